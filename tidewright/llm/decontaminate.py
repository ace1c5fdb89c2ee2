"""Benchmark decontamination: pigeonhole pieces, exact hits, Myers verification.

An item of n characters (lower-cased, white space folded) allows k = floor(RATE n) edits. It is cut
into k + 1 pieces: any stretch of text within k edits of it contains one piece unchanged. One
Aho-Corasick pass finds all pieces of all items; the stretch around a hit is verified once by Myers'
bit-parallel search, so the result is exactly: the least edit distance between the item and any
substring of the text, wherever that is at most k.

The items are a query set taken in blocks of at most BLOCK_BYTES, each block sent to every task; any
number of blocks works. Documents are read once per block and never shuffled.

Defined cases: null and blank texts or items match nothing; an item that repeats is reported under
each of its ids; every row of a repeated document id is reported; a null document id is reported as
null; empty tables give no rows; other columns are ignored; texts are searched whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_rows, map_rows, ship, text_rows

RATE = 0.05
BLOCK_BYTES = 8 << 20
_HITS = "doc_id long, item_id long, distance int"


def normalize(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, rate: float = RATE) -> int:
    return math.floor(rate * len(item))


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of nearly equal length that cover the item."""
    n, k = len(item), budget(item, rate) + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(masks: dict[str, int], length: int, text: str) -> int:
    """Least edit distance between a pattern (as character masks) and any substring of text."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best = score
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        score += (ph & high > 0) - (mh & high > 0)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        up = mh | (full & ~(xv | ph))
        down = ph & xv
        best = min(best, score)
    return best


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """All items of one block."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        found = ((i, normalize(text)) for i, text in items)
        self.items = [(i, text, budget(text, rate), masks(text)) for i, text in found if text]
        starts: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, _, _) in enumerate(self.items):
            for offset, piece in pieces(text, rate):
                starts.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in starts.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if starts:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> dict[int, int]:
        """item number -> least distance, for items within their budget.

        Starts of alignments are verified in windows of 2k + 1, each window once.
        """
        text = normalize(text)
        if not self.items or not text:
            return {}
        tried: set[tuple[int, int]] = set()
        found: dict[int, int] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for n, offset in uses:
                if found.get(n) == 0:
                    continue
                _, item, k, bits = self.items[n]
                start = end - size + 1 - offset
                for window in {(start - k) // (2 * k + 1), (start + k) // (2 * k + 1)}:
                    if (n, window) in tried:
                        continue
                    tried.add((n, window))
                    first = window * (2 * k + 1)
                    stretch = text[max(0, first) : max(0, first + 2 * k + len(item) + k)]
                    distance = 0 if item in stretch else myers(bits, len(item), stretch)
                    if distance <= k:
                        found[n] = min(found.get(n, k), distance)
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance) for every document row and item within the item's error budget."""
    spark = docs.sparkSession
    ship(spark)
    arrow_rows(spark, 512)
    items = text_rows(benchmark, "item_id", "text").select(F.col("doc_id").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    rows, out = text_rows(docs), None
    for n in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n) if blocks > 1 else items
        sent = spark.sparkContext.broadcast([(r.item_id, r.text) for r in block.collect()])
        found = map_rows(rows, _HITS, _searcher(sent, rate))
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(sent, rate: float):
    def search(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        matcher = Matcher(sent.value, rate)
        for batch in batches:
            yield [
                (doc_id, matcher.items[n][0], distance)
                for doc_id, text in batch
                for n, distance in sorted(matcher.search(text).items())
            ]

    return search


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the rows whose text holds an item within its budget; rows and columns else unchanged.

    Each row is judged on its own text, in one pass, without a join.
    """
    spark = docs.sparkSession
    ship(spark)
    arrow_rows(spark, 512)
    items = text_rows(benchmark, "item_id", "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // BLOCK_BYTES))
    for n in range(blocks):
        block = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == n) if blocks > 1 else items
        sent = spark.sparkContext.broadcast([(r.doc_id, r.text) for r in block.collect()])
        docs = docs.mapInArrow(_keeper(sent, rate), docs.schema)
    return docs


def _keeper(sent, rate: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, rate)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.search(t) for t in batch["text"].to_pylist()], pa.bool_()))

    return keep
