"""Token shards as wavelet matrices: one compressed structure per shard, with access, counting and occurrence lookup.

Documents are sorted by id over range partitions of about FILE_BYTES of text; each partition is tokenized
and written as one Parquet file. A row of it is a shard: whole documents of about SHARD_TOKENS ids as one
wavelet matrix, that is bit-planes from the highest bit down with a rank directory per plane (ones before
every 512th bit, 6 % of a plane), all in one zstandard frame, beside the zeros of each plane and the ids and
lengths of the documents. Rank is the directory's entry and at most eight words of bits; select searches the
directory and then one entry's words. Everything a reader returns comes from the files.

Defined cases: null text is empty (its end id alone); null ids sort first; rows that repeat an id
keep their own entries, ordered by text hash; an empty table gives no rows; other columns are ignored.
A document longer than a shard gets a shard of its own. An id outside a matrix occurs nowhere; a position
outside a document has no token and gives no row.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_rows, map_rows, materialize, parts, ship, text_rows
from tidewright.llm.tokens import BYTE, encoder

END_ID = 2
SHARD_TOKENS = 1 << 22
FILE_BYTES = 1 << 28
_SHARD = "part int, shard int, n_tokens long, planes binary, zeros array<long>, doc_ids array<long>, lengths array<long>"
_ENTRY = 8  # words of 64 bits for one entry of a rank directory
_BITS = 64 * _ENTRY


class WaveletMatrix:
    """A sequence of unsigned ids as bit-planes and rank directories; positions and answers are arrays."""

    def __init__(self, planes: np.ndarray, ranks: np.ndarray, zeros: list[int], n: int):
        self.planes, self.ranks, self.zeros, self.n = planes, ranks, zeros, n

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        """Stable partitions by each bit, highest first."""
        now, n = ids, len(ids)
        levels = max(1, int(ids.max(initial=0)).bit_length())
        planes = np.zeros((levels, (n // _BITS + 1) * _BITS // 8), np.uint8)
        zeros = []
        for row, level in zip(planes, reversed(range(levels)), strict=True):
            ones = ((now >> level) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            row[: len(packed)] = packed
            first = np.flatnonzero(~ones)
            zeros.append(len(first))
            now = np.concatenate((now.take(first), now.take(np.flatnonzero(ones))))
        words = planes.view("<u8")
        counts = np.bitwise_count(words).reshape(levels, -1, _ENTRY).sum(axis=2, dtype=np.uint32)
        ranks = np.zeros((levels, counts.shape[1] + 1), np.uint32)
        np.cumsum(counts, axis=1, out=ranks[:, 1:])
        return cls(words, ranks, zeros, n)

    def to_bytes(self) -> bytes:
        return zstandard.ZstdCompressor(level=1).compress(self.planes.tobytes() + self.ranks.astype("<u4").tobytes())

    @classmethod
    def from_bytes(cls, data: bytes, zeros: list[int], n: int) -> WaveletMatrix:
        raw, levels, entries = zstandard.ZstdDecompressor().decompress(data), len(zeros), n // _BITS + 1
        planes = np.frombuffer(raw, "<u8", levels * entries * _ENTRY).reshape(levels, -1)
        return cls(planes, np.frombuffer(raw, "<u4", levels * (entries + 1), planes.nbytes).reshape(levels, -1), list(zeros), n)

    def decode(self) -> np.ndarray:
        """All ids in order: undo the partitions from the lowest plane up."""
        ids = np.zeros(self.n, np.uint32 if len(self.planes) > 16 else np.uint16)
        for level, (plane, zeros) in enumerate(zip(self.planes[::-1], reversed(self.zeros), strict=True)):
            ones = np.unpackbits(plane.view(np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(ids)
            up[np.flatnonzero(~ones)] = ids[:zeros]
            up[np.flatnonzero(ones)] = ids[zeros:] | ids.dtype.type(1 << level)
            ids = up
        return ids

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        entry, word, bit = at // _BITS, at // 64 % _ENTRY, (at % 64).astype(np.uint64)
        words = self.planes[level].reshape(-1, _ENTRY)[entry]
        whole = (np.bitwise_count(words) * (np.arange(_ENTRY) < word[:, None])).sum(axis=1, dtype=np.int64)
        inside = np.bitwise_count(words[np.arange(len(at)), word] & ((np.uint64(1) << bit) - np.uint64(1)))
        return self.ranks[level][entry] + whole + inside

    def _select(self, level: int, one: bool, k: np.ndarray) -> np.ndarray:
        """The position of each k-th one or zero (from 0), which must exist."""
        before = self.ranks[level].astype(np.int64)
        if not one:
            before = np.arange(len(before), dtype=np.int64) * _BITS - before
        entry = np.searchsorted(before, k, side="right") - 1
        bits = np.unpackbits(self.planes[level].reshape(-1, _ENTRY)[entry].view(np.uint8), axis=1, bitorder="little")
        nth = np.cumsum(bits if one else 1 - bits, axis=1, dtype=np.int64)
        return entry * _BITS + (nth > (k - before[entry])[:, None]).argmax(axis=1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The id at each position."""
        at = np.asarray(at, np.int64)
        value = np.zeros(len(at), np.int64)
        for level, zeros in enumerate(self.zeros):
            ones = self._rank1(level, at)
            bit = self._rank1(level, at + 1) - ones
            at = np.where(bit > 0, zeros + ones, at - ones)
            value = value << 1 | bit
        return value

    def _range(self, token: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if token >> len(self.zeros):
            return start, start
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank1(level, start), self._rank1(level, end)
            one = token >> (len(self.zeros) - 1 - level) & 1
            start, end = (zeros + a, zeros + b) if one else (start - a, end - b)
        return start, end

    def count(self, token: int, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Occurrences of an id within each [start, end); the whole sequence by default."""
        start = np.zeros(1, np.int64) if start is None else np.asarray(start, np.int64)
        a, b = self._range(token, start, np.full(len(start), self.n) if end is None else np.asarray(end, np.int64))
        return b - a

    def select(self, token: int, k: np.ndarray) -> np.ndarray:
        """The position of each k-th occurrence (from 0); -1 where there are fewer."""
        k = np.asarray(k, np.int64)
        low, high = (int(x[0]) for x in self._range(token, np.zeros(1, np.int64), np.full(1, self.n)))
        out = np.full(len(k), -1, np.int64)
        known = k < high - low
        at = low + k[known]
        for level in reversed(range(len(self.zeros))):
            one = bool(token >> (len(self.zeros) - 1 - level) & 1)
            at = self._select(level, one, at - self.zeros[level] if one else at)
        out[known] = at
        return out


def _encode(vocabulary: str, shard_tokens: int):
    def encode(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        part, tokenizer = TaskContext.get().partitionId(), encoder(vocabulary)
        end = np.array([END_ID], tokenizer.dtype)
        shard, held, doc_ids, lengths, size = 0, [], [], [], 0

        def row() -> list[tuple]:
            ids = np.concatenate(held)
            held.clear()
            matrix = WaveletMatrix.build(ids)
            return [(part, shard, size, matrix.to_bytes(), matrix.zeros, doc_ids, lengths)]

        for batch in batches:
            for doc_id, text in batch:
                ids = tokenizer.encode(text)
                if size and size + len(ids) + 1 > shard_tokens:
                    yield row()
                    shard, doc_ids, lengths, size = shard + 1, [], [], 0
                held += [ids, end]
                doc_ids.append(doc_id)
                lengths.append(len(ids) + 1)
                size += len(ids) + 1
        if size:
            yield row()

    return encode


def write_shards(docs: DataFrame, files: int | None = None, vocabulary: str = BYTE, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shard files to the shared folder; returns them as read from there.

    As many files as FILE_BYTES of text ask for, or one for each partition of the session's shuffles if
    those are more. The text hash breaks ties of the range partitioning, so that one id in many rows is spread too.
    """
    spark = docs.sparkSession
    ship(spark)
    arrow_rows(spark, 256)
    rows = text_rows(docs)
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        files = max(parts(spark), math.ceil(size / FILE_BYTES))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = rows.repartitionByRange(files, *keys).sortWithinPartitions(*keys)
    return materialize(map_rows(ordered, _SHARD, _encode(vocabulary, shard_tokens)), "token-shards", "uncompressed")


def _decode(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    for batch in batches:
        for part, shard, n_tokens, planes, zeros, doc_ids, lengths in batch:
            matrix = WaveletMatrix.from_bytes(planes, zeros, n_tokens)
            ends = np.cumsum(lengths)
            marks = matrix.count(END_ID, ends - lengths, ends).tolist()
            ids = matrix.decode().astype("<u4")
            yield [
                (doc_id, end - n, n, zlib.crc32(ids[end - n : end].data), mark, part, shard)
                for doc_id, n, end, mark in zip(doc_ids, lengths, ends.tolist(), marks, strict=True)
            ]


def _starts(shards: DataFrame) -> DataFrame:
    """(part, shard, first): ids of the whole corpus before each shard, from one small row per file and shard."""
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = shards.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).select("part", before(Window.orderBy("part")).alias("outer"))
    inside = shards.select("part", "shard", before(Window.partitionBy("part").orderBy("shard")).alias("inner"))
    return inside.join(whole, "part").select("part", "shard", (F.col("outer") + F.col("inner")).alias("first"))


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_end_ids of every document, from the shard files alone.

    n_end_ids, by rank: how often the end id stands in the document, its own end included.
    """
    arrow_rows(shards.sparkSession, 8)
    rows = map_rows(shards, "doc_id long, at long, n_tokens long, ids_crc32 long, n_end_ids long, part int, shard int", _decode)
    return rows.join(_starts(shards), ["part", "shard"]).select(
        "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "n_end_ids"
    )


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: occurrences of each of the tokens in all shards, by rank alone."""

    def count(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            for n_tokens, planes, zeros in batch:
                matrix = WaveletMatrix.from_bytes(planes, zeros, n_tokens)
                yield [(t, int(matrix.count(t)[0])) for t in tokens]

    arrow_rows(shards.sparkSession, 8)
    found = map_rows(shards.select("n_tokens", "planes", "zeros"), "token long, n long", count)
    return found.groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """doc_id, at: every place of a token within its document, by select alone."""

    def find(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            for n_tokens, planes, zeros, doc_ids, lengths in batch:
                matrix = WaveletMatrix.from_bytes(planes, zeros, n_tokens)
                at = matrix.select(token, np.arange(int(matrix.count(token)[0])))
                ends = np.cumsum(lengths)
                doc = np.searchsorted(ends, at, side="right")
                yield [(doc_ids[d], x) for d, x in zip(doc.tolist(), (at - (ends - lengths)[doc]).tolist(), strict=True)]

    arrow_rows(shards.sparkSession, 8)
    return map_rows(shards.select("n_tokens", "planes", "zeros", "doc_ids", "lengths"), "doc_id long, at long", find)


def tokens_at(shards: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, at, token for the (doc_id, at) of wanted that exist, by access alone; only shards asked for are opened."""
    asked = wanted.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("at").cast("long").alias("at")).distinct()
    where = shards.select("part", "shard", F.explode("doc_ids").alias("doc_id")).distinct().join(asked, "doc_id")
    where = where.groupBy("part", "shard").agg(F.collect_list("doc_id").alias("docs"), F.collect_list("at").alias("ats"))

    def look(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            for n_tokens, planes, zeros, doc_ids, lengths, docs, ats in batch:
                matrix = WaveletMatrix.from_bytes(planes, zeros, n_tokens)
                starts = (np.cumsum(lengths) - lengths).tolist()
                places: dict[int, list[tuple[int, int]]] = {}
                for d, a, n in zip(doc_ids, starts, lengths, strict=True):
                    places.setdefault(d, []).append((a, n))
                found = [(d, x, a + x) for d, x in zip(docs, ats, strict=True) for a, n in places[d] if 0 <= x < n]
                yield [(d, x, t) for (d, x, _), t in zip(found, matrix.access([p for *_, p in found]).tolist(), strict=True)]

    arrow_rows(shards.sparkSession, 8)
    rows = shards.join(where, ["part", "shard"]).select("n_tokens", "planes", "zeros", "doc_ids", "lengths", "docs", "ats")
    return map_rows(rows, "doc_id long, at long, token long", look)
