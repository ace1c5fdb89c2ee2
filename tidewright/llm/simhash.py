"""SimHash near-duplicates: segment popcounts as an embedding, a grid join under Manhattan distance.

A fingerprint's 64 bits are cut into 32 segments of 2 bits; the embedding is the vector of their bit
counts. Manhattan distance between two embeddings never exceeds the Hamming distance of the
fingerprints, so fingerprints within 3 bits lie within Manhattan distance 3. The 32 coordinates form
groups; at most three groups can differ, so all but three agree, and the choices of all but three
groups are the grid: two near fingerprints share the cell of at least one choice. There are six groups
or more, so many that a cell holds few fingerprints by chance however many there are. Inside a cell a
range join keeps pairs within Manhattan distance 3, and the bits verify them after.

Only distinct fingerprints meet in the grid (copies share theirs). A cell of at most PAIR_ROWS is
joined in place; a larger one returns a spanning forest of its links instead of all pairs. A cell of
more than CELL_ROWS is split once more: of four groups of its other coordinates one at least agrees, so
near fingerprints meet again in a smaller cell. What is still larger is cut into blocks whose pairs are
separate groups: nothing quadratic leaves a task, and no link between components is lost.

Defined cases: null text is an empty text; texts without words have fingerprint zero; null ids are
left out (a component is named by ids); repeated rows of an id come back once each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_rows, map_rows, materialize, ship, text_rows
from tidewright.llm.components import connected_components

RADIUS = 3
WIDTH = 2
LEAST_GROUPS = 6
CELL_ROWS = 2048
PAIR_ROWS = 32
BROADCAST_ROWS = 1_000_000
_SPLIT = re.compile(rb"[\x20\x09-\x0D]+")
_LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """64 majority bits over the XXH64 (seed 42) of the word shingles, repeats included."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOW)
    words = [w for w in _SPLIT.split(data) if w]
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    size = min(size, len(words))
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - size + 1].tolist()
    shingles = [whole[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, len(shingles))
    octets = hashes.view(np.uint8).reshape(-1, 8)
    out = 0
    for k in range(8):
        counts = np.bincount(octets[:, k], minlength=256) @ _BITS
        out |= int(((2 * counts > len(shingles)) << np.arange(8)).sum()) << (8 * k)
    return out


def _fingerprints(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    for batch in batches:
        found = np.fromiter((fingerprint(text) for _, text in batch), np.uint64, len(batch)).view(np.int64).tolist()
        yield [(doc_id, fp) for (doc_id, _), fp in zip(batch, found, strict=True)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row with an id."""
    spark = docs.sparkSession
    ship(spark)
    arrow_rows(spark, 512)
    return map_rows(text_rows(docs).where(F.col("doc_id").isNotNull()), "doc_id long, fp long", _fingerprints)


def embedding(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, one row per fingerprint."""
    pairs = (fp.astype(np.uint64)[:, None] >> np.arange(0, 64, WIDTH, dtype=np.uint64)) & np.uint64(3)
    return (pairs & np.uint64(1)).astype(np.uint8) + (pairs >> np.uint64(1)).astype(np.uint8)


def groups_for(n: int) -> int:
    """The least number of groups whose cells (1.5 bits a coordinate) number 16 times the fingerprints or more."""
    wanted = math.log2(max(2, n)) + 4
    return next((g for g in range(LEAST_GROUPS, 16) if 1.5 * (64 // WIDTH) * (g - RADIUS) / g >= wanted), 16)


def _keys(counts: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The given coordinates in base 3."""
    return counts[:, columns] @ (3 ** np.arange(len(columns), dtype=np.int64))


def _grid(groups: int) -> tuple[list[np.ndarray], list[tuple[int, ...]]]:
    return np.array_split(np.arange(64 // WIDTH), groups), list(combinations(range(groups), groups - RADIUS))


def _cells(groups: int):
    """The grid cells of each fingerprint: for each choice of groups, their coordinates."""
    coordinates, choices = _grid(groups)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            counts = embedding(fp.view(np.uint64)).astype(np.int64)
            for n, choice in enumerate(choices):
                cell = _keys(counts, np.concatenate([coordinates[g] for g in choice]))
                yield pd.DataFrame({"cell": cell * len(choices) + n, "fp": fp})

    return cells


def _smaller_cells(groups: int):
    """The cells that a fingerprint of a large cell is split to: by each of RADIUS + 1 groups of the cell's other coordinates."""
    coordinates, choices = _grid(groups)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            of = batch["cell"].to_numpy() % len(choices)
            for n in np.unique(of).tolist():
                rows = batch[of == n]
                counts = embedding(rows["fp"].to_numpy().view(np.uint64)).astype(np.int64)
                other = np.concatenate([coordinates[g] for g in range(groups) if g not in choices[n]])
                for i, columns in enumerate(np.array_split(other, RADIUS + 1)):
                    yield pd.DataFrame({"cell": rows["cell"], "part": _keys(counts, columns) * (RADIUS + 1) + i, "fp": rows["fp"]})

    return cells


def manhattan(a: Column, b: Column) -> Column:
    """Distance of the embeddings: per segment one bit says that its count is odd, the other that it is two."""
    low = F.lit(0x5555555555555555)
    counts = [(x.bitwiseAND(low), F.shiftrightunsigned(x, 1).bitwiseAND(low)) for x in (a, b)]
    odd, two = (counts[0][0].bitwiseXOR(counts[0][1]), counts[0][0].bitwiseAND(counts[0][1]))
    odd2, two2 = (counts[1][0].bitwiseXOR(counts[1][1]), counts[1][0].bitwiseAND(counts[1][1]))
    odd, two = odd.bitwiseXOR(odd2), two.bitwiseXOR(two2)
    return F.bit_count(odd) + 2 * F.bit_count(two.bitwiseAND(F.bitwise_not(odd)))


def forest(left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links within left, or between left and right."""
    nodes = left if right is None else np.concatenate((left, right))
    first = len(left) if right is not None else 0
    low = embedding(nodes).astype(np.int16)
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(len(left)):
        rest = np.arange(first or i + 1, len(nodes))
        near = rest[np.abs(low[rest] - low[i]).sum(axis=1) <= RADIUS]
        if len(near):
            near = near[np.bitwise_count(nodes[near] ^ nodes[i]) <= RADIUS]
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                links.append((i, j))
    signed = nodes.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in links]


def _cell_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links of one cell, or of one pair of its blocks (side 1 against side 2)."""
    fp = group["fp"].to_numpy().view(np.uint64)
    side = group["side"].to_numpy()
    links = forest(fp) if not side.any() else forest(fp[side == 1], fp[side == 2])
    return pd.DataFrame(links, columns=["src", "dst"], dtype="int64")


def _pairs(shared: DataFrame, key: list[str]) -> DataFrame:
    """(src, dst) of the links in cells of at most PAIR_ROWS, joined in place."""
    rows = shared.where(F.col("n") <= PAIR_ROWS).select(*key, "fp")
    left, right = rows.withColumnRenamed("fp", "src"), rows.withColumnRenamed("fp", "dst")
    src, dst = F.col("src"), F.col("dst")
    return left.join(right, key).where((src < dst) & (manhattan(src, dst) <= RADIUS) & (F.bit_count(src.bitwiseXOR(dst)) <= RADIUS)).select("src", "dst")


def _counted(cells: DataFrame, key: list[str]) -> DataFrame:
    return cells.join(cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), key)


def links(fps: DataFrame) -> DataFrame:
    """(src, dst): links between distinct fingerprints, enough to keep every component together."""
    groups = groups_for(fps.count())
    cells = materialize(fps.mapInPandas(_cells(groups), "cell long, fp long"), "simhash-cells", "zstd")
    shared = _counted(cells, ["cell"])
    part, none = F.lit(0).cast("long").alias("part"), [F.lit(0).alias(x) for x in ("a", "b", "side")]
    large = shared.where(F.col("n") > CELL_ROWS).select("cell", "fp").mapInPandas(_smaller_cells(groups), "cell long, part long, fp long")
    large = materialize(large, "simhash-large-cells", "zstd")
    again = _counted(large, ["cell", "part"])
    small = shared.where((F.col("n") > PAIR_ROWS) & (F.col("n") <= CELL_ROWS)).select("cell", part, "fp", *none)
    small = small.unionByName(again.where((F.col("n") > PAIR_ROWS) & (F.col("n") <= CELL_ROWS)).select("cell", "part", "fp", *none))
    blocks = F.ceil(F.col("n") / CELL_ROWS).cast("int")
    block = F.pmod(F.xxhash64("fp"), blocks.cast("long")).cast("int")
    big = again.where(F.col("n") > CELL_ROWS).select("cell", "part", "fp", blocks.alias("k"), block.alias("own"))
    big = big.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select(
        "cell",
        "part",
        "fp",
        F.least("own", "other").alias("a"),
        F.greatest("own", "other").alias("b"),
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    forests = small.unionByName(big).groupBy("cell", "part", "a", "b").applyInPandas(_cell_links, "src long, dst long")
    found = _pairs(shared, ["cell"]).unionByName(_pairs(again, ["cell", "part"])).unionByName(forests)
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links."""
    marked = materialize(fingerprints(docs), "simhash-fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    found = materialize(links(distinct.select("fp")), "simhash-links")
    # Links between fingerprints become links between the smallest ids that bear them.
    named = found.join(distinct.select(F.col("fp").alias("src"), F.col("first_id").alias("a")), "src").join(
        distinct.select(F.col("fp").alias("dst"), F.col("first_id").alias("b")), "dst"
    )
    labels = connected_components(named.select("a", "b"))
    classes = distinct.join(labels, distinct.first_id == labels.node, "left").select(
        "fp", F.coalesce("component", "first_id").alias("component_id")
    )
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """docs without the ids whose component has a smaller id; all columns stay, rows without an id too.

    Rows that repeat a kept id come down to one. The removed ids, a fraction of all, are broadcast
    while there are at most BROADCAST_ROWS of them and joined by a shuffle beyond.
    """
    found = near_duplicates(docs)
    found = materialize(found.select("doc_id", (F.col("doc_id") != F.col("component_id")).alias("goes")), "simhash-kept")
    gone = found.where("goes").select(F.col("doc_id").alias("__gone")).distinct()
    n_gone, rows, ids = found.agg(F.count(F.when(F.col("goes"), 1)), F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    gone = F.broadcast(gone) if n_gone <= BROADCAST_ROWS else gone
    kept = docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
    if rows == ids:
        return kept
    return kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).unionByName(kept.where(F.col("doc_id").isNull()))
