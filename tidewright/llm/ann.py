"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, best bin first.

Equal vectors are one entry with its K + 1 smallest ids, so copies neither fill leaves nor repeat
work. Largest inner product becomes least distance by one more coordinate that brings every vector to
the greatest norm. The tree is fitted on at most SAMPLE distinct vectors; every vector is then put
into its leaf. A query walks the tree through a priority queue of cells, nearest first. The number of
leaves it opens is calibrated: PROBES queries are answered by brute force, and visits widen until
their recall reaches RECALL. A leaf is cut into chunks, and the queries that visit it into blocks, so that
no group grows with a hot leaf and a vector moves once per block of its own leaf's visitors; each
(block, chunk) is one matrix product whose scores are double precision
inner products of the original vectors.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
values take no part, nor do rows without an id; fewer candidates than K give fewer rows; rows that
repeat an id are candidates with their own vectors, never for the query of the same id; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_rows, map_rows, materialize, ship

K = 20
SAMPLE = 20_000
PROBES = 64
RECALL = 0.95
LEAF = 1024
BRANCH = 8
CHUNK = 4096
BLOCK = 4096


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels by Lloyd's rounds from a fixed random start; empty cells are dropped."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        labels = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        used, labels = np.unique(labels, return_inverse=True)
        sums = np.zeros((len(used), x.shape[1]))
        np.add.at(sums, labels, x)
        centres = sums / np.bincount(labels)[:, None]
    return centres, np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)


class Tree:
    """Inner nodes hold their children's centres; leaves are numbered in depth-first order."""

    def __init__(self, sample: np.ndarray, leaves: int, top: float, branch: int = BRANCH):
        self.top, self.leaves, self.nodes = top, 0, []
        self.root = self._grow(self.lift(sample), leaves, branch, 0) if len(sample) else -1
        if not self.leaves:
            self.root, self.leaves = ~0, 1

    def lift(self, x: np.ndarray) -> np.ndarray:
        """One more coordinate that makes all norms equal, so that least distance is largest product."""
        return np.hstack([x, np.sqrt(np.maximum(0, self.top**2 - (x**2).sum(axis=1)))[:, None]])

    def _grow(self, x: np.ndarray, leaves: int, branch: int, seed: int) -> int:
        centres, labels = kmeans(x, min(branch, leaves), seed) if leaves > 1 and len(x) > 1 else (x[:1], np.zeros(len(x), int))
        if len(centres) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        at = len(self.nodes)
        self.nodes.append(None)
        children = [
            self._grow(x[labels == c], max(1, round(leaves * float((labels == c).mean()))), branch, seed * branch + c + 1) for c in range(len(centres))
        ]
        self.nodes[at] = (centres, children)
        return at

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector by descent to the nearest centre."""
        out = np.empty(len(x), np.int64)
        stack = [(self.root, np.arange(len(x)))]
        lifted = self.lift(x)
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = ~node
                continue
            centres, children = self.nodes[node]
            nearest = np.argmin((centres**2).sum(axis=1) - 2 * lifted[rows] @ centres.T, axis=1)
            stack += [(child, rows[nearest == c]) for c, child in enumerate(children) if (nearest == c).any()]
        return out

    def visit(self, query: np.ndarray, count: int) -> list[int]:
        """The first `count` leaves, best bin first, for a query scaled to the common norm."""
        q = np.append(query * (self.top / max(1e-300, float(np.linalg.norm(query)))), 0.0)
        heap, found = [(0.0, self.root)], []
        while heap and len(found) < count:
            _, node = heapq.heappop(heap)
            if node < 0:
                found.append(~node)
                continue
            centres, children = self.nodes[node]
            for d, child in zip(((centres - q) ** 2).sum(axis=1).tolist(), children, strict=True):
                heapq.heappush(heap, (d, child))
        return found


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, key): rows that take part; key names the exact vector."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull()
        & F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).select("size").first()
    rows = rows.where(F.size("v") == (size[0] if size else 0))
    return rows.withColumn("key", F.concat(F.hex(F.xxhash64("v")), F.hex(F.xxhash64(F.lit(7), "v"))))


def _top(scores: np.ndarray, first_ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k best by score, ties to the smaller first id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= edge)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((first_ids[kept], -scores[kept]))][:k]


def _product(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return queries @ vectors.T


def search(vectors: DataFrame, every: int = 20, k: int = K, recall: float = RECALL, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    ship(spark)
    arrow_rows(spark, 2048)
    rows = usable(vectors)
    order = Window.partitionBy("key").orderBy("vec_id")
    nearest_ids = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    entries = materialize(nearest_ids.groupBy("key").agg(F.any_value("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-entries")
    n, top = entries.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("key", "vec_id").distinct()
    asked = materialize(asked, "ann-asked")
    queries = materialize(entries.join(asked.select("key").distinct(), "key", "left_semi").select("key", "v"), "ann-queries")

    sample = np.array([r.v for r in entries.orderBy(F.xxhash64(F.lit(1), "key"), "key").select("v").limit(SAMPLE).collect()])
    tree = Tree(sample, max(1, min(math.ceil((n or 0) / leaf), len(sample) // 8)), float(top or 1.0))
    sent = spark.sparkContext.broadcast(tree)

    def assign(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            if batch:
                leaves = sent.value.assign(np.array([v for _, v, _ in batch])).tolist()
                yield [(at, v, ids) for at, (_, v, ids) in zip(leaves, batch, strict=True)]

    placed = materialize(map_rows(entries.select("key", "v", "ids"), "leaf long, v array<double>, ids array<long>", assign), "ann-leaves")
    probes = [(r.key, r.v) for r in queries.orderBy(F.xxhash64(F.lit(2), "key"), "key").limit(PROBES).collect()]
    visits = calibrate(placed, tree, probes, k, recall)

    def walk(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for batch in batches:
            yield [(key, at) for key, v in batch for at in sent.value.visit(np.array(v), visits)]

    opened = materialize(map_rows(queries.select("key", "v"), "key string, leaf long", walk), "ann-visits")
    pieces = lambda rows, size, name: rows.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    leaves = pieces(placed, CHUNK, "chunks").join(pieces(opened, BLOCK, "blocks"), "leaf")  # one small row for each visited leaf
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n).cast("long")).cast("int")
    walked = opened.join(queries.select("key", "v"), "key").join(leaves, "leaf").withColumn("block", deal("key", "blocks"))
    walked = walked.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    stored = placed.join(leaves, "leaf").withColumn("chunk", deal(F.col("ids")[0], "chunks"))
    stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "score": [], "ids": []}, dtype=object)
        x, first = np.stack(left["v"]), np.array([ids[0] for ids in left["ids"]])
        out = []
        for at in range(0, len(right), 512):
            products = _product(np.stack(right["v"].iloc[at : at + 512]), x)
            out += [(s[best], best) for s in products if len(best := _top(s, first, k + 1))]
        ids = left["ids"].to_numpy()
        return pd.DataFrame({"key": right["key"].to_numpy(), "score": [s for s, _ in out], "ids": [[ids[i] for i in b] for _, b in out]})

    scored = (
        stored.select("leaf", "chunk", "block", "v", "ids")
        .groupBy("leaf", "chunk", "block")
        .cogroup(walked.select("leaf", "chunk", "block", "key", "v").groupBy("leaf", "chunk", "block"))
        .applyInPandas(score, "key string, score array<double>, ids array<array<long>>")
    )
    # Per distinct query: the k + 1 best entries of all opened leaves, then the k best ids but its own.
    pairs = F.arrays_zip((F.transform("score", lambda s: -s)).alias("s"), F.col("ids").alias("i"))
    merged = scored.select("key", pairs.alias("pairs")).groupBy("key").agg(F.flatten(F.collect_list("pairs")).alias("pairs"))
    flat = F.flatten(F.transform("pairs", lambda p: F.transform(p["i"], lambda i: F.struct(p["s"].alias("s"), i.alias("id")))))
    own = merged.select("key", F.slice(F.array_sort("pairs"), 1, k + 1).alias("pairs")).select("key", flat.alias("near")).join(asked, "key")
    best = F.slice(F.array_sort(F.filter("near", lambda p: p["id"] != F.col("vec_id"))), 1, k)
    return own.select(F.col("vec_id").alias("query_id"), F.posexplode(best).alias("pos", "p")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("p.id").alias("vec_id"), (-F.col("p.s")).alias("score")
    )


def calibrate(placed: DataFrame, tree: Tree, probes: list[tuple[str, list[float]]], k: int, recall: float) -> int:
    """The least number of leaves that finds `recall` of the probes' exact neighbours."""
    if not probes:
        return 1
    asked = np.array([v for _, v in probes])

    def exact(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        best: list[list[tuple]] = [[] for _ in asked]
        for batch in batches:
            if batch:
                scores = _product(asked, np.array([v for _, v, _ in batch]))
                first = np.array([ids[0] for _, _, ids in batch])
                for q, s in enumerate(scores):
                    best[q] = sorted(best[q] + [(float(-s[i]), int(first[i]), batch[i][0]) for i in _top(s, first, k)])[:k]
        yield [(q, s, i, at) for q, found in enumerate(best) for s, i, at in found]

    rows = map_rows(placed.select("leaf", "v", "ids"), "probe int, s double, id long, leaf long", exact)
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy("s", "id"))).where(F.col("n") <= k)
    wanted: dict[int, list[int]] = {}
    for r in ranked.select("probe", "leaf").collect():
        wanted.setdefault(r.probe, []).append(r.leaf)
    place = []
    for q, leaves in wanted.items():
        order = {leaf: i + 1 for i, leaf in enumerate(tree.visit(asked[q], tree.leaves))}
        place += [order[leaf] for leaf in leaves]
    place.sort()
    return place[max(0, math.ceil(recall * len(place)) - 1)] if place else 1
