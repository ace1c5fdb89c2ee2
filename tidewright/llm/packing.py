"""Best-fit packing of tokenized documents with certified bin counts.

Documents are tokenized once; the pieces (lengths and checksums only) are written, dealt evenly into
partitions of about PER_PARTITION rows and packed there by best-fit decreasing. Dual feasible
functions give each partition a lower bound; a partition that meets its bound is certified and keeps
its bins. One that does not is packed a second way, each bin's room filled by the best pair of what is
left, also with shares of its largest pieces kept apart where it is over 1 % from its bound, and takes the best. If gaps remain, it keeps the bins that no piece of it fits into and hands the
documents of the rest to a common pool, which is dealt into partitions of the same size, so that
documents are exchanged, and packed again. Rounds end when all is certified, one partition is left, or a
round settles less than a quarter of its rows; then every partition's bins stand as they are, and
`gap` tells how many bins its partition has over its bound. No partition outgrows PER_PARTITION.

Defined cases: null text is empty and packs as its end id alone; null and repeated ids are packed row
by row; an empty table gives no pieces; other columns are ignored; texts are tokenized whole.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_rows, map_rows, materialize, ship, text_rows
from tidewright.llm.tokens import WORD, encoder

CAPACITY = 4096
END_ID = 1
PER_PARTITION = 40_000
APART = (0.12, 0.2, 0.28, 0.36)
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECES}, bin long, offset long, settled boolean, gap long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = WORD) -> DataFrame:
    """One row per piece: where it starts in its document, its length and its ids' crc32."""
    spark = docs.sparkSession
    ship(spark)
    arrow_rows(spark, 512)

    def cut(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            rows = []
            for doc_id, text in batch:
                ids = np.append(encode(text), END_ID).astype("<u4")
                for n, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc_id, n, at, len(part), zlib.crc32(part.tobytes())))
            yield rows

    return map_rows(text_rows(docs), _PIECES, cut)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin.

    Bins wait in lists by free room; a bit set of the rooms in use finds the tightest that fits.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    waiting: dict[int, list[int]] = {}
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            at = waiting[room].pop()
            if not waiting[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = at, fill[at]
        fill[at] += size
        if left := room - size:
            waiting.setdefault(left, []).append(at)
            rooms |= 1 << left
    return bins, offsets, np.asarray(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of three families of dual feasible functions, in whole numbers throughout.

    Identity: total length. Threshold t <= capacity / 2: items over capacity - t count as full, items
    under t as nothing. Rounding k: (k + 1) x / capacity is rounded down unless it is whole.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    sums = np.concatenate(([0], np.cumsum(sizes * counts)))
    numbers = np.concatenate(([0], np.cumsum(counts)))
    best = -(-int(sums[-1]) // capacity)
    low = sizes[sizes <= capacity // 2]
    if len(low):
        above = np.searchsorted(sizes, capacity - low, side="right")
        first = np.searchsorted(sizes, low, side="left")
        value = (numbers[-1] - numbers[above]) * capacity + sums[above] - sums[first]
        best = max(best, int((-(-value // capacity)).max()))
    for k in range(1, 64):
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        exact = int((sizes * counts)[whole].sum())
        rounded = int(((scaled // capacity) * counts)[~whole].sum())
        best = max(best, -(-(exact * k + rounded * capacity) // (capacity * k)))
    return best


def fill_by_pairs(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin: the largest item left opens a bin, and the one or two
    items left that fill its room best follow, as long as any fits.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left: dict[int, list[int]] = {}
    for i, size in enumerate(lengths.tolist()):
        left.setdefault(size, []).append(i)
    sizes = sum(1 << size for size in left)  # a bit set of the sizes left
    fill: list[int] = []

    def take(size: int) -> None:
        nonlocal sizes
        i = left[size].pop()
        if not left[size]:
            sizes ^= 1 << size
        bins[i], offsets[i] = len(fill) - 1, fill[-1]
        fill[-1] += size

    def up_to(room: int) -> int:
        """The largest size left within the room, 0 if none."""
        return max(0, (sizes & (2 << room) - 1).bit_length() - 1)

    while sizes:
        fill.append(0)
        take(sizes.bit_length() - 1)
        while one := up_to(capacity - fill[-1]):
            room = capacity - fill[-1]
            best, first = one, one
            at = one
            while at and best < room and 2 * at > best:  # the larger of the two is at least half of what they fill
                one_left = len(left[at]) == 1
                other = up_to(min(at, room - at))
                if other == at and one_left:
                    other = up_to(at - 1)
                if at + other > best:
                    best, first = at + other, at
                at = up_to(at - 1)
            take(first)
            if best > first:
                take(best - first)
    return bins, offsets, np.asarray(fill, np.int64)


def two_ways(lengths: np.ndarray, capacity: int, apart: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The share `apart` of the largest items by best-fit decreasing among themselves, the others by pairs.

    Large items that take two small ones each leave none for the middle; kept apart, they pair with each other.
    """
    order = np.argsort(-lengths, kind="stable")
    cut = int(apart * len(order))
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills, begun = [], 0
    for items, way in ((order[:cut], best_fit_decreasing), (order[cut:], fill_by_pairs)):
        inner, offsets[items], fill = way(lengths[items], capacity)
        bins[items] = inner + begun
        fills.append(fill)
        begun += len(fill)
    return bins, offsets, np.concatenate(fills)


def _pack(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy()
        bound = lower_bound(lengths, capacity)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        if len(fill) > bound:
            ways = [fill_by_pairs(lengths, capacity), *(two_ways(lengths, capacity, x) for x in APART if len(fill) > 1.01 * bound)]
            bins, offsets, fill = min((bins, offsets, fill), *ways, key=lambda packed: len(packed[2]))
        gap = len(fill) - bound
        settled = np.ones(len(lengths), bool) if not gap else (capacity - fill < lengths.min())[bins]
        ids = int(group["part"].iloc[0]) * (1 << 32) + bins
        return group.drop(columns="part").assign(bin=ids, offset=offsets, settled=settled, gap=gap)

    return pack


def pack_sequences(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """pieces with sequence_id, offset and gap; each sequence is gapless from 0 and holds at most capacity."""
    rows = pieces.count()
    round_no, done = 0, None
    while True:
        width = max(1, math.ceil(rows / per_partition))
        deal = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(width)).alias("part")
        packed = pieces.select("*", deal).groupBy("part").applyInPandas(_pack(capacity), _PACKED)
        packed = materialize(packed.withColumn("round", F.lit(round_no)), "packing")
        pool = packed.where(~F.col("settled"))
        left = pool.count()
        last = not left or width == 1 or left > 0.75 * rows
        kept = packed if last else packed.where("settled")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done.select(
                "doc_id", "piece", "start", "length", "ids_crc32",
                (F.col("round").cast("long") * (1 << 56) + F.col("bin")).alias("sequence_id"), "offset", "gap",
            )
        rows, round_no = left, round_no + 1
        pieces = pool.select(*[c.split(" ")[0] for c in _PIECES.split(", ")])


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = WORD) -> DataFrame:
    """Tokenize, cut and pack whole documents."""
    return pack_sequences(materialize(token_pieces(docs, capacity, vocabulary), "token-pieces"), capacity)
