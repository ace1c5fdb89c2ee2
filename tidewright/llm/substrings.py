"""Repeated-substring removal: shard Burrows-Wheeler transforms merged by interleave refinement.

A byte goes if a WINDOW-byte string that covers it also starts anywhere else. Texts are worked on once
per distinct text (SHA-256); a text that occurs twice is repeated as a whole.

Candidates. Every window has an anchor: the place of the least hash among its GRAM-byte strings
(winnowing), which equal windows share. A window holds at least HALF bytes before or after its anchor,
so it also holds the anchor's left or right piece; if that piece occurs once in the corpus, the window
does too. Pieces are counted over all texts by their hashes, and only stretches of windows with a
repeated piece go on: nothing that repeats is lost, and most text never moves.

Merge. A stretch is a string around its piece, `base` its piece's place; a window begins k bytes before
the base, so it is the suffix that the base reaches after k steps of the Burrows-Wheeler walk. Stretches
meet by their piece, equal ones are one. A group's stretches are cut into shards. Each shard is sorted
once, by what follows the bases (no further than WINDOW bytes), and keeps the common prefixes of
neighbours. The shards' orders are merged by refining their interleaving: entries of all shards that
agree so far are a block, and a round splits the blocks by the next STEP bytes, keeping each shard's
own order; a block with entries of one shard is left alone, for that shard has sorted it. So merging
gives one order and the common prefix of all neighbours, and no suffixes are sorted across shards. Then
k runs from 0: each step takes every entry to the suffix one byte longer and splits blocks by that
preceding byte; windows that agree in the k bytes before the base and have a common prefix of WINDOW - k
after it are a repeated interval.

Frequent pieces. A piece whose differing stretches exceed HOT_BYTES is split: the windows before and
after the middle of its range also share a longer piece, which replaces it, until the groups are small
or the piece is a whole window, whose stretches are all equal. No group grows with the frequency.

Defined cases: null text is empty; null and repeated ids keep their rows; matches never cross
documents; windows are judged on the input; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_rows, map_rows, materialize, ship, text_rows

WINDOW = 200
GRAM = 50
HALF = (WINDOW - GRAM) // 2
PIECE = GRAM + HALF
STEP = 7
SHARD = 1 << 17
GROUP_BYTES = 1 << 20
HOT_BYTES = 1 << 18
HOT_ROWS = 20_000
BLOCK = 1 << 17
BROADCAST_ROWS = 1_000_000
_TABLE = np.random.default_rng(12345).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every `size`-byte string, by joining hashes of doubling length."""
    parts, h, width = [], _TABLE[data], 1
    rest, at, out = size, 0, None
    level = 0
    while rest:
        if rest & 1:
            parts.append((h, at))
            at += width
        rest >>= 1
        if rest:
            h = h[: len(h) - width] * _STEP[level % 7] + (h[width:] ^ (h[width:] >> np.uint64(29)))
            level += 1
            width *= 2
    n = len(data) - size + 1
    for h, offset in parts:
        piece = h[offset : offset + n]
        out = piece.copy() if out is None else out * _STEP[3] + (piece ^ (piece >> np.uint64(31)))
    return out * _STEP[0] ^ (out >> np.uint64(32))


def _sliding(h: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every `size` neighbours, by doubling."""
    width = 1
    while width * 2 <= size:
        h = pick(h[: len(h) - width], h[width:])
        width *= 2
    if width < size:
        gap = size - width
        h = pick(h[: len(h) - gap], h[gap:])
    return h


def anchors(data: np.ndarray, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) for runs of windows with one anchor, in order.

    A window's anchor is the leftmost least hash among its grams. `valid` marks the places where a
    window may start; by default all.
    """
    h = gram_hashes(data, GRAM)
    span = WINDOW - GRAM + 1
    least = _sliding(h, span, np.minimum)
    starts = np.arange(len(least)) if valid is None else np.flatnonzero(valid)
    # The grams that are the least of a window: those that equal the largest least of the windows in reach.
    known = least if valid is None else np.where(valid, least, np.uint64(0))
    top = _sliding(np.concatenate((np.zeros(span - 1, np.uint64), known, np.zeros(span - 1, np.uint64))), span, np.maximum)
    at = np.flatnonzero(top[: len(h)] == h)
    first = np.searchsorted(at, starts)
    # Chosen grams of a window may include others' minima; walk to the one that is this window's least.
    want = least[starts]
    own = at[first]
    wrong = np.flatnonzero(h[own] != want)
    while len(wrong):
        first[wrong] += 1
        own[wrong] = at[first[wrong]]
        wrong = wrong[h[own[wrong]] != want[wrong]]
    fresh = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)))) if len(own) else np.empty(0, np.int64)
    return own[fresh], starts[fresh], starts[np.append(fresh[1:], len(own)) - 1] if len(own) else fresh


def stretches(data: np.ndarray, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece hash, base, first window, last window) of all runs of windows that share a left or right piece.

    Windows that start HALF or less before the anchor hold its right piece, the others its left piece.
    """
    if len(data) < WINDOW:
        none = np.empty(0, np.int64)
        return none, none, none, none
    if len(data) >= BLOCK + WINDOW:  # long texts block by block; a run that a block's end cuts is two runs
        parts = []
        for at in range(0, len(data) - WINDOW + 1, BLOCK):
            keys, *places = stretches(data[at : at + BLOCK + WINDOW - 1], None if valid is None else valid[at : at + BLOCK])
            parts.append((keys, *(p + at for p in places)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    anchor, low, high = anchors(data, valid)
    pieces = gram_hashes(data, PIECE)
    middle = anchor - HALF
    right = high >= middle
    left = low < middle
    keys = np.concatenate((pieces[anchor[right]], ~pieces[middle[left]]))
    bases = np.concatenate((anchor[right], middle[left]))
    lows = np.concatenate((np.maximum(low[right], middle[right]), low[left]))
    highs = np.concatenate((high[right], np.minimum(high[left], middle[left] - 1)))
    order = np.argsort(lows, kind="stable")
    return keys[order].view(np.int64), bases[order], lows[order], highs[order]


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in a row, their ends with a leading zero); nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    octets = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return octets, ends - ends[0]


def _batch_stretches(octets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """stretches of many texts at once, windows across their ends left out, and the text of each."""
    valid = np.zeros(max(0, len(octets) - WINDOW + 1), bool)
    change = np.zeros(len(valid) + 1, np.int32)
    some = np.diff(ends) >= WINDOW
    np.add.at(change, ends[:-1][some], 1)
    np.add.at(change, ends[1:][some] - WINDOW + 1, -1)
    valid = np.cumsum(change[:-1]) > 0
    keys, bases, lows, highs = stretches(octets, valid)
    return keys, bases, lows, highs, np.searchsorted(ends, lows, side="right") - 1


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's id, size, SHA-256 and the piece hashes of its stretches."""
    for batch in batches:
        octets, ends = _texts(batch.column(1))
        keys, _, _, _, owner = _batch_stretches(octets, ends)
        offsets = np.searchsorted(owner, np.arange(len(ends))).astype(np.int32)
        data = octets.tobytes()
        sha = [hashlib.sha256(data[a:b]).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(ends)), pa.array(sha, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))],
            ["doc_id", "n_bytes", "key", "names"],
        )


_PIECE = "name long, sid binary, row long, single boolean, start long, base int, size int, piece binary"


def _stretch(name: int, row: int, single: bool, start: int, base: int, size: int, piece: bytes) -> tuple:
    return name, xxhash.xxh3_128_digest(piece), row, single, start, base, size, piece


def _cut(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    """The stretches of a text whose piece is repeated: all bytes of a run of windows, base counted from its start."""
    for batch in batches:
        rows = []
        for row, single, text, names in batch:
            data = text.encode("utf-8", "surrogatepass")
            found, base, low, high = stretches(np.frombuffer(data, np.uint8))
            hit = np.isin(found, np.array(names, np.int64))
            rows += [
                _stretch(name, row, single, a, at - a, PIECE, data[a : b + WINDOW])
                for name, at, a, b in zip(*(x[hit].tolist() for x in (found, base, low, high)), strict=True)
            ]
        yield rows


def _split(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    """Stretches cut in two at the middle of the range of windows, each half by the longer piece it shares.

    Windows begin at most WINDOW - size bytes before the base. Those that begin at most half of that before
    it also share what follows the piece; the others what precedes it.
    """
    for batch in batches:
        rows = []
        for name, row, single, start, base, size, piece in batch:
            half, last = (WINDOW - size) // 2, len(piece) - WINDOW
            middle = base - half
            for a, b, at, longer in ((max(0, middle), last, base, WINDOW - half), (0, min(last, middle - 1), middle - 1, size + half + 1)):
                if a <= b:
                    key = xxhash.xxh3_64_intdigest((b">" if at == base else b"<") + piece[at : at + longer], name & (1 << 64) - 1)
                    rows.append(_stretch(key - (1 << 63), row, single, start + a, at - a, longer, piece[a : b + WINDOW]))
        yield rows


class Shard:
    """Stretches sorted by what follows their bases, to `window` bytes, with the common prefixes of neighbours."""

    def __init__(self, pieces: list[bytes], base: np.ndarray, window: int):
        data = np.frombuffer(b"".join(pieces), np.uint8)
        lengths = np.array([len(p) for p in pieces])
        starts = np.cumsum(lengths) - lengths
        self.follow = _gather(data, starts + base, np.minimum(lengths - base, window), window)
        self.order = sort_suffixes(self.follow)
        ordered = self.follow[self.order]
        differ = ordered[1:] != ordered[:-1]
        self.lcp = np.zeros(len(pieces), np.int64)  # of each entry with the one before it in the order
        self.lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), ordered.shape[1])


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Rows of `width` symbols (or STEP's next multiple) from `starts`: bytes count from 1, beyond a row's length stands 0."""
    wide = np.arange(-(-width // STEP) * STEP)
    at = np.minimum(starts[:, None] + wide, max(0, len(data) - 1))
    return np.where(wide < lengths[:, None], data[at].astype(np.uint16) + np.uint16(1), np.uint16(0))


def _symbol(rows: np.ndarray) -> np.ndarray:
    """STEP symbols of each row as one number."""
    out = rows[:, 0].astype(np.int64)
    for j in range(1, STEP):
        out = out << 9 | rows[:, j]
    return out


def sort_suffixes(follow: np.ndarray) -> np.ndarray:
    """The order of the rows, by STEP symbols at a time; only tied rows are looked at again."""
    order = live = np.arange(len(follow))
    order = order.copy()
    block = np.zeros(len(follow), np.int64)
    for at in range(0, follow.shape[1], STEP):
        symbol = _symbol(follow[order[live], at : at + STEP])
        by = np.lexsort((symbol, block[live]))
        order[live], symbol, of = order[live][by], symbol[by], block[live]
        fresh = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (of[1:] != of[:-1])))
        block[live] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))]
        live = live[~(fresh & np.append(fresh[1:], True))]
        if not len(live):
            break
    return order


def merge_shards(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray]:
    """(entries of all shards in one order, common prefix of each with the one before it).

    The interleaving starts with the shards' orders one after another, in one block. A round splits the
    blocks that hold several shards by the next STEP symbols. Entries of a shard keep their order, and its
    common prefixes say where its symbols change, so one entry of a run is looked up for all of it.
    """
    first = np.cumsum([0, *(len(s.order) for s in shards)])
    total = int(first[-1])
    shard = np.repeat(np.arange(len(shards)), np.diff(first))
    rows = first[shard] + np.concatenate([s.order for s in shards])
    own = np.concatenate([s.lcp for s in shards])
    follow = np.concatenate([s.follow for s in shards])
    entry = np.arange(total)  # places in the shards' orders, as interleaved so far
    lcp = np.zeros(total, np.int64)
    live, fresh = entry.copy(), entry == 0
    for at in range(0, follow.shape[1], STEP):
        here, number = entry[live], np.cumsum(fresh) - 1
        told = np.zeros(len(live), bool)
        told[1:] = (here[1:] == here[:-1] + 1) & (shard[here[1:]] == shard[here[:-1]]) & ~fresh[1:] & (own[here[1:]] >= at + STEP)
        heads = np.flatnonzero(~told)
        symbol = _symbol(follow[rows[here[heads]], at : at + STEP])
        by = np.lexsort((symbol, number[heads]))  # stable: equal symbols keep the order of shards and within shards
        sizes = np.diff(np.append(heads, len(live)))[by]
        entry[live] = here[np.repeat(heads[by] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(live))]
        symbol, number = symbol[by], number[heads[by]]
        new = np.concatenate(([True], number[1:] != number[:-1]))
        cut = ~new & np.concatenate(([False], symbol[1:] != symbol[:-1]))
        starts = np.cumsum(sizes) - sizes
        fresh = np.zeros(len(live), bool)
        fresh[starts[new | cut]] = True
        cut = starts[cut]
        a, b = (follow[rows[entry[live[c]]], at : at + STEP] for c in (cut - 1, cut))
        lcp[live[cut]] = at + (a != b).argmax(axis=1)
        # Blocks of one shard are done: they stand in its order, with its common prefixes.
        of, begin, number = shard[entry[live]], np.flatnonzero(fresh), np.cumsum(fresh) - 1
        mixed = (np.maximum.reduceat(of, begin) != np.minimum.reduceat(of, begin))[number]
        done = live[~mixed & ~fresh]
        lcp[done] = own[entry[done]]
        live, fresh = live[mixed], fresh[mixed]
        if not len(live):
            break
    lcp[live[~fresh]] = follow.shape[1]
    return rows[entry], lcp


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key among the distinct keys, how many share it)."""
    _, number, count = np.unique(keys, return_inverse=True, return_counts=True)
    return number, count[number]


def repeated_windows(pieces: list[bytes], base: np.ndarray, names: np.ndarray, window: int = WINDOW, shard: int = SHARD) -> np.ndarray:
    """(stretch, start) rows, sorted, of the windows that occur in another stretch of the same name too.

    Every window of a stretch begins at or before its base.
    """
    lengths = np.array([len(p) for p in pieces])
    number = (np.cumsum(lengths) - lengths) // shard
    edges = [*np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))).tolist(), len(pieces)]
    order, lcp = merge_shards([Shard(pieces[a:b], base[a:b], window) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    at = (np.cumsum(lengths) - lengths + base)[order]  # the walk: where each entry's suffix begins
    far = base[order]
    near = far - (lengths[order] - window)
    block, _ = _numbered(names[order])
    live = np.arange(len(order))
    found = [np.empty((0, 2), np.int64)]
    for k in range(int(far.max()) + 1):
        live = live[far[live] >= k]
        if k:  # to the suffix one byte longer; entries alone in their block repeat no further
            number, count = _numbered(block[live] << 8 | data[at[live] - k])
            block[live] = number
            live = live[count > 1]
        here = live[near[live] <= k]
        run = np.cumsum(lcp < window - k)[here]  # entries of a run share window - k bytes from the base on
        _, count = _numbered(block[here] * np.int64(len(order) + 1) + run)
        hit = order[here[count > 1]]
        found.append(np.column_stack((hit, base[hit] - k)))
    found = np.concatenate(found)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """First and last windows of the runs of repeated windows of each stretch of a group."""
    found = repeated_windows(list(group["piece"]), group["base"].to_numpy(np.int64), group["name"].to_numpy())
    fresh = np.concatenate(([True], (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1] + 1)))[: len(found)]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(found)) - 1 if len(first) else first
    owners, starts = np.unique(found[first, 0], return_index=True)
    cut = lambda x: pd.Series(np.split(x, starts[1:]) if len(starts) else [], dtype=object)
    return pd.DataFrame(
        {"name": group["name"].to_numpy()[owners], "sid": group["sid"].to_numpy()[owners], "lows": cut(found[first, 1]), "highs": cut(found[last, 1])}
    )


def _runs(at: np.ndarray, size: int) -> np.ndarray:
    """Maximal runs [start, end) of bytes covered by windows that start at the sorted places `at`."""
    breaks = np.flatnonzero(np.diff(at) > size)
    return np.column_stack((at[np.concatenate(([0], breaks + 1))], at[np.append(breaks, len(at) - 1)] + size))


def _digest(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    for batch in batches:
        rows = []
        for key, text, lows, highs in batch:
            data = text.encode("utf-8", "surrogatepass")
            mask = np.zeros(len(data) + 1, bool)
            for a, b in zip(lows, highs, strict=True):
                mask[a : b + 1] = True
            runs = _runs(np.flatnonzero(mask), WINDOW).tolist()
            kept, last = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(data[last:a])
                last = b
            kept.update(data[last:])
            rows.append((key, sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
        yield rows


def _few(side: DataFrame, rows: int) -> DataFrame:
    """A join side of so many small rows: broadcast up to BROADCAST_ROWS, joined by a shuffle beyond."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def _apart(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frequent keys, broadcast: each stands for over HOT_ROWS rows, so they are few; the other keys)."""
    return F.broadcast(counted.where(F.col("n") > HOT_ROWS)), counted.where(F.col("n") <= HOT_ROWS)


def _candidates(facts: DataFrame, copies: DataFrame) -> DataFrame:
    """(row, key, single, names) of each distinct text with the pieces that recur in the corpus."""
    firsts = copies.select("row", (F.col("n") == 1).alias("single"))
    each = facts.where(F.size("names") > 0).join(_few(firsts.select("row"), firsts.count()), "row", "left_semi").select("row", F.explode("names").alias("name"))
    counted = materialize(each.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeat-names", "zstd")
    hot, others = _apart(counted)
    hit = each.join(others.select("name"), "name", "left_semi").unionByName(each.join(hot.select("name"), "name", "left_semi").select("name", "row"))
    held = hit.groupBy("row").agg(F.collect_set("name").alias("names"))
    return materialize(held.join(firsts, "row").join(facts.select("row", "key"), "row"), "repeat-candidates", "zstd")


def _spans(pieces: DataFrame, known: DataFrame, merged: DataFrame) -> DataFrame:
    """(row, lows, highs) of the runs of windows that recur; stretches that occur twice recur as a whole."""
    places = pieces.where("single").select("name", "sid", "row", "start", F.octet_length("piece").alias("size"))
    hot, others = _apart(known.where("n > 1").select("name", "sid", "n"))
    whole = lambda rows: rows.select("row", F.array("start").alias("lows"), F.array(F.col("start") + F.col("size") - WINDOW).alias("highs"))
    rest = places.join(hot, ["name", "sid"], "left_anti").join(others, ["name", "sid"], "left")
    some = rest.where("n is null").join(merged, ["name", "sid"])
    moved = [F.transform(c, lambda x: x + F.col("start")).alias(c) for c in ("lows", "highs")]
    return whole(places.join(hot, ["name", "sid"])).unionByName(whole(rest.where("n > 1"))).unionByName(some.select("row", *moved))


def _recurring(pieces: DataFrame) -> DataFrame:
    """(row, lows, highs) over all stretches: cold pieces are merged in bounded groups, hot ones are split until none is left."""
    out = None
    while True:
        sized = F.octet_length("piece").cast("long")
        known = materialize(pieces.groupBy("name", "sid").agg(F.count(F.lit(1)).alias("n"), F.max(sized).alias("bytes")), "repeat-stretches", "zstd")
        # A piece whose stretches are all equal is settled by their number; only differing ones are merged.
        mixed = known.groupBy("name").agg(F.count(F.lit(1)).alias("sids"), F.sum("bytes").alias("bytes")).where("sids > 1")
        mixed = materialize(mixed.select("name", "bytes"), "repeat-mixed", "zstd")
        is_hot = F.col("bytes") > HOT_BYTES
        n_hot, n_cold, total = mixed.agg(F.count(F.when(is_hot, 1)), F.count(F.when(~is_hot, 1)), F.sum(F.when(~is_hot, F.col("bytes")))).first()
        hot, cold = mixed.where(is_hot).select("name"), mixed.where(~is_hot).select("name")
        shown = pieces.select("name", "sid", "base", "piece")
        shown = shown.join(F.broadcast(cold), "name", "left_semi") if n_cold <= BROADCAST_ROWS else shown
        distinct = shown.groupBy("name", "sid").agg(F.first("base").alias("base"), F.first("piece").alias("piece"))
        distinct = distinct if n_cold <= BROADCAST_ROWS else distinct.join(cold, "name", "left_semi")
        group = F.pmod(F.xxhash64("name"), F.lit(max(1, math.ceil((total or 0) / GROUP_BYTES)))).alias("group")
        merged = distinct.select(group, "name", "sid", "base", "piece").groupBy("group").applyInPandas(_merge, "name long, sid binary, lows array<long>, highs array<long>")
        merged = materialize(merged, "repeat-merged", "zstd")
        settled = pieces.join(_few(hot, n_hot), "name", "left_anti") if n_hot else pieces
        spans = _spans(settled, known.join(_few(hot, n_hot), "name", "left_anti") if n_hot else known, merged)
        out = spans if out is None else out.unionByName(spans)
        if not n_hot:
            return out
        crowd = pieces.join(_few(hot, n_hot), "name", "left_semi").select("name", "row", "single", "start", "base", "size", "piece")
        pieces = materialize(map_rows(crowd, _PIECE, _split), "repeat-pieces", "zstd")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    spark = docs.sparkSession
    ship(spark)
    arrow_rows(spark, 256)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    facts = rows.mapInArrow(_names, "doc_id long, n_bytes long, key binary, names array<long>").withColumn("row", F.monotonically_increasing_id())
    facts = materialize(facts, "repeat-facts", "zstd")
    copies = materialize(facts.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row")), "repeat-copies", "zstd")

    wanted = _candidates(facts, copies)
    texts = rows.where(F.octet_length("text") >= WINDOW).select(F.unhex(F.sha2("text", 256)).alias("key"), "text")
    some = texts.join(_few(wanted.select("key"), wanted.count()), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")
    pieces = materialize(map_rows(some.select("row", "single", "text", "names"), _PIECE, _cut), "repeat-pieces", "zstd")

    spans = _recurring(pieces).groupBy("row").agg(F.flatten(F.collect_list("lows")).alias("lows"), F.flatten(F.collect_list("highs")).alias("highs"))
    spans = materialize(spans.join(wanted.select("row", "key"), "row").drop("row"), "repeat-spans", "zstd")
    chosen = texts.join(_few(spans.select("key"), spans.count()), "key", "left_semi").join(spans, "key")
    done = map_rows(chosen.select("key", "text", "lows", "highs"), "key binary, removed long, spans long, kept string", _digest)

    hot, others = _apart(copies.select("key", "n"))
    entries = facts.select("doc_id", "n_bytes", "key")
    crowd = entries.join(hot, "key").select("*", F.lit(0).cast("long").alias("removed"), F.lit(0).cast("long").alias("spans"), F.lit("").alias("kept"))
    out = entries.join(hot, "key", "left_anti").join(others, "key").join(done, "key", "left").unionByName(crowd)
    whole = (F.col("n") > 1) & (F.col("n_bytes") >= WINDOW)
    return out.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).when(F.col("n") > 1, F.lower(F.hex("key"))).otherwise(F.coalesce("kept", F.lower(F.hex("key")))).alias("kept_sha256"),
    )
