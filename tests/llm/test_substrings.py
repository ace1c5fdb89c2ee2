import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import substrings as s
from tidewright.llm.common import table


def stretches_of(draw_pieces, window):
    """Named stretches all of whose windows hold the byte at the base."""
    rows = []
    for piece, base, name in draw_pieces:
        base %= len(piece)
        piece, base = piece[max(0, base - window + 1) :], min(base, window - 1)
        last = min(base, len(piece) - window) if len(piece) >= window else -1
        if last >= 0:
            rows.append((piece[: last + window], base, name))
    return rows


PIECES = st.lists(st.tuples(st.binary(min_size=1, max_size=30).map(lambda b: bytes(x % 2 + 97 for x in b)), st.integers(0, 30), st.integers(0, 1)), min_size=1, max_size=12)


def by_counting(rows, window):
    count = Counter((name, base - i, p[i : i + window]) for p, base, name in rows for i in range(len(p) - window + 1))
    return [[n, i] for n, (p, base, name) in enumerate(rows) for i in range(len(p) - window + 1) if count[name, base - i, p[i : i + window]] > 1]


def by_merging(rows, window, shard=25):
    pieces, base, names = zip(*rows, strict=True)
    return s.repeated_windows(list(pieces), np.array(base), np.array(names), window, shard=shard).tolist()


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(1, 9))
def test_merge_equals_counting(pieces, window):
    rows = stretches_of(pieces, window)
    if rows:
        assert by_merging(rows, window) == by_counting(rows, window)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=30).map(lambda b: bytes(x % 2 + 97 for x in b)), min_size=1, max_size=20))
def test_merged_order_and_prefixes(pieces):
    shards = [s.Shard(pieces[i : i + 4], np.zeros(len(pieces[i : i + 4]), np.int64), 28) for i in range(0, len(pieces), 4)]
    order, lcp = s.merge_shards(shards)
    rows = [pieces[i][:28] for i in order]
    assert sorted(order.tolist()) == list(range(len(pieces))) and rows == sorted(rows)
    for a, b, n in zip(rows[:-1], rows[1:], lcp[1:].tolist(), strict=True):
        same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert n == (28 if a == b else same)


def test_the_shards_order_carries_the_result(monkeypatch):
    """A shard in a wrong order is merged to a wrong result: what recurs comes out of the sorted shards."""
    rng = random.Random(8)
    pick = lambda n: bytes(rng.choices(b"ab", k=n))
    rows = [(pick(4) + b"piece" + (b"x" if i < 30 else b"y") * 14 + pick(3), 4, 0) for i in range(60)]
    assert by_merging(rows, 22, 30 * 26) == by_counting(rows, 22)
    right = s.sort_suffixes
    monkeypatch.setattr(s, "sort_suffixes", lambda follow: np.random.default_rng(1).permutation(right(follow)))
    assert by_merging(rows, 22, 30 * 26) != by_counting(rows, 22)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(97, 99), min_size=200, max_size=700))
def test_anchors_are_the_leftmost_least(values):
    data = np.array(values, np.uint8)
    h = s.gram_hashes(data, s.GRAM)
    assert len(set(h.tolist())) == len({bytes(data[i : i + s.GRAM]) for i in range(len(h))})
    anchor, low, high = s.anchors(data)
    span = s.WINDOW - s.GRAM + 1
    want = [i + int(np.argmin(h[i : i + span])) for i in range(len(data) - s.WINDOW + 1)]
    got = np.concatenate([np.full(b - a + 1, x) for x, a, b in zip(anchor, low, high, strict=True)]).tolist()
    assert got == want
    _, bases, lows, highs = s.stretches(data)
    assert sorted(i for a, b in zip(lows, highs, strict=True) for i in range(a, b + 1)) == list(range(len(want)))
    assert all(a <= b <= at and b - a <= s.HALF and at + s.PIECE <= a + s.WINDOW for at, a, b in zip(bases, lows, highs, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 520), max_size=7), st.integers(0, 99))
def test_texts_of_a_batch_together(sizes, seed):
    rng = np.random.default_rng(seed)
    texts = [rng.integers(97, 100, n).astype(np.uint8) for n in sizes]
    ends = np.cumsum([0, *sizes])
    together = s._batch_stretches(np.concatenate([np.empty(0, np.uint8), *texts]), ends)
    alone = [(int(k), int(b + e), int(lo + e), int(hi + e), i) for i, (t, e) in enumerate(zip(texts, ends[:-1], strict=True)) for k, b, lo, hi in zip(*s.stretches(t), strict=True)]
    assert sorted(zip(*(x.tolist() for x in together), strict=True)) == sorted(alone)


def test_long_texts_go_block_by_block(monkeypatch):
    data = np.frombuffer(bytes(random.Random(4).choices(b"abcd ", k=5000)), np.uint8)
    want = {w for _, _, a, b in zip(*s.stretches(data), strict=True) for w in range(a, b + 1)}
    whole = {(lo, k) for k, _, lo, _ in zip(*s.stretches(data), strict=True)}
    monkeypatch.setattr(s, "BLOCK", 700)
    keys, bases, lows, highs = s.stretches(data)
    assert {w for a, b in zip(lows, highs, strict=True) for w in range(a, b + 1)} == want and len(keys) == len(lows) == len(bases)
    assert len(whole - {(lo, k) for lo, k in zip(lows, keys, strict=True)}) <= 1


def brute(rows, window=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[i : i + window] for _, t in texts for i in range(len(t) - window + 1))
    out = []
    for doc, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()), key=str)


def test_remove_repeats(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    a, b, c = text(60), text(45), text(200)
    assert len(a.encode()) > 300
    rows = [(1, text(30) + a + text(20)), (2, a[:199]), (3, text(10) + a[20:240] + text(9)), (4, b), (4, b), (5, None), (6, ""), (7, "x" * 900), (8, c), (9, c.replace("a", "b", 3)),
            (None, text(50)), (10, b + text(3) + b), (11, a + a), (12, "ab" * 150), (13, text(40) + "x" * 260), (14, "y" * 200), (15, "y" * 199)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_bytes int")
    assert got(s.remove_repeats(docs)) == brute(rows)
    assert s.remove_repeats(docs.limit(0)).count() == 0


def test_frequent_pieces_make_no_large_group(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage, wider, bound = text(190), text(60), 8000
    rows = [(i, text(300) + (wider if i % 10 == 0 else text(60)) + passage + text(300)) for i in range(80)] + [(90, "ab" * 150), (91, "ab" * 160 + text(50))]
    rows += [(100 + i, text(250) + passage + passage[:30] + text(250)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, merge = brute(rows), s._merge

    def bounded(group):
        assert group["piece"].map(len).sum() <= bound, "large group"
        return merge(group)

    monkeypatch.setattr(s, "_merge", bounded)
    for hot, frequent in ((2000, 20_000), (0, 1)):
        monkeypatch.setattr(s, "HOT_BYTES", hot)
        monkeypatch.setattr(s, "HOT_ROWS", frequent)
        monkeypatch.setattr(s, "GROUP_BYTES", 2000)
        assert got(s.remove_repeats(docs)) == want
    monkeypatch.setattr(s, "BROADCAST_ROWS", 0)
    assert got(s.remove_repeats(docs)) == want


def test_on_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert got(s.remove_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
