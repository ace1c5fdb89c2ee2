import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewright.llm import packing, tokens

TEXTS = ["", "a  b   c\n\n d \n", "don't I'LL 12,3 ½² x²", " lead", "trail ", "Éé İx ﬁ ́a", "a\x1cb", "<|endoftext|> hi", "日本 語", "\n", "a\n b \nc",
         "'s's 'd", "Ü\t q µ ª º _a_ a_b", "hello world, the end. " * 900]


@pytest.mark.parametrize("name", [tokens.WORD, tokens.BYTE])
def test_ids_equal_the_full_encoder(name):
    e = tokens.encoder(name)
    for text in TEXTS:
        assert e.encode(text).tolist() == e.whole(text).tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from(list("ab Z.'\ns5_é²\t|")), max_size=30))
def test_ids_equal_the_full_encoder_on_any_text(text):
    for name in (tokens.WORD, tokens.BYTE):
        e = tokens.encoder(name)
        assert e.encode(text).tolist() == e.whole(text).tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_is_sound_and_packing_valid(sizes):
    lengths = np.array(sizes, np.int64)

    def optimum(rest, rooms):
        if not rest:
            return len(rooms)
        tried = [optimum(rest[1:], rooms + [20 - rest[0]])]
        for i in {r: i for i, r in enumerate(rooms) if r >= rest[0]}.values():
            tried.append(optimum(rest[1:], [*rooms[:i], rooms[i] - rest[0], *rooms[i + 1 :]]))
        return min(tried)

    for way in (packing.best_fit_decreasing, packing.fill_by_pairs, lambda x, c: packing.two_ways(x, c, 0.4)):
        bins, offsets, fill = way(lengths, 20)
        assert packing.lower_bound(lengths, 20) <= optimum(sorted(sizes, reverse=True), []) <= len(fill)
        for b in range(len(fill)):
            inside = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
            assert [o for o, _ in inside] == list(np.cumsum([0] + [n for _, n in inside])[:-1]) and fill[b] <= 20


def check(rows, texts, capacity):
    encode = Tokenizer.from_file(public_tokenizers.path(tokens.WORD))
    want = []
    for i, t in texts:
        ids = np.array(encode.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, n, a, len(p := ids[a : a + capacity]), zlib.crc32(p.tobytes())) for n, a in enumerate(range(0, len(ids), capacity))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(w[3] for w in want)


def test_pack_documents(spark):
    texts = list(enumerate([*TEXTS, None])) + [(None, "x y"), (3, TEXTS[3]), (3, TEXTS[3])]
    docs = spark.createDataFrame([(*t, 9) for t in texts], "doc_id long, text string, length int")
    bins, total = check(packing.pack_documents(docs, 50).collect(), texts, 50)
    assert bins <= -(-total // 50) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_partitions_exchange(spark):
    rows = [(i, 0, 0, 1 + (i * 37) % 30, 0) for i in range(2000)]
    pieces = spark.createDataFrame(rows, packing._PIECES)
    got = packing.pack_sequences(pieces, 41, per_partition=100).collect()
    bins = defaultdict(int)
    for r in got:
        bins[r.sequence_id] += r.length
    total = sum(r[3] for r in rows)
    assert len(got) == 2000 and max(bins.values()) <= 41 and len(bins) <= -(-total // 41) * 1.05 + 1


def test_mid_sized_items_stay_in_bounded_groups(spark, monkeypatch):
    """Items of a quarter to a half of a bin: no group outgrows a partition, and gaps to the bound are few and told."""
    rng = np.random.default_rng(4)
    lengths = rng.integers(1000, 2000, 6000).tolist()
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing._PIECES)
    inner = packing._pack

    def bounded(capacity):
        pack = inner(capacity)

        def run(group):
            assert len(group) <= 1100, "large group"
            return pack(group)

        return run

    monkeypatch.setattr(packing, "_pack", bounded)
    rows = packing.pack_sequences(pieces, 4096, per_partition=1000).collect()
    bins = defaultdict(int)
    for r in rows:
        bins[r.sequence_id] += r.length
    bound = packing.lower_bound(np.array(lengths), 4096)
    assert len(rows) == 6000 and max(bins.values()) <= 4096 and len(bins) <= 1.06 * bound and all(r.gap >= 0 for r in rows)


def test_special_strings():
    """The library gives the string of a special token its one id, wherever it stands."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y", "<|ENDOFTEXT|>", "<|endoftext |>", "<|endof", "\x00<|endoftext|>"]
    for name in (tokens.WORD, tokens.BYTE):
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        for t in texts:
            assert tokens.encoder(name).encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids, (name, t)
