import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewright.llm import tokens, wavelet
from tidewright.llm.common import table


def reopened(ids):
    m = wavelet.WaveletMatrix.build(np.array(ids, np.uint16))
    return wavelet.WaveletMatrix.from_bytes(m.to_bytes(), m.zeros, m.n)


def hold(ids, token):
    m = reopened(ids)
    assert m.decode().tolist() == ids and m.access(np.arange(len(ids))).tolist() == ids
    where = [i for i, x in enumerate(ids) if x == token]
    assert m.count(token).tolist() == [len(where)]
    starts, ends = np.arange(len(ids)), np.full(len(ids), len(ids))
    assert m.count(token, starts, ends).tolist() == [sum(i >= s for i in where) for s in range(len(ids))]
    assert m.select(token, np.arange(len(where) + 1)).tolist() == [*where, -1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 70), min_size=1, max_size=60), st.integers(0, 70))
def test_queries_equal_a_plain_array(ids, token):
    hold(ids, token)


def test_queries_over_many_directory_entries():
    ids = (np.random.default_rng(3).zipf(1.5, 1700) % 90).tolist()
    for token in (0, 1, 2, 89, 90, 1000):
        hold(ids, token)
    hold([5] * 512, 5)
    hold([0] * 1024, 0)


def brute(rows):
    encode = Tokenizer.from_file(public_tokenizers.path(tokens.BYTE))
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(encode.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes()), int((ids == 2).sum())))
        start += len(ids)
    return out


def got(frame):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.n_end_ids) for r in frame.collect()), key=lambda r: r[1])


ROWS = [(7, "seven  x\n\ny # #"), (-3, "minus"), (1, None), (2, ""), (40, "日本 é " * 50), (None, "no id"), (9, "a b c " * 400), (9, "a b c " * 400), (50, "a <|endoftext|> b<|startoftext|>"), (51, "<|endoftext|>"), (52, "w " * 150_000)]


def test_round_trip(spark):
    docs = spark.createDataFrame([(*r, "z") for r in ROWS], "doc_id long, text string, start string")
    assert got(wavelet.read_documents(wavelet.write_shards(docs, 3, shard_tokens=60))) == brute(ROWS)
    assert wavelet.read_documents(wavelet.write_shards(docs.limit(0), 3)).count() == 0


def test_lookups_over_shard_files(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    shards = wavelet.write_shards(docs, 3, shard_tokens=60)
    encode = tokens.encoder(tokens.BYTE).whole
    ids = [(i, [*encode(t or "").tolist(), 2]) for i, t in ROWS]
    flat = [t for _, x in ids for t in x]
    asked = [2, flat[0], 50_256, 70_000]
    assert {r.token: r.n for r in wavelet.token_counts(shards, asked).collect()} == {t: flat.count(t) for t in asked}
    places = wavelet.occurrences(shards, 2).collect()
    assert sorted(map(str, [(r.doc_id, r.at) for r in places])) == sorted(str((i, n)) for i, x in ids for n, t in enumerate(x) if t == 2)
    wanted = spark.createDataFrame([(7, 0), (7, 3), (40, 99), (-3, 0), (-3, 500), (123, 0), (2, 0)], "doc_id long, at long")
    known = dict(ids)
    want = {(d, a, known[d][a]) for d, a in [(7, 0), (7, 3), (40, 99), (-3, 0), (2, 0)]}
    assert {(r.doc_id, r.at, r.token) for r in wavelet.tokens_at(shards, wanted).collect()} == want


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert got(wavelet.read_documents(wavelet.write_shards(docs))) == brute([(r.doc_id, r.text) for r in docs.collect()])
