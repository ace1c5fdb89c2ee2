import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import langid
from tidewright.llm.common import table


def plain_em(logs, n, rounds):
    share = np.full(logs.shape[1], 1 / logs.shape[1])
    for _ in range(rounds):
        parts = share * np.exp(logs - logs.max(axis=1, keepdims=True))
        share = (n[:, None] * parts / parts.sum(axis=1, keepdims=True)).sum(axis=0) / n.sum()
    return share


def toy():
    counts = {}
    for k, text in enumerate(["the thin thing then this", "der die das dick dann", "que quien queso quiza"]):
        for w in text.split():
            for g in langid._grams(w):
                counts.setdefault(g, [0, 0, 0])[k] += 1
    return langid.Model(["aa", "bb", "cc"], counts)


def test_mixture():
    model = toy()
    pure = model.predict(["the thing then", "das dick", None, "", "123 ... !", "the the the the the the " * 30 + "der die das " * 20, "X"])
    assert pure[0] == ("aa", 1.0) and pure[1] == ("bb", 1.0) and pure[2:5] == [("und", 0.0)] * 3
    assert pure[5][0] == "aa" and 0.7 < pure[5][1] < 0.8 and pure[6][0] in model.languages
    logs = model.table(["the", "der"])
    share = plain_em(logs, np.array([180.0, 60.0]), 2000)
    one = model.predict(["the " * 180 + "der " * 60])[0]
    assert abs(one[1] - share[:2].max() / share[:2].sum()) < 0.02


def test_words_are_letters_and_their_marks():
    assert langid.words("½ x² Ⅷ 12 _a_ ٣ ²") == ["x", "a"] and langid.words("½ ² Ⅷ ١٢ ①") == []
    assert langid.words("हिन्दी भाषा Été e\u0301t") == ["हिन्दी", "भाषा", "été", "e\u0301t"]
    assert langid.words("a" * 5000) == ["a" * 5000]
    assert toy().predict(["½ ² Ⅷ", "the" * 3000]) [0] == ("und", 0.0)


def test_chosen_set_equals_trying_all_nested_sets():
    """The proportions have converged, and the set is the best of the nested ones by penalised likelihood."""
    model = toy()
    rng = np.random.default_rng(2)
    vocabulary = "the thin thing der die dick que queso quiza then dann".split()
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 5, 9, 30, 80, 200)] + ["the der"] * 2
    for text, got in zip(texts, model.predict(texts), strict=True):
        names, n = np.unique(text.split(), return_counts=True)
        logs, n = model.table(names.tolist()), n.astype(float)
        order = np.argsort(-plain_em(logs, n, 5000), kind="stable")
        tried = []
        for size in (1, 2, 3):
            some = np.sort(order[:size])
            share = plain_em(logs[:, some], n, 5000)
            value = (n * np.log((share * np.exp(logs[:, some])).sum(axis=1))).sum() - langid.PENALTY * np.log(n.sum() + 1) * (size - 1)
            tried.append((value, -size, share.max(), model.languages[some[share.argmax()]]))
        best = max(tried, key=lambda t: t[:2])
        assert got[0] == best[3] and abs(got[1] - best[2]) < 0.01


def test_batches_and_kept_words_change_nothing(monkeypatch):
    texts = ["the thin der", "queso " * 40 + "dann", "zzz " * 5, "x" * 90, None] * 3
    want = [toy().predict([t])[0] for t in texts]
    monkeypatch.setattr(langid, "KEPT_WORDS", 2)
    got = toy().predict(texts)
    assert [w[0] for w in want] == [g[0] for g in got] and np.allclose([w[1] for w in want], [g[1] for g in got])


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = langid.identify(docs)
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_cases(spark):
    docs = spark.createDataFrame([(1, "the thing", "en", 0.1), (None, "das ding", "de", 0.1), (3, None, "de", 0.1), (4, "das ding", None, 0.1), (4, "das ding", "de", 0.1)],
                                 "doc_id long, text string, lang string, score double")
    out = langid.identify(docs)
    assert out.count() == 5 and out.where("lang_pred = 'und'").count() == 1
    assert langid.identify(docs.where(F.lit(False))).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
