import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import quality
from tidewright.llm.common import table


def test_logistic_finds_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [2, -1, 0] + 0.5)))).astype(float)
    w = quality.fit_logistic(x, y)
    full = np.hstack([x, np.ones((400, 1))])
    gradient = full.T @ (1 / (1 + np.exp(-full @ w)) - y) + np.array([1, 1, 1, 0]) * w
    assert np.abs(gradient).max() < 1e-3 and w[0] > 1 and w[1] < -0.5


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(2)
    words = ["ba", "bo", "bi", "be", "bu", "ka", "ko"]
    rows, labels = [], []
    for i in range(240):
        toxic, bad = i % 5 == 0, i % 7 == 0
        text = " ".join(rng.choice(words) for _ in range(40)) + (" vile worm" if toxic else "")
        rows.append((i, " | ".join(text.split()) if bad else text, "de" if i % 2 else None, "big" if i % 3 else None, 1.0))
        labels.append((i, 0 if bad else 1, int(toxic), "x"))
    rows += [(None, "ba bo", "de", "big", 1.0), (900, None, "de", "rare", 1.0), (901, "", None, None, 1.0), (902, "vile worm " * 2000, "de", "rare", 1.0)]
    labels += [(None, 1, 0, "x"), (5000, None, 1, "x"), (3, 1, 0, "x")]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, keep double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"),
    )


def test_classify(small):
    docs, labels = small
    out = {r.doc_id: r for r in quality.classify(docs, quality.fit(docs, labels)).collect()}
    assert len(out) == docs.count()
    assert all(out[i].keep == (i % 5 != 0 and i % 7 != 0) for i in range(240))
    assert not out[902].keep and out[900] is not None
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {None, *(i for i in range(240) if i % 5 and i % 7)}


def test_shrinkage_orders_sites(spark):
    """A sparse site stays nearer the global mean than a large one of the same evidence."""
    rows = [("a", None, 3.0)] * 200 + [("b", None, -3.0)] * 200 + [("c", None, -3.0)] * 2
    scored = spark.createDataFrame([(i, h, p, e, e) for i, (h, p, e) in enumerate(rows)],
                                   "doc_id long, host string, path string, quality_evidence double, toxic_evidence double")
    docs = spark.createDataFrame([(i, "x", h, p) for i, (h, p, _) in enumerate(rows)], "doc_id long, text string, source string, lang string")
    model = quality.Model([], [])
    original = quality.score
    quality.score = lambda *_: scored
    try:
        by = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    finally:
        quality.score = original
    assert by[0].host_quality > by[401].host_quality > by[200].host_quality


def _given(spark, monkeypatch, rows):
    """classify over given (host, path, evidence of quality, of toxicity)."""
    scored = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, quality_evidence double, toxic_evidence double")
    docs = spark.createDataFrame([(i, "x", r[0], r[1]) for i, r in enumerate(rows)], "doc_id long, text string, source string, lang string")
    monkeypatch.setattr(quality, "score", lambda *_: scored)
    return {r.doc_id: r for r in quality.classify(docs, quality.Model([], [])).collect()}


def _by_hand(rows, target):
    """Scores document by document, with the strengths from plain sums over every document."""
    p = [1 / (1 + math.exp(-r[2 + target])) for r in rows]
    mean = sum(p) / len(p)
    hosts, paths = {}, {}
    for i, r in enumerate(rows):
        hosts.setdefault(r[0], []).append(i)
        paths.setdefault(r[:2], []).append(i)
    avg = lambda ids: sum(p[i] for i in ids) / len(ids)
    inside = sum((p[i] - avg(ids)) ** 2 for ids in paths.values() for i in ids) / (len(p) - len(paths))
    among = sum(len(ids) * (avg(ids) - avg(hosts[h])) ** 2 for (h, _), ids in paths.items())
    shared = sum(len(ids) ** 2 / len(hosts[h]) for (h, _), ids in paths.items())
    path = (among - (len(paths) - len(hosts)) * inside) / (len(p) - shared)
    between = sum(len(ids) * (avg(ids) - mean) ** 2 for ids in hosts.values())
    extra = max(0, path) * (shared - sum(len(ids) ** 2 for ids in paths.values()) / len(p))
    host = (between - (len(hosts) - 1) * inside - extra) / (len(p) - sum(len(ids) ** 2 for ids in hosts.values()) / len(p))
    a, b = (min(1e6, inside / x) if x > 0 else 1e6 for x in (host, path))
    logit = lambda x: math.log(min(max(x, 1e-6), 1 - 1e-6) / (1 - min(max(x, 1e-6), 1 - 1e-6)))
    out = []
    for i, r in enumerate(rows):
        other = lambda ids: [p[j] for j in ids if j != i]  # noqa: B023, E731
        h, q = other(hosts[r[0]]), other(paths[r[:2]])
        of_host = (sum(h) + a * mean) / (len(h) + a)
        of_path = (sum(q) + b * of_host) / (len(q) + b)
        out.append(1 / (1 + math.exp(-(r[2 + target] + logit(of_path) - logit(mean)))))
    return out


@pytest.mark.parametrize("broadcast", [quality.BROADCAST_SITES, 0])
def test_posteriors_by_hand(spark, monkeypatch, broadcast):
    """Every score equals one computed document by document; null sites, sites of one and a hot site among them; by broadcast and by shuffle."""
    rng = random.Random(8)
    monkeypatch.setattr(quality, "BROADCAST_SITES", broadcast)
    monkeypatch.setattr(quality, "HOT", 4)
    mood = {h: rng.gauss(0, 1.5) for h in (None, "a", "b", "c", "d", "hot")}
    turn = {(h, q): rng.gauss(0, 1) for h in mood for q in (None, "x", "y")}
    sites = [("hot", "x")] * 200 + [rng.choice(list(turn)) for _ in range(150)] + [("lone", "z")]
    rows = [(*s, mood.get(s[0], 0) + turn.get(s, 0) + rng.gauss(0, 1), rng.gauss(-2, 1)) for s in sites]
    out = _given(spark, monkeypatch, rows)
    assert len(out) == len(rows)
    for target, name in enumerate(("quality_score", "toxic_score")):
        for i, want in enumerate(_by_hand(rows, target)):
            assert abs(out[i][name] - want) < 1e-6


def test_own_evidence_counts_once(spark, monkeypatch):
    """A document alone on its host is moved by nothing; equal documents get equal scores."""
    rows = [("a", "x", 1.0, 0.0)] * 5 + [("b", "x", -1.0, 0.0)] * 5 + [("one", "x", 4.0, 0.0)]
    out = _given(spark, monkeypatch, rows)
    assert abs(out[10].quality_score - 1 / (1 + math.exp(-4))) < 1e-9
    assert len({round(out[i].quality_score, 12) for i in range(5)}) == 1


def test_degenerate(small):
    docs, labels = small
    model = quality.fit(docs, labels.limit(0))
    assert {round(r.quality_score, 6) for r in quality.classify(docs, model).collect()} == {0.5}
    assert quality.classify(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    even = labels.where("doc_id % 2 = 0")
    out = quality.classify(docs, quality.fit(docs, even)).join(labels.where("doc_id % 2 = 1"), "doc_id")
    n, good, toxic, known = out.agg(
        F.count("*"), F.sum(((F.col("quality_score") >= 0.5) == (F.col("quality") == 1)).cast("int")),
        F.sum(((F.col("toxic_score") >= 0.5) == (F.col("toxic") == 1)).cast("int")),
        F.avg(F.when(F.col("toxic") == 1, (F.col("toxic_score") >= 0.5).cast("int"))),
    ).first()
    assert n > 100 and good / n > 0.93 and toxic / n > 0.93 and known > 0.6
