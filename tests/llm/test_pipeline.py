"""The pipeline against a brute-force run of the same decisions, stage by stage on each stage's own input."""

import re

import pytest

import corpus_pipeline
from tests.llm import test_packing, test_simhash
from tests.llm.test_secrets import ASSIGN
from tidewright.llm import decontaminate, quality
from tidewright.llm.common import materialize, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, seen = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), f"test-{name}")
        seen.append((name, docs, out))
        docs = out
    return {name: (before, after) for name, before, after in seen}


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_columns(stages):
    columns = next(iter(stages.values()))[0].columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "best_fit_packing")
    assert len(stages) == len(corpus_pipeline.STAGES) == 5


def test_quality(spark, stages):
    before, after = stages["quality_classifier"]
    model = quality.fit(before, table(spark, SF, "labels"))
    own = {r.doc_id: model.log_odds(r.text) for r in before.collect()}
    kept = set(ids(after))
    # Site posteriors shift the evidence a little; clear cases must follow it.
    assert all(i in kept for i, (good, toxic) in own.items() if good > 1 and toxic < -1)
    assert all(i not in kept for i, (good, toxic) in own.items() if good < -1 or toxic > 1)


def test_near_dedup(stages):
    before, after = stages["simhash_near_dedup"]
    want = [i for i, _, c in test_simhash.brute([(r.doc_id, r.text) for r in before.collect()]) if i == c]
    assert ids(after) == sorted(want)


def test_decontamination(spark, stages):
    before, after = stages["benchmark_decontamination"]
    items = [decontaminate.normalize(r.text) for r in table(spark, SF, "benchmark").collect()]
    holds = {r.doc_id for r in before.collect() if any(i in decontaminate.normalize(r.text) for i in items)}
    gone = set(ids(before)) - set(ids(after))
    assert holds <= gone
    matcher = decontaminate.Matcher(list(enumerate(items)))
    assert gone == {r.doc_id for r in before.collect() if matcher.search(r.text)}


def redacted(text):
    text = ASSIGN.sub(lambda m: "[SECRET]" if len(m[2]) >= 12 else m[0], text)
    text = re.sub(r"AKIA[A-Z0-9]{14,}", "[SECRET]", text)
    return re.sub(r"[0-9a-f]{16,}", "[SECRET]", text)


def test_secrets(stages):
    before, after = stages["secret_scan"]
    want = {r.doc_id: redacted(r.text) for r in before.collect()}
    got = {r.doc_id: r for r in after.collect()}
    assert {i: r.text for i, r in got.items()} == want and all(r.n_chars == len(r.text) for r in got.values())


def test_packing_and_run(spark, stages):
    before, after = stages["best_fit_packing"]
    texts = [(r.doc_id, r.text) for r in before.collect()]
    bins, total = test_packing.check(after.collect(), texts, 4096)
    assert bins <= -(-total // 4096) + 1
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, whole.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(str, after.select("doc_id", "piece", "length", "ids_crc32").collect()))
