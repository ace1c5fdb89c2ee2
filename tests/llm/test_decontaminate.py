import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewright.llm import decontaminate as d


def sellers(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        last, row = row, [i + 1]
        for j, x in enumerate(text):
            row.append(min(last[j] + (c != x), last[j + 1] + 1, row[j] + 1))
    return min(row)


def brute(docs, items, rate):
    out = []
    for i, text in docs:
        for j, item in items:
            a, b = d.normalize(item), d.normalize(text)
            if a and b and (n := sellers(a, b)) <= d.budget(a, rate):
                out.append((i, j, n))
    return sorted(out, key=str)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=25))
def test_myers(item, text):
    assert d.myers(d.masks(item), len(item), text) == sellers(item, text)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=9), min_size=1, max_size=3), st.text("ab", max_size=40))
def test_search_is_lossless(items, text):
    matcher = d.Matcher(list(enumerate(items)), 0.3)
    got = sorted((0, n, x) for n, x in matcher.search(text).items())
    assert got == brute([(0, text)], list(enumerate(items)), 0.3)


def test_contaminated(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "délta", "eps"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, make(20)), (2, make(12)), (2, ""), (3, None), (4, "short"), (None, make(15))]
    edited = items[0][1].replace("beta", "bta", 2).upper()
    docs = [(10, make(30) + " " + items[1][1] + make(9)), (11, make(5) + "\n " + edited), (12, None), (13, " "), (14, "clean text only"),
            (10, "Short  story"), (None, items[5][1]), (15, make(3000))]
    left = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id int")
    right = spark.createDataFrame([(*x, "n") for x in items], "item_id long, text string, doc_id string")
    want = brute(docs, items, d.RATE)
    assert len(want) >= 4
    for block in (d.BLOCK_BYTES, 60):
        got = [(r.doc_id, r.item_id, r.distance) for r in d.contaminated(left, right, block_bytes=block).collect()]
        assert sorted(got, key=str) == want
    kept = d.decontaminate(left, right)
    assert kept.columns == left.columns and {r.doc_id for r in kept.collect()} == {12, 13, 14, 15}
    assert d.contaminated(left.limit(0), right).count() == 0 and d.contaminated(left, right.limit(0)).count() == 0
