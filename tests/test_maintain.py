"""Maintained views against views counted from scratch."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import maintain

SCHEMA = "k string, g int, v int, day date, note string"
KEYS, SUMS, EXTREMES = ["k", "g"], ("v",), ("v", "day")


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("v", F.col("v").cast("long"))


def _set(frame):
    return sorted(map(repr, (r.asDict(True) for r in frame.select(*sorted(frame.columns)).collect())))


def _random(rng, n):
    import datetime

    key = lambda: rng.choice([None, "a", "b", "hot", "hot", "hot", ""])
    day = lambda: rng.choice([None, datetime.date(2024, 1, rng.randint(1, 9))])
    return [(key(), rng.choice([None, 1, 2]), rng.choice([None, *range(-4, 5)]), day(), rng.choice(["x", "y" * 5000, None])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_five_batches_equal_a_recount(spark, seed):
    rng = random.Random(seed)
    rows = _random(rng, 120)
    before = _frame(spark, rows)
    view = maintain.counted(before, KEYS, SUMS, EXTREMES)
    for _ in range(5):
        rows = [r if rng.random() < 0.7 else (r[0], r[1], rng.randint(-9, 9), *r[3:]) for r in rows if rng.random() < 0.75] + _random(rng, 20)
        after = _frame(spark, rows)
        view = maintain.advanced(view, maintain.changes(before, after), after, KEYS, SUMS, EXTREMES)
        before = after
        assert _set(view) == _set(maintain.counted(after, KEYS, SUMS, EXTREMES))


def test_feed(spark):
    before = _frame(spark, [("a", 1, 1, None, None)] * 3 + [("b", None, 2, None, "x")])
    after = _frame(spark, [("a", 1, 1, None, None)] + [("b", None, 2, None, "x"), ("b", None, 2, None, "y")])
    assert sorted((r.k, r.note, r[maintain.WEIGHT]) for r in maintain.changes(before, after).collect()) == [("a", None, -2), ("b", "y", 1)]
    assert maintain.changes(before, before).count() == 0


def test_all_gone_and_empty(spark):
    some, none = _frame(spark, [("a", 1, 1, None, None), (None, None, None, None, None)]), _frame(spark, [])
    view = maintain.counted(some, KEYS, SUMS, EXTREMES)
    assert maintain.advanced(view, maintain.changes(some, none), none, KEYS, SUMS, EXTREMES).count() == 0
    empty = maintain.counted(none, KEYS, SUMS, EXTREMES)
    assert _set(maintain.advanced(empty, maintain.changes(none, some), some, KEYS, SUMS, EXTREMES)) == _set(view)
    assert _set(maintain.advanced(view, maintain.changes(some, some), some, KEYS, SUMS, EXTREMES)) == _set(view)


def test_only_touched_keys_are_built(spark):
    view = spark.createDataFrame([("a", 1), (None, 2), ("c", 3)], "k string, n int")
    asked = []

    def build(keys):
        asked.extend(r.k for r in keys.collect())
        return keys.where("k is null").select("k", F.lit(9).alias("n"))

    touched = spark.createDataFrame([(None,), (None,), ("c",)], "k string")
    out = maintain.rebuilt(view, touched, ["k"], build)
    assert sorted(out.collect(), key=repr) == sorted([("a", 1), (None, 9)], key=repr)
    assert sorted(asked, key=repr) == ["c", None]


def test_checks_are_counted_while_writing(spark, tmp_path):
    rows = spark.range(0, 1000, 1, 8).withColumn("v", F.when(F.col("id") % 10 != 0, F.col("id")))
    found = maintain.written_with_checks(rows, str(tmp_path / "out"), {"small": F.col("v") < 500, "even": F.col("id") % 2 == 0})
    assert found == {"rows": 1000, "small": 450, "even": 500}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1000
    assert maintain.written_with_checks(rows.limit(0), str(tmp_path / "none"), {"small": F.col("v") < 500}) == {"rows": 0, "small": 0}
