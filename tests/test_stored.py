"""Commits of two writers, the index of identities and clustered files."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tidewright.operators import merge, snapshots
from tidewright.operators.clustered import Clustered
from tidewright.operators.identities import BUCKET, IdentityIndex


def test_two_writers(spark, tmp_path):
    root = str(tmp_path)
    one, two = spark.range(1).toDF("v"), spark.range(2).toDF("v")
    assert snapshots.head(spark, root) == 0
    assert snapshots.commit(spark, root, {"a": one, "b": one}, 0) == 1
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, {"a": two}, 0)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, root, {"c": two}, 0, reads=("b",))
    assert snapshots.commit(spark, root, {"c": two}, 0) == 2
    assert snapshots.commit(spark, root, {"a": two}, 2) == 3
    assert [snapshots.read(spark, root, n).count() for n in "abc"] == [2, 1, 2]
    assert snapshots.read(spark, root, "a", 1).count() == 1
    assert snapshots.commit(spark, root, {}) == 4
    with pytest.raises(KeyError):
        snapshots.read(spark, root, "never")


def test_a_number_is_given_once(spark, tmp_path):
    root, won = str(tmp_path), []
    snapshots.commit(spark, root, {"a": spark.range(1)})

    def claim(i):
        if snapshots._claim(spark, root, 2, {"tables": {}, "written": [str(i)]}):
            won.append(i)

    threads = [threading.Thread(target=claim, args=(i,)) for i in range(12)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert len(won) == 1
    assert snapshots._commit_of(spark, root, 2)["written"] == [str(won[0])]
    assert not list((tmp_path / "commits").glob("*.draft"))


def test_vacuum(spark, tmp_path):
    root = str(tmp_path)
    for n in range(4):
        snapshots.commit(spark, root, {"a": spark.range(n + 1)} | ({"b": spark.range(7)} if n == 0 else {}))
    spark.range(3).write.parquet(f"{root}/a/nobody")
    assert snapshots.vacuum(spark, root, keep=2) == []  # all are young
    for n in range(2):
        snapshots.commit(spark, root, {"a": spark.range(9 + n)})
    assert len(snapshots.vacuum(spark, root, keep=2, hours=0)) == 5
    assert [snapshots.read(spark, root, n).count() for n in "ab"] == [10, 7]
    assert snapshots.read(spark, root, "a", 5).count() == 9
    with pytest.raises(snapshots.Conflict):  # what was committed since can no longer be told
        snapshots.commit(spark, root, {"z": spark.range(1)}, 1)
    with pytest.raises(ValueError):
        snapshots.vacuum(spark, root, keep=0)


IDENTITY = {"isin": "string", "kind": "string", "amount": "decimal(20,4)"}


def _entries(spark, rows):
    return spark.createDataFrame(rows, "isin string, kind string, amount string, n int, _name string, _n string")


def _random(rng, n):
    isin = lambda: rng.choice([None, "", "hot", "hot", "hot", *"abcdef"])
    return [(isin(), rng.choice([None, "x", "y" * 3000]), rng.choice([None, "1", "1.0", "2.50"]), i, "extra", None) for i in range(n)]


@pytest.mark.parametrize("indexed", [True, False])
def test_batches_append_what_is_new(spark, tmp_path, indexed):
    rng, seen = random.Random(3), set()
    index = IdentityIndex(str(tmp_path / "index"), IDENTITY, "isin", 16)
    stored = _entries(spark, []).withColumn("amount", F.col("amount").cast("decimal(20,4)"))
    index.add(_entries(spark, []))
    key = lambda r: (r[0], r[1], None if r[2] is None else float(r[2]))
    for batch in ([], _random(rng, 30), _random(rng, 30), _random(rng, 30)):
        rows = _entries(spark, batch).withColumn("amount", F.col("amount").cast("decimal(20,4)"))
        order = [F.col("n")]
        fresh = index.unseen(rows, order) if indexed else merge.append_only(stored, rows, list(IDENTITY), order)
        want = []
        for r in batch:
            if key(r) not in seen:
                seen.add(key(r))
                want.append(r[3])
        assert fresh.columns == rows.columns
        assert sorted(r.n for r in fresh.collect()) == want
        kept = rows.where(F.col("n").isin(want))
        index.add(kept)
        index.add(kept)  # as after a crash
        stored = stored.unionByName(kept)


def test_a_batch_reads_its_buckets(spark, tmp_path):
    index = IdentityIndex(str(tmp_path / "index"), {"isin": "string", "n": "bigint"}, "isin", 64)
    rows = spark.range(6400).select(F.concat(F.lit("S"), (F.col("id") % 200).cast("string")).alias("isin"), F.col("id").alias("n"))
    index.add(rows)
    batch = rows.where("isin in ('S7', 'S8')").unionByName(spark.createDataFrame([("S7", 9999)], "isin string, n bigint"))
    named = index._named(batch)
    wanted = {r[0] for r in named.select(BUCKET).distinct().collect()}
    found = index.names(named)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and BUCKET in plan.split("PartitionFilters: [")[1].split("]")[0]
    files = {r[0] for r in found.select(F.input_file_name()).distinct().collect()}
    assert {int(f.split(f"{BUCKET}=")[1].split("/")[0]) for f in files} == wanted and len(wanted) <= 2
    assert [tuple(r) for r in index.unseen(batch, [F.col("n")]).collect()] == [("S7", 9999)]


@pytest.mark.parametrize("down", [True, False])
def test_pages_walk_the_whole_table(spark, tmp_path, down):
    rng = random.Random(5)
    data = [(rng.choice([None, *range(-5, 40)]), i, "x") for i in range(700)]
    table = Clustered(str(tmp_path / "t"), (("day", down), ("id", False)))
    table.write(spark.createDataFrame(data, "day int, id long, low string"), 16)
    sign = -1 if down else 1
    want = sorted(((d, i) for d, i, _ in data), key=lambda r: (r[0] is not None, sign * (r[0] or 0), r[1]))
    seen, after = [], None
    while True:
        rows = table.page(spark, after, 120).collect()
        assert len(rows) <= 121
        seen += [(r.day, r.id) for r in rows[:120]]
        if len(rows) <= 120:
            break
        after = {"day": rows[119].day, "id": rows[119].id}
    assert seen == want


def test_a_page_reads_few_files(spark, tmp_path):
    table = Clustered(str(tmp_path / "t"), (("day", True), ("id", False)))
    rows = spark.range(10_000).select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 1000).cast("int")).alias("day"), "id")
    table.write(rows, 40)
    some = rows.where("id = 5500").first()
    for after in (None, {"day": some.day, "id": some.id}):
        page = table.page(spark, after)
        assert page.count() == 51
        assert len(page.inputFiles()) <= 2
    assert table.page(spark, {"day": rows.agg(F.min("day")).first()[0], "id": 10_000}).count() == 0


def test_clustered_edges(spark, tmp_path):
    empty = Clustered(str(tmp_path / "empty"), (("day", False),))
    empty.write(spark.createDataFrame([], "day string"), 4)
    assert empty.page(spark).count() == 0
    with pytest.raises(ValueError):
        Clustered(str(tmp_path / "text"), (("day", True),)).write(spark.createDataFrame([], "day string"), 4)
