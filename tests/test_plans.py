"""Plans that stay small: rules stand in them once, tables are read once."""

import re

from pyspark.sql import functions as F

from tidewright.plans import queries, securities
from tidewright.sources import files as sources


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_a_filter_does_not_repeat_the_rules(spark, sf_dir):
    """Patterns of two fields, each a few times, though the rows are filtered, listed or counted by what the rules found."""
    for name in ("mapping_projection", "issue_sequence", "csv_job_status"):
        assert len(re.findall("RLIKE", optimized(queries.QUERIES[name](spark, sf_dir)))) < 40, name
    rows = queries._lines(spark, sf_dir)
    assert len(re.findall("RLIKE", optimized(rows.where(F.col("valid") & (F.col("price.status") == "PASSED"))))) < 40


def test_lists_of_one_reading(spark, sf_dir):
    assert len(re.findall("Relation", optimized(queries.QUERIES["coupon_projection"](spark, sf_dir)))) == 1


def test_documents_are_dealt_out_and_read_once(spark, sf_dir):
    """One small table of files is read by as many tasks as a shuffle has, and each file once."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    files = queries._json_files(spark, sf_dir).limit(20).coalesce(1)
    files = files.mapInPandas(counted, files.schema)
    docs = securities.read(files)
    kept = sources.kept(docs)
    assert kept.count() == 20 and kept.where("document is not null").count() > 0
    assert read.value == 20
    # asked last: under adaptive execution this runs the shuffle
    assert docs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_listed_files_are_compared_by_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(sources, "ROWS_A_TASK", 10, raising=False)
    listed = spark.range(100).selectExpr("id % 50 AS request", "'b' AS bucket", "id % 25 AS object_key")
    fresh = sources.record_once(listed.where("request < 20"), listed)
    # as planned: adaptive execution may put very small partitions together
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "10" in re.findall(r"hashpartitioning\(.*, (\d+)\)", plan)
    assert sorted(r.request for r in fresh.collect()) == list(range(20, 50))
