import pytest
from pyspark.sql import functions as F

from tidewright.functions import json_values, rules
from tidewright.streaming import admission


def apply(spark, step, text):
    value, code = step(F.col("x"))
    return tuple(spark.createDataFrame([(text,)], "x string").select(value.alias("v"), code.alias("c")).first())


@pytest.mark.parametrize(("text", "want"), [
    ("1,234,567.8", ("1234567.8", None)), ("12,34,567.8", ("1234567.8", None)), ("1,2,34", (None, "INVALID_NUMBER_GROUPING")),
    ("12,345", ("12345", None)), ("-5", ("-5", None)), ("1e5", (None, "INVALID_DECIMAL")), ("abc", (None, "INVALID_DECIMAL")), (None, (None, None)), ("a,b", (None, "INVALID_DECIMAL")),
])
def test_grouped_numbers(spark, text, want):
    assert apply(spark, rules.normalize_grouped_number, text) == want


@pytest.mark.parametrize(("step", "text", "want"), [
    (rules.whole_number, "14.00", ("14", None)), (rules.whole_number, "14.5", (None, "NOT_WHOLE_NUMBER")), (rules.whole_number, "x", (None, "INVALID_DECIMAL")),
    (rules.strict_date, "29-02-2024", ("2024-02-29", None)), (rules.strict_date, "30-02-2024", (None, "INVALID_DATE")), (rules.strict_date, "1899-12-31", (None, "INVALID_DATE")),
    (rules.strict_date, "2024-1-01", (None, "INVALID_DATE")), (rules.exact_decimal, "9" * 1001, (None, "INVALID_DECIMAL")), (rules.exact_decimal, "89400.00", ("89400.00", None)),
    (rules.percent, "1" * 31, (None, "INVALID_DECIMAL")), (rules.keep_before_first_percent, "8.1% (cat I & II)", ("8.1", None)),
    (rules.zero_to_null, "0.00", (None, None)), (rules.strip_trailing_percent, "7 %", ("7", None)), (rules.trim, " a ", ("a ", None)),
])
def test_scalar_rules(spark, step, text, want):
    assert apply(spark, step, text) == want


def test_registry(spark):
    with pytest.raises(KeyError):
        rules.normalize(F.col("x"), ["nope"])
    rules.register_normalizer("dashless", lambda c: (F.regexp_replace(c, "-", ""), rules.none()))
    assert apply(spark, lambda c: rules.normalize(c, ["trim", "dashless"]), " a-b ") == ("ab", None)
    with pytest.raises(KeyError):
        rules.register_normalizer("dashless", rules.trim)
    del rules.NORMALIZERS["dashless"]


@pytest.mark.parametrize(("text", "good"), [
    ('{"a": 1}', True), ("﻿[1]", True), ('{"a": 1} x', False), ('{"a": 1}, 2', False), ('{"a": 1, "a": 2}', False), ("", False), ('"\\u0000"', False), ("{", False),
])
def test_strict_documents(spark, text, good):
    frame = spark.createDataFrame([(text,)], "x string").select(json_values.strict_document(F.col("x")).isNotNull().alias("g"))
    assert frame.first().g is good


def test_stream_admission(spark, tmp_path):
    schema = "sequence long, idempotency_key string, event_key string, payload_hash string"
    rows = [(1, "k1", "e1", "h1"), (2, "k1", "e1", "h1"), (3, "k1", "e2", "h2"), (4, "k2", "e3", "h3"), (5, "k0", "e0", "h0")]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    target = str(tmp_path / "requests")
    spark.createDataFrame([(0, "k0", "e0", "h0")], schema).write.parquet(target)
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    query = admission.run_stream(stream, lambda: spark.read.parquet(target), lambda df: df.write.mode("append").parquet(target), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert {r.sequence for r in spark.read.parquet(target).collect()} == {0, 1, 4}
    outcomes = {r.sequence: r.outcome for r in admission.admit(spark.read.parquet(target).where("sequence = 0"), spark.createDataFrame(rows, schema)).collect()}
    assert outcomes == {1: "ACCEPTED", 2: "REPLAY", 3: "CONFLICT", 4: "ACCEPTED", 5: "REPLAY"}
