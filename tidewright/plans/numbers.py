"""Registered queries over exact numbers, longer than decimals and doubles hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import exact
from tidewright.operators import csv_stage
from tidewright.plans.contracts import FieldSpec, RowRule, SourceContract
from tidewright.plans.queries import query, t

# Two numbers of up to 66 digits a row, which differ in sign, in their last digits, in scale or not at all.
_TAIL = "lpad(CAST((o_orderkey * 7919 + {0}) % 1000 AS STRING), 30, '3')"
_WIDE = "concat(CASE WHEN o_orderkey % 5 = {1} THEN '-' ELSE '' END, CASE WHEN o_orderkey % 7 = 0 THEN '00' ELSE '' END, CAST(o_custkey AS STRING), " + _TAIL + ", CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.50' WHEN 2 THEN concat('.', " + _TAIL + ") ELSE {2} END)"
_LEFT, _RIGHT = _WIDE.format("0", "1", "'.5'"), _WIDE.format("CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 13 - 6 END", "2", "'.500000000000000000000000000000000001'")


def _sides(x: str) -> str:
    """Sign and digits padded to one length, which compare as text within a sign."""
    whole = f"regexp_replace(split_part({x}, '.', 1), '^-', '')"
    return f"CASE WHEN {x} LIKE '-%' THEN -1 ELSE 1 END AS s_{x}, concat(lpad({whole}, 80, '0'), rpad(split_part({x}, '.', 2), 60, '0')) AS d_{x}"


@query(
    f"""SELECT o_orderkey, CASE WHEN s_a < s_b THEN true WHEN s_a > s_b THEN false WHEN s_a = 1 THEN d_a < d_b ELSE d_a > d_b END AS is_less, s_a = s_b AND d_a = d_b AS is_same,
    concat_ws(',', CASE WHEN s_a = -1 THEN 'NEGATIVE_VALUE' END) AS errors FROM (SELECT o_orderkey, {_sides("a")}, {_sides("b")} FROM (SELECT o_orderkey, {_LEFT} AS a, {_RIGHT} AS b FROM orders))"""
)
def exact_numbers(spark, sf):
    field = FieldSpec("a", "a", "DECIMAL", ("trim", "blankToNull", "normalizeGroupedNumber"), ("nonNegative",))
    rows = t(spark, sf, "orders").select("o_orderkey", F.expr(_LEFT).alias("a"), F.expr(_RIGHT).alias("b"))
    out = csv_stage.validate_fields(rows, (field,))
    return out.select("o_orderkey", exact.less(F.col("a.parsed"), F.col("b")).alias("is_less"), exact.same(F.col("a.parsed"), F.col("b")).alias("is_same"), F.array_join("a.errors", ",").alias("errors"))


@query(
    f"""SELECT o_orderkey, CASE WHEN s_a = 1 AND s_b = 1 AND d_a > d_b THEN 'PRICE_INCONSISTENT' ELSE '' END AS row_errors, s_a = 1 AND s_b = 1 AND d_a <= d_b AS valid
    FROM (SELECT o_orderkey, {_sides("a")}, {_sides("b")} FROM (SELECT o_orderkey, {_LEFT} AS a, {_RIGHT} AS b FROM orders))"""
)
def exact_price_rules(spark, sf):
    spec = lambda name: FieldSpec(name, name, "DECIMAL", ("trim", "blankToNull", "normalizeGroupedNumber"), ("nonNegative",))
    contract = SourceContract("wide", (spec("a"), spec("b")), (RowRule("a", "<=", "b"),), "a")
    rows = t(spark, sf, "orders").select("o_orderkey", F.expr(_LEFT).alias("a"), F.expr(_RIGHT).alias("b"))
    return csv_stage.validate_rows(rows, contract).select("o_orderkey", F.array_join("row_errors", ",").alias("row_errors"), "valid")
