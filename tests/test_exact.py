"""Exact numbers against Python's decimals."""

from decimal import Decimal, localcontext

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions import exact

TEXT = st.from_regex(r"-?[0-9]{1,70}(\.[0-9]{1,50})?", fullmatch=True)
NEAR = st.sampled_from(["0", "-0", "-0.00", "0.0", "00", "2.5", "2.50", "02.5", "-2.5", "-2.50", "-2.55", "1" * 39, "1" * 38 + "2", "-" + "1" * 39, "0.00000000001", "0.000000000012", "9" * 1000])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(TEXT | NEAR, TEXT | NEAR), min_size=40, max_size=80))
def test_any_numbers(spark, pairs):
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = rows.select("a", "b", exact.less(F.col("a"), F.col("b")), exact.same(F.col("a"), F.col("b")), exact.is_negative(F.col("a")), exact.plain(F.col("a"))).collect()
    with localcontext() as context:
        context.prec = 2000
        for a, b, less, same, negative, plain in got:
            x, y = Decimal(a), Decimal(b)
            assert (less, same, negative) == (x < y, x == y, x < 0), (a, b)
            assert Decimal(plain) == x and len(plain) <= len(a)


def test_no_numbers(spark):
    rows = spark.createDataFrame([(None, "1"), ("", "1"), ("abcdefghijklmnop", "1"), ("12345678901.", "1")], "a string, b string")
    assert [tuple(r) for r in rows.select(exact.less(F.col("a"), F.col("b")), exact.order_key(F.col("a")), exact.plain(F.col("a"))).collect()] == [(None, None, None)] * 4
