"""Registered queries over maintained views, each with SQL that counts the last snapshot from scratch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewright.operators import maintain, review
from tidewright.plans.queries import query, t
from tidewright.sources.files import cut, shared_folder

BATCHES = 5
#: Orders as snapshot {s} holds them: some come later, some are deleted, statuses and amounts change.
_SNAPSHOT = (
    "SELECT CASE WHEN o_custkey % 17 <> 0 THEN o_custkey END AS customer, CASE WHEN o_orderkey % 5 <= {s} THEN o_orderstatus ELSE 'N' END AS status, o_orderdate AS day, o_orderkey AS id, "
    "CASE WHEN o_orderkey % 13 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 3 = 0 THEN {s} ELSE 0 END END AS amount "
    "FROM {orders} WHERE o_orderkey % 7 <= {s} + 1 AND o_orderkey % 11 >= {s}"
)
_LAST = _SNAPSHOT.format(s=BATCHES, orders="orders")


def _snapshot(spark, sf, s):
    return spark.sql(_SNAPSHOT.format(s=s, orders="{orders}"), orders=t(spark, sf, "orders"))


def _maintained(spark, sf, keys, sums=(), extremes=()):
    """The first snapshot counted whole, then a view for each batch from its changes alone."""
    columns = [*keys, *sums, *extremes]
    before = _snapshot(spark, sf, 0).select(*columns)
    view = cut(maintain.counted(before, keys, sums, extremes))
    for s in range(1, BATCHES + 1):
        after = _snapshot(spark, sf, s).select(*columns)
        view = cut(maintain.advanced(view, maintain.changes(before, after), after, keys, sums, extremes))
        before = after
    return view


@query(f"SELECT customer, status, count(*) AS n, CAST(sum(amount) AS BIGINT) AS sum_amount, count(amount) AS known_amount FROM ({_LAST}) GROUP BY customer, status")
def maintained_counts(spark, sf):
    """Orders and amounts of every customer and status after five batches of changes."""
    return _maintained(spark, sf, ["customer", "status"], ("amount",))


@query(
    f"""SELECT customer, count(*) AS n, CAST(min(day) AS VARCHAR) AS low_day, CAST(max(day) AS VARCHAR) AS high_day, min(amount) AS low_amount, max(amount) AS high_amount
    FROM (SELECT * REPLACE (CAST(day AS DATE) AS day) FROM ({_LAST})) GROUP BY customer"""
)
def maintained_extremes(spark, sf):
    """First and last day, smallest and largest amount of every customer after five batches of changes."""
    out = _maintained(spark, sf, ["customer"], (), ("day", "amount"))
    return out.select("customer", "n", *(F.col(c).cast("date").cast("string").alias(c) for c in ("low_day", "high_day")), "low_amount", "high_amount")


@query(
    f"""SELECT customer, count(*) AS n, string_agg(concat(CAST(id AS VARCHAR), status), ',' ORDER BY day, id) AS orders FROM (SELECT * REPLACE (CAST(day AS DATE) AS day) FROM ({_LAST}))
    WHERE customer IS NOT NULL GROUP BY customer"""
)
def maintained_lists(spark, sf):
    """Every customer's list of orders after five batches; customers whose orders did not change are not built again."""
    rows = lambda s: _snapshot(spark, sf, s).where("customer IS NOT NULL").select("customer", F.col("day").cast("date").alias("day"), "id", "status")

    def built(customers, orders):
        out = review.nested_view(customers, "customer", {"orders": (orders, [F.col("day"), F.col("id")])})
        return out.where("n_orders > 0").select("customer", F.col("n_orders").alias("n"), F.array_join(F.transform("orders", lambda x: F.concat(x["id"].cast("string"), x["status"])), ",").alias("orders"))

    before = rows(0)
    view = cut(built(before.select("customer").distinct(), before))
    for s in range(1, BATCHES + 1):
        after = rows(s)
        view = cut(maintain.rebuilt(view, maintain.changes(before, after), ["customer"], lambda k, after=after: built(k, after.join(k, "customer", "left_semi"))))
        before = after
    return view


@query(
    """SELECT unnest(['rows', 'large_quantity', 'shipped_early', 'no_discount_on_returns']) AS rule, unnest([count(*), count(*) FILTER (WHERE NOT l_quantity > 5),
    count(*) FILTER (WHERE NOT CAST(l_shipdate AS DATE) < DATE '1997-01-01'), count(*) FILTER (WHERE NOT (l_returnflag <> 'R' OR l_discount = 0))]) AS violations FROM lineitem"""
)
def publication_checks(spark, sf):
    """Lines are published and checked in one pass."""
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "l_returnflag", "l_discount")
    checks = {
        "large_quantity": F.col("l_quantity") > 5,
        "shipped_early": F.col("l_shipdate").cast("date") < F.lit("1997-01-01").cast("date"),
        "no_discount_on_returns": (F.col("l_returnflag") != "R") | (F.col("l_discount") == 0),
    }
    shared_folder(spark)
    found = maintain.written_with_checks(lines, f"{spark.sparkContext.getCheckpointDir()}/published-{uuid.uuid4().hex}", checks)
    return spark.createDataFrame([(k, found[k]) for k in ("rows", *checks)], "rule string, violations long")
