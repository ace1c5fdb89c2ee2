"""Registered queries over events in order: folds per group, admission along chains, each with its SQL, which goes event by event."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewright.operators import merge
from tidewright.plans.queries import query, t
from tidewright.sources.files import shared_folder
from tidewright.streaming import admission, fold, state

# A security's coupon events: half of all rows are of one security, dates go up and down, every fifth rate is from the details.
_COUPONS = (
    "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE o_custkey END AS isin, o_orderkey AS sequence, (o_orderkey % 89 + o_custkey) % 4 AS rate, "
    "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS trade_date, CASE WHEN o_orderkey % 5 = 0 THEN 'NSDL' ELSE 'BSE_BHAVCOPY' END AS source FROM {orders}"
)
_STORED = (
    "SELECT p_partkey AS isin, CAST(p_size AS BIGINT) % 4 AS rate, CASE WHEN p_partkey % 4 = 0 THEN DATE '1995-06-17' END AS trade_date, "
    "CASE WHEN p_partkey % 4 = 0 OR p_partkey % 7 = 0 THEN 'BSE_BHAVCOPY' ELSE 'NSDL' END AS source FROM {part} WHERE p_partkey % 3 <> 0"
)
_STEPS = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY sequence) AS n FROM ({_COUPONS.format(orders="orders")})),
    s AS ({_STORED.format(part="part")}),
    r AS (SELECT k.isin, CAST(0 AS BIGINT) AS n, s.rate, s.trade_date, s.source, CAST(NULL AS BIGINT) AS sequence, '' AS change, CAST(NULL AS BIGINT) AS changed_by
          FROM (SELECT isin FROM s UNION SELECT isin FROM e) AS k LEFT JOIN s ON s.isin = k.isin UNION ALL
        SELECT isin, n, CASE WHEN change = 'REPLACE' THEN new_rate ELSE rate END, CASE WHEN change = 'KEEP' THEN trade_date ELSE new_date END,
            CASE WHEN change = 'KEEP' THEN source ELSE new_source END, sequence, change, CASE WHEN change = 'REPLACE' THEN sequence ELSE changed_by END
        FROM (SELECT e.isin, e.n, e.sequence, e.rate AS new_rate, e.trade_date AS new_date, e.source AS new_source, r.rate, r.trade_date, r.source, r.changed_by,
            CASE WHEN e.source = 'NSDL' THEN CASE WHEN r.source IS NOT DISTINCT FROM 'BSE_BHAVCOPY' OR e.rate IS NOT DISTINCT FROM r.rate THEN 'KEEP' ELSE 'REPLACE' END
            WHEN r.source IS DISTINCT FROM 'BSE_BHAVCOPY' OR r.trade_date IS NULL THEN 'REPLACE' WHEN r.trade_date > e.trade_date THEN 'KEEP'
            WHEN r.rate IS NULL OR e.rate <> r.rate THEN 'REPLACE' WHEN r.trade_date < e.trade_date THEN 'ADVANCE_TRADE_DATE' ELSE 'KEEP' END AS change
            FROM r JOIN e ON e.isin = r.isin AND e.n = r.n + 1))"""


def _coupons(spark, sf):
    orders, parts = t(spark, sf, "orders"), t(spark, sf, "part")
    events = spark.sql(_COUPONS.format(orders="{orders}"), orders=orders)
    return fold.coupons_in_order(spark.sql(_STORED.format(part="{parts}"), parts=parts), events)


@query(f"{_STEPS} SELECT isin, sequence, change FROM r WHERE n > 0")
def coupon_changes_in_order(spark, sf):
    return _coupons(spark, sf)[0].select("isin", "sequence", "change")


@query(f"{_STEPS} SELECT isin, rate, strftime(trade_date, '%Y-%m-%d') AS trade_date, source, changed_by FROM r QUALIFY row_number() OVER (PARTITION BY isin ORDER BY n DESC) = 1")
def coupons_after_events(spark, sf):
    return _coupons(spark, sf)[1].select("isin", "rate", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date"), "source", "changed_by")


# A security's details: a third of all rows are of one security; every eleventh event erases the second field.
_DETAILS = (
    "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS isin, o_orderkey AS sequence, CASE WHEN o_custkey % 3 <> 0 THEN o_orderstatus END AS status, "
    "CASE WHEN o_custkey % 4 <> 0 THEN substring(o_orderpriority, 1, 1) END AS basis, o_orderkey % 11 = 0 AS unsecured FROM {orders}"
)
_HELD = "SELECT c_custkey AS isin, 'O' AS status, CASE WHEN c_custkey % 2 = 0 THEN '5' END AS basis FROM {customer} WHERE c_custkey % 5 = 0"


@query(
    f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY isin ORDER BY sequence) AS n FROM ({_DETAILS.format(orders="orders")})), s AS ({_HELD.format(customer="customer")}),
    r AS (SELECT k.isin, CAST(0 AS BIGINT) AS n, s.status, s.basis, CAST(NULL AS BIGINT) AS sequence, '' AS changed FROM (SELECT isin FROM s UNION SELECT isin FROM e) AS k LEFT JOIN s ON s.isin = k.isin UNION ALL
        SELECT e.isin, e.n, coalesce(e.status, r.status), CASE WHEN NOT e.unsecured THEN coalesce(e.basis, r.basis) END, e.sequence,
            concat_ws(',', CASE WHEN e.status IS NOT NULL AND e.status IS DISTINCT FROM r.status THEN 'status' END,
            CASE WHEN CASE WHEN e.unsecured THEN r.basis IS NOT NULL ELSE e.basis IS NOT NULL AND e.basis IS DISTINCT FROM r.basis END THEN 'basis' END)
        FROM r JOIN e ON e.isin = r.isin AND e.n = r.n + 1),
    z AS (SELECT isin, status, basis FROM r QUALIFY row_number() OVER (PARTITION BY isin ORDER BY n DESC) = 1)
    SELECT isin, sequence, changed, NULL AS status, NULL AS basis FROM r WHERE n > 0 UNION ALL SELECT isin, -1, NULL, status, basis FROM z"""
)
def details_in_order(spark, sf):
    orders, customer = t(spark, sf, "orders"), t(spark, sf, "customer")
    events, held = spark.sql(_DETAILS.format(orders="{orders}"), orders=orders), spark.sql(_HELD.format(customer="{customer}"), customer=customer)
    told, last = fold.scalars_in_order(held, events, ["status", "basis"], {"basis": F.col("unsecured")})
    none = F.lit(None).cast("string")
    rows = told.select("isin", "sequence", F.array_join("changed", ",").alias("changed"), none.alias("status"), none.alias("basis"))
    return rows.unionByName(last.select("isin", F.lit(-1).cast("long").alias("sequence"), none.alias("changed"), "status", "basis"))


@query(
    """WITH c AS (SELECT c_custkey AS k, (c_custkey - min(c_custkey) OVER ()) % 2 = 0 AS free, count(*) OVER () AS n FROM customer)
    SELECT k AS sequence, CASE WHEN free THEN 'ACCEPTED' ELSE 'CONFLICT' END AS outcome FROM c UNION ALL SELECT k + n, CASE WHEN free AND k % 3 <> 0 THEN 'REPLAY' ELSE 'CONFLICT' END FROM c"""
)
def admission_chain(spark, sf):
    """One chain through the whole table, each submission sharing its key with the one before or its event with it, then all once more."""
    k = F.col("c_custkey")
    once = t(spark, sf, "customer").select(k.alias("sequence"), F.floor(k / 2 + 0.5).cast("string").alias("idempotency_key"), F.floor(k / 2).cast("string").alias("event_key"), F.lit("h").alias("payload_hash"))
    n = t(spark, sf, "customer").count()
    again = once.withColumn("payload_hash", F.when(F.col("sequence") % 3 == 0, "other").otherwise("h")).withColumn("sequence", F.col("sequence") + n)
    return admission.admit(once.limit(0), once.unionByName(again)).select("sequence", "outcome")


@query(
    f"""{_STEPS.replace(_STORED.format(part="part"), _STORED.format(part="part") + " AND false")} SELECT isin, CAST(rate AS STRING) AS rate, strftime(trade_date, '%Y-%m-%d') AS trade_date, source FROM r
    QUALIFY row_number() OVER (PARTITION BY isin ORDER BY n DESC) = 1"""
)
def coupon_stream(spark, sf):
    """Two runs of one stream, a third of the events late, in the second: every coupon by its last change."""
    folder = f"{shared_folder(spark)}/coupon-stream-{uuid.uuid4().hex}"
    orders = t(spark, sf, "orders")
    events = spark.sql(_COUPONS.format(orders="{orders}"), orders=orders)
    for late in (False, True):
        events.where((F.col("sequence") % 3 == 0) == late).write.mode("append").parquet(f"{folder}/events")
        stream = spark.readStream.schema(events.schema).parquet(f"{folder}/events")
        write = lambda df, n: df.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{folder}/changes/part={n}")
        state.stream_coupons(stream, write, f"{folder}/checkpoint").awaitTermination()
    changes = spark.read.parquet(f"{folder}/changes")
    last = merge.latest(changes, ["isin"], F.desc("batch"))
    return last.select("isin", "rate", F.date_format("trade_date", "yyyy-MM-dd").alias("trade_date"), "source")
