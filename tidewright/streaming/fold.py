"""Events of a group applied in their order, all groups and all events at once.

What an event does to the state of its group is one of a few changes that close under composition: overwrite
(the last one counts), advance (the one of the latest date counts, the last among equals), keep. So the state
before every event is a running maximum of what the events before it leave, and no event waits for another's round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators import merge
from tidewright.operators.scan import running

EXCHANGE, DETAILS = merge.EXCHANGE, merge.DETAILS
_FIRST = -1  # the place of what is stored before all events


def _with_stored(stored: DataFrame, events: DataFrame, key: str, order: str) -> DataFrame:
    """Events, and each stored row as an event before all others."""
    return events.withColumn(order, F.col(order).cast("long")).unionByName(stored.withColumn(order, F.lit(_FIRST).cast("long")), allowMissingColumns=True)


def coupons_in_order(stored: DataFrame, events: DataFrame, key: str = "isin", order: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """(events with their change, coupons after all of them): rates of exchanges and of details, applied one after another.

    stored has key, rate, trade_date, source; events the same and `order`, 0 or more, unique within a key. An exchange's
    rate of an older date is kept out; another rate replaces, the same rate of a later date advances the date alone; a rate
    of the details is set only while no exchange has given one. changed_by is the order of the event that last replaced the
    rate, null if none did. Events without a rate, or an exchange's without a date, change nothing.
    """
    exchange = F.col("source").eqNullSafe(F.lit(EXCHANGE))
    old = F.col(order) == _FIRST
    given = F.when(exchange & (old | (F.col("rate").isNotNull() & F.col("trade_date").isNotNull())), F.struct("trade_date", order, "rate"))
    detail = F.when(~exchange & (old | F.col("rate").isNotNull()), F.struct(order, "rate", "source"))
    every = _with_stored(stored.select(key, "rate", "trade_date", "source"), events, key, order)
    seen = running(every, [key], [order], {"_given": ("max", given), "_detail": ("max", detail)}).where(~old)
    has = F.col("_given").isNotNull()
    rate, day = F.when(has, F.col("_given.rate")).otherwise(F.col("_detail.rate")), F.when(has, F.col("_given.trade_date"))
    of_exchange = merge.coupon_change(rate, day, F.when(has, EXCHANGE).otherwise(F.col("_detail.source")), F.col("rate"), F.col("trade_date"), EXCHANGE)
    of_details = F.when(has | F.col("rate").eqNullSafe(rate), "KEEP").otherwise("REPLACE")
    nothing = F.col("rate").isNull() | (exchange & F.col("trade_date").isNull())
    told = seen.withColumn("change", F.when(nothing, "KEEP").when(exchange, of_exchange).otherwise(of_details)).select(*events.columns, "change")
    last = every.select(key, given.alias("g"), detail.alias("d")).groupBy(key).agg(F.max("g").alias("g"), F.max("d").alias("d"))
    last = last.join(told.where("change = 'REPLACE'").groupBy(key).agg(F.max(order).alias("changed_by")), key, "left")
    has = F.col("g").isNotNull()
    pick = lambda a, b: F.when(has, F.col(a)).otherwise(F.col(b))
    return told, last.select(
        key, pick("g.rate", "d.rate").alias("rate"), F.col("g.trade_date").alias("trade_date"),
        F.when(has, EXCHANGE).otherwise(F.col("d.source")).alias("source"), "changed_by",
    )


def scalars_in_order(stored: DataFrame, events: DataFrame, fields: list[str], erased: dict[str, Column] | None = None, key: str = "isin", order: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """(events with `changed`, the names of the fields each changes; states after all events): values that are missing change nothing.

    `erased` says by field where an event erases what is stored, whatever it brings. order is 0 or more and unique
    within a key; a field is changed where its value differs from the one before.
    """
    erased = erased or {}
    none = F.lit(False)
    every = _with_stored(stored.select(key, *fields), events, key, order)
    wiped = {f: F.coalesce(erased.get(f, none), none) & (F.col(order) != _FIRST) for f in fields}
    left = {f: F.when(wiped[f], F.struct(F.col(order).alias("at"), F.lit(None).cast(every.schema[f].dataType).alias("value"))).when(F.col(f).isNotNull(), F.struct(F.col(order).alias("at"), F.col(f).alias("value"))) for f in fields}
    seen = running(every, [key], [order], {f"_{f}": ("max", left[f]) for f in fields}).where(F.col(order) != _FIRST)
    now = {f: F.when(wiped[f], F.col(f"_{f}.value").isNotNull()).otherwise(merge.scalar_change(F.col(f"_{f}.value"), F.col(f))) for f in fields}
    told = seen.withColumn("changed", F.array_compact(F.array(*(F.when(now[f], f) for f in fields)))).select(*events.columns, "changed")
    last = every.select(key, *(left[f].alias(f) for f in fields)).groupBy(key).agg(*(F.max(f).alias(f) for f in fields))
    return told, last.select(key, *(F.col(f"{f}.value").alias(f) for f in fields))
