"""Publication: upserts, append-only inserts, precedence, change detection, requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import exact

#: Where a coupon rate can come from.
EXCHANGE, DETAILS = "BSE_BHAVCOPY", "NSDL"


def unused(df: DataFrame) -> str:
    """How no column of df begins: underscores, more than its longest name has letters."""
    return "_" * (1 + max(map(len, df.columns), default=0))


def insert_missing(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows whose key is not stored: the created set."""
    return incoming.join(stored.select(*keys), keys, "left_anti").dropDuplicates(keys)


def append_only(stored: DataFrame, incoming: DataFrame, identity: list[str], order: list[Column]) -> DataFrame:
    """Incoming rows new by null-safe identity; within the batch the first by `order` wins.

    The stored table comes down to rows whose hash the batch knows before it is compared, so it is neither sorted nor moved
    while Spark can broadcast those hashes; what is left is compared value by value, in the stored types, nulls with nulls.
    """
    typed = [F.col(c).cast(stored.schema[c].dataType) for c in identity]
    own = unused(incoming)
    hashed = F.xxhash64(*typed).alias(f"{own}hash")
    known = stored.select(hashed, *(x.alias(f"{own}{i}") for i, x in enumerate(typed)))
    hits = known.join(incoming.select(hashed), f"{own}hash", "left_semi")
    first = latest(incoming, identity, *order)
    same = (x.eqNullSafe(F.col(f"{own}{i}")) for i, x in enumerate(typed))
    return first.join(hits.drop(f"{own}hash"), reduce(Column.__and__, same), "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], now: Column) -> DataFrame:
    """Replace every value of a stored key, nulls included; created_at is kept, updated_at set."""
    s, i = stored.alias("s"), incoming.withColumn("_in", F.lit(True)).alias("i")
    joined = s.join(i, keys, "full_outer")
    hit = F.col("_in").isNotNull()
    return joined.select(
        *keys,
        *(F.when(hit, F.col(f"i.{v}")).otherwise(F.col(f"s.{v}")).alias(v) for v in values),
        F.coalesce(F.col("s.created_at"), now).alias("created_at"),
        F.when(hit, now).otherwise(F.col("s.updated_at")).alias("updated_at"),
    )


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first by `order`."""
    n = f"{unused(df)}n"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def coupon_change(stored_rate: Column, stored_date: Column, stored_source: Column, rate: Column, date: Column, source: str) -> Column:
    """REPLACE, ADVANCE_TRADE_DATE or KEEP for an exchange's coupon rate.

    A later date with another rate replaces; a later date with the same rate advances; an older date keeps.
    """
    other = F.coalesce(stored_source != source, F.lit(True)) | stored_date.isNull()
    return (
        F.when(other, "REPLACE")
        .when(date < stored_date, "KEEP")
        .when(~rate.eqNullSafe(stored_rate), "REPLACE")
        .when(date > stored_date, "ADVANCE_TRADE_DATE")
        .otherwise("KEEP")
    )


def coupon_disagrees(stored_rate: Column, stored_source: Column, rate: Column, exchange: str = EXCHANGE) -> Column:
    """True where an exchange's rate is stored and a backup's rate differs; the exchange's stays."""
    return (stored_source == exchange) & stored_rate.isNotNull() & rate.isNotNull() & (stored_rate != rate)


def scalar_change(stored: Column, new: Column) -> Column:
    """True where a value arrives and differs; a missing value never erases."""
    return new.isNotNull() & ~new.eqNullSafe(stored)


def number_change(stored: Column, new: Column) -> Column:
    """True where an exact number arrives and differs as a number; a missing value never erases."""
    return new.isNotNull() & ~F.coalesce(exact.same(stored, new), F.lit(False))


def requests_again(created: Column, missing: Column, count: Column, last: Column, now: Column) -> Column:
    """Ask for details of new securities, or again while details are missing, at most three times, a day apart."""
    waited = last.isNull() | (last <= now - F.expr("interval 1 day"))
    return created | (missing & (count < 3) & waited)


def screen_conflicts(df: DataFrame, partition: list[str], unsecured: Column, covers: Column) -> DataFrame:
    """Flag coverage rows that stand beside an unsecured statement of the same file."""
    flag = F.max(F.when(unsecured, 1).otherwise(0)).over(Window.partitionBy(*partition))
    return df.withColumn("conflict", (flag == 1) & covers)
