"""Views kept up to date from what changed between two snapshots, without counting all rows again."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewright.sources.files import cut

WEIGHT = "_weight"


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The rows of `after` and how many more of each there are than before: `_weight`, negative where rows went, never zero.

    Rows are equal when every column is, nulls included; a changed row goes once and comes once. Repeated rows count
    as often as they stand. Both sides are summed before they move. Columns must be comparable (no maps).
    """
    columns = after.columns
    signed = before.select(*columns).withColumn(WEIGHT, F.lit(-1).cast("long")).unionByName(after.withColumn(WEIGHT, F.lit(1).cast("long")))
    return signed.groupBy(*columns).agg(F.sum(WEIGHT).alias(WEIGHT)).where(F.col(WEIGHT) != 0)


def _of_keys(rows: DataFrame, named: DataFrame, keys: list[str], how: str) -> DataFrame:
    """rows whose keys, nulls as values, are named (left_semi) or not (left_anti)."""
    other = named.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)))
    return rows.join(other, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys))), how)


def counted(rows: DataFrame, keys: list[str], sums: tuple[str, ...] = (), extremes: tuple[str, ...] = ()) -> DataFrame:
    """The view from scratch: per key n, sum_<c> and known_<c> (values that are not null), low_<c> and high_<c>.

    Sums are of whole numbers or decimals: those of doubles would depend on the order of changes.
    """
    parts = [F.count(F.lit(1)).alias("n")]
    parts += [x for c in sums for x in (F.sum(c).alias(f"sum_{c}"), F.count(c).alias(f"known_{c}"))]
    parts += [x for c in extremes for x in (F.min(c).alias(f"low_{c}"), F.max(c).alias(f"high_{c}"))]
    return rows.groupBy(*keys).agg(*parts)


def advanced(view: DataFrame, feed: DataFrame, after: DataFrame, keys: list[str], sums: tuple[str, ...] = (), extremes: tuple[str, ...] = ()) -> DataFrame:
    """The view of `counted` after the changes of `feed`, equal to counting `after` from scratch.

    Rows of untouched keys pass as they are. Counts and sums of touched keys take the signed changes. An extreme that lost
    a row no new row makes up for cannot be told from the changes: only keys of that kind are counted again in `after`.
    Keys without rows leave the view. An empty feed gives the view.
    """
    w = F.col(WEIGHT)
    parts = [F.sum(w).alias("n")]
    parts += [x for c in sums for x in (F.sum(w * F.col(c)).alias(f"sum_{c}"), F.coalesce(F.sum(F.when(F.col(c).isNotNull(), w)), F.lit(0)).alias(f"known_{c}"))]
    for c in extremes:
        came, went = F.when(w > 0, F.col(c)), F.when(w < 0, F.col(c))
        parts += [F.min(came).alias(f"low_{c}"), F.max(came).alias(f"high_{c}"), F.min(went).alias(f"lost_low_{c}"), F.max(went).alias(f"lost_high_{c}")]
    delta = cut(feed.groupBy(*keys).agg(*parts))
    stored = _of_keys(view, delta, keys, "left_semi")
    lost = [f"lost_{e}_{c}" for c in extremes for e in ("low", "high")]
    typed = delta.select(*(F.col(f.name).cast(f.dataType) for f in view.schema), *lost, F.lit(False).alias("_stored"))
    both = stored.withColumn("_stored", F.lit(True)).unionByName(typed, allowMissingColumns=True)
    sum_of = lambda c: F.sum(c).alias(c)
    merged = [sum_of("n")] + [x for c in sums for x in (sum_of(f"sum_{c}"), sum_of(f"known_{c}"))]
    unsure = F.lit(False)
    for c in extremes:
        for e, f in (("low", F.min), ("high", F.max)):
            x = f"{e}_{c}"
            old, new = f(F.when(F.col("_stored"), F.col(x))), f(F.when(~F.col("_stored"), F.col(x)))
            merged += [f(x).alias(x), old.alias(f"_old_{x}"), new.alias(f"_new_{x}"), f(f"lost_{x}").alias(f"_lost_{x}")]
            gone, had, came = F.col(f"_lost_{x}"), F.col(f"_old_{x}"), F.col(f"_new_{x}")
            touched = gone <= had if e == "low" else gone >= had
            made_up = came <= gone if e == "low" else came >= gone
            unsure = unsure | (F.coalesce(touched, F.lit(False)) & ~F.coalesce(made_up, F.lit(False)))
    moved = both.groupBy(*keys).agg(*merged).withColumn("_unsure", unsure).where("n > 0")
    # a sum without any known value is null, as it is when counted from scratch
    moved = moved.withColumns({f"sum_{c}": F.when(F.col(f"known_{c}") > 0, F.col(f"sum_{c}")) for c in sums}) if sums else moved
    if extremes:
        moved = cut(moved)
    out = _of_keys(view, delta, keys, "left_anti").unionByName(moved.where("not _unsure").select(*view.columns))
    if extremes:
        out = out.unionByName(counted(_of_keys(after, moved.where("_unsure"), keys, "left_semi"), keys, sums, extremes))
    return out.select(*view.columns)


def rebuilt(view: DataFrame, touched: DataFrame, keys: list[str], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The view with the rows of touched keys built anew by `build`, which gets those keys, each once; all others pass as they are.

    For views that no sum can follow, such as nested ones; `build` gives no row for a key that is gone.
    """
    named = cut(touched.select(*keys).distinct())
    return _of_keys(view, named, keys, "left_anti").unionByName(build(named).select(*view.columns))


def written_with_checks(rows: DataFrame, path: str, checks: dict[str, Column]) -> dict[str, int]:
    """Write rows as Parquet; how many there are (`rows`) and how many break each check, counted by the pass that writes them.

    A check that is unknown for a row is not broken. The counts stand in the writing stage itself, so a task that is tried
    again counts once, and nothing is read a second time.
    """
    seen = [F.count(F.lit(1)).alias("rows"), *(F.count_if(~c).alias(name) for name, c in checks.items())]
    told = Observation()
    rows.observe(told, *seen).write.parquet(path)
    return dict(told.get)
