"""Running aggregates over the rows of a group in order, when one group may hold a large part of all rows.

A window over such a group would run in one task. Here the rows are laid out by (group, order) in range
partitions of even size; each partition's stretch of a group is added up, the sums of a group's stretches, one a
partition, are run over, and each stretch continues from the sum before it. The aggregate must be associative,
and its two halves are joined by the same function that makes them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.sources.files import cut

#: name -> (aggregate over rows, the same over two values)
AGGREGATES: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
    "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
}


def running(rows: DataFrame, group: list[str], order: list[str], measures: dict[str, tuple[str, Column]], before: bool = True, partitions: int | None = None) -> DataFrame:
    """rows with a column per measure: its aggregate over the earlier rows of the group (with before=False, this one too).

    A measure is (max, min or sum, column); null where no earlier row has a value. The order must be total within a
    group. Null groups and nulls in the order take part as values do, lowest first. An empty table gives no rows.
    """
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    laid = rows.withColumns({f"_m_{name}": value for name, (_, value) in measures.items()})
    laid = laid.repartitionByRange(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    laid = cut(laid.withColumn("_at", F.monotonically_increasing_id())).withColumn("_task", F.shiftright("_at", 33))
    aggregate = {name: AGGREGATES[kind] for name, (kind, _) in measures.items()}
    whole = laid.groupBy(*group, "_task").agg(*(aggregate[name][0](f"_m_{name}").alias(f"_s_{name}") for name in measures))
    earlier = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(*(F.col(c).alias(f"_g_{i}") for i, c in enumerate(group)), F.col("_task").alias("_t"), *(aggregate[name][0](f"_s_{name}").over(earlier).alias(f"_b_{name}") for name in measures))
    same = F.col("_task") == F.col("_t")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{i}"))
    here = Window.partitionBy(*group, "_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = laid.join(starts, same).withColumns({f"_r_{name}": aggregate[name][0](f"_m_{name}").over(here) for name in measures})
    return out.select(*rows.columns, *(aggregate[name][1](F.col(f"_b_{name}"), F.col(f"_r_{name}")).alias(name) for name in measures))
