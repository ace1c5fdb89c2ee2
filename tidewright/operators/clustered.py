"""Tables cut into files by ranges of their order, so that a page reads the few files that hold it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Clustered:
    """A table in a folder, sorted over its files by `order`: (column, descending) pairs that together tell rows apart.

    Nulls come first in either direction. Descending columns are numbers, dates or timestamps.
    """

    path: str
    order: tuple[tuple[str, bool], ...]

    def _place(self, schema: T.StructType, of: dict[str, Column]) -> Column:
        """Where a row stands, as one value that ascends."""
        return F.struct(*(_turned(of[c].cast(schema[c].dataType), schema[c].dataType, down).alias(f"k{i}") for i, (c, down) in enumerate(self.order)))

    def _row(self, schema: T.StructType) -> Column:
        return self._place(schema, {c: F.col(c) for c, _ in self.order})

    def write(self, rows: DataFrame, files: int) -> None:
        """Rows in about `files` files, then the bounds of each: lowest and highest place and number of rows.

        One shuffle by sampled ranges; the bounds read only the order's columns. Rows of equal places share a file.
        """
        place = self._row(rows.schema)
        rows.repartitionByRange(files, place).sortWithinPartitions(place).write.parquet(f"{self.path}/rows")
        written = rows.sparkSession.read.schema(rows.schema).parquet(f"{self.path}/rows").select("_metadata.file_name", place.alias("place"))
        bounds = written.groupBy("file_name").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count(F.lit(1)).alias("n"))
        bounds.coalesce(1).write.parquet(f"{self.path}/bounds")

    def page(self, spark: SparkSession, after: dict[str, object] | None = None, size: int = 50) -> DataFrame:
        """The rows after a place (from the start, if None), in order: a page and one row more.

        Bounds tell the files beforehand: every file holds a row at least, so no more than size + 1 of their bounds reach the
        driver, and only files up to the page's end are read. A place beyond the end, or an empty table, gives no rows.
        """
        schema = spark.read.parquet(f"{self.path}/rows").schema
        place, bounds = self._row(schema), spark.read.parquet(f"{self.path}/bounds")
        if after is not None:
            start = self._place(schema, {c: F.lit(after[c]) for c, _ in self.order})
            bounds = bounds.where(F.col("high") > start)
        found, chosen, sure = bounds.orderBy("low", "high", "file_name").limit(size + 2).collect(), [], 0
        for b in found:
            if sure > size:
                break
            # rows of the file that holds the place may stand before it
            sure += b.n if after is None or chosen else 0
            chosen.append(f"{self.path}/rows/{b.file_name}")
        if not chosen:
            return spark.createDataFrame([], schema)
        rows = spark.read.schema(schema).parquet(*chosen)
        return (rows if after is None else rows.where(place > start)).orderBy(place).limit(size + 1)


def _turned(value: Column, kind: T.DataType, down: bool) -> Column:
    """value, or a value that falls where it rises."""
    if not down:
        return value
    if isinstance(kind, T.DateType):
        return F.bitwise_not(F.unix_date(value))
    if isinstance(kind, T.TimestampType):
        return F.bitwise_not(F.unix_micros(value))
    if isinstance(kind, T.TimestampNTZType):
        return F.bitwise_not(F.unix_micros(value.cast("timestamp")))
    if isinstance(kind, T.IntegralType):
        return F.bitwise_not(value)
    if isinstance(kind, (T.DecimalType, T.FractionalType)):
        return -value
    raise ValueError(f"no descending order for {kind.simpleString()}")
