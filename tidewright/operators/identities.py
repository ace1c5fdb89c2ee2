"""An index of the identities a table holds, kept beside it, so that a batch reads only its own buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.merge import latest, unused
from tidewright.sources.files import cut

BUCKET, NAME = "_bucket", "_name"


@dataclass(frozen=True)
class IdentityIndex:
    """Identities of a table as 32-byte names in folders of buckets.

    `columns` gives the identity's columns and their types in the table; nulls are values, texts of any length count
    whole. Rows of one `group` (one of the columns) share a bucket, so a batch about few groups reads few buckets. `buckets`
    is fixed for the life of an index. Further columns of a batch do not matter.
    """

    path: str
    columns: dict[str, str]
    group: str
    buckets: int = 1024

    def _named(self, rows: DataFrame, own: str = "") -> DataFrame:
        """rows with their bucket and name, under names that begin with `own`."""
        typed = {c: F.col(c).cast(kind).cast("string") for c, kind in self.columns.items()}
        parts = (F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in typed.values())
        bucket = F.pmod(F.xxhash64(typed[self.group]), F.lit(self.buckets)).cast("int")
        return rows.withColumns({own + BUCKET: bucket, own + NAME: F.unhex(F.sha2(F.concat_ws(",", *parts), 256))})

    def add(self, rows: DataFrame) -> None:
        """Name the rows in the index; rows that are there already do no harm, so a batch may be added again after a crash.

        Files are cut by ranges of (bucket, name): a bucket that holds most of all rows is written by many tasks.
        """
        named = self._named(rows.select(*self.columns)).select(BUCKET, NAME)
        named.repartitionByRange(BUCKET, NAME).sortWithinPartitions(BUCKET, NAME).write.mode("append").partitionBy(BUCKET).parquet(self.path)

    def names(self, batch: DataFrame) -> DataFrame:
        """The part of the index that can hold the batch's identities: its buckets, at most `buckets` numbers, prune the scan."""
        wanted = [r[0] for r in batch.select(BUCKET).distinct().collect()]
        stored = batch.sparkSession.read.schema(f"{NAME} binary, {BUCKET} int").parquet(self.path)
        return stored.where(F.col(BUCKET).isin(wanted))

    def unseen(self, batch: DataFrame, order: list[Column]) -> DataFrame:
        """Rows of the batch whose identity the index lacks, the first by `order` of each; `order` should leave no ties.

        The batch is written once, without repeats; the index is not moved while Spark can broadcast the batch's names, and meets
        them by (bucket, name) in a shuffle beyond that. An index nothing was added to must be made by `add` of no rows.
        """
        columns, own = batch.columns, unused(batch)
        first = cut(latest(self._named(batch, own), [own + BUCKET, own + NAME], *order))
        named = first.select(F.col(own + BUCKET).alias(BUCKET), F.col(own + NAME).alias(NAME))
        hits = self.names(named).join(named, [BUCKET, NAME], "left_semi").select(F.col(BUCKET).alias(own + BUCKET), F.col(NAME).alias(own + NAME))
        return first.join(hits, [own + BUCKET, own + NAME], "left_anti").select(*columns)
