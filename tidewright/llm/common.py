"""Shared helpers: the cluster's shared folder, shipped code, parquet cut points, partition counts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED = "tidewright.llm.shipped"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach; a temporary one only in local mode, where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def clear() -> None:
    """Delete the cut points written so far; call it when the results that read them have been used."""
    while _WRITTEN:
        files, path = fs.FileSystem.from_uri(_WRITTEN.pop())
        files.delete_dir(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application (they may not have it installed)."""
    context = spark.sparkContext
    if getattr(context, "_tidewright_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "tidewright_ship.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, str(Path(top.name) / file.relative_to(top)))
    context.addPyFile(target)
    context._tidewright_shipped = True


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Rows per Arrow batch: long texts make large batches, so the text operators lower it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def parts(spark: SparkSession) -> int:
    """Partitions for a keyed shuffle of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string), null texts read as empty; every other column is left behind."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(),
    "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()),
}


def map_rows(df: DataFrame, schema: str, rows: Callable[[Iterator[list[tuple]]], Iterator[list[tuple]]]) -> DataFrame:
    """Arrow batches in and out as lists of plain tuples: nulls stay None and long integers stay exact.

    `rows` is called once per task with an iterator over batches and yields lists of output tuples.
    """
    fields = [(name, _ARROW[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = (list(zip(*(c.to_pylist() for c in batch.columns), strict=True)) for batch in batches)
        for out in rows(plain):
            columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields]
            )

    return df.mapInArrow(run, schema)
