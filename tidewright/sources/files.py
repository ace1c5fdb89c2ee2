"""Scans: manifests, verified files, delimited records, JSON documents, file names."""

from __future__ import annotations

import csv
import io
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.functions.json_values import strict_document
from tidewright.functions.rules import base_name, strip
from tidewright.plans.contracts import SourceContract

FILE = "struct<bucket:string,key:string,format:string,sha256:string,size_bytes:bigint,job_id:string,source_url:string>"
MANIFEST = (
    "specversion string, id string, source string, type string, dataschema string, subject string, data struct<schema_version:string,event_type:string,"
    f"event_id:string,run_id:string,inputs:map<string,string>,dataset_fingerprint:string,files:array<{FILE}>>"
)
# What a manifest must say of itself.
CONSTANTS = {"specversion": "1.0", "source": "urn:bond-platform:service:data-fetch-service", "type": "com.bondplatform.dataset.manifest.v1"}
AGREED = ("dataschema", "subject", "event_type", "event_id", "run_id", "inputs", "dataset_fingerprint")
#: Listed rows that one task compares.
ROWS_A_TASK = 200_000
_RECORDS = "path string, record_number int, cells array<string>, error string"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: spark.checkpoint.dir; a temporary one only in local mode without a setting."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df without its lineage, kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, where a checkpoint computes its rows to count them and again to write them."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(spark: SparkSession) -> int:
    """Partitions of a shuffle of this session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests with every problem listed: required text, constants, digests, sizes, texts of inputs, duplicate objects."""
    raw = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("manifest"), F.from_json("value", MANIFEST).alias("m"))
    out = raw.select("manifest", "m.*")
    required = ["specversion", "id", "source", "type", "dataschema", "subject", "data.event_type", "data.event_id", "data.run_id", "data.dataset_fingerprint"]
    found = [F.when(F.coalesce(strip(F.col(c)), F.lit("")) == "", F.lit(f"{c} is required")) for c in required]
    found += [F.when(F.col(c) != v, F.lit(f"{c} must be {v}")) for c, v in CONSTANTS.items()]
    found += [
        F.when(~F.coalesce(F.col("data.schema_version").try_cast("decimal(38,10)") == 1, F.lit(False)), "data.schema_version must be 1"),
        F.when(F.col("data.inputs").isNull(), "data.inputs is required"),
        F.when(F.exists(F.map_values("data.inputs"), lambda v: v.isNull()), "data.inputs must be texts"),
        F.when(F.exists("data.files", lambda f: (F.coalesce(strip(f["bucket"]), F.lit("")) == "") | (F.coalesce(strip(f["key"]), F.lit("")) == "")), "files need a bucket and a key"),
    ]
    bad_digest = F.exists("data.files", lambda f: ~F.coalesce(f["sha256"].rlike("^(sha256:)?[0-9a-fA-F]{64}$"), F.lit(False)))
    bad_size = F.exists("data.files", lambda f: ~F.coalesce(f["size_bytes"] > 0, F.lit(False)))
    places = F.transform("data.files", lambda f: F.concat_ws("/", f["bucket"], f["key"]))
    found += [
        F.when(F.coalesce(F.size("data.files"), F.lit(0)) <= 0, "data.files is empty"),
        F.when(bad_digest, "files hold an invalid sha256"),
        F.when(bad_size, "files hold an invalid size"),
        F.when(F.size(F.array_distinct(places)) < F.size(places), "files list an object twice"),
    ]
    return out.withColumn("problems", F.array_compact(F.array(*found)))


def listed_files(manifests: DataFrame) -> DataFrame:
    return manifests.select("manifest", "data.run_id", "data.inputs", F.posexplode("data.files").alias("place", "file")).select(
        "manifest", "run_id", "inputs", "place", "file.*"
    )


def file_set_problems(files: DataFrame, group: str, format_: str = "CSV", limit: int = 10_485_760) -> DataFrame:
    """Per manifest: wrong format, more than one CSV, total size over the limit."""
    g = files.groupBy(group).agg(F.sum("size_bytes").alias("total"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("format") != format_).alias("other"))
    checks = [
        F.when(F.col("other") > 0, "INVALID_MANIFEST"),
        F.when((F.lit(format_) == "CSV") & (F.col("n") != 1), "INVALID_MANIFEST"),
        F.when(F.col("total") > limit, "SOURCE_TOO_LARGE"),
    ]
    return g.withColumn("problems", F.array_distinct(F.array_compact(F.array(*checks))))


def disagreements(manifests: DataFrame, submitted: DataFrame, key: str = "run") -> DataFrame:
    """(key, differs): the agreed attributes in which a manifest and the submission of its key differ, in order; nulls agree with nulls.

    Both have the columns AGREED (inputs as a map of texts); inputs are compared whatever their order.
    """
    m, s = manifests.alias("m"), submitted.alias("s")
    sorted_map = lambda c: F.array_sort(F.map_entries(c))
    side = lambda a, n: sorted_map(F.col(f"{a}.{n}")) if n == "inputs" else F.col(f"{a}.{n}")
    names = [F.when(~side("m", n).eqNullSafe(side("s", n)), n if n in ("dataschema", "subject") else f"data.{n}") for n in AGREED]
    return m.join(s, key).select(key, F.array_compact(F.array(*names)).alias("differs"))


def json_name_problems(listed: DataFrame, group: str = "manifest") -> DataFrame:
    """(group, problem): INVALID_SOURCE_FILENAME where a listed name holds no ISIN, several are named, or not the one asked for."""
    isin = json_name(base_name(F.col("key")))
    wanted = F.upper(strip(F.coalesce(F.col("inputs")["isin_code"], F.lit(""))))
    out = listed.groupBy(group).agg(F.bool_or(isin.isNull()).alias("nameless"), F.min(isin).alias("low"), F.max(isin).alias("high"), F.first(wanted).alias("wanted"))
    wrong = F.col("nameless") | (F.col("low") != F.col("high")) | (F.col("low") != F.col("wanted"))
    return out.select(group, F.when(wrong, "INVALID_SOURCE_FILENAME").alias("problem"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length", "content")


def verify(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Every listed object with its file: problem is SOURCE_NOT_FOUND where there is none, CHECKSUM_MISMATCH where size or digest differ.

    Files meet their listing by bucket and key, the end of their path. One manifest lists an object once; an object
    that several runs list is verified for each. Files that nobody lists are left out.
    """
    names = F.split(F.col("path"), "/")
    want = listed.select(F.concat_ws("/", "bucket", "key").alias("object"), F.lower(F.regexp_replace("sha256", "^sha256:", "")).alias("sha256"), "size_bytes", "run_id")
    want = want.withColumn("parts", F.size(F.split("object", "/")))
    lengths = [r.parts for r in want.select("parts").distinct().collect()]  # how deep keys go: a few numbers
    have = files.withColumn("object", F.explode(F.array_distinct(F.array(*(F.array_join(F.slice(names, -n, n), "/") for n in lengths or [1])))))
    same = (F.col("length") == F.col("size_bytes")) & (F.sha2("content", 256) == F.col("sha256"))
    out = want.drop("parts").join(have, "object", "left")
    return out.withColumn("problem", F.when(F.col("path").isNull(), "SOURCE_NOT_FOUND").when(~same, "CHECKSUM_MISMATCH"))


def record_once(stored: DataFrame, listed: DataFrame, key: tuple[str, ...] = ("request", "bucket", "object_key")) -> DataFrame:
    """Listed files that are not recorded yet, each (request, bucket, object) once; another request may record the same object.

    Both sides are dealt out by key to tasks of about ROWS_A_TASK listed rows, as many tasks as that takes.
    """
    n = max(shuffled(listed.sparkSession), -(-listed.count() // ROWS_A_TASK))
    once = listed.repartition(n, *key).dropDuplicates([*key])
    return once.join(stored.select(*key).repartition(n, *key), [*key], "left_anti")


def _csv_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Structural read of whole files; a broken file gives one error row and no records."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows, error = [], None
            try:
                text = bytes(content).decode("utf-8").removeprefix("\ufeff")
                if "\0" in text:
                    raise csv.Error("NUL")
                width = None
                for cells in csv.reader(io.StringIO(text, newline=""), strict=True):
                    if len(cells) == 0 or (len(cells) == 1 and not cells[0].strip()):
                        continue
                    width = width or len(cells)
                    if len(cells) != width:
                        raise csv.Error("cell count")
                    rows.append((path, len(rows) + 1, cells, None))
                error = None if rows else "EMPTY_FILE"
            except (csv.Error, UnicodeDecodeError):
                error = "MALFORMED_CSV"
            if error:
                rows = [(path, 0, None, error)]
            yield pd.DataFrame(rows, columns=["path", "record_number", "cells", "error"])


def csv_records(files: DataFrame) -> DataFrame:
    """(path, record_number from header = 1, cells, error): one task reads a file of at most 10 MiB whole."""
    return files.select("path", "content").mapInPandas(_csv_records, _RECORDS)


def resolve_headers(records: DataFrame, contract: SourceContract) -> tuple[DataFrame, DataFrame]:
    """(typed-by-name records, file errors): any column order, extra columns allowed, names matched stripped in lower case."""
    errors = records.where(F.col("error").isNotNull()).select("path", "error")
    names = F.transform("cells", lambda c: F.lower(strip(c)))
    heads = records.where("record_number = 1").select("path", names.alias("names"))
    wanted = F.array(*(F.lit(f.header.lower()) for f in contract.fields))
    state = heads.select(
        "path", "names",
        F.when(F.size(F.array_distinct("names")) < F.size("names"), "DUPLICATE_HEADER")
        .when(F.size(F.array_except(wanted, F.col("names"))) > 0, "REQUIRED_HEADER_MISSING").alias("error"),
    )
    errors = errors.unionByName(state.where(F.col("error").isNotNull()).select("path", "error"))
    good = records.where("record_number > 1").join(state.where(F.col("error").isNull()).select("path", "names"), "path")
    cells = [F.element_at("cells", F.array_position("names", f.header.lower()).cast("int")).alias(f.name) for f in contract.fields]
    return good.select("path", "record_number", *cells), errors


def json_documents(files: DataFrame) -> DataFrame:
    """(path, modificationTime, document variant, error): strict UTF-8 and strict JSON, else MALFORMED_JSON; numerals are kept as written.

    A file that its listing disowns (column problem, where there is one) is not read: the problem is its error.
    Files are dealt out before they are read: small ones, or rows of one small table, would all come to a task or two.
    """
    files = files.repartition(shuffled(files.sparkSession), "path")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    known = F.col("problem") if "problem" in files.columns else F.lit(None).cast("string")
    out = files.select("path", "modificationTime", F.when(known.isNull(), strict_document(text, True)).alias("document"), known.alias("_known"))
    return out.withColumn("error", F.coalesce("_known", F.when(F.col("document").isNull(), "MALFORMED_JSON"))).drop("_known")


def csv_name(name: Column) -> tuple[Column, Column]:
    """(exchange, trade date) of {exchange}_...{DDMMYYYY}.csv, both or neither: any text before the first underscore, a day of the calendar in the last eight digits."""
    pattern = r"(?s)^([^_]*)_.*?([0-9]{8})(?i:\.csv)$"
    digits = F.nullif(F.regexp_extract(name, pattern, 2), F.lit(""))
    exchange, day = F.upper(F.nullif(strip(F.regexp_extract(name, pattern, 1)), F.lit(""))), F.try_to_date(digits, "ddMMyyyy")
    return F.when(day.isNotNull(), exchange), F.when(exchange.isNotNull(), day)


def csv_name_problems(listed: DataFrame, group: str = "manifest") -> DataFrame:
    """(group, problem) of every listed CSV file: INVALID_SOURCE_FILENAME where its name holds no exchange or no day, TRADE_DATE_MISMATCH where either is not the inputs'."""
    exchange, day = csv_name(base_name(F.col("key")))
    wanted = F.upper(strip(F.coalesce(F.col("inputs")["exchangeName"], F.lit(""))))
    asked = F.col("inputs")["tradeDate"]
    same = (exchange == wanted) & F.coalesce(F.date_format(day, "yyyy-MM-dd") == asked, F.lit(False))
    return listed.select(group, F.when(exchange.isNull() | day.isNull(), "INVALID_SOURCE_FILENAME").when(~same, "TRADE_DATE_MISMATCH").alias("problem"))


def submission_problems(manifests: DataFrame, submitted: DataFrame) -> DataFrame:
    """(manifest, problem): INVALID_MANIFEST where a manifest's attributes are not those of its run's submission, or nobody submitted the run.

    `submitted` has run (the run's id) and the columns AGREED. A manifest is named with the attributes that differ.
    """
    said = manifests.select("manifest", "dataschema", "subject", *(F.col(f"data.{n}").alias(n) for n in AGREED if n not in ("dataschema", "subject")))
    runs = said.withColumn("run", F.col("run_id"))
    differ = disagreements(runs.withColumnRenamed("manifest", "_manifest"), submitted, "run").where(F.size("differs") > 0)
    told = runs.select("manifest", "run").join(differ, "run").select("manifest", F.concat(F.lit("INVALID_MANIFEST: "), F.array_join("differs", ", ")).alias("problem"))
    unknown = runs.join(submitted.select("run"), "run", "left_anti").select("manifest", F.lit("INVALID_MANIFEST: no submission").alias("problem"))
    return told.unionByName(unknown)


def json_name(name: Column) -> Column:
    """The ISIN before the first underscore of a *.json name."""
    return F.upper(F.nullif(strip(F.regexp_extract(name, r"(?i)^([^_]+)_.*\.json$", 1)), F.lit("")))
