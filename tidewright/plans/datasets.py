"""One pipeline per data set: files in, curated snapshots and review rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import csv_stage, merge, snapshots
from tidewright.plans import securities
from tidewright.plans.contracts import DAILY_COUPON, DAILY_CSV, DAILY_SUMMARY, MappingContract, SourceContract
from tidewright.sources import files as sources


def run_csv(files: DataFrame, source: SourceContract = DAILY_CSV, summary: MappingContract = DAILY_SUMMARY) -> dict[str, DataFrame]:
    """canonical, summaries, coupons, issues, counts and rejected files of many files at once."""
    named, errors = sources.resolve_headers(sources.csv_records(files), source)
    rows = csv_stage.validate_rows(named, source)
    canonical = csv_stage.dispositions(rows, "path", F.col(f"{source.duplicate_key}.parsed"))
    coupons = csv_stage.project(canonical, DAILY_COUPON, "path").where(F.col("coupon_rate_value").isNotNull())
    return {
        "canonical": canonical,
        "summaries": csv_stage.project(canonical, summary, "path", "record_number"),
        "coupons": coupons,
        "issues": csv_stage.issues(canonical, source, "path"),
        "counts": csv_stage.counts(canonical, "path"),
        "rejected_records": rejected_records(canonical, source),
        "rejected_files": errors,
    }


def run_dataset(spark: SparkSession, root: str, manifests: str, source: SourceContract | None = DAILY_CSV, summary: MappingContract = DAILY_SUMMARY,
                submitted: DataFrame | None = None) -> dict[str, DataFrame]:
    """All files that the manifests list under root, through the pipeline of their data set: a source contract's, or the JSON one (None).

    Manifests with problems, file sets that break the format's limits and JSON names of other securities are
    left out and listed in `rejected_manifests`, and so are those that list an object which is not there; files whose
    bytes differ from their listing are in `unverified`, and a JSON one is a skipped file of its security besides.
    With `submitted` (run and the agreed attributes) a manifest must say what its run's submission said, and the
    name of a CSV file must agree with the inputs, which admission has validated.
    """
    read = sources.read_manifests(spark, manifests)
    listed = sources.listed_files(read.where(F.size("problems") == 0))
    bad = read.where(F.size("problems") > 0).select("manifest", F.array_join("problems", "; ").alias("problem"))
    sets = sources.file_set_problems(listed, "manifest", "JSON" if source is None else "CSV", 10_485_760 if source is None else source.max_bytes)
    bad = bad.unionByName(sets.where(F.size("problems") > 0).select("manifest", F.array_join("problems", "; ").alias("problem")))
    if source is None:
        bad = bad.unionByName(sources.json_name_problems(listed).where(F.col("problem").isNotNull()))
    if submitted is not None:
        bad = bad.unionByName(sources.submission_problems(read.where(F.size("problems") == 0), submitted))
        if source is not None:
            named = sources.csv_name_problems(listed).where(F.col("problem").isNotNull())
            bad = bad.unionByName(named.join(bad.select("manifest"), "manifest", "left_anti").distinct())
    listed = listed.join(bad.select("manifest").distinct(), "manifest", "left_anti")
    checked = sources.verify(sources.read_bytes(spark, root), listed)
    lost = checked.where(F.col("problem") == "SOURCE_NOT_FOUND").select("run_id").distinct()
    bad = bad.unionByName(listed.join(lost, "run_id", "left_semi").select("manifest").distinct().withColumn("problem", F.lit("SOURCE_NOT_FOUND")))
    there = checked.join(lost, "run_id", "left_anti")
    # a file that several runs list is read once, for the first of them
    good = merge.latest(there.where(F.col("problem").isNull()) if source is not None else there, ["path"], F.col("problem").asc_nulls_first(), F.col("run_id"))
    out = securities.run_json(good) if source is None else run_csv(good, source, summary)
    return out | {"rejected_manifests": bad, "unverified": checked.where(F.col("problem").isNotNull()).select("object", "path", "run_id", "problem")}


def rejected_records(canonical: DataFrame, source: SourceContract = DAILY_CSV) -> DataFrame:
    """Quarantined rows with their raw values as JSON; accepted rows with ignored fields are issues only."""
    fields = [f.name for f in source.fields]
    raw = F.to_json(F.struct(*(F.col(f"{f}.raw").alias(f) for f in fields)), {"ignoreNullFields": "false"})
    return canonical.where("disposition <> 'ACCEPTED'").select("path", "record_number", "disposition", "superseded_by", raw.alias("record"))


def evidence(canonical: DataFrame) -> DataFrame:
    """One JSON line per canonical row, nulls written out."""
    return canonical.select("path", F.to_json(F.struct(*canonical.columns), {"ignoreNullFields": "false"}).alias("value"))


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], base: int | None = None) -> int:
    """All tables of a batch or none, as commit `snapshots.commit` makes it; its number. A batch that another writer overtook is refused."""
    return snapshots.commit(spark, root, tables, base)


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The newest published snapshot that holds the table."""
    return snapshots.read(spark, root, name)


def repair(df: DataFrame, **fixes: Column) -> DataFrame:
    """A one-off backfill as a snapshot rewrite."""
    return df.withColumns(fixes)
