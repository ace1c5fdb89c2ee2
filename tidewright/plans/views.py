"""Read views over the curated and processing tables, for all keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators import review
from tidewright.plans import securities

TERMINAL = ("COMPLETED", "COMPLETED_WITH_ERRORS", "FAILED")  # Fixed values: states in which a job shows its errors.


def ratings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, history) of rating rows (isin, id, source_category, rating_agency_name, rating_date, first_recorded_at, ...).

    Current is one CURRENT row an agency, a missing agency being one too: the latest dated, then the latest recorded,
    undated last. All other rows are history, newest first.
    """
    newest = [F.desc_nulls_last("rating_date"), F.desc("first_recorded_at"), F.col("id")]
    told = F.col("source_category") == "CURRENT"
    pick = F.row_number().over(Window.partitionBy("isin", "rating_agency_name", told).orderBy(*newest))
    split = rows.withColumn("_current", told & (pick == 1))
    return split.where("_current").drop("_current"), split.where(~F.coalesce("_current", F.lit(False))).drop("_current")


def security_view(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a security: its scalars, and arrays assets, current_ratings, rating_history, listings and cash_flows, each whole and sorted.

    tables: security, collateral_asset, rating, listing, cash_flow, with id and first_recorded_at in the latter four. An
    Unsecured security shows no assets. Undated listings and cash flows come last.
    """
    recorded = [F.col("first_recorded_at"), F.col("id")]
    security = tables["security"]
    secured = security.where(~F.coalesce(securities.unsecured(F.lit("collateral_status"), F.col("collateral_status")), F.lit(False))).select("isin")
    current, history = ratings(tables["rating"])
    newest = [F.desc_nulls_last("rating_date"), F.desc("first_recorded_at"), F.col("id")]
    return review.nested_view(security, "isin", {
        "assets": (tables["collateral_asset"].join(secured, "isin", "left_semi"), recorded),
        "current_ratings": (current, [F.col("rating_agency_name").asc_nulls_last()]),
        "rating_history": (history, newest),
        "listings": (tables["listing"], [F.col("listing_date").asc_nulls_last(), *recorded]),
        "cash_flows": (tables["cash_flow"], [F.col("due_date").asc_nulls_last(), *recorded]),
    })


def job_errors(jobs: DataFrame, runs: DataFrame, issues: DataFrame, files: DataFrame, isin: Column | None = None, after: Column | None = None, size: int = 50) -> DataFrame:
    """A page of errors (and one row more) of every finished job: its final run's own failure at sequence 0, then that run's issues.

    jobs (job, status), runs (run_id, job, attempt, failure_code, failure_detail), issues (run_id, sequence, code, isin,
    source_file, message), files (job, file_name). A failure names the file if the job has exactly one, and belongs to
    no security, so a filter by isin leaves it out. `after` compares with the sequence of the page before.
    """
    final = review.final_run(runs, "job", "attempt").join(jobs.where(F.col("status").isin(*TERMINAL)).select("job"), "job", "left_semi")
    single = files.groupBy("job").agg(F.when(F.count(F.lit(1)) == 1, F.min("file_name")).alias("source_file"))
    failed = final.where("failure_code is not null").join(single, "job", "left").select(
        "job", F.lit(0).cast("long").alias("sequence"), F.col("failure_code").alias("code"), F.lit(None).cast("string").alias("isin"), "source_file",
        F.coalesce("failure_detail", "failure_code").alias("message"),
    )
    told = issues.join(final.select("run_id", "job"), "run_id").select("job", F.col("sequence").cast("long").alias("sequence"), "code", "isin", "source_file", "message")
    rows = failed.unionByName(told)
    rows = rows if isin is None else rows.where(F.col("isin") == isin)
    return review.first_pages(rows, "job", None if after is None else F.col("sequence") > after, size)
