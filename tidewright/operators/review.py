"""Read queries over curated and processing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_and_history(ratings: DataFrame, keys: list[str], dated: str, recorded: str, current: Column) -> DataFrame:
    """is_current: the latest dated (undated last), then latest recorded CURRENT row per key; history_rank orders the rest."""
    order = [F.desc_nulls_last(dated), F.desc(recorded)]
    pick = F.row_number().over(Window.partitionBy(*keys, current).orderBy(*order))
    out = ratings.withColumn("is_current", current & (pick == 1))
    return out.withColumn("history_rank", F.when(~F.col("is_current"), F.row_number().over(Window.partitionBy(keys[0], "is_current").orderBy(*order))))


def final_run(runs: DataFrame, job: str, attempt: str) -> DataFrame:
    """The run of the highest attempt per job."""
    last = F.max(attempt).over(Window.partitionBy(job))
    return runs.withColumn("_last", last).where(F.col(attempt) == F.col("_last")).drop("_last")


def group_heads(events: DataFrame, group: list[str], order: str, due: Column) -> DataFrame:
    """Pending events that are the oldest of their group, then due; heads are found before the due filter."""
    heads = events.withColumn("_low", F.min(order).over(Window.partitionBy(*group)))
    return heads.where(F.col(order) == F.col("_low")).where(due).drop("_low")


def keyset_page(df: DataFrame, order: list[Column], after: Column | None, size: int = 50) -> DataFrame:
    """A page and one row more, by the sort key rather than an offset."""
    return (df if after is None else df.where(after)).orderBy(*order).limit(size + 1)


def has_any(df: DataFrame, facts: dict[str, DataFrame], key: str) -> DataFrame:
    """A flag per fact table: whether it holds the key."""
    for name, fact in facts.items():
        known = fact.select(key).distinct().withColumn(name, F.lit(True))
        df = df.join(known, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return df


def error_count(stored: Column, found: Column, failure: Column) -> Column:
    """The larger count, and one more if the run itself failed."""
    return F.greatest(stored, found) + F.when(failure.isNotNull(), 1).otherwise(0)


def backoff_seconds(attempts: Column) -> Column:
    """10 s, doubling, at most 5 minutes."""
    return F.least(F.lit(300), (F.lit(10) * F.pow(F.lit(2), F.least(attempts - 1, F.lit(5)))).cast("int")).cast("int")


def stuck(last_progress: Column, now: Column, final_attempt_started: Column) -> Column:
    """No progress for an hour, or the final attempt running for over 16 minutes."""
    return (last_progress < now - F.expr("interval 1 hour")) | (final_attempt_started < now - F.expr("interval 16 minutes"))


# The counts a finished job of a data set shows, in order.
AGREED_COUNTS = {
    "urn:bond-platform:dataset:bse-debt-trades": ("sourceRecords", "acceptedRows", "invalidRows", "supersededRows"),
    "urn:bond-platform:dataset:nsdl-security": ("filesListed", "filesProcessed", "filesSkipped", "scalarFieldsChanged", "collectionEntriesAppended", "fieldsRejected"),
}


def job_counts(dataset: Column, stored: Column) -> Column:
    """A finished job's agreed counts as JSON, absent ones null; null for a data set without agreed counts."""
    out = F.lit(None).cast("string")
    for name, counts in AGREED_COUNTS.items():
        read = F.from_json(stored, ", ".join(f"{c} bigint" for c in counts))
        shown = F.struct(*(read[c].alias(c) for c in counts))
        out = F.when(dataset == name, F.to_json(shown, {"ignoreNullFields": "false"})).otherwise(out)
    return out


def union_errors(failures: DataFrame, issues: DataFrame, jobs: DataFrame, key: str = "job") -> DataFrame:
    """A job's errors: the final run's failure at sequence 0, then the run's issues; issues of unknown jobs are left out."""
    return failures.unionByName(issues.join(jobs.select(key).distinct(), key, "left_semi"))


def first_pages(errors: DataFrame, key: str = "job", after: Column | None = None, size: int = 50, order: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """Every job's page and one row more, all jobs side by side; ranking stops at the page's end."""
    rows = errors if after is None else errors.where(after)
    spec = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(spec)).where(F.col("_n") <= size + 1).drop("_n")


def job_status(jobs: DataFrame, errors: DataFrame, stored_count: str, failure: Column, finished: Column, key: str = "job", shown: int = 5) -> DataFrame:
    """jobs with error_count, first_errors and has_more where finished; errors need only be grouped once.

    The codes of a job are kept up to `shown` + 1 in one pass: the smallest (sequence, code) pairs.
    """
    ranked = first_pages(errors, key, None, shown, ("sequence", "code"))
    first = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sequence", "code"))).alias("_first"))
    per = errors.groupBy(key).agg(F.count_if(F.col("sequence") > 0).alias("_n")).join(first, key)
    out = jobs.join(per, key, "left")
    number = error_count(F.col(stored_count), F.coalesce("_n", F.lit(0)), failure)
    codes = F.transform(F.slice("_first", 1, shown), lambda x: x["code"])
    more = F.coalesce(F.size("_first") > shown, F.lit(False))
    return out.select(
        *jobs.columns, F.when(finished, number).alias("error_count"), F.when(finished, F.coalesce(F.array_join(codes, ","), F.lit(""))).alias("first_errors"), F.when(finished, more).alias("has_more")
    )


def summaries(rows: DataFrame, dated: str, key: str, start: str | None = None, end: str | None = None, only: object | None = None) -> DataFrame:
    """Rows of an optional key within an optional range of dates (years 1900 to 9999, start not after end)."""
    for day in (start, end):
        if day is not None and not "1900-01-01" <= day <= "9999-12-31":
            raise ValueError(f"not a date from 1900 to 9999: {day}")
    if start is not None and end is not None and start > end:
        raise ValueError("the range ends before it begins")
    day = F.col(dated).cast("date")
    out = rows if only is None else rows.where(F.col(key) == only)
    out = out if start is None else out.where(day >= F.lit(start).cast("date"))
    return out if end is None else out.where(day <= F.lit(end).cast("date"))


def nested_view(entities: DataFrame, key: str, lists: dict[str, tuple[DataFrame, list[Column]]], limit: int | None = None) -> DataFrame:
    """entities with one sorted array per list table, of all its rows or `limit` a key; n_<list> tells of all.

    Each list is (rows with the key, sort columns). A view of a key is one row, so its lists must fit in one.
    """
    out = entities
    for name, (rows, order) in lists.items():
        values = [c for c in rows.columns if c != key]
        own = Window.partitionBy(key)
        ranked = rows.withColumns({"_n": F.row_number().over(own.orderBy(*order)), "_of": F.count(F.lit(1)).over(own)})
        kept = ranked if limit is None else ranked.where(F.col("_n") <= limit)
        kept = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", *values))).alias(name), F.max("_of").alias(f"n_{name}"))
        out = out.join(kept, key, "left")
        out = out.withColumn(name, F.transform(name, lambda x: F.struct(*(x[v].alias(v) for v in values)))).withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    return out


def sweep(jobs: DataFrame, is_stuck: Column, order: str, now: Column, limit: int = 100) -> DataFrame:
    """The oldest stuck jobs, at most `limit`, with the state they go to: FAILED; a run still running ends as abandoned."""
    running = F.col("run_state") == "RUNNING"
    return jobs.where(is_stuck).orderBy(order).limit(limit).select(
        *jobs.columns, F.lit("FAILED").alias("next_state"), F.when(running, "FAILED_TEMPORARY").otherwise(F.col("run_state")).alias("next_run_state"),
        F.when(running, "ATTEMPT_ABANDONED").alias("run_code"), now.alias("failed_at"),
    )


def retained(issues: DataFrame, records: DataFrame, events: DataFrame, now: Column, record_key: str = "record_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(issues, rejected records, events) that are kept: review rows for one calendar year from created_at, delivered events for 30 days.

    An issue goes with the record it belongs to (record_key, null for none). Requests are never deleted, undelivered
    events neither, however old. Deletion and reading are of one moment, `now`.
    """
    since = now - F.expr("interval 1 year")
    old = records.where(F.col("created_at") < since).select(record_key)
    kept = issues.where(~F.coalesce(F.col("created_at") < since, F.lit(False))).join(old, record_key, "left_anti")
    gone = (F.col("status") == "DELIVERED") & (F.col("delivered_at") < now - F.expr("interval 30 days"))
    return kept, records.where(~F.coalesce(F.col("created_at") < since, F.lit(False))), events.where(~F.coalesce(gone, F.lit(False)))


def delivered(events: DataFrame, ok: Column, error: Column, now: Column, limit: int = 1000) -> DataFrame:
    """Bookkeeping after a delivery attempt: status, attempts, next time and the error's first code points."""
    attempts = F.when(ok, F.col("attempts")).otherwise(F.col("attempts") + 1)
    wait = F.make_interval(secs=backoff_seconds(F.col("attempts") + 1).cast("decimal(18,6)"))
    return events.withColumns({
        "status": F.when(ok, "DELIVERED").otherwise("PENDING"), "attempts": attempts, "next_attempt_at": F.when(~ok, now + wait),
        "last_error": F.when(~ok, F.substring(error, 1, limit)),
    })


def audit(rows: DataFrame, checks: dict[str, Column], keys: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """(rule, violations): rows that break a check (unknown is no violation), and rows whose key another table lacks."""
    one = rows.agg(*(F.count_if(~c).alias(k) for k, c in checks.items())).select(F.posexplode(F.array(*(F.col(k) for k in checks))).alias("i", "violations"))
    out = one.select(F.element_at(F.array(*map(F.lit, checks)), F.col("i") + 1).alias("rule"), "violations")
    for rule, (key, known) in keys.items():
        lost = rows.where(F.col(key).isNotNull()).join(known, key, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
        out = out.unionByName(lost.select(F.lit(rule).alias("rule"), "violations"))
    return out
