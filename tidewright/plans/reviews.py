"""Registered queries over the JSON path and the read views, with SQL written from the rules themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.plans import securities, views
from tidewright.plans.queries import query, t

_K = "c_custkey"
_FILE = (
    f"concat('{{\"issuerName\":', CASE WHEN {_K} % 7 = 0 THEN '5.50' WHEN {_K} % 7 = 1 THEN '\"-\"' ELSE concat('\"N', CAST(c_nationkey AS STRING), '\"') END, "
    f"',\"instrumentsVo\":{{\"instruments\":{{\"totalIssueSize\":1234567890123456789012345678901234567', CAST({_K} % 1000 AS STRING), '.50}},\"assetCover\":{{\"securedFlag\":\"', CASE WHEN {_K} % 5 = 0 THEN 'UnSecured' ELSE 'Secured' END, "
    f"'\",\"assetCvrPercent\":', CASE {_K} % 3 WHEN 0 THEN '\"bad%\"' WHEN 1 THEN '99.50' ELSE 'null' END, ',\"assetList\":[{{\"assetType\":\"land\"}}', "
    f"CASE WHEN {_K} % 4 = 0 THEN ',{{\"assetType\":7,\"remarks\":\"r\"}},{{\"assetType\":7.0}}' ELSE '' END, ']}}}},\"coupensVo\":', CASE WHEN {_K} % 11 = 0 THEN '\"x\"' ELSE '{{}}' END, CASE WHEN {_K} % 13 = 0 THEN '}} x' ELSE '}}' END)"
)


def _files(spark, sf):
    """One JSON file about each customer, as a scan of files gives it."""
    path = F.concat(F.lit("b/C"), F.col(_K).cast("string"), F.lit("_details.json"))
    return t(spark, sf, "customer").select(path.alias("path"), F.lit("2026-01-01").cast("timestamp").alias("modificationTime"), F.expr(_FILE).cast("binary").alias("content"))


_COVER = "$.instrumentsVo.assetCover."
_PARTS = [  # condition, kind, path, field, code, value, action
    ("k % 13 = 0", "FILE_SKIPPED", "$", None, "MALFORMED_JSON", None, None),
    ("k % 11 = 0", "SECTION_REJECTED", "$.coupensVo", None, "INVALID_TYPE", None, None),
    ("k % 7 = 0", "FIELD_REJECTED", "$.issuerName", "issuer_name", "INVALID_TYPE", "5.50", None),
    ("k % 3 = 0", "FIELD_REJECTED", f"{_COVER}assetCvrPercent", "asset_coverage", "INVALID_DECIMAL", '"bad%"', None),
    ("k % 4 = 0", "ENTRY_FIELDS_REJECTED", f"{_COVER}assetList[1].assetType", "asset_type", "INVALID_TYPE", "7", None),
    ("k % 4 = 0", "ENTRY_SKIPPED", f"{_COVER}assetList[2].assetType", "asset_type", "INVALID_TYPE", "7.0", None),
    ("k % 5 = 0 AND k % 3 = 1", "VALUE_IGNORED", f"{_COVER}assetCvrPercent", None, "CONFLICTING_COLLATERAL_DATA", "99.50", "Ignored the supplied coverage."),
    ("k % 5 = 0", "VALUE_IGNORED", f"{_COVER}assetList[0]", None, "CONFLICTING_COLLATERAL_DATA", '{"asset_type":"land"}', "Did not record the supplied asset."),
    ("k % 5 = 0 AND k % 4 = 0", "VALUE_IGNORED", f"{_COVER}assetList[1]", None, "CONFLICTING_COLLATERAL_DATA", '{"remarks":"r"}', "Did not record the supplied asset."),
]


def _sql_parts() -> str:
    text = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    read = lambda when, kind: when if kind == "FILE_SKIPPED" else f"k % 13 <> 0 AND {when}"
    rows = (
        f"{{'r': {i}, 'hit': {read(when, kind)}, 'kind': '{kind}', 'json_path': {text(path)}, 'field': {text(field)}, 'code': '{code}', 'value': {text(value)}, 'action': {text(action)}}}"
        for i, (when, kind, path, field, code, value, action) in enumerate(_PARTS)
    )
    return f"SELECT concat('C', CAST(k AS STRING)) AS isin, * FROM (SELECT k, unnest([{', '.join(rows)}], recursive := true) FROM (SELECT c_custkey AS k FROM customer)) WHERE hit"


@query(f"SELECT isin, row_number() OVER (PARTITION BY isin ORDER BY r) AS sequence, kind, json_path, field, code, value, action FROM ({_sql_parts()})")
def json_issues(spark, sf):
    return securities.run_json(_files(spark, sf))["issues"].select("isin", "sequence", "kind", "json_path", "field", "code", "value", "action")


@query(
    f"""SELECT concat('C', CAST(c_custkey AS STRING)) AS isin, CASE WHEN c_custkey % 13 = 0 THEN 'FAILED' WHEN n IS NULL THEN 'COMPLETED' ELSE 'COMPLETED_WITH_ERRORS' END AS status, coalesce(n, 0) AS errors,
    concat('{{"filesListed":1,"filesProcessed":', CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE 1 END, ',"filesSkipped":', CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END, ',"scalarFieldsChanged":', CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE
    2 + CAST(c_custkey % 7 > 1 AS INTEGER) + CAST(c_custkey % 3 = 1 AND c_custkey % 5 <> 0 AS INTEGER) END, ',"collectionEntriesAppended":', CASE WHEN c_custkey % 13 = 0 OR c_custkey % 5 = 0 THEN 0 ELSE 1 + CAST(c_custkey % 4 = 0 AS INTEGER) END, ',"fieldsRejected":',
    CASE WHEN c_custkey % 13 = 0 THEN 0 ELSE CAST(c_custkey % 7 = 0 AS INTEGER) + CAST(c_custkey % 3 = 0 AS INTEGER) + 2 * CAST(c_custkey % 4 = 0 AS INTEGER) + 2 * CAST(c_custkey % 11 = 0 AS INTEGER) END, '}}') AS counts
    FROM customer LEFT JOIN (SELECT k, count(*) AS n FROM ({_sql_parts()}) GROUP BY k) ON k = c_custkey"""
)
def json_outcomes(spark, sf):
    """Every security new: status, errors and the six counts of its job."""
    out = securities.run_json(_files(spark, sf))
    stored = out["security"].limit(0).withColumn("updated_at", F.lit(None).cast("string"))
    changed = securities.apply_changes(stored, out["security"], out["cleared"], F.lit("t1"))
    names = ("cash_flow", "listing", "rating", "collateral_asset")
    _, appended = securities.append_entries({n: out[n].limit(0) for n in names}, {n: out[n] for n in names})
    return securities.outcomes(out["jobs"], changed, appended)


_ORDERED = (
    "SELECT o_custkey AS isin, o_orderkey AS id, o_orderkey % 5 AS kind, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS day, (o_orderkey - o_orderkey % 3) AS seen, "
    "CASE WHEN o_orderkey % 9 <> 0 THEN substring(o_orderpriority, 1, 1) END AS agency, CASE WHEN o_orderstatus = 'F' THEN 'EARLIER' ELSE 'CURRENT' END AS category FROM {orders}"
)


@query(
    f"""WITH o AS ({_ORDERED.format(orders="orders")}), r AS (SELECT *, category = 'CURRENT' AND row_number() OVER (PARTITION BY isin, agency, category ORDER BY day DESC NULLS LAST, seen DESC, id) = 1 AS now FROM o WHERE kind <= 2)
    SELECT c_custkey AS isin, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE coalesce((SELECT string_agg(CAST(id AS STRING), ',' ORDER BY seen, id) FROM o WHERE o.isin = c_custkey AND kind = 3), '') END AS assets,
    coalesce((SELECT string_agg(concat(coalesce(agency, '-'), CAST(id AS STRING)), ',' ORDER BY agency NULLS LAST) FROM r WHERE r.isin = c_custkey AND now), '') AS current_ratings,
    coalesce((SELECT string_agg(CAST(id AS STRING), ',' ORDER BY day DESC NULLS LAST, seen DESC, id) FROM r WHERE r.isin = c_custkey AND NOT now), '') AS history,
    coalesce((SELECT string_agg(CAST(id AS STRING), ',' ORDER BY day NULLS LAST, seen, id) FROM o WHERE o.isin = c_custkey AND kind = 4), '') AS listings,
    coalesce((SELECT string_agg(CAST(id AS STRING), ',' ORDER BY day NULLS LAST, seen, id) FROM o WHERE o.isin = c_custkey AND kind = 0), '') AS cash_flows FROM customer"""
)
def security_documents(spark, sf):
    """The whole view of every security: assets, current ratings, history, listings, cash flows."""
    recorded = spark.sql(_ORDERED.format(orders="{orders}"), orders=t(spark, sf, "orders")).withColumnRenamed("seen", "first_recorded_at")
    kind = lambda *n: recorded.where(F.col("kind").isin(*n))
    status = F.when(F.col(_K) % 3 == 0, "unsecured").otherwise("Secured")
    out = views.security_view({
        "security": t(spark, sf, "customer").select(F.col(_K).alias("isin"), status.alias("collateral_status")),
        "collateral_asset": kind(3).select("isin", "id", "first_recorded_at"),
        "rating": kind(0, 1, 2).select("isin", "id", "first_recorded_at", F.col("category").alias("source_category"), F.col("agency").alias("rating_agency_name"), F.col("day").alias("rating_date")),
        "listing": kind(4).select("isin", "id", "first_recorded_at", F.col("day").alias("listing_date")),
        "cash_flow": kind(0).select("isin", "id", "first_recorded_at", F.col("day").alias("due_date")),
    })
    ids = lambda name: F.coalesce(F.array_join(F.transform(name, lambda x: x["id"].cast("string")), ","), F.lit(""))
    current = F.coalesce(F.array_join(F.transform("current_ratings", lambda x: F.concat(F.coalesce(x["rating_agency_name"], F.lit("-")), x["id"].cast("string"))), ","), F.lit(""))
    return out.select("isin", ids("assets").alias("assets"), current.alias("current_ratings"), ids("rating_history").alias("history"), ids("listings").alias("listings"), ids("cash_flows").alias("cash_flows"))


@query(
    """WITH j AS (SELECT o_orderkey AS job, o_orderkey % 3 + 1 AS last, o_orderkey % 4 = 0 AS failed, o_orderkey % 8 = 0 AS detailed FROM orders WHERE o_orderstatus <> 'P'),
    l AS (SELECT DISTINCT l_orderkey AS job, l_linenumber AS n FROM lineitem), f AS (SELECT l_orderkey AS job, count(*) AS n, min(concat('f', CAST(l_suppkey AS STRING))) AS name FROM lineitem GROUP BY l_orderkey)
    SELECT j.job, CAST(0 AS BIGINT) AS sequence, 'BROKEN' AS code, NULL AS isin, CASE WHEN n = 1 THEN name END AS source_file, CASE WHEN detailed THEN 'detail' ELSE 'BROKEN' END AS message FROM j LEFT JOIN f ON f.job = j.job WHERE failed
    UNION ALL SELECT job, n, 'INVALID_DATE', isin, 'f.csv', 'm' FROM (SELECT l.job, l.n, concat('I', CAST(n % 2 AS STRING)) AS isin, row_number() OVER (PARTITION BY l.job ORDER BY n) + CAST(any_value(failed) OVER (PARTITION BY l.job) AS INTEGER) AS place
    FROM l JOIN j ON l.job = j.job WHERE n % 3 + 1 = last) WHERE place <= 3"""
)
def job_error_pages(spark, sf):
    """The first page of two errors, and one more, of every finished job: only its last run counts."""
    k = F.col("o_orderkey")
    orders = t(spark, sf, "orders")
    jobs = orders.select(k.alias("job"), F.when(F.col("o_orderstatus") == "P", "RUNNING").when(F.col("o_orderstatus") == "F", "FAILED").otherwise("COMPLETED_WITH_ERRORS").alias("status"))
    runs = orders.select(k.alias("job"), F.explode(F.sequence(F.lit(1), (k % 3 + 1).cast("int"))).alias("attempt")).withColumn("run_id", F.concat_ws("-", "job", "attempt"))
    last = F.col("attempt") == F.col("job") % 3 + 1
    runs = runs.withColumns({"failure_code": F.when(~last | (F.col("job") % 4 == 0), "BROKEN"), "failure_detail": F.when(F.col("job") % 8 == 0, "detail")})
    lines = t(spark, sf, "lineitem")
    issues = lines.select("l_orderkey", "l_linenumber").distinct().select(
        F.concat_ws("-", "l_orderkey", (F.col("l_linenumber") % 3 + 1).cast("string")).alias("run_id"), F.col("l_linenumber").alias("sequence"), F.lit("INVALID_DATE").alias("code"),
        F.concat(F.lit("I"), (F.col("l_linenumber") % 2).cast("string")).alias("isin"), F.lit("f.csv").alias("source_file"), F.lit("m").alias("message"),
    )
    files = lines.select(F.col("l_orderkey").alias("job"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file_name"))
    return views.job_errors(jobs, runs, issues, files, size=2)
