"""Registered queries over the driver's tables, each with the SQL that says the same.

Dirty text is derived from integers by one SQL expression that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import json_values, rules
from tidewright.operators import csv_stage, merge, review
from tidewright.plans import securities
from tidewright.plans.contracts import FieldSpec, MappingContract, RowRule, SourceContract
from tidewright.sources import files
from tidewright.streaming import admission

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
PRICE = (
    f"CASE WHEN l_orderkey % 7 = 0 THEN '1,2,34' WHEN l_orderkey % 11 = 0 THEN '  ' WHEN l_orderkey % 13 = 0 THEN concat('-', CAST({CENTS} AS STRING)) "
    f"WHEN l_orderkey % 17 = 0 THEN concat(' ', CAST({CENTS} AS STRING), ' ') WHEN l_orderkey % 19 = 0 THEN '12,34,567.50' "
    f"WHEN l_orderkey % 23 = 0 THEN '1,234,567.25' WHEN l_orderkey % 29 = 0 THEN 'abc' WHEN l_orderkey % 31 = 0 THEN CASE l_linenumber % 4 WHEN 0 THEN '0,123' WHEN 1 THEN '012,345' WHEN 2 THEN '-01,23,456.5' ELSE '-1,234' END ELSE CAST({CENTS} AS STRING) END"
)
QTY = "CAST(CAST(l_quantity AS BIGINT) AS STRING)"
VOLUME = f"CASE WHEN l_linenumber % 4 = 0 THEN concat({QTY}, '.00') WHEN l_linenumber % 4 = 1 THEN concat({QTY}, '.5') WHEN l_linenumber % 4 = 2 THEN {QTY} ELSE 'x' END"
PRICE_SPEC = FieldSpec("price", "price", "DECIMAL", ("trim", "blankToNull", "normalizeGroupedNumber"), ("nonNegative",))
VOLUME_SPEC = FieldSpec("volume", "volume", "INTEGER", ("trim", "blankToNull"), ("nonNegative",), ignore_invalid=True)
_G = r"(regexp_matches(v, '^-?[0-9]+(\.[0-9]+)?$') OR regexp_matches(v, '^-?[1-9][0-9]{0,2}(,[0-9]{3})+(\.[0-9]+)?$') OR regexp_matches(v, '^-?[1-9][0-9]?(,[0-9]{2})*,[0-9]{3}(\.[0-9]+)?$'))"
PRICE_SQL = (
    f"SELECT *, CASE WHEN v IS NOT NULL AND {_G} THEN replace(v, ',', '') END AS parsed, "
    rf"CASE WHEN v IS NULL THEN NULL WHEN {_G} THEN CASE WHEN v LIKE '-%' AND CAST(replace(v, ',', '') AS DOUBLE) < 0 THEN 'NEGATIVE_VALUE' END "
    r"WHEN v LIKE '%,%' AND regexp_matches(v, '^-?[0-9,]+(\.[0-9]+)?$') THEN 'INVALID_NUMBER_GROUPING' ELSE 'INVALID_DECIMAL' END AS code "
    f"FROM (SELECT *, nullif(trim({PRICE}), '') AS v FROM lineitem)"
)
VOLUME_SQL = (
    r"SELECT *, CASE WHEN regexp_matches(w, '^-?[0-9]+(\.0+)?$') THEN regexp_replace(w, '\..*$', '') END AS whole, "
    r"CASE WHEN regexp_matches(w, '^-?[0-9]+(\.0+)?$') THEN NULL WHEN regexp_matches(w, '^-?[0-9]+(\.[0-9]+)?$') THEN 'NOT_WHOLE_NUMBER' ELSE 'INVALID_DECIMAL' END AS wcode "
    "FROM (SELECT *, {0} AS w FROM ({1}))"
).format(VOLUME, PRICE_SQL).replace("{{", "{")


def _field(rows: DataFrame, f: str) -> DataFrame:
    return rows.select("l_orderkey", "l_linenumber", F.col(f"{f}.parsed").alias("parsed"), F.array_join(f"{f}.errors", ",").alias("errors"), F.col(f"{f}.status").alias("status"))


@query(f"SELECT l_orderkey, l_linenumber, parsed, coalesce(code, '') AS errors, CASE WHEN code IS NULL THEN 'PASSED' ELSE 'FAILED' END AS status FROM ({PRICE_SQL})")
def csv_field_validation(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(PRICE).alias("price"))
    return _field(csv_stage.validate_fields(rows, (PRICE_SPEC,)), "price")


@query(f"SELECT l_orderkey, l_linenumber, whole AS parsed, coalesce(wcode, '') AS errors, CASE WHEN wcode IS NULL THEN 'PASSED' ELSE 'IGNORED' END AS status FROM ({VOLUME_SQL})")
def whole_number_parse(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.expr(VOLUME).alias("volume"))
    return _field(csv_stage.validate_fields(rows, (VOLUME_SPEC,)), "volume")


def _p(part: str, n: int) -> str:
    return f"lpad(CAST({part}(l_shipdate) AS STRING), {n}, '0')"


DAY = (
    f"CASE l_linenumber % 5 WHEN 0 THEN concat({_p('day', 2)}, '-', {_p('month', 2)}, '-', {_p('year', 4)}) "
    f"WHEN 1 THEN concat({_p('year', 4)}, '-', {_p('month', 2)}, '-', {_p('day', 2)}) WHEN 2 THEN '30-02-2024' WHEN 3 THEN '1899-12-31' "
    f"ELSE concat({_p('year', 4)}, '/', {_p('month', 2)}, '/', {_p('day', 2)}) END"
)


@query(
    f"""SELECT l_orderkey, l_linenumber, CASE WHEN year(d) >= 1900 THEN strftime(d, '%Y-%m-%d') END AS value,
    CASE WHEN d IS NULL OR year(d) < 1900 THEN 'INVALID_DATE' END AS code FROM (SELECT *,
    coalesce(CASE WHEN regexp_matches(x, '^\\d{{2}}-\\d{{2}}-\\d{{4}}$') THEN try_strptime(x, '%d-%m-%Y') END,
             CASE WHEN regexp_matches(x, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN try_strptime(x, '%Y-%m-%d') END) AS d
    FROM (SELECT *, {DAY} AS x FROM lineitem))"""
)
def strict_dates(spark, sf):
    value, code = rules.strict_date(F.col("x"))
    return t(spark, sf, "lineitem").withColumn("x", F.expr(DAY)).select("l_orderkey", "l_linenumber", value.alias("value"), code.alias("code"))


DISC = "CAST(CAST(round(l_discount * 100) AS BIGINT) AS STRING)"
PCT = f"CASE l_linenumber % 5 WHEN 0 THEN concat({DISC}, '%') WHEN 1 THEN concat(' ', {DISC}, ' % ') WHEN 2 THEN '0.00%' WHEN 3 THEN concat({DISC}, '.5% (cat I)') ELSE concat({DISC}, '%%') END"


@query(
    rf"""SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(s, '^-?[0-9]+(\.[0-9]+)?$') AND NOT regexp_matches(s, '^0+(\.0+)?$') THEN s END AS value,
    CASE WHEN regexp_matches(s, '^-?[0-9]+(\.[0-9]+)?$') THEN NULL ELSE 'INVALID_DECIMAL' END AS code, trim(split_part(x, '%', 1)) AS before_percent
    FROM (SELECT *, regexp_replace(trim(x), '\s*%$', '') AS s FROM (SELECT *, {PCT} AS x FROM lineitem))"""
)
def percent_text(spark, sf):
    value, code = rules.normalize(F.col("x"), ("trim", "blankToNull", "stripTrailingPercent", "normalizeGroupedNumber", "zeroToNull"))
    parsed, more = rules.percent(value)
    before, _ = rules.keep_before_first_percent(F.col("x"))
    return t(spark, sf, "lineitem").withColumn("x", F.expr(PCT)).select(
        "l_orderkey", "l_linenumber", parsed.alias("value"), F.coalesce(code, more).alias("code"), before.alias("before_percent")
    )


VALUE = (
    "CASE event_id % 6 WHEN 0 THEN '{}' WHEN 1 THEN '{\"v\": null}' WHEN 2 THEN '{\"v\": \"-\"}' WHEN 3 THEN '{\"v\": \" N.A. \"}' WHEN 4 THEN '{\"v\": 5}' "
    "ELSE concat('{\"v\": \"', event_type, '\"}') END"
)


@query(
    f"""SELECT event_id, CASE WHEN k IS NULL THEN 'MISSING' WHEN k = 'NULL' THEN 'NULL' WHEN k = 'VARCHAR' AND trim(s) IN ('', '-', 'N.A.') THEN 'PLACEHOLDER' ELSE 'PRESENT' END AS presence,
    CASE WHEN k = 'VARCHAR' AND trim(s) NOT IN ('', '-', 'N.A.') THEN s END AS text_value, CASE WHEN k NOT IN ('NULL', 'VARCHAR') THEN 'INVALID_TYPE' END AS code
    FROM (SELECT event_id, json_type(x, '$.v') AS k, json_extract_string(x, '$.v') AS s FROM (SELECT event_id, {VALUE} AS x FROM events))"""
)
def presence_classes(spark, sf):
    doc = t(spark, sf, "events").select("event_id", F.try_variant_get(F.try_parse_json(F.expr(VALUE)), "$.v", "variant").alias("v"))
    text, code = json_values.text_value(F.col("v"))
    return doc.select("event_id", json_values.presence(F.col("v")).alias("presence"), text.alias("text_value"), code.alias("code"))


NESTED = "concat('{\"a\": ', CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '5' ELSE 'null' END, '}')"


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 3 = 1 THEN '$.a' END AS blocked FROM events")
def json_scalar_extract(spark, sf):
    doc = t(spark, sf, "events").select("event_id", json_values.strict_document(F.expr(NESTED)).alias("d"))
    value, blocked = json_values.scalar(F.col("d"), "$.a.k")
    return doc.select("event_id", F.try_variant_get(value, "$", "bigint").alias("k"), blocked.alias("blocked"))


ITEMS = "CASE WHEN event_id % 4 = 0 THEN '{\"items\": {\"a\": 1}}' ELSE concat('{\"items\": [', CAST(user_id AS STRING), ',', CAST(event_id AS STRING), ',7]}') END"


@query(
    """SELECT event_id, pos, CASE pos WHEN 0 THEN user_id WHEN 1 THEN event_id ELSE 7 END AS item, concat('$.items[', CAST(pos AS STRING), ']') AS element_path
    FROM events, (SELECT unnest([0, 1, 2]) AS pos) WHERE event_id % 4 <> 0"""
)
def json_explode(spark, sf):
    doc = t(spark, sf, "events").select("event_id", F.try_parse_json(F.expr(ITEMS)).alias("d"))
    return json_values.collection(doc, "d", "$.items").select("event_id", "pos", F.try_variant_get("value", "$", "bigint").alias("item"), "element_path")


@query("SELECT DISTINCT user_id AS file, '$.a' AS path FROM events WHERE event_id % 3 = 1")
def structure_issues(spark, sf):
    doc = t(spark, sf, "events").select("user_id", json_values.strict_document(F.expr(NESTED)).alias("d"))
    found = [doc.select(F.col("user_id").alias("file"), json_values.scalar(F.col("d"), p)[1].alias("path")) for p in ("$.a.k", "$.a.z.y")]
    return found[0].unionByName(found[1]).where("path is not null").dropDuplicates(["file", "path"])


@query("SELECT n_nationkey, sha256(concat('{\"a\":\"', n_name, '\",\"b\":', CAST(n_nationkey AS STRING), '}')) AS payload_hash FROM nation")
def canonical_hash(spark, sf):
    text = F.concat(F.lit('{"b": '), F.col("n_nationkey").cast("string"), F.lit(', "a": "'), F.col("n_name"), F.lit('"}'))
    return t(spark, sf, "nation").select("n_nationkey", json_values.canonical_hash(text).alias("payload_hash"))


@query("SELECT doc_id, substr(text, 1, 1000) AS preview, length(text) > 1000 AS cut FROM documents")
def raw_preview(spark, sf):
    text, cut = rules.preview(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", text.alias("preview"), cut.alias("cut"))


@query("SELECT page_id, list_extract(string_split(url, '/'), -1) AS name FROM pages")
def file_basename(spark, sf):
    return t(spark, sf, "pages").select("page_id", rules.base_name(F.col("url")).alias("name"))


NAME = "concat(CASE WHEN o_orderkey % 3 = 0 THEN 'bse' WHEN o_orderkey % 3 = 1 THEN 'NSE' ELSE '' END, '_x', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), CAST(year(o_orderdate) AS STRING), '.csv')"


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'BSE' WHEN o_orderkey % 3 = 1 THEN 'NSE' END AS exchange, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS trade_date,
    CASE WHEN o_orderkey % 3 = 2 THEN 'INVALID_SOURCE_FILENAME' WHEN o_orderkey % 5 = 0 THEN 'TRADE_DATE_MISMATCH' END AS problem FROM orders"""
)
def file_name_agreement(spark, sf):
    exchange, day = files.csv_name(F.expr(NAME))
    named = F.when(F.col("o_orderkey") % 5 == 0, F.date_add(F.to_date("o_orderdate"), 1)).otherwise(F.to_date("o_orderdate"))
    problem = F.when(exchange.isNull() | day.isNull(), "INVALID_SOURCE_FILENAME").when(day != named, "TRADE_DATE_MISMATCH")
    return t(spark, sf, "orders").select("o_orderkey", exchange.alias("exchange"), F.date_format(day, "yyyy-MM-dd").alias("trade_date"), problem.alias("problem"))


PAIR = SourceContract("pair", (FieldSpec("high", "high", "DECIMAL"), FieldSpec("low", "low", "DECIMAL")), (RowRule("high", ">=", "low"),))
LOW = "CAST(CAST(round(p_retailprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT) AS STRING)"


@query(
    f"""SELECT l_orderkey, l_linenumber, NOT bad AS valid, CASE WHEN bad THEN 'PRICE_INCONSISTENT' ELSE '' END AS errors FROM (
    SELECT *, {CENTS} < CAST(round(p_retailprice * 100) AS BIGINT) * CAST(l_quantity AS BIGINT) AS bad FROM lineitem JOIN part ON l_partkey = p_partkey)"""
)
def price_rules(spark, sf):
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("l_orderkey", "l_linenumber", F.expr(f"CAST({CENTS} AS STRING)").alias("high"), F.expr(LOW).alias("low"))
    return csv_stage.validate_rows(rows, PAIR).select("l_orderkey", "l_linenumber", "valid", F.array_join("row_errors", ",").alias("errors"))


def _disposed(spark, sf):
    rows = t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 3).alias("isin"), F.col("l_linenumber").alias("record_number"), (F.col("l_quantity") > 5).alias("valid")
    )
    return csv_stage.dispositions(rows, "file", F.col("isin"))


_DISPOSED = """(SELECT *, CASE WHEN NOT valid THEN 'QUARANTINED_INVALID' WHEN record_number < last THEN 'QUARANTINED_SUPERSEDED' ELSE 'ACCEPTED' END AS disposition FROM (
    SELECT *, max(CASE WHEN valid THEN record_number END) OVER (PARTITION BY file, isin) AS last FROM (
    SELECT l_orderkey AS file, l_partkey % 3 AS isin, l_linenumber AS record_number, l_quantity > 5 AS valid FROM lineitem)))"""


@query(
    f"""SELECT *, CASE WHEN accepted_rows = 0 THEN 'FAILED' WHEN accepted_rows = source_rows THEN 'COMPLETED' ELSE 'COMPLETED_WITH_ERRORS' END AS job_status FROM (
    SELECT file, count(*) AS source_rows, count(*) FILTER (disposition = 'ACCEPTED') AS accepted_rows, count(*) FILTER (disposition = 'QUARANTINED_INVALID') AS invalid_rows,
    count(*) FILTER (disposition = 'QUARANTINED_SUPERSEDED') AS superseded_rows FROM {_DISPOSED} GROUP BY file)"""
)
def dedupe_last_valid(spark, sf):
    return csv_stage.counts(_disposed(spark, sf), "file")


@query(f"SELECT file, record_number, disposition, CASE WHEN disposition = 'QUARANTINED_SUPERSEDED' THEN last END AS superseded_by FROM {_DISPOSED}")
def superseded_by(spark, sf):
    return _disposed(spark, sf).select("file", "record_number", "disposition", "superseded_by")


LINE = SourceContract("line", (PRICE_SPEC, VOLUME_SPEC))


def _lines(spark, sf):
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("record_number"), F.expr(PRICE).alias("price"), F.expr(VOLUME).alias("volume"))
    valid = csv_stage.validate_rows(rows, LINE)
    return valid.withColumn("disposition", F.when(F.col("valid"), "ACCEPTED").otherwise("QUARANTINED_INVALID"))


@query(
    f"""SELECT job, row_number() OVER (PARTITION BY job ORDER BY record_number, place, code) AS sequence, record_number, field, code FROM (
    SELECT l_orderkey AS job, l_linenumber AS record_number, 0 AS place, 'price' AS field, code FROM ({VOLUME_SQL}) WHERE code IS NOT NULL
    UNION ALL SELECT l_orderkey, l_linenumber, 1, 'volume', wcode FROM ({VOLUME_SQL}) WHERE wcode IS NOT NULL)"""
)
def issue_sequence(spark, sf):
    return csv_stage.issues(_lines(spark, sf), LINE, "job")


@query(f"SELECT l_orderkey AS job, l_linenumber AS record_number, parsed AS price, whole AS volume, 'BSE' AS exchange FROM ({VOLUME_SQL}) WHERE code IS NULL")
def mapping_projection(spark, sf):
    return csv_stage.project(_lines(spark, sf), MappingContract("line", {"price": "price", "volume": "volume"}, {"exchange": "BSE"}), "job", "record_number")


@query(f"SELECT l_orderkey AS job, l_linenumber AS record_number, 'VOLUME' AS source_category, whole AS value FROM ({VOLUME_SQL}) WHERE code IS NULL AND whole IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, 'PRICE', parsed FROM ({VOLUME_SQL}) WHERE code IS NULL AND parsed IS NOT NULL")
def coupon_projection(spark, sf):
    lists = [MappingContract("c", {"value": f}, {"source_category": f.upper()}) for f in ("volume", "price")]
    rows = csv_stage.project_each(_lines(spark, sf), lists, "job", "record_number")
    return rows.where("value is not null").select("job", "record_number", "source_category", "value")


@query("SELECT user_id, event_type, event_id AS winner, CAST(round(value * 100) AS BIGINT) AS cents FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def scalar_precedence(spark, sf):
    won = merge.latest(t(spark, sf, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id"))
    return won.select("user_id", "event_type", F.col("event_id").alias("winner"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))


def _ratings(spark, sf):
    dated = F.when(F.col("event_id") % 4 != 0, F.to_date("ts"))
    rows = t(spark, sf, "events").select("user_id", "event_type", "event_id", dated.alias("rating_date"), (F.col("event_id") % 3 != 0).alias("is_listed"))
    return review.current_and_history(rows, ["user_id", "event_type"], "rating_date", "event_id", F.col("is_listed"))


_RATED = """(SELECT *, is_listed AND row_number() OVER (PARTITION BY user_id, event_type, is_listed ORDER BY rating_date DESC NULLS LAST, event_id DESC) = 1 AS is_current FROM (
    SELECT user_id, event_type, event_id, CASE WHEN event_id % 4 <> 0 THEN CAST(ts AS DATE) END AS rating_date, event_id % 3 <> 0 AS is_listed FROM events))"""


@query(f"SELECT user_id, event_type, event_id FROM {_RATED} WHERE is_current")
def current_rating(spark, sf):
    return _ratings(spark, sf).where("is_current").select("user_id", "event_type", "event_id")


@query(f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY rating_date DESC NULLS LAST, event_id DESC) AS history_rank FROM {_RATED} WHERE NOT is_current")
def rating_history(spark, sf):
    return _ratings(spark, sf).where("not is_current").select("user_id", "event_id", "history_rank")


@query("SELECT l_orderkey AS job, l_linenumber AS attempt, l_partkey AS run FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last FROM lineitem) WHERE l_linenumber = last")
def final_run(spark, sf):
    return review.final_run(t(spark, sf, "lineitem"), "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("attempt"), F.col("l_partkey").alias("run"))


def _errors(spark, sf):
    orders, lines = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    failed = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job"), F.lit(0).alias("sequence"), F.lit("RUN_FAILED").alias("code"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_linestatus")
    issues = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("job"), F.row_number().over(order).alias("sequence"), F.col("l_linestatus").alias("code"))
    return review.union_errors(failed, issues, orders.select(F.col("o_orderkey").alias("job")))


_ERRORS = """(SELECT o_orderkey AS job, 0 AS sequence, 'RUN_FAILED' AS code FROM orders WHERE o_orderstatus = 'F' UNION ALL
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linestatus), l_linestatus FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders))"""


@query(f"SELECT * FROM {_ERRORS}")
def error_union(spark, sf):
    return _errors(spark, sf)


@query(f"SELECT job, sequence, code FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY sequence) AS n FROM {_ERRORS} WHERE sequence > 0) WHERE n <= 3")
def job_errors(spark, sf):
    return review.first_pages(_errors(spark, sf), "job", F.col("sequence") > 0, 2)


@query(
    f"""SELECT o_orderkey AS job, o_orderstatus AS status, CASE WHEN o_orderstatus <> 'O' THEN greatest(CAST(o_orderkey % 3 AS BIGINT), coalesce(n, 0)) + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END END AS error_count,
    CASE WHEN o_orderstatus <> 'O' THEN coalesce(first5, '') END AS first_errors, CASE WHEN o_orderstatus <> 'O' THEN coalesce(total, 0) > 5 END AS has_more
    FROM orders LEFT JOIN (SELECT job, count(*) FILTER (sequence > 0) AS n, count(*) AS total, string_agg(code, ',' ORDER BY sequence) FILTER (sequence_no <= 5) AS first5
    FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY sequence, code) AS sequence_no FROM {_ERRORS}) GROUP BY job) ON o_orderkey = job"""
)
def job_status_view(spark, sf):
    jobs = t(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 3).alias("stored"))
    failure = F.when(F.col("status") == "F", F.lit("RUN_FAILED"))
    return review.job_status(jobs, _errors(spark, sf), "stored", failure, F.col("status") != "O").drop("stored")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS low FROM orders WHERE o_orderstatus = 'O') WHERE o_orderkey = low AND o_orderkey % 2 = 0")
def group_heads(spark, sf):
    pending = t(spark, sf, "orders").where("o_orderstatus = 'O'")
    return review.group_heads(pending, ["o_custkey"], "o_orderkey", F.col("o_orderkey") % 2 == 0).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, concat('isin:', upper(trim(concat(' c', CAST(o_custkey AS STRING))))) AS ordering_group, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS acceptance_sequence FROM orders")
def acceptance_sequence(spark, sf):
    group = F.concat(F.lit("isin:"), rules.identity_text(F.concat(F.lit(" c"), F.col("o_custkey").cast("string"))))
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t(spark, sf, "orders").select("o_orderkey", group.alias("ordering_group"), F.row_number().over(order).alias("acceptance_sequence"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('trade-date:', strftime(o_orderdate, '%Y-%m-%d')) ELSE concat('isin:', 'C', CAST(o_custkey AS STRING)) END AS ordering_group FROM orders")
def ordering_group(spark, sf):
    by_day = F.concat(F.lit("trade-date:"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    by_isin = F.concat(F.lit("isin:"), rules.identity_text(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))))
    return t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, by_day).otherwise(by_isin).alias("ordering_group"))


@query("SELECT DISTINCT o_custkey AS isin FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def insert_missing(spark, sf):
    stored = t(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("isin"))
    return merge.insert_missing(stored, t(spark, sf, "orders").select(F.col("o_custkey").alias("isin")), ["isin"])


FLOW = "l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END AS kind, l_linestatus, l_orderkey, l_linenumber"


@query(
    f"""SELECT l_partkey, kind, l_linestatus, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, kind, l_linestatus ORDER BY l_orderkey, l_linenumber) AS n FROM (
    SELECT {FLOW} FROM lineitem WHERE l_orderkey % 2 = 1) i WHERE NOT EXISTS (SELECT 1 FROM (SELECT {FLOW} FROM lineitem WHERE l_orderkey % 2 = 0) s
    WHERE s.l_partkey = i.l_partkey AND s.kind IS NOT DISTINCT FROM i.kind AND s.l_linestatus = i.l_linestatus)) WHERE n = 1"""
)
def append_only(spark, sf):
    rows = t(spark, sf, "lineitem").selectExpr(*["l_partkey", "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END AS kind", "l_linestatus", "l_orderkey", "l_linenumber"])
    stored, incoming = rows.where("l_orderkey % 2 = 0"), rows.where("l_orderkey % 2 = 1")
    return merge.append_only(stored, incoming, ["l_partkey", "kind", "l_linestatus"], [F.col("l_orderkey"), F.col("l_linenumber")])


@query(
    """SELECT c_custkey, CASE WHEN i THEN CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE upper(c_name) END ELSE c_name END AS name, CASE WHEN s THEN 't0' ELSE 't1' END AS created_at,
    CASE WHEN i THEN 't1' ELSE 't0' END AS updated_at FROM (SELECT *, c_custkey % 3 <> 0 AS s, c_custkey % 2 = 0 AS i FROM customer) WHERE s OR i"""
)
def upsert_nulls_overwrite(spark, sf):
    c = t(spark, sf, "customer")
    stored = c.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_name").alias("name"), F.lit("t0").alias("created_at"), F.lit("t0").alias("updated_at"))
    incoming = c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.upper("c_name")).alias("name"))
    return merge.upsert(stored, incoming, ["c_custkey"], ["name"], F.lit("t1"))


_STATE = """(SELECT p_partkey, p_size AS rate, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE DATE '1995-06-17' END AS day, CASE WHEN p_partkey % 4 = 0 THEN 'JSON' WHEN p_partkey % 5 = 0 THEN NULL ELSE 'BSE' END AS source FROM part)"""
_TRADED = """(SELECT l_partkey, CAST(l_shipdate AS DATE) AS new_day, CAST(l_quantity AS BIGINT) AS new_rate FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem) WHERE n = 1)"""


def _coupons(spark, sf):
    state = t(spark, sf, "part").selectExpr(
        "p_partkey", "CAST(p_size AS BIGINT) AS rate", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE DATE '1995-06-17' END AS day", "CASE WHEN p_partkey % 4 = 0 THEN 'JSON' WHEN p_partkey % 5 = 0 THEN NULL ELSE 'BSE' END AS source"
    )
    traded = merge.latest(t(spark, sf, "lineitem"), ["l_partkey"], F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"))
    traded = traded.selectExpr("l_partkey", "CAST(l_shipdate AS DATE) AS new_day", "CAST(l_quantity AS BIGINT) AS new_rate")
    return state.join(traded, F.col("p_partkey") == F.col("l_partkey"))


_CHANGE = "CASE WHEN source IS DISTINCT FROM 'BSE' OR day IS NULL THEN 'REPLACE' WHEN new_day < day THEN 'KEEP' WHEN new_rate IS DISTINCT FROM rate THEN 'REPLACE' WHEN new_day > day THEN 'ADVANCE_TRADE_DATE' ELSE 'KEEP' END"


@query(
    f"""SELECT p_partkey, change, CASE WHEN change = 'REPLACE' THEN new_rate ELSE rate END AS rate, strftime(CASE WHEN change = 'KEEP' THEN day ELSE new_day END, '%Y-%m-%d') AS trade_date
    FROM (SELECT *, {_CHANGE} AS change FROM {_STATE} JOIN {_TRADED} ON p_partkey = l_partkey)"""
)
def coupon_precedence(spark, sf):
    change = merge.coupon_change(F.col("rate"), F.col("day"), F.col("source"), F.col("new_rate"), F.col("new_day"), "BSE")
    out = _coupons(spark, sf).withColumn("change", change)
    return out.select(
        "p_partkey", "change", F.when(F.col("change") == "REPLACE", F.col("new_rate")).otherwise(F.col("rate")).alias("rate"),
        F.date_format(F.when(F.col("change") == "KEEP", F.col("day")).otherwise(F.col("new_day")), "yyyy-MM-dd").alias("trade_date"),
    )


@query(f"SELECT p_partkey, rate AS stored_rate, new_rate, CASE WHEN source = 'BSE' THEN rate ELSE new_rate END AS json_may_set FROM {_STATE} JOIN {_TRADED} ON p_partkey = l_partkey WHERE new_rate <> rate AND source <> 'BSE'")
def coupon_disagreement(spark, sf):
    out = _coupons(spark, sf).where("new_rate <> rate and source <> 'BSE'")
    return out.select("p_partkey", F.col("rate").alias("stored_rate"), "new_rate", F.when(F.col("source") == "BSE", F.col("rate")).otherwise(F.col("new_rate")).alias("json_may_set"))


_SUPPLY = "s_suppkey, s_nationkey AS a, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey + s_suppkey % 2 END AS new_a, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS b, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS new_b"


@query(
    f"""SELECT s_suppkey, CAST(ca AS INTEGER) + CAST(cb AS INTEGER) AS fields_changed, CASE WHEN ca THEN new_a ELSE a END AS a, CASE WHEN cb THEN new_b ELSE b END AS b,
    concat_ws(',', CASE WHEN ca THEN 'a' END, CASE WHEN cb THEN 'b' END) AS sources FROM (SELECT *, new_a IS NOT NULL AND new_a IS DISTINCT FROM a AS ca, new_b IS NOT NULL AND new_b IS DISTINCT FROM b AS cb FROM (SELECT {_SUPPLY} FROM supplier))"""
)
def scalar_changes(spark, sf):
    rows = t(spark, sf, "supplier").selectExpr(
        "s_suppkey", "s_nationkey AS a", "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey + s_suppkey % 2 END AS new_a",
        "CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS b", "CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS new_b",
    )
    rows = rows.withColumns({f"c{x}": merge.scalar_change(F.col(x), F.col(f"new_{x}")) for x in "ab"})
    values = [F.when(F.col(f"c{x}"), F.col(f"new_{x}")).otherwise(F.col(x)).alias(x) for x in "ab"]
    names = F.concat_ws(",", *(F.when(F.col(f"c{x}"), F.lit(x)) for x in "ab"))
    return rows.select("s_suppkey", (F.col("ca").cast("int") + F.col("cb").cast("int")).alias("fields_changed"), *values, names.alias("sources"))


@query(
    """SELECT c_custkey, CAST(c_custkey % 5 + 1 AS BIGINT) AS details_request_count FROM customer WHERE c_custkey % 17 = 0 OR
    ((c_custkey NOT IN (SELECT o_custkey FROM orders) OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) AND c_custkey % 5 < 3 AND c_custkey % 2 = 0)"""
)
def details_requests(spark, sf):
    orders = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    flags = review.has_any(t(spark, sf, "customer").select("c_custkey"), {"has_order": orders, "has_urgent": orders.where("o_orderpriority = '1-URGENT'")}, "c_custkey")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    last = F.when(F.col("c_custkey") % 2 == 0, F.lit("2024-01-01 00:00:00").cast("timestamp")).otherwise(now)
    asks = merge.requests_again(F.col("c_custkey") % 17 == 0, ~(F.col("has_order") & F.col("has_urgent")), F.col("c_custkey") % 5, last, now)
    return flags.where(asks).select("c_custkey", (F.col("c_custkey") % 5 + 1).alias("details_request_count"))


@query("SELECT p_partkey, flag = 1 AND p_size > 25 AS conflict FROM (SELECT *, max(CASE WHEN p_type LIKE '%BRASS' AND p_size < 5 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand, p_size % 10) AS flag FROM part)")
def unsecured_screen(spark, sf):
    rows = t(spark, sf, "part").withColumn("_file", F.col("p_size") % 10)
    return merge.screen_conflicts(rows, ["p_brand", "_file"], F.col("p_type").like("%BRASS") & (F.col("p_size") < 5), F.col("p_size") > 25).select("p_partkey", "conflict")


@query(
    """SELECT count(*) AS total, count(*) FILTER (o) AS with_orders, count(*) FILTER (u) AS with_urgent, count(*) FILTER (NOT o) AS without_orders, count(*) FILTER (o AND NOT u) AS incomplete, count(*) FILTER (c_acctbal < 0) AS negative
    FROM (SELECT *, c_custkey IN (SELECT o_custkey FROM orders) AS o, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS u FROM customer)"""
)
def completeness_metrics(spark, sf):
    orders = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    flags = review.has_any(t(spark, sf, "customer"), {"o": orders, "u": orders.where("o_orderpriority = '1-URGENT'")}, "c_custkey")
    return flags.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("o").alias("with_orders"), F.count_if("u").alias("with_urgent"), F.count_if(~F.col("o")).alias("without_orders"),
        F.count_if(F.col("o") & ~F.col("u")).alias("incomplete"), F.count_if(F.col("c_acctbal") < 0).alias("negative"),
    )


@query("SELECT o_orderpriority AS dataset, o_orderstatus AS outcome, count(*) AS jobs, CAST(round(sum(o_totalprice * 100)) AS BIGINT) // 100 AS total FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderstatus)) UNION ALL SELECT o_orderpriority, NULL, count(*), CAST(round(sum(o_totalprice * 100)) AS BIGINT) // 100 FROM orders GROUP BY ROLLUP (o_orderpriority)")
def op_metrics_grouping_sets(spark, sf):
    orders = t(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("outcome"), (F.col("o_totalprice") * 100).alias("cents"))
    measures = [F.count(F.lit(1)).alias("jobs"), F.floor(F.round(F.sum("cents")) / 100).cast("bigint").alias("total")]
    sets = orders.groupingSets([["dataset", "outcome"], ["outcome"]], "dataset", "outcome").agg(*measures)
    return sets.unionByName(orders.rollup("dataset").agg(*measures).withColumn("outcome", F.lit(None).cast("string")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 20 ORDER BY c_custkey LIMIT 51")
def keyset_page_isin(spark, sf):
    return review.keyset_page(t(spark, sf, "customer").select("c_custkey", "c_name"), [F.col("c_custkey")], F.col("c_custkey") > 20)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1997-12-31' AND (o_orderdate < TIMESTAMP '1997-06-01' OR (o_orderdate = TIMESTAMP '1997-06-01' AND o_orderkey > 100)) ORDER BY o_orderdate DESC, o_orderkey LIMIT 51")
def keyset_page_summary(spark, sf):
    day = F.lit("1997-06-01").cast("timestamp")
    ranged = review.summaries(t(spark, sf, "orders"), "o_orderdate", "o_custkey", "1994-01-01", "1997-12-31")
    after = (F.col("o_orderdate") < day) | ((F.col("o_orderdate") == day) & (F.col("o_orderkey") > 100))
    return review.keyset_page(ranged, [F.desc("o_orderdate"), F.col("o_orderkey")], after).select("o_orderkey", "o_custkey")


@query(
    """SELECT c_custkey, c_name, coalesce(n, 0) AS listings, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE coalesce(keys, '') END AS order_keys FROM customer LEFT JOIN
    (SELECT o_custkey, count(*) AS n, string_agg(CAST(o_orderkey AS STRING), ',' ORDER BY (o_orderkey % 4 = 0), CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END, o_orderkey) AS keys FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey"""
)
def security_view(spark, sf):
    dated = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate"))
    orders = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), dated.alias("day"), F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderkey").alias("number"))
    out = review.nested_view(t(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", {"orders": (orders, [F.col("day").isNull(), F.col("day"), F.col("number")])})
    keys = F.array_join(F.transform("orders", lambda o: o["key"]), ",")
    hidden = F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.coalesce(keys, F.lit("")))
    return out.select("c_custkey", "c_name", F.col("n_orders").alias("listings"), hidden.alias("order_keys"))


@query(
    """SELECT o_orderkey AS job FROM (SELECT o_orderkey, greatest(o_orderdate, coalesce(max(l_shipdate), o_orderdate)) AS progress, max(CASE WHEN l_linenumber = 3 THEN l_shipdate END) AS final_started FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_orderstatus <> 'F' GROUP BY o_orderkey, o_orderdate) WHERE progress < TIMESTAMP '1997-01-01 01:00:00' - INTERVAL 1 HOUR OR final_started < TIMESTAMP '1997-01-01 01:00:00' - INTERVAL 16 MINUTE"""
)
def stuck_jobs(spark, sf):
    runs = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"), F.max(F.when(F.col("l_linenumber") == 3, F.col("l_shipdate"))).alias("final_started"))
    jobs = t(spark, sf, "orders").where("o_orderstatus <> 'F'").join(runs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    now = F.lit("1997-01-01 01:00:00").cast("timestamp")
    return jobs.where(review.stuck(F.greatest("o_orderdate", "last"), now, F.col("final_started"))).select(F.col("o_orderkey").alias("job"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 YEAR AND NOT (event_type = (SELECT min(event_type) FROM events) AND ts < (SELECT max(ts) FROM events) - INTERVAL 30 DAY)")
def retention(spark, sf):
    events = t(spark, sf, "events")
    bounds = events.agg(F.max("ts").alias("now"), F.min("event_type").alias("kind"))
    old = F.col("ts") < F.col("now") - F.expr("interval 30 days")
    kept = events.join(F.broadcast(bounds)).where(F.col("ts") >= F.col("now") - F.expr("interval 1 year")).where(~((F.col("event_type") == F.col("kind")) & old))
    return kept.select("event_id")


@query("SELECT greatest(coalesce(date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '1999-01-01'), 0), 0) AS oldest_days FROM orders WHERE o_orderstatus = 'O'")
def oldest_pending(spark, sf):
    oldest = F.datediff(F.lit("1999-01-01").cast("date"), F.to_date(F.min("o_orderdate")))
    return t(spark, sf, "orders").where("o_orderstatus = 'O'").agg(F.greatest(F.coalesce(oldest, F.lit(0)), F.lit(0)).alias("oldest_days"))


@query("SELECT l_orderkey, l_linenumber, CAST(least(300, 10 * power(2, least(l_linenumber - 1, 5))) AS INTEGER) AS delay_s FROM lineitem")
def backoff(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", review.backoff_seconds(F.col("l_linenumber")).alias("delay_s"))


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 60 WHEN 2 THEN 300 END AS wait_s, CASE WHEN l_linenumber >= 3 THEN 'FAILED' ELSE 'RETRY' END AS next_state FROM lineitem")
def retry_schedule(spark, sf):
    n = F.col("l_linenumber")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(n == 1, 60).when(n == 2, 300).alias("wait_s"), F.when(n >= 3, "FAILED").otherwise("RETRY").alias("next_state"))


@query(
    """SELECT event_id, concat_ws(',', CASE WHEN event_id % 5 = 0 THEN '/specversion INVALID_VALUE' END, CASE WHEN event_id % 3 = 0 THEN '/source REQUIRED' END, CASE WHEN event_id % 7 = 0 THEN '/data/run_id REQUIRED' END,
    CASE WHEN event_id % 7 <> 0 AND event_id % 4 = 0 THEN '/key MISMATCH' END, CASE WHEN event_id % 11 = 0 THEN '/extra UNKNOWN_PROPERTY' END, CASE WHEN event_id % 13 = 0 THEN '/note UNKNOWN_PROPERTY' END) AS faults FROM events"""
)
def submission_validation(spark, sf):
    e = F.col("event_id")
    names = F.array_compact(F.array(F.when(e % 13 == 0, "note"), F.lit("id"), F.when(e % 11 == 0, "extra"), F.lit("time")))
    found = admission.faults({
        "/specversion": F.when(e % 5 == 0, "0.9").otherwise("1.0"), "/id": e.cast("string"), "/source": F.when(e % 3 != 0, F.col("event_type")),
        "/type": F.lit("submission"), "/data/run_id": F.when(e % 7 == 0, " ").otherwise("r"), "/key": F.when(e % 4 == 0, "other").otherwise("r"),
    }, names=names, allowed=("id", "time"), equal=(("/data/run_id", "/key"),))
    return t(spark, sf, "events").select("event_id", F.array_join(F.transform(found, lambda f: F.concat_ws(" ", f["pointer"], f["code"])), ",").alias("faults"))


_SUBMITTED = "event_id, CASE WHEN event_id % 101 <> 0 THEN concat('k', CAST(user_id AS STRING)) END AS idempotency_key, concat('e', CAST(event_id - event_id % 3 AS STRING)) AS event_key, event_type AS payload_hash"


@query(
    f"""WITH RECURSIVE s AS (SELECT {_SUBMITTED} FROM events), r AS (SELECT * FROM s WHERE event_id IN (SELECT min(event_id) FROM s WHERE event_id % 40 = 1 AND idempotency_key IS NOT NULL GROUP BY idempotency_key)),
    i AS (SELECT * FROM s WHERE event_id % 40 <> 1), o AS (SELECT row_number() OVER (ORDER BY min(event_id)) AS n, idempotency_key AS k, event_key AS e, min(event_id) AS first_id FROM i WHERE idempotency_key IS NOT NULL GROUP BY 2, 3),
    g AS (SELECT CAST(0 AS BIGINT) AS n, (SELECT coalesce(list(idempotency_key), []) FROM r) AS ks, (SELECT coalesce(list(event_key), []) FROM r) AS es, CAST(-1 AS BIGINT) AS taken UNION ALL
        SELECT o.n, CASE WHEN x THEN list_append(ks, k) ELSE ks END, CASE WHEN x THEN list_append(es, e) ELSE es END, CASE WHEN x THEN first_id ELSE -1 END
        FROM (SELECT g.ks, g.es, o.*, NOT list_contains(g.ks, o.k) AND NOT list_contains(g.es, o.e) AS x FROM g JOIN o ON o.n = g.n + 1) AS o),
    a AS (SELECT idempotency_key, event_key, payload_hash, false AS stored FROM i WHERE event_id IN (SELECT taken FROM g) UNION ALL SELECT idempotency_key, event_key, payload_hash, true FROM r)
    SELECT event_id, CASE WHEN i.idempotency_key IS NULL THEN 'INVALID' WHEN event_id IN (SELECT taken FROM g) THEN 'ACCEPTED' WHEN a.payload_hash = i.payload_hash THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome
    FROM i LEFT JOIN a ON i.idempotency_key = a.idempotency_key AND i.event_key = a.event_key"""
)
def idempotent_admission(spark, sf):
    rows = t(spark, sf, "events").selectExpr(*(x.strip() for x in ("event_id", "CASE WHEN event_id % 101 <> 0 THEN concat('k', CAST(user_id AS STRING)) END AS idempotency_key", "concat('e', CAST(event_id - event_id % 3 AS STRING)) AS event_key", "event_type AS payload_hash")))
    stored = merge.latest(rows.where("event_id % 40 = 1 AND idempotency_key IS NOT NULL"), ["idempotency_key"], F.col("event_id"))
    return admission.admit(stored, rows.where("event_id % 40 <> 1"), "event_id").select("event_id", "outcome")


@query(
    """SELECT o_orderkey AS manifest, concat_ws(',', CASE WHEN total <> expected THEN 'total' END, CASE WHEN n <> o_orderkey % 7 THEN 'count' END) AS differences, total > 150 AS too_large FROM (
    SELECT o_orderkey, sum(CAST(l_quantity AS BIGINT)) AS total, count(*) AS n, 100 + o_orderkey % 3 AS expected FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"""
)
def manifest_agreement(spark, sf):
    lines = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("total"), F.count(F.lit(1)).alias("n"))
    out = t(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    compared = {"total": F.col("total") != 100 + F.col("o_orderkey") % 3, "count": F.col("n") != F.col("o_orderkey") % 7}
    names = F.concat_ws(",", *(F.when(c, F.lit(k)) for k, c in compared.items()))
    return out.select(F.col("o_orderkey").alias("manifest"), names.alias("differences"), (F.col("total") > 150).alias("too_large"))


@query(
    """SELECT l_orderkey AS manifest, sum(CAST(l_quantity AS BIGINT)) AS total, count(*) AS n, concat_ws(',', CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 OR count(*) <> 1 THEN 'INVALID_MANIFEST' END,
    CASE WHEN sum(CAST(l_quantity AS BIGINT)) > 150 THEN 'SOURCE_TOO_LARGE' END) AS problems FROM lineitem GROUP BY l_orderkey"""
)
def file_set_limits(spark, sf):
    listed = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("manifest"), F.col("l_quantity").cast("bigint").alias("size_bytes"), F.when(F.col("l_returnflag") == "R", "JSON").otherwise("CSV").alias("format"))
    return files.file_set_problems(listed, "manifest", limit=150).select("manifest", "total", "n", F.array_join("problems", ",").alias("problems"))


@query(
    """SELECT DISTINCT l_orderkey AS request, concat('b', CAST(l_linenumber % 2 AS STRING)) AS bucket, l_suppkey AS object_key FROM lineitem AS l WHERE NOT EXISTS
    (SELECT 1 FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey = l.l_orderkey AND l.l_linenumber % 2 = 0 AND o_custkey % 10 = l.l_suppkey % 10)"""
)
def record_source_files(spark, sf):
    lines, bucket = t(spark, sf, "lineitem"), F.concat(F.lit("b"), (F.col("l_linenumber") % 2).cast("string"))
    listed = lines.select(F.col("l_orderkey").alias("request"), bucket.alias("bucket"), F.col("l_suppkey").alias("object_key"))
    orders = t(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("request"), (F.col("o_custkey") % 10).alias("digit"))
    stored = listed.where("bucket = 'b0'").join(orders, "request").where(F.col("object_key") % 10 == F.col("digit"))
    return files.record_once(stored, listed)


AMOUNT = "CASE WHEN l_linenumber % 2 = 0 THEN concat(CAST(CAST(l_quantity AS BIGINT) AS STRING), '.00') ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END"


@query("SELECT l_partkey, l_returnflag, CAST(l_quantity AS BIGINT) AS amount, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag, l_quantity ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def collection_distinct(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("amount", rules.number(F.expr(AMOUNT)))
    first = merge.latest(rows, ["l_partkey", "l_returnflag", "amount"], F.col("l_orderkey"), F.col("l_linenumber"))
    return first.select("l_partkey", "l_returnflag", F.col("amount").cast("bigint").alias("amount"), "l_orderkey", "l_linenumber")


@query(
    """SELECT user_id AS job, count(*) AS listed, count(*) FILTER (event_id % 6 <> 4) AS processed, count(*) FILTER (event_id % 6 = 4) AS skipped,
    CASE WHEN count(*) FILTER (event_id % 6 = 5) = 0 THEN 'FAILED' WHEN count(*) FILTER (event_id % 6 = 4) > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS status FROM events GROUP BY user_id"""
)
def json_job_status(spark, sf):
    doc = t(spark, sf, "events").select("user_id", F.try_variant_get(F.try_parse_json(F.expr(VALUE)), "$.v", "variant").alias("v"))
    text, code = json_values.text_value(F.col("v"))
    g = doc.select("user_id", text.isNotNull().alias("usable"), code.alias("code")).groupBy(F.col("user_id").alias("job")).agg(
        F.count(F.lit(1)).alias("listed"), F.count_if(F.col("code").isNull()).alias("processed"), F.count_if(F.col("code").isNotNull()).alias("skipped"), F.bool_or("usable").alias("usable")
    )
    status = F.when(~F.col("usable"), "FAILED").when(F.col("skipped") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED")
    return g.select("job", "listed", "processed", "skipped", status.alias("status"))


@query("SELECT l_orderkey AS job, CASE WHEN count(*) FILTER (code IS NULL) = 0 THEN 'FAILED' WHEN count(*) FILTER (code IS NULL) = count(*) AND count(wcode) = 0 THEN 'COMPLETED' ELSE 'COMPLETED_WITH_ERRORS' END AS status FROM (" + VOLUME_SQL + ") GROUP BY l_orderkey")
def csv_job_status(spark, sf):
    g = _lines(spark, sf).groupBy("job").agg(F.count_if("valid").alias("accepted"), F.count(F.lit(1)).alias("n"), F.count_if(F.size("volume.errors") > 0).alias("errors"))
    return g.select("job", csv_stage.csv_status(F.col("accepted"), F.col("n"), F.col("errors")).alias("status"))


@query(
    """SELECT user_id AS job, row_number() OVER (PARTITION BY user_id ORDER BY kind_order, event_id) AS sequence, kind, event_id FROM (
    SELECT user_id, event_id, CASE WHEN event_id % 9 = 0 THEN 0 ELSE 1 END AS kind_order, CASE WHEN event_id % 9 = 0 THEN 'FILE_SKIPPED' ELSE 'SECTION_REJECTED' END AS kind
    FROM events WHERE event_id % 3 = 1 OR event_id % 9 = 0)"""
)
def json_rejections(spark, sf):
    text = F.when(F.col("event_id") % 9 == 0, F.concat(F.expr(NESTED), F.lit(" trailing"))).otherwise(F.expr(NESTED))
    doc = t(spark, sf, "events").select("user_id", "event_id", json_values.strict_document(text).alias("d"))
    skipped = doc.where("d is null").select("user_id", "event_id", F.lit(0).alias("kind_order"), F.lit("FILE_SKIPPED").alias("kind"))
    blocked = json_values.scalar(F.col("d"), "$.a.k")[1]
    rejected = doc.where(blocked.isNotNull()).select("user_id", "event_id", F.lit(1).alias("kind_order"), F.lit("SECTION_REJECTED").alias("kind"))
    order = Window.partitionBy("user_id").orderBy("kind_order", "event_id")
    return skipped.unionByName(rejected).select(F.col("user_id").alias("job"), F.row_number().over(order).alias("sequence"), "kind", "event_id")


@query(
    """SELECT l_orderkey AS job, l_linenumber AS sequence, CASE WHEN n = 1 THEN name END AS only_file, coalesce(CASE WHEN l_linestatus = 'F' THEN 'detail' END, l_returnflag) AS preview
    FROM lineitem JOIN (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS n, min(concat('f', CAST(l_suppkey AS STRING))) AS name FROM lineitem GROUP BY l_orderkey) ON l_orderkey = k"""
)
def issue_lookup(spark, sf):
    lines = t(spark, sf, "lineitem")
    name = F.concat(F.lit("f"), F.col("l_suppkey").cast("string"))
    single = lines.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n"), F.min(name).alias("name"))
    return lines.join(single, "l_orderkey").select(
        F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("sequence"), F.when(F.col("n") == 1, F.col("name")).alias("only_file"),
        F.coalesce(F.when(F.col("l_linestatus") == "F", "detail"), F.col("l_returnflag")).alias("preview"),
    )


@query(
    """SELECT 'quantity_range' AS rule, count(*) AS violations FROM lineitem WHERE l_quantity < 2 OR l_quantity > 48 UNION ALL SELECT 'flag_enum', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
    UNION ALL SELECT 'order_fk', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'part_fk', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 9 <> 0)"""
)
def constraint_audit(spark, sf):
    checks = {"quantity_range": F.col("l_quantity").between(2, 48), "flag_enum": F.col("l_returnflag").isin("A", "N")}
    keys = {"order_fk": ("l_orderkey", t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))), "part_fk": ("l_partkey", t(spark, sf, "part").where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("l_partkey")))}
    return review.audit(t(spark, sf, "lineitem"), checks, keys)


@query(
    """SELECT c_custkey, status, delivered, CASE WHEN delivered THEN 0 ELSE attempts + 1 END AS attempts, CASE WHEN NOT delivered THEN CAST(least(300, 10 * power(2, least(attempts, 5))) AS INTEGER) END AS next_delay_s FROM (
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'DELIVERED' ELSE 'PENDING' END AS status, c_custkey % 3 = 0 AS delivered, CAST(c_custkey % 8 AS INTEGER) AS attempts FROM customer)"""
)
def delivery_bookkeeping(spark, sf):
    delivered = F.col("c_custkey") % 3 == 0
    attempts = (F.col("c_custkey") % 8).cast("int")
    return t(spark, sf, "customer").select(
        "c_custkey", F.when(delivered, "DELIVERED").otherwise("PENDING").alias("status"), delivered.alias("delivered"),
        F.when(delivered, 0).otherwise(attempts + 1).alias("attempts"), F.when(~delivered, review.backoff_seconds(attempts + 1)).alias("next_delay_s"),
    )


@query("SELECT o_orderkey, concat('{\"id\":', CAST(o_orderkey AS STRING), ',\"type\":\"details.requested\",\"isin\":\"C', CAST(o_custkey AS STRING), '\",\"note\":', CASE WHEN o_orderkey % 2 = 0 THEN concat('\"', o_orderstatus, '\"') ELSE 'null' END, '}') AS payload FROM orders")
def request_events(spark, sf):
    event = F.struct(F.col("o_orderkey").alias("id"), F.lit("details.requested").alias("type"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("isin"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("note"))
    return t(spark, sf, "orders").select("o_orderkey", F.to_json(event, {"ignoreNullFields": "false"}).alias("payload"))


_K = "c_custkey"
_DOCUMENT = (
    f"concat('{{\"isin\":\"C', CAST({_K} + CASE WHEN {_K} % 10 = 0 THEN 1 ELSE 0 END AS STRING), '\",\"issuerName\":', CASE WHEN {_K} % 7 = 0 THEN '5' WHEN {_K} % 7 = 1 THEN '\"-\"' "
    f"ELSE concat('\"N', CAST(c_nationkey AS STRING), '\"') END, ',\"coupensVo\":{{\"couponDetails\":', CASE WHEN {_K} % 11 = 0 THEN '7' ELSE concat('{{\"couponRate\":\"', CAST({_K} % 9 + 1 AS STRING), '.5%\"}}') END, "
    f"'}},\"listingDetails\":', CASE WHEN {_K} % 13 = 0 THEN '\"x\"' ELSE concat('[{{\"exchangeName\":\"E', CAST({_K} % 3 AS STRING), '\"}},{{\"exchangeName\":4}}]') END, CASE WHEN {_K} % 17 = 0 THEN '}} trailing' ELSE '}}' END)"
)


def _json_files(spark, sf):
    """One JSON file about each customer, as a scan of files gives it."""
    path = F.concat(F.lit("b/C"), F.col(_K).cast("string"), F.lit("_details.json"))
    return t(spark, sf, "customer").select(path.alias("path"), F.lit("2026-01-01").cast("timestamp").alias("modificationTime"), F.expr(_DOCUMENT).cast("binary").alias("content"))


@query(
    """SELECT isin, row_number() OVER (PARTITION BY isin ORDER BY r, json_path) AS sequence, kind, json_path, code FROM (
    SELECT concat('C', CAST(c_custkey AS STRING)) AS isin, unnest([{'r': 1, 'hit': c_custkey % 17 = 0, 'kind': 'FILE_SKIPPED', 'json_path': '$', 'code': 'MALFORMED_JSON'},
    {'r': 2, 'hit': c_custkey % 17 <> 0 AND c_custkey % 11 = 0, 'kind': 'SECTION_REJECTED', 'json_path': '$.coupensVo.couponDetails', 'code': 'INVALID_TYPE'},
    {'r': 2, 'hit': c_custkey % 17 <> 0 AND c_custkey % 13 = 0, 'kind': 'SECTION_REJECTED', 'json_path': '$.listingDetails', 'code': 'INVALID_TYPE'},
    {'r': 3, 'hit': c_custkey % 17 <> 0 AND c_custkey % 7 = 0, 'kind': 'FIELD_REJECTED', 'json_path': '$.issuerName', 'code': 'INVALID_TYPE'},
    {'r': 4, 'hit': c_custkey % 17 <> 0 AND c_custkey % 13 <> 0, 'kind': 'ENTRY_SKIPPED', 'json_path': '$.listingDetails[1]', 'code': 'INVALID_TYPE'}], recursive := true) FROM customer) WHERE hit"""
)
def json_rejection_kinds(spark, sf):
    return securities.run_json(_json_files(spark, sf))["rejections"].select("isin", "sequence", "kind", "json_path", "code")


@query(
    """SELECT concat('C', CAST(c_custkey AS STRING)) AS isin, concat('The payload ISIN C', CAST(c_custkey + 1 AS STRING), ' differs from the file name''s ISIN C', CAST(c_custkey AS STRING), '; the file name''s is used.') AS warning
    FROM customer WHERE c_custkey % 10 = 0 AND c_custkey % 17 <> 0"""
)
def payload_isin_warnings(spark, sf):
    return securities.warnings(securities.read(_json_files(spark, sf))).select("isin", "warning")


@query(
    """WITH i AS (SELECT * FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 > 1 THEN concat('N', CAST(c_nationkey AS STRING)) END AS n, CASE WHEN c_custkey % 11 <> 0 THEN concat(CAST(c_custkey % 9 + 1 AS STRING), '.5') END AS r FROM customer WHERE c_custkey % 17 <> 0) WHERE n IS NOT NULL OR r IS NOT NULL),
    s AS (SELECT c_custkey AS k, 'N1' AS sn, CASE WHEN c_custkey % 6 <> 0 THEN '3.5' END AS sr, CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 4 = 0 THEN 'BSE_BHAVCOPY' ELSE 'NSDL' END AS src FROM customer WHERE c_custkey % 2 = 0),
    j AS (SELECT coalesce(s.k, i.k) AS k, s.k IS NULL AS fresh, n, r, sn, sr, src, n IS NOT NULL AND n IS DISTINCT FROM sn AS cn, r IS NOT NULL AND r IS DISTINCT FROM sr AND NOT coalesce(src = 'BSE_BHAVCOPY', false) AS cr FROM s FULL JOIN i ON s.k = i.k)
    SELECT concat('C', CAST(k AS STRING)) AS isin, CASE WHEN cn THEN n ELSE sn END AS issuer_name, CASE WHEN cr THEN r ELSE sr END AS coupon_rate, CASE WHEN cr THEN 'NSDL' ELSE src END AS coupon_rate_source, CAST(cn AS INTEGER) + CAST(cr AS INTEGER) AS fields_changed,
    CASE WHEN fresh THEN 't1' ELSE 't0' END AS created_at, CASE WHEN cn OR cr THEN 't1' ELSE 't0' END AS updated_at, concat_ws(',', CASE WHEN cr THEN 'coupon_rate' END, CASE WHEN cn THEN 'issuer_name' END) AS sourced FROM j"""
)
def security_publication(spark, sf):
    out = securities.run_json(_json_files(spark, sf))
    incoming = out["security"].join(out["field_sources"], "isin")
    kinds = {f: F.lit(None).cast("string") for f in securities.SCALARS} | {"issuer_name": F.lit("N1"), "coupon_rate": F.when(F.col(_K) % 6 != 0, "3.5")}
    source = F.when(F.col(_K) % 6 == 0, None).when(F.col(_K) % 4 == 0, merge.EXCHANGE).otherwise(merge.DETAILS)
    stored = t(spark, sf, "customer").where("c_custkey % 2 = 0").select(
        F.concat(F.lit("C"), F.col(_K).cast("string")).alias("isin"), *(v.alias(f) for f, v in kinds.items()), source.alias("coupon_rate_source"),
        F.expr("map()").cast(incoming.schema["field_sources"].dataType).alias("field_sources"), F.lit("t0").alias("created_at"), F.lit("t0").alias("updated_at"),
    )
    merged = securities.apply_changes(stored, incoming, incoming.limit(0), F.lit("t1"))
    sourced = F.array_join(F.array_sort(F.map_keys("field_sources")), ",")
    return merged.select("isin", "issuer_name", "coupon_rate", "coupon_rate_source", "fields_changed", "created_at", "updated_at", sourced.alias("sourced"))


@query("SELECT concat('C', CAST(c_custkey AS STRING)) AS isin, concat('E', CAST(c_custkey % 3 AS STRING)) AS exchange_name FROM customer WHERE c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 6 <> 0")
def collection_append(spark, sf):
    listing = securities.run_json(_json_files(spark, sf))["listing"]
    stored = t(spark, sf, "customer").where("c_custkey % 6 = 0").select(F.concat(F.lit("C"), F.col(_K).cast("string")).alias("isin"), F.lit("E0").alias("exchange_name"), F.lit(None).cast("string").alias("listing_date"))
    return securities.append_entries({"listing": stored}, {"listing": listing})[0]["listing"].select("isin", "exchange_name")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('{"sourceRecords":', CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE CAST(o_orderkey AS STRING) END, ',"acceptedRows":null,"invalidRows":null,"supersededRows":null}')
    WHEN 1 THEN concat('{"filesListed":', CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE CAST(o_orderkey % 4 AS STRING) END, ',"filesProcessed":null,"filesSkipped":null,"scalarFieldsChanged":null,"collectionEntriesAppended":null,"fieldsRejected":null}') END AS counts FROM orders"""
)
def job_counts(spark, sf):
    k = F.col("o_orderkey")
    dataset = F.when(k % 3 == 0, "urn:bond-platform:dataset:bse-debt-trades").when(k % 3 == 1, "urn:bond-platform:dataset:nsdl-security").otherwise("other")
    stored = F.when(k % 5 != 0, F.concat(F.lit('{"sourceRecords":'), k.cast("string"), F.lit(',"other":1,"filesListed":'), (k % 4).cast("string"), F.lit("}")))
    return t(spark, sf, "orders").select("o_orderkey", review.job_counts(dataset, stored).alias("counts"))


@query(
    """SELECT o_orderkey AS run, concat_ws(',', CASE WHEN o_orderkey % 4 = 0 THEN 'subject' END, CASE WHEN o_orderkey % 9 = 0 THEN 'data.event_id' END, CASE WHEN o_orderkey % 6 = 0 THEN 'data.run_id' END, CASE WHEN o_orderkey % 5 = 0 THEN 'data.inputs' END) AS differs FROM orders"""
)
def manifest_attributes(spark, sf):
    k = F.col("o_orderkey")
    base = {n: F.concat(F.lit(n), k.cast("string")) for n in files.AGREED if n != "inputs"}
    pairs = lambda a, b: F.map_from_arrays(F.array(F.lit(a[0]), F.lit(b[0])), F.array(a[1], b[1]))
    day, name = ("tradeDate", F.lit("2026-01-01")), ("exchangeName", F.col("o_orderstatus"))
    manifests = t(spark, sf, "orders").select(k.alias("run"), *(v.alias(n) for n, v in base.items()), pairs(day, name).alias("inputs"))
    other = base | {"subject": F.when(k % 4 == 0, "x").otherwise(base["subject"]), "run_id": F.when(k % 6 == 0, None).otherwise(base["run_id"]), "event_id": F.when(k % 9 == 0, "").otherwise(base["event_id"])}
    submitted = t(spark, sf, "orders").select(k.alias("run"), *(v.alias(n) for n, v in other.items()), pairs(name, ("tradeDate", F.when(k % 5 == 0, "2026-01-02").otherwise("2026-01-01"))).alias("inputs"))
    return files.disagreements(manifests, submitted).select("run", F.array_join("differs", ",").alias("differs"))


@query(
    """SELECT l_orderkey AS manifest, CASE WHEN count(*) FILTER (l_suppkey % 9 = 0) > 0 OR count(DISTINCT l_partkey % 2) > 1 OR min(l_partkey % 2) <> l_orderkey % 2 THEN 'INVALID_SOURCE_FILENAME' END AS problem FROM lineitem GROUP BY l_orderkey"""
)
def json_name_agreement(spark, sf):
    name = F.when(F.col("l_suppkey") % 9 == 0, "x.txt").otherwise(F.concat(F.lit("ine"), (F.col("l_partkey") % 2).cast("string"), F.lit("_details.json")))
    wanted = F.map_from_arrays(F.array(F.lit("isin_code")), F.array(F.concat(F.lit(" INE"), (F.col("l_orderkey") % 2).cast("string"))))
    listed = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("manifest"), F.concat(F.lit("k/"), name).alias("key"), wanted.alias("inputs"))
    return files.json_name_problems(listed)


_YEAR = "TIMESTAMP '1999-06-01' - INTERVAL 1 YEAR"


@query(
    f"""SELECT 'issue' AS kind, l_orderkey AS id, l_linenumber AS part FROM lineitem WHERE l_shipdate >= {_YEAR} AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < {_YEAR}) UNION ALL
    SELECT 'record', o_orderkey, 0 FROM orders WHERE o_orderdate >= {_YEAR} UNION ALL
    SELECT 'event', event_id, 0 FROM events WHERE NOT (event_id % 3 = 0 AND ts < (SELECT max(ts) FROM events) - INTERVAL 30 DAY)"""
)
def retention_cascade(spark, sf):
    issues = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("part"), F.col("l_shipdate").alias("created_at"))
    records = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("part"), F.col("o_orderdate").alias("created_at"))
    events = t(spark, sf, "events")
    moment = F.lit(events.agg(F.max("ts")).first()[0])
    events = events.select(F.col("event_id").alias("id"), F.lit(0).alias("part"), F.col("ts").alias("delivered_at"), F.when(F.col("event_id") % 3 == 0, "DELIVERED").otherwise("PENDING").alias("status"))
    kept = review.retained(issues, records, events.limit(0), F.lit("1999-06-01").cast("timestamp"), "id")[:2] + review.retained(issues.limit(0), records.limit(0), events, moment, "id")[2:]
    rows = [rows.select(F.lit(kind).alias("kind"), "id", F.col("part").cast("long").alias("part")) for rows, kind in zip(kept, ("issue", "record", "event"), strict=True)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    """SELECT o_orderkey AS job, 'FAILED' AS next_state, CASE WHEN o_orderkey % 2 = 0 THEN 'FAILED_TEMPORARY' ELSE 'ENDED' END AS next_run_state, CASE WHEN o_orderkey % 2 = 0 THEN 'ATTEMPT_ABANDONED' END AS run_code
    FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 1 HOUR ORDER BY o_orderdate, o_orderkey LIMIT 100"""
)
def stuck_sweep(spark, sf):
    state = F.when(F.col("o_orderkey") % 2 == 0, "RUNNING").otherwise("ENDED")
    jobs = t(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderdate", state.alias("run_state"))
    now = F.lit("1997-01-01").cast("timestamp")
    return review.sweep(jobs, review.stuck(F.col("o_orderdate"), now, F.lit(None).cast("timestamp")), "at", now).select("job", "next_state", "next_run_state", "run_code")
