"""The JSON data set: files about securities in, curated scalars, collections and review rows out.

All files of all securities are handled at once, one row per (file, scalar) and per (file, entry);
precedence is a window per (isin, field), never a driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import exact, json_values, numerals, rules
from tidewright.operators import merge
from tidewright.sources import files as sources

# Where the values of a security stand and their types.
SCALARS = {
    "issuer_name": ("$.issuerName", "text"),
    "issuer_ownership_type": ("$.issuerTypeOwner", "text"),
    "instrument_type": ("$.instrumentType", "text"),
    "allotment_date": ("$.instrumentsVo.instruments.allotmentDate", "date"),
    "redemption_date": ("$.instrumentsVo.instruments.redemptionDate", "date"),
    "original_face_value": ("$.instrumentsVo.instruments.issuePrice", "decimal"),
    "total_issue_size": ("$.instrumentsVo.instruments.totalIssueSize", "decimal"),
    "seniority_repayment": ("$.instrumentsVo.instruments.seniorityRepayment", "text"),
    "collateral_status": ("$.instrumentsVo.assetCover.securedFlag", "text"),
    "asset_coverage_basis": ("$.instrumentsVo.assetCover.assetCvge", "text"),
    "asset_coverage": ("$.instrumentsVo.assetCover.assetCvrPercent", "percent"),
    "coupon_rate": ("$.coupensVo.couponDetails.couponRate", "percent"),
    "coupon_type": ("$.coupensVo.couponDetails.couponType", "text"),
    "listing_status": ("$.listingStatus", "text"),
}
# The fields of collection entries, and where the collections stand.
_FLOW = {"event_type": ("cashFlowsEvent", "text"), "record_date": ("recordDate", "date"), "due_date": ("dueDate", "date")}
_PAID = {"payment_date": ("paymentDate", "date"), "new_face_value": ("newFaceVal", "decimal")}
_RATING = {
    "rating_agency_name": ("creditRatingAgencyName", "text"),
    "rating": ("currentRating", "text"),
    "outlook": ("outlook", "text"),
    "rating_action": ("ratingAction", "text"),
    "rating_date": ("creditRatingDate", "date"),
    "rating_change_date": ("ratingChangeDate", "date"),
    "verification_date": ("dateOfVerification", "date"),
}
_SCHEDULE = "$.coupensVo.cashFlowScheduleDetails"
#: collection -> (path, fields, target table, source category)
COLLECTIONS = {
    "cash_flows": (f"{_SCHEDULE}.cashFlowSchedule", {**_FLOW, "amount_payable": ("amountPayable", "decimal"), **_PAID}, "cash_flow", "SCHEDULE"),
    "interest_cash_flows": (f"{_SCHEDULE}.interestCashFlowSchedule", {**_FLOW, "amount_payable": ("amountRedeem", "decimal"), **_PAID}, "cash_flow", "INTEREST"),
    "listings": ("$.listingDetails", {"exchange_name": ("exchangeName", "text"), "listing_date": ("listingDate", "date")}, "listing", None),
    "current_ratings": ("$.currentRatings", _RATING, "rating", "CURRENT"),
    "earlier_ratings": ("$.earlierRatings", _RATING, "rating", "EARLIER"),
    "collateral_assets": ("$.instrumentsVo.assetCover.assetList", {"asset_type": ("assetType", "text"), "collateral_description": ("securityDetails", "text"), "remarks": ("remarks", "text")}, "collateral_asset", None),
}
COVERAGE = ("asset_coverage_basis", "asset_coverage")
PAYLOAD_ISIN = "$.isin"
# Kinds of rejected parts, in review order.
REJECTIONS = ("FILE_SKIPPED", "SECTION_REJECTED", "FIELD_REJECTED", "ENTRY_FIELDS_REJECTED", "ENTRY_SKIPPED", "VALUE_IGNORED")


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns v_<name> (JSON values) become <name> (exact text), <name>_code and <name>_raw (JSON as read), in one projection a step.

    Numbers are numerals as written, of at most 1,000 characters, percents of at most 30 digits on each side, and not
    negative; a numeral with an exponent is read in 38 digits.
    """
    out = df.withColumns({f"k_{n}": json_values.kind(F.col(f"v_{n}")) for n in kinds})
    out = out.withColumns({f"t_{n}": F.when(F.col(f"k_{n}") == "STRING", F.try_variant_get(f"v_{n}", "$", "string")) for n in kinds})
    numeral = {n: F.coalesce(numerals.marked(F.col(f"t_{n}")), F.lit(False)) for n in kinds}
    wrong = {n: F.col(f"k_{n}").isNotNull() & ~F.col(f"k_{n}").isin("STRING", "VOID") | (numeral[n] & F.lit(k in ("text", "date"))) for n, k in kinds.items()}
    out = out.withColumns(
        {f"{n}_code": F.when(w, rules.INVALID_TYPE) for n, w in wrong.items()}
        | {f"{n}_raw": numerals.json_text(F.col(f"v_{n}")) for n in kinds}
        | {f"t_{n}": F.when(~numeral[n], F.col(f"t_{n}")).when(F.lit(k not in ("text", "date")), _number_text(numerals.written(F.col(f"t_{n}")))) for n, k in kinds.items()}
    )
    shape = {"text": lambda c: c, "date": rules.strip, "decimal": rules.strip, "percent": lambda c: rules.keep_before_first_percent(c)[0]}
    out = out.withColumns({f"t_{n}": F.when(~rules.strip(F.col(f"t_{n}")).isin(*json_values.PLACEHOLDERS), shape[k](F.col(f"t_{n}"))) for n, k in kinds.items()})
    parse = {"text": rules.as_text, "date": rules.strict_date, "decimal": rules.normalize_grouped_number, "percent": rules.normalize_grouped_number}
    bound = {"decimal": rules.exact_decimal, "percent": rules.percent}
    for rule in (parse, bound):
        step: dict[str, Column] = {}
        for n, k in kinds.items():
            if k in rule:
                value, code = rule[k](F.col(f"t_{n}"))
                step |= {f"t_{n}": value, f"{n}_code": F.coalesce(F.col(f"{n}_code"), code)}
        out = out.withColumns(step) if step else out
    step = {n: F.when(exact.is_negative(F.col(f"t_{n}")), rules.NEGATIVE_VALUE) if k in bound else rules.none() for n, k in kinds.items()}
    out = out.withColumns({n: F.when(step[n].isNull(), F.col(f"t_{n}")) for n in kinds} | {f"{n}_code": F.coalesce(F.col(f"{n}_code"), step[n]) for n in kinds})
    return out.drop(*(f"{x}_{n}" for n in kinds for x in "vkt"))


def _number_text(numeral: Column) -> Column:
    """A JSON numeral in plain digits."""
    wide = exact.plain(numeral.try_cast("decimal(38,10)").cast("string"))
    return F.when(numeral.rlike("[eE]"), F.coalesce(wide, numeral)).otherwise(numeral)


def read(files: DataFrame) -> DataFrame:
    """(path, isin, modified, document, error)."""
    docs = sources.json_documents(files)
    return docs.select("path", sources.json_name(rules.base_name(F.col("path"))).alias("isin"), F.col("modificationTime").alias("modified"), "document", "error")


def scalars(docs: DataFrame) -> DataFrame:
    """One row per file and contract scalar that is present, rejected or blocked."""
    found = {n: json_values.scalar(F.col("document"), path) for n, (path, _) in SCALARS.items()}
    rows = docs.where(F.col("error").isNull()).select("path", "isin", "modified", *(v.alias(f"v_{n}") for n, (v, _) in found.items()), *(b.alias(f"b_{n}") for n, (_, b) in found.items()))
    rows = typed(rows, {n: kind for n, (_, kind) in SCALARS.items()})
    cells = [
        F.struct(F.lit(i).alias("place"), F.lit(n).alias("field"), F.lit(path).alias("json_path"), F.col(n).alias("value"), F.col(f"{n}_code").alias("code"), F.col(f"b_{n}").alias("blocked"), F.col(f"{n}_raw").alias("raw"))
        for i, (n, (path, _)) in enumerate(SCALARS.items())
    ]
    out = rows.select("path", "isin", "modified", F.explode(F.array(*cells)).alias("c")).select("path", "isin", "modified", "c.*")
    return out.where("value is not null or code is not null or blocked is not null")


def entries(docs: DataFrame, name: str) -> DataFrame:
    """One row per element of a collection; usable if any of its fields has a value."""
    path, fields, _, category = COLLECTIONS[name]
    good = docs.where(F.col("error").isNull())
    rows = json_values.collection(good, "document", path)
    rows = rows.select("path", "isin", "modified", "pos", "element_path", *(F.try_variant_get("value", f"$.{key}", "variant").alias(f"v_{f}") for f, (key, _) in fields.items()))
    rows = typed(rows, {f: kind for f, (_, kind) in fields.items()})
    def error(place: int, field: str, key: str) -> Column:
        told = F.struct(F.lit(place).alias("place"), F.lit(field).alias("field"), F.concat("element_path", F.lit(f".{key}")).alias("json_path"), F.col(f"{field}_code").alias("code"), F.col(f"{field}_raw").alias("value"))
        return F.when(F.col(f"{field}_code").isNotNull(), told)

    errors = F.array_compact(F.array(*(error(i, f, key) for i, (f, (key, _)) in enumerate(fields.items()))))
    raw = F.to_json(F.struct(*(F.col(f) for f in fields)))
    out = rows.select("path", "isin", "modified", "pos", "element_path", *fields, errors.alias("errors"), raw.alias("selected"))
    usable = F.coalesce(*(F.col(f) for f in fields)).isNotNull()
    return out.withColumn("usable", usable).withColumn("source_category", F.lit(category).cast("string"))


def unsecured(field: Column, value: Column) -> Column:
    return (field == "collateral_status") & (F.lower(value) == "unsecured")


def run_json(files: DataFrame) -> dict[str, DataFrame]:
    """security, field_sources, the four collection tables, cleared, conflicts, rejections and their issues, and the outcome per security.

    A file's values beside its own Unsecured (coverage and assets) are conflicts: told, and not used. Every issue
    counts as an error of the job, warnings do not.
    """
    # every output reads these: parsed and typed once, kept in the shared folder
    docs = sources.kept(read(files))
    found = sources.kept(scalars(docs))
    covers = F.col("field").isin(*COVERAGE) & F.col("value").isNotNull()
    screened = merge.screen_conflicts(found, ["path"], unsecured(F.col("field"), F.col("value")), covers)
    bare = found.where(unsecured(F.col("field"), F.col("value"))).select("path").distinct().withColumn("conflict", F.lit(True))
    winners = merge.latest(screened.where("value is not null and not conflict"), ["isin", "field"], F.desc("modified"), F.desc("path"))
    cleared = winners.where(unsecured(F.col("field"), F.col("value"))).select("isin").distinct()
    wiped = cleared.withColumn("_cleared", F.lit(True))
    applied = winners.join(wiped, "isin", "left").where(~(F.coalesce("_cleared", F.lit(False)) & F.col("field").isin(*COVERAGE)))
    tables: dict[str, DataFrame] = {}
    used = screened.where("value is not null and not conflict").select("isin")
    rejected = found.where("code is not null or blocked is not null").select("isin", F.lit(1).alias("n"))
    parts = {name: sources.kept(entries(docs, name)) for name in COLLECTIONS}
    assets = parts["collateral_assets"].join(bare, "path", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)) & F.col("usable"))
    for place, (name, (_, fields, target, _)) in enumerate(COLLECTIONS.items()):
        rows = assets.where("not conflict") if name == "collateral_assets" else parts[name]
        used = used.unionByName(rows.where("usable").select("isin"))
        rejected = rejected.unionByName(parts[name].select("isin", F.size("errors").alias("n")).where("n > 0"))
        rows = rows.join(cleared, "isin", "left_anti") if name == "collateral_assets" else rows
        kept = rows.where("usable").select("isin", "source_category", *fields, F.lit(place).alias("list"), "modified", "path", "pos", "element_path")
        tables[target] = tables[target].unionByName(kept) if target in tables else kept
    for target, rows in tables.items():
        fields = next(f for _, f, t, _ in COLLECTIONS.values() if t == target)
        numbers = {f: exact.plain(F.col(f)) for f, (_, kind) in fields.items() if kind == "decimal"}
        # Stored cash flows are the same whatever list named them; ratings are told apart by it.
        identity = ["isin", *fields] + (["source_category"] if target == "rating" else [])
        tables[target] = merge.latest(rows.withColumns(numbers), identity, F.col("list"), F.col("modified"), F.col("path"), F.col("pos")).drop("list")
    blocked = found.where("blocked is not null").select("path", "isin", F.col("blocked").alias("json_path")).dropDuplicates(["path", "json_path"])
    ignored = screened.where("conflict").select("isin", "path", F.lit(0).alias("list"), "place", "json_path", F.col("raw").alias("value"), F.lit("Ignored the supplied coverage.").alias("action"))
    ignored = ignored.unionByName(assets.where("conflict").select("isin", "path", F.lit(1).alias("list"), F.col("pos").alias("place"), F.col("element_path").alias("json_path"), F.col("selected").alias("value"), F.lit("Did not record the supplied asset.").alias("action")))
    rejected_parts = rejections(docs, found, ignored, parts)
    told = issues(rejected_parts)
    return tables | {
        "security": applied.groupBy("isin").pivot("field", list(SCALARS)).agg(F.first("value")),
        "field_sources": applied.groupBy("isin").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("path", "json_path")))).alias("field_sources")),
        "cleared": cleared,
        "conflicts": ignored.select("path", "isin", "json_path", "value", F.lit(rules.CONFLICTING_COLLATERAL).alias("code"), "action"),
        "structure_issues": blocked,
        "rejections": rejected_parts,
        "rejected_records": rejected_parts.select("isin", "sequence", "path", "kind", F.to_json(F.struct("json_path", "issues"), {"ignoreNullFields": "false"}).alias("record")),
        "issues": told,
        "warnings": warnings(docs),
        "jobs": jobs(docs, used, rejected, told),
    }


def jobs(docs: DataFrame, used: DataFrame, rejected: DataFrame, told: DataFrame) -> DataFrame:
    """Per security: files listed, processed and skipped, fields rejected (those behind a wrong section too), errors and status.

    No usable value in any file is FAILED; else any issue at all is COMPLETED_WITH_ERRORS.
    """
    per = docs.groupBy("isin").agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("skipped"))
    for rows, name in ((used.groupBy("isin").agg(F.count(F.lit(1)).alias("values")), "values"), (rejected.groupBy("isin").agg(F.sum("n").alias("fields_rejected")), "fields_rejected"), (told.groupBy("isin").agg(F.count(F.lit(1)).alias("errors")), "errors")):
        per = per.join(rows, "isin", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return per.withColumn("status", F.when(F.col("values") == 0, "FAILED").when(F.col("errors") > 0, "COMPLETED_WITH_ERRORS").otherwise("COMPLETED"))


def outcomes(jobs: DataFrame, changed: DataFrame, appended: DataFrame) -> DataFrame:
    """isin, status, errors and the six agreed counts as JSON, once the changes (fields_changed) and appended entries are known."""
    out = jobs.join(changed.select("isin", "fields_changed"), "isin", "left").join(appended.select("isin", "entries_appended"), "isin", "left")
    names = {"filesListed": "listed", "filesProcessed": "processed", "filesSkipped": "skipped", "scalarFieldsChanged": "fields_changed", "collectionEntriesAppended": "entries_appended", "fieldsRejected": "fields_rejected"}
    return out.select("isin", "status", "errors", F.to_json(F.struct(*(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in names.items()))).alias("counts"))


_ISSUE = "array<struct<field:string,json_path:string,code:string,value:string,action:string>>"


def rejections(docs: DataFrame, found: DataFrame, ignored: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """Rejected parts of all files, numbered per security in review order: by file, kind, list, place; each with its issues.

    A skipped file has no other part. Sections of the wrong kind are told once a file; an entry with wrong fields is
    skipped if no field of it has a value; values that an unsecured statement overrules are ignored. An issue keeps the
    value as read, as JSON with its type. code, field and value are those of the first issue.
    """
    none, zero = F.lit(None).cast("string"), F.lit(0)

    def issue(field: Column, path: Column, code: Column, value: Column, action: Column = none) -> Column:
        return F.array(F.struct(field.alias("field"), path.alias("json_path"), code.alias("code"), value.alias("value"), action.alias("action"))).cast(_ISSUE)

    def part(rows: DataFrame, kind: Column | str, place: Column, path: Column, told: Column, group: Column = zero) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return rows.select("isin", "path", kind.alias("kind"), group.cast("int").alias("list"), place.cast("int").alias("place"), path.alias("json_path"), told.alias("issues"))

    whole = F.lit("$")
    out = part(docs.where("error is not null"), "FILE_SKIPPED", zero, whole, issue(none, whole, F.col("error"), none))
    sections = found.where("blocked is not null").select("isin", "path", F.col("blocked").alias("p"))
    for _, (path, _, _, _) in COLLECTIONS.items():
        value, blocked = json_values.scalar(F.col("document"), path)
        kind = json_values.kind(value)
        wrong = F.coalesce(blocked, F.when(kind.isNotNull() & ~kind.isin("ARRAY", "VOID"), path))
        sections = sections.unionByName(docs.where("error is null").select("isin", "path", wrong.alias("p")).where("p is not null"))
    sections = sections.dropDuplicates(["path", "p"])
    out = out.unionByName(part(sections, "SECTION_REJECTED", zero, F.col("p"), issue(none, F.col("p"), F.lit(rules.INVALID_TYPE), none)))
    out = out.unionByName(part(found.where("code is not null"), "FIELD_REJECTED", F.col("place"), F.col("json_path"), issue(F.col("field"), F.col("json_path"), F.col("code"), F.col("raw"))))
    for n, name in enumerate(COLLECTIONS):
        wrong = parts[name].where("size(errors) > 0")
        kind = F.when(F.col("usable"), "ENTRY_FIELDS_REJECTED").otherwise("ENTRY_SKIPPED")
        told = F.transform("errors", lambda e: F.struct(e["field"].alias("field"), e["json_path"].alias("json_path"), e["code"].alias("code"), e["value"].alias("value"), none.alias("action"))).cast(_ISSUE)
        out = out.unionByName(part(wrong, kind, F.col("pos"), F.col("element_path"), told, F.lit(n)))
    code = F.lit(rules.CONFLICTING_COLLATERAL)
    out = out.unionByName(part(ignored, "VALUE_IGNORED", F.col("place"), F.col("json_path"), issue(none, F.col("json_path"), code, F.col("value"), F.col("action")), F.col("list")))
    rank = F.array_position(F.array(*map(F.lit, REJECTIONS)), F.col("kind"))
    rank = F.when(rank == 5, 4).otherwise(rank)  # both kinds of entries stand where they stand in the file
    order = Window.partitionBy("isin").orderBy("path", rank, "list", "place", "json_path")
    first = F.element_at("issues", 1)
    return out.withColumn("sequence", F.row_number().over(order)).withColumns({c: first[c] for c in ("field", "code", "value")})


def issues(rejections: DataFrame) -> DataFrame:
    """One row per error of the rejected parts, numbered per security through all parts."""
    rows = rejections.select("isin", "path", "kind", F.col("sequence").alias("part"), F.posexplode("issues").alias("pos", "i"))
    order = Window.partitionBy("isin").orderBy("part", "pos")
    return rows.select("isin", F.row_number().over(order).alias("sequence"), "part", "path", "kind", "i.*")


def warnings(docs: DataFrame) -> DataFrame:
    """Files whose payload names another ISIN than their name; the name's is used."""
    text, _ = json_values.text_value(F.try_variant_get("document", PAYLOAD_ISIN, "variant"))
    other = rules.identity_text(text)
    told = F.concat(F.lit("The payload ISIN "), other, F.lit(" differs from the file name's ISIN "), F.col("isin"), F.lit("; the file name's is used."))
    return docs.where("error is null").select("path", "isin", F.when(other != rules.identity_text(F.col("isin")), told).alias("warning")).where("warning is not null")


def apply_changes(stored: DataFrame, incoming: DataFrame, cleared: DataFrame, now: Column) -> DataFrame:
    """Merge incoming scalars into stored securities: a missing value keeps, a cleared one erases.

    A stored coupon of an exchange (coupon_rate_source, where there is such a column) is kept, even one without a rate:
    the files' rate is its backup. Where a value changes, updated_at is `now`; created_at is the first `now`.
    field_sources, a map by field on both sides where there, follows the fields that change and loses those erased.
    """
    gone = cleared.select("isin").distinct().withColumn("_gone", F.lit(True))
    joined = stored.alias("s").join(incoming.alias("i"), "isin", "full_outer").join(gone, "isin", "left")
    wiped = F.coalesce("_gone", F.lit(False))
    changed = {}
    for f in SCALARS:
        old, new = F.col(f"s.{f}"), F.col(f"i.{f}")
        changed[f] = merge.number_change(old, new) if SCALARS[f][1] in ("decimal", "percent") else merge.scalar_change(old, new)
        if f in COVERAGE:
            changed[f] = (~wiped & changed[f]) | (wiped & old.isNotNull())
        if f == "coupon_rate" and "coupon_rate_source" in stored.columns:
            changed[f] = changed[f] & ~(F.col("s.coupon_rate_source").eqNullSafe(F.lit(merge.EXCHANGE)))
    count = sum((c.cast("int") for c in changed.values()), F.lit(0))
    values = [F.when(changed[f], F.when(wiped, F.lit(None)).otherwise(F.col(f"i.{f}")) if f in COVERAGE else F.col(f"i.{f}")).otherwise(F.col(f"s.{f}")).alias(f) for f in SCALARS]
    also = []
    if "coupon_rate_source" in stored.columns:
        also.append(F.when(changed["coupon_rate"], merge.DETAILS).otherwise(F.col("s.coupon_rate_source")).alias("coupon_rate_source"))
    if "created_at" in stored.columns:
        also.append(F.coalesce("s.created_at", now).alias("created_at"))
    if "field_sources" in stored.columns and "field_sources" in incoming.columns:
        names = F.array_compact(F.array(*(F.when(c, f) for f, c in changed.items())))
        erased = F.array_compact(F.array(*(F.when(changed[f] & wiped, f) for f in COVERAGE)))
        none = F.expr("map()").cast(stored.schema["field_sources"].dataType)
        kept = F.map_filter(F.coalesce("s.field_sources", none), lambda k, _: ~F.array_contains(names, k))
        new = F.map_filter(F.coalesce(F.col("i.field_sources"), none), lambda k, _: F.array_contains(names, k) & ~F.array_contains(erased, k))
        also.append(F.map_concat(kept, new).alias("field_sources"))
    return joined.select("isin", *values, *also, count.alias("fields_changed"), F.when(count > 0, now).otherwise(F.col("s.updated_at")).alias("updated_at"))


def append_entries(stored: dict[str, DataFrame], tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the entries of each collection table that are not stored yet, their number per security).

    Identity is every value of the entry; ratings are told apart by their list too.
    """
    fresh, counted = {}, None
    for target, rows in tables.items():
        fields = next(f for _, f, t, _ in COLLECTIONS.values() if t == target)
        identity = ["isin", *fields] + (["source_category"] if target == "rating" else [])
        fresh[target] = merge.append_only(stored[target], rows, identity, [F.col("modified"), F.col("path"), F.col("pos")])
        per = fresh[target].groupBy("isin").agg(F.count(F.lit(1)).alias("n"))
        counted = per if counted is None else counted.unionByName(per)
    return fresh, counted.groupBy("isin").agg(F.sum("n").alias("entries_appended"))
