"""Validation of delimited records: fields, row rules, duplicates, dispositions, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import exact, rules
from tidewright.plans.contracts import FieldSpec, MappingContract, RowRule, SourceContract


def _settled(c: Column) -> Column:
    """The same value, which no later filter takes apart.

    A filter (or the one that an explode implies) that Spark moves below the projections is written anew in terms of
    the raw text, with every rule in it once for each mention of its result. What depends on the task's number is not moved.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def validate_fields(records: DataFrame, fields: tuple[FieldSpec, ...]) -> DataFrame:
    """Replace each field's text by struct(raw, normalized, parsed, status, errors).

    Every normalizer is a projection of its own over all fields: a rule reads its input several times,
    and one nested expression would compute all earlier rules again for each reading.
    """
    v, c = (lambda f: f"_v_{f.name}"), (lambda f: f"_c_{f.name}")
    out = records.withColumns({v(f): F.col(f.name) for f in fields} | {c(f): rules.none() for f in fields})
    for k in range(max(len(f.normalizers) for f in fields)):
        step: dict[str, Column] = {}
        for f in fields:
            if k < len(f.normalizers):
                value, code = rules.normalize(F.col(v(f)), f.normalizers[k : k + 1])
                step |= {v(f): value, c(f): F.coalesce(F.col(c(f)), code)}
        out = out.withColumns(step)
    step = {}
    for f in fields:
        parsed, code = rules.PARSERS[f.type](F.col(v(f)))
        missing = F.when(F.col(v(f)).isNull() & F.col(c(f)).isNull(), rules.REQUIRED_VALUE_MISSING) if f.required else rules.none()
        step |= {f"_p_{f.name}": parsed, f"_e_{f.name}": F.array_compact(F.array(missing, F.coalesce(F.col(c(f)), code)))}
    out = out.withColumns(step)
    out = out.withColumns({f"_e_{f.name}": F.concat(f"_e_{f.name}", rules.validate(F.col(f"_p_{f.name}"), f.validators)) for f in fields})
    structs = {}
    for f in fields:
        status = F.when(F.size(f"_e_{f.name}") == 0, "PASSED").otherwise("IGNORED" if f.ignore_invalid else "FAILED")
        structs[f.name] = F.struct(
            F.col(f.name).alias("raw"), F.col(v(f)).alias("normalized"), F.col(f"_p_{f.name}").alias("parsed"), status.alias("status"), F.col(f"_e_{f.name}").alias("errors")
        )
        structs[f.name] = _settled(structs[f.name])
    return out.withColumns(structs).drop(*(f"_{x}_{f.name}" for f in fields for x in "vcpe"))


def _rule_error(rule: RowRule) -> Column:
    left, right = (F.col(f"{side}.parsed") for side in (rule.left, rule.right))
    both = (F.col(f"{rule.left}.status") == "PASSED") & (F.col(f"{rule.right}.status") == "PASSED") & left.isNotNull() & right.isNotNull()
    return F.when(both & (exact.less(left, right) if rule.op == ">=" else exact.less(right, left)), rules.PRICE_INCONSISTENT)


def validate_rows(records: DataFrame, contract: SourceContract) -> DataFrame:
    """Replace each contract field's text by its struct; add row_errors and valid."""
    out = validate_fields(records, contract.fields)
    found = F.array_compact(F.array(*map(_rule_error, contract.rules))) if contract.rules else F.expr("cast(array() as array<string>)")
    out = out.withColumn("row_errors", found)
    failed = [F.col(f"{f.name}.status") == "FAILED" for f in contract.fields]
    bad = F.size("row_errors") > 0
    for f in failed:
        bad = bad | f
    return out.withColumn("valid", _settled(~bad))


def dispositions(rows: DataFrame, group: str | list[str], key: Column, record: str = "record_number", valid: str = "valid") -> DataFrame:
    """The last valid row per key stays; earlier valid ones are superseded by it; invalid rows never displace."""
    spec = Window.partitionBy(*([group] if isinstance(group, str) else group), key)
    last = F.max(F.when(F.col(valid), F.col(record))).over(spec)
    out = rows.withColumn("_last", last)
    return out.withColumn(
        "disposition",
        F.when(~F.col(valid), "QUARANTINED_INVALID").when(key.isNotNull() & (F.col(record) < F.col("_last")), "QUARANTINED_SUPERSEDED").otherwise("ACCEPTED"),
    ).withColumn("superseded_by", F.when(F.col("disposition") == "QUARANTINED_SUPERSEDED", F.col("_last"))).drop("_last")


def counts(rows: DataFrame, *by: str) -> DataFrame:
    """Source, accepted, invalid and superseded rows per file, and the job status they give."""
    n = {"accepted": "ACCEPTED", "invalid": "QUARANTINED_INVALID", "superseded": "QUARANTINED_SUPERSEDED"}
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("source_rows"), *(F.count_if(F.col("disposition") == d).alias(f"{k}_rows") for k, d in n.items())
    )
    return out.withColumn("job_status", csv_status(F.col("accepted_rows"), F.col("source_rows"), F.lit(0)))


def csv_status(accepted: Column, source: Column, errors: Column) -> Column:
    return F.when(accepted == 0, "FAILED").when((accepted == source) & (errors == 0), "COMPLETED").otherwise("COMPLETED_WITH_ERRORS")


def issues(rows: DataFrame, contract: SourceContract, *by: str) -> DataFrame:
    """One row per error of rows that go to review, numbered by record, field, then row errors."""
    listed = [
        F.transform(f"{f.name}.errors", _issue(i, f.name)) for i, f in enumerate(contract.fields)
    ] + [F.transform("row_errors", _issue(len(contract.fields), None))]
    superseded = F.when(F.col("disposition") == "QUARANTINED_SUPERSEDED", F.array(_named(len(contract.fields) + 1, None, F.lit(rules.DUPLICATE_SUPERSEDED))))
    none = F.expr("cast(array() as array<struct<place:int,field:string,code:string>>)")
    out = rows.select(*by, "record_number", F.explode(F.concat(*listed, F.coalesce(superseded, none))).alias("issue"))
    order = Window.partitionBy(*by).orderBy("record_number", "issue.place", "issue.code")
    return out.select(*by, F.row_number().over(order).alias("sequence"), "record_number", "issue.field", "issue.code")


def _named(place: int, name: str | None, code: Column) -> Column:
    return F.struct(F.lit(place).alias("place"), F.lit(name).cast("string").alias("field"), code.alias("code"))


def _issue(place: int, name: str | None):
    return lambda code: _named(place, name, code)


def _mapped(mapping: MappingContract) -> list[Column]:
    values = [F.when(F.col(f"{s}.status") != "IGNORED", F.col(f"{s}.parsed")).alias(t) for t, s in mapping.columns.items()]
    return [*values, *(F.lit(v).alias(k) for k, v in mapping.constants.items())]


def project(rows: DataFrame, mapping: MappingContract, *also: str) -> DataFrame:
    """Accepted rows renamed by the mapping; ignored fields become null; constants are added."""
    return rows.where(F.col("disposition") == "ACCEPTED").select(*also, *_mapped(mapping))


def project_each(rows: DataFrame, mappings: list[MappingContract], *also: str) -> DataFrame:
    """A row per accepted row and mapping, all from one reading of the rows; the mappings name the same columns in one order."""
    lists = F.array(*(F.struct(*_mapped(m)) for m in mappings))
    return rows.where(F.col("disposition") == "ACCEPTED").select(*also, F.explode(lists).alias("_row")).select(*also, "_row.*")
