"""JSON values as Spark variants: presence, typed reads, paths, structure issues, canonical text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import numerals
from tidewright.functions.rules import INVALID_TYPE, none, strip

#: Texts that mean "no update".
PLACEHOLDERS = ("", "-", "N.A.")
#: Fixed value: how deep objects and arrays may nest.
MAX_DEPTH = 32
_END = "end-of-document-5f0c"
_NUL = r"(?<!\\)(?:\\\\)*\\u0000"  # the escape itself, not a backslash followed by u0000
_STRING = r'"(?:[^"\\]|\\.)*"'


def depth(text: Column) -> Column:
    """How deep the brackets of a JSON text nest, those inside strings left out."""
    marks = F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^\[\]{}]", "")
    level = lambda acc, m: acc["now"] + F.when(m.isin("[", "{"), 1).otherwise(-1)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda acc, m: F.struct(level(acc, m).alias("now"), F.greatest(acc["most"], level(acc, m)).alias("most"))
    return F.aggregate(F.filter(F.split(marks, ""), lambda m: m != ""), start, step, lambda acc: acc["most"])


def strict_document(text: Column, keep_numerals: bool = False) -> Column:
    """The variant of a strict JSON document, null if malformed: trailing content, duplicate names, NUL and too deep nesting fail.

    With keep_numerals each number is a marked string (numerals.MARK) of the numeral as it was written.
    """
    clean = F.regexp_replace(text, "^\ufeff", "")
    wrapped = F.try_parse_json(F.concat(F.lit("["), clean, F.lit(f',"{_END}"]')))
    complete = (F.try_variant_get(wrapped, "$[1]", "string") == _END) & F.try_variant_get(wrapped, "$[2]", "string").isNull()
    shallow = (F.length(F.regexp_replace(clean, r"[^\[{]", "")) <= MAX_DEPTH) | (depth(clean) <= MAX_DEPTH)
    strict = complete & ~clean.rlike(_NUL) & ~clean.contains("\0") & shallow
    return F.when(strict, F.try_parse_json(numerals.keep(clean) if keep_numerals else clean))


def kind(value: Column) -> Column:
    """STRING, VOID (JSON null), OBJECT, ARRAY, a number kind or BOOLEAN; null if missing."""
    return F.regexp_extract(F.schema_of_variant(value), r"^[A-Z]+", 0)


def presence(value: Column) -> Column:
    """MISSING, NULL, PLACEHOLDER or PRESENT."""
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull(), "MISSING")
        .when(F.is_variant_null(value), "NULL")
        .when((kind(value) == "STRING") & strip(text).isin(*PLACEHOLDERS), "PLACEHOLDER")
        .otherwise("PRESENT")
    )


def text_value(value: Column) -> tuple[Column, Column]:
    """Only strings are text; anything else present is INVALID_TYPE."""
    here = presence(value) == "PRESENT"
    is_text = kind(value) == "STRING"
    return F.when(here & is_text, F.try_variant_get(value, "$", "string")), F.when(here & ~is_text, INVALID_TYPE).otherwise(none())


def scalar(document: Column, path: str) -> tuple[Column, Column]:
    """(value, blocking path): missing or null on the way is missing, another kind on the way blocks."""
    names = path.removeprefix("$.").split(".")
    blocked = none()
    for n in range(1, len(names)):
        prefix = "$." + ".".join(names[:n])
        at = F.try_variant_get(document, prefix, "variant")
        wrong = at.isNotNull() & ~F.coalesce(F.is_variant_null(at), F.lit(False)) & (kind(at) != "OBJECT")
        blocked = F.coalesce(blocked, F.when(wrong, prefix))
    return F.try_variant_get(document, path, "variant"), blocked


def collection(df: DataFrame, document: str, path: str) -> DataFrame:
    """One row per element of the array at `path`: pos, value and its own path; other kinds give none."""
    array = F.try_variant_get(F.col(document), path, "variant")
    elements = F.when(kind(array) == "ARRAY", array.cast("array<variant>"))
    return df.select("*", F.posexplode(elements).alias("pos", "value")).withColumn(
        "element_path", F.concat(F.lit(f"{path}["), F.col("pos").cast("string"), F.lit("]"))
    )


def canonical_text(text: Column) -> Column:
    """JSON with sorted property names and no spacing, numerals as they were written."""
    return numerals.canonical(text)


def canonical_hash(text: Column) -> Column:
    return F.sha2(canonical_text(text), 256)
