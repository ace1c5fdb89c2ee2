"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is turned into a Boolean trigram query (an OR of ANDs). Postings are
sets of document ids per (trigram, hash bucket of the id), so ids may be any numbers and a bucket stays
near BUCKET_IDS ids; a query intersects and unites them. Documents that the postings admit are verified
with the rule itself; a rule without mandatory trigrams scans all.

Defined cases: null text is empty; a null document id is scanned in full, because postings cannot
name it; repeated ids and rows each get their own result; an empty table gives an empty result; all
other columns are ignored, whatever their names. Texts of any length are scanned whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from dataclasses import dataclass
from re import _parser as sre

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import materialize, text_rows


@dataclass(frozen=True)
class Rule:
    """A span is a match of `pattern` whose `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("forge", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40, base=False),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 16, base=False),
)
#: The widest candidate list that is broadcast; a longer one is joined by a shuffle on the id.
BROADCAST_ROWS = 1_000_000
_STATES = 64
#: Document ids per bucket of the postings, on average.
BUCKET_IDS = 32_768


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives, each a set of lower-case trigrams that every match has; None if some match needs none.

    States are (trigrams so far, literal run). Anything but a literal, a small class, a branch or an
    optional part ends the run, which only makes the query weaker, never wrong.
    """

    def closed(run: str) -> frozenset[str]:
        low = run.lower()
        return frozenset(low[i : i + 3] for i in range(len(low) - 2))

    def walk(nodes: Iterable, states: set[tuple[frozenset[str], str]]) -> set[tuple[frozenset[str], str]]:
        for op, arg in nodes:
            before = states
            if op is sre.LITERAL and arg < 128:
                states = {(t, run + chr(arg)) for t, run in states}
            elif op is sre.IN and len(arg) <= 6 and all(o is sre.LITERAL and a < 128 for o, a in arg):
                states = {(t, run + chr(a)) for t, run in states for _, a in arg}
            elif op is sre.SUBPATTERN:
                states = walk(arg[-1], states)
            elif op is sre.BRANCH:
                states = set().union(*(walk(branch, before) for branch in arg[1]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[:2] == (0, 1):
                states = before | walk(arg[2], before)
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                states = {(t | closed(run), "") for t, run in walk(arg[2], before)}
            else:
                states = {(t | closed(run), "") for t, run in before}
            if len(states) > _STATES:
                states = {(t | closed(run), "") for t, run in before}
        return states

    found = {t | closed(run) for t, run in walk(sre.parse(pattern), {(frozenset(), "")})}
    least = [t for t in found if not any(other < t for other in found)]
    return None if frozenset() in found else sorted(least, key=sorted)


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, bucket, ids) of the given trigrams over whole lower-cased texts."""
    asked = F.array(*(F.lit(t) for t in trigrams))
    held = _let(F.lower("text"), lambda low: F.filter(asked, lambda t: F.contains(low, t)))
    buckets = max(1, math.ceil(docs.count() / BUCKET_IDS))
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")
    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(held).alias("trigram")).groupBy("trigram", bucket).agg(F.collect_set("doc_id").alias("ids"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(rule_no, bucket, ids): documents whose postings satisfy the rule's query."""
    rows = [
        (i, j, len(tris), t)
        for i, rule in enumerate(rules)
        for j, tris in enumerate(trigram_query(rule.pattern) or ())
        for t in sorted(tris)
    ]
    names = ("rule_no", "branch", "needed", "trigram")
    asked = index.sparkSession.range(1).select(
        F.inline(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row, strict=True))) for row in rows)))
    )
    lists = index.join(F.broadcast(asked), "trigram").groupBy("rule_no", "branch", "needed", "bucket").agg(F.collect_list("ids").alias("lists"))
    common = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.col("lists")[0], F.array_intersect)
    return (
        lists.where(F.size("lists") == F.col("needed"))
        .select("rule_no", "bucket", common.alias("ids"))
        .groupBy("rule_no", "bucket")
        .agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    )


def candidate_ids(found: DataFrame) -> DataFrame:
    """(cand_id, rules array<int>): one row per candidate document."""
    return found.select("rule_no", F.explode("ids").alias("cand_id")).groupBy("cand_id").agg(F.collect_set("rule_no").alias("rules"))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda a plain column expression is computed per call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda x, y: x + y)


def _starts(step: Column, lead: Column, width: int = 256) -> Column:
    """start_i = lead_i + the sum of step over all earlier i, by blocks so that long lists stay cheap."""
    last = ((F.size(step) - 1) / width).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(step, b * width + 1, width))

    def from_blocks(blocks: Column) -> Column:
        return _let(F.transform(blocks, _total), lambda sums: F.flatten(F.transform(blocks, lambda inside, b: one(inside, _total(F.slice(sums, F.lit(1), b))))))

    def one(inside: Column, base: Column) -> Column:
        return _let(base, lambda base: F.transform(inside, lambda _, j: base + _total(F.slice(inside, F.lit(1), j))))

    return F.zip_with(_let(blocks, from_blocks), lead, lambda s, p: s + p)


def _spans_of(rule: Rule) -> Column:
    """All matches of a text that has one: array<struct<start, end>>, too short groups dropped."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    found = F.struct(
        lengths(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))).alias("n"),
        lengths(F.split("text", rule.pattern, -1)).alias("p"),
        lengths(F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group))).alias("g"),
    )

    def spans(x: Column) -> Column:
        lead = F.slice(x["p"], F.lit(1), F.size(x["n"]))
        return _let(F.zip_with(lead, x["n"], lambda a, b: a + b), lambda step: zipped(x, _starts(step, lead)))

    def zipped(x: Column, starts: Column) -> Column:
        rows = F.arrays_zip(starts.alias("at"), x["n"].alias("n"), x["g"].alias("g"))
        long_enough = F.filter(rows, _long_enough(rule.least))
        return F.transform(long_enough, lambda y: F.struct(y["at"].alias("start"), (y["at"] + y["n"]).alias("end")))

    return _let(found, spans)


def _hit(rule: Rule, column: str) -> Column:
    """Cheap test that a span may exist; for a plain repeated class the least length is asked at once."""
    pattern = rule.pattern.replace("]+", f"]{{{rule.least},}}") if _maximal_run(rule) else rule.pattern
    return F.col(column).rlike(pattern)


def with_spans(docs: DataFrame, rules: tuple[Rule, ...], admitted: dict[str, Column]) -> DataFrame:
    """Add span_<kind>: array<struct<start long, end long>> of code points, ascending."""
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    spans = {r.kind: F.when(admitted[r.kind] & _hit(r, "text"), _spans_of(r)).otherwise(none) for r in rules}
    return docs.withColumns({f"span_{kind}": column for kind, column in spans.items()})


def _long_enough(least: int):
    return lambda x: x["g"] >= least


def _maximal_run(rule: Rule) -> bool:
    """A single class repeated: asking for the least length at once finds the same long runs, sooner."""
    return rule.group == 0 and re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) is not None


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of docs as (doc_id, text, span_<kind>...), through the index where a rule allows it."""
    docs = text_rows(docs)
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    trigrams = sorted({t for q in queries.values() if q for tris in q for t in tris})
    index = materialize(build_index(docs, trigrams), "trigram-postings")
    found = materialize(candidates(index, rules), "trigram-candidates")
    n = found.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    ids = candidate_ids(found)
    ids = F.broadcast(ids) if n <= BROADCAST_ROWS else ids
    joined = docs.join(ids, docs.doc_id == ids.cand_id, "left")
    admitted = {
        rule.kind: F.lit(True)
        if queries[rule.kind] is None
        else F.col("doc_id").isNull() | F.coalesce(F.array_contains("rules", i), F.lit(False))
        for i, rule in enumerate(rules)
    }
    return with_spans(joined, rules, admitted).drop("cand_id", "rules")


def _listed(rules: list[Rule]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, comma-joined."""

    def tagged(i: int, rule: Rule) -> Column:
        return F.transform(
            f"span_{rule.kind}",
            lambda x: F.struct(x["start"].alias("s"), F.lit(i).alias("i"), x["end"].alias("e"), F.lit(rule.kind).alias("k")),
        )

    arrays = [tagged(i, rule) for i, rule in enumerate(rules)]
    texts = F.transform(F.array_sort(F.concat(*arrays)), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"]))
    return F.array_join(texts, ",")


def digest(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    base = [r for r in rules if r.base]
    counts = [F.size(f"span_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base]
    return scanned.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(list(rules)).alias("spans"))


def _rebuilt(zipped: Column, least: int) -> Column:
    """Text from its (piece, match, group) runs, long enough groups' matches replaced."""
    kept = lambda x: F.when(F.length(x["g"]) >= least, F.lit("[SECRET]")).otherwise(F.coalesce(x["m"], F.lit("")))
    return F.array_join(F.transform(zipped, lambda x: F.concat(x["p"], kept(x))), "")


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Replace every secret of docs by [SECRET], rule by rule; all columns and rows stay.

    Reached through the same index: only admitted documents are searched and rewritten. A null text
    stays null. n_chars, where there is such a column, follows the new text.
    """
    spark_docs = docs.withColumnRenamed(text_col, "__text")
    id_col = "doc_id"
    text = text_rows(docs, id_col, text_col)
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    trigrams = sorted({t for q in queries.values() if q for tris in q for t in tris})
    found = materialize(candidates(build_index(text, trigrams), rules), "trigram-candidates")
    n = found.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    ids = candidate_ids(found).select(F.col("cand_id").alias("__cand"), F.col("rules").alias("__rules"))
    ids = F.broadcast(ids) if n <= BROADCAST_ROWS else ids
    out = spark_docs.join(ids, spark_docs[id_col].cast("long") == ids["__cand"], "left")
    for i, rule in enumerate(rules):
        hit = _hit(rule, "__text")
        if queries[rule.kind] is not None:
            hit = (F.col(id_col).isNull() | F.coalesce(F.array_contains("__rules", i), F.lit(False))) & hit
        group = lambda g, p=rule.pattern: F.regexp_extract_all("__text", F.lit(p), F.lit(g))
        zipped = F.arrays_zip(F.split("__text", rule.pattern, -1).alias("p"), group(0).alias("m"), group(rule.group).alias("g"))
        out = out.withColumn("__text", F.when(hit, _rebuilt(zipped, rule.least)).otherwise(F.col("__text")))
    out = out.withColumnRenamed("__text", text_col).drop("__cand", "__rules")
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col).cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)
