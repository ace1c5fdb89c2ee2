"""How far apart the sources of a language speak: exact divergences of smoothed term shares.

Terms are counted per (lang, source) in one pass over the texts, added up inside each task before anything is
shuffled. A language keeps the terms that stand in at least MIN_DOCS of its documents. Over its V kept terms a
group's share of a term is p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in whole numbers.

Pairs of groups are compared in a cube: groups are dealt into blocks of about GROUP_BLOCK, terms into blocks of
about TERM_BLOCK, and one task owns the cell (group block, group block, term block). The slice of a group block
over a term block is sent to every cell of its row and column of the cube; a cell makes both slices dense, with
each group's share of an absent term where it has none, and adds |p - q| over the terms that stand in either
slice. The parts of a pair are then added along the term axis; the terms that no cell has seen for a pair are
absent from both groups and differ by the same amount each, so they are added as one product. Cells are bounded
by the block sizes whatever one source or term holds.

Defined cases: null text, lang and source are ''; a source without kept terms is a group like any other; in a
language without kept terms V is 0, every value is 0 and no terms are listed; one source alone has no pairs; an
empty table gives no rows; columns other than the three are never read. Equal values are ranked by the item's
UTF-8 bytes. Repeated rows count as often as they stand there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import arrow_rows, map_rows, materialize, ship

MIN_DOCS = 30
SMOOTH = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
GROUP_BLOCK = 64
TERM_BLOCK = 1024
#: A term is a run of ASCII letters and bytes beyond ASCII: as UTF-8, capitals become small and every other byte a space.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_HELD = 400_000  # counts a task holds before it passes them on


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode().translate(_TERMS).split()


def _count(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    """(lang, source, term, n, docs) added up over a stretch of the task's rows; a null term counts the documents."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def rows() -> Iterator[list[tuple]]:
        for (lang, source), (n, docs) in held.items():
            yield [(lang, source, None, 0, docs.pop(None)), *((lang, source, term.decode(), k, docs[term]) for term, k in n.items())]

    for batch in batches:
        for lang, source, text in batch:
            size += (lang, source) not in held
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            found = Counter(terms_of(text))
            n.update(found)
            docs.update(found.keys())
            docs[None] += 1
            size += len(n) - before
        if size > _HELD:
            yield from rows()
            held.clear()
            size = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents of every term of a group; a null term holds the group's documents."""
    ship(docs.sparkSession)
    arrow_rows(docs.sparkSession, 256)
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = map_rows(texts, "lang string, source string, term string, n long, docs long", _count)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (n + 5) / (total + 5 V)), exact beyond 64 bits; 0 where V is 0."""
    wide = lambda c: c.cast("decimal(25,0)")
    quotient = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(n + SMOOTH), wide(total + SMOOTH * v))
    return F.when(v > 0, quotient + 1).otherwise(F.lit(0)).cast("long")


def shares(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, terms): lang, source, v, absent; and lang, source, term, p, q for the kept terms a group has."""
    terms = counts.where("term IS NOT NULL")
    kept = materialize(terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("lang_docs")).where(F.col("lang_docs") >= MIN_DOCS).drop("lang_docs"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    found = terms.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total")))
    groups = materialize(groups.withColumn("absent", _share(F.lit(0), F.col("total"), F.col("v"))), "source-groups")
    terms = found.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", _share(F.col("n"), F.col("total"), F.col("v")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")
    )
    return groups, materialize(terms, "term-shares")


_CELL = ["lang", "block_a", "block_b", "term_block"]


def _cell(rows: pd.DataFrame) -> pd.DataFrame:
    """Partial divergences of all pairs of two group blocks over the terms of one term block."""
    lang, a, b, _ = rows[_CELL].iloc[0]
    has = rows["term"].notna().to_numpy()
    codes, terms = pd.factorize(rows["term"])
    sides = []
    for side in (0, 1):
        own = (rows["side"] == side).to_numpy()
        absent = rows.loc[own & ~has, ["source", "p"]].sort_values("source", key=lambda s: s.map(str.encode))
        place = {s: i for i, s in enumerate(absent["source"])}
        dense = np.repeat(absent["p"].to_numpy(np.int64)[:, None], len(terms), axis=1)
        mine = own & has
        dense[rows.loc[mine, "source"].map(place).to_numpy(np.int64), codes[mine]] = rows.loc[mine, "p"].to_numpy(np.int64)
        sides.append((absent["source"].to_numpy(), dense))
    (left, x), (right, y) = sides
    out = []
    for i, source in enumerate(left):
        partial = np.abs(y - x[i]).sum(axis=1)
        keep = np.arange(i + 1, len(right)) if a == b else np.arange(len(right))
        out.append(pd.DataFrame({"lang": lang, "source": source, "item": right[keep], "partial": partial[keep], "seen": len(terms)}))
    return pd.concat(out, ignore_index=True)


def pairs(groups: DataFrame, terms: DataFrame, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """lang, source, item, value: the divergence of each two sources of a language, both ways round."""
    ship(groups.sparkSession)
    blocks = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / group_block).cast("int").alias("group_blocks"),
        F.greatest(F.lit(1), F.ceil(F.max("v") / term_block)).cast("int").alias("term_blocks"),
    )
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    dealt = groups.join(blocks, "lang").withColumn("block", block("source", "group_blocks"))
    # every group stands in every term block by its share of an absent term, beside the terms that it has
    lines = dealt.select("lang", "source", "block", "group_blocks", F.lit(None).cast("string").alias("term"), F.col("absent").alias("p"), F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("term_block"))
    own = terms.join(dealt.select("lang", "source", "block", "group_blocks", "term_blocks"), ["lang", "source"]).withColumn("term_block", block("term", "term_blocks"))
    slices = lines.unionByName(own.select(*lines.columns))
    cell = lambda a, b, side: F.struct(a.alias("block_a"), b.alias("block_b"), F.lit(side).alias("side"))
    mine, last = F.col("block"), F.col("group_blocks") - 1
    sent = F.concat(F.transform(F.sequence(mine, last), lambda b: cell(mine, b, 0)), F.transform(F.sequence(F.lit(0), mine), lambda a: cell(a, mine, 1)))
    cells = slices.withColumn("cell", F.explode(sent)).select("lang", "cell.*", "term_block", "source", "term", "p")
    partial = cells.groupBy(*_CELL).applyInPandas(_cell, "lang string, source string, item string, partial long, seen long")
    whole = partial.groupBy("lang", "source", "item").agg(F.sum("partial").alias("partial"), F.sum("seen").alias("seen"))
    side = lambda name: groups.select("lang", F.col("source").alias(name), F.col("absent").alias(f"{name}_absent"), *(["v"] if name == "source" else []))
    whole = whole.join(side("source"), ["lang", "source"]).join(side("item"), ["lang", "item"])
    value = F.col("partial") + (F.col("v") - F.col("seen")) * F.abs(F.col("source_absent") - F.col("item_absent"))
    both = F.array(F.struct(F.col("source").alias("a"), F.col("item").alias("b")), F.struct(F.col("item").alias("a"), F.col("source").alias("b")))
    return whole.select("lang", F.explode(both).alias("way"), value.alias("value")).select("lang", F.col("way.a").alias("source"), F.col("way.b").alias("item"), "value")


def audit(docs: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: all pairs of sources, and each source's terms above its language's share."""
    groups, terms = shares(materialize(term_counts(docs), "term-counts"))
    value = F.col("p") - F.col("q")
    listed = [
        pairs(groups, terms).select("lang", "source", F.lit("pair").alias("part"), "item", "value"),
        terms.where(value > 0).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), value.alias("value")),
    ]
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    every, best = (x.withColumn("rank", F.row_number().over(order)) for x in listed)
    return every.unionByName(best.where(F.col("rank") <= top))
