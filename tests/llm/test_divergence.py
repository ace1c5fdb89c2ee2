"""Divergences against a dense count in memory."""

import random
import re
from collections import Counter

from tidewright.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows):
    docs, n, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        n.update((lang, source, w) for w in words)
        docs.update({(lang, w) for w in words})
    out = []
    for lang in {g for g, _ in groups}:
        kept = [w for (x, w), k in docs.items() if x == lang and k >= 30]
        sources = [s for x, s in groups if x == lang]

        def share(count):
            total = sum(count(w) for w in kept)
            return {w: 1 + 10**9 * (count(w) + 5) // (total + 5 * len(kept)) for w in kept}  # noqa: B023

        q = share(lambda w: sum(n[lang, s, w] for s in sources))  # noqa: B023
        p = {s: share(lambda w: n[lang, s, w]) for s in sources}  # noqa: B023
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s][w] - q[w], w) for w in kept if n[lang, s, w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 50)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in divergence.audit(df).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n, sources, words):
    roll = random.Random(seed)
    pool = [roll.choice(["Wort", "ÉTÉ", "mot", "ż", "Zeta", "a"]) + chr(97 + i % 26) * (i // 26 + 1) for i in range(words)]
    return [
        (i, None if i % 17 == 0 else " ".join(roll.choices(pool[: roll.randrange(5, words)], k=roll.randrange(0, 40))), roll.choice(["de", "fr", None, "xx"] if i % 9 else ["yy"]),
         roll.choice([f"s{k}" for k in range(sources)] + [None, "é", "z"]))
        for i in range(n)
    ]


def test_against_dense(spark):
    rows = corpus(1, 900, 5, 60)
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_many_blocks(spark, monkeypatch):
    """More groups and terms than a block holds: every cell of the cube, and terms absent from whole cells."""
    rows = corpus(2, 1500, 12, 80)
    groups, terms = divergence.shares(divergence.term_counts(spark.createDataFrame(rows, SCHEMA)))
    got = sorted((*r,) for r in divergence.pairs(groups, terms, group_block=3, term_block=7).select("lang", "source", "item", "value").collect())
    assert got == sorted((x[0], x[1], x[3], x[4]) for x in brute(rows) if x[2] == "pair")


def test_a_task_passes_on_what_it_holds(spark, monkeypatch):
    rows = [(str(r[2] or ""), str(r[3] or ""), r[1] or "") for r in corpus(3, 200, 3, 40)]
    whole = Counter()
    monkeypatch.setattr(divergence, "_HELD", 5)
    for out in divergence._count(iter([rows[:50], rows[50:], []])):
        for lang, source, term, n, docs in out:
            whole[lang, source, term] += docs if term is None else n
    assert sum(v for (_, _, t), v in whole.items() if t is None) == 200
    assert sum(v for (_, _, t), v in whole.items() if t) == sum(len(divergence.terms_of(t)) for *_, t in rows)


def test_no_kept_terms_one_source_and_repeats(spark):
    """V of 0 gives zeros; a lone source has no pairs; repeated rows count again; other columns do not matter."""
    rows = [(1, "alone", "aa", "s1"), (2, "two", "aa", "s2")] + [(3, "Echo echo é", "bb", "only")] * 31 + [(4, "x" * 300_000, "bb", "only")]
    frame = spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA + ", n int, term string")
    got = found(frame)
    assert got == brute(rows)
    assert ("aa", "s1", "pair", "s2", 0, 1) in got


def test_terms_of():
    every = "".join(map(chr, [*range(0x180), 0x2028, 0x1F642])) + "ABC\x7fÀÉ d\x00e"
    assert [t.decode() for t in divergence.terms_of(every)] == re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in every))


def test_numbers_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(divergence._share(F.lit(7 * 10**17), F.lit(9 * 10**17), F.lit(10**6)).alias("p")).first()
    assert row.p == 1 + 10**9 * (7 * 10**17 + 5) // (9 * 10**17 + 5 * 10**6)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
