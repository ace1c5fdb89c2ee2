"""The trie against a plain one built turn by turn in memory."""

import hashlib
import random
import zlib

import pytest

from tidewright.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    members, ends = {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    kids, leaves, saved = {k: 0 for k in members}, {k: 0 for k in members}, {k: 0 for k in members}
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, who in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(who) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted(
        (min(who), len(k), min(members[k[:-1]]) if k else -1, len(who), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest())
        for k, who in members.items()
    )


def found(spark, rows, schema=SCHEMA):
    out = trie.prefix_trie(spark.createDataFrame(rows, schema))
    assert out.columns == COLUMNS
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in out.collect())


def test_random_tables(spark):
    roll = random.Random(11)
    rows = [(c, t, roll.choice(["user", "assistant", None]), roll.choice(["a", "b", "é", None])) for c in range(60) for t in range(roll.randrange(1, 12))]
    roll.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_nulls_absent_bases_and_turnless(spark):
    rows = [(3, None, None, None), (3, 1, "u", "x"), (7, 1, "u", "x"), (8, 2, None, ""), (None, 1, "u", "lost"), (-4, 1, "u", "n"), (-5, 1, "u", "m"), (-5, 2, "a", "o")]
    assert found(spark, rows) == brute(rows)


def test_groups_of_copies_and_deep_conversations(spark, monkeypatch):
    """Copies, conversations longer than a block, two that agree for 20 turns, ended members in several chunks."""
    monkeypatch.setattr(trie, "_BLOCK", 16)
    monkeypatch.setattr(trie, "_CHUNK", 8)
    copies = [(c, t, "u", f"same {t}") for c in range(0, 400, 5) for t in range(3)]
    deep = [(c, t, "a", f"deep {t}" if t < 20 else f"{c} {t}") for c in (1000, 1005) for t in range(90)]
    long = [(2000, 0, "u", "x" * 300_000), (2000, 1, "u", "y")]
    rows = copies + deep + long
    assert found(spark, rows) == brute(rows)


def test_repeated_rows_and_ties(spark):
    """Repeated rows are turns of their own; a tie of unequal rows has one order, whatever the partitions."""
    rows = [(0, 1, "u", "p")] * 3 + [(5, 1, "u", "p")] * 3
    assert found(spark, rows) == brute(rows)
    tied = [(0, 1, "u", x) for x in "abcdef"] + [(5, 1, "u", x) for x in "fedcba"]
    a, b = found(spark, tied), found(spark, tied[::-1])
    assert a == b and len(a) == 7 and a[0][3] == 2


def test_clashing_columns_and_empty(spark):
    rows = [(0, 1, "u", "p", 1, 2, "z"), (1, 1, "u", "q", 1, 2, "z")]
    schema = SCHEMA + ", depth int, n int, hi string"
    assert found(spark, rows, schema) == brute([r[:4] for r in rows])
    assert found(spark, [], SCHEMA) == []


def test_distinct_names_for_distinct_frames(spark):
    """Role and text are told apart: ('ab', 'c') is not ('a', 'bc')."""
    rows = [(0, 1, "ab", "c"), (5, 1, "a", "bc")]
    assert found(spark, rows) == brute(rows)
    assert len(found(spark, rows)) == 3


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(spark, rows) == brute(rows)
