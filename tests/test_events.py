"""Ordered folds and admission against one event after another."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidewright.operators import scan
from tidewright.streaming import admission, fold, state

EVENTS = "isin string, sequence long, rate long, trade_date date, source string"
STORED = "isin string, rate long, trade_date date, source string"


def one_by_one(stored, events):
    state, told = {k: (r, d, s, None) for k, r, d, s in stored}, {}
    for k, n, rate, day, source in sorted(events, key=lambda e: e[1]):
        old_rate, old_day, old_source, by = state.get(k, (None, None, None, None))
        change = "KEEP"
        if rate is None or (source == fold.EXCHANGE and day is None):
            pass
        elif source != fold.EXCHANGE:
            change = "KEEP" if old_source == fold.EXCHANGE or rate == old_rate else "REPLACE"
        elif old_source != fold.EXCHANGE or old_day is None:
            change = "REPLACE"
        elif day >= old_day:
            change = "REPLACE" if rate != old_rate else "ADVANCE_TRADE_DATE" if day > old_day else "KEEP"
        told[k, n] = change
        if change != "KEEP":
            state[k] = (rate, day if source == fold.EXCHANGE else None, source, n if change == "REPLACE" else by)
    return told, state


def jobs_of(spark, run):
    """Spark jobs that a call starts."""
    spark.sparkContext.setJobGroup("counted", "")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_coupons_of_one_group(spark):
    """10,000 events of one security, in a number of jobs that does not depend on their number."""
    roll = random.Random(5)
    day = date(2024, 1, 1)

    def events(n):
        return [("A", i, roll.choice([None, 1, 2, 3]), roll.choice([None, *(day + timedelta(roll.randrange(i // 50 + 3)) for _ in range(3))]), roll.choice([fold.EXCHANGE, fold.DETAILS, fold.EXCHANGE])) for i in range(n)]

    jobs = []
    for n in (100, 10_000):
        rows, stored = events(n), [("A", 7, day, fold.DETAILS), ("B", 1, None, fold.EXCHANGE)]
        told, state = one_by_one(stored, rows)
        got, last = fold.coupons_in_order(spark.createDataFrame(stored, STORED), spark.createDataFrame(rows[::-1], EVENTS))
        jobs.append(jobs_of(spark, lambda: setattr(test_coupons_of_one_group, "got", got.collect())))  # noqa: B023
        assert {(r.isin, r.sequence): r.change for r in test_coupons_of_one_group.got} == told
        assert {r.isin: tuple(r)[1:] for r in last.collect()} == {k: (r, d if s == fold.EXCHANGE else None, s, b) for k, (r, d, s, b) in state.items()}
    assert max(jobs) < 25


@pytest.mark.parametrize("seed", range(4))
def test_coupons_of_many_groups(spark, seed):
    roll = random.Random(seed)
    day = date(2024, 1, 1)
    rows = [(roll.choice("ABCDE"), i, roll.choice([None, 1, 2]), roll.choice([None, day, day + timedelta(1), day + timedelta(2)]), roll.choice([fold.EXCHANGE, fold.DETAILS])) for i in range(60)]
    stored = [(k, roll.choice([None, 1]), *roll.choice([(day + timedelta(1), fold.EXCHANGE), (None, fold.EXCHANGE), (None, fold.DETAILS), (None, None)])) for k in "ABX"]
    told, state = one_by_one(stored, rows)
    got, last = fold.coupons_in_order(spark.createDataFrame(stored, STORED), spark.createDataFrame(rows, EVENTS))
    assert {(r.isin, r.sequence): r.change for r in got.collect()} == told
    assert {r.isin: tuple(r)[1:] for r in last.collect() if r.isin in state} == state


def test_scalars(spark):
    roll = random.Random(9)
    rows = [(roll.choice("AB"), i, roll.choice([None, "x", "y"]), roll.choice([None, "p", "q"]), roll.random() < 0.2) for i in range(300)]
    state, told = {"A": ["x", None], "C": [None, "p"]}, {}
    for k, n, a, b, wipe in rows:
        old = state.setdefault(k, [None, None])
        names = ["a"] if a is not None and a != old[0] else []
        names += ["b"] if (old[1] is not None if wipe else b is not None and b != old[1]) else []
        state[k] = [a if a is not None else old[0], None if wipe else b if b is not None else old[1]]
        told[k, n] = names
    stored = spark.createDataFrame([("A", "x", None), ("C", None, "p")], "isin string, a string, b string")
    events = spark.createDataFrame(rows, "isin string, sequence long, a string, b string, wipe boolean")
    got, last = fold.scalars_in_order(stored, events, ["a", "b"], {"b": F.col("wipe")})
    assert {(r.isin, r.sequence): r.changed for r in got.collect()} == told
    assert {r.isin: [r.a, r.b] for r in last.collect()} == state


def test_empty_events(spark):
    stored = spark.createDataFrame([("A", 1, None, "NSDL")], STORED)
    got, last = fold.coupons_in_order(stored, spark.createDataFrame([], EVENTS))
    assert got.collect() == [] and [tuple(r) for r in last.collect()] == [("A", 1, None, "NSDL", None)]


def test_running_in_blocks(spark):
    """Sums, maxima and minima over groups that lie across partitions, null groups too."""
    roll = random.Random(2)
    rows = [(roll.choice(["hot", "hot", "hot", "a", None]), i, roll.choice([None, 1, 5, 9])) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, n long, v long")
    for before in (True, False):
        got = scan.running(frame, ["g"], ["n"], {"s": ("sum", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v"))}, before, partitions=7)
        for r in got.collect():
            seen = [v for g, n, v in rows if g == r.g and (n < r.n or (n == r.n and not before)) and v is not None]
            assert (r.s, r.hi, r.lo) == ((sum(seen), max(seen), min(seen)) if seen else (None, None, None))


SUBMISSIONS = "sequence long, idempotency_key string, event_key string, payload_hash string"


def admitted(rows, stored):
    held, out = list(stored), {}
    for n, key, event, h in sorted(rows):
        hit = [x for x in held if x[0] == key or x[1] == event]
        if key is None or event is None:
            out[n] = "INVALID"
        elif not hit:
            out[n] = "ACCEPTED"
            held.append((key, event, h))
        else:
            out[n] = "REPLAY" if (key, event, h) in hit else "CONFLICT"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_admission_of_any_submissions(spark, seed):
    roll = random.Random(seed)
    some = lambda: roll.choice([None, *"abcdefgh", *"abcdefgh"])
    rows = [(i, some(), some(), roll.choice("xy")) for i in range(80)]
    frame = spark.createDataFrame(rows, SUBMISSIONS)
    assert {r.sequence: r.outcome for r in admission.admit(frame.limit(0), frame).collect()} == admitted(rows, [])


@pytest.mark.parametrize("shuffled", [False, True])
def test_admission_of_a_long_chain(spark, monkeypatch, shuffled):
    """A chain of 10,000 in under 40 cut points; in any order of arrival."""
    n = 10_000
    order = list(range(n))
    if shuffled:
        random.Random(1).shuffle(order)
    rows = [(order[i], f"k{(i + 1) // 2}", f"e{i // 2}", "h") for i in range(n)]
    cuts = []
    real = admission.cut
    monkeypatch.setattr(admission, "cut", lambda df: cuts.append(1) or real(df))
    frame = spark.createDataFrame(rows, SUBMISSIONS)
    got = {r.sequence: r.outcome for r in admission.admit(frame.limit(0), frame).collect()}
    keys, events, want = set(), set(), {}
    for s, k, e, _ in sorted(rows):
        want[s] = "CONFLICT" if k in keys or e in events else "ACCEPTED"
        if want[s] == "ACCEPTED":
            keys.add(k)
            events.add(e)
    assert got == want
    assert len(cuts) < 40


def test_coupons_in_a_stream(spark, tmp_path):
    """Three runs with restarts between them, events late and in any order: the coupons of one pass in order."""
    roll = random.Random(4)
    day = date(2024, 1, 1)
    rows = [(roll.choice("ABC"), i, roll.choice([None, 1, 2]), roll.choice([None, day, day + timedelta(1), day + timedelta(2)]), roll.choice([fold.EXCHANGE, fold.DETAILS])) for i in range(90)]
    roll.shuffle(rows)
    coupons = {}
    for run in range(3):
        spark.createDataFrame(rows[run * 30 : run * 30 + 30], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        write = lambda df, n: coupons.update({r.isin: (r.rate, r.trade_date, r.source) for r in df.collect()})  # noqa: E731, ARG005
        state.stream_coupons(events, write, str(tmp_path / "state")).awaitTermination()
        _, want = one_by_one([], rows[: run * 30 + 30])
        assert coupons == {k: (str(r), d if s == fold.EXCHANGE else None, s) for k, (r, d, s, _) in want.items()}


def test_states_of_a_stream(spark, tmp_path, monkeypatch):
    """800 securities and a null one in three runs: no more keyed states are visited than there are buckets, changes are those of each run."""
    roll = random.Random(8)
    day = date(2024, 1, 1)
    names = [*(f"S{i}" for i in range(800)), None]
    rows = [(names[i % 801], i, roll.choice([None, 1, 2]), roll.choice([None, day, day + timedelta(1)]), roll.choice([fold.EXCHANGE, fold.DETAILS])) for i in range(2403)]
    roll.shuffle(rows)
    visits = str(tmp_path / "visits")

    class Counted(state.CouponState):
        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            with open(visits, "a") as f:
                f.write("x")
            yield from super().handleInputRows(key, rows, timerValues)

    monkeypatch.setattr(state, "CouponState", Counted)
    monkeypatch.setattr(state, "BUCKETS", 7, raising=False)
    before = {}
    for run in range(3):
        spark.createDataFrame(rows[run * 801 : run * 801 + 801], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes = []
        write = lambda df, n: changes.extend(df.collect())  # noqa: E731, ARG005, B023
        state.stream_coupons(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), write, str(tmp_path / "state")).awaitTermination()
        _, after = one_by_one([], rows[: run * 801 + 801])
        after = {k: (str(r), d if s == fold.EXCHANGE else None, s) for k, (r, d, s, _) in after.items()}
        got = {r.isin: (r.rate, r.trade_date, r.source) for r in changes}
        assert got == {k: v for k, v in after.items() if before.get(k) != v} and len(got) == len(changes)
        for r in changes:
            old = before.get(r.isin)
            assert (r.change == "ADVANCE_TRADE_DATE") == (old is not None and (old[0], old[2]) == (r.rate, r.source))
        before = after
    assert len(open(visits).read()) <= 3 * 7
