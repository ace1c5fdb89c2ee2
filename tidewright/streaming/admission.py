"""Submissions: validation with every fault reported, and idempotent admission, in batch or per micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators import review
from tidewright.sources.files import cut

#: What a submission must and may carry (JSON pointer, required pattern).
REQUIRED = {"/specversion": r"^1\.0$", "/id": r".+", "/source": r".+", "/type": r".+", "/data/run_id": r".+", "/data/event_id": r".+"}

HOPS = 2  # doublings of the chains' links in one step, before they are cut


def faults(checks: dict[str, Column], required: dict[str, str] = REQUIRED, names: Column | None = None, allowed: tuple[str, ...] = (), equal: tuple[tuple[str, str], ...] = ()) -> Column:
    """array<struct<pointer, code>> for text columns by pointer: REQUIRED, INVALID_VALUE, UNKNOWN_PROPERTY and MISMATCH.

    `names` are the property names a submission carries, of which only `allowed` are known; `equal` names
    pairs of pointers whose texts must agree (a fault of the second, where both are present).
    """
    fault = lambda pointer, code: F.struct(pointer.alias("pointer"), F.lit(code).alias("code"))
    blank = lambda p: F.coalesce(F.trim(checks[p]), F.lit("")) == ""
    found = [
        F.when(blank(p), fault(F.lit(p), "REQUIRED")).when(~checks[p].rlike(pattern), fault(F.lit(p), "INVALID_VALUE"))
        for p, pattern in required.items()
        if p in checks
    ]
    found += [F.when(~blank(a) & ~blank(b) & (checks[a] != checks[b]), fault(F.lit(b), "MISMATCH")) for a, b in equal]
    out = F.array_compact(F.array(*found))
    if names is None:
        return out
    unknown = F.array_sort(F.array_except(F.coalesce(names, F.array().cast("array<string>")), F.array(*map(F.lit, allowed))))
    return F.concat(out, F.transform(unknown, lambda n: fault(F.concat(F.lit("/"), n), "UNKNOWN_PROPERTY")))


def admit(requests: DataFrame, submissions: DataFrame, order: str = "sequence") -> DataFrame:
    """outcome ACCEPTED, REPLAY, CONFLICT or INVALID of each submission, as if they came one by one by `order`.

    Both sides have idempotency_key, event_key and payload_hash; order is unique. A submission is accepted
    if no stored request and no accepted earlier submission shares its key or event; it is a replay if the
    one that does has its key, event and hash. Rejected submissions are not stored, so they block nothing.
    Only the first submission of each (key, event) can be accepted. Of these, one without an earlier neighbour, which is
    one that shares its key or its event, is accepted. One with a single earlier neighbour is accepted if that one is
    not: such links make chains, which are followed by pointer jumping, HOPS times doubled a step, so a chain of n takes
    about log n / HOPS steps. Whoever shares a key or event with an accepted one is not accepted; those who are
    neither, behind several neighbours, go to the next round. A null key or event is INVALID, and nobody's neighbour.
    """
    pair = ["idempotency_key", "event_key"]
    known = F.col(pair[0]).isNotNull() & F.col(pair[1]).isNotNull()
    old = requests.where(known).select(*pair, F.col("payload_hash").alias("_old")).dropDuplicates(pair)
    firsts = submissions.where(known).groupBy(*pair).agg(F.min(order).alias("_first"), F.min_by("payload_hash", order).alias("_hash"))
    free, accepted = firsts, None
    for key in pair:
        free = free.join(old.select(key).distinct(), key, "left_anti")
    free = cut(free)
    while not free.isEmpty():
        new = cut(_settled(free, pair).select(*firsts.columns))
        accepted = new if accepted is None else accepted.unionByName(new)
        for key in pair:
            free = free.join(new.select(key), key, "left_anti")
        free = cut(free)
    accepted = accepted if accepted is not None else firsts.limit(0)
    out = submissions.join(old, pair, "left").join(accepted, pair, "left")
    same = F.coalesce("_old", "_hash").eqNullSafe(F.col("payload_hash"))
    outcome = (
        F.when(~known, "INVALID")
        .when(F.col("_old").isNull() & (F.col(order) == F.col("_first")), "ACCEPTED")
        .when((F.col("_old").isNotNull() | F.col("_first").isNotNull()) & same, "REPLAY")
        .otherwise("CONFLICT")
    )
    return out.withColumn("outcome", outcome).select(*submissions.columns, "outcome")


def _settled(free: DataFrame, pair: list[str]) -> DataFrame:
    """The submissions of `free` that are surely accepted: those without an earlier neighbour, and every second of the chains behind them."""
    near = free
    for key in pair:
        two = free.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_first"))).where(F.col("_n") <= 2)
        near = near.join(two.groupBy(key).agg(F.min("_first").alias(f"_a_{key}"), F.max("_first").alias(f"_b_{key}")), key)
    # earlier neighbours by a key: none, the smallest alone, or more
    count = lambda key: F.when(F.col("_first") == F.col(f"_a_{key}"), 0).when(F.col("_first") == F.col(f"_b_{key}"), 1).otherwise(2)
    single = F.when(count(pair[0]) == 1, F.col(f"_a_{pair[0]}")).otherwise(F.col(f"_a_{pair[1]}"))
    near = cut(near.withColumn("_earlier", count(pair[0]) + count(pair[1])).withColumn("_to", single).drop(*(f"_{x}_{key}" for x in "ab" for key in pair)))
    free_of_all = near.where("_earlier = 0")
    links = cut(near.where("_earlier = 1").select(F.col("_first").alias("_from"), "_to", F.lit(True).alias("_odd")))
    while not links.join(links.select(F.col("_from").alias("_to")), "_to", "left_semi").isEmpty():
        for _ in range(HOPS):
            step = links.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"), F.col("_odd").alias("_also"))
            links = links.join(step, "_to", "left").select("_from", F.coalesce("_next", "_to").alias("_to"), (F.col("_odd") != F.coalesce("_also", F.lit(False))).alias("_odd"))
        links = cut(links)
    even = links.where("NOT _odd").join(free_of_all.select(F.col("_first").alias("_to")), "_to", "left_semi").select(F.col("_from").alias("_first"))
    return free_of_all.unionByName(near.join(even, "_first", "left_semi").select(*near.columns))


def apply_in_order(events: DataFrame, group: list[str], order: str, apply, batch_rows: int = 500) -> int:
    """Apply pending events group by group in order: each round hands `apply` the oldest event of every group.

    Groups go side by side, events of a group one after another; returns the rounds. `apply` gets a
    DataFrame of at most one event a group and returns the (group, order) rows it could apply; a group
    with an event that was not applied waits, later events of it too. batch_rows bounds a round's events.
    """
    pending, rounds = cut(events), 0
    while True:
        heads = cut(review.group_heads(pending, group, order, F.lit(True)).orderBy(order).limit(batch_rows))
        if heads.isEmpty():
            return rounds
        rounds += 1
        done = cut(apply(heads).select(*group, order))
        failed = heads.join(done, [*group, order], "left_anti").select(*group).distinct()
        pending = cut(pending.join(done, [*group, order], "left_anti").join(failed, group, "left_anti"))


def run_stream(stream: DataFrame, read_requests, append_accepted, checkpoint: str):
    """Admit a stream of submissions in micro-batches against the request table."""

    def batch(df: DataFrame, _: int) -> None:
        decided = admit(read_requests(), df)
        append_accepted(decided.where("outcome = 'ACCEPTED'").select(*df.columns))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
