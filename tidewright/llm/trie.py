"""The trie of shared conversation beginnings, by truncation peeling.

Conversations are rebuilt, named by their turns and peeled from the deepest depth up: at each depth the
conversations that end there join the nodes that survive from below, equal sequences become one node with its
sums, the last turn is stripped and what is left is grouped again. Counts, leaves and savings of subtrees are
added up while the nodes are found.

A prefix is named by the exclusive or of 120-bit SHA-256 tags, one for each turn with its depth, so a name is
a running total that can be made in blocks, and stripping a turn takes its tag away again. Conversations of equal
turns are one sequence with a count. A stretch that only one sequence passes needs no regrouping: it is
peeled at once, by running sums. So rounds, and the path that a row carries, are as deep as two different
sequences agree, whatever the length of a conversation.

No conversation is gathered in one place: turns are numbered in range partitions with an offset for each, running
totals go by blocks of turns, and the members that end in a node are hashed as a stream of sorted chunks.

Defined cases: null role or text is empty; turns of a conversation with equal numbers follow each other by a hash of
role and text, null numbers first; rows without conv_id belong to nobody and are left out; repeated rows are turns of
their own; a conversation that is rebuilt to nothing ends in the root; an empty table gives no rows; other columns
are never read. Ids may be negative: conversation c - c mod 5 is then the next multiple below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import map_rows, materialize, parts, ship

GROUP = 5
HEADS = 9
_BLOCK = 256  # turns of a running total's block
_CHUNK = 1024  # ids of a chunk of a node's ended members
_HEX = 15  # hexadecimal digits in each half of a tag


def number_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1), role, text of every turn, in order of turn within its conversation."""
    spark = conversations.sparkSession
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")),
    )
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.xxhash64("role", "text")]
    laid = turns.repartitionByRange(parts(spark), *keys).sortWithinPartitions(*keys, "role", "text").withColumn("at", F.monotonically_increasing_id())
    laid = materialize(laid.drop("turn").withColumn("task", F.shiftright("at", 33)), "turns")
    runs = laid.groupBy("conv", "task").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("conv", "task", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("shift"))
    return laid.join(runs, ["conv", "task"]).select("conv", (F.col("at") + F.col("shift")).alias("pos"), "role", "text")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): every conv; and conv, depth, role, text of the rebuilt turns."""
    taken = lambda c: F.crc32(c.cast("string")) % HEADS
    base = F.col("conv") - F.pmod("conv", F.lit(GROUP))
    every = turns.select("conv").distinct()
    heads = turns.where((F.pmod("conv", F.lit(GROUP)) == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv", "base")
    had = heads.groupBy("base").agg(F.count("*").alias("had"))
    given = heads.withColumn("conv", F.explode(F.transform(F.sequence(F.lit(0), F.lit(GROUP - 1)), lambda i: F.col("base") + i)))
    given = given.where(F.col("pos") <= taken(F.col("conv"))).join(every, "conv", "left_semi")
    own = turns.withColumn("h", taken(F.col("conv"))).where(F.col("pos") > F.col("h")).withColumn("base", base).join(had, "base", "left")
    own = own.withColumn("depth", F.col("pos") - F.col("h") + F.least("h", F.coalesce("had", F.lit(0))))
    return every, given.select("conv", F.col("pos").alias("depth"), "role", "text").unionByName(own.select("conv", "depth", "role", "text"))


def _tags(turns: DataFrame) -> DataFrame:
    """conv, depth, hi, lo, bytes: two halves of the turn's tag, and the bytes of its text."""
    name = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    half = lambda i: F.conv(F.substring("name", i, _HEX), 16, 10).cast("long")
    return turns.select("conv", "depth", name.alias("name"), F.octet_length("text").cast("long").alias("bytes")).select(
        "conv", "depth", half(1).alias("hi"), half(1 + _HEX).alias("lo"), "bytes"
    )


def _prefixes(tags: DataFrame) -> DataFrame:
    """conv, depth, hi, lo (name of the first depth turns), up_hi, up_lo (of one less), bytes, upto (bytes of these turns)."""
    blocked = tags.withColumn("block", F.expr(f"(depth - 1) div {_BLOCK}"))
    totals = {"hi": F.bit_xor, "lo": F.bit_xor, "bytes": F.sum}
    blocks = blocked.groupBy("conv", "block").agg(*(f(c).alias(c) for c, f in totals.items()))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", *(F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"_{c}") for c, f in totals.items()))
    so_far = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    found = blocked.join(blocks, ["conv", "block"]).withColumns({f"run_{c}": f(c).over(so_far) for c, f in totals.items()})
    name = {c: F.col(f"_{c}").bitwiseXOR(F.col(f"run_{c}")) for c in ("hi", "lo")}
    return found.select(
        "conv", "depth", *(name[c].alias(c) for c in name), *(name[c].bitwiseXOR(F.col(c)).alias(f"up_{c}") for c in name),
        "bytes", (F.col("_bytes") + F.col("run_bytes")).alias("upto"),
    )


_KEY = ["depth", "hi", "lo"]


def _stream_hashes(batches: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    """SHA-256 of each node's chunks, which come in order."""
    key, digest = None, None
    for batch in batches:
        done = []
        for *node, chunk in batch:
            if node == key:
                digest.update(b"," + chunk.encode())
            else:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = node, hashlib.sha256(chunk.encode())
        yield done
    if key is not None:
        yield [(*key, digest.hexdigest())]


def _ended(whole: DataFrame) -> DataFrame:
    """depth, hi, lo, ends_sha256 of every node in which conversations end."""
    chunks = whole.groupBy(*_KEY, F.expr(f"conv div {_CHUNK}").alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    laid = chunks.repartition(parts(whole.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "chunk").select(*_KEY, "ids")
    return map_rows(laid, "depth long, hi long, lo long, ends_sha256 string", _stream_hashes)


_SUMS = ["n", "children", "leaves", "saved"]


def _peel(entries: DataFrame) -> DataFrame:
    """Nodes of all depths from the sequences that enter at theirs: (depth, path, conv, n, children, leaves, saved).

    path holds (depth, hi, lo, bytes) of each turn down to the entry's depth. One round a depth, deepest first.
    """
    deepest = entries.agg(F.max("depth")).first()[0]
    survivors, found = None, None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = entries.where(F.col("depth") == depth)
        here = here if survivors is None else here.unionByName(survivors)
        name = lambda c: F.coalesce(F.element_at("path", -1)[c], F.lit(0)) if depth else F.lit(0)  # noqa: E731, B023
        merged = here.groupBy(name("hi").alias("hi"), name("lo").alias("lo")).agg(F.min("conv").alias("conv"), F.any_value("path").alias("path"), *(F.sum(c).alias(c) for c in _SUMS))
        merged = merged.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")))
        if depth:
            merged = merged.withColumn("saved", F.col("saved") + (F.col("n") - 1) * F.element_at("path", -1)["bytes"])
        merged = materialize(merged.withColumn("depth", F.lit(depth).cast("long")), "trie-level")
        found = merged if found is None else found.unionByName(merged)
        survivors = merged.select(F.lit(depth - 1).cast("long").alias("depth"), F.slice("path", 1, max(depth - 1, 0)).alias("path"), "conv", "n", F.lit(1).cast("long").alias("children"), "leaves", "saved")
    return entries.limit(0) if found is None else found


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    ship(conversations.sparkSession)
    every, turns = rebuild(materialize(number_turns(conversations), "numbered"))
    every, tags = materialize(every, "convs"), materialize(_tags(turns), "tags")
    prefixes = materialize(_prefixes(tags), "prefixes")
    totals = tags.groupBy("conv").agg(F.max("depth").alias("depth"), F.bit_xor("hi").alias("hi"), F.bit_xor("lo").alias("lo"), F.sum("bytes").alias("total"))
    zero = F.lit(0).cast("long")
    whole = materialize(every.join(totals, "conv", "left").select("conv", *(F.coalesce(c, zero).alias(c) for c in [*_KEY, "total"])), "sequences")
    sequences = whole.groupBy(*_KEY).agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.any_value("total").alias("total"))
    sequences = materialize(sequences.select("conv", F.col("depth").alias("length"), "n", "total"), "sequences")

    # the turns of one conversation for each sequence, and how deep it goes beside another
    passing = materialize(prefixes.join(sequences, "conv"), "passing")
    shared = passing.groupBy(*_KEY).agg(F.count("*").alias("k")).where("k > 1").select(*_KEY)
    paths = passing.join(shared, _KEY, "left_semi").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*_KEY, "bytes"))).alias("path"), F.max("upto").alias("upto"))
    below = F.col("length") > F.col("depth")
    entries = sequences.join(paths, "conv", "left").select(
        F.coalesce(F.size("path").cast("long"), zero).alias("depth"),
        F.coalesce("path", F.array().cast("array<struct<depth:bigint,hi:bigint,lo:bigint,bytes:bigint>>")).alias("path"),
        "conv", "n", "length", (F.col("total") - F.coalesce("upto", zero)).alias("rest"),
    )
    entries = materialize(
        entries.select("depth", "path", "conv", "n", below.cast("long").alias("children"), below.cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("rest")).alias("saved"))
        .repartitionByRange(parts(conversations.sparkSession), "depth", "conv"), "entries",
    )

    peeled = _peel(entries)
    last = lambda c, at: F.coalesce(F.try_element_at("path", F.lit(at))[c], zero).alias(("up_" if at == -2 else "") + c)
    peeled = peeled.select("conv", "depth", last("hi", -1), last("lo", -1), last("hi", -2), last("lo", -2), *_SUMS)
    alone = passing.join(entries.select("conv", F.col("depth").alias("entry")), "conv").where(F.col("depth") > F.col("entry"))
    alone = alone.select(
        "conv", *_KEY, "up_hi", "up_lo", "n", below.cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"),
        ((F.col("n") - 1) * (F.col("total") - F.col("upto") + F.col("bytes"))).alias("saved"), (F.col("depth") == F.col("entry") + 1).alias("first"),
    )
    alone = materialize(alone, "alone")
    root = peeled.where("depth = 0").select("conv").first()
    top = F.lit(root[0] if root else None).cast("long")
    hang = peeled.unionByName(alone.where("first").drop("first"))
    above = peeled.where("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv").alias("parent"))
    deep = hang.where("depth > 1").join(above, ["depth", "up_hi", "up_lo"]).select("conv", *_KEY, "parent", *_SUMS)
    flat = hang.where("depth <= 1").select("conv", *_KEY, F.when(F.col("depth") == 1, top).alias("parent"), *_SUMS)
    tail = alone.where("NOT first").select("conv", *_KEY, F.col("conv").alias("parent"), *_SUMS)
    nodes = deep.unionByName(flat).unionByName(tail).join(_ended(whole), _KEY, "left")
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), _or_empty("ends_sha256").alias("ends_sha256"),
    )


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(hashlib.sha256(b"").hexdigest()))
