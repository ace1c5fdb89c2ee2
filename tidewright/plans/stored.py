"""Registered queries over tables that the library keeps itself: commits, an index of identities, clustered files."""

from __future__ import annotations

import uuid
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators import snapshots
from tidewright.operators.clustered import Clustered
from tidewright.operators.identities import IdentityIndex
from tidewright.plans.queries import FLOW, query, t
from tidewright.sources.files import shared_folder


def _folder(spark, name):
    shared_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query(
    """SELECT 'customers' AS name, 2 AS at, CAST(c_nationkey AS BIGINT) AS part, count(*) AS n, false AS refused FROM customer GROUP BY c_nationkey
    UNION ALL SELECT 'orders', 1, CAST(o_custkey % 100 AS BIGINT), count(*), false FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey % 100
    UNION ALL SELECT 'orders', 0, NULL, NULL, true UNION ALL SELECT 'totals', 0, NULL, NULL, true"""
)
def two_writers(spark, sf):
    """Four writers begin at the same version: the first publishes orders, one refuses to replace them, one other table passes, and one that read orders is refused."""
    root, orders = _folder(spark, "commits"), t(spark, sf, "orders")
    base = snapshots.head(spark, root)
    totals = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    turns = [("orders", orders.where("o_orderkey % 2 = 0"), ()), ("orders", orders, ()), ("customers", t(spark, sf, "customer"), ()), ("totals", totals, ("orders",))]
    told = []
    for name, rows, reads in turns:
        try:
            told.append((name, snapshots.commit(spark, root, {name: rows}, base, reads), False))
        except snapshots.Conflict:
            told.append((name, 0, True))
    part = {"orders": F.col("o_custkey") % 100, "customers": F.col("c_nationkey")}

    def current(name: str, at: int, refused: bool) -> DataFrame:
        head = [F.lit(name).alias("name"), F.lit(at).alias("at")]
        if refused:
            none = F.lit(None).cast("bigint")
            return spark.range(1).select(*head, none.alias("part"), none.alias("n"), F.lit(True).alias("refused"))
        found = snapshots.read(spark, root, name).groupBy(part[name].cast("bigint").alias("part")).agg(F.count(F.lit(1)).alias("n"))
        return found.select(*head, "part", "n", F.lit(False).alias("refused"))

    return reduce(DataFrame.unionByName, (current(*x) for x in told))


BATCH = "CASE WHEN l_orderkey % 10 < 7 THEN 0 ELSE l_orderkey % 10 - 6 END"


@query(
    f"""SELECT l_partkey, kind, l_linestatus, l_orderkey, l_linenumber, batch FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, kind, l_linestatus ORDER BY batch, l_orderkey, l_linenumber) AS n
    FROM (SELECT {FLOW}, CAST({BATCH} AS INTEGER) AS batch FROM lineitem)) WHERE n = 1"""
)
def indexed_append(spark, sf):
    """Four batches of entries; each appends what no batch before it held, known from the index alone."""
    rows = t(spark, sf, "lineitem").selectExpr("l_partkey", "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_returnflag END AS kind", "l_linestatus", "l_orderkey", "l_linenumber", f"CAST({BATCH} AS INT) AS batch")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("l_partkey", "kind", "l_linestatus")}
    index, table = IdentityIndex(_folder(spark, "identities"), kinds, "l_partkey", 64), _folder(spark, "entries")
    index.add(rows.limit(0))
    for batch in range(4):
        fresh = index.unseen(rows.where(F.col("batch") == batch), [F.col("l_orderkey"), F.col("l_linenumber")])
        path = f"{table}/{batch}"
        fresh.write.parquet(path)
        index.add(spark.read.parquet(path))
    return spark.read.parquet(*(f"{table}/{batch}" for batch in range(4)))


_STARTS = [None, ("1997-06-01", 100), ("1995-03-15", 0), ("1992-01-03", 10), ("1990-01-01", 0)]
_PAGE = "SELECT {i} AS page, o_orderkey, o_custkey FROM (SELECT * FROM orders WHERE {after} ORDER BY o_orderdate DESC, o_orderkey LIMIT 51)"


@query(
    " UNION ALL ".join(
        _PAGE.format(i=i, after="true" if s is None else f"(o_orderdate < TIMESTAMP '{s[0]}' OR (o_orderdate = TIMESTAMP '{s[0]}' AND o_orderkey > {s[1]}))") for i, s in enumerate(_STARTS)
    )
)
def clustered_pages(spark, sf):
    """Orders, newest first, in files cut by that order; a page from each of five places, each from its own files."""
    table = Clustered(_folder(spark, "clustered"), (("o_orderdate", True), ("o_orderkey", False)))
    table.write(t(spark, sf, "orders"), 32)
    pages = [table.page(spark, None if s is None else {"o_orderdate": datetime.fromisoformat(s[0]), "o_orderkey": s[1]}) for s in _STARTS]
    return reduce(DataFrame.unionByName, (p.select(F.lit(i).alias("page"), "o_orderkey", "o_custkey") for i, p in enumerate(pages)))
