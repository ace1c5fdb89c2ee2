"""Coupons kept in a stream, in the state store, so that late events and restarts change nothing.

The state of a security is what the events so far leave, in a form that no order of arrival alters: the exchange's rate of
the latest (trade date, sequence) and the details' rate of the latest sequence. Before a batch's events are shuffled, each
task keeps only those that could win among its own, two a security and Arrow batch, so a security with a large part of all
events sends few rows to the task of its state. What arrives there is gone through once, none is held.

Securities are dealt out to buckets, whose states are read and written as a whole: a keyed state costs a few calls between
Python and the store a key and batch, far more than the work on a row, and there are no more of them than buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewright.streaming.fold import DETAILS, EXCHANGE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Keyed states of a stream. A checkpoint is bound to the number it began with.
BUCKETS = 16_384
_STATE = "trade_date date, given_at long, given string, detail_at long, detail string"
_NEW = (None,) * 5


class CouponState(StatefulProcessor):
    """Rows (bucket, isin, sequence, rate as text, trade_date, source) of a bucket of securities to their coupons, where they change.

    `isin` names the type of the securities' column.
    """

    def __init__(self, isin: str) -> None:
        self.schema = f"isin {isin}, {_STATE}"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("coupons", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803, ARG002
        kept = {isin: tuple(coupon) for isin, *coupon in self.kept.get()}
        old = {}
        for _, isin, *event in rows:
            before = kept.get(isin, _NEW)
            after = _taken(before, *event)
            if after != before:
                old.setdefault(isin, before)
                kept[isin] = after
        if not old:
            return
        self.kept.put([(isin, *coupon) for isin, coupon in kept.items()])
        for isin, coupon in old.items():
            before, after = _shown(*coupon), _shown(*kept[isin])
            if before != after:
                replaced = before[0] != after[0] or before[2] != after[2]
                yield Row(isin=isin, rate=after[0], trade_date=after[1], source=after[2], change="REPLACE" if replaced else "ADVANCE_TRADE_DATE")

    def close(self) -> None:
        pass


def _taken(coupon: tuple, sequence: int, rate: str | None, trade_date: date | None, source: str | None) -> tuple:
    """A security's state after an event."""
    day, given_at, given, detail_at, detail = coupon
    if rate is None:
        return coupon
    if source == EXCHANGE:
        later = trade_date is not None and (day is None or (trade_date, sequence) > (day, given_at))
        return (trade_date, sequence, rate, detail_at, detail) if later else coupon
    return (day, given_at, given, sequence, rate) if detail_at is None or sequence > detail_at else coupon


def _shown(day: date | None, given_at: int | None, given: str | None, detail_at: int | None, detail: str | None) -> tuple:
    if day is not None:
        return given, day, EXCHANGE
    return detail, None, None if detail_at is None else DETAILS


def _leaders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch the events that no other of it outdoes: of a security the exchange's latest and the details' latest."""
    for batch in batches:
        known = batch[batch["rate"].notna()]
        exchange = known["source"] == EXCHANGE
        dated = known[exchange & known["trade_date"].notna()].sort_values(["trade_date", "sequence"]).drop_duplicates("isin", keep="last")
        yield pd.concat([dated, known[~exchange].sort_values("sequence").drop_duplicates("isin", keep="last")])


def stream_coupons(events: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Keep the coupons of a stream of events (isin, sequence, rate, trade_date, source) in the state store.

    `write` gets each batch's changed coupons (isin, rate, trade_date, source, change) and the batch's number. Takes
    what is there and ends; started again on the same checkpoint it goes on where it stopped. A sequence is unique within
    a security. The session's state store becomes RocksDB, which keyed state needs.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    typed = events.selectExpr("isin", "CAST(sequence AS BIGINT) AS sequence", "CAST(rate AS STRING) AS rate", "trade_date", "source")
    isin = events.schema["isin"].dataType.simpleString()
    out = f"isin {isin}, rate string, trade_date date, source string, change string"
    bucket = F.pmod(F.xxhash64("isin"), F.lit(BUCKETS)).cast("int").alias("bucket")
    typed = typed.mapInPandas(_leaders, typed.schema).select(bucket, "*")
    changed = typed.groupBy("bucket").transformWithState(CouponState(isin), out, "Update", "None")
    return changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
