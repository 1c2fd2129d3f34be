"""Conversations from a stream of turns: keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..model import MESSAGES
from ..sources.requests import message
from ..sources.shared import reach_workers

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store_for_timers(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store; a session that names a store itself keeps it."""
    if spark.conf.get(_PROVIDER, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKSDB)


class _Conversation(StatefulProcessor):
    """Gathers the turns of a key; when none came for ``gap_ms`` of event time, they go out as one conversation."""

    def __init__(self, gap_ms: int, keep_ms: int):
        self.gap_ms, self.keep_ms = gap_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn long, role string, text string")
        self.known = handle.getValueState("known", "timer long, last long, parts int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        timer, last, parts = self.known.get() if self.known.exists() else (None, None, 0)
        got = []
        for r in rows:
            got.append((r["turn"], r["role"], r["text"]))
            at = r["at_ms"] if r["at_ms"] is not None else timerValues.getCurrentWatermarkInMs()
            last = at if last is None else max(last, at)
        self.turns.appendList(got)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = max(last, timerValues.getCurrentWatermarkInMs()) + self.gap_ms
        self.handle.registerTimer(timer)
        self.known.update((timer, last, parts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        timer, last, parts = self.known.get()
        if not self.turns.exists():  # long since gone out: forget it
            self.known.clear()
            return iter(())
        turns = [tuple(t) for t in self.turns.get()]
        self.turns.clear()
        again = timer + self.keep_ms
        self.handle.registerTimer(again)
        self.known.update((again, last, parts + 1))
        first = lambda v: (v is not None, v if v is not None else 0)  # noqa: E731  nulls first
        turns.sort(key=lambda t: (first(t[0]), (t[1] is not None, t[1] or ""), t[2] or ""))
        return iter([Row(key=key[0], part=parts + 1, turns=[Row(role=r, text=x) for _, r, x in turns])])

    def close(self) -> None:
        pass


def conversations_from_stream(turns: DataFrame, ts_col: str = "ts", id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", watermark: str = "10 minutes", gap_seconds: int = 600, keep_seconds: int = 86_400) -> DataFrame:
    """A stream of turns -> one request for each conversation: id_col, part, messages.

    A conversation goes out once the watermark has passed its last turn by ``gap_seconds``; its messages are those of
    ``requests_from_turns`` over the same rows. A turn that comes after that, but not later than the watermark, begins the
    conversation's next ``part``; parts are numbered from 1, and the numbers forgotten ``keep_seconds`` after the last one. A turn
    later than the watermark is dropped, as by every operator with one. Turns without a time count as of the watermark.
    All turns of an open conversation are state of its key.
    """
    state_store_for_timers(turns.sparkSession)
    reach_workers(turns.sparkSession)
    kind = turns.schema[id_col].dataType.simpleString()
    given = turns.withWatermark(ts_col, watermark).select(F.col(id_col).alias("key"), F.col(ts_col).alias("ts"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.unix_millis(F.col(ts_col).cast("timestamp")).alias("at_ms"))
    out = given.groupBy("key").transformWithState(_Conversation(gap_seconds * 1000, keep_seconds * 1000), f"key {kind}, part int, turns array<struct<role: string, text: string>>", "append", "EventTime")
    return out.select(F.col("key").alias(id_col), "part", F.transform("turns", lambda m: message(m["role"], m["text"])).cast(MESSAGES).alias("messages"))
