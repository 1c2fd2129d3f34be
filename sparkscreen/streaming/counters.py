"""Counters that run on: totals kept by a stream, their snapshots as a series, and rates over the series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import provider_label

#: Counter names and the labels that each has.
COUNTERS = {"requests_total": ("decision", "provider"), "blocked_total": ("code",), "redacted_total": (), "response_redacted_total": (), "errors_total": ("error_class",)}
_KEY = ("metric", "labels")


def increments(events: DataFrame) -> DataFrame:
    """(metric, labels) for each counter that an event raises: labels is a map, without those that are null.

    Events have any of decision, provider, code, total_redactions and error_class; what a table lacks raises nothing.
    """
    has = lambda c, kind="string": F.col(c).cast(kind) if c in events.columns else F.lit(None).cast(kind)
    values = {"decision": has("decision"), "provider": provider_label(F.coalesce(has("provider"), F.lit(""))), "code": has("code"), "error_class": has("error_class")}
    raised = {
        "requests_total": values["decision"].isNotNull(),
        "blocked_total": values["decision"] == "block",
        "redacted_total": values["decision"] == "redact",
        "response_redacted_total": has("total_redactions", "long") > 0,
        "errors_total": values["error_class"].isNotNull(),
    }
    none = F.array().cast("array<struct<key: string, value: string>>")
    each = []
    for name, labels in COUNTERS.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("key"), values[c].alias("value")) for c in labels]) if labels else none
        # as text, since maps cannot be grouped by
        text = F.to_json(F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())))
        each.append(F.when(raised[name], F.struct(F.lit(name).alias("metric"), text.alias("labels"))))
    return events.select(F.explode(F.array_compact(F.array(*each))).alias("c")).select("c.metric", "c.labels")


def totals(events: DataFrame) -> DataFrame:
    """metric, labels (JSON), value: of a table the counters' values, of a stream their running values (update or complete mode)."""
    return increments(events).groupBy(*_KEY).agg(F.count("*").alias("value"))


def run_counters(events: DataFrame, path: str, checkpoint: str, **trigger):
    """Keeps the totals of a stream and writes those that a micro-batch changed, with the time, as a series under ``path``.

    Totals are state: they go on after a restart with the same checkpoint. A batch that is run again replaces its own
    snapshot. With a new checkpoint counters begin at zero, which the rates below understand.
    """

    def snapshot(df: DataFrame, number: int) -> None:
        df.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return totals(events).writeStream.outputMode("update").foreachBatch(snapshot).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("metric string, labels string, value long, at timestamp, batch long").parquet(path)


def _steps(series: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each snapshot's step: what the counter rose by since the one before. A value below that is a counter begun anew, and all of it is new."""
    before = F.lag("value").over(Window.partitionBy(*by).orderBy(*order))
    return series.withColumn("step", F.when(before.isNull() | (F.col("value") < before), F.col("value")).otherwise(F.col("value") - before))


def increase(series: DataFrame, window: str = "5 minutes", at_col: str = "at", order: Sequence[str] = ("at", "batch"), by: Sequence[str] = _KEY) -> DataFrame:
    """metric, labels, window_start, increase and rate a second of each window, from snapshots, across resets.

    A counter's first snapshot counts whole. A counter has one snapshot for each micro-batch that changed it, so its
    window is as long as the series; sums within a window follow.
    """
    found = _steps(series, by, order).groupBy(*by, F.window(at_col, window).alias("w")).agg(F.sum("step").alias("increase"))
    seconds = (F.col("w.end").cast("double") - F.col("w.start").cast("double"))
    return found.select(*by, F.col("w.start").alias("window_start"), "increase", (F.col("increase") / seconds).alias("rate"))
