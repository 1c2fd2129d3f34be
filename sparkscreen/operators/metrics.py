"""Counters and histograms as aggregates, and quantiles from buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import provider_label

# Bucket bounds in seconds.
PIPELINE_BUCKETS = (0.00005, 0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1)
STAGE_BUCKETS = (0.00001, 0.00005, 0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05)
REQUEST_BUCKETS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)


def requests_total(decided: DataFrame) -> DataFrame:
    return decided.groupBy("decision", provider_label(F.col("provider")).alias("provider")).agg(F.count("*").alias("requests"))


def blocked_total(decided: DataFrame) -> DataFrame:
    return decided.filter("decision = 'block'").groupBy("code").agg(F.count("*").alias("blocked"))


def redacted_total(decided: DataFrame) -> DataFrame:
    return decided.agg(F.count_if(F.col("decision") == "redact").alias("redacted"))


def response_redacted_total(redacted: DataFrame) -> DataFrame:
    return redacted.agg(F.count_if(F.col("total_redactions") > 0).alias("response_redacted"))


def errors_total(log: DataFrame, class_col: str) -> DataFrame:
    return log.groupBy(F.col(class_col).alias("error_class")).agg(F.count("*").alias("errors"))


def entity_counts(with_records: DataFrame, records_col: str = "records") -> DataFrame:
    return with_records.select(F.explode(records_col).alias("r")).groupBy(F.col("r.entity_type").alias("entity_type")).agg(F.count("*").alias("redactions"), F.sum("r.length").alias("total_length"))


def histogram(df: DataFrame, value_col: str, buckets: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """labels, le (null: no bound), cumulative count, and the whole sum: one pass, one row for each bucket."""
    counts = [F.sum(F.when(F.col(value_col) <= b, 1).otherwise(0)).alias(f"_b{i}") for i, b in enumerate(buckets)]
    wide = df.groupBy(*labels).agg(*counts, F.count(value_col).alias("_all"), F.sum(value_col).alias("total"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").cast("long").alias("count")) for i, b in enumerate(buckets)]
    rows.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("_all").alias("count")))
    return wide.select(*labels, F.explode(F.array(*rows)).alias("b"), "total").select(*labels, "b.le", "b.count", "total")


def histogram_quantile(hist: DataFrame, q: float, labels: Sequence[str] = ()) -> DataFrame:
    """Linear interpolation in the bucket that holds the quantile; beyond the last bound that bound is given.

    A histogram has a few rows for each label set, so the window is small whatever was counted.
    """
    w = Window.partitionBy(*labels).orderBy(F.col("le").asc_nulls_last())
    every = Window.partitionBy(*labels)
    steps = hist.withColumns({"below": F.coalesce(F.lag("count").over(w), F.lit(0)), "low": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "whole": F.max("count").over(every), "top": F.max("le").over(every)})
    rank = F.col("whole") * F.lit(q)
    hit = steps.filter((F.col("whole") > 0) & (F.col("count") >= rank) & ((F.col("below") < rank) | (F.col("below") == 0))).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    inside = F.col("low") + (F.col("le") - F.col("low")) * F.try_divide(rank - F.col("below"), F.col("count") - F.col("below"))
    return hit.select(*labels, F.when(F.col("le").isNull(), F.col("top")).otherwise(inside).alias("quantile"))


def _seconds(interval: str) -> float:
    """Seconds of an interval text like "30 seconds"."""
    units = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800, "millisecond": 0.001}
    words = interval.lower().replace("interval", "").split()
    if len(words) % 2 or any(u.rstrip("s") not in units for u in words[1::2]):
        raise ValueError(f"an interval of numbers and units, not {interval!r}")
    return sum(float(n) * units[u.rstrip("s")] for n, u in zip(words[::2], words[1::2]))


def _in_panes(window: str, slide: str | None) -> bool:
    """Windows are whole numbers of slides."""
    return slide is not None and _seconds(window) / _seconds(slide) % 1 == 0 and _seconds(window) > _seconds(slide)


def in_windows(df: DataFrame, ts_col: str, labels: Sequence[str], window: str, slide: str | None, first, then) -> DataFrame:
    """``first`` aggregates of each window and label set, as struct column ``w`` and the labels.

    Sliding windows are made of panes as long as the slide: rows are aggregated once, in their pane, and ``then``
    aggregates panes into the windows that hold them, so that not rows are copied but panes. ``then`` must give from
    ``first`` of panes what ``first`` gives from all their rows. On a stream that is two stateful steps (append mode).
    """
    if not _in_panes(window, slide):
        by = F.window(ts_col, window, slide) if slide else F.window(ts_col, window)
        return df.groupBy(by.alias("w"), *labels).agg(*first)
    panes = df.groupBy(F.window(ts_col, slide).alias("w"), *labels).agg(*first)
    return panes.groupBy(F.window("w", window, slide).alias("w2"), *labels).agg(*then).withColumnRenamed("w2", "w")


def window_rate(df: DataFrame, ts_col: str, labels: Sequence[str], window: str = "5 minutes", slide: str | None = None, seconds: int = 300) -> DataFrame:
    """Events a second for each window and label set; windows without events give no row."""
    counted = in_windows(df, ts_col, labels, window, slide, [F.count("*").alias("n")], [F.sum("n").alias("n")])
    return counted.select(F.col("w.start").alias("window_start"), *labels, "n", (F.col("n") / seconds).alias("rate"))


#: Accuracy of a stored quantile sketch: the rank of what it gives is off by at most RANK_ERROR of all values.
SKETCH_K, RANK_ERROR = 800, 0.01


def quantile_sketches(df: DataFrame, value_col: str, ts_col: str, labels: Sequence[str] = (), pane: str = "30 seconds", k: int = SKETCH_K) -> DataFrame:
    """pane_start, labels, n, sketch: for each pane and label set a KLL sketch of the values, a few kilobytes however many they are.

    To be stored, and merged by ``merged_quantiles`` for any longer window. Null values do not count; panes without values give no row.
    """
    some = df.filter(F.col(value_col).isNotNull())
    found = some.groupBy(F.window(ts_col, pane).alias("w"), *labels).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value_col).cast("double"), F.lit(k)).alias("sketch"))
    return found.select(F.col("w.start").alias("pane_start"), *labels, "n", "sketch")


def merged_quantiles(sketches: DataFrame, quantiles: Sequence[float], labels: Sequence[str] = (), window: str | None = None, slide: str | None = None) -> DataFrame:
    """window_start, labels, n and p50, p95, ... of stored sketches: of each window, or without one of all panes together.

    Only sketches are shuffled, one for each pane and label set; merging keeps the error bound, in whatever order.
    """
    by = [] if window is None else [(F.window("pane_start", window, slide) if slide else F.window("pane_start", window)).alias("w")]
    found = sketches.groupBy(*by, *labels).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("s"))
    start = [] if window is None else [F.col("w.start").alias("window_start")]
    return found.select(*start, *labels, "n", *[F.kll_sketch_get_quantile_double("s", F.lit(float(q))).alias(f"p{round(q * 100)}") for q in quantiles])


def with_responses(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Request audit records with what was redacted in their responses."""
    right = responses.select("request_id", F.col("total_redactions").alias("response_redactions"))
    return requests.join(right, "request_id", "left").withColumn("response_redactions", F.coalesce("response_redactions", F.lit(0)))
