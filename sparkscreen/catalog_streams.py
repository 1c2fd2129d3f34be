"""Registered queries of stateful streams: conversations, counters, panes, quantile sketches, exactly-once tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .catalog import _ERROR, _KIND, _SLIDING, _bodies, _decided_events, _plain_start, _stream, _t, query
from .operators import metrics as M
from .operators import stages as S
from .plans.pipeline import Pipeline
from .sources.shared import scratch_path
from .streaming import assemble as SA
from .streaming import counters as SC
from .streaming import rates as SR
from .streaming import sinks as SS


_NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def run_in_batches(df: DataFrame, parts: Sequence[Column], label: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Runs the stream that ``start`` begins over the rows, as one micro-batch for each condition of ``parts``, in this order.

    The rows of a micro-batch lie in as many files as tasks wrote them, so no task takes a whole batch. The stream is
    stopped after each batch and goes on from its checkpoint; what only time passing brings about comes after the last.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(_NO_DATA)
    for n, part in enumerate(parts):
        df.filter(part).write.mode("append").parquet(path)
        try:
            spark.conf.set(_NO_DATA, before if n == len(parts) - 1 else "false")
            start(spark.readStream.schema(df.schema).parquet(path)).awaitTermination()
        finally:
            spark.conf.set(_NO_DATA, before)


def _started(stream, state: str) -> StreamingQuery:
    return stream.option("checkpointLocation", state).trigger(availableNow=True).start()


@query("SELECT conv_id, 1 AS part, count(*)::INT AS n_messages, string_agg(role || ':' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS said FROM conversations GROUP BY conv_id")
def stream_conversations(spark, sf_dir):
    """Turns of every conversation arrive in two micro-batches, the odd ones first; a last row of a later time closes all."""
    turns = _t(spark, sf_dir, "conversations").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn")))
    last = turns.agg(F.max("turn").alias("turn")).select(F.lit(-1).cast("long").alias("conv_id"), "turn", F.lit("user").alias("role"), F.lit("").alias("text"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("ts"))
    own = F.col("conv_id") >= 0
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    out, state = scratch_path(spark, "conversations"), scratch_path(spark, "conversations-state")
    found = lambda stream: SA.conversations_from_stream(stream).select("conv_id", "part", F.size("messages").alias("n_messages"), said.alias("said"))
    start = lambda stream: _started(found(stream).writeStream.format("parquet").option("path", out), state)
    run_in_batches(turns.unionByName(last), [own & (F.col("turn") % 2 == 1), own & (F.col("turn") % 2 == 0), ~own], "turns", start)
    return spark.read.schema("conv_id long, part int, n_messages int, said string").parquet(out)


_EVENT_COUNTERS = """SELECT 'requests_total' AS metric, '{"decision":"' || decision || '","provider":"other"}' AS labels, count(*) AS value FROM e GROUP BY decision
UNION ALL SELECT 'blocked_total', '{"code":"' || event_type || '"}', count(*) FROM e WHERE decision = 'block' GROUP BY event_type
UNION ALL SELECT 'redacted_total', '{}', count(*) FROM e WHERE decision = 'redact'
UNION ALL SELECT 'response_redacted_total', '{}', count(*) FROM e WHERE event_id % 4 > 0
UNION ALL SELECT 'errors_total', '{"error_class":"' || event_type || '"}', count(*) FROM e GROUP BY event_type"""


@query(f"WITH e AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'block' WHEN 1 THEN 'redact' ELSE 'allow' END AS decision FROM events), c AS ({_EVENT_COUNTERS}) SELECT *, value AS increase FROM c")
def stream_counters(spark, sf_dir):
    """All counters over five micro-batches: the last value of each, and what its snapshots rose by altogether."""
    events = _decided_events(spark, sf_dir).withColumn("error_class", F.col("event_type")).drop("received_at", "value")
    n = F.pmod(F.xxhash64("code", "total_redactions", "decision"), F.lit(5))
    path, state = scratch_path(spark, "counters"), scratch_path(spark, "counters-state")
    run_in_batches(events, [n == i for i in range(5)], "events", lambda stream: SC.run_counters(stream, path, state))
    series = SC.read_counters(spark, path)
    values = series.groupBy("metric", "labels").agg(F.max_by("value", "batch").alias("value"))
    rose = SC.increase(series, "3650 days").groupBy("metric", "labels").agg(F.sum("increase").alias("increase"))
    return values.join(rose, ["metric", "labels"])


@query(f"WITH {_SLIDING}, m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTES AS mark FROM events) SELECT window_start, decision, count(*) AS n, count(*) / 300.0::DOUBLE AS rate FROM e, m WHERE window_start + INTERVAL 5 MINUTES <= mark GROUP BY 1, 2")
def stream_sliding_rate(spark, sf_dir):
    """Sliding windows of a stream from panes, two stateful steps: the windows that the watermark has passed."""
    events = _stream(spark, sf_dir, "events")
    kind = F.pmod("event_id", F.lit(3))
    decided = events.select(F.col("ts").cast("timestamp").alias("received_at"), F.when(kind == 0, "block").when(kind == 1, "redact").otherwise("allow").alias("decision"))
    found, out = SR.decision_rate(decided), scratch_path(spark, "sliding")
    _started(found.writeStream.outputMode("append").format("parquet").option("path", out), scratch_path(spark, "sliding-state")).awaitTermination()
    return _plain_start(spark.read.schema(found.schema).parquet(out))


_HOURS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2"


@query(f"SELECT *, true AS within_p50, true AS within_p95, true AS within_p99 FROM ({_HOURS})")
def quantile_sketches(spark, sf_dir):
    """Sketches of half minutes, stored, and merged for hours; the quantiles' ranks are held against all values of the hour."""
    events = _t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "sketches")
    M.quantile_sketches(events, "value", "ts", ["event_type"]).write.parquet(path)
    merged = M.merged_quantiles(spark.read.parquet(path), (0.5, 0.95, 0.99), ["event_type"], "1 hour")
    values = events.filter("value is not null").select(F.window("ts", "1 hour")["start"].alias("window_start"), "event_type", "value")
    met = values.join(merged, ["window_start", "event_type"])
    counts = [c for q in (50, 95, 99) for c in (F.count_if(F.col("value") < F.col(f"p{q}")).alias(f"less{q}"), F.count_if(F.col("value") <= F.col(f"p{q}")).alias(f"most{q}"))]
    ranks = met.groupBy("window_start", "event_type", "n").agg(*counts)
    within = lambda q: ((F.col(f"less{q}") <= (q / 100 + M.RANK_ERROR) * F.col("n")) & (F.col(f"most{q}") >= (q / 100 - M.RANK_ERROR) * F.col("n"))).alias(f"within_p{q}")
    return _plain_start(ranks.select("window_start", "event_type", "n", within(50), within(95), within(99)))


_SCREENED = f"""WITH d AS (SELECT doc_id, text, {_KIND} AS kind FROM documents), e AS (SELECT *, {_ERROR} AS e FROM d)
SELECT doc_id::VARCHAR AS request_id, CASE WHEN e IS NOT NULL THEN 'rejected' WHEN kind <> 'null content' AND (contains(lower(text), 'scum') OR contains(lower(text), 'moron')) THEN 'blocked' ELSE 'forwarded' END AS kind, 1 AS rows_there, CASE WHEN e IS NULL THEN 1 ELSE 0 END AS audited FROM e"""


@query(_SCREENED)
def stream_screened_tables(spark, sf_dir):
    """Bodies of every document, in three micro-batches, into forwarded, blocked, rejected and audit tables: where each row is, and how often."""
    n = F.pmod("doc_id", F.lit(3))
    path, state, words = scratch_path(spark, "screened"), scratch_path(spark, "screened-state"), Pipeline([S.PolicyEngine([S.PolicyRule("words", ("scum", "moron"))])])
    run_in_batches(_bodies(spark, sf_dir).drop("kind"), [n == i for i in range(3)], "bodies", lambda stream: SS.run_screening(stream, words, path, state, path_col="path"))
    kinds = [SS.read_screened(spark, path, k).select("request_id", F.lit(k).alias("kind")) for k in (SS.FORWARDED, SS.BLOCKED, SS.REJECTED)]
    there = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("request_id", "kind").agg(F.count("*").cast("int").alias("rows_there"))
    audited = SS.read_screened(spark, path, SS.AUDIT).groupBy(F.col("request_id").cast("string").alias("request_id")).agg(F.count("*").cast("int").alias("audited"))
    return there.join(audited, "request_id", "left").select("request_id", "kind", "rows_there", F.coalesce("audited", F.lit(0)).alias("audited"))
