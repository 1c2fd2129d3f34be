"""Audit records: from decided requests to NDJSON and back. They never hold message text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import iso_millis
from ..model import AUDIT_SCHEMA
from .shared import scratch_path


def audit_records(decided: DataFrame) -> DataFrame:
    """Columns of AUDIT_SCHEMA; latencies and names that ``decided`` lacks become defaults."""
    has = lambda c, kind, default=None: F.col(c) if c in decided.columns else F.lit(default).cast(kind)
    return decided.select(
        iso_millis(has("received_at", "timestamp")).alias("timestamp"),
        has("request_id", "string").cast("string").alias("request_id"),
        "decision",
        "stage",
        "reason",
        "code",
        "score",
        F.coalesce(has("model", "string"), F.lit("")).alias("model"),
        F.coalesce(has("provider", "string"), F.lit("")).alias("provider"),
        F.size("messages").alias("message_count"),
        F.when(F.col("decision") == "redact", F.col("entities")).otherwise(F.array().cast("array<string>")).alias("pii_entities_found"),
        F.coalesce(has("latency_pipeline_ms", "double"), F.lit(0.0)).alias("latency_pipeline_ms"),
        F.coalesce(has("latency_total_ms", "double"), F.lit(0.0)).alias("latency_total_ms"),
    )


def write_audit(records: DataFrame, path: str, records_per_file: int = 1_000_000, mode: str = "append") -> None:
    """NDJSON by day, in files of bounded length."""
    dated = records.withColumn("date", F.substring("timestamp", 1, 10))
    dated.write.mode(mode).option("maxRecordsPerFile", records_per_file).partitionBy("date").json(path)


MAX_FILE_BYTES, RANGE_RECORDS = 100 << 20, 1 << 20
#: Files of at most so many bytes are rows, as many for a task as given here or as its bytes allow; a larger file has a task of its own.
ROW_FILE_BYTES, TASK_FILES, TASK_BYTES = 1 << 20, 128, 32 << 20


def write_audit_bounded(records: DataFrame, path: str, max_bytes: int = MAX_FILE_BYTES, mode: str = "append", range_records: int = RANGE_RECORDS) -> None:
    """NDJSON by day, no file larger than ``max_bytes``, each written by one task; a record larger than that has a file of its own.

    A record's place is the sum of the bytes of its day before it, in order of time, by prefix sums over sorted ranges;
    its file follows from that place. Files of up to 1 MB are gathered to one row each, and a task writes many of them
    (as text, so their names end in ``.txt``); with a larger bound, each file has a task of its own (``.json``).
    """
    spark = records.sparkSession
    if max_bytes < 1:
        raise ValueError("files of at least one byte")
    line = F.to_json(F.struct(*[F.col(c) for c in records.columns]))
    sized = records.select(F.struct(*[F.col(c) for c in records.columns]).alias("r"), F.substring("timestamp", 1, 10).alias("date"), (F.octet_length(line) + 1).cast("long").alias("bytes"))
    sized = _kept(sized.withColumn("tie", F.monotonically_increasing_id()), "audit-sized")
    shared = F.when(F.col("bytes") * 2 <= max_bytes, F.col("bytes"))
    count, most, total, large = sized.agg(F.count("*"), F.max(shared), F.coalesce(F.sum(shared), F.lit(0)), F.count_if(shared.isNull())).first()
    keys = ["date", "r.timestamp", "r.request_id", "tie"]
    ordered = sized.repartitionByRange(max(1, -(-count // range_records)), *keys).sortWithinPartitions(*keys)
    # large records stand alone; a file takes the others whose first byte lies in its share, which leaves room for one more
    alone = F.col("bytes") * 2 > max_bytes
    ordered = _kept(ordered.select("r", "date", F.when(alone, 0).otherwise(F.col("bytes")).alias("bytes"), alone.alias("alone"), F.monotonically_increasing_id().alias("at")), "audit-ordered")
    in_range = F.shiftright("at", 33)
    sums = ordered.groupBy(in_range.alias("range"), "date").agg(F.sum("bytes").alias("bytes"), F.count_if("alone").alias("large"))
    before = Window.partitionBy("date").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = sums.select("range", F.col("date").alias("_day"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("skip"), F.coalesce(F.sum("large").over(before), F.lit(0)).alias("skip_large"))
    within = Window.partitionBy("range", "date").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.withColumn("range", in_range).withColumns({"own": F.coalesce(F.sum("bytes").over(within), F.lit(0)), "own_large": F.coalesce(F.count_if("alone").over(within), F.lit(0))})
    joined = placed.join(F.broadcast(start.withColumnRenamed("range", "_range")), (F.col("range") == F.col("_range")) & F.col("date").eqNullSafe(F.col("_day")))
    share = max(1, max_bytes - (most or 0))
    number = F.when(F.col("alone"), F.col("skip_large") + F.col("own_large")).otherwise(F.floor((F.col("skip") + F.col("own")) / share).cast("long"))
    numbered = joined.select("r", "date", "alone", "at", number.alias("file"))
    if max_bytes <= ROW_FILE_BYTES:
        tasks = max(1, -(-(total // share + large) // TASK_FILES), -(-total // TASK_BYTES))
        text = F.expr("listagg(to_json(r), '\n') WITHIN GROUP (ORDER BY at)")
        rows = numbered.repartition(tasks, "date", "alone", "file").groupBy("date", "alone", "file").agg(text.alias("value"))
        rows.select("value", "date").write.mode(mode).option("maxRecordsPerFile", 1).partitionBy("date").text(path)
        return
    # one number for all days: files of each day and kind, after one another; one row for each day and kind
    kinds = numbered.groupBy("date", "alone").agg(F.max("file").alias("last")).collect()
    first, files = [], 0
    for k in sorted(kinds, key=lambda k: (k["date"] or "", k["alone"])):
        first.append((k["date"], k["alone"], files))
        files += k["last"] + 1
    if not files:
        records.withColumn("date", F.lit("")).write.mode(mode).partitionBy("date").json(path)
        return
    firsts = F.broadcast(spark.createDataFrame(first, "day string, is_alone boolean, first long"))
    ids = numbered.join(firsts, F.col("date").eqNullSafe(F.col("day")) & (F.col("alone") == F.col("is_alone"))).withColumn("id", (F.col("first") + F.col("file")).cast("int"))
    ids.repartitionById(files, F.col("id")).sortWithinPartitions("at").select("r.*", "date").write.mode(mode).partitionBy("date").json(path)


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).json(path)


def stream_audit(records: DataFrame, path: str, checkpoint: str, **trigger):
    """The same sink for a stream, appended with a checkpoint."""
    dated = records.withColumn("date", F.substring("timestamp", 1, 10))
    return dated.writeStream.format("json").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
