"""One micro-batch of bodies, decided once, to four tables that hold each row exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.pipeline import Pipeline
from ..sources.audit import audit_records
from ..sources.requests import parse_requests, quarantine

FORWARDED, BLOCKED, REJECTED, AUDIT = "forwarded", "blocked", "rejected", "audit"
_STAGED = "_staged"


def _folder(path: str, kind: str, number: int) -> str:
    return f"{path}/{kind}/batch={number}"


def write_screened(df: DataFrame, number: int, pipeline: Pipeline, path: str, **parse) -> None:
    """One micro-batch: parsed and decided once, written once, and dealt to its tables from there.

    Every folder carries the number of the batch and is replaced as a whole, so a batch that is run again after a
    failure, wherever that was, leaves no double and no half. Identities that are made here (request_id, received_at) are
    fixed by the first writing, from which all four tables are taken.
    """
    good, bad = quarantine(parse_requests(df, **{"salt": str(number), **parse}))
    staged = lambda kind: _folder(path, f"{_STAGED}-{kind}", number)
    spark = df.sparkSession
    decided = pipeline.run(good).drop("extra")  # a map of variants, which the tables of decisions do not need
    decided.write.mode("overwrite").parquet(staged("decided"))
    bad.drop("messages", "extra", "model", "stream").write.mode("overwrite").parquet(_folder(path, REJECTED, number))
    rows = spark.read.schema(decided.schema).parquet(staged("decided"))
    rows.filter("decision <> 'block'").write.mode("overwrite").parquet(_folder(path, FORWARDED, number))
    rows.filter("decision = 'block'").write.mode("overwrite").parquet(_folder(path, BLOCKED, number))
    audit_records(rows).write.mode("overwrite").json(_folder(path, AUDIT, number))
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged("decided"))
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def run_screening(bodies: DataFrame, pipeline: Pipeline, path: str, checkpoint: str, trigger: dict | None = None, **parse):
    """A stream of bodies into ``path``: forwarded, blocked and rejected rows and audit records, as tables by batch."""
    one = lambda df, number: write_screened(df, number, pipeline, path, **parse)
    return bodies.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_screened(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One of the tables, with the batch of each row. Parts that no batch has completed are not seen."""
    reader = spark.read.option("basePath", f"{path}/{kind}")
    return reader.json(f"{path}/{kind}/batch=*") if kind == AUDIT else reader.parquet(f"{path}/{kind}/batch=*")
