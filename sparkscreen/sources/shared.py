"""The folder that the driver and all executors share."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed (same path, or --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), root]))


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. A local session without one gets a new temporary
    folder; a cluster session gets an error, because executors would not see such a folder."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, label: str) -> str:
    return posixpath.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


#: Texts go to Python in batches of so many bytes, unless the session's own configuration says otherwise.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at once, whatever the number of rows."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


#: A table with less than so many bytes for each core may be a few row groups, or one, and as few tasks.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over all cores if it is so small that its files may be read by fewer; a larger one is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df
