"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import scratch_path, small_batches


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package where it is not installed (same path, or --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is executed within leaves no shuffle files behind, as its result is written or collected."""
    before = spark.conf.get(_CLEANUP_CONF, None)
    spark.conf.set(_CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP_CONF) if before is None else spark.conf.set(_CLEANUP_CONF, before)


_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors.

    The shuffle files of making it go at once; its own folder stays until ``discard``, or the end of ``scratch_goes``.
    """
    path = scratch_path(df.sparkSession, label)
    if (scratch := _SCRATCH.get()) is not None:
        scratch.append(path)
    with shuffles_go(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _FOLDERS[out] = path
    return out


def _removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Removes the folders of ``written`` tables that nothing reads any more."""
    for df in frames:
        _removed(df.sparkSession, _FOLDERS.pop(df))


@contextmanager
def scratch_goes(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables ``written`` within are removed at the end, but for those given to the function that it yields.

    What is used afterwards may read those only. They go with the scratch around, if there is one.
    """
    made: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(_FOLDERS[df])
        return df

    token = _SCRATCH.set(made)
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        for path in made:
            if path not in kept:
                _removed(spark, path)
        if (around := _SCRATCH.get()) is not None:
            around += kept


#: At most so many keys are hubs, and never one with fewer rows than LEAST_HUB.
HUBS, LEAST_HUB = 10_000, 200


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row for each key and, in ``count``, how many of ``rows`` hold it.

    Keys with more than one in HUBS of all ``total`` rows are hubs: there are HUBS of them at most, so
    they are broadcast, and their rows stay where they are. The others are joined by a shuffle.
    """
    hub = F.col(count) > max(LEAST_HUB, total // HUBS)
    hubs = F.broadcast(keyed.filter(hub))
    others = rows.join(F.broadcast(keyed.filter(hub).select(*on)), on, "left_anti").join(keyed.filter(~hub), on)
    return rows.join(hubs, on).unionByName(others)


#: A side is broadcast up to so many bytes.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """``df`` marked for broadcast if its counted rows, of about ``row_bytes`` each, are within the bound, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


RANGE_ROWS = 1 << 18


def numbered(rows: DataFrame, group: str, order: list[str], range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``pos`` from 0 in their group, by ``order``, and ``total``, the rows of the group; and (group, total).

    Sorted over all tasks and counted by prefix sums over the sorted ranges, so that a group may hold any part of
    all rows. Nulls come first. Rows equal in ``order`` are told apart by where they stand in the (written) input.
    """
    given = written(rows.withColumn("tie", F.monotonically_increasing_id()), "unordered")
    keys = [group, *order, "tie"]
    ordered = given.repartitionByRange(max(1, -(-given.count() // range_rows)), *keys).sortWithinPartitions(*keys)
    ordered = written(ordered.drop("tie").withColumn("at", F.monotonically_increasing_id()), "ordered")
    discard(given)
    in_range, at = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row for each pair of a range and a group that meet: no more than ranges and groups together
    met = written(ordered.groupBy(in_range.alias("range"), F.col(group).alias("met_group")).agg(F.count("*").alias("n"), F.min(at).alias("first")), "met")
    whole = met.groupBy(F.col("met_group").alias(group)).agg(F.sum("n").alias("total"))
    own = Window.partitionBy("met_group")
    before = met.select("range", "met_group", (F.sum("n").over(own.orderBy("range")) - F.col("n") - F.col("first")).alias("skip"), F.sum("n").over(own).alias("total"))
    found = ordered.join(small(before, met.count(), 128), (in_range == F.col("range")) & F.col(group).eqNullSafe(F.col("met_group")))
    return found.select(*rows.columns, (F.col("skip") + at).alias("pos"), "total"), whole


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or with underscores behind it, so that no column is called so."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def sizes(df: DataFrame, rows_per_task: int) -> int:
    """Tasks for a table that is already written, so that counting it reads footers only."""
    return max(1, -(-df.count() // rows_per_task))
