"""Sharding by sampled splitters: shards of near-equal bytes over a range-partitioned key.

Records are ordered by (hash of the text, hash of the row), so equal texts lie together and a hot
group can still be cut. Each round draws a size-weighted key sample inside every range that is
overfull (at first all rows are one range), takes quantile boundaries from it, and measures the
ranges exactly. Prefix sums over the ranges then place every record.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sizes, small, table, text_or_empty, written

SHARDS, RANGES_PER_SHARD, ROWS_PER_RANGE, SAMPLES_PER_RANGE, ROUNDS = 40, 4, 1_000_000, 16, 12
_UNIT = float(1 << 53)


def _uniform(*cols: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(_UNIT)


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of bounds at or below the key (h, t): first among every step-th bound, then among ``step``."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    keys = lambda some: F.arrays_zip(F.lit([h for h, _ in some]).alias("h"), F.lit([t for _, t in some]).alias("t"))
    passed = lambda b: (b["h"] < F.col("h")) | ((b["h"] == F.col("h")) & (b["t"] <= F.col("t")))
    coarse = step * F.size(F.filter(keys(bounds[step - 1 :: step]), passed)) if len(bounds) >= step else F.lit(0)
    return coarse + F.size(F.filter(F.slice(keys(bounds), coarse + 1, step), passed))


def split_ranges(keyed: DataFrame, ranges: int, per_range: int = SAMPLES_PER_RANGE, rounds: int = ROUNDS) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Boundaries of (h, t), and (range, bytes, rows) of the ranges between them.

    ``keyed`` has h, t and size. The driver receives about ``ranges * per_range`` sampled keys a
    round and one row for each range.
    """
    bounds: list[tuple[int, int]] = []
    for n in range(rounds + 1):
        measured = keyed.withColumn("range", _range_of(bounds)).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("largest")).collect()
        stats = sorted((r["range"], r["bytes"], r["rows"]) for r in measured)
        goal = max(1.0, sum(b for _, b, _ in stats) / ranges)
        full = [r["range"] for r in measured if r["bytes"] - r["largest"] > 2 * goal]
        if not full:
            return bounds, stats
        if n == rounds:
            raise RuntimeError(f"{len(full)} ranges are still overfull after {rounds} rounds")
        step = goal / per_range
        in_full = F.col("range").isin(full) if bounds else F.lit(True)
        weight = F.col("size") / F.lit(step)
        drawn = keyed.withColumn("range", _range_of(bounds)).filter(in_full & (_uniform(F.col("h"), F.col("t"), F.lit(n)) < weight)).select("range", "h", "t", F.greatest(weight, F.lit(1.0)).alias("w"))
        new, at, last = [], 0.0, None
        for r, h, t, w in sorted(map(tuple, drawn.collect())):
            at = at + w if r == last else w
            last = r
            if at >= per_range:
                new.append((h, t))
                at = 0.0
        bounds = sorted(set(bounds) | set(new))
    raise AssertionError


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's UTF-8 bytes plus 16; a null text counts as empty. Law ``bytes``: a record
    belongs to the shard that holds the middle of its bytes in key order, so shards differ by at
    most about one record. A range is sorted in one task; there are more of them as the table grows, of
    about ``ROWS_PER_RANGE`` rows each, and never fewer than ``RANGES_PER_SHARD`` a shard. Repeated rows are records of their own. An empty table gives no rows.
    """
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row"))
    keyed = written(base.withColumn("t", F.xxhash64("doc_id", "row")), "sizes")
    bounds, stats = split_ranges(keyed, max(shards * RANGES_PER_SHARD, sizes(keyed, ROWS_PER_RANGE)))
    total, before, rows, bases = sum(b for _, b, _ in stats), 0, 0, []
    for r, b, n in stats:
        bases.append((r, before, rows))
        before, rows = before + b, rows + n
    starts = small(docs.sparkSession.createDataFrame(bases, "range int, bytes_before long, rows_before long"), len(bases))
    in_order = Window.partitionBy("range").orderBy("h", "t", "row")
    before_row = F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = 2 * (F.col("bytes_before") + F.col("inside")) + F.col("size")
    placed = (
        keyed.withColumn("range", _range_of(bounds))
        .withColumns({"inside": before_row, "rank": F.row_number().over(in_order) - 1})
        .join(starts, "range")
        .select("doc_id", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * max(1, total)))).cast("int").alias("shard"), (F.col("rows_before") + F.col("rank")).alias("rank"))
    )
    placed = written(placed, "placed")
    firsts = small(placed.groupBy("shard").agg(F.min("rank").alias("first")), shards)
    return placed.join(firsts, "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
