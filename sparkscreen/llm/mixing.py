"""Mixing sources to target weights by Pareto order sampling.

Every source gets a share of all words by its weight, at most ``most`` times its own words; what is
above that is shared again by weight among the others. A source's documents are first taken whole
as often as its target certainly allows. The rest of the target (``need`` words) is a sample with
unequal probabilities: a document of ``size`` words has the inclusion probability
``p = min(1, c / sqrt(size))``, so that a sample is not a few very long texts, and ``c`` is the number at
which the expected words, the sum of ``p * size``, are ``need``. Documents with ``p = 1`` are certain. The
others are ranked by their random odds ``u/(1-u)`` divided by their inclusion odds ``p/(1-p)`` and taken in that order until
the words are reached; the last one is taken in part.

``c`` follows from the sums over each source's different sizes. Ranks are found without sorting a source:
rank values fall into ``BUCKETS`` buckets (and one of the certain documents), whose word counts are summed; only the bucket in which the target falls is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch_goes, small, table, text_or_empty, written

MOST, WEIGHTS, BUCKETS = 3, 3, 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sources: DataFrame, most: int = MOST, weights: int = WEIGHTS) -> DataFrame:
    """(source, source_size, n) -> plus weight, target, whole (certain copies) and need (words besides).

    One row for each source. Sorted by cap over weight, the sources that stop at their cap come
    first; the level at which the others share is the highest of the levels seen along that order.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    shared = sources.withColumns({"weight": ((F.row_number().over(by_name) - 1) % weights + 1).cast("long"), "cap": F.col("source_size") * most})
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(everything))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size").cast("double"))), F.lit(0))
    return (
        shared.withColumn("level", level)
        .withColumn("target", target)
        .withColumn("whole", whole)
        .withColumn("need", F.floor(F.col("target") + 0.5) - F.col("whole") * F.col("source_size"))
        .select("source", "source_size", "n", "weight", "target", "whole", "need")
    )


def inclusion(counts: DataFrame) -> DataFrame:
    """(source, size, rows, need), one row for each size of a source -> source, size, p.

    A size is certain if all smaller ones are and the words would not suffice with a ``c`` at its
    square root: then words(<= size) + sqrt(size) * roots(> size) <= need.
    """
    up = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    root = F.sqrt(F.col("size").cast("double"))
    sums = counts.filter("size > 0").withColumns({"words": F.sum(F.col("size") * F.col("rows")).over(up), "roots": F.coalesce(F.sum(root * F.col("rows")).over(down), F.lit(0.0))})
    sure = F.col("words") + root * F.col("roots") <= F.col("need")
    told = sums.withColumn("sure", sure)
    taken = F.coalesce(F.max(F.when(F.col("sure"), F.col("words"))).over(whole), F.lit(0))
    rest = F.max(F.when(~F.col("sure"), F.col("roots") + root * F.col("rows"))).over(whole)
    return told.select("source", "size", F.when(F.col("sure"), F.lit(1.0)).otherwise((F.col("need") - taken) / rest / root).alias("p"))


def mix_documents(docs: DataFrame, most: int = MOST, weights: int = WEIGHTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "") -> DataFrame:
    """doc_id, size, source_size, target, taken, source, whole, p (inclusion probability of one copy more).

    Sizes are words; a null text has none, a null source is a source of its own (the last), and
    documents without words are never taken. Random numbers come from the document's id and the seed alone, so
    runs agree; rows with equal ids and sizes can stand for one another. An empty table gives no
    rows. Texts may have any length, and other columns any names.
    """
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(seed)).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    slim = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"), u.alias("u")), "words")
    counts = slim.groupBy("source", "size").agg(F.count("*").alias("rows"))
    per_source = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"))
    sources = written(source_targets(per_source, most, weights), "targets")
    few = sources.count()
    needs = small(sources.select(F.col("source").alias("o"), "need"), few)
    chances = written(inclusion(counts.join(needs, F.col("source").eqNullSafe(F.col("o"))).drop("o")), "chances")
    known = chances.select(F.col("source").alias("o"), F.col("size").alias("z"), "p")
    joined = slim.withColumnRenamed("source", "o").join(small(sources, few), F.col("o").eqNullSafe(F.col("source"))).drop("o")
    joined = joined.join(small(known, chances.count()), F.col("source").eqNullSafe(F.col("o")) & (F.col("size") == F.col("z")), "left").drop("o", "z").withColumn("p", F.coalesce("p", F.lit(0.0)))
    q = F.when(F.col("p") > 0, F.when(F.col("p") >= 1, F.lit(0.0)).otherwise((F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))))
    ranked = written(joined.withColumn("q", q).withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS).cast("int")), "ranked")
    words = ranked.filter("bucket is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("need").alias("want"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = written(words.withColumn("ahead", ahead).filter("ahead < want").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "ahead", (F.col("ahead") + F.col("words") > F.col("want")).alias("crossing")), "buckets")
    found = ranked.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")), "left")
    out = ("doc_id", "source", "size", "source_size", "target", "whole", "p")
    plain = found.filter("crossing is null or not crossing").select(*out, F.when(F.col("crossing").isNull(), F.lit(0)).otherwise(F.col("size")).alias("extra"))
    in_order = Window.partitionBy("source", "bucket").orderBy("q", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("need") - F.col("ahead") - F.coalesce(F.sum("size").over(in_order), F.lit(0))
    edge = found.filter("crossing").select(*out, F.greatest(F.lit(0), F.least(F.col("size"), left)).alias("extra"))
    return plain.unionByName(edge).select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"), "source", "whole", "p")


def mixed_rows(docs: DataFrame, most: int = MOST, weights: int = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: whole copies, and a last one cut after its words.

    A cut text ends with the last word taken; n_chars, if there, follows the text. Rows equal in id and size
    take what was given to them together, in equal parts. Null texts and texts without words are never
    taken. Other columns may have any names.
    """
    key = lambda c: F.xxhash64(c, c.isNull())
    with scratch_goes(docs.sparkSession) as keep:
        mix = keep(written(mix_documents(docs, most, weights), "mix"))
    plan = mix.groupBy("doc_id", "size").agg(F.sum("taken").alias("taken"), F.count("*").alias("rows"))
    plan = plan.filter("taken > 0").select(key(F.col("doc_id")).alias("k"), F.col("size").alias("z"), F.struct("doc_id", "taken", "rows").alias("plan"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key(docs["doc_id"]).alias("k"), word_count(text_or_empty(docs["text"])).alias("z"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("k", "z").orderBy("k")))
    # not as a plain equality, which would become a key of the join and shuffle the texts once more
    own, planned = F.col("row.doc_id"), F.col("plan.doc_id")
    found = numbered.join(plan.hint("merge"), ["k", "z"]).filter(F.coalesce(own == planned, own.isNull() & planned.isNull()))
    taken = F.floor(F.col("plan.taken") / F.col("plan.rows")) + (F.col("nth") <= F.col("plan.taken") % F.col("plan.rows")).cast("int")
    copies = found.withColumn("taken", taken).select("row", "z", "taken", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("z")).cast("int"))).alias("copy")).filter("taken > 0")
    left = (F.col("taken") - (F.col("copy") - 1) * F.col("z")).cast("int")
    text = F.col("row.text")
    # words taken, with what stands before each of them
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, left), "")
    new = {"text": F.when(left >= F.col("z"), text).otherwise(cut)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(new["text"]).cast(docs.schema["n_chars"].dataType)
    return copies.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op5_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM w),
t AS (SELECT *, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
x AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS whole FROM t),
y AS (SELECT d.source, d.size, count(*) AS n, max(floor(x.target + 0.5)::BIGINT - x.whole * x.source_size) AS need FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source WHERE d.size > 0 GROUP BY d.source, d.size),
z AS (SELECT *, sum(size * n) OVER (PARTITION BY source ORDER BY size) AS words, sqrt(size::DOUBLE) AS root,
  coalesce(sum(sqrt(size::DOUBLE) * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS roots FROM y),
v AS (SELECT *, words + root * roots <= need AS sure FROM z),
p AS (SELECT source, size, CASE WHEN sure THEN 1.0::DOUBLE ELSE (need - coalesce(max(CASE WHEN sure THEN words END) OVER (PARTITION BY source), 0))::DOUBLE / max(CASE WHEN NOT sure THEN roots + root * n END) OVER (PARTITION BY source) / root END AS p FROM v),
r AS (SELECT d.doc_id, d.size, x.source, x.source_size, x.target, x.whole, floor(x.target + 0.5)::BIGINT - x.whole * x.source_size AS need,
  CASE WHEN p.p >= 1 THEN 0 WHEN p.p > 0 THEN (u / (1 - u)) / (p.p / (1 - p.p)) END AS q FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.size = p.size),
c AS (SELECT *, coalesce(sum(CASE WHEN size > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM r)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, need - ahead)) AS BIGINT) AS taken FROM c
"""
