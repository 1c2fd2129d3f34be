"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, mixing, best-fit packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. ``run`` writes each stage's result to
the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscreen.llm import lines, mixing, neardup, packing, toxicity
from sparkscreen.llm.common import discard, table, unused, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 stay, by a model fitted on the labelled documents of ``sf_dir``."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier; documents of which nothing is left go."""
    before, lost = unused("lines_before", docs), unused("lines_gone", docs)
    found = lines.dedup_lines(docs, added=(before, lost))
    emptied = (F.col(lost) > 0) & (F.trim(F.coalesce("text", F.lit(""))) == "")
    return found.filter(~emptied).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the last copy of some is cut after the words taken."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: its place in a sequence of at most 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models, hashed links and packing are beyond SQL: a test holds run() to a plain version of the five stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        discard(*last)
        last = (docs,)
    return docs
