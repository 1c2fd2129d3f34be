"""What the stages of the pipeline leave on the shared disk, and what they shuffle at the end."""

import os

import pytest

pytest.importorskip("sparkscreen.llm.queries")
from sparkscreen.llm import lines, mixing, neardup  # noqa: E402
from sparkscreen.llm.common import reach_workers, scratch_goes, written  # noqa: E402
from sparkscreen.sources.shared import shared_dir  # noqa: E402


def folders(spark):
    path = shared_dir(spark).removeprefix("file:")
    return set(os.listdir(path)) if os.path.isdir(path) else set()


@pytest.mark.parametrize("stage, rows", [(lines.dedup_lines, 40), (mixing.mixed_rows, 40), (neardup.keep_one, 20)])
def test_a_stage_leaves_one_slim_table(spark, stage, rows):
    reach_workers(spark)
    texts = [f"w{i} " + " ".join(f"word{i % 20}x{k}" for k in range(60)) + f"\nline {i % 20}" for i in range(40)]
    texts[20:] = texts[:20] if stage is neardup.keep_one else texts[20:]
    docs = spark.createDataFrame([(i, t, "web") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    before = folders(spark)
    out = stage(docs)
    left = folders(spark) - before
    assert len(left) == 1
    assert out.count() == rows  # what is left suffices
    for root, _, files in os.walk(os.path.join(shared_dir(spark).removeprefix("file:"), left.pop())):
        assert sum(os.path.getsize(os.path.join(root, f)) for f in files) < 50_000


def test_near_dedup_does_not_shuffle_texts_for_a_few_that_go(spark):
    reach_workers(spark)
    text = " ".join(f"word{k}" for k in range(60))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "another")], "doc_id long, text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = neardup.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_scratch_within_scratch(spark):
    before = folders(spark)
    with scratch_goes(spark) as keep:
        with scratch_goes(spark) as keep_inner:
            inner = keep_inner(written(spark.range(3), "inner"))
            written(spark.range(4), "other")
        assert len(folders(spark) - before) == 1
        outer = keep(written(inner.filter("id > 0"), "outer"))
    assert len(folders(spark) - before) == 1 and outer.count() == 2
