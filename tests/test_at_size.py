"""What must not gather in one task, nor grow faster than its input."""

import random

from pyspark.sql import functions as F

from sparkscreen import catalog_sources, catalog_streams
from sparkscreen.operators import keywords as K
from sparkscreen.operators import stages as S
from sparkscreen.plans.pipeline import Pipeline
from sparkscreen.sources import audit as A
from sparkscreen.sources import requests as Q


def test_a_micro_batch_is_no_single_task(spark, tmp_path):
    """Each condition is one micro-batch, in order, and its rows lie in the files of all tasks that made them."""
    seen = []

    def one(df, number):
        rows = df.select("id", F.input_file_name().alias("file")).collect()
        seen.append((number, sorted(r["id"] for r in rows), len({r["file"] for r in rows})))

    start = lambda stream: stream.writeStream.foreachBatch(one).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    catalog_streams.run_in_batches(spark.range(40, numPartitions=4), [F.col("id") % 2 == 1, F.col("id") < 0, F.col("id") % 2 == 0], "numbers", start)
    assert [(n, ids) for n, ids, _ in seen if ids] == [(0, list(range(1, 40, 2))), (seen[-1][0], list(range(0, 40, 2)))]
    assert all(files == 4 for _, ids, files in seen if ids)


def test_audit_records_are_decided_once_and_by_many_tasks(spark, sf_dir, monkeypatch):
    made = []
    run = catalog_sources.run_in_batches
    monkeypatch.setattr(catalog_sources, "run_in_batches", lambda df, *rest: (made.append(df), run(df, *rest)))
    rows = catalog_sources.audit_stream(spark, sf_dir).collect()
    assert sum(r["records"] for r in rows) == sum(r["requests"] for r in rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert len(made[0].filter("part = 0").inputFiles()) > 1 and "regex" not in made[0]._jdf.queryExecution().optimizedPlan().toString()


def test_grams_are_not_counted_out_and_long_keywords_take_every_second(spark):
    """No gram is found by counting letters from the start, short lists carry no whole text, and what is looked up at every second place misses nothing."""
    draw = random.Random(5)
    some = lambda n: "".join(draw.choice("abé😀 ") for _ in range(n))
    texts = [(i, some(draw.randint(0, 400))) for i in range(80)]
    words = [w for _, t in texts for n in (6, 7, 8, 9, 13) for at in (draw.randint(0, 300),) for w in (t[at : at + n],) if w] + [some(7) for _ in range(50)]
    index = K.keyword_index(spark.createDataFrame([(w,) for w in words], "keyword string"))
    for piece in (7, 13, 256):
        hits = K.keyword_hits(spark.createDataFrame(texts, "id long, text string"), index, ["id"], piece=piece)
        assert {tuple(r) for r in hits.collect()} == {(i, w) for i, t in texts for w in words if w in t}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert (K.LONG_GRAM, K.STEP) in index.cuts and "lambdafunction(substring(substring(_around" not in plan and "posexplode" in plan and "Contains(_text" not in plan


def test_a_scorer_keeps_no_earlier_batches(spark):
    """What a worker holds does not grow with the batches that it has scored; batches are bounded in bytes."""

    def scorer(batches):
        import resource  # peak so far, in KB

        for texts in batches:
            peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
            yield texts.str.len() * 0.0 + peak + len(texts) * 1e9

    docs = spark.range(0, 16_000, numPartitions=1).select("id", F.concat(F.col("id").cast("string"), F.repeat(F.lit("x"), 20_000)).alias("text"))
    ran = Pipeline([S.ScoreStage(scorer, 0.0, "custom", "Peak", batches=True)]).run(Q.requests_from_text(docs))
    found = ran.agg(F.max(F.floor(F.col("score") / 1e9)).alias("rows"), F.max(F.col("score") % 1e9).alias("last"), F.min(F.col("score") % 1e9).alias("first")).first()
    assert found["rows"] < 1000 and found["last"] - found["first"] < 120_000


def test_small_audit_files_share_tasks(spark, tmp_path, monkeypatch):
    """A task writes many small files, the same ones as with a task for each: null days, other scripts, line breaks and records over the bound too."""
    draw = random.Random(9)
    at = lambda i: None if i % 50 == 0 else f"2024-01-0{1 + i % 2}T00:00:{i % 60:02d}.{i:03d}Z"
    rows = [(at(i), f"r{i}", "allow", None if i % 7 == 0 else draw.choice(("x", 'ä"\\\n', "😀" * 20, "y" * 400))) for i in range(200)]
    df = spark.createDataFrame(rows, "timestamp string, request_id string, decision string, reason string").repartition(3)

    def written(name):
        A.write_audit_bounded(df, str(tmp_path / name), 400, range_records=60)
        parts = list((tmp_path / name).rglob("part-*"))
        return sorted((p.parent.name, p.read_bytes()) for p in parts), {p.name[:10] for p in parts}

    files, tasks = written("shared")
    assert len(files) > 60 and len(tasks) * 30 < len(files)
    assert all(len(data) <= 400 or data.count(b"\n") == 1 for _, data in files)
    monkeypatch.setattr(A, "ROW_FILE_BYTES", 0)
    assert written("alone")[0] == files
