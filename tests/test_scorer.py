"""The fitted scorer: what it learns, on rows it has not seen, and what it gives where there is nothing to learn."""

import random

import pytest
from pyspark.sql import functions as F

from sparkscreen import catalog_rules
from sparkscreen.operators import scorer as SC
from sparkscreen.operators import stages as S
from sparkscreen.plans.pipeline import Pipeline
from sparkscreen.sources import requests as Q


def made(spark, n, seed):
    """One text in six is bad: it holds one of three words among thirty common ones, in any case."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{draw.randint(0, 30)}" for _ in range(draw.randint(3, 40))]
        bad = draw.random() < 1 / 6
        if bad:
            words.insert(draw.randint(0, len(words)), draw.choice(("Vile", "FOUL", "nasty")))
        rows.append((i, " ".join(words), int(bad)))
    return spark.createDataFrame(rows, "id long, text string, label int")


def test_it_finds_what_makes_texts_bad(spark):
    model = SC.fit(made(spark, 600, 1))
    judged = made(spark, 300, 2).select("label", model(F.col("text")).alias("p")).collect()
    right = sum((r["p"] >= 0.5) == bool(r["label"]) for r in judged)
    assert right >= 290 and all(0 <= r["p"] <= 1 for r in judged)
    ran = Pipeline([S.toxicity_model(model, 0.5)]).run(Q.requests_from_text(spark.createDataFrame([("w1 w2 vile w3",), ("w1 w2 w3",), (None,), ("  ",)], "text string")))
    assert [r["decision"] for r in ran.collect()] == ["block", "allow", "allow", "allow"]
    again = SC.fit(made(spark, 600, 1))
    assert max(abs(a - b) for a, b in zip(model.weights, again.weights)) < 1e-9  # up to the order of sums


def test_nothing_to_learn(spark):
    df = made(spark, 20, 3)
    score = lambda m: df.select(m(F.col("text")).alias("p")).first()["p"]
    assert score(SC.fit(df.filter("label = 0"))) < 1e-9 < 1 - 1e-9 < score(SC.fit(df.filter("label = 1")))
    assert score(SC.fit(df.limit(0))) < 1e-9
    odd = spark.createDataFrame([(None, 1), ("x", None), ("", 1), ("y", 0), ("z", 7)], "text string, label int")
    assert 0 <= score(SC.fit(odd, steps=2)) <= 1


def test_a_sweep_over_the_held_out_fold(spark, sf_dir):
    """Every scored document counts once at each threshold, and fewer are found the higher it is."""
    rows = sorted(catalog_rules.scorer_sweep(spark, sf_dir).collect())
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet").filter("trim(text) <> ''"), "doc_id")
    held_out = labels.filter("doc_id % 5 = 0").count()
    assert all(r["tp"] + r["fp"] + r["fn"] + r["tn"] == held_out for r in rows)
    assert [r["tp"] + r["fp"] for r in rows] == sorted((r["tp"] + r["fp"] for r in rows), reverse=True)
