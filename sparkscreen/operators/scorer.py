"""A text scorer that is fitted with Spark and applied as an expression: logistic regression over hashed words.

Fitting is gradient descent: in each step the weights, a bounded array, go to the rows as a literal, and these give back
sums for each feature; nothing but these sums reaches the driver. The model is a function of a Column, so it is
a native scorer for ``ScoreStage`` and runs inside generated plans, without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import scratch_path

FEATURES, STEPS, RATE, RIDGE = 1 << 12, 30, 1.0, 1e-4


def features(text: Column, size: int = FEATURES) -> Column:
    """Places from 0 of the different words of a text, in lower case; a null text has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int")))


def _margin(places: Column, weights: Column, bias: Column) -> Column:
    return bias + F.aggregate(places, F.lit(0.0), lambda acc, i: acc + F.element_at(weights, i + 1))


@dataclass(frozen=True)
class TextModel:
    """Weights of hashed words and a bias. Called with a text column, it gives the probability of the positive class."""

    weights: tuple[float, ...]
    bias: float

    def probability(self, places: Column) -> Column:
        literal = F.expr("array(" + ",".join(f"{w!r}D" for w in self.weights) + ")")
        return 1 / (1 + F.exp(-_margin(places, literal, F.lit(self.bias))))

    def __call__(self, text: Column) -> Column:
        return self.probability(features(text, len(self.weights)))


def fit(rows: DataFrame, text_col: str = "text", label_col: str = "label", size: int = FEATURES, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> TextModel:
    """A model of rows whose label is 0 or 1; rows without label or text do not count.

    Steps are scaled by the gradients so far (one scale for each feature), so rare and common words are learnt at their own
    pace. No rows, or rows of one class, give a model that scores their share for every text.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "features")
    label = F.col(label_col).cast("int")
    rows.filter(label.isin(0, 1) & F.col(text_col).isNotNull()).select(features(F.col(text_col), size).alias("places"), label.cast("double").alias("y")).write.parquet(path)
    given = spark.read.schema("places array<int>, y double").parquet(path)
    count, positive = given.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not count or positive in (0.0, float(count)):
        return TextModel((0.0,) * size, 30.0 if count and positive else -30.0)
    weights, bias, seen, seen_bias = [0.0] * size, 0.0, [1e-8] * size, 1e-8
    for _ in range(steps):
        p = TextModel(tuple(weights), bias).probability(F.col("places"))
        scored = given.select("places", ((p - F.col("y")) / F.lit(float(count))).alias("r"))
        each = scored.select(F.explode(F.concat(F.array(F.lit(-1)), F.col("places"))).alias("i"), "r")
        sums = each.groupBy("i").agg(F.sum("r").alias("g")).collect()
        gradients = {r["i"]: r["g"] for r in sums}
        bias_step = gradients.pop(-1)
        seen_bias += bias_step**2
        bias -= rate * bias_step / math.sqrt(seen_bias)
        for i, g in gradients.items():
            g += ridge * weights[i]
            seen[i] += g * g
            weights[i] -= rate * g / math.sqrt(seen[i])
    return TextModel(tuple(weights), bias)
