"""Choosing thresholds, and holding decisions against what was expected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float], score_col: str = "score", label_col: str = "label") -> DataFrame:
    """True and false positives and negatives, precision and recall of each threshold, in one pass over the rows."""
    positive = F.col(label_col) == 1
    counts = []
    for i, t in enumerate(thresholds):
        over = F.col(score_col) >= F.lit(float(t))
        for name, cond in (("tp", over & positive), ("fp", over & ~positive), ("fn", ~over & positive), ("tn", ~over & ~positive)):
            counts.append(F.count_if(cond).alias(f"{name}{i}"))
    wide = scored.filter(F.col(score_col).isNotNull() & F.col(label_col).isNotNull()).agg(*counts)
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "fn", "tn")]) for i, t in enumerate(thresholds)])
    out = wide.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumns({"precision": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), "recall": F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))})


def evaluate_expected(decided: DataFrame, expected: DataFrame, key: str = "name") -> DataFrame:
    """How often each expected decision met each actual one."""
    joined = expected.select(key, "expected_decision").join(decided.select(key, "decision"), key)
    return joined.groupBy("expected_decision", "decision").agg(F.count("*").alias("cases"))


def evaluate_cases(decided: DataFrame, text_col: str | None = None) -> DataFrame:
    """Cases that stand beside their expectations, judged: what of decision, code, entities and redacted text is as expected.

    ``decided`` has the columns of a pipeline's result and of ``read_fixtures``. An expectation that a case does not state
    (null) is met by anything; entities are compared as sets. ``text_col`` is the text to hold against expected_redacted_text.
    """
    stated = lambda expected, met: F.coalesce(F.col(expected).isNull() | met, F.lit(False))
    sets = F.array_sort(F.array_distinct("entities")) == F.array_sort(F.array_distinct("expected_entities"))
    text = F.lit(True) if text_col is None else F.col(text_col).eqNullSafe(F.col("expected_redacted_text"))
    parts = {"decision_met": stated("expected_decision", F.col("decision") == F.col("expected_decision")), "code_met": stated("expected_code", F.col("code").eqNullSafe(F.col("expected_code"))), "entities_met": stated("expected_entities", sets), "text_met": stated("expected_redacted_text", text)}
    out = decided.withColumns(parts)
    return out.withColumn("met", F.col("decision_met") & F.col("code_met") & F.col("entities_met") & F.col("text_met"))


def rule_hits(matched: DataFrame, rules: Sequence, indices_col: str = "matched") -> DataFrame:
    """Requests that each rule matched."""
    names = F.array(*[F.lit(r.pattern) for r in rules])
    hits = matched.select(F.explode(indices_col).alias("rule_index")).groupBy("rule_index").agg(F.count("*").alias("requests"))
    return hits.withColumn("rule", F.element_at(names, F.col("rule_index") + 1))


def policy_hits(decided: DataFrame, stage: str = "policy") -> DataFrame:
    """Requests by the policy rule that matched first and its action, allow and log rules too."""
    noted = decided.select(F.try_element_at("stage_details", F.lit(stage)).alias("d")).filter("d is not null")
    return noted.groupBy(F.regexp_extract("d", "^(.*):([^:]*)$", 1).alias("rule"), F.regexp_extract("d", "^(.*):([^:]*)$", 2).alias("action")).agg(F.count("*").alias("requests"))
