"""Screening stages.

A stage adds one finding column and may rewrite the messages. ``prepare`` may add helper columns (a
scorer needs its input as a column of its own); ``finding`` is an expression that the pipeline
evaluates only where no earlier stage has blocked.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import redact as P
from ..functions import text as T
from ..model import FINDING, MESSAGE, RECORD
from ..sources.shared import small_batches


def finding(action: str | Column, reason: Column | None = None, code: str | None = None, entities: Column | None = None, score: Column | None = None, detail: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        (F.lit(action) if isinstance(action, str) else action).alias("action"),
        (null if reason is None else reason).cast("string").alias("reason"),
        F.lit(code).cast("string").alias("code"),
        (F.array() if entities is None else entities).cast("array<string>").alias("entities"),
        (null if score is None else score).cast("double").alias("score"),
        (null if detail is None else detail).cast("string").alias("detail"),
    ).cast(FINDING)


def allow() -> Column:
    return finding("allow")


class Stage:
    name = "stage"

    def _once(self, key: str, inputs: tuple[Column, ...], make: Callable[[], Column]) -> Column:
        """``make()``, kept for the next time that it is asked for with the very same inputs and settings."""
        kept, settings = self.__dict__.setdefault("_kept", {}), repr(self)
        known = kept.get(key)
        if known is None or known[1] != settings or len(known[0]) != len(inputs) or any(a is not b for a, b in zip(known[0], inputs)):
            known = kept[key] = (inputs, settings, make())
        return known[2]

    def prepare(self, df: DataFrame, messages: Column, active: Column) -> DataFrame:
        return df

    def finding(self, df: DataFrame, messages: Column) -> Column:
        raise NotImplementedError

    def rewritten(self, df: DataFrame, messages: Column) -> Column | None:
        """New messages where the stage redacts; None if it never does."""
        return None

    def scratch(self) -> list[str]:
        """Helper columns of ``prepare``, dropped at the end."""
        return []


@dataclass
class RegexInjection(Stage):
    """Lowest-index rule that matches all texts blocks; with ``log_only`` it is only noted."""

    rules: Sequence[R.Rule] = R.BUNDLED
    log_only: bool = False
    name: str = "regex_injection"

    def finding(self, df, messages):
        names = F.array(*[F.lit(r.pattern) for r in self.rules]) if self.rules else F.array().cast("array<string>")
        action = "allow" if self.log_only else "block"

        def judged(i: Column) -> Column:
            rule = F.element_at(names, i + 1)
            reason = None if self.log_only else F.concat(F.lit("Prompt injection detected (rule: "), rule, F.lit(")."))
            return F.when(i.isNull(), allow()).otherwise(finding(action, reason, None if self.log_only else "prompt_injection", detail=rule))

        return self._once("finding", (messages,), lambda: T.let(T.all_text(messages), lambda t: T.let(R.first_match(self.rules, t), judged)))


@contextmanager
def nulls_for_errors(spark: SparkSession) -> Iterator[None]:
    """Expressions that are added to a DataFrame within give null where they would raise under ANSI rules.

    Division by zero, casts, overflow and places that are not there are decided when an expression is added, so
    neither the rest of the plan nor later queries are changed.
    """
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


Scorer = Callable[[Iterator[pd.Series]], Iterator[pd.Series]] | Callable[[Column], Column]


@dataclass
class ScoreStage(Stage):
    """Any scorer of the user text, a threshold, a code.

    ``scorer`` is a function of a Column (native), or with ``batches=True`` a function of an iterator
    of pandas series, which may load its model once before the first batch. A scorer that
    raises or gives null or NaN lets the row through (``on_error="allow"``) or blocks it. A native one is added without
    ANSI rules, so what would raise gives null; only ``raise_error`` and Python UDFs of its own still fail the job.
    """

    scorer: Scorer
    threshold: float
    code: str
    label: str
    name: str = "classifier"
    skip_blank: bool = False
    batches: bool = False
    on_error: str = "allow"
    action: str = "block"
    roles: Sequence[str] = ("user",)

    def _column(self) -> str:
        return f"_score_{self.name}"

    def scratch(self):
        return [self._column(), self._column() + "_given"]

    def prepare(self, df, messages, active):
        text = T.role_text(messages, self.roles)
        wanted = active & (F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) != "") if self.skip_blank else active
        df = df.withColumn(self._column() + "_given", F.when(wanted, text))
        given = F.col(self._column() + "_given")  # a pandas UDF sees every row, so rows that need no score are null
        if not self.batches:
            with nulls_for_errors(df.sparkSession):
                return df.withColumn(self._column(), F.when(given.isNotNull(), self.scorer(given)).cast("double"))
        small_batches(df.sparkSession)
        scorer = self.scorer

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                out = pd.Series([None] * len(texts), dtype="float64", index=texts.index)
                some = texts[texts.notna()]
                if len(some):
                    try:
                        out[some.index] = next(iter(scorer(iter([some])))).to_numpy()
                    except Exception:  # one bad text must not take its batch along
                        for i, t in some.items():
                            try:
                                out[i] = next(iter(scorer(iter([pd.Series([t])])))).iloc[0]
                            except Exception:
                                out[i] = float("nan")
                yield out
                del texts, some, out
                gc.collect()  # batches hang in reference cycles, and few objects of much text seldom set off a collection

        return df.withColumn(self._column(), score(given))

    def finding(self, df, messages):
        score, limit = F.col(self._column()), F.lit(self.threshold)
        reason = F.format_string(self.label + " score %.3f >= threshold %.3f", score, limit)
        over = finding(self.action, reason, self.code, score=score) if self.action == "block" else finding("allow", score=score, detail=reason)
        broken = finding("block", F.lit(f"Stage '{self.name}' failed."), "policy_violation") if self.on_error == "block" else allow()
        failed = F.col(self._column() + "_given").isNotNull() & (score.isNull() | F.isnan(score))
        return F.when(failed, broken).when(score >= limit, over).otherwise(finding("allow", score=score))


def injection_model(scorer: Scorer, threshold: float = 0.85, **options) -> ScoreStage:
    return ScoreStage(scorer, threshold, "prompt_injection", "ONNX injection classifier", name="onnx_injection", **options)


def toxicity_model(scorer: Scorer, threshold: float = 0.9, **options) -> ScoreStage:
    return ScoreStage(scorer, threshold, "toxicity", "Toxicity", name="toxicity", skip_blank=True, **options)


@dataclass
class PiiRedactor(Stage):
    """Redacts each message on its own; a message with findings becomes plain text."""

    entities: Sequence[str] = P.LIBRARY_ORDER
    validate_luhn: bool = True
    replacements: Mapping[str, str] = field(default_factory=dict)
    action: str = "redact"
    name: str = "pii_redactor"

    def scratch(self):
        return ["_pii"]

    def redacted(self, text: Column) -> Column:
        return P.redact(text, self.entities, self.validate_luhn, self.replacements)

    def prepare(self, df, messages, active):
        def one(m: Column) -> Column:
            plain = F.struct(m["role"].alias("role"), m["text"].alias("text"), m["parts"].alias("parts")).cast(MESSAGE)
            changed = lambda z: F.when(F.size(z["records"]) == 0, plain).otherwise(F.struct(m["role"].alias("role"), z["text"].alias("text"), F.lit(None).alias("parts")).cast(MESSAGE))
            return T.let(self.redacted(T.as_text(m)), lambda z: F.struct(changed(z).alias("message"), z["records"].alias("records")))

        return df.withColumn("_pii", self._once("prepare", (messages, active), lambda: F.when(active, F.transform(messages, one))))

    def records(self) -> Column:
        return F.coalesce(F.flatten(F.transform("_pii", lambda x: x["records"])), F.array().cast(f"array<{RECORD}>"))

    def finding(self, df, messages):
        return self._once("finding", (), self._judged)

    def _judged(self) -> Column:
        found = F.array_distinct(F.transform(self.records(), lambda r: r["entity_type"]))

        def judged(e: Column) -> Column:
            names = F.array_join(e, ", ")
            if self.action == "block":
                hit = finding("block", F.concat(F.lit("PII detected: "), names), "policy_violation", e)
            elif self.action == "log_only":
                hit = finding("allow", detail=names)
            else:
                hit = finding("redact", F.concat(F.lit("PII detected and redacted: "), names), None, e)
            return F.when(F.size(e) == 0, allow()).otherwise(hit)

        return T.let(found, judged)

    def rewritten(self, df, messages):
        return self._once("rewritten", (), lambda: F.transform("_pii", lambda x: x["message"])) if self.action == "redact" else None


@dataclass(frozen=True)
class PolicyRule:
    name: str
    content_contains: tuple[str, ...] = ()
    system_prompt_absent: bool = False
    token_count_exceeds: int = 0
    always: bool = False
    action: str = "block"
    message: str | None = None
    enabled: bool = True

    def condition(self, messages: Column, text: Column, lowered: Column) -> Column:
        """always, then contains, then absent, then tokens; no condition at all counts as always."""
        if self.always:
            return F.lit(True)
        if self.content_contains:
            hit = F.lit(False)
            for k in self.content_contains:
                hit = hit | lowered.contains(k.lower())
            return hit
        if self.system_prompt_absent:
            return ~F.exists(messages, lambda m: m["role"] == "system")
        if self.token_count_exceeds > 0:
            return T.approx_tokens(text) > self.token_count_exceeds
        return F.lit(True)


@dataclass
class PolicyEngine(Stage):
    """First enabled rule that matches decides: block, or allow for every other action."""

    rules: Sequence[PolicyRule] = ()
    name: str = "policy"

    def finding(self, df, messages):
        active = [r for r in self.rules if r.enabled]
        if not active:
            return allow()

        def judged(text: Column, lowered: Column) -> Column:
            out = None
            for r in active:
                cond = r.condition(messages, text, lowered)
                reason = F.lit(r.message or f"Policy rule '{r.name}' matched.")
                note = F.lit(f"{r.name}:{r.action}")
                then = finding("block", reason, "policy_violation", detail=note) if r.action == "block" else finding("allow", detail=note)
                out = F.when(cond, then) if out is None else out.when(cond, then)
            return out.otherwise(allow())

        return self._once("finding", (messages,), lambda: T.let(T.all_text(messages), lambda t: T.let(F.lower(t), lambda low: judged(t, low))))


@dataclass
class PrefixGuard(Stage):
    """User text, trimmed at its start and in lower case, must not begin with a forbidden prefix."""

    prefixes: Sequence[str] = ()
    name: str = "prefix_guard"

    def finding(self, df, messages):
        def judged(t: Column) -> Column:
            hit = F.coalesce(*[F.when(t.startswith(p), F.lit(p)) for p in self.prefixes])
            return T.let(hit, lambda p: F.when(p.isNull(), allow()).otherwise(finding("block", F.concat(F.lit("Request begins with forbidden prefix '"), p, F.lit("'.")), "policy_violation")))

        return T.let(T.trim_start(F.lower(T.user_text(messages))), judged) if self.prefixes else allow()


@dataclass
class MaxLengthGuard(Stage):
    """All texts together must not exceed a number of UTF-8 bytes."""

    max_bytes: int = 32_768
    name: str = "max_length_guard"

    def finding(self, df, messages):
        reason = lambda n: F.concat(F.lit("Request content is "), n.cast("string"), F.lit(f" bytes, exceeds limit of {self.max_bytes}."))
        judged = lambda n: F.when(n > self.max_bytes, finding("block", reason(n), "policy_violation")).otherwise(allow())
        return self._once("finding", (messages,), lambda: T.let(F.octet_length(T.all_text(messages)), judged))


@dataclass
class Passthrough(Stage):
    name: str = "passthrough"

    def finding(self, df, messages):
        return allow()


@dataclass
class Blocking(Stage):
    reason: str = "blocked"
    code: str = "test"
    name: str = "blocking"

    def finding(self, df, messages):
        return finding("block", F.lit(self.reason), self.code)


@dataclass
class Failing(Stage):
    """Stands for a stage that fails on every row."""

    on_error: str = "allow"
    name: str = "error"

    def finding(self, df, messages):
        return finding("block", F.lit(f"Stage '{self.name}' failed."), "policy_violation") if self.on_error == "block" else finding("allow", detail=F.lit("error"))


@dataclass
class Redacting(Stage):
    """Replaces every message's text."""

    reason: str = "redacted"
    entities: Sequence[str] = ("email",)
    replacement: str = "[REDACTED]"
    name: str = "redacting"

    def finding(self, df, messages):
        return finding("redact", F.lit(self.reason), None, F.array(*[F.lit(e) for e in self.entities]))

    def rewritten(self, df, messages):
        return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), F.lit(self.replacement).alias("text"), F.lit(None).alias("parts")).cast(MESSAGE))
