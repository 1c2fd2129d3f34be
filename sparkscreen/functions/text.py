"""Text views of a request, and scalar helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def sql_text(value: str) -> str:
    """A string as SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let_sql(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``value``, computed once, under ``name``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def apply_sql(value: Column, name: str, body: str) -> Column:
    """``body``, SQL text over ``name`` alone, of a column. It reaches the JVM in one call, however large it is."""
    return F.element_at(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), 1)


def as_text(message: Column) -> Column:
    """A message's text, or its text parts joined by line feeds; images are left out."""
    parts = F.transform(F.filter(message["parts"], lambda p: p["type"] == "text"), lambda p: p["text"])
    return F.coalesce(message["text"], F.array_join(parts, "\n"), F.lit(""))


def _joined(messages: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(messages, as_text), "\n"), F.lit(""))


def all_text(messages: Column) -> Column:
    return _joined(messages)


def role_text(messages: Column, roles: Sequence[str]) -> Column:
    return _joined(F.filter(messages, lambda m: m["role"].isin(list(roles))))


def user_text(messages: Column) -> Column:
    return role_text(messages, ["user"])


def word_count(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def approx_tokens(text: Column) -> Column:
    return F.floor(word_count(text) * F.lit(1.3))


def trim_start(text: Column) -> Column:
    return F.regexp_replace(text, r"^(?U)\s+", "")


def softmax2(negative: Column, positive: Column) -> Column:
    """Probability of the positive class from two logits, in a form that cannot overflow to NaN."""
    return 1 / (1 + F.exp(negative - positive))


def score_label(score: Column) -> Column:
    return F.when(score >= 0.5, "positive").otherwise("safe")


def is_above_threshold(score: Column, threshold: float) -> Column:
    return score >= F.lit(threshold)


def provider_for_path(path: Column) -> Column:
    return F.when(path.startswith("/v1/messages"), "anthropic").otherwise("openai")


def provider_label(provider: Column) -> Column:
    return F.when(provider.isin("openai", "anthropic", "azure"), provider).otherwise("other")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1e6).cast("long"))


def iso_millis(ts: Column) -> Column:
    """UTC with three fractional digits; needs the session time zone UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def luhn_valid(candidate: Column) -> Column:
    digits = F.regexp_replace(candidate, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


# Field names and types of the answers below.
def block_body(reason: Column, code: Column, request_id: Column) -> Column:
    error = F.struct(reason.alias("message"), F.lit("guardrail_block").alias("type"), code.alias("code"), request_id.alias("guardrail_request_id"))
    return F.to_json(F.struct(error.alias("error")))


def reject_body(message: Column, code: Column) -> Column:
    return F.to_json(F.struct(F.struct(message.alias("message"), F.lit("guardrail_error").alias("type"), code.alias("code")).alias("error")))
