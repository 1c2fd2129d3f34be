"""Ordered redaction of personal data and secrets, with records of what was replaced."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column

from ..model import RECORD
from .text import apply_sql, let_sql, sql_text

# Entity names, their patterns and default replacements.
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    "phone": r"(?:\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}",
    "credit_card": r"\b(?:\d[ \-]?){13,19}\b",
    "ssn": r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b",
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b|\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b",
    "api_key": r"(?:sk-[a-zA-Z0-9\-_]{20,}|sk-ant-[a-zA-Z0-9\-_]{20,}|ghp_[a-zA-Z0-9]{30,40}|gho_[a-zA-Z0-9]{30,40}|ghs_[a-zA-Z0-9]{30,40}|Bearer\s+[a-zA-Z0-9\-._~+/]{20,})",
    "aws_key": r"\bAKIA[A-Z0-9]{16}\b",
}
REPLACEMENTS = {"email": "[EMAIL]", "phone": "[PHONE]", "credit_card": "[CARD]", "ssn": "[SSN]", "ip_address": "[IP_ADDRESS]", "api_key": "[API_KEY]", "aws_key": "[AWS_KEY]"}
LIBRARY_ORDER = ("email", "credit_card", "phone", "ssn", "ip_address", "api_key", "aws_key")
CONFIG_ORDER = ("email", "phone", "credit_card", "ssn", "ip_address", "api_key", "aws_key")

#: What is executed where the pattern as it stands would be tried anew at every sign of a long run: a match begins where
#: its run begins, or where the match before it ended. The matches are the same.
_LOCAL = r"[a-zA-Z0-9._%+\-]"
_EXECUTED = {**PATTERNS, "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++" + PATTERNS["email"].removeprefix(_LOCAL + "+")}
_DIGITS = r"(?U)\d"


def _may_hold(entity: str, text: str) -> str:
    """A cheap test that every text with a match passes, so that most texts meet no costly pattern. SQL text."""
    has = lambda *words: " or ".join(f"contains({text}, {sql_text(w)})" for w in words)
    digit = f"{text} rlike {sql_text(_DIGITS)}"
    if entity == "email":
        return has("@")
    if entity == "ip_address":
        return f"(({has('.')}) and {digit}) or {has(':')}"
    if entity == "api_key":
        return has("sk-", "ghp_", "gho_", "ghs_", "Bearer")
    if entity == "aws_key":
        return has("AKIA")
    return digit


def _may_hold_any(entities: Sequence[str], text: str) -> str:
    """A test that every text passes which one of the entities may change, in one pass for all their signs. SQL text.

    A text that fails it is met by every entity as it is, since none before has changed it.
    """
    some, own = set(entities), {"email", "api_key", "aws_key"}
    signs = ("@" if "email" in some else "") + (r"\d" if some - own else "") + (":" if "ip_address" in some else "")
    tests = [f"{text} rlike {sql_text(f'(?U)[{signs}]')}"] if signs else []
    return " or ".join(tests + [_may_hold(e, text) for e in ("api_key", "aws_key") if e in some]) or "false"


def _luhn_sql(candidate: str) -> str:
    return let_sql(f"regexp_replace({candidate}, '[^0-9]', '')", "d", "length(d) between 13 and 19 and luhn_check(d)")


#: What an entity's pass found: matches, gaps around them (one more), and which matches were replaced (null: all).
_PASS = "struct<entity_type: string, m: array<string>, g: array<string>, k: array<boolean>>"
_START = f"named_struct('text', coalesce(t, ''), 'passes', cast(array() as array<{_PASS}>))"


def _step(entity: str, token: str, checked: bool) -> str:
    """SQL text: struct z (text, passes) after one entity."""
    pattern, put = sql_text("(?U)" + _EXECUTED[entity]), sql_text(token)
    after = lambda text, k: f"named_struct('text', {text}, 'passes', concat(z.passes, array(named_struct('entity_type', {sql_text(entity)}, 'm', m, 'g', g, 'k', {k}))))"
    if checked:
        text = f"array_join(flatten(zip_with(g, concat(zip_with(m, k, (x, y) -> if(y, {put}, x)), array('')), (x, y) -> array(x, y))), '')"
        changed = let_sql(f"transform(m, x -> {_luhn_sql('x')})", "k", after(text, "k"))
    else:
        changed = after(f"array_join(g, {put})", "cast(null as array<boolean>)")
    held = let_sql(f"split(z.text, {pattern}, -1)", "g", changed)
    found = let_sql(f"regexp_extract_all(z.text, {pattern}, 0)", "m", f"if(size(m) = 0, z, {held})")
    return f"if({_may_hold(entity, 'z.text')}, {found}, z)"


def _sums_before(lengths: str) -> str:
    """SQL text: for each place of an array of ints, the sum of what stands before it, and one more.

    In pieces as long as they are many, as arrays grow by copying.
    """
    width = "cast(ceil(sqrt(size(n))) as int)"
    running = f"transform(sequence(1, size(n), {width}), s -> aggregate(slice(n, s, {width}), array(0), (acc, x) -> array_append(acc, element_at(acc, -1) + x)))"
    moved = "concat(acc.out, transform(slice(r, 1, size(r) - 1), x -> x + acc.t))"
    joined = f"aggregate({running}, named_struct('t', 0, 'out', cast(array() as array<int>)), (acc, r) -> named_struct('t', acc.t + element_at(r, -1), 'out', {moved}), acc -> acc.out)"
    return let_sql(lengths, "n", joined)


def _records_sql() -> str:
    """SQL text: the records of a pass p. A match begins behind what stands before its gap, and the gap."""
    before = _sums_before("zip_with(p.g, p.m, (x, y) -> octet_length(x) + coalesce(octet_length(y), 0))")
    starts = f"zip_with({before}, p.g, (x, y) -> x + octet_length(y))"
    record = "named_struct('entity_type', p.entity_type, 'offset', x.b, 'length', octet_length(x.m))"
    seen = f"zip_with(zip_with(p.m, {starts}, (x, y) -> named_struct('m', x, 'b', y)), coalesce(p.k, transform(p.m, x -> true)), (x, y) -> named_struct('m', x.m, 'b', x.b, 'k', y))"
    return f"transform(filter({seen}, x -> x.k), x -> {record})"


@functools.lru_cache(64)
def _redact_sql(entities: tuple[str, ...], validate_luhn: bool, tokens: tuple[tuple[str, str], ...]) -> str:
    by, out = dict(tokens), _START
    for entity in entities:
        out = let_sql(out, "z", _step(entity, by[entity], entity == "credit_card" and validate_luhn))
    records = f"if(size(z.passes) = 0, cast(array() as array<{RECORD}>), cast(flatten(transform(z.passes, p -> {_records_sql()})) as array<{RECORD}>))"
    found = let_sql(out, "z", f"named_struct('text', z.text, 'records', {records})")
    return f"if({_may_hold_any(entities, 't')}, {found}, named_struct('text', coalesce(t, ''), 'records', cast(array() as array<{RECORD}>)))"


@functools.lru_cache(64)
def _redact_text_sql(entities: tuple[str, ...], validate_luhn: bool, tokens: tuple[tuple[str, str], ...]) -> str:
    by, out = dict(tokens), "t"
    for entity in entities:
        if entity == "credit_card" and validate_luhn:
            card = let_sql(_START.replace("coalesce(t, '')", "y"), "z", _step(entity, by[entity], True))
            out = let_sql(out, "y", f"if(y is null, y, ({card}).text)")
        else:
            literal = by[entity].replace("\\", "\\\\").replace("$", "\\$")
            out = let_sql(out, "y", f"if({_may_hold(entity, 'y')}, regexp_replace(y, {sql_text('(?U)' + _EXECUTED[entity])}, {sql_text(literal)}), y)")
    return f"if({_may_hold_any(entities, 't')}, {out}, t)"


def redact(text: Column, entities: Sequence[str] = LIBRARY_ORDER, validate_luhn: bool = True, replacements: Mapping[str, str] | None = None) -> Column:
    """struct(text, records). Entities are applied one after another, each to the text so far.

    A record's byte offset and length refer to the text that its entity was applied to. A null text
    gives an empty text without records.
    """
    tokens = {**REPLACEMENTS, **(replacements or {})}
    return apply_sql(text, "t", _redact_sql(tuple(entities), validate_luhn, tuple(sorted(tokens.items()))))


def redact_text(text: Column, entities: Sequence[str] = LIBRARY_ORDER, validate_luhn: bool = True, replacements: Mapping[str, str] | None = None) -> Column:
    """The redacted text alone. Plain replacement, but for cards that need the Luhn test."""
    tokens = {**REPLACEMENTS, **(replacements or {})}
    return apply_sql(text, "t", _redact_text_sql(tuple(entities), validate_luhn, tuple(sorted(tokens.items()))))
