"""Injection rules: the bundled list and rule files.

Rules are Java regular expressions. ``(?U)`` is put before each, for Unicode classes and case.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions.text import apply_sql, let_sql, sql_text


@dataclass(frozen=True)
class Rule:
    """A pattern, and lower-case literals of which every match holds one (none: not known)."""

    pattern: str
    needs: tuple[str, ...] = ()


# The bundled rules. The literals are ours.
BUNDLED = (
    Rule(r"(?i)ignore\s+(all\s+)?previous\s+instructions?", ("ignore",)),
    Rule(r"(?i)disregard\s+(all\s+)?previous\s+(instructions?|prompts?|constraints?)", ("disregard",)),
    Rule(r"(?i)forget\s+(all\s+)?(your\s+)?previous\s+instructions?", ("forget",)),
    Rule(r"(?i)override\s+(your\s+)?(previous\s+)?(instructions?|programming|directives?)", ("override",)),
    Rule(r"(?i)you\s+are\s+now\s+(a\s+)?(?:DAN|jailbroken|unrestricted|uncensored)", ("dan", "jailbroken", "unrestricted", "uncensored")),
    Rule(r"(?i)act\s+as\s+if\s+you\s+(have\s+no\s+restrictions?|were\s+trained\s+differently)", ("restriction", "differently")),
    Rule(r"(?i)pretend\s+(you\s+)?(have\s+no\s+)?ethical\s+(guidelines?|constraints?|limits?)", ("ethical",)),
    Rule(r"(?i)do\s+not\s+(follow|obey|apply)\s+(your\s+)?(safety|ethical|content)\s+(guidelines?|filters?|rules?)", ("guideline", "filter", "rule")),
    Rule(r"(?i)bypass\s+(all\s+)?(safety|ethical|content)\s+(checks?|filters?|restrictions?)", ("bypass",)),
    Rule(r"(?i)you\s+must\s+comply\s+with\s+(all\s+)?my\s+(instructions?|requests?)", ("comply",)),
    Rule(r"(?i)your\s+new\s+(primary\s+)?directive\s+is", ("directive",)),
    Rule(r"(?i)switch\s+to\s+(developer|jailbreak|DAN|unrestricted)\s+mode", ("switch",)),
    Rule(r"(?i)enable\s+(developer|jailbreak|unrestricted|god)\s+mode", ("enable",)),
    Rule(r"(?i)\[SYSTEM\]\s*:?\s*you\s+are\s+now", ("[system]",)),
    Rule(r"(?i)<<<\s*SYSTEM\s*>>>", ("<<<",)),
    Rule(r"(?i)reveal\s+(your\s+)?(full\s+)?(system\s+prompt|initial\s+instructions?|base\s+prompt)", ("reveal",)),
    Rule(r"(?i)print\s+(your\s+)?(system\s+prompt|original\s+instructions?)", ("print",)),
    Rule(r"(?i)output\s+(your\s+)?(system\s+prompt|initial\s+message|base\s+instructions?)", ("output",)),
    Rule(r"(?i)what\s+(are|were)\s+your\s+(original\s+|initial\s+)?instructions?", ("instruction",)),
    Rule(r"(?i)tell\s+me\s+(everything|all)\s+(about\s+)?your\s+(training|system\s+prompt|instructions?)", ("training", "prompt", "instruction")),
    Rule(r"(?i)---\s*end\s+of\s+(system\s+)?prompt\s*---", ("---",)),
    Rule(r"(?i)###\s*(human|assistant|system|user)\s*:", ("###",)),
    Rule(r"(?i)<\s*/?\s*(system|assistant|user|human)\s*>", ("<",)),
    Rule(r"(?i)\[\s*/?INST\s*\]", ("inst",)),
    Rule(r"(?i)<\s*\|?\s*(im_start|im_end)\s*\|?\s*>", ("im_",)),
    Rule(r"(?i)(explain|describe|provide|give)\s+(step[\s-]by[\s-]step\s+)?(instructions?|steps?)\s+(to|for|on\s+how\s+to)\s+(make|build|create|synthesize|produce)\s+(a\s+)?(bomb|weapon|poison|malware|exploit)", ("bomb", "weapon", "poison", "malware", "exploit")),
    Rule(r"(?i)how\s+to\s+(make|build|synthesize|produce)\s+(methamphetamine|fentanyl|sarin|VX\s+nerve\s+agent|ricin|anthrax)", ("methamphetamine", "fentanyl", "sarin", "nerve", "ricin", "anthrax")),
    Rule(r"(?i)write\s+(me\s+)?(working\s+)?(malware|ransomware|keylogger|exploit|shellcode|rootkit)", ("write",)),
)


def parse_rules(text: str) -> list[Rule]:
    """One pattern a line; blank lines and lines that begin with # do not count."""
    lines = (line.strip() for line in text.splitlines())
    return [Rule(line) for line in lines if line and not line.startswith("#")]


def read_rules(spark: SparkSession, path: str, extra: Iterable[str] = ()) -> list[Rule]:
    """A rule file, then extra rules. A rule file is small and its order counts, so it is read whole."""
    lines = [r[0] for r in spark.read.text(path, wholetext=True).collect()]
    return parse_rules("\n".join([*lines, *extra]))


def with_extra(rules: Sequence[Rule], extra: Iterable[str]) -> list[Rule]:
    return [*rules, *parse_rules("\n".join(extra))]


def invalid_rules(spark: SparkSession, rules: Sequence[Rule]) -> list[str]:
    """Messages for the rules that Java cannot compile."""
    pattern, out = spark.sparkContext._jvm.java.util.regex.Pattern, []
    for i, r in enumerate(rules):
        try:
            pattern.compile("(?U)" + r.pattern)
        except Exception as e:  # a Java exception, of whatever class the gateway gives
            out.append(f"rules[{i}] ({r.pattern!r}): {str(e).splitlines()[0]}")
    return out


#: Letters that Java folds to i, though simple case folding does not; a letter without case stands for them in a scan.
_TURKIC, _CASELESS = "ıİ", "ʔ"
#: A pattern of ASCII letters, white space, marks and groups only, that ignores case.
_SIMPLE = re.compile(r"\(\?i\)(?:[A-Za-z_ /<>#:?|()-]|\\s[+*]|\[\\s-\]|\\[\[\]|])*")


def executed(rule: Rule) -> str | None:
    """What is executed for a simple rule, on the folded text: the pattern in lower case, without giving back white space.

    Java folds every letter that it meets where case is ignored, and tries each split of a run of white space between
    neighbours; on text folded beforehand neither is needed. What follows a run never begins with white space, so the
    matches are the same (a test holds both forms against each other). None for rules that are not simple.
    """
    if not rule.needs or not _SIMPLE.fullmatch(rule.pattern):
        return None
    return "(?U)" + rule.pattern.removeprefix("(?i)").lower().replace(r"\s+", r"\s++").replace(r"\s*", r"\s*+")


def _test_sql(rule: Rule) -> str:
    """SQL text of a rule's test: o is the text, t without letters that only Java folds to i, f that in lower case."""
    simple = executed(rule)
    if simple:
        found = f"f rlike {sql_text(simple)}"
    else:  # a rule that names a dotless or dotted i itself meets the text as it is
        found = f"{'o' if any(c in rule.pattern for c in _TURKIC) else 't'} rlike {sql_text('(?U)' + rule.pattern)}"
    gates = " or ".join(f"contains(f, {sql_text(x)})" for x in rule.needs)
    return f"(({gates}) and {found})" if gates else found


#: Dotless and dotted i are no i for a scan that ignores case.
_SIMPLY_FOLDING = f"case when contains(o, '{_TURKIC[0]}') or contains(o, '{_TURKIC[1]}') then translate(o, '{_TURKIC}', '{2 * _CASELESS}') else o end"
#: Lower case; the long s and the Kelvin sign, which also match s and k, become these.
_FOLD = "lower(case when contains(t, 'ſ') or contains(t, '\u212a') then translate(t, 'ſ\u212a', 'sk') else t end)"


def _scanned(text: Column, body: str) -> Column:
    return apply_sql(text, "o", let_sql(_SIMPLY_FOLDING, "t", let_sql(_FOLD, "f", body)))


def first_match(rules: Sequence[Rule], text: Column) -> Column:
    """Least index of a rule that matches, or null. Patterns are plan literals, compiled once a task."""
    if not rules:
        return F.lit(None).cast("int")
    return _scanned(text, "case " + " ".join(f"when {_test_sql(r)} then {i}" for i, r in enumerate(rules)) + " end")


def all_matches(rules: Sequence[Rule], text: Column) -> Column:
    """Indices of all rules that match, in order."""
    if not rules:
        return F.array().cast("array<int>")
    return _scanned(text, "array_compact(array(" + ", ".join(f"case when {_test_sql(r)} then {i} end" for i, r in enumerate(rules)) + "))")
