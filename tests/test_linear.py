"""Scans and redaction of texts of any kind: what is executed equals the listed form, and takes time in proportion."""

import random
import re
import time

from pyspark.sql import functions as F

from sparkscreen import rules as R
from sparkscreen.functions import redact as P

_WORDS = re.compile(r"[A-Za-z]+|[<>#\[\]/|:-]+")


def pieces(draw):
    """Parts of the bundled patterns, in cases that fold to them or nearly, white space of all kinds."""
    own = {w for r in R.BUNDLED for w in _WORDS.findall(r.pattern) if w not in ("i", "s")}
    spaces = [" ", "  ", "\t", "\n", "\u00a0", "\u2003", "\x0b", "\u200b", ""]
    word = draw.choice(sorted(own))
    folded = draw.choice((word, word.upper(), word.title(), word.replace("s", "ſ"), word.replace("k", "K"), word.replace("i", "ı"), word.replace("I", "İ"), word[:-1]))
    return folded + draw.choice(spaces)


def phrase(draw, pattern):
    """A text made along a pattern, so that many match it."""
    text = pattern.removeprefix("(?i)").replace("(?:", "(")
    while re.search(r"\([^()]*\)", text):
        text = re.sub(r"\(([^()]*)\)(\?)?", lambda m: draw.choice(re.split(r"(?<!\\)\|", m[1]) if not m[2] or draw.random() < 0.5 else [""]), text, count=1)
    text = re.sub(r"(\w)\?", lambda m: draw.choice((m[1], "")), text)
    spaces = lambda least: "".join(draw.choice((" ", "\n", "\t", "\u2003")) for _ in range(draw.randint(least, 3)))
    text = re.sub(r"\\s\+", lambda m: spaces(1), re.sub(r"\\s\*", lambda m: spaces(0), text))
    text = re.sub(r"[/|:]\?", lambda m: draw.choice((m[0][0], "")), text.replace("[\\s-]", draw.choice(" -")).replace("\\", ""))
    return "".join(draw.choice((c, c.upper(), c.lower())) for c in text)


def test_executed_rules_match_as_the_listed_ones(spark):
    draw = random.Random(11)
    texts = ["".join(pieces(draw) for _ in range(draw.randint(1, 9))) for _ in range(600)] + [draw.choice(("", "x ", "< ")) + phrase(draw, draw.choice(R.BUNDLED).pattern) + draw.choice(("", "s", " y")) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = F.translate("text", "ıİ", "ʔʔ")  # letters that only Java folds to i
    listed = F.array_compact(F.array(*[F.when(plain.rlike("(?U)" + r.pattern), F.lit(i)) for i, r in enumerate(R.BUNDLED)]))
    rows = df.select("text", R.all_matches(R.BUNDLED, F.col("text")).alias("got"), R.first_match(R.BUNDLED, F.col("text")).alias("first"), listed.alias("want")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]
    assert all(r["first"] == (r["want"][0] if r["want"] else None) for r in rows)
    assert len({i for r in rows for i in r["want"]}) >= 24 and all(R.executed(r) for r in R.BUNDLED)


def test_own_rules_are_executed_as_they_are():
    for r in (R.Rule("(?i)abc"), R.Rule(r"(?i)[A-Z]\S+", ("a",)), R.Rule("abc", ("abc",)), R.Rule("(?i)maß", ("ma",))):
        assert R.executed(r) is None


def took(df, column):
    start = time.perf_counter()
    df.select(column).collect()
    return time.perf_counter() - start


def test_scan_is_linear_in_marks_and_spaces(spark):
    make = lambda n: spark.range(1).select(F.concat(*[F.expr(f"repeat('{x}', {n})") for x in ("<", "< ", " ", "ignore  ", "[", "---", "#", "you are ")]).alias("t"), F.concat(F.lit("<"), F.expr(f"repeat(' ', {n})"), F.lit("<"), F.expr(f"repeat(' ', {n})")).alias("u"))
    for c in "tu":
        took(make(1000), R.all_matches(R.BUNDLED, F.col(c)))
        assert took(make(500_000), R.all_matches(R.BUNDLED, F.col(c))) < 15


def test_records_of_a_hundred_thousand_emails(spark):
    """Every offset right, and ten times as many take less than thirty times as long."""
    make = lambda n: spark.range(1).select(F.expr(f"array_join(transform(sequence(1, {n}), i -> concat('é', i, '@b.org')), ' ')").alias("t"))
    z = P.redact(F.col("t"), ["email"])
    took(make(1000), z)
    few, many = took(make(10_000), F.size(z["records"])), took(make(100_000), F.size(z["records"]))
    assert many < 30 * (few + 0.2)
    r = make(5000).select("t", z.alias("z")).first()
    want, raw = [], r["t"].encode()
    for m in re.finditer(rb"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", raw):
        want.append((m.start(), m.end() - m.start()))
    assert [(x["offset"], x["length"]) for x in r["z"]["records"]] == want and r["z"]["text"].count("[EMAIL]") == 5000


def test_plans_of_rules_and_redaction_are_built_in_a_moment(spark):
    df = spark.createDataFrame([("x",)], "t string")
    P.redact(F.col("t")), R.first_match(R.BUNDLED, F.col("t"))
    start = time.perf_counter()
    df.select(P.redact(F.col("t")).alias("z"), R.first_match(R.BUNDLED, F.col("t")).alias("i"))
    assert time.perf_counter() - start < 3
