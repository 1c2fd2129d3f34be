"""Large keyword lists: which keywords of a table stand in which texts, as substrings, in lower case.

An OR over literals grows with the list, in the plan and in time. Here the list is a table, indexed
by n-grams: each keyword is filed under n-grams that few keywords share. A text is cut into pieces; its
n-grams are looked up by their hashes, and a keyword found there is compared at the one place where it
would have to stand. A keyword of 7 letters or more is filed under two n-grams of 6 letters that follow
one another, so that of a text's only every second needs to be looked up: one of the two is among
them. A shorter one is filed under one of 4 letters at most, and all are looked up. The plan does not depend on the list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

GRAM, LONG_GRAM, STEP, PIECE = 4, 6, 2, 256
#: An index part of up to so many bytes is broadcast; a larger index is broadcast part by part.
PART_BYTES, ROW_BYTES = 48 << 20, 96


@dataclass(frozen=True)
class KeywordIndex:
    """``rows``: gram (hash), keyword, at (place of the gram in it, from 0), part. ``cuts``: lengths of grams in use, and how far apart
    they are looked up. ``longest``: letters of the longest keyword."""

    rows: DataFrame
    cuts: tuple[tuple[int, int], ...]
    parts: int
    longest: int


def _grams(text: Column, size: Column, count: Column) -> Column:
    """Substrings of ``size`` letters at the places 0 to ``count`` - 1. For keywords: each is found by counting letters from the start."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i + 1, size))


def _grams_of(text: Column, size: int, step: int) -> Column:
    """The substrings of ``size`` letters at every ``step``-th place, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{size}}})).{{{step}}}"), F.lit(1))


def keyword_index(keywords: DataFrame, keyword_col: str = "keyword", gram: int = GRAM, part_bytes: int = PART_BYTES) -> KeywordIndex:
    """Files each different keyword. Null keywords are no keywords; the empty one stands in every text, as a substring does."""
    words = keywords.select(F.lower(keyword_col).alias("keyword")).filter("keyword is not null").distinct()
    long = F.length("keyword") >= LONG_GRAM + STEP - 1
    size = F.when(long, LONG_GRAM).otherwise(F.least(F.length("keyword"), F.lit(gram)))
    own = words.withColumn("size", size).select("keyword", "size", F.posexplode(F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(_grams(F.col("keyword"), F.col("size"), F.length("keyword") - F.col("size") + 1))).alias("at", "text"))
    shared = own.groupBy("text").agg(F.count_distinct("keyword").alias("shared"))
    placed = own.join(shared, "text").groupBy("keyword", "size").agg(F.sort_array(F.collect_list(F.struct("at", "text", "shared"))).alias("grams"))
    step = F.when(long, STEP).otherwise(1)
    most = lambda i: F.array_max(F.transform(F.slice("grams", i, F.col("step")), lambda g: g["shared"]))
    best = F.array_min(F.transform(F.sequence(F.lit(1), F.size("grams") - F.col("step") + 1), lambda i: F.struct(most(i).alias("shared"), i.alias("i"))))["i"]
    filed = placed.withColumn("step", step).select("keyword", "size", "step", F.explode(F.slice("grams", best, F.col("step"))).alias("g"))
    count, letters, cuts, longest = filed.agg(F.count("*"), F.sum(F.octet_length("keyword")), F.sort_array(F.collect_set(F.struct("size", "step"))), F.max(F.length("keyword"))).first()
    parts = max(1, -(-((letters or 0) + ROW_BYTES * count) // part_bytes))
    rows = filed.select(F.xxhash64("g.text").alias("gram"), "keyword", F.col("g.at").alias("at"), F.pmod(F.xxhash64("keyword"), F.lit(parts)).alias("part"))
    return KeywordIndex(rows, tuple((c["size"], c["step"]) for c in cuts or ()), parts, longest or 0)


def _pieces(texts: DataFrame, ids: list[str], piece: int) -> DataFrame:
    """Pieces of each text, with what stands around them: (ids, own letters, around, skip). An empty text is one empty piece."""
    cut = F.regexp_extract_all("_text", F.lit(rf"(?s)\A\z|.{{1,{piece}}}"), F.lit(0))
    none = F.lit("")
    place = lambda c, x, i: F.struct(x.alias("own"), F.coalesce(F.try_element_at(c, F.when(i > 0, i)), none).alias("before"), F.coalesce(F.try_element_at(c, i + 2), none).alias("behind"))
    around = let(cut, lambda c: F.transform(c, lambda x, i: place(c, x, i)))
    return texts.select(*ids, "_text", F.explode(around).alias("_p")).select(*ids, "_text", F.length("_p.own").alias("_own"), F.concat("_p.own", "_p.behind").alias("_on"), F.concat("_p.before", "_p.own", "_p.behind").alias("_around"), F.length("_p.before").alias("_skip"))


def keyword_hits(texts: DataFrame, index: KeywordIndex, ids: list[str], text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """ids, keyword: each keyword once for each text that holds it. A null text holds none.

    Keywords of up to ``piece`` letters are compared within the pieces around a hit, so time grows with a text's length
    and no more; longer ones are looked for in the whole text, which goes along only if the list has such. The only
    shuffle is that of the hits.
    """
    rows = texts.filter(F.col(text_col).isNotNull()).select(*ids, F.lower(text_col).alias("_text"))
    whole = ["_text"] if index.longest > piece else []
    pieces = _pieces(rows, ids, piece)
    # grams that begin in the piece; those at its end reach into the next
    of_cut = [F.struct(_grams_of(F.substring("_on", F.lit(1), F.col("_own") + (size - 1)), size, step).alias("g"), F.lit(step).alias("step")) if size else F.struct(F.array(F.lit("")).alias("g"), F.lit(1).alias("step")) for size, step in index.cuts]
    cut = pieces.select(*ids, *whole, "_around", "_skip", F.explode(F.array(*of_cut) if of_cut else F.array().cast("array<struct<g: array<string>, step: int>>")).alias("_c"))
    grams = cut.select(*ids, *whole, "_around", "_skip", F.col("_c.step").alias("_step"), F.posexplode("_c.g").alias("_at", "_gram")).withColumns({"_gram": F.xxhash64("_gram"), "_at": F.col("_at") * F.col("_step")})
    start = F.col("_skip") + F.col("_at") - F.col("at")
    held = F.substring("_around", start + 1, F.length("keyword")) == F.col("keyword")
    real = (start >= 0) & held
    if whole:
        real = F.when(F.length("keyword") <= piece, real).otherwise(F.col("_text").contains(F.col("keyword")))
    out = None
    for part in range(index.parts):
        own = F.broadcast(index.rows.filter(F.col("part") == part).drop("part"))
        hits = grams.join(own, F.col("_gram") == F.col("gram")).filter(real).select(*ids, "keyword")
        out = hits if out is None else out.unionByName(hits)
    return out.distinct()


def with_keywords(rows: DataFrame, index: KeywordIndex, ids: list[str], text_col: str = "text", out_col: str = "keywords") -> DataFrame:
    """``rows`` with the keywords found in each text, in order, as an array that may be empty. ``ids`` tell rows apart; they may be null."""
    hits = keyword_hits(rows, index, ids, text_col).groupBy(*ids).agg(F.sort_array(F.collect_set("keyword")).alias("_found"))
    found = hits.select(*[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)], "_found")
    same = None
    for i, c in enumerate(ids):
        cond = F.col(c).eqNullSafe(F.col(f"_id{i}"))
        same = cond if same is None else same & cond
    joined = rows.join(found, same, "left")
    return joined.select(*rows.columns, F.coalesce("_found", F.array().cast("array<string>")).alias(out_col))
