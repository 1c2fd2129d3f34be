"""Line dedup by a deletion-neighbourhood join, on words.

Lines are compared as sequences of lower-cased words. A line goes if the same line, or one that
differs from it by at most one word (put in, left out or replaced), stands earlier; the earliest
stays. Earlier means a smaller document id, then a smaller position.

1. Equal lines are one: each different line is kept with its first place.
2. A filter finds the lines that can have a neighbour at all: one edit leaves the first or the last
   ``r`` words as they are, ``r`` a power of two between a quarter and half of the line.
3. Only those emit all their variants with one word deleted, as hashed keys. Key S (place and rest)
   joins lines that differ in one word there; key D joins a line with those that hold one word more.
   Of each key only its earliest line is needed, so no pairs within a key are formed. A sequence's
   hash is the xor of its words' hashes with their places, so that every variant follows from sums.
4. A line and the earlier one it met are compared word by word before it goes.

The edit bound is one word in ``near_words``: of shorter lines, where one word is a larger part of
what they say, only repeats word for word go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_goes, small, table, text_or_empty, written

NEAR_WORDS, FETCHED_ROW_BYTES = 10, 160
_SPACES = ("  ", "\t", "\r", "\f", "\x0b")


def _folded(text: Column) -> Column:
    """Lower case, white space but line feeds one space. Most texts have no other, and are only searched for it."""
    odd = F.lit(False)
    for s in _SPACES:
        odd = odd | text.contains(s)
    return F.lower(F.when(odd, F.regexp_replace(text, r"[^\S\n]+", " ")).otherwise(text))


def _half(n: Column) -> Column:
    """Power of two between n/4 and n/2."""
    return F.call_function("shiftleft", F.lit(1), F.floor(F.log2(n / 2) + 1e-9).cast("int"))


def _line_table(docs: DataFrame, near_words: int) -> DataFrame:
    """One row for each line that is not blank: place, hash, words, keys of the filter."""
    keyed = docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), "text").filter("text <> ''")
    lines = keyed.select("doc", "th", F.posexplode(F.split(_folded(F.col("text")), "\n"))).withColumn("w", F.trim("col")).filter("w <> ''").withColumn("n", F.octet_length("w") - F.octet_length(F.replace("w", F.lit(" "), F.lit(""))) + 1)
    n, near = F.col("n"), F.col("n") >= near_words
    at_ends = [F.when(near, _half(n)), F.when(near & (_half(n - 1) != _half(n)), _half(n - 1)).when(near & (_half(n + 1) != _half(n)), _half(n + 1))]
    keys = {}
    for i, r in enumerate(at_ends):
        keys[f"k{2 * i}"] = F.when(r.isNotNull(), F.xxhash64(F.lit("first"), r, F.call_function("substring_index", F.col("w"), F.lit(" "), r)))
        keys[f"k{2 * i + 1}"] = F.when(r.isNotNull(), F.xxhash64(F.lit("last"), r, F.call_function("substring_index", F.col("w"), F.lit(" "), -r)))
    return lines.select("doc", "th", "pos", F.xxhash64("w").alias("h"), "n", *[k.alias(c) for c, k in keys.items()])


def _place() -> Column:
    return F.struct(F.col("doc").isNull().alias("nodoc"), "doc", "th", "pos")


def _sums_before(e: Column) -> Column:
    """For each place of an array of longs, the xor of what stands before it: in pieces as long as they are many, as arrays grow by copying."""
    step = F.ceil(F.sqrt(F.size(e))).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.size(e), step), lambda s: F.slice(e, s, step))
    running = F.transform(pieces, lambda p: F.aggregate(p, F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1).bitwiseXOR(x))))
    state = lambda t, out: F.struct(t.alias("t"), out.alias("out"))
    moved = lambda acc, r: F.concat(acc["out"], F.transform(F.slice(r, 1, F.size(r) - 1), lambda x: x.bitwiseXOR(acc["t"])))
    return F.aggregate(running, state(F.lit(0).cast("long"), F.array().cast("array<bigint>")), lambda acc, r: state(acc["t"].bitwiseXOR(F.element_at(r, -1)), moved(acc, r)), lambda acc: acc["out"])


MEMBER, LONGER, OWNER = 0, 1, 2


def _variants(lines: DataFrame) -> DataFrame:
    """(o, words, varied) -> o, key, role: all variants with at most one word deleted.

    ``varied`` says that lines of other lengths can be near; else only replaced words are looked for.
    """
    xor = lambda found: F.aggregate(found, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))
    at = lines.select("o", "varied", F.size("words").alias("n"), F.transform("words", lambda w, i: F.xxhash64(w, i)).alias("a"), F.when(F.col("varied"), F.transform("words", lambda w, i: F.xxhash64(w, i - 1))).alias("b"))
    summed = at.select("o", "varied", "n", "a", "b", xor(F.col("a")).alias("ta"), xor(F.col("b")).alias("tb"), F.when(F.col("varied"), _sums_before(F.zip_with("a", "b", lambda x, y: x.bitwiseXOR(y)))).alias("e"))
    key = lambda kind, *rest: F.xxhash64(F.lit(kind), *rest)
    variant = lambda k, role: F.struct(k.alias("key"), F.lit(role).alias("role"))
    same = F.transform("a", lambda x, i: variant(key("S", F.col("n"), i, F.col("ta").bitwiseXOR(x)), MEMBER))
    # less word i: the words before it at their places, those behind it one place before theirs
    longer = F.zip_with("b", "e", lambda y, e: variant(key("D", F.col("n") - 1, F.col("tb").bitwiseXOR(e).bitwiseXOR(y)), LONGER))
    own = F.array(variant(key("D", F.col("n"), F.col("ta")), OWNER))
    return summed.select("o", F.explode(F.when(F.col("varied"), F.concat(same, longer, own)).otherwise(same)).alias("v")).select("o", "v.key", "v.role")


def _one_edit(a: str, b: str) -> Column:
    """Word sequences a and b differ by at most one word."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False).cast("int")
    rest = lambda c, skip: F.slice(c, F.greatest(differs, F.lit(1)) + skip, F.size(c))
    longer = lambda x, y: (F.size(x) == F.size(y) + 1) & (rest(x, 1) == rest(y, 0))
    return (differs == 0) | (rest(a, 1) == rest(b, 1)) | longer(a, b) | longer(b, a)


def _near_repeats(distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """h of the lines that have an earlier line within one word. ``distinct``: h, n, keys, and first, a place."""
    keys = distinct.filter("k0 is not null").select("h", "n", F.explode(F.array("k0", "k1", "k2", "k3")).alias("key")).filter("key is not null")
    shared = keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), (F.min("n") < F.max("n")).alias("varied")).filter("lo <> hi").select("key", "varied")
    able = keys.join(written(shared, "keys"), "key").groupBy("h").agg(F.max("varied").alias("varied"))
    places = written(distinct.join(able, "h").select("h", "first", "varied"), "able")
    wanted = places.groupBy(F.col("first.doc").alias("doc"), F.col("first.th").alias("th")).agg(F.collect_list(F.struct("h", "first", "varied")).alias("lines"))
    wanted = small(wanted, places.count(), FETCHED_ROW_BYTES)
    texts = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"), "text")
    fetched = texts.join(wanted, F.col("d").eqNullSafe(F.col("doc")) & (F.col("t") == F.col("th"))).select(F.split(_folded(F.col("text")), "\n").alias("all"), F.explode("lines").alias("l"))
    lines = fetched.select("l.h", "l.first", "l.varied", F.split(F.trim(F.element_at("all", F.col("l.first.pos") + 1)), " ").alias("words")).dropDuplicates(["h"])
    # numbered in the order of their first places, so that what is joined below is numbers only
    lines = written(lines.orderBy("first").select("h", "varied", "words", F.monotonically_increasing_id().alias("o")), "lines")
    met = written(_variants(lines), "variants")
    not_own = F.when(F.col("role") != OWNER, F.col("o"))
    heads = met.groupBy("key").agg(F.min("role").alias("kind"), F.min(not_own).alias("lo"), F.max(not_own).alias("hi"), F.min(F.when(F.col("role") == OWNER, F.col("o"))).alias("own"))
    # S keys have no owner: members are one word apart. D keys: the owner and each of the others are.
    heads = heads.filter(F.when(F.col("kind") == MEMBER, F.col("lo") < F.col("hi")).otherwise(F.col("own").isNotNull() & F.col("lo").isNotNull())).select("key", "lo", "own")
    partner = F.when(F.col("own").isNull() | (F.col("role") == OWNER), F.col("lo")).otherwise(F.col("own"))
    pairs = met.join(written(heads, "heads"), "key").select("o", partner.alias("o2")).filter("o2 < o").distinct()
    a, b = lines.select("o", "h", F.col("words").alias("wa")), lines.select(F.col("o").alias("o2"), F.col("words").alias("wb"))
    return pairs.join(a, "o").join(b, "o2").filter(_one_edit("wa", "wb")).select("h").distinct()


def repeated_lines(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc, th, gone: for each document that loses lines, their positions from 0.

    ``docs`` has doc_id and text. ``th`` is the hash of the text: rows with equal id and text are one document.
    """
    with scratch_goes(docs.sparkSession) as keep:
        return keep(written(_gone(docs, near_words), "gone"))


def _gone(docs: DataFrame, near_words: int) -> DataFrame:
    lines = written(_line_table(docs, near_words), "lines")
    # sums and minima of numbers only, so that they are made by hashing; the first place of a line that repeats follows below
    keys = [F.min(k).alias(k) for k in ("n", "k0", "k1", "k2", "k3")]
    once = written(lines.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc").alias("doc"), F.min("th").alias("th"), F.min("pos").alias("pos"), *keys), "distinct")
    repeats = lines.select("h", "doc", "th", "pos").join(once.filter("copies > 1").select("h", F.col("doc").alias("least")), "h")
    repeats = written(repeats, "repeats")
    firsts = written(repeats.filter(F.col("doc").eqNullSafe(F.col("least"))).groupBy("h").agg(F.min(_place()).alias("first")), "firsts")
    single = once.filter("copies = 1 and k0 is not null").select("h", "n", "k0", "k1", "k2", "k3", _place().alias("first"))
    again = once.filter("copies > 1 and k0 is not null").select("h", "n", "k0", "k1", "k2", "k3").join(firsts, "h")
    with scratch_goes(docs.sparkSession) as keep:
        near = keep(written(_near_repeats(single.unionByName(again), docs), "near"))
    stay = firsts.join(near, "h", "left_anti").select("first.doc", "first.th", "first.pos", F.lit(True).alias("stays"))
    alone = once.filter("copies = 1").join(near, "h", "left_semi").select("doc", "th", "pos", F.lit(False).alias("stays"))
    places = repeats.select("doc", "th", "pos", F.lit(False).alias("stays")).unionByName(alone).unionByName(stay)
    told = places.groupBy("doc", "th").agg(F.collect_set(F.when(~F.col("stays"), F.col("pos"))).alias("p"), F.collect_set(F.when(F.col("stays"), F.col("pos"))).alias("s"))
    return told.select("doc", "th", F.array_except("p", "s").alias("gone")).filter(F.size("gone") > 0)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_words: int = NEAR_WORDS, added: tuple[str, str] = ("lines_before", "lines_gone")) -> DataFrame:
    """All columns of ``docs``, the text without its repeated lines, plus lines_before and lines_gone.

    Lines end at a line feed. Blank ones always stay; those of fewer than ``near_words`` words go only if
    repeated word for word. A null text stays null. Ids that repeat with other
    texts are ordered by the hash of the text; null ids come last; rows equal in id and text lose the
    same lines. An empty table gives no rows. A line may have any length. Other columns may have any names, but those of ``added``.
    """
    if set(added) & set(docs.columns):
        raise ValueError(f"the table has a column {added}: name others in added")
    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    gone = repeated_lines(own, near_words).select(F.struct("doc", "th", "gone").alias("found"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row")[text_col]
    # one row for each document that loses lines: too many to broadcast, whatever their number here
    found = rows.join(gone.hint("merge"), F.col("row")[id_col].eqNullSafe(F.col("found.doc")) & (F.xxhash64(text_or_empty(text)) == F.col("found.th")), "left")
    parts = F.split(text, "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("found.gone", i)), "\n")
    count = F.when(text_or_empty(text) == "", 0).otherwise(F.size(parts))
    out = [F.when(F.col("found").isNull(), text).otherwise(kept) if c == text_col else F.col("row")[c] for c in docs.columns]
    return found.select(*[x.alias(c) for x, c in zip(out, docs.columns)], count.alias(added[0]), F.coalesce(F.size("found.gone"), F.lit(0)).alias(added[1]))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
