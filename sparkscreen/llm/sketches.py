"""Document fingerprints: an invertible Bloom lookup sketch of a text's paragraphs.

A text's paragraphs (lines, in pieces of at most ``PIECE_WORDS`` words) are hashed to 64-bit digests.
A sketch has three tables of cells; a digest falls into one cell of each, and a cell keeps how many
fell in, the xor of the digests and the xor of their checks. Sketches of two versions are subtracted
cell by cell: common digests cancel, and peeling (take a cell that holds one digest, take that digest
out of its other cells, go on) recovers those that differ.

The fingerprint is the sketch itself, whole: digests are dealt by hash bits into a power of two of blocks of
at most ``BLOCK_LOAD`` on average, each with tables of its own, so that the work grows in proportion to a text. A block that
cannot be peeled by itself is made again with larger tables, so every fingerprint can be decoded. Two
fingerprints are compared by themselves: the longer one is folded to the blocks of the shorter (cells add up),
they are subtracted and peeled block by block, and where that fails, as of two texts with little in
common, the larger sketches help, those of the two sides peeled each by itself. All of it are SQL expressions on arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, table, text_or_empty, written

PIECE_WORDS, BLOCK_LOAD, TABLES, TABLE_CELLS, ROUNDS = 20, 6, 3, (8, 32, 128), 8
_PIECE = rf"\S++(?:[^\S\n]++\S++){{0,{PIECE_WORDS - 1}}}+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs; blank ones do not count."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def _check(d: Column) -> Column:
    """32 bits."""
    return F.shiftrightunsigned(F.xxhash64(d, F.lit(17)), 32)


def _places(cells: int) -> Column:
    """For each cell, counted through all tables: the bits of a digest that choose it, and what they must be."""
    pairs = [((cells - 1) << 7 * t, c << 7 * t) for t in range(TABLES) for c in range(cells)]
    literal = lambda numbers: F.expr(f"array({', '.join(f'{n}L' for n in numbers)})")
    return F.arrays_zip(literal(m for m, _ in pairs).alias("m"), literal(v for _, v in pairs).alias("v"))


def _falls(d: Column, place: Column) -> Column:
    return d.bitwiseAND(place["m"]) == place["v"]


def _cell(c: Column, k: Column, x: Column) -> Column:
    return F.struct(c.cast("int").alias("c"), k.alias("k"), x.alias("x"))


def _none() -> Column:
    zero = F.lit(0).cast("long")
    return _cell(zero, zero, zero)


def _put(a: Column, d: Column, by: Column | int) -> Column:
    return _cell(a["c"] + by, a["k"].bitwiseXOR(d), a["x"].bitwiseXOR(_check(d)))


def sketch(found: Column, cells: int = TABLE_CELLS[0]) -> Column:
    """Array of ``TABLES * cells`` cells."""
    return F.transform(_places(cells), lambda p: F.aggregate(F.filter(found, lambda d: _falls(d, p)), _none(), lambda a, d: _put(a, d, 1)))


def _added(a: Column, b: Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["c"] + sign * y["c"], x["k"].bitwiseXOR(y["k"]), x["x"].bitwiseXOR(y["x"])))


def subtracted(a: Column, b: Column) -> Column:
    """A sketch less another of as many cells."""
    return _added(a, b, -1)


def peeled(difference: Column, cells: int = TABLE_CELLS[0], rounds: int = ROUNDS) -> Column:
    """The digests that a subtracted sketch holds; null if peeling does not empty it."""
    pure = lambda s: F.array_distinct(F.transform(F.filter(s, lambda y: (F.abs(y["c"]) == 1) & (_check(y["k"]) == y["x"])), lambda y: F.struct(y["k"].alias("k"), y["c"].alias("c"))))
    rest = lambda s, ps: F.zip_with(s, _places(cells), lambda y, p: F.aggregate(F.filter(ps, lambda q: _falls(q["k"], p)), y, lambda z, q: _put(z, q["k"], -q["c"])))
    state = lambda s, f, done: F.struct(s.alias("s"), f.alias("f"), done.alias("done"))
    round_ = lambda z: _let(pure(z["s"]), lambda ps: F.when(F.size(ps) == 0, state(z["s"], z["f"], F.lit(True))).otherwise(state(rest(z["s"], ps), F.concat(z["f"], F.transform(ps, lambda q: q["k"])), F.lit(False))))
    empty = lambda s: F.forall(s, lambda y: (y["c"] == 0) & (y["k"] == 0) & (y["x"] == 0))
    start = state(difference, F.array().cast("array<bigint>"), F.lit(False))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda z, _: F.when(z["done"], z).otherwise(round_(z)))
    return _let(done, lambda z: F.when(empty(z["s"]), z["f"]))


def _dealt(found: Column) -> Column:
    """The digests of each block, in the order of the blocks: dealt twice by fewer bits, so that no block looks at all digests."""
    bits = F.when(F.size(found) <= BLOCK_LOAD, 0).otherwise(F.ceil(F.log2(F.size(found) / F.lit(float(BLOCK_LOAD))))).cast("int")
    one = F.lit(1).cast("long")
    of = lambda d, n: F.shiftrightunsigned(d, 24).bitwiseAND(n - 1)
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)

    def deal(z: Column) -> Column:
        n, few = z["n"], z["few"]
        by_low = F.transform(up_to(few), lambda s: _let(F.filter(found, lambda d: of(d, few) == s), lambda own: F.transform(up_to(F.floor(n / few)), lambda j: F.filter(own, lambda d: of(d, n) == s + j * few))))
        return _let(by_low, lambda g: F.transform(up_to(n), lambda b: F.element_at(F.element_at(g, (b % few + 1).cast("int")), (F.floor(b / few) + 1).cast("int"))))

    shift = lambda by: F.call_function("shiftleft", one, by)
    return F.when(F.size(found) <= BLOCK_LOAD, F.array(found)).otherwise(_let(bits, lambda k: _let(F.struct(shift(k).alias("n"), shift(F.floor(k / 2).cast("int")).alias("few")), deal)))


def sketched(found: Column) -> Column:
    """Digests -> for each block a struct of its cells and of the digests that peeling them gives.

    A block has the smallest tables that can be peeled; digests alike in all bits of place stay out of the
    second, though not of the cells.
    """
    block = lambda cells, f: F.struct(cells.alias("cells"), f.alias("f"))
    made = lambda own, c: _let(sketch(own, c), lambda cells: block(cells, peeled(cells, c)))

    def smallest(own: Column, sizes: tuple[int, ...] = TABLE_CELLS) -> Column:
        if len(sizes) == 1:
            return _let(made(own, sizes[0]), lambda z: block(z["cells"], F.coalesce(z["f"], F.array().cast("array<bigint>"))))
        return _let(made(own, sizes[0]), lambda z: F.when(z["f"].isNotNull(), z).otherwise(smallest(own, sizes[1:])))

    return F.transform(_dealt(found), lambda own: smallest(own))


def _held(blocks: Column) -> Column:
    """How many digests the cells hold: counted in the first table of each block."""
    return F.aggregate(blocks, F.lit(0), lambda n, z: n + F.aggregate(F.slice(z["cells"], F.lit(1), (F.size(z["cells"]) / TABLES).cast("int")), F.lit(0), lambda m, y: m + y["c"]))


def differing(a: Column, b: Column) -> Column:
    """How many digests are in one of two fingerprints only."""
    small_tables = TABLES * TABLE_CELLS[0]

    def at(i: Column, n: Column) -> Column:
        own = lambda s: F.filter(s, lambda z, j: j % n == i)
        folded = lambda x: F.aggregate(F.slice(x, F.lit(2), F.size(x)), F.element_at(x, 1)["cells"], lambda acc, z: _added(acc, z["cells"]))
        alike = lambda v: F.forall(F.concat(v["x"], v["y"]), lambda z: F.size(z["cells"]) == small_tables)

        def by_sides(v: Column) -> Column:
            lists = F.struct(F.flatten(F.transform(v["x"], lambda z: z["f"])).alias("p"), F.flatten(F.transform(v["y"], lambda z: z["f"])).alias("q"))
            lost = lambda w: _held(v["x"]) - F.size(w["p"]) + _held(v["y"]) - F.size(w["q"])
            return _let(lists, lambda w: F.size(F.array_except(w["p"], w["q"])) + F.size(F.array_except(w["q"], w["p"])) + lost(w))

        # each is evaluated only if the one before is null
        tried = lambda v: F.coalesce(F.when(alike(v), F.size(peeled(subtracted(folded(v["x"]), folded(v["y"]))))), by_sides(v))
        return _let(F.struct(own(a).alias("x"), own(b).alias("y")), tried)

    return _let(F.least(F.size(a), F.size(b)), lambda n: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + at(i, n)))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints as ``sketched`` gives them: twice the common digests over all digests; 1 for two texts without any."""
    return _let(F.struct((_held(a) + _held(b)).alias("n"), differing(a, b).alias("d")), lambda z: F.when(z["n"] == 0, F.lit(1.0)).otherwise((z["n"] - z["d"]) / z["n"]))


def fingerprint(blocks: Column) -> Column:
    """All blocks as hexadecimal text: a sign for the size of the tables (0, 1, 2), then each cell in 28 (count, digests, checks)."""
    part = lambda y: F.concat(F.lpad(F.hex(F.pmod(y["c"], F.lit(65536))), 4, "0"), F.lpad(F.hex(y["k"]), 16, "0"), F.lpad(F.hex(y["x"]), 8, "0"))
    size = lambda z: F.when(F.size(z["cells"]) == TABLES * TABLE_CELLS[0], "0").when(F.size(z["cells"]) == TABLES * TABLE_CELLS[1], "1").otherwise("2")
    return F.lower(F.array_join(F.transform(blocks, lambda z: F.concat(size(z), F.array_join(F.transform(z["cells"], part), ""))), ""))


def next_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, k, h, n) of documents -> doc_id, k, h, n, copies, next_k, next_h: descending ids, nulls last, then round to the first."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    once = docs.groupBy("k", "h").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    placed = written(once.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "order")
    in_part = Window.partitionBy("part").orderBy(*order)
    me = F.struct("k", "h")
    firsts = placed.withColumn("r", F.row_number().over(in_part)).filter("r = 1").select("part", me.alias("head"))
    # one row for each part
    along = Window.orderBy("part")
    heads = firsts.select("part", F.coalesce(F.lead("head").over(along), F.first("head").over(along)).alias("after"))
    led = placed.withColumn("follows", F.lead(me).over(in_part))
    joined = led.join(small(heads, placed.select("part").distinct().count()), "part")
    return joined.select("doc_id", "k", "h", "n", "copies", F.coalesce("follows", "after").alias("f")).select("doc_id", "k", "h", "n", "copies", F.col("f.k").alias("next_k"), F.col("f.h").alias("next_h"))


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last half replaced by the beginning of the next document.
    Null texts count as empty. Rows equal in id and text are one document, whose row is repeated.
    A single document is its own next. An empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumns({"k": F.xxhash64("doc_id"), "h": F.xxhash64("text")})
    order = written(next_documents(own.select("doc_id", "k", "h", F.char_length("text").alias("n"))), "next")
    once = own.groupBy("k", "h").agg(F.first("text").alias("text"))  # both joins read these columns of it, so its shuffle is made once
    before = order.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("to_k"), F.col("h").alias("to_h"), F.col("n").alias("to_n"), "doc_id", "copies")
    heads = once.join(before, ["k", "h"]).select(F.col("to_k").alias("k"), F.col("to_h").alias("h"), "doc_id", "to_n", "copies", F.substring("text", F.lit(1), F.floor(F.col("to_n") / 2).cast("int")).alias("head"), digests(F.col("text")).alias("next_digests"))
    pairs = once.join(heads, ["k", "h"])
    keep = (F.col("to_n") - F.floor(F.col("to_n") / 2)).cast("int")
    edited = pairs.select("doc_id", F.col("to_n").cast("long").alias("n_chars"), "copies", "next_digests", digests(F.col("text")).alias("own_digests"), F.concat(F.substring("text", F.lit(1), keep), "head").alias("edited"))
    hashed = written(edited.select("doc_id", "n_chars", "copies", F.sha2("edited", 256).alias("edited_sha256"), "own_digests", digests(F.col("edited")).alias("edited_digests"), "next_digests"), "digests")
    rows = hashed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    three = F.struct(sketched(F.col("own_digests")).alias("own"), sketched(F.col("edited_digests")).alias("edited"), sketched(F.col("next_digests")).alias("next"))
    told = _let(three, lambda z: F.struct(fingerprint(z["own"]).alias("fingerprint"), fingerprint(z["edited"]).alias("edited_fingerprint"), likeness(z["own"], z["edited"]).alias("near_edited"), likeness(z["own"], z["next"]).alias("near_next")))
    # one row in, one row out: the four are taken from one evaluation
    return rows.select("doc_id", "n_chars", "edited_sha256", F.inline(F.array(told)))


def op1_invertible_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(table(spark, sf_dir, "documents"))
