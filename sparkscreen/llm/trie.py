"""Trie of conversation prefixes, screened by a count-min sketch.

A node is a distinct sequence of first turns; its members are the conversations that start with it.

1. Turns are numbered over all tasks. A prefix's 128-bit digest is the xor of its turns' hashes, each
   taken with its depth, so that it follows from running sums, which long conversations make in pieces.
2. Tasks count the digests of all prefixes in count-min sketches with counters up to two, which are
   merged. Its estimates are never too low: one proves that a prefix is one conversation's alone.
   Deeper prefixes of that conversation are then its own too.
3. Such tails are emitted where they are: their nodes have one member, one leaf and nothing to save.
4. Only prefixes that are possibly shared are shuffled and grouped exactly. What an estimate of two or
   more did wrong to a prefix that is not shared is put right there.

Subtree figures need no walk over the trie. A member owns a node if it is its smallest one; it owns all
nodes behind that too. So the turns that a member need not store are those before it owns, and a
node's saving is the sum of what of them lies at or below it; its leaves are those that members own.

The sketch takes ``CELLS`` cells for each prefix and hash, up to ``MOST_CELLS`` for each hash (16 MB together, the
bound of what is broadcast); beyond that its estimates are higher and more is grouped exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_hot, numbered, table, written
from .merkle import crc32_sql

CELLS, HASHES, MOST_CELLS, BLOCK_CELLS, PIECE = 4, 3, 1 << 24, 1 << 14, 1 << 14
KEY = ["depth", "p1", "p2"]
_NOTHING = hashlib.sha256(b"").hexdigest()


def turn_table(conversations: DataFrame) -> DataFrame:
    """c, turn, d1, d2 (digest of role and text) and bytes of the text; null roles and texts are empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.filter("conv_id is not null").select(F.col("conv_id").alias("c"), "turn", F.xxhash64(role, text).alias("d1"), F.xxhash64(F.lit("turn"), text, role).alias("d2"), F.octet_length(text).cast("long").alias("bytes"))


def plain_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation as it is: (c, depth, d1, d2, bytes, length) and (c, length)."""
    rows, whole = numbered(turns, "c", ["turn", "d1", "d2"])
    return rows.select("c", (F.col("pos") + 1).alias("depth"), "d1", "d2", "bytes", F.col("total").alias("length")), whole.select("c", F.col("total").alias("length"))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation c as the first h turns of conversation c - c % 5 and then its own after its first h; h = crc32(c) % 9."""
    numbers, whole = numbered(turns, "c", ["turn", "d1", "d2"])
    numbers = written(numbers, "turns")
    c = F.col("c")
    own = whole.select("c", (c - c % 5).alias("g"), (F.crc32(c.cast("string").cast("binary")) % 9).alias("h"), F.col("total").alias("n"))
    heads = whole.select(F.col("c").alias("g"), F.col("total").alias("of_head"))
    head = F.least("h", F.coalesce("of_head", F.lit(0)))
    convs = own.join(heads, "g", "left").select("c", "g", "h", head.alias("head"), (head + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    convs = written(convs, "convs")
    tails = numbers.drop("total").join(convs.select("c", "h", "head", "length"), "c").filter("pos >= h").select("c", (F.col("head") + F.col("pos") - F.col("h") + 1).alias("depth"), "d1", "d2", "bytes", "length")
    firsts = numbers.filter("c % 5 = 0 and pos < 8").select(F.col("c").alias("g"), "pos", "d1", "d2", "bytes")
    firsts = firsts.join(convs.select("c", "g", "head", "length"), "g").filter("pos < head").select("c", (F.col("pos") + 1).alias("depth"), "d1", "d2", "bytes", "length")
    return tails.unionByName(firsts), convs.select("c", "length")


def _prefixes(turns: DataFrame, piece: int) -> DataFrame:
    """(c, depth, d1, d2, bytes, length) -> with p1, p2 (digest of the prefix), q1, q2 (of the one before) and b, its bytes."""
    own = turns.select("c", "depth", "length", "bytes", F.xxhash64("depth", "d1", "d2").alias("m1"), F.xxhash64(F.lit("prefix"), "depth", "d2", "d1").alias("m2"), F.floor(F.col("depth") / piece).cast("long").alias("piece"))
    within = Window.partitionBy("c", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = own.repartition("c", "piece").select("*", F.bit_xor("m1").over(within).alias("r1"), F.bit_xor("m2").over(within).alias("r2"), F.sum("bytes").over(within).alias("rb"))
    # of conversations with several pieces, what stands before each: a row for a piece
    sums = own.filter(f"length >= {piece}").groupBy("c", "piece").agg(F.bit_xor("m1").alias("s1"), F.bit_xor("m2").alias("s2"), F.sum("bytes").alias("sb"))
    before = Window.partitionBy("c").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("c", "piece", F.bit_xor("s1").over(before).alias("x1"), F.bit_xor("s2").over(before).alias("x2"), F.sum("sb").over(before).alias("xb"))
    joined = run.join(base, ["c", "piece"], "left")
    with_base = lambda r, x: F.col(r).bitwiseXOR(F.coalesce(x, F.lit(0)))
    p1, p2 = with_base("r1", "x1"), with_base("r2", "x2")
    return joined.select("c", "depth", "length", "bytes", p1.alias("p1"), p2.alias("p2"), p1.bitwiseXOR(F.col("m1")).alias("q1"), p2.bitwiseXOR(F.col("m2")).alias("q2"), (F.col("rb") + F.coalesce("xb", F.lit(0))).alias("b"))


# ---- the sketch ----


def _places(p1: np.ndarray, p2: np.ndarray, cells: int) -> list[np.ndarray]:
    """Each hash's cell for each digest."""
    shift = np.uint64(64 - cells.bit_length() + 1)
    return [((p1.view(np.uint64) + np.uint64(i) * p2.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> shift for i in range(HASHES)]


def _halves(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("p1").to_numpy(), batch.column("p2").to_numpy()


def sketch(prefixes: DataFrame, total: int) -> tuple[int, list[np.ndarray]]:
    """Cells for each hash, and for each hash their counters up to two, one byte each."""
    cells = min(MOST_CELLS, 1 << max(16, (CELLS * total - 1).bit_length()))

    def counted(batches):
        counts = np.zeros((HASHES, cells), np.uint8)
        for batch in batches:
            for own, at in zip(counts, _places(*_halves(batch), cells)):
                which, n = np.unique(at.astype(np.int64), return_counts=True)
                own[which] = np.minimum(own[which] + n, 2)
        for i, own in enumerate(counts.reshape(HASHES, -1, BLOCK_CELLS)):
            some = np.flatnonzero(own.any(axis=1))
            for first in range(0, len(some), 64):
                blocks = some[first : first + 64]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), i, np.int32)), pa.array(blocks.astype(np.int32)), pa.array([own[b].tobytes() for b in blocks], pa.binary())], names)

    def merged(batches):
        at, total = None, None
        for batch in batches:
            for h, b, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if (h, b) != at:
                    if at:
                        yield one(at, total)
                    at, total = (h, b), np.frombuffer(raw, np.uint8)
                else:
                    total = np.minimum(total + np.frombuffer(raw, np.uint8), 2)
        if at:
            yield one(at, total)

    def one(at, total):
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([total.tobytes()], pa.binary())], names)

    names, schema = ["hash", "block", "cells"], "hash int, block int, cells binary"
    parts = written(prefixes.select("p1", "p2").mapInArrow(counted, schema), "sketches")
    found = parts.repartition("hash", "block").sortWithinPartitions("hash", "block").mapInArrow(merged, schema).collect()
    rows = np.zeros((HASHES, cells), np.uint8)
    for r in found:
        rows[r["hash"], r["block"] * BLOCK_CELLS :][:BLOCK_CELLS] = np.frombuffer(r["cells"], np.uint8)
    return cells, list(rows)


SHARED, FIRST, FURTHER = 0, 1, 2


def _screened(prefixes: DataFrame, total: int) -> DataFrame:
    """``prefixes`` with ``kind``: possibly shared, or proved to be one conversation's, the first such in its piece of the task or a further one."""
    spark = prefixes.sparkSession
    cells, rows = sketch(prefixes, total)
    # four counters in a byte
    packed = [sum(row.reshape(-1, 4)[:, i] << (2 * i) for i in range(4)).astype(np.uint8) for row in rows]
    shared = spark.sparkContext.broadcast(packed)

    def kinds(batches):
        last = None  # the conversation whose tail goes on
        for batch in batches:
            single = np.zeros(batch.num_rows, bool)
            for row, at in zip(shared.value, _places(*_halves(batch), cells)):
                at = at.astype(np.int64)
                single |= (row[at >> 2] >> (2 * (at & 3)).astype(np.uint8)) & 3 == 1
            ids = batch.column("c").to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
            out = np.zeros(len(ids), np.int8)
            for a, b in zip(begins, [*begins[1:], len(ids)]):
                if last == ids[a]:
                    out[a:b] = FURTHER
                elif single[a:b].any():
                    first = a + int(single[a:b].argmax())
                    out[first], out[first + 1 : b] = FIRST, FURTHER
                    last = ids[a]
                else:
                    last = None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "kind"])

    schema = ", ".join(f"{c} {k}" for c, k in prefixes.dtypes) + ", kind byte"
    return prefixes.mapInArrow(kinds, schema)


# ---- exact grouping ----


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, p1, p2, c) -> depth, p1, p2, ends: SHA-256 of each key's ids, ascending and joined by commas.

    The ids of one key may be any number: sorted over all tasks, put together to texts batch by batch, and hashed as they stream by.
    """
    given = written(rows.select(*KEY, "c"), "ends")
    ordered = given.repartitionByRange(max(1, -(-given.count() // (1 << 18))), *KEY, "c").sortWithinPartitions(*KEY, "c")
    kind = "depth long, p1 long, p2 long, "

    def texts(batches):
        for batch in batches:
            keys, ids = np.stack([batch.column(c).to_numpy() for c in KEY]), batch.column("c").to_numpy()
            if not len(ids):
                continue
            begins = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            joined = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(begins, [*begins[1:], len(ids)])]
            yield pa.RecordBatch.from_arrays([*[pa.array(k[begins]) for k in keys], pa.array(ids[begins]), pa.array(joined, pa.string())], [*KEY, "first", "ids"])

    def hashes(batches):
        at, state = None, None
        for batch in batches:
            done = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if key != at:
                    done += [(*at, state.hexdigest())] if at else []
                    at, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield made(done)
        if at:
            yield made([(*at, state.hexdigest())])

    def made(rows):
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], [*KEY, "ends"])

    pieces = ordered.mapInArrow(texts, kind + "first long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(hashes, kind + "ends string")


def _where(cond: Column, value: Column) -> Column:
    return F.when(cond, value)


def trie(turns: DataFrame, convs: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row for each node of the trie of all prefixes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has c, depth from 1 without gaps, d1, d2, bytes and length; ``convs`` c and length, also of conversations without turns.
    conv_id is the smallest member. No conversations give no rows. Conversations of any length, and any number of equal ones.
    """
    prefixes = written(_prefixes(turns, piece), "prefixes")
    known = written(_screened(prefixes, prefixes.count()), "screened")
    convs = written(convs, "lengths")
    rows = known.filter(F.col("kind") == SHARED)
    c, owns = F.col("c"), F.col("least") == F.col("c")
    nodes = written(rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("length").alias("longest")), "nodes")
    back = written(join_hot(rows, nodes, KEY, "n", max(1, rows.count())), "members")

    # of each conversation: where it starts to own its nodes, which node's owner stands before that, whether it owns its last node and that has no children
    there = F.struct("depth", (F.col("b") - F.col("bytes")).alias("before"))
    of_shared = back.groupBy("c").agg(F.min(_where(owns, there)).alias("own"), F.max(_where(~owns, F.struct("depth", "least"))).alias("other"), F.max(owns & (F.col("depth") == F.col("length")) & (F.col("longest") == F.col("length"))).alias("last"), F.max("b").alias("all_bytes"))
    of_tails = known.filter(F.col("kind") == FIRST).groupBy("c").agg(F.min(there).alias("tail"))
    begin = F.least(F.coalesce("own", "tail"), F.coalesce("tail", "own"))
    least_c, longest = convs.agg(F.min("c"), F.max("length")).first()
    if least_c is None:
        return _as_rows(nodes.limit(0), *[F.lit(None)] * 8)
    empty_root = F.col("c") == least_c if not longest else F.lit(False)
    info = convs.join(of_shared, "c", "left").join(of_tails, "c", "left").select(
        "c",
        "length",
        begin["depth"].alias("begin"),
        F.col("tail.depth").alias("tail"),
        F.coalesce("other.least", F.lit(least_c)).alias("owner_before"),
        (F.col("tail").isNotNull() | F.coalesce("last", F.lit(False)) | empty_root).alias("leaf"),
        F.coalesce(begin["before"], "all_bytes", F.lit(0)).alias("not_stored"),
    )
    info = written(info, "info")

    seen = back.join(info.drop("length"), "c")
    parent = _where(owns, _where(F.col("depth") == F.col("begin"), F.col("owner_before")).otherwise(c))
    saved = F.greatest(F.col("not_stored") - (F.col("b") - F.col("bytes")), F.lit(0))
    members = seen.select(*KEY, c, parent.alias("parent"), F.lit(1).alias("n"), F.lit(0).alias("child"), F.col("leaf").cast("int").alias("leaf"), saved.alias("saved"))
    child = lambda df: df.select((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("n"), F.lit(1).alias("child"), F.lit(0).alias("leaf"), F.lit(0).cast("long").alias("saved"))
    firsts = written(known.filter(F.col("kind") == FIRST).join(info.select("c", "tail", "owner_before", "begin"), "c"), "firsts")
    begun = firsts.filter("depth = tail")
    told = members.unionByName(child(back.filter(owns & (F.col("depth") > 1)))).unionByName(child(begun.filter("depth > 1")))
    grouped = told.groupBy(*KEY).agg(F.min("c").alias("least"), F.max("parent").alias("parent"), F.sum("n").alias("n"), F.sum("child").alias("children"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")).filter("n > 0")

    children = back.filter(owns & (F.col("depth") == 1)).select("c").unionByName(begun.filter("depth = 1").select("c")).count()
    zero = F.lit(0).cast("long")
    root = info.agg(F.min("c").alias("least"), F.count("*").alias("n"), F.sum(F.col("leaf").cast("int")).alias("leaves"), F.sum("not_stored").alias("saved"))
    root = root.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "least", F.lit(None).cast("long").alias("parent"), "n", F.lit(children).cast("long").alias("children"), "leaves", "saved")
    ended = back.filter("depth = length").select(*KEY, "c").unionByName(info.filter("length = 0").select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "c"))
    exact = grouped.unionByName(root).join(_ends(ended), KEY, "left")
    out = _as_rows(exact, F.col("least"), F.col("depth"), F.col("parent"), F.col("n"), F.col("children"), F.col("leaves"), F.col("saved"), F.coalesce("ends", F.lit(_NOTHING)))

    ends = _where(F.col("depth") == F.col("length"), F.sha2(c.cast("string").cast("binary"), 256)).otherwise(F.lit(_NOTHING))
    alone = lambda df, parent: _as_rows(df, c, F.col("depth"), parent, F.lit(1), (F.col("depth") < F.col("length")).cast("int"), F.lit(1), F.lit(0), ends)
    first_parent = _where((F.col("depth") == F.col("tail")) & (F.col("depth") == F.col("begin")), F.col("owner_before")).otherwise(c)
    return out.unionByName(alone(known.filter(F.col("kind") == FURTHER), c)).unionByName(alone(firsts, first_parent))


_NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")


def _as_rows(df: DataFrame, *values: Column) -> DataFrame:
    *numbers, ends = values
    return df.select(*[v.cast("long").alias(n) for v, n in zip(numbers, _NAMES)], ends.cast("string").alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations. Turns are ordered by turn, null first, equal ones by their digests; rows without conv_id are no conversation's."""
    return trie(*rebuilt_turns(turn_table(table(spark, sf_dir, "conversations"))))


OP12_SQL = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, c - c % 5 AS g, {crc32_sql('c::VARCHAR')} % 9 AS h, count(*) AS n FROM t GROUP BY c),
b AS (SELECT v.c, t.i AS d, r, x FROM v JOIN t ON t.c = v.g AND t.i <= v.h
  UNION ALL SELECT v.c, least(v.h, coalesce(w.n, 0)) + t.i - v.h, r, x FROM v JOIN t ON t.c = v.c AND t.i > v.h LEFT JOIN v w ON w.c = v.g),
p AS (SELECT c, d, string_agg(strlen(r) || ':' || r || strlen(x) || ':' || x, '') OVER (PARTITION BY c ORDER BY d) AS k, string_agg(strlen(r) || ':' || r || strlen(x) || ':' || x, '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q, strlen(x) AS bytes, count(*) OVER (PARTITION BY c) AS len FROM b
  UNION ALL SELECT v.c, 0, '', NULL, 0, coalesce(l.len, 0) FROM v LEFT JOIN (SELECT c, count(*) AS len FROM b GROUP BY c) l ON l.c = v.c),
nodes AS (SELECT d, k, min(c) AS conv_id, any_value(coalesce(q, '')) AS q, count(*) AS n, max(bytes) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '')) AS ends, bool_and(d = len) AS childless FROM p GROUP BY d, k),
below AS (SELECT p.d, p.k, sum((u.n - 1) * u.bytes) AS saved, count(*) FILTER (u.childless) AS leaves FROM nodes u JOIN p ON p.c = u.conv_id AND p.d <= u.d GROUP BY p.d, p.k),
kids AS (SELECT d - 1 AS d, q AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY d, q)
SELECT a.conv_id, a.d::BIGINT AS depth, up.conv_id AS parent_conv_id, a.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, a.ends AS ends_sha256
FROM nodes a JOIN below ON below.d = a.d AND below.k = a.k LEFT JOIN nodes up ON up.d = a.d - 1 AND up.k = a.q LEFT JOIN kids ON kids.d = a.d AND kids.k = a.k"""
