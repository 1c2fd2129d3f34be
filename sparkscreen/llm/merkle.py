"""Merkle manifest of a dataset, with a butterfly exchange for the upper levels.

Rows are leaves, ordered within groups; ``fanout`` consecutive nodes are hashed into one, level by
level, until one remains: the group's root. The groups' roots, in order, are hashed into the root
of all in the same way.

1. Leaves are sorted over all tasks and numbered by prefix sums over the sorted ranges.
2. ``fanout ** block_levels`` leaves are a block, hashed up within one task. Blocks are the partitions
   of the exchange, so a group of any size is many partitions.
3. In each round, ``fanout ** round_levels`` partitions, aligned by their number, swap the roots of the
   subtrees that they have so far, and each hashes the common ancestors for itself. So after the last
   round every partition has the whole upper part of its leaves' proofs, and nothing has to come down
   again. Partitions with the same place in neighbouring subtrees are partners; the last subtree of a
   group, which may have fewer partitions, tells its root to all partners by a join on the group.
4. The tree over the groups' roots is made by the same steps, as one group.

Digests are SHA-256 of lower-case hex texts put together, as Spark's ``sha2`` gives them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, small, table, written

FANOUT, BLOCK_LEVELS, ROUND_LEVELS = 2, 12, 4


def digest(nodes: Iterable[bytes]) -> bytes:
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def climb(nodes: list[bytes], fanout: int, levels: int | None) -> list[list[bytes]]:
    """The nodes of each level, from the given ones up: ``levels`` times, or until one remains if None."""
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        below = out[-1]
        out.append([digest(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def siblings(levels: list[list[bytes]], at: int, fanout: int) -> list[tuple[list[bytes], int]]:
    """For node ``at`` of the lowest level and each level but the highest: the others of its run, and how many stand left of it."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % fanout
        out.append(([n for i, n in enumerate(nodes[first : first + fanout], first) if i != at], at - first))
        at //= fanout
    return out


def fold(leaf: bytes, proof: Iterable[tuple[Sequence[bytes], int]]) -> bytes:
    """The root that follows from a leaf and its proof."""
    for others, left in proof:
        leaf = digest([*others[:left], leaf, *others[left:]])
    return leaf


_PROOF = "array<struct<others: array<binary>, left: int>>"


def _pairs(proof: list[dict]) -> list[tuple[list[bytes], int]]:
    return [(x["others"], x["left"]) for x in proof]


def _records(proof: list[tuple[list[bytes], int]]) -> list[dict]:
    return [{"others": others, "left": left} for others, left in proof]


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 (hex) of the values in order, each ``-`` if null, else its UTF-8 length, a colon and itself."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def _blocks(leaves: DataFrame, fanout: int, block_levels: int) -> tuple[DataFrame, DataFrame]:
    """(grp, key, leaf, payload...) -> blocks (grp, block, n_blocks, root, keys and leaves), and groups (grp, total)."""
    extra = [c for c in leaves.columns if c not in ("grp", "key", "leaf")]
    numbers, whole = numbered(leaves, "grp", ["key", "leaf"])
    size = fanout**block_levels
    placed = numbers.withColumn("block", F.floor(F.col("pos") / size).cast("long")).withColumn("n_blocks", F.ceil(F.col("total") / size).cast("long"))
    kind = dict(leaves.dtypes)
    schema = f"grp {kind['grp']}, block long, n_blocks long, root binary, key array<{kind['key']}>, leaf array<binary>" + "".join(f", {c} array<{kind[c]}>" for c in extra)

    def hashed(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        nodes, n_blocks = t["leaf"].to_pylist(), t["n_blocks"][0].as_py()
        root = climb(nodes, fanout, block_levels if n_blocks > 1 else None)[-1][0]
        lists = [t[c].to_pylist() for c in ("key", "leaf", *extra)]
        row = [t["grp"][0].as_py(), t["block"][0].as_py(), n_blocks, root, *lists]
        kinds = [t.schema.field("grp").type, pa.int64(), pa.int64(), pa.binary(), *[pa.list_(t.schema.field(c).type) for c in ("key", "leaf", *extra)]]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["grp", "block", "n_blocks", "root", "key", "leaf", *extra])

    return written(placed.groupBy("grp", "block").applyInArrow(hashed, schema), "blocks"), whole


def _round(state: DataFrame, r: int, fanout: int, round_levels: int, tails_rows: int) -> DataFrame:
    """One round: (grp, block, n_blocks, root, proof) after ``r`` rounds -> after ``r + 1``. Ended groups stay as they are."""
    radix = fanout**round_levels
    width = radix**r  # partitions of a subtree
    block, n_blocks = F.col("block"), F.col("n_blocks")
    nodes = F.ceil(n_blocks / width).cast("long")
    node = F.floor(block / width).cast("long")
    state = state.withColumn("nodes", nodes).withColumn("node", node)
    going, ended = state.filter("nodes > 1"), state.filter("nodes = 1")
    first = F.floor(F.col("node") / radix).cast("long") * radix
    last = F.least(first + radix, F.col("nodes")) - 1
    # to each node's partner, the partition with the same place in it; those that the last, shorter subtree lacks hear nothing
    partner = F.transform(F.sequence(first, last), lambda t: t * width + block % width)
    sent = going.select("grp", F.explode(F.filter(partner, lambda t: t < n_blocks)).alias("to"), "node", "root")
    # the last subtree may be shorter than its neighbours, so its root goes to all that need it by the group
    tails = going.filter((F.col("node") == F.col("nodes") - 1) & (block % width == 0)).select(F.col("grp").alias("tg"), F.col("node").alias("tail"), F.col("root").alias("tail_root"))
    heard = sent.groupBy("grp", "to").agg(F.collect_list(F.struct("node", "root")).alias("heard")).select(F.col("grp").alias("hg"), "to", "heard")
    both = going.join(heard, F.col("grp").eqNullSafe(F.col("hg")) & (block == F.col("to"))).join(small(tails, tails_rows, 96), F.col("grp").eqNullSafe(F.col("tg")))
    told = both.select("grp", "block", "n_blocks", "proof", "node", "nodes", "heard", "tail", "tail_root")

    def ancestors(batches):
        for batch in batches:
            rows = batch.to_pylist()
            for x in rows:
                base = x["node"] - x["node"] % radix
                known = {m["node"]: m["root"] for m in x["heard"]}
                if base <= x["tail"] < base + radix:
                    known[x["tail"]] = x["tail_root"]
                levels = climb([known[k] for k in sorted(known)], fanout, None if x["nodes"] <= radix else round_levels)
                x["root"], x["proof"] = levels[-1][0], x["proof"] + _records(siblings(levels, x["node"] - base, fanout))
            yield pa.RecordBatch.from_pylist([{c: x[c] for c in out.names} for x in rows], out)

    out = pa.schema([("grp", _arrow(state, "grp")), ("block", pa.int64()), ("n_blocks", pa.int64()), ("root", pa.binary()), ("proof", _ARROW_PROOF)])
    keep = ["grp", "block", "n_blocks", "root", "proof"]
    risen = told.mapInArrow(ancestors, ", ".join(f"{c} {k}" for c, k in state.select(*keep).dtypes))
    return ended.select(*keep).unionByName(risen)


_ARROW_PROOF = pa.list_(pa.struct([("others", pa.list_(pa.binary())), ("left", pa.int32())]))


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _upper(blocks: DataFrame, groups: int, most_blocks: int, fanout: int, round_levels: int) -> DataFrame:
    """grp, block, root of the group, proof above the block, for each block."""
    state = blocks.select("grp", "block", "n_blocks", "root", F.array().cast(_PROOF).alias("proof"))
    r = 0
    while fanout ** (round_levels * r) < most_blocks:
        state = written(_round(state, r, fanout, round_levels, groups), "round")
        r += 1
    return state.select(F.col("grp").alias("ug"), F.col("block").alias("ub"), F.col("root").alias("subroot"), F.col("proof").alias("upper"))


def _tree(leaves: DataFrame, fanout: int, block_levels: int, round_levels: int) -> tuple[DataFrame, DataFrame, int]:
    """Blocks, their upper proofs, and how many groups there are."""
    blocks, whole = _blocks(leaves, fanout, block_levels)
    groups, most = whole.agg(F.count("*"), F.max("total")).first()
    return blocks, _upper(blocks, groups, -(-(most or 0) // fanout**block_levels), fanout, round_levels), groups


def manifest(leaves: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS, round_levels: int = ROUND_LEVELS) -> DataFrame:
    """(grp, key, leaf, ...) -> one row for each block of leaves, with everything that its proofs need.

    ``leaf`` is a digest (binary), ``grp`` says which tree, and leaves ascend by ``key``; nulls come first,
    equal keys ascend by digest. Columns: grp, block, key, leaf and the others as arrays in order; upper, the
    proof above the block within its group; subroot; top, the proof from it to root; root; and whole, which says
    that the block is its whole group. An empty table gives no rows. Any number of leaves may be equal.
    """
    if fanout < 2 or block_levels < 1 or round_levels < 1:
        raise ValueError("a fanout of two or more, and at least one level for each block and round")
    blocks, upper, groups = _tree(leaves, fanout, block_levels, round_levels)
    roots = upper.filter("ub = 0").select(F.lit(0).alias("grp"), F.col("ug").alias("key"), F.col("subroot").alias("leaf"))
    tops, over, _ = _tree(roots, fanout, block_levels, round_levels)
    top = tops.join(over, F.col("block") == F.col("ub")).select("key", "leaf", F.col("upper").alias("above"), F.col("subroot").alias("root"), (F.col("n_blocks") == 1).alias("whole"))

    def proofs(batches):
        for batch in batches:
            for x in batch.to_pylist():
                levels = climb(x["leaf"], fanout, None if x["whole"] else block_levels)
                rows = [{"tg": g, "top": _records(siblings(levels, i, fanout)) + x["above"], "all_root": x["root"]} for i, g in enumerate(x["key"])]
                yield pa.RecordBatch.from_pylist(rows, out)

    out = pa.schema([("tg", _arrow(leaves, "grp")), ("top", _ARROW_PROOF), ("all_root", pa.binary())])
    by_group = top.mapInArrow(proofs, f"tg {dict(leaves.dtypes)['grp']}, top {_PROOF}, all_root binary")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    joined = blocks.join(upper, same("grp", "ug") & (F.col("block") == F.col("ub"))).join(small(by_group, groups, 4096), same("grp", "tg"))
    return joined.select(*[c for c in blocks.columns if c not in ("n_blocks", "root")], (F.col("n_blocks") == 1).alias("whole"), "upper", "subroot", "top", F.col("all_root").alias("root"))


def proofs(found: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS, changed: str | None = None) -> DataFrame:
    """The blocks of ``manifest`` -> one row for each leaf: grp, key, leaf, subroot, root, proof, folded_root, verified.

    ``proof`` holds the siblings level by level from the leaf to the root. ``changed`` names a column of digests that,
    where they are not null, are folded in place of the leaf: verified says whether that still gives the root.
    """
    kind = dict(found.dtypes)

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = {c: v[0] for c, v in batch.slice(i, 1).to_pydict().items()}
                levels = climb(x["leaf"], fanout, None if x["whole"] else block_levels)
                above = _pairs(x["upper"]) + _pairs(x["top"])
                news = x[changed] if changed else [None] * len(x["leaf"])
                rows = []
                for at, (key, leaf, new) in enumerate(zip(x["key"], x["leaf"], news)):
                    path = siblings(levels, at, fanout) + above
                    seen = fold(new or leaf, path)
                    rows.append((x["grp"], key, leaf.hex(), x["subroot"].hex(), x["root"].hex(), _records(path), digest(n for others, _ in path for n in others).hex(), seen.hex(), seen == x["root"]))
                for first in range(0, len(rows), 1024):
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows[first : first + 1024]), out)], schema=out)

    key = kind["key"].removeprefix("array<").removesuffix(">")
    out = pa.schema([("grp", _arrow(found, "grp")), ("key", _arrow(found, "key").value_type), *[(c, pa.string()) for c in ("leaf", "subroot", "root")], ("proof", _ARROW_PROOF), ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())])
    return found.mapInArrow(each, f"grp {kind['grp']}, key {key}, leaf string, subroot string, root string, proof {_PROOF}, proof_sha256 string, folded_root string, verified boolean")


def op11_merkle_butterfly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, its proof and what a tampered n_chars does to it, by the columns of the contract."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    values = {c: F.col(c) for c in fields}
    tampered = values | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = docs.select(
        F.col("lang").alias("grp"),
        F.col("doc_id").alias("key"),
        F.unhex(leaf_digest(list(values.values()))).alias("leaf"),
        F.when(hit, F.unhex(leaf_digest(list(tampered.values())))).alias("tampered"),
    )
    found = proofs(manifest(leaves), changed="tampered")
    return found.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", F.col("grp").alias("lang"))


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of an ASCII text."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {step})"
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda a: ascii(a)::BIGINT), lambda c, b: {byte}), 4294967295)"


def _part_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf_sql(chars: str) -> str:
    return "sha256(" + " || ".join(map(_part_sql, ("doc_id", "source", "lang", chars, "text"))) + ")"


def _folded_sql(name: str, start: str) -> str:
    """Recursive step that folds each row's h along the siblings of level lvl, which stand in nodes (tree, lvl, pos, h, n)."""
    return f"""{name} AS ({start} UNION ALL SELECT f.id, f.tree, f.lvl + 1, f.pos // 2,
  sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END), f.proof || coalesce(s.h, ''), (f.n + 1) // 2
  FROM {name} f LEFT JOIN nodes s ON s.tree = f.tree AND s.lvl = f.lvl AND s.pos = xor(f.pos, 1) WHERE f.n > 1)"""


OP11_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} END AS tampered FROM documents),
o AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER () AS id FROM d),
low AS (SELECT tree, 0 AS lvl, pos, leaf AS h, n FROM o UNION ALL SELECT tree, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, lvl, pos // 2, n),
subs AS (SELECT tree AS lang_tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS tree, 0 AS lvl, pos, subroot AS h, n FROM subs UNION ALL SELECT 0, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY lvl, pos // 2, n),
nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
{_folded_sql('f', "SELECT id, tree, 0 AS lvl, pos, coalesce(tampered, leaf) AS h, '' AS proof, n FROM o")},
{_folded_sql('g', "SELECT f.id, 0 AS tree, 0 AS lvl, subs.pos, f.h, f.proof, subs.n FROM f JOIN subs ON subs.lang_tree = f.tree WHERE f.n = 1")}
SELECT o.doc_id, o.leaf, subs.subroot, high.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = high.h AS verified, o.lang
FROM o JOIN g ON g.id = o.id AND g.n = 1 JOIN subs ON subs.lang_tree = o.tree JOIN high ON high.n = 1"""
