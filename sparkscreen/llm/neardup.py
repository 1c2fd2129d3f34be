"""Near-dedup of documents by long SimHash fingerprints and pivot distance tables.

The stage for near copies: five-word shingles, similarity 0.8. Equal shares of shingles of 0.8 differ in
about 15 of 100 SimHash bits, too far for the exact join of ``simhash``. So each document has
``WORDS`` fingerprints of 64 bits; a table row is kept for each of many random bit choices, keyed by the
distances to pivots over these bits (equal bits give equal distances); pairs that share a key are
discarded by their first word, then by their largest difference in whole-width pivot distances, and
verified bit by bit. What is left are candidates only: their shingle sets are fetched, and a pair is a
link if the sets themselves have the similarity.

The number of bits in a choice follows the number of documents, and the number of choices follows
from it so that a pair at the limit shares a key with probability ``RECALL``. Only which documents are
connected matters, so the members of crowded keys are first compared with one leader after another, and
connected with those similar to them. This takes no pair away: whatever is not connected by it is
compared as every other pair is. Keys with few members are paired up, but for pairs that are connected
already; crowded keys with more than one component left are compared in blocks within tasks, where
only what connects comes out. A key larger than a block is alike in bits, but perhaps not in words: its
members are keyed anew, by their rarest shingles, of which similar sets share one. If such a key is
too large for a block as well, its largest component is compared with all others, not with itself.
So the groups do not depend on the number of leaders, nor on where crowds and blocks begin.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_goes, small, text_or_empty, unused, written
from .components import components
from .simhash import _BATCH_SHINGLES, _signed, pivots, shingle_hashes

SHINGLE, WORDS, SIMILARITY, SLACK, RECALL, CROWD, CHUNK, FIRST_SLACK = 5, 4, 0.8, 3.0, 0.97, 24, 1000, 3.7
KEY_PIVOTS, WHOLE_PIVOTS, CHUNK_SHINGLES, STAR_ROUNDS, STAR_YIELD = 12, 4, 2_000_000, 3, 10
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def differing_share(similarity: float) -> float:
    """Expected share of bits in which two documents of that shingle similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_bits(similarity: float = SIMILARITY, words: int = WORDS, slack: float = SLACK) -> int:
    """The expected distance plus ``slack`` standard deviations."""
    p = differing_share(similarity)
    return math.floor(64 * words * (p + slack * math.sqrt(p * (1 - p) / (64 * words))))


def shingle_set(text: str, width: int = SHINGLE) -> np.ndarray:
    """The different shingle hashes in rising order, as signed numbers."""
    return np.unique(np.array(shingle_hashes(text, width), np.uint64).view(np.int64))


def node_of(found: np.ndarray) -> int:
    """Texts with equal sets are one node."""
    return _signed(xxhash.xxh64_intdigest(found.tobytes()))


def long_simhash(found: np.ndarray, words: int = WORDS) -> list[int]:
    """``words`` fingerprints of a set of shingle hashes, each by a further mixing of them."""
    if not len(found):
        return [0] * words
    counts, h = np.zeros((words, 64), np.int64), found.view(np.uint64)
    for w in range(words):
        x = h.copy()
        if w:
            x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[w % 3]) + np.uint64(w)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[(w + 1) % 3])
            x ^= x >> np.uint64(31)
        raw = x.astype(">u8").view(np.uint8).reshape(-1, 8)
        for at in range(0, len(raw), _BATCH_SHINGLES):
            counts[w] += np.unpackbits(raw[at : at + _BATCH_SHINGLES], axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(h), axis=1)
    return [_signed(int.from_bytes(row.tobytes(), "big")) for row in bits]


def long_fingerprints(docs: DataFrame, width: int = SHINGLE, words: int = WORDS) -> DataFrame:
    """doc_id, th, node, n, f0, f1, ...: hash of the text, node and size of its shingle set; blank texts have zeros."""
    text = text_or_empty("text")
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    names = [f"f{i}" for i in range(words)]

    def compute(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(2).to_pylist()]
            got = [(node_of(s), len(s), *long_simhash(s, words)) for s in sets]
            cols = list(zip(*got)) if got else [[]] * (words + 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "th", "node", "n", *names])

    return rows.mapInArrow(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, th long, node long, n long, " + ", ".join(f"{n} long" for n in names))


def _sets_of(nodes: DataFrame, docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(th) of one text for each node, from a written table -> node, shingles.

    Only the texts of these nodes are shuffled, while what names them is small.
    """
    text = text_or_empty("text")
    texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text")).join(small(nodes, nodes.count()), "th", "left_semi").dropDuplicates(["th"]).select("text")

    def compute(batches):
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.mapInArrow(compute, "node long, shingles array<long>")


def _apart(a: str, b: str, words: int = WORDS) -> Column:
    return sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(words)), F.lit(0))


def _to_pivot(k: int, masks: list[int], words: int) -> Column:
    ps = pivots((k + 1) * words)[k * words :]
    return sum((F.bit_count(F.col(f"f{i}").bitwiseXOR(F.lit(_signed(ps[i]))).bitwiseAND(F.lit(_signed(masks[i])))) for i in range(words) if masks[i]), F.lit(0))


def _choices(nodes: int, words: int, similarity: float, recall: float) -> list[list[int]]:
    """Random bit choices as masks of each word."""
    bits = max(10, int(math.log2(max(2, nodes))) - 2)
    number = math.ceil(math.log(1 / (1 - recall)) / (1 - differing_share(similarity)) ** bits)
    draw, out = np.random.default_rng(64), []
    for _ in range(number):
        at = draw.choice(64 * words, bits, replace=False)
        out.append([sum(1 << int(b % 64) for b in at if b // 64 == w) for w in range(words)])
    return out


def _keyed(choices: list[list[int]], words: int):
    """Rows of the table: for each choice of bits, the distances over them to KEY_PIVOTS pivots as one key."""

    def rows(batches):
        masks = np.array(choices, np.uint64)
        ps = np.array(pivots(KEY_PIVOTS * words), np.uint64).reshape(KEY_PIVOTS, words)
        for batch in batches:
            node = batch.column(0).to_numpy()
            f = np.stack([batch.column(1 + i).to_numpy() for i in range(words)], axis=1).view(np.uint64)
            away = f[:, None, :] ^ ps[None, :, :]
            for n, mask in enumerate(masks):
                key = np.full(len(f), n, np.uint64)
                for k in range(KEY_PIVOTS):
                    d = np.bitwise_count(away[:, k, :] & mask).sum(axis=1).astype(np.uint64)
                    key = key * np.uint64(_MIX[0]) + d  # distances and choice in one 64-bit number
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key.view(np.int64)), batch.column(1)], ["node", "key", "f0"])

    return rows


def _near(pairs: DataFrame, table: DataFrame, limit: int, similarity: float, words: int) -> DataFrame:
    """Pairs (u, v) within the bits, with their set sizes n and n2.

    Many pairs may have the same v: what is known of these is broadcast while it is small. The pairs are few
    beside the rows of the join that they come from, which is made once by writing them.
    """
    pairs = written(pairs, "met")
    names = [f"f{i}" for i in range(words)]
    whole = [f"c{k}" for k in range(WHOLE_PIVOTS)]
    seconds = written(pairs.select("v").distinct(), "seconds")
    of_v = table.join(seconds, F.col("node") == F.col("v"), "left_semi").select(F.col("node").alias("v"), F.col("n").alias("n2"), *[F.col(n).alias(f"g{i}") for i, n in enumerate(names)], *[F.col(c).alias(f"e{k}") for k, c in enumerate(whole)])
    far = F.greatest(*[F.abs(F.col(c) - F.col(f"e{k}")) for k, c in enumerate(whole)]) > limit
    sized = F.least("n", "n2") / F.greatest("n", "n2") >= similarity
    met = pairs.join(table.withColumnRenamed("node", "u"), "u").join(small(of_v, seconds.count(), 100), "v")
    return written(met.filter(sized & ~far & (_apart("f", "g", words) <= limit)).select("u", "v", "n", "n2"), "near")


def _alike(near: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of near pairs those whose shingle sets have the similarity; the sets of few v are broadcast, as above."""
    of_v = written(sets.join(near.select("v").distinct(), F.col("node") == F.col("v"), "left_semi").select(F.col("node").alias("v"), F.col("shingles").alias("b")), "sets_of_v")
    longs = of_v.agg(F.coalesce(F.sum(F.size("b") + 8), F.lit(0))).first()[0]
    checked = near.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(small(of_v, longs, 8), "v").withColumn("both", F.size(F.array_intersect("a", "b")))
    return written(checked.filter(F.col("both") / (F.col("n") + F.col("n2") - F.col("both")) >= similarity).select("u", "v"), "alike")


def _star_links(active: DataFrame, test) -> list[DataFrame]:
    """Links of the members of crowded keys (key, node) with leaders.

    In each round a key's leader is compared with all its members; those similar to it are linked to
    it and leave the rounds, as does the leader. A group of near copies so costs a row for each member,
    not for each pair. It goes on while a round takes at least one in ``STAR_YIELD`` of the members.
    """
    links, left = [], active.count()
    for n in range(STAR_ROUNDS):
        sizes = active.groupBy("key").agg(F.min_by("node", F.xxhash64("node", F.lit(n))).alias("v"), F.count("*").alias("members"))
        leaders = written(sizes.filter(F.col("members") > 1).select("key", "v"), "leaders")
        met = active.join(leaders, "key").withColumnRenamed("node", "u")
        found = test(met.filter("u <> v").select("u", "v").distinct())
        links.append(found)
        gone = met.join(found.withColumn("near", F.lit(True)), ["u", "v"], "left").filter("near or u = v").select("key", F.col("u").alias("node"))
        active = written(active.join(gone, ["key", "node"], "left_anti"), "active")
        before, left = left, active.count()
        if not left or (before - left) * STAR_YIELD < before:
            break
    return links


def _settle(links: list[DataFrame]) -> None:
    """Puts links of every node with the root of its component in the place of all links: they are fewer, and settle at once.

    The first of ``links`` is what it left the last time, or no link at all.
    """
    more = [x for x in links[1:] if not x.isEmpty()]
    links[1:] = []
    if more:
        roots = components(functools.reduce(DataFrame.unionByName, more, links[0]))
        links[0] = written(roots.filter("u <> root").select("u", F.col("root").alias("v")), "roots")


def _rooted(members: DataFrame, links: list[DataFrame]) -> DataFrame:
    """``members`` with the ``root`` of each node's component, by the links so far, which are settled."""
    _settle(links)
    found = small(links[0].select(F.col("u").alias("node"), F.col("v").alias("known")), links[0].count(), 32)
    return members.join(found, "node", "left").withColumn("root", F.coalesce("known", "node")).drop("known")


def _open(crowded: DataFrame) -> DataFrame:
    """(key, node, root): members of the keys that hold more than one component, with ``members`` of the key."""
    several = crowded.groupBy("key").agg(F.count("*").alias("members"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    return written(crowded.join(several.select("key", "members"), "key"), "open")


class _Search:
    """What all comparisons of one search need: the whole-width table, the texts, the limits."""

    def __init__(self, table: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float, words: int):
        self.table, self.nodes, self.docs, self.similarity, self.words = table, nodes, docs, similarity, words
        self.limit = most_bits(similarity, words)

    def sets(self, of: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes in ``of``."""
        wanted = written(self.nodes.select("node", "th").join(of.select("node").distinct(), "node", "left_semi").select("th"), "wanted")
        return written(_sets_of(wanted, self.docs), "sets")

    def test(self, sets: DataFrame):
        return lambda pairs: _alike(_near(pairs, self.table, self.limit, self.similarity, self.words), sets, self.similarity)

    def links(self, keyed: DataFrame, links: list[DataFrame], sets: DataFrame | None = None) -> DataFrame:
        """(key, node, f0), and the links known, to which more are added -> (key, node, root, members) of keys too large for a block."""
        shared = written(keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "shared")
        crowded = written(keyed.select("key", "node").join(shared.filter(F.col("members") > CROWD).select("key"), "key"), "crowded")
        crowds = not crowded.isEmpty()
        if crowds:
            of_crowds = self.sets(crowded) if sets is None else sets
            links += _star_links(crowded, self.test(of_crowds))
        few = _rooted(keyed.join(shared.filter(F.col("members") <= CROWD).select("key"), "key"), links)
        other = few.select("key", F.col("node").alias("v"), F.col("f0").alias("g0"), F.col("root").alias("root2"))
        # the first of the words alone discards nearly all pairs by chance before anything is gathered for them
        first = F.bit_count(F.col("f0").bitwiseXOR(F.col("g0"))) <= most_bits(self.similarity, 1, FIRST_SLACK)
        met = few.withColumnRenamed("node", "u").join(other, "key").filter((F.col("u") < F.col("v")) & (F.col("root") != F.col("root2")) & first).select("u", "v").distinct()
        near = _near(met, self.table, self.limit, self.similarity, self.words)
        if not near.isEmpty():
            links.append(_alike(near, self.sets(near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node")))) if sets is None else sets, self.similarity))
        if not crowds:
            return crowded.selectExpr("key", "node", "node as root", "0L as members")
        still = _open(_rooted(crowded, links))
        links.append(self.in_blocks(still.filter(F.col("members") <= CHUNK), of_crowds))
        return still.filter(F.col("members") > CHUNK)

    def in_blocks(self, members: DataFrame, sets: DataFrame) -> DataFrame:
        """(key, node, root) -> links between the components of each key; only links that connect come out.

        A key's largest component and its other members are cut into chunks of bounded members and
        shingles. Every two chunks are compared in a task, but for two of the largest component: first by
        bits, then, of members with a near one in another component, by their sets.
        """
        names = [f"f{i}" for i in range(self.words)]
        limit, similarity = self.limit, self.similarity

        def near_ones(f, n, root, i):
            at = np.flatnonzero((np.bitwise_count(f[:i] ^ f[i]).sum(axis=1) <= limit) & (root[:i] != root[i]))
            return at[np.minimum(n[at], n[i]) >= similarity * np.maximum(n[at], n[i])]

        def by_bits(block: pd.DataFrame) -> pd.DataFrame:
            f, n, root = block[names].to_numpy(np.int64).view(np.uint64), block["n"].to_numpy(), block["root"].to_numpy()
            able = np.zeros(len(f), bool)
            for i in range(1, len(f)):
                at = near_ones(f, n, root, i)
                able[at] = True
                able[i] |= len(at) > 0
            return block.loc[able, ["key", "a", "b", "node", "root"]]

        def by_sets(block: pd.DataFrame) -> pd.DataFrame:
            f, n, root = block[names].to_numpy(np.int64).view(np.uint64), block["n"].to_numpy(), block["root"].to_numpy()
            node, found, out = block["node"].to_numpy(), block["shingles"].to_list(), []
            up = {r: r for r in root.tolist()}

            def find(r):
                while up[r] != r:
                    up[r] = up[up[r]]
                    r = up[r]
                return r

            for i in range(1, len(f)):
                for j in near_ones(f, n, root, i).tolist():
                    a, b = find(int(root[i])), find(int(root[j]))
                    if a != b:
                        both = len(np.intersect1d(found[i], found[j], assume_unique=True))
                        if both / (n[i] + n[j] - both) >= similarity:
                            up[max(a, b)] = min(a, b)
                            out.append((node[i], node[j]))
            return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

        chunks = lambda members, shingles: F.ceil(F.greatest(members / CHUNK, shingles / CHUNK_SHINGLES)).cast("int")
        sized = members.select("key", "node", "root").join(self.table.select("node", "n"), "node")
        of_root = sized.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        of_key = of_root.groupBy("key").agg(F.max_by(F.struct("root", "c", "s"), F.struct("c", "root")).alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))
        one = chunks(F.col("c"), F.col("s")) == 1
        cut = written(of_key.select("key", F.when(~one, F.col("top.root")).alias("top"), F.when(one, 0).otherwise(chunks(F.col("top.c"), F.col("top.s"))).alias("own"), F.when(one, 1).otherwise(chunks(F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s"))).alias("others")), "chunks")
        in_top = F.coalesce(F.col("root") == F.col("top"), F.lit(False))
        at = F.when(in_top, F.pmod(F.xxhash64("node"), F.greatest("own", F.lit(1)))).otherwise(F.col("own") + F.pmod(F.xxhash64("node"), F.greatest("others", F.lit(1)))).cast("int")
        dealt = members.select("key", "node", "root").join(cut, "key").withColumn("chunk", at)
        tasks = dealt.withColumn("with", F.explode(F.sequence(F.when(in_top, F.col("own")).otherwise(0), F.col("own") + F.col("others") - 1))).select("key", F.least("chunk", "with").alias("a"), F.greatest("chunk", "with").alias("b"), "node", "root")
        prints = self.table.select("node", "n", *names)
        able = written(tasks.join(prints, "node").groupBy("key", "a", "b").applyInPandas(by_bits, "key long, a int, b int, node long, root long"), "able")
        return written(able.join(prints, "node").join(sets, "node").groupBy("key", "a", "b").applyInPandas(by_sets, "u long, v long"), "block_links")


def wide_links(nodes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(node, th, n, f0, f1, ...) from a written table -> links (u, v) of nodes with the least node of their near copies.

    They are the components of links. Every link is of two nodes whose shingle sets, made from the texts in ``docs``, have the similarity,
    and every two such nodes that share a key are connected.
    """
    names = [f"f{i}" for i in range(words)]
    whole = [_to_pivot(KEY_PIVOTS + k, [(1 << 64) - 1] * words, words).cast("short").alias(f"c{k}") for k in range(WHOLE_PIVOTS)]
    table = written(nodes.select("node", "n", *names, *whole), "pivots")
    keyed = written(nodes.select("node", *names).mapInArrow(_keyed(_choices(nodes.count(), words, similarity, recall), words), "node long, key long, f0 long"), "keys")
    search = _Search(table, nodes, docs, similarity, words)
    links = [table.selectExpr("node as u", "node as v").limit(0)]
    large = search.links(keyed, links)
    if not large.isEmpty():
        # alike in bits; the sets themselves tell who can be similar
        sets = search.sets(large)
        rare = written(_rare_shingles(large.select("node").distinct(), sets, similarity).join(table.select("node", "f0"), "node"), "prefixes")
        large = search.links(rare, links, sets)
        if not large.isEmpty():
            links.append(search.in_blocks(_open(_rooted(large.select("key", "node"), links)), sets))
    _settle(links)
    return links[0]


def _rare_shingles(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(key, node): for each node its rarest shingles among the nodes, so many that two similar sets share one of them."""
    every = sets.join(nodes, "node", "left_semi").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    often = every.groupBy("key").agg(F.count("*").alias("often"))
    in_order = Window.partitionBy("node").orderBy("often", "key")
    ranked = every.join(often, "key").withColumn("r", F.row_number().over(in_order))
    return ranked.filter((F.col("r") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1) & (F.col("often") > 1)).select("key", "node")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the least doc_id.

    Groups are connected by links between documents of at least ``similarity``; equal shingle
    sets are one node. Blank texts are near copies of one another. Rows that repeat a kept
    id with the same shingles stay; null ids stay only where a group has no other.
    """
    own = unused("id_", docs)
    with scratch_goes(docs.sparkSession) as keep:
        gone = keep(written(_gone(docs, similarity).withColumnRenamed("doc_id", own), "gone"))
    # texts are shuffled only where a large part of them goes
    return docs.join(small(gone, gone.count()), F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")


def _gone(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id) of the near copies that do not stay."""
    names = [f"f{i}" for i in range(WORDS)]
    prints = written(long_fingerprints(docs), "fingerprints")
    nodes = written(prints.groupBy("node", "n", *names).agg(F.min("doc_id").alias("first"), F.min("th").alias("th")), "nodes")
    roots = wide_links(nodes.select("node", "th", "n", *names), docs, similarity).withColumnRenamed("v", "root")
    linked = nodes.join(roots, F.col("node") == F.col("u"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    kept = linked.groupBy("root").agg(F.min_by(F.struct("first", "node"), F.struct(F.col("first").isNull(), F.col("first"), F.col("node"))).alias("k"))
    ids = kept.select(F.col("k.first").alias("kept")).distinct()
    return prints.select("doc_id").distinct().join(ids, F.col("doc_id").eqNullSafe(F.col("kept")), "left_anti")
