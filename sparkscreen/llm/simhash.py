"""SimHash near-dedup with pivot distance tables.

A fingerprint's table row holds its Hamming distances to reference fingerprints (pivots): over all
64 bits, and over every choice of ``blocks - bits`` of ``blocks`` bit blocks. Two fingerprints that
differ in at most ``bits`` bits agree on one such choice, so there all their coordinates are equal:
that equality is the join key. Of the pairs it gives, those whose whole-width coordinates differ by
more than ``bits`` anywhere are discarded, and the rest is verified bit by bit.

A crowded key (more than ``crowd`` different fingerprints) is not paired up. Its members take
another exact way: two fingerprints are at most two bits apart if they share a neighbour at one bit,
so each is listed under its 65 neighbours, and members of one list are linked to its first.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty, written
from .components import components

WIDTH, SEED, BITS, BLOCKS, KEY_PIVOTS, WHOLE_PIVOTS, CROWD = 3, 42, 2, 4, 9, 6, 32
_BATCH_SHINGLES = 1 << 18


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int) -> list[int]:
    return [xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 7) for i in range(n)]


def shingle_hashes(text: str, width: int = WIDTH, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle of the lower-cased (A-Z) text; fewer words than ``width`` are one shingle."""
    words = text.encode().lower().split()  # of bytes: A-Z, and the six ASCII white-space bytes
    if not words:
        return []
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    joined, lengths = b" ".join(words), list(map(len, words))
    ends = list(itertools.accumulate(n + 1 for n in lengths))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :])]


def simhash(hashes: list[int]) -> int:
    """Bit i is 1 if more than half of the hashes have it."""
    if not hashes:
        return 0
    counts, h = np.zeros(64, np.int64), np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(h), _BATCH_SHINGLES):
        counts += np.unpackbits(h[at : at + _BATCH_SHINGLES], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a long). Null and blank texts have fingerprint zero."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def compute(batches):
        for batch in batches:
            fps = [_signed(simhash(shingle_hashes(t, width))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return rows.mapInArrow(compute, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _distance(a: Column, pivot: int, mask: int = (1 << 64) - 1) -> Column:
    return F.bit_count(a.bitwiseXOR(F.lit(_signed(pivot))).bitwiseAND(F.lit(_signed(mask))))


def distance_table(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """(fp) -> key, fp, c0, c1, ...: one row for each choice of blocks."""
    if not bits < blocks <= 8:
        raise ValueError("take more blocks than bits, eight at most")
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    fp, keys = F.col("fp"), []
    for n, choice in enumerate(itertools.combinations(masks, blocks - bits)):
        key = F.lit(n).cast("long")
        for p in pivots(KEY_PIVOTS):
            key = F.shiftleft(key, 6).bitwiseOR(_distance(fp, p, sum(choice)).cast("long"))
        keys.append(key)
    whole = {f"c{i}": _distance(fp, p).cast("byte") for i, p in enumerate(pivots(KEY_PIVOTS + WHOLE_PIVOTS)[KEY_PIVOTS:])}
    return fps.select("fp", *[c.alias(k) for k, c in whole.items()], F.explode(F.array(*keys)).alias("key"))


def close_links(fps: DataFrame, bits: int = BITS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Distinct fps -> links (u, v): enough of the pairs within ``bits`` bits to connect all of them."""
    if bits > 2:
        raise ValueError("at most two bits: the way for crowded keys is exact up to two")
    rows = written(distance_table(fps, bits, blocks), "distances")
    coords = [f"c{i}" for i in range(WHOLE_PIVOTS)]
    sizes = rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    shared = rows.join(sizes, "key")
    few = shared.filter(F.col("members") <= crowd).select("key", "fp", *coords)
    other = few.select("key", F.col("fp").alias("fp2"), *[F.col(c).alias(f"{c}_2") for c in coords])
    near = F.greatest(*[F.abs(F.col(c).cast("int") - F.col(f"{c}_2")) for c in coords]) <= bits
    pairs = few.join(other, "key").filter((F.col("fp") < F.col("fp2")) & near & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= bits))
    crowded = shared.filter(F.col("members") > crowd).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    listed = crowded.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("near"))
    # at most 65 fingerprints can be listed under one neighbour
    stars = listed.groupBy("near").agg(F.collect_list("fp").alias("m")).filter(F.size("m") > 1).select(F.explode("m").alias("u"), F.array_min("m").alias("v")).filter("u <> v")
    if bits < 2:
        stars = stars.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)
    return pairs.select(F.col("fp").alias("u"), F.col("fp2").alias("v")).unionByName(stars)


def near_components(docs_fp: DataFrame, bits: int = BITS, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp), read from a written table -> doc_id, fp, component_id.

    Equal fingerprints are one node, so copies are never paired. component_id is the least doc_id
    that links lead to; null ids count only where a component has no other.
    """
    fps = docs_fp.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(close_links(fps.select("fp"), bits, blocks, crowd))
    linked = fps.join(roots, F.col("fp") == F.col("u")).select("fp", "root", "first")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    known = linked.join(least, "root").select(F.col("fp").alias("f"), "least")
    # written, so that the join below is one of two plain shuffles, whose hot fingerprints Spark can split
    ids = written(fps.join(known, F.col("fp") == F.col("f"), "left").select(F.col("fp").alias("g"), F.coalesce("least", "first").alias("component_id")), "ids")
    return docs_fp.join(ids, F.col("fp") == F.col("g")).select("doc_id", "fp", "component_id")


def op4_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs_fp = written(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    found = near_components(docs_fp)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
