"""Removal of word windows that stand more than once, by level-wise doubling.

A window is ``words`` consecutive words of one text. Half windows that repeat at one length are
extended to twice that length, the rest is given up:

1. Lengths 1, 2, 4, ... up to half a window are hashed for each place by doubling, within the text.
2. Of the half windows within a window one is its anchor: that with the least hash. Equal windows have
   equal anchors, so only anchors are counted over all texts (about one place in ten for 35 words).
   Whole copies of a text are counted as one text with its number.
3. Windows whose anchor repeats are candidates. Their texts are gathered once, in chunks, and their
   128-bit hashes made from those of the two halves. Chunks send each hash once, dealt by its bits, and
   hear back which of theirs stand elsewhere: a bit for each.
4. Words that such windows cover are removed. Texts without candidates are never shuffled but for the
   one join that finds the texts to gather.

Half windows are told apart by 64 bits and windows by 128; so only windows alike in all but a few
words can be taken for equal, with a probability of 2 ** -64 for each such pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_hot, table, text_or_empty, written

WORDS, BUCKET_HASHES, CACHED_WORDS, CHUNK_BYTES = 35, 1 << 20, 1 << 18, 4 << 20
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S29, _S32 = np.uint64(29), np.uint64(32)


class WordHashes(dict):
    """Hash of each word, kept for words seen before; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def _mixed(a: np.ndarray, b: np.ndarray, lane: int = 0) -> np.ndarray:
    x = a * _K1 + (b ^ (b >> _S29)) * (_K2 + np.uint64(2 * lane))
    x ^= x >> _S32
    x *= _K3
    return x ^ (x >> _S29)


def _doubled(h: np.ndarray, now: int, length: int) -> np.ndarray:
    """Hashes of windows of ``length`` from those of ``now`` words: twice as long each time, the last time overlapping."""
    while now < length:
        step = min(now, length - now)
        h = _mixed(h[:-step], h[step:])
        now += step
    return h


def half_windows(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of the half windows, ceil(words / 2) words long, at each place that has one."""
    return _doubled(hashes, 1, -(-words // 2))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive ones."""
    now = 1
    while now < width:
        step = min(now, width - now)
        h = np.minimum(h[:-step], h[step:])
        now += step
    return h


def anchors(halves: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the least half window's hash; and which places are such for one of the windows."""
    width = words // 2 + 1  # half windows in a window
    least = _least(halves, width)
    # a place is chosen if it is as small as the least of some window that holds it
    most = ~_least(~np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]), width)
    return least, most == halves


def whole_windows(halves: np.ndarray, words: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, in two parts, of the windows at the given places."""
    a, b = halves[at], halves[at + words // 2]
    return _mixed(a, b), _mixed(b, a, 1)


def _hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


_IDENTITY = ["t1", "t2"]


def _identity(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2"))


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, t1, t2, n_words, kept (SHA-256 of all words), single and double: anchors that stand once, or more often, in the text."""

    def each(batches):
        cache = WordHashes()
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                own = text.encode().split()
                once, more = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(own) >= words:
                    halves = half_windows(_hashes(own, cache), words)
                    found, n = np.unique(halves[anchors(halves, words)[1]], return_counts=True)
                    once, more = found[n == 1].view(np.int64), found[n > 1].view(np.int64)
                rows.append((len(own), hashlib.sha256(b" ".join(own)).hexdigest(), once, more))
            n, kept, once, more = zip(*rows) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", *_IDENTITY)], pa.array(n, pa.int64()), pa.array(kept, pa.string()), *[pa.array(x, pa.list_(pa.int64())) for x in (once, more)]], ["doc_id", *_IDENTITY, "n_words", "kept", "once", "more"])

    return docs.mapInArrow(each, f"doc_id {dict(docs.dtypes)['doc_id']}, t1 long, t2 long, n_words long, kept string, once array<long>, more array<long>")


def _candidates(scanned: DataFrame, words: int) -> DataFrame:
    """t1, t2, all_repeat, hs: the texts with windows that may repeat, and their anchors that do (null: all, as the text stands twice)."""
    texts = written(scanned.filter(F.col("n_words") >= words).groupBy(*_IDENTITY).agg(F.count("*").alias("copies"), F.first("once").alias("once"), F.first("more").alias("more")), "texts")
    anchor = lambda column, n: texts.select(*_IDENTITY, F.explode(column).alias("h"), n.alias("n"))
    once = anchor("once", F.col("copies"))
    counts = once.unionByName(anchor("more", F.col("copies") * 2)).groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).filter("n > 1")
    counts = written(counts, "anchors")
    single = texts.filter("copies = 1")
    own = single.select(*_IDENTITY, F.explode(F.concat("once", "more")).alias("h"))
    total = own.count()
    met = join_hot(own, counts.select("h", "rows"), ["h"], "rows", max(1, total)).groupBy(*_IDENTITY).agg(F.collect_list("h").alias("hs"))
    copied = texts.filter("copies > 1").select(*_IDENTITY, F.lit(True).alias("copied"), F.lit(None).cast("array<long>").alias("hs"))
    found = written(met.select(*_IDENTITY, F.lit(False).alias("copied"), "hs").unionByName(copied), "candidates")
    discard(texts, counts)
    return found


_TEXTS = "array<struct<t1: long, t2: long, copied: boolean, text: string, at: binary>>"


def _chunks(docs: DataFrame, candidates: DataFrame, words: int) -> DataFrame:
    """chunk, n (windows), texts: the texts of the candidates with the places of their windows, some MB together."""
    # a text stands once, however many copies it has
    texts = docs.groupBy(*_IDENTITY).agg(F.first("text").alias("text"))
    met = texts.join(candidates, _IDENTITY).select(*_IDENTITY, "copied", "text", "hs")
    item = pa.struct([("t1", pa.int64()), ("t2", pa.int64()), ("copied", pa.bool_()), ("text", pa.string()), ("at", pa.binary())])
    schema = pa.schema([("chunk", pa.string()), ("n", pa.int64()), ("texts", pa.list_(item))])

    def gathered(batches):
        cache, held, size, n = WordHashes(), [], 0, 0
        for batch in batches:
            for x in batch.to_pylist():
                halves = half_windows(_hashes(x["text"].encode().split(), cache), words)
                count = len(halves) - words // 2
                if x["copied"]:
                    at = np.arange(count)
                else:
                    at = np.flatnonzero(np.isin(anchors(halves, words)[0], np.array(x["hs"], np.int64).view(np.uint64)))
                held.append({"t1": x["t1"], "t2": x["t2"], "copied": x["copied"], "text": x["text"], "at": at.astype("<u4").tobytes()})
                size, n = size + len(x["text"]) + 4 * len(at), n + len(at)
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_pylist([{"chunk": f"{held[0]['t1']} {held[0]['t2']}", "n": n, "texts": held}], schema)
                    held, size, n = [], 0, 0
        if held:
            yield pa.RecordBatch.from_pylist([{"chunk": f"{held[0]['t1']} {held[0]['t2']}", "n": n, "texts": held}], schema)

    return written(met.mapInArrow(gathered, f"chunk string, n long, texts {_TEXTS}"), "chunks")


def _chunk_windows(texts: list[dict], words: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of a chunk: the two parts of the hash, and whether it is a window of a text that stands twice."""
    parts, copied = [], []
    for x in texts:
        at = np.frombuffer(x["at"], "<u4").astype(np.int64)
        parts.append(whole_windows(half_windows(_hashes(x["text"].encode().split(), cache), words), words, at))
        copied.append(np.full(len(at), x["copied"]))
    a, b = (np.concatenate(p) for p in zip(*parts))
    return a, b, np.concatenate(copied)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the pairs, which of the ordered begin a group of equal ones, and each ordered one's group."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    begins = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return order, begins, np.cumsum(begins) - 1


def _sent(a: np.ndarray, b: np.ndarray, copied: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Each window hash of a chunk once, in order, whether the chunk itself holds it twice, and its bucket."""
    order, begins, group = _distinct(a, b)
    twice = np.bincount(group, 1 + copied[order]) > 1 if len(a) else np.zeros(0, bool)
    first = a[order][begins]
    return order, group, first, b[order][begins], twice, ((first >> _S32) * np.uint64(buckets)) >> _S32


def _answers(chunks: DataFrame, buckets: int, words: int) -> DataFrame:
    """chunk, bits: for each window hash that a chunk holds, bucket by bucket in order, whether it stands more than once anywhere."""

    def messages(batches):
        cache = WordHashes()
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                _, _, first, second, twice, bucket = _sent(*_chunk_windows(x["texts"], words, cache), buckets)
                edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                some = [(k, s, e) for k, (s, e) in enumerate(zip(edges, edges[1:])) if s < e]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in some], pa.int32()), pa.array([x["chunk"]] * len(some), pa.string()), *[pa.array([f(s, e) for _, s, e in some], pa.binary()) for f in (lambda s, e: first[s:e].tobytes(), lambda s, e: second[s:e].tobytes(), lambda s, e: np.packbits(twice[s:e]).tobytes())]], ["bucket", "chunk", "a", "b", "twice"])

    def compared(t: pa.Table) -> pa.Table:
        a, b = (np.frombuffer(b"".join(t[c].to_pylist()), np.uint64) for c in ("a", "b"))
        sizes = [len(x) // 8 for x in t["a"].to_pylist()]
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t["twice"].to_pylist(), sizes)])
        order, _, group = _distinct(a, b)
        repeats = np.zeros(len(a), bool)
        repeats[order] = (np.bincount(group, 1 + twice[order]) > 1)[group]
        ends = np.cumsum(sizes)
        bits = [np.packbits(repeats[e - n : e]).tobytes() for e, n in zip(ends, sizes)]
        return pa.table({"chunk": t["chunk"], "bucket": t["bucket"], "n": pa.array(sizes, pa.int32()), "bits": pa.array(bits, pa.binary())})

    sent = chunks.mapInArrow(messages, "bucket int, chunk string, a binary, b binary, twice binary")
    heard = sent.groupBy("bucket").applyInArrow(compared, "chunk string, bucket int, n int, bits binary")
    # a chunk has one answer from each bucket
    return written(heard.groupBy(F.col("chunk").alias("of_chunk")).agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("answers")), "answers")


def _removed(chunks: DataFrame, answers: DataFrame, buckets: int, words: int) -> DataFrame:
    """t1, t2, removed, gone, left: for each text that loses words, how many, their places as (start, end) and the SHA-256 of the others."""

    def each(batches):
        cache = WordHashes()
        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                order, group, *_ = _sent(*_chunk_windows(x["texts"], words, cache), buckets)
                told = sorted(x["answers"], key=lambda m: m["bucket"])
                bits = np.concatenate([np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=m["n"]) for m in told]).astype(bool)
                repeats = np.zeros(len(order), bool)
                repeats[order] = bits[group]
                rows, done = [], 0
                for y in x["texts"]:
                    at = np.frombuffer(y["at"], "<u4").astype(np.int64)
                    at, done = at[repeats[done : done + len(at)]], done + len(at)
                    if len(at):
                        own = y["text"].encode().split()
                        starts = at[np.concatenate([[True], at[1:] > at[:-1] + words])]
                        ends = at[np.concatenate([at[1:] > at[:-1] + words, [True]])] + words
                        kept = [w for s, e in zip([0, *ends], [*starts, len(own)]) for w in own[s:e]]
                        rows.append((y["t1"], y["t2"], len(own) - len(kept), [{"start": int(s), "end": int(e)} for s, e in zip(starts, ends)], hashlib.sha256(b" ".join(kept)).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("removed", pa.int64()), ("gone", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("left", pa.string())])
    joined = chunks.join(answers, F.col("chunk") == F.col("of_chunk")).select("texts", "answers")
    return joined.mapInArrow(each, "t1 long, t2 long, removed long, gone array<struct<start: long, end: long>>, left string")


def repeated_words(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of ``docs``: doc_id, n_words, n_removed, gone (removed words as (start, end) from 0), kept_sha256.

    Words are what stands between ASCII white space, unchanged. A word goes if a window of ``words`` words over it stands
    anywhere else too, in this or another row; rows equal in id and text are two rows. A null text has no words, like an
    empty one; texts shorter than a window lose nothing. An empty table gives no rows. Texts may be of any length that fits
    a task; no other column is looked at.
    """
    if words < 2:
        raise ValueError("windows of two words or more")
    own = _identity(docs, id_col, text_col)
    scanned = written(_scan(own, words), "scanned")
    candidates = _candidates(scanned, words)
    chunks = _chunks(own, candidates, words)
    buckets = max(1, -(-(chunks.agg(F.sum("n")).first()[0] or 0) // BUCKET_HASHES))
    answers = _answers(chunks, buckets, words)
    removed = written(_removed(chunks, answers, buckets, words), "removed")
    discard(candidates, chunks, answers)
    copies = written(scanned.groupBy(*_IDENTITY).agg(F.count("*").alias("copies")).join(removed, _IDENTITY, "left"), "found")
    discard(removed)
    rows = scanned.select("doc_id", *_IDENTITY, "n_words", "kept")
    total = scanned.count()
    told = join_hot(rows, copies, _IDENTITY, "copies", max(1, total))
    gone = F.coalesce("gone", F.array().cast("array<struct<start: long, end: long>>"))
    return told.select("doc_id", "n_words", F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"), gone.alias("gone"), F.coalesce("left", "kept").alias("kept_sha256"))


def op13_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 35 words over all documents."""
    return repeated_words(table(spark, sf_dir, "documents")).drop("gone")
