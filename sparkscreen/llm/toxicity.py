"""Toxicity: maximum-scoring segments over token log-odds, with extreme-value calibration.

Fitting (on labelled rows whose crc32 of the id, modulo ``FOLDS``, is not 0):

1. Documents of each class are counted by the terms they hold: words, and word beginnings of
   ``PREFIXES`` letters, so that inflected words share evidence. A term's log-odds between the
   classes is smoothed by a Dirichlet prior in proportion to its count in both. A term must be
   toxic by ``LEAST_Z`` standard errors and after ``LEAST_CONTEXTS`` different words, so that the
   copies of one toxic document do not make its other words toxic.
2. A word's score is that of the longest term known for it; any other word costs ``DRIFT``.
3. On rows kept apart for it (remainder ``FOLDS - 1``), the best segment of clean documents is
   fitted to an extreme-value law in the document's length, and a logistic curve leads from the
   segments' evidence to a probability.

Scoring: the linear-time scan (Ruzzo and Tompa) finds every maximal scoring segment of a text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table, text_or_empty, written

FOLDS = 5
#: Bound of what is learnt from: labelled documents of each class. Words that a worker keeps scores of.
FIT_DOCS, CACHE_WORDS = 6_000, 200_000
PREFIXES, LEAST_DOCS, LEAST_Z, LEAST_CONTEXTS, PRIOR, DRIFT, P_VALUE = range(4, 11), 3, 3.0, 8, 50.0, 0.03, 0.05
PLAIN_Z, LEAST_BITS, MOST_BITS = 0.5, -5.0, 15.0
_EDGE = re.compile(r"^\W+|\W+$")


def terms(word: str) -> Iterator[str]:
    """The whole word, marked, then its beginnings from the longest."""
    yield word + "$"
    for k in reversed(PREFIXES):
        if k <= len(word):
            yield word[:k]


@dataclass
class Model:
    scores: dict[str, float]
    scale: float = 1.0  # lambda of the extreme-value law
    log_k: float = 0.0
    curve: tuple[float, ...] = (-2.0, 1.0, 0.0)
    cache: dict[str, float] = field(default_factory=dict, compare=False)

    def word_score(self, token: str) -> float:
        word = _EDGE.sub("", token.lower())
        found = next((self.scores[t] for t in terms(word) if t in self.scores), -DRIFT) if word else 0.0
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        self.cache[token] = found
        return found

    def segments(self, text: str) -> tuple[int, list[tuple[float, int, int]]]:
        """Words, and (score, first word, end word) of each maximal segment."""
        words, known = text.split(), self.cache
        at = [(i, s) for i, s in enumerate([known[w] if w in known else self.word_score(w) for w in words]) if s != -DRIFT]
        return len(words), maximal_segments(at)

    def bits(self, score: float, words: int) -> float:
        """Log-evidence of a segment: how far its score is beyond what a clean text of that length has."""
        return self.scale * score - self.log_k - math.log(words)

    def judge(self, text: str) -> tuple[float, list[tuple[float, int, int]]]:
        """Probability, and the significant segments."""
        n, found = self.segments(text)
        told = [(x, self.bits(x[0], n)) for x in found]
        top, significant = max((b for _, b in told), default=LEAST_BITS), [(x, b) for x, b in told if b > -math.log(P_VALUE)]
        z = float(np.dot(self.curve, (1.0, min(max(top, LEAST_BITS), MOST_BITS), math.log1p(sum(b for _, b in significant)))))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))), [x for x, _ in significant]

    def score(self, text: str) -> float:
        return self.judge(text)[0]


def maximal_segments(scored: list[tuple[int, float]]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments in linear time; positions left out score ``-DRIFT`` each."""
    kept: list[list[float]] = []  # start, end, sum before start, sum at end
    links: list[int] = []
    total, last = 0.0, 0
    for i, s in scored:
        total -= DRIFT * (i - last)
        last = i + 1
        before, total = total, total + s
        if s <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = links[j]
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                links.append(j)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3]]
            del kept[j:], links[j:]
    return [(d - c, int(a), int(b)) for a, b, c, d in kept]


def fold(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS, F.lit(0)).cast("int")


def _sampled(rows: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows of each class, by a hash of the id."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for label, n in sizes.items():
        keep = keep | ((F.col("toxic") == label) & (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, bound / n))))
    return rows.filter(keep)


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Fits on labelled rows outside fold 0. Without labels of both classes every score is 0.

    About ``fit_docs`` labelled documents of each class are counted and half as many are used for calibration, drawn by a
    hash of the id; the driver receives the toxic terms of these and two numbers for each of the latter. A document
    labelled more than once counts as toxic if any of its labels says so. Empty tables give a model that scores 0.
    """
    marks = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(fold() != 0)
    texts = docs.select(F.col("doc_id").alias("d"), text_or_empty("text").alias("text"))

    def drawn(rows: DataFrame, bound: int) -> DataFrame:
        """Texts of about ``bound`` labelled rows of each class; the ids are few by that bound, so documents stay where they are."""
        ids = written(_sampled(rows, bound), "sample")
        return texts.join(small(ids, ids.count()), F.col("d") == F.col("doc_id")).select("text", "toxic")

    counted, apart = drawn(marks.filter(fold() != FOLDS - 1), fit_docs), drawn(marks.filter(fold() == FOLDS - 1), fit_docs // 2)

    def count(batches):
        seen: dict[str, list[int]] = {}
        sizes = [0, 0, 0]
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sizes[toxic] += 1
                words = text.lower().split()
                for word, after in dict(zip(words, ["", *words])).items():
                    bit = (1 << zlib.crc32(after.encode()) % 63) * toxic
                    word = _EDGE.sub("", word)
                    for t in terms(word) if word else ():
                        at = seen.get(t)
                        if at is None:
                            at = seen[t] = [0, 0, 0, -1]
                        if at[3] != sizes[0] + sizes[1]:
                            at[toxic] += 1
                            at[3] = sizes[0] + sizes[1]
                        at[2] |= bit
        names, counts = ["", *seen], [sizes, *seen.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3))], ["term", "clean", "toxic", "contexts"])

    totals = counted.mapInArrow(count, "term string, clean long, toxic long, contexts long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.bit_count(F.bit_or("contexts")).alias("contexts"))
    totals = written(totals.filter(f"clean + toxic >= {LEAST_DOCS}"), "terms")
    size = totals.filter("term = ''").first()
    if size is None or not size["clean"] or not size["toxic"]:
        return Model({}, curve=(-20.0, 0.0, 0.0))
    n0, n1 = size["clean"], size["toxic"]
    share = (F.col("clean") + F.col("toxic")) / F.lit(float(n0 + n1))
    a0, a1 = F.col("clean") + PRIOR * share + 0.5, F.col("toxic") + PRIOR * share + 0.5
    odds = F.log(a1 / (F.lit(n1 + PRIOR + 1) - a1)) - F.log(a0 / (F.lit(n0 + PRIOR + 1) - a0))
    told = totals.filter("term <> ''").select("term", "contexts", odds.alias("odds"), (odds / F.sqrt(1 / a1 + 1 / a0)).alias("z"))
    strong = told.filter((F.col("z") >= LEAST_Z) & (F.col("odds") > 1) & (F.col("contexts") >= LEAST_CONTEXTS))
    scores = {r["term"]: r["odds"] for r in strong.collect()}
    heads = sorted({t[: PREFIXES[0]] for t in scores if not t.endswith("$")})
    if heads:
        # longer terms that begin like a strong one but lean to the clean side: they are not taken for their stem
        plain = told.filter(F.substring("term", 1, PREFIXES[0]).isin(heads) & (F.col("z") < PLAIN_Z))
        scores = {r["term"]: -DRIFT for r in plain.collect()} | scores
    model = Model(scores)
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            got = [cast.value.segments(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for n, _ in got], pa.int64()), pa.array([[s for s, _, _ in f] for _, f in got], pa.list_(pa.float64()))], ["toxic", "n", "segments"])

    sample = written(apart.mapInArrow(measure, "toxic int, n long, segments array<double>"), "segments")
    _calibrate(model, sample, {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()})
    return model


def _calibrate(model: Model, sample: DataFrame, sizes: dict[int, int]) -> None:
    """Extreme-value law from the sums of clean documents' segments, then the logistic curve by Newton steps."""
    clean = sample.filter("toxic = 0")
    tail = clean.select(F.explode("segments").alias("s")).agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.min("s").alias("least")).first()
    words = clean.agg(F.sum("n")).first()[0]
    if tail["n"] >= 10:
        model.scale = min(max(1 / max(1e-3, tail["mean"] - tail["least"]), 0.2), 3.0)
        model.log_k = math.log(tail["n"] / words) + model.scale * tail["least"]
    bits = F.transform("segments", lambda s: F.lit(model.scale) * s - model.log_k - F.log(F.greatest(F.col("n"), F.lit(1))))
    top = F.greatest(F.least(F.coalesce(F.array_max("bits"), F.lit(LEAST_BITS)), F.lit(MOST_BITS)), F.lit(LEAST_BITS))
    significant = F.aggregate(F.filter("bits", lambda b: b > -math.log(P_VALUE)), F.lit(0.0), lambda a, b: a + b)
    rows = sorted(map(tuple, sample.select("toxic", bits.alias("bits")).select("toxic", top, F.log1p(significant)).collect()))
    if len({r[0] for r in rows}) < 2:
        return
    x, y = np.array([(1.0, a, b) for _, a, b in rows]), np.array([t for t, _, _ in rows], float)
    weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (len(y) - y.sum()))
    weight /= weight.mean()
    w = np.array([-2.0, 0.5, 0.1])
    ridge = np.diag([1e-3, 0.05, 0.05])
    loss = lambda v: float(weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ v)) + v @ ridge @ v / 2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        while loss(w + step) > loss(w) and np.abs(step).max() > 1e-9:  # a whole step may overshoot
            step /= 2
        w += step
    model.curve = tuple(float(v) for v in w)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, passages: the significant segments as (score, first word, end word).

    Null and blank texts have no segment and get the lowest score. Repeated rows are scored alike. Texts
    are read whole, in linear time whatever their length; an empty table gives no rows.
    """
    cast = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = pa.list_(pa.struct([("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def apply(batches):
        for batch in batches:
            judged = [cast.value.judge(t) for t in batch.column(1).to_pylist()]
            scores = [p for p, _ in judged]
            passages = [[{"score": s, "start": a, "end": b} for s, a, b in found] for _, found in judged]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    return rows.mapInArrow(apply, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, passages array<struct<score: double, start: int, end: int>>")


def keep_clean(docs: DataFrame, model: Model, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``limit``."""
    cast = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def apply(batches):
        for batch in batches:
            keep = [cast.value.score(t or "") < limit for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(apply, docs.schema)


def op9_toxicity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
