"""The pipeline and its rates over streams.

Deciding is stateless, so ``Pipeline.run`` applies to a stream as it is. Rates are windowed counts with
a watermark: rows later than it are missing from rates, never from the audit sink.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import window_rate
from ..plans.pipeline import Pipeline

WATERMARK, WINDOW, SLIDE, SECONDS = "10 minutes", "5 minutes", "30 seconds", 300


def decided_stream(requests: DataFrame, pipeline: Pipeline) -> DataFrame:
    return pipeline.run(requests)


def rate(stream: DataFrame, ts_col: str, labels: Sequence[str], window: str = WINDOW, slide: str | None = SLIDE, watermark: str = WATERMARK) -> DataFrame:
    return window_rate(stream.withWatermark(ts_col, watermark), ts_col, labels, window, slide, SECONDS)


def decision_rate(decided: DataFrame, ts_col: str = "received_at", **options) -> DataFrame:
    return rate(decided, ts_col, ["decision"], **options)


def block_rate(decided: DataFrame, ts_col: str = "received_at", **options) -> DataFrame:
    return rate(decided.filter("decision = 'block'"), ts_col, ["code"], **options)


def redaction_rate(decided: DataFrame, ts_col: str = "received_at", **options) -> DataFrame:
    return rate(decided.filter("decision = 'redact'"), ts_col, [], **options)


def response_redaction_rate(responses: DataFrame, ts_col: str = "received_at", **options) -> DataFrame:
    return rate(responses.filter("total_redactions > 0"), ts_col, [], **options)


def error_rate(log: DataFrame, class_col: str, ts_col: str = "received_at", **options) -> DataFrame:
    return rate(log.withColumnRenamed(class_col, "error_class"), ts_col, ["error_class"], **options)


def latency_quantiles(log: DataFrame, value_col: str, quantiles: Sequence[float] = (0.5, 0.95, 0.99), ts_col: str = "received_at", labels: Sequence[str] = (), window: str = WINDOW, slide: str | None = SLIDE, watermark: str = WATERMARK) -> DataFrame:
    """Approximate quantiles of a latency for each window and label set."""
    by = F.window(ts_col, window, slide) if slide else F.window(ts_col, window)
    got = log.withWatermark(ts_col, watermark).groupBy(by.alias("w"), *labels).agg(F.percentile_approx(value_col, list(quantiles), 10_000).alias("q"))
    return got.select(F.col("w.start").alias("window_start"), *labels, *[F.element_at("q", i + 1).alias(f"p{round(q * 100)}") for i, q in enumerate(quantiles)])


def stage_latency_p99(log: DataFrame, value_col: str, stage_col: str = "stage", **options) -> DataFrame:
    return latency_quantiles(log.withColumnRenamed(stage_col, "stage"), value_col, (0.99,), labels=["stage"], **options)


class FreshPipeline:
    """The pipeline of a rule file as it is now: read anew when the file has changed, built anew when its text has.

    ``make`` makes a pipeline of the file's text. ``version`` is the digest of the text that the last call gave
    the pipeline of. Up to ``keep`` versions are kept with all that their stages have built, so a micro-batch with
    rules that were seen before builds nothing.
    """

    def __init__(self, path: str, make: Callable[[str], Pipeline], keep: int = 8):
        self.path, self.make, self.keep = path, make, keep
        self.version: str | None = None
        self._status, self._known = None, {}

    def __call__(self, spark: SparkSession) -> Pipeline:
        file = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        found = file.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(file)
        status = (found.getModificationTime(), found.getLen())
        if status != self._status:
            text = "\n".join(r[0] for r in spark.read.text(self.path, wholetext=True).collect())
            version = hashlib.sha256(text.encode()).hexdigest()
            if version not in self._known:
                self._known[version] = self.make(text)
                while len(self._known) > self.keep:
                    self._known.pop(next(iter(self._known)))
            self.version, self._status = version, status
        return self._known[self.version]


def run_with_fresh_rules(spark: SparkSession, requests: DataFrame, pipeline: Callable[[SparkSession], Pipeline], sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Asks for the pipeline at the start of every micro-batch: new rows meet new rules, a batch under way keeps its own.

    ``pipeline`` may build one each time, or be a ``FreshPipeline``, which keeps those of rules that have not changed.
    """

    def batch(df: DataFrame, number: int) -> None:
        sink(pipeline(df.sparkSession).run(df), number)

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
