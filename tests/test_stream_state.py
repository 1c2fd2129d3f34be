"""Stateful streams: conversations, counters, panes, sketches and tables written exactly once."""

import random

import pytest
from pyspark.sql import functions as F

from sparkscreen.functions import text as T
from sparkscreen.operators import metrics as M
from sparkscreen.operators import stages as S
from sparkscreen.plans.pipeline import Pipeline
from sparkscreen.sources import requests as Q
from sparkscreen.streaming import assemble as SA
from sparkscreen.streaming import counters as SC
from sparkscreen.streaming import rates as SR
from sparkscreen.streaming import sinks as SS


class Feed:
    """A folder to which rows are added, and a stream over it with one micro-batch for each addition."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, str(path), schema

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def run(found, out, state, mode="append"):
    found.writeStream.outputMode(mode).format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination()


# ---- conversations ----

TURN = "conv_id long, turn long, role string, text string, at long"


def assembled(spark, feed, out, state):
    turns = feed.stream().withColumn("ts", F.timestamp_seconds("at"))
    run(SA.conversations_from_stream(turns, watermark="10 seconds", gap_seconds=60).select("conv_id", "part", "messages"), out, state)
    rows = spark.read.schema("conv_id long, part int, messages " + Q.MESSAGES).parquet(str(out)).collect()
    return {(r["conv_id"], r["part"]): [(m["role"], m["text"]) for m in r["messages"]] for r in rows}


def test_conversations_as_in_batch_with_late_turns_and_a_restart(spark, tmp_path):
    feed, out, state = Feed(spark, tmp_path / "in", TURN), tmp_path / "out", tmp_path / "state"
    first = [(1, 2, "assistant", "b", 1000), (1, 1, "user", None, 1001), (2, 1, "user", "x", 1002), (None, 1, "user", "nobody", 1002)]
    feed.add(first)
    feed.add([(1, None, "system", "a", 1003), (1, 3, None, "c", 1004)])
    assert assembled(spark, feed, out, state) == {}
    # a restart, with turns of an open conversation, and time that closes those of the start
    feed.add([(2, 2, "assistant", "y", 1050), (9, 1, "user", "later", 1085)])
    got = assembled(spark, feed, out, state)
    assert got == {(1, 1): [("system", "a"), ("user", ""), ("assistant", "b"), (None, "c")], (None, 1): [("user", "nobody")]}
    batch = Q.requests_from_turns(spark.createDataFrame(first + [(1, None, "system", "a", 1003), (1, 3, None, "c", 1004)], TURN)).filter("conv_id = 1").first()
    assert [(m["role"], m["text"]) for m in batch["messages"]] == got[1, 1]
    # late, but not later than the watermark: a further part; later than that: dropped
    feed.add([(1, 7, "user", "late", 1080), (1, 8, "user", "too late", 1001)])
    feed.add([(8, 1, "user", "much later", 5000)])
    got = assembled(spark, feed, out, state)
    assert got[1, 2] == [("user", "late")] and got[2, 1] == [("user", "x"), ("assistant", "y")] and got[9, 1] == [("user", "later")]
    assert set(got) == {(1, 1), (1, 2), (2, 1), (9, 1), (None, 1)}


# ---- counters ----

EVENT = "decision string, provider string, code string, total_redactions long, error_class string"


def made_events(n, seed=1):
    draw = random.Random(seed)
    pick = lambda *of: draw.choice((None, *of))
    return [(pick("allow", "block", "redact"), pick("openai", "azure", "new"), pick("toxicity", "custom"), pick(0, 2), pick("timeout")) for _ in range(n)]


@pytest.mark.parametrize("cuts", [(60,), (1, 30, 31, 59)])
def test_running_counters_equal_batch_after_any_cut(spark, tmp_path, cuts):
    rows = made_events(60)
    feed, path, state = Feed(spark, tmp_path / "in", EVENT), str(tmp_path / "series"), str(tmp_path / "state")
    for a, b in zip((0, *cuts), (*cuts, 60)):
        feed.add(rows[a:b] or rows[:0])
        SC.run_counters(feed.stream(), path, state).awaitTermination()  # a restart for each
    df = spark.createDataFrame(rows, EVENT)
    want = {(r["metric"], r["labels"]): r["value"] for r in SC.totals(df).collect()}
    series = SC.read_counters(spark, path)
    assert {(r["metric"], r["labels"]): r["v"] for r in series.groupBy("metric", "labels").agg(F.max_by("value", "batch").alias("v")).collect()} == want
    rose = SC.increase(series, "3650 days").groupBy("metric", "labels").agg(F.sum("increase").alias("n")).collect()
    assert {(r["metric"], r["labels"]): r["n"] for r in rose} == want
    plain = {(r["decision"], r["provider"]): r["requests"] for r in M.requests_total(df.filter("decision is not null")).collect()}
    assert sum(v for (m, _), v in want.items() if m == "requests_total") == sum(plain.values())
    assert want.get(("blocked_total", '{"code":"toxicity"}'), 0) == sum(r[0] == "block" and r[2] == "toxicity" for r in rows)


def test_rates_across_a_reset(spark):
    """10, 14, then a counter begun anew at 3, 8: it rose by 10 + 4 + 3 + 5."""
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    rows = [("m", "{}", v, at(s), b) for v, s, b in ((10, 0, 0), (14, 200, 1), (3, 400, 0), (8, 500, 1), (8, 700, 2))]
    df = spark.createDataFrame(rows, "metric string, labels string, value long, at string, batch long").withColumn("at", F.col("at").cast("timestamp"))
    got = [(r["increase"], round(r["rate"] * 300, 6)) for r in SC.increase(df).orderBy("window_start").collect()]
    assert got == [(14, 14.0), (8, 8.0), (0, 0.0)]


# ---- panes ----


@pytest.mark.parametrize("window,slide", [("5 minutes", "30 seconds"), ("1 minute", "1 minute"), ("50 seconds", "20 seconds"), ("90 seconds", "30 seconds")])
def test_panes_give_the_same_windows(spark, window, slide):
    draw = random.Random(3)
    df = spark.createDataFrame([(draw.choice((None, *range(0, 2000, 7))), draw.choice("ab")) for _ in range(400)], "at long, label string").withColumn("ts", F.timestamp_seconds("at"))
    plain = df.groupBy(F.window("ts", window, slide).alias("w"), "label").agg(F.count("*").alias("n")).select("w.start", "label", "n")
    got = M.window_rate(df, "ts", ["label"], window, slide).select("window_start", "label", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_only_panes_are_copied(spark):
    """Ten windows to an event, and no more rows than panes are given to all of them."""
    df = spark.range(20_000).select(F.timestamp_seconds(F.col("id") % 600).alias("ts"), F.lit("x").alias("label"))
    found = M.window_rate(df, "ts", ["label"], "5 minutes", "30 seconds")
    found.collect()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.rindex("Aggregate")  # below the copying there is an aggregation already


def test_late_rows_of_a_stream_are_missing_from_rates_only(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", "at long, decision string")
    feed.add([(t, "block") for t in range(1000, 1300, 10)])
    feed.add([(5000, "allow"), (1005, "block"), (4700, "allow")])  # of these the first two batches let all in
    feed.add([(5002, "allow")])  # a batch judges lateness by the watermark with which the one before it began
    feed.add([(1010, "block"), (5001, "allow"), (9000, "allow")])  # later than the watermark: 1010
    decided = feed.stream().withColumn("received_at", F.timestamp_seconds("at"))
    out = tmp_path / "out"
    run(SR.decision_rate(decided), out, tmp_path / "state")
    got = {(int(r["window_start"].timestamp()), r["decision"]): r["n"] for r in spark.read.parquet(str(out)).collect()}
    kept = [(t, "block") for t in range(1000, 1300, 10)] + [(5000, "allow"), (1005, "block"), (4700, "allow"), (5002, "allow"), (5001, "allow")]
    want = {}
    for t, d in kept:
        for k in range(10):
            start = t - t % 30 - 30 * k
            if start + 300 <= 9000 - 600:
                want[start, d] = want.get((start, d), 0) + 1
    assert got == want


# ---- sketches ----


def test_merged_sketches_keep_the_rank_error(spark):
    """100,000 skewed values with ties and nulls, in panes of half a minute, merged for hours and for all."""
    df = spark.range(100_000).select(F.timestamp_seconds(F.col("id") % 7200).alias("ts"), F.when(F.col("id") % 50 > 0, F.floor(F.exp(F.rand(5) * 9) * 4) / 4).alias("v"), (F.col("id") % 2).alias("label"))
    rows = df.select((F.unix_timestamp("ts") >= 3600).cast("int").alias("hour"), "label", "v").collect()
    stored = M.quantile_sketches(df, "v", "ts", ["label"])
    hours = M.merged_quantiles(stored, (0.5, 0.99), ["label"], "1 hour").collect()
    whole = M.merged_quantiles(stored, (0.5, 0.99)).collect()
    assert len(hours) == 4 and len(whole) == 1

    def held(values, r):
        values = sorted(v for v in values if v is not None)
        assert len(values) == r["n"]
        for q in (50, 99):
            less, most = sum(v < r[f"p{q}"] for v in values), sum(v <= r[f"p{q}"] for v in values)
            assert less <= (q / 100 + M.RANK_ERROR) * len(values) and most >= (q / 100 - M.RANK_ERROR) * len(values)

    for r in hours:
        held([x["v"] for x in rows if x["hour"] == int(r["window_start"].timestamp() >= 3600) and x["label"] == r["label"]], r)
    held([x["v"] for x in rows], whole[0])
    assert M.merged_quantiles(M.quantile_sketches(df.filter("v is null"), "v", "ts"), (0.5,), [], "1 hour").collect() == []


# ---- exactly once ----

BODY = "request_id string, body string"


def body(text, model='"m"'):
    return f'{{"model":{model},"messages":[{{"role":"user","content":"{text}"}}]}}'


def tables(spark, path):
    return {k: sorted((r["request_id"], r["batch"]) for r in SS.read_screened(spark, path, k).select("request_id", "batch").collect()) for k in (SS.FORWARDED, SS.BLOCKED, SS.REJECTED, SS.AUDIT)}


@pytest.mark.parametrize("after", ["rejected", "forwarded", "blocked", "audit"])
def test_a_batch_that_fails_half_way_leaves_no_doubles(spark, tmp_path, monkeypatch, after):
    """It fails before the table ``after`` of the second micro-batch is written."""
    feed, path = Feed(spark, tmp_path / "in", BODY), str(tmp_path / "out")
    feed.add([("a", body("fine")), ("b", body("scum")), ("c", "no json")])
    feed.add([("d", body("also fine")), ("e", body("SCUM")), ("f", body("x", "7")), ("g", body("mail a@b.org"))])
    words = Pipeline([S.PiiRedactor(), S.PolicyEngine([S.PolicyRule("w", ("scum",))])])
    real = SS._folder

    def failing(p, kind, number):
        if number == 1 and kind == after:
            raise RuntimeError("lost")
        return real(p, kind, number)

    monkeypatch.setattr(SS, "_folder", failing)
    with pytest.raises(Exception, match="lost"):
        SS.run_screening(feed.stream(), words, path, str(tmp_path / "state")).awaitTermination()
    monkeypatch.setattr(SS, "_folder", real)
    SS.run_screening(feed.stream(), words, path, str(tmp_path / "state")).awaitTermination()
    assert tables(spark, path) == {"forwarded": [("a", 0), ("d", 1), ("g", 1)], "blocked": [("b", 0), ("e", 1)], "rejected": [("c", 0), ("f", 1)], "audit": [("a", 0), ("b", 0), ("d", 1), ("e", 1), ("g", 1)]}
    forwarded = {r["request_id"]: r["t"] for r in SS.read_screened(spark, path, SS.FORWARDED).select("request_id", T.user_text(F.col("messages")).alias("t")).collect()}
    assert forwarded["g"] == "mail [EMAIL]"


def test_identities_made_here_are_one_in_all_tables(spark, tmp_path):
    feed, path = Feed(spark, tmp_path / "in", "body string"), str(tmp_path / "out")
    feed.add([(body(f"text {i}"),) for i in range(20)])
    SS.run_screening(feed.stream(), Pipeline.default(), path, str(tmp_path / "state")).awaitTermination()
    ids = [sorted(r["request_id"] for r in SS.read_screened(spark, path, k).collect()) for k in (SS.FORWARDED, SS.AUDIT)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 20
