"""Bodies, identities, rule files and versions, response bodies, audit streams: what no query has exercised so far."""

import time

import pytest
from pyspark.sql import functions as F

from sparkscreen import rules as R
from sparkscreen.operators import responses as RS
from sparkscreen.operators import stages as S
from sparkscreen.plans.pipeline import Pipeline
from sparkscreen.sources import audit as A
from sparkscreen.sources import requests as Q
from sparkscreen.streaming import rates as SR

BODY = '{"model":"m","messages":[{"role":"user","content":"%s"}]}'


def test_bodies_from_files_as_table_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(BODY % x for x in ("one", "two")) + "\nno json\n")
    good, bad = Q.quarantine(Q.parse_requests(Q.read_request_bodies(spark, str(tmp_path / "in"))))
    assert sorted(r["messages"][0]["text"] for r in good.collect()) == ["one", "two"] and [r["parse_error"] for r in bad.collect()] == ["body is not JSON"]
    stream = Q.parse_requests(Q.read_request_bodies(spark, str(tmp_path / "in"), stream=True)).drop("extra")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 3 and got.select("request_id").distinct().count() == 3


def test_identities_hold_when_an_input_is_read_again(spark, tmp_path):
    """Equal bodies have ids of their own; both halves of a quarantine, and every reading, give the same; a salt changes them."""
    spark.createDataFrame([(BODY % "same",)] * 5 + [("no json",)] * 2, "body string").repartition(3).write.parquet(str(tmp_path / "b"))
    ids = lambda df: sorted((r["request_id"], r["body"]) for r in df.select("request_id", "body").collect())
    read = lambda **o: Q.parse_requests(spark.read.parquet(str(tmp_path / "b")), **o)
    one = ids(read())
    good, bad = Q.quarantine(read())
    assert len({i for i, _ in one}) == 7 and sorted(ids(good) + ids(bad)) == one == ids(read().orderBy("body"))
    assert not {i for i, _ in one} & {i for i, _ in ids(read(salt="x"))}
    assert all(len(i) == 36 and i[14] == "3" and i[19] == "8" for i, _ in one)
    given = Q.parse_requests(spark.sql("select 'b' as body, 'mine' as request_id, timestamp'2024-01-01' as received_at")).first()
    assert given["request_id"] == "mine" and given["received_at"].year == 2024


def test_a_body_is_parsed_once(spark):
    """Also where rows are filtered by what came out of it."""
    good, _ = Q.quarantine(Q.parse_requests(spark.createDataFrame([(BODY % "x",)], "body string")))
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = good._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("parsejson") == 1, plan


@pytest.mark.parametrize("column", ["model", "Messages", "_x", "extra"])
def test_columns_that_would_be_overwritten_are_refused(spark, column):
    with pytest.raises(ValueError, match="rename"):
        Q.parse_requests(spark.createDataFrame([("x", "y")], f"body string, {column} string"))


def test_response_columns_are_refused_too(spark):
    df = spark.sql("select 'x' as body, false as stream, 'application/json' as content_type, 1 as total_redactions")
    with pytest.raises(ValueError, match="rename"):
        RS.redact_response_bodies(df, S.PiiRedactor())


def test_rule_files_and_versions(spark, tmp_path):
    path = tmp_path / "own.rules"
    path.write_text("# comment\n\n  (?i)alpha  \nbeta\n")
    assert [r.pattern for r in R.read_rules(spark, str(path), ["#no", "gamma"])] == ["(?i)alpha", "beta", "gamma"]
    built = []

    def make(text):
        built.append(text)
        return Pipeline([S.RegexInjection(R.parse_rules(text))])

    fresh, df = SR.FreshPipeline(str(path), make, keep=2), Q.requests_from_text(spark.createDataFrame([("Alpha",), ("delta",)], "text string"))
    blocked = lambda: sorted(r["text"] for r in fresh(spark).run(df).filter("decision = 'block'").collect())
    assert blocked() == ["Alpha"] and len(built) == 1
    first = fresh.version
    start = time.perf_counter()
    same = fresh(spark)
    assert time.perf_counter() - start < 0.3 and same is fresh(spark) and len(built) == 1
    path.write_text("delta\n# and more\n")
    assert blocked() == ["delta"] and len(built) == 2 and fresh.version != first
    path.write_text("# comment\n\n  (?i)alpha  \nbeta\n")
    assert blocked() == ["Alpha"] and len(built) == 2 and fresh.version == first  # known from before


def test_a_second_batch_with_unchanged_rules_builds_little(spark, tmp_path):
    """What its stages have built is kept, so running the pipeline again is a matter of tenths of a second."""
    df, p = Q.requests_from_text(spark.createDataFrame([("x",)], "text string")), Pipeline.default()
    p.run(df)
    kept = p.stages[1]._kept["prepare"][2]
    start = time.perf_counter()
    p.run(df)
    assert time.perf_counter() - start < 1.5 and p.stages[1]._kept["prepare"][2] is kept
    p.stages[1].action = "block"  # other settings: built anew
    assert p.run(Q.requests_from_text(spark.createDataFrame([("a@b.org",)], "text string"))).first()["decision"] == "block"


def test_audit_records_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}") for i in range(4)], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    made = A.audit_records(Pipeline.default().run(Q.requests_from_text(stream).withColumns({"request_id": F.col("id").cast("string"), "received_at": F.timestamp_seconds(F.col("id") * 86_400)})))
    for _ in range(2):  # again with the same checkpoint: nothing twice
        A.stream_audit(made, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = A.read_audit(spark, str(tmp_path / "out")).collect()
    assert sorted(r["request_id"] for r in rows) == ["0", "1", "2", "3"] and len(list((tmp_path / "out").glob("date=*"))) == 4
