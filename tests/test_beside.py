"""System prompts beside the messages, recorded responses, native scorers that fail."""

import json

import pytest
from pyspark.sql import functions as F

from sparkscreen.operators import responses as RS
from sparkscreen.operators import stages as S
from sparkscreen.plans.pipeline import Pipeline
from sparkscreen.sources import requests as Q


def parsed(spark, bodies, **options):
    rows = [(str(i), p, json.dumps(b)) for i, (p, b) in enumerate(bodies)]
    df = spark.createDataFrame(rows, "request_id string, path string, body string")
    return Q.parse_requests(df, path_col="path", **options)


def asked(**more):
    return {"model": "m", "messages": [{"role": "user", "content": "hi"}]} | more


def roles_and_extra(df):
    got = df.select("request_id", F.transform("messages", lambda m: m["role"]).alias("roles"), F.map_keys("extra").alias("extra"), "parse_error").collect()
    return {r["request_id"]: (r["roles"], sorted(r["extra"]), r["parse_error"]) for r in got}


def test_system_is_prepended_where_asked_for(spark):
    bodies = [("/v1/messages", asked(system="s")), ("/v1/chat", asked(system="s")), ("/v1/messages", asked(system={"a": 1})), ("/v1/messages", asked(system=None)), ("/v1/messages", asked(system=[])), ("/v1/messages", asked())]
    got = roles_and_extra(parsed(spark, bodies, prepend_system=True))
    plain = ["user"]
    assert got == {"0": (["system", *plain], [], None), "1": (plain, ["system"], None), "2": (plain, ["system"], None), "3": (plain, ["system"], None), "4": (["system", *plain], [], None), "5": (plain, [], None)}
    assert roles_and_extra(parsed(spark, bodies[:1]))["0"] == (plain, ["system"], None)


def test_a_bad_body_stays_bad_with_a_system(spark):
    r = parsed(spark, [("/v1/messages", {"model": "m", "system": "s", "messages": 7})], prepend_system=True).first()
    assert r["parse_error"] == "'messages' must be an array" and r["messages"] is None


@pytest.mark.parametrize("system", ["s", [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]])
def test_system_goes_back_beside_the_messages(spark, system):
    df = parsed(spark, [("/v1/messages", asked(system=system, top_k=3))], prepend_system=True)
    at = [F.col(c) for c in ("model", "stream", "messages", "extra")]
    back, inside = df.select(Q.serialize_request(*at, F.lit(True)), Q.serialize_request(*at)).first()
    assert json.loads(back) == asked(system=system, top_k=3, stream=False)
    assert [m["role"] for m in json.loads(inside)["messages"]] == ["system", "user"] and "system" not in json.loads(inside)


def test_recorded_responses_with_bad_lines(spark, tmp_path):
    body = json.dumps({"choices": [{"message": {"role": "assistant", "content": "mail a.b@example.org"}}]})
    lines = [json.dumps({"request_id": "1", "stream": False, "content_type": "application/json", "body": body}), "no json", json.dumps({"request_id": "3", "body": body}), ""]
    (tmp_path / "r.json").write_text("\n".join(lines))
    got = RS.redact_response_bodies(RS.read_response_bodies(spark, f"file://{tmp_path}"), S.PiiRedactor()).collect()
    assert sorted((r["request_id"] or "", r["total_redactions"]) for r in got) == [("", 0), ("1", 1), ("3", 0)]
    assert RS.read_response_bodies(spark, f"file://{tmp_path}", stream=True).isStreaming


@pytest.mark.parametrize("scorer", [lambda t: 1 / (F.length(t) % 2), lambda t: t.cast("double"), lambda t: F.element_at(F.array(F.lit(1.0)), F.length(t))])
@pytest.mark.parametrize("on_error, decision", [("allow", "allow"), ("block", "block")])
def test_native_scorers_that_raise(spark, scorer, on_error, decision):
    df = Q.requests_from_text(spark.createDataFrame([("ab",)], "text string"))
    before = spark.conf.get("spark.sql.ansi.enabled")
    ran = Pipeline([S.ScoreStage(scorer, 0.5, "c", "C", on_error=on_error)]).run(df)
    assert spark.conf.get("spark.sql.ansi.enabled") == before
    assert ran.first()["decision"] == decision


def test_other_columns_keep_their_rules(spark):
    df = spark.createDataFrame([("ab",)], "text string").withColumn("n", F.col("text").cast("int"))
    ran = Pipeline([S.ScoreStage(lambda t: t.cast("double"), 0.5, "c", "C")]).run(Q.requests_from_text(df))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ran.collect()
