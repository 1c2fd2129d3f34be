"""Registered queries of files read and written: bodies, rule files, recorded responses, audit streams; and of failing native scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _DECIDED, _ERROR, _KIND, _REDACTOR, _TURN_SQL, _audited, _bodies, _response_bodies, _t, query
from .catalog_streams import run_in_batches
from .functions import text as T
from .operators import responses as RS
from .operators import stages as S
from .operators import tuning as TU
from .plans.pipeline import Pipeline
from .rules import all_matches, read_rules
from .sources import audit as A
from .sources import requests as Q
from .sources.shared import scratch_path


@query(f"WITH d AS (SELECT doc_id, {_KIND} AS kind FROM documents), e AS (SELECT {_ERROR} AS e FROM d) SELECT coalesce(e, 'good') AS outcome, count(*) AS bodies, count(*) AS identities, count(*) AS identities_again FROM e GROUP BY 1")
def bodies_read_twice(spark, sf_dir):
    """Bodies written as lines and read from there, twice: every one has an identity of its own, and the same each time."""
    path = scratch_path(spark, "body-lines")
    _bodies(spark, sf_dir).select("body").write.text(path)
    read = lambda: Q.parse_requests(Q.read_request_bodies(spark, path)).select("request_id", F.coalesce("parse_error", F.lit("good")).alias("outcome"))
    again = read().select("request_id", F.col("outcome").alias("outcome_again"), F.lit(1).alias("there"))
    both = read().join(again, "request_id", "left").withColumn("same", F.when(F.col("outcome") == F.col("outcome_again"), F.col("there")))
    return both.groupBy("outcome").agg(F.count("*").alias("bodies"), F.count_distinct("request_id").alias("identities"), F.count("same").alias("identities_again"))


_FILE_RULES = ("(?i)\\bscum\\b", "(?i)\\bmoron\\b", "[0-9]{3}-[0-9]{4}", "(?i)\\bthe [a-z]+ of\\b")
_FILE = "# words\n" + "\n".join(_FILE_RULES[:2]) + "\n\n  # numbers\n  " + _FILE_RULES[2] + "  \n"
_FILE_SQL = " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS hits FROM documents WHERE regexp_matches(text, '{r}', 's')" for r in _FILE_RULES)


@query(f"SELECT * FROM ({_FILE_SQL}) WHERE hits > 0")
def rule_file_hits(spark, sf_dir):
    """How many documents each rule of a file finds, and one rule given beside the file; blank lines and remarks do not count."""
    path = scratch_path(spark, "rules")
    spark.range(1).select(F.lit(_FILE).alias("value")).write.text(path)
    rules = read_rules(spark, path + "/*.txt", ["# one more", _FILE_RULES[3]])
    matched = _t(spark, sf_dir, "documents").select(all_matches(rules, F.coalesce("text", F.lit(""))).alias("matched"))
    return TU.rule_hits(matched, rules).select("rule", F.col("requests").alias("hits"))


@query(f"{_TURN_SQL} SELECT conv_id || '-' || turn AS request_id, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE total_redactions END AS total_redactions, CASE WHEN conv_id % 5 = 0 THEN '' ELSE entity_types END AS entity_types FROM r")
def recorded_responses(spark, sf_dir):
    """Responses recorded as NDJSON, read back and redacted."""
    path = scratch_path(spark, "responses")
    _response_bodies(spark, sf_dir).select("request_id", "stream", "content_type", "body").write.json(path)
    redacted = RS.redact_response_bodies(RS.read_response_bodies(spark, path), _REDACTOR)
    return redacted.select("request_id", "total_redactions", F.array_join("entity_types", ",").alias("entity_types"))


def _with_system(spark, sf_dir) -> DataFrame:
    """Anthropic bodies of every document, whose system prompt is a string, a list of blocks, a number, or not there."""
    d, text = _t(spark, sf_dir, "documents"), Q.json_string(F.coalesce("text", F.lit("")))
    kind = F.pmod("doc_id", F.lit(4))
    system = F.when(kind == 0, F.concat(F.lit('"system":'), text, F.lit(","))).when(kind == 1, F.concat(F.lit('"system":[{"type":"text","text":'), text, F.lit('},{"type":"text","text":"end"}],'))).when(kind == 2, F.lit('"system":7,')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"model":"m-1",'), system, F.lit('"max_tokens":9,"messages":[{"role":"user","content":"hi"}]}'))
    return d.select("doc_id", F.col("doc_id").cast("string").alias("request_id"), F.lit("/v1/messages").alias("path"), body.alias("body"))


@query("""WITH d AS (SELECT doc_id, doc_id % 4 AS kind, coalesce(text, '') AS t FROM documents)
SELECT doc_id, CASE WHEN kind > 1 THEN 'block' ELSE 'allow' END AS decision, CASE kind WHEN 0 THEN t || chr(10) || 'hi' WHEN 1 THEN t || chr(10) || 'end' || chr(10) || 'hi' ELSE 'hi' END AS all_text,
  CASE kind WHEN 0 THEN t WHEN 1 THEN t WHEN 2 THEN '7' END AS system, 1 AS n_messages FROM d""")
def system_prompt_beside_messages(spark, sf_dir):
    """The system prompt beside the messages is screened as the first of them, and put back where it was."""
    good, _ = Q.quarantine(Q.parse_requests(_with_system(spark, sf_dir), path_col="path", prepend_system=True))
    ran = Pipeline([S.PolicyEngine([S.PolicyRule("no_system", system_prompt_absent=True)])]).run(good)
    out = F.parse_json(Q.serialize_request(F.col("model"), F.col("stream"), F.col("messages"), F.col("extra"), F.col("provider") == "anthropic"))
    at = lambda p, kind="string": F.try_variant_get("v", p, kind)
    v = ran.select("doc_id", "decision", T.all_text(F.col("messages")).alias("all_text"), out.alias("v"))
    own = F.when(F.pmod("doc_id", F.lit(4)) == 1, at("$.system[0].text")).otherwise(at("$.system"))
    return v.select("doc_id", "decision", "all_text", own.alias("system"), F.size(at("$.messages", "array<variant>")).alias("n_messages"))


@query("""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents), s AS (SELECT doc_id, CASE WHEN n % 3 > 0 THEN 1.0::DOUBLE / (n % 3) END AS x FROM d)
SELECT doc_id, CASE WHEN x >= 0.9 THEN 'block' ELSE 'allow' END AS open, CASE WHEN x IS NULL OR x >= 0.9 THEN 'block' ELSE 'allow' END AS closed, CASE WHEN x IS NULL THEN 'policy_violation' WHEN x >= 0.9 THEN 'custom' END AS code_closed FROM s""")
def native_scorer_fails(spark, sf_dir):
    """A native scorer that divides by zero in every third text: such rows are let through, or blocked, and the job goes on."""
    docs = Q.requests_from_text(_t(spark, sf_dir, "documents"))
    scorer = lambda t: F.lit(1.0) / (F.char_length(t) % 3)
    ran = lambda on_error: Pipeline([S.ScoreStage(scorer, 0.9, "custom", "Custom", on_error=on_error)]).run(docs)
    closed = ran("block").select("doc_id", F.col("decision").alias("closed"), F.col("code").alias("code_closed"))
    return ran("allow").select("doc_id", F.col("decision").alias("open")).join(closed, "doc_id")


@query(f"{_DECIDED} SELECT decision, count(*) AS records, count(DISTINCT doc_id) AS requests FROM decided GROUP BY decision")
def audit_stream(spark, sf_dir):
    """Audit records as a stream of four micro-batches into dated files, stopped after each and started again."""
    path, made, state = scratch_path(spark, "audit-stream"), scratch_path(spark, "audit-made"), scratch_path(spark, "audit-state")
    records = A.audit_records(_audited(spark, sf_dir))
    # decided once; a batch's records then lie in as many files as tasks decided them
    dealt = records.withColumn("part", F.pmod(F.xxhash64("request_id"), F.lit(4)).cast("int"))
    dealt.write.partitionBy("part").parquet(made)
    run_in_batches(spark.read.schema(dealt.schema).parquet(made), [F.col("part") == n for n in range(4)], "audit-in", lambda stream: A.stream_audit(stream.drop("part"), path, state))
    return A.read_audit(spark, path).groupBy("decision").agg(F.count("*").alias("records"), F.count_distinct("request_id").alias("requests"))
