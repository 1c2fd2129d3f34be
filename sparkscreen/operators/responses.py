"""Redaction of model responses: JSON bodies, and assistant turns of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import RECORD
from ..sources.requests import _list, _map, _string, refuse_columns, string_variant
from .stages import PiiRedactor


#: What is known of a response that was recorded: what its request asked for, and what came back.
RESPONSE_SCHEMA = "request_id string, stream boolean, content_type string, body string"


def read_response_bodies(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """NDJSON files of recorded responses, one object a line, with the columns of RESPONSE_SCHEMA.

    The body is the text as it came, JSON or not. A line that is no JSON object has nulls in all columns, and fields
    that are absent are null; such a row is not redactable. With ``stream`` new files are read as they come.
    """
    reader = spark.readStream if stream else spark.read
    return reader.options(**options).schema(RESPONSE_SCHEMA).json(path)


def is_redactable(stream: Column, content_type: Column) -> Column:
    return ~F.coalesce(stream, F.lit(False)) & F.coalesce(content_type.startswith("application/json"), F.lit(False))


def _none() -> Column:
    return F.array().cast(f"array<{RECORD}>")


def _entry(redactor: PiiRedactor, holder: Column, key: str, wanted: Column) -> Column:
    """struct(value, records) of an object whose text under ``key`` is redacted if ``wanted``."""
    text = F.when(wanted, _string(holder[key]))
    put = lambda z: F.map_concat(F.map_filter(holder, lambda k, _: k != key), F.create_map(F.lit(key), string_variant(z["text"])))
    return T.let(redactor.redacted(text), lambda z: F.struct(F.when(F.size(z["records"]) > 0, put(z)).otherwise(holder).alias("value"), z["records"].alias("records")))


def _openai(redactor: PiiRedactor, body: Column) -> Column:
    def choice(c: Column) -> Column:
        m = _map(c)
        put = lambda z: F.to_variant_object(F.map_concat(F.map_filter(m, lambda k, _: k != "message"), F.create_map(F.lit("message"), F.to_variant_object(z["value"]))))
        return T.let(_entry(redactor, _map(m["message"]), "content", F.lit(True)), lambda z: F.struct(F.when(F.size(z["records"]) > 0, put(z)).otherwise(c).alias("value"), z["records"].alias("records")))

    return F.transform(_list(body["choices"]), choice)


def _anthropic(redactor: PiiRedactor, body: Column) -> Column:
    def block(b: Column) -> Column:
        m = _map(b)
        return T.let(_entry(redactor, m, "text", _string(m["type"]) == "text"), lambda z: F.struct(F.when(F.size(z["records"]) > 0, F.to_variant_object(z["value"])).otherwise(b).alias("value"), z["records"].alias("records")))

    return F.transform(_list(body["content"]), block)


def redact_response_bodies(responses: DataFrame, redactor: PiiRedactor, body_col: str = "body", stream_col: str = "stream", type_col: str = "content_type") -> DataFrame:
    """``responses`` with redacted bodies, total_redactions and entity_types (sorted).

    Takes choices[].message.content and content[] blocks of type text. A body that is a stream, not
    JSON, of another shape or clean stays as it is, to the letter.
    """
    refuse_columns(responses, ("total_redactions", "entity_types"), "redaction")
    able = is_redactable(F.col(stream_col), F.col(type_col))
    df = responses.withColumn("_map", F.when(able, _map(F.try_parse_json(F.col(body_col)))))
    df = df.withColumn("_openai", _openai(redactor, F.col("_map"))).withColumn("_anthropic", _anthropic(redactor, F.col("_map")))
    of = lambda c: F.coalesce(F.flatten(F.transform(c, lambda z: z["records"])), _none())
    df = df.withColumn("_records", F.concat(of("_openai"), of("_anthropic")))
    changed = lambda c: F.size(of(c)) > 0
    swap = lambda m, key, c: F.when(changed(c), F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), F.to_variant_object(F.transform(c, lambda z: z["value"]))))).otherwise(m)
    body = F.to_json(swap(swap(F.col("_map"), "choices", "_openai"), "content", "_anthropic"))
    types = F.array_sort(F.array_distinct(F.transform("_records", lambda r: r["entity_type"])))
    out = {body_col: F.when(F.size("_records") > 0, body).otherwise(F.col(body_col)), "total_redactions": F.size("_records"), "entity_types": types}
    return df.withColumns(out).drop("_map", "_openai", "_anthropic", "_records")


def redact_turns(turns: DataFrame, redactor: PiiRedactor, role: str = "assistant", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of turns whose texts of one role are redacted, with the number of redactions and their types."""
    z = F.when(F.col(role_col) == role, redactor.redacted(F.col(text_col)))
    df = turns.withColumn("_z", z)
    types = F.array_sort(F.array_distinct(F.transform("_z.records", lambda r: r["entity_type"])))
    return df.withColumns({text_col: F.coalesce("_z.text", text_col), "total_redactions": F.coalesce(F.size("_z.records"), F.lit(0)), "entity_types": F.coalesce(types, F.array().cast("array<string>"))}).drop("_z")


def response_events(redacted: DataFrame) -> DataFrame:
    """Audit events of responses; clean ones give none."""
    return redacted.filter("total_redactions > 0").select("request_id", F.lit("response_redact").alias("decision"), "total_redactions", "entity_types")
