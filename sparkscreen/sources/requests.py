"""Requests from texts, turns, raw JSON bodies and fixture files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import MESSAGE, MESSAGES, PART

MAX_BODY = 10 * 1024 * 1024


def message(role: Column, text: Column, parts: Column | None = None) -> Column:
    return F.struct(role.alias("role"), text.alias("text"), (F.lit(None) if parts is None else parts).alias("parts")).cast(MESSAGE)


def requests_from_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row becomes a request with one user message; a null text is an empty one."""
    return df.withColumn("messages", F.array(message(F.lit("user"), F.coalesce(F.col(text_col), F.lit("")))).cast(MESSAGES))


def requests_from_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One request for each conversation, its messages in turn order. The only shuffle of the engine's main path."""
    each = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    got = turns.groupBy(id_col).agg(F.array_sort(F.collect_list(each)).alias("_turns"))
    return got.select(id_col, F.transform("_turns", lambda m: message(m["role"], m["text"])).cast(MESSAGES).alias("messages"))


def read_request_bodies(spark: SparkSession, path: str, stream: bool = False, **options: str) -> DataFrame:
    """Text files with one JSON body a line, as column ``body``."""
    reader = spark.readStream if stream else spark.read
    return reader.options(**options).text(path).withColumnRenamed("value", "body")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _map(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _list(v: Column) -> Column:
    return F.when(_kind(v).startswith("ARRAY<"), F.try_variant_get(v, "$", "array<variant>"))


def _string(v: Column) -> Column:
    """The value of a JSON string; null for every other kind."""
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _parsed_parts(content: Column, at: Column) -> Column:
    def one(p: Column) -> Column:
        m = _map(p)
        kind = F.coalesce(_string(m["type"]), F.lit("text"))
        image = _map(m["image_url"])
        text = F.struct(F.lit("text").alias("type"), F.when(kind == "text", F.coalesce(_string(m["text"]), F.lit(""))).otherwise("").alias("text"), F.lit(None).alias("image_url")).cast(PART)
        url = F.struct(F.lit("image_url").alias("type"), F.lit(None).alias("text"), F.struct(F.coalesce(_string(image["url"]), F.lit("")).alias("url"), _string(image["detail"]).alias("detail")).alias("image_url")).cast(PART)
        bad = F.when(~kind.isin("text", "image_url", "image"), F.concat(F.lit("messages["), at.cast("string"), F.lit("] content part has unsupported type '"), kind, F.lit("'")))
        return F.struct(F.when(kind == "image_url", url).otherwise(text).alias("part"), bad.alias("error"))

    return F.transform(_list(content), one)


def _parsed_message(item: Column, i: Column) -> Column:
    at = lambda *rest: F.concat(F.lit("messages["), i.cast("string"), *rest)

    def whole(m: Column) -> Column:
        role, content = _string(m["role"]), m["content"]
        known = F.when(role == "function", "tool").when(role.isin("system", "user", "assistant", "tool"), role)
        blank = F.is_variant_null(content) | content.isNull()

        def judged(parts: Column) -> Column:
            kind = _kind(content)
            plain = F.when(blank, F.lit("")).otherwise(_string(content))
            error = (
                F.when(role.isNull(), at(F.lit("] missing 'role' field")))
                .when(known.isNull(), at(F.lit("] has unknown role '"), role, F.lit("'")))
                .when(~F.coalesce(F.map_contains_key(m, "content"), F.lit(False)), at(F.lit("] missing 'content' field")))
                .when(parts.isNotNull(), F.try_element_at(F.array_compact(F.transform(parts, lambda p: p["error"])), F.lit(1)))
                .when(~F.coalesce(blank, F.lit(False)) & (F.coalesce(kind, F.lit("")) != "STRING"), at(F.lit("] 'content' has unsupported JSON type: "), F.to_json(content)))
            )
            return F.struct(message(known, plain, F.transform(parts, lambda p: p["part"])).alias("message"), error.alias("error"))

        return T.let(_parsed_parts(content, i), judged)

    return T.let(_map(item), whole)


#: Columns that parsing makes.
PARSED_COLUMNS = ("parse_error", "reject_code", "model", "stream", "messages", "extra")


def refuse_columns(df: DataFrame, made: Iterable[str], what: str) -> None:
    """An error for columns that ``what`` would overwrite, and for those that begin with an underscore, as its own do."""
    clashes = sorted(c for c in df.columns if c.lower() in made or c.startswith("_"))
    if clashes:
        raise ValueError(f"rename the columns {', '.join(clashes)}: {what} makes columns of such names")


def _system_message(system: Column) -> Column:
    """A top-level system prompt as a message: a string, or a list of text blocks; null for any other kind."""
    parts = F.transform(_parsed_parts(system, F.lit(0)), lambda p: p["part"])
    return F.when(_string(system).isNotNull() | parts.isNotNull(), message(F.lit("system"), _string(system), parts))


def parse_requests(bodies: DataFrame, body_col: str = "body", max_body: int = MAX_BODY, path_col: str | None = None, salt: str = "", prepend_system: bool = False) -> DataFrame:
    """``bodies`` plus request columns, reject_code and parse_error; a bad body is a row with an error, not a failure.

    request_id and received_at are kept if given. If not, received_at is the time of the query, and request_id the digest of the body,
    of the row's place in the input and of ``salt``, in the form of a UUID: an input that is read again gives the same ids. Inputs that
    are joined later need salts of their own. Rows of a stream have no place, and get random ids. Content that is a string,
    null or a list of parts is taken; the fields that are not understood go to ``extra``. ``bodies`` must not have columns
    of the names that are made here, nor of names that begin with an underscore.

    Anthropic bodies may hold their system prompt in a field beside the messages. By default it stays in ``extra`` and is not
    screened; with ``prepend_system`` it becomes the first message (a string, or a list of text blocks) and leaves ``extra``.
    Other kinds of it stay where they are. ``serialize_request(..., system_field=...)`` puts it back.
    """
    refuse_columns(bodies, PARSED_COLUMNS, "parsing")
    df = bodies
    if "request_id" not in df.columns and df.isStreaming:
        df = df.withColumn("request_id", F.expr("uuid()"))
    elif "request_id" not in df.columns:
        digest = F.md5(F.concat_ws(":", F.coalesce(F.col(body_col), F.lit("")), F.monotonically_increasing_id().cast("string"), F.lit(salt)).cast("binary"))
        # version and variant of a UUID made from a digest
        df = df.withColumn("request_id", F.regexp_replace(digest, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-3$3-8$4-$5"))
    if "received_at" not in df.columns:
        df = df.withColumn("received_at", F.current_timestamp())
    if "provider" not in df.columns:
        df = df.withColumn("provider", T.provider_for_path(F.col(path_col)) if path_col else F.lit("openai"))
    too_large = F.coalesce(F.octet_length(body_col) > max_body, F.lit(False))
    df = df.withColumn("_json", F.when(~too_large, F.try_parse_json(F.col(body_col))))
    df = df.withColumn("_map", _map(F.col("_json")))
    df = df.withColumn("_parsed", F.transform(_list(F.col("_map")["messages"]), _parsed_message))
    model = _string(F.col("_map")["model"])
    error = (
        F.when(too_large, "request body too large")
        .when(F.col("_json").isNull(), "body is not JSON")
        .when(model.isNull(), "missing or invalid 'model' field")
        .when(~F.coalesce(F.map_contains_key("_map", "messages"), F.lit(False)), "missing 'messages' field")
        .when(F.col("_parsed").isNull(), "'messages' must be an array")
        .otherwise(F.try_element_at(F.array_compact(F.transform("_parsed", lambda x: x["error"])), F.lit(1)))
    )
    df = df.withColumn("_error", error)
    stream = F.when(_kind(F.col("_map")["stream"]) == "BOOLEAN", F.try_variant_get(F.col("_map")["stream"], "$", "boolean"))
    messages = F.transform("_parsed", lambda x: x["message"]).cast(MESSAGES)
    extra = F.map_filter("_map", lambda k, _: ~k.isin("model", "messages", "stream"))
    if prepend_system:
        df = df.withColumn("_system", F.when(F.col("provider") == "anthropic", _system_message(F.col("_map")["system"])))
        taken = F.col("_system").isNotNull()
        messages = F.when(taken, F.concat(F.array("_system"), messages)).otherwise(messages)
        extra = F.when(taken, F.map_filter("_map", lambda k, _: ~k.isin("model", "messages", "stream", "system"))).otherwise(extra)
    values = (F.col("_error"), F.when(too_large, "payload_too_large").when(F.col("_error").isNotNull(), "bad_request"), model, F.coalesce(stream, F.lit(False)), messages, extra)
    kept = [c for c in df.columns if c not in ("_json", "_map", "_parsed", "_error", "_system")]
    # One row in, one row out: a filter on the error stops here, instead of parsing each body once for itself.
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(c) for c, v in zip(PARSED_COLUMNS, values)]))))


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good requests, and rejected ones with their answer."""
    bad = parsed.filter(F.col("parse_error").isNotNull())
    return parsed.filter(F.col("parse_error").isNull()).drop("parse_error", "reject_code"), bad.withColumn("response_body", T.reject_body(F.col("parse_error"), F.col("reject_code")))


def json_string(text: Column) -> Column:
    """A string as JSON text."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def string_variant(text: Column) -> Column:
    return F.parse_json(json_string(text))


def serialize_request(model: Column, stream: Column, messages: Column, extra: Column, system_field: Column | None = None) -> Column:
    """JSON text of a request: extra fields, then model, stream and messages over them.

    Where ``system_field`` is true, a first message of role system goes into a field ``system`` beside the messages.
    """

    def part(p: Column) -> Column:
        image = F.to_json(F.struct(p["type"].alias("type"), F.struct(p["image_url"]["url"].alias("url"), p["image_url"]["detail"].alias("detail")).alias("image_url")), {"ignoreNullFields": "false"})
        return F.when(p["type"] == "image_url", image).otherwise(F.to_json(F.struct(p["type"].alias("type"), F.coalesce(p["text"], F.lit("")).alias("text"))))

    def content(m: Column) -> Column:
        parts = F.concat(F.lit("["), F.array_join(F.transform(m["parts"], part), ","), F.lit("]"))
        return F.when(m["text"].isNotNull() | m["parts"].isNull(), json_string(F.coalesce(m["text"], F.lit("")))).otherwise(parts)

    def one(m: Column) -> Column:
        return F.concat(F.lit('{"role":'), json_string(m["role"]), F.lit(',"content":'), content(m), F.lit("}"))

    system = F.lit(None)
    if system_field is not None:
        first = F.try_element_at(messages, F.lit(1))
        beside = F.coalesce(system_field & (first["role"] == "system"), F.lit(False))
        system = F.when(beside, F.parse_json(content(first)))
        messages = F.when(beside, F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    listed = F.parse_json(F.concat(F.lit("["), F.array_join(F.transform(messages, one), ","), F.lit("]")))
    own = F.create_map(F.lit("model"), string_variant(model), F.lit("stream"), F.parse_json(stream.cast("string")), F.lit("messages"), listed)
    if system_field is not None:
        own = F.when(system.isNotNull(), F.map_concat(own, F.create_map(F.lit("system"), system))).otherwise(own)
        extra = F.when(system.isNotNull(), F.map_filter(extra, lambda k, _: k != "system")).otherwise(extra)
    others = F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,variant>")), lambda k, _: ~k.isin("model", "stream", "messages"))
    return F.to_json(F.map_concat(others, own))


#: One case of a fixture file; what a case does not state is null.
CASE_SCHEMA = (
    "name string, messages array<struct<role: string, content: string>>, expected_decision string, expected_code string, expected_entities array<string>, expected_redacted_text string, "
    "policy_rule struct<name: string, enabled: boolean, when: struct<content_contains: array<string>, system_prompt_absent: boolean, token_count_exceeds: bigint, always: boolean>, then: struct<action: string, message: string>>, note string"
)


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Files of {description, cases: [...]}: one row for each case, its messages as request messages, its policy rule as ``rules``."""
    from ..operators.row_rules import RULES, rule_struct

    cases = spark.read.option("multiLine", True).schema(f"description string, cases array<struct<{CASE_SCHEMA}>>").json(path).select(F.explode("cases").alias("c")).select("c.*")
    when, then = F.col("policy_rule.when"), F.col("policy_rule.then")
    rule = rule_struct(F.col("policy_rule.name"), when["content_contains"], when["system_prompt_absent"], when["token_count_exceeds"], when["always"], then["action"], then["message"], F.col("policy_rule.enabled"))
    rules = F.when(F.col("policy_rule").isNotNull(), F.array(rule)).otherwise(F.array().cast(RULES))
    return cases.withColumns({"rules": rules, "messages": F.transform("messages", lambda m: message(m["role"], m["content"])).cast(MESSAGES)}).drop("policy_rule")
