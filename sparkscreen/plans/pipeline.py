"""Pipelines: an ordered fold of stages into one decision for each request.

The first block wins, also after redactions. A redaction changes the messages that later stages see.
Otherwise the reasons of all redactions are joined and their entities united. All of it is one narrow
plan over the rows: nothing is shuffled, and findings after a block are not evaluated.
"""

from __future__ import annotations

import tomllib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import rules as R
from ..functions import redact as P
from ..functions import text as T
from ..operators import stages as S

# The names of stages.
REQUEST_STAGES = ("regex_injection", "onnx_injection", "pii_redactor", "toxicity", "policy")
RESPONSE_STAGES = ("output_pii_redactor",)
MODEL_THRESHOLDS = {"onnx_injection": 0.85, "toxicity": 0.9}
ON_ERROR = ("allow", "block")


MADE_COLUMNS = frozenset(("decision", "reason", "code", "entities", "score", "stage", "stage_trace", "stage_details"))


class Pipeline:
    def __init__(self, stages: Sequence[S.Stage] = ()):
        self.stages = list(stages)
        self._kept: dict = {}

    def _inputs(self) -> tuple[Column, Column]:
        """The messages, and whether a row is not blocked yet: the same columns each time, so that stages can keep what they made of them."""
        if "inputs" not in self._kept:
            self._kept["inputs"] = F.col("messages"), ~F.col("_blocked")
        return self._kept["inputs"]

    def stage(self, stage: S.Stage) -> Pipeline:
        """Adds a stage at the end."""
        self.stages.append(stage)
        return self

    @classmethod
    def default(cls) -> Pipeline:
        """Bundled rules, then redaction in library order."""
        return cls([S.RegexInjection(), S.PiiRedactor()])

    def run(self, requests: DataFrame) -> DataFrame:
        """``requests`` plus decision, reason, code, entities, score, stage and stage_trace; messages as rewritten.

        Null messages count as none. ``requests`` must not have columns of these names, nor of names that begin with an underscore.
        """
        clashes = sorted(c for c in requests.columns if c.lower() in MADE_COLUMNS or c.startswith("_"))
        if clashes:
            raise ValueError(f"rename the columns {', '.join(clashes)}: the pipeline makes columns of such names")
        df = requests.withColumns({"messages": F.coalesce("messages", F.array().cast(requests.schema["messages"].dataType)), "_blocked": F.lit(False)})
        made, scratch = [], ["_blocked"]
        messages, active = self._inputs()
        for i, stage in enumerate(self.stages):
            col = f"_stage{i}"
            df = stage.prepare(df, messages, active)
            df = df.withColumn(col, F.when(active, stage.finding(df, messages)))
            changed = stage.rewritten(df, messages)
            if changed is not None:
                df = df.withColumn("messages", F.when(F.col(f"{col}.action") == "redact", changed).otherwise(messages))
            df = df.withColumn("_blocked", F.coalesce(F.col(f"{col}.action") == "block", F.lit(False)) | F.col("_blocked")).drop(*stage.scratch())
            made.append((col, stage.name))
            scratch.append(col)
        if not made:
            return df.drop("_blocked").withColumns({"decision": F.lit("allow"), "reason": F.lit(None).cast("string"), "code": F.lit(None).cast("string"), "entities": F.array().cast("array<string>"), "score": F.lit(None).cast("double"), "stage": F.lit(None).cast("string"), "stage_trace": F.array().cast("array<struct<stage:string,action:string>>")})
        names = tuple(made)
        if names not in self._kept:
            self._kept[names] = _folded(made)
        ran, out = self._kept[names]
        df = df.withColumn("_ran", ran)
        # One row in, one row out: a filter on the decision stops here, instead of being copied with all it stands for below every stage.
        kept = [c for c in df.columns if c not in ("_ran", *scratch)]
        return df.select(*kept, out)

    def check(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """Dry run of texts: decision, reason, code, entities and the redacted text."""
        from ..sources.requests import requests_from_text

        return self.check_requests(requests_from_text(df, text_col))

    def check_requests(self, requests: DataFrame) -> DataFrame:
        """Dry run of requests: the result of ``run`` and the redacted text."""
        ran = self.run(requests)
        return ran.withColumn("redacted_text", F.when(F.col("decision") == "redact", T.user_text(F.col("messages"))))

    @classmethod
    def from_config(cls, spark: SparkSession, config: Mapping, scorers: Mapping[str, S.Scorer] | None = None) -> Pipeline:
        """Stages in the order of ``pipeline.request_stages``; disabled and unknown ones are left out.

        ``scorers`` has a scorer for each model stage that is enabled. The configuration is checked
        first, and all that is wrong with it is raised at once, patterns that do not compile included.
        A model stage without an ``on_error`` of its own takes that of the pipeline.
        """
        problems, own, flow, out = validate_config(config), config.get("stages", {}), config.get("pipeline", {}), cls()
        wanted = flow.get("request_stages", ["regex_injection", "pii_redactor", "policy"])
        listed_rules: list[R.Rule] = []
        injection = own.get("regex_injection", {})
        if "regex_injection" in wanted and injection.get("enabled", True):
            file, extra = injection.get("rules_file", "").strip(), injection.get("extra_rules", ())
            listed_rules = R.read_rules(spark, file, extra) if file else R.with_extra(R.BUNDLED, extra)
            problems += [f"stages.regex_injection: {p}" for p in R.invalid_rules(spark, listed_rules)]
        if problems:
            raise ValueError("\n".join(problems))
        for name in wanted:
            s = own.get(name, {})
            if name == "policy":
                listed = config.get("policy", {}).get("rules", [])
                if listed:
                    out.stage(S.PolicyEngine([policy_rule(r) for r in listed]))
            elif name in REQUEST_STAGES and s.get("enabled", name not in MODEL_THRESHOLDS):
                if name == "regex_injection":
                    out.stage(S.RegexInjection(listed_rules, s.get("action") == "log_only"))
                elif name == "pii_redactor":
                    out.stage(redactor_from(s))
                else:
                    make = S.injection_model if name == "onnx_injection" else S.toxicity_model
                    on_error = s.get("on_error", flow.get("on_error", "allow"))
                    options = {"on_error": on_error, "batches": s.get("batches", False), "action": s.get("action", "block")}
                    if name == "toxicity":
                        options["roles"] = tuple(s.get("scan_roles", ("user",)))
                    out.stage(make((scorers or {})[name], s.get("threshold", MODEL_THRESHOLDS[name]), **options))
        return out

    @classmethod
    def from_toml(cls, spark: SparkSession, text: str, scorers: Mapping[str, S.Scorer] | None = None) -> Pipeline:
        return cls.from_config(spark, tomllib.loads(text), scorers)


def _folded(made: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Column ``_ran`` of (finding column, stage name) pairs, and from it the columns of the result."""
    ran = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(n).alias("stage"), F.col(c).alias("f"))) for c, n in made]))
    blocks = F.filter("_ran", lambda x: x["f"]["action"] == "block")
    redactions = F.filter("_ran", lambda x: x["f"]["action"] == "redact")
    block = F.try_element_at(blocks, F.lit(1))
    last = F.coalesce(block, F.try_element_at(redactions, F.lit(-1)))
    decision = F.when(F.size(blocks) > 0, "block").when(F.size(redactions) > 0, "redact").otherwise("allow")
    reasons = F.when(F.size(redactions) > 0, F.array_join(F.transform(redactions, lambda x: x["f"]["reason"]), "; "))
    found = F.array_distinct(F.flatten(F.transform(redactions, lambda x: x["f"]["entities"])))
    out = {
        "decision": decision,
        "reason": F.when(F.size(blocks) > 0, block["f"]["reason"]).otherwise(reasons),
        "code": block["f"]["code"],
        "entities": F.when(F.size(blocks) > 0, F.array().cast("array<string>")).otherwise(found),
        "score": last["f"]["score"],
        "stage": last["stage"],
        "stage_trace": F.transform("_ran", lambda x: F.struct(x["stage"].alias("stage"), x["f"]["action"].alias("action"))),
        "stage_details": F.map_from_entries(F.transform(F.filter("_ran", lambda x: x["f"]["detail"].isNotNull()), lambda x: F.struct(x["stage"], x["f"]["detail"]))),
    }
    return ran, F.inline(F.array(F.struct(*[c.alias(n) for n, c in out.items()])))


def redactor_from(settings: Mapping) -> S.PiiRedactor:
    return S.PiiRedactor(settings.get("entities", P.CONFIG_ORDER), settings.get("validate_luhn", True), settings.get("replacements", {}), settings.get("action", "redact"))


def response_redactor(config: Mapping) -> S.PiiRedactor | None:
    """The redactor of responses: that of requests, if the configuration asks for it, or None.

    It is asked for by ``stages.pii_redactor.redact_responses``, and by no stage of its own, so that
    responses cannot be redacted by other rules than requests. ``pipeline.response_stages`` is only checked for unknown names.
    """
    problems = validate_config(config)
    if problems:
        raise ValueError("\n".join(problems))
    s = config.get("stages", {}).get("pii_redactor", {})
    return redactor_from(s) if s.get("enabled", True) and s.get("redact_responses", False) else None


def policy_rule(r: Mapping) -> S.PolicyRule:
    when, then = r.get("when", {}), r.get("then", {})
    return S.PolicyRule(r["name"], tuple(k.lower() for k in when.get("content_contains", ())), when.get("system_prompt_absent", False), when.get("token_count_exceeds", 0), when.get("always", False), then.get("action", "block"), then.get("message"), r.get("enabled", True))


def validate_config(config: Mapping) -> list[str]:
    """Everything that is wrong with a configuration's stages, entities, thresholds and policy rules."""
    out: list[str] = []
    flow, stages = config.get("pipeline", {}), config.get("stages", {})
    for key, known in (("request_stages", REQUEST_STAGES), ("response_stages", RESPONSE_STAGES)):
        out += [f"pipeline.{key}: unknown stage '{x}'; known: {', '.join(known)}" for x in flow.get(key, ()) if x not in known]
    if flow.get("on_error", "allow") not in ON_ERROR:
        out.append(f"pipeline.on_error must be one of {', '.join(ON_ERROR)}")
    pii = stages.get("pii_redactor", {})
    if pii.get("enabled", True):
        names = pii.get("entities", P.CONFIG_ORDER)
        out += [f"stages.pii_redactor.entities: unknown entity '{e}'; known: {', '.join(P.CONFIG_ORDER)}" for e in names if e not in P.PATTERNS]
        if not names:
            out.append("stages.pii_redactor.entities is empty")
    for name, default in MODEL_THRESHOLDS.items():
        s = stages.get(name, {})
        if s.get("enabled", False) and not 0 <= s.get("threshold", default) <= 1:
            out.append(f"stages.{name}.threshold must lie between 0 and 1")
        if s.get("enabled", False) and s.get("on_error", "allow") not in ON_ERROR:
            out.append(f"stages.{name}.on_error must be one of {', '.join(ON_ERROR)}")
    for i, r in enumerate(config.get("policy", {}).get("rules", ())):
        when, words = r.get("when", {}), r.get("when", {}).get("content_contains", ())
        if not r.get("name", "").strip():
            out.append(f"policy.rules[{i}].name is empty")
        if not (words or when.get("system_prompt_absent") or when.get("token_count_exceeds", 0) > 0 or when.get("always")):
            out.append(f"policy.rules[{i}].when has no condition")
        if words and all(not k.strip() for k in words):
            out.append(f"policy.rules[{i}].when.content_contains has only blank words")
    return out
