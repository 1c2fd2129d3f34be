"""Policy rules that stand in the rows: each row brings its own ordered list.

For tenants with rules of their own, and for cases that state the rule they are to be judged by. The
conditions and their order are those of ``PolicyRule``; here they are read from an array of structs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .stages import PolicyRule, Stage, allow, finding

RULE = "struct<name: string, enabled: boolean, content_contains: array<string>, system_prompt_absent: boolean, token_count_exceeds: bigint, always: boolean, action: string, message: string>"
RULES = f"array<{RULE}>"


def rule_struct(name: Column, contains: Column | None = None, system_prompt_absent: Column | None = None, token_count_exceeds: Column | None = None, always: Column | None = None, action: Column | None = None, message: Column | None = None, enabled: Column | None = None) -> Column:
    """One rule; what is not given is null, which stands for: enabled, block, no condition of that kind."""
    null = F.lit(None)
    parts = {"name": name, "enabled": enabled, "content_contains": contains, "system_prompt_absent": system_prompt_absent, "token_count_exceeds": token_count_exceeds, "always": always, "action": action, "message": message}
    return F.struct(*[(null if v is None else v).alias(k) for k, v in parts.items()]).cast(RULE)


def rules_literal(rules: Sequence[PolicyRule]) -> Column:
    """Rules of code as a column, so that rows without their own can take them."""
    lit, words = F.lit, lambda ws: F.array(*[F.lit(w) for w in ws]).cast("array<string>")
    each = [rule_struct(lit(r.name), words(r.content_contains), lit(r.system_prompt_absent), lit(r.token_count_exceeds), lit(r.always), lit(r.action), lit(r.message), lit(r.enabled)) for r in rules]
    return F.array(*each).cast(RULES)


def holds(rule: Column, messages: Column, lowered: Column, tokens: Column) -> Column:
    """always, then contains, then absent, then tokens; no condition at all counts as always."""
    words = F.coalesce(rule["content_contains"], F.array().cast("array<string>"))
    yes = lambda c: F.coalesce(rule[c], F.lit(False))
    contains = F.coalesce(F.exists(words, lambda w: lowered.contains(F.lower(w))), F.lit(False))
    limit = F.coalesce(rule["token_count_exceeds"], F.lit(0))
    absent = ~F.coalesce(F.exists(messages, lambda m: m["role"] == "system"), F.lit(False))
    return F.when(yes("always"), True).when(F.size(words) > 0, contains).when(yes("system_prompt_absent"), absent).when(limit > 0, tokens > limit).otherwise(True)


@dataclass
class RowPolicy(Stage):
    """First enabled rule of the row's own list that holds decides: block, or allow for every other action.

    A null or empty list, or one whose rules are all disabled or null, allows. The plan has one test, whatever the
    number of rules; texts are lowered and counted once for each row.
    """

    rules_col: str = "rules"
    name: str = "policy"

    def finding(self, df: DataFrame, messages: Column) -> Column:
        def judged(hit: Column) -> Column:
            action = F.coalesce(hit["action"], F.lit("block"))
            reason = F.coalesce(hit["message"], F.concat(F.lit("Policy rule '"), hit["name"], F.lit("' matched.")))
            note = F.concat_ws(":", hit["name"], action)
            return F.when(hit.isNull(), allow()).when(action == "block", finding("block", reason, "policy_violation", detail=note)).otherwise(finding("allow", detail=note))

        def first(x: Column) -> Column:
            able = F.filter(F.col(self.rules_col).cast(RULES), lambda r: r.isNotNull() & F.coalesce(r["enabled"], F.lit(True)))
            return T.let(F.try_element_at(F.filter(able, lambda r: holds(r, messages, x["low"], x["tokens"])), F.lit(1)), judged)

        seen = lambda t: F.struct(F.lower(t).alias("low"), T.approx_tokens(t).alias("tokens"))
        return T.let(T.all_text(messages), lambda t: T.let(seen(t), first))


def rules_of(rules: DataFrame, by: Sequence[str], order_col: str = "position") -> DataFrame:
    """A table with one rule a row -> one row for each ``by``, its rules in order. Columns of a rule that the table lacks are null."""
    has = {c: F.col(c) for c in ("enabled", "system_prompt_absent", "token_count_exceeds", "always", "action", "message") if c in rules.columns}
    words = F.col("content_contains") if "content_contains" in rules.columns else None
    rule = rule_struct(F.col("name"), words, **has)
    listed = rules.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("position"), rule.alias("rule")))).alias("_listed"))
    return listed.select(*by, F.transform("_listed", lambda x: x["rule"]).cast(RULES).alias("rules"))


def with_rules(requests: DataFrame, rules: DataFrame, by: Sequence[str], order_col: str = "position", defaults: Sequence[PolicyRule] = ()) -> DataFrame:
    """``requests`` with the rules of their tenant in ``rules``; those without one take ``defaults``."""
    own = rules_of(rules, by, order_col)
    joined = requests.join(own.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("rules").alias("_own")), [requests[c] == F.col(f"_by{i}") for i, c in enumerate(by)], "left")
    return joined.select(*[requests[c] for c in requests.columns], F.coalesce("_own", rules_literal(defaults)).alias("rules"))
