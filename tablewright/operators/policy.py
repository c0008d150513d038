"""Rule sets compiled to Columns, reasoning on items, and governance artifacts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.text import rolling_hash

LOSS_ALPHA, LOSS_FLOOR, REVIEW_LOSS = 0.6, 0.05, 0.15
#: The rule set in force.
RULESET = {
    "ruleSetVersion": "v0.1.0",
    "defaults": {"baseConfidence": 1.0},
    "rules": [
        {
            "ruleId": "G-LOSS-PENALTY", "enabled": True, "when": {"op": "gt", "path": "$.loss.avgLossScore", "value": 0.3},
            "then": {"actions": [
                {"type": "penalize_confidence", "value": 0.2}, {"type": "set_status", "value": "needs_review"},
                {"type": "emit_trace", "message": "Compression loss penalty applied."},
            ]},
        },
        {
            "ruleId": "G-MISSING-SKU", "enabled": True, "when": {"op": "missing", "path": "$.items[*].normalized.sku"},
            "then": {"actions": [{"type": "require_review"}, {"type": "emit_trace", "message": "SKU missing; manual review required."}]},
        },
        {
            "ruleId": "G-PRICE-CONFLICT", "enabled": True, "when": {"op": "gt", "path": "$.manifest.summary.conflictsResolved", "value": 0},
            "then": {"actions": [{"type": "penalize_confidence", "value": 0.1}, {"type": "emit_trace", "message": "Price conflict detected in evidence."}]},
        },
    ],
}


def load_ruleset(text: str | None) -> dict:
    """A rule set of JSON text; a missing or bad one gives no rules and confidence 1."""
    try:
        found = json.loads(text or "")
    except ValueError:
        found = None
    return found if isinstance(found, dict) else {"defaults": {"baseConfidence": 1.0}, "rules": []}


def shadowed(ruleset: dict, mode: str) -> dict:
    """In shadow mode every rule only records its match."""
    if mode != "shadow":
        return ruleset
    return {**ruleset, "rules": [{**rule, "mode": "shadow"} for rule in ruleset.get("rules", [])]}


def value_at(path: str, paths: dict[str, Column]) -> Column:
    """The Column of a path; paths that the context does not have, and paths through arrays, are null."""
    return paths.get(path, F.lit(None)) if "[" not in path or path in paths else F.lit(None)


def condition(when: dict, paths: dict[str, Column], strict: bool = True) -> Column:
    """A condition as a boolean Column that is never null.

    strict: the operators in force (gt, eq, exists, missing), others are false. Else the whole grammar: all, any, not,
    ne, gte, lt, lte, in, between and regex too.
    """
    op, value = when.get("op"), when.get("value")
    if not strict and op in ("all", "any", "not"):
        parts = [condition(w, paths, strict) for w in when.get("conditions", when.get("args", []))]
        if op == "not":
            return ~(parts[0] if parts else F.lit(False))
        out = F.lit(op == "all")
        for p in parts:
            out = (out & p) if op == "all" else (out | p)
        return out
    at = value_at(when.get("path", ""), paths)
    kinds = {"exists": lambda: at.isNotNull(), "missing": lambda: at.isNull(), "gt": lambda: at > F.lit(value), "eq": lambda: at == F.lit(value)}
    if not strict:
        kinds |= {
            "ne": lambda: ~at.eqNullSafe(F.lit(value)), "gte": lambda: at >= F.lit(value), "lt": lambda: at < F.lit(value), "lte": lambda: at <= F.lit(value),
            "in": lambda: at.isin(*value), "between": lambda: at.between(*value), "regex": lambda: at.cast("string").rlike(value),
        }
    return F.coalesce(kinds[op](), F.lit(False)) if op in kinds else F.lit(False)


def apply_rules(df: DataFrame, ruleset: dict, paths: dict[str, Column], strict: bool = True) -> DataFrame:
    """df with confidence, status, applied array<string> and trace array<string> after all rules, in order.

    Later actions see what earlier ones left. A rule in shadow mode is applied and traced, but changes nothing.
    Confidence is held within 0 and 1 at the end only.
    """
    confidence = F.lit(float(ruleset.get("defaults", {}).get("baseConfidence", 1.0)))
    status, none = F.lit("ok"), F.array().cast("array<string>")
    applied, trace = none, none
    for rule in ruleset.get("rules", []):
        if not rule.get("enabled"):
            continue
        hit, name = condition(rule["when"], paths, strict), rule["ruleId"]
        applied = F.concat(applied, F.when(hit, F.array(F.lit(name))).otherwise(none))
        marks: list[str] = []
        if rule.get("mode") == "shadow":
            marks.append("shadow_match")
        else:
            for action in rule.get("then", {}).get("actions", []):
                kind = action.get("type")
                if kind == "penalize_confidence":
                    confidence = F.when(hit, confidence - float(action.get("value") or 0)).otherwise(confidence)
                elif kind == "set_status":
                    status = F.when(hit, action.get("value")).otherwise(status) if action.get("value") else status
                elif kind == "require_review":
                    status = F.when(hit, "needs_review").otherwise(status)
                marks.append(kind if kind in ("penalize_confidence", "set_status", "emit_trace", "require_review") else "unknown_action")
        trace = F.concat(trace, F.when(hit, F.array(*[F.lit(f"{name}:{m}") for m in marks]).cast("array<string>")).otherwise(none))
    return df.withColumns(
        {"confidence": F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)), "status": status, "applied": applied, "trace": trace}
    )


def item_issues(df: DataFrame) -> DataFrame:
    """Items with issues array<struct<rule, severity>>, base_confidence and base_label.

    df: title, url, has_price, price_text (null where the amount is not given), sku. A price of a bare number, which has no
    amount, is one with has_price and no price_text.
    """
    amount = F.when(F.col("price_text") == "", 0.0).otherwise(F.col("price_text").try_cast("double"))
    numeric = F.col("has_price") & F.col("price_text").isNotNull() & amount.isNotNull()
    issue = lambda bad, rule, severity: F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity")))
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    found = F.array_compact(
        F.array(
            issue(empty("title"), "R-TITLE-REQUIRED", "high"),
            issue(empty("url"), "R-URL-REQUIRED", "high"),
            issue(F.col("has_price") & ~numeric, "R-PRICE-NUMERIC", "medium"),
            issue(numeric & (amount <= 0), "R-PRICE-POSITIVE", "high"),
            issue((F.coalesce("sku", F.lit("")) != "") & (F.length(F.trim("sku")) < 2), "R-SKU-TOO-SHORT", "low"),
        )
    )
    of = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s))
    base = F.greatest(F.lit(0.0), 1 - 0.15 * of("high") - 0.08 * of("medium") - 0.03 * of("low"))
    label = F.when(F.size("issues") == 0, "valid").when(F.col("base_confidence") < 0.6, "ambiguous").otherwise("invalid")
    return df.withColumn("issues", found).withColumn("base_confidence", base).withColumn("base_label", label)


def with_loss(df: DataFrame) -> DataFrame:
    """Items after item_issues with item_confidence, loss_penalty and label, by avg_loss_score and item_loss (null if unknown)."""
    clamp = lambda c: F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    penalty = clamp(clamp(F.col("item_loss")) * LOSS_ALPHA + clamp(clamp(F.col("avg_loss_score")) * LOSS_ALPHA))
    adjusted = F.greatest(F.lit(LOSS_FLOOR), clamp(F.col("base_confidence") - F.col("loss_penalty")))
    severity = F.when(F.col("loss_penalty") >= 0.25, "high").when(F.col("loss_penalty") > 0, "medium")
    label = F.when((F.col("base_label") == "valid") & (F.col("item_confidence") < 0.6), "ambiguous").otherwise(F.col("base_label"))
    out = df.withColumn("loss_penalty", penalty).withColumn("item_confidence", adjusted)
    return out.withColumns({"loss_severity": severity, "label": label})


def suggestions_allowed(types: Column) -> Column:
    """Suggestion types that the guardian does not allow."""
    return F.array_except(types, F.array(*map(F.lit, ("fix_field", "add_field", "needs_review"))))


def summarize(items: DataFrame, request: str = "request_id") -> DataFrame:
    """By request: status, decision, worst confidence, before the policy is merged in."""
    g = items.groupBy(request).agg(
        F.least(F.lit(1.0), F.min("item_confidence")).alias("worst"),
        F.bool_or(F.col("label") != "valid").alias("any_invalid"),
        F.max(F.coalesce("avg_loss_score", F.lit(0.0))).alias("avg_loss_score"),
        F.sum(F.coalesce("violations", F.lit(0))).alias("violations"),
    )
    weak = F.col("any_invalid") & (F.col("worst") < 0.6)
    lossy = ~weak & (F.col("avg_loss_score") >= REVIEW_LOSS)
    review = weak | lossy
    return g.withColumns(
        {
            "status": F.when(F.col("violations") > 0, "blocked").when(review, "needs_review").otherwise("ok"),
            "decision": F.when(F.col("violations") > 0, "blocked").when(review, "partial").otherwise("exportable"),
            "loss_penalty": F.round(F.least(F.col("avg_loss_score") * LOSS_ALPHA, F.lit(1.0)), 4),
        }
    )


def merge_policy(summary: DataFrame) -> DataFrame:
    """summary with policy_status and policy_confidence merged in: a policy status that is not ok wins."""
    return summary.withColumns(
        {
            "status": F.when(F.col("policy_status") != "ok", F.col("policy_status")).otherwise(F.col("status")),
            "confidence": F.round(F.least("worst", F.coalesce("policy_confidence", "worst")), 4),
        }
    )


def decisions(policy: DataFrame, mode: str = "active") -> DataFrame:
    """policy (request_id, confidence, status, applied, timestamp) with the columns of a decision and its JSON."""
    action = F.when(F.col("status") == "blocked", "block_output").when(F.col("status") == "needs_review", "require_review").otherwise("allow")
    review = F.col("status") == "needs_review"
    risk = F.when(F.col("status") == "blocked", "critical").when(review & (F.col("confidence") < 0.8), "high").when(review, "medium").otherwise("low")
    notes = F.when(F.size("applied") == 0, "No governance rule triggered.").otherwise(F.concat(F.lit("Applied rules: "), F.array_join("applied", ", ")))
    change = F.round(F.col("confidence") - 1, 4)
    quoted = F.transform("applied", lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    number = F.when(F.col("confidence_adjustment") == F.floor("confidence_adjustment"), F.format_string("%d", F.col("confidence_adjustment").cast("long"))).otherwise(
        F.col("confidence_adjustment").cast("string")
    )
    out = policy.withColumns(
        {
            "decision_id": F.concat(F.lit("dec_"), "request_id"), "action": action, "mode": F.lit("shadow" if mode == "shadow" else "active"),
            "risk_level": risk, "confidence_adjustment": change, "notes": notes,
        }
    )
    text = F.concat(
        F.lit('{"decision_version":"1.0","decision_id":"'), "decision_id", F.lit('","timestamp":"'), "timestamp", F.lit('","rules_triggered":['),
        F.array_join(quoted, ","), F.lit('],"action":"'), "action", F.lit('","mode":"'), "mode", F.lit('","risk_level":"'), "risk_level",
        F.lit('","confidence_adjustment":'), number, F.lit(',"notes":"'), "notes", F.lit('"}'),
    )
    return out.withColumn("decision_json", text)


def reports(decided: DataFrame) -> DataFrame:
    """decisions with avg_loss_score, and the figures of a report: risk_score, loss_penalty, actions_taken, decision_hash."""
    penalty = F.round(1 - F.col("confidence"), 4)
    actions = F.array_compact(
        F.array(
            F.when(F.col("action") == "require_review", "set_status"),
            F.when(penalty > 0, "penalize_confidence"),
            F.when(F.size("trace") > 0, "log_trace_event"),
        )
    )
    return decided.withColumns(
        {
            "report_id": F.concat(F.lit("gov-report-"), "request_id"),
            "risk_score": F.round(F.greatest("avg_loss_score", 1 - F.col("confidence")), 4),
            "report_loss_penalty": penalty,
            "actions_taken": F.when(F.size(actions) == 0, F.array(F.lit("none"))).otherwise(actions),
            "decision_hash": rolling_hash(F.col("decision_json")),
        }
    )


def context(loss: Column, conflicts: Column) -> Column:
    """struct<avgLossScore, conflicts> that conditions read; 0 where nothing is known."""
    return F.struct(F.coalesce(loss, F.lit(0.0)).alias("avgLossScore"), F.coalesce(conflicts, F.lit(0)).alias("conflicts"))


def normalized(confidence: Column, status: Column, reasons: Column) -> Column:
    """struct<confidence, status, reasons>: confidence from 0 to 1, 1 if unknown; status ok and no reasons if unknown."""
    return F.struct(
        F.least(F.greatest(F.coalesce(confidence, F.lit(1.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.coalesce(F.nullif(status, F.lit("")), F.lit("ok")).alias("status"),
        F.coalesce(reasons, F.array().cast("array<string>")).alias("reasons"),
    )


def rule_rows(spark: SparkSession, ruleset: dict) -> DataFrame:
    """rule_id, pos, enabled, op, path, value and actions of a rule set's rules."""
    rows = [
        (r["ruleId"], k, bool(r.get("enabled")), r["when"].get("op"), r["when"].get("path"), None if r["when"].get("value") is None else float(r["when"]["value"]), [a.get("type") for a in r.get("then", {}).get("actions", [])])
        for k, r in enumerate(ruleset.get("rules", []))
    ]
    return spark.createDataFrame(rows, "rule_id string, pos int, enabled boolean, op string, path string, value double, actions array<string>")


def reviewed(rules: DataFrame, review: str) -> DataFrame:
    """Candidate rules with their state, proposed where there is none; rejected ones go, unknown states raise no rule."""
    state = rules.withColumn(review, F.coalesce(F.nullif(review, F.lit("")), F.lit("proposed")))
    return state.filter(F.col(review).isin("proposed", "approved"))
