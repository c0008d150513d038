from pyspark.sql import functions as F

from tablewright.operators import matching, policy

ITEM = "request_id string, item_id string, title string, url string, has_price boolean, price_text string, sku string, avg_loss_score double, item_loss double"
PATHS = {"$.loss.avgLossScore": "loss", "$.manifest.summary.conflictsResolved": "conflicts"}


def paths():
    return {k: F.col(v) for k, v in PATHS.items()}


def state(spark, loss, mode="active"):
    df = spark.createDataFrame([("demo-normal-001", loss, None)], "request_id string, loss double, conflicts long")
    return policy.apply_rules(df, policy.shadowed(policy.RULESET, mode), paths())


def test_golden_decision_and_report(spark):
    df = state(spark, 0.02).withColumns({"timestamp": F.lit("2026-03-06T19:51:30.347Z"), "avg_loss_score": F.col("loss")})
    r = policy.reports(policy.decisions(df)).first()
    assert (r.decision_id, r.applied, r.action, r.mode, r.risk_level, r.confidence_adjustment) == (
        "dec_demo-normal-001", ["G-MISSING-SKU"], "require_review", "active", "medium", 0.0
    )
    assert r.notes == "Applied rules: G-MISSING-SKU"
    assert (r.risk_score, r.report_loss_penalty, r.actions_taken, r.decision_hash) == (0.02, 0.0, ["set_status", "log_trace_event"], "f41e772e")


def test_active_and_shadow_modes(spark):
    active = policy.decisions(state(spark, 0.38).withColumn("timestamp", F.lit("t"))).first()
    assert active.applied == ["G-LOSS-PENALTY", "G-MISSING-SKU"] and active.action == "require_review"
    assert active.confidence_adjustment == -0.2 and active.risk_level == "medium"
    shadow = policy.decisions(state(spark, 0.38, "shadow").withColumn("timestamp", F.lit("t")), "shadow").first()
    assert (shadow.action, shadow.risk_level, shadow.confidence_adjustment, shadow.mode) == ("allow", "low", 0.0, "shadow")
    assert shadow.applied == active.applied and all(t.endswith("shadow_match") for t in shadow.trace)


def test_loss_penalty_regression(spark):
    df = spark.createDataFrame([("demo", "1", "t", "u", True, "10", None, 0.4, None)], ITEM).withColumn("violations", F.lit(0))
    items = policy.with_loss(policy.item_issues(df))
    one = items.first()
    assert abs(one.item_confidence - 0.76) < 1e-9 and one.label == "valid" and one.loss_severity == "medium"
    s = policy.summarize(items).first()
    assert abs(s.loss_penalty - 0.24) < 1e-9 and (s.status, s.decision) == ("needs_review", "partial")


def test_wildcard_paths_are_missing_unless_given(spark):
    df = spark.createDataFrame([("S1",), (None,)], "sku string")
    rule = {"op": "missing", "path": "$.items[*].normalized.sku"}
    reference = df.select(policy.condition(rule, {}).alias("x")).collect()
    assert [r.x for r in reference] == [True, True]
    given = df.select(policy.condition(rule, {"$.items[*].normalized.sku": F.col("sku")}).alias("x")).collect()
    assert [r.x for r in given] == [False, True]


def test_bad_ruleset_has_no_rules():
    assert policy.load_ruleset("{") == policy.load_ruleset(None) == {"defaults": {"baseConfidence": 1.0}, "rules": []}
    assert policy.load_ruleset('{"rules": []}') == {"rules": []}


def test_match_scores(spark):
    rows = [("red widget", None), ("red bolt", None), ("blue bolt", None), ("redder ring", None)]
    df = spark.createDataFrame(rows, "name string, url string")
    score = lambda q: matching.match_score(F.array(*map(F.lit, q)).cast("array<string>"), F.col("name"), F.lit(""), F.lit("{}"), F.col("url"))
    assert [r.s for r in df.select(score(["red", "widget"]).alias("s")).collect()] == [100, 50, 0, 17]
    assert [r.s for r in df.select(score([]).alias("s")).collect()] == [0, 0, 0, 0]
    linked = spark.createDataFrame([("red", "u"), ("x", "u")], "name string, url string")
    assert [r.s for r in linked.select(score(["red"]).alias("s")).collect()] == [100, 2]
