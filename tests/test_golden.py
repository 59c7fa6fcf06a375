"""Small inputs with results written down by hand."""

import pytest

from rulewright import operators


def feedback(spark, texts):
    return spark.createDataFrame([(i, "ws_0", None, 0, t) for i, t in enumerate(texts)], "feedback_id long, workspace_id string, created_at timestamp, submitted_by long, feedback_text string")


def column(spark, key, name, texts):
    return [r[name] for r in operators.apply(spark, key, feedback=feedback(spark, texts)).orderBy("feedback_id").collect()]


def test_rare_class_gate(spark):
    cases = {
        "Please add an export button to the dashboard": "feature_request", "It would be nice to have a dark chart": "feature_request", "Could we get a weekly digest": "feature_request", "Kindly give us a dark theme": "feature_request", "Can we get exports by region": "feature_request",
        "The invoice page shows wrong": "issue_report", "The dashboard seems broken": "issue_report", "The report keeps crashing": "issue_report", "The timer loads very slow": "issue_report", "Orders that are missing": None,
        "What is churn?": "question", "How do we count orders?": "question", "Should we exclude refunds?": "question", "Clarify whether trials are included": "question", "What is churn": None,
        "Revenue should exclude refunds from the report": None, "Only include active users": None, "Orders are counted daily": None, "Please show it: revenue should exclude the refund": "feature_request",
    }
    assert column(spark, "cls_04_rare_gate", "gate", list(cases)) == list(cases.values())


def test_pre_filter(spark):
    cases = {
        "": "empty_input", "  ": "empty_input", "ab": "gibberish", "12345 678 90 12": "gibberish", "asdf qwer zxcv tyui": "gibberish", "xj29 revenue zzz qqq cancelled blahhh 9281 asdfgh": "gibberish", "Revenue should exclude cancelled orders": "ok",
        "$$$ %% && a ###": "gibberish", "Buy cheap followers now at this link": "promo_spam_0", "gain many followers": "promo_spam_1", "get free likes and more": "promo_spam_2", "click here for a free prize": "promo_spam_3", "Include the last 30 days of US orders": "ok", "asdf refunds are wrong": "ok",
    }
    assert column(spark, "cls_02_gibberish", "reason", list(cases)) == list(cases.values())
    short = {"thanks": True, "Thank you": True, "Revenue should exclude refunds": False, "Buy cheap followers now at this link": False}
    assert column(spark, "cls_02_gibberish", "is_gibberish", list(short)) == list(short.values())


def test_pattern_classifier(spark):
    cases = {
        "The total must be net of tax": ("business_rule", "metric_definition", True, 0.9), "Agents should view only their tickets": ("business_rule", "access_rule", True, 0.85), "A phase of nine equals closed": ("business_rule", "mapping_rule", True, 0.88),
        "Remove every test order": ("business_rule", "filter_rule", True, 0.92), "Rows with empty names": ("business_rule", "data_quality_rule", True, 0.85), "Join users to the plan table": ("business_rule", "join_rule", True, 0.82), "Derive the price by weight": ("business_rule", "metric_definition", True, 0.85),
        "We like the new colours": ("business_rule", "metric_definition", False, 0.5), "How do we join the table": ("question", "join_rule", False, 0.3), "What should the total be": ("business_rule", "metric_definition", True, 0.9), "where status is cancelled": ("business_rule", "mapping_rule", True, 0.88),
        "asdf qwer zxcv tyui": ("irrelevant_spam", "metric_definition", False, 0.95),
    }
    got = operators.apply(spark, "cls_05_patterns", feedback=feedback(spark, list(cases))).orderBy("feedback_id").collect()
    assert [(r.feedback_type, r.rule_category, r.is_actionable, r.confidence) for r in got] == list(cases.values())


def test_cascade_and_its_sources(spark):
    texts = ["", "click here for a free prize", "The dashboard seems broken", "Revenue excludes refunds", "Revenue excludes refunds", "Revenue excludes refunds"]
    outputs = spark.createDataFrame([(i, "general_feedback", "filter_rule", c) for i, c in ((0, 0.9), (1, 0.9), (2, 0.9), (3, 0.8), (4, 0.5))], "feedback_id long, feedback_type string, rule_category string, confidence double")
    got = operators.apply(spark, "cls_06_cascade", feedback=feedback(spark, texts), model_outputs=outputs).orderBy("feedback_id").collect()
    assert [(r.feedback_type, r.provenance, r.confidence) for r in got] == [
        ("irrelevant_spam", "empty_input", 0.95), ("irrelevant_spam", "promo_spam", 0.95), ("issue_report", "gate", 0.9), ("general_feedback", "model", 0.8), ("business_rule", "low_confidence_fallback", 0.9), ("business_rule", "pattern", 0.9)]


def test_sensitivity(spark):
    rules = spark.createDataFrame([("a", "net_revenue", "access_rule"), ("b", "orders", "tax_rule"), ("c", "orders", None), ("d", None, "filter_rule")], "rule_id string, business_term string, rule_category string")
    conditions = spark.createDataFrame([("b", "orders.refund_id"), ("c", "orders.status"), ("a", "payments.charge")], "rule_id string, field string")
    got = {r.rule_id: (r.score, r.is_sensitive, r.reasons) for r in operators.apply(spark, "cls_11_sensitivity", rules=rules, conditions=conditions).collect()}
    assert got == {"a": (0.8, True, "term,field"), "b": (0.5, True, "category,field"), "c": (0.0, False, ""), "d": (0.0, False, "")}


def test_time_windows(spark):
    cases = {
        "in the last 30 days": "last_30_days", "over the last 2 weeks": "last_2_weeks", "over the last 3 months": "last_3_months", "this month": "current_month", "the current quarter": "current_quarter", "this week": "current_week", "current year": "current_year",
        "last month": "previous_month", "previous quarter": "previous_quarter", "last year": "previous_year", "year to date": "ytd", "MTD only": "mtd", "qtd": "qtd", "a rolling 7 days mean": "rolling_7_days", "trailing 12 months": "trailing_12_months", "today": "today", "yesterday": "yesterday",
        "whenever": None, "a rolling 7 day mean": "rolling_7_day", "last 5 days of this month": "last_5_days",
    }
    assert column(spark, "ext_09_time_window", "time_window", list(cases)) == list(cases.values())


def test_canonical_operations(spark):
    cases = {
        "Exclude refunds": "exclude", "It does not count towards revenue": "exclude", "It counts toward churn": "include", "It accounts for trials": "include", "Access should be limited to admins": "restrict", "rely on net price": "replace", "net out the fees": "subtract",
        "also account for tips": "add", "must not include trials": "exclude", "Nothing here": None,
    }
    assert column(spark, "ext_14_canonical_operation", "operation", list(cases)) == list(cases.values())


def test_masking(spark):
    docs = spark.createDataFrame([(1, "Mail jo@x.org or call 555-123-4567, (555) 123-4567 and 5551234567, SSN 123-45-6789 or 123456789, card 4111 1111 1111 1111")], "doc_id long, text string")
    # the phone pattern runs before the card's and takes what looks like a phone number
    assert operators.apply(spark, "txt_07_mask", documents=docs).first().masked == "Mail [EMAIL_REDACTED] or call [PHONE_REDACTED], ([PHONE_REDACTED] and [PHONE_REDACTED], SSN [SSN_REDACTED] or [SSN_REDACTED], card [CREDIT_CARD_REDACTED]"
    assert column(spark, "txt_07_log_text", "log_text", ["x" * 201, "short", None]) == ["x" * 200 + "...[TRUNCATED]", "short", "None"]


def test_redaction_by_key(spark):
    values = spark.createDataFrame([(1, "user.name", "jo@x.org", True), (1, "user.Email", "jo", True), (1, "session_token.part.0", "a", True), (1, "notes.0", "call 555-123-4567", True), (1, "n", "5551234567", False)], "feedback_id long, path string, value string, is_text boolean")
    got = {r.path: r.shown for r in operators.apply(spark, "txt_08_redact_keys", record_values=values).collect()}
    assert got == {"user.name": "[EMAIL_REDACTED]", "user.Email": "[REDACTED]", "session_token.part.0": "[REDACTED]", "notes.0": "call [PHONE_REDACTED]", "n": "5551234567"}


def test_spelling(spark):
    texts = ["Refunds shouldnt inlucde cancelld orders, pls", "dont, wont, cant", "fine"]
    assert column(spark, "txt_03_spelling", "corrected", texts) == ["Refunds should not includee cancelled orders, please", "do not, will not, cannot", "fine"]
    assert column(spark, "txt_03_spelling", "changes", texts) == ["shouldnt->should not,cancelld->cancelled,inlucde->include,includ->include", "wont->will not,cant->cannot,dont->do not", ""]
    assert column(spark, "txt_03_spelling", "has_shorthand", texts) == [True, False, False]


def test_step_log(spark):
    got = operators.apply(spark, "txt_02_step_log", feedback=feedback(spark, [" It's 5%.  Why? "])).orderBy("pos").collect()
    assert [(r.step, r.output, r.changes) for r in got] == [
        ("unicode_normalization", " It's 5%.  Why? ", "Normalized 16 chars to 16 chars"), ("whitespace_normalization", "It's 5%. Why?", "Collapsed whitespace, trimmed edges"), ("sentence_segmentation", "It's 5%. Why?", "Segmented into 2 sentences"),
        ("tokenization", "It's 5%. Why?", "Tokenized into 3 tokens"), ("punctuation_removal", "It s 5 . Why?", "Removed non-critical punctuation"),
        ("spelling_correction", "It s 5 . Why?", "No corrections needed"), ("language_normalization", "It s 5 . Why?", "No normalization needed")]


RULE = "rule_id string, rule_no long, workspace_id string, domain_id string, business_term string, operation string, scope string, affected_column string, entity_tables string, entity_columns string, threshold double"


def pair(spark, key, new, old, new_conditions=(), old_conditions=(), candidates=()):
    """One new rule against one old: new and old are (operation, scope, tables, columns)."""
    row = lambda i, r: (i, 1, "w", "d", "churn", r[0], r[1], "c", r[2], r[3], 1.0)
    conditions = lambda i, cs: spark.createDataFrame([(i, k, *c) for k, c in enumerate(cs)], "rule_id string, pos int, field string, operator string, value string")
    return operators.apply(spark, key, new_rules=spark.createDataFrame([row("n", new)], RULE), rules=spark.createDataFrame([row("o", old)], RULE), new_conditions=conditions("n", new_conditions), conditions=conditions("o", old_conditions),
                           new_candidates=spark.createDataFrame([("n", k, t) for k, t in enumerate(candidates)], "rule_id string, pos int, text string")).first()


BASE = ("exclude", "global", "orders", "orders.status")
IS = ("orders.status", "equals", "cancelled")
TWO = ("orders.region", "equals", "emea")


@pytest.mark.parametrize("new,old,a,b,c,want", [
    (BASE, BASE, [IS], [IS], [], ("exact_duplicate", 0.99)),
    (BASE, ("exclude", "global", "order", "orders.status"), [IS], [IS], [], ("exact_duplicate", 0.99)),
    (("exclude", "global", "a;b;c", "orders.status"), ("exclude", "global", "a;b;c;d", "orders.status"), [IS], [IS], [], ("semantic_duplicate", 0.95)),
    (BASE, BASE, [], [IS], [], ("semantic_duplicate", 0.85)),
    (BASE, ("exclude", "global", "tickets", "tickets.id"), [], [IS], ["where the order is late"], ("modification", 0.675)),
    (BASE, ("exclude", "global", "orders", "orders.total"), [], [IS], ["some of them"], ("extension", 0.7)),
    (BASE, BASE, [IS], [IS, TWO], [], ("extension", 0.8)),
    (("include", "global", "orders", "orders.status"), BASE, [IS], [IS, TWO], [], ("subset", 0.4)),
    (("include", "global", "orders", "orders.status"), BASE, [IS, TWO], [IS], [], ("superset", 0.375)),
    (("exclude", "regional", "orders", "orders.status"), BASE, [IS], [TWO], [], ("related_compatible", 0.2)),
    (("map", "regional", "orders", "orders.status"), BASE, [IS], [TWO], [], ("unrelated", 0.0)),
])
def test_relationship_ladder(spark, new, old, a, b, c, want):
    r = pair(spark, "sim_08_relationship", new, old, a, b, c)
    assert (r.relationship, r.confidence) == want


@pytest.mark.parametrize("new,old,a,b,c,want", [
    (BASE, BASE, [IS], [("orders.status", "not_equals", "cancelled")], [], ("direct", 0.95)),
    (BASE, BASE, [IS], [("orders.status", "equals", "open")], [], ("direct", 0.95)),
    (BASE, BASE, [("orders.status", "equals", "cancelled orders of all stores")], [IS], [], ("none", 0.0)),
    (("include", "global", "orders", "orders.status"), BASE, [IS], [TWO], [], ("direct", 0.85)),
    (("exclude", "regional", "orders", ""), ("exclude", "team", "orders", ""), [IS], [("orders.status", "not_equals", "x")], [], ("none", 0.0)),
    (BASE, ("exclude", "global", "tickets", ""), [], [IS], [], ("none", 0.0)),
    (("map", "global", "orders", ""), ("exclude", "global", "orders", ""), [IS, TWO], [IS], [], ("potential", 0.4)),
    (BASE, ("exclude", "global", "tickets", ""), [IS, TWO], [IS], [], ("related_compatible", 0.75)),
])
def test_conflict_ladder(spark, new, old, a, b, c, want):
    r = pair(spark, "sim_13_conflict", new, old, a, b, c)
    assert (r.kind, r.confidence) == want


def test_contradictions_and_their_reasons(spark):
    r = pair(spark, "sim_11_contradictions", BASE, BASE, [IS], [("status", "equals", "open")])
    assert (r.new_condition, r.existing_condition, r.reason) == ("orders.status equals cancelled", "status equals open", "Requires field to equal both cancelled and open")
    r = pair(spark, "sim_11_contradictions", BASE, BASE, [("orders.total", "greater_than", "9")], [("orders.total", "less_than", "5")])
    assert r.reason == "Requires field to be > 9 and < 5"
    assert pair(spark, "sim_11_contradictions", BASE, BASE, [("orders.total", "in", "9")], [("orders.total", "not_in", "5")]).reason == "Operators are contradictory"


def test_schema_checks(spark):
    rules = spark.createDataFrame([
        ("ok", "w", "shop", "net revenue", "exclude", "global", "orders", "orders.status", "ytd"), ("bad", "w", "shop", "weather", "paint", "moon", "clouds", "status", "whenever"),
        ("half", "w", "shop", "revenue", "exclude", "orders", "orders", "", None), ("none", "w", "shop", None, "exclude", None, "", "", None)],
        "rule_id string, workspace_id string, domain_id string, business_term string, operation string, scope string, entity_tables string, entity_columns string, time_window string")
    conditions = spark.createDataFrame([("ok", 0, "shop", "orders.status", "equals", "x"), ("bad", 0, "shop", "clouds.rain", "equals", "x"), ("half", 0, "shop", "orders.status", "greater_than", "1"), ("half", 1, "shop", "status", "equals", "1")], "rule_id string, pos int, domain_id string, field string, operator string, value string")
    catalog = spark.createDataFrame([("shop", "orders", "status", "string", "false", None)], "domain string, table_name string, column_name string, type string, nullable string, allowed string")
    glossary = spark.createDataFrame([("shop", "Revenue", "", "", 0)], "domain string, term string, definition string, ref string, pos int")
    got = {r.rule_id: r for r in operators.apply(spark, "val_01_schema", rules=rules, conditions=conditions, catalog=catalog, glossary=glossary).collect()}
    assert (got["ok"].status, got["ok"].checks_passed, got["ok"].checks_total, got["ok"].coverage) == ("PASS", 10, 10, 1.0)
    assert (got["bad"].status, got["bad"].checks_passed, got["bad"].coverage) == ("FAIL", 4, 0.0) and not got["bad"].table_exists and got["bad"].column_exists and not got["bad"].valid_time_window
    assert (got["half"].status, got["half"].valid_value_type, got["half"].field_to_table_relation, got["half"].valid_scope) == ("PARTIAL", False, False, True)
    assert (got["none"].status, got["none"].checks_total, got["none"].required_components) == ("FAIL", 11, False)


SUGGESTION = "suggestion_id string, suggestion_no long, workspace_id string, status string, confidence double, schema_status string, is_duplicate boolean, has_conflict boolean, sensitive boolean, needs_clarification boolean, mandatory_ok boolean, n_conditions int, n_tables int, scope string, operation string, rule_category string, business_term string"


def test_decision_table_and_route(spark):
    def row(i, **how):
        base = {"confidence": 0.95, "schema_status": "PASS", "is_duplicate": False, "has_conflict": False, "sensitive": False, "needs_clarification": False, "mandatory_ok": True} | how
        return (i, 1, "w", "x", *base.values(), 1, 1, "global", "exclude", "filter_rule", "t")

    cases = {
        "auto": ({}, "router", "auto_approved", True), "schema": ({"schema_status": "FAIL", "has_conflict": True}, "manual_review", "manual_review", False), "mandatory": ({"mandatory_ok": False}, "clarification", "clarification_required", False),
        "ask": ({"needs_clarification": True}, "clarification", "clarification_required", False), "low": ({"confidence": 0.5}, "manual_review", "manual_review", False), "poor": ({}, "manual_review", "manual_review", False),
        "dup": ({"is_duplicate": True, "has_conflict": True}, "reviewer_verification", "reviewer_verification", False), "conflict": ({"has_conflict": True}, "senior_review", "senior_review_required", False), "secret": ({"sensitive": True}, "senior_review", "senior_review_required", False),
        "calibrated": ({}, "manual_review", "manual_review", False),
    }
    suggestions = spark.createDataFrame([row(i, **how) for i, (how, *_) in cases.items()], SUGGESTION)
    fields = spark.createDataFrame([("poor", 0.2, 0.4, 0.6, None), ("calibrated", 0.9, 0.9, 0.9, 0.4)], "suggestion_id string, term double, operation double, condition_mean double, calibrated double")
    table = {r.suggestion_id: r.action for r in operators.apply(spark, "rte_01_decision_table", suggestions=suggestions, field_confidences=fields).collect()}
    route = {r.suggestion_id: (r.review_status, r.auto_approved) for r in operators.apply(spark, "rte_03_route", suggestions=suggestions, field_confidences=fields).collect()}
    assert table == {i: c[1] for i, c in cases.items()} and route == {i: c[2:] for i, c in cases.items()}


@pytest.mark.parametrize("step,to,ok", [("received", "validated", True), ("received", "approved", False), ("Senior_Review", "approved", True), ("auto_approved", "approved", False), ("analyzed", "rejected", True), ("rejected", "received", False), ("rule_activated", "archived", True)])
def test_lifecycle_edges(spark, step, to, ok):
    audit = spark.createDataFrame([("s", "w", 1, None, 1, step, to, 0.0)], "entity_id string, workspace_id string, step int, created_at timestamp, actor long, from_status string, to_status string, tie double")
    assert operators.apply(spark, "lif_01_transition_validity", audit=audit).first().is_valid is ok


def test_calibration_error_by_hand(spark):
    rows = [(0.95, 1, 1), (0.95, 1, 0), (0.55, 1, 1), (0.05, 0, 0), (0.05, 0, 0)]
    predictions = spark.createDataFrame([(i, e, p, 0, c, "en", "en", "m") for i, (c, e, p) in enumerate(rows)], "doc_id long, expected int, predicted int, expected_toxic int, confidence double, expected_lang string, predicted_lang string, model string")
    assert operators.apply(spark, "evl_04_ece", predictions=predictions).first().ece == pytest.approx((2 * 0.45 + 0.45 + 2 * 0.95) / 5)


def test_absent_class_divides_by_nothing(spark):
    predictions = spark.createDataFrame([(1, 1, 1, 0, 0.5, "a", "b", "m"), (2, 1, 1, 0, 0.5, "b", "b", "m")], "doc_id long, expected int, predicted int, expected_toxic int, confidence double, expected_lang string, predicted_lang string, model string")
    got = {r.label: (r.precision_, r.recall, r.f1, r.support) for r in operators.apply(spark, "evl_01_per_class", predictions=predictions).collect()}
    assert got == {"a": (0, 0, 0, 1), "b": (0.5, 1, pytest.approx(0.666667), 1)}


def records(spark, rows):
    return spark.createDataFrame([(f"FB{i}", i, t, "R1", "d", "churn", "exclude", family, kind, "filter_rule", True, False, "orders.status", "orders.status") for i, (t, family, kind) in enumerate(rows)],
                                 "feedback_id string, record_no long, feedback_text string, rule_id string, domain string, business_term string, operation string, rule_family_id string, feedback_type string, rule_category string, is_actionable boolean, requires_clarification boolean, used_field string, context_field string")


def test_families_of_duplicates_lose_no_record(spark):
    rows = [("x", "wide", "business_rule")] + [("x", "other", "business_rule")] * 5000 + [("x", "wide", "business_rule"), ("x", "alone", "business_rule")]
    got = operators.apply(spark, "gen_15_duplicate_pairs", records=records(spark, rows)).collect()
    by = {f: [r for r in got if r.rule_family_id == f] for f in ("wide", "other", "alone")}
    assert [len(by[f]) for f in by] == [2, 5000, 0] and {r.n_pairs for r in by["other"]} == {5000 * 4999 // 2}
    assert {(r.representative, r.feedback_id) for r in by["wide"]} == {("FB0", "FB0"), ("FB0", "FB5001")}


def test_a_rare_class_reaches_the_floor(spark):
    rows = [(f"rule {i}", "f", "business_rule") for i in range(60)] + [(f"why {i}? ", "f", "question") for i in range(4)]
    got = operators.apply(spark, "gen_07_top_up", records=records(spark, rows)).collect()
    assert {r.feedback_type for r in got} == {"question"} and sorted(r.place for r in got) == list(range(41)) and len({r.feedback_text for r in got}) == 36
    first = sorted(got, key=lambda r: r.place)
    assert len({r.feedback_id for r in first[:4]}) == 4 and all(r.feedback_text.startswith("why") and r.feedback_text.endswith("?") for r in first[:4]) and first[4].feedback_text == f"Hi, just reaching out: {first[0].feedback_text}"


def test_leaking_families(spark):
    splits = spark.createDataFrame([("a", "f", "train"), ("b", "f", "test"), ("c", "g", "train"), ("d", "g", "train"), ("e", "h", "val"), ("i", "h", "test"), ("j", "k", "val"), ("l", "k", "test")], "feedback_id string, rule_family_id string, split string")
    got = operators.apply(spark, "gen_20_leakage", given_splits=splits).collect()
    assert {(r.splits, r.n_families, r.example) for r in got} == {("test,train", 1, "f"), ("test,val", 2, "h")}


def test_every_condition_of_a_text(spark):
    text = "Exclude orders where status is cancelled and region is emea, the total should be above 10 and the fee is less than 2.5; over 7"
    got = operators.apply(spark, "ext_04_conditions", feedback=feedback(spark, [text])).collect()
    assert sorted((r.kind, r.place, r.field, r.operator, r.value) for r in got) == [
        (0, 0, "status", "equals", "cancelled"), (0, 1, "region", "equals", "emea"), (0, 2, "fee", "equals", "less"), (1, 0, "total", "greater_than", "10"), (1, 1, "fee", "less_than", "2.5"), (1, 2, "2.5", "greater_than", "7")]


def test_comparisons_wherever_they_stand(spark):
    texts = ["revenue is above 100", "Above 100 only", "orders, above 100", "10 over 100 items", "order count in 2024 above 5", "Size more than '3', (age) exceeds 4.5.", "net_total, is to be under 7", "the above", "orders.total contains \"x1\" and a matches b", None, ""]
    got = operators.apply(spark, "ext_04_conditions", feedback=feedback(spark, texts)).collect()
    assert sorted((r.feedback_id, r.kind, r.place, r.field, r.operator, r.value) for r in got) == [
        (0, 0, 0, "revenue", "equals", "above"), (0, 1, 0, "revenue", "greater_than", "100"), (1, 1, 0, "metric", "greater_than", "100"), (2, 1, 0, "orders", "greater_than", "100"), (3, 1, 0, "10", "greater_than", "100"), (4, 1, 0, "2024", "greater_than", "5"),
        (5, 1, 0, "size", "greater_than", "3"), (5, 1, 1, "age", "greater_than", "4.5"), (6, 1, 0, "net_total", "less_than", "7"), (8, 0, 0, "orders.total", "contains", "x1"), (8, 0, 1, "a", "equals", "b")]


def test_assembled_rules_hold_every_condition(spark):
    got = operators.apply(spark, "ext_12_assemble", feedback=feedback(spark, ["Exclude revenue where region is emea and total above 10", "Include it"])).collect()
    assert sorted((r.feedback_id, r.kind, r.field, r.value, r.n_conditions) for r in got if r.feedback_id == 0) == [(0, 0, "region", "emea", 2), (0, 1, "total", "10", 2)]
    assert [(r.field, r.n_conditions) for r in got if r.feedback_id == 1] == [(None, 0)]
    # term 0.95, operation 0.95, conditions 0.7, scope 0.8, entities 0.75
    assert all(r.overall == pytest.approx((0.95 + 0.95 + 0.7 + 0.8 + 0.75) / 5) for r in got if r.feedback_id == 0)


def test_synonyms_and_tables_are_grounded(spark):
    rules = spark.createDataFrame([("R", "ecommerce", "purchases;completed;customers")], "rule_id string, domain_id string, entity_tables string")
    conditions = spark.createDataFrame([("R", 0, "ecommerce", "order.status"), ("R", 1, "ecommerce", "orders.nothing"), ("R", 2, "ecommerce", "customers.region")], "rule_id string, pos int, domain_id string, field string")
    got = operators.apply(spark, "ext_17_ground", rules=rules, conditions=conditions).collect()
    assert sorted((r.pos, r.field, r.pruned, r.renamed) for r in got) == [
        (0, "orders.status", None, True), (1, None, "orders.nothing", False), (2, "customers.region", None, False), (1000, "orders", None, True), (1001, None, "completed", False), (1002, "customers", None, False)]


def test_every_reference_of_a_text(spark):
    texts = ['Use "net sales" FROM orders.total and `x y` where "a b" join a.b', "plain", None]
    got = operators.apply(spark, "txt_06_schema_references", feedback=feedback(spark, texts)).collect()
    assert sorted((r.feedback_id, r.kind, r.place, r.reference) for r in got) == [
        (0, "dotted", 0, "orders.total"), (0, "dotted", 1, "a.b"), (0, "keyword", 0, "FROM orders.total"), (0, "keyword", 1, 'where "a b"'), (0, "noun", 0, "join"), (0, "quoted", 0, "net sales"), (0, "quoted", 1, "x y"), (0, "quoted", 2, "a b")]


def test_quantiles_lie_between_the_edges(spark):
    log = spark.createDataFrame([("a", d) for d in (0.2, 0.3, 0.4, 0.45, 20.0)], "bucket string, duration double")
    got = {r.q: r.seconds for r in operators.apply(spark, "str_04_quantiles", request_log=log).collect()}
    assert got == {0.5: pytest.approx(0.25 + 0.25 * 1.5 / 3), 0.95: 10.0}


def test_acceptance_needs_all_eight(spark):
    good = {"classification_accuracy": 0.85, "extraction_f1": 0.8, "duplicate_precision": 0.9, "duplicate_recall": 0.9, "conflict_precision": 0.85, "conflict_recall": 0.85, "missed_conflict_rate": 0.05, "response_time": 1.99}
    rows = [("good", k, v) for k, v in good.items()] + [("slow", k, 2.0 if k == "response_time" else v) for k, v in good.items()] + [("part", "classification_accuracy", 0.9)]
    metrics = spark.createDataFrame(rows, "run string, name string, value double")
    assert {r.run: (r.n_passed, r.accepted) for r in operators.apply(spark, "evl_11_gate", run_metrics=metrics).collect()} == {"good": (8, True), "slow": (7, False), "part": (1, False)}
    promotion = {(r.base, r.candidate): (r.promote, r.n_regressed) for r in operators.apply(spark, "evl_12_promotion", run_metrics=metrics).collect()}
    assert promotion[("good", "slow")] == (True, 1) and promotion[("slow", "good")] == (True, 0)


def test_domain_needs_a_strong_score(spark):
    catalog = spark.createDataFrame([("ecommerce", "orders", "net_price", "t", "f", None), ("saas", "plans", "seat_id", "t", "f", None)], "domain string, table_name string, column_name string, type string, nullable string, allowed string")
    texts = ["revenue of orders by net price", "one error", "the subscription plan and its seat"]
    got = operators.apply(spark, "cls_09_domain", feedback=feedback(spark, texts), catalog=catalog).orderBy("feedback_id").collect()
    assert [r.domain for r in got] == ["ecommerce", None, "saas"] and got[0].score == 2 * 1.5 + 2 * 3 and got[1].confidence == 0


def test_glossary_documents(spark):
    document = "# Terms\n\n### churn\nDefinition: users who left\nTables/columns: `plans.status`, `plans.ended_at`\nRelated rules: R1, R2\n\n### seat\nDefinition: a place\n"
    got = operators.apply(spark, "src_03_glossary", glossary_documents=spark.createDataFrame([("saas", document)], "domain string, document string")).orderBy("pos").collect()
    assert [(r.term, r.definition, r.related, r.n_columns, r.first_column) for r in got] == [("churn", "users who left", "R1, R2", 2, "plans.status"), ("seat", "a place", "", 0, "")]


def test_bio_labels_by_priority(spark):
    texts = spark.createDataFrame([("f", "R1", "exclude net revenue where order status is cancelled, above 1,500  for emea")], "feedback_id string, rule_id string, t string")
    mentions = [(1, "BUSINESS_TERM", "net revenue"), (2, "FIELD", "order status"), (2, "FIELD", "order_status"), (3, "THRESHOLD", "1500"), (4, "VALUE", "cancelled"), (5, "OPERATION", "exclude"), (5, "OPERATION", "above"), (6, "SCOPE", "emea"), (9, "COLUMN", "status")]
    rows = spark.createDataFrame([("R1", *m) for m in mentions] + [("R2", 1, "BUSINESS_TERM", "where")], "rule_id string, priority int, label string, mention string")
    got = operators.apply(spark, "gen_18_bio", labelled_texts=texts, rule_mentions=rows).orderBy("place").collect()
    assert [(r.tok, r.label) for r in got] == [
        ("exclude", "B_OPERATION"), ("net", "B_BUSINESS_TERM"), ("revenue", "I_BUSINESS_TERM"), ("where", "O"), ("order", "B_FIELD"), ("status", "I_FIELD"), ("is", "O"), ("cancelled,", "B_VALUE"), ("above", "B_OPERATION"), ("1,500", "B_THRESHOLD"), ("for", "O"), ("emea", "B_SCOPE")]
    assert all("exclude net revenue where order status is cancelled, above 1,500  for emea"[r.start_offset : r.end_offset] == r.tok for r in got)


def test_inferred_conditions(spark):
    columns = ["orders.status", "orders.order_date", "orders.completed_at", "payments.status", "payments.settled_at", "products.is_active", "tags.name"]
    catalog = spark.createDataFrame([("ecommerce", *c.split("."), "t", "f", None) for c in columns], "domain string, table_name string, column_name string, type string, nullable string, allowed string")
    texts = {
        "Skip cancelled orders and failed transactions of the last 30 days": {("orders.status", "cancelled"), ("payments.status", "failed"), ("orders.order_date", "last_30_days")},
        "refunded refund, refunded orders; cancelled order": {("refunds.status", "refunded"), ("orders.status", "refunded"), ("orders.status", "cancelled")}, "active pending orders": {("orders.status", "pending")}, "cancelled tickets": set(),
        "payments of the current quarter and previous month": {("payments.settled_at", "current_quarter"), ("payments.settled_at", "previous_month")}, "tags of the current year": set(), "last 2 weeks": set(),
        "where is_active equals true and where colour is red": {("products.is_active", "true")}, "payment method is card": {("payments.payment_method", "card")}, "paid by card": set(),
        "orders that were cancelled": {("orders.status", "cancelled")}, "purchases that have been successfully completed": {("orders.status", "completed")}, "orders that got failed": set(), "successfully processed payments and successfully processed things": {("payments.status", "successful")},
        "cancelled orders, cancelled orders": {("orders.status", "cancelled")}, "returned products that were returned": {("products.is_active", "false")},
    }
    got = operators.apply(spark, "ext_18_infer", feedback=feedback(spark, list(texts)), catalog=catalog).collect()
    for i, (text, want) in enumerate(texts.items()):
        mine = [(r.field, r.value) for r in got if r.feedback_id == i]
        assert set(mine) == want and len(mine) == len(want), text
    assert {(r.family, r.confidence) for r in got} == {(1, 0.8), (2, 0.75), (3, 0.85), (4, 0.9), (5, 0.8), (6, 0.75)} and {r.operator for r in got} == {"equals"}


def tagged(spark, *texts):
    """Tokens written as word/TAG; a word without a tag is outside."""
    rows = []
    for n, text in enumerate(texts):
        words = [w.partition("/") for w in text.split()]
        whole = " ".join(w for w, _, _ in words)
        rows += [(n, i, w, f"B_{t}" if t else "O", "ecommerce", whole) for i, (w, _, t) in enumerate(words)]
    return spark.createDataFrame(rows, "feedback_id long, i int, tok string, label string, domain string, text string")


def test_components_from_tags(spark):
    texts = [
        "Cancelled/BUSINESS_TERM orders should/OPERATION not include/OPERATION status/FIELD equals/OPERATION open/VALUE",
        "premium/BUSINESS_TERM things of customers here", "total/BUSINESS_TERM nothing", "only/BUSINESS_TERM the refund", "revenue/BUSINESS_TERM must/OPERATION",
        "orders.total/FIELD exclude/OPERATION above/OPERATION 100/VALUE below/OPERATION 200/VALUE region/FIELD emea/VALUE with/VALUE x.y/VALUE",
        "orders/TABLE cancelled/VALUE customers/TABLE", "cancelled/VALUE for/VALUE open/VALUE", "status/FIELD a/VALUE open/VALUE status/FIELD open/VALUE",
    ]
    got = operators.apply(spark, "ext_19_from_tags", tagged_tokens=tagged(spark, *texts)).orderBy("feedback_id", "place").collect()
    rows = [(r.feedback_id, r.business_term, r.corrected_from, r.operation, r.field, r.operator, r.value, r.method) for r in got]
    assert rows == [
        (0, "Orders", "cancelled", "not include", "status", "EQUALS", "open", "explicit_field_value"), (1, "Customers", "premium", None, None, None, None, None), (2, "Nothing", "total", None, None, None, None, None), (3, "Refund", "only", None, None, None, None, None),
        (4, "revenue", None, "must", None, None, None, None), (5, None, None, "exclude", "orders.total", "ABOVE", "100", "explicit_field_value"), (5, None, None, "exclude", "orders.total", "BELOW", "200", "explicit_field_value"), (5, None, None, "exclude", "region", "EQUALS", "emea", "explicit_field_value"),
        (6, None, None, None, "orders.status", "EQUALS", "cancelled", "inferred_table_value"), (6, None, None, None, "customers.status", "EQUALS", "cancelled", "inferred_table_value"), (7, None, None, None, None, "EQUALS", "cancelled", "value_only"), (7, None, None, None, None, "EQUALS", "open", "value_only"),
        (8, None, None, None, "status", "EQUALS", "open", "explicit_field_value")]


def test_components_in_their_normal_form(spark):
    texts = [
        "Revenue,/BUSINESS_TERM does not/OPERATION status,/FIELD exceeds/OPERATION 5/VALUE purchases/TABLE", "Transactions.Fee/FIELD more/OPERATION 3/VALUE total/FIELD 4/VALUE", "ignore cancelled/VALUE", "we wonder open/VALUE in tickets.",
        "orders/TABLE customers/TABLE status/FIELD not include/OPERATION open/VALUE", "orders/TABLE orders/FIELD x/VALUE",
    ]
    got = operators.apply(spark, "ext_20_normalise_components", tagged_tokens=tagged(spark, *texts)).orderBy("feedback_id", "place").collect()
    rows = [(r.feedback_id, r.business_term, r.operation, r.field, r.operator, r.value, r.needs_clarification, r.affected_tables) for r in got]
    assert rows == [
        (0, "Revenue", "EXCLUDE", "orders.status", "GREATER_THAN", "5", False, "orders"), (1, None, "EXCLUDE", "payments.fee", "EQUALS", "3", False, "payments"), (1, None, "EXCLUDE", "payments.total", "EQUALS", "4", False, "payments"), (2, None, "EXCLUDE", None, "EQUALS", "cancelled", True, None),
        (3, None, None, None, "EQUALS", "open", True, None), (4, None, "EXCLUDE", "status", "EQUALS", "open", False, "customers;orders"), (5, None, None, "orders", "EQUALS", "x", False, "orders")]
    assert len({r.family_id for r in got if r.feedback_id == 1}) == 1 and len({r.family_id for r in got}) == 6


def part_stands(part, text):
    import re

    return re.search(rf"(?<![a-z0-9]){re.escape(part)}s?(?![a-z0-9])", text)


def test_glossary_terms_against_plain_loops(spark):
    """A list of 10,000 terms beside odd ones: parts that stand anywhere, plurals, short parts, blanks, signs, long words."""
    import random

    rng = random.Random(4)
    parts = ["order", "net", "revenue", "user", "trial", "churn", "id", "of", "seat", "plan", "region", "status", "open", "brand#12", "c++"]
    terms = list(dict.fromkeys(["_".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(300)] + ["new york", "a", "x_y", "cost of_sales"] + [f"term{i}_part{i % 97}_{i % 13}th" for i in range(10_000)]))
    texts = ["Net revenue of orders by user and plans", "the net_revenue_order of openings", "reopened trials: churns, seats", "brand#12 orders in new york", "cost of_sales c++ of status", "term77_part77_12th and part5 term5 of 5th", "x" * 500 + "net_revenue" + "y" * 300, "", None, "a"]
    glossary = spark.createDataFrame([("d", t, "", "", i) for i, t in enumerate(terms)], "domain string, term string, definition string, ref string, pos int")
    got = operators.apply(spark, "ext_01_glossary_match", feedback=feedback(spark, texts), glossary=glossary).collect()
    want = set()
    for i, text in enumerate(texts):
        low = (text or "").lower()
        for t in terms:
            own = [p for p in t.split("_") if len(p) > 2]
            if text is not None and t in low:
                want.add((i, t, len(t.split("_")), low.find(t)))
            elif text is not None and len(own) > 1 and all(part_stands(p, low) for p in own):
                want.add((i, t, len(own), min(part_stands(p, low).start() for p in own)))
    assert {(r.feedback_id, r.term, r.quality, r.place) for r in got} == want and len(got) == len(want) and len(want) > 50
    for i in range(len(texts)):
        ranked = [(-r.quality, -r.place, r.term) for r in sorted((r for r in got if r.feedback_id == i), key=lambda r: r.rn)]
        assert ranked == sorted(ranked)


def test_no_nested_loop_over_term_lists(spark, sf):
    for key in ("ext_01_glossary_match", "txt_05_keywords"):
        plan = operators.from_tables(spark, key, sf)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_keywords_are_words_or_their_singulars(spark):
    glossary = spark.createDataFrame([("d", t, "", "", 0) for t in ("company", "box", "class", "order_count")], "domain string, term string, definition string, ref string, pos int")
    got = operators.apply(spark, "txt_05_keywords", feedback=feedback(spark, ["Companies boxes class classs orders. status Order_count regions", "nothing"]), glossary=glossary).collect()
    assert [(r.feedback_id, r.keywords, r.n_keywords) for r in got] == [(0, "company box class status order_count region", 6)]


WHOLE_RULE = "rule_id string, rule_no long, workspace_id string, domain_id string, business_term string, operation string, scope string, threshold double, time_window string"


def test_completeness_and_a_question_for_every_gap(spark):
    rules = spark.createDataFrame([
        ("a", 1, "w", "d", "revenue", "exclude", "global", 1.0, "last_30_days"), ("b", 2, "w", "d", None, "", None, None, None), ("c", 3, "w", "d", "churn", "restrict", "global", None, None), ("e", 4, "w", "d", "churn", "map", "global", None, None)], WHOLE_RULE)
    conditions = spark.createDataFrame([("a", 0)], "rule_id string, pos int")
    found = spark.createDataFrame([("c", 0, "late orders")], "rule_id string, pos int, text string")
    inputs = {"new_rules": rules, "new_conditions": conditions, "new_candidates": found}
    got = {r.rule_id: (r.is_complete, r.missing, r.missing_for_operation, r.score) for r in operators.apply(spark, "val_05_completeness", **inputs).collect()}
    assert got == {"a": (True, "", "", 1.2), "b": (False, "business_term,operation,scope", "", 0.0), "c": (False, "", "conditions,threshold", 0.6), "e": (True, "", "", 0.6)}
    asked = [(r.rule_id, r.field, r.priority) for r in operators.apply(spark, "val_05_questions", **inputs).orderBy("rule_id", "pos").collect()]
    assert asked == [
        ("b", "business_term", "high"), ("b", "operation", "high"), ("b", "scope", "high"), ("b", "time_window", "medium"), ("c", "conditions", "high"), ("c", "conditions", "medium"), ("c", "threshold", "high"), ("c", "time_window", "medium")]


def test_a_feedback_without_rules_has_no_status(spark, sf):
    from rulewright.operators.fuzzy import view

    rules = view(spark, sf, "rules").limit(40)
    status = {r.rule_id: r.status for r in operators.apply(spark, "val_01_schema", rules=rules, conditions=view(spark, sf, "conditions")).collect()}
    by = {s: [i for i, t in status.items() if t == s] for s in set(status.values())}
    first, second = sorted(by)[:2]
    mapped = [("one", by[first][0], True), ("two", by[first][0], True), ("two", by[second][0], True), ("none", by[first][0], False), ("lost", "nowhere", True)]
    got = {r.feedback_id: r for r in operators.apply(spark, "val_02_feedback", rules=rules, conditions=view(spark, sf, "conditions"), feedback_rules=spark.createDataFrame(mapped, "feedback_id string, rule_id string, is_actionable boolean")).collect()}
    assert got["one"].status == first and got["none"].status == got["lost"].status == "N/A" and got["none"].mean_coverage == 0 and not got["none"].mandatory_fields_valid
    assert got["two"].n_rules == 2 and got["two"].status == ("PARTIAL" if {first, second} & {"PASS", "PARTIAL"} else "FAIL") and got["two"].strict_status == ("FAIL" if "FAIL" in (first, second) else "PARTIAL")


def test_terms_and_operations_count_once_a_rule(spark):
    rules = spark.createDataFrame([("a", 1, "w", "d", "revenue", "exclude", "global", 1.0, None), ("b", 2, "w", "d", "zyx", "fly", "global", 1.0, None)], WHOLE_RULE)
    conditions = spark.createDataFrame([("a", "d", o) for o in ("equals", "equals", "nearly")], "rule_id string, domain_id string, operator string")
    glossary = spark.createDataFrame([("d", "revenue", "", "", 0), ("d", "revenue", "", "", 1)], "domain string, term string, definition string, ref string, pos int")
    got = operators.apply(spark, "val_04_taxonomy", rules=rules, conditions=conditions, glossary=glossary).first()
    assert (got.known_terms, got.known_operations, got.known_operators, got.validity) == (1, 1, 2, round(4 / 7, 6))


def test_steps_of_a_text_in_order(spark):
    got = operators.apply(spark, "txt_02_step_log", feedback=feedback(spark, ["  Pls  shouldnt ~ count; pls thx. Ok? "])).orderBy("pos").collect()
    assert [r.step for r in got] == ["unicode_normalization", "whitespace_normalization", "sentence_segmentation", "tokenization", "punctuation_removal", "spelling_correction", "language_normalization"]
    assert all(b.input == a.output for a, b in zip(got[4:], got[5:])) and got[6].output == operators.apply(spark, "txt_01_processed", feedback=feedback(spark, ["  Pls  shouldnt ~ count; pls thx. Ok? "])).first().processed_text
    assert "should not" in got[5].output and got[6].output.endswith("please thanks. Ok?") and got[6].changes == "pls->please, thx->thanks"


def test_recommendations_follow_the_worst_conflict(spark, sf):
    got = operators.from_tables(spark, "sim_14_recommendations", sf).collect()
    found = {r.new_id: r for r in operators.from_tables(spark, "sim_14_conflict_rollup", sf).collect()}
    per = {}
    for r in got:
        per.setdefault(r.new_id, []).append(r)
    for new, rows in per.items():
        conflict = found.get(new)
        label = "Conflict" if conflict and conflict.has_conflict else "Compatible" if conflict and rows[0].label == "Compatible" else "No Conflict"
        assert {r.label for r in rows} == {label} and sorted(r.pos for r in rows) == list(range(1, len(rows) + 1)) and len(rows) == (1 if label == "No Conflict" else 3)


def test_names_of_rules(spark):
    rules = spark.createDataFrame([("R0000001", "map", "net_revenue"), ("R0000002", None, "net  revenue"), ("R0000003", "EXCLUDE_all", ""), ("RULE_ABCDEF12", " ", None), ("x", "unknown", "Unknown")], "rule_id string, operation string, business_term string")
    got = {r.rule_id: r.rule_name for r in operators.apply(spark, "txt_10_names", rules=rules).collect()}
    assert got == {"R0000001": "Map Net Revenue", "R0000002": "Rule Net Revenue", "R0000003": "Exclude All General", "RULE_ABCDEF12": "Rule ABCDEF12", "x": "Rule x"}


def test_last_resort_validation(spark):
    rules = spark.createDataFrame([("a", "Revenue", "exclude", "global"), ("b", "churn", "fly", "nowhere"), ("c", "order", None, "region:1"), ("d", None, None, None), ("e", "churn", "map", "global")], "rule_id string, business_term string, operation string, scope string")
    conditions = spark.createDataFrame([("a", "orders.status"), ("b", "status"), ("e", "status")], "rule_id string, field string")
    got = {r.rule_id: (r.status, r.coverage, r.mandatory_ok) for r in operators.apply(spark, "val_12_last_resort", rules=rules, conditions=conditions).collect()}
    assert got == {"a": ("PASS", 1.0, True), "b": ("FAIL", 0.0, True), "c": ("PARTIAL", 1.0, False), "d": ("FAIL", 0.0, False), "e": ("PARTIAL", 0.5, True)}


def test_errors_and_warnings_of_records(spark):
    columns = "feedback_id string, feedback_text string, rule_id string, domain string, operation string, rule_family_id string, feedback_type string, rule_category string, is_actionable boolean, requires_clarification boolean, used_field string, context_field string"
    good = ("f1", "text", "R1", "d", "exclude", "fam", "business_rule", "filter_rule", True, False, "t.c", "t.c")
    change = lambda i, **new: (f"f{i}", *(new.get(n, v) for n, v in zip([c.split()[0] for c in columns.split(", ")][1:], good[1:])))
    rows = [good, change(2, used_field="t.x", context_field="t.x"), change(3, used_field="t.x", context_field="t.x"), change(4, feedback_type="odd", rule_category="odd", operation="fly"), change(5, feedback_text=" ", rule_family_id=""), change(6, rule_id="xf6y"), change(7, rule_id=None)]
    catalog = spark.createDataFrame([("d", "t", "c", "string", "f", None)], "domain string, table_name string, column_name string, type string, nullable string, allowed string")
    expected = spark.createDataFrame([("f3", "fail")], "feedback_id string, schema_expected string")
    got = {r.feedback_id: (r.errors, r.warnings) for r in operators.apply(spark, "val_08_records", records=spark.createDataFrame(rows, columns), catalog=catalog, expected_validity=expected).collect()}
    assert got == {
        "f1": ("", ""), "f2": ("unknown_field", "context_outside_catalog"), "f3": ("", "unknown_field_allowed,context_outside_catalog"), "f4": ("unknown_type,unknown_category,unknown_operation,label_mismatch", ""), "f5": ("missing_family,missing_text", ""),
        "f6": ("", "id_in_rule"), "f7": ("rule_missing", "")}


def test_two_ways_to_say_a_rule_and_one_in_two_languages(spark, sf):
    from rulewright.operators import fixed

    got = operators.from_tables(spark, "gen_03_conversational", sf).collect()
    per = {}
    for r in got:
        per.setdefault(r.rule_id, []).append(r)
        head, tail = fixed.CONVERSATIONAL[r.way].split("{rule}")
        assert r.feedback_text.startswith(head) and r.feedback_text.endswith(tail)
    assert all(len({r.way for r in rows}) == 2 for rows in per.values()) and len({r.way for r in got}) == 8
    mixed = operators.from_tables(spark, "gen_03_code_mixed", sf).collect()
    assert len({r.rule_id for r in mixed}) == len(mixed) and {r.bank for r in mixed} == set(fixed.CODE_MIXED) and all(" mein " in f" {r.feedback_text}" or " se " in r.feedback_text or " ko " in r.feedback_text or " ka " in r.feedback_text for r in mixed)
