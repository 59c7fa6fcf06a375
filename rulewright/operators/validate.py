"""Validation of rules and dataset records."""

from rulewright.sources.adapters import view

from .datagen import OPS as DATASETS

OPS: dict[str, str] = {}

# fixed values: operations, and which comparison operator suits which column type
OPERATIONS = "('exclude', 'include', 'restrict', 'map', 'replace', 'add', 'subtract')"
_TYPES = {"equals": "string integer boolean timestamp", "not_equals": "string integer boolean timestamp", "greater_than": "integer timestamp decimal", "less_than": "integer timestamp decimal", "greater_than_or_equal": "integer timestamp decimal",
          "less_than_or_equal": "integer timestamp decimal", "in": "string integer", "not_in": "string integer", "contains": "string", "is_null": "string integer boolean timestamp decimal", "is_not_null": "string integer boolean timestamp decimal"}
_OPERATORS = "(" + ", ".join(f"'{o}'" for o in _TYPES) + ")"
_SUITS = "CASE operator " + " ".join(f"WHEN '{o}' THEN instr(' {t} ', concat(' ', type, ' ')) > 0" for o, t in _TYPES.items()) + " ELSE FALSE END"
# fixed values: what a time window must name
_WINDOW = "(current|last|previous|today|yesterday|week|month|quarter|year|day|hour|mtd|qtd|ytd|rolling|trailing)"
# a condition has up to four tests, each counted as valid or invalid: its table (an unqualified or unknown one ends them),
# its column, its operator, and whether the operator suits the column's type
_CONDITION = f"""
SELECT c.rule_id, NOT qualified AS bad_field, qualified AND NOT known_table AS bad_table, qualified AND known_table AND type IS NULL AS bad_column, qualified AND known_table AND operator NOT IN {_OPERATORS} AS bad_operator,
  qualified AND known_table AND type IS NOT NULL AND operator IN {_OPERATORS} AND NOT ({_SUITS}) AS bad_type, qualified AND known_table AS reached, qualified AND known_table AND type IS NOT NULL AND operator IN {_OPERATORS} AS typed
FROM (SELECT c.rule_id, c.operator, instr(c.field, '.') > 0 AS qualified, t.table_name IS NOT NULL AS known_table, k.type FROM conditions c LEFT JOIN (SELECT DISTINCT domain, table_name FROM catalog) t ON t.domain = c.domain_id AND t.table_name = regexp_extract(c.field, '^([^.]*)[.]', 1)
  LEFT JOIN catalog k ON k.domain = c.domain_id AND concat(k.table_name, '.', k.column_name) = c.field) c"""
_CONDITIONS = f"""
SELECT rule_id, count_if(bad_field) + count_if(bad_table) + count_if(bad_column) + count_if(bad_operator) + count_if(bad_type) AS n_bad, count_if(reached) + count_if(reached AND NOT bad_column) + count_if(reached AND NOT bad_operator) + count_if(typed AND NOT bad_type) AS n_good,
  count_if(bad_table) = 0 AS table_exists, count_if(bad_column) = 0 AS column_exists, count_if(bad_field OR bad_table OR bad_column) = 0 AS field_to_table_relation, count_if(bad_operator) = 0 AS valid_operator, count_if(bad_type) = 0 AS valid_value_type FROM ({_CONDITION}) x GROUP BY rule_id"""
_ENTITIES = """
SELECT rule_id, count_if(known) AS n_good, count_if(NOT known) AS n_bad FROM (
  SELECT e.rule_id, e.domain_id, k.name IS NOT NULL AS known FROM (SELECT rule_id, domain_id, tok AS name FROM UNNEST{rules|rule_id, domain_id|split(entity_tables, ';')} a UNION ALL SELECT rule_id, domain_id, CASE WHEN instr(tok, '.') = 0 AND tok <> '' THEN concat('?', tok) ELSE tok END FROM UNNEST{rules|rule_id, domain_id|split(entity_columns, ';')} b) e
  LEFT JOIN (SELECT DISTINCT domain, table_name AS name FROM catalog UNION SELECT domain, concat(table_name, '.', column_name) FROM catalog) k ON k.domain = e.domain_id AND k.name = e.name WHERE e.name <> '') x GROUP BY rule_id"""
_TERM = "SELECT r.rule_id, count(g.term) > 0 AS known FROM rules r LEFT JOIN glossary g ON g.domain = r.domain_id AND (instr(lower(r.business_term), lower(g.term)) > 0 OR instr(lower(g.term), lower(r.business_term)) > 0) GROUP BY r.rule_id"
_CHECKED = f"""
SELECT r.rule_id, r.workspace_id, r.domain_id, coalesce(r.business_term, '') <> '' AND coalesce(r.operation, '') <> '' AS required_components, coalesce(r.business_term, '') <> '' AND t.known AS business_term_exists, coalesce(lower(r.operation) IN {OPERATIONS}, FALSE) AS valid_operation,
  coalesce(c.table_exists, FALSE) AS table_exists, coalesce(c.column_exists, FALSE) AS column_exists, coalesce(c.field_to_table_relation, FALSE) AS field_to_table_relation, coalesce(c.valid_operator, FALSE) AS valid_operator, coalesce(c.valid_value_type, FALSE) AS valid_value_type,
  coalesce(r.scope, 'global') = 'global' OR lower(r.scope) = lower(r.domain_id) OR s.table_name IS NOT NULL AS valid_scope, r.time_window IS NULL OR RLIKE(lower(r.time_window), '{_WINDOW}') AS valid_time_window,
  r.time_window IS NOT NULL AS has_window, coalesce(r.business_term, '') <> '' AS has_term, coalesce(r.operation, '') <> '' AS has_operation, coalesce(c.n_good, 0) + coalesce(e.n_good, 0) AS n_good, coalesce(c.n_bad, 0) + coalesce(e.n_bad, 0) AS n_bad
FROM rules r JOIN ({_TERM}) t ON t.rule_id = r.rule_id LEFT JOIN ({_CONDITIONS}) c ON c.rule_id = r.rule_id LEFT JOIN ({_ENTITIES}) e ON e.rule_id = r.rule_id LEFT JOIN (SELECT DISTINCT domain, table_name FROM catalog) s ON s.domain = r.domain_id AND s.table_name = lower(r.scope)"""
_CHECKS = ("required_components", "business_term_exists", "valid_operation", "table_exists", "column_exists", "field_to_table_relation", "valid_operator", "valid_value_type", "valid_scope", "valid_time_window")
_one = lambda test: f"CASE WHEN {test} THEN 1 ELSE 0 END"
_GOOD = f"n_good + {_one('business_term_exists')} + {_one('valid_operation')} + {_one('valid_scope')} + {_one('has_window AND valid_time_window')}"
_BAD = f"n_bad + {_one('has_term AND NOT business_term_exists')} + {_one('has_operation AND NOT valid_operation')} + {_one('NOT valid_scope')} + {_one('NOT valid_time_window')}"
_VALIDATED = f"""
SELECT rule_id, workspace_id, domain_id, {", ".join(_CHECKS)}, {" + ".join(map(_one, _CHECKS))} AS checks_passed, CASE WHEN required_components THEN 10 ELSE 11 END AS checks_total, valid AS n_validated, invalid AS n_invalid, round(CAST(valid AS DOUBLE) / greatest(valid + invalid, 1), 3) AS coverage,
  CASE WHEN NOT required_components THEN 'FAIL' WHEN invalid = 0 THEN 'PASS' WHEN CAST(valid AS DOUBLE) / (valid + invalid) >= 0.5 THEN 'PARTIAL' ELSE 'FAIL' END AS status, column_exists AND table_exists AND field_to_table_relation AS fields_known
FROM (SELECT x.*, {_GOOD} AS valid, {_BAD} AS invalid FROM ({_CHECKED}) x) y"""
OPS["val_01_schema"] = _VALIDATED
OPS["val_02_rollup"] = f"""
SELECT workspace_id, domain_id, CASE WHEN bool_and(status = 'PASS') THEN 'PASS' WHEN bool_or(status IN ('PASS', 'PARTIAL')) THEN 'PARTIAL' ELSE 'FAIL' END AS status, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' ELSE 'PASS' END AS strict_status,
  round(avg(coverage), 6) AS mean_coverage, count_if(NOT fields_known) AS n_unknown_fields FROM ({_VALIDATED}) v GROUP BY workspace_id, domain_id"""
# what is no rule has no status; every rule of a feedback counts once
OPS["val_02_feedback"] = f"""
SELECT f.feedback_id, CASE WHEN f.n_rules = 0 THEN 'N/A' WHEN f.n_pass = f.n_rules THEN 'PASS' WHEN f.n_some > 0 THEN 'PARTIAL' ELSE 'FAIL' END AS status, CASE WHEN f.n_rules = 0 THEN 'N/A' WHEN f.n_fail > 0 THEN 'FAIL' WHEN f.n_pass = f.n_rules THEN 'PASS' ELSE 'PARTIAL' END AS strict_status,
  f.n_rules, coalesce(round(f.coverage, 6), CAST(0 AS DOUBLE)) AS mean_coverage, f.n_rules > 0 AND f.n_complete = f.n_rules AS mandatory_fields_valid, coalesce(f.n_errors, 0) AS n_errors
FROM (SELECT m.feedback_id, count(v.rule_id) AS n_rules, count_if(v.status = 'PASS') AS n_pass, count_if(v.status IN ('PASS', 'PARTIAL')) AS n_some, count_if(v.status = 'FAIL') AS n_fail, count_if(v.required_components) AS n_complete, avg(v.coverage) AS coverage, CAST(sum(v.n_invalid) AS BIGINT) AS n_errors
  FROM feedback_rules m LEFT JOIN ({_VALIDATED}) v ON v.rule_id = m.rule_id AND m.is_actionable GROUP BY m.feedback_id) f"""
view("feedback_rules", "SELECT DISTINCT feedback_id, rule_id, is_actionable FROM records")
OPS["val_03_gates"] = """
SELECT suggestion_id, CASE WHEN schema_status = 'FAIL' OR confidence < 0.3 THEN 'BLOCKED' WHEN schema_status = 'PARTIAL' OR confidence < 0.7 THEN 'REVIEW_REQUIRED' ELSE 'APPROVED' END AS gate,
  concat_ws(',', CASE WHEN schema_status = 'FAIL' THEN 'schema_fail' END, CASE WHEN schema_status = 'PARTIAL' THEN 'schema_partial' END, CASE WHEN confidence < 0.7 THEN 'low_confidence' END) AS reasons FROM suggestions"""
OPS["val_03_counts"] = f"SELECT gate, count(*) AS n, count_if(reasons <> '') AS with_reasons FROM ({OPS['val_03_gates']}) g GROUP BY gate"
# a rule's term and operation count once, each of its conditions' operators once; rules without conditions count too
OPS["val_04_taxonomy"] = f"""
SELECT r.domain_id, r.known_terms, r.known_operations, coalesce(c.known_operators, 0) AS known_operators, round((r.known_terms + r.known_operations + coalesce(c.known_operators, 0)) / CAST(2 * r.n + coalesce(c.n, 0) AS DOUBLE), 6) AS validity
FROM (SELECT x.domain_id, count(*) AS n, count_if(g.domain IS NOT NULL) AS known_terms, count_if(coalesce(x.operation, '') IN {OPERATIONS}) AS known_operations FROM rules x LEFT JOIN (SELECT DISTINCT domain, term FROM glossary) g ON g.domain = x.domain_id AND g.term = x.business_term GROUP BY x.domain_id) r
LEFT JOIN (SELECT domain_id, count(*) AS n, count_if(operator IN {_OPERATORS}) AS known_operators FROM conditions GROUP BY domain_id) c ON c.domain_id = r.domain_id"""
# fixed values: fields that every rule needs, those that an operation needs, and those that help
view("rule_presence", """
SELECT r.rule_id, coalesce(r.business_term, '') <> '' AS business_term, coalesce(r.operation, '') <> '' AS operation, coalesce(r.scope, '') <> '' AS scope, coalesce(c.n, 0) > 0 AS conditions, r.threshold IS NOT NULL AS threshold, coalesce(r.time_window, '') <> '' AS time_window,
  lower(coalesce(r.operation, '')) IN ('exclude', 'include', 'restrict') AS needs_conditions, lower(coalesce(r.operation, '')) = 'restrict' AS needs_threshold, d.text AS candidate
FROM new_rules r LEFT JOIN (SELECT rule_id, count(*) AS n FROM new_conditions GROUP BY rule_id) c ON c.rule_id = r.rule_id LEFT JOIN (SELECT rule_id, text FROM new_candidates WHERE pos = 0) d ON d.rule_id = r.rule_id""")
_LACKS = {"business_term": "NOT business_term", "operation": "NOT operation", "scope": "NOT scope"}
_NEEDS = {"conditions": "needs_conditions AND NOT conditions", "threshold": "needs_threshold AND NOT threshold"}
_names = lambda tests: ", ".join(f"CASE WHEN {t} THEN '{n}' END" for n, t in tests.items())
_PRESENT = " + ".join(f"CASE WHEN {t} THEN 1 ELSE 0 END" for t in ("business_term", "operation", "scope", "needs_conditions AND conditions", "threshold", "time_window"))
OPS["val_05_completeness"] = f"""
SELECT rule_id, missing = '' AND missing_for_operation = '' AS is_complete, missing, missing_for_operation, score FROM (SELECT rule_id, concat_ws(',', {_names(_LACKS)}) AS missing, concat_ws(',', {_names(_NEEDS)}) AS missing_for_operation, round(({_PRESENT}) / CAST(5 AS DOUBLE), 3) AS score FROM rule_presence) p"""
_SOME = " OR ".join([*_LACKS.values(), *_NEEDS.values()])
# a question for each gap, and one for the time where anything is missing; a phrase that was found is asked about twice
_QUESTIONS = [
    (0, "business_term", "high", "NOT business_term", "'Which term is the rule about, such as revenue or churn?'"), (1, "operation", "high", "NOT operation", "'What should happen, such as exclude, include or restrict?'"), (2, "scope", "high", "NOT scope", "'Where does the rule hold, such as global or region:1?'"),
    (3, "conditions", "high", f"{_NEEDS['conditions']} AND coalesce(candidate, '') <> ''", "concat('How can ', candidate, ' be told from the data?')"), (4, "conditions", "medium", f"{_NEEDS['conditions']} AND coalesce(candidate, '') <> ''", "concat('Which field says ', candidate, '?')"),
    (5, "conditions", "high", f"{_NEEDS['conditions']} AND candidate IS NULL", "'Under which conditions does the rule apply?'"), (6, "threshold", "high", _NEEDS["threshold"], "'Which number is the limit?'"), (7, "time_window", "medium", f"({_SOME}) AND NOT time_window", "'Does the rule hold for a certain time only?'"),
]
OPS["val_05_questions"] = " UNION ALL ".join(f"SELECT rule_id, {i} AS pos, '{field}' AS field, '{priority}' AS priority, {text} AS question FROM rule_presence WHERE {test}" for i, field, priority, test, text in _QUESTIONS)
# fixed values: words that are ambiguous wherever they stand, operations and scopes that are not
_VAGUE = "(some|certain|particular|specific|various|different|multiple|several|many|few|etc|and so on|etcetera|and others|and more)"
_CLEAR = "('exclude', 'include', 'restrict', 'map', 'replace', 'add', 'subtract', 'mask', 'expose', 'drop', 'keep')"
_DOUBTS = ("business_term", "operation", "conditions", "scope", "threshold")
_DOUBT = f"""
SELECT r.rule_id, RLIKE(lower(coalesce(r.business_term, '')), '{_VAGUE}') AS business_term, lower(coalesce(r.operation, '')) NOT IN {_CLEAR} AS operation, coalesce(c.vague, FALSE) AS conditions, lower(coalesce(r.scope, '')) <> 'global' AND NOT RLIKE(lower(coalesce(r.scope, '')), '^(region|time):') AS scope,
  coalesce(r.threshold <= 0 OR r.threshold > 1000000, FALSE) AS threshold FROM rules r LEFT JOIN (SELECT rule_id, bool_or(RLIKE(lower(coalesce(field, '')), '{_VAGUE}') OR RLIKE(lower(coalesce(value, '')), '{_VAGUE}')) AS vague FROM conditions GROUP BY rule_id) c ON c.rule_id = r.rule_id"""
OPS["val_06_ambiguity"] = f"""
SELECT rule_id, concat_ws(',', {", ".join(f"CASE WHEN {d} THEN '{d}' END" for d in _DOUBTS)}) AS ambiguous_fields, round(({" + ".join(f"CASE WHEN {d} THEN 1 ELSE 0 END" for d in _DOUBTS)}) / CAST(5 AS DOUBLE), 3) AS score,
  concat_ws(' ', CASE WHEN business_term THEN 'Which business concept is meant?' END, CASE WHEN operation THEN 'What should happen to these records?' END, CASE WHEN conditions THEN 'Which exact field and value?' END, CASE WHEN scope THEN 'Where does the rule hold?' END, CASE WHEN threshold THEN 'Which number is meant?' END) AS questions FROM ({_DOUBT}) d"""
OPS["val_07_mandatory_guard"] = "SELECT suggestion_id, coalesce(trim(business_term), '') = '' OR coalesce(trim(operation), '') = '' OR coalesce(trim(scope), '') = '' OR n_tables = 0 AS needs_clarification, CASE WHEN n_tables = 0 THEN NULL ELSE nullif(trim(business_term), '') END AS business_term FROM suggestions"
# fixed values: the types, categories and operations that a record may have
_RECORD_TYPES = "('business_rule', 'issue_report', 'feature_request', 'question', 'general_feedback', 'irrelevant_spam')"
_RECORD_CATEGORIES = "('metric_definition', 'filter_rule', 'mapping_rule', 'access_rule', 'join_rule', 'data_quality_rule')"
view("expected_validity", DATASETS["gen_09_expected_validity"])
view("known_fields", "SELECT DISTINCT domain, concat(table_name, '.', column_name) AS field FROM catalog")
# an unknown field is an error, unless the record is there to fail; what its context lists beyond the catalog is a warning
_RECORD = f"""
SELECT feedback_id, rule_family_id, concat_ws(',', CASE WHEN coalesce(feedback_id, '') = '' THEN 'missing_id' END, CASE WHEN coalesce(rule_family_id, '') = '' THEN 'missing_family' END, CASE WHEN feedback_text IS NULL OR trim(feedback_text) = '' THEN 'missing_text' END,
    CASE WHEN feedback_type NOT IN {_RECORD_TYPES} THEN 'unknown_type' END, CASE WHEN rule_category NOT IN {_RECORD_CATEGORIES} THEN 'unknown_category' END, CASE WHEN operation NOT IN {OPERATIONS} THEN 'unknown_operation' END,
    CASE WHEN feedback_type = 'business_rule' AND rule_category IS NULL THEN 'rule_without_category' END, CASE WHEN is_actionable AND NOT requires_clarification AND feedback_type = 'business_rule' AND rule_id IS NULL THEN 'rule_missing' END, CASE WHEN is_actionable <> (feedback_type = 'business_rule') THEN 'label_mismatch' END,
    CASE WHEN is_actionable AND used_field <> context_field THEN 'field_outside_context' END, CASE WHEN NOT used_known AND NOT may_fail THEN 'unknown_field' END) AS errors,
  concat_ws(',', CASE WHEN NOT used_known AND may_fail THEN 'unknown_field_allowed' END, CASE WHEN NOT context_known THEN 'context_outside_catalog' END, CASE WHEN instr(coalesce(rule_id, ''), feedback_id) > 0 THEN 'id_in_rule' END) AS warnings
FROM (SELECT r.*, u.field IS NOT NULL AS used_known, c.field IS NOT NULL AS context_known, coalesce(e.schema_expected = 'fail', FALSE) AS may_fail FROM records r LEFT JOIN known_fields u ON u.domain = r.domain AND u.field = r.used_field LEFT JOIN known_fields c ON c.domain = r.domain AND c.field = r.context_field
  LEFT JOIN expected_validity e ON e.feedback_id = r.feedback_id) x"""
OPS["val_08_records"] = _RECORD
OPS["val_09_accept_reject"] = f"""
SELECT feedback_id, n_same, CASE WHEN errors <> '' THEN 'rejected' ELSE 'accepted' END AS outcome, concat_ws(',', nullif(errors, ''), CASE WHEN n_same > 1 THEN 'duplicate_id' END) AS reason
FROM (SELECT *, count(*) OVER (PARTITION BY feedback_id) AS n_same FROM ({_RECORD}) r) x"""
OPS["val_10_consistency"] = """
SELECT rule_family_id, count(DISTINCT feedback_type) AS n_types, count(DISTINCT rule_category) AS n_categories, count(DISTINCT concat(business_term, '|', operation)) AS n_rules FROM records WHERE rule_family_id NOT LIKE 'multi_%'
GROUP BY rule_family_id HAVING count(DISTINCT feedback_type) > 1 OR count(DISTINCT rule_category) > 1 OR count(DISTINCT concat(business_term, '|', operation)) > 1"""
# lists of rules as they come from several files: an id may be there twice, or missing
view("listed_rules", "SELECT rule_id, operation, rule_no AS place FROM rules UNION ALL SELECT CASE WHEN rule_no % 100 = 20 THEN NULL ELSE substring(rule_id, 1, 6) || '0' END, operation, rule_no + 100000 FROM new_rules")
OPS["val_11_rule_lists"] = f"""
SELECT rule_id, 'duplicate_id' AS issue, min(place) AS place FROM listed_rules WHERE coalesce(rule_id, '') <> '' GROUP BY rule_id HAVING count(*) > 1
UNION ALL SELECT rule_id, 'missing_id', place FROM listed_rules WHERE coalesce(rule_id, '') = ''
UNION ALL SELECT rule_id, 'unknown_operation', place FROM listed_rules WHERE coalesce(operation, '') NOT IN {OPERATIONS}
UNION ALL SELECT c.rule_id, 'unknown_column', c.pos FROM conditions c WHERE NOT EXISTS (SELECT 1 FROM catalog k WHERE k.domain = c.domain_id AND concat(k.table_name, '.', k.column_name) = c.field)"""
OPS["val_12_strict"] = """
SELECT r.rule_id, RLIKE(r.scope, '^(global|regional|departmental|region:[1-9]|time:.+)$') AS scope_ok, g.term IS NOT NULL OR r.business_term IN ('revenue', 'orders', 'customers', 'sales', 'profit') AS term_ok, r.operation IN ('exclude', 'include', 'restrict', 'map', 'replace', 'add', 'subtract', 'multiply', 'divide', 'filter', 'calculate') AS operation_ok
FROM rules r LEFT JOIN glossary g ON g.domain = r.domain_id AND g.term = r.business_term"""
# fixed values of the form that needs neither catalog nor glossary
OPS["val_12_last_resort"] = """
SELECT rule_id, n_good, n_bad, mandatory_ok, round(n_good / CAST(greatest(n_good + n_bad, 1) AS DOUBLE), 3) AS coverage, CASE WHEN n_bad = 0 AND mandatory_ok THEN 'PASS' WHEN n_good > 0 AND 2 * n_good >= n_good + n_bad THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM (
  SELECT r.rule_id, coalesce(r.business_term, '') <> '' AND coalesce(r.operation, '') <> '' AND coalesce(r.scope, '') <> '' AS mandatory_ok,
    CASE WHEN lower(r.business_term) IN ('revenue', 'order', 'customer', 'product', 'payment') THEN 1 ELSE 0 END + CASE WHEN lower(r.operation) IN ('exclude', 'include', 'restrict', 'map', 'subtract') THEN 1 ELSE 0 END + CASE WHEN r.scope IN ('global', 'region:1', 'region:2') THEN 1 ELSE 0 END + coalesce(c.n_qualified, 0) AS n_good,
    CASE WHEN r.business_term <> '' AND lower(r.business_term) NOT IN ('revenue', 'order', 'customer', 'product', 'payment') THEN 1 ELSE 0 END + CASE WHEN r.operation <> '' AND lower(r.operation) NOT IN ('exclude', 'include', 'restrict', 'map', 'subtract') THEN 1 ELSE 0 END + CASE WHEN r.scope <> '' AND r.scope NOT IN ('global', 'region:1', 'region:2') THEN 1 ELSE 0 END + coalesce(c.n - c.n_qualified, 0) AS n_bad
  FROM rules r LEFT JOIN (SELECT rule_id, count(*) AS n, count_if(instr(coalesce(field, ''), '.') > 0) AS n_qualified FROM conditions GROUP BY rule_id) c ON c.rule_id = r.rule_id) x"""
