"""Review routing and clarification."""

from rulewright.sources.adapters import view

OPS: dict[str, str] = {}

# fixed values: rows of the decision table in order of priority: condition, action, reason. The calibrated confidence
# counts where there is one, and so does the mean of the fields' confidences.
_TABLE = [
    ("schema_status = 'FAIL'", "manual_review", "schema_validation_failed"), ("NOT mandatory_ok", "clarification", "missing_mandatory_fields"), ("needs_clarification", "clarification", "clarification_required"),
    ("coalesce(calibrated, confidence) < 0.6", "manual_review", "low_classification_probability"), ("extraction_mean < 0.5", "manual_review", "low_extraction_probability"), ("is_duplicate", "reviewer_verification", "duplicate_detected"),
    ("has_conflict", "senior_review", "conflict_detected"), ("sensitive", "senior_review", "sensitive_business_rule"),
]
_EXTRACTED = "SELECT s.*, (f.term + f.operation + f.condition_mean) / 3 AS extraction_mean, f.calibrated FROM suggestions s LEFT JOIN field_confidences f ON f.suggestion_id = s.suggestion_id"
_ACTION = "CASE " + " ".join(f"WHEN {test} THEN '{action}'" for test, action, _ in _TABLE) + " END"
_REASON = "CASE " + " ".join(f"WHEN {test} THEN '{reason}'" for test, _, reason in _TABLE) + " END"
OPS["rte_01_decision_table"] = f"SELECT suggestion_id, coalesce({_ACTION}, 'router') AS action, {_REASON} AS reason FROM ({_EXTRACTED}) e"
# fixed values: weights of the scores
_SCORES = f"""
SELECT s.*, least(1.0, least(0.4, 0.1 * n_conditions) + CASE scope WHEN 'global' THEN 0.1 WHEN 'regional' THEN 0.2 ELSE 0.15 END + CASE operation WHEN 'include' THEN 0.1 WHEN 'exclude' THEN 0.15 ELSE 0.2 END + least(0.15, 0.05 * n_tables)) AS complexity,
  least(1.0, CASE scope WHEN 'global' THEN 0.8 WHEN 'regional' THEN 0.7 ELSE 0.5 END + CASE WHEN rule_category = 'access_rule' THEN 0.2 ELSE 0 END + CASE WHEN n_tables > 2 THEN 0.1 ELSE 0 END) AS impact FROM ({_EXTRACTED}) s"""
_RISK = f"SELECT x.*, least(1.0, CASE WHEN has_conflict THEN 0.4 ELSE 0 END + CASE WHEN is_duplicate THEN 0.3 ELSE 0 END + 0.3 * complexity) AS risk FROM ({_SCORES}) x"
OPS["rte_02_scores"] = f"SELECT suggestion_id, round(CAST(complexity AS DOUBLE), 6) AS complexity, round(CAST(impact AS DOUBLE), 6) AS impact, round(CAST(risk AS DOUBLE), 6) AS risk FROM ({_RISK}) r"
# fixed values: approved automatically from 0.92 on, up to a complexity of 2, without a conflict or duplicate
_ELIGIBLE = "confidence >= 0.92 AND complexity <= 2 AND NOT has_conflict AND NOT is_duplicate"
_FIRST = [("NOT mandatory_ok", "mandatory_manual_review", "urgent", "manager"), ("sensitive", "senior_review_required", "urgent", "senior"), ("needs_clarification", "clarification_required", "high", "qa"), (_ELIGIBLE, "auto_approved", "auto_approved", "automated")]
_pick = lambda i: " ".join(f"WHEN {row[0]} THEN '{row[i]}'" for row in _FIRST)
_ROUTE = f"""
SELECT r.*, {_ELIGIBLE} AS eligible, CASE {_pick(1)} ELSE 'pending_review' END AS review_status,
  CASE {_pick(2)} WHEN (impact > 0.7 AND risk > 0.5) OR has_conflict THEN 'urgent' WHEN impact > 0.7 OR (confidence > 0.8 AND complexity > 0.5) THEN 'high' WHEN impact > 0.4 AND risk > 0.2 THEN 'normal' WHEN is_duplicate THEN 'high' ELSE 'low' END AS priority,
  CASE {_pick(3)} WHEN (impact > 0.7 AND risk > 0.5) OR has_conflict THEN 'senior' WHEN impact > 0.7 OR (confidence > 0.8 AND complexity > 0.5) THEN 'expert' WHEN impact > 0.4 AND risk > 0.2 THEN 'expert' ELSE 'qa' END AS reviewer,
  {_ACTION} AS override_action FROM ({_RISK}) r"""
# the decision table's action, if any row of it holds, takes the place of the status
_OVER = "CASE override_action WHEN 'manual_review' THEN 'manual_review' WHEN 'clarification' THEN 'clarification_required' WHEN 'reviewer_verification' THEN 'reviewer_verification' WHEN 'senior_review' THEN 'senior_review_required' ELSE review_status END"
OPS["rte_03_route"] = f"""
SELECT suggestion_id, {_OVER} AS review_status, priority, reviewer, CASE reviewer WHEN 'automated' THEN 'system:auto_approve' ELSE concat('reviewer:', reviewer, ':', workspace_id) END AS reviewer_id, eligible, eligible AND {_OVER} = 'auto_approved' AS auto_approved FROM ({_ROUTE}) q"""
OPS["rte_04_reasons"] = f"""
SELECT suggestion_id, concat_ws(',', CASE WHEN has_conflict THEN 'conflict' END, CASE WHEN is_duplicate THEN 'duplicate' END, CASE WHEN impact > 0.7 THEN 'high_impact' END, CASE WHEN complexity > 0.5 THEN 'complex' END, CASE WHEN confidence < 0.6 THEN 'low_confidence' END) AS factors,
  concat_ws(',', CASE WHEN has_conflict THEN 'resolve_conflict' END, CASE WHEN is_duplicate THEN 'merge_or_reject' END, CASE WHEN schema_status <> 'PASS' THEN 'fix_references' END) AS actions FROM ({_RISK}) r"""
OPS["rte_05_queue"] = f"SELECT reviewer, priority, count(*) AS n, round(avg(CAST(risk AS DOUBLE)), 6) AS mean_risk FROM ({_ROUTE}) q WHERE priority <> 'auto_approved' GROUP BY reviewer, priority"
# questions of a domain for each gap, in order
view("question_templates", """
SELECT * FROM (VALUES ('', 'term', 1, 'Which metric or term do you mean?'), ('', 'condition', 2, 'When should the rule apply?'), ('', 'condition', 3, 'Which values are meant?'), ('', 'entity', 4, 'Which tables does it concern?'), ('', 'example', 5, 'Can you give an example?'),
  ('global', 'condition', 6, 'Does it hold for every region?'), ('regional', 'condition', 7, 'Which region is meant?'), ('departmental', 'entity', 8, 'Which department owns the data?'), ('regional', 'example', 9, 'When should the rule apply?')) AS t(domain, gap, pos, question)""")
_GAPS = """
SELECT suggestion_id, scope AS domain, 'term' AS gap FROM suggestions WHERE business_term IS NULL UNION ALL SELECT suggestion_id, scope, 'condition' FROM suggestions WHERE n_conditions = 0 UNION ALL SELECT suggestion_id, scope, 'entity' FROM suggestions WHERE n_tables = 0 UNION ALL SELECT suggestion_id, scope, 'example' FROM suggestions WHERE confidence < 0.3"""
# a question that comes twice is asked once, where it comes first; five at most
_ASKED = f"SELECT suggestion_id, question, pos, row_number() OVER (PARTITION BY suggestion_id ORDER BY pos) AS rn FROM (SELECT g.suggestion_id, q.question, min(q.pos) AS pos FROM ({_GAPS}) g JOIN question_templates q ON q.gap = g.gap AND (q.domain = '' OR q.domain = g.domain) GROUP BY g.suggestion_id, q.question) x"
_ROUND = f"SELECT suggestion_id, AGG{{question| |pos}} AS questions, count(*) AS n_questions FROM ({_ASKED}) y WHERE rn <= 5 GROUP BY suggestion_id"
OPS["rte_06_clarification"] = f"""
SELECT q.suggestion_id, q.questions, q.n_questions, f.focus, round(greatest(CAST(0 AS DOUBLE), 1 - f.n / CAST(4 AS DOUBLE)), 6) AS confidence FROM ({_ROUND}) q JOIN (SELECT suggestion_id, AGG{{gap|,|gap}} AS focus, count(*) AS n FROM ({_GAPS}) g GROUP BY suggestion_id) f ON f.suggestion_id = q.suggestion_id"""
OPS["rte_07_payload"] = f"""
SELECT s.suggestion_id, concat_ws('; ', CASE WHEN s.business_term IS NULL OR s.n_conditions = 0 OR s.n_tables = 0 THEN 'incomplete' END, CASE WHEN s.needs_clarification THEN 'ambiguous' END, CASE WHEN s.schema_status = 'FAIL' THEN 'unresolved fields' END) AS reason, s.needs_clarification OR s.business_term IS NULL AS is_mandatory,
  concat_ws(' ', q.questions, CASE WHEN s.needs_clarification THEN 'Which exact wording is meant?' END, CASE WHEN s.schema_status = 'FAIL' THEN 'Which column holds this?' END) AS questions FROM suggestions s LEFT JOIN ({_ROUND}) q ON q.suggestion_id = s.suggestion_id"""
OPS["rte_08_reanalysis"] = "SELECT conv_id, turn, concat(question, ' [CLARIFICATION] ', response) AS combined, question AS original FROM clarifications"
OPS["rte_09_facts"] = "SELECT suggestion_id, i.idx, concat(rule_category, '_', CAST(i.idx AS STRING)) AS family_id, coalesce(business_term, 'metric') AS business_term FROM suggestions s CROSS JOIN (VALUES (0), (1)) AS i(idx) WHERE i.idx < n_conditions"
OPS["rte_10_lineage"] = "SELECT s.suggestion_id, v.version_id AS model_id, p.version_id AS dataset_id, p.scope AS dataset_scope FROM suggestions s LEFT JOIN versions v ON v.version_id = s.run_id LEFT JOIN versions p ON p.version_id = v.parent_id"
