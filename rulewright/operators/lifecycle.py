"""Lifecycle, audit, retention and repository views. What is asked for, the date and the tenants are inputs (views below)."""

from rulewright.sources.adapters import view

OPS: dict[str, str] = {}

# who asks for what: the state that a suggestion is expected in and the one that is wanted
view("transition_requests", "SELECT suggestion_id, CASE WHEN suggestion_no % 2 = 0 THEN 'pending_review' ELSE 'received' END AS expected, CASE suggestion_no % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'validated' ELSE 'rejected' END AS wanted FROM suggestions")
# rules to be activated, by workspace, in the order of the request; some are asked for twice, some don't exist
view("activation_requests", "SELECT concat('ws_', CAST(rule_no % 2 AS STRING)) AS workspace_id, rule_id, rule_no AS pos FROM rules UNION ALL SELECT 'ws_1', rule_id, rule_no + 1000 FROM rules WHERE rule_no % 6 = 1 UNION ALL SELECT 'ws_1', concat('X', CAST(rule_no AS STRING)), rule_no FROM rules WHERE rule_no % 40 = 0")
# the day that retention counts from, and the tenants that are known
view("retention_clock", "SELECT max(created_at) AS as_of FROM suggestions")
view("tenants", "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS tenant FROM nation WHERE n_name < 'F'")
_NORMAL = "CASE WHEN lower({0}) IN ('senior_review', 'manual_review', 'reviewer_verification', 'clarification', 'pending_review') THEN 'pending_review' ELSE lower({0}) END"
OPS["lif_01_transition_validity"] = f"SELECT a.entity_id, a.step, a.tie, a.from_status, a.to_status, e.to_status IS NOT NULL AS is_valid FROM audit a LEFT JOIN edges e ON e.from_status = {_NORMAL.format('a.from_status')} AND e.to_status = {_NORMAL.format('a.to_status')}"
OPS["lif_02_apply_transitions"] = f"""
SELECT s.suggestion_id, s.status AS old_status, q.wanted, CASE WHEN q.expected <> {_NORMAL.format('s.status')} THEN 'status_mismatch' WHEN e.to_status IS NULL THEN 'illegal' ELSE 'applied' END AS outcome,
  CASE WHEN q.expected = {_NORMAL.format('s.status')} AND e.to_status IS NOT NULL THEN q.wanted ELSE s.status END AS new_status
FROM suggestions s JOIN transition_requests q ON q.suggestion_id = s.suggestion_id
LEFT JOIN edges e ON e.from_status = q.expected AND e.to_status = q.wanted"""
_ASKED = OPS["lif_02_apply_transitions"]
# one audit row for each transition applied; who reviews is set where a review ends
OPS["lif_02_audit"] = f"""
SELECT suggestion_id AS entity_id, old_status AS from_status, new_status AS to_status, CASE WHEN new_status IN ('approved', 'rejected') THEN 'reviewer' ELSE 'system' END AS actor, CASE WHEN new_status IN ('approved', 'rejected') THEN new_status END AS decision FROM ({_ASKED}) t WHERE outcome = 'applied'"""
_ORDER = "PARTITION BY entity_id ORDER BY created_at, step, tie"
OPS["lif_03_audit_history"] = f"SELECT entity_id, step, tie, to_status, CAST(row_number() OVER ({_ORDER}) AS INT) AS n, lag(to_status) OVER ({_ORDER}) AS previous, coalesce(lag(to_status) OVER ({_ORDER}) = from_status, TRUE) AS replays FROM audit"
OPS["lif_04_current_status"] = f"""
SELECT c.entity_id, c.to_status AS current_status, AGG{{e.to_status|,|e.to_status}} AS next_statuses FROM (SELECT entity_id, to_status FROM (SELECT entity_id, to_status, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, step DESC, tie DESC) AS rn FROM audit) a WHERE rn = 1) c
LEFT JOIN edges e ON e.from_status = c.to_status GROUP BY c.entity_id, c.to_status"""
OPS["lif_05_draft_rules"] = "SELECT substring(md5(s.suggestion_id), 1, 16) AS rule_id, s.suggestion_id, concat(upper(s.operation), ' ', coalesce(s.business_term, 'rule')) AS rule_name, 'draft' AS status, v.scope AS domain FROM suggestions s LEFT JOIN versions v ON v.version_id = s.run_id WHERE s.status = 'approved'"
OPS["lif_06_batch_activation"] = """
SELECT q.workspace_id, q.rule_id, q.first_pos, CASE WHEN r.rule_id IS NULL THEN 'skipped_not_found' WHEN r.workspace_id <> q.workspace_id THEN 'failed_workspace' WHEN r.status <> 'draft' THEN 'skipped_not_draft' ELSE 'activated' END AS outcome
FROM (SELECT workspace_id, rule_id, min(pos) AS first_pos FROM activation_requests GROUP BY workspace_id, rule_id) q LEFT JOIN rules r ON r.rule_id = q.rule_id"""
OPS["lif_07_listing"] = "SELECT s.suggestion_id, s.status, a.n_steps, CAST(row_number() OVER (PARTITION BY s.workspace_id ORDER BY s.created_at DESC, s.suggestion_no) AS INT) AS place FROM suggestions s LEFT JOIN (SELECT entity_id, count(*) AS n_steps FROM audit GROUP BY entity_id) a ON a.entity_id = s.suggestion_id"
_TARGET = "(SELECT scope, min(version_id) AS target FROM versions WHERE status = 'APPROVED' GROUP BY scope)"
_PROMOTED = f"SELECT v.version_id, v.scope, v.status, CASE WHEN v.version_id = t.target THEN 'ACTIVE' WHEN v.status = 'ACTIVE' AND t.target IS NOT NULL THEN 'ARCHIVED' ELSE v.status END AS new_status FROM versions v LEFT JOIN {_TARGET} t ON t.scope = v.scope"
OPS["lif_08_promotion"] = _PROMOTED
OPS["lif_08_one_active"] = f"SELECT scope, count_if(new_status = 'ACTIVE') AS n_active, count_if(new_status = 'ACTIVE') <= 1 AS holds FROM ({_PROMOTED}) p GROUP BY scope"
OPS["lif_09_next_version"] = "SELECT scope, concat('v0.', CAST(coalesce(max(try_cast(nullif(regexp_extract(version, '^v0[.]([0-9]+)[.]0$', 1), '') AS INT)), 0) + 1 AS STRING), '.0') AS next_version FROM versions GROUP BY scope"
OPS["lif_10_newest_active"] = "SELECT scope, version_id, version FROM (SELECT scope, version_id, version, row_number() OVER (PARTITION BY scope ORDER BY version_id DESC) AS rn FROM versions WHERE status = 'ACTIVE') v WHERE rn = 1"
_DATED = "SELECT s.suggestion_id, s.created_at < c.as_of - INTERVAL 365 DAY AND s.status IN ('approved', 'rejected', 'archived', 'rule_activated') AS expired FROM suggestions s CROSS JOIN retention_clock c"
OPS["lif_11_retention"] = f"SELECT suggestion_id, CASE WHEN expired THEN 'deleted' ELSE 'kept' END AS outcome, CASE WHEN expired THEN concat('retention:', suggestion_id) END AS audit_id FROM ({_DATED}) d"
# fixed values: 365 days for feedback and for suggestions in a final state, 30 days for finished jobs; the newest feedback
# stands for today there, as its dates are of other years
_OLD_FEEDBACK = "SELECT feedback_id, f.created_at < t.now - INTERVAL 365 DAY AS expired FROM feedback f CROSS JOIN (SELECT max(created_at) AS now FROM feedback) t"
_OLD_JOB = "SELECT j.job_id, j.part_no, j.created_at < c.as_of - INTERVAL 30 DAY AND j.outcome = 'F' AS expired FROM jobs j CROSS JOIN retention_clock c"
OPS["lif_11_totals"] = f"""
SELECT 'suggestions' AS entity, count_if(expired) AS deleted, count(*) AS total FROM ({_DATED}) d UNION ALL SELECT 'jobs', count_if(expired), count(*) FROM ({_OLD_JOB}) j UNION ALL SELECT 'feedback', count_if(expired), count(*) FROM ({_OLD_FEEDBACK}) f"""
OPS["lif_11_audit"] = f"""
SELECT 'suggestion' AS entity_type, suggestion_id AS entity_id, 'delete_expired' AS action, 365 AS retention_days FROM ({_DATED}) d WHERE expired
UNION ALL SELECT 'job', concat(CAST(job_id AS STRING), '/', CAST(part_no AS STRING)), 'delete_expired', 30 FROM ({_OLD_JOB}) j WHERE expired UNION ALL SELECT 'feedback', CAST(feedback_id AS STRING), 'delete_expired', 365 FROM ({_OLD_FEEDBACK}) f WHERE expired"""
OPS["lif_12_counts"] = "SELECT 'rules' AS entity, workspace_id, status, count(*) AS n FROM rules GROUP BY workspace_id, status UNION ALL SELECT 'suggestions', workspace_id, status, count(*) FROM suggestions GROUP BY workspace_id, status"
OPS["lif_13_members"] = "SELECT n.n_nationkey AS workspace, count(c.c_custkey) AS members, min(c.c_custkey) AS owner FROM nation n LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY n.n_nationkey"
# an entry of an unknown tenant is kept without one
OPS["lif_14_append_audit"] = "SELECT e.event_id, e.bucket AS action, t.tenant FROM request_log e LEFT JOIN tenants t ON t.tenant = e.tenant"
