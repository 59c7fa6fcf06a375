"""Views that give the driver's tables the shapes that the operators work on, and the dimension rows they join with.

An operator takes any DataFrame of the same columns instead (see rulewright.operators.apply).
"""

from rulewright.plans.sql import View

VIEWS: dict[str, View] = {}


def view(name: str, sql: str) -> None:
    VIEWS[name] = View(name, sql)


view("feedback", """
SELECT event_id AS feedback_id, concat('ws_', CAST(user_id % 5 AS STRING)) AS workspace_id, ts AS created_at, user_id AS submitted_by,
  CASE event_id % 8
    WHEN 0 THEN concat('Revenue should exclude cancelled orders above ', CAST(CAST(floor(value) AS BIGINT) AS STRING))
    WHEN 1 THEN concat('Only include customers where status is active in the last ', CAST(1 + event_id % 30 AS STRING), ' days')
    WHEN 2 THEN 'It would be nice to add an export button to the dashboard'
    WHEN 3 THEN 'What is the definition of active customer?'
    WHEN 4 THEN 'The revenue report page is broken and shows an error'
    WHEN 5 THEN 'orders.total_amount   should be calculated from net_price, pls chekc teh recieve date'
    WHEN 6 THEN 'asdfgh qwerty zzzz 12345 ab1cd'
    ELSE concat('Mail user', CAST(user_id AS STRING), '@example.com or call 555-123-4567, SSN 123-45-6789') END AS feedback_text
FROM events""")

# six digits, or as many as the key has: lpad alone would cut longer ones, and rules would share an id
view("rules", """
SELECT concat('R', CASE WHEN p_partkey < 1000000 THEN lpad(CAST(p_partkey AS STRING), 6, '0') ELSE CAST(p_partkey AS STRING) END) AS rule_id, p_partkey AS rule_no, concat('ws_', CAST(p_partkey % 5 AS STRING)) AS workspace_id,
  CASE p_partkey % 3 WHEN 0 THEN 'ecommerce' WHEN 1 THEN 'support' ELSE 'saas' END AS domain_id,
  lower(p_brand) AS business_term,
  CASE p_size % 4 WHEN 0 THEN 'exclude' WHEN 1 THEN 'include' WHEN 2 THEN 'restrict' ELSE 'map' END AS operation,
  CASE p_size % 5 WHEN 0 THEN 'filter_rule' WHEN 1 THEN 'metric_definition' WHEN 2 THEN 'access_rule' WHEN 3 THEN 'mapping_rule' ELSE 'data_quality_rule' END AS rule_category,
  CASE WHEN p_size % 7 = 0 THEN 'regional' ELSE 'global' END AS scope,
  CASE p_partkey % 6 WHEN 0 THEN 'archived' WHEN 1 THEN 'draft' WHEN 2 THEN 'draft' ELSE 'active' END AS status,
  'orders' AS affected_table, CASE WHEN p_partkey % 2 = 0 THEN 'status' ELSE 'total_amount' END AS affected_column,
  CASE WHEN p_partkey % 4 = 0 THEN 'orders;customers' WHEN p_partkey % 31 = 0 THEN '' WHEN p_partkey % 10 = 3 THEN 'order' ELSE 'orders' END AS entity_tables,
  CASE WHEN p_partkey % 9 = 0 THEN '' WHEN p_partkey % 4 = 0 THEN concat('orders.', CASE WHEN p_partkey % 2 = 0 THEN 'status' ELSE 'total_amount' END, ';customers.segment') ELSE concat('orders.', CASE WHEN p_partkey % 2 = 0 THEN 'status' ELSE 'total_amount' END) END AS entity_columns,
  CASE p_partkey % 5 WHEN 0 THEN 'last_30_days' WHEN 1 THEN 'whenever' END AS time_window,
  CAST(p_size AS DOUBLE) * 10 AS threshold, p_partkey AS created_minute
FROM part""")

view("conditions", """
SELECT rule_id, workspace_id, domain_id, 0 AS pos, CASE WHEN rule_no % 2 = 0 THEN 'orders.status' ELSE 'orders.total_amount' END AS field,
  CASE WHEN rule_no % 2 = 0 THEN CASE WHEN rule_no % 8 = 0 THEN 'not_equals' ELSE 'equals' END ELSE CASE WHEN rule_no % 3 = 0 THEN 'less_than' ELSE 'greater_than' END END AS operator,
  CASE WHEN rule_no % 2 = 0 THEN CASE rule_no % 5 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'completed' ELSE 'pending' END ELSE CAST(CAST(threshold AS BIGINT) AS STRING) END AS value
FROM rules
UNION ALL
SELECT rule_id, workspace_id, domain_id, 1 AS pos, CASE WHEN rule_no % 8 = 0 THEN 'customers.segment' ELSE 'region' END AS field, 'equals' AS operator, affected_column AS value FROM rules WHERE rule_no % 4 = 0""")

view("new_rules", """
SELECT concat('N', substring(rule_id, 2, 20)) AS rule_id, rule_no, workspace_id, domain_id, business_term,
  CASE WHEN rule_no % 100 = 20 THEN CASE operation WHEN 'exclude' THEN 'include' WHEN 'include' THEN 'exclude' ELSE operation END ELSE operation END AS operation,
  rule_category, CASE WHEN rule_no % 100 = 80 THEN 'departmental' ELSE scope END AS scope, status, affected_table, affected_column, entity_tables, entity_columns, time_window, threshold, created_minute
FROM rules WHERE rule_no % 20 = 0""")

view("new_conditions", """
SELECT concat('N', substring(c.rule_id, 2, 20)) AS rule_id, c.workspace_id, c.domain_id, c.pos, c.field, c.operator,
  CASE WHEN r.rule_no % 100 = 60 THEN concat(c.value, ' extra') ELSE c.value END AS value
FROM conditions c JOIN rules r ON r.rule_id = c.rule_id WHERE r.rule_no % 20 = 0 AND NOT (r.rule_no % 100 = 40 AND c.pos = 1) AND r.rule_no % 200 <> 100""")

view("catalog", """
SELECT * FROM (VALUES
  ('ecommerce', 'orders', 'order_id', 'integer', 'false', NULL), ('ecommerce', 'orders', 'status', 'string', 'false', 'pending|completed|cancelled'),
  ('ecommerce', 'orders', 'total_amount', 'decimal', 'true', NULL), ('ecommerce', 'orders', 'created_at', 'timestamp', 'false', NULL),
  ('ecommerce', 'customers', 'customer_id', 'integer', 'false', NULL), ('ecommerce', 'customers', 'segment', 'string', 'true', 'retail|business'),
  ('ecommerce', 'customers', 'region', 'string', 'true', NULL), ('ecommerce', 'customers', 'status', 'string', 'true', 'active|inactive'),
  ('support', 'tickets', 'ticket_id', 'integer', 'false', NULL), ('support', 'tickets', 'status', 'string', 'false', 'open|closed'),
  ('support', 'tickets', 'priority', 'string', 'true', 'low|high'), ('support', 'orders', 'status', 'string', 'true', NULL),
  ('saas', 'subscriptions', 'plan', 'string', 'false', 'free|pro'), ('saas', 'subscriptions', 'is_trial', 'boolean', 'false', NULL),
  ('saas', 'orders', 'total_amount', 'decimal', 'true', NULL)) AS t(domain, table_name, column_name, type, nullable, allowed)""")

view("glossary", """
SELECT * FROM (VALUES
  ('ecommerce', 'revenue', 'Sum of completed orders', 'orders.total_amount', 0), ('ecommerce', 'active_customer', 'A customer with an order lately', 'customers.status', 1),
  ('ecommerce', 'order_count', 'Number of orders', 'orders.order_id', 2), ('support', 'open_ticket', 'A ticket that is not closed', 'tickets.status', 0),
  ('saas', 'trial_user', 'A user on trial', 'subscriptions.is_trial', 0)) AS t(domain, term, definition, ref, pos)""")

view("suggestions", """
SELECT concat('S', CAST(o_orderkey AS STRING)) AS suggestion_id, o_orderkey AS suggestion_no, concat('ws_', CAST(o_custkey % 5 AS STRING)) AS workspace_id, o_custkey AS run_id,
  CASE WHEN o_orderstatus = 'F' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'approved' WHEN '2-HIGH' THEN 'rejected' WHEN '3-MEDIUM' THEN 'rule_activated' ELSE 'archived' END
       WHEN o_orderstatus = 'P' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'Senior_Review' WHEN '2-HIGH' THEN 'pending_review' ELSE 'analyzed' END
       ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'auto_approved' ELSE 'received' END END AS status,
  o_orderdate AS created_at, round(o_totalprice - floor(o_totalprice), 2) AS confidence,
  CASE o_orderkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PARTIAL' WHEN 2 THEN 'FAIL' ELSE 'PASS' END AS schema_status,
  o_orderkey % 7 = 0 AS is_duplicate, o_orderkey % 11 = 0 AS has_conflict, o_orderkey % 13 = 0 AS sensitive, o_orderkey % 9 = 0 AS needs_clarification, o_orderkey % 17 <> 0 AS mandatory_ok,
  CAST(o_orderkey % 6 AS INT) AS n_conditions, CAST(o_orderkey % 4 AS INT) AS n_tables,
  CASE o_orderkey % 3 WHEN 0 THEN 'global' WHEN 1 THEN 'regional' ELSE 'departmental' END AS scope,
  CASE o_orderkey % 5 WHEN 0 THEN 'exclude' WHEN 1 THEN 'map' ELSE 'include' END AS operation,
  CASE o_orderkey % 4 WHEN 0 THEN 'access_rule' ELSE 'metric_definition' END AS rule_category,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'net_revenue' END AS business_term
FROM orders""")

view("audit", """
SELECT o.suggestion_id AS entity_id, o.workspace_id, CAST(l.l_linenumber AS INT) AS step, l.l_shipdate AS created_at, l.l_suppkey AS actor,
  CASE l.l_linenumber WHEN 1 THEN 'received' WHEN 2 THEN 'validated' WHEN 3 THEN 'classified' WHEN 4 THEN 'extracted' ELSE 'analyzed' END AS from_status,
  CASE WHEN l.l_partkey % 20 = 0 THEN 'archived' ELSE CASE l.l_linenumber WHEN 1 THEN 'validated' WHEN 2 THEN 'classified' WHEN 3 THEN 'extracted' WHEN 4 THEN 'analyzed' ELSE 'pending_review' END END AS to_status,
  l.l_extendedprice AS tie
FROM lineitem l JOIN suggestions o ON o.suggestion_no = l.l_orderkey""")

view("edges", """
SELECT * FROM (VALUES ('received','validated'),('validated','classified'),('classified','extracted'),('extracted','analyzed'),('analyzed','pending_review'),('pending_review','approved'),
  ('approved','rule_created'),('rule_created','rule_activated'),('rule_activated','archived'),('received','rejected'),('validated','rejected'),('classified','rejected'),
  ('extracted','rejected'),('analyzed','rejected'),('pending_review','rejected'),('rejected','archived')) AS t(from_status, to_status)""")

view("predictions", """
SELECT d.doc_id, l.quality AS expected, CAST(CASE WHEN substring(md5(CAST(d.doc_id AS STRING)), 1, 1) IN ('0', '1', '2') THEN 1 - l.quality ELSE l.quality END AS INT) AS predicted,
  l.toxic AS expected_toxic, round(2e-2 + 6e-2 * instr('0123456789abcdef', substring(md5(CAST(d.doc_id AS STRING)), 2, 1)) - 13e-3, 4) AS confidence,
  d.lang AS expected_lang, CASE WHEN substring(md5(CAST(d.doc_id AS STRING)), 3, 1) IN ('0', '7') THEN 'en' ELSE d.lang END AS predicted_lang, d.source AS model
FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")

view("records", """
SELECT concat('FB', CAST(f.feedback_id AS STRING)) AS feedback_id, f.feedback_id AS record_no, f.feedback_text, r.rule_id, r.domain_id AS domain, r.business_term, r.operation,
  concat(r.business_term, '_', r.operation, CASE WHEN f.feedback_id % 16 = 4 THEN '_conflict' ELSE '' END) AS rule_family_id,
  CASE f.feedback_id % 8 WHEN 2 THEN 'feature_request' WHEN 3 THEN 'question' WHEN 4 THEN 'issue_report' WHEN 6 THEN 'irrelevant_spam' ELSE 'business_rule' END AS feedback_type,
  CASE WHEN f.feedback_id % 8 IN (0, 1, 5, 7) THEN r.rule_category ELSE NULL END AS rule_category, f.feedback_id % 8 IN (0, 1, 5, 7) AS is_actionable, f.feedback_id % 6 = 0 AS requires_clarification,
  'orders.status' AS used_field, CASE WHEN f.feedback_id % 3 = 0 THEN 'orders.total_amount' ELSE 'orders.status' END AS context_field
FROM feedback f JOIN rules r ON r.rule_no = f.feedback_id % 150""")

view("versions", """
SELECT s_suppkey AS version_id, concat('dataset_', CAST(s_nationkey % 5 AS STRING)) AS scope, CASE WHEN s_suppkey % 13 = 0 THEN 'legacy' ELSE concat('v0.', CAST(s_suppkey % 9 AS STRING), '.0') END AS version,
  CASE s_suppkey % 4 WHEN 0 THEN 'CANDIDATE' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'ACTIVE' ELSE 'ARCHIVED' END AS status, s_acctbal AS accuracy, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey - 1 END AS parent_id
FROM supplier""")

view("request_log", """
SELECT event_id, event_type AS bucket, CASE event_type WHEN 'view' THEN 'feedback' WHEN 'click' THEN 'reviews' WHEN 'purchase' THEN 'rules' ELSE 'batch' END AS policy, user_id AS subject, ts, value / 100 AS duration, CAST(JSON(props, k) AS BIGINT) AS request_key, CAST(user_id % 5 AS BIGINT) AS tenant FROM events""")

view("jobs", """
SELECT l_orderkey AS job_id, l_linenumber AS part_no, l_returnflag AS job_type, l_linestatus AS outcome, CAST(l_partkey % 100 AS BIGINT) AS idempotency_key, concat('ws_', CAST(l_suppkey % 5 AS STRING)) AS workspace_id, l_shipdate AS created_at FROM lineitem""")

view("clarifications", """
SELECT a.conv_id, a.turn, a.text AS question, b.text AS response FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'assistant' AND b.role = 'user'""")

# a record of a request, as paths to its values
view("record_values", """
SELECT feedback_id, path, CASE path WHEN 'text' THEN feedback_text WHEN 'user.id' THEN CAST(submitted_by AS STRING) WHEN 'user.Email' THEN concat('user', CAST(submitted_by AS STRING), '@example.com') WHEN 'headers.authorization' THEN 'Bearer x'
  WHEN 'notes.0' THEN concat('call 555-', lpad(CAST(submitted_by % 1000 AS STRING), 3, '0'), '-4567') ELSE 'plain' END AS value, path <> 'user.id' AS is_text
FROM feedback CROSS JOIN (VALUES ('text'), ('user.id'), ('user.Email'), ('headers.authorization'), ('notes.0'), ('notes.1'), ('session_token.part.0')) AS p(path)""")

view("taxonomy_terms", """
SELECT * FROM (VALUES ('metric definition'), ('filter rule'), ('mapping rule'), ('access rule'), ('join rule'), ('data quality rule'), ('exclude'), ('include'), ('restrict'), ('map'), ('replace'), ('add'), ('subtract')) AS t(term)""")

# what a trained classifier says of feedback: the record's own labels, blurred
view("model_outputs", """
SELECT feedback_id, CASE WHEN substring(md5(CAST(feedback_id AS STRING)), 1, 1) IN ('0', '1') THEN 'general_feedback' WHEN feedback_id % 8 IN (0, 1, 5) THEN 'business_rule' WHEN feedback_id % 8 = 4 THEN 'issue_report' ELSE 'question' END AS feedback_type,
  CASE feedback_id % 3 WHEN 0 THEN 'filter_rule' WHEN 1 THEN 'metric_definition' ELSE 'access_rule' END AS rule_category, round(4e-1 + 4e-2 * (instr('0123456789abcdef', substring(md5(CAST(feedback_id AS STRING)), 2, 1)) - 1), 4) AS confidence
FROM feedback WHERE feedback_id % 10 <> 9""")

view("logits", """
SELECT d.doc_id, c.class, round((instr('0123456789abcdef', substring(md5(CAST(d.doc_id AS STRING)), CAST(c.pos AS INT), 1)) - 8) / CAST(2 AS DOUBLE), 2) AS logit FROM documents d CROSS JOIN (VALUES ('business_rule', 1), ('issue_report', 2), ('question', 3)) AS c(class, pos)""")

# phrases of new rules whose conditions are not structured yet
view("new_candidates", """
SELECT rule_id, 0 AS pos, CASE WHEN rule_no % 400 = 100 THEN 'where the order status is pending' ELSE 'for some of them' END AS text FROM new_rules WHERE rule_no % 200 = 100""")

view("field_confidences", """
SELECT suggestion_id, CASE WHEN business_term IS NULL THEN CAST(0.3 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS term, CASE WHEN operation = 'map' THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END AS operation,
  CASE WHEN n_conditions > 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS condition_mean, CASE WHEN suggestion_no % 4 = 0 THEN round(confidence / 2 + CAST(0.45 AS DOUBLE), 4) END AS calibrated FROM suggestions WHERE suggestion_no % 8 <> 3""")

# a schema catalog with its tables and columns nested in one text for each domain, and glossary documents
view("nested_catalog", """
SELECT domain, AGG{part|;|part} AS tables FROM (SELECT r.r_name AS domain, concat(n.n_name, ':', coalesce(c.columns, '')) AS part FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT c_nationkey, AGG{segment|,|segment} AS columns FROM (SELECT DISTINCT c_nationkey, lower(c_mktsegment) AS segment FROM customer) s GROUP BY c_nationkey) c ON c.c_nationkey = n.n_nationkey) p GROUP BY domain""")

view("glossary_documents", """
SELECT domain_id AS domain, concat('# Terms

', AGG{block|
|term}) AS document FROM (
  SELECT domain_id, business_term AS term, concat('### ', business_term, '
Definition: what ', business_term, ' covers
Tables/columns: `orders.', min(affected_column), '`, `orders.', max(affected_column), '`
Related rules: ', min(rule_id), ', ', max(rule_id), '
') AS block FROM rules GROUP BY domain_id, business_term) b GROUP BY domain_id""")
