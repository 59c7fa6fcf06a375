"""Sources and table maintenance: scans, dimensions, candidate retrieval, upserts, reports."""

from rulewright.sources.adapters import view

OPS: dict[str, str] = {}

# a bad line is one whose text has no member k; it is kept with the reason
OPS["src_01_json_lines"] = """
SELECT event_id, CASE WHEN JSON(props, k) IS NULL THEN 'bad' ELSE 'good' END AS outcome, CAST(JSON(props, k) AS BIGINT) AS k FROM events WHERE trim(props) <> ''"""

# nested twice: tables of a domain, columns of a table
view("catalog_tables", "SELECT domain, regexp_extract(tok, '^([^:]*):', 1) AS table_name, regexp_extract(tok, ':(.*)$', 1) AS columns FROM UNNEST{nested_catalog|domain|split(tables, ';')} t")
OPS["src_02_flat_catalog"] = """
SELECT domain, table_name, nullif(tok, '') AS column_name, concat(table_name, '.', nullif(tok, '')) AS qualified, CAST(count(*) OVER (PARTITION BY domain, tok) AS BIGINT) AS tables_with_column FROM UNNEST{catalog_tables|domain, table_name|split(columns, ',')} c"""
# a block begins at its heading; a document's text before the first heading is none
OPS["src_03_glossary"] = r"""
SELECT domain, pos, regexp_extract(tok, '^ *([^\n]+)', 1) AS term, regexp_extract(tok, 'Definition: ([^\n]*)', 1) AS definition, regexp_extract(tok, 'Related rules: ([^\n]*)', 1) AS related,
  COUNT⟦regexp_extract_all(tok, '`([a-z_.]+)`', 1)¦x¦x <> ''⟧ AS n_columns, regexp_extract(tok, '`([a-z_.]+)`', 1) AS first_column FROM UNNEST{glossary_documents|domain|split(document, '### ')} b WHERE pos > 0"""
OPS["src_04_vocabulary"] = """
SELECT DISTINCT domain, term FROM (
  SELECT domain, table_name AS term FROM catalog UNION ALL SELECT domain, column_name FROM catalog UNION ALL SELECT domain, concat(table_name, '.', column_name) FROM catalog
  UNION ALL SELECT domain_id, operation FROM rules UNION ALL SELECT domain_id, operator FROM conditions UNION ALL SELECT domain, term FROM glossary
  UNION ALL SELECT domain, tok FROM UNNEST{glossary|domain|split(term, '_')} g WHERE length(tok) > 2) v"""

OPS["src_05_rule_scan"] = "SELECT rule_id, domain_id, coalesce(scope, 'global') AS scope, CAST(coalesce(n, 0) AS BIGINT) AS n_conditions, CASE WHEN status = 'active' THEN 'pack' ELSE 'stored' END AS origin FROM rules LEFT JOIN (SELECT rule_id AS id, count(*) AS n FROM conditions GROUP BY rule_id) c ON c.id = rule_id"

OPS["src_06_stored_rules"] = """
SELECT workspace_id, domain_id, rule_id, rn FROM (
  SELECT workspace_id, domain_id, rule_id, CAST(row_number() OVER (PARTITION BY workspace_id, domain_id ORDER BY created_minute DESC, rule_id) AS INT) AS rn FROM rules WHERE status IN ('active', 'draft')) x
WHERE rn <= 100"""

# rules of the pack win, stored ones come in if their id is new
view("pack_rules", "SELECT rule_id, domain_id, operation, threshold FROM rules WHERE status = 'active' UNION ALL SELECT rule_id, domain_id, operation, threshold + 1 FROM new_rules")
OPS["src_07_candidate_union"] = """
SELECT rule_id, domain_id, 'pack' AS origin FROM pack_rules
UNION ALL
SELECT s.rule_id, s.domain_id, 'stored' AS origin FROM rules s WHERE s.status IN ('active', 'draft') AND NOT EXISTS (SELECT 1 FROM pack_rules p WHERE p.rule_id = s.rule_id)"""

# the pack refreshes named columns of stored rules, never their status, and inserts those that are not stored
OPS["src_08_upsert"] = """
SELECT coalesce(o.rule_id, n.rule_id) AS rule_id, coalesce(n.operation, o.operation) AS operation, coalesce(n.threshold, o.threshold) AS threshold, coalesce(o.status, 'draft') AS status,
  CASE WHEN o.rule_id IS NULL THEN 'inserted' WHEN n.rule_id IS NULL THEN 'kept' ELSE 'refreshed' END AS outcome
FROM rules o FULL OUTER JOIN pack_rules n ON n.rule_id = o.rule_id"""

OPS["src_09_run_report"] = """
SELECT feedback_type AS stage, count(*) AS n_records, count(DISTINCT rule_family_id) AS n_families, count_if(is_actionable) AS n_actionable FROM records GROUP BY feedback_type
UNION ALL SELECT 'total', count(*), count(DISTINCT rule_family_id), count_if(is_actionable) FROM records"""
