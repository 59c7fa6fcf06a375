"""Rules from tagged tokens: which words name the term, the operation and the conditions, and their normal form.

Everything of a text is partitioned by its feedback_id; a text meets only its own tokens and its domain's nouns.
"""

from rulewright.sources.adapters import view

from . import fixed
from .datagen import OPS as DATASETS

OPS: dict[str, str] = {}

_in = lambda words: "(" + ", ".join(map(fixed.sql, words)) + ")"
_clean = lambda x: f"regexp_replace({x}, '[.,;:!?()\"'']+$', '')"
_capital = lambda x: f"concat(upper(substring({x}, 1, 1)), substring({x}, 2, 1000))"

view("tagged_tokens", f"SELECT b.feedback_id, b.place AS i, b.tok, b.label, r.domain, r.feedback_text AS text FROM ({DATASETS['gen_18_bio']}) b JOIN records r ON r.feedback_id = b.feedback_id")
view("tag_words", f"SELECT feedback_id, i, tok, lower(tok) AS w, {_clean('lower(tok)')} AS c, label, domain, text, lag(lower(tok)) OVER (PARTITION BY feedback_id ORDER BY i) AS before FROM tagged_tokens")
view("tag_nouns", f"SELECT domain, lower(table_name) AS noun FROM catalog UNION SELECT d.domain, s.noun FROM (SELECT DISTINCT domain FROM catalog) d CROSS JOIN {fixed.values([(s,) for s in fixed.TERM_SYNONYMS], 'noun', 's')}")
# the first word of an operation that is no modal verb, else the first; "not" or "never" before it belongs to it
view("tag_operation", f"""
SELECT feedback_id, i, CASE WHEN before IN ('not', 'never') THEN concat('not ', w) ELSE w END AS operation FROM (
  SELECT feedback_id, i, w, before, row_number() OVER (PARTITION BY feedback_id ORDER BY CASE WHEN w IN {_in(fixed.MODALS)} THEN 1 ELSE 0 END, i) AS rn FROM tag_words WHERE label LIKE 'B_OPERATION%') x WHERE rn = 1""")
view("tag_first_term", "SELECT feedback_id, i, tok, w, domain, text FROM (SELECT feedback_id, i, tok, w, domain, text, row_number() OVER (PARTITION BY feedback_id ORDER BY i) AS rn FROM tag_words WHERE label LIKE 'B_BUSINESS_TERM%') x WHERE rn = 1")
view("tag_adjectives", f"SELECT feedback_id, i, domain, text FROM tag_first_term WHERE w IN {_in(fixed.ADJECTIVES)}")
# an adjective gives way to a noun of the schema within three words, those after it first; else to the first table that the
# text holds; else to the first word that can be a noun
_NEAR = """
SELECT feedback_id, c FROM (SELECT t.feedback_id, n.c, row_number() OVER (PARTITION BY t.feedback_id ORDER BY CASE WHEN n.i > t.i THEN 0 ELSE 1 END, n.i) AS rn FROM tag_adjectives t JOIN tag_words n ON n.feedback_id = t.feedback_id AND n.i <> t.i AND n.i BETWEEN t.i - 3 AND t.i + 3
  LEFT JOIN tag_nouns a ON a.domain = t.domain AND a.noun = n.c LEFT JOIN tag_nouns b ON b.domain = t.domain AND b.noun = regexp_replace(n.c, 's+$', '') WHERE a.noun IS NOT NULL OR b.noun IS NOT NULL) x WHERE rn = 1"""
_HELD = "SELECT t.feedback_id, min(k.noun) AS c FROM tag_adjectives t JOIN (SELECT DISTINCT domain, lower(table_name) AS noun FROM catalog) k ON k.domain = t.domain AND instr(lower(t.text), k.noun) > 0 GROUP BY t.feedback_id"
_OTHER = f"SELECT feedback_id, c FROM (SELECT n.feedback_id, n.c, row_number() OVER (PARTITION BY n.feedback_id ORDER BY n.i) AS rn FROM tag_words n JOIN tag_adjectives t ON t.feedback_id = n.feedback_id WHERE length(n.c) > 2 AND n.c NOT IN {_in(fixed.STOP_WORDS)} AND n.c NOT IN {_in(fixed.ADJECTIVES)}) x WHERE rn = 1"
_TITLE = f"CASE WHEN instr(c, '_') > 0 THEN concat({_capital(chr(39).join(('regexp_extract(c, ', '^([^_]*)', ', 1)')))}, '_', {_capital(chr(39).join(('regexp_extract(c, ', '_(.*)$', ', 1)')))}) ELSE {_capital('c')} END"
view("tag_term", f"""
SELECT feedback_id, CASE WHEN c IS NULL THEN tok ELSE {_TITLE} END AS business_term, CASE WHEN c IS NOT NULL THEN w END AS corrected_from FROM (
  SELECT f.feedback_id, f.tok, f.w, coalesce(a.c, b.c, d.c) AS c FROM tag_first_term f LEFT JOIN ({_NEAR}) a ON a.feedback_id = f.feedback_id LEFT JOIN ({_HELD}) b ON b.feedback_id = f.feedback_id LEFT JOIN ({_OTHER}) d ON d.feedback_id = f.feedback_id) x""")
view("tag_values", f"SELECT feedback_id, i, tok FROM tag_words WHERE label LIKE 'B_VALUE%' AND w NOT IN {_in(fixed.NO_VALUES)}")
view("tag_tables", "SELECT feedback_id, i, tok FROM tag_words WHERE label LIKE 'B_TABLE%'")
view("tag_counts", f"SELECT feedback_id, count_if(label LIKE 'B_FIELD%') AS fields, count_if(label LIKE 'B_TABLE%') AS tables, count_if(label LIKE 'B_VALUE%' AND w NOT IN {_in(fixed.NO_VALUES)}) AS vals FROM tag_words GROUP BY feedback_id")
# values belong to the field before them, each with the nearest word of comparison in the field's stretch; without fields each
# table takes its nearest value; without tables values stand alone
_PAIRED = """
SELECT feedback_id, a, b, field, op, value FROM (SELECT f.feedback_id, f.i AS a, v.i AS b, f.tok AS field, o.tok AS op, v.tok AS value, row_number() OVER (PARTITION BY f.feedback_id, f.i, v.i ORDER BY abs(o.i - v.i), o.i) AS rn
  FROM (SELECT feedback_id, i, tok, coalesce(lead(i) OVER (PARTITION BY feedback_id ORDER BY i), 1000000000) AS until FROM tag_words WHERE label LIKE 'B_FIELD%') f JOIN tag_values v ON v.feedback_id = f.feedback_id AND v.i > f.i AND v.i < f.until AND instr(v.tok, '.') = 0
  LEFT JOIN (SELECT w.feedback_id, w.i, w.tok FROM tag_words w JOIN tag_operation p ON p.feedback_id = w.feedback_id AND p.i <> w.i WHERE w.label LIKE 'B_OPERATION%') o ON o.feedback_id = f.feedback_id AND o.i > f.i AND o.i < f.until) x WHERE rn = 1"""
_NEAREST = "SELECT feedback_id, a, 0 AS b, concat(regexp_replace(tok, '[.]+$', ''), '.status') AS field, 'equals' AS op, value FROM (SELECT t.feedback_id, t.i AS a, t.tok, v.tok AS value, row_number() OVER (PARTITION BY t.feedback_id, t.i ORDER BY abs(v.i - t.i), v.i) AS rn FROM tag_tables t JOIN tag_values v ON v.feedback_id = t.feedback_id JOIN tag_counts n ON n.feedback_id = t.feedback_id AND n.fields = 0) x WHERE rn = 1"
_ALONE = "SELECT v.feedback_id, v.i AS a, 0 AS b, CAST(NULL AS STRING) AS field, 'equals' AS op, v.tok AS value FROM tag_values v JOIN tag_counts n ON n.feedback_id = v.feedback_id AND n.fields = 0 AND n.tables = 0"
view("tag_conditions", f"""
SELECT feedback_id, field, operator, value, CAST(row_number() OVER (PARTITION BY feedback_id ORDER BY a, b) - 1 AS INT) AS place FROM (
  SELECT feedback_id, field, upper(coalesce(op, 'equals')) AS operator, value, min(a) AS a, min(b) AS b FROM ({_PAIRED} UNION ALL {_NEAREST} UNION ALL {_ALONE}) x GROUP BY feedback_id, field, upper(coalesce(op, 'equals')), value) y""")
_METHOD = "CASE WHEN n.vals = 0 THEN NULL WHEN n.fields > 0 THEN 'explicit_field_value' WHEN n.tables > 0 THEN 'inferred_table_value' ELSE 'value_only' END"
OPS["ext_19_from_tags"] = f"""
SELECT n.feedback_id, t.business_term, t.corrected_from, o.operation, c.place, c.field, c.operator, c.value, {_METHOD} AS method FROM tag_counts n LEFT JOIN tag_term t ON t.feedback_id = n.feedback_id LEFT JOIN tag_operation o ON o.feedback_id = n.feedback_id LEFT JOIN tag_conditions c ON c.feedback_id = n.feedback_id"""

_pick = lambda x, pairs, other: "CASE " + " ".join(f"WHEN instr({x}, {fixed.sql(p)}) > 0 THEN '{o.upper()}'" for p, o in sorted(pairs, key=lambda r: (-len(r[0]), r[0]))) + f" ELSE {other} END"
_SURFACE = [(p, o) for o, phrases in fixed.TAGGED_OPERATIONS.items() for p in phrases]
_WHOLE = "CASE operation " + " ".join(f"WHEN {fixed.sql(p)} THEN '{o.upper()}'" for p, o in _SURFACE) + " END"
_mapped = lambda x: f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.TABLE_SYNONYMS.items()) + f" ELSE {x} END"
_STATE_OF = "CASE regexp_replace(lower(tok), '[.]+$', '') " + " ".join(f"WHEN '{t}' THEN '{t}.{c}'" for t, c in fixed.STATE_COLUMNS.items()) + " END"
view("tag_known_state", f"SELECT feedback_id, field FROM (SELECT feedback_id, field, row_number() OVER (PARTITION BY feedback_id ORDER BY i) AS rn FROM (SELECT feedback_id, i, {_STATE_OF} AS field FROM tag_tables) a WHERE field IS NOT NULL) b WHERE rn = 1")
# a condition's field without marks at its end; one without a field takes the state column of a named table
view("tag_fields", """
SELECT c.feedback_id, c.place, c.operator, c.value, regexp_replace(trim(coalesce(c.field, s.field)), '[,;:!?"'']+$', '') AS field, t.n AS n_tables, t.tok AS one_table
FROM tag_conditions c LEFT JOIN tag_known_state s ON s.feedback_id = c.feedback_id LEFT JOIN (SELECT feedback_id, count(*) AS n, min(tok) AS tok FROM tag_tables GROUP BY feedback_id) t ON t.feedback_id = c.feedback_id""")
# a bare field belongs to the only table that the text or the conditions before it name
_EARLIER = "PARTITION BY feedback_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_TABLE_OF = f"CASE WHEN n_tables = 1 AND (first_named IS NULL OR (first_named = one_table AND last_named = one_table)) THEN {_mapped(_clean('lower(trim(one_table))'))} WHEN coalesce(n_tables, 0) = 0 AND first_named = last_named THEN {_mapped(_clean('lower(trim(first_named))'))} END"
view("tag_qualified", f"""
SELECT feedback_id, place, operator, value, CASE WHEN field IS NULL THEN NULL WHEN instr(full_field, '.') > 0 THEN concat({_mapped(_clean("lower(trim(regexp_extract(full_field, '^([^.]*)', 1)))"))}, '.', {_clean("lower(regexp_extract(full_field, '^[^.]*[.](.*)$', 1))")}) ELSE {_clean('lower(full_field)')} END AS field FROM (
  SELECT x.*, CASE WHEN instr(field, '.') = 0 AND known_table IS NOT NULL AND lower(field) <> known_table THEN concat(known_table, '.', field) ELSE field END AS full_field FROM (
    SELECT y.*, {_TABLE_OF} AS known_table FROM (
      SELECT z.*, min(named) OVER ({_EARLIER}) AS first_named, max(named) OVER ({_EARLIER}) AS last_named FROM (SELECT f.*, CASE WHEN instr(field, '.') > 0 THEN regexp_extract(field, '^([^.]*)', 1) END AS named FROM tag_fields f) z) y) x) w""")
_SAID = f"SELECT feedback_id, coalesce({_WHOLE}, {_pick('operation', _SURFACE, chr(39) + 'EXCLUDE' + chr(39))}) AS operation FROM tag_operation"
_IMPLIED = f"SELECT feedback_id, CASE WHEN RLIKE(t, {fixed.sql(fixed.SAYS_EXCLUDE)}) THEN 'EXCLUDE' WHEN RLIKE(t, {fixed.sql(fixed.SAYS_INCLUDE)}) THEN 'INCLUDE' END AS operation FROM (SELECT feedback_id, lower(min(text)) AS t FROM tag_words GROUP BY feedback_id) a"
_OPERATORS = [(p, o) for o, phrases in fixed.OPERATOR_PHRASES.items() for p in phrases]
_RULES = f"""
SELECT n.feedback_id, {_clean('trim(t.business_term)')} AS business_term, coalesce(s.operation, i.operation) AS operation, q.place, q.field, {_pick('lower(q.operator)', _OPERATORS, chr(39) + 'EQUALS' + chr(39))} AS operator, q.value, q.value IS NOT NULL AND q.field IS NULL AS needs_clarification
FROM tag_counts n LEFT JOIN tag_term t ON t.feedback_id = n.feedback_id LEFT JOIN ({_SAID}) s ON s.feedback_id = n.feedback_id LEFT JOIN ({_IMPLIED}) i ON i.feedback_id = n.feedback_id LEFT JOIN tag_qualified q ON q.feedback_id = n.feedback_id"""
_TABLES = f"SELECT feedback_id, name FROM (SELECT feedback_id, {_mapped(_clean('lower(trim(tok))'))} AS name FROM tag_tables UNION SELECT feedback_id, regexp_extract(field, '^([^.]*)[.]', 1) FROM tag_qualified WHERE instr(field, '.') > 0) x WHERE name <> ''"
view("tag_rules", _RULES)
view("tag_affected", _TABLES)
_CANON = "concat(lower(coalesce(min(business_term), '')), '|', coalesce(min(operation), ''), '|', coalesce(AGG{part|;|part}, ''))"
OPS["ext_20_normalise_components"] = f"""
SELECT r.feedback_id, r.business_term, r.operation, r.place, r.field, r.operator, r.value, r.needs_clarification, a.tables AS affected_tables, substring(f.hash, 1, 12) AS family_id FROM tag_rules r
LEFT JOIN (SELECT feedback_id, AGG{{name|;|name}} AS tables FROM tag_affected GROUP BY feedback_id) a ON a.feedback_id = r.feedback_id
JOIN (SELECT feedback_id, SHA(canon) AS hash FROM (SELECT feedback_id, {_CANON} AS canon FROM (SELECT feedback_id, business_term, operation, CASE WHEN value IS NOT NULL THEN concat(coalesce(field, ''), ' ', lower(operator), ' ', lower(value)) END AS part FROM tag_rules) p GROUP BY feedback_id) c) f ON f.feedback_id = r.feedback_id"""
