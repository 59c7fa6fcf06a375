"""Structured extraction."""

from rulewright.sources.adapters import view

from . import fixed, terms

OPS: dict[str, str] = {}

OPS["ext_01_glossary_match"] = terms.GLOSSARY_MATCH
OPS["ext_02_primary_term"] = f"""
SELECT f.feedback_id, coalesce(m.term, nullif(regexp_extract(lower(f.feedback_text), '(?:exclude|include|calculate) ([a-z_]+)', 1), ''), 'metric') AS term,
  CASE WHEN m.term IS NOT NULL AND m.matched_exactly THEN CAST(0.95 AS DOUBLE) WHEN m.term IS NOT NULL THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence
FROM feedback f LEFT JOIN (SELECT * FROM ({OPS["ext_01_glossary_match"]}) y WHERE rn = 1) m ON m.feedback_id = f.feedback_id"""
# fixed values: operations in order, each with its verbs
OPERATIONS = [("exclude", "(exclude|remove|ignore|without)"), ("include", "(include|add|count)"), ("restrict", "(restrict|limit|only)"), ("map", "(map|rename|treat .* as)"), ("calculate", "(calculate|computed?)")]
_FOUND = ", ".join(f"CASE WHEN RLIKE(lower(feedback_text), '{p}') THEN '{o}' END" for o, p in OPERATIONS)
OPS["ext_03_operations"] = f"SELECT feedback_id, concat_ws(',', {_FOUND}) AS operations, coalesce({_FOUND}, 'unknown') AS first_operation FROM feedback"
_FIELD = r"(\w+(?:[.]\w+)?)\s+(is|equals|contains|matches)\s+['\"]?(\w+)"
# fixed values: words that don't name the field of a comparison, and the operator of each comparison
_COPULAS = "is|be|are|was|were|should|must|will|can|would|could|shall|the|a|an|of|to|by|that|this|for|in|at|with|than"
_COMPARE = r"\b(?:greater than|less than|more than|exceeds|above|over|below|under)\s+['\"]?[0-9.]+['\"]?\b"
_EACH = "SELECT feedback_id, pos, tok FROM UNNEST{feedback|feedback_id|regexp_extract_all(lower(feedback_text), PATTERN, 0)} u"
# what stands before each comparison: the pieces between comparisons and the comparisons before it, by their lengths
_BEFORE = f"""
SELECT feedback_id, pos, tok, substring(t, 1, CAST(upto - length(tok) AS INT)) AS before FROM (
  SELECT p.feedback_id, p.pos, c.tok, p.t, sum(length(p.tok) + length(c.tok)) OVER (PARTITION BY p.feedback_id ORDER BY p.pos) AS upto
  FROM (SELECT feedback_id, pos, tok, t FROM UNNEST{{compared|feedback_id, t|SPLITRE(t, {fixed.sql(_COMPARE)})}} a) p JOIN (SELECT feedback_id, pos, tok FROM UNNEST{{compared|feedback_id|regexp_extract_all(t, {fixed.sql(_COMPARE)}, 0)}} b) c ON c.feedback_id = p.feedback_id AND c.pos = p.pos) x"""
view("compared", f"SELECT feedback_id, lower(feedback_text) AS t FROM feedback WHERE RLIKE(lower(feedback_text), {fixed.sql(_COMPARE)})")
# the field is the last word before the comparison that can name one; a word counts without the marks at its ends
_WORDS = f"KEEP⟦MAP⟦SPLITRE(before, '\\s+')¦w¦regexp_replace(w, '^[,;:()]+|[,;:()]+$', ''@G)⟧¦w¦w <> '' AND NOT RLIKE(w, '^({_COPULAS})$')⟧"
# every match of a text, each with its own field, operator and value
OPS["ext_04_conditions"] = f"""
SELECT feedback_id, 0 AS kind, pos AS place, regexp_extract(tok, {fixed.sql(_FIELD)}, 1) AS field, CASE regexp_extract(tok, {fixed.sql(_FIELD)}, 2) WHEN 'contains' THEN 'contains' ELSE 'equals' END AS operator, regexp_extract(tok, {fixed.sql(_FIELD)}, 3) AS value FROM ({_EACH.replace("PATTERN", fixed.sql(_FIELD))}) a
UNION ALL
SELECT feedback_id, 1, pos, coalesce(LAST⟦words⟧, 'metric'), CASE WHEN RLIKE(tok, '^(less than|below|under)') THEN 'less_than' ELSE 'greater_than' END, regexp_extract(tok, '([0-9.]+)', 1) FROM (SELECT feedback_id, pos, tok, {_WORDS} AS words FROM ({_BEFORE}) y) z"""
_AFTER = "(exclude|include|filter|remove|add|apply) (?:by )?([a-z_]+ [a-z_]+)"
# fixed values: kinds of phrases with their confidence; of phrases that repeat the surest stays
_KINDS = [("verb", _AFTER, 2, 0.75), ("when", "when ([a-z_. ]+)", 1, 0.7), ("where", "where ([a-z_. ]+)", 1, 0.7), ("if", "if ([a-z_. ]+)", 1, 0.7), ("noun", "([a-z_]+ [a-z_]+) (?:from|where|that) ", 1, 0.65)]
_PHRASE = " UNION ALL ".join(f"SELECT feedback_id, trim(regexp_extract(tok, '{p}', {g})) AS phrase, '{k}' AS source, CAST({c} AS DOUBLE) AS confidence, {i} AS kind, pos FROM ({_EACH.replace('PATTERN', fixed.sql(p))}) x{i}" for i, (k, p, g, c) in enumerate(_KINDS))
OPS["ext_05_candidates"] = f"SELECT feedback_id, phrase, source, confidence FROM (SELECT x.*, row_number() OVER (PARTITION BY feedback_id, phrase ORDER BY kind, pos) AS rn FROM ({_PHRASE}) x WHERE phrase NOT IN ('', 'revenue', 'calculation', 'total')) y WHERE rn = 1"
# fixed values: words that are a status by themselves
STATUS = "(cancelled|completed|pending|active|inactive|open|closed)"
OPS["ext_06_promote"] = f"""
SELECT feedback_id, phrase, CASE WHEN NOT RLIKE(phrase, ' ') THEN phrase WHEN RLIKE(phrase, '^{STATUS} ') THEN regexp_extract(phrase, '^{STATUS}', 1) WHEN RLIKE(phrase, ' {STATUS}$') THEN regexp_extract(phrase, '{STATUS}$', 1)
  WHEN RLIKE(phrase, '^status [a-z]+$') THEN regexp_extract(phrase, '^status ([a-z]+)$', 1) END AS value FROM ({OPS["ext_05_candidates"]}) p"""
OPS["ext_07_qualify"] = """
SELECT c.rule_id, c.pos, c.field, CASE WHEN instr(c.field, '.') > 0 THEN c.field WHEN k.n = 1 THEN concat(k.first_table, '.', c.field) WHEN k.n > 1 THEN concat(coalesce(m.table_name, k.first_table), '.', c.field) ELSE concat(r.affected_table, '.', c.field) END AS qualified
FROM conditions c JOIN rules r ON r.rule_id = c.rule_id
LEFT JOIN (SELECT domain, column_name, count(*) AS n, min(table_name) AS first_table FROM catalog GROUP BY domain, column_name) k ON k.domain = c.domain_id AND k.column_name = c.field
LEFT JOIN catalog m ON m.domain = c.domain_id AND m.column_name = c.field AND m.table_name = r.affected_table"""
OPS["ext_08_scope"] = "SELECT feedback_id, CASE " + " ".join(f"WHEN RLIKE(t, {fixed.sql(p)}) THEN '{o}'" for p, o in fixed.SCOPES) + " ELSE 'global' END AS scope FROM (SELECT feedback_id, lower(feedback_text) AS t FROM feedback) f"


def _window(pattern: str, token: str) -> str:
    """The token of a time window, with the number and unit that the pattern finds."""
    parts = [f"'{token}'"]
    if "{n}" in token:
        head, tail = token.split("{n}")
        parts = [f"'{head}'", f"regexp_extract(t, {fixed.sql(pattern)}, 1)", f"'{tail}'"]
        if "{unit}" in tail:
            parts[2:] = ["'_'", f"regexp_extract(t, {fixed.sql(pattern)}, 2)"]
    return f"WHEN RLIKE(t, {fixed.sql(pattern)}) THEN concat({', '.join(parts)})"


OPS["ext_09_time_window"] = "SELECT feedback_id, CASE " + " ".join(_window(p, t) for p, t in fixed.TIME_WINDOWS) + " END AS time_window FROM (SELECT feedback_id, lower(feedback_text) AS t FROM feedback) f"
# tables of the conditions' fields, else of the term's glossary entry, else those the rule lists, else those its name holds
_FIRST_KNOWN = "coalesce(c.tables, g.tables, nullif(r.entity_tables, ''), k.tables, 'unknown')"
OPS["ext_10_affected"] = f"""
SELECT r.rule_id, {_FIRST_KNOWN} AS tables, CASE WHEN c.tables IS NOT NULL THEN 'conditions' WHEN g.tables IS NOT NULL THEN 'glossary' WHEN nullif(r.entity_tables, '') IS NOT NULL THEN 'listed' WHEN k.tables IS NOT NULL THEN 'text' ELSE 'none' END AS source FROM rules r
LEFT JOIN (SELECT rule_id, AGG{{t|;|t}} AS tables FROM (SELECT DISTINCT rule_id, regexp_extract(field, '^([a-z_]+)[.]', 1) AS t FROM conditions) x WHERE t <> '' GROUP BY rule_id) c ON c.rule_id = r.rule_id
LEFT JOIN (SELECT domain, term, AGG{{t|;|t}} AS tables FROM (SELECT DISTINCT domain, term, regexp_extract(ref, '^([a-z_]+)[.]', 1) AS t FROM glossary) x WHERE t <> '' GROUP BY domain, term) g ON g.domain = r.domain_id AND g.term = r.business_term
LEFT JOIN (SELECT b.rule_id, AGG{{n.table_name|;|n.table_name}} AS tables FROM rules b JOIN (SELECT DISTINCT domain, table_name FROM catalog) n ON n.domain = b.domain_id AND instr(lower(b.business_term), n.table_name) > 0 GROUP BY b.rule_id) k ON k.rule_id = r.rule_id"""
# fixed values: confidence of each field; conditions count less where a verb asks for them and none is structured
OPS["ext_11_confidence"] = f"""
SELECT feedback_id, term, operation, conditions, scope, entities, round(least(CAST(0.99 AS DOUBLE), (term + operation + conditions + scope + entities) / 5), 6) AS overall FROM (
  SELECT t.feedback_id, least(CAST(0.95 AS DOUBLE), t.confidence) AS term, CASE o.first_operation WHEN 'exclude' THEN CAST(0.95 AS DOUBLE) WHEN 'unknown' THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS operation,
    CASE WHEN c.n > 0 THEN CAST(0.7 AS DOUBLE) WHEN RLIKE(lower(f.feedback_text), '(exclude|include|filter)') THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS conditions, CAST(0.8 AS DOUBLE) AS scope, CAST(0.75 AS DOUBLE) AS entities
  FROM feedback f JOIN ({OPS["ext_02_primary_term"]}) t ON t.feedback_id = f.feedback_id JOIN ({OPS["ext_03_operations"]}) o ON o.feedback_id = f.feedback_id LEFT JOIN (SELECT feedback_id, count(*) AS n FROM ({OPS["ext_04_conditions"]}) e GROUP BY feedback_id) c ON c.feedback_id = f.feedback_id) x"""
OPS["ext_13_family_id"] = """
SELECT rule_id, substring(SHA(canon), 1, 12) AS family_id FROM (
  SELECT r.rule_id, concat(lower(min(r.business_term)), '|', upper(min(r.operation)), '|', AGG{part|;|part}) AS canon
  FROM rules r JOIN (SELECT rule_id, concat(lower(field), ' ', operator, ' ', lower(value)) AS part FROM conditions) c ON c.rule_id = r.rule_id GROUP BY r.rule_id) x"""
# the longest phrase of an operation counts, then the first by name: phrases are tried in that order inside the row
_LONGEST = sorted(((p, o) for o, phrases in fixed.OPERATION_PHRASES.items() for p in phrases), key=lambda x: (-len(x[0]), x[0]))
_OPERATORS = sorted(((p, o) for o, phrases in fixed.OPERATOR_PHRASES.items() for p in phrases), key=lambda x: (-len(x[0]), x[0]))
_canonical = lambda t, pairs: "CASE " + " ".join(f"WHEN instr({t}, {fixed.sql(p)}) > 0 THEN '{o}'" for p, o in pairs) + " END"
OPS["ext_14_canonical_operation"] = f"SELECT feedback_id, {_canonical('t', _LONGEST)} AS operation, {_canonical('t', _OPERATORS)} AS operator FROM (SELECT feedback_id, lower(feedback_text) AS t FROM feedback) f"
# fixed values: columns that hold a state, in order
_STATES = ("status", "state", "type", "category", "priority")
_STATE = "CASE column_name " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(_STATES)) + " ELSE 99 END"
# the state column of the rule's table, else a column whose name shares a word with the value, else the glossary's reference
# of a term that holds the value or lies in it
OPS["ext_15_resolve_field"] = f"""
SELECT v.rule_id, coalesce(s.field, min(CASE WHEN instr(concat('_', k.column_name, '_'), concat('_', lower(v.value), '_')) > 0 OR instr(concat(' ', lower(v.value), ' '), concat(' ', replace(k.column_name, '_', ' '), ' ')) > 0 THEN concat(k.table_name, '.', k.column_name) END), min(g.ref)) AS field,
  CASE WHEN s.field IS NOT NULL THEN 'state_column' WHEN min(CASE WHEN instr(concat('_', k.column_name, '_'), concat('_', lower(v.value), '_')) > 0 OR instr(concat(' ', lower(v.value), ' '), concat(' ', replace(k.column_name, '_', ' '), ' ')) > 0 THEN k.column_name END) IS NOT NULL THEN 'column_name' WHEN min(g.ref) IS NOT NULL THEN 'glossary' ELSE 'none' END AS source
FROM (SELECT c.rule_id, c.domain_id, min(c.value) AS value, min(r.affected_table) AS t FROM conditions c JOIN rules r ON r.rule_id = c.rule_id WHERE instr(c.field, '.') = 0 GROUP BY c.rule_id, c.domain_id) v
LEFT JOIN (SELECT domain, table_name, concat(table_name, '.', column_name) AS field FROM (SELECT domain, table_name, column_name, row_number() OVER (PARTITION BY domain, table_name ORDER BY {_STATE}) AS rn FROM catalog WHERE column_name IN {_STATES}) x WHERE rn = 1) s ON s.domain = v.domain_id AND s.table_name = v.t
LEFT JOIN catalog k ON k.domain = v.domain_id LEFT JOIN glossary g ON g.domain = v.domain_id AND (instr(lower(v.value), g.term) > 0 OR instr(g.term, lower(v.value)) > 0) GROUP BY v.rule_id, s.field"""
# names of tables that stand for another; a field of an unknown table or column is pruned and its condition loses it
view("table_synonyms", "SELECT * FROM (VALUES ('ecommerce', 'order', 'orders'), ('ecommerce', 'purchases', 'orders'), ('ecommerce', 'client', 'customers'), ('ecommerce', 'customer', 'customers'), ('support', 'ticket', 'tickets'), ('support', 'case', 'tickets'), ('saas', 'subscription', 'subscriptions')) AS t(domain, alias, table_name)")
OPS["ext_17_ground"] = """
SELECT c.rule_id, c.pos, CASE WHEN k.column_name IS NULL THEN NULL ELSE c.grounded END AS field, CASE WHEN k.column_name IS NULL THEN c.field END AS pruned, c.grounded <> c.field AS renamed
FROM (SELECT c.rule_id, c.pos, c.domain_id, c.field, CASE WHEN s.table_name IS NULL THEN c.field ELSE concat(s.table_name, regexp_extract(c.field, '([.].*)$', 1)) END AS grounded FROM conditions c LEFT JOIN table_synonyms s ON s.domain = c.domain_id AND s.alias = regexp_extract(c.field, '^([^.]*)', 1)) c
LEFT JOIN catalog k ON k.domain = c.domain_id AND concat(k.table_name, '.', k.column_name) = c.grounded
UNION ALL SELECT r.rule_id, 1000 + t.pos, CASE WHEN n.table_name IS NULL THEN NULL ELSE coalesce(s.table_name, t.tok) END, CASE WHEN n.table_name IS NULL THEN t.tok END, s.table_name IS NOT NULL FROM rules r JOIN UNNEST{rules|rule_id|split(entity_tables, ';')} t ON t.rule_id = r.rule_id
LEFT JOIN table_synonyms s ON s.domain = r.domain_id AND s.alias = t.tok LEFT JOIN (SELECT DISTINCT domain, table_name FROM catalog) n ON n.domain = r.domain_id AND n.table_name = coalesce(s.table_name, t.tok) WHERE t.tok <> ''"""
# what a text implies, by a table of patterns that each text meets once: 1 adjective and noun, 2 a time and a table, 3 where a
# column is, 4 a payment method, 5 a noun that was something, 6 what was successfully processed
_ADJECTIVES = list(dict.fromkeys(adjective for adjective, *_ in fixed.STATES))
_PATTERNS = [
    *((1, i, rf"\b{a}\s+\w+\b", a) for i, a in enumerate(_ADJECTIVES)), *((2, i, p, v) for i, (p, v) in enumerate(fixed.TIMES)), (3, 0, r"where\s+\w+\s+(?:is|equals?|=)\s+\w+", ""), (4, 0, r"payment\s+method\s+(?:is|equals?|=)\s+\w+", ""),
    *((5, i, rf"\b\w+\s+that\s+(?:were|was|have been|had been|got)\s+(?:successfully\s+)?{a}\b", a) for i, a in enumerate(_ADJECTIVES)), (6, 0, r"successfully\s+processed\s+\w+\b", ""),
]
view("feedback_domains", "SELECT feedback_id, CASE workspace_id WHEN 'ws_1' THEN 'support' WHEN 'ws_2' THEN 'saas' WHEN 'ws_4' THEN 'support' ELSE 'ecommerce' END AS domain FROM feedback")
view("pattern_texts", f"SELECT f.feedback_id, f.t, p.family, p.place, p.pattern, p.word FROM lowered f CROSS JOIN {fixed.values(_PATTERNS, 'family, place, pattern, word', 'p')} WHERE RLIKE(f.t, p.pattern)")
_NOUN = r"CASE family WHEN 5 THEN regexp_extract(tok, '^(\w+)', 1) WHEN 2 THEN NULL WHEN 4 THEN NULL WHEN 3 THEN regexp_extract(tok, '^where\s+(\w+)', 1) ELSE regexp_extract(tok, '(\w+)$', 1) END"
view("implied", f"SELECT m.feedback_id, d.domain, m.family, m.place, m.word, m.tok, m.noun, regexp_replace(m.noun, 's+$', '') AS singular FROM (SELECT feedback_id, family, place, word, tok, {_NOUN} AS noun FROM UNNEST{{pattern_texts|feedback_id, family, place, word|regexp_extract_all(t, pattern, 0)}} u) m JOIN feedback_domains d ON d.feedback_id = m.feedback_id")
view("known_tables", "SELECT DISTINCT domain, table_name FROM catalog")
_SYNONYM = lambda x: f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.NOUN_SYNONYMS.items()) + " END"
# a noun's table: itself, its singular, what either stands for, else the noun
view("implied_tables", f"""
SELECT i.*, coalesce(a.table_name, b.table_name, {_SYNONYM('i.noun')}, {_SYNONYM('i.singular')}, i.noun) AS found FROM implied i LEFT JOIN known_tables a ON a.domain = i.domain AND a.table_name = i.noun LEFT JOIN known_tables b ON b.domain = i.domain AND b.table_name = i.singular WHERE i.family IN (1, 5, 6)""")
_STATED = fixed.values([(a, i, t, c, v) for i, (a, t, c, v) in enumerate(fixed.STATES)], "adjective, rank, table_name, column_name, value", "s")
_BY_STATE = f"SELECT feedback_id, family, place, field, value FROM (SELECT i.feedback_id, i.family, i.place, concat(s.table_name, '.', s.column_name) AS field, s.value, row_number() OVER (PARTITION BY i.feedback_id, i.family, i.place, i.tok ORDER BY s.rank) AS rn FROM implied_tables i JOIN {_STATED} ON s.adjective = i.word AND (i.found = s.table_name OR i.found = regexp_replace(s.table_name, 's+$', '')) WHERE i.family IN (1, 5)) x WHERE rn = 1"
_DATE_RANK = "CASE column_name " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(fixed.DATE_COLUMNS)) + " ELSE 99 END"
view("dated_tables", f"SELECT domain, table_name, column_name FROM (SELECT domain, table_name, column_name, row_number() OVER (PARTITION BY domain, table_name ORDER BY {_DATE_RANK}, column_name) AS rn FROM catalog WHERE {_DATE_RANK} < 99 OR RLIKE(lower(column_name), '(_at$|_date|date$)')) x WHERE rn = 1")
# a time belongs to the first table that the text holds and that has a date
_BY_TIME = r"""
SELECT i.feedback_id, i.family, i.place, concat(d.table_name, '.', d.column_name) AS field, replace(i.word, '{n}', regexp_extract(i.tok, '(\d+)', 1)) AS value FROM implied i
JOIN (SELECT l.feedback_id, min(k.table_name) AS table_name FROM lowered l JOIN feedback_domains f ON f.feedback_id = l.feedback_id JOIN dated_tables k ON k.domain = f.domain AND instr(l.t, lower(k.table_name)) > 0 GROUP BY l.feedback_id) h ON h.feedback_id = i.feedback_id
JOIN dated_tables d ON d.domain = i.domain AND d.table_name = h.table_name WHERE i.family = 2"""
_BY_COLUMN = r"SELECT i.feedback_id, i.family, i.place, concat(k.table_name, '.', i.noun) AS field, regexp_extract(i.tok, '(\w+)$', 1) AS value FROM implied i JOIN (SELECT domain, column_name, min(table_name) AS table_name FROM catalog GROUP BY domain, column_name) k ON k.domain = i.domain AND k.column_name = i.noun WHERE i.family = 3"
_BY_METHOD = r"SELECT feedback_id, family, place, 'payments.payment_method' AS field, regexp_extract(tok, '(\w+)$', 1) AS value FROM implied WHERE family = 4"
_BY_SUCCESS = "SELECT i.feedback_id, i.family, i.place, concat(i.found, '.status') AS field, 'successful' AS value FROM implied_tables i JOIN known_tables k ON k.domain = i.domain AND k.table_name = i.found WHERE i.family = 6"
_INFERRED = " UNION ALL ".join((_BY_STATE, _BY_TIME, _BY_COLUMN, _BY_METHOD, _BY_SUCCESS))
# fixed values: confidence by family
OPS["ext_18_infer"] = f"""
SELECT feedback_id, field, 'equals' AS operator, value, min(family) AS family, CASE min(family) WHEN 2 THEN CAST(0.75 AS DOUBLE) WHEN 3 THEN CAST(0.85 AS DOUBLE) WHEN 4 THEN CAST(0.9 AS DOUBLE) WHEN 6 THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS confidence FROM ({_INFERRED}) x GROUP BY feedback_id, field, value"""
# the term itself, else the term of the domain that shares most characters with it; the first by name of those that do equally
_CHARS = "CAST(COUNT⟦split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')¦x¦instr(lower(r.business_term), x) > 0 AND instr(g.term, x) > 0⟧ AS DOUBLE) / greatest(COUNT⟦split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' ')¦x¦instr(lower(r.business_term), x) > 0 OR instr(g.term, x) > 0⟧, 1)"
OPS["ext_22_glossary_enrich"] = f"""
SELECT rule_id, term, definition, round(score, 6) AS confidence, value_definition FROM (
  SELECT r.rule_id, g.term, g.definition, v.definition AS value_definition, CASE WHEN g.term = lower(r.business_term) THEN CAST(0.95 AS DOUBLE) ELSE {_CHARS} END AS score,
    row_number() OVER (PARTITION BY r.rule_id ORDER BY CASE WHEN g.term = lower(r.business_term) THEN CAST(2 AS DOUBLE) ELSE {_CHARS} END DESC, g.term) AS rn
  FROM rules r LEFT JOIN glossary g ON g.domain = r.domain_id LEFT JOIN (SELECT c.rule_id, min(k.definition) AS definition FROM conditions c JOIN glossary k ON k.domain = c.domain_id AND (k.term = lower(c.value) OR k.ref = c.field) GROUP BY c.rule_id) v ON v.rule_id = r.rule_id) x WHERE rn = 1"""
_PARTS = f"""
SELECT t.feedback_id, t.term, t.confidence, o.first_operation AS operation, o.operations, s.scope, w.time_window, c.field, c.operator, c.value FROM ({OPS["ext_02_primary_term"]}) t JOIN ({OPS["ext_03_operations"]}) o ON o.feedback_id = t.feedback_id
JOIN ({OPS["ext_08_scope"]}) s ON s.feedback_id = t.feedback_id JOIN ({OPS["ext_09_time_window"]}) w ON w.feedback_id = t.feedback_id LEFT JOIN (SELECT * FROM ({OPS["ext_04_conditions"]}) x WHERE kind = 0) c ON c.feedback_id = t.feedback_id"""
OPS["ext_12_assemble"] = f"""
SELECT t.feedback_id, t.term, o.first_operation AS operation, s.scope, w.time_window, c.kind, c.place, c.field, c.operator, c.value, coalesce(n.n, 0) AS n_conditions, v.overall, concat_ws(';', 'term=' || t.term, 'op=' || o.first_operation, 'window=' || w.time_window) AS evidence
FROM ({OPS["ext_02_primary_term"]}) t JOIN ({OPS["ext_03_operations"]}) o ON o.feedback_id = t.feedback_id JOIN ({OPS["ext_08_scope"]}) s ON s.feedback_id = t.feedback_id JOIN ({OPS["ext_09_time_window"]}) w ON w.feedback_id = t.feedback_id
JOIN ({OPS["ext_11_confidence"]}) v ON v.feedback_id = t.feedback_id LEFT JOIN ({OPS["ext_04_conditions"]}) c ON c.feedback_id = t.feedback_id LEFT JOIN (SELECT feedback_id, count(*) AS n FROM ({OPS["ext_04_conditions"]}) m GROUP BY feedback_id) n ON n.feedback_id = t.feedback_id"""
OPS["ext_16_complete"] = f"""
SELECT c.rule_id, c.pos, coalesce(CASE WHEN instr(c.field, '.') > 0 THEN c.field END, r.field) AS field, CASE WHEN instr(c.field, '.') = 0 AND r.field IS NULL THEN 'needs_clarification' WHEN instr(c.field, '.') = 0 THEN 'resolved' ELSE 'explicit' END AS origin,
  CASE WHEN instr(c.field, '.') = 0 AND r.field IS NULL THEN CAST(0.3 AS DOUBLE) WHEN instr(c.field, '.') = 0 THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.95 AS DOUBLE) END AS confidence FROM conditions c LEFT JOIN ({OPS["ext_15_resolve_field"]}) r ON r.rule_id = c.rule_id"""
# the condition's rungs in order: a field with its value, a comparison, a time window, what the text implies, the operation's
# own default; what has none of them keeps its keyword alone
_RUNGS = f"""
SELECT p.feedback_id, p.term, p.operation, p.scope, p.field, p.operator, p.value, n.field AS n_field, n.operator AS n_operator, n.value AS n_value, p.time_window, i.field AS i_field, i.operator AS i_operator, i.value AS i_value FROM ({_PARTS}) p
LEFT JOIN (SELECT feedback_id, field, operator, value FROM ({OPS["ext_04_conditions"]}) x WHERE kind = 1 AND place = 0) n ON n.feedback_id = p.feedback_id
LEFT JOIN (SELECT feedback_id, field, operator, value FROM (SELECT y.*, row_number() OVER (PARTITION BY feedback_id ORDER BY family, field, value) AS rn FROM ({OPS["ext_18_infer"]}) y) z WHERE rn = 1) i ON i.feedback_id = p.feedback_id"""
OPS["ext_21_template"] = f"""
SELECT feedback_id, term, operation, scope, coalesce(field, n_field, CASE WHEN time_window IS NOT NULL THEN 'orders.created_at' END, i_field, CASE WHEN operation = 'exclude' THEN 'orders.status' END) AS field, coalesce(CASE WHEN field IS NOT NULL THEN operator END, n_operator, CASE WHEN time_window IS NOT NULL THEN 'greater_than' END, i_operator, CASE WHEN operation = 'exclude' THEN 'equals' END) AS operator,
  coalesce(value, n_value, time_window, i_value, CASE WHEN operation = 'exclude' THEN 'cancelled' END) AS value,
  CASE WHEN field IS NOT NULL THEN 'explicit' WHEN n_field IS NOT NULL THEN 'comparison' WHEN time_window IS NOT NULL THEN 'time_window' WHEN i_field IS NOT NULL THEN 'implied' WHEN operation = 'exclude' THEN 'default' ELSE 'keyword' END AS rung FROM ({_RUNGS}) p"""
