"""Dataset building: expansion, dedupe, leakage-free splits, pairs, labels. Choices are ranked by md5 with a salt."""

from rulewright.sources.adapters import view

from . import fixed

OPS: dict[str, str] = {}

# fixed values: words for comparison operators
_WORDS = "CASE operator WHEN 'equals' THEN 'is' WHEN 'not_equals' THEN 'is not' WHEN 'greater_than' THEN 'is above' WHEN 'less_than' THEN 'is below' ELSE operator END"
_PHRASE = f"SELECT rule_id, AGG{{concat(regexp_extract(field, '([a-z_]+)$', 1), ' ', {_WORDS}, ' ', value)| and |pos}} AS phrase FROM conditions GROUP BY rule_id"
OPS["gen_01_condition_phrase"] = _PHRASE
# fixed values: templates by operation
_TEMPLATES = ", ".join(f"('{o}', {i}, '{t}')" for i, (o, t) in enumerate([("exclude", "{term} should not count rows where {cond}"), ("exclude", "Leave out of {term} all where {cond}"), ("include", "{term} should count rows where {cond}"), ("include", "Please include in {term} those where {cond}"), ("restrict", "Limit {term} to {cond}"), ("restrict", "Only show {term} if {cond}"), ("map", "Treat {term} as {cond}"), ("map", "{term} means {cond}")]))
_EXPANDED = f"""
SELECT rule_id, business_term, operation, template_id, replace(replace(template, '{{term}}', business_term), '{{cond}}', phrase) AS feedback_text, rn FROM (
  SELECT r.rule_id, r.business_term, r.operation, t.template_id, t.template, p.phrase, CAST(row_number() OVER (PARTITION BY r.rule_id ORDER BY md5(concat(r.rule_id, '|', CAST(t.template_id AS STRING), '|salt')), t.template_id) AS INT) AS rn
  FROM rules r JOIN (VALUES {_TEMPLATES}) AS t(operation, template_id, template) ON t.operation = r.operation JOIN ({_PHRASE}) p ON p.rule_id = r.rule_id) x WHERE rn <= {{n}}"""
OPS["gen_02_paraphrase"] = _EXPANDED.replace("{n}", "2")
# two ways to say a rule and one in two languages for each, in an order by md5
_SEED = f"SELECT rule_id, concat(lower(substring(t, 1, 1)), substring(t, 2, 10000)) AS t FROM (SELECT rule_id, regexp_replace(feedback_text, '[.]+$', '') AS t FROM ({_EXPANDED.replace('{n}', '1')}) e) x"
_WAYS = fixed.values([(i, t) for i, t in enumerate(fixed.CONVERSATIONAL)], "way, template", "c")
OPS["gen_03_conversational"] = f"""
SELECT rule_id, way, replace(template, '{{rule}}', t) AS feedback_text FROM (SELECT s.rule_id, s.t, c.way, c.template, row_number() OVER (PARTITION BY s.rule_id ORDER BY md5(concat(s.rule_id, '|way|', CAST(c.way AS STRING))), c.way) AS rn FROM ({_SEED}) s CROSS JOIN {_WAYS}) x WHERE rn <= 2"""
_MIXED = fixed.values([(o, i, t) for o, ways in fixed.CODE_MIXED.items() for i, t in enumerate(ways)], "bank, way, template", "m")
OPS["gen_03_code_mixed"] = f"""
SELECT rule_id, bank, way, replace(replace(template, '{{term}}', term), '{{condition}}', phrase) AS feedback_text FROM (
  SELECT r.rule_id, r.term, p.phrase, m.bank, m.way, m.template, row_number() OVER (PARTITION BY r.rule_id ORDER BY md5(concat(r.rule_id, '|mixed|', CAST(m.way AS STRING))), m.way) AS rn
  FROM (SELECT rule_id, {fixed.title("coalesce(nullif(business_term, ''), 'revenue')")} AS term, CASE WHEN coalesce(operation, 'exclude') IN ('exclude', 'include') THEN coalesce(operation, 'exclude') ELSE 'other' END AS bank FROM rules) r JOIN ({_PHRASE}) p ON p.rule_id = r.rule_id JOIN {_MIXED} ON m.bank = r.bank) x WHERE rn = 1"""
# a rule goes with the next one and the next two of its term, in a salted order: every rule leads one pair and one triple
# if it has so many followers, and no combination of all pairs is ever formed
_ORDERED = "PARTITION BY workspace_id, domain_id, business_term ORDER BY md5(concat(rule_id, '|multi')), rule_id"
_COMBINED = f"SELECT a, b, c, pa, pb, pc FROM (SELECT r.rule_id AS a, lead(r.rule_id) OVER ({_ORDERED.replace('rule_id', 'r.rule_id')}) AS b, lead(r.rule_id, 2) OVER ({_ORDERED.replace('rule_id', 'r.rule_id')}) AS c, p.phrase AS pa, lead(p.phrase) OVER ({_ORDERED.replace('rule_id', 'r.rule_id')}) AS pb, lead(p.phrase, 2) OVER ({_ORDERED.replace('rule_id', 'r.rule_id')}) AS pc FROM rules r JOIN ({_PHRASE}) p ON p.rule_id = r.rule_id) x"
OPS["gen_04_multi_rule"] = f"""
SELECT concat('multi_', a, '_', b) AS family, 2 AS n_rules, concat(pa, '. Also, ', pb) AS feedback_text FROM ({_COMBINED}) y WHERE b IS NOT NULL
UNION ALL SELECT concat('multi_', a, '_', b, '_', c), 3, concat(pa, '. Also, ', pb, '. Also, ', pc) FROM ({_COMBINED}) z WHERE c IS NOT NULL"""
OPS["gen_05_ambiguous"] = "SELECT concat('ambiguous_', t.business_term, '_', CAST(q.id AS STRING)) AS family, replace(q.template, '{term}', t.business_term) AS feedback_text FROM (SELECT DISTINCT business_term FROM rules) t CROSS JOIN (VALUES (1, 'Fix {term} somehow'), (2, '{term} looks off lately'), (3, 'Handle {term} properly')) AS q(id, template)"
OPS["gen_06_conflicting"] = "SELECT concat(rule_id, '_conflict') AS rule_id, CASE WHEN threshold > 100 THEN threshold / 2 WHEN threshold > 0 THEN threshold * 2 ELSE threshold END AS threshold, CASE WHEN threshold > 0 THEN operation WHEN operation = 'exclude' THEN 'include' ELSE 'exclude' END AS operation FROM rules"
# fixed values: the least size of a class, and what is put around a seed's own text, in the order of use
FLOOR = 45
WRAPPERS = ["{text}", "Hi, just reaching out: {text}", "A quick note for the team: {text}", "Sharing this: {text}", "Wanted to flag this: {text}", "Noting this for the backlog: {text}", "{text} Thanks.", "{text} Please advise.", "{text} Let me know your thoughts."]
_WRAPPED = "replace(CASE wrapper " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WRAPPERS)) + " END, '{text}', feedback_text)"
# each class is filled up to the floor, here at least half of the largest class: its seeds go round in a salted order, with
# the next wrapper each round; seed k of n is used once for each place p < need with p % n = k
_SIZES = "SELECT feedback_type, count(*) AS n FROM records GROUP BY feedback_type"
OPS["gen_07_top_up"] = f"""
SELECT feedback_type, n, need, seed + tok * n AS place, feedback_id, {_WRAPPED} AS feedback_text FROM (SELECT feedback_type, n, need, seed, feedback_id, feedback_text, tok, tok % {len(WRAPPERS)} AS wrapper FROM UNNEST{{wanted_seeds|feedback_type, n, need, seed, feedback_id, feedback_text|SERIES(copies)}} u) x"""
view("wanted_seeds", f"""
SELECT feedback_type, n, need, seed, feedback_id, feedback_text, CAST(floor((need - seed + n - 1) / CAST(n AS DOUBLE)) AS BIGINT) AS copies FROM (
  SELECT r.feedback_type, c.n, greatest({FLOOR}, CAST(floor(m.largest / CAST(2 AS DOUBLE)) AS BIGINT)) - c.n AS need, r.feedback_id, rtrim(r.feedback_text) AS feedback_text, CAST(row_number() OVER (PARTITION BY r.feedback_type ORDER BY md5(r.feedback_id), r.feedback_id) - 1 AS BIGINT) AS seed
  FROM records r JOIN ({_SIZES}) c ON c.feedback_type = r.feedback_type CROSS JOIN (SELECT max(n) AS largest FROM ({_SIZES}) s) m WHERE c.n < greatest({FLOOR}, CAST(floor(m.largest / CAST(2 AS DOUBLE)) AS BIGINT))) x WHERE seed < need""")
# fixed values: words that decide a bank text's label, first hit wins
_BANK = "CASE WHEN kind = 'spam' THEN 'irrelevant_spam' WHEN RLIKE(lower(text), '(broken|error|crash|slow|fails)') THEN 'issue_report' WHEN RLIKE(text, '[?]$') THEN 'question' WHEN RLIKE(lower(text), '(add|please|would like|could you)') THEN 'feature_request' ELSE 'general_feedback' END"
# bank texts about each term, and for each rule a record that refers to a table and a column that no catalog has
OPS["gen_08_banks"] = f"""
SELECT kind, concat(kind, '_', CAST(id AS STRING), '_', business_term) AS family, replace(text, '{{term}}', business_term) AS text, {_BANK} AS label, 'pass' AS schema_expected
FROM (VALUES ('nonrule', 1, 'The {{term}} page is broken'), ('nonrule', 2, 'Could you add {{term}} to the export'), ('nonrule', 3, 'Why is {{term}} so low?'), ('spam', 4, 'Win a free trip to {{term}}'), ('nonrule', 5, 'Great work on {{term}}')) AS b(kind, id, text) CROSS JOIN (SELECT DISTINCT business_term FROM rules) t
UNION ALL SELECT 'invalid_reference', concat('invalid_', rule_id), concat('Exclude ', business_term, ' where no_such_table.no_such_column is 1'), 'business_rule', 'fail' FROM rules"""
# every field of a record's conditions and its own column must be in the catalog and in the record's context
OPS["gen_09_expected_validity"] = """
SELECT rec.feedback_id, CASE WHEN bool_and(k.column_name IS NOT NULL AND (f.field = rec.context_field OR f.field = rec.used_field)) THEN 'pass' ELSE 'fail' END AS schema_expected, count(*) AS n_fields
FROM records rec JOIN (SELECT rule_id, field FROM conditions UNION SELECT rule_id, concat(affected_table, '.', affected_column) FROM rules) f ON f.rule_id = rec.rule_id LEFT JOIN catalog k ON k.domain = rec.domain AND concat(k.table_name, '.', k.column_name) = f.field GROUP BY rec.feedback_id"""
_ALL = f"SELECT 'paraphrase' AS generator, 1 AS gen_order, rule_id AS source_id, feedback_text FROM ({OPS['gen_02_paraphrase']}) a UNION ALL SELECT 'conversational', 2, rule_id, feedback_text FROM ({OPS['gen_03_conversational']}) b UNION ALL SELECT 'ambiguous', 3, family, feedback_text FROM ({OPS['gen_05_ambiguous']}) c UNION ALL SELECT 'multi_rule', 4, family, feedback_text FROM ({OPS['gen_04_multi_rule']}) d UNION ALL SELECT 'rephrase', 5, concat(feedback_id, '_', CAST(place AS STRING)), feedback_text FROM ({OPS['gen_07_top_up']}) e UNION ALL SELECT kind, 6, family, text FROM ({OPS['gen_08_banks']}) f UNION ALL SELECT 'code_mixed', 7, rule_id, feedback_text FROM ({OPS['gen_03_code_mixed']}) h"
OPS["gen_10_all"] = f"SELECT concat('GEN', substring(md5(concat(generator, '|', source_id, '|', feedback_text)), 1, 12)) AS feedback_id, generator, source_id, feedback_text FROM ({_ALL}) g"
OPS["gen_10_counts"] = f"SELECT generator, gen_order, count(*) AS n, count(DISTINCT feedback_text) AS n_texts FROM ({_ALL}) g GROUP BY generator, gen_order"
OPS["gen_11_dedupe"] = f"SELECT generator, source_id, feedback_text FROM (SELECT g.*, row_number() OVER (PARTITION BY feedback_text ORDER BY gen_order, source_id) AS rn FROM ({_ALL}) g) d WHERE rn = 1"
_FAMILIES = "SELECT rule_family_id, count(*) AS n, md5(concat(rule_family_id, '|split')) AS place FROM records GROUP BY rule_family_id"
# running sums over all families in two steps: inside each of 256 buckets of their places, and what the buckets before it
# hold in all; each bucket sends its total to those after it
_HEX = "(instr('0123456789abcdef', substring(place, {0}, 1)) - 1)"
view("split_families", f"SELECT rule_family_id, n, place, CAST(16 * {_HEX.format(1)} + {_HEX.format(2)} AS INT) AS bucket FROM ({_FAMILIES}) f")
view("split_buckets", "SELECT bucket, n, families, CAST(255 - bucket AS BIGINT) AS later FROM (SELECT bucket, CAST(sum(n) AS BIGINT) AS n, count(*) AS families FROM split_families GROUP BY bucket) b")
view("split_places", """
SELECT f.rule_family_id, f.n, f.upto + coalesce(b.n, 0) AS upto, f.rn + coalesce(b.families, 0) AS rn, t.total, t.families FROM (
  SELECT rule_family_id, n, bucket, CAST(sum(n) OVER (PARTITION BY bucket ORDER BY place, rule_family_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto, row_number() OVER (PARTITION BY bucket ORDER BY place, rule_family_id) AS rn FROM split_families) f
LEFT JOIN (SELECT bucket + 1 + pos AS bucket, CAST(sum(n) AS BIGINT) AS n, CAST(sum(families) AS BIGINT) AS families FROM UNNEST{split_buckets|bucket, n, families|SERIES(later)} u GROUP BY bucket + 1 + pos) b ON b.bucket = f.bucket
CROSS JOIN (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(families) AS BIGINT) AS families FROM split_buckets) t""")
_SPLIT = "SELECT rule_family_id, n, CASE WHEN upto <= total * 0.2 THEN 'test' WHEN upto <= total * 0.35 THEN 'val' ELSE 'train' END AS split FROM split_places"
OPS["gen_12_split_by_size"] = f"SELECT r.feedback_id, r.rule_family_id, s.split FROM records r JOIN ({_SPLIT}) s ON s.rule_family_id = r.rule_family_id"
OPS["gen_13_split_by_ratio"] = "SELECT rule_family_id, CASE WHEN rn * 10 <= families * 7 THEN 'train' WHEN rn * 10 <= families * 8 THEN 'val' ELSE 'test' END AS split FROM split_places"
OPS["gen_14_task_sets"] = "SELECT 'classification' AS task, feedback_id, feedback_type AS target FROM records UNION ALL SELECT 'extraction', feedback_id, rule_id FROM records WHERE is_actionable UNION ALL SELECT 'clarification', feedback_id, CASE WHEN requires_clarification THEN 'yes' ELSE 'no' END FROM records WHERE is_actionable OR requires_clarification"
# any two records of a family are duplicates: a row for each record names its representative, the number of records and of
# the pairs that they stand for, so no link is lost and no family's square is written
OPS["gen_15_duplicate_pairs"] = """
SELECT r.feedback_id, r.rule_family_id, f.representative, f.n, CAST(f.n * (f.n - 1) / 2 AS BIGINT) AS n_pairs, concat(f.representative, '-', r.feedback_id) AS pair_id, 'duplicate' AS relationship FROM records r
JOIN (SELECT m.rule_family_id, m.n, min(x.feedback_id) AS representative FROM (SELECT rule_family_id, count(*) AS n, min(record_no) AS first_no FROM records WHERE rule_family_id <> '' GROUP BY rule_family_id) m
  JOIN records x ON x.rule_family_id = m.rule_family_id AND x.record_no = m.first_no WHERE m.n > 1 GROUP BY m.rule_family_id, m.n) f ON f.rule_family_id = r.rule_family_id"""
_FIRST = "SELECT rule_family_id, feedback_id FROM (SELECT rule_family_id, feedback_id, row_number() OVER (PARTITION BY rule_family_id ORDER BY record_no) AS rn FROM records) f WHERE rn = 1"
OPS["gen_16_conflict_pairs"] = f"SELECT a.feedback_id AS feedback_id_1, b.feedback_id AS feedback_id_2, a.rule_family_id, 'conflict' AS relationship FROM ({_FIRST}) a JOIN ({_FIRST}) b ON b.rule_family_id = concat(a.rule_family_id, '_conflict')"
OPS["gen_17_family_analysis"] = "SELECT rule_family_id, count(*) AS n, bool_or(feedback_type = 'business_rule') AS has_rule, CASE WHEN rule_family_id LIKE '%_conflict' THEN 'conflict' ELSE 'base' END AS bucket, min(feedback_id) AS first_id FROM records GROUP BY rule_family_id"
# a number from 0 to 1 by the first four hexadecimal digits of a token's place
_DIGIT = "(instr('0123456789abcdef', substring(md5(concat(CAST(t.feedback_id AS STRING), '/', CAST(t.pos AS STRING))), {0}, 1)) - 1)"
_DRAWN = "(" + " + ".join(f"{_DIGIT.format(k)} / CAST({16 ** k} AS DOUBLE)" for k in (1, 2, 3, 4)) + ")"
_TOKENS = "SELECT t.feedback_id, t.pos, t.tok, CASE WHEN lower(t.tok) IN ('revenue', 'customers') THEN 'B-TERM' WHEN RLIKE(t.tok, '^[a-z_]+[.][a-z_]+$') THEN 'B-COLUMN' WHEN RLIKE(t.tok, '^[0-9]+$') THEN 'B-THRESHOLD' WHEN lower(t.tok) IN ('exclude', 'include', 'only') THEN 'B-OPERATION' WHEN lower(t.tok) IN ('active', 'cancelled') THEN 'B-VALUE' ELSE 'O' END AS label FROM UNNEST{feedback|feedback_id|split(feedback_text, ' ')} t WHERE t.tok <> ''"
OPS["gen_18_token_labels"] = _TOKENS
# fixed values: words that stand for a comparison in a text
_SAYS = fixed.values([(o, p) for o, phrases in fixed.OPERATOR_PHRASES.items() for p in phrases], "operator, phrase", "s")
_DOES = fixed.values([(o, p) for o, phrases in fixed.OPERATION_PHRASES.items() for p in phrases], "operation, phrase", "d")
_IS_THRESHOLD = "(c.operator IN ('greater_than', 'less_than') OR CAST(r.threshold AS STRING) = c.value OR CAST(CAST(r.threshold AS BIGINT) AS STRING) = c.value)"
# what a rule's text can name, with the priority of its label: term, field, threshold, value, operation, scope, window, table,
# column; names with underscores count with blanks too
view("rule_mentions", f"""
SELECT DISTINCT rule_id, priority, label, mention FROM (
  SELECT rule_id, 1 AS priority, 'BUSINESS_TERM' AS label, lower(business_term) AS mention FROM rules UNION ALL SELECT rule_id, 1, 'BUSINESS_TERM', replace(lower(business_term), '_', ' ') FROM rules
  UNION ALL SELECT rule_id, 2, 'FIELD', lower(regexp_extract(field, '([^.]*)$', 1)) FROM conditions UNION ALL SELECT rule_id, 2, 'FIELD', replace(lower(regexp_extract(field, '([^.]*)$', 1)), '_', ' ') FROM conditions
  UNION ALL SELECT c.rule_id, CASE WHEN {_IS_THRESHOLD} THEN 3 ELSE 4 END, CASE WHEN {_IS_THRESHOLD} THEN 'THRESHOLD' ELSE 'VALUE' END, lower(c.value) FROM conditions c JOIN rules r ON r.rule_id = c.rule_id WHERE length(c.value) > 1 OR RLIKE(c.value, '^[0-9]$')
  UNION ALL SELECT rule_id, 5, 'OPERATION', lower(operation) FROM rules UNION ALL SELECT r.rule_id, 5, 'OPERATION', d.phrase FROM rules r JOIN {_DOES} ON d.operation = r.operation UNION ALL SELECT c.rule_id, 5, 'OPERATION', s.phrase FROM conditions c JOIN {_SAYS} ON s.operator = c.operator
  UNION ALL SELECT rule_id, 6, 'SCOPE', lower(scope) FROM rules WHERE scope <> 'global' UNION ALL SELECT rule_id, 7, 'TIME_WINDOW', lower(time_window) FROM rules UNION ALL SELECT rule_id, 7, 'TIME_WINDOW', replace(lower(time_window), '_', ' ') FROM rules
  UNION ALL SELECT rule_id, 8, 'TABLE', lower(tok) FROM UNNEST{{rules|rule_id|split(entity_tables, ';')}} a UNION ALL SELECT rule_id, 9, 'COLUMN', lower(regexp_extract(tok, '([^.]*)$', 1)) FROM UNNEST{{rules|rule_id|split(entity_columns, ';')}} b) m WHERE mention <> ''""")
# a token begins a mention that starts in it, and is inside one that started before it and ends with it or later; a number
# is the token's own number, whatever stands around it
_PLACED = "SELECT feedback_id, rule_id, pos, tok, t, CAST(start AS BIGINT) AS start FROM (SELECT feedback_id, rule_id, pos, tok, t, coalesce(sum(length(tok) + 1) OVER (PARTITION BY feedback_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM UNNEST{labelled_texts|feedback_id, rule_id, t|split(t, ' ')} u) x WHERE tok <> ''"
view("labelled_texts", "SELECT feedback_id, rule_id, lower(feedback_text) AS t FROM records")
_LOW = "greatest(start + length(tok) - length(mention), 0)"
_MENTIONED = f"""
SELECT feedback_id, pos, priority, label, mention, CASE WHEN RLIKE(mention, '^[0-9,]+$') THEN RLIKE(replace(tok, ',', ''), concat('(^|[^0-9])', replace(mention, ',', ''), '([^0-9]|$)')) ELSE instr(substring(t, CAST(start + 1 AS INT), CAST(length(tok) - 1 + length(mention) AS INT)), mention) BETWEEN 1 AND length(tok) END AS begins,
  NOT RLIKE(mention, '^[0-9,]+$') AND start - 1 >= {_LOW} AND instr(substring(t, CAST({_LOW} + 1 AS INT), CAST(greatest(start - 1 + length(mention) - {_LOW}, 0) AS INT)), mention) > 0 AS inside
FROM (SELECT p.*, m.priority, m.label, m.mention FROM ({_PLACED}) p JOIN rule_mentions m ON m.rule_id = p.rule_id AND instr(replace(p.t, ',', ''), replace(m.mention, ',', '')) > 0) y"""
OPS["gen_18_bio"] = f"""
SELECT p.feedback_id, CAST(row_number() OVER (PARTITION BY p.feedback_id ORDER BY p.pos) - 1 AS INT) AS place, p.tok, p.start AS start_offset, p.start + length(p.tok) AS end_offset, coalesce(l.label, 'O') AS label FROM ({_PLACED}) p
LEFT JOIN (SELECT feedback_id, pos, concat(CASE WHEN begins THEN 'B_' ELSE 'I_' END, label) AS label FROM (SELECT m.*, row_number() OVER (PARTITION BY feedback_id, pos ORDER BY priority, CASE WHEN begins THEN 0 ELSE 1 END, mention) AS rn FROM ({_MENTIONED}) m WHERE begins OR inside) z WHERE rn = 1) l ON l.feedback_id = p.feedback_id AND l.pos = p.pos"""
OPS["gen_19_label_distribution"] = f"SELECT label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM ({_TOKENS}) t GROUP BY label"
# O tokens stay with the share that makes them 70 % of what stays; which ones is up to the md5 of their place
OPS["gen_19_downsample"] = f"""
SELECT t.feedback_id, t.pos, t.tok, t.label FROM ({_TOKENS}) t CROSS JOIN (SELECT least(CAST(1 AS DOUBLE), 7 * count_if(label <> 'O') / (CAST(3 AS DOUBLE) * greatest(count_if(label = 'O'), 1))) AS rate FROM ({_TOKENS}) c) s
WHERE t.label <> 'O' OR {_DRAWN} < s.rate"""
# which split a record is in is an input; a family in more than one of them leaks
OPS["gen_20_leakage"] = """
SELECT splits, count(*) AS n_families, min(rule_family_id) AS example FROM (SELECT rule_family_id, AGG{split|,|split} AS splits, count(*) AS n FROM (SELECT DISTINCT rule_family_id, split FROM given_splits) d GROUP BY rule_family_id) f WHERE n > 1 GROUP BY splits"""
view("given_splits", "SELECT feedback_id, rule_family_id, CASE substring(md5(concat(feedback_id, '|naive')), 1, 1) WHEN '0' THEN 'val' WHEN '1' THEN 'test' ELSE 'train' END AS split FROM records")
# fixed values: the labels that may occur, the target share of each split, and how far a size may be off
_KNOWN = "('business_rule', 'issue_report', 'feature_request', 'question', 'general_feedback', 'irrelevant_spam')"
_PROFILED = f"SELECT s.split, r.feedback_type, count(*) AS n, count_if(r.rule_category IS NULL AND r.feedback_type = 'business_rule') AS missing_category, count_if(coalesce(trim(r.feedback_text), '') = '') AS missing_text FROM records r JOIN ({_SPLIT}) s ON s.rule_family_id = r.rule_family_id GROUP BY s.split, r.feedback_type"
OPS["gen_21_profile"] = f"SELECT split, feedback_type, n, missing_category, missing_text, feedback_type NOT IN {_KNOWN} AS unexpected, round(1e2 * n / CAST(sum(n) OVER (PARTITION BY split) AS DOUBLE), 4) AS percent FROM ({_PROFILED}) p"
OPS["gen_21_sizes"] = f"""
SELECT split, n, target, abs(n - target) <= 0.3 * target AS in_range FROM (SELECT x.split, x.n, round(x.total * t.share, 4) AS target FROM (SELECT split, CAST(sum(n) AS BIGINT) AS n, CAST(sum(sum(n)) OVER () AS BIGINT) AS total FROM ({_PROFILED}) p GROUP BY split) x
JOIN (VALUES ('train', CAST(0.65 AS DOUBLE)), ('val', CAST(0.15 AS DOUBLE)), ('test', CAST(0.2 AS DOUBLE))) AS t(split, share) ON t.split = x.split) y"""
# seeds stay; a new record joins them if its id is new
view("new_records", "SELECT concat('FB', CAST(2 * feedback_id AS STRING)) AS feedback_id FROM feedback")
OPS["gen_22_merge_seeds"] = "SELECT feedback_id, 'seed' AS origin FROM records UNION ALL SELECT n.feedback_id, 'new' FROM new_records n WHERE NOT EXISTS (SELECT 1 FROM records s WHERE s.feedback_id = n.feedback_id)"
