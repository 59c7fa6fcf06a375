"""Filtering and classification."""

from rulewright.sources.adapters import view

from . import fixed, terms

OPS: dict[str, str] = {}

def _mash(word: str) -> str:
    """A word of three letters or more that lies on one row of the keyboard."""
    return f"(length({word}) >= 3 AND ({' OR '.join(f'instr({fixed.sql(row)}, {word}) > 0' for row in fixed.KEYBOARD_ROWS)}))"


def _features(keep: str, view: str, text: str) -> str:
    """The columns `keep`, t and counts over the tokens of a text, inside the row: nothing is exploded, shuffled or joined.
    What a stripped token reads as is one letter, m(ashed), t(riple), x (letters with digits), n(umber), e(mpty) or p(lain)."""
    kind = "CASE WHEN w = '' THEN 'e' ELSE concat(CASE WHEN TRIPLE(w) THEN 't' ELSE '' END, CASE WHEN RLIKE(w, '[a-z][^0-9]*[0-9]|[0-9][^a-z]*[a-z]') THEN 'x' ELSE '' END, CASE WHEN RLIKE(w, '^\\d{3,}$') THEN 'n' ELSE '' END, CASE WHEN " + _mash("w") + " THEN 'm' ELSE '' END, '.') END"
    return f"""
SELECT {keep}, t, len_words AS n_tokens, COUNT⟦raw_kinds¦k¦k = 'm'⟧ AS mash, COUNT⟦kinds¦k¦instr(k, 't') > 0⟧ AS repeated, COUNT⟦kinds¦k¦instr(k, 'x') > 0⟧ AS mixed, COUNT⟦kinds¦k¦instr(k, 'n') > 0⟧ AS numbers,
  CASE WHEN len_words = 0 THEN CAST(0 AS BIGINT) ELSE COUNT⟦kinds¦k¦k <> '.'⟧ END AS noisy, COUNT⟦raw_kinds¦k¦k = 'p'⟧ AS plain
FROM (SELECT {keep}, t, COUNT⟦words¦w¦w <> ''⟧ AS len_words, MAP⟦words¦w¦CASE WHEN {_mash('w')} THEN 'm' WHEN RLIKE(w, '^\\pL{{3,}}$') THEN 'p' ELSE '' END⟧ AS raw_kinds, MAP⟦bare¦w¦{kind}⟧ AS kinds
  FROM (SELECT {keep}, t, words, MAP⟦words¦w¦BTRIM(w, {fixed.sql(fixed.EDGES)})⟧ AS bare
    FROM (SELECT {keep}, t, split(t, ' ') AS words FROM (SELECT {keep}, lower(trim(regexp_replace(coalesce({text}, ''), '\\s+', ' '@G))) AS t FROM {view}) a) b) c) d"""


OPS["cls_01_noise_tokens"] = f"SELECT doc_id, n_tokens, mash, repeated, mixed, numbers, noisy, plain FROM ({_features('doc_id', 'documents', 'text')}) d WHERE n_tokens > 0"
_SYMBOLS = "(length(raw) - length(regexp_replace(raw, '[\\pL\\pN]', ''@G))) * 2 < length(raw)"
_JUDGED = f"""
SELECT feedback_id, raw, lower(trim(raw)) AS t, trim(raw) = '' AS is_empty, length(raw) AS n_chars, n_tokens, mash, noisy, plain, NOT RLIKE(raw, '\\pL') AS no_letter, {_SYMBOLS} AS symbols FROM ({_features("feedback_id, raw", "(SELECT feedback_id, coalesce(feedback_text, '') AS raw FROM feedback) r", "raw")}) n"""
_SHARED = "no_letter OR symbols OR (n_tokens > 0 AND plain = 0 AND {n} > 20) OR (n_tokens >= 3 AND noisy * 2 >= n_tokens)"
_PROMO = "CASE " + " ".join(f"WHEN RLIKE(t, {fixed.sql(p)}) THEN {i}" for i, p in enumerate(fixed.PROMO)) + " ELSE -1 END"
# two forms of the predicate: one in front of the pattern classifier, one with reasons in front of a model
OPS["cls_02_gibberish"] = f"""
SELECT feedback_id, n_chars < 10 OR t IN ({", ".join(map(fixed.sql, fixed.STOP_REPLIES))}) OR {_SHARED.format(n="n_chars")} OR (n_tokens >= 2 AND mash >= 2 AND mash * 2 >= n_tokens) AS is_gibberish,
  CASE WHEN is_empty THEN 'empty_input' WHEN length(t) < 10 OR {_SHARED.format(n="length(t)")} OR (n_tokens >= 2 AND mash * 2 >= n_tokens) THEN 'gibberish' WHEN {_PROMO} >= 0 THEN concat('promo_spam_', CAST({_PROMO} AS STRING)) ELSE 'ok' END AS reason
FROM ({_JUDGED}) j"""
OPS["cls_03_promo"] = f"SELECT doc_id, {_PROMO} AS pattern FROM (SELECT doc_id, lower(text) AS t FROM documents) d"

_REQUEST, _ISSUE, _ASKS = (fixed.any_of("t", p) for p in (fixed.REQUEST_FRAMES, fixed.ISSUE_FRAMES, fixed.QUESTION_FRAMES))
OPS["cls_04_rare_gate"] = f"""
SELECT feedback_id, CASE WHEN {_REQUEST} THEN 'feature_request' WHEN RLIKE(t, {fixed.sql(fixed.RULE_SIGNAL)}) THEN NULL WHEN RLIKE(t, {fixed.sql(fixed.ISSUE_ARTEFACT)}) AND {_ISSUE} THEN 'issue_report'
  WHEN RLIKE(t, '\\bclarify\\s+whether\\b') OR (RLIKE(t, '[?]$') AND {_ASKS}) THEN 'question' END AS gate
FROM (SELECT feedback_id, lower(trim(feedback_text)) AS t FROM feedback) f"""

_CATEGORY = "CASE " + " ".join(f"WHEN RLIKE(t, {fixed.sql(p)}) THEN '{c}'" for p, c, _ in fixed.CATEGORIES) + " ELSE 'metric_definition' END"
_CONFIDENCE = "CASE " + " ".join(f"WHEN RLIKE(t, {fixed.sql(p)}) THEN CAST({x} AS DOUBLE)" for p, _, x in fixed.CATEGORIES) + " ELSE CAST(0.5 AS DOUBLE) END"
_MATCHED = fixed.any_of("t", [p for p, _, _ in fixed.CATEGORIES])
_QUESTION = f"RLIKE(t, '(^|\\s)({'|'.join(fixed.QUESTION_WORDS)})(\\s|$)') AND instr(t, 'should') = 0 AND instr(t, 'must') = 0"
_PATTERN = f"""
SELECT feedback_id, CASE WHEN {_QUESTION} THEN 'question' ELSE 'business_rule' END AS feedback_type, {_CATEGORY} AS rule_category, {_MATCHED} AND NOT ({_QUESTION}) AS is_actionable,
  CASE WHEN {_QUESTION} THEN CAST(0.3 AS DOUBLE) ELSE {_CONFIDENCE} END AS confidence
FROM (SELECT feedback_id, lower(trim(feedback_text)) AS t FROM feedback) f"""
_FINAL = f"""
SELECT p.feedback_id, CASE WHEN g.is_gibberish THEN 'irrelevant_spam' ELSE p.feedback_type END AS feedback_type, p.rule_category, p.is_actionable AND NOT g.is_gibberish AS is_actionable,
  CASE WHEN g.is_gibberish THEN CAST(0.95 AS DOUBLE) ELSE p.confidence END AS confidence
FROM ({_PATTERN}) p JOIN ({OPS["cls_02_gibberish"]}) g ON g.feedback_id = p.feedback_id"""
OPS["cls_05_patterns"] = _FINAL
OPS["cls_05_type_counts"] = f"SELECT feedback_type, rule_category, is_actionable, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM ({_PATTERN}) p GROUP BY feedback_type, rule_category, is_actionable"
# spam, promotion, gate, model, pattern: each stage answers what the ones before it let through; all of it is one scan of
# feedback beside the model's table
_CASCADE = f"""
SELECT j.*, CASE WHEN {_REQUEST} THEN 'feature_request' WHEN RLIKE(t, {fixed.sql(fixed.RULE_SIGNAL)}) THEN NULL WHEN RLIKE(t, {fixed.sql(fixed.ISSUE_ARTEFACT)}) AND {_ISSUE} THEN 'issue_report' WHEN RLIKE(t, '\\bclarify\\s+whether\\b') OR (RLIKE(t, '[?]$') AND {_ASKS}) THEN 'question' END AS gate,
  CASE WHEN is_empty THEN 'empty_input' WHEN length(t) < 10 OR {_SHARED.format(n="length(t)")} OR (n_tokens >= 2 AND mash * 2 >= n_tokens) THEN 'gibberish' WHEN {_PROMO} >= 0 THEN 'promo_spam' ELSE 'ok' END AS reason,
  CASE WHEN {_QUESTION} THEN 'question' ELSE 'business_rule' END AS pattern_type, {_CATEGORY} AS pattern_category, CASE WHEN {_QUESTION} THEN CAST(0.3 AS DOUBLE) ELSE {_CONFIDENCE} END AS pattern_confidence, {_MATCHED} AND NOT ({_QUESTION}) AS pattern_actionable
FROM ({_JUDGED}) j"""
OPS["cls_06_cascade"] = f"""
SELECT c.feedback_id, CASE WHEN reason <> 'ok' THEN 'irrelevant_spam' WHEN gate IS NOT NULL THEN gate WHEN m.confidence >= 0.6 THEN m.feedback_type ELSE pattern_type END AS feedback_type,
  CASE WHEN reason <> 'ok' THEN 'unknown' WHEN gate IS NOT NULL THEN 'none' WHEN m.confidence >= 0.6 THEN m.rule_category ELSE pattern_category END AS rule_category,
  CASE WHEN reason <> 'ok' OR gate IS NOT NULL THEN FALSE WHEN m.confidence >= 0.6 THEN m.feedback_type = 'business_rule' ELSE pattern_actionable END AS is_actionable,
  CASE WHEN reason <> 'ok' THEN CAST(0.95 AS DOUBLE) WHEN gate IS NOT NULL THEN CAST(0.9 AS DOUBLE) WHEN m.confidence >= 0.6 THEN m.confidence ELSE pattern_confidence END AS confidence,
  CASE WHEN reason <> 'ok' THEN reason WHEN gate IS NOT NULL THEN 'gate' WHEN m.confidence >= 0.6 THEN 'model' WHEN m.confidence IS NOT NULL THEN 'low_confidence_fallback' ELSE 'pattern' END AS provenance
FROM ({_CASCADE}) c LEFT JOIN model_outputs m ON m.feedback_id = c.feedback_id"""
_TERMS = """SELECT domain, table_name AS term FROM catalog UNION SELECT domain, replace(table_name, '_', ' ') FROM catalog UNION SELECT domain, column_name FROM catalog UNION SELECT domain, replace(column_name, '_', ' ') FROM catalog
    UNION SELECT d.domain, x.term FROM (SELECT DISTINCT domain FROM catalog) d CROSS JOIN taxonomy_terms x"""
_KEYWORDS = fixed.values([(d, k) for d, words in fixed.DOMAIN_KEYWORDS.items() for k in words], "domain, term", "k")
view("domain_terms", f"SELECT domain, 'term' AS kind, lower(term) AS term FROM ({_TERMS}) a UNION SELECT domain, 'keyword', term FROM {_KEYWORDS}")
_HELD = f"SELECT feedback_id, domain, count_if(kind = 'term') AS n_terms, count_if(kind = 'keyword') AS n_keywords FROM ({terms.contained('domain_terms', 'domain, kind, term')}) h GROUP BY feedback_id, domain"
# a domain counts if it has terms of its own
OPS["cls_09_domain"] = f"""
SELECT f.feedback_id, CASE WHEN s.score >= 4 THEN s.domain END AS domain, CASE WHEN s.score >= 4 THEN least(1.0, s.score / 30) ELSE CAST(0 AS DOUBLE) END AS confidence, coalesce(s.score, CAST(0 AS DOUBLE)) AS score FROM feedback f LEFT JOIN (
  SELECT feedback_id, domain, score, row_number() OVER (PARTITION BY feedback_id ORDER BY score DESC, domain) AS rn FROM (
    SELECT h.feedback_id, h.domain, CAST(n_terms + CASE WHEN n_terms > 1 THEN 0.5 * n_terms ELSE 0 END + 2 * n_keywords AS DOUBLE) AS score FROM ({_HELD}) h JOIN (SELECT DISTINCT domain FROM catalog) d ON d.domain = h.domain) c) s ON s.feedback_id = f.feedback_id AND s.rn = 1"""
OPS["cls_10_calibrate"] = """
SELECT doc_id, temperature, round(1 / (1 + exp(-ln(p / (1 - p)) / temperature)), 6) AS calibrated FROM (SELECT doc_id, greatest(0.000001, least(0.999999, confidence)) AS p FROM predictions) x
CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (CAST(2.0 AS DOUBLE))) AS t(temperature)"""
# logits of a row by class; the largest is taken off before exp()
OPS["cls_10_softmax"] = """
SELECT doc_id, class, temperature, round(e / sum(e) OVER (PARTITION BY doc_id, temperature), 6) AS probability, round(1 / (1 + exp(-z)), 6) AS sigmoid FROM (
  SELECT l.doc_id, l.class, t.temperature, l.logit / t.temperature AS z, exp(l.logit / t.temperature - max(l.logit / t.temperature) OVER (PARTITION BY l.doc_id, t.temperature)) AS e
  FROM logits l CROSS JOIN (VALUES (CAST(0.5 AS DOUBLE)), (CAST(1.0 AS DOUBLE)), (CAST(2.0 AS DOUBLE))) AS t(temperature)) x"""
_SENSITIVE = "(" + "|".join(fixed.SENSITIVE_TERMS) + ")"
OPS["cls_11_sensitivity"] = f"""
SELECT rule_id, round(least(1.0, s), 6) AS score, s >= 0.5 AS is_sensitive, concat_ws(',', CASE WHEN term > 0 THEN 'term' END, CASE WHEN category > 0 THEN 'category' END, CASE WHEN field > 0 THEN 'field' END) AS reasons
FROM (SELECT rule_id, term, category, field, term + category + field AS s FROM (
  SELECT r.rule_id, CASE WHEN RLIKE(lower(r.business_term), '{_SENSITIVE}') THEN CAST(0.6 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS term, CASE WHEN RLIKE(lower(r.rule_category), '{_SENSITIVE}') THEN CAST(0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS category,
    CASE WHEN coalesce(c.n, 0) > 0 THEN CAST(0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS field
  FROM rules r LEFT JOIN (SELECT rule_id, count_if(RLIKE(lower(field), '{_SENSITIVE}')) AS n FROM conditions GROUP BY rule_id) c ON c.rule_id = r.rule_id) a) b"""
