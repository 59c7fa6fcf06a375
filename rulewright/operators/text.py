"""Text normalisation and privacy."""

from rulewright.sources.adapters import view

from . import fixed, terms

OPS: dict[str, str] = {}

# NFKC is left to functions.text.normalise_unicode, ASCII rows need none. Cutting into sentences and tokens and joining
# them again changes nothing once blanks are single, so these steps only count.
_BLANKS = r"trim(regexp_replace(feedback_text, '\s+', ' '@G))"
NORMAL = f"regexp_replace({_BLANKS}, {fixed.sql(fixed.PUNCTUATION)}, ' '@G)"
OPS["txt_01_normalise"] = f"SELECT feedback_id, {NORMAL} AS processed_text FROM feedback"

_SENTENCES = f"CAST(length({_BLANKS}) - length(regexp_replace({_BLANKS}, '[.!?] ', '.'@G)) + 1 AS STRING)"
_STEPS = [
    ("unicode_normalization", "feedback_text", "feedback_text", "concat('Normalized ', CAST(length(feedback_text) AS STRING), ' chars to ', CAST(length(feedback_text) AS STRING), ' chars')"),
    ("whitespace_normalization", "feedback_text", _BLANKS, "'Collapsed whitespace, trimmed edges'"),
    ("sentence_segmentation", _BLANKS, _BLANKS, f"concat('Segmented into ', {_SENTENCES}, ' sentences')"),
    ("tokenization", _BLANKS, _BLANKS, f"concat('Tokenized into ', CAST(CASE WHEN {_BLANKS} = '' THEN 0 ELSE length({_BLANKS}) - length(replace({_BLANKS}, ' ', '')) + 1 END AS STRING), ' tokens')"),
    ("punctuation_removal", _BLANKS, NORMAL, "'Removed non-critical punctuation'"),
]
def _fixed(column: str, pairs: list[tuple[str, str]]) -> str:
    for wrong, right in pairs:
        column = f"replace({column}, '{wrong}', '{right}')"
    return column


# a correction is listed if its misspelling is there when its turn comes
_CHANGES = ", ".join(f"CASE WHEN instr({_fixed('feedback_text', fixed.MISSPELLINGS[:i])}, '{a}') > 0 THEN '{a}->{b}' END" for i, (a, b) in enumerate(fixed.MISSPELLINGS))
OPS["txt_03_spelling"] = f"""
SELECT feedback_id, {_fixed("corrected", fixed.SHORTHAND)} AS corrected, changes, RLIKE(corrected, 'pls|thx') AS has_shorthand
FROM (SELECT feedback_id, {_fixed("feedback_text", fixed.MISSPELLINGS)} AS corrected, concat_ws(',', {_CHANGES}) AS changes FROM feedback) f"""

_SAID = ", ".join(f"CASE WHEN instr({_fixed('normal', fixed.MISSPELLINGS[:i])}, '{a}') > 0 THEN '{a}->{b}' END" for i, (a, b) in enumerate(fixed.MISSPELLINGS))
_SHORT = ", ".join(f"CASE WHEN instr(spelled, '{a}') > 0 THEN '{a}->{b}' END" for a, b in fixed.SHORTHAND)
view("processed", f"SELECT feedback_id, normal, spelled, {_fixed('spelled', fixed.SHORTHAND)} AS processed_text, coalesce(nullif(concat_ws(', ', {_SAID}), ''), 'No corrections needed') AS spelling, coalesce(nullif(concat_ws(', ', {_SHORT}), ''), 'No normalization needed') AS language FROM (SELECT feedback_id, normal, {_fixed('normal', fixed.MISSPELLINGS)} AS spelled FROM (SELECT feedback_id, {NORMAL} AS normal FROM feedback) a) b")
OPS["txt_01_processed"] = "SELECT feedback_id, processed_text, language <> 'No normalization needed' AS language_normalized FROM processed"
# steps that look for words without changing the text have no entry
OPS["txt_02_step_log"] = " UNION ALL ".join([*(f"SELECT feedback_id, {i} AS pos, '{step}' AS step, {before} AS input, {after} AS output, {changes} AS changes FROM feedback" for i, (step, before, after, changes) in enumerate(_STEPS)), "SELECT feedback_id, 5, 'spelling_correction', normal, spelled, spelling FROM processed", "SELECT feedback_id, 8, 'language_normalization', spelled, processed_text, language FROM processed"])

OPS["txt_05_keywords"] = terms.KEYWORDS

# fixed values: what refers to a schema: dotted names, quoted ones, what follows a keyword of SQL, and words for its parts
_NAME = r"(?:\w+[.]\w+|\"[^\"]+\"|`[^`]+`)"
_REFERENCES = [("dotted", "feedback_text", r"\b\w+[.]\w+\b"), ("quoted", "feedback_text", r"\"[^\"]+\"|`[^`]+`"), ("keyword", "feedback_text", rf"(?i)\b(?:select|where|from|group\s+by|order\s+by)\s+{_NAME}"), ("noun", "lower(feedback_text)", r"\b(?:table|column|field|attribute|join|relationship|foreign\s+key)\b")]
OPS["txt_06_schema_references"] = " UNION ALL ".join(f"SELECT feedback_id, '{kind}' AS kind, pos AS place, {chr(39).join(('regexp_replace(tok, ', '^[\"`]|[\"`]$', ', ', '', '@G)')) if kind == 'quoted' else 'tok'} AS reference FROM UNNEST{{feedback|feedback_id|regexp_extract_all({text}, {fixed.sql(pattern)}, 0)}} u{i}" for i, (kind, text, pattern) in enumerate(_REFERENCES))


def masked(column: str) -> str:
    for pattern, marker in fixed.MASKS:
        column = f"regexp_replace({column}, {fixed.sql(pattern)}, '{marker}'@G)"
    return column


OPS["txt_07_mask"] = f"SELECT doc_id, {masked('text')} AS masked, length(text) > {fixed.LOG_LENGTH} AS is_long FROM documents"
OPS["txt_07_log_text"] = f"SELECT feedback_id, {masked('cut')} AS log_text FROM (SELECT feedback_id, CASE WHEN feedback_text IS NULL THEN 'None' WHEN length(feedback_text) > {fixed.LOG_LENGTH} THEN concat(substring(feedback_text, 1, {fixed.LOG_LENGTH}), '...[TRUNCATED]') ELSE feedback_text END AS cut FROM feedback) f"
# a record as paths to its values; a sensitive word in any key of the path hides all below it
OPS["txt_08_redact_keys"] = f"""
SELECT feedback_id, path, CASE WHEN {fixed.any_of("lower(path)", fixed.SENSITIVE_KEYS)} THEN '[REDACTED]' WHEN is_text THEN {masked('value')} ELSE value END AS shown FROM record_values"""
OPS["txt_09_bounds"] = "SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) > 10000 THEN 'too_long' ELSE 'ok' END AS verdict, CAST(length(text) AS BIGINT) AS n FROM documents"
# a rule without an operation and a term is named by the end of its id
OPS["txt_10_names"] = f"""
SELECT rule_id, term_label, CASE WHEN lower(concat(operation_label, ' ', term_label)) = 'rule general' THEN concat('Rule ', substring(rule_id, greatest(length(rule_id) - 7, 1), 8)) ELSE concat(operation_label, ' ', term_label) END AS rule_name FROM (
  SELECT rule_id, CASE WHEN operation = '' OR lower(operation) = 'unknown' THEN 'Rule' ELSE {fixed.title('operation')} END AS operation_label, CASE WHEN term = '' OR lower(term) = 'unknown' THEN 'General' ELSE {fixed.title('term')} END AS term_label
  FROM (SELECT rule_id, trim(coalesce(operation, '')) AS operation, trim(coalesce(business_term, '')) AS term FROM rules) r) x"""
