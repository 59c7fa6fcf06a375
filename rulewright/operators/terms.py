"""Terms of a list inside texts, by an index of the list: no text meets a term that shares nothing with it.

A term that a text holds lies, but for blanks, in the text's words: the first characters of its longest word are a key, and
the substrings of up to as many characters of all distinct words are looked up among the keys. What is found is held to the
whole term. A term of several parts, whose parts may stand anywhere, is found by the part that fewest terms have.
"""

from rulewright.sources.adapters import view

#: Characters of a key at most.
KEY = 12

view("lowered", "SELECT feedback_id, lower(feedback_text) AS t FROM feedback")
view("text_tokens", "SELECT DISTINCT feedback_id, tok FROM UNNEST{lowered|feedback_id|SPLITRE(t, '\\s+')} u WHERE tok <> ''")
view("known_tokens", "SELECT word, CAST(length(word) AS BIGINT) AS n FROM (SELECT DISTINCT tok AS word FROM text_tokens) d")
view("token_starts", f"SELECT word, pos AS start, least({KEY}, n - pos) AS room FROM UNNEST{{known_tokens|word, n|SERIES(n)}} u")
view("token_parts", "SELECT DISTINCT word, substring(word, CAST(start + 1 AS INT), CAST(pos + 1 AS INT)) AS sub FROM UNNEST{token_starts|word, start|SERIES(room)} u")


def contained(terms: str, columns: str) -> str:
    """feedback_id, t (the text in lower case) and the columns of each row of `terms` whose term stands in the text."""
    keys = f"SELECT {columns}, substring(tok, 1, {KEY}) AS key FROM (SELECT u.*, row_number() OVER (PARTITION BY {columns} ORDER BY length(tok) DESC, tok) AS rn FROM UNNEST{{{terms}|{columns}|split(term, ' ')}} u WHERE tok <> '') k WHERE rn = 1"
    named = ", ".join(f"w.{c.strip()}" for c in columns.split(","))
    words = f"SELECT DISTINCT p.word, {', '.join('k.' + c.strip() for c in columns.split(','))} FROM token_parts p JOIN ({keys}) k ON k.key = p.sub"
    return f"SELECT m.feedback_id, l.t, {', '.join('m.' + c.strip() for c in columns.split(','))} FROM (SELECT DISTINCT x.feedback_id, {named} FROM text_tokens x JOIN ({words}) w ON w.word = x.tok) m JOIN lowered l ON l.feedback_id = m.feedback_id WHERE instr(l.t, m.term) > 0"


# ---- terms of a glossary ----
view("glossary_terms", "SELECT DISTINCT domain, term FROM glossary")
view("text_words", "SELECT DISTINCT feedback_id, tok FROM UNNEST{lowered|feedback_id|SPLITRE(t, '[^a-z0-9]+')} u WHERE tok <> ''")
# parts of three letters or more count; a term has two of them at least to be found by them
view("glossary_parts", "SELECT domain, term, part, n_parts, shared FROM (SELECT domain, term, tok AS part, count(*) OVER (PARTITION BY domain, term) AS n_parts, count(*) OVER (PARTITION BY tok) AS shared FROM UNNEST{glossary_terms|domain, term|split(term, '_')} u WHERE length(tok) > 2) p WHERE n_parts > 1")
view("rarest_parts", "SELECT domain, term, word FROM (SELECT domain, term, regexp_extract(part, '([a-z0-9]+)', 1) AS word, row_number() OVER (PARTITION BY domain, term ORDER BY shared, length(part) DESC, part) AS rn FROM glossary_parts WHERE RLIKE(part, '[a-z0-9]')) r WHERE rn = 1")
_STANDS = "concat('(^|[^a-z0-9])\\Q', g.part, '\\Es?([^a-z0-9]|$)')"
_BEFORE = "concat('(?s)^(.*?(?:^|[^a-z0-9]))\\Q', g.part, '\\Es?(?:[^a-z0-9]|$)')"
_SCATTERED = f"""
SELECT c.feedback_id, c.domain, c.term, min(length(regexp_extract(l.t, {_BEFORE}, 1))) AS place, count(*) AS quality FROM (
  SELECT DISTINCT x.feedback_id, r.domain, r.term FROM text_words x JOIN (SELECT domain, term, word FROM rarest_parts UNION SELECT domain, term, concat(word, 's') FROM rarest_parts) r ON r.word = x.tok) c
JOIN lowered l ON l.feedback_id = c.feedback_id JOIN glossary_parts g ON g.domain = c.domain AND g.term = c.term WHERE RLIKE(l.t, {_STANDS}) GROUP BY c.feedback_id, c.domain, c.term, g.n_parts HAVING count(*) = g.n_parts"""
_EXACT = f"SELECT feedback_id, domain, term, instr(t, term) - 1 AS place, length(term) - length(replace(term, '_', '')) + 1 AS quality FROM ({contained('glossary_terms', 'domain, term')}) e"
# an exact match counts before the parts' match; more parts first, then what stands later
GLOSSARY_MATCH = f"""
SELECT m.feedback_id, m.domain, m.term, m.is_exact OR instr(l.t, replace(m.term, '_', ' ')) > 0 AS matched_exactly, CAST(m.quality AS INT) AS quality, CAST(m.place AS INT) AS place, CAST(row_number() OVER (PARTITION BY m.feedback_id ORDER BY m.quality DESC, m.place DESC, m.domain, m.term) AS INT) AS rn FROM (
  SELECT feedback_id, domain, term, max(is_exact) = 1 AS is_exact, coalesce(max(CASE WHEN is_exact = 1 THEN quality END), max(quality)) AS quality, coalesce(max(CASE WHEN is_exact = 1 THEN place END), max(place)) AS place FROM (
    SELECT feedback_id, domain, term, 1 AS is_exact, place, quality FROM ({_EXACT}) a UNION ALL SELECT feedback_id, domain, term, 0, place, quality FROM ({_SCATTERED}) b) u GROUP BY feedback_id, domain, term) m JOIN lowered l ON l.feedback_id = m.feedback_id"""

# ---- keywords ----
view("vocabulary_terms", "SELECT term FROM glossary UNION SELECT table_name FROM catalog UNION SELECT column_name FROM catalog")
# a word counts as it is, else as the singular that its ending allows, in this order
_FORMS = """
SELECT tok, 0 AS kind, tok AS form FROM known_words UNION ALL SELECT tok, 1, concat(substring(tok, 1, length(tok) - 3), 'y') FROM known_words WHERE tok LIKE '%ies' AND length(tok) > 3
UNION ALL SELECT tok, 2, substring(tok, 1, length(tok) - 2) FROM known_words WHERE tok LIKE '%es' AND length(tok) > 2 UNION ALL SELECT tok, 3, substring(tok, 1, length(tok) - 1) FROM known_words WHERE tok LIKE '%s' AND NOT tok LIKE '%ss' AND length(tok) > 1"""
view("known_words", "SELECT DISTINCT tok FROM text_tokens")
KEYWORDS = f"""
SELECT t.feedback_id, AGG{{w.term| |pos}} AS keywords, count(*) AS n_keywords FROM (SELECT feedback_id, pos, tok FROM UNNEST{{lowered|feedback_id|SPLITRE(t, '\\s+')}} u) t
JOIN (SELECT tok, form AS term FROM (SELECT f.tok, f.form, row_number() OVER (PARTITION BY f.tok ORDER BY f.kind) AS rn FROM ({_FORMS}) f JOIN vocabulary_terms v ON v.term = f.form) x WHERE rn = 1) w ON w.tok = t.tok GROUP BY t.feedback_id"""
