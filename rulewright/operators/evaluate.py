"""Evaluation, calibration and model comparison."""

from rulewright.sources.adapters import view

from .datagen import OPS as DATASETS
from .route import OPS as ROUTES
from .similarity import ALL_CONFLICTS, ALL_RELATIONSHIPS
from .validate import OPS as CHECKS

OPS: dict[str, str] = {}

_CONFUSION = "SELECT expected_lang, predicted_lang, count(*) AS n FROM predictions GROUP BY expected_lang, predicted_lang"
OPS["evl_01_confusion"] = _CONFUSION


def _per_label(confusion: str, truth: str, guess: str) -> str:
    """Support, guesses and hits of each label, all from the confusion counts."""
    return f"""
SELECT label, sum(support) AS support, sum(guessed) AS guessed, sum(hit) AS hit FROM (
  SELECT {truth} AS label, n AS support, 0 AS guessed, CASE WHEN {truth} = {guess} THEN n ELSE 0 END AS hit FROM ({confusion}) a UNION ALL SELECT {guess}, 0, n, 0 FROM ({confusion}) b) x GROUP BY label"""


def _prf(counts: str) -> str:
    return f"SELECT label, CAST(support AS BIGINT) AS support, CAST(hit AS BIGINT) AS hit, CASE WHEN guessed = 0 THEN 0 ELSE hit / CAST(guessed AS DOUBLE) END AS p, CASE WHEN support = 0 THEN 0 ELSE hit / CAST(support AS DOUBLE) END AS r, CASE WHEN support + guessed = 0 THEN 0 ELSE 2 * hit / CAST(support + guessed AS DOUBLE) END AS f FROM ({counts}) x"


_PRF = _prf(_per_label(_CONFUSION, "expected_lang", "predicted_lang"))
OPS["evl_01_per_class"] = f"SELECT label, support, round(p, 6) AS precision_, round(r, 6) AS recall, round(f, 6) AS f1 FROM ({_PRF}) m"
OPS["evl_01_averages"] = f"SELECT round(avg(f), 6) AS macro_f1, round(sum(f * support) / sum(support), 6) AS weighted_f1, round(avg(p), 6) AS macro_precision, round(sum(r * support) / sum(support), 6) AS accuracy FROM ({_PRF}) m"
_BINARY = "count_if(expected = 1 AND predicted = 1) AS tp, count_if(expected = 0 AND predicted = 1) AS fp, count_if(expected = 1 AND predicted = 0) AS fn, count_if(expected = 0 AND predicted = 0) AS tn"
_RATES = "tp, fp, fn, tn, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / CAST(tp + fp AS DOUBLE) END, 6) AS precision_, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / CAST(tp + fn AS DOUBLE) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) END, 6) AS f1"
OPS["evl_02_binary"] = f"SELECT {_RATES} FROM (SELECT {_BINARY} FROM predictions) b"
OPS["evl_02_by_model"] = f"SELECT model, {_RATES} FROM (SELECT model, {_BINARY} FROM predictions GROUP BY model) b"
# tags of tokens, true and guessed; a guess misses some entities and takes some plain tokens for one
view("tags", f"""
SELECT feedback_id, pos, label AS truth, CASE WHEN substring(md5(concat(CAST(feedback_id AS STRING), '/', CAST(pos AS STRING))), 1, 1) = '0' THEN CASE WHEN label = 'O' THEN 'B-TERM' ELSE 'O' END ELSE label END AS guess FROM ({DATASETS["gen_18_token_labels"]}) t""")
_TAGS = _prf(_per_label("SELECT truth, guess, count(*) AS n FROM tags GROUP BY truth, guess", "truth", "guess"))
OPS["evl_03_tokens"] = f"SELECT label, support, hit, round(p, 6) AS precision_, round(r, 6) AS recall, round(f, 6) AS f1 FROM ({_TAGS}) m"
OPS["evl_03_summary"] = f"""
SELECT round(m.macro_f1, 6) AS macro_f1, round(m.accuracy, 6) AS token_accuracy, round(e.exact, 6) AS exact_match FROM (SELECT avg(CASE WHEN label <> 'O' THEN f END) AS macro_f1, CAST(sum(hit) AS DOUBLE) / sum(support) AS accuracy FROM ({_TAGS}) t) m
CROSS JOIN (SELECT avg(CASE WHEN whole THEN 1e0 ELSE 0e0 END) AS exact FROM (SELECT feedback_id, bool_and(truth = guess) AS whole FROM tags GROUP BY feedback_id) s) e"""
_BINS = "SELECT CAST(least(floor(confidence * 10), 9) AS INT) AS bin, count(*) AS n, avg(confidence) AS conf, avg(CASE WHEN expected = predicted THEN 1e0 ELSE 0e0 END) AS acc FROM predictions GROUP BY CAST(least(floor(confidence * 10), 9) AS INT)"
OPS["evl_04_reliability"] = f"SELECT bin, n, round(conf, 6) AS mean_confidence, round(acc, 6) AS accuracy FROM ({_BINS}) b"
OPS["evl_04_ece"] = f"SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM ({_BINS}) b"
# negative log-likelihood over temperatures of [0.01, 10], a grid first and a finer one about its best, for each head
_HEADS = """SELECT 'quality' AS head, ln(greatest(0.000001, least(0.999999, confidence)) / (1 - greatest(0.000001, least(0.999999, confidence)))) AS z, expected = predicted AS correct FROM predictions
  UNION ALL SELECT 'language', ln(greatest(0.000001, least(0.999999, confidence)) / (1 - greatest(0.000001, least(0.999999, confidence)))), expected_lang = predicted_lang FROM predictions"""
_GRID = ", ".join(f"(CAST({t} AS DOUBLE))" for t in (0.01, 0.02, 0.035, 0.06, 0.1, 0.2, 0.35, 0.5, 0.75, 1, 1.5, 2, 3, 5, 7.5, 10))
_FINER = ", ".join(f"(CAST({100 + 5 * k} AS DOUBLE) / 100)" for k in range(-9, 17))
# softplus, without overflow for large logits
_NLL = "avg(greatest(CASE WHEN correct THEN -z ELSE z END / t, CAST(0 AS DOUBLE)) + ln(1 + exp(-abs(z / t))))"
_BEST = "SELECT head, t, nll FROM (SELECT head, t, nll, row_number() OVER (PARTITION BY head ORDER BY nll, t) AS rn FROM ({0}) x) y WHERE rn = 1"
_COARSE = _BEST.format(f"SELECT head, t, round({_NLL}, 9) AS nll FROM ({_HEADS}) p CROSS JOIN (VALUES {_GRID}) AS g(t) GROUP BY head, t")
_FINE = _BEST.format(f"SELECT head, t, round({_NLL}, 9) AS nll FROM (SELECT p.head, p.z, p.correct, least(CAST(10 AS DOUBLE), greatest(CAST(0.01 AS DOUBLE), c.t * g.f)) AS t FROM ({_HEADS}) p JOIN ({_COARSE}) c ON c.head = p.head CROSS JOIN (VALUES {_FINER}) AS g(f)) q GROUP BY head, t")
OPS["evl_05_temperature"] = f"SELECT head, round(t, 6) AS t, round(nll, 6) AS nll FROM ({_FINE}) b"
_TEXTS = "(SELECT rule_id, AGG{concat(field, ' ', operator, ' ', value)|;|pos} AS conditions_text FROM {table} GROUP BY rule_id)"
_ALIGNED = f"""
SELECT n.rule_id, n.business_term AS p1, r.business_term AS t1, n.operation AS p2, r.operation AS t2, a.conditions_text AS p3, b.conditions_text AS t3, n.scope AS p4, r.scope AS t4, n.time_window AS p5, r.time_window AS t5, CAST(n.threshold AS STRING) AS p6, CAST(r.threshold AS STRING) AS t6,
  concat(n.entity_tables, '/', n.entity_columns) AS p7, concat(r.entity_tables, '/', r.entity_columns) AS t7
FROM new_rules n JOIN rules r ON r.rule_no = n.rule_no LEFT JOIN {_TEXTS.replace("{table}", "new_conditions")} a ON a.rule_id = n.rule_id LEFT JOIN {_TEXTS.replace("{table}", "conditions")} b ON b.rule_id = r.rule_id"""
_SEVEN = list(enumerate(("business_term", "operation", "conditions", "scope", "time_window", "threshold", "affected_entities"), 1))
_same = lambda i: f"coalesce(p{i}, '') = coalesce(t{i}, '')"
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS n, count_if({_same(i)}) AS same, count_if({_same(i)} AND coalesce(t{i}, '') <> '') AS hit, count_if(coalesce(p{i}, '') <> '') AS guessed, count_if(coalesce(t{i}, '') <> '') AS support FROM ({_ALIGNED}) a" for i, f in _SEVEN)
OPS["evl_06_fields"] = f"""
SELECT field, round(same / CAST(greatest(n, 1) AS DOUBLE), 6) AS accuracy, round(hit / CAST(greatest(guessed, 1) AS DOUBLE), 6) AS precision_, round(hit / CAST(greatest(support, 1) AS DOUBLE), 6) AS recall, round(2 * hit / CAST(greatest(guessed + support, 1) AS DOUBLE), 6) AS f1 FROM ({_LONG}) x"""
OPS["evl_06_summary"] = f"""
SELECT round(e.exact, 6) AS exact_match, round(v.passed, 6) AS validation_pass_rate FROM (SELECT avg(CASE WHEN {" AND ".join(_same(i) for i, _ in _SEVEN)} THEN 1e0 ELSE 0e0 END) AS exact FROM ({_ALIGNED}) a) e CROSS JOIN (SELECT avg(CASE WHEN status = 'PASS' THEN 1e0 ELSE 0e0 END) AS passed FROM ({CHECKS["val_01_schema"]}) c) v"""
# judgements of rule pairs: what a pair is (kind), whether it is a duplicate, what was said, and the rank of the old rule
# among the candidates of the new one
KIND = "CASE WHEN o.rule_no <> n.rule_no THEN 'other' WHEN n.rule_no % 100 = 20 THEN 'operation_changed' WHEN n.rule_no % 100 = 40 THEN 'condition_dropped' WHEN n.rule_no % 100 = 60 THEN 'value_changed' WHEN n.rule_no % 100 = 80 THEN 'scope_changed' ELSE 'exact' END"
SAME_EXPECTED = "CASE WHEN o.rule_no = n.rule_no AND n.operation = o.operation THEN 1 ELSE 0 END"
SCORE = "CASE WHEN n.operation = o.operation THEN 2 ELSE 0 END + CASE WHEN n.scope = o.scope THEN 1 ELSE 0 END + CASE WHEN n.affected_column = o.affected_column THEN 1 ELSE 0 END"
SAME_FACTS = "CASE WHEN n.operation = o.operation AND n.scope = o.scope AND n.affected_column = o.affected_column THEN 1 ELSE 0 END"
_SCORED_PAIRS = f"""
  SELECT n.rule_id AS new_id, o.rule_id AS old_id, o.rule_no AS old_no, {KIND} AS kind,
    {SAME_EXPECTED} AS expected, {SAME_FACTS} AS predicted,
    {SCORE} AS score
  FROM new_rules n JOIN rules o ON o.workspace_id = n.workspace_id AND o.domain_id = n.domain_id AND o.business_term = n.business_term"""
view("duplicate_judgements", f"""
SELECT new_id, old_id, kind, expected, predicted, CAST(row_number() OVER (PARTITION BY new_id ORDER BY score DESC, old_no) AS INT) AS place FROM (
{_SCORED_PAIRS}) p""")
_DUPLICATES = f"{_BINARY}, count_if(expected = 1 AND place <= 10) AS top_hits, count(*) AS n_pairs"
_RATED = f"{{0}}, {_RATES}, round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp / CAST(fp + tn AS DOUBLE) END, 6) AS fpr, round(CASE WHEN tp + fn = 0 THEN 0 ELSE fn / CAST(tp + fn AS DOUBLE) END, 6) AS fnr, round(top_hits / CAST(greatest(tp + fn, 1) AS DOUBLE), 6) AS recall_at_10, n_pairs"
OPS["evl_07_duplicates"] = f"SELECT {_RATED.format('kind')} FROM (SELECT kind, {_DUPLICATES} FROM duplicate_judgements GROUP BY kind UNION ALL SELECT 'all', {_DUPLICATES} FROM duplicate_judgements) b"
# rules of one term with the same operation and scope are one class: pairs of their first rules, also of a class with itself if
# it has more than one; evl_08_classes says which rules each stands for
_LABELLED = "SELECT workspace_id, domain_id, business_term, operation, scope, min(rule_id) AS rule_id, count(*) AS n FROM rules GROUP BY workspace_id, domain_id, business_term, operation, scope"
OPS["evl_08_classes"] = "SELECT rule_id, min(rule_id) OVER (PARTITION BY workspace_id, domain_id, business_term, operation, scope) AS first_id FROM rules"
OPS["evl_08_pair_labels"] = f"""
SELECT a.rule_id AS id_1, b.rule_id AS id_2, a.n AS n_1, b.n AS n_2, a.operation = b.operation AS truth, a.operation = b.operation AND a.scope = b.scope AS strict, (CASE WHEN a.operation = b.operation THEN 1e0 ELSE 0e0 END + CASE WHEN a.scope = b.scope THEN 1e0 ELSE 0e0 END) / 2 > 0.4 AS lenient
FROM ({_LABELLED}) a JOIN ({_LABELLED}) b ON b.workspace_id = a.workspace_id AND b.domain_id = a.domain_id AND b.business_term = a.business_term AND (b.rule_id <> a.rule_id OR a.n > 1)"""
# judgements of conflicts; the category is what two rules of one term disagree in
CATEGORY = "CASE WHEN n.operation <> o.operation THEN 'operation' WHEN n.scope <> o.scope THEN 'scope' WHEN n.affected_column <> o.affected_column THEN 'condition' WHEN n.threshold <> o.threshold THEN 'threshold' ELSE 'none' END"
CONFLICT_EXPECTED = "CASE WHEN (n.operation = 'exclude' AND o.operation = 'include') OR (n.operation = 'include' AND o.operation = 'exclude') OR (n.affected_column = o.affected_column AND n.threshold <> o.threshold AND n.operation = o.operation) THEN 1 ELSE 0 END"
view("conflict_judgements", f"""
SELECT n.rule_id AS new_id, o.rule_id AS old_id, {CATEGORY} AS category,
  {CONFLICT_EXPECTED} AS expected,
  CASE WHEN n.affected_column = o.affected_column AND (n.operation <> o.operation OR n.threshold <> o.threshold) AND n.scope = o.scope THEN 1 ELSE 0 END AS predicted
FROM new_rules n JOIN rules o ON o.workspace_id = n.workspace_id AND o.domain_id = n.domain_id AND o.business_term = n.business_term""")
OPS["evl_09_conflicts"] = f"""
SELECT category, {_RATES}, round(fn / CAST(greatest(tp + fn, 1) AS DOUBLE), 6) AS missed_rate, round(fp / CAST(greatest(fp + tn, 1) AS DOUBLE), 6) AS false_rate
FROM (SELECT category, {_BINARY} FROM conflict_judgements GROUP BY category UNION ALL SELECT 'all', {_BINARY} FROM conflict_judgements) b"""
# the same measures of what the detectors of SIM-08 and SIM-13 say of the judged pairs
_SAID_PAIR = f"SELECT j.new_id, j.old_id, j.category, j.expected, CASE WHEN d.kind IN ('direct', 'potential') THEN 1 ELSE 0 END AS predicted FROM conflict_judgements j LEFT JOIN ({ALL_CONFLICTS}) d ON d.new_id = j.new_id AND d.old_id = j.old_id"
_BY_CATEGORY = f"""
SELECT category, {_RATES}, round(fn / CAST(greatest(tp + fn, 1) AS DOUBLE), 6) AS missed_rate, round(fp / CAST(greatest(fp + tn, 1) AS DOUBLE), 6) AS false_rate
FROM (SELECT category, {_BINARY} FROM ({_SAID_PAIR}) j GROUP BY category) b"""
OPS["evl_09_detected"] = _BY_CATEGORY
_SAID_SAME = f"SELECT j.new_id, j.old_id, j.kind, j.expected, CASE WHEN coalesce(d.relationship, 'unrelated') <> 'unrelated' THEN 1 ELSE 0 END AS predicted, j.place FROM duplicate_judgements j LEFT JOIN ({ALL_RELATIONSHIPS}) d ON d.new_id = j.new_id AND d.old_id = j.old_id"
OPS["evl_07_detected"] = f"SELECT {_RATED.format('kind')} FROM (SELECT kind, {_DUPLICATES} FROM ({_SAID_SAME}) j GROUP BY kind) b"
# the same of counted judgements (n alike in all columns), which judged makes of classes
_n = lambda test: f"CAST(sum(CASE WHEN {test} THEN n ELSE 0 END) AS BIGINT)"
_SUMMED = f"{_n('expected = 1 AND predicted = 1')} AS tp, {_n('expected = 0 AND predicted = 1')} AS fp, {_n('expected = 1 AND predicted = 0')} AS fn, {_n('expected = 0 AND predicted = 0')} AS tn"
COUNTED_CONFLICTS = _BY_CATEGORY.replace(f"{_BINARY} FROM ({_SAID_PAIR}) j", f"{_SUMMED} FROM counted")
SAID_SAME_SCORED = f"SELECT j.new_id, j.old_no, j.kind, j.expected, CASE WHEN coalesce(d.relationship, 'unrelated') <> 'unrelated' THEN 1 ELSE 0 END AS predicted, j.score FROM ({_SCORED_PAIRS}) j LEFT JOIN ({ALL_RELATIONSHIPS}) d ON d.new_id = j.new_id AND d.old_id = j.old_id"
COUNTED_DUPLICATES = f"SELECT {_RATED.format('kind')} FROM (SELECT kind, {_SUMMED}, {_n('expected = 1 AND in_top')} AS top_hits, CAST(sum(n) AS BIGINT) AS n_pairs FROM counted GROUP BY kind) b"
_FOUND = f"{_SUMMED}, {_n('expected = 1 AND in_top')} AS top_hits, coalesce(CAST(sum(n) AS BIGINT), 0) AS n_pairs".replace("CAST(sum(CASE", "coalesce(CAST(sum(CASE").replace("END) AS BIGINT)", "END) AS BIGINT), 0)")
COUNTED_FACTS = f"SELECT {_RATED.format('kind')} FROM (SELECT kind, {_FOUND} FROM counted GROUP BY kind UNION ALL SELECT 'all', {_FOUND} FROM counted) b".replace("(tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE)", "(tp + tn) / nullif(CAST(tp + fp + fn + tn AS DOUBLE), 0)")
OPS["evl_10_clarifications"] = f"SELECT {_RATES}, fn AS missed, fp AS incorrect FROM (SELECT count_if(needs AND asked) AS tp, count_if(NOT needs AND asked) AS fp, count_if(needs AND NOT asked) AS fn, count_if(NOT needs AND NOT asked) AS tn FROM (SELECT needs_clarification AS needs, business_term IS NULL OR n_conditions = 0 AS asked FROM suggestions) s) b"
view("clarification_times", "SELECT s.suggestion_id, s.workspace_id, s.created_at, max(a.created_at) AS resolved_at FROM suggestions s JOIN audit a ON a.entity_id = s.suggestion_id WHERE s.needs_clarification GROUP BY s.suggestion_id, s.workspace_id, s.created_at")
OPS["evl_10_resolution"] = "SELECT workspace_id, count(*) AS n, round(avg(CAST(SECONDS(resolved_at) - SECONDS(created_at) AS DOUBLE)), 6) AS mean_seconds, max(SECONDS(resolved_at) - SECONDS(created_at)) AS longest_seconds FROM clarification_times WHERE resolved_at >= created_at GROUP BY workspace_id"
_METRICS = "SELECT model, 'accuracy' AS name, round(avg(CASE WHEN expected = predicted THEN 1e0 ELSE 0e0 END), 6) AS value FROM predictions GROUP BY model UNION ALL SELECT model, 'confidence', round(avg(confidence), 6) FROM predictions GROUP BY model UNION ALL SELECT model, 'has_toxic', max(CASE WHEN expected_toxic = 1 THEN 1e0 ELSE 0e0 END) FROM predictions GROUP BY model"
# the eight measures of a run, from one aggregation, in long form
_EN, _DE = ("count_if(expected_lang = '{0}' AND predicted_lang = '{0}')".format(x) for x in ("en", "de"))
_MEASURES = {
    "classification_accuracy": "avg(CASE WHEN expected = predicted THEN 1e0 ELSE 0e0 END)", "extraction_f1": "2e0 * count_if(expected = 1 AND predicted = 1) / greatest(count_if(expected = 1) + count_if(predicted = 1), 1)",
    "duplicate_precision": f"{_EN} / CAST(greatest(count_if(predicted_lang = 'en'), 1) AS DOUBLE)", "duplicate_recall": f"{_EN} / CAST(greatest(count_if(expected_lang = 'en'), 1) AS DOUBLE)",
    "conflict_precision": f"{_DE} / CAST(greatest(count_if(predicted_lang = 'de'), 1) AS DOUBLE)", "conflict_recall": f"{_DE} / CAST(greatest(count_if(expected_lang = 'de'), 1) AS DOUBLE)",
    "missed_conflict_rate": f"1 - {_DE} / CAST(greatest(count_if(expected_lang = 'de'), 1) AS DOUBLE)", "response_time": "3 * avg(confidence)",
}
view("run_metrics", f"""
SELECT g.run, n.name, round(CAST(CASE n.name {" ".join(f"WHEN '{m}' THEN g.{m}" for m in _MEASURES)} END AS DOUBLE), 6) AS value FROM (SELECT model AS run, {", ".join(f"{test} AS {m}" for m, test in _MEASURES.items())} FROM predictions GROUP BY model) g
CROSS JOIN (VALUES {", ".join(f"('{m}')" for m in _MEASURES)}) AS n(name)""")
# fixed values: targets, and whether more is better
_TARGETS = [("classification_accuracy", 0.85, True), ("extraction_f1", 0.80, True), ("duplicate_precision", 0.90, True), ("duplicate_recall", 0.90, True), ("conflict_precision", 0.85, True), ("conflict_recall", 0.85, True), ("missed_conflict_rate", 0.05, False), ("response_time", 2.0, False)]
_GOALS = "(VALUES " + ", ".join(f"('{n}', CAST({t} AS DOUBLE), {more})" for n, t, more in _TARGETS) + ") AS t(name, target, more)"
_PASSES = "CASE WHEN t.more THEN m.value >= t.target WHEN t.name = 'response_time' THEN m.value < t.target ELSE m.value <= t.target END"
OPS["evl_11_criteria"] = f"SELECT m.run, m.name, m.value, t.target, {_PASSES} AS passed FROM run_metrics m JOIN {_GOALS} ON t.name = m.name"
OPS["evl_11_gate"] = f"SELECT run, count_if(passed) AS n_passed, count(*) AS n_criteria, bool_and(passed) AND count(*) = {len(_TARGETS)} AS accepted FROM ({OPS['evl_11_criteria']}) c GROUP BY run"
_COMPARED = f"""
SELECT a.run AS base, b.run AS candidate, a.name, a.value AS base_value, b.value AS candidate_value, round(b.value - a.value, 6) AS delta, CASE WHEN b.value = a.value THEN 'same' WHEN (b.value > a.value) = t.more THEN 'improved' ELSE 'regressed' END AS verdict
FROM run_metrics a JOIN run_metrics b ON b.name = a.name AND b.run <> a.run JOIN {_GOALS} ON t.name = a.name"""
OPS["evl_12_compare"] = _COMPARED
OPS["evl_12_promotion"] = f"""
SELECT base, candidate, n_improved, n_regressed, accuracy >= 0.85 AND gain >= 0 AS promote, concat_ws('; ', CASE WHEN accuracy < 0.85 THEN 'accuracy below target' ELSE 'accuracy on target' END, CASE WHEN gain > 0 THEN 'candidate better' WHEN gain < 0 THEN 'candidate worse' ELSE 'candidate equal' END) AS reasons
FROM (SELECT base, candidate, count_if(verdict = 'improved') AS n_improved, count_if(verdict = 'regressed') AS n_regressed, max(CASE WHEN name = 'classification_accuracy' THEN candidate_value END) AS accuracy, max(CASE WHEN name = 'classification_accuracy' THEN delta END) AS gain FROM ({_COMPARED}) c GROUP BY base, candidate) x"""
OPS["evl_13_rank"] = f"SELECT model, value AS accuracy, CAST(rank() OVER (ORDER BY value DESC) AS INT) AS place FROM ({_METRICS}) m WHERE name = 'accuracy'"
OPS["evl_14_unpivot"] = _METRICS
OPS["evl_15_lineage"] = "SELECT v.version_id, p.version_id AS parent, g.version_id AS grandparent, c.n AS children FROM versions v LEFT JOIN versions p ON p.version_id = v.parent_id LEFT JOIN versions g ON g.version_id = p.parent_id LEFT JOIN (SELECT parent_id, count(*) AS n FROM versions GROUP BY parent_id) c ON c.parent_id = v.version_id"
OPS["evl_16_run_summary"] = "SELECT bucket AS engine, count(*) AS n, count_if(duration > 1) AS slow, round(avg(CASE WHEN duration <= 3 THEN duration END), 6) AS mean_latency, count_if(duration > 3) AS errors FROM request_log GROUP BY bucket"
# what a run's suggestions came to: validation, routing, duplicates, conflicts and clarifications
_ROUTED = f"SELECT s.workspace_id, r.review_status FROM ({ROUTES['rte_03_route']}) r JOIN suggestions s ON s.suggestion_id = r.suggestion_id"
OPS["evl_16_counts"] = f"""
SELECT engine, measure, name, count(*) AS n FROM (
  SELECT workspace_id AS engine, 'validation' AS measure, schema_status AS name FROM suggestions UNION ALL SELECT workspace_id, 'routing', review_status FROM ({_ROUTED}) r
  UNION ALL SELECT workspace_id, 'duplicate', CASE WHEN is_duplicate THEN 'duplicate' ELSE 'unrelated' END FROM suggestions UNION ALL SELECT workspace_id, 'conflict', CASE WHEN has_conflict THEN 'conflict' ELSE 'none' END FROM suggestions
  UNION ALL SELECT workspace_id, 'clarification', CASE WHEN needs_clarification THEN 'required' ELSE 'none' END FROM suggestions) x GROUP BY engine, measure, name"""
