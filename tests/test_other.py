import difflib
import json
import re

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rulewright import catalogue, operators
from rulewright.functions import text
from rulewright.operators import building, fuzzy
from rulewright.sources import files
from test_operators import duck, rows  # noqa: F401

import pytest


@pytest.mark.parametrize("key", sorted(set(catalogue.oracle_sql()) - set(catalogue.operators.OPERATORS)))
def test_queries_with_sql(spark, duck, sf, key):  # noqa: F811
    got, want = catalogue.queries()[key](spark, sf).toPandas(), duck.sql(catalogue.oracle_sql()[key]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("key", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_queries_without_sql(spark, sf, key):
    assert catalogue.queries()[key](spark, sf).count()


def test_ratio_is_difflib_and_the_bound_holds(spark):
    pairs = [("revenue", "revenu"), ("abc", "abcd"), ("x", "yyyy"), ("", "a"), ("order", "orders"), ("brand#1", "brand#12")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", text.sequence_ratio(F.col("a"), F.col("b")).alias("r"), text.ratio_bound(F.col("a"), F.col("b")).alias("u")).collect():
        assert r.r == difflib.SequenceMatcher(None, r.a, r.b).ratio() and r.u >= r.r


def test_similar_terms_finds_all_that_begin_or_end_alike(spark):
    words = ["revenue", "revenues", "avenue", "status", "statuses", "state"]
    df = spark.createDataFrame([(w,) for w in words], "a string")
    got = {(r.a, r.b) for r in fuzzy.similar_terms(df, df.withColumnRenamed("a", "b"), 0.8).collect()}
    assert got == {(a, b) for a in words for b in words if difflib.SequenceMatcher(None, a, b).ratio() > 0.8 and (a[0] == b[0] or a[-1] == b[-1])}


def test_unicode_normalisation(spark):
    df = spark.createDataFrame([("ﬁn",), ("plain",), (None,), ("é",)], "t string")
    assert [r[0] for r in df.select(text.normalise_unicode(F.col("t"))).collect()] == ["fin", "plain", None, "é"]


def test_json_lines_and_glossary(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": broken\n' + json.dumps({"id": 2}) + "\n")
    good, bad = files.read_json_lines(spark, str(tmp_path / "a.jsonl"), StructType([StructField("id", LongType()), StructField("t", StringType())]))
    assert sorted(tuple(r) for r in good.collect()) == [(1, "x"), (2, None)] and bad.count() == 1
    (tmp_path / "g.md").write_text("# Terms\n\n### revenue\nDefinition: Sum of orders\nTables: `orders.total`, `orders.status`\n### churn\nDefinition: Lost\n")
    got = [tuple(r) for r in files.read_glossary(spark, str(tmp_path / "g.md")).orderBy("pos").collect()]
    assert got == [("revenue", "Sum of orders", ["orders.total", "orders.status"], 1), ("churn", "Lost", [], 2)]


def test_upsert_and_splits(spark, tmp_path):
    stored = spark.createDataFrame([(1, "a", "active"), (2, "b", "draft")], "id long, name string, status string")
    new = spark.createDataFrame([(2, "B", "archived"), (3, "C", "active")], "id long, name string, status string")
    assert sorted(tuple(r) for r in files.upsert(stored, new, "id", ["name"]).collect()) == [(1, "a", "active"), (2, "B", "draft"), (3, "C", "active")]
    files.write_splits(stored.withColumns({"split": F.lit("train"), "_why": F.lit("x")}), str(tmp_path / "out"))
    assert set(spark.read.json(str(tmp_path / "out")).columns) == {"id", "name", "status", "split"}


def test_one_active_version_and_whole_families(spark, sf):
    queries = catalogue.queries()
    assert queries["lif_08_one_active"](spark, sf).where("not holds").count() == 0
    split = queries["gen_12_split_by_size"](spark, sf)
    assert split.groupBy("rule_family_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("least", [0.3, 0.6, 0.8, 0.85])
def test_similar_terms_finds_all(spark, least):
    words = ["xstatusy", "astatusb", "status", "", "a", "aa", "aaa", "ab", "ba", "brand#12", "brand#13", "brand#21", "net_revenue", "revenue_net", "été", "ét", "order total", "total order", "x" * 250, "x" * 249 + "y", "abcdefghijkl", "lkjihgfedcba"]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "a string")
    got = {(r.a, r.b): r.ratio for r in fuzzy.similar_terms(df, df.withColumnRenamed("a", "b"), least).collect()}
    assert got == {(a, b): ratio(a, b) for a in words for b in words if ratio(a, b) > least}
    assert least > 0.75 or ("xstatusy", "astatusb") in got


def test_rules_of_like_terms_are_compared(spark, sf):
    new = [tuple(r) for r in fuzzy.view(spark, sf, "new_rules").select("rule_id", "workspace_id", "domain_id", "business_term").collect()]
    old = [tuple(r) for r in fuzzy.view(spark, sf, "rules").select("rule_id", "workspace_id", "domain_id", "business_term").collect()]
    want = {(n[0], o[0]) for n in new for o in old if n[1:3] == o[1:3] and ratio(n[3], o[3]) > 0.85}
    classes = operators.from_tables(spark, "sim_07_classes", sf).collect()

    def told(key, which):
        """All pairs that the pairs of first rules stand for."""
        of = {}
        for r in classes:
            of.setdefault((r.side, r[which]), []).append(r.rule_id)
        rows = catalogue.queries()[key](spark, sf)
        rows = rows.selectExpr("split(comparison_id, '-')[0] AS new_id", "split(comparison_id, '-')[1] AS old_id") if "new_id" not in rows.columns else rows
        return [(n, o) for r in rows.collect() for n in of["new", r.new_id] for o in of["old", r.old_id]]

    got = told("sim_07_pair_features_ratio", "level_id")
    assert len(got) == len(want) and set(got) == want
    equal = set(told("sim_07_pair_features", "level_id"))
    assert equal < want
    for key in ("sim_08_relationship", "sim_13_conflict", "sim_15_comparisons"):
        got = told(f"{key}_ratio", "first_id")
        assert len(got) == len(want) and set(got) == want


def test_weighted_and_related_rules_are_those_of_all_pairs(spark):
    """Against plain loops, with unlike terms, like operations, several conditions and no conditions."""
    terms, operations, columns = ["net revenue", "churned users", "zyx", "net revenues"], ["exclude", "excludes", "map"], ["a", "b"]
    fields = [[], ["orders.status"], ["status", "region"], ["region", "status", "status", "orders.status"]]
    rule = lambda side, n, t, o, c: (f"{side}{n:03d}", n, "w" if n % 7 else "v", terms[t % 4], operations[o % 3], columns[c % 2])
    new, old = [rule("N", n, n, n // 2, n // 3) for n in range(1, 25)], [rule("R", n, n // 3, n, n // 2) for n in range(1, 40)]
    of = {r[0]: fields[(r[1] * 5 + (r[0][0] == "R")) % 4] for r in new + old}
    rules = lambda r: spark.createDataFrame(r, "rule_id string, rule_no long, workspace_id string, business_term string, operation string, affected_column string")
    conditions = lambda r: spark.createDataFrame([(x[0], f) for x in r for f in of[x[0]]], "rule_id string, field string")

    def weighted(n, o):
        term, operation = ratio(n[3], o[3]), ratio(n[4], o[4])
        score = (0.4 * term if term > 0.7 else 0) + (0.3 if n[4] == o[4] else 0.2 * operation if operation > 0.6 else 0) + 0.2 * (1 if n[5] == o[5] else 0.5)
        return score + 0.1 * sum(any(f in g or g in f for g in of[o[0]]) for f in of[n[0]])

    ranked = lambda n, score: sorted(((-round(score(n, o), 9), o[1], o[0]) for o in old if o[2] == n[2]))
    want = {n[0]: (r[0][2], -r[0][0]) for n in new if (r := ranked(n, weighted)) and -r[0][0] > 0.5 + 1e-9}
    got = {r.new_id: (r.rule_id, round(r.score, 9)) for r in fuzzy.weighted_matches(rules(new), conditions(new), rules(old), conditions(old)).collect()}
    assert got == want
    one = lambda name, *terms: rules([(f"{name}{t}", i, "w", t, "map", "x") for i, t in enumerate(terms)])
    held = lambda name: spark.createDataFrame([(name, "region")], "rule_id string, field string")
    assert [(r.rule_id, round(r.score, 6)) for r in fuzzy.weighted_matches(one("N", "aaa"), held("Naaa"), one("R", "yyy", "zzz"), held("Rzzz")).collect()] == [("Rzzz", 0.6)]
    related = lambda n, o: 0.6 * ratio(n[3], o[3]) + 0.4 * (1 if n[5] == o[5] else 0.5)
    want = {(n[0], i + 1, r[2], -r[0]) for n in new for i, r in enumerate([r for r in ranked(n, related) if -r[0] > 0.3 + 1e-9][:5])}
    got = {(r.new_id, r.place, r.rule_id, round(r.score, 9)) for r in fuzzy.related_rules(rules(new), rules(old)).collect()}
    assert got == want
    unlike = fuzzy.related_rules(rules([("N", 1, "w", "aaa", "map", "x")]), rules([("R", 2, "w", "zzz", "map", "x"), ("Q", 3, "w", "zzz", "map", "y")])).collect()
    assert [(r.rule_id, round(r.score, 6)) for r in unlike] == [("R", 0.4)]


def test_families_link_members_far_apart(spark):
    records = spark.createDataFrame([("a", "f", 1), ("b", "f", 5000), ("c", "f", 90000), ("d", "g", 2), ("e", None, 3), ("h", "", 4)], "feedback_id string, rule_family_id string, record_no long")
    assert sorted(tuple(r) for r in building.duplicate_families(records).collect()) == [(i, "f", 3, "a") for i in "abc"]
    assert sorted(r.pair_id for r in building.representative_pairs(records).collect()) == ["a-b", "a-c"]


def test_rare_classes_reach_the_floor(spark):
    records = spark.createDataFrame([(f"r{i}", "rare", f"text {i} ") for i in range(3)] + [("x", "rare", " ")] + [(f"o{i}", "often", "t") for i in range(40)] + [("z", "mute", None)], "feedback_id string, feedback_type string, feedback_text string")
    got = building.top_up(records, 40).orderBy("place").collect()
    assert [r.place for r in got] == list(range(36)) and {(r.feedback_type, r.n, r.need) for r in got} == {("rare", 4, 36)}
    assert len({(r.feedback_id, r.feedback_text) for r in got}) == 27 and all(len({r.feedback_id for r in got[i : i + 3]}) == 3 for i in range(0, 36, 3))
    assert got[3].feedback_text == f"Hi, just reaching out: text {got[3].feedback_id[1]}"


@pytest.mark.parametrize("n_o,n_other,kept", [(20000, 3000, 7000), (1000, 3000, 1000), (50, 0, 0)])
def test_downsampling_meets_the_share(spark, n_o, n_other, kept):
    tokens = spark.range(n_o + n_other).select(F.col("id").alias("feedback_id"), F.lit(0).alias("pos"), F.when(F.col("id") < n_o, "O").otherwise("B-TERM").alias("label"))
    got = building.downsample(tokens)
    assert got.where("label <> 'O'").count() == n_other and abs(got.where("label = 'O'").count() - kept) <= 0.03 * kept


def test_backlog_of_files_in_shuffled_time_order(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for i in (3, 0, 4, 1, 2):
        events.withColumn("_tile", F.expr("ntile(5) over (order by ts)")).where(F.col("_tile") == i + 1).drop("_tile").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    for key, n in (("str_01_stream", "n"), ("str_03_stream", "n"), ("str_02_stream", None)):
        whole, split = (catalogue.queries()[key](spark, at).drop(*([] if n else ["event_id"])).toPandas() for at in (sf, str(tmp_path)))
        assert len(whole) and rows(whole) == rows(split)
    total = catalogue.queries()["str_01_stream"](spark, str(tmp_path)).agg(F.sum("n")).first()[0]
    assert total == events.where("ts is not null").count()
    first = events.select("event_id", "ts", (F.col("user_id") % 5).alias("tenant"), F.get_json_object("props", "$.k").alias("request_key")).toPandas().sort_values(["ts", "event_id"]).drop_duplicates(["tenant", "request_key"])
    assert sorted(r.event_id for r in catalogue.queries()["str_02_stream"](spark, str(tmp_path)).collect()) == sorted(first["event_id"])


def test_words_are_corrected_in_the_text(spark):
    """Against plain loops: short words and terms, plurals, marks at the end, repeats, terms with odd characters."""
    terms = ["order", "revenue", "churn", "company", "box", "tax", "a$b", "net_sales", "class"]
    texts = ["Revenu of the orderr, and REVENU again: revenu-like", "taxs txa bx. companies boxes orders", "classs class clas!", "a$bb net_sale churn's", "", None, "...", "ordr ordr;"]

    def plural(w):
        return any(w.endswith(e) and len(w) > len(e) and w[: -len(e)] + p in terms for e, p in (("ies", "y"), ("es", ""))) or (w.endswith("s") and not w.endswith("ss") and w[:-1] in terms)

    want = {}
    for i, t in enumerate(texts):
        fixes, out = {}, t
        for w in (t or "").split():
            w = w.lower().rstrip(".,!?;:")
            best = min(((-ratio(w, b), b) for b in terms), default=None)
            if w and w not in terms and not plural(w) and -best[0] > 0.8:
                fixes.setdefault(w, best[1])
        for w, b in fixes.items():
            out = re.sub(rf"\b{re.escape(w)}\b", lambda _, b=b: b, out, flags=re.IGNORECASE)
        want[i] = (out, ",".join(f"{w}->{b}" for w, b in fixes.items()))
    df = spark.createDataFrame(list(enumerate(texts)), "feedback_id long, text string")
    got = {r.feedback_id: (r.corrected, r.changes) for r in fuzzy.corrected(df, spark.createDataFrame([(t,) for t in terms], "b string")).collect()}
    assert got == want


def test_families_train_or_test_as_a_whole(spark, sf):
    from rulewright.operators import learn

    records = fuzzy.view(spark, sf, "records").withColumn("side", learn.train_side(F.col("rule_family_id"), F.col("feedback_id")))
    assert records.groupBy("rule_family_id").agg(F.countDistinct("side").alias("n")).where("n > 1").count() == 0
    assert records.select("side").distinct().count() == 2
    loose = spark.createDataFrame([(f"f{i}", None if i % 2 else "") for i in range(40)], "feedback_id string, rule_family_id string")
    assert loose.select(learn.train_side(F.col("rule_family_id"), F.col("feedback_id"))).distinct().count() == 2


def test_two_targets_and_the_mean_of_their_confidence(spark):
    from rulewright.operators import learn

    data = [("exclude cancelled orders from revenue", "business_rule", "filter_rule"), ("only admins may see salaries", "business_rule", "access_rule"), ("the dashboard page is broken", "issue_report", None), ("what does churn mean", "question", None)] * 6
    records = spark.createDataFrame(data, "feedback_text string, feedback_type string, rule_category string")
    model = learn.train(records)
    got = learn.predict(model, spark.createDataFrame([(0, "exclude refunded orders"), (1, "the page is broken"), (2, None)], "feedback_id long, feedback_text string")).orderBy("feedback_id").collect()
    assert (got[0].predicted_type, got[0].predicted_category, got[0].predicted_actionable) == ("business_rule", "filter_rule", True)
    assert (got[1].predicted_type, got[1].predicted_category, got[1].predicted_actionable) == ("issue_report", "", False)
    assert all(0 < r.confidence <= 1 for r in got)
    from rulewright import operators

    feedback = spark.createDataFrame([(0, "w", None, 0, "Exclude refunded orders from the revenue")], "feedback_id long, workspace_id string, created_at timestamp, submitted_by long, feedback_text string")
    answer = learn.outputs(model, feedback)
    row = operators.apply(spark, "cls_06_cascade", feedback=feedback, model_outputs=answer).first()
    assert row.provenance == "model" and row.confidence == answer.first().confidence


def test_running_sums_have_no_single_task(spark, sf):
    from rulewright import operators

    for key in ("gen_12_split_by_size", "gen_13_split_by_ratio", "str_04_active_jobs"):
        plan = operators.from_tables(spark, key, sf)._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line]
        assert windows and all(re.search(r"\], \[(bucket|job_type)#", w) for w in windows)


def test_a_refresh_of_the_index_touches_what_changed(spark, tmp_path):
    index = files.VectorIndex(spark, str(tmp_path / "index"))
    texts = lambda *rows: spark.createDataFrame(rows, "rule_id string, text string")
    assert {tuple(r) for r in index.refresh(texts(("a", "net revenue is x"), ("b", "churn"), ("c", None))).collect()} == {("a", "inserted"), ("b", "inserted"), ("c", "inserted")}
    assert index.refresh(texts(("a", "net revenue is x"), ("b", "churn"), ("c", None))).count() == 0
    assert {tuple(r) for r in index.refresh(texts(("a", "net revenue is y"), ("c", None), ("d", "churn"))).collect()} == {("a", "updated"), ("b", "removed"), ("d", "inserted")}
    now = {r.rule_id: r for r in index.current(spark.read.parquet(index.path)).collect()}
    assert set(now) == {"a", "c", "d"} and abs(now["a"].vector.norm(2) - 1) < 1e-9 and now["c"].vector.numNonzeros() == 0
    assert {(r["version"], r["count"]) for r in spark.read.parquet(index.path).groupBy("version").count().collect()} == {(0, 3), (1, 3)}


def test_nearest_vectors_in_shards_blocks_and_lists(spark, sf):
    import numpy as np
    from rulewright.operators import vectors

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.3 * rng.normal(size=16)).tolist(), i % 20) for i in range(1500)] + [(7, [1.0] * 16, 0), (7, [1.0] * 16, 0), (2000, None, 0), (2001, [0.0] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    queries = df.where("vec_id % 20 = 0 or vec_id = 7")
    whole = rows_of(vectors.batched_top_k(df, queries))
    assert rows_of(vectors.batched_top_k(df, queries, shard_rows=100, block_queries=9)) == whole and len([r for r in whole if r[0] == 7]) == 30
    fitted = vectors.fit_centres(df, 20, sample=400)
    found = rows_of(vectors.approximate_top_k(df, queries, fitted, 3, shard_rows=50, block_queries=20))
    recall = len({r[:2] for r in found} & {r[:2] for r in whole}) / len({r[:2] for r in whole})
    assert recall >= 0.95 and rows_of(vectors.approximate_top_k(df, queries, fitted, 99)) == whole
    exact, near = ({r[:2] for r in rows_of(catalogue.queries()[key](spark, sf))} for key in ("sim_04_batched_top_k", "sim_04_approximate"))
    assert len(exact & near) / len(exact) >= 0.9
    assert vectors.approximate_top_k(df.where("false"), df.where("false"), vectors.fit_centres(df.where("false"), 5), 2).count() == 0


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())
