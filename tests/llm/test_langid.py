from rulewright.llm import langid

ROWS = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog went out", "en"), ("le chat et le chien sont la", "fr"), ("der hund und die katze sind da", "de")] * 20)]


def brute(text, model_sets, sizes=langid.SIZES):
    """Grams of a text one by one, for comparison with the vectorised hashing."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return sorted(w[i : i + n] for n in sizes for w in (f" {x} " for x in words) for i in range(len(w) - n + 1))


def test_grams_are_those_of_padded_words():
    text = "Ab, c  Été-x 42 αβγδ"
    assert len(langid.grams(text)) == len(brute(text, None))
    assert len(set(langid.grams(text).tolist())) == len(set(brute(text, None)))
    assert set(langid.grams("ab ab").tolist()) == set(langid.grams("ab").tolist())


def test_prediction_and_odd_rows(spark):
    df = spark.createDataFrame(ROWS + [(100, None, "en"), (101, "", None), (None, "le chien", None)], "doc_id long, text string, lang string")
    model = langid.train(df.where(~langid.held_out()))
    odd = [(1, None), (2, ""), (3, "12 34!"), (4, "the dog"), (5, "le chien"), (6, "der hund"), (None, "the dog"), (4, "the dog"), (7, "the dog and the cat " * 60_000), (8, "日本語")]
    data = spark.createDataFrame([(*r, "old", "extra") for r in odd], "doc_id long, text string, lang_pred string, lang string")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(data, model).collect()]
    assert got[:9] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "fr"), (6, "de"), (None, "en"), (4, "en"), (7, "en")]
    assert all(0 <= r.score <= 1 for r in langid.identify(data, model).collect())
    assert got[9][1] in model.languages


def test_more_languages_than_a_word_has_bits(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{letters[i % 26] * 3}{letters[i // 26] * 2}q " * 5, f"l{i:02d}") for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, langid.train(df)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 68


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(df, langid.train(df)).first().lang_pred == "und"


def test_query_held_out_accuracy(spark, sf):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = langid.op1_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert held and sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def plain_grams(text):
    words, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            words.append(f" {word} ")
            word = ""
    return [w[i : i + n] for n in langid.SIZES for w in words for i in range(len(w) - n + 1)]


def test_query_agrees_with_plain_sets(spark, sf):
    """The whole query against counted n-grams in plain sets: no filter, no hashes, no false positives."""
    import zlib
    from collections import Counter

    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    counts = {}
    for i, text, lang in docs:
        if lang is not None and text is not None and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    rate = {lang: {g: n / sum(c.values()) for g, n in sorted(c.items(), key=lambda x: -x[1])[:6000]} for lang, c in counts.items()}
    most = Counter()
    for own in rate.values():
        for g, x in own.items():
            most[g] = max(most[g], x)
    known = {lang: {g for g, x in own.items() if x >= 0.1 * most[g]} for lang, own in rate.items()}
    cover = {lang: sum(rate[lang][g] for g in known[lang]) for lang in known}
    same, apart = 0, []
    got = {r.doc_id: r for r in langid.op1_language_id(spark, sf).collect()}
    for i, text, _ in docs:
        grams = plain_grams(text or "")
        if not grams:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        own = {lang: sum(g in known[lang] for g in grams) / len(grams) / cover[lang] for lang in sorted(known)}
        best = max(own, key=own.get)
        same += got[i].lang_pred == best or own[best] - own[got[i].lang_pred] < 0.02
        apart.append(abs(got[i].score - min(1.0, own[got[i].lang_pred])))
    assert same == len(apart) and sum(apart) / len(apart) < 0.01 and len(got) == len(docs)


def test_identify_nothing(spark):
    model = langid.train(spark.createDataFrame([(1, "the house", "en")], "doc_id long, text string, lang string"))
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    r = langid.identify(spark.createDataFrame([(1, None), (1, None), (2, "12 34")], "doc_id long, text string"), model).collect()
    assert [(x.lang_pred, x.score) for x in r] == [("und", 0.0)] * 3
