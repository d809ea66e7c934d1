"""Words joined with list tables: idioms, lists of any size, repeated rows, feeds and views."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatframe import analyze
from chatframe.functions.lists import WordLists, united
from chatframe.operators import terms, training as tr
from chatframe.operators.enrich import enrich, message_table, score
from chatframe.operators.occurrences import KEY, _listed_forms, keyed, rule_hits
from chatframe.operators.scoring import predict_texts
from chatframe.plans import catalog, outputs
from chatframe.plans.analysis import feature_summary
from tests.test_analysis import chat_rows
from tests.test_regression import sample

COLUMNS = "chat_id string, msg_seq long, datetime timestamp_ntz, sender string, message string"


def table(spark, texts):
    rows = [("c", i, dt.datetime(2024, 1, 1), "s", t) for i, t in enumerate(texts)]
    return message_table(spark.createDataFrame(rows, COLUMNS))


def compound(spark, texts, lists=None):
    lists = lists or WordLists()
    rows = score(enrich(table(spark, texts), lists), lists).orderBy("msg_seq").collect()
    return [r["sentiment_score"] for r in rows]


def normal(total):
    return round(total / (total * total + 15) ** 0.5, 4)


def test_idioms_by_hand(spark):
    got = compound(spark, [
        "I think it was the bomb",               # an idiom replaces the valence
        "the bomb",                              # not without three words before it
        "that was a kiss of death today",        # of three words, the last of which is scored
        "we all said it was yeah right now",     # begins at the word itself
        "you can really cut the mustard here",   # forward, of three words, after a booster
        "it was all sort of good",               # a phrase that weakens: two words before
        "it was all sort of very good",          # the same phrase, three words before
        "it was all kind of very good",          # not behind a scored word, which "kind" is
    ])
    assert got[0] == normal(3.0) and got[1] == normal(-2.2)
    assert got[2] == normal(1.8 - 1.5)  # "death" looks back; "kiss" has two words before it and counts by itself
    assert got[3] == normal(-2.0) and got[4] == normal(2.0)
    assert got[5] == normal(1.9 - 0.293) and got[6] == normal(1.9)
    assert got[7] == compound(spark, ["it was all kind of very good"], WordLists(idioms={}))[0]


def test_own_idioms_and_the_longest_one(spark):
    lists = WordLists.from_tables(
        valence=spark.createDataFrame([("good", 2.0)], "token string, valence double"),
        idioms=spark.createDataFrame([("so good", 0.5), ("oh so good", -1.0), ("good grief", 1.0), ("good grief man", -2.0)], "phrase string, valence double"),
    )
    got = compound(spark, ["a man said oh so good", "and he said well good grief", "and he said well good grief man"], lists)
    assert got == [normal(0.5), normal(1.0), normal(-2.0)]  # two words behind before three; ahead, the longer


def test_lists_are_never_collected(spark):
    """A list with more rows than any literal could hold; only the words of the text matter."""
    many = spark.range(300_000).select(F.concat(F.lit("w"), "id").alias("word"), F.lit("lemma").alias("lemma"))
    letters = spark.createDataFrame([("abc", "xyz")], "word string, lemma string")
    lists = WordLists.from_tables(lemmas=many.union(letters))
    df = enrich(table(spark, ["abc plain words"]), lists)
    assert df.first()["cleaned_message"] == "xyz plain words"
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "w299999" not in plan and "Join" in plan


def test_lists_are_united(spark):
    parts = [spark.createDataFrame([(w,) for w in ws], "word string") for ws in (["a", "b", None], ["b", "c"], [])]
    assert sorted(r[0] for r in united(parts).collect()) == ["a", "b", "c"]
    lists = WordLists.from_tables(stopwords=parts, valence=spark.createDataFrame([("x", 1.0), ("x", 2.0)], "token string, valence double"))
    rules = lists.rules(spark).filter("token = 'x'").collect()
    assert [(r["valence"], r["delta"]) for r in rules] == [(2.0, None)]


def test_repeated_rows_and_keys_without_an_identity(spark):
    one = table(spark, ["I love it", "I love it", None, ""])
    twice = one.union(one).union(one.filter("msg_seq = 0"))
    rows = score(enrich(twice)).groupBy("msg_seq").agg(F.count("*"), F.count_distinct("sentiment_score"), F.max("cleaned_message")).collect()
    assert sorted((r[0], r[1], r[2]) for r in rows) == [(0, 3, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1)]
    same = keyed(spark.createDataFrame([("a",), ("a",), (None,)], "text string"), "text")
    assert same.select(*KEY).distinct().count() == 2
    model = tr.SentimentModel("m", ["Negative", "Positive"], [0.0, 0.0], {"love": (1.0, -1.0, 1.0), "love cake": (2.0, 0.0, 3.0)})
    texts = spark.createDataFrame([("love cake",)] * 3 + [(None,), ("",)], "text string")
    found = predict_texts(texts, model)
    assert found.columns[0] == "text" and not set(KEY) & set(found.columns)
    assert [r["label"] for r in found.filter("text = 'love cake'").collect()] == ["Positive"] * 3
    assert [r["confidence"] for r in found.filter("text IS NULL OR text = ''").collect()] == [1.0, 1.0]


@pytest.mark.parametrize("labels", [["Negative", "Positive"], ["Negative", "Neutral", "Positive"]])
def test_the_certificate_sees_whether_a_fit_is_the_optimum(spark, labels):
    s = sample(spark, labels)
    runs = tr.runs_of(s).cache()
    counts = tr.term_counts(s)
    vocab = tr.vocabulary(counts, runs).cache()
    weighted = tr.features(counts, runs, vocab).cache()
    fitted, _ = tr.fit_regressions(weighted, runs, labels)
    coefficients = tr.regression_coefficients(spark, vocab, fitted, labels)
    worst = F.max(F.abs("gradient"))
    by_run = tr.regression_gradient(weighted, runs, coefficients).groupBy("run").agg(worst.alias("g")).collect()
    assert len(by_run) == 6 and all(r["g"] < 1e-6 for r in by_run), by_run
    moved = coefficients.withColumn("weight", F.when(F.col("run") == 2, F.col("weight") + 0.01).otherwise(F.col("weight")))
    worse = {r["run"]: r["g"] for r in tr.regression_gradient(weighted, runs, moved).groupBy("run").agg(worst.alias("g")).collect()}
    assert worse[2] > 1e-5 and all(g < 1e-6 for run, g in worse.items() if run != 2)


@pytest.fixture(scope="module")
def analysis(spark):
    return analyze(spark.createDataFrame(chat_rows("big", 60), COLUMNS))


def test_a_broken_feed_stops_no_other(spark, analysis, tmp_path):
    path = str(tmp_path / "feeds")

    def broken(messages):
        return messages.select(F.raise_error(F.lit("no such feed")).alias("x"))

    ok = outputs.save_feeds(analysis.messages, path)
    assert [r["status"] for r in ok.collect()] == ["ok"] * 10
    rows = {r["feed"]: r for r in outputs.save_feeds(analysis.messages, path, outputs.FEEDS | {"top_words": broken}).collect()}
    assert [f for f, r in rows.items() if r["status"] == "failed"] == ["top_words"]
    assert rows["top_words"]["error"] and rows["top_words"]["rows"] is None and rows["hourly_activity"]["rows"] == 24
    assert outputs.read_feed(spark, path, "top_words").count() == ok.filter("feed = 'top_words'").first()["rows"]  # of the run before
    with pytest.raises(FileNotFoundError):
        outputs.read_feed(spark, path, "nothing")


def test_every_result_is_a_view(spark, analysis):
    names = catalog.create_views(analysis, "a_")
    assert len(names) >= 27 and len(set(names)) == len(names)
    for name in names:
        spark.sql(f"SELECT count(*) FROM {name}").collect()
    joined = spark.sql(
        "SELECT s.sender, s.total_messages, m.avg_score FROM a_sender_stats s JOIN a_sentiment_by_sender m USING (chat_id, sender)"
    )
    assert joined.count() == 3
    catalog.drop_views(spark, names)
    assert not any(t.name.startswith("a_") for t in spark.catalog.listTables())


def test_only_words_that_change_a_text_are_grouped(spark):
    """A short word that stays short is no hit; a short word with a long form is one."""
    lemmas = spark.createDataFrame([("ux", "design"), ("is", "be"), ("went", "go"), ("ran", "run")], "word string, lemma string")
    lists = WordLists.from_tables(stopwords=[spark.createDataFrame([("of",), ("the",)], "word string")], lemmas=lemmas)
    known = {r["word"]: r["form"] for r in _listed_forms(spark, lists, False).collect()}
    assert known == {"ux": "design", "went": "go", "ran": "run", "the": ""}
    texts = ["the ux is of ran went home", "of the is", "zzz", "", None, "<Media omitted>", "12 34"]
    rows = enrich(table(spark, texts), lists).orderBy("msg_seq").collect()
    assert [r["cleaned_message"] for r in rows] == ["design run home", "", "zzz", "", "", "", ""]


def test_hits_of_the_rules_are_not_sorted_for_an_idiom(spark):
    hits = rule_hits(keyed(table(spark, ["we all thought it was the bomb"]), "message"), "message", WordLists())
    assert "SortAggregate" not in hits._jdf.queryExecution().executedPlan().toString()
    assert hits.first()["_values"] == [3.0]


def test_pairs_give_words_and_phrases(spark):
    texts = ["cat dog cat dog", "cat", "", None, "bird dog"]
    df = enrich(table(spark, texts))
    pairs = {(r["word"], r["next_word"]): r["count"] for r in terms.pair_frequency(df).collect()}
    assert pairs == {("cat", "dog"): 2, ("dog", "cat"): 1, ("dog", None): 2, ("cat", None): 1, ("bird", "dog"): 1}
    row = feature_summary(df).first()
    assert (row["total_words"], row["unique_words"], row["top_word"], row["top_bigram"]) == (7, 3, "cat", "cat dog")
