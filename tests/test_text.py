import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatframe import enrich, message_table, score
from chatframe.functions import lexicon as lx
from chatframe.functions import text as tx
from chatframe.functions.lists import WordLists, verb_lemmas
from chatframe.operators import activity, mood, terms
from chatframe.schema import require_columns

COLUMNS = "chat_id string, msg_seq long, datetime timestamp_ntz, sender string, message string"
AT = dt.datetime(2024, 1, 1, 10)


def table(spark, messages, chat="c"):
    rows = [(chat, i, AT, "s", m) for i, m in enumerate(messages)]
    return message_table(spark.createDataFrame(rows, COLUMNS))


def cleaned(spark, *messages, **options):
    return [r for r in enrich(table(spark, messages), **options).orderBy("msg_seq").collect()]


def test_short_messages_are_skipped(spark):
    for row in cleaned(spark, "ok", "😂", " a b ", "null", "Media omitted"):
        assert (row["cleaned_message"], row["emoji_list"], row["has_url"]) == ("", [], False)
    assert cleaned(spark, "😂", count_short=True)[0]["emoji_count"] == 1


def test_emoji(spark):
    runs = cleaned(spark, "Great work!! 🔥😂 yes ❤️", "good🔥bad thing", "你好吗朋友")
    assert runs[0]["emoji_list"] == ["🔥😂", "❤️"]
    assert runs[1]["cleaned_message"] == "goodbad thing"
    assert runs[2]["emoji_count"] == 1
    single = cleaned(spark, "Great work!! 🔥😂 yes", emoji="single")
    assert single[0]["emoji_list"] == ["🔥", "😂"]
    with pytest.raises(ValueError):
        cleaned(spark, "x", emoji="none")


def test_urls_apostrophes_and_lemmas(spark):
    rows = cleaned(
        spark, "see WWW.example.com now", "don't", "She was running and played games", "go http://a.b/c?d=1 x"
    )
    assert rows[0]["has_url"] and rows[0]["cleaned_message"] == "see"
    assert rows[1]["cleaned_message"] == ""
    assert rows[2]["cleaned_message"] == "run play games"
    assert rows[3]["has_url"] and rows[3]["cleaned_message"] == ""


def test_gif_is_media_but_not_skipped(spark):
    row = enrich(table(spark, ["gif omitted"])).first()
    assert row["is_media"] and row["cleaned_message"] == "gif"


def test_lemma_table():
    lemmas = verb_lemmas()
    pairs = {"went": "go", "goes": "go", "running": "run", "tries": "try", "loved": "love",
             "stopping": "stop", "agreeing": "agree", "dying": "die", "watches": "watch", "forgetting": "forget"}
    assert {k: lemmas[k] for k in pairs} == pairs


def test_published_sentences(spark):
    want = {
        "VADER is smart, handsome, and funny.": (0.8316, 0.746, 0.254, 0.0),
        "VADER is smart, handsome, and funny!": (0.8439, 0.752, 0.248, 0.0),
        "VADER is very smart, handsome, and funny.": (0.8545, 0.701, 0.299, 0.0),
        "VADER is not smart, handsome, nor funny.": (-0.7424, 0.0, 0.354, 0.646),
    }
    rows = score(enrich(table(spark, list(want)))).collect()
    got = {r["message"]: (r["sentiment_score"], r["vader_pos"], r["vader_neu"], r["vader_neg"]) for r in rows}
    assert got == want


def test_rules(spark):
    messages = ["good but terrible", "GOOD day", "never so good", "least good", "kind of good",
                "good", "isn't good", "   ", "a", ":) ok then"]
    rows = score(enrich(table(spark, messages))).orderBy("msg_seq").collect()
    s = [r["sentiment_score"] for r in rows]

    def compound(x):
        return round(x / (x * x + 15) ** 0.5, 4)

    assert s[0] == compound(1.9 * 0.5 - 2.1 * 1.5)
    assert s[1] == compound(1.9 + 0.733)
    assert s[2] == compound((1.9 + 0.293) * 1.5)
    assert s[3] == compound(1.9 * -0.74)
    assert s[4] == compound(1.9)
    assert s[5] == compound(1.9)
    assert s[6] == compound(1.9 * -0.74)
    assert (s[7], rows[7]["vader_neu"]) == (0.0, 1.0)
    assert (s[8], rows[8]["vader_neu"]) == (0.0, 0.0)
    assert s[9] > 0


def test_labels_and_confidence(spark):
    df = spark.createDataFrame(
        [(0.05, 0.0), (-0.05, 0.0), (0.0499, 0.0), (0.35, 0.06), (0.35, -0.06), (0.15, 1.0), (0.14, 1.0)],
        "s double, p double",
    )
    rows = df.select(lx.label_of(F.col("s")), lx.confidence_of(F.col("s"), F.col("p"))).collect()
    assert [r[0] for r in rows] == ["Positive", "Negative", "Neutral", *["Positive"] * 4]
    assert [r[1] for r in rows] == ["Low", "Low", "Low", "High", "Medium", "Medium", "Low"]


def test_own_lists(spark):
    lists = WordLists.from_tables(
        stopwords=[spark.createDataFrame([("foo",)], "word string"), spark.createDataFrame([("bar",)], "word string")],
        lemmas=spark.createDataFrame([("bazzes", "baz")], "word string, lemma string"),
        valence=spark.createDataFrame([("baz", 2.0)], "token string, valence double"),
        negations=spark.createDataFrame([("nix",)], "token string"),
    )
    row = score(enrich(table(spark, ["foo nix baz bar bazzes"]), lists), lists).first()
    assert row["cleaned_message"] == "nix baz baz"
    assert row["sentiment_score"] == round(-1.48 / (1.48**2 + 15) ** 0.5, 4)


def test_ngrams_within_one_message(spark):
    e = enrich(table(spark, ["alpha beta", "gamma"]))
    assert terms.ngram_frequency(e, 2).select("phrase").collect()[0][0] == "alpha beta"
    assert terms.ngram_frequency(e, 3).count() == 0


def test_keywords_need_two_senders(spark):
    assert terms.sender_keywords(enrich(table(spark, ["alpha beta", "gamma"]))).count() == 0


def gaps(spark, *moments):
    rows = [("c", i, at, who, "x") for i, (at, who) in enumerate(moments)]
    df = spark.createDataFrame(rows, COLUMNS)
    return [(r["msg_seq"], r["sender"], r["gap_seconds"])
            for r in activity.reply_gaps(df).orderBy("msg_seq").collect()]


def test_reply_gaps(spark):
    sec = dt.timedelta(seconds=1)
    assert gaps(spark, (AT, "a"), (AT + 43200 * sec, "b")) == [(1, "b", 43200)]
    assert gaps(spark, (AT, "a"), (AT + 43201 * sec, "b")) == []
    assert gaps(spark, (AT, "a"), (AT + 43200.4 * sec, "b")) == []
    assert gaps(spark, (AT, "a"), (AT + 0.5 * sec, "b")) == [(1, "b", 0.5)]
    assert gaps(spark, (AT, "a"), (AT, "b")) == []
    # equal times: the last of them is the one answered, the first of the next answers
    assert gaps(spark, (AT, "a"), (AT, "b"), (AT + sec, "b"), (AT + sec, "a")) == []
    assert gaps(spark, (AT, "b"), (AT, "a"), (AT + sec, "b"), (AT + sec, "a")) == [(2, "b", 1)]
    night = dt.datetime(2024, 1, 1, 23, 59, 59)
    assert gaps(spark, (night, "a"), (night + 2 * sec, "b"), (night + 3 * sec, "b")) == [(1, "b", 2)]


def test_reply_gaps_against_brute_force(spark):
    import random

    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"c{rng.randrange(3)}", i,
             AT + dt.timedelta(minutes=rng.randrange(9000)), f"s{rng.randrange(3)}", "x") for i in range(1500)]
    want = []
    for chat in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == chat), key=lambda r: (r[2], r[1]))
        for before, now in zip(ordered, ordered[1:]):
            gap = (now[2] - before[2]).total_seconds()
            if now[3] != before[3] and 0 < gap <= 43200:
                want.append((chat, now[1], now[3], gap))
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    got = [tuple(r) for r in activity.reply_gaps(df).select("chat_id", "msg_seq", "sender", "gap_seconds").collect()]
    assert sorted(got) == sorted(want) and want


def test_weeks_and_months(spark):
    rows = [("c", i, dt.datetime(2024, 1, d), "s", "good day") for i, d in enumerate((7, 8, 14, 31))]
    s = score(enrich(message_table(spark.createDataFrame(rows, COLUMNS))))
    weeks = [(str(r["date"]), r["message_count"]) for r in mood.sentiment_over_time(s, "W").orderBy("date").collect()]
    assert weeks == [("2024-01-07", 1), ("2024-01-14", 2), ("2024-02-04", 1)]
    assert [str(r["date"]) for r in mood.sentiment_over_time(s, "M").collect()] == ["2024-01-31"]
    with pytest.raises(ValueError):
        mood.sentiment_over_time(s, "Q")


def test_missing_columns_fail_early(spark):
    with pytest.raises(ValueError, match="message"):
        require_columns(spark.range(1), ["message"])
