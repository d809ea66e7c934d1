"""What the plans of large jobs may not do; results are compared elsewhere."""

import re
from dataclasses import replace

from pyspark.sql import functions as F

from chatframe.functions import text as tx
from chatframe.functions.lists import WordLists
from chatframe.operators.enrich import enrich, message_table, score
from chatframe.operators.occurrences import KEY, keyed, term_counts
from chatframe.operators.scoring import predict_texts
from chatframe.operators.training import SentimentModel, training_sample
from chatframe.plans.analysis import feature_summary, scored_messages
from chatframe.plans.outputs import dashboard
from chatframe.sources import exports
from checks.queries import Training

TEXTS = ["I jogged and really love this, not bad at all!", "", "ok", "<Media omitted>", None, "We all thought it was the bomb", "jogged jogged never so GOOD"]


def messages(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "msg_seq long, message string")
    when = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz").alias("datetime")
    return rows.select(F.lit("c").alias("chat_id"), "msg_seq", when, F.lit("A").alias("sender"), "message")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_scoring_cleans_once_and_takes_texts_apart_once(spark):
    found = plan(scored_messages(messages(spark)))
    assert len(re.findall(r"^.*\[\^a-z\]\+.*$", found, re.MULTILINE)) == 1
    assert "size(transform(filter(split(" not in found  # tokens made for a filter before the words


def test_scoring_on_the_way_equals_scoring_by_itself(spark):
    lemmas = spark.createDataFrame([("jogged", "very good"), ("love", "adore")], "word string, lemma string")
    given = spark.createDataFrame(
        [("very", 0.2, 0.3, 1.3), ("good", 0.7, 0.6, 1.0), ("bad", -0.7, 0.6, 1.0), ("jogged", -1.0, 1.0, 1.0)],
        "word string, polarity double, subjectivity double, intensity double",
    )
    lists = WordLists.from_tables(lemmas=lemmas, subjectivity=given)
    rows = messages(spark).union(messages(spark).limit(2))
    once = scored_messages(rows, lists)
    apart = score(enrich(message_table(rows), lists), lists).select(once.columns)
    assert sorted(map(str, once.collect())) == sorted(map(str, apart.collect()))
    assert once.filter("msg_seq = 0").first()["subjectivity"] > 0


def test_feature_summary_cleans_once(spark):
    summary = feature_summary(enrich(message_table(messages(spark))))
    assert len(re.findall(r"^.*\[\^a-z\]\+.*$", plan(summary), re.MULTILINE)) == 1
    row = summary.first()
    said = [r["cleaned_message"].split() for r in enrich(message_table(messages(spark))).collect()]
    words = [w for m in said for w in m]
    pairs = [" ".join(p) for m in said for p in zip(m, m[1:])]
    most = lambda entries: min(set(entries), key=lambda e: (-entries.count(e), e))
    assert (row["total_words"], row["unique_words"]) == (len(words), len(set(words)))
    assert (row["top_word"], row["top_bigram"]) == (most(words), most(pairs))


def test_cleaning_groups_only_the_words_of_a_list(spark):
    cleaned = enrich(message_table(messages(spark)))
    assert re.search(r"Filter \(whole#\d+ OR isnotnull\(form#", plan(cleaned))
    assert "posexplode" not in plan(cleaned)
    found = {r["msg_seq"]: r["cleaned_message"] for r in cleaned.collect()}
    assert found[0] == "jogged really love bad" and found[6] == "jogged jogged never good"
    assert found[1] == found[2] == found[4] == ""


def test_no_pattern_looks_for_the_ends_of_a_text(spark):
    assert "\\s+$" not in plan(messages(spark).select(tx.is_skippable(F.col("message"))))
    spaces = "".join(chr(c) for c in range(0x3100) if re.fullmatch(r"\s", chr(c)) and c not in range(0x1C, 0x20))
    rows = spark.createDataFrame([(spaces + "a b" + spaces,), (spaces,), ("\x1ca\u200b",), (None,)], "t string")
    once = F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("once")
    assert [r["now"] for r in rows.select(tx.strip(F.col("t")).alias("now")).collect()] == ["a b", "", "\x1ca\u200b", None]
    assert rows.select(once, tx.strip(F.col("t")).alias("now")).filter("NOT once <=> now").count() == 0


def test_lines_are_never_dealt_by_chat_alone(spark):
    lines = [("a", i // 5, i, f"1/1/2024, 10:{i:02d} - A: text {i}") for i in range(20)]
    df = spark.createDataFrame(lines, "chat_id string, block long, line_no long, line string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = exports.split_lines(df)
        physical = found._jdf.queryExecution().executedPlan().toString()
        assert len(found.collect()) == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    by_chat = re.compile(r"Exchange hashpartitioning\(chat_id#\d+, \d+\)")
    dealt = physical.split("\n")
    below = [dealt[i + 1] for i, text in enumerate(dealt) if by_chat.search(text)]
    assert below and not [text for text in below if "line#" in text or "piece" in text]  # counts of blocks only


def test_scoring_with_short_lists_moves_no_row(spark):
    found = scored_messages(messages(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in found and "Join" not in found
    long = WordLists(stopwords=frozenset(f"w{i}" for i in range(2000)))  # no list is cut: a longer one is joined
    assert "Join" in plan(scored_messages(messages(spark), long))


def test_short_lists_say_the_same_as_tables(spark):
    """Words looked up in the row against the same lists as tables, which are joined; also mixed."""
    texts = [
        *TEXTS, "NOT bad, but I never so LOVED it!!", "we all said the bomb, sort of good, just enough very kind of bad",
        "it isn't the least good; at least good", "this KISS of death was really extremely good ????", "yeah right, cut the mustard :)",
        "went gone running LOVES https://a.b/bad www.x.y/good 🔥 great", "\u3000 ", "É İ ΣΑΣ great", "never very good not really bad",
        "a b c", "kind of kind", "hardly ever this never good", "and he has had never a so good bad ass",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "msg_seq long, message string")
    when = F.lit("2024-01-01 10:00:00").cast("timestamp_ntz").alias("datetime")
    rows = rows.union(rows.filter("msg_seq % 3 = 0")).select(F.lit("c").alias("chat_id"), "msg_seq", when, F.lit("A").alias("sender"), "message")
    seeds = WordLists()
    names = ("lemmas", "valence", "boosters", "negations", "subjectivity", "idioms")
    tables = WordLists.from_tables(stopwords=[seeds.table(spark, "stopwords")], **{n: seeds.table(spark, n) for n in names})

    def result(lists):
        return sorted(map(str, scored_messages(rows, lists).collect()))

    expected = result(tables)
    assert result(seeds) == expected and len({r.split("sentiment_score=")[1] for r in expected}) > 12
    assert result(replace(tables, stopwords=seeds.stopwords, lemmas=seeds.lemmas)) == expected
    assert result(replace(seeds, subjectivity=tables.subjectivity)) == expected
    assert result(replace(seeds, valence=tables.valence)) == expected


def test_terms_are_counted_by_hash(spark):
    """Repeated rows have one key, and a count is not that of all of them."""
    weights = spark.createDataFrame([("cat", [1.0, 2.0]), ("cat dog", [3.0, 4.0]), ("rare", [5.0, 6.0])], "term string, weights array<double>")
    texts = spark.createDataFrame([("c", 1, "cat dog cat dog cat"), ("c", 2, "bird"), ("c", 3, ""), ("c", 4, None)], "chat_id string, msg_seq long, text string")
    dealt = keyed(texts.union(texts.filter("msg_seq < 3")).union(texts.filter("msg_seq = 1")), "text")
    counts = term_counts(dealt, tx.words_of(F.col("text")), weights)
    assert "collect_set" not in plan(counts)
    got = dealt.filter("text IS NOT NULL").dropDuplicates(["msg_seq"]).join(counts, KEY, "left").orderBy("msg_seq").collect()
    entries = [[(e["term"], e["n"], e["weights"]) for e in r["_entries"] or []] for r in got]
    assert entries == [[("cat", 3, [1.0, 2.0]), ("cat dog", 2, [3.0, 4.0])], [], []]


def test_live_texts_are_dealt_and_cleaned_in_the_row(spark):
    model = SentimentModel("m", ["Negative", "Positive"], [0.0, 0.0], {"love": (1.0, -1.0, 1.0)})
    texts = messages(spark).select("chat_id", "msg_seq", F.col("message").alias("text"))
    found = predict_texts(texts, model)._jdf.queryExecution().executedPlan().toString().split("\n")
    cleaned = [i for i, line in enumerate(found) if "[^a-z]+" in line]
    assert len(cleaned) == 1 and "whole#" not in "".join(found)  # no row for each word of a text
    assert any("Exchange hashpartitioning(_k1" in line for line in found[cleaned[0] + 1 :])  # a file may be one task


def test_training_stores_no_texts_it_does_not_read(spark, tmp_path):
    when = F.lit("2024-01-01 10:00:00").cast("timestamp")
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("good work").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(1).selectExpr("id AS conv_id", "id AS turn", "'u' AS role", "'bad' AS text").write.parquet(f"{tmp_path}/conversations.parquet")
    events = spark.range(1).select(F.col("id").alias("event_id"), when.alias("ts"), F.col("id").alias("user_id"), F.lit("click").alias("event_type"), F.lit(9.0).alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    t = Training(spark, str(tmp_path))
    assert t.labelled.count() == 42 and "message" not in t.labelled.columns
    assert sorted(map(str, t.sample.collect())) == sorted(map(str, training_sample(t.scored).collect()))
    assert "message" not in t.shown.columns
    assert sorted(map(str, dashboard(t.shown).collect())) == sorted(map(str, dashboard(t.scored).collect()))
