"""The full run on a small written chat: training, saving, reuse, outputs, streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from chatframe import analyze, chart_feeds, load_model, save_dashboard, save_report
from chatframe.operators.scoring import predict_texts
from chatframe.plans.analysis import scored_messages
from chatframe.plans.outputs import dashboard, detailed_results
from chatframe.sources.models import model_exists
from chatframe.streaming.live import live_results, live_scores, start_live_scores

GOOD = ["great work team, I love it", "what a wonderful happy day", "excellent, best plan ever",
        "thanks, this is awesome and fun"]
BAD = ["this is terrible, I hate it", "awful boring mess again", "worst horrible day, so sad",
       "stupid useless broken thing"]


def chat_rows(chat, n, start=dt.datetime(2024, 1, 1, 9)):
    rows = []
    for i in range(n):
        text = (GOOD if i % 2 else BAD)[(i // 2) % 4] + f" number {'abcdefghij'[i % 10] * 3}"
        rows.append((chat, i, start + dt.timedelta(hours=5 * i), f"s{i % 3}", text))
    return rows


@pytest.fixture(scope="module")
def messages(spark):
    rows = chat_rows("big", 80) + chat_rows("small", 6)
    rows.append(("quiet", 0, dt.datetime(2024, 1, 1), "a", "<Media omitted>"))
    return spark.createDataFrame(
        rows, "chat_id string, msg_seq long, datetime timestamp_ntz, sender string, message string"
    )


@pytest.fixture(scope="module")
def run(spark, messages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model"))
    assert not model_exists(spark, path)
    return analyze(messages, model_path=path), path


def test_modes_and_predictions(run):
    result, _ = run
    modes = {r["chat_id"]: r["mode"] for r in result.modes.collect()}
    assert modes == {"big": "FULL", "small": "NO_ML", "quiet": "NO_ML"}
    assert result.training.accuracy > 0.8
    assert result.training.classes == ["Negative", "Positive"]
    n = result.training.training_samples + result.training.test_samples
    assert result.training.test_samples == -(-n // 5)
    small = result.messages.filter("chat_id <> 'big'")
    assert small.filter("predicted_sentiment <> sentiment_label").count() == 0


def test_reuse_gives_the_same_labels(spark, run, messages):
    first, path = run
    again = analyze(messages, model_path=path)
    assert again.training is None
    assert {r["mode"] for r in again.modes.collect()} == {"FAST", "NO_ML"}
    key = ["chat_id", "msg_seq", "predicted_sentiment"]
    assert sorted(map(tuple, first.messages.select(key).collect())) == sorted(
        map(tuple, again.messages.select(key).collect())
    )
    meta = again.model_metadata.collect()
    assert len(meta) == 1 and meta[0]["accuracy"] == first.training.accuracy


def test_no_text_is_neutral(run):
    quiet = run[0].overall_mood.filter("chat_id = 'quiet'").collect()[0]
    assert (quiet["overall_label"], quiet["overall_score"], quiet["total_analysed"]) == ("Neutral", 0.0, 0)


def test_chart_feeds_and_results(run):
    feeds = chart_feeds(run[0].messages)
    assert len(feeds) == 10
    assert feeds["hourly_activity"].filter("is_peak").count() == 3
    assert feeds["sentiment_trend"].filter("chat_id = 'quiet'").count() == 0
    for feed in feeds.values():
        feed.limit(1).collect()
    rows = detailed_results(run[0].messages).filter("chat_id = 'big'").collect()
    assert len(rows) == 3 and all(r["keywords"] for r in rows)


def test_sinks(spark, run, tmp_path):
    result, _ = run
    save_report(result, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report" / "section=model")).count() == 9
    save_dashboard(result, str(tmp_path / "dash"))
    back = spark.read.json(str(tmp_path / "dash")).filter("chat_id = 'big' and section = 'hourly'")
    hours = json.loads(back.collect()[0]["payload"])
    assert len(hours) == 24 and sum(h["messages"] for h in hours) == 80
    assert dashboard(result.messages).filter("section = 'response_times'").count() > 0


def test_stream_equals_batch(spark, run, tmp_path):
    model = load_model(spark, run[1])
    texts = [(i, t) for i, t in enumerate([*GOOD, *BAD, "", "x" * 501, None])]
    df = spark.createDataFrame(texts, "id int, text string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    start_live_scores(stream, run[1], str(tmp_path / "out"), str(tmp_path / "cp"), max_chars=500).awaitTermination()
    found = live_results(spark, str(tmp_path / "out"), df.schema)
    got = sorted(map(str, found.drop("batch_id", "model_version").collect()))
    want = live_scores(df, model, max_chars=500).select(found.drop("batch_id", "model_version").columns).collect()
    assert got == sorted(map(str, want))
    errors = {r["id"]: r["error"] for r in want}
    assert errors[8] == "Text is empty." and errors[9].startswith("Text too long")
    assert errors[10] == "No text provided." and errors[0] is None
    long = live_scores(df, model).filter("id = 9").first()  # no limit unless one is given
    assert long["error"] is None and long["label"] is not None
    both = predict_texts(df, model).filter("id < 8").collect()
    assert all(abs(r["prob_positive"] + r["prob_negative"] - 1) < 1e-3 for r in both)


def test_alone_or_together(spark, messages):
    together = scored_messages(messages.repartition(7)).filter("chat_id = 'big'")
    alone = scored_messages(messages.filter("chat_id = 'big'").coalesce(1))
    columns = ["msg_seq", "cleaned_message", "sentiment_score", "sentiment_label", "vader_pos"]
    assert sorted(map(tuple, together.select(columns).collect())) == sorted(
        map(tuple, alone.select(columns).collect())
    )
    assert alone.agg(F.count("*")).first()[0] == 80
