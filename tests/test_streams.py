"""Saved model versions, live scoring batch by batch, the trend with late rows."""

import datetime as dt

import pytest

from chatframe.operators.mood import sentiment_over_time
from chatframe.operators.training import SentimentModel
from chatframe.sources import models
from chatframe.streaming.live import (
    LiveScorer, Ledger, late_messages, live_results, live_scores, start_live_scores, start_trend, trend_so_far,
)

FIRST = SentimentModel("Naive Bayes", ["Negative", "Positive"], [-0.7, -0.7], {"good": (1.0, -3.0, -1.0), "bad": (1.5, -1.0, -3.0)})
SECOND = SentimentModel("Naive Bayes", ["Negative", "Positive"], [-0.1, -2.0], {"good": (1.0, -1.0, -3.0)})
TEXTS = "id long, text string"


class Crash(Exception):
    pass


def crash(*_, **__):
    raise Crash


# --- versions ---------------------------------------------------------------------------


def test_a_crash_leaves_the_model_before_in_place(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    assert not models.model_exists(spark, path) and models.model_versions(spark, path).count() == 0
    with pytest.raises(FileNotFoundError):
        models.load_model(spark, path)
    first = models.save_model(spark, FIRST, path)
    assert models.load_model(spark, path) == FIRST
    with monkeypatch.context() as broken:
        broken.setattr(models, "_publish", crash)  # all folders of the new version are there
        with pytest.raises(Crash):
            models.save_model(spark, SECOND, path)
    assert models.current_version(spark, path) == first and models.load_model(spark, path) == FIRST
    second = models.save_model(spark, SECOND, path)
    assert models.load_model(spark, path) == SECOND and models.load_model(spark, path, first) == FIRST
    rows = models.model_versions(spark, path).orderBy("number").collect()
    assert [(r["number"], r["version"]) for r in rows] == [(1, first), (2, second)]
    assert models.model_metadata(spark, path).count() == 0


def test_two_trainings_at_once_are_one_model_for_all_readers(spark, tmp_path):
    path = str(tmp_path / "m")
    versions = [models.save_model(spark, m, path) for m in (FIRST, SECOND)]
    models._publish(spark, path, (2, "0" * 32, "Naive Bayes"))  # another writer took the same number
    assert models.current_version(spark, path) == max(versions[1], "0" * 32)


def test_terms_of_a_saved_model(spark, tmp_path):
    models.save_model(spark, FIRST, str(tmp_path / "m"))
    rows = sorted(map(tuple, models.model_terms(spark, str(tmp_path / "m")).collect()))
    assert rows == [("bad", "Negative", 1.5, -1.0), ("bad", "Positive", 1.5, -3.0), ("good", "Negative", 1.0, -3.0), ("good", "Positive", 1.0, -1.0)]


# --- live scores ------------------------------------------------------------------------


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    path, out = str(tmp_path / "m"), str(tmp_path / "out")
    models.save_model(spark, FIRST, path)
    batch = spark.createDataFrame([(1, "good good"), (2, "bad"), (3, ""), (3, "")], TEXTS)
    scorer = LiveScorer(path, out)
    for _ in range(3):
        scorer(batch, 0)
    LiveScorer(path, out)(batch, 0)  # a new process from an old checkpoint
    got = live_results(spark, out, batch.schema)
    want = live_scores(batch, FIRST).select(got.drop("batch_id", "model_version").columns)
    assert sorted(map(str, got.drop("batch_id", "model_version").collect())) == sorted(map(str, want.collect()))
    assert got.count() == 4 and [r["error"] for r in got.filter("id = 3").collect()] == ["Text is empty."] * 2


def test_a_batch_without_its_ledger_row_is_written_again(spark, tmp_path, monkeypatch):
    path, out = str(tmp_path / "m"), str(tmp_path / "out")
    models.save_model(spark, FIRST, path)
    batch = spark.createDataFrame([(1, "good"), (2, "bad")], TEXTS)
    half = live_scores(batch.limit(1), FIRST)
    half.write.parquet(f"{out}/batches/7")  # the crash came before the ledger
    assert live_results(spark, out, batch.schema).count() == 0
    LiveScorer(path, out)(batch, 7)
    rows = live_results(spark, out, batch.schema).orderBy("id").collect()
    assert [(r["id"], r["label"], r["batch_id"]) for r in rows] == [(1, "Positive", 7), (2, "Negative", 7)]


def test_a_new_version_counts_from_the_next_batch(spark, tmp_path):
    path, out, source = (str(tmp_path / x) for x in ("m", "out", "in"))
    first = models.save_model(spark, FIRST, path)
    df = spark.createDataFrame([(1, "good")], TEXTS)
    df.write.mode("append").parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    start_live_scores(stream, path, out, str(tmp_path / "cp")).awaitTermination()
    second = models.save_model(spark, SECOND, path)
    spark.createDataFrame([(2, "good")], TEXTS).write.mode("append").parquet(source)
    start_live_scores(stream, path, out, str(tmp_path / "cp")).awaitTermination()
    start_live_scores(stream, path, out, str(tmp_path / "cp")).awaitTermination()  # nothing new
    rows = live_results(spark, out, df.schema).orderBy("id").collect()
    assert [(r["label"], r["model_version"]) for r in rows] == [("Positive", first), ("Negative", second)]
    assert Ledger(out).rows(spark).count() == 2


# --- trend ------------------------------------------------------------------------------

SCORED = "chat_id string, datetime timestamp_ntz, date date, sentiment_score double, is_media boolean, is_deleted boolean"


def written(spark, source, *days):
    at = [dt.datetime(2024, 1, 1, 12) + dt.timedelta(days=d) for d in days]
    rows = [("c", t, t.date(), 0.25 * (t.day % 3), False, False) for t in at]
    rows.append(("c", at[0], at[0].date(), 1.0, True, False))  # media never count
    spark.createDataFrame(rows, SCORED).coalesce(1).write.mode("append").parquet(source)


def test_trend_equals_the_batch_and_counts_late_rows(spark, tmp_path):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    parts = [(0, 1, 2), (7, 8, 3), (15, 16), (22, 23, 9), (29, 4), (36, 5, 17), (37, 6)]
    for days in parts:  # one after the other, as files come in
        written(spark, source, *days)
        stream = spark.readStream.schema(SCORED).option("maxFilesPerTrigger", 1).parquet(source)
        for q in start_trend(stream, out, cp):
            q.awaitTermination()
    whole = sentiment_over_time(spark.read.parquet(source), "W").select("chat_id", "date", "message_count").collect()
    got = {r["date"]: r["message_count"] for r in trend_so_far(spark, out).collect()}
    late = {r["date"]: r["late_messages"] for r in late_messages(spark, out).collect()}
    assert {r["date"]: r["message_count"] for r in whole} == {d: got.get(d, 0) + late.get(d, 0) for d in got | late}
    # what came a day or less after its week is there, what came weeks after is not
    assert got[dt.date(2024, 1, 7)] >= 3 and late[dt.date(2024, 1, 7)] >= 2 and dt.date(2024, 2, 11) not in late


def test_trend_without_late_rows_equals_the_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for days in ((0, 1, 2), (3, 8, 9), (10, 15, 16)):
        written(spark, source, *days)
    stream = spark.readStream.schema(SCORED).option("maxFilesPerTrigger", 1).parquet(source)
    for freq in ("W", "D"):
        for q in start_trend(stream, f"{out}{freq}", str(tmp_path / f"cp{freq}"), freq):
            q.awaitTermination()
        want = sentiment_over_time(spark.read.parquet(source), freq).select("chat_id", "date", "avg_score", "message_count")
        assert sorted(map(tuple, trend_so_far(spark, f"{out}{freq}").collect())) == sorted(map(tuple, want.collect()))
        assert late_messages(spark, f"{out}{freq}").count() == 0
    with pytest.raises(ValueError):
        start_trend(stream, out, "x", "Q")
