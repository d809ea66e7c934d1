"""Registered queries: every operator over the whole message view."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatframe.functions.text import round_half_even
from chatframe.operators import activity, mood, sampling, scoring, stats, terms, training
from chatframe.operators.enrich import enrich, message_table
from chatframe.plans import outputs
from chatframe.plans.analysis import feature_summary, scored_messages
from chatframe.plans.store import shared_folder, stored
from chatframe.sources import exports, models
from chatframe.sources.tables import chat_messages
from chatframe.streaming import live

Query = Callable[[SparkSession, str], DataFrame]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_table(chat_messages(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich(messages(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_messages(chat_messages(spark, sf_dir))


def over(table: Query, operator: Callable[..., DataFrame], *args, **kwargs) -> Query:
    """``operator`` applied to one of the three tables above."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(table(spark, sf_dir), *args, **kwargs)

    return query


def flat_enriched(df: DataFrame) -> DataFrame:
    return df.select(
        "chat_id", "msg_seq", F.array_join("emoji_list", "|").alias("emoji_list"), "emoji_count",
        "has_url", "cleaned_message",
    )


def vocabulary(df: DataFrame) -> DataFrame:
    return terms.vocabulary_totals(terms.word_frequency(df))


QUERIES: dict[str, Query] = {
    "message_table": messages,
    "enriched_messages": over(enriched, flat_enriched),
    "scored_messages": over(
        scored,
        lambda df: df.select(
            "chat_id", "msg_seq", "sentiment_label", "sentiment_score", "subjectivity",
            "sentiment_confidence", "vader_pos", "vader_neg", "vader_neu",
        ),
    ),
    "chat_summary": over(messages, stats.chat_summary),
    "chat_senders": over(messages, stats.chat_senders),
    "processing_stats": over(enriched, stats.processing_stats),
    "sender_stats": over(enriched, stats.sender_stats),
    "participation": over(messages, stats.participation),
    "monthly_volume_by_sender": over(messages, stats.monthly_volume_by_sender),
    "monthly_volume_estimate": over(messages, stats.monthly_volume_by_sender, estimate=True),
    "word_frequency": over(enriched, terms.word_frequency),
    "vocabulary_totals": over(enriched, vocabulary),
    "bigram_frequency": over(enriched, terms.ngram_frequency, 2),
    "trigram_frequency": over(enriched, terms.ngram_frequency, 3),
    "emoji_frequency": over(enriched, terms.emoji_frequency),
    "top_words": over(enriched, terms.top_words),
    "top_bigrams": over(enriched, terms.top_bigrams),
    "top_trigrams": over(enriched, terms.top_trigrams),
    "top_emojis": over(enriched, terms.top_emojis),
    "word_weights": over(enriched, terms.word_weights),
    "sender_keywords": over(enriched, terms.sender_keywords),
    "hourly_activity": over(messages, activity.hourly_activity),
    "weekday_activity": over(messages, activity.weekday_activity),
    "monthly_activity": over(messages, activity.monthly_activity),
    "monthly_activity_by_year": over(messages, activity.monthly_activity, by_year=True),
    "daily_activity": over(messages, activity.daily_activity),
    "activity_peaks": over(messages, activity.peaks),
    "reply_gaps": over(messages, activity.reply_gaps),
    "reply_times": over(messages, activity.reply_times),
    "sentiment_by_sender": over(scored, mood.sentiment_by_sender),
    "sentiment_daily": over(scored, mood.sentiment_over_time, "D"),
    "sentiment_weekly": over(scored, mood.sentiment_over_time, "W"),
    "sentiment_monthly": over(scored, mood.sentiment_over_time, "M"),
    "overall_mood": over(scored, mood.overall_mood),
    "label_distribution": over(scored, mood.label_distribution),
    "label_distribution_all": over(scored, mood.label_distribution, text_only=False),
}


# --- exported text and back ------------------------------------------------------------


def exported_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message view written as transcript lines, three layouts, one block per hour."""
    m = chat_messages(spark, sf_dir)
    stamp = (
        F.when(F.col("chat_id") == "de", F.concat(F.date_format("datetime", "d/M/yyyy, h:mm a"), F.lit(" - ")))
        .when(
            F.col("chat_id") == "team",
            F.concat(F.lit("["), F.date_format("datetime", "d/M/yyyy, h:mm:ss a"), F.lit("] ")),
        )
        .otherwise(F.concat(F.date_format("datetime", "d/M/yyyy, H:mm"), F.lit(" - ")))
    )
    text = F.concat(stamp, F.col("sender"), F.lit(": "), F.col("message"))
    hour = F.unix_date(F.to_date("datetime")).cast("long") * 24 + F.hour("datetime")
    in_block = Window.partitionBy("chat_id", "block").orderBy("datetime", "msg_seq", "pos")
    return m.select(
        "chat_id", "datetime", "msg_seq", hour.alias("block"),
        F.posexplode(F.split(text, "\n")).alias("pos", "line"),
    ).select("chat_id", "block", F.row_number().over(in_block).cast("long").alias("line_no"), "line")


def odd_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported lines, and in one chat a notice after every third block and a time that
    can't be read after every fifth; a chat of such a time alone; a chat without any layout."""
    lines = exported_lines(spark, sf_dir)
    ends = lines.filter("chat_id = 'fr'").groupBy("chat_id", "block").agg(F.max("line_no").alias("last"))
    notice, unread = "1/1/2024, 10:00 - Someone joined", "99/99/2024, 10:00 - A: x"
    alone = spark.createDataFrame([("yy", 0, 1, unread), ("zz", 0, 1, "no times here")], lines.schema)
    return (
        lines.union(ends.filter("block % 3 = 0").select("chat_id", "block", F.col("last") + 1, F.lit(notice)))
        .union(ends.filter("block % 5 = 0").select("chat_id", "block", F.col("last") + 2, F.lit(unread)))
        .union(alone)
    )


def parse_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = odd_lines(spark, sf_dir)
    return exports.parse_report(exports.timed_blocks(exports.split_lines(lines)))


# --- training: a query stores each table it reads more than once, for itself alone --------


class Training:
    """The tables of one training run, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def scored(self) -> DataFrame:
        return stored(scored(self.spark, self.sf_dir), "scored")

    @cached_property
    def shown(self) -> DataFrame:
        """All scored messages without their texts as written, which no chart reads; the cleaned ones stay."""
        return stored(scored(self.spark, self.sf_dir).drop("message", "time", "word_count", "char_count"), "shown")

    @cached_property
    def labelled(self) -> DataFrame:
        """All scored messages, with the columns that training and prediction read."""
        read = ("is_media", "is_deleted", "cleaned_message", "sentiment_label", "sentiment_confidence")
        return stored(scored(self.spark, self.sf_dir).select("chat_id", "msg_seq", *read), "labelled")

    @cached_property
    def sample(self) -> DataFrame:
        return stored(training.training_sample(self.labelled), "sample")

    @cached_property
    def runs(self) -> DataFrame:
        return stored(training.runs_of(self.sample), "runs")

    @cached_property
    def counts(self) -> DataFrame:
        return stored(training.term_counts(self.sample), "counts")

    @cached_property
    def vocabulary(self) -> DataFrame:
        return stored(training.vocabulary(self.counts, self.runs), "vocabulary")

    @cached_property
    def features(self) -> DataFrame:
        return stored(training.features(self.counts, self.runs, self.vocabulary), "features")

    @cached_property
    def weights(self) -> DataFrame:
        return training.naive_bayes_weights(self.features, self.runs, self.vocabulary)

    @property
    def confusion(self) -> DataFrame:
        return training.confusion(training.naive_bayes_predictions(self.features, self.runs, self.weights))

    @property
    def report(self) -> DataFrame:
        return training.class_report(self.confusion)

    @cached_property
    def model(self) -> training.SentimentModel:
        return training.model_of(self.vocabulary, self.weights, training.class_priors(self.runs))

    @property
    def predicted(self) -> DataFrame:
        return scoring.predict_messages(self.labelled, self.model)


def of_training(result: Callable[[Training], DataFrame]) -> Query:
    return lambda spark, sf_dir: result(Training(spark, sf_dir))


def live_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_messages(spark, sf_dir).select("chat_id", "msg_seq", F.col("message").alias("text"))


def live_scored(t: Training) -> DataFrame:
    return live.live_scores(live_texts(t.spark, t.sf_dir), t.model).drop("text")


def regression_certificate(t: Training) -> DataFrame:
    """Each of the six regressions is at its optimum: no slope of the penalised loss is left."""
    labels = sorted(r[0] for r in t.sample.select("sentiment_label").distinct().collect())
    fitted, _ = training.fit_regressions(t.features, t.runs, labels)
    coefficients = stored(training.regression_coefficients(t.spark, t.vocabulary, fitted, labels), "coefficients")
    gradient = training.regression_gradient(t.features, t.runs, coefficients)
    per_run = gradient.groupBy("run").agg(
        F.count_distinct("term").alias("terms"), (F.max(F.abs("gradient")) < 1e-6).alias("optimal")
    )
    rows = t.runs.filter("part = 'train'").groupBy("run").agg(F.count("*").alias("rows"))
    return per_run.join(rows, "run").select("run", "rows", "terms", "optimal")


def feed_ledger(t: Training) -> DataFrame:
    """The ten feeds, written side by side; one more that breaks costs none of them."""
    path = f"{shared_folder(t.spark)}/feeds-{uuid.uuid4().hex}"
    feeds = outputs.FEEDS | {"broken": lambda messages: messages.select("no_such_column")}
    return outputs.save_feeds(t.scored, path, feeds).select("feed", "status", "rows")


# --- saved models and streams, over files that the query writes for itself -----------------


def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The naive Bayes model, saved as a second version and read back through the manifest."""
    path = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    models.save_model(spark, training.SentimentModel("empty", ["Neutral"], [0.0], {}), path)
    models.save_model(spark, Training(spark, sf_dir).model, path)
    return models.model_terms(spark, path)


def _replayed(df: DataFrame, name: str, parts: int) -> DataFrame:
    """The rows of a table as a stream of files, ``parts`` of them in a micro-batch."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", parts)
    return read.parquet(path)


def live_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages scored as they come, in several micro-batches; the last run finds nothing new."""
    texts = live_texts(spark, sf_dir)
    out = f"{shared_folder(spark)}/live-{uuid.uuid4().hex}"
    models.save_model(spark, Training(spark, sf_dir).model, f"{out}/model")
    stream = _replayed(texts, "incoming", 2)
    for _ in range(2):
        live.start_live_scores(stream, f"{out}/model", f"{out}/scores", f"{out}/checkpoint").awaitTermination()
    return live.live_results(spark, f"{out}/scores", texts.schema).drop("text", "batch_id", "model_version")


def trend_replay(spark: SparkSession, sf_dir: str, delay: str, files: int) -> str:
    """The weekly trend over scored messages that come as files in order of time."""
    columns = ["chat_id", "datetime", "sentiment_score", "is_media", "is_deleted"]
    rows = scored(spark, sf_dir).select(*columns).repartitionByRange(4, "datetime")
    out = f"{shared_folder(spark)}/trend-{uuid.uuid4().hex}"
    for query in live.start_trend(_replayed(rows, "scored-files", files), out, f"{out}/checkpoint", delay=delay):
        query.awaitTermination()
    return out


def trend_of_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No message is late for a trend that waits a hundred years."""
    return live.trend_so_far(spark, trend_replay(spark, sf_dir, "36500 days", 2))


def late_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by week, taken and late, when the trend waits for a day only: their sums are fixed."""
    out = trend_replay(spark, sf_dir, "1 day", 1)
    taken, late = live.trend_so_far(spark, out), live.late_messages(spark, out)
    both = taken.join(late, ["chat_id", "date"], "full")
    n = F.coalesce("message_count", F.lit(0)) + F.coalesce("late_messages", F.lit(0))
    return both.select("chat_id", "date", n.cast("long").alias("messages"))


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both classifiers on the training sample; logistic regression has no SQL form."""
    result = training.train_classifier(Training(spark, sf_dir).sample)
    rows = [
        (name, c["accuracy"], c["f1_score"], c["cross_val_mean"], c["cross_val_std"], name == result.model_name)
        for name, c in result.candidates.items()
    ]
    return spark.createDataFrame(
        rows,
        "model string, accuracy double, f1_score double, cross_val_mean double,"
        " cross_val_std double, chosen boolean",
    )


def rounded(query: Query, *columns: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        return df.withColumns({c: round_half_even(F.col(c), 6) for c in columns})

    return run


QUERIES |= {
    "senders_by_volume": over(enriched, lambda df: stats.by_volume(stats.sender_stats(df)).select("chat_id", "sender", "total_messages")),
    "senders_by_mood": over(scored, lambda df: mood.by_mood(mood.sentiment_by_sender(df)).select("chat_id", "sender", "avg_score")),
    "parsed_messages": over(exported_lines, exports.parse_lines),
    "parse_report": parse_quality,
    "run_modes": over(messages, training.run_modes, model_exists=False),
    "training_sample": of_training(lambda t: training.training_sample(t.scored)),
    "train_test_split": of_training(lambda t: sampling.split_train_test(t.sample).drop("cleaned_message")),
    "cross_validation_folds": of_training(lambda t: sampling.assign_folds(t.sample).drop("cleaned_message")),
    "model_vocabulary": rounded(of_training(lambda t: training.vocabulary(t.counts, t.runs)), "idf"),
    "tfidf_features": rounded(
        of_training(lambda t: training.features(t.counts, t.runs, t.vocabulary).drop("position")), "weight"
    ),
    "naive_bayes_weights": rounded(of_training(lambda t: t.weights), "weight"),
    "class_priors": rounded(of_training(lambda t: training.class_priors(t.runs)), "bias"),
    "naive_bayes_confusion": of_training(lambda t: t.confusion),
    "class_report": rounded(of_training(lambda t: t.report), "precision", "recall", "f1"),
    "run_scores": rounded(of_training(lambda t: training.run_scores(t.report)), "accuracy", "weighted_f1"),
    "cross_validation": of_training(lambda t: training.cross_validation(training.run_scores(t.report))),
    "regression_certificate": of_training(regression_certificate),
    "model_comparison": model_comparison,
    "saved_model": rounded(saved_model, "idf", "weight"),
    "predicted_messages": of_training(lambda t: t.predicted.select("chat_id", "msg_seq", "predicted_sentiment")),
    "agreement": of_training(lambda t: mood.agreement(stored(t.predicted, "predicted"))),
    "live_scores": of_training(live_scored),
    "live_stream": live_stream,
    "trend_stream": trend_of_stream,
    "late_stream": late_stream,
    "feature_summary": over(enriched, feature_summary),
    "hourly_feed": over(messages, outputs.hourly_feed),
    "weekday_feed": over(messages, outputs.weekday_feed),
    "sentiment_split_feed": over(scored, outputs.sentiment_split_feed),
    "sentiment_trend_feed": over(scored, outputs.trend_feed),
    "sender_split_feed": over(scored, outputs.sender_split_feed),
    "feed_ledger": of_training(feed_ledger),
    "detailed_results": of_training(lambda t: outputs.detailed_results(t.scored)),
    "written_report": of_training(lambda t: outputs.report(t.scored)),
    "report_lines": of_training(lambda t: outputs.report_lines(outputs.report(t.scored))),
    "dashboard": of_training(lambda t: outputs.dashboard(t.shown)),
}
