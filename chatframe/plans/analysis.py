"""The full analysis: many chats in, one set of lazy result tables out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.functions.lists import WordLists
from chatframe.operators import activity, mood, stats, terms
from chatframe.operators.enrich import DEFAULT_LISTS, enrich, message_table, score
from chatframe.operators.scoring import predict_messages
from chatframe.operators.training import (
    SAMPLES_PER_CLASS, ClassifierResult, run_modes, train_classifier, training_sample,
)
from chatframe.plans.store import stored
from chatframe.schema import MIN_MESSAGES_FOR_MODEL, require_columns
from chatframe.sources.models import load_model, model_exists, model_metadata, save_model

FEATURE_COLUMNS = (
    "cleaned_message", "sender", "hour", "day_name", "month_name", "date", "datetime",
    "is_media", "is_deleted", "emoji_count", "has_url", "word_count",
)


@dataclass
class Features:
    """Frequencies, statistics and activity of an enriched message table."""

    word_frequency: DataFrame
    bigrams: DataFrame
    trigrams: DataFrame
    vocabulary_totals: DataFrame
    sender_keywords: DataFrame
    sender_stats: DataFrame
    hourly: DataFrame
    weekday: DataFrame
    monthly: DataFrame
    daily: DataFrame
    reply_times: DataFrame


@dataclass
class Analysis:
    """Everything a report or a dashboard needs; the tables are lazy."""

    messages: DataFrame
    features: Features
    modes: DataFrame
    chat_summary: DataFrame
    feature_summary: DataFrame
    processing_stats: DataFrame
    overall_mood: DataFrame
    sentiment_by_sender: DataFrame
    sentiment_trend: DataFrame
    label_distribution: DataFrame
    top_emojis: DataFrame
    agreement: DataFrame
    model_metadata: DataFrame | None
    training: ClassifierResult | None
    training_error: str | None


def features(enriched: DataFrame) -> Features:
    require_columns(enriched, FEATURE_COLUMNS)
    words = terms.word_frequency(enriched)
    return Features(
        word_frequency=words,
        bigrams=terms.ngram_frequency(enriched, 2),
        trigrams=terms.ngram_frequency(enriched, 3),
        vocabulary_totals=terms.vocabulary_totals(words),
        sender_keywords=terms.sender_keywords(enriched),
        sender_stats=stats.sender_stats(enriched),
        hourly=activity.hourly_activity(enriched),
        weekday=activity.weekday_activity(enriched),
        monthly=activity.monthly_activity(enriched),
        daily=activity.daily_activity(enriched),
        reply_times=activity.reply_times(enriched),
    )


def feature_summary(enriched: DataFrame) -> DataFrame:
    """One row per chat: totals, peaks, top word and phrase, fastest responder."""
    # one pass: the messages are cleaned once for their words and phrases
    phrase = F.struct((-F.col("count")).alias("n"), F.concat_ws(" ", "word", "next_word").alias("phrase"))
    words = terms.pair_frequency(enriched).groupBy("chat_id", "word").agg(
        F.sum("count").alias("count"),
        F.min(F.when(F.col("next_word").isNotNull(), phrase)).alias("phrase"),
    )
    leaders = words.groupBy("chat_id").agg(
        F.sum("count").alias("total_words"),
        F.count("*").alias("unique_words"),
        stats.first_by("word", F.col("count")).alias("top_word"),
        F.min("phrase")["phrase"].alias("top_bigram"),
    )
    fastest = (
        activity.reply_times(enriched)
        .groupBy("chat_id")
        .agg(
            F.min_by("sender", F.struct("avg_minutes", "sender")).alias("fastest_responder"),
            F.min("avg_minutes").alias("fastest_resp_mins"),
        )
    )
    return (
        activity.peaks(enriched)
        .drop("peak_hour_messages")
        .join(leaders, "chat_id", "left")
        .join(fastest, "chat_id", "left")
        .select(
            "chat_id",
            F.coalesce("total_words", F.lit(0)).alias("total_words"),
            F.coalesce("unique_words", F.lit(0)).alias("unique_words"),
            "peak_hour", "most_active_day", "top_word", "top_bigram", "fastest_responder",
            "fastest_resp_mins",
        )
    )


def scored_messages(messages: DataFrame, lists: WordLists = DEFAULT_LISTS) -> DataFrame:
    """Bare messages to the scored message table; they are dealt by their key once."""
    return score(enrich(message_table(messages), lists, keep_key=True), lists)


def with_predictions(scored: DataFrame, model, modes: DataFrame) -> DataFrame:
    """Model labels, except for chats too small for a model, which keep the lexicon's."""
    if model is None:
        return predict_messages(scored, None)
    small = modes.select("chat_id", (F.col("mode") == "NO_ML").alias("_small"))
    predicted = predict_messages(scored.join(small, "chat_id"), model)
    return predicted.withColumn(
        "predicted_sentiment",
        F.when(F.col("_small"), F.col("sentiment_label")).otherwise(F.col("predicted_sentiment")),
    ).drop("_small")


def analyze(
    messages: DataFrame,
    *,
    model_path: str | None = None,
    force_retrain: bool = False,
    samples_per_class: int = SAMPLES_PER_CLASS,
    min_messages: int = MIN_MESSAGES_FOR_MODEL,
    lists: WordLists = DEFAULT_LISTS,
) -> Analysis:
    """Analyse ``(chat_id, msg_seq, datetime, sender, message)``.

    The scored messages are stored once, as some fifteen results read them.  One model
    serves all chats: it is trained when none is saved under ``model_path`` or when
    forced, on the messages of the chats that are large enough.  A training that fails
    leaves the lexicon labels in place and its reason in ``training_error``.
    """
    spark = messages.sparkSession
    scored = stored(scored_messages(messages, lists), "scored")
    saved = model_exists(spark, model_path)
    modes = stored(run_modes(scored, model_exists=saved, force=force_retrain, min_messages=min_messages), "modes")
    training = error = model = None
    if modes.filter("mode = 'FULL'").limit(1).count():
        try:
            large = scored.join(modes.filter("mode <> 'NO_ML'").select("chat_id"), "chat_id", "left_semi")
            sample = training_sample(large, samples_per_class)
            training = train_classifier(sample)
            model = training.model
            if model_path is not None:
                save_model(spark, training, model_path)
        except ValueError as problem:
            error = str(problem)
    elif saved:
        model = load_model(spark, model_path)
    full = with_predictions(scored, model, modes)
    if model is not None:
        full = stored(full, "predicted")
    return Analysis(
        messages=full,
        features=features(full),
        modes=modes,
        chat_summary=stats.chat_summary(full),
        feature_summary=feature_summary(full),
        processing_stats=stats.processing_stats(full),
        overall_mood=mood.overall_mood(full),
        sentiment_by_sender=mood.sentiment_by_sender(full),
        sentiment_trend=mood.sentiment_over_time(full, "W"),
        label_distribution=mood.label_distribution(full),
        top_emojis=terms.top_emojis(full),
        agreement=mood.agreement(full),
        model_metadata=model_metadata(spark, model_path)
        if model_path is not None and model is not None
        else None,
        training=training,
        training_error=error,
    )

