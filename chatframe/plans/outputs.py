"""Feeds for charts, dashboard, result pages and the written report."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatframe.operators import activity, mood, stats, terms
from chatframe.plans.analysis import Analysis, feature_summary
from chatframe.schema import NEGATIVE, NEUTRAL, POSITIVE
from chatframe.sources.models import metadata_rows


def _with_peak(counts: DataFrame, place: str) -> DataFrame:
    """Flag the bucket with most messages; chats have a fixed number of buckets."""
    chat = Window.partitionBy("chat_id").orderBy(F.desc("messages"), place)
    return counts.withColumn("is_peak", F.row_number().over(chat) == 1)


def hourly_feed(messages: DataFrame) -> DataFrame:
    return _with_peak(activity.hourly_activity(messages), "hour")


def weekday_feed(messages: DataFrame) -> DataFrame:
    return _with_peak(activity.weekday_activity(messages), "position")


def trend_feed(scored: DataFrame) -> DataFrame:
    """Weekly trend of chats with at least two points, with the sign of each."""
    points = mood.sentiment_over_time(scored, "W")
    enough = points.groupBy("chat_id").agg(F.count("*").alias("n")).filter("n >= 2")
    return points.join(enough.select("chat_id"), "chat_id").withColumn(
        "is_positive", F.col("avg_score") >= 0
    )


def sentiment_split_feed(scored: DataFrame) -> DataFrame:
    """Label split with the mood text and score of the chat."""
    moods = mood.overall_mood(scored).select("chat_id", "mood_description", "overall_score")
    return mood.label_distribution(scored).filter("messages > 0").join(moods, "chat_id")


def sender_split_feed(scored: DataFrame) -> DataFrame:
    return mood.sentiment_by_sender(scored).select(
        "chat_id", "sender", "positive_pct", "neutral_pct", "negative_pct"
    )


FEEDS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "word_cloud": terms.word_weights,
    "top_words": terms.top_words,
    "hourly_activity": hourly_feed,
    "weekday_activity": weekday_feed,
    "monthly_activity": activity.monthly_activity,
    "participation": stats.participation,
    "top_bigrams": terms.top_bigrams,
    "sentiment_split": sentiment_split_feed,
    "sentiment_trend": trend_feed,
    "sentiment_by_sender": sender_split_feed,
}


def chart_feeds(scored: DataFrame) -> dict[str, DataFrame]:
    """The data of the ten charts; each is its own lazy table."""
    return {name: build(scored) for name, build in FEEDS.items()}


def save_feeds(
    scored: DataFrame, path: str, feeds: dict[str, Callable[[DataFrame], DataFrame]] | None = None, at_once: int = 4
) -> DataFrame:
    """Write every feed below ``path``, ``at_once`` side by side; a feed that fails stops no other.

    A feed is written to ``feeds/<name>`` and then entered in the ledger, one row per feed:
    ``(feed, status, rows, error)``.  A feed that fails keeps the result of the run before, and its
    row says why.  Returns the ledger of this run.
    """
    spark = scored.sparkSession
    feeds = FEEDS if feeds is None else feeds
    run = uuid.uuid4().hex

    def write(name: str) -> tuple[str, str, int | None, str | None]:
        try:
            target = f"{path}/feeds/{name}/{run}"
            feeds[name](scored).write.parquet(target)
            return name, "ok", spark.read.parquet(target).count(), None
        except Exception as problem:  # whatever a feed does, the other nine are written
            return name, "failed", None, f"{type(problem).__name__}: {problem}".splitlines()[0]

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(write), feeds))
    ledger = spark.createDataFrame(
        [(run, time.time_ns(), *row) for row in rows], "run string, at long, feed string, status string, rows long, error string"
    )
    ledger.coalesce(1).write.mode("append").json(f"{path}/ledger")
    return ledger.drop("run", "at")


def read_feed(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The last result of a feed that was written without a failure."""
    schema = "run string, at long, feed string, status string, rows long, error string"
    done = spark.read.schema(schema).json(f"{path}/ledger").filter((F.col("feed") == name) & (F.col("status") == "ok"))
    last = done.orderBy(F.desc("at")).first()
    if last is None:
        raise FileNotFoundError(f"no feed {name} under {path}")
    return spark.read.parquet(f"{path}/feeds/{name}/{last['run']}")


# --- dashboard ----------------------------------------------------------------------


def _plain(df: DataFrame, column: str) -> Column:
    """A value as JSON shows it everywhere: fractions with four decimals, keys in the given order."""
    value = F.col(column)
    return value.cast("decimal(18,4)").alias(column) if dict(df.dtypes)[column] == "double" else value


def _one(df: DataFrame, section: str, order: str, *columns: str) -> DataFrame:
    """One JSON array per chat, for series whose length is fixed by definition."""
    fields = [order, *[c for c in columns if c != order]]
    rows = F.array_sort(F.collect_list(F.struct(*[_plain(df, c) for c in fields])))
    return df.groupBy("chat_id").agg(F.to_json(rows).alias("payload")).select(
        "chat_id", F.lit(section).alias("section"), F.lit("").alias("key"), "payload"
    )


def _each(df: DataFrame, section: str, key: str, *columns: str) -> DataFrame:
    """One JSON object per sender or period, for series that grow with the chat."""
    return df.select(
        "chat_id", F.lit(section).alias("section"), F.col(key).cast("string").alias("key"),
        F.to_json(F.struct(*[_plain(df, c) for c in columns])).alias("payload"),
    )


def dashboard(scored: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """``(chat_id, section, key, payload)``: every series of the dashboard as JSON.

    Series of fixed length are one document per chat; series with an entry per sender
    or week are one document per entry, so no chat has to fit one row.  Documents are
    canonical: equal tables give equal bytes.
    """
    keywords = (
        terms.sender_keywords(scored)
        .groupBy("chat_id", "sender")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
        .withColumn("terms", F.transform("k", lambda x: x["term"]))
    )
    parts = [
        _one(activity.hourly_activity(scored), "hourly", "hour", "messages"),
        _one(activity.weekday_activity(scored), "daily", "position", "day_name", "messages"),
        _one(activity.monthly_activity(scored), "monthly", "month", "month_name", "messages"),
        _one(terms.top_words(scored), "top_words", "rank", "word", "count"),
        _one(terms.top_bigrams(scored), "bigrams", "rank", "phrase", "count"),
        _one(terms.top_emojis(scored), "emojis", "rank", "emoji", "count"),
        _one(mood.label_distribution(scored), "sentiment_dist", "label", "share_pct"),
        _each(keywords, "tfidf", "sender", "terms"),
        _each(
            activity.reply_times(scored), "response_times", "sender", "avg_minutes", "avg_seconds"
        ),
        _each(stats.participation(scored), "user_msgs", "sender", "messages", "share_pct"),
        _each(
            stats.monthly_volume_by_sender(scored), "monthly_by_sender", "sender", "month",
            "month_name", "messages",
        ),
        _each(
            mood.sentiment_by_sender(scored), "sentiment_by_sender", "sender", "positive_pct",
            "neutral_pct", "negative_pct", "avg_score",
        ),
        _each(
            mood.sentiment_over_time(scored, "W"), "sentiment_trend", "date", "avg_score",
            "message_count",
        ),
    ]
    if metadata is not None:
        parts.append(
            metadata.select(
                F.lit("").alias("chat_id"), F.lit("model").alias("section"), F.lit("").alias("key"),
                F.to_json(F.struct(*metadata.columns)).alias("payload"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def detailed_results(scored: DataFrame) -> DataFrame:
    """One row per sender: statistics, reply time, sentiment and keywords."""
    keywords = (
        terms.sender_keywords(scored)
        .groupBy("chat_id", "sender")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("k"))
        .select(
            "chat_id", "sender",
            F.array_join(F.transform("k", lambda x: x["term"]), ", ").alias("keywords"),
        )
    )
    key = ["chat_id", "sender"]
    feelings = mood.sentiment_by_sender(scored).select(
        *key, POSITIVE, NEUTRAL, NEGATIVE, "positive_pct", "neutral_pct", "negative_pct", "avg_score"
    )
    return (
        stats.sender_stats(scored)
        .join(activity.reply_times(scored), key, "left")
        .join(feelings, key, "left")
        .join(keywords, key, "left")
    )


# --- report --------------------------------------------------------------------------


def _text(df: DataFrame, column: str) -> Column:
    """Values as text; fractions with four decimals in plain notation."""
    if dict(df.dtypes)[column] == "double":
        return F.col(column).cast("decimal(18,4)").cast("string")
    return F.col(column).cast("string")


def _section(df: DataFrame, section: str, key: str | None = None) -> DataFrame:
    """Columns of a summary table as ``(chat_id, section, key, value)`` rows.

    With ``key``, a table of one row per sender names its values ``sender.column``.
    """
    columns = [c for c in df.columns if c not in ("chat_id", key)]
    prefix = F.concat(F.col(key), F.lit(".")) if key else F.lit("")
    pairs = F.array(
        *[
            F.struct(F.concat(prefix, F.lit(c)).alias("key"), _text(df, c).alias("value"))
            for c in columns
        ]
    )
    return df.select("chat_id", F.lit(section).alias("section"), F.inline(pairs))


def report(scored: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """All summaries as one long table of text."""
    parts = [
        _section(stats.chat_summary(scored), "chat_summary"),
        _section(mood.overall_mood(scored), "overall_sentiment"),
        _section(mood.sentiment_by_sender(scored), "sentiment_by_sender", "sender"),
        _section(feature_summary(scored), "feature_summary"),
    ]
    if metadata is not None:
        parts.append(
            metadata_rows(metadata).select(
                F.lit("").alias("chat_id"), F.lit("model").alias("section"), "key", "value"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def report_lines(rows: DataFrame) -> DataFrame:
    """``(section, value)``: the report's rows as lines; names are padded, never cut."""

    def padded(name: str, width: int) -> Column:
        return F.when(F.char_length(name) < width, F.rpad(name, width, " ")).otherwise(F.col(name))

    line = F.concat(
        padded("chat_id", 20), F.lit("  "), padded("key", 35), F.lit(": "), F.coalesce("value", F.lit("–"))
    )
    return rows.select("section", line.alias("value"))


def save_report(analysis: Analysis, path: str) -> None:
    """Write the report as text lines, one folder per section."""
    rows = report(analysis.messages, analysis.model_metadata)
    report_lines(rows).write.mode("overwrite").partitionBy("section").text(path)


def save_dashboard(analysis: Analysis, path: str) -> None:
    """Write the dashboard documents as JSON lines, one folder per section."""
    dashboard(analysis.messages, analysis.model_metadata).write.mode("overwrite").partitionBy(
        "section"
    ).json(path)
