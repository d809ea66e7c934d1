"""Sentiment aggregates over a scored message table.

Scores carry four decimals, so sums are taken as decimals: the result does not
depend on the order in which tasks finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.functions.lexicon import label_of, mood_of
from chatframe.functions.text import round_half_even
from chatframe.operators.enrich import has_cleaned_text, is_text
from chatframe.schema import LABELS, NEGATIVE, NEUTRAL, POSITIVE, require_columns


def score_sum(condition: Column | None = None) -> Column:
    exact = F.col("sentiment_score").cast("decimal(18,4)")
    return F.sum(exact if condition is None else F.when(condition, exact))


def mean(total: Column, n: Column) -> Column:
    return total.cast("double") / n


def percent(part: Column, whole: Column) -> Column:
    return round_half_even(part / whole * 100, 1)


def sentiment_by_sender(scored: DataFrame) -> DataFrame:
    """Label counts, shares and mean score per sender; :func:`by_mood` puts them in order."""
    require_columns(scored, ("sentiment_label", "sentiment_score"))
    label, total = F.col("sentiment_label"), F.col("total")
    return (
        scored.filter(is_text())
        .groupBy("chat_id", "sender")
        .agg(
            *[F.count_if(label == name).alias(name) for name in (POSITIVE, NEGATIVE, NEUTRAL)],
            F.count("*").alias("total"),
            score_sum().alias("_sum"),
        )
        .select(
            "chat_id", "sender", POSITIVE, NEGATIVE, NEUTRAL, "total",
            percent(F.col(POSITIVE), total).alias("positive_pct"),
            percent(F.col(NEGATIVE), total).alias("negative_pct"),
            percent(F.col(NEUTRAL), total).alias("neutral_pct"),
            round_half_even(mean(F.col("_sum"), total), 4).alias("avg_score"),
        )
    )


def by_mood(senders: DataFrame) -> DataFrame:
    """The most positive senders first within their chat, for a sink that shows them in order."""
    return senders.orderBy("chat_id", F.desc("avg_score"), "sender")


def sentiment_over_time(scored: DataFrame, freq: str = "W") -> DataFrame:
    """Mean score and messages per day, week or month.

    Weeks run Monday to Sunday and carry the date of their Sunday; months carry
    their last day.  Periods without messages do not occur.
    """
    periods = {
        "D": F.col("date"),
        "W": F.date_add(F.col("date"), 6 - F.weekday("date")),
        "M": F.last_day("date"),
    }
    if freq not in periods:
        raise ValueError("freq must be 'D', 'W' or 'M'")
    return (
        scored.filter(is_text())
        .groupBy("chat_id", periods[freq].alias("period"))
        .agg(score_sum().alias("_sum"), F.count("*").alias("message_count"))
        .select(
            "chat_id", F.col("period").alias("date"),
            round_half_even(mean(F.col("_sum"), F.col("message_count")), 4).alias("avg_score"),
            "message_count",
        )
    )


def overall_mood(scored: DataFrame) -> DataFrame:
    """One row per chat; a chat without text messages is Neutral with score 0."""
    label = F.col("sentiment_label")
    cells = scored.groupBy("chat_id", "sender", "day_name").agg(
        F.count_if(is_text()).alias("n"),
        score_sum(is_text()).alias("s"),
        *[F.count_if(is_text() & (label == name)).alias(name) for name in LABELS],
        F.count_if(is_text() & (F.col("sentiment_confidence") == "High")).alias("high"),
    )
    # one pass over the small cells gives chat, sender and weekday totals
    key, sums = F.grouping_id(), [F.sum(c).alias(c) for c in ("n", "s", *LABELS, "high")]
    levels = cells.groupingSets(
        [["chat_id"], ["chat_id", "sender"], ["chat_id", "day_name"]],
        "chat_id", "sender", "day_name",
    ).agg(key.alias("level"), *sums)
    whole, sender, day = (F.col("level") == v for v in (3, 1, 2))
    m = mean(F.col("s"), F.col("n"))

    def total(name: str, alias: str) -> Column:
        return F.max(F.when(whole, F.col(name))).alias(alias)

    def extreme(level: Column, name: str, value: Column) -> Column:
        return F.min_by(name, F.when(level & (F.col("n") > 0), F.struct(value.alias("v"), name)))

    totals = levels.groupBy("chat_id").agg(
        total("n", "total_analysed"), total("s", "s"),
        *[total(name, name) for name in LABELS], total("high", "high_confidence"),
        extreme(sender, "sender", -m).alias("most_positive_user"),
        extreme(sender, "sender", m).alias("most_negative_user"),
        extreme(day, "day_name", -m).alias("happiest_day"),
    )
    n = F.col("total_analysed")
    average = F.when(n > 0, round_half_even(mean(F.col("s"), n), 4)).otherwise(0.0)

    def pct(name: str) -> Column:
        return F.when(n > 0, percent(F.col(name), n))

    return totals.withColumn("overall_score", average).select(
        "chat_id",
        label_of(F.col("overall_score")).alias("overall_label"),
        "overall_score",
        pct(POSITIVE).alias("positive_pct"),
        pct(NEGATIVE).alias("negative_pct"),
        pct(NEUTRAL).alias("neutral_pct"),
        "most_positive_user", "most_negative_user", "happiest_day",
        F.when(n > 0, mood_of(F.col("overall_score"))).alias("mood_description"),
        "total_analysed", "high_confidence",
    )


def label_distribution(scored: DataFrame, *, text_only: bool = True) -> DataFrame:
    """Messages per label and their share; the three labels always occur."""
    rows = scored.filter(is_text()) if text_only else scored
    label = F.col("sentiment_label")
    cells = F.array(
        *[F.struct(F.lit(x).alias("label"), F.col(x).alias("messages")) for x in LABELS]
    )
    return (
        rows.groupBy("chat_id")
        .agg(
            *[F.count_if(label == name).alias(name) for name in LABELS],
            F.count("*").alias("total"),
        )
        .select("chat_id", "total", F.inline(cells))
        .select(
            "chat_id", "label", "messages",
            percent(F.col("messages"), F.col("total")).alias("share_pct"),
        )
    )


def agreement(predicted: DataFrame) -> DataFrame:
    """Agreement of lexicon and model labels in percent, one decimal.

    ``agreement_scored_pct`` is taken among the rows the model scored,
    ``agreement_all_pct`` has every message in its denominator.
    """
    same = F.col("sentiment_label") == F.col("predicted_sentiment")
    scored = is_text() & has_cleaned_text()
    return (
        predicted.groupBy("chat_id")
        .agg(
            F.count("*").alias("messages"),
            F.count_if(scored).alias("scored_messages"),
            F.count_if(scored & same).alias("_same_scored"),
            F.count_if(is_text() & same).alias("_same_text"),
        )
        .select(
            "chat_id", "messages", "scored_messages",
            F.when(
                F.col("scored_messages") > 0, percent(F.col("_same_scored"), F.col("scored_messages"))
            ).alias("agreement_scored_pct"),
            percent(F.col("_same_text"), F.col("messages")).alias("agreement_all_pct"),
        )
    )
