"""Per-chat and per-sender statistics.

Each function aggregates once at the finest level it needs (with map-side partial
aggregation) and rolls the small result up, so a chat that holds a large part of
all rows never has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.functions.text import round_half_even, words_of
from chatframe.operators.enrich import is_text
from chatframe.schema import require_columns


def first_by(name: str, amount: Column) -> Column:
    """Aggregate: the ``name`` with the largest amount; the smaller name on a tie."""
    return F.min_by(name, F.struct(-amount, F.col(name)))


def ratio(part: Column, whole: Column, digits: int, scale: float | None = None) -> Column:
    value = part / whole
    return round_half_even(value * scale if scale else value, digits)


def chat_summary(messages: DataFrame) -> DataFrame:
    """One row per chat: totals, date range, words, most active sender."""
    require_columns(messages, ("chat_id", "sender", "date", "is_media", "is_deleted", "word_count"))
    per_sender = messages.groupBy("chat_id", "sender").agg(
        F.count("*").alias("n"),
        F.count_if(is_text()).alias("text"),
        F.count_if("is_media").alias("media"),
        F.count_if("is_deleted").alias("deleted"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        F.sum("word_count").alias("words"),
        F.sum(F.when(is_text(), F.col("word_count"))).alias("text_words"),
    )
    return (
        per_sender.groupBy("chat_id")
        .agg(
            F.sum("n").alias("total_messages"),
            F.sum("text").alias("total_text_msgs"),
            F.sum("media").alias("total_media_msgs"),
            F.sum("deleted").alias("total_deleted"),
            F.count("*").alias("total_senders"),
            F.min("first").alias("date_start"),
            F.max("last").alias("date_end"),
            F.sum("words").alias("total_words"),
            F.sum("text_words").alias("_text_words"),
            first_by("sender", F.col("n")).alias("most_active_user"),
        )
        .select(
            "chat_id", "total_messages", "total_text_msgs", "total_media_msgs", "total_deleted",
            "total_senders", "date_start", "date_end",
            F.date_diff("date_end", "date_start").alias("total_days"),
            "total_words",
            F.when(
                F.col("total_text_msgs") > 0,
                ratio(F.col("_text_words"), F.col("total_text_msgs"), 2),
            ).alias("avg_words_per_msg"),
            "most_active_user",
        )
    )


def chat_senders(messages: DataFrame) -> DataFrame:
    """Senders of each chat with their first message; sort by it for first-seen order."""
    first = F.min(F.struct("datetime", "msg_seq")).alias("first")
    return (
        messages.groupBy("chat_id", "sender")
        .agg(first)
        .select(
            "chat_id", "sender",
            F.col("first.datetime").alias("first_datetime"),
            F.col("first.msg_seq").alias("first_msg_seq"),
        )
    )


def processing_stats(enriched: DataFrame) -> DataFrame:
    """What cleaning found: processable messages, emoji, URLs, distinct words."""
    words = words_of(F.col("cleaned_message"))
    # next to its words, each message gives one row without a word that carries its counts
    counted = enriched.select("chat_id", "emoji_count", "has_url", words.alias("_words")).select(
        "chat_id", "emoji_count", "has_url", F.size("_words").alias("_n"),
        # outer: else Spark filters by the size of the list before, and cleans every message twice
        F.explode_outer(F.array_append("_words", F.lit(None).cast("string"))).alias("word"),
    )
    message = F.col("word").isNull()
    per_word = counted.groupBy("chat_id", "word").agg(
        F.count_if(message).alias("messages"),
        F.count_if(message & (F.col("_n") > 0)).alias("processable"),
        F.count_if(message & (F.col("emoji_count") > 0)).alias("with_emoji"),
        F.sum(F.when(message, F.col("emoji_count").cast("long")).otherwise(0)).alias("emojis"),
        F.count_if(message & F.col("has_url")).alias("with_url"),
        F.sum(F.when(message, F.col("_n").cast("long")).otherwise(0)).alias("words"),
    )
    totals = per_word.groupBy("chat_id").agg(
        F.sum("messages").alias("total_messages"),
        F.sum("processable").alias("processable_messages"),
        F.sum("with_emoji").alias("messages_with_emoji"),
        F.sum("emojis").alias("total_emojis"),
        F.sum("with_url").alias("messages_with_url"),
        F.count("word").alias("unique_words"),
        F.sum("words").alias("_words"),
    )
    return totals.select(
        "chat_id", "total_messages", "processable_messages", "messages_with_emoji",
        "total_emojis", "messages_with_url", "unique_words",
        F.when(
            F.col("processable_messages") > 0,
            ratio(F.col("_words"), F.col("processable_messages"), 2),
        ).alias("avg_words_after_clean"),
    )


def sender_stats(enriched: DataFrame) -> DataFrame:
    """Twelve columns per sender; :func:`by_volume` puts them in order."""
    per_hour = enriched.groupBy("chat_id", "sender", "hour").agg(
        F.count("*").alias("n"),
        F.count_if(is_text()).alias("text"),
        F.count_if("is_media").alias("media"),
        F.count_if("is_deleted").alias("deleted"),
        F.sum(F.col("word_count").cast("long")).alias("words"),
        F.sum(F.when(is_text(), F.col("word_count").cast("long"))).alias("text_words"),
        F.sum(F.col("emoji_count").cast("long")).alias("emojis"),
        F.count_if("has_url").alias("urls"),
    )
    per_sender = per_hour.groupBy("chat_id", "sender").agg(
        F.sum("n").alias("total_messages"),
        F.sum("text").alias("text_messages"),
        F.sum("media").alias("media_messages"),
        F.sum("deleted").alias("deleted_messages"),
        F.sum("words").alias("total_words"),
        F.sum("text_words").alias("_text_words"),
        F.sum("emojis").alias("total_emojis"),
        F.sum("urls").alias("urls_shared"),
        first_by("hour", F.col("n")).alias("most_active_hour"),
    )
    # counted from the messages: this reads one column and no text
    chats = enriched.groupBy("chat_id").agg(F.count("*").alias("_chat_total"))
    total = F.col("total_messages")
    return per_sender.join(chats, "chat_id").select(
        "chat_id", "sender", "total_messages", "text_messages", "media_messages",
        "deleted_messages", "total_words",
        F.when(
            F.col("text_messages") > 0,
            ratio(F.col("_text_words"), F.col("text_messages"), 2),
        )
        .otherwise(0.0)
        .alias("avg_words_per_msg"),
        "total_emojis",
        ratio(F.col("total_emojis"), total, 2).alias("avg_emojis_per_msg"),
        "urls_shared",
        ratio(total, F.col("_chat_total"), 2, 100.0).alias("message_share_pct"),
        "most_active_hour",
    )


def by_volume(senders: DataFrame) -> DataFrame:
    """Busiest senders first within their chat, for a sink that shows them in order."""
    return senders.orderBy("chat_id", F.desc("total_messages"), "sender")


def participation(messages: DataFrame) -> DataFrame:
    """Messages and share (one decimal) per sender, with the total of the chat."""
    per_sender = messages.groupBy("chat_id", "sender").agg(F.count("*").alias("messages"))
    chats = per_sender.groupBy("chat_id").agg(F.sum("messages").alias("chat_messages"))
    return per_sender.join(chats, "chat_id").select(
        "chat_id", "sender", "messages", "chat_messages",
        ratio(F.col("messages"), F.col("chat_messages"), 1, 100.0).alias("share_pct"),
    )


def monthly_volume_by_sender(messages: DataFrame, *, estimate: bool = False) -> DataFrame:
    """Messages per month name (years merged) and sender.

    The default counts.  ``estimate=True`` shares every month total out by the
    senders' overall volumes, with the chat total plus one as the denominator, as
    the dashboard of old did.
    """
    counted = messages.groupBy("chat_id", "month", "month_name", "sender").agg(
        F.count("*").alias("messages")
    )
    if not estimate:
        return counted
    months = counted.groupBy("chat_id", "month", "month_name").agg(
        F.sum("messages").alias("_month_total")
    )
    senders = counted.groupBy("chat_id", "sender").agg(F.sum("messages").alias("_sender_total"))
    chats = counted.groupBy("chat_id").agg(F.sum("messages").alias("_chat_total"))
    # months of a chat are at most twelve rows, so this equi-join grows the senders
    # by a constant factor only
    return (
        senders.join(chats, "chat_id")
        .join(months, "chat_id")
        .select(
            "chat_id", "month", "month_name", "sender",
            F.floor(
                F.col("_month_total") * F.col("_sender_total") / (F.col("_chat_total") + 1) + 0.5
            ).alias("messages"),
        )
    )
