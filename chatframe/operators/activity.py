"""When messages are sent, and how fast senders reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatframe.functions.text import round_half_even
from chatframe.operators.stats import first_by
from chatframe.schema import MAX_REPLY_SECONDS, MONTHS, WEEKDAYS, require_columns


def _counts_over_domain(messages: DataFrame, column: str, domain: list, name: str) -> DataFrame:
    """Messages per value of a small fixed domain, zeros included.

    One row of counters per chat leaves each task, whatever the size of the chat.
    """
    counters = [F.count_if(F.col(column) == v).alias(f"_{i}") for i, v in enumerate(domain)]
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(v).alias(name), F.col(f"_{i}").alias("messages"))
            for i, v in enumerate(domain)
        ]
    )
    return (
        messages.groupBy("chat_id")
        .agg(*counters)
        .select("chat_id", F.explode(pairs).alias("p"))
        .select("chat_id", "p.position", f"p.{name}", "p.messages")
    )


def hourly_activity(messages: DataFrame) -> DataFrame:
    """24 rows per chat."""
    return _counts_over_domain(messages, "hour", list(range(24)), "hour").drop("position")


def weekday_activity(messages: DataFrame) -> DataFrame:
    """Seven rows per chat; ``position`` 0 is Monday."""
    return _counts_over_domain(messages, "day_name", list(WEEKDAYS), "day_name")


def monthly_activity(messages: DataFrame, *, by_year: bool = False) -> DataFrame:
    """Messages per month, months without messages dropped.

    Years are merged unless ``by_year``.
    """
    if by_year:
        return messages.groupBy("chat_id", "year", "month", "month_name").agg(
            F.count("*").alias("messages")
        )
    return (
        _counts_over_domain(messages, "month_name", list(MONTHS), "month_name")
        .filter(F.col("messages") > 0)
        .withColumn("month", F.col("position") + 1)
        .drop("position")
    )


def daily_activity(messages: DataFrame) -> DataFrame:
    """Messages per calendar date, only dates that occur."""
    return messages.groupBy("chat_id", "date").agg(F.count("*").alias("messages"))


def peaks(messages: DataFrame) -> DataFrame:
    """Peak hour and busiest weekday per chat; the earliest on a tie."""
    hours = hourly_activity(messages)
    peak_hour = hours.groupBy("chat_id").agg(
        first_by("hour", F.col("messages")).alias("peak_hour"),
        F.max("messages").alias("peak_hour_messages"),
    )
    days = weekday_activity(messages)
    busiest = days.groupBy("chat_id").agg(
        F.min_by("day_name", F.struct(-F.col("messages"), "position")).alias("most_active_day")
    )
    return peak_hour.join(busiest, "chat_id")


def _micros() -> Column:
    """Microseconds of a wall clock since the epoch; the session time zone plays no part."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = (F.col("datetime") - epoch).cast("interval second").cast("decimal(18,6)")
    return (seconds * 1_000_000).cast("long")


def _replies(messages: DataFrame) -> DataFrame:
    """``(chat_id, msg_seq, sender, previous_sender, gap)``; gap in microseconds.

    As a gap of zero never counts, only the first and the last sender of every distinct
    timestamp matter.  The rows are reduced to those before anything is ordered; the
    order is then taken within one chat and minute, the last moment before a minute is
    carried over, and the minutes of a chat are ordered within a day, the last minute
    before a day carried over in turn.  So no task sorts a whole chat.
    """
    require_columns(messages, ("chat_id", "msg_seq", "datetime", "sender"))
    moments = (
        messages.groupBy("chat_id", "datetime")
        .agg(
            F.min(F.struct("msg_seq", "sender")).alias("first"),
            F.max(F.struct("msg_seq", "sender")).alias("last"),
        )
        .select("chat_id", _micros().alias("at"), "first", F.col("last.sender").alias("last_sender"))
        .withColumns({"minute": F.floor(F.col("at") / 60e6), "day": F.floor(F.col("at") / 86_400e6)})
    )

    def carried(df: DataFrame, period: str, *within: str) -> DataFrame:
        """The last moment before each period, for the head of the period."""
        order = Window.partitionBy("chat_id", *within).orderBy(period)
        return (
            df.withColumn("end", F.lag("end").over(order))
            .filter(F.col("end").isNotNull())
            .select("chat_id", *within, period, F.col("end.at").alias("at"), F.col("end.last_sender").alias("last_sender"))
        )

    end = F.max(F.struct("at", "last_sender")).alias("end")
    minute_ends = moments.groupBy("chat_id", "day", "minute").agg(end)
    day_ends = minute_ends.groupBy("chat_id", "day").agg(F.max("end").alias("end"))
    first_minutes = minute_ends.groupBy("chat_id", "day").agg(F.min("minute").alias("minute"))
    overnight = carried(day_ends, "day").join(first_minutes, ["chat_id", "day"])
    heads = carried(minute_ends, "minute", "day").unionByName(overnight)
    nobody = F.lit(None).cast("struct<msg_seq:bigint,sender:string>").alias("first")
    in_minute = Window.partitionBy("chat_id", "minute").orderBy("at")
    return (
        moments.unionByName(heads.select("chat_id", "at", nobody, "last_sender", "minute", "day"))
        .select(
            "chat_id", "first", F.lag("last_sender").over(in_minute).alias("previous_sender"),
            (F.col("at") - F.lag("at").over(in_minute)).alias("gap"),
        )
        .filter(F.col("first").isNotNull())
        .select("chat_id", "first.msg_seq", "first.sender", "previous_sender", "gap")
        .filter(
            (F.col("sender") != F.col("previous_sender"))
            & (F.col("gap") > 0) & (F.col("gap") <= MAX_REPLY_SECONDS * 1_000_000)
        )
    )


def reply_gaps(messages: DataFrame) -> DataFrame:
    """Messages that answer another sender, with the gap in seconds, exact to the microsecond.

    A message is a reply when the message before it in the chat, ordered by
    ``(datetime, msg_seq)``, has another sender and lies more than zero and at most
    twelve hours back.
    """
    return _replies(messages).withColumn("gap_seconds", F.col("gap") / 1e6).drop("gap")


def reply_times(messages: DataFrame) -> DataFrame:
    """Mean reply time per sender, in minutes (two decimals) and in seconds."""
    mean = F.col("_gaps") / F.col("n_replies")
    return (
        _replies(messages)
        .groupBy("chat_id", "sender")
        .agg(F.sum("gap").alias("_gaps"), F.count("*").alias("n_replies"))
        .select(
            "chat_id", "sender", "n_replies",
            round_half_even(mean / 6e7, 2).alias("avg_minutes"),
            round_half_even(mean / 1e6, 2).alias("avg_seconds"),
        )
    )
