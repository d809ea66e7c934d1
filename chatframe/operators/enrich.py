"""From bare messages to the enriched and scored message table.

Flags and lengths are projections, and so is scoring with short lists, with the cleaning on the
way to it.  With longer lists or tables both join the words of the messages with them
(:mod:`chatframe.operators.occurrences`) and share one dealing of the messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.functions import lexicon as lx
from chatframe.functions import text as tx
from chatframe.functions.lists import WordLists, value_of
from chatframe.operators.occurrences import KEY, clean, keyed, rule_hits, subjective_terms, with_subjective
from chatframe.schema import (
    BASE_COLUMNS, MESSAGE_COLUMNS, MONTHS, NEUTRAL, WEEKDAYS, require_columns,
)

DEFAULT_LISTS = WordLists()


def is_text() -> Column:
    """Predicate shared by all text statistics: neither media nor deleted."""
    return ~F.col("is_media") & ~F.col("is_deleted")


def has_cleaned_text() -> Column:
    return F.ltrim("cleaned_message") != ""


def message_table(messages: DataFrame) -> DataFrame:
    """Add type flags, calendar parts and lengths to ``(chat_id, msg_seq, datetime,
    sender, message)``."""
    require_columns(messages, BASE_COLUMNS)
    message, when = F.col("message"), F.col("datetime")
    flagged = messages.select(
        *BASE_COLUMNS,
        tx.is_media(message).alias("is_media"),
        tx.is_deleted(message).alias("is_deleted"),
    )
    counted = F.col("is_media")
    return flagged.withColumns(
        {
            "date": F.to_date(when),
            "time": F.substring(when.cast("string"), 12, 8),
            "year": F.year(when),
            "month": F.month(when),
            "month_name": F.get(F.lit(list(MONTHS)), F.month(when) - 1),
            "day": F.dayofmonth(when),
            "day_name": F.get(F.lit(list(WEEKDAYS)), F.weekday(when)),
            "hour": F.hour(when),
            "word_count": F.when(counted, 0).otherwise(tx.word_count(message)),
            "char_count": F.when(counted, 0).otherwise(F.char_length(message)),
        }
    ).select(*MESSAGE_COLUMNS)


def enrich(
    messages: DataFrame,
    lists: WordLists = DEFAULT_LISTS,
    *,
    emoji: str = "runs",
    count_short: bool = False,
    keep_key: bool = False,
) -> DataFrame:
    """Add ``emoji_list, emoji_count, has_url, cleaned_message``.

    ``emoji="single"`` counts every emoji by itself; ``count_short=True`` also reads
    emoji from messages of one or two characters.  ``keep_key=True`` is for rows on their way to
    :func:`score`: short lists are looked up inside the row, and with others the key by which
    the rows are dealt and what the subjectivity list says about their words are left, so that
    they are neither dealt nor cleaned again.
    """
    if emoji not in ("runs", "single"):
        raise ValueError("emoji must be 'runs' or 'single'")
    require_columns(messages, ("message",))
    message = F.col("message")
    skipped = F.col("_skippable")
    found = tx.emoji_runs(message, single=emoji == "single")
    unread = (skipped & (F.char_length(message) > 2)) if count_short else skipped
    enriched = (
        clean(
            messages.withColumn("_skippable", tx.is_skippable(message)), "message", lists, skipped,
            subjective=keep_key, in_row=keep_key,
        )
        .withColumns(
            {
                "emoji_list": F.when(unread | message.isNull(), F.array().cast("array<string>"))
                .otherwise(found),
                "has_url": ~skipped & tx.has_url(message),
                "cleaned_message": F.coalesce(F.array_join("_words", " "), F.lit("")),
            }
        )
        .withColumn("emoji_count", F.size("emoji_list"))
        .drop("_skippable", "_words")
    )
    columns = [*messages.columns, "emoji_list", "has_url", "cleaned_message", "emoji_count"]
    kept = [c for c in (*KEY, "_subjective") if keep_key and c in enriched.columns]
    return enriched.select(*columns, *kept)


def _with_list_values(scored: DataFrame, lists: WordLists) -> DataFrame:
    """Add ``_values`` and ``_n_tokens`` of the rules and ``_terms`` of the subjectivity list."""
    read = F.when(is_text() & has_cleaned_text(), tx.words_of(F.col("cleaned_message")))
    none, no_terms = F.array().cast("array<double>"), F.array().cast("array<struct<polarity:double,subjectivity:double>>")
    # Without a scored word only this matters: whether there is a word of two characters.
    long_word = F.col("message").rlike(tx.LONG_WORD).cast("int")
    if lists.short("valence", "boosters", "negations", "idioms"):
        rules = lx.with_rule_values(scored.withColumn("_tokens", F.when(F.col("_scored"), lx.rule_tokens(F.col("message")))), lists)
        n_tokens = F.size("_tokens")
    else:
        scored = keyed(scored, "message")
        rules = scored.join(rule_hits(scored.filter("_scored"), "message", lists), KEY, "left")
        n_tokens = F.coalesce("_n_tokens", long_word)
    rules = rules.withColumns({"_n_tokens": n_tokens, "_values": F.coalesce("_values", none)})
    if lists.short("subjectivity"):
        of_list = {w: dict(zip(("polarity", "subjectivity", "intensity"), map(float, v))) for w, v in lists.subjectivity.items()}
        kind = "struct<polarity:double,subjectivity:double,intensity:double>"
        entries = F.transform("_read", lambda w: value_of(w, of_list, kind))
    else:
        if "_subjective" not in rules.columns:
            rules = with_subjective(keyed(rules, "message"), "cleaned_message", lists, is_text() & has_cleaned_text())
        known = F.col("_subjective")
        entries = F.when(F.size(known) > 0, F.transform("_read", lambda w: known[w]))
    staged = rules.withColumn("_read", read).withColumn("_entries", entries)
    return staged.withColumn("_terms", F.coalesce(subjective_terms(F.col("_read"), F.col("_entries")), no_terms))


def score(messages: DataFrame, lists: WordLists = DEFAULT_LISTS) -> DataFrame:
    """Add the seven sentiment columns; media and deleted rows get neutral defaults."""
    require_columns(
        messages, ("message", "cleaned_message", "sender", "date", "is_media", "is_deleted")
    )
    scored_text = F.col("_scored")
    scored = messages.withColumn("_scored", is_text() & F.col("message").rlike(tx.WORD))
    staged = _with_list_values(scored, lists).withColumn(
        "_emphasis", F.when(F.size("_values") > 0, lx.emphasis(F.col("message"))).otherwise(0.0)
    )
    staged = lx.with_rule_score(staged).withColumns(
        {
            "sentiment_score": F.when(scored_text, F.col("_compound")).otherwise(0.0),
            "_polarity": F.coalesce(lx.mean_of(F.col("_terms"), "polarity"), F.lit(0.0)),
            "subjectivity": F.coalesce(lx.mean_of(F.col("_terms"), "subjectivity"), F.lit(0.0)),
            "vader_pos": F.when(scored_text, F.col("_pos")).otherwise(0.0),
            "vader_neg": F.when(scored_text, F.col("_neg")).otherwise(0.0),
            "vader_neu": F.when(scored_text, F.col("_neu")).otherwise(1.0),
        }
    )
    value = F.col("sentiment_score")
    return staged.withColumns(
        {
            "sentiment_label": F.when(is_text(), lx.label_of(value)).otherwise(NEUTRAL),
            "sentiment_confidence": F.when(
                is_text(), lx.confidence_of(value, F.col("_polarity"))
            ).otherwise("Low"),
        }
    ).select(
        *[c for c in messages.columns if c not in (*KEY, "_subjective")],
        "sentiment_label", "sentiment_score", "subjectivity", "sentiment_confidence",
        "vader_pos", "vader_neg", "vader_neu",
    )
