"""Words, phrases and emoji: frequencies, top lists, keywords per sender.

Messages without text need no filter here: their word list is empty and gives one row without
a word, which is dropped.  A filter on ``cleaned_message`` would be pushed below the cleaning and
make every message be cleaned twice, as would the one Spark adds to ``explode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatframe.functions.text import ngrams_of, round_half_even, words_of
from chatframe.operators.topn import top_rows


def _exploded(df: DataFrame, entries: Column, name: str, *kept: str) -> DataFrame:
    """One row for each entry of a list, next to the columns ``kept``."""
    return df.select(*kept, F.explode_outer(entries).alias(name)).filter(F.col(name).isNotNull())


def word_frequency(enriched: DataFrame) -> DataFrame:
    """``(chat_id, word, count)`` over all cleaned messages."""
    return (
        _exploded(enriched, words_of(F.col("cleaned_message")), "word", "chat_id")
        .groupBy("chat_id", "word")
        .agg(F.count("*").alias("count"))
    )


def vocabulary_totals(frequency: DataFrame) -> DataFrame:
    """Total and distinct words per chat, from :func:`word_frequency`."""
    return frequency.groupBy("chat_id").agg(
        F.sum("count").alias("total_words"), F.count("*").alias("unique_words")
    )


def ngram_frequency(enriched: DataFrame, n: int) -> DataFrame:
    """``(chat_id, phrase, count)`` of ``n`` neighbouring words of one message."""
    if n < 1:
        raise ValueError("n must be at least 1")
    words = words_of(F.col("cleaned_message"))
    return (
        _exploded(enriched.select("chat_id", words.alias("words")), ngrams_of(F.col("words"), n), "phrase", "chat_id")
        .groupBy("chat_id", "phrase")
        .agg(F.count("*").alias("count"))
    )


def pair_frequency(enriched: DataFrame) -> DataFrame:
    """``(chat_id, word, next_word, count)``: every word with the one behind it, the last with NULL.

    So the counts of a word add up to its :func:`word_frequency`, and rows with a next word
    are the phrases of two words.
    """
    words = F.col("words")
    pairs = F.arrays_zip(words.alias("word"), F.slice(words, 2, F.size(words)).alias("next_word"))
    return (
        enriched.select("chat_id", words_of(F.col("cleaned_message")).alias("words"))
        # outer: else Spark filters by the size of the list before, and makes it twice
        .select("chat_id", F.inline_outer(pairs).alias("word", "next_word"))
        .filter("word IS NOT NULL")
        .groupBy("chat_id", "word", "next_word")
        .agg(F.count("*").alias("count"))
    )


def emoji_frequency(enriched: DataFrame) -> DataFrame:
    return (
        _exploded(enriched, F.col("emoji_list"), "emoji", "chat_id")
        .groupBy("chat_id", "emoji")
        .agg(F.count("*").alias("count"))
    )


def top_terms(frequency: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent entries per chat; the smaller text first on a tie.

    The rank filter reaches the shuffle as a per-task limit, so at most ``n`` rows
    per chat and task are exchanged.
    """
    term = [c for c in frequency.columns if c not in ("chat_id", "count")][0]
    return top_rows(frequency, ["chat_id"], [F.desc("count"), F.col(term)], n, key=term)


def top_words(enriched: DataFrame, n: int = 20) -> DataFrame:
    return top_terms(word_frequency(enriched), n)


def top_bigrams(enriched: DataFrame, n: int = 10) -> DataFrame:
    return top_terms(ngram_frequency(enriched, 2), n)


def top_trigrams(enriched: DataFrame, n: int = 10) -> DataFrame:
    return top_terms(ngram_frequency(enriched, 3), n)


def top_emojis(enriched: DataFrame, n: int = 10) -> DataFrame:
    return top_terms(emoji_frequency(enriched), n)


def word_weights(enriched: DataFrame, n: int = 150) -> DataFrame:
    """Top words with their weight relative to the most frequent one."""
    chat = Window.partitionBy("chat_id")
    return top_words(enriched, n).withColumn(
        "weight", F.col("count") / F.max("count").over(chat)
    )


def sender_keywords(enriched: DataFrame, n: int = 10, vocabulary: int = 500) -> DataFrame:
    """Signature words of each sender by TF-IDF, with one document per sender.

    The vocabulary is the ``vocabulary`` most frequent words of the chat; weights are
    ``(1 + ln count) * (ln((1 + senders) / (1 + senders using it)) + 1)``, scaled to
    unit length per sender.  Chats with fewer than two writing senders have none.
    """
    counts = (
        _exploded(enriched, words_of(F.col("cleaned_message")), "term", "chat_id", "sender")
        .groupBy("chat_id", "sender", "term")
        .agg(F.count("*").alias("count"))
    )
    writers = (
        counts.groupBy("chat_id", "sender")
        .agg(F.sum("count").alias("n"))
        .filter(F.col("n") > 0)
        .groupBy("chat_id")
        .agg(F.count("*").alias("documents"))
        .filter(F.col("documents") >= 2)
    )
    terms = counts.groupBy("chat_id", "term").agg(
        F.sum("count").alias("count"), F.count("*").alias("document_frequency")
    )
    by_count = [F.desc("count"), F.col("term")]
    idf = (
        top_rows(terms, ["chat_id"], by_count, vocabulary, key="term", rank="position")
        .join(writers, "chat_id")
        .select(
            "chat_id", "term",
            (F.ln((1 + F.col("documents")) / (1 + F.col("document_frequency"))) + 1).alias("idf"),
        )
    )
    weighted = counts.join(idf, ["chat_id", "term"]).select(
        "chat_id", "sender", "term", ((1 + F.ln("count")) * F.col("idf")).alias("weight")
    )
    sender = Window.partitionBy("chat_id", "sender")
    score = F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(sender))
    return (
        weighted.withColumn("score", score)
        .withColumn("rank", F.row_number().over(sender.orderBy(F.desc("score"), "term")))
        .filter((F.col("rank") <= n) & (F.col("score") > 0))
        .select(
            "chat_id", "sender", "rank", "term", round_half_even(F.col("score"), 4).alias("score")
        )
    )
