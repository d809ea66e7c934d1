"""Applying a trained model to texts: their terms are joined with the model's weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.functions.lists import WordLists
from chatframe.functions.text import round_half_even, strip, words_of
from chatframe.operators.enrich import DEFAULT_LISTS, has_cleaned_text, is_text
from chatframe.operators.occurrences import KEY, clean, keyed, term_counts
from chatframe.operators.training import SentimentModel
from chatframe.schema import LABELS, NEUTRAL, require_columns


def _with_scores(df: DataFrame, words: Column, model: SentimentModel) -> DataFrame:
    """Add ``_scores``, one value per label of the model, in the order of its labels.

    ``df`` has a key.  A term weighs its scaled count times idf; weights of a text have length 1.
    """
    entries = F.col("_entries")

    def weight(e: Column) -> Column:
        return (1 + F.ln(e["n"])) * e["weights"][0]

    def evidence(k: int) -> Column:
        return F.aggregate(entries, F.lit(0.0), lambda a, e: a + weight(e) * e["weights"][k + 1])

    length = F.sqrt(F.aggregate(entries, F.lit(0.0), lambda a, e: a + weight(e) * weight(e)))
    staged = df.join(term_counts(df, words, model.table(df.sparkSession)), KEY, "left").withColumn("_length", length)
    scores = F.array(
        *[
            F.lit(float(b))
            + F.when(F.col("_length") > 0, evidence(k) / F.col("_length")).otherwise(0.0)
            for k, b in enumerate(model.bias)
        ]
    )
    return staged.withColumn("_scores", scores).drop("_entries", "_length")


def _best_label(model: SentimentModel) -> Column:
    """The first label with the highest score."""
    place = F.array_position("_scores", F.array_max("_scores"))
    return F.element_at(F.array(*map(F.lit, model.labels)), place.cast("int"))


def check_texts(texts: DataFrame, text: str = "text", max_chars: int | None = None) -> DataFrame:
    """Add ``error``: NULL for texts that a live call would accept.

    ``max_chars`` refuses longer texts, as a web form does with 500; there is no limit
    by default.
    """
    trimmed = strip(F.col(text))
    # The error texts
    error = F.when(F.col(text).isNull(), "No text provided.").when(trimmed == "", "Text is empty.")
    if max_chars is not None:
        error = error.when(F.char_length(trimmed) > max_chars, f"Text too long (max {max_chars} characters).")
    return texts.withColumn("error", error)


def predict_texts(
    texts: DataFrame,
    model: SentimentModel,
    text: str = "text",
    lists: WordLists = DEFAULT_LISTS,
    *,
    raw: bool = False,
) -> DataFrame:
    """Add ``label, confidence, prob_positive, prob_neutral, prob_negative``.

    Texts are cleaned like the training rows; ``raw=True`` only lower-cases them and
    takes words of two or more characters.  Blank texts are Neutral with certainty.
    """
    require_columns(texts, (text,))
    body = F.coalesce(F.col(text), F.lit(""))
    # dealt before they are cleaned: a micro-batch may be one file
    dealt = keyed(texts, text)
    if raw:
        words = F.regexp_extract_all(F.lower(body), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    else:
        dealt = clean(dealt, text, lists, in_row=True)
        words = F.coalesce("_words", F.array().cast("array<string>"))
    blank = strip(body) == ""
    top = F.array_max("_scores")
    powers = F.transform("_scores", lambda s: F.exp(s - top))
    scored = (
        _with_scores(dealt, words, model)
        .withColumn("_powers", powers)
        .withColumn("_sum", F.aggregate("_powers", F.lit(0.0), lambda a, p: a + p))
    )

    def probability(label: str) -> Column:
        if label in model.labels:
            p = F.get("_powers", F.lit(model.labels.index(label))) / F.col("_sum")
        else:
            p = F.lit(0.0)
        return F.when(blank, 1.0 if label == NEUTRAL else 0.0).otherwise(round_half_even(p, 4))

    return scored.withColumns(
        {
            "label": F.when(blank, NEUTRAL).otherwise(_best_label(model)),
            "confidence": F.when(blank, 1.0).otherwise(
                round_half_even(F.array_max("_powers") / F.col("_sum"), 4)
            ),
            **{f"prob_{x.lower()}": probability(x) for x in LABELS},
        }
    ).drop("_scores", "_powers", "_sum", "_words", *KEY)


def predict_messages(messages: DataFrame, model: SentimentModel | None) -> DataFrame:
    """Add ``predicted_sentiment``.

    Text messages with cleaned text get the model's label, all others Neutral.
    Without a model the lexicon label is copied.
    """
    if model is None:
        label = F.col("sentiment_label") if "sentiment_label" in messages.columns else F.lit(NEUTRAL)
        return messages.withColumn("predicted_sentiment", label)
    dealt = keyed(messages, "cleaned_message")
    scored = _with_scores(dealt, words_of(F.col("cleaned_message")), model)
    return scored.withColumn(
        "predicted_sentiment",
        F.when(is_text() & has_cleaned_text(), _best_label(model)).otherwise(NEUTRAL),
    ).drop("_scores", *KEY)
