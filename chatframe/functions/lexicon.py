"""Expressions of the two lexicon scoring methods, over words joined with the lists.

The rule-based method follows the published description (Hutto & Gilbert, ICWSM
2014): valences of lexicon words, adjusted by capitals, by boosters and negations
among the three words before, by idioms around the word and by a contrasting "but";
punctuation adds emphasis.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.functions.lists import WordLists, is_in, value_of
from chatframe.functions.text import SPACES, round_half_even
from chatframe.schema import (
    HIGH_CONFIDENCE, LABEL_THRESHOLD, MEDIUM_CONFIDENCE, NEGATIVE, NEUTRAL, POSITIVE,
    STRONG_MOOD,
)

# ---- Fixed values: constants of the published rules ---------------------------
CAPS_BOOST = 0.733
NEGATE = -0.74
DISTANCE_WEIGHT = (1.0, 0.95, 0.9)
NEVER_SO = {2: 1.5, 3: 1.25}
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
# Word runs that may be an idiom, by distance from the scored word; the last that is one counts.
PHRASES = (
    ("p3", "p2"), ("p3", "p2", "p1"), ("p2", "p1"), ("p2", "p1", "token"), ("p1", "token"),
    ("token", "n1"), ("token", "n1", "n2"),
)
BOOSTER_PLACES = (0, 2)
EXCLAMATION, MAX_EXCLAMATIONS = 0.292, 4
QUESTION, MANY_QUESTIONS = 0.18, 0.96
NORMALISER = 15.0
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# ---- Fixed values: second method ----------------------------------------------
SUBJECTIVITY_NEGATIONS = ("no", "not", "never")
SUBJECTIVITY_NEGATE = -0.5


def rule_tokens(message: Column) -> Column:
    """Words with punctuation stripped from the ends, without single characters.

    A word that would shrink to one character or less stays as written, so that
    emoticons survive.
    """
    raw = F.filter(F.split(message, SPACES), lambda w: F.char_length(w) > 1)

    def strip_ends(w: Column) -> Column:
        stripped = F.btrim(w, F.lit(PUNCTUATION))
        return F.when(F.char_length(stripped) > 1, stripped).otherwise(w)

    return F.transform(raw, strip_ends)


def is_upper(token: Column) -> Column:
    return (F.upper(token) == token) & (F.lower(token) != token)


def mixed_case(tokens: Column) -> Column:
    """Some but not all tokens are written in capitals."""
    shouted = F.size(F.filter(tokens, is_upper))
    return (shouted > 0) & (shouted < F.size(tokens))


Get = Callable[[str], Column]
"""How a rule reads what is known of a scored word: a column, or a field of a struct."""


def first_value(get: Get = F.col) -> Column:
    """The word's own valence, stronger if it shouts among words that do not."""
    valence = get("valence")
    return valence + F.when(get("u0"), F.signum(valence) * CAPS_BOOST).otherwise(0.0)


def after_word(d: int, get: Get = F.col) -> Column:
    """``value`` after looking at the word ``d`` places before; scored words are passed over."""
    v, prev = get("value"), get(f"p{d}")
    delta = F.coalesce(get(f"delta{d}"), F.lit(0.0))
    shout = F.when(
        (delta != 0) & get(f"u{d}"), F.when(v > 0, CAPS_BOOST).otherwise(-CAPS_BOOST)
    ).otherwise(0.0)
    signed = F.when(v < 0, -delta).otherwise(delta) + shout
    negates = F.coalesce(get(f"negates{d}"), F.lit(False)) | prev.contains("n't")
    factor = F.when(negates, NEGATE).otherwise(1.0)
    if d > 1:
        so = reduce(Column.__or__, (F.coalesce(get(f"p{k}").isin("so", "this"), F.lit(False)) for k in range(1, d)))
        factor = F.when((prev == "never") & so, NEVER_SO[d]).otherwise(factor)
    return F.when(prev.isNull() | F.coalesce(get(f"scored{d}"), F.lit(False)), v).otherwise(
        (v + signed * DISTANCE_WEIGHT[d - 1]) * factor
    )


def later_rules(get: Get = F.col) -> Column:
    """The factor of "least", "kind of" and a contrasting "but"."""
    least = (get("p1") == "least") & ~F.coalesce(get("scored1"), F.lit(False))
    at_least = F.coalesce(get("p2").isin("at", "very"), F.lit(False))
    i, but_at = get("i"), get("but_at")
    return (
        F.when(least & ~at_least, NEGATE).otherwise(1.0)
        * F.when((get("token") == "kind") & (get("n1") == "of"), 0.0).otherwise(1.0)
        * F.when((but_at >= 0) & (i < but_at), BUT_BEFORE)
        .when((but_at >= 0) & (i > but_at), BUT_AFTER)
        .otherwise(1.0)
    )


def looks_for_phrases(get: Get = F.col) -> Column:
    """Phrases count for words that have three before them, the first of which is not scored."""
    return get("p3").isNotNull() & ~F.coalesce(get("scored3"), F.lit(False))


def phrase_at(place: int, get: Get = F.col) -> Column:
    """The run of words at a place of ``PHRASES``; NULL where one of them is missing."""
    return reduce(lambda a, b: F.concat(a, F.lit(" "), b), [get(n) for n in PHRASES[place]])


def phrases_around() -> Column:
    """``(place, phrase)`` of the neighbouring words; a later place wins."""
    return F.array(
        *[F.struct(F.lit(place).alias("place"), phrase_at(place).alias("phrase")) for place in range(len(PHRASES))]
    )


# ---- the same over short lists, word by word inside the row ---------------------------


def clean_words(letters: Column, lists: WordLists) -> Column:
    """Stopwords out, verb lemmas in, words of up to two letters out; NULL for NULL."""

    def form(w: Column) -> Column:
        return F.when(is_in(w, lists.stopwords), "").otherwise(F.coalesce(value_of(w, lists.lemmas, "string"), w))

    return F.filter(F.transform(F.split(letters, " "), form), lambda w: F.char_length(w) > 2)


def with_rule_values(df: DataFrame, lists: WordLists) -> DataFrame:
    """Add ``_values``, the valences of the scored words of ``_tokens`` after all rules, in their order."""
    valence, tokens, low, mixed = lists.scoring_valence(), F.col("_tokens"), F.col("_low"), F.col("_mixed")
    boosters = {w: v for w, v in lists.boosters.items() if " " not in w}
    weakening = {w: v for w, v in lists.boosters.items() if " " in w}

    def hit(i: Column) -> Column:
        """The word at ``i``, its neighbours, which of them shout, and what the lists say of them."""
        before = {d: F.get(low, i - d) for d in (1, 2, 3)}
        fields = {"i": i, "but_at": F.col("_but_at"), "token": F.get(low, i)}
        fields["valence"] = value_of(fields["token"], valence, "double")
        fields |= {f"u{d}": mixed & is_upper(F.get(tokens, i - d)) for d in (0, 1, 2, 3)}
        fields |= {f"n{d}": F.get(low, i + d) for d in (1, 2)}
        for d, word in before.items():
            fields |= {
                f"p{d}": word, f"scored{d}": is_in(word, valence), f"delta{d}": value_of(word, boosters, "double"),
                f"negates{d}": is_in(word, lists.negations),
            }
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    def with_value(hits: Column, rule: Callable[[Get], Column]) -> Column:
        """``hits`` of structs ``(hit, value)``: each value is made once and read by the next rule."""

        def step(x: Column) -> Column:
            value = rule(lambda name: x["value"] if name == "value" else x["hit"][name])
            return F.struct(x["hit"].alias("hit"), value.alias("value"))

        return F.transform(hits, step)

    def final(get: Get) -> Column:
        idioms = [value_of(phrase_at(p, get), lists.idioms, "double") for p in reversed(range(len(PHRASES)))]
        deltas = [value_of(phrase_at(p, get), weakening, "double") for p in BOOSTER_PLACES]
        looked = looks_for_phrases(get)
        idiom, delta = F.when(looked, F.coalesce(*idioms)), F.when(looked, F.least(*deltas))
        return (F.coalesce(idiom, get("value")) + F.coalesce(delta, F.lit(0.0))) * later_rules(get)

    hits = F.transform("_at", lambda i: F.struct(hit(i).alias("hit"), F.lit(None).cast("double").alias("value")))
    for rule in (first_value, *(lambda get, d=d: after_word(d, get) for d in (1, 2, 3)), final):
        hits = with_value(hits, rule)
    place = F.transform(low, lambda w, i: F.when(is_in(w, valence), i))
    return (
        df.withColumn("_low", F.transform(tokens, F.lower))
        .withColumn("_at", F.filter(place, lambda i: i.isNotNull()))
        .withColumns(
            {
                "_mixed": F.when(F.size("_at") > 0, mixed_case(tokens)),
                "_but_at": F.when(F.size("_at") > 0, F.array_position(low, "but").cast("int") - 1),
            }
        )
        .withColumn("_values", F.transform(hits, lambda x: x["value"]))
    )


def emphasis(message: Column) -> Column:
    """Score added by exclamation and question marks."""

    def count(mark: str) -> Column:
        return F.char_length(message) - F.char_length(F.replace(message, F.lit(mark), F.lit("")))

    questions = count("?")
    return F.least(count("!"), F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION + (
        F.when(questions > 3, MANY_QUESTIONS)
        .when(questions > 1, questions * QUESTION)
        .otherwise(0.0)
    )


def with_rule_score(df: DataFrame) -> DataFrame:
    """Turn ``_values, _n_tokens, _emphasis`` into ``_compound, _pos, _neg, _neu``.

    Staged, so that each sum over the valences is taken once.
    """
    values, zero = F.col("_values"), F.lit(0.0)
    emphasis, n_tokens = F.col("_emphasis"), F.col("_n_tokens")

    def share(part: Column) -> Column:
        return F.when(n_tokens > 0, round_half_even(part / F.col("_everything"), 3)).otherwise(0.0)

    total, plus, minus = F.col("_total"), F.col("_plus"), F.col("_minus")
    return (
        df.withColumns(
            {
                "_total": F.aggregate(values, zero, lambda a, v: a + v),
                "_plus": F.aggregate(
                    values, zero, lambda a, v: a + F.when(v > 0, v + 1.0).otherwise(0.0)
                ),
                "_minus": F.aggregate(
                    values, zero, lambda a, v: a + F.when(v < 0, 1.0 - v).otherwise(0.0)
                ),
                "_plain": n_tokens - F.size(F.filter(values, lambda v: v != 0)),
            }
        )
        .withColumns(
            {
                "_total": total + F.signum(total) * emphasis,
                "_plus": plus + F.when(plus > minus, emphasis).otherwise(0.0),
                "_minus": minus + F.when(plus < minus, emphasis).otherwise(0.0),
            }
        )
        .withColumn("_everything", plus + minus + F.col("_plain"))
        .withColumns(
            {
                "_compound": round_half_even(total / F.sqrt(total * total + NORMALISER), 4),
                "_pos": share(plus),
                "_neg": share(minus),
                "_neu": share(F.col("_plain")),
            }
        )
    )


def subjective_values(word: Column, strength: Column, p1: Column, p2: Column) -> Column:
    """``struct(polarity, subjectivity)`` of a scored word after the words before it.

    ``strength`` is that of an intensifying word right before, else NULL; it multiplies both.  A
    negation before either of them weakens and turns the polarity.
    """

    def clamp(v: Column) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))

    factor = F.coalesce(strength, F.lit(1.0))
    negated = p1.isin(*SUBJECTIVITY_NEGATIONS) | (strength.isNotNull() & p2.isin(*SUBJECTIVITY_NEGATIONS))
    polarity = clamp(word["polarity"] * factor) * F.when(negated, SUBJECTIVITY_NEGATE).otherwise(1.0)
    return F.struct(polarity.alias("polarity"), clamp(word["subjectivity"] * factor).alias("subjectivity"))


def mean_of(terms: Column, name: str) -> Column:
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t[name])
    return F.when(F.size(terms) > 0, round_half_even(total / F.size(terms), 4)).otherwise(0.0)


def label_of(score: Column) -> Column:
    return (
        F.when(score >= LABEL_THRESHOLD, POSITIVE)
        .when(score <= -LABEL_THRESHOLD, NEGATIVE)
        .otherwise(NEUTRAL)
    )


def confidence_of(score: Column, polarity: Column) -> Column:
    """High needs a strong score and agreement of both methods in direction."""
    direction = (
        F.when(polarity > LABEL_THRESHOLD, 1.0).when(polarity < -LABEL_THRESHOLD, -1.0).otherwise(0.0)
    )
    return (
        F.when((F.abs(score) >= HIGH_CONFIDENCE) & (F.signum(score) == direction), "High")
        .when(F.abs(score) >= MEDIUM_CONFIDENCE, "Medium")
        .otherwise("Low")
    )


def mood_of(mean: Column) -> Column:
    """Five bands of a mean score."""
    return (
        F.when(mean >= STRONG_MOOD, "Very Positive 😊")
        .when(mean >= LABEL_THRESHOLD, "Generally Positive 🙂")
        .when(mean <= -STRONG_MOOD, "Very Negative 😔")
        .when(mean <= -LABEL_THRESHOLD, "Generally Negative 😐")
        .otherwise("Mostly Neutral 😶")
    )
