"""Words of texts as rows: joined with list tables, put together again per text.

Scoring needs none of this for short lists that are held here: their words are looked up inside
the row.  Else a text becomes one row per word, with its place and the words around it.  Lists are
tables of any size: Spark broadcasts a small one and shuffles a large one.  Every row carries the
key of its text; texts are dealt by that key once, and explode, join, regrouping and the join back
keep the dealing, so no step after the first moves a text.

The key is a 128-bit hash of the row's identity and the text, so repeated rows have one key and
get equal results: places are collected as sets, and counts divided by the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatframe.functions import lexicon as lx
from chatframe.functions import text as tx
from chatframe.functions.lists import WordLists

KEY = ["_k1", "_k2"]
IDENTITY = ("chat_id", "msg_seq")


def keyed(df: DataFrame, text: str) -> DataFrame:
    """Add the key of each row's text and deal the rows by it.

    Rows without an identity have the text alone for a key.  They are not dealt here, as one
    text may be most rows: joins split such a key when they see it.
    """
    if set(KEY) <= set(df.columns):
        return df
    identity = [c for c in IDENTITY if c in df.columns]
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (*identity, text)]
    df = df.withColumns({KEY[0]: F.xxhash64(*values), KEY[1]: F.xxhash64(F.lit("second"), *values)})
    return df.repartition(*KEY) if len(identity) == len(IDENTITY) else df


def _map_of(entry: Column) -> Column:
    """Aggregate: ``struct(word, value)`` as a map; nulls are left out, a word has one value."""
    return F.map_from_entries(F.collect_set(entry))


def _subjective() -> Column:
    return F.struct("polarity", "subjectivity", "intensity")


def _listed_forms(spark: SparkSession, lists: WordLists, subjective: bool) -> DataFrame:
    """``(word, form)`` of the words cleaning knows; a stopword has the empty form.

    ``subjective`` adds the words of the subjectivity list, whose form is the word, and
    ``entries``, what that list says about the words of each form that stays.
    """
    forms = lists.forms(spark)
    if subjective:
        nothing = (F.lit(None).cast("string").alias("lemma"), F.lit(None).cast("boolean").alias("stop"))
        forms = forms.union(lists.subjective(spark).select("word", *nothing)).groupBy("word").agg(
            F.max("lemma").alias("lemma"), F.max("stop").alias("stop")
        )
    form = F.when(F.coalesce("stop", F.lit(False)), "").otherwise(F.coalesce("lemma", "word"))
    # A short word that stays short is left out anyway.
    known = forms.select("word", form.alias("form")).filter("char_length(word) > 2 OR char_length(form) > 2")
    if not subjective:
        return known
    # A lemma of several words is several words of the cleaned text.
    parts = F.when(F.char_length("form") > 2, tx.words_of(F.col("form")))
    table = lists.subjective(spark).select(F.col("word").alias("part"), _subjective().alias("values"))
    entry = F.when(F.col("values").isNotNull(), F.struct("part", "values"))
    return (
        known.select("word", "form", F.explode_outer(parts).alias("part"))
        .join(table, "part", "left")
        .groupBy("word", "form")
        .agg(F.sort_array(F.collect_set(entry)).alias("entries"))
    )


def clean(
    texts: DataFrame, text: str, lists: WordLists, skipped: Column | None = None, *,
    subjective: bool = False, in_row: bool = False,
) -> DataFrame:
    """Add ``_words``: stopwords out, verb lemmas in, words of up to two letters out.

    NULL for rows that are ``skipped``.  ``in_row`` looks words up inside the row, if the lists are
    short; such rows need no key.  Else rows get theirs and are dealt by it, and ``subjective`` also
    adds ``_subjective``, the map of :func:`with_subjective`, so that no text is cleaned again for it.

    Joined with lists, a text becomes a row for each of its words, once, and one row with all its
    letters.  Of the words only those of a list are grouped again; the others stay in their place
    among the letters.
    """
    if in_row and lists.short("stopwords", "lemmas"):
        words = lx.clean_words(tx.letters_of(F.col(text)), lists)
        return texts.withColumn("_words", words if skipped is None else F.when(~skipped, words))
    texts = keyed(texts, text)
    read = texts if skipped is None else texts.filter(~skipped)
    distinct = F.array_distinct(F.split("letters", " "))
    rows = F.concat(
        F.transform(distinct, lambda w: F.struct(w.alias("word"), F.lit(False).alias("whole"))),
        F.array(F.struct(F.col("letters").alias("word"), F.lit(True).alias("whole"))),
    )
    # outer: else Spark filters by the size of the list before, and makes it twice
    words = read.select(*KEY, tx.letters_of(F.col(text)).alias("letters")).select(*KEY, F.inline_outer(rows))
    hits = words.join(_listed_forms(texts.sparkSession, lists, subjective), "word", "left").filter("whole OR form IS NOT NULL")
    listed = ~F.col("whole")
    aggregates = [
        F.max(F.when(F.col("whole"), F.col("word"))).alias("_letters"),
        _map_of(F.when(listed, F.struct("word", "form"))).alias("_forms"),
    ]
    if subjective:
        entries = F.collect_set(F.when(listed & (F.size("entries") > 0), F.col("entries")))
        aggregates.append(F.map_from_entries(F.array_distinct(F.flatten(entries))).alias("_subjective"))
    back = hits.groupBy(*KEY).agg(*aggregates)
    forms = F.transform(F.split("_letters", " "), lambda w: F.coalesce(F.col("_forms")[w], w))
    left = F.filter(forms, lambda w: F.char_length(w) > 2)
    return texts.join(back, KEY, "left").withColumn("_words", left).drop("_letters", "_forms")


def rule_hits(texts: DataFrame, message: str, lists: WordLists) -> DataFrame:
    """``_values`` and ``_n_tokens`` by key, for texts with words of the valence list."""
    spark = texts.sparkSession
    tokens, low = F.col("tokens"), F.col("low")
    staged = (
        texts.select(*KEY, lx.rule_tokens(F.col(message)).alias("tokens"))
        .withColumn("low", F.transform("tokens", F.lower))
        .withColumns(
            {
                "mixed": lx.mixed_case(tokens), "but_at": F.array_position("low", "but") - 1,
                "n_tokens": F.size("tokens"),
            }
        )
        # outer: else Spark filters by the size of the list before, and takes every text apart twice
        .select("*", F.posexplode_outer("low").alias("i", "token"))
    )
    rules = lists.rules(spark)
    scored = rules.filter("valence IS NOT NULL").select("token", "valence")
    near = {f"p{d}": F.get(low, F.col("i") - d) for d in (1, 2, 3)} | {f"n{d}": F.get(low, F.col("i") + d) for d in (1, 2)}
    shouted = {f"u{d}": F.col("mixed") & lx.is_upper(F.get(tokens, F.col("i") - d)) for d in (0, 1, 2, 3)}
    hits = staged.join(scored, "token").select(
        *KEY, "i", "token", "valence", "but_at", "n_tokens",
        *(c.alias(n) for n, c in (near | shouted).items()),
    )
    for d in (1, 2, 3):
        before = rules.select(
            F.col("token").alias(f"p{d}"), F.col("valence").isNotNull().alias(f"scored{d}"),
            F.col("delta").alias(f"delta{d}"), F.col("negates").alias(f"negates{d}"),
        )
        hits = hits.join(before, f"p{d}", "left")
    hits = hits.withColumn("value", lx.first_value())
    for d in (1, 2, 3):
        hits = hits.withColumn("value", lx.after_word(d))
    # A hit is one row without a phrase, and one for each run of words around it that may be a phrase.
    none = F.array(F.struct(F.lit(-1).alias("place"), F.lit(None).cast("string").alias("phrase")))
    runs = F.when(lx.looks_for_phrases(), F.concat(none, lx.phrases_around())).otherwise(none)
    around = hits.select(
        *KEY, "i", "n_tokens", "value", lx.later_rules().alias("factor"),
        F.explode(runs).alias("p"),
    ).select("*", "p.*").drop("p").join(lists.phrases(spark), "phrase", "left")
    # An idiom replaces the value; a later place in the list of phrases wins.
    places = range(len(lx.PHRASES))
    per_word = around.groupBy(*KEY, "i").agg(
        F.max("value").alias("value"), F.max("factor").alias("factor"), F.max("n_tokens").alias("n_tokens"),
        # a number for each place: a struct would have Spark sort the rows
        *(F.max(F.when(F.col("place") == p, F.col("idiom"))).alias(f"idiom{p}") for p in places),
        F.min(F.when(F.col("place").isin(*lx.BOOSTER_PLACES), F.col("delta"))).alias("delta"),
    )
    final = (F.coalesce(*(F.col(f"idiom{p}") for p in reversed(places)), "value") + F.coalesce("delta", F.lit(0.0))) * F.col("factor")
    return per_word.groupBy(*KEY).agg(
        F.max("n_tokens").alias("_n_tokens"),
        F.sort_array(F.collect_list(F.struct("i", final.alias("v")))).alias("_places"),
    ).select(*KEY, "_n_tokens", F.col("_places.v").alias("_values"))


def with_subjective(texts: DataFrame, cleaned: str, lists: WordLists, read: Column) -> DataFrame:
    """Add ``_subjective``: what the list says about the words of each text that is ``read``, as a map."""
    table = lists.subjective(texts.sparkSession).select("word", _subjective().alias("values"))
    words = texts.filter(read).select(*KEY, F.explode(F.array_distinct(tx.words_of(F.col(cleaned)))).alias("word"))
    back = words.join(table, "word").groupBy(*KEY).agg(_map_of(F.struct("word", "values")).alias("_subjective"))
    return texts.join(back, KEY, "left")


def subjective_terms(words: Column, entries: Column) -> Column:
    """``array<struct(polarity, subjectivity)>`` of the words that have an entry, in their order.

    ``entries`` has what the list says of each of ``words``, or NULL.
    """

    def at(values: Column, i: Column, d: int) -> Column:
        return F.get(values, i + F.lit(d))

    # A word that strengthens a scored word right after it does not count by itself.
    places = F.filter(
        F.transform(entries, lambda s, i: F.when(s.isNotNull(), F.struct(i.alias("i"), s.alias("s")))), lambda x: x.isNotNull()
    )
    counted = F.filter(places, lambda x: (x["s"]["intensity"] == 1) | at(entries, x["i"], 1).isNull())

    def values(x: Column) -> Column:
        before = at(entries, x["i"], -1)["intensity"]
        return lx.subjective_values(x["s"], F.when(before != 1, before), at(words, x["i"], -1), at(words, x["i"], -2))

    return F.transform(counted, values)


def term_counts(texts: DataFrame, words: Column, weights: DataFrame) -> DataFrame:
    """``_entries`` by key: for each known term its count and weights, in order of the terms.

    ``weights`` has ``(term, weights)``; terms are words and pairs of neighbouring words.  Each text
    gives one more row, of the empty term; as repeated rows have one key, the count of
    any term is divided by theirs.  Counts are of fixed length, so that they are hashed, not sorted.
    """
    whole = F.col("term") == ""
    terms = F.concat(F.array(F.lit("")), "w", tx.ngrams_of(F.col("w"), 2))
    # outer: else Spark filters by the size of the list before, and makes it twice
    staged = texts.select(*KEY, words.alias("w")).select(*KEY, F.explode_outer(terms).alias("term"))
    known = weights.select("term", F.lit(True).alias("known"))
    counted = staged.join(known, "term", "left").filter(whole | F.col("known")).groupBy(*KEY, "term").agg(F.count("*").alias("rows"))
    entry = F.when(~whole, F.struct("term", "rows", "weights"))
    entries = F.sort_array(F.collect_list(entry))
    back = counted.join(weights, "term", "left").groupBy(*KEY).agg(
        entries.alias("_rows"), F.max(F.when(whole, F.col("rows"))).alias("_copies")
    )
    once = F.transform(
        "_rows", lambda e: F.struct(e["term"].alias("term"), (e["rows"] / F.col("_copies")).alias("n"), e["weights"].alias("weights"))
    )
    return back.select(*KEY, once.alias("_entries"))
