"""Word lists: seeds written for this project, or tables of any size.

Words are looked up in short lists that are held here, as the seeds are, by expressions.  With
longer lists and with tables they are joined; tables are read where they are, never collected.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Mapping
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- Fixed values: chat words that carry no meaning --------------------------
CHAT_STOPWORDS = """
ok okay yeah yep yes no oh
hmm hm ah ha lol omg lmao
bro guy guys hi hey hello bye
haha hahaha hehe na nah yaar
message deleted media omitted null
""".split()

# ---- Fixed values: English function words (letters only; apostrophes never
# ---- survive cleaning) -------------------------------------------------------
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves
he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those
am is are was were be been being have has had having do does did doing
a an the and but if or because as until while
of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such
no nor not only own same so than too very
s t can will just don should now d ll m o re ve y
ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn
wasn weren won wouldn
""".split()

# ---- Fixed values: irregular verbs, as "base past participle" ----------------
IRREGULAR_VERBS = """
go went gone; see saw seen; say said said; get got gotten; make made made;
know knew known; think thought thought; take took taken; come came come;
give gave given; find found found; tell told told; feel felt felt; leave left left;
keep kept kept; begin began begun; bring brought brought; write wrote written;
sit sat sat; stand stood stood; lose lost lost; pay paid paid; meet met met;
run ran run; buy bought bought; speak spoke spoken; hold held held; grow grew grown;
send sent sent; build built built; understand understood understood; draw drew drawn;
break broke broken; spend spent spent; drive drove driven; eat ate eaten; fall fell fallen;
catch caught caught; teach taught taught; win won won; forget forgot forgotten;
sleep slept slept; choose chose chosen; wear wore worn; fly flew flown; sell sold sold;
sing sang sung; swim swam swum; drink drank drunk; throw threw thrown; fight fought fought;
hear heard heard; mean meant meant; ride rode ridden; rise rose risen; wake woke woken
"""

# ---- Fixed values: regular verbs ---------------------------------------------
REGULAR_VERBS = """
ask work seem call try need want use like love hate help talk turn start show play move
live believe happen include continue change watch follow stop create open walk offer
remember consider appear serve die stay reach kill remain suggest raise pass report
decide pull return explain hope develop carry thank receive agree support join
finish plan share laugh enjoy miss worry wait reply text post check fix order wish
cook clean study visit travel arrive answer learn listen look save train test cancel
""".split()

# ---- Fixed values: rule-based valence lexicon (seed) --------------------------
VALENCE = {
    "love": 3.2, "loved": 2.9, "loves": 2.7, "lovely": 2.8, "great": 3.1, "good": 1.9,
    "nice": 1.8, "best": 3.2, "better": 1.9, "happy": 2.7, "glad": 2.0, "awesome": 3.1,
    "amazing": 2.8, "excellent": 2.7, "wonderful": 2.7, "fantastic": 2.6, "perfect": 2.7,
    "smart": 1.7, "handsome": 2.2, "funny": 1.9, "fun": 2.3, "beautiful": 2.9, "cool": 1.3,
    "brilliant": 2.8, "enjoy": 2.2, "enjoyed": 2.3, "thanks": 1.9, "thank": 1.5,
    "welcome": 2.0, "win": 2.8, "winner": 2.8, "kind": 2.4, "sweet": 2.0, "proud": 2.1,
    "hope": 1.9, "like": 1.5, "liked": 1.8, "excited": 1.4, "helpful": 1.8, "success": 2.7,
    "safe": 1.9, "strong": 2.3, "support": 1.7, "agree": 1.5, "trust": 2.3, "yay": 2.4,
    "congrats": 2.4, "interesting": 1.7, "favorite": 2.0, "free": 2.3, "easy": 1.9,
    ":)": 2.0, ":d": 2.3, ";)": 0.9, "<3": 1.9,
    "hate": -2.7, "hated": -3.2, "bad": -2.5, "worse": -2.1, "worst": -3.1,
    "terrible": -2.1, "horrible": -2.5, "awful": -2.0, "sad": -2.1, "angry": -2.3,
    "annoying": -1.7, "annoyed": -1.6, "stupid": -2.4, "ugly": -2.3, "boring": -1.3,
    "disappointed": -1.9, "fail": -2.5, "failed": -2.3, "failure": -2.3, "error": -1.7,
    "wrong": -2.1, "problem": -1.7, "problems": -1.7, "lost": -1.3, "lose": -1.7,
    "pain": -2.3, "painful": -1.9, "sick": -2.3, "tired": -1.9, "sorry": -0.3,
    "afraid": -2.0, "worry": -1.9, "worried": -1.2, "cry": -2.1, "crying": -2.1,
    "dead": -3.3, "death": -2.9, "kill": -3.7, "evil": -3.4, "liar": -2.3, "useless": -1.8,
    "worthless": -1.9, "ineffectual": -1.2, "pathetic": -2.7, "idiot": -2.3, "scam": -2.7,
    "poor": -2.1, "dirty": -1.9, "danger": -2.4, "dangerous": -2.1, "cruel": -2.8,
    "disgusting": -2.4, "mess": -1.5, "broken": -2.1, "mad": -2.2, "alone": -1.0,
    "yeah": 1.2, "bomb": -2.2, "shit": -2.6, "ass": -2.5, "cut": -1.1, "kiss": 1.8,
    ":(": -1.9, ":'(": -2.2,
}

# ---- Fixed values: words that strengthen or weaken the next lexicon word ------
STRENGTHEN = """
absolutely amazingly awfully completely considerably decidedly deeply enormously
entirely especially exceptionally extremely fabulously fully greatly highly hugely
incredibly intensely majorly more most particularly purely quite really remarkably so
substantially thoroughly totally tremendously uber unbelievably unusually utterly very
""".split()
WEAKEN = """
almost barely hardly kinda kindof less little marginally occasionally partly scarcely
slightly somewhat sorta sortof
""".split()
BOOST = 0.293

# ---- Fixed values: weakening phrases of two words, right before or one word before the scored word
WEAKEN_PHRASES = ("just enough", "kind of", "sort of")

# ---- Fixed values: idioms around a lexicon word, with the valence they get ----
IDIOMS = {
    "the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0,
    "cut the mustard": 2.0, "kiss of death": -1.5, "hand to mouth": -2.0,
}

# ---- Fixed values: words that negate -----------------------------------------
NEGATIONS = """
aint arent cannot cant couldnt darent didnt doesnt dont hadnt hasnt havent isnt
mightnt mustnt neednt neither never none nope nor not nothing nowhere oughtnt shant
shouldnt uhuh wasnt werent without wont wouldnt rarely seldom despite
""".split()

# ---- Fixed values: second lexicon, word -> (polarity, subjectivity, intensity) -
SUBJECTIVITY = {
    "love": (0.5, 0.6, 1.0), "lovely": (0.5, 0.75, 1.0), "great": (0.8, 0.75, 1.0),
    "good": (0.7, 0.6, 1.0), "nice": (0.6, 1.0, 1.0), "best": (1.0, 0.3, 1.0),
    "better": (0.5, 0.5, 1.0), "happy": (0.8, 1.0, 1.0), "glad": (0.5, 1.0, 1.0),
    "awesome": (1.0, 1.0, 1.0), "amazing": (0.6, 0.9, 1.0), "excellent": (1.0, 1.0, 1.0),
    "wonderful": (1.0, 1.0, 1.0), "fantastic": (0.4, 0.9, 1.0), "perfect": (1.0, 1.0, 1.0),
    "smart": (0.21, 0.64, 1.0), "handsome": (0.5, 1.0, 1.0), "funny": (0.25, 1.0, 1.0),
    "fun": (0.3, 0.2, 1.0), "beautiful": (0.85, 1.0, 1.0), "cool": (0.35, 0.65, 1.0),
    "brilliant": (0.9, 1.0, 1.0), "welcome": (0.8, 0.9, 1.0), "win": (0.8, 0.4, 1.0),
    "kind": (0.6, 0.9, 1.0), "sweet": (0.35, 0.65, 1.0), "proud": (0.8, 1.0, 1.0),
    "safe": (0.5, 0.5, 1.0), "strong": (0.43, 0.73, 1.0), "easy": (0.43, 0.83, 1.0),
    "free": (0.4, 0.8, 1.0), "interesting": (0.5, 0.5, 1.0), "favorite": (0.5, 1.0, 1.0),
    "new": (0.14, 0.45, 1.0), "right": (0.29, 0.54, 1.0), "sure": (0.5, 0.89, 1.0),
    "hate": (-0.8, 0.9, 1.0), "bad": (-0.7, 0.67, 1.0), "worse": (-0.4, 0.6, 1.0),
    "worst": (-1.0, 1.0, 1.0), "terrible": (-1.0, 1.0, 1.0), "horrible": (-1.0, 1.0, 1.0),
    "awful": (-1.0, 1.0, 1.0), "sad": (-0.5, 1.0, 1.0), "angry": (-0.5, 1.0, 1.0),
    "annoy": (-0.4, 0.8, 1.0), "stupid": (-0.8, 1.0, 1.0), "ugly": (-0.7, 1.0, 1.0),
    "boring": (-1.0, 1.0, 1.0), "disappointed": (-0.75, 0.75, 1.0), "wrong": (-0.5, 0.9, 1.0),
    "sick": (-0.71, 0.86, 1.0), "tired": (-0.4, 0.7, 1.0), "sorry": (-0.5, 1.0, 1.0),
    "afraid": (-0.6, 0.9, 1.0), "dead": (-0.2, 0.4, 1.0), "evil": (-1.0, 1.0, 1.0),
    "useless": (-0.5, 0.2, 1.0), "worthless": (-0.8, 0.9, 1.0), "poor": (-0.4, 0.6, 1.0),
    "ineffectual": (-0.4, 0.6, 1.0), "pathetic": (-1.0, 1.0, 1.0), "dirty": (-0.6, 0.8, 1.0),
    "dangerous": (-0.6, 0.9, 1.0), "cruel": (-1.0, 1.0, 1.0), "disgusting": (-1.0, 1.0, 1.0),
    "mad": (-0.63, 1.0, 1.0), "late": (-0.3, 0.6, 1.0), "hard": (-0.29, 0.54, 1.0),
    "really": (0.2, 0.2, 1.3), "absolutely": (0.2, 0.9, 1.5), "extremely": (-0.13, 1.0, 1.5),
    "totally": (0.0, 0.75, 1.3), "quite": (0.0, 0.4, 0.8), "slightly": (-0.17, 0.17, 0.7),
    "incredibly": (0.9, 0.9, 1.6), "fairly": (0.7, 0.9, 0.8),
}

def _inflect(verb: str) -> tuple[str, str, str]:
    """English spelling of the -s, -ed and -ing forms of a verb."""
    vowels = "aeiou"
    s = "es" if verb.endswith(("s", "x", "z", "ch", "sh", "o")) else "s"
    if verb.endswith("ee"):
        return verb + "s", verb + "d", verb + "ing"
    if verb.endswith("ie"):
        return verb + "s", verb + "d", verb[:-2] + "ying"
    if verb.endswith("e"):
        return verb + "s", verb + "d", verb[:-1] + "ing"
    if verb.endswith("y") and verb[-2] not in vowels:
        return verb[:-1] + "ies", verb[:-1] + "ied", verb + "ing"
    short = len(verb) in (3, 4) and verb[-1] not in vowels + "wxy"
    doubles = short and verb[-2] in vowels and verb[-3] not in vowels
    stem = verb + verb[-1] if doubles or verb in ("begin", "forget") else verb
    return verb + s, stem + "ed", stem + "ing"


def verb_lemmas() -> dict[str, str]:
    """``inflected form -> base`` for the seed verbs (verbs only)."""
    table: dict[str, str] = {}
    for verb in REGULAR_VERBS:
        table.update(dict.fromkeys(_inflect(verb), verb))
    for entry in IRREGULAR_VERBS.replace("\n", " ").split(";"):
        base, past, participle = entry.split()
        third, _, progressive = _inflect(base)
        table.update(dict.fromkeys((third, past, participle, progressive), base))
    return {form: base for form, base in table.items() if form != base}


def _local(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType]) -> DataFrame:
    return spark.createDataFrame(pa.table({n: pa.array(v, types[n]) for n, v in columns.items()}))


_TEXT, _NUMBER = pa.string(), pa.float64()

# Lists held here with up to this many words are written into expressions; others are joined.
SHORT = 1_000


def is_in(word: Column, words: Collection[str]) -> Column:
    """Membership in a short list; false for NULL."""
    return F.coalesce(word.isin(sorted(words)), F.lit(False)) if words else F.lit(False)


def value_of(word: Column, table: Mapping[str, object], sql_type: str) -> Column:
    """The value of a word in a short list, or NULL; only words of the list are looked for one by one."""
    words = sorted(table)
    if not words:
        return F.lit(None).cast(sql_type)

    def constant(values: list, kind: str) -> Column:
        return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), kind)

    place = F.array_position(constant(words, "array<string>"), word).cast("int")
    return F.when(is_in(word, words), F.get(constant([table[w] for w in words], f"array<{sql_type}>"), place - 1))


@dataclass(frozen=True)
class WordLists:
    """All lists the text operators need; the default is the project seed.

    Each is a collection of words or, from :meth:`from_tables`, a table.
    """

    stopwords: frozenset[str] | DataFrame = frozenset(ENGLISH_STOPWORDS) | frozenset(CHAT_STOPWORDS)
    lemmas: dict[str, str] | DataFrame = field(default_factory=verb_lemmas)
    valence: dict[str, float] | DataFrame = field(default_factory=lambda: dict(VALENCE))
    boosters: dict[str, float] | DataFrame = field(
        default_factory=lambda: {w: BOOST for w in STRENGTHEN} | {w: -BOOST for w in (*WEAKEN, *WEAKEN_PHRASES)}
    )
    negations: frozenset[str] | DataFrame = frozenset(NEGATIONS)
    idioms: dict[str, float] | DataFrame = field(default_factory=lambda: dict(IDIOMS))
    subjectivity: dict[str, tuple[float, float, float]] | DataFrame = field(
        default_factory=lambda: dict(SUBJECTIVITY)
    )

    @staticmethod
    def from_tables(
        stopwords: list[DataFrame] | None = None,
        lemmas: DataFrame | None = None,
        valence: DataFrame | None = None,
        boosters: DataFrame | None = None,
        negations: DataFrame | None = None,
        subjectivity: DataFrame | None = None,
        idioms: DataFrame | None = None,
    ) -> "WordLists":
        """Replace seeds by tables: ``stopwords(word)`` (several are united),
        ``lemmas(word, lemma)``, ``valence(token, valence)``,
        ``boosters(token, delta)``, ``negations(token)``, ``idioms(phrase, valence)`` and
        ``subjectivity(word, polarity, subjectivity, intensity)``.

        Nothing is read here.  Boosters and idioms of several words are written with single
        blanks.  Of rows that disagree about a word the largest value counts.
        """
        given = {"lemmas": lemmas, "valence": valence, "boosters": boosters, "negations": negations,
                 "subjectivity": subjectivity, "idioms": idioms}
        lists = {name: table for name, table in given.items() if table is not None}
        if stopwords:
            lists["stopwords"] = united(stopwords)
        return WordLists(**lists)

    def short(self, *names: str) -> bool:
        """The named lists are held here and short."""
        held = [getattr(self, name) for name in names]
        return all(not isinstance(words, DataFrame) and len(words) <= SHORT for words in held)

    def scoring_valence(self) -> dict[str, float]:
        """The valence seed without the booster words, which never score by themselves."""
        return {t: v for t, v in self.valence.items() if t not in self.boosters}

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A list as a table, with the columns of :meth:`from_tables`."""
        held = getattr(self, name)
        columns = {
            "stopwords": ("word",), "lemmas": ("word", "lemma"), "valence": ("token", "valence"),
            "boosters": ("token", "delta"), "negations": ("token",), "idioms": ("phrase", "valence"),
            "subjectivity": ("word", "polarity", "subjectivity", "intensity"),
        }[name]
        if isinstance(held, DataFrame):
            return held.select(*columns)
        if isinstance(held, dict):
            rows = [(k, *(v if isinstance(v, tuple) else (v,))) for k, v in sorted(held.items())]
        else:
            rows = [(k,) for k in sorted(held)]
        kinds = {c: _NUMBER if c in ("valence", "delta", "polarity", "subjectivity", "intensity") else _TEXT for c in columns}
        return _local(spark, {c: [r[i] for r in rows] for i, c in enumerate(columns)}, kinds)

    def forms(self, spark: SparkSession) -> DataFrame:
        """``(word, lemma, stop)``: what cleaning does with a word; other words stay."""
        stop = self.table(spark, "stopwords").select("word", F.lit(None).cast("string").alias("lemma"), F.lit(True).alias("stop"))
        return _one_row(stop, self.table(spark, "lemmas").withColumn("stop", F.lit(None).cast("boolean")))

    def rules(self, spark: SparkSession) -> DataFrame:
        """``(token, valence, delta, negates)``; a booster word has no valence."""
        rows = _one_row(
            self.table(spark, "valence").selectExpr("token", "valence", "CAST(NULL AS DOUBLE) AS delta", "CAST(NULL AS BOOLEAN) AS negates"),
            self.table(spark, "boosters").selectExpr("token", "CAST(NULL AS DOUBLE)", "delta", "CAST(NULL AS BOOLEAN)"),
            self.table(spark, "negations").selectExpr("token", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "true"),
        )
        return rows.withColumn("valence", F.when(F.col("delta").isNull(), F.col("valence")))

    def phrases(self, spark: SparkSession) -> DataFrame:
        """``(phrase, idiom, delta)``: idioms and boosters of several words."""
        boosters = self.table(spark, "boosters").filter(F.contains("token", F.lit(" ")))
        return _one_row(
            self.table(spark, "idioms").selectExpr("phrase", "valence AS idiom", "CAST(NULL AS DOUBLE) AS delta"),
            boosters.selectExpr("token", "CAST(NULL AS DOUBLE)", "delta"),
        )

    def subjective(self, spark: SparkSession) -> DataFrame:
        return _one_row(self.table(spark, "subjectivity"))


def united(tables: list[DataFrame]) -> DataFrame:
    """The words of several list tables, each once."""
    return reduce(DataFrame.unionByName, [t.select("word") for t in tables]).filter("word IS NOT NULL").distinct()


def _one_row(*parts: DataFrame) -> DataFrame:
    """The union of tables with one row for each value of the first column."""
    key, *rest = parts[0].columns
    largest: list[Column] = [F.max(c).alias(c) for c in rest]
    return reduce(DataFrame.union, parts).filter(F.col(key).isNotNull()).groupBy(key).agg(*largest)
