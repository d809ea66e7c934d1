"""Prefix trie, language by compression and collocations against plain versions."""

import collections
import hashlib
import io

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from chatframe.llm import collocations, conversations, languages
from chatframe.llm.queries import QUERIES

from . import plain

SMALL, TENTH = "/root/testdata/sf0.001", "/root/testdata/sf0.1"
CONVERSATION = "conv_id long, turn int, role string, text string"


def by_key(rows, n=2):
    return sorted((tuple(r) for r in rows), key=lambda r: [str(x) for x in r[:n]])


# --- 11 -----------------------------------------------------------------------------------


def odd_conversations():
    rows = [(c, t, "user", f"turn {t}") for c in range(100, 130) for t in range(5)]  # one large group
    rows += [(200, t, None, None) for t in range(40)]  # a long one, whose head nine others share
    rows += [(c, t, "user", f"own {c % 3} {t}") for c in range(201, 210) for t in range(35 + c % 2)]
    rows += [(300, None, "b", "null first"), (300, 1, "a", "tie"), (300, 1, "b", "tie"), (300, 1, "b", "tie"), (300, 0, "", "é\U0001f600")]
    rows += [(301, 0, "x", ""), (None, 0, "x", "no conversation"), (-250, 3, "user", "minus"), (-200, 1, "user", "minus hundred")]
    rows += [(400, 0, "user", "long " * 200_000), (401, 0, "user", "long " * 200_000), (2**40, 0, "a", "b")]
    return rows


@pytest.mark.parametrize(("width", "shard_rows"), [(16, 50_000), (3, 7), (5, 1)])
def test_trie_is_that_of_the_plain_version(spark, width, shard_rows):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, CONVERSATION).withColumns({c: F.lit(1) for c in ("digest", "pos", "ids", "place", "block")})
    got = conversations.prefix_trie(df.repartition(3), width=width, shard_rows=shard_rows)
    assert by_key(got.collect()) == by_key(plain.trie(rows))


def test_trie_of_the_small_table_and_of_nothing(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    want = plain.trie([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert by_key(QUERIES["op11_conversations"](spark, SMALL).collect()) == by_key(want)
    assert conversations.prefix_trie(table.filter("false")).count() == 0


def test_boundary_nodes_of_every_range_are_recombined():
    """The same rows in one matrix and in many give the same counts at every depth."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    ids = [[{"hi": int(x), "lo": int(x)} for x in rng.integers(0, 2, rng.integers(0, 5))] for _ in range(60)]
    rows = pa.table({
        "block": pa.array([0] * 60, pa.int64()), "hi": pa.array([0] * 60, pa.int64()), "lo": pa.array([0] * 60, pa.int64()),
        "ids": pa.array(ids, pa.list_(pa.struct([("hi", pa.int64()), ("lo", pa.int64())]))),
        "goes_on": pa.array([False] * 60), "conv_id": pa.array(range(60), pa.int64()),
        "points": pa.array([[1] * len(i) for i in ids], pa.list_(pa.int64())),
    })
    counted = collections.Counter()
    for j, members, starts, columns in conversations.Matrix(rows, 4).nodes():
        for k, n in enumerate(np.diff(np.append(starts, len(members)))):
            counted[(j, int(columns["hi"][k]))] += int(n)
    want = collections.Counter()
    for i in ids:
        for d in range(len(i) + 1):
            want[tuple(x["hi"] for x in i[:d])] += 1
    assert sorted(counted.values()) != [] and sum(counted.values()) == sum(want.values()) and counted[(0, 0)] == 60


# --- 12 -----------------------------------------------------------------------------------

TEXTS = [
    (1, "The house is green and the garden is large. We like the house.", "en"),
    (2, "Das Haus ist grün und der Garten ist groß. Wir mögen das Haus.", "de"),
    (3, "The trees in the garden are old, and the house is old too.", "en"),
    (4, "Die Bäume in dem Garten sind alt, und das Haus ist auch alt.", "de"),
    (5, None, "en"), (6, "", "de"), (7, "12345 !!! \U0001f600", "en"), (None, "the garden", None), (8, "der Garten", None),
    (9, "The garden of the house. " * 60_000, None), (10, "the garden", "en"), (10, "the garden", "en"),
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i + 1_000 * k if i else i, t, lang, 1) for k in range(6) for i, t, lang in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, _language int").repartition(3)


def test_languages_of_odd_rows(spark, texts):
    learned = languages.fit(texts)
    assert sorted(learned) == ["de", "en"]
    out = languages.identify(texts, learned, result="_found")
    assert out.columns == [*texts.columns, "_found"] and out.count() == 6 * len(TEXTS)
    for r in out.collect():
        text, (lang, score, _) = r["text"], r["_found"]
        if not text or not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
        else:
            assert 0 < score <= 1 and lang == ("de" if "Haus" in text or "der" in text else "en"), r
    assert languages.fit(texts.filter("false")) == {}
    unknown = languages.identify(texts, {}, keep=["doc_id"]).select("_language.lang").distinct().collect()
    assert [r[0] for r in unknown] == ["und"]


def test_nothing_is_learned_from_held_out_rows(spark, texts):
    changed = texts.withColumn("lang", F.when(languages.held_out(), "xx").otherwise(F.col("lang")))
    changed = changed.withColumn("text", F.when(languages.held_out(), "xx").otherwise(F.col("text")))
    assert languages.fit(changed) == languages.fit(texts)


def test_the_smallest_encoding_wins():
    """Sizes are those of plain calls of the encoder; the share falls as the margin narrows."""
    dictionaries = {"a": b"alpha beta gamma delta " * 40, "b": b"eins zwei drei vier " * 40}
    coder = languages.Coder(dictionaries)
    text = "alpha gamma delta beta alpha. " * 40
    given = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for d in dictionaries.values()]
    plainly = [len(zstandard.ZstdCompressor(dict_data=d, level=3, write_content_size=False).compress(text.encode()[:4096])) for d in given]
    assert plainly[0] < plainly[1] and coder.predict(text)[0] == "a"
    assert coder.predict("zwei vier drei eins " * 3)[0] == "b"
    clear, narrow = coder.predict("alpha beta gamma")[1], coder.predict("x")[1]
    assert clear > 0.9 > 0.75 > narrow >= 0.5


def test_languages_on_held_out_rows(spark):
    found = QUERIES["op12_languages"](spark, TENTH).alias("f").join(spark.read.parquet(f"{TENTH}/documents.parquet"), "doc_id")
    held = found.filter("held_out").agg(F.count("*"), F.avg(F.expr("int(lang_pred = lang)")), F.min("score"), F.max("score")).first()
    assert held[0] > 3_000 and held[1] >= 0.99 and 0 <= held[2] <= held[3] <= 1


# --- 13 -----------------------------------------------------------------------------------

DOCUMENT = "doc_id long, text string, lang string"


def odd_texts():
    rng = np.random.default_rng(7)
    words = ["new", "york", "times", "the", "of", "ünïcode", "\x00odd", "a-b", " "]
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) + rng.choice([".", "\n", " ", "\t", "?!"]) for _ in range(150)]
    rows = [(n, t, ["en", None, "de"][n % 3]) for n, t in enumerate(texts)]
    rows += [(1_000 + n, "New York Times is the New York Times.\tNew  York Times", "en") for n in range(40)]
    rows += [(None, None, "en"), (1, "", None), (2, "same same " * 30, "und"), (3, "one two three four five " * 40, "x")]
    return rows


@pytest.mark.parametrize("trie_phrases", [1_000_000, 10])
def test_collocations_are_those_of_the_plain_version(spark, monkeypatch, trie_phrases):
    rows = odd_texts()
    df = spark.createDataFrame(rows, DOCUMENT).withColumns({c: F.lit("k") for c in ("phrase", "a", "n", "rank", "place", "shard")})
    got = collocations.collocations(df.repartition(3), trie_phrases=trie_phrases)
    want = plain.collocations([(t, lang) for _, t, lang in rows])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert any(r[2].startswith("new york") for r in want)


def test_slices_overlap_by_three_words(monkeypatch):
    """A text read in slices of a few bytes counts as it does whole."""
    monkeypatch.setattr(collocations, "SLICE", 40)
    rng = np.random.default_rng(5)
    data = " ".join(rng.choice(["one", "two", "three.", "four", "a..b", "."], 4_000)).encode()
    joined = b""
    for _, part, known in collocations._cut("x", data):
        assert part[:known] == joined[len(joined) - known :]
        assert known == 0 or len(part[:known].replace(b".", b" ").split()) == 3
        joined += part[known:]
    assert joined == data
    phrases = sorted([("x", p) for p in ("one", "one two", "two three", "four one two", "one one one one", "three", "a", "b")])
    whole, sliced = (np.zeros(len(phrases), np.int64) for _ in range(2))
    trie = collocations.Trie(*zip(*phrases))
    trie.count("x", data, 0, whole)
    for lang, part, known in collocations._cut("x", data):
        trie.count(lang, part, known, sliced)
    want = [sum(f" {p} " in f" {' '.join(w[i:i + len(p.split())])} " for w in map(str.split, data.decode().split("."))
                for i in range(len(w) - len(p.split()) + 1)) for _, p in phrases]
    assert whole.tolist() == sliced.tolist() == want and min(want) > 0


def test_hashes_of_words_are_those_of_their_bytes():
    data = "one two.one \x00odd  two ünï".encode()
    starts, ends, hashes, together = collocations.word_hashes(data)
    words = [data[a:b] for a, b in zip(starts, ends)]
    assert words == [b"one", b"two", b"one", b"\x00odd", b"two", "ünï".encode()]
    assert together.tolist() == [True, False, True, True, True, False]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[4] and len(set(hashes.tolist())) == 4
    assert [int(collocations.word_hashes(w)[2][0]) for w in words] == hashes.tolist()


def test_no_cell_of_a_trie_is_used_twice():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(300)]
    phrases = sorted({(str(rng.choice(["a", "b"])), " ".join(rng.choice(vocabulary, rng.integers(1, 5)))) for _ in range(3_000)})
    trie = collocations.Trie(*zip(*phrases))
    held = io.BytesIO()
    trie.save(held)
    held.seek(0)
    trie = collocations.Trie.load(held)
    counts = np.zeros(len(phrases), np.int64)
    for lang, phrase in phrases:
        trie.count(lang, phrase.encode(), 0, counts)
    want = collections.Counter()
    for lang, phrase in phrases:
        words = phrase.split()
        want.update((lang, " ".join(words[i:j])) for i in range(len(words)) for j in range(i + 1, len(words) + 1))
    assert counts.tolist() == [want[p] for p in phrases]
    assert np.count_nonzero(trie.check >= 0) == len(trie.base) - len(trie.roots)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], DOCUMENT)
    assert collocations.collocations(empty).count() == 0
    assert hashlib.sha256(b"").hexdigest() == conversations.NO_ENDS


def odd_hashes(spark, parts):
    texts = spark.createDataFrame(odd_texts(), DOCUMENT).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").repartition(parts)
    words = collocations.word_counts(texts).filter("a >= 30")
    return texts, collocations.frequent_hashes(texts, words, 30)


def test_a_candidate_is_listed_by_one_task_only(spark):
    texts, hashes = odd_hashes(spark, 6)
    assert hashes.select("at").distinct().count() > 1
    rows = collocations.listed(texts, collocations.hash_files(hashes)).collect()
    assert len(rows) == len({(r.lang, r.phrase) for r in rows}) == hashes.count()


@pytest.mark.parametrize("change", ["at + 1000 AS at, n", "at, n + 1 AS n"])
def test_no_phrase_is_lost_if_partitions_move_or_phrases_share_a_hash(spark, change):
    texts, hashes = odd_hashes(spark, 3)
    want = sorted(collocations.frequent_phrases(texts, hashes, 30).collect())
    assert want and sorted(collocations.frequent_phrases(texts, hashes.selectExpr("h", *change.split(", ")), 30).collect()) == want
