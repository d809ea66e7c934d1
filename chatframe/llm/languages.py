"""Language identification by compression.

Each language has a zstandard dictionary of raw content: sentences of its training documents.
A text is cut into blocks of ``BLOCK`` bytes, and every block is encoded once with each
dictionary.  The language whose encodings are smallest in total is chosen, since its dictionary
predicts the text best.  The score is that language's share of the likelihood: a bit saved
counts as ``EVIDENCE`` of a bit, because encoders count whole bytes.  Texts with a score below
``narrow`` are marked as rejected.

Encoders spend whole bytes and need some text to save any, so short and repetitive texts come
out alike.  Where the fast encodings differ by less than ``CLEAR_BYTES`` bytes or ``CLEAR_SHARE``
of the smallest, the distinct words of the text are encoded once more behind ``PRIMERS`` samples
of each language, with a slow search; what a sample alone takes is subtracted.

The dictionaries are made from a bounded sample: at most ``dictionary_bytes`` of distinct
sentences for each language, chosen by hash, and ``TOTAL_BYTES`` for all languages together.
Every document is read to choose them, and every whole text is encoded.

``lang`` is a learned value; ``und`` stands for a null text, a text without letters, or for
all texts if nothing was learned.  Ties go to the language that comes first in order.  A null
``lang`` teaches nothing; ids that are null count as empty text; equal rows get a row each; very
long texts are encoded block by block; other columns are kept or ignored, never read.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import stored

DICTIONARY_BYTES = 112 << 10
TOTAL_BYTES = 64 << 20
BLOCK = 4_096
SENTENCE_BYTES = 400
PRIMERS, PRIMER_BYTES = 4, 2_048
CLEAR_BYTES, CLEAR_SHARE = 16, 0.01
NARROW = 0.6
EVIDENCE = 0.5
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_NO_WORD = re.compile(r"[\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]{1,%d}" % SENTENCE_BYTES)


def held_out(doc_id: str = "doc_id", folds: int = 3) -> Column:
    """The documents that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 1


def _place(*values: Column) -> Column:
    """A number in [0, 1) that depends on the values only."""
    return F.pmod(F.xxhash64(*values), F.lit(1 << 30)) / (1 << 30)


def sampled_sentences(docs: DataFrame, dictionary_bytes: int) -> DataFrame:
    """``(lang, sentence)``: distinct sentences, about ``dictionary_bytes`` for each language.

    First distinct texts are chosen so that they hold a few times as much, then sentences.
    """
    known = docs.filter(~held_out()).filter("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), "text"
    )
    sizes = known.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size"))
    share = F.least(F.lit(1.0), F.lit(16.0 * dictionary_bytes) / F.greatest("size", F.lit(1)))
    shares = stored(sizes.select("lang", share.alias("share")), "language-shares")
    texts = known.join(shares, "lang").filter(_place(F.col("text")) < F.col("share")).select("lang", "text").distinct()

    def cut(batches):
        for batch in batches:
            langs, sentences = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = {s.strip() for s in _SENTENCE.findall(text.as_py())}
                found = [s for s in found if _LETTER.search(s)]
                langs += [lang] * len(found)
                sentences += found
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(sentences, pa.string())], ["lang", "sentence"])

    sentences = stored(texts.mapInArrow(cut, "lang string, sentence string").distinct(), "sentences")
    sizes = sentences.groupBy("lang").agg(F.sum(F.octet_length("sentence")).alias("size"))
    share = F.lit(1.1 * dictionary_bytes) / F.col("size")
    chosen = sentences.join(sizes.select("lang", share.alias("share")), "lang")
    return chosen.filter(_place(F.col("lang"), F.col("sentence")) < F.col("share")).select("lang", "sentence")


def fit(docs: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES, total_bytes: int = TOTAL_BYTES) -> dict[str, bytes]:
    """A dictionary for each learned language; smaller ones if the languages are very many."""
    n = docs.filter(~held_out()).filter("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string")).distinct().count()
    if not n:
        return {}
    each = min(dictionary_bytes, total_bytes // n)
    rows = sampled_sentences(docs, each).orderBy("lang", F.xxhash64("sentence"), "sentence").collect()
    found: dict[str, list[bytes]] = {}
    for row in rows:
        found.setdefault(row["lang"], []).append(row["sentence"].encode())
    return {lang: b". ".join(some)[:each] for lang, some in sorted(found.items())}


def blocks_of(data: bytes):
    return (data[a : a + BLOCK] for a in range(0, len(data), BLOCK))


class Coder:
    """Compressors for every language, a fast and a thorough one."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard as z

        self.langs = list(dictionaries)
        self.fast, self.thorough, self.primers = [], [], []
        for content in dictionaries.values():
            rest, tail = content[: -PRIMERS * PRIMER_BYTES], content[-PRIMERS * PRIMER_BYTES :]
            primers = [tail[a : a + PRIMER_BYTES] for a in range(0, len(tail), PRIMER_BYTES)] or [b""]
            for kind, given, params in (
                (self.fast, content, {"hash_log": 14, "chain_log": 14, "search_log": 1, "strategy": z.STRATEGY_DFAST}),
                (self.thorough, rest or content, {"hash_log": 15, "chain_log": 15, "search_log": 3, "strategy": z.STRATEGY_LAZY2}),
            ):
                params = z.ZstdCompressionParameters(
                    **params, window_log=18, min_match=4, target_length=16,
                    write_content_size=False, write_checksum=False, write_dict_id=False,
                )
                known = z.ZstdCompressionDict(given or b" " * 8, dict_type=z.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(compression_params=params)
                kind.append(z.ZstdCompressor(dict_data=known, compression_params=params))
            coder = self.thorough[-1]
            self.primers.append([(x, len(coder.compress(x))) for x in primers])

    def sizes(self, text: str) -> list[float]:
        """Bytes of the encodings, by language."""
        sizes = [float(sum(len(c.compress(b)) for b in blocks_of(text.encode()))) for c in self.fast]
        best, second = sorted([*sizes, math.inf])[:2]
        if second - best >= max(CLEAR_BYTES, CLEAR_SHARE * best):
            return sizes
        words = dict.fromkeys(_NO_WORD.sub(" ", text.lower()).split())
        blocks = list(blocks_of(" ".join(words).encode()))
        for i, (coder, primers) in enumerate(zip(self.thorough, self.primers)):
            more = sum(len(coder.compress(x + b". " + b)) - n for b in blocks for x, n in primers)
            sizes[i] += more / len(primers)
        return sizes

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and its share of the likelihood."""
        if not self.langs or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0
        sizes = self.sizes(text)
        best = min(sizes)
        shares = [2.0 ** max(-1_000.0, (best - s) * 8 * EVIDENCE) for s in sizes]  # the best one's is 1
        return self.langs[sizes.index(best)], 1.0 / math.fsum(shares)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str] | None = None, narrow: float = NARROW, result: str = "_language") -> DataFrame:
    """The columns ``keep`` (all by default) of every document and a struct, ``result``.

    The struct: the language, the score, and whether it is rejected as too narrow.
    """
    keep = docs.columns if keep is None else keep
    columns = keep if "text" in keep else [*keep, "text"]
    place, n = columns.index("text"), len(keep)
    df = docs.select(*(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(columns)))
    struct = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields[:n])
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        coder = Coder(sent.value)
        for batch in batches:
            found = []
            for x in batch.column(place):
                lang, score = coder.predict(x.as_py())
                found.append({"lang": lang, "score": score, "rejected": score < narrow})
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(found, struct)], [*batch.schema.names[:n], "_language"]
            )

    return df.mapInArrow(run, schema + "_language struct<lang:string,score:double,rejected:boolean>").select(
        *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)), F.col("_language").alias(result)
    )
