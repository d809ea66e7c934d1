"""Toxicity by multiple-instance learning over sentences.

A document is a bag of sentences.  A sentence has a probability, the logistic function of
the weights of its distinct words; a document is toxic unless none of its sentences is
(noisy-or).  Only labels of documents are known; the gradient of a document's likelihood
goes to the sentences that explain it, and the sentences with a probability of at least a
half are returned as the offending ones.

A word weighs the sum over its features: the word and its beginnings of 3 to 6 letters.
Features are chosen by how unevenly they occur in toxic and other documents.

The model is fitted on about ``sample_rows`` labelled documents at most, half of them of each
label, chosen by a hash of the id; weights make up for the sampling.  Scoring
covers every document, with its whole text.

Null and empty texts have no sentence and the score 0; a null or unknown label is none; if
a document has several labels the largest counts; ids that are null count as empty text;
equal rows are scored each; without labels all scores are nearly 0; other columns are kept
or ignored, never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatframe.llm.common import stored

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """The documents whose labels are never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds == 0


def features_of(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]


def sampled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """``(doc_id, text, y, weight)`` of the labelled documents to learn from.

    The chosen ids, a bounded number, are sent to the tasks that read the texts.
    """
    known = stored(
        labels.filter(~held_out()).filter("toxic in (0, 1) and doc_id is not null")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")),
        "labels",
    )
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    each = sample_rows // 2
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, each / n).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    chosen = stored(known.filter(place < share), "chosen")
    weight = F.when(F.col("y") == 1, max(1.0, sizes.get(1, 0) / each)).otherwise(max(1.0, sizes.get(0, 0) / each))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("weight", weight)


def uneven_features(sample: DataFrame, limit: int, least: int = 5) -> list[str]:
    """The ``limit`` features whose document shares differ most, in standard errors."""

    def count(batches):
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        rows = [0, 0]

        def flush():
            for y, c in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.string()), pa.array([y] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())],
                    ["feature", "y", "n"],
                )
                c.clear()

        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                rows[y] += 1
                words = set(WORD.findall((text.as_py() or "").lower()))
                counts[y].update({f for w in words for f in features_of(w)})
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield from flush()
        yield from flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array(["", ""], pa.string()), pa.array([0, 1], pa.int32()), pa.array(rows, pa.int64())], ["feature", "y", "n"]
        )

    counted = stored(
        sample.select("text", "y").mapInArrow(count, "feature string, y int, n long").groupBy("feature")
        .agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("toxic"), F.sum(F.expr("if(y = 0, n, 0)")).alias("other"))
        .filter(F.col("toxic") + F.col("other") >= least),
        "features",
    )
    totals = counted.filter("feature = ''").first()
    if not totals or not totals["toxic"] or not totals["other"]:
        return []
    n1, n0 = totals["toxic"], totals["other"]
    share = (F.col("toxic") + F.col("other")) / (n1 + n0)
    error = F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    z = F.abs(F.col("toxic") / n1 - F.col("other") / n0) / F.nullif(error, F.lit(0.0))
    best = counted.filter("feature <> ''").select("feature", z.alias("z")).filter("z > 0").orderBy(F.desc("z"), "feature")
    return [r["feature"] for r in best.limit(limit).collect()]


def train(bags: list[tuple[int, float, int, list[list[int]]]], n_features: int, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias from bags ``(label, weight, sentences, features of some sentences)``.

    Adam on the noisy-or likelihood with a small penalty on weights; sentences without
    features all have the probability of the bias.
    """
    y = np.array([b[0] for b in bags], float)
    cost = np.array([b[1] for b in bags], float)
    cost /= cost.sum()
    bare = np.array([b[2] - len(b[3]) for b in bags], float)
    bag_of = np.repeat(np.arange(len(bags)), [len(b[3]) for b in bags])
    sentences = [s for b in bags for s in b[3]]
    sentence_of = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    feature = np.fromiter((f for s in sentences for f in s), np.int64, len(sentence_of))
    params, first, second = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    params[-1] = -7.0
    for step in range(1, steps + 1):
        w, b = params[:-1], params[-1]
        z = b + np.bincount(sentence_of, w[feature], len(sentences))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + math.exp(-b))
        none = np.bincount(bag_of, np.log1p(-p), len(bags)) + bare * math.log1p(-p0)  # log of 1 - P
        some = np.clip(-np.expm1(none), 1e-12, None)
        pull = cost * np.where(y == 1, -np.exp(none) / some, 1.0)  # times p: the slope by z
        gz = pull[bag_of] * p
        grad = np.empty_like(params)
        grad[:-1] = np.bincount(feature, gz[sentence_of], n_features) + 1e-6 * w
        grad[-1] = gz.sum() + (pull * bare).sum() * p0
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        params -= 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return params[:-1], float(params[-1])


class Model:
    """Weights of features and the bias; at most ``features`` entries."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.__init__(*state)

    def weigh(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """The document's probability and its offending sentences."""
        known, none, spans = self.known, 0.0, []
        if len(known) > 500_000:
            known.clear()
        bare = -math.log1p(-1 / (1 + math.exp(-self.bias)))
        lower = (text or "").lower()
        same = len(lower) == len(text or "")  # else places are found in the text as it is
        for m in SENTENCE.finditer(lower if same else text):
            z = 0.0
            for word in set(WORD.findall(m[0] if same else m[0].lower())):
                w = known.get(word)
                if w is None:
                    w = known[word] = self.weigh(word)
                z += w
            if z:
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, z + self.bias))))
                none -= math.log1p(-p)
                if p >= 0.5:
                    spans.append({"start": m.start(), "end": m.end(), "score": p})
            else:
                none += bare
        return -math.expm1(-none), spans


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 16_000, features: int = 1_024) -> Model:
    sample = stored(sampled(docs, labels, sample_rows), "toxicity-sample")
    names = uneven_features(sample, features)
    if not names:
        return Model({}, -20.0)
    numbers = {f: i for i, f in enumerate(names)}
    bag_schema = pa.schema([("y", pa.int32()), ("weight", pa.float64()), ("n", pa.int64()), ("sentences", pa.list_(pa.list_(pa.int32())))])

    def bags(batches):
        for batch in batches:
            rows = []
            for text, y, weight in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, some = 0, []
                for m in SENTENCE.finditer((text.as_py() or "").lower()):
                    n += 1
                    of = [numbers[f] for w in set(WORD.findall(m[0])) for f in features_of(w) if f in numbers]
                    if of:
                        some.append(of)
                rows.append({"y": y, "weight": weight, "n": n, "sentences": some})
            yield pa.RecordBatch.from_pylist(rows, schema=bag_schema)

    def learn(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        if rows:
            weights, bias = train([(r["y"], r["weight"], r["n"], r["sentences"]) for r in rows], len(names))
            yield pa.RecordBatch.from_arrays([pa.array([*weights, bias], pa.float64())], ["weight"])

    packed = stored(
        sample.select("text", "y", "weight").mapInArrow(bags, "y int, weight double, n long, sentences array<array<int>>"), "bags"
    )
    fitted = [r[0] for r in packed.repartition(1).mapInArrow(learn, "weight double").collect()]
    return Model({f: w for f, w in zip(names, fitted) if w}, fitted[-1])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, result: str = "_toxicity") -> DataFrame:
    """The columns ``keep`` (all by default) of every document and a struct, ``result``.

    The struct: the score and the offending sentences as ``(start, end, score)``, in code
    points of the text.
    """
    keep = docs.columns if keep is None else keep
    columns = keep if "text" in keep else [*keep, "text"]
    place, n = columns.index("text"), len(keep)
    df = docs.select(*(F.col(c).alias(f"_keep_{i}") for i, c in enumerate(columns)))
    struct = pa.struct([
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))),
    ])
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields[:n])
    schema += "_toxicity struct<score:double,spans:array<struct<start:int,end:int,score:double>>>"
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = sent.value.score
        for batch in batches:
            found = [dict(zip(("score", "spans"), of(x.as_py()))) for x in batch.column(place)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(found, struct)], [*batch.schema.names[:n], "_toxicity"]
            )

    return df.mapInArrow(run, schema).select(
        *(F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)), F.col("_toxicity").alias(result)
    )
