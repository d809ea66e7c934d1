"""From raw documents to token ids: five stages, each written and read again.

A stage takes the documents that its predecessor kept and returns documents with the same
columns; the last returns what is in the files of token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatframe.llm import decontamination, mixing, simhash, tokens, toxicity
from chatframe.llm.common import free_name, stored, table
from chatframe.llm.queries import word_bpe


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below a half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "_toxicity")
    return toxicity.score(docs, model, result=name).filter(F.col(name)["score"] < 0.5).drop(name)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    name = free_name(docs, "_hits")
    scanned = decontamination.scan(docs, table(spark, sf_dir, "benchmark"), result=name)
    return scanned.filter(F.size(F.col(name)["starts"]) == 0).drop(name)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them; the files of token ids are in order of ``doc_id``."""
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the files of token ids hold: a row per document."""
    return tokens.read_ids(tokens.write_ids(docs, word_bpe()), with_ids=False)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("token_ids", token_ids),
]

#: No SQL for a trained model and a tokenizer; tests compare every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
