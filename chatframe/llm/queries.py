"""Registered queries of the corpus operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatframe.llm import (
    collocations, conversations, decontamination, embeddings, language_model, languages, lines, mixing, secrets,
    simhash, tokens, toxicity, warc,
)
from chatframe.llm.common import table
from chatframe.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.round(F.get("positions", F.lit(0)), 9).alias("position"),
    ).orderBy("position", "doc_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.records(warc.read_chunks(segments))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = F.col("_toxicity.score")
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", toxicity.held_out().alias("held_out"), score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        F.size("_toxicity.spans").alias("n_offending"),
    )


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokens.write_ids(table(spark, sf_dir, "documents"), word_bpe())
    return tokens.read_ids(files, with_ids=False)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.report(decontamination.scan(docs, items, keep=["doc_id"]))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(lines.drop_boilerplate(table(spark, sf_dir, "pages")))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages.identify(docs, languages.fit(docs), keep=["doc_id"])
    return found.select(
        "doc_id", languages.held_out().alias("held_out"), F.col("_language.lang").alias("lang_pred"),
        F.col("_language.score").alias("score"), F.col("_language.rejected").alias("rejected"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_token_ids": op4_token_ids,
    "op5_decontamination": op5_decontamination,
    "op6_secrets": op6_secrets,
    "op7_language_model": op7_language_model,
    "op8_simhash": op8_simhash,
    "op9_embeddings": op9_embeddings,
    "op10_lines": op10_lines,
    "op11_conversations": op11_conversations,
    "op12_languages": op12_languages,
    "op13_collocations": op13_collocations,
}
