"""The queries op1 to op10 over the documents of an input directory, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, fingerprint, language, packing, quality, rules, secrets, simhash, toxicity
from .common import read_table, remainder



def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = brown.score(docs, *(trained := brown.train(docs, remainder("doc_id", 10) != 0)))
    return scored.select("doc_id", (remainder("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(trained[0].train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.train(docs, remainder("doc_id", 3) != 1)
    return language.identify(docs, model, ["doc_id"]).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_neighbours(read_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = quality.score(docs, quality.train(docs, labels, remainder("doc_id", 3) != 1))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, labels, remainder("doc_id", 3) != 1))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_packing, op2_brown, op3_language, op4_order_minhash, op5_simhash, op6_bpe, op7_quality, op8_rules, op9_toxicity, op10_secrets)
}

#: Queries that SQL can express; the others are tested against brute-force versions.
ORACLES: dict[str, str] = {"op8_rules": rules.oracle()}
