"""From raw documents to packed sequences: five stages, each one of the text operators.

run() writes what a stage returns as Parquet in the folder that all executors
share and reads it again for the next one, so no stage depends on the
lineage of those before. A stage's input is deleted once its output is written; the
input of the last one stays, for the result is read lazily.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables
(an empty result) and further columns, whatever their names, as its operator's
docstring says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.llm import language, nearcopies, packing, rules, secrets
from quillstone.llm.common import read_table, remainder, shared_folder
from quillstone.llm.queries import vocabulary
from quillstone.sources.storage import Folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a clear language go, null texts and texts without a letter among them. Equal texts share a verdict."""
    return language.accepted(docs, language.train(docs, remainder("doc_id", 3) != 1))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a threshold rejects go, null and empty texts among them. Equal texts share a verdict."""
    return rules.kept_rows(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id: SimHash over
    five-word shingles, similarity 0.8 or more. Rows with a null id name no document and stay; rows with one id and
    unrelated texts stay both."""
    return nearcopies.one_of_each_group(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays. Null texts stay null."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of token sequences; a null text is an empty document, its end token."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Compression, sets of shingles and tokenizers are beyond SQL: the
#: pipeline is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that the stages keep."""
    docs = read_table(spark, sf_dir, "documents")
    folder = Folder(spark, f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        path = folder.path(f"{n}.parquet")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if n:
            folder.remove(f"{n - 1}.parquet")
    return STAGES[-1][1](spark, docs, sf_dir)
