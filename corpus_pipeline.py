"""Training corpus from raw documents: rules, language, near copies, mixture, packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before kept.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexarium.llm import jaccard_join, language_id, mixing, packing, quality_rules
from lexarium.session import importable
from lexarium.storage import mark, new_path, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found, with ``lang`` set to it; the models learn from ``lang`` of this stage's input."""
    return language_id.keep_identified(docs, language_id.learn(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard likeness of 0.8 or more on five-word shingles."""
    return jaccard_join.keep_one(docs, jaccard_join.Setting(n=5, least=80))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixing.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("best-fit packing", sequences),
]

#: Suffix arrays, language models and packing have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is written to the shared folder, and freed with all that its stage wrote
    once the next stage's result is there."""
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        began = mark()
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = new_path(spark, name.replace(" ", "-"))
            docs.write.option("compression", "zstd").parquet(path)
            # the stage's own tables, and the table before; the new one is the last of the list
            release(spark, began - (i > 0), -1)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
