"""From raw documents to packed training sequences in five stages, each written and read again.

Defined results: a null or empty text is scored by the quality classifier like any other and goes at the language stage, which
knows no language for a text without a letter; of equal and nearly equal texts the one with the least id stays, whether or
not ids are null or repeat; a null source is a source of its own; very long texts pass whole and are cut only into
sequences; an empty table gives an empty result; other columns, whatever their names, stay with their documents up to
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictlake.llm import jaccard_join, language_id, mixing, packing, quality
from verdictlake.llm.common import drop_staged, new_dir, table
from verdictlake.llm.queries import MOST_TOKENS, tokenizer_path

#: A document stays if its quality score reaches the first, and its predicted language is known with the second.
LEAST_QUALITY, LEAST_LANGUAGE = 0.3, 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learned from the labels of these documents, does not reject."""
    rows, accepted = quality.accepted(docs, table(spark, sf_dir, "labels"), LEAST_QUALITY)
    return rows.where(accepted)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    predict = language_id.predictor(spark, language_id.learn(docs))
    found = docs.select(F.struct("*").alias("own"), predict("text").alias("found"))
    known = found.where((F.col("found.lang_pred") != "und") & (F.col("found.score") >= LEAST_LANGUAGE))
    return known.select(*[F.col("own").getField(c).alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.pack_documents(docs, tokenizer_path(), MOST_TOKENS)


STAGES = [("quality_classifier", keep_quality), ("language_id", keep_language), ("jaccard_join", keep_one_of_each), ("mixing", mix_sources), ("best_fit_packing", pack_sequences)]

#: SQL cannot express the classifiers, the forest or the packing. tests/llm holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = new_dir(spark, f"pipeline-{name}")
        stage(spark, rows, sf_dir).write.parquet(path)
        if i:
            drop_staged(rows)  # the stage before, which nothing reads any more
        rows = spark.read.parquet(path)
    return rows
