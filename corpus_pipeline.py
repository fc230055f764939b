"""From raw documents to packed sequences: toxic documents go, repeated lines go, of near copies one stays, personal
data is masked, and what is left is packed.

Each stage reads all that the one before kept, written as Parquet in the shared folder. All but the last return the
columns of ``documents``. Rows without a document id are scored, masked and packed like others, but repeat nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from redpencil.llm import line_dedup, odd_sketch, packing, pii, toxicity
from redpencil.llm.common import table
from redpencil.llm.queries import tokenizer_path
from redpencil.session import new_path

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under ``TOXIC``; the model is fitted on labelled rows among them."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("row"), "text")
    kept = toxicity.score(rows, model).where(F.col("toxicity.score") < TOXIC)
    return kept.select(*(F.col(f"row.{c}") for c in docs.columns))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those with no other lines go."""
    return line_dedup.drop_repeated_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies over five-word shingles."""
    return odd_sketch.drop_near_duplicates(docs, words=5)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with spans of personal data replaced by their kind in brackets."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens, with their ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("pii", mask_personal_data), ("packing", pack)]

#: The stages are models and tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": (run, ORACLE_SQL)}
