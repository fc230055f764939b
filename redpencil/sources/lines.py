"""Line files: reading with stable line numbers, writing in order, saving prepared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from redpencil.functions.text import strip


def number_rows(df: DataFrame, name: str) -> DataFrame:
    """Number the rows of a file scan from zero in file and line order.

    Only one row per file split passes through the offset window; the rows themselves stay in
    place. The offsets are broadcast: three numbers per file split, some 20 MB for the splits of
    100 TB. ``df`` must carry ``_file`` and ``_block`` from :func:`file_position`.
    """
    tagged = df.withColumn("_row", F.monotonically_increasing_id())
    tagged = tagged.withColumn("_part", F.shiftright("_row", 33))
    splits = tagged.groupBy("_part", "_file", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_part", F.struct("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")).alias("_split"))
    # a partition reads its splits one after the other: a row is in the last one that begins before it
    offsets = offsets.groupBy("_part").agg(F.array_sort(F.collect_list("_split")).alias("_splits"))
    numbered = tagged.join(F.broadcast(offsets), "_part")
    own = F.element_at(F.filter("_splits", lambda s: s["_first"] <= F.col("_row")), -1)
    rest = [c for c in df.columns if c not in ("_file", "_block")]
    return numbered.select((own["_offset"] + F.col("_row") - own["_first"]).alias(name), *rest)


def file_position() -> list[Column]:
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """``sent_id, text``: one stripped sentence per line, empty lines kept; ``.gz`` is read by suffix."""
    lines = spark.read.text(path, lineSep="\n").select(strip(F.col("value")).alias("text"), *file_position())
    return number_rows(lines, "sent_id")


def write_sentences(df: DataFrame, path: str, text: str = "text", order: str = "sent_id",
                    single_file: bool = False, compression: str | None = None) -> None:
    """One sentence per line in ``order``; line breaks inside a sentence become spaces."""
    value = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit(" ")).alias("value")
    if single_file:
        rows = df.select(order, value).repartition(1).sortWithinPartitions(order)
    else:
        rows = df.select(order, value).orderBy(order)
    rows.select("value").write.text(path, compression=compression, lineSep="\n")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``block_id, text``: runs of lines between empty lines, joined by line breaks."""
    raw = spark.read.text(path, lineSep="\n\n").select(
        F.regexp_replace("value", r"\A\n+|\n+\z", "").alias("text"), *file_position())
    return number_rows(raw.where(F.col("text") != ""), "block_id")


def read_parallel(spark: SparkSession, path: str) -> DataFrame:
    """``pair_id, source, target`` from tab-separated text without header or quoting.

    An empty field is null; words such as ``NA`` stay text.
    """
    pairs = spark.read.csv(path, schema="source string, target string", sep="\t", header=False,
                           quote="", escape="", lineSep="\n")
    return number_rows(pairs.select("source", "target", *file_position()), "pair_id")


def write_parallel(df: DataFrame, path: str, order: str = "pair_id") -> None:
    """Tab-separated source and target; tabs and line breaks inside a field become spaces."""
    field = lambda c: F.translate(F.coalesce(F.col(c), F.lit("")), "\t\n", "  ")
    rows = df.orderBy(order).select(F.concat_ws("\t", field("source"), field("target")).alias("value"))
    rows.write.text(path, lineSep="\n")


def save_dataset(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
