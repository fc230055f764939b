"""Corpus filters and reproducible samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from redpencil.functions.text import equal_ignoring_space_and_case


def changed_pairs(df: DataFrame) -> DataFrame:
    """Pairs with a target that differs from the source; a null source counts as different."""
    return df.where(F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("source")))


def seeded_sample(df: DataFrame, n: int, seed: int, key: str = "pair_id", strict: bool = True) -> DataFrame:
    """The first ``n`` rows of a seeded order that depends on the keys only, not on partitions.

    ``strict`` fails when there are fewer than ``n`` rows. Ranks are hexadecimal hashes. One aggregate counts the rows
    by the rank's first four digits, 65,536 counts at most; the second scan sorts only the ranks up to the digits that
    complete the sample, a few more than ``n`` rows in all.
    """
    ranked = df.withColumn("_rank", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    head = F.conv(F.substring("_rank", 1, 4), 16, 10).cast("int")
    counts = ranked.groupBy(head.alias("head")).count().where("head IS NOT NULL").toArrow()
    heads, rows = (np.asarray(c) for c in counts.columns) if len(counts) else (np.empty(0, np.int64), np.empty(0, np.int64))
    order = np.argsort(heads, kind="stable")
    reached = np.cumsum(rows[order])
    at = int(np.searchsorted(reached, n))
    if at == len(reached):
        if strict and n > (reached[-1] if len(reached) else 0):
            raise ValueError(f"sample of {n} rows asked for, fewer present")
        return df
    return ranked.where(head <= int(heads[order][at])).orderBy("_rank", key).limit(n).drop("_rank")


def drop_space_and_case_edits(df: DataFrame) -> DataFrame:
    return df.where(~equal_ignoring_space_and_case(F.col("original"), F.col("correction")))


def drop_unchanged_edits(df: DataFrame) -> DataFrame:
    return df.where(F.col("original") != F.col("correction"))


def valid_span(start: Column, end: Column, token_count: Column) -> Column:
    """Gold edits whose offsets lie inside the running token count; false for noop spans."""
    return (start >= 0) & (start <= token_count) & (end >= 0) & (end <= token_count)
