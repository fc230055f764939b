"""Assigning documents to shards of near-equal bytes, copies together: longest processing time first.

Groups of equal texts, sorted by size, go to the least-loaded bin through a heap. One heap over all groups would be
one task, so this is done in levels: groups are dealt to buckets by their key, each bucket fills ``shards`` bins of
its own, and the bins are the groups of the next level, ``FAN_IN`` buckets at a time, until one bucket is left whose
bins are the shards. No task sees more than a bucket, and the number of levels grows with the logarithm of the input.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from redpencil.llm.common import content_key, partitions_for
from redpencil.session import materialize

GROUPS_PER_BUCKET = 20_000
FAN_IN = 64
#: Rows numbered by one task.
ROWS_PER_RUN = 20_000
ROW_OVERHEAD = 16


def least_loaded(sizes: list[int], bins: int) -> list[int]:
    """The bin of each size: descending, ties in the given order, to the least-loaded bin (of equals the first)."""
    heap = [(0, k) for k in range(bins)]
    place = [0] * len(sizes)
    for at in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        load, k = heap[0]
        place[at] = k
        heapq.heapreplace(heap, (load + sizes[at], k))
    return place


def _fill(groups: DataFrame, bins: int, key_type: str) -> DataFrame:
    """``key, bucket, bin, bytes`` of ``key, bucket, bytes``."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], ignore_index=True)
        return pdf.assign(bin=pd.Series(least_loaded(pdf["bytes"].tolist(), bins), dtype="int32"))
    return groups.groupBy("bucket").applyInPandas(run, f"key {key_type}, bucket long, bytes long, bin int")


def assign_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: equal texts share a shard, slots count from 0 in each.

    A null text has no bytes and is grouped with the empty text. Repeated rows count each; null ids are numbered
    like others; an empty table gives no rows. Other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + ROW_OVERHEAD).alias("size"),
                       F.crc32(body).alias("text_crc32"), content_key(F.col(text)).alias("key"))
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = materialize(groups, "shard-groups")
    buckets = partitions_for(groups.count(), GROUPS_PER_BUCKET)
    level = groups.select("key", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("long").alias("bucket"), "bytes")
    filled = materialize(_fill(level, shards, "binary"), "shard-bins")
    placed = filled.select("key", "bucket", "bin")
    while buckets > 1:
        # the bins of FAN_IN buckets are the groups of their parent
        bins = filled.groupBy("bucket", "bin").agg(F.sum("bytes").alias("bytes")).select(
            (F.col("bucket") * shards + F.col("bin")).cast("long").alias("key"),
            F.floor(F.col("bucket") / FAN_IN).cast("long").alias("bucket"), "bytes")
        filled = materialize(_fill(bins, shards, "long"), "shard-bins")
        step = filled.select(F.floor(F.col("key") / shards).cast("long").alias("bucket"),
                             F.pmod("key", F.lit(shards)).cast("int").alias("bin"),
                             F.col("bucket").alias("parent"), F.col("bin").alias("parent_bin"))
        placed = placed.join(step, ["bucket", "bin"]).select(
            "key", F.col("parent").alias("bucket"), F.col("parent_bin").alias("bin"))
        buckets = partitions_for(buckets, FAN_IN)
    shard = rows.join(placed.select("key", F.col("bin").alias("shard")), "key").drop("key")
    return number_slots(shard, "shard", rows.count())


def number_slots(rows: DataFrame, shard: str, count: int) -> DataFrame:
    """Add ``slot``, 0 and up within each shard without a gap; no task numbers a whole shard.

    Runs of a shard are numbered apart, each from the sum of the runs before it.
    """
    runs = partitions_for(count, ROWS_PER_RUN)
    rows = materialize(rows.withColumn("_run", F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit(1)), F.lit(runs))), "shard-placed")
    sizes = rows.groupBy(shard, "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(shard, "_run").orderBy("doc_id", "text_crc32"))
    numbered = rows.withColumn("_k", within - 1).join(starts, [shard, "_run"])
    return numbered.withColumn("slot", (F.col("_start") + F.col("_k")).cast("long")).drop("_run", "_k", "_start")
