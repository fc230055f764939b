"""Ordered-table utilities. Order is cut into position buckets, so no key needs a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BUCKET_ROWS = 1 << 16


def _bucketed(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_bucket", F.expr(f"`{order}` div {width}"))


def _over_buckets(by: list[str]):
    return (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_bucket")


def prefix_sum(df: DataFrame, value: Column, name: str, order: str, by: list[str] = (),
               width: int = BUCKET_ROWS) -> DataFrame:
    """Running sum of ``value`` up to and including each row, in ``order`` within ``by``.

    Rows sum inside buckets of ``width`` positions; one row per bucket carries the sums across.
    ``order`` is a unique integer position.
    """
    by = list(by)
    cells = _bucketed(df, order, width).withColumn("_value", value)
    totals = cells.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_total"))
    before = _over_buckets(by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumn("_inside", F.sum("_value").over(inside))
    return summed.join(offsets, by + ["_bucket"]).select(
        *df.columns, (F.col("_before") + F.col("_inside")).alias(name))


def pairs(df: DataFrame, value: str, order: str, by: list[str] = (), overlapping: bool = False,
          width: int = BUCKET_ROWS) -> DataFrame:
    """Neighbouring values as ``(first, second)``.

    Without overlap rows 0-1, 2-3, ... pair up. When the number of rows is odd the last row is
    paired with null; with overlap and an even number there is no such row.

    A row's place and follower come from one window inside its bucket; one row per bucket carries the
    number of rows before it and the first value of the next bucket.
    """
    by = list(by)
    cells = _bucketed(df.select(*by, order, value), order, width).withColumn("_cell", F.struct(F.col(value).alias("v")))
    totals = cells.groupBy(*by, "_bucket").agg(F.count("*").alias("_rows"), F.min(F.struct(F.col(order).alias("at"), "_cell")).alias("_first"))
    over = _over_buckets(by)
    borders = totals.select(*(F.col(b).alias(f"_by_{b}") for b in by), F.col("_bucket").alias("_of"), F.lead("_first").over(over)["_cell"].alias("_ahead"),
                            F.coalesce(F.sum("_rows").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(order)
    placed = cells.withColumn("_place", F.row_number().over(inside)).withColumn("_next", F.lead("_cell").over(inside))
    same = F.col("_bucket").eqNullSafe(F.col("_of"))
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    following = F.coalesce("_next", "_ahead")
    first_of_pair = (F.col("_before") + F.col("_place")) % 2 == 1
    keep = following.isNotNull() | first_of_pair if overlapping else first_of_pair
    return placed.join(borders, same).where(keep).select(*by, order, F.col(value).alias("first"), following["v"].alias("second"))


def blocks(df: DataFrame, is_separator: Column, order: str, line: str, by: list[str] = (),
           joiner: str = "", width: int = BUCKET_ROWS) -> DataFrame:
    """Join the lines between separator rows: ``by, block_id, text``. No separator run makes an
    empty block; block ids grow with position. A block is one text value and is collected as such."""
    by = list(by)
    marked = prefix_sum(df, is_separator.cast("long"), "block_id", order, by, width)
    grouped = marked.where(~is_separator).groupBy(*by, "block_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("p"), F.col(line).alias("l")))).alias("lines"))
    return grouped.select(*by, "block_id", F.array_join(F.transform("lines", lambda x: x["l"]), joiner).alias("text"))


def uniq(df: DataFrame, key: Column | str, order: str, by: list[str] = ()) -> DataFrame:
    """First row per key, in a unique ``order`` without nulls.

    The least position of each key is found on 128 bits of it, in a hash aggregate that combines before the shuffle, so
    hot keys are cheap and long keys don't move; then a semi-join keeps the rows at these positions.
    """
    key = F.col(key) if isinstance(key, str) else key
    keyed = df.select("*", F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(1), key).alias("_h2"))
    group = [*by, "_h1", "_h2"]
    firsts = keyed.groupBy(*(F.col(c).alias(f"_of_{c}") for c in group)).agg(F.min(order).alias("_least"))
    same = F.col(order) == F.col("_least")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return keyed.join(firsts, same, "left_semi").drop("_h1", "_h2")


def sort_entries(df: DataFrame, key: str, value: str, by_value: bool = False, reverse: bool = False) -> DataFrame:
    """Key/value rows in order of key, or of value with the key as tie-break."""
    direction = F.desc if reverse else F.asc
    return df.orderBy(*([direction(value), F.asc(key)] if by_value else [direction(key)]))


def extreme_entry(df: DataFrame, key: str, value: str, largest: bool, by_value: bool = False,
                  by: list[str] = ()) -> DataFrame:
    """The entry with the largest or smallest key or value per group; ties go to the smallest key."""
    if not by_value:
        pick = F.max if largest else F.min
        entry = pick(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))
        return df.groupBy(*by).agg(entry.alias("e")).select(*by, F.col("e.k").alias(key), F.col("e.v").alias(value))
    best_rows = df.groupBy(*by, value).agg(F.min(key).alias(key))
    pick = F.max if largest else F.min
    entry = pick(F.struct(F.col(value).alias("v"), F.col(key).alias("k"))).alias("e")
    return best_rows.groupBy(*by).agg(entry).select(*by, F.col("e.k").alias(key), F.col("e.v").alias(value))


SCALE_STEP = 32.0


def softmax(df: DataFrame, value: str, name: str, by: list[str]) -> DataFrame:
    """Softmax within groups, shifted by the group maximum.

    Maximum and sum come from one pass: rows of a group add up in classes of ``SCALE_STEP``, each sum scaled to its
    class so that nothing overflows, and a group's classes are then brought to the scale of its maximum. The
    aggregates combine before the shuffle, and joining a group's row back is split like any skewed join.
    """
    by = list(by)
    base = F.floor(F.col(value) / SCALE_STEP).cast("double") * SCALE_STEP
    classes = df.groupBy(*by, base.alias("_base")).agg(F.max(value).alias("_top"), F.sum(F.exp(F.col(value) - base)).alias("_sum"))
    peaks = classes.withColumn("_peak", F.max("_top").over(Window.partitionBy(*by)))
    groups = peaks.groupBy(*by).agg(F.max("_peak").alias("_top"), F.sum(F.col("_sum") * F.exp(F.col("_base") - F.col("_peak"))).alias("_mass"))
    return df.join(groups, by).select(*df.columns, (F.exp(F.col(value) - F.col("_top")) / F.col("_mass")).alias(name))


def frange(spark: SparkSession, start: float, end: float | None = None, inc: float = 1.0) -> DataFrame:
    """Values start, start + inc, ... short of ``end``; one argument counts from 0.0."""
    if end is None:
        start, end = 0.0, float(start)
    if inc == 0:
        raise ValueError("inc must not be 0")
    count = max(0, int((end - start) / inc) + 1)
    value = F.lit(float(start)) + F.col("id") * F.lit(float(inc))
    inside = F.col("value") < end if inc > 0 else F.col("value") > end
    return spark.range(count + 1).select("id", value.alias("value")).where(inside)


def frange_rows(df: DataFrame, end: Column, inc: float = 1.0) -> DataFrame:
    """Each row with the values 0.0, inc, ... short of its ``end``, as ``value``; ``inc`` is above 0."""
    if inc <= 0:
        raise ValueError("inc must be above 0")
    steps = F.ceil(end / inc).cast("long")
    counted = df.withColumn("value", F.explode(F.when(steps > 0, F.sequence(F.lit(0).cast("long"), steps - 1))))
    return counted.withColumn("value", F.col("value") * F.lit(float(inc)))


def collate(df: DataFrame, position: str, columns: list[str], batch_size: int) -> DataFrame:
    """Rows to batches of ``batch_size`` positions, one list per column, in position order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(position).alias("_p"), *columns)))
    batches = df.groupBy(F.expr(f"`{position}` div {batch_size}").alias("batch_id")).agg(rows.alias("rows"))
    return batches.select("batch_id", *(F.col("rows")[c].alias(c) for c in columns))
