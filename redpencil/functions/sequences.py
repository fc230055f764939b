"""Token-array columns: shrinking and intersection."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def common_prefix(left: Column, right: Column) -> Column:
    """Length of the common prefix of two arrays."""
    same = F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return let(same, lambda same: let(F.array_position(same, F.lit(False)), lambda miss: F.when(
        miss > 0, miss - 1).otherwise(F.size(same)).cast("int")))


def shrink(start: Column, end: Column, original: Column, correction: Column) -> Column:
    """Cut common leading, then common trailing tokens of an edit and move its offsets."""
    tokens = lambda text: F.array_remove(F.split(text, " "), "")
    rest = lambda array, skip: F.slice(array, skip + 1, F.greatest(F.size(array) - skip, F.lit(0)))
    cut = lambda array, tail: F.array_join(F.slice(array, F.lit(1), F.size(array) - tail), " ")
    pair = lambda orig, corr: F.struct(orig.alias("orig"), corr.alias("corr"))

    def without_head(words, head):
        return let(pair(rest(words["orig"], head), rest(words["corr"], head)), lambda left: let(
            common_prefix(F.reverse(left["orig"]), F.reverse(left["corr"])), lambda tail: F.struct(
                (start + head).alias("start"), (end - tail).alias("end"),
                cut(left["orig"], tail).alias("original"), cut(left["corr"], tail).alias("correction"))))
    return let(pair(tokens(original), tokens(correction)), lambda words: let(
        common_prefix(words["orig"], words["corr"]), lambda head: without_head(words, head)))


def intersect_keeping_duplicates(left: Column, right: Column) -> Column:
    """Elements of ``left`` that occur in ``right``, in order and with repeats."""
    return F.filter(left, lambda x: F.array_contains(right, x))
