"""Ordered-table utilities with tiny buckets against plain Python."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from redpencil.operators import tables


def frame(spark, values, by=None):
    rows = [(i, v, (by or ["k"] * len(values))[i]) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "pos long, v string, k string").repartition(5)


@pytest.mark.parametrize("width", [1, 3, 1000])
@pytest.mark.parametrize("n", [0, 1, 2, 7, 8])
def test_pairs(spark, width, n):
    letters = list("abcdefgh")[:n]
    ends = letters[1:] + [None]
    apart = [tuple(r)[1:] for r in tables.pairs(frame(spark, letters), "v", "pos", width=width).orderBy("pos").collect()]
    assert apart == list(zip(letters, ends))[::2]
    both = [tuple(r)[1:] for r in tables.pairs(frame(spark, letters), "v", "pos", overlapping=True, width=width).orderBy("pos").collect()]
    assert both == list(zip(letters, ends))[:n if n % 2 else max(n - 1, 0)]


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_blocks_by_key(spark, width):
    values = list("#ab##c#d") + list("x#y#")
    keys = ["k"] * 8 + ["m"] * 4
    got = tables.blocks(frame(spark, values, keys), F.col("v") == "#", "pos", "v", by=["k"], joiner="+", width=width)
    rows = [(r.k, r.text) for r in got.orderBy("k", "block_id").collect()]
    assert rows == [("k", "a+b"), ("k", "c"), ("k", "d"), ("m", "x"), ("m", "y")]


def test_prefix_sum_with_hot_key(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("k"))
    got = tables.prefix_sum(df, F.lit(1), "n", "id", ["k"], width=64)
    assert got.groupBy("k").agg(F.max("n").alias("n")).where("k = 'hot'").first().n == 3333
    assert got.where("k = 'rare'").where("n <> id / 3 + 1").count() == 0


def test_uniq_and_extremes(spark):
    df = frame(spark, list("baBcAb"))
    assert [r.v for r in tables.uniq(df, F.lower("v"), "pos").orderBy("pos").collect()] == list("bac")
    assert sorted(r.v for r in tables.uniq(df, F.when(F.lower("v") != "a", F.lower("v")), "pos").collect()) == ["a", "b", "c"]
    plan = tables.uniq(df, F.lower("v"), "pos")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    rows = spark.createDataFrame([("g", "x", 2), ("g", "y", 5), ("g", "w", 5), ("h", "z", 1)], "g string, k string, v int")
    pick = lambda *a: {r.g: (r.k, r.v) for r in tables.extreme_entry(rows, "k", "v", *a, by=["g"]).collect()}
    assert pick(True, True) == {"g": ("w", 5), "h": ("z", 1)}
    assert pick(False, True) == {"g": ("x", 2), "h": ("z", 1)}
    assert pick(True, False) == {"g": ("y", 5), "h": ("z", 1)}
    assert [r.k for r in tables.sort_entries(rows, "k", "v", True, True).collect()] == ["w", "y", "x", "z"]
    assert [r.k for r in tables.sort_entries(rows, "k", "v").collect()] == ["w", "x", "y", "z"]


def test_softmax_and_grid(spark):
    values = [1000.0, 1001.0, 999.0]
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate(values)], "i long, g string, v double")
    got = [r.p for r in tables.softmax(df, "v", "p", ["g"]).orderBy("i").collect()]
    weights = [math.exp(v - 1001) for v in values]
    assert got == pytest.approx([w / sum(weights) for w in weights])
    wide = [-700.0, 0.0, 31.9, 32.0, 700.0, 701.5]
    df = spark.createDataFrame([(i, "g", v) for i, v in enumerate(wide)], "i long, g string, v double")
    found = tables.softmax(df, "v", "p", ["g"])
    weights = [math.exp(v - 701.5) for v in wide]
    assert [r.p for r in found.orderBy("i").collect()] == pytest.approx([w / sum(weights) for w in weights], rel=1e-12)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2 and plan.count("Join") == 1

    def grid(*args):
        return [r.value for r in tables.frange(spark, *args).orderBy("id").collect()]

    def plain(start, end, inc):
        out = itertools.takewhile(lambda x: x < end if inc > 0 else x > end, (start + k * inc for k in itertools.count()))
        return list(out)
    for args in [(0.0, 1.0, 0.1), (1.0, -1.0, -0.3), (2.0, 2.0, 1.0), (0.0, 5.0, 2.5), (3.0, 1.0, 1.0)]:
        assert grid(*args) == plain(*args)
    assert grid(3) == [0.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        tables.frange(spark, 0, 1, 0)


def test_collate(spark):
    df = spark.range(10).select("id", (F.col("id") * 2).alias("d"), F.col("id").cast("string").alias("s")).repartition(4)
    rows = tables.collate(df, "id", ["d", "s"], 4).orderBy("batch_id").collect()
    assert [r.d for r in rows] == [[0, 2, 4, 6], [8, 10, 12, 14], [16, 18]] and rows[2].s == ["8", "9"]
