import numpy as np
import pytest
from pyspark.sql import functions as F

from redpencil.llm import negative_tree


def brute(rows, asks, positives=5, negatives=3, least=50, most=95):
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and all(x is not None for x in r[2])]
    size = max({len(r[2]) for r in good}, key=lambda n: (sum(len(r[2]) == n for r in good), -n))
    good = [(i, label, tuple(v)) for i, label, v in good if len(v) == size]
    out = []
    for i, label, v in sorted(set(r for r in good if asks(r[0]))):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in good if j != i or other != label)
        best = [(-s, j) for s, j, other in scored if other == label][:positives]
        for score, j in best:
            near = [(-s, k) for s, k, other in scored if other != label and least * score <= -100 * s <= most * score][:negatives]
            out += [(i, j, n + 1, k, score, s) for n, (s, k) in enumerate(near)]
    return sorted(out)


def rows_of(seed, size=8, n=400):
    r = np.random.default_rng(seed)
    centres = r.integers(-40, 40, (6, size))
    rows = [(k, int(r.integers(0, 3)), (centres[k % 6] + r.integers(-25, 26, size)).tolist()) for k in range(n)]
    rows += [(1000 + k, k % 2, rows[10][2]) for k in range(120)]                  # a point that many rows share
    rows += [(2000, None, rows[0][2]), (2001, 1, None), (None, 1, rows[0][2]), (2002, 1, [1, None] + [0] * (size - 2)), (2003, 1, [1, 2]), (2004, 1, [])]
    rows += [(2050, 1, [0] * size), rows[50], rows[50], (50, 2, rows[3][2]), (2005, 0, [3000] * size)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "id long, label int, vector array<long>, subtree string").repartition(3)


@pytest.mark.parametrize("chunk,splits,leaves", [(4096, 24, 12), (16, 5, 3), (40, 1, 1)])
def test_equals_brute_force(spark, monkeypatch, chunk, splits, leaves):
    for name, value in {"CHUNK_ROWS": chunk, "SPLITS": splits, "LEAVES": leaves, "ANCHORS": 7, "TOGETHER": 3, "SAMPLE": 90}.items():
        monkeypatch.setattr(negative_tree, name, value)
    rows = rows_of(chunk)
    found = negative_tree.hard_negatives(frame(spark, rows), F.col("id") % 25 == 0)
    expected = brute(rows, lambda i: i % 25 == 0)
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 20


def test_other_bounds(spark):
    rows = rows_of(5, n=150)
    found = negative_tree.hard_negatives(frame(spark, rows), F.col("id") % 10 == 0, positives=2, negatives=4, least=10, most=100)
    assert sorted(map(tuple, found.collect())) == brute(rows, lambda i: i % 10 == 0, 2, 4, 10, 100)


def test_without_anchors_or_rows(spark):
    df = frame(spark, rows_of(6, n=30))
    for rows, asks in ((df.limit(0), F.lit(True)), (df, F.lit(False)), (df.where("id = 3"), F.lit(True)), (df, F.lit(None).cast("boolean"))):
        assert negative_tree.hard_negatives(rows, asks).count() == 0


def test_ranges_eliminate_siblings():
    """Two far groups: a window around one leaves the other's subtree out, and no answer is lost."""
    r = np.random.default_rng(1)
    near, far = r.integers(90, 110, (50, 4)), r.integers(-110, -90, (50, 4))
    points = negative_tree.lift(np.concatenate([near, far]).astype(float), 60_000.0)
    centres = points[[0, 50]]
    gaps = negative_tree.distances(points, centres)
    child = gaps.argmin(axis=1)
    ranges = negative_tree.ranges_of(gaps, child, 2)
    anchors = near[:5].astype(float)
    annuli = negative_tree.Annuli(anchors, np.full(5, 30_000), np.full(5, 50_000), 60_000.0)
    assert annuli.meet(centres, ranges).tolist() == [[True, False]] * 5
    everything = negative_tree.Annuli(anchors, np.full(5, negative_tree.LOW), np.full(5, negative_tree.HIGH), 60_000.0)
    assert everything.meet(centres, ranges).all()
