import math

import numpy as np
import pytest

from redpencil.llm import embedding_join, maxscore


def cosine(a, b):
    a, b = (np.array(x) / np.abs(x).max() for x in (a, b))
    return np.dot(a, b) / math.sqrt(np.dot(a, a)) / math.sqrt(np.dot(b, b))


def brute_links(rows, least):
    def usable(r):
        return r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])
    good = [r for r in rows if usable(r)]
    links, parent = {}, {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for k, a in enumerate(good):
        for b in good[:k]:
            if a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= least:
                links[a[0]] = links.get(a[0], 0) + 1
                links[b[0]] = links.get(b[0], 0) + 1
                p, q = sorted((root(a[0]), root(b[0])))
                parent[q] = p
    return sorted((r[0], links.get(r[0], 0), root(r[0]), root(r[0]) == r[0]) for r in rows)


def vectors(seed, size):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, size))
    rows = []
    for k in range(260):
        v = centres[k % 12] + r.normal(size=size) * r.choice([0.05, 0.2, 0.35, 3])
        rows.append((k, v.tolist(), int(r.integers(0, 2))))
    for k in range(40):
        rows.append((300 + k, rows[k % 3][1], rows[k % 3][2]))
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 1), (401, [], 1), (402, [0.0] * size, 1), (403, [nan] + [1.0] * (size - 1), 1), (404, [inf] + [1.0] * (size - 1), 1),
             (405, [None] + [1.0] * (size - 1), 1), (406, rows[0][1], None), (407, [1.0], 1), (408, [2.0], 1), (409, [1e-200] * size, 0), (410, [1e200] * size, 0)]
    return rows


@pytest.mark.parametrize("size,chunk", [(20, 7), (64, 1024)])
def test_near_vectors(spark, monkeypatch, size, chunk):
    monkeypatch.setattr(embedding_join, "CHUNK", chunk)
    rows = vectors(size, size)
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, label int, cls string")
    assert sorted(map(tuple, embedding_join.near_vectors(df).collect())) == brute_links(rows, 0.93)
    assert embedding_join.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_with_repeated_and_missing_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(str, map(tuple, embedding_join.near_vectors(df).collect()))) == sorted(map(str, [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, None)]))


@pytest.mark.parametrize("scale", [5, 5 * 2**27])
def test_top_k(spark, monkeypatch, scale):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 60)
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 7)
    monkeypatch.setattr(maxscore, "SHARDS_PER_TASK", 2)
    r = np.random.default_rng(3)
    rows = [(k, (r.integers(-3, 4, 16) * (scale // 5)).tolist()) for k in range(500)]
    rows += [(1000 + k, rows[0][1]) for k in range(30)]
    extra = [(None, rows[0][1]), (2000, None), (2001, [None] * 16)]
    df = spark.createDataFrame([(*x, "z") for x in rows + extra], "vec_id long, embedding array<long>, size string")
    out = maxscore.top_k(df, df.where("vec_id % 20 = 0"), 6)
    expected = []
    for q, v in rows:
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows if c != q))[:6]
            expected += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(map(tuple, out.collect())) == sorted(expected)
    assert maxscore.top_k(df.limit(0), df, 3).count() == 0 and maxscore.top_k(df, df.limit(0), 3).count() == 0
    assert maxscore.top_k(df.where("vec_id = 5"), df.where("vec_id = 5"), 3).count() == 0


def test_integers(spark):
    df = spark.createDataFrame([([0.5, -0.001, 1.0],)], "v array<float>")
    assert df.select(maxscore.integers(df.v)).first()[0] == [32, -1, 64]
