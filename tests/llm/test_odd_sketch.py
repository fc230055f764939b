import random

import numpy as np

from redpencil.llm import common, odd_sketch
from redpencil.llm.common import components
from redpencil.session import materialize


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


def shingle_set(text):
    w = words(text)
    return {tuple(w)} if len(w) == 1 else set(zip(w, w[1:]))


def brute(docs):
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in ids)


def corpus(r):
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "É".lower(), "a b"]
    base = [[r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 12, 40, 120]))] for _ in range(25)]
    docs = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "One"), (1004, "one"), (1005, "x y"), (1006, "X\ty")]
    for d in range(200):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        docs.append((d, r.choice([" ", "\n", "  "]).join(w)))
    # a group in which every document is near the first, but not all are near each other
    group = [f"g{k}" for k in range(100)]
    docs += [(500 + k, " ".join(r.choice(vocabulary) if r.random() < 0.06 else w for w in group)) for k in range(60)]
    return docs


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs = corpus(random.Random(seed))
        rows = spark.createDataFrame([(d, t, 3) for d, t in docs], "doc_id long, text string, component_id int")
        assert sorted(map(tuple, odd_sketch.near_duplicates(rows).collect())) == brute(docs)


def test_block_comparison_alone(spark, monkeypatch):
    """Small chunks, so that a band's members meet in many blocks."""
    monkeypatch.setattr(odd_sketch, "CHUNK", 3)
    docs = corpus(random.Random(3))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, odd_sketch.near_duplicates(rows).collect())) == brute(docs)


def test_nulls_repeats_and_empty(spark):
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (1, "other text here"), (2, "A b  c")], "doc_id long, text string")
    out = sorted(map(str, (tuple(r) for r in odd_sketch.near_duplicates(rows).collect())))
    assert out == sorted(map(str, [(None, 2, None, None), (1, 2, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]))
    assert odd_sketch.near_duplicates(rows.limit(0)).count() == 0
    kept = odd_sketch.drop_near_duplicates(rows.withColumn("_gone", rows.text))
    assert kept.columns == ["doc_id", "text", "_gone"] and kept.count() == 4


def test_sketch_never_hides_a_pair():
    r = np.random.default_rng(5)
    for _ in range(300):
        common, own = r.integers(0, 2**63, 160, dtype=np.uint64), r.integers(0, 2**63, 40, dtype=np.uint64)
        a = odd_sketch.min_hashes(np.concatenate([common, own[:20]]))
        b = odd_sketch.min_hashes(np.concatenate([common, own[20:]]))
        bits = np.bitwise_count((odd_sketch.odd_sketch(a) ^ odd_sketch.odd_sketch(b)).view(np.uint64)).sum()
        assert bits <= 2 * (a != b).sum() and bits <= 2 * odd_sketch.most_differing()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 60)] + [(1, 2), (2, 1), (3, 3)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**{k: 10 for k in range(10, 61)}, 1: 1, 2: 1}


def test_all_texts_of_a_repeated_id_count(spark):
    x = [f"x{k}" for k in range(100)]
    near = [*x[:50], "other", *x[51:]]
    rows = [(5, "a text of its own"), (5, " ".join(x)), (9, " ".join(x)), (12, " ".join(near)), (12, " ".join(near)), (20, "far from all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.component_id, r.kept) for r in odd_sketch.near_duplicates(df).collect()}
    assert found == {(5, 5, True), (9, 5, False), (12, 5, False), (20, 20, True)}


def test_components_end_with_stars(spark, monkeypatch):
    """One pass makes two stars of these links; none follows only to see that nothing changes."""
    written = []
    monkeypatch.setattr(common, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    edges = spark.createDataFrame([(5, 1), (6, 1), (7, 1), (9, 8), (9, 9), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {1: 1, 5: 1, 6: 1, 7: 1, 8: 8, 9: 8}
    assert len(written) == 2
