"""The stages on a small fixture: every decision against a brute-force version of it."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from redpencil.llm import toxicity
from test_line_dedup import brute as repeated_lines
from test_toxicity import plain_score

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(None, "no id here, me@x.org", "en", "s", 1), (10**9, None, None, None, None), (10**9 + 1, "", "en", "s", 0)], docs.schema)
    return docs.union(extra)


def test_stages(spark, tables):
    docs, columns, seen = tables, tables.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        path = corpus_pipeline.new_path(spark, "stage")
        out.write.parquet(path)
        seen[name], docs = (docs, out), spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns and docs.count() > 100, name
        assert stage(spark, tables.limit(0), SF).count() == 0, name
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in seen["toxicity"])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(after) <= set(before) and {10**9, 10**9 + 1, None} <= set(after)
    assert sum(labels.get(d, 0) for d in after) <= 0.5 * sum(labels.values())
    model = toxicity.train(tables, spark.read.parquet(f"{SF}/labels.parquet"))
    assert set(after) == {d for d, t in before.items() if plain_score(model, t) < corpus_pipeline.TOXIC}
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in seen["line_dedup"])
    gone = {(d, k) for d, k, kept, *_ in repeated_lines(list(before.items())) if not kept}
    expected = {}
    for d, text in before.items():
        lines = (text or "").split("\n")
        left = [x for k, x in enumerate(lines) if (d, k) not in gone]
        if len(left) == len(lines) or any(x.strip(" \t\r") for x in left):
            expected[d] = text if len(left) == len(lines) else "\n".join(left)
    assert after == expected
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in seen["near_dedup"])

    def shingles(text):
        w = (text or "").split()
        return {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    sets = {d: shingles(t.lower() if t else t) for d, t in after.items() if d is not None}
    ids = sorted(sets)
    assert not any(sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b)
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in seen["pii"])
    assert set(before) == set(after) and after[None] == "no id here, [email]" and after[10**9] is None
    assert all("@mail" not in (t or "") for t in after.values())
    lengths = defaultdict(int)
    for r in docs.collect():
        lengths[r.doc_id] += r.length
    assert set(lengths) == set(after)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).where(F.col("length") > 4096).count() == 0
