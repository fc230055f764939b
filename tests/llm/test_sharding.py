from collections import defaultdict
from zlib import crc32

import pytest

from redpencil.llm import sharding


def check(rows, shards):
    loads, slots, homes = [0] * shards, defaultdict(list), defaultdict(set)
    for r in rows:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    return loads


def test_least_loaded():
    assert sharding.least_loaded([5, 9, 5, 1], 2) == [1, 0, 1, 0]
    assert sharding.least_loaded([], 3) == []


@pytest.mark.parametrize("per_bucket", [10, 100000])
def test_levels(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(sharding, "GROUPS_PER_BUCKET", per_bucket)
    monkeypatch.setattr(sharding, "FAN_IN", 3)
    monkeypatch.setattr(sharding, "ROWS_PER_RUN", 50)
    texts = [None, "", "é"] + ["same"] * 300 + ["t%d" % k * (k % 50 + 1) for k in range(500)]
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, "no id", "x"), (3, "same", "x")],
                                 "doc_id long, text string, shard string")
    out = sharding.assign_shards(rows, 5).collect()
    assert len(out) == len(texts) + 2
    loads = check(out, 5)
    assert max(loads) <= (1.2 if per_bucket == 10 else 1.02) * min(loads)
    homes = defaultdict(set)
    for r in out:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        assert r["size"] == len(text.encode()) + 16 and r.text_crc32 == crc32(text.encode())
        homes[text].add(r.shard)
    assert all(len(h) == 1 for h in homes.values())


def test_empty(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign_shards(rows, 4).count() == 0
