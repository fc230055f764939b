import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from redpencil.llm import collocations


def brute(rows, top, least, covered=80):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and 100 * b >= covered * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in candidates.items())
            if not inside:
                score, cut = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed):
    r = random.Random(seed)
    common = ["the", "of", "New", "york", "é", "É", "a\x85b", "x y", "😀", "ÿ", "z"]
    rows = []
    for d in range(300):
        words = []
        for _ in range(r.choice([0, 1, 3, 20, 60])):
            words += r.choice([["New", "York", "City"], ["as", "well", "as"], [r.choice(common)], [f"w{r.randrange(500)}"], ["ha", "ha", "ha", "ha", "ha"]])
            if r.random() < .1:
                words[-1] += r.choice([".", ",", ";", ":", "!", "?", "\n", "\r", "\x0b", "\x0c", "..", " . "])
        rows.append((r.choice([" ", "  ", "\t"]).join(words), r.choice(["en", "en", "fr", None, "und", ""])))
    return rows + [(None, "en"), ("", "en"), (" \t\n", "de"), ("one", "de"), ("of the " * 3000, "en")]


@pytest.mark.parametrize("least,top,sieve", [(5, 2000, 1 << 26), (30, 7, 1 << 26), (5, 2000, 1 << 15)])
def test_equals_brute_force(spark, monkeypatch, least, top, sieve):
    monkeypatch.setattr(collocations, "SIEVE_BITS", sieve)           # a full sieve lets all pass, counts stay exact
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 500)
    monkeypatch.setattr(collocations, "BLOCK_ROWS", 1000)
    rows = corpus(least)
    df = spark.createDataFrame([(*r, 7) for r in rows], "text string, lang string, n int").repartition(4)
    out = collocations.collocations(df, top, least=least)
    expected = brute(rows, top, least)
    assert sorted(map(tuple, out.collect())) == expected and len(expected) > 10


class Open:
    """A sieve that lets all pass."""
    value = np.full(collocations.SIEVE_BITS // 8, 255, np.uint8)


def test_a_task_hands_on_equal_windows_once():
    texts = ["new york  city\tNEW york city", "new york city. \nnew york city,city", "x y"]
    batches = [pa.RecordBatch.from_arrays([pa.array([lang] * 3), pa.array(texts)], names=["lang", "text"]) for lang in ("en", "fr", "en", "en")]
    rows = [r for b in collocations.window_counter(Open, [Open, Open], 4)(iter(batches)) for r in b.to_pylist()]
    keys = Counter((r["lang"], *(r[f"w{k}"] for k in range(1, 5))) for r in rows)
    assert max(keys.values()) == 1                                   # also over batches
    one = {(r["w1"], r["w2"], r["w3"], r["w4"]): r["n"] for r in rows if r["lang"] == "fr"}
    assert one == {("new", "york", "city", "new"): 1, ("york", "city", "new", "york"): 1, ("city", "new", "york", "city"): 1,
                   ("new", "york", "city", None): 3, ("york", "city", None, None): 3, ("city", None, None, None): 4,
                   ("x", "y", None, None): 1, ("y", None, None, None): 1}
    assert {k: 3 * n for k, n in one.items()} == {(r["w1"], r["w2"], r["w3"], r["w4"]): r["n"] for r in rows if r["lang"] == "en"}


def test_windows_are_handed_on_before_their_codes_change(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK_ROWS", 40)
    texts = [f"a{k} b{k} c{k % 3}" for k in range(30)]
    batches = [pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([t])], names=["lang", "text"]) for t in texts for lang in ("en", "fr")]
    counts = Counter()
    for b in collocations.window_counter(Open, [Open, Open], 4)(iter(batches)):
        for r in b.to_pylist():
            counts[tuple(r.values())[:-1]] += r["n"]
    expected = Counter()
    for t in texts:
        w = t.split(" ")
        for k in range(3):
            expected.update((lang, *w[k:], *[None] * (k + 1)) for lang in ("en", "fr"))
    assert counts == expected


@pytest.mark.parametrize("texts", [[b""], [b" "], [b"\n"], [b"a"], [b" a  b\t.c", b"", b"D! ?\r e\x0b"], ["\u00c9\u0085 \u2028x\x1cy".encode(), b"  "]])
def test_tokens(texts):
    expected = re.findall(rb"\n|[^ \t\n]+", re.sub(rb"[.,;:!?\x0a-\x0d]", b"\n", b"\n".join(texts).lower()))
    assert collocations.tokens(texts).to_pylist() == expected


def test_products_beyond_64_bits(spark):
    df = spark.sql("SELECT CAST(4000000000000000000 AS LONG) AS a, CAST(4500000000000000001 AS LONG) AS l, CAST(4100000000000000003 AS LONG) AS r")
    got = df.select(collocations.cut_score("a", "l", "r").alias("s")).first().s
    assert got == 2000000 * 4000000000000000000 // (4500000000000000001 + 4100000000000000003)


def test_empty(spark):
    df = spark.createDataFrame([(None, None), ("", "en"), ("one two", "en")], "text string, lang string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(df.limit(0)).count() == 0
