import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from redpencil.llm import gated_lm as lm


@pytest.fixture
def small(monkeypatch):
    for name, value in {"SLOTS": 4, "STEPS": 5, "HIDDEN": 3, "WORDS": 9, "CLASSES": 4}.items():
        monkeypatch.setattr(lm, name, value)
    counts = lm.Counts(3000, 41, 10, [b"w%d" % k for k in range(30)], np.arange(60, 30, -1))
    model = lm.Model(counts.own)
    model.flat[:] += np.random.default_rng(0).normal(0, 0.3, len(model.flat))
    return counts, model


def test_gradients_equal_differences(small):
    counts, model = small
    r, n = np.random.default_rng(1), len(counts.own)
    inputs, targets = r.integers(0, n, (5, 4)), r.integers(0, n, (5, 4))
    fresh, used, state = r.random((5, 4)) < 0.2, r.random((5, 4)) < 0.9, r.normal(0, 0.3, (3, 4)).astype(np.float32)
    model.flat = model.flat.astype(np.float64)
    model.__dict__.update(model.views(model.flat))
    found = model.gradients(inputs, fresh, targets, used, state)[0]
    for k in range(len(model.flat)):
        loss, was = [], model.flat[k]
        for step in (1e-3, -1e-3):
            model.flat[k] = was + step
            loss.append(model.gradients(inputs, fresh, targets, used, state)[2])
        model.flat[k] = was
        assert abs((loss[0] - loss[1]) / 2e-3 - found[k]) < 1e-4


def plain(model, symbols):
    """A document's log-likelihood, one token after the other."""
    h, total, state, last = lm.HIDDEN, 0.0, np.zeros(lm.HIDDEN), lm.END
    lay = model.layout
    for x in symbols:
        given, again = model.table[:, last].astype(float), model.again @ state
        z, r = (1 / (1 + np.exp(-(given[k * h:k * h + h] + again[k * h:k * h + h]))) for k in (0, 1))
        new = np.tanh(given[2 * h:] + r * again[2 * h:])
        state = z * state + (1 - z) * new
        place = lay.place[x]
        c = lay.of_place[place]
        logits = model.to_class @ state + model.class_bias
        total += logits[c] - np.log(np.exp(logits).sum())
        lo, hi = lay.starts[c], lay.starts[c + 1]
        logits = model.to_word[lo:hi] @ state + model.word_bias[lo:hi]
        total += logits[place - lo] - np.log(np.exp(logits).sum())
        last = x
    return total


def test_windows_carry_the_state_through_whole_texts(small):
    counts, model = small
    r = random.Random(3)
    texts = [[r.randrange(len(counts.own)) for _ in range(r.choice([0, 1, 4, 5, 6, 23, 90]))] + [lm.END] for _ in range(40)]
    sums, state = np.zeros(len(texts)), np.zeros((lm.HIDDEN, lm.SLOTS), np.float32)
    for slots, inputs, targets, fresh, number in lm.Slots(iter(enumerate(map(np.array, texts)))).windows():
        states, _ = model.states(inputs, fresh, state[:, slots])
        state[:, slots] = states[-1]
        found, _ = model.log_probabilities(lm._side_by_side(states), targets.ravel())
        used = number.ravel() >= 0
        np.add.at(sums, number.ravel()[used], found[used])
    assert np.allclose(sums, [plain(model, t) for t in texts], atol=1e-3)


def test_probabilities_of_all_words_add_up(small):
    counts, model = small
    states = np.random.default_rng(2).normal(0, 1, (3, 1)).astype(np.float32)
    every = np.arange(len(counts.own))
    found, _ = model.log_probabilities(np.repeat(states, len(every), axis=1), every)
    assert abs(np.exp(found).sum() - 1) < 1e-5
    # the shared output's words: known ones with their counts plus one, and one for all unseen ones
    rare = counts.counts[lm.WORDS:]
    others = counts.types - len(counts.words) - 1                     # beyond the table, with the counts that are left
    left = counts.total - counts.documents - counts.counts.sum()
    assert counts.rare_share == (rare + 1).sum() + left + others + 1


def corpus(seed, n=400):
    r = random.Random(seed)
    rows = []
    for d in range(n):
        kind = r.choice("ab")                                          # each document keeps to one vocabulary
        words = [f"{kind}{min(int(r.paretovariate(.7)), 400)}" for _ in range(r.choice([1, 5, 60]))]
        rows.append((d, " ".join(words).replace("a1 ", "A1\t", 1)))
    rows += [(5000, None), (5001, ""), (5002, "unseen\x85word É a1"), (None, "a1 a2"), (7, "a1 b1"), (7, "a1 b1"), (5003, "x" * 100 + " a1\n" * 3000)]
    return rows


def brute(rows):
    def words(text):
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\v\f\r":
            lower = lower.replace(c, " ")
        return [w for w in lower.split(" ") if w] + [None]
    held = lambda d: d is None or crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in rows if not held(d) for w in words(t))
    total, types = sum(counts.values()), len(counts)
    return sorted(((d, held(d), len(words(t)), sum(counts[w] > 0 for w in words(t)), total,
                    round(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words(t)), 6)) for d, t in rows), key=str)


@pytest.mark.parametrize("counted", [200_000, 20])
def test_base_equals_brute_force(spark, monkeypatch, counted):
    monkeypatch.setattr(lm, "COUNTED", counted)
    monkeypatch.setattr(lm, "WORDS", 50)
    rows = corpus(1)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, words int").repartition(3)
    out = lm.score(df).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str) == brute(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    twice = [r.score for r in out if r.doc_id == 7]
    assert len(twice) == 3 and len({round(x, 6) for x in twice}) == 2


def test_held_out_texts_get_likelier(spark, monkeypatch):
    """Documents keep to one of two vocabularies, which the state learns and counts can't."""
    monkeypatch.setattr(lm, "WORDS", 100)
    df = spark.createDataFrame(corpus(2, 4000), "doc_id long, text string").repartition(2)
    held = [r for r in lm.score(df).collect() if r.held_out and r.n_tokens > 50]
    assert len(held) > 50
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert sum(r.score > r.base_score for r in held) > 0.8 * len(held)


def test_empty_and_unlearned(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert lm.score(df.limit(0)).count() == 0
    out = sorted(map(tuple, lm.score(df).collect()), key=lambda r: r[2])
    assert [r[:5] for r in out] == [(None, True, 1, 0, 0), (None, True, 3, 0, 0)] and all(r[5] == 0 and math.isfinite(r[6]) for r in out)


def test_words_of_many_texts(monkeypatch):
    """Words cut and looked up for many texts at once are those of each text alone."""
    texts = [None, "", " \t\n", "The the\x0bTHE", " a\x1cb  \u0085c\u00a0d\u2003É É ", "x " * 50, None, "\x00 a\x00", "rare 中文", ""]
    alone = [lm.tokens((t or "").encode()) for t in texts]
    known = [b"a", b"the", b"x", "É".encode()]
    monkeypatch.setattr(lm, "WORDS", 2)
    monkeypatch.setattr(lm, "READ_BYTES", 16)
    coder = lm.Coder(lm.Counts(60, 5, 9, known, np.array([4, 3, 2, 1])))
    code = {w: k + 2 for k, w in enumerate(known)}
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(texts, kind)
        words, ends = lm.words_of(column)
        assert [words.to_pylist()[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends)] == alone
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        parts = list(lm.slices(batch, 0))
        assert len(parts) > 1 and sum((p.column(0).to_pylist() for p in parts), []) == texts
        read = [x for p in parts for x in coder.read(p.column(0))]
        for own, (symbols, numbers, other) in zip(alone, read, strict=True):
            assert symbols.tolist() == [code[w] if code.get(w, 9) < coder.own else lm.RARE for w in own] + [lm.END]
            assert numbers.tolist() == [code[w] for w in own if w in code] and other == [w for w in own if w not in code]
        found = Counter()
        for b in lm.count_words(iter([batch])):
            for r in b.to_pylist():
                found[r["word"]] += r["n"]
        assert found == Counter(w for own in alone for w in own)
    assert list(lm.slices(batch.slice(0, 0), 0)) == []
