import itertools
import random
from zlib import crc32

import numpy as np
import pytest

from redpencil.llm import toxicity


@pytest.mark.parametrize("width", [1, 2, 3, 128])
def test_marginals_equal_enumeration(monkeypatch, width):
    monkeypatch.setattr(toxicity, "CHAIN", width)                # columns of one chain, cut or not
    r = np.random.default_rng(1)
    lengths = np.array([0, 1, 4, 3, 0])
    evidence, moves = r.normal(size=8), r.normal(size=(2, 2))
    p, expected = toxicity.forward_backward(evidence, toxicity.Layout(lengths), moves)
    at, moved, found = 0, np.zeros((2, 2)), []
    for n in (1, 4, 3):
        e, total, on = evidence[at:at + n], 0.0, np.zeros(n)
        steps = np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(e[k] for k in range(n) if y[k]) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += weight
            on += weight * np.array(y)
            for a, b in zip(y, y[1:]):
                steps[a, b] += weight
        found += list(on / total)
        moved += steps / total
        at += n
    assert np.allclose(p, found) and np.allclose(expected, moved)


def test_long_texts_are_one_chain(monkeypatch):
    r = np.random.default_rng(4)
    lengths = np.array([300, 5, 0, 1000])
    evidence, moves = r.normal(size=1305), np.array([[2.0, -1.0], [-2.0, 3.0]])
    cut, moved = toxicity.forward_backward(evidence, toxicity.Layout(lengths), moves)
    monkeypatch.setattr(toxicity, "CHAIN", 2000)
    whole, expected = toxicity.forward_backward(evidence, toxicity.Layout(lengths), moves)
    assert np.allclose(cut, whole, atol=1e-12) and np.allclose(moved, expected)


def test_batches_do_not_matter(monkeypatch):
    model = toxicity.Crf({"=bad": 9.0}, -3.0, np.array([[1.0, -1.0], [-1.0, 1.0]]), (-1.0, 1.0, 1.0))
    texts = ["a bad thing " * k for k in (1, 50, 0, 3, 400)] + [None, "fine"]
    one, spans = toxicity._Scorer(model).scores(texts)
    monkeypatch.setattr(toxicity, "BATCH_TOKENS", 7)
    two, again = toxicity._Scorer(model).scores(texts)
    assert np.allclose(one, two, atol=1e-12) and [[s["start"] for s in x] for x in spans] == [[s["start"] for s in x] for x in again]


def plain_score(model, text):
    """A document's score, token by token over its whole chain."""
    on = [1 / (1 + np.exp(-np.clip(model.evidence(w), -30, 30))) for w in toxicity.TOKEN.findall(text or "")]
    top, many, m = -12.0, 0.0, np.exp(model.moves)
    if on:
        ahead = [np.array([1 - on[0], on[0]])]
        for x in on[1:]:
            new = ahead[-1] @ m * [1 - x, x]
            ahead.append(new / new.sum())
        back = [np.ones(2)]
        for x in on[:0:-1]:
            new = m @ (back[-1] * [1 - x, x])
            back.append(new / new.sum())
        p = np.array([a[1] * b[1] / (a @ b) for a, b in zip(ahead, back[::-1])])
        best = np.clip(p.max(), 6.2e-6, 1 - 6.2e-6)
        top, many = np.log(best / (1 - best)), np.log1p(p[p >= 0.5].sum())
    b0, b1, b2 = model.curve
    return 1 / (1 + np.exp(-np.clip(b0 + b1 * top + b2 * many, -30, 30)))


def test_scores_equal_plain_chains(spark, corpus):
    docs, labels, truth = corpus
    model = toxicity.train(docs, labels)
    long = spark.createDataFrame([(9000, "a zzbad b " * 200, "x"), (9001, "neutral " * 700 + "Qqvile", "x"), (9002, None, "x")], docs.schema)
    for row in toxicity.score(docs.union(long), model).collect():
        assert abs(row.toxicity.score - plain_score(model, row.text)) < 1e-9


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows = []
    for d in range(600):
        toxic = d % 4 == 0
        text = [r.choice(words) for _ in range(r.choice([3, 30, 300]))]
        for _ in range(3 if toxic else 0):
            text.insert(r.randrange(len(text)), r.choice(["zzbad", "Qqvile", "xxstem" + r.choice(words)]))
        rows.append((d, " ".join(text), int(toxic)))
    docs = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(None, 1), (3, None), (10**6, 1)], "doc_id long, toxic int")
    return docs, labels, {d: (t, y) for d, t, y in rows}


def test_held_out_rows(spark, corpus):
    docs, labels, truth = corpus
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).collect()
    held = [r for r in out if crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80
    wrong = sum((r.toxicity.score >= 0.5) != (truth[r.doc_id][1] == 1) for r in held)
    assert wrong <= 2
    row = next(r for r in out if r.toxicity.spans)
    span = row.toxicity.spans[0]
    assert truth[row.doc_id][0][span.start:span.end].lower()[:2] in ("zz", "qq", "xx")


def test_held_out_labels_do_not_matter(spark, corpus):
    docs, labels, _ = corpus
    other = labels.where(toxicity.in_training(labels.doc_id))
    one, two = toxicity.train(docs, labels), toxicity.train(docs, other)
    assert one.weights == two.weights and one.curve == two.curve


def test_nulls_and_no_labels(spark, corpus):
    docs, labels, _ = corpus
    model = toxicity.train(docs, labels)
    rows = spark.createDataFrame([(1, None), (2, ""), (None, "!?"), (4, "zzbad " * 50000), (4, "zzbad " * 50000)], "doc_id long, text string")
    scores = [r.toxicity.score for r in toxicity.score(rows, model).collect()]
    assert scores[0] == scores[1] == scores[2] < 0.5 < scores[3] == scores[4]
    empty = toxicity.train(docs, labels.limit(0))
    assert all(r.toxicity.score < 0.5 for r in toxicity.score(docs, empty).collect())
    assert toxicity.score(rows.limit(0), model).count() == 0


def test_long_rows_cost_no_other_rows(spark, corpus, monkeypatch):
    docs, labels, truth = corpus
    spent = {y: sum(len(t) for t, own in truth.values() if own == y) for y in (0, 1)}
    monkeypatch.setattr(toxicity, "TOXIC_CHARS", spent[1], raising=False)
    monkeypatch.setattr(toxicity, "CLEAN_CHARS", spent[0], raising=False)
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", spent[0] + spent[1], raising=False)
    # long rows of both classes among the sample, some of them first in its order
    long = [(10**7 + k, "neutral filler " * (1 + sum(spent.values()) // 15), k % 2) for k in range(20)]
    more = docs.union(spark.createDataFrame([(d, t, "x") for d, t, _ in long], docs.schema))
    known = labels.union(spark.createDataFrame([(d, y) for d, _, y in long], labels.schema))
    assert toxicity.train(more, known).weights == toxicity.train(docs, labels).weights != {}


def test_class_without_a_row_that_fits(spark, corpus, monkeypatch):
    docs, labels, _ = corpus
    monkeypatch.setattr(toxicity, "TOXIC_CHARS", 5, raising=False)
    # the shortest text of a class counts in any case, so very long ones are no error
    assert toxicity.train(docs, labels).curve[0] < 0
    with pytest.warns(UserWarning, match="toxic=0"):
        toxicity.train(docs.limit(0), labels)


def test_small_weights_and_earlier_bounds(spark, corpus):
    docs, labels, _ = corpus
    assert any(0.02 <= abs(w) < 0.05 for w in toxicity.train(docs, labels).weights.values())
    assert toxicity.CLEAN_ROWS >= 6000 and toxicity.TOXIC_CHARS + toxicity.CLEAN_CHARS >= 24_000_000


def test_clean_features_are_only_counted():
    """Features come one text at a time; a text's own are held only where they may have to be covered."""
    found = [np.array([0, 3]), np.array([0, 4]), np.array([0, 5]), np.array([1, 3]), np.array([1, 4]), np.array([1, 5]), np.array([2, 3]), np.array([2])]
    toxic = np.array([True] * 6 + [False] * 2)
    assert toxicity.telling(iter(found), toxic, 6).tolist() == toxicity.telling(found, toxic, 6).tolist() == [True, True, False, False, False, False]
    # two features cover 200 toxic texts, 3 texts have one of their own
    found = [np.array([0])] * 200 + [np.array([1])] * 3 + [np.array([2])] * 50
    toxic = np.arange(253) < 203
    assert toxicity.telling(iter(found), toxic, 3).tolist() == [True, True, False]
