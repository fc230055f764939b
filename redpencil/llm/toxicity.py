"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

A token's features are its word, the word's beginnings and its end, so unseen forms of known stems count. The chain
has two states; tokens of toxic documents with a telling feature are the labelled positive tokens, all others the
negative ones. Forward-backward marginals give the spans; their maximum and their sum give the document's score
through a logistic curve fitted on the same rows.

Fitting sees at most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` labelled ids, the first in the order of a hash of the id, and of
each class ``TOXIC_CHARS`` and ``CLEAN_CHARS`` characters, the shortest texts first and at least one; so a long text costs its class no
other row. All of them decide which features are telling and where the curve lies; the
field's weights are fitted on the toxic rows and as many clean ones. Scoring reads every text whole, as one chain.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

TOXIC_ROWS, CLEAN_ROWS = 1200, 6000
TOXIC_CHARS, CLEAN_CHARS = 8_000_000, 16_000_000
FOLDS = 5
CHAIN = 128                      # tokens of a column; bounds the steps of a batch, not the chains
BATCH_TOKENS, BATCH_TEXTS = 60_000, 1024
STEPS = 40
REMEMBERED = 200_000
TOKEN = re.compile(r"[^\W_]+")
SPAN = "array<struct<start: int, end: int, probability: double>>"


def features(word: str) -> list[str]:
    w = word.lower()
    return [f"={w}", *(f"{w[:n]}*" if len(w) >= n else f"={w}" for n in (3, 4, 5)), f"*{w[-3:]}"]


@dataclass
class Crf:
    """Weights of two-state chains; state 1 is toxic. ``moves[i][j]`` goes from state i to j."""
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def evidence(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


class Layout:
    """Texts one after the other as columns of at most ``CHAIN`` tokens. Columns of a text are links of one chain."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        columns = -(-lengths // CHAIN)
        self.count = int(columns.sum())
        ends = np.cumsum(lengths)
        within = np.arange(int(ends[-1]) if len(ends) else 0)
        within -= np.repeat(ends - lengths, lengths)
        self.place = (within % CHAIN).astype(np.int32)
        self.column = (np.repeat(np.cumsum(columns) - columns, lengths) + within // CHAIN).astype(np.int32)
        self.sizes = np.bincount(self.column, minlength=self.count)
        self.width = int(self.sizes.max(initial=0))
        self.follows = np.flatnonzero(within > 0)
        # columns by how many of their text lie before them
        number = np.arange(self.count) - np.repeat(np.cumsum(columns) - columns, columns)
        order = np.argsort(number, kind="stable")
        cuts = np.searchsorted(number[order], np.arange(1, int(columns.max(initial=0)) + 1))
        self.turns = [x for x in np.split(order, cuts)[1:] if len(x)]     # second columns, third ones, ...


def forward_backward(evidence: np.ndarray, layout: Layout, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 per token, and the expected moves between states, over all texts at once.

    Each column's transfer from the state before it to that at its end is a product of two by two matrices, found for
    all columns together. With these, states pass from column to column, so a text is one chain however long it is.
    """
    m = np.exp(moves)
    width, count, sizes = layout.width, layout.count, layout.sizes
    grid = np.zeros((width, count))
    grid[layout.place, layout.column] = evidence
    # in place: grids are the largest arrays of a fit
    on = np.clip(grid, -30, 30, out=grid)
    np.exp(np.negative(on, out=on), out=on)
    on += 1
    np.divide(1, on, out=on)
    # what enters a column: the share in state 1 of the token before it (none: no moves into the first token), and what follows its end
    before, after = np.full(count, np.nan), np.full(count, 0.5)
    if layout.turns:
        transfer = _transfers(on, sizes, m)
        first = np.setdiff1d(np.arange(count), np.concatenate(layout.turns))
        ends = np.empty(count)
        ends[first] = _ends(on[:, first], sizes[first], m)
        for turn in layout.turns:
            before[turn] = ends[turn - 1]
            ends[turn] = _pass(transfer[:, :, turn], before[turn], forward=True)
        for turn in layout.turns[::-1]:
            after[turn - 1] = _pass(transfer[:, :, turn], after[turn], forward=False)
    # the scaled vectors are kept as their share in state 1
    ahead = np.empty_like(on)
    enters = ~np.isnan(before)
    share = np.where(enters, before, 0.5)
    for t in range(width):
        one = (1 - share) * m[0, 1] + share * m[1, 1]
        zero = (1 - share) * m[0, 0] + share * m[1, 0]
        if not t:
            one, zero = np.where(enters, one, 0.5), np.where(enters, zero, 0.5)
        share = one * on[t] / (one * on[t] + zero * (1 - on[t]))
        ahead[t] = share
    back = np.full((width, count), 0.5)
    expected = np.zeros((2, 2))

    def moved(share: np.ndarray, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
        joint = np.stack([(1 - share) * m[0, 0] * zero, (1 - share) * m[0, 1] * one, share * m[1, 0] * zero, share * m[1, 1] * one])
        return (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
    state = after.copy()
    if width:
        back[width - 1] = state
    for t in range(width - 2, -1, -1):
        live = sizes > t + 1
        one, zero = state * on[t + 1], (1 - state) * (1 - on[t + 1])
        expected += moved(ahead[t][live], one[live], zero[live])
        b1, b0 = m[1, 0] * zero + m[1, 1] * one, m[0, 0] * zero + m[0, 1] * one
        state = np.where(live, b1 / (b1 + b0), state)
        back[t] = state
    for turn in layout.turns:
        expected += moved(before[turn], back[0, turn] * on[0, turn], (1 - back[0, turn]) * (1 - on[0, turn]))
    del on
    one, zero = ahead[layout.place, layout.column], back[layout.place, layout.column]
    del ahead, back
    both = one * zero
    np.subtract(1, one, out=one)
    one *= np.subtract(1, zero, out=zero)
    one += both
    both /= one
    return both, expected


def _transfers(on: np.ndarray, sizes: np.ndarray, m: np.ndarray) -> np.ndarray:
    """For each column the product of its tokens' moves and evidence, [from, to, column], scaled."""
    out = np.repeat(np.eye(2)[:, :, None], on.shape[1], axis=2)
    for t in range(len(on)):
        live = sizes > t
        zero = (out[:, 0] * m[0, 0] + out[:, 1] * m[1, 0]) * (1 - on[t])
        one = (out[:, 0] * m[0, 1] + out[:, 1] * m[1, 1]) * on[t]
        new = np.stack([zero, one], axis=1)
        new /= new.sum(axis=(0, 1))
        out = np.where(live, new, out)
    return out


def _pass(transfer: np.ndarray, share: np.ndarray, forward: bool) -> np.ndarray:
    """The share in state 1 at the other end of columns."""
    if forward:
        zero, one = ((1 - share) * transfer[0, k] + share * transfer[1, k] for k in (0, 1))
    else:
        zero, one = ((1 - share) * transfer[k, 0] + share * transfer[k, 1] for k in (0, 1))
    return one / (one + zero)


def _ends(on: np.ndarray, sizes: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The share at the end of first columns."""
    share = on[0].copy()
    for t in range(1, len(on)):
        one, zero = ((1 - share) * m[0, 1] + share * m[1, 1]) * on[t], ((1 - share) * m[0, 0] + share * m[1, 0]) * (1 - on[t])
        share = np.where(sizes > t, one / (one + zero), share)
    return share


def summary(marginals: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text: log-odds of the likeliest token, and the logarithm of one more than the expected toxic tokens."""
    out = np.zeros((len(lengths), 2))
    out[:, 0] = -12.0
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        top = np.clip(np.maximum.reduceat(marginals, starts), 6.2e-6, 1 - 6.2e-6)
        out[full, 0] = np.log(top / (1 - top))
        out[full, 1] = np.log1p(np.add.reduceat(np.where(marginals >= 0.5, marginals, 0.0), starts))
    return out


def telling(found: Iterable[np.ndarray], toxic: np.ndarray, count: int) -> np.ndarray:
    """Whether a feature tells: toxic texts have it and clean ones hardly do, and it is frequent or covers texts that
    no other one covers. ``found`` holds each text's different features; those of clean texts are only counted."""
    bad, good, listed = np.zeros(count, np.int64), np.zeros(count, np.int64), []
    for own, t in zip(found, toxic):
        (bad if t else good)[own] += 1
        if t:
            listed.append(own)
    sure = (bad >= 3) & (good <= 0.02 * bad)
    chosen = sure & (bad >= max(3, int(0.02 * toxic.sum())))
    left = [own[sure[own]] for own in listed if not chosen[own].any()]
    while left:
        counts = np.bincount(np.concatenate(left), minlength=count)
        best = int(counts.argmax())
        if counts[best] < 3:
            break
        chosen[best] = True
        left = [own for own in left if best not in own]
    return chosen


def batches_of(items: Iterable) -> Iterator[list]:
    """Lists of ``BATCH_TOKENS`` tokens, or one longer item."""
    held, size = [], 0
    for x in items:
        if held and size + len(x) > BATCH_TOKENS:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def fit(texts: Iterable[str | None], toxic: np.ndarray) -> Crf:
    """The model of labelled texts; without texts of both classes one that finds nothing."""
    model = Crf()
    toxic = np.asarray(toxic).astype(bool)
    if not toxic.any() or toxic.all():
        return model
    types: dict[str, int] = {}
    tokens = [np.fromiter((types.setdefault(w, len(types)) for w in TOKEN.findall(t or "")), np.int32) for t in texts]
    names: dict[str, int] = {}
    table = np.fromiter((names.setdefault(f, len(names)) for w in types for f in features(w)), np.int32).reshape(-1, 5)
    del types
    chosen = telling((np.unique(table[np.unique(t)]) for t in tokens), toxic, len(names))
    is_telling = chosen[table].any(axis=1)
    own = np.concatenate([np.flatnonzero(toxic), np.flatnonzero(~toxic)[:toxic.sum()]])
    w, bias, moves = _fit_weights([tokens[k] for k in own], toxic[own], is_telling, table, len(names))
    w[np.abs(w) < 0.02] = 0
    model.weights = {f: float(w[k]) for f, k in names.items() if w[k]}
    model.bias, model.moves = float(bias), moves
    evidence, found = bias + w[table].sum(axis=1), []
    for part in batches_of(tokens):
        lengths = np.array([len(t) for t in part])
        p, _ = forward_backward(evidence[np.concatenate(part)], Layout(lengths), moves)
        found.append(summary(p, lengths))
    model.curve = logistic(np.concatenate(found), toxic)
    return model


def _fit_weights(tokens: list[np.ndarray], toxic: np.ndarray, is_telling: np.ndarray, table: np.ndarray, count: int):
    """Gradient ascent on the likelihood of the labelled tokens, with a step of its own for each weight."""
    lengths = np.array([len(t) for t in tokens])
    flat = np.concatenate(tokens)
    y = (is_telling[flat] & np.repeat(toxic, lengths)).astype(float)
    layout = Layout(lengths)
    follows = layout.follows
    seen = np.bincount((2 * y[follows - 1] + y[follows]).astype(int), minlength=4).reshape(2, 2)
    w, squares = np.zeros(count), np.full(count, 1e-6)
    bias, moves, of_moves, of_bias = -3.0, np.zeros((2, 2)), np.full((2, 2), 1e-6), 1e-6
    for _ in range(STEPS):
        evidence = bias + w[table].sum(axis=1)
        p, expected = forward_backward(evidence[flat], layout, moves)
        by_type = np.bincount(flat, weights=y - p, minlength=len(table))
        g = np.bincount(table.ravel(), weights=np.repeat(by_type, 5), minlength=count) - 0.01 * w
        squares += g * g
        w += 0.7 * g / np.sqrt(squares)
        gb, gm = by_type.sum(), seen - expected - 0.01 * moves
        of_bias, of_moves = of_bias + gb * gb, of_moves + gm * gm
        bias += 0.5 * gb / np.sqrt(of_bias)
        moves = moves + 0.3 * gm / np.sqrt(of_moves)
    return w, bias, moves


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Intercept and slopes, by Newton steps with a small penalty; a slope that would be negative is left out."""
    used = [0, 1, 2]
    while True:
        a = np.column_stack([np.ones(len(x)), x])[:, used]
        penalty = np.array([0.01, 0.1, 0.1])[used]
        b = np.zeros(len(used))
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
            b = b + np.linalg.solve(h, a.T @ (y - p) - penalty * b)
        negative = [k for k, v in zip(used, b) if k and v < 0]
        if not negative:
            found = dict(zip(used, b.tolist()))
            return found[0], found.get(1, 0.0), found.get(2, 0.0)
        used = [k for k in used if k not in negative]


def in_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != 0, F.lit(False))


def _that_fit(sizes: list[tuple[int, int, int]], most: int) -> list[tuple[int]]:
    """The ids of ``sizes``, which has characters, hash and id in ascending order, until ``most`` characters are taken; the
    shortest text in any case."""
    ends = np.cumsum([n for n, _, _ in sizes])
    return [(i,) for _, _, i in sizes[:max(1, int(np.searchsorted(ends, most, side="right")))]]


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Crf:
    """Fit on a bounded sample of the labelled rows whose crc32 of the id, modulo 5, is not 0.

    Rows with a null id or label are left out; of several labels of an id the highest counts. Of a class whose texts are
    all longer than its characters the shortest is taken; one whose ids have no documents is a warning.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where("_id IS NOT NULL AND _toxic IS NOT NULL")
    known = known.where(in_training(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    order = F.xxhash64("_id")
    picked = [r for t, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)) for r in
              known.where(F.col("_toxic") == t).orderBy(order, "_id").limit(n).collect()]
    spark = docs.sparkSession
    ids = spark.createDataFrame([(r._id, int(r._toxic)) for r in picked], "_id long, _toxic int")
    body = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = body.join(F.broadcast(ids), "_id")            # at most TOXIC_ROWS + CLEAN_ROWS ids
    sizes = rows.groupBy("_toxic", F.xxhash64("_id").alias("k"), "_id").agg(
        F.sum(F.coalesce(F.length("_text"), F.lit(0))).alias("n")).collect()
    chosen = []
    for toxic, most in ((1, TOXIC_CHARS), (0, CLEAN_CHARS)):
        own = sorted((r.n, r.k, r._id) for r in sizes if r._toxic == toxic)
        fits = _that_fit(own, most)
        if not own and any(r._toxic == toxic for r in picked):
            warnings.warn(f"no document of the sampled labels toxic={toxic}; the model finds nothing")
        chosen += fits
    within = spark.createDataFrame(chosen, "_id long")
    found = rows.join(F.broadcast(within), "_id").orderBy("_id", "_text").select("_text", "_toxic").toArrow()
    columns = found.columns
    del found
    labels = columns.pop().to_numpy()
    return fit((x.as_py() for x in columns.pop()), labels)          # the texts are let go when they are tokens


class _Scorer:
    def __init__(self, model: Crf):
        self.model, self.known = model, {}

    def evidence(self, words: list[str]) -> list[float]:
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for k, w in enumerate(words):
                if found[k] is None:
                    found[k] = self.known[w] = self.model.evidence(w)
        return found

    def score(self, texts: list[str | None], words: list[list[str]]) -> tuple[np.ndarray, list[list[dict]]]:
        lengths = np.array([len(w) for w in words])
        evidence = np.array([e for w in words for e in self.evidence(w)])
        p, _ = forward_backward(evidence, Layout(lengths), self.model.moves)
        b0, b1, b2 = self.model.curve
        x = summary(p, lengths)
        scores = 1 / (1 + np.exp(-np.clip(b0 + x @ np.array([b1, b2]), -30, 30)))
        spans, starts = [], np.cumsum(lengths) - lengths
        for t, at, n in zip(texts, starts, lengths):
            own = p[at:at + n]
            hits = set(np.flatnonzero(own >= 0.5).tolist())
            spans.append([{"start": m.start(), "end": m.end(), "probability": float(own[k])}
                          for k, m in enumerate(TOKEN.finditer(t)) if k in hits] if hits else [])
        return scores, spans

    def scores(self, texts: Iterable[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores and spans, as many texts at once as ``BATCH_TOKENS`` allow."""
        found, spans, words, held, size = [], [], [], [], 0

        def flush() -> None:
            s, x = self.score(held, words)
            found.append(s)
            spans.extend(x)
            words.clear(), held.clear()
        for text in texts:
            own = TOKEN.findall(text) if text else []
            if held and (size + len(own) > BATCH_TOKENS or len(held) == BATCH_TEXTS):
                flush()
                size = 0
            held.append(text)
            words.append(own)
            size += len(own)
        if held:
            flush()
        return np.concatenate(found) if found else np.empty(0), spans


def score(docs: DataFrame, model: Crf, text: str = "text", output: str = "toxicity") -> DataFrame:
    """Add a struct ``score double, spans``; spans are toxic tokens with character offsets, end exclusive.

    Null, empty and wordless texts have no spans and the score of a text without a toxic token. Rows are scored
    one by one, so repeated rows get equal scores; other columns stay.
    """
    @F.arrow_udf(f"struct<score: double, spans: {SPAN}>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = _Scorer(model)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
        for column in columns:
            values, spans = scorer.scores(x.as_py() for x in column)
            yield pa.StructArray.from_arrays([pa.array(values), pa.array(spans, kind)], names=["score", "spans"])
    return docs.withColumn(output, run(F.col(text)))
