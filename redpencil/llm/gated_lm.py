"""A gated recurrent language model that scores whole documents, trained over the whole corpus.

The model reads a document word by word and gives the next token in two factors: its class, then the token in the
class. Frequent words and the end of a document have an output of their own; all other words share one, within which
their training counts decide. So probabilities of all words, unseen ones included, add up to one.

Documents run in ``SLOTS`` slots side by side, each window of ``STEPS`` tokens a few matrix products. When a document
ends, the next one takes its slot with a state of zeros; until then the state is carried from window to window, so a
text's likelihood covers it from the first to the last token, however long it is. Training cuts the gradients at the
windows' borders (truncated backpropagation).

Word counts cover all training rows. Training goes through all of them once, in ``ROUNDS`` parts: every task trains a
copy of the model on its rows of the part, and the copies' mean, weighted by tokens, starts the next part. Tasks hold the
counts of the ``COUNTED`` most frequent words; all other words meet their counts in a join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from redpencil.session import materialize

FOLDS, HELD_OUT = 7, 2
WORDS = 1000                     # words with an output of their own
COUNTED = 200_000                # words whose counts every task holds
COUNTED_BYTES = 64               # longer words meet their counts in the join
CLASSES = 32
HIDDEN = 16
SLOTS, STEPS = 256, 32
LONGER = 16                      # times that a window of few slots may be longer
ROUNDS = 4
TRAINER_TOKENS = 2_000_000       # a task trains on about so many tokens of a part, or on its split's if those are more
RATE = 0.02
END, RARE = 0, 1                 # symbols; words follow in the order of their counts
ROWS_OUT = 4096
READ_BYTES = 1 << 24             # texts of about so many bytes are cut into words at once


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words; ``bytes.split`` cuts at ``\\x20\\x09-\\x0D``."""
    return text.lower().split()


@dataclass
class Counts:
    """What the training rows hold: all tokens, different ones, documents, and the counts of frequent words."""
    total: int
    types: int
    documents: int
    words: list[bytes]
    counts: np.ndarray

    def __post_init__(self):
        own = min(WORDS, len(self.words))
        self.own = np.concatenate([[self.documents, 0], self.counts[:own]]).astype(np.int64)
        self.own[RARE] = self.total - self.own.sum()
        # what the shared output divides among its words: their counts, each plus one, and one for all unseen words
        self.rare_share = int(self.own[RARE]) + self.types - own - (self.documents > 0) + 1


class Layout:
    """Classes of symbols by the square roots of their counts; the symbols of a class lie next to each other."""

    def __init__(self, own: np.ndarray):
        order = np.argsort(-own, kind="stable")
        weight = np.cumsum(np.sqrt(own[order] + 1.0))
        label = np.minimum((weight - 1e-9) / weight[-1] * CLASSES, CLASSES - 1).astype(int)
        _, label = np.unique(label, return_inverse=True)
        self.place = np.empty(len(own), np.int64)            # symbol -> output
        self.place[order] = np.arange(len(own))
        self.of_place = label                                # output -> class
        self.starts = np.append(np.flatnonzero(np.diff(label, prepend=-1)), len(own))
        self.classes = len(self.starts) - 1


class Model:
    """Parameters, all of them views of one array: input table (embedding and gates in one), recurrence, outputs."""

    def __init__(self, own: np.ndarray, flat: np.ndarray | None = None):
        self.layout = lay = Layout(own)
        n, h, c = len(own), HIDDEN, lay.classes
        # arrays lie with their longest side last, so that a step goes through memory in order
        shapes = {"table": (3 * h, n), "again": (3 * h, h), "to_class": (c, h), "class_bias": (c,), "to_word": (n, h), "word_bias": (n,)}
        fresh = flat is None
        self.flat = np.zeros(sum(map(math.prod, shapes.values())), np.float32) if fresh else flat.astype(np.float32)
        self.shapes = shapes
        self.__dict__.update(self.views(self.flat))
        if fresh:
            r = np.random.default_rng(20250311)
            self.table[:] = r.normal(0, 0.3, self.table.shape)
            self.again[:] = r.normal(0, 1 / math.sqrt(h), self.again.shape)
            # the outputs start as the training counts
            share = np.empty(n)
            share[lay.place] = own + 1.0
            in_class = np.add.reduceat(share, lay.starts[:-1])
            self.class_bias[:] = np.log(in_class / in_class.sum())
            self.word_bias[:] = np.log(share / in_class[lay.of_place])

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            out[name] = flat[at:at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return out

    def states(self, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States [step, unit, slot] after each step of a window [step, slot], and what the way back needs."""
        h, steps = HIDDEN, len(inputs)
        given = np.take(self.table, inputs, axis=1)
        out = np.empty((steps + 1, *state.shape), np.float32)
        before, inner, recurrent = (np.empty((steps, *state.shape), np.float32) for _ in range(3))
        gates = np.empty((steps, 2 * h, state.shape[1]), np.float32)
        out[0] = state
        keep = (~fresh).astype(np.float32)
        for t in range(steps):
            prev, g, n = before[t], gates[t], inner[t]
            np.multiply(out[t], keep[t], out=prev)
            a = self.again @ prev
            recurrent[t] = a[2 * h:]
            np.add(given[:2 * h, t], a[:2 * h], out=g)
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            np.multiply(g[h:], recurrent[t], out=n)
            n += given[2 * h:, t]
            np.tanh(n, out=n)
            np.subtract(prev, n, out=out[t + 1])
            out[t + 1] *= g[:h]
            out[t + 1] += n
        return out[1:], (before, gates, inner, recurrent, keep)

    def log_probabilities(self, states: np.ndarray, targets: np.ndarray, weight: np.ndarray | None = None, into: dict | None = None):
        """Natural logarithms of the targets' probabilities, given states [unit, place]; with ``into`` also gradients, and
        those by the states."""
        lay = self.layout
        place = lay.place[targets]
        cls = lay.of_place[place]
        order = np.argsort(cls.astype(np.int16), kind="stable")     # places by class, so that a class is a slice
        states, place, cls = np.take(states, order, axis=1), place[order], cls[order]
        ends = np.searchsorted(cls, np.arange(lay.classes + 1))
        weight = None if weight is None else weight[order]

        def softmax(matrix, bias, own, wanted, weight):
            e = matrix @ own
            e += bias[:, None]
            e -= e.max(axis=0)
            columns = np.arange(len(wanted))
            found = e[wanted, columns]
            np.exp(e, out=e)
            total = e.sum(axis=0)
            found -= np.log(total)
            if into is not None:
                e *= weight / total
                e[wanted, columns] -= weight
            return found, e
        found, d = softmax(self.to_class, self.class_bias, states, cls, weight)
        down = None
        if into is not None:
            into["to_class"] += d @ states.T
            into["class_bias"] += d.sum(axis=1)
            down = self.to_class.T @ d
        for c in range(lay.classes):
            lo, hi, k = lay.starts[c], lay.starts[c + 1], slice(ends[c], ends[c + 1])
            if hi - lo == 1 or k.start == k.stop:
                continue
            part, d = softmax(self.to_word[lo:hi], self.word_bias[lo:hi], states[:, k], place[k] - lo, None if weight is None else weight[k])
            found[k] += part
            if into is not None:
                into["to_word"][lo:hi] += d @ states[:, k].T
                into["word_bias"][lo:hi] += d.sum(axis=1)
                down[:, k] += self.to_word[lo:hi].T @ d
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return found[back], None if down is None else np.take(down, back, axis=1)

    def gradients(self, inputs, fresh, targets, used, state) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient of a window's loss, in parts of a full one, by all parameters; the state after it, and the loss."""
        h, (steps, slots) = HIDDEN, inputs.shape
        flat = np.zeros_like(self.flat)
        g = self.views(flat)
        states, (before, gates, inner, recurrent, keep) = self.states(inputs, fresh, state)
        weight = (used.ravel() / (SLOTS * STEPS)).astype(np.float32)      # a window of few tokens moves little
        found, down = self.log_probabilities(_side_by_side(states), targets.ravel(), weight, g)
        down = down.reshape(h, steps, slots)
        by_input, by_state = (np.empty((steps, 3 * h, slots), np.float32) for _ in range(2))
        z, r = gates[:, :h], gates[:, h:]
        # how a state depends on the inputs of its gates, for all steps at once
        rest = 1 - z
        of_z = before - inner
        of_z *= z
        of_z *= rest
        of_n = inner * inner
        np.subtract(1, of_n, out=of_n)
        of_n *= rest
        of_r = 1 - r
        of_r *= r
        of_r *= recurrent
        back, later = np.ascontiguousarray(self.again.T), np.zeros_like(state)
        for t in range(steps - 1, -1, -1):
            d = later
            d += down[:, t]
            x, a = by_input[t], by_state[t]
            n = x[2 * h:]
            np.multiply(d, of_z[t], out=x[:h])
            np.multiply(d, of_n[t], out=n)
            np.multiply(n, of_r[t], out=x[h:2 * h])
            a[:2 * h] = x[:2 * h]
            np.multiply(n, r[t], out=a[2 * h:])
            d *= z[t]
            d += back @ a
            d *= keep[t]
        g["again"] += _side_by_side(by_state) @ _side_by_side(before).T
        names = inputs.ravel()
        for row, own in zip(g["table"], _side_by_side(by_input)):
            row += np.bincount(names, weights=own, minlength=len(row))
        return flat, states[-1], float(-(found * weight).sum())


def _side_by_side(steps: np.ndarray) -> np.ndarray:
    """[step, unit, slot] as [unit, place]."""
    return np.ascontiguousarray(steps.transpose(1, 0, 2)).reshape(steps.shape[1], -1)


class Slots:
    """Documents as windows [step, slot] of inputs, targets, first tokens, and the numbers of their documents (-1: none)."""

    def __init__(self, documents: Iterator[tuple[int, np.ndarray]]):
        self.documents = documents
        self.waiting: dict[int, tuple] = {}                   # slot -> (number, targets, first open token)
        self.over = False

    def windows(self) -> Iterator[tuple[np.ndarray, ...]]:
        """The slots in use, then what they hold. When few are left, which hold long texts, windows grow longer."""
        live = list(range(SLOTS))
        while live:
            steps = STEPS * min(max(SLOTS // len(live), 1), LONGER) if self.over else STEPS
            targets, inputs = np.zeros((len(live), steps), np.int64), np.zeros((len(live), steps), np.int64)
            fresh, number = np.zeros((len(live), steps), bool), np.full((len(live), steps), -1)
            for row, s in enumerate(live):
                at = 0
                while at < steps:
                    held = self.waiting.pop(s, None)
                    if held is None:
                        new = None if self.over else next(self.documents, None)
                        if new is None:
                            self.over = True
                            break
                        held = (*new, 0)
                    k, symbols, done = held
                    n = min(steps - at, len(symbols) - done)
                    targets[row, at:at + n] = symbols[done:done + n]
                    number[row, at:at + n] = k
                    if done:
                        inputs[row, at:at + n] = symbols[done - 1:done + n - 1]
                    else:
                        fresh[row, at] = True                 # a text begins after the end of another one
                        inputs[row, at + 1:at + n] = symbols[:n - 1]
                    at, done = at + n, done + n
                    if done < len(symbols):
                        self.waiting[s] = (k, symbols, done)
            used = np.flatnonzero(number[:, 0] >= 0)
            if len(used):
                yield np.array(live)[used], inputs[used].T, targets[used].T, fresh[used].T, number[used].T
            if self.over:
                live = sorted(self.waiting)


class Coder:
    """Texts as symbols, and the sums that their word counts give."""

    def __init__(self, counts: Counts):
        self.given, self.own = counts, len(counts.own)
        self.symbol = {None: END, **{w: k + 2 for k, w in enumerate(counts.words[:self.own - 2])}}
        self.counts = np.concatenate([[counts.documents, 0], counts.counts])
        self.logs = np.log10(self.counts + 1.0)

    def symbols(self, text: bytes) -> np.ndarray:
        """Symbols with the end."""
        words = tokens(text)
        words.append(None)
        return np.fromiter(map(self.symbol.get, words, repeat(RARE)), np.int64, len(words))

    def read(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """For each text its symbols with the end, the numbers of the counted words, and the other words."""
        words, ends = words_of(texts)
        known = pa.array(self.given.words, words.type)
        numbers = pc.fill_null(pc.index_in(words, value_set=known), -3).to_numpy().astype(np.int64) + 2
        symbols = np.where((numbers < 0) | (numbers >= self.own), RARE, numbers)
        for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
            found = numbers[lo:hi]
            other = words.take(pa.array(lo + np.flatnonzero(found < 0))).to_pylist()
            yield np.append(symbols[lo:hi], END), found[found >= 0], other


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What ``tokens`` gives for all texts, one after the other, and where the words of each text end."""
    low = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    low = pc.if_else(pc.equal(pc.binary_length(low), 0), pa.scalar(None, low.type), low)
    lists = pc.ascii_split_whitespace(low)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    return lists.flatten().cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()), ends


def slices(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts, in this column, have about ``READ_BYTES``; at least one each."""
    at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // READ_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
    for lo, hi in zip(cuts, cuts[1:]):
        if lo < hi:
            yield batch.slice(lo, hi - lo)


def _texts(column: pa.Array) -> Iterator[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for x in column.cast(kind):
        yield x.as_py() or b""


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n`` of a task's texts; a word can come more than once."""
    for batch in batches:
        for part in slices(batch, 0):
            counts = pc.value_counts(words_of(part.column(0))[0])
            yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.binary()), counts.field(1)], names=["word", "n"])


def in_training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS != HELD_OUT, F.lit(False))


def gather(rows: DataFrame) -> tuple[Counts, DataFrame]:
    """What the texts of ``rows`` hold, and the table of all their words with counts."""
    table = rows.select("text").mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    table = materialize(table, "words")
    total, types = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    documents = rows.count()
    top = table.where(F.octet_length("word") <= COUNTED_BYTES).orderBy(F.desc("n"), "word").limit(COUNTED).toArrow()
    words = [bytes(x) for x in top.column(0).to_pylist()]
    counts = top.column(1).to_numpy() if len(words) else np.empty(0, np.int64)
    return Counts(total + documents, types + (documents > 0), documents, words, counts), table


def train(rows: DataFrame, counts: Counts) -> np.ndarray:
    """Parameters after one pass over the texts of ``rows``, which have a column ``part`` from 0 to ``ROUNDS - 1``."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(counts)               # at most COUNTED words of COUNTED_BYTES
    flat = Model(counts.own).flat
    trainers = max(1, math.ceil(counts.total / ROUNDS / TRAINER_TOKENS))
    for part in range(ROUNDS):
        rate = RATE * (1 - part / ROUNDS)
        start = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], start=start, rate=rate) -> Iterator[pa.RecordBatch]:
            coder, model = Coder(shared.value), Model(shared.value.own, start.value)
            seen = fit(model, ((0, coder.symbols(t)) for b in batches for t in _texts(b.column(0))), rate)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(model.flat))), pa.array(model.flat.astype(np.float64) * seen),
                                                  pa.repeat(pa.scalar(seen), len(model.flat))], names=["k", "x", "n"])
        own = rows.where(F.col("part") == part).select("text")
        own = own.coalesce(trainers)
        mean = own.mapInArrow(run, "k long, x double, n long").groupBy("k").agg((F.sum("x") / F.sum("n")).alias("x"))
        mean = mean.toArrow()                                   # one number for each parameter
        if len(mean):
            flat = np.empty(len(flat), np.float32)
            flat[mean.column("k").to_numpy()] = mean.column("x").to_numpy()
    return flat


def fit(model: Model, documents: Iterator[tuple[int, np.ndarray]], rate: float) -> int:
    """Train a model in place, with steps scaled by running means of gradients and their squares; the tokens seen."""
    mean, square, step, seen = np.zeros_like(model.flat), np.zeros_like(model.flat), 0, 0
    state = np.zeros((HIDDEN, SLOTS), np.float32)
    for slots, inputs, targets, fresh, number in Slots(documents).windows():
        used = number >= 0
        grad, state[:, slots], _ = model.gradients(inputs, fresh, targets, used, state[:, slots])
        norm = math.sqrt(float(grad @ grad))
        if norm > 1:
            grad /= norm
        step += 1
        mean += 0.1 * (grad - mean)
        square += 0.01 * (grad * grad - square)
        model.flat -= rate / (1 - 0.9**step) * mean / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        seen += int(used.sum())
    return seen


SCORED = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, own double, shared long, "
          "words array<binary>, times array<int>")


def score_rows(counts, flat):
    """Per document: what the model and the counted words give, and its other words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, model = Coder(counts.value), Model(counts.value.own, flat.value)
        held: dict[int, list] = {}
        first = TaskContext.get().partitionId() << 33
        share = math.log10(counts.value.rare_share)
        ends_known = int(counts.value.documents > 0)

        def documents() -> Iterator[tuple[int, np.ndarray]]:
            k = 0
            for batch in batches:
                # long texts first, so that they don't go on alone at the end
                batch = batch.take(pc.sort_indices(pc.fill_null(pc.binary_length(batch.column(2)), 0), sort_keys=[("", "descending")]))
                read = chain.from_iterable(coder.read(part.column(2)) for part in slices(batch, 2))
                for doc_id, held_out, (symbols, known, other) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), read):
                    logs = float(coder.logs[known].sum() + coder.logs[END])
                    rare = known[known >= coder.own]
                    often = Counter(other)
                    own = float(coder.logs[rare].sum()) - share * (len(rare) + len(other))
                    # [model's sum, open tokens, row]
                    held[k] = [0.0, len(symbols), (first + k, doc_id, held_out, len(symbols), len(known) + ends_known, logs, own, len(other),
                                                   list(often), list(often.values()))]
                    yield k, symbols
                    k += 1

        def out(done: list[int]) -> pa.RecordBatch:
            rows = [held.pop(k) for k in done]
            columns = list(zip(*(r[2] for r in rows)))
            columns[6] = [own + r[0] / math.log(10) for own, r in zip(columns[6], rows)]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in SCORED.split(", ")])
        state, done = np.zeros((HIDDEN, SLOTS), np.float32), []
        for slots, inputs, targets, fresh, number in Slots(documents()).windows():
            states, _ = model.states(inputs, fresh, state[:, slots])
            state[:, slots] = states[-1]
            found, _ = model.log_probabilities(_side_by_side(states), targets.ravel())
            used = number.ravel() >= 0
            numbers, at = np.unique(number.ravel()[used], return_inverse=True)
            sums, sizes = np.bincount(at, weights=found[used].astype(np.float64)), np.bincount(at)
            for k, x, n in zip(numbers.tolist(), sums.tolist(), sizes.tolist()):
                row = held[k]
                row[0] += x
                row[1] -= n
                if not row[1]:
                    done.append(k)
            if len(done) >= ROWS_OUT:
                yield out(done)
                done = []
        if done:
            yield out(done)
    return run


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per document.

    Training rows are those whose crc32 of the id, modulo 7, is not 2; rows without an id count as held out. A-Z become
    small letters; tokens are words and one end for each text, null texts are empty. ``n_known`` are the tokens that
    training rows hold, ``train_tokens`` all of theirs. ``base_score`` is the sum of log10((c + 1) / (N + V + 1)) over the
    tokens, ``score`` the log10 probability that the recurrent model gives the whole text. Repeated rows are scored one by
    one; other columns are not read. Without training rows, all is unseen and scores follow from that.
    """
    held_out = ~in_training(F.col(doc_id))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("string").alias("text"))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(ROUNDS)).cast("int")
    learned = rows.where("NOT held_out").select("text", part.alias("part"))
    counts, table = gather(learned)
    flat = train(learned, counts)
    sc = docs.sparkSession.sparkContext
    scored = materialize(rows.mapInArrow(score_rows(sc.broadcast(counts), sc.broadcast(flat)), SCORED), "scored")
    others = scored.where("shared > 0").select("row", F.explode(F.arrays_zip("words", "times")).alias("_w")).select(
        "row", F.col("_w.words").alias("word"), F.col("_w.times").alias("times"))
    met = others.join(table, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("more"))
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("more_known", F.lit(0))
    out = scored.drop("words", "times").join(met, "row", "left")
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
                      (F.col("logs") + more - F.col("n_tokens") * math.log10(counts.total + counts.types + 1)).alias("base_score"),
                      (F.col("own") + more).alias("score"))
