"""Exact top-k search by inner product with the MaxScore method over integer vectors.

A dimension is a term, its postings are a shard's vectors with their values there. What the terms from some place on can
add to a query's score is bounded twice: by the range of the shard's values in each of them, and by the product of the
query's and the vector's lengths in them; the lesser one counts. The terms that together cannot lift a vector over the
query's k-th best score so far are not essential: only the postings of the others are traversed for every vector, and
what is still competitive then is probed in the remaining terms, some at a time.

Candidates are cut into shards and queries into blocks. Every block meets every shard once, in a task that holds one of
each, goes through its shards in order and keeps the k best of each query; the parts are merged at the end. Essential
terms are summed for a block and a shard as one product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from redpencil.llm.common import partitions_for
from redpencil.session import materialize

SHARD_ROWS = 2048
BLOCK_ROWS = 8192
TOGETHER = 256                   # queries of one product
SHARDS_PER_TASK = 4
TERMS = 16                       # terms that are added at once
SPARSE = 0.1                     # below this share of competitive pairs each is probed on its own
SCALE = 64
LEAST = -(2**62)                # below every score


def integers(embedding: Column, scale: int = SCALE) -> Column:
    """Components as ``floor(scale * x)``."""
    return F.transform(embedding.cast("array<double>"), lambda x: F.floor(x * scale).cast("long"))


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """A type in which inner products of these integers are exact."""
    reach = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64


class Shard:
    """A shard's vectors in ascending order of ids, with its terms from the widest range to the narrowest."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, vectors = ids[order], vectors[order]
        self.terms = np.argsort(vectors.min(axis=0) - vectors.max(axis=0), kind="stable")
        self.vectors = vectors[:, self.terms]
        self.low, self.high = self.vectors.min(axis=0), self.vectors.max(axis=0)
        self.steps = [*range(0, self.vectors.shape[1], TERMS), self.vectors.shape[1]]
        self.lengths = self.rests(self.vectors)

    def rests(self, rows: np.ndarray) -> np.ndarray:
        """Lengths of rows in the terms from each step on, rounded up."""
        square = rows.astype(np.float64) ** 2
        tails = np.stack([square[:, at:].sum(axis=1) for at in self.steps], axis=1)
        return np.sqrt(tails) * (1 + 1e-9)


class TopK:
    """The best candidates of each query of a block so far; of equal scores the smaller id."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = query_ids, queries, k
        self.scores = np.full((len(query_ids), k), LEAST)
        self.found = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def shard(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Add a shard's vectors."""
        shard = Shard(ids, vectors)
        for at in range(0, len(self.ids), TOGETHER):
            self.some(np.arange(at, min(at + TOGETHER, len(self.ids))), shard)

    def some(self, mine: np.ndarray, shard: Shard) -> None:
        queries = self.queries[mine][:, shard.terms]
        best = np.maximum(queries * shard.low, queries * shard.high)
        gain = np.stack([best[:, at:].sum(axis=1) for at in shard.steps], axis=1)      # the most that ranges allow from a step on
        own = shard.rests(queries)
        bar = self.scores[mine, -1]                               # LEAST until k are found
        most = np.minimum(gain[:, 0], own[:, 0] * shard.lengths[:, 0].max(initial=0))
        live = most >= bar
        if not live.any():
            return                                                # no vector of the shard can compete
        mine, queries, gain, own, bar = (x[live] for x in (mine, queries, gain, own, bar))
        # essential: the first terms, until the others alone can't reach any query's bar
        rest = np.minimum(gain, own * shard.lengths.max(axis=0, initial=0))
        essential = int(np.argmax((rest < bar[:, None]).all(axis=0))) if (rest < bar[:, None]).all(axis=0).any() else len(shard.steps) - 1
        kind = exact_kind(queries, shard.vectors)
        q, v = queries.astype(kind), shard.vectors.astype(kind)
        step = max(essential, 1)
        at = shard.steps[step]
        scores = q[:, :at] @ v[:, :at].T
        pairs = None
        while pairs is None and step < len(shard.steps) - 1:
            alive = scores + self._bound(gain[:, step, None], own[:, step, None], shard.lengths[None, :, step], kind) >= bar[:, None]
            if alive.mean() < SPARSE:
                pairs = np.nonzero(alive)
                break
            to = shard.steps[step + 1]
            scores += q[:, at:to] @ v[:, at:to].T
            step, at = step + 1, to
        if pairs is None:
            pairs = np.nonzero((scores >= bar[:, None]) & (shard.ids[None, :] != self.ids[mine][:, None]))
            a, b = pairs
            score = scores[a, b]
        else:
            a, b = pairs
            score = scores[a, b]
            while step < len(shard.steps) - 1 and len(a):
                to = shard.steps[step + 1]
                score = score + np.einsum("ij,ij->i", q[a, at:to], v[b, at:to])
                step, at = step + 1, to
                ok = score + self._bound(gain[a, step], own[a, step], shard.lengths[b, step], kind) >= bar[a]
                a, b, score = a[ok], b[ok], score[ok]
            ok = shard.ids[b] != self.ids[mine][a]
            a, b, score = a[ok], b[ok], score[ok]
        self._merge(mine, a, shard.ids[b], score.astype(np.int64))

    @staticmethod
    def _bound(gain: np.ndarray, own: np.ndarray, other: np.ndarray, kind: type) -> np.ndarray:
        bound = np.minimum(gain, own * other)
        bound = np.ceil(bound + np.abs(bound) * 1e-9)
        return bound.astype(kind) if kind is not np.float32 else np.nextafter(bound.astype(np.float32), np.float32(np.inf))

    def _merge(self, mine: np.ndarray, a: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """The k best of what was found and what was there, for the queries ``mine``; ``a`` are places in it."""
        order = np.lexsort((ids, -scores, a))
        a, ids, scores = a[order], ids[order], scores[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        ok = place < self.k
        a, ids, scores, place = a[ok], ids[ok], scores[ok], place[ok]
        new_scores, new_ids = np.full((len(mine), self.k), LEAST), np.full((len(mine), self.k), np.iinfo(np.int64).max)
        new_scores[a, place], new_ids[a, place] = scores, ids
        both = np.concatenate([self.scores[mine], new_scores], axis=1), np.concatenate([self.found[mine], new_ids], axis=1)
        best = np.lexsort((both[1], -both[0]), axis=1)[:, :self.k]
        self.scores[mine], self.found[mine] = (np.take_along_axis(x, best, axis=1) for x in both)

    def results(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        full = self.scores > LEAST
        return np.repeat(self.ids, full.sum(axis=1)), self.found[full], self.scores[full]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query its k best vectors but itself, ranks from 1.

    Vectors hold integers. Vectors without id, null ones and those with a null component take no part, vectors of
    another size than the query don't either. Rows that repeat an id are searched and found each on their own, apart
    from a query's own id. Ties go to the smaller id. Without candidates a query has no rows.
    """
    def clean(df: DataFrame) -> DataFrame:
        v = F.col(embedding).cast("array<long>")
        rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector"))
        rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
        return rows.withColumn("size", F.size("vector"))
    candidates, asked = materialize(clean(vectors), "candidates"), materialize(clean(queries), "queries")
    shards = partitions_for(candidates.count(), SHARD_ROWS)
    blocks = partitions_for(asked.count(), BLOCK_ROWS)
    groups = partitions_for(shards, SHARDS_PER_TASK)
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    left = asked.withColumn("block", block).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        "block", "group", "size", F.lit(-1).alias("shard"), "vec_id", "vector")
    right = candidates.withColumn("shard", shard).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        "block", F.pmod("shard", F.lit(groups)).cast("int").alias("group"), "size", "shard", "vec_id", "vector")
    met = left.union(right).repartition(blocks * groups, "block", "group").sortWithinPartitions("block", "group", "size", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: TopK | None = None
        now, rest = None, None

        def finish() -> Iterator[pa.RecordBatch]:
            if state is not None and len(state.ids):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in state.results()], names=["query_id", "vec_id", "score"])

        def take(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal state, now
            key = tuple(t.column(c)[0].as_py() for c in ("block", "group", "size"))
            ids = t.column("vec_id").to_numpy()
            values = pa.concat_arrays(t.column("vector").chunks).flatten().to_numpy().reshape(len(ids), key[2])
            if key != now:
                yield from finish()
                now, state = key, None
            if t.column("shard")[0].as_py() < 0:
                state = TopK(ids, values, k)
            elif state is not None:
                state.shard(ids, values)

        def parts(t: pa.Table) -> list[pa.Table]:
            columns = [t.column(c).to_numpy() for c in ("block", "group", "size", "shard")]
            new = np.zeros(len(t) - 1, bool)
            for c in columns:
                new |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(t)]
            return [t.slice(x, y - x) for x, y in zip(cuts, cuts[1:])]
        for batch in batches:
            held = pa.Table.from_batches([batch])
            held = held if rest is None else pa.concat_tables([rest, held])
            if not len(held):
                continue
            *done, rest = parts(held)
            for t in done:
                yield from take(t)
        if rest is not None:
            yield from take(rest)
        yield from finish()
    best = met.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
