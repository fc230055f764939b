"""Hard negatives from a geometric near-neighbour access tree: multiway hyperplanes with distance ranges.

A node's split points cut space by the hyperplanes between them: each vector belongs to the nearest split point. Every
split point stores the range of its distances to the vectors of each of its siblings' subtrees. A search is a window of
scores; for an anchor that is an annulus of distances around it. By the triangle inequality, a sibling whose range
around a split point does not meet the annulus, widened by the anchor's distance to that split point, holds no answer.

Scores are inner products. They turn into distances by one more coordinate, ``sqrt(M - |x|**2)`` for vectors and 0 for
anchors, with M the largest squared norm: then ``d**2 = |a|**2 + M - 2 <a, x>``, whatever the norms are.

The root's split points come from a bounded sample; its ranges cover every row. A subtree is held in chunks of
``CHUNK_ROWS``, so a point that a third of all rows share is no hot task. Each chunk's task builds the next level from its
rows, eliminates its children in the same way, and reads the leaves that remain exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from redpencil.session import materialize

SAMPLE = 2048                    # vectors that split points are chosen from
SPLITS = 24                      # split points of the root
LEAVES = 12                      # split points, so leaves, of a chunk
CHUNK_ROWS = 4096
ANCHORS = 2048                   # anchors that meet a chunk at once
TOGETHER = 256                   # anchors of one product
LOW, HIGH = -(1 << 62), 1 << 62  # a window open on a side
FOUND = "anchor long, slot int, found_id long, score long"


def farthest_first(points: np.ndarray, n: int) -> np.ndarray:
    """Rows of up to ``n`` different points, each the farthest from those before it."""
    chosen = [0] if len(points) else []
    gap = ((points - points[0]) ** 2).sum(axis=1) if len(points) else np.empty(0)
    while len(chosen) < n and len(gap) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen, np.int64)


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Euclidean distances; both with the lifting coordinate."""
    square = (points ** 2).sum(axis=1)[:, None] + (centres ** 2).sum(axis=1) - 2 * (points @ centres.T)
    return np.sqrt(np.maximum(square, 0))


def lift(vectors: np.ndarray, most: float) -> np.ndarray:
    extra = np.sqrt(np.maximum(most - (vectors ** 2).sum(axis=1), 0))
    return np.column_stack([vectors, extra])


class Annuli:
    """The distances from each anchor that its window of scores allows."""

    def __init__(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray, most: float):
        square = (anchors ** 2).sum(axis=1) + most
        # the exact distance lies within the rounding of the products it comes from
        self.slack = 1e-6 * np.sqrt(square.max(initial=0)) + 1e-6
        self.inner = np.sqrt(np.maximum(square - 2.0 * high, 0))
        self.outer = np.sqrt(np.maximum(square - 2.0 * low, 0))
        self.empty = (low > high) | (square - 2.0 * low < -self.slack * self.slack)
        self.lifted = np.column_stack([anchors, np.zeros(len(anchors))])

    def meet(self, centres: np.ndarray, ranges: np.ndarray) -> np.ndarray:
        """For each anchor which subtrees can hold an answer; ``ranges[i, j]`` are the distances from centre i to subtree j."""
        ok = np.repeat(~self.empty[:, None], ranges.shape[1], axis=1)
        d = distances(self.lifted, centres)
        for i in range(len(centres)):
            near = np.maximum(np.maximum(self.inner - d[:, i], d[:, i] - self.outer), 0) - self.slack
            far = d[:, i] + self.outer + self.slack
            ok &= (ranges[i, :, 0] <= far[:, None]) & (ranges[i, :, 1] >= near[:, None])
        return ok


def ranges_of(gaps: np.ndarray, child: np.ndarray, children: int) -> np.ndarray:
    """Least and largest distance from every centre to every child; of a child without rows a range that meets nothing."""
    out = np.empty((gaps.shape[1], children, 2))
    out[..., 0], out[..., 1] = np.inf, -np.inf
    for c in range(children):
        own = gaps[child == c]
        if len(own):
            out[:, c, 0], out[:, c, 1] = own.min(axis=0), own.max(axis=0)
    return out


def exact_kind(anchors: np.ndarray, vectors: np.ndarray):
    """A type in which inner products of these integers are exact."""
    reach = int(np.abs(anchors).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    return np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else object


class Chunk:
    """A subtree's next level over one chunk of its rows, which are in ascending order of their ids."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: float):
        self.most = most
        points = lift(vectors.astype(np.float64), most)
        self.centres = points[farthest_first(points, LEAVES)]
        gaps = distances(points, self.centres)
        leaf = gaps.argmin(axis=1)
        self.ranges = ranges_of(gaps, leaf, len(self.centres))
        self.leaves = [(ids[k], labels[k], vectors[k]) for k in (np.flatnonzero(leaf == c) for c in range(len(self.centres)))]

    def search(self, keys: np.ndarray, own_ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray,
               same: bool, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """The ``k`` best rows of each window: ``key, slot, id, score``. ``low`` and ``high`` are [anchor, slot].

        With ``same`` rows of the anchor's label but not of its id, otherwise rows of other labels.
        """
        for at in range(0, len(keys), TOGETHER):
            part = slice(at, at + TOGETHER)
            slots = low.shape[1]
            annuli = [Annuli(vectors[part].astype(np.float64), low[part, s], high[part, s], self.most) for s in range(slots)]
            meets = np.stack([a.meet(self.centres, self.ranges) for a in annuli], axis=1)       # [anchor, slot, leaf]
            bar = low[part].copy()
            held: list[tuple] = []
            for c, (ids, own, rows) in enumerate(self.leaves):
                live = np.flatnonzero(meets[:, :, c].any(axis=1))
                if not len(live) or not len(ids):
                    continue
                kind = exact_kind(vectors[part], rows)
                scores = vectors[part][live].astype(kind) @ rows.astype(kind).T
                allowed = (own[None, :] == labels[part][live][:, None]) == same
                if same:
                    allowed &= ids[None, :] != own_ids[part][live][:, None]
                for s in range(slots):
                    window = allowed & (scores >= bar[live, s][:, None]) & (scores <= high[part][live, s][:, None])
                    window &= meets[live, s, c][:, None]
                    a, r = np.nonzero(window)
                    if not len(a):
                        continue
                    found = scores[a, r].astype(np.int64)
                    # the k best of each anchor; rows are in ascending order of ids already
                    order = np.lexsort((r, -found, a))
                    a, r, found = a[order], r[order], found[order]
                    place = np.arange(len(a)) - np.searchsorted(a, a)
                    a, r, found, place = (x[place < k] for x in (a, r, found, place))
                    held.append((keys[part][live[a]], np.full(len(a), s), ids[r], found))
                    full = place == k - 1
                    bar[live[a[full]], s] = np.maximum(bar[live[a[full]], s], found[full])
            if held:
                key, slot, ids, found = (np.concatenate(x) for x in zip(*held))
                order = np.lexsort((ids, -found, slot, key))
                key, slot, ids, found = key[order], slot[order], ids[order], found[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (slot[1:] != slot[:-1])
                first = np.flatnonzero(new)
                place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
                yield tuple(x[place < k] for x in (key, slot, ids, found))


def pack(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("long"))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class Tree:
    """The root: split points, each subtree's chunks, and the ranges of distances between them, from all rows."""

    def __init__(self, rows: DataFrame, size: int):
        self.size = size
        self.rows = rows
        order = F.xxhash64("id", "row")
        sample = rows.orderBy(order, "row").limit(SAMPLE).select("vector").toArrow()
        squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
        self.most = float(rows.agg(F.max(squares)).first()[0] or 0.0)
        points = lift(_matrix(sample.column(0), size).astype(np.float64), self.most)
        self.centres = points[farthest_first(points, SPLITS)]
        centres, most = self.centres, self.most

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    gaps = distances(lift(_matrix(b.column("vector"), size).astype(np.float64), most), centres)
                    yield b.append_column("subtree", pa.array(gaps.argmin(axis=1).astype(np.int32)))

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count, total = len(centres), np.zeros(len(centres), np.int64)
            found = ranges_of(np.empty((0, count)), np.empty(0), count)
            for b in batches:
                if not len(b):
                    continue
                gaps = distances(lift(_matrix(b.column("vector"), size).astype(np.float64), most), centres)
                child = b.column("subtree").to_numpy()
                new = ranges_of(gaps, child, count)
                found[..., 0], found[..., 1] = np.minimum(found[..., 0], new[..., 0]), np.maximum(found[..., 1], new[..., 1])
                total += np.bincount(child, minlength=count)
            i, j = (x.ravel() for x in np.indices((count, count)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (i, j, found[..., 0].ravel(), found[..., 1].ravel(), total[j])],
                                             names=["i", "j", "low", "high", "n"])
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", subtree int"
        self.placed = materialize(rows.mapInArrow(place, schema), "tree")
        # one row for each pair of split points
        table = self.placed.mapInArrow(measure, "i long, j long, low double, high double, n long").groupBy("i", "j").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
        self.ranges = ranges_of(np.empty((0, len(centres))), np.empty(0), len(centres))
        self.chunks = [1] * len(centres)
        for r in table:
            self.ranges[r.i, r.j] = r.low, r.high
            self.chunks[r.j] = max(1, math.ceil(r.n / CHUNK_ROWS))
        counts = F.array(*(F.lit(n) for n in self.chunks))
        self.chunked = self.placed.withColumn("chunk", F.pmod(F.xxhash64("row"), F.get(counts, F.col("subtree"))).cast("int"))

    def search(self, windows: DataFrame, same: bool, k: int, slots: int, elsewhere: bool | None = None) -> DataFrame:
        """``anchor, slot, found_id, score``: the best ``k`` of each chunk for every window that can hold an answer there.

        ``windows`` has ``anchor, id, label, vector, low, high, subtree``, the last three arrays of ``slots`` numbers and the anchor's own
        subtree. ``elsewhere``: only other subtrees than that (True), only that one (False), or all.
        """
        size, most, centres, ranges, chunks = self.size, self.most, self.centres, self.ranges, self.chunks

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b):
                    continue
                anchors = _matrix(b.column("vector"), size).astype(np.float64)
                low, high = _matrix(b.column("low"), slots), _matrix(b.column("high"), slots)
                ok = np.zeros((len(b), len(centres)), bool)
                for s in range(slots):
                    ok |= Annuli(anchors, low[:, s], high[:, s], most).meet(centres, ranges)
                if elsewhere is not None:
                    own = b.column("subtree").to_numpy()[:, None] == np.arange(len(centres))
                    ok = ok & ~own if elsewhere else own
                a, j = np.nonzero(ok)
                yield b.drop_columns(["subtree"]).take(pa.array(a)).append_column("subtree", pa.array(j.astype(np.int32)))
        count = max(1, math.ceil(windows.count() / ANCHORS))
        block = F.pmod(F.xxhash64("anchor"), F.lit(count)).cast("int")
        narrow = "anchor long, id long, label int, vector array<bigint>, low array<bigint>, high array<bigint>, subtree int"
        asked = windows.select("anchor", "id", "label", "vector", "low", "high", "subtree").mapInArrow(route, narrow)
        every = F.array(*(F.sequence(F.lit(0), F.lit(n - 1)) for n in chunks))
        asked = asked.withColumn("chunk", F.explode(F.get(every, F.col("subtree")))).withColumn("block", block).withColumn("kind", F.lit(1))
        none = F.lit(None).cast("array<bigint>")
        held = self.chunked.select(F.col("row").alias("anchor"), "id", "label", "vector", none.alias("low"), none.alias("high"), "subtree", "chunk",
                                   F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"), F.lit(0).alias("kind"))
        columns = ["subtree", "chunk", "block", "kind", "id", "anchor", "label", "vector", "low", "high"]
        met = held.select(columns).union(asked.select(columns))
        tasks = max(1, sum(chunks)) * count
        met = met.repartition(min(tasks, 100_000), "subtree", "chunk", "block").sortWithinPartitions("subtree", "chunk", "block", "kind", "id", "anchor")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk, now = None, None
            for t in groups(batches, ("subtree", "chunk", "block", "kind")):
                key = tuple(t.column(c)[0].as_py() for c in ("subtree", "chunk", "block"))
                ids, labels, vectors = t.column("id").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("vector"), size)
                if not t.column("kind")[0].as_py():
                    chunk, now = Chunk(ids, labels, vectors, most), key
                elif key == now:
                    low, high = _matrix(t.column("low"), slots), _matrix(t.column("high"), slots)
                    for found in chunk.search(t.column("anchor").to_numpy(), ids, labels, vectors, low, high, same, k):
                        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
                                                         names=["anchor", "slot", "found_id", "score"])
        return met.mapInArrow(run, FOUND)


def groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows that are equal in some columns, one table each; at most a chunk and a block of anchors are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        new = np.zeros(len(batch) - 1, bool)
        for c in by:
            x = batch.column(c).to_numpy()
            new |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
        for lo, hi in zip(cuts, cuts[1:]):
            part = batch.slice(lo, hi - lo)
            if held and any(held[-1].column(c)[0] != part.column(c)[0] for c in by):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each window, ``rank`` from 1; ties to the smaller id."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``id, label, vector`` with integers in the vectors. An anchor's positives are the ``positives`` best other rows of its
    label, its hard negatives for each positive the ``negatives`` best rows of other labels whose score lies between ``least`` and
    ``most`` percent of the positive's. Best: the largest inner product with the anchor, ties to the smaller id.

    Rows without id, label or vector, those with a null component, and vectors of another length than most have take no
    part. Rows that repeat an id count each on their own, but are no positives of an anchor with their id; equal anchor
    rows (id, label and vector) are one anchor. An anchor without positives, or without negatives in the window, has no rows there.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    vector = F.col("vector").cast("array<bigint>")
    usable = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), vector.alias("vector"),
                         F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    usable = usable.where("id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0").where(F.forall("vector", lambda x: x.isNotNull()))
    usable = materialize(usable.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = usable.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return rows.sparkSession.createDataFrame([], schema)
    tree = Tree(usable.where(F.size("vector") == sizes["size"]), sizes["size"])
    asks = tree.placed.where("asks").groupBy("id", "label", "vector").agg(F.min("row").alias("anchor"), F.min("subtree").alias("subtree"))
    asks = materialize(asks, "anchors")

    def window(low: Column, high: Column) -> list[Column]:
        return [F.array(low.cast("long")).alias("low"), F.array(high.cast("long")).alias("high")]
    # the anchor's own subtree first: its positives there bound the search elsewhere
    here = materialize(best(tree.search(asks.select("*", *window(F.lit(LOW), F.lit(HIGH))), True, positives, 1, elsewhere=False), positives), "near")
    bars = here.where(F.col("rank") == positives).select("anchor", F.col("score").alias("bar"))
    bounded = asks.join(bars, "anchor", "left").select("anchor", "id", "label", "vector", "subtree", *window(F.coalesce("bar", F.lit(LOW)), F.lit(HIGH)))
    there = tree.search(bounded, True, positives, 1, elsewhere=True)
    positive = materialize(best(here.drop("rank").unionByName(there), positives), "positives")
    # a window of scores for each positive, all of an anchor's in one search
    slots = positive.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "found_id", "score"))).alias("found"))

    def bound(k: int, percent: int, up: bool) -> Column:
        score = F.col("found")[k]["score"].cast("decimal(38,0)") * percent
        whole = F.ceil(score / 100) if up else F.floor(score / 100)
        return F.when(F.size("found") > k, whole.cast("long")).otherwise(F.lit(HIGH if up else LOW))
    windows = asks.join(slots, "anchor").select(
        "anchor", "id", "label", "vector", "subtree",
        F.array(*(bound(k, least, True) for k in range(positives))).alias("low"), F.array(*(bound(k, most, False) for k in range(positives))).alias("high"))
    found = best(tree.search(windows, False, negatives, positives), negatives)
    names = asks.select("anchor", F.col("id").alias("anchor_id"))
    matched = positive.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.join(matched, ["anchor", "slot"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
