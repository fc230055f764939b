"""Near-duplicate embeddings by a subspace pigeonhole join, verified exactly.

Unit vectors with a cosine of at least c have a squared distance of at most ``2 - 2c``. After one rotation, which
spreads the distance over all coordinates, vectors are cut into blocks of ``BLOCK`` coordinates, and in at least one
block the squared distance is at most the block's share of that budget. In each block a range join finds these
pairs: vectors are sorted into strips along the block's first coordinate, as wide as the block's radius, and meet
those of their own strip and of the next one. A pair is counted in the first block that finds it, so the union of the
candidates needs no shuffle.

Rotated coordinates travel in single precision, and a block's distance is always the same sum of the same numbers, so
all tasks agree on which block finds a pair first; radius and strips are wider by what rounding can add. A candidate's
cosine is then known to ``DOUBT``: only pairs closer than that to the bound leave their task, and are verified on the given
vectors in double precision.

Equal vectors of a label meet as one with a count. A strip can hold a third of all vectors, so it is dealt to chunks
that meet in pairs. A task holds two chunks; it gives back counts and the links of a spanning forest, not the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from redpencil.llm.common import components
from redpencil.session import materialize

COSINE = 0.93
BLOCK = 8
CHUNK = 4096
TOGETHER = 1024                  # rows of a chunk that are compared at once
SLACK = 1e-5                     # of a block's squared distance, for the rounding of rotated coordinates
DOUBT = 1e-5                     # of a cosine, for the same; pairs nearer to the bound are verified in double precision


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def block_bounds(size: int) -> list[tuple[int, int]]:
    return [(k, min(k + BLOCK, size)) for k in range(0, size, BLOCK)]


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def radius(budget: float, block: tuple[int, int], size: int) -> float:
    return float(np.sqrt(budget * (block[1] - block[0]) / size + SLACK)) + 1e-6


def with_strips(rows: DataFrame, budget: float) -> DataFrame:
    """``cls, label, n, size, turned, strips``: rotated coordinates, and the number of the strip in each block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            turned, strips = [], []
            for v in vectors:
                t = (unit_vectors(np.array([v], float))[0] @ rotation_of(len(v))).astype(np.float32)
                turned.append(t)
                strips.append([int(np.floor(float(t[a]) / radius(budget, (a, b), len(v)))) for a, b in block_bounds(len(v))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("cls"), batch.column("label"), batch.column("n"), pa.array([len(v) for v in vectors], pa.int32()),
                 pa.array(turned, pa.list_(pa.float32())), pa.array(strips, pa.list_(pa.int32()))],
                names=["cls", "label", "n", "size", "turned", "strips"])
    return rows.select("cls", "label", "n", "vector").mapInArrow(
        run, "cls long, label string, n long, size int, turned array<float>, strips array<int>")


_rotations: dict[int, np.ndarray] = {}


def rotation_of(size: int) -> np.ndarray:
    if size not in _rotations:
        _rotations[size] = rotation(size)
    return _rotations[size]


class _Forest:
    """Links that join what was apart within a task's group."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def block_distance(x: np.ndarray, y: np.ndarray, block: tuple[int, int]) -> np.ndarray:
    """Squared distances of rows in a block: one sum in one order, so that all tasks find the same."""
    total = np.zeros(len(x))
    for k in range(*block):
        gap = x[:, k].astype(np.float64) - y[:, k]
        total += gap * gap
    return total


def compare(left: np.ndarray, right: np.ndarray | None, block: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row pairs of a chunk and another one (or itself) that this block finds first and that are near enough, or may be:
    ``i, j, sure``."""
    same = right is None
    right = left if same else right
    size, budget = left.shape[1], 2 - 2 * cosine
    bounds = block_bounds(size)
    a, b = bounds[block]
    limits = [budget * (y - x) / size + SLACK for x, y in bounds]
    squares = [(z[:, a:b].astype(np.float64) ** 2).sum(axis=1).astype(np.float32) for z in (left, right)]
    for p in range(0, len(left), TOGETHER):
        for q in range(p if same else 0, len(right), TOGETHER):
            x, y = left[p:p + TOGETHER], right[q:q + TOGETHER]
            # a first look by one product, a little wider than the limit
            near = squares[0][p:p + TOGETHER, None] + squares[1][None, q:q + TOGETHER] - 2 * (x[:, a:b] @ y[:, a:b].T) <= np.float32(limits[block] + SLACK)
            if same and p == q:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            for at in range(0, len(i), 200_000):
                u, v = i[at:at + 200_000], j[at:at + 200_000]
                ok = block_distance(x[u], y[v], bounds[block]) <= limits[block]
                u, v = u[ok], v[ok]
                about = np.einsum("ij,ij->i", x[u], y[v], dtype=np.float64)
                ok = about >= cosine - DOUBT
                u, v, about = u[ok], v[ok], about[ok]
                for k in range(block):                  # an earlier block has found it
                    later = block_distance(x[u], y[v], bounds[k]) > limits[k]
                    u, v, about = u[later], v[later], about[later]
                yield u + p, v + q, about >= cosine + DOUBT


def block_join(rows: DataFrame, cosine: float) -> DataFrame:
    """``a, b, n``: with b null, the number of vectors linked with a that one meeting found; with n zero a link of a
    forest; with n null a pair in doubt."""
    parts = rows.select("cls", "label", "n", "size", "turned", F.posexplode("strips").alias("block", "strip"))
    keys = ["label", "size", "block", "strip"]
    counts = parts.groupBy(*keys).agg(F.count("*").alias("rows"))
    chunked = parts.join(counts, keys)
    chunks = F.ceil(F.col("rows") / CHUNK).cast("int")
    # the strip before this one is met by its rows coming over; they need the number of its chunks
    ahead = counts.select("label", "size", "block", (F.col("strip") - 1).alias("strip"), F.ceil(F.col("rows") / CHUNK).cast("int").alias("next"))
    chunked = chunked.withColumn("chunks", chunks).join(ahead, keys, "left").withColumn(
        "chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))

    def meeting(strip, low, high, side):
        return F.struct(F.xxhash64("label", "size", "block", strip, low, high, F.lit(0)).alias("meeting"), F.lit(side).alias("side"),
                        F.xxhash64("label", "size", "block", strip, low, high, F.lit(1)).alias("check"))
    c = F.col("chunk")
    own = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.when(
        o == c, meeting(F.col("strip"), c, c, 2)).when(o > c, meeting(F.col("strip"), c, o, 0)).otherwise(meeting(F.col("strip"), o, c, 1)))
    # across strips: side 0 is the strip, side 1 the next one; the chunk of the next strip is counted from -1 down
    forth = F.when(F.col("next").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("next") - 1), lambda o: meeting(
        F.col("strip"), c, -1 - o, 0))).otherwise(F.array())
    before = counts.select("label", "size", "block", (F.col("strip") + 1).alias("strip"), F.ceil(F.col("rows") / CHUNK).cast("int").alias("previous"))
    back = F.when(F.col("previous").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("previous") - 1), lambda o: meeting(
        F.col("strip") - 1, o, -1 - c, 1))).otherwise(F.array())
    met = chunked.join(before, keys, "left").withColumn("m", F.explode(F.concat(own, forth, back)))
    met = met.select(F.col("m.meeting").alias("meeting"), F.col("m.check").alias("check"), F.col("m.side").alias("side"), "block", "cls", "n", "turned")
    met = met.repartition("meeting").sortWithinPartitions("meeting", "check", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def finish(t: pa.Table) -> Iterator[pa.RecordBatch]:
            cls, n, side = (t.column(x).to_numpy() for x in ("cls", "n", "side"))
            turned = pa.concat_arrays(t.column("turned").chunks).flatten().to_numpy().reshape(len(cls), -1)
            # side 2: a chunk with itself
            left, right, alone = (np.flatnonzero(side == s) for s in (0, 1, 2))
            if not len(alone) and not (len(left) and len(right)):
                return
            left, other = (alone, alone) if len(alone) else (left, right)
            total, forest, links, doubts = np.zeros(len(cls), np.int64), _Forest(), [], []
            for i, j, sure in compare(turned[left], None if len(alone) else turned[right], t.column("block")[0].as_py(), cosine):
                i, j = left[i], other[j]
                doubts += zip(cls[i[~sure]].tolist(), cls[j[~sure]].tolist())
                i, j = i[sure], j[sure]
                np.add.at(total, i, n[j])
                np.add.at(total, j, n[i])
                links += [(x, y) for x, y in zip(cls[i].tolist(), cls[j].tolist()) if forest.join(x, y)]
            found = np.flatnonzero(total)
            pairs = links + doubts
            yield pa.RecordBatch.from_arrays(
                [pa.array([*cls[found].tolist(), *(x for x, _ in pairs)], pa.int64()), pa.array([None] * len(found) + [y for _, y in pairs], pa.int64()),
                 pa.array([*total[found].tolist(), *[0] * len(links), *[None] * len(doubts)], pa.int64())], names=["a", "b", "n"])

        def groups(t: pa.Table) -> Iterator[pa.Table]:
            m, c = t.column("meeting").to_numpy(), t.column("check").to_numpy()
            cuts = [0, *(np.flatnonzero((m[1:] != m[:-1]) | (c[1:] != c[:-1])) + 1).tolist(), len(m)]
            for x, y in zip(cuts, cuts[1:]):
                yield t.slice(x, y - x)
        for batch in batches:
            held = pa.Table.from_batches([batch])
            held = held if rest is None else pa.concat_tables([rest, held])
            parts = list(groups(held)) if len(held) else []
            for t in parts[:-1]:
                yield from finish(t)
            rest = parts[-1] if parts else held
        if rest is not None and len(rest):
            yield from finish(rest)
    return met.mapInArrow(run, "a long, b long, n long")


def verified(pairs: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """``a, b, na, nb``: the pairs of classes whose cosine is large enough in double precision, with the classes' sizes."""
    @F.arrow_udf("boolean")
    def near(x: pa.Array, y: pa.Array) -> pa.Array:
        found = [float(unit_vectors(np.array([a], float))[0] @ unit_vectors(np.array([b], float))[0]) >= cosine for a, b in zip(x.to_pylist(), y.to_pylist())]
        return pa.array(found, pa.bool_())
    one = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("vector").alias("va"))
    two = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("vector").alias("vb"))
    both = pairs.select("a", "b").distinct().join(one, "a").join(two, "b")
    return materialize(both.where(near("va", "vb")).select("a", "b", "na", "nb"), "vector-pairs")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding",
                 label: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per vector.

    Vectors of one label with a cosine of at least ``cosine`` are linked; the component is what links reach, named by
    its smallest id. Vectors without label or id, and those that are null, empty, all zero or hold a null or
    non-finite component link with nothing and are their own component (null without id). Vectors of other sizes
    never meet. Rows that repeat a vector are linked with each other, also under one id. An empty table gives no rows.
    """
    v = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("vector"), F.col(label).cast("string").alias("label"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vector") > 0)).where(finite).where(
        F.exists("vector", lambda x: x != 0))
    classes = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    # an id for each class; several classes can have one smallest id only if ids repeat
    classes = classes.withColumn("cls", F.xxhash64("label", "vector"))
    classes = materialize(classes, "vector-classes")
    found = materialize(block_join(with_strips(classes, 2 - 2 * cosine), cosine), "vector-links")
    pairs = verified(found.where("b IS NOT NULL AND n IS NULL"), classes, cosine)
    counts = found.where("b IS NULL").select(F.col("a").alias("cls"), "n").union(pairs.select("a", "nb")).union(pairs.select("b", "na"))
    linked = counts.groupBy("cls").agg(F.sum("n").alias("others"))
    parts = components(found.where("b IS NOT NULL AND n = 0").select("a", "b").union(pairs.select("a", "b")))
    placed = classes.select("cls", "rep", "n").join(parts, F.col("cls") == F.col("node"), "left").withColumn("part", F.coalesce("component", "cls"))
    names = placed.groupBy("part").agg(F.min("rep").alias("component_id"))
    placed = placed.join(names, "part").join(linked, "cls", "left")
    result = placed.select("cls", "component_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    usable_row = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vector") > 0) & finite
                  & F.exists("vector", lambda x: x != 0))
    out = rows.select("vec_id", F.when(usable_row, F.xxhash64("label", "vector")).alias("cls")).join(result, "cls", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id"),
                      (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"))
