"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on full shingle sets.

``SAMPLES`` MinHash values of a document serve twice: in bands of ``ROWS``, whose equal values propose pairs, and
folded into an odd sketch, a bitmap of parities. Each sample that two documents don't share flips at most two bits of
the exclusive or of their sketches, so a pair with more set bits than ``2 * most_differing()`` is left out before its
texts are read. What remains is confirmed on the full sets.

Only one document of each different set takes part. Bands hold a third of them at worst, so pairs within a band are
not emitted: every document is first compared with the band's smallest; documents that are still in different components
meet in blocks of ``CHUNK``, first by their sketches, then those that pass by their texts, and
only links leave the task. What is in one component needs no more comparisons, so no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType

from redpencil.llm.common import components
from redpencil.session import materialize

WORDS = 2                        # words of a shingle
SIMILARITY = 80                  # percent of the union
ROWS, BANDS = 4, 36              # a pair at the bound shares no band with probability (1 - 0.8 ** 4) ** 36 < 1e-8
SAMPLES = ROWS * BANDS
SKETCH_LONGS = 16                # 1024 bits
CHUNK = 256
REMEMBERED = 250_000
_RANDOM = np.random.default_rng(20240917)
FACTORS = _RANDOM.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RANDOM.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_PLACES = (np.arange(SAMPLES, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)


def most_differing(samples: int = SAMPLES, similarity: float = SIMILARITY / 100, risk: float = 1e-9) -> int:
    """The number of differing samples that a pair at the bound exceeds with at most this probability."""
    tail, d = 0.0, samples
    while d:
        tail += math.comb(samples, d) * (1 - similarity) ** d * similarity ** (samples - d)
        if tail > risk:
            return d
        d -= 1
    return 0


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value


_hashes = _WordHashes()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the different shingles of a text, sorted; ASCII letters lower, words between ASCII white space.

    A text of fewer words is one shingle, one without words has none.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    n = max(len(h) - words + 1, 1)
    out = np.full(n, min(words, len(h)), np.uint64)
    for k in range(min(words, len(h))):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h[k:k + n])
    return np.unique(out)


def min_hashes(s: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, 2**64 - 1, np.uint64)
    for k in range(0, len(s), 512):
        values = np.multiply.outer(s[k:k + 512], FACTORS)
        values += SHIFTS
        np.minimum(out, values.min(axis=0), out=out)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in samples.reshape(BANDS, ROWS).T:
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + column)
    return out.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    bits = mix(samples + _PLACES) % np.uint64(64 * SKETCH_LONGS)
    parity = (np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_LONGS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def sketched(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """``doc_id, n_shingles, same, digest, bands, sketch``; ``same`` is equal for equal sets, ``digest`` for equal texts."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            for at in range(0, len(texts), 256):
                sizes, same, digests, bands, sketches = [], [], [], [], []
                for t in texts[at:at + 256].to_pylist():
                    s = shingles(t, words)
                    digests.append(hashlib.md5((t or "").encode()).digest())
                    sizes.append(len(s))
                    same.append(hashlib.md5(s.tobytes()).digest())
                    samples = min_hashes(s)
                    bands.append(band_keys(samples) if len(s) else np.empty(0, np.int64))
                    sketches.append(odd_sketch(samples))

                def lists(arrays: list[np.ndarray]) -> pa.Array:
                    ends = np.cumsum([0, *map(len, arrays)])
                    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays)))
                yield pa.RecordBatch.from_arrays(
                    [ids[at:at + 256], pa.array(sizes, pa.int64()), pa.array(same, pa.binary()), pa.array(digests, pa.binary()), lists(bands), lists(sketches)],
                    names=["doc_id", "n_shingles", "same", "digest", "bands", "sketch"])
        _hashes.clear()                                              # workers live on after a task
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(
        run, "doc_id long, n_shingles long, same binary, digest binary, bands array<long>, sketch array<long>")


def linked(a: str, b: str, words: int) -> Column:
    """Whether the full shingle sets of the texts in two columns are similar enough."""
    @F.arrow_udf(BooleanType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last, first = [], None, None
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            if x != last or first is None:
                last, first = x, shingles(x, words)
            other = shingles(y, words)
            both = len(np.intersect1d(first, other, assume_unique=True))
            out.append(100 * both >= SIMILARITY * (len(first) + len(other) - both))
        return pa.array(out, pa.bool_())
    return run(a, b)


def differing_bits(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def confirm(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs ``a, b`` that are linked: by sizes and sketches first, then on the full sets."""
    one = sketches.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.distinct().join(one, "a").join(two, "b")
    near = near.where((100 * F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb"))
                      & (differing_bits(F.col("sa"), F.col("sb")) <= 2 * most_differing())).select("a", "b")
    first = texts.select(F.col("rep").alias("a"), F.col("text").alias("ta"))
    second = texts.select(F.col("rep").alias("b"), F.col("text").alias("tb"))
    both = near.join(first, "a").join(second, "b")
    return materialize(both.where(linked("ta", "tb", words)).select("a", "b"), "confirmed")


def with_component(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with their component so far, of bands with more than one."""
    rows = members.select("band", "rep").join(found, F.col("rep") == F.col("node"), "left").select(
        "band", "rep", F.coalesce("component", "rep").alias("component"))
    busy = rows.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return materialize(rows.join(busy.where("low <> high"), "band").drop("high"), "members")


def meetings(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """``meeting, rep, component, n_shingles, sketch, bands, band``: who is compared with whom within bands.

    A band's members are dealt to chunks: those of its smallest component, and the others. Chunks of others meet each
    other and those of the smallest component, so no meeting has more than about two chunks.
    """
    stats = members.groupBy("band").agg(F.count(F.when(F.col("component") == F.col("low"), 1)).alias("n0"),
                                        F.count(F.when(F.col("component") != F.col("low"), 1)).alias("n1"))
    k0, k1 = (F.ceil(F.col(n) / CHUNK).cast("int") for n in ("n0", "n1"))
    rows = members.join(stats, "band").join(sketches.select("rep", "n_shingles", "sketch", "bands"), "rep")
    lowest = F.col("component") == F.col("low")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.when(lowest, k0).otherwise(k1)).cast("int"))

    def meeting(kind: int, i: Column, j: Column) -> Column:
        return F.xxhash64("band", F.lit(kind), i, j)
    with_rest = F.transform(F.sequence(F.lit(0), k1 - 1), lambda j: meeting(0, F.col("chunk"), j))
    with_low = F.transform(F.sequence(F.lit(0), k0 - 1), lambda i: meeting(0, i, F.col("chunk")))
    among = F.transform(F.sequence(F.lit(0), k1 - 1), lambda j: meeting(1, F.least(j, F.col("chunk")), F.greatest(j, F.col("chunk"))))
    rows = rows.withColumn("meeting", F.explode(F.when(lowest, with_rest).otherwise(
        F.concat(with_low, F.when(F.col("n1") > 1, among).otherwise(F.array())))))
    return rows.select("meeting", "rep", "component", "n_shingles", "sketch", "bands", "band")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold all rows of their keys, from batches sorted by key."""
    rest: pa.Table | None = None
    for batch in batches:
        held = pa.Table.from_batches([batch])
        held = held if rest is None else pa.concat_tables([rest, held])
        group = held.column(key).to_numpy()
        start = int(np.searchsorted(group, group[-1])) if len(group) else 0
        if start:
            yield held.slice(0, start)
        rest = held.slice(start)
    if rest is not None and len(rest):
        yield rest


def _matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    return pa.concat_arrays(column.chunks).flatten().to_numpy().view(kind).reshape(-1, width)


def near_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of one meeting and different components that are near by sizes and sketches, and whose first common
    band is that of the meeting, so that each pair is looked at once."""
    group, component, size, band = (table.column(c).to_numpy() for c in ("meeting", "component", "n_shingles", "band"))
    sketch, bands = _matrix(table.column("sketch"), SKETCH_LONGS, np.uint64), _matrix(table.column("bands"), BANDS, np.int64)
    bits = 2 * most_differing()
    found_a, found_b, at, step = [], [], np.arange(len(group)), 1
    while len(at):
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]         # sorted, so whoever has no partner here has none farther on
        a = at[component[at] != component[at + step]]
        b = a + step
        ok = 100 * np.minimum(size[a], size[b]) >= SIMILARITY * np.maximum(size[a], size[b])
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64) <= bits
        a, b = a[ok], b[ok]
        first = (bands[a] == bands[b]).argmax(axis=1)
        ok = bands[a, first] == band[a]
        found_a.append(a[ok])
        found_b.append(b[ok])
        step += 1
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.empty(0, int), np.empty(0, int))


def links_within_bands(members: DataFrame, sketches: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """Links ``a, b`` that join components among the members of bands, at most one less than a meeting's rows.

    The first pass compares sketches and names the rows that are near another one; only their texts come to the
    second, which compares the same pairs on the full sets. No pair leaves a task but as a link.
    """
    met = materialize(meetings(members, sketches), "meetings")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "meeting"):
            rows = np.unique(np.concatenate(near_rows(table)))
            yield pa.RecordBatch.from_arrays([pa.array(table.column(c).to_numpy()[rows]) for c in ("meeting", "rep")], names=["meeting", "rep"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "meeting"):
            rep, text = table.column("rep").to_pylist(), table.column("text")
            sets, forest, out = {}, {}, []

            def root(x: int) -> int:
                while forest.setdefault(x, x) != x:
                    x = forest[x]
                return x
            component = table.column("component").to_pylist()
            for i, j in zip(*(x.tolist() for x in near_rows(table))):
                p, q = root(component[i]), root(component[j])
                if p == q:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = shingles(text[k].as_py(), words)
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= SIMILARITY * (len(sets[i]) + len(sets[j]) - both):
                    forest[max(p, q)] = min(p, q)
                    out.append((rep[i], rep[j]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
    near = met.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(name, "meeting long, rep long").distinct()
    known = met.join(near, ["meeting", "rep"]).join(texts, "rep")
    return materialize(known.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(verify, "a long, b long"), "confirmed")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per document.

    Documents with enough shingles in common are linked; a component is what links reach, named by its smallest id,
    and that document is kept. Texts that are null, empty or blank have no shingles and are linked with nothing. A
    row without id is linked with nothing and its ``component_id`` and ``kept`` are null. All texts of a repeated id are
    compared, and what one of them is linked with counts for the id. An empty table gives no rows. Other columns are not read.
    """
    own = materialize(sketched(docs, doc_id, text, words), "sketches")
    usable = own.where("n_shingles > 0 AND doc_id IS NOT NULL")
    one = Window.partitionBy("same").orderBy("doc_id", "digest")     # the digest decides only where an id repeats
    sketches = usable.withColumn("_k", F.row_number().over(one)).where("_k = 1")
    # a class is named by a number of its own, as the same id can stand for several sets
    sketches = materialize(sketches.select(F.monotonically_increasing_id().alias("rep"), "same", "doc_id", "digest", "n_shingles", "bands", "sketch"), "classes")
    banded = sketches.select("rep", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first <> last")
    members = materialize(banded.join(shared.select("band", "first"), "band"), "members")
    mates = sketches.join(members.select("rep").distinct(), "rep").select("rep", "doc_id", "digest")
    body = F.col(text)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), body.alias("text"), F.unhex(F.md5(body.cast("binary"))).alias("digest"))
    texts = materialize(texts.join(mates, ["doc_id", "digest"]).select("rep", "text").dropDuplicates(["rep"]), "texts")

    links = confirm(members.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")), sketches, texts, words)
    found = components(links)
    busy = with_component(members, found)
    links = links_within_bands(busy, sketches, texts, words).union(links_of_ids(usable, sketches))
    # what is known as one component goes on as a star
    found = components(stars(found).union(links))

    linked = sketches.select("rep", "same", "doc_id").join(found, F.col("rep") == F.col("node"), "left").select(
        "same", "doc_id", F.coalesce("component", "rep").alias("component"))
    names = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = linked.join(names, "component").select("same", F.col("component_id").alias("component"))
    rows = own.join(named, "same", "left")
    linked_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", linked_id.alias("component_id"), (F.col("doc_id") == linked_id).alias("kept"))


def stars(found: DataFrame) -> DataFrame:
    """Links ``a, b`` that give the same components again."""
    return found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def links_of_ids(usable: DataFrame, sketches: DataFrame) -> DataFrame:
    """Links ``a, b`` between the classes of ids that have several."""
    several = usable.groupBy("doc_id").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high")
    owned = usable.join(several, "doc_id").select("doc_id", "same", "low").distinct()
    reps = sketches.select("same", "rep")
    first = reps.select(F.col("same").alias("low"), F.col("rep").alias("a"))
    return owned.where("same <> low").join(reps, "same").join(first, "low").select("a", F.col("rep").alias("b"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """The documents that are kept, with all their columns; rows without id stay."""
    gone = near_duplicates(docs, doc_id, text, words).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = docs.select(F.struct("*").alias("_row")).join(gone, F.col(f"_row.{doc_id}").cast("long") == F.col("_gone"), "left_anti")
    return rows.select(*(F.col(f"_row.{c}") for c in docs.columns))
