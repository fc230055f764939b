"""Collocations: phrases of two to four words that occur far more often together than apart, per language.

Every word occurrence gives one window of the longest length: the word and those that follow it in its piece, as lead
columns, padded where the piece ends. Only these windows are counted. Spark's ROLLUP over the lead columns then sums
them to every shorter prefix, so phrases of all lengths come from one pass over the text.

Sieves shorten windows before they are counted. No phrase of ``least`` occurrences holds a rarer word, pair or triple of
neighbours, so a window ends before the first of these. A sieve is a bitmap of hashed words, pairs or triples, built
from counts over all rows; a collision only lets a window stay longer than it must, and a bitmap that fills up sieves
less. So counts are exact at every size, and what the tasks hold is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from redpencil.session import materialize

LONGEST = 4                      # words of a window
LEAST = 30                       # occurrences of a candidate
COVERED = 80                     # percent of a candidate's occurrences inside one longer candidate: it is left out
SCALE = 2_000_000
SIEVE_BITS = 1 << 26             # 8 MB
BLOCK_BYTES = 8 << 20            # text that a task works on at once, or one longer text
BLOCK_ROWS = 1 << 21             # counts that a task holds before it hands them on
UNKNOWN = "und"
#: fixed values: capital letters become small, blanks are one kind, and all that ends a piece is a line feed
_FROM, _TO = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9
_BYTES = bytes.maketrans(_FROM, _TO)
END = 0                          # code of the end of a piece


def tokens(texts: list[bytes]) -> pa.DictionaryArray:
    """The words of all texts in order, with ``\\n`` between pieces and texts."""
    data = np.frombuffer(b"\n".join(texts).translate(_BYTES), np.uint8)
    blank, end = data == ord(" "), data == ord("\n")
    first = np.ones(len(data), bool)
    first[1:] = blank[:-1] | end[:-1] | end[1:]
    starts = np.flatnonzero(first[~blank])
    data = data[~blank]
    offsets = np.append(starts, len(data))
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()


class Words:
    """Texts of one language at a time as arrays of word codes; codes hold for the life of the object."""

    def __init__(self):
        self.codes: dict[bytes, int] = {b"\n": END}

    def read(self, texts: list[bytes]) -> np.ndarray:
        """The codes of all texts, with ``END`` between pieces and texts."""
        found, codes = tokens(texts), self.codes
        known = np.fromiter((codes.setdefault(w, len(codes)) for w in found.dictionary.to_pylist()), np.int32, len(found.dictionary))
        return known[found.indices.to_numpy()]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """Language and texts, as many as ``BLOCK_BYTES`` allow."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        texts = batch.column(1).cast(pa.binary()) if pa.types.is_string(batch.column(1).type) else batch.column(1).cast(pa.large_binary())
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            rows = np.flatnonzero(np.asarray(langs.indices) == code)
            held, size = [], 0
            for k in rows.tolist():
                t = texts[k].as_py()
                held.append(t)
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield lang, held
                    held, size = [], 0
            if held:
                yield lang, held


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, word, n`` of a task's texts; a word can come more than once."""
    counts: dict[str, dict[bytes, int]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            words.pop(b"\n", None)
            rows = list(words.items())
            for at in range(0, len(rows), 1 << 17):
                part = rows[at:at + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(part)), pa.array([w for w, _ in part], pa.binary()).cast(pa.string()),
                                                  pa.array([n for _, n in part], pa.int64())], names=["lang", "word", "n"])
        counts.clear()
    for lang, texts in blocks(batches):
        found, words = tokens(texts), counts.setdefault(lang, {})
        for w, n in zip(found.dictionary.to_pylist(), np.bincount(found.indices.to_numpy()).tolist()):
            words[w] = words.get(w, 0) + n
        if sum(map(len, counts.values())) > BLOCK_ROWS:
            yield from out()
    yield from out()


def bit_of(lang: str, word: bytes) -> int:
    """A word's hash: 64 bits, the same in every task."""
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang.encode()))


def bits(hashes: np.ndarray) -> np.ndarray:
    """Places in a sieve, from 1."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(20)) % np.uint64(SIEVE_BITS)).astype(np.int64) + 1


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of sequences, from those of all but the last word and that of the last one."""
    return (left ^ (left >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + right


class Coded:
    """A block's words with their hashes, and what a sieve lets pass."""

    def __init__(self, words_sieve: np.ndarray):
        self.sieve, self.by_lang = words_sieve, {}

    def read(self, lang: str, texts: list[bytes]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """Codes without gaps, each word's hash, and whether a code is a word that may be frequent."""
        known = self.by_lang.get(lang)
        if known is None or len(known[0].codes) > BLOCK_ROWS // 4:
            known = (Words(), np.zeros(0, np.uint64), np.zeros(0, bool))
        words, hashes, passes = known
        codes = words.read(texts)
        new = list(words.codes)[len(hashes):]
        fresh = np.fromiter((bit_of(lang, w) for w in new), np.uint64, len(new))
        ok = has(self.sieve, bits(fresh))
        if not len(hashes):
            ok[END] = False
        hashes, passes = np.concatenate([hashes, fresh]), np.concatenate([passes, ok])
        self.by_lang[lang] = words, hashes, passes
        return words, codes, hashes, passes


def has(sieve: np.ndarray, places: np.ndarray) -> np.ndarray:
    k = places - 1
    return (sieve[k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool)


def passing(codes: np.ndarray, hashes: np.ndarray, ok: np.ndarray, sieves: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For sequences of 1, 2, ... words the places that pass all sieves so far, and the hashes of what is there."""
    k = np.flatnonzero(ok)
    h = hashes[codes[k]]
    yield k, h
    for n, sieve in enumerate(sieves, 2):
        k, h = longer(codes, hashes, k, h, n)
        good = has(sieve.value, bits(h))
        k, h = k[good], h[good]
        yield k, h


def longer(codes: np.ndarray, hashes: np.ndarray, k: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of sequences of ``n`` words whose first and last ``n - 1`` words both pass, and their hashes."""
    both = np.flatnonzero(k[1:] == k[:-1] + 1)
    return k[both], joined(h[both], hashes[codes[k[both] + n - 1]])


def sequence_counter(words_sieve, sieves: list) -> Callable:
    """Counts of hashed sequences, one word longer than the last sieve's, that may be frequent: ``bit, n``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, held, size = Coded(words_sieve.value), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            places, n = np.unique(np.concatenate(held), return_counts=True)
            for at in range(0, len(places), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(places[at:at + (1 << 18)], pa.int64()), pa.array(n[at:at + (1 << 18)])], names=["bit", "n"])
        for lang, texts in blocks(batches):
            _, codes, hashes, passes = coded.read(lang, texts)
            *_, (k, h) = passing(codes, hashes, passes[codes], sieves)
            _, h = longer(codes, hashes, k, h, len(sieves) + 2)
            held.append(bits(h).astype(np.int32))
            size += len(h)
            if size > 2 * BLOCK_ROWS:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()
    return run


def distinct(columns: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal windows that are neighbours in this order as one, with the sum of their counts."""
    columns = columns[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (columns[:, 1:] != columns[:, :-1]).any(axis=0)
    first = np.flatnonzero(new)
    return columns[:, first], np.add.reduceat(n[order], first)


def mixed(columns: np.ndarray) -> np.ndarray:
    """A hash of each window: one column to sort by."""
    out = columns[0].astype(np.uint64)
    for column in columns[1:]:
        out = joined(out, column.astype(np.uint64))
    return out


def window_counter(words_sieve, sieves: list, longest: int) -> Callable:
    """``lang, w1 .. , n``: a task's counts of padded windows; null is padding."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded, held, size = Coded(words_sieve.value), {}, 0             # held: by language its words and counted windows

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            words, counted = held.pop(lang)
            table, n = (np.concatenate(x, axis=-1) for x in zip(*counted))
            table, n = distinct(table, n, np.lexsort(table[::-1]))
            names = np.array(list(words.codes), object)
            for at in range(0, len(n), 1 << 17):
                part = table[:, at:at + (1 << 17)]
                used, place = np.unique(part, return_inverse=True)
                # END stands for padding
                texts_ = pa.array([None if c == END else w for c, w in zip(used, names[used])], pa.binary()).cast(pa.string())
                place = place.reshape(part.shape)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), part.shape[1]), *(texts_.take(pa.array(p)) for p in place), pa.array(n[at:at + (1 << 17)])],
                    names=["lang", *(f"w{i + 1}" for i in range(longest)), "n"])
        for lang, texts in blocks(batches):
            words, codes, hashes, passes = coded.read(lang, texts)
            found = [k for k, _ in passing(codes, hashes, passes[codes], sieves)]
            starts = found[0]
            if not len(starts):
                continue
            table = np.empty((longest, len(starts)), np.int32)
            table[0] = codes[starts]
            for lead in range(1, longest):
                # the word stays while all sequences of the sieves' lengths up to it pass
                n = min(lead, len(sieves)) + 1
                whole = np.zeros(len(codes), bool)
                whole[found[n - 1]] = True
                alive = whole[starts] if lead < len(found) else alive & whole[np.minimum(starts + lead + 1 - n, len(codes) - 1)]
                table[lead] = np.where(alive, codes[np.minimum(starts + lead, len(codes) - 1)], END)
            if lang in held and held[lang][0] is not words:             # its codes hold no longer
                size -= sum(len(n) for _, n in held[lang][1])
                yield from out(lang)
            del found
            counted = distinct(table, np.ones(len(starts), np.int64), np.argsort(mixed(table)))
            held.setdefault(lang, (words, []))[1].append(counted)
            size += len(counted[1])
            if size > BLOCK_ROWS // 2:
                for known in list(held):
                    yield from out(known)
                size = 0
        for lang in list(held):
            yield from out(lang)
    return run


def sieve_of(places: DataFrame, column: str) -> np.ndarray:
    """The bitmap of the places in a column: ``SIEVE_BITS`` bits, whatever the table's size."""
    parts = places.groupBy(F.bitmap_bucket_number(column).alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(column)).alias("bitmap")).toArrow()
    out = np.zeros(SIEVE_BITS // 8, np.uint8)
    for part, bitmap in zip(parts.column(0).to_pylist(), parts.column(1).to_pylist()):
        out[(part - 1) * len(bitmap):part * len(bitmap)] = np.frombuffer(bitmap, np.uint8)
    return out


def phrase_counts(texts: DataFrame, words: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang, words array, f`` of all phrases of up to ``longest`` words with at least ``least`` occurrences.

    ``texts`` holds lang and text without nulls, ``words`` the counts of its words.
    """
    sc = texts.sparkSession.sparkContext

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = np.fromiter((bit_of(x, w.encode()) for x, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([pa.array(bits(hashes))], names=["bit"])
    frequent = words.where(F.col("n") >= least).select("lang", "word").mapInArrow(place, "bit long")
    words_sieve = sc.broadcast(sieve_of(frequent, "bit"))           # bounded: SIEVE_BITS
    sieves: list = []
    for _ in range(2, longest):
        counted = texts.mapInArrow(sequence_counter(words_sieve, sieves), "bit long, n long").groupBy("bit").agg(F.sum("n").alias("n"))
        sieves = [*sieves, sc.broadcast(sieve_of(counted.where(F.col("n") >= least), "bit"))]
    lead = [f"w{i + 1}" for i in range(longest)]
    schema = ", ".join(["lang string", *(f"{c} string" for c in lead), "n long"])
    windows = texts.mapInArrow(window_counter(words_sieve, sieves, longest), schema)
    windows = materialize(windows.groupBy("lang", *lead).agg(F.sum("n").alias("n")), "windows")       # read twice
    # whole windows are counted already; the rollup sums them to shorter prefixes
    whole = windows.where((F.col("n") >= least) & F.col(lead[-1]).isNotNull()).select("lang", F.array(*lead).alias("words"), F.col("n").alias("f"))
    shorter = lead[:-1]
    sums = windows.rollup("lang", *shorter).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    # a prefix of k words: the last columns are rolled up, and its own last one is no padding
    phrase = F.filter(F.array(*shorter), lambda w: w.isNotNull())
    size = F.lit(len(shorter)) - F.bit_count("level")
    sums = sums.where((F.col("f") >= least) & (size >= 1) & (F.size(phrase) == size))
    return sums.select("lang", phrase.alias("words"), "f").union(whole)


def part(start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice("words", start, length), " ")


def cut_score(a: str, left: str, right: str) -> Column:
    """``floor(SCALE a / (left + right))``; in decimals, as the product may pass 64 bits."""
    return F.expr(f"CAST(CAST({a} AS DECIMAL(20,0)) * {SCALE} DIV (CAST({left} AS DECIMAL(20,0)) + CAST({right} AS DECIMAL(20,0))) AS LONG)")


def collocations(docs: DataFrame, top: int = 2000, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST,
                 covered: int = COVERED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best ``top`` phrases of each language, ranks from 1.

    A-Z become small letters, texts are cut into pieces at ``.,;:!?`` and line ends and those into words at blanks and
    tabs; a null text is empty, a null language ``und``. A candidate has ``a >= least`` occurrences, overlaps included.
    Of its cuts into a first part (``l`` occurrences) and the rest (``r``) the one with the lowest score
    ``floor(2000000 a / (l + r))`` counts, at equal scores the one after the fewest words. A candidate inside a longer
    one with ``covered`` percent of its occurrences is left out. ``n`` are all word occurrences of the language.
    Order: score and a descending, phrase ascending by its UTF-8 bytes. A language without candidates has no rows.
    Repeated rows count as often as they occur; other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").alias("text")).where("text <> ''")
    words = texts.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = phrase_counts(texts, words, least, longest).withColumn("phrase", F.array_join("words", " "))
    counts = materialize(counts, "phrases")
    known = counts.select("lang", F.col("phrase").alias("part"), "f")
    found = counts.where(F.size("words") >= 2).select("lang", "words", "phrase", F.col("f").alias("a"), F.size("words").alias("size"))
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "cut", part(1, F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"))
    cuts = cuts.join(known.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(known.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("score", cut_score("a", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inner = found.where("size > 2").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    inner = inner.groupBy("lang", part(F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * covered))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
