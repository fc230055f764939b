"""Removing repeated and nearly repeated lines by a join of deletion neighbourhoods; DataFrame functions only.

Two lines that differ by one inserted, deleted or replaced character share a variant with a deleted character. Emitting
all variants of all lines would multiply the input by the line length, so lines are first cut into segments (halves,
or ``SEGMENT`` characters of longer lines). An edit lies in one segment and leaves the text before and after it alone;
only segments whose surroundings another line shares emit their deletion variants, as hashed keys. Equal variants meet,
every line is compared with the earliest one that it meets, the edit distance is verified on the texts, and the
earliest line stays.

Only different lines meet, and those with one variant differ by one character, so the groups don't grow with the
number of copies. Copies are counted before anything is shuffled.

What few rows of many are wanted is found with a sieve before a join: a bitmap of their hashed keys, of a fixed size, that
is broadcast. It lets a few others pass, which the join then drops, so only rows that are likely wanted are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from redpencil.session import materialize

#: Default: lines of fewer characters must be equal to count as repeated; from here on one edit is allowed.
MIN_CHARS = 20
#: Characters of a segment of lines over twice as long; shorter lines have two segments.
SEGMENT = 256
SIEVE_BITS, SLICE_BITS = 1 << 26, 1 << 15
PLACES = 10_000_000_000          # more than lines of a document: position = document * PLACES + line
BLANKS = " \t\r"


def split_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, line_no, body, n``: every line, without blanks at its ends, and its characters.

    Lines are trimmed and measured below the explode; above it, the optimizer would do so at each use.
    """
    trimmed = F.transform(F.split(F.col(text), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    measured = F.transform(trimmed, lambda x: F.struct(x.alias("body"), F.length(x).alias("n")))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.posexplode(measured).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", "line.body", "line.n")


def keyed(lines: DataFrame) -> DataFrame:
    """Lines that can be repeated, with 128 bits of their text and their place in the order of all lines."""
    place = (F.col("doc_id").cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(11,0)") + F.col("line_no")).cast("decimal(31,0)")
    return lines.where("doc_id IS NOT NULL AND body <> ''").select(
        F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(1), "body").alias("h2"), place.alias("place"), "body", "n")


def sieve(rows: DataFrame, key: str) -> DataFrame:
    """``slice, words``: a bitmap of the hashes in a column, ``SIEVE_BITS`` in all, whatever the table's size."""
    bit = F.pmod(key, F.lit(SIEVE_BITS)) + 1
    parts = rows.groupBy(F.bitmap_bucket_number(bit).alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bitmap"))
    word = lambda k: F.conv(F.hex(F.substring("bitmap", 8 * k + 1, F.lit(8))), 16, -10).cast("long")
    return parts.select("slice", F.transform(F.sequence(F.lit(0), F.lit(SLICE_BITS // 64 - 1)), word).alias("words"))


def sieved(rows: DataFrame, key: str, sieve: DataFrame) -> DataFrame:
    """The rows whose key may be in the sieve."""
    bit = F.pmod(key, F.lit(SIEVE_BITS))
    at = bit % SLICE_BITS
    # the lowest bit of a byte comes first, and so does the highest byte of a word
    inside = F.getbit(F.get("words", (at / 64).cast("int")), (7 - F.floor(at / 8) % 8) * 8 + at % 8)
    return rows.join(F.broadcast(sieve), (F.floor(bit / SLICE_BITS) + 1 == F.col("slice")) & (inside == 1), "left_semi")


def with_segments(lines: DataFrame, min_chars: int) -> DataFrame:
    """A row for each segment of each line, with ``role, start, width, context``.

    Role 0 takes the line as the shorter or equal one of a pair, role 1 as the one with an inserted character: its
    segments are one character longer than those of the line without it, and what lies around them is the same.
    ``context`` is a hash of that and of the shorter line's length. Places come from explodes, so that the text is cut
    and hashed in compiled projections.
    """
    def width(base: Column) -> Column:
        return F.when(base > 2 * SEGMENT, SEGMENT).otherwise(F.ceil(base / 2)).cast("int")

    def count(base: Column) -> Column:
        return F.when(base >= min_chars, F.ceil(base / width(base))).otherwise(0).cast("int")
    n = F.col("n")
    rows = lines.withColumn("_k", F.explode(F.sequence(F.lit(0), count(n) + count(n - 1) - 1)))
    rows = rows.withColumn("role", F.when(F.col("_k") < count(n), 0).otherwise(1))
    base = n - F.col("role")
    rows = rows.withColumn("start", ((F.col("_k") - F.when(F.col("role") == 1, count(n)).otherwise(0)) * width(base)).cast("int"))
    rows = rows.withColumn("width", (F.least(width(base), base - F.col("start")) + F.col("role")).cast("int"))
    before = F.substring(F.col("body"), F.lit(1), F.col("start"))
    after = F.substring(F.col("body"), F.col("start") + F.col("width") + 1, n)
    return rows.withColumn("context", F.xxhash64(base, F.col("start"), before, after)).drop("_k")


def with_variants(rows: DataFrame) -> DataFrame:
    """A row for each variant of ``part``, with ``key`` and the side on which it meets others.

    Side 0: a character of this segment replaced, so equal positions meet. Side 1: the segment as it is, which meets
    side 2: a longer segment with a character deleted.
    """
    n, at, long = F.length("part"), F.col("at"), F.col("role") == 1
    rows = rows.withColumn("at", F.explode(F.sequence(F.when(long, 1).otherwise(0), n)))
    rest = F.when(at == 0, F.col("part")).otherwise(
        F.concat(F.substring(F.col("part"), F.lit(1), at - 1), F.substring(F.col("part"), at + 1, n)))
    rows = rows.withColumn("side", F.when(long, 2).when(at == 0, 1).otherwise(0))
    return rows.withColumn("key", F.xxhash64(F.when(F.col("side") == 0, at).otherwise(-1), rest))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, line_no, kept, of_doc_id, of_line_no, edits``: one row per line of every text.

    A line is dropped when an earlier one (by document id, then line) equals it, or, from ``min_chars`` characters of
    both on (at least 2), is one edit away; ``of_*`` name the earliest such line, ``edits`` its distance. Blanks at the ends of a
    line don't count. Blank lines and lines of documents without id are kept and repeat nothing. A null text has no
    lines, an empty one a blank line. Rows with the same document id count as one document: their equal lines are
    decided alike. Other columns are not read.
    """
    lines = split_lines(docs, doc_id, text)
    own = keyed(lines)
    first = own.groupBy("h1", "h2").agg(F.min("place").alias("first"))
    near = earlier_neighbours(own, first, min_chars)
    verdict = first.join(near, ["h1", "h2"], "left").select("h1", "h2", "first", "near")
    mine = lines.withColumn("h1", F.when(F.col("doc_id").isNotNull() & (F.col("body") != ""), F.xxhash64("body")))
    place = (F.col("doc_id").cast("decimal(20,0)") * F.lit(PLACES).cast("decimal(11,0)") + F.col("line_no")).cast("decimal(31,0)")
    mine = mine.select("doc_id", "line_no", "h1", F.xxhash64(F.lit(1), "body").alias("h2"), place.alias("place"))
    found = mine.join(verdict, ["h1", "h2"], "left")
    of = F.when(F.col("near") < F.col("first"), F.col("near")).when(
        F.col("first") < F.col("place"), F.col("first")).otherwise(F.col("near"))
    found = found.withColumn("of", F.when(of < F.col("place"), of))
    at = F.floor(F.col("of") / F.lit(PLACES)).cast("long")
    return found.select(
        "doc_id", "line_no", F.col("of").isNull().alias("kept"), at.alias("of_doc_id"),
        F.pmod(F.col("of"), F.lit(PLACES).cast("decimal(31,0)")).cast("int").alias("of_line_no"),
        F.when(F.col("of").isNotNull(), F.when(F.col("of") == F.col("first"), 0).otherwise(1)).alias("edits"))


def earlier_neighbours(own: DataFrame, first: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1, h2, near``: for different lines, the earliest first place of a line that is one edit away, if earlier."""
    long_enough = own.where(F.col("n") >= min_chars)
    contexts = with_segments(long_enough, min_chars).select("context", "h1", "h2", "role", "start")
    # surroundings that at least two different lines share
    shared = contexts.groupBy("context").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high")
    shared = materialize(shared.select("context"), "shared-contexts")
    busy = sieved(contexts, "context", sieve(shared, "context")).join(shared, "context", "left_semi").groupBy("h1", "h2").agg(
        F.collect_set(F.struct("role", "start")).alias("busy"))
    wanted = materialize(busy.join(first, ["h1", "h2"]).withColumnRenamed("first", "place"), "wanted-lines")
    texts = sieved(long_enough, "h1", sieve(wanted, "h1")).join(wanted, ["h1", "h2", "place"])
    texts = materialize(texts.dropDuplicates(["h1", "h2"]), "busy-lines")
    active = with_segments(texts, min_chars).where(
        F.exists("busy", lambda b: (b["role"] == F.col("role")) & (b["start"] == F.col("start"))))
    active = active.select("place", "context", "role", F.substring(F.col("body"), F.col("start") + 1, F.col("width")).alias("part"))
    # the pieces are few but grow to a row for each character, so they are dealt out first
    active = active.repartition("context", "place")
    keys = with_variants(active).select("context", "key", "side", "place")
    # at most a line for each character that can stand at a place, however often the lines occur
    equal = Window.partitionBy("context", "key")
    keys = keys.withColumn("short", F.min(F.when(F.col("side") < 2, F.col("place"))).over(equal)).withColumn(
        "long", F.min(F.when(F.col("side") == 2, F.col("place"))).over(equal))
    pairs = keys.select("place", F.when(F.col("side") == 1, F.col("long")).otherwise(F.col("short")).alias("near"))
    pairs = pairs.where("near < place").distinct()
    here, there = texts.select("place", "h1", "h2", "body"), texts.select(F.col("place").alias("near"), F.col("body").alias("other"))
    verified = pairs.join(there, "near").join(here, "place").where(F.levenshtein("body", "other", 1).between(0, 1))
    return verified.groupBy("h1", "h2").agg(F.min("near").alias("near"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without their repeated lines; a document with no other line than repeated and blank ones goes.

    Columns and other rows stay as they are.
    """
    lines = repeated_lines(docs, doc_id, text, min_chars)
    gone = lines.where("NOT kept").groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_set("line_no")).alias("_gone"))
    rows = docs.select(F.struct("*").alias("_row")).join(gone, F.col(f"_row.{doc_id}").cast("long") == F.col("_doc"), "left")
    body = F.col(f"_row.{text}")
    every = F.split(body, "\n")
    ends = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size(every)))
    runs = F.transform(F.sequence(F.lit(0), F.size("_gone")), lambda k: F.slice(
        every, F.get(ends, k) + 2, F.get(ends, k + 1) - F.get(ends, k) - 1))
    rows = rows.withColumn("_left", F.when(F.col("_gone").isNotNull(), F.flatten(runs)))
    rows = rows.where(F.col("_left").isNull() | F.exists("_left", lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    kept = F.when(F.col("_left").isNotNull(), F.array_join("_left", "\n")).otherwise(body)
    return rows.select(*(kept.alias(c) if c == text else F.col(f"_row.{c}") for c in docs.columns))
