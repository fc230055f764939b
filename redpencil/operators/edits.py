"""Edit tables from sentence pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from redpencil.functions.text import equal_ignoring_space_and_case
from redpencil.functions.tokenizer import whitespace_tokens
from redpencil.operators.alignment import edit_spans
from redpencil.session import unnest

EDIT = "struct<start:int,end:int,original:string,correction:string>"


def zip_lines(left: DataFrame, right: DataFrame, key: str = "sent_id", strict: bool = True) -> DataFrame:
    """Match two line tables one to one. ``strict`` fails on the first unmatched line as the query
    runs; otherwise unmatched lines are dropped. A position that a table holds twice is an error in both
    cases, found where the join sorts its rows anyway, before any row is matched."""
    order = Window.partitionBy(key).orderBy(key)

    def fail(words: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"{words}: {key}="), F.col(key).cast("string"))).cast("boolean")

    def once(df: DataFrame) -> DataFrame:
        numbered = df.where(F.col(key).isNotNull() | F.lit(strict)).withColumn("_n", F.row_number().over(order))
        return numbered.where(F.when((F.col("_n") > 1) & F.col(key).isNotNull(), fail("repeated line")).otherwise(F.lit(True))).drop("_n")
    if not strict:
        return once(left).join(once(right), key)
    a = once(left).withColumn("_left", F.lit(True))
    b = once(right).withColumn("_right", F.lit(True))
    unmatched = F.col("_left").isNull() | F.col("_right").isNull()
    return a.join(b, key, "full_outer").where(F.when(unmatched, fail("line without partner")).otherwise(F.lit(True))).drop("_left", "_right")


def _edit(span: Column, source: Column, hypothesis: Column) -> Column:
    text = lambda tokens, start, end: F.array_join(F.slice(tokens, start + 1, end - start), " ")
    return F.struct(
        span["start"].alias("start"), span["end"].alias("end"),
        text(source, span["start"], span["end"]).alias("original"),
        text(hypothesis, span["hyp_start"], span["hyp_end"]).alias("correction"))


def with_edits(df: DataFrame, source: str = "source", hypothesis: str = "hypothesis", name: str = "edits",
               max_unchanged_words: int = 0, ignore_whitespace_casing: bool = False,
               lattice: str = "merged") -> DataFrame:
    """Add the edits that turn ``source`` into ``hypothesis`` as an array column.

    The pair never moves between tasks, and only its tokens and the spans cross into Python.
    """
    src, hyp = whitespace_tokens(F.col(source)), whitespace_tokens(F.col(hypothesis))
    # equal pairs have no edits: they go to Python as nulls
    differs = F.col(source) != F.col(hypothesis)
    prepared = df.withColumn("_src", F.when(differs, src)).withColumn("_hyp", F.when(differs, hyp))
    spans = edit_spans(F.col("_src"), F.col("_hyp"), None, max_unchanged_words, lattice)
    aligned = prepared.withColumn("_spans", spans)
    edits = edits_of(F.col("_spans"), F.col("_src"), F.col("_hyp"), ignore_whitespace_casing)
    both = F.col(source).isNotNull() & F.col(hypothesis).isNotNull()
    return aligned.select(*df.columns, F.when(both, edits).alias(name))


def edits_of(spans: Column, source: Column, hypothesis: Column, ignore_whitespace_casing: bool = False) -> Column:
    """The edits of an aligned pair's token arrays that change something; none without an alignment."""
    edits = F.transform(F.element_at(spans, 1), lambda s: _edit(s, source, hypothesis))
    edits = F.filter(edits, lambda e: e["original"] != e["correction"])
    if ignore_whitespace_casing:
        edits = F.filter(edits, lambda e: ~equal_ignoring_space_and_case(e["original"], e["correction"]))
    return F.coalesce(edits, F.array().cast(f"array<{EDIT}>"))


def explode_edits(df: DataFrame, keys: list[str], edits: str = "edits") -> DataFrame:
    """Long edit table: ``keys, edit_pos, start, end, original, correction``."""
    return unnest(df, keys, edits, "e", "edit_pos").select(*keys, "edit_pos", "e.*")


def extract_edits(df: DataFrame, keys: list[str], **options) -> DataFrame:
    """Edits of ``source``/``hypothesis`` rows without gold, one row per edit."""
    return explode_edits(with_edits(df, **options), keys)


def edit_count(df: DataFrame, source: str, hypothesis: str, name: str, **options) -> DataFrame:
    """Number of edits between two sentence columns, 0 for equal ones."""
    counted = with_edits(df, source, hypothesis, "_edits", **options)
    return counted.select(*df.columns, F.size("_edits").cast("long").alias(name))


def align_to_gold(df: DataFrame, max_unchanged_words: int = 2, ignore_whitespace_casing: bool = False,
                  lattice: str = "merged") -> DataFrame:
    """Add ``alignments``: per annotator the edit sequence that agrees best with that gold set.

    ``df`` carries ``source, text, gold``. One matrix per pair serves all annotators of the row.
    Gold edits whose original differs from the source tokens can match nothing and stay behind.
    """
    src, hyp = whitespace_tokens(F.col("source")), whitespace_tokens(F.col("text"))
    # equal pairs have no edits: they are not cut into tokens
    differs = F.col("source") != F.col("text")
    prepared = df.withColumn("_src", F.when(differs, src)).withColumn("_hyp", F.when(differs, hyp))

    def matchable(gold_set):
        fits = lambda g: F.when(g["end"] > g["start"], F.array_join(
            F.slice("_src", g["start"] + 1, F.greatest(g["end"] - g["start"], F.lit(0))), " ")).otherwise("") == g["original"]
        return F.transform(F.filter(gold_set["edits"], fits), lambda g: F.struct(
            g["start"].alias("start"), g["end"].alias("end"), g["corrections"].alias("corrections")))
    spans = edit_spans(F.col("_src"), F.col("_hyp"), F.when(differs, F.transform("gold", matchable)), max_unchanged_words, lattice)
    aligned = prepared.withColumn("_spans", spans)

    def per_annotator(gold_set, k):
        edits = F.transform(F.get(F.col("_spans"), k), lambda s: _edit(s, F.col("_src"), F.col("_hyp")))
        if ignore_whitespace_casing:
            edits = F.filter(edits, lambda e: ~equal_ignoring_space_and_case(e["original"], e["correction"]))
        return F.struct(
            gold_set["annotator"].alias("annotator"),
            F.coalesce(edits, F.array().cast(f"array<{EDIT}>")).alias("edits"), gold_set["edits"].alias("gold"))
    return aligned.select(*df.columns, F.transform("gold", per_annotator).alias("alignments"))


def extract_edits_vs_gold(df: DataFrame, keys: list[str], **options) -> DataFrame:
    """System edits per annotator: ``keys, annotator, edit_pos, start, end, original, correction``."""
    rows = unnest(align_to_gold(df, **options), keys, "alignments", "a")
    return explode_edits(rows.select(*keys, "a.annotator", "a.edits"), keys + ["annotator"])
