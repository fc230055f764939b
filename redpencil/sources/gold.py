"""Gold edit files: blocks of S (sentence) and A (annotation) lines, read and written."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from redpencil.functions.sequences import let
from redpencil.functions.text import WS, strip
from redpencil.functions.tokenizer import whitespace_tokens
from redpencil.session import materialize, unnest
from redpencil.sources.lines import file_position, number_rows

# Field layout of annotation lines.
NOOP, NONE = "noop", "-NONE-"
EDIT_TYPE, REQUIRED = "UNK", "REQUIRED"

EDITS = "array<struct<start:int,end:int,original:string,corrections:array<string>>>"


@dataclass(frozen=True)
class Gold:
    """One row per sentence; the long tables are narrow views of it."""

    rows: DataFrame     # sent_id, source, tokens, annotations, gold array<struct<annotator, edits>>

    @property
    def sentences(self) -> DataFrame:
        return self.rows.select("sent_id", "source", "tokens")

    @property
    def edits(self) -> DataFrame:
        """Every annotation line, noop lines with span (-1, -1) included."""
        return unnest(self.rows, ["sent_id"], "annotations", "a", "edit_pos").select(
            "sent_id", "a.annotator", "edit_pos", "a.start", "a.end", "a.etype", "a.original",
            "a.corrections", "a.required", "a.comment")

    @property
    def sets(self) -> DataFrame:
        """One row per sentence and annotator, also for empty edit sets."""
        return unnest(self.rows, ["sent_id"], "gold", "g").select(
            "sent_id", "g.annotator", "g.edits")


def _annotation(line: Column, tokens: Column) -> Column:
    """An annotation line's fields and offsets, each cut once."""
    fields = F.split(F.substring(line, F.lit(3), F.length(line)), r"\|\|\|")
    offset = lambda numbers, k: F.element_at(numbers, k + 1).cast("int")

    def with_fields(fields: Column) -> Column:
        noop, numbers = F.element_at(fields, 2) == NOOP, F.split(strip(F.element_at(fields, 1)), f"{WS}+")
        span = F.when(noop, F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"))).otherwise(let(
            numbers, lambda n: F.struct(offset(n, 0).alias("start"), offset(n, 1).alias("end"))))
        return let(span, lambda span: _annotation_of(fields, span["start"], span["end"], tokens))
    return let(fields, with_fields)


def _annotation_of(fields: Column, start: Column, end: Column, tokens: Column) -> Column:
    field = lambda k: F.element_at(fields, k + 1)
    inside = (start >= 0) & (start <= F.size(tokens)) & (end > start)
    original = F.when(inside, F.array_join(F.slice(tokens, F.greatest(start, F.lit(0)) + 1,
                                                   F.greatest(end - start, F.lit(0))), " ")).otherwise("")
    corrections = F.transform(F.split(field(2), r"\|\|"), lambda c: F.when(c == NONE, "").otherwise(strip(c)))
    return F.struct(
        field(5).cast("int").alias("annotator"), start.alias("start"), end.alias("end"),
        field(1).alias("etype"), original.alias("original"), corrections.alias("corrections"),
        field(3).alias("required"), field(4).alias("comment"))


def gold_sets(annotations: Column, token_limit: Column) -> Column:
    """Edit sets by annotator. An annotator with noop lines only keeps an empty set; a sentence
    without annotations has annotator 0 with an empty set."""
    annotators = F.array_sort(F.array_distinct(F.transform(annotations, lambda a: a["annotator"])))
    annotators = F.when(F.size(annotators) == 0, F.array(F.lit(0))).otherwise(annotators)

    def edits_of(annotator):
        valid = F.filter(annotations, lambda a: (
            (a["annotator"] == annotator) & a["start"].between(0, token_limit) & a["end"].between(0, token_limit)))
        return F.struct(annotator.alias("annotator"), F.transform(valid, lambda a: F.struct(
            a["start"].alias("start"), a["end"].alias("end"), a["original"].alias("original"),
            a["corrections"].alias("corrections"))).alias("edits"))
    return F.transform(annotators, edits_of)


def read_gold(spark: SparkSession, path: str) -> Gold:
    """Read gold blocks. A block without an S line, or with lines of another kind, is an error.

    When a block has several S lines, each of them gets the block's edits whose offsets do not
    exceed the running token count.
    """
    blocks = spark.read.text(path, lineSep="\n\n").select(
        F.regexp_replace("value", r"\A\n+|\n+\z", "").alias("block"), *file_position()).where("block <> ''")
    blocks = blocks.withColumn("lines", F.split("block", "\n"))
    s_lines = F.filter("lines", lambda x: x.startswith("S "))
    others = F.filter(F.slice("lines", 2, F.size("lines")), lambda x: ~x.startswith("I ") & ~x.startswith("S "))
    bad = (F.size(s_lines) == 0) | F.exists(others, lambda x: ~x.startswith("A "))
    blocks = blocks.withColumn("texts", F.transform(s_lines, lambda x: strip(F.substring(x, F.lit(3), F.length(x)))))
    blocks = blocks.withColumn("block_tokens", whitespace_tokens(F.array_join("texts", " ")))
    blocks = blocks.select(
        "_file", "_block",
        F.when(bad, F.raise_error(F.concat(F.lit("not a gold block: "), "block"))).otherwise(F.col("texts")).alias("texts"),
        # the block's tokens are cut once, not for each of its lines
        let(F.col("block_tokens"), lambda tokens: F.transform(F.filter(others, lambda x: x.startswith("A ")),
                                                              lambda x: _annotation(x, tokens))).alias("annotations"))
    rows = unnest(blocks, ["_file", "_block", "texts", "annotations"], "texts", "source", "pos")
    rows = rows.withColumn("limit", F.size(whitespace_tokens(
        F.array_join(F.slice("texts", F.lit(1), F.col("pos") + 1), " "))))
    rows = rows.select(
        "_file", "_block", "source", whitespace_tokens(F.col("source")).alias("tokens"), "annotations",
        let(F.col("limit"), lambda limit: gold_sets(F.col("annotations"), limit)).alias("gold"))
    return Gold(number_rows(rows, "sent_id"))


def gold_from_edits(sentences: DataFrame, edits: DataFrame) -> Gold:
    """Gold rows from ``sentences(sent_id, source)`` and ``edits(sent_id, annotator, edit_pos, start,
    end, etype, corrections)``. A sentence's annotations are bounded, so they are collected per sentence."""
    fields = ["edit_pos", "annotator", "start", "end", "etype", "corrections"]
    grouped = edits.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("listed"))
    joined = sentences.join(grouped, "sent_id", "left").withColumn(
        "tokens", whitespace_tokens(F.col("source")))
    empty = F.array().cast("array<struct<annotator:int,start:int,end:int,etype:string,original:string,"
                           "corrections:array<string>,required:string,comment:string>>")
    annotation = lambda e: F.struct(
        e["annotator"].cast("int").alias("annotator"), e["start"].cast("int").alias("start"),
        e["end"].cast("int").alias("end"), e["etype"].alias("etype"),
        F.when(e["end"] > e["start"], F.array_join(F.slice(
            "tokens", F.greatest(e["start"], F.lit(0)) + 1, F.greatest(e["end"] - e["start"], F.lit(0))), " "))
         .otherwise("").alias("original"),
        e["corrections"].alias("corrections"), F.lit(REQUIRED).alias("required"), F.lit(NONE).alias("comment"))
    rows = joined.withColumn("annotations", F.coalesce(F.transform("listed", annotation), empty))
    return Gold(rows.select("sent_id", "source", "tokens", "annotations", gold_sets(
        F.col("annotations"), F.size("tokens")).alias("gold")))


def annotation_line(start: Column, end: Column, etype: Column, correction: Column, annotator: Column) -> Column:
    return F.concat(F.lit("A "), start.cast("string"), F.lit(" "), end.cast("string"), F.lit("|||"), etype,
                    F.lit("|||"), correction, F.lit(f"|||{REQUIRED}|||{NONE}|||"), annotator.cast("string"))


def _write_blocks(df: DataFrame, lines: Column, path: str, single_file: bool) -> None:
    block = df.select("sent_id", F.array_join(lines, "\n").alias("value"))
    # sorting reads its input twice, for the bounds of the ranges and for the rows: blocks are made once
    block = (block.repartition(1).sortWithinPartitions("sent_id") if single_file
             else materialize(block, "blocks").orderBy("sent_id"))
    block.select("value").write.text(path, lineSep="\n\n")


def write_edits(df: DataFrame, path: str, with_target: bool = False, single_file: bool = False) -> None:
    """Write ``sent_id, source, hypothesis, edits`` rows; edits that change nothing are left out."""
    changed = F.filter("edits", lambda e: e["original"] != e["correction"])
    head = [F.concat(F.lit("S "), "source")] + [F.concat(F.lit("T "), "hypothesis")] * with_target
    lines = F.concat(F.array(*head), F.transform(changed, lambda e: annotation_line(
        e["start"], e["end"], F.lit(EDIT_TYPE), e["correction"], F.lit(0))))
    _write_blocks(df, lines, path, single_file)


def write_gold(gold: Gold, path: str, single_file: bool = False) -> None:
    """Write gold rows back; several alternatives are joined by ``||``."""
    lines = F.concat(F.array(F.concat(F.lit("S "), "source")), F.transform("annotations", lambda a: annotation_line(
        a["start"], a["end"], a["etype"],
        F.array_join(F.transform(a["corrections"], lambda c: F.when(c == "", NONE).otherwise(c)), "||"),
        a["annotator"])))
    _write_blocks(gold.rows, lines, path, single_file)
