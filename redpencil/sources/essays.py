"""Learner essays in SGML/XML: documents, paragraphs, mistakes and learner profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from redpencil.functions.text import WS
from redpencil.session import unnest

# Tags and attributes of an essay document.
PROFILE_TAGS = ("MATRIC", "EMAIL", "NATIONALITY", "FIRST_LANGUAGE", "SCHOOL_LANGUAGE", "ENGLISH_TESTS")
MISTAKE_ATTRIBUTES = ("start_par", "start_off", "end_par", "end_off")

STRAY_AMPERSAND = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)"
ATTRIBUTE = r"([\w:.-]+)\s*=\s*\"([^\"]*)\""

ESSAY_SCHEMA = (
    "_nid long, " + ", ".join(f"{tag} string" for tag in PROFILE_TAGS) + ", TEXT struct<TITLE:string,P:array<string>>, "
    "ANNOTATION array<struct<_teacher_id:int,MISTAKE:array<struct<"
    + ",".join(f"_{a}:int" for a in MISTAKE_ATTRIBUTES) + ",TYPE:string,CORRECTION:string,COMMENT:string>>>>")


def _inner_text(text: Column) -> Column:
    """Blank text is ''; otherwise cut one leading and one trailing line break."""
    return F.when(text.rlike(rf"\A{WS}*\z"), "").otherwise(F.regexp_replace(text, r"\A\n|\n\z", ""))


def read_essays(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, attrs, paragraphs, mistakes``, the learner profile and ``error``. Paragraph 0 is the title.

    ``attrs`` holds all attributes of the document. An ampersand that begins no entity is text. A
    document that can't be read keeps its markup in ``error``, which is null otherwise.
    """
    # cut at the closing tag, so that big files split and several documents need no common root
    ends = spark.read.text(path, lineSep="</DOC>").where(F.col("value").rlike(r"<DOC[\s>]"))
    document = F.concat(F.regexp_extract("value", r"(?s)(<DOC[\s>].*)", 1), F.lit("</DOC>"))
    document = F.regexp_replace(document, STRAY_AMPERSAND, "&amp;")
    tag = F.regexp_extract(document, r"\A<DOC([^>]*)>", 1)
    attributes = (F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(k)) for k in (1, 2))
    raw = ends.select(F.map_from_arrays(*attributes).alias("_attrs"), F.from_xml(document, f"{ESSAY_SCHEMA}, _error string", {
        "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_error"}).alias("d"))
    raw = raw.select("_attrs", "d.*")
    paragraphs = F.concat(
        F.when(F.col("TEXT.TITLE").isNotNull(), F.array("TEXT.TITLE")).otherwise(F.array().cast("array<string>")),
        F.coalesce("TEXT.P", F.array().cast("array<string>")))
    mistakes = F.flatten(F.transform(
        F.filter(F.coalesce("ANNOTATION", F.array().cast(dict(raw.dtypes)["ANNOTATION"])),
                 lambda a: a["MISTAKE"].isNotNull()),
        lambda a: F.transform(a["MISTAKE"], lambda m: F.struct(
            a["_teacher_id"].alias("teacher_id"), *(m[f"_{name}"].alias(name) for name in MISTAKE_ATTRIBUTES),
            _inner_text(m["TYPE"]).alias("type"), _inner_text(m["CORRECTION"]).alias("correction"),
            _inner_text(m["COMMENT"]).alias("comment")))))
    return raw.select(
        F.col("_nid").alias("doc_id"),
        F.col("_attrs").alias("attrs"),
        F.transform(paragraphs, lambda p: _inner_text(F.coalesce(p, F.lit("")))).alias("paragraphs"),
        mistakes.alias("mistakes"), *(_inner_text(F.col(tag)).alias(tag.lower()) for tag in PROFILE_TAGS),
        F.col("_error").alias("error"))


def essay_mistakes(essays: DataFrame) -> DataFrame:
    return unnest(essays, ["doc_id"], "mistakes", "m").select("doc_id", "m.*")


def essay_paragraphs(essays: DataFrame) -> DataFrame:
    return unnest(essays, ["doc_id"], "paragraphs", "text", "par")


def essay_profiles(essays: DataFrame) -> DataFrame:
    return essays.select("doc_id", *(tag.lower() for tag in PROFILE_TAGS))


def write_essays(df: DataFrame, path: str) -> None:
    """Write rows of the essay schema (attributes with a leading underscore) as documents."""
    df.write.format("xml").options(rowTag="DOC", rootTag="ESSAYS").save(path)
