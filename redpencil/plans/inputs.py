"""Inputs of the registered queries: views of the given tables, in Spark and as SQL.

Sentences are the pieces of ``documents.text`` between line breaks and ". ". Systems are fixed
rewrites of the sentences, whose edits are known:

* every 16 tokens, token 2 is replaced by ``zz<i>``, ``yy<i>`` is put before token 7, and token 12
  is deleted unless it equals a neighbour;
* system ``full`` has all of them, ``half`` the replacements only,
  ``same`` none;
* annotator 0 marks all of them; annotator 1 marks the replacements at every 32 tokens, or nothing
  (noop) for every third sentence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from redpencil.functions.sequences import let
from redpencil.functions.text import WS
from redpencil.functions.tokenizer import whitespace_tokens
from redpencil.session import deal, spread, unnest
from redpencil.sources.gold import NOOP, gold_sets

PIECE = r"\n|\. "
IDS_PER_DOC = 1 << 31     # more than the elements of an array: sentence ids are document id, then place in it


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet"))


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    docs = deal(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    pieces = unnest(docs, ["doc_id", "lang"], F.split("text", PIECE), "source", "pos")
    return pieces.where("source <> ''").select(
        (F.col("doc_id") * IDS_PER_DOC + F.col("pos")).alias("sent_id"), "doc_id", "pos", "lang", "source")


def sql_tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda t: t <> '')"


def sql_strip(text: str) -> str:
    return rf"regexp_replace({text}, '\A{WS}+|{WS}+\z', '', 'g')"


SENTENCES = rf"""sent AS (
  SELECT doc_id * {IDS_PER_DOC} + k - 1 AS sent_id, doc_id, k - 1 AS pos, lang, piece AS source
  FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(text, '{PIECE}')) AS piece,
               generate_subscripts(regexp_split_to_array(text, '{PIECE}'), 1) AS k FROM documents)
  WHERE piece <> '')"""

TOKENS = f"tok AS (SELECT *, {sql_tokens('source')} AS w, len({sql_tokens('source')}) AS n FROM sent)"


def deleted(words: Column, i: Column) -> Column:
    here = F.get(words, i)
    return (i % 16 == 12) & (here != F.get(words, i - 1)) & ~here.eqNullSafe(F.get(words, i + 1))


def rewrite(words: Column, system: str) -> Column:
    """The system's sentence from source tokens."""
    def piece(word, i):
        new = F.when(i % 16 == 2, F.array(F.concat(F.lit("zz"), i.cast("string"))))
        if system == "full":
            new = new.when(i % 16 == 7, F.array(F.concat(F.lit("yy"), i.cast("string")), word))
            new = new.when(deleted(words, i), F.array().cast("array<string>"))
        return new.otherwise(F.array(word))
    if system == "same":
        return F.array_join(words, " ")
    return F.array_join(F.flatten(F.transform(words, piece)), " ")


SQL_DELETED = "(i % 16 = 12 AND w[i+1] <> w[i] AND w[i+1] IS DISTINCT FROM w[i+2])"
KNOWN = f"""known AS (
  SELECT sent_id, doc_id, pos, lang, source, w, n, i, w[i+1] AS word,
         CASE WHEN i % 16 = 2 THEN 'sub' WHEN i % 16 = 7 THEN 'ins' WHEN {SQL_DELETED} THEN 'del' END AS op
  FROM (SELECT *, unnest(range(n)) AS i FROM tok)),
edit AS (
  SELECT sent_id, doc_id, pos, i, op, i AS start_, CASE WHEN op = 'ins' THEN i ELSE i + 1 END AS end_,
         CASE WHEN op = 'ins' THEN '' ELSE word END AS original,
         CASE op WHEN 'sub' THEN 'zz' || i WHEN 'ins' THEN 'yy' || i ELSE '' END AS correction
  FROM known WHERE op IS NOT NULL)"""
OPS = """ops AS (
  SELECT t.sent_id, t.doc_id, t.pos, t.lang, t.n, count(e.op) AS all_, count(e.op) FILTER (e.op = 'sub') AS subs,
         count(e.op) FILTER (e.op = 'ins') AS ins, count(e.op) FILTER (e.op = 'del') AS dels,
         count(e.op) FILTER (e.op = 'sub' AND e.i % 32 = 2) AS marked
  FROM tok t LEFT JOIN edit e ON t.sent_id = e.sent_id GROUP BY ALL)"""
BASE = f"WITH {SENTENCES}, {TOKENS}, {KNOWN}, {OPS}"


def hypotheses(spark: SparkSession, sf: str, systems=("full", "half", "same")) -> DataFrame:
    """``system, sent_id, text`` for all sentences; one scan, exploded to systems."""
    rows = sentences(spark, sf).withColumn("_w", whitespace_tokens(F.col("source")))
    outputs = F.array(*(F.struct(F.lit(s).alias("system"), rewrite(F.col("_w"), s).alias("text")) for s in systems))
    return unnest(rows, ["sent_id"], outputs, "o").select("o.system", "sent_id", "o.text")


def annotations(words: Column, pos: Column) -> Column:
    """All annotations of a sentence as an array, in document order per annotator."""
    places = F.filter(F.transform(words, lambda _, i: F.when(
        (i % 16 == 2) | (i % 16 == 7) | F.coalesce(deleted(words, i), F.lit(False)), i)), lambda i: i.isNotNull())

    def marked(i):
        op = F.when(i % 16 == 2, "sub").when(i % 16 == 7, "ins").otherwise("del")
        text = i.cast("string")
        fixes = F.when(i % 16 == 2, F.array(F.concat(F.lit("zz"), text), F.lit("other"))).when(
            i % 16 == 7, F.array(F.concat(F.lit("yy"), text))).otherwise(F.array(F.lit("")))
        return F.struct(
            F.lit(0).alias("annotator"), i.alias("start"), F.when(i % 16 == 7, i).otherwise(i + 1).alias("end"),
            op.alias("etype"), F.when(i % 16 == 7, "").otherwise(F.get(words, i)).alias("original"),
            fixes.alias("corrections"), F.lit("REQUIRED").alias("required"), F.lit("-NONE-").alias("comment"))

    def second(everything):
        return F.transform(F.filter(everything, lambda a: (a["etype"] == "sub") & (a["start"] % 32 == 2)),
                           lambda a: a.withField("annotator", F.lit(1)))
    noop = F.array(F.struct(
        F.lit(1).alias("annotator"), F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(NOOP).alias("etype"),
        F.lit("").alias("original"), F.array(F.lit("")).alias("corrections"), F.lit("REQUIRED").alias("required"),
        F.lit("-NONE-").alias("comment")))
    return let(F.transform(places, marked), lambda everything: F.concat(
        everything, F.when(pos % 3 == 0, noop).otherwise(second(everything))))


def gold_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``sent_id, source, tokens, annotations, gold`` for all sentences."""
    rows = sentences(spark, sf).withColumn("tokens", whitespace_tokens(F.col("source")))
    rows = rows.withColumn("annotations", annotations(F.col("tokens"), F.col("pos")))
    return rows.select("sent_id", "doc_id", "pos", "source", "tokens", "annotations", gold_sets(
        F.col("annotations"), F.size("tokens")).alias("gold"))


# Sets per annotator as the reader builds them: annotator 0 exists when it has edits; a sentence
# without any annotation line gets an empty annotator 0.
SETS = """sets AS (
  SELECT sent_id, pos, 0 AS annotator, all_ AS gold FROM ops WHERE all_ > 0 OR (pos % 3 <> 0 AND marked = 0)
  UNION ALL
  SELECT sent_id, pos, 1, CASE WHEN pos % 3 = 0 THEN 0 ELSE marked END FROM ops WHERE pos % 3 = 0 OR marked > 0),
counts AS (
  SELECT y.system, s.sent_id, s.annotator, s.gold,
         CASE y.system WHEN 'full' THEN o.all_ WHEN 'half' THEN o.subs ELSE 0 END AS proposed,
         CASE WHEN y.system = 'same' THEN 0 WHEN s.annotator = 1 THEN s.gold
              WHEN y.system = 'full' THEN o.all_ ELSE o.subs END AS correct
  FROM sets s JOIN ops o ON s.sent_id = o.sent_id
  CROSS JOIN (SELECT unnest(['full', 'half', 'same']) AS system) y)"""
SCORED = f"{BASE}, {SETS}"


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """``sent_id, source, raw``: sentences inside decoded model outputs of several shapes."""
    s = F.col("source")
    raw = (F.when(F.col("pos") % 5 == 0, F.concat(F.lit("<s> GEC: "), s, F.lit("\nCorrected: "), s, F.lit(" </s>")))
           .when(F.col("pos") % 5 == 1, F.concat(F.lit("<s> GEC: "), s, F.lit('\nCorrected: "'), s, F.lit('"')))
           .when(F.col("pos") % 5 == 2, F.concat(s, F.lit("!?! .. ")))
           .when(F.col("pos") % 5 == 3, F.concat(
               F.lit("\n[INST] <<SYS>>\n"), s, F.lit("\n<</SYS>>\nfix it [/INST] "), s, F.lit(" </s")))
           .otherwise(F.concat(
               F.lit("    ### Instruction: x\n\n    ### Response:\n    \n  "), s, F.lit("  \nmore"))))
    return sentences(spark, sf).select("sent_id", "source", raw.alias("raw"))


RESPONSES = f"""WITH {SENTENCES}, resp AS (SELECT sent_id, source, CASE pos % 5
  WHEN 0 THEN '<s> GEC: ' || source || chr(10) || 'Corrected: ' || source || ' </s>'
  WHEN 1 THEN '<s> GEC: ' || source || chr(10) || 'Corrected: "' || source || '"'
  WHEN 2 THEN source || '!?! .. '
  WHEN 3 THEN chr(10) || '[INST] <<SYS>>' || chr(10) || source || chr(10) || '<</SYS>>' || chr(10)
              || 'fix it [/INST] ' || source || ' </s'
  ELSE '    ### Instruction: x' || chr(10) || chr(10) || '    ### Response:' || chr(10) || '    ' || chr(10)
       || '  ' || source || '  ' || chr(10) || 'more' END AS raw FROM sent)"""


TURNS = 1 << 31           # pair ids: conversation id, then the turn


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """``pair_id, source, target``: a user turn and the assistant turn after it, null when missing.

    Every seventh target is missing and every fifth equals its source.
    """
    turns = table(spark, sf, "conversations")
    users = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    answers = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pair_id = F.col("conv_id") * TURNS + F.when(F.col("turn").between(0, TURNS - 1), F.col("turn")).otherwise(
        F.raise_error(F.lit("turn out of range")).cast("long"))
    target = F.when(pair_id % 7 == 0, None).when(pair_id % 5 == 0, F.col("source")).otherwise(F.col("answer"))
    return users.join(answers, ["conv_id", "turn"], "left").select(pair_id.alias("pair_id"), "source", target.alias("target"))


CORPUS = f"""corpus AS (
  SELECT u.conv_id * {TURNS} + u.turn AS pair_id, u.text AS source,
         CASE WHEN (u.conv_id * {TURNS} + u.turn) % 7 = 0 THEN NULL
              WHEN (u.conv_id * {TURNS} + u.turn) % 5 = 0 THEN u.text ELSE a.text END AS target
  FROM conversations u LEFT JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""
