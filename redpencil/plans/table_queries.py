"""Registered queries over sources, sinks, samples and ordered-table utilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from redpencil.functions import prompts
from redpencil.functions.sequences import intersect_keeping_duplicates
from redpencil.functions.text import WS
from redpencil.functions.tokenizer import whitespace_tokens
from redpencil.operators import edits, offsets, sampling, tables
from redpencil.plans.edit_queries import _pairs
from redpencil.plans.inputs import (
    TURNS,
    BASE, CORPUS, SCORED, SENTENCES, corpus, gold_rows, sentences, sql_strip, sql_tokens, table)
from redpencil.plans.text_queries import sql_ptb_tokens
from redpencil.session import new_path, unnest
from redpencil.sources import essays, gold, lines


# ---------------------------------------------------------------- sources and sinks: write, then read

def _parallel(spark, sf):
    path = new_path(spark, "parallel")
    lines.write_parallel(corpus(spark, sf), path)
    return lines.read_parallel(spark, path)


_FLAT = "nullif(translate({c}, chr(9) || chr(10), '  '), '')"
_PARALLEL = f"""WITH {CORPUS} SELECT row_number() OVER (ORDER BY pair_id) - 1 AS pair_id,
  {_FLAT.format(c='source')} AS source, {_FLAT.format(c='target')} AS target FROM corpus"""


def _sentence_file(compression=None):
    def run(spark, sf):
        path = new_path(spark, "sentences")
        docs = table(spark, sf, "documents").select(F.col("doc_id").alias("sent_id"), "text")
        lines.write_sentences(docs, path, compression=compression)
        return lines.read_sentences(spark, path)
    return run


_SENTENCE_FILE = f"""SELECT row_number() OVER (ORDER BY doc_id) - 1 AS sent_id,
  {sql_strip("replace(text, chr(10), ' ')")} AS text FROM documents"""


def _gold_file(spark, sf):
    path = new_path(spark, "gold")
    # tokenized sources, as the format requires
    rows = gold_rows(spark, sf).withColumn("source", F.array_join("tokens", " "))
    gold.write_gold(gold.Gold(rows), path)
    return gold.read_gold(spark, path)


_GOLD_LIST = f"""{BASE}, place AS (SELECT sent_id, pos, row_number() OVER (ORDER BY sent_id) - 1 AS line FROM tok),
listed AS (
  SELECT p.line AS sent_id, 0 AS annotator, e.i AS ord, e.start_ AS start, e.end_ AS "end", e.op AS etype, e.original,
         CASE WHEN e.op = 'sub' THEN [e.correction, 'other'] ELSE [e.correction] END AS corrections
  FROM edit e JOIN place p ON p.sent_id = e.sent_id
  UNION ALL
  SELECT p.line, 1, e.i, e.start_, e.end_, e.op, e.original, [e.correction, 'other'] FROM edit e
  JOIN place p ON p.sent_id = e.sent_id WHERE e.op = 'sub' AND e.i % 32 = 2 AND e.pos % 3 <> 0
  UNION ALL SELECT line, 1, 0, -1, -1, 'noop', '', [''] FROM place WHERE pos % 3 = 0)"""


def _blocks_file(spark, sf):
    """Pages as blocks: tags cut apart on lines of their own, an empty line after each page."""
    path = new_path(spark, "blocks")
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace("html", "\n+", "\n").alias("value"))
    pages.orderBy("page_id").select("value").write.text(path, lineSep="\n\n")
    return lines.read_blocks(spark, path)


def _write_read_edits(with_target):
    def run(spark, sf):
        path = new_path(spark, "edits")
        rows = _pairs(spark, sf, "half").withColumn("source", F.array_join(whitespace_tokens(F.col("source")), " "))
        gold.write_edits(edits.with_edits(rows), path, with_target)
        return lines.read_blocks(spark, path).select("block_id", "text")
    return run


_HALF = """half AS (SELECT sent_id, string_agg(CASE WHEN op = 'sub' THEN 'zz' || i ELSE word END, ' ' ORDER BY i) AS text,
  string_agg('A ' || i || ' ' || (i + 1) || '|||UNK|||zz' || i || '|||REQUIRED|||-NONE-|||0', chr(10) ORDER BY i)
    FILTER (op = 'sub') AS marks FROM known GROUP BY sent_id)"""


def _edit_file_sql(with_target: bool) -> str:
    target = "|| chr(10) || 'T ' || coalesce(h.text, '')" if with_target else ""
    return f"""{BASE}, {_HALF} SELECT row_number() OVER (ORDER BY t.sent_id) - 1 AS block_id,
      'S ' || array_to_string(w, ' ') {target} || coalesce(chr(10) || h.marks, '') AS text
      FROM tok t LEFT JOIN half h ON h.sent_id = t.sent_id"""


def _dataset(spark, sf):
    path = new_path(spark, "dataset")
    rows = sampling.changed_pairs(corpus(spark, sf))
    lines.save_dataset(rows.select("pair_id", prompts.rl_prompt(F.col("source")).alias("text"), "source", "target"), path)
    return lines.load_dataset(spark, path)


# XML has no place for these, and readers fold carriage returns
_XML_SAFE = r"[^\x09\x0A\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def _essays(spark, sf):
    """Documents as essays: first line the title, other lines paragraphs, one mistake per line but the first."""
    path = new_path(spark, "essays")
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("_nid"), "lang", F.split(F.regexp_replace("text", _XML_SAFE, ""), "\n").alias("l"))
    body = F.slice("l", F.lit(2), F.size("l"))
    mistakes = F.transform(body, lambda x, i: F.struct(
        (i + 1).cast("int").alias("_start_par"), F.lit(0).alias("_start_off"), (i + 1).cast("int").alias("_end_par"),
        F.length(x).alias("_end_off"), F.when(i % 2 == 0, "Mec").otherwise("Vt").alias("TYPE"),
        F.upper(F.substring(x, 1, 3)).alias("CORRECTION")))
    docs = rows.select(
        "_nid", F.col("lang").alias("NATIONALITY"), F.struct(F.element_at("l", 1).alias("TITLE"), body.alias("P")).alias("TEXT"),
        F.array(F.struct((F.col("_nid") % 7).cast("int").alias("_teacher_id"), mistakes.alias("MISTAKE"))).alias("ANNOTATION"))
    essays.write_essays(docs, path)
    return essays.read_essays(spark, path)


_ESSAY = rf"""WITH essay AS (SELECT doc_id, lang, string_split(regexp_replace(text, '{_XML_SAFE}', '', 'g'), chr(10)) AS l FROM documents)"""
_BLANK = rf"regexp_matches(t, '\A{WS}*\z')"


# ---------------------------------------------------------------- ordered tables

def _event_lines(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


def _vectors(spark, sf):
    rows = unnest(table(spark, sf, "embeddings"), ["vec_id", "label"], "embedding", "v", "dim")
    return rows.select("vec_id", "label", "dim", F.col("v").cast("double").alias("v"))


def _batches(spark, sf):
    pairs = corpus(spark, sf).where("target is not null")
    placed = tables.prefix_sum(pairs, F.lit(1), "place", "pair_id", width=TURNS * 20_000).withColumn("place", F.col("place") - 1)
    return tables.collate(placed, "place", ["source", "target"], 4)


def _grid(spark, sf):
    """For each user a grid from 0 to the number of their events in steps of 0.5."""
    counts = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return tables.frange_rows(counts, F.col("n"), 0.5).select("user_id", "value")


def _convert_blocks(spark, sf):
    rows = sentences(spark, sf).select("sent_id", "source", F.length("source").alias("n"))
    block = F.concat(
        F.lit("S "), "source", F.lit("\nA "), F.floor(F.col("n") / 3).cast("string"), F.lit(" "), F.col("n").cast("string"),
        F.lit("|||Mec|||it's, fine||ok.|||REQUIRED|||-NONE-|||0\nI note"))
    return offsets.convert_blocks(rows.select("sent_id", block.alias("text")))


_FIX = "array_to_string(" + sql_ptb_tokens("'it''s, fine'") + ", ' ') || '||' || array_to_string(" + sql_ptb_tokens("'ok.'") + ", ' ')"

QUERIES = {
    "a1_parallel_file": (_parallel, _PARALLEL),
    "a2_sentence_file": (_sentence_file(), _SENTENCE_FILE),
    "a3_gold_edits": (
        lambda spark, sf: _gold_file(spark, sf).edits.select(
            "sent_id", "annotator", "start", "end", "etype", "original", "corrections"),
        f'{_GOLD_LIST} SELECT sent_id, annotator, start, "end", etype, original, corrections FROM listed'),
    "a3_gold_sets": (
        lambda spark, sf: _gold_file(spark, sf).sets.select("sent_id", "annotator", F.size("edits").alias("edits")),
        f"""{SCORED}, place AS (SELECT sent_id, row_number() OVER (ORDER BY sent_id) - 1 AS line FROM tok)
            SELECT line AS sent_id, annotator, gold AS edits FROM sets JOIN place ON place.sent_id = sets.sent_id"""),
    "a4_gzip_sentence_file": (_sentence_file("gzip"), _SENTENCE_FILE),
    "a5_block_file": (
        _blocks_file,
        rf"""SELECT row_number() OVER (ORDER BY page_id) - 1 AS block_id, regexp_replace(regexp_replace(html, '\n+', chr(10), 'g'),
             '\A\n+|\n+\z', '', 'g') AS text FROM pages"""),
    "a5_blocks_of_rows": (
        lambda spark, sf: tables.blocks(_event_lines(spark, sf), F.col("event_type") == "error", "event_id", "event_type",
                                        joiner="\n"),
        """WITH marked AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS b FROM events)
           SELECT b::BIGINT AS block_id, string_agg(event_type, chr(10) ORDER BY event_id) AS text FROM marked
           WHERE event_type <> 'error' GROUP BY b"""),
    "a6_saved_dataset": (
        _dataset,
        f"""WITH {CORPUS} SELECT pair_id, 'GEC: ' || source || chr(10) || 'Corrected:' AS text, source, target FROM corpus
            WHERE target IS NOT NULL AND target <> source"""),
    "a7_write_sentences": (
        lambda spark, sf: _sentence_file()(spark, sf).groupBy((F.col("sent_id") % 10).alias("bucket")).agg(
            F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars")),
        f"WITH f AS ({_SENTENCE_FILE}) SELECT sent_id % 10 AS bucket, count(*) AS lines, sum(len(text))::BIGINT AS chars FROM f GROUP BY 1"),
    "a8_edit_file": (_write_read_edits(False), _edit_file_sql(False)),
    "a8_edit_file_with_target": (_write_read_edits(True), _edit_file_sql(True)),
    "a9_essays": (
        lambda spark, sf: _essays(spark, sf).select("doc_id", F.size("paragraphs").alias("paragraphs"), F.size("mistakes").alias("mistakes")),
        f"{_ESSAY} SELECT doc_id, len(l)::INTEGER AS paragraphs, (len(l) - 1)::INTEGER AS mistakes FROM essay"),
    "a10_essay_mistakes": (
        lambda spark, sf: essays.essay_mistakes(_essays(spark, sf)).select(
            "doc_id", "teacher_id", "start_par", "start_off", "end_par", "end_off", "type"),
        f"""{_ESSAY}, line AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS k FROM essay)
            SELECT doc_id, (doc_id % 7)::INTEGER AS teacher_id, k::INTEGER AS start_par, 0 AS start_off, k::INTEGER AS end_par,
                   len(t)::INTEGER AS end_off, CASE WHEN k % 2 = 1 THEN 'Mec' ELSE 'Vt' END AS type FROM line WHERE k > 0"""),
    "a11_essay_paragraphs": (
        lambda spark, sf: essays.essay_paragraphs(_essays(spark, sf)),
        f"""{_ESSAY}, line AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS k FROM essay)
            SELECT doc_id, k::INTEGER AS par, CASE WHEN {_BLANK} THEN '' ELSE t END AS text FROM line"""),
    "a11_essay_profiles": (
        lambda spark, sf: essays.essay_profiles(_essays(spark, sf)).select("doc_id", "nationality"),
        "SELECT doc_id, lang AS nationality FROM documents"),
    "c1_changed_pairs": (
        lambda spark, sf: sampling.changed_pairs(corpus(spark, sf)),
        f"WITH {CORPUS} SELECT * FROM corpus WHERE target IS NOT NULL AND source IS DISTINCT FROM target"),
    "c2_seeded_sample_sft": (
        lambda spark, sf: sampling.seeded_sample(table(spark, sf, "lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("key")).distinct(),
            45030, 42, "key", strict=False),
        """WITH k AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS key FROM lineitem)
           SELECT key FROM k ORDER BY md5('42:' || key), key LIMIT 45030"""),
    "c2_seeded_sample_rl": (
        lambda spark, sf: sampling.seeded_sample(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 5000, 15580,
                                                 "o_orderkey", strict=False),
        "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('15580:' || o_orderkey), o_orderkey LIMIT 5000"),
    "e5_convert_offsets": (
        _convert_blocks,
        f"""WITH {SENTENCES} SELECT sent_id, 'S ' || array_to_string({sql_ptb_tokens('source')}, ' ') || chr(10) || 'A '
              || len({sql_ptb_tokens('substr(source, 1, len(source) // 3)')}) || ' ' || len({sql_ptb_tokens('source')})
              || '|||Mec|||' || {_FIX} || '|||REQUIRED|||-NONE-|||0' || chr(10) || 'I note' AS text FROM sent"""),
    "g14_collate": (
        _batches,
        f"""WITH {CORPUS}, placed AS (SELECT *, row_number() OVER (ORDER BY pair_id) - 1 AS place FROM corpus WHERE target IS NOT NULL)
            SELECT place // 4 AS batch_id, list(source ORDER BY place) AS source, list(target ORDER BY place) AS target
            FROM placed GROUP BY place // 4"""),
    "i1_uniq": (
        lambda spark, sf: tables.uniq(_event_lines(spark, sf), "event_type", "event_id", by=["user_id"]),
        """SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (
             PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1"""),
    "i1_uniq_text": (
        lambda spark, sf: tables.uniq(table(spark, sf, "documents").select("doc_id", "text"), F.lower("text"), "doc_id"),
        "SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) AS k FROM documents) WHERE k = 1"),
    "i2_sort_entries": (
        lambda spark, sf: tables.sort_entries(table(spark, sf, "orders").groupBy("o_custkey").agg(
            F.max("o_totalprice").alias("price")), "o_custkey", "price", by_value=True, reverse=True),
        "SELECT o_custkey, max(o_totalprice) AS price FROM orders GROUP BY o_custkey ORDER BY price DESC, o_custkey"),
    "i3_max_entry_by_value": (
        lambda spark, sf: tables.extreme_entry(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity", True, True, ["l_suppkey"]),
        """SELECT l_suppkey, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (
             PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey) AS k FROM lineitem) WHERE k = 1"""),
    "i3_min_entry_by_value": (
        lambda spark, sf: tables.extreme_entry(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", False, True, ["o_orderpriority"]),
        """SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (
             PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k FROM orders) WHERE k = 1"""),
    "i3_max_entry_by_key": (
        lambda spark, sf: tables.extreme_entry(table(spark, sf, "orders"), "o_orderkey", "o_totalprice", True, False, ["o_custkey"]),
        """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (
             PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1"""),
    "i5_intersect": (
        lambda spark, sf: sentences(spark, sf).select("sent_id", intersect_keeping_duplicates(
            whitespace_tokens(F.col("source")), F.split(F.lit("the of and de la der die und et"), " ")).alias("words")),
        f"""WITH {SENTENCES} SELECT sent_id, list_filter({sql_tokens('source')},
              lambda x: list_contains(string_split('the of and de la der die und et', ' '), x)) AS words FROM sent"""),
    "i8_pairs": (
        lambda spark, sf: tables.pairs(_event_lines(spark, sf), "event_type", "event_id", ["user_id"]),
        """WITH r AS (SELECT *, row_number() OVER w AS k, lead(event_type) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
           SELECT user_id, event_id, event_type AS first, nxt AS second FROM r WHERE k % 2 = 1"""),
    "i8_overlapping_pairs": (
        lambda spark, sf: tables.pairs(_event_lines(spark, sf), "event_type", "event_id", overlapping=True),
        """WITH r AS (SELECT *, row_number() OVER w AS k, lead(event_type) OVER w AS nxt, lead(event_id) OVER w AS more FROM events WINDOW w AS (ORDER BY event_id))
           SELECT event_id, event_type AS first, nxt AS second FROM r WHERE more IS NOT NULL OR k % 2 = 1"""),
    "i9_softmax": (
        lambda spark, sf: tables.softmax(_vectors(spark, sf), "v", "p", ["vec_id"]).select("vec_id", "dim", F.round("p", 9).alias("p")),
        """WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
           e AS (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id)) AS e FROM v)
           SELECT vec_id, dim, round(e / sum(e) OVER (PARTITION BY vec_id), 9) AS p FROM e"""),
    "i10_frange": (
        _grid, """SELECT user_id, k * 0.5::DOUBLE AS value
                  FROM (SELECT user_id, unnest(range(2 * count(*))) AS k FROM events GROUP BY user_id)"""),
    "j2_custom_key_and_joiner": (
        lambda spark, sf: tables.blocks(
            sentences(spark, sf).select("doc_id", "pos", "source"), F.length("source") < 20, "pos", "source", by=["doc_id"], joiner=" / "),
        f"""WITH {SENTENCES}, m AS (SELECT *, sum(CASE WHEN len(source) < 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM sent)
            SELECT doc_id, b::BIGINT AS block_id, string_agg(source, ' / ' ORDER BY pos) AS text FROM m WHERE len(source) >= 20 GROUP BY doc_id, b"""),
}
