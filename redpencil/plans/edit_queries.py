"""Registered queries over sentence pairs: edits, matching, scores and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from redpencil.functions import prompts, rates
from redpencil.functions.sequences import shrink
from redpencil.functions.tokenizer import whitespace_tokens
from redpencil.operators import edits, rewards, sampling, scoring
from redpencil.operators.alignment import token_distance
from redpencil.session import unnest
from redpencil.plans.inputs import (
    BASE, IDS_PER_DOC, SCORED, gold_rows, hypotheses, rewrite, sentences)

# 2,000 documents' worth of sentence ids per segment of the running choice
SEGMENT = IDS_PER_DOC * 2000


def _pairs(spark, sf, system="full"):
    rows = sentences(spark, sf).withColumn("_w", whitespace_tokens(F.col("source")))
    return rows.select("sent_id", "lang", "doc_id", "source", rewrite(F.col("_w"), system).alias("hypothesis"))


def _known_sql(select: str, rest: str = "") -> str:
    return f"{BASE} SELECT {select} FROM edit {rest}"


def _edit_table(spark, sf):
    return edits.extract_edits(_pairs(spark, sf, "half"), ["sent_id"])


def _edit_counts(spark, sf):
    """Edits per source language, with counts summed before the shuffle."""
    counted = edits.edit_count(_pairs(spark, sf), "source", "hypothesis", "edits")
    return counted.groupBy("lang").agg(F.sum("edits").alias("edits"), F.count("*").alias("sentences"))


def _aligned(spark, sf, systems=("full", "half", "same"), **options):
    rows = hypotheses(spark, sf, systems).join(gold_rows(spark, sf).select("sent_id", "source", "gold"), "sent_id")
    return edits.align_to_gold(rows, **options)


def _aligned_in_place(spark, sf, systems=("full", "half", "same"), **options):
    """The same rows without the join: systems and gold derive from one scan of the sentences."""
    rows = gold_rows(spark, sf)
    outputs = F.array(*(F.struct(F.lit(s).alias("system"), rewrite(F.col("tokens"), s).alias("text")) for s in systems))
    rows = unnest(rows, ["sent_id", "source", "gold"], outputs, "o").select(
        "o.system", "sent_id", "o.text", "source", "gold")
    return edits.align_to_gold(rows, **options)


def _counts(spark, sf, **options):
    return scoring.sentence_counts(_aligned_in_place(spark, sf, **options), ["system", "sent_id"])


def _vs_gold(spark, sf):
    """Every edit of the 'full' system for each annotator, without merging."""
    rows = hypotheses(spark, sf, ("full",)).join(gold_rows(spark, sf).select("sent_id", "source", "gold"), "sent_id")
    found = edits.extract_edits_vs_gold(rows, ["sent_id"], max_unchanged_words=0)
    # where words repeat, an edit can stand at more than one place; its text is the same
    return found.groupBy("sent_id", "annotator").agg(
        F.count("*").alias("edits"), F.array_join(F.array_sort(F.collect_list("correction")), "|").alias("corrections"))


_MATCHED = f"""{SCORED}, found AS (
  SELECT e.sent_id, 0 AS annotator, start_ AS start, end_ AS "end", original, correction FROM edit e
  UNION ALL
  SELECT e.sent_id, 1, start_, end_, original, correction FROM edit e WHERE op = 'sub' AND i % 32 = 2 AND pos % 3 <> 0)"""


def _semi_join(spark, sf):
    """Known edits of the 'half' system against gold, both as long tables."""
    gold = gold_rows(spark, sf)
    sets = unnest(gold, ["sent_id"], "gold", "g")
    gold_edits = unnest(sets, ["sent_id", "g.annotator"], "g.edits", "e").select("sent_id", "annotator", "e.*")
    found = edits.extract_edits(_pairs(spark, sf, "half"), ["sent_id"])
    both = found.withColumn("annotator", F.explode(F.array(F.lit(0), F.lit(1))))
    return scoring.match_edits(both, gold_edits, ["sent_id", "annotator"])


def _score(spark, sf):
    return scoring.score(hypotheses(spark, sf), gold_rows(spark, sf), segment_rows=SEGMENT)


def _report(spark, sf):
    return scoring.line_report(hypotheses(spark, sf), gold_rows(spark, sf), segment_rows=SEGMENT)


def _single(spark, sf, beta=0.5):
    return scoring.score_single(hypotheses(spark, sf), gold_rows(spark, sf), beta=beta)


_RATES = """CASE WHEN proposed = 0 THEN 1.0::DOUBLE ELSE correct::DOUBLE / proposed END AS p,
  CASE WHEN gold = 0 THEN 1.0::DOUBLE ELSE correct::DOUBLE / gold END AS r"""
_FINAL = """CASE WHEN 0.25::DOUBLE * p + r = 0 THEN 0.0::DOUBLE
  ELSE 1.25::DOUBLE * p * r / (0.25::DOUBLE * p + r) END AS f"""
_FIRST = f"""{SCORED}, first AS (
  SELECT y.system, o.sent_id, 0 AS annotator, o.all_ AS gold,
         CASE y.system WHEN 'full' THEN o.all_ WHEN 'half' THEN o.subs ELSE 0 END AS proposed,
         CASE y.system WHEN 'full' THEN o.all_ WHEN 'half' THEN o.subs ELSE 0 END AS correct
  FROM ops o CROSS JOIN (SELECT unnest(['full', 'half', 'same']) AS system) y)"""
_SINGLE = f"""{_FIRST}, totals AS (SELECT system, sum(correct)::BIGINT AS correct, sum(proposed)::BIGINT AS proposed,
  sum(gold)::BIGINT AS gold FROM first GROUP BY system),
rated AS (SELECT *, {_RATES} FROM totals), final AS (SELECT *, {_FINAL} FROM rated)"""

# The running choice as one ordered fold per system.
_F = "(CASE WHEN 0.25::DOUBLE * {g} + {p} = 0 THEN (CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE ELSE 1.25::DOUBLE * {c} / (0.25::DOUBLE * {g} + {p}) END)"
_F0 = _F.format(c="(acc.c + x.c0)", p="(acc.p + x.p0)", g="(acc.g + x.g0)")
_F1 = _F.format(c="(acc.c + x.c1)", p="(acc.p + x.p1)", g="(acc.g + x.g1)")
_SECOND = f"""(x.c1 IS NOT NULL AND (x.c0 IS NULL OR {_F1} > {_F0} OR ({_F1} = {_F0} AND (x.c1 > x.c0 OR
  (x.c1 = x.c0 AND x.p1 + 0.25::DOUBLE * x.g1 < x.p0 + 0.25::DOUBLE * x.g0)))))"""
_LINES = f"""{SCORED}, line AS (
  SELECT system, sent_id, max(correct) FILTER (annotator = 0) AS c0, max(proposed) FILTER (annotator = 0) AS p0,
         max(gold) FILTER (annotator = 0) AS g0, max(correct) FILTER (annotator = 1) AS c1,
         max(proposed) FILTER (annotator = 1) AS p1, max(gold) FILTER (annotator = 1) AS g1
  FROM counts GROUP BY system, sent_id),
folded AS (
  SELECT system, list_reduce(
    list({{'c0': c0::BIGINT, 'p0': p0::BIGINT, 'g0': g0::BIGINT, 'c1': c1::BIGINT, 'p1': p1::BIGINT, 'g1': g1::BIGINT}}
         ORDER BY sent_id),
    lambda acc, x: {{'c': (acc.c + CASE WHEN {_SECOND} THEN x.c1 ELSE x.c0 END)::BIGINT,
                    'p': (acc.p + CASE WHEN {_SECOND} THEN x.p1 ELSE x.p0 END)::BIGINT,
                    'g': (acc.g + CASE WHEN {_SECOND} THEN x.g1 ELSE x.g0 END)::BIGINT}},
    {{'c': 0::BIGINT, 'p': 0::BIGINT, 'g': 0::BIGINT}}) AS t
  FROM line GROUP BY system)"""

# The same fold keeping every line's choice.
_REPORT = f"""{_LINES.split("folded AS")[0].rstrip().rstrip(',')}, picked AS (
  SELECT system, list(sent_id ORDER BY sent_id) AS ids, list_reduce(
    list({{'c': c0::BIGINT, 'p': p0::BIGINT, 'g': g0::BIGINT, 'c0': c0::BIGINT, 'p0': p0::BIGINT, 'g0': g0::BIGINT,
          'c1': c1::BIGINT, 'p1': p1::BIGINT, 'g1': g1::BIGINT}} ORDER BY sent_id),
    lambda acc, x: {{'c': (acc.c + CASE WHEN {_SECOND} THEN x.c1 ELSE x.c0 END)::BIGINT,
                    'p': (acc.p + CASE WHEN {_SECOND} THEN x.p1 ELSE x.p0 END)::BIGINT,
                    'g': (acc.g + CASE WHEN {_SECOND} THEN x.g1 ELSE x.g0 END)::BIGINT,
                    'picks': list_append(acc.picks, CASE WHEN {_SECOND} THEN 1 ELSE 0 END)}},
    {{'c': 0::BIGINT, 'p': 0::BIGINT, 'g': 0::BIGINT, 'picks': []::INTEGER[]}}).picks AS picks
  FROM line GROUP BY system),
choice AS (SELECT system, unnest(ids) AS sent_id, unnest(picks) AS annotator FROM picked),
ran AS (
  SELECT k.system, k.sent_id, k.annotator, sum(n.correct) OVER w AS correct, sum(n.proposed) OVER w AS proposed, sum(n.gold) OVER w AS gold
  FROM choice k JOIN counts n ON n.system = k.system AND n.sent_id = k.sent_id AND n.annotator = k.annotator
  WINDOW w AS (PARTITION BY k.system ORDER BY k.sent_id))
SELECT system, sent_id, annotator, correct::BIGINT AS correct, proposed::BIGINT AS proposed, gold::BIGINT AS gold, {_RATES},
  {_F.format(c="correct::BIGINT", p="proposed::BIGINT", g="gold::BIGINT")} AS f FROM ran"""

_SHRINK_HEAD = "coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda k: a[k] <> b[k]), true), least(len(a), len(b)) + 1) - 1"


def _shrink_rows(spark, sf):
    """Each sentence against its rewrite as one whole-sentence edit, then shrunk."""
    rows = _pairs(spark, sf).withColumn("n", F.size(whitespace_tokens(F.col("source"))))
    plain = lambda c: F.array_join(whitespace_tokens(F.col(c)), " ")
    return rows.select("sent_id", shrink(F.lit(0), F.col("n"), plain("source"), plain("hypothesis")).alias("s")).select("sent_id", "s.*")


def _distance(cost):
    def run(spark, sf):
        rows = _pairs(spark, sf)
        tokens = lambda c: whitespace_tokens(F.col(c))
        return rows.select("sent_id", token_distance(tokens("source"), tokens("hypothesis"), cost).alias("distance"))
    return run


def _adjacent(spark, sf):
    """Every second deletion of a sentence followed by an insertion at the same place."""
    rows = sentences(spark, sf).withColumn("w", whitespace_tokens(F.col("source")))
    hyp = F.array_join(F.flatten(F.transform("w", lambda word, i: F.when(
        i % 16 == 5, F.array(F.concat(F.lit("qq"), i.cast("string")))).otherwise(F.array(word)))), " ")
    gold = F.flatten(F.transform("w", lambda word, i: F.when(i % 16 == 5, F.array(
        F.struct(i.alias("start"), (i + 1).alias("end"), word.alias("original"), F.array(F.lit("")).alias("corrections")),
        F.struct((i + 1).alias("start"), (i + 1).alias("end"), F.lit("").alias("original"),
                 F.array(F.concat(F.lit("qq"), i.cast("string"))).alias("corrections")))).otherwise(
        F.array().cast("array<struct<start:int,end:int,original:string,corrections:array<string>>>"))))
    rows = rows.select("sent_id", "source", hyp.alias("text"), F.array(
        F.struct(F.lit(0).alias("annotator"), gold.alias("edits"))).alias("gold"))
    return scoring.adjacent_matches(edits.align_to_gold(rows), ["sent_id"])


_ADJACENT = f"""{BASE} SELECT sent_id, 0 AS annotator, i AS start, i + 1 AS "end", word AS original, '' AS correction, '!' AS flag
  FROM known WHERE i % 16 = 5
  UNION ALL SELECT sent_id, 0, i + 1, i + 1, '', 'qq' || i, '!' FROM known WHERE i % 16 = 5"""


def _reward_rows(spark, sf):
    """Query: source is the 'full' rewrite, target the sentence; response: the 'half' rewrite with two words
    at its end, and a second line."""
    rows = sentences(spark, sf).withColumn("w", whitespace_tokens(F.col("source")))
    plain = F.array_join("w", " ")
    return rows.select(
        F.col("sent_id").alias("row_id"), prompts.reward_query(rewrite(F.col("w"), "full"), plain).alias("query"),
        F.concat(F.lit("Corrected"), rewrite(F.col("w"), "half"), F.lit(" qqq x\nand more")).alias("response"))


_SIG = "1 - 1 / (1 + exp(-(-ln(1.0::DOUBLE / 0.666 - 1) / 3) * {a}))"


def _reward_formula(spark, sf):
    """Reward from known counts: replacements against all edits of each sentence."""
    rows = _pairs(spark, sf)
    counted = edits.edit_count(rows, "source", "hypothesis", "output_edits")
    source = (F.size(whitespace_tokens(F.col("source"))) / 16).cast("long")
    return counted.select("sent_id", F.round(rates.reward(source, F.col("output_edits")), 9).alias("reward"))


def _token_edits(spark, sf):
    """One edit per token: lower case, a space inside, or another word."""
    words = unnest(sentences(spark, sf), ["sent_id"], whitespace_tokens(F.col("source")), "original", "i")
    word = F.col("original")
    fix = (F.when(F.col("i") % 3 == 0, F.lower(word))
           .when(F.col("i") % 3 == 1, F.concat(F.substring(word, 1, 1), F.lit(" "), F.substring(word, F.lit(2), F.length(word))))
           .otherwise(F.concat(F.lit("zz"), F.col("i").cast("string"))))
    return words.select("sent_id", F.col("i").alias("start"), word, fix.alias("correction"))


_TOKEN_EDITS = f"""{BASE}, pair AS (SELECT sent_id, i AS start, word AS original, CASE i % 3 WHEN 0 THEN lower(word)
  WHEN 1 THEN left(word, 1) || ' ' || substr(word, 2) ELSE 'zz' || i END AS correction FROM known)"""


QUERIES = {
    "f1_zip_lines": (
        lambda spark, sf: edits.zip_lines(
            hypotheses(spark, sf, ("full",)).select("sent_id", "text"), sentences(spark, sf).select("sent_id", "source")),
        f"""{BASE}, put AS (SELECT sent_id, i, CASE WHEN op = 'sub' THEN 'zz' || i WHEN op = 'ins' THEN 'yy' || i || ' ' || word
              WHEN op = 'del' THEN NULL ELSE word END AS word FROM known),
            hyp AS (SELECT sent_id, string_agg(word, ' ' ORDER BY i) AS text FROM put GROUP BY sent_id)
            SELECT s.sent_id, coalesce(text, '') AS text, source FROM sent s LEFT JOIN hyp ON s.sent_id = hyp.sent_id"""),
    "f2_token_distance": (_distance(2), f"{BASE} SELECT sent_id, ins + dels + 2 * subs AS distance FROM ops"),
    "f2_token_distance_unit": (_distance(1), f"{BASE} SELECT sent_id, ins + dels + subs AS distance FROM ops"),
    "f3_extract_edits": (
        _edit_table,
        _known_sql('sent_id, row_number() OVER (PARTITION BY sent_id ORDER BY i) - 1 AS edit_pos, start_ AS start, '
                   'end_ AS "end", original, correction', "WHERE op = 'sub'")),
    "f4_extract_edits_vs_gold": (
        _vs_gold, f"""{SCORED} SELECT e.sent_id, s.annotator, count(*) AS edits,
              string_agg(correction, '|' ORDER BY correction) AS corrections
            FROM edit e JOIN sets s ON e.sent_id = s.sent_id GROUP BY ALL"""),
    "f5_merged_edit_counts": (
        lambda spark, sf: edits.edit_count(_pairs(spark, sf), "source", "hypothesis", "edits", max_unchanged_words=2)
        .select("sent_id", "edits"),
        f"{BASE} SELECT sent_id, all_ AS edits FROM ops"),
    "f6_single_lattice_counts": (
        lambda spark, sf: edits.edit_count(_pairs(spark, sf), "source", "hypothesis", "edits", lattice="single")
        .select("sent_id", "edits"),
        f"{BASE} SELECT sent_id, all_ AS edits FROM ops"),
    "f7_shrink_edits": (
        _shrink_rows,
        f"""{BASE}, put AS (SELECT sent_id, i, CASE WHEN op = 'sub' THEN ['zz' || i] WHEN op = 'ins' THEN ['yy' || i, word]
              WHEN op = 'del' THEN [] ELSE [word] END AS words FROM known),
            hyp AS (SELECT sent_id, flatten(list(words ORDER BY i)) AS b FROM put GROUP BY sent_id),
            two AS (SELECT t.sent_id, t.w AS a, coalesce(h.b, []) AS b FROM tok t LEFT JOIN hyp h ON t.sent_id = h.sent_id),
            head AS (SELECT sent_id, {_SHRINK_HEAD} AS h, a, b FROM two),
            rest AS (SELECT sent_id, h, len(a) AS n, list_reverse(a[h + 1:]) AS a, list_reverse(b[h + 1:]) AS b FROM head),
            tail AS (SELECT sent_id, h, n, {_SHRINK_HEAD} AS e, a, b FROM rest)
            SELECT sent_id, h::INTEGER AS start, (n - e)::INTEGER AS "end", array_to_string(list_reverse(a[e + 1:]), ' ') AS original,
                   array_to_string(list_reverse(b[e + 1:]), ' ') AS correction FROM tail"""),
    "f8_edit_count": (_edit_counts, f"{BASE} SELECT lang, sum(all_)::BIGINT AS edits, count(*) AS sentences FROM ops GROUP BY lang"),
    "g1_match_edits": (
        _semi_join,
        f"""{_MATCHED}, half AS (SELECT f.*, row_number() OVER (PARTITION BY e.sent_id, annotator ORDER BY e.i) - 1 AS k FROM found f
              JOIN edit e ON e.sent_id = f.sent_id AND e.op = 'sub' AND e.start_ = f.start AND e."end_" = f."end" AND e.correction = f.correction),
            place AS (SELECT sent_id, start_, row_number() OVER (PARTITION BY sent_id ORDER BY i) - 1 AS edit_pos FROM edit WHERE op = 'sub')
            SELECT h.sent_id, p.edit_pos, h.start, h."end", h.original, h.correction, h.annotator
            FROM half h JOIN place p ON p.sent_id = h.sent_id AND p.start_ = h.start"""),
    "g2_ordered_matches": (
        lambda spark, sf: unnest(
            unnest(_aligned_in_place(spark, sf, ("full",)), ["sent_id"], "alignments", "a"), ["sent_id", "a.annotator"],
            scoring.matched_in_order(F.col("a.edits"), F.col("a.gold")), "e").select("sent_id", "annotator", "e.*"),
        f"{_MATCHED} SELECT * FROM found"),
    "g3_adjacent_matches": (_adjacent, _ADJACENT),
    "g4_sentence_counts": (
        lambda spark, sf: scoring.sentence_counts(_aligned(spark, sf), ["system", "sent_id"]),
        f"{SCORED} SELECT system, sent_id, annotator, correct, proposed, gold FROM counts"),
    "g5_score_single": (_single, f"{_SINGLE} SELECT system, correct, proposed, gold, p, r, f FROM final"),
    "g6_score": (
        _score,
        f"""{_LINES}, totals AS (SELECT system, t.c AS correct, t.p AS proposed, t.g AS gold FROM folded),
            rated AS (SELECT *, {_RATES} FROM totals) SELECT *, {_FINAL} FROM rated"""),
    "g7_line_report": (_report, _REPORT),
    "g8_rates": (
        lambda spark, sf: _counts(spark, sf).select(
            "system", "sent_id", "annotator", rates.precision(F.col("correct"), F.col("proposed")).alias("p"),
            rates.recall(F.col("correct"), F.col("gold")).alias("r"),
            rates.running_f(F.col("correct"), F.col("proposed"), F.col("gold"), 1.0).alias("f")),
        f"""{SCORED} SELECT system, sent_id, annotator, {_RATES}, CASE WHEN gold + proposed = 0
              THEN (CASE WHEN correct = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE ELSE 2.0::DOUBLE * correct / (gold + proposed) END AS f FROM counts"""),
    "g9_sentence_scores": (
        lambda spark, sf: scoring.sentence_scores(hypotheses(spark, sf), gold_rows(spark, sf)),
        f"""{_FIRST}, rated AS (SELECT *, {_RATES} FROM first)
            SELECT system, sent_id, annotator, correct, proposed, gold, p, r, {_FINAL} FROM rated"""),
    "g10_corpus_precision_recall_f": (
        lambda spark, sf: _single(spark, sf).select("system", "p", "r", "f"), f"{_SINGLE} SELECT system, p, r, f FROM final"),
    "g11_score_options": (
        lambda spark, sf: _single(spark, sf, beta=2.0).select("system", "f"),
        f"""{_SINGLE} SELECT system, CASE WHEN 4.0::DOUBLE * p + r = 0 THEN 0.0::DOUBLE
              ELSE 5.0::DOUBLE * p * r / (4.0::DOUBLE * p + r) END AS f FROM final"""),
    "g12_rank_systems": (
        lambda spark, sf: _score(spark, sf).select("system", "correct", "proposed", "gold"),
        f"{_LINES} SELECT system, t.c AS correct, t.p AS proposed, t.g AS gold FROM folded"),
    "g13_gold_profile": (
        lambda spark, sf: scoring.gold_profile(unnest(gold_rows(spark, sf), [], "annotations", "a").select("a.*")),
        f"""{BASE}, listed AS (SELECT 0 AS annotator, op AS etype FROM edit
              UNION ALL SELECT 1, 'sub' FROM edit WHERE op = 'sub' AND i % 32 = 2 AND pos % 3 <> 0
              UNION ALL SELECT 1, 'noop' FROM ops WHERE pos % 3 = 0)
            SELECT annotator, etype, count(*) AS edits FROM listed GROUP BY ALL"""),
    "g13_empty_sets": (
        lambda spark, sf: scoring.empty_sets(unnest(gold_rows(spark, sf), [], "gold", "g").select("g.*")),
        f"""{SCORED} SELECT annotator, count(*) AS sentences, count(*) FILTER (gold = 0) AS empty FROM sets GROUP BY annotator"""),
    "c3_drop_space_and_case_edits": (
        lambda spark, sf: sampling.drop_space_and_case_edits(_token_edits(spark, sf)),
        f"{_TOKEN_EDITS} SELECT * FROM pair WHERE lower(replace(original, ' ', '')) <> lower(replace(correction, ' ', ''))"),
    "c4_drop_unchanged_edits": (
        lambda spark, sf: sampling.drop_unchanged_edits(_token_edits(spark, sf)),
        f"{_TOKEN_EDITS} SELECT * FROM pair WHERE original <> correction"),
    "c5_valid_gold_spans": (
        lambda spark, sf: unnest(gold_rows(spark, sf), ["sent_id", F.size("tokens").alias("n")], "annotations", "a")
        .where(sampling.valid_span(F.col("a.start"), F.col("a.end"), F.col("n"))).groupBy("sent_id").agg(F.count("*").alias("edits")),
        f"""{BASE} SELECT sent_id, all_ + CASE WHEN pos % 3 = 0 THEN 0 ELSE marked END AS edits FROM ops
            WHERE all_ + CASE WHEN pos % 3 = 0 THEN 0 ELSE marked END > 0"""),
    "h1_reward": (
        _reward_formula,
        f"""{BASE} SELECT sent_id, round(CASE WHEN n // 16 = 0 AND all_ = 0 THEN 1.0::DOUBLE
              WHEN n // 16 = 0 THEN {_SIG.format(a="all_")} ELSE 1 - all_::DOUBLE / (n // 16) END, 9) AS reward FROM ops"""),
    "h2_calibrated_sigmoid": (
        lambda spark, sf: sentences(spark, sf).select("sent_id", F.round(
            rates.calibrated_sigmoid(F.length("source")), 9).alias("value")),
        f"{BASE} SELECT sent_id, round(1 / (1 + exp(-(-ln(1.0::DOUBLE / 0.8 - 1) / 5) * len(source))), 9) AS value FROM sent"),
    "h3_split_reward_query": (
        lambda spark, sf: _reward_rows(spark, sf).select("row_id", *(c.alias(n) for c, n in zip(
            prompts.split_reward_query(F.col("query")), ("source", "target")))),
        f"""{BASE}, put AS (SELECT sent_id, i, CASE WHEN op = 'sub' THEN 'zz' || i WHEN op = 'ins' THEN 'yy' || i || ' ' || word
              WHEN op = 'del' THEN NULL ELSE word END AS word FROM known),
            hyp AS (SELECT sent_id, string_agg(word, ' ' ORDER BY i) AS text FROM put GROUP BY sent_id)
            SELECT t.sent_id AS row_id, coalesce(h.text, '') || ' ' AS source, array_to_string(w, ' ') AS target
            FROM tok t LEFT JOIN hyp h ON h.sent_id = t.sent_id"""),
    "h4_reward_table": (
        lambda spark, sf: rewards.reward_table(_reward_rows(spark, sf), ["row_id"]).withColumn("reward", F.round("reward", 9)),
        # words appended right after a replaced last word belong to its edit
        f"""{BASE}, half AS (SELECT sent_id, string_agg(CASE WHEN op = 'sub' THEN 'zz' || i ELSE word END, ' ' ORDER BY i) AS text
              FROM known GROUP BY sent_id),
            n AS (SELECT o.sent_id, all_ AS s, subs + CASE WHEN (n - 1) % 16 = 2 THEN 0 ELSE 1 END AS a, coalesce(text, '') AS text
                  FROM ops o LEFT JOIN half h ON h.sent_id = o.sent_id)
            SELECT sent_id AS row_id, s AS source_edits, a AS output_edits, round(CASE WHEN s = 0 THEN {_SIG.format(a="a")}
              ELSE 1 - a::DOUBLE / s END, 9) AS reward, text || ' qqq x' AS normalized_response FROM n"""),
}
