"""The operators of this subpackage as registered queries: name -> (Spark query, equivalent SQL or None)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from redpencil.llm import (collocations, embedding_join, gated_lm, line_dedup, maxscore, negative_tree, odd_sketch, packing, pii,
                           sentencepiece_codec, sharding, toxicity, warc)
from redpencil.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    model = tokenizer_path("piece_bpe_32k.model")
    rows = table(spark, sf_dir, "documents").select("doc_id", sentencepiece_codec.encode("text", model).alias("ids"))
    rows = rows.withColumn("decoded", sentencepiece_codec.decode("ids", model))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of a label at a cosine of 0.93."""
    return embedding_join.near_vectors(table(spark, sf_dir, "embeddings"))


# Vectors that are null, empty, zero or not finite throughout link with nothing.
OP3 = """WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda c: c * c))) AS norm FROM v
  WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
link AS (SELECT a.vec_id AS p, b.vec_id AS q FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / a.norm / b.norm >= 0.93),
reach AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT r.vec_id, l.q FROM reach r JOIN link l ON l.p = r.other)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE p = v.vec_id) AS n_links, r.component_id, r.component_id = v.vec_id AS kept
FROM v JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) r ON v.vec_id = r.vec_id"""


def op4_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over two-word shingles at a similarity of 0.8."""
    return odd_sketch.near_duplicates(table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pii.detect(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.KINDS]
    return rows.select(F.col("_row.doc_id").alias("doc_id"), *counts, F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
                       pii.span_text(F.col("spans")).alias("spans"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), keep_ids=False)
    return pieces.drop("ids")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, by a model of the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.score(docs, model).select("doc_id", F.col("toxicity.score").alias("score"))
    return rows.select("doc_id", (~toxicity.in_training(F.col("doc_id"))).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))


SHARDS = 40


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all documents, with the earliest equal or nearly equal line."""
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


TOP = 20


def op10_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best other vectors of every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings")
    whole = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("embedding IS NOT NULL").where(whole).select("vec_id", maxscore.integers(F.col("embedding")).alias("embedding"))
    return maxscore.top_k(rows, rows.where("vec_id % 20 = 0"), TOP)


OP10 = """WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda c: floor(c * 64)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


# One edit in lines of m characters, or m and one more, leaves the first or the last m // 2 characters alone.
OP9_LINES = """lines AS (
  SELECT doc_id, line_no, body, CASE WHEN doc_id IS NOT NULL AND body <> '' THEN
         doc_id::HUGEINT * 10000000000 + line_no END AS place
  FROM (SELECT doc_id, (k - 1)::INTEGER AS line_no, trim(line, ' ' || chr(9) || chr(13)) AS body FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS k FROM {docs}))),
firsts AS (SELECT body, min(place) AS first, length(body) AS n FROM lines WHERE place IS NOT NULL GROUP BY body),
halves AS (
  SELECT body, n, first, unnest(['p' || m || left(body, m // 2), 's' || m || right(body, m // 2)]) AS half
  FROM (SELECT *, unnest([n, n - 1]) AS m FROM firsts WHERE n >= 20) WHERE m >= 20),
met AS (SELECT DISTINCT x.body, x.n, y.body AS other, y.n AS other_n, y.first AS near
  FROM halves x JOIN halves y ON x.half = y.half AND y.first < x.first AND x.body <> y.body),
close AS (SELECT body, min(near) AS near FROM met WHERE CASE
    WHEN n = other_n THEN len(list_filter(range(n), lambda p: body[p + 1] <> other[p + 1])) = 1
    WHEN n = other_n + 1 THEN len(list_filter(range(n), lambda p: left(body, p) || substr(body, p + 2) = other)) > 0
    WHEN n + 1 = other_n THEN len(list_filter(range(other_n), lambda p: left(other, p) || substr(other, p + 2) = body)) > 0
    ELSE false END GROUP BY body),
found AS (
  SELECT l.doc_id, l.line_no, CASE WHEN least(near, first) < place THEN least(near, first) END AS of_place, first
  FROM lines l LEFT JOIN firsts f ON l.body = f.body AND l.place IS NOT NULL LEFT JOIN close c ON f.body = c.body)"""
OP9 = f"""WITH {OP9_LINES.format(docs='documents')}
SELECT doc_id, line_no, of_place IS NULL AS kept, (of_place // 10000000000)::BIGINT AS of_doc_id,
       (of_place % 10000000000)::INTEGER AS of_line_no,
       CASE WHEN of_place = first THEN 0 WHEN of_place IS NOT NULL THEN 1 END::INTEGER AS edits FROM found"""

def op11_negative_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for the positives of every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL")
    whole = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where(whole).select(F.col("vec_id").alias("id"), label.alias("label"), maxscore.integers(F.col("embedding"), 256).alias("vector"))
    found = negative_tree.hard_negatives(rows, F.col("id") % 50 == 0)
    return found.withColumn("rank", F.col("rank").cast("int"))


OP11 = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding::DOUBLE[], lambda c: floor(c * 256)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.x, c.x)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def op12_gated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-likelihoods of all documents, by word counts and by the recurrent model."""
    return gated_lm.score(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language of all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP13 = """WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS place, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS words
  FROM (SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents)),
total AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS p FROM pieces),
grams AS (SELECT lang, k, words[p:p + k - 1] AS phrase FROM starts, (VALUES (1), (2), (3), (4)) s(k) WHERE p + k - 1 <= len(words)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, l.k AS cut,
    ((2000000::HUGEINT * c.f) // (l.f + r.f))::BIGINT AS score
  FROM f c JOIN f l ON l.lang = c.lang AND l.k < c.k AND l.phrase = c.phrase[:l.k]
    JOIN f r ON r.lang = c.lang AND r.k = c.k - l.k AND r.phrase = c.phrase[l.k + 1:]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM scored s WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.lang = s.lang AND g.k > len(s.phrase) AND 100 * g.f >= 80 * s.a
    AND len(list_filter(range(1, g.k - len(s.phrase) + 2), lambda i: g.phrase[i:i + len(s.phrase) - 1] = s.phrase)) > 0)),
ranked AS (SELECT *, array_to_string(phrase, ' ') AS joined FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(joined)) AS rank, joined AS phrase, a, l, r, n, score
FROM ranked JOIN total USING (lang) QUALIFY rank <= 2000"""

QUERIES = {
    "op1_sentencepiece": (op1_sentencepiece, None),
    "op2_warc": (op2_warc, None),
    "op3_subspace_join": (op3_subspace_join, OP3),
    "op4_odd_sketch": (op4_odd_sketch, None),
    "op5_pii": (op5_pii, None),
    "op6_packing": (op6_packing, None),
    "op7_toxicity": (op7_toxicity, None),
    "op8_sharding": (op8_sharding, None),
    "op9_line_dedup": (op9_line_dedup, OP9),
    "op10_maxscore": (op10_maxscore, OP10),
    "op11_negative_tree": (op11_negative_tree, OP11),
    "op12_gated_lm": (op12_gated_lm, None),
    "op13_collocations": (op13_collocations, OP13),
}
