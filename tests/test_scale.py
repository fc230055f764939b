"""Work that must not be repeated: expressions computed once a row, rules skipped, lattices given up before walks are listed."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from redpencil.functions.sequences import shrink
from redpencil.functions.tokenizer import ptb_tokens
from redpencil.operators import alignment, scoring
from redpencil.plans.inputs import sentences
from redpencil.sources import gold as gold_files

EDIT = "array<struct<start:int,end:int,original:string,correction:string>>"
GOLD = "array<struct<start:int,end:int,original:string,corrections:array<string>>>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shrink_compares_each_side_once(spark):
    text = plan(spark.range(1).select(shrink(F.lit(0), F.col("id").cast("int"), F.col("id").cast("string"), F.col("id").cast("string")).alias("r")))
    assert text.count("zip_with(") == 2


def test_tokenizer_rules_wait_for_their_character(spark):
    df = spark.createDataFrame([("a/b c--d e...f 1,2 it's 'x' y|z end.",), ("plain words",), (None,)], "t string")
    assert plan(df.select(ptb_tokens(F.col("t")).alias("r"))).count("Contains(") == 6
    assert [r[0] for r in df.select(ptb_tokens(F.col("t"))).collect()] == [
        "a / b c -- d e ... f 1,2 it 's ' x ' y -PIPE- z end .".split(), ["plain", "words"], None]


def test_ordered_matches_look_up_single_places(spark):
    spans = [(k, k + 1, f"w{k}", f"v{k}") for k in range(6)]
    df = spark.createDataFrame([
        (spans, [(a, b, o, [c, "other"]) for a, b, o, c in spans if a != 3]),                 # one missing
        (spans[:2], [(0, 1, "w0", ["v0"]), (0, 1, "w0", ["v0"]), (1, 2, "w1", ["x"])]),       # a repeated gold edit counts again
        (spans[:3][::-1], [(a, b, o, [c]) for a, b, o, c in spans[:3]]),                      # never steps back
        ([], []), (None, [])], f"e {EDIT}, g {GOLD}")
    found = df.select(scoring.matched_in_order(F.col("e"), F.col("g")).alias("m"))
    assert "array_position(" in plan(found)
    assert [None if r.m is None else [x.start for x in r.m] for r in found.collect()] == [[0, 1, 2, 4, 5], [0, 0], [2], [], None]


def test_no_walks_are_listed_where_they_are_too_many(monkeypatch):
    src = ["a"] * 400
    hyp = ["a" if k % 8 else "z" for k in range(400)]
    monkeypatch.setattr(alignment, "_arcs", None)
    gold = pa.nulls(1, pa.list_(pa.list_(pa.struct([
        ("start", pa.int32()), ("end", pa.int32()), ("corrections", pa.list_(pa.string()))]))))
    monkeypatch.setattr(alignment, "SPARSE_WORK", 5000)
    (edits,), = alignment.align_batch(pa.array([src]), pa.array([hyp]), gold, 0, (1, 2)).to_pylist()
    rebuilt, at = [], 0
    for e in edits:
        rebuilt += src[at:e["start"]] + hyp[e["hyp_start"]:e["hyp_end"]]
        at = e["end"]
    assert rebuilt + src[at:] == hyp


def test_short_lattices_are_shared_between_batches():
    tokens = lambda words: pa.array([words.split()])
    gold = pa.nulls(1, pa.list_(pa.list_(pa.struct([
        ("start", pa.int32()), ("end", pa.int32()), ("corrections", pa.list_(pa.string()))]))))
    alignment.align_batch(tokens("p q r s"), tokens("p x r s"), gold, 0, (1, 2))
    before = alignment._shared_shape.cache_info().misses
    (edits,), = alignment.align_batch(tokens("k l m n"), tokens("k y m n"), gold, 0, (1, 2)).to_pylist()
    assert alignment._shared_shape.cache_info().misses == before and [tuple(e.values()) for e in edits] == [(1, 2, 1, 2)]


def test_ranks_before_the_first_gold_edit_are_kept(monkeypatch):
    """The nodes that are ranked again begin at the end of the first arc that a gold edit changes."""
    begun, rank = [], alignment._rank
    monkeypatch.setattr(alignment, "_rank", lambda found, ranks, *rest: (begun.append((len(ranks), len(found))), rank(found, ranks, *rest)))
    src = [f"w{k}" for k in range(200)]
    hyp = ["x" if k in (20, 150) else w for k, w in enumerate(src)]
    gold = pa.array([[[], [{"start": 150, "end": 151, "corrections": ["x"]}]]], pa.list_(pa.list_(pa.struct([
        ("start", pa.int32()), ("end", pa.int32()), ("corrections", pa.list_(pa.string()))]))))
    (sets,) = alignment.align_batch(pa.array([src]), pa.array([hyp]), gold, 0, (1, 2)).to_pylist()
    assert [[(e["start"], e["end"]) for e in edits] for edits in sets] == [[(20, 21), (150, 151)]] * 2
    assert begun[0][0] == 1 and len(begun) == 2 and begun[1][0] > 150


def test_distances_of_all_costs_need_no_matrix(monkeypatch):
    monkeypatch.setattr(alignment, "_forward", None)
    pairs = [("a b c d", "a x c d"), ("a b c", "b c a"), ("", "a b"), ("a a b a", "a b a a a"), ("p q r s t u", "u t s r q p"), ("a", "a")]
    left, right = (pa.array([p[k].split() for p in pairs] + [None], pa.list_(pa.string())) for k in (0, 1))
    found = {cost: alignment.distance_batch(left, right, cost).to_pylist() for cost in (0, 1, 2, 3)}
    assert found == {0: [0, 0, 2, 1, 0, 0, None], 1: [1, 2, 2, 2, 6, 0, None], 2: [2, 2, 2, 3, 10, 0, None], 3: [2, 2, 2, 3, 10, 0, None]}


def test_distances_in_bits_and_bands_agree(monkeypatch):
    left = pa.array([[f"w{k * k % 7}" for k in range(n)] for n in range(30)])
    right = pa.array([[f"w{k * k * k % 5}" for k in range(31 - n)] for n in range(30)])
    in_bits = [alignment.distance_batch(left, right, cost).to_pylist() for cost in (0, 1, 2, 5)]
    monkeypatch.setattr(alignment, "BIT_TOKENS", 2)
    assert [alignment.distance_batch(left, right, cost).to_pylist() for cost in (0, 1, 2, 5)] == in_bits


def test_blocks_are_made_once_for_a_sorted_file(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def text(k):
        made.add(1)
        return f"s {k}"
    named = F.udf(text, "string").asNondeterministic()
    rows = spark.range(40).select(F.col("id").alias("sent_id"), named("id").alias("source"), F.lit("t").alias("hypothesis"),
                                  F.array().cast(EDIT).alias("edits"))
    gold_files.write_edits(rows, str(tmp_path / "m"))
    assert made.value == 40
    assert [r.source for r in gold_files.read_gold(spark, str(tmp_path / "m")).sentences.orderBy("sent_id").collect()] == [
        f"s {k}" for k in range(40)]


def test_annotation_lines_are_cut_once(spark, tmp_path):
    (tmp_path / "g.m2").write_text("S a b c\nA 0 1|||sub|||x||y|||REQUIRED|||-NONE-|||0\nA -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||1\n\n")
    read = gold_files.read_gold(spark, str(tmp_path))
    assert plan(read.rows).count("split(substring(") == 1
    assert [tuple(r)[1:] for r in read.edits.orderBy("edit_pos").collect()] == [
        (0, 0, 0, 1, "sub", "a", ["x", "y"], "REQUIRED", "-NONE-"), (1, 1, -1, -1, "noop", "", [""], "REQUIRED", "-NONE-")]


def test_sentences_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    texts = ["a b. c\nd", None, "", "a b. c\nd"] * 20                # ids and texts repeat, some are null
    docs = pa.table({"doc_id": pa.array([None if k % 7 == 0 else k % 9 for k in range(80)], pa.int64()),
                     "text": pa.array(texts), "lang": pa.array(["en"] * 80), "source": pa.array(["s"] * 80), "n_chars": pa.array([1] * 80)})
    pq.write_table(docs, tmp_path / "documents.parquet")
    rows = sentences(spark, str(tmp_path))
    sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(sizes) == 120 and sum(n > 0 for n in sizes) >= 4
    assert sorted({r.source for r in rows.collect()}) == ["a b", "c", "d"]
