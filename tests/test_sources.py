"""Files in and out: numbering, quoting, gold blocks, essays."""

import gzip

import pytest
from pyspark.sql import functions as F

from redpencil.session import SPREAD, materialize, shared_dir, spread
from redpencil.operators.edits import with_edits
from redpencil.sources import essays, gold, lines


def test_sentences_keep_order_over_files(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"part-{k:02d}.txt").write_text("".join(f" s{k}-{i} \n" for i in range(50 - 4 * k)) + "\n")
    got = [r.text for r in lines.read_sentences(spark, str(tmp_path)).orderBy("sent_id").collect()]
    assert got == [x for k in range(12) for x in [f"s{k}-{i}" for i in range(50 - 4 * k)] + [""]]


def test_numbering_over_splits_of_one_file(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"line {i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = lines.read_sentences(spark, str(path))
        assert rows.rdd.getNumPartitions() > 3
        assert rows.where("text <> concat('line ', sent_id)").count() == 0 and rows.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_gzip_and_round_trip(spark, tmp_path):
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress("x y\n\n  z \n".encode()))
    rows = lines.read_sentences(spark, str(tmp_path / "a.txt.gz"))
    assert [r.text for r in rows.orderBy("sent_id").collect()] == ["x y", "", "z"]
    out = str(tmp_path / "out")
    lines.write_sentences(rows.withColumn("text", F.replace("text", F.lit(" "), F.lit("\n"))), out, single_file=True)
    assert [r.text for r in lines.read_sentences(spark, out).orderBy("sent_id").collect()] == ["x y", "", "z"]


def test_parallel_text(spark, tmp_path):
    (tmp_path / "c.tsv").write_text('He said "hi\tHe said "hi" .\n# x\\y\tNA\nonly source\t\n spaced \tnull\n')
    got = [tuple(r)[1:] for r in lines.read_parallel(spark, str(tmp_path / "c.tsv")).orderBy("pair_id").collect()]
    assert got == [('He said "hi', 'He said "hi" .'), ("# x\\y", "NA"), ("only source", None), (" spaced ", "null")]


def test_blocks(spark, tmp_path):
    (tmp_path / "b.txt").write_text("\n\na\nb\n\n\n\nc\n\nd")
    got = [tuple(r) for r in lines.read_blocks(spark, str(tmp_path / "b.txt")).orderBy("block_id").collect()]
    assert got == [(0, "a\nb"), (1, "c"), (2, "d")]


GOLD = """S a b c
A 0 1|||X|||A||  AA |||REQUIRED|||-NONE-|||1
I ignored
A 2 3|||Y||||||REQUIRED|||note|||1
A 1 1|||noop|||x|||REQUIRED|||-NONE-|||0


S plain one

S d e
S f
A 0 1|||X|||-NONE-|||REQUIRED|||-NONE-|||0
A 2 3|||X|||F|||REQUIRED|||-NONE-|||0
"""


def test_gold_rules(spark, tmp_path):
    (tmp_path / "g").write_text(GOLD)
    read = gold.read_gold(spark, str(tmp_path / "g"))
    assert [r.source for r in read.sentences.orderBy("sent_id").collect()] == ["a b c", "plain one", "d e", "f"]
    edits = [tuple(r) for r in read.edits.where("sent_id = 0").orderBy("edit_pos").collect()]
    assert edits[0] == (0, 1, 0, 0, 1, "X", "a", ["A", "AA"], "REQUIRED", "-NONE-")
    assert edits[1][3:8] == (2, 3, "Y", "c", [""]) and edits[2][1:6] == (0, 2, -1, -1, "noop")
    sets = {(r.sent_id, r.annotator): [(e.start, e.end, e.original) for e in r.edits] for r in read.sets.collect()}
    assert sets == {(0, 0): [], (0, 1): [(0, 1, "a"), (2, 3, "c")], (1, 0): [],
                    (2, 0): [(0, 1, "d")], (3, 0): [(0, 1, "d"), (2, 3, "f")]}


@pytest.mark.parametrize("bad", ["A 0 1|||X|||y|||R|||-|||0\n", "S a\nB odd line\n"])
def test_bad_blocks_fail(spark, tmp_path, bad):
    (tmp_path / "g").write_text(bad)
    with pytest.raises(Exception, match="not a gold block"):
        gold.read_gold(spark, str(tmp_path / "g")).edits.collect()


def test_gold_round_trip_and_edits_table(spark, tmp_path):
    (tmp_path / "g").write_text(GOLD.split("S d e")[0])
    read = gold.read_gold(spark, str(tmp_path / "g"))
    gold.write_gold(read, str(tmp_path / "out"))
    again = gold.read_gold(spark, str(tmp_path / "out"))
    columns = ["sent_id", "annotator", "start", "end", "etype", "original", "corrections"]
    key = lambda g: sorted(map(tuple, g.edits.select(*columns).collect()), key=repr)
    assert key(again) == key(read)
    built = gold.gold_from_edits(read.sentences.select("sent_id", "source"), read.edits)
    order = lambda g: sorted(map(tuple, g.sets.collect()), key=repr)
    assert order(built) == order(read)


def test_edit_file(spark, tmp_path):
    pairs = spark.createDataFrame([(0, "a b c", "a x"), (1, "same", "same")], "sent_id long, source string, hypothesis string")
    gold.write_edits(with_edits(pairs), str(tmp_path / "m"), with_target=True, single_file=True)
    text = next((tmp_path / "m").glob("part-*")).read_text()
    assert text == "S a b c\nT a x\nA 1 3|||UNK|||x|||REQUIRED|||-NONE-|||0\n\nS same\nT same\n\n"


def test_essays_that_are_no_clean_markup(spark, tmp_path):
    (tmp_path / "e.sgml").write_text("""<DOC nid="1" place="Q &amp; A"><TEXT><P>rock & roll, R&D</P></TEXT></DOC>
<DOC nid="2"><TEXT><P>never closed</TEXT></DOC>
<DOC nid="3"><TEXT><P>fine</P></TEXT></DOC>
""")
    rows = sorted(essays.read_essays(spark, str(tmp_path / "e.sgml")).collect(), key=lambda r: r.attrs["nid"])
    assert [r.attrs["nid"] for r in rows] == ["1", "2", "3"] and rows[0].attrs["place"] == "Q &amp; A"
    assert rows[0].paragraphs == ["rock & roll, R&D"] and rows[2].paragraphs == ["fine"]
    assert [r.error is None for r in rows] == [True, False, True]


def test_essays(spark, tmp_path):
    (tmp_path / "e.sgml").write_text("""<DOC nid="7">
<MATRIC>M1</MATRIC><EMAIL>e@x</EMAIL><NATIONALITY>N</NATIONALITY>
<TEXT>
<TITLE>
The title
</TITLE>
<P>
First  par

</P>
<P>Second &amp; last</P>
</TEXT>
<ANNOTATION teacher_id="3">
<MISTAKE start_par="1" start_off="0" end_par="1" end_off="5"><TYPE>Mec</TYPE><CORRECTION>1st</CORRECTION></MISTAKE>
<MISTAKE start_par="2" start_off="1" end_par="2" end_off="2"><TYPE>Vt</TYPE><CORRECTION></CORRECTION><COMMENT>why</COMMENT></MISTAKE>
</ANNOTATION>
</DOC>
<DOC nid="8"><TEXT><TITLE>T</TITLE></TEXT></DOC>
""")
    read = essays.read_essays(spark, str(tmp_path / "e.sgml"))
    paragraphs = [tuple(r) for r in essays.essay_paragraphs(read).orderBy("doc_id", "par").collect()]
    assert paragraphs == [(7, 0, "The title"), (7, 1, "First  par\n"), (7, 2, "Second & last"), (8, 0, "T")]
    mistakes = [tuple(r)[:7] for r in essays.essay_mistakes(read).orderBy("start_par").collect()]
    assert mistakes == [(7, 3, 1, 0, 1, 5, "Mec"), (7, 3, 2, 1, 2, 2, "Vt")]
    profile = essays.essay_profiles(read).where("doc_id = 7").first()
    assert (profile.matric, profile.email, profile.nationality) == ("M1", "e@x", "N")


def test_shared_folder_and_datasets(spark, tmp_path):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    df = spark.range(5)
    assert materialize(df, "t").count() == 5
    lines.save_dataset(df, str(tmp_path / "d"))
    assert lines.load_dataset(spark, str(tmp_path / "d")).count() == 5
    one = lines.load_dataset(spark, str(tmp_path / "d")).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == 1
    spark.conf.set(SPREAD, "true")
    try:
        assert spread(one).rdd.getNumPartitions() == 4
    finally:
        spark.conf.unset(SPREAD)
