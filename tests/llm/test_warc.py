import base64
import hashlib

from pyspark.sql import functions as F

from redpencil.llm import warc
from redpencil.session import new_path


def test_surt():
    assert warc.surt("https://www.Example.com:8080/a/b?q=1#x") == "com,example,www:8080)/a/b?q=1"
    assert warc.surt("http://example.com") == "com,example)/" and warc.surt(None) == ")/"
    assert warc.surt("http://[bad") == ")/http://[bad"


def test_record_round_trip():
    headers, payload = warc.parse(warc.record(5, "http://ä/\r\nx", b"a\r\n\r\nb", "D", None))
    assert payload == b"a\r\n\r\nb" and warc._text(headers["warc-target-uri"]) == "http://ä/\r\nx"
    headers, payload = warc.parse(warc.record(5, None, b"zz", "D", (7, "u")))
    assert payload == b"" and warc.page_of(headers["warc-refers-to"]) == 7 and headers["warc-type"] == "revisit"


def expected(rows):
    last = {}
    for page, _, html in rows:
        if page is not None:
            last[html or ""] = max(page, last.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        of = last.get(html or "")
        revisit = of is not None and of != page
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", of if revisit else None))
    return sorted(out, key=str)


def pages():
    rows = [(k, f"http://h{k % 7}.example.com/p{k % 11}", f"<p>é {k % 13}</p>\r\n\r\n") for k in range(200)]
    rows += [(1000, None, None), (1001, "", ""), (1002, "http://x/", None), (None, "http://x/", "own"), (None, "http://x/", "<p>é 1</p>\r\n\r\n"),
             (5, "http://h5.example.com/p5", "<p>é 5</p>\r\n\r\n"), (1003, "http://x/", "long " * 400000), (1004, "http://y/", "long " * 400000)]
    return rows


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES_PER_BLOCK", 7)
    rows = pages()
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    out = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    assert out == expected(rows)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_index_finds_every_capture(spark, monkeypatch):
    monkeypatch.setattr(warc, "LINES_PER_BLOCK", 5)
    df = spark.createDataFrame([(k, f"http://h{k % 3}.org/same", f"text {k}") for k in range(120)], "page_id long, url string, html string")
    folder = new_path(spark, "test-warc")
    captures = warc.write_archives(df, f"{folder}/a")
    index = warc.build_index(captures, f"{folder}/i")
    found = warc.look_up(captures.union(captures.withColumn("key", F.lit("org,zz)/"))), index)
    assert sorted((r.page_id, r.file, r.offset) for r in found.collect()) == sorted((r.page_id, r.file, r.offset) for r in captures.collect())
    texts = {r.page_id: bytes(r.payload).decode() for r in warc.read_ranges(found).collect()}
    assert texts == {k: f"text {k}" for k in range(120)}
    assert {r.page_id for r in warc.read_archives(captures.select("file").distinct()).collect()} == set(range(120))
