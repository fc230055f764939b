import random
import re

import pytest

from redpencil.llm import pii

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(number):
    total = 0
    for k, c in enumerate(reversed(number)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
            "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def brute(text):
    spans = [(m.start(), rank, m.end(), kind) for rank, (kind, rule) in enumerate(RULES.items())
             for m in re.finditer(rule, text or "") if valid(kind, m.group())]
    return sorted(spans)


def texts():
    r = random.Random(1)
    bits = ["a", "b.c", "@", "@x", ".", "..", "-", " ", "\n", "+", "+1", "1", "255", "256", "007", "4111 1111 1111 1111", "4111-1111-1111-1111",
            "(202) ", "555", "0123456789", "é", "😀", "_", "%", "mail", "x@y.z", "1.2.3.4", "+44 20 7946 0958", " at ", " dot com"]
    return [None, "", "a" * 20000, "1" * 20000, "1 " * 9000, "+1" * 3000, "a@b" * 3000, "1.2.3.4 " * 300,
            *("".join(r.choice(bits) for _ in range(r.randint(1, 14))) for _ in range(1500))]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts())] + [(None, "me@x.org", "z"), (8, "again@x.org", "z")],
                                 "doc_id long, text string, _base string")


def test_base_spans_equal_brute_force(rows):
    for row in pii.detect(rows).collect():
        assert [tuple(s) for s in row.base] == brute(row._row.text), row._row.text
        assert set(row.base) <= set(row.spans)
        assert all(not (s.start < b.end and b.start < s.end) for s in set(row.spans) - set(row.base) for b in row.base)


def test_redact(spark):
    rows = spark.createDataFrame([(1, "mail me@x.org or +44 20 7946 0958 é", 5), (2, None, 6), (3, "clean", 7), (3, "clean", 7)],
                                 "doc_id long, text string, spans int")
    out = pii.redact(rows)
    assert out.columns == rows.columns
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [
        (1, "mail [email] or [phone] é", 5), (2, None, 6), (3, "clean", 7), (3, "clean", 7)]))
    assert pii.detect(rows.limit(0)).count() == 0


def test_plan_is_native(rows):
    plan = pii.detect(rows)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_trees_add_what_looks_alike(spark):
    """Written-out addresses get selected when the trees have seen enough of both kinds."""
    r = random.Random(3)
    docs = []
    for k in range(1500):
        name = "".join(r.choice("abcdefgh") for _ in range(6))
        docs.append((k, r.choice([f"write to {name}@host.example now", f"see {name} at home for more", f"call +1 202 555 {k:04d} now",
                                  f"version {k} of 2019"]), "z"))
    out = pii.detect(spark.createDataFrame(docs, "doc_id long, text string, z string")).collect()
    for row in out:
        assert [tuple(s) for s in row.base] == brute(row._row.text)
        if "version" in row._row.text or " at home" in row._row.text:
            assert not row.spans


def test_loose_spans_are_added_and_masked(spark):
    """Loose forms of all kinds are masked, however many a corpus holds; numbers and versions are not."""
    r = random.Random(4)

    def card():
        head = "4" + "".join(r.choice("0123456789") for _ in range(14))
        return next(head + c for c in "0123456789" if luhn(head + c))
    docs, loose = [], {}
    for k in range(1200):
        name, n = "".join(r.choice("abcdefgh") for _ in range(6)), card()
        ip = [r.randrange(1, 256) for _ in range(4)]
        strict = [f"write to {name}@host.example now", f"call +1 202 555 {k:04d} now", f"pay by card {n} now", "the server {}.{}.{}.{} answers".format(*ip)]
        other = [("email", f"write to {name} at host dot com now"), ("phone", f"call 1 202 555 {k:04d} now"),
                 ("card", "pay by card " + ".".join(n[i:i + 4] for i in range(0, 16, 4)) + " now"), ("ip", "the server {}[.]{}[.]{}[.]{} answers".format(*ip))]
        none = [f"version {k} of 2019", f"a total of {k + 10**9} units", f"see {name} at home. Then go", f"build 9{k % 100:02d} . 2 . 3 . {k}"]
        form = k % 3
        text = (strict if form == 0 else [t for _, t in other] if form == 1 else none)[k // 3 % 4]
        docs.append((k, text))
        loose[k] = other[k // 3 % 4][0] if form == 1 else None
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x._row.doc_id: x for x in pii.detect(table).collect()}
    masked = {x.doc_id: x.text for x in pii.redact(table).collect()}
    for kind in pii.KINDS:
        own = [k for k, v in loose.items() if v == kind]
        hits = [k for k in own if any(s.kind == kind for s in got[k].spans) and f"[{kind}]" in masked[k]]
        assert not any(got[k].base for k in own) and len(hits) >= 0.9 * len(own), (kind, len(hits), len(own))
    assert [(t, got[k].spans) for k, t in docs if k % 3 == 2 and got[k].spans] == []


def test_rare_kind_among_many_digit_runs(spark):
    """Thresholds rest on all rows, so a kind that a few documents hold is judged in a table full of numbers."""
    docs = [(k, f"a total of {10**9 + k * 7919} units and {10**11 + k * 104729} more") for k in range(9000)]
    docs += [(10**6 + k, f"write to user{k}@host.example now") for k in range(12)] + [(2 * 10**6, "write to someone at host dot com now")]
    got = pii.detect(spark.createDataFrame(docs, "doc_id long, text string")).where("_row.doc_id = 2000000").head()
    assert [s.kind for s in got.spans] == ["email"]


def test_long_texts_of_many_matches(spark):
    """Places, contexts and cuts beyond one block of matches and one piece of text; overlaps and ties among them."""
    r = random.Random(6)
    parts = ["call +44 20 7946 0958 now", "é😀", "me@x.org", "1.2.3.4", "4111 1111 1111 1111", "+1 (202) 555 0123 4111-1111-1111-1111", "w" * 700, "x@y.z 1.1.1.1"]
    docs = [(k, " ".join(r.choice(parts) for _ in range(n))) for k, n in enumerate([1, 47, 48, 49, 97, 500, 3000])]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    found = {x._row.doc_id: x for x in pii.detect(table).collect()}
    masked = {x.doc_id: x.text for x in pii.redact(table).collect()}
    for k, text in docs:
        assert [tuple(s) for s in found[k].base] == brute(text)
        out, at = "", 0
        for s in found[k].spans:
            if s.start >= at:
                out += text[at:s.start] + f"[{s.kind}]"
            at = max(at, s.end)
        assert masked[k] == out + text[at:]


def test_free_spans(spark):
    """Which spans touch no base span, against all pairs."""
    r = random.Random(7)

    def spans(n):
        return [(a, 0, a + r.randrange(1, 9), "ip") for a in (r.randrange(300) for _ in range(n))]
    rows = [(spans(r.choice([0, 1, 60, 130])), sorted(spans(r.choice([0, 1, 5, 20])))) for _ in range(40)]
    df = spark.createDataFrame(rows, f"more {pii.SPAN}, base {pii.SPAN}")
    out = df.select("more", "base", pii.with_free(df.more, df.base).alias("free")).collect()
    for row in out:
        expected = [not any(m.start < b.end and b.start < m.end for b in row.base) for m in row.more]
        assert [f.free for f in row.free or []] == expected


def test_loose_phones(spark):
    r = random.Random(8)
    docs, planted = [], {}
    for k in range(900):
        n = [f"{r.randrange(2, 9)}{r.randrange(10**9):09d}" for _ in range(2)][0]
        spaced, dashed = f"{n[:3]} {n[3:6]} {n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}"
        text = [f"call me on +44 {spaced}", f"tel +1 {dashed}", f"a total of {n} units", f"since version {n[0]}.{n[1]}.{n[2]}", f"call me on 0044 {spaced}", f"Phone: {dashed}"][k % 6]
        docs.append((k, f"some words before. {text} and after"))
        if k % 6 > 3:
            planted[k] = k % 6
    got = {x._row.doc_id: x.spans for x in pii.detect(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for form in (4, 5):
        own = [k for k, f in planted.items() if f == form]
        # one number in ten of 14 digits is also a card by the base rules, which stay
        assert sum(any(s.kind in ("phone", "card") for s in got[k]) for k in own) >= 0.9 * len(own)
        assert sum(any(s.kind == "phone" for s in got[k]) for k in own) >= 0.8 * len(own)
    assert not any(got[k] for k, _ in docs if k % 6 in (2, 3))
