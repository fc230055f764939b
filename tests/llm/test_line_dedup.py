import random

from pyspark.sql import functions as F

from redpencil.llm import line_dedup


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def brute(docs, min_chars=line_dedup.MIN_CHARS):
    lines = [(d, k, line.strip(" \t\r")) for d, text in docs for k, line in enumerate((text or "").split("\n")) if text is not None]
    order = sorted((x for x in lines if x[0] is not None and x[2]))
    out = []
    for d, k, body in lines:
        of = None
        if d is not None and body:
            for e, j, other in order:
                if (e, j) >= (d, k):
                    break
                close = within_one(body, other) if min(len(body), len(other)) >= min_chars else body == other
                if close:
                    of = (e, j, int(body != other))
                    break
        out.append((d, k, of is None, *(of or (None, None, None))))
    return sorted(out, key=str)


def edited(r, line):
    k = r.randrange(len(line) + 1)
    return line[:k] + r.choice(["", "é", "x", "😀"]) + line[k + r.choice([0, 1]):]


def corpus():
    r = random.Random(1)
    words = ["alpha", "beta", "gämma", "delta", "ο", "a", "aa"]
    base = [" ".join(r.choice(words) for _ in range(r.choice([1, 4, 8, 60, 300]))) for _ in range(30)]
    docs = [(None, base[0] + "\n" + base[1]), (90, None), (91, ""), (92, "\n\n"), (-3, base[2])]
    for d in range(60):
        lines = []
        for _ in range(r.randint(1, 6)):
            line = r.choice(base)
            for _ in range(r.choice([0, 1, 1, 2])):
                line = edited(r, line)
            lines.append(r.choice(["", " ", "\t"]) + line + r.choice(["", "\r"]))
        docs.append((d, "\n".join(lines)))
    docs += [(200 + k, "a" * (40 + k % 3)) for k in range(9)] + [(300, "x" * 3000), (301, "x" * 1500 + "y" + "x" * 1500)]
    return docs


def test_equals_brute_force(spark):
    docs = corpus()
    rows = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, body string")
    out = [tuple(r) for r in line_dedup.repeated_lines(rows).select(
        "doc_id", "line_no", "kept", "of_doc_id", "of_line_no", "edits").collect()]
    assert sorted(out, key=str) == brute(docs)
    other = [tuple(r) for r in line_dedup.repeated_lines(rows, min_chars=6).select(
        "doc_id", "line_no", "kept", "of_doc_id", "of_line_no", "edits").collect()]
    assert sorted(other, key=str) == brute(docs, 6)


def test_sieve_lets_all_wanted_pass(spark):
    rows = spark.range(-5000, 5000).select(F.xxhash64("id").alias("k"), "id")
    kept = line_dedup.sieved(rows, "k", line_dedup.sieve(rows.where("id % 100 = 0"), "k"))
    found = {r.id for r in kept.collect()}
    assert set(range(-5000, 5000, 100)) <= found and len(found) < 110
    assert line_dedup.sieved(rows, "k", line_dedup.sieve(rows.limit(0), "k")).count() == 0


def test_documents_without_their_lines(spark):
    docs = [*corpus(), (91, "")]
    rows = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, _gone string")
    drop = {(d, k) for d, k, kept, *_ in brute(docs) if not kept}
    expected = []
    for d, t in docs:
        lines = (t or "").split("\n")
        left = [x for k, x in enumerate(lines) if (d, k) not in drop]
        if len(left) == len(lines):
            expected.append((d, t, "z"))
        elif any(x.strip(" \t\r") for x in left):
            expected.append((d, "\n".join(left), "z"))
    out = line_dedup.drop_repeated_lines(rows)
    assert out.columns == rows.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted(expected, key=str)


def test_empty_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "same line of text here"), (1, "same line of text here")], "doc_id long, text string")
    assert [r.kept for r in line_dedup.repeated_lines(rows).collect()] == [True, True]
    assert line_dedup.repeated_lines(rows.limit(0)).count() == 0
