"""The alignment kernel against exhaustive search on small pairs."""

import random
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edit_model import choose
from redpencil.operators import alignment
from redpencil.operators.alignment import align_batch, distance_batch
from redpencil.operators.edits import edit_count, extract_edits, with_edits, zip_lines

TOKENS = pa.list_(pa.string())
GOLD = pa.list_(pa.list_(pa.struct(
    [("start", pa.int32()), ("end", pa.int32()), ("corrections", pa.list_(pa.string()))])))


def spans(src, hyp, gold_sets=None, keep=2, costs=(1, 2)):
    listed = None if gold_sets is None else [
        [{"start": a, "end": b, "corrections": list(alts)} for a, b, *alts in g] for g in gold_sets]
    out = align_batch(pa.array([src], TOKENS), pa.array([hyp], TOKENS), pa.array([listed], GOLD), keep, costs)
    return [[(e["start"], e["end"], e["hyp_start"], e["hyp_end"]) for e in row] for row in out.to_pylist()[0]]


def cheapest_edges(src, hyp, sub):
    """Edges of all cheapest paths, by plain recursion from both ends."""
    n, m = len(src), len(hyp)

    def nexts(i, j):
        if i < n and j < m:
            yield i + 1, j + 1, 0 if src[i] == hyp[j] else sub, src[i] != hyp[j]
        if i < n:
            yield i + 1, j, 1, True
        if j < m:
            yield i, j + 1, 1, True

    @lru_cache(None)
    def to_end(i, j):
        return 0 if (i, j) == (n, m) else min(c + to_end(a, b) for a, b, c, _ in nexts(i, j))
    edges, seen, todo = {}, set(), [(0, 0)]
    while todo:
        v = todo.pop()
        if v in seen:
            continue
        seen.add(v)
        for a, b, c, change in nexts(*v):
            if c + to_end(a, b) == to_end(*v):
                edges[v, (a, b)] = change
                todo.append((a, b))
    return edges


def cost_by_sequence(src, hyp, gold, keep, costs):
    """Every possible span sequence with its least (-gold edits, other steps, charges)."""
    layers = [cheapest_edges(src, hyp, c) for c in costs]
    change = {e: x for layer in layers for e, x in layer.items()}
    charge = {e: sum(e in layer for layer in layers) for e in change}
    end = (len(src), len(hyp))

    def edits_from(v):
        """(goal, steps, charge, has change) of every edit or kept step that starts at v."""
        todo = [(w, 1, 0 if change[v, w] else 1, change[v, w], charge[u, w] if change[u, w] else 0)
                for u, w in change if u == v]
        while todo:
            w, steps, kept, changed, fee = todo.pop()
            if steps == 1 or changed:
                yield w, steps, fee, changed
            for x, y in change:
                if x == w and kept + (not change[x, y]) <= keep:
                    todo.append((y, steps + 1, kept + (not change[x, y]), changed or change[x, y], 1))

    @lru_cache(None)
    def best(v):
        if v == end:
            return {(): (0, 0, 0)}
        table = {}
        for w, steps, fee, changed in set(edits_from(v)):
            here = ((v[0], w[0], v[1], w[1]),) if changed else ()
            hit = changed and any((v[0], w[0]) == (a, b) and tuple(hyp[v[1]:w[1]]) in alts for a, b, alts in gold)
            for rest, (g, s, f) in best(w).items():
                cost = (g - 1, s, f) if hit else (g, s + steps, f + fee)
                if cost < table.get(here + rest, (1, 0, 0)):
                    table[here + rest] = cost
        return table
    return best((0, 0))


def random_case(rnd):
    """A dense pair, or one of mostly kept tokens, with gold of all kinds, insertions and repeats among it."""
    words = [f"w{k}" for k in range(rnd.choice([2, 3, 6, 12]))]
    pick = lambda n: [rnd.choice(words) for _ in range(n)]
    if rnd.random() < .5:
        src, hyp = pick(rnd.randint(0, 6)), pick(rnd.randint(0, 6))
    else:
        src, hyp = pick(rnd.randint(0, 11)), []
        for w in src:
            r = rnd.random()
            hyp += [] if r < .1 else [w] if r < .85 else pick(1 if r < .9 else 2)
    gold = []
    for k in range(len(src) + 1):
        for _ in range(rnd.choice([0, 0, 1, 2])):
            if rnd.random() < .5:
                gold.append((k, k, *[pick(rnd.choice([1, 1, 2])) for _ in range(rnd.choice([1, 2]))]))
            if k < len(src) and rnd.random() < .4:
                gold.append((k, min(len(src), k + rnd.choice([1, 1, 2, 3])), pick(rnd.choice([0, 1, 1, 2]))))
    return src, hyp, gold


def correct(found, gold, hyp):
    """Matched edits, in order; equal gold further on counts an edit again."""
    count = last = 0
    for a, b, j, jj in found:
        places = [k for k in range(last, len(gold)) if gold[k][:2] == (a, b) and hyp[j:jj] in gold[k][2:]]
        count, last = count + len(places), places[-1] + 1 if places else last
    return count


@pytest.mark.parametrize("keep", [0, 1, 2])
@pytest.mark.parametrize("costs", [(1, 2), (2,)])
@pytest.mark.parametrize("sparse", [True, False])
def test_counts_equal_the_model(monkeypatch, keep, costs, sparse):
    if not sparse:
        monkeypatch.setattr(alignment, "SPARSE_WORK", 0)
    monkeypatch.setattr(alignment, "CELLS_PER_CHUNK", random.Random(keep).choice([1 << 22, 400]))
    rnd = random.Random(7 * keep + len(costs) + 100 * sparse)
    for _ in range(260):
        src, hyp, gold = random_case(rnd)
        listed = [(a, b, *(" ".join(x) for x in alts)) for a, b, *alts in gold]
        found = spans(src, hyp, [listed], keep, costs)[0]
        wanted = choose(src, hyp, gold, keep, costs)
        assert (len(found), correct(found, gold, hyp)) == (len(wanted), correct(wanted, gold, hyp)), (src, hyp, gold)


def test_long_pair_in_bounded_memory(monkeypatch):
    """Rows that don't all fit are computed again; the lattice is the same."""
    rnd = random.Random(11)
    src = [rnd.randrange(300) for _ in range(700)]
    hyp = [t if rnd.random() < .9 else rnd.randrange(300) for t in src if rnd.random() < .95]
    whole = list(alignment.lattices([(src, hyp)], (1, 2)))
    monkeypatch.setattr(alignment, "CELLS_PER_CHUNK", 1000)
    assert list(alignment.lattices([(src, hyp)], (1, 2))) == whole


@pytest.mark.parametrize("seed", range(6))
def test_search_for_large_lattices_is_optimal(seed, monkeypatch):
    """Where walks are too many to list, longer edits are charged once."""
    monkeypatch.setattr(alignment, "SPARSE_WORK", -1)
    monkeypatch.setattr(alignment, "DENSE_NODES", 0)
    rnd = random.Random(seed)
    for _ in range(25):
        words = [f"w{k}" for k in range(rnd.choice([2, 3, 6]))]
        src = [rnd.choice(words) for _ in range(rnd.randint(0, 4))]
        hyp = [rnd.choice(words) for _ in range(rnd.randint(0, 4))]
        keep, costs = rnd.choice([0, 1, 2]), rnd.choice([(1, 2), (2,)])
        # deletions and replacements only: insertions follow their own once-each rule
        gold = [(k, k + 1, ((), (rnd.choice(words),))) for k in range(len(src)) if rnd.random() < .4]
        gold = [(a, b, tuple(x for x in alts if list(x) != src[a:b])) for a, b, alts in gold]
        listed = [(a, b, *(" ".join(x) for x in alts)) for a, b, alts in gold]
        if src == hyp:
            assert spans(src, hyp, [listed], keep, costs) == [[]]
            continue
        table = cost_by_sequence(src, hyp, tuple(gold), keep, costs)
        found = tuple(spans(src, hyp, [listed], keep, costs)[0])
        assert found in table
        assert table[found] == min(table.values()), (src, hyp, gold, keep, costs, found)


def test_worked_sentences():
    cat = spans("My aunt lives at coast .".split(), "Her aunt lives on the coast .".split(), [[(3, 4, "on"), (4, 4, "the", "a")]])
    assert [s[:2] for s in cat[0]] == [(0, 3), (3, 4), (4, 4)]
    assert spans(list("ab"), [], None, 0) == [[(0, 2, 0, 0)]]
    assert spans([], list("ab"), None, 0) == [[(0, 0, 0, 2)]]
    assert spans(list("abc"), list("defg"), None, 0) == [[(0, 3, 0, 4)]]
    assert spans(["a", "a"], ["a"], None, 0) == [[(0, 1, 0, 0)]]


def test_each_gold_insertion_is_used_once():
    src, hyp = ["x", "y"], ["x", "the", "the", "y"]
    one = spans(src, hyp, [[(1, 1, "the")]])[0]
    two = spans(src, hyp, [[(1, 1, "the"), (1, 1, "the")]])[0]
    assert (1, 1, 1, 2) in one and two == [(1, 1, 1, 2), (1, 1, 2, 3)]


def test_null_and_batches_of_mixed_length():
    rnd = random.Random(3)
    rows = [(None, ["a"]), (["a"], None)]
    for n in (1, 3, 40, 400):
        src = [rnd.choice("abcdefgh") for _ in range(n)]
        hyp = [t if rnd.random() < .8 else "z" for t in src]
        rows.append((src, hyp))
    out = align_batch(pa.array([r[0] for r in rows], TOKENS), pa.array([r[1] for r in rows], TOKENS),
                      pa.nulls(len(rows), GOLD), 0, (1, 2)).to_pylist()
    assert out[:2] == [None, None]
    for (src, hyp), (edits,) in zip(rows[2:], out[2:]):
        rebuilt, at = [], 0
        for e in edits:
            rebuilt += src[at:e["start"]] + hyp[e["hyp_start"]:e["hyp_end"]]
            at = e["end"]
        assert rebuilt + src[at:] == hyp


@pytest.mark.parametrize("cost", [1, 2])
def test_token_distance(cost):
    rnd = random.Random(cost)
    pairs = [([rnd.choice("abc") for _ in range(rnd.randint(0, 9))], [rnd.choice("abcd") for _ in range(rnd.randint(0, 9))])
             for _ in range(200)]

    @lru_cache(None)
    def plain(s, t):
        if not s or not t:
            return len(s) + len(t)
        return min(plain(s[1:], t) + 1, plain(s, t[1:]) + 1, plain(s[1:], t[1:]) + (s[0] != t[0]) * cost)
    got = distance_batch(pa.array([p[0] for p in pairs], TOKENS), pa.array([p[1] for p in pairs], TOKENS), cost)
    assert got.to_pylist() == [plain("".join(s), "".join(t)) for s, t in pairs]


def test_edit_tables(spark):
    rows = [(0, "a b c", "a x c"), (1, "same", "same"), (2, "", "new words"), (3, "The Cat", "the cat"), (4, None, "a")]
    df = spark.createDataFrame(rows, "id long, source string, hypothesis string").repartition(3)
    got = extract_edits(df, ["id"]).orderBy("id", "edit_pos").collect()
    assert [tuple(r) for r in got] == [(0, 0, 1, 2, "b", "x"), (2, 0, 0, 0, "", "new words"), (3, 0, 0, 2, "The Cat", "the cat")]
    quiet = with_edits(df, ignore_whitespace_casing=True).where("id = 3").select(F.size("edits")).collect()
    assert quiet[0][0] == 0
    counts = {r.id: r.n for r in edit_count(df.where("source is not null"), "source", "hypothesis", "n").collect()}
    assert counts == {0: 1, 1: 0, 2: 1, 3: 1}


def test_kernel_runs_once_per_row(spark):
    df = spark.createDataFrame([(0, "a b", "a c")], "id long, source string, hypothesis string")
    plan = extract_edits(df, ["id"]).where("start >= 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_zip_lines_is_strict(spark):
    left = spark.createDataFrame([(0, "a"), (1, "b")], "sent_id long, text string")
    right = spark.createDataFrame([(0, "s")], "sent_id long, source string")
    assert zip_lines(left, right, strict=False).count() == 1
    with pytest.raises(Exception, match="without partner"):
        zip_lines(left, right).collect()
    for strict in (True, False):
        with pytest.raises(Exception, match="repeated line"):
            zip_lines(left.union(left.where("sent_id = 1")), left.withColumnRenamed("text", "t"), strict=strict).collect()
    plan = zip_lines(left, right)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2      # the check needs no shuffle of its own


def test_patterns_are_aligned_once(monkeypatch):
    """Pairs with equal tokens at the same places, and gold seen alike, need no matrix of their own, in any batch."""
    def batch(words, fixes):
        src, hyp = [w for w in words], [*words[:2], fixes[0], *words[3:6], fixes[1], *words[6:]]
        gold = [[{"start": 2, "end": 3, "corrections": ["no", fixes[0]]}, {"start": 6, "end": 6, "corrections": [fixes[1]]}], []]
        return pa.array([src], TOKENS), pa.array([hyp], TOKENS), pa.array([gold], GOLD)
    first = align_batch(*batch("one two three four five six one".split(), ("x", "y")), 2, (1, 2)).to_pylist()
    assert [tuple(e.values()) for e in first[0][0]] == [(2, 3, 2, 3), (6, 6, 6, 7)]
    monkeypatch.setattr(alignment, "_forward", None)
    assert align_batch(*batch("a b c d e f a".split(), ("u", "v")), 2, (1, 2)).to_pylist() == first


@pytest.mark.parametrize("kept_bytes", [0, 1 << 25])
@pytest.mark.parametrize("band", [1, 31])
def test_remembered_patterns_change_nothing(monkeypatch, kept_bytes, band):
    """Rows of one batch, remembered or not, in patterns or not, against each row alone."""
    rnd = random.Random(band + kept_bytes)
    cases = [random_case(rnd) for _ in range(150)] * 2
    listed = [[[{"start": a, "end": b, "corrections": [" ".join(x) for x in alts]} for a, b, *alts in gold], []] for _, _, gold in cases]
    rows = [pa.array([c[k] for c in cases], TOKENS) for k in (0, 1)] + [pa.array(listed, GOLD)]
    for keep, costs in ((0, (2,)), (2, (1, 2))):
        monkeypatch.setattr(alignment, "PATTERN_BAND", -1)
        alone = [align_batch(*(x.slice(r, 1) for x in rows), keep, costs)[0].as_py() for r in range(len(cases))]
        monkeypatch.setattr(alignment, "KEPT_BYTES", kept_bytes)
        monkeypatch.setattr(alignment, "PATTERN_BAND", band)
        assert align_batch(*rows, keep, costs).to_pylist() == alone
        together = alignment.align_batches(iter([tuple(x.slice(at, 70) for x in rows) for at in range(0, len(cases), 70)]), keep, costs)
        assert [r for part in together for r in part.to_pylist()] == alone


def by_plain_listing(monkeypatch, nodes, codes, width, keep):
    with monkeypatch.context() as plain:
        plain.setattr(alignment, "DENSE_NODES", 0)
        cells = dict(zip(nodes.tolist(), codes.tolist()))
        return alignment._arcs(cells, list(cells), width, keep, True)


@pytest.mark.parametrize("work", [60, 200_000])
@pytest.mark.parametrize("keep", [0, 1, 2])
def test_walks_by_length_equal_walks_by_node(monkeypatch, work, keep):
    monkeypatch.setattr(alignment, "SPARSE_WORK", work)
    rnd, given_up = random.Random(work + keep), 0
    for _ in range(40):
        size = rnd.choice([2, 8, 40])
        src = [rnd.randrange(size) for _ in range(rnd.choice([1, 10, 40, 120]))]
        hyp = [x for w in src for x in ([] if rnd.random() < .06 else [w] if rnd.random() < .85 else [rnd.randrange(size + 2), w])]
        if src == hyp:
            continue
        for _, band, (nodes, codes) in alignment.lattices([(src, hyp)], (1, 2)):
            nodes, codes = np.frombuffer(nodes, np.int64), np.frombuffer(codes, np.int64)
            arcs = alignment._arcs_by_steps(nodes, codes, 2 * band + 1, keep)
            plain = by_plain_listing(monkeypatch, nodes, codes, 2 * band + 1, keep)
            if plain is None:
                given_up += 1
                assert arcs is None
                continue
            assert arcs.length == plain.length and arcs.rank == plain.rank
            assert [sorted(x) for x in arcs.found] == [sorted(x) for x in plain.found]
    assert (given_up > 0) == (work == 60)
