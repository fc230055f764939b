"""Personal data in texts: generators propose spans, boosted trees judge them; DataFrame functions only.

Four base kinds have exact rules and always stay. Looser patterns propose more spans of each kind, which may overlap:
written-out addresses, spaced or bracketed dots, and runs of digits with other separators. Gradient-boosted trees
(Spark's) see a candidate's format and the text around it. Their labels do not follow the strict form: positive are base
spans rewritten into loose forms at their place in the text; negative are base spans rewritten into numbers, versions and
ends of sentences, and the texts' own candidates in a neutral context or of an impossible form. Own candidates that may be
personal data have no label. Trees are fitted on at most ``FIT_EACH`` examples for each kind and label; all examples set
each kind's threshold, the lowest with a precision of ``PRECISION``. A kind without such a threshold adds nothing.

A text is read by each pattern twice, for the matches and for what lies between them; their lengths give the places.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from redpencil.session import materialize

KINDS = ("email", "ip", "card", "phone")
FIT_EACH = 2000                  # examples of a kind and label that the trees are fitted on
PRECISION = 0.99
AROUND = 24                      # characters of context on either side
PER_BLOCK = 48                   # items that are gone through one by one
PIECE = 1024                     # characters that a cut looks through

# The base patterns. Runs are taken whole, as no shorter run can match where the whole one does not, and a match
# can begin only where its run begins or the last match ended; so long runs are read once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# What the generators look for, besides the base patterns themselves.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?@ ?| ?[(\[]at[)\]] ?| at )[A-Za-z0-9-]{1,64}+(?:(?: ?\. ?| ?[(\[]dot[)\]] ?| dot )[A-Za-z0-9-]{1,64}+){1,8}+",
    "phone": r"(?<![0-9+(])[+(]?[0-9](?:[ ().-]{0,2}+[0-9]){6,40}+",
    "ip": r"(?i)(?<![0-9])[0-9]{1,3}(?:(?: ?\. ?| ?[(\[](?:dot|\.)[)\]] ?| dot )[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ._/-]{0,3}+[0-9]){13,18}(?![0-9])",
}
WORDS = {"mail": r"(?i)mail|contact", "phone": r"(?i)tel|phone|call|fax|mobil", "card": r"(?i)card|visa|pay|account",
         "net": r"(?i)\bip\b|host|server|address|network", "code": r"(?i)key|token|pass|secret|hash|version|id"}
CUES = {"email": "mail", "phone": "phone", "card": "card", "ip": "net"}

# Base spans in loose forms, and what looks like those but is none: (text before, text, text after).
AT, DOT = (" at ", " [at] ", "(at)", " @ "), (" dot ", " [dot] ", ".", ".")
GROUPS = (".", " - ", "  ", "/")
POINTS = (" . ", "[.]", " dot ", "(dot)")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), use)[0]


def before_each(items: Column, zero: Column, step, join) -> Column:
    """For each item what ``step`` makes of those before it.

    Items are summed by blocks first, so the work grows with their number, not its square. ``join`` adds a block's result.
    """
    def over(it: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(it) - 1) / PER_BLOCK).cast("int"))
        block = lambda b: F.slice(it, b * PER_BLOCK + 1, F.lit(PER_BLOCK))
        totals = F.transform(blocks, lambda b: F.aggregate(block(b), zero, step))
        starts = F.aggregate(totals, F.array(zero), lambda s, t: F.concat(s, F.array(join(F.element_at(s, -1), t))))
        each = bound(starts, lambda at: F.transform(blocks, lambda b: bound(block(b), lambda own: F.transform(
            own, lambda x, i: F.aggregate(F.slice(own, F.lit(1), i), F.get(at, b), step)))))
        return F.when(F.size(it) > 0, F.flatten(each)).otherwise(F.array().cast("array<int>"))
    return bound(items, over)


def found(text: Column, pattern: str) -> Column:
    """``start, end, value, before, after`` of the matches, leftmost and non-overlapping, in characters.

    The text around a match is cut from the gaps and matches beside it, so no cut begins at the start of the text.
    """
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    none, around = F.lit(""), F.lit(AROUND)

    def place(it: Column, starts: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            last, then, later = F.get(it, i - 1), F.get(it, i + 1), F.get(it, i + 2)
            first = F.get(starts, i) + F.length(x["gap"])
            before = F.concat(F.right(F.coalesce(last["gap"], none), around), F.coalesce(last["value"], none), F.right(x["gap"], around))
            after = F.concat(F.left(then["gap"], around), F.when(F.length(then["gap"]) < AROUND, F.concat(
                F.coalesce(then["value"], none), F.left(F.coalesce(later["gap"], none), around))).otherwise(none))
            return F.struct(first.alias("start"), (first + F.length(x["value"])).alias("end"), x["value"].alias("value"),
                            F.right(before, around).alias("before"), F.left(after, around).alias("after"))
        # the last gap has no match
        return F.filter(F.transform(it, one), lambda m: m["value"].isNotNull())
    return bound(sizes, lambda it: bound(before_each(it, F.lit(0), lambda s, x: s + F.length(x["gap"]) + F.coalesce(F.length(x["value"]), F.lit(0)),
                                                     lambda s, t: s + t), lambda starts: place(it, starts)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    n = F.length(number)

    def digit(i: Column) -> Column:
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), digit), F.lit(0), lambda s, d: s + d) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(value))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def gate(text: Column, kind: str) -> Column:
    """Whether a text can hold the kind at all; a quick look that saves the patterns."""
    return text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike("[0-9]")


SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
SEEN = "array<struct<start:int,rank:int,end:int,kind:string,value:string,before:string,after:string>>"


def base_matches(text: Column) -> Column:
    """The spans of the base kinds by start, then kind in the order of ``KINDS``, with their texts and those around them."""
    def part(rank: int, kind: str) -> Column:
        kept = F.filter(found(text, BASE[kind]), lambda m: valid(kind, m["value"]))
        own = F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"),
                                                   *(m[c].alias(c) for c in ("value", "before", "after"))))
        return F.when(gate(text, kind), own).otherwise(F.array().cast(SEEN))
    return F.array_sort(F.concat(*(part(rank, kind) for rank, kind in enumerate(KINDS))))


def spans_only(matches: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(*(m[c].alias(c) for c in ("start", "rank", "end", "kind"))))


def base_spans(text: Column) -> Column:
    return spans_only(base_matches(text))


FEATURES = ("kind", "length", "digits", "separators", "plus", "parens", "dots", "longest", "letters", "glued_before",
            "glued_after", *(f"near_{w}" for w in WORDS), "line_start", "line_end",
            "at_sign", "at_word", "dot_word", "dot_space", "octets", "luhn")


def candidates(text: Column) -> Column:
    """What the loose patterns propose: ``start, rank, end, kind, x``, with the features in ``x``."""
    def part(kind: str, pattern: str) -> Column:
        has = text.rlike("(?i)@|\\bat\\b") if kind == "email" else text.rlike("[0-9]")

        def judged(m: Column) -> Column:
            v, before, after = m["value"], m["before"], m["after"]
            around = F.concat(before, F.lit(" "), after)
            n = F.length(v)
            values = [F.lit(float(KINDS.index(kind))), n, F.length(digits(v)), n - F.length(F.regexp_replace(v, "[ ().-]", "")),
                      v.contains("+"), v.contains("("), n - F.length(F.replace(v, F.lit("."), F.lit(""))),
                      F.array_max(F.transform(F.split(v, "[^0-9]"), F.length)), n - F.length(F.regexp_replace(v, "[A-Za-z]", "")),
                      before.rlike(r"[\p{L}\p{N}_]$"), after.rlike(r"^[\p{L}\p{N}_]"),
                      *(around.rlike(w) for w in WORDS.values()), before.rlike(r"(^|\n)$"), after.rlike(r"^(\n|$)"),
                      v.contains("@"), v.rlike(r"(?i)[ (\[]at[ )\]]"), v.rlike(r"(?i)[ (\[]dot[ )\]]"), v.contains(". "),
                      F.regexp_replace(v, "[^0-9]+", ".").rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$") if kind == "ip" else F.lit(False),
                      valid("card", v) if kind == "card" else F.lit(False)]
            return F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"),
                            F.lit(kind).alias("kind"), F.array(*(x.cast("double") for x in values)).alias("x"))
        own = F.transform(found(text, pattern), judged)
        return F.when(has, own).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,x:array<double>>>"))
    return F.concat(*(part(kind, pattern) for kind, pattern in LOOSE.items()))


def with_free(spans: Column, base: Column) -> Column:
    """Spans with ``free``: whether they touch no base span. Both in one order, with the farthest end of the base spans
    before each and the nearest start of those after it."""
    kind = "struct<start:int,late:int,end:int,at:int>"
    marks = F.concat(F.transform(base, lambda x: F.struct(x["start"].alias("start"), F.lit(0).alias("late"), x["end"].alias("end"), F.lit(-1).alias("at")).cast(kind)),
                     F.transform(spans, lambda x, i: F.struct(x["start"].alias("start"), F.lit(1).alias("late"), x["end"].alias("end"), i.alias("at")).cast(kind)))

    def judged(own: Column) -> Column:
        ends = before_each(own, F.lit(-1), lambda s, x: F.greatest(s, F.when(x["late"] == 0, x["end"]).otherwise(-1)), F.greatest)
        far = F.lit(2**31 - 1)
        starts = F.reverse(before_each(F.reverse(own), far, lambda s, x: F.least(s, F.when(x["late"] == 0, x["start"]).otherwise(far)), F.least))
        free = F.zip_with(F.zip_with(own, ends, lambda x, e: F.struct(x["at"].alias("at"), x["end"].alias("end"), (e <= x["start"]).alias("ok"))), starts,
                          lambda x, t: F.struct(x["at"].alias("at"), (x["ok"] & (t >= x["end"])).alias("free")))
        return F.array_sort(F.filter(free, lambda x: x["at"] >= 0))
    free = bound(F.array_sort(marks), judged)
    return bound(free, lambda f: F.transform(spans, lambda x, i: x.withField("free", F.get(f, i)["free"])))


def proposed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_seen`` and ``_more``: the base matches, and the candidates with ``free`` and with ``label`` 0 if they
    touch no base span and can't be personal data, or nothing around them speaks for it; else null."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_seen", base_matches(body)).withColumn("_more", candidates(body))
    at = {name: k for k, name in enumerate(FEATURES)}

    def has(c: Column, name: str) -> Column:
        return c["x"][at[name]] > 0

    def label(c: Column) -> Column:
        numbers = c["x"][at["digits"]]
        impossible = F.when(c["kind"] == "ip", ~has(c, "octets")).when(c["kind"] == "card", ~has(c, "luhn")).when(
            c["kind"] == "phone", ~numbers.between(7, 15)).otherwise(False)
        neutral = F.lit(False)
        for kind, word in CUES.items():
            neutral = neutral | ((c["kind"] == kind) & ~has(c, f"near_{word}"))
        # a written-out address speaks for itself
        open_ = (c["kind"] != "email") | ~(has(c, "at_sign") | has(c, "dot_word"))
        return c.withField("label", F.when(c["free"] & (impossible | (neutral & open_)), 0.0))
    return rows.withColumn("_more", F.transform(with_free(F.col("_more"), F.col("_seen")), label))


def rewritten(kind: str, value: Column, before: Column, after: Column) -> list[tuple[float, Column, Column, Column]]:
    """Labelled forms of a base span: ``label, text before, text, text after``."""
    number, plain, total = digits(value), F.lit(" of the library"), (F.lit("a total of "), F.lit(" units"))
    if kind == "email":
        local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)

        def form(a: str, d: str) -> Column:
            return F.concat(local, F.lit(a), F.replace(host, F.lit("."), F.lit(d)))
        return [(1.0, before, form(a, d), after) for a, d in zip(AT, DOT)] + [
            (0.0, before, form(" at ", ". "), after), (0.0, F.lit("they met "), form(" at ", ". "), F.lit(" was"))]
    if kind == "phone":
        bare = F.substring(value, F.lit(2), F.length(value))
        local = F.regexp_replace(bare, "^[0-9]+[ ().-]+(?=[0-9 ().-]{8})", "")
        forms = [bare, F.regexp_replace(bare, "[ ().-]+", "."), F.regexp_replace(bare, "[ ().-]+", "-"), F.concat(F.lit("00"), number),
                 F.concat(F.lit("00"), bare)]
        cued = [(F.lit(cue), v, F.lit(end)) for cue, end in (("call me on ", " please"), ("Phone: ", "")) for v in (*forms[1:], local)]
        return [(1.0, before, v, after) for v in forms] + [(1.0, *x) for x in cued] + [
            (0.0, total[0], number, total[1]), (0.0, F.lit("since version "), F.regexp_replace(number, "(.{3})(?=.)", "$1."), plain)]
    if kind == "card":
        broken = F.concat(F.substring(number, F.lit(1), F.length(number) - 1), ((F.substring(number, -1, 1).cast("int") + 1) % 10).cast("string"))

        def grouped(n: Column, mark: str) -> Column:
            return F.regexp_replace(n, "(.{4})(?=.)", f"$1{mark}")
        return [(1.0, before, grouped(number, mark), after) for mark in GROUPS] + [
            (0.0, before, grouped(broken, "."), after), (0.0, total[0], grouped(broken, "  "), total[1])]
    wrong = F.regexp_replace(value, "[0-9]+$", "999")
    return [(1.0, before, F.replace(value, F.lit("."), F.lit(mark)), after) for mark in POINTS] + [
        (0.0, before, F.replace(wrong, F.lit("."), F.lit(" . ")), after),
        (0.0, F.lit("since version "), F.replace(value, F.lit("."), F.lit(". ")), plain)]


def examples(rows: DataFrame, doc_id: str) -> DataFrame:
    """``k, kind, x, label`` of all labelled candidates and of all base spans in their rewritten forms."""
    own = rows.where(F.exists("_more", lambda c: c["label"].isNotNull())).select(F.col(doc_id).alias("_id"), F.explode("_more").alias("c"))
    own = own.where("c.label IS NOT NULL").select(
        F.xxhash64("_id", "c.start", "c.kind").alias("k"), "c.kind", "c.x", "c.label")
    spans = rows.where(F.size("_seen") > 0).select(F.col(doc_id).alias("_id"), F.explode("_seen").alias("b"))
    spans = spans.select(F.xxhash64("_id", "b.start", "b.kind").alias("k"), "b.kind", "b.value", "b.before", "b.after")
    forms = F.lit(None)
    for kind in KINDS:
        made = F.array(*(F.struct(F.lit(y).alias("label"), b.alias("before"), v.alias("value"), a.alias("after"))
                         for y, b, v, a in rewritten(kind, F.col("value"), F.col("before"), F.col("after"))))
        forms = F.when(F.col("kind") == kind, made).otherwise(forms)
    spans = spans.select("k", "kind", F.posexplode(forms).alias("n", "f"))
    spans = spans.select(F.xxhash64("k", "n").alias("k"), "kind", "f.label", F.length("f.before").alias("start"), F.length("f.value").alias("n"),
                         F.concat("f.before", "f.value", "f.after").alias("_t"))
    met = F.filter(candidates(F.col("_t")), lambda c: (c["kind"] == F.col("kind")) & (c["start"] <= F.col("start")) & (c["end"] >= F.col("start") + F.col("n")))
    spans = spans.select("k", "kind", "label", F.explode(met).alias("c"))
    return own.unionByName(spans.select("k", "kind", "c.x", "label"))


class Trees:
    """Boosted trees as a column expression, with a threshold for each kind."""

    def __init__(self, trees: list, weights: list[float], thresholds: dict[str, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def margin(self, x: Column) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            feature, bound, left, right = node
            return F.when(F.get(x, F.lit(feature)) <= bound, value(left)).otherwise(value(right))
        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + value(tree) * weight
        return total

    def selected(self, c: Column) -> Column:
        chosen = F.lit(False)
        for kind, least in self.thresholds.items():
            chosen = chosen | ((c["kind"] == kind) & (self.margin(c["x"]) >= least))
        return chosen


def _node(node):
    """A node of a fitted tree as ``(feature, bound, left, right)`` or a leaf's value."""
    if "LeafNode" in node.getClass().getSimpleName():
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _node(node.leftChild()), _node(node.rightChild())


def fit(rows: DataFrame, doc_id: str) -> Trees:
    """Trees from at most ``FIT_EACH`` examples of each kind and label, the first by a hash; thresholds from all examples."""
    some = materialize(examples(rows, doc_id), "candidates")
    learn = None
    for kind in LOOSE:
        for y in (0.0, 1.0):
            own = some.where((F.col("kind") == kind) & (F.col("label") == y)).orderBy("k", "x").limit(FIT_EACH)
            learn = own if learn is None else learn.union(own)
    learn = materialize(learn, "sample")
    if learn.select("label").distinct().count() < 2:
        return Trees([], [], {})
    # at most 2 * FIT_EACH rows of each kind
    sample = learn.select("label", array_to_vector("x").alias("features")).coalesce(1).sortWithinPartitions("label", "features")
    model = GBTClassifier(maxIter=10, maxDepth=4, stepSize=0.3, seed=7).fit(sample)
    trees = Trees([_node(t._call_java("rootNode")) for t in model.trees], list(model.treeWeights), {})
    # calibration: the margin in steps, counted over all rows; a few hundred groups at most
    step = F.floor(trees.margin(F.col("x")) * 50)
    counts = some.groupBy("kind", step.alias("step")).agg(F.sum("label").alias("good"), F.count("*").alias("n")).collect()
    for kind in LOOSE:
        good = n = 0
        for r in sorted((r for r in counts if r.kind == kind), key=lambda r: -r.step):
            good, n = good + r.good, n + r.n
            if good >= PRECISION * n:
                trees.thresholds[kind] = r.step / 50
    return trees


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row, base, spans`` for every row: the row itself, its base spans, and all selected spans, both by start.

    A null text counts as empty and has no spans. Null ids take part like others; repeated rows get equal spans; an
    empty table gives no rows. Added spans touch no base span.
    """
    rows = docs.select(F.struct("*").alias("_row"))
    rows = proposed(rows.withColumn("_text", F.col(f"_row.{text}")), "_text").drop("_text")
    rows = materialize(rows.withColumn("_id", F.col(f"_row.{doc_id}")), "proposed")
    trees = fit(rows, "_id")
    more = F.filter("_more", lambda c: trees.selected(c) & c["free"])
    base = spans_only(F.col("_seen"))
    return rows.select("_row", base.alias("base"), F.array_sort(F.array_distinct(F.concat(base, spans_only(more)))).alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every span replaced by ``[kind]``; of overlapping spans the first one names the place.

    All columns stay; a null text stays null.
    """
    found_ = detect(docs, doc_id, text)
    body = F.col(f"_row.{text}")
    pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(own: Column, start: Column, end: Column) -> Column:
        """The text from a place to another one, out of the pieces that hold it."""
        first = F.floor(start / PIECE).cast("int")
        held = F.array_join(F.slice(own, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1), "")
        return F.when(end > start, F.substring(held, start - first * PIECE + 1, end - start)).otherwise("")

    def masked(own: Column, spans: Column, upto: Column) -> Column:
        """Before each span the text since the farthest end so far; a span that begins earlier adds nothing."""
        parts = F.transform(spans, lambda x, i: F.when(x["start"] >= F.get(upto, i), F.concat(
            cut(own, F.get(upto, i), x["start"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(""))
        last = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), cut(own, last, F.length(body)))
    upto = before_each(F.col("spans"), F.lit(0), lambda s, x: F.greatest(s, x["end"]), F.greatest)
    clean = bound(pieces, lambda own: bound(upto, lambda u: masked(own, F.col("spans"), u)))
    clean = F.when(F.size("spans") == 0, body).otherwise(clean)
    return found_.select(*(clean.alias(c) if c == text else F.col(f"_row.{c}") for c in docs.columns))
