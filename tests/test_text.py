"""Column functions against small plain-Python models on awkward strings."""

import itertools
import random
import string

import pytest
from pyspark.sql import functions as F

from redpencil.functions import prompts, text, tokenizer
from redpencil.functions.sequences import intersect_keeping_duplicates, shrink
from redpencil.operators import correct, offsets, sampling
from redpencil.operators.rewards import reward_table

PIECES = ["", "a", "The cat", " ", "  ", "\t", "\n", '"', "Corrected: ", "Corrected", "</s>", "</s", "</", "é", "ñ x", ".", "!?",
          " ", " ", "\x85", "\x1d", "[/INST]", "<<SYS>>", "<</SYS>>", "### Response:", " - ", " / ", "(", "z.", "`", "_"]


def awkward_strings():
    rnd = random.Random(5)
    pairs = ["".join(p) for p in itertools.product(PIECES[:14], repeat=2)]
    longer = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(3, 9))) for _ in range(400)]
    return sorted(set(PIECES + pairs + longer))


@pytest.fixture(scope="module")
def strings(spark):
    return spark.createDataFrame([(s,) for s in awkward_strings()], "s string")


def words_before(s, mark):
    return s.split(mark, 1)[0]


def gap_model(s):
    cut = max((i for i in range(1, len(s)) if s[i] == " " and s[i - 1].isalpha()), default=None)
    return s if cut is None else s[:cut + 2]


def response_model(s):
    _, found, below = ("\n" + s).partition("### Response:")
    lines = below.split("\n")[1:] if found else []
    return next((x.strip() for x in lines if x.strip() and "### Response:" not in x), "")


def between_model(s):
    if "<<SYS>>" in s and "<</SYS>>" in s.split("<<SYS>>", 1)[1]:
        return s.split("<<SYS>>", 1)[1].split("<</SYS>>", 1)[0].strip()
    return None


def quote_model(s):
    s = s.replace("Corrected: ", "")
    return s[:-1].strip() if s[-1:] == '"' else s


MODELS = {
    "strip": (text.strip, str.strip),
    "normalize": (text.normalize, lambda s: "".join(" " if k else "".join(g) for k, g in itertools.groupby(s, str.isspace))),
    "between": (text.model_response, between_model),
    "between_text": (lambda c: text.model_response(c, "none"), lambda s: "none" if between_model(s) is None else between_model(s)),
    "instruction": (text.after_instruction, lambda s: s.split("[/INST]", 1)[1] if "[/INST]" in s else None),
    "prompt": (lambda c: text.strip_prompt(c, "The"), lambda s: s.removeprefix("The").lstrip()),
    "clean_sentence": (text.clean_sentence, quote_model),
    "punctuation": (text.clean_punctuation, lambda s: s[:len(s.rstrip(string.punctuation + " ")) + 2]),
    "gap": (text.cut_after_last_word_gap, gap_model),
    "response": (text.instruction_response, response_model),
    "line": (lambda c: text.line(c, 1), lambda s: (s.split("\n") + [None])[1]),
    "slice": (lambda c: text.line_slice(c, 1, 2, 1), lambda s: s.split("\n")[1][2:-1] if "\n" in s else None),
    "rl": (text.rl_answer, lambda s: gap_model(s.split("\n")[1] if "\n" in s else s).replace("Corrected: ", "")),
    "reward": (text.reward_answer, lambda s: gap_model(words_before(s, "\n")).replace("Corrected", "")),
    "ascii": (text.is_ascii, str.isascii),
    "printable": (text.keep_printable_ascii, lambda s: "".join(c for c in s if " " <= c <= "~")),
    "tokens": (tokenizer.whitespace_tokens, str.split),
    "squeeze": (text.squeeze_case, lambda s: "".join(c for c in s if c != " ").lower()),
}


@pytest.mark.parametrize("name", MODELS)
def test_column_equals_model(strings, name):
    column, model = MODELS[name]
    for s, got in strings.select("s", column(F.col("s"))).collect():
        assert got == model(s), repr(s)


def test_nulls_stay_null(spark):
    row = spark.createDataFrame([(None,)], "s string").select(
        *(column(F.col("s")) for column, _ in MODELS.values())).first()
    assert all(v is None for v in row)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_answers(spark):
    raw = F.lit("<s> GEC: x\nCorrected: It is  good . And </s")
    assert one(spark, text.sft_answer(raw, "llama")) == "It is good . And <"
    assert one(spark, text.sft_answer(F.lit('a\nCorrected: "fine" </s>'), "mpt")) == '"fine" '
    assert one(spark, text.sft_answer(F.lit("one line"), "llama")) is None
    assert one(spark, text.or_source(text.sft_answer(F.lit("one line"), "falcon"), F.lit("src"))) == "src"
    assert one(spark, text.erase_end_markers(F.lit("a</s>b</sc</d"))) == "a b c d"
    with pytest.raises(ValueError):
        text.sft_answer(raw, "other")
    assert one(spark, text.normalize(F.lit("a ' b ' c - d / e (f)"), "intended")) == "a 'b' c-d/e ( f ) "


def test_cp1252(spark):
    assert len(text.CP1252_FROM) == len(text.CP1252_TO) == 27
    fixed = one(spark, text.fix_cp1252(F.lit("\x80 \x85 \x93x\x94 \x9f \x81\x8d")))
    assert fixed == "€ … “x” Ÿ \x81\x8d"
    for old, new in zip(text.CP1252_FROM, text.CP1252_TO):
        assert bytes([ord(old)]).decode("cp1252") == new


TOKENIZED = [
    ("Ann wrote, \"We couldn't find it. They'll call us.\"", True,
     "Ann wrote , `` We could n't find it . They 'll call us . ''"),
    ("a,b,c 1,000 x,5", False, "a , b,c 1,000 x , 5"),
    ("Mr. Smith is 5. 6 e.g. U.S. end.", False, "Mr. Smith is 5. 6 e.g. U.S. end ."),
    ("wait... what--yes - no", False, "wait ... what -- yes - no"),
    ("and/or (x) a|b; c:d", False, "and / or ( x ) a -PIPE- b ; c : d"),
    ("John's dogs' 1990's 'quoted'", False, "John 's dogs ' 1990 's ' quoted '"),
    ("I cannot [go] {now}", True, "I can not [ go ] { now }".replace("[", "-LSB-").replace("]", "-RSB-").replace("{", "-LCB-").replace("}", "-RCB-")),
    ("", False, ""), ("...", False, "..."), ("  é! ", False, "é !"),
]


@pytest.mark.parametrize("sentence,ptb,expected", TOKENIZED)
def test_tokenizer(spark, sentence, ptb, expected):
    assert " ".join(one(spark, tokenizer.ptb_tokens(F.lit(sentence), "en", ptb))) == expected


def test_french_and_unknown_language(spark):
    assert one(spark, tokenizer.ptb_tokens(F.lit("l'ami d'un A."), "fr")) == ["l'", "ami", "d'", "un", "A", "."]
    with pytest.raises(ValueError):
        tokenizer.ptb_tokens(F.lit("x"), "de")


def test_offsets(spark):
    sentence = "It's here, now."
    rows = spark.createDataFrame([(sentence, 0, 4), (sentence, 5, 9), (sentence, 6, 10), (sentence, 11, 15)],
                                 "sentence string, start_off int, end_off int")
    assert [tuple(r)[3:] for r in offsets.token_spans(rows).orderBy("start_off").collect()] == [(0, 2), (2, 3), (3, 4), (4, 6)]
    block = "S It's here, now.\nA 5 9|||Wci|||there,||'tis|||REQUIRED|||-NONE-|||0\nother"
    out = offsets.convert_blocks(spark.createDataFrame([(1, block)], "id long, text string")).first()
    assert out.text == "S It 's here , now .\nA 2 3|||Wci|||there ,||' tis|||REQUIRED|||-NONE-|||0\nother"


def test_prompts(spark):
    s, t = F.lit("A b ."), F.lit("A c .")
    assert one(spark, prompts.sft_text(s, F.lit(None).cast("string"))) == "<s> GEC: A b .\nCorrected: A b . </s>"
    assert one(spark, prompts.rl_prompt(s)) == "GEC: A b .\nCorrected:"
    assert one(spark, prompts.inference_prompt(s)) == "<s> GEC: A b .\nCorrected:"
    query = prompts.reward_query(s, t)
    assert one(spark, query) == "source: A b . \n target: A c ."
    assert [one(spark, c) for c in prompts.split_reward_query(query)] == ["A b . ", "A c ."]
    assert one(spark, prompts.chat(F.lit("sys"), s)) == "\n[INST] <<SYS>>\nsys\n<</SYS>>\nA b . [/INST]\n"
    assert one(spark, prompts.zero_shot_sentence(s)).split("\n")[2] == "    Sentence: A b . <s>"
    assert one(spark, prompts.zero_shot_instruction(s)).split("\n")[3:7] == ["    ### Input:", "    A b .", "", "    ### Response:"]


def test_rewards(spark):
    rows = spark.createDataFrame([
        (0, "source: a b \n target: a c", "a c"), (1, "source: a c \n target: a c", "a c\nmore"),
        (2, "source: a c \n target: a c", "x c y"), (3, "source: a b \n target: a c", "z c q")], "id long, query string, response string")
    got = {r.id: (r.source_edits, r.output_edits, r.reward) for r in reward_table(rows, ["id"]).collect()}
    assert got[0] == (1, 0, 1.0) and got[1] == (0, 0, 1.0) and got[3] == (1, 2, -1.0)
    assert got[2][:2] == (0, 2) and got[2][2] == pytest.approx(1 - 1 / (1 + (1 / .666 - 1) ** (2 / 3)))


def test_shrink_and_intersect(spark):
    cases = [("a b c", "a x c", (1, 2, "b", "x")), ("a b", "a b", (2, 2, "", "")), ("", "n", (0, 0, "", "n")),
             ("a a", "a", (1, 2, "a", "")), ("a b", "b", (0, 1, "a", "")), ("x a b", "y a b", (0, 1, "x", "y"))]
    for before, after, expected in cases:
        got = one(spark, shrink(F.lit(0), F.lit(len(before.split())), F.lit(before), F.lit(after)))
        assert tuple(got) == expected
    assert one(spark, intersect_keeping_duplicates(
        F.array(*map(F.lit, "abca")), F.array(F.lit("a"), F.lit("c")))) == ["a", "c", "a"]


def test_filters_and_sample(spark):
    rows = spark.createDataFrame([(0, "a", "b"), (1, "a", "a"), (2, "a", None), (3, None, "b")], "pair_id long, source string, target string")
    assert sorted(r.pair_id for r in sampling.changed_pairs(rows).collect()) == [0, 3]
    ids = spark.range(1000).withColumnRenamed("id", "pair_id")
    pick = lambda parts: [r.pair_id for r in sampling.seeded_sample(ids.repartition(parts), 10, 42).collect()]
    assert sorted(pick(1)) == sorted(pick(9)) and len(set(pick(1))) == 10
    with pytest.raises(Exception, match="fewer present"):
        sampling.seeded_sample(ids, 1001, 1).collect()
    edits = spark.createDataFrame([("A b", "ab"), ("a", "b"), ("a", "a")], "original string, correction string")
    assert sampling.drop_space_and_case_edits(edits).count() == 1
    assert sampling.drop_unchanged_edits(edits).count() == 2


def test_correct(spark):
    def load():
        return lambda batch: [p + " It is good ok" if "bad" in p else p.split("\n")[0] for p in batch]
    rows = spark.createDataFrame([(0, "It bad"), (1, "fine")], "sent_id long, text string")
    out = correct.correct(rows, load, lambda raw: text.sft_answer(raw, "llama")).orderBy("sent_id").collect()
    assert [r.corrected for r in out] == ["It is good o", "fine"]
