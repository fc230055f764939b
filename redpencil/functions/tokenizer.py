"""Token columns: whitespace tokens and a Penn-Treebank-style tokenizer of native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from redpencil.functions.sequences import let
from redpencil.functions.text import SPACE, SPACE_CHARS, strip

# Words that keep a trailing dot.
NONBREAKING_PREFIXES = {
    "en": """A B C D E F G H I J K L M N O P Q R S T U V W X Y Z
        Adj Adm Adv Asst Bart Bldg Brig Bros Capt Cmdr Col Comdr Con Corp Cpl DR Dr Drs Ens
        Gen Gov Hon Hr Hosp Insp Lt MM MR MRS MS Maj Messrs Mlle Mme Mr Mrs Ms Msgr Op Ord
        Pfc Ph Prof Pvt Rep Reps Res Rev Rt Sen Sens Sfc Sgt Sr St Supt Surg
        v vs i.e rev e.g Nos Nr""".split(),
    "fr": [],
}

# Rewrite rules, applied in this order. Neighbours are consumed, not looked at, so a
# rule can skip every second of several touching matches.
OPENING_RULES = (
    (rf"([^\p{{L}}\p{{N}}_{SPACE_CHARS}.'`,\-\"|/])", " $1 "),
    (r"\|", " -PIPE- "),
    (r"(\S)/(\S)", "$1 / $2"),
)
TREEBANK_RULES = (
    (r"\(", " -LRB- "),
    (r"\)", " -RRB- "),
    (r"\[", " -LSB- "),
    (r"\]", " -RSB- "),
    (r"\{", " -LCB- "),
    (r"\}", " -RCB- "),
    (r"\"\s*\z", " '' "),
    (r"\A\s*\"", " `` "),
    (r"(\S)\"\s", "$1 '' "),
    (r"\s\"(\S)", " `` $1"),
    (r"(\S)\"", "$1 '' "),
    (r"\"(\S)", " `` $1"),
    (r"'\s*\z", " ' "),
    (r"\A\s*'", " ` "),
    (r"(\S)'\s", "$1 ' "),
    (r"\s'(\S)", " ` $1"),
    ("'ll", " -CONTRACT-ll"),
    ("'re", " -CONTRACT-re"),
    ("'ve", " -CONTRACT-ve"),
    ("n't", " n-CONTRACT-t"),
    ("'LL", " -CONTRACT-LL"),
    ("'RE", " -CONTRACT-RE"),
    ("'VE", " -CONTRACT-VE"),
    ("N'T", " N-CONTRACT-T"),
    ("cannot", "can not"),
    ("Cannot", "Can not"),
)
RUN_AND_COMMA_RULES = (
    (r"(\.{2,})", " $1 "),
    (r"(-{2,})", " $1 "),
    (r"(\D),(\D)", "$1 , $2"),
    (r"(\d),(\D)", "$1 , $2"),
    (r"(\D),(\d)", "$1 , $2"),
)
APOSTROPHE_RULES = {
    "en": (
        ("([^a-zA-Z])'([^a-zA-Z])", "$1 ' $2"),
        (r"(\W)'([a-zA-Z])", "$1 ' $2"),
        ("([a-zA-Z])'([^a-zA-Z])", "$1 ' $2"),
        ("([a-zA-Z])'([a-zA-Z])", "$1 '$2"),
        (r"(\d)'(s)", "$1 '$2"),
        (r" '\s+s ", " 's "),
        (r" '\s+s ", " 's "),
    ),
    "fr": (
        ("([^a-zA-Z])'([^a-zA-Z])", "$1 ' $2"),
        ("([^a-zA-Z])'([a-zA-Z])", "$1 ' $2"),
        ("([a-zA-Z])'([^a-zA-Z])", "$1 ' $2"),
        ("([a-zA-Z])'([a-zA-Z])", "$1' $2"),
    ),
}
QUOTE_PAIR_RULE = ("' '", "''")


def whitespace_tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def rewrite_rules(lang: str, ptb: bool) -> tuple:
    """The rules that run before the sentence is cut into words."""
    if lang not in APOSTROPHE_RULES:
        raise ValueError(f"no tokenizer rules for language {lang!r}")
    return (*OPENING_RULES, *(TREEBANK_RULES if ptb else ()), *RUN_AND_COMMA_RULES,
            *APOSTROPHE_RULES[lang], QUOTE_PAIR_RULE)


def _final_dot_pattern(lang: str) -> str:
    """A word's final dot, unless the word is a dot run, an abbreviation, or a number follows.

    Words are separated by single spaces. An abbreviation is a listed prefix or a stem that holds
    both a dot and a letter.
    """
    stop = r"\.(?: |\z)"
    listed = "|".join(p.replace(".", r"\.") for p in NONBREAKING_PREFIXES[lang])
    not_listed = f"(?!(?:{listed}){stop})" if listed else ""
    return (rf"(?<![^ ])(?=[^ ]+{stop})(?!\.+(?: |\z)){not_listed}"
            rf"(?![^ ]*\.[^ ]*[a-zA-Z][^ ]*{stop})(?![^ ]*[a-zA-Z][^ ]*\.[^ ]*{stop})"
            r"([^ ]+)\.(?=\z| (?![0-9]))")


def ptb_tokens(text: Column, lang: str = "en", ptb: bool = False) -> Column:
    """Penn-Treebank-style tokens; ``ptb`` adds bracket, quote and contraction conventions."""
    if lang not in APOSTROPHE_RULES:
        raise ValueError(f"no tokenizer rules for language {lang!r}")
    dots, dashes, *commas = RUN_AND_COMMA_RULES
    opening, pipe, slash = OPENING_RULES
    out = _replaced(F.concat(F.lit(" "), strip(text), F.lit(" ")), opening)
    out = _where("/", F.replace(out, F.lit("|"), F.lit(pipe[1])), slash)
    if ptb:
        out = _replaced(out, *TREEBANK_RULES)
    out = _where("--", _where("..", out, dots), dashes)
    out = _where(",", out, *commas)
    out = _where("'", out, *APOSTROPHE_RULES[lang], QUOTE_PAIR_RULE)
    out = F.trim(_replaced(out, (f"{SPACE}+", " ")))
    out = _where(".", out, (_final_dot_pattern(lang), "$1 ."))
    # single spaces are the only blanks left
    out = F.replace(F.replace(out, F.lit("' '"), F.lit("''")), F.lit("-CONTRACT-"), F.lit("'"))
    return F.array_remove(F.split(out, " "), "")


def _replaced(text: Column, *rules) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _where(needle: str, text: Column, *rules) -> Column:
    """The rules, each of which can only match around ``needle``, tried on texts that hold it."""
    return let(text, lambda x: F.when(F.contains(x, F.lit(needle)), _replaced(x, *rules)).otherwise(x))


def tokenize_all(df, columns: list[str], lang: str = "en", ptb: bool = False):
    """Replace text columns by their token arrays."""
    return df.withColumns({c: ptb_tokens(F.col(c), lang, ptb) for c in columns})
