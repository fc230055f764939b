"""String columns: whitespace, normalization, model-response cleaning and encoding repair.

All functions take and return a Column built from native expressions, so they stay inside
whole-stage code generation and keep nulls as nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The whitespace class of Unicode strings (Spark's trim cuts only U+0020).
SPACE_CHARS = (r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS = f"[{SPACE_CHARS}]"
# The same class for Spark's regular expressions: visible ASCII characters fail at the first comparison.
SPACE = f"[[^!-~]&&{WS}]"
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Retokenization rules of the score normalizer, in order ('.' stops at '\n' only).
NORMALIZE_RULES = (
    (r"(?d) ' (.*?) ' ", " '$1' "),
    (" - ", "-"),
    (" / ", "/"),
    (r"([\]\[(){}<>])", " $1 "),
    (f"{SPACE}+", " "),
)

# Markers and labels of prompts and responses.
SYS_OPEN, SYS_CLOSE = "<<SYS>>", "<</SYS>>"
INST_CLOSE = "[/INST]"
ANSWER_LABEL = "Corrected: "
ANSWER_WORD = "Corrected"
RESPONSE_HEADER = "### Response:"
END_MARKERS = ("</s>", "</s", "</")
MISSING_MARKERS_TEXT = "Model response markers not found."

# Windows-1252 code points that stand for other characters, and those characters.
CP1252_FROM = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252_TO = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def left_strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+", "")


def remove(text: Column, part: str) -> Column:
    return F.replace(text, F.lit(part), F.lit(""))


def _after(text: Column, position: Column, length: int) -> Column:
    return F.substring(text, position + length, F.length(text))


def normalize(text: Column, mode: str = "effective") -> Column:
    """Collapse whitespace; ``mode='intended'`` applies all retokenization rules in turn."""
    if mode not in ("effective", "intended"):
        raise ValueError(f"mode must be 'effective' or 'intended', not {mode!r}")
    for pattern, replacement in NORMALIZE_RULES if mode == "intended" else NORMALIZE_RULES[-1:]:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def model_response(text: Column, missing: str | None = None) -> Column:
    """Stripped text between the first system marker and the next closing one."""
    opened = F.instr(text, SYS_OPEN)
    rest = _after(text, opened, len(SYS_OPEN))
    closed = F.instr(rest, SYS_CLOSE)
    found = F.when((opened > 0) & (closed > 0), strip(F.substring(rest, F.lit(1), closed - 1)))
    return found if missing is None else F.when(text.isNotNull(), F.coalesce(found, F.lit(missing)))


def after_instruction(text: Column) -> Column:
    """Everything after the first instruction end marker, null without one."""
    at = F.instr(text, INST_CLOSE)
    return F.when(at > 0, _after(text, at, len(INST_CLOSE)))


def strip_prompt(text: Column, prompt: Column | str) -> Column:
    """Cut a known prompt from the front, then left-strip."""
    prompt = F.lit(prompt) if isinstance(prompt, str) else prompt
    cut = F.substring(text, F.length(prompt) + 1, F.length(text))
    return left_strip(F.when(F.startswith(text, prompt), cut).otherwise(text))


def clean_sentence(text: Column) -> Column:
    """Delete answer labels; cut one closing double quote and strip."""
    text = remove(text, ANSWER_LABEL)
    cut = strip(F.substring(text, F.lit(1), F.length(text) - 1))
    return F.when(F.endswith(text, F.lit('"')), cut).otherwise(text)


def clean_punctuation(text: Column) -> Column:
    """Keep at most two characters of a trailing run of ASCII punctuation and spaces."""
    run = r"[!-/:-@\[-`{-~ ]"
    return F.regexp_replace(text, rf"(?s)({run}{{2}}){run}*\z", "$1")


def cut_after_last_word_gap(text: Column) -> Column:
    """Keep the text up to one character past the last space that follows a letter."""
    return F.regexp_replace(text, r"(?s)\A(.*\p{L} .?).*\z", "$1")


def instruction_response(text: Column) -> Column:
    """First non-empty stripped line below a response header, '' without one."""
    lines = F.split(text, "\n")
    is_header = lambda line: F.contains(line, F.lit(RESPONSE_HEADER))
    header = F.array_position(F.transform(lines, is_header), F.lit(True))
    below = F.slice(lines, header + 1, F.size(lines))
    answers = F.filter(below, lambda line: ~is_header(line) & (strip(line) != ""))
    first = F.when(header > 0, strip(F.try_element_at(answers, F.lit(1))))
    return F.when(text.isNotNull(), F.coalesce(first, F.lit("")))


def line(text: Column, number: int) -> Column:
    """Line ``number`` (from zero), null when there are fewer lines."""
    return F.try_element_at(F.split(text, "\n"), F.lit(number + 1))


def line_slice(text: Column, number: int = 4, head: int = 7, tail: int = 4) -> Column:
    """Line ``number`` without its first ``head`` and last ``tail`` characters."""
    picked = line(text, number)
    return F.substring(picked, F.lit(head + 1), F.greatest(F.length(picked) - head - tail, F.lit(0)))


def erase_end_markers(text: Column) -> Column:
    for marker in END_MARKERS:
        text = F.replace(text, F.lit(marker), F.lit(" "))
    return text


def sft_answer(text: Column, model_type: str) -> Column:
    """Answer line of a fine-tuned model's decoded output, cleaned for scoring."""
    answer = line(text, 1)
    if model_type == "llama":
        answer = remove(cut_after_last_word_gap(answer), ANSWER_LABEL)
    elif model_type in ("mpt", "falcon"):
        answer = erase_end_markers(clean_punctuation(clean_sentence(answer)))
    else:
        raise ValueError(f"unknown model type {model_type!r}")
    return normalize(answer)


def rl_answer(text: Column) -> Column:
    """Answer of a reward-tuned model: line 1 if there is one, not normalized."""
    answer = F.when(F.contains(text, F.lit("\n")), line(text, 1)).otherwise(text)
    return remove(cut_after_last_word_gap(answer), ANSWER_LABEL)


def reward_answer(text: Column) -> Column:
    """First line of a sampled response, as compared when rewards are computed."""
    return remove(cut_after_last_word_gap(F.substring_index(text, "\n", 1)), ANSWER_WORD)


def or_source(cleaned: Column, source: Column) -> Column:
    """Fall back to the input sentence when nothing was extracted."""
    return F.coalesce(cleaned, source)


def squeeze_case(text: Column) -> Column:
    """Lower case without spaces (U+0020 only), the key that ignores whitespace and casing."""
    return F.lower(remove(text, " "))


def equal_ignoring_space_and_case(left: Column, right: Column) -> Column:
    return squeeze_case(left) == squeeze_case(right)


def is_ascii(text: Column) -> Column:
    return text.rlike(r"\A[\x00-\x7F]*\z")


def fix_cp1252(text: Column) -> Column:
    """Map stray Windows-1252 control characters to the characters they stand for."""
    return F.translate(text, CP1252_FROM, CP1252_TO)


def keep_printable_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x20-\x7E]", "")
