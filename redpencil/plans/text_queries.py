"""Registered queries over text columns: prompts, cleaning, tokens, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from redpencil.functions import prompts, text, tokenizer
from redpencil.operators import correct, offsets
from redpencil.plans.inputs import (
    CORPUS, RESPONSES, SENTENCES, corpus, responses, sentences, sql_strip, sql_tokens, table)
from redpencil.functions.text import WS


def _prompt(build):
    return lambda spark, sf: build(corpus(spark, sf))


def _clean(expr):
    return lambda spark, sf: responses(spark, sf).select("sent_id", expr(F.col("raw")).alias("result"))


def _clean_sql(expr: str) -> str:
    return f"{RESPONSES} SELECT sent_id, {expr} AS result FROM resp"


def sql_gap(t: str) -> str:
    return rf"regexp_replace({t}, '(?s)\A(.*\p{{L}} .?).*\z', '\1')"


def sql_normalize(t: str) -> str:
    return f"regexp_replace({t}, '{WS}+', ' ', 'g')"


def sql_line(t: str, k: int) -> str:
    return f"string_split({t}, chr(10))[{k + 1}]"


def sql_clean_sentence(t: str) -> str:
    bare = f"replace({t}, 'Corrected: ', '')"
    cut = sql_strip(f"left({bare}, len({bare}) - 1)")
    return f"""CASE WHEN ends_with({bare}, '"') THEN {cut} ELSE {bare} END"""


def sql_punctuation(t: str) -> str:
    run = r"[!-/:-@\[-`{-~ ]"
    return rf"regexp_replace({t}, '(?s)({run}{{2}}){run}*\z', '\1')"


def sql_llama(t: str) -> str:
    return sql_normalize(f"replace({sql_gap(sql_line(t, 1))}, 'Corrected: ', '')")


def sql_mpt(t: str) -> str:
    cleaned = sql_punctuation(sql_clean_sentence(sql_line(t, 1)))
    return sql_normalize(f"replace(replace(replace({cleaned}, '</s>', ' '), '</s', ' '), '</', ' ')")


def sql_response(t: str) -> str:
    lines = f"string_split({t}, chr(10))"
    head = f"list_position(list_transform({lines}, lambda x: contains(x, '### Response:')), true)"
    first = (f"list_filter({lines}[{head} + 1:], lambda x: NOT contains(x, '### Response:') "
             f"AND {sql_strip('x')} <> '')[1]")
    return f"CASE WHEN {head} > 0 THEN coalesce({sql_strip(first)}, '') ELSE '' END"


def sql_ptb(t: str, lang: str = "en", ptb: bool = False) -> str:
    """The tokenizer as SQL; a comma list of tokens is rejoined by spaces."""
    out = f"' ' || {sql_strip(t)} || ' '"
    for pattern, replacement in tokenizer.rewrite_rules(lang, ptb):
        pattern, replacement = pattern.replace("'", "''"), replacement.replace("'", "''").replace("$", "\\")
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    prefixes = ", ".join(f"'{p}'" for p in tokenizer.NONBREAKING_PREFIXES[lang])
    in_list = f"list_contains([{prefixes}], left(x, len(x) - 1))" if prefixes else "false"
    words = sql_tokens(out)
    stem = "left(x, len(x) - 1)"
    return (
        f"list_transform([{words}], lambda ws: array_to_string(list_transform(ws, lambda x, i: CASE "
        rf"WHEN NOT regexp_matches(x, '\A\S+\.\z') OR regexp_matches(x, '\A\.+\z') THEN x "
        rf"WHEN contains({stem}, '.') AND regexp_matches({stem}, '[a-zA-Z]') THEN x "
        rf"WHEN {in_list} OR coalesce(regexp_matches(ws[i + 1], '\A\d'), false) THEN x "
        f"ELSE {stem} || ' .' END), ' '))[1]")


def sql_ptb_tokens(t: str, lang: str = "en", ptb: bool = False) -> str:
    joined = sql_ptb(t, lang, ptb)
    return sql_tokens(rf"replace(regexp_replace({joined}, '''\s+''', '''''', 'g'), '-CONTRACT-', '''')")


def _docs(expr, *extra):
    return lambda spark, sf: table(spark, sf, "documents").select("doc_id", expr(F.col("text")).alias("result"))


def rule_model():
    """A stand-in model for tests: answers each prompt with its sentence in upper-case first letters."""
    def answer(batch):
        out = []
        for p in batch:
            sentence = p.partition("GEC: ")[2].rpartition("\nCorrected:")[0]
            out.append(f"{p} {sentence.replace(' the ', ' a ')} ok </s>" if sentence else p)
        return out
    return answer


def _correct(spark, sf):
    rows = sentences(spark, sf).select("sent_id", F.col("source").alias("text"))
    return correct.correct(rows, rule_model, lambda raw: text.sft_answer(raw, "llama"))


def _spans(spark, sf):
    rows = sentences(spark, sf).select(
        "sent_id", F.col("source").alias("sentence"), F.floor(F.length("source") / 3).cast("int").alias("start_off"),
        F.floor(F.length("source") * 2 / 3).cast("int").alias("end_off"))
    return offsets.token_spans(rows).select("sent_id", "tok_start", "tok_end")


# Fixed text of the two zero-shot prompts and the chat wrapper, as SQL.
def _template_sql(template: str) -> str:
    return "'" + template.replace("'", "''").replace("{source}", "' || source || '") \
        .replace("{target}", "' || target || '") + "'"


_C = f"WITH {CORPUS} SELECT pair_id, "
_S = f"WITH {SENTENCES} SELECT sent_id, "
_CP_IN, _CP_OUT = "éèêçüöä", "\x80\x85\x8a\x93\x97\x99\x9f"
_CP_FIXED = "€…Š“—™Ÿ"

QUERIES = {
    "b1_sft_text": (
        _prompt(lambda c: c.select("pair_id", prompts.sft_text(F.col("source"), F.col("target")).alias("text"))),
        _C + "'<s> GEC: ' || source || chr(10) || 'Corrected: ' || coalesce(target, source) || ' </s>' AS text FROM corpus"),
    "b2_rl_prompt": (
        _prompt(lambda c: c.select("pair_id", prompts.rl_prompt(F.col("source")).alias("text"))),
        _C + "'GEC: ' || source || chr(10) || 'Corrected:' AS text FROM corpus"),
    "b3_reward_query": (
        _prompt(lambda c: c.select("pair_id", prompts.reward_query(F.col("source"), F.col("target")).alias("query"))),
        _C + "'source: ' || source || ' ' || chr(10) || ' target: ' || target AS query FROM corpus"),
    "b4_inference_prompt": (
        _prompt(lambda c: c.select("pair_id", prompts.inference_prompt(F.col("source")).alias("text"))),
        _C + "'<s> GEC: ' || source || chr(10) || 'Corrected:' AS text FROM corpus"),
    "b5_zero_shot_sentence": (
        _prompt(lambda c: c.select("pair_id", prompts.zero_shot_sentence(F.col("source")).alias("text"))),
        _C + _template_sql(prompts.ZERO_SHOT_SENTENCE) + " AS text FROM corpus"),
    "b6_zero_shot_instruction": (
        _prompt(lambda c: c.select("pair_id", prompts.zero_shot_instruction(F.col("source")).alias("text"))),
        _C + _template_sql(prompts.ZERO_SHOT_INSTRUCTION) + " AS text FROM corpus"),
    "b7_chat_wrapper": (
        _prompt(lambda c: c.select("pair_id", prompts.chat(F.lit("Be brief."), F.col("source")).alias("text"))),
        _C + "chr(10) || '[INST] <<SYS>>' || chr(10) || 'Be brief.' || chr(10) || '<</SYS>>' || chr(10) || source "
             "|| ' [/INST]' || chr(10) AS text FROM corpus"),

    "d1_normalize": (_clean(text.normalize), _clean_sql(sql_normalize("raw"))),
    "d1_normalize_intended": (
        _clean(lambda c: text.normalize(c, "intended")),
        _clean_sql(sql_normalize(
            r"regexp_replace(replace(replace(regexp_replace(raw, ' '' (.*?) '' ', ' ''\1'' ', 'g'), ' - ', '-'), ' / ', '/'),"
            r" '([\]\[(){}<>])', ' \1 ', 'g')"))),
    "d2_model_response": (
        _clean(text.model_response),
        _clean_sql("CASE WHEN contains(raw, '<<SYS>>') AND contains(split_part(raw, '<<SYS>>', 2), '<</SYS>>') THEN "
                   + sql_strip("split_part(split_part(raw, '<<SYS>>', 2), '<</SYS>>', 1)") + " END")),
    "d2_model_response_text": (
        _clean(lambda c: text.model_response(c, text.MISSING_MARKERS_TEXT)),
        _clean_sql("CASE WHEN contains(raw, '<<SYS>>') AND contains(split_part(raw, '<<SYS>>', 2), '<</SYS>>') THEN "
                   + sql_strip("split_part(split_part(raw, '<<SYS>>', 2), '<</SYS>>', 1)")
                   + " ELSE 'Model response markers not found.' END")),
    "d3_after_instruction": (
        _clean(text.after_instruction),
        _clean_sql("CASE WHEN strpos(raw, '[/INST]') > 0 THEN substr(raw, strpos(raw, '[/INST]') + 7) END")),
    "d4_strip_prompt": (
        _clean(lambda c: text.strip_prompt(c, "<s> GEC:")),
        _clean_sql(rf"regexp_replace(CASE WHEN starts_with(raw, '<s> GEC:') THEN substr(raw, 9) ELSE raw END, '\A{WS}+', '')")),
    "d5_clean_sentence": (_clean(text.clean_sentence), _clean_sql(sql_clean_sentence("raw"))),
    "d6_clean_punctuation": (_clean(text.clean_punctuation), _clean_sql(sql_punctuation("raw"))),
    "d7_cut_after_last_word_gap": (_clean(text.cut_after_last_word_gap), _clean_sql(sql_gap("raw"))),
    "d8_instruction_response": (_clean(text.instruction_response), _clean_sql(sql_response("raw"))),
    "d9_line": (_clean(lambda c: text.line(c, 1)), _clean_sql(sql_line("raw", 1))),
    "d10_line_slice": (
        _clean(text.line_slice),
        _clean_sql(f"substr({sql_line('raw', 4)}, 8, greatest(len({sql_line('raw', 4)}) - 11, 0))")),
    "d11_erase_end_markers": (
        _clean(text.erase_end_markers),
        _clean_sql("replace(replace(replace(raw, '</s>', ' '), '</s', ' '), '</', ' ')")),
    "d12_sft_answer_llama": (_clean(lambda c: text.sft_answer(c, "llama")), _clean_sql(sql_llama("raw"))),
    "d12_sft_answer_mpt": (_clean(lambda c: text.sft_answer(c, "mpt")), _clean_sql(sql_mpt("raw"))),
    "d12_sft_answer_falcon": (_clean(lambda c: text.sft_answer(c, "falcon")), _clean_sql(sql_mpt("raw"))),
    "d13_rl_answer": (
        _clean(text.rl_answer),
        _clean_sql("replace(" + sql_gap(f"CASE WHEN contains(raw, chr(10)) THEN {sql_line('raw', 1)} ELSE raw END")
                   + ", 'Corrected: ', '')")),
    "d14_or_source": (
        lambda spark, sf: responses(spark, sf).select("sent_id", text.or_source(
            text.sft_answer(F.col("raw"), "llama"), F.col("source")).alias("result")),
        _clean_sql(f"coalesce({sql_llama('raw')}, source)")),
    "d15_reward_answer": (
        _clean(text.reward_answer),
        _clean_sql("replace(" + sql_gap(sql_line("raw", 0)) + ", 'Corrected', '')")),

    "e1_whitespace_tokens": (
        _docs(tokenizer.whitespace_tokens),
        f"SELECT doc_id, {sql_tokens('text')} AS result FROM documents"),
    "e2_ptb_tokens": (
        _docs(tokenizer.ptb_tokens),
        f"SELECT doc_id, {sql_ptb_tokens('text')} AS result FROM documents"),
    "e2_ptb_tokens_treebank": (
        lambda spark, sf: table(spark, sf, "pages").select(
            "page_id", tokenizer.ptb_tokens(F.col("html"), "en", True).alias("result")),
        f"SELECT page_id, {sql_ptb_tokens('html', 'en', True)} AS result FROM pages"),
    "e2_ptb_tokens_fr": (
        _docs(lambda c: tokenizer.ptb_tokens(c, "fr")),
        f"SELECT doc_id, {sql_ptb_tokens('text', 'fr')} AS result FROM documents"),
    "e2_tokenize_all": (
        lambda spark, sf: tokenizer.tokenize_all(table(spark, sf, "conversations").select("conv_id", "turn", "text"), ["text"]),
        f"SELECT conv_id, turn, {sql_ptb_tokens('text')} AS text FROM conversations"),
    "e3_token_spans": (
        _spans,
        f"{_S} len({sql_ptb_tokens('substr(source, 1, len(source) // 3)')}) AS tok_start, "
        f"len({sql_ptb_tokens('substr(source, 1, len(source) * 2 // 3)')}) AS tok_end FROM sent"),
    "e4_tokenize_corrections": (
        lambda spark, sf: sentences(spark, sf).select("sent_id", offsets.tokenize_corrections(
            F.concat("source", F.lit("||"), F.lower("source"))).alias("result")),
        f"{_S} array_to_string(list_transform(string_split(source || '||' || lower(source), '||'), "
        f"lambda c: array_to_string({sql_ptb_tokens('c')}, ' ')), '||') AS result FROM sent"),

    "i4_is_ascii": (
        _docs(text.is_ascii), r"SELECT doc_id, regexp_matches(text, '\A[\x00-\x7F]*\z') AS result FROM documents"),
    "i6_fix_cp1252": (
        _docs(lambda c: text.fix_cp1252(F.translate(c, _CP_IN, _CP_OUT))),
        f"SELECT doc_id, translate(text, '{_CP_IN}', '{_CP_FIXED}') AS result FROM documents"),
    "i7_keep_printable_ascii": (
        _docs(text.keep_printable_ascii),
        r"SELECT doc_id, regexp_replace(text, '[^\x20-\x7E]', '', 'g') AS result FROM documents"),
    "j1_correct": (
        _correct,
        f"{_S} coalesce(" + sql_normalize("replace(" + sql_gap(
            "'Corrected: ' || replace(source, ' the ', ' a ') || ' ok </s>'") + ", 'Corrected: ', '')")
        + ", source) AS corrected, source AS text FROM sent"),
}
