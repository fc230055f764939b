"""Character offsets to token offsets for annotations on untokenized sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from redpencil.functions.tokenizer import ptb_tokens


def token_offset(sentence: Column, char_offset: Column) -> Column:
    """Number of tokens of the prefix; a cut token counts as one."""
    return F.size(ptb_tokens(F.substring(sentence, F.lit(1), char_offset)))


def token_spans(df: DataFrame, sentence: str = "sentence", start: str = "start_off", end: str = "end_off") -> DataFrame:
    """Add ``tok_start, tok_end`` to rows with a sentence and a character span."""
    return df.select(
        "*", token_offset(F.col(sentence), F.col(start)).alias("tok_start"),
        token_offset(F.col(sentence), F.col(end)).alias("tok_end"))


def tokenized_text(text: Column) -> Column:
    return F.array_join(ptb_tokens(text), " ")


def tokenize_corrections(corrections: Column) -> Column:
    """Tokenize each of several ``||``-separated corrections."""
    return F.array_join(F.transform(F.split(corrections, r"\|\|"), tokenized_text), "||")


def convert_blocks(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Rewrite blocks of S and A lines from character to token offsets.

    The rewritten S line is the tokenized sentence; an A line gets token offsets and tokenized
    corrections; other lines pass. Offsets refer to the nearest S line above. Blocks are cut before
    their S lines, so each line is looked at once with its sentence; nothing is shuffled.
    """
    def rewritten(line: Column, sentence: Column) -> Column:
        fields = F.split(F.substring(line, F.lit(3), F.length(line)), r"\|\|\|")
        offsets = F.split(F.trim(F.get(fields, F.lit(0))), r"\s+")
        place = lambda k: token_offset(sentence, F.get(offsets, F.lit(k)).cast("int")).cast("string")
        annotation = F.concat(F.lit("A "), F.array_join(F.concat(
            F.array(F.concat(place(0), F.lit(" "), place(1)), F.get(fields, F.lit(1)),
                    tokenize_corrections(F.get(fields, F.lit(2)))),
            F.slice(fields, F.lit(4), F.greatest(F.size(fields) - 3, F.lit(0)))), "|||"))
        return F.when(line.startswith("S "), F.concat(F.lit("S "), tokenized_text(sentence))).when(
            line.startswith("A "), annotation).otherwise(line)

    def part(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        sentence = F.when(head.startswith("S "), F.substring(head, F.lit(3), F.length(head))).otherwise("")
        return F.array_join(F.transform(F.split(piece, "\n"), lambda line: rewritten(line, sentence)), "\n")
    keys = [c for c in blocks.columns if c != text]
    new = F.array_join(F.transform(F.split(F.col(text), r"\n(?=S )"), part), "\n")
    return blocks.where(F.col(text).isNotNull()).select(*keys, new.alias(text))
