import random

import numpy as np
import pytest
import sentencepiece

from redpencil.llm.sentencepiece_codec import PieceCodec, decode, encode

ALPHABET = "ab  the▁\n\t\0é😀ñ<0x>s/.,中文字ing▁▁"


@pytest.fixture(scope="module")
def own(pieces_model):
    return PieceCodec(pieces_model)


@pytest.fixture(scope="module")
def library(pieces_model):
    return sentencepiece.SentencePieceProcessor(model_file=pieces_model)


def ids(own, text):
    return np.frombuffer(own.encode(text), "<i4").tolist()


def test_random_texts(own, library):
    r = random.Random(1)
    pieces = list(own.ids)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(r.choice(pieces) for _ in range(r.randint(1, 6))) for _ in range(5000)]
    texts += ["", " ", "   ", "<s>", "▁", "a" * 5000, "\n" * 99, "the" * 3000]
    for text in texts:
        assert ids(own, text) == library.encode(text)
        assert own.decode(library.encode(text)) == library.decode(library.encode(text))


def test_random_ids(own, library):
    r = random.Random(2)
    for _ in range(5000):
        some = [r.randrange(0, r.choice([300, 32000])) for _ in range(r.randint(0, 6))]
        assert own.decode(some) == library.decode(some)


def test_border_check_equals_merging(own):
    r = random.Random(3)
    pieces = list(own.ids)
    for _ in range(20000):
        left, right = r.choice(pieces), r.choice(pieces)
        assert own.compatible(left, right) == (own.merged(left + right) == [left, right])


def test_columns(spark, pieces_model, library):
    texts = [None, "", "a b", "a b", "naïve  x\n", "x " * 50000]
    rows = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, ids int")
    out = rows.select("doc_id", encode("text", pieces_model).alias("found")).withColumn("back", decode("found", pieces_model))
    for row in out.collect():
        text = texts[row.doc_id] or ""
        assert row.found == library.encode(text)
        assert row.back == text
    assert rows.limit(0).select(encode("text", pieces_model)).count() == 0


def test_whole_table(documents, pieces_model, library):
    for row in documents.select("text", encode("text", pieces_model).alias("found")).collect():
        assert row.found == library.encode(row.text or "")
