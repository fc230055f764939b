import os

import pytest

from redpencil.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(DATA):
        pytest.skip("test tables absent")
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def pieces_model():
    return tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def words_model():
    return tokenizer_path("word_bpe_49k.json")
