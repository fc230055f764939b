import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from redpencil.llm import packing
from redpencil.llm.word_tokens import WordEncoder

ALPHABET = "aB  the\n\t\r\v \u0085\x1ćéÉ😀ñΣσ<|endoftext|>'s 12.,中文字ing"


def test_words_equal_whole_texts(words_model):
    own = WordEncoder(words_model)
    whole = Tokenizer.from_file(words_model)
    r = random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(5000)]
    special = ["<|endoftext|>", "hello <|endoftext|> there", "a<|startoftext|>b \n<|endoftext|>,", "<|endoftext|><|startoftext|>", " <|EndOfText|>"]
    for text in [*texts, *special, "", " ", "it's 'S", "\n\n"]:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_assign_fills_sequences():
    r = random.Random(2)
    for _ in range(200):
        pieces = [(d, 0, r.choice([1, 2, 30, 100, 5000])) for d in range(r.randint(0, 60))]
        full, left = packing.assign(pieces, 128)
        assert all(sum(n for *_, n in s) == 128 for s in full)
        assert sum(n for *_, n in left) < 128
        tail = packing.powers(left, 128)
        assert all(sum(n for *_, n in s) in (1, 2, 4, 8, 16, 32, 64) for s in tail)
        check_cover({d: n for d, _, n in pieces}, full + tail)


def naive(pieces, capacity):
    """Every piece in turn, the costliest first, to the cheapest sequence with room, found by looking at all."""
    full = [[(d, s + k, capacity)] for d, s, n in pieces for k in range(0, n - n % capacity, capacity)]
    rest = [(d, s + n - n % capacity, n % capacity) for d, s, n in pieces if n % capacity]
    sequences = [[0.0, capacity, []] for _ in range(sum(n for *_, n in rest) // capacity)]
    for d, s, n in sorted(rest, key=lambda p: (-packing.cost(p[2]), p)):
        while n and any(x[1] for x in sequences):
            own = min((x for x in sequences if x[1]), key=lambda x: x[0])
            part = min(n, own[1])
            own[0], own[1] = own[0] + packing.cost(part), own[1] - part
            own[2].append((d, s, part))
            s, n = s + part, n - part
    return full + [x[2] for x in sequences]


def test_assign_equals_a_plain_search():
    r = random.Random(12)
    for _ in range(150):
        pieces = [(d, r.choice([0, 7]), r.choice([1, 2, 2, 30, 64, 100, 128, 5000])) for d in range(r.randint(0, 40))]
        full, _ = packing.assign(pieces, 128)
        assert sorted(full) == sorted(naive(pieces, 128))


def check_cover(lengths, sequences):
    seen = defaultdict(list)
    for members in sequences:
        for d, s, n in members:
            seen[d].append((s, n))
    assert set(seen) == set(lengths)
    for d, spans in seen.items():
        at = 0
        for s, n in sorted(spans):
            assert s == at and n > 0
            at += n
        assert at == lengths[d]


def test_costs_are_balanced():
    pieces = [(d, 0, n) for d, n in enumerate([2000] * 23 + [100] * 483)]
    full, _ = packing.assign(pieces)
    costs = [sum(packing.cost(n) for *_, n in s) for s in full]
    assert max(costs) < 1.25 * min(costs)


def test_pack(spark, documents, words_model):
    texts = [None, "", "a b", "a b", "word " * 20000, "x"]
    rows = spark.createDataFrame([(None if k == 5 else k % 4, t, 7) for k, t in enumerate(texts)],
                                 "doc_id long, text string, offset int")
    out = packing.pack(rows, words_model).collect()
    assert sum(r.length for r in out) == 1 + 1 + 3 + 3 + 20001 + 2
    check_table(out)
    assert packing.pack(rows.limit(0), words_model).count() == 0
    out = packing.pack(documents.repartition(3), words_model).collect()
    check_table(out)
    whole = Tokenizer.from_file(words_model)
    found = defaultdict(list)
    for r in out:
        found[r.doc_id].append((r.start, r.ids))
    for row in documents.collect():
        expected = np.array([*whole.encode(row.text, add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert b"".join(x for _, x in sorted(found[row.doc_id])) == expected


def check_table(rows):
    sequences = defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    for members in sequences.values():
        at = 0
        for offset, n, total in sorted(members):
            assert offset == at
            at += n
        assert at == members[0][2] <= 4096 and at & (at - 1) == 0
