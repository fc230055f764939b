"""Cost-balanced packing of token sequences for training.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n``, as attention stays within a piece. Documents
in descending order of cost go to the sequence of the lowest cost that has token capacity left, and are cut where it
ends. Only the last tokens of a partition fill no sequence: they are cut to lengths that are powers of two, which
are not padded.

Each partition packs its own documents, a bounded block of tokens at a time, so nothing is shuffled, and a lost task
is repeated alone with the same result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from redpencil.llm.word_tokens import word_encoder

CAPACITY = 4096
END_ID = 2
#: Tokens that a task holds before it packs them; those that fill no sequence go on to the next block.
BLOCK_TOKENS = 2_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_length int, ids binary")
#: Sequence ids of a partition start at its number times this.
IDS_PER_PARTITION = 1 << 33

Piece = tuple[int, int, int]         # document, first token, tokens


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(pieces: list[Piece], capacity: int = CAPACITY) -> tuple[list[list[Piece]], list[Piece]]:
    """Sequences that are full to the last token, and pieces of fewer tokens than the capacity that are left."""
    full = [[(d, s + k, capacity)] for d, s, n in pieces for k in range(0, n - n % capacity, capacity)]
    rest = [(d, s + n - n % capacity, n % capacity) for d, s, n in pieces if n % capacity]
    members: list[list[Piece]] = [[] for _ in range(sum(n for *_, n in rest) // capacity)]
    room = [capacity] * len(members)
    lowest = [(0.0, k) for k in range(len(members))]
    left = []
    for d, s, n in sorted(rest, key=lambda p: (-cost(p[2]), p)):
        while n and lowest:
            spent, k = lowest[0]
            part = min(n, room[k])
            members[k].append((d, s, part))
            s, n, room[k] = s + part, n - part, room[k] - part
            if room[k]:
                heapq.heapreplace(lowest, (spent + cost(part), k))
            else:
                heapq.heappop(lowest)
        if n:
            left.append((d, s, n))
    return full + members, left


def powers(pieces: list[Piece], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Sequences whose lengths are the powers of two that add up to the pieces' tokens."""
    out, left = [], list(reversed(pieces))
    total = sum(n for *_, n in pieces)
    for size in (1 << k for k in reversed(range(capacity.bit_length())) if total >> k & 1):
        members = []
        while size:
            d, s, n = left.pop()
            part = min(n, size)
            members.append((d, s, part))
            size -= part
            if n > part:
                left.append((d, s + part, n - part))
        out.append(members)
    return out


class _Block:
    """Documents whose tokens a task holds."""

    def __init__(self, first_sequence: int, keep_ids: bool):
        self.docs: dict[int, tuple[int | None, int, bytes, int]] = {}   # id, all tokens, held ids, first held token
        self.pieces: list[Piece] = []
        self.tokens, self.added, self.next_sequence, self.keep_ids = 0, 0, first_sequence, keep_ids

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs[self.added] = (doc_id, n, ids, 0)
        self.pieces.append((self.added, 0, n))
        self.added, self.tokens = self.added + 1, self.tokens + n

    def flush(self, last: bool) -> pa.RecordBatch:
        sequences, left = assign(self.pieces)
        if last:
            sequences, left = sequences + powers(left), []
        columns: list[list] = [[] for _ in range(9)]
        for members in sequences:
            offset, length = 0, sum(n for *_, n in members)
            for d, s, n in members:
                doc_id, tokens, ids, held = self.docs[d]
                own = ids[4 * (s - held):4 * (s - held + n)]
                row = (doc_id, s, n, zlib.crc32(own), tokens, self.next_sequence, offset, length,
                       own if self.keep_ids else None)
                for column, value in zip(columns, row):
                    column.append(value)
                offset += n
            self.next_sequence += 1
        held = {d: s for d, s, _ in left}
        self.docs = {d: (self.docs[d][0], self.docs[d][1], self.docs[d][2][4 * (s - self.docs[d][3]):], s)
                     for d, s in held.items()}
        self.pieces, self.tokens = left, sum(n for *_, n in left)
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
         keep_ids: bool = True) -> DataFrame:
    """One row per piece: its document, first token, tokens, checksum, and place in its sequence.

    A document is its whole text's ids and the end id; a null or empty text is the end id alone. Repeated rows are
    packed each on their own, null document ids stay null, an empty table gives no rows. Other columns are not read.
    ``ids`` holds the piece's ids as little-endian 32-bit numbers, or null without ``keep_ids``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        block = _Block(TaskContext.get().partitionId() * IDS_PER_PARTITION, keep_ids)
        for batch in batches:
            for row_id, row_text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(row_id, encoder.encode(row_text.as_py()) + end)
                if block.tokens >= BLOCK_TOKENS:
                    yield block.flush(last=False)
        if block.pieces:
            yield block.flush(last=True)

    source = docs.select(F.col(doc_id).cast("long"), F.col(text))
    return source.mapInArrow(run, SCHEMA)
