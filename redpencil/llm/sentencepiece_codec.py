"""Encoding and decoding with a SentencePiece model of the merge type, on Arrow batches.

The encoder does not merge a text from its characters. It walks the text from the left with the longest pieces that
an Aho-Corasick automaton finds, accepts a piece only if re-merging it with its left neighbour gives back exactly
the two, steps to the next shorter piece otherwise, and keeps a bitfield of positions from which no way leads on.
A sequence whose neighbours are all compatible is the one that merging gives, so the result is exact.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

SPACE = "▁"
#: Entries that a worker remembers before it starts anew; bounds memory, not results.
REMEMBERED = 500_000
NEVER = 1 << 62


class PieceCodec:
    """A model's pieces with what encoding and decoding need."""

    def __init__(self, model_path: str):
        import ahocorasick
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as file:
            model.ParseFromString(file.read())
        spec, kinds = model.normalizer_spec, model.trainer_spec
        plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and spec.escape_whitespaces
        if kinds.model_type != 2 or not kinds.byte_fallback or not plain or spec.remove_extra_whitespaces:
            raise ValueError("only merge-type models with byte fallback and no normalization are supported")
        if any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == 1}
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6}
        self.raw = [None] * len(model.pieces)        # bytes of each piece; none for unknown and control pieces
        for i, p in enumerate(model.pieces):
            if p.type in (1, 6):
                self.raw[i] = bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.replace(SPACE, " ").encode()
        self.spaced = [p.type == 1 and p.piece[0] == SPACE for p in model.pieces]
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1:
                self.automaton.add_word(piece, (len(piece) - 1, piece))
        self.automaton.make_automaton()
        # No piece holds a space after another character, and some characters are in no piece: no merge reaches
        # over these places, so the units between them are encoded on their own and remembered.
        known = set("".join(self.ids))
        crossing = any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.ids)
        lone = "".join(re.escape(chr(c)) for c in range(1, 128) if chr(c) not in known)
        if crossing:
            self.units = re.compile(r"(?s).+")
        elif lone:
            self.units = re.compile(f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+|[{lone}]")
        else:
            self.units = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.order = {p: k for k, p in enumerate(sorted(self.cost, key=self.cost.__getitem__)) if len(p) > 1}
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 1, -1) if p[:n] in self.ids), p[0]) for p in self.order}
        self.halves: dict[str, tuple[str, str]] = {}  # the two symbols whose merge completes a piece
        self.encoded: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: always the cheapest neighbours, the first of equals."""
        parts, order = list(text), self.order
        while len(parts) > 1:
            ranks = [order.get(x + y, NEVER) for x, y in zip(parts, parts[1:])]
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            if len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves_of(self, piece: str) -> tuple[str, str] | None:
        """None for a piece that merging its own characters doesn't give."""
        if piece not in self.halves and self.merged(piece) != [piece]:
            self.halves[piece] = None
        return self.halves[piece]

    def reachable(self, piece: str) -> bool:
        return len(piece) == 1 or self.halves_of(piece) is not None

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives the two again.

        Only merges over the border can spoil that. From the two pieces back to their characters, the last merge
        on either side is undone, and a merge of the symbols at the border must not have come before it.
        """
        if len(self.pairs) > REMEMBERED:
            self.pairs.clear()
        known = self.reachable(right) and (not left or self.reachable(left) and self.border_holds(left, right))
        self.pairs[left, right] = known
        return known

    def border_holds(self, left: str, right: str) -> bool:
        before = NEVER
        while True:
            if self.order.get(left + right, NEVER) < before:
                return False
            of_left, of_right = self.order.get(left, -1), self.order.get(right, -1)
            if of_left < 0 and of_right < 0:
                return True
            if of_left > of_right:                   # of equal merges the left one comes first
                before, left = of_left, self.halves_of(left)[1]
            else:
                before, right = of_right + 1, self.halves_of(right)[0]

    def split(self, unit: str) -> list[str]:
        longest = list(unit)                         # a character is always a symbol, even one outside the model
        for end, (back, piece) in self.automaton.iter(unit):
            longest[end - back] = piece              # later ends are longer
        size, pairs, shorter = len(unit), self.pairs, self.shorter
        failed = 0                                   # bit k: from position k no way leads to the end
        taken: list[str] = []
        at, left, piece = 0, "", longest[0]
        while True:
            end = at + len(piece)
            if not failed or not failed >> end & 1:
                fits = pairs.get((left, piece))
                if fits is None:
                    fits = self.compatible(left, piece)
                if fits:
                    taken.append(piece)
                    if end == size:
                        return taken
                    at, left, piece = end, piece, longest[end]
                    continue
            if len(piece) > 1:
                piece = shorter[piece]
            else:                                    # nothing fits here: give up this position and the piece before it
                failed |= 1 << at
                piece = taken.pop()
                at -= len(piece)
                left = taken[-1] if taken else ""

    def unit_ids(self, unit: str) -> bytes:
        """The unit's ids as little-endian 32-bit numbers."""
        pieces = self.split(unit)
        out = list(map(self.ids.get, pieces))
        if None in out:                              # characters outside the model become their bytes
            out = [i for k, p in zip(out, pieces) for i in ([k] if k is not None else map(self.byte_ids.get, p.encode()))]
        return array("i", out).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        units = self.units.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.encoded.get, units))
        if None in found:
            if len(self.encoded) > REMEMBERED:
                self.earlier, self.encoded = self.encoded, {}
            remembered, earlier = self.encoded, self.earlier
            for k, unit in enumerate(units):
                if found[k] is None:
                    ids = earlier.get(unit) or remembered.get(unit) or self.unit_ids(unit)
                    found[k] = ids
                    if len(unit) <= 64:
                        remembered[unit] = ids
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        try:
            text = b"".join(map(self.raw.__getitem__, ids)).decode()
        except (TypeError, UnicodeDecodeError, IndexError):   # unknown and control pieces, byte runs that are no text
            return self.library.decode(ids)
        return text[1:] if ids and self.spaced[ids[0]] else text


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def encode(text: Column | str, model_path: str) -> Column:
    """Ids of each whole text, without begin or end ids; null and empty texts give an empty array."""
    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        own = codec(model_path)
        found = [own.encode(t.as_py()) for t in texts]
        ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int64)
        if ends[-1] > 2**31 - 1:
            raise ValueError("too many ids in one batch; lower spark.sql.execution.arrow.maxRecordsPerBatch")
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
    return run(F.col(text) if isinstance(text, str) else text)


def decode(ids: Column | str, model_path: str) -> Column:
    """The text of each id array; null and empty arrays give an empty text. Null ids are left out."""
    @F.arrow_udf("string")
    def run(arrays: pa.Array) -> pa.Array:
        own = codec(model_path)
        out = []
        for x in arrays:
            values = x.values
            if values is None or not len(values):
                out.append("")
                continue
            out.append(own.decode((values.drop_null() if values.null_count else values).to_numpy().tolist()))
        return pa.array(out, pa.string())
    return run(F.col(ids) if isinstance(ids, str) else ids)
