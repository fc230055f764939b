"""Token ids of whole texts from a tokenizer file that drops white space, word by word."""

from __future__ import annotations

from array import array
from functools import lru_cache

#: Words that a worker remembers before it starts anew; bounds memory, not results.
REMEMBERED = 500_000


class WordEncoder:
    """Ids as little-endian 32-bit numbers.

    White space separates tokens and is dropped, so the words between blanks and line breaks are encoded on their
    own and remembered; all else, other kinds of white space too, is left to the tokenizer. Its special tokens hold no
    blanks and take none beside them, so their strings in a text get their ids as in whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        self.earlier: dict[str, bytes] = {}

    def encode(self, text: str | None) -> bytes:
        words = (text or "").replace("\n", " ").split(" ")
        found = list(map(self.words.get, words))
        if None in found:
            if len(self.words) > REMEMBERED:
                self.earlier, self.words = self.words, {"": b""}
            earlier = self.earlier
            unseen = {w: earlier.get(w) for w, x in zip(words, found) if x is None}
            missing = [w for w, x in unseen.items() if x is None]
            for w, e in zip(missing, self.tokenizer.encode_batch_fast(missing, add_special_tokens=False)):
                unseen[w] = array("I", e.ids).tobytes()
            found = [unseen[w] if x is None else x for w, x in zip(words, found)]
            self.words.update((w, x) for w, x in unseen.items() if len(w) <= 64)
        return b"".join(found)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")   # tasks share the cores already
    return WordEncoder(path)
