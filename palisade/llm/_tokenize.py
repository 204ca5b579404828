"""Exact, cached use of a public tokenizer: equal to encoding each whole text with the tokenizers library."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from palisade.llm._work import keep

#: Words kept with their ids in each worker; beyond it the cache starts anew, results stay the same.
CACHE_WORDS = 400_000
#: Longer words are encoded each time.
CACHE_LENGTH = 40
_TAIL = ".,;:!?*$%&#()"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """This process' encoder, which a worker's tasks share until it turns to another operator."""
    keep("tokenizer", word_encoder.cache_clear)
    return WordEncoder(path)


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer's pre-tokenizer drops white space and none of its tokens spans it, so a text's ids are those of its
    pieces between spaces and line ends in turn. Pieces are encoded by the library and remembered. A piece of Latin
    letters and closing marks is the letters' ids and the marks' ids, for the pre-tokenizer splits there. Lower-case Latin
    letters are what the normalizer leaves alone and the pre-tokenizer maps letter by letter, so they go to the library's
    model at once. That holds only for tokenizers of this kind; for others pass by_word=False, and whole texts go to the library.
    """

    def __init__(self, path: str, by_word: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.by_word = by_word
        self.cache: dict[str, bytes] = {"": b""}
        self.model = self.tok.model
        letters = [c for c in map(chr, range(256)) if c.isalpha() and c == c.lower()] if by_word else []
        self.mapped = {ord(c): "".join(part for part, _ in self.tok.pre_tokenizer.pre_tokenize_str(c)) for c in letters}

    def _raw(self, pieces: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tok.encode_batch_fast(pieces, add_special_tokens=False)]

    def _words(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of many words, which the library takes as one sequence of words."""
        got = self.tok.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(got.ids, "<u4")
        bounds = (4 * np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(pieces) + 1))).tolist()
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip(bounds, bounds[1:])]

    def _learn(self, missing: set[str]) -> None:
        cache, parts = self.cache, []
        need: set[str] = set()
        letters: set[str] = set()
        for w in missing:
            stem = w.rstrip(_TAIL)
            if stem and stem.isalpha() and max(stem) <= "\u00ff":
                low, tail = stem.lower(), w[len(stem) :]
                parts.append((w, low, tail))
                letters.add(low)
                need.add(tail)
            else:
                need.add(w)
        new = [w for w in need if w not in cache]
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            cache.update(zip(part, self._words(part)))
        for w in letters.difference(cache):
            cache[w] = np.array([t.id for t in self.model.tokenize(w.translate(self.mapped))], "<u4").tobytes()
        for w, low, tail in parts:
            cache[w] = cache[low] + cache[tail]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self._raw([text])[0]
        pieces = text.replace("\n", " ").split(" ")
        if len(text) > CACHE_LENGTH * len(pieces):  # odd text: hardly any spaces
            return b"".join(self._raw([p for p in pieces if p])) if len(pieces) > 1 else self._raw([text])[0]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {"": b""}
        get = self.cache.__getitem__
        try:
            return b"".join(map(get, pieces))
        except KeyError:
            self._learn(set(pieces).difference(self.cache))
            return b"".join(map(self.cache.__getitem__, pieces))
