"""Token ids of whole texts by the tokenizers library, with a cache of words."""

from __future__ import annotations

import re
from array import array

import numpy as np

#: A run of Latin letters and perhaps one full stop or comma: its pieces are a word and a punctuation mark.
LATIN_WORD = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)")


def _byte_characters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


class WordEncoder(dict):
    """Ids of a text from the ids of its chunks between spaces and line ends.

    That equals encoding the whole text for a tokenizer that drops white space and joins nothing
    across it, such as word_bpe_49k.json (``words_apart``); for others the text is encoded whole.
    A chunk's ids are kept as bytes; at ``most`` chunks the cache starts again, so memory is bounded.
    Latin words go to the tokenizer's model at once; anything else takes its whole course.
    """

    def __init__(self, path: str, words_apart: bool = True, most: int = 800_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words_apart, self.most = words_apart, most
        self.dtype = id_type(self.tokenizer.get_vocab_size())
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.characters = _byte_characters()
        self[""] = b""

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        found = LATIN_WORD.fullmatch(chunk)
        if found is None:
            ids = self._pack(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        elif found[2] or not chunk.islower():
            ids = self._word(found[1].lower()) + (self[found[2]] if found[2] else b"")
        else:
            ids = self._word(chunk)
        if len(self) >= self.most:
            self.clear()
            self[""] = b""
        self[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case Latin word, which need not be kept."""
        kept = self.get(word)
        if kept is None:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.characters)
            kept = self._pack([t.id for t in self.model.tokenize(letters)])
        return kept

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a text; none for null."""
        if not text:
            return np.zeros(0, dtype=self.dtype)
        if not self.words_apart:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        return np.frombuffer(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))), dtype=self.dtype)


def id_type(vocabulary: int) -> np.dtype:
    """Smallest little-endian unsigned type for the ids of a vocabulary."""
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, words_apart: bool = True) -> WordEncoder:
    """One encoder per Python worker, so that its cache serves all of the worker's tasks."""
    if (path, words_apart) not in _ENCODERS:
        _ENCODERS[path, words_apart] = WordEncoder(path, words_apart)
    return _ENCODERS[path, words_apart]
