"""Whole texts through a public tokenizer, with the library's own ids."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

WORD_BPE = "word_bpe_49k.json"
# What may follow a word of letters as a pre-token of its own (not the apostrophe,
# which can begin one with letters).
_MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, int]:
    """Byte to the letter that stands for it in a byte-level vocabulary: printable bytes stand for
    themselves, the others for the letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(0x100) if b not in shown]
    return dict(zip(shown, shown)) | {b: 0x100 + i for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def _is_latin(text: str) -> bool:
    """No letter beyond U+00FF: each has one lower-case form of the same kind."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder(dict):
    """Ids of whole texts as `Tokenizer.encode(text, add_special_tokens=False)`
    gives them, as little-endian unsigned 32-bit integers; itself the ids of chunks.

    The tokenizer is one that drops white space: its normalizer, its
    pre-tokenizer and its special tokens never join what stands on both sides of
    a space or line feed, so the ids of a text are those of its chunks in a row.
    A chunk is encoded by the library once and remembered; equality with whole
    texts is tested, on random strings too.  A tokenizer for which this is not
    known gets whole texts (`whole=True`).

    It is a cache: emptied at `LIMIT` chunks, also within a text, and chunks of
    over `LONGEST` characters are not kept.
    """

    LIMIT = 1_000_000
    LONGEST = 64

    def __init__(self, path: str, whole: bool = False):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.whole = whole
        self.model = self.tokenizer.model.tokenize
        # matched as written, before the normalizer lower-cases
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content.lower() for t in added if not t.normalized]

    def encode(self, text: str) -> bytes:
        """Ids by the library alone."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        if self.whole:
            return [self.encode(t or "") for t in texts]
        return [b"".join(map(self.__getitem__, self._chunks(t))) for t in texts]

    def _chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        if _is_latin(text):  # the normalizer lower-cases, letter by letter
            low = text.lower()
            # in other case a special token is no token, and must not become one
            if not any(s in low for s in self.special):
                text = low
        return text.replace("\n", " ").split(" ")

    def __missing__(self, chunk: str) -> bytes:
        """Encode a new chunk: a word with marks after it as word and marks; a word of letters up
        to U+00FF, of which the normalizer changes the case only and which the pre-tokenizer
        leaves whole, by the model alone."""
        if chunk.isalpha() and _is_latin(chunk):
            low = chunk.lower()
            if not low.isascii():
                low = low.encode().decode("latin-1").translate(_LETTERS)
            ids = array("I", [t.id for t in self.model(low)]).tobytes()
        else:
            stem = chunk.rstrip(_MARKS)
            if len(stem) < len(chunk) and stem.isalpha():
                ids = self[stem] + self[chunk[len(stem) :]]
            else:
                ids = self.encode(chunk) if chunk else b""
        if len(chunk) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[chunk] = ids
        return ids


@lru_cache(1)
def word_encoder(path: str, whole: bool = False) -> WordEncoder:
    """The encoder of this Python process: what one task has learned serves the next."""
    return WordEncoder(path, whole)
