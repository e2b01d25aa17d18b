"""Byte-pair encoding in linear time, and decoding by an offset table.

A row of tokens is what the merges give exactly if each token is what its own
bytes give and each adjacent pair is compatible: no merge could have joined the
two over their border.  So the encoder takes the longest token at each position
(Aho-Corasick), checks it against the token before it, and falls back to shorter
tokens and then to earlier positions only where a pair is not compatible.  The
valid row of tokens of a prefix is unique; hence no position is tried twice, and
the time is linear.

Two tokens l, r are incompatible if some x on the right edge of l's merge tree
and some y on the left edge of r's are joined by a merge that comes before the
one that consumes x, and not after the one that consumes y (of equal merges the
left one goes first).
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame

from assetry.llm.common import map_batches
from assetry.llm.tokens import tokenizer_path

BYTE_BPE = "byte_bpe_50k.json"
# The pre-tokenizer's pattern, with white space spelled out.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
ENCODED = "doc_id long, ids binary, n_tokens long"
# The same pattern where every character is ASCII.
ASCII_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
    r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """Byte of each letter with which byte-level vocabularies spell: printable
    bytes are themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, letters = data["model"], byte_letters()

        def spelled(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.ids = {spelled(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.merges: list[tuple[int, int, int]] = []
        for pair in model["merges"]:
            left, right = (spelled(t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges.append((self.ids[left], self.ids[right], self.ids[left + right]))

    def token_bytes(self) -> list[bytes]:
        """Bytes of each id, special tokens in UTF-8."""
        out = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for token, i in self.ids.items():
            out[i] = token
        for token, i in self.special.items():
            out[i] = token.encode()
        return out


class Words(dict):
    """Ids of the words met, as bytes; emptied when full."""

    LIMIT = 700_000

    def __init__(self, encode_bytes):
        super().__init__()
        self.encode_bytes = encode_bytes

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.encode_bytes(word.encode())).tobytes()
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    """Exact ids of byte strings and of texts."""

    PAIRS = 1_000_000  # remembered pairs of the compatibility table

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick
        import regex

        self.split = regex.compile(PATTERN).findall
        self.split_ascii = re.compile(ASCII_PATTERN).findall
        self.special = (
            regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")").split
            if vocabulary.special
            else None
        )
        self.special_ids = vocabulary.special
        self.joined: dict[tuple[int, int], int] = {}  # rank of the merge of a pair
        self.parts: dict[int, tuple[int, int, int]] = {}  # left, right, rank of a token
        for rank, (left, right, token) in enumerate(vocabulary.merges):
            self.joined.setdefault((left, right), rank)
            self.parts.setdefault(token, (left, right, rank))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.right_edge: dict[int, list[tuple[int, int]]] = {}
        self.left_edge: dict[int, list[tuple[int, int]]] = {}
        # only tokens that their own bytes give
        own: set[int] = set()
        for token, i in sorted(vocabulary.ids.items(), key=lambda x: self.parts.get(x[1], (0, 0, -1))[2]):
            if i not in self.parts:
                if len(token) == 1:
                    own.add(i)
                continue
            left, right, rank = self.parts[i]
            if left in own and right in own and self._free(left, right, rank):
                own.add(i)
        self.tokens = {t.decode("latin-1"): i for t, i in vocabulary.ids.items() if i in own}
        self.spelling = {i: t for t, i in self.tokens.items()}
        self.shorter = {i: self._next_shorter(t) for t, i in self.tokens.items()}
        self.longest_token = max(map(len, self.tokens))
        self.automaton = ahocorasick.Automaton()
        for token, i in self.tokens.items():
            self.automaton.add_word(token, i)
        self.automaton.make_automaton()
        self.words = Words(self.encode_bytes)

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens along one edge of a token's merge tree, from the token down, each
        with the rank of the merge that consumes it."""
        known = self.left_edge if side == 0 else self.right_edge
        edge = known.get(token)
        if edge is None:
            edge, consumed, at = [], _NEVER, token
            while True:
                edge.append((at, consumed))
                parts = self.parts.get(at)
                if parts is None:
                    break
                at, consumed = parts[side], parts[2]
            known[token] = edge
        return edge

    def _free(self, left: int, right: int, before: int) -> bool:
        """No merge of a rank under `before` joins the two over their border."""
        joined = self.joined
        for x, x_gone in self._edge(left, 1):
            for y, y_gone in self._edge(right, 0):
                rank = joined.get((x, y))
                if rank is not None and rank < before and rank < x_gone and rank <= y_gone:
                    return False
        return True

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= self.PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._free(left, right, _NEVER)
        return known

    def _longest(self, s: str, at: int) -> int:
        piece = s[at : at + self.longest_token]
        for n in range(self.automaton.longest_prefix(piece), 0, -1):
            token = self.tokens.get(piece[:n])
            if token is not None:
                return token
        raise ValueError(f"byte {ord(s[at])} is not in the vocabulary")

    def _next_shorter(self, s: str) -> int:
        """The longest token that begins this one, or -1."""
        for n in range(len(s) - 1, 0, -1):
            if s[:n] in self.tokens:
                return self.tokens[s[:n]]
        return -1

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of bytes that are one word of the pre-tokenizer."""
        s = data.decode("latin-1")
        row = [token for _, token in self.automaton.iter_long(s)]
        pairs, left, at = self.pairs, -1, 0
        for k, token in enumerate(row):
            if left >= 0:
                free = pairs.get((left, token))
                if not (self.compatible(left, token) if free is None else free):
                    return self._backtrack(s, row[:k], at, token)
            at += len(self.spelling[token])
            left = token
        return row if at == len(s) else self._backtrack(s, [], 0, self._longest(s, 0))

    def _backtrack(self, s: str, row: list[int], at: int, token: int) -> list[int]:
        """Go on from a valid row that ends at `at`; `token` is to be tried there."""
        n, spelling, shorter = len(s), self.spelling, self.shorter
        dead = bytearray(n + 1)
        while at < n:
            end = at + len(spelling[token])
            if not dead[end] and (not row or self.compatible(row[-1], token)):
                row.append(token)
                at = end
                if at < n:
                    token = self._longest(s, at)
                continue
            token = shorter[token]
            while token < 0:
                dead[at] = 1
                token = row.pop()
                at -= len(spelling[token])
                token = shorter[token]
        return row

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, unsigned 32-bit little-endian; null is empty."""
        if not text:
            return b""
        if self.special is None or not any(t in text for t in self.special_ids):
            return self._plain(text)
        return b"".join(
            np.array([self.special_ids[p]], dtype="<u4").tobytes()
            if p in self.special_ids
            else self._plain(p)
            for p in self.special(text)
        )

    def _plain(self, text: str) -> bytes:
        words = self.split_ascii(text) if text.isascii() else self.split(text)
        return b"".join(map(self.words.__getitem__, words))


class Decoder:
    """Bytes of ids: all tokens in one array, with the offset of each."""

    def __init__(self, vocabulary: Vocabulary):
        tokens = vocabulary.token_bytes()
        self.data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int32)
        self.offsets = np.zeros(len(tokens), dtype=np.int32)
        np.cumsum(self.lengths[:-1], out=self.offsets[1:])

    def decode(self, ids: bytes) -> bytes:
        row = np.frombuffer(ids, dtype="<u4")
        if len(row) == 0:
            return b""
        lengths = self.lengths[row]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.offsets[row] - (ends - lengths), lengths)
        shift += np.arange(ends[-1], dtype=shift.dtype)
        return self.data[shift].tobytes()


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Rows (doc_id, ids, n_tokens) of `docs` (doc_id, text): whole texts as the
    tokenizer file's merges give them, without added tokens; a special token's
    string in a text is that token.  Null and empty texts have no ids.  Each row
    is encoded for itself, also with equal or null ids; other columns are not
    read.  No shuffle."""
    path = tokenizer or tokenizer_path(BYTE_BPE)

    def make():
        encoder = Encoder(Vocabulary(path))

        def turn(batch):
            ids = [encoder.encode(t) for t in batch.column("text").to_pylist()]
            return {
                "doc_id": batch.column("doc_id"),
                "ids": ids,
                "n_tokens": [len(i) // 4 for i in ids],
            }

        return turn

    return map_batches(docs.select("doc_id", "text"), make, ENCODED)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Rows (doc_id, text) of `encoded` (doc_id, ids): all tokens, special ones
    too; bytes that are not UTF-8 become U+FFFD; null ids give a null text."""
    path = tokenizer or tokenizer_path(BYTE_BPE)

    def make():
        decoder = Decoder(Vocabulary(path))

        def turn(batch):
            return {
                "doc_id": batch.column("doc_id"),
                "text": [
                    None if i is None else decoder.decode(i).decode("utf-8", "replace")
                    for i in batch.column("ids").to_pylist()
                ],
            }

        return turn

    return map_batches(encoded.select("doc_id", "ids"), make, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encode and decode in one pass, keeping digests only: (doc_id, n_tokens,
    ids_sha256, decoded_sha256)."""
    path = tokenizer or tokenizer_path(BYTE_BPE)

    def make():
        vocabulary = Vocabulary(path)
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)

        def turn(batch):
            ids = [encoder.encode(t) for t in batch.column("text").to_pylist()]
            texts = [decoder.decode(i).decode("utf-8", "replace").encode() for i in ids]
            return {
                "doc_id": batch.column("doc_id"),
                "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
            }

        return turn

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_batches(docs.select("doc_id", "text"), make, schema)
