"""Exact byte-level BPE by per-prefix dynamic programming.

The merge procedure of byte-pair encoding gives every prefix of a byte string
exactly one encoding, and the encoding of a prefix is the encoding of a shorter
prefix followed by one token.  So it suffices to store the last token of every
prefix.  At each end position the automaton over the vocabulary lists the tokens
that are a suffix of the prefix, longest first; the one whose left neighbour (the
last token of the remaining prefix) is compatible is the last token, and there is
only one.  Following the back-pointers from the end yields the ids.

Two tokens are compatible when running the merges over their joined bytes keeps
the border between them; this is decided by undoing merges from the border outwards.

The work is linear in the length of a piece (times the few suffix matches), so one
very long piece without white space costs no more per byte than ordinary words.
"""

from __future__ import annotations

import json
import os

import ahocorasick
import numpy as np
import regex

#: The published split pattern of the byte_bpe_50k vocabulary.
#: (its first alternatives begin with an apostrophe, so letters may be tried before them).
SPLIT_PATTERN = r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct pieces (and as many words) remembered by one worker, and the longest worth it.
MEMO_PIECES = 1 << 18
MEMO_BYTES = 64


def default_directory() -> str:
    """Folder of the public vocabularies: $MOENDA_TOKENIZERS or /opt/tokenizers."""
    return os.environ.get("MOENDA_TOKENIZERS", "/opt/tokenizers")


def _byte_of_symbol() -> dict[str, int]:
    """Inverse of the byte-to-printable-symbol rule of byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    kept = set(plain)
    shifted = (b for b in range(256) if b not in kept)
    table.update({chr(0x100 + k): b for k, b in enumerate(shifted)})
    return table


class PrefixBpe:
    """Byte-level BPE of a ``tokenizers`` JSON file (its ``vocab`` and ``merges``)."""

    def __init__(self, path: str, pattern: str = SPLIT_PATTERN):
        with open(path, encoding="utf-8") as handle:
            model = json.load(handle)["model"]
        to_byte = _byte_of_symbol()
        symbols: dict[str, int] = model["vocab"]
        self._id_of: dict[bytes, int] = {}
        for symbol, ident in symbols.items():
            try:
                self._id_of[bytes(map(to_byte.__getitem__, symbol))] = ident
            except KeyError:  # a special token: not made of byte symbols
                continue
        size = max(symbols.values()) + 1
        self._left = list(range(size))
        self._right = list(range(size))
        self._merged: dict[tuple[int, int], int] = {}
        previous = -1
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, whole = symbols[a], symbols[b], symbols[a + b]
            if whole <= previous:
                raise ValueError("ids must follow the order of the merges")
            previous = whole
            if (left, right) not in self._merged:
                self._merged[left, right] = whole
                self._left[whole], self._right[whole] = left, right
        self._bytes: dict[int, bytes] = {i: b for b, i in self._id_of.items()}
        self._suffixes = ahocorasick.Automaton()
        for token, ident in self._id_of.items():
            self._suffixes.add_word(token.decode("latin-1"), (ident, len(token)))
        self._suffixes.make_automaton()
        self._pieces = regex.compile(pattern)
        self._memo = _Memo(self._encode_piece)
        self._words = _Memo(self._encode_word)

    @property
    def vocabulary(self) -> dict[bytes, int]:
        return self._id_of

    def _compatible(self, one: int, two: int) -> bool:
        merged, left, right = self._merged.get, self._left, self._right
        bound = 1 << 60  # ids below it may still merge across the border
        while True:
            across = merged((one, two))
            if across is not None and across < bound:
                return False
            if one > two:  # the left token was completed later: undo it first
                bound, one = one, right[one]
                if one == bound:
                    bound, two = two + 1, left[two]
                    if two + 1 == bound:
                        return True
            else:
                bound, two = two + 1, left[two]
                if two + 1 == bound:
                    bound, one = one, right[one]
                    if one == bound:
                        return True

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece: last token of every prefix, then the back-pointers."""
        n = len(data)
        if n == 0:
            return []
        compatible = self._compatible
        last, width = [-1] * (n + 1), [0] * (n + 1)
        for end, (ident, length) in self._suffixes.iter(data.decode("latin-1")):
            end += 1
            if width[end]:
                continue  # the last token of this prefix is known; it is unique
            start = end - length
            if start == 0 or (width[start] and compatible(last[start], ident)):
                last[end], width[end] = ident, length
        ids, at = [], n
        while at:
            if not width[at]:
                raise ValueError("the vocabulary does not cover every byte")
            ids.append(last[at])
            at -= width[at]
        ids.reverse()
        return ids

    def _encode_piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        known = self._id_of.get(data)
        return np.array([known] if known is not None else self.encode_bytes(data), "<i4").tobytes()

    def _encode_word(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Run
        return self._encode_run(" " + word)

    def _encode_run(self, text: str) -> bytes:
        return b"".join(map(self._memo.__getitem__, self._pieces.findall(text)))

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian int32, without special tokens.

        A single space between two other characters always begins a piece, so a
        text whose spaces are all such is the sequence of its words, each with its
        space; words repeat and are remembered.  Any other text is split as a whole.
        """
        head, *words = text.split(" ")
        if words and head and head[-1].isspace():
            return self._encode_run(text)
        try:
            return self._encode_run(head) + b"".join(map(self._words.__getitem__, words))
        except _Run:
            return self._encode_run(text)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<i4").tolist()

    def count(self, text: str) -> int:
        return len(self.encode_packed(text)) >> 2

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, ids))


class _Run(Exception):
    """A run of white space: the words can't be encoded one by one."""


class _Memo(dict):
    """Remembers the results of a function of a string, within its bound."""

    def __init__(self, function):
        super().__init__()
        self._function = function

    def __missing__(self, text: str) -> bytes:
        packed = self._function(text)
        if len(text) <= MEMO_BYTES:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[text] = packed
        return packed


_LOADED: dict[str, PrefixBpe] = {}


def load(name: str = "byte_bpe_50k", directory: str | None = None) -> PrefixBpe:
    """The tokenizer of a file, loaded once per Python worker."""
    path = os.path.join(directory or default_directory(), f"{name}.json")
    if path not in _LOADED:
        _LOADED[path] = PrefixBpe(path)
    return _LOADED[path]
