"""Encoders over public vocabulary files: whole words are encoded once and remembered.

Both encoders agree with the tokenizers library on every text. Texts whose
characters all lie in a range where the library's character classes are stated
here are split into words by one regular expression, and the ids of each distinct
word are looked up; any other text goes to the library as a whole.
"""

from __future__ import annotations

import functools
import os
import re
import sys
import unicodedata

import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words remembered by a worker before it starts afresh.
REMEMBERED = 400_000

_PLAIN = [chr(c) for c in range(0x20, 0x180) if not (0x7F <= c <= 0xA0 or c == 0x130)] + list("\t\n\r")
_OTHER = re.compile("[^" + re.escape("".join(_PLAIN)) + "]|<\\|")
_LETTERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _PLAIN if unicodedata.category(c)[0] == "N")
_SPACE = r" \t\n\r"
_SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"


def shown_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # these stand for themselves
    hidden = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class _Remembered(dict):
    """word -> ids as little-endian bytes."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = self.encode(word)
        return ids


class ByteEncoder:
    """Byte-level BPE; ids are packed as little-endian 16-bit numbers."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        shown = shown_bytes()
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        vocab = {t: i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in added}
        ranks = {bytes(shown[c] for c in t): i for t, i in vocab.items()}
        self.pieces = {i: t for t, i in ranks.items()} | {i: t.encode() for t, i in added.items()}
        if max(self.pieces) >= 1 << 16:
            raise ValueError("the vocabulary does not fit 16 bits")
        one = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.words = _Remembered(lambda w: self.pack(one.encode_ordinary(w)))
        self.split = re.compile(f"{_SUFFIXES}| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_SPACE}{_LETTERS}{_NUMBERS}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(2, "little") for i in ids])

    @staticmethod
    def unpack(packed: bytes) -> list[int]:
        numbers = memoryview(packed).cast("H") if sys.byteorder == "little" else [int.from_bytes(packed[i : i + 2], "little") for i in range(0, len(packed), 2)]
        return list(numbers)

    def encode(self, text: str) -> bytes:
        if _OTHER.search(text):
            return self.pack(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8; bytes that are no UTF-8 become replacement characters, as in the library."""
        found = b"".join(map(self.pieces.__getitem__, ids))
        return found.decode("utf-8", "replace").encode()


class WordEncoder:
    """BPE with word ends over lower-cased words; ids are packed as little-endian 32-bit numbers.

    A word's bytes and one closing byte that UTF-8 never holds are merged by
    rank: a last byte and the closing byte form the unit that ends words.
    """

    END, CLOSING = "</w>", b"\xff"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        shown = shown_bytes()
        vocab = self.library.get_vocab(with_added_tokens=False)
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        ranks = {}
        for token, i in vocab.items():
            if token not in added:
                ends = token.endswith(self.END) and len(token) > len(self.END)
                letters = bytes(shown[c] for c in token.removesuffix(self.END)) if ends else bytes(shown[c] for c in token)
                ranks[letters + self.CLOSING * ends] = i
        ranks[self.CLOSING] = max(vocab.values()) + 1  # never left alone: every byte joins it
        merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.words = _Remembered(lambda w: self.pack(merge(w.encode() + self.CLOSING)))
        self.split = re.compile(f"{_SUFFIXES}|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACE}{_LETTERS}{_NUMBERS}]+").findall

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def encode(self, text: str) -> bytes:
        if _OTHER.search(text):
            return self.pack(self.library.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.words.__getitem__, self.split(text.lower())))


@functools.lru_cache(2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


@functools.lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)
