"""Exact token ids at the speed of a dictionary lookup.

The tokenizer works on pieces (runs of letters, single digits, runs of signs) that never cross white
space, so the ids of a text are those of its words, joined. Words and pieces that were met before are
looked up; only new pieces go through the library's BPE model. Words with characters whose lower case
or normal form might depend on the Unicode version go through the whole tokenizer, still word by word,
and texts that hold the string of a special token go through it as a whole.
"""
from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import regex

#: Fixed value of the tokenizer file: its split pattern.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Up to Latin Extended-B, NFC changes nothing and lower case is one to one, but for U+0130.
UNUSUAL = re.compile("[^\x00-įı-ɏ]")
#: What ``str.split`` takes for white space and the tokenizer doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")
END_ID = 1
#: Entries of the caches; one is emptied when full, which costs time but changes no result.
WORD_ENTRIES, PIECE_ENTRIES = 250_000, 500_000


class _Pieces(dict):
    """Ids of a lower-case piece, from the BPE model when it is met first."""

    def __init__(self, whole):
        from tokenizers import pre_tokenizers

        super().__init__()
        self.tokenize = whole.model.tokenize
        self.level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.id_bytes = [i.to_bytes(4, "little") for i in range(1 + max(whole.get_vocab().values()))]

    def __missing__(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isprintable() else self.level(piece)[0][0]
        got = b"".join([self.id_bytes[t.id] for t in self.tokenize(mapped)])
        if len(self) >= PIECE_ENTRIES:
            self.clear()
        self[piece] = got
        return got


class _Words(dict):
    """Ids of a word as it stands in the text."""

    def __init__(self, pieces: _Pieces, slow):
        super().__init__()
        self.pieces, self.slow = pieces, slow

    def __missing__(self, word: str) -> bytes:
        if not word.isascii() and UNUSUAL.search(word):
            got = self.slow(word)
        elif word.isalpha():
            got = self.pieces[word.lower()]
        else:
            got = b"".join(map(self.pieces.__getitem__, PIECES.findall(word.lower())))
        if len(self) >= WORD_ENTRIES:
            self.clear()
        self[word] = got
        return got


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words = _Words(_Pieces(self.whole), self.slow)

    def slow(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def forget(self) -> None:
        """Give the caches' memory back, as a worker outlives the stage that needed them."""
        self.words.pieces.clear()
        self.words.clear()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special) or SEPARATORS.search(text):
            return self.slow(text)
        return b"".join(map(self.words.__getitem__, text.split()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, so its caches last over batches."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


END_BYTES = np.array([END_ID], dtype="<u4").tobytes()
