"""Exact BPE ids at dictionary speed.

Both vocabularies cut a text into pre-tokens first and merge inside each of them only, so the ids
of a text are the joined ids of its pieces. A piece here is what stands between two single spaces
or line ends; its ids come from a cache and, when new, from the tokenizers library. A text with
something that makes pieces depend on each other (runs of white space, letters beyond Latin,
control strings of special tokens) goes to the library whole, so ids always equal the library's.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \x85\xa0"
BEYOND = re.compile("[^\x00-ɏ]|<\\||[\x1c-\x1f]")
#: The vocabularies' own splitting patterns (fixed values), written out for Latin letters.
BYTE_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
WORD_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
#: Rows of a cache's two halves together; a worker process keeps its caches from task to task.
CACHE_ROWS = 800_000


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character as byte-level vocabularies write it: printable Latin-1 bytes
    stand for themselves, the others follow from U+0100 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Cache:
    """A dictionary in two halves: when the young one is full, it becomes the old one, whose rows last until asked for again."""

    def __init__(self, rows: int):
        self.half = max(1, rows // 2)
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def get(self, key: str, make: Callable[[str], bytes | None]) -> bytes | None:
        got = self.young.get(key, self)  # itself: no such row
        if got is not self:
            return got
        got = self.old.get(key, self)
        if got is self:
            got = make(key)
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        self.young[key] = got
        return got


@lru_cache(maxsize=2)
def worker_bpe(path: str, words: bool, plain: bool = False, rows: int = CACHE_ROWS) -> CachedBpe:
    """The worker process's own CachedBpe: Spark reuses processes, so later tasks find it warm."""
    return CachedBpe(path, words, plain, rows)


def release() -> None:
    """For tasks that need no tokens: a worker process that tokenized before gives its caches' memory back."""
    worker_bpe.cache_clear()


class CachedBpe:
    """ids(text): little-endian unsigned 32-bit ids as bytes, as ``encode(add_special_tokens=False)`` gives."""

    def __init__(self, path: str, words: bool, plain: bool = False, rows: int = CACHE_ROWS):
        """plain: strings of special tokens inside a text are ordinary text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.model = self.tokenizer.model
        self.words = words
        self.table = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.pieces, self.first, self.rest = Cache(rows // 8), Cache(rows // 8), Cache(rows)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, text: str) -> bytes:
        """The ids of one piece."""
        if text.isascii() and text.isprintable():
            mapped = text.replace(" ", "Ġ")
        else:
            mapped = text.encode().decode("latin-1").translate(self.table)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def piece(self, text: str) -> bytes:
        if text[0] == " ":  # a word that came alone before, now with something behind it
            got = self.rest.young.get(text[1:]) or self.rest.old.get(text[1:])
            if got:
                return got
        return self.pieces.get(text, self.merged)

    def joined(self, cache: Cache, keys: list[str], prefix: str) -> bytes | None:
        """The ids of prefix + key for each key; None if one of them is no independent piece."""
        got = list(map(cache.young.get, keys))
        try:
            return b"".join(got)
        except TypeError:
            pass
        # Only what the young half lacks is asked for one by one.
        make = partial(self.chunk, prefix=prefix)
        for at in [at for at, ids in enumerate(got) if ids is None]:
            ids = got[at] = cache.get(keys[at], make)
            if ids is None:
                return None
        return b"".join(got)

    def chunk(self, key: str, prefix: str) -> bytes | None:
        if key[:1] == "\n":  # a line's first word
            key, prefix = key[1:], "\n"
        if key.isascii():
            if "<|" in key:
                return None
        elif BEYOND.search(key):
            return None
        if self.words:
            low = key.lower() if key.isascii() else unicodedata.normalize("NFC", key).lower()
            return self.merged(low) if low.isalpha() else b"".join(map(self.piece, WORD_PIECES.findall(low)))
        if key.isalpha():  # one piece, with a space or line start before it as a piece of its own kind
            return self.merged(prefix + key) if prefix != "\n" else self.piece("\n") + self.merged(key)
        if not key or key[0].isspace() or key[-1].isspace():
            return None
        return b"".join(map(self.piece, BYTE_PIECES.findall(prefix + key)))

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.words:
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):
                return self.whole(text)
            got = self.joined(self.rest, text.split(), "")
            return self.whole(text) if got is None else got
        keys = text.replace("\n", " \n").split(" ")
        # A text that begins with a space gives it to the next word.
        head = b"" if text[0] == " " else self.joined(self.first, keys[:1], "")
        tail = self.joined(self.rest, keys[1:], " ") if head is not None else None
        return self.whole(text) if tail is None else head + tail
