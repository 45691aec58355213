"""Exact pre-token caches over the tokenizers library.

A BPE vocabulary encodes each pre-token on its own, so a text's ids are the
concatenation of its pre-tokens' ids. Texts made only of characters whose
class is certain (``SAFE``) are split here by a regular expression with that
class spelled out, and each distinct pre-token is encoded once per worker by
the library. Any other text, and any text that may hold a special token's
string, goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from .common import kept

# Letters and numbers of the ranges that SAFE admits.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
NUMBER = "0-9²³¹¼½¾"
UNSAFE = re.compile("[^\t\n\r -~¡-įı-ſ‐-‧‰-⁞€]")

#: The splitting rules of the two public vocabularies, by the library's names. Letters are tried
#: first here, which no other part can begin with.
BYTE_LEVEL = re.compile(rf" ?[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(rf"[{LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")

#: Entries that a worker's cache may hold before it starts anew (60 MB), and ids, which bound the bytes of long ones.
CACHE_ENTRIES, CACHE_IDS = 320_000, 4_000_000
#: A longer pre-token (bytes glued together, mostly) is counted each time and not kept.
LONGEST = 100


def tokenizer(path: str):
    """The library's tokenizer, without truncation or padding; kept with the other things of its path."""
    held = kept.setdefault(path, {})
    if "tokenizer" not in held:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        held["tokenizer"] = t
    return held["tokenizer"]


def fast(text: str) -> bool:
    """Whether the expressions above split ``text`` as the library does."""
    return "<|" not in text and not UNSAFE.search(text)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printing Latin-1
    characters stand for themselves, the other bytes for the letters from U+0100 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256))
    return [chr(b) if b in printing else chr(256 + next(others)) for b in range(256)]


_LETTERS = _byte_letters()


def _model_encode(path: str):
    """The ids of one pre-token, by the library's model without its text pipeline."""
    tokenize = tokenizer(path).model.tokenize

    def encode(piece: str) -> list[int]:
        if not piece.isascii() or not piece.isprintable() or " " in piece:
            piece = "".join([_LETTERS[b] for b in piece.encode()])
        return [t.id for t in tokenize(piece)]

    return encode


class Lengths(dict):
    """Pre-token -> number of ids; misses are encoded by the library."""

    def __init__(self, path: str, known: dict[str, int]):
        super().__init__(known)
        self.known, self.encode, self.piece_ids = known, tokenizer(path).encode, _model_encode(path)

    def __missing__(self, piece: str) -> int:
        n = len(self.piece_ids(piece))
        if len(piece) > LONGEST:
            return n
        if len(self) >= CACHE_ENTRIES + len(self.known):
            self.clear()
            self.update(self.known)
        self[piece] = n
        return n

    def count(self, text: str) -> int:
        if fast(text):
            return sum(map(self.__getitem__, BYTE_LEVEL.findall(text)))
        return len(self.encode(text, add_special_tokens=False).ids)


class Ids(dict):
    """Pre-token -> place of its ids in one flat array; encodes whole batches."""

    def __init__(self, path: str):
        super().__init__()
        self.encode, self.piece_ids = tokenizer(path).encode, _model_encode(path)
        self._empty()

    def _empty(self) -> None:
        self.clear()
        self.flat, self.place, self.size = array("i"), array("q"), array("q")

    def __missing__(self, piece: str) -> int:
        return self._add(piece, self.piece_ids(piece))

    def _add(self, piece, ids: list[int]) -> int:
        k = self[piece] = len(self)
        self.place.append(len(self.flat))
        self.size.append(len(ids))
        self.flat.extend(ids)
        return k

    def batch(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each text closed by ``end_id``,
        and the number of ids of each text."""
        if len(self) >= CACHE_ENTRIES or len(self.flat) >= CACHE_IDS:
            self._empty()
        end = self[()] if () in self else self._add((), [end_id])
        get, out, n, waiting = self.__getitem__, [], [], []
        for text in texts:
            if fast(text):
                found = WORD_LEVEL.findall(text.lower())
                waiting += (np.fromiter(map(get, found), np.int64, len(found)), [end])
                n.append(None)
            else:
                out.append(self._gather(waiting, n))
                out.append(np.array([*self.encode(text, add_special_tokens=False).ids, end_id], np.int32))
                waiting = []
                n.append(len(out[-1]))
        out.append(self._gather(waiting, n))
        return np.concatenate(out), np.array(n, np.int64)

    def _gather(self, waiting: list, n: list) -> np.ndarray:
        """Ids of the waiting texts; replaces each None in ``n`` by a text's number."""
        if not waiting:
            return np.zeros(0, np.int32)
        at = np.concatenate(waiting).astype(np.int64)
        flat, place, size = (np.frombuffer(x, t) for x, t in ((self.flat, np.int32), (self.place, np.int64), (self.size, np.int64)))
        size = size[at]
        stop = np.cumsum(size)
        last = stop[np.cumsum([len(a) + 1 for a in waiting[::2]]) - 1]
        n[len(n) - n.count(None) :] = np.diff(last, prepend=0).tolist()
        return flat[np.repeat(place[at] - (stop - size), size) + np.arange(stop[-1])]


def lengths_for(path: str, key: str, known: dict[str, int]) -> Lengths:
    """The process's ``Lengths`` for one broadcast table, kept from task to task."""
    held = kept.setdefault(path, {})
    if held.get("lengths", (None,))[0] != key:
        held["lengths"] = (key, Lengths(path, known))
    return held["lengths"][1]


def ids_for(path: str) -> Ids:
    """The process's ``Ids`` for one vocabulary."""
    held = kept.setdefault(path, {})
    if "ids" not in held:
        held["ids"] = Ids(path)
    return held["ids"]
