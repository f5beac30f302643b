"""Token ids of whole texts by a public tokenizer, each distinct word once in a while.

The tokenizer drops white space and never joins what blanks divide, nor, of ASCII, a letter or a digit
with what is neither (the signs in ``APART``), nor two digits.  So a text's ids are those of such parts one
after the other.  The parts of a chunk are found by numpy and told apart by Arrow's dictionary; only parts
that the process has not kept from before go to the tokenizer.  ``tests/llm`` hold this against the plain call.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from lectern.llm.text_bytes import CHUNK_BYTES, LOWER, NOT_SPACE, words

#: Parts kept by a process at most, about; a chunk's are kept until its texts are done, and all are forgotten beyond it.
KEPT_PARTS, KEPT_BYTES = 800_000, 32 << 20

_LETTER, _DIGIT, _APART = (np.zeros(256, bool) for _ in range(3))
for _c in range(65, 91):
    _LETTER[_c] = _LETTER[_c + 32] = True
_DIGIT[48:58] = True
#: Signs that part words: ASCII but for the apostrophe, which contractions hold, and those of special tokens.
APART = '!"#$%&()*+,-./:;=?@[\\]^_`{}~'
_APART[np.frombuffer(APART.encode(), np.uint8)] = True
#: Two neighbours of these kinds (0: any other byte) are parted.
_KIND = np.where(_LETTER, 1, np.where(_DIGIT, 2, np.where(_APART, 3, 0))).astype(np.uint8)
_PARTED = np.zeros((4, 4), bool)
for _a, _b in ((1, 2), (1, 3), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)):
    _PARTED[_a, _b] = True
_PARTED = _PARTED.ravel()


class Encoder:
    """Ids of parts of words, with those of the last parts kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._forget()

    def _forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = (np.zeros(1 << 16, t) for t in (np.uint32, np.int64, np.int64))
        self.used = self.held = 0

    def _new_ids(self, parts: list[bytes]) -> list[list[int]]:
        """Plain small letters are a part for the tokenizer's model as they are, which saves what comes before it."""
        out: list = [None] * len(parts)
        rest = []
        for i, part in enumerate(parts):
            if part.isascii() and part.isalpha() and part.islower():
                out[i] = [token.id for token in self.model.tokenize(part.decode())]
            else:
                rest.append(i)
        for i, x in zip(rest, self.tokenizer.encode_batch_fast([parts[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def _numbers(self, parts: list[bytes]) -> np.ndarray:
        """For each part the number of its ids in ``starts`` and ``sizes``."""
        if len(self.number) + len(parts) > KEPT_PARTS or self.held > KEPT_BYTES:
            self._forget()
        found = np.fromiter(map(self.number.get, parts, repeat(-1)), np.int64, len(parts))
        at = np.flatnonzero(found < 0)
        if not len(at):
            return found
        some = [parts[i] for i in at]
        new = self._new_ids(some)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        first, end = len(self.number), self.used + int(sizes.sum())
        while end > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        while first + len(some) > len(self.starts):
            self.starts, self.sizes = (np.append(x, np.zeros_like(x)) for x in (self.starts, self.sizes))
        self.ids[self.used : end] = np.fromiter(chain.from_iterable(new), np.uint32, end - self.used)
        self.starts[first : first + len(some)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + len(some)] = sizes
        found[at] = np.arange(first, first + len(some))
        self.number.update(zip(some, range(first, first + len(some)), strict=True))
        self.used = end
        self.held += sum(map(len, some))
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, and how many each has."""
        rows = len(offsets) - 1
        starts, _, _ = words(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        solid = NOT_SPACE[data]
        edge = np.zeros(len(data), bool)
        edge[starts] = True
        kind = _KIND[data]
        edge[1:] |= _PARTED[kind[:-1] * np.uint8(4) + kind[1:]]
        lower = data
        if not ((data[:-1] == 60) & (data[1:] == 124)).any():  # no special token can be meant
            lower = LOWER[data]
            accent = np.flatnonzero(data[1:] >= 128)  # it may belong to a capital only, or to a small letter only
            lower[accent] = data[accent]
        body = lower[solid]
        begin = np.flatnonzero(edge[solid])
        places = np.append(begin, len(body)).astype(np.int64)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(places), pa.py_buffer(body)]).dictionary_encode()
        number = self._numbers(parts.dictionary.to_pylist())
        own = parts.indices.to_numpy()
        count = self.sizes[number][own]
        total = np.cumsum(count)
        wide = np.int32 if max(self.used, int(total[-1])) < 1 << 31 else np.int64
        ids = self.ids[np.repeat((self.starts[number][own] - total + count).astype(wide), count) + np.arange(total[-1], dtype=wide)]
        ends = np.searchsorted(begin, np.append(0, np.cumsum(solid))[offsets], "left")  # parts before each text
        return ids, np.diff(np.append(0, total)[ends])


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for each process and path."""
    return Encoder(path)


def pieces_of_text(data: np.ndarray) -> Iterator[np.ndarray]:
    """``data`` in consecutive pieces of about a chunk that end after a blank; a longer run without one is a piece."""
    at = 0
    while at < len(data):
        end = min(at + CHUNK_BYTES, len(data))
        while end < len(data):
            gaps = np.flatnonzero(~NOT_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
                break
            end = min(end + CHUNK_BYTES, len(data))
        yield data[at:end]
        at = end
