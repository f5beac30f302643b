"""Vectorised work on the UTF-8 bytes of many texts at once.

All separators used by the operators are ASCII, so words of code points are also words of bytes.
Hashes are 64 bits: a polynomial over byte codes, taken from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in chunks of about this many bytes (a longer text is a chunk of its own).
CHUNK_BYTES = 1 << 20

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


BYTE_CODE = mix((np.arange(256, dtype=np.uint64) + U(1)) * GOLDEN)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_codes = np.arange(256)
#: Not one of space, tab, line feed, vertical tab, form feed, carriage return.
NOT_SPACE = ~((_codes == 32) | ((_codes >= 9) & (_codes <= 13)))

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


class Rolling:
    """Hashes of any spans of ``data``."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * up[: len(data)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * GOLDEN)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    texts = texts.fill_null(b"")
    rows = len(texts)
    if not rows:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, rows + 1, texts.offset * 8)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts (as indexes) of the maximal runs of ``is_word`` bytes; none spans two texts."""
    inside = is_word[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    before[edge] = False
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(texts: pa.Array, is_word: np.ndarray = NOT_SPACE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes of all words with A-Z lower-cased, the text of each as an index).

    A text longer than a chunk is hashed in pieces that end between words, so memory grows with its
    words, not with its bytes (a single word longer than a chunk is hashed as one).
    """
    for first, last, data, offsets in chunks(texts):
        if len(offsets) > 2 or len(data) <= CHUNK_BYTES:
            data = LOWER[data]
            starts, ends, doc = words(data, offsets, is_word)
            yield first, last, Rolling(data).spans(starts, ends), doc
            continue
        found, at = [], 0
        while at < len(data):
            end = at + CHUNK_BYTES
            if end < len(data):
                gaps = np.flatnonzero(~is_word[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:
                    while end < len(data) and is_word[data[end]]:
                        end += 1
            some = LOWER[data[at:end]]
            starts, ends, _ = words(some, np.array([0, len(some)]), is_word)
            found.append(Rolling(some).spans(starts, ends))
            at = end
        each = np.concatenate(found)
        yield first, last, each, np.zeros(len(each), np.int64)
