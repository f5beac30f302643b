"""Fill-in-the-middle rewriting of documents: a numpy kernel over whole Arrow batches.

A token is a run of non-blank bytes with the blanks before it, or the blanks at the end of a text; blanks
are ASCII, so bytes of UTF-8 do.  One byte-class lookup and one comparison of adjacent bytes mark every
byte that ends a token; running sums that start anew in each document number the tokens, and one binary
search finds the cuts of all rows.  The new texts are gathered together as well, piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import prepare
from lectern.llm.text_bytes import NOT_SPACE, chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = np.frombuffer((PREFIX + SUFFIX + MIDDLE).encode(), np.uint8)
_P, _S, _M = ((np.int64(i), np.int64(3)) for i in (0, 3, 6))
FORMS = ("plain", "psm", "spm")


def _sums(x: np.ndarray) -> np.ndarray:
    """Running sums with a 0 before them."""
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


def token_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True for each byte that is the last of a token."""
    solid = NOT_SPACE[data]
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    after[last] = False
    ends = solid & ~after
    ends[last] = True
    return ends


def _marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True for each text that holds one of the three marks."""
    at = np.flatnonzero((data[:-2] == 60) & (data[2:] == 62) & np.isin(data[1:-1], _MARKS[1::3])) if len(data) > 2 else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, at, "right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[doc[at + 3 <= offsets[doc + 1]]] = True
    return out


def rewrite(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, turn: np.ndarray, spm: np.ndarray) -> tuple[np.ndarray, ...]:
    """(number of tokens, form, code points of the prefix, of the middle, new bytes, their offsets) of all texts at once.
    ``turn`` and ``spm`` tell which texts are drawn for a rewrite and for the suffix-first form."""
    ends = _sums(token_ends(data, offsets))  # tokens that end before a byte, in all texts
    before = ends[offsets[:-1]]
    n = ends[offsets[1:]] - before
    first, second = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
    begin, end = offsets[:-1], offsets[1:]
    cut = [np.where(k == 0, begin, np.searchsorted(ends, before + k, "left")) for k in (first, second)]
    letters = _sums((data & 0xC0) != 0x80)
    form = np.where(~turn | (begin == end) | _marked(data, offsets), 0, np.where(spm, 2, 1))
    size = len(data)
    source = np.concatenate([data, _MARKS])
    rows = len(n)
    starts, lengths = np.zeros((rows, 6), np.int64), np.zeros((rows, 6), np.int64)
    prefix, middle, suffix = (begin, cut[0] - begin), (cut[0], cut[1] - cut[0]), (cut[1], end - cut[1])
    mark = {k: (np.full(rows, size + at), np.full(rows, width)) for k, (at, width) in {"p": _P, "s": _S, "m": _M}.items()}
    for value, pieces in ((1, (mark["p"], prefix, mark["s"], suffix, mark["m"], middle)), (2, (mark["s"], suffix, mark["p"], prefix, mark["m"], middle))):
        own = form == value
        for k, (at, length) in enumerate(pieces):
            starts[own, k], lengths[own, k] = at[own], length[own]
    plain = form == 0
    starts[plain, 0], lengths[plain, 0] = begin[plain], (end - begin)[plain]
    starts, lengths = starts.ravel(), lengths.ravel()
    done = _sums(lengths)
    shift = np.repeat(starts - done[:-1], lengths)
    return n, form, letters[cut[0]] - letters[begin], letters[cut[1]] - letters[cut[0]], source[shift + np.arange(done[-1])], done[::6]


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = [batch.column(f"h{i}").to_numpy() for i in (1, 2)]
        turn, spm = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("turn", "spm"))
        for a, b, data, offsets in chunks(batch.column("text")):
            n, form, prefix, middle, new, at = rewrite(data, offsets, h[0][a:b], h[1][a:b], turn[a:b], spm[a:b])
            plain = form == 0
            output = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(new))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(n), pa.array(np.array(FORMS, object)[form], pa.string()), pa.array(prefix, mask=plain), pa.array(middle, mask=plain), output.cast(pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    Four numbers are the first groups of eight hexadecimal digits of sha256 of ``seed:doc_id``.  The first two, modulo
    n + 1, are the numbers of tokens before the cuts; the third decides whether the text is rewritten (``rate`` of
    100), the fourth in which form: prefix, suffix, middle (psm) or, for ``spm_rate`` of 100, suffix, prefix, middle.
    A null text is empty, and an empty text stays plain, as does one that holds a mark itself; code points of plain
    texts are null.  A null doc_id is drawn as an empty one.  Rows of one id get the same draws, so repeated rows give
    equal rows.  Each row is worked on alone: texts of any length are cut whole, nothing is shuffled, and a task
    holds about 1 MB of texts, or one longer text, at a time.  An empty table gives no rows; extra columns are not read.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    drawn = docs.select("doc_id", "text", h[0].alias("h1"), h[1].alias("h2"), (h[2] % 100 < rate).alias("turn"), (h[3] % 100 < spm_rate).alias("spm"))
    return drawn.mapInArrow(_kernel, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that ``output`` was made from.  The marks of a rewritten text are its only ones, so they are sought."""
    p, s, m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    psm = F.concat(F.substring(output, p + 3, s - p - 3), F.substring(output, m + 3, F.char_length(output)), F.substring(output, s + 3, m - s - 3))
    spm = F.concat(F.substring(output, p + 3, m - p - 3), F.substring(output, m + 3, F.char_length(output)), F.substring(output, s + 3, p - s - 3))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
