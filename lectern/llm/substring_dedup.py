"""Suffix-array dedup of long byte strings across a corpus, by longest-previous-factor arrays.

Every window of ``length`` bytes has an anchor, its smallest hashed k-mer, at an offset from its start; equal
windows have equal anchors at equal offsets.  Offsets are dealt into a few ranges.  The windows of a text that
have one anchor and a range in common form a segment, whose key is the hash of the bytes that all windows of
that anchor and range contain.  A key that occurs once rules its segment out.  All other segments are put in
order, key by key: of each distinct content the first occurrence and, if there are more, a second one, which
stands for all later ones (their matches are the same).

Within a key, windows are put in suffix order: the rank of a window is that of the bytes before the anchor,
then that of the bytes from the anchor on, and both grow byte by byte.  The previous and next smaller
positions in that order give the longest previous factors (cut off at ``length``), the previous and next
larger ones the longest next factors.  So a window is known to have an earlier or a later match.

A key whose contents exceed ``group_bytes`` is not gathered: its segments are cut into narrower ranges of
offsets, whose keys hold more bytes, down to single offsets, where a key is a whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import counted_small, drop, key_filter, may_hold, prepare, small, table, text_key
from lectern.llm.text_bytes import CHUNK_BYTES, GOLDEN, U, Rolling, chunks, mix

#: Low bits of a minimizer's rank that hold the position, so that the last of equal k-mers is taken; stretches are shorter.
PLACE = U((1 << 28) - 1)
#: Bytes of distinct contents of one key that a task gathers at most.
GROUP_BYTES = 2 << 20
#: Ranges of offsets for the first keys and for those of hot ones; after them come single offsets.
RANGES = (2, 16)


def kmer_size(length: int) -> int:
    return max(1, min(32, length // 4))


def ranges_of(length: int) -> list[int]:
    """Numbers of ranges of offsets, from the first keys to single offsets."""
    span = length - kmer_size(length) + 1
    return [*[r for r in RANGES if r < span], span]


def _window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def stretches(texts: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place of the first byte in its text): chunks of texts, and long texts in
    stretches that overlap by length - 1 bytes, so that each window is in one of them."""
    for first, _, data, offsets in chunks(texts):
        if len(offsets) > 2 or len(data) <= CHUNK_BYTES + length:
            yield first, data, offsets, 0
            continue
        for at in range(0, len(data) - length + 1, CHUNK_BYTES):
            some = data[at : at + CHUNK_BYTES + length - 1]
            yield first, some, np.array([0, len(some)]), at


def segments(data: np.ndarray, offsets: np.ndarray, length: int, ranges: int) -> tuple[np.ndarray, ...]:
    """(text index, start in the text, number of windows, offset of the anchor from the start, key, hash of the
    bytes) of all segments."""
    k, none = kmer_size(length), np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none, none
    span = length - k + 1
    roll = Rolling(data)
    at = np.arange(len(data) - k + 1)
    hashes = roll.spans(at, at + k)
    ranks = (hashes & ~PLACE) | (PLACE - (at.astype(np.uint64) & PLACE))
    least = _window_minimum(ranks, span)
    place = (PLACE - (least & PLACE)).astype(np.int64)
    at = at[: len(place)]
    part = (place - at) * ranges // span
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]  # of the text a byte is in
    valid = at + length <= ends
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (part[1:] != part[:-1]) | (ends[1:] != ends[:-1])
    begin = np.flatnonzero(first)
    count = np.bincount((np.cumsum(first) - 1)[valid], minlength=len(begin)) if len(begin) else none
    doc = np.searchsorted(offsets, begin, "right") - 1
    number = np.arange(ranges + 1)
    edge = -(-number * span // ranges)  # offsets of range i are edge[i] ... edge[i + 1] - 1
    own, anchor = part[begin], place[begin]
    core = roll.spans(anchor - edge[own], anchor - edge[own + 1] + 1 + length)
    key = mix(core + (own.astype(np.uint64) + U(1)) * GOLDEN)
    whole = roll.spans(begin, begin + count + length - 1)
    return doc, begin - offsets[doc], count, anchor - begin, key.view(np.int64), whole.view(np.int64)


def _keys(length: int, ranges: int):
    def run(batches):
        for batch in batches:
            for _, data, offsets, _ in stretches(batch.column(0), length):
                keys, counts = np.unique(segments(data, offsets, length, ranges)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["k", "c"])

    return run


def _segment_rows(length: int, ranges: int, again):
    def run(batches):
        for batch in batches:
            for first, data, offsets, base in stretches(batch.column(2), length):
                found = segments(data, offsets, length, ranges)
                some = may_hold(again.value, found[4])
                doc, start, count, anchor, key, whole = (x[some] for x in found)
                rows = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(start + base, pa.int64()), pa.array(count, pa.int32()), pa.array(anchor, pa.int32()), pa.array(key, pa.int64()), pa.array(whole, pa.int64())],
                    ["doc_id", "row_key", "start", "windows", "anchor", "k", "h"],
                )

    return run


def _cut_segments(length: int):
    """Rows (doc_id, row_key, text, wanted) to one row for each wanted segment, with its bytes."""

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(batch.num_rows), count)
            flat = lists.flatten()
            start, size = flat.field("start").to_numpy(), flat.field("windows").to_numpy() + length - 1
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            pieces = [texts[r][s : s + n] for r, s, n in zip(rows.tolist(), start.tolist(), size.tolist(), strict=True)]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [flat.field("k"), flat.field("h"), flat.field("c"), batch.column(0).take(take), batch.column(1).take(take), flat.field("start"), flat.field("anchor"), pa.array(pieces, pa.binary())],
                ["k", "h", "c", "doc_id", "row_key", "start", "anchor", "piece"],
            )

    return run


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _split_segments(length: int, ranges: int):
    """Segments with their bytes to the narrower segments that their windows fall into."""

    def run(batches):
        for batch in batches:
            data, offsets = _bytes_of(batch.column("piece"))
            doc, start, count, anchor, key, whole = segments(data, offsets, length, ranges)
            rows, begin = pa.array(doc), offsets[doc] + start
            body = data.tobytes()
            pieces = [body[b : b + n] for b, n in zip(begin.tolist(), (count + length - 1).tolist(), strict=True)]
            old = [batch.column(x).take(rows) for x in ("k", "h", "c", "doc_id", "row_key", "start")]
            yield pa.RecordBatch.from_arrays(
                [old[0], old[1], pa.array(start, pa.int32()), pa.array(key, pa.int64()), pa.array(whole, pa.int64()), *old[2:5], pa.array(start + old[5].to_numpy(), pa.int64()), pa.array(anchor, pa.int32()), pa.array(pieces, pa.binary())],
                ["old_k", "old_h", "shift", "k", "h", "c", "doc_id", "row_key", "start", "anchor", "piece"],
            )

    return run


def context_ranks(group: np.ndarray, first: np.ndarray, room: np.ndarray, data: np.ndarray, steps: int, back: bool) -> np.ndarray:
    """ranks[n, p]: the place, in the order of bytes, of the n bytes of piece p from ``first`` on (``back``: before
    it) among pieces of its group; equal strings of one group have equal ranks.  A piece has ``room`` bytes there."""
    ranks = np.zeros((steps + 1, len(group)), np.int64)
    ranks[0] = group
    for n in range(1, steps + 1):
        on = np.flatnonzero(room >= n)
        if not len(on):
            break
        if back:
            joint = data[first[on] - n].astype(np.int64) << 32 | ranks[n - 1, on]
        else:
            joint = ranks[n - 1, on] << 8 | data[first[on] + n - 1]
        ranks[n, on] = np.unique(joint, return_inverse=True)[1]
    return ranks


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it with a smaller value, or -1; all values differ.

    Whatever lies between a place and its candidate is larger, so a candidate that is larger too passes
    on its own candidate; steps double as they compound.
    """
    near = np.arange(-1, len(values) - 1)
    todo = np.arange(len(values))
    while len(todo):
        todo = todo[near[todo] >= 0]
        todo = todo[values[near[todo]] > values[todo]]
        near[todo] = near[near[todo]]
    return near


def longest_factors(order: np.ndarray, same: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """By position: the longest previous and the longest next factor, cut off at ``length`` (shorter ones: 0).

    ``order`` has the positions in suffix order and ``same`` whether the window at a place equals the one
    at the place before.  A factor of ``length`` bytes starts at the nearest smaller (larger) position
    before or after in the order, if that is among the equal windows.
    """
    n = len(order)
    run = np.cumsum(~same)
    found = []
    for values in (order, -order):
        before = nearest_smaller(values)
        after = n - 1 - nearest_smaller(values[::-1])[::-1]  # n where there is none
        match = (before >= 0) & (run[np.maximum(before, 0)] == run)
        match |= (after < n) & (run[np.minimum(after, n - 1)] == run)
        factor = np.zeros(n, np.int64)
        factor[order] = match * length
        found.append(factor)
    return found[0], found[1]


def match_pieces(group: np.ndarray, twice: np.ndarray, anchor: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For all windows of pieces in the order of their positions: piece, window in the piece, whether it is of the
    second occurrence (pieces that occur ``twice``), longest previous and longest next factor.

    Pieces of one ``group`` have the same k-mer at ``anchor``; only they can have windows in common.
    """
    k = kmer_size(length)
    span, size = length - k + 1, np.diff(offsets)
    at = offsets[:-1] + anchor
    left = context_ranks(group, at, anchor, data, span - 1, True)
    right = context_ranks(group, at + k, size - anchor - k, data, span - 1, False)
    count = size - length + 1
    piece = np.repeat(np.arange(len(size)), count)
    window = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    offset = anchor[piece] - window
    rank = offset << 48 | left[offset, piece] << 24 | right[span - 1 - offset, piece]
    again = np.flatnonzero(twice[piece])
    piece, window, rank = (np.concatenate((x, x[again])) for x in (piece, window, rank))
    second = np.arange(len(piece)) >= len(piece) - len(again)
    order = np.argsort(rank, kind="stable")
    ordered = rank[order]
    same = np.concatenate(([False], ordered[1:] == ordered[:-1]))[: len(order)]
    previous, following = longest_factors(order, same, length)
    return piece, window, second, previous, following


def _match_groups(length: int, keep_first: bool):
    """Segments sorted by key and position, to the ranges of their windows that go, by occurrence."""

    def flush(held):
        rows = pa.Table.from_batches(held).combine_chunks()
        group = np.unique(rows.column("k").to_numpy(), return_inverse=True)[1]
        data, offsets = _bytes_of(rows.column("piece").combine_chunks())
        twice = rows.column("c").to_numpy() > 1
        piece, window, second, previous, following = match_pieces(group, twice, rows.column("anchor").to_numpy().astype(np.int64), data, offsets, length)
        goes = previous >= length
        if not keep_first:
            goes |= following >= length
        joined = np.concatenate(([False], goes[1:] & goes[:-1] & (piece[1:] == piece[:-1]) & (second[1:] == second[:-1])))[: len(goes)]
        begin = np.flatnonzero(goes & ~joined)
        stop = np.flatnonzero(goes & ~np.concatenate((joined[1:], [False]))[: len(goes)])
        take = pa.array(piece[begin])
        columns = [rows.column(x).combine_chunks().take(take) for x in ("k", "h")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(second[begin]), pa.array(window[begin], pa.int32()), pa.array(window[stop] + 1, pa.int32())], ["k", "h", "later", "b", "e"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            k = batch.column("k").to_numpy()
            last = np.flatnonzero(k[1:] != k[:-1])  # the place before the last change of key
            new = not held or len(k) and held[-1].column("k")[-1].as_py() != k[0]
            if size >= CHUNK_BYTES and held and (new or len(last)):
                cut = 0 if new else int(last[-1]) + 1
                yield flush([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                size += sum(len(x) for x in batch.column("piece").to_pylist())
        if held:
            yield flush(held)

    return run


def matched_windows(units: DataFrame, length: int, group_bytes: int, keep_first: bool, level: int = 0) -> DataFrame:
    """(k, h, later, b, e): ranges of windows of ``units`` that go, of the first occurrence or of all ``later`` ones.

    ``units`` is a written table with a row for each content: k, h, c (occurrences), doc_id, row_key and
    start of the first, anchor, piece.
    """
    plan = ranges_of(length)
    kind = units.schema["doc_id"].dataType.simpleString()
    sizes = units.groupBy("k").agg(F.sum("c").alias("n"), F.sum(F.octet_length("piece")).alias("size")).where("n > 1")
    sizes = table(sizes.select("k", (F.col("size") > group_bytes).alias("hot")), "repeated-keys")
    known = units.join(sizes, "k")
    last = level + 1 >= len(plan)
    calm = (known if last else known.where("not hot")).drop("hot")
    order = ["k", "doc_id", "row_key", "start"]
    found = calm.repartition(F.col("k")).sortWithinPartitions(*order).mapInArrow(_match_groups(length, keep_first), "k long, h long, later boolean, b int, e int")
    if last or sizes.where("hot").isEmpty():
        return table(found, "matches")
    schema = f"old_k long, old_h long, shift int, k long, h long, c long, doc_id {kind}, row_key long, start long, anchor int, piece binary"
    cut = table(known.where("hot").mapInArrow(_split_segments(length, plan[level + 1]), schema), "narrow-segments")
    first = F.min(F.struct("doc_id", "row_key", "start", "anchor", "piece"))
    merged = cut.groupBy("k", "h").agg(F.sum("c").alias("c"), first.alias("at")).select("k", "h", "c", "at.*")
    merged = table(merged, "narrow-contents")
    deeper = matched_windows(merged, length, group_bytes, keep_first, level + 1)
    own = merged.select("k", "h", F.struct("doc_id", "row_key", "start").alias("at"))
    own = own.join(deeper.groupBy("k", "h").agg(F.collect_list(F.struct("later", "b", "e")).alias("told")), ["k", "h"])
    back = cut.select("old_k", "old_h", "shift", "k", "h", F.struct("doc_id", "row_key", "start").alias("own")).join(own, ["k", "h"])
    back = back.select("old_k", "old_h", "shift", F.col("own").eqNullSafe(F.col("at")).alias("is_first"), F.explode("told").alias("t"))
    # what is not the first occurrence here counts as a later one, for the first of its parent as well
    later = F.explode(F.when(F.col("is_first"), F.array("t.later")).when(F.col("t.later"), F.array(F.lit(False), F.lit(True))).otherwise(F.array().cast("array<boolean>")))
    back = back.select(F.col("old_k").alias("k"), F.col("old_h").alias("h"), later.alias("later"), (F.col("t.b") + F.col("shift")).alias("b"), (F.col("t.e") + F.col("shift")).alias("e"))
    found = table(found.unionByName(back), "matches")
    drop(cut, merged, deeper, sizes)
    return found


def repeated_ranges(rows: DataFrame, length: int, group_bytes: int = GROUP_BYTES, keep_first: bool = False) -> DataFrame:
    """(rid, ranges), a written table: for each of ``rows`` (rid, a struct of doc_id and row_key, and text) that has any,
    the ranges [b, e) of window starts whose window of ``length`` bytes also starts anywhere else (with
    ``keep_first``: anywhere before)."""
    kind = rows.schema["rid"].dataType["doc_id"].dataType.simpleString()
    ranges = ranges_of(length)[0]
    texts = rows.select(F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(_keys(length, ranges), "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))
    again = table(counted.where("c > 1").select("k"), "again")
    held = rows.sparkSession.sparkContext.broadcast(key_filter(again))
    cut = rows.select("rid.doc_id", "rid.row_key", F.col("text").cast("binary").alias("text"))
    parts = cut.mapInArrow(_segment_rows(length, ranges, held), f"doc_id {kind}, row_key long, start long, windows int, anchor int, k long, h long")
    parts = table(parts.join(small(again), "k"), "segments")
    drop(again)

    contents = parts.groupBy("k", "h").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "row_key", "start", "windows", "anchor")).alias("at"))
    wanted = contents.select(F.struct("at.doc_id", "at.row_key").alias("rid"), F.struct("at.start", "at.windows", "at.anchor", "k", "h", "c").alias("s"))
    wanted = table(wanted.groupBy("rid").agg(F.collect_list("s").alias("wanted")), "wanted-segments")
    some = rows.select("rid", F.col("text").cast("binary").alias("text")).join(small(wanted.select("rid")), "rid", "left_semi")
    some = some.join(wanted, "rid").dropDuplicates(["rid"]).select("rid.doc_id", "rid.row_key", "text", "wanted")
    units = table(some.mapInArrow(_cut_segments(length), f"k long, h long, c long, doc_id {kind}, row_key long, start long, anchor int, piece binary"), "units")
    drop(wanted)

    found = matched_windows(units, length, group_bytes, keep_first)
    firsts = units.select("k", "h", F.struct("doc_id", "row_key", "start").alias("at"))
    told = firsts.join(found.groupBy("k", "h").agg(F.collect_list(F.struct("later", "b", "e")).alias("told")), ["k", "h"])
    told = table(told, "told")
    drop(units, found)
    own = F.struct("doc_id", "row_key", "start").eqNullSafe(F.col("at"))
    hits = parts.join(told, ["k", "h"]).select(F.struct("doc_id", "row_key").alias("rid"), "start", F.explode(F.filter("told", lambda t: t["later"] != own)).alias("t"))
    hits = table(hits.select("rid", F.struct((F.col("start") + F.col("t.b")).alias("b"), (F.col("start") + F.col("t.e")).alias("e")).alias("r")), "hits")
    drop(parts, told)
    out = table(hits.groupBy("rid").agg(F.collect_list("r").alias("ranges")), "ranges")
    drop(hits)
    return out


def _remove(length: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            sizes, removed, spans, digests, kept, starts = [], [], [], [], [], []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for text, ranges in zip(texts, batch.column(2).to_pylist(), strict=True):
                merged: list[list[int]] = []
                for r in sorted((x["b"], x["e"] + length - 1) for x in ranges or ()):
                    if merged and r[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], r[1])
                    else:
                        merged.append([*r])
                left, rest = 0, []
                for b, e in merged:
                    rest.append(text[left:b])
                    left = e
                rest = b"".join([*rest, text[left:]])
                sizes.append(len(text))
                removed.append(len(text) - len(rest))
                spans.append(len(merged))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if keep_text else None)
                starts.append(merged)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()), pa.array(starts, pa.list_(pa.list_(pa.int64())))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = 200, group_bytes: int = GROUP_BYTES, keep_text: bool = False, keep_first: bool = False) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the
    bytes that stay, if ``keep_text``) and spans, the removed [from, to).

    A byte goes if a window of ``length`` bytes that covers it also starts elsewhere, in any document, the
    same one included; with ``keep_first``, only if it also starts earlier, in the order of doc_id (nulls
    first), of the text's hash and of position, so that the first copy stays.

    A null text is empty; texts shorter than ``length`` stay whole.  Repeated rows (equal doc_id and text) are
    each other's copies and lose all windows; with ``keep_first`` they are alike, so all are the first.  Long
    texts are worked on in overlapping stretches.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # the cast makes the type the one that written tables have, so that joins and aggregates share a partitioning
    rows = rows.select(F.struct("doc_id", text_key(F.col("text")).alias("row_key")).cast(f"struct<doc_id:{kind},row_key:bigint>").alias("rid"), "text")
    ranges = repeated_ranges(rows, length, group_bytes, keep_first)
    touched, few = counted_small(ranges.select("rid"), "touched")
    if few:  # only texts that lose something are shuffled
        some = rows.join(touched, "rid", "left_semi").join(ranges, "rid")
        rest = rows.join(touched, "rid", "left_anti").withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType))
        joined = some.unionByName(rest)
    else:
        joined = rows.join(ranges, "rid", "left")
    joined = joined.select("rid.doc_id", F.col("text").cast("binary").alias("text"), "ranges")
    return joined.mapInArrow(_remove(length, keep_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>")
