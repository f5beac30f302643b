"""Language-model scoring with a log-frequency Bloom filter.

Training tokens and pairs of tokens are counted over all training documents: map tasks add up what
they see, and packed arrays of (hash, count) meet by leading bits of the hash.  A count is quantised to a level q,
exactly up to EXACT and on a logarithmic scale beyond, and (gram, 1) ... (gram, q) are entered in a Bloom filter, whose slices
are built where the counts are, each with SPARE bits or more for an entry.  A count is read by probing level
after level until one is missing.  All slices' bits are broadcast while they are BROADCAST_BITS at most;
beyond that, grams are sent to their slices and the levels come back.

A probability is a mixture of the token's own and of its share among what follows the token before it.  The filter
also finds pairs that it was not given, at a rate that its fill tells; shares are divided by the mass that they
have in all with those, so that the probabilities of all tokens after a context add up to 1.

Exact counts, for the base score, do not come from the filter: the most frequent tokens are broadcast as
a table of bounded size, all others are looked up by shuffling packed arrays of hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import prepare, table
from lectern.llm.text_bytes import GOLDEN, LOWER, U, Rolling, chunks, mix, words

#: Counts of tokens and of pairs are their own level up to EXACT, then quantised to powers of LEVEL_BASE.  A token's count is what
#: shares of all that follows it are taken of, so it is fine; the errors of many pairs level each other out.
EXACT, LEVEL_BASE = (32, 8), (1.03, 1.3)
#: Contexts share a weight if their counts fall between the same powers of this.
WEIGHT_BASE = 1.4
#: Probes for each level of a gram.
PROBES = 4
#: Bits of a block of the filter as a power of two, and how many levels of a gram share one.
BLOCK_BITS, BLOCK_LEVELS = 9, 8
#: Bits for an entry of the filter, rounded up to a power of two by slice, and the most bits that are broadcast.
SPARE, BROADCAST_BITS = 5, 1 << 30
#: Broadcast exact counts at most.
HOT_TOKENS = 1 << 17
#: Distinct grams that a map task holds before it emits them.
HELD = 3_000_000
#: The highest level there is: that of 2 ** 63.  Probing ends there, whatever the filter holds.
TOP_LEVEL = EXACT[0] + int((63 * np.log(2) - np.log(EXACT[0])) / np.log(LEVEL_BASE[0]))
#: Weights, by the count of the token before.
LEVELS = 64
#: Bytes of training text for each slice.
SLICE_BYTES = 8 << 20
END = int(mix(np.array([0xE0F], np.uint64))[0])


def slice_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of a sorted array, and where each begins, with the end."""
    if not len(values):
        return values, np.zeros(1, np.int64)
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[begin], np.append(begin, len(values))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens with an end after each text, and the text of each."""
    data = LOWER[data]
    starts, ends, doc = words(data, offsets)
    rows = len(offsets) - 1
    count = np.bincount(doc, minlength=rows)
    out = np.full(len(starts) + rows, END, np.uint64)
    docs = np.repeat(np.arange(rows), count + 1)
    out[np.arange(len(starts)) + doc] = Rolling(data).spans(starts, ends)
    return out, docs


def pairs(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The hash of each token with the one before it in its text (the first: with the end mark)."""
    before = np.full(len(h), END, np.uint64)
    before[1:] = np.where(doc[1:] == doc[:-1], h[:-1], U(END))
    return mix(before * U(3) + mix(h + GOLDEN))


def _merge(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes, kind="stable")
    hashes, counts = hashes[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.zeros(0, np.int64)
    return hashes[new], np.add.reduceat(counts, new) if len(new) else counts


def _count_grams(bits: int):
    def emit(kind, held):
        h, c = _merge(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        used, cut = runs(slice_of(h, bits))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(used), kind), pa.int32()), pa.array(used, pa.int64()), pa.array([h[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), pa.array([c[i:j].astype(np.uint32).tobytes() for i, j in zip(cut, cut[1:])], pa.binary())],
            ["kind", "slice", "hashes", "counts"],
        )

    def run(batches):
        held, size = [[], []], [0, 0]
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                h, doc = tokens(data, offsets)
                for kind, grams in enumerate((h, pairs(h, doc))):
                    part = np.unique(grams, return_counts=True)
                    held[kind].append(part)
                    size[kind] += len(part[0])
                    if size[kind] > HELD:
                        held[kind] = [_merge(np.concatenate([x[0] for x in held[kind]]), np.concatenate([x[1] for x in held[kind]]))]
                        size[kind] = len(held[kind][0][0])
                        if size[kind] > HELD // 2:
                            yield emit(kind, held[kind])
                            held[kind], size[kind] = [], 0
        for kind in (0, 1):
            if held[kind]:
                yield emit(kind, held[kind])

    return run


def levels(counts: np.ndarray, kind: int = 0) -> np.ndarray:
    """The quantised level of a count of 1 or more."""
    exact, base = EXACT[kind], LEVEL_BASE[kind]
    above = exact + np.floor(np.log(np.maximum(counts, exact) / exact) / np.log(base) + 1e-9).astype(np.int64)
    return np.where(counts < exact, counts, above)


def level_value(q: np.ndarray, kind: int = 0) -> np.ndarray:
    """The mean count of level q (0 for 0), for counts spread evenly over the level."""
    exact, base = EXACT[kind], LEVEL_BASE[kind]
    q = np.minimum(q, exact + int((63 * np.log(2) - np.log(exact)) / np.log(base)))
    low = np.ceil(exact * base ** np.maximum(q - exact, 0.0) - 1e-6)
    high = np.maximum(np.ceil(exact * base ** np.maximum(q + 1.0 - exact, 0.0) - 1e-6) - 1, low)
    return np.where(q < exact, np.asarray(q, np.float64), (low + high) / 2)


def rough(q: np.ndarray) -> np.ndarray:
    """Levels of tokens for fitting: those beyond EXACT in steps of WEIGHT_BASE."""
    return np.where(q <= EXACT[0], q, EXACT[0] + np.floor((q - EXACT[0]) * np.log(LEVEL_BASE[0]) / np.log(WEIGHT_BASE) + 1e-9).astype(np.int64))


def rough_value(q: np.ndarray) -> np.ndarray:
    """The count that a level for fitting stands for: the middle of its step, on a logarithmic scale."""
    return np.where(q < EXACT[0], np.asarray(q, np.float64), EXACT[0] * WEIGHT_BASE ** (np.maximum(q - EXACT[0], 0) + 0.5))


def probe_bits(h: np.ndarray, level: np.ndarray, kind: int, own_bits: int | np.ndarray) -> np.ndarray:
    """PROBES bit numbers within the gram's slice of 2**own_bits bits, for a level of each gram.

    The probes of BLOCK_LEVELS levels of a gram lie in one block of the size of a cache line, which is read once.
    """
    level = level.astype(np.uint64)
    block = mix(h + (level // U(BLOCK_LEVELS) * U(2) + U(kind)) * GOLDEN)
    spot = mix(block + (level + U(1)) * GOLDEN)
    start = (block >> (U(64 + BLOCK_BITS) - np.asarray(own_bits).astype(np.uint64))) << U(BLOCK_BITS)
    return np.stack([(start + ((spot >> U(BLOCK_BITS * i)) & U((1 << BLOCK_BITS) - 1))).astype(np.int64) for i in range(PROBES)])


def _build_slice(slice_bits: int, own_bits: int | None = None):
    """Counts and bits of a slice; without ``own_bits``, of the size that its entries need."""

    def run(key, frame):
        counted = []
        for kind in (0, 1):
            part = frame[frame["kind"] == kind]
            h = np.concatenate([np.frombuffer(x, np.uint64) for x in part["hashes"]] or [np.zeros(0, np.uint64)])
            c = np.concatenate([np.frombuffer(x, np.uint32) for x in part["counts"]] or [np.zeros(0, np.uint32)]).astype(np.int64)
            counted.append(_merge(h, c))
        entries = sum(int(levels(c, kind).sum()) for kind, (_, c) in enumerate(counted))
        own = own_bits or max(BLOCK_BITS + 1, int(np.ceil(np.log2(max(entries * SPARE, 1)))))
        filled = np.zeros(1 << own, bool)
        for kind, (h, c) in enumerate(counted):
            q = levels(c, kind)
            for level in range(1, int(q.max()) + 1 if len(q) else 1):
                some = h[q >= level]
                filled[probe_bits(some, np.full(len(some), level), kind, own).ravel()] = True
        h, c = counted[0]
        return pd.DataFrame({"slice": [key[0]], "hashes": [h.tobytes()], "counts": [c.tobytes()], "bits": [np.packbits(filled, bitorder="little").tobytes()], "n": [int(c.sum())], "v": [len(h)], "pairs": [len(counted[1][0])], "entries": [entries], "false": [float((filled.reshape(-1, 1 << BLOCK_BITS).mean(axis=1) ** PROBES).mean())]})

    return run


def read_levels(bits: np.ndarray, h: np.ndarray, kind: int, slice_bits: int, own_bits: int | np.ndarray, start: int | np.ndarray) -> np.ndarray:
    """Levels read by probing, from 1 on, until one is missing or TOP_LEVEL is reached; each gram's slice has 2**own_bits
    bits from bit ``start``."""
    own_bits, start = np.broadcast_to(own_bits, len(h)), np.broadcast_to(start, len(h))
    q = np.zeros(len(h), np.int64)
    at = np.arange(len(h))
    level = 1
    while len(at) and level <= TOP_LEVEL:
        probes = probe_bits(h[at], np.full(len(at), level), kind, own_bits[at]) + start[at]
        there = np.ones(len(at), bool)
        for p in probes:
            there &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
        at = at[there]
        q[at] = level
        level += 1
    return q


def known_levels(h: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels of those ``h`` that are among ``hashes`` (0 for others), and which are not."""
    if not len(hashes):
        return np.zeros(len(h), np.int64), np.ones(len(h), bool)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    there = hashes[at] == h
    return np.where(there, levels(counts[at]), 0), ~there


class Model:
    """What is broadcast: the filter's bits (None: too many), frequent tokens' exact counts, totals."""

    def __init__(self, bits: np.ndarray | None, slice_bits: int, own_bits: int | np.ndarray, n: int, v: int, hot: tuple[np.ndarray, np.ndarray], false: float = 0.0, cut: int = TOP_LEVEL):
        self.bits, self.slice_bits, self.n, self.v, self.hot = bits, slice_bits, n, v, hot
        self.own_bits = np.broadcast_to(np.asarray(own_bits, np.int64), 1 << slice_bits)
        self.starts = np.concatenate(([0], np.cumsum(1 << self.own_bits)[:-1]))
        self.weights, self.false, self.cut = np.full(LEVELS, 0.05), false, cut  # hot tokens have levels above the cut

    def level_of(self, h: np.ndarray, kind: int) -> np.ndarray:
        """Levels as ``read_levels`` reads them, but of hot tokens those of their exact counts."""
        out, probed = known_levels(h, *self.hot) if kind == 0 else (np.zeros(len(h), np.int64), np.ones(len(h), bool))
        some = h[probed]
        at = slice_of(some, self.slice_bits)
        out[probed] = read_levels(self.bits, some, kind, self.slice_bits, self.own_bits[at], self.starts[at])
        return out

    def fit_weights(self, told: np.ndarray, times: np.ndarray, rounds: int = 20) -> None:
        """The weight of the share by the count of the token before, by expectation maximisation with each token left
        out; ``times`` counts the tokens that have each row of ``rough`` levels."""
        count = rough_value(np.arange(rough(np.int64(TOP_LEVEL)) + 1))
        own, share, level = self.shares(count[told[:, 0]], count[told[:, 1]], level_value(told[:, 2].astype(np.int64), 1), 1)
        seen = np.bincount(level, times, minlength=LEVELS)
        for _ in range(rounds):
            w = self.weights[level]
            won = np.bincount(level, times * (w * share / (w * share + (1 - w) * own)), minlength=LEVELS)
            self.weights = np.minimum((won + 0.05) / (seen + 1), 0.95)
        self.weights[0] = 0.0

    def log_probabilities(self, told: np.ndarray) -> np.ndarray:
        """log10 of each token's probability after the one before it."""
        count = level_value(np.arange(TOP_LEVEL + 1))
        own, share, level = self.shares(count[told[:, 0]], count[told[:, 1]], level_value(np.arange(TOP_LEVEL + 1), 1)[told[:, 2]])
        w = self.weights[level]
        return np.log10(w * share + (1 - w) * own)

    def shares(self, before: np.ndarray, count: np.ndarray, after: np.ndarray, left_out: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For counts of the token before, the token and both: the token's own probability, its share after the token before it, and the
        weight's number; with ``left_out`` 1 as if the token itself had not been counted.

        Each of all tokens is read as following a context by mistake, or once too often, with the probability
        ``false``, twice with its square, and so on (never more often than the context occurs): so much is added,
        on average, to the context's count, which is what shares are of.
        """
        own = (np.maximum(count - left_out, 0) + 1) / (self.n + self.v + 1)
        after = np.minimum(after, np.minimum(before, count))  # a pair is no more frequent than its parts
        context = np.maximum(before - left_out, 1)
        mistaken = self.false * (1 - self.false ** np.minimum(context, 64)) / (1 - self.false) if self.false < 1 else context
        share = np.maximum(after - left_out, 0) / (context + self.v * mistaken)
        number = np.floor(np.log(np.maximum(before, 1)) / np.log(WEIGHT_BASE) + 1e-9).astype(np.int64) + 1
        return own, share, np.where(before == 0, 0, np.minimum(number, LEVELS - 1))


def told_levels(h: np.ndarray, doc: np.ndarray, level_of) -> np.ndarray:
    """For each token the levels of the counts of the token before it, of itself and of the pair of both."""
    uniq, back = np.unique(h, return_inverse=True)
    level = level_of(uniq, 0)
    own = level[back]
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    before = np.where(first, level[np.searchsorted(uniq, END)], np.concatenate(([0], own[:-1])))
    uniq, back = np.unique(pairs(h, doc), return_inverse=True)
    return np.stack([before, own, level_of(uniq, 1)[back]], 1).astype(np.uint16)


def unpack(data: np.ndarray) -> np.ndarray:
    """The rows of ``told_levels`` in bytes of ``pack``."""
    return np.frombuffer(data.tobytes(), np.uint16).reshape(-1, 3)


def _count_levels(batches):
    """How many tokens of a task have each row of ``rough`` levels, as one number."""
    codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for _, _, data, _ in chunks(batch.column(0)):
            told = unpack(data)
            single = rough(np.arange(TOP_LEVEL + 1))[told[:, :2]]
            part = np.unique(single[:, 0] << 32 | single[:, 1] << 16 | told[:, 2].astype(np.int64), return_counts=True)
            codes, times = _merge(np.concatenate((codes, part[0])), np.concatenate((times, part[1])))
    yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times)], ["code", "times"])


def _log_score(model: Model):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("levels")
            score = np.zeros(batch.num_rows)
            for first, last, data, offsets in chunks(batch.column(at)):
                docs = np.repeat(np.arange(last - first), np.diff(offsets) // 6)
                score[first:last] = np.bincount(docs, model.log_probabilities(unpack(data)), minlength=last - first)
            yield batch.set_column(at, "score", pa.array(score))

    return run


def fit(train: DataFrame) -> tuple[DataFrame, Model]:
    """The written table of slices (slice, bits, hashes and counts of tokens) and the model of ``train`` (text).

    All counts are of all of ``train``, and all are in the filter; the interpolation weights are fitted later, from the levels of all its tokens.
    """
    spark = train.sparkSession
    size = train.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    slice_bits = int(np.ceil(np.log2(max(size / SLICE_BYTES, 1))))
    grams = train.select("text").mapInArrow(_count_grams(slice_bits), "kind int, slice long, hashes binary, counts binary")
    schema = "slice long, hashes binary, counts binary, bits binary, n long, v long, pairs long, entries long, false double"
    slices = table(grams.groupBy("slice").applyInPandas(_build_slice(slice_bits), schema), "gram-slices")
    own_bits = np.full(1 << slice_bits, BLOCK_BITS + 1)
    n = v = 0
    false = 0.0
    for row in slices.select("slice", F.octet_length("bits").alias("size"), "n", "v", "false").collect():
        own_bits[row["slice"]] = int(row["size"]).bit_length() + 2
        n, v, false = n + row["n"], v + row["v"], false + row["false"]  # pairs are spread evenly over slices
    starts = np.concatenate(([0], np.cumsum(1 << own_bits)))
    bits = None
    if starts[-1] <= BROADCAST_BITS:
        bits = np.zeros(starts[-1] >> 3, np.uint8)
        for row in slices.select("slice", "bits").toLocalIterator():
            bits[starts[row["slice"]] >> 3 : starts[row["slice"] + 1] >> 3] = np.frombuffer(row["bits"], np.uint8)

    def histogram(batches):
        for batch in batches:
            for x in batch.column(0).to_pylist():
                q, c = np.unique(levels(np.frombuffer(x, np.int64)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c)], ["q", "c"])

    found = slices.select("counts").mapInArrow(histogram, "q long, c long").groupBy("q").agg(F.sum("c").alias("c")).collect()
    cut, held = 0, 0
    for row in sorted(found, key=lambda r: -r["q"]):
        held += row["c"]
        if held > HOT_TOKENS:
            cut = row["q"]
            break

    def frequent(batches):
        for batch in batches:
            for h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, c = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                keep = levels(c) > cut
                yield pa.RecordBatch.from_arrays([pa.array([h[keep].tobytes()], pa.binary()), pa.array([c[keep].tobytes()], pa.binary())], ["hashes", "counts"])

    # a row for each slice; all slices are read side by side
    hot = [(np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in slices.select("hashes", "counts").mapInArrow(frequent, "hashes binary, counts binary").collect()]
    hot = _merge(np.concatenate([x[0] for x in hot] or [np.zeros(0, np.uint64)]), np.concatenate([x[1] for x in hot] or [np.zeros(0, np.int64)]))
    model = Model(bits, slice_bits, own_bits, n, v, hot, false / (1 << slice_bits), cut)
    return slices, model


def _score(broadcast, slice_bits: int):
    """Rows of three kinds: one for each document (slice null), requests for the counts of rarer tokens and, where the
    filter is not broadcast (then documents have their text and no levels), requests for levels (pairs not null)."""
    names = ["batch", "slice", "row", "doc_id", "held_out", "n_tokens", "known", "base", "levels", "hashes", "rows", "times", "text", "pairs"]

    def cut(h, *more):
        used, at = runs(slice_of(h, slice_bits))
        return used, [[x[i:j].tobytes() for i, j in zip(at, at[1:])] for x in (h, *more)]

    def run(batches):
        model: Model = broadcast.value
        task, number = TaskContext.get().partitionId(), 0
        kinds = [pa.int64(), pa.int64(), pa.int32(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.string(), pa.binary()]
        for batch in batches:
            for first, last, data, offsets in chunks(batch.column(2)):
                label = (task << 32) | number
                number += 1
                h, doc = tokens(data, offsets)
                rows = last - first
                if model.bits is None:
                    told, text = pa.nulls(rows, pa.binary()), batch.column(2)[first:last].cast(pa.string())
                    asked = [dict(zip(used, parts[0], strict=True)) for used, parts in (cut(np.unique(h)), cut(np.unique(pairs(h, doc))))]
                    used = sorted(asked[0].keys() | asked[1].keys())
                    empty = [pa.nulls(len(used), k) for k in kinds]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), label)), pa.array(used, pa.int64()), *empty[2:3], pa.nulls(len(used), batch.column(0).type), *empty[4:9], pa.array([asked[0].get(i, b"") for i in used], pa.binary()), *empty[10:13], pa.array([asked[1].get(i, b"") for i in used], pa.binary())], names)
                else:
                    told, text = pack(told_levels(h, doc, model.level_of), doc, rows), pa.nulls(rows, pa.string())
                # each token of each document once
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))))
                times = np.diff(np.concatenate((new, [len(h)])))
                total = np.bincount(doc, minlength=rows)
                h, doc = h[new], doc[new]
                at = np.minimum(np.searchsorted(model.hot[0], h), max(len(model.hot[0]) - 1, 0))
                hot = model.hot[0][at] == h if len(model.hot[0]) else np.zeros(len(h), bool)
                base = np.bincount(doc[hot], times[hot] * np.log10(model.hot[1][at[hot]] + 1.0), minlength=rows)
                known = np.bincount(doc[hot], times[hot], minlength=rows).astype(np.int64)
                base -= total * np.log10(model.n + model.v + 1.0)
                span = slice(first, last)
                none = pa.nulls(rows, pa.binary())
                ids = batch.column(0)[span]
                kinds[3] = ids.type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, label)), pa.nulls(rows, pa.int64()), pa.array(np.arange(rows), pa.int32()), ids, batch.column(1)[span], pa.array(total, pa.int64()), pa.array(known), pa.array(base), told, none, none, none, text, none], names
                )
                h, doc, times = h[~hot], doc[~hot], times[~hot]
                order = np.argsort(h, kind="stable")
                h, doc, times = h[order], doc[order], times[order]
                used, packed = cut(h, doc.astype(np.uint32), times.astype(np.uint32))
                empty = [pa.nulls(len(used), k) for k in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), label)), pa.array(used, pa.int64()), *empty[2:9], *[pa.array(x, pa.binary()) for x in packed], *empty[12:]], names)

    return run


def pack(told: np.ndarray, doc: np.ndarray, rows: int) -> pa.Array:
    """The rows of ``told_levels`` of each text, as bytes."""
    ends = np.cumsum(np.bincount(doc, minlength=rows))
    return pa.array([x.tobytes() for x in np.split(told, ends[:-1])], pa.binary())


def together(parts: pd.Series, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Packed arrays as one, and where each begins, with the end."""
    cut = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64))) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), kind), cut


def _tell(slice_bits: int, cut: int):
    """The levels that a slice's bits have for the tokens and pairs of each request, or the exact counts for hot tokens.

    The more slices there are, the smaller and the more requests are, so all requests to a slice are read as one array."""

    def run(key, known, asked):
        out = {"batch": asked["batch"], "slice": asked["slice"]}
        bits = np.frombuffer(known["bits"].iloc[0], np.uint8) if len(known) else np.zeros(1 << BLOCK_BITS - 2, np.uint8)
        own = len(bits).bit_length() + 2
        h, c = (np.frombuffer(known[x].iloc[0], t) if len(known) else np.zeros(0, t) for x, t in (("hashes", np.uint64), ("counts", np.int64)))
        hot = levels(c) > cut
        h, c = h[hot], c[hot]

        def told(asked: pd.Series, kind: int) -> list[bytes]:
            grams, cut = together(asked, np.uint64)
            grams, back = np.unique(grams, return_inverse=True)  # frequent pairs are asked for by many batches
            q, probed = known_levels(grams, h, c) if kind == 0 else (np.zeros(len(grams), np.int64), np.ones(len(grams), bool))
            q[probed] = read_levels(bits, grams[probed], kind, slice_bits, own, 0)
            q = q.astype(np.uint16)[back]
            return [q[i:j].tobytes() for i, j in zip(cut, cut[1:])]

        for kind, name in enumerate(("hashes", "pairs")):
            out[name] = told(asked[name], kind)
        return pd.DataFrame(out)

    return run


def _assemble(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a batch with levels in place of the text; answers in order of slices are in order of hashes."""
    docs, answers = docs.sort_by("row"), answers.sort_by("slice")
    level = [np.frombuffer(b"".join(answers.column(x).to_pylist()), np.uint16).astype(np.int64) for x in ("hashes", "pairs")]
    text = docs.column("text").cast(pa.large_binary()).to_pylist()
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in text])))
    h, doc = tokens(np.frombuffer(b"".join(text), np.uint8), offsets)
    told = told_levels(h, doc, lambda _, kind: level[kind])
    return docs.drop_columns(["text"]).append_column("levels", pack(told, doc, len(text)))


def _answer(key, known, asked):
    h = np.frombuffer(known["hashes"].iloc[0], np.uint64) if len(known) else np.zeros(0, np.uint64)
    c = np.frombuffer(known["counts"].iloc[0], np.int64) if len(known) else np.zeros(0, np.int64)
    hashes, cut = together(asked["hashes"], np.uint64)
    rows, times = (together(asked[x], np.uint32)[0] for x in ("rows", "times"))
    at = np.minimum(np.searchsorted(h, hashes), max(len(h) - 1, 0))
    there = h[at] == hashes if len(h) else np.zeros(len(hashes), bool)
    # the rows of all requests are summed at once, each request's in order
    code = (np.repeat(np.arange(len(asked)), np.diff(cut)) << 32 | rows)[there]
    more, times = times[there] * np.log10(c[at[there]] + 1.0) if len(h) else np.zeros(0), times[there].astype(np.int64)
    order = np.argsort(code, kind="stable")
    used, new = runs(code[order])
    base, seen = (np.add.reduceat(x[order], new[:-1]) if len(used) else x for x in (more, times))
    cut = np.searchsorted(used >> 32, np.arange(len(asked) + 1))
    packed = [[x[i:j].tobytes() for i, j in zip(cut, cut[1:])] for x in ((used & 0xFFFFFFFF).astype(np.uint32), base, seen.astype(np.uint32))]
    return pd.DataFrame({"batch": asked["batch"].to_numpy(), "rows": packed[0], "base": packed[1], "times": packed[2]})


def _finish(key, docs, answers):
    docs = docs.sort_values("row")
    base, known = docs["base"].to_numpy().copy(), docs["known"].to_numpy().copy()
    for rows, more, times in zip(answers["rows"], answers["base"], answers["times"], strict=True):
        rows = np.frombuffer(rows, np.uint32)
        base[rows] += np.frombuffer(more, np.float64)
        known[rows] += np.frombuffer(times, np.uint32)
    return pd.DataFrame({"doc_id": docs["doc_id"], "held_out": docs["held_out"], "n_tokens": docs["n_tokens"], "n_known": known, "base_score": base, "score": docs["score"]})


def score_documents(docs: DataFrame, held_out) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score, the model's log10 probability of the text.  ``held_out`` is a boolean column; the model learns
    from the other rows.

    Tokens are words (runs of non-blanks, A-Z lower-cased) and an end; a null text is empty and has the
    end only.  The base score is exact: add-one probabilities of single tokens.  If all rows are held
    out, nothing is known and both scores rest on the one unseen token.  Repeated rows count, and are scored, as
    often as they occur; texts of any length are counted and scored whole.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    slices, model = fit(rows.where("not held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"batch long, slice long, row int, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, levels binary, hashes binary, rows binary, times binary, text string, pairs binary"
    scored = table(rows.mapInArrow(_score(spark.sparkContext.broadcast(model), model.slice_bits), schema), "scored")
    asked = scored.where("slice is not null and pairs is null").select("batch", "slice", "hashes", "rows", "times")
    answers = slices.select("slice", "hashes", "counts").groupBy("slice").cogroup(asked.groupBy("slice")).applyInPandas(_answer, "batch long, rows binary, base binary, times binary")
    own = scored.where("slice is null").select("batch", "row", "doc_id", "held_out", "n_tokens", "known", "base", "levels")
    if model.bits is None:
        asked = scored.where("pairs is not null").select("batch", "slice", "hashes", "pairs")
        told = slices.select("slice", "bits", "hashes", "counts").groupBy("slice").cogroup(asked.groupBy("slice")).applyInPandas(_tell(model.slice_bits, model.cut), "batch long, slice long, hashes binary, pairs binary")
        texts = scored.where("slice is null").select(*own.columns[:-1], "text")
        own = table(texts.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_assemble, own.schema), "levels")
    # the share's weights depend on the levels only, so counts of equal rows of levels are all that fitting needs; there are
    # about 70 levels for it, so their rows are bounded at any size
    counted = own.where("not held_out").select("levels").mapInArrow(_count_levels, "code long, times long").groupBy("code").agg(F.sum("times").alias("times")).orderBy("code").toPandas()
    code = counted["code"].to_numpy(np.int64)
    model.fit_weights(np.stack([code >> 32, code >> 16 & 65535, code & 65535], 1).astype(np.uint16), counted["times"].to_numpy(np.int64))
    model.bits = model.hot = None  # what is left needs the weights only
    own = own.mapInArrow(_log_score(model), f"batch long, row int, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double")
    out = own.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(_finish, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
