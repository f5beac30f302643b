"""Packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Pieces of equal length can stand for each other, so a packing is a number of sequences for each pattern,
which is a multiset of lengths.  What is searched is therefore bounded by the capacity, not by the data:
demand is a count for each length from 1 to the capacity.  Each island (a Spark task) holds a few packings,
the first made by best fit of falling lengths, others by best fit in disturbed orders.  A child takes whole
well-filled sequences of one parent into the other; sequences of that parent that hold pieces which are now
there twice are taken out, and the pieces displaced by that are put by best fit where there is room.  After
each round every island sends copies of its best packings to the next one.  The search ends when a packing
has as few sequences as the sum of lengths allows, or after the last round.

Then each piece gets its place: pieces of one length are numbered, by task and within the task, and the
numbers are dealt to the places of that length in the patterns.
"""

from __future__ import annotations

import bisect
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm.store import prepare, small, table
from lectern.llm.text_bytes import chunks
from lectern.llm.tokens import encoder, pieces_of_text

CAPACITY = 4096
ISLANDS, ROUNDS, POPULATION, CHILDREN, ELITES = 6, 3, 4, 8, 2
#: A packing of more patterns is not kept; best fit makes four for each length at most.
PATTERNS = 8 * CAPACITY

#: A pattern: (length, how often) in falling order of length.  A packing: the number of sequences of each pattern.
Pattern = tuple[tuple[int, int], ...]
Packing = dict[Pattern, int]


# Pieces


def _tokens(path: str, end_id: int, batch: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, ids with the closing one, their number for each row)."""
    own = encoder(path)
    for first, last, data, offsets in chunks(batch):
        if last - first == 1:  # may be long
            ids = np.concatenate([*(own.encode(x, np.array([0, len(x)]))[0] for x in pieces_of_text(data)), np.array([end_id], np.uint32)])
            yield first, last, ids, np.array([len(ids)])
            continue
        ids, n = own.encode(data, offsets)
        ends = np.cumsum(n + 1)
        out = np.full(ends[-1], end_id, np.uint32)
        inner = np.ones(ends[-1], bool)
        inner[ends - 1] = False
        out[inner] = ids
        yield first, last, out, n + 1


def cut_pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this task
        part = TaskContext.get().partitionId()
        for batch in batches:
            for first, last, ids, n in _tokens(path, end_id, batch.column("text")):
                pieces = -(-n // capacity)
                row = np.repeat(np.arange(last - first), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n[row] - start, capacity)
                order = np.argsort(length, kind="stable")
                own = length[order]
                place = np.empty(len(row), np.int64)
                place[order] = np.arange(len(row)) - np.searchsorted(own, own, "left")
                nth = seen[length] + place
                np.add.at(seen, length, 1)
                ends = np.append(0, np.cumsum(length)) * 4
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                ids_of = batch.column("doc_id").slice(first, last - first).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [ids_of, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), blobs, pa.array(np.full(len(row), part, np.int64)), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids", "part", "nth"],
                )

    return run


# Packings


def fill(pattern: Pattern) -> int:
    return sum(length * times for length, times in pattern)


def bins(packing: Packing) -> int:
    return sum(packing.values())


def fitness(packing: Packing, capacity: int) -> float:
    """The mean square of how full sequences are: of packings with as many sequences, that with fuller ones wins."""
    n = bins(packing)
    return sum(count * (fill(p) / capacity) ** 2 for p, count in packing.items()) / n if n else 1.0


def _with(pattern: Pattern, length: int, times: int) -> Pattern:
    held = dict(pattern)
    held[length] = held.get(length, 0) + times
    return tuple(sorted(held.items(), reverse=True))


def best_fit(packing: Packing, items: list[tuple[int, int]], capacity: int) -> Packing:
    """``packing`` with all (length, count) put in, in their order, each into the fullest sequence that has room, as many
    at a time as would go to sequences of one pattern."""
    by_room: dict[int, Packing] = {}
    rooms: list[int] = []

    def add(room: int, pattern: Pattern, count: int) -> None:
        if room not in by_room:
            by_room[room] = {}
            bisect.insort(rooms, room)
        by_room[room][pattern] = by_room[room].get(pattern, 0) + count

    for pattern, count in packing.items():
        add(capacity - fill(pattern), pattern, count)
    for length, count in items:
        while count:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern, there = by_room[room].popitem()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, pattern, there = capacity, (), count
            each = room // length
            whole = min(there, count // each)
            if whole:
                add(room - each * length, _with(pattern, length, each), whole)
                count -= whole * each
            rest = there - whole
            if rest and count < each:  # what is left goes into one more
                if count:
                    add(room - count * length, _with(pattern, length, count), 1)
                    rest, count = rest - 1, 0
            if rest and pattern:
                add(room, pattern, rest)
    out: Packing = {}
    for group in by_room.values():
        for pattern, there in group.items():
            out[pattern] = out.get(pattern, 0) + there
    return out


def contents(packing: Packing, capacity: int) -> np.ndarray:
    held = np.zeros(capacity + 1, np.int64)
    for pattern, count in packing.items():
        for length, times in pattern:
            held[length] += times * count
    return held


def _falling(counts: np.ndarray) -> list[tuple[int, int]]:
    return [(int(i), int(counts[i])) for i in np.flatnonzero(counts)[::-1]]


def _disturbed(items: list[tuple[int, int]], rng: random.Random, by: float) -> list[tuple[int, int]]:
    """Roughly in falling order, each length moved by a random share of itself."""
    return sorted(items, key=lambda x: -x[0] * (1 + by * (rng.random() - 0.5)))


def cross(own: Packing, other: Packing, rng: random.Random, capacity: int) -> Packing:
    """A child of two packings of the same pieces."""
    filled = sorted(other.items(), key=lambda x: -fill(x[0]))
    child: Packing = {}
    for pattern, count in filled[: max(1, len(filled) * 3 // 4)]:  # well-filled sequences, whole
        if rng.random() < 0.5:
            child[pattern] = rng.randint(1, count)
    surplus = contents(child, capacity)
    for pattern, count in sorted(own.items(), key=lambda x: fill(x[0])):  # ill-filled ones go first
        out = min(count, max(-(-max(int(surplus[length]), 0) // times) for length, times in pattern))
        for length, times in pattern:
            surplus[length] -= times * out
        if out < count:
            child[pattern] = child.get(pattern, 0) + count - out
    displaced = _falling(np.maximum(-surplus, 0))
    return best_fit(child, displaced, capacity)


def shaken(own: Packing, rng: random.Random, capacity: int) -> Packing:
    """A mutation: the worst-filled sequences and some others are emptied and their pieces put in anew."""
    kept, freed = {}, np.zeros(capacity + 1, np.int64)
    for k, (pattern, count) in enumerate(sorted(own.items(), key=lambda x: fill(x[0]))):
        out = count if k < 3 else rng.randint(0, count) if rng.random() < 0.1 else 0
        for length, times in pattern:
            freed[length] += times * out
        if out < count:
            kept[pattern] = count - out
    return best_fit(kept, _disturbed(_falling(freed), rng, 0.3), capacity)


def least_bins(demand: np.ndarray, capacity: int) -> int:
    return -(-int((demand * np.arange(capacity + 1)).sum()) // capacity)


def _packed(packing: Packing) -> tuple[list[int], list[int], list[int], list[int]]:
    patterns = list(packing.items())
    return [len(p) for p, _ in patterns], [c for _, c in patterns], [length for p, _ in patterns for length, _ in p], [times for p, _ in patterns for _, times in p]


def _unpacked(sizes, counts, lengths, times) -> Packing:
    ends, out = np.cumsum(sizes), {}
    for end, size, count in zip(ends, sizes, counts, strict=True):
        out[tuple(zip(map(int, lengths[end - size : end]), map(int, times[end - size : end]), strict=True))] = int(count)
    return out


_STATE = "island int, fitness double, bins long, sizes array<int>, counts array<long>, lengths array<int>, times array<int>"


def _row(island: int, packing: Packing, capacity: int) -> tuple:
    return island, fitness(packing, capacity), bins(packing), *_packed(packing)


def _best(packings: list[Packing], capacity: int) -> list[Packing]:
    return sorted(packings, key=lambda p: (bins(p), -fitness(p, capacity)))


def _settle(island: int, demand: np.ndarray, capacity: int, seed: int) -> list[Packing]:
    rng, items = random.Random(f"{seed}:{island}"), _falling(demand)
    first = best_fit({}, items, capacity)
    if bins(first) == least_bins(demand, capacity):
        return [first]
    return [first, *(best_fit({}, _disturbed(items, rng, 0.2), capacity) for _ in range(POPULATION - 1))]


def _generation(island: int, packings: list[Packing], demand: np.ndarray, capacity: int, seed: str) -> list[Packing]:
    """The island's packings after a round: parents by contests of two, children that are no worse stay."""
    rng, least = random.Random(seed), least_bins(demand, capacity)
    held = _best(packings, capacity)[:POPULATION]
    for _ in range(CHILDREN):
        if bins(held[0]) == least:
            break
        own, other = (held[min(rng.randrange(len(held)), rng.randrange(len(held)))] for _ in range(2))
        child = shaken(own, rng, capacity) if own is other or rng.random() < 0.3 else cross(own, other, rng, capacity)
        if len(child) <= PATTERNS and child not in held:
            held = _best([*held, child], capacity)[:POPULATION]
    return held


def evolve(spark, demand: np.ndarray, capacity: int = CAPACITY, islands: int = ISLANDS, rounds: int = ROUNDS, seed: int = 7) -> Packing:
    """A packing of ``demand`` (a count for each length up to ``capacity``, which bounds all that is sent)."""
    if not demand.any():
        return {}
    least = least_bins(demand, capacity)
    names = ["island", "fitness", "bins", "sizes", "counts", "lengths", "times"]

    def settle(key, _):
        return pd.DataFrame([_row(key[0], p, capacity) for p in _settle(key[0], demand, capacity, seed)], columns=names)

    def live_in(k: int):
        def live(key, rows):
            packings = [_unpacked(*r) for r in rows[names[3:]].itertuples(index=False)]
            return pd.DataFrame([_row(key[0], p, capacity) for p in _generation(key[0], packings, demand, capacity, f"{seed}:{k}:{key[0]}")], columns=names)

        return live

    state = table(spark.range(islands).select(F.col("id").cast("int").alias("island")).groupBy("island").applyInPandas(settle, _STATE), "islands")
    for k in range(rounds):
        if state.agg(F.min("bins")).first()[0] == least:
            break

        elite = F.row_number().over(W.partitionBy("island").orderBy("bins", F.desc("fitness")))
        guests = state.withColumn("place", elite).where(F.col("place") <= ELITES).drop("place").withColumn("island", (F.col("island") + 1) % islands)
        state = table(state.union(guests).groupBy("island").applyInPandas(live_in(k), _STATE), "islands")
    won = state.orderBy("bins", F.desc("fitness"), "island").first()
    return _unpacked(won["sizes"], won["counts"], won["lengths"], won["times"])


# Places


def places(packing: Packing) -> tuple[np.ndarray, ...]:
    """For each length the places that its pieces get, in the order of their numbers: (length, first number, first
    sequence, pieces in each sequence, place of the first of them)."""
    found, base = [], 0
    for pattern, count in sorted(packing.items()):
        at = 0
        for length, times in pattern:
            found.append((length, count * times, base, times, at))
            at += length * times
        base += count
    rows = np.array(found, np.int64).reshape(-1, 5)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    ends = np.cumsum(rows[:, 1])
    begin = ends - rows[:, 1]
    first = begin - begin[np.searchsorted(rows[:, 0], rows[:, 0], "left")] if len(rows) else begin
    return rows[:, 0], first, rows[:, 2], rows[:, 3], rows[:, 4]


#: Number of pieces of one length, at most.
_NUMBERS = 1 << 48


def _placed(sent):
    def run(batches):
        length, first, sequence, each, at = sent.value
        keys = length * _NUMBERS + first
        for batch in batches:
            own, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            k = np.searchsorted(keys, own * _NUMBERS + number, "right") - 1
            nth = number - first[k]
            columns = [*batch.columns[:-1], pa.array(sequence[k] + nth // each[k]), pa.array(at[k] + own * (nth % each[k]))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    return run


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """A written table of the pieces of all ``docs`` (doc_id, text): doc_id, piece, start, length, ids (unsigned 32-bit,
    little-endian), and part and nth, which number the pieces of each length.  See ``pack_documents``."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", "text").mapInArrow(cut_pieces(path, capacity, end_id), f"doc_id {kind}, piece int, start long, length long, ids binary, part long, nth long")
    return table(cut, "pieces")


def pack_pieces(pieces: DataFrame, *keep, capacity: int = CAPACITY, islands: int = ISLANDS, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """doc_id, piece, start, length, then ``keep``, sequence_id and offset for each row of ``cut_documents``.

    Only these columns and a count for each task and length are moved; ids stay where they are.
    """
    spark = pieces.sparkSession
    counts = table(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    demand = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        demand[r["length"]] = r["n"]
    packing = evolve(spark, demand, capacity, islands, rounds, seed)
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    bases = table(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base")), "piece-numbers")
    named = pieces.select("doc_id", "piece", "start", "length", *keep, "part", "nth").join(small(bases), ["part", "length"])
    columns = [c for c in named.columns if c not in ("part", "length", "nth", "base", "doc_id", "piece", "start")]
    numbered = named.select("doc_id", "piece", "start", "length", *columns, (F.col("base") + F.col("nth")).alias("number"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields[:-1])
    return numbered.mapInArrow(_placed(spark.sparkContext.broadcast(places(packing))), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """For each piece of ``docs`` (doc_id, text): doc_id, piece (from 0), start, length, ids, sequence_id and offset.

    A document's ids are those of the tokenizer in ``path`` without special tokens (but strings of special tokens in a
    text are these tokens, as the tokenizer has it), then ``end_id``.  Documents of more than ``capacity`` ids
    are cut into pieces of that many, the last of which may be shorter.  Pieces fill their sequence from offset 0
    without gaps.  A null or empty text is ``end_id`` alone.  Repeated rows are packed each for itself, also
    rows without a doc_id.  Very long texts are encoded and cut whole.  An empty table gives no rows;
    extra columns are not read.
    """
    pieces = cut_documents(docs, path, capacity, end_id)
    return pack_pieces(pieces, "ids", capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences of ``pack_documents``, at most a capacity of ids each: sequence_id, ids (binary as above)."""
    inside = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = packed.groupBy("sequence_id").agg(inside.alias("inside"))
    return joined.select("sequence_id", F.unhex(F.array_join(F.transform("inside", lambda x: x["ids"]), "")).alias("ids"))
