"""Spelling variants of the words of a corpus, found by Aho-Corasick automata of half words.

Two words that differ by one code point share a half: where the first difference is in the second half of a
word, its first half begins the other word, and else its second half ends it.  So each word is taken as two
segments.  A segment is dealt to a shard by its hash, and a word is sent to the shards of the segments that could
begin or end it (four at most, as lengths differ by one at most).  A shard holds an automaton of its segments
and scans its words; a segment found at the right end of a word of fitting length gives a candidate, and
all candidates are verified in numpy.  The place of the first difference tells which half counts a pair, so
none is counted twice, and a shard returns a count and the best form for each word, not pairs.

A segment that more than ``hot`` words share is not dealt out.  Its words are taken anew at each place of the other half:
there a word is all but one code point, so what a key gathers is bounded by the alphabet, at any size.
"""

from __future__ import annotations

from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import ascii_lower, partitions, prepare, small, table

#: Words that share a segment, beyond which they are compared place by place.
HOT = 1000
#: Rows of a shard, about.
SHARD_ROWS = 40_000
#: Candidates verified at once, and the longest words compared in one matrix.
PAIRS, WIDTH = 1 << 18, 48

_PARTIAL = "word string, near long, best_n long, best string"


def spelled_words(docs: DataFrame, erase: int = 199, least_chars: int = 6, least: int = 5) -> DataFrame:
    """word, n: the words of ``docs`` (doc_id, text) of at least ``least_chars`` code points and ``least`` occurrences.

    A word is a maximal run of Latin letters with A-Z lower-cased.  Where the crc32 of ``doc_id:run`` is
    divisible by ``erase``, the code point at that number modulo the run's length is left out.  A null
    doc_id is empty here, a null text has no words.  Occurrences are counted in each task first.
    """
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"[a-zÀ-ÿ]{{{least_chars},}}"), F.lit(0))
    each = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.char_length("run")))
    words = each.select(F.when(h % erase == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# Verification


class Words:
    """Words of a shard by number, their bytes in Latin-1 (a byte for each code point)."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.raw = [w.encode("latin-1") for w in words]
        self.size = np.fromiter(map(len, self.raw), np.int64, len(words))
        order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
        self.by_rank = np.array(order, np.int64)
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.by_rank] = np.arange(len(words))
        wide = min(int(self.size.max(initial=1)), WIDTH) + 1
        self.matrix = np.zeros((len(words), wide), np.uint8)
        for i, w in enumerate(self.raw):
            if len(w) < wide:
                self.matrix[i, : len(w)] = np.frombuffer(w, np.uint8)
        self.near = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), len(words), np.int64)

    def _first_difference(self, a: int, b: int) -> tuple[int, bool]:
        """Of two long words: the first place where they differ, and whether all else is equal."""
        x, y = self.raw[a], self.raw[b]
        least = min(len(x), len(y))
        differ = np.flatnonzero(np.frombuffer(x, np.uint8, least) != np.frombuffer(y, np.uint8, least))
        c = int(differ[0]) if len(differ) else least
        return c, x != y and x[c + (len(x) >= len(y)) :] == y[c + (len(y) >= len(x)) :]

    def differences(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs: the first place where they differ (the shorter length, if one begins the other), and whether
        they differ by exactly one inserted, deleted or replaced code point."""
        first, one = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
        long = np.maximum(self.size[a], self.size[b]) >= self.matrix.shape[1]
        for k in np.flatnonzero(long):
            if abs(self.size[a[k]] - self.size[b[k]]) <= 1:
                first[k], one[k] = self._first_difference(a[k], b[k])
        k = np.flatnonzero(~long)
        a, b = a[k], b[k]
        change = self.size[a] - self.size[b]
        x, y = self.matrix[np.where(change < 0, b, a)], self.matrix[np.where(change < 0, a, b)]  # the longer, the other
        same = x != y
        first[k] = np.where(same.any(axis=1), same.argmax(axis=1), x.shape[1])
        replaced = same.sum(axis=1) == 1
        # after the place of an insertion the longer word is one ahead
        ahead = (x[:, 1:] != y[:, :-1]) & (np.arange(x.shape[1] - 1) >= first[k][:, None])
        one[k] = np.where(change == 0, replaced, (np.abs(change) == 1) & ~ahead.any(axis=1))
        first[k] = np.minimum(first[k], np.minimum(self.size[a], self.size[b]))
        return first, one

    def count(self, own: np.ndarray, other: np.ndarray) -> None:
        np.add.at(self.near, own, 1)
        np.minimum.at(self.best, own, self.rank[other])

    def found(self) -> pa.Table:
        own = np.flatnonzero(self.near)
        best = self.by_rank[self.best[own]]
        return pa.table({"word": pa.array([self.words[i] for i in own], pa.string()), "near": self.near[own], "best_n": self.n[best], "best": pa.array([self.words[i] for i in best], pa.string())})


def _numbered(rows: pa.Table) -> tuple[Words, np.ndarray]:
    """The distinct words of a shard and the number of each row's."""
    names = rows["word"].combine_chunks().dictionary_encode()
    number = names.indices.to_numpy()
    n = np.zeros(len(names.dictionary), np.int64)
    n[number] = rows["n"].to_numpy()
    return Words(names.dictionary.to_pylist(), n), number


# Halves


def scan_shard(rows: pa.Table) -> pa.Table:
    """``rows``: word, n, half (0: to be scanned only, 1 or 2: this half of the word is in the automaton, too)."""
    words, number = _numbered(rows)
    half = rows["half"].to_numpy()
    held: dict[str, dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
    for which in (1, 2):
        for i in np.unique(number[half == which]):
            w = words.words[i]
            held[w[: len(w) // 2] if which == 1 else w[len(w) // 2 :]][which, len(w)].append(i)
    if not held:
        return words.found()
    automaton = ahocorasick.Automaton()
    for segment, groups in held.items():
        automaton.add_word(segment, (len(segment), {k: np.array(v) for k, v in groups.items()}))
    automaton.make_automaton()
    own, other, which, waiting = [], [], [], 0

    def verify() -> None:
        a, b = np.concatenate(own), np.concatenate(other)
        first, one = words.differences(a, b)
        second = first >= words.size[a] // 2  # the first half is whole
        right = one & (second == (np.concatenate(which) == 1))
        words.count(a[right], b[right])

    for i, w in enumerate(words.words):
        size = len(w)
        for end, (length, groups) in automaton.iter(w):
            for side in (1, 2):
                if (end + 1 == length) if side == 1 else (end + 1 == size):
                    for fitting in (size - 1, size, size + 1):
                        some = groups.get((side, fitting))
                        if some is not None:
                            own.append(some)
                            other.append(np.full(len(some), i))
                            which.append(np.full(len(some), side))
                            waiting += len(some)
        if waiting >= PAIRS:
            verify()
            own, other, which, waiting = [], [], [], 0
    if waiting:
        verify()
    return words.found()


def scan_places(rows: pa.Table) -> pa.Table:
    """``rows``: word, n, key, place, own (the word's length is that of the key).  A key holds words that are equal but for
    one place."""
    words, number = _numbered(rows)
    keys, own, place = rows["key"].to_numpy(), rows["own"].to_numpy(zero_copy_only=False), rows["place"].to_numpy()
    order = np.argsort(keys, kind="stable")
    edges = np.append(np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])), len(order))
    left, right, at, waiting = [], [], [], 0

    def verify() -> None:
        a, b = np.concatenate(left), np.concatenate(right)
        first, one = words.differences(a, b)
        good = one & (np.minimum(first, words.size[a] - 1) == np.concatenate(at))
        words.count(a[good], b[good])

    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if j - i < 2:
            continue
        members = order[i:j]
        mine, all_of = np.unique(number[members[own[members]]]), np.unique(number[members])
        if len(mine):
            left.append(np.repeat(mine, len(all_of)))
            right.append(np.tile(all_of, len(mine)))
            at.append(np.full(len(left[-1]), place[members[0]]))
            waiting += len(left[-1])
        if waiting >= PAIRS:
            verify()
            left, right, at, waiting = [], [], [], 0
    if waiting:
        verify()
    return words.found()


def _segments(word: Column, least_chars: int) -> Column:
    """Array of (half, segment, own): what could be a half of a word of fitting length."""
    size = F.char_length(word)
    fitting = [size - 1, size, size + 1]
    first = [F.struct(F.lit(1).alias("half"), F.substring(word, F.lit(1), F.floor(s / 2).cast("int")).alias("segment"), (F.floor(s / 2) == F.floor(size / 2)).alias("own"), s >= least_chars) for s in fitting]
    second = [F.struct(F.lit(2).alias("half"), F.right(word, F.ceil(s / 2).cast("int")).alias("segment"), (F.ceil(s / 2) == F.ceil(size / 2)).alias("own"), s >= least_chars) for s in fitting]
    return F.array_distinct(F.filter(F.array(*first, *second), lambda x: x["col4"]))


def near_words(words: DataFrame, least_chars: int = 6, hot: int = HOT) -> DataFrame:
    """word, near (number of words one code point away), best_n and best (that of largest n, then smallest) for each
    of ``words`` (a written table of distinct word, n) that has any."""
    spark = words.sparkSession
    each = words.select("word", "n", F.explode(_segments(F.col("word"), least_chars)).alias("x")).select("word", "n", "x.half", "x.segment", "x.own")
    crowds = small(table(each.groupBy("half", "segment").agg(F.count("*").alias("crowd")).where(F.col("crowd") > hot), "hot-segments"))
    dealt = table(each.join(crowds, ["half", "segment"], "left"), "segments")
    plain = dealt.where("crowd is null")
    shards = max(partitions(spark), -(-plain.count() // SHARD_ROWS))
    plain = plain.select("word", "n", F.when(F.col("own"), F.col("half")).otherwise(0).alias("half"), F.pmod(F.xxhash64("half", "segment"), F.lit(shards)).alias("shard"))
    halves = plain.groupBy("shard").applyInArrow(scan_shard_of, _PARTIAL)
    size, length = F.char_length("word"), F.col("length")
    middle = F.floor(length / 2).cast("int")
    crowded = dealt.where("crowd is not null").select("word", "n", "half", "segment", F.explode(F.array(size - 1, size, size + 1)).alias("length"))
    fits = F.char_length("segment") == F.when(F.col("half") == 1, middle).otherwise(length - middle)
    crowded = crowded.where(fits & (length >= least_chars))
    spots = F.when(F.col("half") == 1, F.sequence(middle, length - 1)).otherwise(F.sequence(F.lit(0), middle - 1))
    placed = crowded.select("word", "n", "length", F.explode(spots).alias("place"))
    rest = F.when(length - 1 > F.col("place"), F.right("word", length - 1 - F.col("place"))).otherwise("")
    key = F.xxhash64("length", "place", F.substring("word", F.lit(1), F.col("place")), rest)
    placed = placed.select("word", "n", "place", (length == size).alias("own"), key.alias("key"), F.pmod(key, F.lit(shards)).alias("shard"))
    places = placed.groupBy("shard").applyInArrow(scan_places_of, _PARTIAL)
    found = halves.union(places).groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("best"))
    return found.select("word", "near", (-F.col("best.less")).alias("best_n"), F.col("best.best").alias("best"))


def scan_shard_of(rows: pa.Table) -> pa.Table:
    return scan_shard(rows)


def scan_places_of(rows: pa.Table) -> pa.Table:
    return scan_places(rows)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for each row of ``forms`` (word, form), whose chains have no cycles: the way to go is doubled each time."""
    ways = table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = small(ways.select(F.col("word").alias("root"), F.col("root").alias("next")))
        longer = table(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "roots")
        ways = longer.select("word", "root")
        if longer.where("more").isEmpty():
            return ways


def spelling_variants(docs: DataFrame, erase: int = 199, least_chars: int = 6, least: int = 5, factor: int = 5, hot: int = HOT) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of ``docs``; see ``spelled_words``.

    Two words are near if they differ by one inserted, deleted or replaced code point.  A word's form is its near word
    of largest n (of these the smallest in code-point order), if that is at least ``factor`` times its own n, else
    null; its root is where forms lead to, or itself.  Repeated rows are counted each; rows without a doc_id
    too.  Texts and words of any length are taken whole.  An empty table gives no rows; extra columns are not read.
    """
    prepare(docs.sparkSession)
    words = table(spelled_words(docs, erase, least_chars, least), "words")
    near = near_words(words, least_chars, hot)
    known = F.col("best_n") >= factor * F.col("n")
    joined = words.join(near, "word", "left")
    formed = table(joined.select("word", "n", F.coalesce("near", F.lit(0)).alias("n_near"), F.when(known, F.col("best")).alias("form"), F.when(known, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
