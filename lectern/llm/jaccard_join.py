"""N-gram Jaccard join: documents whose sets of word n-grams are alike, as connected groups.

A size-aware join of heavy and light sets:

* Light sets (few shingles) are linked through subsets: every set lists its subsets of the size that
  it must share with a partner of each size.  Sets that list the same subset as a set of the smaller
  size are like that one, so each is paired with one such set.
* Heavy sets scan inverted lists.  A list holds the rarest shingles of each set only (the prefix that
  two like sets cannot both miss), with sizes and positions to rule pairs out early.
* The boundary is the size at which listing subsets and scanning lists cost least in all, both counted: the
  subsets of the small sets that are in lists, and the lengths of the lists that sets of each size scan.

All pairs, light and heavy, are first held against parity bitmaps of the sets (the bits in which two differ
are no more than the shingles in which the sets differ), then verified on the whole sets.

Rarity is counted over all shingles of all documents: map tasks send packed hashes to slices of the
hash space, which count in how many documents each occurs and send back those that occur in more than
one; all others are in no list.  Exact copies are one class from the start.  Within a list, sets are first
compared with one pivot (the set for which the shingle is rarest); after that only sets in different
components are, so a large group of near copies is joined without making its pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.components import connected_components
from lectern.llm.store import drop, prepare, small, table
from lectern.llm.text_bytes import GOLDEN, U, mix, word_hashes

#: Bytes of text for each slice of the hash space.
SLICE_BYTES = 8 << 20
#: Shingles, and sets, that a map task packs together.
PACK_SHINGLES, PACK_SETS = 1 << 19, 1 << 16
#: Words of a long text whose shingles are made at once.
STRETCH = 1 << 20
#: Sets that would list more subsets than this are heavy in any case.
MOST_SUBSETS = 2000


def _shingles(each: np.ndarray, doc: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles (all words, if there are fewer) in the order of text and hash, and the text of each."""
    count = np.bincount(doc, minlength=rows)
    begin = np.concatenate(([0], np.cumsum(count)))
    size = np.minimum(count, n)[doc]  # words in the shingle that starts at a word
    index = np.arange(len(each))
    whole = index + size <= begin[doc + 1]
    value = np.zeros(len(each), np.uint64)
    for k in range(n):
        at = np.minimum(index + k, len(each) - 1)
        value = np.where(k < size, mix(value * U(3) + each[at] + U(k * int(GOLDEN) & (1 << 64) - 1)), value)
    value, doc = value[whole], doc[whole]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], doc[new]


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """For each text its distinct n-word shingles as sorted hashes (one for all words if there are fewer)."""
    out: list[np.ndarray] = []
    for first, last, each, doc in word_hashes(texts):
        rows = last - first
        if rows == 1 and len(each) > STRETCH:
            parts = [_shingles(each[b : b + STRETCH + n - 1], np.zeros(len(each[b : b + STRETCH + n - 1]), np.int64), 1, n)[0] for b in range(0, len(each) - n + 1, STRETCH)]
            out.append(np.unique(np.concatenate(parts)))
            continue
        if not len(each):
            out += [np.zeros(0, np.uint64)] * rows
            continue
        value, doc = _shingles(each, doc, rows, n)
        cut = np.searchsorted(doc, np.arange(rows + 1))
        out += [value[cut[i] : cut[i + 1]] for i in range(rows)]
    return out


def least_overlap(a: int, b: int, percent: int) -> int:
    """Shingles that sets of sizes a and b share at least, if they are alike."""
    return -(-percent * (a + b) // (100 + percent))


def subset_plan(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, subset size) for each partner size of a set of n."""
    plan = []
    for m in range(-(-percent * n // 100), n * 100 // percent + 1):
        c = least_overlap(n, m, percent)
        if c <= min(n, m):
            plan.append((min(n, m), max(n, m), c))
    return plan


def subset_count(n: int, percent: int) -> int:
    return sum(comb(n, c) for _, _, c in subset_plan(n, percent))


def most_light(percent: int) -> int:
    """The largest size up to which sets list MOST_SUBSETS subsets at most."""
    n = 0
    while subset_count(n + 1, percent) <= MOST_SUBSETS:
        n += 1
    return n


def light_limit(cost: dict[int, tuple[int, int]], percent: int) -> int:
    """The size up to which sets are light; ``cost`` has for each size the sets in lists and the list entries they scan.

    Lists also serve sets that are light but near enough in size to have a heavy partner.
    """
    def total(limit: int) -> int:
        listed = sum(sets * subset_count(n, percent) for n, (sets, _) in cost.items() if n <= limit)
        return listed + sum(entries for n, (_, entries) in cost.items() if n * 100 >= (limit + 1) * percent)

    return min(range(most_light(percent) + 1), key=total)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _subsets(values: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit keys for each of the subsets, and whether the set is of the smaller size of the two."""
    n, keys = len(values), []
    for low, high, c in subset_plan(n, percent):
        left_out = np.array(list(combinations(range(n), n - c)), np.int64).reshape(comb(n, c), n - c)
        both = []
        for seed in (low * 1_000_003 + high, low * 7_000_003 + high * 2 + 1):
            salt = mix(np.array([seed], np.uint64))
            each = mix(values ^ salt)
            both.append(mix(each.sum(dtype=np.uint64) - each[left_out].sum(axis=1, dtype=np.uint64) + salt))
        keys.append((*both, np.full(len(left_out), n == low)))
    return tuple(np.concatenate(x) for x in zip(*keys, strict=True))


def _list_subsets(percent: int):
    def run(batches):
        for batch in batches:
            for cid, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k1, k2, low = _subsets(np.frombuffer(members, np.uint64), percent)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k1), cid)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(low)], ["cid", "k1", "k2", "low"])

    return run


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def set_keys(s: np.ndarray) -> tuple[int, int]:
    return _signed(int(mix(s).sum(dtype=np.uint64))), _signed(int(mix(s ^ GOLDEN).sum(dtype=np.uint64)))


def parity_bitmap(s: np.ndarray) -> bytes:
    """A bit for each residue of hashes, flipped by each member; a power of two of bits, one for each member or more."""
    bits = 1 << max(6, int(len(s) - 1).bit_length())
    odd = np.bincount((s & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """Members that the sets of two bitmaps differ in at least; the longer bitmap is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


PACKED = "slice long, label long, doc_id {kind}, place int, n int, k1 long, k2 long, bitmap binary, members binary, rest binary, sets binary, levels binary"


def _pack(n: int, slices: int, most: int):
    """Rows of documents (rest null; place: the set's number in the pack) and, for each slice, the distinct sets' shingles: 32 bits
    of the hash, sorted, and the set of each."""
    names = [x.split()[0] for x in PACKED.split(", ")]

    def emit(ids, sets, label):
        keys = [set_keys(s) for s in sets]
        number: dict = {}
        place = [number.setdefault(k, len(number)) for k in keys]
        of = {p: s for p, s in zip(place, sets, strict=True)}
        ids = pa.concat_arrays(ids) if len(ids) > 1 else ids[0]
        rows = len(sets)
        none, home = pa.nulls(rows, pa.binary()), -1 - label  # documents pass by themselves
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(rows, home)), pa.array(np.full(rows, label)), ids, pa.array(place, pa.int32()), pa.array([len(s) for s in sets], pa.int32()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
             pa.array([parity_bitmap(s) for s in sets], pa.binary()), pa.array([s.tobytes() if 0 < len(s) <= most else None for s in sets], pa.binary()), none, none, none], names
        )
        value = np.concatenate([of[p] for p in range(len(of))])
        owner = np.repeat(np.arange(len(of)), [len(of[p]) for p in range(len(of))]).astype(np.uint16)
        part = ((value >> U(32)) * U(slices) >> U(32)).astype(np.int64)
        rest = (value & U(0xFFFFFFFF)).astype(np.uint32)
        order = np.lexsort((rest, part))
        part, rest, owner = part[order], rest[order], owner[order]
        cut = np.searchsorted(part, np.arange(slices + 1))
        used = np.flatnonzero(np.diff(cut))
        k = len(used)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(np.full(k, label)), pa.nulls(k, ids.type), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()),
             pa.array([rest[cut[i] : cut[i + 1]].tobytes() for i in used], pa.binary()), pa.array([owner[cut[i] : cut[i + 1]].tobytes() for i in used], pa.binary()), pa.nulls(k, pa.binary())], names
        )

    def run(batches):
        task, packs = TaskContext.get().partitionId(), 0
        ids, sets, held = [], [], 0
        for batch in batches:
            made = shingle_sets(batch.column(1), n)
            at = 0
            while at < len(made):
                stop = at
                while stop < len(made) and held < PACK_SHINGLES and len(sets) + stop - at < PACK_SETS:
                    held += len(made[stop])
                    stop += 1
                ids.append(batch.column(0)[at:stop])
                sets += made[at:stop]
                at = stop
                if held >= PACK_SHINGLES or len(sets) >= PACK_SETS:
                    yield from emit(ids, sets, (task << 32) | packs)
                    packs, ids, sets, held = packs + 1, [], [], 0
        if sets:
            yield from emit(ids, sets, (task << 32) | packs)

    return run


def _count(rows: pa.Table) -> pa.Table:
    """Documents pass; of the packs' shingles in a slice, those that are in more than one set stay, with the level of their count."""
    asks = pc.is_valid(rows.column("rest"))
    packs, docs = rows.filter(asks), rows.filter(pc.invert(asks))
    if not packs.num_rows:
        return docs
    rest = [np.frombuffer(x, np.uint32) for x in packs.column("rest").to_pylist()]
    _, back, counts = np.unique(np.concatenate(rest), return_inverse=True, return_counts=True)
    counts = counts[back]
    level = np.minimum(4 * np.log2(counts), 255).astype(np.uint8)
    cut = np.concatenate(([0], np.cumsum([len(x) for x in rest])))
    keep, found = [], ([], [], [])
    for i, (x, owner) in enumerate(zip(rest, packs.column("sets").to_pylist(), strict=True)):
        span = slice(cut[i], cut[i + 1])
        some = counts[span] > 1
        if some.any():
            keep.append(i)
            for out, values in zip(found, (x, np.frombuffer(owner, np.uint16), level[span]), strict=True):
                out.append(values[some].tobytes())
    packs = packs.take(pa.array(keep, pa.int64()))
    for name, values in zip(("rest", "sets", "levels"), found, strict=True):
        packs = packs.set_column(packs.schema.get_field_index(name), name, pa.array(values, pa.binary()))
    return pa.concat_tables([docs, packs])


SIGNED = "doc_id {kind}, n int, k1 long, k2 long, bitmap binary, members binary, least {plain}, tokens array<long>, first int"


def _prefixes(percent: int):
    """A pack's documents; the first with each set has the least doc_id of them and the shared shingles of its prefix, from place ``first`` on."""

    def run(rows: pa.Table) -> pa.Table:
        asks = pc.is_valid(rows.column("rest"))
        docs, packs = rows.filter(pc.invert(asks)).sort_by("place"), rows.filter(asks)
        place, size = docs.column("place").to_numpy(), docs.column("n").to_numpy()
        lead = np.concatenate(([True], place[1:] != place[:-1])) if len(place) else np.zeros(0, bool)
        sizes = size[lead]
        owner = np.concatenate([np.frombuffer(x, np.uint16) for x in packs.column("sets").to_pylist()] or [np.zeros(0, np.uint16)]).astype(np.int64)
        level = np.concatenate([np.frombuffer(x, np.uint8) for x in packs.column("levels").to_pylist()] or [np.zeros(0, np.uint8)])
        token = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) | part << 32 for x, part in zip(packs.column("rest").to_pylist(), packs.column("slice").to_pylist(), strict=True)] or [np.zeros(0, np.int64)])
        order = np.lexsort((token, level, owner))
        owner, token = owner[order], token[order]
        begin = np.searchsorted(owner, np.arange(len(sizes) + 1))
        alone = sizes - np.diff(begin)  # shingles of no other set come first
        tokens, firsts = [], []
        for i, n in enumerate(sizes.tolist()):
            length = prefix_length(n, percent) if n else 0
            tokens.append(token[begin[i] : begin[i] + max(length - int(alone[i]), 0)])
            firsts.append(int(alone[i]))
        ids = pc.struct_field(docs.column("doc_id").combine_chunks(), 0)
        least = pa.table([docs.column("place"), ids], names=["place", "id"]).group_by("place").aggregate([("id", "min")]).sort_by("place")
        at = np.where(lead, np.cumsum(lead) - 1, -1)
        index = pa.array(at, mask=~lead)
        lists = pa.array(tokens, pa.list_(pa.int64()))
        columns = [docs.column(x) for x in ("doc_id", "n", "k1", "k2")]
        columns += [pc.if_else(pa.array(lead), docs.column(x), pa.scalar(None, pa.binary())) for x in ("bitmap", "members")]
        columns += [least.column("id_min").combine_chunks().take(index), lists.take(index), pa.array(firsts, pa.int32()).take(index)]
        return pa.table(columns, names=[x.split()[0] for x in SIGNED.split(", ")])

    return run


def _whole_sets(n: int):
    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(0), n)
            keys = [set_keys(s) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["k1", "k2", "members"])

    return run


def _likely(percent: int):
    """Pairs (u, v, nu, nv, bu, bv) that the bitmaps leave."""

    def run(batches):
        for batch in batches:
            nu, nv = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = [least_difference(a, b) <= x + y - 2 * least_overlap(x, y, percent) for x, y, a, b in zip(nu, nv, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                at = np.searchsorted(a, b)
                both = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _feasible(percent: int, limit: int):
    """Whether the sets a and b, first sharing a shingle at their positions, may be alike by the lists."""
    need = F.ceil((F.col("a.n") + F.col("b.n")) * percent / F.lit(100 + percent) - 1e-9)
    rest = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    sizes = (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent) & (F.greatest("a.n", "b.n") > limit)
    return sizes & (rest >= need)


def sign_documents(rows: DataFrame, shingle: int, percent: int, most: int) -> DataFrame:
    """The written table of signatures (see SIGNED) of ``rows`` (doc_id, a struct of doc_id and row_key, and text); sets
    of ``most`` members or fewer are in it whole."""
    kind, plain = (x.simpleString() for x in (rows.schema["doc_id"].dataType, rows.schema["doc_id"].dataType["doc_id"].dataType))
    size = rows.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    slices = max(1, -(-size // SLICE_BYTES))
    packs = rows.mapInArrow(_pack(shingle, slices, most), PACKED.format(kind=kind))
    counted = table(packs.groupBy("slice").applyInArrow(_count, PACKED.format(kind=kind)), "counted")
    signed = table(counted.groupBy("label").applyInArrow(_prefixes(percent), SIGNED.format(kind=kind, plain=plain)), "signatures")
    drop(counted)
    return signed


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, limit: int | None = None) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, the smallest doc_id that
    links lead to, row_key, a hash of the text (null as empty), and component, a number that all rows of a
    component have in common (null for empty sets).  Two texts link if 100 * shared >= percent *
    union of their sets of ``shingle``-word n-grams (words are runs of non-blanks, A-Z lower-cased).

    Null and wordless texts have empty sets and link with nothing, also not with each other; component_id is
    then their own.  Rows of equal sets always link, repeated rows too.  A component whose ids are all null has
    none.  Texts of any length are read whole, in stretches.  An empty table gives no rows.  ``limit``
    overrides the boundary between light and heavy sets.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    identity = F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_key")).cast(f"struct<doc_id:{kind},row_key:bigint>")
    rows = docs.select(identity.alias("doc_id"), "text")
    most = most_light(percent) if limit is None else limit
    signed = sign_documents(rows, shingle, percent, most)

    # classes of equal sets; the first row of each pack has what they need
    own = signed.where("n > 0 and first is not null").groupBy("k1", "k2")
    classes = own.agg(F.min("doc_id").alias("rep"), F.min("least").alias("least"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"), F.first("members").alias("members"), F.first("tokens").alias("tokens"), F.first("first").alias("first"))
    classes = table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    # lists that hold more than one set
    lists = classes.select("cid", "n", "first", F.posexplode("tokens").alias("pos", "token")).select("cid", "n", (F.col("pos") + F.col("first")).alias("pos"), "token")
    shared = lists.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("pos", "n", "cid")).alias("p")).where("c > 1")
    shared = table(shared, "shared-tokens")
    lists = whole = table(lists.join(shared, "token"), "lists")
    drop(shared)
    if limit is None:
        cost = lists.where(F.col("n") <= most).groupBy("n").agg(F.countDistinct("cid").alias("sets"), F.sum("c").alias("entries")).collect()  # a row for each size
        limit = light_limit({r["n"]: (r["sets"], r["entries"]) for r in cost}, percent)

    # light sets: a subset shared with a set of the smaller size
    some = classes.where(F.col("n") <= limit).join(lists.select("cid").distinct(), "cid", "left_semi")
    subsets = table(some.select("cid", "members").mapInArrow(_list_subsets(percent), "cid long, k1 long, k2 long, low boolean"), "subsets")
    least = subsets.groupBy("k1", "k2").agg(F.min(F.when(F.col("low"), F.col("cid"))).alias("v"), F.count("*").alias("c"))
    light = subsets.join(least.where("c > 1 and v is not null"), ["k1", "k2"]).where("cid != v").select(F.least("cid", "v").alias("u"), F.greatest("cid", "v").alias("v"))

    def likely(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs that the bitmaps leave, written."""
        side = classes.select("cid", "n", "bitmap")
        both = pairs.join(side.select(F.col("cid").alias("u"), F.col("n").alias("nu"), F.col("bitmap").alias("bu")), "u")
        both = both.join(side.select(F.col("cid").alias("v"), F.col("n").alias("nv"), F.col("bitmap").alias("bv")), "v")
        return table(both.select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(_likely(percent), "u long, v long"), name)

    def alike(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the written pairs whose whole sets are alike, written; only texts that are in a pair are read again."""
        named = table(pairs.select(F.explode(F.array("u", "v")).alias("cid")).distinct(), "wanted", 2 * pairs.count())
        wanted = table(classes.select("cid", "rep", "k1", "k2").join(small(named), "cid", "left_semi"), "wanted-classes")
        texts = rows.join(small(wanted.select("rep")), F.col("doc_id") == F.col("rep"), "left_semi").select("text")
        sets = texts.mapInArrow(_whole_sets(shingle), "k1 long, k2 long, members binary")
        sets = sets.join(small(wanted.select("cid", "k1", "k2")), ["k1", "k2"]).select("cid", "members").dropDuplicates(["cid"])
        sets = table(sets, "sets")
        left = sets.select(F.col("cid").alias("u"), F.col("members").alias("mu"))
        right = sets.select(F.col("cid").alias("v"), F.col("members").alias("mv"))
        both = pairs.join(left, "u").join(right, "v").select("u", "v", "mu", "mv")
        out = table(both.mapInArrow(_verify(percent), "u long, v long"), name)
        drop(named, wanted, sets)
        return out

    lists = lists.where(F.col("n") * 100 >= (limit + 1) * percent)
    near = F.struct("n", "pos").alias("b")
    tried = lists.where(F.col("cid") != F.col("p.cid")).select(F.col("p.cid").alias("u"), F.col("cid").alias("v"), F.struct(F.col("p.n").alias("n"), F.col("p.pos").alias("pos")).alias("a"), near)
    tried = tried.where(_feasible(percent, limit)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    tried = likely(tried.unionByName(light).distinct(), "pivot-pairs")
    # a pair for each set first; then those that are not in one component yet
    found = tried.count()
    begun = table(tried.groupBy("v").agg(F.min("u").alias("u")).select("u", "v"), "first-pairs", found)
    edges = alike(begun, "links")
    roots = connected_components(edges)

    def apart(pairs: DataFrame) -> DataFrame:
        for x in ("u", "v"):
            pairs = pairs.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")), x, "left")
        return pairs.where(F.coalesce("ru", "u") != F.coalesce("rv", "v")).select("u", "v")

    second = table(apart(tried.join(begun, ["u", "v"], "left_anti")), "second-pairs", found)
    if not second.isEmpty():
        edges = edges.unionByName(alike(second, "more-links"))
        roots = connected_components(edges)

    # what is left: sets that share a list but are in different components so far
    placed = lists.join(roots, F.col("cid") == F.col("node"), "left").select("token", "cid", "n", "pos", F.coalesce("root", "cid").alias("root"))
    mixed = table(placed.groupBy("token").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 != r2").select("token"), "mixed-tokens")
    placed = table(placed.join(mixed, "token", "left_semi"), "placed")
    a, b = placed.alias("a"), placed.alias("b")
    more = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.cid") < F.col("b.cid")) & (F.col("a.root") != F.col("b.root")) & _feasible(percent, limit))
    more = likely(more.select(F.col("a.cid").alias("u"), F.col("b.cid").alias("v")).distinct().join(tried, ["u", "v"], "left_anti"), "cross-pairs")
    if not more.isEmpty():
        roots = connected_components(edges.unionByName(alike(more, "cross-links")))
    drop(whole, subsets, tried, begun, second, mixed, placed, more)

    # back to documents
    placed = classes.select("k1", "k2", "cid", "least").join(roots, F.col("cid") == F.col("node"), "left")
    placed = table(placed.select("k1", "k2", "least", F.coalesce("root", "cid").alias("root")), "class-roots")
    drop(classes)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(named, "root").select("k1", "k2", "component_id", F.col("root").alias("component"))
    full = signed.where("n > 0").select("doc_id", "n", "k1", "k2").join(placed, ["k1", "k2"])
    out = full.select("doc_id.doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "doc_id.row_key", "component")
    return out.unionByName(signed.where("n = 0").select("doc_id.doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id.doc_id").alias("component_id"), "doc_id.row_key", F.lit(None).cast("long").alias("component")))
