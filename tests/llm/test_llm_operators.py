"""The corpus operators against brute force, and on rows that are odd in every way."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import chat, decontaminate, fingerprint, jaccard_join, language_id, line_dedup, lm_score, mixing, quality, substring_dedup
from lectern.llm.components import connected_components
from lectern.llm.store import bucket_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators use themselves.
CLASH = ["row_key", "n", "k", "h1", "term", "u", "v", "node", "root", "probability", "part", "n_words", "spans", "start", "cid", "rep", "score", "topic", "fingerprint", "key", "pos"]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def corpus(seed=1, n=60):
    """Texts with exact and near copies, shared lines and passages, odd characters and lengths."""
    rng = random.Random(seed)
    vocabulary = ["w" + "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = []
    for i in range(n):
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25))) for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), rng.choice(["Shared Line", "  shared line\t"]))
        if i % 5 == 0:
            lines.append(passage)
        text = "\n".join(lines)
        if i % 7 == 0 and texts:
            text = rng.choice(texts)
        elif i % 4 == 0 and texts:
            parts = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 2)):
                parts[rng.randrange(len(parts))] = rng.choice(vocabulary)
            text = " ".join(parts)
        texts.append(text)
    texts += ["", " \n\t", "one", "One two", "a b c d e f g h i", "a b c d e f g h i j", "😀 astral 😀", "x" * 900, "12 34"]
    langs = ["en", "fr", None]
    return [(i, t, langs[i % 3], "hot" if i % 3 else f"s{i % 4}", len(t)) for i, t in enumerate(texts)]


def odd_rows():
    """Nulls in every column, repeated rows and ids, a very long text."""
    rows = corpus(2, 12)
    return [*rows, rows[0], rows[0], (None, "no id here", None, None, None), (None, None, None, None, None), (900, None, "en", "hot", 0), (3, "another text under id three", "en", None, None), (901, "long words again " * 40_000, "en", "hot", 680_000)]


def frame(spark, rows, extra=()):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return docs.select("*", *[F.lit(c).alias(c) for c in extra])


BENCH = [(1, "w alpha beta"), (2, " ".join(f"w{i}" for i in range(25))), (3, None), (4, ""), (None, "lonely item words")]


def benchmark(spark, rows=BENCH):
    return spark.createDataFrame(rows, "item_id long, text string")


def line_truth(rows, least=10):
    keys = [[x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in (t or "").split("\n")] for _, t, *_ in rows]
    seen = collections.defaultdict(set)
    for (i, *_), ks in zip(rows, keys):
        for k in ks:
            seen[k].add(i)
    out = []
    for (i, t, *_), ks in zip(rows, keys):
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, ks) if not (k and len(seen[k]) >= least)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


def canon(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("rows,least", [(corpus(), 10), (odd_rows(), 3)])
def test_line_dedup(spark, rows, least):
    got = line_dedup.dedup_lines(frame(spark, rows, CLASH), least).collect()
    assert canon(tuple(r) for r in got) == canon(line_truth(rows, least))


def repeat_truth(rows, length):
    bodies = [(t or "").encode() for _, t, *_ in rows]
    seen = collections.Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for (i, *_), b in zip(rows, bodies):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [1, 600, 2 << 20])
def test_suffix_dedup(spark, group):
    rows = [r for r in odd_rows() if len(r[1] or "") < 5000] + corpus(5, 40)
    got = substring_dedup.remove_repeats(frame(spark, rows, CLASH), 40, group).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert canon(tuple(r) for r in got) == canon(repeat_truth(rows, 40))


def later_truth(rows, length):
    """What stays if only windows with an earlier match go; rows in the order of id and of the text's hash."""
    seen, out = set(), []
    for i, _, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        out.append((i, bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.mark.parametrize("group", [1, 600, 2 << 20])
def test_suffix_dedup_keeps_the_first_copy(spark, group):
    rows = [(i, t, l, s, n) for i, t, l, s, n in corpus(5, 60) + [(600, "abc" * 60, None, None, None)]]
    docs = frame(spark, rows, CLASH)
    keyed = [tuple(r) for r in docs.select("doc_id", F.xxhash64("text"), "text").collect()]
    got = substring_dedup.remove_repeats(docs, 40, group, keep_text=True, keep_first=True).collect()
    assert canon((r["doc_id"], bytes(r["kept"])) for r in got) == canon(later_truth(keyed, 40))
    assert sum(r["n_removed"] for r in got) > 1000


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    rng = random.Random(8)
    long = "".join(rng.choice("abcdef ") for _ in range(5000))
    rows = [(1, long, None, None, 0), (2, "x" + long[900:1300] + "y", None, None, 0), (3, long[2000:2050], None, None, 0), (4, "z" * 3000, None, None, 0)]
    texts = pa.array([r[1] for r in rows])
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 512)
    assert max(len(d) for _, d, _, _ in substring_dedup.stretches(texts, 40)) >= 512
    found = collections.Counter()
    for first, data, offsets, base in substring_dedup.stretches(texts, 40):
        doc, start, count, *_ = substring_dedup.segments(data, offsets, 40, 2)
        for d, s, c in zip(doc, start, count):
            found.update((first + int(d), int(s) + base + k) for k in range(c))
    assert found == collections.Counter((i, k) for i, r in enumerate(rows) for k in range(len(r[1]) - 39))
    got = substring_dedup.remove_repeats(frame(spark, rows), 40).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert canon(tuple(r) for r in got) == canon(repeat_truth(rows, 40))


def test_suffix_order_and_factors():
    rng = random.Random(3)
    for _ in range(30):
        text = bytes(rng.choice(b"ab") for _ in range(60))
        length = rng.randint(1, 6)
        windows = [text[i : i + length] for i in range(len(text) - length + 1)]
        order = np.array(sorted(range(len(windows)), key=lambda i: (windows[i], rng.random())))
        same = np.array([k > 0 and windows[order[k]] == windows[order[k - 1]] for k in range(len(order))])
        previous, following = substring_dedup.longest_factors(order, same, length)
        for i, w in enumerate(windows):
            assert previous[i] == length * (w in windows[:i]) and following[i] == length * (w in windows[i + 1 :])
        values = np.array(rng.sample(range(100), 50))
        near = substring_dedup.nearest_smaller(values)
        assert near.tolist() == [max([k for k in range(i) if values[k] < values[i]], default=-1) for i in range(50)]


def test_pieces_are_matched_in_suffix_order():
    rng, length = random.Random(4), 24
    k = substring_dedup.kmer_size(length)
    pieces, anchors = [], []
    for _ in range(60):
        before, after = (bytes(rng.choice(b"ab") for _ in range(rng.randint(12, 18))) for _ in range(2))
        pieces.append(before[-rng.randint(0, 18) :] + b"#" * k + after)
        anchors.append(pieces[-1].index(b"#"))
    ok = [len(p) >= length and a <= length - k and len(p) - a <= length for p, a in zip(pieces, anchors)]
    pieces, anchors = ([x for x, o in zip(xs, ok) if o] for xs in (pieces, anchors))
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
    twice = np.array([rng.random() < 0.2 for _ in pieces])
    piece, window, second, previous, following = substring_dedup.match_pieces(np.zeros(len(pieces), np.int64), twice, np.array(anchors), np.frombuffer(b"".join(pieces), np.uint8), offsets, length)
    text = [pieces[p][w : w + length] for p, w in zip(piece, window)]
    for i, t in enumerate(text):
        assert (previous[i] > 0) == (t in text[:i]) and (following[i] > 0) == (t in text[i + 1 :])
    assert any(previous) and any(second) and not all(previous)


def jaccard_truth(rows, n, percent):
    sets = []
    for _, t, *_ in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("n,percent,limit", [(3, 90, None), (5, 80, None), (3, 90, 0), (2, 60, 12), (3, 80, 30)])
def test_jaccard_join(spark, n, percent, limit):
    rows = [r for r in corpus(7, 90) if len(words(r[1])) < (40 if limit else 1000)]
    got = jaccard_join.jaccard_components(frame(spark, rows, CLASH), n, percent, limit).drop("row_key", "component").collect()
    assert canon(tuple(r) for r in got) == canon(jaccard_truth(rows, n, percent))


def test_jaccard_join_in_many_slices_and_packs(spark, monkeypatch):
    rows = corpus(21, 120)
    monkeypatch.setattr(jaccard_join, "SLICE_BYTES", 700)
    got = jaccard_join.jaccard_components(frame(spark, rows), 3, 80).drop("row_key", "component").collect()
    assert canon(tuple(r) for r in got) == canon(jaccard_truth(rows, 3, 80))


def test_packs_and_stretches(monkeypatch):
    texts = pa.array([t for _, t, *_ in corpus(22, 40)] + ["lo ng " * 4000, None])
    whole = [s.tolist() for s in jaccard_join.shingle_sets(texts, 3)]
    from lectern.llm import text_bytes

    monkeypatch.setattr(text_bytes, "CHUNK_BYTES", 64)
    monkeypatch.setattr(jaccard_join, "STRETCH", 16)
    assert [s.tolist() for s in jaccard_join.shingle_sets(texts, 3)] == whole


def test_boundary_is_chosen_by_cost():
    # lists that cost nothing to scan leave no set light; long lists make sets light as far as subsets cost less
    assert jaccard_join.light_limit({n: (10, 0) for n in range(1, 30)}, 90) == 0
    far = jaccard_join.light_limit({n: (10, 1_000_000) for n in range(1, 30)}, 90)
    near = jaccard_join.light_limit({n: (10, 600) for n in range(1, 30)}, 90)
    assert 0 < near < far <= jaccard_join.most_light(90)


def test_bitmaps_never_rule_out_like_sets():
    rng = np.random.default_rng(5)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        a = np.unique(jaccard_join.mix(rng.integers(0, 1 << 60, size).astype(np.uint64)))
        b = np.unique(np.concatenate([a[: int(len(a) * rng.random())], jaccard_join.mix(rng.integers(0, 1 << 60, int(rng.integers(0, 60))).astype(np.uint64))]))
        if len(b):
            assert jaccard_join.least_difference(jaccard_join.parity_bitmap(a), jaccard_join.parity_bitmap(b)) <= len(np.setxor1d(a, b))


def test_jaccard_join_of_odd_rows(spark):
    rows = odd_rows()
    got = jaccard_join.jaccard_components(frame(spark, rows, CLASH), 3, 90).drop("row_key", "component").collect()
    assert canon(tuple(r) for r in got) == canon(jaccard_truth(rows, 3, 90))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200 + i) for i in range(40)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    link = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            link[a].add(b)
            link[b].add(a)
    for node in link:
        seen, todo = {node}, [node]
        while todo:
            for x in link[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[node] == min(seen)
    assert set(got) == set(link)


def contamination_truth(rows, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wins = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - width, 0) + 1):
            if w:
                wins[tuple(w[k : k + width])].add(i)
    out = []
    for i, t, *_ in rows:
        w, hit, found = split(t), set(), set()
        for win, owners in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= {str(o) for o in owners if o is not None}
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def test_decontamination(spark):
    rows = odd_rows()[:-1] + corpus(8, 10)
    rows += [(500, "x W, alpha-beta y w ALPHA beta", "en", "s", 0), (501, " ".join(f"w{i}" for i in range(3, 22)), "en", "s", 0), (502, " ".join(f"w{i}" for i in range(9)), "en", "s", 0), (503, "a lonely item words b", None, None, None)]
    docs = frame(spark, rows, CLASH)
    found = decontaminate.find_contamination(docs, benchmark(spark))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found.collect()]
    assert canon(got) == canon(contamination_truth(rows, BENCH))
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, found).collect()}
    assert cut[500] == "x y " and cut[503] == "a b" and cut[502] == rows[-2][1]
    assert {500, 501, 503} & {r["doc_id"] for r in decontaminate.remove_documents(docs, found).collect()} == set()


def test_fingerprints(spark):
    rows = corpus(9, 40)
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_documents(frame(spark, rows, CLASH)).collect()}
    ordered = sorted(rows)
    for k, (i, t, *_) in enumerate(ordered):
        after, cut = ordered[(k + 1) % len(ordered)][1], len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        f, e, x = fingerprint.digests(pa.array([t, edited, after]))
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e)
        assert r["near_edited"] == fingerprint.likeness([f], [e])[0] and r["near_next"] == fingerprint.likeness([f], [x])[0]


MASK = (1 << 64) - 1


def mixed(x):
    for _ in range(2):
        x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & MASK
    return x ^ x >> 32


def digest_truth(text):
    """The digest, byte by byte and from its description only."""
    b = text.encode()
    counts = [0] * 256
    for k in range(len(b)):
        for t, places in enumerate(((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))):
            if k + places[-1] < len(b):
                h = 0
                for p, place in enumerate(places):
                    h ^= mixed((((t * 3 + p) * 256 + b[k + place]) * 0x9E3779B97F4A7C15 + 1) & MASK) >> 56
                counts[h] += 1
    cuts = [sorted(counts)[q * 64 - 1] for q in (1, 2, 3)]
    code = [sum(c > x for x in cuts) for c in counts]
    body = bytes(code[i] | code[i + 1] << 2 | code[i + 2] << 4 | code[i + 3] << 6 for i in range(0, 256, 4))
    return (bytes([sum(b) % 251, min(int(math.log1p(len(b)) / math.log(1.3)), 255)]) + body).hex()


def likeness_truth(x, y):
    a, b = bytes.fromhex(x), bytes.fromhex(y)
    far = abs(a[1] - b[1]) + (a[0] != b[0])
    for p, q in zip(a[2:], b[2:]):
        far += sum([0, 1, 2, 6][abs((p >> s & 3) - (q >> s & 3))] for s in (0, 2, 4, 6))
    return 1 - min(far, 416) / 416


def test_digests_by_brute_force():
    texts = [t for _, t, *_ in corpus(31, 25)] + ["", "ab", "abc", "é" * 40, "aaaaaaaaaa" * 30]
    got = fingerprint.digests(pa.array(texts))
    assert got == [digest_truth(t) for t in texts]
    pairs = [(got[i], got[j]) for i in range(len(got)) for j in range(0, i, 3)]
    assert fingerprint.likeness(*map(list, zip(*pairs))).tolist() == pytest.approx([likeness_truth(*p) for p in pairs])


def test_fingerprint_cases(spark):
    out = fingerprint.fingerprint_documents(frame(spark, odd_rows(), CLASH)).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out)
    one = fingerprint.fingerprint_documents(frame(spark, [(7, "only text", None, None, None)])).collect()
    assert one[0]["near_next"] == 1.0
    a, b, c = fingerprint.digests(pa.array(["abc def " * 30, "abc def " * 30, None]))
    assert a == b != c and fingerprint.likeness([a], [b])[0] == 1.0


def test_language_model(spark):
    rows = odd_rows()[:-1] + corpus(11, 50)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    lm_hot, lm_score.HOT_TOKENS = lm_score.HOT_TOKENS, 20
    try:
        got = lm_score.score_documents(frame(spark, rows, CLASH), bucket_of(F.col("doc_id"), 7) == 2).collect()
    finally:
        lm_score.HOT_TOKENS = lm_hot
    counts = collections.Counter(w for i, t, *_ in rows if not held(i) for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = canon((i, held(i), len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for i, t, *_ in rows)
    assert canon((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_scores_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SPARE", 2000)  # so that the filter is never wrong here
    rates, fit = [], lm_score.Model.fit_weights
    monkeypatch.setattr(lm_score.Model, "fit_weights", lambda self, *a: (rates.append(self.false), fit(self, *a))[1])
    rows = corpus(17, 60)
    held = lambda i: i % 5 == 2
    got = {r["doc_id"]: r["score"] for r in lm_score.score_documents(frame(spark, rows), F.col("doc_id") % 5 == 2).collect()}
    texts = {i: [*words(t), "\n"] for i, t, *_ in rows}  # the end is a token of its own
    pairs_of = {i: list(zip(["\n", *ts[:-1]], ts)) for i, ts in texts.items()}
    single = collections.Counter(w for i, ts in texts.items() if not held(i) for w in ts)
    double = collections.Counter(p for i, ps in pairs_of.items() if not held(i) for p in ps)
    n, v = sum(single.values()), len(single)
    level = lambda c, exact=32, base=1.03: c if c < exact else exact + int(math.log(c / exact) / math.log(base) + 1e-9)
    bucket = lambda c: 1 + int(math.log(c) / math.log(1.4) + 1e-9) if c else 0

    def count_of(c, *ladder):
        inside = [x for x in range(5000) if level(x, *ladder) == level(c, *ladder)]
        return (inside[0] + inside[-1]) / 2

    tables = {c: count_of(c) for c in {*single.values(), 0}}
    pair_tables = {c: count_of(c, 8, 1.3) for c in {*double.values(), 0}}

    def roughly(c):  # for fitting
        return c if c < 32 else 32 * 1.4 ** (int((level(c) - 32) * math.log(1.03) / math.log(1.4) + 1e-9) + 0.5)

    def shares(a, b, out):
        value = roughly if out else tables.get
        before, own, both = value(single[a]), value(single[b]), pair_tables[double[a, b]]
        both = min(both, before, own)
        return (max(own - out, 0) + 1) / (n + v + 1), max(both - out, 0) / (max(before - out, 1) + v * sum(rates[0] ** k for k in range(1, int(min(max(before - out, 1), 64)) + 1))), min(bucket(before), 63)

    weights = [0.05] * 64
    told = [shares(a, b, 1) for i, ps in pairs_of.items() if not held(i) for a, b in ps]
    for _ in range(20):
        won, seen = [0.0] * 64, [0] * 64
        for own, share, q in told:
            w = weights[q]
            won[q] += w * share / (w * share + (1 - w) * own)
            seen[q] += 1
        weights = [min((x + 0.05) / (y + 1), 0.95) for x, y in zip(won, seen)]
    weights[0] = 0.0
    for i, ps in pairs_of.items():
        want = sum(math.log10(weights[q] * share + (1 - weights[q]) * own) for own, share, q in (shares(a, b, 0) for a, b in ps))
        assert got[i] == pytest.approx(want, abs=1e-6)


def test_probabilities_after_a_context_add_up(spark, monkeypatch):
    """With the filter as it is used: over all known tokens and an unknown one, after contexts of all levels."""
    rng, names = random.Random(23), [f"w{i}" for i in range(4000)]
    weights = [1 / (i + 3) for i in range(4000)]
    rows = [(i, " ".join(rng.choices(names, weights, k=rng.randint(1, 400))), None, None, None) for i in range(500)]
    kept, fit = [], lm_score.fit
    monkeypatch.setattr(lm_score, "fit", lambda train: kept.append(fit(train)) or (kept[0][0], kept[0][1]))
    bits = []
    made = lm_score.Model.fit_weights
    monkeypatch.setattr(lm_score.Model, "fit_weights", lambda self, *a: (bits.append((self.bits, self.hot)), made(self, *a))[1])
    lm_score.score_documents(frame(spark, rows), F.lit(False)).collect()
    model = kept[0][1]
    model.bits, model.hot = bits[0]
    counts = collections.Counter(w for _, t, *_ in rows for w in t.split())
    vocabulary = sorted(counts, key=lambda w: -counts[w])
    data = " ".join(vocabulary).encode()
    h, _ = lm_score.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))  # with the end
    every = np.append(h, np.uint64(12345))  # an unknown token
    sums = {}
    for k in np.unique(np.geomspace(1, len(vocabulary), 50).astype(int) - 1):
        together = np.stack([np.full(len(every), h[k]), every], 1).ravel()
        told = lm_score.told_levels(together, np.repeat(np.arange(len(every)), 2), model.level_of)[1::2]
        sums[vocabulary[k]] = float((10.0 ** model.log_probabilities(told)).sum())
    assert 0.001 < model.false < 0.1 and min(counts[w] for w in sums) <= 3 and len(sums) > 40
    assert max(abs(x - 1) for x in sums.values()) < 0.02, sums


def test_slices_are_cut_by_what_is_there():
    used, at = lm_score.runs(np.array([3, 3, 7, 1 << 40]))
    assert list(used) == [3, 7, 1 << 40] and list(at) == [0, 2, 3, 4]
    assert [len(x) for x in lm_score.runs(np.zeros(0, np.int64))] == [0, 1]


def test_filter_reads_levels_back():
    h = lm_score.mix(np.arange(1, 2001, dtype=np.uint64))
    c = np.arange(1, 2001) % 300 + 1
    frame = __import__("pandas").DataFrame({"kind": [0], "hashes": [h.tobytes()], "counts": [c.astype(np.uint32).tobytes()]})
    row = lm_score._build_slice(0, 20)((0,), frame).iloc[0]
    model = lm_score.Model(np.frombuffer(row["bits"], np.uint8), 0, 20, row["n"], row["v"], (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    read, true = model.level_of(h, 0), lm_score.levels(c)
    assert (read >= true).all() and (read == true).mean() > 0.9
    assert (model.level_of(lm_score.mix(np.arange(5000, 7000, dtype=np.uint64)), 0) > 0).mean() < 0.1


def test_filter_holds_rare_pairs():
    h = lm_score.mix(np.arange(1, 40_001, dtype=np.uint64))
    frame = __import__("pandas").DataFrame({"kind": [1], "hashes": [h.tobytes()], "counts": [np.ones(len(h), np.uint32).tobytes()]})
    row = lm_score._build_slice(0)((0,), frame).iloc[0]
    bits = np.frombuffer(row["bits"], np.uint8)
    assert len(bits) * 8 >= lm_score.SPARE * len(h) == lm_score.SPARE * row["entries"]
    model = lm_score.Model(bits, 0, len(bits).bit_length() + 2, row["n"], row["v"], (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert (model.level_of(h, 1) >= 1).all()


def test_levels_are_the_same_by_broadcast_and_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SLICE_BYTES", 2000)
    monkeypatch.setattr(lm_score, "HOT_TOKENS", 20)
    docs, found = frame(spark, odd_rows() + corpus(4), CLASH), []
    for most in (lm_score.BROADCAST_BITS, 0):
        monkeypatch.setattr(lm_score, "BROADCAST_BITS", most)
        found.append(sorted([tuple(r) for r in lm_score.score_documents(docs, bucket_of(F.col("doc_id"), 7) == 2).collect()], key=repr))
    assert found[0] == found[1] and len(found[0]) == docs.count()


def test_weights_are_fitted_on_all_training_texts(spark, monkeypatch):
    rows = [(i, "same words here", None, None, None) for i in range(600)] + [(1000 + i, f"t{i} u{i % 7} " * (i % 5 + 1) + "last", None, None, None) for i in range(300)]
    rows += [(2000, "long " * 600_000, None, None, None), (2001, None, None, None, None), (3000, "held out " * 50, None, None, None)]
    seen, fit = [], lm_score.Model.fit_weights
    monkeypatch.setattr(lm_score.Model, "fit_weights", lambda self, told, times, *a: (seen.append(int(times.sum())), fit(self, told, times, *a))[1])
    got = lm_score.score_documents(frame(spark, rows), F.col("doc_id") >= 3000).collect()
    assert seen == [sum(len(words(t)) + 1 for i, t, *_ in rows if i < 3000)] == [got[0]["train_tokens"]]


def test_language_net_learns_and_rejects(spark):
    rng = random.Random(12)
    sounds = {"xx": ["ka", "ri", "to"], "yy": ["schu", "ße", "bö"]}
    rows = [(i, " ".join("".join(rng.choice(sounds[l]) for _ in range(3)) for _ in range(30)), l, "s", 0) for i, l in enumerate(["xx", "yy"] * 60)]
    net = language_id.fit_language_net(frame(spark, rows).select("text", "lang"))
    extra = [(900, None, None, None, None), (901, "12 !!", "xx", None, None), (None, "kari", None, None, None), (902, "schubö " * 5000, None, None, None)]
    got = {r["doc_id"]: r for r in language_id.predict_languages(frame(spark, rows + extra, CLASH), net).collect()}
    assert all(got[i]["lang_pred"] == l for i, _, l, *_ in rows)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0 and got[902]["lang_pred"] == "yy" and got[None]["lang_pred"] == "xx"
    blank = language_id.fit_language_net(frame(spark, []).select("text", "lang"))
    assert language_id.predict_languages(frame(spark, rows[:2]), blank).first()["lang_pred"] == "und"


def test_network_by_brute_force():
    net = language_id.ByteNet(["a", "b", "c"], seed=9)
    rng = np.random.default_rng(2)
    net.bias, net.out_bias = rng.normal(0, 0.2, net.bias.shape).astype(np.float32), rng.normal(0, 0.2, 3).astype(np.float32)
    texts = ["Some Words, 12 of them: éàü", "x" * 700, "short", ("mixed ÿ " * 60)]
    names, scores = net.predict(pa.array(texts))
    for text, name, score in zip(texts, names, scores):
        data = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode())
        total, weight = np.zeros(3), 0.0
        for at in range(0, len(data), 256):
            window = data[at : at + 256].ljust(256, b" ")
            peaks = []
            for table in net.tables:
                sums = [sum(table[k][window[s + k]] for k in range(len(table))) for s in range(256 - len(table) + 1)]
                peaks += list(np.max(sums, axis=0))
            z = np.maximum(np.array(peaks) + net.bias, 0) @ net.out + net.out_bias
            letters = sum(b != 32 for b in window) + 1e-3
            total += letters * (z - np.log(np.exp(z).sum()))
            weight += letters
        p = np.exp(total / weight) / np.exp(total / weight).sum()
        assert name == net.classes[int(p.argmax())] and score == pytest.approx(p.max(), abs=1e-4)


def test_attention_by_brute_force():
    model = quality.AttentionBags(seed=8)
    rng = np.random.default_rng(3)
    model.mean, model.scale = rng.random(quality.FEATURES).astype(np.float32) / 10, rng.random(quality.FEATURES).astype(np.float32) + 0.5
    texts = ["Plain words, plain words.\n" * 60, "$$$ 123", "", "ÄÖÜ äöü " * 100]
    got = model.score(pa.array(texts))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for text, score in zip(texts, got):
        data = text.encode()
        hidden, marks = [], []
        for at in range(0, max(len(data), 1), 512):
            part = data[at : at + 512]
            kinds = [int(quality.CLASS[b]) for b in part]
            ones, twos = collections.Counter(kinds), collections.Counter(zip(kinds, kinds[1:]))
            x = [math.sqrt(ones[k] / max(len(part), 1)) for k in range(quality.CLASSES)] + [math.sqrt(twos[j, k] / max(len(part), 1)) for j in range(quality.CLASSES) for k in range(quality.CLASSES)]
            # words count where they begin
            spans = [m for m in re.finditer(rb"[^\x20\x09-\x0D]+", data.lower() if data.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in data)) if at <= m.start() < at + 512]
            n, distinct, letters = len(spans), len({m[0] for m in spans}), sum(len(m[0]) for m in spans)
            x += [math.log1p(len(part)), distinct / max(n, 1), letters / max(n, 1) / 10, math.log1p(len(data)) / 10]
            h = np.tanh(((np.array(x) - model.mean) / model.scale) @ model.w + model.wb)
            hidden.append(h)
            marks.append(float((np.tanh(h @ model.v) * np.array([sigmoid(u) for u in h @ model.u])) @ model.a))
        share = np.exp(np.array(marks)) / np.exp(np.array(marks)).sum()
        assert score == pytest.approx(sigmoid(float((share @ np.array(hidden)) @ model.c + model.cb[0])), abs=1e-4)


def test_quality_model_learns(spark):
    rng = random.Random(13)
    rows = [(i, " ".join("".join(rng.choice("abcdef") for _ in range(4)) + ("$$$" if i % 4 == 0 else "") for _ in range(120)), "en", "s", 0) for i in range(240)]
    labelled = frame(spark, rows).select("text", (F.col("doc_id") % 4 != 0).cast("int").alias("label"))
    model = quality.fit_quality(labelled)
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(frame(spark, rows + odd_rows()[-6:-1], CLASH), model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 != 0) for i in range(240)) and all(0 <= s <= 1 for s in got.values())
    untrained = quality.fit_quality(frame(spark, []).select("text", F.lit(1).alias("label")))
    assert len(quality.score_quality(frame(spark, rows[:2]), untrained).collect()) == 2


def test_long_texts_are_scored_block_by_block(monkeypatch):
    model = quality.AttentionBags()
    texts = pa.array(["some words of a text " * 300, "short"])
    whole = model.score(texts)
    monkeypatch.setattr("lectern.llm.text_bytes.CHUNK_BYTES", 1000)
    monkeypatch.setattr(quality, "BLOCK", 2 * quality.PASSAGE)
    assert np.allclose(model.score(texts), whole, atol=0.02)


def test_training_pieces_are_spread_over_the_whole_text(spark):
    from lectern.llm.store import spread

    text = "".join(chr(97 + i // 100) for i in range(2600))
    got = spark.createDataFrame([(text,), ("short",), (None,)], "t string").select(spread(F.col("t"), 5, 20)).collect()
    assert got[0][0][:20] == "a" * 20 and got[0][0][-20:] == "z" * 20 and len(got[0][0]) == 100 and len(set(got[0][0])) >= 5
    assert [r[0] for r in got[1:]] == ["short", None]


def test_copies_neither_fill_nor_empty_a_sample(spark):
    from lectern.llm.store import hash_sample

    rows = [(i % 3,) for i in range(9000)] + [(100 + i,) for i in range(500)]
    docs = spark.createDataFrame(rows, "n long").withColumn("by", F.xxhash64("n"))
    got = [r["n"] for r in hash_sample(docs, "by", 200).collect()]
    assert len(got) == len(set(got)) == 200
    assert got == [r["n"] for r in hash_sample(docs.repartition(5), "by", 200).collect()]
    few = hash_sample(docs.where("n < 3"), "by", 2)
    assert few.count() == 2 and hash_sample(docs.where("n < 0"), "by", 5).count() == 0


def test_probing_ends_in_a_full_filter():
    full = np.full(128, 255, np.uint8)
    h = lm_score.mix(np.arange(1, 50, dtype=np.uint64))
    assert (lm_score.read_levels(full, h, 0, 0, 10, 0) == lm_score.TOP_LEVEL).all() and lm_score.TOP_LEVEL < 1 << 16


def test_attention_gradient():
    rng = np.random.default_rng(0)
    model = quality.AttentionBags()
    bags, y = [rng.normal(size=(k, quality.FEATURES)).astype(np.float32) for k in (1, 3, 2)], np.array([1.0, 0.0, 1.0])
    doc = np.repeat(np.arange(3), [1, 3, 2])

    def loss():
        p = model.forward(np.concatenate(bags), doc, 3)[0]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    before = loss()
    for _ in range(5):
        model.train(bags, y, epochs=4, rate=0.01)
    assert loss() < before


@pytest.mark.parametrize("cells", [200_000, 0])
def test_mixing(spark, cells):
    rows = odd_rows()[:-1] + corpus(14, 60)
    got = mixing.mixing_probabilities(frame(spark, rows, CLASH), driver_cells=cells).collect()
    assert len(got) == len(rows) and all((r["probability"] > 0) == (r["n_tokens"] > 0) and r["probability"] <= 1 + 1e-9 for r in got)
    other = mixing.mixing_probabilities(frame(spark, rows), driver_cells=200_000).collect()
    assert canon((r["doc_id"], r["sampled"], round(r["probability"], 6)) for r in got) == canon((r["doc_id"], r["sampled"], round(r["probability"], 6)) for r in other)


def test_raking_meets_targets():
    rng = np.random.default_rng(1)
    codes, w = [np.repeat(np.arange(4), 6), np.tile(np.arange(6), 4)], rng.random(24) + 0.1
    targets = [np.bincount(c, w) ** 0.5 for c in codes]
    targets = [t / t.sum() * w.sum() for t in targets]
    out, residual = mixing.rake(w, codes, targets, 60)
    assert residual < mixing.TOLERANCE and all(np.allclose(np.bincount(c, out), t, rtol=1e-9) for c, t in zip(codes, targets))
    few = mixing.rake(w, codes, targets, 1)[1]
    assert few > 0.01


def test_targets_of_values():
    sums = {"a": 60.0, "b": 30.0, None: 10.0}
    assert mixing.target_sums(sums, {"a": 0.2, "absent": 0.5}, 1.0) == pytest.approx({"a": 20.0, "b": 60.0, None: 20.0})
    assert mixing.target_sums(sums, {"a": 1.0, "b": 2.0, None: 1.0}, 1.0) == pytest.approx({"a": 25.0, "b": 50.0, None: 25.0})
    assert mixing.target_sums(sums, None, 1.0) == pytest.approx(sums) and mixing.target_sums({}, {"a": 1}, 1.0) == {}


@pytest.mark.parametrize("cells", [200_000, 0])
def test_mix_meets_explicit_targets(spark, cells):
    rows = [(i, "word " * (i % 50 + 1), ["en", "fr", None][i % 3], f"s{i % 4}", 0) for i in range(600)]
    out = mixing.mixing_probabilities(frame(spark, rows, CLASH), targets={"lang": {"en": 0.2, "fr": 0.7}, "source": {"s1": 0.4}}, rounds=40, driver_cells=cells, keep=("lang", "source")).collect()
    total = sum(r["n_tokens"] * r["probability"] for r in out)
    share = lambda name, v: sum(r["n_tokens"] * r["probability"] for r in out if r[f"lectern_{name}"] == v) / total
    assert share("lang", "en") == pytest.approx(0.2) and share("lang", "fr") == pytest.approx(0.7) and share("source", "s1") == pytest.approx(0.4)
    assert out[0]["residual"] < 1e-9 and max(r["probability"] for r in out) == pytest.approx(1.0)


CALL = '{"tool_calls":[{"id":"%s","name":"%s","arguments":%s,"after":%s}]}'


def test_chat_links_orders_and_checks(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", CALL % ("b", "add", '{"y":2,"x":"1"}', '["a"]')), (1, 2, "assistant", CALL % ("a", "add", '{"x":1,"y":2}', "[]")),
        (1, 3, "tool", '{"tool_call_id":"a","content":{"z":1,"b":[1,2]}}'), (1, 4, "tool", '{"tool_call_id":"b","content":"ok"}'), (1, 5, "tool", '{"tool_call_id":"zz","content":1}'),
        (1, 6, "assistant", CALL % ("c", "free", "{}", '["d"]')), (1, 7, "assistant", CALL % ("d", "free", "{}", '["c"]')), (1, 8, "assistant", CALL % ("a", "add", '{"x":1,"y":1}', "[]")),
        (2, 0, "assistant", CALL % ("a", "free", "{}", '["nope"]')), (2, 1, "assistant", "{not json"), (None, None, None, None), (2, 2, "user", '{"tool_call_id":"a"}'),
    ]
    schemas = spark.createDataFrame([("add", "x", "integer", True), ("add", "y", "number", True)], "name string, param string, type string, required boolean")
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("status", F.lit("x")), schemas).collect()
    by = {(r["conv_id"], r["turn"]): r for r in out}
    assert len(out) == len(rows)
    told = {k: (r["kind"], r["status"], r["linked_turn"], r["ready_turn"], r["depth"]) for k, r in by.items()}
    assert told[1, 2] == ("call", "ok", 3, 2, 0) and told[1, 1] == ("call", "invalid", 4, 3, 1)
    assert told[1, 3] == ("result", "ok", 2, 3, 1) and told[1, 4] == ("result", "ok", 1, 4, 2) and told[1, 5][:2] == ("result", "orphan")
    assert told[1, 6][1] == told[1, 7][1] == "cycle" and told[1, 8][1] == "repeated" and told[2, 0][1] == "missing"
    assert told[2, 1][0] == told[2, 2][0] == told[1, 0][0] == told[None, None][0] == "message"
    assert by[1, 3]["line"] == '{"content":{"b":[1,2],"z":1},"conv_id":1,"id":"a","kind":"result","role":"tool","turn":3}'
    assert by[1, 0]["line"] == '{"content":"hi","conv_id":1,"role":"user","turn":0}'


def test_chat_keeps_fields_beside_calls_and_results(spark):
    rows = [
        (1, 0, "assistant", '{"content":"let me look","model":"m","none":null,"tool_calls":[{"id":"a","name":"f","arguments":{"y":1,"x":null},"after":["q"],"type":"function"},{"id":"q","name":"g"}]}'),
        (1, 1, "tool", '{"tool_call_id":"a","content":"ok","seconds":2}'), (1, 2, "tool", '{"tool_call_id":"q","content":null}'),
    ]
    out = {(r["turn"], r["idx"]): r["line"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out == {
        (0, -1): '{"content":"let me look","conv_id":1,"fields":{"model":"m","none":null},"role":"assistant","turn":0}',
        (0, 0): '{"after":["q"],"arguments":{"x":null,"y":1},"conv_id":1,"fields":{"type":"function"},"id":"a","kind":"call","name":"f","role":"assistant","turn":0}',
        (0, 1): '{"conv_id":1,"id":"q","kind":"call","name":"g","role":"assistant","turn":0}',
        (1, -1): '{"conv_id":1,"fields":{"seconds":2},"role":"tool","turn":1}',
        (1, 0): '{"content":"ok","conv_id":1,"id":"a","kind":"result","role":"tool","turn":1}',
        (2, 0): '{"content":null,"conv_id":1,"id":"q","kind":"result","role":"tool","turn":2}',
    }


def test_chat_lines_of_nulls_and_numbers(spark):
    rows = [(None, None, None, None), (1, 0, "assistant", '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":1,"y":1.0,"z":null}}]}')]
    out = {r["kind"]: r["line"] for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert out["message"] == "{}"
    assert out["call"] == '{"arguments":{"x":1,"y":1,"z":null},"conv_id":1,"id":"a","kind":"call","name":"f","role":"assistant","turn":0}'


def test_tool_log_of_plain_conversations(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(60)] + [(2, 0, "system", "rules"), (2, 1, "user", "unanswered"), (3, None, "user", None), (3, 0, None, "x"), (4, 5, "assistant", "no call before")]
    log = chat.as_tool_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    schemas = spark.createDataFrame([("reply", "prompt", "string", True), ("reply", "chars", "integer", True)], "name string, param string, type string, required boolean")
    out = chat.format_chats(log, schemas).collect()
    assert len(out) == len(rows) and {r["kind"] for r in out} == {"call", "result", "message"}
    calls = {r["call_id"]: r for r in out if r["conv_id"] == 1 and r["kind"] == "call" and r["status"] != "repeated"}
    for r in calls.values():
        for need in [n for n in __import__("json").loads(r["line"])["after"] if n in calls and r["status"] in ("ok", "unanswered", "invalid", "missing") and calls[n]["status"] != "cycle"]:
            assert r["depth"] > calls[need]["depth"] or r["depth"] == 0
    assert {r["status"] for r in out if r["conv_id"] == 4} == {"orphan"} and {r["status"] for r in out if r["conv_id"] == 3 and r["kind"] == "call"} == {"invalid"}


EMPTY = {
    "fingerprint": lambda s, d: fingerprint.fingerprint_documents(d),
    "lines": lambda s, d: line_dedup.dedup_lines(d),
    "lm": lambda s, d: lm_score.score_documents(d, F.lit(False)),
    "suffix": lambda s, d: substring_dedup.remove_repeats(d),
    "decontaminate": lambda s, d: decontaminate.find_contamination(d, benchmark(s)),
    "jaccard": lambda s, d: jaccard_join.jaccard_components(d),
    "mixing": lambda s, d: mixing.mixing_probabilities(d),
    "quality": lambda s, d: quality.score_quality(d, quality.AttentionBags()),
    "language": lambda s, d: language_id.predict_languages(d, language_id.ByteNet(["en"])),
    "first copies": lambda s, d: substring_dedup.remove_repeats(d, keep_first=True),
    "chat": lambda s, d: chat.format_chats(d.select(F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("lang").alias("role"), "text")),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(spark, name):
    assert EMPTY[name](spark, frame(spark, [])).count() == 0


def test_no_benchmark(spark):
    found = decontaminate.find_contamination(frame(spark, corpus(1, 5)), benchmark(spark, []))
    assert found.where("n_hit > 0").count() == 0 and found.count() == 14


# --- the pipeline ---


@pytest.fixture(scope="module")
def stage_input(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    benchmark(spark).write.parquet(str(d / "benchmark.parquet"))
    rng = random.Random(15)
    sounds = ["ka", "ri", "to", "mi", "ne"]
    plain = [(1000 + i, " ".join("".join(rng.choice(sounds) for _ in range(3)) for _ in range(60)), "en", "s1", 0) for i in range(40)]
    frame(spark, odd_rows() + plain, ("row_key", "n", "probability")).write.parquet(str(d / "documents.parquet"))
    return str(d)


def kept_truth(spark, rows):
    """(doc_id, text) of the near-duplicate stage: of each group the row of least id (none counts as most) and hash of the text."""
    rows = sorted({(r[0], r[1]) for r in rows}, key=repr)
    hashed = {tuple(r)[0]: tuple(r)[1] for r in spark.createDataFrame(list({(t,) for _, t in rows}), "text string").select("text", F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]]))
    stay, groups = [], set()
    named = [(k, t, None, None, 0) for k, (_, t) in enumerate(rows)]
    for (i, t), (_, n, group) in zip(rows, jaccard_truth(named, 5, 80)):
        if not n or group not in groups:
            stay.append((i, t))
        groups.add(group)
    return stay


def test_near_duplicates_that_share_or_lack_an_id(spark, stage_input):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(5, text), (5, text + " end"), (5, "quite another text here indeed now"), (None, text + " and"), (None, "x y z " * 9), (None, "x y z " * 9 + "x"), (7, text), (5, text), (8, None), (None, None), (9, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, stage_input).collect()
    assert canon((r["doc_id"], r["text"]) for r in got) == canon(kept_truth(spark, [tuple(r) for r in docs.collect()]))
    assert len(got) == 6


def test_stages_one_by_one(spark, stage_input):
    docs = spark.read.parquet(f"{stage_input}/documents.parquet")
    rows = [tuple(r)[:5] for r in docs.collect()]
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, docs, stage_input)
    assert told.columns == columns and {r["doc_id"] for r in told.collect()} >= set(range(1000, 1040))
    assert told.where("text is null").count() == 0 and told.where("doc_id = 900").count() == 0
    lines = stages["line_dedup"](spark, docs, stage_input)
    assert lines.columns == columns and canon((r["doc_id"], r["text"]) for r in lines.collect()) == canon((x[0], x[3]) for x in line_truth(rows))
    near = stages["near_duplicates"](spark, docs, stage_input)
    assert near.columns == columns and canon((r["doc_id"], r["text"]) for r in near.collect()) == canon(kept_truth(spark, rows))
    clean = stages["decontamination"](spark, docs, stage_input)
    hit = {x[0] for x in contamination_truth(rows, BENCH) if x[2]}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - hit
    mixed = stages["mixing"](spark, docs, stage_input)
    assert mixed.columns == [*columns, "mix_tokens", "mix_probability"] and mixed.count() > 0


def test_pipeline_runs(spark, stage_input):
    out = corpus_pipeline.run(spark, stage_input)
    assert out.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "mixing"]


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_no_documents(spark, stage_input, stage):
    assert dict(corpus_pipeline.STAGES)[stage](spark, frame(spark, []), stage_input).count() == 0
