"""Fill-in-the-middle, packing and spelling variants against brute force, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import fill_middle, packing, queries, spelling, tokens
from tests.llm.test_llm_operators import CLASH, SCHEMA, corpus, odd_rows

PATH = public_tokenizers.path(queries.PACK_TOKENIZER)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("odd"))
    rows = [*odd_rows(), (950, "<P> marked", "en", "s", 1), (951, "blank at the end \n", "en", "s", 1), (952, " \t ", "en", "s", 1), (953, "naïve NAÏVE Straße don't DON'T 12ab34 ***x*** a≠b é H̱   x y '́s", "fr", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{place}-none/documents.parquet")
    return place, rows


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fim(doc_id, text):
    text = text or ""
    found = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    key = digest(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(key[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(found) + 1), h2 % (len(found) + 1)))
    prefix, middle, suffix = "".join(found[:a]), "".join(found[a:b]), "".join(found[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(found), "plain", None, None, digest(text), digest(text)
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 % 100 < 80 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(found), "spm" if h4 % 100 < 80 else "psm", len(prefix), len(middle), digest(out), digest(text)


def test_fill_middle_by_brute_force(spark, odd):
    got = sorted(map(tuple, queries.op11_fill_middle(spark, odd[0]).collect()), key=repr)
    assert got == sorted((fim(r[0], r[1]) for r in odd[1]), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert queries.op11_fill_middle(spark, f"{odd[0]}-none").count() == 0


def test_fill_middle_at_every_cut():
    text = "ein  paar\tWörter, ça va 😀 \n".encode()
    data, offsets = np.frombuffer(text * 3, np.uint8), np.arange(4) * len(text)
    found = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text.decode())
    for a in range(len(found) + 1):
        for b in range(len(found) + 1):
            n, form, prefix, middle, new, at = fill_middle.rewrite(data, offsets, *(np.full(3, x) for x in (a, b)), np.array([True, True, False]), np.array([True, False, True]))
            lo, hi = min(a, b), max(a, b)
            p, m, s = "".join(found[:lo]), "".join(found[lo:hi]), "".join(found[hi:])
            assert [new[at[i] : at[i + 1]].tobytes().decode() for i in range(3)] == [f"<S>{s}<P>{p}<M>{m}", f"<P>{p}<S>{s}<M>{m}", text.decode()]
            assert list(form) == [2, 1, 0] and set(n) == {len(found)} and set(prefix) == {len(p)} and set(middle) == {len(m)}


def test_ids_are_those_of_the_plain_call():
    plain, own, rng = Tokenizer.from_file(PATH), tokens.Encoder(PATH), random.Random(5)
    signs = ["a", "B", "é", "ß", "İ", "H̱", "J̌", "́", "̸", "=", "<", ">", "|", "'", "s", "'S", "'ll", "9", "٣", "½", ".", ",", "-", "#", "_", " ", "\n", " ", " ", "\x0b", "日", "😀", "Σ", "the", "ing", "\x00", "<|endoftext|>", "<|ENDOFTEXT|>"]
    for k in range(300):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 6))]
        blobs = [t.encode() for t in texts]
        ids, n = own.encode(np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *map(len, blobs)]))
        want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert list(n) == list(map(len, want)) and list(ids) == [i for w in want for i in w], texts


def whole_packing(rows, docs, capacity):
    """Checks pieces and places; returns the number of sequences."""
    plain = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for doc_id, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        for piece in range(-(-len(ids) // capacity)):
            some = np.array(ids[piece * capacity : (piece + 1) * capacity], "<u4")
            want[doc_id, piece, piece * capacity, len(some), zlib.crc32(some.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    inside = collections.defaultdict(list)
    for r in rows:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in inside.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(inside)


def test_packing_by_brute_force(spark, odd):
    docs = [(r[0], r[1]) for r in odd[1]]
    n = whole_packing(queries.op12_packing(spark, odd[0]).collect(), docs, 4096)
    total = sum(len(Tokenizer.from_file(PATH).encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    assert n == -(-total // 4096)
    assert queries.op12_packing(spark, f"{odd[0]}-none").count() == 0


def test_sequences_hold_their_documents(spark):
    rows = corpus(4, 40)
    packed = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), PATH, capacity=64)
    whole_packing(packed.withColumn("ids_crc32", F.crc32("ids")).collect(), [(r[0], r[1]) for r in rows], 64)
    made = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert made[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tobytes() == bytes(r["ids"])


def plain_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_and_children_keep_all_pieces(seed):
    rng, capacity = random.Random(seed), 100
    demand = np.zeros(capacity + 1, np.int64)
    for _ in range(rng.choice([3, 60, 400])):
        demand[rng.randint(20, 60) if seed % 2 else rng.randint(1, 100)] += rng.choice([1, 1, 7])
    lengths = [i for i in range(capacity + 1) for _ in range(demand[i])]
    first = packing.best_fit({}, packing._falling(demand), capacity)
    assert packing.bins(first) == plain_best_fit(lengths, capacity)
    held = packing._settle(0, demand, capacity, 1)
    for k in range(30):
        own, other = rng.choice(held), rng.choice(held)
        for child in (packing.cross(own, other, rng, capacity), packing.shaken(own, rng, capacity)):
            assert (packing.contents(child, capacity) == demand).all() and all(packing.fill(p) <= capacity for p in child)
            held.append(child)


def test_islands_better_best_fit(spark):
    """Triplets that fill a sequence exactly, which best fit of falling lengths does not find."""
    rng, capacity, groups = random.Random(3), 1000, 20
    demand = np.zeros(capacity + 1, np.int64)
    for _ in range(groups):
        a = rng.randint(380, 490)
        b = rng.randint(250, (capacity - a) // 2 + 40)
        for x in (a, b, capacity - a - b):
            demand[x] += 1
    first = packing.bins(packing.best_fit({}, packing._falling(demand), capacity))
    won = packing.evolve(spark, demand, capacity, islands=4, rounds=4)
    assert (packing.contents(won, capacity) == demand).all()
    assert groups <= packing.bins(won) < first


def spelled(rows, erase=199, least_chars=6, least=5, factor=5):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % erase == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= least}
    letters = sorted({c for w in n for c in w})
    near = {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near[w] = {e for e in edits if e in n and e != w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= factor * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n), key=repr)


def misspelt(seed, n=400):
    rng, letters = random.Random(seed), "abcé"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "ababab", "y" * 60, "y" * 61, "y" * 60 + "z"]
    out = []
    for i in range(n):
        some = []
        for _ in range(rng.randint(0, 60)):
            w = stems[min(int(rng.expovariate(0.08)), len(stems) - 1)]
            while rng.random() < 0.5:
                k = rng.randint(0, len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:]])
            some.append(w.capitalize() if rng.random() < 0.2 else w)
        out.append((i % (n - 3), " ".join(some) if some else None))
    return [*out, (None, "aaaaaa aaaaab " * 20), (None, None), (7, "ÉÉÉÉÉÉ éééééé ×÷×÷×÷ " * 9), (7, "aaaaaa aaaaab " * 300), (8, "pqrstu " * 6 + "pqrstv " * 40 + "pqrswv " * 300), out[5], out[5]]


@pytest.mark.parametrize("hot", [1000, 12, 0])
def test_spelling_by_brute_force(spark, hot):
    rows = misspelt(hot)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = sorted(map(tuple, spelling.spelling_variants(docs, hot=hot).collect()), key=repr)
    want = spelled(rows)
    assert got == want and any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 5 for r in want)


def test_spelling_of_odd_rows(spark, odd):
    got = sorted(map(tuple, queries.op13_spelling(spark, odd[0]).collect()), key=repr)
    assert got == spelled([(r[0], r[1]) for r in odd[1]])
    assert queries.op13_spelling(spark, f"{odd[0]}-none").count() == 0


def tool_log(conversations):
    """Messages of calls and results: conversations of (calls as (id, after), answered ids)."""
    import json

    rows = []
    for conv, (calls, answered) in enumerate(conversations):
        for turn, (call, after) in enumerate(calls):
            rows.append((conv, 2 * turn, "assistant", json.dumps({"tool_calls": [{"id": call, "name": "f", "arguments": {}, "after": after}]})))
            if call in answered:
                rows.append((conv, 2 * turn + 1, "tool", json.dumps({"tool_call_id": call, "content": "x"})))
    return rows


def test_order_by_fold_and_by_levels(spark, monkeypatch):
    from lectern.llm import chat

    rng, conversations = random.Random(6), []
    for _ in range(40):
        names = [f"c{i}" for i in range(rng.randint(1, 12))]
        calls = [(n, rng.sample(names, min(len(names), rng.choice([0, 0, 1, 1, 2]))) + (["none"] if rng.random() < 0.1 else [])) for n in names]
        conversations.append((calls, set(rng.sample(names, rng.randint(0, len(names))))))
    messages = spark.createDataFrame(tool_log(conversations), "conv_id long, turn int, role string, text string")
    found = []
    for most in (1000, 6, 0):
        monkeypatch.setattr(chat, "FOLD_CALLS", most)
        found.append(sorted(map(tuple, chat.format_chats(messages).collect()), key=repr))
    assert found[0] == found[1] == found[2] and {"cycle", "ok", "missing"} <= {r[9] for r in found[0]} and max(r[8] for r in found[0]) > 3


def test_a_chain_of_a_thousand_calls(spark):
    import time

    from lectern.llm import chat

    names = [f"c{i}" for i in range(1000)]
    random.Random(3).shuffle(names)
    calls = [(n, [f"c{int(n[1:]) - 1}"] if n != "c0" else []) for n in names]
    messages = spark.createDataFrame(tool_log([(calls, set(names))]), "conv_id long, turn int, role string, text string")
    began = time.time()
    depth = {r["call_id"]: r["depth"] for r in chat.format_chats(messages).where("kind = 'call'").collect()}
    assert depth == {f"c{i}": i for i in range(1000)} and time.time() - began < 60
