"""Quality classifier: attention-based multiple-instance learning, in numpy.

A document is a bag of passages of fixed length.  Each passage is encoded (frequencies of byte classes and
of pairs of them, word length, share of distinct words), mapped to a hidden vector, and weighted by gated
attention; the weighted vector gives the score.  Only documents have labels: encoder, attention and
score are learned from them together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import hash_sample, prepare, spread
from lectern.llm.text_bytes import GOLDEN, LOWER, Rolling, chunks, mix, words

PASSAGE = 512
HIDDEN, GATE = 24, 12
#: Passages of a document in training at most, spread over all of it; scoring reads all.
TRAIN_PASSAGES = 16
#: Bytes of a long text that are encoded at a time, in whole passages.
BLOCK = 512 * PASSAGE

_marks = b"\n \t.,;:!?'\"()|-_#*$%&@/\\<>{}[]=+~^`"
CLASS = np.full(256, 4, np.int64)  # other controls
CLASS[97:123], CLASS[65:91], CLASS[48:58], CLASS[128:] = 0, 1, 2, 3
for _i, _b in enumerate(_marks):
    CLASS[_b] = 5 + _i
CLASSES = 5 + len(_marks)
EXTRA = 4
FEATURES = CLASSES + CLASSES * CLASSES + EXTRA


def passages(data: np.ndarray, offsets: np.ndarray, told: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the text of each; an empty text has one empty passage.  ``told`` has the bytes of the
    texts where only pieces of them are given."""
    size = np.diff(offsets)
    told = size if told is None else told
    count = np.maximum(-(-size // PASSAGE), 1)
    start = np.concatenate(([0], np.cumsum(count)))
    n = int(start[-1])
    doc = np.repeat(np.arange(len(size)), count)
    own = np.repeat(start[:-1], size) + (np.arange(len(data)) - np.repeat(offsets[:-1], size)) // PASSAGE
    kind = CLASS[data]
    length = np.bincount(own, minlength=n).astype(np.float64)
    ones = np.bincount(own * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    same = own[1:] == own[:-1] if len(own) else np.zeros(0, bool)
    twos = np.bincount(((own[:-1] * CLASSES + kind[:-1]) * CLASSES + kind[1:])[same] if len(own) else np.zeros(0, np.int64), minlength=n * CLASSES * CLASSES).reshape(n, -1)
    low = LOWER[data]
    starts, ends, _ = words(low, offsets)
    place = own[starts] if len(starts) else np.zeros(0, np.int64)
    hashes = mix(Rolling(low).spans(starts, ends) + place.astype(np.uint64) * GOLDEN) if len(starts) else np.zeros(0, np.uint64)
    n_words = np.bincount(place, minlength=n)
    _, at = np.unique(hashes, return_index=True)
    distinct = np.bincount(place[at], minlength=n)
    letters = np.bincount(place, (ends - starts).astype(np.float64), minlength=n)
    some = np.maximum(length, 1)[:, None]
    extra = np.stack([np.log1p(length), distinct / np.maximum(n_words, 1), letters / np.maximum(n_words, 1) / 10, np.log1p(np.repeat(told, count)) / 10], axis=1)
    return np.concatenate([np.sqrt(ones / some), np.sqrt(twos / some), extra], axis=1).astype(np.float32), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionBags:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.w, self.wb = rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN)
        self.v, self.u = rng.normal(0, 0.3, (HIDDEN, GATE)), rng.normal(0, 0.3, (HIDDEN, GATE))
        self.a = rng.normal(0, 0.3, GATE)
        self.c, self.cb = rng.normal(0, 0.3, HIDDEN), np.zeros(1)

    def params(self):
        return [self.w, self.wb, self.v, self.u, self.a, self.c, self.cb]

    def forward(self, x: np.ndarray, doc: np.ndarray, rows: int):
        """Scores of the bags whose passages are ``x``, sorted by ``doc``; each bag has one at least."""
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ self.w + self.wb)
        t, s = np.tanh(h @ self.v), _sigmoid(h @ self.u)
        e = (t * s) @ self.a
        start = np.searchsorted(doc, np.arange(rows))
        e = np.exp(e - np.maximum.reduceat(e, start)[doc])
        weight = e / np.add.reduceat(e, start)[doc]
        z = np.add.reduceat(weight[:, None] * h, start, axis=0)
        return _sigmoid(z @ self.c + self.cb[0]), (x, h, t, s, weight, z, start)

    def train(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 0.004, decay: float = 2e-4, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        count = sum(map(len, bags))  # bag by bag, as a copy of all passages would be large
        self.mean = (sum(b.sum(axis=0, dtype=np.float64) for b in bags) / count).astype(np.float32)
        self.scale = np.sqrt(sum(np.square(b - self.mean).sum(axis=0, dtype=np.float64) for b in bags) / count).astype(np.float32) + np.float32(0.02)
        params = self.params()
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for i in range(0, len(bags), batch):
                rows = order[i : i + batch]
                doc = np.repeat(np.arange(len(rows)), [len(bags[r]) for r in rows])
                p, (x, h, t, s, weight, z, start) = self.forward(np.concatenate([bags[r] for r in rows]), doc, len(rows))
                d = (p - y[rows]) / len(rows)
                dz = d[:, None] * self.c
                dw = (dz[doc] * h).sum(axis=1)
                de = weight * (dw - np.add.reduceat(weight * dw, start)[doc])
                dt, ds = de[:, None] * self.a * s * (1 - t * t), de[:, None] * self.a * t * s * (1 - s)
                dh = weight[:, None] * dz[doc] + dt @ self.v.T + ds @ self.u.T
                dx = dh * (1 - h * h)
                grads = [x.T @ dx, dx.sum(axis=0), h.T @ dt, h.T @ ds, ((t * s) * de[:, None]).sum(axis=0), z.T @ d, d.sum(keepdims=True)]
                step += 1
                for v, g, m, q in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    q += 0.001 * (g * g - q)
                    v -= rate * ((m / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8) + decay * v)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = []
        for _, _, data, offsets in chunks(texts):
            if len(offsets) > 2 or len(data) <= BLOCK:
                x, doc = passages(data, offsets)
                out.append(self.forward(x, doc, len(offsets) - 1)[0])
            else:
                out.append(self.score_long(data))
        return np.concatenate(out) if out else np.zeros(0)

    def score_long(self, data: np.ndarray) -> np.ndarray:
        """The score of one text, whose passages are encoded block by block; only hidden vectors and attention are kept."""
        size, hidden, marks = np.array([len(data)]), [], []
        for b in range(0, len(data), BLOCK):
            some = data[b : b + BLOCK]
            x, doc = passages(some, np.array([0, len(some)]), size)
            _, (_, h, t, s, _, _, _) = self.forward(x, doc, 1)
            hidden.append(h)
            marks.append((t * s) @ self.a)
        h, e = np.concatenate(hidden), np.concatenate(marks)
        e = np.exp(e - e.max())
        return _sigmoid(((e / e.sum()) @ h)[None, :] @ self.c + self.cb[0])


def fit_quality(labelled: DataFrame, sample_rows: int = 4000) -> AttentionBags:
    """The classifier for ``labelled`` (text, label 0 or 1), learned from a bounded sample: ``sample_rows`` rows, those of
    smallest hash, and TRAIN_PASSAGES passages of each at most, spread evenly from the first to the last byte.

    Null labels are left out; a null text is empty; of equal texts with one label one is drawn, and a text that has
    both labels may be drawn with each.  Without rows the classifier is untrained.
    """
    text = F.coalesce("text", F.lit(""))
    known = labelled.where("label is not null").select(
        F.xxhash64(text, "label").alias("by"), F.col("label").cast("double").alias("label"), spread(text, TRAIN_PASSAGES, PASSAGE).alias("text"), F.octet_length(text).cast("long").alias("size")
    )
    rows = hash_sample(known, "by", sample_rows).toArrow()
    model = AttentionBags()
    bags: list[np.ndarray] = []
    size = rows.column("size").to_numpy()
    for first, last, data, offsets in chunks(rows.column("text")):
        x, doc = passages(data, offsets, size[first:last])
        cut = np.searchsorted(doc, np.arange(last - first + 1))
        for b, e in zip(cut[:-1], cut[1:], strict=True):
            bags.append(x[b:e] if e - b <= TRAIN_PASSAGES else x[np.linspace(b, e - 1, TRAIN_PASSAGES).astype(int)])
    if bags:
        model.train(bags, rows.column("label").to_numpy())
    return model


def score_quality(docs: DataFrame, model: AttentionBags) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id and score, the probability of label 1.  Null and empty
    texts are one empty passage; repeated rows are scored alike; texts of any length are scored whole, block by
    block.  An empty table gives no rows."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
