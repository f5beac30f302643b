"""Language identification with a byte convolutional network, trained in numpy.

Windows of fixed length go through filters of several widths over one-hot bytes, the maximum of each over
the window, and a softmax.  As inputs are one-hot, a filter is a table with a row for each of its places
and byte values, and only the place of the maximum gets a gradient.  A text is the mean of all its
windows, weighted by the letters in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import hash_sample, prepare, spread
from lectern.llm.text_bytes import chunks

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Windows of a text in training at most, spread over all of it; prediction reads all.
TRAIN_WINDOWS = 16
#: Windows that go through the network at a time.
BLOCK = 64
UNKNOWN = "und"

#: Lower-cases A-Z; all ASCII that is no letter is a space; pads are spaces.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded windows of all texts (one at least for each) and the text of each."""
    size = np.diff(offsets)
    count = np.maximum(-(-size // WINDOW), 1)
    start = np.concatenate(([0], np.cumsum(count)))
    out = np.full(start[-1] * WINDOW, 32, np.uint8)
    shift = np.repeat(start[:-1] * WINDOW - offsets[:-1], size)
    out[np.arange(len(data)) + shift] = FOLD[data]
    return out.reshape(-1, WINDOW), np.repeat(np.arange(len(size)), count)


class ByteNet:
    def __init__(self, classes: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), max(len(classes), 1))).astype(np.float32)
        self.out_bias = np.zeros(max(len(classes), 1), np.float32)

    def pooled(self, x: np.ndarray, places: bool = False):
        best, where = [], []
        for table in self.tables:
            n = WINDOW - len(table) + 1
            z = table[0].take(x[:, :n], axis=0)
            for k in range(1, len(table)):
                z += table[k].take(x[:, k : k + n], axis=0)
            if places:
                where.append(z.argmax(axis=1))
            best.append(z.max(axis=1))
        return np.concatenate(best, axis=1), where

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [np.maximum(self.pooled(x[i : i + BLOCK])[0] + self.bias, 0) @ self.out + self.out_bias for i in range(0, len(x), BLOCK)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.out_bias)), np.float32)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 6) -> None:
        rng = np.random.default_rng(seed)
        params = [*self.tables, self.bias, self.out, self.out_bias]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BLOCK):
                rows = order[i : i + BLOCK]
                own = x[rows]
                raw, where = self.pooled(own, True)
                hidden = np.maximum(raw + self.bias, 0)
                z = hidden @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p /= len(rows)
                back = (p @ self.out.T) * (hidden > 0)
                grads = []
                for k, (table, at) in enumerate(zip(self.tables, where, strict=True)):
                    g = np.zeros_like(table)
                    part = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(len(table)):
                        np.add.at(g[j], (own[np.arange(len(rows))[:, None], at + j], np.arange(FILTERS)[None, :]), part)
                    grads.append(g)
                grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
                t += 1
                for v, g, m, s in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for _, _, data, offsets in chunks(texts):
            x, doc = windows(data, offsets)
            rows = len(offsets) - 1
            z = self.logits(x).astype(np.float64)
            z -= z.max(axis=1, keepdims=True)
            z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
            weight = (x != 32).sum(axis=1) + 1e-3
            total = np.zeros((rows, z.shape[1]))
            np.add.at(total, doc, z * weight[:, None])
            total /= np.bincount(doc, weight, minlength=rows)[:, None]
            p = np.exp(total - total.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            names += [self.classes[i] for i in best]
            scores.append(p[np.arange(rows), best])
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fit_language_net(labelled: DataFrame, sample_rows: int = 3000) -> ByteNet:
    """The network for ``labelled`` (text, lang), learned from a bounded sample: the ``sample_rows`` rows whose
    text and language have the smallest hashes, and TRAIN_WINDOWS windows of each at most, spread evenly from the
    first to the last code point.

    Null texts and languages, and windows without a letter, are left out; of equal texts of one language one is drawn.
    Without rows the network has no classes.
    """
    known = labelled.where("lang is not null and text is not null")
    known = known.select(F.xxhash64("text", "lang").alias("by"), "lang", spread(F.col("text"), TRAIN_WINDOWS, WINDOW).alias("text"))
    rows = hash_sample(known, "by", sample_rows).toArrow()
    net = ByteNet(sorted(set(rows.column("lang").to_pylist())))
    if net.classes:
        labels = np.array([net.classes.index(x) for x in rows.column("lang").to_pylist()])
        xs, ys = [], []
        for first, last, data, offsets in chunks(rows.column("text")):
            x, doc = windows(data, offsets)
            full = (x != 32).any(axis=1)
            xs.append(x[full])
            ys.append(labels[first:last][doc[full]])
        net.train(np.concatenate(xs), np.concatenate(ys))
    return net


def predict_languages(docs: DataFrame, net: ByteNet) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred, one of the network's classes, and score, its probability.

    A text that is null or has no letter, and any text if the network has no classes, is ``und`` with
    score 0.  Long texts are read in whole, window by window.  Repeated rows get equal results; an empty table
    gives no rows.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        model = shared.value
        for batch in batches:
            names, scores = model.predict(batch.column(1)) if model.classes else ([UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows))
            told = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n if t else UNKNOWN for n, t in zip(names, told, strict=True)], pa.string()), pa.array(np.where(told, scores, 0.0), pa.float64()), batch.column(3)], ["doc_id", "lang_pred", "score", "row_key"]
            )

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), has_letter(text).alias("told"), F.xxhash64(text).alias("row_key")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, row_key long")


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")
