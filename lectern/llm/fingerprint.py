"""Document fingerprints: a quartile bucket digest.

Byte triplets within a window of five are hashed (by tabulation) into buckets and counted.  The digest
gives for each bucket the quartile of its count among the text's buckets, in two bits, after a check byte
and the length on a logarithmic scale, in hexadecimal.  Two digests differ by the steps between their
quartiles (opposite ends count double) and lengths; the likeness is 1 less that difference over its
value for unrelated digests, bounded by 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm.store import prepare, text_key
from lectern.llm.text_bytes import GOLDEN, U, chunks, mix

BUCKETS = 256
#: Bytes of a window of five that make a triplet.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
#: What digests of independent buckets differ by: 1.625 for each bucket.
BOUND = 1.625 * BUCKETS
#: Lengths that differ by this factor differ by 1.
LENGTH_BASE = 1.3
#: Bytes of text in a range of doc_id, about.
RANGE_BYTES = 4 << 20

_tables = (mix(np.arange(len(TRIPLETS) * 3 * 256, dtype=np.uint64) * GOLDEN + U(1)) >> U(56)).astype(np.uint8).reshape(len(TRIPLETS), 3, 256)


def digests(texts: pa.Array) -> list[str]:
    """The digest of each text; null as empty.  A text of fewer than three bytes has no triplets."""
    out = []
    for first, last, data, offsets in chunks(texts):
        rows = last - first
        size = np.diff(offsets)
        doc = np.repeat(np.arange(rows), size)
        left = np.repeat(offsets[1:], size) - np.arange(len(data))  # bytes to the text's end
        counts = np.zeros(rows * BUCKETS, np.int64)
        base = doc * BUCKETS
        for table, triplet in zip(_tables, TRIPLETS, strict=True):
            n = len(data) - triplet[2]
            if n <= 0:
                continue
            h = table[0][data[:n]] ^ table[1][data[triplet[1] : triplet[1] + n]] ^ table[2][data[triplet[2] :]]
            inside = left[:n] > triplet[2]
            counts += np.bincount((base[:n] + h)[inside], minlength=rows * BUCKETS)
        counts = counts.reshape(rows, BUCKETS)
        ordered = np.sort(counts, axis=1)
        code = np.zeros((rows, BUCKETS), np.uint8)
        for k in (1, 2, 3):
            code += counts > ordered[:, k * BUCKETS // 4 - 1][:, None]
        packed = code[:, 0::4] | code[:, 1::4] << 2 | code[:, 2::4] << 4 | code[:, 3::4] << 6
        length = np.minimum(np.log1p(size) / np.log(LENGTH_BASE), 255).astype(np.uint8)
        check = np.zeros(rows, np.int64)
        np.add.at(check, doc, data)
        head = np.stack([(check % 251).astype(np.uint8), length], axis=1)
        out += [row.tobytes().hex() for row in np.concatenate([head, packed], axis=1)]
    return out


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """From 0 (as unrelated as digests are) to 1 (equal digests) for each pair."""
    if not left:
        return np.zeros(0)
    a, b = (np.frombuffer(bytes.fromhex("".join(x)), np.uint8).reshape(len(x), -1) for x in (left, right))
    total = np.abs(a[:, 1].astype(np.int64) - b[:, 1]) + (a[:, 0] != b[:, 0])
    cost = np.array([0, 1, 2, 6])
    for shift in (0, 2, 4, 6):
        total = total + cost[np.abs(((a[:, 2:] >> shift) & 3).astype(np.int64) - ((b[:, 2:] >> shift) & 3))].sum(axis=1)
    return 1 - np.minimum(total, BOUND) / BOUND


def _first_pass(bounds: np.ndarray):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            part = np.searchsorted(bounds, ids, "left")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests(batch.column(1)), pa.string()), pa.array(part, pa.int64())], ["doc_id", "text", "fingerprint", "part"])

    return run


def _second_pass(batches):
    for batch in batches:
        edited = digests(batch.column("edited"))
        own, after = batch.column("fingerprint").to_pylist(), batch.column("next_fingerprint").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_chars"), batch.column("edited_sha256"), batch.column("fingerprint"), pa.array(edited, pa.string()), pa.array(likeness(own, edited)), pa.array(likeness(own, after))],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, an integer, and text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the
    next document (ascending doc_id, nulls first, equal ids by a hash of the text; after the last
    comes the first).  A null text is empty.  Texts travel once, to ranges of doc_id; each range also
    gets the first row of the next.  Repeated rows follow each other, in any order; rows without or of one id are
    in one range.  Texts of any length are digested whole.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(2, -(-size // RANGE_BYTES))
    bounds = np.unique(np.array(docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", [i / count for i in range(1, count)], 0.1 / count), np.float64)).astype(np.int64)

    def in_part(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.searchsorted(bounds, ids, "left"), pa.int64())], ["doc_id", "row_key", "part"])

    keys = rows.select("doc_id", text_key(F.col("text")).alias("row_key")).mapInArrow(in_part, f"doc_id {kind}, row_key long, part long")
    firsts = sorted(keys.groupBy("part").agg(F.min(F.struct("doc_id", "row_key")).alias("at")).collect(), key=lambda r: r["part"])  # a row for each range
    copies = spark.createDataFrame(
        [(r["at"]["doc_id"], r["at"]["row_key"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)], f"c_id {kind}, c_key long, to_part long"
    )
    signed = rows.mapInArrow(_first_pass(bounds), f"doc_id {kind}, text string, fingerprint string, part long").withColumn("row_key", text_key(F.col("text")))
    signed = signed.join(F.broadcast(copies), F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("row_key") == F.col("c_key")), "left")
    places = F.array_compact(F.array(F.struct("part", F.lit(0).alias("copy")), F.when(F.col("to_part").isNotNull(), F.struct(F.col("to_part").alias("part"), F.lit(1).alias("copy")))))
    placed = signed.select("doc_id", "row_key", "text", "fingerprint", F.explode(places).alias("at"))
    placed = placed.select("doc_id", "row_key", "text", "fingerprint", "at.part", "at.copy")
    order = W.partitionBy("part").orderBy("copy", "doc_id", "row_key")
    placed = placed.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("copy = 0")
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    placed = placed.select("doc_id", n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k)).alias("edited"))
    placed = placed.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    return placed.mapInArrow(_second_pass, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
