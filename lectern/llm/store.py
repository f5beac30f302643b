"""Session settings and intermediate tables in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch at most; texts are long, so batches are kept short.
ARROW_ROWS = 512
#: A side is broadcast only when its counted rows are at most this many.
BROADCAST_ROWS = 1_000_000
#: And a written table, only when its files have at most this many bytes.
BROADCAST_BYTES = 64 << 20


def prepare(spark: SparkSession) -> None:
    """Settings that the operators rely on: short Arrow batches and adaptive plans."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where none is set and Spark runs in one process, as in tests."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = spark.conf.get("lectern.own.checkpoint.dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("lectern.own.checkpoint.dir", own)
    return own


#: Paths that ``table`` has made, by open scope; see ``scratch``.
_scopes: list[list[str]] = []


#: Rows of a few numbers that go to one file of a table whose size is known.
FILE_ROWS = 500_000


def table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage.  ``rows``, where known about how many
    go in and come out, keeps small tables to few files."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for scope in _scopes[-1:]:
        scope.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lectern_path = path
    return out


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, place = _file_system(spark, path)
        fs.delete(place, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``table`` returned; for those that nothing will read any more."""
    for df in tables:
        delete(df.sparkSession, df.lectern_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """At its end all tables made within are deleted; what they were made for must have been written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        delete(spark, *_scopes.pop())


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows allow it and, for a written table, its counted bytes; otherwise a
    shuffled join remains, whose hot keys adaptive execution splits.  A selection from a table must be of a few
    numbers a row."""
    path = getattr(df, "lectern_path", None)
    if path:
        fs, place = _file_system(df.sparkSession, path)
        if fs.getContentSummary(place).getLength() > BROADCAST_BYTES:
            return df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def counted_small(df: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``df`` (rows of a few numbers each), written, and whether it has at most ``rows`` rows, in which case it has a
    broadcast hint."""
    df = table(df, name)
    few = df.limit(rows + 1).count() <= rows
    return F.broadcast(df) if few else df, few


#: Bits of a key filter: 32 MB at any size of the data.  Beyond about as many keys it lets most others through.
FILTER_BITS = 28


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter of one probe for the column ``k`` of evenly hashed 64-bit keys; see ``may_hold``."""
    place = F.shiftrightunsigned("k", 64 - FILTER_BITS)
    parts = keys.groupBy(F.shiftright(place, 15).alias("bucket")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit(32767))).alias("bits"))
    bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    for row in parts.toLocalIterator():  # 4 KB for each of at most 2 ** (FILTER_BITS - 15) buckets
        bits[row["bucket"] << 12 : (row["bucket"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
    return bits


def may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False for keys that were not given to ``key_filter``; true for all others and, by chance, for some of these."""
    place = (keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def hash_sample(df: DataFrame, by: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of ``df`` with distinct values of the hash ``by``, those of smallest value, the same on every run.

    A threshold from the estimated number of distinct values lets only about half as many more than ``rows`` through
    the scan, so that what is sorted does not grow with the number of tasks; of equal values, as copies have, one row
    counts, so no group of copies fills the sample or takes it away.
    """
    place = F.pmod(F.col(by), F.lit(1 << 31))
    n = df.agg(F.approx_count_distinct(by, 0.02)).first()[0]
    some = df.where(place < int((1 << 31) * 1.5 * rows / n)) if n > 1.5 * rows else df
    return some.dropDuplicates([by]).orderBy(place, by).limit(rows)


def spread(text: Column, pieces: int, width: int) -> Column:
    """``text``, or where it is longer than ``pieces`` times ``width`` code points, that many pieces of it, spread evenly
    from its first to its last code point."""
    size = F.char_length(text)
    cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda i: F.substring(text, F.floor(i * (size - width) / max(pieces - 1, 1)).cast("int") + 1, F.lit(width)))
    return F.when(size > pieces * width, F.array_join(cut, "")).otherwise(text)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_key(text: Column) -> Column:
    """With doc_id, what identifies a row."""
    return F.xxhash64(text)


def bucket_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids fall in bucket -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
