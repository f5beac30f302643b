"""Line dedup: lines that many documents share are dropped wherever they stand.

DataFrame functions only.  Lines are exploded as two 64-bit hashes of their key, so neither texts nor
lines are shuffled to count them; only documents that lose a line are put together anew, by position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import ascii_lower, prepare, small, table, text_key

#: Stripped at both ends of a line for its key.
BLANKS = " \t\n\x0b\x0c\r"


def line_keys(text: Column) -> Column:
    """The key of each line: stripped, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.trim(x, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1, keep_columns: Sequence[str] = ()) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_lines, n_dropped, kept_text, and the columns named in
    ``keep_columns``, prefixed lectern_.

    A line goes if its key has at least ``min_length`` code points and is found in at least
    ``min_docs`` documents, also in the first of them.  Rows that share a doc_id (or whose doc_id is
    null) count as one document; repeated rows each lose their lines.  A null or empty text is one empty line and
    stays empty; a text that loses all its lines becomes empty.  Texts of any length are split whole.  An empty
    table gives no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = rows.select("doc_id", text_key(F.col("text")).alias("row_key"), F.posexplode(line_keys(F.col("text"))).alias("pos", "key"))
    lines = lines.where(F.char_length("key") >= min_length).select(
        "doc_id", "row_key", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")
    )
    shared = lines.select("doc_id", "h1", "h2").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
    shared = small(table(shared.where(F.col("n_docs") >= min_docs).select("h1", "h2"), "shared-lines"))
    dropped = lines.join(shared, ["h1", "h2"], "left_semi").groupBy("doc_id", "row_key").agg(F.collect_set("pos").alias("dropped"))
    dropped = dropped.withColumnsRenamed({"doc_id": "d_id", "row_key": "d_key"})
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[F.col(c).alias(f"lectern_{c}") for c in keep_columns if c != "text"])
    rows = rows.withColumn("row_key", text_key(F.col("text")))
    joined = rows.join(dropped, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("row_key") == F.col("d_key")), "left")
    split = F.split("text", "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("dropped"))
    return joined.select(
        "doc_id",
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
        .alias("kept_text"),
        *[F.col(f"lectern_{c}") for c in keep_columns if c != "text"],
    )
