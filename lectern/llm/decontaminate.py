"""Benchmark decontamination: windows of benchmark words found in documents.

DataFrame functions only.  The hashes of all windows of the benchmark's normalised words form a set, which is
broadcast if its counted rows allow it (8 bytes each); all token windows of the documents are scanned against
it, and each hit is verified word for word before it counts.  From the hits come spans or documents to remove.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import ascii_lower, drop, prepare, small, table, text_key

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, letters a-z and all beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), WORD_BREAK), "")


def benchmark_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """(item_id, win): distinct windows of ``width`` words, or the whole item if it has fewer."""
    items = benchmark.select("item_id", word_array(F.coalesce("text", F.lit(""))).alias("ws")).where(F.size("ws") > 0)
    last = F.greatest(F.size("ws") - width, F.lit(0))
    return items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("ws", i + 1, width))).alias("win")).distinct()


def window_hashes(ws: Column, lengths: list[int]) -> Column:
    """An array of (at, len, h): the hashes of all windows of these numbers of words in the array ``ws``."""

    def of_length(n: int) -> Column:
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), F.xxhash64(F.slice(ws, i + 1, n)).alias("h")))

    return F.concat(*[of_length(n) for n in lengths])


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, items (sorted, as strings), row_key,
    and spans, the merged word ranges [from, to) that are hit (null if none).

    Null or wordless texts and items have no windows.  Rows with equal doc_id and text get equal
    results, also if repeated; a null item_id is left out of ``items`` but its windows still hit.  Texts of any length
    are scanned whole.  An empty table of documents gives no rows, one of items no hits.
    """
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    rid = F.struct("doc_id", text_key(text).alias("row_key")).cast(f"struct<doc_id:{kind},row_key:bigint>").alias("rid")
    rows = docs.select(rid, text.alias("text"))
    wins = table(benchmark_windows(benchmark, width).withColumn("w_id", F.xxhash64("win")), "windows")
    lengths = sorted(r["n"] for r in wins.select(F.size("win").alias("n")).distinct().collect())  # width numbers at most
    words = rows.select("rid", word_array(F.col("text")).alias("ws"))
    if lengths:
        # the set of hashes is broadcast if it is counted to be small; else hashes, not texts, are shuffled
        known = small(table(wins.select(F.col("w_id").alias("h")).distinct(), "window-hashes"))
        seen = words.select("rid", F.explode(window_hashes(F.col("ws"), lengths)).alias("w")).select("rid", "w.at", "w.len", "w.h")
        probed = table(seen.join(known, "h").distinct(), "probed")
        # word for word: only texts with a hash hit are read again
        places = table(probed.groupBy("rid").agg(F.collect_list(F.struct("at", "len", "h")).alias("places")), "places")
        again = rows.join(small(places.select("rid")), "rid", "left_semi").join(places, "rid").dropDuplicates(["rid"])
        again = again.select("rid", word_array(F.col("text")).alias("ws"), "places")
        again = again.select("rid", F.explode(F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["len"].alias("len"), p["h"].alias("h"), F.slice("ws", p["at"] + 1, p["len"]).alias("got")))).alias("p"))
        texts = wins.select(F.col("w_id").alias("h"), "win").distinct()
        found = again.select("rid", "p.*").join(texts, "h").where(F.col("got") == F.col("win")).select("rid", "at", "len", "win")
        found = table(found.distinct(), "window-hits")
        drop(probed, places)
    else:
        found = words.where("false").select("rid", F.lit(0).alias("at"), F.lit(0).alias("len"), "ws").withColumnRenamed("ws", "win")
    spans = found.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct(F.col("at").alias("b"), (F.col("at") + F.col("len")).alias("e")))).alias("sp"))
    merged = F.expr(
        """aggregate(sp, array(named_struct('b', -1, 'e', -1)), (acc, x) ->
             if(element_at(acc, -1).e >= x.b and element_at(acc, -1).b >= 0,
                concat(slice(acc, 1, size(acc) - 1),
                       array(named_struct('b', element_at(acc, -1).b, 'e', greatest(element_at(acc, -1).e, x.e)))),
                concat(acc, array(x))))"""
    )
    covered = F.expr("aggregate(sp, named_struct('n', 0L, 'e', 0), (acc, x) -> named_struct('n', acc.n + greatest(x.e - greatest(x.b, acc.e), 0), 'e', greatest(acc.e, x.e))).n")
    spans = spans.select("rid", covered.alias("n_hit"), F.slice(merged, 2, 1_000_000_000).alias("spans"))
    items = found.select("rid", "win").distinct().join(wins.select("win", "item_id"), "win")
    items = items.groupBy("rid").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hits = table(spans.join(items, "rid"), "hit-documents")
    sizes = rows.select("rid", F.size(word_array(F.col("text"))).cast("long").alias("n_words"))
    return sizes.join(small(hits), "rid", "left").select(
        "rid.doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "spans",
        "rid.row_key",
    )


def remove_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the hit words (each goes with the separator after it); other rows as they are."""
    columns = docs.columns
    hit = found.where(F.col("n_hit") > 0).select(F.col("doc_id").alias("lectern_id"), F.col("row_key").alias("lectern_key"), F.col("spans").alias("lectern_spans")).distinct()
    letters = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    ws, seps = F.regexp_extract_all("text", F.lit(letters), 0), F.split("text", letters)
    gone = F.flatten(F.transform("lectern_spans", lambda s: F.sequence(s["b"], s["e"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size(ws) - 1), gone)
    cut = F.concat(F.get(seps, F.lit(0)), F.array_join(F.transform(kept, lambda i: F.concat(F.get(ws, i), F.get(seps, i + 1))), ""))
    joined = docs.join(hit, docs["doc_id"].eqNullSafe(F.col("lectern_id")) & (text_key(F.coalesce(docs["text"], F.lit(""))) == F.col("lectern_key")), "left")
    return joined.select(*[F.when(F.col("lectern_spans").isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else docs[c] for c in columns])


def remove_documents(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without those that are hit."""
    hit = found.where(F.col("n_hit") > 0).select(F.col("doc_id").alias("lectern_id"), F.col("row_key").alias("lectern_key")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("lectern_id")) & (text_key(F.coalesce(docs["text"], F.lit(""))) == F.col("lectern_key"))
    return docs.join(hit, same, "left_anti")
