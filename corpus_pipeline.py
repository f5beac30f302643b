"""The corpus pipeline: five stages from documents to a sampled mix.  Counted as part of ``lectern.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read back
as the next stage's docs.  Extra columns of documents are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, jaccard_join, language_id, line_dedup, mixing
from lectern.llm.store import bucket_of, delete, scratch, shared_dir, small, table, text_key

#: A prediction less probable than this is no language of the corpus (chance, with four, is 0.25).
MIN_LANGUAGE_SCORE = 0.3


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows in ``gone`` (doc_id, row_key).  The keys are written and counted first: if they are few
    they are broadcast, and no text is shuffled."""
    keys = gone.select(F.col("doc_id").alias("lectern_id"), F.col("row_key").alias("lectern_key")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("lectern_id")) & (text_key(F.coalesce(docs["text"], F.lit(""))) == F.col("lectern_key"))
    return docs.join(small(table(keys, "gone")), same, "left_anti").select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no language: null texts, texts without a letter or below the least score.

    The network learns from the rows that query op8 learns from; lang itself is left as it is.
    """
    net = language_id.fit_language_net(docs.where(bucket_of(F.col("doc_id"), 5) != 0).select("text", "lang"))
    told = language_id.predict_languages(docs.select("doc_id", "text"), net)
    gone = told.where((F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < MIN_LANGUAGE_SCORE))
    return _without(docs, gone)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that 10 documents or more share; n_chars, if there, counts the new text.  Documents stay,
    also if nothing is left of them (their text is then empty)."""
    rest = line_dedup.dedup_lines(docs, keep_columns=docs.columns)
    counted = [F.char_length("kept_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("kept_text").alias(c) if c == "text" else F.col(f"lectern_{c}").alias(c) for c in docs.columns]
    return rest.select(*counted)


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity 0.8): that of smallest id (a null id
    counts as largest) and, among rows of that id, of smallest hash of the text.  A document is a row of doc_id and
    text, so a text that only shares its id with a copy stays.  Repeated rows (equal id and text) stay once.
    Empty texts are in no group and stay."""
    grouped = table(jaccard_join.jaccard_components(docs, shingle=5, percent=80).where("n_shingles > 0").select("component", "doc_id", "row_key"), "grouped")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    firsts = grouped.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    kept = _without(docs, grouped.join(firsts, "component").where(place != F.col("first")))
    again = docs.groupBy("doc_id", text_key(F.col("text")).alias("row_key")).agg(F.count("*").alias("rows")).where("rows > 1")
    return kept if again.isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of ten words of a benchmark item (or a whole shorter item)."""
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("n_hit > 0"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents to the raked weights: the columns of documents with n_tokens and probability."""
    out = mixing.mixing_probabilities(docs, keep=tuple(docs.columns)).where("sampled")
    return out.select(*[F.col(f"lectern_{c}").alias(c) for c in docs.columns], F.col("n_tokens").alias("mix_tokens"), F.col("probability").alias("mix_probability"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", join_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
]

#: The first stage is a trained network, which SQL cannot express.  Tests hold line dedup, near duplicates and decontamination
#: against brute force, language identification on rows whose language is known, and mixing on its targets.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; a stage's own tables, and the documents that it read, are deleted once its result
    is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/lectern/pipeline-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
