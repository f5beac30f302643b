"""Highlight rectangles: rows of text, clusters within a row, and merged boxes in percent of the page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MATH = "[Λ∆πθβσ∑∫≈≠≤≥±∞∼−×÷]"


#: Rectangles that a task sorts at a time, on average.
TASK_ROWS = 500_000


def dealt(rects: DataFrame, page: str) -> DataFrame:
    """Whole pages, dealt to as many partitions as keep TASK_ROWS rectangles each (and all cores busy), so that what a task sorts
    does not grow with the table.  Its rows are counted for that: give it a table, not what is costly to make."""
    n = max(-(-rects.count() // TASK_ROWS), rects.sparkSession.sparkContext.defaultParallelism)
    return rects.repartition(n, page)


def clustered(rects: DataFrame) -> DataFrame:
    """rects (page_id, pos, left, right, top, bottom, text) with row_no and cluster_no, by gaps and islands.

    Rectangles without area are left out; ``dealt`` rectangles are not shuffled again.  In order of centre and left edge, a new row starts where the
    centre moves by more than 0.55 of the greater height; within a row, a new cluster where the gap or the
    overlap says so.
    """
    r = rects.where("right > left and bottom > top").withColumn("height", F.col("bottom") - F.col("top")).withColumn("cy", (F.col("top") + F.col("bottom")) / 2)
    by_y = W.partitionBy("page_id").orderBy("cy", "left", "pos")
    jump = F.abs(F.lag("cy").over(by_y) - F.col("cy")) > 0.55 * F.greatest(F.lag("height").over(by_y), "height")
    r = r.withColumn("jump", F.coalesce(jump, F.lit(True)).cast("int")).withColumn("row_no", F.sum("jump").over(by_y))
    by_x = W.partitionBy("page_id", "row_no").orderBy("left", "pos")
    before = {c: F.lag(c).over(by_x) for c in ("right", "top", "bottom", "height")}
    gap = F.col("left") - before["right"]
    overlap = (F.least(before["bottom"], "bottom") - F.greatest(before["top"], "top")) / F.greatest(F.lit(1.0), F.least(before["height"], "height"))
    near = F.greatest(F.lit(3.0), F.least(F.lit(7.0), F.greatest(before["height"], "height") * 0.45))
    new = F.coalesce(~((gap <= near) & (overlap >= 0.45)), F.lit(True))
    return r.withColumn("new", new.cast("int")).withColumn("cluster_no", F.sum("new").over(by_x)).drop("jump", "new")


def merged_rows(rects: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, row_no, cluster_no, text, left, top, width, height): boxes in percent of pages (page_id, page_left, page_top,
    page_width, page_height); clusters that look like formulas, and short ones beside them, are left out."""
    order = F.array_sort(F.collect_list(F.struct("left", "pos", "text")))
    c = clustered(rects).groupBy("page_id", "row_no", "cluster_no").agg(
        F.min("left").alias("l"), F.max("right").alias("r"), F.min("top").alias("t"), F.max("bottom").alias("b"), F.count("*").alias("n"),
        F.sum((F.length(F.trim("text")).between(1, 3)).cast("int")).alias("short"), order.alias("xs"),
    )
    c = c.withColumn("text", F.array_join(F.transform("xs", lambda x: x["text"]), "")).withColumn("dense", F.regexp_replace("text", r"\s+", ""))
    size, alnum = F.length("dense"), F.regexp_count("dense", F.lit("[A-Za-z0-9]"))
    other, math = size - alnum, F.regexp_count("dense", F.lit(MATH))
    like = (
        (size == 0) | F.col("dense").rlike("[\\x00-\\x1f]") | ((size <= 3) & ((math > 0) | (other > 0))) | (math >= 2)
        | ((F.col("n") >= 6) & (F.col("short") >= F.ceil(F.col("n") * 0.6)) & (other >= F.greatest(F.lit(4.0), alnum * 0.5)))
        | ((F.col("n") >= 4) & (other >= F.greatest(F.lit(5), alnum)))
    )
    c = c.withColumn("formula", like)
    row = W.partitionBy("page_id", "row_no").orderBy("cluster_no")
    beside = F.coalesce(F.lag("formula").over(row), F.lit(False)) | F.coalesce(F.lead("formula").over(row), F.lit(False))
    tiny = beside & size.between(1, 4) & (F.col("n") <= 2) & ((F.col("r") - F.col("l")) <= F.greatest(F.lit(16.0), (F.col("b") - F.col("t")) * 2.5))
    c = c.withColumn("tiny", tiny).where("not formula and not tiny").join(pages, "page_id")
    pad = F.least(F.lit(1.25), F.greatest(F.lit(0.5), (F.col("b") - F.col("t")) * 0.06))
    left = F.greatest(F.col("page_left"), F.col("l") - pad)
    right = F.least(F.col("page_left") + F.col("page_width"), F.col("r") + pad)
    pct = lambda x, whole: F.round(x / F.col(whole) * 100, 6)
    return c.select("page_id", "row_no", "cluster_no", "text", pct(left - F.col("page_left"), "page_width").alias("left"), pct(F.col("t") - F.col("page_top"), "page_height").alias("top"), pct(right - left, "page_width").alias("width"), pct(F.col("b") - F.col("t"), "page_height").alias("height"))
