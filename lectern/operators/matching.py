"""Locating quoted text in the items of a page: exactly, else in folded form, by a prefix, or by trigrams.

Exact, case-folded, folded and prefix hits are found by expressions over the joined items; pages are folded
once, before quotes are joined to them.  Only quotes without such a hit are sent to Python, with the folded page: it
keeps an index of the trigrams of the page that it saw last, counts those that a quote shares with it, and scores
windows only around places where enough of them meet.  The span of a hit in folded text is found by walking
its first and last item.  Offsets count code points.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.folding import FORMS, fold_pairs, folded, folded_by, place_of, squeezed
from lectern.operators.steps import settled

# Marks that a span takes in at its end; the least share and score of a prefix by form; the least quote.
CLOSING = "])}\"'’”.,;:!?"
PREFIX_SHARE, PREFIX_LEAST, PREFIX_SCORES = 0.6, 6, [("light", 0.85), ("heavy", 0.80)]
LEAST, LEAST_TRIGRAMS, SURE = 3, 6, 0.95
#: What is made of a page once: folded code points, and for each form the page in it and how many characters each item has.
PAGE = ("page_pairs", *[f"{x}_{form}" for x in ("page", "sizes") for form in FORMS])
SPAN = ("begin_index", "begin_offset", "end_index", "end_offset", "score")


class TrigramIndex:
    """The places of the trigrams of a text, in order of the trigram."""

    def __init__(self, text: str):
        self.text = text
        self.codes = _codes(text)
        self.order = np.argsort(self.codes, kind="stable")
        self.sorted = self.codes[self.order]
        again = self.sorted[1:] == self.sorted[:-1]
        self.before = np.full(len(self.codes), -1)  # where the trigram of a place occurs before
        self.before[self.order[1:][again]] = self.order[:-1][again]

    def shared(self, known: np.ndarray) -> tuple[int, np.ndarray]:
        """How many of ``known`` (distinct trigrams) the text has, and where, in order."""
        begin, end = (np.searchsorted(self.sorted, known, side) for side in ("left", "right"))
        count = end - begin
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        return int((count > 0).sum()), np.sort(self.order[at])

    def distinct(self, at: np.ndarray, wide: int, low: int, high: int) -> np.ndarray:
        """For windows ``low`` to ``high`` - 1 of ``wide`` trigrams: how many different ones of those at ``at`` they hold.

        A trigram counts in the windows that hold it but not its occurrence before: a range of windows, so
        differences at its ends and their sums give all counts.
        """
        first = np.maximum(self.before[at] + 1, at - wide + 1)
        steps = np.bincount(np.clip(first - low, 0, high - low), minlength=high - low + 1) - np.bincount(np.clip(at + 1 - low, 0, high - low), minlength=high - low + 1)
        return np.cumsum(steps)[: high - low]


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]


def window_scores(text: str, needle: str) -> np.ndarray:
    """The Jaccard similarity of the trigrams of each window of ``text`` as long as ``needle`` with those of ``needle``."""
    index, known, windows = TrigramIndex(text), np.unique(_codes(needle)), len(text) - len(needle) + 1
    both = index.distinct(index.shared(known)[1], len(needle) - 2, 0, windows)
    return both / (len(known) + index.distinct(np.arange(len(index.codes)), len(needle) - 2, 0, windows) - both)


def best_window(index: TrigramIndex, needle: str, least: float) -> tuple[int, float] | None:
    """The first of the best windows, if it reaches ``least`` (less 0.001); the first that is nearly sure, if any is.

    A window that does holds at least that share of the needle's trigrams: a page with fewer is given up by their
    count, and of others only the stretch between the first and the last window with enough is scored.
    """
    if len(needle) < LEAST_TRIGRAMS or len(index.text) < len(needle):
        return None
    known, wide, windows = np.unique(_codes(needle)), len(needle) - 2, len(index.text) - len(needle) + 1
    least -= 0.001
    count, at = index.shared(known)
    if count <= least * len(known):
        return None
    both = index.distinct(at, wide, 0, windows)
    near = np.flatnonzero(both > least * len(known))
    if not len(near):
        return None
    low, high = int(near[0]), int(near[-1]) + 1
    both = both[low:high]
    scores = both / (len(known) + index.distinct(np.arange(low, high + wide - 1), wide, low, high) - both)
    best = int(np.argmax(scores > SURE)) if (scores > SURE).any() else int(np.argmax(scores))
    return (low + best, float(scores[best])) if scores[best] > least else None


def page_items(items: DataFrame) -> DataFrame:
    """(doc_id, page_num, items, and the columns PAGE): the ordered items of each page as an array of (idx, text), and their
    text in each form."""
    return _with_forms(items.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("items")))


def _with_forms(pages: DataFrame) -> DataFrame:
    """With the folded texts of the items one after the other, a blank after each (but in the dense form)."""
    texts = F.transform("items", lambda x: F.coalesce(x["text"], F.lit("")))
    pages = settled(pages, {"page_pairs": fold_pairs(F.array_join(texts, " "))})
    raw = settled(pages, {"page_raw": F.transform(texts, lambda t: folded_by(t, F.col("page_pairs")))})

    def items(form: str) -> Column:
        return F.transform("page_raw", lambda r: F.concat(squeezed(r, form), F.lit(" ")))

    made = settled(raw, {f"made_{form}": items(form) for form in ("light", "heavy")}).drop("page_raw")
    made = settled(made, {"made_dense": F.transform("made_heavy", lambda x: F.replace(x, F.lit(" "), F.lit("")))})
    columns = {f"page_{form}": F.array_join(f"made_{form}", "") for form in FORMS} | {f"sizes_{form}": F.transform(f"made_{form}", F.char_length) for form in FORMS}
    return settled(made, columns).drop(*[f"made_{form}" for form in FORMS])


def _exact_hits(quotes: DataFrame) -> DataFrame:
    """quotes (…, needle, items) with exact_hit, the span of the first hit of ``needle`` in the items' texts joined by
    blanks, or null."""
    needle, items = F.col("needle"), F.col("items")
    texts = F.transform(items, lambda x: F.coalesce(x["text"], F.lit("")))
    rows = quotes.withColumn("exact_texts", texts).withColumn("exact_joined", F.array_join("exact_texts", " "))
    joined = F.col("exact_joined")
    same = F.char_length(F.lower(joined)) == F.char_length(joined)
    at = F.coalesce(F.nullif(F.instr(joined, needle), F.lit(0)), F.when(same, F.nullif(F.instr(F.lower(joined), F.lower(needle)), F.lit(0))))
    rows = rows.withColumn("exact_at", F.when((F.regexp_replace(needle, r"\s", "") != "") & (F.size(items) > 0), at - 1))
    # one pass over the items: the last that begins at or before the hit's first place, and at or before its last
    start = F.struct(F.col("exact_at").alias("b"), (F.col("exact_at") + F.char_length(needle)).alias("e"), F.lit(0).alias("place"), F.lit(0).alias("i"), *[F.lit(0).alias(x) for x in ("first", "first_at", "last", "last_at")])

    def step(acc: Column, text: Column) -> Column:
        before, within = acc["place"] <= acc["b"], acc["place"] < acc["e"]
        pick = lambda when, new, name: F.when(when, acc[new]).otherwise(acc[name]).alias(name)
        return F.struct(
            acc["b"].alias("b"), acc["e"].alias("e"), (acc["place"] + F.char_length(text) + 1).alias("place"), (acc["i"] + 1).alias("i"),
            pick(before, "i", "first"), pick(before, "place", "first_at"), pick(within, "i", "last"), pick(within, "place", "last_at"),
        )

    rows = rows.withColumn("exact_place", F.when(F.col("exact_at").isNotNull(), F.aggregate("exact_texts", start, step)))
    p = F.col("exact_place")
    span = F.struct(
        F.get(items, p["first"])["idx"].cast("int").alias("begin_index"), F.least(p["b"] - p["first_at"], F.char_length(F.get("exact_texts", p["first"]))).alias("begin_offset"),
        F.get(items, p["last"])["idx"].cast("int").alias("end_index"), F.least(p["e"] - p["last_at"], F.char_length(F.get("exact_texts", p["last"]))).alias("end_offset"), F.lit(1.0).alias("score"),
    )
    return settled(rows, {"exact_hit": F.when(p.isNotNull(), span)})


def _folded_hits(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows (…, needle, items, page forms, exact_hit) with quote forms and ``told``: struct(form, b, e, score) of the first hit of the
    whole quote in a form, or of its prefix, or null."""
    raw = settled(rows, {"quote_raw": folded(F.coalesce("needle", F.lit("")))})
    rows = settled(raw, {f"quote_{form}": squeezed(F.col("quote_raw"), form) for form in ("light", "heavy")}).drop("quote_raw")
    rows = settled(rows, {"quote_dense": F.replace("quote_heavy", F.lit(" "), F.lit(""))})

    def hit(form: str, part: Column, score: float, when: Column) -> Column:
        at, size = F.instr(f"page_{form}", part), F.char_length(f"quote_{form}")
        end = F.least(at - 1 + size, F.char_length(f"page_{form}"))
        return F.when(when & (at > 0), F.struct(F.lit(form).alias("form"), (at - 1).alias("b"), end.alias("e"), F.lit(score).alias("score")))

    tries = [hit(form, F.col(f"quote_{form}"), 1.0, F.char_length(f"quote_{form}") >= LEAST) for form in FORMS]
    for form, score in PREFIX_SCORES:
        if score >= threshold:
            size = F.greatest(F.lit(PREFIX_LEAST), (F.char_length(f"quote_{form}") * PREFIX_SHARE).cast("int"))
            tries.append(hit(form, F.substring(F.col(f"quote_{form}"), F.lit(1), size), score, F.lit(True)))
    usable = F.col("exact_hit").isNull() & (F.char_length("quote_heavy") >= LEAST) & (F.size("items") > 0)
    rows = settled(rows, {"usable": F.coalesce(usable, F.lit(False))})
    return settled(rows, {"told": F.when(F.col("usable"), F.coalesce(*tries))})


def _best_windows(threshold: float):
    """A function of the heavy forms of page and quote; null for rows where they are null."""

    @F.pandas_udf("b int, e int, score double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index = None
        for page, quote in batches:
            told = []
            for text, needle in zip(page, quote, strict=True):
                if text is not None and (index is None or index.text != text):
                    index = TrigramIndex(text)
                hit = None if text is None else best_window(index, needle, threshold)
                told.append((hit[0], hit[0] + len(needle), hit[1]) if hit else (None, None, None))
            yield pd.DataFrame(told, columns=["b", "e", "score"]).astype({"b": "Int32", "e": "Int32", "score": "float64"})

    return run


def _spans(rows: DataFrame, names: list[str]) -> DataFrame:
    """``names`` and the span of ``told`` (form, b, e, score) in the items; nulls without one."""
    told = F.col("told")
    texts = F.transform("items", lambda x: F.coalesce(x["text"], F.lit("")))
    rows = settled(rows, {"span_texts": F.when(told.isNotNull(), texts)})
    sizes = F.when(told["form"] == "light", F.col("sizes_light")).when(told["form"] == "heavy", F.col("sizes_heavy")).when(told["form"] == "dense", F.col("sizes_dense"))
    rows = settled(rows, {"span_sizes": sizes})

    def item(at: Column) -> Column:
        """struct(i, before) of the item that holds the form's character ``at``; items without characters hold none."""
        start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("before"), F.lit(0).alias("n"), F.lit(0).alias("seen"))

        def step(acc: Column, size: Column) -> Column:
            ours = (at >= acc["seen"]) & (at < acc["seen"] + size)
            return F.struct(F.when(ours, acc["n"]).otherwise(acc["i"]).alias("i"), F.when(ours, acc["seen"]).otherwise(acc["before"]).alias("before"), (acc["n"] + 1).alias("n"), (acc["seen"] + size).alias("seen"))

        return F.aggregate("span_sizes", start, step)

    rows = settled(rows, {"span_first": item(told["b"]), "span_last": item(told["e"] - 1)})
    text = {k: F.get("span_texts", F.col(f"span_{k}")["i"]) for k in ("first", "last")}
    size = {k: F.get("span_sizes", F.col(f"span_{k}")["i"]) - F.when(told["form"] == "dense", 0).otherwise(1) for k in ("first", "last")}
    begin = place_of(text["first"], F.col("page_pairs"), told["form"], told["b"] - F.col("span_first")["before"], size["first"])["begin"]
    end = place_of(text["last"], F.col("page_pairs"), told["form"], told["e"] - 1 - F.col("span_last")["before"], size["last"])["end"]
    rows = settled(rows, {"span_begin": begin, "span_end": end})
    rest = F.substring(text["last"], F.col("span_end") + 1, F.char_length(text["last"]))
    closing = F.char_length(rest) - F.char_length(F.ltrim(rest, F.lit(CLOSING)))
    idx = [F.get("items", F.col(f"span_{k}")["i"])["idx"].cast("int") for k in ("first", "last")]
    span = [idx[0], F.col("span_begin"), idx[1], F.col("span_end") + closing, told["score"]]
    return rows.select(*names, *[F.when(told.isNotNull(), x).alias(n) for x, n in zip(span, SPAN, strict=True)])


def match_spans(quotes: DataFrame, threshold: float = 0.55) -> DataFrame:
    """quotes (…, needle, items, and what ``page_items`` makes where it is there) with the span of the match, nulls
    without one.  Blank and null quotes and pages without items have none."""
    names = [c for c in quotes.columns if c != "items" and c not in PAGE]
    exact = _exact_hits(quotes)
    rows = _folded_hits(exact if set(PAGE) <= set(quotes.columns) else _with_forms(exact), threshold)
    asked = F.col("told").isNull() & F.col("usable")
    rows = rows.withColumn("window", _best_windows(threshold)(F.when(asked, F.col("page_heavy")), F.when(asked, F.col("quote_heavy"))))
    window = F.when(F.col("window")["b"].isNotNull(), F.struct(F.lit("heavy").alias("form"), F.col("window")["b"].alias("b"), F.col("window")["e"].alias("e"), F.col("window")["score"].alias("score")))
    found = _spans(rows.withColumn("told", F.coalesce("told", window)), [*names, "exact_hit"])
    hit = F.col("exact_hit")
    return found.select(*names, *[F.when(hit.isNotNull(), hit[n]).otherwise(F.col(n)).alias(n) for n in SPAN])


def anchors(highlights: DataFrame, items: DataFrame, threshold: float = 0.55) -> DataFrame:
    """highlights (id, doc_id, page_num, exact_text, file_name) with the best span on their own page or, without one
    there, the page before or after (the better; one of 0.9 or more on the page before ends it)."""
    pages = page_items(items).withColumnRenamed("page_num", "match_page").withColumnRenamed("doc_id", "page_doc")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), (F.col("page_num") + d).alias("at")) for i, d in enumerate((0, -1, 1))]))
    tries = highlights.select("id", F.col("doc_id").alias("page_doc"), F.col("exact_text").alias("needle"), steps.alias("try"))
    tries = tries.select("id", "page_doc", "needle", F.col("try.at").alias("match_page"), "try.step").dropna()
    # what several highlights, or several steps, seek on a page is sought there once
    sought = tries.select("page_doc", "match_page", "needle").distinct()
    found = match_spans(sought.join(pages, ["page_doc", "match_page"]), threshold).where("score is not null")
    found = tries.join(found, ["page_doc", "match_page", "needle"])
    good = F.when((F.col("step") == 0) | ((F.col("step") == 1) & (F.col("score") >= 0.9)), 2.0 - F.col("step") / 10).otherwise(F.col("score"))
    best = found.groupBy("id").agg(F.max_by(F.struct("match_page", "begin_index", "begin_offset", "end_index", "end_offset", "score"), F.struct(good, -F.col("step"))).alias("m"))
    page = F.coalesce("m.match_page", "page_num")
    return highlights.join(best, "id", "left").select(
        *highlights.columns, page.alias("match_page"), F.coalesce("m.score", F.lit(0.0)).alias("score"), "m.begin_index", "m.begin_offset", "m.end_index", "m.end_offset",
        F.concat(F.lit("[["), "file_name", F.lit("#page="), page.cast("string"), F.lit("]]")).alias("link"),
    )


def stored(found: DataFrame) -> DataFrame:
    """Anchors with both ends, offsets 0 and page 1 by default, as they are kept by document."""
    return found.where("begin_index is not null and end_index is not null").withColumns({"begin_offset": F.coalesce("begin_offset", F.lit(0)), "end_offset": F.coalesce("end_offset", F.lit(0)), "match_page": F.coalesce("match_page", F.lit(1))})


def on_page(found: DataFrame, doc_id: Column, page: Column) -> DataFrame:
    """Stored anchors of one page of a document, in the order in which they begin."""
    return found.where((F.col("doc_id") == doc_id) & (F.col("match_page") == page)).orderBy("begin_index", "begin_offset")
