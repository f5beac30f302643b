"""Second calls: truncated answers are asked for again with more room, insufficient ones are repaired or replaced.

Each stage is a table; only the rows that need it go to the next call, and answers meet by id.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import responses, rules
from lectern.functions.text import excerpt, trim_all
from lectern.sources.files import call_provider

Call = Callable[[str, str, int], tuple[int, str]]


def _texts(answered: DataFrame) -> DataFrame:
    r = responses.response_text(F.col("provider"), F.col("body"))
    return answered.withColumn("r", r).select("id", "provider", "system", "user", "max_tokens", F.col("r.text").alias("text"), F.col("r.truncated").alias("truncated"))


def call_with_retry(requests: DataFrame, call: Call, parallel: int = 3, kept: str | None = None) -> DataFrame:
    """requests (id, provider, system, user, max_tokens) with text and tries; an answer that is cut off, or is JSON that
    looks so, is asked for once more with a larger budget.  Of the two, one that parses stays, else the longer.

    The first answers are read twice.  With a folder ``kept`` they and the second ones are written there and read back, so
    each request is made once, whatever the plan, and a later step sees the same answer; without it a
    provider should give the same answer again.
    """

    def answered(asked: DataFrame, name: str) -> DataFrame:
        texts = _texts(call_provider(asked, call, parallel))
        if kept is None:
            return texts
        texts.write.mode("overwrite").parquet(f"{kept}/{name}")
        return requests.sparkSession.read.parquet(f"{kept}/{name}")

    first = answered(requests, "first")
    cut = first.where(F.col("truncated") | responses.looks_truncated(F.col("text")))
    again = cut.select("id", "provider", "system", "user", rules.retry_token_budget(F.col("max_tokens")).cast("int").alias("max_tokens"))
    second = answered(again, "second").select("id", F.col("text").alias("again"))
    both = first.join(second, "id", "left")
    parsed = lambda c: responses.json_or_inner(F.col(c)).isNotNull()
    better = F.col("again").isNotNull() & F.when(parsed("again"), True).when(parsed("text"), False).otherwise(F.length("again") > F.length("text"))
    return both.select("id", F.when(better, F.col("again")).otherwise(F.col("text")).alias("text"), F.when(F.col("again").isNull(), 1).otherwise(2).alias("tries"))


# What stands in for an explanation that could not be had, and for a figure's note, by language.
SECTION_NET = {
    "en": [
        "> [!note] This part corresponds to **{name}** in the paper.",
        "The safest confirmed focus is: {focus}",
        "Finer technical details still need to be checked against the original section, so this fallback keeps the explanation intentionally minimal.",
    ],
    "zh-CN": ["> [!note] 这一部分对应论文中的 **{name}**。", "当前可直接确认的重点是：{focus}", "更细的技术细节需要继续结合原文该节核对，因此此处先保留最小化讲解。"],
}
FORMULA_NET = {
    "en": [
        "{formula}",
        "> [!note] Minimal formula note",
        '> This formula appears in **{name}** and is directly tied to "{focus}".',
        "> Finer variable definitions still need to be checked against the nearby source context, so this fallback keeps only the safest role-level explanation.",
    ],
    "zh-CN": ["{formula}", "> [!note] 最小化公式说明", "> 该公式位于 **{name}**，当前可确认它与“{focus}”直接相关。", "> 更细的变量释义需要继续结合上下文核对，因此这里先保留公式本体与作用说明。"],
}
FIGURE_NOTE = {"en": "This figure is referenced by the surrounding explanation and is inserted here for direct lookup.", "zh-CN": "这张图与上文讲解直接相关，放在这里便于对照理解。"}
FIGURE = r"(?i)(?:Figure|Fig\.?)[ ]*\d+"


def _filled(parts: list[str], **values: Column) -> Column:
    """The parts with values in place of their names, parted by empty lines; empty parts are left out."""
    made = []
    for part in parts:
        pieces = re.split(r"\{(\w+)\}", part)
        made.append(F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(pieces)]))
    return F.array_join(F.filter(F.array(*made), lambda x: x != ""), "\n\n")


def safety_net(label: Column, focus: Column, language: str = "en") -> Column:
    """For a section of that name whose goal, or excerpt, is ``focus``."""
    return _filled(SECTION_NET[language], name=label, focus=focus)


def formula_net(formula: Column, label: Column, focus: Column, language: str = "en") -> Column:
    return _filled(FORMULA_NET[language], formula=responses.formula_block(formula), name=label, focus=focus)


def explained(answers: DataFrame, repairs: DataFrame, language: str = "en", least: int = 60) -> DataFrame:
    """(id, markdown, step): answers (id, text, label, content, and focus or else the excerpt of content), else repairs
    (id, text), else the safety net, by which is sufficient first."""
    focus = F.col("focus") if "focus" in answers.columns else excerpt(F.col("content"))
    own = answers.withColumn("markdown", responses.markdown_of(F.col("text")))
    fixed = repairs.select("id", responses.markdown_of(F.col("text")).alias("repaired"))
    both = own.join(fixed, "id", "left")
    good = ~rules.is_insufficient(F.col("markdown"), F.col("content"), language, least)
    mended = F.col("repaired").isNotNull() & ~rules.is_insufficient(F.coalesce("repaired", F.lit("")), F.col("content"), language, least)
    return both.select(
        "id", F.when(good, F.col("markdown")).when(mended, F.col("repaired")).otherwise(safety_net(F.col("label"), focus, language)).alias("markdown"),
        F.when(good, "answer").when(mended, "repair").otherwise("safety-net").alias("step"),
    )


def block_body(markdown: Column) -> Column:
    """An explanation without the heading that it begins with; sections of one heading are joined as prose."""
    return F.regexp_replace(trim_all(markdown), r"\A#{1,6}\s+[^\n]*\n+", "")


def _image_ids(mentions: Column, path: Column, images: Column) -> Column:
    """The first two of the images (array of id, path, content, in order) that mentions name, by number or because they stand in
    the same section; without any, the first two of the section."""
    same = F.filter(images, lambda x: x["path"] == path)

    def named(mention: Column) -> Column:
        number = F.nullif(F.regexp_extract(mention, r"(?i)(?:Figure|Fig\.?)[ ]*(\d+)", 1), F.lit(""))
        return F.filter(images, lambda x: (x["path"] == path) | F.coalesce(F.regexp_like(x["content"], F.concat(F.lit(r"(?i)(?:figure|fig\.?|image)[ ]*"), number)), F.lit(False)))

    found = F.array_distinct(F.transform(F.flatten(F.transform(mentions, named)), lambda x: x["id"]))
    return F.slice(F.when(F.size(found) > 0, found).otherwise(F.transform(same, lambda x: x["id"])), 1, 2)


def explainer_outputs(answers: DataFrame, images: DataFrame, language: str = "en") -> DataFrame:
    """(doc_id, id, markdown, figure_mentions, image_ids, figure_note) of answers (doc_id, id, text, section_path, content).

    The text may be JSON with markdown, figureMentions (strings count) and figureNote.  Without mentions those in
    the section's content count.  Images (doc_id, id, ordinal, section_path, content) of the document meet them by
    number or section, two at most.  A note that is missing or blank is a stock one where there are images, else empty.
    """
    body = responses.json_or_inner(F.col("text"))
    listed = F.try_variant_get(body, "$.figureMentions", "array<variant>")
    told = F.transform(F.filter(listed, lambda m: F.schema_of_variant(m) == "STRING"), lambda m: F.try_variant_get(m, "$", "string"))
    note = F.try_variant_get(body, "$.figureNote", "variant")
    note = F.when(F.schema_of_variant(note) == "STRING", F.nullif(trim_all(F.try_variant_get(note, "$", "string")), F.lit("")))
    rows = answers.select("doc_id", "id", "content", F.array_join("section_path", " > ").alias("path"), responses.markdown_of(F.col("text")).alias("markdown"), F.coalesce(told, F.array().cast("array<string>")).alias("figure_mentions"), note.alias("note"))
    found = F.array_distinct(F.transform(F.regexp_extract_all("content", F.lit(FIGURE), F.lit(0)), lambda m: trim_all(F.regexp_replace(m, r"\s+", " "))))
    held = images.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "id", F.array_join("section_path", " > ").alias("path"), "content"))).alias("images"))
    rows = rows.join(held, "doc_id", "left").withColumn("sought", F.when(F.size("figure_mentions") > 0, F.col("figure_mentions")).otherwise(F.coalesce(found, F.array().cast("array<string>"))))
    ids = _image_ids(F.col("sought"), F.col("path"), F.coalesce("images", F.array().cast(held.schema["images"].dataType)))
    rows = rows.withColumn("image_ids", ids)
    stock = F.when(F.size("image_ids") > 0, FIGURE_NOTE[language]).otherwise("")
    return rows.select("doc_id", "id", block_body(F.col("markdown")).alias("markdown"), "figure_mentions", "image_ids", F.coalesce("note", stock).alias("figure_note"))


def needs_repair(answers: DataFrame, language: str = "en", least: int = 60) -> DataFrame:
    return answers.where(rules.is_insufficient(responses.markdown_of(F.col("text")), F.col("content"), language, least))


def import_id(url: Column, pdf_url: Column, paper_id: Column) -> Column:
    """The first of link, PDF link and id that holds an arXiv id; null means opening the link."""
    from lectern.functions.ids import arxiv_id

    return F.coalesce(arxiv_id(url), arxiv_id(pdf_url), arxiv_id(paper_id))


def tally(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def pointer_label(path: Column, excerpt: Column) -> Column:
    return F.coalesce(F.nullif(F.try_element_at(path, F.lit(-1)), F.lit("")), excerpt)
