"""Markdown documents: sections by heading, and pointers to sections, paragraphs, formulas and images.

A text is cut at its heading lines, and a section at every match of what is looked for, into rows of
(what lies before, match).  Sums of their lengths over windows give offsets and lines, so nothing is
scanned by hand.  Offsets count code points of the text with unix lines and trimmed ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.rules import is_trivial_formula
from lectern.functions.text import BLANKS, collapse, excerpt, fnv1a, normalize_heading, shorten, strip_markdown_inline, trim_all, unix_lines
from lectern.operators.steps import settled

# Patterns of Markdown.
HEADING = r"(?dm)^#{1,6}[^\S\n]+[^\n]*"
IMAGE = r'!\[([^\]]*)\]\([^\s)]+(?:\s+"[^"]*")?\)'
DISPLAY = [r"\$\$[\s\S]+?\$\$", r"\\\[[\s\S]+?\\\]", r"\\begin\{equation\*?\}[\s\S]+?\\end\{equation\*?\}"]
LEVELS = 6
INLINE = r"\$(?!\$)([^$\n]{2,}?)\$"
LONE_IMAGE, LONE_DISPLAY = r"\A!\[[^\]]*\]\([^)]*\)\z", r"\A\$\$[\s\S]*\$\$\z"
FIGURE_WORD = r"(?i)\A(figure|fig\.?|table|图|表)"

KINDS = ["section", "paragraph", "formula", "image"]


def newlines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def _pieces(text: Column, pattern: str, mark: str) -> Column:
    """An array of (before, match): what lies before each match, and the match; every match begins with ``mark``.  The text
    is scanned from its first mark on, once for each of both, however many matches there are."""
    head = F.substring_index(text, mark, 1)
    rest = F.substring(text, F.char_length(head) + 1, F.char_length(text))
    pairs = F.filter(F.arrays_zip(F.split(rest, pattern, -1).alias("before"), F.regexp_extract_all(rest, F.lit(pattern), 0).alias("match")), lambda p: p["match"].isNotNull())
    found = F.transform(pairs, lambda p, i: F.struct(F.when(i == 0, F.concat(head, p["before"])).otherwise(p["before"]).alias("before"), p["match"].alias("match")))
    return F.when(F.contains(text, F.lit(mark)), found).otherwise(F.array().cast("array<struct<before:string,match:string>>"))


def _section_rows(docs: DataFrame) -> DataFrame:
    """Sections with a number ``rid`` for the row of ``docs`` that they are from."""
    body = trim_all(unix_lines(F.coalesce("markdown", F.lit(""))))
    rows = settled(docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "markdown"), {"body": body}).drop("markdown").where("body <> ''")
    rows = settled(rows, {"gaps": F.split("body", HEADING, -1), "heads": F.concat(F.array(F.lit("")), F.regexp_extract_all("body", F.lit(HEADING), 0))})
    bare = trim_all(F.array_join("gaps", "")) == ""  # headings only: one section, of all
    cut = F.arrays_zip(F.col("heads").alias("head"), F.col("gaps").alias("text"))
    rows = settled(rows, {"cut": F.when(bare, F.array(F.struct(F.lit("").alias("head"), F.col("body").alias("text")))).otherwise(cut)})
    rows = rows.select("doc_id", "rid", F.posexplode("cut").alias("i", "p"))
    level, title = F.char_length(F.regexp_extract("p.head", r"\A#*", 0)), strip_markdown_inline(F.regexp_replace("p.head", r"\A#+\s+", ""))
    rows = rows.select("doc_id", "rid", "i", "p.head", "p.text", F.when(F.col("i") == 0, 1).otherwise(level).alias("level"), F.when(F.col("i") == 0, "Document").otherwise(title).alias("heading"))
    # a heading without text opens no section: its line goes
    rows = rows.withColumn("opens", F.col("heading") != "").withColumn("kept", F.when(F.col("opens"), F.col("text")).otherwise(F.regexp_replace("text", r"\A\n", "")))
    upto = W.partitionBy("rid").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select(
        "*", F.sum(F.col("opens").cast("int")).over(upto).alias("section"),
        (F.sum(F.char_length("head") + F.char_length("text")).over(upto) - F.char_length("text")).alias("at"), (F.sum(newlines(F.col("text"))).over(upto) - newlines(F.col("text"))).alias("line"),
    )
    # a title is at most one deeper than the one before and as deep as its level, so its depth is a running least value; the
    # path to a title is, for each depth up to its own, the last title of that depth
    deep = F.col("section") + F.least(F.lit(0), F.min(F.when(F.col("opens"), F.col("level") - F.col("section"))).over(upto))
    rows = rows.withColumn("deep", deep.cast("int"))
    trail = [F.last(F.when(F.col("opens") & (F.col("deep") == k), F.col("heading")), ignorenulls=True).over(upto).alias(f"t{k}") for k in range(1, LEVELS + 1)]
    path = F.slice(F.array(*[f"t{k}" for k in range(1, LEVELS + 1)]), F.lit(1), F.col("deep"))
    rows = rows.select("*", *trail).withColumn("path", path)
    first = F.min(F.struct("i", "heading", "level", "path", "at", "line")).alias("f")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "kept"))), lambda x: x["kept"]), "")
    found = rows.groupBy("doc_id", "rid", "section").agg(first, whole.alias("raw")).withColumn("content", trim_all(F.col("raw"))).where("content <> ''")
    bare = F.ltrim("raw", F.lit(BLANKS))
    lead, lead_lines = F.char_length("raw") - F.char_length(bare), newlines(F.col("raw")) - newlines(bare)
    found = found.select("doc_id", "rid", "section", "f.heading", "f.level", "f.path", "content", (F.col("f.line") + 1 + lead_lines).cast("int").alias("line_start"), (F.col("f.at") + lead).cast("int").alias("char_start"))
    return found.withColumn("pos", F.row_number().over(W.partitionBy("rid").orderBy("section")) - 1)


def sections(docs: DataFrame) -> DataFrame:
    """Sections of docs (doc_id, markdown): doc_id, pos, heading, level, path, normalized_heading, content, line_start,
    line_end, char_start, char_end.

    Text before the first heading belongs to ``Document``; sections without content are left out, but a text of
    headings only is one section.  A heading's path keeps as many entries as its level is deep, less one.
    Null and empty texts have none.
    """
    c = F.col
    return _section_rows(docs).select(
        "doc_id", "pos", "heading", "level", "path", normalize_heading(c("heading")).alias("normalized_heading"), "content", "line_start", (c("line_start") + newlines(c("content"))).alias("line_end"),
        "char_start", (c("char_start") + F.char_length("content")).alias("char_end"),
    )


def _with_captions(rows: DataFrame) -> DataFrame:
    """rows (kind, match, around, b, e, …) with caption, of images: from the paragraph after if it names a figure or has
    12 characters, from the one before, or the alternative text.  Each step is a column of its own, as it is used often."""
    c = F.col
    after = F.element_at(F.split(F.regexp_replace(F.substring(c("around"), (c("e") + 1).cast("int"), F.char_length("around")), r"\A\n+", ""), r"\n\s*\n", -1), 1)
    before = F.element_at(F.split(F.regexp_replace(F.substring(c("around"), F.lit(1), c("b").cast("int")), r"\n+\z", ""), r"\n\s*\n", -1), -1)
    rows = rows.withColumns({"after": trim_all(after), "before": trim_all(before)})
    rows = rows.withColumns({f"{x}_flat": collapse(strip_markdown_inline(c(x))) for x in ("after", "before")})
    rows = rows.withColumns({f"{x}_sentence": F.regexp_extract(f"{x}_flat", r"\A(.+?[.!?。！？])(?:\s|\z)", 1) for x in ("after", "before")})
    rows = rows.withColumns({f"{x}_snippet": shorten(F.when(c(f"{x}_sentence") != "", c(f"{x}_sentence")).otherwise(c(f"{x}_flat"))) for x in ("after", "before")})
    telling = (c("after_snippet") != "") & ~c("after").startswith("![") & (c("after_snippet").rlike(FIGURE_WORD) | (F.char_length("after_snippet") >= 12))
    told = F.when(telling, c("after_snippet")).when((F.char_length("before_snippet") >= 12) & ~c("before").startswith("!["), c("before_snippet")).otherwise(trim_all(F.regexp_extract("match", IMAGE, 1)))
    return rows.withColumn("caption", F.when(c("kind") == "image", F.nullif(told, F.lit(""))))


def pointers(docs: DataFrame) -> DataFrame:
    """Pointers to the sections, paragraphs, formulas and images of docs (doc_id, markdown): doc_id, id, kind, ordinal,
    section_path, excerpt, line_start, line_end, char_start, char_end, content_hash, content.

    Paragraphs are parted by an empty line; those that are an image or a display formula only are left out.  Inline
    formulas within a display formula, and trivial ones, are left out.  Ordinals count by document and kind.
    """
    content = F.col("content")
    blocks = F.transform(F.split(content, "\n\n", -1), lambda x, i: F.struct(F.when(i > 0, "\n\n").otherwise("").alias("before"), x.alias("match")))
    scans = [("section", F.array(F.struct(F.lit("").alias("before"), content.alias("match")))), ("paragraph", blocks)]
    scans += [("formula", _pieces(content, p, m)) for p, m in zip([*DISPLAY, INLINE], ["$$", "\\[", "\\begin{equation", "$"], strict=True)] + [("image", _pieces(content, IMAGE, "!["))]
    inline = 2 + len(DISPLAY)

    def tagged(scan: int, kind: str, pieces: Column) -> Column:
        around = content if kind == "image" else F.lit(None).cast("string")
        return F.transform(pieces, lambda p, j: F.struct(F.lit(scan).alias("scan"), F.lit(kind).alias("kind"), j.alias("j"), p["before"].alias("before"), p["match"].alias("match"), around.alias("around")))

    rows = settled(_section_rows(docs), {"found": F.concat(*[tagged(i, k, p) for i, (k, p) in enumerate(scans)])})
    rows = rows.select("doc_id", "rid", "pos", "path", "line_start", "char_start", F.explode("found").alias("t"))
    rows = rows.select("doc_id", "rid", "pos", "path", "line_start", "char_start", "t.*")
    upto = W.partitionBy("rid", "pos", "scan").orderBy("j").rowsBetween(W.unboundedPreceding, 0)
    bare = F.ltrim("match", F.lit(BLANKS))  # paragraphs have blanks at their ends, the others none
    own, own_lines = F.char_length(bare), newlines(bare)
    rows = rows.select(
        "doc_id", "rid", "pos", "path", "line_start", "char_start", "scan", "kind", "j", "around", trim_all(F.col("match")).alias("match"), own.alias("own"), own_lines.alias("own_lines"),
        (F.char_length("before") + F.char_length("match")).alias("n"), (newlines(F.col("before")) + newlines(F.col("match"))).alias("n_lines"),
    )
    rows = rows.select("*", (F.sum("n").over(upto) - F.col("own")).alias("b"), (F.sum("n_lines").over(upto) - F.col("own_lines")).alias("line"))
    rows = rows.withColumn("e", F.col("b") + F.char_length("match"))
    display = F.when((F.col("scan") > 1) & (F.col("scan") < inline), F.col("e"))
    within = F.coalesce(F.max(display).over(W.partitionBy("rid", "pos").orderBy("b")) >= F.col("e"), F.lit(False))  # of those that begin here or before
    lone = (F.col("match").startswith("![") & F.col("match").rlike(LONE_IMAGE)) | (F.col("match").startswith("$$") & F.col("match").rlike(LONE_DISPLAY))
    rows = rows.withColumn("within", within).where((F.col("match") != "") & ~((F.col("scan") == inline) & F.col("within")) & ~((F.col("kind") == "paragraph") & lone))
    rows = rows.where((F.col("kind") != "formula") | ~is_trivial_formula(F.col("match")))
    rows = rows.withColumn("ordinal", F.row_number().over(W.partitionBy("rid", "kind").orderBy("pos", "b", "scan")))
    rows = _with_captions(rows).withColumn("shown", F.coalesce("caption", "match"))
    digest = fnv1a(F.concat("kind", F.lit("\n"), F.array_join("path", " > "), F.lit("\n"), "match"))
    c = F.col
    return rows.withColumn("content_hash", digest).select(
        "doc_id", F.concat("kind", F.lit(":"), c("ordinal").cast("string"), F.lit(":"), "content_hash").alias("id"), "kind", "ordinal", c("path").alias("section_path"), excerpt(F.col("shown")).alias("excerpt"),
        (c("line_start") + c("line")).cast("int").alias("line_start"), (c("line_start") + c("line") + newlines(c("match"))).cast("int").alias("line_end"),
        (c("char_start") + c("b")).cast("int").alias("char_start"), (c("char_start") + c("e")).cast("int").alias("char_end"), "content_hash", c("match").alias("content"),
    )
