"""Reports and notes: grouped rendering, and the managed block of a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import BLANKS, trim_all

# Order and titles of sections, and the report's title.
ORDER = ["abstract", "introduction", "related_work", "method", "experiment", "conclusion"]
LABELS = {"abstract": "Abstract", "introduction": "Introduction", "related_work": "Related Work", "method": "Method", "experiment": "Experiment", "conclusion": "Conclusion", "other": "Other"}
TITLE = "## AI 精读报告"
START, END = "<!-- lectern:summary:start -->", "<!-- lectern:summary:end -->"


def grouped(anchors: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, label, priority, first_pos, lines): anchors (by, pos, type, section_tag, heading_text, exact_text, link) by
    heading, else tag; fixed sections come first, then others as they appear."""
    key = F.coalesce("heading_text", "section_tag")
    line = F.concat(F.lit("- **["), "type", F.lit("]** "), "link", F.lit("  \n  "), "exact_text")
    rows = anchors.select(by, key.alias("key"), "pos", "section_tag", "heading_text", line.alias("line"))
    groups = rows.groupBy(by, "key").agg(F.min("pos").alias("first_pos"), F.min_by(F.struct("section_tag", "heading_text"), "pos").alias("f"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    priority = F.coalesce(*[F.when(F.col("f.section_tag") == t, i) for i, t in enumerate(ORDER)], F.lit(len(ORDER)))
    label = F.coalesce("f.heading_text", *[F.when(F.col("f.section_tag") == t, name) for t, name in LABELS.items()], F.lit("Other"))
    return groups.select(by, label.alias("label"), priority.alias("priority"), "first_pos", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("lines"))


def render_report(anchors: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, report)."""
    part = F.concat(F.lit("\n### "), "label", F.lit("\n"), "lines")
    parts = grouped(anchors, by).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("priority", "first_pos", part.alias("part")))).alias("ps"))
    return parts.select(by, F.concat(F.lit(f"\n---\n\n{TITLE}\n"), F.array_join(F.transform("ps", lambda x: x["part"]), "\n")).alias("report"))


def summary_block(content: Column, effort: Column, model: Column, generated: Column) -> Column:
    """The block between its markers; empty for blank content."""
    body = trim_all(content)
    named = F.coalesce(F.nullif(trim_all(model), F.lit("")), F.lit("unknown"))
    block = F.concat(F.lit(f"{START}\n## AI Summary\n- Effort: "), effort, F.lit("\n- Model: "), named, F.lit("\n- Generated: "), generated, F.lit("\n\n"), body, F.lit(f"\n{END}"))
    return F.when(body == "", "").otherwise(block)


def upsert_block(note: Column, block: Column) -> Column:
    """The note with its first managed block replaced by position, or the block at its end; as it is for an empty block."""
    b = F.instr(note, F.lit(START))
    e = F.call_function("locate", F.lit(END), note, F.greatest(b, F.lit(1)))
    there = (b > 0) & (e > 0)
    replaced = F.concat(F.substring(note, F.lit(1), b - 1), block, F.substring(note, e + len(END), F.char_length(note)))
    return F.when(block == "", note).when(there, replaced).otherwise(append_block(note, block))


def append_block(note: Column, block: Column, blanks: str = BLANKS) -> Column:
    """The note without the ``blanks`` at its end, an empty line and the block; the block alone if nothing is left."""
    rest = F.rtrim(note, F.lit(blanks))
    return F.when(rest == "", F.concat(block, F.lit("\n"))).otherwise(F.concat(rest, F.lit("\n\n"), block, F.lit("\n")))


def summary_source(title: str, chunks: DataFrame) -> DataFrame:
    """(doc_id, source): chunks (doc_id, pos, section_tag, heading_text, text) under their headings, after the title."""
    label = F.coalesce("heading_text", *[F.when(F.col("section_tag") == t, n) for t, n in LABELS.items()], F.lit("Other"))
    piece = F.concat(F.lit("### "), label, F.lit("\n"), "text")
    rows = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", piece.alias("t")))).alias("r"))
    return rows.select("doc_id", F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("r", lambda x: x["t"]), "\n\n")).alias("source"))
