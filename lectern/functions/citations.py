"""Citation keys, BibTeX, IEEE and template formatting.  Records are columns of a DataFrame:
title, authors (array), year (0: unknown), arxiv_id, doi, venue, entry_type, url."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import trim_all

# Conference names by preset.
VENUES = {
    "neurips": "Advances in Neural Information Processing Systems",
    "icml": "Proceedings of the 40th International Conference on Machine Learning",
    "iclr": "International Conference on Learning Representations",
    "cvpr": "Proceedings of the IEEE/CVF Conference on Computer Vision and Pattern Recognition",
    "eccv": "European Conference on Computer Vision",
    "iccv": "Proceedings of the IEEE/CVF International Conference on Computer Vision",
    "aaai": "Proceedings of the AAAI Conference on Artificial Intelligence",
    "acl": "Proceedings of the 61st Annual Meeting of the Association for Computational Linguistics",
    "emnlp": "Proceedings of the 2024 Conference on Empirical Methods in Natural Language Processing",
    "naacl": "Proceedings of the 2024 Conference of the North American Chapter of the Association for Computational Linguistics",
    "kdd": "Proceedings of the 30th ACM SIGKDD Conference on Knowledge Discovery and Data Mining",
}
# Words that no key is made of.
KEY_STOP_WORDS = ["the", "and", "for", "with", "from", "are", "has"]


def _words(text: Column) -> Column:
    return F.split(trim_all(text), r"\s+")


def cite_key(title: Column, authors: Column, year: Column) -> Column:
    """First author's last name, the year, and the first telling word of the title."""
    author = F.coalesce(F.get(authors, F.lit(0)), F.lit("unknown"))
    last = F.regexp_replace(F.lower(F.element_at(_words(author), -1)), "[^a-z]", "")
    telling = F.filter(F.split(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: (F.char_length(w) > 2) & ~w.isin(*KEY_STOP_WORDS))
    return F.concat(last, F.when(year > 0, year.cast("string")).otherwise("0000"), F.coalesce(F.get(telling, F.lit(0)), F.lit("paper")))


def entry_type(explicit: Column, venue: Column, doi: Column) -> Column:
    empty = F.lit("")
    return F.when(F.coalesce(explicit, empty) != "", explicit).when(F.coalesce(venue, empty) != "", "inproceedings").when(F.coalesce(doi, empty) != "", "article").otherwise("misc")


def escape_bibtex(text: Column) -> Column:
    """The braces that a backslash brings are escaped as well, as the format's readers expect of this exporter."""
    text = F.replace(text, F.lit("\\"), F.lit("\\textbackslash{}"))
    text = F.regexp_replace(text, r"([&%$#_{}])", r"\\$1")
    return F.replace(F.replace(text, F.lit("~"), F.lit("\\textasciitilde{}")), F.lit("^"), F.lit("\\textasciicircum{}"))


def bibtex(preset: Column | None = None) -> Column:
    """The BibTeX entry of a record; a preset sets type and book title."""
    c, empty = F.col, F.lit("")
    book = F.lit(None).cast("string")
    if preset is not None:
        book = F.coalesce(*[F.when(preset == k, v) for k, v in VENUES.items()])
    kind = F.when(book.isNotNull(), "inproceedings").otherwise(entry_type(c("entry_type"), c("venue"), c("doi")))

    def field(name: str, value: Column, shown: Column) -> Column:
        return F.when(shown, F.concat(F.lit(f"  {name} = {{"), value, F.lit("},")))

    def has(x: Column) -> Column:
        return F.coalesce(x, empty) != ""

    where = F.coalesce(book, c("venue"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("@"), kind, F.lit("{"), cite_key(c("title"), c("authors"), c("year")), F.lit(",")),
        field("title    ", escape_bibtex(c("title")), F.lit(True)),
        field("author   ", F.array_join(F.transform(c("authors"), escape_bibtex), " and "), F.size("authors") > 0),
        field("year     ", c("year").cast("string"), c("year") > 0),
        field("booktitle", escape_bibtex(where), (kind == "inproceedings") & has(where)),
        field("journal  ", escape_bibtex(c("venue")), (kind == "article") & has(c("venue"))),
        field("howpublished", F.concat(F.lit("arXiv preprint arXiv:"), c("arxiv_id")), ~kind.isin("inproceedings", "article") & has(c("arxiv_id"))),
        field("doi      ", c("doi"), has(c("doi"))),
        field("url      ", c("url"), has(c("url"))),
        F.lit("}"),
    )


def abbreviate(name: Column) -> Column:
    """Initials and last name; a single name stays."""
    parts = _words(name)
    initials = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit(".")))
    return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.concat(F.array_join(initials, " "), F.lit(" "), F.element_at(parts, -1)))


def ieee(number: Column) -> Column:
    c = F.col
    authors = (
        F.when(F.size("authors") == 0, "Unknown").when(F.size("authors") > 3, F.concat(abbreviate(F.get(c("authors"), F.lit(0))), F.lit(" et al.")))
        .otherwise(F.array_join(F.transform(c("authors"), abbreviate), ", "))
    )
    venue = F.coalesce(c("venue"), F.when(F.coalesce(c("arxiv_id"), F.lit("")) != "", F.concat(F.lit("arXiv:"), c("arxiv_id"))), F.lit(""))
    return F.concat(
        F.lit("["), number.cast("string"), F.lit("] "), authors, F.lit(', "'), c("title"), F.lit('"'),
        F.when(venue != "", F.concat(F.lit(", in *"), venue, F.lit("*"))).otherwise(""), F.lit(", "),
        F.when(c("year") > 0, c("year").cast("string")).otherwise("n.d."), F.when(F.coalesce(c("doi"), F.lit("")) != "", F.concat(F.lit(". doi: "), c("doi"))).otherwise(""), F.lit("."),
    )


def fill_template(template: Column, values: dict[str, Column], opening: str, closing: str) -> Column:
    """Known placeholders are replaced by position, in one pass over the template's pieces; others stay."""
    keys = "|".join(values)
    pattern = f"{opening}({keys}){closing}"
    texts, names = F.split(template, pattern), F.regexp_extract_all(template, F.lit(pattern), 1)
    known = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))])
    filled = F.transform(names, lambda k: known[k])
    return F.array_join(F.transform(texts, lambda t, i: F.concat(t, F.coalesce(F.get(filled, i), F.lit("")))), "")


def custom(template: Column) -> Column:
    c = F.col
    values = {"title": c("title"), "authors": F.array_join("authors", ", "), "year": F.when(c("year") > 0, c("year").cast("string")), "doi": c("doi"), "arxiv_id": c("arxiv_id"), "url": c("url"), "venue": c("venue")}
    return fill_template(template, values, r"\{", r"\}")


# The note that a blank template stands for.
NOTE_TEMPLATE = """
---
arxiv_id: "{{arxiv_id}}"
title: "{{title_frontmatter}}"
published: "{{published}}"
pdf_file: "[[{{pdf_file}}]]"
tags:
  - summary
type:
  - paper
---
"""


def note_from_template(template: Column, pdf_name: Column) -> Column:
    """A note for columns id, title, authors, published, abstract; a blank or null template is NOTE_TEMPLATE."""
    c = F.col
    template = F.when(trim_all(F.coalesce(template, F.lit(""))) == "", NOTE_TEMPLATE).otherwise(template)
    quoted = F.replace(c("title"), F.lit('"'), F.lit("'"))
    authors = F.array_join(F.transform(c("authors"), lambda a: F.concat(F.lit('  - "'), F.replace(a, F.lit('"'), F.lit("'")), F.lit('"'))), "\n")
    values = {"arxiv_id": c("id"), "title_frontmatter": quoted, "title": c("title"), "authors_yaml": authors, "published": c("published"), "abstract": trim_all(F.regexp_replace(c("abstract"), r"\n+", " ")), "pdf_file": pdf_name}
    return fill_template(template, values, r"\{\{", r"\}\}")


def export_lines(records: DataFrame) -> DataFrame:
    """(pos, line): each formatted record (pos, entry, missing array), after a warning where fields are missing."""
    line = F.when(F.size("missing") > 0, F.concat(F.lit("% missing: "), F.array_join("missing", ", "), F.lit("\n"), F.col("entry"))).otherwise(F.col("entry"))
    return records.select("pos", line.alias("line"))


def export_text(records: DataFrame) -> DataFrame:
    """One row: the lines in order, parted by empty lines.  For what a user puts on a clipboard; a whole corpus is
    written from ``export_lines``."""
    ordered = export_lines(records).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    return ordered.select(F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n").alias("output"))
