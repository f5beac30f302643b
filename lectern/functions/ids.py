"""Paper identifiers, paths and record projection.  Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import collapse, trim_all

# Patterns of identifiers.
ARXIV_NEW = r"(\d{4}\.\d{4,6})"
ARXIV_OLD_URL = r"(?i)arxiv\.org/(?:abs|pdf)/([\w-]+/\d+)"
ARXIV_OLD = r"\A[\w-]+/\d+\z"
ARXIV_URL = r"(?i)arxiv\.org/(?:abs|pdf)/([\w-]+/\d+|\d{4}\.\d{4,6})"
ARXIV_LABELED = r"(?i)\barxiv\b\s*[:=]?\s*([\w-]+/\d+|\d{4}\.\d{4,6})"
DOI_URL = r"""(?i)https?://(?:dx\.)?doi\.org/([^\s<>"']+)"""
DOI_LABELED = r"""(?i)\bdoi\b\s*[:=]?\s*(10\.\d{4,9}/[^\s<>"']+)"""
DOI_BARE = r"""(?i)\b(10\.\d{4,9}/[^\s<>"']+)"""


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def arxiv_id(text: Column) -> Column:
    """The first new-style id anywhere (no version), else an old-style one in a URL or alone; else null."""
    return F.coalesce(_found(text, ARXIV_NEW), _found(text, ARXIV_OLD_URL), _found(text, ARXIV_OLD, 0))


def explicit_arxiv_id(text: Column) -> Column:
    """An id in a URL or after the word arXiv."""
    return F.coalesce(arxiv_id(_found(text, ARXIV_URL)), arxiv_id(_found(text, ARXIV_LABELED)))


def clean_doi(doi: Column) -> Column:
    return F.regexp_replace(trim_all(doi), r"[.,;]+\z", "")


def doi(text: Column) -> Column:
    """A DOI from a URL, else after the word doi, else bare; without trailing punctuation."""
    return clean_doi(F.coalesce(_found(text, DOI_URL), _found(text, DOI_LABELED), _found(text, DOI_BARE)))


def paper_identity(text: Column) -> Column:
    """struct(id, type): an explicit arXiv id, else a DOI, else any arXiv id; null without one."""

    def as_type(value: Column, kind: str) -> Column:
        return F.when(value.isNotNull(), F.struct(value.alias("id"), F.lit(kind).alias("type")))

    return F.coalesce(as_type(explicit_arxiv_id(text), "arxiv"), as_type(doi(text), "doi"), as_type(arxiv_id(text), "arxiv"))


def normalize_title(title: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]+", " "))


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\A/+|/+\z", "")


def within_folder(path: Column, folder: Column) -> Column:
    """Case-insensitive; every path is within the empty folder."""
    p, f = F.lower(normalize_path(path)), F.lower(normalize_path(folder))
    return (f == "") | (p == f) | p.startswith(F.concat(f, F.lit("/")))


def strip_wiki_link(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\A!?\[\[", ""), r"\]\]\z", "")


def names_pdf_path(value: Column, path: Column) -> Column:
    return F.lower(normalize_path(strip_wiki_link(value))) == F.lower(normalize_path(path))


def names_pdf_file(value: Column, name: Column) -> Column:
    return F.lower(trim_all(strip_wiki_link(value))) == F.lower(name)


def mentions_pdf(value: Column, path: Column, name: Column) -> Column:
    low = F.lower(value)
    return names_pdf_path(value, path) | names_pdf_file(value, name) | F.contains(low, F.concat(F.lit("[["), F.lower(name), F.lit("]]"))) | F.contains(low, F.lower(normalize_path(path)))


def source_keys(value: Column) -> Column:
    """The keys by which ``mentions_pdf`` finds a field's value: ``path:`` with the value and every stretch of it that ends
    in .pdf, and ``name:`` with the value and its wiki links."""
    low = F.lower(value)
    paths = F.array(F.lower(normalize_path(strip_wiki_link(value))))
    names = F.concat(F.array(F.lower(trim_all(strip_wiki_link(value)))), F.regexp_extract_all(low, F.lit(r"\[\[([^\[\]]*)\]\]"), 1))
    pieces = F.split(low, r"(?<=\.pdf)", -1)
    heads = F.transform(F.filter(pieces, lambda x: x.endswith(".pdf")), lambda x, i: F.array_join(F.slice(pieces, F.lit(1), i + 1), ""))
    ends = F.flatten(F.transform(heads, lambda x: F.transform(F.sequence(F.lit(1), F.char_length(x)), lambda i: F.substring(x, i, F.char_length(x)))))
    keys = F.concat(F.transform(F.concat(paths, ends), lambda x: F.concat(F.lit("path:"), x)), F.transform(names, lambda x: F.concat(F.lit("name:"), x)))
    return F.when(value.isNotNull(), F.array_distinct(keys))


def safe_file_name(title: Column) -> Column:
    return F.substring(collapse(F.regexp_replace(title, r'[\\/:*?"<>|#\n\r]', "-")), 1, 100)


def file_path(title: Column, folder: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(folder, r"/+\z", ""), F.lit("/"), safe_file_name(title), F.lit(f".{extension}"))


def graph_id(paper_id: Column) -> Column:
    """The identifier as the citation graph spells it."""
    return F.when(paper_id.startswith("arxiv:"), F.concat(F.lit("ArXiv:"), F.substring(paper_id, 7, 1 << 30))).when(paper_id.startswith("doi:"), F.concat(F.lit("DOI:"), F.substring(paper_id, 5, 1 << 30))).otherwise(paper_id)


def pdf_url(paper_id: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/pdf/"), paper_id)


def source_urls(paper_id: Column) -> Column:
    """Where the text of a paper may be read, by kind; the id is percent-encoded except in the PDF's."""
    coded = F.replace(F.url_encode(paper_id), F.lit("+"), F.lit("%20"))
    return F.struct(
        F.concat(F.lit("https://huggingface.co/papers/"), coded, F.lit(".md")).alias("markdown"), F.concat(F.lit("https://arxiv.org/html/"), coded).alias("html"),
        F.concat(F.lit("https://ar5iv.labs.arxiv.org/html/"), coded).alias("ar5iv"), pdf_url(paper_id).alias("pdf"),
    )


def graph_record(record: Column) -> Column:
    """A citation-graph record with sentinels for what it lacks and the best link: open PDF, arXiv, DOI, graph page."""
    empty = F.lit("")
    open_pdf = F.nullif(record["openAccessPdf"]["url"], empty)
    arxiv, doi_ = F.nullif(record["externalIds"]["ArXiv"], empty), F.nullif(record["externalIds"]["DOI"], empty)
    return F.struct(
        record["paperId"].alias("id"),
        F.coalesce(F.nullif(record["title"], empty), F.lit("Untitled")).alias("title"),
        F.coalesce(F.transform(record["authors"], lambda a: a["name"]), F.array().cast("array<string>")).alias("authors"),
        F.coalesce(record["year"], F.lit(0)).alias("year"),
        F.coalesce(record["abstract"], empty).alias("abstract"),
        F.coalesce(record["citationCount"], F.lit(0)).alias("citation_count"),
        F.coalesce(open_pdf, F.concat(F.lit("https://arxiv.org/abs/"), arxiv), F.concat(F.lit("https://doi.org/"), doi_), F.concat(F.lit("https://www.semanticscholar.org/paper/"), record["paperId"])).alias("url"),
        record["openAccessPdf"]["url"].alias("pdf_url"),
    )
