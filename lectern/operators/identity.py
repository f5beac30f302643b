"""Resolving papers from notes and PDFs, and linking PDFs to notes.

Notes are rows (path, name, basename, ext, frontmatter, body, inline_tags), frontmatter a map of strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import ids
from lectern.functions.text import collapse, trim_all
from lectern.operators.steps import settled

ARXIV_ALIASES = ["arxiv_id", "arxiv", "arXiv"]
DOI_ALIASES = ["doi", "DOI"]
BODY_CHARS, PREVIEW_CHARS, PREVIEW_PAGES = 8000, 1200, 3


def field(name: str, frontmatter: str = "frontmatter") -> Column:
    """The trimmed value of a key in any case; null if it is missing or blank."""
    hit = F.map_values(F.map_filter(F.coalesce(frontmatter, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k) == name.lower()))
    return F.nullif(trim_all(F.get(hit, F.lit(0))), F.lit(""))


def _key(name: str) -> Column:
    keys = F.filter(F.map_keys(F.col("frontmatter")), lambda k: F.lower(k) == name.lower())
    return F.get(keys, F.lit(0))


def frontmatter_identity(arxiv_aliases: list[str] = ARXIV_ALIASES, doi_aliases: list[str] = DOI_ALIASES) -> Column:
    """struct(id, type, matched_field): arXiv aliases in order, then DOI aliases, then the field source."""

    def hit(value: Column, kind: str, key: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(value.alias("id"), F.lit(kind).alias("type"), key.alias("matched_field")))

    tries = [hit(ids.arxiv_id(field(a)), "arxiv", _key(a)) for a in arxiv_aliases] + [hit(ids.doi(field(a)), "doi", _key(a)) for a in doi_aliases]
    tries += [hit(ids.arxiv_id(field("source")), "arxiv", F.lit("source")), hit(ids.doi(field("source")), "doi", F.lit("source"))]
    return F.coalesce(*tries)


def note_query() -> Column:
    """What a note's paper is looked for by: its name, title and abstract."""
    return trim_all(F.concat_ws(" ", "basename", field("title"), field("abstract")))


def resolve_notes(notes: DataFrame) -> DataFrame:
    """(path, id, type, matched_field, resolution_source, query_text): by frontmatter, else by the body's first 8000
    characters; notes without an identity are left out."""
    own = settled(notes, {"fm": frontmatter_identity(), "head": F.substring(F.coalesce("body", F.lit("")), 1, BODY_CHARS)})
    own = settled(own, {"txt": F.when(F.col("fm").isNull(), ids.paper_identity(F.col("head")))})  # only sought where it counts
    query = note_query()
    return own.where("fm is not null or txt is not null").select(
        "path", F.coalesce("fm.id", "txt.id").alias("id"), F.coalesce("fm.type", "txt.type").alias("type"), F.col("fm.matched_field").alias("matched_field"),
        F.when(F.col("fm").isNotNull(), "frontmatter").otherwise("note-text").alias("resolution_source"), query.alias("query_text"),
    )


def _tagged(tier: int, keys: Column) -> Column:
    """The keys, each once, with the rule that they are for."""
    return F.transform(F.array_distinct(F.array_compact(F.coalesce(keys, F.array().cast("array<string>")))), lambda k: F.struct(F.lit(tier).alias("tier"), k.alias("k")))


def link_pdfs(pdfs: DataFrame, notes: DataFrame, folder: str = "") -> DataFrame:
    """(pdf_path, note_path, tier): rules in order (path, name, source, file title, title); a rule counts only where it
    finds exactly one note, and the first that does wins.

    Every rule is an equi-join on a normalised key, of which each note has one, or, for the field source, those of
    all file names and paths that end in it.  Notes are counted by key before they meet PDFs; empty keys meet none.
    A file makes several keys, of which the plan knows no size, so joins are shuffled and neither side is broadcast.
    """
    n = notes.where(ids.within_folder(F.col("path"), F.lit(folder))).select("path", "basename", field("pdf_file").alias("pdf_file"), field("source").alias("source"), field("title").alias("title"))
    p = pdfs.select(F.col("path").alias("pdf_path"), "name", F.col("basename").alias("pdf_base"))
    as_path, as_name = (lambda x: F.lower(ids.normalize_path(ids.strip_wiki_link(x)))), (lambda x: F.lower(trim_all(ids.strip_wiki_link(x))))
    path_key, name_key, title_key = F.lower(ids.normalize_path(F.col("pdf_path"))), F.lower(F.col("name")), ids.normalize_title(F.col("pdf_base"))
    source_keys = ids.source_keys(F.col("source"))
    keys = [
        (1, path_key, F.array(as_path(F.col("pdf_file")))), (2, name_key, F.array(as_name(F.col("pdf_file")))), (3, F.concat(F.lit("path:"), path_key), source_keys), (3, F.concat(F.lit("name:"), name_key), source_keys),
        (4, title_key, F.array(ids.normalize_title(F.col("basename")))), (5, title_key, F.array(ids.normalize_title(F.col("title")))),
    ]
    asked = p.select("pdf_path", F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), k.alias("k")) for t, k, _ in keys])).alias("x")).select("pdf_path", "x.*").where("k <> ''")
    offered = {t: k for t, _, k in keys}  # rule 3 has both its forms in one array
    have = n.select(F.col("path").alias("note_path"), F.explode(F.concat(*[_tagged(t, k) for t, k in offered.items()])).alias("x")).select("note_path", "x.*")
    counted = have.where("k <> ''").groupBy("tier", "k").agg(F.count_distinct("note_path").alias("n"), F.min("note_path").alias("least"), F.max("note_path").alias("most"))
    hits = asked.hint("merge").join(counted, ["tier", "k"]).groupBy("pdf_path", "tier").agg(F.max("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    single = hits.where("n = 1 and least = most")
    return single.groupBy("pdf_path").agg(F.min_by("least", "tier").alias("note_path"), F.min("tier").alias("tier"))


def resolve_pdfs(pdfs: DataFrame, notes: DataFrame, folder: str = "") -> DataFrame:
    """(path, id, type, resolution_source, related_note, query_text) of pdfs (path, name, basename, preview): the linked
    note's identity, else what the first pages' text tells; PDFs without either are left out.

    A linked note without an identity is related all the same, and its text is the query.
    """
    own = notes.select(F.col("path").alias("note_path"), note_query().alias("n_query"))
    known = resolve_notes(notes).select(F.col("path").alias("known_path"), F.col("id").alias("n_id"), F.col("type").alias("n_type"))
    linked = link_pdfs(pdfs, notes, folder).hint("merge").join(own, "note_path").join(known.hint("merge"), F.col("note_path") == F.col("known_path"), "left")
    out = pdfs.join(linked.select("pdf_path", "note_path", "n_id", "n_type", "n_query").hint("merge"), F.col("path") == F.col("pdf_path"), "left").withColumn("txt", ids.paper_identity(F.coalesce("preview", F.lit(""))))
    pdf_query = trim_all(F.concat_ws(" ", "basename", F.substring(collapse(F.coalesce("preview", F.lit(""))), 1, PREVIEW_CHARS)))
    return out.where("n_id is not null or txt is not null").select(
        "path", F.coalesce("n_id", "txt.id").alias("id"), F.coalesce("n_type", "txt.type").alias("type"), F.when(F.col("n_id").isNotNull(), "linked-note").otherwise("pdf-text").alias("resolution_source"),
        F.col("note_path").alias("related_note"), F.coalesce(F.nullif("n_query", F.lit("")), pdf_query).alias("query_text"),
    )


def note_arxiv_id() -> Column:
    """From the fields arxiv_id, arxiv, source (in this case only), else from the file's name."""
    return F.coalesce(*[ids.arxiv_id(F.col("frontmatter")[k]) for k in ("arxiv_id", "arxiv", "source")], ids.arxiv_id(F.col("basename")))


def normalize_tag(tag: Column) -> Column:
    return F.lower(trim_all(F.regexp_replace(trim_all(tag), r"\A#+", "")))


def note_tags() -> Column:
    """Normalised tags from frontmatter (a comma-separated string) and the text."""
    fm = F.split(F.coalesce(field("tags"), F.lit("")), ",")
    return F.array_distinct(F.filter(F.transform(F.concat(fm, F.coalesce("inline_tags", F.array().cast("array<string>"))), normalize_tag), lambda t: t != ""))


def tagged(notes: DataFrame, tag: str) -> DataFrame:
    return notes.where(F.array_contains(note_tags(), normalize_tag(F.lit(tag))))


def tag_histogram(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode(note_tags()).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def citation_records(notes: DataFrame, arxiv_meta: DataFrame | None = None) -> DataFrame:
    """Records of notes that have an arXiv id or a DOI; ``arxiv_meta`` (arxiv_id, m_authors, m_published) fills in authors
    and year where a note has no authors."""
    fm = lambda k: F.nullif(trim_all(F.col("frontmatter")[k]), F.lit(""))
    year_of = lambda x: F.nullif(F.regexp_extract(x, r"(\d{4})", 1), F.lit("")).cast("int")
    rows = notes.select(
        "path", F.coalesce(fm("title"), "basename").alias("title"),
        F.filter(F.transform(F.split(F.coalesce(fm("authors"), F.lit("")), r",(?![^(]*\))"), trim_all), lambda a: a != "").alias("authors"),
        F.coalesce(F.when(fm("year").rlike(r"\A\d{4}\z"), fm("year").try_cast("int")), year_of(F.coalesce(fm("published"), fm("date"))), F.lit(0)).alias("year"),
        F.coalesce(*[fm(a) for a in ARXIV_ALIASES]).alias("arxiv_id"), F.coalesce(*[fm(a) for a in DOI_ALIASES]).alias("doi"),
        F.coalesce(fm("venue"), fm("booktitle"), fm("journal")).alias("venue"), fm("url").alias("own_url"), F.lit(None).cast("string").alias("entry_type"),
    ).where("arxiv_id is not null or doi is not null")
    if arxiv_meta is not None:
        rows = rows.join(arxiv_meta, "arxiv_id", "left")
        bare = F.size("authors") == 0
        rows = rows.withColumn("year", F.when(bare & (F.col("year") == 0), F.coalesce(year_of(F.col("m_published")), F.lit(0))).otherwise(F.col("year")))
        rows = rows.withColumn("authors", F.when(bare, F.coalesce("m_authors", F.array().cast("array<string>"))).otherwise(F.col("authors"))).drop("m_authors", "m_published")
    url = F.coalesce("own_url", F.concat(F.lit("https://doi.org/"), "doi"), F.concat(F.lit("https://arxiv.org/abs/"), "arxiv_id"))
    missing = F.array_compact(F.array(F.when(F.col("year") == 0, "year"), F.when(F.size("authors") == 0, "authors")))
    return rows.withColumn("url", url).withColumn("missing", missing).drop("own_url")


def is_graph_file(path: Column) -> Column:
    """Whether a file may stand for a paper: a note or a PDF."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1)).isin("md", "pdf")


def pdf_candidates(notes: DataFrame, pdfs: DataFrame, folder: str) -> DataFrame:
    """(note_path, pdf_path, priority) of notes (…, path, basename, frontmatter, body) and pdfs (path, name) that there are.

    A note's candidates in order: its field pdf_file, its first embedded PDF, and the PDF of its own name in ``folder``.
    Each may be a path, else the name of a file anywhere (the shortest path counts), else a name in ``folder``.
    """
    embedded = F.get(F.filter(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"!\[\[([^\]]*)\]\]"), 1), lambda x: F.lower(trim_all(F.split(x, r"\|")[0])).endswith(".pdf")), F.lit(0))
    base = ids.normalize_path(F.lit(folder))
    own = F.concat(base, F.lit("/"), "basename", F.lit(".pdf"))
    tries = F.array(*[F.struct(F.lit(i).alias("n"), c.alias("c")) for i, c in enumerate((field("pdf_file"), embedded, own))])
    clean = trim_all(F.split(ids.strip_wiki_link(trim_all(F.col("t.c"))), r"\|")[0])
    links = notes.select(F.col("path").alias("note_path"), F.explode(tries).alias("t")).select("note_path", "t.n", clean.alias("link")).where("link <> ''")
    paths = pdfs.where(F.lower("path").endswith(".pdf")).select(F.col("path").alias("pdf_path"), "name").distinct()
    direct = links.join(paths, F.col("link") == F.col("pdf_path")).select("note_path", "pdf_path", (F.col("n") * 3).alias("priority"))
    shortest = paths.groupBy("name").agg(F.min_by("pdf_path", F.struct(F.char_length("pdf_path"), "pdf_path")).alias("pdf_path"))
    named = links.join(shortest, F.col("link") == F.col("name")).select("note_path", "pdf_path", (F.col("n") * 3 + 1).alias("priority"))
    attached = links.where(~F.contains("link", F.lit("/"))).withColumn("link", F.concat(base, F.lit("/"), "link"))
    attached = attached.join(paths, F.col("link") == F.col("pdf_path")).select("note_path", "pdf_path", (F.col("n") * 3 + 2).alias("priority"))
    return direct.unionByName(named).unionByName(attached)


def summary_pdf(candidates: DataFrame) -> DataFrame:
    """(note_path, pdf_path): of candidates (note_path, pdf_path, priority) that exist, the one of least priority."""
    return candidates.groupBy("note_path").agg(F.min_by("pdf_path", F.struct("priority", "pdf_path")).alias("pdf_path"))


# The kinds of source in order, with their names.
SOURCES = [("huggingface-markdown", "Hugging Face paper markdown"), ("arxiv-html", "arXiv HTML"), ("ar5iv-html", "ar5iv HTML"), ("jina-reader", "Jina Reader"), ("pdf", "PDF parser")]


def first_source(attempts: DataFrame) -> DataFrame:
    """(paper_id, kind, text): of attempts (paper_id, priority, kind, status, text) the first that has text."""
    good = attempts.where((F.col("status") == 200) & (trim_all(F.coalesce("text", F.lit(""))) != ""))
    return good.groupBy("paper_id").agg(F.min_by(F.struct("kind", "text"), "priority").alias("s")).select("paper_id", "s.kind", "s.text")


def source_bundle(papers: DataFrame, responses: DataFrame, prefer_markdown: bool = True) -> DataFrame:
    """(paper_id, kind, label, text, attempts): the first source in order that has text, and what became of each.

    papers (paper_id, arxiv_id, pdf_text); responses (paper_id, kind, status, text) of the remote sources, at most one
    for a paper and kind.  404 and blank text are ``skipped``, other answers but 200 an ``error``.  The first kind is
    tried before all others, and only if preferred; all remote others at once; the PDF's text only if none has any.
    """
    order = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(k).alias("kind"), F.lit(n).alias("label")) for i, (k, n) in enumerate(SOURCES)])
    first, last = SOURCES[0][0], SOURCES[-1][0]
    grid = papers.select("paper_id", "arxiv_id", "pdf_text", F.explode(order).alias("s")).select("paper_id", "arxiv_id", "pdf_text", "s.*")
    got = grid.join(responses.select("paper_id", "kind", "status", F.col("text").alias("answer")), ["paper_id", "kind"], "left")
    wanted = F.col("arxiv_id").isNotNull() & (F.lit(prefer_markdown) | (F.col("kind") != first))
    body = trim_all(F.coalesce("answer", F.lit("")))
    text = F.when(F.col("kind") == last, F.coalesce("pdf_text", F.lit(""))).when(wanted & (F.col("status") == 200) & (body != ""), body)
    missing = F.when(F.col("kind") == first, "Markdown page not found").otherwise("Source not available")
    failed = wanted & F.col("status").isNotNull() & ~F.col("status").isin(200, 404)
    reason = (
        F.when(text.isNotNull(), F.lit(None).cast("string")).when((F.col("kind") == first) & ~F.lit(prefer_markdown), "Preference disabled").when(F.col("arxiv_id").isNull(), "No arXiv ID available")
        .when(failed, F.concat(F.lit("Source request returned "), F.col("status").cast("string"), F.lit(": "), F.substring(F.coalesce("answer", F.lit("")), 1, 200))).otherwise(missing)
    )
    status = F.when(text.isNotNull(), "success").when(failed, "error").otherwise("skipped")
    entry = F.struct("priority", "kind", "label", status.alias("status"), reason.alias("reason"), text.alias("text"))
    rows = got.groupBy("paper_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    rows = rows.withColumn("won", F.get(F.filter("all", lambda a: a["status"] == "success"), F.lit(0)))
    # after the first kind nothing else is tried; after a remote one, not the PDF
    tried = F.filter("all", lambda a: (a["priority"] == 0) | ((F.col("won.priority") > 0) & (a["kind"] != last)) | (F.col("won.kind") == last))
    log = F.transform(tried, lambda a: F.struct(a["kind"].alias("kind"), a["label"].alias("label"), a["status"].alias("status"), a["reason"].alias("reason")))
    return rows.select("paper_id", "won.kind", "won.label", "won.text", log.alias("attempts"))
