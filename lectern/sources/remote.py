"""Remote sources behind a fetch function: texts of papers, the citation graph, PDFs.

``fetch(url, headers)`` gives (status, body); it runs in tasks, batch by batch, and may raise.  What a status means
is decided here, so a test's or an offline user's stub is a dictionary of answers.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import ids
from lectern.functions.text import normalize_remote
from lectern.operators.identity import SOURCES, source_bundle
from lectern.sources import html

Fetch = Callable[[str, dict[str, str]], tuple[int, str | None]]

# What each source is asked to send; the citation graph's address and the fields asked for.
ACCEPT = {
    "huggingface-markdown": "text/markdown,text/plain",
    "arxiv-html": "text/html,application/xhtml+xml",
    "ar5iv-html": "text/html,application/xhtml+xml",
    "jina-reader": "text/plain,text/markdown,text/html",
}
GRAPH = "https://api.semanticscholar.org/graph/v1"
GRAPH_FIELDS = "title,authors,year,abstract,citationCount,openAccessPdf,externalIds"
READER = "https://r.jina.ai/"
LOOKS_LIKE_HTML = re.compile(r"<!doctype html>|<html[\s>]", re.I)


def source_requests(papers: DataFrame, prefer_markdown: bool = True) -> DataFrame:
    """(paper_id, kind, url) for papers (paper_id, arxiv_id) that have an identifier; the reader reads the PDF's address."""
    urls = ids.source_urls(F.col("arxiv_id"))
    kinds = {"huggingface-markdown": urls["markdown"], "arxiv-html": urls["html"], "ar5iv-html": urls["ar5iv"], "jina-reader": F.concat(F.lit(READER), urls["pdf"])}
    wanted = [F.struct(F.lit(k).alias("kind"), u.alias("url")) for k, u in kinds.items() if prefer_markdown or k != SOURCES[0][0]]
    return papers.where("arxiv_id is not null").select("paper_id", F.explode(F.array(*wanted)).alias("r")).select("paper_id", "r.*")


def _asked(fetch: Fetch, url: str, headers: dict[str, str]) -> tuple[int, str]:
    """A failure to fetch at all is status 0 with what went wrong."""
    try:
        status, body = fetch(url, headers)
        return int(status), body or ""
    except Exception as e:  # the function is the caller's, and one page must not end the others
        return 0, str(e)


def fetch_sources(requests: DataFrame, fetch: Fetch) -> DataFrame:
    """requests (paper_id, kind, url) with status and text: pages of 200 as Markdown (HTML by its kind or its looks), all
    others as they came.  A failed fetch has status 0."""
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema)

    def text_of(kind: str, url: str, status: int, body: str) -> str:
        page = kind in ("arxiv-html", "ar5iv-html") or (kind == "jina-reader" and LOOKS_LIKE_HTML.match(body.strip()))
        return html.to_markdown(body, url) if status == 200 and body.strip() and page else body

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [_asked(fetch, u, {"Accept": ACCEPT.get(k, "*/*")}) for k, u in zip(f["kind"], f["url"], strict=True)]
            texts = [text_of(k, u, *g) for k, u, g in zip(f["kind"], f["url"], got, strict=True)]
            yield f.assign(status=[g[0] for g in got], text=texts)

    return requests.mapInPandas(run, f"{kept}, status int, text string")


def paper_sources(papers: DataFrame, fetch: Fetch, prefer_markdown: bool = True) -> DataFrame:
    """``identity.source_bundle`` of papers (paper_id, arxiv_id, pdf_text) with what ``fetch`` finds, tidied."""
    answers = fetch_sources(source_requests(papers, prefer_markdown), fetch)
    answers = answers.withColumn("text", F.when(F.col("status") == 200, normalize_remote(F.col("text"))).otherwise(F.col("text")))
    return source_bundle(papers, answers, prefer_markdown)


def fetch_graph(papers: DataFrame, fetch: Fetch, relation: str = "citations", most: int = 20, key: str = "") -> DataFrame:
    """(paper_id, pos, record): the papers that cite those in papers (paper_id), or are their references.

    A key that is rejected (401, 403) is left out and the request repeated; any other failure, also of a body that
    is not JSON, gives no rows.
    """
    found = {"citations": "citingPaper", "references": "citedPaper"}[relation]
    url = F.concat(F.lit(f"{GRAPH}/paper/"), ids.graph_id(F.col("paper_id")), F.lit(f"/{relation}?fields={GRAPH_FIELDS}&limit={most}"))
    kind = papers.schema["paper_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bodies = []
            for u in f["url"]:
                status, body = _asked(fetch, u, {"x-api-key": key} if key else {})
                if key and status in (401, 403):
                    status, body = _asked(fetch, u, {})
                bodies.append(body if status == 200 else None)
            yield pd.DataFrame({"paper_id": f["paper_id"], "body": bodies})

    record = "paperId:string,title:string,authors:array<struct<authorId:string,name:string>>,year:int,abstract:string,citationCount:int,openAccessPdf:struct<url:string>,externalIds:struct<ArXiv:string,DOI:string>"
    answered = papers.select("paper_id", url.alias("url")).mapInPandas(run, f"paper_id {kind}, body string")
    rows = answered.select("paper_id", F.posexplode(F.from_json("body", f"data array<struct<{found}:struct<{record}>>>")["data"]).alias("pos", "r"))
    return rows.where(F.col(f"r.{found}").isNotNull()).select("paper_id", "pos", ids.graph_record(F.col(f"r.{found}")).alias("record"))


def downloads(papers: DataFrame, files: DataFrame, fetch: Callable[[str], tuple[int, bytes]], folder: Column, overwrite: bool = False) -> DataFrame:
    """(paper_id, path, step, status, content): the PDFs of papers (paper_id, arxiv_id, title) that are not among files (path) yet.

    Each path is fetched once: step is ``kept`` for one that is there (unless ``overwrite``), else ``fetched`` or, but for
    status 200, ``failed``; a fetch that raises has status 0.  Writing the content by path is then idempotent.  A task
    holds one PDF at a time.
    """
    path = ids.file_path(F.col("title"), folder, "pdf")
    rows = papers.select("paper_id", path.alias("path"), ids.pdf_url(F.col("arxiv_id")).alias("url"))
    have = files.select(F.col("path").alias("have")).distinct()
    rows = rows.join(have, F.col("path") == F.col("have"), "left").withColumn("there", F.col("have").isNotNull() & ~F.lit(overwrite)).drop("have")
    kind = papers.schema["paper_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(len(f)):
                try:
                    status, content = fetch(f["url"].iloc[k])
                except Exception:  # the function is the caller's, and one paper must not end the others
                    status, content = 0, None
                good = status == 200
                yield f.iloc[k : k + 1][["paper_id", "path"]].assign(step="fetched" if good else "failed", status=int(status), content=[content if good else None])

    schema = f"paper_id {kind}, path string, step string, status int, content binary"
    new = rows.where("not there and url is not null").dropDuplicates(["path"]).mapInPandas(run, schema)
    kept = rows.where("there").select("paper_id", "path", F.lit("kept").alias("step"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("binary").alias("content"))
    return new.unionByName(kept)
