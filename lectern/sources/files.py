"""Notes, Atom records and provider calls as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.ids import arxiv_id, pdf_url
from lectern.functions.text import trim_all

NOTE = r"(?s)\A---\n(.*?)\n---\n?"


def split_note(path: Column, content: Column) -> list[Column]:
    """path, name, basename, ext, head (the YAML between its marks, or null), body, inline_tags."""
    name = F.element_at(F.split(path, "/"), -1)
    body = F.regexp_replace(content, NOTE, "")
    return [
        path.alias("path"), name.alias("name"), F.regexp_replace(name, r"\.[^.]*\z", "").alias("basename"), F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1)).alias("ext"),
        F.nullif(F.regexp_extract(content, NOTE, 1), F.lit("")).alias("head"), body.alias("body"),
        F.regexp_extract_all(F.regexp_replace(body, r"(?s)```.*?```", ""), F.lit(r"(?:^|\s)#([A-Za-z][\w/-]*)"), 1).alias("inline_tags"),
    ]


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Note files (.md, in all folders below ``path``) with their frontmatter as a map of strings (lists joined by commas)."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True).select("*", F.col("_metadata.file_path").alias("path"))
    return with_frontmatter(raw.select(*split_note(F.col("path"), F.col("value"))))


def with_frontmatter(notes: DataFrame) -> DataFrame:
    """``head`` parsed to ``frontmatter``; YAML that is no mapping gives an empty one."""
    columns = [f for f in notes.schema if f.name != "head"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns) + ", frontmatter map<string,string>"

    def value(x) -> str:
        return ", ".join(map(str, x)) if isinstance(x, list) else "" if x is None else str(x)

    def run(frames):
        import yaml

        for f in frames:
            maps = []
            for head in f["head"]:
                try:
                    loaded = yaml.load(head, yaml.BaseLoader) if head else {}
                except yaml.YAMLError:
                    loaded = {}
                maps.append({str(k): value(v) for k, v in loaded.items()} if isinstance(loaded, dict) else {})
            yield f.drop(columns="head").assign(frontmatter=maps)

    return notes.mapInPandas(run, schema)


#: What is read of a feed, and how: texts as they are, and an error for what is no XML.
FEED = "entry array<struct<id array<string>, title array<string>, summary array<string>, published array<string>, author array<struct<name array<string>>>, link array<struct<_title string, _href string>>>>"
FEED_OPTIONS = {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false"}
FEED_ROOT = r"(?s)\A(?:\s|\x{FEFF}|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<feed[\s/>]"


def atom_entry(xml: Column) -> Column:
    """struct of the first entry: id, title, authors, abstract, published (10 characters), pdf_url; null without an entry.

    A feed is parsed once for all fields.  Only fields with markup in them are read again, as the parser leaves the markup in.
    """

    def read(e: Column) -> Column:
        def text(name: str) -> Column:
            told = F.coalesce(F.get(e[name], F.lit(0)), F.lit(""))
            return trim_all(F.when(F.contains(told, F.lit("<")), F.xpath_string(xml, F.lit(f"/feed/entry[1]/{name}"))).otherwise(told))

        raw = text("id")
        own = F.coalesce(arxiv_id(raw), raw)
        names = F.array_compact(F.flatten(F.transform(F.coalesce(e["author"], F.array()), lambda a: F.coalesce(a["name"], F.array().cast("array<string>")))))
        names = F.when(F.exists(names, lambda n: F.contains(n, F.lit("<"))), F.xpath(xml, F.lit("/feed/entry[1]/author/name/text()"))).otherwise(names)
        authors = F.filter(F.transform(names, trim_all), lambda a: a != "")
        links = F.filter(e["link"], lambda k: (k["_title"] == "pdf") & k["_href"].isNotNull())
        link = F.nullif(F.get(links, F.lit(0))["_href"], F.lit(""))
        return F.struct(own.alias("id"), text("title").alias("title"), authors.alias("authors"), text("summary").alias("abstract"), F.substring(text("published"), 1, 10).alias("published"), F.coalesce(link, pdf_url(own)).alias("pdf_url"))

    entries = F.when(xml.rlike(FEED_ROOT), F.from_xml(xml, FEED, FEED_OPTIONS)["entry"])
    return F.get(F.transform(F.slice(entries, 1, 1), read), F.lit(0))


def _asked_seconds(headers: dict | None) -> float | None:
    """What a header Retry-After asks for, in seconds or as a date; None without a usable one."""
    import datetime as dt
    from email.utils import parsedate_to_datetime

    value = next((str(v).strip() for k, v in (headers or {}).items() if k.lower() == "retry-after"), "")
    try:
        return max(float(value), 0.0) if float(value) >= 0 else None
    except ValueError:
        pass
    try:
        return max((parsedate_to_datetime(value) - dt.datetime.now(dt.UTC)).total_seconds(), 0.0)
    except (ValueError, TypeError):
        return None


def call_provider(requests: DataFrame, call: Callable[[str, str, int], tuple], parallel: int = 3, attempts: int = 4, wait: Callable[[float], None] | None = None, width: int = 1) -> DataFrame:
    """requests (id, system, user, max_tokens) with status, body and attempts of ``call``, on ``parallel`` tasks of ``width``
    calls at a time each, so at most their product run at once.

    ``call`` gives (status, body) or (status, body, headers).  An empty system prompt is answered by {} without a call.  Calls
    that may succeed later, by their status or by the error that they raise, are repeated, at most ``attempts``
    times in all; before each repetition ``wait``, if given, is called with the pause in seconds (time.sleep, say):
    what the header Retry-After asks for, else the doubling one, 8 at most.  A call that raised last has status 0 and
    the error as body.  Within a task answers are in the order of the requests, whichever comes first; a batch of
    requests is held at a time, and a slow call holds up its batch only.
    """
    from lectern.functions.rules import RETRYABLE, TRANSPORT_WORDS

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema)

    def answer(request: tuple) -> tuple[int, str, int]:
        system, user, tokens = request
        if not (system or "").strip():
            return 200, "{}", 0
        headers = None
        for n in range(1, attempts + 1):
            if n > 1 and wait:
                asked = _asked_seconds(headers)
                wait(min(2.0 ** (n - 2) if asked is None else asked, 8.0))
            try:
                status, body, *rest = call(system, user, int(tokens))
                headers = rest[0] if rest else None
                again = status in RETRYABLE
            except Exception as e:  # the call is the caller's, and one request must not end the others
                status, body, headers = 0, str(e), None
                again = any(w in body.lower() for w in TRANSPORT_WORDS)
            if not again:
                break
        return status, body, n

    def run(frames):
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(width) as pool:
            for f in frames:
                rows = list(pool.map(answer, zip(f["system"], f["user"], f["max_tokens"], strict=True)))
                yield f.assign(status=[r[0] for r in rows], body=[r[1] for r in rows], attempts=[r[2] for r in rows])

    return requests.repartition(parallel).mapInPandas(run, f"{kept}, status int, body string, attempts int")


def stub_provider(system: str, user: str, max_tokens: int) -> tuple[int, str]:
    """A deterministic stand-in for a model: marks the first sentence of 10 characters or more."""
    import json
    import re

    found = re.search(r"[^.!?\n]{9,}[.!?]", user)
    return 200, json.dumps({"highlights": [{"exact_text": found[0].strip(), "type": "key_point"}] if found else []})


# Tables that are replaced or grown safely: a folder for each version or batch, which counts once its mark is there.  A mark is
# an empty file that is made last and never changed, so a job that dies leaves what was there before.

_MARK = "_committed-"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def committed(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions or batches at ``path`` that count, in order."""
    fs, place = _files(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n.removeprefix(_MARK)) for n in names if n.startswith(_MARK))


def _commit(spark: SparkSession, table: DataFrame, path: str, number: int) -> None:
    fs, _ = _files(spark, path)
    table.write.mode("overwrite").parquet(f"{path}/v{number}")  # a dead job's leavings go
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_MARK}{number}"), False).close()


def current_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The last version that ``save_if_changed`` saved at ``path``, or None."""
    numbers = committed(spark, path)
    return spark.read.parquet(f"{path}/v{numbers[-1]}") if numbers else None


def save_if_changed(table: DataFrame, path: str, keep: int = 2) -> bool:
    """Saves a new version of the table at ``path`` (settings, a queue) if its rows differ; whether it did.

    Readers take the last version with a mark, so they see the old table or the new one, whenever the job ends; the
    last ``keep`` versions stay, for those who still read them.
    """
    spark, path = table.sparkSession, path.rstrip("/")
    numbers = committed(spark, path)
    if numbers:
        old = current_table(spark, path)
        if old.dtypes == table.dtypes and old.exceptAll(table).isEmpty() and table.exceptAll(old).isEmpty():
            return False
    new = numbers[-1] + 1 if numbers else 0
    _commit(spark, table, path, new)
    fs, _ = _files(spark, path)
    for n in numbers[: max(len(numbers) + 1 - keep, 0)]:
        for gone in (f"{path}/{_MARK}{n}", f"{path}/v{n}"):
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(gone), True)
    return True


def batch_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keeps each micro-batch once, also if a restarted stream brings it again."""

    def save(batch: DataFrame, number: int) -> None:
        if number not in committed(batch.sparkSession, path):
            _commit(batch.sparkSession, batch, path, number)

    return save


def batches(spark: SparkSession, path: str) -> DataFrame | None:
    """All that ``batch_sink`` has kept at ``path``, or None."""
    numbers = committed(spark, path)
    return spark.read.parquet(*[f"{path}/v{n}" for n in numbers]) if numbers else None


def overwrite_documents(rows: DataFrame, path: str) -> None:
    """Replaces what is kept at ``path`` for the documents (doc_id) in ``rows``, and for no others: a folder for each
    document, written by one task."""
    rows.repartition("doc_id").write.partitionBy("doc_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
