"""The citation graph as a data source: ``spark.read.format(name)`` after ``register_graph``.

Options: ``papers``, the identifiers to ask for (parted by commas), ``limit`` (records for a paper and relation), ``key``,
and ``parts`` (papers of a partition).  Filters on paper_id and relation are pushed to the source, which then asks for
what is left only; a schema given by the user has the fields that are asked for.
"""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.types import StructType

from lectern.sources.remote import GRAPH, Fetch, _asked

SCHEMA = "paper_id string, relation string, pos int, id string, title string, authors array<string>, year int, abstract string, citation_count long"
# The fields of the graph that columns come from, and where a relation's papers are.
FIELDS = {"id": "paperId", "title": "title", "authors": "authors", "year": "year", "abstract": "abstract", "citation_count": "citationCount"}
RELATIONS = {"citations": "citingPaper", "references": "citedPaper"}
SPELLED = {"arxiv:": "ArXiv:", "doi:": "DOI:"}


@dataclass
class Papers(InputPartition):
    ids: list[str]
    relations: list[str]


class GraphReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict, fetch: Fetch):
        self.columns, self.fetch = schema.fieldNames(), fetch
        self.papers = [p.strip() for p in options.get("papers", "").split(",") if p.strip()]
        self.relations = list(RELATIONS)
        self.limit, self.key, self.parts = int(options.get("limit", 20)), options.get("key", ""), int(options.get("parts", 50))

    def pushFilters(self, filters: list) -> Iterator:
        """Keeps the papers and relations that equality with values allows; yields what Spark has to filter itself."""
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("paper_id",):
                self.papers = [p for p in self.papers if p in wanted]
            elif wanted is not None and f.attribute == ("relation",):
                self.relations = [r for r in self.relations if r in wanted]
            else:
                yield f

    def partitions(self) -> list[Papers]:
        papers = list(dict.fromkeys(self.papers))
        return [Papers(papers[i : i + self.parts], self.relations) for i in range(0, len(papers), self.parts)] or [Papers([], [])]

    def read(self, part: Papers) -> Iterator[tuple]:
        fields = ",".join(FIELDS[c] for c in self.columns if c in FIELDS) or "paperId"
        for paper in part.ids:
            spelled = next((to + paper[len(short) :] for short, to in SPELLED.items() if paper.startswith(short)), paper)
            for relation in part.relations:
                url = f"{GRAPH}/paper/{urllib.parse.quote(spelled, safe=':/')}/{relation}?fields={fields}&limit={self.limit}"
                status, body = _asked(self.fetch, url, {"x-api-key": self.key} if self.key else {})
                if self.key and status in (401, 403):
                    status, body = _asked(self.fetch, url, {})
                for pos, record in enumerate(self._records(body, relation) if status == 200 else []):
                    if record is not None:
                        yield tuple(self._value(c, paper, relation, pos, record) for c in self.columns)

    def _records(self, body: str, relation: str) -> list:
        try:
            return [r.get(RELATIONS[relation]) for r in json.loads(body).get("data") or []][: self.limit]
        except (ValueError, AttributeError):
            return []

    @staticmethod
    def _value(column: str, paper: str, relation: str, pos: int, record: dict):
        own = {"paper_id": paper, "relation": relation, "pos": pos}
        if column in own:
            return own[column]
        value = record.get(FIELDS[column])
        if column == "authors":
            return [a.get("name") for a in value or []]
        return value or {"title": "Untitled", "year": 0, "abstract": "", "citation_count": 0}.get(column)


def register_graph(spark: SparkSession, fetch: Fetch, name: str = "paper_graph") -> None:
    """Makes the graph behind ``fetch(url, headers)`` a format of that name in the session."""

    class GraphSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: StructType) -> GraphReader:
            return GraphReader(schema, dict(self.options), fetch)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GraphSource)
