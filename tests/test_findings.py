"""Faults that a review found on larger tables and odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.functions import folding, text
from lectern.operators import geometry, markdown, matching, report, tfidf
from lectern.plans import catalog
from lectern.sources import files
from lectern.streaming import lines

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_picks_of_unknown_size_are_not_broadcast(spark):
    plan = plan_of(catalog.queries()["candidate_picks"](spark, SF))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


@pytest.mark.parametrize("name", ["linked_pdfs", "pdf_papers"])
def test_links_of_unknown_size_are_not_broadcast(spark, name):
    plan = plan_of(catalog.queries()[name](spark, SF))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_titles_read_the_references_that_their_sql_reads(spark, tmp_path):
    shown = {1: ("a &amp;&amp; b &amp", "a && b &amp"), 2: ("x = &quot;0b&quot; &", "x = &quot;0b&quot; &"), 3: ("&amp;lt; &lt;", "&lt; &lt;")}
    rows = [(i, "http://x.org", f"<html><body><article><h1>{h}</h1><p>t</p></article></body></html>") for i, (h, _) in shown.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r["page_id"]: r["title"] for r in catalog.queries()["html_title"](spark, str(tmp_path)).collect()} == {i: t for i, (_, t) in shown.items()}


def test_feeds_are_parsed_once(spark):
    plan = plan_of(catalog.queries()["part_feeds"](spark, SF))
    assert plan.count("from_xml") == 1 and "Exchange" in plan


def test_feeds_with_markup_are_read_whole(spark):
    feed = "<?xml version='1.0'?>\n<!-- c --><feed xmlns='http://www.w3.org/2005/Atom'><entry><id>x</id><id>y</id><title type='html'>A &amp; <b>bold</b> &lt;i</title><author/><author><name> </name></author><author><name><![CDATA[C D]]></name></author><link title='pdf'/><link title='pdf' href='h'/></entry><entry><id>z</id></entry></feed>"
    rows = [(0, feed), (1, "<feed></feed>"), (2, "<feed><entry/></feed>"), (3, "<other><entry><id>x</id></entry></other>"), (4, None)]
    got = [r["e"] and tuple(r["e"]) for r in spark.createDataFrame(rows, "i int, xml string").select("i", files.atom_entry(F.col("xml")).alias("e")).orderBy("i").collect()]
    assert got == [("x", "A & bold <i", ["C D"], "", "", "h"), None, ("", "", [], "", "", "https://arxiv.org/pdf/"), None, None]


@pytest.mark.parametrize("name", ["rectangle_clusters", "merged_boxes"])
def test_rectangles_of_a_task_do_not_grow_with_the_table(spark, monkeypatch, name):
    monkeypatch.setattr(geometry, "TASK_ROWS", 100)
    n = -(-spark.read.parquet(f"{SF}/lineitem.parquet").count() // 100)
    plan = plan_of(catalog.queries()[name](spark, SF))
    assert "hashpartitioning(l_orderkey" in plan and f", {n}), REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_titles_of_a_section_are_not_collected_for_each_other(spark):
    plan = plan_of(catalog.queries()["document_pointers"](spark, SF))
    windows = [x for x in plan.split("\n") if " Window " in x or x.lstrip(" +-:").startswith("Window")]
    assert windows and not any("collect_list" in x for x in windows)


def test_paths_are_those_of_a_stack_of_titles(spark):
    levels = [3, 1, 2, 5, 6, 2, 4, 3, 6, 1, 6, 6, 1, 2, 3, 4, 5, 6, 4]
    told, stack = [], ["Document"]
    for i, level in enumerate(levels):
        stack = [*stack[: level - 1], f"t{i}"]
        told.append(stack)
    text = "\n".join(f"{'#' * level} t{i}\n{'#' * (i % 6 + 1)} \nbody {i} $$a + b$$ $c + d$ ![x](y)" for i, level in enumerate(levels))
    docs = spark.createDataFrame([(1, text)], "doc_id long, markdown string")
    assert [r["path"] for r in markdown.sections(docs).orderBy("pos").collect()] == told
    found = markdown.pointers(docs).collect()
    assert {k: sum(r["kind"] == k for r in found) for k in markdown.KINDS} == {"section": 19, "paragraph": 19, "formula": 38, "image": 19}


def test_texts_of_abstracts_are_made_once(spark):
    plan = plan_of(catalog.queries()["document_abstracts"](spark, SF))
    assert plan.count("## Abstract") == 1


def test_figures_read_pointers_once(spark):
    plan = plan_of(catalog.queries()["document_figures"](spark, SF))
    assert plan.count("Scan parquet") == 1 and "Join" not in plan


def test_pages_go_to_python_in_small_lots_and_once(spark):
    plan = plan_of(catalog.queries()["html_pointers"](spark, SF))
    assert plan.count("BatchEvalPython") == 1 and "InPandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", ["note_papers", "pdf_papers"])
def test_texts_of_notes_are_made_once(spark, name):
    plan = plan_of(catalog.queries()[name](spark, SF))
    assert plan.count("(?i)[0-9/]|arxiv|doi") == 1


def test_empty_lines_of_streams_need_no_join_of_their_own(spark):
    chunks = spark.createDataFrame([(1, 0, b"a\n\n"), (1, 1, b"\nb"), (1, 2, None), (1, 3, b"\n"), (2, 0, b"\n\nx"), (3, 0, b""), (4, 0, b"\n")], "stream int, seq long, body binary")
    found = lines.chunk_lines(chunks, 2)
    assert "LeftAnti" not in plan_of(found)
    assert sorted(map(tuple, found.collect())) == [(1, 0, "a"), (1, 1, ""), (1, 2, ""), (1, 3, "b"), (2, 0, ""), (2, 1, ""), (2, 2, "x"), (4, 0, "")]


def test_answers_are_made_once(spark):
    plan = plan_of(catalog.queries()["document_salvage"](spark, SF))
    assert "Generate inline" in plan  # a made answer is a row of its own, which both columns read


def test_lists_of_all_documents_are_not_shuffled_for_their_most_cited(spark):
    plan = plan_of(catalog.queries()["citation_rank_blend"](spark, SF))
    assert "WindowGroupLimit" in plan and "max(citations" not in "".join(x for x in plan.split("\n") if "Window" in x)


def test_a_text_is_sought_once_on_a_page(spark, monkeypatch):
    sought, real = [], matching.match_spans
    monkeypatch.setattr(matching, "match_spans", lambda quotes, threshold: sought.append(quotes.count()) or real(quotes, threshold))
    items = spark.createDataFrame([("d", p, i, f"line {i} of page {p}, {w} and more") for p, w in ((1, "apples"), (2, "pears")) for i in range(3)], "doc_id string, page_num int, idx int, text string")
    marks = [(f"{w}{p}", "d", p, f"Line 1 of page {n}, {w} and more", "p.pdf") for n, w in ((1, "apples"), (2, "pears")) for p in (0, 1, 2, 3)] + [("none", "d", 1, None, "p.pdf"), ("nowhere", None, 1, "line", "p.pdf")]
    got = {r["id"]: (r["match_page"], r["begin_index"], r["score"]) for r in matching.anchors(spark.createDataFrame(marks, "id string, doc_id string, page_num int, exact_text string, file_name string"), items).collect()}
    assert sought == [4]  # two texts, on two pages each
    near = {"apples0": (1, 1, 1.0), "apples1": (1, 1, 1.0), "apples3": (2, 0, pytest.approx(21 / 37)), "pears2": (2, 1, 1.0), "pears3": (2, 1, 1.0), "none": (1, None, 0.0), "nowhere": (1, None, 0.0)}
    assert {k: got[k] for k in near} == near and len(got) == 10


def test_places_are_sought_from_both_ends(spark):
    """A prefix is tried by the characters that are missing, not by halving the whole text: all places of texts whose code
    points make none, one or many characters."""
    texts = ["plain text of words", "  a­­­ b…ﷺ  ½c. ", "­" * 40 + "x" + "ﷺ" * 3 + "-" * 50 + "y", "…" * 9, "--"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("pairs", folding.fold_pairs(F.col("t")))
    for form in folding.FORMS:
        size = F.char_length(folding.squeezed(folding.folded(F.col("t")), form))
        rows = df.withColumn("n", F.explode(F.sequence(F.lit(0), size))).withColumn("p", folding.place_of(F.col("t"), F.col("pairs"), F.lit(form), F.col("n"), size))
        prefixes = F.transform(F.sequence(F.lit(0), F.char_length("t")), lambda k: F.char_length(folding.squeezed(folding.folded_by(F.substring("t", F.lit(1), k), F.col("pairs")), form)))
        got = rows.select("t", "n", "p", prefixes.alias("has")).collect()
        assert len(got) > 20
        for r in got:
            end = next((k for k, has in enumerate(r["has"]) if has > r["n"]), None)
            last = len(r["t"]) if r["has"][-1] == 0 else next(k for k, has in enumerate(r["has"]) if has == r["has"][-1])
            assert tuple(r["p"]) == ((end - 1, end) if end else (len(r["t"]), last)), (form, r)


def test_pages_go_on_without_their_folded_items(spark):
    plan = plan_of(catalog.queries()["fuzzy_anchors"](spark, SF))
    assert not any("page_raw" in x and "Exchange" in x for x in plan.split("\n")) and "page_raw" not in matching.PAGE and "sizes_light" in matching.PAGE


def test_only_pairs_that_can_count_are_ranked(spark):
    docs = spark.createDataFrame([(1, ""), (2, "wolf ox " * 20_000), (3, "Wolf woL wolfs ox"), (4, "the"), (5, None), (6, "ox-ox ox2")], "doc_id long, text string")
    queries = spark.createDataFrame([("a", "wolf ox"), ("b", "ox2 cow"), ("c", "")], "query_id string, text string")
    whole = {(r["query_id"], r["doc_id"]): r["sim"] for r in tfidf.similarities(queries, docs).collect()}
    some = {(r["query_id"], r["doc_id"]): r["sim"] for r in tfidf.similarities(queries, docs, 2).collect()}
    assert len(whole) == 18 and {k for k, v in whole.items() if v} == {("a", 2), ("a", 3), ("a", 6), ("b", 6)}
    assert some == pytest.approx({k: v for k, v in whole.items() if v or k[1] <= 2})
    counted = {(r["doc_id"], r["term"]): r["tf"] for r in tfidf._counted(docs).collect()}
    assert counted == {(r["doc_id"], r["term"]): r["tf"] for r in tfidf.term_frequencies(docs).collect()} and counted[2, "wolf"] == 20_000
    plan = plan_of(catalog.queries()["tfidf_topk"](spark, SF))
    assert "array_except" in plan and "map_from_entries" not in plan


BLANK = ["", " ", "\n \t", "\r\n", "\f", "\v", "\u00a0", "\u3000 \n", "\u200b", "\x85", "\x1c"]
ODD = [None, *BLANK, *[x for b in BLANK for x in ("a" + b, b + "a", f"a{b}\n", f"\n{b}a")]]


def unlike_sql(spark, tmp_path, name, texts):
    """What the query and its SQL make of documents with these texts, and of one without a key: (text, query, SQL) where they differ."""
    rows = [*enumerate(texts), (None, "a"), (None, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(map(tuple, catalog.queries()[name](spark, str(tmp_path)).where("doc_id IS NOT NULL").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    made = con.execute(catalog.oracle_sql()[name]).fetchall()
    keyless = sorted(repr(r[1]) for r in catalog.queries()[name](spark, str(tmp_path)).where("doc_id IS NULL").collect())
    assert keyless == sorted(repr(v) for i, v in made if i is None) and len(got) == len(texts)
    return [(texts[i], got[i], v) for i, v in made if i is not None and got[i] != v]


def test_blocks_are_added_as_by_sql(spark, tmp_path):
    old = f"{report.START}\nold\n{report.END}"
    assert unlike_sql(spark, tmp_path, "managed_block_append", [*ODD, old, f"x {old} y", report.START, f"{report.END} {report.START}\v", "$1 \\1 $$ \n"]) == []


def test_bodies_are_tidied_as_by_sql(spark, tmp_path):
    heads = ["# Head", "# Head\n\ntext", "## A\n# B\n\n### C\n\nx", "#\nx\n", "# h\n" * 3000 + "t"]
    inside = ["a \r\nb  \r\n\r\n\r\nc", "a\rb", "a \t\n \n\t\n\nb", "a" + " " * 20_000 + "b" + "\n" * 5000 + "c", "\\", "\\r\\s\\|", "|\\\n\n\n\\|", "$1 \\1 $$"]
    assert unlike_sql(spark, tmp_path, "note_bodies", [*ODD, *heads, *inside]) == []


def test_many_headings_and_long_runs_of_blanks_are_tidied(spark):
    texts = {"# h\r\n\n" * 3000 + "t \t\n\n\n\n#h\n": "t\n\n#h", "a" + " " * 50_000 + "b \n": "a" + " " * 50_000 + "b", "# a\n## b\n": "## b", " \n": ""}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["body"] for r in df.select("t", text.normalize_markdown(F.col("t")).alias("body")).collect()} == texts
