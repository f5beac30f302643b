"""Operators on hand-made rows: folds, offsets, state and rendering."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import citations, responses, rules, text
from lectern.operators import cascade, geometry, identity, markdown, matching, pages, planner, report, tfidf
from lectern.plans import fixtures
from lectern.sources import files, html, remote
from lectern.streaming import queues

ITEM = "doc_id string, page_num int, idx int, text string, height double, y double, font_name string, font_family string, has_eol boolean"


def items(spark, lines):
    """lines: (page, text, height)"""
    rows = [("d", p, i, t, float(h), 700.0 - 14 * i, "f1", "serif", False) for i, (p, t, h) in enumerate(lines)]
    return spark.createDataFrame(rows, ITEM)


def chunks(spark, lines):
    return [r.asDict() for r in pages.chunk_pages(items(spark, lines)).orderBy("pos").collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_chunks_take_page_and_stop_at_references(spark):
    found = chunks(spark, [(5, "Main body.", 12), (6, "7. References", 12), (7, "Smith et al. 2023.", 12)])
    assert [c["page_num"] for c in found] == [5] and found[0]["text"] == "Main body." and found[0]["section_tag"] == "other"


def test_captions_go_and_bodies_stay(spark):
    found = " ".join(c["text"] for c in chunks(spark, [(1, "Main body.", 12), (1, "Figure 1: Architecture overview.", 12), (1, "More body.", 12)]))
    assert "Main body." in found and "More body." in found and "Figure" not in found


def test_headings_set_tag_and_long_text_splits(spark):
    found = chunks(spark, [(1, "1 Introduction", 18), *[(1, f"sentence number {i} here.", 12) for i in range(200)], (2, "Conclusion", 18), (2, "The end.", 12)])
    assert len(found) > 3 and found[0]["section_tag"] == "introduction" and found[0]["heading_text"] == "Introduction"
    assert found[-1]["section_tag"] == "conclusion" and all(len(c["text"]) <= 1600 for c in found)
    assert all(c["text"].endswith(".") for c in found)


def test_heading_pieces_on_a_line_are_one(spark):
    rows = [("d", 1, 0, "3", 18.0, 700.0, "f", "s", False), ("d", 1, 1, "Method", 18.0, 700.0, "f", "s", False), ("d", 1, 2, "Words that follow here.", 12.0, 680.0, "f", "s", False), ("d", 1, 3, "And more of those words.", 12.0, 666.0, "f", "s", False), ("d", 1, 4, "Still more of them here.", 12.0, 652.0, "f", "s", False)]
    found = pages.chunk_pages(spark.createDataFrame(rows, ITEM)).collect()
    assert [(r["section_tag"], r["heading_text"]) for r in found] == [("method", "Method")]


def test_no_items_no_chunks(spark):
    assert pages.chunk_pages(items(spark, [])).count() == 0


@pytest.mark.parametrize("s", ["", "abc", "é€", "section\nTitle\nx"])
def test_hash(spark, s):
    h = 0x811C9DC5
    for c in s:
        h = (h ^ ord(c)) * 0x01000193 % 2**32
    assert value(spark, text.fnv1a(F.lit(s))) == f"{h:08x}"


def pointers(spark, *texts, kind=None):
    found = markdown.pointers(spark.createDataFrame(list(enumerate(texts)), "doc_id int, markdown string")).orderBy("doc_id", "kind", "ordinal").collect()
    return [p for p in found if kind in (None, p["kind"])]


def test_astral_offsets_count_code_points(spark):
    (found,) = pointers(spark, "a 😀 $x=1$ b", kind="formula")
    assert (found["char_start"], found["char_end"]) == (4, 9)


def test_prose_between_display_blocks_counts_as_inline(spark):
    found = [p["content"] for p in pointers(spark, "$$a=b$$ words = here $$c=d$$", kind="formula")]
    assert "$$a=b$$" in found and "$$c=d$$" in found and len(found) == 3


def test_sections_and_offsets(spark):
    md = "Before.\r\n\r\n# A\n\ntext *one*.\n\n### B\nb text\n# \nmore b\n\n## C\n\n\n## D\nd"
    found = markdown.sections(spark.createDataFrame([(1, md), (2, "# only\n## headings"), (3, ""), (4, None), (1, "x")], "doc_id int, markdown string")).collect()
    first = sorted((r for r in found if r["doc_id"] == 1 and r["content"] != "x"), key=lambda r: r["pos"])
    assert [(r["heading"], list(r["path"]), r["content"]) for r in first] == [("Document", ["Document"], "Before."), ("A", ["A"], "text *one*."), ("B", ["A", "B"], "b text\nmore b"), ("D", ["A", "D"], "d")]
    body = md.replace("\r\n", "\n")
    for r in (first[0], first[1], first[3]):
        assert body[r["char_start"] : r["char_end"]] == r["content"] and body[: r["char_start"]].count("\n") + 1 == r["line_start"]
    assert [(r["heading"], r["content"]) for r in found if r["doc_id"] == 2] == [("Document", "# only\n## headings")] and not [r for r in found if r["doc_id"] in (3, 4)]
    assert sum(r["content"] == "x" for r in found) == 1


def test_captions_come_from_neighbours(spark):
    found = pointers(spark, "![a](u)\n\nFigure 1: Short. Rest.", "A paragraph before it.\n\n![b](u)\n\nbrief", "![alt text](u)", "![c](u) and words that follow it", kind="image")
    assert [p["excerpt"] for p in found] == ["Figure 1: Short.", "A paragraph before it.", "alt text", "and words that follow it"]


def test_html_walk():
    page = '<body><nav>skip</nav><main><h1>Paper  Title</h1><p>One<b>two<p>three<figure><img src="/fig1.png"><figcaption>Figure 1</figcaption></figure><div class="ltx_Math" alttext="\\bm{x} = y + z"></div><ul><li>a<li>b</ul><pre> code </pre></main>'
    out = html.to_markdown(page, "https://arxiv.org/html/2604.04184")
    for part in ("# Paper Title", "Onetwo", "three", "![Figure](https://arxiv.org/fig1.png)", "Figure 1", "$$\n\\boldsymbol{x} = y + z\n$$", "- a\n\n- b", "```\ncode\n```"):
        assert part in out
    assert "skip" not in out and html.to_markdown("", "") == "# Paper"


def test_boldsymbol_keeps_longer_names():
    assert html.boldsymbol(r"a \bmod b \bm{x{y}} \bm z") == r"a \bmod b \boldsymbol{x{y}} \boldsymbol{z}"
    assert html.boldsymbol(r"\bm\alpha + \bm {ab} \bm") == r"\boldsymbol{\alpha} + \boldsymbol{ab} \bm"
    assert html.boldsymbol(r"\bm{open \bm x") == r"\boldsymbol{{}open \boldsymbol{x}"


def test_blocks_of_known_pointers(spark):
    outputs = spark.createDataFrame([("d", 1, "p", "a", "## Title\nBody"), ("d", 2, "gone", "a", "x"), ("d", 3, "p", "a", "  "), ("e", 4, "p", "a", "other document")], "doc_id string, seq int, pointer_id string, target_heading string, markdown string")
    known = spark.createDataFrame([("d", "p"), ("d", "p")], "doc_id string, id string")
    assert [tuple(r) for r in planner.explainer_blocks(outputs, known).collect()] == [("d", "a", 1, "Body")]


def test_images_of_a_section_by_path_and_by_number(spark):
    sections = spark.createDataFrame([("d", "s1", ["A"], "see Fig. 2 and figure 3"), ("d", "s2", ["B"], "nothing")], "doc_id string, id string, section_path array<string>, content string")
    images = spark.createDataFrame([("d", "i1", 1, ["B"], "![Figure 1](u)"), ("d", "i2", 2, ["C"], "![Figure 2](u)"), ("d", "i3", 3, ["C"], "![image 31](u)"), ("d", "i4", 4, ["A"], "![x](u)")], "doc_id string, id string, ordinal int, section_path array<string>, content string")
    got = sorted(tuple(r) for r in planner.image_owner(images, sections, 3).collect())
    assert got == [("d", "s1", "i2", 1), ("d", "s1", "i3", 3), ("d", "s1", "i4", 2), ("d", "s2", "i1", 1)]


def test_picks_meet_candidates(spark):
    picks = spark.createDataFrame([("q", i, f"p{i}", "short" if i == 1 else "long enough reason") for i in range(8)] + [("q", 9, "p1", "again")], "id string, pos int, paper_id string, reason string")
    papers = spark.createDataFrame([("q", f"p{i}", f"T{i}", f"u{i}", "A first sentence that is long enough. More.") for i in range(1, 8)], "id string, paper_id string, title string, url string, abstract string")
    got = tfidf.recommended_papers(picks, papers).orderBy("rank").collect()
    assert [r["paper_id"] for r in got] == ["p1", "p2", "p3", "p4", "p5"] and got[0]["reason"] == "A first sentence that is long enough." and got[1]["reason"] == "long enough reason"


def test_failures_and_headers(spark):
    f = responses.failure(F.col("status"), F.col("body"), F.col("headers"))
    rows = [(400, '{"id":"msg_1","error":{"detail":"quota used up","meta":{"Request-Id":"r9"}}}', None), (500, None, {"X-Request-ID": "h1"}), (500, "a  b\n" * 200, {}), (429, '{"list":[{"a":{"request id":" deep "}}]}', {"request-id": "h2"})]
    got = [r["f"] for r in spark.createDataFrame(rows, "status int, body string, headers map<string,string>").select(f.alias("f")).collect()]
    assert (got[0]["message"], got[0]["request_id"]) == ("quota used up", "r9") and (got[1]["message"], got[1]["request_id"]) == ("", "h1")
    assert len(got[2]["message"]) == 240 and got[3]["request_id"] == "deep" and got[3]["overloaded"] and got[3]["retryable"]


def test_retries_wait_for_dates_too(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    asked = lambda x: value(spark, rules.asked_delay_ms(F.lit(x), now))
    assert asked("3") == 3000 and asked("0.5") == 500 and asked("Thu, 01 Jan 2026 00:00:05 GMT") == 5000 and asked("Wed, 31 Dec 2025 23:00:00 GMT") == 0 and asked("soon") is None and asked("") is None
    assert value(spark, rules.is_transport_error(F.lit("Error: ECONNRESET"))) is True and value(spark, rules.is_transport_error(F.lit("bad key"))) is False


def test_sources_are_tried_in_order(spark):
    papers = spark.createDataFrame([("p", "2301.00001", "pdf text"), ("none", "2301.00002", "pdf text"), ("no id", None, "text"), ("first", "2301.00003", "")], "paper_id string, arxiv_id string, pdf_text string")
    rows = [("p", "huggingface-markdown", 404, ""), ("p", "arxiv-html", 404, ""), ("p", "ar5iv-html", 200, " <p>x "), ("p", "jina-reader", 500, "oops"), ("first", "huggingface-markdown", 200, "# md"), ("first", "arxiv-html", 200, "h"), ("none", "arxiv-html", 200, "  ")]
    answers = spark.createDataFrame(rows, "paper_id string, kind string, status int, text string")
    got = {r["paper_id"]: r for r in identity.source_bundle(papers, answers).collect()}
    told = lambda p: [a["status"] for a in got[p]["attempts"]]
    assert (got["p"]["kind"], got["p"]["text"], told("p")) == ("ar5iv-html", "<p>x", ["skipped", "skipped", "success", "error"]) and got["p"]["attempts"][3]["reason"] == "Source request returned 500: oops"
    assert got["none"]["kind"] == "pdf" and told("none") == ["skipped"] * 4 + ["success"] and got["no id"]["attempts"][1]["reason"] == "No arXiv ID available"
    assert got["first"]["kind"] == "huggingface-markdown" and told("first") == ["success"]
    other = {r["paper_id"]: r for r in identity.source_bundle(papers, answers, prefer_markdown=False).collect()}
    assert other["first"]["kind"] == "arxiv-html" and other["first"]["attempts"][0]["reason"] == "Preference disabled"


def note(path, front=None, body=""):
    base = path.split("/")[-1]
    return (path, base, base.rsplit(".", 1)[0], "md", front or {}, body, [])


NOTE = "path string, name string, basename string, ext string, frontmatter map<string,string>, body string, inline_tags array<string>"


def test_linked_note_without_identity_is_related(spark):
    notes = spark.createDataFrame([note("n/My Note.md", {"pdf_file": "a.pdf", "title": "Of things"}), note("n/é.md"), note("n/ü.md"), note("n/src.md", {"source": "see [[b.pdf]] and x/Papers/c.pdf, v2"})], NOTE)
    pdfs = spark.createDataFrame([("Papers/a.pdf", "a.pdf", "a", "DOI: 10.1145/1234567.8901234"), ("Papers/é.pdf", "é.pdf", "é", "arXiv:2301.00001"), ("Papers/b.pdf", "b.pdf", "b", "arXiv:2301.00002"), ("Papers/c.pdf", "c.pdf", "c", "")], "path string, name string, basename string, preview string")
    got = {r["path"]: r for r in identity.resolve_pdfs(pdfs, notes).collect()}
    assert (got["Papers/a.pdf"]["related_note"], got["Papers/a.pdf"]["resolution_source"], got["Papers/a.pdf"]["query_text"]) == ("n/My Note.md", "pdf-text", "My Note Of things")
    assert got["Papers/é.pdf"]["related_note"] is None and got["Papers/b.pdf"]["related_note"] == "n/src.md"
    links = {r["pdf_path"]: (r["note_path"], r["tier"]) for r in identity.link_pdfs(pdfs, notes).collect()}
    assert links == {"Papers/a.pdf": ("n/My Note.md", 2), "Papers/b.pdf": ("n/src.md", 3), "Papers/c.pdf": ("n/src.md", 3)}
    plan = identity.link_pdfs(pdfs, notes)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_old_highlights_go_with_admission(spark):
    marks, fresh = spark.createDataFrame([("a", 1), ("b", 2)], "pdf string, n int"), spark.createDataFrame([("a", "7"), ("a", "8")], "pdf string, id string")
    assert [r["pdf"] for r in queues.without_old_highlights(marks, fresh).collect()] == ["b"]


def folded_spans(spark, cases, threshold=0.55):
    """Spans by match_spans for (needle, texts); the index of an item is its place."""
    rows = [(k, n, [(i, t) for i, t in enumerate(ts)]) for k, (n, ts) in enumerate(cases)]
    quotes = spark.createDataFrame(rows, "k int, needle string, items array<struct<idx int, text string>>")
    got = {r["k"]: tuple(r)[2:] for r in matching.match_spans(quotes, threshold).collect()}
    return [got[k] if got[k][0] is not None else None for k in range(len(cases))]


def test_folded_matches_equal_a_plain_version(spark):
    import random

    from plain_matching import find_folded

    rng = random.Random(11)
    signs = ["a", "b", "c", "B", "é", "É", "ß", "ﬁ", "Ǆ", "½", "\u00ad", " ", "  ", "\t", "\u00a0", "\ufeff", "\u2028", ".", ",", ")", "”", "日", "각", "İ", "Σ", "😀", "1", "-"]
    word = lambda: "".join(rng.choice(signs[:4] if rng.random() < 0.6 else signs) for _ in range(rng.randint(1, 9)))
    cases = []
    for _ in range(400):
        texts = [" ".join(word() for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 5))]
        whole = " ".join(texts)
        a = rng.randint(0, max(len(whole) - 1, 0))
        quote = whole[a : a + rng.randint(3, 40)]
        for _ in range(rng.choice([0, 1, 1, 3])):
            k = rng.randint(0, len(quote))
            quote = quote[:k] + rng.choice(signs) + quote[k + rng.randint(0, 1) :]
        cases.append((rng.choice([quote, quote.upper(), "Zq" + quote[2:], quote + " xyxyxy"]), texts))
    got = folded_spans(spark, cases)
    seen = set()
    for (needle, texts), g in zip(cases, got, strict=True):
        joined = " ".join(texts)
        if needle.strip() and (needle in joined or (len(joined.lower()) == len(joined) and needle.lower() in joined.lower())):
            continue  # an exact hit
        want = find_folded(needle, texts)
        assert (g is None) == (want is None) and (g is None or g[:4] == want[:4] and g[4] == pytest.approx(want[4])), (needle, texts)
        seen.add(want and want[4])
    assert {None, 1.0, 0.85, 0.8} <= seen and len(seen) > 20


def test_python_only_scores_windows(spark):
    quotes = spark.createDataFrame([("a", [(0, "b")])], "needle string, items array<struct<idx int, text string>>")
    plan = matching.match_spans(quotes)._jdf.queryExecution().optimizedPlan().toString()
    sent = [line for line in plan.split("\n") if "ArrowEvalPython" in line]
    assert len(sent) == 1 and "told" in sent[0] and "items" not in sent[0].split("[", 1)[1].split("]")[0] and "Union" not in plan


def test_folded_strings_fold_to_themselves():
    from lectern.functions.folding import fold_table

    table = fold_table()
    assert not [c for c, f in table.items() if any(x in table for x in f)]


def test_matches_with_thresholds_and_neighbours(spark):
    assert folded_spans(spark, [("hello world foo XXXXXXXX", ["hello world foo", "bar baz"])], 0.9) == [None]
    assert folded_spans(spark, [("hello world foo XXXXXXXX", ["hello world foo", "bar baz"])])[0][4] == 0.85
    assert folded_spans(spark, [("zz", ["a"]), (None, ["abc"]), ("abc", [])]) == [None] * 3
    lines = items(spark, [(1, "first page text", 10), (2, "a quoted sentence stands here", 10)])
    quote = spark.createDataFrame([("q", "d", 1, "quoted sentence", "p.pdf"), ("n", "d", 1, "qqqq wwww zzzz", "p.pdf")], "id string, doc_id string, page_num int, exact_text string, file_name string")
    got = {r["id"]: r for r in matching.anchors(quote, lines).collect()}
    assert (got["q"]["match_page"], got["q"]["score"], got["q"]["link"]) == (2, 1.0, "[[p.pdf#page=2]]")
    assert (got["n"]["match_page"], got["n"]["score"], got["n"]["begin_index"]) == (1, 0.0, None)
    assert matching.stored(matching.anchors(quote, lines)).count() == 1


def test_exact_spans_by_expression(spark):
    rows = [
        ("over two", "world again", ["hello world", "again and", "again"]), ("other case", "HELLO", ["", "say hello"]), ("none", "absent", ["hello"]), ("blank", " ", ["a b"]), ("no items", "a", []),
        ("null", None, ["a"]), ("null text", "b", [None, "ab"]),
    ]
    quotes = spark.createDataFrame([(k, n, [(10 + i, t) for i, t in enumerate(ts)]) for k, n, ts in rows], "k string, needle string, items array<struct<idx int, text string>>")
    got = {r["k"]: tuple(r)[2:] for r in matching.match_spans(quotes).collect()}
    assert got["over two"] == (10, 6, 11, 5, 1.0) and got["other case"] == (11, 4, 11, 9, 1.0) and got["null text"] == (11, 1, 11, 2, 1.0)
    assert all(got[k] == (None,) * 5 for k in ("none", "blank", "no items", "null"))
    sent = next(line for line in matching.match_spans(quotes)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "ArrowEvalPython" in line)
    assert "isnull(told" in sent and "usable" in sent  # rows with an exact hit are not usable for it


def test_window_scores_equal_sets():
    import random

    rng = random.Random(1)
    grams = lambda s: {s[i : i + 3] for i in range(len(s) - 2)}
    for _ in range(50):
        page, needle = ("".join(rng.choice("ab c") for _ in range(rng.randint(lo, 60))) for lo in (30, 6))
        needle = needle[:25]
        want = [len(grams(page[i : i + len(needle)]) & grams(needle)) / len(grams(page[i : i + len(needle)]) | grams(needle)) for i in range(len(page) - len(needle) + 1)]
        assert matching.window_scores(page, needle).tolist() == pytest.approx(want)


def test_every_candidate_has_a_similarity(spark):
    docs = spark.createDataFrame([(1, "cooking recipes pasta pizza"), (2, "machine learning is great"), (3, ""), (4, None)], "doc_id int, text string")
    queries = spark.createDataFrame([("q", "machine learning is great"), ("empty", ""), ("far", "quantum entanglement")], "query_id string, text string")
    got = {(r["query_id"], r["doc_id"]): r["sim"] for r in tfidf.similarities(queries, docs).collect()}
    assert len(got) == 12 and got["q", 2] == pytest.approx(1.0) and got["q", 1] == got["empty", 2] == got["far", 1] == got["q", 3] == got["q", 4] == 0.0
    cards = spark.createDataFrame([("q", 1, 0.0, 90), ("q", 2, 0.5, 0)], "query_id string, doc_id int, sim double, citations int")
    assert {r["doc_id"]: round(r["final"], 6) for r in tfidf.blend(cards, ["query_id"]).collect()} == {1: 0.3, 2: 0.35}


def test_owner_needs_containment(spark):
    sections = spark.createDataFrame([("d", "s1", 1, 0, 120), ("d", "s2", 2, 121, 260), ("d", "s3", 3, 261, 420)], "doc_id string, id string, ordinal int, char_start int, char_end int")
    inner = spark.createDataFrame([("d", "f1", 210, 320), ("d", "f2", 130, 140)], "doc_id string, id string, char_start int, char_end int")
    assert {r["id"]: r["owner_id"] for r in planner.owning_section(inner, sections).collect()} == {"f1": None, "f2": "s2"}


def test_block_is_replaced_once_by_position(spark):
    block = report.summary_block(F.lit("New $$x$$ $& \\1"), F.lit("low"), F.lit("m"), F.lit("t"))
    once = report.upsert_block(F.lit("Note"), block)
    again = report.upsert_block(once, report.summary_block(F.lit("Two $$y$$"), F.lit("low"), F.lit("m"), F.lit("t")))
    out = value(spark, again)
    assert out.startswith("Note\n\n" + report.START) and out.count(report.START) == 1 and "$$y$$" in out and "$$x$$" not in out
    assert value(spark, report.upsert_block(F.lit("Note"), F.lit(""))) == "Note"
    assert value(spark, report.upsert_block(F.lit(" "), F.lit("B"))) == "B\n"


def test_report_orders_fixed_sections_first(spark):
    rows = [("d", 0, "t", "other", "Custom", "x", "[[l]]"), ("d", 1, "t", "experiment", None, "y", "[[l]]"), ("d", 2, "t", "abstract", None, "z", "[[l]]")]
    out = report.render_report(spark.createDataFrame(rows, "doc_id string, pos int, type string, section_tag string, heading_text string, exact_text string, link string")).first()["report"]
    assert out.index("### Abstract") < out.index("### Experiment") < out.index("### Custom")


def test_templates_keep_unknown_names(spark):
    paper = spark.createDataFrame([("i", 'A "t"', ["X \"Y\""], "2020-01-01", "l1\n\nl2")], "id string, title string, authors array<string>, published string, abstract string")
    out = paper.select(citations.note_from_template(F.lit("{{arxiv_id}}|{{title_frontmatter}}|{{authors_yaml}}|{{abstract}}|{{pdf_file}}|{{constructor}}|{{what}}"), F.lit("p.pdf")).alias("v")).first()["v"]
    assert out == "i|A 't'|  - \"X 'Y'\"|l1 l2|p.pdf|{{constructor}}|{{what}}"


def test_ieee_and_presets(spark):
    r = spark.createDataFrame([("T", ["A B", "C D", "E F", "G H"], 0, "2301.1", None, None, None, None)], "title string, authors array<string>, year int, arxiv_id string, doi string, venue string, entry_type string, url string")
    assert r.select(citations.ieee(F.lit(2)).alias("v")).first()["v"] == '[2] A. B et al., "T", in *arXiv:2301.1*, n.d..'
    entry = r.select(citations.bibtex(F.lit("icml")).alias("v")).first()["v"]
    assert entry.startswith("@inproceedings{b0000paper") and citations.VENUES["icml"] in entry and "year" not in entry
    assert r.select(citations.custom(F.lit("{title} {year}{x}")).alias("v")).first()["v"] == "T {x}"
    out = citations.export_text(spark.createDataFrame([(2, "b", ["year"]), (1, "a", [])], "pos int, entry string, missing array<string>")).first()["output"]
    assert out == "a\n\n% missing: year\nb"


def test_draft_merges_in_heading_order(spark):
    headings = spark.createDataFrame([("b", 1, "B", "none yet"), ("a", 0, "A", "none yet"), ("f", 2, "F", None)], "heading string, heading_pos int, title string, filler string")
    blocks = spark.createDataFrame([("d", "a", 2, "two"), ("d", "a", 1, "one")], "doc_id string, heading string, seq int, markdown string")
    assert planner.merge_draft(blocks, headings).first()["draft"] == "## A\none\n\ntwo\n\n## B\nnone yet"
    focus = spark.createDataFrame([("d", ["first", "then"]), ("e", []), ("f", ["alone"])], "doc_id string, entries array<string>")
    got = {r["doc_id"]: r["draft"] for r in planner.merge_draft(blocks, headings, focus, map_heading="a").collect()}
    assert got == {"d": "## A\n> [!tip] Reading map\n- first\n- then\n\none\n\ntwo\n\n## B\nnone yet", "f": "## A\n> [!tip] Reading map\n- alone\n\n## B\nnone yet"}


def test_placeholders(spark):
    drafts = spark.createDataFrame([("d", "x {{image:image:1:ab}} y {{image:2:cd}} z {{image:none}}"), ("e", "plain")], "doc_id string, draft string")
    images = spark.createDataFrame([("d", "image:1:ab", "![a](u)"), ("d", "image:2:cd", "![b](v)")], "doc_id string, id string, content string")
    assert {r["doc_id"]: r["draft"] for r in planner.replace_image_placeholders(drafts, images).collect()} == {"d": "x ![a](u) y ![b](v) z ", "e": "plain"}


def test_rectangles_merge_to_percent(spark):
    schema = "page_id int, pos int, left double, right double, top double, bottom double, text string"
    rects = spark.createDataFrame([(1, 0, 0.0, 10.0, 0.0, 10.0, "abc"), (1, 1, 12.0, 20.0, 0.0, 10.0, "def"), (1, 2, 50.0, 60.0, 0.0, 10.0, "∑∫"), (1, 3, 0.0, 30.0, 40.0, 50.0, "next line"), (1, 4, 5.0, 5.0, 0.0, 9.0, "flat")], schema)
    page = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0)], "page_id int, page_left double, page_top double, page_width double, page_height double")
    got = geometry.merged_rows(rects, page).orderBy("row_no", "cluster_no").collect()
    assert [(r["text"], r["left"], r["width"], r["top"], r["height"]) for r in got] == [("abcdef", 0.0, 20.6, 0.0, 10.0), ("next line", 0.0, 30.6, 40.0, 10.0)]


def test_highlights_and_provider_stub(spark):
    calls = spark.createDataFrame([("a", "mark", "A sentence that is long enough. More.", 10), ("b", "", "x", 10)], "id string, system string, user string, max_tokens int")
    answered = files.call_provider(calls, files.stub_provider, parallel=2)
    got = responses.parse_highlights(answered.select("id", "body")).collect()
    assert [(r["id"], r["exact_text"]) for r in got] == [("a", "A sentence that is long enough.")]
    bad = spark.createDataFrame([("1", "{oops"), ("2", '{"highlights":[{"exact_text":"short","type":"x"},{"exact_text":5,"type":"x"},{"type":"x"}]}')], "id string, body string")
    assert responses.parse_highlights(bad).count() == 0


def test_source_leak_and_language(spark):
    source = "word " * 60
    assert value(spark, rules.is_source_leak(F.lit(source), F.lit(source))) is True
    assert value(spark, rules.is_insufficient(F.lit("An own account, quite different. " * 3), F.lit(source))) is False
    assert value(spark, rules.is_insufficient(F.lit("An own account, quite different. " * 3), F.lit(source), "zh-CN")) is True


def test_notes_are_split_and_parsed(spark):
    raw = spark.createDataFrame([("v/N one.md", "---\ntags: [a, '#B']\ndoi: 10.1000/x\n---\nBody #Inline\n```\n#no\n```"), ("v/two.md", "plain"), ("v/bad.md", "---\n: [\n---\nx")], "path string, value string")
    notes = files.with_frontmatter(raw.select(*files.split_note(F.col("path"), F.col("value"))))
    got = {r["basename"]: r for r in notes.collect()}
    assert got["N one"]["frontmatter"]["doi"] == "10.1000/x" and list(got["N one"]["inline_tags"]) == ["Inline"] and got["two"]["frontmatter"] == {} and got["bad"]["frontmatter"] == {}
    assert {r["tag"] for r in identity.tag_histogram(notes).collect()} == {"a", "b", "inline"} and identity.tagged(notes, "#B").count() == 1


def test_throttle_stream_equals_batch(spark, tmp_path):
    events = fixtures.table(spark, "throttle")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    out = queues.throttle_stream(stream, "k").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(90)
    key = lambda r: r["pos"]
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=key) == sorted(queues.throttle_trace(events, "k").collect(), key=key)


def test_sessions_of_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT 'u' AS k, timestamp_millis(t) AS ts FROM VALUES (0L), (100L), (1000L), (600000L) AS v(t)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    q = queues.debounce_stream(stream, "k", "ts").writeStream.format("memory").queryName("sessions").trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert sorted(r["n"] for r in spark.table("sessions").collect()) == [1, 2]


def test_queue_helpers(spark):
    q = spark.createDataFrame([("1", "a", "running", 1), ("2", "b", "pending", 2), ("3", "c", "odd", 3), (None, "d", "done", 4)], "id string, pdf string, status string, added_at int")
    assert queues.next_job(q).count() == 0
    again = queues.recover(q)
    assert queues.next_job(again).first()["id"] == "1" and again.count() == 2
    assert queues.clear_done(q).count() == 3
    starts = queues.paced(spark.createDataFrame([(0, 0), (1, 100), (2, 9000)], "pos int, ts_ms int")).orderBy("pos").collect()
    assert [r["start_ms"] for r in starts] == [0, 3000, 9000]


def test_sources_are_fetched_by_policy(spark):
    pages = {
        "https://huggingface.co/papers/2301.00001.md": (404, "no"), "https://arxiv.org/html/2301.00001": (503, "busy"), "https://ar5iv.labs.arxiv.org/html/2301.00001": (200, "<html><body><main><h1>T</h1><p>Body</p></main></body></html>"),
        "https://r.jina.ai/https://arxiv.org/pdf/2301.00001": (200, "plain\r\n\n\n\ntext"), "https://huggingface.co/papers/2301.00002.md": (200, "  "), "https://r.jina.ai/https://arxiv.org/pdf/2301.00002": (200, "<!DOCTYPE html><html><body><article><h1>R</h1></article></body></html>"),
    }

    def fetch(url, headers):
        if url not in pages:
            raise OSError("unreachable")
        return pages[url]

    papers = spark.createDataFrame([("a", "2301.00001", "p"), ("b", "2301.00002", "p"), ("c", None, "from the PDF")], "paper_id string, arxiv_id string, pdf_text string")
    got = {r["paper_id"]: r for r in remote.paper_sources(papers, fetch).collect()}
    assert got["a"]["kind"] == "ar5iv-html" and got["a"]["text"].startswith("# T\n") and got["a"]["text"].endswith("\n\nBody") and [x["status"] for x in got["a"]["attempts"]] == ["skipped", "error", "success", "success"]
    assert got["b"]["kind"] == "jina-reader" and got["b"]["text"].startswith("# R") and got["b"]["attempts"][1]["reason"].startswith("Source request returned 0: unreachable")
    assert (got["c"]["kind"], got["c"]["text"]) == ("pdf", "from the PDF")


def test_graph_is_fetched_again_without_a_rejected_key(spark):
    import json

    answer = json.dumps({"data": [{"citingPaper": {"paperId": "x", "title": "T", "authors": [{"name": "A"}], "externalIds": {"ArXiv": "2301.00009"}}}, {"citingPaper": None}]})

    def fetch(url, headers):
        if headers or "limit=7" not in url:
            return 403, "no"
        return (200, answer) if "ArXiv:2301.1" in url else (200, "not json") if "bad" in url else (500, "")

    papers = spark.createDataFrame([("arxiv:2301.1",), ("bad",), ("down",)], "paper_id string")
    (row,) = remote.fetch_graph(papers, fetch, most=7, key="k").collect()
    assert (row["paper_id"], row["record"]["id"], row["record"]["url"], row["record"]["year"]) == ("arxiv:2301.1", "x", "https://arxiv.org/abs/2301.00009", 0)
    assert remote.fetch_graph(papers, fetch, "references", 7).count() == 0


def test_downloads_are_idempotent(spark):
    papers = spark.createDataFrame([(1, "2301.1", "One"), (2, "2301.2", "Two"), (3, "2301.3", "Two"), (4, "gone", "Four"), (5, None, "Five")], "paper_id int, arxiv_id string, title string")
    files = spark.createDataFrame([("Papers/One.pdf",)], "path string")
    fetch = lambda url: (404, b"") if url.endswith("gone") else (200, b"%PDF")
    got = sorted((r["path"], r["step"]) for r in remote.downloads(papers, files, fetch, F.lit("Papers/")).collect())
    assert got == [("Papers/Four.pdf", "failed"), ("Papers/One.pdf", "kept"), ("Papers/Two.pdf", "fetched")]
    assert {r["step"] for r in remote.downloads(papers, files, fetch, F.lit("Papers"), overwrite=True).collect()} == {"fetched", "failed"}


def test_pdf_of_a_note(spark):
    notes = spark.createDataFrame([note("n/a.md", {"pdf_file": "[[x.pdf|shown]]"}), note("n/b.md", {}, "see ![[pic.png]] and ![[deep.pdf]]"), note("n/c.md"), note("n/d.md", {"pdf_file": "Papers/y.pdf"}), note("n/e.md", {"pdf_file": "none.pdf"})], NOTE)
    pdfs = spark.createDataFrame([("Papers/x.pdf", "x.pdf"), ("z/long/deep.pdf", "deep.pdf"), ("z/deep.pdf", "deep.pdf"), ("Papers/c.pdf", "c.pdf"), ("Papers/y.pdf", "y.pdf")], "path string, name string")
    found = identity.summary_pdf(identity.pdf_candidates(notes, pdfs, "Papers/"))
    assert {r["note_path"]: r["pdf_path"] for r in found.collect()} == {"n/a.md": "Papers/x.pdf", "n/b.md": "z/deep.pdf", "n/c.md": "Papers/c.pdf", "n/d.md": "Papers/y.pdf"}
    assert [value(spark, identity.is_graph_file(F.lit(p))) for p in ("a/b.MD", "c.pdf", "d.png", "e")] == [True, True, False, False]


def test_blank_template_is_the_default(spark):
    paper = spark.createDataFrame([("2301.1", 'A "t"', ["X"], "2020-01-01", "a")], "id string, title string, authors array<string>, published string, abstract string")
    out = paper.select(citations.note_from_template(F.lit("  "), F.lit("p.pdf")).alias("v")).first()["v"]
    assert out == "\n---\narxiv_id: \"2301.1\"\ntitle: \"A 't'\"\npublished: \"2020-01-01\"\npdf_file: \"[[p.pdf]]\"\ntags:\n  - summary\ntype:\n  - paper\n---\n"


def test_nets_name_the_section(spark):
    out = value(spark, cascade.formula_net(F.lit("$$ a=b $$"), F.lit("Method"), F.lit("how it works")))
    assert out.split("\n\n")[0] == "$$ a=b $$" and '> This formula appears in **Method** and is directly tied to "how it works".' in out


def test_second_calls(spark):
    import json

    def call(system, user, tokens):
        whole = json.dumps({"markdown": "the whole answer " * 3})
        text = whole if user == "fine" or tokens > 100 else whole[:20]
        return 200, json.dumps({"choices": [{"finish_reason": "stop" if text == whole else "length", "message": {"content": text}}]})

    requests = spark.createDataFrame([("a", "openai", "s", "fine", 100), ("b", "openai", "s", "long", 100)], "id string, provider string, system string, user string, max_tokens int")
    got = {r["id"]: (r["tries"], responses) for r in cascade.call_with_retry(requests, call).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": 1, "b": 2}


def test_summary_source(spark):
    chunks = spark.createDataFrame([("d", 1, "method", None, "m"), ("d", 0, "other", "Own", "o"), ("d", 2, "other", None, "x")], "doc_id string, pos int, section_tag string, heading_text string, text string")
    assert report.summary_source("T", chunks).first()["source"] == "# T\n\n### Own\no\n\n### Method\nm\n\n### Other\nx"


def test_anchors_of_a_page(spark):
    found = spark.createDataFrame([("d", 1, 5, 0), ("d", 1, 2, 3), ("d", 2, 0, 0), ("e", 1, 0, 0)], "doc_id string, match_page int, begin_index int, begin_offset int")
    assert [r["begin_index"] for r in matching.on_page(found, F.lit("d"), F.lit(1)).collect()] == [2, 5]


def test_notes_are_read_from_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: T\n---\nBody #x", encoding="utf-8")
    (tmp_path / "b.txt").write_text("no note", encoding="utf-8")
    got = files.read_notes(spark, str(tmp_path)).collect()
    assert [(r["basename"], r["frontmatter"]["title"]) for r in got] == [("a", "T")]


def test_request_parts(spark):
    got = lambda c: value(spark, c)
    assert [got(responses.chosen_provider(F.lit("https://api.openai.com/v1"), F.lit(s))) for s in ("anthropic", "openai", "auto", None)] == ["anthropic", "openai", "openai", "openai"]
    assert [got(responses.request_url(F.lit("anthropic"), F.lit(u))) for u in ("https://a.b", "https://a.b/v1/", "https://a.b/x/Messages")] == ["https://a.b/v1/messages", "https://a.b/v1/messages", "https://a.b/x/Messages"]
    assert got(responses.request_url(F.lit("openai"), F.lit("https://a.b/v1/"))) == "https://a.b/v1/chat/completions"
    assert got(responses.request_headers(F.lit("anthropic"), F.lit("k"))) == {"Content-Type": "application/json", "x-api-key": "k", "anthropic-version": "2023-06-01"}
    assert got(responses.request_headers(F.lit("openai"), F.lit("k"))) == {"Content-Type": "application/json", "Authorization": "Bearer k"}
    thinking = got(responses.request_body(F.lit("openai"), F.lit("m"), F.lit("s"), F.lit("u"), F.lit(9), F.lit(0.2), as_json=False, thinking=True))
    assert '"enable_thinking":true,"thinking_budget_tokens":512' in thinking and "response_format" not in thinking


def test_answers_that_need_repair(spark):
    answers = spark.createDataFrame([("short", "Too short.", "source"), ("good", "An own account of the matter, long enough and quite different from it. " * 2, "source"), ("copy", "word " * 60, "word " * 60)], "id string, text string, content string")
    assert {r["id"] for r in cascade.needs_repair(answers).collect()} == {"short", "copy"}


def test_calls_are_repeated_after_pauses(spark, tmp_path):
    def call(system, user, tokens):
        if user == "down":
            raise OSError("Network unreachable")
        if user == "bad":
            raise ValueError("no such model")
        return (503 if user == "busy" else 200), "x"

    log = str(tmp_path / "waits")

    def wait(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds} ")

    requests = spark.createDataFrame([(u, "s", u, 1) for u in ("fine", "down", "bad", "busy")], "id string, system string, user string, max_tokens int")
    got = {r["id"]: (r["status"], r["attempts"]) for r in files.call_provider(requests, call, 1, wait=wait).collect()}
    assert got == {"fine": (200, 1), "down": (0, 4), "bad": (0, 1), "busy": (503, 4)}
    assert sorted(open(log).read().split()) == sorted(["1.0", "2.0", "4.0"] * 2)


def test_tables_are_replaced_only_if_they_differ(spark, tmp_path):
    path = str(tmp_path / "settings")
    one, two = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2)], "k string, v int")
    assert files.save_if_changed(one, path) and not files.save_if_changed(one, path) and files.save_if_changed(two, path)
    assert [tuple(r) for r in files.current_table(spark, path).collect()] == [("a", 2)]
