"""Small literal tables for operators that the driver's tables have no input for, and the rows they must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BODY = "Body text that goes on."
EXPLAINED = "This section sets out why the method works and what each of its steps adds."
METHOD = "We describe the method in detail here."

#: name: (schema, rows)
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "arxiv_inputs": ("input string", [("https://arxiv.org/abs/2303.08774v2",), ("https://arxiv.org/pdf/2303.08774",), ("2301.123456",), ("https://arxiv.org/abs/cs/0610101",), ("cs/0610101",), ("not-an-arxiv-url",), ("",), ("see 10.1145/1234567.8901234",)]),
    "identity_inputs": ("input string", [("DOI: 10.1145/1234567.8901234",), ("https://doi.org/10.1000/xyz-123.",), ("arXiv:2303.08774 and doi 10.1/x",), ("as in 2303.08774",), ("arXiv: cs/0610101",), ("nothing here",)]),
    "graph": (
        "paperId string, title string, authors array<struct<authorId:string,name:string>>, year int, abstract string, citationCount int, openAccessPdf struct<url:string>, externalIds struct<ArXiv:string,DOI:string>",
        [
            ("p1", "One", [("1", "A"), ("2", "B")], 2020, "abs", 5, ("https://pdf/1",), ("2001.00001", "10.1/a")),
            ("p2", "Two", [("1", "A")], 2021, "abs", 0, ("",), ("2001.00002", "10.1/b")),
            ("p3", "Three", [], 2022, None, 7, None, (None, "10.1/c")),
            ("p4", None, None, None, None, None, None, None),
        ],
    ),
    "notes": (
        "path string, name string, basename string, ext string, frontmatter map<string,string>, body string, inline_tags array<string>",
        [
            ("Notes/a.md", "a.md", "a", "md", {"arXiv": "https://arxiv.org/abs/2303.08774v2", "title": "Deep Nets", "authors": "Ada Lovelace, Bob (Lab, X)", "year": "2023", "tags": "ML, #Summary"}, "", ["ml"]),
            ("Notes/b.md", "b.md", "b", "md", {"pdf_file": "[[Linked Paper.pdf]]", "arxiv": "2301.00001"}, "", None),
            ("Notes/c.md", "c.md", "c", "md", {"source": "https://doi.org/10.1000/xyz-123", "doi": "10.1000/xyz-123", "published": "May 2019", "venue": "J"}, "", []),
            ("Notes/d.md", "d.md", "d", "md", {"title": "twin"}, "cites doi 10.1000/abc.", []),
            ("Notes/twin.md", "twin.md", "twin", "md", {}, "no id", []),
            ("Notes/e.md", "e.md", "e", "md", {"title": "Twin"}, "none", []),
        ],
    ),
    "pdfs": (
        "path string, name string, basename string, preview string",
        [
            ("Papers/Linked Paper.pdf", "Linked Paper.pdf", "Linked Paper", "arXiv:1111.11111"),
            ("Papers/Free.pdf", "Free.pdf", "Free", "DOI: 10.1145/1234567.8901234"),
            ("Papers/Twin.pdf", "Twin.pdf", "Twin", "nothing"),
            ("Papers/Deep_Nets.pdf", "Deep_Nets.pdf", "Deep-Nets", ""),
        ],
    ),
    "atom": (
        "k int, xml string",
        [
            (1, "<feed xmlns='http://www.w3.org/2005/Atom'><entry><id>http://arxiv.org/abs/2303.08774v1</id><title> A Title </title><summary>S</summary><published>2023-03-15T00:00:00Z</published><author><name>Ann A</name></author><author><name> </name></author><author><name>Bo B</name></author><link title='pdf' href='http://arxiv.org/pdf/2303.08774v1'/></entry></feed>"),
            (2, "<feed xmlns='http://www.w3.org/2005/Atom'><title>none</title></feed>"),
            (3, "<feed><entry><id>odd</id><title>T</title><summary/><published>2020</published></entry></feed>"),
        ],
    ),
    "headings": ("h string", [("1. Introduction",), ("Related Work",), ("Methods",), ("method",), ("7. References",), ("Appendix A",), ("Acknowledgments",), ("Figure 1: Overview",), ("tbl. 3",), ("Conclusion",), ("References to this",)]),
    "formulas": ("f string", [("$x$",), ("$$E = mc^2$$",), ("$alpha_i$",), ("\\[\\frac{a}{b}\\]",), ("$abc$",), ("$f(x, y, z)$",), ("$p(x)$",), ("$x^{abc}$",)]),
    "markdown": (
        "doc_id string, markdown string",
        [
            ("paths", "# Title\nIntro text\n## Method\nBody\n### Details\nDeep"),
            ("plain", "no headings"),
            ("mixed", f"# Paper\n\n{BODY}\n\n![alt text](http://x/fig.png)\n\nFigure 1: An overview of it.\n\n## Method\n\n{METHOD}\n\n$$E = mc^2$$"),
            ("jump", "# A\na\n### B\nb\n### C\nc"),
            ("late", "## X\nx"),
            ("empty", " \n"),
        ],
    ),
    "plan_sections": (
        "doc_id string, id string, kind string, ordinal int, section_path array<string>, excerpt string, char_start int, char_end int, content string",
        [
            ("p", "s1", "section", 1, ["Paper", "Introduction"], "why", 0, 100, "why"),
            ("p", "s2", "section", 2, ["Paper", "Approach"], "how", 100, 200, "how"),
            ("p", "s3", "section", 3, ["Paper", "Evaluation"], "what", 200, 300, "what"),
            ("p", "s4", "section", 4, ["Paper", "References"], "refs", 300, 400, "refs"),
            ("q", "only", "section", 1, ["References"], "r", 0, 10, "r"),
        ],
    ),
    "failures": (
        "status int, body string",
        [
            (429, '{"error":{"message":"slow down","type":"rate_limit"}}'),
            (503, '{"error":{"message":"server busy"},"request_id":"r-1"}'),
            (503, '{"error":{"message":"maintenance"}}'),
            (529, "{}"),
            (500, "plain text"),
            (400, '{"error":{"message":"overloaded","request_id":"r-2"}}'),
            (400, '{"id":"msg_1","error":{"detail":"quota used up","meta":{"Request-Id":"r9"}}}'),
            (500, '{"error":"plain","error_description":" told twice "}'),
        ],
    ),
    "responses": (
        "k int, provider string, body string",
        [
            (1, "anthropic", '{"content":[{"type":"text","text":"<think>hm</think>Hi"},{"type":"text","text":"there"}],"stop_reason":"max_tokens"}'),
            (2, "openai", '{"choices":[{"finish_reason":"stop","message":{"content":"Hello"}}]}'),
            (3, "openai", '{"choices":[{"finishReason":"length","message":{"content":["a","b"]}}]}'),
            (4, "openai", "not json"),
            (5, "anthropic", '{"content":[]}'),
        ],
    ),
    "raw_answers": (
        "k int, raw string",
        [(1, '{"markdown":"Hello"}'), (2, '```json\n{"markdown":"In a fence"}\n```'), (3, '{"markdown":"cut off here \\"so'), (4, "Just text"), (5, '{"other":1}'), (6, '[{"a":'), (7, "```\nplain body\n```")],
    ),
    "sse": ("k int, provider string, line string", [(1, "openai", 'data: {"choices":[{"delta":{"content":"ab"}}]}'), (2, "openai", "data: [DONE]"), (3, "openai", ": ping"), (4, "anthropic", 'data: {"type":"content_block_delta","delta":{"text":"cd"}}')]),
    "retries": ("k int, attempt int, after string", [(1, 0, None), (2, 1, None), (3, 9, None), (4, 0, "3"), (5, 0, "60"), (6, 2, "soon")]),
    "quotes": (
        "id string, needle string, items array<struct<idx:int,text:string>>",
        [
            ("exact", "hello world", [(0, "foo bar"), (1, "hello world"), (2, "baz qux")]),
            ("two", "The quick brown fox", [(0, "The quick"), (1, "brown fox")]),
            ("case", "the quick brown fox", [(0, "THE QUICK"), (1, "BROWN FOX")]),
            ("prefix", "hello world foo XXXXXXXX", [(0, "hello world foo"), (1, "bar baz")]),
            ("none", "xyz 12345 completely unrelated", [(0, "apple banana"), (1, "cherry date")]),
            ("inside", "hello world", [(0, "prefix hello world")]),
            ("dash", "end to end pipeline", [(0, "prefix end-to-end pipeline")]),
            ("hyphen", "algorithm", [(0, "prefix algo­rithm")]),
            ("joined", "models typically excel at this", [(0, "models typicallyexcel at this")]),
            ("blank", "  ", [(0, "hello")]),
        ],
    ),
    "throttle": ("k string, pos long, ts_ms long, kind string, retry_after_ms long", [("a", 0, 100_000, "overload", None), *[("a", i, 100_000 + i, "success", None) for i in range(1, 6)], *[("a", i, 115_000 + i, "success", None) for i in range(6, 11)], *[("a", i, 125_020 + i, "success", None) for i in range(11, 16)]]),
    "queue_events": (
        "queue string, seq long, pdf string, id string, event string",
        [
            ("q", 1, "a", "1", "enqueue"), ("q", 2, "a", "2", "enqueue"), ("q", 3, "a", "1", "start"), ("q", 4, "a", "1", "finish"), ("q", 5, "a", "3", "enqueue"), ("q", 6, "b", "4", "enqueue"), ("q", 7, "b", "4", "start"),
            ("q", 8, "b", "4", "cancel"), ("q", 9, "c", "5", "enqueue"), ("q", 10, "c", "5", "finish"), ("q", 11, "a", "3", "start"), ("q", 12, "a", "3", "restart"), ("q", 13, "d", "6", "enqueue"), ("q", 14, "d", "6", "fail"), ("q", 15, "", "", "clear"),
            ("r", 1, "x", "1", "enqueue"), ("r", 2, "y", "2", "enqueue"), ("r", 3, "x", "1", "start"), ("r", 4, "y", "2", "start"), ("r", 5, "x", "1", "finish"), ("r", 6, "y", "2", "start"), ("r", 7, "y", "2", "fail"), ("r", 8, "z", "3", "enqueue"), ("r", 9, "z", "3", "start"),
        ],
    ),
    "titles": ("title string", [("A/B: C?",), ("  two\nlines ",), ("x" * 120,)]),
    "attempts": ("paper_id string, priority int, kind string, status int, text string", [("p", 1, "hf-markdown", 404, None), ("p", 2, "arxiv-html", 404, None), ("p", 3, "ar5iv-html", 200, "text"), ("p", 4, "reader", 200, "other"), ("q", 1, "hf-markdown", 200, "  "), ("q", 5, "pdf", 200, "pdf text")]),
    "answers": (
        "id string, text string, label string, content string",
        [("good", '{"markdown":"' + EXPLAINED + '"}', "M", "Source."), ("leak", "word " * 40, "L", "word " * 40), ("lost", "short", "S", "The  source text.")],
    ),
    "repairs": ("id string, text string", [("leak", EXPLAINED), ("lost", "no")]),
    "import_inputs": ("k int, url string, pdf_url string, id string", [(1, "https://arxiv.org/abs/2301.00001", None, "x"), (2, "https://doi.org/10.1/x", "https://arxiv.org/pdf/2302.00002", "x"), (3, "https://x.org", None, "arxiv:2303.00003"), (4, "https://x.org", None, "abc")]),
    "settings": ("k int, color string, names array<string>, effort string", [(1, " #FFF ", [" arxiv", "ArXiv", "", "id"], "high"), (2, "#12AB34", [" "], "extreme"), (3, "red", [], None)]),
    "prose": ("k int, s string", [(1, "# H\n> quote *b* [l](u) ![i](v)\n\n\n\n```\ncode\n``` end"), (2, "$x+y$\nword"), (3, "word")]),
    "abstract_docs": ("doc_id string, markdown string", [("a", "# T\nFirst.\n## Abstract\nThe  abstract\ntext."), ("b", "# T\n\nOnly paragraph here.")]),
    "urls": ("url string", [("https://api.anthropic.com/v1/messages",), ("https://api.openai.com/v1/chat/completions",), ("https://claude.example.org/",), ("http://localhost:8080/v1//",)]),
    "picks": ("id string, body string", [("q", '```json\n{"recommendations":[{"paperId":"p1","reason":"r"},{"reason":"no id"},{"paperId":"p2"}]}\n```'), ("z", "nothing"), ("y", '[{"paperId":"bare"}]'), ("x", '{"recommendations":[{"paperId":" p3 ","reason":5},{"paperId":4}]}')]),
    "pdf_candidates": ("note_path string, pdf_path string, priority int", [("n", "b.pdf", 2), ("n", "a.pdf", 1), ("m", "c.pdf", 3)]),
    "escapes": ("s string", [("a\\b",), ("50% & {x}_1",), ("~^",)]),
}

T, N = True, None
_LONG = "x" * 100
#: name: (columns, rows)
LOST = "> [!note] This part corresponds to **S** in the paper.\n\nThe safest confirmed focus is: The source text.\n\nFiner technical details still need to be checked against the original section, so this fallback keeps the explanation intentionally minimal."
ANTHROPIC_BODY = '{"model":"m","max_tokens":10,"temperature":0.1,"system":"sys","messages":[{"role":"user","content":[{"type":"text","text":"hi"}]}]}'
OPENAI_BODY = '{"model":"m","max_tokens":10,"temperature":0.1,"enable_thinking":false,"response_format":{"type":"json_object"},"messages":[{"role":"system","content":"sys"},{"role":"user","content":"hi"}]}'
EXPECTED: dict[str, tuple[str, list[tuple]]] = {
    "arxiv_ids": ("input, id", [("https://arxiv.org/abs/2303.08774v2", "2303.08774"), ("https://arxiv.org/pdf/2303.08774", "2303.08774"), ("2301.123456", "2301.123456"), ("https://arxiv.org/abs/cs/0610101", "cs/0610101"), ("cs/0610101", "cs/0610101"), ("not-an-arxiv-url", N), ("", N), ("see 10.1145/1234567.8901234", "4567.890123")]),
    "paper_identities": ("input, id, type", [("DOI: 10.1145/1234567.8901234", "10.1145/1234567.8901234", "doi"), ("https://doi.org/10.1000/xyz-123.", "10.1000/xyz-123", "doi"), ("arXiv:2303.08774 and doi 10.1/x", "2303.08774", "arxiv"), ("as in 2303.08774", "2303.08774", "arxiv"), ("arXiv: cs/0610101", "cs/0610101", "arxiv"), ("nothing here", N, N)]),
    "graph_records": ("id, title, year, citation_count, url, n_authors", [("p1", "One", 2020, 5, "https://pdf/1", 2), ("p2", "Two", 2021, 0, "https://arxiv.org/abs/2001.00002", 1), ("p3", "Three", 2022, 7, "https://doi.org/10.1/c", 0), ("p4", "Untitled", 0, 0, "https://www.semanticscholar.org/paper/p4", 0)]),
    "note_identities": (
        "path, id, type, matched_field, resolution_source, query_text",
        [("Notes/a.md", "2303.08774", "arxiv", "arXiv", "frontmatter", "a Deep Nets"), ("Notes/b.md", "2301.00001", "arxiv", "arxiv", "frontmatter", "b"), ("Notes/c.md", "10.1000/xyz-123", "doi", "doi", "frontmatter", "c"), ("Notes/d.md", "10.1000/abc", "doi", N, "note-text", "d twin")],
    ),
    "note_pdf_links": ("pdf_path, note_path, tier", [("Papers/Linked Paper.pdf", "Notes/b.md", 2), ("Papers/Twin.pdf", "Notes/twin.md", 4), ("Papers/Deep_Nets.pdf", "Notes/a.md", 5)]),
    "pdf_identities": ("path, id, type, resolution_source, related_note", [("Papers/Linked Paper.pdf", "2301.00001", "arxiv", "linked-note", "Notes/b.md"), ("Papers/Free.pdf", "10.1145/1234567.8901234", "doi", "pdf-text", N), ("Papers/Deep_Nets.pdf", "2303.08774", "arxiv", "linked-note", "Notes/a.md")]),
    "tag_counts": ("tag, n", [("ml", 1), ("summary", 1)]),
    "note_records": ("path, title, authors, year, url, missing", [("Notes/a.md", "Deep Nets", "Ada Lovelace; Bob (Lab, X)", 2023, "https://arxiv.org/abs/https://arxiv.org/abs/2303.08774v2", ""), ("Notes/b.md", "b", "Ada Lovelace; Alan Turing", 2023, "https://arxiv.org/abs/2301.00001", ""), ("Notes/c.md", "c", "", 2019, "https://doi.org/10.1000/xyz-123", "authors")]),
    "atom_records": ("k, id, title, authors, published, pdf_url", [(1, "2303.08774", "A Title", "Ann A; Bo B", "2023-03-15", "http://arxiv.org/pdf/2303.08774v1"), (2, N, N, N, N, N), (3, "odd", "T", "", "2020", "https://arxiv.org/pdf/odd")]),
    "heading_tags": ("h, tag, stop, caption", [("1. Introduction", "introduction", False, False), ("Related Work", "related_work", False, False), ("Methods", "other", False, False), ("method", "method", False, False), ("7. References", "other", T, False), ("Appendix A", "other", T, False), ("Acknowledgments", "other", T, False), ("Figure 1: Overview", "other", False, T), ("tbl. 3", "other", False, T), ("Conclusion", "conclusion", False, False), ("References to this", "other", False, False)]),
    "trivial_formulas": ("f, trivial", [("$x$", T), ("$$E = mc^2$$", False), ("$alpha_i$", False), ("\\[\\frac{a}{b}\\]", False), ("$abc$", T), ("$f(x, y, z)$", False), ("$p(x)$", False), ("$x^{abc}$", False)]),
    "markdown_pointers": (
        "doc_id, kind, ordinal, path, excerpt, line_start, char_start, char_end",
        [
            ("paths", "section", 1, "Title", "Intro text", 2, 8, 18), ("paths", "section", 2, "Title > Method", "Body", 4, 29, 33), ("paths", "section", 3, "Title > Method > Details", "Deep", 6, 46, 50),
            ("paths", "paragraph", 1, "Title", "Intro text", 2, 8, 18), ("paths", "paragraph", 2, "Title > Method", "Body", 4, 29, 33), ("paths", "paragraph", 3, "Title > Method > Details", "Deep", 6, 46, 50),
            ("plain", "section", 1, "Document", "no headings", 1, 0, 11), ("plain", "paragraph", 1, "Document", "no headings", 1, 0, 11),
            ("mixed", "section", 1, "Paper", f"{BODY} Figure 1: An overview of it.", 3, 9, 93), ("mixed", "section", 2, "Paper > Method", f"{METHOD} $$E = mc^2$$", 11, 106, 158),
            ("mixed", "paragraph", 1, "Paper", BODY, 3, 9, 32), ("mixed", "paragraph", 2, "Paper", "Figure 1: An overview of it.", 7, 65, 93), ("mixed", "paragraph", 3, "Paper > Method", METHOD, 11, 106, 144),
            ("mixed", "formula", 1, "Paper > Method", "$$E = mc^2$$", 13, 146, 158), ("mixed", "image", 1, "Paper", "Figure 1: An overview of it.", 5, 34, 63),
            ("jump", "section", 1, "A", "a", 2, 4, 5), ("jump", "section", 2, "A > B", "b", 4, 12, 13), ("jump", "section", 3, "A > B > C", "c", 6, 20, 21),
            ("jump", "paragraph", 1, "A", "a", 2, 4, 5), ("jump", "paragraph", 2, "A > B", "b", 4, 12, 13), ("jump", "paragraph", 3, "A > B > C", "c", 6, 20, 21),
            ("late", "section", 1, "Document > X", "x", 2, 5, 6), ("late", "paragraph", 1, "Document > X", "x", 2, 5, 6),
        ],
    ),
    "section_plans": (
        "doc_id, pointer_id, target_heading",
        [
            ("p", "s1", "research_question"), ("p", "s2", "method_breakdown"), ("p", "s3", "experimental_pipeline"), ("p", "s2", "core_intuition"), ("p", "s3", "results_takeaways"), ("p", "s4", "limitations_open_questions"),
            ("q", "only", "research_question"), ("q", "only", "core_intuition"), ("q", "only", "method_breakdown"), ("q", "only", "experimental_pipeline"), ("q", "only", "results_takeaways"), ("q", "only", "limitations_open_questions"),
        ],
    ),
    "failed_calls": (
        "status, body, message, request_id, overloaded, retryable",
        [
            (429, TABLES["failures"][1][0][1], "slow down", N, T, T), (503, TABLES["failures"][1][1][1], "server busy", "r-1", T, T), (503, TABLES["failures"][1][2][1], "maintenance", N, False, T),
            (529, "{}", "{}", N, T, T), (500, "plain text", "plain text", N, False, T), (400, TABLES["failures"][1][5][1], "overloaded", "r-2", False, False),
            (400, TABLES["failures"][1][6][1], "quota used up", "r9", False, False), (500, TABLES["failures"][1][7][1], "told twice", N, False, T),
        ],
    ),
    "response_texts": ("k, text, stop_reason, truncated", [(1, "Hi\nthere", "max_tokens", T), (2, "Hello", "stop", False), (3, "a\nb", "length", T), (4, "{}", N, False), (5, "{}", N, False)]),
    "salvaged_markdown": ("k, markdown, cut", [(1, "Hello", False), (2, "In a fence", False), (3, 'cut off here "so', T), (4, "Just text", False), (5, "", False), (6, "", T), (7, "plain body", False)]),
    "stream_tokens": ("k, token", [(1, "ab"), (2, N), (3, N), (4, "cd")]),
    "retry_delays": ("k, delay_ms", [(1, 1000), (2, 2000), (3, 8000), (4, 3000), (5, 8000), (6, 4000)]),
    "quote_matches": (
        "id, begin_index, begin_offset, end_index, end_offset, score",
        [("exact", 1, 0, 1, 11, 1.0), ("two", 0, 0, 1, 9, 1.0), ("case", 0, 0, 1, 9, 1.0), ("prefix", 0, 0, 1, 7, 0.85), ("none", N, N, N, N, N), ("inside", 0, 7, 0, 18, 1.0), ("dash", 0, 7, 0, 26, 1.0), ("hyphen", 0, 7, 0, 17, 1.0), ("joined", 0, 0, 0, 29, 1.0), ("blank", N, N, N, N, N)],
    ),
    "throttle_vector": ("pos, concurrency, recent_overloads", [(0, 1, 1), *[(i, 1, 1) for i in range(1, 6)], *[(i, 2, 1) for i in range(6, 11)], *[(i, 3, 1) for i in range(11, 16)]]),
    "queue_states": ("queue, pdf, id, status, error", [("q", "a", "3", "pending", N), ("q", "c", "5", "pending", N), ("q", "d", "6", "pending", N), ("r", "x", "1", "done", N), ("r", "y", "2", "error", "Failed"), ("r", "z", "3", "running", N)]),
    "file_names": ("title, path", [("A/B: C?", "Papers/A-B- C-.pdf"), ("  two\nlines ", "Papers/two-lines.pdf"), ("x" * 120, f"Papers/{_LONG}.pdf")]),
    "source_priority": ("paper_id, kind, text", [("p", "ar5iv-html", "text"), ("q", "pdf", "pdf text")]),
    "explanations": ("id, markdown, step", [("good", EXPLAINED, "answer"), ("leak", EXPLAINED, "repair"), ("lost", LOST, "safety-net")]),
    "import_ids": ("k, arxiv", [(1, "2301.00001"), (2, "2302.00002"), (3, "2303.00003"), (4, N)]),
    "setting_values": ("k, color, names, effort", [(1, "#ffffff", "arxiv|id", "high"), (2, "#12ab34", "doi", "low"), (3, "#ffd400", "doi", "low")]),
    "prose_texts": (
        "k, prose, without_images, math, kind",
        [
            (1, "H quote b l end", "# H\n> quote *b* [l](u) \n\n```\ncode\n``` end", TABLES["prose"][1][0][1], "sentence"),
            (2, "word", "$x+y$\nword", "$$\nx+y\n$$\nword", "sentence"),
            (3, "word", "word", "word", "word"),
        ],
    ),
    "abstracts": ("doc_id, abstract", [("a", "The abstract text."), ("b", "Only paragraph here.")]),
    "provider_requests": (
        "url, provider, address, body",
        [
            (TABLES["urls"][1][0][0], "anthropic", "https://api.anthropic.com/v1/messages", ANTHROPIC_BODY),
            (TABLES["urls"][1][1][0], "openai", "https://api.openai.com/v1/chat/completions", OPENAI_BODY), (TABLES["urls"][1][2][0], "anthropic", "https://claude.example.org/v1/messages", ANTHROPIC_BODY), (TABLES["urls"][1][3][0], "openai", "http://localhost:8080/v1/chat/completions", OPENAI_BODY),
        ],
    ),
    "recommended": ("id, pos, paper_id, reason", [("q", 0, "p1", "r"), ("q", 2, "p2", ""), ("x", 0, "p3", "")]),
    "image_owners": ("doc_id, section, image, n", [("mixed", "section:1", "image:1", 1)]),
    "chosen_pdfs": ("note_path, pdf_path", [("n", "a.pdf"), ("m", "c.pdf")]),
    "escaped_bibtex": ("s, escaped", [("a\\b", "a\\textbackslash\\{\\}b"), ("50% & {x}_1", "50\\% \\& \\{x\\}\\_1"), ("~^", "\\textasciitilde{}\\textasciicircum{}")]),
}


def table(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    parts = ["'" + p.replace("'", "''") + "'" for p in value.split("\n")]
    return parts[0] if len(parts) == 1 else "(" + " || chr(10) || ".join(parts) + ")"


def values_sql(columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"
