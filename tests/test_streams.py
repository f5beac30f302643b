"""Streamed chunks, pacing, sinks and calls: batch and stream, on odd rows and against plain versions."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import cascade, planner
from lectern.sources import files, graph_source, remote
from lectern.streaming import lines, queues


def chunked(seed, n=20):
    """(chunks, lines by stream): streams cut at any byte."""
    rng, rows, want = random.Random(seed), [], {}
    for s in range(n):
        text = "".join(rng.choice(["a", "é", "😀", "\n", "\n\n", "data: x", "\r"]) for _ in range(rng.randint(0, 60)))
        body, at, seq = text.encode(), 0, 0
        while at < len(body):
            size = rng.choice([1, 1, 2, 7, 40])
            rows.append((s, seq, body[at : at + size], at + size >= len(body)))
            at, seq = at + size, seq + 1
        whole = text.split("\n")
        want[s] = whole if whole[-1] else whole[:-1]
    return rows, want


def by_stream(rows, n):
    out = {s: [] for s in range(n)}
    for r in sorted(rows, key=lambda r: (r["stream"], r["line_no"])):
        assert r["line_no"] == len(out[r["stream"]])
        out[r["stream"]].append(r["line"])
    return out


@pytest.mark.parametrize("block", [2, 4096])
def test_lines_of_chunks_cut_anywhere(spark, block):
    rows, want = chunked(3)
    random.Random(1).shuffle(rows)
    chunks = spark.createDataFrame(rows, "stream int, seq long, body binary, last boolean")
    assert by_stream(lines.chunk_lines(chunks, block).collect(), 20) == want
    assert lines.chunk_lines(chunks.where("false")).count() == 0
    assert [r["line"] for r in lines.chunk_lines(spark.createDataFrame([(1, 0, None), (1, 1, b"a")], "stream int, seq long, body binary")).collect()] == ["a"]


def test_line_stream_equals_batch(spark, tmp_path):
    rows, want = chunked(4)
    random.Random(2).shuffle(rows)
    schema = "stream int, seq long, body binary, last boolean"
    for k in range(2):  # chunks come late and early, some twice
        spark.createDataFrame(rows[k::2] + rows[:3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    made = lines.line_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    run = made.writeStream.format("memory").queryName("told_lines").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="100 milliseconds").start()
    until = time.time() + 90
    while spark.table("told_lines").count() < sum(map(len, want.values())) and time.time() < until:
        time.sleep(0.5)
    run.stop()
    assert by_stream(spark.table("told_lines").collect(), 20) == want


@pytest.mark.parametrize("block", [2, 4096])
def test_pacing_without_a_global_window(spark, block):
    rng = random.Random(block)
    rows = [(i, rng.choice([rng.randint(0, 10_000), 3_600_000 * rng.randint(0, 3), 3_600_000 * 4096 * rng.randint(-2, 3) + rng.randint(-5, 5)])) for i in range(300)]
    start, want = None, {}
    for pos, ts in sorted(rows, key=lambda r: (r[1], r[0])):
        start = ts if start is None else max(ts, start + 3000)
        want[pos] = start
    made = queues.paced(spark.createDataFrame([*rows, (300, None)], "pos long, ts_ms long"), 3000, block)
    assert {r["pos"]: r["start_ms"] for r in made.collect()} == {**want, 300: None}
    assert "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()
    assert queues.paced(made.select("pos", "ts_ms").where("false")).count() == 0


def plain_cover(sections):
    """sections: (id, ordinal, char_start, planned, heading, scores) of one document."""
    frame = sorted(sections, key=lambda s: s[1])
    plans = [(i, s[4]) for i, s in enumerate(frame) if s[3]]
    order = sorted(range(len(frame)), key=lambda i: (frame[i][2], i))
    for k, heading in enumerate(planner.TARGETS):
        if heading in [h for _, h in plans]:
            continue
        uses = [sum(j == i for j, _ in plans) for i in range(len(frame))]
        pick = max(range(len(frame)), key=lambda i: (frame[i][5][k] - 2 * uses[i], -i))
        if frame[pick][5][k] - 2 * uses[pick] <= 0:
            turn = order[::-1] if k >= 4 else order
            pick = min(turn, key=lambda i: (uses[i], turn.index(i)))
        plans.append((pick, heading))
    return [(frame[i][0], h, planner.HEADINGS.index(h), frame[i][2]) for i, h in plans]


def test_cover_by_a_fold(spark):
    rng, rows, want = random.Random(8), [], []
    for doc in range(60):
        sections = [(f"s{i}", i, rng.choice([i * 10, 100 - i * 10, 50]), rng.random() < 0.6, rng.choice(planner.HEADINGS), [rng.choice([0, 0, 1, 3, 6]) for _ in planner.TARGETS]) for i in range(rng.randint(1, 7))]
        rows += [(doc, *s) for s in sections]
        want += [(doc, *r) for r in plain_cover(sections)]
    made = planner.cover(spark.createDataFrame(rows, "doc_id int, id string, ordinal int, char_start int, planned boolean, target_heading string, all_scores array<int>"))
    assert sorted(map(tuple, made.collect())) == sorted(want)
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()


def test_calls_run_side_by_side_in_order(spark):
    def call(system, user, tokens):
        time.sleep(0.4 if int(user) % 2 else 0.2)
        return 200, user

    requests = spark.createDataFrame([(i, "s", str(i), 9) for i in range(12)], "id int, system string, user string, max_tokens int").coalesce(1)
    files.call_provider(requests, call, 1).count()
    took = []
    for width in (1, 6):
        began = time.time()
        got = files.call_provider(requests, call, 1, width=width).collect()
        took.append(time.time() - began)
        assert all(r["body"] == r["user"] for r in got) and sorted(r["id"] for r in got) == list(range(12))
    assert took[1] < took[0] - 1.5


def test_pauses_are_what_the_server_asks_for(spark, tmp_path):
    log = str(tmp_path / "pauses")

    def call(system, user, tokens):
        return {"seconds": (429, "", {"Retry-After": "3"}), "long": (503, "", {"retry-after": "600"}), "past": (503, "", {"Retry-After": "Wed, 21 Oct 2015 07:28:00 GMT"}), "odd": (429, "", {"Retry-After": "soon"})}[user]

    def wait(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds}\n")

    requests = spark.createDataFrame([(u, "s", u, 9) for u in ("seconds", "long", "past", "odd")], "id string, system string, user string, max_tokens int")
    files.call_provider(requests, call, 1, attempts=3, wait=wait).collect()
    assert sorted(map(float, open(log).read().split())) == [0.0, 0.0, 1.0, 2.0, 3.0, 3.0, 8.0, 8.0]


def test_a_dead_job_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.current_table(spark, path) is None
    for n in range(4):
        assert files.save_if_changed(spark.range(n + 1), path)
    spark.range(99).write.parquet(f"{path}/v4")  # written, but its mark was never made
    assert files.current_table(spark, path).count() == 4 and files.committed(spark, path) == [2, 3]
    assert files.save_if_changed(spark.range(5), path) and files.current_table(spark, path).count() == 5


def test_batches_count_once(spark, tmp_path):
    sink, path = files.batch_sink(str(tmp_path / "b")), str(tmp_path / "b")
    sink(spark.range(3), 0)
    sink(spark.range(100), 0)  # brought again after a restart
    spark.range(50).write.parquet(f"{path}/v1")  # a dead batch
    assert files.batches(spark, path).count() == 3
    sink(spark.range(4), 1)
    assert files.batches(spark, path).count() == 7


def test_documents_without_rows_stay(spark, tmp_path):
    path = str(tmp_path / "anchors")
    files.overwrite_documents(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "doc_id string, n int"), path)
    before = {f: os.stat(f"{path}/doc_id=b/{f}").st_mtime_ns for f in os.listdir(f"{path}/doc_id=b")}
    files.overwrite_documents(spark.createDataFrame([("a", 9), ("c", 4)], "doc_id string, n int"), path)
    assert sorted((r["doc_id"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3), ("c", 4)]
    assert before == {f: os.stat(f"{path}/doc_id=b/{f}").st_mtime_ns for f in os.listdir(f"{path}/doc_id=b")}


def test_a_raising_download_fails_alone(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("reset")
        return 200, b"%PDF"

    papers = spark.createDataFrame([(1, "2301.1", "One"), (2, "bad", "Two")], "paper_id int, arxiv_id string, title string")
    got = {r["paper_id"]: (r["step"], r["status"], r["content"]) for r in remote.downloads(papers, spark.createDataFrame([], "path string"), fetch, F.lit("P")).collect()}
    assert got == {1: ("fetched", 200, b"%PDF"), 2: ("failed", 0, None)}


def test_the_last_run_is_emitted_too(spark, tmp_path):
    schema = "k string, number long, ts_ms long"
    spark.createDataFrame([("a", 1, 0), ("a", 2, 100), ("a", 3, 900), ("b", 7, 50)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    made = queues.debounce_emitted(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k")
    run = made.writeStream.format("memory").queryName("emitted").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="100 milliseconds").start()
    try:
        until = time.time() + 90
        while spark.table("emitted").count() < 3 and time.time() < until:
            time.sleep(0.5)
    finally:
        run.stop()
    assert sorted(map(tuple, spark.table("emitted").collect())) == [("a", 2, 100, 2), ("a", 3, 900, 1), ("b", 7, 50, 1)]


def test_graph_as_a_data_source(spark, tmp_path):
    import json

    log = str(tmp_path / "asked")
    graph = {("ArXiv:1", "citations"): [{"citingPaper": {"paperId": "x", "title": "X", "authors": [{"name": "A"}], "year": 2001, "citationCount": 3}}, {"citingPaper": {"paperId": "y"}}], ("DOI:2", "references"): [{"citedPaper": {"paperId": "z", "title": "Z"}}, {"citedPaper": None}]}

    def fetch(url, headers):
        with open(log, "a") as f:
            f.write(url + "\n")
        if headers:
            return 403, ""
        paper, relation = url.split("/paper/")[1].split("?")[0].rsplit("/", 1)
        return (200, json.dumps({"data": graph[paper, relation]})) if (paper, relation) in graph else (500, "down")

    graph_source.register_graph(spark, fetch)
    whole = spark.read.format("paper_graph").option("papers", "arxiv:1, doi:2,arxiv:1,none").option("key", "k").option("parts", 2).load()
    want = [("arxiv:1", "citations", 0, "x", "X", ["A"], 2001, "", 3), ("arxiv:1", "citations", 1, "y", "Untitled", [], 0, "", 0), ("doi:2", "references", 0, "z", "Z", [], 0, "", 0)]
    assert sorted(map(tuple, whole.collect())) == want and whole.rdd.getNumPartitions() == 2
    os.remove(log)
    some = spark.read.format("paper_graph").schema("paper_id string, relation string, id string").option("papers", "arxiv:1,doi:2").option("limit", 1).load()
    some = some.where("paper_id = 'arxiv:1' and relation in ('citations') and id <> 'q'")
    assert [tuple(r) for r in some.collect()] == [("arxiv:1", "citations", "x")]
    asked = open(log).read().split()
    assert len(asked) == 1 and asked[0].endswith("/ArXiv:1/citations?fields=paperId&limit=1")
    assert spark.read.format("paper_graph").load().count() == 0


def test_explainer_outputs(spark):
    answers = spark.createDataFrame(
        [
            (1, "json", '{"markdown": "## Own heading\\n\\nBody text", "figureMentions": ["Fig. 2", 7], "figureNote": " noted "}', ["A", "B"], "see Figure 1"),
            (1, "found", "# T\n\nplain  ", ["C"], "in Figure  3 and FIG. 3, Figure 3"), (1, "section", "plain", ["A"], "none named"), (2, "alone", "plain", ["A"], "Figure 1"), (1, "null", None, None, None),
        ],
        "doc_id int, id string, text string, section_path array<string>, content string",
    )
    images = spark.createDataFrame([(1, "i1", 1, ["A"], "![figure 1](a)"), (1, "i2", 2, ["A", "B"], "image"), (1, "i3", 3, ["D"], "Fig.2"), (1, "i4", 4, ["A", "B"], "figure 22"), (1, "i5", 5, ["D"], "Image 3")], "doc_id int, id string, ordinal int, section_path array<string>, content string")
    for language in ("en", "zh-CN"):
        got = {r["id"]: tuple(r)[2:] for r in cascade.explainer_outputs(answers, images, language).collect()}
        stock = cascade.FIGURE_NOTE[language]
        assert got["json"] == ("Body text", ["Fig. 2"], ["i2", "i3"], "noted") and got["found"] == ("plain", [], ["i5"], stock)
        assert got["section"] == ("plain", [], ["i1"], stock) and got["alone"] == ("plain", [], [], "") and got["null"][1:] == ([], [], "")
    row = spark.range(1).select(cascade.safety_net(F.lit("方法"), F.lit("f"), "zh-CN").alias("s"), cascade.formula_net(F.lit("x"), F.lit("n"), F.lit("f"), "zh-CN").alias("f")).first()
    assert row["s"].startswith("> [!note] 这一部分对应论文中的 **方法**。\n\n") and "“f”" in row["f"]


def test_kept_answers_are_asked_for_once(spark, tmp_path):
    import json

    log = str(tmp_path / "calls")

    def call(system, user, tokens):
        with open(log, "a") as f:
            f.write(f"{user}:{tokens}\n")
        text = '{"markdown": "cut' if user == "long" and tokens < 1000 else '{"markdown": "whole"}'
        return 200, json.dumps({"choices": [{"finish_reason": "length" if "cut" in text else "stop", "message": {"content": text}}]})

    requests = spark.createDataFrame([(u, "openai", "s", u, 900) for u in ("short", "long")], "id string, provider string, system string, user string, max_tokens int")
    got = cascade.call_with_retry(requests, call, 1, kept=str(tmp_path / "kept"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, got.collect())) == [("long", '{"markdown": "whole"}', 2), ("short", '{"markdown": "whole"}', 1)]
    assert sorted(open(log).read().split()) == ["long:1800", "long:900", "short:900"]
