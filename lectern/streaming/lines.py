"""Lines and tokens of streamed responses whose chunks are cut at any byte, as a batch and as a stream.

A chunk is (stream, seq, body), body being bytes.  A line ends with a line feed, or with its stream; a character
that a cut divides is whole again, because lines are put together as bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions.responses import stream_token
from lectern.operators.steps import settled

#: Chunks of a stream whose line feeds are added up in one window; blocks are then added up themselves.
BLOCK = 4096


def chunk_lines(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(stream, line_no, line) of chunks (stream, seq, body): all lines but an empty one at a stream's end.

    The number of line feeds before a chunk is the number of the line that its first piece belongs to.  It is a running
    sum over (stream, block of seq) and, before that, over blocks, so that a stream of any length is no single
    window; what travels for it are counts.  Then the pieces of each line are put together in order of seq.  Null
    bodies are empty; chunks of one seq (and a null seq, which comes first) are put in order of their bodies.
    """
    # one character for each byte, so that pieces can be cut and joined before they are decoded
    text = F.coalesce(F.decode("body", "ISO-8859-1"), F.lit(""))
    pieces = chunks.select("stream", F.coalesce("seq", F.lit(-1)).alias("seq"), text.alias("chunk"))
    pieces = pieces.groupBy("stream", "seq").agg(F.array_join(F.array_sort(F.collect_list("chunk")), "").alias("chunk"))
    pieces = pieces.withColumn("block", F.floor(F.col("seq") / block))
    feeds = pieces.select("stream", "seq", "block", F.regexp_count("chunk", F.lit("\n")).cast("long").alias("feeds"))
    before = W.partitionBy("stream").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = feeds.groupBy("stream", "block").agg(F.sum("feeds").alias("feeds")).select("stream", "block", F.coalesce(F.sum("feeds").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("stream", "block").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    count = F.regexp_count("chunk", F.lit("\n")).cast("long")
    numbered = pieces.withColumn("feeds", count).withColumn("own", F.coalesce(F.sum("feeds").over(inside), F.lit(0))).join(blocks, ["stream", "block"])
    parts = numbered.select("stream", "seq", "feeds", (F.col("base") + F.col("own")).alias("first"), F.posexplode(F.split("chunk", "\n")).alias("pos", "piece"))
    # empty pieces are kept, so every line has one; all but the last piece of a chunk end their lines
    ends = F.max(F.col("pos") < F.col("feeds")).alias("ended")
    found = parts.groupBy("stream", (F.col("first") + F.col("pos")).alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("pieces"), ends)
    joined = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    return settled(found, {"line": F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8")}).where("ended or line <> ''").select("stream", "line_no", "line")


def stream_tokens(lines: DataFrame, provider: Column) -> DataFrame:
    """(stream, line_no, token): what the lines of ``chunk_lines`` add to the text of their streams."""
    return lines.select("stream", "line_no", stream_token(F.rtrim(F.col("line"), F.lit("\r")), provider).alias("token")).where("token is not null")


def line_stream(chunks: DataFrame, wait_ms: int = 60_000) -> DataFrame:
    """As ``chunk_lines``, over a stream of chunks with a column ``last`` (boolean, the stream's end).

    The state of a stream is the unfinished line, its number and the seq that comes next; a chunk whose forerunners are still
    missing waits in the state, one that was seen is left out.  After ``wait_ms`` without a chunk the stream ends as
    it stands.  ``chunks`` has sequential seq from 0.
    """
    kind = chunks.schema["stream"].dataType.simpleString()

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, number, due, early, end = state.get if state.exists else (b"", 0, 0, [], None)
        waiting = {int(e["seq"]): bytes(e["body"]) for e in early}
        rows = []
        if not state.hasTimedOut:
            for f in frames:
                for seq, body, last in zip(f["seq"], f["body"], f["last"], strict=True):
                    if seq >= due:
                        waiting[int(seq)] = bytes(body or b"")
                    if last:
                        end = int(seq)
        while due in waiting:
            *lines, rest = (bytes(rest) + waiting.pop(due)).split(b"\n")
            for line in lines:
                rows.append((key[0], number, line.decode("utf-8", "replace")))
                number += 1
            due += 1
        if state.hasTimedOut or (end is not None and due > end):
            if rest:
                rows.append((key[0], number, bytes(rest).decode("utf-8", "replace")))
            state.remove()
        else:
            state.update((bytes(rest), number, due, [{"seq": s, "body": b} for s, b in waiting.items()], end))
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame(rows, columns=["stream", "line_no", "line"])

    kept = "rest binary, number long, due long, early array<struct<seq long, body binary>>, end long"
    return chunks.select("stream", "seq", "body", "last").groupBy("stream").applyInPandasWithState(run, f"stream {kind}, line_no long, line string", kept, "append", GroupStateTimeout.ProcessingTimeTimeout)
