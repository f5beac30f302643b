"""Job queues, adaptive throttling and debouncing, over event logs and as streams.

The state machines are plain folds over ordered events; the batch operators apply them per key, and the
streaming operators keep the same state between micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Milliseconds and counts of the throttle.
COOLDOWN_MS, WINDOW_MS, SPACING_MS, STREAK = 15_000, 60_000, 10_000, 5


class Throttle:
    """Additive increase, multiplicative decrease of a concurrency limit."""

    def __init__(self, most: int, now: int | None = None, changed: int = 0, streak: int = 0, until: int = 0, history: list[int] | None = None):
        self.most, self.now, self.changed, self.streak, self.until = most, most if now is None else now, changed, streak, until
        self.history = list(history or [])

    def step(self, ts: int, kind: str, retry_after: int = 0) -> None:
        """kind: success, overload, or failure (any other)."""
        self.history = [t for t in self.history if t >= ts - WINDOW_MS]
        if kind == "success":
            self.streak += 1
            if self.now < self.most and self.until <= ts and ts - self.changed >= SPACING_MS and self.streak >= STREAK:
                self.now, self.streak, self.changed = self.now + 1, 0, ts
        else:
            self.streak = 0
            if kind == "overload":
                self.now, self.changed = max(1, self.now // 2), ts
                self.until = ts + max(COOLDOWN_MS, retry_after)
                self.history.append(ts)

    def state(self) -> tuple:
        return self.most, self.now, self.changed, self.streak, self.until, self.history


THROTTLE = "{key}, ts_ms long, pos long, concurrency int, recent_overloads int, cooling boolean"


def throttle_trace(events: DataFrame, key: str, most: int = 3) -> DataFrame:
    """The limit after each event of events (key, ts_ms, pos, kind, retry_after_ms), per key in order of time and pos."""
    kind = events.schema[key].dataType.simpleString()

    def run(k, frame):
        t, rows = Throttle(most), []
        for e in frame.sort_values(["ts_ms", "pos"]).itertuples():
            t.step(e.ts_ms, e.kind, 0 if pd.isna(e.retry_after_ms) else int(e.retry_after_ms))
            rows.append((k[0], e.ts_ms, e.pos, t.now, len(t.history), t.until > e.ts_ms))
        return pd.DataFrame(rows, columns=[key, "ts_ms", "pos", "concurrency", "recent_overloads", "cooling"])

    return events.select(key, "ts_ms", "pos", "kind", "retry_after_ms").groupBy(key).applyInPandas(run, THROTTLE.format(key=f"{key} {kind}"))


def throttle_stream(events: DataFrame, key: str, most: int = 3) -> DataFrame:
    """As ``throttle_trace``, over a stream; within a micro-batch events are put in order."""
    kind = events.schema[key].dataType.simpleString()

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t = Throttle(*(list(state.get)[:5]), list(state.get[5])) if state.exists else Throttle(most)
        rows = []
        for e in pd.concat(list(frames)).sort_values(["ts_ms", "pos"]).itertuples():
            t.step(e.ts_ms, e.kind, 0 if pd.isna(e.retry_after_ms) else int(e.retry_after_ms))
            rows.append((k[0], e.ts_ms, e.pos, t.now, len(t.history), t.until > e.ts_ms))
        state.update(t.state())
        yield pd.DataFrame(rows, columns=[key, "ts_ms", "pos", "concurrency", "recent_overloads", "cooling"])

    kept = "most int, now int, changed long, streak int, until long, history array<long>"
    return events.select(key, "ts_ms", "pos", "kind", "retry_after_ms").groupBy(key).applyInPandasWithState(run, THROTTLE.format(key=f"{key} {kind}"), kept, "append", GroupStateTimeout.NoTimeout)


def recent_overloads(events: DataFrame, key: str) -> DataFrame:
    """events (key, ts_ms, pos, kind) with the overloads of the last 60 seconds, itself included."""
    order = W.partitionBy(key).orderBy("ts_ms").rangeBetween(-WINDOW_MS, 0)
    return events.withColumn("recent", F.sum((F.col("kind") == "overload").cast("int")).over(order))


def debounce(events: DataFrame, key: str, wait_ms: int = 300) -> DataFrame:
    """Events (key, ts_ms, pos) after which nothing came for ``wait_ms``, or at all."""
    order = W.partitionBy(key).orderBy("ts_ms", "pos")
    gap = F.lead("ts_ms").over(order) - F.col("ts_ms")
    return events.withColumn("gap", gap).where(F.col("gap").isNull() | (F.col("gap") >= wait_ms)).drop("gap")


def debounce_stream(events: DataFrame, key: str, time: str, wait: str = "300 milliseconds") -> DataFrame:
    """(key, last, n) per session of a stream with a watermark: its end is ``wait`` after the last event."""
    return events.groupBy(key, F.session_window(time, wait)).agg(F.max(time).alias("last"), F.count("*").alias("n"))


def debounce_emitted(events: DataFrame, key: str, wait_ms: int = 300) -> DataFrame:
    """(key, number, last_ms, n) for each run of events (key, number, ts_ms) of a stream that nothing followed for
    ``wait_ms``: the last number, its time and how many there were.

    A run in which a later event came ``wait_ms`` after the one before is emitted at once, the last one by a timer, after
    ``wait_ms`` without an event, so that none waits for the next.  Late events of a micro-batch are put in order.
    """
    kind = events.schema[key].dataType.simpleString()

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows, held = [], list(state.get) if state.exists else None
        if state.hasTimedOut:
            rows.append(held)
            state.remove()
        else:
            for e in pd.concat(list(frames)).sort_values(["ts_ms", "number"]).itertuples():
                if held is not None and e.ts_ms - held[1] >= wait_ms:
                    rows.append(held)
                    held = None
                held = [max(e.number, held[0]), max(e.ts_ms, held[1]), held[2] + 1] if held else [e.number, e.ts_ms, 1]
            state.update(tuple(held))
            state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame([(k[0], *r) for r in rows], columns=[key, "number", "last_ms", "n"])

    out = f"{key} {kind}, number long, last_ms long, n long"
    return events.select(key, "number", "ts_ms").groupBy(key).applyInPandasWithState(run, out, "number long, last_ms long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def fresh_answers(requests: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """answers (key, number, ts_ms) that are not stale: when they came, no later request of requests (key, number, ts_ms)
    of that key had been made.  A request of the same millisecond counts as made."""
    asked = requests.select(key, "ts_ms", "number", F.lit(0).alias("kind"))
    told = answers.select(key, "ts_ms", "number", F.lit(1).alias("kind"))
    order = W.partitionBy(key).orderBy("ts_ms", "kind").rowsBetween(W.unboundedPreceding, 0)
    both = asked.unionByName(told).withColumn("newest", F.max(F.when(F.col("kind") == 0, F.col("number"))).over(order))
    return both.where("kind = 1 and number = newest").select(key, "number", "ts_ms")


def admit(queue: DataFrame, jobs: DataFrame, by: list[str]) -> DataFrame:
    """jobs that are not pending or running already; of repeated ones the first (by added_at, id) stays, as pending."""
    active = queue.where(F.col("status").isin("pending", "running")).select(*by).distinct()
    order = W.partitionBy(*by).orderBy("added_at", "id")
    fresh = jobs.join(active, by, "left_anti").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    return fresh.withColumn("status", F.lit("pending"))


def recover(queue: DataFrame) -> DataFrame:
    """After a restart: rows without id, file or a known status are dropped, running jobs are pending again."""
    good = queue.where(F.col("id").isNotNull() & F.col("pdf").isNotNull() & F.col("status").isin("pending", "running", "done", "error"))
    return good.withColumn("status", F.when(F.col("status") == "running", "pending").otherwise(F.col("status")))


def next_job(queue: DataFrame) -> DataFrame:
    """The first pending job by added_at and id, none while one runs."""
    idle = queue.agg(F.count_if(F.col("status") == "running").alias("busy"), F.min(F.when(F.col("status") == "pending", F.struct("added_at", "id"))).alias("first"))
    return idle.where("busy = 0 and first is not null").select("first.id", "first.added_at")


def progress(steps: DataFrame, key: str) -> DataFrame:
    """steps (key, pos, done) with n_done, the steps done up to each, and total, in order of pos."""
    order = W.partitionBy(key).orderBy("pos")
    return steps.withColumn("n_done", F.sum(F.col("done").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.count("*").over(W.partitionBy(key)))


def queue_statistics(queue: DataFrame) -> DataFrame:
    return queue.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "running", "done", "error")])


def clear_done(queue: DataFrame) -> DataFrame:
    return queue.where(~F.col("status").isin("done", "error"))


def latest(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The last row for each ``by``."""
    w = W.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def run_queue(events: DataFrame) -> DataFrame:
    """(queue, pdf, id, status, error): the state of jobs after events (queue, seq, pdf, id, event: enqueue, start, finish,
    fail, cancel, restart, clear), per queue in order.

    A queue has one consumer, which takes the oldest pending job: another start, or one while a job runs, is
    ignored, as is the end of a job that does not run.  A file with a pending or running job is not enqueued again.
    A cancelled job, running or pending, is an error ``Cancelled``; a restart puts the running job back; clear drops
    what is done or failed.
    """

    def run(k, frame):
        jobs: dict[str, dict] = {}
        ends = {"finish": ("done", None), "fail": ("error", "Failed"), "cancel": ("error", "Cancelled")}
        for e in frame.sort_values("seq").itertuples():
            waiting = [i for i, j in jobs.items() if j["status"] == "pending"]
            running = [i for i, j in jobs.items() if j["status"] == "running"]
            if e.event == "enqueue":
                if e.pdf not in {jobs[i]["pdf"] for i in waiting + running}:
                    jobs[e.id] = {"pdf": e.pdf, "status": "pending", "error": None}
            elif e.event == "start":
                if not running and waiting[:1] == [e.id]:
                    jobs[e.id]["status"] = "running"
            elif e.event in ends:
                if e.id in running or (e.event == "cancel" and e.id in waiting):
                    jobs[e.id]["status"], jobs[e.id]["error"] = ends[e.event]
            elif e.event == "restart":
                for i in running:
                    jobs[i]["status"] = "pending"
            elif e.event == "clear":
                jobs = {i: j for i, j in jobs.items() if j["status"] in ("pending", "running")}
        return pd.DataFrame([(k[0], j["pdf"], i, j["status"], j["error"]) for i, j in jobs.items()], columns=["queue", "pdf", "id", "status", "error"])

    return events.groupBy("queue").applyInPandas(run, "queue string, pdf string, id string, status string, error string")


def without_old_highlights(highlights: DataFrame, admitted: DataFrame) -> DataFrame:
    """highlights (pdf, …) but for those of files that were admitted to the queue, which are made anew."""
    return highlights.join(admitted.select("pdf").distinct(), "pdf", "left_anti")


def retry_schedule(attempt: Column, base: int = 3000, least: int = 3000, most: int = 15_000) -> Column:
    """Milliseconds before the next try of a metadata request."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.lit(base) * F.pow(F.lit(2), attempt))).cast("long")


HOUR_MS, ERA_HOURS = 3_600_000, 4096


def paced(requests: DataFrame, spacing_ms: int = 3000, block: int = 4096) -> DataFrame:
    """requests (pos, ts_ms; pos counts up from 0) with start_ms, no two starts closer than ``spacing_ms``: a request starts
    at the running maximum of ts - n * spacing, plus n * spacing, n being its place in order of (ts, pos).

    Pacing is global, but no window is.  Requests of one millisecond are counted first (they start one after the other); sums and
    maxima then run within hours, over the hours of an era, and over eras, and what came before is sent back
    to each.  The windows hold a row for each millisecond of an hour, or hour of an era (4096 hours), at most; eras,
    of which a century has 214, are added up on the driver.  Requests of one millisecond are numbered in blocks of
    ``block`` positions.  Requests without a time never start; those without a pos come first.
    """
    spark, s = requests.sparkSession, F.lit(spacing_ms)
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    ticks = requests.where("ts_ms is not null").groupBy(F.col("ts_ms").cast("long").alias("ts_ms")).agg(F.count("*").alias("c"))
    ticks = ticks.withColumn("hour", F.floor(F.col("ts_ms") / HOUR_MS)).withColumn("era", F.floor(F.col("hour") / ERA_HOURS))
    in_hour = W.partitionBy("era", "hour").orderBy("ts_ms")
    ticks = ticks.withColumn("n", F.coalesce(F.sum("c").over(before(in_hour)), F.lit(0)))
    ticks = ticks.withColumn("top", F.max(F.col("ts_ms") - F.col("n") * s).over(in_hour.rowsBetween(W.unboundedPreceding, 0)))
    hours = ticks.groupBy("era", "hour").agg(F.sum("c").alias("c"), F.max("top").alias("top"))
    in_era = W.partitionBy("era").orderBy("hour")
    hours = hours.withColumn("hour_n", F.coalesce(F.sum("c").over(before(in_era)), F.lit(0))).withColumn("top", F.col("top") - F.col("hour_n") * s)
    hours = hours.withColumn("hour_top", F.max("top").over(before(in_era)))
    rows, n, top = [], 0, None
    for r in hours.groupBy("era").agg(F.sum("c").alias("c"), F.max("top").alias("top")).orderBy("era").collect():
        rows.append((r["era"], n, top))
        own = r["top"] - n * spacing_ms
        n, top = n + r["c"], own if top is None else max(top, own)
    eras = spark.createDataFrame(rows, "era long, era_n long, era_top long")
    ticks = ticks.join(hours.select("era", "hour", "hour_n", "hour_top"), ["era", "hour"]).join(F.broadcast(eras), "era")
    held = [F.col("top") - (F.col("hour_n") + F.col("era_n")) * s, F.col("hour_top") - F.col("era_n") * s, F.col("era_top")]
    starts = ticks.select(F.col("ts_ms").alias("tick"), (F.greatest(*held) + (F.col("era_n") + F.col("hour_n") + F.col("n")) * s).alias("first_ms"))
    # numbers of the requests of one millisecond: within blocks of pos, and the blocks before
    named = requests.withColumns({"tick": F.col("ts_ms").cast("long"), "pos_block": F.coalesce(F.floor(F.col("pos") / block), F.lit(-1))})
    in_tick = W.partitionBy("tick").orderBy("pos_block")
    blocks = named.groupBy("tick", "pos_block").agg(F.count("*").alias("c")).withColumn("block_n", F.coalesce(F.sum("c").over(before(in_tick)), F.lit(0))).drop("c")
    own = F.row_number().over(W.partitionBy("tick", "pos_block").orderBy("pos")) - 1
    named = named.withColumn("own_n", own).join(blocks, ["tick", "pos_block"], "left").join(starts, "tick", "left")
    return named.select(*requests.columns, (F.col("first_ms") + (F.col("block_n") + F.col("own_n")) * s).alias("start_ms"))
