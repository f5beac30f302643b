"""Mixing sources to target weights: iterative proportional fitting, then sampling.

Tokens are summed over cells of source, language and topic.  Raking scales the cells until their sums by
source, by language and by topic each meet a target; a cell's factor, its raked over its own weight,
divided by the largest factor, is the probability with which each of its documents is sampled.  So the
expected mix is the raked one exactly.  Sampling goes by a hash of the id and is the same on every run.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.store import drop, prepare, table

MARGINS = ("source", "lang", "topic")
#: Cells up to this many are raked on the driver; more are raked as tables.
DRIVER_CELLS = 200_000
#: Raking ends when no sum misses its target by more than this share.
TOLERANCE = 1e-10


def token_count(text: Column) -> Column:
    """Words of a text: runs of non-blanks."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by form: tables, marked-up text, texts of many digits, prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit("|")), "table")
        .when(text.rlike(r"[#$%&*]{3}"), "marked")
        .when(text.rlike(r"[0-9]{6}"), "numbers")
        .otherwise("prose")
    )


def rake(weights: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Cell weights scaled until the sums of each margin's values meet their targets, or for ``rounds`` rounds; and the
    largest share by which a sum then still misses its target."""
    raked = weights.astype(float).copy()
    residual = 0.0
    for _ in range(rounds):
        residual = 0.0
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, raked, minlength=len(target))
            with np.errstate(divide="ignore", invalid="ignore"):
                by = np.where(now > 0, target / now, 0.0)
            residual = max(residual, float(np.abs(by[now > 0] - 1).max(initial=0.0)))
            raked *= by[code]
        if residual < tolerance:
            break
    return raked, residual


def target_sums(weights: dict, wanted: dict | None, power: float) -> dict:
    """The target of each value of a margin, of the same total as its ``weights``: the share in ``wanted`` of those that
    it names (scaled down if they exceed 1, or up if they leave something that no other value takes); the others
    share what is left by their weights to ``power``."""
    total = sum(weights.values())
    wanted = {k: v for k, v in (wanted or {}).items() if k in weights}
    tempered = {k: w**power for k, w in weights.items() if k not in wanted}
    given = sum(wanted.values())
    left = max(1 - given, 0.0) if tempered else 0.0
    scale = (1 - left) / given if given else 1.0
    rest = sum(tempered.values())
    shares = {k: v * scale for k, v in wanted.items()} | {k: w / rest * (left if given else 1.0) for k, w in tempered.items()}
    return {k: x * total for k, x in shares.items()}


def _rake_table(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    raked, residual = cells.withColumn("raked", F.col("weight").cast("double")), 0.0
    for _ in range(rounds):
        residual = 0.0
        for name in MARGINS:
            now = raked.groupBy(name).agg(F.sum("raked").alias("now")).join(targets[name].withColumnRenamed(name, "to"), F.col(name).eqNullSafe(F.col("to")))
            by = table(now.select(F.col("to"), (F.col("target") / F.col("now")).alias("by")), "factors")
            residual = max(residual, by.agg(F.max(F.abs(F.col("by") - 1))).first()[0] or 0.0)
            last, raked = raked, table(raked.join(by, F.col(name).eqNullSafe(F.col("to"))).select(*MARGINS, "weight", (F.col("raked") * F.col("by")).alias("raked")), "raked")
            drop(by, *([last] if last is not None and hasattr(last, "lectern_path") else []))
        if residual < tolerance:
            break
    return raked, residual


def _targets(cells: DataFrame, name: str, wanted: dict | None, power: float) -> DataFrame:
    """``target_sums`` as a written table (name, target)."""
    sums = cells.groupBy(name).agg(F.sum("weight").cast("double").alias("w"))
    asked = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in (wanted or {}).items()], f"asked {cells.schema[name].dataType.simpleString()}, share double")
    sums = table(sums.join(F.broadcast(asked), F.col(name).eqNullSafe(F.col("asked")), "left").select(name, "w", "share"), "margin")
    told = sums.agg(F.sum("w").alias("total"), F.sum("share").alias("given"), F.sum(F.when(F.col("share").isNull(), F.pow("w", F.lit(power)))).alias("rest")).first()
    total, given, rest = told["total"] or 0.0, told["given"] or 0.0, told["rest"]
    left = max(1 - given, 0.0) if rest is not None else 0.0
    share = F.when(F.col("share").isNotNull(), F.col("share") * ((1 - left) / given if given else 1.0)).otherwise(F.pow("w", F.lit(power)) / F.lit(rest or 1.0) * (left if given else 1.0))
    return table(sums.select(name, (share * total).alias("target")), "targets")


def cell_probabilities(counted: DataFrame, power: float, rounds: int, targets: dict | None = None, driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, bool, float]:
    """(c_source, c_lang, c_topic, probability) of ``counted`` (source, lang, topic, n_tokens), whether it is small, and
    the share by which a margin still misses its target."""
    spark, targets = counted.sparkSession, targets or {}
    cells = table(counted.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("weight")).where("weight > 0"), "cells")
    names = {name: f"c_{name}" for name in MARGINS}
    rows = cells.limit(driver_cells + 1).collect()
    if len(rows) <= driver_cells:
        rows.sort(key=lambda r: tuple((r[m] is not None, r[m] or "") for m in MARGINS))
        weights = np.array([r["weight"] for r in rows], float)
        codes, wanted = [], []
        for name in MARGINS:
            place: dict = {}
            codes.append(np.array([place.setdefault(r[name], len(place)) for r in rows], np.int64))
            sums = np.bincount(codes[-1], weights, minlength=len(place))
            told = target_sums(dict(zip(place, sums, strict=True)), targets.get(name), power)
            wanted.append(np.array([told[k] for k in place], float))
        raked, residual = rake(weights, codes, wanted, rounds) if rows else (weights, 0.0)
        factor = raked / weights if rows else weights
        p = factor / factor.max() if rows else factor
        schema = ", ".join(f"c_{f.name} {f.dataType.simpleString()}" for f in cells.schema if f.name in names) + ", probability double"
        order = [f.name for f in cells.schema if f.name in names]
        drop(cells)
        return spark.createDataFrame([(*[r[m] for m in order], float(x)) for r, x in zip(rows, p, strict=True)], schema), True, residual
    raked, residual = _rake_table(cells, {m: _targets(cells, m, targets.get(m), power) for m in MARGINS}, rounds)
    raked = raked.withColumn("factor", F.col("raked") / F.col("weight"))
    top = raked.agg(F.max("factor")).first()[0]
    return raked.select(*[F.col(m).alias(c) for m, c in names.items()], (F.col("factor") / top).alias("probability")), False, residual


def mixing_probabilities(
    docs: DataFrame, power: float = 0.8, rounds: int = 10, topic: Column | None = None, seed: int = 11, keep: tuple[str, ...] = (), targets: dict | None = None, driver_cells: int = DRIVER_CELLS
) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, source, lang): doc_id, n_tokens, topic, probability, sampled, residual
    and the columns named in ``keep``.

    ``targets`` gives for any of the margins (source, lang, topic) the share of tokens of some values; see
    ``target_sums`` for the others.  Raking ends when every margin meets its targets to TOLERANCE, or after
    ``rounds`` rounds; residual, the same in all rows, is the largest share by which a margin then misses one (as
    where targets contradict each other).  ``topic`` is an expression for the topic, by default ``topic_of``.

    Null sources and languages are values of their own.  A text without words (null, empty) is in no
    cell, has probability 0 and is not sampled.  Rows of one doc_id, repeated ones too, are drawn alike: by a hash
    of the id.  Texts of any length are counted whole.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    counted = docs.select("doc_id", "source", "lang", token_count(F.col("text")).alias("n_tokens"), (topic if topic is not None else topic_of(F.col("text"))).alias("topic"), *[F.col(c).alias(f"lectern_{c}") for c in keep])
    cells, few, residual = cell_probabilities(counted.select(*MARGINS, "n_tokens"), power, rounds, targets, driver_cells)
    same = F.lit(True)
    for name in MARGINS:
        same = same & F.col(name).eqNullSafe(F.col(f"c_{name}"))
    joined = counted.join(F.broadcast(cells) if few else cells, same, "left")
    draw = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    p = F.when(F.col("n_tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(0.0)
    return joined.select("doc_id", "n_tokens", "topic", p.alias("probability"), (draw < p).alias("sampled"), F.lit(residual).alias("residual"), *[F.col(f"lectern_{c}") for c in keep])
