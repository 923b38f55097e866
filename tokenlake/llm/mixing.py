"""Mixing sources to target weights by iterative proportional fitting, then sampling by calibrated probabilities.

Only DataFrame and SQL functions run here. Documents are summed to cells (one per combination of the dimensions'
values) before anything is shuffled; raking works on the cells alone: each sweep scales the cells' token weights to
one dimension's target shares after the other. A document's probability of being kept is the scaled weight of its
cell over the cell's tokens, calibrated so that the expected tokens are the budget; where a cell would need more than
all it has, it is kept whole and the rest of the budget is spread over the other cells in proportion, again and again
until no further cell is. The draw is a hash of the id, so it does not change from run to run.

Targets: a dict of dimension to {value: share}, or to a power (a float): shares in proportion to the observed tokens
to that power (1: as they are, 0: uniform). Values without a target, or with target 0, get no weight.

Cases: null values are values of their own (targets call them by None); a null or empty text has no tokens and is
kept only with probability as its cell's; rows that share a doc_id share the draw; an empty table gives no row; a
dimension may be a computed column; other columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.llm.common import WORD, saved

#: Topic by pattern, first match wins: SQL regular expressions over the text.
TOPICS = {"legal": "[Ll]icen[sc]e|[Cc]opyright", "table": r"[|]", "markup": r"[#*$%&<>]{2}", "shout": "!!", "numbers": "[0-9]{3}"}


def topic(text: Column, topics: dict[str, str] = TOPICS) -> Column:
    return reduce(lambda rest, kv: F.when(text.rlike(kv[1]), kv[0]).otherwise(rest), reversed(list(topics.items())), F.lit("prose"))


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from the id: 52 bits of md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def share_table(cells: DataFrame, dim: str, target: dict | float) -> DataFrame:
    """A row per value of a dimension with its target share: v, goal."""
    if isinstance(target, dict):
        rows = [(None if k is None else str(k), float(v)) for k, v in target.items()]
        got = cells.sparkSession.createDataFrame(rows, "v string, goal double").groupBy("v").agg(F.sum("goal").alias("goal"))
        have = cells.select(F.col(dim).cast("string").alias("h")).distinct()
        got = have.join(got, F.col("h").eqNullSafe(F.col("v"))).select(F.col("h").alias("v"), "goal")
    else:
        got = cells.groupBy(F.col(dim).cast("string").alias("v")).agg(F.pow(F.sum("t").cast("double"), F.lit(float(target))).alias("goal"))
    whole = got.agg(F.sum("goal")).first()[0]
    return got.select("v", (F.col("goal") / F.lit(whole or 1.0)).alias("goal"))


def residual(raked: DataFrame, goals: dict[str, DataFrame]) -> float:
    """The largest difference between a value's share of the weights and its target, over all dimensions."""
    return _residual(_with_goals(raked, goals), list(goals))


def _with_goals(cells: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """cells with _g0, _g1, ...: the target share of the cell's value of each dimension."""
    for i, (d, goal) in enumerate(goals.items()):
        cells = cells.join(goal.select(F.col("v").alias("_v"), F.col("goal").alias(f"_g{i}")), F.col(d).cast("string").eqNullSafe(F.col("_v")), "left").drop("_v")
    return cells


def _residual(known: DataFrame, dims: list[str]) -> float:
    """residual() of cells that have their goals, in one query."""
    each = [F.struct(F.lit(i).alias("i"), F.col(d).cast("string").alias("v"), F.col(f"_g{i}").alias("goal")) for i, d in enumerate(dims)]
    sums = known.select("w", F.explode(F.array(*each)).alias("x")).groupBy("x.i", "x.v").agg(F.sum("w").alias("have"), F.max("x.goal").alias("goal"))
    whole = F.sum("have").over(Window.partitionBy("i"))
    off = F.coalesce("goal", F.lit(0.0)) - F.coalesce(F.col("have") / F.when(whole != 0, whole).otherwise(1.0), F.lit(0.0))
    return sums.select(F.abs(off).alias("off")).agg(F.max("off")).first()[0] or 0.0


def rake(cells: DataFrame, targets: dict[str, dict | float], sweeps: int = 6, tolerance: float | None = None) -> DataFrame:
    """cells (the dimensions, t: tokens) with w: raked weights that sum to 1, dimension by dimension, sweep by sweep.

    Without a tolerance there are just so many sweeps; with one there may be more, until residual() is at most that, or
    no longer falls by a hundredth a sweep: some targets no weights can meet, such as one of a value without tokens.
    Targets are joined to the cells once, so that a sweep is one query without joins, and a residual another: each
    query costs the driver memory for its plan and its generated code.
    """
    goals = {d: share_table(cells, d, t) for d, t in targets.items()}
    now = saved(_with_goals(cells, goals).withColumn("w", F.col("t").cast("double")), "goals")
    sweep, last = 0, float("inf")
    while tolerance is not None or sweep < sweeps:
        for i, d in enumerate(goals):
            have = F.sum("w").over(Window.partitionBy(F.col(d).cast("string")))
            now = now.withColumn("w", F.col("w") * F.coalesce(F.when(have > 0, F.col(f"_g{i}") / have).otherwise(0.0), F.lit(0.0)))
        now = saved(now, "raked")
        sweep += 1
        if tolerance is not None and sweep >= sweeps:
            off = _residual(now, list(goals))
            if off <= tolerance or off > 0.99 * last:
                break
            last = off
    return now.drop(*[f"_g{i}" for i in range(len(goals))])


def calibrate(raked: DataFrame, budget: float) -> DataFrame:
    """raked cells with p: the probability of keeping a document, so that expected tokens are budget x all tokens.

    Each round makes at least one more cell whole, or is the last.
    """
    now, held = raked.withColumn("p", F.lit(0.0)), -1
    while True:
        full = F.col("p") >= 1
        whole, taken, open_, n = now.agg(F.sum("t"), F.sum(F.when(full, F.col("t"))), F.sum(F.when(~full, F.col("w"))), F.count_if(full)).first()
        if n == held:
            return now
        held = n
        rate = max((whole or 0) * float(budget) - (taken or 0), 0.0) / open_ if open_ else 0.0
        now = now.withColumn("p", F.when(full, 1.0).when(F.col("t") > 0, F.least(F.lit(1.0), F.lit(rate) * F.col("w") / F.col("t"))).otherwise(F.lit(0.0)))
        now = saved(now, "rates")


def mix(docs: DataFrame, targets: dict[str, dict | float], budget: float, *, sweeps: int = 6, tolerance: float | None = None, seed: int = 42) -> DataFrame:
    """docs (with the dimensions' columns and n_tokens) with weight, probability and selected (columns of these names give
    way unless they are dimensions, which are then not in the result); all other columns stay.
    """
    dims = {f"_d{i}": d for i, d in enumerate(targets)}
    cells = saved(docs.groupBy(*[F.col(f"`{d}`").alias(x) for x, d in dims.items()]).agg(F.sum("n_tokens").alias("t")), "cells")
    rates = calibrate(rake(cells, {x: targets[d] for x, d in dims.items()}, sweeps, tolerance), budget).select(*dims, F.col("w").alias("_weight"), F.col("p").alias("_probability"))
    same = reduce(lambda a, b: a & b, [docs[f"`{d}`"].eqNullSafe(rates[x]) for x, d in dims.items()])
    out = docs.join(rates, same, "left").drop(*dims).drop("weight", "probability", "selected")
    out = out.withColumnsRenamed({"_weight": "weight", "_probability": "probability"})
    return out.withColumn("selected", draw(F.col("doc_id"), seed) < F.coalesce("probability", F.lit(0.0)))
