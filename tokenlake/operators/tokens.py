"""Statistics over token arrays: codebook use, degeneracy, bands and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.functions.arrays import VOCABULARY, unique_ratio
from tokenlake.operators.ranks import floor_quantile, global_rank
from tokenlake.sources.clips import cut


def codebook_counts(clips: DataFrame) -> DataFrame:
    return clips.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def codebook_usage(clips: DataFrame) -> DataFrame:
    """tokens, distinct, coverage, entropy in bits, perplexity, share of the 1000 most frequent. At most VOCABULARY counts."""
    counts = codebook_counts(clips)
    whole = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), "token").limit(1000).agg(F.sum("n").alias("top"))
    p = F.col("n") / F.col("total")
    out = counts.join(F.broadcast(whole)).groupBy("total").agg(F.count("*").alias("n_distinct"), F.sum(-p * F.log2(p)).alias("entropy_bits"))
    return out.join(F.broadcast(top)).select(F.col("total").alias("n_tokens"), "n_distinct", (100.0 * F.col("n_distinct") / VOCABULARY).alias("coverage_pct"), "entropy_bits", F.pow(F.lit(2.0), "entropy_bits").alias("perplexity"), (F.col("top") / F.col("total")).alias("top1000_share"))


def rank_frequency(clips: DataFrame) -> DataFrame:
    """token, n, rank, cumulative share: windows over at most VOCABULARY rows."""
    order = Window.orderBy(F.desc("n"), "token")
    every = Window.partitionBy()
    return codebook_counts(clips).select("token", "n", F.row_number().over(order).cast("long").alias("rank"), (F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(every)).alias("cumulative_share"))


def degeneracy(clips: DataFrame, n: int = 12, key: str = "audio_id") -> DataFrame:
    """key, n_codes, unique_ratio, repeat_frac, max_run of each clip's tokens.

    A position is covered if it lies in an n-gram that occurs again in its clip. Grams meet by (clip, 64-bit hash); only
    those that meet are compared in full. Runs are gaps and islands. A clip's positions meet by (clip, gram), not by clip.
    """
    at = cut(clips.select(key, "tokens", F.size("tokens").alias("len")), "tokens")
    grams = at.where(F.col("len") >= 2 * n).select(key, F.explode(F.expr(f"transform(sequence(1, len - {n - 1}), i -> struct(i as i, xxhash64(slice(tokens, i, {n})) as h))")).alias("x"))
    grams = cut(grams.select(key, "x.i", "x.h"), "grams")
    twice = grams.groupBy(key, "h").agg(F.count("*").alias("c")).where("c > 1").select(key, "h")
    met = grams.join(twice, [key, "h"], "left_semi")
    full = met.join(at.select(key, "tokens"), key).select(key, "i", F.expr(f"slice(tokens, i, {n})").alias("g"))
    again = full.groupBy(key, "g").agg(F.count("*").alias("c"), F.collect_list("i").alias("i")).where("c > 1").select(key, F.explode("i").alias("i"))
    covered = again.select(key, F.explode(F.expr(f"sequence(i, i + {n - 1})")).alias("p")).distinct().groupBy(key).agg(F.count("*").alias("covered"))
    islands = at.select(key, F.posexplode("tokens").alias("p", "v")).withColumn("island", F.col("p") - F.row_number().over(Window.partitionBy(key, "v").orderBy("p")))
    runs = islands.groupBy(key, "v", "island").agg(F.count("*").alias("run")).groupBy(key).agg(F.max("run").alias("max_run"))
    out = at.select(key, F.col("len").cast("long").alias("n_codes"), unique_ratio(F.col("tokens")).alias("unique_ratio")).join(covered, key, "left").join(runs, key, "left")
    return out.select(key, "n_codes", "unique_ratio", F.coalesce(F.try_divide(F.coalesce("covered", F.lit(0)), F.col("n_codes")), F.lit(0.0)).alias("repeat_frac"), F.coalesce("max_run", F.lit(0)).cast("long").alias("max_run"))


def rate_band(spoken: DataFrame, key: str = "audio_id") -> DataFrame:
    """p05, median, p95 (floor index) and n of speech tokens per phone, over rows with more than 5 phones and 25 speech tokens."""
    rates = spoken.where((F.col("n_phone") > 5) & (F.col("n_speech") > 25)).select(key, (F.col("n_speech") / F.col("n_phone")).alias("x"))
    ranked = global_rank(rates, "x", key, total="_n").withColumnRenamed("_n", "n")
    return ranked.agg(*[floor_quantile("x", p).alias(q) for q, p in (("p05", 0.05), ("median", 0.5), ("p95", 0.95))], F.count("*").alias("n"))


def duration_verdict(n_phone: Column, n_speech: Column, p05: Column, median: Column, p95: Column) -> tuple[Column, Column]:
    """(ratio to the median rate, verdict)."""
    rate = F.when(n_phone > 0, n_speech / n_phone)
    ratio = F.when(n_phone > 0, rate / median).otherwise(F.lit(float("nan")))
    return ratio, F.when(n_phone <= 0, "?").when(rate < p05, "TOO_SHORT").when(rate > p95, "TOO_LONG").otherwise("ok")


def degeneracy_verdict(unique: Column, repeat: Column, run: Column, unique_p05: Column, repeat_p95: Column, run_p95: Column) -> Column:
    flags = F.array_compact(F.array(F.when(unique < unique_p05, "LOW_DIVERSITY"), F.when(repeat > F.greatest(repeat_p95, F.lit(0.02)), "LOOPING"), F.when(run > F.greatest(run_p95.cast("double"), F.lit(3.0)), "STUCK")))
    return F.when(F.size(flags) > 0, F.array_join(flags, ";")).otherwise("ok")
