"""Nested stratified sampling and splits: every sample is a prefix of one hash-made order."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlake.functions.arrays import duration_bucket
from tokenlake.operators.ranks import global_rank, numbered

EDGES = (2.0, 4.0, 6.0, 8.0, 10.0)


def u01(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from md5 of "seed:key"; built in, so also in other SQL engines."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def u01_blake(key: Column, seed: int = 42) -> Column:
    """The same from blake2b-64 (big-endian), which Spark lacks."""

    @F.pandas_udf(T.DoubleType())
    def run(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: int.from_bytes(hashlib.blake2b(f"{seed}:{k}".encode(), digest_size=8).digest(), "big") / 2.0**64, na_action="ignore")

    return run(key.cast("string"))


def stratified_keys(clips: DataFrame, seed: int = 42, edges=EDGES, draw=u01) -> DataFrame:
    """clips with bucket and sort_key: (rank in its stratum + the stratum's offset) / the stratum's size.

    Strata are duration bucket x channel. A stratum is ranked over a hash-range part of its own first, so that a hot
    stratum is many tasks: rank = rows of earlier parts + rank in the part.
    """
    parts = max(8, clips.count() // 100_000)
    rows = clips.withColumn("bucket", duration_bucket(F.col("duration"), edges)).withColumn("_u", draw(F.col("audio_id"), seed)).withColumn("_part", F.floor(F.col("_u") * parts).cast("int"))
    sizes = rows.groupBy("bucket", "channel", "_part").agg(F.count("*").alias("_rows"))
    stratum = Window.partitionBy("bucket", "channel")
    ahead = sizes.select("bucket", "channel", "_part", F.coalesce(F.sum("_rows").over(stratum.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"), F.sum("_rows").over(stratum).alias("_size"))
    local = F.row_number().over(Window.partitionBy("bucket", "channel", "_part").orderBy("_u", "audio_id")) - 1
    joined = rows.withColumn("_local", local).alias("r").join(ahead.alias("a"), F.col("r.bucket").eqNullSafe(F.col("a.bucket")) & F.col("r.channel").eqNullSafe(F.col("a.channel")) & (F.col("r._part") == F.col("a._part")))
    offset = draw(F.concat(F.lit("stratum:"), F.col("r.bucket"), F.lit(":"), F.col("r.channel")), seed)
    key = (F.col("_ahead") + F.col("_local") + offset) / F.col("_size")
    return joined.select("r.*", key.alias("sort_key")).drop("_u", "_part", "_local")


def stratified_order(clips: DataFrame, seed: int = 42, edges=EDGES, draw=u01) -> DataFrame:
    """clips with rank: their place in the nested order."""
    return global_rank(stratified_keys(clips, seed, edges, draw), "sort_key", "audio_id")


def audit_sample(clips: DataFrame, n: int, seed: int = 42, edges=EDGES, draw=u01) -> DataFrame:
    """The first n of the nested order (none if n <= 0)."""
    return stratified_keys(clips, seed, edges, draw).orderBy("sort_key", "audio_id").limit(max(0, n))


def stratum_counts(clips: DataFrame, edges=EDGES) -> DataFrame:
    return clips.groupBy(duration_bucket(F.col("duration"), edges).alias("bucket"), "channel").agg(F.count("*").alias("n"))


def exact_length_batches(clips: DataFrame, max_batch: int = 1, key: str = "audio_id") -> DataFrame:
    """clips with batch: clips of one n_samples only, max_batch at most, in the order of key (unique). Only ids are numbered."""
    places = numbered(clips, "n_samples", key).select(F.col("n_samples").alias("_n"), F.col(key).alias("_k"), F.floor(F.col("number") / max_batch).cast("long").alias("batch"))
    return clips.join(places, clips["n_samples"].eqNullSafe(places["_n"]) & (clips[key] == places["_k"])).drop("_n", "_k")


def random_subset(rows: DataFrame, share: float, seed: int = 42, key: str = "audio_id") -> DataFrame:
    """The rows whose draw, a hash of the key, is below the share: the same ones in every run, and nested in larger shares."""
    return rows.where(u01(F.col(key), seed) < share)


def train_eval_split(rows: DataFrame, requested: int, seed: int = 42, key: str = "audio_id") -> DataFrame:
    """rows with split: min(requested, max(1, n // 10)) of them eval, by a hash of the key."""
    ranked = global_rank(rows.withColumn("_u", u01(F.col(key), seed)), "_u", key, total="n")
    size = F.least(F.lit(requested), F.greatest(F.lit(1), F.floor(F.col("n") / 10)))
    return ranked.withColumn("split", F.when(F.col("rank") < size, "eval").otherwise("train")).drop("_u", "rank", "n")


def pending(work: DataFrame, done: DataFrame, key: str = "audio_id") -> DataFrame:
    """What is still to do: resume after an interruption."""
    return work.join(done.select(key).distinct(), key, "left_anti")
