"""Global ranks, order statistics and samples by position, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.sources.clips import cut


def global_rank(df: DataFrame, *keys: str, name: str = "rank", total: str | None = None) -> DataFrame:
    """df with its 0-based position in the order of keys (which must be unique for the order to be fixed).

    Rows are computed once, range-partitioned, and numbered within partitions; the partitions' sizes (one small row
    each) give offsets, and the number of all rows in a column `total` if asked for.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = cut(df, "unranked")  # range partitioning reads its input twice
    parts = cut(df.repartitionByRange(max(1, n), *keys).withColumn("_part", F.spark_partition_id()), "ranks")
    numbered = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*keys)))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    whole = [F.sum("_n").over(Window.partitionBy()).alias(total)] if total else []
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), *whole)
    return numbered.join(offsets, "_part").withColumn(name, F.col("_ahead") + F.col("_local") - 1).drop("_part", "_local", "_ahead")


def numbered(df: DataFrame, group: str, key: str, name: str = "number") -> DataFrame:
    """group, key and the 0-based place of key (unique) in its group: rank among all less the group's first rank.

    A hot group is as many tasks as its rows need. The firsts of groups of more than one row in 512 (fewer than 512 of
    them) are broadcast.
    """
    ranked = cut(global_rank(df.select(group, key), group, key, name="_rank", total="_total"), "numbered")
    firsts = cut(ranked.groupBy(group, "_total").agg(F.min("_rank").alias("_first"), F.count("*").alias("_n")), "firsts")
    hot = F.col("_n") * 512 > F.col("_total")
    few, rest = (firsts.where(c).select(F.col(group).alias("_group"), "_first") for c in (hot, ~hot))
    same = F.col(group).eqNullSafe(F.col("_group"))
    whole = ranked.join(F.broadcast(few), same).unionByName(ranked.join(F.broadcast(few), same, "left_anti").join(rest, same))
    return whole.select(group, key, (F.col("_rank") - F.col("_first")).alias(name))


def exclusive_quantile(ranked: DataFrame, value: str, p: float) -> Column:
    """An aggregate over ranked rows (columns rank, n): the exclusive quantile, interpolated between two positions."""
    at = F.lit(p) * (F.col("n") + 1) - 1
    low = F.least(F.greatest(F.floor(at), F.lit(0)), F.col("n") - 2)
    weight = at - low
    return F.sum(F.when(F.col("rank") == low, F.col(value) * (1 - weight)).when(F.col("rank") == low + 1, F.col(value) * weight))


def distribution(rows: DataFrame, value: str, key: str) -> DataFrame:
    """mean, median, p5, p95 of a column; with fewer than 20 values the least and the greatest stand for the outer two."""
    ranked = global_rank(rows.where(F.col(value).isNotNull()).select(value, key), value, key, total="n")
    median = F.when(F.max("n") > 1, exclusive_quantile(ranked, value, 0.5)).otherwise(F.max(value))
    outer = lambda p, few: F.when(F.max("n") < 20, few).otherwise(exclusive_quantile(ranked, value, p))
    return ranked.agg(F.avg(value).alias("mean"), median.alias("median"), outer(0.05, F.min(value)).alias("p5"), outer(0.95, F.max(value)).alias("p95"))


def floor_quantile(value: str, p: float) -> Column:
    """An aggregate over ranked rows: the value at position int(p * (n - 1))."""
    return F.max(F.when(F.col("rank") == F.floor(F.lit(p) * (F.col("n") - 1)), F.col(value)))


def even_sample(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The rows at positions (i * n) // k, with i: a sample that reaches both ends."""
    ranked = global_rank(df, *keys, total="n")
    low = F.ceil(F.col("rank") * k / F.col("n")).cast("long")
    return ranked.withColumn("i", low).where((F.col("i") < k) & (F.floor(F.col("i") * F.col("n") / k) == F.col("rank"))).drop("n")


def stride_sample(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """The rows at positions i * max(1, n // k) for i below k."""
    ranked = global_rank(df, *keys, total="n")
    step = F.greatest(F.lit(1), F.floor(F.col("n") / k)).cast("long")
    return ranked.withColumn("step", step).where((F.col("rank") % F.col("step") == 0) & (F.col("rank") / F.col("step") < k)).drop("n", "step")
