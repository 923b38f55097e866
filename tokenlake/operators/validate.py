"""Release validation: the first failing reason of each row, repeated ids first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenlake.functions.arrays import SAMPLE_RATE, VOCABULARY, expected_frames
from tokenlake.functions.text import is_blank
from tokenlake.schemas import RELEASE
from tokenlake.sources.clips import ENCODER_TAG, require_columns


def token_reason(tokens: Column, n_samples: Column, tolerance: int = 1) -> Column:
    return F.when(F.size(tokens) == 0, "empty token sequence").when((F.array_min(tokens) < 0) | (F.array_max(tokens) >= VOCABULARY), "tokens out of range").when(F.abs(F.size(tokens) - expected_frames(n_samples)) > tolerance, "token count")


def row_reason(tolerance: int = 1) -> Column:
    """Null if the row is valid."""
    reason = F.when(F.col("audio_id").isNull(), "missing audio_id")
    for f in RELEASE.fieldNames()[1:]:
        reason = reason.when(F.col(f).isNull(), f"missing {f}")
    reason = reason.when(is_blank(F.col("text")), "empty transcript").when(F.col("sampling_rate") != SAMPLE_RATE, "sampling rate").when(F.col("encoder") != ENCODER_TAG, "encoder tag")
    return F.coalesce(reason, token_reason(F.col("tokens"), F.col("n_samples"), tolerance))


def validate(rows: DataFrame, position: str = "pos", tolerance: int = 1) -> DataFrame:
    """rows with reason: an id's first row (by position) is validated, later ones are repeats; null is valid.

    A null id has no first row: each such row is judged by itself.
    """
    require_columns(rows, tuple(RELEASE.fieldNames()))
    firsts = rows.groupBy("audio_id").agg(F.min(position).alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    marked = rows.join(firsts, "audio_id", "left")
    return marked.withColumn("reason", F.when(F.col(position) > F.col("_first"), "duplicate audio_id").otherwise(row_reason(tolerance))).drop("_first")


def summary(validated: DataFrame) -> DataFrame:
    bad = F.col("reason").isNotNull()
    return validated.agg(F.count("*").alias("n_rows"), F.count_if(~bad).alias("n_ok"), F.count_if(bad).alias("n_errors"), ((F.count("*") > 0) & (F.count_if(bad) == 0)).alias("ok"))


def errors(validated: DataFrame, position: str = "pos") -> DataFrame:
    """A row per error, `id: reason`, with its position. A row without an id goes by its position."""
    name = F.coalesce("audio_id", F.concat(F.lit("<row "), F.col(position), F.lit(">")))
    return validated.where("reason is not null").select(position, F.concat(name, F.lit(": "), F.col("reason")).alias("error"))


def validate_parquet(spark: SparkSession, path: str, position: str | None = None, tolerance: int = 1) -> DataFrame:
    """A written release read again, its numbers in the release's types, and validated. Without a column for it, a row's
    position is its place in the files.
    """
    rows = spark.read.parquet(path)
    require_columns(rows, tuple(RELEASE.fieldNames()))
    if position is None:
        position = "pos"
        rows = rows.withColumn(position, F.monotonically_increasing_id())
    return validate(rows.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in RELEASE.fields}), position, tolerance)


def require_valid(rows: DataFrame, position: str = "pos") -> DataFrame:
    """rows, if all are valid; an error before anything is written otherwise."""
    got = summary(validate(rows, position)).first()
    if not got.ok:
        raise ValueError(f"{got.n_ok}/{got.n_rows} rows valid, {got.n_errors} errors")
    return rows


def duplicates(rows: DataFrame, key: str = "audio_id", position: str = "pos") -> DataFrame:
    """All but the first row of each repeated key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(position))).where("_n > 1").drop("_n")


def release(store: DataFrame) -> DataFrame:
    """Rows with a text, in the release's schema."""
    return store.where(~is_blank(F.col("text"))).withColumn("encoder", F.lit(ENCODER_TAG)).withColumn("sampling_rate", F.lit(SAMPLE_RATE))


def dropped(store: DataFrame) -> DataFrame:
    return store.where(is_blank(F.col("text")))
