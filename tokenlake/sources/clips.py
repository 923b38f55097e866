"""Sources and sinks: the clips view, token store, JSON lines, CSV, wav, and the schema checks at their edges."""

from __future__ import annotations

import io
import tempfile
import uuid
import wave
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlake.functions.arrays import HOP, SAMPLE_RATE
from tokenlake.functions.text import WORD, is_blank
from tokenlake.schemas import HYPOTHESIS, TOKEN_STORE

#: The codec's tag in a release. Set it to the tag that the data carry.
ENCODER_TAG = "codec-v1"
REQUIRED = ("id", "audio", "text", "duration", "channel", "sample_rate", "n_channels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share; a local master may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tokenlake-")
    return f"{base.rstrip('/')}/tokenlake/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch folder and read again: computed once, and a lineage that outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require_columns(df: DataFrame, names: tuple[str, ...] = REQUIRED) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips derived from documents: a token per word, and lengths that follow from it (with planted faults)."""
    docs = table(spark, sf_dir, "documents")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    rows = docs.select(
        F.col("doc_id").alias("pos"), F.concat(F.lit("clip_"), F.expr("lpad(cast(doc_id as string), greatest(7, length(cast(doc_id as string))), '0')")).alias("audio_id"), F.col("source").alias("channel"), "lang",
        F.expr("case when doc_id % 53 = 0 then null when doc_id % 59 = 0 then '  ' else text end").alias("text"),
        F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int")).alias("tokens"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("_n"),
    )
    # The number of tokens is that of words: lengths need no token to be made.
    rows = rows.withColumn("n_samples", F.col("_n").cast("long") * HOP + F.col("pos") % HOP + F.expr("case when pos % 97 = 0 then 640 else 0 end"))
    return rows.drop("_n").withColumn("duration", F.col("n_samples").cast("double") / SAMPLE_RATE).withColumn("expected_frames", F.expr(f"greatest(1, n_samples div {HOP})"))


#: The same view in DuckDB.
CLIPS_SQL = """clips as (select *, n_samples::double / 16000 as duration, greatest(1, n_samples // 320) as expected_frames from (
    select *, len(tokens)::bigint * 320 + pos % 320 + (case when pos % 97 = 0 then 640 else 0 end) as n_samples from (
    select doc_id as pos, 'clip_' || lpad(doc_id::varchar, greatest(7, length(doc_id::varchar))::int, '0') as audio_id, source as channel, lang,
    case when doc_id % 53 = 0 then null when doc_id % 59 = 0 then '  ' else text end as text,
    [('0x' || substr(md5(w), 1, 4))::int for w in regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')] as tokens from documents)))"""


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short transcripts: audio_id, text, role of every conversation turn."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select(F.concat(F.lit("utt_"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("audio_id"), "text", "role", "conv_id", "turn")


UTTERANCES_SQL = "utterances as (select 'utt_' || conv_id || '_' || turn as audio_id, text, role, conv_id, turn from conversations)"


def write_token_store(rows: DataFrame, path: str, per_file: int = 2000) -> None:
    """Append shards; their names are unique, so a lost shard is never written over."""
    rows.select(*TOKEN_STORE.fieldNames()).write.mode("append").option("maxRecordsPerFile", per_file).parquet(path)


def token_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOKEN_STORE).parquet(path)


def references(rows: DataFrame, position: str = "pos") -> DataFrame:
    """audio_id, text of rows with a text; the last of a repeated id counts."""
    return rows.where(~is_blank(F.col("text"))).groupBy("audio_id").agg(F.max_by("text", position).alias("text"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines in full: a torn line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_hypotheses(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, HYPOTHESIS)


def last_wins(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    return rows.groupBy(key).agg(F.coalesce(F.max_by(value, position), F.lit("")).alias(value))


def tolerant_ids(lines: DataFrame, column: str = "value", field: str = "audio_id", kind: str = "string") -> DataFrame:
    """The field of every line that parses and has it; torn lines and lines without it are left out."""
    parsed = F.from_json(F.col(column), f"{field} {kind}", {"mode": "PERMISSIVE"})
    return lines.withColumn(field, parsed.getField(field)).where(F.col(field).isNotNull())


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """path, sampling_rate, n_channels, samples (mono, in [-1, 1)) of 16-bit wav files."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with wave.open(io.BytesIO(content)) as f:
                    raw = np.frombuffer(f.readframes(f.getnframes()), dtype="<i2").reshape(-1, f.getnchannels())
                    out.append((name, f.getframerate(), f.getnchannels(), (raw.mean(axis=1) / 32768).tolist()))
            yield pd.DataFrame(out, columns=["path", "sampling_rate", "n_channels", "samples"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, "path string, sampling_rate int, n_channels int, samples array<double>")


def wav_bytes(rows: DataFrame, samples: str = "samples", rate: int = SAMPLE_RATE) -> DataFrame:
    """rows with wav: the samples as a 16-bit mono file's bytes."""

    @F.pandas_udf(T.BinaryType())
    def encode(column):
        import numpy as np

        def one(x):
            out = io.BytesIO()
            with wave.open(out, "wb") as f:
                f.setnchannels(1)
                f.setsampwidth(2)
                f.setframerate(rate)
                f.writeframes((np.clip(np.asarray(x, dtype=float), -1, 1) * 32767).astype("<i2").tobytes())
            return out.getvalue()

        return column.map(one, na_action="ignore")

    return rows.withColumn("wav", encode(samples))
