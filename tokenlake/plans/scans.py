"""Queries: scans, validation, sampling, sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.functions.arrays import duration_bucket, expected_frames
from tokenlake.operators import ranks, sampling, validate
from tokenlake.plans.registry import query
from tokenlake.sources import clips as src
from tokenlake.sources.clips import CLIPS_SQL, ENCODER_TAG, clips, table

BUCKET_SQL = "len([e for e in [2.0, 4.0, 6.0, 8.0, 10.0] if e <= duration])"
U01_SQL = "('0x' || substr(md5('42:' || {key}), 1, 8))::bigint / 4294967296.0::double"


@query(f"with {CLIPS_SQL} select audio_id, channel, duration, n_samples from clips order by audio_id limit 100")
def scan_required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 clips (the reader's first-n feature), columns checked first."""
    rows = src.require_columns(clips(spark, sf_dir), ("audio_id", "text", "duration", "channel"))
    return rows.select("audio_id", "channel", "duration", "n_samples").orderBy("audio_id").limit(100)


@query(f"with {CLIPS_SQL} select audio_id, len(tokens)::bigint as n_tokens, n_samples, expected_frames, text from clips")
def token_store_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to shards and read back."""
    path = src.scratch(spark, "store")
    src.write_token_store(clips(spark, sf_dir), path)
    return src.token_store(spark, path).select("audio_id", F.size("tokens").cast("long").alias("n_tokens"), "n_samples", "expected_frames", "text")


@query(f"with {CLIPS_SQL} select channel, count(*) as n_rows, sum(len(tokens))::bigint as n_tokens, count(distinct audio_id) as n_ids from clips group by 1")
def token_store_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = src.scratch(spark, "store")
    src.write_token_store(clips(spark, sf_dir), path, per_file=500)
    return src.token_store(spark, path).groupBy("channel").agg(F.count("*").alias("n_rows"), F.sum(F.size("tokens")).alias("n_tokens"), F.count_distinct("audio_id").alias("n_ids"))


@query(f"with {CLIPS_SQL} select lang, count(*) as n, sum(n_samples)::bigint as n_samples from clips group by 1")
def shards_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clips(spark, sf_dir).select("audio_id", "lang", "n_samples")
    whole = rows.where("lang = 'en'").unionByName(rows.where("lang <> 'en' or lang is null"))
    return whole.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_samples").alias("n_samples"))


@query(f"with {CLIPS_SQL} select audio_id, text from clips where trim(coalesce(text, '')) <> ''")
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.references(clips(spark, sf_dir))


@query("select conv_id, arg_max(text, turn) as text, count(*) as n_records from conversations group by 1")
def hyps_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return src.last_wins(turns, "conv_id", "text", "turn").join(turns.groupBy("conv_id").agg(F.count("*").alias("n_records")), "conv_id")


TORN = "case when event_id % 10 = 0 then substr(props, 1, 4) else props end"


@query(f"select event_id, (json_extract_string(line, '$.k'))::bigint as k from (select event_id, {TORN} as line from events) where json_valid(line) and json_extract_string(line, '$.k') is not null")
def jsonl_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select("event_id", F.expr(TORN).alias("value"))
    return src.tolerant_ids(lines, field="k", kind="long").select("event_id", "k")


@query("select vec_id, label, round(list_sum([x::double for x in embedding]), 6) as total from embeddings")
def signal_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
    path = src.scratch(spark, "csv")
    src.write_csv(rows, path)
    return src.read_csv(spark, path, rows.schema)


@query(f"with {CLIPS_SQL} select audio_id, n_samples, expected_frames, round(duration * 1000)::bigint as duration_ms from clips")
def preprocess_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clips(spark, sf_dir)
    return rows.select("audio_id", "n_samples", expected_frames(F.col("n_samples")).alias("expected_frames"), F.round(F.col("duration") * 1000).cast("long").alias("duration_ms"))


@query(f"with {CLIPS_SQL} select audio_id, channel, text, n_samples, len(tokens)::bigint as n_tokens, '{ENCODER_TAG}' as encoder, 16000 as sampling_rate from clips where trim(coalesce(text, '')) <> ''")
def release_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.release(clips(spark, sf_dir)).select("audio_id", "channel", "text", "n_samples", F.size("tokens").cast("long").alias("n_tokens"), "encoder", "sampling_rate")


@query(f"with {CLIPS_SQL} select audio_id, case when text is null then 'null' else 'blank' end as reason from clips where trim(coalesce(text, '')) = ''")
def dropped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.dropped(clips(spark, sf_dir)).select("audio_id", F.when(F.col("text").isNull(), "null").otherwise("blank").alias("reason"))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store as a release, followed by repeats of some ids."""
    rows = clips(spark, sf_dir).withColumn("encoder", F.lit(ENCODER_TAG)).withColumn("sampling_rate", F.expr("case when pos % 71 = 0 then 24000 else 16000 end"))
    return rows.unionByName(rows.where("pos % 61 = 0").withColumn("pos", F.col("pos") + F.lit(10_000_000_000)))


RELEASES_SQL = CLIPS_SQL + """, one as (select *, 'codec-v1' as encoder, case when pos % 71 = 0 then 24000 else 16000 end as sampling_rate from clips),
    releases as (select * from one union all select * replace (pos + 10000000000 as pos) from one where pos % 61 = 0),
    validated as (select *, case when row_number() over (partition by audio_id order by pos) > 1 then 'duplicate audio_id' when channel is null then 'missing channel' when text is null then 'missing text'
    when trim(text) = '' then 'empty transcript' when sampling_rate <> 16000 then 'sampling rate' when len(tokens) = 0 then 'empty token sequence' when list_min(tokens) < 0 or list_max(tokens) >= 65536 then 'tokens out of range'
    when abs(len(tokens) - expected_frames) > 1 then 'token count' end as reason from releases)"""  # fmt: skip


@query(f"with {RELEASES_SQL} select audio_id, pos, coalesce(reason, 'ok') as reason from validated")
def validate_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate(releases(spark, sf_dir)).select("audio_id", "pos", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query(f"with {RELEASES_SQL} select count(*) as n_rows, count(*) filter (where reason is null) as n_ok, count(reason) as n_errors, count(*) > 0 and count(reason) = 0 as ok from validated")
def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.summary(validate.validate(releases(spark, sf_dir)))


@query(f"with {RELEASES_SQL} select pos, audio_id || ': ' || reason as error from validated where reason is not null")
def validate_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of a release that was written and read again."""
    path = src.scratch(spark, "release")
    releases(spark, sf_dir).write.parquet(path)
    return validate.errors(validate.validate_parquet(spark, path, "pos"))


@query(f"with {RELEASES_SQL} select audio_id, pos from validated where reason = 'duplicate audio_id'")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicates(releases(spark, sf_dir)).select("audio_id", "pos")


@query(f"with {CLIPS_SQL} select count(*) as n, count(*) filter (where len(tokens) <> n_samples // 320) as n_inexact, count(*) filter (where abs(len(tokens) - expected_frames) > 1) as n_beyond_one, max(abs(len(tokens) - expected_frames))::bigint as worst from clips")
def frame_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = F.abs(F.size("tokens") - F.col("expected_frames"))
    return clips(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(F.expr("size(tokens) <> n_samples div 320")).alias("n_inexact"), F.count_if(off > 1).alias("n_beyond_one"), F.max(off).cast("long").alias("worst"))


@query(f"with {CLIPS_SQL} select audio_id, round({U01_SQL.format(key='audio_id')}, 12) as u from clips")
def u01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips(spark, sf_dir).select("audio_id", F.round(sampling.u01(F.col("audio_id")), 12).alias("u"))


@query()
def u01_blake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips(spark, sf_dir).select("audio_id", sampling.u01_blake(F.col("audio_id")).alias("u"))


@query()
def stratified_order_blake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested order by blake2b draws, which SQL lacks; tests hold it against a Python model."""
    return sampling.stratified_order(clips(spark, sf_dir).select("audio_id", "channel", "duration"), draw=sampling.u01_blake).select("audio_id", "bucket", "channel", "rank")


@query(f"with {CLIPS_SQL} select audio_id from clips where {U01_SQL.format(key='audio_id')} < 0.25")
def random_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.random_subset(clips(spark, sf_dir).select("audio_id"), 0.25)


@query("select count(*) as n, count(k) as n_k, sum(k)::bigint as total from (select (json_extract_string(props, '$.k'))::bigint as k from events)")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records appended as JSON lines and read in full."""
    path = src.scratch(spark, "jsonl")
    src.append_json(table(spark, sf_dir, "events").select(F.from_json("props", "k long").alias("p")).select("p.k"), path)
    return src.read_json_lines(spark, path, "k long").agg(F.count("*").alias("n"), F.count("k").alias("n_k"), F.sum("k").alias("total"))


@query(f"with {CLIPS_SQL} select audio_id, {BUCKET_SQL}::bigint as bucket from clips")
def duration_bucket_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips(spark, sf_dir).select("audio_id", duration_bucket(F.col("duration")).alias("bucket"))


ORDER_SQL = CLIPS_SQL + f""", drawn as (select *, {BUCKET_SQL}::bigint as bucket, {U01_SQL.format(key='audio_id')} as u from clips),
    keyed as (select *, ((row_number() over (partition by bucket, channel order by u, audio_id) - 1) + {U01_SQL.format(key="'stratum:' || bucket || ':' || channel")}) / count(*) over (partition by bucket, channel) as sort_key from drawn),
    ordered as (select *, row_number() over (order by sort_key, audio_id) - 1 as rank from keyed)"""  # fmt: skip


@query(f"with {ORDER_SQL} select audio_id, bucket, channel, rank, round(sort_key, 9) as sort_key from ordered")
def stratified_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_order(clips(spark, sf_dir).select("audio_id", "channel", "duration")).select("audio_id", "bucket", "channel", "rank", F.round("sort_key", 9).alias("sort_key"))


@query(f"with {ORDER_SQL} select audio_id, bucket, channel from ordered where rank < 3000")
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.audit_sample(clips(spark, sf_dir).select("audio_id", "channel", "duration"), 3000).select("audio_id", "bucket", "channel")


@query(f"with {CLIPS_SQL} select {BUCKET_SQL}::bigint as bucket, channel, count(*) as n from clips group by 1, 2")
def stratum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratum_counts(clips(spark, sf_dir))


@query(f"with {CLIPS_SQL} select audio_id, n_samples, (row_number() over (partition by n_samples order by audio_id) - 1) // 3 as batch from clips")
def exact_length_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact_length_batches(clips(spark, sf_dir).select("audio_id", "n_samples"), 3)


RANKED_SQL = CLIPS_SQL + ", ranked as (select audio_id, n_samples, row_number() over (order by audio_id) - 1 as rank, count(*) over () as n from clips)"


@query(f"with {RANKED_SQL}, picks as (select i, (i * (select max(n) from ranked)) // 64 as place from range(64) t(i)) select audio_id, rank, i from ranked join picks on rank = place")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.even_sample(clips(spark, sf_dir).select("audio_id"), 64, "audio_id").select("audio_id", "rank", "i")


@query(f"with {RANKED_SQL} select audio_id, rank from ranked where rank % greatest(1, n // 64) = 0 and rank // greatest(1, n // 64) < 64")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.stride_sample(clips(spark, sf_dir).select("audio_id"), 64, "audio_id").select("audio_id", "rank")


@query(f"with {CLIPS_SQL}, by_length as (select audio_id, n_samples, row_number() over (order by n_samples, audio_id) - 1 as rank, count(*) over () as n from clips) select p, audio_id, n_samples from by_length, (values (0.1::double), (0.5::double), (0.9::double)) t(p) where rank = floor(p * (n - 1))::bigint")
def gt_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips at length quantiles."""
    rows = ranks.global_rank(clips(spark, sf_dir).select("audio_id", "n_samples"), "n_samples", "audio_id", total="n")
    at = F.expr("filter(array(0.1D, 0.5D, 0.9D), p -> floor(p * (n - 1)) = rank)")
    return rows.select(F.explode(at).alias("p"), "audio_id", "n_samples")


@query(f"with {CLIPS_SQL}, drawn as (select audio_id, row_number() over (order by {U01_SQL.format(key='audio_id')}, audio_id) - 1 as rank, count(*) over () as n from clips) select audio_id, case when rank < least(200, greatest(1, n // 10)) then 'eval' else 'train' end as split from drawn")
def train_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.train_eval_split(clips(spark, sf_dir).select("audio_id"), 200).select("audio_id", "split")


@query(f"with {ORDER_SQL} select o.audio_id, o.bucket, len(c.tokens)::bigint as n_tokens from ordered o join clips c using (audio_id) where o.rank < 300")
def sample_to_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sampled ids meet their rows."""
    rows = clips(spark, sf_dir)
    sample = sampling.audit_sample(rows.select("audio_id", "channel", "duration"), 300).select("audio_id", "bucket")
    return rows.select("audio_id", F.size("tokens").cast("long").alias("n_tokens")).join(F.broadcast(sample), "audio_id")  # 300 rows


@query(f"with {CLIPS_SQL} select audio_id, lang from clips anti join (select doc_id from labels) l on clips.pos = l.doc_id")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips not yet labelled."""
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"))
    return sampling.pending(clips(spark, sf_dir).select("audio_id", "pos", "lang"), done, "pos").select("audio_id", "lang")


@query("select doc_id from documents where lang = 'en' intersect select doc_id from labels")
def ids_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id").intersect(table(spark, sf_dir, "labels").select("doc_id"))


@query("(select doc_id from documents union select doc_id from labels) except (select doc_id from documents intersect select doc_id from labels)")
def ids_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return d.union(e).distinct().exceptAll(d.intersect(e))
