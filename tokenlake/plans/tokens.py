"""Queries: token statistics and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.functions.arrays import fsq_digits
from tokenlake.operators import ranks
from tokenlake.operators import tokens as tk
from tokenlake.plans.registry import query
from tokenlake.sources.clips import CLIPS_SQL, clips, cut

COUNTS_SQL = CLIPS_SQL + ", flat as (select unnest(tokens) as token from clips), freq as (select token, count(*) as n from flat group by 1), ranked as (select *, row_number() over (order by n desc, token) as rank, sum(n) over () as total from freq)"


@query(f"with {COUNTS_SQL}, e as (select max(total)::bigint as n_tokens, count(*) as n_distinct, sum(-(n / total) * log2(n / total)) as h, sum(n) filter (where rank <= 1000) / max(total) as top from ranked) select n_tokens, n_distinct, round(100.0::double * n_distinct / 65536, 6) as coverage_pct, round(h, 6) as entropy_bits, round(pow(2, h), 3) as perplexity, round(top, 6) as top1000_share from e")
def codebook_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tk.codebook_usage(clips(spark, sf_dir))
    return got.select("n_tokens", "n_distinct", *[F.round(c, 6).alias(c) for c in ("coverage_pct", "entropy_bits", "top1000_share")], F.round("perplexity", 3).alias("perplexity"))


@query(f"with {COUNTS_SQL} select token, n, rank, round(sum(n) over (order by rank) / total, 9) as cumulative_share from ranked")
def rank_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.rank_frequency(clips(spark, sf_dir)).withColumn("cumulative_share", F.round("cumulative_share", 9))


@query(f"with {CLIPS_SQL}, flat as (select unnest(tokens) as t from clips), d as (select count(distinct t) as n_distinct from flat) select count(*) as n_rows, round(sum(duration) / 3600, 6) as hours, sum(len(tokens))::bigint as n_tokens, max(n_distinct) as n_distinct, round(100.0::double * max(n_distinct) / 65536, 6) as coverage_pct, case when count(*) < 1000 then 'n<1K' when count(*) < 10000 then '1K<n<10K' when count(*) < 100000 then '10K<n<100K' else '100K<n<1M' end as size_category from clips, d")
def release_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clips(spark, sf_dir)
    distinct = rows.select(F.explode("tokens").alias("t")).agg(F.count_distinct("t").alias("n_distinct"))
    sums = rows.agg(F.count("*").alias("n_rows"), F.round(F.sum("duration") / 3600, 6).alias("hours"), F.sum(F.size("tokens")).alias("n_tokens"))
    size = F.when(F.col("n_rows") < 1000, "n<1K").when(F.col("n_rows") < 10000, "1K<n<10K").when(F.col("n_rows") < 100000, "10K<n<100K").otherwise("100K<n<1M")
    return sums.join(F.broadcast(distinct)).withColumn("coverage_pct", F.round(100.0 * F.col("n_distinct") / 65536, 6)).withColumn("size_category", size)  # one row


DEGENERACY_SQL = CLIPS_SQL + """, pos as (select audio_id, unnest(tokens) as v, generate_subscripts(tokens, 1) as p from clips),
    grams as (select audio_id, i, tokens[i : i + 11] as g from (select audio_id, tokens, unnest(range(1, len(tokens) - 10)) as i from clips where len(tokens) >= 24)),
    again as (select audio_id, i from (select *, count(*) over (partition by audio_id, g) as c from grams) where c > 1),
    covered as (select audio_id, count(distinct i + k) as covered from again, range(12) r(k) group by 1),
    runs as (select audio_id, max(c) as max_run from (select audio_id, v, count(*) as c from (select *, p - row_number() over (partition by audio_id, v order by p) as island from pos) group by audio_id, v, island) group by 1),
    degenerate as (select audio_id, len(tokens)::bigint as n_codes, case when len(tokens) > 0 then len(list_distinct(tokens)) / len(tokens) else 0 end as unique_ratio, case when len(tokens) > 0 then coalesce(covered, 0) / len(tokens) else 0 end as repeat_frac, coalesce(max_run, 0)::bigint as max_run from clips left join covered using (audio_id) left join runs using (audio_id))"""  # fmt: skip


@query(f"with {DEGENERACY_SQL} select audio_id, n_codes, round(unique_ratio, 9) as unique_ratio, round(repeat_frac, 9) as repeat_frac, max_run from degenerate")
def degeneracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tk.degeneracy(clips(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("unique_ratio", "repeat_frac")})


BAND_KEYS = ("unique_ratio", "repeat_frac", "max_run")
BANDS_SQL = DEGENERACY_SQL + "".join(f", b_{k} as (select {k}::double as x, row_number() over (order by {k}, audio_id) - 1 as rank, count(*) over () as n from degenerate where n_codes > 25)" for k in BAND_KEYS) + ", bands as (" + " union all ".join(f"select '{k}' as measure, " + ", ".join(f"max(x) filter (where rank = floor({p}::double * (n - 1))) as {q}" for q, p in (("p05", 0.05), ("median", 0.5), ("p95", 0.95))) + f" from b_{k}" for k in BAND_KEYS) + ")"


@query(f"with {BANDS_SQL} select measure, round(p05, 9) as p05, round(median, 9) as median, round(p95, 9) as p95 from bands")
def reference_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands(cut(tk.degeneracy(clips(spark, sf_dir)), "degeneracy")).withColumns({c: F.round(c, 9) for c in ("p05", "median", "p95")})


def bands(measured: DataFrame) -> DataFrame:
    """measure, p05, median, p95 (floor index) of clips with more than 25 codes."""
    long = measured.where("n_codes > 25").select("audio_id", F.posexplode(F.array(*[F.col(k).cast("double") for k in BAND_KEYS])).alias("m", "x"))
    out = None
    for m, k in enumerate(BAND_KEYS):
        rows = ranks.global_rank(long.where(F.col("m") == m).select("x", "audio_id"), "x", "audio_id", total="n")
        one = rows.agg(*[ranks.floor_quantile("x", p).alias(q) for q, p in (("p05", 0.05), ("median", 0.5), ("p95", 0.95))]).select(F.lit(k).alias("measure"), "p05", "median", "p95")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"with {BANDS_SQL}, r as (select max(p05) filter (where measure = 'unique_ratio') as u, max(p95) filter (where measure = 'repeat_frac') as f, max(p95) filter (where measure = 'max_run') as m from bands), flags as (select audio_id, unique_ratio < u as a, repeat_frac > greatest(f, 0.02) as b, max_run > greatest(m, 3) as c from degenerate, r) select audio_id, case when a or b or c then concat_ws(';', case when a then 'LOW_DIVERSITY' end, case when b then 'LOOPING' end, case when c then 'STUCK' end) else 'ok' end as verdict from flags")
def degeneracy_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = cut(tk.degeneracy(clips(spark, sf_dir)), "degeneracy")
    at = lambda m, q: F.max(F.when(F.col("measure") == m, F.col(q)))
    one = bands(measured).agg(at("unique_ratio", "p05").alias("u"), at("repeat_frac", "p95").alias("f"), at("max_run", "p95").alias("m"))
    rows = measured.join(F.broadcast(one))  # one row
    return rows.select("audio_id", tk.degeneracy_verdict(F.col("unique_ratio"), F.col("repeat_frac"), F.col("max_run"), F.col("u"), F.col("f"), F.col("m")).alias("verdict"))


PHONES_SQL = "len([c for c in string_split(coalesce(text, ''), ' ') if c <> ''])"


@query(f"with {CLIPS_SQL}, r as (select audio_id, {PHONES_SQL}::bigint as n_phone, len(tokens)::bigint as n_speech from clips) select audio_id, round(case when n_phone > 0 then n_speech / n_phone / 1.0 end, 6) as ratio, case when n_phone <= 0 then '?' when n_speech / n_phone < 0.9 then 'TOO_SHORT' when n_speech / n_phone > 1.1 then 'TOO_LONG' else 'ok' end as verdict from r")
def duration_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against a fixed band of tokens per word."""
    rows = clips(spark, sf_dir).select("audio_id", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")).alias("n_phone"), F.size("tokens").alias("n_speech"))
    ratio, verdict = tk.duration_verdict(F.col("n_phone"), F.col("n_speech"), F.lit(0.9), F.lit(1.0), F.lit(1.1))
    return rows.select("audio_id", F.round(F.nanvl(ratio, F.lit(None).cast("double")), 6).alias("ratio"), verdict.alias("verdict"))


@query(f"with {CLIPS_SQL} select token, token % 8 as d0, token // 8 % 8 as d1, token // 64 % 8 as d2, token // 512 % 8 as d3, token // 4096 % 16 as d4 from (select distinct unnest(tokens) as token from clips)")
def fsq_digits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With levels 8, 8, 8, 8, 16: an assumption of this query; the levels are a parameter."""
    rows = clips(spark, sf_dir).select(F.explode("tokens").alias("token")).distinct().withColumn("d", fsq_digits(F.col("token"), [8, 8, 8, 8, 16]))
    return rows.select("token", *[F.col("d")[i].alias(f"d{i}") for i in range(5)])


@query(f"with {CLIPS_SQL}, g as (select channel, count(*) as n from clips group by 1) select channel, n, (select count(*) from g) as n_channels, round((select max(n) from g) / (select sum(n) from g), 9) as largest_share from g order by n desc, channel limit 15")
def channel_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = clips(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"))
    whole = counts.agg(F.count("*").alias("n_channels"), F.round(F.max("n") / F.sum("n"), 9).alias("largest_share"))
    return counts.orderBy(F.desc("n"), "channel").limit(15).join(F.broadcast(whole))  # one row


@query(f"with {CLIPS_SQL}, r as (select min(duration) as lo, max(duration) as hi from clips) select least(39, floor((duration - lo) / ((hi - lo) / 40)))::bigint as bin, count(*) as n from clips, r group by 1")
def duration_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clips(spark, sf_dir).select("duration")
    ends = rows.agg(F.min("duration").alias("lo"), F.max("duration").alias("hi"))
    at = F.least(F.lit(39), F.floor((F.col("duration") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 40)))
    return rows.join(F.broadcast(ends)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))  # one row
