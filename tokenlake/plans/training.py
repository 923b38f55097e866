"""Queries: training preparation, grids, evaluation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.functions.arrays import generated_codes
from tokenlake.operators import prepare as pp
from tokenlake.operators import ranks
from tokenlake.plans.registry import query
from tokenlake.plans.errors import LATIN, REASON_SQL
from tokenlake.operators import tokens as tk
from tokenlake.sources.clips import CLIPS_SQL, clips, cut, table

MOST, BASE = 896, pp.SPEECH_BASE
EARLY_SQL = REASON_SQL.format(letters=LATIN, latin="false and", least=50, most=MOST - pp.OVERHEAD)
PREPARED_SQL = CLIPS_SQL + f""", early as (select *, {EARLY_SQL} as early, list_filter(string_split(trim(regexp_replace(lower(text), '[\\s\\x0B]+', ' ', 'g')), ' '), lambda w: w <> '') as words from clips),
    made as (select *, [1, 2, 3, 4] || [('0x' || substr(md5(w), 1, 4))::int + 10 for w in words] || [5, 6, 7] as head from early),
    whole as (select *, head || [8] || [t + {BASE} for t in tokens] || [9] as ids from made),
    prepared as (select audio_id, coalesce(early, case when len(words) = 0 then 'empty_phonemes' when len(ids) > {MOST} then 'too_long_with_phonemes' end, '') as reject, len(head)::int as start, len(ids)::int as n, ids from whole),
    kept as (select * from prepared where reject = '')"""  # fmt: skip
DIGEST = "md5({}::varchar)"


def digest(column: str) -> F.Column:
    """An array of integers as text, hashed: what DuckDB's cast of a list gives."""
    return F.md5(F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: x.cast("string")), ", "), F.lit("]")).cast("binary"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pp.prepare(clips(spark, sf_dir), MOST, letters=LATIN)


def kept(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the kept rows. They are prepared once: a filter on the reason, pushed below, would make the ids again."""
    return cut(prepared(spark, sf_dir).select("reject", *columns), "prepared").where("reject = ''").drop("reject")


@query(f"with {PREPARED_SQL} select audio_id, reject, case when reject = '' then start else -1 end as speech_start_idx, case when reject = '' then n else 0 end as length, case when reject = '' then {DIGEST.format('ids')} else md5('[]') end as ids_md5 from prepared")
def prepare_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select("audio_id", "reject", "speech_start_idx", "length", digest("input_ids").alias("ids_md5"))


@query(f"with {PREPARED_SQL} select audio_id, start as speech_start_idx, n as length from kept")
def prepare_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pp.kept(prepared(spark, sf_dir)).select("audio_id", "speech_start_idx", "length")


@query(f"with {PREPARED_SQL} select reject, count(*) as n from prepared where reject <> '' group by 1")
def prepare_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pp.reject_histogram(prepared(spark, sf_dir))


@query(f"with {CLIPS_SQL} select audio_id, len(tokens)::int + 9 as length, {DIGEST.format(f'([1, 2, 3, 4, 5, 6, 7, 8] || [t + {BASE} for t in tokens] || [9])')} as ids_md5 from clips")
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bare template around each clip's codes."""
    from tokenlake.functions.arrays import assemble as put

    none = F.array().cast("array<int>")
    rows = clips(spark, sf_dir).select("audio_id", put(pp.head(none), F.col("tokens"), BASE, pp.SPEECH_START, pp.SPEECH_END).alias("ids"))
    return rows.select("audio_id", F.size("ids").alias("length"), digest("ids").alias("ids_md5"))


@query(f"select count(*) as n, count(distinct code) = 65536 and bool_and(id = code + {BASE}) and min(code) = 0 and max(code) = 65535 as ok from (select range as code, range + {BASE} as id from range(65536))")
def contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pp.contiguous(spark.range(65536).select(F.col("id").alias("code"), (F.col("id") + BASE).alias("id")))


@query(f"with {PREPARED_SQL}, b as (select *, (row_number() over (partition by n order by audio_id) - 1) // 4 as batch, ((n + 7) // 8 * 8)::int as padded from kept) select audio_id, padded, {DIGEST.format('(ids || [0 for i in range(padded - n)])')} as ids_md5, {DIGEST.format('([-100 for i in range(start)] || ids[start + 1 :] || [-100 for i in range(padded - n)])')} as labels_md5, n as attended from b")
def collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of four rows of one length: ids are numbered first, the arrays join them last."""
    rows = kept(spark, sf_dir, "audio_id", "input_ids", "speech_start_idx", "length")
    places = ranks.numbered(rows, "length", "audio_id").select("audio_id", F.concat_ws(":", "length", F.floor(F.col("number") / 4)).alias("batch"))
    got = pp.collate(rows.join(places, "audio_id"))
    return got.select("audio_id", "padded", digest("input_ids").alias("ids_md5"), digest("labels").alias("labels_md5"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("attended"))


@query(f"with {CLIPS_SQL} select audio_id, len(tokens)::int + 8 as n_ids, {DIGEST.format(f'([1, 2, 3, 4, 5, 6, 7, 8] || [t + {BASE} for t in tokens])')} as ids_md5 from clips")
def build_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt with the clip's own codes as reference."""
    none = F.array().cast("array<int>")
    ids = F.concat(pp.head(none), F.array(F.lit(pp.SPEECH_START)), F.transform("tokens", lambda t: t + BASE))
    return clips(spark, sf_dir).select("audio_id", ids.alias("ids")).select("audio_id", F.size("ids").alias("n_ids"), digest("ids").alias("ids_md5"))


@query(f"with {CLIPS_SQL}, g as (select audio_id, [t - 1000 for t in tokens if t >= 1000] as codes, len(tokens) as n from clips) select audio_id, len(codes)::int as n_codes, {DIGEST.format('codes')} as codes_md5 from g")
def generated_codes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of which some lie below the codec's range, an end mark, and ids after it."""
    ids = F.concat(F.transform("tokens", lambda t: t + BASE - 1000), F.array(F.lit(9), F.lit(BASE + 1)))
    rows = clips(spark, sf_dir).select("audio_id", generated_codes(ids, BASE, 9).alias("codes"))
    return rows.select("audio_id", F.size("codes").alias("n_codes"), digest("codes").alias("codes_md5"))


LENGTHS_SQL = PREPARED_SQL + ", r as (select n as x, row_number() over (order by n, audio_id) - 1 as rank, count(*) over () as n from kept)"


@query(f"with {LENGTHS_SQL} select " + ", ".join(f"max(x) filter (where rank = floor({p}::double * (n - 1))) as {q}" for q, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + ", max(x) as longest from r")
def seq_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranks.global_rank(kept(spark, sf_dir, "audio_id", "length").withColumnRenamed("length", "x"), "x", "audio_id", total="n")
    return rows.agg(*[ranks.floor_quantile("x", p).alias(q) for q, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))], F.max("x").alias("longest"))


def exclusive(p: float) -> str:
    at = f"({p}::double * (n + 1) - 1)"
    low = f"least(greatest(floor({at}), 0), n - 2)"
    return f"sum(case when rank = {low} then x * (1 - ({at} - {low})) when rank = {low} + 1 then x * ({at} - {low}) end)"


TOKENS_SQL = CLIPS_SQL + ", r as (select len(tokens)::bigint as x, row_number() over (order by len(tokens), audio_id) - 1 as rank, count(*) over () as n from clips)"


def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.global_rank(clips(spark, sf_dir).select("audio_id", F.size("tokens").cast("long").alias("x")), "x", "audio_id", total="n")


@query(f"with {TOKENS_SQL} select min(x) as shortest, " + ", ".join(f"round({exclusive(p)}, 6) as {q}" for q, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + ", max(x) as longest, sum(x)::bigint as total from r")
def length_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_lengths(spark, sf_dir)
    return rows.agg(F.min("x").alias("shortest"), *[F.round(ranks.exclusive_quantile(rows, "x", p), 6).alias(q) for q, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))], F.max("x").alias("longest"), F.sum("x").alias("total"))


@query(f"with {TOKENS_SQL}, q as (select (floor(({exclusive(0.99)} + 63) / 64) * 64)::bigint as recommended from r) select recommended, round(100.0::double * count(*) filter (where x <= recommended) / count(*), 6) as coverage_pct from r, q group by 1")
def recommended_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_lengths(spark, sf_dir)
    one = rows.agg((F.floor((ranks.exclusive_quantile(rows, "x", 0.99) + 63) / 64) * 64).cast("long").alias("recommended"))
    return rows.join(F.broadcast(one)).groupBy("recommended").agg(F.round(100.0 * F.count_if(F.col("x") <= F.col("recommended")) / F.count("*"), 6).alias("coverage_pct"))  # one row


@query(f"with {PREPARED_SQL} select count(*) as n, sum(n - start - 2)::bigint as speech_tokens, round(sum(n - start - 2) / 50.0::double / 3600, 6) as hours, round(1 - sum(n) / (count(*) * {MOST}::double), 6) as padding_waste from kept")
def padding_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pp.padding_stats(pp.kept(prepared(spark, sf_dir)), MOST).withColumns({c: F.round(c, 6) for c in ("hours", "padding_waste")})


@query(f"with {PREPARED_SQL}, d as (select audio_id, n, row_number() over (order by ('0x' || substr(md5('42:' || audio_id), 1, 8))::bigint / 4294967296.0::double, audio_id) - 1 as rank, count(*) over () as m from kept) select case when rank < least(500, greatest(1, m // 10)) then 'eval' else 'train' end as split, count(*) as n, sum(n)::bigint as tokens from d group by 1")
def prepared_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split, written by split, read back."""
    from tokenlake.operators.sampling import train_eval_split
    from tokenlake.sources.clips import scratch

    path = scratch(spark, "prepared")
    train_eval_split(pp.kept(prepared(spark, sf_dir)), 500).write.partitionBy("split").parquet(path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), F.sum("length").alias("tokens"))


@query("select rows, batch, accumulate, devices, batch * accumulate * devices as effective, (rows + batch * accumulate * devices - 1) // (batch * accumulate * devices) as steps_per_epoch, ((rows + batch * accumulate * devices - 1) // (batch * accumulate * devices) * 3) * 3 // 100 as warmup from (select count(*) as rows from documents), (values (1, 8, 1), (2, 8, 1), (4, 4, 2)) t(batch, accumulate, devices)")
def train_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").agg(F.count("*").alias("rows"))
    grid = spark.sql("select * from values (1, 8, 1), (2, 8, 1), (4, 4, 2) t(batch, accumulate, devices)")
    out = grid.join(F.broadcast(rows)).withColumn("effective", F.expr("batch * accumulate * devices"))  # one row
    out = out.withColumn("steps_per_epoch", F.expr("(rows + effective - 1) div effective"))
    return out.withColumn("warmup", F.expr("steps_per_epoch * 3 * 3 div 100"))


RATE_SQL = PREPARED_SQL + """, spoken as (select audio_id, start - 7 as n_phone, n - start - 2 as n_speech from kept), rates as (select n_speech / n_phone as x, row_number() over (order by n_speech / n_phone, audio_id) - 1 as rank, count(*) over () as m from spoken where n_phone > 5 and n_speech > 25),
    rate_band as (select max(x) filter (where rank = floor(0.05::double * (m - 1))) as p05, max(x) filter (where rank = floor(0.5::double * (m - 1))) as median, max(x) filter (where rank = floor(0.95::double * (m - 1))) as p95, max(m) as n from rates)"""  # fmt: skip


def spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audio_id, n_phone, n_speech of prepared rows."""
    around = len(pp.PREFIX) + len(pp.INFIX) + 2
    return kept(spark, sf_dir, "audio_id", "speech_start_idx", "length").select("audio_id", (F.col("speech_start_idx") - around).alias("n_phone"), (F.col("length") - F.col("speech_start_idx") - 2).alias("n_speech"))


@query(f"with {RATE_SQL} select round(p05, 9) as p05, round(median, 9) as median, round(p95, 9) as p95, n from rate_band")
def rate_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech tokens per phone token of the corpus itself, of rows with more than 5 phones and 25 codes."""
    return tk.rate_band(spoken(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("p05", "median", "p95")})


@query(f"with {RATE_SQL} select audio_id, round(n_speech / n_phone / median, 6) as ratio, case when n_phone <= 0 then '?' when n_speech / n_phone < p05 then 'TOO_SHORT' when n_speech / n_phone > p95 then 'TOO_LONG' else 'ok' end as verdict from spoken, rate_band")
def duration_verdict_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against the band that the corpus gives."""
    rows = cut(spoken(spark, sf_dir), "spoken")
    banded = rows.join(F.broadcast(tk.rate_band(rows)))  # one row
    ratio, verdict = tk.duration_verdict(*map(F.col, ("n_phone", "n_speech", "p05", "median", "p95")))
    return banded.select("audio_id", F.round(ratio, 6).alias("ratio"), verdict.alias("verdict"))


STATE = "552000000::double * 16 / 1073741824"


@query(f"select l as seq_len, b as batch, round(floor_gib, 2) as floor_gib, case when floor_gib > 22 then 'OOM' when floor_gib > 17 then 'tight' else 'ok' end as verdict from (select l, b, {STATE} + b * l * 217216::double * 10 / 1073741824 as floor_gib from (values (256), (512), (896), (1024), (2048)) x(l), (values (1), (2), (4)) y(b))")
def vram_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence lengths x batch sizes: a grid of literals."""
    grid = spark.sql("select explode(array(256, 512, 896, 1024, 2048)) as seq_len").withColumn("batch", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    gib = F.lit(552_000_000.0) * 16 / 2**30 + F.col("batch") * F.col("seq_len") * F.lit(217_216.0) * 10 / 2**30
    return grid.select("seq_len", "batch", F.round(gib, 2).alias("floor_gib"), F.when(gib > 22, "OOM").when(gib > 17, "tight").otherwise("ok").alias("verdict"))


GRID_SQL = """grid as (select item_id, text, model, seed, ('0x' || substr(md5(item_id || ':' || model || ':' || seed), 1, 6))::bigint as h from benchmark, (values ('base'), ('ft')) m(model), (values (1), (2), (3)) s(seed)),
    evals as (select item_id, 'c' || item_id % 5 as category, model, seed, 50 + h % 900 as n_codes, (50 + h % 900) / 50.0::double as duration_s, h % 11 <> 0 as hit_eos, 50 + h % 900 <= 55 as at_min_floor, 50 + h % 900 >= 945 as at_max_tokens, (h % 1000) / 1000.0::double as unique_ratio,
    case when h % 7 = 0 then 'TOO_SHORT' else 'ok' end as duration_verdict, case when h % 13 = 0 then 'LOOPING' else 'ok' end as degeneracy_verdict from grid)"""  # fmt: skip


def evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items x models x seeds, with a hash in place of a model's output."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.lit("base"), F.lit("ft"))).alias("model")).withColumn("seed", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "item_id", "model", "seed").cast("binary")), 1, 6), 16, 10).cast("long")
    rows = rows.withColumn("h", h).withColumn("n_codes", 50 + F.col("h") % 900)
    return rows.select(
        "item_id", F.concat(F.lit("c"), F.col("item_id") % 5).alias("category"), "model", "seed", "n_codes", (F.col("n_codes") / F.lit(50.0)).alias("duration_s"), (F.col("h") % 11 != 0).alias("hit_eos"), (F.col("n_codes") <= 55).alias("at_min_floor"), (F.col("n_codes") >= 945).alias("at_max_tokens"),
        ((F.col("h") % 1000) / F.lit(1000.0)).alias("unique_ratio"), F.when(F.col("h") % 7 == 0, "TOO_SHORT").otherwise("ok").alias("duration_verdict"), F.when(F.col("h") % 13 == 0, "LOOPING").otherwise("ok").alias("degeneracy_verdict"),
    )


@query(f"with {GRID_SQL} select item_id, category, model, seed, n_codes, duration_s, hit_eos, at_min_floor, at_max_tokens from evals")
def eval_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals(spark, sf_dir).select("item_id", "category", "model", "seed", "n_codes", "duration_s", "hit_eos", "at_min_floor", "at_max_tokens")


@query(f"with {GRID_SQL} select model, seed, category, count(*) as n from evals where category in ('c1', 'c3') group by 1, 2, 3")
def eval_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some categories only."""
    return pp.of_categories(evals(spark, sf_dir), "c1,c3").groupBy("model", "seed", "category").agg(F.count("*").alias("n"))


@query(f"with {GRID_SQL} select model, category, count(*) as n, round(avg(unique_ratio), 9) as mean_unique, count(*) filter (where duration_verdict not in ('ok', '?')) as n_duration, count(*) filter (where degeneracy_verdict not in ('ok', '?')) as n_degenerate, count(*) filter (where at_min_floor) as n_floor, count(*) filter (where at_max_tokens) as n_max, count(*) filter (where not hit_eos) as n_no_eos from evals group by 1, 2")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = lambda c: F.count_if(~F.col(c).isin("ok", "?"))
    return evals(spark, sf_dir).groupBy("model", "category").agg(F.count("*").alias("n"), F.round(F.avg("unique_ratio"), 9).alias("mean_unique"), bad("duration_verdict").alias("n_duration"), bad("degeneracy_verdict").alias("n_degenerate"), F.count_if("at_min_floor").alias("n_floor"), F.count_if("at_max_tokens").alias("n_max"), F.count_if(~F.col("hit_eos")).alias("n_no_eos"))


@query(f"with {GRID_SQL} select item_id, model, round(max(duration_s) - min(duration_s), 6) as spread, max(duration_s) - min(duration_s) > 0.4 * avg(duration_s) as unstable from evals group by 1, 2")
def seed_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = F.max("duration_s") - F.min("duration_s")
    return evals(spark, sf_dir).groupBy("item_id", "model").agg(F.round(spread, 6).alias("spread"), (spread > 0.4 * F.avg("duration_s")).alias("unstable"))


@query(f"with {GRID_SQL}, m as (select category, avg(unique_ratio) filter (where model = 'ft') as ft, avg(unique_ratio) filter (where model = 'base') as base from evals group by 1) select category, round(ft, 9) as ft, round(base, 9) as base, round(ft - base, 9) as gain from m where ft is not null and base is not null")
def ft_vs_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = evals(spark, sf_dir).groupBy("category").pivot("model", ["ft", "base"]).agg(F.avg("unique_ratio")).where("ft is not null and base is not null")
    return wide.select("category", F.round("ft", 9).alias("ft"), F.round("base", 9).alias("base"), F.round(F.col("ft") - F.col("base"), 9).alias("gain"))


