"""Queries: signals, with the embeddings' components as samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.functions import arrays, signal
from tokenlake.plans.registry import query
from tokenlake.sources.clips import table

PAIRS_SQL = "pairs as (select a.vec_id, [x::double for x in a.embedding] as r, [x::double for x in b.embedding] as e from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector and the next one."""
    rows = table(spark, sf_dir, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e"))
    return rows.select("vec_id", F.col("embedding").alias("r")).join(after, "vec_id")


@query(f"with {PAIRS_SQL}, c as (select vec_id, [x - list_avg(r) for x in r] as r, [x - list_avg(e) for x in e] as e from pairs), s as (select *, list_dot_product(e, r) / list_dot_product(r, r) as k from c), n as (select vec_id, k * k * list_dot_product(r, r) as p, list_sum([(x - k * r[i]) ** 2 for x, i in e]) as q from s) select vec_id, round(least(100, 10 * log10(p / q)), 6) as si_sdr from n")
def si_sdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("vec_id", F.round(arrays.si_sdr(F.col("r"), F.col("e")), 6).alias("si_sdr"))


@query(f"with {PAIRS_SQL} select vec_id, round(list_dot_product(r, e) / (sqrt(list_dot_product(r, r)) * sqrt(list_dot_product(e, e))), 6) as cosine from pairs")
def cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("vec_id", F.round(arrays.cosine(F.col("r"), F.col("e")), 6).alias("cosine"))


@query("select vec_id, (64 + 56)::int as n_padded, round(list_sum([x::double for x in embedding]), 6) as total from embeddings")
def pad_to_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded to a multiple of 60 samples."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", arrays.pad_to_hop(F.transform("embedding", lambda x: x.cast("double")), 60).alias("p"))
    return rows.select("vec_id", F.size("p").alias("n_padded"), F.round(arrays.total(F.col("p")), 6).alias("total"))


@query("with r as (select vec_id, [x::double for x in embedding] as x, [trunc(greatest(-1.0, least(1.0, x::double)) * 32767) / 32768 for x in embedding] as y from embeddings) select vec_id, round(list_max([abs(a - greatest(-1.0, least(1.0, x[i]))) for a, i in y]), 9) as worst, round(list_sum(y), 6) as total from r")
def int16_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"), arrays.int16_roundtrip(F.col("embedding")).alias("y"))
    off = F.array_max(F.zip_with("x", "y", lambda a, b: F.abs(b - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a.cast("double"))))))
    return rows.select("vec_id", F.round(off, 9).alias("worst"), F.round(arrays.total(F.col("y")), 6).alias("total"))


@query("with r as (select vec_id, [x::double * 4 for x in embedding] as x from embeddings), p as (select *, list_max([abs(v) for v in x]) as peak from r) select vec_id, peak > 1 as scaled, round(list_sum(case when peak > 1 then [v / peak for v in x] else x end), 6) as total from p")
def peak_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 4).alias("x"))
    peak = F.array_max(F.transform("x", F.abs))
    return rows.select("vec_id", (peak > 1).alias("scaled"), F.round(arrays.total(arrays.peak_normalised(F.col("x"))), 6).alias("total"))


@query("""with f as (select vec_id, unnest(range(0, len(embedding) // 8)) as f, [x::double for x in embedding] as x from embeddings),
    m as (select vec_id, f, list_sum([v * v for v in x[f * 8 + 1 : f * 8 + 8]]) / 8 as energy, list_sum([(sign(x[f * 8 + i]) <> sign(x[f * 8 + i + 1]))::int for i in range(1, 8)]) / 7 as zcr from f),
    q as (select *, quantile_cont(energy, 0.2) over (partition by vec_id) as low, quantile_cont(zcr, 0.5) over (partition by vec_id) as mid from m)
    select vec_id, f as frame, round(energy, 9) as energy, round(zcr, 9) as zcr, case when energy < low then 0 when zcr < mid then 1 else 2 end as class from q""")
def frame_energy_zcr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 8 samples: energy, zero crossings, and a coarse class against the vector's own quantiles."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.expr("transform(sequence(0, size(embedding) div 8 - 1), f -> transform(slice(embedding, f * 8 + 1, 8), x -> double(x)))")).alias("frame", "s"))
    energy = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x) / F.size("s")
    cross = F.expr("aggregate(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (a, b) -> if(sign(a) <> sign(b), 1D, 0D)), 0D, (a, x) -> a + x) / (size(s) - 1)")
    rows = rows.select("vec_id", F.col("frame").cast("long").alias("frame"), energy.alias("energy"), cross.alias("zcr"))
    own = Window.partitionBy("vec_id")  # the frames of one clip
    low, mid = F.percentile("energy", F.lit(0.2)).over(own), F.percentile("zcr", F.lit(0.5)).over(own)
    return rows.select("vec_id", "frame", F.round("energy", 9).alias("energy"), F.round("zcr", 9).alias("zcr"), F.when(F.col("energy") < low, 0).when(F.col("zcr") < mid, 1).otherwise(2).alias("class"))


#: Sample o of 2 for 3: the input under a windowed sinc of 6 zero crossings, cut off at 0.99 of the lower rate.
RESAMPLED_SQL = """x as (select vec_id, generate_subscripts(embedding, 1) - 1 as j, unnest(embedding)::double as v from embeddings), o as (select vec_id, unnest(range((len(embedding) * 2 + 2) // 3)) as o from embeddings),
    t as (select vec_id, o, v, (j / 3.0::double - o / 2.0::double) * 1.98::double as t from o join x using (vec_id)),
    r as (select vec_id, o as i, sum(v * case when abs(t) >= 6 then 0 when t = 0 then 1 else sin(pi() * t) / (pi() * t) end * pow(cos(t * pi() / 12), 2) * 0.66::double) filter (where abs(t) < 6) as y from t group by 1, 2)"""  # fmt: skip


@query(f"with {RESAMPLED_SQL} select vec_id, i, round(coalesce(y, 0), 6) + 0 as sample from r")
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(signal.resample(F.transform("embedding", lambda x: x.cast("double")), 24_000, 16_000)).alias("i", "y"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), (F.round("y", 6) + F.lit(0.0)).alias("sample"))


@query(f"with {RESAMPLED_SQL}, p as (select r.vec_id, count(*) as n, sum(r.y * e.v) as dot from r join x e on r.vec_id = e.vec_id and r.i = e.j group by 1) select vec_id, n, round(dot, 5) + 0 as dot from p")
def align_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector against itself resampled, both cut to the shorter."""
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    r, e = signal.aligned(doubles, doubles)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", r.alias("r"), e.alias("e"))
    return rows.select("vec_id", F.size("e").cast("long").alias("n"), (F.round(arrays.total(F.zip_with("r", "e", lambda a, b: a * b)), 5) + F.lit(0.0)).alias("dot"))


#: One frame of 1024 around a clip of less than 512 samples, 513 magnitudes, 80 triangles on the mel scale.
MEL_SQL = PAIRS_SQL + """, s as (select vec_id, 0 as side, generate_subscripts(r, 1) - 1 as n, unnest(r) as v from pairs union all select vec_id, 1, generate_subscripts(e, 1) - 1, unnest(e) from pairs),
    m as (select vec_id, side, k, sqrt(pow(sum(v * w * c), 2) + pow(sum(v * w * d), 2)) as a from s join (select n, k, 0.5 - 0.5 * cos(2 * pi() * (512 + n) / 1024) as w, cos(2 * pi() * k * (512 + n) / 1024) as c, sin(2 * pi() * k * (512 + n) / 1024) as d from range(64) p(n), range(513) q(k)) using (n) group by 1, 2, 3),
    edges as (select i, 700 * (pow(10, i * 2595 * log10(1 + 8000 / 700.0::double) / 81 / 2595) - 1) as f from range(82) t(i)),
    bank as (select a.i as b, k, greatest(0, least((k * 15.625::double - a.f) / (b.f - a.f), (c.f - k * 15.625::double) / (c.f - b.f))) as h from edges a join edges b on b.i = a.i + 1 join edges c on c.i = a.i + 2, range(513) q(k)),
    logs as (select vec_id, side, b, ln(sum(a * h) + 1e-5::double) as y from m join (select * from bank where h > 0) using (k) group by 1, 2, 3), every as (select vec_id, side, b, coalesce(y, ln(1e-5::double)) as y from (select * from (select distinct vec_id, side from m), (select i as b from range(80) t(i))) left join logs using (vec_id, side, b))"""  # fmt: skip


@query(f"with {MEL_SQL} select vec_id, round(avg(abs(r.y - e.y)), 6) as mel_l1 from every r join every e using (vec_id, b) where r.side = 0 and e.side = 1 group by 1")
def mel_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("vec_id", F.round(signal.mel_l1("r", "e"), 6).alias("mel_l1"))
