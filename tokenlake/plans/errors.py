"""Queries: transcripts, error counts, rates, bootstrap, the verdict, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.functions import text as tx
from tokenlake.operators import ranks, stats
from tokenlake.plans.registry import query
from tokenlake.sources.clips import CLIPS_SQL, UTTERANCES_SQL, clips, cut, table, utterances

#: A letter that no turn holds: k words or letters of it for others, with deletions only or insertions only beside them,
#: are as many edits as substitutions and deletions (or insertions) together, so that SQL has a closed form.
NOVEL = "\u0298"
#: References are turns; the original's transcript lacks system turns and every 13th word, and has NOVEL for every 11th from
#: the 5th on; the reconstruction's has NOVEL for every 7th from the 3rd on, and one word more after every 17th.
HYPS_SQL = UTTERANCES_SQL + """, norm as (select *, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(text, '\\p{P}', '', 'g'), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '^ | $', '', 'g') as ref from utterances),
    split as (select *, string_split(ref, ' ') as w from norm),
    pairs as (select audio_id, role, ref, list_filter(w, lambda x, i: i % 13 <> 0) as kept, list_filter(w, lambda x, i: i % 13 <> 0 and i % 11 = 5) as so, list_filter(w, lambda x, i: i % 7 = 3) as sr, w from split where role <> 'system'),
    counts as (select audio_id, (len(w) - len(kept) + len(so))::bigint as w_err_orig, (len(sr) + len(w) // 17)::bigint as w_err_recon, len(w)::bigint as w_ref,
    (length(ref) - length(array_to_string(kept, ' ')) + length(array_to_string(so, '')))::bigint as c_err_orig, (length(array_to_string(sr, '')) + len(w) // 17 * 2)::bigint as c_err_recon, length(ref)::bigint as c_ref from pairs)"""  # fmt: skip


def hypotheses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, hypotheses of the original, of the reconstruction)."""
    rows = utterances(spark, sf_dir).withColumn("ref", tx.normalize_transcript("text"))
    words = tx.word_array(F.col("ref"))
    swapped = lambda k, at: F.transform(words, lambda x, i: F.when((i + 1) % k == at, F.repeat(F.lit(NOVEL), F.char_length(x))).otherwise(x))
    orig = F.array_join(F.filter(swapped(11, 5), lambda x, i: (i + 1) % 13 != 0), " ")
    recon = F.array_join(F.transform(swapped(7, 3), lambda x, i: F.when((i + 1) % 17 == 0, F.concat(x, F.lit(f" {NOVEL}"))).otherwise(x)), " ")
    return rows.select("audio_id", "ref"), rows.where("role <> 'system'").select("audio_id", orig.alias("hyp_orig")), rows.select("audio_id", recon.alias("hyp_recon"))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, o, e = hypotheses(spark, sf_dir)
    return cut(stats.clip_counts(r.join(o, "audio_id").join(e, "audio_id"), normalize=False), "counts")


@query(f"with {HYPS_SQL} select audio_id, len(w)::bigint as n_ref, len(kept)::bigint as n_orig, (len(w) + len(w) // 17)::bigint as n_recon from pairs")
def audit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, o, e = hypotheses(spark, sf_dir)
    n = lambda c: F.size(tx.word_array(F.col(c))).cast("long")
    return r.join(o, "audio_id").join(e, "audio_id").select("audio_id", n("ref").alias("n_ref"), n("hyp_orig").alias("n_orig"), n("hyp_recon").alias("n_recon"))


@query(f"with {UTTERANCES_SQL} select audio_id from utterances where role = 'system'")
def audit_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that some side has and not all have."""
    r, o, e = hypotheses(spark, sf_dir)
    whole = r.join(o, "audio_id").join(e, "audio_id").select("audio_id")
    return o.select("audio_id").join(e.select("audio_id"), "audio_id", "full").join(whole, "audio_id", "left_anti")


@query(f"with {HYPS_SQL} select * from counts")
def clip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir)


RATES_SQL = "rates as (select count(*) as n_clips, sum(w_ref)::bigint as n_ref_words, {s} * sum(w_err_orig) / sum(w_ref) as wer_orig, {s} * sum(w_err_recon) / sum(w_ref) as wer_recon, {s} * sum(c_err_orig) / sum(c_ref) as cer_orig, {s} * sum(c_err_recon) / sum(c_ref) as cer_recon from counts where w_ref > 0)"
RATE_NAMES = ("wer_orig", "wer_recon", "cer_orig", "cer_recon", "delta_wer", "delta_cer")


@query(f"with {HYPS_SQL}, {RATES_SQL.format(s='100.0::double')} select n_clips, n_ref_words, round(wer_orig, 6) as wer_orig, round(wer_recon, 6) as wer_recon, round(cer_orig, 6) as cer_orig, round(cer_recon, 6) as cer_recon, round(wer_recon - wer_orig, 6) as delta_wer, round(cer_recon - cer_orig, 6) as delta_cer from rates")
def corpus_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.corpus_rates(counted(spark, sf_dir).where("w_ref > 0"))
    return got.select("n_clips", "n_ref_words", *[F.round(c, 6).alias(c) for c in RATE_NAMES])


@query(f"with {HYPS_SQL}, {RATES_SQL.format(s='1.0::double')} select round(wer_orig, 9) as wer_orig, round(wer_recon, 9) as wer_recon, round(cer_orig, 9) as cer_orig, round(cer_recon, 9) as cer_recon, round(wer_recon - wer_orig, 9) as delta_wer, round(cer_recon - cer_orig, 9) as delta_cer from rates")
def delta_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As fractions."""
    got = stats.corpus_rates(counted(spark, sf_dir), scale=1.0)
    return got.select(*[F.round(c, 9).alias(c) for c in RATE_NAMES])


@query(f"with {HYPS_SQL}, signals as (select 'utt_' || conv_id || '_' || turn as audio_id, length(text)::double / 50 as duration, role as channel from conversations where turn > 0) select c.audio_id, w_err_orig, w_err_recon, w_ref, duration, channel from counts c left join signals s using (audio_id) where w_ref > 0")
def per_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with the signal columns of the clips that have them."""
    signals = utterances(spark, sf_dir).where("turn > 0").select("audio_id", (F.char_length("text").cast("double") / 50).alias("duration"), F.col("role").alias("channel"))
    return counted(spark, sf_dir).where("w_ref > 0").join(signals, "audio_id", "left").select("audio_id", "w_err_orig", "w_err_recon", "w_ref", "duration", "channel")


def draws_sql(source: str, value: str, stat: str, iters: int) -> str:
    """The keyed bootstrap in SQL over a CTE `items` (audio_id and the columns of stat)."""
    return f"""{source}, numbered as (select *, row_number() over (order by audio_id) - 1 as place from {value}), size as (select count(*) as n from numbered),
    draws as (select r, ('0x' || substr(md5('42:' || r || ':' || d), 1, 8))::bigint % n as place from size, range({iters}) a(r), range((select n from size)) b(d)),
    stats as (select r, {stat} as value from draws join numbered using (place) group by r), sorted as (select list_sort(list(value)) as v from stats where value is not null)
    select round(v[floor(0.025::double * len(v))::int + 1], 6) as lo, round(v[least(len(v) - 1, floor(0.975::double * len(v))::int) + 1], 6) as hi, len(v)::bigint as n_draws from sorted"""


ITERS = 2000
SPEAKER_SQL = "speakers as (select doc_id as audio_id, quality::double + doc_id % 7 / 10.0::double as value from labels)"


@query("with " + draws_sql(HYPS_SQL, "(select * from counts where w_ref > 0)", "100.0::double * (sum(w_err_recon) - sum(w_err_orig)) / sum(w_ref)", ITERS))
def bootstrap_delta_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.bootstrap_ci(counted(spark, sf_dir).where("w_ref > 0"), stats.delta_wer_stat(), iters=ITERS)
    return got.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n_draws")


def speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("audio_id"), (F.col("quality").cast("double") + F.col("doc_id") % 7 / F.lit(10.0)).alias("value"))


@query("with " + draws_sql(SPEAKER_SQL, "speakers", "avg(value)", ITERS))
def bootstrap_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.bootstrap_ci(speakers(spark, sf_dir), F.avg("value"), iters=ITERS)
    return got.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n_draws")


@query(f"with {SPEAKER_SQL} select round(avg(value), 9) as mean, count(value) as n from speakers")
def speaker_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mean(speakers(spark, sf_dir), "value").withColumn("mean", F.round("mean", 9))


def exclusive_sql(p: str) -> str:
    at = f"({p}::double * (n + 1) - 1)"
    low = f"least(greatest(floor({at}), 0), n - 2)"
    return f"round(sum(case when rank = {low} then x * (1 - ({at} - {low})) when rank = {low} + 1 then x * ({at} - {low}) end), 6)"


@query(f"with {CLIPS_SQL}, ranked as (select duration as x, row_number() over (order by duration, audio_id) - 1 as rank, count(*) over () as n from clips) select round(avg(x), 6) as mean, {exclusive_sql('0.5')} as median, {exclusive_sql('0.05')} as p5, {exclusive_sql('0.95')} as p95 from ranked")
def metric_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_dist(clips(spark, sf_dir).select("audio_id", F.col("duration").alias("x")), "audio_id")


def rounded_dist(rows: DataFrame, key: str) -> DataFrame:
    return ranks.distribution(rows, "x", key).select(*[F.round(c, 6).alias(c) for c in ("mean", "median", "p5", "p95")])


@query("select round(avg(r_regionkey), 6) as mean, round(median(r_regionkey), 6) as median, min(r_regionkey)::double as p5, max(r_regionkey)::double as p95 from region")
def metric_dist_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewer than 20 values: the least and the greatest stand for the outer percentiles."""
    return rounded_dist(table(spark, sf_dir, "region").select("r_regionkey", F.col("r_regionkey").cast("double").alias("x")), "r_regionkey")


CASES = "(0.5, 2.0, 0.9, 0.95), (6.0, 9.0, 0.9, 0.95), (3.0, 7.0, 0.9, 0.95), (0.5, 2.0, 0.78, 0.83), (6.0, 9.0, 0.78, 0.83), (0.5, 2.0, 0.5, 0.7), (0.5, 2.0, null, null), (5.0, 6.0, null, null)"
DECIDE_SQL = "case when lo > 5.0 or coalesce(slo_hi < 0.8, false) then 'TRIGGER' when hi < 5.0 and coalesce(slo > 0.8, true) then 'NO_TRIGGER' else 'EXPAND' end"


@query(f"select lo::double as lo, hi::double as hi, {DECIDE_SQL} as verdict from (values {CASES}) t(lo, hi, slo, slo_hi)")
def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"select double(a) as lo, double(b) as hi, double(c) as slo, double(d) as shi from values {CASES} t(a, b, c, d)")
    return rows.select("lo", "hi", stats.decide(F.col("lo"), F.col("hi"), F.col("slo"), F.col("shi")).alias("verdict"))


PLACE_SQL = "case when {lo} > {at} then 'entirely above' when {hi} < {at} then 'entirely below' else 'straddles' end"


@query("select lo::double as lo, hi::double as hi, slo::double as slo, 'delta-WER CI [' || printf('%.2f', lo::double) || ', ' || printf('%.2f', hi::double) || '] ' || " + PLACE_SQL.format(lo="lo", hi="hi", at="5.0") + " || ' 5.0 pts' as wer_reason, case when slo is null then 'speaker similarity not computed' else 'speaker-sim CI [' || printf('%.3f', slo::double) || ', ' || printf('%.3f', slo_hi::double) || '] ' || " + PLACE_SQL.format(lo="slo", hi="slo_hi", at="0.8") + f" || ' 0.8' end as speaker_reason from (values {CASES}) t(lo, hi, slo, slo_hi)")
def decide_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"select double(a) as lo, double(b) as hi, double(c) as slo, double(d) as shi from values {CASES} t(a, b, c, d)")
    said = rows.withColumn("said", stats.decide_reasons(F.col("lo"), F.col("hi"), F.col("slo"), F.col("shi")))
    return said.select("lo", "hi", "slo", F.col("said")[0].alias("wer_reason"), F.col("said")[1].alias("speaker_reason"))


@query("select n, case when n < 3000 then 3000 when n < 8000 then 8000 when n < 20000 then 20000 end as next from (values (0), (2999), (3000), (8000), (19999), (20000)) t(n)")
def expand_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("select n from values (0), (2999), (3000), (8000), (19999), (20000) t(n)").select("n", stats.next_rung(F.col("n")).alias("next"))


@query("with ci as (" + "with " + draws_sql(HYPS_SQL, "(select * from counts where w_ref > 0)", "100.0::double * (sum(w_err_recon) - sum(w_err_orig)) / sum(w_ref)", ITERS) + f"), t as (with {HYPS_SQL}, {RATES_SQL.format(s='100.0::double')} select * from rates) select case when lo > 5.0 then 'TRIGGER' when hi < 5.0 then 'NO_TRIGGER' else 'EXPAND' end as verdict, n_clips, round(wer_recon - wer_orig, 6) as delta_wer, lo, hi from ci, t")
def audit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: transcripts to counts, rates, interval and decision."""
    counts = counted(spark, sf_dir).where("w_ref > 0")
    ci = stats.bootstrap_ci(counts, stats.delta_wer_stat(), iters=ITERS)
    both = stats.corpus_rates(counts).join(F.broadcast(ci))  # one row
    null = F.lit(None).cast("double")
    return both.select(stats.decide(F.col("lo"), F.col("hi"), null, null).alias("verdict"), "n_clips", F.round("delta_wer", 6).alias("delta_wer"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


#: Rows beside the documents, which hold no Arabic: letters with marks, letters to unify, punctuation, a lengthening mark.
ARABIC = ["\u0643\u064e\u062a\u064e\u0628\u064e", "\u0623\u062d\u0645\u062f \u0625\u0644\u0649 \u0622\u062e\u0631", "\u0645\u062f\u0631\u0633\u0629\u060c \u0643\u0628\u064a\u0631\u0629\u061f", "\u0648\u0627\u062e\u0640\u0640\u0627  \u061b ok!"]
ARABIC_ROWS = ", ".join(f"({-i}, '{t}')" for i, t in enumerate(ARABIC, 1))
UNIFY_SQL = "translate(regexp_replace(text, '[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0640]', '', 'g'), '\u0623\u0625\u0622\u0649\u0629', '\u0627\u0627\u0627\u064a\u0647')"


@query(f"with d as (select doc_id, {UNIFY_SQL} as text from (select doc_id, text from documents union all select * from (values {ARABIC_ROWS}) t(doc_id, text))) select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\p{{P}}', '', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', ' ', 'g'), '[\\s\\x0B]+', ' ', 'g'), '^ | $', '', 'g') as text from d")
def normalize_ar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and a few rows of Arabic."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.sql(f"select bigint(a) as doc_id, b as text from values {ARABIC_ROWS} t(a, b)"))
    return rows.select("doc_id", tx.normalize_transcript("text").alias("text"))


@query("select doc_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(text, '–', '-'), '—', '-'), '‘', ''''), '’', ''''), '“', '\"'), '”', '\"'), '[\\s\\x0B]+', ' ', 'g')) as text from documents")
def g2p_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.speech_text("text").alias("text"))


REASON_SQL = "case when text is null then 'null_text' when trim(text) = '' then 'empty_text' when not regexp_matches(text, '{letters}') then 'no_arabic_letters' when regexp_matches(text, '[0-9]') then 'contains_digits' when {latin} regexp_matches(text, '[A-Za-z]{{2,}}') then 'latin_run' when len(tokens) < {least} then 'too_short' when len(tokens) > {most} then 'too_long' end"
LATIN = "[A-Za-z]"


@query(f"with {CLIPS_SQL} select audio_id, coalesce({REASON_SQL.format(letters=LATIN, latin='false and', least=50, most=883)}, 'keep') as reason from clips")
def filter_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With Latin as the script looked for, since the tables hold no Arabic."""
    rows = clips(spark, sf_dir).select("audio_id", "text", "tokens", tx.mapped_text("text").alias("mapped"))
    return rows.select("audio_id", F.coalesce(tx.reject_reason(F.col("text"), F.col("mapped"), F.size("tokens"), 883, letters=LATIN), F.lit("keep")).alias("reason"))


@query(f"with {CLIPS_SQL} select reason, count(*) as n from (select {REASON_SQL.format(letters=LATIN, latin='false and', least=50, most=883)} as reason from clips) where reason is not null group by 1")
def reject_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_reason(spark, sf_dir).where("reason <> 'keep'").groupBy("reason").agg(F.count("*").alias("n"))


@query("with c as (select unnest(string_split(text, '')) as c from documents) select c, count(*) as n, regexp_matches(c, '\\p{L}') as letter, regexp_matches(c, '\\p{Mn}') as mark from c where c <> '' group by 1, 3, 4")
def char_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    return chars.groupBy("c").agg(F.count("*").alias("n")).select("c", "n", F.col("c").rlike(r"\p{L}").alias("letter"), F.col("c").rlike(r"\p{Mn}").alias("mark"))


RAW = "('[1, 2, 3]'), ('4,5 6'), ('  7 8,,9  '), ('x y'), (''), ('[]'), ('[1,'), ('65535')"


@query("select raw, case when trim(raw) like '[%' then case when json_valid(trim(raw)) then array_to_string(from_json(trim(raw), '[\"INTEGER\"]'), ',') end when regexp_full_match(trim(raw), '[,\\s]*[0-9]+([,\\s]+[0-9]+)*[,\\s]*') then array_to_string(list_filter(regexp_split_to_array(trim(raw), '[,\\s]+'), lambda x: x <> ''), ',') end as parsed from (values " + RAW + ") t(raw)")
def parse_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"select raw from values {RAW} t(raw)")
    return rows.select("raw", F.array_join(F.transform(tx.parsed_tokens(F.col("raw")), lambda t: t.cast("string")), ",").alias("parsed"))
