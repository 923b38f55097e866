"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.llm import ann, langid, licenses, mixing, packing, ppm, quality, simhash, tokenstore, warc
from tokenlake.llm.common import crc_mod, saved, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = tokenstore.write_store(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return tokenstore.read_store(store)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_mod(F.col("doc_id"), 4) == 2)
    model = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    counts = saved(quality.measured(docs, ["doc_id", "lang"]), "measured")
    cuts = quality.thresholds(counts, table(spark, sf_dir, "labels"))
    return quality.judged(counts, cuts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, runs = warc.write_archives(table(spark, sf_dir, "pages"))
    index = saved(warc.merged_index(runs), "captures")
    return warc.read_captures(path, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts", "range", "rank")


@query
def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"))
    return ppm.score(docs, ~F.col("held_out"), keep=["doc_id", "held_out"])


@query
def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.TEMPLATES | licenses.TEXTS).drop("block")


#: Target marginals of the query: shares in proportion to a power of the observed tokens.
MIX_TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
MIX_BUDGET, MIX_SWEEPS = 0.6, 6


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", mixing.topic(F.col("text")).alias("topic"), mixing.tokens(F.col("text")).alias("n_tokens"))
    mixed = mixing.mix(docs, MIX_TARGETS, MIX_BUDGET, sweeps=MIX_SWEEPS)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), "selected")


def mixing_sql() -> str:
    """The same in SQL: raking and calibration are unrolled."""
    topic = "case " + " ".join(f"when regexp_matches(text, '{p}') then '{t}'" for t, p in mixing.TOPICS.items()) + " else 'prose' end"
    dims = list(MIX_TARGETS)
    steps = [
        f"d as (select doc_id, source, lang, {topic} as topic, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens from documents)",
        "c0 as materialized (select source, lang, topic, sum(n_tokens)::double as t, sum(n_tokens)::double as w from d group by all)",
    ]
    for dim, power in MIX_TARGETS.items():
        steps.append(f"g_{dim} as materialized (select {dim}, g / sum(g) over () as goal from (select {dim}, pow(sum(t), {power}) as g from c0 group by all))")
    i = 0
    for _ in range(MIX_SWEEPS):
        for dim in dims:
            rest = ", ".join(f"c{i}.{x}" for x in dims)
            steps.append(f"c{i + 1} as materialized (select {rest}, t, coalesce(case when s.have > 0 then w * (g.goal / s.have) else 0 end, 0) as w from c{i} left join (select {dim}, sum(w) as have from c{i} group by all) s on c{i}.{dim} is not distinct from s.{dim} left join g_{dim} g on c{i}.{dim} is not distinct from g.{dim})")
            i += 1
    steps.append(f"p0 as materialized (select *, 0.0::double as p from c{i})")
    for j in range(4):
        steps.append(f"p{j + 1} as materialized (select p{j}.* exclude (p), case when p >= 1 then 1.0 when t > 0 and o > 0 then least(1.0, greatest(a * {MIX_BUDGET} - k, 0.0) / o * w / t) else 0.0 end::double as p from p{j}, (select sum(t) as a, coalesce(sum(t) filter (where p >= 1), 0) as k, sum(w) filter (where p < 1) as o from p{j}))")
    u = "('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0"
    same = " and ".join(f"d.{x} is not distinct from p4.{x}" for x in dims)
    return f"with {', '.join(steps)} select doc_id, d.source, d.lang, d.topic, n_tokens, round(w, 9) as weight, round(p, 9) as probability, ({u}) < coalesce(p, 0) as selected from d left join p4 on {same}"


ORACLES["op3_mixing"] = mixing_sql()
