"""The corpus pipeline: five stages from raw documents to packed sequences. Part of the subpackage llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.llm import langid, mixing, nearcopies, packing, quality
from tokenlake.llm.common import crc_mod, shared_dir, table
from tokenlake.llm.queries import vocabulary

#: A document is rejected as of no language if it is `und` or fewer of its n-grams than this belong to the language.
LEAST_SCORE = 0.3
#: Target marginals (powers of the observed tokens) and the share of tokens that the mixture keeps.
TARGETS = {"source": 0.5, "lang": 0.8, "topic": 1.0}
BUDGET = 0.8
#: Raking goes on until no share of a source, language or topic is further than this from its target.
TOLERANCE = 1e-4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of a recognised language; the held-out quarter never trains."""
    model = langid.train(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    own = docs.columns
    named = docs.toDF(*[c if c == "text" else f"c_{c}" for c in own])
    kept = langid.identify(named, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(c if c == "text" else f"c_{c}").alias(c) for c in own])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that pass the base rules and the risk-controlled cutoffs, learnt from the labelled ones among them."""
    return quality.kept_rows(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return nearcopies.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep a sample whose source, language and topic shares are raked to the targets."""
    own = docs.columns
    rows = docs.select("doc_id", "source", "lang", mixing.topic(F.col("text")).alias("topic"), mixing.tokens(F.col("text")).alias("n_tokens"), F.struct(*own).alias("row"))
    kept = mixing.mix(rows, TARGETS, BUDGET, tolerance=TOLERANCE).where("selected")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in own])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=2, capacity=1024)


STAGES = [("language ID", language_id), ("quality rules", quality_rules), ("SimHash near-dedup", near_dedup), ("mixing sources", mix_sources), ("best-fit packing", pack)]

#: Trained filters, components and packing are beyond SQL; tests hold run() against a plain model of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_dir(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
