"""Training preparation: reject, phonemize, tokenize, assemble, collate, split."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlake.functions.arrays import FRAME_RATE, IGNORED, VOCABULARY, assemble, padded_to
from tokenlake.functions.text import ARABIC_LETTER, mapped_text, reject_reason

#: Ids of the stub tokenizer's special pieces: below them are words, from SPEECH_BASE on the codes.
PREFIX, TEXT_START, TEXT_END, INFIX, SPEECH_START, SPEECH_END = [1, 2, 3], 4, 5, [6, 7], 8, 9
SPEECH_BASE = 100_000
OVERHEAD = len(PREFIX) + len(INFIX) + 4

#: Phonemizers by language: a function from a Column of text to a Column of phones.
PHONEMIZERS: dict[str, Callable[[Column], Column]] = {}


def register_phonemizer(language: str, make: Callable[[], Callable[[str], str]]) -> None:
    """make() runs once per worker and gives the function of one text (a model need not be picklable)."""

    @F.pandas_udf(T.StringType())
    def run(batches: pd.Series) -> pd.Series:
        one = make()
        return batches.map(lambda t: " ".join(one(t).split()), na_action="ignore")

    PHONEMIZERS[language] = lambda text: run(text)


def stub_phones(text: Column) -> Column:
    """Not a phonemizer: the words themselves, lower-cased."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def stub_ids(phones: Column) -> Column:
    """Not a tokenizer: an id below 65 546 per word, from md5."""
    words = F.filter(F.split(phones, " "), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") + 10)


def head(phone_ids: Column) -> Column:
    ids = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.concat(ids(PREFIX), ids([TEXT_START]), phone_ids, ids([TEXT_END]), ids(INFIX))


def prepare(clips: DataFrame, most: int = 896, least: int = 50, *, letters: str = ARABIC_LETTER, phones: Callable[[Column], Column] = stub_phones, ids: Callable[[Column], Column] = stub_ids) -> DataFrame:
    """audio_id, input_ids, speech_start_idx, length, reject ("" = kept): cheap rejects first, then the rest.

    Rejected rows never reach the phonemizer: its input is null for them.
    """
    mapped = clips.select("audio_id", "text", "tokens", mapped_text("text").alias("mapped"))
    early = mapped.withColumn("early", reject_reason(F.col("text"), F.col("mapped"), F.size("tokens"), most - OVERHEAD, least, letters=letters))
    spoken = early.withColumn("phones", phones(F.when(F.col("early").isNull(), F.col("text"))))
    made = spoken.withColumn("_phone_ids", ids(F.col("phones")))
    whole = assemble(head(F.col("_phone_ids")), F.col("tokens"), SPEECH_BASE, SPEECH_START, SPEECH_END)
    start = F.size("_phone_ids") + len(PREFIX) + len(INFIX) + 2
    size = start + F.size("tokens") + 2
    reject = F.coalesce(F.col("early"), F.when(F.coalesce(F.col("phones"), F.lit("")) == "", "empty_phonemes"), F.when(size > most, "too_long_with_phonemes"), F.lit(""))
    kept = F.col("reject") == ""
    return made.withColumn("reject", reject).select("audio_id", F.when(kept, whole).otherwise(F.array().cast("array<int>")).alias("input_ids"), F.when(kept, start).otherwise(-1).alias("speech_start_idx"), F.when(kept, size).otherwise(0).alias("length"), "reject")


def kept(prepared: DataFrame) -> DataFrame:
    return prepared.where("reject = ''").drop("reject")


def reject_histogram(prepared: DataFrame) -> DataFrame:
    return prepared.where("reject <> ''").groupBy("reject").agg(F.count("*").alias("n"))


def padding_stats(kept_rows: DataFrame, most: int = 896) -> DataFrame:
    speech = F.sum(F.col("length") - F.col("speech_start_idx") - 2)
    return kept_rows.agg(F.count("*").alias("n"), speech.alias("speech_tokens"), (speech / FRAME_RATE / 3600).alias("hours"), (1 - F.sum("length") / (F.count("*") * most)).alias("padding_waste"))


def collate(batches: DataFrame, pad: int = 0, multiple: int = 8, batch: str = "batch") -> DataFrame:
    """Rows of a batch padded to its longest (rounded up): input_ids, labels (prompt and pad ignored), attention_mask."""
    longest = F.max("length").over(Window.partitionBy(batch))
    rows = batches.withColumn("padded", (F.ceil(longest / multiple) * multiple).cast("int"))
    labels = F.concat(F.array_repeat(F.lit(IGNORED), F.col("speech_start_idx")), F.expr("slice(input_ids, speech_start_idx + 1, greatest(length - speech_start_idx, 0))"))
    return rows.select(*[c for c in batches.columns if c != "input_ids"], "padded", padded_to(F.col("input_ids"), F.col("padded"), pad).alias("input_ids"), padded_to(labels, F.col("padded"), IGNORED).alias("labels"), padded_to(F.array_repeat(F.lit(1), F.col("length")), F.col("padded"), 0).alias("attention_mask"))


def of_categories(items: DataFrame, wanted: str | None = None, column: str = "category") -> DataFrame:
    """The items of the categories named between commas; all of them if none is named."""
    names = [n.strip() for n in (wanted or "").split(",") if n.strip()]
    return items.where(F.col(column).isin(names)) if names else items


def contiguous(ids: DataFrame, base: int = SPEECH_BASE, vocabulary: int = VOCABULARY) -> DataFrame:
    """Whether columns code, id are code + base for every code of the vocabulary: n, ok."""
    return ids.agg(F.count("*").alias("n"), ((F.count_distinct("code") == vocabulary) & F.every(F.col("id") == F.col("code") + base) & (F.min("code") == 0) & (F.max("code") == vocabulary - 1)).alias("ok"))
