"""Language identification by bit-sliced Bloom filters of character n-grams.

A language's n-gram set holds those of its letter 3- and 4-grams that make up at least `cutoff` of its n-grams in
training, so a set has at most 2 / cutoff members however much text there is. All sets share one filter: a position
is a word with one bit per language, and the AND of a gram's k positions is the bitmask of the languages whose set
holds it (false positives included). Per document the bits are counted by language, each count is corrected by its
language's false-positive rate, and the largest corrected share decides.

Training uses at most about `docs_per_lang` documents of each language, chosen by a hash of the id (a documented
bound; every document can be chosen). Prediction reads whole texts and nothing else.

Cases: a null text, or one without a letter, is `und` with score 0; a tie goes to the first language by name; if no
labelled document exists all are `und`; rows that share a doc_id are predicted each; an empty table gives no row; input
columns named lang_pred or score give way to the predicted ones, all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import saved, small_batches

LETTERS = re.compile(r"[^\W\d_]+")
SIZES = (3, 4)
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Code points handled at once.
BLOCK = 1 << 20


def letters(text: str | None) -> str:
    """Lower-cased runs of letters, with single spaces around; empty if there is none."""
    words = LETTERS.findall(text.lower()) if text else []
    return f" {' '.join(words)} " if words else ""


def grams(text: str, starts: int | None = None) -> np.ndarray:
    """Hashes of the 3- and 4-grams of a text prepared by letters(): all, or those that start in its first `starts` characters."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    out = []
    for n in SIZES:
        if len(c) >= n:
            size = len(c) - n + 1 if starts is None else min(len(c) - n + 1, starts)
            h = np.full(size, n, dtype=np.uint64)
            for i in range(n):
                h = (h ^ c[i : size + i]) * PRIME
                h ^= h >> np.uint64(29)
            out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def positions(h: np.ndarray, k: int, bits: int) -> Iterator[np.ndarray]:
    for i in range(k):
        x = (h ^ np.uint64(0xD6E8FEB86659FD93 * (i + 1) & (1 << 64) - 1)) * PRIME
        yield (x >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class LanguageFilter:
    langs: list[str]
    words: np.ndarray  # per position one or more 64-bit words
    k: int
    bits: int
    false_positive: np.ndarray

    @classmethod
    def build(cls, sets: dict[str, np.ndarray], k: int = 4) -> LanguageFilter:
        langs = sorted(sets)
        most = max([1, *(len(s) for s in sets.values())])
        bits = max(10, int(np.ceil(np.log2(8 * most))))
        words = np.zeros((max(1, -(-len(langs) // 64)), 1 << bits), dtype=np.uint64)
        wrong = np.zeros(len(langs))
        for i, lang in enumerate(langs):
            mark = np.zeros(1 << bits, dtype=bool)
            for at in positions(sets[lang].astype(np.uint64), k, bits):
                mark[at] = True
            words[i // 64][mark] |= np.uint64(1 << (i % 64))
            wrong[i] = mark.mean() ** k
        return cls(langs, words, k, bits, wrong)

    def masks(self, h: np.ndarray, plane: int = 0) -> np.ndarray:
        """Of each hash, the bitmask of the (64 of a plane) languages that hold it."""
        got = None
        for at in positions(h, self.k, self.bits):
            got = self.words[plane][at] if got is None else got & self.words[plane][at]
        return got

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """(n-grams that each language holds, n-grams) of a prepared text, block by block."""
        hits, n = np.zeros(len(self.langs), dtype=np.int64), 0
        for start in range(0, len(text), BLOCK):
            h = grams(text[start : start + BLOCK + max(SIZES) - 1], BLOCK)
            n += len(h)
            for plane in range(len(self.words)):
                values, many = np.unique(self.masks(h, plane), return_counts=True)
                for i in range(64 * plane, min(len(self.langs), 64 * plane + 64)):
                    hits[i] += many[(values >> np.uint64(i % 64)) & np.uint64(1) == 1].sum()
        return hits, n

    def predict(self, text: str | None) -> tuple[str, float]:
        ready = letters(text)
        if not ready or not self.langs:
            return "und", 0.0
        hits, n = self.counts(ready)
        if not n:
            return "und", 0.0
        share = np.clip((hits / n - self.false_positive) / (1 - np.minimum(self.false_positive, 0.99)), 0, 1)
        best = int(share.argmax())
        return self.langs[best], float(share[best])


def train(labelled: DataFrame, *, docs_per_lang: int = 2000, cutoff: float = 2e-5) -> LanguageFilter:
    """A filter learnt from columns doc_id, text and lang of labelled rows."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageFilter.build({})
    share = F.element_at(F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, docs_per_lang / n)))]), F.col("lang"))
    u = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ready := letters(text):
                    by.setdefault(lang, []).append(grams(ready))
            for lang, hs in by.items():
                values, many = np.unique(np.concatenate(hs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values.view(np.int64)), pa.array(many)], ["lang", "gram", "n"])

    counted = rows.where(u < share).select("text", "lang").transform(small_batches).mapInArrow(count, "lang string, gram long, n long")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    summed = saved(summed, "langid")
    totals = {r.lang: r.n for r in summed.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return LanguageFilter.build({})
    least = F.element_at(F.create_map(*[x for lang, n in totals.items() for x in (F.lit(lang), F.lit(cutoff * n))]), F.col("lang"))
    held = summed.where(F.col("n") >= least).select("lang", "gram").toPandas()  # at most 2 / cutoff a language
    return LanguageFilter.build({lang: own.to_numpy() for lang, own in held.groupby("lang")["gram"]} if len(held) else {})


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """docs with lang_pred and score (columns of these names give way); all other columns stay."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql import types as T

    return small_batches(docs).mapInArrow(predict, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
