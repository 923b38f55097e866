"""Language-model scoring by prediction by partial matching over bytes, beside a smoothed unigram base.

A text is lower-cased (A-Z), its words joined by single spaces and closed by a newline, which no word holds; the same
newline stands before the text. The trie of byte contexts up to `order` bytes is learnt from all training texts:
the counts of (order + 1)-grams are summed by Spark, and those of lower orders are their sums, so that every symbol
seen after a context was seen after its suffix. Escapes are estimated as in method D, with another constant e:
with t occurrences of d distinct symbols, a symbol seen n times has (n - e) / t and the escape e d / t. Symbols of a
context that was escaped are excluded in the shorter one. As the trie is closed under suffixes, what is excluded is a
property of the context alone, so code lengths are table look-ups.

No process holds the trie, and no entry is left out. The code length of a byte depends on its (order + 1)-gram alone,
and what it needs from the trie of orders 2 on are entries whose contexts end in the same two bytes. So the trie is
built in parts by these two bytes (orders 0 and 1, 65 792 entries at most, are a table that each worker reads), and
each part gives the code lengths of the distinct grams of the scored texts. Texts are scored in chunks of about `CHUNK`
bytes, which meet the code lengths of their distinct grams in a join.

Base: words are counted over all training texts. Workers read the counts of at most `heavy` most frequent words; the
documents' other words meet their counts in a join, after each document has summed its own.

Cases: a null or empty text has one token, the end; without any training text the base and the model are uniform (all
probabilities 1 of an empty vocabulary, and 1/256 a byte); rows that share a doc_id are scored each; an empty table
gives no row; other columns are ignored, but for those to keep, of which any that this operator makes gives way.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import read_columns, release, saved, small_batches, written

END = b"\n"
#: What an escape takes from each distinct symbol's count. Of 0.1 to 0.9, the best for an eighth of sf0.01's training
#: documents (crc32 of "e" and the id mod 8 is 0) under the others' trie; documents held out from training took no part.
ESCAPE = 0.3
EMPTY = np.uint64((1 << 64) - 1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 20
#: Bytes of text that are scored together, about.
CHUNK = 32 << 20
MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def normal(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(the code of order + 1 bytes that ends at each byte of each text, where each text starts)."""
    pad = END * order
    flat = np.frombuffer(pad + pad.join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.r_[0, np.cumsum(sizes + order)[:-1]]
    code = np.zeros(len(flat) - order, dtype=np.uint64)
    for i in range(order + 1):
        code = (code << np.uint64(8)) | flat[i : i + len(code)]
    keep = np.ones(len(code), dtype=bool)
    for i in range(order):
        keep[(starts[1:] - 1 - i)] = False
    return code[keep], np.r_[0, np.cumsum(sizes)[:-1]]


def prepared(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def runs(texts: list[bytes], order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, codes of texts first to end, where each starts), of about BLOCK bytes; long texts come in parts."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
            size += len(texts[j])
            j += 1
        if size <= 4 * BLOCK:
            yield i, j, *codes(texts[i:j], order)
        else:  # one very long text
            long = END * order + texts[i]
            for b in range(order, len(long), BLOCK):
                flat = long[b - order : b + BLOCK]
                c = np.zeros(len(flat) - order, dtype=np.uint64)
                for at in range(order + 1):
                    c = (c << np.uint64(8)) | np.frombuffer(flat, dtype=np.uint8)[at : at + len(c)]
                yield i, j, c, np.zeros(1, dtype=np.int64)
        i = j


def distinct(grams: np.ndarray) -> np.ndarray:
    """Sorted, each once. (np.unique would hash them, which takes ten times as long as to sort them.)"""
    held = np.sort(grams)
    return held[np.r_[True, held[1:] != held[:-1]]] if len(held) else held


class Table:
    """Positions of 64-bit keys, which are kept sorted by a hash that loses nothing; an index of its top bits leads in."""

    def __init__(self, hashed: np.ndarray):
        self.hashed = hashed
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(hashed))))))
        edges = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.searchsorted(hashed, edges).astype(np.int32)

    @staticmethod
    def hash(keys: np.ndarray) -> np.ndarray:
        return keys * SPREAD

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions of keys, -1 where absent."""
        want = self.hash(keys)
        at = self.first[(want >> np.uint64(64 - self.bits)).astype(np.int64)]
        out = np.full(len(keys), -1, dtype=np.int32)
        left = np.arange(len(keys))
        while len(left):
            inside = at < len(self.hashed)
            left, at = left[inside], at[inside]
            seen, own = self.hashed[at], want[left]
            hit = seen == own
            out[left[hit]] = at[hit]
            on = seen < own
            left, at = left[on], at[on] + 1
        return out

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Positions of keys which are all there."""
        want = self.hash(keys)
        at = self.first[(want >> np.uint64(64 - self.bits)).view(np.int64)]
        left = np.flatnonzero(self.hashed[at] != want)
        while len(left):
            at[left] += 1
            left = left[self.hashed[at[left]] != want[left]]
        return at


def tagged(grams: np.ndarray, order: int) -> np.ndarray:
    """Keys of grams' last order + 1 bytes, with the order in the top byte."""
    return (grams & np.uint64((1 << 8 * (order + 1)) - 1)) | np.uint64(order << 56)


@dataclass
class Trie:
    """What scoring looks up. A context's values say how its symbols are excluded from the next shorter one."""

    order: int
    entry: Table
    context: Table
    direct: np.ndarray
    log_n: np.ndarray
    escape: np.ndarray
    rest: np.ndarray
    rest_escape: np.ndarray
    last: float

    @classmethod
    def build(cls, order: int, keys: np.ndarray, counts: np.ndarray) -> Trie:
        """From entries (order and gram, tagged; sorted) and their counts."""
        n = counts.astype(np.float64)
        orders = keys >> np.uint64(56)
        contexts = ((keys & np.uint64((1 << 56) - 1)) >> np.uint64(8)) | (orders << np.uint64(56))
        contexts, first = np.unique(contexts, return_index=True)
        ends = np.r_[first[1:], len(keys)].astype(np.int64)
        total = np.add.reduceat(n, first) if len(keys) else np.empty(0)
        kinds = (ends - first).astype(np.float64)
        of = np.repeat(np.arange(len(first), dtype=np.int32), ends - first)
        by, by_context = np.argsort(Table.hash(keys)), np.argsort(Table.hash(contexts))
        entry, context = Table(Table.hash(keys)[by]), Table(Table.hash(contexts)[by_context])
        # what remains of the next shorter context without this one's symbols
        shorter = np.maximum(orders, np.uint64(1)) - np.uint64(1)
        lower = entry.find((keys & ((np.uint64(1) << (np.uint64(8) * (shorter + np.uint64(1)))) - np.uint64(1))) | (shorter << np.uint64(56)))
        lower[orders == 0] = -1
        taken = np.bincount(of, weights=np.where(lower >= 0, n[by][lower], 0), minlength=len(first))
        depth = contexts >> np.uint64(56)
        shorter = np.maximum(depth, np.uint64(1)) - np.uint64(1)
        parent = context.find((contexts & ((np.uint64(1) << (np.uint64(8) * shorter)) - np.uint64(1))) | (shorter << np.uint64(56)))
        rest = np.where(depth > 0, total[by_context][parent] - taken, 0)
        rest_kinds = np.where(depth > 0, kinds[by_context][parent] - kinds, 0)
        with np.errstate(divide="ignore"):
            log_n = np.log10(n - ESCAPE)
            direct = log_n - np.log10(total[of])
            escape = np.log10(kinds * ESCAPE) - np.log10(total)
            rest_escape = np.where(rest_kinds > 0, np.log10(np.maximum(rest_kinds, 1) * ESCAPE) - np.log10(np.maximum(rest, 1)), 0)
            rest = np.log10(rest)
        single = lambda x, order_: x[order_].astype(np.float32)
        last = -np.log10(max(1, 256 - int(kinds[depth == 0].sum())))
        return cls(order, entry, context, single(direct, by), single(log_n, by), single(escape, by_context), single(rest, by_context), single(rest_escape, by_context), float(last))

    def log10s(self, grams: np.ndarray) -> np.ndarray:
        """log10 of each byte's probability after its context."""
        out = np.zeros(len(grams))
        todo, excluded = np.arange(len(grams)), np.full(len(grams), -1, dtype=np.int32)
        for k in range(self.order, -1, -1):
            own = grams[todo]
            at = self.entry.find(tagged(own, k))
            hit, after = at >= 0, excluded >= 0
            plain, inside = hit & ~after, hit & after
            out[todo[plain]] += self.direct[at[plain]]
            out[todo[inside]] += self.log_n[at[inside]] - self.rest[excluded[inside]]
            todo, own, excluded, after = todo[~hit], own[~hit], excluded[~hit], after[~hit]
            if not len(todo):
                return out
            here = self.context.find((own >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1) | np.uint64(k << 56))
            fresh = ~after & (here >= 0)
            out[todo[fresh]] += self.escape[here[fresh]]
            out[todo[after]] += self.rest_escape[excluded[after]]
            excluded = here
        out[todo] += self.last
        return out


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """gram (order + 1 bytes as a long), n over all whole texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def summed(parts):
            values, many = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            sort = np.argsort(values)
            values, many = values[sort], many[sort]
            first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
            return values[first], np.add.reduceat(many, first)

        def counted(ready):
            values, many = np.unique(codes(ready, order)[0], return_counts=True)
            return values, many.astype(np.int64)

        def out(parts):
            values, many = summed(parts)
            for i in range(0, len(values), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(values[i : i + (1 << 16)].view(np.int64)), pa.array(many[i : i + (1 << 16)])], ["gram", "n"])

        parts, ready, size, held = [], [], 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                ready.append(prepared(normal(text)))
                size += len(ready[-1])
                if size >= 2 * BLOCK:
                    parts.append(counted(ready))
                    held += len(parts[-1][0])
                    ready, size = [], 0
                    if held > BLOCK:
                        parts = [summed(parts)]
                        held = len(parts[0][0])
                    if held > 2 * BLOCK:
                        yield from out(parts)
                        parts, held = [], 0
        if ready:
            parts.append(counted(ready))
        if parts:
            yield from out(parts)
        del parts, ready
        release()

    return texts.select("text").transform(small_batches).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> int:
    """The least n such that at most `most` rows have n or more, from a histogram of n in steps of an eighth of log2."""
    step = F.floor(F.log2("n") * 8)
    held, least = 0, 1
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high")).collect(), key=lambda r: -r.s):
        held += r.m
        if held > most:
            return r.high + 1
        least = r.low
    return least


def asked(rows: DataFrame, order: int) -> DataFrame:
    """chunk, gram: the distinct grams of the texts (column _text) of each chunk."""

    import pyarrow as pa

    def run(key, batches):  # one batch of texts at a time
        parts, held = [], 0
        for batch in batches:
            for _, _, code, _ in runs([prepared(normal(t)) for t in batch.column("_text").to_pylist()], order):
                parts.append(distinct(code))
                held += len(parts[-1])
                if held > 2 * BLOCK:
                    parts = [distinct(np.concatenate(parts))]
                    held = len(parts[0])
        grams = distinct(np.concatenate(parts))
        del parts
        for i in range(0, len(grams), 1 << 16):
            own = grams[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), key[0].as_py(), np.int64)), pa.array(own.view(np.int64))], ["chunk", "gram"])
        del grams
        release()

    run.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return rows.select("_chunk", "_text").groupBy("_chunk").applyInArrow(run, "chunk long, gram long")


_lowest: dict[str, list[np.ndarray]] = {}


def _low(path: str) -> list[np.ndarray]:
    """The entries of orders 0 and 1, read once by this worker."""
    if path not in _lowest:
        _lowest.clear()
        _lowest[path] = read_columns(path, "k", "g", "n")
    return _lowest[path]


def lengths(grams: DataFrame, top: DataFrame, order: int) -> DataFrame:
    """gram, log10 of its last byte's probability, of every row of grams, under the whole trie of top (gram, n)."""
    cells = [F.struct(F.lit(k).cast("long").alias("k"), F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("g")) for k in range(min(order, 1) + 1)]
    low = top.select(F.explode(F.array(*cells)).alias("x"), "n").groupBy(F.col("x.k").alias("k"), F.col("x.g").alias("g")).agg(F.sum("n").alias("n"))
    lowest = written(low.repartition(1), "low")
    end = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFF))

    def run(key, seen, want):
        import pyarrow as pa

        from tokenlake.llm import ppm

        k, g, n = ppm._low(lowest)
        mine = (k == 0) | (g >> 8 == key[0].as_py() & 0xFF)
        keys, counts = [g[mine].view(np.uint64) | (k[mine].astype(np.uint64) << np.uint64(56))], [n[mine]]
        sort = np.argsort(keys[0])
        keys, counts = [keys[0][sort]], [counts[0][sort]]
        own, many = seen.column("gram").to_numpy().view(np.uint64), seen.column("n").to_numpy()
        for o in range(2, order + 1):
            values, inverse = np.unique(tagged(own, o), return_inverse=True)
            keys.append(values)
            counts.append(np.bincount(inverse, weights=many, minlength=len(values)).astype(np.int64))
        asked_for = want.column("gram").to_numpy()
        if not len(asked_for):
            return pa.table({"gram": pa.array([], pa.int64()), "log": pa.array([], pa.float64())})
        trie = Trie.build(order, np.concatenate(keys), np.concatenate(counts))
        return pa.table({"gram": pa.array(asked_for), "log": pa.array(trie.log10s(asked_for.view(np.uint64)))})

    return top.withColumn("_end", end).groupBy("_end").cogroup(grams.withColumn("_end", end).groupBy("_end")).applyInArrow(run, "gram long, log double")


def word_counts(texts: DataFrame) -> DataFrame:
    """word (bytes; null: the end), n over all whole texts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(counts):
            words = list(counts)
            for i in range(0, len(words), 1 << 15):
                part = words[i : i + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], ["word", "n"])

        counts: Counter = Counter()
        ends = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(normal(text))
                ends += 1
            if len(counts) > 400_000:
                yield from out(counts)
                counts = Counter()
        yield from out(counts)
        if ends:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([ends], pa.int64())], ["word", "n"])

    return texts.select("text").transform(small_batches).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


_commons: dict[str, dict[bytes, float]] = {}


def _common(path: str) -> dict[bytes, float]:
    """The logs of the common words, read once by this worker."""
    if path not in _commons:
        _commons.clear()
        _commons[path] = dict(zip(*read_columns(path, "word", "log"), strict=True))
    return _commons[path]


def score(docs: DataFrame, training, *, keep: list[str] | None = None, heavy: int = 200_000, order: int = 5) -> DataFrame:
    """Columns `keep` of docs with n_tokens, n_known, train_tokens, base_score and score; training: a condition on docs.

    A kept column of one of these names gives way to the one made here.
    """
    kept = [c for c in (["doc_id"] if keep is None else keep) if c not in MADE]
    keep = [f"_k{i}" for i in range(len(kept))]
    texts = docs.where(training).select("text")
    words = saved(word_counts(texts), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = (words.where(F.col("word").isNull()).agg(F.sum("n")).first()[0]) or 0
    known = words.where(F.col("word").isNotNull())
    base = 0.1 * (distinct + 1) + total
    log = lambda c: F.log10((c + F.lit(0.1)) / F.lit(float(base)))
    common = written(known.where(F.col("n") >= frequent(known, heavy)).select("word", log(F.col("n")).alias("log")).repartition(1), "common")
    rare = words.where(F.col("word").isNotNull()).select(F.col("word").alias("w"), F.col("n").alias("c"))
    rows = docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`").alias(k) for c, k in zip(kept, keep, strict=True)])
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64("_text", *keep), F.lit(size // CHUNK + 1)))
    top = saved(gram_counts(texts, order), "grams")
    wanted = saved(asked(small_batches(rows), order), "asked")
    logs = saved(lengths(wanted.select("gram").distinct(), top, order), "lengths")
    met = wanted.join(logs.hint("merge"), "gram")

    def run(key, table, found):
        import pyarrow as pa

        from tokenlake.llm import ppm

        known_logs = ppm._common(common)
        end = np.log10((ends + 0.1) / base)
        grams, values = found.column("gram").to_numpy().view(np.uint64), found.column("log").to_numpy()
        hashed = Table.hash(grams)
        sort = np.argsort(hashed)
        priced, values = Table(hashed[sort]), values[sort]
        del grams, hashed, sort
        scores, known, part, tokens, rare_words, rare_counts, ends_at = [], [], [], [], [], [], [0]
        for at in range(0, table.num_rows, 1000):  # so many texts at a time
            texts = []
            for text in table.column("_text").slice(at, 1000).to_pylist():
                own = normal(text)
                tokens.append(len(own) + 1)
                texts.append(prepared(own))
                many = Counter(own)
                hit = [(n, known_logs[w]) for w, n in many.items() if w in known_logs]
                known.append(sum(n for n, _ in hit) + (ends > 0))
                part.append(sum(n * x for n, x in hit) + end)
                rare_words += [w for w in many if w not in known_logs]
                rare_counts += [n for w, n in many.items() if w not in known_logs]
                ends_at.append(len(rare_words))
            sums = np.zeros(len(texts))
            for i, j, code, starts in runs(texts, order):
                sums[i:j] += np.add.reduceat(values[priced.places(code)], starts)
            scores.append(sums)
        del priced, values
        scores = np.concatenate(scores) if scores else np.zeros(0)
        rest = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], ["w", "n"])
        rest = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), rest)
        cols = [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(part, pa.float64()), pa.array(scores), rest]
        own = [table.column(c) for c in keep]
        del rare_words, rare_counts
        release()
        return pa.table([*own, *cols], names=[*keep, "n_tokens", "known", "part", "score", "rest"])

    from pyspark.sql import types as T

    extra = T._parse_datatype_string("n_tokens long, known long, part double, score double, rest array<struct<w: binary, n: long>>").fields
    scored = rows.groupBy("_chunk").cogroup(met.groupBy("chunk")).applyInArrow(run, T.StructType([*rows.select(*keep).schema.fields, *extra]))
    first = saved(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    left = first.select("_row", F.explode("rest").alias("x")).select("_row", "x.w", "x.n")
    heard = left.join(rare, "w", "left")
    c = F.coalesce("c", F.lit(0))
    sums = heard.groupBy("_row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * log(c)).alias("sum"))
    out = first.drop("rest").join(sums, "_row", "left")
    return out.select(*[F.col(k).alias(c) for c, k in zip(kept, keep, strict=True)], "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("part") + F.coalesce("sum", F.lit(0.0))).alias("base_score"), "score")
