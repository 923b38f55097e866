"""Quality rules whose cutoffs are chosen under a proven limit on false rejections.

Each rule has a value per document (larger is worse) and a fixed grid of cutoffs. In each stratum, the share of labelled
good documents that pass the base rules which a set of cutoffs would reject gets an exact (Clopper-Pearson) upper
confidence bound, which must be at most the allowed risk for all chosen rules together. The order of what is tried comes
from the labelled bad documents alone, never from the good ones that the bounds are of: rules go by the most bad
documents that any of their cutoffs rejects, and of a rule only cutoffs that reject more bad ones than the milder do.
A rule's cutoffs, with those chosen before, are tested in fixed sequence from the mildest until one fails, so that all of
them share one level. The first rule has half of a stratum's level; a later one has an equal part of the other half, over
the number of choices that the rules before it may have left. A rule whose cutoff rejects no more of the bad than of the
good is not taken, nor one without which the others reject the same bad ones. The strata share delta; those with too few good labels for the first test of all are not tested, and
take no part in it.

So, with confidence 1 - delta, at most `risk` of good documents are rejected in every stratum at once. Where labels
are too few for that promise, rules are silent there.

Cases: a null text has no word; labels of documents that are absent, null labels and repeated labels of one document
(the worst counts) are handled; a null stratum is a stratum; an empty table gives no row; input columns that are named
like counts, base_failed or kept give way to those made here, all others stay.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlake.llm.common import saved, small_batches

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rule: its value (SQL over the base counts) and its grid of cutoffs.
RULES = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3]),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.01, 0.02, 0.04, 0.06, 0.08, 0.1, 0.13, 0.16]),
    "long_words": ("word_chars / greatest(n_words, 1)", [7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 14.0, 16.0]),
}


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (those with a word) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    covered = 0
    if len(words) > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            many, end = Counter(windows), 0
            for i, w in enumerate(windows):
                if many[w] > 1:
                    covered += i + 5 - max(i, end)
                    end = i + 5
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), covered, len(lines)


def measured(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with the counts of measure() and base_failed; columns of these names give way."""
    names = [*BASE, "n_lines"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*names, "base_failed")]
    rows = docs.select(F.col("text").alias("_text"), *[docs[c] for c in keep])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [measure(t) for t in batch.column(0).to_pylist()]
            cols = [pa.array([g[i] for g in got], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], [*batch.schema.names[1:], *names])

    out = small_batches(rows).mapInArrow(run, T.StructType([*rows.schema.fields[1:], *[T.StructField(n, T.LongType()) for n in names]]))
    return out.withColumn("base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def upper_bound(k: int, n: int, level: float) -> float:
    """The exact upper confidence bound of a proportion of which k in n were seen: P(X <= k) = level there."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        a, b = math.log(p), math.log1p(-p) if p < 1 else -math.inf
        if sum(math.exp(c + i * a + (n - i) * b) for i, c in enumerate(logs)) > level:
            low = p
        else:
            high = p
    return high


def at_risk(n: int, level: float, risk: float) -> int:
    """The most rejections in n whose bound is at most risk, -1 if none: the largest k with P(X <= k) <= level at that risk."""
    if risk >= 1:
        return n
    step, bound = math.log(risk) - math.log1p(-risk), math.log(level)
    term = whole = n * math.log1p(-risk)  # of no rejection
    k = -1
    while whole <= bound and k < n:
        k += 1
        if k < n:
            term += math.log((n - k) / (k + 1)) + step
            whole += math.log1p(math.exp(min(term - whole, 700.0))) if term < whole else term - whole + math.log1p(math.exp(whole - term))
        else:
            return n
    return k


def needed(level: float, risk: float) -> int:
    """The fewest good documents of which none is lost whose bound at this level is at most risk."""
    return math.ceil(math.log(level) / math.log1p(-risk))


def shares(sizes: Counter, risk: float, delta: float) -> tuple[int, int | None]:
    """(strata that share delta, the fewest good documents of any of them), from numbers of strata by good documents."""
    parts, least = 0, None
    for n in sorted(sizes, reverse=True):
        if n < needed(delta / (parts + sizes[n]) / 2, risk):
            break
        parts, least = parts + sizes[n], n
    return parts, least


def chosen(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, risk: float, delta: float) -> dict[str, float]:
    """Rule to cutoff of one stratum; levels: for each rule (row) and cell the cutoffs that the value is above."""
    rules, n, n_bad = list(RULES), int(good.sum()), int(bad.sum())
    caught = lambda r, i: int(bad[levels[r] > i].sum())
    order = sorted(range(len(rules)), key=lambda r: (-caught(r, 0), r))
    rejected, out, states = np.zeros(len(good), dtype=bool), {}, 1
    for place, r in enumerate(order):
        steps, most = [], 0
        for i in reversed(range(len(RULES[rules[r]][1]))):  # the mildest first
            if caught(r, i) > most:
                steps.append(i)
                most = caught(r, i)
        allowed = at_risk(n, delta / 2 if place == 0 else delta / 2 / (len(order) - 1) / states, risk) if n else -1
        best = None
        for i in steps:
            if good[rejected | (levels[r] > i)].sum() > allowed:
                break
            if caught(r, i) * n > int(good[levels[r] > i].sum()) * n_bad:
                best = i
        if best is not None:
            rejected |= levels[r] > best
            out[rules[r]] = RULES[rules[r]][1][best]
        states *= len(steps) + 1
    over = {k: levels[rules.index(k)] > RULES[k][1].index(c) for k, c in out.items()}
    for k in sorted(over, key=lambda k: (-int(good[over[k]].sum()), k)):  # fewer rules never lose more
        if not bad[over[k] & ~np.any([x for o, x in over.items() if o != k], axis=0)].sum():
            del over[k]
    return {k: out[k] for k in over}


def thresholds(counts: DataFrame, labels: DataFrame, stratum: str = "lang", *, risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum, cuts (map of rule to cutoff; a rule that is silent is absent), from all labelled rows.

    counts has doc_id, the stratum column and the columns of measured(); labels has doc_id and quality (1 is good).
    """
    worst = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("good"))
    own = counts.where(~F.col("base_failed")).select("doc_id", F.col(stratum).alias("stratum"), *BASE, "n_lines").join(worst, "doc_id")
    above = [F.expr(f"size(filter(array({', '.join(f'{c}D' for c in cuts)}), c -> double({value}) > c))").alias(rule) for rule, (value, cuts) in RULES.items()]
    hist = own.select("stratum", "good", *above).groupBy("stratum", *RULES)
    hist = hist.agg(F.count_if(F.col("good") == 1).alias("n_good"), F.count_if(F.col("good") == 0).alias("n_bad"))
    hist = saved(hist, "quality")
    sizes = hist.groupBy("stratum").agg(F.sum("n_good").alias("n")).groupBy("n").agg(F.count("*").alias("strata")).where(F.col("n") >= needed(delta / 2, risk)).collect()
    parts, least = shares(Counter({r.n: r.strata for r in sizes}), risk, delta)

    def choose(key, table):
        import pyarrow as pa

        levels = np.array([table.column(r).to_numpy() for r in RULES])
        good, bad = table.column("n_good").to_numpy(), table.column("n_bad").to_numpy()
        cuts = chosen(levels, good, bad, risk, delta / parts) if parts and good.sum() >= least else {}
        first = pa.concat_tables([table.slice(0, 1).select(["stratum"])] * len(cuts)) if cuts else table.slice(0, 0).select(["stratum"])
        return first.append_column("rule", pa.array(list(cuts), pa.string())).append_column("cut", pa.array(list(cuts.values()), pa.float64()))

    schema = T.StructType([T.StructField("stratum", counts.schema[stratum].dataType), *T._parse_datatype_string("rule string, cut double").fields])
    taken = hist.groupBy("stratum").applyInArrow(choose, schema)
    return taken.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("cuts"))  # at most a row per rule


def judged(counts: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """counts with kept (a column of that name gives way): false if the base rules fail, or a rule's value is above its stratum's cutoff."""
    cuts = cuts.select(F.col("stratum").alias("_stratum"), F.col("cuts").alias("_cuts"))
    rows = counts.join(cuts, counts[stratum].eqNullSafe(cuts["_stratum"]), "left")
    bad = [F.coalesce(F.expr(f"double({value})") > F.try_element_at("_cuts", F.lit(rule)), F.lit(False)) for rule, (value, _) in RULES.items()]
    over = bad[0]
    for b in bad[1:]:
        over = over | b
    return rows.withColumn("kept", ~F.col("base_failed") & ~over).drop("_stratum", "_cuts")


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judged() keeps, all columns, with cutoffs learnt from their labelled ones.

    Texts are measured once, and only counts are written. The verdict depends on text and language alone, so it returns
    to the rows by a hash of both: hashes that many rows have are broadcast (see joined() for the bound), the rows of
    the others are joined by a shuffle at every size.
    """
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    key = F.xxhash64("text", "lang", F.col("text").isNull(), F.col("lang").isNull()).alias("key")
    counts = saved(measured(docs.select("text", "lang", "doc_id", key), ["doc_id", "lang", "key"]), "measured")
    said = judged(counts, thresholds(counts, labels)).groupBy("key").agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    said = saved(said, "verdicts")
    hot = F.col("n") > (said.agg(F.sum("n")).first()[0] or 0) // 512
    few = said.where(hot)
    rows = docs.select(key, *[F.col(c).alias(n) for c, n in names.items()])
    rest = rows.join(F.broadcast(few.select("key")), "key", "left_anti").join(saved(said.where(~hot & ~F.col("kept")).select("key"), "rejected").hint("merge"), "key", "left_anti")
    kept = rest.unionByName(rows.join(F.broadcast(few.where("kept").select("key")), "key", "left_semi"))
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
