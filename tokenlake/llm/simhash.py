"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at 3 or fewer differing bits. 3 is odd, so a fingerprint is seen in three views, each without one of
its blocks of 22, 21 and 21 bits: if 1 to 3 bits differ, the view without a block that holds one of them differs in 2
at most. In each view a fingerprint emits every variant within half that radius (the view itself and its 42 or 43
single flips), so two linked fingerprints meet at a variant. The variants are shuffled, and pairs that meet are verified
on all 64 bits.

Distinct fingerprints are emitted once each, whatever the number of copies. Where more than `bucket` of them meet at a
variant, their pairs are not formed, nor is the group held: its rows are streamed, and marked. Marked fingerprints go
through the full space instead: each emits all variants within 2 bits if its parity is even and within 1 if odd (odd distances), and
all within 1 (even ones). There any two that meet under the rule are linked, so a star per variant is exact.

Cases: a null text, an empty one and one without a word have fingerprint 0, linked like any other; null doc_ids count
as larger than all others; rows that share a doc_id are handled each; an empty table gives no row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenlake.llm.common import joined, saved, small_batches

RADIUS = 3
LAST = (1 << 63) - 1
BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
BLOCK = 1 << 18
#: First bit and width of each block that a view leaves out.
BLOCKS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: str | None) -> int:
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        hashes = [digest(b" ".join(words), 42)]
    else:
        hashes = [digest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:], strict=False)]
    ones, h = np.zeros(64, dtype=np.int64), np.array(hashes, dtype="<u8")
    for at in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(BIT[2 * ones > len(h)].sum()) if len(h) else 0


def fingerprints(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with fp: the fingerprint's 64 bits as a long."""
    rows = docs.select(F.col("text").alias("_text"), *[docs[c] for c in (docs.columns if keep is None else keep)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch.column(0).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps)], [*batch.schema.names[1:], "fp"])

    return small_batches(rows).mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField("fp", T.LongType())]))


def _flips(width: int, radius: int) -> np.ndarray:
    """All masks of at most `radius` bits among `width`."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)], dtype=np.uint64)


def _emit(make):
    """A mapInArrow function: make(fps) gives (keys, positions in fps, tag) of the variants."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            whole = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(whole), 2048):
                fps = whole[at : at + 2048]
                for keys, own, tag in make(fps):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(own.view(np.int64)), pa.array(np.full(len(keys), tag, np.int8))], ["variant", "fp", "tag"])

    return run


def _views(fps: np.ndarray):
    """Variants in the three views: the bits of the view, the block's number in the 2 bits from 2^48 on."""
    for block, (first, size) in enumerate(BLOCKS):
        flips = _flips(64 - size, 1)
        low = fps & np.uint64((1 << first) - 1)
        high = (fps >> np.uint64(first + size)) << np.uint64(first) if first + size < 64 else np.zeros_like(fps)
        keys = ((low | high)[:, None] ^ flips[None, :]) | np.uint64(block << 48)
        yield keys.ravel(), np.repeat(fps, len(flips)), 0


def _balls(fps: np.ndarray):
    """Variants in the full space; tag 1: odd distances, a key's even and odd side; tag 0: even distances."""
    one, two = _flips(64, 1), _flips(64, 2)
    odd = (np.bitwise_count(fps) & 1).astype(bool)
    for part, flips, tag in ((fps, one, 0), (fps[~odd], two, 1), (fps[odd], one, 2)):
        if len(part):
            yield (part[:, None] ^ flips[None, :]).ravel(), np.repeat(part, len(flips)), tag


def _linked(bucket: int):
    """A mapInArrow function over rows sorted by variant and fp: verified links, and (fp, null) for crowded variants."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(a, b=None):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b) if b is not None else pa.nulls(len(a), pa.int64())], ["a", "b"])

        def out(keys, fps):
            """Marks and links of full runs of equal keys; links by the distance between places in the run."""
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            crowded = np.repeat(sizes > bucket, sizes)
            yield from rows(fps[crowded])
            keys, fps = keys[~crowded], fps[~crowded]
            for step in range(1, bucket):
                same = np.flatnonzero(keys[step:] == keys[:-step]) if len(keys) > step else ()
                if not len(same):
                    break
                a, b = fps[same], fps[same + step]
                near = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= RADIUS
                yield from rows(a[near], b[near])

        keys, fps, streamed = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            new, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if streamed is not None:  # the rest of a crowded run
                n = int(np.searchsorted(new, streamed, side="right"))
                yield from rows(own[:n])
                new, own = new[n:], own[n:]
                streamed = None if len(new) else streamed
            keys, fps = np.r_[keys, new], np.r_[fps, own]
            if len(keys) and keys[0] != keys[-1]:
                cut = int(np.searchsorted(keys, keys[-1]))
                yield from out(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
            if len(keys) > bucket:
                yield from rows(fps)
                keys, fps, streamed = keys[:0], fps[:0], int(keys[0])
        if len(keys):
            yield from out(keys, fps)

    return run


def links(distinct: DataFrame, bucket: int = 48) -> DataFrame:
    """Links a < b between distinct fingerprints (column fp) that connect exactly those at RADIUS or fewer bits."""
    emitted = distinct.select("fp").mapInArrow(_emit(_views), "variant long, fp long, tag byte").select("variant", "fp")
    met = emitted.repartition("variant").sortWithinPartitions("variant", "fp").mapInArrow(_linked(bucket), "a long, b long")
    met = saved(met, "links")
    crowded = met.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    rest = crowded.mapInArrow(_emit(_balls), "variant long, fp long, tag byte")
    same = F.when(F.col("tag") == 0, 0).otherwise(1)
    stars = rest.groupBy("variant", same.alias("side")).agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.min(F.when(F.col("tag") == 1, F.col("fp"))).alias("even"), F.min(F.when(F.col("tag") == 2, F.col("fp"))).alias("odd"))
    even = stars.where((F.col("side") == 0) & (F.col("low") < F.col("high"))).select("variant", F.lit(0).alias("side"), F.col("low").alias("hub"))
    odd = stars.where((F.col("side") == 1) & F.col("even").isNotNull() & F.col("odd").isNotNull()).select("variant", F.lit(1).alias("side"), F.col("odd").alias("hub"))
    sides = rest.select("variant", "fp", same.alias("side"))
    # variants are made by a function, whose output Spark takes to be as small as its input: no broadcast here
    star = sides.join(even.unionByName(odd).hint("merge"), ["variant", "side"]).where(F.col("hub") != F.col("fp")).select(F.col("fp").alias("a"), F.col("hub").alias("b"))
    both = met.where(F.col("b").isNotNull()).unionByName(star)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of every node of edges a, b, by large-star and small-star rounds.

    A hub's edges are not dealt by the hub: its least neighbour is broadcast to them (see joined()).
    """
    edges = saved(edges.where("a <> b").select("a", "b").distinct(), "edges")
    before, total = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "low")
        large = joined(both, low, ["a"], "n", 2 * total, "inner").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").distinct().select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        down = saved(down, "down")
        least = saved(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
        small = joined(down, least, ["a"], "n", total, "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = saved(small.where("a <> b").distinct(), "stars")
        total, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (total, mark) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = (total, mark)


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id (null: LAST), text_hash, fp, root (the component's smallest fingerprint), component_id of every row of docs."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = saved(fingerprints(ids, ["doc_id", "text_hash"]), "fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct))
    member = saved(distinct.join(found.hint("merge"), distinct["fp"] == found["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "member")
    lowest = saved(member.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m")), "lowest")
    whole = saved(joined(member, lowest, ["root"], "m", distinct.count()).select("fp", "n", "root", "component_id"), "whole")
    return joined(rows, whole, ["fp"], "n", rows.count())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) of every row of docs."""
    null = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return grouped(docs).select(null("doc_id"), "fp", null("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, one row of each group: that with the smallest doc_id (of equal ones, the smallest hash of the text). All columns stay."""
    heads = grouped(docs).groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))
    return only(docs, heads.select("head.doc_id", "head.text_hash"))


def only(docs: DataFrame, heads: DataFrame) -> DataFrame:
    """The rows of docs that heads name by doc_id (null: LAST) and text_hash, one for each.

    The join shuffles at every size, so that it behaves alike on small and large tables.
    """
    from pyspark.sql import Window

    heads = saved(heads.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text")), "heads")
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = dict(zip(docs.columns, named.columns, strict=True))
    rows = named.withColumn("_id", F.coalesce(F.col(own["doc_id"]).cast("long"), F.lit(LAST))).withColumn("_text", F.xxhash64(own["text"]))
    kept = rows.join(heads.hint("merge"), ["_id", "_text"])
    n = F.row_number().over(Window.partitionBy("_id", "_text").orderBy(F.xxhash64(*own.values())))  # equal rows of one id
    return kept.withColumn("_n", n).where("_n = 1").select(*[F.col(c).alias(k) for k, c in own.items()])
