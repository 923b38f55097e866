"""Near copies by Jaccard similarity, found by meet-in-the-middle ball hashing of wide SimHash fingerprints.

Two texts link if the sets of their shingles (five words; fewer words: the whole sequence) have a similarity of 0.8 or
more. 64 bits don't tell that: at 0.8 about 15 % of all bits differ, too many for a ball in one space. So a fingerprint
has 384 bits, read in 13 views of 28 bits, and in each view a text emits the view and its 28 single flips. Two texts
meet at a variant if any view differs in 2 bits at most. That finds a pair with probability 0.92 at a similarity of
0.8, 0.98 at 0.85 and more than 0.99 from 0.9 on; all that meet are then decided by their shingles, so nothing is linked
wrongly. More views find more, more bits make chance meetings rarer (28 suit some hundred thousand texts, 34 some ten
million; `views` times `bits` must not exceed 384).

Texts with equal shingle sets are one node whatever their number. Each variant's nodes are streamed in order and
screened against the first of them on all 384 bits (4 standard deviations more than 0.8 makes differ); a node's pairs
with the eight of those that differ in the fewest bits are decided by their texts, and join components. What is left are
pairs of different components that met: in a large group they are many, nearly all below 0.8, and too close for the
bits to tell. No row is made of them. Where one passes the screen in its variant's task, only its nodes are named, and
those go through an exact index: a node's shingles are ordered from the rarest among the named nodes on, and two sets
that are similar enough share one so early in both that enough of each follows it (the prefixes of AllPairs and PPJoin).
Pairs that meet at such a shingle and pass the screen are decided by their texts in rounds: a node with eight of
them, then with 64 more, and so on, until no pair of different components is left. So no link between texts that meet is
lost, and a group of thousands of near copies is not compared by its texts pair by pair. Inside a task the bits of a
variant's or shingle's nodes of different components are still compared pair by pair.

Components of at most a million links are joined in one task (an exact way like the other, that takes one job for
some dozens of them), more by star rounds.

Cases: null and empty texts and those without a word have the empty set, one node; null doc_ids count as larger than all
others; rows that share a doc_id are handled each; an empty table gives no row; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenlake.llm.common import joined, saved, small_batches
from tokenlake.llm.simhash import BLOCK, LAST, components, only

WORDS = 6
W = [f"w{i}" for i in range(WORDS)]
#: A node's pairs with so many first nodes of variants are decided before the exact index; the index finds the others.
LEADS = 8
#: Sizes are whole numbers; what a product of one and the similarity may be off by.
TINY = 1e-6
#: Fixed values of the 64-bit mixer splitmix64.
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the text's distinct shingles, ascending."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    n = max(len(words) - width + 1, 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)), np.uint64, n))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The 384 bits as 6 words: a bit is 1 if it is set in over half of the shingles' mixed hashes."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        z = hashes[at : at + BLOCK, None] + GOLDEN * np.arange(1, WORDS + 1, dtype=np.uint64)
        z = (z ^ (z >> np.uint64(30))) * MIX1
        z = (z ^ (z >> np.uint64(27))) * MIX2
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.astype("<u8").view(np.uint8).reshape(len(z), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def prints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id (null: LAST), text_hash, node (a hash of the shingle set), its size and the sketch's words of every row."""
    rows = docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64("text").alias("text_hash"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets = [shingles(t, width) for t in batch.column(0).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            words = np.array([sketch(s) for s in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(nodes), sizes, *[pa.array(words[:, i]) for i in range(WORDS)]], ["doc_id", "text_hash", "node", "size", *W])

    return small_batches(rows).mapInArrow(run, "doc_id long, text_hash long, node long, size long, " + ", ".join(f"{w} long" for w in W))


def _variants(views: int, bits: int):
    """A mapInArrow function from node and sketch to (variant, node): in each view the node and its single flips."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        powers = 1 << np.arange(bits, dtype=np.int64)
        flips = np.r_[0, powers]
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            words = np.stack([batch.column(1 + i).to_numpy() for i in range(WORDS)], axis=1).astype("<i8")
            for at in range(0, len(nodes), 256):
                part = np.unpackbits(words[at : at + 256].view(np.uint8), axis=1, bitorder="little")[:, : views * bits]
                keys = part.reshape(-1, views, bits).astype(np.int64) @ powers
                keys = (keys[:, :, None] ^ flips) | (np.arange(views, dtype=np.int64) << bits)[None, :, None]
                own = np.repeat(nodes[at : at + 256], views * len(flips))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(own)], ["variant", "node"])

    return run


def _followers(batches: Iterator) -> Iterator:
    """Of rows sorted by variant and node: all but the first of a variant, with that first one. Holds one batch."""
    import pyarrow as pa

    key = lead = None
    for batch in batches:
        keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        first = np.r_[key is None or keys[0] != key, keys[1:] != keys[:-1]]
        at = np.maximum.accumulate(np.where(first, np.arange(len(keys)), -1))
        leads = np.where(at >= 0, nodes[at], 0 if lead is None else lead)
        key, lead = keys[-1], leads[-1]
        if not first.all():
            yield pa.RecordBatch.from_arrays([pa.array(x[~first]) for x in (keys, nodes, leads)], ["variant", "node", "lead"])


def _crossing(most: int, bucket: int = 64, similarity: float = 0.8):
    """A mapInArrow function over rows (variant, node, root, main, sketch) sorted by variant: the pairs a < b of nodes
    of one variant and different roots whose sketches differ in at most `most` bits. Holds a variant's nodes.

    A column size, if there, leaves out pairs whose sizes are too different for that similarity; a column place after
    it those that have too few shingles from there on (place: how many of the node's shingles come before the variant).
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows(a, b):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        def out(table):
            keys, nodes, roots, mains = (table.column(i).to_numpy() for i in range(4))
            words = np.stack([table.column(4 + i).to_numpy() for i in range(WORDS)], axis=1).view(np.uint64)
            size, place = ([*(c.to_numpy() for c in table.columns[4 + WORDS :]), None, None])[:2]

            def passing(a, b):
                if size is not None:
                    x, y = size[a], size[b]
                    ok = np.minimum(x, y) >= similarity * np.maximum(x, y) - TINY
                    if place is not None:
                        same = similarity / (1 + similarity) * (x + y) - TINY
                        ok &= (x - place[a] >= same) & (y - place[b] >= same)
                    a, b = a[ok], b[ok]
                ok = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64) <= most
                return rows(nodes[a[ok]], nodes[b[ok]])

            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            few = np.flatnonzero(np.repeat(sizes <= bucket, sizes))
            for step in range(1, bucket):
                a, b = few[:-step], few[step:]
                same = keys[a] == keys[b]
                if not same.any():
                    break
                a, b = a[same], b[same]
                apart = roots[a] != roots[b]
                yield from passing(a[apart], b[apart])
            for first, n in zip(starts[sizes > bucket], sizes[sizes > bucket], strict=True):
                own = np.arange(first, first + n)
                minor = own[roots[own] != mains[own]]
                step = max(1, BLOCK // n)
                for at in range(0, len(minor), step):
                    part = minor[at : at + step]
                    a, b = np.repeat(part, n), np.tile(own, len(part))
                    apart = (roots[a] != roots[b]) & ((roots[b] == mains[b]) | (nodes[a] < nodes[b]))
                    yield from passing(a[apart], b[apart])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 1 << 16:
                continue
            table = pa.Table.from_batches(held)
            keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from out(table.slice(0, cut))
                held, n = table.slice(cut).to_batches(), len(keys) - cut
            else:  # one variant has all of these
                held, n = table.to_batches(), 0
        if held:
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield from out(table)

    return run


def _ends(pairs):
    """A mapInArrow function: the nodes of the pairs a, b that the mapInArrow function `pairs` makes, once a task."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found: set[int] = set()
        for batch in pairs(batches):
            found.update(np.unique(np.concatenate([c.to_numpy() for c in batch.columns])).tolist())
        nodes = np.fromiter(found, np.int64, len(found))
        for at in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)])], ["node"])

    return run


def _joined_at_once(batches: Iterator) -> Iterator:
    """Of links a, b: node and root (the component's smallest node) of each node, by union-find in this task."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    for at in range(0, len(nodes), 1 << 16):
        part = [(x, find(x)) for x in nodes[at : at + (1 << 16)]]
        part = [(x, r) for x, r in part if x != r]
        if part:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part, strict=True)], ["node", "root"])


def _components(links: DataFrame, at_once: int) -> DataFrame:
    """components(), in one task if there are at most so many links; a component's smallest node may have no row."""
    if links.count() > at_once:
        return components(links)
    return links.select("a", "b").coalesce(1).mapInArrow(_joined_at_once, "node long, root long")


def _dealt(pairs: DataFrame, values: DataFrame, key: str, part: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """pairs with the columns of values (node and others) for their node `key`.

    Values of a few bytes of the keys that many pairs have are broadcast (see joined()); wide ones (`part` given) are
    copied once for every `part` pairs of their key, and the pairs dealt to the copies. `keys`: rows with the same keys,
    to count these without making the pairs once more.
    """
    count = saved((pairs if keys is None else keys).groupBy(key).agg(F.count("*").alias("n")), "count")
    total = count.agg(F.sum("n")).first()[0] or 0
    values = values.withColumnRenamed("node", key)
    if part is None:
        return joined(pairs, values.join(count.hint("merge"), key), [key], "n", total, "inner")
    salts = count.withColumn("salts", F.ceil(F.col("n") / part).cast("long"))
    rows = joined(pairs, salts, [key], "n", total, "inner").withColumn("salt", F.pmod(F.xxhash64("a", "b"), "salts")).drop("salts")
    copies = values.join(salts.hint("merge"), key).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts", "n")
    return rows.join(copies.hint("merge"), [key, "salt"]).drop("salt")


def _screened(met: DataFrame, nodes: DataFrame, most: int) -> DataFrame:
    """The pairs a (lead), b (follower) whose sketches differ in at most `most` bits, and in how many."""
    near = pairs = saved(met.select("lead", F.col("node").alias("follower")).distinct(), "pairs")
    for key in ("lead", "follower"):
        near = _dealt(near, nodes.select("node", *[F.col(w).alias(f"{key}{w}") for w in W]), key, keys=pairs)
    differ = sum(F.bit_count(F.col(f"lead{w}").bitwiseXOR(F.col(f"follower{w}"))) for w in W)
    return near.select(F.col("lead").alias("a"), F.col("follower").alias("b"), differ.alias("differ")).where(F.col("differ") <= most)


def _texts(named: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node and text (one of those with its shingles) of the nodes in `named`, each once there."""
    needed = saved(named.join(nodes.hint("merge"), "node").select("node", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_text")), "needed")
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64("text").alias("_text"), "text")
    return own.join(needed.hint("merge"), ["_id", "_text"]).select("node", "text").dropDuplicates(["node"])


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs whose shingle sets are as similar as that."""
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = saved(_texts(needed, nodes, docs), "texts")
    keys = pairs
    for key in "ab":
        pairs = _dealt(pairs, texts.withColumnRenamed("text", f"t{key}"), key, 256, keys)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            near = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = shingles(a, width), shingles(b, width)
                same = len(np.intersect1d(x, y, assume_unique=True))
                near.append(same >= similarity * (len(x) + len(y) - same))
            mask = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return small_batches(pairs.select("a", "b", "ta", "tb")).mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs of nodes of different components."""
    own = pairs.columns
    for key in "ab":
        pairs = pairs.join(found.select(F.col("node").alias(key), F.col("root").alias(f"r{key}")).hint("merge"), key, "left")
    return pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*own)


def _mixed(rows: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """rows (variant, node and others) of variants with nodes of several components, as _crossing() takes them, sorted."""
    others = [c for c in rows.columns if c not in ("variant", "node")]
    member = saved(nodes.join(found.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), *W, "size"), "member")
    at = saved(rows.join(member.hint("merge"), "node"), "at")
    sizes = at.groupBy("variant", "root").agg(F.count("*").alias("n")).groupBy("variant").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("k"))
    mixed = at.join(sizes.where("k > 1").select("variant", "main").hint("merge"), "variant").select("variant", "node", "root", "main", *W, "size", *others)
    return mixed.repartition("variant").sortWithinPartitions("variant")


def _prefixes(named: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """variant (a shingle), node and place of the shingles that the nodes in `named` begin with, from the rarest among
    those nodes on. Two of the nodes that are similar enough have a shingle here with `similarity` / (1 + `similarity`)
    of their sizes' sum of both sets from there on. A shingle of a single node takes a place and has no row.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingles(text, width).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), node)), pa.array(np.full(len(own), len(own)))], ["variant", "node", "size"])

    grams = saved(small_batches(_texts(named, nodes, docs)).mapInArrow(run, "variant long, node long, size long"), "grams")
    often = saved(grams.groupBy("variant").agg(F.count("*").alias("n")).where("n > 1").withColumn("often", F.col("n")), "often")
    shared = joined(grams, often, ["variant"], "n", grams.count(), "inner")
    own = Window.partitionBy("node")
    place = F.row_number().over(own.orderBy("often", "variant")) - 1 + F.col("size") - F.count("*").over(own)
    return shared.withColumn("place", place.cast("long")).where(F.col("size") - F.col("place") >= F.col("size") * similarity - TINY).select("variant", "node", "place")


def _most_bits(similarity: float) -> int:
    """Bits of the sketch that differ at that similarity (the angle between sets of equal size), and 4 standard deviations."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    n = 64 * WORDS
    return int(n * p + 4 * (n * p * (1 - p)) ** 0.5)


def heads(docs: DataFrame, width: int = 5, similarity: float = 0.8, views: int = 13, bits: int = 28, at_once: int = 1_000_000) -> DataFrame:
    """A row for each group of near copies: doc_id (null: LAST) and text_hash of its first row, n its rows."""
    if views * bits > 64 * WORDS:
        raise ValueError("the views need more bits than a fingerprint has")
    most = _most_bits(similarity)
    rows = saved(prints(docs, width), "prints")
    nodes = saved(rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("size", *W)]), "nodes")
    emitted = nodes.select("node", *W).mapInArrow(_variants(views, bits), "variant long, node long")
    met = saved(emitted.repartition("variant").sortWithinPartitions("variant", "node").mapInArrow(_followers, "variant long, node long, lead long"), "met")

    near = saved(_screened(met, nodes, most), "near")
    place = F.row_number().over(Window.partitionBy("b").orderBy("differ", "a"))
    near = saved(near.select("a", "b", place.alias("place")), "near")
    tried = near.where(F.col("place") <= LEADS)
    links = saved(_verified(tried.where("place = 1").select("a", "b"), nodes, docs, width, similarity), "links")
    found = saved(_components(links, at_once), "found")
    more = saved(_apart(tried.where("place > 1").select("a", "b"), found), "more")
    links = saved(links.unionByName(_verified(more, nodes, docs, width, similarity)), "links")
    found = saved(_components(links, at_once), "found")

    # what is left are a node's pairs with further first nodes of variants, screened by now, and those of the others
    crossing = _crossing(most, similarity=similarity)
    met = _mixed(met.select("variant", "node"), found, nodes).mapInArrow(_ends(crossing), "node long")
    left = near.where(F.col("place") > LEADS)
    named = saved(met.unionByName(left.select(F.col("a").alias("node"))).unionByName(left.select(F.col("b").alias("node"))).distinct(), "named")
    prefixes = saved(_prefixes(named, nodes, docs, width, similarity), "prefixes")
    cross = saved(_mixed(prefixes, found, nodes).mapInArrow(crossing, "a long, b long").distinct(), "cross")
    rest, step = cross.join(tried.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), LEADS
    while True:
        place = F.row_number().over(Window.partitionBy("b").orderBy("a"))
        rest = saved(_apart(rest, found).withColumn("place", place), "rest")
        if rest.isEmpty():
            break
        more = saved(_verified(rest.where(F.col("place") <= step).select("a", "b"), nodes, docs, width, similarity), "links")
        links = saved(links.unionByName(more), "links")
        found = saved(_components(links, at_once), "found")
        rest, step = rest.where(F.col("place") > step).select("a", "b"), 8 * step

    grouped = nodes.join(found.hint("merge"), "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    return grouped.agg(F.min("first").alias("head"), F.sum("n").alias("n")).select("head.doc_id", "head.text_hash", "n")


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """docs, one row of each group of near copies: that with the smallest doc_id. All columns stay. Parameters as in heads()."""
    return only(docs, heads(docs, **parameters))
