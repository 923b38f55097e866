"""Nearest neighbours by largest inner product, by collision-counting hashing.

Inner products become distances by one more coordinate: with the largest norm M of all vectors, x / M gets
sqrt(1 - |x|^2 / M^2), and a query q / |q| gets 0; the nearest such point has the largest inner product. Each block of
vectors keeps `projections` arrays sorted by one random projection each. A query opens a window centred at its own
projection in every array, first as wide as the nearest of a small sample asks for, counts for each vector in how many
windows it lies (or, where a window holds most, how many it is outside of), and verifies (exactly, on the original
vectors) those that reach the collision threshold. Virtual rehashing widens the windows by a factor and counts only
what is new, until the k-th verified point lies within the radius that the windows stand for. In the last round the
windows cover everything, so no query ends with fewer than it could have.

Vectors are dealt to blocks by a hash and queries to chunks; a task holds one block and one chunk, whatever the
size of the table, and gives each query its best k there; the best of all blocks are merged by a bounded top-k.

Cases: vectors that are null, zero, of another length than most, or hold a null or non-finite component take no part;
ties go to the smaller vec_id; a query's own vec_id is no candidate; a null vec_id takes no part; rows that share a
vec_id are candidates each, and queries each (with their own ranks) unless their vectors are equal, which makes them one; with fewer than k candidates all are returned; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class CollisionIndex:
    """Sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, *, projections: int = 40, seed: int = 7):
        self.ids, self.vectors = ids, vectors
        unit = vectors / largest  # so that squares cannot overflow
        rest = np.sqrt(np.maximum(0.0, 1 - (unit * unit).sum(axis=1)))
        rng = np.random.default_rng(seed)
        self.lines = rng.standard_normal((projections, vectors.shape[1] + 1))
        at = np.c_[unit, rest] @ self.lines.T
        self.order = np.argsort(at, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.take_along_axis(at.T, self.order, axis=1)
        self.largest = largest
        self.single = unit.astype(np.float32)

    def first_radii(self, directions: np.ndarray, own: np.ndarray, sample: int) -> np.ndarray:
        """Where each query's windows start: the distance of the nearest in a sample of the block."""
        some = np.random.default_rng(1).permutation(len(self.ids))[:sample]
        scores = directions @ (self.vectors[some] / self.largest).T
        scores[own[:, None] == self.ids[some][None, :]] = -1
        best = scores.max(axis=1, initial=-1)
        return np.sqrt(np.maximum(2 - 2 * best, 1e-6))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, *, share: float = 0.75, half: float = 1.5, widen: float = 1.2, sample: int = 256):
        """For each query (ids, scores) of the best k found. half: a window's half-width in radii; share: the threshold."""
        n, m = len(self.ids), len(self.lines)
        peaks = np.abs(queries).max(axis=1)
        norms = peaks * np.sqrt(((queries / peaks[:, None]) ** 2).sum(axis=1))
        directions = queries / norms[:, None]
        centre = directions @ self.lines[:, :-1].T
        radii = self.first_radii(directions, own, sample)
        least = int(np.ceil(share * m))
        reach = half * radii
        low = np.stack([np.searchsorted(self.sorted[p], centre[:, p] - reach) for p in range(m)])
        high = np.stack([np.searchsorted(self.sorted[p], centre[:, p] + reach, side="right") for p in range(m)])
        for q, query in enumerate(queries):
            radius, a, b, base = float(radii[q]), low[:, q], high[:, q], 0
            counts = np.zeros(n, dtype=np.int16)
            for p in range(m):
                line = self.order[p]
                if 2 * (b[p] - a[p]) <= n:
                    counts[line[a[p] : b[p]]] += 1
                else:  # the window holds most: count those outside
                    base += 1
                    counts[line[: a[p]]] -= 1
                    counts[line[b[p] :]] -= 1
            seen = self.ids == own[q]
            got_at, got = np.empty(0, np.int64), np.empty(0)
            while True:
                new = np.flatnonzero((counts >= least - base) & ~seen) if radius < np.inf else np.flatnonzero(~seen)
                if len(new):
                    seen[new] = True
                    got_at, got = self.verified(query, directions[q], new, got_at, got, k)
                # squared distance of the transformed points: 2 - 2 q.x / (|q| M)
                if radius == np.inf or len(got) >= k and 2 - 2 * (got[k - 1] / norms[q] / self.largest) <= radius * radius:
                    break
                if radius > 2:
                    radius = np.inf
                    continue
                radius *= widen
                for p in range(m):
                    line = self.order[p]
                    c, d = np.searchsorted(self.sorted[p], centre[q, p] - half * radius), np.searchsorted(self.sorted[p], centre[q, p] + half * radius, side="right")
                    counts[line[c : a[p]]] += 1
                    counts[line[b[p] : d]] += 1
                    a[p], b[p] = c, d
            yield self.ids[got_at], got

    def verified(self, query: np.ndarray, direction: np.ndarray, new: np.ndarray, got_at: np.ndarray, got: np.ndarray, k: int):
        """The best k of those got and the new ones: single precision, on vectors scaled to at most length 1, leaves out
        what cannot be among them (its error is below 2^-24 times the square root of a length, and a rounding a term).
        """
        if len(new) > k:
            rough = self.single[new] @ direction.astype(np.float32)
            slack = max(1e-4, 1e-6 * len(direction))
            new = new[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack]
        scores = (self.vectors[new] * query).sum(axis=1)
        at, scores = np.r_[got_at, new], np.r_[got, scores]
        best = np.lexsort((self.ids[at], -scores))[:k]
        return at[best], scores[best]


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and the vector (array<double>) of rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (usual.d if usual else 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, *, column: str = "embedding", block: int = 16384, chunk: int = 8192, projections: int = 40) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest. is_query: a condition on vec_id."""
    rows = usable(vectors, column)
    peak = F.array_max(F.transform("v", F.abs))
    norm = peak * F.sqrt(F.aggregate(F.transform("v", lambda x: x / peak), F.lit(0.0), lambda s, x: s + x * x))
    n, asked, largest = rows.agg(F.count("*"), F.count_if(is_query), F.max(norm)).first()
    blocks, chunks = max(1, -(-n // block)), max(1, -(-(asked or 0) // chunk))
    limit = (largest or 1.0) * (1 + 1e-12)
    part = lambda count, salt: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    base = rows.select(part(blocks, 1).alias("block"), every(chunks).alias("chunk"), "vec_id", "v")
    asks = rows.where(is_query).dropDuplicates(["vec_id", "v"]).select(every(blocks).alias("block"), part(chunks, 2).alias("chunk"), "vec_id", "v", F.xxhash64("v").alias("mark"))

    def matrix(column) -> np.ndarray:
        flat = column.combine_chunks()
        return np.asarray(flat.flatten(), dtype=np.float64).reshape(len(flat), -1)

    def find(left, right):
        import pyarrow as pa

        from tokenlake.llm.ann import CollisionIndex

        names = ["query_id", "mark", "vec_id", "score"]
        if not len(left) or not len(right):
            return pa.table([*[pa.array([], pa.int64())] * 3, pa.array([], pa.float64())], names)
        index = CollisionIndex(left.column("vec_id").to_numpy(), matrix(left.column("v")), limit, projections=projections)
        own, marks = right.column("vec_id").to_numpy(), right.column("mark").to_numpy()
        found = list(index.search(matrix(right.column("v")), own, k))
        sizes = [len(ids) for ids, _ in found]
        return pa.table([pa.array(np.repeat(own, sizes)), pa.array(np.repeat(marks, sizes)), pa.array(np.concatenate([i for i, _ in found])), pa.array(np.concatenate([s for _, s in found]))], names)

    schema = T._parse_datatype_string("query_id long, mark long, vec_id long, score double")
    best = base.groupBy("block", "chunk").cogroup(asks.groupBy("block", "chunk")).applyInArrow(find, schema)
    from pyspark.sql import Window

    # at most k rows of a block for each row of a query
    rank = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
