"""Best-fit packing of token pieces into fixed-length sequences, finished by swap-based local search.

Pieces are dealt to groups by a hash (a group's size has a fixed expectation, whatever the keys), and each group is
packed by itself: best fit in decreasing order gives the start, then local search moves pieces, swaps one for one,
or two for one, between underfull bins whenever that raises the sum of squared fills, until bins run empty. Where nothing
does, exchanges that keep the sum as it is bring other pieces into the underfull bins, a bounded number of times. A group
can waste less than one bin against packing it with its neighbours: one in several thousand.

Cases: a null or empty text is a piece of the end id alone; a text over the capacity is cut, the first piece taking the
rest; rows that share a doc_id, or are equal, are packed each; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import saved, small_batches

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins (lists of positions in lengths): each piece, longest first, goes to the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set if a bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - n
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


class LocalSearch:
    """Exchanges between bins: a move (nothing for one or two pieces), one for one, one for two, two for one.

    Underfull bins are indexed by the lengths of their pieces and of their pairs of pieces, so that the partner of an
    exchange of a given size is a look-up, whatever the number of bins. Full bins are indexed likewise: an exchange with
    one of them swaps the two fills and leaves the squared fill as it is, but puts other pieces into the underfull bin.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int, seed: int = 1):
        self.size, self.capacity, self.random = lengths, capacity, random.Random(seed)
        self.bins = [list(b) for b in bins]
        self.fill = [sum(lengths[i] for i in b) for b in self.bins]
        self.alive = sum(f > 0 for f in self.fill)
        self.open: dict[int, tuple[set[int], set[int]]] = {}
        #: By pieces (1 or 2): their length to the underfull bins that hold them (a dict as an ordered set), and to full bins.
        self.held: dict[int, dict[int, dict[int, None]]] = {1: defaultdict(dict), 2: defaultdict(dict)}
        self.full: dict[int, dict[int, list[int]]] = {1: defaultdict(list), 2: defaultdict(list)}
        self.listed: set[tuple[int, int, int]] = set()
        for b in range(len(self.bins)):
            self._enter(b)

    def _sizes(self, b: int) -> tuple[set[int], set[int]]:
        """The lengths of a bin's pieces, and of its pairs of pieces."""
        many = Counter(self.size[i] for i in self.bins[b])
        kinds = sorted(many)
        pairs = {n + m for x, n in enumerate(kinds) for m in kinds[x + 1 :]} | {2 * n for n in kinds if many[n] > 1}
        return set(kinds), pairs

    def _enter(self, b: int) -> None:
        if self.fill[b]:
            sizes = self._sizes(b)
            if self.fill[b] < self.capacity:
                self.open[b] = sizes
            for count, own in enumerate(sizes, 1):
                for n in own:
                    if b in self.open:
                        self.held[count][n][b] = None
                    elif (count, n, b) not in self.listed:
                        self.listed.add((count, n, b))
                        self.full[count][n].append(b)

    def _leave(self, b: int) -> None:
        for count, own in enumerate(self.open.pop(b, ()), 1):
            for n in own:
                del self.held[count][n][b]

    def _pieces(self, b: int, total: int, count: int) -> list[int] | None:
        """So many pieces of a bin of so much length together."""
        seen: dict[int, int] = {}
        for i in self.bins[b] if count else ():
            n = self.size[i]
            if count == 1 and n == total:
                return [i]
            if count == 2 and total - n in seen:
                return [seen[total - n], i]
            seen.setdefault(n, i)
        return None if count else []

    def exchange(self, a: int, out: int, count: int, b: int, back: int, many: int) -> None:
        give, take = self._pieces(a, out, count), self._pieces(b, back, many)
        self._leave(a)
        self._leave(b)
        self.bins[a] = [i for i in self.bins[a] if i not in give] + take
        self.bins[b] = [i for i in self.bins[b] if i not in take] + give
        self.fill[a] += back - out
        self.fill[b] -= back - out
        self.alive -= (not self.fill[a]) + (not self.fill[b])
        self._enter(a)
        self._enter(b)

    def _offers(self, a: int) -> list[tuple[int, int, int]]:
        """(length, pieces, pieces to take for them) of what an underfull bin can give."""
        ones, twos = self.open[a]
        return [(0, 0, 1), (0, 0, 2), *((n, 1, 1) for n in ones), *((n, 1, 2) for n in ones), *((n, 2, 1) for n in twos)]

    def raising(self, a: int, least: int):
        """An exchange with an underfull bin that adds at least `least` tokens to bin a, as many as can be, and raises squared fill."""
        offers = self._offers(a)
        for net in range(self.capacity - self.fill[a], least - 1, -1):
            for out, count, many in offers:
                for b in self.held[many].get(out + net, ()):
                    if b != a and net > self.fill[b] - self.fill[a]:
                        return out, count, b, out + net, many
        return None

    def sideways(self, a: int):
        """An exchange with a full bin that swaps the two fills, chosen at random."""
        gap, offers = self.capacity - self.fill[a], self._offers(a)
        self.random.shuffle(offers)
        for out, count, many in offers:
            listed = self.full[many].get(out + gap)
            while listed:
                k = self.random.randrange(len(listed))
                b = listed[k]
                if self.fill[b] == self.capacity and self._pieces(b, out + gap, many):
                    return out, count, b, out + gap, many
                self.listed.discard((many, out + gap, b))  # no longer so
                listed[k] = listed[-1]
                listed.pop()
        return None

    def run(self, need: int, steps: int) -> None:
        """Until `need` bins are left, or nothing raises squared fill after so many sideways exchanges."""
        queue, left, until = list(self.open), steps, steps
        while self.alive > need:
            while queue and self.alive > need:  # those that fill a bin: a look-up for each offer
                a = queue.pop()
                if a in self.open and (step := self.raising(a, self.capacity - self.fill[a])):
                    self.exchange(a, *step)
                    queue.append(step[2])
            if not queue and left <= until:  # all others, now and then
                until = left - len(self.open)
                for a in sorted(self.open, key=lambda b: -self.fill[b]):
                    while a in self.open and (step := self.raising(a, 1)):
                        self.exchange(a, *step)
                        queue += [a, step[2]]
                        until = left
            if queue:
                continue
            if left <= 0 or not self.open:
                return
            left -= 1
            a = self.random.choice(list(self.open))
            if step := self.sideways(a):
                self.exchange(a, *step)
                queue.append(step[2])


def improve(bins: list[list[int]], lengths: list[int], capacity: int, *, sideways: int = 4000) -> list[list[int]]:
    """Local search from a packing: as many bins or fewer. sideways: the least number of sideways exchanges to try."""
    need = -(-sum(lengths) // capacity)
    found = LocalSearch(bins, lengths, capacity)
    found.run(need, max(sideways, 5 * len(found.open)))
    return [b for b in found.bins if b]


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return improve(best_fit(lengths, capacity), lengths, capacity)


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, *, with_ids: bool = False) -> DataFrame:
    """A row per piece of each encoded document: doc_id, piece, start, length, ids_crc32, salt, and its ids if asked for."""

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tokenlake.llm.tokens import encoder

        enc, salt = encoder(tokenizer), 0
        tail = enc.pack([end_id])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(enc.encode(text) + tail, dtype=enc.dtype).astype("<u4")
                first = len(ids) % capacity or capacity
                for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, end - capacity) if piece else 0
                    part = ids[start:end]
                    salt += 1
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(part), salt, *[part.tolist()] * with_ids))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * with_ids]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt", *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(small_batches).mapInArrow(cut, PIECES + ", ids array<long>" * with_ids)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_size: int = 50_000) -> DataFrame:
    """pieces (read from a table, so that they are the same each time) with sequence_id and offset."""
    n = pieces.count()
    groups = max(1, -(-n // group_size))
    keyed = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(groups)))

    def place(table):
        import pyarrow as pa

        lengths, group = table.column("length").to_pylist(), table.column("group")[0].as_py()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for b, own in enumerate(pack(lengths, capacity)):
            at = 0
            for i in own:
                sequence[i], offset[i], at = (group << 32) + b, at, at + lengths[i]
        table = table.drop_columns(["group", "salt"])
        return table.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    names = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "salt"]
    return keyed.groupBy("group").applyInArrow(place, ", ".join([*names, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, *, with_ids: bool = False) -> DataFrame:
    """Encode, cut and pack whole documents: a row per piece with its sequence and its place there."""
    return pack_pieces(saved(pieces_of(docs, tokenizer, end_id, capacity, with_ids=with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The token sequences themselves, from a packing that carries ids: sequence_id, n_tokens, input_ids, boundaries."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", F.flatten(F.col("parts.ids")).alias("input_ids"), F.col("parts.offset").alias("boundaries"), F.col("parts.doc_id").alias("doc_ids"))
