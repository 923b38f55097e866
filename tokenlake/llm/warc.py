"""WARC archives with revisit records, and a globally ordered capture index by external merge.

Each task writes one archive of gzip members and a run: its captures sorted by URL key and timestamp. The runs are
then merged: splitters on the whole sort key cut the key space into ranges of like size (a hot host or URL spans
several), and each range, which is a task's bounded share, merges its slices of all runs with a loser tree. The ranges follow each other, so the index
is in global order. Only runs that Spark committed name an archive, so what a lost task wrote is never read.

A payload of at least `least` bytes that occurs more than once is stored in the row with the largest page_id; the
others are revisit records that refer to it and keep its HTTP header with the payload's length.

Cases: null html is an empty payload; a null url has an empty key; null page_ids count as smaller than all others, and
never are the one that others refer to; rows that share both page_id and payload are each a response (or a revisit);
an empty table gives no row; a payload of any size is one record; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.llm.common import filesystem, joined, saved, shared_dir, small_batches

LEAST = 1000
RUN = "run string, seq long, urlkey string, ts timestamp, page_id long, file string, offset long, size long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """A sort-friendly key: host labels reversed and joined by commas, then path and query; scheme and fragment go."""
    rest = (url or "").strip().split("#", 1)[0]
    rest = rest.split("://", 1)[-1]
    host, slash, path = rest.partition("/")
    host = host.rsplit("@", 1)[-1].lower()
    host = host.removeprefix("www.").removesuffix(":80").removesuffix(":443")
    return f"{','.join(reversed(host.split('.')))}){slash}{path}" if host else path


def record_id(page_id: int | None, digest: str) -> str:
    import hashlib

    h = hashlib.sha1(f"{page_id}:{digest}".encode()).hexdigest()
    return f"urn:uuid:{h[:8]}-{h[8:12]}-5{h[13:16]}-8{h[17:20]}-{h[20:32]}"


def marked(pages: DataFrame, ts: str | None = None) -> DataFrame:
    """page_id, url, ts, payload, digest, first (the page that a revisit refers to, else null)."""
    at = F.col(ts).cast("timestamp") if ts else F.timestamp_seconds(F.lit(1704067200) + F.coalesce(F.col("page_id"), F.lit(0)))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", at.alias("ts"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= LEAST
    # Digests alone tell which payloads are copies.
    seen = saved(rows.select("page_id", "digest", large.alias("large")), "digests")
    copies = saved(seen.where("large").groupBy(F.col("digest").alias("key")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "copies")
    # A small payload refers to nothing; its key is its own, so that small payloads do not meet in one task.
    key = F.when(large, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.substring("digest", 1, 8)))
    found = joined(rows.withColumn("key", key), copies, ["key"], "n", seen.count())
    own = F.col("first").isNull() | F.col("first").eqNullSafe(F.col("page_id"))
    return found.select("page_id", "url", "ts", "payload", "digest", F.when(~own, F.col("first")).alias("first"))


def write_archives(pages: DataFrame, ts: str | None = None, *, level: int = 4) -> tuple[str, DataFrame]:
    """(folder of the archives, runs: their captures, each run sorted by urlkey, ts, page_id)."""
    path = shared_dir(pages.sparkSession, "warc")

    def write(batches: Iterator) -> Iterator:
        import base64
        import os
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        from tokenlake.llm.warc import PROFILE, record_id, url_key

        task = TaskContext.get()
        fs, root = filesystem(path)
        run, out, at, captures = f"{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}", None, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(os.path.join(root, f"{run}.warc.gz"), compression=None)
                payload, digest, first = row["payload"], row["digest"], row["first"]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                block = http if first is not None else http + payload
                date = row["ts"].strftime("%Y-%m-%dT%H:%M:%SZ") if row["ts"] is not None else "1970-01-01T00:00:00Z"
                uri = "".join(c for c in row["url"] or "" if c > " ")
                head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <{record_id(row['page_id'], digest)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
                head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"X-Page-Id: {'' if row['page_id'] is None else row['page_id']}"]
                if first is not None:
                    head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(first, digest)}>", f"X-Refers-To-Page-Id: {first}"]
                head.append(f"Content-Length: {len(block)}")
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()
                out.write(member)
                captures.append((url_key(row["url"]), row["ts"], row["page_id"], at, len(member)))
                at += len(member)
        if out is not None:
            out.close()
            low = __import__("datetime").datetime.min
            captures.sort(key=lambda c: (c[0], (c[1] or low).replace(tzinfo=None), c[2] if c[2] is not None else -(1 << 63), c[3]))
            for i in range(0, len(captures), 1 << 15):
                part = list(zip(*captures[i : i + (1 << 15)], strict=True))
                n = len(part[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([run] * n), pa.array(range(i, i + n), pa.int64()), pa.array(part[0], pa.string()), pa.array(part[1], pa.timestamp("us", "UTC")), pa.array(part[2], pa.int64()), pa.array([f"{run}.warc.gz"] * n), pa.array(part[3], pa.int64()), pa.array(part[4], pa.int64())],
                    ["run", "seq", "urlkey", "ts", "page_id", "file", "offset", "size"],
                )

    return path, saved(small_batches(marked(pages, ts)).mapInArrow(write, RUN), "runs")


class LoserTree:
    """k-way merge of sorted iterators of (key, value): each inner node holds the loser of its match."""

    def __init__(self, runs: list[Iterator]):
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._enter(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _enter(self, winner: int) -> None:
        """First entries wait at the first free node; later they play."""
        node = (winner + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self._beats(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.tree[0]] is not None:
            winner = self.tree[0]
            yield self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            node = (winner + self.k) // 2
            while node > 0:
                if self._beats(self.tree[node], winner):
                    self.tree[node], winner = winner, self.tree[node]
                node //= 2
            self.tree[0] = winner


def merged_index(runs: DataFrame, *, range_size: int = 50_000) -> DataFrame:
    """All captures in global order of urlkey, ts, page_id: the runs' columns, range and rank (place in the range).

    Spark samples the whole sort key for the ranges' splitters, so a hot URL spans several; in a range each run's slice
    is in order already (run, seq), and the slices are merged. Ranges are tasks, and follow each other.
    """
    ranges = max(1, -(-runs.count() // range_size))

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        from tokenlake.llm.warc import LoserTree

        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        names = table.column("run").to_pylist()
        starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
        low = -(1 << 63)
        cols = [table.column(c).to_pylist() for c in ("urlkey", "ts", "page_id")]
        key = [(u, t.timestamp() if t is not None else float("-inf"), p if p is not None else low) for u, t, p in zip(*cols, strict=True)]
        slices = [iter([(key[i], i) for i in range(x, y)]) for x, y in zip(starts, [*starts[1:], len(names)], strict=True)]
        order = [i for _, i in LoserTree(slices)]
        got = table.take(pa.array(order, pa.int64())).append_column("range", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32()))
        yield from got.append_column("rank", pa.array(range(len(order)), pa.int64())).to_batches()

    dealt = runs.repartitionByRange(ranges, "urlkey", "ts", "page_id").sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(merge, RUN + ", range int, rank long")


def read_captures(path: str, index: DataFrame) -> DataFrame:
    """Each capture of an index read back from its archive: page_id, record_type, digest and length of the payload."""

    def read(batches: Iterator) -> Iterator:
        import base64
        import hashlib

        import pyarrow as pa

        fs, root = filesystem(path)
        files: dict[str, object] = {}
        for batch in batches:
            rows = []
            for file, offset, size in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "size")), strict=True):
                if file not in files:
                    if len(files) >= 64:
                        files.pop(next(iter(files))).close()
                    files[file] = fs.open_input_file(f"{root}/{file}")
                raw = zlib.decompress(files[file].read_at(size, offset), 31)
                head, _, block = raw.partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
                http, _, payload = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                n = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                if fields["WARC-Type"] == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"{file} at {offset}: the payload is not that of its digest")
                page, refers = fields.get("X-Page-Id", ""), fields.get("X-Refers-To-Page-Id", "")
                rows.append((int(page) if page.strip() else None, n, digest, fields["WARC-Type"], int(refers) if refers else None, fields.get("WARC-Target-URI", "")))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                got = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*got, *(batch.column(c) for c in ("urlkey", "ts", "range", "rank"))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "urlkey", "ts", "range", "rank"])

    need = index.select("file", "offset", "size", "urlkey", "ts", "range", "rank")
    return need.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, urlkey string, ts timestamp, range int, rank long")
