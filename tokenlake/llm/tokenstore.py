"""Token-ID binary files: each document a zstandard frame under one shared dictionary, with an offset index.

A store is a folder: `dictionary` (the shared dictionary's bytes), `index` (a Parquet table) and `shards`. A shard file is
`MAGIC`, one byte of id width, 8 bytes of dictionary hash, then frames. The index has a row per document: its shard file,
the frame's place, its length in ids and the ids before it in the shard. Only index rows that Spark committed name a file,
so what a lost or repeated task wrote is never read. open_store() needs nothing but the folder's path.

Cases: a null or empty text gives just the end id; rows that share a doc_id are all kept, ordered by the text's hash;
a null doc_id comes first; an empty table gives an empty index; other columns are ignored; a text of any length is
one frame; where too little text exists to train a dictionary, the sample itself is one (raw), or there is none.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenlake.llm.common import filesystem, shared_dir, small_batches

MAGIC = b"TLTOK1"
HEADER = struct.Struct("<6sB8s")
INDEX = "doc_id long, shard int, file string, offset long, frame_bytes int, n_tokens long, shard_start long"


@dataclass
class TokenStore:
    path: str
    index: DataFrame
    dictionary: bytes
    dictionary_hash: bytes


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of serialized id arrays; raw content if there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionary_hash(raw: bytes) -> bytes:
    import hashlib

    return hashlib.sha256(raw).digest()[:8]


def codec(raw: bytes, level: int = 3):
    """(compressor, decompressor) for frames of one document each."""
    import zstandard

    have = zstandard.ZstdCompressionDict(raw) if raw else None
    return zstandard.ZstdCompressor(level=level, dict_data=have), zstandard.ZstdDecompressor(dict_data=have)


def open_store(spark: SparkSession, path: str) -> TokenStore:
    """A store that was written before, by any session."""
    fs, root = filesystem(path)
    with fs.open_input_stream(f"{root}/dictionary") as f:
        raw = f.read()
    return TokenStore(path, spark.read.schema(INDEX).parquet(f"{path}/index"), raw, dictionary_hash(raw))


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 1, *, path: str | None = None, dict_bytes: int = 32768, sample_docs: int = 2048, sample_chars: int = 16384, level: int = 3) -> TokenStore:
    """Encode whole texts and write them in ascending doc_id order to `path` (a new folder; by default in the shared one).

    The dictionary is trained on the first `sample_chars` characters of about `sample_docs` texts, chosen by a hash of the
    id: a dictionary serves the beginnings of frames, and its training set is bounded by both.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    share = sample_docs / max(1, rows.count())
    u = F.pmod(F.xxhash64("doc_id", "tie", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    short = rows.where((u < share) & (F.length("text") > 0)).select(F.substring("text", 1, sample_chars).alias("text"))
    from tokenlake.llm.tokens import encoder

    enc = encoder(tokenizer)
    raw = train_dictionary([enc.encode(r.text) for r in short.toLocalIterator()], dict_bytes)
    mark, path, end = dictionary_hash(raw), path or shared_dir(spark, "tokens"), end_id
    fs, root = filesystem(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as f:
        f.write(raw)

    def write(batches: Iterator) -> Iterator:
        import os
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        from tokenlake.llm.tokens import encoder
        from tokenlake.llm.tokenstore import HEADER

        task, enc = TaskContext.get(), encoder(tokenizer)
        pack, tail = codec(raw, level)[0].compress, enc.pack([end])
        fs, root = filesystem(f"{path}/shards")
        out, name, at, before = None, f"{task.partitionId():06d}-{task.attemptNumber()}-{uuid.uuid4().hex[:8]}.tok", HEADER.size, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(os.path.join(root, name))
                    out.write(HEADER.pack(MAGIC, enc.width, mark))
                ids = enc.encode(text) + tail
                frame, n = pack(ids), len(ids) // enc.width
                out.write(frame)
                rows.append((doc_id, task.partitionId(), name, at, len(frame), n, before))
                at, before = at + len(frame), before + n
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
                names = ["doc_id", "shard", "file", "offset", "frame_bytes", "n_tokens", "shard_start"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if out is not None:
            out.close()

    ordered = small_batches(rows).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(write, INDEX).write.parquet(f"{path}/index")
    return open_store(spark, path)


def read_store(store: TokenStore, *, with_ids: bool = False) -> DataFrame:
    """Every document read back: doc_id, start, n_tokens, ids_crc32, shard, offset, and its ids if asked for.

    start counts the ids of all documents before it: the shards follow each other in doc_id order, so the totals of
    earlier shards (a row per shard) are added to the index's count.
    """
    from pyspark.sql import Window

    path, raw, mark = store.path, store.dictionary, store.dictionary_hash
    totals = store.index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("base"))
    placed = store.index.join(starts, "shard").withColumn("start", F.col("base") + F.col("shard_start"))

    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tokenlake.llm.tokenstore import HEADER

        unpack = codec(raw)[1]
        fs, root = filesystem(f"{path}/shards")
        name, source, width = None, None, 2
        for batch in batches:
            crcs, ids = [], []
            for file, offset, size, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{root}/{file}")
                    magic, width, found = HEADER.unpack(source.read_at(HEADER.size, 0))
                    if magic != MAGIC or found != mark:
                        raise ValueError(f"{file}: not a token shard of this dictionary")
                got = np.frombuffer(unpack.decompress(source.read_at(size, offset)), dtype=f"<u{width}")
                if len(got) != n:
                    raise ValueError(f"{file} at {offset}: {len(got)} ids, the index has {n}")
                wide = got.astype("<u4")
                crcs.append(zlib.crc32(wide))
                if with_ids:
                    ids.append(wide)
            cols = [batch.column(0), batch.column(1), pa.array(crcs, pa.int64()), batch.column(3), batch.column(5), batch.column(6)]
            names = ["doc_id", "shard", "ids_crc32", "offset", "n_tokens", "start"]
            if with_ids:
                cols, names = [*cols, pa.array([i.tolist() for i in ids], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    need = placed.select("doc_id", "shard", "file", "offset", "frame_bytes", "n_tokens", "start")
    schema = "doc_id long, shard int, ids_crc32 long, offset long, n_tokens long, start long" + ", ids array<long>" * with_ids
    out = need.mapInArrow(read, schema)
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset", *["ids"] * with_ids)


def read_document(spark: SparkSession, store: TokenStore, doc_id: int) -> list[list[int]]:
    """Short-document access: the ids of the rows of one doc_id, by the index and one read of each frame."""
    fs, root = filesystem(f"{store.path}/shards")
    unpack, found = codec(store.dictionary)[1], []
    for r in store.index.where(F.col("doc_id") == doc_id).toLocalIterator():
        import numpy as np

        with fs.open_input_file(f"{root}/{r.file}") as source:
            _, width, _ = HEADER.unpack(source.read_at(HEADER.size, 0))
            found.append(np.frombuffer(unpack.decompress(source.read_at(r.frame_bytes, r.offset)), dtype=f"<u{width}").tolist())
    return found
