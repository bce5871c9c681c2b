"""Operator 10: token ids as length-delimited binary records with an offset index.

A record file is a row of frames: length (u64), masked checksum of the length (u32), data, masked checksum of
the data (u32), all little-endian; the data is a document's ids, 16 bits each where the vocabulary allows it.
Checksums are crc32, masked by a rotation and a constant so that a frame of frames has checksums of its own.
The index beside it has one entry per record (document id, offset, ids), for shuffled reads by offset.
Files are range-partitioned and sorted by document id; file names are an attempt's own, and the table of
files that the write returns decides which count.

Defined cases: null and empty texts are the end id alone; null ids come first; repeated ids follow each other,
by the text's hash; an empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_u32, shared_path, slices, stored, utf8
from .encode import encoder
from .files import create, open_random, open_stream

# The mask's rotation and constant, as in the common framed-record format.
MASK_ROTATE, MASK_ADD = 15, 0xA282EAD8
ENTRY = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("tokens", "<u4")])
FILES = "part int, data string, idx string, records long, tokens long, bytes_per_id int"
READ = 4 << 20


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> MASK_ROTATE) | (c << (32 - MASK_ROTATE))) + MASK_ADD) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    n = struct.pack("<Q", len(data))
    return b"".join((n, struct.pack("<I", masked(n)), data, struct.pack("<I", masked(data))))


def unframe(stream) -> Iterator[bytes]:
    """The data of each frame of a stream; a wrong checksum or a cut file is an error."""
    held, at = b"", 0

    def need(n):
        nonlocal held, at
        while len(held) - at < n:
            more = stream.read(max(READ, n))
            if not more:
                return False
            held, at = held[at:] + more, 0
        return True
    while need(12):
        n, check = struct.unpack_from("<QI", held, at)
        if masked(held[at:at + 8]) != check:
            raise ValueError("record length is damaged")
        if not need(16 + n):
            raise ValueError("record file is cut short")
        data = held[at + 12:at + 12 + n]
        if masked(data) != struct.unpack_from("<I", held, at + 12 + n)[0]:
            raise ValueError("record data is damaged")
        at += 16 + n
        yield data
    if len(held) - at:
        raise ValueError("record file is cut short")


def read_at(file, offset: int) -> bytes:
    """The record at an offset of an open file."""
    file.seek(offset)
    head = file.read(12)
    n, check = struct.unpack("<QI", head)
    if masked(head[:8]) != check:
        raise ValueError("record length is damaged")
    data = file.read(n)
    if masked(data) != struct.unpack("<I", file.read(4))[0]:
        raise ValueError("record data is damaged")
    return data


def _write(folder: str, vocabulary: str, end_id: int):
    def run(batches):
        enc, part, out = encoder(vocabulary), TaskContext.get().partitionId(), None
        width = 2 if enc.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
        kind, end, at, total, entries = np.dtype(f"<u{width}"), np.array([end_id], dtype=np.uint32), 0, 0, []
        for b in batches:
            for s in slices(b, "text"):
                if out is None:
                    data, out = create(folder, f"part-{part:06d}", ".rec")
                block = []
                for doc_id, raw in zip(s.column("doc_id").to_pylist(), enc.ids(s.column("text"))):
                    ids = np.concatenate((np.frombuffer(raw, dtype=np.uint32), end))
                    f = frame(ids.astype(kind).tobytes())
                    entries.append((doc_id or 0, doc_id is not None, at, len(ids)))
                    at += len(f)
                    total += len(ids)
                    block.append(f)
                out.write(b"".join(block))
        if out is not None:
            out.close()
            idx, index = create(folder, f"part-{part:06d}", ".idx")
            index.write(json.dumps({"records": len(entries), "bytes_per_id": width}).encode().ljust(64))
            index.write(np.array(entries, dtype=ENTRY).tobytes())
            index.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "data": data, "idx": idx, "records": len(entries), "tokens": total, "bytes_per_id": width}],
                                             schema=pa.schema([("part", pa.int32()), ("data", pa.string()), ("idx", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes_per_id", pa.int32())]))
    return run


def write(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write all documents in ascending id order; returns the table of files, in order of `part`."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    x = x.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    x = x.select("doc_id", F.col("text").cast("string").alias("text"))
    folder = folder or shared_path(spark, "records")
    return stored(x.mapInArrow(_write(folder, vocabulary, end_id), FILES), "record-files")


def _read(batches):
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
    for b in batches:
        for f in b.to_pylist():
            with open_stream(f["idx"]) as s:
                head = json.loads(s.read(64))
                entries = np.frombuffer(s.read(), dtype=ENTRY)
            if len(entries) != head["records"]:
                raise ValueError("index is cut short")
            start, block, size = f["base"], [], 0
            with open_stream(f["data"]) as s:
                for e, data in zip(entries, unframe(s), strict=True):
                    ids = np.frombuffer(data, dtype=f"<u{f['bytes_per_id']}").astype("<u4")
                    block.append((int(e["doc_id"]) if e["known"] else None, start, len(ids), crc32_u32(ids), ids.tobytes() if f["with_ids"] else None))
                    start += len(ids)
                    size += len(data)
                    if size > READ or len(block) > 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*block), kind)], schema=kind)
                        block, size = [], 0
            if block:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*block), kind)], schema=kind)


def read(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every record of the files: doc_id, start (ids before it in all), n_tokens, ids_crc32, ids (or null)."""
    spark = files.sparkSession
    rows, base = [], 0
    for f in sorted(files.collect(), key=lambda r: r["part"]):  # one row a file
        rows.append((f["data"], f["idx"], f["bytes_per_id"], base, with_ids))
        base += f["tokens"]
    x = spark.createDataFrame(rows, "data string, idx string, bytes_per_id int, base long, with_ids boolean")
    return x.repartition(max(1, len(rows))).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def _entries(batches):
    for b in batches:
        for f in b.to_pylist():
            with open_stream(f["idx"]) as s:
                s.read(64)
                e = np.frombuffer(s.read(), dtype=ENTRY)
            yield pa.RecordBatch.from_arrays([pa.array([f["data"]] * len(e)), pa.array(e["offset"].astype(np.int64)),
                                              pa.array([f["bytes_per_id"]] * len(e), pa.int32()),
                                              pa.array(e["doc_id"].astype(np.int64), mask=e["known"] == 0)], names=["data", "offset", "bytes_per_id", "doc_id"])


def _fetch(batches):
    for b in batches:
        at: dict = {}
        out = []
        for r in b.to_pylist():
            if r["data"] not in at:
                if len(at) >= 64:
                    at.pop(next(iter(at))).close()
                at[r["data"]] = open_random(r["data"])
            out.append(np.frombuffer(read_at(at[r["data"]], r["offset"]), dtype=f"<u{r['bytes_per_id']}").astype("<u4").tobytes())
        for f in at.values():
            f.close()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "ids"])


def read_shuffled(files: DataFrame, seed: int, partitions: int | None = None) -> DataFrame:
    """(doc_id, ids) of every record in a random order fixed by the seed, fetched by offset."""
    n = partitions or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = files.select("data", "idx", "bytes_per_id").mapInArrow(_entries, "data string, offset long, bytes_per_id int, doc_id long")
    e = e.withColumn("deal", F.xxhash64("data", "offset", F.lit(seed)))
    return e.repartitionByRange(n, "deal").sortWithinPartitions("deal").drop("deal").mapInArrow(_fetch, "doc_id long, ids binary")
