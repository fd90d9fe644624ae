"""Token ids as length-delimited binary records with a separate offset index.

Data file: one record a document, ``u64 length | u32 check(length) | payload |
u32 check(payload)``; payload: ``u8 has_id | i64 doc_id | u8 id width | ids``.
Index file: one entry a record, ``u64 byte offset | u64 tokens before it in this
file | u64 tokens``. Numbers are little-endian; a check is the CRC-32 of the
bytes, rotated right by 15 bits plus a constant, so that a record that holds
records doesn't check itself. One pair of files is written a partition, and a
manifest table lists the pairs in document order.

A task writes under a name of its own attempt and only the manifest makes files
count, so a repeated or speculative task does no harm. Files are opened by
``pyarrow.fs``, so the folder may be in any store it knows.

Nulls: a null text has no ids but the end id; a null doc_id sorts first. Rows
with the same doc_id stand in order of their text. An empty table gives no file.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path, small_batches
from .pieces import encoder

_FRAME, _INDEX, _HEAD = "<QI", "<QQQ", "<?qB"
MANIFEST = "part int, data_file string, index_file string, n_docs long, n_tokens long"
DOCUMENTS = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return size + struct.pack("<I", masked_crc(size)) + payload + struct.pack("<I", masked_crc(payload))


def unframe(f) -> bytes | None:
    """The payload of the record at the stream's place, or None at its end."""
    head = f.read(struct.calcsize(_FRAME))
    if not head:
        return None
    size, check = struct.unpack(_FRAME, head)
    if masked_crc(head[:8]) != check:
        raise ValueError("the length of a record does not match its checksum")
    payload, tail = f.read(size), f.read(4)
    if len(payload) < size or struct.unpack("<I", tail)[0] != masked_crc(payload):
        raise ValueError("a record does not match its checksum")
    return payload


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    has_id, doc_id, width = struct.unpack_from(_HEAD, payload)
    return doc_id if has_id else None, np.frombuffer(payload, dtype=f"<u{width}", offset=struct.calcsize(_HEAD))


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode every text, append ``end_id`` and write records in ascending doc_id order; returns the manifest."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or scratch_path(spark, "token-records")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = _store(folder)
        name = f"{root}/part-{part:06d}-{uuid.uuid4().hex}"
        enc, data, index, at, start, n = None, None, None, 0, 0, 0
        for batch in batches:
            if enc is None:
                enc = encoder(tokenizer)
                end = np.array([end_id], dtype=enc.dtype).tobytes()
                store.create_dir(root, recursive=True)
                data, index = store.open_output_stream(name + ".rec"), store.open_output_stream(name + ".idx")
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text").to_pylist()), strict=True):
                width = enc.dtype.itemsize
                record = frame(struct.pack(_HEAD, doc_id is not None, doc_id or 0, width) + ids + end)
                tokens = len(ids) // width + 1
                data.write(record)
                index.write(struct.pack(_INDEX, at, start, tokens))
                at, start, n = at + len(record), start + tokens, n + 1
        if n:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "data_file": f"{folder}/{name[len(root) + 1 :]}.rec", "index_file": f"{folder}/{name[len(root) + 1 :]}.idx", "n_docs": n, "n_tokens": start}], schema=_SCHEMA)

    _SCHEMA = pa.schema([("part", pa.int32()), ("data_file", pa.string()), ("index_file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    placed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(placed.mapInArrow(write, MANIFEST), "token-manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Read every record back: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    spread = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 4))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["data_file"])
                _, index_path = _store(row["index_file"])
                with store.open_input_stream(index_path) as f:
                    entries = np.frombuffer(f.read(), dtype="<u8").reshape(-1, 3)
                out = []
                with store.open_input_stream(path, buffer_size=1 << 20) as f:
                    for _, start, tokens in entries.tolist():
                        doc_id, ids = unpack(unframe(f))
                        if len(ids) != tokens:
                            raise ValueError(f"{row['data_file']}: the index and the records differ")
                        out.append({"part": row["part"], "doc_id": doc_id, "local_start": start, "n_tokens": tokens, "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})
                        if len(out) == 5000:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    # one row a file: the running sum over parts is as small as the list of files
    base = manifest.select("part", (F.sum("n_tokens").over(Window.orderBy("part")) - F.col("n_tokens")).alias("base"))
    rows = spread.mapInArrow(read, DOCUMENTS)
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """Records in a random order that depends on the seed alone, read by their index entries: epoch_rank, doc_id, ids.

    Only index entries are shuffled. Each task seeks to the records of its share
    of the epoch, so the order of the rows in a partition is the order of training.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["index_file"])
                with store.open_input_stream(path) as f:
                    offsets = np.frombuffer(f.read(), dtype="<u8").reshape(-1, 3)[:, 0].astype("int64")
                yield pa.RecordBatch.from_arrays([pa.array([row["data_file"]] * len(offsets)), pa.array(offsets)], names=["data_file", "offset"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        schema = pa.schema([("epoch_rank", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["data_file"] not in opened:
                    if len(opened) == 64:
                        opened.pop(next(iter(opened))).close()
                    store, path = _store(row["data_file"])
                    opened[row["data_file"]] = store.open_input_file(path)
                f = opened[row["data_file"]]
                f.seek(row["offset"])
                doc_id, ids = unpack(unframe(f))
                out.append({"epoch_rank": row["epoch_rank"], "doc_id": doc_id, "ids": ids.astype("int32").tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    index = manifest.repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism)).mapInArrow(entries, "data_file string, offset long")
    order = F.xxhash64(F.lit(seed), F.regexp_extract("data_file", r"part-(\d+)", 1), "offset")
    return index.withColumn("epoch_rank", order).repartitionByRange("epoch_rank").sortWithinPartitions("epoch_rank").mapInArrow(fetch, "epoch_rank long, doc_id long, ids array<int>")


def token_records(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the records of all documents and report each from the files."""
    return read_documents(write_records(docs, tokenizer, end_id))
