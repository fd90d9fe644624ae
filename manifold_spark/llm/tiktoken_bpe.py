"""Byte-level BPE by the tiktoken library with a local rank file: ids of whole texts, and bytes of ids.

Texts beyond ``PIECE_CHARS`` are cut first, at places where the split pattern
always starts a new match, so that the library never gets one huge string; the
ids are the same as those of the whole. Such places are a single space between
two characters that are no white space, in any script, and, as some scripts
write no spaces, the place between a mark that ends a phrase and a letter or
number. A text with neither is encoded as one.

Nulls: a null text counts as empty (no tokens). Repeated rows are encoded each
for itself. Only doc_id (as a long) and the new columns are returned; other
columns are ignored. Special strings are ordinary text. An empty table gives an
empty one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import small_batches

PIECE_CHARS = 1 << 18
_CUT = re.compile(r"(?<=\S) (?=\S)|(?<=[.,;:!?。、，．！？；：।])(?=[^\W_])")
_loaded: dict = {}


def load(rank_file: str, pattern: str):
    """The encoding of a rank file, once a worker process."""
    if (rank_file, pattern) not in _loaded:
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f))}
        _loaded[rank_file, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[rank_file, pattern]


def cut(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text in pieces of about ``size`` characters; longer where it has no safe place."""
    out, at = [], 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def encode(enc, text: str | None, size: int = PIECE_CHARS) -> list[int]:
    if not text:
        return []
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for piece in cut(text, size) for i in enc.encode_ordinary(piece)]


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(rank_file, pattern)
        for b in batches:
            ids = pa.array([encode(enc, t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and the raw bytes of its ids; bytes that are no valid UTF-8 stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(rank_file, pattern)
        for b in batches:
            data = pa.array([enc.decode_bytes(ids or []) for ids in b.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), data], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(rank_file, pattern)
        for b in batches:
            n, sha, back = [], [], []
            for text in b.column("text").to_pylist():
                ids = encode(enc, text)
                n.append(len(ids))
                sha.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                back.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
