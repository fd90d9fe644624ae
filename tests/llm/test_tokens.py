import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from manifold_spark.llm import tiktoken_bpe, token_records
from manifold_spark.llm.pieces import PieceEncoder
from manifold_spark.llm.token_counts import count_tokens

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "  ", "\n", "a\n", "\na", "a  b", "a \n b", "don't you'll 's  's", "x<|endoftext|>y", "é à ² ½ 中文 a", "a\tb", "1234 56,7", "\n a", "ab" * 4000, "the " * 3000, "\x00 a\x85b　c", "🙂 ok"]


def _texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(" \nabZ'sé.1,-½\t") for _ in range(rng.randint(1, 25))) for _ in range(300)]


def _docs(spark):
    texts = _texts()
    return texts, spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, start string").repartition(3)


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_pieces_equal_whole_texts(whole):
    e = PieceEncoder(JSON, max_pieces=5)
    for _ in range(2):
        assert [np.frombuffer(b, e.dtype).tolist() for b in e.encode(_texts())] == [whole(t) for t in _texts()]
        assert e.count(_texts(), {"the": 1}) == [len(whole(t)) for t in _texts()]


def test_records_round_trip(spark, whole):
    texts, docs = _docs(spark)
    manifest = token_records.write_records(docs, JSON, 2)
    got = token_records.read_documents(manifest).orderBy("doc_id").collect()
    start = 0
    for row, text in zip(got, texts, strict=True):
        ids = [*whole(text), 2]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shuffled = token_records.read_shuffled(manifest, 7).collect()
    assert sorted(r.doc_id for r in shuffled) == list(range(len(texts)))
    assert [r.doc_id for r in shuffled] != list(range(len(texts)))
    assert all(r.ids == [*whole(texts[r.doc_id]), 2] for r in shuffled)


def test_records_null_ids_ties_and_empty(spark):
    docs = spark.createDataFrame([(None, "b"), (1, "b"), (1, "a"), (1, "a")], "doc_id long, text string")
    got = token_records.token_records(spark, docs, JSON, 2).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 1] and [r.start for r in got] == [0, 2, 4, 6]
    assert token_records.token_records(spark, docs.limit(0), JSON, 2).count() == 0


def test_damaged_record_is_found(tmp_path):
    data = token_records.frame(b"abc")
    assert token_records.unframe(__import__("io").BytesIO(data)) == b"abc"
    with pytest.raises(ValueError):
        token_records.unframe(__import__("io").BytesIO(data[:13] + b"x" + data[14:]))


def test_tiktoken_round_trip(spark):
    import tiktoken

    texts, docs = _docs(spark)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in tiktoken_bpe.round_trip(docs, RANKS, P.PATTERN).collect():
        text = texts[r.doc_id] or ""
        ids = enc.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = tiktoken_bpe.decode_documents(tiktoken_bpe.encode_documents(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {r.doc_id: bytes(r.bytes) for r in back.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    for text in filter(None, texts):
        assert tiktoken_bpe.encode(enc, text, 50) == enc.encode_ordinary(text)
    assert tiktoken_bpe.round_trip(docs.limit(0), RANKS, P.PATTERN).count() == 0


@pytest.mark.parametrize("table_size", [0, 3, 1000])
def test_counts(spark, whole, table_size):
    texts, docs = _docs(spark)
    for r in count_tokens(docs, JSON, limit=5, table_size=table_size).collect():
        n = len(whole(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 5)
    assert count_tokens(docs.limit(0), JSON).count() == 0
