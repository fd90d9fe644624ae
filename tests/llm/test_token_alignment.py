"""Alignment of tokenizers against all pairs of whole texts."""

import hashlib
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from manifold_spark.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level(token):
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    return bytes(back[c] for c in token)


def expected(rows):
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    docs = []
    for doc_id, text in rows:
        groups = []
        if text:
            a = a_tok.encode(" " + text, add_special_tokens=False).ids
            b = b_tok.encode(text)
            xs = [byte_level(a_tok.id_to_token(i)) for i in a]
            ys = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(xs) == b"".join(ys) == (" " + text).encode():
                ea, eb = list(accumulate(map(len, xs))), list(accumulate(map(len, ys)))
                cuts = sorted(set(ea) & set(eb))
                groups = [([], []) for _ in cuts]
                for ids, ends, side in ((a, ea, 0), (b, eb, 1)):
                    for i, e in zip(ids, ends, strict=True):
                        groups[bisect_left(cuts, e)][side].append(i)
        docs.append((doc_id, groups))
    count = Counter()
    for _, groups in docs:
        count.update({(x, y) for a, b in groups for x in a for y in b})
    top_a, top_b = defaultdict(int), defaultdict(int)
    for (x, y), n in count.items():
        top_a[x], top_b[y] = max(top_a[x], n), max(top_b[y], n)
    out = []
    for doc_id, groups in docs:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[p] == top_a[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "", sum(count[p] == top_b[p[1]] for p in links)))
    return out


ROWS = [
    (1, "The quick brown fox, and the lazy dog."),
    (2, "The quick brown fox, and the lazy dog."),
    (3, None),
    (4, ""),
    (5, " two  spaces \n and\n\nbreaks\t here "),
    (6, "a line\nanother line\nthe last 123 4567"),
    (7, "special <|endoftext|> and <s> strings </s>"),
    (8, "marks ▁ of spaces"),
    (9, "café naïve 中文字 \U0001f600 あい é  x"),
    (10, "x" * 3000 + " " * 200 + "aab" * 500),
    (None, "the fox"),
    (1, "the fox and the hen"),
    (11, "\nstarts with a break"),
    (12, "nul \x00 and \x07 bytes"),
    (13, "trailing space "),
    (14, "\n"),
    (15, " "),
    (16, "word\n"),
]


@pytest.mark.parametrize("bound", [token_alignment.BROADCAST_PAIRS, 0])
def test_equals_all_pairs(spark, bound):
    df = spark.createDataFrame([(i, t, "n_a", 5) for i, t in ROWS], "doc_id long, text string, a string, n long").repartition(3)
    got = [tuple(r) for r in token_alignment.report(df, A, B, bound).collect()]
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(got, key=key) == sorted(expected(ROWS), key=key)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = [tuple(r) for r in token_alignment.report(df, A, B).collect()]
    assert sorted(got) == sorted(expected(rows))


def test_memory_is_bounded(monkeypatch):
    small = token_alignment.Aligner(A, B, max_pieces=3)
    texts = ["one two three four five", "six seven one two", "x" * 100]
    large = token_alignment.Aligner(A, B)
    shape = lambda out: [(d.digest, d.counts, d.links) for d in out]
    assert shape(small.align(texts)) == shape(large.align(texts)) and len(small.known) == 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.report(df, A, B).collect() == []
