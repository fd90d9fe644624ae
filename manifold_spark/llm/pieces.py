"""Whole-text token ids from the tokenizers library, looked up by piece.

A byte-level BPE splits a text by a fixed pattern before it merges. A space that
is followed by a non-space always starts a match of that pattern, and a single
line break is always a match of its own, so a text without doubled white space
falls apart into pieces (``the``, ``house,``, ``\\nThe``) whose ids don't depend
on their neighbours. Pieces repeat, so each is encoded by the library once per
worker. A text with doubled white space, a special token or a character whose
Unicode class may differ between libraries is encoded whole by the library, and
so is every text where the file has another normalizer, pre-tokenizer or model
than that of byte-level BPE.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Anything else than these has no piece boundaries that are known for certain.
_UNSURE = re.compile("[^\n -~¡-±´-¸º»¿-ɏ]")

#: The split of byte-level BPE, for texts of the characters above.
_MATCH = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Byte-level vocabularies write a byte without a printable form of its own as the next free character from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_VISIBLE = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def split_pieces(text: str, specials: tuple[str, ...]) -> list[str] | None:
    """The pieces of a text, or None where it has to be encoded whole.

    Every piece stands for itself with one space before it, or begins with a
    line break. The text is taken to follow a line break, whose token is no part
    of the text.
    """
    if "  " in text or " \n" in text or "\n\n" in text or _UNSURE.search(text):
        return None
    for s in specials:
        if s in text:
            return None
    return ("\n" + text).replace("\n", " \n").split(" ")[1:]


def is_byte_level(spec: dict) -> bool:
    """Whether the file splits and merges as the pieces here take for granted."""
    split, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    return spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and model.get("type") == "BPE" and plain


class _Known(dict):
    """Values by piece; what no longer fits is looked up in ``extra``, which lasts for one batch."""

    extra: dict

    def __missing__(self, piece):
        return self.extra[piece]


#: Longer pieces are encoded each time.
MEMORY_CHARS = 48


class PieceEncoder:
    """Ids of texts by one tokenizer file, with a bounded memory of pieces: ``max_pieces`` of ``MEMORY_CHARS`` at most."""

    def __init__(self, path: str, max_pieces: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.splits = is_byte_level(json.load(f))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.max_pieces = max_pieces
        self.ids = _Known()
        self.lengths = _Known()
        self.line_break = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece: its matches of the pattern, each merged by the library's model."""
        tokenize, matches, packed, out = self.tokenizer.model.tokenize, _MATCH.findall, self.packed, []
        for p in pieces:
            p = p if p[:1] == "\n" else " " + p
            ids = []
            for m in [p] if p[1:].isalpha() and p[0] == " " else matches(p):
                visible = m.replace(" ", "\u0120").replace("\n", "\u010a") if m.isascii() else m.encode().decode("latin-1").translate(_VISIBLE)
                ids += [packed[t.id] for t in tokenize(visible)]
            out.append(b"".join(ids))
        return out

    def _learn(self, split: list[list[str] | None], known: _Known, value) -> None:
        """Have ``known`` answer for every piece of the batch."""
        missing = list(set().union(*(p for p in split if p)) - known.keys())
        found = dict(zip(missing, map(value, self.encode_pieces(missing)), strict=True))
        if len(known) < self.max_pieces:
            known.update((p, v) for p, v in found.items() if len(p) <= MEMORY_CHARS)
            known.extra = {p: v for p, v in found.items() if len(p) > MEMORY_CHARS}
        else:
            known.extra = found

    def _split(self, texts: list[str | None]) -> list[list[str] | None]:
        return [(split_pieces(t, self.specials) if self.splits else None) if t else [] for t in texts]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text; a null text counts as empty."""
        split = self._split(texts)
        self._learn(split, self.ids, bytes)
        skip, get = len(self.line_break), self.ids.__getitem__
        return [self._whole(t) if p is None else b"".join(map(get, p))[skip:] for t, p in zip(texts, split, strict=True)]

    def count(self, texts: list[str | None], frequent: dict[str, int]) -> list[int]:
        """Token counts: first by the frequent pieces, then by this worker's own, then by the library."""
        split = self._split(texts)
        width, known = self.dtype.itemsize, self.lengths
        if not known:
            known.update(frequent)
        self._learn(split, known, lambda ids: len(ids) // width)
        skip, get = len(self.line_break) // width, known.__getitem__
        return [len(self._whole(t)) // width if p is None else sum(map(get, p)) - skip if p else 0 for t, p in zip(texts, split, strict=True)]


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, key: int = 0) -> PieceEncoder:
    """The encoder of this worker process; ``key`` tells tables of frequent pieces apart."""
    if (path, key) not in _encoders:
        _encoders.clear()
        _encoders[path, key] = PieceEncoder(path)
    return _encoders[path, key]
