"""Quality rules: base counts of a text and bands of n-gram perplexity by language.

The model is an interpolated modified Kneser-Ney model of order ``order`` over
the characters (code points, none folded) of each language. Spark counts the
n-grams of all texts, each distinct text of a language once: a task passes on
sums, and continuation counts, discounts and back-off weights are joins and
windows over the n-grams, order by order. The model is stored as sorted arrays of 64-bit n-gram
hashes with their log-probabilities, those of back-off weights beside them.

A model of at most ``MODEL_ENTRIES`` is broadcast. A larger one is broadcast in
parts, one after another: all that is looked up for a symbol has the two symbols before
it in common (or is no longer than two symbols, and in every part), so each part gives
the sum over its own symbols, and distinct texts pass on one number a part. A model of more than
``MOST_PARTS`` parts stays a table: distinct texts are dealt into groups of bounded size, each group
asks for the n-grams that it holds, and gets them back as sorted arrays of its own.

A text's log-perplexity is compared with the exact quartiles of its language,
over the distinct texts that pass the base rules, in steps of 0.0001. It is
rejected beyond the median by more than ``spread`` times the distance of median
and quartile on that side, plus ``slack / sqrt(n_chars)``, as short texts scatter
more. With n texts in a language that distance is averaged with all languages'
(weights n and ``PRIOR``) and widened by ``1 + PRIOR / n``, so a language with few
texts has a wide band and no language is without one.

Nulls: a null text has no words and fails. A null language is a language of its
own. Repeated rows are judged each for itself. Other columns, whatever their
names, are kept by ``keep_good`` and ignored by ``judge``. An empty table gives
an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_counted, materialize, packed, small_batches, unpacked
from .copies import DistinctTexts, bitmap, hits
from .words import mix, windows, word_hashes

ORDER = 5
#: Entries (12 bytes each) up to which a model is broadcast, and characters in a group of texts beyond that.
MODEL_ENTRIES, GROUP_CHARS = 4_000_000, 16_000_000
#: Parts that a model is looked up in, at most, as each goes through all texts; and classes of two symbols, of which a part has some.
MOST_PARTS, CLASSES = 16, 1 << 12
#: Characters that a counting task gets where partitions are smaller, as sums of little text save little.
COUNTED_CHARS = 8_000_000
#: Characters that are worked on at once, and n-grams that a task holds before it passes them on.
PIECE, HELD = 1 << 20, 1_000_000
#: Least distance of median and quartile of the log-perplexity, and texts that the average over languages counts for.
LEAST_WIDTH, PRIOR = 0.01, 20.0
_R, _TAG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: What an entry of order k is: a gram, a context with its back-off weight, and the chance of a symbol never seen.
_CONTEXT, _UNIFORM, _PAIR = 16, 32, 48


# base counts --------------------------------------------------------------------


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "replace")
    n = len(data.split())
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    repeat = 0
    if n >= 6:
        h = windows(word_hashes(data), 5)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, np.flatnonzero(twice), 1)
            np.add.at(cover, np.flatnonzero(twice) + 5, -1)
            repeat = int((np.cumsum(cover)[:-1] > 0).sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


# n-grams of texts ---------------------------------------------------------------


def pieces(texts: list[str], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of about PIECE characters, each part behind the ``order - 1`` before it (spaces before a text), where parts start, and whose they are."""
    held, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), PIECE):
            before = text[at - order + 1 : at] if at else " " * (order - 1)
            held.append(before + text[at : at + PIECE])
            owner.append(i)
            size += len(held[-1])
            if size >= PIECE:
                yield _points(held, owner)
                held, owner, size = [], [], 0
    if held:
        yield _points(held, owner)


def _points(held: list[str], owner: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *map(len, held)])[:-1]
    return np.frombuffer("".join(held).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64), starts, np.array(owner)


def _poly(s: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """The unmixed hash of the ``k`` symbols that end at each place."""
    h = np.zeros(len(end), np.uint64)
    for j in range(k - 1, -1, -1):
        h = h * _R + s[end - j]
    return h


def _tagged(h: np.ndarray, tag: int) -> np.ndarray:
    return mix(h + np.full(1, tag, np.uint64) * _TAG)


def _whole(s: np.ndarray, order: int) -> np.ndarray:
    """The unmixed hash of every gram of ``order`` symbols."""
    h = np.zeros(max(len(s) - order + 1, 0), np.uint64)
    for j in range(order):
        h = h * _R + s[j : len(h) + j]
    return h


def count_grams(texts: DistinctTexts, order: int, tasks: int) -> DataFrame:
    """lang, gram (a string of ``order`` characters) and n, over every distinct text, in at most ``tasks`` tasks."""

    def merged(parts):
        h, n, s = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, first, at = np.unique(h, return_index=True, return_inverse=True)
        return key, np.bincount(at, weights=n).astype(np.int64), s[first]

    def emit(held):
        for lang, parts in held.items():
            _, n, s = merged(parts)
            for at in range(0, len(n), 100_000):
                text = s[at : at + 100_000].astype("<u4").tobytes().decode("utf-32-le", "replace")
                grams = pa.array([text[i : i + order] for i in range(0, len(text), order)], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), grams, pa.array(n[at : at + 100_000])], names=["lang", "gram", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, pending = {}, 0
        for b in batches:
            for lang, texts in by_language(b).items():
                for s, starts, _ in pieces([t for _, t in texts], order):
                    h = _whole(s, order)
                    inside = np.ones(len(h), bool)
                    # grams that reach into the next part end in the characters before it
                    for j in range(1, order):
                        inside[starts[1:] - j] = False
                    at = np.flatnonzero(inside)
                    key, first, n = np.unique(h[at], return_index=True, return_counts=True)
                    place = at[first][:, None] + np.arange(order)
                    held.setdefault(lang, []).append((key, n, s[place].astype(np.uint32)))
                    pending += len(key)
            if pending > HELD:
                held = {lang: [merged(parts)] for lang, parts in held.items()}
                pending = sum(len(parts[0][0]) for parts in held.values())
                if pending > HELD // 2:
                    yield from emit(held)
                    held, pending = {}, 0
        yield from emit(held)

    return texts.each(work, "lang string, gram string, n long", tasks).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def by_language(b: pa.RecordBatch) -> dict[str, list[tuple[int, str]]]:
    """Place and text of the rows with a text, by language."""
    out: dict[str, list[tuple[int, str]]] = {}
    for i, (lang, text) in enumerate(zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True)):
        if text:
            out.setdefault(lang, []).append((i, text))
    return out


# the model ------------------------------------------------------------------------


def kneser_ney(counted: DataFrame, order: int) -> tuple[DataFrame, list[DataFrame]]:
    """The chance u of a symbol never seen, by lang, and for each order a table of lang, gram, p of its last symbol and b of the context of it.

    Each order is written once, so the next one moves only its own grams and the chance that it builds on.
    """
    level = {order: counted}
    for k in range(order - 1, 0, -1):  # how many different symbols stand before a gram of order k
        level[k] = materialize(level[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "grams")
    few = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]
    sizes = None
    for k in range(1, order + 1):
        one = level[k].groupBy("lang").agg(F.lit(k).alias("k"), *few, F.count("*").alias("symbols"))
        sizes = one if sizes is None else sizes.union(one)
    y = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
    sizes = sizes.withColumn("y", y)
    for i, usual in ((1, 0.5), (2, 1.0), (3, 1.5)):
        d = i - (i + 1) * F.col("y") * F.col(f"n{i + 1}") / F.col(f"n{i}")
        sizes = sizes.withColumn(f"d{i}", F.when((F.col(f"n{i}") > 0) & (F.col(f"n{i + 1}") > 0), F.least(F.greatest(d, F.lit(0.05)), F.lit(i - 0.01))).otherwise(usual))
    # a table of known size: where it is small, as languages are few, no gram is moved to its language
    sizes = materialize(sizes.select("lang", "k", "symbols", "d1", "d2", "d3"), "discounts")
    unseen = sizes.where("k = 1").select("lang", (1 / (F.col("symbols") + 1)).alias("u"))
    out: list[DataFrame] = []
    for k in range(1, order + 1):
        rows = level[k]
        if k == 1:  # one context a language: its sums are known
            sums = rows.groupBy("lang").agg(F.sum("n").alias("total"), *few[:2], F.count("*").alias("rows"))
            rows = rows.join(sums, "lang").join(unseen.withColumnRenamed("u", "below"), "lang")
        else:
            below = out[-1].select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
            rows = rows.withColumn("suffix", F.substring("gram", 2, k - 1)).join(below, ["lang", "suffix"]).drop("suffix")
            w = Window.partitionBy("lang", F.substring("gram", 1, k - 1))  # a context has no more rows than the language has symbols
            rows = rows.select("*", F.sum("n").over(w).alias("total"), *(x.over(w).alias(f"n{i}") for i, x in ((1, F.count_if(F.col("n") == 1)), (2, F.count_if(F.col("n") == 2)))), F.count("*").over(w).alias("rows"))
        rows = rows.join(sizes.where(F.col("k") == k).drop("k"), "lang")
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        b = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * (F.col("rows") - F.col("n1") - F.col("n2"))) / F.col("total")
        p = (F.col("n") - discount) / F.col("total") + b * F.col("below")
        found = rows.select("lang", "gram", p.alias("p"), b.alias("b"))
        out.append(found if k == order else materialize(found, "chances"))
    return unseen, out


def hashed(unseen: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """lang, class, key and value: each gram with its log-probability and each context with its log back-off weight, by their hashes.

    The class is that of the two symbols before a gram's last one, -1 if it has fewer. The grams of a context stand together, so it is given once, or again with the same value where a batch begins.
    """

    def of_order(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                langs = b.column("lang").dictionary_encode()
                code = langs.indices.to_numpy()
                p, weight = (np.log(b.column(c).to_numpy()).astype(np.float32) for c in ("p", "b"))
                every = np.frombuffer("".join(b.column("gram").to_pylist()).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
                end = np.arange(b.num_rows) * k + k - 1
                gram, context = _tagged(_poly(every, end, k), k), _tagged(_poly(every, end - 1, k - 1), _CONTEXT + k)
                first = np.ones(b.num_rows, bool)
                first[1:] = (context[1:] != context[:-1]) | (code[1:] != code[:-1])
                lang = pa.array(np.concatenate((code, code[first])))
                kind = _classes(every, end) if k > 2 else np.full(b.num_rows, -1, np.int16)
                kind, key, value = np.concatenate((kind, kind[first])), np.concatenate((gram, context[first])), np.concatenate((p, weight[first]))
                yield pa.RecordBatch.from_arrays([pa.DictionaryArray.from_arrays(lang, langs.dictionary).cast(pa.string()), pa.array(kind), pa.array(key.view(np.int64)), pa.array(value)], names=["lang", "class", "key", "value"])

        return run

    schema = "lang string, class short, key long, value float"
    model = unseen.select("lang", F.lit(-1).cast("short").alias("class"), F.lit(int(np.int64(_uniform().view(np.int64)))).alias("key"), F.log("u").cast("float").alias("value"))
    for k, level in enumerate(levels, 1):
        model = model.union(level.select("lang", "gram", "p", "b").mapInArrow(of_order(k), schema))
    return model


def _classes(s: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The class of the two symbols before each place."""
    return (_tagged(_poly(s, end - 1, 2), _PAIR) % np.uint64(CLASSES)).astype(np.int16)


def _uniform() -> np.uint64:
    return _tagged(np.zeros(1, np.uint64), _UNIFORM)[0]


class SortedHashes:
    """Values by 64-bit hash: sorted keys, and where the keys with given leading bits start."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        bits = max(1, len(keys).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.append(keys[order], ~np.uint64(0))
        self.values = np.append(values[order], np.float32(0))
        self.starts = np.searchsorted(self.keys[:-1], np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none) and whether there is one."""
        at = self.starts[(wanted >> self.shift).astype(np.int64)].astype(np.int64)
        behind = np.flatnonzero(self.keys[at] < wanted)
        while len(behind):
            at[behind] += 1
            behind = behind[self.keys[at[behind]] < wanted[behind]]
        found = self.keys[at] == wanted
        return np.where(found, self.values[at], np.float32(0)), found


def log_probabilities(table: SortedHashes, s: np.ndarray, order: int, end: np.ndarray | None = None) -> np.ndarray:
    """Log-probability of each symbol from place ``order - 1`` on, or of those at ``end``, by back-off through the sorted hashes."""
    whole = _whole(s, order) if end is None else _poly(s, end, order)
    end = np.arange(order - 1, len(s)) if end is None else end
    out, found = table.find(_tagged(whole, order))
    open_ = np.flatnonzero(~found)
    for k in range(order, 0, -1):
        if k < order:
            value, found = table.find(_tagged(_poly(s, end[open_], k), k))
            out[open_] += value
            open_ = open_[~found]
        if not len(open_):
            return out
        value, _ = table.find(_tagged(_poly(s, end[open_] - 1, k - 1), _CONTEXT + k))
        out[open_] += value
    value, _ = table.find(np.full(1, _uniform()))
    out[open_] += value[0]
    return out


def log_perplexities(table: SortedHashes, texts: list[str], order: int, part: int = 0, parts: int = 1) -> np.ndarray:
    """Mean negative log-probability of each (non-empty) text's characters; of a ``part`` of a model what its own symbols add to that."""
    total = np.zeros(len(texts))
    for s, starts, owner in pieces(texts, order):
        if parts == 1:
            p = np.concatenate((np.zeros(order - 1), log_probabilities(table, s, order)))
        else:
            end = np.arange(order - 1, len(s))
            end = end[_classes(s, end) % parts == part]
            p = np.zeros(len(s))
            p[end] = log_probabilities(table, s, order, end)
        for j in range(order - 1):
            p[starts + j] = 0
        np.add.at(total, owner, np.add.reduceat(p, starts))
    return -total / np.maximum([len(t) for t in texts], 1)


# judging ----------------------------------------------------------------------------

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _given(docs: DataFrame, row: Column) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("(null)")) if "lang" in docs.columns else F.lit("(null)")
    text = F.col("text").cast("string")
    return docs.select(row, lang.alias("lang"), text.alias("text"), F.xxhash64(lang, text).alias("text_key"))


def _measured(given: DataFrame, tables: dict[str, SortedHashes] | None, order: int) -> DataFrame:
    """row, lang, text_key, n_chars, the base counts, base_failed and log_perplexity (null without tables)."""
    shared = given.sparkSession.sparkContext.broadcast(tables)
    kept = ["row", "lang", "text_key", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [base_counts(t) for t in b.column("text").to_pylist()]
            failed = [base_failed(c[0], c[4]) for c in counts]
            value = np.full(b.num_rows, np.nan)
            for lang, texts in by_language(b).items() if shared.value is not None else ():
                if lang in shared.value:
                    value[[i for i, _ in texts]] = log_perplexities(shared.value[lang], [t for _, t in texts], order)
            columns = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *columns, pa.array(failed, pa.bool_()), pa.array(value, mask=np.isnan(value))], names=[*kept, *COUNTS, "base_failed", "log_perplexity"])

    given = given.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))
    schema = given.select("row", "lang", "text_key", "n_chars").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return given.mapInArrow(run, schema.add("base_failed", "boolean").add("log_perplexity", "double"))


def _by_parts(texts: DistinctTexts, model: DataFrame, order: int, parts: int) -> DataFrame:
    """lang, text_key, n_chars, the base counts, base_failed and log_perplexity of every distinct text, for a model that is broadcast in parts; without the texts."""
    spark = model.sparkSession
    kept = ["lang", "text_key", "n_chars", *COUNTS, "base_failed"]

    def of(part: int, shared):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column("text").to_pylist()
                value = np.zeros(b.num_rows)
                for lang, found in by_language(b).items():
                    if lang in shared.value:
                        value[[i for i, _ in found]] = log_perplexities(shared.value[lang], [t for _, t in found], order, part, parts)
                columns = [b.column("text_key"), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(value)]
                if part:
                    columns += [pa.nulls(b.num_rows, kind) for kind in (pa.string(), *[pa.int64()] * (1 + len(COUNTS)), pa.bool_())]
                else:
                    counts = [base_counts(t) for t in texts]
                    columns += [b.column("lang"), pa.array([len(t) for t in texts], pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*counts, strict=True)), pa.array([base_failed(c[0], c[4]) for c in counts], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["text_key", "part", "x", "lang", *kept[2:]])

        return work

    schema = f"text_key long, part int, x double, lang string, {', '.join(f'{c} long' for c in kept[2:-1])}, base_failed boolean"
    out = None
    for part in range(parts):
        shared = spark.sparkContext.broadcast(_tables(model.where(f"class < 0 or class % {parts} = {part}")))
        one = materialize(texts.each(of(part, shared), schema), "perplexities")
        shared.destroy()
        out = one if out is None else out.union(one)
    # added in the order of the parts
    value = sum((F.coalesce(F.max(F.when(F.col("part") == part, F.col("x"))), F.lit(0.0)) for part in range(1, parts)), F.max(F.when(F.col("part") == 0, F.col("x"))))
    whole = out.groupBy("text_key").agg(*(F.max(c).alias(c) for c in kept if c != "text_key"), value.alias("log_perplexity"))
    return materialize(whole.select(*kept, "log_perplexity"), "perplexities")


def _tables(model: DataFrame) -> dict[str, SortedHashes]:
    """The sorted hashes of each language."""
    entries = model.select("lang", "key", "value").toArrow()
    lang = entries.column("lang").combine_chunks().dictionary_encode()
    code, key, value = lang.indices.to_numpy(), entries.column("key").to_numpy().view(np.uint64), entries.column("value").to_numpy()
    return {name: SortedHashes(key[code == i], value[code == i]) for i, name in enumerate(lang.dictionary.to_pylist())}


def _by_groups(texts: DistinctTexts, model: DataFrame, order: int, groups: int) -> DataFrame:
    """text_key and log_perplexity of every distinct text, for a model that is too large for a broadcast."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("text"), b.column("text_key")], names=["lang", "text", "text_key"])

    placed = texts.each(keep, "lang string, text string, text_key long").withColumn("group", F.pmod("text_key", F.lit(groups)).cast("int"))
    placed = materialize(placed, "grouped-texts")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group in np.unique(b.column("group").to_numpy()):
                part = b.filter(pa.array(b.column("group").to_numpy() == group))
                for lang, found in by_language(part).items():
                    keys = [np.full(1, _uniform())]
                    for s, _, _ in pieces([t for _, t in found], order):
                        end = np.arange(order - 1, len(s))
                        for k in range(1, order + 1):
                            keys += [np.unique(_tagged(_poly(s, end, k), k)), np.unique(_tagged(_poly(s, end - 1, k - 1), _CONTEXT + k))]
                    key = np.unique(np.concatenate(keys))
                    yield pa.RecordBatch.from_arrays([pa.array([int(group)] * len(key), pa.int32()), pa.array([lang] * len(key)), pa.array(key.view(np.int64))], names=["group", "lang", "key"])

    def answer(texts: pa.Table, entries: pa.Table) -> pa.Table:
        lang, out = np.array(entries.column("lang").to_pylist(), object), []
        key, value = entries.column("key").to_numpy().view(np.uint64), entries.column("value").to_numpy()
        for b in texts.combine_chunks().to_batches():
            for name, found in by_language(b).items():
                table = SortedHashes(key[lang == name], value[lang == name])
                out.append(pa.table({"text_key": b.column("text_key").take(pa.array([i for i, _ in found])), "log_perplexity": log_perplexities(table, [t for _, t in found], order)}))
        return pa.concat_tables(out) if out else pa.table({"text_key": pa.array([], pa.int64()), "log_perplexity": pa.array([], pa.float64())})

    asked = placed.mapInArrow(ask, "group int, lang string, key long").distinct()
    answers = asked.join(model, ["lang", "key"]).select("group", "lang", "key", "value")
    return placed.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(answer, "text_key long, log_perplexity double")


class Model:
    """The model of a table's texts, and how many parts it is looked up in."""

    def __init__(self, docs: DataFrame, row: Column, order: int):
        small_batches(docs.sparkSession)
        self.given, self.order = _given(docs, row), order
        self.texts = DistinctTexts(self.given.where("text <> ''"), ["lang"])
        self.chars = self.given.agg(F.sum(F.char_length("text"))).first()[0] or 0
        counted = materialize(count_grams(self.texts, order, int(self.chars // COUNTED_CHARS) + 1), "grams")
        self.table = materialize(hashed(*kneser_ney(counted, order)), "model")
        entries = self.table.count()
        self.parts = 1 if entries <= MODEL_ENTRIES else -(-entries // MODEL_ENTRIES) if MODEL_ENTRIES and order > 2 else MOST_PARTS + 1

    def by_text(self) -> DataFrame:
        return _by_parts(self.texts, self.table, self.order, self.parts)

    def scored(self) -> DataFrame:
        given = self.given
        if self.parts == 1:
            return materialize(_measured(given, _tables(self.table), self.order), "scores")
        copies = given.where("text <> ''").groupBy("text_key").agg(F.count("*").alias("n"))
        if self.parts <= MOST_PARTS:
            found = materialize(self.by_text().join(copies, "text_key"), "perplexities")
            rows = materialize(given.where("text <> ''").select("row", "text_key"), "rows")
            empty = materialize(_measured(given.where("text is null or text = ''"), None, self.order), "scores")
            return materialize(join_counted(rows, found, ["text_key"]).select(empty.columns).unionByName(empty), "scores")
        found = materialize(_by_groups(self.texts, self.table, self.order, int(self.chars // GROUP_CHARS) + 1), "perplexities")
        found = materialize(found.join(copies, "text_key"), "perplexities")
        counted = materialize(_measured(given, None, self.order).drop("log_perplexity"), "counts")
        rest = counted.where("n_chars = 0").withColumn("log_perplexity", F.lit(None).cast("double"))
        return materialize(join_counted(counted.where("n_chars > 0"), found, ["text_key"]).drop("n").unionByName(rest), "scores")


def scored(docs: DataFrame, row: Column, order: int = ORDER) -> DataFrame:
    """row (as given), lang, text_key, n_chars, base counts, base_failed and log_perplexity of every document."""
    return Model(docs, row, order).scored()


def with_verdict(scores: DataFrame, spread: float, slack: float) -> DataFrame:
    """The scores with ``kept``."""
    ok = scores.where("not base_failed and log_perplexity is not null").groupBy("lang", "text_key").agg(F.first("log_perplexity").alias("x"))
    bins = ok.groupBy("lang", F.round("x", 4).alias("x")).agg(F.count("*").alias("n"))
    q = bins.groupBy("lang").agg(F.sum("n").alias("texts"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias("q"))
    q = materialize(q.select(F.col("lang").alias("of"), "texts", F.col("q")[1].alias("median"), (F.col("q")[1] - F.col("q")[0]).alias("low"), (F.col("q")[2] - F.col("q")[1]).alias("high")), "bands")
    usual = q.agg(*(F.sum(F.col("texts") * F.col(c)) / F.sum("texts") for c in ("low", "high"))).first()
    n = F.col("texts")

    def width(c: str, average: float | None) -> Column:
        mean = (n * F.col(c) + PRIOR * (average or 0.0)) / (n + PRIOR)
        return spread * F.greatest(mean, F.lit(LEAST_WIDTH)) * (1 + PRIOR / n)

    bands = q.select("of", (F.col("median") - width("low", usual[0])).alias("least"), (F.col("median") + width("high", usual[1])).alias("most"))
    room = slack / F.sqrt(F.greatest("n_chars", F.lit(1)))
    inside = (F.col("log_perplexity") >= F.col("least") - room) & (F.col("log_perplexity") <= F.col("most") + room)
    joined = scores.join(bands, scores["lang"] == bands["of"], "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("of", "least", "most")


def judge(docs: DataFrame, spread: float = 4.0, slack: float = 1.5, order: int = ORDER) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and log_perplexity of every document."""
    found = with_verdict(scored(docs, F.struct("doc_id").alias("row"), order), spread, slack)
    return found.select("row.doc_id", *COUNTS, "base_failed", "kept", "log_perplexity")


def keep_good(docs: DataFrame, spread: float = 4.0, slack: float = 1.5, order: int = ORDER) -> DataFrame:
    """The documents that pass, with their columns: scored once, and filtered as they were written.

    Where the model is in parts, texts are judged, and documents are told by two bitmaps of text keys,
    of those that pass and those that don't; only the few that are in both are joined with the keys.
    """
    model = Model(docs, packed(docs), order)
    if not 1 < model.parts <= MOST_PARTS:
        return unpacked(with_verdict(model.scored(), spread, slack).where("kept"), docs.columns)
    judged = materialize(with_verdict(model.by_text(), spread, slack).select("text_key", "kept"), "verdicts")
    context = docs.sparkSession.sparkContext
    good, bad = (context.broadcast(bitmap(judged.where(c).select(F.col("text_key").alias("key")))) for c in ("kept", "not kept"))
    rows = model.given.where("text <> ''").select("row", "text_key")

    def told(unsure: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key = b.column("text_key").to_numpy()
                yield b.filter(pa.array(hits(good.value, key) & (hits(bad.value, key) == unsure)))

        return run

    joined = rows.mapInArrow(told(True), rows.schema).join(judged.where("kept").select("text_key"), "text_key", "left_semi")
    return unpacked(rows.mapInArrow(told(False), rows.schema).select("row").union(joined.select("row")), docs.columns)
