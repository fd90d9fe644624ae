"""Near-duplicate documents by an exact n-gram Jaccard join.

Every text becomes the sorted set of its word-shingle hashes; equal sets are one
class. Two sets with a similarity of t share an element among the first
``n - ceil(t * n) + 1`` of each in any fixed order, so classes meet by those
prefixes; the order puts the corpus's most frequent shingles last, which keeps
shared passages out of the prefixes. Of classes that meet, only those can link
whose sizes are within the ratio t. Each carries a bitmap in which every
shingle toggles one bit, of a power of two bits and not fewer than shingles, so
that long texts don't fill it; a wider one folds to a narrower by XOR. Two
bitmaps that differ in d bits belong to sets that differ in d elements at least,
so bit counts bound the overlap from above. What is left is verified on the
sorted arrays.

Classes that meet are first compared with the one of their group that shares
most of its prefix. Only groups that the resulting components don't already
cover are compared pair by pair: small ones in a join, large ones in tiles of one or two neighbouring size
bands, each tile of a bounded number of classes, so no group is ever held by one
task and no pairs are emitted but those that pass the bit counts.

Nulls: a text that is null or has no words has an empty set and links with
nothing. Repeated rows are linked like any equal texts. A null doc_id takes part
but is never a component's id unless there is no other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import discard, join_counted, materialize, packed, scratch_path, small_batches, unpacked
from .words import distinct, mix, repeated, shingles

BITS = 1024
#: Entries of the table of frequent shingles (12 bytes each) and slots of the filter of documents (a bit each).
FREQUENT, SLOTS = 1 << 17, 1 << 26
#: Classes of a group that are compared in a join; larger groups are cut into tiles of so many at most.
JOINED, TILE = 64, 1024
#: Partners that meet one set in one go when pairs are verified.
PARTNERS = 256


def text_key() -> Column:
    """A hash that tells the texts of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def class_of(s: np.ndarray) -> int:
    """A signed 64-bit name for a sorted set."""
    w = mix(s + np.arange(len(s), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return int(mix(np.array([w.sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64))


def toggled_bits(s: np.ndarray) -> np.ndarray:
    width = max(BITS, 1 << max(len(s) - 1, 0).bit_length())
    on = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(on.astype(np.uint8)).view(np.int64)


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The narrower bitmap of the same set."""
    return np.bitwise_xor.reduce(np.asarray(bits, np.int64).reshape(-1, size), axis=0)


def frequent_shingles(docs: DataFrame, k: int, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and their ranks from 1 (least frequent).

    Tasks pass on only what they see twice or more, so a shingle of more documents
    than tasks can't be missed; which shingles are held only decides the order.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            h, c = repeated(np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], names=["h", "n"])

        for b in batches:
            for text in b.column("text").to_pylist():
                held.append(shingles(text, k))
                n += len(held[-1])
            if n > 3_000_000:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    seen = _texts(docs).select("text").mapInArrow(tally, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    top = seen.orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    rank = np.empty(len(h), np.int32)
    rank[np.lexsort((h, n))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], rank[order]


def prefix(s: np.ndarray, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The elements of a set of which a similar set must hold one of its own prefix."""
    size = len(s) - (percent * len(s) + 99) // 100 + 1
    h, rank = frequent
    if len(h) and len(s):
        at = np.minimum(np.searchsorted(h, s), len(h) - 1)
        r = np.where(h[at] == s, rank[at], 0)
        if r.any():
            return s[np.lexsort((s, r))[:size]]
    return s[:size]


def classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, the text's key, n, class and the prefix (only with the first document of its class in a task)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent_shingles(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            n, names, parts = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, k)
                c = class_of(s)
                n.append(len(s))
                names.append(c)
                parts.append(prefix(s, percent, shared.value).view(np.int64) if len(s) and c not in seen else None)
                seen.add(c)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["doc_id", "key", "n", "class", "prefix"])

    return _texts(docs).withColumn("key", text_key()).mapInArrow(run, "doc_id long, key long, n long, class long, prefix array<long>")


def _slots(rows: DataFrame) -> np.ndarray:
    """A filter of doc_ids: SLOTS bits, whatever the number of rows."""
    words = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot")).groupBy((F.col("slot") / 8).cast("int").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(slot % 8 as int))")).alias("bits")).toArrow()
    out = np.zeros(SLOTS // 8, np.uint8)
    out[words.column("byte").to_numpy()] = words.column("bits").to_numpy()
    return out


def sets_of(docs: DataFrame, wanted: DataFrame, k: int, items: bool) -> DataFrame:
    """Of the wanted documents' classes: class and the sorted set (binary), or class, n and bits (array of longs)."""
    shared = docs.sparkSession.sparkContext.broadcast(_slots(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b.column("slot").to_numpy()
            hit = np.flatnonzero(shared.value[slot >> 3] >> (slot & 7) & 1)
            found = [shingles(t, k) for t in b.column("text").take(pa.array(hit)).to_pylist()]
            names = pa.array([class_of(s) for s in found], pa.int64())
            if items:
                yield pa.RecordBatch.from_arrays([names, pa.array([s.tobytes() for s in found], pa.binary())], names=["class", "items"])
            else:
                yield pa.RecordBatch.from_arrays([names, pa.array([len(s) for s in found], pa.int64()), pa.array([toggled_bits(s) for s in found], pa.list_(pa.int64()))], names=["class", "n", "bits"])

    placed = _texts(docs).withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)))
    return placed.mapInArrow(run, "class long, items binary" if items else "class long, n long, bits array<long>")


def _near(percent: int, a: str, b: str):
    """Sizes and bit counts let the similarity reach ``percent``."""
    size = F.least(F.size(f"{a}_bits"), F.size(f"{b}_bits"))

    def fold(bits):
        xor = lambda i: F.aggregate(F.sequence(i, F.size(bits) - 1, size), F.lit(0).cast("long"), lambda s, j: s.bitwiseXOR(F.get(bits, j)))
        return F.when(F.size(bits) == size, bits).otherwise(F.transform(F.sequence(F.lit(0), size - 1), xor))

    differ = F.aggregate(F.zip_with(fold(F.col(f"{a}_bits")), fold(F.col(f"{b}_bits")), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col(f"{a}_n") + F.col(f"{b}_n")
    # overlap <= (total - differ) / 2, and 100 * overlap >= percent * (total - overlap)
    return (100 + percent) * (total - differ) >= 2 * percent * total


def _sized(percent: int, a: str, b: str):
    return 100 * F.least(f"{a}_n", f"{b}_n") >= percent * F.greatest(f"{a}_n", f"{b}_n")


def verified(pairs: DataFrame, docs: DataFrame, first_docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those that link. Only sets of pairs that pass the bit counts are made and sent.

    The one of a pair with more partners is its hub: its set is sent once for
    every ``PARTNERS`` partners, ahead of them, not once a pair.
    """
    side = lambda x: sets.select(F.col("class").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "bits")))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(_sized(percent, "a", "b"))
    likely = materialize(sized.where(_near(percent, "a", "b")).select("a", "b").distinct(), "likely")
    partners = likely.select(F.col("a").alias("class")).union(likely.select("b")).groupBy("class").count()
    many = lambda x: partners.select(F.col("class").alias(x), F.col("count").alias(f"{x}_partners"))
    at_a = F.col("a_partners") >= F.col("b_partners")
    met = likely.join(many("a"), "a").join(many("b"), "b").select(F.when(at_a, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(at_a, F.col("b")).otherwise(F.col("a")).alias("class"), F.greatest("a_partners", "b_partners").alias("most"))
    met = met.select("hub", F.pmod(F.xxhash64("class"), F.ceil(F.col("most") / PARTNERS)).cast("int").alias("tile"), F.lit(1).alias("role"), "class")
    sent = materialize(met.union(met.select("hub", "tile", F.lit(0), F.col("hub")).distinct()), "sent")
    wanted = partners.select("class").join(first_docs, "class").select("doc_id")
    held = sent.join(sets_of(docs, wanted, k, items=True), "class").repartition("hub", "tile").sortWithinPartitions("hub", "tile", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y = np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for role, items in zip(batch.column("role").to_pylist(), batch.column("items"), strict=True):
                x = np.frombuffer(items.as_buffer(), np.uint64)
                if role == 0:
                    y = x.copy()
                    keep.append(False)
                    continue
                few, most = (x, y) if len(x) < len(y) else (y, x)
                shared = int((most[np.minimum(np.searchsorted(most, few), len(most) - 1)] == few).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("class")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = held.select("hub", "tile", "role", "class", "items").mapInArrow(run, "a long, b long")
    return materialize(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "links")


def _tiled(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of large groups that pass sizes and bit counts: a, b.

    A size band spans a factor of 100 / percent, so partners are in the same or
    the next band; a band is dealt over tiles by the class's name.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    rows = materialize(rows.withColumn("band", band), "banded")
    around = materialize(rows.groupBy("h", "band").agg(F.count("*").alias("members"), F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), "bands")
    sizes = around.select("h", "band", "tiles")
    after = sizes.select("h", (F.col("band") - 1).alias("band"), F.col("tiles").alias("after"))
    before = sizes.select("h", (F.col("band") + 1).alias("band"), F.col("tiles").alias("before"))
    around = materialize(around.join(after, ["h", "band"], "left").join(before, ["h", "band"], "left"), "band-tiles")
    tiles = join_counted(rows, around, ["h", "band"], "members").withColumn("tile", F.pmod(F.hash("class"), "tiles"))
    cell = lambda b1, t1, b2, t2: F.struct(b1.cast("int").alias("b1"), t1.cast("int").alias("t1"), b2.cast("int").alias("b2"), t2.cast("int").alias("t2"))
    band_, tile = F.col("band"), F.col("tile")
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cells = F.concat(
        F.transform(upto(F.col("tiles")), lambda t: cell(band_, F.least(tile, t), band_, F.greatest(tile, t))),
        F.transform(upto(F.col("after")), lambda t: cell(band_, tile, band_ + 1, t)),
        F.transform(upto(F.col("before")), lambda t: cell(band_ - 1, t, band_, tile)),
    )
    dealt = tiles.withColumn("cell", F.explode(cells)).join(sets.select("class", "bits"), "class")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("class")
        name, comp, n = pdf["class"].to_numpy(), pdf["component"].to_numpy(), pdf["n"].to_numpy()
        least = pdf["bits"].map(len).min()
        bits = np.stack([folded(x, least) for x in pdf["bits"]]).view(np.uint64)
        a, b = [], []
        for i in range(len(pdf) - 1):
            other = np.flatnonzero((comp[i + 1 :] != comp[i]) & (100 * np.minimum(n[i], n[i + 1 :]) >= percent * np.maximum(n[i], n[i + 1 :]))) + i + 1
            differ = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64)
            total = n[other] + n[i]
            other = other[(100 + percent) * (total - differ) >= 2 * percent * total]
            a.append(np.minimum(name[other], name[i]))
            b.append(np.maximum(name[other], name[i]))
        return pd.DataFrame({"a": np.concatenate(a) if a else np.empty(0, np.int64), "b": np.concatenate(b) if b else np.empty(0, np.int64)})

    return dealt.select("h", "cell", "class", "component", "n", "bits").groupBy("h", "cell").applyInPandas(compare, "a long, b long")


def _by_shingle(rows: DataFrame, name: str, *sums: Column, where: str) -> DataFrame:
    """``rows`` with sums of all rows that share their ``h``. Sums are partial before the shuffle, and rows of a hot ``h`` stay where they are."""
    groups = rows.groupBy("h").agg(*sums, F.count("*").alias("size")).where(where)
    return join_counted(rows, materialize(groups, name), ["h"], "size")


def meetings(found: DataFrame) -> DataFrame:
    """Who meets whom: the prefixes, kept where two classes share an element."""
    posted = found.where("prefix is not null").select(F.explode("prefix").alias("h"), "class", "n")
    met = _by_shingle(posted, "shared", F.min("class").alias("low"), F.max("class").alias("high"), where="low <> high")
    return met.select("h", "class", "n").distinct()


def links(docs: DataFrame, names: DataFrame, met: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) between classes, enough of them to connect all that any links connect."""
    # the original of a family of near copies shares more of its prefix than any copy, whose own edits come first
    common = met.groupBy("class").agg((F.count("*") / F.first("n")).alias("common"))
    first_docs = names.groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    sets = materialize(sets_of(docs, met.select("class").distinct().join(first_docs, "class").select("doc_id"), k, items=False), "sets")
    rated = materialize(met.join(common, "class"), "rated")
    star = _by_shingle(rated, "leaders", F.max(F.struct("common", "class"))["class"].alias("leader"), where="size > 1")
    star = star.where("class <> leader").select(F.least("leader", "class").alias("a"), F.greatest("leader", "class").alias("b")).distinct()
    stars = materialize(star, "stars")
    near = verified(stars, docs, first_docs, sets, k, percent)
    # what is left: members of one group in different components
    component = connected_components(near)
    placed = materialize(met.join(component.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")), "placed")
    open_ = _by_shingle(placed, "groups", F.min("component").alias("low"), F.max("component").alias("high"), where="low <> high")
    open_ = materialize(open_.select("h", "class", "n", "component", "size"), "open")
    small = open_.where(F.col("size") <= JOINED)
    other = small.select("h", F.col("class").alias("b"), F.col("n").alias("b_n"), F.col("component").alias("b_component"))
    joined = small.select("h", F.col("class").alias("a"), F.col("n").alias("a_n"), "component").join(other, "h").where((F.col("a") < F.col("b")) & (F.col("component") != F.col("b_component")) & _sized(percent, "a", "b")).select("a", "b")
    more = joined.union(_tiled(open_.where(F.col("size") > JOINED), sets, percent)).distinct().join(stars, ["a", "b"], "left_anti")
    return near.union(verified(materialize(more, "pairs"), docs, first_docs, sets, k, percent))


def _placed(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, n, class and key (hash of the text) of every document, and class, first (smallest doc_id) and component of every class with words."""
    spark = docs.sparkSession
    small_batches(spark)
    path = scratch_path(spark, "classes")
    classes(docs, k, percent).write.parquet(path)
    found = spark.read.parquet(path)
    names = materialize(found.select("doc_id", "n", "class", "key"), "names")
    met = materialize(meetings(found), "met")
    # the prefixes, a third of the input or more, aren't read again
    discard(spark, path)
    component = connected_components(links(docs, names, met, k, percent)).withColumnRenamed("node", "class")
    first = names.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("first"))
    return names, first.join(component, "class", "left").withColumn("component", F.coalesce("component", "class"))


def components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of every document."""
    names, placed = _placed(docs, k, percent)
    first = placed.select("class", "first")
    ids = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    by_class = placed.join(ids, "component").select("class", "component_id")
    # most classes have one document: its own id, so only the others are looked up
    shared = by_class.join(first, "class").where(~F.col("component_id").eqNullSafe(F.col("first"))).select("class", "component_id").union(first.join(names.groupBy("class").count().where("count > 1"), "class").join(by_class, "class").select("class", "component_id"))
    out = names.join(shared.distinct(), "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one row of each group left: of the smallest doc_id, null only where there is no other. All columns stay.

    A row is told by doc_id and text, so other texts of a dropped doc_id stay. Of
    rows that are alike in both, any one stays. Rows without words all stay.
    """
    names, placed = _placed(docs, k, percent)
    row = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")
    members = names.where("n > 0").join(placed.select("class", "component"), "class")
    # counted for all groups with partial sums, so that a large group isn't ordered in one task
    groups = members.groupBy("component").agg(F.min(row).alias("stays"), F.count("*").alias("n")).where("n > 1")
    marked = members.join(groups.select("component", "stays"), "component").select("doc_id", "key", (row == F.col("stays")).alias("stays"))
    marked = materialize(marked.groupBy("doc_id", "key").agg(F.max("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1"), "marked")
    # null ids are joined as a flag and a number
    id_ = F.col("doc_id").cast("long")
    given = docs.select(packed(docs), F.coalesce(id_, F.lit(0).cast("long")).alias("_id"), id_.isNull().alias("_null"), text_key().alias("_key"))
    other = lambda rule: marked.where(rule).select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"), F.col("doc_id").isNull().alias("_null"), F.col("key").alias("_key"))
    on = ["_id", "_null", "_key"]
    several = other("stays")
    once = given.join(other("true"), on, "left_anti")
    # rows alike in doc_id and text: each task passes on one, then one of all stays
    of_several = given.join(several, on, "left_semi").dropDuplicates(on)
    return unpacked(once.union(of_several.select(once.columns)), docs.columns)
