"""Block Lanczos on an edge table without moving the edges or the basis.

Ids are dealt over parts; of each part a block of directions is one row, an array. The
edges are written once by tiles, (parts of i) x (parts of j), and the basis grows by one
block a round; both are bucketed tables, so that Spark joins what a round brings to them
without shuffling them again. A round shuffles copies of one block, as many as a side has tiles,
and the tiles' sums, and writes the product and the new block; whatever is older is read where it lies.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize, scratch_path
from .sampling import uniform

#: Ids of a part, about.
PART = 1024
#: Edges of a tile and numbers of a block in a tile, about, and the edges of a row of a tile.
EDGES, NUMBERS, CHUNK = 4_000_000, 8_000_000, 1 << 18
#: Buckets of a table, at most.
BUCKETS = 24


class Bucketed:
    """A table in the shared folder whose rows lie by ``key``: groups of the key, and joins with other tables that lie so, are not shuffled."""

    def __init__(self, spark, name: str, key: str, buckets: int):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.path, self.name = scratch_path(spark, name), f"manifold_{uuid.uuid4().hex}"

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, self.key)

    def append(self, rows: DataFrame) -> None:
        """Add rows; those of one key should be in one partition, as :meth:`dealt` or a join with such a table leaves them."""
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, self.key).option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        discard(self.spark, self.path)


def _packed(rows: list[np.ndarray]) -> pa.Array:
    """Arrays as bytes, which Spark hands on without looking at each number."""
    return pa.array([np.ascontiguousarray(r).tobytes() for r in rows], pa.binary())


def _unpacked(table: pa.Table, column: str, kind: type = np.float64) -> list[np.ndarray]:
    return [np.frombuffer(b, kind) for b in table.column(column).to_pylist()]


def _lists(table: pa.Table, column: str) -> list[np.ndarray]:
    return [a.values.to_numpy(zero_copy_only=False) for a in table.column(column)]


_STATE = "part int, turn int, q binary"


class Krylov:
    """The edges of a symmetric matrix in tiles, and a basis of directions on its nodes."""

    def __init__(self, edges: DataFrame, nodes: DataFrame, n: int, width: int, seed: int):
        spark = self.spark = edges.sparkSession
        parts = self.parts = -(-n // PART)
        node = nodes.select("id", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
        start = F.array(*(uniform("id", seed + c) - 0.5 for c in range(width)))
        of = node.withColumn("x", start).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("e"))
        of = materialize(of.select("part", F.transform("e", lambda e: e["id"]).alias("ids"), F.flatten(F.transform("e", lambda e: e["x"])).alias("q")), "nodes")
        self.ids = of.select("part", "ids")
        sizes = self.sizes = np.zeros(parts, np.int64)
        for r in of.select("part", F.size("ids").alias("n")).collect():
            sizes[r["part"]] = r["n"]
        count = edges.count()
        sides = self.sides = min(parts, max(2, -(-n * width // NUMBERS), int(np.ceil(np.sqrt(count / EDGES)))))
        # where a part begins among those of its tile
        self.begin = np.zeros(parts, np.int64)
        for s in range(sides):
            self.begin[s::sides] = np.cumsum(sizes[s::sides]) - sizes[s::sides]
        begin = F.array(*(F.lit(int(b)) for b in self.begin))
        place = self.ids.select("part", F.posexplode("ids").alias("at", "id")).select("id", F.pmod("part", F.lit(sides)).alias("side"), (F.get(begin, F.col("part")) + F.col("at")).cast("int").alias("at"))
        place = materialize(place, "places")
        e = edges.join(place.select(F.col("id").alias("i"), F.col("side").alias("a"), F.col("at").alias("r")), "i").join(place.select(F.col("id").alias("j"), F.col("side").alias("b"), F.col("at").alias("c")), "j")
        e = e.select((F.col("a") * sides + F.col("b")).cast("int").alias("tile"), "r", "c", F.col("w").cast("double").alias("w"))

        def pack(t: pa.Table) -> pa.Table:
            r, c, w = (t.column(x).to_numpy() for x in ("r", "c", "w"))
            order = np.argsort(r, kind="stable")
            cuts = [order[at : at + CHUNK] for at in range(0, len(order), CHUNK)]
            return pa.table({"tile": pa.array(np.full(len(cuts), t.column("tile")[0].as_py(), np.int32)), "r": _packed([r[o] for o in cuts]), "c": _packed([c[o] for o in cuts]), "w": _packed([w[o] for o in cuts])})

        self.tiles = Bucketed(spark, "tiles", "tile", min(sides * sides, BUCKETS))
        self.tiles.append(self.tiles.dealt(e).groupBy("tile").applyInArrow(pack, "tile int, r binary, c binary, w binary"))
        self.basis = Bucketed(spark, "basis", "part", min(parts, BUCKETS))
        self.turns = 0
        self.start = of.select("part", F.lit(0).alias("turn"), "q")

    def _new(self, name: str) -> Bucketed:
        return Bucketed(self.spark, name, "part", self.basis.buckets)

    def begin_with(self, turn_of, width: int) -> int:
        """The first block: the start's directions made orthonormal by what ``turn_of`` makes of their Gram matrix; their number."""
        sizes, rows = self.sizes, self.start

        def gram(t: pa.Table) -> pa.Table:
            q = _lists(t, "q")[0].reshape(sizes[t.column("part")[0].as_py()], -1)
            return _entries(q.T @ q)

        found = rows.groupBy("part").applyInArrow(gram, "p int, s double")
        turn = turn_of(_total(found, width * width).reshape(width, width))

        def make(t: pa.Table) -> pa.Table:
            part = t.column("part")[0].as_py()
            q = _lists(t, "q")[0].reshape(sizes[part], -1)
            return _row(part, 0, q @ turn)

        self.basis.append(self.basis.dealt(rows).groupBy("part").applyInArrow(make, _STATE))
        self.turns = 1
        return turn.shape[1]

    def multiply(self, last: int) -> Bucketed:
        """The matrix times the last block, of ``last`` directions; written."""
        sides, sizes, begin, parts = self.sides, self.sizes, self.begin, self.parts
        copies = F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("a")
        block = self.basis.read().where(F.col("turn") == self.turns - 1).select("part", "q", copies)
        block = block.select((F.col("a") * sides + F.pmod("part", F.lit(sides))).cast("int").alias("tile"), "part", "q")

        def work(key, edges: pa.Table, block: pa.Table) -> pa.Table:
            a, b = divmod(key[0].as_py(), sides)
            x = np.zeros((last, int(sizes[b::sides].sum())))
            for part, q in zip(block.column("part").to_pylist(), _unpacked(block, "q"), strict=True):
                x[:, begin[part] : begin[part] + sizes[part]] = q.reshape(sizes[part], last).T
            own = int(sizes[a::sides].sum())
            y = np.zeros((own, last))
            for r, c, w in zip(_unpacked(edges, "r", np.int32), _unpacked(edges, "c", np.int32), _unpacked(edges, "w"), strict=True):
                low, high = int(r[0]), int(r[-1]) + 1
                for k in range(last):
                    y[low:high, k] += np.bincount(r - low, w * x[k, c], high - low)
            mine = [p for p in range(a, parts, sides) if sizes[p]]
            return pa.table({"part": pa.array(mine, pa.int32()), "q": _packed([y[begin[p] : begin[p] + sizes[p]] for p in mine])})

        sums = self.tiles.read().groupBy("tile").cogroup(block.groupBy("tile")).applyInArrow(work, "part int, q binary")

        def add(t: pa.Table) -> pa.Table:
            return pa.table({"part": t.column("part").slice(0, 1), "turn": pa.array([0], pa.int32()), "q": _packed([np.sum(_unpacked(t, "q"), axis=0)])})

        out = self._new("product")
        out.append(out.dealt(sums).groupBy("part").applyInArrow(add, _STATE))
        return out

    def _with_basis(self, product: Bucketed, last: int, of, schema: str, since: int = 0) -> DataFrame:
        """``of`` the part, its rows of the basis from block ``since`` on, and those of the product."""
        sizes = self.sizes

        def work(key, basis: pa.Table, product: pa.Table) -> pa.Table:
            part = key[0].as_py()
            y = _unpacked(product, "q")[0].reshape(sizes[part], last)
            return of(part, _joined(basis, sizes[part]), y)

        return self.basis.read().where(F.col("turn") >= since).groupBy("part").cogroup(product.read().groupBy("part")).applyInArrow(work, schema)

    def inner(self, product: Bucketed, size: int, last: int, before: int) -> np.ndarray:
        """The basis times the product, size by last: a symmetric matrix joins a block with itself and the one before, of ``before`` directions, only."""
        near = before + last
        found = self._with_basis(product, last, lambda part, q, y: _entries(q.T @ y), "p int, s double", self.turns - 2)
        out = np.zeros((size, last))
        out[size - near :] = _total(found, near * last).reshape(near, last)
        return out

    def inner_again(self, product: Bucketed, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The basis times what is left of the product after ``h`` of the basis is taken off, and that rest's Gram matrix."""
        size, last = h.shape

        def of(part, q, y):
            y = y - q @ h
            return _entries(np.vstack([q.T @ y, y.T @ y]))

        sums = _total(self._with_basis(product, last, of, "p int, s double"), (size + last) * last).reshape(size + last, last)
        return sums[:size], sums[size:]

    def grow(self, product: Bucketed, h: np.ndarray, again: np.ndarray, turn: np.ndarray) -> None:
        """The rest of the product, twice freed of the basis and turned, becomes the next block."""
        turns, last = self.turns, h.shape[1]
        self.basis.append(self._with_basis(product, last, lambda part, q, y: _row(part, turns, ((y - q @ h) - q @ again) @ turn), _STATE))
        self.turns += 1

    def vectors(self, chosen: np.ndarray) -> DataFrame:
        """id, x: the basis times ``chosen``."""
        sizes = self.sizes

        def work(key, basis: pa.Table, ids: pa.Table) -> pa.Table:
            x = _joined(basis, sizes[key[0].as_py()]) @ chosen
            ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            return pa.table({"id": pa.array(_lists(ids, "ids")[0], pa.int64()), "x": pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))})

        return self.basis.read().groupBy("part").cogroup(self.ids.groupBy("part")).applyInArrow(work, "id long, x array<double>")

    def drop(self) -> None:
        self.tiles.drop()
        self.basis.drop()


def _joined(basis: pa.Table, rows: int) -> np.ndarray:
    turns = basis.column("turn").to_numpy()
    blocks = _unpacked(basis, "q")
    return np.hstack([blocks[i].reshape(rows, -1) for i in np.argsort(turns)])


def _row(part: int, turn: int, q: np.ndarray) -> pa.Table:
    return pa.table({"part": pa.array([part], pa.int32()), "turn": pa.array([turn], pa.int32()), "q": _packed([q])})


def _entries(m: np.ndarray) -> pa.Table:
    return pa.table({"p": pa.array(np.arange(m.size, dtype=np.int32)), "s": pa.array(m.ravel())})


def _total(found: DataFrame, size: int) -> np.ndarray:
    rows = found.groupBy("p").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(size)
    out[rows.column("p").to_numpy()] = rows.column("s").to_numpy()
    return out
