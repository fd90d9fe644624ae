"""Selective correction of an embedding: only points whose neighbourhoods are off may move.

A point is flagged if the effective size of its neighbourhood (by the weights that
the embedding was made with) over its k-star (the largest scale at which distances
in the input still grow as a power of the rank) is out of bounds. Flagged
points then move, with Adam's steps, to straighten log rank against log distance
to a fixed set of neighbours in the embedding. A step needs the flagged points' edges
and the places of their ends: these lie in tiles, which keep their points' places and moments
and hand on only places that other tiles need. Points that aren't flagged keep their places to the last bit.

Points without neighbours aren't flagged. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize, scratch_path
from .lanczos import BUCKETS, Bucketed, _packed, _unpacked
from .neighbours import _matrix, effective_size, grid, k_star, knn, same_length
from .spectral import arrays

#: Edges of a tile of the correction, about.
EDGES = 4_000_000


def mismatch(table: DataFrame, weights: DataFrame, k: int = 200, least_r2: float = 0.95, low: float = 0.5, high: float = 1.0, edges: DataFrame | None = None) -> DataFrame:
    """id, ratio (effective size over k-star) and mismatched; ``weights`` is i, j, w, ``edges`` the neighbours to rank ``k`` where they are known."""
    near = knn(table, k) if edges is None else edges
    top = near.agg(F.max("rank")).first()[0] or 1
    star = k_star(near, grid(min(k, top), min(5, top)), least_r2)
    both = effective_size(weights).join(star, "i")
    ratio = F.when(F.col("k_star") > 0, F.col("k_eff") / F.col("k_star")).otherwise(0.0)
    return both.select(F.col("i").alias("id"), ratio.alias("ratio")).withColumn("mismatched", (F.col("ratio") > high) | (F.col("ratio") < low))


def scale_edges(embedding: DataFrame, k: int = 100, k_min: int = 5, steps: int = 15) -> DataFrame:
    """i, j, x: the neighbours at a grid of ranks, x the logarithm of the rank."""
    ranks = sorted({int(r) + 1 for r in np.logspace(np.log10(k_min), np.log10(k), steps) if int(r) < k})
    return knn(embedding, k).where(F.col("rank").isin(ranks)).select("i", "j", F.log("rank").alias("x"))


def _measured(edges: DataFrame, places: DataFrame) -> DataFrame:
    """The edges with difference, squared distance and, over each i, the moments of x and of y, the log distance."""
    a, b = places.select(F.col("id").alias("i"), F.col("vec").alias("u")), places.select(F.col("id").alias("j"), F.col("vec").alias("v"))
    e = edges.join(a, "i").join(b, "j").withColumn("diff", F.zip_with("u", "v", lambda p, q: p - q))
    e = e.withColumn("d2", F.aggregate("diff", F.lit(0.0), lambda s, c: s + c * c)).withColumn("y", F.log(F.sqrt("d2") + F.lit(1e-30)))
    # a handful of edges each
    w = Window.partitionBy("i")
    e = e.withColumn("x", F.col("x") - F.avg("x").over(w)).withColumn("y", F.col("y") - F.avg("y").over(w))
    return e.withColumns({"xx": F.sum(F.col("x") * F.col("x")).over(w), "xy": F.sum(F.col("x") * F.col("y")).over(w), "yy": F.sum(F.col("y") * F.col("y")).over(w)})


def fit_quality(edges: DataFrame, places: DataFrame) -> DataFrame:
    """i and r2 of its log-log line in ``places``."""
    r2 = F.when(F.first("yy") > 1e-10, F.least(F.lit(1.0), F.try_divide(F.first("xy") * F.first("xy"), F.first("xx") * F.first("yy")))).otherwise(0.0)
    return _measured(edges, places).groupBy("i").agg(F.coalesce(r2, F.lit(0.0)).alias("r2"))


def gradient(edges: DataFrame, places: DataFrame) -> DataFrame:
    """id, g: how the sum of 1 - r2 over the edges' points i changes with each end's place."""
    e = _measured(edges, places).where("yy > 1e-10 and xx > 0 and d2 > 0")
    slope = -2 * F.col("xy") / (F.col("xx") * F.col("yy")) * (F.col("x") - F.col("xy") * F.col("y") / F.col("yy"))
    e = e.withColumn("f", slope / F.col("d2"))
    ends = e.select(F.col("i").alias("id"), F.transform("diff", lambda c: c * F.col("f")).alias("g")).union(e.select("j", F.transform("diff", lambda c: -c * F.col("f"))))
    entries = ends.select("id", F.posexplode("g").alias("p", "x")).groupBy("id", "p").agg(F.sum("x").alias("x"))
    return entries.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda t: t["x"]).alias("g"))


def _tiled(edges: DataFrame, places: DataFrame, moving: DataFrame, tiles: int) -> Bucketed:
    """A row a tile: what its steps read and never change.

    Tiles are strips of points by their first entry, about even. A tile has the edges of its own moving points and of all
    that have one of these as a neighbour, which is what the own points' steps depend on; of
    other tiles' points it gets the places after each step.
    """
    cuts = sorted(set(places.select(F.col("vec")[0].alias("x")).approxQuantile("x", [t / tiles for t in range(1, tiles)], 0.01))) if tiles > 1 else []
    tile = sum((F.when(F.col("vec")[0] >= c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    known = materialize(places.join(moving.withColumn("moves", F.lit(True)), "id", "left").select("id", "vec", F.coalesce("moves", F.lit(False)).alias("moves"), tile.alias("tile")), "places")
    e = edges.join(known.select(F.col("id").alias("i"), "tile"), "i").join(known.select(F.col("id").alias("j"), F.col("tile").alias("other"), "moves"), "j")
    reached = e.where("moves and other <> tile").select("i", F.col("other").alias("tile")).distinct()
    held = materialize(e.select("tile", "i", "j", "x").union(edges.join(reached, "i").select("tile", "i", "j", "x")), "tile-edges")
    ends = held.select("tile", F.col("i").alias("id")).union(held.select("tile", "j")).distinct()
    ends = ends.join(known.withColumnRenamed("tile", "owner"), "id")
    needed = ends.select("tile", F.col("owner").alias("peer"), F.lit(False).alias("sent"), "id", "moves", "vec")
    needed = materialize(needed.union(ends.where("moves and tile <> owner").select(F.col("owner"), "tile", F.lit(True), "id", "moves", "vec")), "tile-ends")

    def pack(key, e: pa.Table, ends: pa.Table) -> pa.Table:
        sent = ends.column("sent").to_numpy(zero_copy_only=False)
        ids, peers, moves = ends.column("id").to_numpy(), ends.column("peer").to_numpy(), ends.column("moves").to_numpy(zero_copy_only=False)
        own, first = np.unique(ids[~sent], return_index=True)
        vec = _matrix(ends.column("vec"))[~sent][first]
        i, j, x = (e.column(c).to_numpy() for c in ("i", "j", "x"))
        order = np.lexsort((j, x, i))
        to = np.lexsort((ids[sent], peers[sent]))
        mine = np.flatnonzero(moves[~sent][first] & (peers[~sent][first] == key[0].as_py()))
        columns = {"ids": own, "a": np.searchsorted(own, i[order]), "b": np.searchsorted(own, j[order]), "x": x[order], "mine": mine, "peers": peers[sent][to].astype(np.int64), "sends": np.searchsorted(own, ids[sent][to]), "start": vec}
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int32())} | {c: _packed([v]) for c, v in columns.items()})

    out = Bucketed(edges.sparkSession, "correction", "tile", min(len(cuts) + 1, BUCKETS))
    schema = "tile int, " + ", ".join(f"{c} binary" for c in ("ids", "a", "b", "x", "mine", "peers", "sends", "start"))
    out.append(out.dealt(held).groupBy("tile").cogroup(out.dealt(needed).groupBy("tile")).applyInArrow(pack, schema))
    return out


def _stepped(tile: dict[str, np.ndarray], p: np.ndarray, m: np.ndarray, v: np.ndarray, steps: range, rate: float) -> None:
    """Adam's steps of a tile's own points, in place: ``p`` are the places of all its points, ``m`` and ``v`` the moments of its own."""
    a, b, x, mine = (tile[c] for c in ("a", "b", "x", "mine"))
    n, dims = p.shape
    over = lambda of, w: np.bincount(of, w, n)
    number = np.maximum(np.bincount(a, minlength=n), 1)
    x = x - (over(a, x) / number)[a]
    xx = over(a, x * x)
    for step in steps:
        diff = p[a] - p[b]
        d2 = (diff * diff).sum(1)
        y = np.log(np.sqrt(d2) + 1e-30)
        y -= (over(a, y) / number)[a]
        xy, yy = over(a, x * y)[a], over(a, y * y)[a]
        some = (yy > 1e-10) & (xx[a] > 0) & (d2 > 0)
        slope = np.divide(-2 * xy * (x - np.divide(xy * y, yy, out=np.zeros(len(y)), where=some)), xx[a] * yy * d2, out=np.zeros(len(y)), where=some)
        diff *= slope[:, None]
        g = np.stack([over(a, diff[:, c]) - over(b, diff[:, c]) for c in range(dims)], axis=1)[mine]
        m *= 0.9
        m += 0.1 * g
        v *= 0.999
        v += 0.001 * g * g
        p[mine] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)


_INDEX = ("ids", "a", "b", "mine", "peers", "sends")


def correct(embedding: DataFrame, flagged: DataFrame, k: int = 100, k_min: int = 5, grid_steps: int = 15, steps: int = 500, rate: float = 1e-3, most: int = EDGES) -> DataFrame:
    """id, vec: the embedding after ``steps`` in which the points of ``flagged`` (id, mismatched) move.

    Points that follow each other's steps lie in tiles of about ``most`` edges. One tile goes all its steps in one task; with
    more, each step is a round, after which tiles hand the places on that others need.
    """
    places = same_length(embedding)
    moving = flagged.where("mismatched").select("id").distinct()
    edges = materialize(scale_edges(places, k, k_min, grid_steps).join(moving.withColumnRenamed("id", "i"), "i", "left_semi"), "scale-edges")
    count = edges.count()
    if not count or steps < 1:
        return places
    spark, places = embedding.sparkSession, materialize(places, "embedding")
    tiles = _tiled(edges, places, moving, -(-count // most))
    alone = tiles.read().count() == 1

    def opened(tile: pa.Table) -> dict[str, np.ndarray]:
        return {c: _unpacked(tile, c, np.int64 if c in _INDEX else np.float64)[0] for c in tile.column_names if c != "tile"}

    def now(tile, state: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of a tile's points and the moments of its own: those of its last step, and the places that others sent."""
        n, own = len(tile["ids"]), len(tile["mine"])
        dims = len(tile["start"]) // n
        if not state.num_rows:
            return tile["start"].reshape(n, dims).copy(), np.zeros((own, dims)), np.zeros((own, dims))
        rows = list(zip(state.column("sent").to_pylist(), _unpacked(state, "ids", np.int64), _unpacked(state, "q"), strict=True))
        p, m, v = np.split(next(q for sent, _, q in rows if not sent).reshape(-1, dims), [n, n + own])
        p = p.copy()
        for sent, ids, q in rows:
            if sent:
                p[np.searchsorted(tile["ids"], ids)] = q.reshape(-1, dims)
        return p, m.copy(), v.copy()

    def after(turn: range):
        def work(key, tile: pa.Table, state: pa.Table) -> pa.Table:
            tile = opened(tile)
            p, m, v = now(tile, state)
            _stepped(tile, p, m, v, turn, rate)
            to = [(peer, tile["sends"][tile["peers"] == peer]) for peer in np.unique(tile["peers"])]
            return pa.table({
                "tile": pa.array([key[0].as_py(), *(int(peer) for peer, _ in to)], pa.int32()), "sent": pa.array([False] + [True] * len(to)),
                "ids": _packed([np.empty(0, np.int64), *(tile["ids"][at] for _, at in to)]), "q": _packed([np.vstack([p, m, v]), *(p[at] for _, at in to)]),
            })

        return work

    def places_of(tile: pa.Table, state: pa.Table) -> pa.Table:
        tile = opened(tile)
        p, _, _ = now(tile, state)
        return pa.table({"id": tile["ids"][tile["mine"]], "moved": arrays(p[tile["mine"]])})

    schema, path = "tile int, sent boolean, ids binary, q binary", None
    state = spark.createDataFrame([], schema)
    for turn in [range(1, steps + 1)] if alone else [range(step, step + 1) for step in range(1, steps + 1)]:
        last, path = path, scratch_path(spark, "steps")
        tiles.read().groupBy("tile").cogroup(state.groupBy("tile")).applyInArrow(after(turn), schema).write.parquet(path)
        state = spark.read.schema(schema).parquet(path)
        if last:
            discard(spark, last)
    moved = materialize(tiles.read().groupBy("tile").cogroup(state.groupBy("tile")).applyInArrow(places_of, "id long, moved array<double>"), "moved")
    tiles.drop()
    discard(spark, path)
    return places.join(moved, "id", "left").select("id", F.coalesce("moved", "vec").alias("vec"))
