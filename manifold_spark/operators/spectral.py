"""Spectra of graphs that stay edge tables: i, j, w.

The largest eigenvalues of a symmetric matrix come from block Lanczos (its tables are
those of :mod:`.lanczos`): only small Gram matrices, summed by tasks, reach the driver,
where they are factorised. Nothing of the size of the points is ever held in one place.
Each round writes its new directions, so plans stay short and lost executors cost little.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .lanczos import Krylov
from .neighbours import distance, dot, kernel, knn


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("i").agg(F.sum("w").alias("degree"))


def symmetric_operator(edges: DataFrame, alpha: float = 1.0) -> DataFrame:
    """The symmetric diffusion operator: weights over both degrees to the power ``alpha``, then over the square roots of the new degrees."""
    once = _over_degrees(edges, alpha) if alpha else edges
    return _over_degrees(once, 0.5)


def _over_degrees(edges: DataFrame, power: float) -> DataFrame:
    d = degrees(edges)
    a, b = d.select("i", F.pow("degree", F.lit(power)).alias("di")), d.select(F.col("i").alias("j"), F.pow("degree", F.lit(power)).alias("dj"))
    return edges.join(a, "i").join(b, "j").select("i", "j", F.coalesce(F.try_divide(F.col("w"), F.col("di") * F.col("dj")), F.lit(0.0)).alias("w"))


def gaussian_edges(table: DataFrame, k: int = 15) -> DataFrame:
    """The adaptive neighbour kernel with a diagonal of ones."""
    e = kernel(knn(table, k)).select("i", "j", "w")
    return e.where("i <> j").union(table.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("w")))


def decay_edges(table: DataFrame, k: int = 5, decay: float = 40.0, reach: int | None = None, least: float = 1e-4) -> DataFrame:
    """The alpha-decay kernel exp(-(d / eps) ** decay), eps a point's distance to its ``k``-th neighbour, made symmetric by the mean, diagonal one.

    Neighbours are looked up to rank ``reach`` (5 k), weights under ``least`` are dropped.
    """
    e = materialize(knn(table, reach or 5 * k), "neighbours")
    eps = e.where(F.col("rank") == k).select("i", F.greatest("d", F.lit(1e-12)).alias("eps"))
    w = e.join(eps, "i").select("i", "j", F.exp(-F.pow(F.col("d") / F.col("eps"), F.lit(float(decay)))).alias("w")).where(F.col("w") >= least)
    both = w.union(w.select("j", "i", "w")).groupBy("i", "j").agg((F.sum("w") / 2).alias("w"))
    return both.union(table.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("w")))


def times(edges: DataFrame, block: DataFrame, size: int) -> DataFrame:
    """The product of the matrix with a block: id, x (an array of ``size``)."""
    rows = edges.join(block.select(F.col("id").alias("j"), "x"), "j")
    return rows.groupBy(F.col("i").alias("id")).agg(F.array(*(F.sum(F.col("w") * F.get("x", F.lit(c))) for c in range(size))).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def arrays(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(np.ascontiguousarray(rows, dtype=float).ravel()))


def summed(table: DataFrame, columns: list[str], size: int, of) -> np.ndarray:
    """The sum over all rows of ``of``, which makes ``size`` numbers of the matrices of some array columns of a batch.

    Tasks sum their own rows; Spark adds the sums by place, and ``size`` numbers reach the driver.
    """

    def sums(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += np.asarray(of(*(matrix(b.column(c)) for c in columns))).ravel()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["p", "s"])

    found = table.select(*columns).mapInArrow(sums, "p int, s double").groupBy("p").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(size)
    out[found.column("p").to_numpy()] = found.column("s").to_numpy()
    return out


def mapped(table: DataFrame, columns: list[str], of, keep: str = "id", name: str = "x") -> DataFrame:
    """``keep`` and an array: the rows of ``of``, a function of the matrices of some array columns of a batch."""

    def work(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(keep), arrays(of(*(matrix(b.column(c)) for c in columns)))], names=[keep, name])

    return table.select(keep, *columns).mapInArrow(work, f"{keep} {dict(table.dtypes)[keep]}, {name} array<double>")


#: A matrix of so many nodes at most is solved whole on the driver; larger ones by block Lanczos, with the same result.
SMALL = 1000


def eigen(edges: DataFrame, k: int, rounds: int = 60, tolerance: float = 1e-7, seed: int = 42, extra: int = 4, small: int = SMALL) -> tuple[np.ndarray, DataFrame]:
    """The ``k`` eigenvalues of largest magnitude of a symmetric edge table, and id, x: the entries of their unit vectors.

    Values are in descending order. Of each vector the entry of largest size of the
    least id among equals is positive. Block Lanczos: each round multiplies the last
    ``k + extra`` directions, takes the last two blocks off the product, then what
    rounding left of all blocks, and adds it; the matrix in these directions is small. Ends when the
    residuals of the ``k`` values are under ``tolerance`` of the largest, when no new
    direction is left (the result is then exact), or after ``rounds``. A value
    that occurs more often than the block is wide is found that often only.
    An empty table has no values.
    """
    e = materialize(edges.select("i", "j", "w"), "matrix")
    nodes = e.select(F.col("i").alias("id")).distinct()
    n = nodes.count()
    if not n or k < 1:
        return np.empty(0), e.select(F.col("i").alias("id"), F.array(F.lit(0.0)).alias("x")).limit(0)
    if n <= small:
        return _dense_eigen(e, nodes, k)
    width = min(k + extra, n)
    krylov = Krylov(e, nodes, n, width, seed)
    size = last = krylov.begin_with(_orthonormal, width)
    before, t = 0, np.zeros((0, 0))
    for step in range(rounds):
        product = krylov.multiply(last)
        inner = krylov.inner(product, size, last, before)
        grown = np.zeros((size, size))
        grown[: len(t), : len(t)] = t
        grown[:, size - last :] = inner
        grown[size - last :, :] = inner.T
        t = grown
        again, gram = krylov.inner_again(product, inner)
        gram = gram - again.T @ again
        values, vectors = np.linalg.eigh((t + t.T) / 2)
        order = np.argsort(-np.abs(values), kind="stable")[: min(k, size)]
        # the product outside of the basis, by its Gram matrix: what a vector's last entries make of it is the residual
        tail = vectors[size - last :, order]
        residuals = np.sqrt(np.maximum(np.einsum("ai,ab,bi->i", tail, (gram + gram.T) / 2, tail), 0))
        scale = max(np.abs(values).max(), 1e-300)
        turn = _orthonormal(gram, least=(1e-13 * scale) ** 2)
        if (size >= k and residuals.max() <= tolerance * scale) or turn.shape[1] == 0 or size == n or step == rounds - 1:
            product.drop()
            break
        turn = turn[:, -min(turn.shape[1], n - size) :]
        krylov.grow(product, inner, again, turn)
        product.drop()
        before, last = last, turn.shape[1]
        size += last
    order = order[np.argsort(-values[order], kind="stable")]
    chosen = vectors[:, order]
    found = materialize(krylov.vectors(chosen), "vectors")
    krylov.drop()
    signs = found.agg(*(F.max(F.struct(F.round(F.abs(F.get("x", F.lit(c))), 9).alias("a"), (-F.col("id")).alias("b"), F.get("x", F.lit(c)).alias("v"))).alias(f"s{c}") for c in range(len(order)))).first()
    flip = np.array([1.0 if signs[f"s{c}"]["v"] >= 0 else -1.0 for c in range(len(order))])
    return values[order], mapped(found, ["x"], lambda x: x * flip)


def _dense_eigen(edges: DataFrame, nodes: DataFrame, k: int) -> tuple[np.ndarray, DataFrame]:
    """The same for a matrix that the driver can hold."""
    rows = edges.groupBy("i", "j").agg(F.sum("w").alias("w")).toArrow()
    ids = np.sort(nodes.toArrow().column("id").to_numpy())
    m = np.zeros((len(ids), len(ids)))
    m[np.searchsorted(ids, rows.column("i").to_numpy()), np.searchsorted(ids, rows.column("j").to_numpy())] = rows.column("w").to_numpy()
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:k]
    order = order[np.argsort(-values[order], kind="stable")]
    x = vectors[:, order]
    x = x * np.where(x[np.abs(np.round(x, 9)).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    table = edges.sparkSession.createDataFrame([(int(i), [float(c) for c in row]) for i, row in zip(ids, x, strict=True)], "id long, x array<double>")
    return values[order], materialize(table, "vectors")


def _orthonormal(gram: np.ndarray, least: float = 0.0) -> np.ndarray:
    """The matrix that makes columns with this Gram matrix orthonormal, fewer where they hold fewer directions; rising."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = values > max(max(values.max(), 0) * 1e-14, least)
    return vectors[:, keep] / np.sqrt(values[keep])


def spectrum(edges: DataFrame, k: int = 25, rounds: int = 60) -> DataFrame:
    """place (from 0) and value of the ``k`` largest eigenvalues."""
    values, _ = eigen(edges, k, rounds)
    values = values + 0.0
    return edges.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "place int, value double")


def gap_ratio(values: DataFrame) -> DataFrame:
    """One row: the largest over the second eigenvalue; infinite where the second is 0, null with fewer than two."""
    two = F.max(F.when(F.col("place") == 1, F.col("value")))
    one = F.max(F.when(F.col("place") == 0, F.col("value")))
    return values.agg(F.when(F.abs(two) < 1e-12, F.lit(float("inf"))).otherwise(one / two).alias("gap_ratio"))


def decay_rate(values: DataFrame, top: int = 20) -> DataFrame:
    """One row: minus the slope of log eigenvalue by place, over the positive ones among the first ``top``."""
    rows = values.where((F.col("place") < top) & (F.col("value") > 0))
    return rows.agg((-F.regr_slope(F.log("value"), F.col("place"))).alias("decay_rate"))


def spectral_entropy(values: DataFrame, t: int = 3) -> DataFrame:
    """One row: the entropy (in bits) of the eigenvalues' magnitudes to the power ``t``, as shares."""
    p = values.select(F.pow(F.abs("value"), F.lit(float(t))).alias("p"))
    total = p.agg(F.sum("p").alias("all"))
    share = p.crossJoin(F.broadcast(total)).select((F.col("p") / F.col("all")).alias("q")).where("q > 0")
    return share.agg((-F.sum(F.col("q") * F.log2("q"))).alias("entropy"))


def spectral_counts(values: DataFrame, times: list[int], floor: float = 1e-6) -> DataFrame:
    """t and the number of eigenvalues whose magnitude to the power t is above ``floor``."""
    t = values.select(F.abs("value").alias("a"), F.explode(F.array(*(F.lit(int(x)) for x in times))).alias("t"))
    return t.groupBy("t").agg(F.count_if(F.pow("a", F.col("t").cast("double")) > floor).alias("n"))


def topology(table: DataFrame, values: DataFrame) -> DataFrame:
    """One row: points, dimensions, gap ratio, eigenvalues above a hundredth of the largest, and participation."""
    shape = table.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"))
    top = values.agg(F.max("value").alias("top"))
    of = values.crossJoin(F.broadcast(top)).agg(F.count_if(F.col("value") > 0.01 * F.col("top")).alias("large"), (F.pow(F.sum("value"), 2) / F.sum(F.col("value") * F.col("value"))).alias("participation"))
    return shape.crossJoin(gap_ratio(values)).crossJoin(of)


def diffusion_coordinates(edges: DataFrame, k: int = 2, t: int = 1, alpha: float = 1.0, rounds: int = 60) -> DataFrame:
    """id, vec: coordinates lambda ** t times psi of the first ``k`` nontrivial eigenvectors of the transition matrix.

    These come from the symmetric operator: psi is its eigenvector over that of eigenvalue one.
    """
    values, vectors = eigen(symmetric_operator(edges, alpha), k + 1, rounds)
    first = F.get("x", F.lit(0))
    return vectors.select("id", F.array(*(F.get("x", F.lit(c)) / first * float(values[c] ** t) for c in range(1, len(values)))).alias("vec"))


def coordinate_correlation(embedding: DataFrame, coordinates: DataFrame, k: int = 2) -> DataFrame:
    """One row: the mean over ``k`` axes of the magnitude of the correlation with the diffusion coordinates."""
    both = embedding.join(coordinates.select("id", F.col("vec").alias("other")), "id")
    axes = [F.abs(F.corr(F.get("vec", F.lit(c)), F.get("other", F.lit(c)))) for c in range(k)]
    return both.agg((sum(axes, F.lit(0.0)) / k).alias("correlation"))


def power(edges: DataFrame, t: int) -> DataFrame:
    """The edge table of the ``t``-th power of a matrix."""
    out = edges.select("i", "j", "w")
    for _ in range(t - 1):
        step = out.select("i", F.col("j").alias("m"), F.col("w").alias("u")).join(edges.select(F.col("i").alias("m"), "j", "w"), "m")
        out = materialize(step.groupBy("i", "j").agg(F.sum(F.col("u") * F.col("w")).alias("w")), "power")
    return out


def diffusion_curvature(operator: DataFrame, t: int = 3, percentile: float = 0.05, every: bool = False) -> DataFrame:
    """i and the mean mass that ``t`` steps from i leave within a ball around i.

    The ball holds the nodes whose rows of the power differ by no more than the given
    percentile of all distances. Rows that share nothing can be nearer than others that do, if their
    mass is spread wider: with ``every`` they are among the pairs and the balls, else only reached pairs are.
    """
    from .curvature import all_ball_means, ball_means

    operator = materialize(operator.select("i", "j", "w").where("w > 0"), "operator")
    return (all_ball_means if every else ball_means)(power(operator, t), percentile)


def condense(table: DataFrame, k: int = 5, decay: float = 40.0, scale: float = 1.025, granularity: float = 0.1, rounds: int = 500, subsample: int = 1000, seed: int = 42) -> DataFrame:
    """step and n: the number of groups after each round of diffusion condensation; see :func:`condensation`."""
    steps, _ = condensation(table, row_shares(decay_edges(table, k, decay)), scale, granularity, rounds, subsample, seed)
    return steps


def condensation(table: DataFrame, operator: DataFrame, scale: float = 1.025, granularity: float = 0.1, rounds: int = 500, subsample: int = 1000, seed: int = 42, target: int = 1) -> tuple[DataFrame, DataFrame]:
    """step and n, the groups after each round from step 0 on; and id, group (the smallest id of the group) at the end.

    A round merges all groups whose centroids (means of their points as these are
    now) are closer than a threshold, also by way of others. Where none are, every
    point moves to its mean by ``operator`` (i, j, w, rows summing to one), and the
    threshold grows by ``scale``. The threshold starts at the 0.1 percentile of the
    distances of at most ``subsample`` points (by hash) plus a tenth of ``granularity``
    times their deviation. Ends at ``target`` groups or fewer. Close centroids are found by tiles;
    a tile hands on the links of a forest, not all of its pairs.
    """
    from . import sampling
    from .graph import connected_components
    from .neighbours import same_length
    from .scaling import distances

    points = materialize(same_length(table).select("id", F.col("id").alias("group"), "vec"), "condensed")
    spark, n = table.sparkSession, points.count()
    some = sampling.random(points.select("id", "vec"), "id", subsample, seed).collect()
    far = distances(*[np.array([r["vec"] for r in some], dtype=float)] * 2)[np.triu_indices(len(some), 1)] if len(some) > 1 else np.empty(0)
    if not len(far):
        return spark.createDataFrame([(0, 1)] if n else [], "step int, n int"), points.select("id", "group")
    threshold = float(np.percentile(far, 0.1) + granularity * far.std() * 0.1)
    operator = materialize(operator.select("i", "j", "w"), "operator")
    steps = [(0, n)]
    for step in range(1, rounds + 1):
        if n <= target:
            break
        centres = materialize(mean_vectors(points, "group").select(F.col("group").alias("id"), "vec"), "centres")
        merged = connected_components(materialize(close_links(centres, threshold), "links"))
        after = points.join(merged.select(F.col("node").alias("group"), "component"), "group", "left").select("id", F.coalesce("component", "group").alias("group"), "vec")
        after = materialize(after, "condensed")
        count = after.select("group").distinct().count()
        if count == n:
            moved = weighted_means(operator, points.select("id", "vec"))
            points = materialize(points.select("id", "group").join(moved, "id"), "condensed")
            threshold *= scale
        else:
            points, n = after, count
        steps.append((step, n))
    return spark.createDataFrame(steps, "step int, n int"), points.select("id", "group")


def mean_vectors(table: DataFrame, by: str) -> DataFrame:
    """The mean of ``vec`` by a column."""
    entries = table.select(by, F.posexplode("vec").alias("p", "x")).groupBy(by, "p").agg(F.avg("x").alias("x"))
    return entries.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda t: t["x"]).alias("vec"))


def weighted_means(operator: DataFrame, table: DataFrame) -> DataFrame:
    """id and vec: for each row i of an operator the sum of w times the vector of j."""
    rows = operator.join(table.select(F.col("id").alias("j"), "vec"), "j").select("i", "w", F.posexplode("vec").alias("p", "x"))
    entries = rows.groupBy("i", "p").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return entries.groupBy(F.col("i").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda t: t["x"]).alias("vec"))


def close_links(table: DataFrame, threshold: float, tile: int = 2048) -> DataFrame:
    """a, b: links that connect the same points as all pairs closer than ``threshold`` do.

    Every two tiles meet once and are looked at by cells. Points of a tile hold the smallest id that they are
    linked to so far, and a cell hands on what changes: few links however many pairs are close.
    """
    import pandas as pd

    from .neighbours import _meet, cells, squares

    def work(tiles):
        links = [pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})]
        if tiles is not None:
            ids, x, others, y, _ = tiles
            linked = others.copy()
            for rows, cols in cells(len(x), len(y)):
                own = ids[rows]
                r, c = np.nonzero(squares(x[rows], y[cols]) < threshold**2)
                other = own[r] != others[cols][c]
                r, c = r[other], c[other]
                if not len(r):
                    continue
                before, of_x, of_y = linked[cols], own.copy(), linked[cols].copy()
                while True:
                    np.minimum.at(of_x, r, of_y[c])
                    new = of_y.copy()
                    np.minimum.at(new, c, of_x[r])
                    if (new == of_y).all():
                        break
                    of_y = new
                moved = before != of_y
                a, b = np.concatenate([own, before[moved]]), np.concatenate([of_x, of_y[moved]])
                linked[cols] = of_y
                links.append(pd.DataFrame({"a": a[a != b], "b": b[a != b]}))
        return pd.concat(links).drop_duplicates()

    return _meet(table, table, work, "a long, b long", tile, half=True)


def dimensions_of(table: DataFrame) -> int:
    return table.agg(F.max(F.size("vec"))).first()[0] or 0


def row_shares(edges: DataFrame) -> DataFrame:
    return edges.join(degrees(edges), "i").select("i", "j", (F.col("w") / F.col("degree")).alias("w"))


def shortest_paths(edges: DataFrame, sources: DataFrame, rounds: int = 1000) -> DataFrame:
    """source, id and d: the shortest way from each source over undirected edges i, j, d, for all ids that it reaches.

    Each round lets the ways that got shorter in the last one go one edge further,
    so a round costs what is new. ``sources`` has ``id``; their number is what the
    caller bounds, as the result has a row for each source and id.
    """
    both = materialize(edges.select("i", "j", "d").union(edges.select("j", "i", "d")).groupBy("i", "j").agg(F.min("d").alias("d")), "both-ways")
    best = materialize(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("d")), "ways")
    new = best
    for _ in range(rounds):
        reach = new.select("source", F.col("id").alias("i"), F.col("d").alias("so_far")).join(both, "i").groupBy("source", F.col("j").alias("id")).agg(F.min(F.col("so_far") + F.col("d")).alias("d"))
        step = materialize(reach.join(best.withColumnRenamed("d", "old"), ["source", "id"], "left").where("old is null or d < old").select("source", "id", "d"), "shorter")
        if not step.take(1):
            break
        best = materialize(best.union(step).groupBy("source", "id").agg(F.min("d").alias("d")), "ways")
        new = step
    return best


def geodesic_distances(table: DataFrame, k: int, sources: DataFrame) -> DataFrame:
    """source, id and d along the graph of ``k`` neighbours, from the given sources."""
    return shortest_paths(knn(table, k).select("i", "j", "d"), sources)


def geodesic_correlation(high: DataFrame, low: DataFrame, k: int = 10, sources: int = 64, seed: int = 42) -> DataFrame:
    """One row: Spearman correlation of distances along the graph of ``high`` with straight ones in ``low``, from ``sources`` points by hash."""
    from . import sampling
    from .statistics import spearman

    chosen = sampling.random(high.select("id"), "id", sources, seed)
    d = geodesic_distances(high, k, chosen).where("source <> id")
    end = low.select("id", F.col("vec").alias("b"))
    pairs = d.join(low.select(F.col("id").alias("source"), F.col("vec").alias("a")), "source").join(end, "id").select(F.col("d").alias("x"), distance("a", "b").alias("y"))
    return spearman(materialize(pairs, "geodesics"), "x", "y")


def smoothness(edges: DataFrame, values: DataFrame, normalised: bool = True) -> DataFrame:
    """One row: the mean over the columns of ``values`` (id, vec) of x'Lx, L the Laplacian of the directed edges."""
    deg = edges.groupBy("i").agg(F.count("*").cast("double").alias("deg"))
    x = values.select(F.col("id").alias("i"), F.col("vec").alias("x")).join(deg, "i")
    y = x.select(F.col("i").alias("j"), F.col("x").alias("y"), F.col("deg").alias("degj"))
    e = edges.select("i", "j").join(x, "i").join(y, "j")
    scale = F.sqrt(F.col("deg") * F.col("degj")) if normalised else F.lit(1.0)
    cross = e.agg(F.sum(dot("x", "y") / scale).alias("cross"))
    own = x.agg(F.sum(dot("x", "x") * (F.lit(1.0) if normalised else F.col("deg"))).alias("own"), F.max(F.size("x")).alias("columns"))
    return own.crossJoin(cross).select(((F.col("own") - F.col("cross")) / F.col("columns")).alias("smoothness"))
