"""Comparisons of spaces, labellings and samples.

Those that are defined on all pairs of points read them from one pair join and
sum them by row first; rank correlations are over a stated number of pairs.
Points are ``id, vec``; labels are ``id, label``. Rows with a null label take no part.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import drawn, sampling
from .neighbours import TILE, _meet, blocks, cells, common_length, distance, dot, intrinsic_dimension, knn, same_length, squares, valid
from .statistics import auc, spearman


def _side_by_side(a: DataFrame, b: DataFrame) -> tuple[DataFrame, int]:
    """id and both vectors one after another, of the points that can take part in both tables; and the length of the first."""
    a, b = same_length(a), same_length(b)
    both = a.join(b.select("id", F.col("vec").alias("other")), "id").select("id", F.concat("vec", "other").alias("vec"))
    return materialize(both, "both"), common_length(a)


#: Bins by which squared distances are counted, and how many values of the last bins are looked at one by one.
BINS, VALUES = 1 << 14, 200_000


def median_squares(both: DataFrame, cut: int, tile: int = TILE) -> list[float]:
    """The medians of the positive squared distances of all pairs, of the first ``cut`` entries and of the others; 1 where there are none.

    All pairs are gone through a few times by tiles, and only counts leave these: each time the bins about the
    middle become the range of the next, until the values in it are few.
    """
    least, most = [0.0, 0.0], [0.0, 0.0]
    for side, entries in enumerate((F.slice("vec", 1, cut), F.slice("vec", cut + 1, 1 << 20))):
        # no distance is larger than twice the longest vector
        most[side] = 4.0 * (both.agg(F.max(dot(entries, entries))).first()[0] or 0.0) * (1 + 1e-9)
    out: list[float | None] = [None, None]

    def gone_through(single: bool) -> DataFrame:
        """By side and place p the number of distances: of all (-2), of those below the range (-1), and in it by bins, or by value if ``single``."""
        todo, low, high = [s for s in (0, 1) if out[s] is None], list(least), list(most)

        def counted(x: np.ndarray, y: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
            every, below, n, found = 0, 0, np.zeros(BINS, np.int64), [np.empty(0)]
            wide = BINS / (high - low) if high > low else 0.0
            for rows, cols in cells(len(x), len(y)):
                d = squares(x[rows], y[cols]).ravel()
                d = d[d > 0]
                inside = d[(d >= low) & (d <= high)]
                every, below = every + len(d), below + np.count_nonzero(d < low)
                if single:
                    found.append(inside)
                else:
                    n += np.bincount(np.minimum(((inside - low) * wide).astype(np.int64), BINS - 1), minlength=BINS)
            at, n = np.unique(np.concatenate(found), return_counts=True) if single else (np.flatnonzero(n), n[n > 0])
            return np.concatenate([[-2.0, -1.0], at]), np.concatenate([[every, below], n])

        def work(tiles) -> pd.DataFrame:
            parts = [pd.DataFrame({"side": np.empty(0, np.int64), "p": np.empty(0), "n": np.empty(0, np.int64)})]
            if tiles is not None:
                _, x, _, y, same = tiles
                for s in todo:
                    part = slice(0, cut) if s == 0 else slice(cut, None)
                    p, n = counted(x[:, part], y[:, part], low[s], high[s])
                    parts.append(pd.DataFrame({"side": s, "p": p, "n": n if same else 2 * n}))
            return pd.concat(parts)

        return _meet(both, both, work, "side long, p double, n long", tile, half=True).groupBy("side", "p").agg(F.sum("n").alias("n"))

    few = False
    while None in out:
        last = few
        found = gone_through(last).toPandas()  # a bounded number of rows
        few = True
        for s in (0, 1):
            if out[s] is not None:
                continue
            rows = found[found["side"] == s].sort_values("p")
            total, below, rows = rows.loc[rows["p"] == -2, "n"].sum(), rows.loc[rows["p"] == -1, "n"].sum(), rows[rows["p"] >= 0]
            if not total:
                out[s] = 1.0
                continue
            upto = below + rows["n"].to_numpy().cumsum()
            middle = [rows["p"].to_numpy()[np.searchsorted(upto, r)] for r in ((total + 1) // 2, total // 2 + 1)]
            if last:
                out[s] = float(sum(middle) / 2)
                continue
            wide = (most[s] - least[s]) / BINS
            # a bin more at both ends, as rounding may have put a value into the next one
            near = rows[(rows["p"] >= middle[0] - 1) & (rows["p"] <= middle[1] + 1)]["n"].sum()
            low = least[s]
            least[s], most[s] = max(low, low + (middle[0] - 1) * wide), min(most[s], low + (middle[1] + 2) * wide)
            few = few and (near <= VALUES or most[s] - least[s] <= 1e-13 * most[s])
    return [float(m) for m in out]


def rbf_cka(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """One row: CKA with Gaussian kernels, each with the median of its positive squared distances as its width.

    Defined on all pairs: every two tiles meet once, and only sums by point leave.
    """
    both, cut = _side_by_side(a, b)
    mx, my = median_squares(both, cut, tile)

    def work(tiles) -> pd.DataFrame:
        if tiles is None:
            return pd.DataFrame({"i": np.empty(0, np.int64), **{c: np.empty(0) for c in ("rk", "rl", "kl", "kk", "ll")}})
        ids, x, others, y, same = tiles
        sums, theirs = np.zeros((len(ids), 5)), np.zeros((len(others), 5))
        for rows, cols in cells(len(x), len(y)):
            k, l = (np.exp(np.divide(d, -m, out=d), out=d) for d, m in ((squares(x[rows, :cut], y[cols, :cut]), mx), (squares(x[rows, cut:], y[cols, cut:]), my)))
            # sums of products are needed over all pairs only, so those of two tiles stand with the first one's points
            sums[rows] += np.stack([k.sum(1), l.sum(1), *((1 if same else 2) * np.einsum("ij,ij->i", u, v) for u, v in ((k, l), (k, k), (l, l)))], axis=1)
            if not same:
                theirs[cols, 0] += k.sum(0)
                theirs[cols, 1] += l.sum(0)
        if not same:
            ids, sums = np.concatenate([ids, others]), np.vstack([sums, theirs])
        return pd.DataFrame({"i": ids, **dict(zip(("rk", "rl", "kl", "kk", "ll"), sums.T, strict=True))})

    found = _meet(both, both, work, "i long, rk double, rl double, kl double, kk double, ll double", tile, half=True)
    rows = found.groupBy("i").agg(*(F.sum(c).alias(c) for c in ("rk", "rl", "kl", "kk", "ll")))
    n = F.count("*")
    centred = lambda x, y: F.sum(x + y) - 2 / n * F.sum(F.col("r" + x) * F.col("r" + y)) + F.sum("r" + x) * F.sum("r" + y) / n / n
    h = rows.agg(centred("k", "l").alias("kl"), centred("k", "k").alias("kk"), centred("l", "l").alias("ll"))
    return h.select(F.coalesce(F.try_divide("kl", F.sqrt(F.col("kk") * F.col("ll"))), F.lit(0.0)).alias("cka"))


def distance_correlation(a: DataFrame, b: DataFrame, tile: int = TILE) -> DataFrame:
    """One row: Pearson's correlation of the distances of all pairs in two tables; moments by tile, of which no pair leaves."""
    both, cut = _side_by_side(a, b)
    names = ("n", "x", "y", "xx", "yy", "xy")

    def work(tiles) -> pd.DataFrame:
        if tiles is None:
            return pd.DataFrame({c: np.empty(0) for c in names})
        ids, x, others, y = tiles
        out = []
        for rows in blocks(len(x), len(y)):
            other = ids[rows, None] != others[None, :]
            d, e = (np.sqrt(squares(x[rows, part], y[:, part])[other]) for part in (slice(0, cut), slice(cut, None)))
            if len(d):
                dm, em = d.mean(), e.mean()
                out.append((float(len(d)), dm, em, ((d - dm) ** 2).sum(), ((e - em) ** 2).sum(), ((d - dm) * (e - em)).sum()))
        return pd.DataFrame(out, columns=list(names), dtype=float)

    # moments about each block's means; the means' own distances from those of all come on top
    m = _meet(both, both, work, ", ".join(f"{c} double" for c in names), tile)
    of = lambda s, u, v: F.sum(s) + F.sum(F.col("n") * F.col(u) * F.col(v)) - F.sum(F.col("n") * F.col(u)) * F.sum(F.col("n") * F.col(v)) / F.sum("n")
    t = m.agg(of("xy", "x", "y").alias("xy"), of("xx", "x", "x").alias("xx"), of("yy", "y", "y").alias("yy"))
    return t.select(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("pearson"))


def sampled_distances(a: DataFrame, b: DataFrame, pairs: int, seed: int = 42) -> DataFrame:
    """i, j with the distance in each table (x, y), of ``pairs`` pairs drawn by a hash of both ids out of all."""
    chosen = materialize(drawn.pairs(a, pairs, seed), "pairs")
    end = lambda t, key, name: t.select(F.col("id").alias(key), F.col("vec").alias(name))
    for t, name in ((a, "x"), (b, "y")):
        chosen = chosen.join(end(t, "i", "u"), "i").join(end(t, "j", "w"), "j").withColumn(name, distance("u", "w")).drop("u", "w")
    return chosen


def preservation(a: DataFrame, b: DataFrame, pairs: int = 50_000, only_far: bool = False) -> DataFrame:
    """One row: Spearman correlation of sampled distances; ``only_far`` drops the nearest tenth of them."""
    d = sampled_distances(a, b, pairs)
    if only_far:
        d = d.crossJoin(F.broadcast(d.agg(F.percentile("x", F.lit(0.1)).alias("cut")))).where("x >= cut")
    return spearman(d, "x", "y")


def pearson_distances(a: DataFrame, b: DataFrame, pairs: int = 100) -> DataFrame:
    return sampled_distances(a, b, pairs).agg(F.corr("x", "y").alias("pearson"))


#: Rows in one of the groups whose pairs are counted together.
COUNTED = 500_000


def _inversions(ranks: np.ndarray) -> int:
    """The pairs of places whose first has the larger rank (from 0): bit by bit, a stable order each."""
    total = 0
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        one = (ranks >> bit) & 1
        group = ranks >> (bit + 1)
        before = np.cumsum(one)
        start = np.searchsorted(group, group)  # groups lie together, in rising order
        total += int((before - (before - one)[start])[one == 0].sum())
        ranks = ranks[np.argsort(ranks >> bit, kind="stable")]
    return total


def _concordance(keys: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> int:
    """Concordant less discordant pairs of x and y, of those with equal ``keys``."""
    code = lambda columns: np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True)[1].ravel() if len(columns) > 1 else np.unique(columns[0], return_inverse=True)[1]
    x, y = code([x]), code([y])
    k = code([code([c]) for c in keys]) if keys else np.zeros(len(x), np.int64)
    order = np.lexsort((y, x, k))
    within = k * (int(y.max(initial=0)) + 1)
    ties = lambda c: int((n * (n - 1) // 2).sum()) if len(n := np.unique(c, return_counts=True)[1]) else 0
    both = x.astype(np.int64) * (int(y.max(initial=0)) + 1) + y
    alike = ties(k) - ties(code([k, x]) if keys else x) - ties(within + y) + ties(code([k, both]) if keys else both)
    return alike - 2 * _inversions(code([within + y])[order])


def kendall(df: DataFrame, key: str, x: str, y: str, tile: int = COUNTED) -> DataFrame:
    """One row: Kendall's tau-b over all pairs of rows with different keys; null where a column is constant, NaN where two differ by NaN.

    No pair is made: of a group of rows, concordant and discordant pairs are counted by sorting. Rows of larger
    tables are dealt into groups of ``tile``, and every two of these are counted together; what each group holds
    itself is taken off.
    """
    kind = dict(df.dtypes)
    number = lambda c: F.col(c).cast("long" if kind[c] in ("tinyint", "smallint", "int", "bigint") else "double")
    code = F.col(key).cast("long") if kind[key] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)
    rows = materialize(df.where(F.col(key).isNotNull()).select(code.alias("k"), number(x).alias("x"), number(y).alias("y"), F.monotonically_increasing_id().alias("at")), "rows")

    def alike(t: DataFrame, *by: str) -> int:
        return t.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0

    def apart(t: DataFrame, *by: str) -> int:
        """Pairs with different keys, and with different values of a column too."""
        return alike(t) - alike(t, "k") - (alike(t, *by) - alike(t, "k", *by) if by else 0)

    both = rows.where("x is not null and y is not null")
    one, two = (apart(rows.where(F.col(c).isNotNull()), c) for c in ("x", "y"))
    schema, spark = "kendall double", df.sparkSession
    if not one or not two or not apart(both):
        return spark.createDataFrame([(None,)], schema)
    for c in ("x", "y"):
        infinite = rows.where(F.abs(c) == F.lit(float("inf")))
        if dict(rows.dtypes)[c] == "double" and (rows.where(F.isnan(c)).take(1) or alike(infinite, c) > alike(infinite, "k", c)):
            return spark.createDataFrame([(float("nan"),)], schema)
    n = max(1, -(-both.count() // tile))
    unique = not alike(both, "k")

    def count(t: pa.Table) -> pa.Table:
        k, a, b = (t.column(c).to_numpy() for c in ("k", "x", "y"))
        found = _concordance([], a, b) - (0 if unique else _concordance([k], a, b))
        return pa.table({"own": [t.column("a")[0].as_py() == t.column("b")[0].as_py()], "s": [found]})

    side, other = F.pmod(F.xxhash64("at"), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    pairs = both.select("k", "x", "y", side.alias("side"), other.alias("other")).select("k", "x", "y", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"))
    pairs = pairs.repartition(min(n * (n + 1) // 2, 1000), "a", "b")
    sums = {r["own"]: r["s"] for r in pairs.groupBy("a", "b").applyInArrow(count, "own boolean, s long").groupBy("own").agg(F.sum("s").alias("s")).collect()}
    s = sums.get(False, 0) - (n - 2) * sums.get(True, 0)
    return spark.createDataFrame([(s / (math.sqrt(one) * math.sqrt(two)),)], schema)


def class_axis(table: DataFrame, sides: DataFrame, folds: int = 0) -> DataFrame:
    """id, side (0, 1) and projection on the difference of the class means.

    With ``folds`` a point is projected on the unit axis of the folds that it isn't in (folds by crc32 of id).
    """
    fold = F.crc32(F.col("id").cast("string")) % folds if folds else F.lit(0)
    p = table.join(sides.where("side is not null"), "id").withColumn("fold", fold)
    sums = p.select("fold", "side", F.posexplode("vec").alias("p", "x")).groupBy("fold", "side", "p").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    if folds:
        over = Window.partitionBy("side", "p")
        sums = sums.select("fold", "side", "p", (F.sum("s").over(over) - F.col("s")).alias("s"), (F.sum("n").over(over) - F.col("n")).alias("n"))
    axis = sums.groupBy("fold", "p").agg(F.sum(F.when(F.col("side") == 1, F.col("s") / F.col("n")).otherwise(-F.col("s") / F.col("n"))).alias("w"))
    axis = axis.groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "w"))), lambda t: t["w"]).alias("axis"))
    # one vector a fold
    q = p.join(F.broadcast(axis), "fold")
    return q.select("id", "side", (dot("vec", "axis") / (F.sqrt(dot("axis", "axis")) + 1e-12 if folds else F.lit(1.0))).alias("projection"))


def separation_auroc(table: DataFrame, sides: DataFrame, folds: int = 0) -> DataFrame:
    return auc(class_axis(table, sides, folds), "projection", "side")


def layer_geometry(layers: dict[str, DataFrame], sides: DataFrame, k: int = 20, folds: int = 0) -> DataFrame:
    """layer, lid (the mean local intrinsic dimension at ``k``), auroc of the two sides, n and dim: one row a layer.

    ``sides`` has id and side (0, 1); with ``folds`` the axis is fitted out of fold.
    """
    out = None
    for name, points in layers.items():
        lid = intrinsic_dimension(knn(points, k)).agg(F.avg("lid").alias("lid"))
        shape = valid(points).agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"))
        one = lid.crossJoin(separation_auroc(points, sides, folds)).crossJoin(shape)  # a row each
        one = one.select(F.lit(name).alias("layer"), "lid", F.col("auc").alias("auroc"), "n", "dim")
        out = one if out is None else out.unionByName(one)
    return out


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings, from their contingency table."""
    pairs = lambda c: c * (c - 1) / 2
    n = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    of = lambda by: n.groupBy(by).agg(F.sum("n").alias("m")).agg(F.sum(pairs(F.col("m"))).alias(f"s{by}"))
    t = n.agg(F.sum(pairs(F.col("n"))).alias("s"), pairs(F.sum("n")).alias("all")).crossJoin(of("a")).crossJoin(of("b"))
    chance, most = F.col("sa") * F.col("sb") / F.col("all"), (F.col("sa") + F.col("sb")) / 2
    return t.select(F.coalesce(F.try_divide(F.col("s") - chance, most - chance), F.lit(1.0)).alias("ari"))


def kmeans(table: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """id, cluster."""
    v = table.select("id", array_to_vector("vec").alias("features"))
    return KMeans(k=k, seed=seed, predictionCol="cluster").fit(v).transform(v).select("id", "cluster")


def pca(table: DataFrame, k: int) -> DataFrame:
    """id, vec: the first ``k`` principal components, centred; of each loading the largest entry is positive. An empty table gives an empty one."""
    from .models import fit_pca

    model = fit_pca(table, k)
    return table.select("id", "vec").limit(0) if model is None else model.transform(table)


def _poisson(u):
    """How often a Poisson variable with mean 1 draws, by a uniform number."""
    term, total, out = 0.36787944117144233, 0.0, F.lit(0)
    for n in range(1, 12):
        total += term
        term /= n
        out = out + (u >= total).cast("int")
    return out


def bootstrap_mean(df: DataFrame, key: str, value: str, rounds: int = 100, ci: float = 0.95) -> DataFrame:
    """One row: mean and percentile interval over Poisson bootstrap rounds, drawn by a hash of key and round.

    Each round is summed in the map stage, so only ``rounds`` rows a task are shuffled.
    """
    drawn = df.where(F.col(value).isNotNull()).select(F.col(value).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("b"), F.col(key).alias("key")).withColumn("draw", F.concat_ws(",", "key", "b"))
    drawn = drawn.withColumn("w", _poisson(sampling.uniform("draw", 42)))
    by = drawn.groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum("w")).alias("m"))
    return by.agg(F.percentile("m", F.lit((1 - ci) / 2)).alias("low"), F.percentile("m", F.lit((1 + ci) / 2)).alias("high"))


def stable_scales(steps: DataFrame) -> DataFrame:
    """Of the runs of equal ``n`` of two ``step`` or more: start, length, n, middle and whether it scores best.

    ``steps`` is one condensation run: step from 0, n components; a few hundred rows.
    """
    by_step = Window.orderBy("step")
    run = steps.withColumn("new", F.coalesce((F.col("n") != F.lag("n").over(by_step)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(by_step)).withColumn("all", F.count("*").over(Window.partitionBy(F.lit(0))))
    runs = run.groupBy("run").agg(F.min("step").alias("start"), F.count("*").alias("length"), F.first("n").alias("n"), F.first("all").alias("all"))
    # without any run of two the last step stands for itself
    runs = runs.withColumn("longest", F.max("length").over(Window.partitionBy(F.lit(0)))).where("length >= 2 or (longest < 2 and start = all - 1)")
    score = F.col("length") * (1 + F.col("start") / F.col("all")) / F.greatest(F.log(1 + F.col("n")), F.lit(0.1))
    place = F.row_number().over(Window.orderBy(F.desc("score"), "start"))
    return runs.withColumn("score", score).select("start", "length", "n", (F.col("start") + F.floor(F.col("length") / 2)).alias("middle"), (place == 1).alias("best"))
