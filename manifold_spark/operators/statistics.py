"""Statistics over points, labels, traces and run tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_counted, materialize
from .neighbours import _meet, blocks, distance, dot, squares, valid


def with_average_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """The rows with their rank from 1, ties sharing their mean; null values are ranked first.

    Values are counted, ranges of values are sorted apart, and each range adds the
    rows of those before it: what one task sees is one range, and one row a range
    is summed in order. Hot values are joined back by :func:`join_counted`.
    """
    counts = materialize(df.groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n")), "values")
    placed = materialize(counts.repartitionByRange("__v").withColumn("__part", F.spark_partition_id()), "ranges")
    before = placed.groupBy("__part").agg(F.sum("__n").alias("__all")).select("__part", (F.sum("__all").over(Window.orderBy("__part")) - F.col("__all")).alias("__before"))
    upto = F.sum("__n").over(Window.partitionBy("__part").orderBy("__v")) - F.col("__n")
    ranks = placed.join(F.broadcast(before), "__part").select("__v", "__n", (F.col("__before") + upto + (F.col("__n") + 1) / 2).alias(name))
    ranks = materialize(ranks, "ranks")
    known = join_counted(df.withColumn("__v", F.col(value)).where("__v is not null"), ranks.where("__v is not null"), ["__v"], "__n").drop("__v", "__n")
    nulls = df.where(F.col(value).isNull()).crossJoin(F.broadcast(ranks.where("__v is null").select(name)))
    return known.select(*df.columns, name).unionByName(nulls.select(*df.columns, name))


def percentile_ranks(df: DataFrame, value: str) -> DataFrame:
    n = df.count()
    return with_average_rank(df, value).withColumn("pct_rank", (F.col("rank") - 1) / F.lit(n - 1) if n > 1 else F.lit(0.0)).drop("rank")


def strata(df: DataFrame, value: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """0 up to the low percentile, 2 from the high one, else 1."""
    cuts = df.agg(F.percentile(value, F.lit(low)).alias("lo"), F.percentile(value, F.lit(high)).alias("hi"))
    return df.crossJoin(F.broadcast(cuts)).withColumn("stratum", F.when(F.col(value) >= F.col("hi"), 2).when(F.col(value) <= F.col("lo"), 0).otherwise(1)).drop("lo", "hi")


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the area under the ROC curve by rank sums; null without both classes.

    Equal scores are counted first, and ranges of scores are ordered apart: a task
    sees one range, and one row a range is summed in order.
    """
    by = df.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    placed = materialize(by.select(F.col(score).alias("s"), "p", "n").repartitionByRange("s").withColumn("part", F.spark_partition_id()), "scores")
    parts = placed.groupBy("part").agg(F.sum("n").alias("all")).select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    below = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("s")) - F.col("n")
    s = placed.join(F.broadcast(parts), "part").withColumn("below", below).agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return s.select(F.try_divide("u", F.col("p").cast("double") * F.col("n")).alias("auc"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the rank correlation of two columns, over the rows that have both."""
    both = materialize(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b")), "both")
    return with_average_rank(with_average_rank(both, "a", "x"), "b", "y").agg(F.corr("x", "y").alias("spearman"))


def silhouette(table: DataFrame, labels: DataFrame, tile: int = 2048) -> DataFrame:
    """id and silhouette by Euclidean distance; 0 for clusters of one point.

    Defined on all pairs: tiles of matrix products, of which only sums by point and label leave a task.
    """
    p = materialize(valid(table).join(labels.where("label is not null").select("id", F.col("label").cast("string").alias("label")), "id"), "labelled")

    def sums(tiles) -> pd.DataFrame:
        if tiles is None:
            return pd.DataFrame({"id": np.empty(0, np.int64), "label": pd.Series([], dtype="object"), "other": pd.Series([], dtype="object"), "s": np.empty(0), "n": np.empty(0, np.int64)})
        ids, x, others, y, label, theirs = tiles
        code, other = pd.factorize(theirs.to_pandas())
        member = np.eye(len(other))[code]
        s, n = np.empty((len(ids), len(other))), np.tile(member.sum(0), (len(ids), 1))
        for rows in blocks(len(x), len(y)):
            d = np.sqrt(squares(x[rows], y))
            # a point isn't counted in its own cluster
            r, c = np.nonzero(ids[rows, None] == others[None, :])
            d[r, c] = 0
            np.subtract.at(n, (rows.start + r, code[c]), 1)
            s[rows] = d @ member
        return pd.DataFrame({"id": np.repeat(ids, len(other)), "label": np.repeat(label.to_pandas().to_numpy(), len(other)), "other": np.tile(np.asarray(other), len(ids)), "s": s.ravel(), "n": n.ravel().astype(np.int64)})

    by = _meet(p, p, sums, "id long, label string, other string, s double, n long", tile, ("label",), ("label",))
    by = by.groupBy("id", "label", "other").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("m"))
    ab = by.groupBy("id", "label").agg(F.min(F.when(F.col("other") == F.col("label"), F.col("m"))).alias("a"), F.min(F.when(F.col("other") != F.col("label"), F.col("m"))).alias("b"))
    return ab.select("id", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def gram(table: DataFrame, centred: bool = True) -> DataFrame:
    """Second moments (times n) of the dimensions: p, q, c. A task passes on its d x d sums, whatever it reads."""

    def partial(batches):
        for b in batches:
            if len(b):
                x = np.stack(b["vec"].to_list())
                d = x.shape[1]
                p, q = np.divmod(np.arange(d * d), d)
                mean = x.mean(axis=0)
                c = (x - mean).T @ (x - mean)
                yield pd.DataFrame({"n": len(x), "p": p, "q": q, "c": c.ravel(), "mp": mean[p], "mq": mean[q]})

    parts = table.select("vec").mapInPandas(partial, "n long, p int, q int, c double, mp double, mq double")
    # moments about each batch's own mean, whose distance from the mean of all comes on top
    total = parts.groupBy("p", "q").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum(F.col("n") * F.col("mp") * F.col("mq")).alias("pq"), F.sum(F.col("n") * F.col("mp")).alias("sp"), F.sum(F.col("n") * F.col("mq")).alias("sq"))
    about_zero = F.col("c") + F.col("pq")
    return total.select("p", "q", (about_zero - F.col("sp") * F.col("sq") / F.col("n") if centred else about_zero).alias("c"))


def linear_cka(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: linear CKA of two point tables on the same ids."""
    both = a.join(b.select("id", F.col("vec").alias("other")), "id").select("id", F.concat("vec", "other").alias("vec"), F.size("vec").alias("cut"))
    cut = both.agg(F.first("cut").alias("cut"))
    g = gram(both.select("id", "vec")).crossJoin(F.broadcast(cut))
    part = lambda c: F.sum(F.when(c, F.col("c") * F.col("c")))
    p, q, n = F.col("p"), F.col("q"), F.col("cut")
    s = g.agg(part((p < n) & (q >= n)).alias("xy"), part((p < n) & (q < n)).alias("xx"), part((p >= n) & (q >= n)).alias("yy"))
    return s.select((F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("cka"))


def fractal_dimension(table: DataFrame, steps: int = 10) -> DataFrame:
    """One row: box counting over log-spaced sizes between a tenth of the least range and the largest range."""
    long = table.select("id", F.posexplode("vec").alias("p", "x"))
    r = long.groupBy("p").agg(F.min("x").alias("lo"), (F.max("x") - F.min("x")).alias("range"))
    span = r.agg((F.log(F.min("range") / 10)).alias("a"), F.log(F.max("range")).alias("b"))
    sizes = span.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.exp(F.col("a") + (F.col("b") - F.col("a")) * i / (steps - 1)))).alias("s", "eps"))
    # one row of the least values by dimension; boxes are then told row by row
    lows = r.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "lo"))), lambda x: x["lo"]).alias("lows"))
    boxes = table.where("vec is not null").select("vec").crossJoin(F.broadcast(lows)).crossJoin(F.broadcast(sizes))
    cell = F.zip_with("vec", "lows", lambda x, lo: F.floor((x - lo) / F.col("eps")))
    cells = boxes.select("s", "eps", cell.alias("cell")).distinct().groupBy("s", "eps").agg(F.count("*").alias("n"))
    return cells.agg((-F.regr_slope(F.log("n"), F.log("eps"))).alias("fractal_dimension"))


def trace_geometry(steps: DataFrame) -> DataFrame:
    """trace, step with velocity, cosine velocity and Menger curvature of consecutive vectors."""
    w = Window.partitionBy("trace").orderBy("step")
    s = steps.withColumn("before", F.lag("vec").over(w)).withColumn("after", F.lead("vec").over(w))
    norm = lambda v: F.sqrt(dot(v, v))
    floor = F.lit(1e-8)
    cosine = dot("vec", "before") / (F.greatest(norm("vec"), floor) * F.greatest(norm("before"), floor))
    u, v = F.zip_with("vec", "before", lambda x, y: x - y), F.zip_with("after", "vec", lambda x, y: x - y)
    s = s.withColumn("u", u).withColumn("v", v)
    c = dot("u", "v") / (F.greatest(norm("u"), floor) * F.greatest(norm("v"), floor))
    sine = F.sqrt(F.greatest(1 - c * c, F.lit(0.0)))
    menger = 2 * sine / F.greatest(distance("after", "before"), floor)
    return s.select("trace", "step", norm("u").alias("velocity"), (1 - cosine).alias("cosine_velocity"), F.when(F.col("before").isNotNull() & F.col("after").isNotNull(), menger).alias("curvature"))


def granger(series: DataFrame) -> DataFrame:
    """cause, effect with coefficient and chi-square of the lag-1 regression of ``effect`` on both pasts.

    ``series`` is long: t, gene, value, already differenced. Closed form from sums, no pair of genes is special.
    """
    w = Window.partitionBy("gene").orderBy("t")
    own = series.withColumn("past", F.lag("value").over(w)).where("past is not null")
    pairs = own.select("t", F.col("gene").alias("effect"), F.col("value").alias("y"), F.col("past").alias("x")).join(own.select("t", F.col("gene").alias("cause"), F.col("past").alias("z")), "t").where("cause <> effect")
    s = pairs.groupBy("cause", "effect").agg(F.count("*").alias("n"), F.regr_sxx("y", "x").alias("xx"), F.regr_sxx("y", "z").alias("zz"), F.regr_syy("y", "x").alias("yy"), F.regr_sxy("y", "x").alias("xy"), F.regr_sxy("y", "z").alias("zy"), F.regr_sxy("x", "z").alias("xz"))
    # a constant series has no regression: nulls
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    coef = F.try_divide(F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz"), det)
    b = F.try_divide(F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz"), det)
    s = s.withColumn("coef", coef).withColumn("full", F.col("yy") - b * F.col("xy") - F.col("coef") * F.col("zy")).withColumn("own", F.col("yy") - F.try_divide(F.col("xy") * F.col("xy"), F.col("xx")))
    return s.select("cause", "effect", "coef", F.try_divide(F.col("n") * (F.col("own") - F.col("full")), F.col("full")).alias("chi2"))


#: Added to p before its logarithm is taken, so a score is ten times log 2 at most. A fixed value.
P_FLOOR = 2.0**-10


def signed_score(p: Column, coef: Column) -> Column:
    """The sign of the coefficient times minus log of p + P_FLOOR."""
    return F.signum(coef) * -F.log(p + F.lit(P_FLOOR))


def chi2_tail(chi2: Column) -> Column:
    """The chance that a chi-square variable of one degree is larger."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series([None if v != v else math.erfc(math.sqrt(max(v, 0.0) / 2)) for v in x.to_numpy(dtype=float, na_value=np.nan)], dtype=float)

    return tail(chi2)


def gene_series(cells: DataFrame, downsample: int = 10) -> DataFrame:
    """t, gene, value: the mean over cells of (t, gene, value) rows, every ``downsample``-th time kept from the first on, first differences."""
    if downsample < 1:
        raise ValueError(f"downsample must be 1 or more, not {downsample}")
    mean = cells.groupBy("t", "gene").agg(F.avg("value").alias("value"))
    # a row for each time
    place = mean.select("t").distinct().withColumn("place", F.row_number().over(Window.orderBy("t")) - 1).where(F.col("place") % downsample == 0)
    w = Window.partitionBy("gene").orderBy("t")
    return mean.join(F.broadcast(place), "t").select("t", "gene", (F.col("value") - F.lag("value").over(w)).alias("value")).where("value is not null")


def granger_scores(cells: DataFrame, regulators: list | None = None, targets: list | None = None, downsample: int = 10) -> DataFrame:
    """cause, effect, coef, p and score of every pair of genes whose test isn't degenerate; ``regulators`` and ``targets`` name the genes of each side."""
    found = granger(gene_series(cells, downsample))
    for side, names in (("cause", regulators), ("effect", targets)):
        found = found.where(F.col(side).isin(list(names))) if names is not None else found
    found = found.where("chi2 is not null and coef is not null and not isnan(chi2)").withColumn("p", chi2_tail(F.col("chi2")))
    return found.select("cause", "effect", "coef", "p", signed_score(F.col("p"), F.col("coef")).alias("score"))


def loadings_summary(df: DataFrame) -> DataFrame:
    """component, modality and its share of the L2 norm; shared where every modality has a tenth."""
    by = df.groupBy("component", "modality").agg(F.sqrt(F.sum(F.col("loading") * F.col("loading"))).alias("norm"))
    total = Window.partitionBy("component")
    by = by.withColumn("share", F.col("norm") / F.sum("norm").over(total))
    return by.withColumn("shared", F.min("share").over(total) >= 0.1)
