"""Clusters, covers and trees of graphs and point tables."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .graph import connected_components
from .neighbours import distance, knn
from .sampling import uniform


def communities(edges: DataFrame, resolution: float = 0.5, rounds: int = 20, levels: int = 5, seed: int = 42) -> DataFrame:
    """node and community by modularity: a round moves nodes to the neighbouring community with the largest gain, and levels contract communities.

    The gain of a community is the weight of the edges to it less ``resolution``
    times degree times its degree over the total. In one round only the half of
    the nodes that a hash of node and round draws may move, so that two
    neighbours rarely change places for ever. After the rounds of a level each
    community is refined into its connected parts, so every one is connected.
    ``edges`` are undirected (i, j, w), given once or in both directions. A
    community's name is its least node.
    """
    e = edges.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w").groupBy("i", "j").agg(F.sum("w").alias("w"))
    e = materialize(e.union(e.select("j", "i", "w")), "graph")
    nodes = e.select(F.col("i").alias("node")).distinct()
    member = materialize(nodes.select("node", F.col("node").alias("at")), "members")  # node of the first level -> node of this level
    for level in range(levels):
        degree = materialize(e.groupBy(F.col("i").alias("at")).agg(F.sum("w").alias("degree")), "degrees")
        total = degree.agg(F.sum("degree")).first()[0]
        if not total:
            break
        label = materialize(degree.select("at", F.col("at").alias("label"), "degree"), "labels")
        for at in range(rounds):
            mass = label.groupBy("label").agg(F.sum("degree").alias("mass"))
            to = e.where("i <> j").join(label.select(F.col("at").alias("j"), "label"), "j").groupBy(F.col("i").alias("at"), "label").agg(F.sum("w").alias("w"))
            own = label.select("at", "label", F.lit(0.0).alias("w"))
            options = to.union(own).groupBy("at", "label").agg(F.sum("w").alias("w")).join(mass, "label").join(label.select("at", F.col("label").alias("was"), "degree"), "at")
            others = F.col("mass") - F.when(F.col("label") == F.col("was"), F.col("degree")).otherwise(0.0)
            gain = F.round(F.col("w") - F.lit(resolution / total) * F.col("degree") * others, 9)
            best = options.groupBy("at").agg(F.max(F.struct(gain.alias("gain"), (F.col("label") == F.col("was")).alias("stays"), (-F.col("label")).alias("low"))).alias("best"), F.first("was").alias("was"), F.first("degree").alias("degree"))
            may = uniform("at", seed + at + 1000 * level) < 0.5
            step = best.select("at", F.when(may, -F.col("best.low")).otherwise(F.col("was")).alias("label"), "was", (-F.col("best.low")).alias("wants"), "degree")
            step = materialize(step, "labels")
            label = step.select("at", "label", "degree")
            if not step.where("wants <> was").take(1):
                break
        # a community that fell apart as nodes left it is as many communities; no step gathers the nodes of a large one
        of = lambda side: label.select(F.col("at").alias(side), F.col("label").alias(f"{side}_label"))
        inner = e.where("i < j").join(of("i"), "i").join(of("j"), "j").where("i_label = j_label").select(F.col("i").alias("a"), F.col("j").alias("b"))
        parts = connected_components(inner).select(F.col("node").alias("at"), F.col("component").alias("to"))
        renamed = materialize(label.select("at").join(parts, "at", "left").select("at", F.coalesce("to", "at").alias("to")), "renamed")
        member = materialize(member.join(renamed, "at").select("node", F.col("to").alias("at")), "members")
        if not renamed.where("at <> to").take(1):
            break
        ends = lambda side: renamed.select(F.col("at").alias(side), F.col("to").alias(f"{side}_to"))
        e = materialize(e.join(ends("i"), "i").join(ends("j"), "j").groupBy(F.col("i_to").alias("i"), F.col("j_to").alias("j")).agg(F.sum("w").alias("w")), "graph")
    return member.select("node", F.col("at").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of a labelling (node, community) of undirected edges i, j, w given in both directions."""
    a, b = labels.select(F.col("node").alias("i"), F.col("community").alias("a")), labels.select(F.col("node").alias("j"), F.col("community").alias("b"))
    e = edges.join(a, "i").join(b, "j")
    inside = e.agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("all"))
    mass = e.groupBy("a").agg(F.sum("w").alias("m")).agg(F.sum(F.col("m") * F.col("m")).alias("squares"))
    return inside.crossJoin(mass).select((F.col("inside") / F.col("all") - resolution * F.col("squares") / (F.col("all") * F.col("all"))).alias("modularity"))


def classifier(table: DataFrame, labels: DataFrame, c: float = 1.0, max_iter: int = 1000) -> DataFrame:
    """id and the chance of label 1 by logistic regression with an L2 penalty of 1 / (c n), fitted on the labelled rows and applied to all."""
    rows = table.select("id", array_to_vector("vec").alias("features"))
    known = materialize(rows.join(labels.where("label in (0, 1)").select("id", F.col("label").cast("double").alias("label")), "id"), "labelled")
    n = known.count()
    model = LogisticRegression(maxIter=max_iter, regParam=1.0 / (c * max(n, 1)), standardization=False, tol=1e-9).fit(known)
    return model.transform(rows).select("id", vector_to_array("probability")[1].alias("probability"))


def spanning_edges(edges: DataFrame) -> DataFrame:
    """The minimum spanning forest of undirected edges i, j, d: a, b and d.

    Each round every component picks its shortest edge to another one (ties by
    the edge's ends), and the picked edges join components; components at least halve.
    """
    e = materialize(edges.where("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d")), "graph")
    picked = None
    e = e.select("a", "b", "d", F.col("a").alias("ca"), F.col("b").alias("cb"))
    while True:
        ends = e.select(F.col("ca").alias("c"), F.struct("d", "a", "b").alias("edge")).union(e.select("cb", F.struct("d", "a", "b")))
        best = materialize(ends.groupBy("c").agg(F.min("edge").alias("edge")).select("edge.*").distinct(), "picked")
        if not best.take(1):
            break
        picked = best if picked is None else picked.union(best)
        joined = connected_components(materialize(best.join(e, ["a", "b"]).select("ca", "cb"), "joins"), "ca", "cb")
        name = lambda side: joined.select(F.col("node").alias(side), F.col("component").alias(f"{side}_to"))
        e = e.join(name("ca"), "ca", "left").join(name("cb"), "cb", "left").select("a", "b", "d", F.coalesce("ca_to", "ca").alias("ca"), F.coalesce("cb_to", "cb").alias("cb")).where("ca <> cb")
        e = materialize(e, "graph")
    return picked.select("a", "b", "d") if picked is not None else e.select("a", "b", "d")


def components_persistence(edges: DataFrame, threshold: float = 0.1, relative: bool = False) -> DataFrame:
    """One row: how many finite bars of the components' persistence, the lengths of the spanning forest, are above the threshold (of the longest, if relative)."""
    bars = spanning_edges(edges)
    cut = F.lit(threshold) * (F.max("d") if relative else F.lit(1.0))
    one = bars.agg(cut.alias("cut"))
    return bars.crossJoin(F.broadcast(one)).agg(F.count_if(F.col("d") > F.col("cut")).alias("bars"))


def farthest_points(table: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` points (all, if fewer), each the farthest from those before: id, vec and place from 0; the first is drawn by a hash of the id, ties go to the smaller id.

    Every point keeps its distance to the chosen ones, so a step is one pass with
    one broadcast point; ``n`` steps are what the method asks for.
    """
    left = materialize(table.select("id", "vec", F.lit(float("inf")).alias("d")), "farthest")
    chosen = []
    last = left.orderBy(uniform("id", seed), "id").select("id", "vec").first()
    while last is not None and len(chosen) < n:
        chosen.append((last["id"], last["vec"], len(chosen)))
        if len(chosen) == n:
            break
        left = left.where(F.col("id") != last["id"]).select("id", "vec", F.least("d", distance("vec", F.array(*(F.lit(float(x)) for x in last["vec"])))).alias("d"))
        if len(chosen) % 10 == 0:
            left = materialize(left, "farthest")
        top = left.agg(F.max(F.struct(F.col("d"), (-F.col("id")).alias("low"), "vec")).alias("top")).first()["top"]
        last = {"id": -top["low"], "vec": top["vec"]} if top is not None else None
    return table.sparkSession.createDataFrame(chosen, "id long, vec array<double>, place int")


def density_lens(table: DataFrame, k: int = 15) -> DataFrame:
    """id and lens: one over the mean distance to the ``k`` nearest."""
    return knn(table, k).groupBy(F.col("i").alias("id")).agg((1 / F.greatest(F.avg("d"), F.lit(1e-12))).alias("lens"))


def lens_values(table: DataFrame, lens: str = "density", k: int = 15) -> DataFrame:
    """id and lens of each point: ``density``, ``pca1`` (the first principal component) or ``diffusion1`` (the first nontrivial coordinate of the symmetric operator)."""
    if lens == "density":
        return density_lens(table, k)
    if lens == "pca1":
        from .models import fit_pca

        model = fit_pca(table, 1)
        return table.select("id", F.lit(0.0).alias("lens")).limit(0) if model is None else model.transform(table).select("id", F.get("vec", F.lit(0)).alias("lens"))
    if lens == "diffusion1":
        from . import spectral

        _, x = spectral.eigen(spectral.symmetric_operator(spectral.gaussian_edges(table, k), 0.0), 2)
        return x.select("id", F.get("x", F.lit(1)).alias("lens"))
    raise ValueError(f"no lens {lens}; there are density, pca1 and diffusion1")


def reeb_graph(lens: DataFrame, edges: DataFrame, bins: int = 10, overlap: float = 0.0, density_factor: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes (node, bin, n, lens), links (a, b) and members (id, node) of the graph of components of lens intervals.

    ``lens`` has id and lens, ``edges`` the neighbour graph (i, j). Intervals are
    open above, and reach ``overlap`` of their width into both neighbours. An
    interval's members are joined by the edges between them; components of at most
    ``density_factor`` of the mean number of points of an interval go. Components of
    consecutive intervals are linked if they are connected together: by a point or an edge.
    """
    # read three times: a neighbour search is made once
    edges, lens = materialize(edges.select("i", "j"), "reeb-edges"), materialize(lens.select("id", "lens"), "reeb-lens")
    span = lens.agg(F.min("lens").alias("lo"), F.max("lens").alias("hi"), F.count("*").alias("n")).first()
    lo = span["lo"] or 0.0
    width = ((span["hi"] or 0.0) + 1e-6 - lo) / bins
    at = (F.col("lens") - F.lit(lo)) / width
    inside = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: (at >= b - overlap) & (at < b + 1 + overlap))
    members = materialize(lens.select("id", "lens", F.explode(inside).alias("bin")), "bins")
    a, b = members.select(F.col("id").alias("i"), "bin"), members.select(F.col("id").alias("j"), "bin")
    key = lambda c: F.col(c) * bins + F.col("bin")
    within = edges.select("i", "j").join(a, "i").join(b, ["j", "bin"]).select(key("i").alias("a"), key("j").alias("b"))
    component = connected_components(within).select(F.col("node").alias("key"), F.col("component").alias("node"))
    placed = members.withColumn("key", F.col("id") * bins + F.col("bin")).join(component, "key", "left").withColumn("node", F.coalesce("node", "key"))
    placed = materialize(placed.select("id", "lens", "bin", "node"), "placed")
    nodes = placed.groupBy("node", "bin").agg(F.count("*").alias("n"), F.avg("lens").alias("lens")).where(F.col("n") > F.lit(span["n"] / bins * density_factor))
    nodes = materialize(nodes, "nodes")
    kept = materialize(placed.join(nodes.select("node"), "node", "left_semi").select("id", "bin", "node"), "kept")
    low = kept.select("id", "bin", F.col("node").alias("a"))
    high = kept.select(F.col("id").alias("other"), (F.col("bin") - 1).alias("bin"), F.col("node").alias("b"))
    ways = edges.select("i", "j").union(edges.select("j", "i")).union(lens.select("id", "id")).toDF("id", "other").distinct()
    links = low.join(ways, "id").join(high, ["other", "bin"]).select("a", "b").distinct()
    return nodes, links, kept.select("id", "node")


def graph_summary(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row: nodes, edges, components, loops (edges - nodes + components), branch points (three links or more) and endpoints (one) of a graph."""
    components = connected_components(links.select("a", "b"))
    n = nodes.agg(F.count("*").alias("nodes"))
    e = links.agg(F.count("*").alias("edges"))
    alone = nodes.join(components, "node", "left_anti").agg(F.count("*").alias("alone"))
    c = components.agg(F.count_distinct("component").alias("joined"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    d = degree.agg(F.count_if(F.col("count") >= 3).alias("branch_points"), F.count_if(F.col("count") == 1).alias("endpoints"))
    s = n.crossJoin(e).crossJoin(alone).crossJoin(c).crossJoin(d).withColumn("components", F.col("alone") + F.col("joined"))
    return s.select("nodes", "edges", "components", (F.col("edges") - F.col("nodes") + F.col("components")).alias("loops"), "branch_points", "endpoints")
