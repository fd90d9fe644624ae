import numpy as np
import pandas as pd
import pytest

from manifold_spark.operators import neighbours as nb
from manifold_spark.operators import statistics

POINTS = "id long, vec array<double>"


def cloud(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], POINTS)


def test_a_larger_table_has_larger_tiles_not_more_of_them():
    sides = [-(-n // nb.tile_size(n, 64, nb.TILE)) for n in (3000, 50_000, 100_000, 600_000)]
    assert sides == [1, 8, 8, 8]
    # but a tile stays bounded, and longer vectors have smaller ones
    assert nb.tile_size(10**9, 64, nb.TILE) * 64 <= nb.MOST and nb.tile_size(10**9, 6400, nb.TILE) == nb.TILE


def test_squares_of_equal_and_far_points():
    x = np.random.default_rng(0).normal(size=(40, 7)) + 1e3
    y = np.vstack([x[:5], x[:5] + 1e-9, x + 2])
    want = ((x[:, None] - y[None]) ** 2).sum(2)
    assert (nb.squares(x, y)[np.arange(5), np.arange(5)] == 0).all()
    assert np.allclose(nb.squares(x, y), want, rtol=1e-7, atol=0)


def test_ranks_count_ties_by_id_in_tiles(spark):
    x = np.random.default_rng(1).normal(size=(60, 4)).round(1)
    x[30:45] = x[:15]
    table = cloud(spark, x)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    want = {}
    for i in range(60):
        order = [j for j in np.lexsort((np.arange(60), d[i])) if j != i]
        want |= {(i, int(j)): r + 1 for r, j in enumerate(order)}
    asked = spark.createDataFrame([k for n, k in enumerate(want) if n % 3 == 0], "i long, j long")
    got = {(r.i, r.j): r.r for r in nb.ranks_of(asked, table, tile=9).collect()}
    assert got == {k: want[k] for k in got} and len(got) == asked.count()


def test_silhouette_of_repeated_points(spark):
    x = np.random.default_rng(2).normal(size=(24, 3))
    x[12:18] = x[:6]
    label = np.arange(24) % 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "id long, label int")
    for row in statistics.silhouette(cloud(spark, x), labels, tile=5).collect():
        i = row.id
        mean = [d[i, (label == c) & (np.arange(24) != i)].mean() for c in range(3)]
        a, b = mean[label[i]], min(m for c, m in enumerate(mean) if c != label[i])
        assert row.silhouette == pytest.approx((b - a) / max(a, b))


def test_a_written_table_meets_itself_whatever_is_read_of_it(spark, tmp_path):
    from manifold_spark.operators import vectors

    x = np.random.default_rng(3).normal(size=(30, 3))
    cloud(spark, x).write.parquet(str(tmp_path / "t"))
    pairs = vectors.center_gram(spark.read.parquet(str(tmp_path / "t")), tile=8)
    z = x - x.mean(0)
    assert pairs.count() == len(pairs.select("i").collect()) == 30 * 31 // 2
    assert all(r.c == pytest.approx((z @ z.T)[r.i, r.j]) for r in pairs.collect())
    assert "CoGroups" in pairs._jdf.queryExecution().toString()


def test_kernels_and_distances_meet_in_tiles(spark, monkeypatch):
    from manifold_spark.operators import comparison

    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(41, 4)), rng.normal(size=(41, 3))
    x[30:] = x[:11]
    y[35:] = y[30]
    dx, dy = (((v[:, None] - v[None]) ** 2).sum(2) for v in (x, y))
    # bins about the middle are narrowed more than once
    monkeypatch.setattr(comparison, "BINS", 8)
    monkeypatch.setattr(comparison, "VALUES", 50)
    both, cut = comparison._side_by_side(cloud(spark, x), cloud(spark, y))
    assert comparison.median_squares(both, cut, 9) == pytest.approx([np.median(d[d > 0]) for d in (dx, dy)])

    def centred(d):
        h = np.eye(41) - 1 / 41
        return h @ np.exp(-d / np.median(d[d > 0])) @ h

    k, m = centred(dx), centred(dy)
    assert comparison.rbf_cka(cloud(spark, x), cloud(spark, y), tile=9).first().cka == pytest.approx((k * m).sum() / np.sqrt((k * k).sum() * (m * m).sum()))
    upper = np.triu_indices(41, 1)
    found = comparison.distance_correlation(cloud(spark, x), cloud(spark, y), tile=9)
    assert found.first().pearson == pytest.approx(np.corrcoef(np.sqrt(dx[upper]), np.sqrt(dy[upper]))[0, 1])
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    # all points equal: no distance is positive
    same = cloud(spark, np.ones((5, 2)))
    assert comparison.rbf_cka(same, same).first().cka == 0 and comparison.distance_correlation(same, same).first().pearson is None


def test_the_right_table_of_a_neighbour_join_has_few_tiles(spark):
    import pandas as pd

    once = lambda tiles: pd.DataFrame({"i": [] if tiles is None else tiles[0]}, dtype="int64")
    table = cloud(spark, np.random.default_rng(4).normal(size=(60, 3)))
    # a point's candidates are those of so many tiles, at any size, as a tile may hold so many numbers
    assert nb._meet(table, table, once, "i long", 1, few=True).count() == 60 * nb.FEW
    assert [-(-n // nb.tile_size(n, 64, nb.TILE, nb.FEW, nb.LARGE)) for n in (10_256, 102_564, 400_000)] == [3, 3, 3]
    assert nb.tile_size(10**9, 64, nb.TILE, nb.FEW, nb.LARGE) * 64 <= nb.LARGE


@pytest.mark.parametrize("kind", ["spread", "repeated", "in one group", "alike"])
def test_nearest_of_a_tile_by_groups(kind):
    rng, k, n = np.random.default_rng(5), 7, 1000
    c = rng.normal(size=(n, 5))
    if kind == "repeated":
        c = c.round(0)
    if kind == "in one group":  # all that is near has the same place in its group
        c[:: n // nb.GROUP] *= 1e-3
    if kind == "alike":
        c[:] = c[0]
    cid = rng.permutation(n)
    q, qid = np.vstack([c[:40], rng.normal(size=(20, 5))]), np.concatenate([cid[:40], np.arange(n, n + 20)])
    got = nb.nearest(cid, c, qid, q, k).sort_values(["i", "d", "j"])
    d = np.sqrt(((q[:, None] - c[None]) ** 2).sum(2))
    for at, i in enumerate(qid):
        order = [p for p in np.lexsort((cid, d[at])) if cid[p] != i][:k]
        mine = got[got["i"] == i]
        assert mine["j"].tolist() == cid[order].tolist() and np.allclose(mine["d"], d[at][order], rtol=1e-12, atol=0)


def runs(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("CoGroupsInArrow")


def test_neighbours_are_found_once(spark):
    from manifold_spark.operators import phate

    table = cloud(spark, np.random.default_rng(6).normal(size=(40, 4)))
    near = nb.knn(table, 5)
    assert runs(near) == 1
    # both look at neighbours to two ranks, or twice
    assert runs(phate.kernel(table, 3)) == 0
    assert runs(nb.overlap(near, nb.knn(table, 4))) == 2


def test_overlap_of_neighbours_that_only_one_table_has(spark):
    edges = lambda *pairs: spark.createDataFrame(list(pairs), "i long, j long")
    a, b = edges((1, 2), (1, 3), (2, 1), (2, 3), (3, 1)), edges((1, 3), (1, 4), (2, 3), (2, 1))
    assert dict(nb.overlap(a, b).collect()) == {1: 0.5, 2: 1.0, 3: 0.0}


def test_a_table_that_meets_itself_by_halves_takes_every_two_tiles_once(spark):
    x = np.random.default_rng(9).normal(size=(60, 3))
    table = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "id long, vec array<double>")

    def work(tiles):
        if tiles is None:
            return pd.DataFrame({"n": np.empty(0, np.int64), "m": np.empty(0, np.int64)})
        ids, _, others, _, same = tiles
        assert same == (set(ids) == set(others))
        return pd.DataFrame({"n": [len(ids) * len(others) * (1 if same else 2)], "m": [1]})

    meetings = nb._meet(table, table, work, "n long, m long", 10, half=True).toPandas()
    assert meetings["n"].sum() == 60 * 60 and meetings["m"].sum() == 6 * 7 // 2
    plain = nb.pair_sums(table, table.select("id", "vec"), lambda d: d).first()
    found = nb.pair_sums(table, table, lambda d: d, tile=10).first()
    assert found.n == plain.n == 3600 and found.s == pytest.approx(plain.s) == pytest.approx(((x[:, None] - x[None]) ** 2).sum())
    # cells that are smaller than a tile, and equal points at 0
    both = nb.squares(np.vstack([x, x[:5] + 1e6]), x)
    assert (np.diag(both)[:60] == 0).all() and np.allclose(both, ((np.vstack([x, x[:5] + 1e6])[:, None] - x[None]) ** 2).sum(-1))
    assert len(list(nb.cells(1100, 600))) == 6


def test_products_stream_out_of_packed_tiles_and_are_whole(spark, monkeypatch):
    from manifold_spark.operators import vectors

    monkeypatch.setattr(vectors, "STREAM", 50)
    x = np.random.default_rng(10).normal(size=(50, 3))
    ids = np.random.default_rng(11).permutation(500)[:50] - 100
    table = spark.createDataFrame([(int(i), [float(c) for c in row]) for i, row in zip(ids, x, strict=True)], "id long, vec array<double>")
    z = x - x.mean(0)
    want = {(int(min(p, q)), int(max(p, q))): float(a @ b) for p, a in zip(ids, z, strict=True) for q, b in zip(ids, z, strict=True)}
    for tile in (1000, 9):
        pairs = vectors.center_gram(table, tile=tile)
        # tiles move as packed rows, not point by point
        assert "MapInArrow" in pairs._jdf.queryExecution().toString()
        rows = pairs.collect()
        assert {(r.i, r.j): r.c for r in rows} == pytest.approx(want) and len(rows) == len(want)
    assert vectors.center_gram(table.limit(0)).count() == 0


def test_links_of_cells_connect_as_all_close_pairs_do(spark, monkeypatch):
    from manifold_spark.operators import spectral
    from manifold_spark.operators.graph import connected_components

    monkeypatch.setattr(nb, "CELL", 7)
    x = np.random.default_rng(12).uniform(size=(90, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    label = np.arange(90)
    while True:
        new = np.array([label[d[i] < 0.09].min() for i in range(90)])
        if (new == label).all():
            break
        label = new
    links = spectral.close_links(spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "id long, vec array<double>"), 0.09, tile=20)
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert len(set(label)) < 80 and [got.get(i, i) for i in range(90)] == list(label)


def test_the_decay_kernel_finds_its_neighbours_once(spark, monkeypatch):
    from manifold_spark.operators import spectral

    table = cloud(spark, np.random.default_rng(13).normal(size=(40, 3)))
    edges = spectral.row_shares(spectral.decay_edges(table, 3))
    assert "CoGroups" not in edges._jdf.queryExecution().executedPlan().toString()
    assert edges.groupBy("i").agg({"w": "sum"}).toPandas()["sum(w)"].to_numpy() == pytest.approx(np.ones(40))
