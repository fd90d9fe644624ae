import numpy as np
import pyarrow as pa

from manifold_spark.operators import clustering, local
from manifold_spark.operators import neighbours as nb
from manifold_spark.operators.spectral import arrays


def test_patches_are_solved_a_bounded_number_at_a_time():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 20 * 64))
    batch = pa.RecordBatch.from_arrays([pa.array([[0] * 20] * 2000), arrays(rng.random((2000, 20))), arrays(x)], names=["near", "d", "x"])
    sizes, seen = [], []
    for rows, points, *_ in local._solved(batch, 64, "none", 0.1, 0.75):
        sizes.append(points.shape[0] * 64 * (64 + 20))
        seen.extend(rows)
        assert np.array_equal(points.reshape(len(rows), -1), x[rows])
    assert max(sizes) <= 2_000_000 and seen == list(range(2000))


def test_reeb_graph_searches_neighbours_once(spark):
    t = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(40)], "id long, vec array<double>")
    lens = t.selectExpr("id", "vec[0] as lens")
    nodes, links, _ = clustering.reeb_graph(lens, nb.knn(t, 2), bins=4)
    assert "CoGroups" not in links._jdf.queryExecution().toString()
    row = clustering.graph_summary(nodes, links).first()
    assert (row.nodes, row.edges, row.loops) == (4, 3, 0)
