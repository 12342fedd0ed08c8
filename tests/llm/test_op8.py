import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import topk_search
from tallyloom.llm.topk_search import top_k


def brute(rows, k, scale=64.0):
    ok = sorted({(i, tuple(int(np.floor(scale * x)) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)})
    out = set()
    for i, q in ok:
        if i % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))
            out |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])}
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("_v", F.lit(1)).withColumn("score", F.lit("x"))
    return {tuple(r) for r in top_k(df, F.col("_id") % 20 == 0, **more).collect()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(500, 8))
    base[200:400] = base[200] + rng.normal(size=(200, 8)) * 0.01  # a hot group
    base[420:440] = base[420]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    rows += [(None, [1.0] * 8), (520, None), (540, [1.0, None] + [0.0] * 6), (560, [float("nan")] * 8), (580, [0.0] * 8), (600, [1.0, 2.0]), (601, [2.0, 1.0]), (620, []), rows[40], rows[41]]
    for more in ({}, {"chunk_rows": 40, "query_rows": 6, "max_pivots": 7}):
        assert found(spark, rows, k=20, **more) == brute(rows, 20)


def test_large_numbers_and_few_rows(spark):
    rows = [(0, [1e7, -3.0]), (20, [1e6 + 1 / 64, 2.5]), (3, [-3e6, 7.0])]
    assert found(spark, rows, k=2) == brute(rows, 2)
    assert found(spark, [], k=2) == set()


def test_clustered_vectors_are_sent_to_few_cells(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 16)) * 8
    rows = [(i, [float(x) for x in middle[i % 40] + rng.normal(size=16) * 0.05]) for i in range(2400)]
    sent = []
    assert found(spark, rows, k=5, chunk_rows=60, query_rows=4, sent=sent) == brute(rows, 5)
    n, asked, cells, query_copies, data_copies = sent[0]
    assert asked == 120 and query_copies < asked * cells / 3 and data_copies < n * asked / 4 / 3


@pytest.mark.parametrize("n", [300, 3000])
def test_every_size_has_cells_and_leaves_some_out(spark, n):
    """Cells come from the number of rows, small tables included; the driver's state is a few numbers for each of some 2 sqrt(n) units."""
    rng = np.random.default_rng(9)
    middle = rng.normal(size=(12, 12)) * 6
    rows = [(i, [float(x) for x in middle[i % 12] + rng.normal(size=12) * 0.3]) for i in range(n)]
    sent = []
    assert found(spark, rows, k=5, sent=sent) == brute(rows, 5)
    _, asked, cells, query_copies, data_copies = sent[0]
    assert cells >= 8 and query_copies < asked * cells * 0.7 and data_copies < n * 2


def test_units_and_cells():
    first, parts = topk_search._cells([10, 5, 90, 3, 40], 40)
    assert (first, parts) == ([0, 0, 1, 4, 5], [1, 1, 3, 1, 1])
    units = topk_search.Units(np.array([[3.0, 0.0], [0.0, 2.0]]), np.array([0, 1, 0, -1]), np.array([0.5, 0.1, 9.0, 0.0]), np.array([3.5, 2.1, 12.0, 4.0]), np.arange(4), np.ones(4, int))
    q = np.array([[1.0, 0.0], [0.0, -1.0]])
    assert np.allclose(units.bounds(q, np.arange(4))[:, :3], [[3.5, 0.1, 12.0], [0.5, -1.9, 9.0]]) and np.isinf(units.bounds(q, np.array([3]))).all()
    assert units.open_to(0, 0.0, 1.0, 100.0).tolist() == [3] and units.open_to(0, 0.0, 1.0, None).tolist() == [0, 1, 2, 3] and units.open_to(-1, 0.0, 1.0, 5.0).tolist() == [0, 1, 2, 3]


def test_ids_must_be_numbers(spark):
    df = spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>")
    with pytest.raises(TypeError):
        top_k(df, F.lit(True))
