import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.vector_dedup import Settings, _coarse, _from_coarse, _slack, near_duplicate_vectors


def brute(rows, cosine=0.9):
    ok = {}
    for i, v in rows:
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, float) / np.abs(v).max()
            ok[i] = v / np.linalg.norm(v)
    ids = sorted(ok)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = {i: 0 for i, _ in rows}
    for p, i in enumerate(ids):
        for j in ids[:p]:
            if len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (n[i], find(i), find(i) == i) for i, _ in rows}


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = list(rng.normal(size=(400, 16)))
    for spread, count in ((0.02, 150), (0.1, 60), (0.2, 60), (0.33, 40), (0.0, 30)):  # tight and loose groups, around the threshold
        base = rng.normal(size=16)
        rows += [(base / np.linalg.norm(base) + rng.normal(size=16) * spread) * rng.uniform(0.1, 9) if spread else base for _ in range(count)]
    out = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    out += [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, []), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (9008, [1e300, 1e300])]
    return out


def test_against_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows + rows[:2], "vec_id long, embedding array<double>").withColumn("i", F.lit(1)).withColumn("leader", F.lit("x"))
    want = brute(rows)
    for s in (Settings(), Settings(sample_leaders=3, chunk=32, block=16, neighbours=5)):
        got = near_duplicate_vectors(df, settings=s).collect()
        assert len(got) == len(rows) + 2
        links = sum(r.n_links for r in got)
        assert 0.98 * sum(w[0] for w in want.values()) <= links
        wrong = [r for r in got if (r.n_links, r.component_id, r.kept) != want[r.vec_id]]
        assert all(r.n_links <= want[r.vec_id][0] for r in got) and len(wrong) <= 0.02 * len(rows)


def test_no_rows(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def pairs_among(n, pairs, dim=64, cosine=0.91, seed=1):
    """n random vectors and for the first of them one partner each at that cosine."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    side = rng.normal(size=(pairs, dim))
    side -= (side * v[:pairs]).sum(axis=1, keepdims=True) * v[:pairs]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return [(i, [float(x) for x in row]) for i, row in enumerate([*v, *(cosine * v[:pairs] + (1 - cosine**2) ** 0.5 * side)])]


def result(spark, rows, s, report=None):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df, settings=s, report=report).collect()}


@pytest.mark.parametrize("n, pairs", [(300, 40), (1000, 3), (2000, 200)])
def test_lists_answer_at_every_size(spark, n, pairs):
    """Vectors without structure and isolated partners, the hardest case: the lists answer, from several chunks, and recall is what the audit says."""
    rows, report = pairs_among(n, pairs), {}
    got, want = result(spark, rows, Settings(), report), brute(rows)
    told = report[64]
    assert told["answer"] == "lists" and told["recall"] >= 0.99 and told["chunk"] < told["leaders"] / 3
    assert sum(g[0] for g in got.values()) >= 0.97 * sum(w[0] for w in want.values()) and all(got[i][0] <= w[0] for i, w in want.items())
    assert sum(got[i] != w for i, w in want.items()) <= 0.03 * 2 * pairs


def test_descent_that_falls_short_is_told(spark):
    weak = {"tables": 1, "chunk": 16, "rounds": 1, "neighbours": 2, "audits": 1, "audit_rows": 16}
    rows = pairs_among(1000, 60)
    with pytest.raises(RuntimeError, match="of the known near pairs"):
        result(spark, rows, Settings(**weak))
    with pytest.warns(UserWarning, match="less than 0.99"):
        got = result(spark, rows, Settings(**weak, least_recall=0.0))
    assert all(g[0] <= w[0] for g, w in zip((got[i] for i in sorted(got)), (w for _, w in sorted(brute(rows).items()))))
    report = {}
    assert result(spark, rows, Settings(**weak, exact=True), report) == brute(rows) and report[64]["answer"] == "all pairs"


def test_null_keys_and_one_dimension(spark):
    rows = [(None, [1.0, 0.0]), (5, [1.0, 0.01]), (None, [0.0, 1.0]), (7, [3.0]), (8, [5.0]), (9, [-1.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)
    assert got == sorted([(None, 1, 5, True), (5, 1, 5, True), (None, 0, None, True), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True)], key=str)


def test_coarse_products_are_within_their_slack():
    rng = np.random.default_rng(2)
    for dim in (1, 2, 64, 128, 384):
        signs = rng.choice([-1.0, 1.0], size=(40, dim))
        for rows in (signs, np.where(rng.random((40, dim)) < 0.04, -signs, signs), rng.normal(size=(40, dim)), rng.normal(size=(40, dim)) ** 5):
            u = rows / np.linalg.norm(rows, axis=1, keepdims=True)
            v, error = _from_coarse(_coarse(u))
            assert (np.abs(v @ v.T - u @ u.T) <= _slack(error[:, None], error[None, :], dim)).all() and error.max() < 0.05


def test_vectors_of_equal_sized_components(spark):
    rng = np.random.default_rng(4)
    rows = rng.choice([-1.0, 1.0], size=(40, 128))
    near = rows.copy()
    for r in near:
        r[rng.choice(128, 6, replace=False)] *= -1  # cosine 0.906
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*rows, *near])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = near_duplicate_vectors(df, settings=Settings()).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)
