import math
import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.statistics import exact_percentiles

QS = {"p0": 0.0, "p025": 0.025, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def plain(values, nearest):
    v, n = sorted(values), len(values) - 1
    if nearest:
        return [v[round(n * q)] for q in QS.values()]
    return [v[math.floor(n * q)] + (0.0 if math.floor(n * q) == math.ceil(n * q) else (v[math.ceil(n * q)] - v[math.floor(n * q)]) * (n * q - math.floor(n * q))) for q in QS.values()]


@pytest.mark.parametrize("nearest", [False, True])
def test_against_sorted_lists(spark, nearest):
    rnd = random.Random(2)
    groups = {
        "wide": [rnd.uniform(-1, 1) * 10 ** rnd.randint(-300, 300) for _ in range(500)], "one": [3.5], "two": [2.0, 1.0], "ties": [rnd.choice([0.0, -0.0, 1e-310, 5.0]) for _ in range(400)],
        "close": [1.0 + i * 2**-52 for i in range(300)] + [1e300, -1e300], None: [float(i) for i in range(11)], "ends": [math.inf, -math.inf, 0.0, 1.0, 2.0, 3.0, 4.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    rnd.shuffle(rows)
    got = {r.k: [r[q] for q in QS] for r in exact_percentiles(spark.createDataFrame(rows, "k string, v double").repartition(5), by="k", value="v", qs=QS, nearest=nearest).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        want = plain(vs, nearest)
        assert all(a == b or (math.isnan(a) and math.isnan(b)) for a, b in zip(got[k], want)), (k, got[k], want)


def test_values_beside_an_outlier(spark):
    """Four million values and one of 1e300 are selected exactly."""
    n = 4_000_000
    rows = spark.range(n, numPartitions=16).select(F.lit(1).alias("k"), F.when(F.col("id") == 7, 1e300).otherwise(F.rand(3)).alias("v")).cache()
    got = exact_percentiles(rows, by="k", value="v", qs={"p50": 0.5, "p100": 1.0}, nearest=True).first()
    assert got.p100 == 1e300 and rows.where(F.col("v") < got.p50).count() == round((n - 1) * 0.5)
    assert rows.where(F.col("v") == got.p50).count() >= 1


def test_empty(spark):
    assert exact_percentiles(spark.createDataFrame([], "k string, v double"), by="k", value="v", qs=QS).collect() == []
