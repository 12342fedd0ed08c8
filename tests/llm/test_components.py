import random

import pytest
from pyspark.sql import functions as F

from tallyloom.llm.components import connected_components


def plain(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def graphs():
    rnd = random.Random(3)
    path = [(i, i + 1) for i in range(40)]
    hub = [(500, 1000 + i) for i in range(300)] + [(900 + i, 500) for i in range(50)]
    loose = [(rnd.randrange(2000, 2400), rnd.randrange(2000, 2400)) for _ in range(220)]
    return path + hub + loose + hub[:20] + [(7, 7), (None, 3), (5000, 5000)]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_dealt_out_rounds_against_plain_union(spark, kind):
    edges = graphs()
    if kind == "string":
        edges = [tuple(None if x is None else f"n{x:05d}" for x in e) for e in edges]
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(7, F.rand(1))
    assert df.rdd.getNumPartitions() == 7
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == plain(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(1, 1)], "a long, b long"), "a", "b").count() == 0
