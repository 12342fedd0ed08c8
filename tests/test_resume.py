import json

import pytest
from pyspark.sql import functions as F

from tallyloom.streaming import resume

SCHEMA = "k string, fp string, n long"


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", resume.ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(("k", "fp", "n"), r))) + "\n" for r in rows))


def start(spark, tmp_path, process=lambda df: df.withColumn("twice", F.col("n") * 2)):
    rows = resume.attempts_stream(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1)
    return resume.run_once_per_key(rows, process, str(tmp_path / "out"), key="k", fingerprint="fp", order="n", checkpoint=str(tmp_path / "ck"))


def run(spark, tmp_path, **more):
    query = start(spark, tmp_path, **more)
    query.awaitTermination()
    return query


def results(spark, tmp_path):
    return sorted((r.k, r.n, r.twice) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_each_key_once_and_a_batch_costs_its_own_rows(rocks, tmp_path):
    put(tmp_path / "in", "a.json", [("x", "f", 3), ("x", "f", 1), ("y", "f", 2)] + [("hot", "f", i) for i in range(5000)])
    run(rocks, tmp_path)
    assert results(rocks, tmp_path) == [("hot", 0, 0), ("x", 1, 2), ("y", 2, 4)]
    put(tmp_path / "in", "b.json", [("y", "f", 0), ("z", "f", 7)])
    query = run(rocks, tmp_path)
    assert results(rocks, tmp_path) == [("hot", 0, 0), ("x", 1, 2), ("y", 2, 4), ("z", 7, 14)]
    last = [p for p in query.recentProgress if p["numInputRows"]][-1]
    assert last["numInputRows"] == 2 and len(last["sources"]) == 1  # the sink is no source
    assert last["stateOperators"][0]["numRowsTotal"] == 4


def test_a_run_that_dies_is_taken_up(rocks, tmp_path):
    for i in range(3):
        put(tmp_path / "in", f"{i}.json", [(f"k{j}", "f", j) for j in range(i, i + 4)])
    dies = lambda df: df.withColumn("twice", F.when(F.col("k") == "k5", F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("n") * 2))
    with pytest.raises(Exception, match="killed"):
        run(rocks, tmp_path, process=dies)
    run(rocks, tmp_path)
    assert results(rocks, tmp_path) == [(f"k{j}", j, 2 * j) for j in range(6)]


def test_another_configuration_fails(rocks, tmp_path):
    put(tmp_path / "in", "a.json", [("x", "f", 1)])
    run(rocks, tmp_path)
    put(tmp_path / "in", "b.json", [("x", "g", 2)])
    with pytest.raises(Exception, match="another configuration"):
        run(rocks, tmp_path)
