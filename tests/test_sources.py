import hashlib
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import files, records
from tallyloom.streaming import resume


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "é\n", None), (1, "a", True)], "b long, a string, c boolean")
    records.write_jsonl(df, f"{tmp_path}/x", order=["b"], single=True)
    lines = "".join(p.read_text() for p in (tmp_path / "x").glob("part*"))
    assert lines == '{"a":"a","b":1,"c":true}\n{"a":"é\\n","b":2,"c":null}\n'
    assert sorted(map(tuple, records.read_jsonl(spark, f"{tmp_path}/x", "b long, a string, c boolean").collect()), key=str) == [(1, "a", True), (2, "é\n", None)]
    with pytest.raises(Exception, match="already exists"):
        records.write_jsonl(df, f"{tmp_path}/x")


def test_jsonl_strict_blank_and_empty(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n  \n{"a": 2}\n')
    got = records.read_jsonl(spark, f"{tmp_path}/a.jsonl", "a int", line_numbers=True)
    assert [tuple(r) for r in got.orderBy("line_no").collect()] == [(1, 1), (4, 2)]
    (tmp_path / "bad.jsonl").write_text("[1]\nno json\n")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        records.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "a int").collect()
    assert [r.is_object for r in records.read_variant_lines(spark, f"{tmp_path}/a.jsonl").collect()] == [True, True]
    (tmp_path / "none.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="no records"):
        records.read_jsonl(spark, f"{tmp_path}/none.jsonl", "a int", allow_empty=False)


def test_env_and_words(spark, tmp_path):
    (tmp_path / "env").write_text("# c\n\nexport A='x=y'\nB=2\n")
    assert sorted(map(tuple, records.read_env(spark, f"{tmp_path}/env").collect())) == [("A", "x=y"), ("B", "2")]
    (tmp_path / "env2").write_text("no equals\n")
    with pytest.raises(Exception, match="KEY=value"):
        records.read_env(spark, f"{tmp_path}/env2").collect()
    (tmp_path / "w.tsv").write_text("block_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\ttext\n1\t1\t1\t1\t5\t6\t7\t8\thi\n1\t1\t1\t2\tx\t6\t7\t8\tno\n1\t1\t1\t3\t5\t6\t7\t8\t \n")
    assert [tuple(r) for r in records.read_word_table(spark, f"{tmp_path}/w.tsv").collect()] == [("hi", 5, 6, 7, 8, "1/1/1", 1)]


def test_manifest_bijection(spark, tmp_path):
    root = tmp_path / "r"
    (root / "d").mkdir(parents=True)
    (root / "__pycache__").mkdir()
    (root / "__pycache__/x.py").write_text("no")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for name, text in (("a.txt", "one"), ("d/b.txt", "two"), ("c.txt", "three")):
        (root / name).write_text(text)
    actual = files.digests(files.list_files(spark, str(root), content=True))
    assert {r.path for r in actual.collect()} == {"a.txt", "d/b.txt", "c.txt"}
    (tmp_path / "m").write_text(f"{sha('one')}  a.txt\n{sha('bad')}  d/b.txt\n{sha('x')}  gone.txt\n")
    m = files.read_manifest(spark, f"{tmp_path}/m")
    assert {tuple(r) for r in files.manifest_differences(m, actual).collect()} == {("d/b.txt", "digest"), ("gone.txt", "missing"), ("c.txt", "unlisted")}
    assert ("c.txt", "unlisted") not in {tuple(r) for r in files.manifest_differences(m, actual, subset=True).collect()}
    assert tuple(files.manifest_totals(actual).first()) == (3, 11)
    for bad in ("/abs", "../up"):
        (tmp_path / "b").write_text(f"{sha('one')}  {bad}\n")
        with pytest.raises(Exception, match="bad manifest"):
            files.read_manifest(spark, f"{tmp_path}/b").collect()


def test_archive_and_images(spark, tmp_path):
    sha = hashlib.sha256(b"row\n").hexdigest()
    for name, digest in (("ok.zip", sha), ("bad.zip", "0" * 64)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("data.jsonl", "row\n")
            z.writestr("PACKAGE_MANIFEST.sha256", f"{digest}  data.jsonl\n")
    got = {r.name: r.sha256 for r in files.archive_members(spark, f"{tmp_path}/ok.zip").collect()}
    assert got["data.jsonl"] == sha
    with pytest.raises(Exception, match="digest"):
        files.archive_members(spark, f"{tmp_path}/bad.zip").collect()
    (tmp_path / "i").mkdir()
    (tmp_path / "i/x.png").write_bytes(bytes.fromhex(files.PNG) + b"rest")
    assert files.data_urls(files.list_files(spark, f"{tmp_path}/i", content=True)).first().url.startswith("data:image/png;base64,iVBORw0KGg")


def test_resumable_stream(spark, tmp_path):
    src, out, ck = (f"{tmp_path}/{x}" for x in ("in", "out", "ck"))
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").coalesce(1).write.json(src)
    run = lambda: resume.run_available(resume.attempts_stream(spark, src, "k string, v int"), lambda df: df.withColumn("w", F.col("v") * 10), out, key="k", checkpoint=ck).awaitTermination()
    run()
    spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int").coalesce(1).write.mode("append").json(src)
    run()
    run()
    assert sorted((r.k, r.w) for r in spark.read.parquet(out).collect()) == [("a", 10), ("b", 20), ("c", 30)]


def test_stream_windows(spark, tmp_path):
    rows = [("click", "2024-01-01 00:10:00", 1.0), ("click", "2024-01-01 00:50:00", 2.0), ("view", "2024-01-01 01:10:00", 4.0)]
    spark.createDataFrame(rows, "event_type string, ts string, value double").selectExpr("event_type", "to_timestamp(ts) ts", "value").write.parquet(f"{tmp_path}/e")
    s = spark.readStream.schema("event_type string, ts timestamp, value double").parquet(f"{tmp_path}/e")
    q = resume.event_windows(s).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("w").collect()) == [("click", 2, 3.0), ("view", 1, 4.0)]
