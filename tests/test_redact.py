"""Redaction of texts in which entries stand beside other letters, against DuckDB."""

import duckdb

from tallyloom.plans.catalogue import ORACLES, QUERIES


def test_entries_beside_letters_beyond_ascii(spark, tmp_path):
    texts = ["请打开example.com看", "éwww.one.test/a b", "éa.com", "mailéb@c.orgé x", "a.comx b.com_ .c@d.io", "1.2.3.4, 5.6.7.8", "1.2.3.4 5.6.7.8 9.9.9.9", "8.8.8.8", None, ""]
    spark.createDataFrame([(i, f"l{i}", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = QUERIES["q31_redact"](spark, str(tmp_path))
    want = con.execute(ORACLES["q31_redact"])
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())
