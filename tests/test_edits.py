import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallyloom.functions import edits, text
from tallyloom.operators import scoring
from tallyloom.plans.catalogue import QUERIES
from tallyloom.plans.score_queries import document_cases


def plain(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_long_answers_cost_no_product_of_their_lengths(spark):
    """Before, the first of these pairs took 60,000 x 60,000 steps, in characters and again in tokens."""
    rnd = random.Random(1)
    gold = "".join(rnd.choices("abcde fgh 你", k=60_000)).strip()
    shuffled = "".join(rnd.choices("abcde fgh 你", k=30_000)).strip()
    rows = [("a", [("0", gold)], [("0", gold.replace("e", "3"))]), ("b", [("0", gold)], [("0", shuffled)])]
    pairs = spark.createDataFrame(rows, "sample_id string, messages array<struct<message_id:string,text:string>>, p_messages array<struct<message_id:string,text:string>>")
    spark.range(1).select(text.mixed_distances(F.lit("a"), F.lit("b"))).collect()
    start = time.perf_counter()
    got = {r.sample_id: r for r in scoring.score_messages(pairs).collect()}
    assert time.perf_counter() - start < 15
    normal = " ".join(gold.split())
    assert got["a"].char_edits == normal.count("e") and got["a"].reference_characters == len(normal)
    assert 0 < got["b"].mixed_token_edits <= got["b"].reference_mixed_tokens


def test_distances_against_a_plain_one(spark):
    rnd, rows = random.Random(7), [("", ""), ("", "a b"), ("a", ""), ("ab", "ba"), ("a😀b", "a😀c"), (None, "a")]
    for _ in range(500):
        a = rnd.choices("ab1 e你　é😀,", k=rnd.randint(0, 16))
        b = [rnd.choice("abe3 ") if rnd.random() < 0.2 else x for x in a if rnd.random() > 0.1 * (len(a) % 2)]
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.mixed_distances("a", "b").alias("d"), F.levenshtein("a", "b").alias("n"), text.mixed_tokens(F.col("a")).alias("x"), text.mixed_tokens(F.col("b")).alias("y"), text.mixed_token_count(F.col("a")).alias("many"))
    for r in df.collect():
        assert r.d.characters == r.n
        assert r.a is None or (r.many == len(r.x) and r.d.tokens == plain(r.x, r.y) and r.d.characters == plain(r.a, r.b))


def test_codes_that_are_rare_and_common():
    rnd = random.Random(3)
    for codes in (range(3), range(400)):
        a, b = (np.array(rnd.choices(codes, k=n)) for n in (500, 430))
        assert edits.distance(a, b) == edits.distance(b, a) == plain(a.tolist(), b.tolist())


def test_scores_of_empty_answers(spark):
    rows = [("a", [("0", " x, y "), ("1", " ")], []), ("b", [("0", " "), ("1", "é")], [("0", "one  2"), ("1", "é\n")])]
    pairs = spark.createDataFrame(rows, "sample_id string, messages array<struct<message_id:string,text:string>>, p_messages array<struct<message_id:string,text:string>>")
    got = sorted((r.sample_id, r.message_id, r.exact, r.char_edits, r.reference_characters, r.mixed_token_edits, r.reference_mixed_tokens) for r in scoring.score_messages(pairs).collect())
    assert got == [("a", "0", False, 4, 4, 3, 3), ("a", "1", True, 0, 0, 0, 0), ("b", "0", False, 5, 0, 2, 0), ("b", "1", True, 0, 1, 0, 1)]


def test_blanks_at_the_ends_and_between(spark):
    rows = ["　 a \t b \x85", " \n a \n  b \x0b\n", "a b", "\t", "", None, "a   b", " \r\n"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(text.collapse_blanks(F.col("t"))).collect()]
    assert got == ["a b", "a\nb", "a b", "", "", None, "a   b", ""]


@pytest.fixture(scope="module")
def long_clauses(tmp_path_factory):
    """Documents whose texts are one clause each; the answer to document 3 has a 3 for each of its 20,000 letters e."""
    where = str(tmp_path_factory.mktemp("long"))
    texts = {3: "ab e" * 20_000, 7: "ab cd", 8: "x e", 10: None}
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": f"s{i}", "n_chars": len(t or "")} for i, t in texts.items()]
    schema = pa.schema({"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()})
    pq.write_table(pa.Table.from_pylist(rows, schema), f"{where}/documents.parquet")
    pq.write_table(pa.table({"doc_id": [3, 7, 8, 10], "quality": [0, 1, 0, 1], "toxic": [0, 0, 0, 0]}), f"{where}/labels.parquet")
    return where


@pytest.mark.parametrize("name", ["q01_cer_by_lang", "q02_score_grouping_sets", "q61_score_report"])
def test_queries_score_long_clauses(spark, long_clauses, name):
    """Before, 80,000 x 80,000 steps."""
    start = time.perf_counter()
    rows = QUERIES[name](spark, long_clauses).collect()
    assert time.perf_counter() - start < 30
    whole = next(r for r in rows if name.startswith("q01") or r.scope == "overall")
    assert whole.character_error_rate == (20_000 + 5) / (80_000 + 5 + 3) and whole.mixed_token_error_rate == (20_000 + 2) / (20_001 + 2 + 2)


def test_whole_texts_are_dealt(spark, long_clauses):
    plan = document_cases(spark, long_clauses)._jdf.queryExecution().optimizedPlan().toString()
    for below in re.split("RepartitionByExpression", plan)[1:]:
        assert "split(" not in below.split("Relation [")[0]


def test_bootstrap_of_long_clauses(spark, long_clauses):
    start = time.perf_counter()
    rows = {r.metric: r for r in QUERIES["q12_mt_bootstrap"](spark, long_clauses).collect()}
    assert time.perf_counter() - start < 30
    assert len(rows) == 12 and all(0 <= r.ci_low <= r.ci_high for r in rows.values()) and rows["character_error_rate"].ci_high <= 1
