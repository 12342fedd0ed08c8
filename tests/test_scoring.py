import hashlib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import rng, text
from tallyloom.functions.safety import findings, normalised
from tallyloom.operators import scoring, statistics
from tallyloom.plans import fixtures


def test_report_of_fixtures(spark):
    cases = scoring.score_cases(fixtures.gold(spark), fixtures.predictions(spark))
    by = {r.sample_id: r for r in cases.collect()}
    one, two, three = by["s1--v000"], by["s2--v000"], by["s3--v000"]
    assert (one.char_edits, one.exact_message_count, one.target_message_count, one.intent_exact) == (1, 1, 2, True)
    assert one.mixed_token_edits == 1 and one.reference_mixed_tokens == 11
    assert not one.entry_top1_exact and one.entry_topk_exact and not one.full_reconstruction_success  # the second rank doesn't mend the first
    assert two.char_edits == 4 and two.entry_top1_exact and two.predicted_live_entry_count == 1
    assert three.abstain and three.all_target_messages_exact and not three.platform_exact and not three.full_reconstruction_success
    report = {(r.scope, r.value): r for r in scoring.report(cases).collect()}
    assert report[("obfuscation_type", "swap")].case_count == 2 and ("obfuscation_type", None) not in report
    assert report[("overall", None)].case_count == 3
    assert report[("platform", "mail")].character_error_rate == 4.0  # not clipped
    assert report[("overall", None)].character_error_rate == pytest.approx(5 / (26 + 8 + 1))


def test_ids_and_defaults(spark):
    g, p = fixtures.gold(spark), fixtures.predictions(spark)
    extra = p.unionByName(p.where("sample_id = 's1--v000'")).unionByName(p.limit(1).withColumn("sample_id", F.lit("zz")))
    got = {r.kind: (r.n, r.first_ids) for r in scoring.id_differences(g, extra).collect()}
    assert got == {"unknown": (1, ["zz"]), "missing": (1, ["s3--v000"]), "duplicate": (1, ["s1--v000"])}
    task = {r.sample_id: r.p_platform for r in scoring.with_default_predictions(g, p, platform_of_task=True).collect()}
    assert task["s3--v000"] == "chat"


def test_target_messages(spark):
    df = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")], [("a", True), ("b", False)])], "g array<struct<message_id:string,text:string>>, s array<struct<message_id:string,transform:boolean>>")
    assert [tuple(m) for m in df.select(scoring.target_messages(F.col("g"), F.col("s"))).first()[0]] == [("a", "3")]


def test_strict_gate(spark):
    rows = [([(1, "a.b.test")], True), ([(2, "a.b.test"), (1, "x.b.test")], False), ([(1, "A.b.test")], False), ([(1, "https://a.b.test")], False), ([], False), ([(1, "a.b.test"), (1, "q")], False), ([(0, "q"), (1, "a.b.test")], False), ([(2, "a.b.test")], False), ([(1, None)], False)]
    df = spark.createDataFrame([(i, c, "a.b.test") for i, (c, _) in enumerate(rows)], "i int, c array<struct<rank:int,value:string>>, e string")
    got = {r.i: r.g for r in df.select("i", scoring.strict_top1_gate(F.col("c"), F.col("e")).alias("g")).collect()}
    assert [got[i] for i in range(len(rows))] == [w for _, w in rows]
    with pytest.raises(Exception, match="canonical"):
        df.select(scoring.strict_top1_gate(F.col("c"), F.lit("one.test"))).collect()


def test_null_gate_raises(spark):
    df = spark.createDataFrame([("V", "A", True), ("V", "A", False)], "d string, t string, g boolean")
    d, t = scoring.apply_gate(F.col("d"), F.col("t"), F.col("g"))
    assert [tuple(r) for r in df.select(d, t).collect()] == [("V", "A"), ("__BOTTOM__", "__BOTTOM__")]
    with pytest.raises(Exception, match="true or false"):
        df.select(*scoring.apply_gate(F.col("d"), F.col("t"), F.lit(None).cast("boolean"))).collect()


def plain_f1(pairs, labels):
    out = []
    for x in labels:
        tp = sum(g == x and p == x for g, p in pairs)
        fp, fn = sum(g != x and p == x for g, p in pairs), sum(g == x and p != x for g, p in pairs)
        out.append(2 * tp / (2 * tp + fp + fn) if tp else 0.0)
    return sum(out) / len(out)


def test_macro_f1_fixed_labels(spark):
    assert plain_f1([("a", "a")], "abc") == pytest.approx(1 / 3)
    rnd = random.Random(1)
    pairs = [(rnd.choice("abcx"), rnd.choice("abc_")) for _ in range(200)]
    df = spark.createDataFrame(pairs, "g string, p string")
    assert df.agg(statistics.macro_f1(F.col("g"), F.col("p"), ("a", "b", "c"))).first()[0] == pytest.approx(plain_f1(pairs, "abc"), abs=1e-12)


def test_paired_bootstrap_is_row_resampling(spark):
    df = fixtures.paired(spark)
    rows = [r.asDict() for r in df.orderBy("model", "ordinal").collect()]
    draws = rng.twister_draws(spark, seeds=statistics.model_seeds(df, 7), replicates=40, size=12)
    got = {(r.model, r.metric): (r.point, r.ci_low, r.ci_high) for r in statistics.paired_bootstrap(df, draws, ("A", "B")).collect()}

    def accuracy(part, prefix):
        return sum(r["gold_decision"] == r[f"{prefix}_pred_decision"] for r in part) / len(part)

    for k, model in enumerate(("model0", "model1")):
        own, twister, values = [r for r in rows if r["model"] == model], random.Random(7 + k), []
        for _ in range(40):
            part = [own[twister.randrange(12)] for _ in own]
            values.append(accuracy(part, "web") - accuracy(part, "gated"))
        values.sort()
        want = (accuracy(own, "web") - accuracy(own, "gated"), values[round(39 * 0.025)], values[round(39 * 0.975)])
        assert got[(model, "gate_loss")] == pytest.approx(want, abs=1e-12)


def test_percentiles(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8, 16)], "x double")
    assert df.agg(statistics.percentile_linear(F.col("x"), 0.025)).first()[0] == pytest.approx(1.1)
    many = spark.range(2000)
    assert many.agg(statistics.percentile_nearest(F.col("id"), 0.975)).first()[0] == 1949
    assert many.where("false").agg(statistics.percentile_linear(F.col("id"), 0.5)).first()[0] is None


def test_hash_numbers(spark):
    seed = hashlib.sha256(b"g|1").digest()
    want = [int.from_bytes(hashlib.sha256(seed + i.to_bytes(8, "big")).digest()[:8], "big") for i in range(5)]
    got = [int(r[0]) for r in spark.range(5).select(rng.u64(rng.seed_hex(F.lit("g|1")), F.col("id"))).collect()]
    stream = rng.Stream("g|1")
    assert got == want == [stream.u64() for _ in range(5)]
    assert rng.threshold(0.72) == int(0.72 * 2**64)
    assert [r[0] for r in spark.range(5).select(rng.happens(rng.u64(rng.seed_hex(F.lit("g|1")), F.col("id")), 0.72)).collect()] == [w < int(0.72 * 2**64) for w in want]
    with pytest.raises(ValueError):
        rng.Stream("x").below(0)


def test_text_functions(spark):
    rows = ["  a\t b \n  c ", "é x", "你好, World-42"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    norm = [r[0] for r in df.orderBy("i").select(text.normal_text(F.col("t"))).collect()]
    assert norm == ["a b\nc", unicodedata.normalize("NFC", "é x"), "你好, World-42"]
    assert df.where("i = 2").select(text.mixed_tokens(F.col("t"))).first()[0] == ["你", "好", ",", "World", "-", "42"]
    assert df.limit(1).select(text.folded(F.lit("Ｓtraẞe  x"))).first()[0] == "strasse x"
    edits = lambda a, b: df.limit(1).select(text.token_edits(F.array(*map(F.lit, a)).cast("array<string>"), F.array(*map(F.lit, b)).cast("array<string>"))).first()[0]
    assert edits("kitten", "sitting") == 3 and edits([], ["a"]) == 1 and edits(["long", "x"], ["x", "long"]) == 2
    assert df.limit(1).select(text.slug(F.lit("..a b/c--"))).first()[0] == "a_b_c"
    assert df.limit(1).select(text.slug(F.lit("//"))).first()[0] == "model"
    assert df.limit(1).select(text.aware_timestamp(F.lit("2026-01-01T00:00:00"))).first()[0] is None
    assert df.limit(1).select(text.aware_timestamp(F.lit("2026-01-01T00:00:00Z"))).first()[0] is not None


@pytest.mark.parametrize("value, want", [
    ("HTTPS://Example.TEST.:443/a?b#c", ("https://example.test/a?b#c", "https", "example.test", "", "/a", "b", "c")),
    ("one.test", ("https://one.test/", "https", "one.test", "", "/", "", "")),
    ("[MASKED_SITE_A1]", ("[MASKED_SITE_A1]", "", "[MASKED_SITE_A1]", "", "", "", "")),
    ("a[.]b", ("a[.]b", "", "a[.]b", "UNPARSEABLE", "", "", "")),
    ("http://x.test:99999/", ("http://x.test:INVALID/", "http", "x.test", "INVALID", "/", "", "")),
])
def test_entries(value, want):
    assert text.parsed_entry(value) == want


@pytest.mark.parametrize("value, want", [("localhost", True), ("http://127.0.0.1/", True), ("a.example.org", True), ("evil.com", False), ("x[.]test", False), ("[MASKED_URL]", True), ("b.invalid", True)])
def test_reserved(value, want):
    assert text.reserved_value(value) is want


def test_model_json_and_envelope(spark):
    rows = ['{"a": 1}', 'x ```json\n{"a": 2}\n``` y', "say {\"a\": 3} end", "[1]", "none"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    assert [r[0] for r in df.orderBy("i").select(text.json_object(F.col("c"))).collect()] == ['{"a":1}', '{"a":2}', '{"a":3}', None, None]
    e = text.envelope(F.lit('{"choices":[{"message":{"content":"hi"}}],"usage":{"prompt_tokens":3}}'))
    assert tuple(df.limit(1).select(e["content"], e["prompt_tokens"], e["model"]).first()) == ("hi", 3, None)


def test_safety_findings():
    kinds = lambda t: [(k, v) for k, v, _, _ in findings(t)]
    assert kinds("go to hxxps://evil[.]com/x now") == [("LIVE_DOMAIN", "evil.com")]
    assert kinds("see http://ok.test/ and localhost and 127.0.0.1 and [MASKED_SITE]") == []
    assert kinds("mail a.b@shop.co") [0] == ("EMAIL_ADDRESS", "a.b@shop.co")
    assert ("IP_ADDRESS", "8.8.8.8") in kinds("at 8.8.8.8")
    assert ("PHONE_OR_ACCOUNT_NUMBER", "13812345678") in kinds("call 138 1234 5678")
    assert ("BANK_OR_ID_NUMBER", "6222020200112230") in kinds("card 6222 0202 0011 2230")
    assert ("ENCODED_LIVE_ENTRY", "aHR0cDovL2V2aWwuY29tL3g=") in kinds("x aHR0cDovL2V2aWwuY29tL3g= y")
    assert kinds("evil dot com") == [("LIVE_DOMAIN", "evil.com")] and kinds("e​vil。com") == [("LIVE_DOMAIN", "evil.com")]
    assert normalised("a%2Eb") == "a.b"


@pytest.mark.parametrize("value, want", [
    ("at 2001:db8::8a2e:370:7334 now", ("IP_ADDRESS", "2001:db8::8a2e:370:7334")), ("at [2001:db8::1] now", ("IP_ADDRESS", "[2001:db8::1]")), ("evil[ . ]com", ("LIVE_DOMAIN", "evil.com")),
    ("evil 点 com", ("LIVE_DOMAIN", "evil.com")), ("abc[点]com", ("LIVE_DOMAIN", "abc.com")), ("call 13 812345678", ("PHONE_OR_ACCOUNT_NUMBER", "13812345678")),
    ("call (010) 8123 4567", ("PHONE_OR_ACCOUNT_NUMBER", "01081234567")), ("微信号：abc12", ("ACCOUNT_IDENTIFIER", "abc12")), ("e v i l . c o m", ("LIVE_DOMAIN", "evil.com")),
    ("打开 例子。公司", ("LIVE_DOMAIN", "例子.公司")), ("add wx12345678", ("ACCOUNT_IDENTIFIER", "wx12345678")), ("mail a@b.io", ("EMAIL_ADDRESS", "a@b.io")), ("http://2130706434/", None),
    ("http://2147483649/", ("LIVE_DOMAIN", "2147483649")), ("他说。好的", None), ("HXXPS://evil.com/x", ("LIVE_DOMAIN", "evil.com")), ("例え.test", None),
])
def test_each_family_finds(value, want):
    got = [(k, v) for k, v, _, _ in findings(value)]
    assert (want in got) if want else got == []


def test_schemes_are_put_right_in_lower_case():
    assert normalised("HXXPS://a hxxp://b Hxxps://c") == "https://a http://b https://c"


def test_duplicate_predictions_fail(spark):
    g = spark.createDataFrame([("a", "x")], "sample_id string, platform string")
    p = spark.createDataFrame([("a",), ("a",)], "sample_id string").selectExpr("sample_id", "'v' input_view", "'x' platform", "'i' intent", "false abstain", f"cast(array() as {scoring.MESSAGES}) messages", f"cast(array() as {scoring.CANDIDATES}) candidates")
    pairs = scoring.with_default_predictions(g, p)
    for read in (lambda: pairs.collect(), lambda: pairs.count(), lambda: pairs.select("platform").collect(), lambda: scoring.score_messages(pairs.withColumn("messages", F.col("p_messages"))).count()):
        with pytest.raises(Exception, match="duplicate prediction: a"):
            read()


def test_unknown_and_missing_predictions(spark):
    g = spark.createDataFrame([("a", "x"), ("b", "x")], "sample_id string, platform string")
    p = lambda *ids: spark.createDataFrame([(i,) for i in ids], "sample_id string").selectExpr("sample_id", "'v' input_view", "'x' platform", "'i' intent", "false abstain", f"cast(array() as {scoring.MESSAGES}) messages", f"cast(array() as {scoring.CANDIDATES}) candidates")
    with pytest.raises(Exception, match="unknown sample_id: zz"):
        scoring.with_default_predictions(g, p("a", "zz")).count()
    assert scoring.with_default_predictions(g, p("a", "zz"), unknown=True).count() == 2
    with pytest.raises(Exception, match="missing prediction: b"):
        scoring.with_default_predictions(g, p("a"), allow_missing=False).count()
    assert scoring.with_default_predictions(g, p("a", "b"), allow_missing=False).where("NOT prediction_missing").count() == 2


def test_token_edits_against_a_plain_distance(spark):
    import random

    rnd, rows = random.Random(6), []
    for _ in range(400):
        a = rnd.choices("abcd", k=rnd.randint(0, 12))
        b = [x for x in a if rnd.random() > 0.2]
        for _ in range(rnd.randint(0, 3)):
            b.insert(rnd.randint(0, len(b)), rnd.choice("abz"))
        rows.append((a, b))

    def plain(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last = _row(last, i, x, b)
        return last[-1]

    def _row(last, i, x, b):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row

    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", text.token_edits(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == plain(r.a, r.b) for r in got)


def test_redaction_order_and_limit(spark):
    shown = lambda t, **k: spark.createDataFrame([(t,)], "t string").select(text.redacted(F.col("t"), **k)).first()[0]
    assert shown("a  www.x.y/z b@shop.io\n10.0.0.1 c@d.edu") == "a [MASKED_URL] b@[MASKED_DOMAIN] [MASKED_IP] [MASKED_EMAIL]"
    assert len(shown("x" * 500)) == 180 and len(shown("x" * 500, limit=None)) == 500


def test_bootstrap_draws_as_many_sources_as_there_are(spark, tmp_path):
    import hashlib

    from tallyloom.plans.catalogue import QUERIES

    for n in (3, 25):
        docs = [(i, f"s{i % n:02d}", 100) for i in range(4 * n)]
        labels = [(i, 0, int(i % n >= n - 5 and i < 2 * n)) for i in range(4 * n)]  # the last sources lose half by the gate
        where = str(tmp_path / str(n))
        spark.createDataFrame(docs, "doc_id long, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
        at = lambda i: int(hashlib.md5(f"paired:{i}".encode()).hexdigest()[:12], 16) % n  # noqa: B023, E731, S324
        v = sorted(sum(at(r * n + k) >= n - 5 for k in range(n)) / (2 * n) for r in range(300))
        got = QUERIES["q11_paired_bootstrap"](spark, where).first()
        assert (got.ci_low, got.ci_high) == (round(v[round(299 * 0.025)], 9), round(v[round(299 * 0.975)], 9))


def test_report_makes_its_cases_once_and_texts_of_plain_letters_stay_out_of_python(spark):
    from tallyloom.functions.text import normal_text

    cases = scoring.score_cases(fixtures.gold(spark), fixtures.predictions(spark))
    plan = scoring.report(cases)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("levenshtein(") == cases.agg(F.sum("char_edits"), F.sum("mixed_token_edits"))._jdf.queryExecution().optimizedPlan().toString().count("levenshtein(")
    nothing = {(r.scope, r.value, r.case_count, r.character_error_rate) for r in scoring.report(cases.where("false")).collect()}
    assert nothing == {("overall", None, 0, 0.0)}
    texts = spark.createDataFrame([("e\u0301 a\u00a0b",), ("  \u00e9\u00df x ",), ("\u1100\u1161",), (None,)], "t string")
    assert [r[0] for r in texts.select(normal_text(F.col("t"))).collect()] == ["\u00e9 a\u00a0b", "\u00e9\u00df x", "\uac00", None]
