import hashlib
import random

from tallyloom.llm.chat_format import format_chats, read_back

NASTY = ["", None, "</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "<|turn|>", "&lt; &amp; &#91; &#124;", "a\nb", "é😀 ", "<", "&", "|>", "x" * 30000]


def test_round_trip(spark):
    rnd = random.Random(1)
    rows = []
    for c in range(40):
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant", "assistant", "sys|>tem&", None]), rnd.choice(NASTY)))
    rows += [(None, 0, "user", "a"), (50, None, "assistant", "b"), (50, None, "assistant", "b"), (50, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, pieces int, formatted string")
    got = {r.conv_id: r for r in read_back(format_chats(df)).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert list(got[c].loss_texts) == [t for r, t in turns if r == "assistant"]
        marks = got[c].formatted
        assert marks.count("<|end|>\n") == sum(1 for i, (r, _) in enumerate(turns) if i == 0 or turns[i - 1][0] != r)
        assert "[INST]" not in marks and "</s>" not in marks


def test_one_long_conversation(spark):
    df = spark.range(3000).selectExpr("7L conv_id", "id turn", "IF(id % 3 = 0, 'user', 'assistant') role", "concat('t', id) text")
    r = read_back(format_chats(df)).first()
    assert len(r.turns) == 3000 and hashlib.sha256("".join(r.loss_texts).encode()).hexdigest() == hashlib.sha256("".join(f"t{i}" for i in range(3000) if i % 3).encode()).hexdigest()


def test_one_very_long_conversation_takes_time_in_proportion(spark):
    df = spark.range(60_000).selectExpr("7L conv_id", "id turn", "IF(id % 3 = 0, 'user', 'assistant') role", "concat('t<', id) text")
    r = format_chats(df).first()
    assert len(r.loss_spans) == 40_000
    for i, s in ((1, r.loss_spans[0]), (59_999, r.loss_spans[-1])):
        assert r.formatted[s.start : s.start + s.len] == f"t&lt;{i}"


def test_a_text_of_several_megabytes(spark):
    text = "<é[" * 1_000_000
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    assert read_back(format_chats(df)).first().loss_texts == [text]


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
