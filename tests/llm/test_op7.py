import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyloom.llm.packing import packed, place_table, plan, sequences
from tallyloom.llm.tokens import WordEncoder, tokenizer_path


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece_once(seed):
    rnd = random.Random(seed)
    top = [2048, 300, 1100, 2047, 700, 2048][seed]
    counts = Counter(rnd.randint(1, top) for _ in range(rnd.choice([1, 50, 4000])))
    groups = plan(counts)
    held = Counter()
    for n, lengths in groups:
        assert n > 0 and 0 < sum(lengths) <= 2048
        for x in lengths:
            held[x] += n
    assert held == counts
    least = -(-sum(k * n for k, n in counts.items()) // 2048)
    halves = sum(n for k, n in counts.items() if k > 1024)
    assert sum(n for n, _ in groups) <= max(least, halves) * 1.02 + 1
    table = place_table(groups)
    assert (np.diff(table["key"]) > 0).all()


def test_plan_of_nothing():
    assert plan({}) == [] and len(place_table([])["key"]) == 0


TEXTS = ["", None, "a", "Plain, TEXT!!%% 12a3 ÄÖß\rx", "it's ok 'street", " a  b c　d é ́x ΣΑΣ", "<|endoftext|>", "<|startoftext|> hi<|endoftext|><|endoftext|>\n<|ENDOFTEXT|>", "l’été\n\n\tx", "word " * 9000, "word " * 9000, "x\x0by\x1cz"]


def test_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = [r.asDict() for r in packed(docs, with_ids=True).collect()]
    plain = Tokenizer.from_file(tokenizer_path())
    want = Counter((i, tuple(plain.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t, _ in rows)
    by = {}
    for r in got:
        assert r["length"] == len(r["ids"]) and r["start"] == 2048 * r["piece"]
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(TEXTS):
        if i != 2:
            assert (i, tuple(x for r in sorted(by[i], key=lambda r: r["piece"]) for x in r["ids"])) in want
    assert len(by[2]) == 2
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(len(r.ids) for r in sequences(packed(docs, with_ids=True)).collect()) == sum(r["length"] for r in got)


def test_empty(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_equal_the_tokenizer():
    import pyarrow as pa

    rnd = random.Random(5)
    chars = "abcdeABCDE  \n\t.,!'-0123éÉßÿ×µªΣς日本　́\x0b<|>"
    parts = [*chars, "<|startoftext|>", "<|endoftext|>", "<|endoftext", "|>"]
    texts = ["".join(rnd.choice(parts if n % 3 == 0 else chars) for _ in range(rnd.randint(0, 40))) for n in range(3000)]
    enc = WordEncoder(tokenizer_path())
    slots, sizes, ends, _ = enc.encode(pa.array(texts, pa.large_string()))
    ids = enc.ids(slots, sizes)
    want = Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)
    assert all(w.ids == ids[ends[i] : ends[i + 1]].tolist() for i, w in enumerate(want))
