import hashlib
import random
import zlib

import pytest

from tallyloom.llm import prefix_trie as P
from tallyloom.llm.op11_query import rebuilt
from tallyloom.llm.prefix_trie import prefix_trie, turn_places

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def plain_places(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    return {c: [(r[2], r[4]) for r in sorted(t)] for c, t in out.items()}


def plain_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    """Nodes by walking a dictionary of tuples."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[b] for b in below) if below else 1
        saved[path] = sum(saved[b] for b in below) + ((len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0)
    rows = []
    for path, ids in members.items():
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(path))))
        rows.append((min(ids), len(path), min(members[path[:-1]]) if path else None, len(ids), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def talk(n, seed=3, turns=(1, 3, 9, 40)):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        rows += [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bé", "", None])) for t in range(rnd.choice(turns))]
    return rows


def trie_of(spark, rows, extra=()):
    placed = turn_places(spark.createDataFrame(rows, SCHEMA).repartition(5))
    convs = placed.select("conv").distinct()
    return prefix_trie(placed, convs.unionByName(spark.createDataFrame([(c,) for c in extra], "conv long")) if extra else convs)


@pytest.mark.parametrize("block, chunk", [(1024, 4096), (4, 3), (2, 1)])
def test_against_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "CHUNK", chunk)
    rows = talk(60) + [(c, 0, "user", "hot") for c in range(100, 160)] + [(200, None, "user", "x"), (200, None, "user", "x"), (200, 5, "user", "y"), (200, 5, "user", "x"), (None, 1, "user", "lost"), (-7, 1, "a", "bc"), (-8, 1, "ab", "c")]
    want = plain_trie(plain_places(rows) | {500: [], 501: []})
    assert rows_of(trie_of(spark, rows, (500, 501))) == want


def test_rebuilt_against_brute_force(spark):
    rows = [r for r in talk(120, seed=9) if r[0] % 7]
    placed = turn_places(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert rows_of(prefix_trie(*rebuilt(placed))) == plain_trie(plain_rebuilt(plain_places(rows)))


def test_preorder_intervals(spark):
    nodes = trie_of(spark, talk(50)).collect()
    assert sorted(n.position for n in nodes) == list(range(1, len(nodes) + 1))
    root = next(n for n in nodes if n.depth == 0)
    assert (root.position, root.subtree_end) == (1, len(nodes))
    stack = []
    for n in sorted(nodes, key=lambda n: n.position):
        while stack and stack[-1].subtree_end < n.position:
            stack.pop()
        assert len(stack) == n.depth and (not stack or (n.subtree_end <= stack[-1].subtree_end and n.parent_conv_id == stack[-1].conv_id))
        stack.append(n)


def test_one_long_conversation_and_copies(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16)
    rows = [(1, t, "user", str(t % 3)) for t in range(3000)] + [(c, 0, "user", "0") for c in range(2, 600)]
    got = rows_of(trie_of(spark, rows))
    assert got == plain_trie(plain_places(rows)) and len(got) == 3001


def test_empty_and_long_texts(spark):
    assert trie_of(spark, []).collect() == []
    rows = [(1, 0, "user", "é" * 500_000), (2, 0, "user", "é" * 500_000), (2, 1, "user", "x")]
    assert rows_of(trie_of(spark, rows)) == plain_trie(plain_places(rows))


def test_other_columns_and_names(spark):
    rows = [(1, 0, "user", "a", 9, 9, 9), (2, 0, "user", "a", 8, 8, 8)]
    df = spark.createDataFrame(rows, "place long, depth long, role string, p1 string, conv long, _turn long, rank long")
    placed = turn_places(df, conv_id="place", turn="depth", text="p1")
    assert rows_of(prefix_trie(placed, placed.select("conv").distinct())) == plain_trie({1: [("user", "a")], 2: [("user", "a")]})
