"""Near-duplicate vectors by NN-descent on balls.

Dong et al., "Efficient k-nearest neighbor graph construction for generic similarity
measures" (2011): a neighbour graph gets better by comparing neighbours of neighbours.

1. Equal unit vectors are one node with a multiplicity. 2. Nodes within half the linking angle
of a leader make its ball; all nodes of a ball are linked with each other, so that a hot group
of copies is one ball and its pairs are counted, not listed. 3. NN-descent over leaders: lists
start from sorted random projections; a local join compares the neighbours of each leader, new
ones with all; a list keeps the best few and every neighbour near enough to matter, so it is
enlarged when saturated. 4. An audit after each round measures recall on known near pairs: a bounded sample of leaders, each
with a planted partner within the linking angle that takes part in the descent like any leader, and the brute-force
partners of a second bounded sample. Descent ends when recall is reached; else more projections, longer lists and more rounds
follow, and at last the query fails. All pairs are compared only on request. 5. Kept edges of leaders are
checked in double precision: by their angle and the balls' radii either all members of two balls
are linked, or none, or the members are compared in blocks. 6. Components of linked balls.
"""

from __future__ import annotations

import hashlib
import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import Written, scratch
from tallyloom.llm.components import connected_components
from tallyloom.llm.vectors import finite_rows, from_binary, to_binary


@dataclass(frozen=True)
class Settings:
    """sample_leaders: bound of the sample that is collected and broadcast. chunk, tables: leaders that a first list is chosen from, and orders of them;
    if not given, they come from the number of leaders (see sized).

    planted, audit_rows: leaders that get a planted partner, and leaders that are compared with all. With 300 planted pairs and none missed,
    recall is 0.99 or more with 95 % confidence. audit_recall ends the descent; after `audits` attempts a recall of least_recall is enough, with a warning.
    exact: all pairs of leaders are compared instead, whatever it costs.
    """

    cosine: float = 0.9
    neighbours: int = 8
    tables: int | None = None
    chunk: int | None = None
    rounds: int = 4
    sample_leaders: int = 256
    planted: int = 300
    audit_rows: int = 256
    audit_recall: float = 0.99
    least_recall: float = 0.9
    audits: int = 4
    exact: bool = False
    block: int = 1024
    seed: int = 3

    def sized(self, n: int) -> Settings:
        """chunk grows with the root of the leaders' number, so that small tables have several chunks too. Two vectors at the linking angle fall into one chunk where all of log2(n / chunk)
        random planes leave them on one side; there are so many tables that 0.99 of such pairs meet in one, 128 at most: descent and the audit do the rest."""
        chunk = self.chunk or min(512, max(16, 4 * math.isqrt(n)))
        meet = (1 - self.angle / math.pi) ** max(0.0, math.log2(max(n, 1) / chunk))
        tables = self.tables or min(128, max(3, math.ceil(math.log(0.01) / math.log1p(-min(meet, 0.999)))))
        return replace(self, chunk=chunk, tables=tables)

    @property
    def angle(self) -> float:
        return math.acos(self.cosine)


#: Angles are compared with this slack, so that rounding never makes a bound lie.
SLACK = 1e-7
#: Leaders that are broadcast at a time, in numbers of 8 bytes, and leaders that they meet at a time.
GROUP, MEET = 1 << 20, 256


def _units(df: DataFrame, key: str, vector: str) -> DataFrame:
    """_id, _node (128-bit digest), _dim, _unit (float64) for all rows; null where a vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, dims, unit = [None] * len(batch), [0] * len(batch), [None] * len(batch)
            for at, m in finite_rows(batch.column(1)):
                if m.shape[1] == 0:
                    continue
                m = m / np.maximum(np.abs(m).max(axis=1, keepdims=True), np.finfo(float).tiny)
                size = np.sqrt((m * m).sum(axis=1, keepdims=True))
                for i, row, s in zip(at, m / np.maximum(size, np.finfo(float).tiny) + 0.0, size[:, 0], strict=True):
                    if s > 0:
                        raw = row.tobytes()
                        node[i], dims[i], unit[i] = hashlib.blake2b(raw, digest_size=16).digest(), m.shape[1], raw
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.binary()), pa.array(dims, pa.int32()), pa.array(unit, pa.binary())], names=["_id", "_node", "_dim", "_unit"])

    slim = df.select(key, vector)
    return slim.mapInArrow(run, f"_id {slim.schema[key].dataType.simpleString()}, _node binary, _dim int, _unit binary")


def _grouped(df: DataFrame, cols: tuple[str, ...], solve: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """solve() for each group of cols, streamed from sorted partitions; a group must fit into memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def out() -> Iterator[pa.RecordBatch]:
            got = solve(pa.Table.from_batches(held))
            if got is not None and got.num_rows:
                yield got

        for batch in batches:
            if not len(batch):
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(cols))), strict=True))
            start = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or keys[i] != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if i < len(keys):
                        if held:
                            yield from out()
                        held, start, last = [], i, keys[i]
        if held:
            yield from out()

    rest = [c for c in df.columns if c not in cols]
    return df.select(*cols, *rest).repartition(*cols).sortWithinPartitions(*cols).mapInArrow(run, schema)


def balls(nodes: DataFrame, s: Settings) -> DataFrame:
    """nodes (_node, m, least, _unit) with leader, its own node for most, and the cosine to it."""
    half = math.cos(s.angle / 2 - SLACK)
    picked: list[tuple[bytes, np.ndarray]] = []
    for r in nodes.orderBy(F.xxhash64("_node", F.lit(s.seed)), "_node").limit(s.sample_leaders).select("_node", "_unit").collect():
        u = np.frombuffer(r._unit)
        if all(u @ v < half for _, v in picked):
            picked.append((bytes(r._node), u))
    heads = np.stack([v for _, v in picked]) if picked else np.zeros((0, 1))
    names = [n for n, _ in picked]
    bits = min(62, max(4, math.ceil(math.log2(max(nodes.count(), 2)))))
    planes = np.random.default_rng(s.seed).normal(size=(heads.shape[1], bits))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            u = from_binary(batch.column(3), "<f8")
            c = u @ heads.T
            hit = c >= half
            at = hit.argmax(axis=1)
            got = hit[np.arange(len(u)), at]
            sig = ((u @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64))
            leader = pa.array([names[j] if g else None for j, g in zip(at, got, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, leader, pa.array(np.where(got, c[np.arange(len(u)), at], 1.0)), pa.array(sig)], names=["_node", "m", "least", "_unit", "leader", "near", "sig"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    one = Written(nodes.mapInArrow(first, f"{kinds}, leader binary, near double, sig bigint"), "balls-1").df
    free = one.where("leader IS NULL")
    lead = free.groupBy("sig").agg(F.min(F.struct("_node", "_unit")).alias("head"), F.count("*").alias("c")).where("c > 1").select("sig", F.col("head._node").alias("_h"), F.col("head._unit").alias("_hu"))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leader, near = batch.column(0).to_pylist(), np.ones(len(batch))
            other = np.flatnonzero(pc.fill_null(pc.not_equal(batch.column(4), batch.column(0)), False).to_numpy(zero_copy_only=False))
            if len(other):
                at = pa.array(other)
                c = np.einsum("ij,ij->i", from_binary(batch.column(3).take(at), "<f8"), from_binary(batch.column(5).take(at), "<f8"))
                for i, cosine, head in zip(other, c, batch.column(4).take(at).to_pylist(), strict=True):
                    if cosine >= half:
                        leader[i], near[i] = head, cosine
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(leader, pa.binary()), pa.array(near)], names=["_node", "m", "least", "_unit", "leader", "near"])

    rest = free.join(lead, "sig", "left").select("_node", "m", "least", "_unit", "_h", "_hu").mapInArrow(second, f"{kinds}, leader binary, near double")
    return one.where("leader IS NOT NULL").drop("sig").unionByName(rest)


def _coarse(units: np.ndarray) -> pa.Array:
    """Rows in 8 bits, each with its own scale, after that scale and the norm of the row's error (4 bytes each)."""
    scale = (np.abs(units).max(axis=1, keepdims=True) / 127).astype("<f4")
    q = np.clip(np.round(units / scale), -127, 127).astype(np.int8)
    error = np.sqrt(((units - q * scale.astype(float)) ** 2).sum(axis=1, keepdims=True)) * (1 + 1e-6)
    return to_binary(np.concatenate([np.concatenate([scale, error.astype("<f4")], axis=1).view(np.int8), q], axis=1))


def _from_coarse(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """float32 rows and the norms of their errors."""
    raw = from_binary(column, "i1")
    head = np.ascontiguousarray(raw[:, :8]).view("<f4")
    return raw[:, 8:].astype(np.float32) * head[:, :1], head[:, 1].astype(float)


def _slack(error_a, error_b, dim: int) -> np.ndarray:
    """The greatest error of a float32 product of coarse rows, rounding included."""
    return error_a + error_b + error_a * error_b + (dim + 8) * 2.0**-23


def _near_enough(radii_a, radii_b, s: Settings) -> np.ndarray:
    """The least cosine of two leaders whose balls may hold a link."""
    return np.cos(np.minimum(s.angle + radii_a + radii_b + SLACK, math.pi))


def _first_lists(leaders: DataFrame, dim: int, s: Settings, seed: int) -> DataFrame:
    """i, j, cos, near: neighbours inside runs of `chunk` leaders in the order of random sign codes; one order for each table."""
    parts = []
    for t in range(s.tables):
        rng = np.random.default_rng((seed, t))
        planes, line = rng.normal(size=(dim, 20)), rng.normal(size=dim)

        def code(batches: Iterator[pa.RecordBatch], planes=planes, line=line) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    v, _ = _from_coarse(batch.column(2))
                    order = ((v @ planes) > 0) @ (1 << np.arange(19, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order), pa.array((v @ line).astype(float))], names=["i", "radius", "v", "_code", "_fine"])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def solved(run: pa.Table) -> pa.RecordBatch:
                ids, radii = run.column("i").to_numpy(), run.column("radius").to_numpy()
                v, error = _from_coarse(run.column("v"))
                c = v @ v.T
                np.fill_diagonal(c, -2)
                k = min(s.neighbours, len(ids) - 1)
                near = c >= _near_enough(radii[:, None], radii[None, :], s) - _slack(error[:, None], error[None, :], dim)
                keep = near.copy()
                if k > 0:
                    best = np.argpartition(c, -k, axis=1)[:, -k:]
                    keep[np.arange(len(ids))[:, None], best] = True
                np.fill_diagonal(keep, False)
                a, b = np.nonzero(keep)
                return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(c[a, b]), pa.array(near[a, b])], names=["i", "j", "cos", "near"])

            held, n = [], 0
            for batch in batches:
                while len(batch):
                    part = batch.slice(0, s.chunk - n)
                    held.append(part)
                    n += len(part)
                    batch = batch.slice(len(part))
                    if n == s.chunk:
                        yield solved(pa.Table.from_batches(held))
                        held, n = [], 0
            if n > 1:
                yield solved(pa.Table.from_batches(held))

        coded = leaders.select("i", "radius", "v").mapInArrow(code, "i long, radius double, v binary, _code long, _fine double")
        parts.append(coded.repartitionByRange("_code", "_fine", "i").sortWithinPartitions("_code", "_fine", "i").mapInArrow(compare, "i long, j long, cos float, near boolean"))
    return _union(parts)


def _best(edges: DataFrame, s: Settings) -> DataFrame:
    """Lists from edges (i, j, cos, near, new): the best of each i, and all that are near enough; an older edge stays old."""
    once = edges.groupBy("i", "j").agg(F.max("cos").alias("cos"), F.min("new").alias("new"), F.max("near").alias("near"))
    rank = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("near"), F.desc("cos"), "j"))
    return once.withColumn("_rank", rank).where(F.col("near") | (F.col("_rank") <= s.neighbours)).select("i", "j", "cos", "new", "near")


def _local_join(lists: DataFrame, leaders: DataFrame, dim: int, s: Settings) -> DataFrame:
    """i, j, cos, near of neighbours of one leader, new ones against all, that are near enough or beat the worst of a list."""
    worst = lists.groupBy("i").agg(F.min("cos").alias("worst"), F.count("*").alias("n")).select("i", F.when(F.col("n") >= s.neighbours, F.col("worst")).otherwise(F.lit(-2.0)).alias("worst"))
    back = lists.select(F.col("j").alias("c"), F.col("i").alias("x"), "cos", "new")
    back = back.withColumn("_r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("cos"), "x"))).where(F.col("_r") <= 2 * s.neighbours).drop("_r")
    around = lists.select(F.col("i").alias("c"), F.col("j").alias("x"), "cos", "new").unionAll(back).groupBy("c", "x").agg(F.max("new").alias("new"))
    about = leaders.select("i", "radius", "v").join(worst, "i").withColumnRenamed("i", "x")
    rows = around.join(about, "x").select("c", "x", "new", "radius", "worst", "v")

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        new = t.column("new").to_numpy()
        if not new.any() or t.num_rows < 2:
            return None
        ids, radii, worst_of = t.column("x").to_numpy(), t.column("radius").to_numpy(), t.column("worst").to_numpy()
        v, error = _from_coarse(t.column("v"))
        out = []
        for start in range(0, len(ids), s.block):  # a saturated list is compared in blocks
            r = slice(start, start + s.block)
            c = v[r] @ v.T
            near = c >= _near_enough(radii[r, None], radii[None, :], s) - _slack(error[r, None], error[None, :], dim)
            keep = (c > np.minimum(worst_of[r, None], worst_of[None, :])) | near
            keep &= (new[r, None] | new[None, :]) & (ids[r, None] < ids[None, :])
            a, b = np.nonzero(keep)
            out.append((ids[a + start], ids[b], c[a, b], near[a, b]))
        columns = [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["i", "j", "cos", "near"])

    found = _grouped(rows, ("c",), solve, "i long, j long, cos float, near boolean")
    found = found.groupBy("i", "j").agg(F.max("cos").alias("cos"), F.max("near").alias("near"))
    return found.unionAll(found.select(F.col("j").alias("i"), F.col("i").alias("j"), "cos", "near"))


def _near_pairs(asked: list, leaders: DataFrame, s: Settings) -> DataFrame:
    """i, j for each leader i of a bounded list and all leaders j near enough, compared in double precision."""
    ids, radii, units = np.array([r.i for r in asked]), np.array([r.radius for r in asked]), np.stack([np.frombuffer(r._unit) for r in asked])

    def true(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), MEET):
                batch = whole.slice(start, MEET)
                j, other = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                c = units @ from_binary(batch.column(2), "<f8").T
                a, b = np.nonzero(c >= _near_enough(radii, other.max(), s)[:, None])
                at = (c[a, b] >= _near_enough(radii[a], other[b], s)) & (ids[a] != j[b])
                yield pa.RecordBatch.from_arrays([pa.array(ids[a[at]]), pa.array(j[b[at]])], names=["i", "j"])

    return leaders.select("i", "radius", "_unit").mapInArrow(true, "i long, j long")


def _all_pairs(leaders: DataFrame, n: int, dim: int, s: Settings) -> DataFrame:
    """i, j, near: all near pairs, by as many passes over the leaders as they have bounded blocks."""
    at = F.pmod(F.xxhash64("i", F.lit(s.seed)), F.lit(1 << 30)) / F.lit(1 << 30)
    parts: list[DataFrame] = []
    passes = -(-n // max(GROUP // dim, 1))
    for p in range(passes):
        asked = leaders.where((at >= p / passes) & (at < (p + 1) / passes)).select("i", "radius", "_unit").collect()  # one block
        if asked:
            parts.append(Written(_near_pairs(asked, leaders, s), "all-pairs").df)
    return _union(parts).withColumn("near", F.lit(True))


def _planted(leaders: DataFrame, s: Settings) -> DataFrame:
    """i (below 0), j, radius, v: for some leaders j a partner at a random place between half the linking angle and the whole of it."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            j, u = batch.column(0).to_numpy(), from_binary(batch.column(1), "<f8")
            drawn = [np.random.default_rng((s.seed, int(x))) for x in j]
            side = np.stack([r.normal(size=u.shape[1]) for r in drawn])
            side -= (side * u).sum(axis=1, keepdims=True) * u
            size = np.sqrt((side * side).sum(axis=1, keepdims=True))
            theta = s.angle * np.array([0.5 + 0.5 * r.random() for r in drawn])[:, None]
            at = np.flatnonzero(size[:, 0] > 1e-9)  # there is no other direction in one dimension
            if len(at):
                v = (np.cos(theta) * u + np.sin(theta) * side / np.maximum(size, 1e-9))[at]
                yield pa.RecordBatch.from_arrays([pa.array(-1 - j[at]), pa.array(j[at]), pa.array(np.zeros(len(at))), _coarse(v)], names=["i", "j", "radius", "v"])

    some = leaders.orderBy(F.xxhash64("i", F.lit(s.seed)), "i").limit(s.planted).select("i", "_unit")
    return Written(some.mapInArrow(make, "i long, j long, radius double, v binary"), "planted").df


def _recall(lists: DataFrame, known: DataFrame) -> float:
    """Share of known near pairs (i, j) in the lists, the lesser of that over pairs and the mean over their i; 1 if none is known."""
    both = known.join(lists.where("near").select("i", "j", F.lit(1).alias("_in")), ["i", "j"], "left")
    total, found, seen, share = both.groupBy("i").agg(F.count("*").alias("n"), F.count("_in").alias("k")).agg(F.sum("n"), F.sum("k"), F.count("*"), F.sum(F.col("k") / F.col("n"))).first()
    return min(found / total, share / seen) if seen else 1.0


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def neighbour_lists(leaders: DataFrame, dim: int, s: Settings, report: dict | None = None) -> DataFrame:
    """i, j, near: NN-descent until its audit is content. report, if given, gets how it went."""
    n = leaders.count()
    told = report if report is not None else {}
    if s.exact:
        told.update(answer="all pairs", recall=1.0, leaders=n)
        return _all_pairs(leaders, n, dim, s)
    s = s.sized(n)
    planted = _planted(leaders, s)
    asked = leaders.orderBy(F.xxhash64("i", F.lit(s.seed + 1)), "i").limit(s.audit_rows).select("i", "radius", "_unit").collect()
    known = planted.select("i", "j")
    if asked:
        known = Written(known.unionAll(_near_pairs(asked, leaders, s)), "known").df
    every = Written(leaders.select("i", "radius", "v").unionAll(planted.select("i", "radius", "v")), "taking-part").df
    lists, recall = None, 0.0
    for attempt in range(s.audits):
        now = replace(s, tables=s.tables << attempt, neighbours=s.neighbours << attempt)
        first = _first_lists(every, dim, now, s.seed + attempt)
        both = first.unionAll(first.select(F.col("j").alias("i"), F.col("i").alias("j"), "cos", "near")).withColumn("new", F.lit(True))
        if lists is not None:
            both = both.unionByName(lists.withColumn("new", F.lit(False)))
        lists = Written(_best(both, now), "lists").df
        for done in range(s.rounds + 1):
            recall = _recall(lists, known)
            size, n_new, near_new = lists.agg(F.count("*"), F.count_if("new"), F.count_if(F.col("new") & F.col("near"))).first()
            told.update(answer="lists", recall=recall, leaders=n, attempts=attempt + 1, rounds=done, tables=now.tables, chunk=now.chunk)
            settled = n_new <= 0.02 * size and not near_new
            if recall >= s.audit_recall and done or settled or done == s.rounds:
                break
            more = _local_join(lists, every, dim, now).withColumn("new", F.lit(True))
            lists = Written(_best(lists.withColumn("new", F.lit(False)).unionByName(more), now), "lists").df
        if recall >= s.audit_recall:
            break
    if recall < s.least_recall:
        raise RuntimeError(f"NN-descent found {recall:.3f} of the known near pairs after {s.audits} attempts; more tables, neighbours or audits, or exact=True, are needed")
    if recall < s.audit_recall:
        warnings.warn(f"NN-descent found {recall:.3f} of the known near pairs, less than {s.audit_recall}", stacklevel=2)
    return lists.where((F.col("i") >= 0) & (F.col("j") >= 0)).select("i", "j", "near")


def _member_links(pairs: DataFrame, members: DataFrame, s: Settings) -> DataFrame:
    """_node, n, a, b for the members of balls a and b that have n linked partners in the other one; solved in blocks."""
    sizes = members.groupBy("leader").agg(F.ceil(F.count("*") / s.block).cast("int").alias("chunks"))
    cut = pairs.join(sizes.withColumnsRenamed({"leader": "a", "chunks": "_na"}), "a").join(sizes.withColumnsRenamed({"leader": "b", "chunks": "_nb"}), "b")
    place = lambda n: F.pmod(F.xxhash64("_node"), n).cast("int")
    of_a = cut.join(members.withColumnRenamed("leader", "a"), "a").select("a", "b", place(F.col("_na")).alias("x"), F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("y"), F.lit(True).alias("first"), "_node", "m", "_unit")
    of_b = cut.join(members.withColumnRenamed("leader", "b"), "b").select("a", "b", F.explode(F.sequence(F.lit(0), F.col("_na") - 1)).alias("x"), place(F.col("_nb")).alias("y"), F.lit(False).alias("first"), "_node", "m", "_unit")

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        first = t.column("first").to_numpy()
        if first.all() or not first.any():
            return None
        u, m, node = from_binary(t.column("_unit"), "<f8"), t.column("m").to_numpy(), np.array(t.column("_node").to_pylist(), object)
        linked = (u[first] @ u[~first].T) >= s.cosine
        n = np.concatenate([linked @ m[~first], m[first] @ linked])
        who = np.concatenate([node[first], node[~first]])
        at = n > 0
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        return pa.RecordBatch.from_arrays(
            [pa.array(list(who[at]), pa.binary()), pa.array(n[at].astype(np.int64)), pa.array([a] * int(at.sum()), pa.binary()), pa.array([b] * int(at.sum()), pa.binary())], names=["_node", "n", "a", "b"]
        )

    return _grouped(of_a.unionByName(of_b), ("a", "b", "x", "y"), solve, "_node binary, n long, a binary, b binary")


def _linked(nodes: DataFrame, dim: int, s: Settings, report: dict | None = None) -> DataFrame:
    """_node, n_links, component_id for the nodes (_node, m, least, _unit) of one dimension."""
    members = Written(balls(nodes, s), "balls").df
    own = F.col("_node") == F.col("leader")
    table = members.groupBy("leader").agg(
        F.sum("m").alias("weight"), F.min("least").alias("least"), F.min("near").alias("near"), F.max_by("_unit", own.cast("int")).alias("_unit"), F.count("*").alias("size")
    )

    def with_coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near, size = batch.column(3).to_numpy(), batch.column(5).to_numpy()
                radius = np.where(size > 1, np.arccos(np.clip(near, -1, 1)) + SLACK, 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], batch.column(4), pa.array(radius), _coarse(from_binary(batch.column(4), "<f8"))], names=["leader", "weight", "least", "_unit", "radius", "v"])

    kind = nodes.schema["least"].dataType.simpleString()
    leaders = Written(table.mapInArrow(with_coarse, f"leader binary, weight long, least {kind}, _unit binary, radius double, v binary").withColumn("i", F.monotonically_increasing_id()), "leaders").df
    lists = neighbour_lists(leaders, dim, s, report)

    side = lambda n: leaders.select(F.col("i").alias(n), F.col("leader").alias(f"leader_{n}"), F.col("radius").alias(f"r_{n}"), F.col("_unit").alias(f"u_{n}"), F.col("weight").alias(f"w_{n}"))
    near = lists.where("near").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct().join(side("i"), "i").join(side("j"), "j")

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                c = (from_binary(batch.column(2), "<f8") * from_binary(batch.column(3), "<f8")).sum(axis=1)
                r = batch.column(4).to_numpy() + batch.column(5).to_numpy()
                theta = np.arccos(np.clip(c, -1, 1))
                every = np.where(r == 0, c >= s.cosine, theta + r <= s.angle - SLACK)
                none = np.where(r == 0, ~every, theta - r > s.angle + SLACK)
                kind = np.where(every, 2, np.where(none, 0, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *batch.columns[6:8], pa.array(kind.astype(np.int32))], names=["a", "b", "w_a", "w_b", "kind"])

    pairs = near.select(F.col("leader_i").alias("a"), F.col("leader_j").alias("b"), "u_i", "u_j", "r_i", "r_j", "w_i", "w_j").mapInArrow(classify, "a binary, b binary, w_a long, w_b long, kind int")
    pairs = Written(pairs.where("kind > 0"), "ball-pairs").df
    whole = pairs.where("kind = 2")
    to_ball = whole.select(F.col("a").alias("leader"), F.col("w_b").alias("w")).unionAll(whole.select("b", "w_a")).groupBy("leader").agg(F.sum("w").alias("w"))
    some = Written(_member_links(pairs.where("kind = 1").select("a", "b"), members.select("leader", "_node", "m", "_unit"), s), "member-links").df
    to_node = some.groupBy("_node").agg(F.sum("n").alias("n"))
    comp = connected_components(whole.select("a", "b").unionAll(some.select("a", "b").distinct()), "a", "b")
    placed = leaders.select("leader", "weight", "least").join(comp, F.col("leader") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "leader"))
    names = Written(placed.groupBy("comp").agg(F.min("least").alias("component_id")), "names").df  # written: a hot component's rows can be split
    by_ball = placed.join(names, "comp").join(to_ball, "leader", "left").select("leader", "component_id", (F.col("weight") - 1 + F.coalesce("w", F.lit(0))).alias("_base"))
    return members.select("_node", "leader").join(by_ball, "leader").join(to_node, "_node", "left").select("_node", (F.col("_base") + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), "component_id")


def near_duplicate_vectors(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings(), report: dict | None = None) -> DataFrame:
    """key, n_links, component_id, kept for every row of df.

    Two vectors of one dimension are linked if their cosine in double precision is at least
    settings.cosine. Null or zero vectors, and those with null or non-finite components, have no
    links and are their own component. Rows that repeat a key and its vector count as one vector
    and each get a row. A row with a null key is a vector like any other; a component's id is its least key that isn't null, null
    if it has none, and then its rows are kept. Cosines equal to the bound are links. Empty tables give no rows; other columns are
    not read. Of links between different texts that descent finds, none is dropped; the share it finds is audited (see Settings), and
    report, if given, gets for each dimension what answered and the recall.
    """
    with scratch(df.sparkSession, "near-vectors"):
        return Written(_answers(df, key, vector, settings, report), "vectors", outside=True).df


def _answers(df: DataFrame, key: str, vector: str, settings: Settings, report: dict | None = None) -> DataFrame:
    rows = Written(_units(df, key, vector), "units").df
    held = rows.where("_node IS NOT NULL").groupBy("_id", "_node", "_dim").agg(F.first("_unit").alias("_unit"))
    nodes = Written(held.groupBy("_node", "_dim").agg(F.count("*").alias("m"), F.min("_id").alias("least"), F.first("_unit").alias("_unit")), "nodes").df
    found = None
    for dim in sorted(r[0] for r in nodes.select("_dim").distinct().collect()):  # as a rule one
        part = _linked(nodes.where(F.col("_dim") == dim).select("_node", "m", "least", "_unit"), dim, settings, report.setdefault(dim, {}) if report is not None else None)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = rows.select("_node", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id")).where("false")
    out = rows.select("_id", "_node").join(found, "_node", "left")
    comp = F.coalesce("component_id", "_id")
    return out.select(F.col("_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("_id") == comp, F.lit(True)).alias("kept"))
