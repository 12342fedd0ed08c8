"""Exact top-k inner products by a Voronoi kNN join.

1. Pivots are a bounded sample, about as many as the root of the number of rows; rows and queries
go to their nearest pivot. 2. A group's rows are cut into rings of distance to the pivot (units), of about as many rows
as the root of their number, and units are put together to cells of about that size; a unit with more rows is several cells.
3. A query is solved in its own cell, which gives a lower bound of its k-th score. 4. Bounds
from summaries: no score in a unit with pivot p, radius r and greatest norm m exceeds
min(q.p + |q| r, |q| m). For the queries of group i, whose pivot is o, radius R and greatest norm M,
that is at most o.p + R |p| + M r, so units below the least bound of all of a group's queries are left
out for all of them, in the tasks that hold them; what remains is tested query by query. The driver holds pivots, and a few numbers for each unit
and group; there are at most MOST_UNITS units besides one a pivot, whatever the number of rows. 5. A query goes to the cells of
its remaining units, and a cell's rows to as many blocks of queries as it got, to none if it got
none. Blocks are solved locally.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from tallyloom.llm.common import Written, scratch
from tallyloom.llm.vectors import finite_rows, to_binary

#: Sums below it are exact in float64, with a place number added.
EXACT = 2.0**52
PLACES = 1 << 16
#: Bounds of the units' number, and of the rows of a cell.
MOST_UNITS, LEAST_CELL, MOST_CELL = 1 << 16, 32, 1 << 15


def packed_rows(ints: np.ndarray) -> pa.Array:
    """Each row in 2 bytes a component, or in 8 if one of them needs more."""
    small = (np.abs(ints) < 1 << 15).all(axis=1)
    narrow, out = ints.astype("<i2"), []
    for i, fits in enumerate(small):
        out.append((narrow[i] if fits else ints[i]).tobytes())
    return pa.array(out, pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """int64 rows of one dimension."""
    rows = column.to_pylist()
    if all(len(r) == 2 * dim for r in rows):
        return np.frombuffer(b"".join(rows), "<i2").reshape(len(rows), dim).astype(np.int64)
    return np.stack([np.frombuffer(r, "<i2" if len(r) == 2 * dim else "<i8").astype(np.int64) for r in rows])


def quantised(df: DataFrame, *, key: str, vector: str, scale: float) -> DataFrame:
    """_id, _dim, _v (integers floor(scale * x), little-endian) of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in finite_rows(batch.column(1)):
                ints = np.clip(np.floor(scale * m), -(2.0**62), 2.0**62).astype("<i8")
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), m.shape[1], np.int32)), packed_rows(ints)], names=["_id", "_dim", "_v"])

    if not isinstance(df.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be a whole number")
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), vector).mapInArrow(run, "_id long, _dim int, _v binary")


def _products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    top = max(float(np.abs(q).max(initial=0)), 1.0) * max(float(np.abs(d).max(initial=0)), 1.0) * max(q.shape[1], 1)
    return q.astype(np.float64) @ d.astype(np.float64).T if top * PLACES < EXACT else q @ d.T


def best_rows(q: np.ndarray, q_ids: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int, least: np.ndarray | None = None):
    """(query row, data row, score) arrays of each query's k best data rows, ties to the smaller id, none its own, none below least."""
    order = np.argsort(d_ids, kind="stable")
    d, d_ids = d[order], d_ids[order]
    out = [(np.zeros(0, np.int64),) * 3]
    for start in range(0, len(q), 256):
        scores = _products(q[start : start + 256], d)
        own = q_ids[start : start + 256, None] == d_ids[None, :]
        if scores.dtype != np.float64 or len(d) >= PLACES:
            rank = np.argsort(-scores, axis=1, kind="stable")
            good = ~np.take_along_axis(own, rank, axis=1)
            good &= np.cumsum(good, axis=1) <= k
            rows, at = np.nonzero(good)
            cols = rank[rows, at]
        else:
            mixed = np.where(own, -np.inf, scores * PLACES - np.arange(len(d)))
            cols = np.argpartition(mixed, len(d) - k, axis=1)[:, -k:] if len(d) > k else np.broadcast_to(np.arange(len(d)), mixed.shape)
            rows, cols = np.repeat(np.arange(len(scores)), cols.shape[1]), cols.ravel()
            good = np.isfinite(mixed[rows, cols])
            rows, cols = rows[good], cols[good]
        got = scores[rows, cols]
        if least is not None:
            good = got >= least[start + rows]
            rows, cols, got = rows[good], cols[good], got[good]
        out.append((start + rows, order[cols], got.astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@dataclass
class Units:
    """Pivots of one dimension, summaries of its units, and where their rows are."""

    pivots: np.ndarray
    pivot: np.ndarray  # the unit's pivot by number, -1 where it has none
    radius: np.ndarray
    norm: np.ndarray
    cell: np.ndarray  # the first of its cells
    parts: np.ndarray  # and their number

    def bounds(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Greatest scores that queries can have in the units `at`, rounding included."""
        size, pivot = np.sqrt((q * q).sum(axis=1))[:, None], self.pivot[at]
        if not len(self.pivots):
            return np.full((len(q), len(at)), np.inf)
        top = np.minimum((q @ self.pivots.T)[:, pivot] + size * self.radius[at], size * self.norm[at])
        return np.where(pivot >= 0, top + np.abs(top) * 1e-9 + size * self.norm[at] * 1e-9 + 1e-6, np.inf)

    def group_bounds(self, origin: np.ndarray, reach: float, norm: float) -> np.ndarray:
        """Greatest scores of any query of one group in each unit."""
        top = (self.pivots @ origin + reach * np.sqrt((self.pivots**2).sum(axis=1)))[self.pivot] + norm * self.radius
        return np.where(self.pivot >= 0, top + np.abs(top) * 1e-9 + norm * self.norm * 1e-9 + 1e-6, np.inf)

    def open_to(self, group: int, reach: float, norm: float, least: float | None) -> np.ndarray:
        """Units that some query of the group may need."""
        every = np.arange(len(self.radius))
        return every if group < 0 or least is None else every[self.group_bounds(self.pivots[group], reach, norm) >= least]


def _cells(units: list, chunk_rows: int) -> tuple[list[int], list[int]]:
    """First cell and number of cells of each unit; small units next to each other share one."""
    first, parts, cell, room = [], [], -1, 0
    for n in units:
        need = -(-n // chunk_rows)
        if need == 1 and n <= room:
            room -= n
        else:
            cell, room = cell + 1, chunk_rows - n
        first.append(cell)
        parts.append(need)
        cell += need - 1
    return first, parts


def top_k(
    df: DataFrame, queries, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0, max_pivots: int = 2048, chunk_rows: int | None = None, query_rows: int = 4096, seed: int = 5, sent: list | None = None
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for each row that fulfils `queries` (a Column over `_id`).

    Scores are inner products of floor(scale * x); only vectors of one dimension are compared.
    A query has every other row as candidate, none with its own id; ties go to the smaller
    id; rows that repeat an id and its vector count as one. Vectors that are null or hold null or
    non-finite components, and rows with a null id, take no part; ids are whole numbers; empty tables give no rows;
    scores past a long wrap. Pivots are sqrt(rows), at most max_pivots, rows with the smallest hashes; they decide only the
    speed, as does chunk_rows, the rows of a cell (the root of their number, within LEAST_CELL and MOST_CELL, if not given).
    sent, if given, gets one tuple: rows, queries, cells, copies of queries, copies of rows.
    """
    with scratch(df.sparkSession, "topk"):
        return Written(_top_k(df, queries, key, vector, k, scale, max_pivots, chunk_rows, query_rows, seed, sent), "topk", outside=True).df


def _top_k(df: DataFrame, queries, key: str, vector: str, k: int, scale: float, max_pivots: int, chunk_rows: int | None, query_rows: int, seed: int, sent: list | None) -> DataFrame:
    spark = df.sparkSession
    rows = Written(quantised(df, key=key, vector=vector, scale=scale).distinct(), "vectors").df
    n_rows = rows.count()
    if not n_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    chunk_rows = chunk_rows or min(MOST_CELL, max(LEAST_CELL, math.isqrt(n_rows)))
    unit_rows = max(chunk_rows, -(-n_rows // MOST_UNITS))
    sample = rows.orderBy(F.xxhash64("_id", F.lit(seed)), "_id", "_v").limit(min(max_pivots, math.isqrt(n_rows) + 1)).collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in {r._dim for r in sample}:
        found = np.unique(unpacked(pa.array([r._v for r in sample if r._dim == dim], pa.binary()), dim), axis=0).astype(np.float64)
        line = np.random.default_rng(seed).normal(size=dim)
        pivots[dim] = found[np.argsort(found @ line, kind="stable")]  # neighbours share cells

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            group, reach, norm = np.full(len(dims), -1, np.int32), np.zeros(len(dims)), np.zeros(len(dims))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                v = unpacked(batch.column(2).take(pa.array(at)), int(dim)).astype(np.float64)
                norm[at] = np.sqrt((v * v).sum(axis=1))
                if int(dim) in pivots:
                    p = pivots[int(dim)]
                    group[at] = ((p * p).sum(axis=1) - 2 * (v @ p.T)).argmin(axis=1)
                    reach[at] = np.sqrt(((v - p[group[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group), pa.array(reach), pa.array(norm)], names=["_id", "_dim", "_v", "_group", "_reach", "_norm"])

    grouped = Written(rows.mapInArrow(near, "_id long, _dim int, _v binary, _group int, _reach double, _norm double"), "groups").df
    sizes = {(r._dim, r._group): (r.r, -(-r.n // unit_rows)) for r in grouped.groupBy("_dim", "_group").agg(F.count("*").alias("n"), F.max("_reach").alias("r")).collect()}  # a row a pivot, or a dimension
    wide = [F.struct(F.lit(d).alias("_dim"), F.lit(g).alias("_group"), F.lit(r).alias("_r"), F.lit(n).alias("_n")) for (d, g), (r, n) in sizes.items() if n > 1 and r > 0]  # groups of several rings
    ring = F.lit(0)
    if wide:
        large = F.broadcast(spark.range(1).select(F.explode(F.array(*wide)).alias("_w")).select("_w.*"))
        grouped = grouped.join(large, ["_dim", "_group"], "left")
        ring = F.coalesce(F.least(F.floor(F.col("_reach") / F.col("_r") * F.col("_n")), F.col("_n") - 1), F.lit(0))
    grouped = grouped.select("_id", "_dim", "_v", "_group", ring.cast("int").alias("_ring"), "_reach", "_norm")
    summary = grouped.groupBy("_dim", "_group", "_ring").agg(F.count("*").alias("n"), F.max("_reach").alias("r"), F.max("_norm").alias("m")).collect()  # a row a ring
    summary.sort(key=lambda r: (r._dim, r._group, r._ring))
    first, parts = _cells([r.n for r in summary], chunk_rows)
    units, place = {}, {}
    for dim in {r._dim for r in summary}:
        own = [i for i, r in enumerate(summary) if r._dim == dim]
        units[dim] = Units(
            pivots.get(dim, np.zeros((0, dim))), np.array([summary[i]._group for i in own]), np.array([summary[i].r for i in own]), np.array([summary[i].m for i in own]),
            np.array([first[i] for i in own]), np.array([parts[i] for i in own]),
        )
    for i, r in enumerate(summary):
        place[(r._dim, r._group, r._ring)] = (first[i], parts[i])
    cell_of = np.array([(d, g, x, f, n) for (d, g, x), (f, n) in place.items()], np.int64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {(d, g, x): (f, n) for d, g, x, f, n in cell_of.tolist()}
        for batch in batches:
            at = [known[key] for key in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4)), strict=True)]
            salt = batch.column(7).to_numpy()
            cell = np.array([f for f, _ in at], np.int64) + salt % np.maximum(np.array([n for _, n in at], np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), batch.column(5), batch.column(6), pa.array(cell), batch.column(8)], names=["_id", "_dim", "_v", "_group", "_reach", "_norm", "_cell", "_asks"])

    salt = F.pmod(F.xxhash64("_id", "_v"), F.lit(1 << 40))
    celled = grouped.select("*", salt.alias("_salt"), F.coalesce(queries, F.lit(False)).alias("_asks")).mapInArrow(placed, "_id long, _dim int, _v binary, _group int, _reach double, _norm double, _cell long, _asks boolean")
    celled = Written(celled, "cells").df

    def own_cell(t: pa.Table) -> pa.Table:
        asks, dims = t.column("_asks").to_numpy(), t.column("_dim").to_numpy()
        parts = []
        for dim in np.unique(dims[asks]):
            at = np.flatnonzero(dims == dim)
            ids, v = t.column("_id").to_numpy()[at], unpacked(t.column("_v").take(pa.array(at)), int(dim))
            q = np.flatnonzero(asks[at])
            row, _, score = best_rows(v[q], ids[q], v, ids, k)
            full = np.full(len(q), np.iinfo(np.int64).max)
            np.minimum.at(full, row, score)
            got = t.select(["_id", "_dim", "_v", "_group", "_reach", "_norm"]).take(pa.array(at[q]))
            parts.append(got.append_column("_least", pa.array(full, mask=np.bincount(row, minlength=len(q)) < k)))
        return pa.concat_tables(parts) if parts else t.slice(0, 0).select(["_id", "_dim", "_v", "_group", "_reach", "_norm"]).append_column("_least", pa.array([], pa.int64()))

    asked = celled.where("_asks").select("_cell").distinct()
    bounded = celled.join(asked, "_cell", "left_semi").groupBy("_cell").applyInArrow(own_cell, "_id long, _dim int, _v binary, _group int, _reach double, _norm double, _least long")
    bounded = Written(bounded, "queries").df
    sides = bounded.groupBy("_dim", "_group").agg(F.count("*").alias("n"), F.max("_reach").alias("r"), F.max("_norm").alias("m"), F.when(F.count("*") == F.count("_least"), F.min("_least")).alias("least")).collect()  # a row a pivot, or a dimension
    asking = {(r._dim, r._group): (r.r, r.m, r.least) for r in sides}
    known = spark.sparkContext.broadcast((units, asking))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (units, asking), open_ = known.value, {}
        for batch in batches:
            dims, groups = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            least = np.where(batch.column(6).is_valid().to_numpy(zero_copy_only=False), pc.fill_null(batch.column(6), 0).to_numpy(), -np.inf)
            for dim, group in {*zip(dims.tolist(), groups.tolist(), strict=True)}:
                u, at = units[dim], np.flatnonzero((dims == dim) & (groups == group))
                if (dim, group) not in open_:
                    open_ = {(dim, group): u.open_to(group, *asking[(dim, group)])}  # one group at a time
                some = open_[(dim, group)]
                for start in range(0, len(at), 256):
                    part = at[start : start + 256]
                    q = unpacked(batch.column(2).take(pa.array(part)), dim).astype(np.float64)
                    row, unit = np.nonzero(u.bounds(q, some) >= least[part, None])
                    unit = some[unit]
                    n = u.parts[unit]
                    cell = np.repeat(u.cell[unit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    pairs = np.unique(np.stack([np.repeat(row, n), cell], axis=1), axis=0)
                    got = batch.take(pa.array(part[pairs[:, 0]]))
                    yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), got.column(2), got.column(6), pa.array(pairs[:, 1])], names=["_id", "_dim", "_v", "_least", "_cell"])

    copies = Written(bounded.mapInArrow(send, "_id long, _dim int, _v binary, _least long, _cell long"), "copies").df
    blocks = Written(copies.groupBy("_cell").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("_blocks")), "blocks").df
    of_query = copies.join(blocks, "_cell").withColumn("_block", F.pmod(F.xxhash64("_id", F.lit(3)), F.col("_blocks")).cast("int")).drop("_blocks")
    of_data = celled.select("_id", "_dim", "_v", "_cell").join(blocks, "_cell").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    if sent is not None:
        sent.append((n_rows, bounded.count(), first[-1] + parts[-1], copies.count(), of_data.count()))

    def solve(data: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        for dim in np.unique(asked.column("_dim").to_numpy()):
            d_at, q_at = (pa.array(np.flatnonzero(t.column("_dim").to_numpy() == dim)) for t in (data, asked))
            if not len(d_at):
                continue
            d, q = (unpacked(t.column("_v").take(at), int(dim)) for t, at in ((data, d_at), (asked, q_at)))
            d_ids, q_ids = data.column("_id").take(d_at).to_numpy(), asked.column("_id").take(q_at).to_numpy()
            least = asked.column("_least").take(q_at)
            floor = np.where(least.is_valid().to_numpy(), pc.fill_null(least, np.iinfo(np.int64).min).to_numpy(), np.iinfo(np.int64).min)
            row, at, score = best_rows(q, q_ids, d, d_ids, k, floor)
            out.append(pa.table({"query_id": q_ids[row], "vec_id": d_ids[at], "score": score}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    cell = ("_cell", "_block")
    found = of_data.groupBy(*cell).cogroup(of_query.groupBy(*cell)).applyInArrow(solve, "query_id long, vec_id long, score long").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
