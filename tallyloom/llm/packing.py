"""Best-fit packing by a linear grouping scheme.

Documents become pieces of at most `capacity` tokens. Packing needs only how many pieces
have each length, a table of at most `capacity` rows: on it the driver plans, and each
length's pieces then take the planned places in their order. The plan

1. sorts the large lengths and cuts them into groups of equal numbers of pieces, whose
   lengths count as the group's largest;
2. finds how many sequences get each configuration of a few such sizes by the linear
   programme of the covering problem (revised simplex over all configurations), rounded down;
3. substitutes the actual pieces of the groups into the configurations;
4. puts what is left, and the small pieces, best-fit in falling order of length.

The scheme's two parameters, the smallest large length and the number of groups, are tried
over a short list, and the plan with the fewest sequences is taken.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import Written, give_back
from tallyloom.llm.tokens import encoder, slices, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: (smallest large length as a share of the capacity, groups) that are tried.
SCHEMES = ((0.25, 10), (0.34, 24), (0.5, 48))
#: Rows of one length that are numbered by one task, about.
ROWS_A_SALT = 20_000

#: identical sequences: how many, and the lengths in each, in order
Group = tuple[int, tuple[int, ...]]


def configurations(sizes: list[int], capacity: int) -> list[tuple[int, ...]]:
    """All multisets of group indices that fit, of up to capacity // smallest size members."""
    out = []
    for n in range(1, capacity // min(sizes) + 1):
        out += [c for c in combinations_with_replacement(range(len(sizes)), n) if sum(sizes[g] for g in c) <= capacity]
    return out


def covering_counts(sizes: list[int], need: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(configuration, number of sequences), rounded down from the covering LP's solution."""
    configs = configurations(sizes, capacity)
    a = np.zeros((len(sizes), len(configs)))
    for j, c in enumerate(configs):
        for g in c:
            a[g, j] += 1
    basis = [configs.index((g,)) for g in range(len(sizes))]
    for g in range(len(sizes)):  # start from sequences of one size, as many as fit
        basis[g] = configs.index((g,) * (capacity // sizes[g]))
    b = np.asarray(need, float)
    for _ in range(50 * len(sizes)):
        inv = np.linalg.inv(a[:, basis])
        gain = inv.sum(axis=0) @ a - 1
        j = int(np.argmax(gain))
        if gain[j] < 1e-9:
            break
        x, d = inv @ b, inv @ a[:, j]
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        basis[int(np.argmin(ratio))] = j
    x = np.linalg.solve(a[:, basis], b)
    return [(configs[j], int(np.floor(v + 1e-9))) for j, v in zip(basis, x, strict=True) if v >= 1]


def grouped(lengths: list[tuple[int, int]], groups: int) -> list[list[list[int]]]:
    """Falling (length, count) rows cut into groups of equal numbers; a length may fall into several."""
    total = sum(n for _, n in lengths)
    out, room = [[]], -(-total // groups)
    left = room
    for length, n in lengths:
        while n:
            if not left:
                out.append([])
                left = room
            k = min(n, left)
            out[-1].append([length, k])
            n, left = n - k, left - k
    return out


def best_fit(items: list[tuple[int, int]], opened: list[Group], capacity: int) -> list[Group]:
    """Falling (length, count) items into the opened sequences and new ones, each where least room stays."""
    bins: dict[int, list[Group]] = defaultdict(list)
    for n, had in opened:
        bins[capacity - sum(had)].append((n, had))
    rooms = sorted(bins)

    def put(room: int, group: Group) -> None:
        if room not in bins or not bins[room]:
            i = bisect.bisect_left(rooms, room)
            if i == len(rooms) or rooms[i] != room:
                rooms.insert(i, room)
        bins[room].append(group)

    for length, n in items:
        while n:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                m, had = bins[room].pop()
                if not bins[room]:
                    rooms.pop(i)
            else:
                room, m, had = capacity, n, ()
            each = room // length
            full = min(m, n // each)
            if full:
                put(room - each * length, (full, (*had, *[length] * each)))
            else:
                full, each = 1, n
                put(room - each * length, (1, (*had, *[length] * each)))
            n -= full * each
            if m > full and room < capacity:
                put(room, (m - full, had))
    return [g for room in sorted(bins) for g in bins[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY, schemes=SCHEMES) -> list[Group]:
    """Groups of identical sequences that hold every piece once."""
    falling = sorted(((k, n) for k, n in counts.items() if n and k < capacity), reverse=True)
    whole = [(counts[capacity], (capacity,))] if counts.get(capacity) else []
    best: list[Group] | None = None
    for share, groups in schemes:
        large, opened = [r for r in falling if r[0] > share * capacity], []
        if large and groups:
            queues = grouped(large, min(groups, sum(n for _, n in large)))
            sizes, need = [q[0][0] for q in queues], [sum(n for _, n in q) for q in queues]
            for config, m in covering_counts(sizes, need, capacity):
                while m:  # one run for as long as each of its groups goes on with one length
                    use = defaultdict(int)
                    for g in config:
                        use[g] += 1
                    if any(not queues[g] or sum(n for _, n in queues[g]) < k for g, k in use.items()):
                        break
                    run = min(m, *(max(1, queues[g][0][1] // k) for g, k in use.items()))
                    if any(queues[g][0][1] < k for g, k in use.items()):
                        run = 1
                    had = []
                    for g, k in use.items():
                        for _ in range(k):
                            had.append(queues[g][0][0])
                            queues[g][0][1] -= run
                            if not queues[g][0][1]:
                                queues[g].pop(0)
                    opened.append((run, tuple(sorted(had, reverse=True))))
                    m -= run
            left = defaultdict(int)
            for q in queues:
                for length, n in q:
                    left[length] += n
            rest = sorted([*left.items(), *(r for r in falling if r[0] <= share * capacity)], reverse=True)
        else:
            rest = falling
        got = best_fit(rest, opened, capacity)
        if best is None or sum(n for n, _ in got) < sum(n for n, _ in best):
            best = got
    return whole + (best or [])


def place_table(groups: list[Group]) -> dict[str, np.ndarray]:
    """For each run of pieces of one length: key (length, first rank), first sequence, offset; sorted by key."""
    at: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for n, lengths in groups:
        offset = 0
        for length in lengths:
            rows.append(((length << 44) + at[length], sequence, offset))
            at[length] += n
            offset += length
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return {"key": table[:, 0], "sequence": table[:, 1], "offset": table[:, 2]}


def pieces_of(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and the end id, cut by the capacity."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for part, texts in slices(batch, "text"):
                slots, sizes, ends, _ = enc.encode(texts)
                flat, lengths = enc.ids(slots, sizes), np.diff(ends)
                ids = np.full(len(flat) + len(lengths), end_id, np.uint32)
                ids[np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)] = flat
                total = lengths + 1
                n = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                size = np.minimum(total[doc] - start, capacity)
                cut = (np.cumsum(total) - total)[doc] + start
                raw = [ids[a : a + k] for a, k in zip(cut, size, strict=True)]
                crc = np.fromiter((zlib.crc32(r.astype("<u4").tobytes()) for r in raw), np.int64, len(raw))
                cols = [part.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([r.astype(np.int32) for r in raw], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
        give_back()

    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


def packed(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece with sequence_id and offset; sequences are gapless from offset 0.

    A null or empty text is its end id alone. Rows that repeat a doc_id are packed as documents
    of their own; ties of length go by (doc_id, piece, crc). Empty tables give no rows. Only doc_id
    and text are read. with_ids also returns each piece's ids.
    """
    cut = pieces_of(docs, capacity=capacity, end_id=end_id, tokenizer=tokenizer, with_ids=with_ids)
    pieces = Written(cut, "pieces").df
    salts = max(32, -(-pieces.count() // ROWS_A_SALT))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sizes = Written(salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")), "sizes").df
    counts = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `capacity` rows
    table = place_table(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("_first"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_in", F.row_number().over(inside)).join(firsts, ["length", "_salt"])
    keyed = ranked.select(*pieces.columns, (F.shiftleft(F.col("length"), 44) + F.col("_first") + F.col("_in") - 1).alias("_key"))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # 24 bytes a run; runs follow the number of distinct lengths, not of documents

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            key = batch.column(batch.num_columns - 1).to_numpy()
            i = np.searchsorted(at["key"], key, side="right") - 1
            cols = [*batch.columns[:-1], pa.array(at["sequence"][i] + key - at["key"][i]), pa.array(at["offset"][i])]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return keyed.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def sequences(packed_with_ids: DataFrame) -> DataFrame:
    """sequence_id, ids: the token sequences themselves, from packed(..., with_ids=True)."""
    return packed_with_ids.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("ids"))
