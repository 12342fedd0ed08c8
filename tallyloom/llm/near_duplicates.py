"""Near-duplicate documents by Order MinHash with banded alignment.

Marcais et al., "Locality-sensitive hashing for the edit distance" (2019): a sketch holds,
for one hash function, the several least occurrence-labelled word shingles in the order they
have in the text; texts with an equal sketch are candidates. Candidates are linked if a
banded alignment of their shingle sequences matches m with m / (n1 + n2 - m) >= 0.8.

1. Texts of equal words are one node; nodes are numbered by their least doc_id. 2. In each
bucket of equal sketches every node is aligned with the bucket's first node. 3. Linked nodes
make components. 4. Buckets that still hold several components are solved exactly, without
pairs inside a component: small ones as one block; the nodes of large ones, such as texts that
share a long passage, are dealt anew by their rarest shingles, and those groups are solved in
blocks of bounded size. Blocks return linked components, not pairs. 5. Components of all links
are the classes; a class is named by its least doc_id.

Sketches of short texts miss more, so texts of up to 30 shingles have further buckets, an exact
prefix filter: of two that are alike, no pair with a text of up to 24 shingles is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tallyloom.llm.alignment import DENOMINATOR, NUMERATOR, alike, shared_counts
from tallyloom.llm.common import Written, fresh, give_back, scratch
from tallyloom.llm.components import connected_components
from tallyloom.llm.shingles import STEP, Shingled, mix, shingled


@dataclass(frozen=True)
class Settings:
    """A pair of similarity 0.8 shares one of 14 sketches of 4 minima with probability 1 - (1 - p)^14.

    The minima are drawn without replacement: of n shingles, k of them shared, p = C(k, 4) / C(n, 4), which is near
    0.8^4 for long texts (over 0.999 in all) and less for short ones: 0.956 for 4 of 5, 0.9966 for 8 of 10, 0.9989
    for 20 of 25. Texts of up to `short` shingles therefore are in the buckets of their first labelled shingles too.
    """

    words: int = 5
    sketches: int = 14
    minima: int = 4
    short: int = 30
    block: int = 192
    seed: int = 11
    max_broadcast_keys: int = 500_000  # of 16 bytes, or ids; more of them are joined by shuffle


def bucketing(s: Settings) -> Callable[[Shingled], np.ndarray]:
    """The buckets of a text: one for each sketch, and for short texts those of its first shingles.

    A pair of similarity 0.8 shares 0.8 of the labelled shingles of either text, so it has one in common among the
    n - ceil(0.8 n) + 1 of each that come first in one order, here that of the hashes.
    """
    seeds = mix(np.arange(1, 2 * s.sketches + 2, dtype=np.uint64) * STEP + np.uint64(s.seed))
    times, plus, salt = seeds[: s.sketches, None] | np.uint64(1), seeds[s.sketches : -1, None], seeds[-1]
    which = np.arange(s.sketches, dtype=np.uint64) + np.uint64(1)

    def buckets(x: Shingled) -> np.ndarray:
        n = len(x.shingles)
        if n == 0:
            return np.zeros(0, np.int64)
        values = mix(x.labelled[None, :] * times + plus)
        least = np.argpartition(values, s.minima - 1, axis=1)[:, : s.minima] if n > s.minima else np.broadcast_to(np.arange(n), values.shape)
        key = which
        for column in np.sort(least, axis=1).T:  # in the order of the text
            key = mix(key * STEP + x.shingles[column])
        if n <= s.short:
            first = np.sort(x.labelled)[: n + n * NUMERATOR // -DENOMINATOR + 1]
            key = np.concatenate([key, mix(first + salt)])
        return key.astype(np.int64)

    return buckets


def sketched(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, key (128 bits of the words), n (shingles), buckets, seq (32-bit shingle hashes in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = bucketing(s)
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                keys, sizes, buckets, seqs = [], [], [], []
                for x in shingled(pc.fill_null(part.column(1), ""), s.words):
                    keys.append(x.key)
                    sizes.append(len(x.shingles))
                    seqs.append((x.shingles >> np.uint64(32)).astype("<u4").tobytes())
                    buckets.append(of(x))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(buckets, pa.list_(pa.int64())), pa.array(seqs, pa.binary())],
                    names=["doc_id", "key", "n", "buckets", "seq"],
                )
        give_back()

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, key binary, n int, buckets array<bigint>, seq binary")


def aligned_pairs(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that are alike; each node's sequence is fetched by a join."""
    with_a = pairs.join(seqs.select(F.col("node").alias("a"), F.col("seq").alias("_seq_a")), "a")
    both = with_a.join(seqs.select(F.col("node").alias("b"), F.col("seq").alias("_seq_b")), "b").select("a", "b", "_seq_a", "_seq_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = [alike(np.frombuffer(a[i].as_py(), "<u4"), np.frombuffer(b[i].as_py(), "<u4")) for i in range(len(batch))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _blocks_solved(rows: DataFrame) -> DataFrame:
    """Linked components (a, b) found inside groups of (bucket, x, y), whose rows come one after another."""

    def solve(comps: list[int], sides: list[bool], seqs: list[bytes]) -> list[tuple[int, int]]:
        arrays = [np.frombuffer(q, "<u4") for q in seqs]
        sizes = np.array([len(x) for x in arrays])
        root = {c: c for c in comps}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        may = shared_counts(arrays) * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (sizes[:, None] + sizes[None, :])
        main = np.array(sides)
        may &= ~(main[:, None] & main[None, :])
        for i, j in zip(*np.nonzero(np.triu(may, 1)), strict=True):
            x, y = find(comps[i]), find(comps[j])
            if x != y and alike(arrays[i], arrays[j]):
                root[max(x, y)] = min(x, y)
        return [(find(c), c) for c in root if find(c) != c]  # named alike in all blocks that hold them, so that few different pairs are left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [])

        def out() -> pa.RecordBatch:
            got = solve(*held)
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["a", "b"])

        for batch in batches:
            for bucket, x, y, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, x, y) != at:
                    if at is not None and len(held[0]) > 1:
                        yield out()
                    at, held = (bucket, x, y), ([], [], [])
                for values, value in zip(held, row, strict=True):
                    values.append(value)
        if at is not None and len(held[0]) > 1:
            yield out()

    cols = ("bucket", "x", "y")
    return rows.select(*cols, "comp", "main", "seq").repartition(*cols).sortWithinPartitions(*cols).mapInArrow(run, "a long, b long")


def _unsettled(members: DataFrame, settled: int) -> DataFrame:
    """bucket, size, c and _top (the largest component and its number of nodes) of buckets (bucket, node, comp) with several components.

    Buckets of up to `settled` nodes have been solved before. Buckets of the same nodes are needed once.
    """
    per = members.groupBy("bucket", "comp").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("s1"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("s2"))
    total = per.groupBy("bucket").agg(F.sum("c").alias("size"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("top"), F.sum("s1").alias("s1"), F.bit_xor("s2").alias("s2"))
    once = total.where((F.col("comps") > 1) & (F.col("size") > settled)).groupBy("size", "s1", "s2").agg(F.min(F.struct("bucket", "top")).alias("_g"))
    return once.select("_g.bucket", F.col("_g.top.comp").alias("_top"), "_g.top.c", "size")


def _blocks(members: DataFrame, buckets: DataFrame, seqs: DataFrame, block: int) -> DataFrame:
    """Rows of the blocks (bucket, x, y) of unsettled buckets.

    A bucket's largest component (main) is cut into chunks 0, 1, ... and the other nodes into
    chunks -1, -2, ...; blocks are all pairs of chunks but two of the main component.
    """
    some = members.join(buckets, "bucket").withColumn("main", F.col("comp") == F.col("_top"))
    n_main = F.ceil(F.col("c") / block)
    n_rest = F.ceil((F.col("size") - F.col("c")) / block)
    chunk = F.when(F.col("main"), F.pmod(F.xxhash64("node"), n_main)).otherwise(-1 - F.pmod(F.xxhash64("node"), n_rest))
    others = F.when(F.col("main"), F.sequence(-n_rest, F.lit(-1).cast("bigint"))).otherwise(F.sequence(-n_rest, n_main - 1))
    spread = some.withColumn("_chunk", chunk).withColumn("_other", F.explode(others))
    spread = spread.select("bucket", F.least("_chunk", "_other").alias("x"), F.greatest("_chunk", "_other").alias("y"), "node", "comp", "main")
    return spread.join(seqs, "node")


def _labels(seq: bytes) -> np.ndarray:
    """Hashes of a sequence's shingles, each with how often it came before, so that no two of a text are alike."""
    x = np.sort(np.frombuffer(seq, "<u4"))
    start = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    times = np.arange(len(x)) - np.repeat(start, np.diff(np.concatenate([start, [len(x)]])))
    return mix((x.astype(np.uint64) << np.uint64(32)) + times.astype(np.uint64))


#: Labels are counted in so many slots, by their first bits; a chunk of them is a row. 4 MB in all, whatever the input.
SLOTS, CHUNK = 1 << 22, 1 << 16


def _slots(labels: np.ndarray) -> np.ndarray:
    return (labels >> np.uint64(64 - 22)).astype(np.int64)


def _frequencies(rows: DataFrame) -> np.ndarray:
    """For each slot a byte that rises with the number of its labels in rows (node, comp, seq): 0 and 1 as they are, then steps of an eighth of a power of two.

    Each task counts in its own slots, and their chunks are added up one by one; only the bytes reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for seq in batch.column(0):
                np.add.at(held, _slots(_labels(seq.as_py())), 1)
        for c in range(SLOTS // CHUNK):
            part = held[c * CHUNK : (c + 1) * CHUNK]
            if len(at := np.flatnonzero(part)):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([at.astype("<u2").tobytes()]), pa.array([part[at].astype("<i8").tobytes()])], names=["chunk", "at", "times"])
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(CHUNK, np.int64)

        def out() -> pa.RecordBatch:
            steps = np.where(held > 1, 2 + np.floor(8 * np.log2(np.maximum(held, 2) / 2)), held).clip(max=255)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([steps.astype("u1").tobytes()])], names=["chunk", "often"])

        for batch in batches:
            for c, at, times in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != now:
                    if now is not None:
                        yield out()
                    now, held = c, np.zeros(CHUNK, np.int64)
                held[np.frombuffer(at, "<u2")] += np.frombuffer(times, "<i8")
        if now is not None:
            yield out()

    counted = rows.select("seq").mapInArrow(count, "chunk int, at binary, times binary")
    often = np.zeros(SLOTS, np.uint8)
    for c, of in counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk int, often binary").collect():
        often[c * CHUNK : (c + 1) * CHUNK] = np.frombuffer(of, np.uint8)
    return often


def _by_rare_shingles(members: DataFrame, seqs: DataFrame) -> DataFrame:
    """bucket, node, comp: nodes (node, comp) dealt anew by occurrence-labelled shingles, so that any two alike meet.

    Two sequences that match 0.8 share 0.8 of the shingles of either, so they have one in common among the first
    n - ceil(0.8 n) + 1 of each, in any one order; the order is by frequency among these nodes, as counted in slots. A
    passage that many texts share is frequent, and brings no two of them together. Slots that hold one label are of
    shingles that no other node has. A node's labels stay in its row, and only those that deal it out become rows.
    """
    rows = Written(members.join(seqs, "node").select("node", "comp", "seq"), "dealt").df
    often = _frequencies(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, comp, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                labels = _labels(seq)
                times = often[_slots(labels)]
                first = np.lexsort((labels, times))[: len(labels) + len(labels) * NUMERATOR // -DENOMINATOR + 1]
                picked = labels[first[times[first] > 1]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(picked), pa.array(np.full(len(picked), node)), pa.array(np.full(len(picked), comp))], names=["bucket", "node", "comp"])

    return rows.mapInArrow(run, "bucket long, node long, comp long")


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, class_id, kept, key (128 bits of the words) for every row of docs (doc_id, text; other columns are not read).

    class_id is the least doc_id of the class, kept whether the row has it. Texts with equal
    lower-cased words are always one class; a null text is empty, and texts without words are one
    class. A text of fewer than five words equals only texts of the same words. Rows with a null
    doc_id take part; class_id is null, and all its rows kept, only where no row of a class has
    an id. Repeated rows get one row each. Empty tables give no rows.
    """
    with scratch(docs.sparkSession, "near-duplicates"):
        return Written(_classes(docs, settings), "classes", outside=True).df


def _numbered(rows: DataFrame) -> DataFrame:
    """node, key, least, buckets: texts of different words, numbered by the least doc_id of their rows (none last).

    So the smallest node of a class has the class's least doc_id, and all that follows works on longs.
    """
    unique = rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("buckets").alias("buckets"))
    order = (F.col("least").isNull(), F.col("least"), F.col("key"))
    ordered = unique.repartitionByRange(*order).sortWithinPartitions(*order)  # the numbers rise with the ranges, so they are given before anything is written
    return ordered.select(F.monotonically_increasing_id().alias("node"), "key", "least", "buckets")


def _linked(nodes: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """node, component (its smallest node) of all nodes that are linked to another one."""
    members = nodes.select(F.explode("buckets").alias("bucket"), "node")
    heads = Written(members.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("c")).where("c > 1"), "heads").df
    shared = Written(members.join(heads, "bucket"), "buckets").df
    wanted = Written(nodes.select("node", "key").join(shared.select("node"), "node", "left_semi"), "wanted").df
    few = wanted.count() <= s.max_broadcast_keys
    seqs = Written(rows.select("key", "seq").join(F.broadcast(wanted) if few else wanted, "key").groupBy("node").agg(F.first("seq").alias("seq")), "sequences").df
    stars = shared.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    comp = connected_components(aligned_pairs(stars, seqs), "a", "b")
    placed = shared.where("c > 2").select("bucket", "node").join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("comp"))
    placed = Written(placed, "placed").df
    open_ = Written(_unsettled(placed, 2), "unsettled").df
    more = _blocks_solved(_blocks(placed, open_.where(F.col("size") <= s.block), seqs, s.block))
    large = open_.where(F.col("size") > s.block)
    if not large.isEmpty():
        again = Written(_by_rare_shingles(placed.join(large.select("bucket"), "bucket").select("node", "comp").distinct(), seqs), "rare").df
        more = more.unionAll(_blocks_solved(_blocks(again, _unsettled(again, 1), seqs, s.block)))
    more = Written(more.distinct(), "more-links").df
    if more.isEmpty():
        return comp
    up = connected_components(more, "a", "b").select(F.col("node").alias("comp"), F.col("component").alias("_root"))
    known = comp.unionByName(up.select(F.col("comp").alias("node"), F.col("comp").alias("component")).join(comp.select("node"), "node", "left_anti"))
    return known.join(up, known["component"] == up["comp"], "left").select("node", F.coalesce("_root", "component").alias("component"))


def _classes(docs: DataFrame, s: Settings) -> DataFrame:
    rows = Written(sketched(docs, s), "sketches").df
    nodes = Written(_numbered(rows), "nodes").df
    comp = Written(_linked(nodes, rows, s), "linked").df
    names = Written(comp.select("component").distinct().join(nodes.select(F.col("node").alias("component"), F.col("least").alias("_least")), "component"), "names").df
    of_node = Written(comp.join(names, "component").select("node", F.col("_least").alias("_class")), "classes").df
    of_key = Written(nodes.join(of_node.withColumn("_in", F.lit(True)), "node", "left").select("key", F.when(F.col("_in"), F.col("_class")).otherwise(F.col("least")).alias("class_id")), "keys").df
    out = rows.select("doc_id", "key").join(of_key, "key")
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.col("class_id").isNull() & F.col("doc_id").isNull(), F.lit(False)).alias("kept"), "key")


def keyed(docs: DataFrame, words: int) -> DataFrame:
    """All columns of docs with the key of the text's words as _key."""
    name, at = fresh(docs.columns, "_key"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [x.key for x in shingled(pc.fill_null(batch.column(at), ""), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, BinaryType())]))


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, with all their columns, of which one stays for each class (any one of equal rows)."""
    found = near_duplicates(docs, settings)
    per_id = Written(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or("kept").alias("_stays"), F.count_if("kept").alias("_times")), "stays").df
    gone = per_id.where("NOT _stays").select(F.col("doc_id").alias("_gone_id"))
    few = gone.count() <= settings.max_broadcast_keys
    out = docs.where("doc_id IS NOT NULL").join(F.broadcast(gone) if few else gone, docs["doc_id"] == gone["_gone_id"], "left_anti")
    if not per_id.where("_times > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", "text"])
    nameless = found.where("kept AND doc_id IS NULL").select("key").distinct()
    if nameless.isEmpty():
        return out
    rows = keyed(docs.where("doc_id IS NULL"), settings.words)
    name = rows.columns[-1]
    once = rows.join(nameless.withColumnRenamed("key", "_kept_key"), F.col(name) == F.col("_kept_key"), "left_semi").dropDuplicates([name])
    return out.unionByName(once.drop(name))
