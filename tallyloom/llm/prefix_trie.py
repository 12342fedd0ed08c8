"""The trie of conversation prefixes, as intervals of its preorder.

A node is a distinct sequence of first turns; the conversations that begin with it are its members. Distinct whole
sequences are ranked in the order of their paths, so that a node's members are an interval of ranks; the nodes in the order
(first rank, depth) are the trie's preorder, and a subtree is the interval from its node to the last node of its last rank.
What is summed over a subtree is then a difference of two prefix sums, whatever the subtree's size.

Texts stay where they are read: a turn travels as 16 bytes of a digest. Prefixes are identified by sums of random
numbers drawn from (place, turn), 124 bits in all, which one running sum over the turns gives. No step
gathers a conversation, a subtree or the members of a node: numbers and sums run over ranges of sorted rows, whose totals
are added in order; paths are ranked block by block; member ids are joined to strings of a bounded number of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.llm.common import Written, scratch

#: Turns in a block of a path; ids in a chunk of a node's members.
BLOCK, CHUNK = 1024, 4096
PARTS = ("p1", "p2", "p3", "p4")
NODE = ("depth", *PARTS)


def running(rows: DataFrame, sums: dict[str, Column], order: list[str], *, by: tuple[str, ...] = ()) -> DataFrame:
    """rows with columns of sums over the rows up to each one in the order, within equal values of `by` (which are not null).

    Rows are sorted by ranges of (by, order), which are written, and summed within a range; a range then adds
    the totals of the earlier ranges of the same `by`, one row at most for each range. So one hot key is dealt out like any rows.
    """
    kept = Written(rows.select("*", *[v.cast("long").alias(n) for n, v in sums.items()]).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_at", F.monotonically_increasing_id()), "running").df
    kept = kept.withColumn("_range", F.shiftright("_at", 33))
    totals = kept.groupBy("_range", *by).agg(*[F.sum(n).alias(n) for n in sums])
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *by, *[F.sum(n).over(earlier).alias(f"_before_{n}") for n in sums]).where(F.col(f"_before_{next(iter(sums))}").isNotNull())
    inside = Window.partitionBy("_range", *by).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    summed = kept.select(*rows.columns, "_range", *[F.sum(n).over(inside).alias(n) for n in sums])
    return summed.join(F.broadcast(before), ["_range", *by], "left").select(*rows.columns, *[(F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0))).alias(n) for n in sums])


def turn_places(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, place (from 1), turn_key, n_bytes: each row is a turn, in the order of turn (null first), role, and then turn_key.

    turn_key is 16 bytes of SHA-256 of (role, text), a null one of which is empty; n_bytes is the text's size in UTF-8. Rows without a conv_id are left out.
    """
    role_of, text_of = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.length(role_of).cast("string"), F.lit(":"), role_of, text_of), 256)
    slim = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("_turn"), role_of.alias("_role"), F.unhex(F.substring(digest, 1, 32)).alias("turn_key"), F.octet_length(text_of).cast("long").alias("n_bytes")
    )
    return running(slim, {"place": F.lit(1)}, ["_turn", "_role", "turn_key"], by=("conv",)).select("conv", "place", "turn_key", "n_bytes")


def _prefixed(placed: DataFrame) -> DataFrame:
    """placed with p1..p4, the identity of the prefix that ends at each turn, and q1..q4, that of the prefix before it."""
    words = [F.xxhash64(F.lit(seed), F.col("place"), F.col("turn_key")) for seed in (11, 12)]
    draws = [f(w) for w in words for f in (lambda w: F.shiftrightunsigned(w, 33), lambda w: w.bitwiseAND((1 << 31) - 1))]
    drawn = placed.select("*", *[d.alias(f"_{n}") for n, d in zip(PARTS, draws)])
    summed = running(drawn, {n: F.col(f"_{n}") for n in PARTS}, ["place"], by=("conv",))
    return summed.select("conv", F.col("place").alias("depth"), "turn_key", "n_bytes", *PARTS, *[(F.col(n) - F.col(f"_{n}")).alias(f"q{n[1]}") for n in PARTS])


def _path_ranks(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, rank (from 1): conversations, which all differ, in the order of their sequences of turn_key, a prefix before what continues it.

    Sequences are cut into blocks; equal blocks get one number, in the order of blocks, and stand for them in the sequences of the next round.
    """
    level = paths.select("conv", (F.col("depth") - 1).alias("i"), F.col("turn_key").alias("v"))
    while True:
        blocks = level.groupBy("conv", F.floor(F.col("i") / BLOCK).alias("i")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("path"))
        blocks = Written(blocks, "blocks").df
        if (blocks.agg(F.max("i")).first()[0] or 0) == 0:
            break
        numbers = running(blocks.select("path").distinct(), {"v": F.lit(1)}, ["path"])
        level = Written(blocks.join(numbers, "path").select("conv", "i", "v"), "level").df
    whole = convs.join(blocks.select("conv", "path"), "conv", "left").withColumn("path", F.coalesce("path", F.array().cast(blocks.schema["path"].dataType)))
    return running(whole, {"rank": F.lit(1)}, ["path"]).select("conv", "rank")


def _member_digests(lasts: DataFrame) -> DataFrame:
    """NODE, ends_sha256: digest of the ids of the conversations that end at a node, in order, joined by commas.

    Ids are joined to strings of at most CHUNK ids; a node's strings, CHUNK times fewer than its share of all ids, go through one running digest, which keeps nothing.
    """
    chunks = running(lasts, {"n": F.lit(1)}, ["conv"]).groupBy(*NODE, F.floor(F.col("n") / CHUNK).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    names = [*NODE, "ends_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if node != at:
                    if at:
                        done.append([*at, digest.hexdigest()])
                    at, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in [*at, digest.hexdigest()]], names=names)

    return ordered.mapInArrow(run, ", ".join([f"{n} long" for n in NODE] + ["ends_sha256 string"]))


def prefix_trie(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each node, of the conversations `conv` of convs with the turns (conv, place, turn_key, n_bytes) of placed.

    conv_id, depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256, position and
    subtree_end (in the preorder, from 1): see the module and :func:`turn_places`. A conversation without turns is a member
    of the root alone. Conversations of equal turns share all nodes. Without conversations there is no node. convs has each conversation once, and all of placed.
    """
    with scratch(placed.sparkSession, "trie"):
        paths = Written(_prefixed(placed), "paths").df
        last = paths.groupBy("conv").agg(F.max_by(F.struct("depth", *PARTS), "depth").alias("_last"))
        lasts = Written(convs.select("conv").join(last, "conv", "left").select("conv", *[F.coalesce(F.col("_last")[n], F.lit(0)).cast("long").alias(n) for n in NODE]), "lasts").df
        first = Written(lasts.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("n")), "sequences").df
        own = Written(paths.join(first.select("conv", "n"), "conv"), "own").df  # the turns of one conversation of each sequence
        ranks = Written(_path_ranks(own, first.select("conv", "n")).join(first.select("conv", "n"), "conv"), "ranks").df
        zero = F.lit(0).cast("long")
        rows = own.drop("n").join(ranks, "conv").select("conv", "rank", "n", *NODE, *[f"q{n[1]}" for n in PARTS], "n_bytes")
        rows = rows.unionByName(ranks.select("conv", "rank", "n", *[zero.alias(c) for c in (*NODE, "q1", "q2", "q3", "q4", "n_bytes")]))
        nodes = rows.groupBy(*NODE, "q1", "q2", "q3", "q4").agg(
            F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"), F.min("rank").alias("first"), F.max("rank").alias("last"), F.max("n_bytes").alias("n_bytes")
        )
        nodes = Written(nodes, "nodes").df
        above = [(F.col("depth") - 1).alias("depth"), *[F.col(f"q{n[1]}").alias(n) for n in PARTS]]
        counted = nodes.where("depth > 0").select(*above).groupBy(*NODE).agg(F.count("*").alias("n_children"))
        nodes = nodes.join(counted, list(NODE), "left").withColumn("n_children", F.coalesce("n_children", zero))
        own_sums = {"position": F.lit(1), "leaves": F.when(F.col("n_children") == 0, 1).otherwise(0), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")}
        nodes = Written(running(nodes, own_sums, ["first", "depth"]), "preorder").df
        ends = nodes.groupBy(F.col("first").alias("last")).agg(F.max("position").alias("subtree_end"), F.max("leaves").alias("_leaves"), F.max("saved").alias("_saved"))
        parents = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(n).alias(f"q{n[1]}") for n in PARTS], F.col("conv_id").alias("parent_conv_id"))
        found = nodes.join(ends, "last").join(parents, ["depth", "q1", "q2", "q3", "q4"], "left").join(_member_digests(lasts), list(NODE), "left")
        found = found.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            (F.col("_leaves") - F.col("leaves") + own_sums["leaves"]).alias("n_leaves"), (F.col("_saved") - F.col("saved") + own_sums["saved"]).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "position", "subtree_end",
        )
        return Written(found, "trie", outside=True).df
