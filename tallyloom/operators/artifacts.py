"""Artefacts that records name, against a listed tree: paths through links, digests, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.rules import portable_path
from tallyloom.operators.run_checks import resolved
from tallyloom.sources.shared import written

#: Links that one path may go through; more are a circle, which leads nowhere.
MOST_LINKS = 40


def _escapes(path: Column) -> Column:
    return (path == "..") | path.startswith("../") | path.startswith("/")


def real_paths(rows: DataFrame, tree: DataFrame, path: str, *, root: str = "/") -> DataFrame:
    """rows with real_path: their path below the root with all links followed; one that starts with ../ or / has left the root, null is a circle of links.

    tree: path (below root), target (what a link holds, relative to its folder or absolute; null for files). Each round follows the first link of every path.
    """
    links = tree.where("target IS NOT NULL").select(F.col("path").alias("_link"), F.col("target").alias("_target"))
    top = resolved(F.lit(root)) if root.strip("/") else F.lit("")
    now = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_now", resolved(F.col(path)))
    done = None
    for _ in range(MOST_LINKS + 1):
        now = written(now, "paths")
        parts = F.split("_now", "/")
        prefixes = F.when(_escapes(F.col("_now")), F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
        hit = now.select("_row", F.explode(prefixes).alias("_link")).join(links, "_link").groupBy("_row").agg(F.min_by(F.struct("_link", "_target"), F.length("_link")).alias("_first"))
        step = now.join(hit, "_row", "left")
        still = step.where("_first IS NULL").drop("_first")
        done = still if done is None else done.unionByName(still)
        link, target = F.col("_first._link"), F.col("_first._target")
        folder = F.regexp_extract(link, r"(?s)^(.*/)[^/]*$", 1)
        rest = F.substring(F.col("_now"), F.length(link) + 1, F.length("_now"))
        inside = (resolved(target) == top) | resolved(target).startswith(F.concat(top, F.lit("/")))
        goes = F.when(~target.startswith("/"), F.concat(folder, target, rest)).when(inside, F.concat(F.substring(resolved(target), F.length(top) + 2, F.length(target)), rest)).otherwise(F.concat(target, rest))
        now = step.where("_first IS NOT NULL").withColumn("_now", resolved(goes)).drop("_first")
        if hit.isEmpty():
            return done.withColumnRenamed("_now", "real_path").drop("_row")
    return done.unionByName(now.withColumn("_now", F.lit(None).cast("string"))).withColumnRenamed("_now", "real_path").drop("_row")


def checked_artifacts(entities: DataFrame, tree: DataFrame, *, root: str = "/") -> DataFrame:
    """case_id, entity_id, state: escapes, missing, mismatch or verified, for each entity (case_id, entity_id, path, sha256) with a portable path.

    tree: path, target, sha256. Digests are compared without case.
    """
    placed = real_paths(entities.where(portable_path(F.col("path"))).select("case_id", "entity_id", "path", "sha256"), tree, "path", root=root)
    real = tree.where("target IS NULL").select(F.col("path").alias("real_path"), F.lower("sha256").alias("_real"))
    state = F.when(_escapes(F.col("real_path")), "escapes").when(F.col("_real").isNull(), "missing").when(F.col("_real") != F.lower(F.coalesce("sha256", F.lit(""))), "mismatch").otherwise("verified")
    return placed.join(real, "real_path", "left").select("case_id", "entity_id", state.alias("state"))


def artifact_errors(states: DataFrame) -> DataFrame:
    """case_id, code of what is wrong."""
    names = {"escapes": "artifact_path_escapes_root", "missing": "artifact_missing", "mismatch": "artifact_sha256_mismatch"}
    code = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("state"))
    return states.where("state <> 'verified'").select("case_id", F.concat(F.lit("entity:"), "entity_id", F.lit(":"), code).alias("code"))


def artifact_counts(states: DataFrame) -> DataFrame:
    """case_id, checked, verified; a path that leaves the root is not checked."""
    return states.groupBy("case_id").agg(F.count_if(F.col("state") != "escapes").alias("checked"), F.count_if(F.col("state") == "verified").alias("verified"))


def manifest_check(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: missing, unlisted, digest, size and link differences between two listings (path, bytes, sha256, is_link), and both totals of files and bytes."""
    a = actual.select("path", *[F.col(c).alias(f"_{c}") for c in ("bytes", "sha256", "is_link")])
    both = declared.join(a, "path", "full_outer")
    held = F.col("bytes").isNotNull() & F.col("_bytes").isNotNull()
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return both.agg(
        n(F.col("_bytes").isNull()).alias("missing"), n(F.col("bytes").isNull()).alias("unlisted"), n(held & (F.lower("sha256") != F.lower("_sha256"))).alias("digest"), n(held & (F.col("bytes") != F.col("_bytes"))).alias("size"), n(F.col("_is_link")).alias("links"),
        F.count("bytes").alias("declared_files"), F.count("_bytes").alias("actual_files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("declared_bytes"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("actual_bytes"),
    )
