"""Referential integrity, duplicates, reconciliation, coverage, set algebra and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unknown_references(rows: DataFrame, known: DataFrame, *, value: str, id_column: str, prefix: Column | str) -> DataFrame:
    """Rows whose value isn't a known id, with code prefix:unknown_reference:value."""
    ids = known.select(F.col(id_column).alias("_known")).distinct()
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return rows.where(F.col(value).isNotNull()).join(ids, F.col(value) == F.col("_known"), "left_anti").withColumn("code", F.concat(p, F.lit(":unknown_reference:"), F.col(value).cast("string")))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key in a total order, and the later ones; rows with a blank key are in neither.

    The first rows are an aggregation with map-side combine, so that a key with very many rows is no single task.
    """
    named = rows
    for k in keys:
        named = named.where(F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != ""))
    rest = [c for c in rows.columns if c not in keys]
    first = named.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"), F.min(F.struct(*order)).alias("_at"))
    later = named.join(first.select(*keys, "_at"), keys).where(F.struct(*order) > F.col("_at")).select(*rows.columns)
    return first.select(*keys, "_row.*").select(*rows.columns), later


def reconciled(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key, state (equal, differs, left_only, right_only) by null-safe comparison of all other shared columns."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    a = left.select(F.col(key), F.struct(*shared).alias("_a"), F.lit(True).alias("_l"))
    b = right.select(F.col(key), F.struct(*shared).alias("_b"), F.lit(True).alias("_r"))
    state = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.col("_a").eqNullSafe(F.col("_b")), "equal").otherwise("differs")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def zipped(left: DataFrame, right: DataFrame, position: str = "line_no") -> DataFrame:
    """Rows of equal position; raises if a position is on one side only."""
    r = right.select(*[F.col(c).alias(c if c == position or c not in left.columns else f"right_{c}") for c in right.columns], F.lit(True).alias("_r"))
    both = left.withColumn("_l", F.lit(True)).join(r, position, "full_outer")
    fine = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("the sides have different rows"))).otherwise(F.lit(True))
    return both.where(fine).drop("_l", "_r")


def set_algebra(a: Column, b: Column) -> dict[str, Column]:
    return {"only_a": F.array_sort(F.array_except(a, b)), "only_b": F.array_sort(F.array_except(b, a)), "both": F.array_sort(F.array_intersect(a, b)), "equal": F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))}


def sorted_distinct(codes: Column) -> Column:
    return F.array_sort(F.array_distinct(codes))


def first_sorted(codes: Column, n: int) -> Column:
    return F.slice(F.array_sort(codes), 1, n)


def covered(required: Column, had: Column) -> dict[str, Column]:
    """missing states in order, and PASS, PARTIAL or FAIL."""
    missing = F.array_sort(F.array_except(required, had))
    return {"missing": missing, "status": F.when(F.size(missing) == 0, "PASS").when(F.size(F.array_intersect(required, had)) > 0, "PARTIAL").otherwise("FAIL")}


def sole_membership(rows: DataFrame, *, item: str, group: str, declared: str) -> DataFrame:
    """item, memberships, ok: the groups of an item are exactly the one that it declares."""
    per = rows.groupBy(item, declared).agg(F.array_sort(F.collect_set(group)).alias("memberships"))
    return per.withColumn("ok", F.col("memberships") == F.array(F.col(declared)))


def asymmetric_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose mirror is missing, and pairs of one with itself."""
    mirror = pairs.select(F.col(b).alias("_a"), F.col(a).alias("_b")).distinct()
    lone = pairs.join(mirror, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")), "left_anti").select(a, b, F.lit("asymmetric").alias("code"))
    return lone.unionAll(pairs.where(F.col(a) == F.col(b)).select(a, b, F.lit("self").alias("code")))


def bounding_boxes(words: DataFrame, *, by: list[str], pad: int, width: int, height: int) -> DataFrame:
    """by..., words, x0, y0, x1, y1: the padded hull of each line's words within the image."""
    return words.groupBy(*by).agg(
        F.count("*").alias("words"), F.greatest(F.min("x") - pad, F.lit(0)).alias("x0"), F.greatest(F.min("y") - pad, F.lit(0)).alias("y0"),
        F.least(F.max(F.col("x") + F.col("w")) + pad, F.lit(width)).alias("x1"), F.least(F.max(F.col("y") + F.col("h")) + pad, F.lit(height)).alias("y1"),
    )


def sensitive_lines(words: DataFrame, sensitive, *, by: list[str], order: str, text: str) -> DataFrame:
    """Lines whose spaced or compact text is sensitive: by..., spaced, whole (the line) or the words to cover."""
    lines = words.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_w"))
    spaced = F.array_join(F.transform("_w", lambda w: w[text]), " ")
    compact = F.array_join(F.transform("_w", lambda w: w[text]), "")
    out = lines.select(*by, spaced.alias("spaced"), (sensitive(spaced) | sensitive(compact)).alias("whole"), F.filter("_w", lambda w: sensitive(w[text])).alias("hits"))
    return out.where(F.col("whole") | (F.size("hits") > 0))


def longest_prefix_join(rows: DataFrame, rules: list[tuple[str, str]], text: str) -> Column:
    """Matches of a dictionary (rule_id, source) in a text, longest source first, ties by rule_id; matches don't overlap."""
    from pyspark.sql.functions import regexp_extract_all

    order = sorted({s for _, s in rules}, key=lambda s: (-len(s), min(i for i, x in rules if x == s)))
    pattern = "|".join(r"\Q" + s + r"\E" for s in order)
    return regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
