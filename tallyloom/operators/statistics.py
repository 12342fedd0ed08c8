"""Macro-F1, paired decision scores, percentiles and bootstrap intervals.

A bootstrap replicate is a weight for each cluster or row, so that resampling is a join with
a table of weights and an aggregation; rows are never repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.operators.ranking import numbered
from tallyloom.operators.scoring import BOTTOM, ratio
from tallyloom.sources.shared import written

#: Fixed labels.
DECISIONS = ("VIOLATION", "NON_VIOLATION", "INSUFFICIENT_EVIDENCE")


def percentile_linear(value: Column, q: float) -> Column:
    """Exact, with linear interpolation between the neighbours of (n - 1) q; null for no rows."""
    return F.percentile(value, F.lit(q))


def percentile_nearest(value: Column, q: float) -> Column:
    """The member at round-half-even((n - 1) q) of the sorted values; values of a group come together, so groups are bounded."""
    listed = F.array_sort(F.collect_list(value))
    return F.element_at(listed, (F.bround((F.size(listed) - 1) * F.lit(q)) + 1).cast("int"))


#: Bits of a code that one pass of the selection looks at.
RADIX = 16


def _ordered_codes(rows: DataFrame, by: str) -> DataFrame:
    """by, _code: longs in the order of the doubles of column _v; -0.0 is 0.0, NaN the greatest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = (batch.column(1).to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))], names=[by, "_code"])

    return rows.select(by, "_v").mapInArrow(run, f"{by} {rows.schema[by].dataType.simpleString()}, _code long")


def _decoded(codes: pa.Array) -> pa.Array:
    code = codes.to_numpy()
    return pa.array((code ^ ((code >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64))


def exact_percentiles(rows: DataFrame, *, by: str, value: str, qs: dict[str, float], nearest: bool = False) -> DataFrame:
    """by and a column for each q: exact percentiles of groups of any size, interpolated or nearest by half-even.

    Radix selection: doubles become longs of the same order, equal ones a count; each pass counts the next 16 bits of the values that share a
    wanted rank's bits so far, and keeps for each rank the one digit that holds it. Passes are aggregations with map-side combine, so neither a huge group
    nor values that lie close together beside an outlier gather in one task. Null values are left out, a null group is a group.
    """
    codes = _ordered_codes(rows.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v")), by)
    codes = written(codes.groupBy(by, "_code").agg(F.count("*").alias("_c")), "codes")
    at = lambda q: (F.col("_n") - 1) * F.lit(q)
    wanted = F.array_distinct(F.array(*[x.cast("bigint") for q in qs.values() for x in ((F.bround(at(q)),) if nearest else (F.floor(at(q)), F.ceil(at(q))))]))
    active = codes.groupBy(by).agg(F.sum("_c").alias("_n")).select(F.col(by).alias("_by"), "_n", F.lit(0).cast("bigint").alias("_below"), wanted.alias("_ranks"), F.lit(0).cast("bigint").alias("_prefix"))
    for shift in range(64 - RADIX, -1, -RADIX):
        first = shift == 64 - RADIX
        same = codes[by].eqNullSafe(active["_by"]) if first else codes[by].eqNullSafe(active["_by"]) & (F.shiftright(codes["_code"], shift + RADIX) == active["_prefix"])
        hist = codes.groupBy(by, F.shiftright("_code", shift).alias("_digit")).agg(F.sum("_c").alias("_c")) if first else codes.join(active, same, "left_semi").groupBy(by, F.shiftright("_code", shift).alias("_digit")).agg(F.sum("_c").alias("_c"))
        above = F.lit(0).cast("bigint") if first else F.shiftright("_digit", RADIX)
        hist = hist.withColumn("_above", above)
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(by, "_above").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 65,536 digits at most
        placed = hist.withColumn("_before", before).join(active, hist[by].eqNullSafe(active["_by"]) & (F.col("_above") == active["_prefix"]))
        low = F.col("_below") + F.col("_before")
        hit = placed.withColumn("_ranks", F.filter("_ranks", lambda r: (r >= low) & (r < low + F.col("_c")))).where(F.size("_ranks") > 0)
        active = written(hit.select("_by", "_n", low.alias("_below"), "_ranks", F.col("_digit").alias("_prefix")), "ranks")
    kind = active.schema["_by"].dataType.simpleString()

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _decoded(batch.column(3))], names=["_by", "_n", "_r", "_v"])

    found = active.select("_by", "_n", F.explode("_ranks").alias("_r"), "_prefix").mapInArrow(values, f"_by {kind}, _n long, _r long, _v double")
    found = found.groupBy("_by", "_n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"))  # two ranks a q
    pick = lambda r: F.element_at("_m", r.cast("bigint"))

    def result(q: float) -> Column:
        if nearest:
            return pick(F.bround(at(q)))
        low, high = F.floor(at(q)), F.ceil(at(q))
        return pick(low) + F.when(low == high, F.lit(0.0)).otherwise((pick(high) - pick(low)) * (at(q) - low))

    return found.select(F.col("_by").alias(by), *[result(q).alias(name) for name, q in qs.items()])


def label_f1(gold: Column, pred: Column, label: str, weight: Column | None = None) -> Column:
    """2 tp / (2 tp + fp + fn), 0 where undefined."""
    w = F.lit(1) if weight is None else weight
    n = lambda c: F.sum(F.when(c, w).otherwise(0))
    tp = n((gold == label) & (pred == label))
    p = ratio(tp, n(pred == label))
    r = ratio(tp, n(gold == label))
    return ratio(2 * p * r, p + r)


def macro_f1(gold: Column, pred: Column, labels: tuple[str, ...], weight: Column | None = None) -> Column:
    """Mean over the fixed labels; one that never occurs counts 0."""
    return sum((label_f1(gold, pred, x, weight) for x in labels), F.lit(0.0)) / len(labels)


def decision_scores(prefix: str, types: tuple[str, ...], decisions: tuple[str, ...] = DECISIONS, weight: Column | None = None) -> dict[str, Column]:
    """Accuracy and macro-F1 of decisions over all rows, macro-F1 of types over gold violations, exact hierarchy."""
    w = F.lit(1) if weight is None else weight
    d, t = F.col(f"{prefix}_pred_decision"), F.col(f"{prefix}_pred_type")
    gd, gt = F.col("gold_decision"), F.col("gold_type")
    violation = gd == decisions[0]
    gold_type = F.when(violation, gt)
    pred_type = F.when(violation, F.when(d == decisions[0], t).otherwise(F.lit(BOTTOM)))
    all_rows = F.sum(w)
    return {
        f"{prefix}_decision_accuracy": ratio(F.sum(F.when(gd == d, w).otherwise(0)), all_rows),
        f"{prefix}_decision_macro_f1": macro_f1(gd, d, decisions, weight),
        f"{prefix}_violation_type_macro_f1": macro_f1(gold_type, pred_type, types, weight),
        f"{prefix}_hierarchical_exact_match": ratio(F.sum(F.when((gd == d) & (gt == t), w).otherwise(0)), all_rows),
    }


def paired_scores(types: tuple[str, ...], decisions: tuple[str, ...] = DECISIONS, weight: Column | None = None) -> list[Column]:
    """Gate rate, web and gated scores, and what the gate costs in accuracy."""
    w = F.lit(1) if weight is None else weight
    web, gated = (decision_scores(p, types, decisions, weight) for p in ("web", "gated"))
    loss = web["web_decision_accuracy"] - gated["gated_decision_accuracy"]
    gate = ratio(F.sum(F.when(F.col("gate_pass"), w).otherwise(0)), F.sum(w))
    return [gate.alias("entry_gate_pass"), *[c.alias(k) for k, c in (web | gated).items()], loss.alias("gate_loss")]


PAIRED_METRICS = ("entry_gate_pass", *(f"{p}_{m}" for p in ("web", "gated") for m in ("decision_accuracy", "decision_macro_f1", "violation_type_macro_f1", "hierarchical_exact_match")), "gate_loss")


def cluster_index(rows: DataFrame, cluster: str) -> DataFrame:
    """cluster, idx: sorted clusters numbered from 0."""
    return numbered(rows.select(cluster).distinct(), [cluster], "_place").select(cluster, (F.col("_place") - 1).cast("int").alias("idx"))


def hash_draws(spark, replicates: int, size: int, *, salt: str) -> DataFrame:
    """replicate, idx, times: draws by MD5 that any SQL engine can repeat; made on the executors."""
    n = spark.range(replicates * size)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), F.col("id").cast("string"))), 1, 12), 16, 10).cast("bigint") % size
    return n.select((F.floor(F.col("id") / size)).cast("int").alias("replicate"), drawn.cast("int").alias("idx")).groupBy("replicate", "idx").agg(F.count("*").alias("times"))


def cluster_bootstrap(sums: DataFrame, draws: DataFrame, metrics: dict[str, Column], *, cluster: str, qs=(0.025, 0.975), percentile=percentile_linear) -> DataFrame:
    """metric, ci_low, ci_high. sums: one row of additive totals per cluster; metrics: aggregates over `w`-weighted totals; percentile: percentile_linear or percentile_nearest."""
    indexed = sums.join(cluster_index(sums, cluster), cluster)
    reps = draws.join(indexed, "idx").withColumnRenamed("times", "w").groupBy("replicate").agg(*[c.alias(k) for k, c in metrics.items()])
    long = reps.unpivot(["replicate"], list(metrics), "metric", "value").where(~F.isnan("value") & F.col("value").isNotNull())
    return long.groupBy("metric").agg(percentile(F.col("value"), qs[0]).alias("ci_low"), percentile(F.col("value"), qs[1]).alias("ci_high"))


def paired_totals(types: tuple[str, ...], decisions: tuple[str, ...] = DECISIONS, prefixes: tuple[str, ...] = ("web", "gated")) -> dict[str, Column]:
    """0/1 columns whose sums are all that the paired scores need: rows, passes, right answers, and for each label its gold, predicted and right ones."""
    gd, gt = F.col("gold_decision"), F.col("gold_type")
    violation = gd == decisions[0]
    out = {"rows": F.lit(True)} | ({"gate": F.col("gate_pass")} if "gated" in prefixes else {})
    out |= {f"gold_d{i}": gd == x for i, x in enumerate(decisions)} | {f"gold_t{i}": violation & (gt == x) for i, x in enumerate(types)}
    for p in prefixes:
        d, t = F.col(f"{p}_pred_decision"), F.col(f"{p}_pred_type")
        told = violation & (d == decisions[0])
        out |= {f"{p}_right": gd == d, f"{p}_exact": (gd == d) & (gt == t)}
        out |= {f"{p}_d{i}": d == x for i, x in enumerate(decisions)} | {f"{p}_hit_d{i}": (gd == x) & (d == x) for i, x in enumerate(decisions)}
        out |= {f"{p}_t{i}": told & (t == x) for i, x in enumerate(types)} | {f"{p}_hit_t{i}": told & (gt == x) & (t == x) for i, x in enumerate(types)}
    return {name: F.coalesce(c, F.lit(False)).cast("int") for name, c in out.items()}


def scores_of_totals(types: tuple[str, ...], decisions: tuple[str, ...] = DECISIONS, prefixes: tuple[str, ...] = ("web", "gated")) -> dict[str, Column]:
    """The paired scores from columns of totals, named as paired_totals names them."""
    n, out = F.col("rows"), {}

    def f1(p: str, kind: str, labels: tuple[str, ...]) -> Column:
        each = []
        for i in range(len(labels)):
            precision, recall = (ratio(F.col(f"{p}_hit_{kind}{i}"), F.col(c)) for c in (f"{p}_{kind}{i}", f"gold_{kind}{i}"))
            each.append(ratio(2 * precision * recall, precision + recall))
        return sum(each, F.lit(0.0)) / len(labels)

    for p in prefixes:
        out |= {
            f"{p}_decision_accuracy": ratio(F.col(f"{p}_right"), n), f"{p}_decision_macro_f1": f1(p, "d", decisions),
            f"{p}_violation_type_macro_f1": f1(p, "t", types), f"{p}_hierarchical_exact_match": ratio(F.col(f"{p}_exact"), n),
        }
    if "gated" in prefixes:
        out = {"entry_gate_pass": ratio(F.col("gate"), n)} | out | {"gate_loss": out["web_decision_accuracy"] - out["gated_decision_accuracy"]}
    return out


def resampled_totals(totals: DataFrame, draws: DataFrame, columns: list[str], *, by: str, order: list[str], block: int = 1024) -> DataFrame:
    """by, replicate and columns: the totals of each replicate, as a product of its weights with the rows' totals, block of rows by block of rows.

    totals has a row for each (by, order); draws (stream, replicate, idx, times) weigh the rows of the stream named like their `by`, by their place from 0. A task holds one
    block: `block` rows of totals, and a weight for each of them and each replicate; only a row of sums for each replicate leaves it.
    """
    names = ["_by", "_replicate", *columns]
    placed = numbered(totals.select(by, *order, *columns), [by, *order], "_place")
    starts = placed.groupBy(by).agg(F.min("_place").alias("_start"))
    place = (F.col("_place") - F.col("_start")).cast("long")
    rows = placed.join(starts, by).select(F.col(by).cast("string").alias("_by"), F.floor(place / block).alias("_block"), (place % block).cast("int").alias("_row"), *columns)
    weights = draws.select(F.col("stream").alias("_by"), F.floor(F.col("idx") / block).alias("_block"), F.col("replicate").cast("int").alias("_replicate"), (F.col("idx") % block).cast("int").alias("_row"), F.col("times").cast("int").alias("_times"))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [pa.string(), pa.int32(), *[pa.int64()] * len(columns)]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        held = np.zeros((block, len(columns)), np.int64)
        held[left["_row"].to_numpy()] = np.stack([left[c].to_numpy() for c in columns], axis=1)
        replicates, at = np.unique(right["_replicate"].to_numpy(), return_inverse=True)
        weight = np.zeros((len(replicates), block))
        np.add.at(weight, (at, right["_row"].to_numpy()), right["_times"].to_numpy())
        sums = np.rint(weight @ held.astype(np.float64)).astype(np.int64)  # exact below 2^53
        return pa.table([pa.array([left["_by"][0].as_py()] * len(replicates)), pa.array(replicates, pa.int32()), *(pa.array(c) for c in sums.T)], names=names)

    schema = ", ".join(["_by string", "_replicate int", *(f"{c} long" for c in columns)])
    parts = rows.groupBy("_by", "_block").cogroup(weights.groupBy("_by", "_block")).applyInArrow(product, schema)
    return parts.groupBy(F.col("_by").alias(by), F.col("_replicate").alias("replicate")).agg(*[F.sum(c).alias(c) for c in columns])


def paired_bootstrap(
    rows: DataFrame, draws: DataFrame, types: tuple[str, ...], *, by: str = "model", order: str = "ordinal", decisions: tuple[str, ...] = DECISIONS, qs=(0.025, 0.975), prefixes: tuple[str, ...] = ("web", "gated"), block: int = 1024
) -> DataFrame:
    """by, metric, point, ci_low, ci_high: web and gated scores from the same draws (stream, replicate, idx, times). Percentiles are those of one value a replicate."""
    kept = written(rows.groupBy(by, order).agg(*[F.sum(c).alias(n) for n, c in paired_totals(types, decisions, prefixes).items()]), "totals")
    columns, scores = list(paired_totals(types, decisions, prefixes)), scores_of_totals(types, decisions, prefixes)
    reps = resampled_totals(kept, draws, columns, by=by, order=[order], block=block).select(by, "replicate", *[c.alias(n) for n, c in scores.items()])
    long = reps.unpivot([by, "replicate"], list(scores), "metric", "value")
    ci = long.groupBy(by, "metric").agg(percentile_nearest(F.col("value"), qs[0]).alias("ci_low"), percentile_nearest(F.col("value"), qs[1]).alias("ci_high"))
    whole = kept.groupBy(F.col(by).cast("string").alias(by)).agg(*[F.sum(c).alias(c) for c in columns])
    return whole.select(by, *[c.alias(n) for n, c in scores.items()]).unpivot([by], list(scores), "metric", "point").join(ci, [by, "metric"])


def stream_draws(streams: DataFrame, replicates: int, *, salt: str) -> DataFrame:
    """stream, replicate, idx, times: for each stream (stream, size) as many draws as it has rows, by MD5 of `salt:stream:number`; made on the executors."""
    n = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    each = streams.select("stream", "size", n.alias("replicate")).where("size > 0").repartition("stream", "replicate")
    each = each.select("stream", "size", "replicate", F.explode(F.expr("sequence(0L, size - 1)")).alias("_n"))
    number = (F.col("replicate") * F.col("size") + F.col("_n")).cast("string")
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), "stream", F.lit(":"), number)), 1, 12), 16, 10).cast("bigint") % F.col("size")
    return each.select("stream", "replicate", drawn.cast("long").alias("idx")).groupBy("stream", "replicate", "idx").agg(F.count("*").alias("times"))


#: Rows of a stream whose patterns are one array, and draws that a task makes at a time.
PLACES, DRAWN = 1 << 16, 1 << 18


def bootstrap_by_patterns(
    rows: DataFrame, types: tuple[str, ...], *, replicates: int, salt: str, by: str = "model", order: str = "ordinal", decisions: tuple[str, ...] = DECISIONS, qs=(0.025, 0.975), prefixes: tuple[str, ...] = ("web", "gated")
) -> DataFrame:
    """What paired_bootstrap says for the draws of stream_draws(salt), where each (by, order) is one row or few.

    Rows with the same totals are one pattern, so a replicate is a count for each pattern. Draws are made in chunks and leave their task as packed 16-bit places,
    a binary for each replicate and block of PLACES rows; they meet the block's pattern numbers, and only counts leave that task.
    """
    columns, scores = list(paired_totals(types, decisions, prefixes)), scores_of_totals(types, decisions, prefixes)
    kept = written(rows.groupBy(F.col(by).cast("string").alias("_by"), order).agg(*[F.sum(c).alias(n) for n, c in paired_totals(types, decisions, prefixes).items()]), "totals")
    patterns = written(numbered(kept.groupBy(*columns).agg(F.count("*").alias("_rows")), columns, "_pattern").drop("_rows"), "patterns")  # a few hundred at most with 0/1 totals
    placed = numbered(kept.join(F.broadcast(patterns) if patterns.count() <= 100_000 else patterns, columns).select("_by", order, "_pattern"), ["_by", order], "_place")
    sizes = written(placed.groupBy("_by").agg(F.min("_place").alias("_start"), F.count("*").alias("_size")), "streams")  # a row a stream
    at = (F.col("_place") - F.col("_start")).cast("long")
    places = placed.join(sizes, "_by").select("_by", F.floor(at / PLACES).alias("_block"), (at % PLACES).cast("int").alias("_at"), F.col("_pattern").cast("int").alias("_pattern"))

    each = sizes.select("_by", "_size", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("_replicate"))
    each = each.select("*", F.explode(F.expr(f"sequence(0L, (_size - 1) div {DRAWN})")).alias("_chunk")).repartition("_by", "_replicate", "_chunk")
    packed = "_by string, _replicate int, _block long, _places binary"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import md5

        for batch in batches:
            for name, size, replicate, chunk in zip(*(batch.column(i).to_pylist() for i in range(4))):
                first, head = replicate * size + chunk * DRAWN, f"{salt}:{name}:".encode()
                raw = b"".join([md5(b"%b%d" % (head, i)).digest()[:6] for i in range(first, first + min(DRAWN, size - chunk * DRAWN))])
                eight = np.zeros((len(raw) // 6, 8), np.uint8)
                eight[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
                drawn = np.sort((eight.view(">u8").ravel().astype(np.int64)) % size)
                blocks, starts = np.unique(drawn // PLACES, return_index=True)
                parts = np.split((drawn % PLACES).astype("<u2"), starts[1:])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(blocks)), pa.array([replicate] * len(blocks), pa.int32()), pa.array(blocks, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["_by", "_replicate", "_block", "_places"])

    draws = each.select("_by", "_size", "_replicate", "_chunk").mapInArrow(draw, packed)
    names = ["_by", "_replicate", "_pattern", "_times"]

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        of = np.zeros(PLACES, np.int64)
        of[left["_at"].to_numpy()] = left["_pattern"].to_numpy()
        known, of = np.unique(of, return_inverse=True)
        out = []
        for replicate, places in zip(right["_replicate"].to_pylist(), right["_places"]):
            times = np.bincount(of[np.frombuffer(places.as_buffer(), "<u2")], minlength=len(known))
            hit = np.flatnonzero(times)
            out.append((np.full(len(hit), replicate, np.int32), known[hit].astype(np.int32), times[hit]))
        parts = [np.concatenate(x) for x in zip(*out)] if out else [np.array([], k) for k in (np.int32, np.int32, np.int64)]
        name = left["_by"][0].as_py() if left.num_rows else None
        return pa.table([pa.array([name] * len(parts[0]), pa.string()), *map(pa.array, parts)], names=names)

    counts = places.groupBy("_by", "_block").cogroup(draws.groupBy("_by", "_block")).applyInArrow(count, "_by string, _replicate int, _pattern int, _times long")
    counts = counts.groupBy("_by", "_replicate", "_pattern").agg(F.sum("_times").alias("_times"))
    reps = counts.join(patterns, "_pattern").groupBy(F.col("_by").alias(by), F.col("_replicate").alias("replicate")).agg(*[F.sum(F.col(c) * F.col("_times")).alias(c) for c in columns])
    reps = reps.select(by, "replicate", *[c.alias(n) for n, c in scores.items()])
    long = reps.unpivot([by, "replicate"], list(scores), "metric", "value")
    ci = long.groupBy(by, "metric").agg(percentile_nearest(F.col("value"), qs[0]).alias("ci_low"), percentile_nearest(F.col("value"), qs[1]).alias("ci_high"))
    whole = kept.groupBy(F.col("_by").alias(by)).agg(*[F.sum(c).alias(c) for c in columns])
    return whole.select(by, *[c.alias(n) for n, c in scores.items()]).unpivot([by], list(scores), "metric", "point").join(ci, [by, "metric"])


def model_seeds(rows: DataFrame, base: int, by: str = "model") -> dict[str, int]:
    """The base seed plus a model's place among the sorted names (a handful of models)."""
    return {r[0]: base + i for i, r in enumerate(rows.select(by).distinct().orderBy(by).collect())}


def metric_rows(wide: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Long rows with values printed to twelve decimals."""
    doubles = wide.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return doubles.unpivot(ids, metrics, "metric", "value").select(*ids, "metric", F.format_string("%.12f", "value").alias("value_text"))


def within_tolerance(a: DataFrame, b: DataFrame, on: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """One row: compared, within, exact, max_abs_delta, equal to twelve decimals."""
    both = a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on)
    gap = F.abs(F.col("_a") - F.col("_b"))
    return both.agg(F.count("*").alias("compared"), F.count_if(gap <= tolerance).alias("within"), F.count_if(gap == 0).alias("exact"), F.max(gap).alias("max_abs_delta"), F.count_if(F.format_string("%.12f", "_a") == F.format_string("%.12f", "_b")).alias("text_equal"))


def aligned(rows: DataFrame, *, by: str = "model", key: str = "ordinal", gold: tuple[str, ...] = ("task2_case_ref", "gold_decision", "gold_type")) -> DataFrame:
    """key, variants, models: keys whose gold differs between models, or that some model lacks or repeats."""
    per = rows.groupBy(key).agg(F.count_distinct(F.struct(*gold)).alias("variants"), F.count_distinct(by).alias("models"), F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(rows.agg(F.count_distinct(by).alias("_all")))).where("variants <> 1 OR models <> _all OR n <> _all").select(key, "variants", "models")
