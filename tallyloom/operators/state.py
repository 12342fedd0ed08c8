"""Attempt histories, resume, ledgers and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_observed(attempts: DataFrame, *, by: str, order: Column, observed: Column) -> DataFrame:
    """by, outcome (the first observed row), failures_before, ignored_later, attempts; outcome is null if none was observed."""
    rest = [c for c in attempts.columns if c != by]
    keyed = attempts.select(by, F.struct(*rest).alias("_row"), order.alias("_at"), observed.alias("_seen"))
    first = keyed.groupBy(by).agg(F.min(F.when(F.col("_seen"), F.col("_at"))).alias("_first"), F.min_by("_row", F.when(F.col("_seen"), F.col("_at"))).alias("outcome"))
    counts = keyed.join(first, by).groupBy(by).agg(
        F.count_if(F.col("_first").isNull() | (F.col("_at") < F.col("_first"))).alias("failures_before"), F.count_if(F.col("_at") > F.col("_first")).alias("ignored_later"), F.count("*").alias("attempts")
    )
    return first.select(by, "outcome").join(counts, by)


def frozen_outcomes(attempts: DataFrame, tasks: DataFrame) -> DataFrame:
    """sample_id, final_status and the accounting of attempts (sample_id, attempt, has_audit, output_observed, status, has_prediction).

    Attempts without an audit or an observed output don't decide; a PASS without its prediction file
    is a system failure and the walk goes on; no deciding attempt is SYSTEM_FAILURE_EXHAUSTED.
    """
    decides = F.col("has_audit") & F.col("output_observed") & ~((F.col("status") == "PASS") & ~F.col("has_prediction"))
    seen = first_observed(attempts, by="sample_id", order=F.col("attempt"), observed=decides)
    raw = attempts.groupBy("sample_id").agg(F.bool_or("has_prediction").alias("_raw"))
    joined = tasks.select("sample_id").join(seen, "sample_id", "left").join(raw, "sample_id", "left")
    status = F.when(F.col("outcome").isNull(), "SYSTEM_FAILURE_EXHAUSTED").when(F.col("outcome.status") == "PASS", "PASS").otherwise("MODEL_FAILURE")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("sample_id", status.alias("final_status"), F.col("outcome.attempt").alias("deciding_attempt"), zero("failures_before"), zero("ignored_later"), (F.coalesce("_raw", F.lit(False)) & (status != "PASS")).alias("masked_success"))


def accounting(outcomes: DataFrame, expected: int) -> DataFrame:
    """One row of counts; raises unless valid and failed make up the expected number."""
    n = outcomes.agg(F.count_if(F.col("final_status") == "PASS").alias("valid"), F.count_if(F.col("final_status") != "PASS").alias("failed"), F.count_if("masked_success").alias("masked_successes"), F.sum("failures_before").alias("failures_before"))
    fine = F.when(F.col("valid") + F.col("failed") != expected, F.raise_error(F.lit("outcomes don't add up"))).otherwise(F.lit(True))
    return n.where(fine)


def latest_state(events: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, created_at (the first time), updated_at and the fields of the last event."""
    rest = [c for c in events.columns if c not in (*keys, at)]
    return events.groupBy(*keys).agg(F.min(at).alias("created_at"), F.max(at).alias("updated_at"), F.max_by(F.struct(*rest), at).alias("_s")).select(*keys, "created_at", "updated_at", "_s.*")


def rolled_up(status: DataFrame, left: DataFrame, right: DataFrame, *, a: str, b: str, state: str, complete: str, partial: str) -> DataFrame:
    """a, pairs, pending, overall: the state of each a of left over all b of right; a pair without a status is PENDING.

    The pairs are counted, not made: those without a status are what is left of the number of b.
    """
    known = status.join(left.select(a).distinct(), a, "left_semi").join(right.select(b).distinct(), b, "left_semi")
    is_, n = (lambda *states: F.count_if(F.coalesce(F.col(state), F.lit("PENDING")).isin(*states))), F.col("_n")
    counts = known.groupBy(a).agg(F.count("*").alias("_rows"), F.count_distinct(b).alias("_b"), is_("PENDING").alias("_open"), is_(complete).alias("_done"), is_(complete, partial).alias("_half"))
    each = left.select(a).distinct().join(counts, a, "left").fillna(0, ["_rows", "_b", "_open", "_done", "_half"]).crossJoin(F.broadcast(right.agg(F.count_distinct(b).alias("_n"))))  # one row
    pairs = F.col("_rows") + n - F.col("_b")
    overall = F.when(F.col("_done") == pairs, "COMPLETE").when(F.col("_half") == pairs, "COMPLETE_WITH_PARTIAL").otherwise("RUNNING")
    return each.where("_n > 0").select(a, pairs.alias("pairs"), (F.col("_open") + n - F.col("_b")).alias("pending"), overall.alias("overall"))


def unprocessed(tasks: DataFrame, done: DataFrame, key: str, *, fingerprint: str | None = None) -> DataFrame:
    """Tasks without a result; results of another fingerprint raise."""
    if fingerprint is not None:
        done = done.where(F.when(F.col("fingerprint") != fingerprint, F.raise_error(F.lit("results of another configuration"))).otherwise(F.lit(True)))
    return tasks.join(done.select(key).distinct(), key, "left_anti")


def retry_counts(attempts: DataFrame, task: str, status: str) -> DataFrame:
    """One row: tasks, retries (attempts beyond the first of each), failures."""
    per = attempts.groupBy(task).agg(F.count("*").alias("_n"), F.count_if(F.col(status) != "PASS").alias("_f"))
    return per.agg(F.count("*").alias("tasks"), F.sum(F.greatest(F.col("_n") - 1, F.lit(0))).alias("retries"), F.sum("_f").alias("failures"))


def usage_sums(calls: DataFrame, by: list[str], usage: str) -> DataFrame:
    """by..., key, total over a map of counters with open keys."""
    return calls.select(*by, F.explode(usage).alias("key", "_v")).where(F.col("_v").isNotNull()).groupBy(*by, "key").agg(F.sum("_v").alias("total"))


def qualified_models(results: DataFrame) -> DataFrame:
    """model, response_model: models with a PASS row and exactly one identity (the requested one where none is given)."""
    ok = results.where("status = 'PASS'").groupBy("model").agg(F.collect_set(F.coalesce("response_model", "model")).alias("_ids"))
    return ok.where(F.size("_ids") == 1).select("model", F.get("_ids", 0).alias("response_model"))


def retry_delay(attempt: Column, schedule: list[float], retry_after: Column) -> Column:
    """The schedule's place for the attempt (the last one beyond it), or longer if the server says so."""
    steps = F.array(*[F.lit(float(x)) for x in schedule])
    return F.greatest(F.get(steps, F.least(attempt, F.lit(len(schedule) - 1))), F.coalesce(retry_after, F.lit(0.0)))


#: HTTP statuses worth another try.
RETRYABLE = (408, 425, 429, 500, 502, 503, 504)


def error_kind(status: Column, body_is_json: Column, content: Column) -> Column:
    """RETRY, TERMINAL or OK for one call."""
    return F.when(status.isNull() | status.isin(*RETRYABLE), "RETRY").when(status >= 400, "TERMINAL").when(~body_is_json | content.isNull() | (content == ""), "RETRY").otherwise("OK")


def gaps(rows: DataFrame, by: str, position: str) -> DataFrame:
    """by, n, contiguous: whether positions are 0..n-1."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), (F.min(position) == 0).alias("_z"), F.max(position).alias("_m"), F.count_distinct(position).alias("_d")).select(by, "n", (F.col("_z") & (F.col("_m") == F.col("n") - 1) & (F.col("_d") == F.col("n"))).alias("contiguous"))


def changes(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows with the value before them in their group."""
    return rows.withColumn("before", F.lag(value).over(Window.partitionBy(by).orderBy(order)))


def call_rollup(calls: DataFrame, by: str, call: str) -> DataFrame:
    """by, successful, failed and all calls, attempts, resolved_models (sorted), token_usage (sums of whole numbers by name) of calls, each a VARIANT.

    Counts are aggregated before any shuffle; a run's models and usage names are few.
    """
    c = F.col(call)
    attempts = F.coalesce(F.try_variant_get(c, "$.attempts", "array<variant>"), F.array().cast("array<variant>"))
    objects = F.filter(attempts, lambda a: F.try_variant_get(a, "$", "map<string,variant>").isNotNull())
    name = lambda v: F.nullif(F.try_variant_get(v, "$.response_model", "string"), F.lit(""))
    each = calls.select(by, (F.coalesce(F.try_variant_get(c, "$.status", "string"), F.lit("")) == "PASS").alias("_ok"), objects.alias("_a"), F.array_compact(F.concat(F.array(name(c)), F.transform(objects, name))).alias("_m"))
    counts = each.groupBy(by).agg(F.count_if("_ok").alias("successful_model_call_count"), F.count_if(~F.col("_ok")).alias("failed_model_call_count"), F.count("*").alias("model_call_audit_count"), F.sum(F.size("_a")).alias("provider_attempt_count"))
    models = each.select(by, F.explode("_m").alias("_m")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("_m")).alias("resolved_models"))
    usage = each.select(by, F.explode("_a").alias("_a")).select(by, F.explode(F.map_entries(F.try_variant_get("_a", "$.usage", "map<string,variant>"))).alias("_u"))
    whole = usage.where(F.schema_of_variant("_u.value") == "BIGINT").groupBy(by, F.col("_u.key").alias("_k")).agg(F.sum(F.try_variant_get("_u.value", "$", "long")).alias("_v"))
    used = whole.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias("token_usage"))
    out = counts.join(models, by, "left").join(used, by, "left")
    return out.withColumn("resolved_models", F.coalesce("resolved_models", F.array().cast("array<string>"))).withColumn("token_usage", F.coalesce("token_usage", F.create_map().cast("map<string,bigint>")))
