"""Records of browser runs: expected responses, tolerated console and page errors, degraded assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps whose status is an expectation. Fixed values.
STATUS_OPS = ("goto", "expect_response", "fetch")
FONT_HOSTS = ("fonts.googleapis.com", "fonts.gstatic.com")
POLICY_MARKS = ("refused to", "has been blocked", "violates the following")


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def local_request(url: Column, origin: Column) -> Column:
    """Same scheme, host and port as the local runtime."""
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1) == origin


def response_matches(url: Column, status: Column, method: Column, path_is: Column, status_is: Column, method_is: Column) -> Column:
    """Each expectation holds where it is given."""
    given = lambda e, ok: e.isNull() | F.coalesce(ok, F.lit(False))
    return given(F.nullif(path_is, F.lit("")), url_path(url) == path_is) & given(status_is, status == status_is) & given(F.nullif(method_is, F.lit("")), method == method_is)


def expected_error_statuses(steps: Column) -> Column:
    """Statuses of 400 and more that steps (op, status) ask for."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(steps, lambda s: s["op"].isin(*STATUS_OPS) & (s["status"] >= 400)), lambda s: s["status"])))


def degraded_responses(responses: DataFrame, assets: DataFrame) -> DataFrame:
    """responses (site_id, url, status, resource_type) with degraded: the source had the same error for that asset (site_id, out_rel, status)."""
    a = assets.where("status >= 400 AND out_rel <> ''").select("site_id", F.regexp_replace("out_rel", "^/+", "").alias("_rel"), F.col("status").alias("status")).distinct().withColumn("_bad", F.lit(True))
    rel = F.regexp_replace(F.url_decode(url_path(F.col("url"))), "^/+", "")
    j = responses.withColumn("_rel", rel).join(a, ["site_id", "_rel", "status"], "left")
    return j.select(*responses.columns, (F.coalesce("_bad", F.lit(False)) & F.col("resource_type").isin("image", "font", "media")).alias("degraded"))


def unexpected_console_errors(messages: DataFrame, scenarios: DataFrame, responses: DataFrame) -> DataFrame:
    """messages (site_id, scenario_id, message) that nothing excuses.

    Excused are font hosts, content policies, statuses that the scenario (steps) expects, and statuses
    all of whose responses (site_id, scenario_id, status, resource_type, degraded) are fonts, or all degraded.
    """
    keys = ["site_id", "scenario_id"]
    low = F.lower("message")
    fonts, policy = F.lit(False), F.lit(False)
    for h in FONT_HOSTS:
        fonts = fonts | low.contains(h)
    for mark in POLICY_MARKS:
        policy = policy | low.contains(mark)
    m = messages.where(~(fonts | (low.contains("content security policy") & policy))).withColumn("status", F.nullif(F.regexp_extract("message", r"status of ([1-5][0-9]{2})", 1), F.lit("")).cast("int"))
    wanted = scenarios.select(*keys, expected_error_statuses(F.col("steps")).alias("_expected"))
    per = responses.groupBy(*keys, "status").agg(F.bool_and(F.col("resource_type") == "font").alias("_fonts"), F.bool_and("degraded").alias("_degraded"))
    j = m.join(wanted, keys, "left").join(per, [*keys, "status"], "left")
    excused = F.col("status").isNotNull() & (F.coalesce(F.array_contains("_expected", F.col("status")), F.lit(False)) | F.coalesce("_fonts", F.lit(False)) | F.coalesce("_degraded", F.lit(False)))
    return j.where(~excused).select(*messages.columns)


def unexpected_page_errors(messages: DataFrame, allowed: DataFrame) -> DataFrame:
    """messages (site_id, scenario_id, message) that the scenario doesn't allow (same columns)."""
    return messages.join(allowed, ["site_id", "scenario_id", "message"], "left_anti")


def response_events(responses: DataFrame, origin: Column) -> DataFrame:
    """status, method, resource_type and the path of local responses; others as [EXTERNAL]."""
    return responses.select("status", "method", "resource_type", F.when(local_request(F.col("url"), origin), url_path(F.col("url"))).otherwise(F.lit("[EXTERNAL]")).alias("path"))
