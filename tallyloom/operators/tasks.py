"""Model-visible tasks, responses of models and the rules that hold them to each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.safety import safety_findings
from tallyloom.functions.text import MASKED_ENTRY, ids_digest, is_reserved
from tallyloom.operators.rules import Rule, unknown_keys

PLACEHOLDER = "{{ENTRY}}"
#: Labels of intents and the phrases that predictions use. Fixed values.
INTENTS = {
    "OPEN_SITE": "open site", "ADD_ACCOUNT": "add account", "SEARCH_QUERY": "search query", "ENTER_CODE": "enter code", "CONTACT_SERVICE": "contact service", "UNKNOWN": "unknown",
}
RESPONSE = (
    "reconstructed_messages array<struct<message_id:string,text:string>>, intent_label string, platform string, entry_candidates array<struct<rank:int,value:string,confidence:double>>, "
    "abstain boolean, uncertainties array<string>"
)
RESPONSE_KEYS = ("reconstructed_messages", "intent_label", "platform", "entry_candidates", "abstain", "uncertainties")


def task_rows(records: DataFrame, *, context: dict[str, Column], constants: dict[str, str], version: str) -> DataFrame:
    """The projection that a model may see: sample_id, messages with content for text, chosen context, constants and a digest."""
    body = records.select(
        "sample_id", F.transform("messages", lambda m: F.struct(m["message_id"].alias("message_id"), m["text"].alias("content"))).alias("messages"),
        *[c.alias(k) for k, c in context.items()], *[F.lit(v).alias(k) for k, v in constants.items()], F.lit(version).alias("schema_version"),
    )
    return body.withColumn("task_sha256", F.sha2(F.to_json(F.struct(*sorted(body.columns)), {"ignoreNullFields": "false"}), 256))


def prediction_rows(responses: DataFrame, *, model: str, run_id: str) -> DataFrame:
    """Predictions from typed responses: texts trimmed, confidences to six places, intent labels as phrases."""
    phrase = F.element_at(F.create_map(*[F.lit(x) for kv in INTENTS.items() for x in kv]), F.col("r.intent_label"))
    return responses.select(
        "sample_id", F.lit(model).alias("model_id"), F.lit(run_id).alias("run_id"),
        F.transform("r.reconstructed_messages", lambda m: F.struct(m["message_id"].alias("message_id"), F.trim(m["text"]).alias("text"))).alias("messages"),
        phrase.alias("intent"), F.lower(F.col("r.platform")).alias("platform"),
        F.transform("r.entry_candidates", lambda c: F.struct(c["rank"].alias("rank"), c["value"].alias("value"), F.round(c["confidence"], 6).alias("confidence"))).alias("candidates"),
        F.col("r.abstain").alias("abstain"),
    )


def reranked(responses: DataFrame, limit: int = 5) -> DataFrame:
    """The lenient reading: candidates ranked by their place, the first five, confidence 0.5 where none is given."""
    first = F.slice(F.coalesce("r.entry_candidates", F.array().cast("array<struct<rank:int,value:string,confidence:double>>")), 1, limit)
    return responses.withColumn("candidates", F.transform(first, lambda c, i: F.struct((i + 1).alias("rank"), c["value"].alias("value"), F.coalesce(c["confidence"], F.lit(0.5)).alias("confidence"))))


def _fine_items(field: str, keys: tuple[str, ...]) -> Column:
    """For each item of a list of the response whether it is an object of these keys (sorted) alone."""
    names = lambda x: F.array_sort(F.map_keys(F.try_variant_get(x, "$", "map<string,variant>")))
    return F.transform(F.try_variant_get(F.try_parse_json("raw"), f"$.{field}", "array<variant>"), lambda x: F.coalesce(names(x) == F.array(*[F.lit(k) for k in keys]), F.lit(False)))


def response_codes(tasks: DataFrame, responses: DataFrame) -> DataFrame:
    """sample_id, codes: the strict rules of responses (sample_id, raw JSON text) against tasks (sample_id, platform, messages).

    Candidates that are reserved may stand in a text; everything else that the safety scanner finds may not.
    """
    j = tasks.select("sample_id", F.col("platform").alias("task_platform"), F.transform("messages", lambda m: m["message_id"]).alias("ids")).join(responses.select("sample_id", "raw"), "sample_id")
    j = j.withColumn("keys", F.json_object_keys("raw")).withColumn("r", F.from_json("raw", RESPONSE))
    odd = {}
    for name, field, keys in (("RECONSTRUCTED_MESSAGE_SCHEMA_INVALID", "reconstructed_messages", ("message_id", "text")), ("ENTRY_CANDIDATE_SCHEMA_INVALID", "entry_candidates", ("confidence", "rank", "value"))):
        j = j.withColumn(f"_{field}", _fine_items(field, keys))
        odd[name] = F.exists(f"_{field}", lambda ok: ~ok)
        kept = F.transform(F.filter(F.arrays_zip(F.col(f"r.{field}").alias("x"), F.col(f"_{field}").alias("ok")), lambda z: F.coalesce(z["ok"], F.lit(True))), lambda z: z["x"])
        j = j.withColumn("r", F.col("r").withField(field, kept))  # items of other keys are told, and left out of the other rules
    cand = j.select("sample_id", F.explode("r.entry_candidates").alias("c")).select("sample_id", "c.value", is_reserved(F.coalesce("c.value", F.lit(""))).alias("ok"))
    cand = cand.groupBy("sample_id").agg(F.collect_set(F.when(F.col("ok"), F.col("value"))).alias("safe"), F.bool_and("ok").alias("all_safe"))
    text = j.select("sample_id", F.explode("r.reconstructed_messages").alias("m")).join(cand, "sample_id", "left")
    masked = F.reduce(F.coalesce("safe", F.array().cast("array<string>")), F.coalesce("m.text", F.lit("")), lambda t, s: F.replace(t, s, F.lit("[MASKED_SITE]")))
    unsafe = text.select("sample_id", safety_findings(masked).alias("f")).groupBy("sample_id").agg(F.bool_or(F.size("f") > 0).alias("unsafe"))
    full = j.join(cand, "sample_id", "left").join(unsafe, "sample_id", "left")
    c, m = F.col("r.entry_candidates"), F.col("r.reconstructed_messages")
    ranks = F.transform(c, lambda x: x["rank"])
    falling = F.forall(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.coalesce(F.get(c, i)["confidence"] <= F.get(c, i - 1)["confidence"], F.lit(True)))
    tests = {
        "RECONSTRUCTED_MESSAGES_INVALID": m.isNull(), "RECONSTRUCTED_MESSAGE_IDS_INVALID": m.isNotNull() & ~F.transform(m, lambda x: x["message_id"]).eqNullSafe(F.col("ids")),
        "RECONSTRUCTED_MESSAGE_TEXT_INVALID": F.exists(m, lambda x: x["text"].isNull()), "RECONSTRUCTED_MESSAGE_SAFETY_INVALID": F.col("unsafe"),
        "INTENT_LABEL_INVALID": ~F.coalesce(F.col("r.intent_label").isin(*INTENTS), F.lit(False)), "PLATFORM_INVALID": ~F.col("r.platform").eqNullSafe(F.col("task_platform")),
        "ENTRY_CANDIDATES_INVALID": c.isNull() | (F.size("_entry_candidates") > 5), "ENTRY_CANDIDATE_RANK_INVALID": F.exists(c, lambda x: x["rank"].isNull()),
        "ENTRY_CANDIDATE_CONFIDENCE_INVALID": F.exists(c, lambda x: ~F.coalesce((x["confidence"] >= 0) & (x["confidence"] <= 1), F.lit(False))), "ENTRY_CANDIDATE_SAFETY_INVALID": ~F.col("all_safe"),
        "ENTRY_CANDIDATE_RANKS_NOT_CONTIGUOUS": F.exists(F.transform(ranks, lambda x, i: ~x.eqNullSafe(i + 1)), lambda x: x) | odd["ENTRY_CANDIDATE_SCHEMA_INVALID"], "ENTRY_CANDIDATE_CONFIDENCE_NOT_MONOTONIC": ~falling,
        "ABSTAIN_INVALID": F.col("r.abstain").isNull(), "NON_ABSTAIN_REQUIRES_CANDIDATE": ~F.col("r.abstain") & (F.coalesce(F.size("_entry_candidates"), F.lit(0)) <= 0),
        "UNCERTAINTIES_INVALID": F.col("r.uncertainties").isNull() | F.exists("r.uncertainties", lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""),
    } | odd
    keys_bad = ~F.coalesce(F.array_sort("keys").eqNullSafe(F.array_sort(F.array(*[F.lit(k) for k in RESPONSE_KEYS]))), F.lit(False))
    listed = F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()])))
    return full.select("sample_id", F.when(keys_bad, F.array(F.lit("SEMANTIC_KEYS_INVALID"))).otherwise(listed).alias("codes"))


JUDGMENT_KEYS = ("intent", "evidence", "risk_reason", "answer", "evidence_sufficiency", "counterevidence")
JUDGMENT = "intent string, evidence array<struct<evidence_id:string,observation:string>>, risk_reason string, answer string, evidence_sufficiency string, counterevidence array<string>"


def judgment_rules(raw: str, known: str, visible: str | None = None) -> list[Rule]:
    """Rules over a JSON column, an array column of known evidence ids and one of those that the model could see."""
    j = F.from_json(F.col(raw), JUDGMENT)
    ids = F.transform(j["evidence"], lambda e: e["evidence_id"])
    keys = F.array_sort(F.json_object_keys(raw)).eqNullSafe(F.array_sort(F.array(*[F.lit(k) for k in JUDGMENT_KEYS])))
    rules = [
        Rule("JUDGMENT_KEYS_INVALID", ~keys), Rule("JUDGMENT_ANSWER_INVALID", ~F.coalesce(j["answer"].isin("YES", "NO", "INSUFFICIENT"), F.lit(False))),
        Rule("JUDGMENT_SUFFICIENCY_INVALID", ~F.coalesce(j["evidence_sufficiency"].isin("SUFFICIENT", "INSUFFICIENT"), F.lit(False))),
        Rule("JUDGMENT_REASON_INVALID", F.trim(F.coalesce(j["risk_reason"], F.lit(""))) == ""), Rule("JUDGMENT_EVIDENCE_INVALID", j["evidence"].isNull()), Rule("JUDGMENT_EVIDENCE_EMPTY", F.size(j["evidence"]) == 0),
        Rule("JUDGMENT_UNKNOWN_EVIDENCE_ID", F.size(F.array_except(ids, F.col(known))) > 0), Rule("JUDGMENT_EMPTY_OBSERVATION", F.exists(j["evidence"], lambda e: F.trim(F.coalesce(e["observation"], F.lit(""))) == "")),
        Rule("JUDGMENT_COUNTEREVIDENCE_INVALID", j["counterevidence"].isNull()),
    ]
    if visible is not None:
        rules.append(Rule("JUDGMENT_CITATION_NOT_MODEL_VISIBLE", F.size(F.array_except(F.array_intersect(ids, F.col(known)), F.col(visible))) > 0))
    return rules


def action_rules(raw: str, expected: str) -> list[Rule]:
    """Rules of an action response in JSON against the expected action id of a column."""
    a = F.from_json(F.col(raw), "action_id string, reason string, visual_observations array<string>")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return [
        Rule("ACTION_KEYS_INVALID", F.size(unknown_keys(F.col(raw), ["action_id", "reason", "visual_observations"])) > 0), Rule("ACTION_ID_TYPE_INVALID", blank(a["action_id"])), Rule("ACTION_REASON_INVALID", blank(a["reason"])),
        Rule("ACTION_VISUAL_OBSERVATIONS_INVALID", a["visual_observations"].isNull() | F.exists(a["visual_observations"], lambda x: x.isNull())), Rule("ACTION_ID_INVALID", ~a["action_id"].eqNullSafe(F.col(expected))),
    ]


def generation_rules(model: str, options: str) -> list[Rule]:
    """Rules of request options (map column) by the model's prefix: what must be frozen and what must be left out."""
    m, o = F.col(model), F.col(options)
    has = lambda k: F.coalesce(F.map_contains_key(o, k), F.lit(False))
    reasoning = m.startswith("gpt-5.")
    return [
        Rule("TEMPERATURE_MUST_BE_OMITTED", reasoning & has("temperature")), Rule("REASONING_EFFORT_MUST_BE_OMITTED", ~reasoning & has("reasoning_effort")),
        Rule("TEMPERATURE_NOT_FROZEN", ~reasoning & ~F.element_at(o, "temperature").eqNullSafe(F.lit("0"))), Rule("ENABLE_THINKING_NOT_FALSE", m.startswith("qwen") & ~F.element_at(o, "enable_thinking").eqNullSafe(F.lit("false"))),
        Rule("KIMI_THINKING_NOT_DISABLED", m.startswith("kimi-") & ~F.element_at(o, "thinking").eqNullSafe(F.lit("disabled"))),
        Rule("THINKING_OVERRIDE_UNEXPECTED", ~m.startswith("qwen") & ~m.startswith("kimi-") & (has("enable_thinking") | has("thinking"))),
    ]


def source_rules() -> list[Rule]:
    """Rules of source sessions (messages array<struct<message_id, text, transform>>)."""
    ids = F.transform("messages", lambda m: m["message_id"])
    marks = lambda t: F.size(F.split(F.coalesce(t, F.lit("")), r"\Q" + PLACEHOLDER + r"\E")) - 1
    return [
        Rule("messages:duplicate_id", F.size(F.array_distinct(ids)) < F.size(ids)), Rule("messages:none_transformed", ~F.exists("messages", lambda m: F.coalesce(m["transform"], F.lit(False)))),
        Rule("messages:placeholder_count", F.exists("messages", lambda m: m["transform"] & (marks(m["text"]) != 1))), Rule("messages:stray_placeholder", F.exists("messages", lambda m: ~m["transform"] & (marks(m["text"]) > 0))),
    ]


def recipe_rules() -> list[Rule]:
    """Rules of a recipe set (recipes array<struct<variant_index:int, primary:boolean, ...>>)."""
    index = F.array_sort(F.transform("recipes", lambda r: r["variant_index"]))
    return [
        Rule("recipes:indices_not_contiguous", F.exists(F.transform(index, lambda x, i: ~x.eqNullSafe(i)), lambda x: x)), Rule("recipes:primary_count", F.size(F.filter("recipes", lambda r: F.coalesce(r["primary"], F.lit(False)))) != 1),
    ]


def observed(response: dict[str, Column]) -> Column:
    """Whether a model's output was seen: any of the fields isn't null."""
    return F.coalesce(*[c.cast("string") for c in response.values()]).isNotNull()


def smoke_entry(value: Column) -> Column:
    """Quotes stripped; https entries as scheme, lower-case host and path; a trailing slash only falls after /start/."""
    text = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"^[`\"']+", ""), r"[`\"']+$", "")
    host = F.lower(F.regexp_extract(text, r"(?i)^https://(?:[^@/?#]*@)?([^:/?#]+)", 1))
    path = F.regexp_extract(text, r"(?i)^https://[^/?#]*([^?#]*)", 1)
    whole = F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path))
    return F.when(host == "", text).otherwise(F.when(whole.endswith("/start/"), F.regexp_replace(whole, "/+$", "")).otherwise(whole))


def json_path(parts: Column) -> Column:
    """$.a[0] from an array of keys and digits."""
    return F.concat(F.lit("$"), F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit("."), p))), ""))


def at_path(raw: Column, dotted: str) -> Column:
    """The value at a dotted path of a JSON text, as text; a missing one raises."""
    path = "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))
    got = F.get_json_object(raw, path)
    return F.when(got.isNull(), F.raise_error(F.lit(f"JSON path {dotted!r} is missing"))).otherwise(got)


def by_ordinal(rows: DataFrame, places: DataFrame, *, key: str = "case_ref", ordinal: str = "ordinal") -> DataFrame:
    """Rows with their ordinal; raises unless keys and ordinals are one to one."""
    n = places.agg((F.count("*") == F.count_distinct(key)).alias("_k"), (F.count("*") == F.count_distinct(ordinal)).alias("_o"))
    fine = F.when(F.col("_k") & F.col("_o"), F.lit(True)).otherwise(F.raise_error(F.lit("keys and ordinals aren't one to one")).cast("boolean"))
    return rows.join(places.select(key, ordinal), key).crossJoin(F.broadcast(n.select(fine.alias("_fine")))).where("_fine").drop("_fine")  # n is one row


def published(rows: DataFrame, names: DataFrame, *, model: str = "model", display: str = "display_model") -> DataFrame:
    """Rows of models with one display name that is published."""
    one = rows.groupBy(model).agg(F.count_distinct(display).alias("_n"), F.min(display).alias("_name")).where("_n = 1")
    kept = one.join(names.select(F.col(names.columns[0]).alias("_name")).distinct(), "_name").select(model)
    return rows.join(kept, model, "left_semi")


def resolved_inputs(sites: DataFrame, tasks: DataFrame, cases: DataFrame) -> DataFrame:
    """site_id, variant, sample_id, stratum: cases (site_id, variant, stratum) through sites (site_id, sample_ids) to tasks; one case a stratum."""
    once = cases.withColumn("_n", F.count("*").over(Window.partitionBy("stratum")))
    once = once.where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("several cases in "), F.col("stratum")))).otherwise(F.lit(True)))
    bound = once.join(sites, "site_id").withColumn("sample_id", F.get("sample_ids", F.col("variant")))
    return bound.join(tasks.select("sample_id"), "sample_id").select("site_id", "variant", "sample_id", "stratum")


def scope_state(site_ids: Column, declared: Column, digest: Column) -> Column:
    """OK or what is wrong with a frozen list of sites."""
    ids = F.array_sort(F.transform(site_ids, F.trim))
    return (
        F.when(F.coalesce(F.size(site_ids), F.lit(0)) <= 0, "empty").when(F.exists(ids, lambda x: F.coalesce(x == "", F.lit(True))), "blank id").when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicates")
        .when(~declared.eqNullSafe(F.size(ids)), "count").when(~digest.eqNullSafe(ids_digest(ids)), "digest").otherwise("OK")
    )


def aggregate_only(report: DataFrame, case_columns: tuple[str, ...] = ("sample_id", "site_id", "messages", "candidates")) -> DataFrame:
    """The report without columns that tell single cases."""
    return report.drop(*case_columns)


def release_state(contract: DataFrame, actual: DataFrame) -> DataFrame:
    """name, problem of a release: contract (name, sha256, records) against actual (name, sha256, records)."""
    a = actual.select("name", F.col("sha256").alias("_h"), F.col("records").alias("_n"))
    problem = F.when(F.col("_h").isNull(), "missing").when(F.col("_h") != F.col("sha256"), "digest").when(~F.col("_n").eqNullSafe(F.col("records")), "count")
    return contract.join(a, "name", "left").select("name", problem.alias("problem")).where("problem IS NOT NULL")


MASKED_ONLY = rf"^{MASKED_ENTRY}$"
