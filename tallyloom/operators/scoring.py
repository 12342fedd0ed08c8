"""Scoring of nested predictions against gold records, as joins and aggregates.

gold: sample_id, site_id, platform, intent, entry_value, obfuscation_types array<string>,
messages array<struct<message_id, text>> (the target messages, see target_messages).
predictions: sample_id, input_view, platform, intent, abstain, messages array<struct<message_id, text>>,
candidates array<struct<rank, value, confidence>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.text import entry_parts, folded, is_reserved, mixed_distances, mixed_token_count, normal_text

COMPONENTS = ("scheme", "host", "port", "path", "query", "fragment")
MESSAGES = "array<struct<message_id:string,text:string>>"
CANDIDATES = "array<struct<rank:int,value:string,confidence:double>>"


def target_messages(gold: Column, session: Column) -> Column:
    """Gold messages whose id the session marks with transform = true; of a repeated id the last counts."""
    wanted = F.transform(F.filter(session, lambda m: m["transform"]), lambda m: m["message_id"])
    kept = F.filter(gold, lambda m: F.array_contains(wanted, m["message_id"]))
    ids = F.transform(kept, lambda m: m["message_id"])
    return F.filter(kept, lambda m, i: ~F.array_contains(F.slice(ids, i + 2, F.size(kept) + 1), m["message_id"]))


def _none_where(wrong: Column, message: str, key: Column) -> Column:
    """A condition for where(): it holds for every row, and fails the query at a wrong one. Spark may prune a column that nothing reads, a filter never."""
    return F.when(wrong, F.raise_error(F.concat(F.lit(message), key.cast("string"))).cast("boolean")).otherwise(True)


def with_default_predictions(gold: DataFrame, predictions: DataFrame, *, platform_of_task: bool = False, unknown: bool = False, allow_missing: bool = True) -> DataFrame:
    """Gold left-joined with predictions; a missing one abstains with empty answers and stays in the denominator.

    A sample_id with several predictions always fails the query: it would count more than once in every rate. So does a prediction of an
    id that gold doesn't have, unless unknown ones are let pass (they count nowhere), and a missing one, unless those are allowed.
    """
    times = F.count("*").over(Window.partitionBy("sample_id"))  # dealt as the join needs it, so no shuffle of its own
    p = predictions.withColumn("_times", times).where(_none_where(F.col("_times") > 1, "duplicate prediction: ", F.col("sample_id"))).select(
        "sample_id", F.col("input_view").alias("p_input_view"), F.col("platform").alias("p_platform"), F.col("intent").alias("p_intent"), F.col("abstain").alias("p_abstain"),
        F.col("messages").cast(MESSAGES).alias("p_messages"), F.col("candidates").cast(CANDIDATES).alias("p_candidates"), F.lit(True).alias("_has"),
    )
    missing = F.col("_has").isNull()
    default_platform = F.col("platform") if platform_of_task else F.lit("unknown")
    joined = gold.withColumn("_gold", F.lit(True)).join(p.hint("merge"), "sample_id", "left" if unknown else "full_outer")  # both sides dealt by sample: answers grow with the data, so they are never broadcast
    if not unknown:
        joined = joined.where(_none_where(F.col("_gold").isNull(), "predictions contain unknown sample_id: ", F.col("sample_id")))
    if not allow_missing:
        joined = joined.where(_none_where(F.col("_has").isNull(), "missing prediction: ", F.col("sample_id")))
    return joined.select(
        *gold.columns,
        missing.alias("prediction_missing"),
        F.when(missing, default_platform).otherwise(F.col("p_platform")).alias("p_platform"),
        F.when(missing, "").otherwise(F.col("p_intent")).alias("p_intent"),
        F.when(missing, True).otherwise(F.col("p_abstain")).alias("p_abstain"),
        F.coalesce("p_messages", F.array().cast(MESSAGES)).alias("p_messages"),
        F.coalesce("p_candidates", F.array().cast(CANDIDATES)).alias("p_candidates"),
    )


def id_differences(gold: DataFrame, predictions: DataFrame, key: str = "sample_id") -> DataFrame:
    """kind (unknown, missing, duplicate), n, first_ids: the first ten in order."""
    ids_g, ids_p = gold.select(F.col(key).alias("id")).distinct(), predictions.select(F.col(key).alias("id"))
    twice = ids_p.groupBy("id").count().where("count > 1").select("id")
    kinds = (("unknown", ids_p.distinct().join(ids_g, "id", "left_anti")), ("missing", ids_g.join(ids_p.distinct(), "id", "left_anti")), ("duplicate", twice))
    out = None
    for kind, rows in kinds:
        one = rows.select(F.lit(kind).alias("kind"), "id")
        out = one if out is None else out.unionAll(one)
    first = F.row_number().over(Window.partitionBy("kind").orderBy("id"))
    ten = out.withColumn("_r", first).where("_r <= 10").groupBy("kind").agg(F.array_sort(F.collect_list("id")).alias("first_ids"))  # tasks pass on ten ids a kind at most
    return out.groupBy("kind").agg(F.count("*").alias("n")).join(ten, "kind")


def score_messages(pairs: DataFrame) -> DataFrame:
    """sample_id, message_id, exact, edits and reference lengths; a message without an answer scores against ""."""
    ids = lambda c: F.transform(c, lambda m: m["message_id"])
    in_order = (ids("messages") == ids("p_messages")) & (F.size(F.array_distinct(ids("messages"))) == F.size("messages"))
    both = lambda g, text: F.struct(g["message_id"].alias("message_id"), g["text"].alias("gold"), text.alias("answer"))
    by_place = F.zip_with("messages", "p_messages", lambda g, a: both(g, a["text"]))
    by_id = F.transform("messages", lambda g: both(g, F.try_element_at(F.filter("p_messages", lambda m: m["message_id"] == g["message_id"]), F.lit(-1))["text"]))
    paired = pairs.select("sample_id", F.explode(F.when(in_order, by_place).otherwise(by_id)).alias("m"))  # before the explode, so that no row carries the other answers
    other = F.when(~F.col("m.gold").eqNullSafe(F.coalesce("m.answer", F.lit(""))), F.coalesce("m.answer", F.lit("")))  # null where the answer is the gold text itself
    texts = paired.select("sample_id", F.col("m.message_id").alias("message_id"), normal_text(F.col("m.gold")).alias("gold"), normal_text(other).alias("other"))
    texts = texts.select("sample_id", "message_id", "gold", F.coalesce("other", "gold").alias("answer"))
    exact = F.col("gold") == F.col("answer")
    apart = ~exact & (F.col("gold") != "") & (F.col("answer") != "")  # else all of the longer one is edited; only texts that are apart leave the JVM
    compared = texts.withColumns({"exact": exact, "far": mixed_distances(F.when(apart, F.col("gold")), F.when(apart, F.col("answer"))), "reference_mixed_tokens": mixed_token_count(F.col("gold"))})
    edits = lambda far, size, reference: F.coalesce(far, F.when(exact, 0).when(F.col("answer") == "", reference).otherwise(size(F.col("answer"))))
    return compared.select(
        "sample_id", "message_id", "exact", edits(F.col("far.characters"), F.length, F.length("gold")).alias("char_edits"), F.length("gold").alias("reference_characters"),
        edits(F.col("far.tokens"), mixed_token_count, F.col("reference_mixed_tokens")).alias("mixed_token_edits"), "reference_mixed_tokens",
    )


def score_candidates(pairs: DataFrame, top_k: int = 5) -> DataFrame:
    """sample_id and candidate rows of the k lowest ranks: canonical_exact, component matches, reserved_or_masked."""
    if not 1 <= top_k <= 10:
        raise ValueError("top_k lies in 1..10")
    ranked = pairs.select("sample_id", entry_parts("entry_value").alias("gold"), F.slice(F.array_sort("p_candidates", lambda a, b: (a["rank"] - b["rank"]).cast("int")), 1, top_k).alias("c"))
    one = ranked.select("sample_id", "gold", F.posexplode("c").alias("pos", "c"))
    one = one.select("sample_id", "gold", "pos", "c", entry_parts(F.col("c.value")).alias("e"), is_reserved(F.col("c.value")).alias("reserved_or_masked"))
    matches = F.struct(*[(F.col(f"e.{x}") == F.col(f"gold.{x}")).alias(x) for x in COMPONENTS])
    right = sum(((F.col(f"e.{x}") == F.col(f"gold.{x}")).cast("int") for x in COMPONENTS), F.lit(0))
    return one.select(
        "sample_id", "pos", F.col("c.rank").alias("rank"), F.col("c.confidence").alias("confidence"), (F.col("e.canonical") == F.col("gold.canonical")).alias("canonical_exact"),
        matches.alias("component_matches"), (right / len(COMPONENTS)).alias("component_accuracy"), "reserved_or_masked",
    )


def score_cases(gold: DataFrame, predictions: DataFrame, *, top_k: int = 5, platform_of_task: bool = False, unknown: bool = False, allow_missing: bool = True) -> DataFrame:
    """One row per gold case. Without target messages all of them count as exact. top1 is the lowest rank present."""
    pairs = with_default_predictions(gold, predictions, platform_of_task=platform_of_task, unknown=unknown, allow_missing=allow_missing)
    messages = score_messages(pairs).groupBy("sample_id").agg(
        *[F.sum(c).alias(c) for c in ("char_edits", "reference_characters", "mixed_token_edits", "reference_mixed_tokens")],
        F.count("*").alias("target_message_count"), F.count_if("exact").alias("exact_message_count"),
    )
    entries = score_candidates(pairs, top_k).groupBy("sample_id").agg(
        F.bool_or(F.col("canonical_exact") & (F.col("pos") == 0)).alias("top1"), F.bool_or("canonical_exact").alias("topk"), F.count_if(~F.col("reserved_or_masked")).alias("live"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    base = pairs.join(messages, "sample_id", "left").join(entries, "sample_id", "left")
    flat = base.select(
        "sample_id", "site_id", "platform", "obfuscation_types", F.col("p_abstain").alias("abstain"),
        *[zero(c) for c in ("char_edits", "reference_characters", "mixed_token_edits", "reference_mixed_tokens", "target_message_count", "exact_message_count")],
        (folded("p_intent") == folded("intent")).alias("intent_exact"), (F.col("p_platform") == F.col("platform")).alias("platform_exact"),
        F.coalesce("top1", F.lit(False)).alias("entry_top1_exact"), F.coalesce("topk", F.lit(False)).alias("entry_topk_exact"), zero("live").alias("predicted_live_entry_count"),
    )
    every = F.col("exact_message_count") == F.col("target_message_count")
    rest = every & F.col("intent_exact") & F.col("platform_exact")
    return flat.withColumns({
        "all_target_messages_exact": every, "local_resolution_success_at_k": F.col("entry_topk_exact"),
        "full_reconstruction_success": rest & F.col("entry_topk_exact"), "full_reconstruction_success_top1": rest & F.col("entry_top1_exact"),
    })


#: name of the rate, case column
RATES = {
    "message_exact_rate": "all_target_messages_exact", "intent_accuracy": "intent_exact", "platform_accuracy": "platform_exact", "entry_top1_exact_rate": "entry_top1_exact",
    "entry_topk_recall": "entry_topk_exact", "local_resolution_success_rate_at_k": "local_resolution_success_at_k", "abstain_rate": "abstain",
    "full_reconstruction_success_rate": "full_reconstruction_success", "full_reconstruction_success_rate_top1": "full_reconstruction_success_top1",
}


def ratio(top: Column, bottom: Column) -> Column:
    """0.0 where the denominator is 0 or there are no rows."""
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def micro_averages(weight: Column | None = None) -> list[Column]:
    """Aggregates over case rows; with a weight each case counts so many times."""
    w = F.lit(1) if weight is None else weight
    total = lambda c: F.sum(F.col(c) * w)
    return [
        F.coalesce(F.sum(w), F.lit(0)).cast("bigint").alias("case_count"), F.coalesce(total("target_message_count"), F.lit(0)).cast("bigint").alias("target_message_count"),
        ratio(total("char_edits"), total("reference_characters")).alias("character_error_rate"), ratio(total("mixed_token_edits"), total("reference_mixed_tokens")).alias("mixed_token_error_rate"),
        ratio(total("exact_message_count"), total("target_message_count")).alias("message_exact_rate_per_message"),
        *[ratio(F.sum(F.col(c).cast("int") * w), F.sum(w)).alias(name) for name, c in RATES.items()],
        F.coalesce(total("predicted_live_entry_count"), F.lit(0)).cast("bigint").alias("predicted_live_entry_count"),
    ]


def report(cases: DataFrame) -> DataFrame:
    """scope (overall, platform, obfuscation_type), value, metrics; a case counts once for each of its distinct types."""
    none = F.lit(None).cast("string")
    scope = lambda name, value: F.struct(F.lit(name).alias("scope"), value.cast("string").alias("value"))
    types = F.transform(F.array_distinct("obfuscation_types"), lambda t: scope("obfuscation_type", t))
    scopes = F.concat(F.array(scope("overall", none), scope("platform", F.col("platform"))), F.coalesce(types, F.array().cast("array<struct<scope:string,value:string>>")))
    summed = ["target_message_count", "exact_message_count", "char_edits", "reference_characters", "mixed_token_edits", "reference_mixed_tokens", "predicted_live_entry_count", *dict.fromkeys(RATES.values())]
    counted = cases.select(F.explode(scopes).alias("_s"), F.lit(1).alias("_w"), *summed).select("_s.*", "_w", *summed)  # the cases are made once, and added up before they leave their task
    nothing = cases.sparkSession.range(1).select(F.lit("overall").alias("scope"), none.alias("value"), F.lit(0).alias("_w"))  # so that there is a report of no cases too
    return counted.unionByName(nothing, allowMissingColumns=True).groupBy("scope", "value").agg(*micro_averages(F.col("_w")))


def confusable_legend(texts: DataFrame, mapping: DataFrame, *, key: str, text: str) -> DataFrame:
    """key, position, character, targets: distinct characters in order of first occurrence that the map (character, target) holds."""
    chars = texts.select(key, F.posexplode(F.array_distinct(F.split(text, ""))).alias("position", "character"))
    targets = mapping.groupBy("character").agg(F.array_sort(F.collect_set("target")).alias("targets"))
    return chars.join(targets, "character").select(key, "position", "character", "targets")


def strict_top1_gate(candidates: Column, expected: Column) -> Column:
    """Rank 1 equals the expected three-label .test name exactly; odd ranks or none fail; an odd expectation raises."""
    label = r"[a-z0-9]([a-z0-9-]*[a-z0-9])?"
    fine = F.coalesce(expected.rlike(rf"^{label}\.{label}\.test$") & ~expected.contains("\n"), F.lit(False))
    ranks = F.transform(candidates, lambda c: c["rank"])
    good = (F.size(candidates) > 0) & F.forall(candidates, lambda c: F.coalesce((c["rank"] >= 1) & c["value"].isNotNull(), F.lit(False))) & (F.size(F.array_distinct(ranks)) == F.size(ranks))
    top = F.get(F.filter(candidates, lambda c: c["rank"] == 1), 0)["value"]
    return F.when(~fine, F.raise_error(F.lit("expected entry isn't a canonical three-label .test name")).cast("boolean")).otherwise(F.coalesce(good & (top == expected), F.lit(False)))


BOTTOM = "__BOTTOM__"


def apply_gate(decision: Column, kind: Column, gate: Column) -> tuple[Column, Column]:
    """The web prediction where the gate passes, bottom twice where not; a null gate raises."""
    null = F.raise_error(F.lit("the gate must be true or false"))
    return tuple(F.when(gate.isNull(), null).when(gate, c).otherwise(F.lit(BOTTOM)) for c in (decision, kind))
