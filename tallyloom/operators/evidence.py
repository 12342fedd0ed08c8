"""Audit of evidence cases: provenance, dependency groups, inference, propositions, conclusion, stopping.

Cases are one nested row each. Arrays are exploded into keyed tables, every rule is a query of
violations, graphs are closures, and the outcome is an aggregate over the violations of a case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.text import aware_timestamp
from tallyloom.operators.graph import closure, cycle_nodes
from tallyloom.operators.rules import portable_path, union, verdicts
from tallyloom.sources.shared import written

STR, STRS = "string", "array<string>"
#: Arrays of a case: name, place in the case, label in codes, fields besides id. Fixed formats.
TABLES = {
    "agents": ("provenance.agents", "agent", {}),
    "activities": ("provenance.activities", "activity", {"agent_ids": STRS, "used_entity_ids": STRS, "generated_entity_ids": STRS, "started_at": STR, "ended_at": STR}),
    "entities": ("provenance.entities", "entity", {"path": STR, "sha256": STR, "source_stage": STR, "primary_source": "boolean"}),
    "derivations": ("provenance.derivations", "derivation", {"generated_entity_id": STR, "used_entity_ids": STRS, "activity_id": STR}),
    "search_scopes": ("search_scopes", "search_scope", {"coverage_status": STR, "planned_actions": "int", "completed_actions": "int", "completion_basis": STR, "evidence_ids": STRS}),
    "dependency_groups": ("dependency_groups", "dependency_group", {"root_entity_ids": STRS, "member_observation_ids": STRS}),
    "observations": ("observations", "observation", {"polarity": STR, "entity_id": STR, "activity_id": STR, "dependency_group_id": STR, "search_scope_ids": STRS}),
    "inferences": ("inferences", "inference", {"based_on_ids": STRS, "agent_id": STR}),
    "propositions": ("proposition_set.propositions", "proposition", {"role": STR, "risk_alignment": STR, "level": STR, "mutually_exclusive_with": STRS}),
    "predictions": ("predictions", "prediction", {"proposition_id": STR, "search_scope_ids": STRS}),
    "alternatives": ("alternative_explanations", "alternative", {"materiality": STR, "status": STR, "related_proposition_ids": STRS, "evidence_ids": STRS, "search_scope_ids": STRS}),
    "assessments": ("assessments", "assessment", {"subject_id": STR, "proposition_id": STR, "prediction_id": STR, "direction": STR, "strength": STR, "alternative_explanation_ids": STRS}),
}
GATES = ("capture_complete", "collection_authorized", "fidelity_verified", "integrity_verified", "interaction_trace_complete", "provenance_complete", "sanitization_recorded")


def _array(name: str) -> str:
    return f"array<struct<id:string{''.join(f',{k}:{v}' for k, v in TABLES[name][2].items())}>>"


SCHEMA = (
    "case_id string, scope struct<decision_level:string>, decision_policy struct<min_independent_support_groups:int>, "
    f"evidence_gate struct<{','.join(f'{g}:boolean' for g in GATES)}>, "
    f"provenance struct<{','.join(f'{n}:{_array(n)}' for n in ('agents', 'activities', 'entities', 'derivations'))}>, proposition_set struct<propositions:{_array('propositions')}>, "
    + ", ".join(f"{TABLES[n][0]} {_array(n)}" for n in ("search_scopes", "dependency_groups", "observations", "inferences", "predictions", "alternatives", "assessments"))
    + ", conclusion struct<outcome:string,selected_proposition_id:string,supporting_assessment_ids:array<string>,counter_assessment_ids:array<string>,unresolved_alternative_ids:array<string>,requires_human_review:boolean>"
    + ", stopping struct<decision:string,unmet_prediction_ids:array<string>,unresolved_alternative_ids:array<string>>"
)
OPEN_STATES = ("NOT_TESTED", "SUPPORTED", "UNRESOLVED")

#: Outcomes that claim a proposition, with its alignment, and those that a person must see.
SUPPORTED_OUTCOMES = {"SUPPORTED_HIGH_RISK": "HIGH_RISK", "BENIGN_SUPPORTED": "BENIGN"}
REVIEW_OUTCOMES = ("INSUFFICIENT_EVIDENCE", "CONFLICTING_EVIDENCE", "INVALID_EVIDENCE")


def _v(rows: DataFrame, code: Column, severity: str = "error") -> DataFrame:
    return rows.select("case_id", F.lit(severity).alias("severity"), code.alias("code"))


def _code(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


#: The id column of each keyed table.
ID = {
    "agents": "agent_id", "activities": "activity_id", "entities": "entity_id", "derivations": "derivation_id", "search_scopes": "search_scope_id", "dependency_groups": "dependency_group_id",
    "observations": "evidence_id", "inferences": "inference_id", "propositions": "proposition_id", "predictions": "prediction_id", "alternatives": "alternative_explanation_id", "assessments": "assessment_id",
}


class Case:
    """The keyed tables of a set of cases; of a repeated id the first row counts."""

    def __init__(self, cases: DataFrame):
        self.cases = cases
        self.t: dict[str, DataFrame] = {}
        self.repeats: list[DataFrame] = []
        for name, (place, label, _) in TABLES.items():
            rows = cases.select("case_id", F.posexplode(place).alias("_pos", "_r")).select("case_id", "_pos", "_r.*").where("id IS NOT NULL AND trim(id) <> ''")
            n = written(rows.withColumn("_n", F.row_number().over(Window.partitionBy("case_id", "id").orderBy("_pos"))), name)  # some dozen rules read it
            self.repeats.append(_v(n.where("_n > 1"), _code(label, "[", F.col("_pos"), "]:duplicate_id:", F.col("id"))))
            self.t[name] = n.where("_n = 1").drop("_n", "_pos").withColumnRenamed("id", ID[name])

    def ids(self, *names: str) -> DataFrame:
        out = None
        for n in names:
            one = self.t[n].select("case_id", F.col(ID[n]).alias("_id"))
            out = one if out is None else out.unionAll(one)
        return out.distinct()

    def unknown(self, name: str, column: str, known: tuple[str, ...], code: str, *, many: bool = True) -> DataFrame:
        """Ids of a column that no row of the known tables has. code: before the id, with {id} for the row's own."""
        key = ID[name]
        refs = self.t[name].select("case_id", F.col(key).alias("_row"), (F.explode(column) if many else F.col(column)).alias("_id")).where("_id IS NOT NULL")
        before, after = code.split("{id}")
        return _v(refs.join(self.ids(*known), ["case_id", "_id"], "left_anti"), _code(before, F.col("_row"), after, F.col("_id")))


def provenance(c: Case) -> list[DataFrame]:
    ref = ":unknown_reference:"
    act, ent, der, obs = c.t["activities"], c.t["entities"], c.t["derivations"], c.t["observations"]
    out = [
        c.unknown("activities", "agent_ids", ("agents",), "activity:{id}:agent" + ref),
        c.unknown("activities", "used_entity_ids", ("entities",), "activity:{id}:used_entity" + ref),
        c.unknown("activities", "generated_entity_ids", ("entities",), "activity:{id}:generated_entity" + ref),
        _v(act.where(F.arrays_overlap("used_entity_ids", "generated_entity_ids")), _code("activity:", F.col("activity_id"), ":entity_used_and_generated_in_place")),
        _v(act.where(aware_timestamp(F.col("ended_at")) < aware_timestamp(F.col("started_at"))), _code("activity:", F.col("activity_id"), ":ended_before_started")),
        _v(ent.where(~portable_path(F.col("path"))), _code("entity:", F.col("entity_id"), ":path_not_portable")),
        _v(ent.where("primary_source AND source_stage <> 'source_capture'"), _code("entity:", F.col("entity_id"), ":primary_source_stage_invalid")),
        c.unknown("derivations", "generated_entity_id", ("entities",), "derivation:{id}:unknown_generated_entity:", many=False),
        c.unknown("derivations", "used_entity_ids", ("entities",), "derivation:{id}:used_entity" + ref),
        c.unknown("derivations", "activity_id", ("activities",), "derivation:{id}:unknown_activity:", many=False),
        c.unknown("observations", "entity_id", ("entities",), "observation:{id}:unknown_entity:", many=False),
        c.unknown("observations", "activity_id", ("activities",), "observation:{id}:unknown_activity:", many=False),
        c.unknown("observations", "dependency_group_id", ("dependency_groups",), "observation:{id}:unknown_dependency_group:", many=False),
        c.unknown("observations", "search_scope_ids", ("search_scopes",), "observation:{id}:search_scope" + ref),
        c.unknown("dependency_groups", "root_entity_ids", ("entities",), "dependency_group:{id}:root_entity" + ref),
        c.unknown("dependency_groups", "member_observation_ids", ("observations",), "dependency_group:{id}:member_observation" + ref),
        c.unknown("search_scopes", "evidence_ids", ("observations",), "search_scope:{id}:evidence" + ref),
    ]
    made = act.select("case_id", "activity_id", F.explode("generated_entity_ids").alias("entity_id")).groupBy("case_id", "entity_id").agg(F.array_sort(F.collect_set("activity_id")).alias("_by"))
    origin = ent.select("case_id", "entity_id").join(made, ["case_id", "entity_id"], "left")
    out.append(_v(origin.where("_by IS NULL"), _code("entity:", F.col("entity_id"), ":no_generating_activity")))
    out.append(_v(origin.where(F.size("_by") > 1), _code("entity:", F.col("entity_id"), ":multiple_generating_activities:", F.array_join("_by", ","))))
    io = act.select("case_id", "activity_id", F.col("used_entity_ids").alias("_used"), F.col("generated_entity_ids").alias("_made"))
    with_io = der.join(io, ["case_id", "activity_id"])
    out.append(_v(with_io.where(~F.array_contains("_made", F.col("generated_entity_id"))), _code("derivation:", F.col("derivation_id"), ":generated_entity_not_activity_output")))
    out.append(_v(with_io.where(F.size(F.array_except("used_entity_ids", "_used")) > 0), _code("derivation:", F.col("derivation_id"), ":used_entity_not_activity_input")))
    touched = obs.join(io, ["case_id", "activity_id"]).where(~F.array_contains(F.concat("_used", "_made"), F.col("entity_id")))
    out.append(_v(touched, _code("observation:", F.col("evidence_id"), ":entity_not_touched_by_activity")))
    scope = c.t["search_scopes"]
    out.append(_v(scope.where("coverage_status = 'COMPLETE' AND completed_actions < planned_actions"), _code("search_scope:", F.col("search_scope_id"), ":complete_but_actions_missing")))
    out.append(_v(scope.where("coverage_status = 'COMPLETE' AND coalesce(trim(completion_basis), '') = ''"), _code("search_scope:", F.col("search_scope_id"), ":completion_basis_missing")))
    edges = der.select("case_id", F.col("generated_entity_id").alias("src"), F.explode("used_entity_ids").alias("dst"))
    pairs = written(closure(edges), "derivations")
    out.append(_v(cycle_nodes(pairs), _code("provenance_derivation_cycle:", F.col("node"))))
    group = c.t["dependency_groups"]
    members = group.select("case_id", "dependency_group_id", F.explode("member_observation_ids").alias("evidence_id"))
    had = members.groupBy("case_id", "evidence_id").agg(F.array_sort(F.collect_set("dependency_group_id")).alias("_in"))
    placed = obs.join(had, ["case_id", "evidence_id"], "left").withColumn("_in", F.coalesce("_in", F.array().cast("array<string>")))
    out.append(_v(placed.where(~F.col("_in").eqNullSafe(F.array("dependency_group_id"))), _code("observation:", F.col("evidence_id"), ":dependency_membership_mismatch:", F.array_join("_in", ","))))
    roots = group.select("case_id", "dependency_group_id", F.explode("root_entity_ids").alias("_root"))
    want = obs.join(roots, ["case_id", "dependency_group_id"])
    hit = want.join(pairs.select("case_id", F.col("src").alias("entity_id"), F.col("dst").alias("_root"), F.lit(True).alias("_hit")), ["case_id", "entity_id", "_root"], "left")
    lost = hit.groupBy("case_id", "evidence_id").agg(F.bool_or(F.coalesce("_hit", F.col("entity_id") == F.col("_root"))).alias("_ok")).where("NOT _ok")
    out.append(_v(lost, _code("observation:", F.col("evidence_id"), ":entity_not_derived_from_group_root")))
    negative = obs.where("polarity = 'ABSENCE'").select("case_id", "evidence_id", F.explode_outer("search_scope_ids").alias("search_scope_id")).join(scope.select("case_id", "search_scope_id", (F.col("coverage_status") == "COMPLETE").alias("complete")), ["case_id", "search_scope_id"], "left")
    partial = negative.groupBy("case_id", "evidence_id").agg(F.bool_and(F.coalesce("complete", F.lit(False))).alias("_ok")).where("NOT _ok")
    out.append(_v(partial, _code("negative_observation:", F.col("evidence_id"), ":incomplete_search_scope"), "warning"))
    return out


def reasoning(c: Case) -> tuple[list[DataFrame], DataFrame]:
    """Rules of inferences, propositions, predictions, alternatives and assessments; and (case, subject, observation) roots."""
    ref = ":unknown_reference:"
    inf, prop = c.t["inferences"], c.t["propositions"]
    edges = inf.select("case_id", F.col("inference_id").alias("src"), F.explode("based_on_ids").alias("dst"))
    pairs = written(closure(edges), "inferences")
    target, other = prop.where("role = 'TARGET'"), prop.where("role = 'ALTERNATIVE'")
    counts = c.cases.select("case_id").join(prop.groupBy("case_id").agg(F.count_if(F.col("role") == "TARGET").alias("_t"), F.count_if(F.col("role") == "ALTERNATIVE").alias("_a"), F.array_sort(F.collect_set("risk_alignment")).alias("_al")), "case_id", "left")
    excl = prop.select("case_id", F.col("proposition_id").alias("a"), F.explode("mutually_exclusive_with").alias("b"))
    mirror = excl.select("case_id", F.col("b").alias("a"), F.col("a").alias("b"))
    need = target.select("case_id", F.col("proposition_id").alias("a")).join(other.select("case_id", F.col("proposition_id").alias("b")), "case_id")
    known = c.ids("propositions").select("case_id", F.col("_id").alias("b"))
    level = prop.join(c.cases.select("case_id", F.col("scope.decision_level").alias("decision_level")), "case_id").where(~F.col("level").eqNullSafe(F.col("decision_level")))
    pred = c.t["predictions"]
    lacking = prop.join(pred.select("case_id", "proposition_id").distinct(), ["case_id", "proposition_id"], "left_anti")
    alt, ass = c.t["alternatives"], c.t["assessments"]
    of_pred = ass.join(pred.select("case_id", "prediction_id", F.col("proposition_id").alias("_p")), ["case_id", "prediction_id"]).where(~F.col("_p").eqNullSafe(F.col("proposition_id")))
    out = [
        c.unknown("inferences", "based_on_ids", ("observations", "inferences"), "inference:{id}:based_on" + ref),
        c.unknown("inferences", "agent_id", ("agents",), "inference:{id}:unknown_agent:", many=False),
        _v(cycle_nodes(pairs), _code("inference_cycle:", F.col("node"))),
        _v(counts.where("coalesce(_t, 0) <> 1"), _code("propositions:target_count:", F.coalesce("_t", F.lit(0)))),
        _v(counts.where("coalesce(_a, 0) = 0"), _code("propositions:alternative_missing")),
        _v(counts.where(F.size(F.array_intersect("_al", F.array(F.lit("HIGH_RISK"), F.lit("BENIGN")))) < 2), _code("propositions:high_risk_and_benign_pair_required")),
        _v(level, _code("proposition:", F.col("proposition_id"), ":level_mismatch:", F.col("level"), "!=", F.col("decision_level"))),
        c.unknown("propositions", "mutually_exclusive_with", ("propositions",), "proposition:{id}:exclusive" + ref),
        _v(excl.where("a = b"), _code("proposition:", F.col("a"), ":self_exclusive")),
        _v(excl.where("a <> b").join(known, ["case_id", "b"], "left_semi").join(mirror, ["case_id", "a", "b"], "left_anti"), _code("proposition:", F.col("a"), ":asymmetric_exclusivity:", F.col("b"))),
        _v(need.join(excl, ["case_id", "a", "b"], "left_anti"), _code("proposition_pair:not_mutually_exclusive:", F.col("a"), ":", F.col("b"))),
        c.unknown("predictions", "proposition_id", ("propositions",), "prediction:{id}:unknown_proposition:", many=False),
        c.unknown("predictions", "search_scope_ids", ("search_scopes",), "prediction:{id}:search_scope" + ref),
        _v(lacking, _code("proposition:", F.col("proposition_id"), ":prediction_missing")),
        c.unknown("alternatives", "related_proposition_ids", ("propositions",), "alternative:{id}:proposition" + ref),
        c.unknown("alternatives", "evidence_ids", ("observations",), "alternative:{id}:evidence" + ref),
        c.unknown("alternatives", "search_scope_ids", ("search_scopes",), "alternative:{id}:search_scope" + ref),
        _v(alt.where("status = 'REFUTED'").where(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0), _code("alternative:", F.col("alternative_explanation_id"), ":refuted_without_evidence"), "blocker"),
        c.unknown("assessments", "subject_id", ("observations", "inferences"), "assessment:{id}:unknown_subject:", many=False),
        c.unknown("assessments", "proposition_id", ("propositions",), "assessment:{id}:unknown_proposition:", many=False),
        c.unknown("assessments", "prediction_id", ("predictions",), "assessment:{id}:unknown_prediction:", many=False),
        _v(of_pred, _code("assessment:", F.col("assessment_id"), ":prediction_proposition_mismatch")),
        c.unknown("assessments", "alternative_explanation_ids", ("alternatives",), "assessment:{id}:alternative" + ref),
        _v(ass.where("direction = 'NEUTRAL' AND strength <> 'LOW'"), _code("assessment:", F.col("assessment_id"), ":neutral_strength_not_low"), "warning"),
    ]
    obs = c.ids("observations")
    own = obs.select("case_id", F.col("_id").alias("subject"), F.col("_id").alias("evidence_id"))
    under = pairs.select("case_id", F.col("src").alias("subject"), F.col("dst").alias("_id")).join(obs, ["case_id", "_id"]).select("case_id", "subject", F.col("_id").alias("evidence_id"))
    return out, own.unionAll(under).distinct()


def conclusion(c: Case, roots: DataFrame) -> list[DataFrame]:
    none = F.array().cast("array<string>")
    base = c.cases.select(
        "case_id", F.col("conclusion.outcome").alias("outcome"), F.col("conclusion.selected_proposition_id").alias("selected"), F.coalesce("conclusion.supporting_assessment_ids", none).alias("support"),
        F.coalesce("conclusion.counter_assessment_ids", none).alias("counter"), F.coalesce("conclusion.unresolved_alternative_ids", none).alias("listed"), F.coalesce("conclusion.requires_human_review", F.lit(False)).alias("review"),
        F.col("stopping.decision").alias("stop"), F.coalesce("stopping.unmet_prediction_ids", none).alias("unmet"), F.coalesce("stopping.unresolved_alternative_ids", none).alias("stop_listed"),
        F.coalesce("decision_policy.min_independent_support_groups", F.lit(2)).alias("min_groups"),
    )
    expected = None
    for o, a in SUPPORTED_OUTCOMES.items():
        expected = F.when(F.col("outcome") == o, a) if expected is None else expected.when(F.col("outcome") == o, a)
    base = base.withColumn("expected", expected).withColumn("supported", F.col("expected").isNotNull())
    ass, prop = c.t["assessments"], c.t["propositions"]
    a_ids = c.ids("assessments").withColumnRenamed("_id", "assessment_id")
    cited = base.select("case_id", "selected", "supported", F.explode("support").alias("assessment_id"))
    against = base.select("case_id", "selected", "supported", F.explode("counter").alias("assessment_id"))
    picked = base.join(prop.select("case_id", F.col("proposition_id").alias("selected"), "risk_alignment"), ["case_id", "selected"], "left")
    sup, con = cited.join(ass, ["case_id", "assessment_id"]), against.join(ass, ["case_id", "assessment_id"])
    yes = F.col("supported")
    all_counter = ass.join(base.select("case_id", F.col("selected").alias("proposition_id"), "counter", "supported"), ["case_id", "proposition_id"]).where(yes & (F.col("direction") == "REFUTES") & ~F.array_contains("counter", F.col("assessment_id")))
    omitted = all_counter.groupBy("case_id").agg(F.array_sort(F.collect_set("assessment_id")).alias("_ids"))
    group_of = c.t["observations"].select("case_id", "evidence_id", "dependency_group_id", "polarity", "search_scope_ids")
    behind = sup.join(roots.withColumnRenamed("subject", "subject_id"), ["case_id", "subject_id"]).join(group_of, ["case_id", "evidence_id"])
    groups = base.where(yes).join(behind.groupBy("case_id").agg(F.count_distinct("dependency_group_id").alias("_g")), "case_id", "left").withColumn("_g", F.coalesce("_g", F.lit(0)))
    scope = c.t["search_scopes"].select("case_id", "search_scope_id", (F.col("coverage_status") == "COMPLETE").alias("complete"))
    negative = behind.where("polarity = 'ABSENCE' AND supported").select("case_id", "evidence_id", F.explode_outer("search_scope_ids").alias("search_scope_id")).join(scope, ["case_id", "search_scope_id"], "left")
    weak = negative.groupBy("case_id", "evidence_id").agg(F.bool_and(F.coalesce("complete", F.lit(False))).alias("_ok")).where("NOT _ok").groupBy("case_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("_ids"))
    open_alt = c.t["alternatives"].where((F.col("materiality") == "MATERIAL") & F.col("status").isin(*OPEN_STATES)).groupBy("case_id").agg(F.array_sort(F.collect_set("alternative_explanation_id")).alias("_open"))
    state = base.join(open_alt, "case_id", "left").withColumn("_open", F.coalesce("_open", none))
    judged = prop.join(ass.select("case_id", "proposition_id").distinct(), ["case_id", "proposition_id"], "left_anti").groupBy("case_id").agg(F.array_sort(F.collect_set("proposition_id")).alias("_ids"))
    rival = ass.where("direction = 'SUPPORTS' AND strength IN ('MODERATE', 'HIGH')").join(base.where(yes).select("case_id", "selected", "min_groups"), "case_id").where("NOT proposition_id <=> selected")
    rival = rival.join(roots.withColumnRenamed("subject", "subject_id"), ["case_id", "subject_id"]).join(group_of, ["case_id", "evidence_id"]).groupBy("case_id", "proposition_id", "min_groups").agg(F.count_distinct("dependency_group_id").alias("_g"))
    rivals = rival.where("_g >= min_groups").groupBy("case_id").agg(F.array_sort(F.collect_set("proposition_id")).alias("_ids"))
    listed = lambda rows, col, known, code: _v(rows.select("case_id", F.explode(col).alias("_id")).join(c.ids(known), ["case_id", "_id"], "left_anti"), _code(code, F.col("_id")))
    b = "blocker"
    return [
        _v(cited.join(a_ids, ["case_id", "assessment_id"], "left_anti"), _code("conclusion:supporting_assessment:unknown_reference:", F.col("assessment_id"))),
        _v(against.join(a_ids, ["case_id", "assessment_id"], "left_anti"), _code("conclusion:counter_assessment:unknown_reference:", F.col("assessment_id"))),
        _v(picked.where(yes & F.col("risk_alignment").isNull()), _code("conclusion:selected_proposition_missing"), b),
        _v(picked.where(yes & (F.col("risk_alignment") != F.col("expected"))), _code("conclusion:selected_proposition_alignment_mismatch:", F.col("expected")), b),
        _v(base.where(yes & (F.size("support") == 0)), _code("conclusion:supporting_assessments_missing"), b),
        _v(base.where(~yes & F.col("selected").isNotNull()), _code("conclusion:selected_proposition_for_non_supported_outcome"), b),
        _v(sup.where(yes & ~F.col("proposition_id").eqNullSafe(F.col("selected"))), _code("conclusion:support_assessment_wrong_proposition:", F.col("assessment_id")), b),
        _v(sup.where(yes & (F.col("direction") != "SUPPORTS")), _code("conclusion:support_assessment_wrong_direction:", F.col("assessment_id")), b),
        _v(con.where(yes & ~F.col("proposition_id").eqNullSafe(F.col("selected"))), _code("conclusion:counter_assessment_wrong_proposition:", F.col("assessment_id")), b),
        _v(con.where(yes & (F.col("direction") != "REFUTES")), _code("conclusion:counter_assessment_wrong_direction:", F.col("assessment_id")), b),
        _v(omitted, _code("conclusion:counterevidence_omitted:", F.array_join("_ids", ",")), b),
        _v(groups.where("_g < min_groups"), _code("conclusion:independent_support_groups=", F.col("_g"), "<", F.col("min_groups")), b),
        _v(weak, _code("conclusion:negative_evidence_without_complete_scope:", F.array_join("_ids", ",")), b),
        _v(state.where(F.array_sort(F.array_distinct("listed")) != F.col("_open")), _code("conclusion:unresolved_alternative_set_mismatch:expected=", F.array_join("_open", ",")), b),
        _v(state.where(yes & (F.size("_open") > 0)), _code("conclusion:material_alternatives_unresolved:", F.array_join("_open", ",")), b),
        _v(judged.join(base.where(yes).select("case_id"), "case_id"), _code("conclusion:proposition_coverage_incomplete:", F.array_join("_ids", ",")), b),
        _v(rivals, _code("conclusion:competing_proposition_strongly_supported:", F.array_join("_ids", ",")), b),
        listed(base, "unmet", "predictions", "stopping:unmet_prediction:unknown_reference:"),
        listed(base, "stop_listed", "alternatives", "stopping:unresolved_alternative:unknown_reference:"),
        _v(state.where(F.array_sort(F.array_distinct("stop_listed")) != F.col("_open")), _code("stopping:unresolved_alternative_set_mismatch:expected=", F.array_join("_open", ",")), b),
        _v(base.where(yes & ~F.col("stop").eqNullSafe(F.lit("STOP_SUFFICIENT"))), _code("stopping:supported_outcome_requires_stop_sufficient"), b),
        _v(base.where(~yes & (F.col("stop") == "STOP_SUFFICIENT")), _code("stopping:stop_sufficient_without_supported_outcome"), b),
        _v(base.where(F.col("outcome").isin(*REVIEW_OUTCOMES) & ~F.col("review")), _code("conclusion:review_outcome_requires_human_review"), b),
    ]


def audit(cases: DataFrame, artifacts: DataFrame | None = None) -> DataFrame:
    """case_id, errors, blockers, warnings, outcome. artifacts: case_id, path, sha256 of the files that exist."""
    c = Case(cases)
    gates = cases.select("case_id", F.explode(F.array(*[F.struct(F.lit(g).alias("_k"), F.coalesce(f"evidence_gate.{g}", F.lit(False)).alias("_ok")) for g in GATES])).alias("g")).select("case_id", "g.*").where("NOT _ok")
    parts = [*c.repeats, _v(gates, _code("evidence_gate_failed:", F.col("_k"))), *provenance(c)]
    more, roots = reasoning(c)
    parts += [*more, *conclusion(c, written(roots, "roots"))]
    if artifacts is not None:
        e = c.t["entities"].join(artifacts.select("case_id", "path", F.lower("sha256").alias("_real")), ["case_id", "path"], "left")
        parts.append(_v(e.where(F.col("_real").isNull()), _code("entity:", F.col("entity_id"), ":artifact_missing")))
        parts.append(_v(e.where(F.col("_real") != F.lower("sha256")), _code("entity:", F.col("entity_id"), ":artifact_sha256_mismatch")))
    batches = [written(union(parts[i : i + 12]), "violations") for i in range(0, len(parts), 12)]  # plans of a dozen rules each
    found = union(batches)
    submitted = cases.select("case_id", F.col("conclusion.outcome").alias("submitted"))
    got = verdicts(submitted, found, "case_id", competing="conclusion:competing_proposition", submitted=F.coalesce("submitted", F.lit("INVALID_EVIDENCE")))
    return got.drop("submitted")
