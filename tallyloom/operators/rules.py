"""Rules as predicates, violations as rows, verdicts as aggregates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tallyloom.sources.shared import written


@dataclass(frozen=True)
class Rule:
    """code and the condition of rows that break it; severity is error, blocker or warning."""

    code: Column | str
    broken: Column
    severity: str = "error"

    def row(self) -> Column:
        code = F.lit(self.code) if isinstance(self.code, str) else self.code
        return F.when(F.coalesce(self.broken, F.lit(False)), F.struct(F.lit(self.severity).alias("severity"), code.alias("code")))


def violations(rows: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """key, severity, code: one scan for all rules of a table."""
    listed = F.filter(F.array(*[r.row() for r in rules]), lambda v: v.isNotNull())
    return rows.select(key, F.explode(listed).alias("v")).select(key, "v.severity", "v.code")


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdicts(keys: DataFrame, found: DataFrame, key: str, *, competing: str = "conclusion:competing", submitted: Column | None = None) -> DataFrame:
    """key, errors, blockers, warnings (sorted sets), outcome: errors first, then competing support, then any blocker."""
    some = lambda s: F.array_sort(F.collect_set(F.when(F.col("severity") == s, F.col("code"))))
    per = found.groupBy(key).agg(some("error").alias("errors"), some("blocker").alias("blockers"), some("warning").alias("warnings"))
    empty = F.array().cast("array<string>")
    j = keys.join(per, key, "left")
    for c in ("errors", "blockers", "warnings"):
        j = j.withColumn(c, F.coalesce(c, empty))
    outcome = (
        F.when(F.size("errors") > 0, "INVALID_EVIDENCE").when(F.exists("blockers", lambda b: b.startswith(competing)), "CONFLICTING_EVIDENCE").when(F.size("blockers") > 0, "INSUFFICIENT_EVIDENCE").otherwise(F.lit("VALID") if submitted is None else submitted)
    )
    return j.withColumn("outcome", outcome)


def check_counts(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """code, checked, passed for each rule with a fixed code."""
    stats = F.array(*[F.struct(F.lit(str(i)).alias("rule"), F.coalesce(~r.broken, F.lit(True)).alias("ok")) for i, r in enumerate(rules)])
    names = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(str(i)), F.lit(r.code if isinstance(r.code, str) else f"rule_{i}"))])
    e = rows.select(F.explode(stats).alias("s")).groupBy("s.rule").agg(F.count("*").alias("checked"), F.count_if("s.ok").alias("passed"))
    return e.select(F.element_at(names, F.col("rule")).alias("code"), "checked", "passed")


def schema_rules(schema: dict, column: str, *, path: str = "$") -> list[Rule]:
    """Rules of a JSON Schema (required, enum, const, pattern, range, lengths, items, unique items) over a typed column."""
    rules: list[Rule] = []
    c = F.col(column)
    for name, sub in schema.get("properties", {}).items():
        field, at = f"{column}.{name}", f"{path}.{name}"
        f = F.col(field)
        if name in schema.get("required", []):
            rules.append(Rule(f"schema:{at}:required", c.isNotNull() & f.isNull()))
        if "enum" in sub:
            rules.append(Rule(f"schema:{at}:enum", ~f.isin(*[x for x in sub["enum"] if x is not None])))
        if "const" in sub:
            rules.append(Rule(f"schema:{at}:const", f != F.lit(sub["const"])))
        if "pattern" in sub:
            rules.append(Rule(f"schema:{at}:pattern", ~f.rlike(sub["pattern"])))
        for key, test in (("minimum", lambda v: f < v), ("maximum", lambda v: f > v), ("minLength", lambda v: F.length(f) < v), ("maxLength", lambda v: F.length(f) > v), ("minItems", lambda v: F.size(f) < v), ("maxItems", lambda v: F.size(f) > v)):
            if key in sub:
                rules.append(Rule(f"schema:{at}:{key}", f.isNotNull() & test(sub[key])))
        if sub.get("uniqueItems"):
            rules.append(Rule(f"schema:{at}:uniqueItems", F.size(F.array_distinct(f)) < F.size(f)))
        if sub.get("type") == "object":
            rules += schema_rules(sub, field, path=at)
        for inner, part in sub.get("items", {}).get("properties", {}).items():
            rules += _item_rules(f, f"schema:{at}[].{inner}", inner, part, required=inner in sub["items"].get("required", []))
    return rules


def _item_rules(array: Column, code: str, inner: str, part: dict, *, required: bool) -> list[Rule]:
    out = []
    if required:
        out.append(Rule(f"{code}:required", F.exists(array, lambda x: x[inner].isNull())))
    if "enum" in part:
        out.append(Rule(f"{code}:enum", F.exists(array, lambda x: ~x[inner].isin(*part["enum"]))))
    if "pattern" in part:
        out.append(Rule(f"{code}:pattern", F.exists(array, lambda x: ~x[inner].rlike(part["pattern"]))))
    return out


def unknown_keys(raw: Column, allowed: list[str]) -> Column:
    """Keys of a JSON object in text that a closed schema doesn't name, in order."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in allowed])))


def forbidden_names(schema: StructType, denied: set[str], *, path: str = "$") -> list[str]:
    """Paths of denied field names anywhere in a typed table, compared in lower case."""
    out = []
    for f in schema.fields:
        at = f"{path}.{f.name}"
        if f.name.lower() in denied:
            out.append(at)
        kind: DataType = f.dataType
        while isinstance(kind, ArrayType):
            kind, at = kind.elementType, at + "[]"
        if isinstance(kind, StructType):
            out += forbidden_names(kind, denied, path=at)
    return out


def forbidden_json_keys(raw: Column, denied: list[str]) -> Column:
    """Denied keys anywhere in a JSON text, as found: each a quoted name before a colon."""
    return F.array_sort(F.array_distinct(F.array_intersect(F.transform(F.regexp_extract_all(raw, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1)), F.lower), F.array(*[F.lit(d.lower()) for d in denied]))))


def key_paths(rows: DataFrame, key: str, raw: str, denied: list[str]) -> DataFrame:
    """key, path: where a denied key stands in a JSON text, at any depth, as $.name[index].name; texts that aren't JSON give none.

    All values of one depth are opened in one pass; the containers among them, written, are the next pass. There are as many passes as the deepest text has levels.
    """
    spark, out = rows.sparkSession, None
    level = rows.select(F.col(key), F.lit("$").alias("_path"), F.try_parse_json(raw).alias("_v"))
    while True:
        opened = level.where("_v IS NOT NULL").lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "_name", "_value"))
        path = F.when(F.col("_name").isNotNull(), F.concat("_path", F.lit("."), "_name")).otherwise(F.concat("_path", F.lit("["), F.col("_pos").cast("string"), F.lit("]")))
        inside = F.try_variant_get("_value", "$", "map<string,variant>").isNotNull() | F.try_variant_get("_value", "$", "array<variant>").isNotNull()
        held = F.coalesce(F.col("_name").isin(denied), F.lit(False))
        opened = written(opened.select(key, path.alias("_path"), held.alias("_held"), F.when(inside, F.col("_value")).alias("_v")).where("_held OR _v IS NOT NULL"), "keys")
        found = opened.where("_held").select(key, F.col("_path").alias("path"))
        out = found if out is None else out.unionByName(found)
        level = opened.select(key, "_path", "_v")
        if level.where("_v IS NOT NULL").isEmpty():
            return out


def portable_path(path: Column) -> Column:
    return F.coalesce((path != "") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..") & ~path.contains("\\"), F.lit(False))


def leaks(rows: DataFrame, private: list[Column]) -> Column:
    """Whether a row, as JSON, holds any of its private literals."""
    text, out = F.to_json(F.struct(*rows.columns)), F.lit(False)
    for p in private:
        out = out | F.coalesce(text.contains(p) & (p != ""), F.lit(False))
    return out


#: Families of credentials. Fixed values.
SECRETS = {"aws": r"AKIA[0-9A-Z]{16}", "github": r"gh[pousr]_[A-Za-z0-9]{36}", "token": r"""token\s*=\s*["'][0-9a-f]{32,}["']""", "bearer": r"sk-[A-Za-z0-9_-]{20,}"}


def secret_counts(text: Column) -> dict[str, Column]:
    return {k: F.regexp_count(text, F.lit(p)) for k, p in SECRETS.items()}


def policy_for(model: Column, table: list[tuple[str, str]], default: str) -> Column:
    """The policy of the first prefix that fits."""
    out = None
    for prefix, policy in table:
        out = (F if out is None else out).when(model.startswith(prefix), policy)
    return F.lit(default) if out is None else out.otherwise(default)
