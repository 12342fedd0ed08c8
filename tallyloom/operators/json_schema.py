"""JSON Schema (draft 2020-12) as one column expression over VARIANT: a schema is compiled once, rows are checked in the JVM.

`Schema(schema).errors(column)` is an array of (pointer, keyword, detail): the JSON pointer of the value at fault, the keyword it breaks, and
what that keyword asks for (for `required` the missing name, for a closed object its names that aren't allowed). As in the draft, a
broken `anyOf`, `oneOf` or `not` is one error at the value itself, `allOf`, `$ref` and `then`/`else` give the errors of their schemas.

Every value is opened once: a lambda over a one-element array binds its kind, members, items, text and number. Schemas that refer to
themselves can't be written out as an expression and are refused, as are keywords that aren't known here.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "struct<pointer:string,keyword:string,detail:string>"
#: Keywords that assert nothing.
SILENT = {"$schema", "$id", "$anchor", "$defs", "definitions", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "if", "then", "else", "minContains", "maxContains"}
#: Kinds of variants that are numbers.
NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"
KINDS = ("null", "boolean", "object", "array", "number", "string", "integer")

_TIME = r"([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)"
#: Formats that are checked when asked for; all others are accepted.
FORMATS: dict[str, Callable[[Column], Column]] = {
    "date-time": lambda s: s.rlike(rf"(?d)\A\d{{4}}-\d\d-\d\d[Tt]{_TIME}\z") & F.substring(s, 1, 10).try_cast("date").isNotNull(),
    "date": lambda s: s.rlike(r"\A\d{4}-\d\d-\d\d\z") & s.try_cast("date").isNotNull(),
    "time": lambda s: s.rlike(rf"\A{_TIME}\z"),
    "uuid": lambda s: s.rlike(r"\A[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"),
    "ipv4": lambda s: s.rlike(r"\A((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(?!\z)|\z)){4}"),
    "email": lambda s: s.contains("@"),
}


def _none() -> Column:
    return F.array().cast(f"array<{ERROR}>")


def _token(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def _token_of(name: Column) -> Column:
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _canonical(v: Column) -> Column:
    """Text that is equal for equal values: members in order, numbers of one value alike."""
    return F.when(F.schema_of_variant(v).rlike(NUMBER), F.concat(F.lit("#"), F.try_variant_get(v, "$", "double").cast("string"))).otherwise(F.to_json(v))


class _Value:
    """An opened value: the fields of the struct that _open makes of a variant."""

    def __init__(self, node: Column, at: Column):
        self.node, self.at = node, at
        self.variant, self.kind, self.members, self.items, self.text, self.number = (node[f] for f in ("v", "kind", "members", "items", "text", "number"))

    def iskind(self, name: str) -> Column:
        if name == "integer":
            return self.number == F.floor(self.number)
        start = {"null": "VOID", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "string": "STRING"}
        return self.kind.rlike(NUMBER) if name == "number" else self.kind.startswith(start[name])


#: What a keyword reads of a value besides its kind.
READS = {
    "members": {"minProperties", "maxProperties", "properties", "required", "additionalProperties", "patternProperties", "propertyNames", "dependentRequired"},
    "items": {"minItems", "maxItems", "uniqueItems", "items", "prefixItems", "contains"},
    "text": {"enum", "const", "pattern", "format", "minLength", "maxLength"},
    "number": {"type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"},
}


def _open(v: Column, reads: set[str]) -> Column:
    """Only what the schema reads is taken out of the variant; the rest is null."""
    members, items = F.try_variant_get(v, "$", "map<string,variant>"), F.try_variant_get(v, "$", "array<variant>")
    kind = scalar = F.schema_of_variant(v)  # of a container it would describe all that is inside
    if reads & {"members", "items"}:
        kind = F.when(members.isNotNull(), "OBJECT").when(items.isNotNull(), "ARRAY").otherwise(scalar)
    fields = {
        "members": members, "items": items,
        "text": F.when(scalar == "STRING", F.try_variant_get(v, "$", "string")), "number": F.when(scalar.rlike(NUMBER), F.try_variant_get(v, "$", "double")),
    }
    none = {"members": "map<string,variant>", "items": "array<variant>", "text": "string", "number": "double"}
    return F.struct(v.alias("v"), kind.alias("kind"), *[(c if name in reads else F.lit(None).cast(none[name])).alias(name) for name, c in fields.items()])


class Schema:
    """A compiled schema. formats: whether `format` is checked (by FORMATS) or only noted, as the draft has it."""

    def __init__(self, schema: dict[str, Any] | bool, *, formats: bool = False):
        self.root, self.formats = schema, formats
        self._refs: list[str] = []

    def errors(self, column: Column | str) -> Column:
        """Errors of a column of JSON text or VARIANT; a text that isn't JSON is one error of keyword `json`, a null is none."""
        c = F.col(column) if isinstance(column, str) else column
        return self._of(self.root, c, F.lit(""))

    def errors_of_text(self, text: Column | str) -> Column:
        c = F.col(text) if isinstance(text, str) else text
        bad = F.array(self._error(F.lit(""), "json", "JSON text"))
        parsed = F.try_parse_json(c)
        return F.when(c.isNull(), _none()).when(parsed.isNull(), bad).otherwise(self.errors(parsed))

    # one value

    def _of(self, schema: Any, variant: Column, at: Column) -> Column:
        if schema is True or schema == {}:
            return _none()
        reads = self._reads(schema)
        return F.flatten(F.transform(F.array(_open(variant, reads)), lambda node: self._errors(schema, _Value(node, at))))

    def _reads(self, schema: Any) -> set[str]:
        """What a schema, and all that apply to the same value, read of it."""
        if not isinstance(schema, dict):
            return set()
        out = {field for field, keywords in READS.items() if keywords & set(schema)}
        if "type" in schema and "integer" not in schema["type"]:
            out -= {"number"} if not READS["number"] & (set(schema) - {"type"}) else set()
        for k in ("allOf", "anyOf", "oneOf"):
            for sub in schema.get(k, []):
                out |= self._reads(sub)
        for k in ("not", "if", "then", "else"):
            out |= self._reads(schema.get(k))
        return out | (self._reads(self._target(schema["$ref"])) if "$ref" in schema else set())

    def _valid(self, schema: Any, value: _Value) -> Column:
        return F.size(self._errors(schema, value)) == 0

    def _error(self, at: Column, keyword: str, detail: Any) -> Column:
        return F.struct(at.alias("pointer"), F.lit(keyword).alias("keyword"), (detail if isinstance(detail, Column) else F.lit(detail if isinstance(detail, str) else json.dumps(detail, ensure_ascii=False))).alias("detail"))

    def _errors(self, schema: Any, value: _Value) -> Column:
        """All errors of an opened value."""
        if schema is True or schema == {}:
            return _none()
        if schema is False:
            return F.array(self._error(value.at, "false", "nothing"))
        unknown = set(schema) - SILENT - set(self._KEYWORDS) - set(self._LISTS)
        if unknown:
            raise ValueError(f"keywords of a schema that are not supported: {sorted(unknown)}")
        single = [F.when(F.coalesce(self._KEYWORDS[k](self, arg, value), F.lit(False)), self._error(value.at, k, arg)) for k, arg in schema.items() if k in self._KEYWORDS and (k != "format" or self.formats and arg in FORMATS)]
        parts = [part for k, arg in schema.items() if k in self._LISTS for part in self._LISTS[k](self, arg, value, schema)]
        if "if" in schema:
            then, other = (self._errors(schema.get(k, True), value) for k in ("then", "else"))
            parts.append(F.when(self._valid(schema["if"], value), then).otherwise(other))
        if single:
            parts.insert(0, F.filter(F.array(*single), lambda e: e.isNotNull()))
        return F.concat(*parts) if parts else _none()

    def _equal(self, value: _Value, wanted: Any) -> Column:
        if wanted is None:
            return value.iskind("null")
        if isinstance(wanted, bool):
            return value.iskind("boolean") & (F.try_variant_get(value.variant, "$", "boolean") == wanted)
        if isinstance(wanted, int | float):
            return value.number == float(wanted)
        if isinstance(wanted, str):
            return value.text == wanted
        return F.to_json(value.variant) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))

    def _contained(self, value: _Value, schema: Any) -> Column:
        return F.size(F.filter(value.items, lambda x: F.size(self._of(schema, x, F.lit(""))) == 0))

    def _unlike(self, arg: list | str, value: _Value) -> Column:
        out = F.lit(True)
        for k in [arg] if isinstance(arg, str) else arg:
            if k not in KINDS:
                raise ValueError(f"no such type: {k}")
            out = out & ~F.coalesce(value.iskind(k), F.lit(False))
        return out

    def _differs(self, wanted: list, value: _Value) -> Column:
        texts = [w for w in wanted if isinstance(w, str)]
        out = F.coalesce(value.text.isin(texts), F.lit(False)) if texts else F.lit(False)
        for w in wanted:
            if not isinstance(w, str):
                out = out | F.coalesce(self._equal(value, w), F.lit(False))
        return ~out

    #: keyword: whether the value breaks it; a null answer (a value of another kind) is no.
    _KEYWORDS: dict[str, Callable[[Schema, Any, _Value], Column]] = {
        "type": _unlike,
        "enum": _differs,
        "const": lambda self, a, v: ~F.coalesce(self._equal(v, a), F.lit(False)),
        "pattern": lambda self, a, v: ~v.text.rlike(f"(?d){a}"),
        "format": lambda self, a, v: v.text.isNotNull() & ~FORMATS[a](v.text),
        "minLength": lambda self, a, v: F.length(v.text) < a,
        "maxLength": lambda self, a, v: F.length(v.text) > a,
        "minimum": lambda self, a, v: v.number < a,
        "maximum": lambda self, a, v: v.number > a,
        "exclusiveMinimum": lambda self, a, v: v.number <= a,
        "exclusiveMaximum": lambda self, a, v: v.number >= a,
        "multipleOf": lambda self, a, v: (v.number / a) != F.floor(v.number / a),
        "minItems": lambda self, a, v: F.size(v.items) < a,
        "maxItems": lambda self, a, v: F.size(v.items) > a,
        "uniqueItems": lambda self, a, v: (F.size(F.array_distinct(F.transform(v.items, _canonical))) < F.size(v.items)) if a else F.lit(False),
        "minProperties": lambda self, a, v: F.size(v.members) < a,
        "maxProperties": lambda self, a, v: F.size(v.members) > a,
        "anyOf": lambda self, a, v: ~self._count(a, v, least=1),
        "oneOf": lambda self, a, v: ~self._count(a, v, exact=1),
        "not": lambda self, a, v: self._valid(a, v),
    }

    def _count(self, schemas: list, value: _Value, *, least: int | None = None, exact: int | None = None) -> Column:
        n = sum((self._valid(s, value).cast("int") for s in schemas), F.lit(0))
        return n >= least if exact is None else n == exact

    # keywords of several errors, or of errors further down

    def _ref(self, ref: str, value: _Value, schema: dict) -> list[Column]:
        if ref in self._refs:
            raise ValueError(f"the schema refers to itself by {ref}")
        self._refs.append(ref)
        try:
            return [self._errors(self._target(ref), value)]
        finally:
            self._refs.pop()

    def _target(self, ref: str) -> Any:
        if not ref.startswith("#"):
            raise ValueError(f"only references within the schema are followed: {ref}")
        target = self.root
        for token in ref[1:].split("/")[1:]:
            target = target[int(token)] if isinstance(target, list) else target[token.replace("~1", "/").replace("~0", "~")]
        return target

    def _properties(self, properties: dict, value: _Value, schema: dict) -> list[Column]:
        out = []
        for name, sub in properties.items():
            if sub is not True and sub != {}:
                child = F.try_element_at(value.members, F.lit(name))
                out.append(F.when(child.isNotNull(), self._of(sub, child, F.concat(value.at, F.lit(f"/{_token(name)}")))).otherwise(_none()))
        return out

    def _required(self, names: list[str], value: _Value, schema: dict) -> list[Column]:
        missing = F.filter(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda n: ~F.map_contains_key(value.members, n))
        return [F.when(value.members.isNotNull(), F.transform(missing, lambda n: self._error(value.at, "required", n))).otherwise(_none())]

    def _others(self, value: _Value, schema: dict) -> Column:
        """Members that neither properties nor patternProperties name."""
        named, patterns = [F.lit(n) for n in schema.get("properties", {})], list(schema.get("patternProperties", {}))
        other = lambda k: (~k.isin(*named) if named else F.lit(True)) & ~(k.rlike("(?d)" + "|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False))
        return F.map_filter(value.members, lambda k, v: other(k))

    def _members(self, value: _Value, members: Column, sub: Any) -> Column:
        """Errors of all members of a map, by one schema."""
        each = F.transform(F.map_entries(members), lambda e: self._of(sub, e["value"], F.concat(value.at, F.lit("/"), _token_of(e["key"]))))
        return F.when(value.members.isNotNull(), F.flatten(each)).otherwise(_none())

    def _additional(self, sub: Any, value: _Value, schema: dict) -> list[Column]:
        others = self._others(value, schema)
        if sub is False:
            names = F.array_sort(F.map_keys(others))
            return [F.when((value.members.isNotNull()) & (F.size(names) > 0), F.array(self._error(value.at, "additionalProperties", F.array_join(names, ", ")))).otherwise(_none())]
        return [] if sub is True or sub == {} else [self._members(value, others, sub)]

    def _patterns(self, patterns: dict, value: _Value, schema: dict) -> list[Column]:
        like = lambda p: lambda k, v: k.rlike(f"(?d){p}")
        return [self._members(value, F.map_filter(value.members, like(p)), sub) for p, sub in patterns.items()]

    def _names(self, sub: Any, value: _Value, schema: dict) -> list[Column]:
        wrong = F.filter(F.map_keys(value.members), lambda k: F.size(self._of(sub, F.parse_json(F.concat(F.lit('"'), F.regexp_replace(k, r'(["\\])', r"\\$1"), F.lit('"'))), F.lit(""))) > 0)
        return [F.when(value.members.isNotNull(), F.transform(F.array_sort(wrong), lambda k: self._error(value.at, "propertyNames", k))).otherwise(_none())]

    def _dependent(self, needs: dict[str, list[str]], value: _Value, schema: dict) -> list[Column]:
        out = []
        for name, others in needs.items():
            present = F.coalesce(F.map_contains_key(value.members, F.lit(name)), F.lit(False))
            missing = F.filter(F.array(*[F.lit(n) for n in others]).cast("array<string>"), lambda n: ~F.map_contains_key(value.members, n))
            out.append(F.when(present, F.transform(missing, lambda n: self._error(value.at, "dependentRequired", n))).otherwise(_none()))
        return out

    def _item_errors(self, value: _Value, sub: Any, start: int) -> Column:
        each = F.transform(value.items, lambda x, i: F.when(i >= start, self._of(sub, x, F.concat(value.at, F.lit("/"), i.cast("string")))).otherwise(_none()))
        return F.when(value.items.isNotNull(), F.flatten(each)).otherwise(_none())

    def _items(self, sub: Any, value: _Value, schema: dict) -> list[Column]:
        if sub is True or sub == {}:
            return []
        return [self._item_errors(value, sub, len(schema.get("prefixItems", [])))]

    def _prefix(self, subs: list, value: _Value, schema: dict) -> list[Column]:
        return [F.when(F.coalesce(F.size(value.items) > i, F.lit(False)), self._of(sub, F.get(value.items, F.lit(i)), F.concat(value.at, F.lit(f"/{i}")))).otherwise(_none()) for i, sub in enumerate(subs)]

    def _contains(self, sub: Any, value: _Value, schema: dict) -> list[Column]:
        least, most, n = schema.get("minContains", 1), schema.get("maxContains"), self._contained(value, sub)
        wrong = n < least if most is None else (n < least) | (n > most)
        return [F.when((value.items.isNotNull()) & wrong, F.array(self._error(value.at, "contains", {"min": least, "max": most}))).otherwise(_none())]

    _LISTS: dict[str, Callable[[Schema, Any, _Value, dict], list[Column]]] = {
        "$ref": _ref,
        "allOf": lambda self, subs, v, schema: [self._errors(s, v) for s in subs],
        "properties": _properties,
        "required": _required,
        "additionalProperties": _additional,
        "patternProperties": _patterns,
        "propertyNames": _names,
        "dependentRequired": _dependent,
        "items": _items,
        "prefixItems": _prefix,
        "contains": _contains,
    }


def schema_violations(rows: DataFrame, schema: Schema, key: str, raw: str) -> DataFrame:
    """key, pointer, keyword, detail: a row for each error of the JSON text in column `raw`. A null text has none."""
    return rows.select(key, F.explode(schema.errors_of_text(raw)).alias("e")).select(key, "e.*")


def rendered(errors: Column, *, limit: int = 10) -> Column:
    """The first errors by pointer, as `location: keyword detail; ...` with dots in the location and $ for the whole value; null for none."""
    place = lambda e: F.when(e["pointer"] == "", "$").otherwise(F.replace(F.substring(e["pointer"], 2, 1 << 30), F.lit("/"), F.lit(".")))
    return F.when(F.size(errors) > 0, F.array_join(F.transform(F.slice(F.array_sort(errors), 1, limit), lambda e: F.concat(place(e), F.lit(": "), e["keyword"], F.lit(" "), e["detail"])), "; "))
