"""Compiled schemas against a plain reading of the draft, over mutated records."""

import json
import math
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.json_schema import Schema, rendered, schema_violations
from tallyloom.operators.rules import key_paths

EXPECTED = {
    "$schema": "https://json-schema.org/draft/2020-12/schema",
    "type": "object",
    "additionalProperties": False,
    "required": ["id", "kind", "messages"],
    "properties": {
        "id": {"$ref": "#/$defs/id"},
        "kind": {"enum": ["a", "b", 3, None, True]},
        "version": {"const": "v0.1"},
        "score": {"type": "number", "minimum": 0, "exclusiveMaximum": 1},
        "count": {"type": ["integer", "null"], "multipleOf": 2, "maximum": 100, "exclusiveMinimum": -4},
        "messages": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"$ref": "#/$defs/message"}},
        "tags": {"type": "array", "uniqueItems": True, "items": {"type": ["string", "number", "array"]}, "contains": {"type": "string"}, "minContains": 1, "maxContains": 2},
        "pair": {"prefixItems": [{"type": "string"}, {"type": "integer"}], "items": False},
        "when": {"type": "string", "format": "date-time"},
        "day": {"format": "date"},
        "note": {"oneOf": [{"type": "null"}, {"type": "string", "minLength": 2, "maxLength": 4}, {"type": "string", "pattern": "^x"}]},
        "extra": {"type": "object", "patternProperties": {"^n_": {"type": "number"}}, "additionalProperties": {"type": "string"}, "propertyNames": {"maxLength": 5}, "minProperties": 1, "maxProperties": 3},
        "same": {"const": {"b": [1, None], "a/b~c": {"x": 1}}},
        "not": {"not": {"type": "string"}},
        "any": {"anyOf": [{"type": "integer"}, {"minLength": 3}]},
        "never": False,
        "free": True,
    },
    "dependentRequired": {"score": ["count", "version"]},
    "allOf": [{"if": {"properties": {"kind": {"const": "a"}}, "required": ["kind"]}, "then": {"required": ["score"]}, "else": {"properties": {"count": {"minimum": 2}}}}],
    "$defs": {
        "id": {"type": "string", "pattern": "^[A-Z][0-9]+$"},
        "message": {"type": "object", "required": ["text"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "by": {"$ref": "#/$defs/id"}, "parts": {"type": "array", "items": {"$ref": "#/$defs/part"}}}},
        "part": {"type": "object", "properties": {"a/b": {"type": "boolean"}, "t~": {"$ref": "#/$defs/id"}}, "required": ["a/b"]},
    },
}


def kind_of(v):
    if v is None or isinstance(v, bool):
        return "null" if v is None else "boolean"
    return {int: "number", float: "number", str: "string", list: "array", dict: "object"}[type(v)]


def isa(v, kind):
    return kind_of(v) == "number" and v == math.floor(v) if kind == "integer" else kind_of(v) == kind


def alike(a, b):
    if kind_of(a) != kind_of(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(alike, a, b))
    if isinstance(a, dict):
        return set(a) == set(b) and all(alike(a[k], b[k]) for k in a)
    return a == b


def is_date(text):
    try:
        return bool(date.fromisoformat(text)) and len(text) == 10
    except ValueError:
        return False


def plain(root, schema, v, at=""):
    """(pointer, keyword) of all errors, in the words of the draft."""
    if schema is True:
        return []
    if schema is False:
        return [(at, "false")]
    out, kind = [], kind_of(v)
    bad = lambda keyword, broken: out.append((at, keyword)) if broken else None
    ok = lambda s, x: not plain(root, s, x)
    step = lambda name: f"{at}/{str(name).replace('~', '~0').replace('/', '~1')}"
    for k, a in schema.items():
        if k == "$ref":
            target = root
            for token in a[2:].split("/"):
                target = target[token]
            out += plain(root, target, v, at)
        elif k == "allOf":
            out += [e for s in a for e in plain(root, s, v, at)]
        elif k == "anyOf":
            bad(k, not any(ok(s, v) for s in a))
        elif k == "oneOf":
            bad(k, sum(ok(s, v) for s in a) != 1)
        elif k == "not":
            bad(k, ok(a, v))
        elif k == "if":
            out += plain(root, schema.get("then" if ok(a, v) else "else", True), v, at)
        elif k == "type":
            bad(k, not any(isa(v, t) for t in ([a] if isinstance(a, str) else a)))
        elif k == "enum":
            bad(k, not any(alike(v, x) for x in a))
        elif k == "const":
            bad(k, not alike(v, a))
        elif kind == "string" and k in ("minLength", "maxLength", "pattern", "format"):
            tests = {"minLength": lambda: len(v) < a, "maxLength": lambda: len(v) > a, "pattern": lambda: not re.search(a, v), "format": lambda: not (is_date(v[:10]) and (a == "date" and len(v) == 10 or a == "date-time" and re.fullmatch(r"T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?(Z|[+-][01]\d:[0-5]\d)", v[10:])))}
            bad(k, tests[k]())
        elif kind == "number" and k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
            bad(k, {"minimum": v < a, "maximum": v > a, "exclusiveMinimum": v <= a, "exclusiveMaximum": v >= a, "multipleOf": k == "multipleOf" and v / a != math.floor(v / a)}[k])
        elif kind == "array":
            if k in ("minItems", "maxItems"):
                bad(k, len(v) < a if k == "minItems" else len(v) > a)
            elif k == "uniqueItems":
                bad(k, any(alike(x, y) for i, x in enumerate(v) for y in v[:i]))
            elif k == "items":
                out += [e for i, x in enumerate(v) if i >= len(schema.get("prefixItems", [])) for e in plain(root, a, x, step(i))]
            elif k == "prefixItems":
                out += [e for i, (s, x) in enumerate(zip(a, v)) for e in plain(root, s, x, step(i))]
            elif k == "contains":
                bad(k, not schema.get("minContains", 1) <= sum(ok(a, x) for x in v) <= schema.get("maxContains", math.inf))
        elif kind == "object":
            if k in ("minProperties", "maxProperties"):
                bad(k, len(v) < a if k == "minProperties" else len(v) > a)
            elif k == "required":
                out += [(at, k) for n in a if n not in v]
            elif k == "dependentRequired":
                out += [(at, k) for n, others in a.items() if n in v for o in others if o not in v]
            elif k == "properties":
                out += [e for n, s in a.items() if n in v for e in plain(root, s, v[n], step(n))]
            elif k == "patternProperties":
                out += [e for p, s in a.items() for n in v if re.search(p, n) for e in plain(root, s, v[n], step(n))]
            elif k == "propertyNames":
                out += [(at, k) for n in v if not ok(a, n)]
            elif k == "additionalProperties":
                others = [n for n in v if n not in schema.get("properties", {}) and not any(re.search(p, n) for p in schema.get("patternProperties", {}))]
                if a is False:
                    bad(k, others)
                else:
                    out += [e for n in others for e in plain(root, a, v[n], step(n))]
    return out


VALUES = [None, True, False, 0, 1, 2, 3, -4, 0.5, 1.0, 7.25, 100, 102, 1e3, "", "a", "b", "xy", "x", "xyzzy", "A1", "v0.1", "é😀", 'q"\\', "2024-02-29", "2023-02-29", "2024-05-01T10:00:00Z", "2024-05-01T25:00:00Z", "2024-05-01", "A1\n", [], {}, [1, 1.0], ["a", "a"], ["a", 2], ["a", 2, 3], [[1], [1.0]], {"b": [1, None], "a/b~c": {"x": 1}}, {"n_1": 1, "z": "t"}, {"n_1": "t", "longer": 1}]
GOOD = {"id": "A1", "kind": "b", "version": "v0.1", "score": 0.5, "count": 4, "messages": [{"text": "t", "by": "B2", "parts": [{"a/b": True, "t~": "C3"}]}], "tags": ["x", 1, [2]], "pair": ["p", 1], "when": "2024-05-01T10:00:00.5+02:00", "day": "2024-02-29", "note": None, "extra": {"n_a": 1}, "same": {"a/b~c": {"x": 1}, "b": [1, None]}, "not": 1, "any": "abc", "free": [{}]}


def mutated(rnd, value):
    """The value with some parts replaced, removed, repeated or renamed."""
    if rnd.random() < 0.05:
        return rnd.choice(VALUES)
    if isinstance(value, dict):
        out = {k: mutated(rnd, v) for k, v in value.items() if rnd.random() > 0.06}
        if rnd.random() < 0.05:
            out[rnd.choice(["zz", "a/b", "n_2", "never", "t~", "more"])] = rnd.choice(VALUES)
        return out
    if isinstance(value, list):
        out = [mutated(rnd, v) for v in value]
        return out + out[:1] if rnd.random() < 0.1 else out
    return rnd.choice(VALUES) if rnd.random() < 0.08 else value


def test_mutated_records_against_the_draft(spark):
    rnd = random.Random(4)
    records = [GOOD] + [mutated(rnd, GOOD) for _ in range(9_999)]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)]
    got = {}
    for r in schema_violations(spark.createDataFrame(rows, "i int, j string").repartition(4), Schema(EXPECTED, formats=True), "i", "j").collect():
        got.setdefault(r.i, []).append((r.pointer, r.keyword))
    assert not plain(EXPECTED, EXPECTED, GOOD) and 0 not in got
    want = {i: sorted(e) for i, r in enumerate(records) if (e := plain(EXPECTED, EXPECTED, r))}
    assert {i: sorted(e) for i, e in got.items()} == want
    assert {k for e in want.values() for _, k in e} >= {"type", "enum", "const", "pattern", "format", "required", "oneOf", "anyOf", "not", "additionalProperties", "uniqueItems", "contains", "false", "dependentRequired", "propertyNames"}


def test_texts_that_are_no_json(spark):
    rows = [(1, "{"), (2, None), (3, '{"a":1,"a":2}'), (4, "[]"), (5, '{"id": "A1", "kind": null, "messages": [{"text": "t"}]}')]
    got = [(r.i, r.pointer, r.keyword) for r in schema_violations(spark.createDataFrame(rows, "i int, j string"), Schema(EXPECTED), "i", "j").orderBy("i").collect()]
    assert got == [(1, "", "json"), (3, "", "json"), (4, "", "type")]


def test_rendered(spark):
    rows = [('{"id": "a", "kind": "b", "messages": [{"by": "A1"}], "zz": 1}',), (json.dumps(GOOD),)]
    df = spark.createDataFrame(rows, "j string")
    first, second = [r[0] for r in df.select(rendered(Schema(EXPECTED).errors_of_text("j"))).collect()]
    assert first == "$: additionalProperties zz; id: pattern ^[A-Z][0-9]+$; messages.0: required text" and second is None


def test_refused_schemas(spark):
    for schema in ({"$ref": "#/$defs/a", "$defs": {"a": {"items": {"$ref": "#/$defs/a"}}}}, {"unevaluatedProperties": False}, {"$ref": "other.json"}, {"type": "text"}):
        with pytest.raises(ValueError):
            Schema(schema).errors(F.parse_json(F.lit("1")))


def walk(value, denied, path="$"):
    out = []
    for step, child in [(f".{k}", v) for k, v in value.items()] if isinstance(value, dict) else [(f"[{i}]", v) for i, v in enumerate(value)] if isinstance(value, list) else []:
        out += [path + step] * (step[1:] in denied and isinstance(value, dict)) + walk(child, denied, path + step)
    return out


def test_key_paths_against_a_plain_walk(spark):
    rnd = random.Random(8)

    def nested(depth):
        kind = rnd.random()
        if depth == 0 or kind < 0.2:
            return rnd.choice([1, None, "gold", ""])
        if kind < 0.5:
            return [nested(depth - 1) for _ in range(rnd.randint(0, 3))]
        return {k: nested(depth - 1) for k in rnd.sample(["gold", "answer", "a b", "x", "Gold"], rnd.randint(0, 4))}

    records = [nested(6) for _ in range(300)] + [{"gold": [[[[{"a": {"answer": {"gold": {}}}}]]]]}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(-1, "{"), (-2, None)]
    got = sorted((r.i, r.path) for r in key_paths(spark.createDataFrame(rows, "i int, j string").repartition(3), "i", "j", ["gold", "answer"]).collect())
    assert got == sorted((i, p) for i, r in enumerate(records) for p in walk(r, {"gold", "answer"}))
