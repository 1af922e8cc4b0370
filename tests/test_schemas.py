import json
import random

import pytest

from newsloom.operators import schema_rules

NEWS = {
    "$schema": "http://json-schema.org/draft-07/schema#", "title": "a run", "type": "object", "required": ["version", "stories"], "minProperties": 2, "additionalProperties": False,
    "definitions": {"link": {"type": "string", "format": "uri", "minLength": 3}},
    "properties": {
        "version": {"type": "string", "pattern": r"^0\.3\.\d+$"}, "share": {"type": "number", "minimum": 0, "maximum": 1}, "note": {"type": ["string", "null"], "maxLength": 5},
        "stories": {"type": "array", "minItems": 1, "maxItems": 3, "items": {
            "type": "object", "required": ["id", "links"],
            "properties": {"id": {"type": "string", "pattern": "^st_[0-9a-f]{6}$"}, "kind": {"enum": ["story", "deal"]}, "links": {"type": "array", "uniqueItems": True, "items": {"$ref": "#/definitions/link"}}, "day": {"type": "string", "format": "date"}}}},
        "outlets": {"type": "object", "patternProperties": {"^[a-z]+$": {"type": "integer", "exclusiveMinimum": 0}}, "additionalProperties": {"type": "boolean"}, "propertyNames": {"minLength": 2}},
        "either": {"anyOf": [{"type": "integer"}, {"type": "string"}]}, "one": {"oneOf": [{"type": "integer"}, {"minimum": 5}]}, "no": {"not": {"const": 3}}, "both": {"allOf": [{"minimum": 1}, {"maximum": 2}]},
    },
}
GOOD = {"version": "0.3.1", "stories": [{"id": "st_00ff00", "links": ["a:b"], "kind": "deal", "day": "2026-03-01", "more": 1}], "share": 0.5, "note": None, "outlets": {"ab": 1, "AB": True}, "either": "x", "one": 3, "no": 4, "both": 1.5}


def _found(spark, docs, schema=NEWS, **options):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)]
    out = {i: set() for i in range(len(docs))}
    for x in schema_rules.schema_violations(spark.createDataFrame(rows, "n int, value string"), schema, **options).collect():
        out[x.n].add((x.path, x.rule))
    return [out[i] for i in range(len(docs))]


def test_each_kind_of_violation_with_its_path(spark):
    story = GOOD["stories"][0]
    cases = [
        (GOOD, set()), ("{oops", {("$", "json")}), ("[]", {("$", "type")}), ("null", {("$", "type")}), ('"x"', {("$", "type")}),
        ({"version": "0.3.1"}, {("$", "required:stories"), ("$", "minProperties")}),
        (GOOD | {"extra": 1}, {("$.extra", "additionalProperties")}),
        (GOOD | {"version": "0.4.1", "share": 1.5, "note": "too long"}, {("$.version", "pattern"), ("$.share", "maximum"), ("$.note", "maxLength")}),
        (GOOD | {"version": 3, "share": "0.5", "note": 4}, {("$.version", "type"), ("$.share", "type"), ("$.note", "type")}),
        (GOOD | {"stories": []}, {("$.stories", "minItems")}), (GOOD | {"stories": [story] * 4}, {("$.stories", "maxItems")}),
        (GOOD | {"stories": [story, {"id": "st_x", "links": ["ab", "ab"], "kind": "other"}, 5]},
         {("$.stories[1].id", "pattern"), ("$.stories[1].links", "uniqueItems"), ("$.stories[1].links[0]", "minLength"), ("$.stories[1].links[1]", "minLength"), ("$.stories[1].kind", "enum"), ("$.stories[2]", "type")}),
        (GOOD | {"stories": [{"links": "a:b"}]}, {("$.stories[0]", "required:id"), ("$.stories[0].links", "type")}),
        (GOOD | {"outlets": {"ab": 0, "cd": 1.5, "EF": 1, "g": 2}}, {("$.outlets.ab", "exclusiveMinimum"), ("$.outlets.cd", "type"), ("$.outlets.EF", "type"), ("$.outlets.g", "propertyNames:minLength")}),
        (GOOD | {"either": 1.5, "one": 7, "no": 3, "both": 3}, {("$.either", "anyOf"), ("$.one", "oneOf"), ("$.no", "not"), ("$.both", "maximum")}),
        (GOOD | {"one": "neither"}, set()), (GOOD | {"share": 1.0, "either": 2.0}, set()),
    ]
    for (doc, want), got in zip(cases, _found(spark, [d for d, _ in cases]), strict=True):
        assert got == want, doc


def test_formats_are_told_if_asked_for(spark):
    bad = GOOD | {"stories": [GOOD["stories"][0] | {"day": "2026-13-01", "links": ["no uri"]}]}
    assert _found(spark, [bad])[0] == set()
    assert _found(spark, [bad, GOOD], formats=True) == [{("$.stories[0].day", "format"), ("$.stories[0].links[0]", "format")}, set()]


def test_schemas_that_are_refused():
    for schema, what in (({"type": "object", "dependencies": {}}, "dependencies"), ({"$ref": "#/a", "a": {"properties": {"x": {"$ref": "#/a"}}}}, "itself"), ({"$ref": "other.json"}, "inside")):
        from pyspark.sql import functions as F

        with pytest.raises(ValueError, match=what):
            schema_rules.Compiler(schema).broken(F.col("x"), F.lit("$"), schema)


def _judge(v, s, path="$"):
    """The rules of test_made_documents by plain recursion."""
    kind = "null" if v is None else {bool: "boolean", str: "string", list: "array", dict: "object", int: "integer", float: "number"}[type(v)]
    kind = "integer" if kind == "number" and v == int(v) else kind
    if "type" in s and kind != s["type"] and not (s["type"] == "number" and kind == "integer"):
        yield path, "type"
    if kind in ("integer", "number") and "minimum" in s and v < s["minimum"]:
        yield path, "minimum"
    if kind == "string" and len(v) < s.get("minLength", 0):
        yield path, "minLength"
    if kind == "array" and "items" in s:
        for i, x in enumerate(v):
            yield from _judge(x, s["items"], f"{path}[{i}]")
    if kind == "object":
        yield from ((path, f"required:{k}") for k in s.get("required", []) if k not in v)
        for k, x in v.items():
            if k in s.get("properties", {}):
                yield from _judge(x, s["properties"][k], f"{path}.{k}")


def test_made_documents_against_recursion(spark):
    r = random.Random(3)
    leaf = lambda: r.choice([{"type": "string", "minLength": 2}, {"type": "number", "minimum": 1}, {"type": "integer"}, {"type": "boolean"}, {"minimum": 2}])
    schema = {"type": "object", "required": ["a", "b"], "properties": {"a": leaf(), "b": {"type": "array", "items": {"type": "object", "required": ["x"], "properties": {"x": leaf(), "y": {"items": leaf()}}}}, "c": {"properties": {"d": leaf()}}}}

    def value(depth):
        kind = r.randrange(9 if depth < 4 else 6)
        if kind > 6:
            return {r.choice("abcdxy"): value(depth + 1) for _ in range(r.randrange(5))}
        if kind == 6:
            return [value(depth + 1) for _ in range(r.randrange(4))]
        return r.choice([None, True, 0, 1, 2.0, 2.5, -1, "", "ab", "x"])

    docs = [{k: value(1) for k in r.sample("abc", r.randint(1, 3))} for _ in range(60)] + [value(0) for _ in range(20)]
    docs += [{"a": "ab", "b": [{"x": value(3), "y": [value(4), 1]} for _ in range(3)], "c": {"d": value(4)}} for _ in range(40)]
    for d, got in zip(docs, _found(spark, [json.dumps(d) for d in docs], schema), strict=True):
        assert got == set(_judge(d, schema)), d
