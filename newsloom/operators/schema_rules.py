"""JSON documents against JSON Schema documents: a schema is compiled to one Column over a variant, which gives every violation with its path.

The compiler walks the schema, not the data: objects become maps of variants, lists are gone through by lambdas, and each rule is a condition with
a path, so a document of any size is judged by one expression of the schema's size and no Python runs on it. References inside a schema
(#/definitions/…, #/$defs/…) are followed where they lead to no cycle. A rule that the compiler doesn't know is refused when the schema is read, rather than passed over.

Meaning as in draft 7: a rule speaks of values of its own type alone (minimum of numbers, pattern of strings, …); integers are numbers
without a fraction; `format` is told only if formats=True.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MAP, _LIST = "map<string,variant>", "array<variant>"
FOUND = "array<struct<path:string,rule:string>>"
#: Keywords that say nothing about a document.
REMARKS = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "definitions", "$defs", "readOnly", "writeOnly"}
#: What a string of a format looks like.
FORMATS = {
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "date-time": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt ]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)$",
    "time": r"^([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)?$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|\\^`]*$",
    "email": r"^[^@\s]+@[^@\s]+$",
}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), 0)


def _none() -> Column:
    return F.array().cast(FOUND)


def _all(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else _none()


def _kind(v: Column) -> Column:
    scalar = F.schema_of_variant(v)
    number = v.cast("double")
    return (
        F.when(F.is_variant_null(v), "null").when(F.try_variant_get(v, "$", _MAP).isNotNull(), "object").when(F.try_variant_get(v, "$", _LIST).isNotNull(), "array")
        .when(scalar == "STRING", "string").when(scalar == "BOOLEAN", "boolean").when(number == F.floor(number), "integer").otherwise("number")
    )


class Compiler:
    def __init__(self, schema: dict | bool, formats: bool = False) -> None:
        self.root, self.formats = schema, formats

    def _target(self, ref: str) -> dict | bool:
        if not ref.startswith("#"):
            raise ValueError(f"only references inside the schema are followed, not {ref!r}")
        at = self.root
        for step in ref[1:].strip("/").split("/") if ref != "#" else []:
            at = at[step.replace("~1", "/").replace("~0", "~")]
        return at

    def broken(self, v: Column, path: Column, schema: dict | bool, within: tuple[str, ...] = ()) -> Column:
        """The violations of a value (variant, not null)."""
        if schema is True or schema == {}:
            return _none()
        if schema is False:
            return F.array(self._one(path, "false"))
        if "$ref" in schema:
            ref = schema["$ref"]
            if ref in within:
                raise ValueError(f"{ref!r} leads back to itself")
            return self.broken(v, path, self._target(ref), (*within, ref))
        both = F.struct(v.alias("v"), _kind(v).alias("k"))
        return _let(both, lambda x: _all(self._parts(x["v"], x["k"], path, schema, within)))

    @staticmethod
    def _one(path: Column, rule: str) -> Column:
        return F.struct(path.alias("path"), F.lit(rule).alias("rule"))

    def _parts(self, v: Column, kind: Column, path: Column, schema: dict, within: tuple[str, ...]) -> list[Column]:
        rules: list[tuple[str, Column]] = []
        parts: list[Column] = []
        text, number = v.cast("string"), v.cast("double")
        is_number = kind.isin("integer", "number")
        members, items = F.try_variant_get(v, "$", _MAP), F.try_variant_get(v, "$", _LIST)
        of = {
            "minimum": (is_number, lambda x: number < x), "maximum": (is_number, lambda x: number > x),
            "exclusiveMinimum": (is_number, lambda x: number <= x), "exclusiveMaximum": (is_number, lambda x: number >= x),
            "minLength": (kind == "string", lambda x: F.length(text) < x), "maxLength": (kind == "string", lambda x: F.length(text) > x),
            "pattern": (kind == "string", lambda x: ~text.rlike(x)),
            "minItems": (kind == "array", lambda x: F.size(items) < x), "maxItems": (kind == "array", lambda x: F.size(items) > x),
            "uniqueItems": (kind == "array", lambda x: F.lit(x) & (F.size(F.array_distinct(F.transform(items, lambda y: F.to_json(y)))) < F.size(items))),
            "minProperties": (kind == "object", lambda x: F.size(members) < x), "maxProperties": (kind == "object", lambda x: F.size(members) > x),
        }
        for word, x in schema.items():
            if word in REMARKS:
                continue
            if word == "type":
                allowed = {"integer" if t == "number" else t for t in ([x] if isinstance(x, str) else x)} | set([x] if isinstance(x, str) else x)
                rules.append((word, ~kind.isin(*sorted(allowed))))
            elif word in ("enum", "const"):
                told = [json.dumps(e, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for e in (x if word == "enum" else [x])]
                rules.append((word, ~F.to_json(v).isin(*told)))
            elif word in of:
                holds, test = of[word]
                rules.append((word, holds & test(x)))
            elif word == "format":
                if self.formats and x in FORMATS:
                    rules.append((word, (kind == "string") & ~text.rlike(FORMATS[x])))
            elif word == "required":
                for name in x:
                    rules.append((f"required:{name}", (kind == "object") & members[name].isNull()))
            elif word == "properties":
                for name, inner in x.items():
                    below = members[name]
                    found = _let(below, lambda y, inner=inner, name=name: F.when(y.isNotNull(), self.broken(y, F.concat(path, F.lit(f".{name}")), inner, within)))
                    parts.append(F.when(kind == "object", F.coalesce(found, _none())).otherwise(_none()))
            elif word == "patternProperties":
                for pattern, inner in x.items():
                    parts.append(self._members(members, kind, path, lambda k, pattern=pattern: k.rlike(pattern), inner, within))
            elif word == "additionalProperties":
                known, patterns = list(schema.get("properties", {})), list(schema.get("patternProperties", {}))

                def test(k: Column, known=known, patterns=patterns) -> Column:
                    out = ~k.isin(*known) if known else F.lit(True)
                    for p in patterns:
                        out = out & ~k.rlike(p)
                    return out

                if x is False:
                    extra = F.filter(F.map_keys(members), lambda k: test(k))  # noqa: B023
                    found = F.transform(extra, lambda k: self._one(F.concat(path, F.lit("."), k), "additionalProperties"))
                    parts.append(F.when(kind == "object", found).otherwise(_none()))
                elif x is not True:
                    parts.append(self._members(members, kind, path, test, x, within))
            elif word == "propertyNames":
                named = lambda k: self.broken(F.to_variant_object(F.array(k)), path, {"items": x}, within)  # noqa: E731, B023
                parts.append(F.when(kind == "object", F.flatten(F.transform(F.map_keys(members), lambda k: F.transform(named(k), lambda f: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.concat(F.lit("propertyNames:"), f["rule"]).alias("rule")))))).otherwise(_none()))
            elif word == "items" and isinstance(x, (dict, bool)):
                each = F.transform(items, lambda y, i: self.broken(y, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), x, within))  # noqa: B023
                parts.append(F.when(kind == "array", F.flatten(each)).otherwise(_none()))
            elif word == "allOf":
                parts += [self.broken(v, path, inner, within) for inner in x]
            elif word in ("anyOf", "oneOf", "not"):
                good = [F.size(self.broken(v, path, inner, within)) == 0 for inner in (x if word != "not" else [x])]
                n = sum((g.cast("int") for g in good), F.lit(0))
                rules.append((word, {"anyOf": n == 0, "oneOf": n != 1, "not": n > 0}[word]))
            else:
                raise ValueError(f"the schema has {word!r}: {x!r}, which isn't known here")
        if rules:
            told = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), self._one(path, name)) for name, c in rules]))
            parts.insert(0, told)
        return parts

    def _members(self, members: Column, kind: Column, path: Column, which: Callable[[Column], Column], inner: dict | bool, within: tuple[str, ...]) -> Column:
        picked = F.filter(F.map_entries(members), lambda e: which(e["key"]))
        each = F.transform(picked, lambda e: self.broken(e["value"], F.concat(path, F.lit("."), e["key"]), inner, within))
        return F.when(kind == "object", F.flatten(each)).otherwise(_none())


def schema_at(spark: SparkSession, path: str) -> dict | bool:
    """A schema document: one small JSON file, read by the driver."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def schema_violations(docs: DataFrame, schema: dict | bool, value: str = "value", formats: bool = False) -> DataFrame:
    """docs (…, value: JSON text) to a row for each violation: docs' other columns, path and rule; a text that is no JSON has the rule "json" at $."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != value]
    v = F.try_parse_json(F.col(value))
    no_json = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule")))
    found = _let(v, lambda x: F.when(x.isNull(), no_json).otherwise(Compiler(schema, formats).broken(x, F.lit("$"), schema)))
    return docs.select(*rest, F.explode(found).alias("_found")).select(*rest, "_found.path", "_found.rule")
