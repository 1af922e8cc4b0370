"""Chat formatting with tool-call linking, with DataFrame functions alone.

A turn's text may be plain, or a JSON object: {"tool_calls": [...], "content", ...} of an assistant, or {"tool_call_id", "content", ...} of a tool. A
call is {"id", "name", "arguments", ...} or {"id", "function": {"name", "arguments", ...}, ...}; both are written in the first form, and what else a message, a call
or its function holds is kept under its own key. Calls and results are joined by (conversation, identifier), arguments are validated
against the schemas of the tools, and messages are put in topological order: a result stands behind its call, and what already
stands behind it stays. Each message is one row with its sort position and its canonical JSON (keys sorted, no
spaces), so a conversation of any length is never gathered into one task.

Position: (at, step, turn): at is the turn, or for a result that came before its call the call's turn with step 1. Equal
positions (repeated turns) are ordered by the JSON.

Defined results: role null is 'user', text null is ''; a text that isn't such an object as a whole is content, as it came: with anything behind the object, a key that
an object repeats, a number that no double holds, or calls that aren't all objects; a key "role" inside a text gives way to the turn's role; content that isn't a string keeps its JSON; of calls that share an
identifier within a conversation the first (smallest turn) is linked, the others are flagged duplicate (their identifiers); a result without a call is flagged orphan; a call without a result is unanswered, as a duplicate is; a tool without a schema accepts any
object; arguments may be an object or a string that holds one, which is read; anything else is the problem "arguments" and is written as it came (none:
{}); a number is written by its value (whole and decimal ones of up to 38 digits exactly, others as the
nearest double); repeated rows stay; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tools and their parameters: name to type and whether it is required.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculator": {"expression": ("string", True)},
    "weather": {"city": ("string", True), "days": ("integer", False), "metric": ("boolean", False)},
}

_MAP = "map<string,variant>"


def parsed(text: Column) -> Column:
    """text as a variant if all of it is one JSON value that can be written again: no repeated key, nothing behind it, no number beyond a double's range; else null.

    The parser stops behind the first value. Inside brackets and inside braces what may follow differs, so a text that is read to its end in both is one value, or several with
    commas, which the brackets count.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    inside = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    one = F.try_variant_get(listed, "$[0]", "variant")
    more = F.try_variant_get(listed, "$[1]", "variant").isNotNull() | (F.size(F.map_keys(inside.cast(_MAP))) > 1)
    infinite = F.regexp_count(F.to_json(one), F.lit("Infinity|NaN")) > F.regexp_count(text, F.lit("Infinity|NaN"))
    return F.when(listed.isNotNull() & inside.isNotNull() & ~more & ~F.coalesce(infinite, F.lit(False)), one)


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _text_of(v: Column) -> Column:
    """A name or identifier: a string as it is, another value as its JSON, nothing for null."""
    return F.when(v.isNull() | F.is_variant_null(v), None).when(_kind(v) == "STRING", v.cast("string")).otherwise(F.to_json(v))


def _without(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def quoted(c: Column) -> Column:
    """c as a JSON string: quote, backslash and control characters escaped, all else as is."""
    one = F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x")))
    return F.substring(one, F.lit(6), F.length(one) - 6)


def _typed(value: Column, kind: str) -> Column:
    """Whether a JSON value is of the kind; a string that looks like a number isn't one."""
    test = {"integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN$", "string": "^STRING$", "array": "^ARRAY", "object": "^OBJECT"}.get(kind)
    return F.lit(True) if test is None else F.schema_of_variant(value).rlike(test)


def _read(call: Column) -> Column:
    """A call (variant) with its arguments as a map, null if they are no object; raw: as they came; rest: its other keys."""
    own = call.cast(_MAP)
    inner = F.when(_kind(own["function"]).startswith("OBJECT") & own["name"].isNull() & own["arguments"].isNull(), own["function"].cast(_MAP))
    raw = F.when(inner.isNotNull(), inner["arguments"]).otherwise(own["arguments"])
    value = F.when(_kind(raw) == "STRING", parsed(raw.cast("string"))).otherwise(raw)
    object_ = F.when(_kind(value).startswith("OBJECT"), value)
    left = _without(inner, "name", "arguments")
    rest = F.when(inner.isNull(), _without(own, "id", "name", "arguments")).otherwise(_without(own, "id", "name", "arguments", "function"))
    return F.struct(
        _text_of(own["id"]).alias("id"), own["id"].alias("raw_id"), _text_of(F.when(inner.isNotNull(), inner["name"]).otherwise(own["name"])).alias("name"),
        object_.cast(_MAP).alias("arguments"), raw.alias("raw"), rest.alias("rest"), F.when(F.size(left) > 0, left).alias("function"),
    )


def problems(name: Column, args: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted problems of a call's arguments: missing:p, type:p, unknown:p."""
    known = F.lit(None).cast("array<string>")
    for tool, params in schemas.items():
        found = [
            *(F.when(~F.coalesce(F.map_contains_key(args, p), F.lit(False)), F.lit(f"missing:{p}")) for p, (_, need) in params.items() if need),
            *(F.when(F.coalesce(F.map_contains_key(args, p), F.lit(False)) & ~F.coalesce(_typed(args[p], kind), F.lit(False)), F.lit(f"type:{p}")) for p, (kind, _) in params.items()),
        ]
        names = F.array(*[F.lit(p) for p in params]) if params else F.array().cast("array<string>")
        unknown = F.transform(F.array_except(F.coalesce(F.map_keys(args), F.array().cast("array<string>")), names), lambda p: F.concat(F.lit("unknown:"), p))
        known = F.when(name == tool, F.concat(F.array_compact(F.array(*found)), unknown)).otherwise(known)
    return F.array_sort(F.coalesce(known, F.array().cast("array<string>")))


def messages(turns: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """turns (conv_id, turn, role, text): a row for each with its position, links, problems and canonical JSON."""
    text = F.coalesce(F.col("text"), F.lit(""))
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), text.alias("text"))
    may = F.col("text").rlike(r"\A\s*\{") & F.col("role").isin("assistant", "tool")
    t = t.withColumn("v", F.when(may, parsed(F.col("text"))))
    t = t.withColumn("m", F.when(_kind(F.col("v")).startswith("OBJECT"), F.col("v").cast(_MAP)))
    listed = F.when(_kind(F.col("m.tool_calls")).startswith("ARRAY"), F.col("m.tool_calls").cast("array<variant>"))
    whole = (F.size(listed) > 0) & ~F.exists(listed, lambda c: ~_kind(c).startswith("OBJECT"))
    is_call = (F.col("role") == "assistant") & F.coalesce(whole, F.lit(False))
    is_result = (F.col("role") == "tool") & F.coalesce(_text_of(F.col("m.tool_call_id")).isNotNull(), F.lit(False))
    t = t.withColumn("calls", F.when(is_call, F.transform(listed, _read))).withColumn("answers", F.when(is_result, _text_of(F.col("m.tool_call_id"))))
    said = F.col("m.content")
    t = t.withColumn("content", F.when(is_call | is_result, F.when(said.isNull() | F.is_variant_null(said), F.lit('""')).otherwise(_value(said))).otherwise(quoted(F.col("text"))))
    kept = F.when(is_call, _without(F.col("m"), "content", "role", "tool_calls")).when(is_result, _without(F.col("m"), "content", "role", "tool_call_id"))
    t = t.withColumn("rest", F.coalesce(F.to_json(_written(kept)), F.lit(""))).drop("v", "m")

    call = t.where("calls is not null").select("conv_id", "turn", F.posexplode("calls").alias("pos", "c"))
    call = call.where("c.id is not null").groupBy("conv_id", F.col("c.id").alias("id")).agg(F.min(F.struct("turn", "pos")).alias("first"))
    call = call.select(F.col("conv_id").alias("_conv"), F.col("id").alias("_id"), "first", F.col("first.turn").alias("call_turn"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("answers") == F.col("_id"))
    no_turn, no_list = F.lit(None).cast(t.schema["turn"].dataType).alias("call_turn"), F.array().cast("array<string>")
    plain = t.where("answers is null and calls is null").select("*", no_turn, no_list.alias("duplicate"), no_list.alias("unanswered"))
    results = t.where("answers is not null").join(call, same, "left").drop("_conv", "_id", "first")
    results = results.select("*", no_list.alias("duplicate"), no_list.alias("unanswered"))
    # each call of a message with the first of its identifier and whether a result has it
    answered = t.where("answers is not null").select(F.col("conv_id").alias("_of"), F.col("answers").alias("_answers")).distinct()
    calling = t.where("calls is not null").withColumn("row", F.monotonically_increasing_id())
    told = calling.select("row", F.struct(*t.columns).alias("all"), "conv_id", "turn", F.posexplode("calls").alias("pos", "c")).withColumn("id", F.col("c.id"))
    told = told.join(call, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("id") == F.col("_id")), "left")
    told = told.join(answered, F.col("conv_id").eqNullSafe(F.col("_of")) & (F.col("id") == F.col("_answers")), "left")
    later = F.col("first") < F.struct("turn", "pos")
    name = F.coalesce("id", F.lit(""))
    told = told.groupBy("row").agg(F.first("all").alias("all"), F.array_sort(F.collect_list(F.when(later, name))).alias("duplicate"), F.array_sort(F.collect_list(F.when(later | F.col("_answers").isNull(), name))).alias("unanswered"))
    calling = told.select("all.*", "duplicate", "unanswered", no_turn)
    t = plain.unionByName(results).unionByName(calling)

    late = F.col("call_turn") > F.col("turn")
    problem = F.transform("calls", lambda c: F.when(c["arguments"].isNull(), F.array(F.lit("arguments"))).otherwise(problems(c["name"], c["arguments"], schemas)))
    t = t.withColumn("problems", F.coalesce(F.flatten(problem), F.array().cast("array<string>")))

    def args(c: Column) -> Column:
        return F.coalesce(_object(_written(c["arguments"])), F.when(c["raw"].isNotNull(), _value(c["raw"])), F.lit("{}"))

    def one(c: Column) -> Column:
        own = F.array(_pair("arguments", args(c)), _pair("id", F.coalesce(F.when(~F.is_variant_null(c["raw_id"]), _value(c["raw_id"])), F.lit('""'))), _pair("name", quoted(c["name"])))
        function = F.when(c["function"].isNotNull(), F.array(_pair("function", _object(_written(c["function"])))))
        return _object(F.concat(own, F.coalesce(_written(c["rest"]), _none()), F.coalesce(function, _none())))

    answers = F.when(F.col("answers").isNotNull(), F.array(_pair("tool_call_id", quoted(F.col("answers")))))
    calls = F.when(F.col("calls").isNotNull(), F.array(_pair("tool_calls", F.concat(F.lit("["), F.array_join(F.transform("calls", one), ","), F.lit("]")))))
    rest = F.from_json("rest", "array<struct<k:string,j:string>>")
    body = _object(F.concat(F.array(_pair("content", F.col("content")), _pair("role", quoted(F.col("role")))), F.coalesce(answers, calls, _none()), F.coalesce(rest, _none())))
    return t.select(
        "conv_id", "turn", "role",
        F.coalesce(F.when(late, F.col("call_turn")), F.col("turn")).alias("at"),
        F.when(late, 1).otherwise(0).alias("step"),
        F.coalesce(F.size("calls"), F.lit(0)).alias("n_calls"),
        "call_turn",
        (F.col("answers").isNotNull() & F.col("call_turn").isNull()).alias("orphan"),
        "problems", "duplicate", "unanswered",
        body.alias("message"),
    )


def _value(v: Column) -> Column:
    """A JSON value by its own type; a variant's keys are sorted at every depth."""
    return F.when(v.isNull() | F.is_variant_null(v), F.lit("null")).when(F.schema_of_variant(v) == "STRING", quoted(v.cast("string"))).otherwise(F.to_json(v))


def _none() -> Column:
    return F.array().cast("array<struct<k:string,j:string>>")


def _pair(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("k"), value.alias("j"))


def _written(m: Column) -> Column:
    """A map's pairs (k, JSON of its value)."""
    return F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), _value(e["value"]).alias("j")))


def _object(pairs: Column) -> Column:
    """Pairs as a JSON object, sorted by key."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(quoted(p["k"]), F.lit(":"), p["j"])), ","), F.lit("}"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    m = messages(turns)
    return m.select("conv_id", "turn", "at", "step", "n_calls", "call_turn", "orphan", F.size("problems").alias("n_problems"), F.size("duplicate").alias("n_duplicate"), F.size("unanswered").alias("n_unanswered"), "message")


OP2_SQL = r"""
SELECT conv_id, turn, turn AS at, 0 AS step, 0 AS n_calls, CAST(NULL AS BIGINT) AS call_turn, false AS orphan, 0 AS n_problems, 0 AS n_duplicate, 0 AS n_unanswered,
       '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || CAST(to_json(coalesce(role, 'user')) AS VARCHAR) || '}' AS message
FROM conversations
WHERE NOT (coalesce(text, '') LIKE '{%' AND role IN ('assistant', 'tool'))
"""
