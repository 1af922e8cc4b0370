"""Whatever a turn holds is in its message: against json, key by key."""

import json
import random

from newsloom.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string"


def _messages(spark, rows):
    return {(x.conv_id, x.turn): x for x in chat_format.messages(spark.createDataFrame(rows, SCHEMA)).collect()}


def _canonical(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_unknown_keys_and_both_forms_of_a_call_are_kept(spark):
    rows = [
        (1, 0, "assistant", {"content": None, "reasoning": {"b": 1, "a": ["x"]}, "role": "other", "tool_calls": [
            {"id": "a", "type": "function", "function": {"name": "search", "arguments": "{\"query\":\"q\"}", "strict": True}, "index": 0},
            {"id": 7, "name": "search", "arguments": {"query": "q"}, "function": "kept", "note": None}]}),
        (1, 1, "tool", {"tool_call_id": "a", "content": [{"type": "text", "text": "r"}], "is_error": True, "name": "search", "zz": 1.5}),
    ]
    got = _messages(spark, [(*r[:3], json.dumps(r[3])) for r in rows])
    assert got[1, 0].message == _canonical({"content": "", "reasoning": {"a": ["x"], "b": 1}, "role": "assistant", "tool_calls": [
        {"arguments": {"query": "q"}, "function": {"strict": True}, "id": "a", "index": 0, "name": "search", "type": "function"},
        {"arguments": {"query": "q"}, "function": "kept", "id": 7, "name": "search", "note": None}]})
    assert got[1, 0].problems == [] and got[1, 0].unanswered == ["7"]
    assert got[1, 1].message == _canonical({"content": [{"text": "r", "type": "text"}], "is_error": True, "name": "search", "role": "tool", "tool_call_id": "a", "zz": 1.5}) and got[1, 1].call_turn == 0


def test_what_is_not_one_object_stays_as_it_came(spark):
    call = '{"tool_calls":[{"id":"a","name":"n","arguments":{}}]}'
    texts = [
        f"{call} trailing", f"{call},{call}", f"{call}],[", f"{call}}},{{\"y\":{{}}", f"{call}}}", f"{call}]", call[:-1], '{"tool_calls":[{"id":"a","name":"n","arguments":{"x":1e400}}]}',
        '{"tool_calls":[{"id":"a","name":"n","arguments":{"x":1,"x":2}}]}', '{"tool_calls":["a"]}', '{"tool_calls":[]}', '{"tool_calls":{"id":"a"}}', '{"content":"x"}', "{}", "{", '{"tool_calls":[null]}',
    ]
    got = _messages(spark, [(1, i, "assistant", t) for i, t in enumerate(texts)])
    for i, t in enumerate(texts):
        assert json.loads(got[1, i].message) == {"content": t, "role": "assistant"}, t
    got = _messages(spark, [(1, 0, "assistant", f" \n{call}\t"), (1, 1, "user", call), (1, 2, "assistant", call.replace("{}", '{"x":"Infinity","y":-0.5e3}'))])
    assert got[1, 0].n_calls == 1 and json.loads(got[1, 1].message)["content"] == call and json.loads(got[1, 2].message)["tool_calls"][0]["arguments"] == {"x": "Infinity", "y": -500.0}


def test_round_trip_of_made_messages(spark):
    r = random.Random(21)
    keys = ["content", "reasoning", "is_error", "é", "a b", "z", "Name", "metadata"]

    def value(depth):
        kind = r.randrange(9 if depth < 3 else 6)
        if kind > 6:
            return {r.choice(["b", "a", "é", "0", "A"]): value(depth + 1) for _ in range(r.randrange(4))}
        if kind == 6:
            return [value(depth + 1) for _ in range(r.randrange(4))]
        return r.choice([None, True, 0, -7, 2**60, 1.25, "", "12", "{x}", 'q"\\', "a\nb", "日🙂", "NaN"])

    made = []
    for i in range(150):
        m = {k: value(0) for k in r.sample(keys, r.randrange(5))}
        if i % 2:
            m["tool_call_id"] = f"c{i}"
        else:
            m["tool_calls"] = [{"id": f"c{i}", "name": "n", "arguments": {k: value(1) for k in r.sample(keys, 2)}, **{k: value(1) for k in r.sample(["type", "x", "index"], r.randrange(3))}} for _ in range(r.randint(1, 3))]
        made.append(m)
    got = _messages(spark, [(1, i, "tool" if i % 2 else "assistant", json.dumps(m, ensure_ascii=i % 3 == 0)) for i, m in enumerate(made)])
    for i, m in enumerate(made):
        want = m | {"role": "tool" if i % 2 else "assistant", "content": "" if m.get("content") is None else m["content"]}
        assert got[1, i].message == _canonical(want)
