import json
import random

import pytest

from driftlab.llm import chat as C

ROWS = "conv_id long, turn long, role string, text string, node string, content int"
SCHEMA = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 0}, "s": {"enum": ["a", "b"]}, "x": {}}, "required": ["n"], "additionalProperties": False}


def call(i, name="f", **a):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": a}) + "</tool_call>"


def result(i, content="ok"):
    return json.dumps({"tool_call_id": i, "content": content})


def test_schema_subset():
    ok = lambda x, s: C.fits(x, s)
    assert ok({"n": 1, "s": "a"}, SCHEMA) and not ok({"n": -1}, SCHEMA) and not ok({"n": True}, SCHEMA) and not ok({}, SCHEMA)
    assert not ok({"n": 1, "z": 0}, SCHEMA) and not ok({"n": 1, "s": "c"}, SCHEMA) and ok({"n": 2.0}, SCHEMA)
    assert ok([1, "a"], {"type": "array", "items": {"type": ["number", "string"]}, "maxItems": 2}) and not ok([None], {"items": {"type": "string"}})


@pytest.fixture(scope="module")
def got(spark):
    rows = [
        (1, 0, "system", '<tools>[{"name":"f","parameters":%s}]</tools> hi' % json.dumps(SCHEMA)),
        (1, 1, "user", 'Grüße "x" \\ / \n\t\u0001'),
        (1, 2, "assistant", "let me " + call("b", n=1) + call("a", n=-1) + "<tool_call>{oops</tool_call>"),
        (1, 3, "tool", result("b", {"z": 1, "a": [1, 2]})),
        (1, 4, "assistant", call("b", n=2) + call("c", "g", n=1)),
        (1, 5, "tool", result("nobody")),
        (1, 6, "tool", "junk"),
        # a result before its call, and a call before the result it uses
        (2, 0, "tool", result("p")),
        (2, 1, "assistant", call("q", x={"$result": "p"}, n=1)),
        (2, 2, "tool", result("q")),
        (2, 3, "assistant", call("p", n=1)),
        (2, 4, "user", "after"),
        # a cycle
        (3, 0, "assistant", call("u", x={"$result": "v"}) + call("v", x={"$result": "u"})),
        (3, 1, "tool", result("u")),
        (3, 2, "tool", result("v")),
        (None, None, None, None),
        (None, 1, "tool", result("b")),
        (4, None, "user", ""),
        (4, 1, "assistant", "w " * 60_000),
        (4, 1, "assistant", "w " * 60_000),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], ROWS)
    return rows, C.format_chats(df, {"g": {"type": "object"}}).collect(), df


def test_links_validation_and_problems(got):
    rows, out, _ = got
    assert len(out) == len(rows)
    by = {(r.conv_id, r.turn): r for r in out}
    a = by[1, 2]
    assert (a.n_calls, a.n_linked, a.n_valid, a.problems) == (3, 1, 1, "bad_call,invalid_arguments,no_result")
    assert json.loads(a.json) == {"content": "let me", "role": "assistant", "tool_calls": [{"arguments": {"n": 1}, "id": "b", "name": "f"}, {"arguments": {"n": -1}, "id": "a", "name": "f"}, {"raw": "{oops"}]}
    assert by[1, 3].json == '{"content":{"a":[1,2],"z":1},"role":"tool","tool_call_id":"b"}'
    assert (by[1, 4].n_linked, by[1, 4].n_valid, by[1, 4].problems) == (0, 2, "duplicate_id,no_result")
    assert by[1, 5].problems == "orphan_result" and by[1, 6].problems == "bad_result"
    assert by[None, None].json == '{"content":null,"role":null}' and by[None, 1].problems == "orphan_result"
    for r in out:
        assert r.json == C.canonical(json.loads(r.json))


def test_topological_order(got):
    _, out, _ = got
    order = [(r.turn) for r in out if r.conv_id == 2]
    assert order == [3, 0, 1, 2, 4]  # p's call, its result, the call that uses it, its result; then what stood behind
    assert {r.problems for r in out if r.conv_id == 3} == {"cycle,unknown_tool", "cycle"}
    assert [r.turn for r in out if r.conv_id == 1] == list(range(7))


def test_random_orders_match_brute_force(spark):
    r = random.Random(9)
    rows = []
    for conv in range(30):
        ids = [f"i{k}" for k in range(r.randint(1, 6))]
        msgs = []
        for k, i in enumerate(ids):
            use = {"x": {"$result": r.choice(ids[:k])}} if k and r.random() < 0.7 else {}
            msgs += [("assistant", call(i, **use)), ("tool", result(i))]
        r.shuffle(msgs)
        rows += [(conv, t, *m, "", 0) for t, m in enumerate(msgs)]
    out = C.format_chats(spark.createDataFrame(rows, ROWS)).collect()
    for conv in range(30):
        own = [x for x in out if x.conv_id == conv]
        done, want = {}, {}
        calls = {json.loads(x.json)["tool_calls"][0]["id"]: x for x in own if x.n_calls}
        results = {json.loads(x.json)["tool_call_id"]: x for x in own if x.role == "tool"}
        pre = {x.turn: [] for x in own}
        for i, x in results.items():
            pre[x.turn].append(calls[i].turn)
        for i, x in calls.items():
            ref = json.loads(x.json)["tool_calls"][0]["arguments"].get("x")
            if ref:
                pre[x.turn].append(results[ref["$result"]].turn)

        def at(t):
            if t not in want:
                top = max([at(p) for p in pre[t]], default=(-1, 0))
                want[t] = (top[0], top[1] + 1) if top[0] >= t else (t, 0)
            return want[t]

        torn = any(p >= t for t, ps in pre.items() for p in ps)
        for x in own:
            assert (x.order_turn, x.order_level) == (at(x.turn) if torn else (x.turn, 0))
            assert not x.problems or x.problems == "unknown_tool"
        for x in own:
            done[x.turn] = True
            assert all(p in done for p in pre[x.turn])


def test_empty(got):
    assert C.format_chats(got[2].limit(0)).count() == 0


HOSTILE = [r'"\ud83d"', r'{"\udc00": 1}', "[" * 200_000, '{"a":' * 5_000 + "1" + "}" * 5_000, "1" + "0" * 400, "1" * 5_000, "NaN", "-Infinity", "1e999", '"\\u0000"', "{}", "null", "[1,", '"x"', "{" + '"k":1,' * 2_000 + '"z":2}']
SCHEMAS = ['{"properties":{"n":{"type":"integer"}}}', '{"minimum":"1"}', '{"properties":[1]}', '{"enum":3}', '{"type":[{}]}', '{"required":"n"}', '{"items":4}', '{"maxItems":null}', "null", "[]", '{"properties":{"n":{"additionalProperties":7}}}', '{"properties":{"n":{"type":"integer","maximum":1}}}']


def test_nothing_hostile_raises(spark):
    rows, r = [], random.Random(4)
    for i, x in enumerate(HOSTILE):
        for j, s in enumerate(SCHEMAS):
            rows += [(100 * i + j, 0, "system", '<tools>[{"name":"f","parameters":%s}]</tools>' % s), (100 * i + j, 1, "assistant", '<tool_call>{"id":"a","name":"f","arguments":{"n":%s}}</tool_call>' % x), (100 * i + j, 2, "tool", '{"tool_call_id":"a","content":%s}' % x)]
    whole = call("i", n=1, x={"$result": "k"}) + result("i") + "<tools>[]</tools>"
    for k in range(300):
        t = list(whole)
        for _ in range(r.randint(1, 6)):
            t[r.randrange(len(t))] = r.choice('{}[]",:\\u$0dé<>')
        rows.append((90_000 + k, 0, r.choice(("assistant", "tool", "system")), "".join(t)))
    out = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(rows)
    for x in out:
        json.loads(x.json, parse_constant=lambda c: pytest.fail(c))
    by = {(x.conv_id, x.turn): x for x in out}
    assert by[0, 1].problems == "invalid_arguments" and by[0, 1].n_linked == 1  # a lone surrogate is a string
    assert "bad_call" in by[200, 1].problems and "bad_result" in by[200, 2].problems  # nested too deeply
    assert by[400, 1].problems == "" and by[400 + 1, 1].problems == "bad_schema"  # 10**400 is an integer
    assert "bad_call" in by[600, 1].problems and "bad_call" in by[800, 1].problems  # NaN, 1e999
    assert "\ufffd" in by[0, 1].json
