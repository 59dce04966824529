import json
import random

from sieveline.llm import chat

MESSAGES = "conv_id bigint, turn bigint, role string, text string, place string"


def call(*calls, content=None):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, **more} for i, n, a, more in calls], "content": content})


def answer(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def run(spark, rows):
    found = chat.format_chat(spark.createDataFrame([(*r, "clash") for r in rows], MESSAGES)).collect()
    return {(r.conv_id, r.turn, r.role): r for r in found}, found


def test_links_order_and_json(spark):
    rows = [
        (1, 0, "user", 'say "hi"\n'),
        (1, 1, "tool", answer("a", {"z": 1, "b": [True, None]})),
        (1, 2, "assistant", call(("a", "search", {"query": "x", "limit": 3}, {}), content="ok")),
        (1, 3, "assistant", call(("b", "calculator", {"expression": "1+1"}, {"after": ["c"]}))),
        (1, 4, "assistant", call(("c", "weather", {"city": "Y"}, {}))),
        (2, 0, "tool", answer("a", "nobody asked")),
        (2, 1, "assistant", "{broken"),
        (2, 2, "assistant", None),
    ]
    by, found = run(spark, rows)
    assert len(found) == len(rows)
    assert json.loads(by[1, 0, "user"].json) == {"content": 'say "hi"\n', "role": "user"}
    tool = by[1, 1, "tool"]
    assert (tool.place_turn, tool.place_step, tool.status) == (2, 1, "linked")
    assert tool.json == '{"content":{"b":[true,null],"z":1},"role":"tool","tool_call_id":"a"}'
    asked = by[1, 2, "assistant"]
    assert (asked.n_calls, asked.n_invalid, asked.n_answered) == (1, 0, 1)
    assert asked.json == '{"content":"ok","role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search"}]}'
    later = by[1, 3, "assistant"]
    assert (later.place_turn, later.place_step) == (4, 1)
    assert by[2, 0, "tool"].status == "orphan"
    assert by[2, 1, "assistant"].status == by[2, 2, "assistant"].status == "plain"
    assert by[2, 2, "assistant"].json == '{"content":null,"role":"assistant"}'


def test_arguments(spark):
    cases = [
        ({"query": "x"}, 0), ({"query": "x", "limit": 2}, 0), ({"query": 5}, 1), ({}, 1), ({"query": "x", "limit": "2"}, 1),
        ({"query": "x", "limit": None}, 0), ({"query": None}, 1), ({"query": "x", "other": 1}, 1), ([], 1), ("text", 1), (None, 1), ({"query": "x", "limit": 1.5}, 1),
    ]
    rows = [(i, 0, "assistant", call(("id", "search", a, {}))) for i, (a, _) in enumerate(cases)]
    rows.append((100, 0, "assistant", call(("id", "no such tool", {}, {}), ("id2", "weather", {"city": "X"}, {}))))
    by, _ = run(spark, rows)
    for i, (a, bad) in enumerate(cases):
        assert by[i, 0, "assistant"].n_invalid == bad, a
    assert by[100, 0, "assistant"].n_invalid == 1


def test_repeats_cycles_nulls_and_empty(spark):
    rows = [
        (1, 0, "assistant", call(("a", "weather", {"city": "X"}, {}))),
        (1, 1, "assistant", call(("a", "weather", {"city": "Y"}, {}))),
        (1, 2, "tool", answer("a", 1)),
        (1, 3, "tool", answer("a", 2)),
        (2, 0, "assistant", call(("p", "weather", {"city": "X"}, {"after": ["q"]}))),
        (2, 1, "assistant", call(("q", "weather", {"city": "X"}, {"after": ["p"]}))),
        (None, None, None, None),
        (None, None, None, None),
    ]
    by, found = run(spark, rows)
    assert len(found) == len(rows)
    assert [by[1, t, r].status for t, r in ((0, "assistant"), (1, "assistant"), (2, "tool"), (3, "tool"))] == ["linked", "repeated", "linked", "repeated"]
    assert {by[2, 0, "assistant"].status, by[2, 1, "assistant"].status} == {"unordered"}
    assert run(spark, [])[1] == []


def test_no_call_is_lost(spark):
    """Calls without identifier, of the function shape, and of no use."""
    shaped = {"id": "a", "type": "function", "function": {"name": "search", "arguments": '{"query":"x","limit":2}'}}
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": [{"name": "weather", "arguments": {"city": "X"}}, {"id": "b", "name": "weather", "arguments": {}}]})),
        (1, 1, "assistant", json.dumps({"tool_calls": [shaped]})),
        (1, 2, "tool", answer("a", "found")),
        (1, 3, "assistant", json.dumps({"tool_calls": ["x", {"id": "c"}]})),
        (1, 4, "assistant", json.dumps({"tool_calls": []})),
        (1, 5, "assistant", call(("d", "search", "{broken", {}))),
    ]
    by, _ = run(spark, rows)
    two = by[1, 0, "assistant"]
    assert (two.n_calls, two.n_invalid, two.status) == (2, 1, "unnamed")
    assert json.loads(two.json)["tool_calls"] == [{"arguments": {"city": "X"}, "id": None, "name": "weather"}, {"arguments": {}, "id": "b", "name": "weather"}]
    asked = by[1, 1, "assistant"]
    assert (asked.n_calls, asked.n_invalid, asked.n_answered, asked.status) == (1, 0, 1, "linked")
    assert asked.json == '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"limit":2,"query":"x"},"id":"a","name":"search"}]}'
    assert by[1, 3, "assistant"].status == by[1, 4, "assistant"].status == "plain"
    assert json.loads(by[1, 3, "assistant"].json)["content"] == rows[3][3]
    assert (by[1, 5, "assistant"].n_invalid, by[1, 5, "assistant"].status) == (1, "unanswered")


def test_nested_arguments(spark):
    cases = [
        ({"query": "x", "filters": {"language": "en"}}, 0), ({"query": "x", "filters": {}}, 1), ({"query": "x", "filters": None}, 0), ({"query": "x", "filters": "en"}, 1),
        ({"query": "x", "filters": {"language": "en", "sites": ["a", "b"]}}, 0), ({"query": "x", "filters": {"language": "en", "sites": ["a", 2]}}, 1),
        ({"query": "x", "filters": {"language": "en", "more": 1}}, 1), ({"query": "x", "filters": {"language": "en", "sites": []}}, 0),
    ]
    rows = [(i, 0, "assistant", call(("id", "search", a, {}))) for i, (a, _) in enumerate(cases)]
    rows += [(100, 0, "assistant", call(("id", "weather", {"city": "X", "unit": "celsius"}, {}))), (101, 0, "assistant", call(("id", "weather", {"city": "X", "unit": "kelvin"}, {})))]
    by, _ = run(spark, rows)
    for i, (a, bad) in enumerate(cases):
        assert by[i, 0, "assistant"].n_invalid == bad, a
    assert (by[100, 0, "assistant"].n_invalid, by[101, 0, "assistant"].n_invalid) == (0, 1)


def test_long_chain_null_conversation_and_long_text(spark):
    """A chain of 150 calls, each after the next turn's; a conversation without
    a name; a text of a megabyte."""
    n = 150
    rows = [(1, t, "assistant", call((f"c{t}", "weather", {"city": "X"}, {"after": [f"c{t + 1}"]} if t < n - 1 else {}))) for t in range(n)]
    rows += [(None, 0, "assistant", call(("a", "weather", {"city": "X"}, {}))), (None, 1, "tool", answer("a", 1)), (2, 0, "user", "long " * 200_000)]
    by, _ = run(spark, rows)
    assert all((by[1, t, "assistant"].place_turn, by[1, t, "assistant"].place_step) == (n - 1, n - 1 - t) for t in range(n))
    assert (by[None, 0, "assistant"].status, by[None, 0, "assistant"].n_answered, by[None, 1, "tool"].status) == ("linked", 1, "linked")
    assert json.loads(by[2, 0, "user"].json)["content"] == rows[-1][3]


def plain_format(rows):
    """Places and statuses of one conversation's calls (with one call a turn)
    and results, straight from the definition."""
    calls, results = {}, {}
    for turn, kind, name, _ in rows:
        (calls if kind == "call" else results).setdefault(name, turn)
    before = {turn: set() for turn, *_ in rows}
    for turn, kind, name, after in rows:
        if kind == "call":
            before[turn] |= {calls[a] for a in after if a in calls and calls[a] != turn}
        elif results[name] == turn and name in calls:
            before[turn].add(calls[name])
    place = {}
    while ready := [t for t in before if t not in place and all(b in place for b in before[t])]:
        for t in ready:
            place[t] = max([(t, 0), *((place[b][0], place[b][1] + 1) for b in before[t])])
    out = {}
    for turn, kind, name, _ in rows:
        mine, other = (calls, results) if kind == "call" else (results, calls)
        if turn not in place:
            why = "unordered"
        elif mine[name] != turn:
            why = "repeated"
        elif name not in other:
            why = "unanswered" if kind == "call" else "orphan"
        else:
            why = "linked"
        out[turn] = (*place.get(turn, (turn, 0)), why)
    return out


def test_random_conversations(spark):
    r = random.Random(4)
    rows, want = [], {}
    for conv in range(60):
        names = [f"n{i}" for i in range(r.randint(1, 9))]
        made = []
        for turn in range(r.randint(1, 18)):
            name = r.choice(names)
            if r.random() < 0.6:
                made.append((turn, "call", name, r.choices(names, k=r.choice([0, 0, 1, 2, 3]))))
            else:
                made.append((turn, "result", name, []))
        for turn, kind, name, after in made:
            rows.append((conv, turn, "assistant" if kind == "call" else "tool", call((name, "weather", {"city": "X"}, {"after": after})) if kind == "call" else answer(name, turn)))
        want |= {(conv, turn): found for turn, found in plain_format(made).items()}
    r.shuffle(rows)
    _, found = run(spark, rows)
    assert {(x.conv_id, x.turn): (x.place_turn, x.place_step, x.status) for x in found} == want
    assert len({x[2] for x in want.values()}) == 5
