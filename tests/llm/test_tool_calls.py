import json
import random

import duckdb
import pandas as pd
import pytest

from vecloom.llm import tool_calls as C

SCHEMAS = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 0}, "tag": {"enum": ["x", "y"]}}, "additionalProperties": False}}
ANY = {"add": {"type": "object"}}


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, "after": list(f)} for i, n, a, f in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def lines(df):
    """conversation -> its lines in reading order, as (row, parsed line)."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: tuple((r[c] is not None, r[c]) for c in C.ORDER)):
        out.setdefault(r.conv, []).append((r, json.loads(r.line)))
    return out


def test_links_order_and_validation(spark):
    rows = [
        (1, 0, "system", "Be kind"),
        (1, 1, "assistant", call(("b", "add", {"tag": "x", "a": 2.0}, ["a"]), ("a", "add", {"a": 1}, []), ("c", "add", {"a": -1, "z": 0}, ["b"]), ("d", "nope", {}, ["missing"]))),
        (1, 2, "tool", result("b", {"z": 1, "y": [1.0, "é"]})),
        (1, 3, "tool", result("a", "first")),
        (1, 4, "tool", result("lost", "nobody")),
        (1, 5, "assistant", call(("a", "add", {"a": 9}, []))),
        (2, 0, "assistant", call(("p", "add", {"a": 1}, ["q"]), ("q", "add", {"a": 1}, ["p"]), ("r", "add", "not an object", []))),
        (2, 1, "assistant", '{"tool_calls": [{"id": "s", "name": "add", "arguments": "{broken"}]}'),
    ]
    out = lines(C.linked_events(frame(spark, rows), SCHEMAS))
    one = out["1"]
    assert [(x["kind"], x.get("id")) for _, x in one] == [("message", None), ("call", "a"), ("call", "b"), ("call", "c"), ("call", "d"), ("result", "b"), ("result", "a"), ("orphan", "lost"), ("call", "a")]
    by = {(x["kind"], x.get("id"), x["turn"]): (r, x) for r, x in one}
    assert by["call", "a", 1][1]["n_results"] == 1 and by["call", "a", 1][0].linked and by["result", "a", 3][1]["content"] == "first"
    assert by["result", "b", 2][1]["content"] == '{"y":[1,"é"],"z":1}' and '"arguments":{"a":2,"tag":"x"}' in by["call", "b", 1][0].line
    assert by["call", "c", 1][1]["errors"] == ["$.a: below minimum", "$.z: unknown"] and by["call", "d", 1][1]["errors"] == ["unknown tool"]
    assert by["call", "a", 5][1]["errors"] == ["duplicate id"] and by["call", "a", 5][1]["n_results"] == 0 and not by["call", "a", 5][0].linked
    assert by["orphan", "lost", 4][1]["content"] == "nobody"
    two = out["2"]
    assert [(x["id"], r.cyclic) for r, x in two] == [("p", True), ("q", True), ("r", False), ("s", False)]
    assert two[2][1]["errors"] == ["arguments: not JSON"] and two[-1][1]["errors"] == ["arguments: not JSON"]
    assert all(r.line == C.canonical(x) for conv in out.values() for r, x in conv)


def test_links_hold_over_any_number_of_turns(spark):
    rows = [(1, 998, "assistant", call(("a", "add", {}, []))), (1, 999, "assistant", call(("b", "add", {}, ["a"])))]
    rows += [(1, 1000, "tool", result("b", "yes")), (1, 70_000, "tool", result("a", "late")), (1, 90_000, "assistant", call(("a", "add", {}, [])))]
    rows += [(2, 998, "user", "one"), (2, 1000, "user", "two"), (2, 3001, "assistant", "answer"), (2, 3002, "user", "three"), (3, 5, "assistant", "unasked"), (3, -2000, "user", "early")]
    out = lines(C.linked_events(frame(spark, rows), ANY))
    got = [(x["kind"], x["id"], x["turn"], r.linked) for r, x in out["1"]]
    assert got == [("call", "a", 998, True), ("result", "a", 70_000, True), ("call", "b", 999, True), ("result", "b", 1000, True), ("call", "a", 90_000, False)]
    two = {(x["kind"], x["turn"]): x for _, x in out["2"]}
    assert two["call", 1000]["after"] == ["2:998"] and two["result", 3001]["id"] == "2:1000" and two["call", 3002]["after"] == ["2:1000"]
    assert [x["kind"] for _, x in out["3"]] == ["call", "result"] and out["3"][1][1]["id"] == "3:-2000"


def test_order_against_brute_force(spark):
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 8)
        calls = [{"id": f"c{k}", "turn": rng.randint(0, 3), "after": [f"c{rng.randrange(n)}" for _ in range(rng.randint(0, 2))]} for k in range(n)]
        calls = [c | {"after": [a for a in c["after"] if a != c["id"]]} for c in calls]
        out, stuck = C.ordered(calls)
        done, left, want = set(), list(calls), []
        while True:
            ready = sorted((c for c in left if set(c["after"]) <= done), key=lambda c: (c["turn"], c["id"]))
            if not ready:
                break
            want.append(ready[0])
            done.add(ready[0]["id"])
            left.remove(ready[0])
        assert out[: len(want)] == want and stuck == len(left)


def test_calls_follow_what_they_wait_for_and_cycles_are_marked(spark):
    rng = random.Random(4)
    rows, waits = [], {}
    for conv in range(60):
        n = rng.randint(2, 14)
        for k in range(n):
            after = [f"c{rng.randrange(n)}" for _ in range(rng.choice([0, 0, 0, 1, 2]))]
            after = [a for a in after if a != f"c{k}"]
            waits.setdefault(str(conv), {})[f"c{k}"] = set(after)
            rows.append((conv, rng.randint(0, 3500), "assistant", call((f"c{k}", "add", {}, after))))

    def cyclic(need):
        left = dict(need)
        while True:
            ready = [k for k, v in left.items() if not v & left.keys()]
            if not ready:
                return set(left)
            for k in ready:
                del left[k]

    def in_cycle(need, k):
        seen, todo = set(), list(need[k])
        while todo:
            x = todo.pop()
            if x == k:
                return True
            if x not in seen:
                seen.add(x)
                todo += need[x]
        return False

    stuck = 0
    for conv, found in lines(C.linked_events(frame(spark, rows), ANY)).items():
        order = [x["id"] for _, x in found]
        marked = {x["id"] for r, x in found if r.cyclic}
        need = waits[conv]
        assert sorted(order) == sorted(need) and marked <= cyclic(need) and {k for k in need if in_cycle(need, k)} <= marked
        assert [r.at for r, _ in found] == sorted(r.at for r, _ in found)
        for k, at in ((k, order.index(k)) for k in order if k not in marked):
            assert all(order.index(a) < at for a in need[k])
        stuck += len(marked)
    assert stuck


def test_plain_turns_match_the_sql(spark):
    rng = random.Random(3)
    rows = [(c, t * rng.choice([1, 700]), rng.choice(["user", "assistant", "system"]), rng.choice(["Hé \"x\"\n", "", "a/b\\c", "plain"])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows = list({(r[0], r[1]): r for r in rows}.values())
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]))
    got = con.execute(C.CONVERSATIONS_SQL)
    names = [c[0] for c in got.description]
    out = C.linked_events(frame(spark, rows))
    assert sorted(names) == sorted(out.columns)
    assert sorted(map(repr, got.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in out.collect())


def test_nulls_repeats_and_empty(spark):
    rows = [(None, 0, "user", "x"), (None, 0, "user", "y"), (3, None, None, None), (4, 0, "user", "q"), (4, 0, "user", "q"), (4, 1, "assistant", "r"), (6, 0, "user", "word " * 50_000)]
    df = frame(spark, rows).selectExpr("*", "1 as at", "'z' as kind")
    out = lines(C.linked_events(df))
    assert len(out) == 5 and [x["kind"] for _, x in out["4"]] == ["call", "result"] and out["4"][0][1]["n_results"] == 1
    assert out["3"][0][1] == {"kind": "message", "role": "", "content": "", "turn": 0} and len(out["6"][0][0].line) > 250_000
    assert C.linked_events(frame(spark, [])).collect() == []


MALFORMED = [
    '{"tool_calls": [{"id": "n", "name": "add", "arguments": {"a": NaN}}]}', '{"tool_calls": [{"id": 1e400, "name": "add"}]}', '{"tool_calls": [{"id": "\\ud800", "name": "add"}]}',
    '{"tool_call_id": "\\ud800", "content": "x"}', '{"a":' * 100_000 + "1" + "}" * 100_000, '{"tool_calls": ' + "[" * 50_000 + "]" * 50_000 + "}", "{", '{"tool_calls": [',
    '{"tool_call_id": "x", "content": Infinity}', '{"tool_calls": [{"id": ' + "9" * 5000 + "}]}",
]
ODD = [
    ('{"tool_calls": [{"id": "a", "name": "add", "after": 5}]}', ("a", ["5"])), ('{"tool_calls": [{"id": "a", "name": "add", "after": "c1"}]}', ("a", ["c1"])),
    ('{"tool_calls": [{"id": "a", "name": "add", "after": null}]}', ("a", [])), ('{"tool_calls": [{"id": "a", "after": {"x": 1.0}}]}', ("a", ['{"x":1}'])),
    ('{"tool_calls": [7]}', ("", [])), ('{"tool_calls": [{"id": null, "name": ["n"]}]}', ("null", [])),
    ('{"tool_calls": [{"id": "a", "name": "add", "arguments": "{\\"a\\": NaN}"}]}', ("a", [])), ('{"tool_calls": [{"id": "a", "name": "add", "arguments": "\\"\\\\ud800\\""}]}', ("a", [])),
]


def test_malformed_messages_have_a_defined_result(spark):
    rows = [(k, 0, "tool", t) for k, t in enumerate(MALFORMED)] + [(100 + k, 0, "tool", t) for k, (t, _) in enumerate(ODD)]
    out = lines(C.linked_events(frame(spark, rows), ANY))
    for k, text in enumerate(MALFORMED):
        assert out[str(k)][0][1] == {"kind": "message", "role": "tool", "content": text, "turn": 0}
    for k, (_, (i, after)) in enumerate(ODD):
        (row, x), = out[str(100 + k)]
        assert (x["kind"], x["id"], x["after"]) == ("call", i, after)
    assert out[str(100 + len(ODD) - 1)][0][1]["errors"] == ["arguments: not JSON"] == out[str(100 + len(ODD) - 2)][0][1]["errors"]


def test_one_conversation_and_one_call_with_most_rows(spark):
    rows = [(1, 7, "assistant", call(("hot", "add", {}, [])))] + [(1, 7, "tool", result("hot", f"r{k}")) for k in range(3000)]
    rows += [(1, 7, "user", f"u{k}") for k in range(500)] + [(1, 8, "assistant", f"a{k}") for k in range(500)]
    df = C.linked_events(frame(spark, rows), ANY | C.SCHEMAS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    found = lines(df)["1"]
    hot = next(x for _, x in found if x["id"] == "hot" and x["kind"] == "call")
    assert hot["n_results"] == 3000 and sum(x["kind"] == "result" and x["id"] == "hot" for _, x in found) == 3000
    asked = [x for _, x in found if x["kind"] == "call" and x["id"] == "1:7"]
    assert len(asked) == 500 and sum(x["errors"] == ["duplicate id"] for x in asked) == 499 and sum(x["n_results"] for x in asked) == 500
    assert C.in_reading_order(df, 4).count() == len(found)


@pytest.mark.parametrize("value,schema,n", [
    (True, {"type": "integer"}, 1), (2.0, {"type": "integer"}, 0), ([1, "a"], {"type": "array", "items": {"type": "number"}, "minItems": 3}, 2),
    ("abc", {"maxLength": 2}, 1), (None, {"type": ["null", "string"]}, 0), (5, {"maximum": 4}, 1), ({"a": {"b": 1}}, {"properties": {"a": {"required": ["c"]}}}, 1),
    (True, {"enum": [1]}, 1), (1.0, {"const": 1}, 0), (2, {"const": 1}, 1), ("ab", {"pattern": "^b"}, 1), (5, {"anyOf": [{"type": "string"}, {"minimum": 6}]}, 1), (5, {"oneOf": [{"minimum": 1}, {"minimum": 2}]}, 1),
    (5, {"not": {"type": "integer"}}, 1), ([1, 1.0], {"uniqueItems": True}, 1), (0.3, {"multipleOf": 0.1}, 0), (7, {"multipleOf": 2}, 1), (3, {"exclusiveMinimum": 3, "exclusiveMaximum": 4}, 1),
    ({"x": 1}, {"additionalProperties": {"type": "string"}}, 1), ({}, {"minProperties": 1}, 1), (1, {"allOf": [{"minimum": 2}, {"maximum": 0}]}, 2), (1, False, 1),
])
def test_schema_rules(value, schema, n):
    C.check_schema(schema)
    assert len(C.violations(value, schema)) == n


def test_unknown_schema_keywords_are_refused(spark):
    for schema in ({"format": "email"}, {"properties": {"a": {"$ref": "#/x"}}}, {"anyOf": [{"if": {}}]}):
        with pytest.raises(ValueError):
            C.linked_events(frame(spark, []), {"t": schema})


def test_numbers_beyond_double_make_a_text_plain(spark):
    import json

    from vecloom.llm import tool_calls as T

    huge = "9" * 401
    message = '{"tool_calls":[{"id":"a","name":"f","arguments":{"x":' + huge + "}}]}"
    inner = json.dumps({"tool_calls": [{"id": "b", "name": "f", "arguments": '{"x":' + huge + "}"}]})
    fine = json.dumps({"tool_calls": [{"id": "c", "name": "f", "arguments": {"x": 10**300}}]})
    rows = [("k", 0, "assistant", message), ("k", 1, "assistant", inner), ("k", 2, "assistant", fine)]
    schema = {"f": {"type": "object", "properties": {"x": {"multipleOf": 0.5, "maximum": 1e308}}}}
    out = {r.turn: r for r in T.linked_events(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"), schema).collect()}
    assert out[0].kind != "call" and out[1].n_errors == 1 and "not JSON" in out[1].line
    assert out[2].kind == "call" and out[2].n_errors == 0
    for text in (huge, "-" + huge, "1e999", "[" * 5000):
        try:
            T.strict_json(text)
            raise AssertionError(text[:9])
        except ValueError:
            pass


def test_schemas_that_workers_could_fail_on_are_refused():
    import pytest

    from vecloom.llm import tool_calls as T

    for bad in (
        {"type": "strin"}, {"type": []}, {"type": [1]}, {"pattern": "("}, {"pattern": 5}, {"multipleOf": 0}, {"multipleOf": -1}, {"multipleOf": "2"}, {"minimum": "1"}, {"maximum": True},
        {"minLength": "x"}, {"maxItems": -1}, {"required": "a"}, {"required": [1]}, {"enum": 5}, {"enum": [float("nan")]}, {"properties": []}, {"properties": {"a": 5}}, {"items": [1]},
        {"anyOf": []}, {"oneOf": {}}, {"allOf": [None]}, {"not": "x"}, {"$ref": "#"}, [], "object", None,
    ):
        with pytest.raises(ValueError):
            T.check_schema(bad)
    T.check_schema({"type": ["string", "null"], "pattern": "^a+$", "multipleOf": 0.5, "anyOf": [True, {"minLength": 0}], "enum": [None, {"a": [1]}], "required": ["a"]})


def test_one_wait_in_a_long_conversation_is_spread_over_tasks(spark):
    import json

    from pyspark.sql import functions as F

    from vecloom.llm import tool_calls as T

    n = 20_000
    call = F.concat(F.lit('{"tool_calls":[{"id":"c'), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit('","name":"f","arguments":{}'), F.when(F.col("id") == 5, F.lit(',"after":["c015000"]')).when(F.col("id") == 9000, F.lit(',"after":["c000001","c009500"]')).otherwise(F.lit("")), F.lit("}]}"))
    messages = spark.range(n).select(F.lit("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), call.alias("text"))
    every = T.with_plain_turns(T.events(messages))
    calls = every.where("kind = 'call'").withColumn("rank", F.struct("turn", "id", "mid", "seq"))
    heads = calls.groupBy("conv", "id").agg(F.min("rank").alias("head"))
    places = T.positions(calls, heads)
    assert places.count() == n and places.select("place").distinct().count() == n
    order = {r["rank"]["turn"]: r.place for r in places.collect()}
    plain, _ = T.ordered([{"id": f"c{i:06d}", "turn": i, "after": {5: ["c015000"], 9000: ["c000001", "c009500"]}.get(i, [])} for i in range(n)])
    assert [c["turn"] for c in plain] == sorted(order, key=order.get)
    lines = T.linked_events(messages.where("turn < 3000"), {"f": {}})
    assert lines.count() == 3000 and all(json.loads(r.line)["errors"] == [] for r in lines.limit(50).collect())
