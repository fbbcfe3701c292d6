"""Chat formatting: tool calls linked to their results, ordered, validated and serialised.

Messages become events: a text that is a JSON object with ``tool_calls`` ([{id, name, arguments,
after}]) brings calls, one with ``tool_call_id`` and ``content`` a result, anything else is plain.  In
tables without tool calls every user turn is a call of the tool ``respond`` that follows the call
before it, and an assistant turn is a result of the last user turn before it.  Calls and results meet
in a hash join by (conversation, identifier); the calls of a conversation are ordered so that each
follows those it names in ``after``; arguments are checked against JSON schemas; and every event is
written as one line of canonical JSON: keys sorted, no spaces, UTF-8.  A conversation is its lines in
the order of ``ORDER``: messages at their turn, a call at its turn or, where it waits for a later call,
behind that, and results behind the calls of the turn they answer.  ``in_reading_order`` sorts a table so.

Linking, duplicates, asked turns and order hold over the whole conversation, however many turns it has.

Scale: repeated messages are collapsed by a pre-aggregated distinct.  Everything else is joins and
pre-aggregated group-bys by (conversation, identifier) or (conversation, turn), so neither a
conversation nor the results of a call are ever gathered; lines come from a narrow Arrow map.  The last
user turn before a turn is found within stretches of ``STRETCH`` turn numbers, of which each has at most
that many rows, and between them by one row a stretch.  Calls that name none of higher rank (turn, then
identifier) are in order as they are.  The others are put in order by islands, found in ranges of the sorted calls: the calls between one and
the last it waits for, overlapping ones together; an island's identifiers meet in one task.

Defined results: rows equal in all four columns count once; messages without a conv_id are each a
conversation of their own; null turns count as turn 0, null texts as empty; of several calls with one
identifier the first (turn, then a hash of the message, then place in it) is linked, the others carry the
error ``duplicate id``; a result without call is an orphan; in an island ready calls go by (turn, id) and
calls in a cycle, or behind one, come last and are ``cyclic``; unknown tools and unparsable arguments
are errors.  A text is not JSON, and so plain, if it holds NaN, infinities, numbers beyond double or
lone surrogates or is nested too deeply.  An ``after`` that is no list counts as a list of one (null: of
none), a call that is no object as one without fields; missing identifiers and names are empty.  Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.plans.durable import materialize

STRETCH = 1000
ORDER = ("conv", "at", "place", "step", "turn", "id", "line")
SCHEMAS = {
    "respond": {
        "type": "object",
        "required": ["prompt", "turn"],
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    }
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}
_ANNOTATIONS = {"title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment"}
_CHECKED = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern", "minItems", "maxItems",
    "uniqueItems", "items", "required", "properties", "additionalProperties", "minProperties", "maxProperties", "anyOf", "allOf", "oneOf", "not",
}


def canonical(value) -> str:
    """JSON with sorted keys, no spaces, raw Unicode; integral floats as integers; NaN is refused."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _plain(value):
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value


def _integer(digits: str) -> int:
    if len(digits) > 310:
        raise ValueError("beyond double")
    value = int(digits)
    if abs(value) > sys.float_info.max:
        raise ValueError("beyond double")
    return value


def strict_json(text: str):
    """The value of a JSON text; ValueError for whatever has no canonical form in UTF-8."""
    try:
        value = json.loads(text, parse_int=_integer)
        canonical(value).encode("utf-8")
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


def _refused(path: str, key: str, what: str) -> ValueError:
    return ValueError(f"{path}: {key} must be {what}")


def check_schema(schema, path: str = "$") -> None:
    """ValueError for what ``violations`` does not know or could fail on, so that nothing is ignored in
    silence and no message can stop a job: unknown keywords and type names, patterns that do not compile,
    steps that are not positive, bounds and lists of the wrong kind."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{path}: a schema is an object, true or false")
    unknown = {str(k) for k in schema} - _CHECKED - _ANNOTATIONS
    if unknown:
        raise ValueError(f"{path}: schema keywords not supported: {sorted(unknown)}")
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) <= sys.float_info.max
    for key, value in schema.items():
        if key == "type":
            kinds = value if isinstance(value, list) else [value]
            if not kinds or not all(isinstance(k, str) and k in _TYPES for k in kinds):
                raise _refused(path, key, f"of {sorted(_TYPES)}")
        elif key in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum") and not number(value):
            raise _refused(path, key, "a number")
        elif key == "multipleOf" and not (number(value) and value > 0):
            raise _refused(path, key, "a positive number")
        elif key[:3] in ("min", "max") and key[3:] in ("Length", "Items", "Properties") and not (number(value) and value >= 0):
            raise _refused(path, key, "a number of at least 0")
        elif key == "pattern":
            try:
                re.compile(value)
            except (re.error, TypeError, RecursionError, OverflowError):
                raise _refused(path, key, "a regular expression") from None
        elif key == "required" and not (isinstance(value, list) and all(isinstance(k, str) for k in value)):
            raise _refused(path, key, "a list of names")
        elif key in ("enum", "const"):
            if key == "enum" and not isinstance(value, list):
                raise _refused(path, key, "a list")
            try:
                canonical(value)
            except (TypeError, ValueError):
                raise _refused(path, key, "JSON") from None
        elif key == "properties":
            if not isinstance(value, dict):
                raise _refused(path, key, "an object")
            for k, inner in value.items():
                check_schema(inner, f"{path}.{k}")
        elif key in ("items", "not", "additionalProperties"):
            check_schema(value, f"{path}.{key}")
        elif key in ("anyOf", "allOf", "oneOf"):
            if not isinstance(value, list) or not value:
                raise _refused(path, key, "a list of schemas")
            for i, inner in enumerate(value):
                check_schema(inner, f"{path}.{key}[{i}]")


def _is(value, kind: str) -> bool:
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, _TYPES[kind]) or (kind == "integer" and isinstance(value, float) and value.is_integer())


def violations(value, schema, path: str = "$") -> list[str]:
    """What ``value`` breaks in the schema, in a fixed order."""
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: not allowed"]
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and canonical(value) not in {canonical(v) for v in schema["enum"]}:
        found.append(f"{path}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        found.append(f"{path}: not the constant")
    if _is(value, "number"):
        found += [f"{path}: below minimum"] * (value < schema.get("minimum", value) or ("exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]))
        found += [f"{path}: above maximum"] * (value > schema.get("maximum", value) or ("exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]))
        if "multipleOf" in schema and not _multiple(value, schema["multipleOf"]):
            found.append(f"{path}: not a multiple")
    for kind, low, high in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems"), (dict, "minProperties", "maxProperties")):
        if isinstance(value, kind):
            found += [f"{path}: too short"] * (len(value) < schema.get(low, 0)) + [f"{path}: too long"] * (len(value) > schema.get(high, len(value)))
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        found.append(f"{path}: does not match")
    if isinstance(value, list):
        if schema.get("uniqueItems") and len({canonical(v) for v in value}) < len(value):
            found.append(f"{path}: items repeat")
        if "items" in schema:
            found += [v for k, x in enumerate(value) for v in violations(x, schema["items"], f"{path}[{k}]")]
    if isinstance(value, dict):
        known, others = schema.get("properties", {}), schema.get("additionalProperties", True)
        found += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{path}.{k}")
            elif others is False:
                found.append(f"{path}.{k}: unknown")
            else:
                found += violations(value[k], others, f"{path}.{k}")
    for inner in schema.get("allOf", []):
        found += violations(value, inner, path)
    if "anyOf" in schema and all(violations(value, inner, path) for inner in schema["anyOf"]):
        found.append(f"{path}: fits none of anyOf")
    if "oneOf" in schema and sum(not violations(value, inner, path) for inner in schema["oneOf"]) != 1:
        found.append(f"{path}: does not fit exactly one of oneOf")
    if "not" in schema and not violations(value, schema["not"], path):
        found.append(f"{path}: fits what it must not")
    return found


def _multiple(value, step) -> bool:
    if isinstance(value, int) and isinstance(step, int):
        return value % step == 0
    times = value / step
    return math.isfinite(times) and abs(times - round(times)) <= 1e-9 * max(1.0, abs(times))


def ordered(calls: list[dict]) -> tuple[list[dict], int]:
    """Calls so that each follows those in its ``after``; ready ones by (turn, id); cycles last."""
    by_id = {c["id"]: c for c in reversed(calls)}
    waits = {k: {a for a in c["after"] if a in by_id and by_id[a] is not c} for k, c in enumerate(calls)}
    followers: dict[str, list[int]] = {}
    for k, needs in waits.items():
        for a in needs:
            followers.setdefault(a, []).append(k)
    rank = lambda k: (calls[k]["turn"], calls[k]["id"], k)
    ready = [rank(k) for k in waits if not waits[k]]
    heapq.heapify(ready)
    out, done = [], set()
    while ready:
        k = heapq.heappop(ready)[-1]
        out.append(calls[k])
        done.add(k)
        if by_id[calls[k]["id"]] is calls[k]:
            for f in followers.get(calls[k]["id"], ()):
                waits[f].discard(calls[k]["id"])
                if not waits[f] and f not in done:
                    heapq.heappush(ready, rank(f))
    stuck = sorted((k for k in range(len(calls)) if k not in done), key=rank)
    return out + [calls[k] for k in stuck], len(stuck)


def _parsed(text: str):
    if text.lstrip()[:1] != "{":
        return None
    try:
        value = strict_json(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _text(value) -> str:
    return value if isinstance(value, str) else canonical(value)


def _after(value) -> list[str]:
    listed = value if isinstance(value, list) else [] if value is None else [value]
    return sorted({_text(a) for a in listed})


_EVENT = {"conv": pa.string(), "turn": pa.int64(), "mid": pa.int64(), "seq": pa.int32(), "kind": pa.string(), "id": pa.string(), "name": pa.string(), "arguments": pa.string(), "after": pa.list_(pa.string()), "content": pa.string(), "role": pa.string()}


def events(messages: DataFrame) -> DataFrame:
    """One row a call, result, user turn, assistant turn or other message, as written in the texts.

    ``mid`` is a hash of the message and ``seq`` the place of a call in it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long"))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    mid = F.xxhash64(turn, role, text)
    own = F.concat(F.lit("message:"), F.hex(mid))
    rows = messages.select(F.coalesce(F.col("conv_id").cast("string"), own).alias("conv"), turn.alias("turn"), mid.alias("mid"), role.alias("role"), text.alias("text")).distinct()

    def scan(batches):
        for batch in batches:
            out = {n: [] for n in _EVENT}

            columns = [out[n].append for n in _EVENT]

            def add(r, kind, seq=0, ident=None, name=None, arguments=None, after=None, content=None, columns=columns):
                for put, value in zip(columns, (r["conv"], r["turn"], r["mid"], seq, kind, ident, name, arguments, after, content, r["role"])):
                    put(value)

            for r in batch.to_pylist():
                value = _parsed(r["text"])
                calls = value.get("tool_calls") if value else None
                if isinstance(calls, list):
                    for k, c in enumerate(calls):
                        c = c if isinstance(c, dict) else {}
                        add(r, "call", k, _text(c.get("id", "")), _text(c.get("name", "")), _text(c.get("arguments", {})), _after(c.get("after")))
                elif value and "tool_call_id" in value:
                    add(r, "result", ident=_text(value["tool_call_id"]), content=_text(value.get("content", "")))
                else:
                    add(r, f"{r['role']} turn" if r["role"] in ("user", "assistant") else "message", content=r["text"])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(list(_EVENT.items())))

    return rows.mapInArrow(scan, "conv string, turn long, mid long, seq int, kind string, id string, name string, arguments string, after array<string>, content string, role string")


def last_user_turns(found: DataFrame) -> DataFrame:
    """(conv, turn, asked): for each turn of users and assistants the last earlier turn of a user."""
    turns = found.where("kind in ('user turn', 'assistant turn')").groupBy("conv", "turn").agg(F.max(F.col("kind") == "user turn").alias("user"))
    turns = turns.withColumn("stretch", F.floor(F.col("turn") / STRETCH).cast("long"))
    turns = materialize(turns.withColumn("own", F.when(F.col("user"), F.col("turn"))), "turns")
    before = Window.partitionBy("conv", "stretch").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.groupBy("conv", "stretch").agg(F.max("own").alias("own"))
    earlier = sums.select("conv", "stretch", F.max("own").over(ahead).alias("earlier")).where("earlier is not null")
    near = turns.select("conv", "turn", "stretch", F.max("own").over(before).alias("near"))
    return near.join(earlier, ["conv", "stretch"], "left").select("conv", "turn", F.coalesce("near", "earlier").alias("asked"))


def with_plain_turns(found: DataFrame) -> DataFrame:
    """User turns as calls of ``respond`` and assistant turns as results of the last one before them."""
    met = found.join(materialize(last_user_turns(found), "asked"), ["conv", "turn"], "left")
    is_call, is_answer = F.col("kind") == "user turn", F.col("kind") == "assistant turn"
    named = lambda turn: F.concat("conv", F.lit(":"), F.col(turn).cast("string"))
    prompt = F.to_json(F.struct(F.col("content").alias("prompt"), "turn"))
    return met.select(
        "conv",
        "turn",
        "mid",
        "seq",
        F.when(is_call, "call").when(is_answer, "result").otherwise(F.col("kind")).alias("kind"),
        F.when(is_call, named("turn")).when(is_answer, named("asked")).otherwise(F.col("id")).alias("id"),
        F.when(is_call, "respond").otherwise(F.col("name")).alias("name"),
        F.when(is_call, prompt).otherwise(F.col("arguments")).alias("arguments"),
        F.when(is_call, F.filter(F.array(named("asked")), lambda a: a.isNotNull())).otherwise(F.col("after")).alias("after"),
        F.when(is_call, F.lit(None)).otherwise(F.col("content")).alias("content"),
        "role",
    )


def positions(calls: DataFrame, heads: DataFrame) -> DataFrame:
    """(conv, rank, at, place, cyclic) of the calls of conversations in which one waits for a call of
    higher rank; all others are in order by rank."""
    waits = calls.select("conv", "rank", F.explode("after").alias("id")).join(heads, ["conv", "id"]).where("head > rank")
    reach = materialize(waits.groupBy("conv", "rank").agg(F.max("head").alias("reach")), "waits")
    whole = calls.select("conv", "rank", "after").join(reach.select("conv").distinct(), "conv", "left_semi").join(reach, ["conv", "rank"], "left")
    # ranges of the sorted calls, so that no task sees a whole conversation; what a range needs of those before
    # it in its conversation comes from one row a conversation and range
    ranged = materialize(whole.repartitionByRange("conv", "rank").withColumn("range", F.spark_partition_id()), "ranged")
    along = Window.partitionBy("conv", "range").orderBy("rank")
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("conv", "range").agg(F.max("reach").alias("own"), F.count(F.lit(1)).alias("n"))
    sums = sums.select("conv", "range", F.max("own").over(earlier).alias("carried"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    near = ranged.withColumn("near", F.max("reach").over(along.rowsBetween(Window.unboundedPreceding, -1))).withColumn("nth", F.row_number().over(along))
    farthest = F.greatest("near", "carried")
    starts = near.join(sums, ["conv", "range"]).select("conv", "range", "rank", "after", (F.col("nth") + F.col("before")).alias("place"), F.coalesce(farthest < F.col("rank"), F.lit(True)).cast("long").alias("starts"))
    starts = materialize(starts, "starts")
    begun = starts.groupBy("conv", "range").agg(F.sum("starts").alias("n")).select("conv", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("islands"))
    islands = starts.withColumn("here", F.sum("starts").over(along)).join(begun, ["conv", "range"])
    islands = materialize(islands.select("conv", "rank", "after", (F.col("here") + F.col("islands")).alias("island"), "place"), "islands")
    groups = islands.groupBy("conv", "island").agg(F.sort_array(F.collect_list(F.struct("rank", "after", "place"))).alias("calls"))

    def scan(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                sequence, cyclic = ordered([{"id": c["rank"]["id"], "turn": c["rank"]["turn"], "after": c["after"] or [], **c} for c in r["calls"]])
                at, first = sequence[0]["turn"], min(c["place"] for c in sequence)
                for k, c in enumerate(sequence):
                    at = max(at, c["turn"])
                    rows.append({"conv": r["conv"], "rank": c["rank"], "at": at, "place": first + k, "cyclic": k >= len(sequence) - cyclic})
            rank = pa.struct([("turn", pa.int64()), ("id", pa.string()), ("mid", pa.int64()), ("seq", pa.int32())])
            schema = pa.schema([("conv", pa.string()), ("rank", rank), ("at", pa.int64()), ("place", pa.int64()), ("cyclic", pa.bool_())])
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return materialize(groups.mapInArrow(scan, "conv string, rank struct<turn: long, id: string, mid: long, seq: int>, at long, place long, cyclic boolean"), "positions")


def linked_events(messages: DataFrame, schemas: dict | None = None) -> DataFrame:
    """conv, at, place, step, kind, turn, id, linked, cyclic, n_results, n_errors and line of every event."""
    schemas = SCHEMAS if schemas is None else schemas
    for name, schema in schemas.items():
        check_schema(schema, name)
    found = materialize(events(messages), "found")
    every = materialize(with_plain_turns(found), "events")  # read several times below
    keys = ["conv", "id"]
    calls = every.where("kind = 'call'").withColumn("rank", F.struct("turn", "id", "mid", "seq"))
    results = every.where("kind = 'result'")
    heads = materialize(calls.groupBy(*keys).agg(F.min("rank").alias("head")), "heads")
    answers = results.where("id is not null").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_results"))
    places = positions(calls, heads)
    known = calls.join(heads, keys).join(answers, keys, "left").join(places, ["conv", "rank"], "left")
    first = F.col("rank") == F.col("head")
    at, place, cyclic = F.coalesce("at", "turn"), F.coalesce("place", F.lit(0).cast("long")), F.coalesce("cyclic", F.lit(False))
    columns = ["conv", "turn", "id", "name", "arguments", "after", "content", "role"]
    null = lambda kind: F.lit(None).cast(kind)
    shown = known.select(*columns, at.alias("at"), place.alias("place"), cyclic.alias("cyclic"), F.lit("call").alias("kind"), F.when(first, F.coalesce("n_results", F.lit(0))).otherwise(0).alias("n_results"), (~first).alias("again"))
    placed = heads.join(places.withColumnRenamed("rank", "head"), ["conv", "head"], "left")
    met = results.join(placed, keys, "left")
    linked = F.col("head").isNotNull()
    replies = met.select(*columns, F.when(linked, F.coalesce("at", F.col("head.turn"))).otherwise(F.col("turn")).alias("at"), place.alias("place"), F.lit(False).alias("cyclic"), F.when(linked, "result").otherwise("orphan").alias("kind"), null("long").alias("n_results"), F.lit(False).alias("again"))
    plain = every.where("kind = 'message'").select(*columns, F.col("turn").alias("at"), F.lit(0).cast("long").alias("place"), F.lit(False).alias("cyclic"), "kind", null("long").alias("n_results"), F.lit(False).alias("again"))
    rows = shown.unionByName(replies).unionByName(plain)

    def scan(batches):
        for batch in batches:
            made = [written(r, schemas) for r in batch.to_pylist()]
            own = [batch.column(batch.schema.get_field_index(n)) for n in ("conv", "at", "place", "kind", "turn", "id", "cyclic", "n_results")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.string())], names=["conv", "at", "place", "kind", "turn", "id", "cyclic", "n_results", "n_errors", "line"])

    lines = rows.mapInArrow(scan, "conv string, at long, place long, kind string, turn long, id string, cyclic boolean, n_results long, n_errors long, line string")
    step = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "call", 1).when(F.col("kind") == "result", 2).otherwise(3)
    is_linked = F.when(F.col("kind") == "call", F.col("n_results") > 0).otherwise(F.col("kind") == "result")
    return lines.select("conv", "at", "place", step.alias("step"), "kind", "turn", "id", is_linked.alias("linked"), "cyclic", F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), "n_errors", "line")


def written(r: dict, schemas: dict) -> tuple[int, str]:
    """(number of errors, canonical JSON) of one event."""
    if r["kind"] == "message":
        return 0, canonical({"kind": "message", "role": r["role"], "content": r["content"], "turn": r["turn"]})
    if r["kind"] != "call":
        return 0, canonical({"kind": r["kind"], "id": r["id"], "content": r["content"], "turn": r["turn"]})
    arguments, errors = r["arguments"], ["duplicate id"] if r["again"] else []
    try:
        arguments = strict_json(r["arguments"])
    except ValueError:
        errors.insert(0, "arguments: not JSON")
    if r["name"] not in schemas:
        errors.append("unknown tool")
    elif "arguments: not JSON" not in errors:
        errors += violations(arguments, schemas[r["name"]])
    return len(errors), canonical({"kind": "call", "id": r["id"], "name": r["name"], "arguments": arguments, "after": r["after"] or [], "errors": errors, "n_results": r["n_results"], "turn": r["turn"]})


def in_reading_order(lines: DataFrame, partitions: int | None = None) -> DataFrame:
    """Lines sorted by ``ORDER`` over all partitions, so that files written from them read as conversations."""
    spread = lines.repartitionByRange(*([partitions] if partitions else []), *ORDER)
    return spread.sortWithinPartitions(*ORDER)


#: The same rows in DuckDB SQL over ``conversations`` where no text is JSON and no user turn repeats.
CONVERSATIONS_SQL = """
WITH m AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS conv, turn, role, coalesce(text, '') AS text FROM conversations),
u AS (SELECT DISTINCT conv, turn FROM m WHERE role = 'user'),
a AS (SELECT m.conv, m.turn, m.role, m.text, u.turn AS asked FROM m ASOF LEFT JOIN u ON u.conv = m.conv AND m.turn > u.turn),
n AS (SELECT conv, asked AS turn, count(*) AS n FROM a WHERE role = 'assistant' AND asked IS NOT NULL GROUP BY ALL),
lines AS (
    SELECT a.conv, a.turn AS "at", 'call' AS kind, a.turn, a.conv || ':' || a.turn AS id, coalesce(n.n, 0) AS n_results, CAST(a.text = '' AS BIGINT) AS n_errors,
        '{"after":[' || coalesce('"' || a.conv || ':' || asked || '"', '') || '],"arguments":{"prompt":' || to_json(a.text)::VARCHAR || ',"turn":' || a.turn || '},"errors":['
        || CASE WHEN a.text = '' THEN '"$.prompt: too short"' ELSE '' END || '],"id":"' || a.conv || ':' || a.turn || '","kind":"call","n_results":' || coalesce(n.n, 0)
        || ',"name":"respond","turn":' || a.turn || '}' AS line
    FROM a LEFT JOIN n ON n.conv = a.conv AND n.turn = a.turn WHERE role = 'user'
    UNION ALL SELECT conv, coalesce(asked, turn), CASE WHEN asked IS NULL THEN 'orphan' ELSE 'result' END, turn, conv || ':' || asked, 0, 0,
        '{"content":' || to_json(text)::VARCHAR || ',"id":' || coalesce('"' || conv || ':' || asked || '"', 'null') || ',"kind":"' || CASE WHEN asked IS NULL THEN 'orphan' ELSE 'result' END
        || '","turn":' || turn || '}' FROM a WHERE role = 'assistant'
    UNION ALL SELECT conv, turn, 'message', turn, NULL, 0, 0,
        '{"content":' || to_json(text)::VARCHAR || ',"kind":"message","role":' || to_json(role)::VARCHAR || ',"turn":' || turn || '}' FROM a WHERE role NOT IN ('user', 'assistant'))
SELECT conv, "at", CAST(0 AS BIGINT) AS place, CAST(CASE kind WHEN 'message' THEN 0 WHEN 'call' THEN 1 WHEN 'result' THEN 2 ELSE 3 END AS INTEGER) AS step, kind, turn, id,
    CASE kind WHEN 'call' THEN n_results > 0 ELSE kind = 'result' END AS linked, false AS cyclic, n_results, n_errors, line FROM lines
"""
