"""Chat formatting with tool calls: link calls to results, order them, check arguments, write canonical JSON.

1. A conversation's turns meet in one shuffle, which carries each text once. Turns that hold {"tool_calls": [...]} or
   {"tool_call_id": ..., "content": ...} as JSON are calls and results under their own identifiers; every other turn that isn't the
   assistant's calls `respond` with what it says and needs the call two turns before, and an assistant's turn is the result of the
   turn before it. The identifiers of plain turns ("turn:3") are apart from those of tool calls, whatever those are.
2. Calls and results meet in a hash join by identifier: results are the built side, calls probe it. Of each side the first row of an
   identifier, the least by place and content, is linked. Further calls of one identifier stay as calls without a result and are
   marked with their number ("copy": 2 and so on); further results of one identifier and results without a call are orphans. So
   calls, linked results and orphans together are all that the turns hold, repeated rows included.
3. A call's arguments are checked against the schema of its tool's name (type, required, properties, additionalProperties, enum,
   minimum, maximum, minLength, maxLength, items) and written as canonical JSON: keys in order of code point, no spaces,
   no escapes but those JSON needs.
4. A conversation's calls are put in topological order of their dependencies, ties by place and then identifier. Calls in or
   behind a cycle come last in that same order and are marked. Dependencies on unknown identifiers don't hold a call back.

A conversation is one row of output, so its messages meet in one task: that group is as large as the example it makes. A row
without conversation is a conversation of its own, so such rows never form a group. Null texts count as empty, a null turn is
before all others. Arguments that aren't JSON (or that JSON can't say: NaN, nesting past the reader's depth) are invalid and kept
as a JSON string. Text that looks like a tool turn but isn't JSON is a plain turn. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karyoflux.llm.common import small_batches

_LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """Canonical JSON; lone surrogates, which UTF-8 can't hold, stay escaped."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def parsed(text: str):
    """The value of JSON text that canonical() can write; ValueError otherwise."""
    try:
        value = json.loads(text)
        canonical(value)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "integer": int, "number": (int, float)}


def _is(value, kind: str) -> bool:
    """Whether value has a type of JSON Schema; truth values are no numbers, and 1.0 is an integer. No value has an unknown type."""
    if kind not in _TYPES or isinstance(value, bool) and kind != "boolean":
        return False
    return isinstance(value, _TYPES[kind]) or kind == "integer" and isinstance(value, float) and value.is_integer()


def _same(a, b) -> bool:
    """Equality of JSON values: true isn't 1, and 1.0 is 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return a == b


def problems(value, schema: dict | bool, at: str = "$") -> list[str]:
    """What in value goes against schema, as paths with the rule; empty if nothing. type is one name or a list of them."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}:never"]
    kind = schema.get("type")
    if kind is not None and not any(_is(value, k) for k in (kind if isinstance(kind, list) else [kind])):
        return [f"{at}:type"]
    out = []
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{at}:enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}:{rule}" for rule, bad in (("minimum", value < schema.get("minimum", value)), ("maximum", value > schema.get("maximum", value))) if bad]
    if isinstance(value, str):
        out += [f"{at}:{rule}" for rule, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", len(value)))) if bad]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}:required" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}:unknown" for k in sorted(value) if k not in known]
        for k in sorted(known.keys() & value.keys()):
            out += problems(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    return out


def topological(calls: list[tuple[int, Id, list[Id]]]) -> tuple[list[int], set[int]]:
    """(order, cyclic) of calls (place, id, dependencies), as positions in the list. A repeated id means its first call."""
    where: dict[Id, int] = {}
    for k, c in enumerate(calls):
        where.setdefault(c[1], k)
    after: list[list[int]] = [[] for _ in calls]
    waits = [0] * len(calls)
    for k, (_, _, needs) in enumerate(calls):
        for d in {where[d] for d in needs if d in where}:
            after[d].append(k)
            waits[k] += 1
    rank = lambda k: (calls[k][0], calls[k][1])
    ready = [(*rank(k), k) for k in range(len(calls)) if not waits[k]]
    heapq.heapify(ready)
    order = []
    while ready:
        k = heapq.heappop(ready)[-1]
        order.append(k)
        for x in after[k]:
            waits[x] -= 1
            if not waits[x]:
                heapq.heappush(ready, (*rank(x), x))
    left = sorted(set(range(len(calls))) - set(order), key=rank)
    return order + left, set(left)


#: Plain turns as calls.
TURN_SCHEMAS = {
    "respond": {
        "type": "object", "additionalProperties": False, "required": ["role", "text", "turn"],
        "properties": {"role": {"type": "string", "enum": ["system", "user"]}, "text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    }
}

#: An identifier: whether it is a plain turn's, and its text.
Id = tuple[bool, str]


@dataclass
class Call:
    id: Id
    place: int
    name: str
    arguments: object  # JSON text, or its value
    needs: list[Id]
    copy: int = 1


@dataclass
class Result:
    id: Id
    place: int
    content: str


def events(turn: int | None, role: str | None, text: str | None) -> list[Call | Result]:
    """The calls or the result of one turn."""
    place, text = -1 if turn is None else int(turn), text or ""
    tool = None
    if text.startswith("{"):
        try:
            tool = parsed(text)
        except ValueError:
            tool = None
    if tool is not None:
        calls = tool.get("tool_calls")
        if isinstance(calls, list) and calls and all(isinstance(c, dict) for c in calls):
            return [Call((False, _text(c.get("id"))), place, _text(c.get("name")), c.get("arguments"), _needs(c.get("needs"))) for c in calls]
        if isinstance(tool.get("tool_call_id"), str):
            return [Result((False, tool["tool_call_id"]), place, _text(tool.get("content")))]
    if role == "assistant":
        return [Result((True, f"turn:{place - 1}"), place, text)]
    said = {k: v for k, v in (("role", role), ("text", text), ("turn", turn if turn is None else int(turn))) if v is not None}
    return [Call((True, f"turn:{place}"), place, "respond", said, [(True, f"turn:{place - 2}")])]


def _text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else canonical(value)


def _needs(value) -> list[Id]:
    """A need names a tool call, or a plain turn as "turn:3" where no call has that identifier."""
    return [(False, _text(x)) for x in value] if isinstance(value, list) else []


def link(found: list[Call | Result]) -> tuple[list[tuple[Call, Result | None]], list[Result]]:
    """(calls with their results, orphans) of one conversation's calls and results, by hash join on the identifier."""
    calls = sorted((x for x in found if isinstance(x, Call)), key=lambda c: (c.place, c.id, c.name, _text(c.arguments), c.needs))
    results = sorted((x for x in found if isinstance(x, Result)), key=lambda r: (r.place, r.id, r.content))
    built: dict[Id, Result] = {}
    orphans = []
    for r in results:
        if built.setdefault(r.id, r) is not r:
            orphans.append(r)
    copies: dict[Id, int] = defaultdict(int)
    linked = []
    for c in calls:
        copies[c.id] += 1
        c.copy = copies[c.id]
        linked.append((c, built.pop(c.id, None) if c.copy == 1 else None))
    for c in calls:
        c.needs = [(True, x[1]) if x not in copies and (True, x[1]) in copies else x for x in c.needs]
    return linked, sorted([*orphans, *built.values()], key=lambda r: (r.place, r.id, r.content))


def write(turns: list[tuple[int | None, str | None, str | None]], schemas: dict[str, dict]) -> tuple[int, int, int, int, int, str]:
    """(calls, linked, invalid, cyclic, orphans, JSON) of one conversation's turns (turn, role, text), whatever their order."""
    linked, orphans = link([e for t in turns for e in events(*t)])
    order, cyclic = topological([(c.place, c.id, c.needs) for c, _ in linked])
    out, answered, invalid = [], 0, 0
    for k in order:
        c, r = linked[k]
        try:
            value = c.arguments if not isinstance(c.arguments, str) else parsed(c.arguments)
            wrong = problems(value, schemas[c.name]) if c.name in schemas else ["$:tool"]
        except ValueError:
            value, wrong = c.arguments, ["$:json"]
        row = {"id": c.id[1], "name": c.name, "arguments": value}
        if c.copy > 1:
            row["copy"] = c.copy
        if r is not None:
            answered += 1
            row["result"] = r.content
        if wrong:
            invalid += 1
            row["errors"] = wrong
        if k in cyclic:
            row["cyclic"] = True
        out.append(row)
    lone = [{"id": o.id[1], "result": o.content} for o in orphans]
    return len(out), answered, invalid, len(cyclic), len(lone), canonical({"calls": out, "orphans": lone})


def format_chats(turns: DataFrame, schemas: dict[str, dict], conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row a conversation of turns: conv_id, n_calls, n_linked, n_invalid, n_cyclic, n_orphans, chat (canonical JSON)."""

    @F.pandas_udf("struct<n_calls: long, n_linked: long, n_invalid: long, n_cyclic: long, n_orphans: long, chat: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in batches:
            rows = [write([(t["turn"], t["role"], t["text"]) for t in c], schemas) for c in some]
            yield pd.DataFrame(rows, columns=["n_calls", "n_linked", "n_invalid", "n_cyclic", "n_orphans", "chat"])

    small_batches(turns.sparkSession)
    own = F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id())
    slim = turns.select(F.col(conv_id).alias("conv_id"), own.alias("own"), F.struct(F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("t"))
    met = slim.groupBy("conv_id", "own").agg(F.collect_list("t").alias("turns"))
    return met.select("conv_id", run("turns").alias("_c")).select("conv_id", "_c.*")
