"""Chat formatting with linked tool calls (operator 4).

Input are turns (conv_id, turn, role, text). A turn whose text is a JSON object with ``tool_calls`` (a list of objects with
``id``, ``name`` and ``arguments``) makes calls; one of role ``tool`` whose text is a JSON object with ``tool_call_id`` is a
result. Calls and results are joined by hash on (conv_id, identifier). Any other turn is a plain message.

Order: a plain message keeps its turn. Calls wait for the results that their arguments name as ``{"$result": "<id>"}``. A
message with calls comes at its turn or, if that is later, at the greatest ``order_turn`` of the calls and results of other
messages that its calls wait for; a call's level is 0, or one more than the greatest level that it waits for. A result comes
at the latest of its turn, its message's ``order_turn`` and that of the results of the same message that its call waits for;
its level is its call's, or its message's if that is greater and both share an ``order_turn``. (conv_id, order_turn, level,
kind, turn) sorts a conversation topologically. Only for a call with ``unknown_tool`` or ``invalid_arguments`` waits inside its
own message don't move the result: it is a refusal. No conversation is ever gathered in one task, so one may be of any
length; a message, which is one row, is.

Each call's arguments are validated against the tool's schema (types, required, properties, enum, items of JSON Schema).
Messages become canonical JSON: keys sorted by code point, no spaces, no escapes but the necessary ones, UTF-8; further
fields of messages, calls and results stay. A text that is no JSON (``NaN`` and numbers beyond a double included), or that is
nested more than ``DEPTH`` deep, is a plain message, whatever its length.

``status``: ``ok``; ``unknown_tool``, ``invalid_arguments``, ``unknown_result`` (it waits for the result of no call), ``no_result``,
``duplicate_id``, ``cycle`` for the first call with such a fault, in that order of precedence; ``no_call`` for a result without a call.
Of calls that share an identifier the first in order of turn and place links; of several results for a call all link. Waits in a circle
of messages are a ``cycle`` too, as no order of these messages holds. A null text counts as empty, a null role as
``user``; null ids link nothing. Repeated rows are formatted each; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from graphlib import CycleError, TopologicalSorter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, in_arrow, texts_of, written

#: Schemas of the tools that production conversations may call.
TOOLS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}},
    "weather": {"type": "object", "required": ["city"], "properties": {"city": {"type": "string"}, "unit": {"type": "string", "enum": ["c", "f"]}}},
}
TYPES = {"object": dict, "array": list, "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}
#: Deepest nesting of a call or result that is read.
DEPTH = 200
TURN = "conv_id long, turn long, kind int, message string, ids array<string>, faults array<string>, waiters array<int>, waits array<string>"
FAULTS = ("unknown_tool", "invalid_arguments", "unknown_result", "no_result", "duplicate_id", "cycle", "ok")


def canonical(value: object) -> str:
    """Canonical JSON of a value; a lone surrogate, which UTF-8 can't hold, becomes a question mark."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return text.encode("utf-8", "replace").decode()


def valid(value: object, schema: dict) -> bool:
    """Whether a value meets a schema of the subset named above; a reference to a result stands for a value of any type."""
    if isinstance(value, dict) and len(value) == 1 and isinstance(value.get("$result"), str):
        return True
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        return all(k in value for k in schema.get("required", [])) and all(valid(v, known[k]) for k, v in value.items() if k in known)
    return not isinstance(value, list) or all(valid(v, schema.get("items", {})) for v in value)


def named(value: object) -> list[str]:
    """Identifiers of the results that a value names."""
    if isinstance(value, dict):
        own = [value["$result"]] if isinstance(value.get("$result"), str) else []
        return own + [x for v in value.values() for x in named(v)]
    return [x for v in value for x in named(v)] if isinstance(value, list) else []


def _number(text: str) -> float:
    """A finite number."""
    found = float(text)
    if found in (float("inf"), float("-inf")):
        raise ValueError(text)
    return found


def _no_number(text: str) -> float:
    """``NaN`` and ``Infinity`` aren't JSON."""
    raise ValueError(text)


def deep(value: object) -> bool:
    """Whether a value is nested more than ``DEPTH`` deep."""
    level = [value]
    for _ in range(DEPTH + 1):
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if not level:
            return False
    return True


def parsed(text: str) -> dict:
    """The JSON object that a text is, or an empty one."""
    if not text.lstrip().startswith("{"):
        return {}
    try:
        found = json.loads(text, parse_float=_number, parse_constant=_no_number)
    except (ValueError, RecursionError):
        return {}
    return found if isinstance(found, dict) and not deep(found) else {}


def read_turn(role: str, text: str, tools: dict) -> tuple[int, str, list[str], list[str], list[int], list[str]]:
    """(kind, message, identifiers, fault of each, places of calls that wait, identifiers waited for): kind 0 plain, 1 calls, 2 result."""
    found = parsed(text)
    calls = found.get("tool_calls")
    if isinstance(calls, list) and calls and all(isinstance(c, dict) for c in calls):
        ids, faults, waiters, waits, out = [], [], [], [], []
        for c in calls:
            args = c.get("arguments")
            if isinstance(args, str):
                args = parsed(args) or args
            own, name = c.get("id"), c.get("name")
            schema = tools.get(name) if isinstance(name, str) else None
            ids.append(own if isinstance(own, str) else None)
            faults.append("unknown_tool" if schema is None else "" if valid(args, schema) else "invalid_arguments")
            after = named(args)
            waiters += [len(ids) - 1] * len(after)
            waits += after
            out.append({**c, "arguments": args, "id": own, "name": name})
        return 1, canonical({**found, "role": role, "tool_calls": out}), ids, faults, waiters, waits
    if role == "tool" and isinstance(found.get("tool_call_id"), str):
        return 2, canonical({"content": None, **found, "role": role}), [found["tool_call_id"]], [], [], []
    return 0, canonical({"role": role, "content": text}), [], [], [], []


def place(turn: int | None, calls: list[dict], cross: list[dict], inner: list[dict]) -> tuple[int | None, int, dict[int, tuple]]:
    """(order_turn, level, {place: (floor, level, cycle, reach)}) of a message with calls.

    ``calls`` hold place, fault, and first and last turn of the results; ``cross`` what a call waits for in other messages
    (place, reach, level); ``inner`` what it waits for in this one (place, target). No result of a call comes before its
    floor; reach is the last ``order_turn`` of the call and its results.
    """
    last = lambda *turns: max((t for t in turns if t is not None), default=None)
    order = last(turn, *(x["reach"] for x in cross))
    base, deps = {c["place"]: 0 for c in calls}, {c["place"]: set() for c in calls}
    for x in cross:
        base[x["place"]] = max(base[x["place"]], 1 + x["level"])
    for x in inner:
        deps[x["place"]].add(x["target"])
    sorter, sequence = TopologicalSorter(deps), []
    try:
        sorter.prepare()
    except CycleError:
        pass  # what isn't in a cycle, nor waits for one, still comes
    while ready := sorter.get_ready():
        sequence += ready
        sorter.done(*ready)
    for p in sequence:
        base[p] = max([base[p], *(1 + base[d] for d in deps[p])])
    level, known = max(base.values()), {c["place"]: c for c in calls}
    out: dict[int, tuple] = {}
    for p in sequence:
        c = known[p]
        # The result of a call that wasn't fit to run is a refusal, which waits for no other result of the message.
        floor = order if c["fault"] else last(order, *(out[d][3] for d in deps[p]))
        tie = floor == order and (c["first"] is None or order is None or c["first"] <= order)
        own = max([base[p], *(1 + out[d][1] for d in deps[p]), level if tie else 0])
        out[p] = (floor, own, False, last(floor, c["last"]))
    for p in base.keys() - out.keys():
        out[p] = (order, level, True, last(order, known[p]["last"]))
    return order, level, out


PLACED = "row long, conv_id long, order_turn long, message_level int, place int, id string, floor long, level int, cycle boolean, reach long"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``PLACED`` for the calls of each message whose waits are known, be it from messages that came before in this very sweep."""
    key, here = None, {}
    for b in batches:
        out = []
        for m in b.to_pylist():
            if key != (m["conv_id"],):
                key, here = (m["conv_id"],), {}
            cross = []
            for x in m["cross"] or []:
                if not x["known"]:
                    if x["after"] not in here:
                        break
                    x["reach"], x["level"] = here[x["after"]]
                cross.append(x)
            else:
                order, level, found = place(m["turn"], m["calls"], cross, m["inner"] or [])
                for c in m["calls"]:
                    out.append((m["row"], m["conv_id"], order, level, c["place"], c["id"], *found[c["place"]]))
                    if c["id"] is not None:
                        here[c["id"]] = found[c["place"]][3], found[c["place"]][1]
        yield batch(out, PLACED)


def placed(made: DataFrame, waits: DataFrame) -> DataFrame:
    """``PLACED`` of the calls of messages that wait for a result.

    ``made`` are all calls (row, conv_id, turn, place, id, nth, fault, first, last), ``waits`` the edges (row, conv_id, place,
    after, owner, target). Rounds over the messages that are left, dealt out by ranges of conversation and turn: a task goes through
    its range in order, up and down in turn, and places every message whose waits are known from rounds before or from its way
    so far. So a chain of any length takes two rounds, and one more for each part of its conversation that it crosses against
    the way or from range to range. When neither way places any, the rest is a cycle or waits for one.
    """
    edges = written(waits.withColumn("outer", F.col("row") != F.col("owner")), "waits")
    mine = made.join(edges.select("row").distinct(), "row", "left_semi").dropDuplicates(["row", "place"])
    messages = mine.groupBy("row", "conv_id", "turn").agg(F.collect_list(F.struct("place", F.when(F.col("nth") == 1, F.col("id")).alias("id"), (F.col("fault") != "").alias("fault"), "first", "last")).alias("calls"))
    inner = edges.where("not outer").groupBy("row").agg(F.collect_list(F.struct("place", "target")).alias("inner"))
    left = written(messages.join(inner, "row", "left"), "messages")
    free = made.where("nth = 1").join(edges.select("row").distinct(), "row", "left_anti")
    reached = written(free.select("conv_id", F.col("id").alias("after"), F.greatest("turn", "last").alias("reach"), F.lit(0).alias("level")).join(edges.select("conv_id", "after").distinct(), ["conv_id", "after"], "left_semi"), "reached")
    rest, done, level, idle = edges.where("outer"), [], 0, 0
    while not left.isEmpty():
        level += 1
        known = rest.join(reached.withColumn("known", F.lit(True)), ["conv_id", "after"], "left")
        known = known.groupBy("row").agg(F.collect_list(F.struct("place", "after", F.coalesce("known", F.lit(False)).alias("known"), "reach", F.coalesce("level", F.lit(0)).alias("level"))).alias("cross"))
        ready = left.join(known, "row", "left").select("row", "conv_id", "turn", "calls", "inner", "cross")
        way = F.asc_nulls_first("turn") if level % 2 else F.desc_nulls_last("turn")
        spread = ready.repartitionByRange("conv_id", "turn", "row").sortWithinPartitions("conv_id", way, "row")
        now = written(in_arrow(spread, _sweep, PLACED), "placed")
        if now.isEmpty():
            idle += 1
            if idle < 2:  # the other way may still lead on
                continue
            waiting = edges.select("row", "place", F.lit(True).alias("waits")).distinct()
            stuck = left.select("row", "conv_id", "turn", F.explode("calls").alias("c")).select("row", "conv_id", "turn", F.col("c.place").alias("place"), F.col("c.id").alias("id")).join(waiting, ["row", "place"], "left")
            done.append(stuck.select("row", "conv_id", F.col("turn").alias("order_turn"), F.lit(level).alias("message_level"), "place", "id", F.col("turn").alias("floor"), F.lit(level).alias("level"), F.coalesce("waits", F.lit(False)).alias("cycle"), F.col("turn").alias("reach")))
            break
        idle = 0
        done.append(now)
        reached = reached.unionByName(now.where("id is not null").select("conv_id", F.col("id").alias("after"), "reach", "level"))
        left = written(left.join(now.select("row").distinct(), "row", "left_anti"), "messages")
        rest = rest.join(left.select("row"), "row", "left_semi")
    return reduce(DataFrame.unionByName, done)


def chat_messages(turns: DataFrame, tools: dict | None = None) -> DataFrame:
    """conv_id, turn, order_turn, level, kind, status, message (canonical JSON) of every turn."""
    tools = TOOLS if tools is None else tools

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b["conv_id"].to_pylist(), b["turn"].to_pylist(), b["role"].to_pylist(), texts_of(b["text"]), strict=True)
            yield batch([(c, t, *read_turn("user" if role is None else role, text.decode(), tools)) for c, t, role, text in rows], TURN)

    read = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    rows = written(in_arrow(read, run, TURN), "turns")
    own = F.xxhash64("conv_id", "turn", "message").alias("row")
    plain = rows.where("kind = 0").select("conv_id", "turn", F.col("turn").alias("order_turn"), F.lit(0).alias("level"), "kind", F.lit("ok").alias("status"), "message")

    made = rows.where("kind = 1").select(own, "conv_id", "turn", F.posexplode(F.arrays_zip("ids", "faults")).alias("place", "call"))
    made = made.select("row", "conv_id", "turn", "place", F.col("call.ids").alias("id"), F.col("call.faults").alias("fault"))
    firsts = made.where("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row", "place")).alias("one"))
    made = made.join(firsts, ["conv_id", "id"], "left").withColumn("nth", F.when(F.col("one").isNotNull(), F.when(F.struct("turn", "row", "place").eqNullSafe(F.col("one")), 1).otherwise(2))).drop("one")
    results = rows.where("kind = 2").select(own, "conv_id", "turn", F.col("ids")[0].alias("id"), "message")
    answered = results.groupBy("conv_id", "id").agg(F.lit(True).alias("answered"), F.min("turn").alias("first"), F.max("turn").alias("last"))
    made = made.join(answered, ["conv_id", "id"], "left")
    calls = made.where("nth = 1").select("conv_id", "id", F.col("turn").alias("call_turn"), F.col("row").alias("owner"), F.col("place").alias("target")).distinct()
    named_ = rows.where("kind = 1").select(own, "conv_id", F.explode(F.arrays_zip("waiters", "waits")).alias("w"))
    named_ = named_.select("row", "conv_id", F.col("w.waiters").alias("place"), F.col("w.waits").alias("after")).distinct()
    named_ = written(named_.join(calls.select("conv_id", F.col("id").alias("after"), "owner", "target"), ["conv_id", "after"], "left"), "named")
    waits, lost = named_.where("owner is not null"), named_.where("owner is null").select("row", "place", F.lit(True).alias("lost")).distinct()
    ranks = rows.sparkSession.createDataFrame([], PLACED) if waits.isEmpty() else placed(made, waits)

    judged = made.join(ranks.select("row", "place", "order_turn", "message_level", "cycle"), ["row", "place"], "left")
    judged = judged.join(lost, ["row", "place"], "left")
    fault = F.when(F.col("fault") != "", F.col("fault")).when(F.col("lost"), "unknown_result").when(F.col("answered").isNull(), "no_result").when(F.col("nth") > 1, "duplicate_id").when(F.col("cycle"), "cycle").otherwise("ok")
    rank = F.array_position(F.array(*map(F.lit, FAULTS)), fault)
    judged = judged.groupBy("row").agg(F.max("order_turn").alias("order_turn"), F.max(F.coalesce("message_level", F.lit(0))).alias("level"), F.min_by(fault, rank).alias("status"))
    callers = rows.where("kind = 1").withColumn("row", own).join(judged, "row").select("conv_id", "turn", F.coalesce("order_turn", "turn").alias("order_turn"), "level", "kind", "status", "message")

    linked = results.join(calls, ["conv_id", "id"], "left").join(ranks.where("id is not null").select("conv_id", "id", "floor", "level"), ["conv_id", "id"], "left")
    linked = linked.select("conv_id", "turn", F.coalesce(F.greatest("turn", "call_turn", "floor"), "turn").alias("order_turn"), F.coalesce("level", F.lit(0)).alias("level"), F.lit(2).alias("kind"), F.when(F.col("call_turn").isNull(), "no_call").otherwise("ok").alias("status"), "message")
    return plain.unionByName(callers).unionByName(linked)


def write_jsonl(messages: DataFrame, path: str) -> None:
    """Write the messages as lines of JSON, sorted by conversation and order."""
    order = ["conv_id", "order_turn", "level", "kind", "turn", "message"]
    messages.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("message").write.text(path)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, formatted."""
    return chat_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
