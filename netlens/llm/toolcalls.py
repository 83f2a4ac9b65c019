"""Tool-call linking for chat data.

Messages are read as tool calls and tool results; both are joined by (conversation,
identifier); calls are put in a topological order of their dependencies; arguments are
validated against the schema of their tool; each linked call is serialised as canonical
JSON (sorted keys, no blanks, one spelling of every number).

Messages:

* an assistant turn ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}, ...]}``
  holds calls; ``{"$ref": id}`` anywhere in arguments is a dependency too;
* a tool turn ``{"tool_call_id", "content"}`` is a result;
* with ``plain``, any other turn is read as an exchange: a user or system turn t is a call
  ``<conversation>:t`` of ``reply`` or ``configure`` that depends on turn t - 2 from turn 2
  on, an assistant or tool turn t is the result of ``<conversation>:t-1``.

Order: if all dependencies of a conversation lie before the calls that need them, the
order of its turns is topological already (round 0). Only conversations where some lie
later are sorted: ``round`` is then the length of the longest chain of dependencies that
ends at the call, counted from 1, and is null for calls on or behind a cycle. (round, turn,
place) sorts calls topologically. Sorting goes by blocks of at most about ``BLOCK`` calls of
neighbouring turns, each sorted as far as it goes in one task; what depends on another
block waits for the next pass. So no conversation, however long, is gathered in one task,
and a chain costs passes for the blocks it runs through, not for its links.

Defined results for odd input: of calls with one identifier the earliest counts (the least
text on ties), of results too, and ``copies`` tells how many there were; a call or result
without an identifier (null or missing) gets one of its own from its turn and place and
links to nothing; identifiers that are not text are written as JSON; a result without a
call is a row of kind ``orphan``; a call without a result has a null result; a null
conversation is one of its own, whatever other conversations are named; a null turn counts
as -1; a null text as empty; turns of other roles are left out; a dependency that does not
exist is an error of the call; dependencies that are no list of texts are ignored;
arguments or contents that are no JSON (NaN, infinity) are an error and written as null; a
message that JSON does not allow, or nested deeper than its reader goes, is no message; lone
surrogates are written as escapes; an empty table gives an empty result. Only the four named
columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import by_bytes, checkpointed, texts_of, tidied

#: Calls of a conversation that are sorted in one task.
BLOCK = 20_000
_TURN = {"type": "integer", "minimum": 0}
_SAID = {
    "type": "object", "required": ["text", "turn"], "additionalProperties": False,
    "properties": {"text": {"type": "string", "minLength": 1}, "turn": _TURN},
}
SCHEMAS = {"reply": _SAID, "configure": _SAID}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
_SURROGATES = re.compile("[\ud800-\udfff]")


def clean(text: str) -> str:
    """Text that can be written as UTF-8: lone surrogates become escapes."""
    return _SURROGATES.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _number(x: int | float) -> str:
    """The shortest digits that give the number, written alike whether it came as 1, 1.0 or 1e0."""
    if isinstance(x, int):
        if abs(x) < 10**21 or x.bit_length() > 1023 or int(float(x)) != x:
            return str(x)
        x = float(x)
    if not math.isfinite(x):
        raise ValueError("no JSON number")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    digits, point = "".join(map(str, digits)), len(digits) + exponent
    if -6 < point <= 0:
        text = "0." + "0" * -point + digits
    elif 0 < point <= 21:
        text = digits[:point] + "." + digits[point:]
    else:
        text = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{point - 1:+d}"
    return "-" * sign + text


def canonical(value) -> str:
    """JSON with keys in order of UTF-16 units, no blanks, and one spelling of every number; of any depth."""
    out: list[str] = []
    todo: list = [value]
    marks = object()  # (marks, text) on the stack is text to be written as it is
    while todo:
        x = todo.pop()
        if isinstance(x, tuple) and x and x[0] is marks:
            out.append(x[1])
        elif isinstance(x, dict):
            inner: list = [(marks, "{")]
            for i, k in enumerate(sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))):
                inner += [(marks, "," * (i > 0) + clean(json.dumps(k, ensure_ascii=False)) + ":"), x[k]]
            todo += [(marks, "}"), *reversed(inner)]
        elif isinstance(x, list):
            inner = [(marks, "[")]
            for i, y in enumerate(x):
                inner += [(marks, ","), y] if i else [y]
            todo += [(marks, "]"), *reversed(inner)]
        elif isinstance(x, int | float) and not isinstance(x, bool):
            out.append(_number(x))
        else:
            out.append(clean(json.dumps(x, ensure_ascii=False)))
    return "".join(out)


def problems(value, schema: dict, at: str = "$") -> Iterator[str]:
    """What is wrong with a value under type, enum, const, required, properties, additionalProperties, items and bounds.

    Goes as deep as the schema, not as the value.
    """
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds

    def is_a(kind: str) -> bool:
        if kind in ("number", "integer"):
            number = isinstance(value, int | float) and not isinstance(value, bool)
            return number and (kind == "number" or isinstance(value, int) or value.is_integer())
        return isinstance(value, _TYPES[kind])

    if kinds and not any(map(is_a, kinds)):
        yield f"{at}: not {'|'.join(kinds)}"
        return
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        yield f"{at}: not in enum"
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        yield f"{at}: not the constant"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", ()):
            if k not in value:
                yield f"{at}.{k}: missing"
        for k in sorted(value):
            if k in known:
                yield from problems(value[k], known[k], f"{at}.{clean(k)}")
            elif schema.get("additionalProperties") is False:
                yield f"{at}.{clean(k)}: unknown"
    elif isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            yield f"{at}: number of items"
        if "items" in schema:
            for i, x in enumerate(value):
                yield from problems(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
            yield f"{at}: length"
    elif isinstance(value, int | float) and not isinstance(value, bool):
        if not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
            yield f"{at}: out of bounds"


def _refs(value) -> Iterator[str]:
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str) and len(x) == 1:
                yield clean(x["$ref"])
            todo += x.values()
        elif isinstance(x, list):
            todo += x


def _json(text: str):
    """The value, or None for what is no JSON or nested too deeply."""
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _written(value) -> str | None:
    try:
        return canonical(value)
    except ValueError:
        return None


def _name(value, otherwise: str) -> str:
    if value is None:
        return otherwise
    return clean(value) if isinstance(value, str) else _written(value) or otherwise


def read_message(conv: str, turn: int, role: str, text: str, plain: bool) -> Iterator[tuple]:
    """(place, kind, id, name, arguments or content as canonical JSON, dependencies) of one turn."""
    found = _json(text) if text[:1] == "{" else None
    if isinstance(found, dict) and isinstance(found.get("tool_calls"), list):
        for i, c in enumerate(found["tool_calls"]):
            c = c if isinstance(c, dict) else {}
            arguments = c.get("arguments")
            if isinstance(arguments, str) and (inner := _json(arguments)) is not None:
                arguments = inner
            given = c.get("depends_on")
            depends = {clean(d) for d in given if isinstance(d, str)} if isinstance(given, list) else set()
            yield i, "call", _name(c.get("id"), f"{conv}:{turn}:{i}"), _name(c.get("name"), ""), _written(arguments), sorted({*depends, *_refs(arguments)})
    elif isinstance(found, dict) and "tool_call_id" in found:
        yield 0, "result", _name(found["tool_call_id"], f"{conv}:{turn}:result"), None, _written(found.get("content")), []
    elif plain and role in ("user", "system"):
        name = "reply" if role == "user" else "configure"
        yield 0, "call", f"{conv}:{turn}", name, canonical({"text": text, "turn": turn}), [f"{conv}:{turn - 2}"] if turn >= 2 else []
    elif plain and role in ("assistant", "tool"):
        yield 0, "result", f"{conv}:{turn - 1}", None, canonical(text), []


def parse(messages: DataFrame, plain: bool = True) -> DataFrame:
    """``conv`` is a key that no null conversation shares with one of that name."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))
    turn = F.coalesce("turn", F.lit(-1)).cast("long").alias("turn")
    kept = messages.select(conv.alias("conv"), "conv_id", turn, F.lower(F.coalesce("role", F.lit(""))).alias("role"), F.col("text").cast("string").alias("text"))
    names = ["conv", "turn", "place", "kind", "id", "name", "body", "depends", "conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            rows = []
            for i, (key, turn, role, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), texts_of(batch, "text"), strict=True)):
                rows += [(i, key, turn, *r) for r in read_message(key.removeprefix("="), turn, role, text, plain)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string())]
            columns = [pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1).take(pa.array([r[0] for r in rows], pa.int64()))], names)

    kind = messages.schema["conv_id"].dataType.simpleString()
    return kept.mapInArrow(tidied(run), f"conv string, turn long, place long, kind string, id string, name string, body string, depends array<string>, conv_id {kind}")


def _sort_block(rows: pd.DataFrame) -> pd.DataFrame:
    """Rounds of the calls of one block that can be told: ``id``, a dependency ``dep`` (null: none), and the round it is known to have."""
    needs, done, waiting = defaultdict(set), {}, defaultdict(set)
    for i, dep, known in zip(rows["id"], rows["dep"], rows["dep_round"], strict=True):
        needs[i]
        if isinstance(dep, str):
            if known == known and known is not None:
                done[dep] = int(known)
            else:
                needs[i].add(dep)
                waiting[dep].add(i)
    most = defaultdict(int)
    for i, dep in zip(rows["id"], rows["dep"], strict=True):
        if isinstance(dep, str) and dep in done:
            most[i] = max(most[i], done[dep])
    ready, out = [i for i, n in needs.items() if not n], {}
    while ready:
        i = ready.pop()
        out[i] = most[i] + 1
        for w in waiting[i]:
            most[w] = max(most[w], out[i])
            needs[w].discard(i)
            if not needs[w]:
                ready.append(w)
    return pd.DataFrame({"conv": rows["conv"].iloc[0], "id": list(out), "round": list(out.values())}).astype({"conv": object, "id": object, "round": "int64"})


def _rounds(calls: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, id, round) of the calls (conv, id, turn) that can be ordered; edges are (conv, id, dep) between them."""
    size = calls.groupBy("conv").agg(F.count("*").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    # turns are cut evenly; turns that hold too many calls are cut by hash as well
    parts = F.ceil(F.col("n") / block)
    cut = F.floor((F.col("turn") - F.col("low")) * parts / (F.col("high") - F.col("low") + 1))
    own = checkpointed(calls.join(size, "conv").select("conv", "id", cut.cast("long").alias("cut")))
    heavy = own.groupBy("conv", "cut").agg(F.ceil(F.count("*") / block).alias("pieces"))
    own = own.join(heavy, ["conv", "cut"]).select("conv", "id", "cut", F.pmod(F.xxhash64("id"), "pieces").alias("piece"))
    left = checkpointed(own.join(edges, ["conv", "id"], "left").withColumn("dep_round", F.lit(None).cast("long")))
    found = checkpointed(left.select("conv", "id", F.lit(0).cast("long").alias("round")).where("false"))
    while True:
        new = checkpointed(left.groupBy("conv", "cut", "piece").applyInPandas(_sort_block, "conv string, id string, round long"))
        if new.isEmpty():
            return found
        found = checkpointed(found.unionByName(new))
        known = new.select("conv", F.col("id").alias("dep"), "round")
        left = left.join(new.select("conv", "id"), ["conv", "id"], "left_anti").join(known, ["conv", "dep"], "left")
        left = left.select("conv", "id", "cut", "piece", "dep", F.coalesce("dep_round", "round").alias("dep_round"))
        left = checkpointed(left)
        if left.isEmpty():
            return found


def link(messages: DataFrame, schemas: dict[str, dict] | None = None, plain: bool = True, block: int = BLOCK) -> DataFrame:
    """One row per call and per orphan result.

    conv_id, call_id, kind, name, turn, place, round, result_turn, copies, valid, errors, canonical.
    """
    schemas = SCHEMAS if schemas is None else schemas
    rows = checkpointed(parse(messages, plain))

    def first(kind: str, *names: str) -> DataFrame:
        own = rows.where(F.col("kind") == kind).groupBy("conv", "id")
        return own.agg(F.min(F.struct("turn", "place", *names)).alias(kind), F.count("*").alias(f"{kind}s"), F.min("conv_id").alias(f"{kind}_conv"))

    calls, results = first("call", "name", "body", "depends"), first("result", "body")
    placed = calls.select("conv", "id", "call.turn", "call.place", "call.depends")
    edges = placed.select("conv", "id", "turn", "place", F.explode("depends").alias("dep"))
    at = placed.select("conv", F.col("id").alias("dep"), F.col("turn").alias("t"), F.col("place").alias("p"))
    edges = checkpointed(edges.join(at, ["conv", "dep"], "left"))
    missing = edges.where(F.col("t").isNull()).groupBy("conv", "id").agg(F.array_sort(F.collect_set("dep")).alias("missing"))  # of one call
    late = checkpointed(edges.where(F.struct("t", "p") >= F.struct("turn", "place")).select("conv").distinct())
    linked = calls.join(results, ["conv", "id"], "full").join(missing, ["conv", "id"], "left")
    if late.isEmpty():
        linked = linked.withColumn("round", F.lit(0))
    else:
        own = placed.join(late, "conv", "left_semi").select("conv", "id", "turn")
        known = edges.where(F.col("t").isNotNull()).join(late, "conv", "left_semi").select("conv", "id", "dep")
        linked = linked.join(_rounds(own, known, block), ["conv", "id"], "left").join(late.withColumn("late", F.lit(True)), "conv", "left")
        linked = linked.withColumn("round", F.when(F.col("late"), F.col("round")).otherwise(F.lit(0)))
    linked = linked.select(
        F.coalesce("call_conv", "result_conv").alias("conv_id"), F.col("id").alias("call_id"),
        F.when(F.col("calls").isNull(), "orphan").otherwise("call").alias("kind"), F.col("call.name").alias("name"),
        F.coalesce("call.turn", "result.turn").alias("turn"), F.coalesce("call.place", "result.place").alias("place"),
        F.when(F.col("calls").isNotNull(), F.col("round")).cast("int").alias("round"), F.col("result.turn").alias("result_turn"),
        F.greatest(F.coalesce("calls", F.lit(0)), F.coalesce("results", F.lit(0))).alias("copies"),
        F.col("call.body").alias("arguments"), F.col("result.body").alias("content"), "missing",
    )

    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = ("kind", "call_id", "name", "arguments", "content", "missing", "result_turn")
        for batch in batches:
            valid, errors, written = [], [], []
            for kind, call, name, arguments, content, gone, answered in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in read), strict=True):
                wrong = [f"dependency {d}: missing" for d in gone or ()]
                if kind == "call":
                    if arguments is None:
                        wrong.append("$: no JSON")
                    elif name not in schemas:
                        wrong.append(f"tool {name}: unknown")
                    else:
                        # nesting that the reader accepted once may be too deep for it in a deeper stack
                        value = _json(arguments)
                        wrong += ["$: no JSON"] if value is None and arguments != "null" else problems(value, schemas[name])
                    head = f'{{"arguments":{arguments or "null"},"id":{canonical(call)},"name":{canonical(name)},'
                else:
                    wrong.append("result without call")
                    head = f'{{"id":{canonical(call)},'
                if content is None and answered is not None:
                    wrong.append("result: no JSON")
                valid.append(not wrong)
                errors.append("; ".join(wrong))
                written.append(f'{head}"result":{content or "null"}}}')
            keep = [c for c in batch.schema.names if c not in ("arguments", "content", "missing")]
            own = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = [pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(written, pa.string())]
            yield pa.RecordBatch.from_arrays([*own, *made], [*keep, "valid", "errors", "canonical"])

    kind = messages.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, call_id string, kind string, name string, turn long, place long, round int, result_turn long, copies long, valid boolean, errors string, canonical string"
    return linked.mapInArrow(tidied(serialise), schema)


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """The exchanges of a conversation written as tool messages, each call waiting for the one two turns later."""
    name = lambda t: F.concat(F.lit("c"), t.cast("string"))
    call = F.struct(
        name(F.col("turn")).alias("id"), F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"),
        F.struct("text", "turn").alias("arguments"), F.array(name(F.col("turn") + 2)).alias("depends_on"),
    )
    answer = F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))
    asked = F.col("role").isin("user", "system")
    text = F.when(asked, F.to_json(F.struct(F.array(call).alias("tool_calls")))).otherwise(F.to_json(answer))
    return conversations.select("conv_id", "turn", F.when(asked, "assistant").otherwise("tool").alias("role"), text.alias("text"))


#: DuckDB, for tables without tool messages: exchanges joined by turn.
ORACLE = """
WITH m AS (SELECT conv_id, coalesce(turn, -1)::BIGINT AS turn, lower(coalesce(role, '')) AS role, coalesce(text, '') AS text FROM conversations
), c AS (
  SELECT conv_id, conv_id || ':' || turn AS id, min(turn) AS turn, min(CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END) AS name, min(text) AS text, count(*) AS n
  FROM m WHERE role IN ('user', 'system') GROUP BY 1, 2
), r AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS id, min(turn) AS turn, min(text) AS text, count(*) AS n FROM m WHERE role IN ('assistant', 'tool') GROUP BY 1, 2
), j AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.id, r.id) AS call_id, c.conv_id IS NOT NULL AS called, c.name, c.turn, r.turn AS result_turn,
         greatest(coalesce(c.n, 0), coalesce(r.n, 0)) AS copies, c.text AS asked, r.text AS told,
         c.turn >= 2 AND NOT EXISTS (SELECT 1 FROM c AS d WHERE d.conv_id = c.conv_id AND d.turn = c.turn - 2) AS gone
  FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.id = r.id
)
SELECT conv_id, call_id, CASE WHEN called THEN 'call' ELSE 'orphan' END AS kind, name, coalesce(turn, result_turn)::BIGINT AS turn, 0::BIGINT AS place,
       CASE WHEN called THEN 0 END::INTEGER AS round, result_turn, copies::BIGINT AS copies,
       called AND NOT gone AND asked <> '' AND turn >= 0 AS valid,
       CASE WHEN NOT called THEN 'result without call' ELSE concat_ws('; ', CASE WHEN gone THEN 'dependency ' || conv_id || ':' || (turn - 2) || ': missing' END,
         CASE WHEN asked = '' THEN '$.text: length' END, CASE WHEN turn < 0 THEN '$.turn: out of bounds' END) END AS errors,
       CASE WHEN called THEN '{"arguments":{"text":' || to_json(asked)::VARCHAR || ',"turn":' || turn || '},"id":' || to_json(call_id)::VARCHAR || ',"name":' || to_json(name)::VARCHAR || ','
            ELSE '{"id":' || to_json(call_id)::VARCHAR || ',' END || '"result":' || coalesce(to_json(told)::VARCHAR, 'null') || '}' AS canonical
FROM j
"""

#: DuckDB, for the exchanges written as tool messages: rounds count from the end of each run of calls two turns apart.
ORDER_ORACLE = """
WITH c AS (
  SELECT conv_id, turn, 'c' || turn AS id, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name, text,
         turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM conversations WHERE role IN ('user', 'system')
), k AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, run ORDER BY turn DESC) AS place FROM c
), o AS (SELECT *, max(place) OVER (PARTITION BY conv_id) > 1 AS late FROM k
), r AS (SELECT conv_id, turn, 'c' || (turn - 1) AS id, text FROM conversations WHERE role NOT IN ('user', 'system'))
SELECT coalesce(o.conv_id, r.conv_id) AS conv_id, coalesce(o.id, r.id) AS call_id, CASE WHEN o.id IS NULL THEN 'orphan' ELSE 'call' END AS kind, o.name,
       coalesce(o.turn, r.turn) AS turn, CASE WHEN o.id IS NOT NULL THEN CASE WHEN late THEN place ELSE 0 END END::INTEGER AS round, r.turn AS result_turn,
       o.id IS NOT NULL AND place > 1 AND o.text <> '' AS valid, to_json(r.text)::VARCHAR AS result
FROM o FULL JOIN r ON o.conv_id = r.conv_id AND o.id = r.id
"""
