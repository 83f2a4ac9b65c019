"""Identification of application protocols, per flow and in order of arrival.

One pass over packets that lie by flow and in order (a window says so, so that the planner
keeps the distribution of ``flows.sessionize`` or makes it anew) keeps a small state for the
flow it is in: the protocols that are
still possible, those found so far, and what stateful dissectors remember. The protocols
found belong to the flow, so every later packet reports them too. With ``reorder``, TCP
payloads pass through the tracker of ``tcp`` first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens import catalog
from netlens.operators import dissectors as d
from netlens.operators import fieldwork, flows, headers
from netlens.operators.tcp import Tracker

SCHEMA = "protocols array<string>, tcp_status string, l7_length int, fields map<string,string>, http_headers array<struct<key:string,value:string>>"


@dataclass
class Config:
    protocols: tuple[str, ...] | None = None  # None: all
    fields: tuple[str, ...] = ()  # PROTOCOL_FIELD; only these are extracted
    max_trials: int = 0  # 0: no limit
    accuracy: str = "high"
    reorder: bool = True

    def tops(self) -> list[str]:
        inner = {c for cs in d.CHILDREN.values() for c in cs} - {"JSON_RPC", "MONERO"}
        return [n for n in d.ORDER if n in d.REGISTRY and n not in inner and (self.protocols is None or n in self.protocols)]


@dataclass
class Flow:
    candidates: list[str]
    stack: list[str] = field(default_factory=list)
    done: bool = False
    trials: int = 0
    packets: int = 0
    states: dict = field(default_factory=dict)
    seen_syn: bool = False
    tracker: Tracker | None = None
    work: dict = field(default_factory=dict)


def _rotated(names: list[str], p: d.Packet) -> list[str]:
    ports = catalog.TCP_PORTS if p.proto == 6 else catalog.UDP_PORTS
    hint = ports.get(p.sport) or ports.get(p.dport)
    if not hint:
        return names
    at = d.ORDER.index(hint)
    return sorted(names, key=lambda n: (d.ORDER.index(n) - at) % len(d.ORDER))


def guess(proto: int, sport: int, dport: int) -> str | None:
    ports = catalog.TCP_PORTS if proto == 6 else catalog.UDP_PORTS if proto == 17 else {}
    return ports.get(sport) or ports.get(dport)


def identify(flow: Flow, p: d.Packet, config: Config) -> None:
    """Advances the flow by one packet with payload."""
    while not flow.done:
        kept, hit = [], None
        for name in _rotated(flow.candidates, p):
            transport = d.TRANSPORT[name]
            if transport != "both" and transport != ("tcp" if p.proto == 6 else "udp"):
                continue
            outcome = d.REGISTRY[name](p, flow.states.setdefault(name, {}))
            if outcome == d.MATCH:
                hit = name
                break
            if outcome == d.MORE:
                kept.append(name)
        if hit is None:
            flow.candidates = kept
            break
        flow.stack.append(catalog.DISPLAY.get(hit, hit))
        fieldwork.prepare(hit, p, flow.work)
        flow.candidates = [c for c in d.CHILDREN.get(hit, ()) if config.protocols is None or c in config.protocols]
        if not flow.candidates:
            flow.done = True
    flow.trials += 1
    if not flow.done and (not flow.candidates or (config.max_trials and flow.trials >= config.max_trials)):
        flow.done = True
        if not flow.stack:
            found = guess(p.proto, p.sport, p.dport)
            flow.stack = [catalog.DISPLAY[found] if found else catalog.UNKNOWN]


def classify(rows: DataFrame, config: Config | None = None) -> DataFrame:
    """Adds the columns of ``SCHEMA`` to sessionized packets; their frames (``pkt``) are left behind, so they are not shuffled.

    tcp_status: in_order, rebuilt, out_of_order, retransmission, or null where there is no tracking.
    """
    config = config or Config()
    wanted = fieldwork.expanded(config.fields)
    rows = rows.drop("pkt")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), SCHEMA])
    ordered = flows.with_place(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, flow = config.tops(), Flow([])
        pairs = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
        for batch in (part for whole in batches for part in headers.blocks(whole, "payload")):
            get = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: E731, B023
            stacks, statuses, lengths, fields, pairs_found = [], [], [], [], []
            read = (flows.PLACE, "dir", "proto", "sport", "dport", "src", "dst", "payload", "tcp_flags", "seq", "ack")
            for place, way, proto, sport, dport, src, dst, payload, flags, seq, ack in zip(*map(get, read), strict=True):
                if place == 1:
                    flow = Flow(list(tops))
                payload, status, found = payload or b"", None, {}
                if proto == 6:
                    flow.seen_syn |= bool(flags & 2)
                    if config.reorder:
                        flow.tracker = flow.tracker or Tracker()
                        status, payload = flow.tracker.take(way, seq, ack, flags, payload)
                if payload and proto in (6, 17):
                    flow.packets += 1
                    p = d.Packet(payload, proto, sport, dport, src, dst, way, flow.seen_syn, flow.packets, config.accuracy)
                    known = len(flow.stack)
                    if known:
                        for name in flow.stack:
                            fieldwork.prepare(name, p, flow.work)
                    if not flow.done:
                        identify(flow, p, config)
                    if wanted:
                        found = fieldwork.extract(flow.stack, p, flow.work, wanted)
                stacks.append(list(flow.stack))
                statuses.append(status)
                lengths.append(len(payload))
                pairs_found.append(found.pop("HTTP_HEADERS", None))
                fields.append(list(found.items()))
            listed = [None if x is None else [{"key": k, "value": v} for k, v in x] for x in pairs_found]
            added = [
                pa.array(stacks, pa.list_(pa.string())), pa.array(statuses, pa.string()), pa.array(lengths, pa.int32()),
                pa.array(fields, pa.map_(pa.string(), pa.string())), pa.array(listed, pairs),
            ]
            kept = [c for c in batch.schema.names if c != flows.PLACE]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *added], [*kept, "protocols", "tcp_status", "l7_length", "fields", "http_headers"])

    return ordered.mapInArrow(run, schema)


def tagged(rows: DataFrame, rules: dict[str, DataFrame], config: Config | None = None) -> DataFrame:
    """``classify`` with ``tags``: of each packet those of its fields by the rules of a field, in the order of fields, 128 at most.

    Rules of a field imply that it is extracted. ``HTTP_HEADERS`` is looked up by the key of its rules.
    """
    from netlens.operators import tags

    config = config or Config()
    found = classify(rows, replace(config, fields=tuple(dict.fromkeys([*config.fields, *rules]))))
    order = [f"{p}_{f}" for p, f, _ in catalog.fields()]
    parts = []
    for name, own in rules.items():
        if name == "HTTP_HEADERS":
            part = tags.of_pairs(found.where("http_headers is not null"), own, "http_headers", ["ord"])
            part = part.select("ord", F.posexplode("tags").alias("at", "tag"))
        else:
            values = found.select("ord", F.col("fields")[name].alias("value")).where("value is not null")
            part = tags.lookup(values, own, "value", ["ord"]).select("ord", F.lit(0).alias("at"), "tag")
        parts.append(part.select("ord", F.lit(order.index(name)).alias("field"), "at", "tag"))
    each = reduce(DataFrame.unionByName, parts)
    listed = F.array_sort(F.collect_list(F.struct("field", "at", "tag")))  # of one packet
    by_packet = each.groupBy("ord").agg(F.slice(F.transform(listed, lambda x: x["tag"]), 1, tags.MOST_TAGS).alias("tags"))
    return found.join(by_packet, "ord", "left")


def protocol_counts(classified: DataFrame) -> DataFrame:
    """Packets per protocol of the stack; those of flows without one count as unknown."""
    shown = F.when(F.size("protocols") > 0, F.col("protocols")).otherwise(F.array(F.lit(catalog.UNKNOWN)))
    return classified.select(F.explode(shown).alias("protocol")).groupBy("protocol").agg(F.count("*").alias("packets"))


def header(name: str):
    """First value of an HTTP header of ``http_headers``, whatever the case of its name."""
    return F.get(F.filter("http_headers", lambda h: F.lower(h["key"]) == name.lower()), 0)["value"]


def has_protocol(name: str):
    """Whether the stack of a packet holds a protocol, by either of its names."""
    i = catalog.l7_id(name)
    return F.array_contains("protocols", catalog.L7[i][1] if i < len(catalog.L7) else name)


def bodies(classified: DataFrame, content_type: str) -> DataFrame:
    """ord, flow_id and body (BINARY) of HTTP messages of a content type; needs the fields HTTP_BODY and HTTP_HEADERS."""
    found = classified.where(F.lower(header("content-type")).startswith(content_type.lower()))
    return found.select("ord", "flow_id", F.encode(F.col("fields")["HTTP_BODY"], "ISO-8859-1").alias("body")).where(F.col("body").isNotNull())


_SQL_TYPES = {"N": "bigint", "S": "string"}


def typed(classified: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Adds a STRUCT column for each protocol of ``fields`` (PROTOCOL_FIELD), in lower case: numbers as BIGINT, bodies as BINARY, headers as pairs.

    A struct is null where none of its fields was found.
    """
    kinds = {f"{p}_{f}": (p, f, t) for p, f, t in catalog.fields()}
    columns: dict[str, list] = {}
    for name in fields:
        protocol, field_, kind = kinds[name]
        raw = F.col("fields")[name]
        if kind == "M":
            value = F.col("http_headers")
        elif field_ == "BODY":
            value = F.encode(raw, "ISO-8859-1")
        else:
            value = raw.cast(_SQL_TYPES[kind])
        columns.setdefault(protocol.lower(), []).append(value.alias(field_.lower()))
    found = {p: F.when(reduce(or_, [c.isNotNull() for c in cs]), F.struct(*cs)) for p, cs in columns.items()}
    return classified.withColumns(found)
