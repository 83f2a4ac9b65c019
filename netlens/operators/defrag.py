"""IP defragmentation.

Only fragments are shuffled, by (source, destination, identification, protocol), and run
through an assembler in order of arrival; its state is one datagram. The fragment that
completes a datagram brings the rebuilt one. Earlier bytes win where fragments overlap.
Frames that are plainly no fragments are told by expressions and never read for this.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.operators import headers


@dataclass(frozen=True)
class Options:
    """Limits of reassembly. A datagram that is not whole ``timeout`` after its first fragment is dropped.

    With ``per_source_bytes``, a source that holds more than that in unfinished datagrams loses the
    oldest of them until it does not, and the fragment that came if none is left. With ``total_bytes``
    the same holds for all sources together; the total is divided among ``slices`` by the hash of the
    source, each with a task of its own. Without limits a task holds one datagram at a time.
    """

    timeout_v4_us: int = 30_000_000
    timeout_v6_us: int = 60_000_000
    most_bytes: int = 65535
    per_source_bytes: int | None = None
    total_bytes: int | None = None
    slices: int = 16


class Datagram:
    """Pieces of one datagram."""

    def __init__(self, most: int = 65535):
        self.most, self.end, self.parts = most, None, []  # parts: (start, bytes), sorted, without overlap

    def add(self, start: int, more: bool, data: bytes) -> bytes | None:
        """The payload once it is whole."""
        stop = start + len(data)
        if stop > self.most or (self.end is not None and (stop > self.end or not more)):
            return None
        if not more:
            if any(s + len(x) > stop for s, x in self.parts):
                return None
            self.end = stop
        merged, at = [], start
        for s, x in self.parts:
            if at < s and at < stop:
                merged.append((at, data[at - start : min(stop, s) - start]))
            merged.append((s, x))
            at = max(at, s + len(x))
        if at < stop:
            merged.append((at, data[at - start :]))
        self.parts = sorted((p for p in merged if p[1]), key=lambda p: p[0])
        if self.end is None:
            return None
        at = 0
        for s, x in self.parts:
            if s != at:
                return None
            at += len(x)
        return b"".join(x for _, x in self.parts) if at == self.end else None


def rebuilt(version: int, src: bytes, dst: bytes, proto: int, payload: bytes) -> bytes:
    """An IP packet that is not a fragment."""
    if version == 4:
        return b"\x45\0" + (20 + len(payload)).to_bytes(2, "big") + bytes(4) + b"\x40" + bytes([proto]) + bytes(2) + src + dst + payload
    return b"\x60" + bytes(3) + len(payload).to_bytes(2, "big") + bytes([proto]) + b"\x40" + src + dst + payload


def reassemble(dissected: DataFrame, options: Options | None = None) -> DataFrame:
    """(ord, ts_us, dlt, pkt[, file]): datagrams made of the fragments in ``dissected`` (status 1), as RAW packets."""
    options = options or Options()
    key = F.struct("l3_version", "src", "dst", "frag_id", "frag_proto")
    with_file = ["file"] if "file" in dissected.columns else []
    pieces = dissected.where("is_fragment AND status = 1").select("ord", "ts_us", *with_file, key.alias("k"), "frag_offset", "frag_more", "payload")
    if options.total_bytes is not None:
        pieces = pieces.withColumn("group", F.pmod(F.xxhash64("k.src"), F.lit(options.slices)))
    else:
        pieces = pieces.withColumn("group", F.col("k") if options.per_source_bytes is None else F.struct("k.l3_version", "k.src"))
    # the window states by what, and in which order, rows must lie, and tells where a group begins
    pieces = pieces.withColumn("place", F.row_number().over(Window.partitionBy("group").orderBy("ord"))).drop("group")
    names = ["ord", "ts_us", "k", "frag_offset", "frag_more", "payload", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(options)
        for batch in (part for whole in batches for part in headers.blocks(whole, "payload")):
            out, at = [], []
            rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True)
            for i, (o, ts, k, start, more, data, place) in enumerate(rows):
                if place == 1:
                    held = _Held(options)
                found = held.add(ts, k, start, more, data or b"")
                if found is not None:
                    at.append(i)
                    out.append((o, ts, "RAW", rebuilt(k["l3_version"], k["src"], k["dst"], k["frag_proto"], found)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)]
            columns += [batch.column(batch.schema.get_field_index(c)).take(pa.array(at, pa.int64())) for c in with_file]
            yield pa.RecordBatch.from_arrays(columns, ["ord", "ts_us", "dlt", "pkt", *with_file])

    return pieces.mapInArrow(run, "ord long, ts_us long, dlt string, pkt binary" + ", file string" * len(with_file))


class _Held:
    """Unfinished datagrams of a group, oldest first, and what they hold by source."""

    def __init__(self, options: Options):
        self.options, self.whole, self.used = options, {}, {}  # key: (time it expires, bytes, datagram)

    def _drop(self, key: tuple) -> None:
        _, size, _ = self.whole.pop(key)
        self.used[key[:2]] -= size

    def add(self, ts: int, k: dict, start: int, more: bool, data: bytes) -> bytes | None:
        options = self.options
        key = (k["l3_version"], k["src"], k["dst"], k["frag_id"], k["frag_proto"])
        source, limit = key[:2], options.per_source_bytes
        if limit is not None and self.used.get(source, 0) > limit:
            for old in [x for x in self.whole if x[:2] == source]:
                if self.used[source] <= limit:
                    break
                self._drop(old)
            if not any(x[:2] == source for x in self.whole):
                return None
        timeout = options.timeout_v4_us if key[0] == 4 else options.timeout_v6_us
        share = None if options.total_bytes is None else -(-options.total_bytes // options.slices)
        while self.whole and ((oldest := next(iter(self.whole.items())))[1][0] < ts or (share is not None and sum(self.used.values()) >= share)):
            self._drop(oldest[0])
        if key in self.whole and self.whole[key][0] < ts:
            self._drop(key)
        expires, size, datagram = self.whole.get(key) or (ts + timeout, 0, Datagram(options.most_bytes))
        found = datagram.add(start, more, data)
        held = sum(len(x) for _, x in datagram.parts)
        self.whole[key] = (expires, held, datagram)
        self.used[source] = self.used.get(source, 0) + held - size
        if found is not None:
            self._drop(key)
        return found


def maybe_fragment(packets: DataFrame) -> DataFrame:
    """Without the Ethernet frames that are plainly no fragments: IPv4 that has no fragment bits or tunnel, IPv6 that begins with TCP or UDP."""
    at = lambda off, n: headers.number("pkt", off, n)
    plain4 = (at(12, 2) == 0x0800) & (at(20, 2) % 0x4000 == 0) & ~at(23, 1).isin(4, 41)
    plain6 = (at(12, 2) == 0x86DD) & at(20, 1).isin(6, 17)
    return packets.where(~F.coalesce((F.col("dlt") == "EN10MB") & (plain4 | plain6), F.lit(False)))


def dissect(packets: DataFrame, options: Options | None = None) -> DataFrame:
    """Dissection of whole packets and of rebuilt datagrams (status 2); fragments stay with status 1. ``file`` is kept where it is given."""
    own = packets.select("ord", "ts_us", "dlt", "pkt", *(["file"] if "file" in packets.columns else []))
    again = headers.dissect(reassemble(headers.dissect(maybe_fragment(own)), options), "L3")
    again = again.withColumn("status", F.when(F.col("status") == 0, 2).otherwise(F.col("status")))
    return headers.dissect(own).unionByName(again)
