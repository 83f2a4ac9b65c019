"""L2, L3 and L4 headers of packets.

``dissect`` reads any packet: it works on whole Arrow batches of bytes at once and
steps all packets of a batch through tags, extension headers and tunnels together, so
there is no loop over rows. ``ethernet_ip`` states the common case (Ethernet with up to
two VLAN tags, plain IPv4 or IPv6, TCP or UDP) as Column expressions, which stay in
generated code and let filters on headers reach below them.

Bad packets keep their row and get a negative ``status``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens import catalog

SCHEMA = (
    "status int, l2_length int, src_mac binary, dst_mac binary, l3_version int, l3_offset int, l3_length int, src binary, dst binary, "
    "is_fragment boolean, frag_offset int, frag_more boolean, frag_id long, frag_proto int, proto int, l4_offset int, l4_length int, "
    "sport int, dport int, seq long, ack long, tcp_flags int, tcp_window int, tcp_window_scale int, l4_bytes int, payload_length int, payload binary"
)
_MAX_STEPS = 32


class _Bytes:
    """The packets of a batch, end to end, with reads at an offset of every packet; beyond its end a packet reads as zero."""

    def __init__(self, column: pa.Array):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.fill_null(b"") if column.null_count else column
        wide = pa.types.is_large_binary(column.type)
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        self.at, self.size = ends[:-1], np.diff(ends)

    def u8(self, off: np.ndarray) -> np.ndarray:
        ok = (off >= 0) & (off < self.size)
        return np.where(ok, self.data[np.where(ok, self.at + off, 0)], 0).astype(np.int64)

    def be(self, off: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(len(self.at), np.int64)
        for i in range(n):
            out = out << 8 | self.u8(off + i)
        return out

    def cut(self, off: np.ndarray, n: np.ndarray, keep: np.ndarray) -> pa.Array:
        """Bytes [off, off + n) of each kept packet, null for the others. Takes some 30 bytes for each of them meanwhile."""
        n = np.where(keep, np.clip(np.minimum(n, self.size - off), 0, None), 0)
        starts, ends = self.at + off, np.concatenate([[0], np.cumsum(n)])
        index = np.repeat(starts - ends[:-1], n) + np.arange(ends[-1])
        valid = pa.array(keep).buffers()[1] if len(keep) else None
        return pa.Array.from_buffers(pa.binary(), len(n), [valid, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(self.data[index].tobytes())], int((~keep).sum()))


def _l2(b: _Bytes, dlt: list[str | None], status: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of the link header and its ethertype (0 where the link type has none)."""
    n = len(b.at)
    names = np.array([d or "" for d in dlt], object)
    zero = np.zeros(n, np.int64)
    length, kind = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for name, fixed in catalog.L2_LENGTH.items():
        length[names == name] = fixed
    eth = names == "EN10MB"
    kind = np.where(eth, b.be(zero + 12, 2), kind)
    sll = names == "LINUX_SSL"
    kind = np.where(sll, b.be(zero + 14, 2), kind)
    llc = eth & (kind <= 1500)
    snap = llc & (b.u8(zero + 14) == 0xAA)
    length = np.where(snap, 22, length)
    kind = np.where(snap, b.be(zero + 20, 2), np.where(llc, 0, kind))
    # 802.11: only data frames with an LLC/SNAP header carry packets
    radio, wifi = names == "IEEE802_11_RADIO", names == "IEEE802_11"
    either = radio | wifi
    if either.any():
        tap = np.where(radio, b.u8(zero + 2) | b.u8(zero + 3) << 8, 0)
        control = b.u8(tap)
        qos = (control & 0x80) != 0
        header = tap + 24 + np.where(qos, 2, 0)
        data_frame = ((control >> 2) & 3) == 2
        bad_fcs = radio & ((b.u8(zero + 4) & 2) != 0) & ((b.u8(zero + 16) & 0x40) != 0)
        good = either & data_frame & ~bad_fcs & (b.u8(header) == 0xAA)
        length = np.where(either, np.where(good, header + 8, -1), length)
        kind = np.where(good, b.be(header + 6, 2), kind)
    for _ in range(4):  # tags may nest
        tagged = np.isin(kind, (0x8100, 0x88A8)) & (length >= 0)
        if not tagged.any():
            break
        kind = np.where(tagged, b.be(length + 2, 2), kind)
        length = np.where(tagged, length + 4, length)
    labelled = np.isin(kind, (0x8847, 0x8848)) & (length >= 0)
    for _ in range(_MAX_STEPS):
        if not labelled.any():
            break
        bottom = (b.u8(length + 2) & 1) == 1
        length = np.where(labelled, length + 4, length)
        kind = np.where(labelled & bottom, 0, kind)
        labelled = labelled & ~bottom & (length < b.size)
    status[(length < 0) | (length > b.size)] = -7
    other = (kind != 0) & ~np.isin(kind, (0x0800, 0x86DD)) & (eth | sll | either) & (status == 0)
    status[other] = -1
    return length, kind


def _addresses(b: _Bytes, at4: np.ndarray, at6: np.ndarray, version: np.ndarray, ok: np.ndarray) -> pa.Array:
    return b.cut(np.where(version == 4, at4, at6), np.where(version == 4, 4, 16), ok)


def parse(packets: pa.Array, dlt: list[str | None], start: str = "L2") -> dict[str, pa.Array | np.ndarray]:
    """Columns of ``SCHEMA`` for a batch of packets."""
    b = _Bytes(packets)
    n = len(b.at)
    zero, status = np.zeros(n, np.int64), np.zeros(n, np.int64)
    l2 = zero
    if start == "L2":
        l2, _ = _l2(b, dlt, status)
    off = l2.copy()
    empty = (b.size - off <= 0) & (status == 0)
    live = (status == 0) & ~empty
    version, proto = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    src, dst, end = off.copy(), off.copy(), b.size.copy()
    fragment, frag_off, frag_more, frag_id, frag_proto = np.zeros(n, bool), zero.copy(), np.zeros(n, bool), zero.copy(), zero.copy()
    outer, shown = off.copy(), zero.copy()
    want = np.where(live, -2, -1)  # -2: an IP header is next; -1: done; else the next header of an IPv6 chain or an L4 protocol
    inner = np.zeros(n, bool)
    for _ in range(_MAX_STEPS):
        head = want == -2
        if not head.any() and not (want >= 0).any():
            break
        if head.any():
            v = b.u8(off) >> 4
            four, six = head & (v == 4), head & (v == 6)
            status[head & ~four & ~six] = -1
            want[head & ~four & ~six] = -1
            ihl, total, left = (b.u8(off) & 15) * 4, b.be(off + 2, 2), end - off
            bad = four & ((left < 20) | (total > left) | (total <= ihl) | (ihl < 20))
            status[bad], want[bad] = -6, -1
            four &= ~bad
            end = np.where(four, off + total, end)
            piece, more = (b.be(off + 6, 2) & 0x1FFF) * 8, (b.be(off + 6, 2) & 0x2000) != 0
            cut = four & ((piece > 0) | more) & ~inner
            src, dst = np.where(four, off + 12, np.where(six, off + 8, src)), np.where(four, off + 16, np.where(six, off + 24, dst))
            shown = np.where(four, 4, np.where(six, 6, shown))
            version = np.where(head & (four | six), np.where(four, 4, 6), version)
            fragment |= cut
            frag_off, frag_more = np.where(cut, piece, frag_off), np.where(cut, more, frag_more)
            frag_id, frag_proto = np.where(cut, b.be(off + 4, 2), frag_id), np.where(cut, b.u8(off + 9), frag_proto)
            bad = six & ((left < 40) | (b.be(off + 4, 2) + 40 > left))
            status[bad], want[bad] = -6, -1
            six &= ~bad
            end = np.where(six, off + 40 + b.be(off + 4, 2), end)
            following = np.where(four, b.u8(off + 9), b.u8(off + 6))
            step = np.where(four, ihl, 40)
            go = four | six
            want = np.where(go, following, want)
            off = np.where(go, off + step, off)
            want[cut] = -1
            status[cut] = 1
        chain = want >= 0
        options = chain & np.isin(want, (0, 43, 60))
        wrong = options & (version != 6)
        status[wrong], want[wrong] = -3, -1
        options &= ~wrong
        piece6 = chain & (want == 44)
        wrong = piece6 & (version != 6)
        status[wrong], want[wrong] = -3, -1
        piece6 &= ~wrong
        tunnel = chain & np.isin(want, (4, 41))
        final = chain & ~options & ~piece6 & ~tunnel & (want >= 0)
        size = 8 + b.u8(off + 1) * 8
        want = np.where(options, b.u8(off), want)
        off = np.where(options, off + size, off)
        if piece6.any():
            both = b.be(off + 2, 2)
            fragment |= piece6
            frag_off, frag_more = np.where(piece6, both & 0xFFF8, frag_off), np.where(piece6, (both & 1) == 1, frag_more)
            frag_id, frag_proto = np.where(piece6, b.be(off + 4, 4), frag_id), np.where(piece6, b.u8(off), frag_proto)
            off = np.where(piece6, off + 8, off)
            whole = piece6 & ~frag_more & (frag_off == 0)  # an atomic fragment is a datagram
            fragment &= ~whole
            want = np.where(whole, frag_proto, want)
            rest = piece6 & ~whole
            status[rest], want[rest] = 1, -1
        want[tunnel] = -2
        inner |= tunnel
        beyond = (off > end) & (want != -1) & ~final
        status[beyond], want[beyond] = -6, -1
        proto = np.where(final, want, proto)
        want[final] = -1
    rest = want != -1
    status[rest] = -6
    ok3 = (version > 0) & np.isin(status, (0, 1))
    l4 = (proto >= 0) & (status == 0)
    left = end - off
    tcp, udp = l4 & (proto == 6), l4 & (proto == 17)
    doff = (b.u8(off + 12) >> 4) * 4
    bad = (tcp & ((left < 20) | (doff > left) | (doff < 20))) | (udp & ((left < 8) | (b.be(off + 4, 2) > left)))
    status[bad] = -5
    l4, tcp, udp = l4 & ~bad, tcp & ~bad, udp & ~bad
    l4_length = np.where(tcp, doff, np.where(udp, 8, left))
    payload = np.where(l4, left - l4_length, 0)
    ports = tcp | udp
    scale = np.full(n, -1, np.int64)
    todo, at = tcp & (doff > 20), off + 20
    for _ in range(40):  # TCP options
        todo = todo & (at < off + doff)
        if not todo.any():
            break
        kind, size = b.u8(at), b.u8(at + 1)
        scale = np.where(todo & (kind == 3) & (size == 3), b.u8(at + 2), scale)
        todo = todo & (kind != 0) & ((kind == 1) | (size >= 2))
        at = np.where(todo, at + np.where(kind == 1, 1, size), at)

    def number(x: np.ndarray, keep: np.ndarray, kind=pa.int32()) -> pa.Array:
        return pa.array(x, kind, mask=~keep)

    eth = np.array([d == "EN10MB" for d in dlt], bool) & (b.size >= 14) & (start == "L2")
    ok2 = status != -7
    return {
        "status": pa.array(status, pa.int32()), "l2_length": number(l2, ok2), "src_mac": b.cut(zero + 6, zero + 6, eth), "dst_mac": b.cut(zero, zero + 6, eth),
        "l3_version": number(shown, ok3 | l4), "l3_offset": number(outer, ok2), "l3_length": number(off - outer, ok3),
        "src": b.cut(src, np.where(shown == 4, 4, 16), (shown > 0) & ok3), "dst": b.cut(dst, np.where(shown == 4, 4, 16), (shown > 0) & ok3),
        "is_fragment": pa.array(fragment), "frag_offset": number(frag_off, fragment), "frag_more": pa.array(frag_more, mask=~fragment),
        "frag_id": number(frag_id, fragment, pa.int64()), "frag_proto": number(frag_proto, fragment),
        "proto": number(proto, l4), "l4_offset": number(off, ok3), "l4_length": number(l4_length, l4),
        "sport": number(np.where(ports, b.be(off, 2), 0), l4), "dport": number(np.where(ports, b.be(off + 2, 2), 0), l4),
        "seq": number(b.be(off + 4, 4), tcp, pa.int64()), "ack": number(b.be(off + 8, 4), tcp, pa.int64()),
        "tcp_flags": number(b.u8(off + 13), tcp), "tcp_window": number(b.be(off + 14, 2), tcp),
        "tcp_window_scale": number(scale, tcp & (scale >= 0)), "l4_bytes": number(left, l4), "payload_length": number(payload, l4),
        "payload": b.cut(np.where(fragment, off, off + l4_length), np.where(fragment, left, payload), l4 | (fragment & (status == 1))),
    }


#: Bytes of packets that are worked on at once.
BLOCK_BYTES = 1 << 20


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``most`` bytes of a BINARY column, but for single rows above that: Spark's batches may hold 64 MB."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def dissect(packets: DataFrame, start: str = "L2") -> DataFrame:
    """Adds the columns of ``SCHEMA`` to packets(ord, ts_us, dlt, pkt, ...). ``start``: the layer at which ``pkt`` begins (L2 or L3)."""
    if start not in ("L2", "L3"):
        raise ValueError(start)
    own = packets if "dlt" in packets.columns else packets.withColumn("dlt", F.lit("EN10MB"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields), SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in blocks(whole, "pkt")):
            get = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            found = parse(get("pkt"), get("dlt").to_pylist(), start)
            yield pa.RecordBatch.from_arrays([*batch.columns, *found.values()], [*batch.schema.names, *found])

    return own.mapInArrow(run, schema)


def number(column: Column | str, off, n: int) -> Column:
    """Unsigned big-endian integer of ``n`` bytes at a byte offset."""
    off = F.lit(off) if isinstance(off, int) else off
    return F.conv(F.hex(F.substring(column, off + 1, F.lit(n))), 16, 10).cast("long")


def ethernet_ip(packets: DataFrame) -> DataFrame:
    """Header columns of the common case, as expressions: Ethernet (0-2 VLAN tags), IPv4 or IPv6 without extension headers, TCP or UDP.

    Rows that need more have a null ``proto``; give them to ``dissect``.
    """
    p = F.col("pkt")
    kind = lambda off: number(p, off, 2)
    one, two = kind(12) == 0x8100, (kind(12) == 0x8100) & (kind(16) == 0x8100)
    rows = packets.withColumn("l2_length", F.when(two, 22).when(one, 18).otherwise(14))
    off = F.col("l2_length")
    rows = rows.withColumn("l3_version", F.shiftright(number(p, off, 1), 4).cast("int"))
    four, six = F.col("l3_version") == 4, F.col("l3_version") == 6
    rows = rows.withColumn("ihl", F.when(four, (number(p, off, 1) % 16) * 4).when(six, F.lit(40)).cast("int"))
    total = F.when(four, number(p, off + 2, 2)).otherwise(number(p, off + 4, 2) + 40)
    left = F.length(p) - off
    plain = F.when(four, (total <= left) & (total > F.col("ihl")) & (F.col("ihl") >= 20) & (number(p, off + 6, 2) % 0x4000 == 0)).when(six, total <= left)
    proto = F.when(plain, F.when(four, number(p, off + 9, 1)).otherwise(number(p, off + 6, 1)))
    rows = rows.withColumn("proto", F.when(proto.isin(6, 17), proto).cast("int")).withColumn("l4_offset", off + F.col("ihl")).withColumn("l4_bytes", (total - F.col("ihl")).cast("int"))
    size = F.when(four, F.lit(4)).otherwise(F.lit(16))
    rows = rows.withColumn("src", F.substring(p, off + F.when(four, 13).otherwise(9), size)).withColumn("dst", F.substring(p, off + F.when(four, 17).otherwise(25), size))
    at, tcp = F.col("l4_offset"), F.col("proto") == 6
    rows = rows.withColumn("l4_length", F.when(tcp, F.shiftright(number(p, at + 12, 1), 4) * 4).when(F.col("proto") == 17, F.lit(8)).cast("int"))
    good = F.when(tcp, (F.col("l4_length") >= 20) & (F.col("l4_length") <= F.col("l4_bytes"))).otherwise((F.col("l4_bytes") >= 8) & (number(p, at + 4, 2) <= F.col("l4_bytes")))
    return rows.withColumns({
        "status": F.when(F.col("proto").isNotNull(), F.when(good, 0).otherwise(-5)),
        "sport": number(p, at, 2).cast("int"), "dport": number(p, at + 2, 2).cast("int"), "seq": F.when(tcp, number(p, at + 4, 4)), "ack": F.when(tcp, number(p, at + 8, 4)),
        "tcp_flags": F.when(tcp, number(p, at + 13, 1)).cast("int"), "tcp_window": F.when(tcp, number(p, at + 14, 2)).cast("int"),
        "l3_length": F.col("ihl"), "payload_length": (F.col("l4_bytes") - F.col("l4_length")).cast("int"),
        "payload": F.substring(p, at + F.col("l4_length") + 1, F.col("l4_bytes") - F.col("l4_length")),
    }).drop("ihl")


def dissect_segments(segments: DataFrame) -> DataFrame:
    """Dissection that begins at L4: ``pkt`` is a segment, and src, dst (4 or 16 bytes) and proto are given as columns."""
    size = F.length("pkt")
    two = lambda n: F.unhex(F.lpad(F.hex(n), 4, "0"))
    one = F.unhex(F.lpad(F.hex(F.col("proto")), 2, "0"))
    v4 = F.concat(F.unhex(F.lit("4500")), two(size + 20), F.unhex(F.lit("0000000040")), one, F.unhex(F.lit("0000")), "src", "dst", "pkt")
    v6 = F.concat(F.unhex(F.lit("60000000")), two(size), one, F.unhex(F.lit("40")), "src", "dst", "pkt")
    keep = [c for c in segments.columns if c not in ("src", "dst", "proto", "pkt", "dlt")]
    whole = segments.select(*keep, F.lit("RAW").alias("dlt"), F.when(F.length("src") == 4, v4).when(F.length("src") == 16, v6).alias("pkt"))
    return dissect(whole, "L3")
