"""TCP stream tracking: order, retransmissions and rebuilt payloads of one flow."""

from __future__ import annotations

from dataclasses import dataclass, field

#: How far ahead of the expected byte a segment may lie to be kept.
HORIZON = 32768
_M = 1 << 32


def ahead(a: int, b: int) -> int:
    """a - b on the circle of sequence numbers, in [-2^31, 2^31)."""
    return ((a - b + (1 << 31)) % _M) - (1 << 31)


@dataclass
class Tracker:
    """State of both directions; ``take`` gives the status of a segment and the payload that is now in order."""

    expected: list = field(default_factory=lambda: [None, None])
    highest_ack: list = field(default_factory=lambda: [None, None])
    last: list = field(default_factory=lambda: [None, None])
    fins: list = field(default_factory=lambda: [False, False])
    kept: list = field(default_factory=lambda: [{}, {}])
    syn: int | None = None
    syn_ack: bool = False
    established: bool = False

    @property
    def terminated(self) -> bool:
        return all(self.fins)

    def take(self, way: int, seq: int, ack: int, flags: int, payload: bytes) -> tuple[str, bytes]:
        syn, acks = flags & 2, flags & 16
        if self.established:
            return self._analyse(way, seq, ack, flags, payload)
        if syn and not acks and self.syn is None:
            self.syn, self.expected[way] = way, (seq + 1) % _M
            return "in_order", b""
        if syn and acks and self.syn is not None and not self.syn_ack:
            self.syn_ack, self.expected[way] = True, (seq + 1) % _M
            return "in_order", b""
        if acks and not syn and self.syn_ack:
            self.established = True
            return self._analyse(way, seq, ack, flags, payload)
        # begun in the middle: established once each side has acknowledged what the other sent
        end = (seq + (1 if syn else len(payload))) % _M
        if self.expected[way] is None or ahead(end, self.expected[way]) > 0:
            self.expected[way] = end
        if acks:
            self.highest_ack[way] = ack if self.highest_ack[way] is None or ahead(ack, self.highest_ack[way]) > 0 else self.highest_ack[way]
        if None not in self.expected and self.expected[0] == self.highest_ack[1] and self.expected[1] == self.highest_ack[0]:
            self.established = True
        return "out_of_order", b""

    def _analyse(self, way: int, seq: int, ack: int, flags: int, payload: bytes) -> tuple[str, bytes]:
        expected = self.expected[way]
        if expected is None:
            expected = self.expected[way] = seq
        far = ahead(seq, expected)
        if far == 0:
            if not payload and self.last[way] == (seq, ack) and not any(self.fins) and not flags & 7:
                return "retransmission", b""
            self.last[way] = (seq, ack)
            self.expected[way] = (seq + len(payload) + (flags & 1) + ((flags >> 2) & 1)) % _M
            self.fins[way] |= bool(flags & 1)
            rest = self._fill(way) if self.kept[way] else b""
            return ("rebuilt", payload + rest) if rest else ("in_order", payload)
        if far > 0:
            if far <= HORIZON and payload:
                old = self.kept[way].get(seq, b"")
                self.kept[way][seq] = max(old, payload, key=len)
            return "out_of_order", b""
        if -far < len(payload):  # its end is new
            fresh = payload[-far:]
            self.expected[way] = (expected + len(fresh)) % _M
            return "rebuilt", fresh + self._fill(way)
        return "retransmission", b""

    def _fill(self, way: int) -> bytes:
        """Kept segments that now connect; earlier bytes win."""
        out, kept = [], self.kept[way]
        while kept:
            seq = min(kept, key=lambda s: ahead(s, self.expected[way]))
            far = ahead(seq, self.expected[way])
            if far > 0:
                break
            part = kept.pop(seq)[-far:]
            out.append(part)
            self.expected[way] = (self.expected[way] + len(part)) % _M
        return b"".join(out)


def streams(rows):
    """ord, flow_id, dir, status, data of TCP packets in sessionized rows; ``data`` is what is now in order."""
    import pyarrow as pa

    from netlens.operators import flows, headers

    ordered = flows.with_place(rows.where("proto = 6")).select("ord", "flow_id", "dir", flows.PLACE, "seq", "ack", "tcp_flags", "payload")

    def run(batches):
        tracker = Tracker()
        for batch in (part for whole in batches for part in headers.blocks(whole, "payload")):
            statuses, data = [], []
            for way, place, seq, ack, flags, payload in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                if place == 1:
                    tracker = Tracker()
                status, fresh = tracker.take(way, seq, ack, flags, payload or b"")
                statuses.append(status)
                data.append(fresh)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(statuses, pa.string()), pa.array(data, pa.binary())], ["ord", "flow_id", "dir", "status", "data"])

    return ordered.mapInArrow(run, "ord long, flow_id long, dir int, status string, data binary")
