"""Flows of a packet stream.

``track`` keeps a few numbers per live flow in the state store and gives every packet its
flow and direction, by the same rule as ``flows.sessionize`` in batch; ``flow_records`` gives
each flow when it ends. State goes when its flow has been idle for long enough by event time,
so it holds the flows of the last minutes and not all that ever were. ``sessions`` sums up
flows with Spark's session windows, where order does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netlens.operators import flows

OUTPUT = "ord long, seg int, flow_id long, dir int, packets long, bytes long"
_STATE = "last long, seg int, flow_id long, src long, sport int, rst boolean, packets long, bytes long"


def _key():
    """Text of a flow key: both ends in order, and the protocol."""
    a, b = F.struct("src", "sport"), F.struct("dst", "dport")
    text = lambda ip, port: F.concat_ws(":", F.col(ip), F.col(port))
    return F.when(a <= b, F.concat_ws("|", text("src", "sport"), text("dst", "dport"), "proto")).otherwise(F.concat_ws("|", text("dst", "dport"), text("src", "sport"), "proto"))


def _timed(packets: DataFrame, delay_us: int) -> DataFrame:
    """With the flow key, and the event time that lets the state of idle flows go (a millisecond on, since time 0 counts as late from the start)."""
    return packets.withColumns({"key": _key(), "ts": F.timestamp_micros(F.col("ts_us") + 1000)}).withWatermark("ts", f"{max(1, delay_us // 1000)} milliseconds")


def _until(state: GroupState, last_us: int, idle_us: int) -> None:
    """Sets the time at which the flow has been idle for long enough; it must lie behind the watermark."""
    state.setTimeoutTimestamp(max(-(-(last_us + idle_us) // 1000), state.getCurrentWatermarkMs()) + 2)


def _breaks(rows: pd.DataFrame, last: int | None, rst: bool, idle_us: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of the packets of a key in order: where a flow begins, where because of a pause, and whether an RST waits for a SYN at the end.

    ``last`` is the time of the packet before (None where there is none), ``rst`` whether an RST waits.
    """
    ts, flags, tcp = rows["ts_us"].to_numpy(np.int64), rows["flags"].to_numpy(np.int64), rows["proto"].to_numpy(np.int64) == 6
    syn, reset = tcp & (flags & flows.SYN != 0), tcp & (flags & flows.RST != 0)
    idle = np.diff(ts, prepend=ts[0] if last is None else last) > idle_us
    latest = lambda test: np.maximum.accumulate(np.where(test, np.arange(len(ts)), -1))
    set_at, cleared_at = latest(reset), latest(syn | idle)
    waits = np.where(np.maximum(set_at, cleared_at) < 0, rst, (set_at >= 0) & (set_at >= cleared_at))
    begins = idle | (syn & np.concatenate([[rst], waits[:-1]]))
    begins[0] |= last is None
    return begins, idle, bool(waits[-1])


def track(packets: DataFrame, idle_us: int = flows.IDLE_US) -> DataFrame:
    """Streaming (ord, ts_us, src, sport, dst, dport, proto, flags, size), addresses as numbers, to ``OUTPUT``: the running counts of each packet's flow.

    The state of a key is dropped when the watermark (``idle_us`` behind the latest packet) passes
    the time at which its flow ends by idleness; ``seg`` then counts from 0 again, ``flow_id`` still
    tells flows apart. Packets that come later than the watermark are dropped, as late data is.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, seg, flow, src, sport, rst, n, size = state.get if state.exists else (None, -1, 0, 0, 0, False, 0, 0)
        rows = pd.concat(list(frames)).sort_values("ord")
        begins, _, rst = _breaks(rows, last, rst, idle_us)
        first, which = np.flatnonzero(begins), np.cumsum(begins)  # 0 is the flow of the state
        own = lambda kept, values: np.concatenate([[kept], values[first]])[which]
        ords, sizes, at = rows["ord"].to_numpy(np.int64), rows["size"].to_numpy(np.int64), np.arange(len(rows))
        flow_ids = own(flow, ords)
        srcs, sports = own(src, rows["src"].to_numpy(np.int64)), own(sport, rows["sport"].to_numpy(np.int64))
        back = (rows["src"].to_numpy(np.int64) != srcs) | (rows["sport"].to_numpy(np.int64) != sports)
        counts, total = at + 1 - own(-n, at), np.cumsum(sizes)
        sums = total - own(-size, total - sizes)
        state.update((int(rows["ts_us"].iloc[-1]), int(seg + which[-1]), int(flow_ids[-1]), int(srcs[-1]), int(sports[-1]), rst, int(counts[-1]), int(sums[-1])))
        _until(state, int(rows["ts_us"].iloc[-1]), idle_us)
        yield pd.DataFrame({"ord": ords, "seg": seg + which, "flow_id": flow_ids, "dir": back.astype(int), "packets": counts, "bytes": sums})

    return _timed(packets, idle_us).groupBy("key").applyInPandasWithState(step, OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


RECORD = (
    "flow_id long, src string, sport int, dst string, dport int, proto int, packets_0 long, packets_1 long, bytes_0 long, bytes_1 long, first_us long, last_us long, reason string"
)


def _ended(flow: list, rst: bool, rows: pd.DataFrame, idle_us: int) -> tuple[list[tuple], list, bool]:
    """Records of the flows of a key that end, the one that goes on, and whether an RST waits. ``flow``: the one so far (empty where there is none)."""
    begins, idle, rst = _breaks(rows, flow[11] if flow else None, rst, idle_us)
    first, which, ts = np.flatnonzero(begins), np.cumsum(begins), rows["ts_us"].to_numpy(np.int64)
    src, sport = rows["src"].to_numpy(object), rows["sport"].to_numpy(np.int64)
    heads = [(flow or [None] * 6)[:6], *(list(r) for r in rows.iloc[first][["ord", "src", "sport", "dst", "dport", "proto"]].itertuples(index=False, name=None))]
    owner = np.empty(len(heads), object)
    owner[:] = [h[1] for h in heads]
    back = (src != owner[which]) | (sport != np.array([h[2] or 0 for h in heads])[which])
    cell = which * 2 + back
    counts = np.bincount(cell, minlength=2 * len(heads)).reshape(-1, 2)
    sums = np.bincount(cell, rows["size"].to_numpy(np.float64), 2 * len(heads)).astype(np.int64).reshape(-1, 2)  # exact below 2^53
    out = []
    for k, head in enumerate(heads):
        begin, end = (int(first[k - 1]) if k else 0), (int(first[k]) if k < len(first) else len(ts))
        if k == 0 and not flow:
            continue
        before = flow[6:11] if k == 0 else [0, 0, 0, 0, int(ts[begin])]
        last = int(ts[end - 1]) if end > begin else flow[11]
        own = [*head, before[0] + int(counts[k, 0]), before[1] + int(counts[k, 1]), before[2] + int(sums[k, 0]), before[3] + int(sums[k, 1]), before[4], last]
        if k < len(first):
            out.append((*own, "idle" if idle[end] else "reopened"))
    return out, own, rst


def flow_records(packets: DataFrame, idle_us: int = flows.IDLE_US) -> DataFrame:
    """Streaming (ord, ts_us, src, sport, dst, dport, proto, flags, size), addresses as text, to ``RECORD``: one row per flow, when it ends.

    A flow ends by a packet after a pause (``idle``) or a SYN after an RST (``reopened``), or, when no
    packet comes, as soon as the watermark has passed its idle time (``expired``); then its state is dropped.
    """
    names = ["flow_id", "src", "sport", "dst", "dport", "proto", "packets_0", "packets_1", "bytes_0", "bytes_1", "first_us", "last_us"]

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            *flow, _ = state.get
            state.remove()
            yield pd.DataFrame([(*flow, "expired")], columns=[*names, "reason"])
            return
        *flow, rst = state.get if state.exists else (False,)
        out, flow, rst = _ended(flow, rst, pd.concat(list(frames)).sort_values("ord"), idle_us)
        state.update(tuple(x if isinstance(x, str) else int(x) for x in flow) + (bool(rst),))
        _until(state, int(flow[11]), idle_us)
        yield pd.DataFrame(out, columns=[*names, "reason"])

    kept = RECORD.replace(", reason string", ", rst boolean")
    return _timed(packets, idle_us).groupBy("key").applyInPandasWithState(step, RECORD, kept, "append", GroupStateTimeout.EventTimeTimeout)


def sessions(packets: DataFrame, idle: str = "30 seconds") -> DataFrame:
    """Packets and bytes of each flow, closed by the watermark; ``ts`` is the event time."""
    timed = packets.withColumn("key", _key()).withWatermark("ts", idle)
    sums = timed.groupBy("key", F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("packets"), F.sum("size").alias("bytes"))
    return sums.select("key", F.col("w.start").alias("start"), "packets", "bytes")


def to_files(stream: DataFrame, path: str, checkpoint: str):
    """Runs an append stream over what there is and writes it as Parquet; the query it returns ends by itself."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
