"""Bidirectional flows: keys, directions, sessions, statistics and caps.

Everything here is windows and aggregates over one partitioning by ``flow_key``: the
packets are shuffled once, and each later step reuses that distribution. It has as many
parts as the input needs, so what a task sorts does not grow with the input. ``ord`` is
the arrival order; ties cannot occur in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDLE_US = 30_000_000
SYN, FIN, RST, ACK = 2, 1, 4, 16


def flow_key(src="src", sport="sport", dst="dst", dport="dport", proto="proto") -> Column:
    """The same for both directions: lower and higher (address, port), and protocol."""
    a, b = F.struct(F.col(src).alias("ip"), F.col(sport).alias("port")), F.struct(F.col(dst).alias("ip"), F.col(dport).alias("port"))
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.col(proto).alias("proto"))


#: Name of the column that numbers the packets of a flow from 1.
PLACE = "__place"


def with_place(rows: DataFrame) -> DataFrame:
    """Sessionized rows as a pass over flows needs them: a flow lies together, in order, and ``PLACE`` tells where it begins."""
    return rows.withColumn(PLACE, F.row_number().over(Window.partitionBy("flow_key", "seg").orderBy("ord")))


#: Bytes of input files whose packets a task takes: some 100,000 packets of a table that encodes each in 16 to 20 bytes.
TASK_BYTES = 2 << 20


def parts_for(rows: DataFrame) -> int:
    """How many tasks the files need that rows are made of; a source that does not tell its size counts for nothing."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    nodes = (leaves.apply(i) for i in range(leaves.size()))
    size = sum(int(str(n.stats().sizeInBytes())) for n in nodes if n.getClass().getSimpleName() == "LogicalRelation")
    return -(-size // TASK_BYTES)


def dealt(rows: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """Rows dealt by a key to as many tasks as their input needs; left to Spark where one would do."""
    parts = parts_for(rows) if parts is None else parts
    return rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism), key) if parts > 1 else rows


def has(flag: int) -> Column:
    return F.coalesce(F.col("tcp_flags").bitwiseAND(flag) != 0, F.lit(False))


def sessionize(packets: DataFrame, idle_us: int = IDLE_US, fin_closes: bool = False, parts: int | None = None) -> DataFrame:
    """Adds flow_key, seg (number of the flow within its key), dir (0 as its first packet, else 1) and flow_id (ord of its first packet).

    A flow ends when its key was idle for more than ``idle_us``; when a SYN follows an
    RST; and, with ``fin_closes``, after the packet that completes a FIN in both directions.
    ``parts``: to how many tasks packets are dealt; by default as many as their files need.
    """
    rows = dealt(packets.withColumn("flow_key", flow_key()), "flow_key", parts)
    w = Window.partitionBy("flow_key").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    last = lambda flag, frame: F.max(F.when(flag, F.col("ord"))).over(frame)
    gap = F.coalesce(F.col("ts_us") - F.lag("ts_us").over(w) > idle_us, F.lit(False))
    rows = rows.withColumn("__gap", gap)
    rows = rows.withColumns({"__from": last(F.col("__gap"), so_far), "__rst": last(has(RST), before), "__syn": last(has(SYN), before)})
    since = F.coalesce("__from", F.lit(-1))
    syn_before = F.when(F.col("__syn") >= since, F.col("__syn"))
    # within a session of the key: a SYN breaks if an RST came since the last SYN
    reopened = (F.col("proto") == 6) & has(SYN) & (F.col("__rst") >= since) & (F.col("__rst") >= F.coalesce(syn_before, F.lit(-1)))
    rows = rows.withColumn("__break", F.col("__gap") | F.coalesce(reopened, F.lit(False)))
    rows = rows.withColumn("seg", F.sum(F.col("__break").cast("int")).over(so_far).cast("int"))
    if fin_closes:
        rows = _closed(rows)
    flow = Window.partitionBy("flow_key", "seg").orderBy("ord")
    first = F.first(F.struct("src", "sport", "ord")).over(flow)
    rows = rows.withColumn("__first", first)
    return rows.withColumns({
        "flow_id": F.col("__first.ord"),
        "dir": F.when((F.col("src") == F.col("__first.src")) & (F.col("sport") == F.col("__first.sport")), 0).otherwise(1),
    }).drop("__gap", "__from", "__rst", "__syn", "__break", "__first")


def _closed(rows: DataFrame) -> DataFrame:
    """Raises ``seg`` after each packet that completes a FIN in both directions.

    FINs of a flow come in runs of one direction. A run finds the flow half closed if the
    run before left it so: one of several FINs always does, a single FIN only if it did not
    complete a pair itself. So single runs take turns from the last ``anchor`` on, a run that
    begins a flow or has several FINs, and all this is windows over one order.
    """
    w = Window.partitionBy("flow_key").orderBy("ord")
    before, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    fin = has(FIN) & (F.col("proto") == 6)
    forward = F.struct(F.col("src"), F.col("sport")) == F.col("flow_key.lo")
    fresh, same = ~F.coalesce(F.col("__last.seg") == F.col("seg"), F.lit(False)), F.col("__last.forward") == F.col("__fin.forward")
    rows = rows.withColumn("__fin", F.when(fin, F.struct("seg", forward.alias("forward"))))
    rows = rows.withColumns({"__last": F.last("__fin", True).over(before), "__next": F.lead("seg").over(w)})
    rows = rows.withColumn("__begins", fin & (fresh | ~same))
    rows = rows.withColumn("__run", F.sum(F.col("__begins").cast("long")).over(so_far))
    rows = rows.withColumn("__anchor", F.max(F.when(fin & (fresh | same), F.col("__run"))).over(before))
    closes = F.col("__begins") & ~fresh & ((F.col("__run") - F.col("__anchor")) % 2 == 1) & (F.col("__next") == F.col("seg"))
    cuts = F.coalesce(F.sum(F.coalesce(closes, F.lit(False)).cast("int")).over(before), F.lit(0))
    return rows.withColumn("seg", (F.col("seg") + cuts).cast("int")).drop("__fin", "__last", "__next", "__begins", "__run", "__anchor")


def round_trips(rows: DataFrame) -> DataFrame:
    """Adds rtt (us) and rtt_of (direction) where a packet measures one.

    A SYN+ACK measures the way from the last packet of the other direction; the first
    packet of the initiator that has its acknowledged number measures the other way.
    """
    before = Window.partitionBy("flow_key", "seg").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    both = has(SYN) & has(ACK)
    last = lambda d: F.last(F.when(F.col("dir") == d, F.col("ts_us")), True).over(before)
    rows = rows.withColumns({"__last0": last(0), "__last1": last(1), "__ack": F.last(F.when(both, F.col("ack")), True).over(before)})
    answer = ~both & (F.col("dir") == 0) & (F.col("seq") == F.col("__ack"))
    rows = rows.withColumn("__answer", F.coalesce(answer, F.lit(False)))
    fresh = F.col("__answer") & (F.coalesce(F.max(F.col("__answer")).over(before), F.lit(False)) == F.lit(False))
    other = F.when(F.col("dir") == 0, F.col("__last1")).otherwise(F.col("__last0"))
    return rows.withColumns({
        "rtt": F.when(both, F.col("ts_us") - other).when(fresh, F.col("ts_us") - F.col("__last1")),
        "rtt_of": F.when(both, 1 - F.col("dir")).when(fresh, F.lit(1)),
    }).drop("__last0", "__last1", "__ack", "__answer")


def statistics(rows: DataFrame, only: list[str] | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per flow: identity, and the chosen statistics of both directions as <name>_0 and <name>_1.

    Takes what ``sessionize`` gives; ``rtt_syn_ack`` needs ``round_trips`` and
    ``retransmissions`` the ``tcp_status`` of the TCP tracker first.
    """
    count = lambda test, d: F.count(F.when(test & (F.col("dir") == d), 1))
    total = lambda value, d: F.coalesce(F.sum(F.when(F.col("dir") == d, value)), F.lit(0)).cast("long")
    payload = F.col("payload_length") > 0
    every = {
        "packets": lambda d: count(F.lit(True), d),
        "bytes": lambda d: total(F.col("l3_length") + F.col("l4_bytes"), d),
        "timestamp_first": lambda d: F.min_by(F.when(F.col("dir") == d, F.col("ts_us")), F.when(F.col("dir") == d, F.col("ord"))),
        "timestamp_last": lambda d: F.max_by(F.when(F.col("dir") == d, F.col("ts_us")), F.when(F.col("dir") == d, F.col("ord"))),
        "rtt_syn_ack": lambda d: F.max_by("rtt", F.when(F.col("rtt_of") == d, F.col("ord"))),
        "syn": lambda d: count(has(SYN), d),
        "fin": lambda d: count(has(FIN), d),
        "rst": lambda d: count(has(RST), d),
        "zero_window": lambda d: count((F.col("proto") == 6) & (F.col("tcp_window") == 0), d),
        "retransmissions": lambda d: count(F.col("tcp_status") == "retransmission", d),
        "window_scaling": lambda d: F.coalesce(F.max_by("tcp_window_scale", F.when((F.col("dir") == d) & F.col("tcp_window_scale").isNotNull(), F.col("ord"))), F.lit(-1)),
        "l7_packets": lambda d: count(payload, d),
        "l7_bytes": lambda d: total(F.when(payload, F.col("payload_length")).cast("long"), d),
    }
    needs = {"rtt_syn_ack": "rtt", "retransmissions": "tcp_status", "window_scaling": "tcp_window_scale"}
    chosen = only or [k for k in every if needs.get(k, "ord") in rows.columns]
    first = lambda c: F.min_by(c, "ord").alias(c)
    aggregates = [first(c) for c in ("src", "sport", "dst", "dport", "proto")]
    aggregates += [every[k](d).alias(f"{k}_{d}") for k in chosen for d in (0, 1)]
    aggregates += [c.alias(k) for k, c in (extra or {}).items()]
    return rows.groupBy("flow_key", "seg").agg(F.min("ord").alias("flow_id"), *aggregates)


def packet_times(rows: DataFrame, most: int = 10) -> DataFrame:
    """The first ``most`` non-empty payloads of each direction of a flow: lengths and times since the one before (first 0)."""
    some = rows.where(F.col("payload_length") > 0)
    w = Window.partitionBy("flow_key", "seg", "dir").orderBy("ord")
    some = some.withColumns({"k": F.row_number().over(w), "dt": F.coalesce(F.col("ts_us") - F.lag("ts_us").over(w), F.lit(0))}).where(F.col("k") <= most)
    packed = F.array_sort(F.collect_list(F.struct("k", F.col("payload_length").alias("len"), "dt")))  # at most ``most``
    out = some.groupBy("flow_key", "seg", "dir").agg(F.min("flow_id").alias("flow_id"), packed.alias("p"))
    return out.select("flow_id", "dir", F.transform("p", lambda x: x["len"]).alias("lengths"), F.transform("p", lambda x: x["dt"]).alias("times"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (ord, ts_us, key) in order, one for each slice in a batch: differences, byte by byte, compressed."""
    for batch in batches:
        if any(c.null_count for c in batch.columns[:2]):
            raise ValueError("packets need ord and ts_us")
        ords, times, keys, slices = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        rows = []
        for one in np.unique(slices):
            own = slices == one
            columns = np.stack([np.diff(ords[own], prepend=0), np.diff(times[own], prepend=0), keys[own]]).astype(np.int64)
            rows.append((int(one), int(ords[own][0]), int(own.sum()), zlib.compress(columns.view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1).tobytes(), 1)))
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["slice", "first", "n", "data"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """ord, ts_us and key of the blocks of ``_pack``, and the place of each block."""
    for n, data, place in zip(*(batch.column(c) for c in ("n", "data", PLACE)), strict=True):
        columns = np.frombuffer(zlib.decompress(data.as_py()), np.uint8).reshape(3, 8, n.as_py()).transpose(0, 2, 1)
        ords, times, keys = np.ascontiguousarray(columns).view(np.int64)[:, :, 0]
        yield np.cumsum(ords), np.cumsum(times), keys, place.as_py()


def cap(rows: DataFrame, most: int, strategy: str = "skip", idle_us: int = IDLE_US, slices: int = 16) -> DataFrame:
    """ord, admitted, evicted: what a table of at most ``most`` live flows does with each packet.

    ``skip`` refuses packets of new flows when the table is full; ``evict`` removes the
    flow that was idle longest (earliest created on ties) and ``evicted`` names it by the
    ord of its first packet. The rule depends on the order of all packets of a table, so the
    table is divided among ``slices`` by the hash of the flow key, each with its share of
    ``most`` and a task of its own, as among workers. ``slices=1`` is one table for all: one
    task, which reads three narrow columns in order and holds ``most`` flows. Packets are put
    in order by many tasks and come to that of their table packed, some bytes for each.
    """
    if strategy not in ("skip", "evict"):
        raise ValueError(strategy)
    share = -(-most // slices)
    narrow = rows.select("ord", "ts_us", F.xxhash64("flow_key").alias("key")).withColumn("slice", F.pmod("key", F.lit(slices)).cast("int"))
    parts = max(parts_for(rows), rows.sparkSession.sparkContext.defaultParallelism)
    packed = narrow.repartitionByRange(parts, "ord").sortWithinPartitions("ord").mapInArrow(_pack, "slice int, first long, n int, data binary")
    packed = packed.withColumn(PLACE, F.row_number().over(Window.partitionBy("slice").orderBy("first")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live: dict[int, tuple[int, int]] = {}  # key: last time, first ord; in order of last use
        for ords, times, keys, place in (block for batch in batches for block in _unpacked(batch)):
            if place == 1:
                live = {}
            admitted, evicted = [], []
            for o, ts, key in zip(ords.tolist(), times.tolist(), keys.tolist(), strict=True):
                gone = None
                while live:
                    oldest = next(iter(live))
                    if ts - live[oldest][0] <= idle_us:
                        break
                    del live[oldest]
                known = live.pop(key, None)
                if known is None and len(live) >= share:
                    if strategy == "skip":
                        admitted.append(False)
                        evicted.append(None)
                        continue
                    gone = live.pop(next(iter(live)))[1]
                live[key] = (ts, known[1] if known else o)
                admitted.append(True)
                evicted.append(gone)
            yield pa.RecordBatch.from_arrays([pa.array(ords), pa.array(admitted, pa.bool_()), pa.array(evicted, pa.int64())], ["ord", "admitted", "evicted"])

    return packed.mapInArrow(run, "ord long, admitted boolean, evicted long")


def refused(rows: DataFrame, most: int, idle_us: int = IDLE_US, slices: int = 16) -> DataFrame:
    """The rows with status -4 where a full table of flows refused them."""
    out = cap(rows, most, "skip", idle_us, slices).where("NOT admitted").select("ord", F.lit(True).alias("__refused"))
    return dealt(rows, "ord").join(out, "ord", "left").withColumn("status", F.when(F.col("__refused"), -4).otherwise(F.col("status"))).drop("__refused")
