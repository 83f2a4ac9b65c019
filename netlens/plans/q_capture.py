"""Capture files: written by the sink, read by both sources, with flows that run on from file to file."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from netlens.functions import names
from netlens.operators import defrag, flows, headers, l7
from netlens.operators.l7 import Config
from netlens.plans import fixtures as fx
from netlens.plans.q_flows import _ADDR, _KEYED
from netlens.plans.q_l7 import _KINDS, CONVERSATIONS, STACKS, _ID_NAMES, conversations
from netlens.plans.q_streams import shared_folder
from netlens.sources import pcap
from netlens.streaming import tracker

QUERIES, ORACLE_SQL = {}, {}
#: Files that small tables are written to; larger ones make a file of what a task takes.
_FILES = 5
#: By kind: transport, stack and number of packets in each direction.
_SIZES = [(_ID_NAMES[k], v[0], STACKS[k], sum(1 for w, _ in v[3] if w == 0), sum(len(b) for _, b in v[3])) for k, v in CONVERSATIONS.items()]
_SIZES.append((_KINDS - 1, 17, "Unknown", 1, len(b"\x30noise that is no protocol")))
_TABLE = ", ".join(f"({k}, {proto}, '{stack}', {forth}, {size})" for k, proto, stack, forth, size in _SIZES)


def _written(packets, folder: str) -> int:
    """Adds capture files of packets to a folder, in order of arrival; how many."""
    files = max(_FILES, flows.parts_for(packets))
    packets.repartitionByRange(files, "ord").sortWithinPartitions("ord").select("ts_us", "pkt").write.format("pcap").mode("append").save(folder)
    return files


def captured(spark, sf_dir) -> tuple[str, int]:
    """A folder of capture files of the conversations, in order of arrival, and their number; files end anywhere in a flow."""
    folder = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    pcap.register(spark)
    return folder, _written(conversations(spark, sf_dir), folder)


def _flows(packets, parts: int):
    """Stack and number of packets of each flow, by the event that its client's address encodes."""
    rows = flows.sessionize(defrag.dissect(packets).where("status in (0, 2)"), parts=parts)
    found = l7.classify(rows, Config(reorder=False))
    stack = F.max_by(F.array_join("protocols", ","), "ord")
    client = F.conv(F.hex(F.least("src", "dst")), 16, 10).cast("long") - 167772161
    sums = found.groupBy("flow_id", client.alias("event_id")).agg(stack.alias("stack"), F.count("*").alias("packets"), F.countDistinct("file").alias("files"))
    return sums.groupBy("event_id").agg(F.first("stack").alias("stack"), F.first("packets").alias("packets"), F.count("*").alias("flows"))


def capture_files(spark, sf_dir):
    folder, parts = captured(spark, sf_dir)
    return _flows(pcap.read(spark, folder), parts)


def capture_source(spark, sf_dir):
    folder, parts = captured(spark, sf_dir)
    return _flows(spark.read.format("pcap").load(folder), parts)


QUERIES |= {"capture_files": capture_files, "capture_source": capture_source}
_N = ", ".join(f"({_ID_NAMES[k]}, '{STACKS[k]}', {len(v[3])})" for k, v in CONVERSATIONS.items())
ORACLE_SQL["capture_files"] = ORACLE_SQL["capture_source"] = f"""
SELECT event_id, stack, n AS packets, 1 AS flows FROM events JOIN (VALUES {_N}, ({_KINDS - 1}, 'Unknown', 1)) AS t(kind, stack, n) ON event_id % {_KINDS} = kind
"""


def capture_stream(spark, sf_dir):
    """The same files as a stream, dissected on the way and written as files."""
    folder, _ = captured(spark, sf_dir)
    rows = headers.dissect(spark.readStream.format("pcap").load(folder)).select("ord", "file", "proto", "payload_length")
    tracker.to_files(rows, f"{folder}-out/rows", f"{folder}-out/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{folder}-out/rows")
    return found.groupBy("proto").agg(F.count("*").alias("packets"), F.sum("payload_length").alias("bytes"), F.countDistinct("ord").alias("numbers"))


QUERIES["capture_stream"] = capture_stream
ORACLE_SQL["capture_stream"] = f"""
SELECT proto, sum(n)::BIGINT AS packets, sum(size)::BIGINT AS bytes, sum(n)::BIGINT AS numbers
FROM events JOIN (VALUES {", ".join(f"({k}, {proto}, {len(CONVERSATIONS[name][3]) if name else 1}, {size})" for (k, proto, _, _, size), name in zip(_SIZES, [*CONVERSATIONS, None], strict=True))}) AS t(kind, proto, n, size) ON event_id % {_KINDS} = kind GROUP BY 1
"""


def flow_summary_l7(spark, sf_dir):
    """One row per conversation: what links, networks, transports and applications it has, and how much goes each way."""
    rows = l7.classify(flows.sessionize(headers.dissect(conversations(spark, sf_dir))), Config(reorder=False))
    extra = {
        "event_id": F.min("event_id"), "l2": F.min_by("dlt", "ord"), "l3": F.min_by(F.when(F.col("l3_version") == 4, "IPv4").otherwise("IPv6"), "ord"),
        "l7": F.max_by(F.array_join("protocols", ","), "ord"),
    }
    found = flows.statistics(rows, ["packets", "l7_packets", "l7_bytes"], extra)
    total = (F.col("l7_bytes_0") + F.col("l7_bytes_1")).alias("l7_bytes")
    return found.select("event_id", "l2", "l3", F.col("proto").alias("l4"), "l7", (F.col("packets_0") + F.col("packets_1")).alias("packets"), total)


QUERIES["flow_summary_l7"] = flow_summary_l7
ORACLE_SQL["flow_summary_l7"] = f"""
SELECT event_id, 'EN10MB' AS l2, 'IPv4' AS l3, proto AS l4, stack AS l7, n AS packets, size AS l7_bytes
FROM events JOIN (VALUES {", ".join(f"({k}, {proto}, '{stack}', {len(CONVERSATIONS[name][3]) if name else 1}, {size})" for (k, proto, stack, _, size), name in zip(_SIZES, [*CONVERSATIONS, None], strict=True))}) AS t(kind, proto, stack, n, size) ON event_id % {_KINDS} = kind
"""


def stream_flow_records(spark, sf_dir):
    """Flows of a stream of capture files as they end. Packets of the far future let the watermark pass them all, in runs that go on from the checkpoint."""
    folder = f"{shared_folder(spark)}/flows-{uuid.uuid4().hex}"
    pcap.register(spark)
    schema = "ord long, ts_us long, src long, dst long, sport int, dport int, proto int, flags int, win int"
    later = [spark.createDataFrame([(0, (1 << 50) + k, 1, 2, 3, 4, 17, 0, 0)], schema) for k in range(2)]
    for rows in (fx.packets(spark, sf_dir), *(fx.payload_packets(x, F.lit(bytearray(b"end"))) for x in later)):
        _written(rows, folder)
        found = headers.dissect(spark.readStream.format("pcap").load(folder)).where("status = 0")
        size = (F.col("l3_length") + F.col("l4_bytes")).cast("long").alias("size")
        ends = [names.ip_text(F.col(c)).alias(c) for c in ("src", "dst")]
        records = tracker.flow_records(found.select("ord", "ts_us", *ends, "sport", "dport", "proto", F.coalesce("tcp_flags", F.lit(0)).alias("flags"), size))
        tracker.to_files(records, f"{folder}-out/rows", f"{folder}-out/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}-out/rows").drop("flow_id", "reason")


QUERIES["stream_flow_records"] = stream_flow_records
ORACLE_SQL["stream_flow_records"] = f"""
WITH {_KEYED}
SELECT {_ADDR.format("arg_min(src, ord)")} AS src, arg_min(sport, ord)::INT AS sport, {_ADDR.format("arg_min(dst, ord)")} AS dst, arg_min(dport, ord)::INT AS dport, proto, count(*) FILTER (d = 0) AS packets_0,
  count(*) FILTER (d = 1) AS packets_1, coalesce(sum(bytes) FILTER (d = 0), 0)::BIGINT AS bytes_0, coalesce(sum(bytes) FILTER (d = 1), 0)::BIGINT AS bytes_1, min(ts_us) AS first_us, max(ts_us) AS last_us
FROM r GROUP BY flow_id, proto
"""
