"""Packets built in SQL from the driver tables, and the columns they encode.

Oracles never read bytes: they use the encoded columns, as stated in ``PACKETS_SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_COLUMNS = """
  SELECT ord, ts_us, dir, CASE WHEN dir = 1 THEN server ELSE client END AS src, CASE WHEN dir = 1 THEN client ELSE server END AS dst,
         CASE WHEN dir = 1 THEN svc ELSE cport END AS sport, CASE WHEN dir = 1 THEN cport ELSE svc END AS dport, proto,
         CASE WHEN proto = 17 THEN 0 ELSE flags END AS flags, CASE WHEN proto = 17 THEN 0 ELSE win END AS win, plen, event_type
  FROM (
    SELECT event_id AS ord, event_id * 86000 + {micros} % 86000 AS ts_us, event_id % 2 AS dir,
           167772161 + user_id % 10 AS client, 3232235777 + user_id % 3 AS server,
           CASE event_type WHEN 'click' THEN 80 WHEN 'view' THEN 443 WHEN 'purchase' THEN 25 WHEN 'signup' THEN 53 ELSE 22 END AS svc,
           40000 + user_id % 10 AS cport, CASE WHEN event_type = 'signup' THEN 17 ELSE 6 END AS proto,
           CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 13 = 0 THEN 17 WHEN event_id % 97 = 0 THEN 4 ELSE 24 END AS flags,
           CASE WHEN event_id % 50 = 0 THEN 0 ELSE 8192 END AS win, CAST(floor(value) AS BIGINT) % 200 AS plen, event_type
    FROM events)
"""
#: DuckDB: the columns encoded in the packets.
PACKETS_SQL = _COLUMNS.format(micros="(epoch_us(ts) - 1704067200000000)")
_SPARK_SQL = _COLUMNS.format(micros="(unix_micros(cast(ts AS TIMESTAMP)) - 1704067200000000)").replace("FROM events", "FROM {events}")


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_SPARK_SQL, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def h(column, digits: int) -> Column:
    """A whole number as hexadecimal digits."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lpad(F.hex(column.cast("long")), digits, "0")


def l4_hex(payload: Column, size: Column, seq=None, ack=None) -> Column:
    """TCP or UDP header and payload; sizes in bytes."""
    seq = F.lit(1000) + F.col("ord") if seq is None else seq
    ack = F.lit(77) if ack is None else ack
    tcp = F.concat(h("sport", 4), h("dport", 4), h(seq, 8), h(ack, 8), F.lit("50"), h("flags", 2), h("win", 4), F.lit("00000000"))
    udp = F.concat(h("sport", 4), h("dport", 4), h(size + 8, 4), F.lit("0000"))
    return F.concat(F.when(F.col("proto") == 17, udp).otherwise(tcp), payload)


def l4_size(size: Column) -> Column:
    return F.when(F.col("proto") == 17, 8).otherwise(20) + size


def ipv4_hex(body: Column, size: Column, proto: Column, src="src", dst="dst", ident=None, frag=None) -> Column:
    """IPv4 header before a body of ``size`` bytes."""
    ident = F.col("ord") % 65536 if ident is None else ident
    return F.concat(F.lit("4500"), h(size + 20, 4), h(ident, 4), h(F.lit(0x4000) if frag is None else frag, 4), F.lit("40"), h(proto, 2), F.lit("0000"), h(src, 8), h(dst, 8), body)


def ipv6_hex(body: Column, size: Column, following: Column, src="src", dst="dst") -> Column:
    """IPv6 header; addresses are the IPv4 ones in the last four bytes of 2001:db8::."""
    prefix = F.lit("20010db8" + "0" * 16)
    return F.concat(F.lit("60000000"), h(size, 4), h(following, 2), F.lit("40"), prefix, h(src, 8), prefix, h(dst, 8), body)


def ethernet_hex(body: Column, ethertype: str = "0800") -> Column:
    return F.concat(F.lit("020000000001" + "020000000002" + ethertype), body)


def as_packet(hexed: Column) -> Column:
    return F.unhex(hexed)


def packets(spark: SparkSession, sf_dir: str, payload: Column | None = None) -> DataFrame:
    """ord, ts_us, dlt, pkt: Ethernet frames of ``columns`` with a payload of ``plen`` times 'a'."""
    rows = columns(spark, sf_dir)
    body = F.repeat(F.lit("61"), F.col("plen").cast("int"))
    whole = ethernet_hex(ipv4_hex(l4_hex(body, F.col("plen")), l4_size(F.col("plen")), F.col("proto")))
    return rows.select("ord", "ts_us", F.lit("EN10MB").alias("dlt"), as_packet(whole).alias("pkt"))


def payload_packets(rows: DataFrame, payload: Column) -> DataFrame:
    """Frames with a given BINARY payload over (ord, ts_us, src, dst, sport, dport, proto, flags, win[, seq, ack])."""
    size = F.length(payload)
    seq = F.col("seq") if "seq" in rows.columns else None
    ack = F.col("ack") if "ack" in rows.columns else None
    whole = ethernet_hex(ipv4_hex(l4_hex(F.hex(payload), size, seq, ack), l4_size(size), F.col("proto")))
    keep = [c for c in rows.columns if c not in ("src", "dst", "sport", "dport", "proto", "flags", "win", "seq", "ack", "dlt", "pkt", "payload")]
    return rows.select(*keep, F.lit("EN10MB").alias("dlt"), as_packet(whole).alias("pkt"))
