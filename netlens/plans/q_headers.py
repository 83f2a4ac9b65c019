"""Header parsing: each variant wraps the same packets, and the oracle is what was encoded."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.functions import names
from netlens.operators import headers
from netlens.plans import fixtures as fx
from netlens.plans.fixtures import PACKETS_SQL

QUERIES, ORACLE_SQL = {}, {}
_ADDR = "concat_ws('.', {0} // 16777216, ({0} // 65536) % 256, ({0} // 256) % 256, {0} % 256)"
_ADDR6 = "concat('2001:0db8:0000:0000:0000:0000:', substr(lpad(lower(to_hex({0})), 8, '0'), 1, 4), ':', substr(lpad(lower(to_hex({0})), 8, '0'), 5, 4))"


def _inner(v6: bool = False):
    """Hex of the innermost IP packet and its size."""
    size = fx.l4_size(F.col("plen"))
    l4 = fx.l4_hex(F.repeat(F.lit("61"), F.col("plen").cast("int")), F.col("plen"))
    return (fx.ipv6_hex(l4, size, F.col("proto")), size + 40) if v6 else (fx.ipv4_hex(l4, size, F.col("proto")), size + 20)


def _shown(df):
    return df.select(
        "ord", "status", "l2_length", "l3_version", "l3_length", names.ip_text(F.col("src")).alias("src"), names.ip_text(F.col("dst")).alias("dst"), "proto", "sport", "dport", "l4_length", "payload_length",
        F.md5("payload").alias("payload_md5"),
    )


def _register(name: str, hexed, dlt: str, l2: int, l3: int, v6: bool = False, start: str = "L2"):
    def run(spark, sf_dir):
        rows = fx.columns(spark, sf_dir).select("ord", F.lit(dlt).alias("dlt"), fx.as_packet(hexed()).alias("pkt"))
        return _shown(headers.dissect(rows, start))

    addr = _ADDR6 if v6 else _ADDR
    QUERIES[name] = run
    ORACLE_SQL[name] = f"""
SELECT ord, 0 AS status, {l2} AS l2_length, {6 if v6 else 4} AS l3_version, {l3} AS l3_length, {addr.format("src")} AS src, {addr.format("dst")} AS dst, proto, sport, dport,
       CASE WHEN proto = 17 THEN 8 ELSE 20 END AS l4_length, plen AS payload_length, md5(repeat('a', plen::INT)) AS payload_md5 FROM ({PACKETS_SQL})"""


_e = fx.ethernet_hex
_register("l2_ethernet", lambda: _e(_inner()[0]), "EN10MB", 14, 20)
_register("l2_vlan", lambda: _e(F.concat(F.lit("00640800"), _inner()[0]), "8100"), "EN10MB", 18, 20)
_register("l2_double_vlan", lambda: _e(F.concat(F.lit("0064810000c80800"), _inner()[0]), "8100"), "EN10MB", 22, 20)
_register("l2_mpls", lambda: _e(F.concat(F.lit("0001003f" + "0002003f" + "0003013f"), _inner()[0]), "8847"), "EN10MB", 26, 20)
_register("l2_snap", lambda: F.concat(F.lit("020000000001" + "020000000002"), fx.h(_inner()[1] + 8, 4), F.lit("aaaa030000000800"), _inner()[0]), "EN10MB", 22, 20)
_register("l2_sll", lambda: F.concat(F.lit("0000" + "0001" + "0006" + "0200000000010000" + "0800"), _inner()[0]), "LINUX_SSL", 16, 20)
_register("l2_raw", lambda: _inner()[0], "RAW", 0, 20)
_register("l2_null", lambda: F.concat(F.lit("02000000"), _inner()[0]), "NULL", 4, 20)
_register("l2_ppp", lambda: F.concat(F.lit("ff030021"), _inner()[0]), "PPP", 4, 20)
_register("l2_wifi", lambda: F.concat(F.lit("8802" + "00" * 24 + "aaaa030000000800"), _inner()[0]), "IEEE802_11", 34, 20)
_register("l2_radiotap", lambda: F.concat(F.lit("0000" + "1200" + "00000000" + "00" * 10 + "8802" + "00" * 24 + "aaaa030000000800"), _inner()[0]), "IEEE802_11_RADIO", 52, 20)
_register("l3_ipv4", lambda: _inner()[0], "RAW", 0, 20, start="L3")
_register("l3_ipv6", lambda: _inner(True)[0], "RAW", 0, 40, True)


def _chain():
    """Hop-by-hop, destination options (16 bytes) and routing headers before the transport."""
    size = fx.l4_size(F.col("plen"))
    l4 = fx.l4_hex(F.repeat(F.lit("61"), F.col("plen").cast("int")), F.col("plen"))
    options = F.concat(F.lit("3c00" + "010400000000"), F.lit("2b01" + "00" * 14), F.concat(fx.h("proto", 2), F.lit("00" + "00" * 6)))
    return fx.ipv6_hex(F.concat(options, l4), size + 32, F.lit(0))


_register("l3_ext_headers", _chain, "RAW", 0, 72, True)
_register("l3_6in4", lambda: fx.ipv4_hex(_inner(True)[0], _inner(True)[1], F.lit(41), "dst", "src"), "RAW", 0, 60, True)
_register("l3_4in4", lambda: fx.ipv4_hex(_inner()[0], _inner()[1], F.lit(4), "dst", "src"), "RAW", 0, 40)
_register("l3_4in6", lambda: fx.ipv6_hex(_inner()[0], _inner()[1], F.lit(4), "dst", "src"), "RAW", 0, 60)
_register("l3_6in6", lambda: fx.ipv6_hex(_inner(True)[0], _inner(True)[1], F.lit(41), "dst", "src"), "RAW", 0, 80, True)


def fast_path(spark, sf_dir):
    """The same rows by Column expressions alone."""
    rows = headers.ethernet_ip(fx.packets(spark, sf_dir))
    return _shown(rows)


QUERIES["headers_fast_path"] = fast_path
ORACLE_SQL["headers_fast_path"] = ORACLE_SQL["l2_ethernet"]


def l3_errors(spark, sf_dir):
    """Damaged packets by kind of damage and outcome."""
    whole = _inner()[0]
    kind = F.col("ord") % 8
    hexed = (
        F.when(kind == 0, F.substring(whole, 1, 38)).when(kind == 1, F.concat(F.lit("75"), F.substring(whole, 3, 1000))).when(kind == 2, F.lit(""))
        .when(kind == 3, F.concat(F.lit("4500ffff"), F.substring(whole, 9, 1000))).when(kind == 4, F.substring(whole, 1, 2 * 20 + 8))
        .when(kind == 5, F.concat(F.lit("45000018"), F.substring(whole, 9, 40))).when(kind == 6, F.concat(whole, F.lit("00" * 6))).otherwise(whole)
    )
    rows = fx.columns(spark, sf_dir).select("ord", kind.cast("int").alias("damage"), F.lit("RAW").alias("dlt"), fx.as_packet(hexed).alias("pkt"))
    found = headers.dissect(rows)
    return found.groupBy("damage", "status", names.status_message(F.col("status")).alias("message")).agg(F.count("*").alias("n"), F.sum(F.coalesce("payload_length", F.lit(0))).alias("payload"))


QUERIES["l3_errors"] = l3_errors
ORACLE_SQL["l3_errors"] = f"""
WITH p AS (SELECT *, (ord % 8)::INT AS damage, CASE WHEN proto = 17 THEN 8 ELSE 20 END + plen AS l4 FROM ({PACKETS_SQL})),
s AS (SELECT *, CASE damage WHEN 0 THEN -6 WHEN 1 THEN -1 WHEN 3 THEN -6 WHEN 4 THEN -6 WHEN 5 THEN -5 ELSE 0 END AS status FROM p)
SELECT damage, status, CASE status WHEN -6 THEN 'Error while parsing the L3 header' WHEN -1 THEN 'Neither IPv4 nor IPv6' WHEN -5 THEN 'Error while parsing the L4 header' ELSE 'Everything is ok' END AS message,
       count(*) AS n, sum(CASE WHEN status = 0 AND damage <> 2 THEN plen ELSE 0 END)::BIGINT AS payload
FROM s GROUP BY 1, 2, 3
"""


def l2_errors(spark, sf_dir):
    """Unknown link types, cut frames and frames that are not IP."""
    kind = F.col("ord") % 4
    whole = _inner()[0]
    hexed = F.when(kind == 1, F.lit("0200000000")).when(kind == 2, fx.ethernet_hex(F.lit("0001080006040001"), "0806")).otherwise(fx.ethernet_hex(whole))
    rows = fx.columns(spark, sf_dir).select("ord", kind.cast("int").alias("damage"), F.when(kind == 0, "OTHER").otherwise("EN10MB").alias("dlt"), fx.as_packet(hexed).alias("pkt"))
    return headers.dissect(rows).groupBy("damage", "status").agg(F.count("*").alias("n"))


QUERIES["l2_errors"] = l2_errors
ORACLE_SQL["l2_errors"] = f"SELECT (ord % 4)::INT AS damage, [-7, -7, -1, 0][(ord % 4)::INT + 1] AS status, count(*) AS n FROM ({PACKETS_SQL}) GROUP BY 1, 2"


def l4_other(spark, sf_dir):
    """Transports without ports: the whole segment is header, and a flow is still made."""
    other = F.when(F.col("ord") % 2 == 0, 1).otherwise(132)
    hexed = fx.ethernet_hex(fx.ipv4_hex(F.repeat(F.lit("08"), (F.col("plen") + 1).cast("int")), F.col("plen") + 1, other))
    rows = fx.columns(spark, sf_dir).select("ord", F.lit("EN10MB").alias("dlt"), fx.as_packet(hexed).alias("pkt"))
    return headers.dissect(rows).select("ord", "status", names.l4_name(F.col("proto")).alias("l4"), "sport", "dport", "l4_length", "payload_length")


QUERIES["l4_other"] = l4_other
ORACLE_SQL["l4_other"] = f"SELECT ord, 0 AS status, CASE WHEN ord % 2 = 0 THEN 'ICMP' ELSE 'SCTP' END AS l4, 0 AS sport, 0 AS dport, plen + 1 AS l4_length, 0 AS payload_length FROM ({PACKETS_SQL})"


def l4_tcp(spark, sf_dir):
    found = headers.dissect(fx.packets(spark, sf_dir)).where("proto = 6")
    return found.select("ord", "sport", "dport", "seq", "ack", "tcp_flags", "tcp_window", "l4_bytes")


QUERIES["l4_tcp"] = l4_tcp
ORACLE_SQL["l4_tcp"] = f"SELECT ord, sport, dport, 1000 + ord AS seq, 77 AS ack, flags AS tcp_flags, win AS tcp_window, 20 + plen AS l4_bytes FROM ({PACKETS_SQL}) WHERE proto = 6"
QUERIES["l4_udp"] = lambda spark, sf_dir: headers.dissect(fx.packets(spark, sf_dir)).where("proto = 17").select("ord", "sport", "dport", "l4_bytes", "payload_length")
ORACLE_SQL["l4_udp"] = f"SELECT ord, sport, dport, 8 + plen AS l4_bytes, plen AS payload_length FROM ({PACKETS_SQL}) WHERE proto = 17"


def cidr_match(spark, sf_dir):
    found = headers.dissect(fx.packets(spark, sf_dir))
    nets = ["10.0.0.0/29", "10.0.0.8/30", "192.168.1.0/31", "192.168.0.0/16"]
    return found.select(*[F.count_if(names.in_network(F.col("src"), n)).alias(f"n{i}") for i, n in enumerate(nets)])


QUERIES["cidr_match"] = cidr_match
ORACLE_SQL["cidr_match"] = f"""
SELECT count(*) FILTER (src BETWEEN 167772160 AND 167772167) AS n0, count(*) FILTER (src BETWEEN 167772168 AND 167772171) AS n1,
       count(*) FILTER (src BETWEEN 3232235776 AND 3232235777) AS n2, count(*) FILTER (src BETWEEN 3232235520 AND 3232301055) AS n3 FROM ({PACKETS_SQL})
"""
