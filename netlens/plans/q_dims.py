"""Dimension tables and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens import catalog
from netlens.functions import names
from netlens.plans import fixtures


def _values(columns: str, rows) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) AS t({columns})"


def _dim(name):
    return lambda spark, sf_dir: names.dimension(spark, name)


_PORTS = [(t, p, n) for t, ps in (("tcp", catalog.TCP_PORTS), ("udp", catalog.UDP_PORTS)) for p, n in sorted(ps.items())]
ORACLE_SQL = {
    "l2_names": _values("id, name", enumerate(catalog.L2)),
    "l3_names": _values("id, name", sorted(catalog.L3.items())),
    "l4_names": _values("id, name", sorted(catalog.L4.items())),
    "l7_names": _values("id, name, transport", [(i, s, t) for i, (_, s, t) in enumerate(catalog.L7)]),
    "l7_field_catalog": _values("id, protocol, field, type", [(i, p, f, catalog.FIELD_TYPES[t]) for i, (p, f, t) in enumerate(catalog.fields())]),
    "status_messages": _values("status, message", sorted(catalog.STATUS.items())),
    "known_ports": _values("transport, port, protocol", _PORTS),
    "dlt_map": _values("code, name", sorted(catalog.DLT.items())),
    "statistics_names": _values("id, name", enumerate(catalog.STATISTICS)),
}
QUERIES = {k: _dim("statistics" if k == "statistics_names" else k) for k in ORACLE_SQL}


def name_lookup(spark, sf_dir):
    """Names to numbers and back, whatever the case, with the stated results of failure."""
    given = spark.createDataFrame([("dns",), ("Json-RPC",), ("json_rpc",), ("SKYPE",), ("nothing",), ("tcp",), ("IcMpV6",)], "name string")
    return given.select("name", names.l7_number(F.col("name")).alias("l7_id"), names.l4_number(F.col("name")).alias("l4_id"), names.l7_display(F.upper("name")).alias("shown"))


QUERIES["name_lookup"] = name_lookup
ORACLE_SQL["name_lookup"] = _values(
    "name, l7_id, l4_id, shown",
    [("dns", 0, 0, "DNS"), ("Json-RPC", 26, 0, "Unknown"), ("json_rpc", 26, 0, "JSON-RPC"), ("SKYPE", 9, 0, "Skype"), ("nothing", 37, 0, "Unknown"), ("tcp", 37, 6, "Unknown"), ("IcMpV6", 37, 58, "Unknown")],
)


def port_guess(spark, sf_dir):
    rows = fixtures.columns(spark, sf_dir)
    guess = names.port_guess(F.col("proto"), F.col("sport").cast("int"), F.col("dport").cast("int"))
    return rows.groupBy("proto", "sport", "dport").agg(F.count("*").alias("n")).withColumn("guess", guess)


QUERIES["port_guess"] = port_guess
ORACLE_SQL["port_guess"] = f"""
WITH p AS ({fixtures.PACKETS_SQL}), k AS ({ORACLE_SQL["known_ports"]})
SELECT p.proto, sport, dport, count(*) AS n, coalesce(max(a.protocol), max(b.protocol)) AS guess
FROM p LEFT JOIN k a ON a.port = sport AND a.transport = CASE WHEN proto = 6 THEN 'tcp' ELSE 'udp' END
LEFT JOIN k b ON b.port = dport AND b.transport = CASE WHEN proto = 6 THEN 'tcp' ELSE 'udp' END
GROUP BY 1, 2, 3
"""


def unmatched_ports(spark, sf_dir):
    """Destination ports that no protocol is known for (anti join)."""
    ports = names.dimension(spark, "known_ports").select(F.when(F.col("transport") == "tcp", 6).otherwise(17).alias("proto"), F.col("port").alias("dport"))
    rows = fixtures.columns(spark, sf_dir).withColumn("dport", F.col("dport").cast("int"))
    return rows.join(F.broadcast(ports), ["proto", "dport"], "left_anti").groupBy("proto", "dport").agg(F.count("*").alias("n"))


QUERIES["unmatched_ports"] = unmatched_ports
ORACLE_SQL["unmatched_ports"] = f"""
WITH p AS ({fixtures.PACKETS_SQL}), k AS ({ORACLE_SQL["known_ports"]})
SELECT proto, dport, count(*) AS n FROM p
WHERE NOT EXISTS (SELECT 1 FROM k WHERE port = dport AND transport = CASE WHEN proto = 6 THEN 'tcp' ELSE 'udp' END) GROUP BY 1, 2
"""


def flow_hashes(spark, sf_dir):
    rows = fixtures.columns(spark, sf_dir).select("src", "sport", "dst", "dport", "proto").distinct()
    args = [F.col(c).cast("long") for c in ("src", "sport", "dst", "dport", "proto")]
    return rows.select(
        "src", "sport", "dst", "dport", "proto",
        names.flow_hash_simple(*args).alias("simple"), names.flow_hash_fnv(*args).alias("fnv"), names.flow_hash_bkdr(*args).alias("bkdr"), names.flow_hash_murmur3(*args).alias("murmur3"),
    )


QUERIES["flow_hashes"] = flow_hashes
_low = "(src < dst OR (src = dst AND sport <= dport))"
_key = (
    f"[x & 255 for x in [lo >> 24, lo >> 16, lo >> 8, lo, hi >> 24, hi >> 16, hi >> 8, hi, proto, lp >> 8, lp, hp >> 8, hp]]"
)
ORACLE_SQL["flow_hashes"] = f"""
WITH p AS (SELECT DISTINCT src, sport, dst, dport, proto FROM ({fixtures.PACKETS_SQL})),
e AS (SELECT *, CASE WHEN {_low} THEN src ELSE dst END AS lo, CASE WHEN {_low} THEN dst ELSE src END AS hi, CASE WHEN {_low} THEN sport ELSE dport END AS lp, CASE WHEN {_low} THEN dport ELSE sport END AS hp FROM p),
k AS (SELECT *, {_key} AS b FROM e),
w AS (SELECT *, [b[4*i+1]::HUGEINT + b[4*i+2]::HUGEINT * 256 + b[4*i+3]::HUGEINT * 65536 + b[4*i+4]::HUGEINT * 16777216 for i in [0, 1, 2]] AS k3,
  [b[i]::HUGEINT for i in [4, 3, 2, 1, 8, 7, 6, 5, 9, 11, 10, 13, 12]] AS f, [CASE WHEN x > 127 THEN x - 256 ELSE x END::HUGEINT for x in b] AS s FROM k),
t AS (SELECT *, [((x * 3432918353) % 4294967296) for x in k3 || [b[13]::HUGEINT]] AS m1 FROM w),
u AS (SELECT *, [(((((x * 32768) % 4294967296) + x // 131072)) * 461845907) % 4294967296 for x in m1] AS m2 FROM t),
v AS (SELECT *, list_reduce([0::HUGEINT] || m2[1:3], lambda h, x: (((xor(h, x) * 8192) % 4294967296 + xor(h, x) // 524288) * 5 + 3864292196) % 4294967296) AS h0 FROM u),
z1 AS (SELECT *, xor(xor(h0, m2[4]), 13::HUGEINT) AS h1 FROM v), z2 AS (SELECT *, (xor(h1, h1 // 65536) * 2246822507) % 4294967296 AS h2 FROM z1),
z3 AS (SELECT *, (xor(h2, h2 // 8192) * 3266489909) % 4294967296 AS h3 FROM z2)
SELECT src, sport, dst, dport, proto, (src + dst + sport + dport + proto) % 4294967296 AS simple,
  list_reduce([2166136261::HUGEINT] || f, lambda h, x: (xor(h, x) * 16777619) % 4294967296)::BIGINT AS fnv,
  (list_reduce([0::HUGEINT] || s, lambda h, x: (h * 131 + x + 4294967296) % 4294967296) % 2147483648)::BIGINT AS bkdr,
  xor(h3, h3 // 65536)::BIGINT AS murmur3
FROM z3
"""
