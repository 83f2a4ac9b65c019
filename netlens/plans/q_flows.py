"""Flow queries over packet bytes, stated by windows over the encoded columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.functions import names
from netlens.operators import flows, headers
from netlens.plans import fixtures as fx

QUERIES, ORACLE_SQL = {}, {}
_ADDR = "concat_ws('.', {0} // 16777216, ({0} // 65536) % 256, ({0} // 256) % 256, {0} % 256)"

_KEYED = f"""
p AS (SELECT *, 20 + CASE WHEN proto = 17 THEN 8 ELSE 20 END + plen AS bytes, (flags // 2) % 2 = 1 AS syn, flags % 2 = 1 AS fin, (flags // 4) % 2 = 1 AS rst FROM ({fx.PACKETS_SQL})),
k AS (SELECT *, least(src, dst) AS a, greatest(src, dst) AS b, CASE WHEN src < dst THEN sport ELSE dport END AS ap, CASE WHEN src < dst THEN dport ELSE sport END AS bp FROM p),
g AS (SELECT *, coalesce(ts_us - lag(ts_us) OVER w > 30000000, false) AS gap FROM k WINDOW w AS (PARTITION BY a, b, ap, bp, proto ORDER BY ord)),
g2 AS (SELECT *, max(CASE WHEN gap THEN ord END) OVER (PARTITION BY a, b, ap, bp, proto ORDER BY ord) AS since FROM g),
g3 AS (SELECT *, max(CASE WHEN rst THEN ord END) OVER w AS lr, max(CASE WHEN syn THEN ord END) OVER w AS ls FROM g2
       WINDOW w AS (PARTITION BY a, b, ap, bp, proto ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g4 AS (SELECT *, gap OR coalesce(proto = 6 AND syn AND lr >= coalesce(since, -1) AND lr >= coalesce(CASE WHEN ls >= coalesce(since, -1) THEN ls END, -1), false) AS brk FROM g3),
g5 AS (SELECT *, sum(brk::INT) OVER (PARTITION BY a, b, ap, bp, proto ORDER BY ord)::INT AS seg FROM g4),
f AS (SELECT *, first_value(src) OVER w AS fsrc, first_value(sport) OVER w AS fport, first_value(ord) OVER w AS flow_id FROM g5 WINDOW w AS (PARTITION BY a, b, ap, bp, proto, seg ORDER BY ord)),
r AS (SELECT *, CASE WHEN src = fsrc AND sport = fport THEN 0 ELSE 1 END AS d FROM f)
"""


def _rows(spark, sf_dir):
    return flows.sessionize(headers.dissect(fx.packets(spark, sf_dir)).where("status = 0"))


def flow_key(spark, sf_dir):
    rows = headers.ethernet_ip(fx.packets(spark, sf_dir)).withColumn("k", flows.flow_key())
    text = lambda end: F.concat_ws(":", names.ip_text(F.col(f"k.{end}.ip")), F.col(f"k.{end}.port"))
    return rows.groupBy(text("lo").alias("lo"), text("hi").alias("hi"), F.col("k.proto").alias("proto")).agg(F.count("*").alias("n"))


QUERIES["flow_key"] = flow_key
ORACLE_SQL["flow_key"] = f"WITH {_KEYED} SELECT concat_ws(':', {_ADDR.format('a')}, ap) AS lo, concat_ws(':', {_ADDR.format('b')}, bp) AS hi, proto, count(*) AS n FROM k GROUP BY ALL"
QUERIES["flow_sessionize"] = lambda spark, sf_dir: _rows(spark, sf_dir).select("ord", "seg", "flow_id", "dir")
ORACLE_SQL["flow_sessionize"] = f"WITH {_KEYED} SELECT ord, seg, flow_id, d AS dir FROM r"
QUERIES["flow_direction"] = lambda spark, sf_dir: _rows(spark, sf_dir).groupBy("flow_id").agg(F.count_if(F.col("dir") == 0).alias("forth"), F.count_if(F.col("dir") == 1).alias("back"))
ORACLE_SQL["flow_direction"] = f"WITH {_KEYED} SELECT flow_id, count(*) FILTER (d = 0) AS forth, count(*) FILTER (d = 1) AS back FROM r GROUP BY 1"


def flow_summary(spark, sf_dir):
    """One row per flow: who, what and how much, in both directions."""
    links = {"l2": F.min_by("dlt", "ord"), "l3": F.min_by(F.when(F.col("l3_version") == 4, "IPv4").otherwise("IPv6"), "ord")}
    rows = flows.statistics(_rows(spark, sf_dir), ["packets", "bytes", "l7_packets", "l7_bytes", "timestamp_first", "timestamp_last"], links)
    rows = rows.withColumns({"addr_src": names.ip_text(F.col("src")), "addr_dst": names.ip_text(F.col("dst")), "l4": names.l4_name(F.col("proto"))})
    counts = [c for c in rows.columns if c.endswith(("_0", "_1"))]
    return rows.select("flow_id", "l2", "l3", "l4", "addr_src", "addr_dst", F.col("sport").alias("port_src"), F.col("dport").alias("port_dst"), *counts)


QUERIES["flow_summary"] = flow_summary
ORACLE_SQL["flow_summary"] = f"""
WITH {_KEYED}
SELECT flow_id, 'EN10MB' AS l2, 'IPv4' AS l3, CASE WHEN proto = 6 THEN 'TCP' ELSE 'UDP' END AS l4, {_ADDR.format("arg_min(src, ord)")} AS addr_src, {_ADDR.format("arg_min(dst, ord)")} AS addr_dst,
  arg_min(sport, ord) AS port_src, arg_min(dport, ord) AS port_dst,
  count(*) FILTER (d = 0) AS packets_0, count(*) FILTER (d = 1) AS packets_1, coalesce(sum(bytes) FILTER (d = 0), 0)::BIGINT AS bytes_0, coalesce(sum(bytes) FILTER (d = 1), 0)::BIGINT AS bytes_1,
  count(*) FILTER (d = 0 AND plen > 0) AS l7_packets_0, count(*) FILTER (d = 1 AND plen > 0) AS l7_packets_1, coalesce(sum(plen) FILTER (d = 0), 0)::BIGINT AS l7_bytes_0, coalesce(sum(plen) FILTER (d = 1), 0)::BIGINT AS l7_bytes_1,
  arg_min(ts_us, ord) FILTER (d = 0) AS timestamp_first_0, arg_min(ts_us, ord) FILTER (d = 1) AS timestamp_first_1, arg_max(ts_us, ord) FILTER (d = 0) AS timestamp_last_0, arg_max(ts_us, ord) FILTER (d = 1) AS timestamp_last_1
FROM r GROUP BY flow_id, proto
"""


def flow_flags(spark, sf_dir):
    return flows.statistics(_rows(spark, sf_dir), ["syn", "fin", "rst", "zero_window"]).drop("flow_key", "seg", "src", "sport", "dst", "dport", "proto")


QUERIES["flow_stats_flags"] = flow_flags
ORACLE_SQL["flow_stats_flags"] = f"WITH {_KEYED} SELECT flow_id, " + ", ".join(
    f"count(*) FILTER (d = {d} AND {test}) AS {name}_{d}" for name, test in (("syn", "syn"), ("fin", "fin"), ("rst", "rst"), ("zero_window", "proto = 6 AND win = 0")) for d in (0, 1)
) + " FROM r GROUP BY flow_id"


def splt(spark, sf_dir):
    found = flows.packet_times(_rows(spark, sf_dir))
    return found.select("flow_id", "dir", F.array_join("lengths", ",").alias("lengths"), F.array_join("times", ",").alias("times"))


QUERIES["splt"] = splt
ORACLE_SQL["splt"] = f"""
WITH {_KEYED}, s AS (SELECT *, row_number() OVER w AS n, coalesce(ts_us - lag(ts_us) OVER w, 0) AS dt FROM r WHERE plen > 0 WINDOW w AS (PARTITION BY flow_id, d ORDER BY ord))
SELECT flow_id, d AS dir, string_agg(plen::VARCHAR, ',' ORDER BY n) AS lengths, string_agg(dt::VARCHAR, ',' ORDER BY n) AS times FROM s WHERE n <= 10 GROUP BY 1, 2
"""


def handshakes(spark, sf_dir):
    """Three-packet handshakes, one per event, with a window scale option."""
    rows = fx.columns(spark, sf_dir).where("proto = 6").select("ord", "ts_us", F.col("ord").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("step"), (F.col("plen") + 1).alias("lag"))
    out = F.col("step") % 2 == 0
    rows = rows.withColumns({
        "ord": F.col("n") * 4 + F.col("step"), "ts_us": F.col("ts_us") + F.col("lag") * F.col("step") * (F.col("step") + 1),
        "src": F.when(out, F.lit(167772161)).otherwise(F.lit(167772162)), "dst": F.when(out, F.lit(167772162)).otherwise(F.lit(167772161)),
        "sport": F.when(out, 20000 + F.col("n") % 30000).otherwise(F.lit(80)), "dport": F.when(out, F.lit(80)).otherwise(20000 + F.col("n") % 30000),
        "proto": F.lit(6), "flags": F.element_at(F.array(*map(F.lit, (2, 18, 16, 16))), F.col("step") + 1), "seq": F.when(out, 100 + F.col("n") + (F.col("step") > 0).cast("int")).otherwise(F.lit(9000) + (F.col("step") > 1).cast("int")),
        "ack": F.when(F.col("step") == 0, F.lit(0)).when(out, F.lit(9001)).otherwise(101 + F.col("n")),
    })
    option = F.when(F.col("step") < 2, F.concat(F.lit("01030300"[:6]), fx.h(F.col("n") % 15, 2))).otherwise(F.lit(""))
    size = F.when(F.col("step") < 2, F.lit(24)).otherwise(F.lit(20))
    tcp = F.concat(fx.h("sport", 4), fx.h("dport", 4), fx.h("seq", 8), fx.h("ack", 8), F.when(F.col("step") < 2, "60").otherwise("50"), fx.h("flags", 2), F.lit("2000" + "00000000"), option)
    return rows.select("ord", "n", "ts_us", F.lit("EN10MB").alias("dlt"), fx.as_packet(fx.ethernet_hex(fx.ipv4_hex(tcp, size, F.lit(6)))).alias("pkt"))


def flow_rtt(spark, sf_dir):
    rows = headers.dissect(handshakes(spark, sf_dir))
    found = flows.statistics(flows.round_trips(flows.sessionize(rows)), ["rtt_syn_ack", "window_scaling", "packets"])
    return found.select("flow_id", "rtt_syn_ack_0", "rtt_syn_ack_1", "window_scaling_0", "window_scaling_1", "packets_0", "packets_1")


QUERIES["flow_stats_rtt_window_scaling"] = flow_rtt
ORACLE_SQL["flow_stats_rtt_window_scaling"] = f"""
SELECT ord * 4 AS flow_id, 2 * (plen + 1) AS rtt_syn_ack_0, 4 * (plen + 1) AS rtt_syn_ack_1, ord % 15 AS window_scaling_0, ord % 15 AS window_scaling_1, 2 AS packets_0, 2 AS packets_1
FROM ({fx.PACKETS_SQL}) WHERE proto = 6
"""


_LIVE, _CAP, _PAUSE = 8, 5, 1000


def round_robin(spark, sf_dir):
    """Packets of ``_LIVE`` flows in turn, with a pause that ends all of them after each ``_PAUSE``."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("ord"))
    rows = rows.withColumns({
        "ts_us": F.col("ord") * 1000 + F.floor(F.col("ord") / _PAUSE) * 31_000_000, "src": F.lit(167772161) + F.col("ord") % _LIVE, "dst": F.lit(3232235777), "sport": F.lit(4000), "dport": F.lit(7000),
        "proto": F.lit(17), "flags": F.lit(0), "win": F.lit(0),
    })
    return headers.dissect(fx.payload_packets(rows, F.lit(bytearray(b"x")))).withColumn("flow_key", flows.flow_key())


def flow_cap(strategy):
    return lambda spark, sf_dir: flows.cap(round_robin(spark, sf_dir), _CAP, strategy, slices=1)


QUERIES |= {"flow_cap_skip": flow_cap("skip"), "flow_cap_evict": flow_cap("evict")}
ORACLE_SQL["flow_cap_skip"] = f"SELECT event_id AS ord, event_id % {_LIVE} < {_CAP} AS admitted, NULL::BIGINT AS evicted FROM events"
# the flow whose turn it is was always evicted by then, so each packet needs a place, and takes that of the packet _CAP before
ORACLE_SQL["flow_cap_evict"] = f"SELECT event_id AS ord, true AS admitted, CASE WHEN event_id % {_PAUSE} >= {_CAP} THEN event_id - {_CAP} END AS evicted FROM events"


def flow_refused(spark, sf_dir):
    found = flows.refused(round_robin(spark, sf_dir), _CAP, slices=1)
    return found.groupBy("status", names.status_message(F.col("status")).alias("message")).agg(F.count("*").alias("n"))


QUERIES["flow_cap_status"] = flow_refused
ORACLE_SQL["flow_cap_status"] = f"""
SELECT CASE WHEN event_id % {_LIVE} < {_CAP} THEN 0 ELSE -4 END AS status, CASE WHEN event_id % {_LIVE} < {_CAP} THEN 'Everything is ok' ELSE 'The maximum number of flows has been reached' END AS message, count(*) AS n FROM events GROUP BY 1, 2
"""


def top_talkers(spark, sf_dir):
    rows = headers.dissect(fx.packets(spark, sf_dir)).where("status = 0")
    return rows.groupBy(names.ip_text(F.col("src")).alias("src")).agg(F.sum(F.col("l3_length") + F.col("l4_bytes")).alias("bytes"), F.count("*").alias("packets")).orderBy(F.desc("bytes"), "src").limit(5)


QUERIES["top_talkers"] = top_talkers
ORACLE_SQL["top_talkers"] = f"WITH {_KEYED} SELECT {_ADDR.format('src')} AS src, sum(bytes)::BIGINT AS bytes, count(*) AS packets FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"


def rollup(spark, sf_dir):
    rows = headers.dissect(fx.packets(spark, sf_dir)).where("status = 0")
    l7 = names.l7_display(names.port_guess(F.col("proto"), F.col("sport"), F.col("dport")))
    rows = rows.select(F.lit("IPv4").alias("l3"), names.l4_name(F.col("proto")).alias("l4"), l7.alias("l7"), "payload_length")
    return rows.rollup("l3", "l4", "l7").agg(F.count("*").alias("packets"), F.sum("payload_length").alias("bytes"))


QUERIES["rollup_l3_l4_l7"] = rollup
ORACLE_SQL["rollup_l3_l4_l7"] = f"""
SELECT l3, l4, l7, count(*) AS packets, sum(plen)::BIGINT AS bytes FROM (SELECT 'IPv4' AS l3, CASE WHEN proto = 6 THEN 'TCP' ELSE 'UDP' END AS l4,
  CASE event_type WHEN 'click' THEN 'HTTP' WHEN 'view' THEN 'SSL' WHEN 'purchase' THEN 'SMTP' WHEN 'signup' THEN 'DNS' ELSE 'SSH' END AS l7, plen FROM ({fx.PACKETS_SQL})) GROUP BY ROLLUP (l3, l4, l7)
"""


def per_minute(spark, sf_dir):
    rows = headers.dissect(fx.packets(spark, sf_dir)).where("status = 0")
    return rows.groupBy(F.floor(F.col("ts_us") / 60_000_000).alias("minute")).agg(F.count("*").alias("packets"), F.sum("payload_length").alias("bytes"))


QUERIES["traffic_per_minute"] = per_minute
ORACLE_SQL["traffic_per_minute"] = f"SELECT ts_us // 60000000 AS minute, count(*) AS packets, sum(plen)::BIGINT AS bytes FROM ({fx.PACKETS_SQL}) GROUP BY 1"


def request_response(spark, sf_dir):
    """Each packet of the server with the last one of the client before it in the flow (as-of, by window)."""
    from pyspark.sql import Window

    rows = _rows(spark, sf_dir)
    w = Window.partitionBy("flow_key", "seg").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("dir") == 0, F.struct("ord", "ts_us")), True).over(w)
    return rows.withColumn("q", asked).where((F.col("dir") == 1) & F.col("q").isNotNull()).select("ord", F.col("q.ord").alias("request"), (F.col("ts_us") - F.col("q.ts_us")).alias("wait_us"))


QUERIES["request_response_join"] = request_response
ORACLE_SQL["request_response_join"] = f"""
WITH {_KEYED}, q AS (SELECT ord, flow_id, ts_us FROM r WHERE d = 0)
SELECT a.ord, q.ord AS request, a.ts_us - q.ts_us AS wait_us FROM (SELECT * FROM r WHERE d = 1) a ASOF JOIN q ON a.flow_id = q.flow_id AND a.ord > q.ord
"""
