"""Further headers, fields and flow rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from netlens.functions import names
from netlens.operators import flows, headers, l7
from netlens.operators.l7 import Config
from netlens.plans import fixtures as fx
from netlens.plans.q_flows import _KEYED
from netlens.plans.q_l7 import _ID_NAMES, _KINDS, _PAGES_SQL, _carried, _classified, _pages, conversations, exchanges

QUERIES, ORACLE_SQL = {}, {}


def from_l4(spark, sf_dir):
    """Segments whose addresses and protocol are given as columns."""
    rows = fx.columns(spark, sf_dir)
    body = F.repeat(F.lit("61"), F.col("plen").cast("int"))
    rows = rows.select("ord", F.unhex(fx.h("src", 8)).alias("src"), F.unhex(fx.h("dst", 8)).alias("dst"), "proto", F.unhex(fx.l4_hex(body, F.col("plen"))).alias("pkt"))
    return headers.dissect_segments(rows).select("ord", "status", "proto", "sport", "dport", "payload_length")


QUERIES["dissect_from_l4"] = from_l4
ORACLE_SQL["dissect_from_l4"] = f"SELECT ord, 0 AS status, proto, sport, dport, plen AS payload_length FROM ({fx.PACKETS_SQL})"


def l4_truncated(spark, sf_dir):
    """IP packets whose transport header is cut."""
    body = F.substring(fx.l4_hex(F.lit(""), F.lit(0)), 1, 2 * 7)
    rows = fx.columns(spark, sf_dir).select("ord", "proto", F.lit("RAW").alias("dlt"), F.unhex(fx.ipv4_hex(body, F.lit(7), F.col("proto"))).alias("pkt")).withColumnRenamed("proto", "given")
    return headers.dissect(rows).groupBy("given", "status", names.status_message(F.col("status")).alias("message")).agg(F.count("*").alias("n"))


QUERIES["l4_truncated"] = l4_truncated
ORACLE_SQL["l4_truncated"] = f"SELECT proto AS given, -5 AS status, 'Error while parsing the L4 header' AS message, count(*) AS n FROM ({fx.PACKETS_SQL}) GROUP BY 1"


def rst_reopen(spark, sf_dir):
    """Flows that a SYN opened anew after an RST, though their key was not idle."""
    rows = flows.sessionize(headers.dissect(fx.packets(spark, sf_dir)).where("status = 0"), idle_us=10**15)
    return rows.groupBy("proto").agg(F.countDistinct("flow_id").alias("flows"), F.max("seg").alias("most"))


QUERIES["flow_rst_reopen"] = rst_reopen
ORACLE_SQL["flow_rst_reopen"] = f"WITH {_KEYED.replace('30000000', '1000000000000000')} SELECT proto, count(DISTINCT flow_id) AS flows, max(seg) AS most FROM r GROUP BY 1"


_CLOSING = [(0, 2), (0, 17), (1, 17), (0, 24), (1, 17), (0, 17), (1, 24)]


def closings(spark, sf_dir):
    """Per event a conversation that is closed by both sides twice and goes on; as UDP the same packets close nothing."""
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(w).alias("way"), F.lit(f).alias("flags")) for i, (w, f) in enumerate(_CLOSING)])
    rows = fx.columns(spark, sf_dir).select(F.col("ord").alias("n"), F.col("proto").cast("int").alias("proto"), F.explode(steps).alias("s")).select("n", "proto", "s.*")
    out, mine = F.col("way") == 0, F.lit(20000) + F.col("n") % 9000
    client, server = F.lit(167772161) + F.col("n"), F.lit(3232235777)
    made = rows.select(
        (F.col("n") * 8 + F.col("step")).alias("ord"), (F.col("n") * 1000).alias("ts_us"), F.when(out, client).otherwise(server).alias("src"), F.when(out, server).otherwise(client).alias("dst"),
        F.when(out, mine).otherwise(F.lit(7000)).alias("sport"), F.when(out, F.lit(7000)).otherwise(mine).alias("dport"), "proto", "flags", F.lit(8192).alias("win"), F.lit(bytearray(b"ab")).alias("payload"),
    )
    return headers.dissect(fx.payload_packets(made, F.col("payload")))


def _light(proto: int):
    def run(spark, sf_dir):
        rows = closings(spark, sf_dir).where(F.col("proto") == proto)
        return flows.sessionize(rows, fin_closes=True).groupBy("flow_id").agg(F.count("*").alias("packets"), F.max("seg").alias("seg"))

    return run


QUERIES |= {"tcp_light_termination": _light(6), "flow_fin_closes_udp": _light(17)}
ORACLE_SQL["tcp_light_termination"] = f"SELECT ord * 8 + first AS flow_id, n AS packets, seg FROM ({fx.PACKETS_SQL}), (VALUES (0, 3, 0), (3, 3, 1), (6, 1, 2)) AS t(first, n, seg) WHERE proto = 6"
ORACLE_SQL["flow_fin_closes_udp"] = f"SELECT ord * 8 AS flow_id, 7 AS packets, 0 AS seg FROM ({fx.PACKETS_SQL}) WHERE proto = 17"


def sticky(spark, sf_dir):
    """Packets of an SSH conversation before and after it is known."""
    found = _classified(conversations(spark, sf_dir, _ID_NAMES["SSH"]))
    return found.groupBy((F.col("ord") % 8).alias("step"), F.array_join("protocols", ",").alias("stack")).agg(F.count("*").alias("n"))


QUERIES["sticky_protocol"] = sticky
ORACLE_SQL["sticky_protocol"] = f"SELECT step, CASE step WHEN 0 THEN '' ELSE 'SSH' END AS stack, count(*) AS n FROM events, (VALUES (0), (1)) AS t(step) WHERE event_id % {_KINDS} = {_ID_NAMES['SSH']} GROUP BY 1, 2"


def _jpegs(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("n", F.unhex(F.concat(F.lit("ffd8ffe0"), fx.h("n", 16))).alias("image"), F.when(F.col("n") % 3 == 0, "image/jpeg").otherwise("text/plain").alias("kind"))
    head = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nCONTENT-type: "), F.col("kind"), F.lit("\r\nX: 1\r\nX: 2\r\nContent-Length: 12\r\n\r\n")), "UTF-8")
    return _carried(rows, F.concat(head, F.col("image")), 6, 80, ["HTTP_BODY", "HTTP_HEADERS"])[0]


QUERIES["jpeg_bodies"] = lambda spark, sf_dir: l7.bodies(_jpegs(spark, sf_dir), "image/jpeg").select(F.col("ord").alias("page_id"), F.lower(F.hex("body")).alias("body"))
ORACLE_SQL["jpeg_bodies"] = "SELECT page_id, 'ffd8ffe0' || lpad(lower(to_hex(page_id)), 16, '0') AS body FROM pages WHERE page_id % 3 = 0"


def header_get(spark, sf_dir):
    found = _jpegs(spark, sf_dir)
    return found.select(F.col("ord").alias("page_id"), l7.header("content-TYPE").alias("kind"), l7.header("con").alias("con"), F.expr("size(filter(http_headers, h -> h.key = 'X'))").alias("twice"), l7.has_protocol("http").alias("is_http"))


QUERIES["http_header_get"] = header_get
ORACLE_SQL["http_header_get"] = "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'image/jpeg' ELSE 'text/plain' END AS kind, NULL::VARCHAR AS con, 2 AS twice, true AS is_http FROM pages"


def ja3s(spark, sf_dir):
    """Server hellos, and a certificate in a second record."""
    rows = _pages(spark, sf_dir)
    cipher = F.col("n") % 5000 + 100
    body = F.concat(F.lit("0303" + "00" * 32 + "00"), fx.h(cipher, 4), F.lit("00" + "0008" + "00170000" + "ff010000"))
    hello = F.concat(F.lit("02"), fx.h(F.length(body) / 2, 6), body)
    name = F.concat(F.lit("www."), F.col("host"))
    certificate = F.concat(F.lit("5504030c04" + "6e6f6e65" + "5504030c"), fx.h(F.length(name), 2), F.hex(name))
    message = F.concat(F.lit("0b"), fx.h(F.length(certificate) / 2, 6), certificate)
    record = lambda m: F.concat(F.lit("160303"), fx.h(F.length(m) / 2, 4), m)
    found, fields = _carried(rows, F.unhex(F.concat(record(hello), record(message))), 6, 443, ["SSL_HANDSHAKE_TYPE", "SSL_CIPHER_SUITES", "SSL_EXTENSIONS", "SSL_JA3", "SSL_CERTIFICATE"])
    return found.select(F.col("ord").alias("page_id"), *fields)


QUERIES["ja3s"] = ja3s
ORACLE_SQL["ja3s"] = f"""
SELECT n AS page_id, '2' AS ssl_handshake_type, (n % 5000 + 100)::VARCHAR AS ssl_cipher_suites, '23-65281' AS ssl_extensions, md5('771,' || (n % 5000 + 100) || ',23-65281') AS ssl_ja3, 'www.' || host AS ssl_certificate FROM {_PAGES_SQL}
"""


def quic_hello(spark, sf_dir):
    """Client hellos of the first QUIC with server name and user agent."""
    host, agent = F.hex("host"), F.hex(F.concat(F.lit("agent/"), F.col("n").cast("string")))
    swap = lambda x: F.concat(F.substring(x, 7, 2), F.substring(x, 5, 2), F.substring(x, 3, 2), F.substring(x, 1, 2))
    first, second = F.length(host) / 2, F.length(host) / 2 + F.length(agent) / 2
    chlo = F.concat(F.lit("43484c4f" + "0200" + "0000" + "534e4900"), swap(fx.h(first, 8)), F.lit("55414944"), swap(fx.h(second, 8)), host, agent)
    body = F.concat(F.lit("09" + "0011223344556677" + "51303433" + "01" + "a0" * 12), chlo)
    found, fields = _carried(_pages(spark, sf_dir), F.unhex(body), 17, 443, ["QUIC_VERSION", "QUIC_SNI", "QUIC_UAID"])
    return found.select(F.col("ord").alias("page_id"), F.array_join("protocols", ",").alias("stack"), *fields)


QUERIES["quic_sni"] = quic_hello
ORACLE_SQL["quic_sni"] = f"SELECT n AS page_id, 'QUIC' AS stack, 'Q043' AS quic_version, host AS quic_sni, 'agent/' || n AS quic_uaid FROM {_PAGES_SQL}"


def rtcp_receiver(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("n"), "user_id")
    body = F.concat(F.lit("81c90007"), fx.h("user_id", 8), *[fx.h(F.col("n") + i, 8) for i in range(1, 7)])
    names_ = "SSRC ID FLCNPL EXT_SEQN_RCV INT_JITTER LSR DELAY_LSR".split()
    found, fields = _carried(rows, F.unhex(body), 17, 5005, [f"RTCP_RECEIVER_{x}" for x in names_])
    return found.select(F.col("ord").alias("event_id"), *fields)


QUERIES["rtcp_receiver"] = rtcp_receiver
ORACLE_SQL["rtcp_receiver"] = "SELECT event_id, user_id::VARCHAR AS rtcp_receiver_ssrc, " + ", ".join(f"(event_id + {i + 1})::VARCHAR AS rtcp_receiver_{x.lower()}" for i, x in enumerate("ID FLCNPL EXT_SEQN_RCV INT_JITTER LSR DELAY_LSR".split())) + " FROM events"


def accuracy(spark, sf_dir):
    """A SIP request without From and To is one at low accuracy only."""
    text = b"INVITE sip:b@b SIP/2.0\r\nCall-ID: 1\r\n\r\n"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("n"))
    rows = rows.withColumns({"ord": F.col("n"), "ts_us": F.col("n"), "src": F.lit(167772161) + F.col("n"), "dst": F.lit(3232235777), "sport": F.lit(900), "dport": F.lit(7000), "proto": F.lit(17), "flags": F.lit(0), "win": F.lit(0)})
    packets = fx.payload_packets(rows, F.lit(bytearray(text)))
    both = [_classified(packets, Config(accuracy=a, protocols=("SIP",), reorder=False)).select(F.lit(a).alias("accuracy"), F.array_join("protocols", ",").alias("stack")) for a in ("low", "high")]
    return both[0].unionByName(both[1]).groupBy("accuracy", "stack").agg(F.count("*").alias("n"))


QUERIES["accuracy_levels"] = accuracy
ORACLE_SQL["accuracy_levels"] = "SELECT accuracy, CASE accuracy WHEN 'low' THEN 'SIP' ELSE 'Unknown' END AS stack, count(*) AS n FROM events, (VALUES ('low'), ('high')) AS t(accuracy) GROUP BY 1"


def typed_fields(spark, sf_dir):
    """Responses with their fields as typed columns."""
    wanted = ("HTTP_STATUS_CODE", "HTTP_VERSION_MAJOR", "HTTP_VERSION_MINOR", "HTTP_BODY", "HTTP_HEADERS", "SSL_SNI")
    found = l7.typed(_classified(exchanges(spark, sf_dir), Config(fields=wanted, reorder=True)), wanted).where("http.body is not null")
    return found.select(
        F.col("n").alias("page_id"), (F.col("http.status_code") + 1).alias("next_code"), (F.col("http.version_major") * 10 + F.col("http.version_minor")).alias("version"), F.length("http.body").alias("size"),
        F.sha2("http.body", 256).alias("sha256"), F.col("http.headers")[0]["value"].alias("first_header"), F.col("ssl").isNull().alias("no_ssl"), F.typeof("http.status_code").alias("kind"), F.typeof("http.body").alias("body_kind"),
    )


QUERIES["typed_fields"] = typed_fields
ORACLE_SQL["typed_fields"] = """
SELECT page_id, 201 AS next_code, 11 AS version, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS sha256, 'text/html' AS first_header, true AS no_ssl, 'bigint' AS kind, 'binary' AS body_kind FROM pages
"""


def tagged_packets(spark, sf_dir):
    """Requests tagged by URL and by headers; only the rules say which fields are read."""
    schema = "seq long, key string, value string, matchingType string, tag string"
    urls = spark.createDataFrame([(0, None, "/e", "PREFIX", "english"), (1, None, ".html", "SUFFIX", "page"), (2, None, "/", "SUFFIX", "folder")], schema)
    names_ = spark.createDataFrame([(0, "host", "blog.", "PREFIX", "blog"), (1, "HOST", ".org", "SUFFIX", "org"), (2, "user-agent", "t", "EXACT", "agent")], schema)
    rows = flows.sessionize(headers.dissect(_requests(spark, sf_dir)))
    found = l7.tagged(rows, {"HTTP_HEADERS": names_, "HTTP_URL": urls}, Config(reorder=False))
    return found.select(F.col("ord").alias("page_id"), F.array_join("tags", ",").alias("tags"))


def _requests(spark, sf_dir):
    rows = _pages(spark, sf_dir)
    text = F.concat(F.lit("GET /"), F.regexp_replace("path", "^/", ""), F.lit(" HTTP/1.1\r\nHost: "), F.col("host"), F.lit("\r\nUser-Agent: t\r\n\r\n"))
    rows = rows.withColumns({
        "ord": F.col("n"), "ts_us": F.col("n") * 1000, "src": F.lit(167772161) + F.col("n") % 1000000, "dst": F.lit(3232235777), "sport": 20000 + F.col("n") % 8000, "dport": F.lit(80),
        "proto": F.lit(6), "flags": F.lit(24), "win": F.lit(8192),
    })
    return fx.payload_packets(rows, F.encode(text, "UTF-8"))


QUERIES["tags_on_packets"] = tagged_packets
ORACLE_SQL["tags_on_packets"] = f"""
SELECT n AS page_id, concat_ws(',', CASE WHEN starts_with(lower(url_), '/e') THEN 'english' WHEN ends_with(lower(url_), '.html') THEN 'page' WHEN ends_with(url_, '/') THEN 'folder' END,
  CASE WHEN starts_with(lower(host), 'blog.') THEN 'blog' WHEN ends_with(lower(host), '.org') THEN 'org' END, 'agent') AS tags
FROM (SELECT *, '/' || regexp_replace(path, '^/', '') AS url_ FROM {_PAGES_SQL})
"""


def sip_answers(spark, sf_dir):
    """Responses with two identities and a quality report as body."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("n"))
    n = F.col("n").cast("string")
    text = F.concat(
        F.lit("SIP/2.0 486 Busy Here\r\nVia: SIP/2.0/UDP a.example;branch=z"), n, F.lit("\r\nFrom: \"A\" <sip:al@a.example>;tag=f\r\nTo: <sip:u"), n, F.lit("@b.example>;tag=t"), n,
        F.lit("\r\nCall-ID: c"), n, F.lit("\r\nCSeq: 2 INVITE\r\nP-Asserted-Identity: <sip:x@p.example>\r\nP-Preferred-Identity: <sip:y@q.example>\r\n\r\nVQSessionReport\r\nCallID: x"), n, F.lit("\r\n"),
    )
    wanted = "METHOD REASON VIA FROM_URI TO_DOMAIN TO_TAG PAI_DOMAIN PID_URI RTCPXR_CALLID RURI_URI".split()
    found, fields = _carried(rows, F.encode(text, "UTF-8"), 17, 5060, [f"SIP_{x}" for x in wanted])
    return found.select(F.col("ord").alias("c_custkey"), *fields)


QUERIES["sip_answers"] = sip_answers
ORACLE_SQL["sip_answers"] = """
SELECT c_custkey, '486' AS sip_method, 'Busy Here' AS sip_reason, 'SIP/2.0/UDP a.example;branch=z' || c_custkey AS sip_via, 'sip:al@a.example' AS sip_from_uri, 'b.example' AS sip_to_domain, 't' || c_custkey AS sip_to_tag,
  'p.example' AS sip_pai_domain, 'sip:y@q.example' AS sip_pid_uri, 'x' || c_custkey AS sip_rtcpxr_callid, NULL::VARCHAR AS sip_ruri_uri FROM customer
"""


def dns_answers(spark, sf_dir):
    """Two addresses and the server that answers for the zone."""
    labels = F.expr("aggregate(split(host, '[.]'), '', (a, x) -> concat(a, lpad(hex(length(x)), 2, '0'), hex(x)))")
    address = lambda first: F.concat(F.lit("c00c" + "00010001" + "00000e10" + "0004" + first), fx.h(F.col("n") % 16777216, 6))
    zone = F.lit("c00c" + "00020001" + "00000e10" + "0005" + "026e73c00c")
    body = F.concat(fx.h(F.col("n") % 65536, 4), F.lit("8180" + "0001000200010000"), labels, F.lit("00" + "00010001"), address("0a"), address("0b"), zone)
    found, fields = _carried(_pages(spark, sf_dir), F.unhex(body), 17, 53, ["DNS_NS_IP_1", "DNS_NS_IP_2", "DNS_AUTH_SRV"])
    return found.select(F.col("ord").alias("page_id"), *fields)


QUERIES["dns_answers"] = dns_answers
_IP = "concat_ws('.', {0}, (n // 65536) % 256, (n // 256) % 256, n % 256)"
ORACLE_SQL["dns_answers"] = f"SELECT n AS page_id, {_IP.format(10)} AS dns_ns_ip_1, {_IP.format(11)} AS dns_ns_ip_2, 'ns.' || host AS dns_auth_srv FROM {_PAGES_SQL}"


def rtcp_all(spark, sf_dir):
    """One name that asks for all fields of a sender's report."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("n"), "user_id")
    body = F.concat(F.lit("81c8000c"), fx.h("user_id", 8), *[fx.h(F.col("n") + i, 8) for i in range(1, 12)])
    found, _ = _carried(rows, F.unhex(body), 17, 5005, ["RTCP_SENDER_ALL"])
    wanted = {"TIME_LSW": 2, "TIME_RTP": 3, "FLCNPL": 7, "EXT_SEQN_RCV": 8, "LSR": 10, "DELAY_LSR": 11}
    return found.select(F.col("ord").alias("event_id"), *[F.col("fields")[f"RTCP_SENDER_{k}"].alias(k.lower()) for k in wanted])


QUERIES["rtcp_all"] = rtcp_all
ORACLE_SQL["rtcp_all"] = """
SELECT event_id, (event_id + 2)::VARCHAR AS time_lsw, (event_id + 3)::VARCHAR AS time_rtp, (event_id + 7)::VARCHAR AS flcnpl, (event_id + 8)::VARCHAR AS ext_seqn_rcv, (event_id + 10)::VARCHAR AS lsr, (event_id + 11)::VARCHAR AS delay_lsr FROM events
"""


def jsonrpc_answers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("n"), "event_type", "user_id")
    good = F.concat(F.lit('"result": [1, '), F.col("user_id").cast("string"), F.lit("]"))
    bad = F.concat(F.lit('"error": {"code": -1, "message": "'), F.col("event_type"), F.lit('"}'))
    text = F.concat(F.lit('{"jsonrpc": "2.0", '), F.when(F.col("n") % 2 == 0, good).otherwise(bad), F.lit(', "id": '), F.col("n").cast("string"), F.lit("}"))
    found, fields = _carried(rows, F.encode(text, "UTF-8"), 6, 4000, ["JSON_RPC_MSG_TYPE", "JSON_RPC_ID", "JSON_RPC_RESULT", "JSON_RPC_ERROR"])
    return found.select(F.col("ord").alias("event_id"), *fields)


QUERIES["jsonrpc_answers"] = jsonrpc_answers
ORACLE_SQL["jsonrpc_answers"] = """
SELECT event_id, '1' AS json_rpc_msg_type, event_id::VARCHAR AS json_rpc_id, CASE WHEN event_id % 2 = 0 THEN '[1,' || user_id || ']' END AS json_rpc_result,
  CASE WHEN event_id % 2 = 1 THEN '{"code":-1,"message":"' || event_type || '"}' END AS json_rpc_error FROM events
"""
