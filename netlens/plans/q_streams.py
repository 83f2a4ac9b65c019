"""Tags, reassembly, search and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from netlens.operators import defrag, flows, headers, l7, search, tags, tcp
from netlens.plans import fixtures as fx
from netlens.plans.q_l7 import _pages, exchanges
from netlens.streaming import tracker

QUERIES, ORACLE_SQL = {}, {}


def shared_folder(spark) -> str:
    """A folder that driver and executors share: the checkpoint folder of the session, a temporary one only where none is set."""
    context = spark.sparkContext
    return (context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="netlens-")).removeprefix("file:")


_RULES = [
    ("https://", "PREFIX", "secure"), ("https://blog.", "PREFIX", "blog"), ("http://m.", "PREFIX", "mobile"), (".html", "SUFFIX", "page"), ("/", "SUFFIX", "folder"), ("#top", "SUFFIX", "top"), ("http://www.", "PREFIX", "www"),
]


def _rules(spark):
    return spark.createDataFrame([(i, None, v, k, t) for i, (v, k, t) in enumerate(_RULES)], "seq long, key string, value string, matchingType string, tag string")


def tag_urls(spark, sf_dir):
    return tags.lookup(_pages(spark, sf_dir), _rules(spark), "url", ["n"]).withColumnRenamed("n", "page_id")


QUERIES["tags_priority"] = tag_urls
_values = ", ".join(f"('{v}', '{k}', '{t}', {i})" for i, (v, k, t) in enumerate(_RULES))
ORACLE_SQL["tags_priority"] = f"""
SELECT page_id, arg_max(tag, CASE kind WHEN 'PREFIX' THEN 3000 WHEN 'EXACT' THEN 2000 ELSE 1000 END + length(value)) AS tag FROM pages JOIN (VALUES {_values}) AS r(value, kind, tag, seq)
ON CASE kind WHEN 'PREFIX' THEN starts_with(lower(url), value) ELSE ends_with(lower(url), value) END GROUP BY 1
"""


def tag_headers(spark, sf_dir):
    """Tags of header lists, looked up by name whatever its case."""
    rules = spark.createDataFrame([(0, "Host", "blog.", "PREFIX", "blog"), (1, "HOST", ".org", "SUFFIX", "org"), (2, "x-id", "7", "EXACT", "seven")], "seq long, key string, value string, matchingType string, tag string")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    rows = _pages(spark, sf_dir).select("n", F.array(pair("x-ID", (F.col("n") % 10).cast("string")), pair("hOst", F.upper("host"))).alias("h"))
    return tags.of_pairs(rows, rules, "h", ["n"]).select(F.col("n").alias("page_id"), F.array_join("tags", ",").alias("tags"))


QUERIES["tags_mmap"] = tag_headers
ORACLE_SQL["tags_mmap"] = """
SELECT page_id, concat_ws(',', CASE WHEN page_id % 10 = 7 THEN 'seven' END, t) AS tags FROM (SELECT page_id, CASE WHEN starts_with(h, 'blog.') THEN 'blog' WHEN ends_with(h, '.org') THEN 'org' END AS t
FROM (SELECT page_id, lower(regexp_extract(url, '//([^/?#]+)', 1)) AS h FROM pages)) WHERE page_id % 10 = 7 OR t IS NOT NULL
"""


#: Bytes of a document in one datagram, and of a fragment.
_DATAGRAM, _PIECE = 60_000, 512


def fragments(spark, sf_dir, v6: bool = False):
    """Whole documents in UDP datagrams of at most ``_DATAGRAM`` bytes, cut into pieces of ``_PIECE`` bytes in an order set by a hash, some twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    docs = docs.select("doc_id", "body", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("body") - 1, F.lit(0)) / _DATAGRAM).cast("int"))).alias("part"))
    docs = docs.select("doc_id", "part", F.substring("body", F.col("part") * _DATAGRAM + 1, F.lit(_DATAGRAM)).alias("body"))
    udp = F.concat(F.lit("13881389"), fx.h(F.length("body") + 8, 4), F.lit("0000"), F.hex("body"))
    whole = docs.select("doc_id", "part", F.unhex(udp).alias("udp"))
    last = ((F.length("udp") - 1) / _PIECE).cast("int")
    pieces = whole.select("doc_id", "part", "udp", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    pieces = pieces.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 2).cast("int"))))
    pieces = pieces.withColumn("o", F.abs(F.hash("doc_id", "part", "k", "copy")) % 1000)
    part = F.substring("udp", F.col("k") * _PIECE + 1, F.lit(_PIECE))
    more = F.when(F.length("udp") > (F.col("k") + 1) * _PIECE, 1).otherwise(0)
    n, server = F.length(part), F.lit(3232235777) + F.col("part")
    if v6:
        body = F.concat(F.lit("1100"), fx.h(F.col("k") * _PIECE + more, 4), fx.h(F.col("doc_id"), 8), F.hex(part))
        hexed = fx.ipv6_hex(body, n + 8, F.lit(44), F.lit(167772161), server)
    else:
        hexed = fx.ipv4_hex(F.hex(part), n, F.lit(17), F.lit(167772160) + F.shiftright("doc_id", 16), server, F.col("doc_id") % 65536, F.col("k") * (_PIECE // 8) + more * 8192)
    order = ((F.col("doc_id") * 1000 + F.col("part")) * 1000 + F.col("o")) * 256 + F.col("k") * 2 + F.col("copy")
    return pieces.select(order.alias("ord"), F.col("doc_id").alias("ts_us"), "doc_id", F.lit("RAW").alias("dlt"), F.unhex(hexed).alias("pkt"))


def _defrag(v6):
    def run(spark, sf_dir):
        found = defrag.dissect(fragments(spark, sf_dir, v6)).where("status = 2")
        number = F.floor(F.col("ord") / 256_000)
        return found.select(F.floor(number / 1000).alias("doc_id"), (number % 1000).alias("part"), "dport", F.md5("payload").alias("md5")).distinct()

    return run


QUERIES |= {"ipv4_defrag": _defrag(False), "ipv6_defrag": _defrag(True)}
ORACLE_SQL["ipv4_defrag"] = ORACLE_SQL["ipv6_defrag"] = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, part, substr(h, part * {2 * _DATAGRAM} + 1, {2 * _DATAGRAM}) AS h FROM d, LATERAL (SELECT unnest(generate_series(0, greatest(length(h) - 1, 0) // {2 * _DATAGRAM})) AS part))
SELECT doc_id, part, 5001 AS dport, md5(from_hex(h)) AS md5 FROM p WHERE length(h) > {2 * (_PIECE - 8)}
"""


def segments(spark, sf_dir, mixed: bool = True):
    """A handshake and the segments of every document, some sent twice, with numbers that pass 2^32.

    ``mixed``: in an order that differs by a few places, copies being longer than what they repeat; otherwise in order, each copy behind what it repeats.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body")).where(F.length("body") > 0)
    start = F.lit(4294967296 - 1000) + F.col("doc_id") % 500
    cut = docs.select("doc_id", "body", start.alias("start"), F.explode(F.sequence(F.lit(0), ((F.length("body") - 1) / 300).cast("int"))).alias("k"))
    cut = cut.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).where((F.col("copy") == 0) | (F.col("k") % 3 == 1))
    place = F.col("k") * 4 + (F.abs(F.hash("doc_id", "k", "copy")) % 16 if mixed else F.lit(0))
    data = cut.select(
        "doc_id", (10 + place).alias("o"), (F.col("k") % 8 * 2 + F.col("copy")).alias("tie"), ((F.col("start") + 1 + F.col("k") * 300) % 4294967296).alias("seq"), F.lit(24).alias("flags"), F.lit(0).alias("way"),
        F.substring("body", F.col("k") * 300 + 1, F.when(F.col("copy") == 1, 320 if mixed else 300).otherwise(300)).alias("payload"),
    )
    opening = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(f).alias("flags"), F.lit(w).alias("way")) for i, f, w in ((0, 2, 0), (1, 18, 1), (2, 16, 0))])).alias("s"), start.alias("start"))
    seq = F.when(F.col("s.way") == 1, F.lit(9000)).otherwise((F.col("start") + (F.col("s.o") > 0).cast("int")) % 4294967296)
    opening = opening.select("doc_id", "s.o", F.lit(0).alias("tie"), seq.alias("seq"), "s.flags", "s.way", F.lit(bytearray()).alias("payload"))
    rows = data.unionByName(opening)
    out, client, server = F.col("way") == 0, F.lit(167772161) + F.col("doc_id"), F.lit(3232235777)
    mine = 20000 + F.col("doc_id") % 9000
    return fx.payload_packets(
        rows.select(
            (F.col("doc_id") * 100_000_000 + F.col("o") * 16 + F.col("tie")).alias("ord"), F.col("doc_id").alias("ts_us"), "doc_id",
            F.when(out, client).otherwise(server).alias("src"), F.when(out, server).otherwise(client).alias("dst"), F.when(out, mine).otherwise(F.lit(80)).alias("sport"),
            F.when(out, F.lit(80)).otherwise(mine).alias("dport"), F.lit(6).alias("proto"), "flags", F.lit(8192).alias("win"), "seq", F.when(F.col("flags") == 2, 0).otherwise(F.lit(9001)).alias("ack"), "payload",
        ), F.col("payload"),
    )


def tcp_stream(spark, sf_dir):
    rows = flows.sessionize(headers.dissect(segments(spark, sf_dir)))
    found = tcp.streams(rows).where("dir = 0 AND length(data) > 0")
    parts = F.array_sort(F.collect_list(F.struct("ord", F.hex("data").alias("data"))))  # of one document
    joined = F.unhex(F.array_join(F.transform(parts, lambda x: x["data"]), ""))
    return found.groupBy(F.floor(F.col("flow_id") / 100_000_000).alias("doc_id")).agg(F.md5(joined).alias("md5"))


QUERIES["tcp_stream_concat"] = tcp_stream
ORACLE_SQL["tcp_stream_concat"] = "SELECT doc_id, md5(text) AS md5 FROM documents WHERE length(coalesce(text, '')) > 0"


def tcp_reorder(spark, sf_dir):
    """What became of the segments: every byte is delivered once."""
    rows = flows.sessionize(headers.dissect(segments(spark, sf_dir)))
    found = tcp.streams(rows).where("dir = 0")
    return found.groupBy(F.floor(F.col("flow_id") / 100_000_000).alias("doc_id")).agg(F.sum(F.length("data")).alias("bytes"), F.count("*").alias("segments"))


QUERIES["tcp_reorder"] = tcp_reorder
ORACLE_SQL["tcp_reorder"] = """
SELECT doc_id, size::BIGINT AS bytes, (2 + k + (k + 1) // 3)::BIGINT AS segments FROM (SELECT doc_id, size, (size - 1) // 300 + 1 AS k FROM (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size FROM documents) WHERE size > 0)
"""


def tcp_retransmissions(spark, sf_dir):
    """Segments by what the tracker makes of them, and the retransmissions of flows."""
    rows = flows.sessionize(headers.dissect(segments(spark, sf_dir, mixed=False)))
    found = rows.drop("tcp_status").join(tcp.streams(rows).select("ord", F.col("status").alias("tcp_status")), "ord")
    sums = flows.statistics(found, ["packets", "retransmissions"])
    return sums.select(F.floor(F.col("flow_id") / 100_000_000).alias("doc_id"), "packets_0", "packets_1", "retransmissions_0", "retransmissions_1")


QUERIES["tcp_retransmissions"] = tcp_retransmissions
ORACLE_SQL["tcp_retransmissions"] = """
SELECT doc_id, (2 + k + (k + 1) // 3)::BIGINT AS packets_0, 1 AS packets_1, ((k + 1) // 3)::BIGINT AS retransmissions_0, 0 AS retransmissions_1
FROM (SELECT doc_id, (octet_length(encode(text)) - 1) // 300 + 1 AS k FROM documents WHERE length(coalesce(text, '')) > 0)
"""


def multi_pattern(spark, sf_dir):
    """Whole items of the benchmark that occur in documents as they stand."""
    patterns = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("pattern"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    return search.search(docs, "doc_id", "body", patterns).select("doc_id", "name", F.col("at").alias("first"))


QUERIES["multi_pattern_search"] = multi_pattern
ORACLE_SQL["multi_pattern_search"] = """
SELECT doc_id, item_id::VARCHAR AS name, octet_length(encode(substr(d.text, 1, strpos(d.text, b.text) - 1)))::BIGINT AS first FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0
"""


def http_patterns(spark, sf_dir):
    """Signatures in the bodies of pages, put together from all segments of their flows."""
    found = l7.classify(flows.sessionize(headers.dissect(exchanges(spark, sf_dir))), l7.Config(fields=("HTTP_BODY", "HTTP_HEADERS"), reorder=True))
    known = spark.createDataFrame([(n, bytearray(p.encode())) for n, p in _SIGNATURES], "name string, pattern binary")
    hits = search.search(l7.bodies(found, "text/html"), "ord", "body", known)
    return hits.select(F.floor(F.col("ord") / 1_000_000).alias("page_id"), "name", F.col("at").alias("first"))


_SIGNATURES = [("article", "<article>"), ("end", "</html>"), ("script", "track(1"), ("word", "the "), ("umlaut", "über"), ("none", "<blink>")]
QUERIES["http_pattern_matching"] = http_patterns
ORACLE_SQL["http_pattern_matching"] = f"""
SELECT page_id, name, octet_length(encode(substr(html, 1, strpos(html, pattern) - 1)))::BIGINT AS first FROM pages JOIN (VALUES {", ".join(map(str, _SIGNATURES))}) AS t(name, pattern) ON contains(html, pattern)
"""


def stream_flows(spark, sf_dir):
    """The flow tracker over a file stream of events, run to the end; written as files and read back."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream.createOrReplaceTempView("stream_events")
    rows = spark.sql(fx._SPARK_SQL.replace("FROM {events}", "FROM stream_events")).withColumns({c: F.col(c).cast("int") for c in ("sport", "dport", "proto", "flags")})
    rows = rows.withColumn("size", F.lit(20) + F.when(F.col("proto") == 17, 8).otherwise(20) + F.col("plen"))
    out = f"{shared_folder(spark)}/tracked-{uuid.uuid4().hex}"
    tracked = tracker.track(rows.select("ord", "ts_us", "src", "sport", "dst", "dport", "proto", "flags", "size"))
    tracker.to_files(tracked, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("ord", "seg", "flow_id", "dir")


QUERIES["stream_flow_stats"] = stream_flows
from netlens.plans.q_flows import ORACLE_SQL as _FLOWS  # noqa: E402

ORACLE_SQL["stream_flow_stats"] = _FLOWS["flow_sessionize"]
