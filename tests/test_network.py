"""Dissection, flows and reassembly on hand-made packets."""

import itertools
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netlens import catalog
from netlens.functions import names, quicinitial
from netlens.operators import defrag, dissectors, fieldwork, flows, headers, l7, tags, tcp
from netlens.plans import q_l7
from netlens.sources import pcap
from netlens.streaming import tracker


def ip(payload, proto=6, src=b"\x0a\0\0\1", dst=b"\x0a\0\0\2", ident=1, frag=0):
    return b"\x45\0" + struct.pack(">HHHBBH", 20 + len(payload), ident, frag, 64, proto, 0) + src + dst + payload


def seg(data=b"", sport=1000, dport=80, seq=1, ack=1, flags=24):
    return struct.pack(">HHIIBBHHH", sport, dport, seq % 2**32, ack, 0x50, flags, 512, 0, 0) + data


def one(packet, dlt="RAW"):
    found = headers.parse(pa.array([packet], pa.binary()), [dlt])
    return {k: v[0].as_py() for k, v in found.items()}


def test_empty_and_null_packets():
    assert one(b"")["status"] == 0 and one(None)["status"] == 0 and one(b"")["proto"] is None
    assert headers.parse(pa.array([], pa.binary()), [])["status"].to_pylist() == []


def test_truncation_at_every_byte_is_an_error_or_a_shorter_payload():
    whole = ip(seg(b"hello"))
    for n in range(1, len(whole)):
        assert one(whole[:n])["status"] < 0
    assert one(whole)["payload"] == b"hello" and one(whole + b"pad")["payload"] == b"hello"


def test_options_and_window_scale():
    header = struct.pack(">HHIIBBHHH", 5, 6, 1, 0, 0x70, 2, 9, 0, 0) + b"\x01\x03\x03\x07\x02\x04\x05\xb4"
    r = one(ip(header))
    assert (r["tcp_window_scale"], r["l4_length"], r["payload_length"]) == (7, 28, 0)


def test_random_bytes_never_raise():
    r = random.Random(1)
    rows = [r.randbytes(r.randrange(120)) for _ in range(3000)] + [bytes([0x45]) + r.randbytes(60) for _ in range(500)] + [bytes([0x60]) + r.randbytes(90) for _ in range(500)]
    for dlt in [*catalog.L2, None, "nothing"]:
        found = headers.parse(pa.array(rows, pa.binary()), [dlt] * len(rows))
        assert all(len(v) == len(rows) for v in found.values())


def test_fragments_in_any_order_and_overlapping():
    data = bytes(range(64)) * 3
    cuts = [(0, 64), (64, 128), (128, 192), (32, 96)]
    for order in itertools.permutations(cuts):
        d = defrag.Datagram()
        found = [x for a, b in order if (x := d.add(a, b < 192, data[a:b]))]
        assert found and found[0] == data
    d = defrag.Datagram()
    assert d.add(0, False, b"ab") == b"ab"
    assert defrag.Datagram().add(65530, True, b"x" * 10) is None


def test_earlier_fragment_bytes_win():
    d = defrag.Datagram()
    d.add(0, True, b"AAAAAAAA")
    assert d.add(4, False, b"BBBBBBBB") == b"AAAAAAAABBBB"


def test_segments_in_any_order_across_the_wrap():
    data = random.Random(4).randbytes(900)
    start = 2**32 - 300
    parts = [(i, data[i : i + 130]) for i in range(0, 900, 100)]
    for k in range(30):
        order = parts + random.Random(k).sample(parts, 3)
        random.Random(k).shuffle(order)
        t = tcp.Tracker()
        assert t.take(0, start - 1, 0, 2, b"")[0] == "in_order" and t.take(1, 9, start, 18, b"")[0] == "in_order" and t.take(0, start, 10, 16, b"")[0] == "in_order"
        assert b"".join(t.take(0, (start + i) % 2**32, 10, 24, d)[1] for i, d in order) == data


def test_retransmission_and_horizon():
    t = tcp.Tracker()
    for way, seq, ack, flags in ((0, 0, 0, 2), (1, 0, 1, 18), (0, 1, 1, 16)):
        t.take(way, seq, ack, flags, b"")
    assert t.take(0, 1, 1, 24, b"abc") == ("in_order", b"abc") and t.take(0, 1, 1, 24, b"abc") == ("retransmission", b"")
    assert t.take(0, 4 + tcp.HORIZON + 1, 1, 24, b"x")[0] == "out_of_order" and not t.kept[0]
    t.take(0, 4, 1, 17, b"")
    t.take(1, 1, 5, 17, b"")
    assert t.terminated


def test_a_stream_begun_in_the_middle_waits_for_both_sides():
    t = tcp.Tracker()
    assert t.take(0, 100, 500, 24, b"ab")[0] == "out_of_order" and t.take(1, 500, 102, 24, b"cd")[0] == "out_of_order"
    assert t.take(0, 102, 502, 16, b"")[0] == "out_of_order" and t.established
    assert t.take(0, 102, 502, 24, b"ef") == ("in_order", b"ef")


@pytest.mark.parametrize("name", list(q_l7.CONVERSATIONS))
def test_dissectors_and_noise(name):
    proto, client, port, packets = q_l7.CONVERSATIONS[name]
    states, outcomes = {}, []
    for k, (way, b) in enumerate(packets):
        c = client or 23456
        p = dissectors.Packet(b, proto, c if way == 0 else port, port if way == 0 else c, b"\n\0\0\1", bytes([224, 0, 0, 251]), way, False, k + 1)
        if name in ("ETHEREUM", "ZCASH", "MONERO", "STRATUM"):
            fieldwork.prepare("HTTP", p, {})
            fieldwork.prepare("JSON_RPC", p, {})
        outcomes.append(dissectors.REGISTRY[name](p, states))
    assert outcomes[-1] == dissectors.MATCH
    noise = dissectors.Packet(b"\x99\x98\x97~~~~", 6 if dissectors.TRANSPORT[name] != "udp" else 17, 1, 2, seen_syn=True, l7_packets=9)
    assert dissectors.REGISTRY[name](noise, {}) != dissectors.MATCH
    for n in range(40):
        dissectors.REGISTRY[name](dissectors.Packet(random.Random(n).randbytes(n), 6, 53, port, l7_packets=1), {})


def test_every_protocol_has_a_dissector():
    assert set(dissectors.REGISTRY) == {n for n, *_ in catalog.L7} and len(catalog.L7) == 37 and len(catalog.fields()) == 88 - 4 + 3


def test_own_dissectors_can_be_added():
    @dissectors.register("ECHO7", "udp")
    def echo(p, s):
        return dissectors.MATCH if p.payload == b"echo" else dissectors.NO

    flow = l7.Flow(l7.Config(protocols=("ECHO7",)).tops())
    l7.identify(flow, dissectors.Packet(b"echo", 17, 1, 2), l7.Config())
    assert flow.stack == ["ECHO7"]
    dissectors.ORDER.remove("ECHO7")
    del dissectors.REGISTRY["ECHO7"]


def test_http_in_pieces():
    work, whole = {}, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nX: 1\r\nX: 2\r\n\r\n3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n"
    found = [m for i in range(0, len(whole), 7) if (m := fieldwork.http_message(whole[i : i + 7], 0, work))]
    assert len(found) == 1 and found[0]["BODY"] == b"abcde" and found[0]["HEADERS"][1:] == [("X", "1"), ("X", "2")]
    assert dissectors.http_prefix(b"P") and not dissectors.http_prefix(b"PX") and not dissectors.http_prefix(b"GET / HTTP/1.1\r\nbad header\r\n")


def test_dns_names_follow_pointers_but_not_for_ever():
    assert fieldwork.dns_name(b"\x01a\xc0\x00", 0)[0].startswith("a.a")
    assert fieldwork.dns_name(b"\x01a\x01b\0x", 0) == ("a.b", 5)


def test_quic_initial_keys_and_hello():
    key, iv, hp = quicinitial.client_keys(1, bytes.fromhex("8394c8f03e515708"))
    assert (key.hex(), iv.hex(), hp.hex()) == ("1f369613dd76d5467730efcbe3b1a22d", "fa044b2f42a3fd3b46fb255c", "9f50449e04a0e810283a1e9933adedd2")
    packet = q_l7.quic_initial(b"name.example")
    assert quicinitial.fields(packet)["SNI"] == "name.example"
    assert "SNI" not in quicinitial.fields(packet[:600] + b"\xff" + packet[601:])


def test_capture_files(spark, tmp_path):
    packets = [(1_700_000_000_000_001, b"abc"), (1_700_000_000_000_002, b""), (5, b"x" * 70)]
    data = pcap.build(packets)
    (tmp_path / "a.pcap").write_bytes(data)
    big = struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 9, 101) + struct.pack(">IIII", 7, 8000, 2, 2) + b"hi" + b"\0\0"
    (tmp_path / "b.pcap").write_bytes(big)
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    ng = b"\x0a\x0d\x0d\x0a" + struct.pack("<IIHHq", 28, 0x1A2B3C4D, 1, 0, -1) + struct.pack("<I", 28)
    ng += block(1, struct.pack("<HHI", 113, 0, 0)) + block(6, struct.pack("<IIIII", 0, 0, 99, 3, 3) + b"xyz\0")
    (tmp_path / "c.pcapng").write_bytes(ng)
    assert list(pcap.parse(data)) == [(ts, "EN10MB", len(b), b) for ts, b in packets]
    rows = pcap.read(spark, str(tmp_path)).collect()
    assert sorted((r.ts_us, r.dlt, bytes(r.pkt)) for r in rows) == sorted([(ts, "EN10MB", b) for ts, b in packets] + [(7_000_008, "RAW", b"hi"), (99, "LINUX_SSL", b"xyz")])
    pcap.register(spark)
    again = spark.read.format("pcap").load(str(tmp_path)).collect()
    assert len(again) == 5 and len({r.ord for r in again}) == 5
    query = spark.readStream.format("pcap").load(str(tmp_path)).writeStream.format("memory").queryName("captured").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("captured").count() == 5


def test_flows_run_on_over_files_in_any_order_of_writing(spark, tmp_path):
    """Two flows that begin with the same number within their file, one of them going on in the next file."""
    udp = lambda data, src, port: ip(struct.pack(">HHHH", 4000, port, 8 + len(data), 0) + data, 17, src=src)
    stun = bytes.fromhex("000100002112a442") + b"transaction1"
    ntp = b"\x23".ljust(48, b"\0")
    a, b = b"\x0a\0\0\x07", b"\x0a\0\0\x08"
    files = {"b.pcap": [(2_000_000, udp(ntp, b, 123)), (2_000_001, udp(b"\xff" * 9, a, 3478))], "a.pcap": [(1_000_000, udp(stun, a, 3478)), (1_500_000, udp(stun, a, 3478))]}
    for name, rows in files.items():  # the first by name is written last
        (tmp_path / name).write_bytes(pcap.build(rows, 101))
    pcap.register(spark)
    for packets in (pcap.read(spark, str(tmp_path)), spark.read.format("pcap").load(str(tmp_path))):
        rows = flows.sessionize(defrag.dissect(packets).where("status in (0, 2)"))
        found = l7.classify(rows.repartition(3, "sport")).orderBy("ord").collect()
        assert [(bytes(r.src), r.protocols[0]) for r in found] == [(a, "STUN"), (a, "STUN"), (b, "NTP"), (a, "STUN")]
        assert len({r.ord for r in found}) == 4 and len({r.flow_id for r in found}) == 2 and {r.file.split("/")[-1] for r in found} == set(files)


def test_a_capture_stream_takes_every_file_once(spark, tmp_path):
    """Files that come later sort before, and are moved in with an old date."""
    import os

    folder, away = tmp_path / "in", tmp_path / "away"
    folder.mkdir()
    away.mkdir()
    pcap.register(spark)

    def put(name, ts):
        (away / name).write_bytes(pcap.build([(ts, b"x" * ts)]))
        os.utime(away / name, (1, 1))
        os.rename(away / name, folder / name)

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for name, ts in (("m.pcap", 5), ("a.pcap", 6), ("k.pcap", 7)):
        put(name, ts)
        tracker.to_files(spark.readStream.format("pcap").load(str(folder)), out, state).awaitTermination()
        rows = spark.read.parquet(out).collect()
        assert len(rows) == len({r.ord for r in rows}) == ts - 4
    assert sorted(r.ts_us for r in spark.read.parquet(out).collect()) == [5, 6, 7]
    (folder / "m.pcap").unlink()
    put("z.pcap", 8)
    with pytest.raises(Exception, match="removed or changed"):
        tracker.to_files(spark.readStream.format("pcap").load(str(folder)), out, state).awaitTermination()


def test_captures_are_written_and_read_back(spark, tmp_path):
    pcap.register(spark)
    rows = spark.createDataFrame([(i, i * 1000, bytes([i % 256]) * (i % 70)) for i in range(500)], "n long, ts_us long, pkt binary")
    for _ in range(2):
        rows.repartitionByRange(3, "n").sortWithinPartitions("n").write.format("pcap").mode("overwrite").save(str(tmp_path / "w"))
    found = pcap.read(spark, str(tmp_path / "w")).orderBy("ord").collect()
    assert [(r.ts_us, bytes(r.pkt)) for r in found] == [(i * 1000, bytes([i % 256]) * (i % 70)) for i in range(500)] and len({r.file for r in found}) == 3


def flow_rows(spark, rows):
    return spark.createDataFrame(rows, "ord long, ts_us long, src binary, sport int, dst binary, dport int, proto int, tcp_flags int, payload_length int")


def sequential(rows, idle=30_000_000):
    """The flow rules, one packet at a time."""
    state, out = {}, {}
    for o, ts, src, sport, dst, dport, proto, flags, _ in rows:
        key = (proto, *sorted([(src, sport), (dst, dport)]))
        s = state.get(key)
        syn = proto == 6 and flags & 2
        if s is None or ts - s["last"] > idle or (syn and s["rst"]):
            s = state[key] = {"seg": (s["seg"] + 1 if s else 0), "id": o, "first": (src, sport), "rst": False}
        elif syn:
            s["rst"] = False
        s["rst"] |= bool(proto == 6 and flags & 4)
        s["last"] = ts
        out[o] = (s["seg"], s["id"], int((src, sport) != s["first"]))
    return out


def test_sessions_follow_the_sequential_rule(spark):
    r = random.Random(9)
    ends = [(bytes([10, 0, 0, i]), 1000 + i) for i in range(3)]
    rows, ts = [], 0
    for o in range(800):
        a, b = r.sample(ends, 2)
        ts += r.choice([1, 1000, 9_000_000, 31_000_000]) if r.random() < 0.3 else 5
        rows.append((o, ts, *a, *b, r.choice([6, 6, 17]), r.choice([2, 4, 16, 24, 24, 18]), 5))
    got = {x.ord: (x.seg, x.flow_id, x.dir) for x in flows.sessionize(flow_rows(spark, rows)).collect()}
    assert got == sequential(rows)


def test_fins_close_a_flow(spark):
    a, b = (b"\1\1\1\1", 1), (b"\2\2\2\2", 2)
    flags = [(a, 2), (a, 17), (b, 17), (a, 16), (b, 17), (a, 17), (a, 16), (a, 17), (a, 17), (b, 16)]
    rows = [(i, i, *x, *(b if x == a else a), 6, f, 0) for i, (x, f) in enumerate(flags)]
    closed = flows.sessionize(flow_rows(spark, rows), fin_closes=True).orderBy("ord").collect()
    assert [x.seg for x in closed] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2] and [x.flow_id for x in closed] == [0, 0, 0, 3, 3, 3, 6, 6, 6, 6]
    assert {x.seg for x in flows.sessionize(flow_rows(spark, rows)).collect()} == {0}
    late = [(*r[:1], r[1] + 40_000_000 * (i > 1), *r[2:]) for i, r in enumerate(rows)]  # a pause between the two sides
    assert [x.seg for x in flows.sessionize(flow_rows(spark, late), fin_closes=True).orderBy("ord").collect()] == [0, 0, 1, 1, 1, 1, 2, 2, 2, 2]


def test_caps(spark):
    rows = [(i, i * 1000, bytes([1, 1, 1, i % 4]), 1, b"\2\2\2\2", 2, 17, 0, 1) for i in range(8)]
    keyed = flow_rows(spark, rows).withColumn("flow_key", flows.flow_key())
    skip = {x.ord: x.admitted for x in flows.cap(keyed, 2, "skip", slices=1).collect()}
    assert skip == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False}
    evict = {x.ord: x.evicted for x in flows.cap(keyed, 2, "evict", slices=1).collect()}
    assert evict == {0: None, 1: None, 2: 0, 3: 1, 4: 2, 5: 3, 6: 4, 7: 5}
    sliced = flows.cap(keyed, 4, "skip", slices=4)  # a place for each slice
    assert sliced.where("admitted").count() >= 2 and sliced.count() == 8
    assert {x.status for x in flows.refused(keyed.withColumn("status", F.lit(0)), 2, slices=1).collect()} == {0, -4}


def test_directions_are_symmetric(spark):
    rows = spark.createDataFrame([(3232235777, 80, 167772161, 40000, 6), (167772161, 40000, 3232235777, 80, 6)], "src long, sport long, dst long, dport long, proto long")
    args = [F.col(c) for c in ("src", "sport", "dst", "dport", "proto")]
    for f in (names.flow_hash_simple, names.flow_hash_fnv, names.flow_hash_bkdr, names.flow_hash_murmur3):
        assert len({x[0] for x in rows.select(f(*args)).collect()}) == 1


def test_tag_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.json").write_text('{"rules": [{"value": "abc", "matchingType": "PREFIX", "tag": "p"}, {"value": "ABCD", "matchingType": "PREFIX", "tag": "longer"}, {"value": "xyz", "matchingType": "SUFFIX", "tag": "s"}, {"value": "abcd", "matchingType": "PREFIX", "tag": "last"}, {"value": "q", "matchingType": "EXACT", "tag": "e"}]}')
    values = spark.createDataFrame([(1, "AbCdE"), (2, "abx"), (3, "abcxyz"), (4, "Q"), (5, None), (6, "wxyz"), (7, "")], "id int, v string")
    got = {r.id: r.tag for r in tags.lookup(values, tags.load(spark, str(tmp_path / "rules.json")), "v", ["id"]).collect()}
    assert got == {1: "last", 3: "p", 4: "e", 6: "s"}


def test_column_pruning_reaches_the_scan(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id = 3").select("event_id")
    plan = rows._jdf.queryExecution().explainString(rows._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(user_id,3)" in plan and "props" not in plan


def test_a_stream_in_many_batches(spark, tmp_path):
    r = random.Random(2)
    rows = [(o, o * 1000, r.choice([1, 2]), 10, 3, 20, 6, r.choice([2, 4, 24]), 60) for o in range(60)]
    schema = "ord long, ts_us long, src long, sport int, dst long, dport int, proto int, flags int, size long"
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = tracker.track(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("followed").start()
    query.processAllAvailable()
    query.stop()
    got = {x.ord: (x.seg, x.flow_id, x.dir) for x in spark.table("followed").collect()}
    want = sequential([(o, ts, s, sp, d, dp, p, f, z) for o, ts, s, sp, d, dp, p, f, z in rows])
    assert got == want


def test_state_of_idle_flows_goes(spark, tmp_path):
    schema = "ord long, ts_us long, src string, sport int, dst string, dport int, proto int, flags int, size long"
    second = 1_000_000
    batches = [[(i, i, f"a{i}", 1, "b", 2, 17, 0, 10) for i in range(20)], [(30, 100 * second, "c", 1, "d", 2, 17, 0, 10)], [(40, 200 * second, "e", 1, "f", 2, 17, 0, 10)], [(50, 201 * second, "e", 1, "f", 2, 17, 0, 10)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = tracker.flow_records(stream).writeStream.format("memory").queryName("ended").start()
    query.processAllAvailable()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    assert max(held) >= 20 and held[-1] <= 2
    got = {(r.src, r.packets_0, r.reason) for r in spark.table("ended").collect()}
    assert {(f"a{i}", 1, "expired") for i in range(20)} <= got


def test_http_messages_of_any_length_in_pieces():
    body = bytes(i * 7 % 251 for i in range(3 << 20))
    work, found = {}, []
    sized = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"".join(b"%x\r\n" % len(c) + c + b"\r\n" for c in (body[i : i + 50_000] for i in range(0, len(body), 50_000))) + b"0\r\n\r\n"
    stream = sized + chunked + b"HTTP/1.1 204 No\r\nX: 1\r\n\r\n"
    for at in range(0, len(stream), 1460):
        found.append(fieldwork.http_message(stream[at : at + 1460], 1, work))
    found = [m for m in found if m]
    assert [m["STATUS_CODE"] for m in found] == [200, 200] and all(m["BODY"] == body for m in found)
    assert fieldwork.http_message(b"", 1, work)["STATUS_CODE"] == 204


def test_tls_records_longer_than_a_segment():
    hello = q_l7.client_hello()
    record = b"\x16\x03\x01" + len(hello).to_bytes(2, "big") + hello
    rest = b"".join(b"\x16\x03\x03" + (16000).to_bytes(2, "big") + b"\x0b" + (15996).to_bytes(3, "big") + bytes(15996) for _ in range(20))
    state, outcomes = {}, []
    for at in range(0, len(record + rest), 1460):
        p = dissectors.Packet((record + rest)[at : at + 1460], 6, 50000, 443)
        outcomes.append(dissectors.REGISTRY["SSL"](p, state))
        if outcomes[-1] != dissectors.MORE:
            break
    assert outcomes[-1] == dissectors.MATCH and dissectors.NO not in outcomes


def _pieces(source, ident, count, size=8, base=0):
    return [ip(bytes([ident]) * size, 17, src=source, ident=ident, frag=(k * size // 8) | (0x2000 if k < count - 1 else 0)) for k in range(count)]


def test_datagrams_expire_after_their_first_fragment(spark):
    a, (x, y, z) = b"\x0a\0\0\1", _pieces(b"\x0a\0\0\1", 7, 3)
    times = {"kept": (0, 20_000_000, 29_000_000), "lost": (0, 20_000_000, 31_000_000)}  # each pause is short
    for name, ts in times.items():
        rows = spark.createDataFrame([(i, t, "RAW", bytearray(b)) for i, (t, b) in enumerate(zip(ts, (x, y, z), strict=True))], "ord long, ts_us long, dlt string, pkt binary")
        assert defrag.dissect(rows).where("is_fragment = false").count() == (name == "kept"), (a, name)


def test_sources_that_hold_too_much_lose_their_oldest_datagrams(spark):
    a, b = b"\x0a\0\0\1", b"\x0a\0\0\2"
    first, second, other = _pieces(a, 1, 2, 800), _pieces(a, 2, 2, 800), _pieces(b, 3, 2, 800)
    order = [first[0], second[0], other[0], other[1], second[1], first[1]]
    rows = spark.createDataFrame([(i, i, "RAW", bytearray(p)) for i, p in enumerate(order)], "ord long, ts_us long, dlt string, pkt binary")

    def whole(**limits):
        found = defrag.reassemble(headers.dissect(rows), defrag.Options(**limits)).collect()
        return {bytes(r.pkt)[-1] for r in found}

    assert whole() == whole(per_source_bytes=1600) == whole(total_bytes=1 << 20) == {1, 2, 3}
    assert whole(per_source_bytes=1500) == {2, 3}  # the first of two is dropped when the source's next fragment comes
    assert whole(per_source_bytes=100) == set()  # what is left of a source with nothing but too much is the fragment, which goes too
    assert whole(total_bytes=1500, slices=1) == {3}
