"""What the findings of round 3 came down to, each on a small case."""

import os
import random
import time
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from netlens.functions import quicinitial
from netlens.operators import dissectors, flows, headers, l7
from netlens.plans import fixtures, q_capture, q_l7
from netlens.streaming import tracker


@pytest.mark.parametrize("library", [True, False])
def test_quic_packets_open_fast_and_right(monkeypatch, library):
    if not library:
        monkeypatch.setattr(quicinitial, "_openssl", lambda: None)
    # FIPS 197 C.1; test case 4 of the GCM specification
    assert quicinitial.aes128(bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff") * 2).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a" * 2
    key, nonce, aad = bytes.fromhex("feffe9928665731c6d6a8f9467308308"), bytes.fromhex("cafebabefacedbaddecaf888"), bytes.fromhex("feedfacedeadbeeffeedfacedeadbeefabaddad2")
    text = bytes.fromhex("d9313225f88406e5a55909c5aff5269a86a7a9531534f7da2e4c303d8a318a721c3c0c95956809532fcf0e2449a6b525b16aedf5aa0de657ba637b39")
    sealed = quicinitial.gcm(key, nonce, aad, text, True)
    assert sealed[-16:].hex() == "5bc94fbc3221a5db94fae95ae7121a47" and quicinitial.gcm(key, nonce, aad, sealed) == text
    for bad in (sealed[:-1] + b"\0", b"\0" + sealed[1:], sealed[:20], b"", sealed[:15]):
        assert quicinitial.gcm(key, nonce, aad, bad) is None
    assert quicinitial.gcm(key, nonce, aad + b"x", sealed) is None and quicinitial.gcm(key, nonce, aad, sealed) == text
    packets = [q_l7.quic_initial(f"h{i}.example".encode()) for i in range(40)]
    began = time.thread_time()
    assert [quicinitial.fields(p)["SNI"] for p in packets] == [f"h{i}.example" for i in range(40)]
    assert time.thread_time() - began < 0.2  # 10.9 ms a packet before


def test_both_ways_of_aes_gcm_agree():
    r = random.Random(3)
    for _ in range(50):
        key, nonce, aad, text = r.randbytes(16), r.randbytes(12), r.randbytes(r.randrange(40)), r.randbytes(r.randrange(300))
        sealed = quicinitial.gcm(key, nonce, aad, text, True)
        assert sealed == quicinitial.plain_gcm(key, nonce, aad, text, True) and quicinitial.plain_gcm(key, nonce, aad, sealed) == text


def test_a_request_is_no_mqtt_whatever_the_port_of_its_client():
    stack = lambda b, sport=28080: (f := l7.Flow(l7.Config().tops()), l7.identify(f, dissectors.Packet(b, 6, sport, 80), l7.Config()))[0].stack
    for method in ("GET", "PUT", "POST", "HEAD", "PATCH", "DELETE", "OPTIONS", "M-SEARCH"):
        for size in range(40, 128):
            head = f"{method} / HTTP/1.1\r\nHost: a\r\nX: ".encode()
            assert stack(head.ljust(size - 4, b"x") + b"\r\n\r\n") == ["HTTP"]
    good = ["30050001612121", "320700016100017879", "40020001", "4003000110", "50020001", "62020001", "7003000192", "c000", "d000", "820600010001610 0".replace(" ", "")]
    assert all(stack(bytes.fromhex(x), 20000) == ["MQTT"] for x in good)
    assert not any(stack(bytes.fromhex(x), 20000) == ["MQTT"] for x in ("30050009612121", "360700016100017879", "42020001", "4003000111", "60020001", "400100"))


def test_one_trial_leaves_nothing_to_guess_from(spark, tmp_path):
    kind, kinds = q_l7._IDS["WHATSAPP"], q_l7._KINDS
    ids = [n for n in range(kind, 200_000, kinds) if n % 9000 in (8080, 8081) or n < 200]
    assert any(n > 200 for n in ids)
    pq.write_table(pa.table({"event_id": ids}), f"{tmp_path}/events.parquet")
    found = {(r.event_id, r.trials): r.stack for r in q_l7.max_trials(spark, str(tmp_path)).collect()}
    assert found == {(n, t): s for n in ids for t, s in ((0, "WhatsApp"), (1, "Unknown"))}


def test_a_large_batch_is_dissected_in_blocks():
    fields = [SimpleNamespace(name=n, dataType=SimpleNamespace(simpleString=lambda: "x")) for n in ("ord", "dlt", "pkt")]
    frame = SimpleNamespace(columns=["ord", "dlt", "pkt"], schema=SimpleNamespace(fields=fields), mapInArrow=lambda run, schema: run)
    body = bytes(60_000)
    packet = b"\x45\0" + (28 + len(body)).to_bytes(2, "big") + bytes(4) + b"\x40\x11\0\0" + bytes([10, 0, 0, 1, 10, 0, 0, 2]) + b"\x13\x88\x13\x89" + (8 + len(body)).to_bytes(2, "big") + b"\0\0" + body
    batch = pa.record_batch({"ord": list(range(400)), "dlt": ["RAW"] * 400, "pkt": pa.array([packet] * 400, pa.binary())})  # 24 MB
    tracemalloc.start()
    found = [(b.column("ord").to_pylist(), b.column("payload_length").to_pylist()) for b in headers.dissect(frame)(iter([batch]))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [o for os, _ in found for o in os] == list(range(400)) and {n for _, ns in found for n in ns} == {60_000}
    assert most < 100e6  # 600 MB before


def test_blocks_keep_every_row():
    r = random.Random(4)
    for _ in range(50):
        values = [None if r.random() < 0.2 else r.randbytes(r.randrange(40)) for _ in range(r.randrange(30))]
        batch = pa.record_batch({"n": np.arange(len(values)), "b": pa.array(values, pa.binary())}).slice(r.randrange(3))
        parts = list(headers.blocks(batch, "b", 50))
        assert [x for p in parts for x in p.column("n").to_pylist()] == batch.column("n").to_pylist()
        assert all(p.num_rows == 1 or sum(len(x or b"") for x in p.column("b").to_pylist()) <= 50 for p in parts)


def test_flows_are_dealt_to_as_many_tasks_as_their_input_needs(spark, sf_dir, monkeypatch):
    packets = headers.dissect(fixtures.packets(spark, sf_dir))
    alone = flows.sessionize(packets)
    monkeypatch.setattr(flows, "TASK_BYTES", 1000)
    many = flows.parts_for(packets)
    assert many == -(-26708 // 1000)  # the file of events
    found = l7.classify(flows.sessionize(packets), l7.Config(reorder=False))
    assert found.rdd.getNumPartitions() == many  # what lies in between keeps the parts
    columns = ("ord", "seg", "flow_id", "dir")
    assert sorted(found.select(*columns).collect()) == sorted(alone.select(*columns).collect())
    assert flows.sessionize(packets, parts=7).rdd.getNumPartitions() == 7


def test_larger_tables_make_more_capture_files(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(flows, "TASK_BYTES", 3000)
    folder, parts = q_capture.captured(spark, sf_dir)
    assert parts == 9 == sum(not n.startswith((".", "_")) for n in os.listdir(folder))
    found = q_capture.capture_source(spark, sf_dir).agg({"packets": "sum", "flows": "max", "event_id": "count"}).collect()[0]
    assert (found["max(flows)"], found["count(event_id)"]) == (1, 1000)


def ended_one_by_one(flow, rst, rows, idle_us):
    """``tracker._ended``, packet by packet."""
    out = []
    for r in rows.itertuples(index=False):
        syn = r.proto == 6 and bool(r.flags & flows.SYN)
        idle = bool(flow) and r.ts_us - flow[11] > idle_us
        if not flow or idle or (syn and rst):
            if flow:
                out.append((*flow, "idle" if idle else "reopened"))
            flow, rst = [r.ord, r.src, r.sport, r.dst, r.dport, r.proto, 0, 0, 0, 0, r.ts_us, r.ts_us], False
        way = 0 if (r.src, r.sport) == (flow[1], flow[2]) else 1
        flow[6 + way] += 1
        flow[8 + way] += r.size
        flow[11] = r.ts_us
        rst = (rst and not syn) or bool(r.proto == 6 and r.flags & flows.RST)
    return out, flow, rst


def test_records_of_a_batch_equal_those_packet_by_packet():
    r = random.Random(5)
    for _ in range(300):
        proto, fast, slow, ts, o = r.choice([6, 6, 17]), ([], False), ([], False), 0, 0
        for _ in range(r.randrange(1, 4)):  # batches of a key
            packets = []
            for _ in range(r.randrange(1, 30)):
                ts, o = ts + r.choice([0, 1, 5, 10, 11, 40]), o + r.randrange(1, 3)
                ends = r.choice([("a", 1, "b", 2), ("b", 2, "a", 1)])
                packets.append((o, ts, *ends, proto, r.choice([0, 2, 4, 6, 16, 24]), r.randrange(100)))
            rows = pd.DataFrame(packets, columns=["ord", "ts_us", "src", "sport", "dst", "dport", "proto", "flags", "size"])
            out, *fast = tracker._ended(*fast, rows, 10)
            want, *slow = ended_one_by_one(*slow, rows, 10)
            assert (out, fast) == (want, slow)


def test_records_of_many_packets_are_fast():
    n = 100_000
    rows = pd.DataFrame({"ord": range(n), "ts_us": range(n), "src": ["a", "b"] * (n // 2), "sport": 1, "dst": ["b", "a"] * (n // 2), "dport": 1, "proto": 6, "flags": 16, "size": 7})
    began = time.thread_time()
    out, flow, _ = tracker._ended([], False, rows, 10)
    assert time.thread_time() - began < 0.06 and not out and flow[6:10] == [n // 2, n // 2, 350_000, 350_000]


def test_closing_by_fin_equals_packet_by_packet_and_leaves_the_jvm_no_more(spark):
    r, rows, want, o = random.Random(6), [], {}, 0
    for key in range(60):
        ts, seg, cuts, fins, last = 0, 0, 0, 0, None
        for _ in range(r.randrange(1, 40)):
            gap = r.random() < 0.1
            ts, o = ts + (31_000_000 if gap else 10), o + 1
            way, fin = r.randrange(2), r.random() < 0.6
            seg += gap and last is not None
            if fins == 3:
                cuts, fins = cuts + (seg == last), 0
            if seg != last:
                fins, last = 0, seg
            fins |= (1 + way) * fin
            want[o] = seg + cuts
            ends = [(bytes([10, 0, 0, key]), 4000), (bytes([10, 0, 1, 1]), 80)]
            rows.append((o, ts, *ends[way], *ends[1 - way], 6, 17 if fin else 16, b"x"))
    packets = spark.createDataFrame(rows, "ord long, ts_us long, src binary, sport int, dst binary, dport int, proto int, tcp_flags int, payload binary")
    found = flows.sessionize(packets, fin_closes=True)
    assert {x.ord: x.seg for x in found.collect()} == want
    assert "MapInArrow" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("slices", [1, 3])
def test_a_full_table_equals_packet_by_packet(spark, slices):
    r, rows, ts = random.Random(7), [], 0
    for o in range(3000):
        ts += r.choice([1, 1, 50, 400])
        rows.append((o * 3, ts, r.randrange(12)))
    packets = spark.createDataFrame(r.sample(rows, len(rows)), "ord long, ts_us long, flow_key int").repartition(4)
    of = {x.flow_key: (x.k, x.s) for x in packets.selectExpr("flow_key", "xxhash64(flow_key) k", f"pmod(xxhash64(flow_key), {slices}) s").distinct().collect()}
    for strategy in ("skip", "evict"):
        want, tables = {}, {s: {} for s in range(slices)}
        for o, t, key in rows:
            live, gone = tables[of[key][1]], None
            for k in [k for k, (last, _) in live.items() if t - last > 1000]:
                del live[k]
            if key not in live and len(live) >= -(-6 // slices):
                if strategy == "skip":
                    want[o] = (False, None)
                    continue
                gone = live.pop(min(live, key=lambda k: live[k][0]))[1]
            live[key] = (t, live[key][1] if key in live else o)
            want[o] = (True, gone)
        found = flows.cap(packets, 6, strategy, idle_us=1000, slices=slices)
        assert {x.ord: (x.admitted, x.evicted) for x in found.collect()} == want


def test_packets_come_packed_to_the_task_of_a_table():
    r, n = np.random.default_rng(1), 10_000
    ords, times, slices = np.arange(n) * 3, np.cumsum(r.integers(0, 200_000, n)), r.integers(0, 2, n).astype(np.int32)
    keys = r.integers(-(2**63), 2**63 - 1, n)
    batch = pa.record_batch([pa.array(ords), pa.array(times), pa.array(keys), pa.array(slices)], ["ord", "ts_us", "key", "slice"])
    (packed,) = flows._pack(iter([batch]))
    assert packed.num_rows == 2 and packed.nbytes < 13 * n  # keys are random; a sorted row took 64 bytes and more
    back = list(flows._unpacked(packed.append_column(flows.PLACE, pa.array([1, 1]))))
    for one, (o, t, k, _) in zip((0, 1), back, strict=True):
        own = slices == one
        assert (o == ords[own]).all() and (t == times[own]).all() and (k == keys[own]).all()
    with pytest.raises(ValueError):
        list(flows._pack(iter([pa.record_batch([pa.array([1]), pa.array([None], pa.int64()), pa.array([1]), pa.array([0], pa.int32())], ["ord", "ts_us", "key", "slice"])])))
