"""Scalars, codecs, state machine, range functions and rules on small cases, and random traces against plain rules."""

import random
import struct
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from flowloom.functions import scalars as S
from flowloom.operators import anomalies, flows, metrics
from flowloom.plans import rules
from flowloom.plans import vectors as V
from flowloom.schemas import TCP
from flowloom.sources import codecs, events

T = dict.fromkeys(TCP.fieldNames(), 0)


def tcp(spark, *rows):
    base = T | {"comm": "app", "saddr": 1, "daddr": 2, "sport": 10, "dport": 80, "protocol": 6, "direction": 1, "tcp_state": 7}
    return spark.createDataFrame([tuple((base | {"seq": i} | r)[c] for c in TCP.fieldNames()) for i, r in enumerate(rows)], TCP)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "column,want",
    [
        (lambda: S.uint32_to_ip(F.lit(0x0100A8C0)), "192.168.0.1"),
        (lambda: S.ip_to_uint32(F.lit("192.168.0.1")), 0x0100A8C0),
        (lambda: S.ip_to_uint32(F.lit("::ffff:10.0.0.1")), 0x0100000A),
        (lambda: S.ip_to_uint32(F.lit("300.1.1.1")), None),
        (lambda: S.bytes_to_string(F.lit(b"ab\0cd\0")), "ab"),
        (lambda: S.parse_comm(F.lit(b"ab\0cd\0\0")), "ab\0cd"),
        (lambda: S.parse_comm(F.lit(b"\xff\xfe\0")), "\xff\xfe"),
        (lambda: S.string_to_bytes(F.lit("abc"), 5), b"abc\0\0"),
        (lambda: S.string_to_bytes(F.lit("abcdef"), 4), b"abcd"),
        (lambda: S.format_bytes(F.lit(1023)), "1023 B"),
        (lambda: S.format_bytes(F.lit(1536)), "1.50 KB"),
        (lambda: S.format_bytes(F.lit(2**50)), "1024.00 TB"),
        (lambda: S.format_duration(F.lit(1500)), "1.50 ms"),
        (lambda: S.micros_to_string(F.lit(0)), "0"),
        (lambda: S.micros_to_string(F.lit(2_500_000)), "2.50s"),
        (lambda: S.reverse_flow_key(F.lit("a:1->b:2/TCP")), "b:2->a:1/TCP"),
        (lambda: S.reverse_flow_key(F.lit("broken")), "broken"),
        (lambda: S.reverse_flow_key(F.lit("a->b->c/TCP")), "a->b->c/TCP"),
        (lambda: S.is_private_ip(F.lit("172.31.0.1")), True),
        (lambda: S.is_private_ip(F.lit("172.32.0.1")), False),
        (lambda: S.protocol_name(F.lit(1)), "PROTO_1"),
        (lambda: S.direction_name(F.lit(9)), "UNKNOWN"),
        (lambda: S.tcp_state_name(F.lit(11)), "CLOSING"),
        (lambda: S.tcp_state_name(F.lit(12)), "UNKNOWN"),
        (lambda: S.swap16(F.lit(0x1234)), 0x3412),
        (lambda: S.tcp_flag_names(F.lit(18)), ["SYN", "ACK"]),
        (lambda: S.retrans_ratio(F.lit(1), F.lit(0)), 0.0),
        (lambda: S.threshold_color(F.lit(5.0), [(0, "green"), (5, "red")]), "red"),
        (lambda: S.humanize(F.lit(12345.0)), "12.35k"),
        (lambda: S.humanize(F.lit(0.012)), "12m"),
        (lambda: S.humanize_percentage(F.lit(0.0625)), "6.25%"),
        (lambda: S.ns_to_us(F.lit(1_700_000_000_123_456_789)), 1_700_000_000_123_456),
    ],
)
def test_scalars(spark, column, want):
    assert value(spark, column()) == want


def test_malformed_records_go_to_dead_letters(spark):
    df = spark.createDataFrame([(bytes(151),), (bytes(152),), (bytes(160),), (None,)], "raw binary")
    good, dead = codecs.decode_records(df, "tcp")
    assert (good.count(), dead.count()) == (2, 2)
    good, dead = codecs.decode_records(spark.createDataFrame([(bytes(63),)], "raw binary"), "udp")
    assert (good.count(), dead.count()) == (0, 1)


def test_record_offsets(spark):
    raw = bytearray(152)
    struct.pack_into("<QII16s", raw, 0, 5, 6, 7, b"nginx\0\0\0")
    struct.pack_into("<IIHHBBB", raw, 32, 0x0100000A, 2, 1234, 80, 6, 2, 1)
    struct.pack_into("<I4xQI4xQ", raw, 80, 3, 4, 5, 6)
    struct.pack_into("<BBBBI", raw, 144, 1, 2, 3, 7, 99)
    row = codecs.decode_records(spark.createDataFrame([(bytes(raw),)], "raw binary"), "tcp")[0].first()
    assert (row.ts_ns, row.pid, row.comm, row.saddr, row.sport, row.event_type, row.direction) == (5, 6, "nginx", 0x0100000A, 1234, 2, 1)
    assert (row.retrans_count, row.retrans_bytes, row.zero_wnd_count, row.zero_wnd_duration, row.tcp_state, row.duration_us, row.seq) == (3, 4, 5, 6, 7, 99, None)


def frame(ihl=5, protocol=6, ether=0x0800, l4=b""):
    ip = bytes([0x40 | ihl, 0]) + struct.pack(">HHHBBH", 40, 7, 0, 64, protocol, 0) + bytes([10, 0, 0, 1, 8, 8, 8, 8]) + bytes((ihl - 5) * 4)
    return bytes(12) + struct.pack(">H", ether) + ip + l4


def test_frames(spark):
    segment = struct.pack(">HHIIBBHHH", 1234, 80, 0, 0, 0x50, 18, 0, 0, 0)
    datas = [frame(l4=segment), frame(ihl=6, l4=segment), frame(protocol=17, l4=struct.pack(">HHHH", 5, 53, 8, 0)), frame(protocol=1), frame(ether=0x86DD), frame(l4=segment[:19]), b"", None]
    df = spark.createDataFrame([(i, 1, 0, 100, x) for i, x in enumerate(datas)], "ts_ns long, ifindex long, direction int, wire_len long, data binary")
    good, bad = codecs.frames_to_packets(df)
    got = {r.ts_ns: (r.sport, r.dport, r.protocol, r.tcp_flags, r.packet_len, r.ip_header_len) for r in good.collect()}
    assert got == {0: (1234, 80, 6, 18, 100, 20), 1: (1234, 80, 6, 18, 100, 24), 2: (5, 53, 17, 0, 100, 20), 3: (0, 0, 1, 0, 100, 20)}
    assert sorted(r.ts_ns for r in bad.collect()) == [4, 5, 6, 7]


def figures(df):
    return df.first().asDict()


def test_hand_written_traces(spark):
    s, e = {"event_type": 1, "ts_ns": 10}, {"event_type": 2, "ts_ns": 20, "retrans_count": 2, "packets_sent": 4, "rst_count": 1, "syn_retrans": 3}
    m = figures(metrics.tcp_metrics(flows.match_flows(tcp(spark, s, {"event_type": 3, "ts_ns": 15, "retrans_count": 1}, e)), dedup=True))
    assert (m["new_flows_total"], m["closed_flows_total"], m["active_flows"], m["retrans_packets_total"], m["retrans_packets_dedup"], m["retrans_ratio"]) == (1, 1, 0, 3, 1, 0.5)
    assert (m["server_reset_total"], m["client_syn_repeat_total"]) == (1, 3)
    m = figures(metrics.tcp_metrics(flows.match_flows(tcp(spark, e))))
    assert (m["closed_flows_total"], m["active_flows"], m["retrans_packets_total"], m["retrans_ratio"], m["server_reset_total"], m["client_syn_repeat_total"]) == (1, 0, 2, None, 0, 0)
    rows = tcp(spark, s, s | {"ts_ns": 11}, e)
    m = figures(metrics.tcp_metrics(flows.match_flows(rows)))
    assert (m["new_flows_total"], m["active_flows"], flows.open_connections(rows).count()) == (2, 1, 0)
    assert flows.match_flows(tcp(spark, s, e, e | {"ts_ns": 30})).where("matched").count() == 1
    late = e | {"ts_ns": 10 + 301 * 10**9}
    # at 300 s the flow is not older than 300 s yet, so it leaves at 600 s
    assert flows.match_flows(tcp(spark, s, late), 300).where("matched").count() == 1
    assert flows.match_flows(tcp(spark, s, e | {"ts_ns": 600 * 10**9}), 300).where("matched").count() == 0


def test_random_traces_match_the_rule(spark):
    r, rows = random.Random(3), []
    for i in range(600):
        rows.append({"event_type": r.choice([1, 2, 2, 3]), "ts_ns": r.randrange(200), "sport": r.randrange(12)})
    got = {(x.ts_ns, x.seq): x.matched for x in flows.match_flows(tcp(spark, *rows)).collect()}
    opened = set()
    for i, x in sorted(enumerate(rows), key=lambda p: (p[1]["ts_ns"], p[0])):
        if x["event_type"] == 1:
            opened.add(x["sport"])
        hit = x["event_type"] == 2 and x["sport"] in opened
        assert got[x["ts_ns"], i] == hit
        if x["event_type"] == 2:
            opened.discard(x["sport"])


def hooks(spark, *rows):
    return spark.createDataFrame([(s, t, h, a, 1, 2, 3, 4) for s, t, h, a in rows], "sock long, ts_ns long, hook string, arg long, saddr long, daddr long, sport int, dport int")


def test_socket_reuse_and_ack_pairing(spark):
    df = hooks(spark, (1, 1, "tcp_connect", 0), (1, 2, "tcp_set_state", 7), (1, 3, "tcp_sendmsg", 9), (1, 4, "tcp_connect", 0), (1, 5, "tcp_set_state", 1))
    assert sorted((r.life, r.packets_sent) for r in flows.reconstruct_flows(df).collect()) == [(1, 0), (2, 0)]
    df = hooks(spark, (1, 1, "tcp_connect", 0), (1, 1000, "tcp_sendmsg", 1), (1, 2000, "tcp_sendmsg", 1), (1, 7000, "tcp_ack", 0), (1, 9000, "tcp_ack", 0))
    f = flows.reconstruct_flows(df).first()
    assert (f.rtt_count, f.rtt_sum, f.rtt_mean) == (1, 5, 5)


def test_receive_pairing(spark):
    df = spark.createDataFrame([(1, 1, "entry", None, 7), (1, 2, "exit", -1, None), (1, 3, "exit", 20, None), (1, 4, "exit", 5, None)], "pid_tgid long, ts_ns long, kind string, ret long, sock long")
    assert [(r.ret, r.sock) for r in flows.pair_udp_receives(df).collect()] == [(20, 7)]


def series(spark, *points, name="m", labels=None):
    return spark.createDataFrame([(name, labels or {}, t, float(v)) for t, v in points], "name string, labels map<string,string>, ts_s long, value double")


def test_rate_resets_gaps_and_zero(spark):
    rows = series(spark, (0, 0), (15, 10), (30, 5), (45, 15)).unionByName(series(spark, (60, 0), name="other"))
    at = {r.t: r.value for r in V.increase(rows, "m", 60, 60).collect()}
    # samples at 15, 30 and 45 in (0, 60]... and at 0 in (-60, 0], which alone is not enough
    assert at.keys() <= {0, 60} and at[60] == pytest.approx((15 - 10 + 10) * (30 + 15 + 15) / 30)
    one = V.rate(series(spark, (0, 1)), "m", 60, 60)
    assert one.count() == 0


def test_quantile_edges(spark):
    def q(rows, p=0.5):
        return V.histogram_quantile(p, spark.createDataFrame([({"le": le}, 0, float(v)) for le, v in rows], "labels map<string,string>, t long, value double")).first().value

    assert q([("100", 4), ("200", 4), ("+Inf", 4)]) == 50
    assert q([("100", 0), ("200", 4), ("+Inf", 4)]) == 150
    assert q([("100", 0), ("200", 1), ("+Inf", 4)], 0.9) == 200
    assert q([("100", 0), ("+Inf", 0)]) != q([("100", 0), ("+Inf", 0)])  # NaN


def test_arithmetic_of_floats(spark):
    a, b = series(spark, (0, 1), (30, 0)), series(spark, (0, 0), (30, 0))
    out = {r.t: r.value for r in V.binary("/", *(x.withColumnRenamed("ts_s", "t") for x in (a, b))).collect()}
    assert out[0] == float("inf") and out[30] != out[30]
    nan = spark.createDataFrame([({}, 0, float("nan"))], "labels map<string,string>, t long, value double")
    assert V.compare(nan, ">", 0.05).count() == 0


def test_alerts_hold_and_start_anew(spark):
    present = spark.createDataFrame([({}, t, 1.0) for t in (0, 30, 60, 120, 150)], "labels map<string,string>, t long, value double")
    got = {r.t: (r.state, r.active_since) for r in rules.held(present, 60, 30).collect()}
    assert got == {0: ("pending", 0), 30: ("pending", 0), 60: ("firing", 0), 120: ("pending", 120), 150: ("pending", 120)}


def test_sampling_keeps_whole_flows(spark):
    rows = tcp(spark, *[{"event_type": k, "sport": p} for p in range(200) for k in (1, 2)])
    kept = events.sample_flows(rows, 50).groupBy("sport").count().collect()
    assert 40 < len(kept) < 160 and all(r["count"] == 2 for r in kept)
    with pytest.raises(ValueError):
        events.sample_flows(rows, 0)


def test_anomalies(spark):
    rows = [(1, 1, 2, 10, 80, 6, 2), (2, 2, 1, 80, 10, 6, 20), (3, 1, 2, 11, 80, 6, 18), (4, 1, 2, 10, 80, 6, 2), (5, 1, 2, 12, 80, 6, 17)]
    df = spark.createDataFrame(rows, "ts_ns long, saddr long, daddr long, sport int, dport int, protocol int, tcp_flags int")
    got = anomalies.anomaly_counts(df).first()
    assert (got.client_establish_fail, got.server_syn_miss, got.client_port_reuse) == (1, 1, 1)
    assert sorted(map(tuple, anomalies.anomaly_events(df).collect())) == [(1, 11), (3, 12), (4, 13), (5, 15)]


def test_registered_families(spark):
    own = metrics.Registry()
    own.register_metric("big_total", "event_type = 2 and bytes_sent > 5", "1")
    own.register_metric("last_size", "event_type = 2", "bytes_sent", "gauge")
    own.register_metric("size", "event_type = 2", "bytes_sent", "histogram")
    own.register_metric("by_port_total", "event_type = 2", "bytes_sent", labels={"port": "dport"})
    with pytest.raises(ValueError):
        own.register_metric("big_total", "true", "1")
    with pytest.raises(ValueError):
        own.register_metric("x", "true", "1", "gauge", {"a": "dport"})
    start = {"event_type": 1, "ts_ns": 1, "seq": 1}
    end = {"event_type": 2, "ts_ns": 20 * 10**9, "seq": 2, "bytes_sent": 150}
    m = flows.match_flows(tcp(spark, start, end, end | {"ts_ns": 40 * 10**9, "seq": 3, "bytes_sent": 3}))
    wide = metrics.tcp_metrics(m, registry=own).first()
    assert (wide["big_total"], wide["last_size"]) == (1, 3.0) and "by_port_total" not in wide
    got = {}
    for x in metrics.tcp_samples(m, registry=own).collect():
        if x.name.removeprefix("network_tcp_") in ("big_total", "last_size", "size_count", "by_port_total") or (x.name == "network_tcp_size_bucket" and x.labels == {"le": "100"}):
            got.setdefault(x.name.removeprefix("network_tcp_"), {})[x.ts_s] = x.value
    assert got["big_total"] == {15: 0, 30: 1, 45: 1} and got["last_size"] == {15: 0, 30: 150, 45: 3}
    assert got["size_count"] == {15: 0, 30: 1, 45: 2} and got["size_bucket"] == {15: 0, 30: 0, 45: 1}
    assert got["by_port_total"] == {30: 150, 45: 153}
    plain = {x.name for x in metrics.tcp_samples(m).select("name").distinct().collect()}
    more = {x.name for x in metrics.tcp_samples(m, registry=own).select("name").distinct().collect()}
    assert more - plain == {f"network_tcp_{n}" for n in ("big_total", "last_size", "size_bucket", "size_count", "size_sum", "by_port_total")}


@pytest.mark.parametrize("name", ["q_rtt_p95_per_minute", "q_ga1_reconstruct_flows", "q_ga4_tcp_metrics", "q_ga20_tcp_flags", "q_r1_rate", "q_d_o4", "q_a1_hightcpretransmissionrate", "q_t4_stream_match"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(map(show, r)) for r in cur.fetchall())
    assert sorted(tuple(map(show, r)) for r in df.select(names).collect()) == want


def test_entry_point(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_empty_tables(spark):
    empty = spark.createDataFrame([], TCP)
    assert flows.match_flows(empty).count() == 0
    assert metrics.tcp_metrics(flows.match_flows(empty)).first()["new_flows_total"] == 0


def test_importable_without_the_corpus_part():
    code = "import sys; sys.modules['flowloom.llm'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'q_r1_rate' in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(__file__).parent.parent)).returncode == 0


def test_byte_sizes_are_exact_on_ties(spark):
    """Expected texts as C's and Go's %.2f print the exact binary value."""
    want = {1024 + 128: "1.12 KB", 1024 + 384: "1.38 KB", 1024 + 640: "1.62 KB", 1024 + 896: "1.88 KB", 2**20 - 1: "1024.00 KB", 2**20 + 2**17: "1.12 MB", 2**30 + 2**27 + 1: "1.13 GB", 2**40 + 2**37: "1.12 TB"}
    sizes = [*want, *range(1024, 1024 * 1024, 64), *(random.Random(3).getrandbits(b) for b in range(11, 63) for _ in range(20))]
    for n in sizes:
        k = max(k for k in range(5) if n >= 1024**k)
        want.setdefault(n, f"{float(n) / 1024**k:.2f} {S.UNITS[k]}" if k else f"{n} B")
    df = spark.createDataFrame([(n,) for n in want], "n long")
    assert {r.n: r.t for r in df.select("n", S.format_bytes("n").alias("t")).collect()} == want


def test_every_flow_is_formatted(spark, sf):
    got = entry.queries()["q_p6_formats"](spark, sf)
    flows_ = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert got.count() == flows_ and got.where("k % 8 = 0").count() > 0


def test_texts_of_ties(spark):
    """Rounded by the exact binary value, ties to even, as printf of C and Go."""
    want = {1152: "1.12 KB", 1408: "1.38 KB", 1023: "1023 B"}
    got = spark.createDataFrame([(n,) for n in want], "n long").select("n", S.format_bytes("n").alias("t")).collect()
    assert {r.n: r.t for r in got} == want
    ticks = [999, 1000, 1125, 1375, 1005, 999995, 1005000, 1015000, 1125000, 2675000, 4 * 10**12 + 5000, 7 * 10**9 + 125000]
    text = lambda us: f"{us} µs" if us < 1000 else "%.2f ms" % (us / 1000) if us < 10**6 else "%.2f s" % (us / 10**6)
    got = spark.createDataFrame([(n,) for n in ticks], "n long").select("n", S.format_duration("n").alias("t")).collect()
    assert {r.n: r.t for r in got} == {n: text(n) for n in ticks}
