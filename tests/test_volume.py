"""What large tables need: streams by tables, sums beyond a long, slices of a day in histories and range functions."""

import pytest
from pyspark.sql import functions as F

from flowloom import queries
from flowloom.operators import metrics as M
from flowloom.plans import vectors as V
from flowloom.streaming import alerts, flow_state, flow_tables, jobs
from flowloom.streaming.carried import Carried
from test_streams import HOOK_ROWS, S, rows, tcp

START, END, RETRANS = {"event_type": 1}, {"event_type": 2}, {"event_type": 3}


@pytest.mark.parametrize(
    "batches, want",
    [
        (
            [[START | {"ts_ns": 5 * S}, START | {"ts_ns": 8 * S, "sport": 11}, END | {"ts_ns": 9 * S, "sport": 11}], [RETRANS | {"ts_ns": 700 * S, "sport": 99}], [END | {"ts_ns": 710 * S}]],
            [(10, "expired", 5 * S, None, 0), (10, "orphan", None, 710 * S, 0), (11, "matched", 8 * S, 9 * S, 0)],
        ),
        ([[END | {"ts_ns": 20 * S}], [START | {"ts_ns": 25 * S}]], [(10, "orphan", None, 20 * S, 0)]),
        # open over a batch, with its last count; replaced; let go by an event of its own, before the watermark does
        ([[START | {"ts_ns": 5 * S}, RETRANS | {"ts_ns": 6 * S, "retrans_count": 4}], [RETRANS | {"ts_ns": 601 * S, "retrans_count": 9}, END | {"ts_ns": 602 * S}]], [(10, "expired", 5 * S, None, 4), (10, "orphan", None, 602 * S, 0)]),
        ([[START | {"ts_ns": 5 * S}], [START | {"ts_ns": 7 * S}], [END | {"ts_ns": 9 * S, "retrans_count": 2}, END | {"ts_ns": 10 * S}]], [(10, "matched", 7 * S, 9 * S, 2), (10, "orphan", None, 10 * S, 0)]),
        # later than the watermark
        ([[START | {"ts_ns": 50 * S}], [END | {"ts_ns": 39 * S}, END | {"ts_ns": 60 * S}]], [(10, "matched", 50 * S, 60 * S, 0)]),
    ],
)
def test_flows_by_tables_are_those_of_the_machine(spark, tmp_path, batches, want):
    carried = Carried(spark, str(tmp_path))
    for k, batch in enumerate(batches):
        for _ in range(2):
            flow_tables.match_batch(carried, tcp(spark, *batch), k, 300, 10)
    found = flow_tables.done_of(spark, str(tmp_path), flow_state.MATCHED)
    assert rows(found.select("sport", "kind", "start_ts", "end_ts", "retrans_count")) == want


def test_connections_by_tables_outlive_a_batch_and_leave_for_their_age(spark, tmp_path):
    hook = lambda sock, t, name, arg=0: (sock, t * S, name, arg, 1, 2, 3, 4)
    first = [hook(1, 1, "tcp_connect"), hook(1, 2, "tcp_set_state", 1), hook(1, 3, "tcp_sendmsg", 50), hook(2, 3, "tcp_sendmsg", 9), hook(3, 3, "tcp_connect"), hook(4, 1, "tcp_connect"), hook(4, 2, "tcp_sendmsg", 5)]
    second = [hook(1, 5, "tcp_retransmit_skb", 7), hook(1, 6, "tcp_set_state", 7), hook(1, 7, "tcp_sendmsg", 99), hook(2, 8, "tcp_connect"), hook(2, 8, "tcp_set_state", 7), hook(4, 4, "tcp_connect"), hook(4, 5, "tcp_set_state", 7)]
    third, fourth = [hook(5, 1000, "tcp_connect")], [hook(3, 1001, "tcp_set_state", 7), hook(5, 1002, "tcp_set_state", 7)]
    carried = Carried(spark, str(tmp_path))
    for k, part in enumerate((first, second, third, fourth)):
        flow_tables.reconstruct_batch(carried, spark.createDataFrame(part, HOOK_ROWS), k, 300)
    got = rows(flow_tables.done_of(spark, str(tmp_path), jobs.FLOWS))
    assert got == [(1, S, 2 * S, 6 * S, 50, 1, 1, 0), (2, 8 * S, None, 8 * S, 0, 0, 0, 0), (4, 4 * S, None, 5 * S, 0, 0, 0, 0), (5, 1000 * S, None, 1002 * S, 0, 0, 0, 0)]


def test_sums_of_stamps_may_be_no_longs(spark, monkeypatch):
    late = 2**62
    made = [(k, late + k, hook, arg, 1, 2, 3, 4) for k in range(3) for hook, arg in (("tcp_connect", 0), ("tcp_set_state", 7))]
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame(made, HOOK_ROWS))
    found = queries.events_from_hooks(spark, "")
    assert [(r.event_type, r.events, int(r.stamps)) for r in found.collect()] == [(2, 3, 3 * late + 3)]
    assert dict(found.dtypes)["bytes_sent"] == "bigint"


def test_a_series_in_slices_gives_what_it_gives_whole(spark, monkeypatch):
    made = [("m", {"k": k}, t, float((t * 7) % 50 + t)) for k in "ab" for t in range(5, 2000, 15) if not 400 < t < 700]
    samples = spark.createDataFrame(made, alerts.SAMPLES)
    views = lambda: [rows(f.selectExpr("labels['k'] k", "t", "round(value, 9) v")) for f in (V.rate(samples, "m", 300), V.increase(samples, "m", 60), V.increase(samples, "m", 600, only_last=True), V.instant(samples, "m"))]
    assert "slice" in V.at_points(samples, "m", 300, 30).columns
    whole = views()
    monkeypatch.setattr(V, "SLICE_S", 200)
    assert views() == whole and all(whole)


def test_a_history_in_slices_is_that_of_the_whole(spark, sf, monkeypatch):
    from flowloom.operators import anomalies as A

    rates = lambda: rows(queries.flat(M.samples(queries.with_expiries(spark, sf), "tcp", M.TCP_COUNTERS, (M.ACTIVE,), M.TCP_LAST, M.TCP_HISTOGRAMS[:1], rates=A.RATES, store=queries.stored)))
    whole = rates()
    monkeypatch.setattr(M, "DAY_S", 90)
    assert rates() == whole and whole


def test_half_closed_flows_need_no_sets(spark):
    from flowloom.operators import anomalies as A

    packet = lambda t, a, b, flags: (t, a, b, 1000 + a, 1000 + b, 6, flags)
    made = [packet(1, 1, 2, 2), packet(2, 2, 1, 18), packet(3, 1, 2, 17), packet(1, 3, 4, 2), packet(2, 4, 3, 17), packet(3, 4, 3, 17), packet(1, 5, 6, 17), packet(2, 6, 5, 17), packet(1, 7, 8, 2), packet(4, 9, 9, 17)]
    found = A.half_closed(spark.createDataFrame(made, "ts_ns long, saddr long, daddr long, sport int, dport int, protocol int, tcp_flags int"))
    assert rows(found.select("ts_ns", "by_client")) == [(3, False), (3, True), (4, True)]
    assert "collect_set" not in found._jdf.queryExecution().executedPlan().toString()


NAMED = "bytes_sent_total new_flows_total server_reset_total active_flows retrans_ratio rtt_microseconds_bucket srt_microseconds_sum connections_by_state timeout_total client_wait_microseconds_count".split()


@pytest.mark.parametrize("day", [90, 86400])
def test_samples_of_few_families_are_those_of_the_whole_history(spark, sf, monkeypatch, day):
    whole = queries.flat(M.tcp_samples(queries.with_expiries(spark, sf)))
    monkeypatch.setattr(M, "DAY_S", day)
    monkeypatch.setattr(queries, "WRITTEN", {})
    names = [f"network_tcp_{n}" for n in NAMED]
    few = rows(queries.flat(queries.samples_named(spark, sf, "tcp", names)))
    assert few == rows(whole.where(F.col("name").isin(names))) and {r[0] for r in few} == set(names)


def test_samples_of_few_families_of_datagrams_and_packets(spark, sf, monkeypatch):
    from flowloom.operators import anomalies as A

    monkeypatch.setattr(queries, "WRITTEN", {})
    udp = ["network_udp_bytes_sent_total", "network_udp_packets_per_second", "network_udp_active_flows"]
    whole = queries.flat(M.udp_samples(queries.table(spark, sf, "udp"))).where(F.col("name").isin(udp))
    assert rows(queries.flat(queries.samples_named(spark, sf, "udp", udp))) == rows(whole)
    fed = [f"network_tcp_{f[0]}" for f in (*A.COUNTERS, *A.RATES)] + ["network_tcp_active_flows"]
    whole = queries.flat(M.tcp_samples(queries.with_expiries(spark, sf), packets=queries.table(spark, sf, "packets"))).where(F.col("name").isin(fed))
    assert rows(queries.flat(queries.samples_named(spark, sf, "tcp and packets", fed))) == rows(whole)


def test_a_panel_computes_its_own_families_alone(spark, sf, monkeypatch):
    monkeypatch.setattr(queries, "WRITTEN", {})
    monkeypatch.setattr(queries, "READ", {})
    assert queries.QUERIES["q_d_o10"](spark, sf).count()
    assert sorted(name for *_, name in queries.WRITTEN) == ["tcp sums of slot bytes_sent_total bytes_received_total", "udp sums of slot bytes_sent_total bytes_received_total"]
    assert queries.QUERIES["q_d_l31"](spark, sf).count() and len(queries.WRITTEN) == 2


def test_events_are_dealt_by_slot_before_they_are_added_up(spark, sf):
    sums = M.slot_sums(queries.derived(spark, sf, "tcp").withColumn("matched", F.lit(True)), last_values=(), histograms=M.TCP_HISTOGRAMS[:1], states=False, parts=3)[0]
    plan = sums._jdf.queryExecution().executedPlan().toString()
    own = [line for line in plan.splitlines() if "Aggregate" in line and "keys=[slot" in line]
    dealt = [line for line in plan.splitlines() if "hashpartitioning(slot" in line]
    assert len(own) == 2 and len(dealt) == 1 and ", 3)" in dealt[0] and plan.index(dealt[0]) > plan.index(own[-1])


def test_states_in_slices_are_those_of_the_whole(spark, monkeypatch):
    sums = spark.createDataFrame([("n", {"s": k}, t, 1.0) for k in "ab" for t in range(0, 600, 45) if k == "a" or t > 200], "name string, labels map<string,string>, slot long, d double")
    until = spark.createDataFrame([(900,)], "until long")
    view = lambda days: rows(M.densified(sums, until, 15, days).selectExpr("labels['s'] s", "ts_s", "value"))
    whole = view(None)
    monkeypatch.setattr(M, "DAY_S", 100)
    assert view(9) == whole and len(whole) > 50


def test_states_alone_are_a_query(spark, sf, monkeypatch):
    monkeypatch.setattr(queries, "WRITTEN", {})
    assert rows(queries.QUERIES["q_d_o30"](spark, sf).where("value > 0").select("legend").distinct())
