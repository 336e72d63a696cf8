"""Streams: alerts and snapshots carried over batches, flows with timers, late rows, failing handlers."""

import pytest
from pyspark.sql import functions as F

from flowloom import queries
from flowloom.operators import flows as W
from flowloom.operators import metrics as M
from flowloom.plans import rules as R
from flowloom.plans import vectors as V
from flowloom.schemas import TCP
from flowloom.sources import events
from flowloom.streaming import alerts, flow_state, jobs, snapshots
from flowloom.streaming.carried import Carried

ZERO = {f.name: 0 for f in TCP}
BASE = ZERO | {"comm": "app", "saddr": 1, "daddr": 2, "sport": 10, "dport": 80, "protocol": 6, "direction": 1, "tcp_state": 7}
S = 1_000_000_000


def tcp(spark, *rows):
    return spark.createDataFrame([tuple((BASE | {"seq": i} | r)[c] for c in TCP.fieldNames()) for i, r in enumerate(rows)], TCP)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_flows_leave_at_the_tick_after_their_age(spark):
    start, end = {"event_type": 1, "ts_ns": 10 * S}, {"event_type": 2}
    found = lambda *e: W.match_flows(tcp(spark, *e), 300)
    assert found(start, end | {"ts_ns": 599 * S}).where("matched").count() == 1
    late = found(start, end | {"ts_ns": 600 * S})
    assert late.where("matched").count() == 0 and late.where("event_type = 1").first().expired_ts == 600 * S
    assert found(start | {"ts_ns": 300 * S}).first().expired_ts == 900 * S, "as old as the age is not older"
    twice = found(start, start | {"ts_ns": 20 * S}, end | {"ts_ns": 30 * S})
    assert twice.where("expired_ts is not null").count() == 0
    gone = W.with_expiries(late, 700 * S)
    assert rows(gone.select("event_type", "ts_ns", "bytes_sent")) == [(1, 10 * S, 0), (2, 600 * S, 0), (6, 600 * S, None)]
    assert W.with_expiries(late, 599 * S).count() == 2
    assert M.tcp_metrics(gone).first().active_flows == 0
    assert rows(W.expired_flows(tcp(spark, start), 300).select("start_ts", "expired_ts")) == [(10 * S, 600 * S)]


@pytest.fixture()
def stream(spark, tmp_path):
    """Feeds batches of TCP events to a stream of matched flows, one run a batch."""

    def feed(hold, *batches):
        for k, batch in enumerate(batches):
            tcp(spark, *batch).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = events.read_events(spark, f"{tmp_path}/in", "tcp", streaming=True)
            jobs.run_available(flow_state.match_flows_stream(source, 300, "10 seconds", hold), str(tmp_path / "out"))
        done = spark.read.schema(flow_state.MATCHED).parquet(f"{tmp_path}/out/rows")
        return rows(done.select("sport", "kind", "start_ts", "end_ts"))

    return feed


def test_timers_let_old_flows_go(stream):
    other = {"event_type": 3, "sport": 99}
    got = stream(False, [{"event_type": 1, "ts_ns": 5 * S}, {"event_type": 1, "ts_ns": 8 * S, "sport": 11}, {"event_type": 2, "ts_ns": 9 * S, "sport": 11}], [other | {"ts_ns": 700 * S}], [{"event_type": 2, "ts_ns": 710 * S}])
    assert got == [(10, "expired", 5 * S, None), (10, "orphan", None, 710 * S), (11, "matched", 8 * S, 9 * S)]


def test_an_end_waits_for_its_start_in_the_mode_that_holds(stream):
    end, start = {"event_type": 2, "ts_ns": 20 * S}, {"event_type": 1, "ts_ns": 15 * S}
    lone = {"event_type": 2, "ts_ns": 21 * S, "sport": 12}
    got = stream(True, [end, lone], [start], [{"event_type": 3, "ts_ns": 100 * S, "sport": 99}])
    assert got == [(10, "matched", 15 * S, 20 * S), (12, "orphan", None, 21 * S)]


def test_an_end_is_an_orphan_at_once_in_the_other_mode(stream):
    assert stream(False, [{"event_type": 2, "ts_ns": 20 * S}], [{"event_type": 1, "ts_ns": 25 * S}]) == [(10, "orphan", None, 20 * S)]


def test_a_batch_that_runs_again_changes_no_snapshot(spark, sf, tmp_path):
    all_events = queries.table(spark, sf, "tcp").select(*TCP.fieldNames())
    middle = 200 * S
    carried = Carried(spark, str(tmp_path))
    first, second = all_events.where(F.col("ts_ns") < middle), all_events.where(F.col("ts_ns") >= middle)
    snapshots.take_batch(carried, first, 0)
    snapshots.take_batch(carried, second, 1)
    snapshots.take_batch(carried, second, 1)
    snapshots.take_batch(carried, all_events.limit(0), 2)
    snapshots.finish(spark, str(tmp_path))
    until = all_events.agg(F.max("ts_ns")).first()[0]
    want = M.tcp_samples(W.with_expiries(W.match_flows(all_events, 300), until))
    assert rows(queries.flat(snapshots.history(spark, str(tmp_path)))) == rows(queries.flat(want))


RULE = R.Rule("Many", ("instant", "m"), ">", 5, 60, 30, "warning", "test", "{v} is many")


def test_alerts_over_batches_equal_alerts_over_all(spark, tmp_path):
    values = [9 if k % 13 < 7 else 0 for k in range(40)]
    series = [("m", {"k": "a"}, 15 * (k + 1), float(v)) for k, v in enumerate(values)] + [("m", {"k": "b"}, 15 * (k + 1), 9.0) for k in range(40)]
    samples = spark.createDataFrame(series, alerts.SAMPLES)
    carried = Carried(spark, str(tmp_path))
    for batch, (a, b) in enumerate(((0, 100), (100, 105), (105, 400), (400, 601))):
        part = samples.where(F.col("ts_s").between(a, b - 1))
        alerts.evaluate_batch(carried, part, batch, {"x": RULE})
        if batch == 2:
            alerts.evaluate_batch(carried, part, batch, {"x": RULE})
    alerts.evaluate_batch(carried, samples.limit(0), 4, {"x": RULE})
    columns = ("t", "value", "state", "active_since", "description")
    label = F.col("labels")["k"].alias("k")
    want = rows(R.evaluate_rule(RULE, samples).select(label, *columns))
    assert rows(alerts.alerts_of(spark, str(tmp_path)).select(label, *columns)) == want and want
    changed = rows(alerts.changes_of(spark, str(tmp_path)).select(label, "t", "state"))
    assert [c for c in changed if c[0] == "b"] == [("b", 30, "pending"), ("b", 90, "firing")]
    mine = {(r[0], r[1], r[3], r[4]) for r in want if r[0] == "a"}
    begun = sorted({since for _, _, _, since in mine})
    assert sorted(t for k, t, state in changed if state == "pending" and k == "a") == begun
    assert len([1 for k, _, state in changed if k == "a" and state == "inactive"]) in (len(begun), len(begun) - 1)


def test_late_rows_are_counted(spark, tmp_path):
    for k, at in enumerate((1000, 2000, 100)):
        spark.createDataFrame([(at * S, 1)], "ts_ns long, packet_size long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("ts_ns long, packet_size long").parquet(f"{tmp_path}/in")
        query = jobs.windowed_counts(source, "packet_size").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/o").trigger(availableNow=True).start()
        query.awaitTermination()
    dropped = jobs.dropped_rows(query)
    assert dropped.agg(F.sum("dropped")).first()[0] == 1


def test_a_failing_handler_stops_no_other(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")

    def broken(batch, number):
        raise ValueError("no")

    out = jobs.by_batch(f"{tmp_path}/out")
    handlers = {"broken": broken, "good": out, "again": out}
    jobs.to_tables(source, handlers, f"{tmp_path}/s", poison="id = 3", availableNow=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 9
    assert rows(spark.read.json(f"{tmp_path}/s/errors").select("handler", "kind", "message")) == [("broken", "ValueError", "no")]
    assert spark.read.json(f"{tmp_path}/s/dead").count() == 1


def test_a_history_is_read_by_folder(spark, tmp_path):
    day = 86400
    series = [(n, {"a": "b"}, t, float(t)) for n in ("x", "y") for t in range(0, 10 * day, 7200)]
    events.write_samples(spark.createDataFrame(series, alerts.SAMPLES), str(tmp_path))
    history = events.read_samples(spark, str(tmp_path))
    assert history.count() == len(series)
    hour = events.in_range(history, 3 * day, 3 * day + 3600).where("name = 'x'")
    assert len(hour.inputFiles()) <= len(history.inputFiles()) and hour.count() == 1
    plan = hour._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "family" in filters.split("PushedFilters")[0] and "date" in filters.split("PushedFilters")[0]
    events.expire_samples(spark, str(tmp_path), 7)
    left = events.read_samples(spark, str(tmp_path)).agg(F.min("ts_s"), F.countDistinct("date")).first()
    assert tuple(left) == (3 * day, 7)


def test_missing_slots_come_from_gaps(spark):
    heard = [("a", 0), ("a", 15), ("a", 60), ("b", 30)]
    up = R.liveness(spark.createDataFrame([({"instance": i}, t) for i, t in heard], "labels map<string,string>, ts_s long"))
    got = {(r.labels["instance"], r.ts_s): r.value for r in up.collect()}
    assert got == {(i, t): float((i, t) in heard) for i in "ab" for t in range(0, 75, 15)}
    down = R.evaluate_rule(R.RULES["a8"], V.select_labels(up, job="agent", instance="b"))
    assert rows(down.select("t", "state")) == [(0, "pending"), (60, "pending")] or rows(down.select("t", "state")) == [(0, "pending"), (60, "firing")]


def test_sliding_windows_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(t * S, 10) for t in (0, 40, 310, 2000)], "ts_ns long, packet_size long").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("ts_ns long, packet_size long").parquet(f"{tmp_path}/in")
    done = spark.read.parquet(jobs.run_available(jobs.windowed_counts(source, "packet_size", "5 minutes", "30 seconds"), str(tmp_path / "o")))
    got = {x.s: (x.total, x.events) for x in done.select(F.unix_timestamp("window_start").alias("s"), "total", "events").collect()}
    want = {w: [t for t in (0, 40, 310) if w <= t < w + 300] for w in range(-270, 330, 30)}
    assert got == {w: (10 * len(ts), len(ts)) for w, ts in want.items() if ts}


HOOK_ROWS = "sock long, ts_ns long, hook string, arg long, saddr long, daddr long, sport int, dport int"


def test_connections_of_a_stream_outlive_a_restart(spark, tmp_path):
    hook = lambda sock, t, name, arg=0: (sock, t * S, name, arg, 1, 2, 3, 4)
    parts = [
        [hook(1, 1, "tcp_connect"), hook(1, 2, "tcp_set_state", 1), hook(1, 3, "tcp_sendmsg", 50), hook(2, 3, "tcp_sendmsg", 9)],
        [hook(1, 5, "tcp_retransmit_skb", 7), hook(1, 6, "tcp_set_state", 7), hook(1, 7, "tcp_sendmsg", 99), hook(2, 8, "tcp_connect"), hook(2, 8, "tcp_set_state", 7)],
    ]
    for part in parts:
        spark.createDataFrame(part, HOOK_ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(HOOK_ROWS).parquet(f"{tmp_path}/in")
        jobs.run_available(jobs.reconstruct_flows_stream(source), str(tmp_path / "o"))
    got = rows(spark.read.schema(jobs.FLOWS).parquet(f"{tmp_path}/o/rows"))
    assert got == [(1, S, 2 * S, 6 * S, 50, 1, 1, 0), (2, 8 * S, None, 8 * S, 0, 0, 0, 0)]


def test_connections_of_a_stream_leave_for_their_age(spark, tmp_path):
    made = [[(1, 1 * S, "tcp_connect")], [(2, 1000 * S, "tcp_connect")], [(1, 1001 * S, "tcp_set_state"), (2, 1002 * S, "tcp_set_state")]]
    for part in made:
        full = [(*x, 7, 1, 2, 3, 4) for x in part]
        spark.createDataFrame(full, HOOK_ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(HOOK_ROWS).parquet(f"{tmp_path}/in")
        jobs.run_available(jobs.reconstruct_flows_stream(source, 300), str(tmp_path / "o"))
    assert [x[0] for x in rows(spark.read.schema(jobs.FLOWS).parquet(f"{tmp_path}/o/rows"))] == [2]


def test_updates_of_totals(spark, tmp_path):
    schema = "saddr long, daddr long, sport int, dport int, pid long, packet_size long"
    for part in ([(1, 2, 3, 4, 5, 10), (9, 2, 3, 4, 5, 1)], [(1, 2, 3, 4, 5, 7), (1, 2, 3, 4, 5, 7)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.run_updates(jobs.running_udp_totals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), str(tmp_path))
    assert rows(jobs.last_updates(spark, str(tmp_path), [*W.TUPLE, "pid"])) == [(1, 2, 3, 4, 5, 24, 3), (9, 2, 3, 4, 5, 1, 1)]
    assert spark.read.parquet(f"{tmp_path}/rows").count() == 3
