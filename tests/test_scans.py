import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import flows as W
from flowloom.operators import metrics as M
from flowloom.operators.scans import Run, running

S = 1_000_000_000


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def events(spark, n=400, seed=3):
    r = random.Random(seed)
    made = [(r.choice([None, 1, 2]), r.randrange(60) * S, k, r.choice([None, 1, 5, 9])) for k in range(n)]
    return spark.createDataFrame(made, "k long, ts_ns long, seq long, v long")


@pytest.mark.parametrize("own", [True, False])
def test_slices_say_what_one_window_says(spark, own):
    runs = {kind: Run(kind, F.col("v"), own) for kind in ("sum", "min", "max", "last", "next")}
    df = events(spark)
    whole = rows(running(df, ["k"], ["ts_ns", "seq"], runs))
    for s in (1, 7, 1000):
        assert rows(running(df, ["k"], ["ts_ns", "seq"], runs, s)) == whole
    # by hand
    want = {}
    for k in (None, 1, 2):
        mine = sorted((x.ts_ns, x.seq, x.v) for x in df.collect() if x.k == k)
        for at, (ts, seq, v) in enumerate(mine):
            before = [y for _, _, y in mine[: at + own] if y is not None]
            after = [y for _, _, y in mine[at + 1 - own :] if y is not None]
            want[seq] = (sum(before) if before else None, min(before, default=None), max(before, default=None), before[-1] if before else None, after[0] if after else None)
    assert {x[2]: x[4:] for x in whole} == want


def test_slices_of_no_rows(spark):
    df = events(spark).limit(0)
    assert running(df, ["k"], ["ts_ns", "seq"], {"so_far": Run("sum", F.col("v"))}, 5).collect() == []


def hooks(spark, n=3000, seed=5):
    """Half of all rows are of one socket."""
    r = random.Random(seed)
    names = ["tcp_connect"] + ["tcp_sendmsg", "tcp_ack"] * 6 + ["tcp_retransmit_skb", "tcp_send_active_reset", "tcp_synack", "tcp_set_state", "tcp_set_state"]
    made = [(0 if r.random() < 0.5 else r.randrange(1, 300), k * S // 3, r.choice(names), r.choice([1, 7, 100]), 1, 2, 3, 4) for k in range(n)]
    return spark.createDataFrame(made, "sock long, ts_ns long, hook string, arg long, saddr long, daddr long, sport int, dport int")


def test_flows_in_slices(spark):
    h = hooks(spark)
    for make in (W.hook_lifetimes, W.reconstruct_flows, W.hook_events_to_tcp_events, lambda x, s=None: W.round_trips(W.hook_lifetimes(x, s), s)):
        assert rows(make(h, 20)) == rows(make(h)) != []
    calls = h.select(F.lit(7).alias("pid_tgid"), "ts_ns", F.when(F.col("arg") == 1, "entry").otherwise("exit").alias("kind"), (F.col("arg") - 7).alias("ret"), "sock")
    assert rows(W.pair_udp_receives(calls, 20)) == rows(W.pair_udp_receives(calls)) != []


def test_a_closed_socket_says_nothing_until_it_connects(spark):
    made = [("tcp_sendmsg", 0), ("tcp_connect", 0), ("tcp_sendmsg", 5), ("tcp_set_state", 7), ("tcp_sendmsg", 6), ("tcp_set_state", 7), ("tcp_connect", 0), ("tcp_ack", 0)]
    df = spark.createDataFrame([(1, k * 10 * S, hook, arg, 1, 2, 3, 4) for k, (hook, arg) in enumerate(made)], hooks(spark, 1).schema)
    for s in (None, 15):
        assert sorted((x.ts_ns // S, x.life) for x in W.hook_lifetimes(df, s).collect()) == [(10, 1), (20, 1), (30, 1), (60, 2), (70, 2)]


def test_no_task_reads_more_than_a_slice_of_a_hot_key(spark):
    made = [(1 if k % 2 else k, 2, 3, 4, 5, k * S, 1, 10) for k in range(12000)]
    udp = spark.createDataFrame(made, "saddr long, daddr long, sport int, dport int, pid long, ts_ns long, direction int, packet_size long")
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        def most(slice_s):
            done = M.udp_running_totals(udp, slice_s).select("total_bytes", F.spark_partition_id().alias("task"))
            tasks = [(x[1], x[2]) for x in done.groupBy("task").agg(F.count(F.lit(1)), F.max("total_bytes")).collect()]
            assert sum(n for n, _ in tasks) == 12000 and max(m for _, m in tasks) == 60000
            return max(n for n, _ in tasks)

        assert most(None) > 6000
        # 120 slices of 50 rows of the hot key, in 16 tasks
        assert most(100) < 2000
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_events_in_slices_exchange_the_rows_once(spark):
    h = hooks(spark, 1500, 8).withColumn("sock", F.expr("nullif(sock, 9)")).withColumn("hook", F.expr("case when ts_ns % 7 = 3 then 'other' else hook end"))
    whole = rows(W.hook_events_to_tcp_events(h))
    for s in (1, 5, 60, 10_000):
        assert rows(W.hook_events_to_tcp_events(h, s)) == whole != []
    some = W.hook_events_to_tcp_events(h, 20).select("event_type", "ts_ns", "syn_rtt", "bytes_sent", "retrans_bytes")
    some.collect()
    plan = some._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "ReusedExchange" not in line]
    # of the rows, of what slices leave behind, and of the rows that another slice's life may reach; before, 10
    assert len(made) == 3 and plan.count("ReusedExchange") == 2, plan
