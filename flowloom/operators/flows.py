"""Flow reconstruction and matching: every rule is a window over one key, so one exchange serves each operator.

Order within a key is (ts_ns, seq). Windows are keyed by raw integers (socket, five-tuple, thread), never by a
formatted key, and need no self join. Hook rows of one stamp are taken by name and argument. Where one key may have
more rows than a task can take, slice_s cuts it into slices of time (scans).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.scans import HEAD, PLACE, ROW, SLICE, Run, running

TUPLE = ["saddr", "daddr", "sport", "dport"]
START, END, RETRANS, ZERO_WINDOW, RESET = 1, 2, 3, 4, 5
#: Not a recorded event: derived when a flow is too old.
EXPIRED = 6
MAX_AGE_S = 300
ESTABLISHED, CLOSE = 1, 7
HOOK_ORDER = ["ts_ns", "hook", "arg"]
#: In the order of their names, so that their places can stand for them.
HOOKS = ["tcp_ack", "tcp_connect", "tcp_retransmit_skb", "tcp_send_active_reset", "tcp_sendmsg", "tcp_set_state", "tcp_synack"]


def expiry_tick(start: str, max_age_s: int) -> Column:
    """F8: when a flow leaves: collection runs every max_age_s and takes what is older than max_age_s by then."""
    age = max_age_s * 1_000_000_000
    return F.expr(f"(({start}) + {age}) div {age} * {age} + {age}")


def match_flows(tcp: DataFrame, max_age_s: int | None = None, slice_s: int | None = None) -> DataFrame:
    """Each event with matched (an END whose flow is open), start_ts, retrans_ratio, timeout_occurred.

    An END is matched if the START or END before it, of the same five-tuple, is a START. With max_age_s, a flow that
    is still open at its expiry_tick leaves then (expired_ts of its START), before any event of that moment, and its
    END is an orphan. A START that another START replaces does not expire. slice_s: see scans.
    """
    ends = F.col("event_type").isin(START, END)
    runs = {"previous": Run("last", F.when(ends, F.struct("event_type", "ts_ns")), own=False)}
    if max_age_s is not None:
        runs["next_ts"] = Run("next", F.when(ends, F.col("ts_ns")), own=False)
    # what is no end of a flow has no match, and is not exchanged
    out = running(tcp.where(ends), [*TUPLE, "protocol"], ["ts_ns", "seq"], runs, slice_s)
    open_flow = F.col("previous.event_type") == START
    if max_age_s is not None:
        open_flow &= F.col("ts_ns") < expiry_tick("previous.ts_ns", max_age_s)
        tick = expiry_tick("ts_ns", max_age_s)
        gone = (F.col("event_type") == START) & (F.col("next_ts").isNull() | (tick <= F.col("next_ts")))
        out = out.withColumn("expired_ts", F.when(gone, tick)).drop("next_ts")
    out = out.withColumn("matched", (F.col("event_type") == END) & F.coalesce(open_flow, F.lit(False)))
    out = out.withColumn("start_ts", F.when(F.col("matched"), F.col("previous.ts_ns"))).drop("previous")
    ratio = F.when(F.col("packets_sent") > 0, F.col("retrans_count") / F.col("packets_sent")).otherwise(F.lit(0.0))
    others = tcp.where(~F.coalesce(ends, F.lit(False))).withColumn("matched", F.lit(False))
    out = out.unionByName(others, allowMissingColumns=True)
    return out.withColumn("retrans_ratio", F.when(F.col("matched"), ratio)).withColumn("timeout_occurred", F.col("timeout_flag") > 0)


def with_expiries(matched: DataFrame, until_ns: int) -> DataFrame:
    """G-A6: matched (with expired_ts), and an EXPIRED event for each flow that leaves by until_ns; its counters are null."""
    left = F.col("expired_ts") <= until_ns
    kept = ("ts_ns", "event_type", "matched", *TUPLE, "protocol", "seq")
    plain = [c for c in matched.columns if c not in ("ts_ns", "event_type", "expired_ts")]
    times = F.array(F.struct("ts_ns", "event_type"), F.when(left, F.struct(F.col("expired_ts").alias("ts_ns"), F.lit(EXPIRED).alias("event_type"))))
    rows = matched.select(*plain, F.explode(F.filter(times, lambda x: x.isNotNull())).alias("at"))
    rows = rows.select(*plain, "at.ts_ns", "at.event_type")
    own = F.col("event_type") != EXPIRED
    return rows.select(*[F.col(c) if c in kept else F.when(own, F.col(c)).alias(c) for c in rows.columns])


def expired_flows(tcp: DataFrame, max_age_s: int) -> DataFrame:
    """F8: the flows that leave, with their start and when they do."""
    left = match_flows(tcp, max_age_s).where("expired_ts is not null")
    return left.select(*TUPLE, "protocol", F.col("ts_ns").alias("start_ts"), "expired_ts")


def open_connections(tcp: DataFrame) -> DataFrame:
    """G-A7, K2, J2: keys whose last START or END is a START, with the retransmissions since."""
    marked = tcp.where(F.col("event_type").isin(START, END, RETRANS))
    order = F.struct("ts_ns", "seq")
    last = F.max(F.when(F.col("event_type") != RETRANS, F.struct("ts_ns", "seq", "event_type")))
    re = F.max(F.when(F.col("event_type") == RETRANS, F.struct(order.alias("at"), "retrans_count", "retrans_bytes")))
    keys = marked.groupBy(*TUPLE, "protocol").agg(last.alias("last"), re.alias("re")).where(F.col("last.event_type") == START)
    since = F.col("re.at") > F.struct(F.col("last.ts_ns").alias("ts_ns"), F.col("last.seq").alias("seq"))
    return keys.select(
        *TUPLE,
        "protocol",
        F.col("last.ts_ns").alias("start_ts"),
        F.when(since, F.col("re.retrans_count")).otherwise(0).alias("retrans_count"),
        F.when(since, F.col("re.retrans_bytes")).otherwise(0).alias("retrans_bytes"),
    )


def hook_lifetimes(hooks: DataFrame, slice_s: int | None = None) -> DataFrame:
    """Life numbers the connects of a socket; rows before the first and after a CLOSE are dropped."""
    connect, close = is_hook("tcp_connect"), is_hook("tcp_set_state", CLOSE)
    runs = {"life": Run("sum", connect.cast("int")), "mark": Run("last", F.when(connect, START).when(close, END), own=False)}
    out = running(hooks, ["sock"], HOOK_ORDER, runs, slice_s)
    return out.where((F.col("life") > 0) & (connect | (F.col("mark") == START))).drop("mark")


def lives_of(hooks: DataFrame, order: list[str]) -> DataFrame:
    """hook_lifetimes by an order of its own, with later: not null where the socket connects again after the row."""
    connect, close = is_hook("tcp_connect"), is_hook("tcp_set_state", CLOSE)
    runs = {"life": Run("sum", connect.cast("int")), "mark": Run("last", F.when(connect, START).when(close, END), own=False), "later": Run("next", F.when(connect, True), own=False)}
    return running(hooks, ["sock"], order, runs).where((F.col("life") > 0) & (connect | (F.col("mark") == START))).drop("mark")


def round_trips(lives: DataFrame, slice_s: int | None = None) -> DataFrame:
    """rtt_us of an ack that directly follows a send, among sends and acks of a life."""
    talk = F.when(F.col("hook").isin("tcp_sendmsg", "tcp_ack"), F.struct("hook", "ts_ns"))
    out = running(lives, ["sock", "life"], HOOK_ORDER, {"sent": Run("last", talk, own=False)}, slice_s)
    paired = (F.col("hook") == "tcp_ack") & (F.col("sent.hook") == "tcp_sendmsg")
    return out.withColumn("rtt_us", F.when(paired, F.expr("(ts_ns - sent.ts_ns) div 1000"))).drop("sent")


def is_hook(name: str, state: int | None = None):
    hit = F.col("hook") == name
    return hit if state is None else hit & (F.col("arg") == state)


def reconstruct_flows(hooks: DataFrame, slice_s: int | None = None) -> DataFrame:
    """G-A1: one row for each life of a socket: stamps, sums, round trips, last state."""
    rows = round_trips(hook_lifetimes(hooks, slice_s), slice_s)
    stamp = lambda hit: F.min(F.when(hit, F.col("ts_ns")))
    total = lambda name: F.sum(F.when(is_hook(name), F.col("arg")).otherwise(0))
    out = rows.groupBy("sock", "life").agg(
        stamp(is_hook("tcp_connect")).alias("syn_ts"),
        stamp(is_hook("tcp_synack")).alias("synack_ts"),
        stamp(is_hook("tcp_set_state", ESTABLISHED)).alias("established_ts"),
        stamp(is_hook("tcp_set_state", CLOSE)).alias("close_ts"),
        F.count_if(is_hook("tcp_sendmsg")).alias("packets_sent"),
        total("tcp_sendmsg").alias("bytes_sent"),
        F.count("rtt_us").alias("rtt_count"),
        F.coalesce(F.sum("rtt_us"), F.lit(0)).alias("rtt_sum"),
        F.max("rtt_us").alias("rtt_max"),
        F.min("rtt_us").alias("rtt_min"),
        F.count_if(is_hook("tcp_retransmit_skb")).alias("retrans_count"),
        total("tcp_retransmit_skb").alias("retrans_bytes"),
        F.count_if(is_hook("tcp_send_active_reset")).alias("rst_count"),
        F.max_by(F.when(is_hook("tcp_set_state"), F.col("arg")), F.when(is_hook("tcp_set_state"), F.col("ts_ns"))).alias("last_state"),
        F.max("ts_ns").alias("last_update"),
        *[F.min(F.when(is_hook("tcp_set_state", ESTABLISHED), F.col(c))).alias(c) for c in ("saddr", "sport")],
        *[F.min(c).alias(c) for c in ("daddr", "dport")],
    )
    return (
        out.withColumn("rtt_mean", F.expr("case when rtt_count > 0 then rtt_sum div rtt_count end"))
        .withColumn("syn_rtt", F.expr("(established_ts - syn_ts) div 1000"))
        .withColumn("syn_rtt_server", F.expr("case when established_ts is not null then (synack_ts - syn_ts) div 1000 end"))
        .withColumn("syn_rtt_client", F.expr("(established_ts - synack_ts) div 1000"))
        .withColumn("duration_us", F.expr("(close_ts - syn_ts) div 1000"))
    )


def both(kind: str, a: Column, b: Column) -> Column:
    """A sum, min or max of two, of which either may be null."""
    return {"sum": lambda: F.coalesce(a + b, a, b), "min": lambda: F.least(a, b), "max": lambda: F.greatest(a, b)}[kind]()


def life_rows_in_slices(hooks: DataFrame, runs: dict[str, Run], wanted: Column, slice_s: int) -> DataFrame:
    """The wanted rows of lives with runs (sum, min, max) over each life, as round_trips and running give them.

    Lives, round trips and runs are made within each slice of a socket, so its rows are exchanged once. A part begins at
    each connect; the rows before the first one (part 0) belong to a life that another slice began, if it is still open. The last row
    of each slice says what the slice leaves behind, and only that and the wanted rows of part 0 are exchanged again.
    """
    names, order = F.array(*map(F.lit, HOOKS)), ["ts_ns", "hook_no", "arg"]
    rows = hooks.withColumn(SLICE, F.expr(f"ts_ns div {slice_s}000000000")).withColumn("hook_no", F.array_position(names, F.col("hook")).cast("byte"))
    rows = rows.where("hook_no > 0").drop("hook").repartition("sock", SLICE).withColumn("hook", F.element_at(names, F.col("hook_no").cast("int")))

    def over(kind: str, value: Column, keys: list[str], by: list[str], own: bool = True) -> Column:
        reduce = {"sum": F.sum, "min": F.min, "max": F.max, "first": lambda v: F.first(v, ignorenulls=True), "last": lambda v: F.last(v, ignorenulls=True)}[kind]
        return reduce(value).over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0 if own else -1))

    connect, close, key = is_hook("tcp_connect"), is_hook("tcp_set_state", CLOSE), ["sock", SLICE]
    rows = rows.withColumn("part", over("sum", connect.cast("int"), key, order))
    rows = rows.withColumn("mark", over("last", F.when(connect, START).when(close, END), key, order, own=False))
    rows = rows.where(connect | F.coalesce(F.col("mark") == START, F.col("part") == 0)).drop("mark")
    # the trip of an ack that follows a send, where a part has both
    trip = lambda sent, at: F.when(F.col(f"{sent}.sent") & ~F.col(f"{at}.sent"), F.expr(f"({at}.ts_ns - {sent}.ts_ns) div 1000"))
    rows = rows.withColumn("talk", F.when(F.col("hook").isin("tcp_sendmsg", "tcp_ack"), F.struct((F.col("hook") == "tcp_sendmsg").alias("sent"), "ts_ns")))
    rows = rows.withColumn("before", over("last", F.col("talk"), [*key, "part"], order, own=False)).withColumn("rtt_us", trip("before", "talk"))
    rows = rows.select(
        "*",
        *[over(r.kind, r.value, [*key, "part"], order).alias(n) for n, r in runs.items()],
        over("first", F.col("talk"), [*key, "part"], order).alias("first_talk"),
        over("last", F.col("talk"), [*key, "part"], order).alias("last_talk"),
        F.lead(F.lit(True)).over(Window.partitionBy(*key).orderBy("part", *order)).alias("more"),
    )

    def with_trip(n: str, edge: str) -> Column:
        """A run with the trip that ends at the first ack of part 0 and began in another slice."""
        if n not in ("rtt_n", "rtt_sum", "rtt_high", "rtt_low"):
            return F.col(n)
        return both(runs[n].kind, F.col(n), F.when(F.col(edge).isNotNull(), 1).cast("long") if n == "rtt_n" else F.col(edge))

    # what each slice leaves behind, made cumulative along the lives of a socket
    left = rows.where("more is null").select(*key, "part", close.alias("ended"), "first_talk", "last_talk", *runs)
    left = left.withColumn("life", over("sum", (F.col("part") > 0).cast("int"), ["sock"], [SLICE]))
    life = ["sock", "life"]
    left = left.withColumn("before", over("last", F.col("last_talk"), life, [SLICE], own=False))
    left = left.withColumn("edge", F.when(F.col("part") == 0, trip("before", "first_talk")))
    left = left.select(
        *key,
        "life",
        ((F.col("life") > 0) & ~over("max", F.coalesce("ended", F.lit(False)), life, [SLICE])).alias("open"),
        over("last", F.col("last_talk"), life, [SLICE]).alias("talk_left"),
        *[over(r.kind, with_trip(n, "edge"), life, [SLICE]).alias(f"{n}_left") for n, r in runs.items()],
    )
    brought = ["open", "talk_left", *[f"{n}_left" for n in runs]]
    previous = Window.partitionBy("sock").orderBy("life", SLICE)
    left = left.select(*key, *[F.lag(c).over(previous).alias(c) for c in brought], F.lit(HEAD).alias(PLACE)).where("open")

    columns = [*hooks.columns, "rtt_us", *runs]
    heads = rows.where(wanted & (F.col("part") == 0)).select(*dict.fromkeys([*columns, SLICE, "first_talk"]), F.lit(ROW).alias(PLACE))
    heads = heads.unionByName(left, allowMissingColumns=True)
    heads = heads.select(*columns, PLACE, "first_talk", *[over("last", F.col(c), key, [PLACE]).alias(c) for c in brought]).where((F.col(PLACE) == ROW) & F.col("open"))
    heads = heads.withColumn("edge", trip("talk_left", "first_talk"))
    heads = heads.select(*hooks.columns, "rtt_us", *[both(r.kind, F.col(f"{n}_left"), with_trip(n, "edge")).alias(n) for n, r in runs.items()])
    return rows.where(wanted & (F.col("part") > 0)).select(*columns).unionByName(heads).drop("rtt_us")


def hook_events_to_tcp_events(hooks: DataFrame, slice_s: int | None = None) -> DataFrame:
    """G-A2, W3: START at the first ESTABLISHED, END at CLOSE, RETRANS and RST with the counts so far."""
    first = lambda hit, value="ts_ns": Run("min", F.when(hit, F.col(value)))
    retrans, reset, sent = is_hook("tcp_retransmit_skb"), is_hook("tcp_send_active_reset"), is_hook("tcp_sendmsg")
    up = is_hook("tcp_set_state", ESTABLISHED)
    so_far = {
        "syn_ts": first(is_hook("tcp_connect")),
        "synack_ts": first(is_hook("tcp_synack")),
        "established_ts": first(up),
        "ups": Run("sum", up.cast("int")),
        "local_addr": first(up, "saddr"),
        "local_port": first(up, "sport"),
        "retrans_count": Run("sum", retrans.cast("long")),
        "retrans_bytes": Run("sum", F.when(retrans, F.col("arg")).otherwise(0)),
        "rst_count": Run("sum", reset.cast("int")),
        "packets_sent": Run("sum", sent.cast("long")),
        "bytes_sent": Run("sum", F.when(sent, F.col("arg")).otherwise(0)),
        "rtt_n": Run("sum", F.col("rtt_us").isNotNull().cast("long")),
        "rtt_sum": Run("sum", F.col("rtt_us")),
        "rtt_high": Run("max", F.col("rtt_us")),
        "rtt_low": Run("min", F.col("rtt_us")),
    }
    if slice_s:
        rows = life_rows_in_slices(hooks, so_far, up | is_hook("tcp_set_state", CLOSE) | retrans | reset, slice_s)
    else:
        rows = running(round_trips(hook_lifetimes(hooks)), ["sock", "life"], HOOK_ORDER, so_far)
    kind = (
        F.when(up & (F.col("ups") == 1), START).when(is_hook("tcp_set_state", CLOSE), END).when(retrans, RETRANS).when(reset, RESET)
    )
    end, timed = F.col("event_type") == END, F.col("event_type").isin(START, END)
    at_end = lambda value: F.when(end, F.coalesce(F.expr(value), F.lit(0))).otherwise(0)
    hand = lambda a, b: F.when(timed, F.coalesce(F.expr(f"case when established_ts is not null then ({b} - {a}) div 1000 end"), F.lit(0))).otherwise(0)
    return (
        rows.withColumn("event_type", kind)
        .where("event_type is not null")
        .select(
            "sock",
            "ts_ns",
            "event_type",
            F.coalesce("local_addr", F.lit(0)).alias("saddr"),
            "daddr",
            F.coalesce("local_port", "sport").alias("sport"),
            "dport",
            hand("syn_ts", "established_ts").alias("syn_rtt"),
            hand("synack_ts", "established_ts").alias("syn_rtt_client"),
            hand("syn_ts", "synack_ts").alias("syn_rtt_server"),
            at_end("case when rtt_n > 0 then rtt_sum div rtt_n end").alias("rtt_mean"),
            at_end("rtt_high").alias("rtt_max"),
            at_end("rtt_low").alias("rtt_min"),
            "retrans_count",
            "retrans_bytes",
            at_end("bytes_sent").alias("bytes_sent"),
            at_end("packets_sent").alias("packets_sent"),
            "rst_count",
            at_end("(ts_ns - syn_ts) div 1000").alias("duration_us"),
        )
    )


def hook_stats(hooks: DataFrame) -> DataFrame:
    """G-A3: connections in all, those not closed, retransmissions, resets."""
    lives = hook_lifetimes(hooks)
    connects, closes = F.count_if(is_hook("tcp_connect")), F.count_if(is_hook("tcp_set_state", CLOSE))
    return lives.agg(
        connects.alias("total"),
        (connects - closes).alias("active"),
        F.count_if(is_hook("tcp_retransmit_skb")).alias("retrans"),
        F.count_if(is_hook("tcp_send_active_reset")).alias("rst"),
    )


def pair_udp_receives(calls: DataFrame, slice_s: int | None = None) -> DataFrame:
    """An exit with bytes pairs with the entry directly before it; failed exits do not count."""
    rows = calls.where("kind = 'entry' or ret > 0")
    opened = Run("last", F.struct("kind", "sock"), own=False)
    paired = running(rows, ["pid_tgid"], ["ts_ns", "sock", "kind"], {"opened": opened}, slice_s)
    return paired.where("kind = 'exit' and opened.kind = 'entry'").select("pid_tgid", "ts_ns", "ret", F.col("opened.sock").alias("sock"))
