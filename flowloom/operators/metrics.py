"""Metric families: counters, gauges and histograms as conditional aggregates, then as a long table of samples.

A family is a row of a table (name, condition, value), in expressions over matched events. All families of a
protocol come from one hash aggregate per slot of time; the slots (time, not events) are then made cumulative.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import scalars as S
from flowloom.operators import anomalies as A
from flowloom.operators.scans import Run, running

#: Upper bounds of the histogram buckets in microseconds.
BOUNDS = (100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000, 200000, 500000, 1000000, 5000000, 10000000)
END = "event_type = 2"
#: (family, condition, value): what an event adds.
TCP_COUNTERS = (
    ("bytes_sent_total", END, "bytes_sent"),
    ("bytes_received_total", END, "bytes_received"),
    ("packets_sent_total", END, "packets_sent"),
    ("packets_received_total", END, "packets_received"),
    ("new_flows_total", "event_type = 1", "1"),
    ("closed_flows_total", END, "1"),
    ("retrans_packets_total", "event_type in (2, 3)", "case when event_type = 3 then 1 else retrans_count end"),
    ("retrans_bytes_total", f"{END} and retrans_count > 0", "retrans_bytes"),
    ("zero_window_events_total", f"{END} and zero_wnd_count > 0", "zero_wnd_count"),
    ("zero_window_duration_microseconds_total", f"{END} and matched and zero_wnd_count > 0", "zero_wnd_duration"),
    ("client_syn_repeat_total", f"{END} and matched and direction = 1", "syn_retrans"),
    ("server_syn_repeat_total", f"{END} and matched and direction <> 1", "syn_retrans"),
    ("server_reset_total", f"event_type = 5 or ({END} and matched)", "case when event_type = 5 then 1 else rst_count end"),
)
#: The variants without double counting.
TCP_DEDUP = (("retrans_packets_dedup", "event_type = 3", "1"), ("server_reset_dedup", "event_type = 5", "1"))
#: A gauge that adds up like a counter; 6 is a flow that leaves for its age.
ACTIVE = ("active_flows", f"event_type in (1, 6) or ({END} and matched)", "case when event_type = 1 then 1 else -1 end")
#: (family, condition, value): the value of the last event in the condition.
TCP_LAST = (
    ("rtt_max_microseconds", f"{END} and rtt_mean > 0", "rtt_max"),
    ("rtt_min_microseconds", f"{END} and rtt_mean > 0", "rtt_min"),
    ("srt_max_microseconds", f"{END} and matched and srt_mean > 0", "srt_max"),
    ("retrans_ratio", f"{END} and matched and retrans_count > 0", "retrans_ratio"),
)
#: (family, condition, value): observations of a histogram.
TCP_HISTOGRAMS = (
    ("syn_rtt_microseconds", f"{END} and syn_rtt > 0", "syn_rtt"),
    ("syn_rtt_client_microseconds", f"{END} and syn_rtt > 0", "syn_rtt_client"),
    ("syn_rtt_server_microseconds", f"{END} and syn_rtt > 0", "syn_rtt_server"),
    ("rtt_microseconds", f"{END} and rtt_mean > 0", "rtt_mean"),
    ("srt_microseconds", f"{END} and matched and srt_mean > 0", "srt_mean"),
)
UDP_COUNTERS = (
    ("bytes_sent_total", "direction = 1", "packet_size"),
    ("bytes_received_total", "direction <> 1", "packet_size"),
    ("packets_sent_total", "direction = 1", "1"),
    ("packets_received_total", "direction <> 1", "1"),
)
#: Families that are declared but have no producer: they stay 0.
UNFED = (
    "client_establish_fail_total client_establish_other_total server_syn_miss_total server_establish_fail_total server_establish_other_total "
    "server_queue_overflow_total client_port_reuse_total timeout_total client_half_close_lack_total server_half_close_lack_total "
    "requests_per_second responses_per_second new_flows_per_second closed_flows_per_second"
).split()
UNFED_HISTOGRAMS = ("client_wait_microseconds", "server_wait_microseconds")
#: (family, value): gauges that a tick sets to what was added a second since the tick before, and that hold until the next.
UDP_RATES = (("bytes_per_second", "packet_size"), ("packets_per_second", "1"))
TCP_UNFED = [*UNFED, *(name for name, _ in UDP_RATES)]
UDP_UNFED = sorted({*UNFED, *(f[0] for f in (*TCP_COUNTERS, ACTIVE, *TCP_LAST))} - {f[0] for f in UDP_COUNTERS})
UDP_UNFED_HISTOGRAMS = (*(f[0] for f in TCP_HISTOGRAMS), *UNFED_HISTOGRAMS)
SCRAPE_S, TICK_S, DAY_S = 15, 60, 86400


class Families(NamedTuple):
    """The families of a protocol, by how they are computed; rates also are counters of a slot."""

    protocol: str
    counters: tuple = ()
    last_values: tuple = ()
    histograms: tuple = ()
    rates: tuple = ()
    states: bool = False
    unfed: tuple = ()
    unfed_histograms: tuple = ()

    def only(self, names) -> Families:
        """Those that the samples' names need."""
        short = {n.removeprefix(f"network_{self.protocol}_") for n in names}
        plain = lambda families: tuple(f for f in families if f[0] in short)
        parts = lambda name: any(f"{name}_{x}" in short for x in ("bucket", "sum", "count"))
        return Families(
            self.protocol,
            plain(self.counters),
            plain(self.last_values),
            tuple(f for f in self.histograms if parts(f[0])),
            plain(self.rates),
            self.states and "connections_by_state" in short,
            tuple(n for n in self.unfed if n in short),
            tuple(n for n in self.unfed_histograms if parts(n)),
        )

    def conditions(self) -> list[str]:
        """The events that say anything; all if a rate is among the families."""
        fed = [f[1] for f in (*self.counters, *self.last_values, *self.histograms)]
        return [*fed, *(["true"] if self.rates else []), *([END] if self.states else [])]


#: What the flow events and the datagrams alone give.
TCP_FAMILIES = Families("tcp", (*TCP_COUNTERS, ACTIVE), TCP_LAST, TCP_HISTOGRAMS, states=True, unfed=tuple(TCP_UNFED), unfed_histograms=UNFED_HISTOGRAMS)
UDP_FAMILIES = Families("udp", UDP_COUNTERS, rates=UDP_RATES, unfed=tuple(UDP_UNFED), unfed_histograms=UDP_UNFED_HISTOGRAMS)


def added(family: tuple[str, str, str]) -> Column:
    name, where, value = family
    return F.coalesce(F.sum(F.expr(f"case when {where} then cast({value} as bigint) else 0 end")), F.lit(0)).cast("long").alias(name)


def last(family: tuple[str, str, str]) -> Column:
    name, where, value = family
    return F.max_by(F.expr(f"case when {where} then cast({value} as double) end"), F.expr(f"case when {where} then struct(ts_ns, seq, sock_order) end")).alias(name)


def totals(df: DataFrame, families, by: list[str] | None = None) -> DataFrame:
    """G-A4 to G-A12, G-A16: one wide aggregate of all families."""
    return df.groupBy(*(by or [])).agg(*[added(f) for f in families])


def tcp_metrics(matched: DataFrame, by: list[str] | None = None, dedup: bool = False, registry: Registry | None = None) -> DataFrame:
    """G-A4 to G-A12, G-A15: counters, the active gauge and last values. Ties of time and seq go to the larger five-tuple.

    A registry adds its counters and gauges without labels.
    """
    rows = matched.withColumn("sock_order", F.struct("saddr", "daddr", "sport", "dport"))
    more = registry or Registry()
    counters = (*TCP_COUNTERS, ACTIVE, *(TCP_DEDUP if dedup else ()), *more.plain("counter"))
    return rows.groupBy(*(by or [])).agg(*[added(f) for f in counters], *[last(f) for f in (*TCP_LAST, *more.plain("gauge"))])


def true_extremes(matched: DataFrame) -> DataFrame:
    """Q3: the extremes over all closed flows, which the last-value gauges are not."""
    return matched.where(f"{END} and rtt_mean > 0").agg(F.max("rtt_max").alias("rtt_max_true"), F.min("rtt_min").alias("rtt_min_true"))


def closing_states(matched: DataFrame) -> DataFrame:
    """G-A13"""
    return matched.where(END).groupBy(S.tcp_state_name("tcp_state").alias("state")).agg(F.count(F.lit(1)).alias("connections"))


def udp_metrics(udp: DataFrame, by: list[str] | None = None) -> DataFrame:
    return totals(udp, UDP_COUNTERS, by)


def histogram(df: DataFrame, value: str, bounds=BOUNDS, by: list[str] | None = None, where: str = "true") -> DataFrame:
    """G-A14: by, le, cumulative count; one aggregate with a conditional count for each bound, then rows."""
    by = by or []
    counts = [F.count_if(F.expr(f"({where}) and {value} <= {b}")).alias(f"b{k}") for k, b in enumerate(bounds)]
    wide = df.groupBy(*by).agg(*counts, F.count_if(F.expr(where)).alias("total"), F.sum(F.expr(f"case when {where} then {value} else 0 end")).alias("total_sum"))
    cells = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("c")) for k, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("c")))
    return wide.select(*by, F.col("total_sum").alias("value_sum"), F.inline(cells)).select(*by, "le", F.col("c").alias("cumulative"), "value_sum")


def udp_flows(udp: DataFrame) -> DataFrame:
    """G-A17, J8: both directions of a local to remote key, with its process."""
    sent = F.col("direction") == 1
    return udp.groupBy("saddr", "daddr", "sport", "dport", "pid").agg(
        F.sum(F.when(sent, F.col("packet_size")).otherwise(0)).alias("bytes_sent"),
        F.sum(F.when(~sent, F.col("packet_size")).otherwise(0)).alias("bytes_received"),
        F.count_if(sent).alias("packets_sent"),
        F.count_if(~sent).alias("packets_received"),
        F.min("ts_ns").alias("first_ts"),
        F.max("ts_ns").alias("last_ts"),
    )


def udp_running_totals(udp: DataFrame, slice_s: int | None = None) -> DataFrame:
    """total_bytes of the flow up to and with each packet; packets of one stamp by direction and size. slice_s: see scans."""
    if "total_bytes" in udp.columns:
        udp = udp.drop("total_bytes")
    return running(udp, ["saddr", "daddr", "sport", "dport", "pid"], ["ts_ns", "direction", "packet_size"], {"total_bytes": Run("sum", F.col("packet_size"))}, slice_s)


def udp_sessions(udp: DataFrame, gap: str = "30 seconds") -> DataFrame:
    """Conversations of a flow that end after a gap."""
    timed = udp.withColumn("ts", S.event_time("ts_ns"))
    return timed.groupBy("saddr", "daddr", "sport", "dport", "pid", F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("packets"), F.sum("packet_size").alias("bytes"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts")
    ).drop("s")


def named_interfaces(tc: DataFrame, interfaces: DataFrame) -> DataFrame:
    """The interface's name, or if<n>; the host's interfaces are a handful of rows."""
    return tc.join(F.broadcast(interfaces), "ifindex", "left").withColumn("if_name", S.if_name("ifindex", "if_name"))


def tc_metrics(tc: DataFrame, interfaces: DataFrame) -> DataFrame:
    """G-A18"""
    rows = named_interfaces(tc, interfaces)
    keys = [S.protocol_name("protocol").alias("protocol"), S.direction_name("direction").alias("direction"), F.col("if_name").alias("interface")]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_len").alias("bytes"))


def tc_both_levels(tc: DataFrame) -> DataFrame:
    """G-A18 and G-A19 in one pass: by interface, and over all interfaces (ifindex null)."""
    sets = [["protocol", "direction", "ifindex"], ["protocol", "direction"]]
    return tc.groupingSets(sets, "protocol", "direction", "ifindex").agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_len").alias("bytes"))


def tcp_flag_counts(tc: DataFrame) -> DataFrame:
    """G-A20, F6"""
    flagged = tc.where("protocol = 6 and tcp_flags <> 0").select(F.explode(S.tcp_flag_names("tcp_flags")).alias("flag"), S.direction_name("direction").alias("direction"))
    return flagged.groupBy("flag", "direction").agg(F.count(F.lit(1)).alias("packets"))


def windowed_rate(df: DataFrame, value: str, seconds: int) -> DataFrame:
    """Sums in tumbling windows of event time, divided by their length."""
    at = F.expr(f"ts_ns div {seconds}000000000")
    sums = df.groupBy(at.alias("w")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("events"))
    return sums.select((F.col("w") * seconds).alias("window_start_s"), (F.col("total") / seconds).alias("per_second"), (F.col("events") / seconds).alias("events_per_second"))


class Registry:
    """Families a user adds; tcp_metrics and tcp_samples compute them with their own.

    register_metric names a family by the events it counts (where) and what they add or set (value), both expressions
    over matched events. kind: counter (a sum), gauge (the last value) or histogram. A counter may have labels, from
    names to expressions; it then has a series for each set of labels, from its first event on.
    """

    def __init__(self):
        self.families = []

    def register_metric(self, name: str, where: str, value: str, kind: str = "counter", labels: dict[str, str] | None = None) -> None:
        if kind not in ("counter", "gauge", "histogram") or (labels and kind != "counter"):
            raise ValueError(f"no family of kind {kind}" + (" with labels" if labels else ""))
        if name in {f[0] for f in self.families}:
            raise ValueError(f"{name} is registered")
        self.families.append((name, where, value, kind, labels))

    def plain(self, kind: str) -> tuple:
        return tuple(f[:3] for f in self.families if f[3] == kind and not f[4])

    def labelled(self) -> tuple:
        return tuple(f for f in self.families if f[4])


def slot_of(step: int = SCRAPE_S) -> Column:
    """The scrape that sees an event first: at the next multiple of step, or at the event itself."""
    return F.when(F.col("ts_ns") % (step * 1_000_000_000) == 0, F.expr("ts_ns div 1000000000")).otherwise(F.expr(f"(ts_ns div {step}000000000 + 1) * {step}"))


def densified(sums: DataFrame, until: DataFrame, step: int = SCRAPE_S, days: int | None = None) -> DataFrame:
    """name, labels, ts_s, value from what labelled series add (name, labels, slot, d): totals on every slot from the first.

    A series' rows reach to its next one, so nothing is joined but the last slot (until, one row). days, if known, is the
    number of tasks for series in slices of a day; sums are read twice then.
    """
    rows = sums.withColumn("series", F.to_json(F.array_sort(F.map_entries("labels")))).withColumn("ts_ns", F.col("slot") * 1_000_000_000)
    runs = {"value": Run("sum", F.col("d")), "next": Run("next", F.col("slot"), own=False)}
    rows = running(rows, ["name", "series"], ["ts_ns"], runs, DAY_S if days else None, days)
    rows = rows.join(F.broadcast(until))
    slots = F.sequence("slot", F.coalesce(F.col("next") - step, F.col("until")), F.lit(step).cast("long"))
    return rows.select("name", "labels", F.explode(slots).alias("ts_s"), F.col("value").cast("double").alias("value"))


def tc_samples(tc: DataFrame, interfaces: DataFrame, step: int = SCRAPE_S) -> DataFrame:
    """G-A23: packets and bytes by protocol, direction and interface, and TCP flags by direction, on a grid."""
    rows = tc.withColumn("slot", slot_of(step))
    flags = F.when((F.col("protocol") == 6) & (F.col("tcp_flags") != 0), F.col("tcp_flags")).otherwise(0)
    sums = rows.groupBy("slot", "protocol", "direction", "ifindex", flags.alias("flags")).agg(F.count(F.lit(1)).alias("packets"), F.sum("packet_len").alias("bytes"))
    pair = lambda name, value: F.create_map(F.lit(name), value)
    way = pair("direction", S.direction_name("direction"))
    where = F.map_concat(pair("protocol", S.protocol_name("protocol")), way, pair("ifindex", F.col("if_name")))
    cell = lambda name, labels, value: F.struct(F.lit(f"network_tc_{name}").alias("name"), labels.alias("labels"), value.alias("d"))
    cells = F.array(cell("packets_total", where, F.col("packets")), cell("bytes_total", where, F.col("bytes")))
    flagged = F.transform(S.tcp_flag_names("flags"), lambda f: cell("tcp_flags_total", F.map_concat(pair("flag", f), way), F.col("packets")))
    named = named_interfaces(sums, interfaces).select("slot", F.inline(F.concat(cells, flagged)))
    series = F.to_json(F.array_sort(F.map_entries("labels")))
    added_up = named.groupBy("name", series.alias("series"), "slot").agg(F.any_value("labels").alias("labels"), F.sum("d").cast("double").alias("d")).drop("series")
    return densified(added_up, rows.agg(F.max("slot").alias("until")), step)


def labelled_sums(events: DataFrame, protocol: str, families, step: int = SCRAPE_S) -> DataFrame:
    """What labelled families add: name, labels, slot, d, from one aggregate over all of them."""
    cells = [
        F.when(F.expr(where), F.struct(F.lit(f"network_{protocol}_{name}").alias("name"), F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.coalesce(F.expr(v).cast("string"), F.lit("")))]).alias("labels"), F.expr(f"cast({value} as double)").alias("d")))
        for name, where, value, _, labels in families
    ]
    rows = events.select(slot_of(step).alias("slot"), F.inline(F.array_compact(F.array(*cells))))
    series = F.to_json(F.array_sort(F.map_entries("labels")))
    return rows.groupBy("name", series.alias("series"), "slot").agg(F.any_value("labels").alias("labels"), F.sum("d").alias("d")).drop("series")


def histogram_sums(histograms) -> list[Column]:
    aggs = []
    for name, where, value in histograms:
        aggs += [F.count_if(F.expr(f"({where}) and {value} <= {b}")).cast("long").alias(f"{name}_bucket|{b}") for b in BOUNDS]
        aggs += [F.count_if(F.expr(where)).cast("long").alias(f"{name}_bucket|+Inf"), added((f"{name}_sum", where, value)), F.count_if(F.expr(where)).cast("long").alias(f"{name}_count")]
    return aggs


def slot_sums(events: DataFrame, counters=(*TCP_COUNTERS, ACTIVE), last_values=TCP_LAST, histograms=TCP_HISTOGRAMS, rates=(), states: bool = True, step: int = SCRAPE_S, parts: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """What each slot adds to every family, one row a slot; and connections that closed, by slot and state (slot, state, d).

    parts, if given, is the number of tasks that slots are dealt over before they are added up: where every task has
    events of every slot, sums of its own would be wider than its events, and no fewer.
    """
    rows = events.withColumn("slot", slot_of(step))
    if parts:
        rows = rows.repartition(parts, "slot")
    if "saddr" in events.columns:
        rows = rows.withColumn("sock_order", F.struct("saddr", "daddr", "sport", "dport"))
    aggs = [added(f) for f in counters] + [last(f) for f in last_values] + [added((name, "true", value)) for name, value in rates] + histogram_sums(histograms)
    by_state = None
    if states:
        by_state = rows.where(END).groupBy("slot", S.tcp_state_name("tcp_state").alias("state")).agg(F.count(F.lit(1)).cast("double").alias("d"))
    return (rows.groupBy("slot").agg(*aggs) if aggs else rows.select("slot").distinct()), by_state


def history_of(wide: DataFrame, by_state: DataFrame | None, grid: DataFrame, protocol: str = "tcp", last_values=TCP_LAST, rates=(), unfed=TCP_UNFED, unfed_histograms=UNFED_HISTOGRAMS, step: int = SCRAPE_S, days: int | None = None) -> DataFrame:
    """name, labels, ts_s, value of every family on the slots of grid, from the sums of slots.

    Totals run over wide rows, one a slot, in slices of a day (scans); only then a slot becomes a row for each series, in
    the task that has its day. days, if known, is the number of tasks for that: rows of a slot compress to almost
    nothing, so their size on the way says little about the work they make.
    """
    prefix, none = f"network_{protocol}_", F.expr("cast(map() as map<string,string>)")
    cell = lambda name, labels, value: F.struct(F.lit(prefix + name).alias("name"), labels.alias("labels"), F.coalesce(value, F.lit(0.0)).alias("value"))
    cells, until = [], grid.agg(F.max("slot").alias("until"))
    if rates:
        # the tick at or before a slot has what lies in the TICK_S before it
        ticks = wide.groupBy(F.expr(f"(slot + {TICK_S - 1}) div {TICK_S} * {TICK_S}").alias("tick")).agg(*[(F.sum(n) / TICK_S).alias(f"rate_{n}") for n, _ in rates])
        grid = grid.withColumn("tick", F.expr(f"slot div {TICK_S} * {TICK_S}")).join(ticks, "tick", "left").drop("tick")
        cells += [cell(n, none, F.col(f"rate_{n}")) for n, _ in rates]
    full = (grid.join(wide, "slot", "left") if len(wide.columns) > 1 else grid).withColumn("ts_ns", F.col("slot") * 1_000_000_000)
    lasts = {f[0] for f in last_values}
    series = [c for c in wide.columns if c != "slot" and c not in {n for n, _ in rates}]
    runs = {f"run{k}": Run("last" if c in lasts else "sum", F.col(f"`{c}`").cast("double")) for k, c in enumerate(series)}
    for k, c in enumerate(series):
        name, _, le = c.partition("|")
        cells.append(cell(name, F.create_map(F.lit("le"), F.lit(le)) if le else none, F.col(f"run{k}")))
    for n in unfed:
        cells.append(cell(n, none, F.lit(0.0)))
    for n in unfed_histograms:
        cells += [cell(f"{n}_bucket", F.create_map(F.lit("le"), F.lit(str(b))), F.lit(0.0)) for b in (*BOUNDS, "+Inf")]
        cells += [cell(f"{n}_{x}", none, F.lit(0.0)) for x in ("sum", "count")]
    kept = full.select("slot", "ts_ns", *[f"rate_{n}" for n, _ in rates], *[f"`{c}`" for c in series])
    totals_so_far = (running(kept, [], ["ts_ns"], runs, DAY_S, days) if runs else kept).drop("ts_ns", *series)
    out = totals_so_far.select(F.col("slot").alias("ts_s"), F.inline(F.array(*cells))).select("name", "labels", "ts_s", "value") if cells else None
    if by_state is not None:
        named = by_state.select(F.lit(prefix + "connections_by_state").alias("name"), F.create_map(F.lit("state"), "state").alias("labels"), "slot", "d")
        states = densified(named, until, step, days)
        out = out.unionByName(states) if cells else states
    return out


def samples(events: DataFrame, protocol: str, counters, gauges=(), last_values=(), histograms=(), states: bool = False, unfed=(), unfed_histograms=(), step: int = SCRAPE_S, store=None, rates=(), labelled=(), parts: int | None = None) -> DataFrame:
    """G-A23, T11: name, labels, ts_s, value of every family on a grid of step seconds.

    Unlabelled families have a row on each slot from the first, labelled ones from the slot of their first event.
    store, if given, writes a table and rereads it; it gets the sums by slot, which several parts of the result use.
    parts: see slot_sums.
    """
    wide, by_state = slot_sums(events, (*counters, *gauges), last_values, histograms, rates, states, step, parts)
    days = None
    if store:
        wide = store(wide.toDF(*[f"c{k}" for k in range(len(wide.columns))])).toDF(*wide.columns)
        by_state = store(by_state) if states else None
        days = wide.agg(F.expr(f"max(slot) div {DAY_S} - min(slot) div {DAY_S} + 1")).first()[0]
    grid = wide.agg(F.sequence(F.min("slot"), F.max("slot"), F.lit(step).cast("long")).alias("s")).select(F.explode("s").alias("slot"))
    out = history_of(wide, by_state, grid, protocol, last_values, rates, unfed, unfed_histograms, step, days)
    if labelled:
        out = out.unionByName(densified(labelled_sums(events, protocol, labelled, step), grid.agg(F.max("slot").alias("until")), step))
    return out


def family_sums(events: DataFrame, families: Families, parts: int | None = None, step: int = SCRAPE_S) -> DataFrame:
    """Sums by slot of few families: slot, a column for each of their series, and closed connections by state as an array.

    Events that add to none of them are left out before the exchange, as far as down to the scans of their sources.
    """
    f = families
    wanted = F.expr(" or ".join(f"({c})" for c in dict.fromkeys(f.conditions())) or "false")
    wide, by_state = slot_sums(events.where(wanted), f.counters, f.last_values, f.histograms, f.rates, f.states, step, parts)
    if by_state is None:
        return wide
    states = by_state.groupBy("slot").agg(F.collect_list(F.struct("state", "d")).alias("by_state"))
    return wide.join(states, "slot", "left")


def family_samples(sums: DataFrame, families: Families, names, span: tuple | None, step: int = SCRAPE_S) -> DataFrame:
    """G-A23 for the names alone, from family_sums: a branch for each name, which a condition on name leaves as the only one.

    span begins with the first and the last slot of all events of the protocol, so that every family is on the same grid.
    """
    spark, prefix = sums.sparkSession, f"network_{families.protocol}_"
    first, last_slot = span[:2] if span else (0, -step)
    days = last_slot // DAY_S - first // DAY_S + 1 if span else None
    grid = spark.range(first, last_slot + step, step).toDF("slot")
    out = []
    for name in names:
        f, short = families.only([name]), name.removeprefix(prefix)
        mine = [c for c in sums.columns if c.partition("|")[0] == short]
        states = None
        if f.states:
            states = sums.select("slot", F.inline(F.coalesce("by_state", F.expr("cast(array() as array<struct<state: string, d: double>>)"))))
        rows = history_of(sums.select("slot", *[F.col(f"`{c}`") for c in mine]), states, grid, f.protocol, f.last_values, f.rates, f.unfed, f.unfed_histograms, step, days)
        out.append(rows.where(F.col("name") == name).withColumn("name", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def tcp_samples(matched: DataFrame, store=None, packets: DataFrame | None = None, registry: Registry | None = None, parts: int | None = None) -> DataFrame:
    """All TCP families. With packets, the families that only packets can feed are fed (anomalies), and flow rates are set."""
    more, fed, rates = registry or Registry(), (), ()
    if packets is not None:
        found = A.anomaly_events(packets)
        # the windows over packets run once, for the sums and the states alike
        matched = matched.unionByName(store(found) if store else found, allowMissingColumns=True)
        fed, rates = A.COUNTERS, A.RATES
    unfed = [name for name in TCP_UNFED if name not in {f[0] for f in (*fed, *rates)}]
    counters, last_values, histograms = (*TCP_COUNTERS, *fed, *more.plain("counter")), (*TCP_LAST, *more.plain("gauge")), (*TCP_HISTOGRAMS, *more.plain("histogram"))
    return samples(matched, "tcp", counters, (ACTIVE,), last_values, histograms, True, unfed, UNFED_HISTOGRAMS, store=store, rates=rates, labelled=more.labelled(), parts=parts)


def udp_samples(udp: DataFrame, store=None, parts: int | None = None) -> DataFrame:
    return samples(udp, "udp", UDP_COUNTERS, unfed=UDP_UNFED, unfed_histograms=UDP_UNFED_HISTOGRAMS, rates=UDP_RATES, store=store, parts=parts)


def with_labels(rows: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Labels on every sample."""
    extra = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return rows.withColumn("labels", F.map_concat(F.map_filter("labels", lambda k, _: ~k.isin(list(labels))), extra))


def keep_names(rows: DataFrame, pattern: str) -> DataFrame:
    """names that the whole pattern matches."""
    return rows.where(F.col("name").rlike(f"^(?:{pattern})$"))


def latest(rows: DataFrame) -> DataFrame:
    """The last sample of each series: what a scrape sees now."""
    series = F.to_json(F.array_sort(F.map_entries("labels")))
    by = rows.withColumn("series", series).groupBy("name", "series")
    return by.agg(F.any_value("labels").alias("labels"), F.max("ts_s").alias("ts_s"), F.max_by("value", "ts_s").alias("value")).drop("series")


def exposition(rows: DataFrame) -> DataFrame:
    """A text line for each sample."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    value = F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string"))
    return rows.select("ts_s", F.concat("name", labels, F.lit(" "), value).alias("line"))
