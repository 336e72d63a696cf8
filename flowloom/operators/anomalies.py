"""Anomaly counters from packets (X1 to X6): our definitions of families that have no other producer.

They are counts, or (anomaly_events) rows beside the flow events, so that the aggregate of all families counts them
too and they are samples like the others. client_syn_repeat has a producer among the flow events and is a count only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.scalars import bidirectional_key

FIN, SYN, RST, ACK = 1, 2, 4, 16
#: (family, event type, mark): event types of our own, which no recorded event has.
EVENTS = (
    ("client_establish_fail_total", 11, "establish_fail"),
    ("server_syn_miss_total", 12, "syn_miss"),
    ("client_port_reuse_total", 13, "port_reuse"),
    ("client_half_close_lack_total", 14, "not by_client"),
    ("server_half_close_lack_total", 15, "by_client"),
)
COUNTERS = tuple((name, f"event_type = {code}", "1") for name, code, _ in EVENTS)
#: X1 as gauges that a tick sets.
RATES = (("new_flows_per_second", "case when event_type = 1 then 1 else 0 end"), ("closed_flows_per_second", "case when event_type = 2 then 1 else 0 end"))


def has(mask: int):
    return F.col("tcp_flags").bitwiseAND(mask) != 0


def marked_packets(packets: DataFrame, reuse_s: int = 60) -> DataFrame:
    """Packets with syn_repeat, syn_miss, establish_fail and port_reuse marks; one exchange by flow."""
    rows = packets.where("protocol = 6").withColumn("flow", bidirectional_key("saddr", "sport", "daddr", "dport"))
    syn, synack = has(SYN) & ~has(ACK), has(SYN) & has(ACK)
    flow = Window.partitionBy("flow").orderBy("ts_ns", "tcp_flags", "saddr", "sport")
    before = flow.rowsBetween(Window.unboundedPreceding, -1)
    seen_syn = F.coalesce(F.sum(syn.cast("int")).over(before), F.lit(0))
    last_end = F.max(F.when(has(FIN) | has(RST), F.col("ts_ns"))).over(before)
    reuse = syn & (F.col("ts_ns") - last_end <= reuse_s * 1_000_000_000)
    following = F.lead(F.struct("tcp_flags", "saddr")).over(flow)
    refused = syn & (following["tcp_flags"].bitwiseAND(RST) != 0) & (following["saddr"] != F.col("saddr"))
    return rows.select(
        "*",
        F.coalesce(reuse, F.lit(False)).alias("port_reuse"),
        (syn & (seen_syn > 0) & last_end.isNull()).alias("syn_repeat"),
        (synack & (seen_syn == 0)).alias("syn_miss"),
        F.coalesce(refused, F.lit(False)).alias("establish_fail"),
    )


def anomaly_counts(packets: DataFrame, reuse_s: int = 60) -> DataFrame:
    """X2, X3, X4, X6 in one row."""
    return marked_packets(packets, reuse_s).agg(
        F.count_if("establish_fail").alias("client_establish_fail"),
        F.count_if("syn_miss").alias("server_syn_miss"),
        F.count_if("port_reuse").alias("client_port_reuse"),
        F.count_if("syn_repeat").alias("client_syn_repeat"),
    )


def half_closed(packets: DataFrame) -> DataFrame:
    """Flows with a FIN of one side only, with the time of their last packet and whether the FIN is the client's.

    The client is the side of the first SYN, or else of the first packet.
    """
    rows = packets.where("protocol = 6").withColumn("flow", bidirectional_key("saddr", "sport", "daddr", "dport"))
    low = F.col("saddr").eqNullSafe(F.col("flow.low.ip")) & F.col("sport").eqNullSafe(F.col("flow.low.port"))
    # the side and what it sent are flags: sets of sides would be objects, one for each flow
    first = F.min_by(low, F.struct((~(has(SYN) & ~has(ACK))).alias("late"), "ts_ns", "tcp_flags", "saddr", "sport"))
    ended = lambda side: F.coalesce(F.max(has(FIN) & side), F.lit(False))
    g = rows.groupBy("flow").agg(first.alias("client_low"), ended(low).alias("low_end"), ended(~low).alias("high_end"), F.max("ts_ns").alias("ts_ns"))
    return g.where(F.col("low_end") != F.col("high_end")).select("flow", "ts_ns", (F.col("client_low") == F.col("low_end")).alias("by_client"))


def half_close_lack(packets: DataFrame) -> DataFrame:
    """How many closed by one side only; the other side is the one that lacks a close."""
    return half_closed(packets).agg(F.count_if(~F.col("by_client")).alias("client_half_close_lack"), F.count_if("by_client").alias("server_half_close_lack"))


def anomaly_events(packets: DataFrame, reuse_s: int = 60) -> DataFrame:
    """ts_ns, event_type of each anomaly: at its packet, or at the last packet of a flow that is half closed."""
    codes = lambda part: F.array_compact(F.array(*[F.when(F.expr(mark), code) for _, code, mark in part]))
    by_packet = marked_packets(packets, reuse_s).select("ts_ns", F.explode(codes(EVENTS[:3])).alias("event_type"))
    return by_packet.unionByName(half_closed(packets).select("ts_ns", F.explode(codes(EVENTS[3:])).alias("event_type")))


def flow_rates(tcp: DataFrame, seconds: int = 60) -> DataFrame:
    """STARTs and ENDs per second of each window."""
    at = F.expr(f"ts_ns div {seconds}000000000")
    g = tcp.groupBy(at.alias("w")).agg(F.count_if(F.col("event_type") == 1).alias("n"), F.count_if(F.col("event_type") == 2).alias("c"))
    return g.select((F.col("w") * seconds).alias("window_start_s"), (F.col("n") / seconds).alias("new_flows_per_second"), (F.col("c") / seconds).alias("closed_flows_per_second"))
