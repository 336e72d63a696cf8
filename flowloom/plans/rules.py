"""Alert rules: an expression whose result, held for a time, fires."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.scalars import humanize, humanize_percentage
from flowloom.plans import vectors as V
from flowloom.plans.panels import evaluate, rate


@dataclass(frozen=True)
class Rule:
    name: str
    expression: tuple
    op: str
    threshold: float
    hold_s: int
    interval_s: int
    severity: str
    category: str
    template: str


def tcp(name):
    return rate(f"tcp_{name}_total", 300)


#: The rules. {h} is the value with an SI prefix, {p} in percent, {v} as it is.
RULES = {
    "a1": Rule("HighTCPRetransmissionRate", ("vector", "/", tcp("retrans_packets"), tcp("packets_sent")), ">", 0.05, 120, 30, "warning", "performance", "{p} of the TCP packets sent were sent again"),
    "a2": Rule("FrequentZeroWindowEvents", tcp("zero_window_events"), ">", 10, 120, 30, "warning", "performance", "{h} zero windows a second"),
    "a3": Rule("HighTCPLatency", ("quantile", 0.95, rate("tcp_rtt_microseconds_bucket", 300)), ">", 100000, 300, 30, "warning", "latency", "One round trip in twenty takes {h}µs or more"),
    "a4": Rule("HighConnectionFailureRate", tcp("client_establish_fail"), ">", 5, 120, 30, "critical", "connectivity", "{h} connections a second are not established"),
    "a5": Rule("FrequentTCPReset", tcp("server_reset"), ">", 20, 120, 30, "warning", "error", "{h} resets a second"),
    "a6": Rule("HighSYNRetransmissionRate", tcp("client_syn_repeat"), ">", 5, 120, 30, "warning", "connectivity", "{h} SYN packets a second are repeated"),
    "a7": Rule("ServerQueueOverflow", tcp("server_queue_overflow"), ">", 1, 60, 30, "critical", "capacity", "{h} connections a second find the accept queue full"),
    "a8": Rule("AgentDown", ("instant", "up"), "==", 0, 60, 60, "critical", "availability", "No sample from the agent for a minute"),
    "a9": Rule("TooManyActiveConnections", ("instant", "network_tcp_active_flows"), ">", 50000, 300, 60, "warning", "capacity", "{v} connections are open"),
}


def render(template: str, value: str = "value") -> Column:
    """P28"""
    forms = {"{h}": humanize(value), "{p}": humanize_percentage(value), "{v}": F.format_string("%.0f", F.col(value))}
    for mark, form in forms.items():
        if mark in template:
            before, after = template.split(mark)
            return F.concat(F.lit(before), form, F.lit(after))
    return F.lit(template)


def held(present: DataFrame, hold_s: int, interval_s: int, carried: DataFrame | None = None) -> DataFrame:
    """(labels, t, value) of true evaluations, with active_since and pending or firing; a gap starts anew.

    carried has (labels, t, active_since) of alerts that were active before; they are in the result with fresh false.
    """
    rows = present.select("labels", "t", "value", F.lit(None).cast("long").alias("active_since"), F.lit(True).alias("fresh"))
    if carried is not None:
        rows = rows.unionByName(carried.select("labels", "t", F.lit(None).cast("double").alias("value"), "active_since", F.lit(False).alias("fresh")))
    rows = rows.withColumn("series", V.key())
    order = Window.partitionBy("series").orderBy("t")
    rows = rows.withColumn("island", F.col("t") - F.row_number().over(order) * interval_s)
    since = F.min(F.coalesce("active_since", "t")).over(Window.partitionBy("series", "island"))
    rows = rows.withColumn("active_since", since)
    return rows.withColumn("state", F.when(F.col("t") - F.col("active_since") >= hold_s, "firing").otherwise("pending")).drop("series", "island")


def described(found: DataFrame, rule: Rule) -> DataFrame:
    return found.select(
        F.lit(rule.name).alias("alert"), "labels", "t", "value", "state", "active_since", F.lit(rule.severity).alias("severity"), render(rule.template).alias("description")
    )


def evaluate_rule(rule: Rule, samples: DataFrame, threshold: float | None = None, end_s: int | None = None, parts: int | None = None) -> DataFrame:
    """alert, labels, t, value, state, active_since, severity, description: evaluations at which the rule is not inactive."""
    vector = evaluate(samples, rule.expression, rule.interval_s, end_s, parts)
    return described(held(V.compare(vector, rule.op, rule.threshold if threshold is None else threshold), rule.hold_s, rule.interval_s), rule)


def liveness(samples: DataFrame, step_s: int = 15) -> DataFrame:
    """Samples of up for each instance: 1 in a slot that has a sample of it, 0 in those between, before and after.

    Slots without a sample are the gaps between an instance's samples, so nothing is joined but the first and last slot.
    """
    order = Window.partitionBy("instance").orderBy("ts_s")
    seen = samples.select(F.col("labels")["instance"].alias("instance"), "ts_s").distinct()
    bounds = samples.agg(F.min("ts_s").alias("first_s"), F.max("ts_s").alias("last_s"))
    rows = seen.withColumn("before", F.lag("ts_s").over(order)).withColumn("after", F.lead("ts_s").over(order)).join(F.broadcast(bounds))
    gap = lambda a, b: F.when(a <= b, F.sequence(a, b, F.lit(step_s).cast("long")))
    missed = F.concat(
        F.coalesce(F.when(F.col("before").isNull(), gap(F.col("first_s"), F.col("ts_s") - step_s)), F.array().cast("array<bigint>")),
        F.coalesce(gap(F.col("ts_s") + step_s, F.coalesce(F.col("after") - step_s, F.col("last_s"))), F.array().cast("array<bigint>")),
    )
    slots = F.concat(F.array(F.struct("ts_s", F.lit(1.0).alias("value"))), F.transform(missed, lambda t: F.struct(t.alias("ts_s"), F.lit(0.0).alias("value"))))
    labels = F.create_map(F.lit("job"), F.lit("agent"), F.lit("instance"), "instance")
    return rows.select(F.lit("up").alias("name"), labels.alias("labels"), F.inline(slots))
