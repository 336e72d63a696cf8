"""Dashboard panels as data: for each series its legend and an expression over samples.

An expression is a nested tuple: (function, arguments...). ``evaluate`` turns it into a DataFrame (labels, t, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.scalars import threshold_color
from flowloom.plans import vectors as V
from flowloom.sources.events import in_range

N = "network_"


def rate(name, s=60):
    return ("rate", N + name, s)


def grown(name, s=60):
    return ("increase", N + name, s)


def quantile(q, name, s=300):
    return ("/", ("quantile", q, ("rate", f"{N}{name}_microseconds_bucket", s)), 1000)


def last(name):
    return ("instant", N + name)


def hour(*families):
    return [(legend, ("increase_last", f"{N}tcp_{name}_total", 3600)) for legend, name in families]


#: The series of each panel.
PANELS = {
    "o1": [("active", last("tcp_active_flows"))],
    "o2": [("new flows/s", rate("tcp_new_flows_total"))],
    "o3": [("retrans%", ("*", last("tcp_retrans_ratio"), 100))],
    "o4": [("P95 RTT", quantile(0.95, "tcp_rtt"))],
    "o5": [("zero-wnd/m", grown("tcp_zero_window_events_total"))],
    "o6": [("RST/m", grown("tcp_server_reset_total"))],
    "o10": [("TCP sent", rate("tcp_bytes_sent_total")), ("TCP recv", rate("tcp_bytes_received_total")), ("UDP sent", rate("udp_bytes_sent_total")), ("UDP recv", rate("udp_bytes_received_total"))],
    "o11": [("active", last("tcp_active_flows")), ("new/s", rate("tcp_new_flows_total")), ("closed/s", rate("tcp_closed_flows_total"))],
    "o20": [("RTT P50", quantile(0.5, "tcp_rtt")), ("RTT P95", quantile(0.95, "tcp_rtt")), ("RTT P99", quantile(0.99, "tcp_rtt")), ("SYN RTT P95", quantile(0.95, "tcp_syn_rtt"))],
    "o21": [("retrans/s", rate("tcp_retrans_packets_total")), ("zero-wnd/s", rate("tcp_zero_window_events_total")), ("RST/s", rate("tcp_server_reset_total")), ("timeout/s", rate("tcp_timeout_total")), ("conn-fail/s", rate("tcp_client_establish_fail_total"))],
    "o30": [("{{state}}", ("share", last("tcp_connections_by_state")))],
    "o31": hour(("Client SYN Repeat", "client_syn_repeat"), ("Client Establish Fail", "client_establish_fail"), ("Server SYN Miss", "server_syn_miss"), ("Server Queue Overflow", "server_queue_overflow")),
    "o32": [("TCP sent pps", rate("tcp_packets_sent_total")), ("TCP recv pps", rate("tcp_packets_received_total")), ("UDP sent pps", rate("udp_packets_sent_total")), ("UDP recv pps", rate("udp_packets_received_total"))],
    "l1": [("SYN P95", quantile(0.95, "tcp_syn_rtt"))],
    "l2": [("client P95", quantile(0.95, "tcp_syn_rtt_client"))],
    "l3": [("server P95", quantile(0.95, "tcp_syn_rtt_server"))],
    "l4": [("SRT P95", quantile(0.95, "tcp_srt"))],
    "l10": [("{{le}}", ("cells", ("sum_le", rate("tcp_rtt_microseconds_bucket", 300))))],
    "l20": [("Total P50", quantile(0.5, "tcp_syn_rtt")), ("Total P95", quantile(0.95, "tcp_syn_rtt")), ("Client P95", quantile(0.95, "tcp_syn_rtt_client")), ("Server P95", quantile(0.95, "tcp_syn_rtt_server"))],
    "l21": [("RTT P50", quantile(0.5, "tcp_rtt")), ("RTT P95", quantile(0.95, "tcp_rtt")), ("RTT P99", quantile(0.99, "tcp_rtt")), ("SRT P95", quantile(0.95, "tcp_srt"))],
    "l30": [("RTT max", ("/", last("tcp_rtt_max_microseconds"), 1000)), ("SRT max", ("/", last("tcp_srt_max_microseconds"), 1000))],
    "l31": [("Client wait P95", quantile(0.95, "tcp_client_wait")), ("Server wait P95", quantile(0.95, "tcp_server_wait"))],
    "e1": [("retrans%", ("*", last("tcp_retrans_ratio"), 100))],
    "e2": [("retrans/m", grown("tcp_retrans_packets_total"))],
    "e3": [("zero-wnd/m", grown("tcp_zero_window_events_total"))],
    "e4": [("RST/m", grown("tcp_server_reset_total"))],
    "e5": [("failures/m", ("vector", "+", grown("tcp_client_establish_fail_total"), grown("tcp_server_establish_fail_total")))],
    "e6": [("overflow/m", grown("tcp_server_queue_overflow_total"))],
    "e10": [("packets/s", rate("tcp_retrans_packets_total")), ("bytes/s", rate("tcp_retrans_bytes_total"))],
    "e11": [("zero-window/s", rate("tcp_zero_window_events_total")), ("RST/s", rate("tcp_server_reset_total")), ("timeout/s", rate("tcp_timeout_total"))],
    "e20": [(x + "/s", rate(f"tcp_{n}_total")) for x, n in (("Client SYN repeat", "client_syn_repeat"), ("Client establish fail", "client_establish_fail"), ("Server SYN miss", "server_syn_miss"), ("Server SYN repeat", "server_syn_repeat"), ("Server establish fail", "server_establish_fail"), ("Server queue overflow", "server_queue_overflow"))],
    "e21": [(x + "/s", rate(f"tcp_{n}_total")) for x, n in (("Port reuse", "client_port_reuse"), ("Timeout", "timeout"), ("Client half-close lack", "client_half_close_lack"), ("Server half-close lack", "server_half_close_lack"))],
    "e30": hour(("Client SYN Repeat", "client_syn_repeat"), ("Client Establish Fail", "client_establish_fail"), ("Client Establish Other", "client_establish_other"), ("Server SYN Miss", "server_syn_miss"), ("Server SYN Repeat", "server_syn_repeat"), ("Server Establish Fail", "server_establish_fail"), ("Server Queue Overflow", "server_queue_overflow"), ("Client Port Reuse", "client_port_reuse"), ("Server Reset", "server_reset"), ("Timeout", "timeout"), ("Client Half-Close Lack", "client_half_close_lack"), ("Server Half-Close Lack", "server_half_close_lack")),
}
#: The colours of single-value panels.
STEPS = {
    "o1": [(0, "green"), (10000, "yellow"), (50000, "red")],
    "o3": [(0, "green"), (1, "yellow"), (5, "red")],
    "o4": [(0, "green"), (10, "yellow"), (100, "red")],
    "o5": [(0, "green"), (10, "yellow"), (100, "red")],
    "o6": [(0, "green"), (5, "yellow"), (50, "red")],
    "l1": [(0, "green"), (10, "yellow"), (50, "red")],
    "l2": [(0, "green"), (5, "yellow"), (20, "red")],
    "l3": [(0, "green"), (5, "yellow"), (20, "red")],
    "l4": [(0, "green"), (5, "yellow"), (20, "red")],
    "e1": [(0, "green"), (1, "yellow"), (5, "red")],
    "e2": [(0, "green"), (100, "yellow"), (1000, "red")],
    "e3": [(0, "green"), (10, "yellow"), (100, "red")],
    "e4": [(0, "green"), (5, "yellow"), (50, "red")],
    "e5": [(0, "green"), (5, "yellow"), (50, "red")],
    "e6": [(0, "green"), (1, "yellow"), (10, "red")],
    "e30": [(0, "green"), (10, "yellow"), (100, "red")],
}


def names_in(expression) -> set[str]:
    """The names of samples that an expression reads."""
    if isinstance(expression, str):
        return {expression} if expression.startswith(N) else set()
    return set().union(*map(names_in, expression)) if isinstance(expression, (tuple, list)) else set()


def evaluate(samples: DataFrame, expression: tuple, step_s: int = V.STEP_S, end_s: int | None = None, parts: int | None = None) -> DataFrame:
    """labels, t, value of an expression; end_s is the last evaluation point, by default the last sample's time. parts: see vectors."""
    kind, *args = expression
    inner = lambda e: evaluate(samples, e, step_s, end_s, parts)
    if kind == "rate":
        return V.rate(samples, *args, step_s, end_s=end_s, parts=parts)
    if kind == "increase":
        return V.increase(samples, *args, step_s, end_s=end_s, parts=parts)
    if kind == "increase_last":
        return V.increase(samples, *args, step_s, only_last=True)
    if kind == "instant":
        return V.instant(samples, args[0], step_s, end_s=end_s, parts=parts)
    if kind == "quantile":
        return V.histogram_quantile(args[0], inner(args[1]))
    if kind == "sum_le":
        return V.sum_by(inner(args[0]), "le")
    if kind == "cells":
        return V.bucket_cells(inner(args[0]))
    if kind == "share":
        return V.share(inner(args[0]))
    if kind == "vector":
        return V.binary(args[0], inner(args[1]), inner(args[2]))
    return V.scalar_op(kind, inner(args[0]), args[1])


def evaluate_panel(panel: str, samples: DataFrame, start_s: int | None = None, end_s: int | None = None, step_s: int = V.STEP_S, parts: int | None = None) -> DataFrame:
    """Legend, t, value, color of all series of a panel; the legend may be a label's value.

    With start_s and end_s, samples is a history with dates, and only the folders of that range are read.
    """
    if start_s is not None:
        samples = in_range(samples, start_s, end_s)
    out = None
    for legend, expression in PANELS[panel]:
        rows = evaluate(samples, expression, step_s, end_s, parts)
        text = F.col("labels")[legend.strip("{}")] if legend.startswith("{{") else F.lit(legend)
        color = threshold_color("value", STEPS[panel]) if panel in STEPS else F.lit(None).cast("string")
        rows = rows.select(text.alias("legend"), "t", "value", color.alias("color"))
        out = rows if out is None else out.unionByName(rows)
    return out
