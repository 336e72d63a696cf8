"""SQL for DuckDB that computes what the queries compute, written from the definitions over the fixture SQL."""

from __future__ import annotations

from flowloom import fixtures
from flowloom.operators import metrics as M
from flowloom.plans import panels, rules

TUPLE = "saddr, daddr, sport, dport"


def base(*names: str) -> str:
    return "with " + ", ".join(f"{n} as ({fixtures.sql(n)})" for n in names)


MATCHED = base("tcp") + f""", m0 as (select *, last_value(case when event_type in (1, 2) then event_type end ignore nulls) over w prev,
 last_value(case when event_type in (1, 2) then ts_ns end ignore nulls) over w prev_ts
 from tcp window w as (partition by {TUPLE}, protocol order by ts_ns, seq rows between unbounded preceding and 1 preceding)),
 n0 as (select *, event_type = 2 and coalesce(prev = 1 and ts_ns < (prev_ts // 300000000000 + 2) * 300000000000, false) matched from m0),
 m as (select * exclude (prev, prev_ts), case when matched then prev_ts end start_ts, case when matched then (case when packets_sent > 0 then retrans_count / packets_sent else 0.0 end) end retrans_ratio from n0),
 gone as (select *, (ts_ns // 300000000000 + 2) * 300000000000 expired_ts from (select saddr, daddr, sport, dport, protocol, seq, ts_ns, event_type, lead(ts_ns) over (partition by saddr, daddr, sport, dport, protocol order by ts_ns, seq) next_ts
  from tcp where event_type in (1, 2)) where event_type = 1 and (next_ts is null or (ts_ns // 300000000000 + 2) * 300000000000 <= next_ts)),
 me as (select * from m union all by name select saddr, daddr, sport, dport, protocol, seq, expired_ts ts_ns, 6 event_type, false matched from gone where expired_ts <= (select max(ts_ns) from tcp))"""
LIVES = base("hooks") + """, h1 as (select *, sum(case when hook = 'tcp_connect' then 1 else 0 end) over (partition by sock order by ts_ns rows unbounded preceding) life from hooks),
 h2 as (select *, sum(case when hook = 'tcp_set_state' and arg = 7 then 1 else 0 end) over (partition by sock, life order by ts_ns rows unbounded preceding) - (case when hook = 'tcp_set_state' and arg = 7 then 1 else 0 end) closed_before from h1),
 lives as (select * exclude (closed_before) from h2 where life > 0 and closed_before = 0),
 talk as (select sock, life, ts_ns, hook, lag(hook) over w ph, lag(ts_ns) over w pt from lives where hook in ('tcp_sendmsg', 'tcp_ack') window w as (partition by sock, life order by ts_ns)),
 rtts as (select sock, life, ts_ns, (ts_ns - pt) // 1000 rtt_us from talk where hook = 'tcp_ack' and ph = 'tcp_sendmsg')"""


def added(f) -> str:
    name, where, value = f
    return f"cast(coalesce(sum(case when {where} then cast({value} as bigint) else 0 end), 0) as bigint) {name}"


def last(f) -> str:
    name, where, value = f
    return f"arg_max(cast({value} as double), (ts_ns, seq, saddr, daddr, sport, dport)) filter (where {where}) {name}"


def samples_cte(rel: str, protocol: str, counters, lasts=(), histograms=(), states=False, unfed=(), unfed_histograms=(), name: str = "s", rates=()) -> str:
    """name(name, le, state, ts_s, value) over rel."""
    slot = "case when ts_ns % 15000000000 = 0 then ts_ns // 1000000000 else (ts_ns // 15000000000 + 1) * 15 end"
    series = [(n, "", w, v) for n, w, v in counters]
    for n, w, v in histograms:
        series += [(f"{n}_bucket", str(b), f"({w}) and {v} <= {b}", "1") for b in M.BOUNDS]
        series += [(f"{n}_bucket", "+Inf", w, "1"), (f"{n}_sum", "", w, v), (f"{n}_count", "", w, "1")]
    cells = " union all ".join(f"select '{n}' n, '{le}' le, slot, sum(case when {w} then cast({v} as bigint) else 0 end) d from {name}e group by slot" for n, le, w, v in series)
    out = f"""{name}e as (select *, {slot} slot from {rel}), {name}g as (select unnest(range(min(slot), max(slot) + 15, 15)) slot from {name}e), {name}d as ({cells}),
 {name}n as (select distinct n, le from {name}d),
 {name}c as (select 'network_{protocol}_' || k.n as name, k.le, '' state, g.slot ts_s, sum(cast(coalesce(d, 0) as double)) over (partition by k.n, k.le order by g.slot) "value"
   from {name}g g cross join {name}n k left join {name}d x on x.slot = g.slot and x.n = k.n and x.le = k.le)"""
    parts = [f"select * from {name}c"]
    for f in lasts:
        n, w, v = f
        out += f""", {name}l_{n} as (select slot, {last(f)} from {name}e group by slot)"""
        parts.append(f"select 'network_{protocol}_{n}', '', '', g.slot, coalesce(last_value({n} ignore nulls) over (order by g.slot rows unbounded preceding), 0) from {name}g g left join {name}l_{n} x on x.slot = g.slot")
    if states:
        out += f""", {name}t as (select slot, {state_sql('tcp_state')} state, count(*) d from {name}e where event_type = 2 group by all), {name}u as (select state, min(slot) since from {name}t group by state)"""
        parts.append(f"select 'network_{protocol}_connections_by_state', '', u.state, g.slot, sum(cast(coalesce(d, 0) as double)) over (partition by u.state order by g.slot) from {name}g g join {name}u u on g.slot >= u.since left join {name}t x on x.slot = g.slot and x.state = u.state")
    for n, v in rates:
        # a gauge holds what the last tick set: the events of the minute before the tick, its end included
        out += f""", {name}r_{n} as (select (ts_ns + 59999999999) // 60000000000 * 60 tick, sum({v}) / 60 rate from {name}e group by 1)"""
        parts.append(f"select 'network_{protocol}_{n}', '', '', g.slot, coalesce(rate, 0) from {name}g g left join {name}r_{n} x on x.tick = g.slot // 60 * 60")
    zeros = [(n, "") for n in unfed] + [(f"{n}_bucket", str(b)) for n in unfed_histograms for b in (*M.BOUNDS, "+Inf")] + [(f"{n}_{x}", "") for n in unfed_histograms for x in ("sum", "count")]
    if zeros:
        values = ", ".join(f"('network_{protocol}_{n}', '{le}')" for n, le in zeros)
        parts.append(f"select z.n, z.le, '', g.slot, 0.0 from {name}g g cross join (values {values}) z(n, le)")
    return out + f", {name} as (" + " union all ".join(parts) + ")"


def state_sql(c: str) -> str:
    from flowloom.functions.scalars import TCP_STATES

    return f"case {c} " + " ".join(f"when {k} then '{v}'" for k, v in TCP_STATES.items()) + " else 'UNKNOWN' end"


def tcp_samples_cte() -> str:
    return samples_cte("me", "tcp", (*M.TCP_COUNTERS, M.ACTIVE), M.TCP_LAST, M.TCP_HISTOGRAMS, True, M.TCP_UNFED, M.UNFED_HISTOGRAMS, "st")


def all_samples() -> str:
    udp = f", udp as ({fixtures.sql('udp')}), " + samples_cte("udp", "udp", M.UDP_COUNTERS, name="su")
    return MATCHED + ", " + tcp_samples_cte() + udp + ", s as (select * from st union all select * from su)"


TCP_ONLY = MATCHED + ", " + tcp_samples_cte().replace("st as (select", "s as (select", 1)


def vector(e: tuple, step: int = 30) -> str:
    """A subquery (le, state, t, value) of an expression over s."""
    kind, *a = e
    if kind in ("rate", "increase", "increase_last", "instant"):
        name, span = a[0], a[1] if len(a) > 1 else 300
        end = f"(select max(ts_s) from s where name = '{name}') // {step} * {step}" if kind == "increase_last" else "(select max(ts_s) from s)"
        first = end if kind == "increase_last" else f"(select min(ts_s) from s) // {step} * {step}"
        ex = f"""(select r.*, t from (select *, lag(ts_s) over w bt, lag("value") over w bv from s where name = '{name}' window w as (partition by le, state order by ts_s)) r
          join (select unnest(range({first}, {end} + 1, {step})) t) g on t >= ts_s and t < ts_s + {span})"""
        if kind == "instant":
            return f'(select le, state, t, arg_max("value", ts_s) "value" from {ex} group by le, state, t)'
        per = f" / {span}" if kind == "rate" else ""
        return f"""(select le, state, t, inc * (span + (case when inc > 0 and f >= 0 then least(ds2, span * f / inc) else ds2 end) + de2) / span{per} "value" from (
          select *, case when ds >= 1.1 * av then av / 2 else ds end ds2, case when de >= 1.1 * av then av / 2 else de end de2 from (
          select *, span / (n - 1) av from (select le, state, t, count(*) n, arg_min("value", ts_s) f, arg_max("value", ts_s) - arg_min("value", ts_s) + sum(case when bt > t - {span} and "value" < bv then bv else 0.0 end) inc,
          cast(max(ts_s) - min(ts_s) as double) span, cast(min(ts_s) - (t - {span}) as double) ds, cast(t - max(ts_s) as double) de from {ex} group by le, state, t having count(*) >= 2))))"""
    if kind == "quantile":
        q, inner = a
        inside = f"low + (b - low) * (cast({q} as double) * total - under) / nullif(\"value\" - under, 0)"
        return f"""(select '' le, state, t, case when max(total) > 0 then arg_min(case when isinf(b) then low else {inside} end, b) filter (where "value" >= {q} * total) else 'NaN'::double end "value" from (
          select *, coalesce(lag(b) over w, 0) low, coalesce(lag("value") over w, 0) under, max("value") over (partition by state, t) total from (
          select *, case le when '+Inf' then 'Infinity'::double else cast(le as double) end b from {vector(inner, step)} x) window w as (partition by state, t order by b)) group by state, t)"""
    if kind == "sum_le":
        return f'(select le, \'\' state, t, sum("value") "value" from {vector(a[0], step)} x group by le, t)'
    if kind == "cells":
        return f"""(select le, state, t, "value" - coalesce(lag("value") over (partition by state, t order by case le when '+Inf' then 'Infinity'::double else cast(le as double) end), 0) "value" from {vector(a[0], step)} x)"""
    if kind == "share":
        return f'(select le, state, t, 100 * "value" / nullif(sum("value") over (partition by t), 0) "value" from {vector(a[0], step)} x)'
    if kind == "vector":
        op, left, right = a
        value = f"x.\"value\" {op} y.\"value\"" if op != "/" else "case when y.\"value\" <> 0 then x.\"value\" / y.\"value\" when x.\"value\" > 0 then 'Infinity'::double when x.\"value\" < 0 then '-Infinity'::double else 'NaN'::double end"
        return f'(select x.le, x.state, x.t, {value} "value" from {vector(left, step)} x join {vector(right, step)} y on x.le = y.le and x.state = y.state and x.t = y.t)'
    return f'(select le, state, t, "value" {kind} {a[1]} "value" from {vector(a[0], step)} x)'


def panel(name: str) -> str:
    parts = []
    for legend, e in panels.PANELS[name]:
        text = legend.strip("{}") if legend.startswith("{{") else f"'{legend}'"
        color = "null"
        if name in panels.STEPS:
            color = "case when isnan(v) then null " + " ".join(f"when v >= {x} then '{c}'" for x, c in sorted(panels.STEPS[name], reverse=True)) + " end"
        parts.append(f"select {text} legend, t, round(v, 6) \"value\", cast({color} as varchar) color from (select *, \"value\" v from {vector(e)} x)")
    both = any("_udp_" in str(e) for _, e in panels.PANELS[name])
    return (all_samples() if both else TCP_ONLY) + " " + " union all ".join(parts)


def rule(name: str, threshold: float | None = None) -> str:
    r = rules.RULES[name]
    limit = r.threshold if threshold is None else threshold
    op = "=" if r.op == "==" else r.op
    return TCP_ONLY + f""", v as (select * from {vector(r.expression, r.interval_s)} x where "value" {op} {limit} and not isnan("value")),
 i as (select *, t - row_number() over (partition by le, state order by t) * {r.interval_s} island from v),
 a as (select *, min(t) over (partition by le, state, island) active_since from i)
 select '{r.name}' alert, t, round("value", 6) "value", case when t - active_since >= {r.hold_s} then 'firing' else 'pending' end state, active_since, '{r.severity}' severity from a"""
