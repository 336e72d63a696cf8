"""Event tables derived from the order, line item and event tables, as FIXTURES.md defines them.

The SQL is the same text in Spark and DuckDB but for the names of the tables and the microseconds of a timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SEGMENTS = """select l_orderkey k, l_linenumber ln, count(*) segs, sum(cast(l_quantity*100 as bigint)) bytes,
 sum(case when l_returnflag='R' then 1 else 0 end) rt, sum(case when l_returnflag='R' then cast(l_quantity*100 as bigint) else 0 end) rtb
 from {lineitem} group by l_orderkey, l_linenumber"""
FLOWS = """select o_orderkey k, o_custkey c, o_orderstatus st,
 cast(10 + (((o_custkey >> 8) & 255) << 16) + ((o_custkey & 255) << 24) as bigint) saddr,
 cast(192 + (168 << 8) + ((o_orderkey % 4) << 16) + (((o_orderkey % 20)+1) << 24) as bigint) daddr,
 cast(32768 + o_orderkey % 28000 as int) sport, case o_orderkey % 4 when 0 then 80 when 1 then 443 when 2 then 5432 else 6379 end dport,
 o_orderkey*300000000 + (o_custkey % 97)*1000000 t0, 80 + (o_custkey*37) % 4000 srv, 20 + (o_orderkey*13) % 900 cli,
 case when o_orderstatus='P' and o_orderkey % 5 = 0 then 0 else 1 end est from {orders}"""
NEW_TCP = "ts_ns event_type saddr daddr sport dport syn_rtt syn_rtt_client syn_rtt_server rtt_mean rtt_max rtt_min retrans_count retrans_bytes bytes_sent packets_sent rst_count tcp_state duration_us sock".split()
TCP_CORE = f"""with f as ({FLOWS}), l as ({SEGMENTS}), a as (select k, sum(segs) segs, sum(bytes) bytes, sum(rt) rt, sum(rtb) rtb from l group by k)
select t0+(srv+cli)*1000 ts_ns, 1 event_type, saddr,daddr,sport,dport, srv+cli syn_rtt, cli syn_rtt_client, srv syn_rtt_server, 0 rtt_mean, 0 rtt_max, 0 rtt_min, 0 retrans_count, 0 retrans_bytes, 0 bytes_sent, 0 packets_sent, 0 rst_count, 1 tcp_state, 0 duration_us, k sock from f where est=1
union all
select t0+5000000+ (case when est=1 then 100000000 + (c%50)*10000000 else 0 end), 2, case when est=1 then saddr else 0 end,daddr,sport,dport, case when est=1 then srv+cli else 0 end, case when est=1 then cli else 0 end, case when est=1 then srv else 0 end,
 case when est=1 and segs>0 then 150+(c*11)%5000 else 0 end, case when est=1 and segs>0 then 150+(c*11)%5000+(f.k%7)*1000 else 0 end, case when est=1 and segs>0 then 100 else 0 end,
 case when est=1 then coalesce(rt,0) else 0 end, case when est=1 then coalesce(rtb,0) else 0 end, case when est=1 then coalesce(bytes,0) else 0 end, case when est=1 then coalesce(segs,0) else 0 end, case when f.k%50=7 then 1 else 0 end, 7,
 5000+(case when est=1 then 100000+(c%50)*10000 else 0 end), f.k from f left join a on f.k=a.k where st='F' or est=0
union all
select t0+5000000+ln*7000000, 3, saddr,daddr,sport,dport,0,0,0,0,0,0,sum(rt) over (partition by f.k order by ln), sum(rtb) over (partition by f.k order by ln),0,0,0,1,0,f.k from f join l on f.k=l.k where est=1 and rt>0
union all
select t0+60000000, 5, saddr,daddr,sport,dport,0,0,0,0,0,0,0,0,0,0,1,1,0,k from f where est=1 and k%50=7"""
#: One of three stretches of ten minutes is a bad one: slow round trips, zero windows, repeated SYNs, resets.
BAD = "ts_ns % 1800000000000 between 600000000000 and 1199999999999"
CLOSED = "event_type = 2 and syn_rtt > 0"
OWN = {
    "rtt_mean": f"case when {CLOSED} and {BAD} then rtt_mean * 60 else rtt_mean end",
    "rtt_max": f"case when {CLOSED} and {BAD} then rtt_max * 60 else rtt_max end",
    "rst_count": f"case when {CLOSED} and {BAD} then rst_count + 30 + sock % 20 else rst_count end",
    "tcp_state": "case when event_type = 2 and sock % 9 = 0 then 8 when event_type = 2 and sock % 9 = 1 then 9 else tcp_state end",
    "srt_mean": f"case when {CLOSED} and sock % 4 <> 0 then 50 + (sock * 17) % 9000 else 0 end",
    "srt_max": f"case when {CLOSED} and sock % 4 <> 0 then 50 + (sock * 17) % 9000 + (sock % 5) * 400 else 0 end",
    "zero_wnd_count": f"case when {CLOSED} and {BAD} then 10 + sock % 30 when {CLOSED} and sock % 3 = 0 then 1 else 0 end",
    "zero_wnd_duration": f"case when {CLOSED} and ({BAD} or sock % 3 = 0) then 700 + (sock * 29) % 5000 else 0 end",
    "bytes_received": f"case when {CLOSED} then (sock * 131) % 100000 else 0 end",
    "packets_received": f"case when {CLOSED} then 1 + sock % 40 else 0 end",
    "direction": "case when sock % 5 = 2 then 0 else 1 end",
    "syn_retrans": f"case when {CLOSED} and {BAD} then 20 + sock % 7 when {CLOSED} then sock % 3 else 0 end",
    "timeout_flag": "case when event_type = 2 and sock % 21 = 4 then 1 else 0 end",
    "pid": "1000 + sock % 30",
    "tid": "1000 + sock % 30",
    "comm": "'app'",
    "protocol": "6",
    "seq": "event_type",
}
INTS = "sport dport event_type rst_count tcp_state protocol direction syn_retrans timeout_flag".split()
TCP = (
    "select "
    + ", ".join(f"cast({OWN.get(c, c)} as {'string' if c == 'comm' else 'int' if c in INTS else 'bigint'}) {c}" for c in dict.fromkeys([*NEW_TCP, *OWN]))
    + f" from ({TCP_CORE}) core"
)
HOOKS = f"""with f as ({FLOWS}), l as ({SEGMENTS}), b as (select f.*, l.ln, l.bytes, l.rt, l.rtb from f join l on f.k=l.k where est=1)
select cast(sock as bigint) sock, cast(ts_ns as bigint) ts_ns, hook, cast(arg as bigint) arg, saddr, daddr, sport, dport from (
select k sock, t0 ts_ns, 'tcp_connect' hook, 0 arg, saddr,daddr,sport,dport from f
union all select k, t0+srv*1000,'tcp_synack',0,saddr,daddr,sport,dport from f where est=1
union all select k, t0+(srv+cli)*1000,'tcp_set_state',1,saddr,daddr,sport,dport from f where est=1
union all select k, t0+5000000+ln*7000000,'tcp_sendmsg',bytes,saddr,daddr,sport,dport from b
union all select k, t0+5000000+ln*7000000+(200+(k*7+ln*31)%3000)*1000,'tcp_ack',0,saddr,daddr,sport,dport from b
union all select k, t0+5000000+ln*7000000+4500000,'tcp_retransmit_skb',rtb,saddr,daddr,sport,dport from b where rt>0
union all select k, t0+60000000,'tcp_send_active_reset',0,saddr,daddr,sport,dport from f where est=1 and k%50=7
union all select k, t0+5000000+(case when est=1 then 100000000+(c%50)*10000000 else 0 end),'tcp_set_state',7,saddr,daddr,sport,dport from f where st='F' or est=0) h"""
UDP = """select (TS_US - 1704067200000000)*2 ts_ns, cast(1000 + user_id % 50 as bigint) pid, cast(10 + ((user_id & 255) << 24) as bigint) saddr, cast(case when user_id % 7=0 then 0 else 8 + (8 << 8) + ((user_id % 3) << 24) end as bigint) daddr,
 cast(40000 + user_id % 100 as int) sport, cast(case when user_id % 7=0 then 0 else 53 end as int) dport, cast(case when event_type in ('click','purchase') then 1 else 0 end as int) direction, cast(floor(value*10) as bigint)+28 packet_size from {events}"""
TC = """select l_orderkey*300000000 + l_linenumber*1000000 ts_ns, cast(l_suppkey % 4 + 1 as bigint) ifindex, cast(case when l_linenumber=7 then 1 when l_returnflag='R' then 17 else 6 end as int) protocol,
 cast(case when l_linestatus='F' then 0 else 1 end as int) direction, cast(case when l_linenumber<>7 and l_returnflag<>'R' then l_partkey % 64 else 0 end as int) tcp_flags, cast(l_quantity*29 as bigint)+40 packet_len from {lineitem}"""
#: Entry and exit of receive calls: an entry for each event, and an exit that fails now and then.
UDP_CALLS = """select cast(user_id as bigint) pid_tgid, (TS_US - 1704067200000000)*2 ts_ns, case when event_type in ('click','purchase') then 'entry' else 'exit' end kind,
 cast(case when event_type in ('click','purchase') then null when event_id % 5 = 0 then -1 else floor(value*10)+28 end as bigint) ret, cast(event_id as bigint) sock from {events}"""
#: Packets of a flow's handshake and end, for the anomaly counters.
PACKETS = f"""with f as ({FLOWS}) select cast(ts_ns as bigint) ts_ns, saddr, daddr, sport, dport, cast(6 as int) protocol, cast(tcp_flags as int) tcp_flags, cast(40 as bigint) packet_len from (
select t0 ts_ns, saddr, daddr, sport, dport, 2 tcp_flags from f where k%11<>3
union all select t0+500000, saddr, daddr, sport, dport, 2 from f where k%13=1
union all select t0+1000000, daddr, saddr, dport, sport, case when k%17=2 then 20 else 18 end from f
union all select t0+9000000, saddr, daddr, sport, dport, 17 from f where k%5<>0
union all select t0+9500000, daddr, saddr, dport, sport, 17 from f where k%7<>0
union all select t0+20000000, saddr, daddr, sport, dport, 2 from f where k%19=4) p"""
INTERFACES = "select * from (values (cast(1 as bigint), 'lo'), (cast(2 as bigint), 'eth0'), (cast(3 as bigint), 'ens33')) t(ifindex, if_name)"
TABLES = {"tcp": TCP, "hooks": HOOKS, "udp": UDP, "tc": TC, "udp_calls": UDP_CALLS, "packets": PACKETS, "interfaces": INTERFACES, "flows": FLOWS}
SOURCES = ("orders", "lineitem", "events")


def sql(name: str) -> str:
    """The derivation for DuckDB, where the source tables are views."""
    return TABLES[name].format(**{t: t for t in SOURCES}).replace("TS_US", "epoch_us(ts)")


def derived(spark: SparkSession, sf_dir: str, name: str, parts: int | None = None) -> DataFrame:
    """parts, if given, is the number of tasks that line items are dealt over by order, before they are added up."""
    text = TABLES[name].replace("TS_US", "unix_micros(cast(ts as timestamp))")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES if "{" + t + "}" in text}
    if parts and name != "tc" and "lineitem" in used:
        used["lineitem"] = used["lineitem"].repartition(parts, "l_orderkey")
    return spark.sql(text, **used)
