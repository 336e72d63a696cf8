"""Column names and types of the event tables."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType, TimestampType

KINDS = {"long": LongType(), "int": IntegerType(), "string": StringType(), "binary": BinaryType()}


def columns(**kinds: str) -> StructType:
    return StructType([StructField(name, KINDS[kind]) for kind, names in kinds.items() for name in names.split()])


def ordered(text: str) -> StructType:
    """A schema from "name:kind ..." in order."""
    return StructType([StructField(n, KINDS[k]) for n, k in (x.split(":") for x in text.split())])


TCP = ordered(
    "ts_ns:long pid:long tid:long comm:string saddr:long daddr:long sport:int dport:int protocol:int event_type:int direction:int "
    "syn_rtt:long syn_rtt_client:long syn_rtt_server:long rtt_mean:long rtt_max:long rtt_min:long srt_mean:long srt_max:long "
    "retrans_count:long retrans_bytes:long zero_wnd_count:long zero_wnd_duration:long bytes_sent:long bytes_received:long "
    "packets_sent:long packets_received:long syn_retrans:int rst_count:int timeout_flag:int tcp_state:int duration_us:long seq:long"
)
UDP = ordered(
    "ts_ns:long pid:long tid:long comm:string saddr:long daddr:long sport:int dport:int direction:int packet_size:long total_bytes:long"
)
TC = ordered(
    "ts_ns:long ifindex:long saddr:long daddr:long sport:int dport:int protocol:int direction:int tcp_flags:int packet_len:long "
    "ip_header_len:int ip_ttl:int ip_tos:int ip_id:int"
)
HOOKS = ordered("sock:long ts_ns:long hook:string arg:long saddr:long daddr:long sport:int dport:int")
UDP_CALLS = ordered("pid_tgid:long ts_ns:long kind:string ret:long sock:long")
INTERFACES = ordered("ifindex:long if_name:string")
FRAMES = ordered("ts_ns:long ifindex:long direction:int wire_len:long data:binary")
SAMPLES = StructType(
    [StructField("name", StringType()), StructField("labels", MapType(StringType(), StringType())), StructField("ts", TimestampType()), StructField("value", DoubleType())]
)
EVENTS = {"tcp": TCP, "udp": UDP, "tc": TC, "hooks": HOOKS, "udp_calls": UDP_CALLS, "frames": FRAMES}
