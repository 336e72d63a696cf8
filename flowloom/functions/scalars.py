"""Scalar functions P1 to P28 as column expressions; nothing here runs Python on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names by code.
TCP_STATES = {1: "ESTABLISHED", 2: "SYN_SENT", 3: "SYN_RECV", 4: "FIN_WAIT1", 5: "FIN_WAIT2", 6: "TIME_WAIT", 7: "CLOSE", 8: "CLOSE_WAIT", 9: "LAST_ACK", 10: "LISTEN", 11: "CLOSING"}
FLAGS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32}
UNITS = ("B", "KB", "MB", "GB", "TB")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uint32_to_ip(c) -> Column:
    """The low byte is the first octet."""
    return F.concat_ws(".", *[(F.shiftright(col(c), s).bitwiseAND(255)).cast("string") for s in (0, 8, 16, 24)])


def ip_to_uint32(c, strict: bool = False) -> Column:
    """The reverse of P1; a mapped address counts as its last four octets; null, or an error if strict."""
    text = F.regexp_replace(col(c), "^::[fF]{4}:", "")
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    parts = F.split(text, r"\.")
    value = sum(F.shiftleft(F.get(parts, i).cast("long"), 8 * i) for i in range(4))
    bad = F.raise_error(F.concat(F.lit("not an IPv4 address: "), col(c))).cast("long") if strict else F.lit(None).cast("long")
    return F.when(text.rlike(rf"^({octet}\.){{3}}{octet}$"), value).otherwise(bad)


def bytes_to_string(c) -> Column:
    """Cut at the first NUL; bytes map to characters one to one."""
    return F.call_function("substring_index", F.decode(col(c), "ISO-8859-1"), F.char(F.lit(0)), F.lit(1))


def string_to_bytes(c, n: int) -> Column:
    """Padded with NUL or cut to n bytes."""
    return F.call_function("rpad", F.encode(col(c), "UTF-8"), F.lit(n), F.unhex(F.lit("00")))


def parse_comm(c) -> Column:
    """P5: trailing NULs go; others stay."""
    return F.regexp_replace(F.decode(col(c), "ISO-8859-1"), "\\x00+$", "")


def format_bytes(c) -> Column:
    """With two decimals from KB on; base 1024. Exact on ties (to even, as C and Go print), unlike format_string."""
    n = col(c)
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    whole = n.cast("double").cast("long")
    for k, unit in enumerate(UNITS[1:], 1):
        small = n < 1024 ** (k + 1) if k < 4 else F.lit(True)
        part = whole.bitwiseAND(1024**k - 1) * 100
        cents, rest = F.shiftright(whole, 10 * k) * 100 + F.shiftright(part, 10 * k), part.bitwiseAND(1024**k - 1)
        up = (rest > 1024**k // 2) | ((rest == 1024**k // 2) & (cents.bitwiseAND(1) == 1))
        cents = cents + up.cast("long")
        out = out.when(small, F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(f" {unit}")))
    return out


def two_decimals(us: Column, scale: int) -> Column:
    """us / scale, as a double, with two decimals: rounded by its exact binary value, ties to even, as C and Go print."""
    us = us.cast("long")
    rest = (us % scale) * 100 % scale
    cents = ((us * 100 - rest) / scale).cast("long")
    # at a tie in decimals the double may lie above or below it: both sides times scale and 2 ** 52, without the whole part
    whole = F.floor(us / scale)
    fraction = ((us.cast("double") / scale - whole.cast("double")) * 2.0**52).cast("long").cast("decimal(19,0)") * scale
    exact = (us - whole * scale).cast("decimal(7,0)") * F.lit(2**52).cast("decimal(16,0)")
    odd = cents.bitwiseAND(1) == 1
    up = (2 * rest > scale) | ((2 * rest == scale) & ((fraction > exact) | ((fraction == exact) & odd)))
    cents = cents + up.cast("long")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def format_duration(c) -> Column:
    """P7"""
    us = col(c)
    return (
        F.when(us < 1000, F.concat(us.cast("string"), F.lit(" µs")))
        .when(us < 1_000_000, F.concat(two_decimals(us, 1000), F.lit(" ms")))
        .otherwise(F.concat(two_decimals(us, 1_000_000), F.lit(" s")))
    )


def micros_to_string(c) -> Column:
    """Without the space; 0 is "0"."""
    return F.when(col(c) == 0, F.lit("0")).otherwise(F.replace(format_duration(c), F.lit(" "), F.lit("")))


def flow_key(src, sport, dst, dport, protocol) -> Column:
    """P9"""
    text = [col(x).cast("string") for x in (src, sport, dst, dport, protocol)]
    return F.concat(text[0], F.lit(":"), text[1], F.lit("->"), text[2], F.lit(":"), text[3], F.lit("/"), text[4])


def reverse_flow_key(c) -> Column:
    """P10: a key of another form stays as it is."""
    slash = F.split(col(c), "/", -1)
    ends = F.split(F.get(slash, 0), "->", -1)
    ok = (F.size(F.split(col(c), "->", -1)) == 2) & (F.size(F.split(F.get(F.split(col(c), "->", -1), 1), "/", -1)) == 2) & (F.size(slash) == 2)
    return F.when(ok, F.concat(F.get(ends, 1), F.lit("->"), F.get(ends, 0), F.lit("/"), F.get(slash, 1))).otherwise(col(c))


def bidirectional_key(src, sport, dst, dport) -> Column:
    """The same for both directions of a flow."""
    a, b = F.struct(col(src).alias("ip"), col(sport).alias("port")), F.struct(col(dst).alias("ip"), col(dport).alias("port"))
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def retrans_ratio(r, t) -> Column:
    """0 without packets."""
    return F.when(col(t) == 0, F.lit(0.0)).otherwise(F.try_divide(col(r).cast("double"), col(t).cast("double")))


def is_private_ip(c) -> Column:
    """10/8, 172.16/12, 192.168/16."""
    n = ip_to_uint32(c)
    first, second = n.bitwiseAND(255), F.shiftright(n, 8).bitwiseAND(255)
    return F.coalesce((first == 10) | ((first == 172) & second.between(16, 31)) | ((first == 192) & (second == 168)), F.lit(False))


def protocol_name(c) -> Column:
    """P14"""
    return F.when(col(c) == 6, "TCP").when(col(c) == 17, "UDP").otherwise(F.concat(F.lit("PROTO_"), col(c).cast("string")))


def direction_name(c) -> Column:
    """P15"""
    return F.when(col(c) == 1, "EGRESS").when(col(c) == 0, "INGRESS").otherwise(F.lit("UNKNOWN"))


def tcp_state_name(c) -> Column:
    """P16"""
    names = F.create_map(*[F.lit(x) for pair in TCP_STATES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, col(c)), F.lit("UNKNOWN"))


def if_name(index, name) -> Column:
    """The joined name, or if<n>."""
    return F.coalesce(col(name), F.concat(F.lit("if"), col(index).cast("string")))


def ns_to_us(c) -> Column:
    """P18"""
    return _div(c, 1000)


def ns_to_ms(c) -> Column:
    """P18"""
    return _div(c, 1_000_000)


def _div(c, by: int) -> Column:
    return F.call_function("div", col(c).cast("long"), F.lit(by).cast("long"))


def swap16(c) -> Column:
    """The other byte order of a 16-bit number."""
    return F.shiftleft(col(c).bitwiseAND(255), 8).bitwiseOR(F.shiftright(col(c), 8).bitwiseAND(255))


def assemble_tcp_flags(**bits) -> Column:
    """P20: bits by name (fin, syn, rst, psh, ack, urg)."""
    out = F.lit(0)
    for name, bit in bits.items():
        out = out.bitwiseOR(F.when(col(bit).cast("int") != 0, FLAGS[name.upper()]).otherwise(0))
    return out


def tcp_flag_names(c) -> Column:
    """P21"""
    return F.array_compact(F.array(*[F.when(col(c).bitwiseAND(mask) != 0, name) for name, mask in FLAGS.items()]))


def event_time(c) -> Column:
    """P22"""
    return F.timestamp_micros(ns_to_us(c))


def handshake(syn, synack, established) -> Column:
    """Total, server and client microseconds; null where a stamp is missing."""
    def part(a, b):
        return F.when((col(a) > 0) & (col(b) > 0), _div(col(b) - col(a), 1000))

    return F.struct(part(syn, established).alias("total"), part(syn, synack).alias("server"), part(synack, established).alias("client"))


def durations(start_ns, established_ns, end_ns) -> Column:
    """Microseconds since the start, and since the connection was established."""
    return F.struct(_div(col(end_ns) - col(start_ns), 1000).alias("duration_us"), (col(end_ns) - col(established_ns)).alias("established_ns"))


def timeout_occurred(c) -> Column:
    """P25"""
    return col(c) > 0


def scaled(c, factor: float) -> Column:
    """P26"""
    return col(c) * factor


def threshold_color(c, steps: list[tuple[float, str]]) -> Column:
    """The colour of the highest step that the value reaches; null below all and for NaN."""
    out = None
    for value, color in sorted(steps, reverse=True):
        hit = (col(c) >= value) & ~F.isnan(col(c).cast("double"))
        out = F.when(hit, color) if out is None else out.when(hit, color)
    return out


def humanize(c) -> Column:
    """Four significant digits with an SI prefix."""
    v = col(c).cast("double")
    out = F.when(v.isNull() | F.isnan(v) | (v == 0) | (F.abs(v) < 1e-24), F.format_string("%.4g", v))
    for power, prefix in ((24, "Y"), (21, "Z"), (18, "E"), (15, "P"), (12, "T"), (9, "G"), (6, "M"), (3, "k"), (0, "")):
        out = out.when(F.abs(v) >= 10.0**power, F.concat(short(v / 10.0**power), F.lit(prefix)))
    for power, prefix in ((-3, "m"), (-6, "u"), (-9, "n")):
        out = out.when(F.abs(v) >= 10.0**power, F.concat(short(v / 10.0**power), F.lit(prefix)))
    return out.otherwise(F.format_string("%.4g", v))


def short(v: Column) -> Column:
    """Four significant digits without trailing zeros, for 0.1 <= |v| < 1000."""
    digits = F.when(F.abs(v) >= 100, 1).when(F.abs(v) >= 10, 2).otherwise(3)
    text = F.when(digits == 1, F.format_string("%.1f", v)).when(digits == 2, F.format_string("%.2f", v)).otherwise(F.format_string("%.3f", v))
    return F.regexp_replace(text, r"\.?0+$", "")


def humanize_percentage(c) -> Column:
    """P28"""
    return F.concat(short(col(c).cast("double") * 100), F.lit("%"))
