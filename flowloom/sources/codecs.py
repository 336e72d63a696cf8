"""Fixed-layout records and frames as bulk jobs: one numpy structured type over a batch's bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.schemas import EVENTS, FRAMES, TC

#: Field, numpy type, offset; and the record's size.
LAYOUTS = {
    "tcp": (
        152,
        "ts_ns:<u8:0 pid:<u4:8 tid:<u4:12 comm:S16:16 saddr:<u4:32 daddr:<u4:36 sport:<u2:40 dport:<u2:42 protocol:u1:44 event_type:u1:45 direction:u1:46 "
        "syn_rtt:<u4:48 syn_rtt_client:<u4:52 syn_rtt_server:<u4:56 rtt_mean:<u4:60 rtt_max:<u4:64 rtt_min:<u4:68 srt_mean:<u4:72 srt_max:<u4:76 "
        "retrans_count:<u4:80 retrans_bytes:<u8:88 zero_wnd_count:<u4:96 zero_wnd_duration:<u8:104 bytes_sent:<u8:112 bytes_received:<u8:120 "
        "packets_sent:<u8:128 packets_received:<u8:136 syn_retrans:u1:144 rst_count:u1:145 timeout_flag:u1:146 tcp_state:u1:147 duration_us:<u4:148",
    ),
    "udp": (64, "ts_ns:<u8:0 pid:<u4:8 tid:<u4:12 comm:S16:16 saddr:<u4:32 daddr:<u4:36 sport:<u2:40 dport:<u2:42 direction:u1:44 packet_size:<u8:48 total_bytes:<u8:56"),
    "tc": (
        40,
        "ts_ns:<u8:0 ifindex:<u4:8 saddr:<u4:12 daddr:<u4:16 sport:<u2:20 dport:<u2:22 protocol:u1:24 direction:u1:25 tcp_flags:u1:26 packet_len:<u4:28 "
        "ip_header_len:<u4:32 ip_ttl:u1:36 ip_tos:u1:37 ip_id:<u2:38",
    ),
}
ARROW = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def record_type(kind: str) -> np.dtype:
    size, fields = LAYOUTS[kind]
    names, formats, offsets = zip(*(x.split(":") for x in fields.split()))
    return np.dtype({"names": names, "formats": formats, "offsets": [int(o) for o in offsets], "itemsize": size})


def decode_records(df: DataFrame, kind: str, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(typed rows, dead letters): records shorter than the layout are dead; of longer ones the prefix is read.

    Process names lose trailing NULs only, and map bytes to characters one to one. seq, where the table has it, is null.
    """
    size, schema = LAYOUTS[kind][0], EVENTS[kind]
    short = F.coalesce(F.octet_length(raw) < size, F.lit(True))

    def work(batches):
        kinds = record_type(kind)
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), kinds)
            out = []
            for field in schema:
                if field.name not in kinds.names:
                    out.append(pa.nulls(len(rows), ARROW[field.dataType.simpleString()]))
                elif field.name == "comm":
                    out.append(pa.array([c.decode("latin-1") for c in rows["comm"].tolist()], pa.string()))
                else:
                    out.append(pa.array(rows[field.name].astype(np.int64), ARROW[field.dataType.simpleString()]))
            yield pa.RecordBatch.from_arrays(out, names=schema.fieldNames())

    good = df.where(~short).select(F.substring(F.col(raw), 1, size).alias("raw"))
    return good.mapInArrow(work, schema), df.where(short)


def encode_records(df: DataFrame, kind: str) -> DataFrame:
    """raw: the reverse, for replaying tables as captured records."""

    def work(batches):
        kinds = record_type(kind)
        for batch in batches:
            rows = np.zeros(batch.num_rows, kinds)
            for name in kinds.names:
                if name in batch.schema.names:
                    values = batch.column(name)
                    rows[name] = [(v or "").encode("latin-1") for v in values.to_pylist()] if name == "comm" else values.fill_null(0).to_numpy(zero_copy_only=False)
            raw = rows.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + kinds.itemsize] for i in range(0, len(raw), kinds.itemsize)], pa.binary())], names=["raw"])

    return df.mapInArrow(work, "raw binary")


def frames_to_packets(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packets, rejected frames). Other protocols than TCP and UDP keep the network layer only."""
    parsed = frames.select(*FRAMES.fieldNames()).mapInArrow(parse_frames, schema_of_parsed())
    return parsed.where("ok").select(*TC.fieldNames()), parsed.where("not ok").select(*FRAMES.fieldNames())


def schema_of_parsed():
    from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

    return StructType([*TC.fields, StructField("ok", BooleanType()), StructField("wire_len", LongType()), StructField("data", BinaryType())])


def parse_frames(batches):
    names = schema_of_parsed().fieldNames()
    for batch in batches:
        data = batch.column("data")
        lens = np.array([len(x) if x is not None else 0 for x in data.to_pylist()], np.int64)
        flat = np.frombuffer(b"".join(x or b"" for x in data.to_pylist()) + bytes(128), np.uint8).astype(np.int64)
        base = np.cumsum(lens) - lens

        def at(offset, base=base, flat=flat):
            return flat[np.minimum(base + offset, flat.size - 1)]

        def at16(offset, at=at):
            return at(offset) << 8 | at(offset + 1)

        def address(offset, at=at):
            return sum(at(offset + k) << 8 * k for k in range(4))  # the low byte is the first octet

        ihl = (at(14) & 15) * 4
        protocol, l4 = at(23), 14 + ihl
        tcp, udp = protocol == 6, protocol == 17
        ok = (lens >= 34) & (at16(12) == 0x0800) & ~(tcp & (lens < l4 + 20)) & ~(udp & (lens < l4 + 8))
        ports = tcp | udp
        out = {
            "ts_ns": batch.column("ts_ns"),
            "ifindex": batch.column("ifindex"),
            "saddr": address(26),
            "daddr": address(30),
            "sport": np.where(ports, at16(l4), 0),
            "dport": np.where(ports, at16(l4 + 2), 0),
            "protocol": protocol,
            "direction": batch.column("direction"),
            "tcp_flags": np.where(tcp, at(l4 + 13) & 63, 0),
            "packet_len": batch.column("wire_len"),
            "ip_header_len": ihl,
            "ip_ttl": at(22),
            "ip_tos": at(15),
            "ip_id": at16(18),
            "ok": ok,
            "wire_len": batch.column("wire_len"),
            "data": data,
        }
        kinds = {f.name: ARROW.get(f.dataType.simpleString(), pa.bool_()) for f in schema_of_parsed().fields}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds[n]) if isinstance(v := out[n], np.ndarray) else v for n in names], names=names)
