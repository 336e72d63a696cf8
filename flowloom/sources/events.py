"""Reading and writing event tables, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions import scalars as S
from flowloom.operators.metrics import exposition, named_interfaces
from flowloom.schemas import EVENTS


def read_events(spark: SparkSession, path: str, kind: str, fmt: str = "parquet", streaming: bool = False, files_per_trigger: int = 1000) -> DataFrame:
    """A table of the kind with its explicit schema; no inference."""
    if streaming:
        return spark.readStream.schema(EVENTS[kind]).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return spark.read.schema(EVENTS[kind]).format(fmt).load(path)


def read_hook_events(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False) -> DataFrame:
    return read_events(spark, path, "hooks", fmt, streaming)


def sample_flows(df: DataFrame, percent: int) -> DataFrame:
    """Whole flows, by a hash of the five-tuple; the same flows in every run."""
    if not 1 <= percent <= 100:
        raise ValueError(f"sampling rate must be 1 to 100, not {percent}")
    return df.where(F.pmod(F.xxhash64("saddr", "daddr", "sport", "dport"), F.lit(100)) < percent)


def enrich(df: DataFrame, interfaces: DataFrame | None = None) -> DataFrame:
    """The readable columns that the table has the codes for."""
    have = set(df.columns)
    out = df
    if interfaces is not None and "ifindex" in have:
        out = named_interfaces(out, interfaces)
    if "saddr" in have:
        out = out.withColumn("src_ip", S.uint32_to_ip("saddr")).withColumn("dst_ip", S.uint32_to_ip("daddr"))
    out = out.withColumn("ts", S.event_time("ts_ns"))
    for name, code, function in (("protocol_name", "protocol", S.protocol_name), ("direction_name", "direction", S.direction_name), ("state_name", "tcp_state", S.tcp_state_name)):
        if code in have:
            out = out.withColumn(name, function(code))
    if {"protocol_name", "src_ip"} <= set(out.columns):
        out = out.withColumn("flow_key", S.flow_key("src_ip", "sport", "dst_ip", "dport", "protocol_name"))
    return out


def flow_log(matched: DataFrame) -> DataFrame:
    """A record for each start and each matched or orphan close."""
    kind = F.when(F.col("event_type") == 1, "started").when(F.col("matched"), "closed").otherwise("closed_orphan")
    rows = enrich(matched.where("event_type in (1, 2)"))
    return rows.select(kind.alias("record"), "ts_ns", "src_ip", "dst_ip", "sport", "dport", "syn_rtt", "rtt_mean", "bytes_sent", "bytes_received", "retrans_count", "duration_us", "state_name")


def packet_log(packets: DataFrame, interfaces: DataFrame | None = None) -> DataFrame:
    """A record for each packet of an interface or datagram of a process, with names in place of codes."""
    rows = enrich(packets, interfaces).drop("ts")
    return rows.select(F.lit("packet" if "ifindex" in packets.columns else "datagram").alias("record"), *[c for c in rows.columns if c not in ("ifindex", "saddr", "daddr", "protocol", "direction", "pid", "tid")])


def write_log(df: DataFrame, path: str, fmt: str = "json") -> None:
    """As JSON lines, or as text of name=value pairs."""
    if fmt == "text":
        df = df.select(F.concat_ws(" ", *[F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns]).alias("value"))
    df.write.mode("append").format(fmt).save(path)


def write_exposition(samples: DataFrame, path: str) -> None:
    """S10"""
    exposition(samples).select("line").write.mode("overwrite").text(path)


def write_samples(samples: DataFrame, path: str, by_day: bool = False) -> None:
    """History in folders by date and family, so that a time range and a family prune them.

    by_day: the rows of a day, or of a series, already lie in one task each, and are not exchanged again.
    """
    dated = samples.withColumn("date", F.to_date(F.timestamp_seconds("ts_s"))).withColumn("family", F.col("name"))
    (dated if by_day else dated.repartition("date", "family")).write.mode("append").partitionBy("date", "family").parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """name, labels, ts_s, value, date of a history; a condition on name or date prunes its folders."""
    schema = "labels map<string,string>, ts_s long, value double, date date, family string"
    return spark.read.schema(schema).parquet(path).select(F.col("family").alias("name"), "labels", "ts_s", "value", "date")


def in_range(samples: DataFrame, start_s: int, end_s: int) -> DataFrame:
    """samples of a history from start to end, by folders first."""
    day = lambda s: F.to_date(F.timestamp_seconds(F.lit(s)))
    return samples.where(F.col("ts_s").between(start_s, end_s) & F.col("date").between(day(start_s), day(end_s)))


def expire_samples(spark: SparkSession, path: str, days: int = 7) -> None:
    """A history without the folders of days that are over; the day of the last sample counts as the first."""
    history = read_samples(spark, path)
    last = history.agg(F.max("date")).first()[0]
    old = [r[0] for r in history.select("date").distinct().where(F.col("date") <= F.date_sub(F.lit(last), days)).collect()] if last else []
    for date in old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/date={date}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def merge_events(**tables: DataFrame) -> DataFrame:
    """One timeline of several kinds."""
    out = None
    for kind, df in tables.items():
        df = df.withColumn("kind", F.lit(kind))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def route(events: DataFrame, kind: str) -> DataFrame:
    """The rows of a kind."""
    return events.where(F.col("kind") == kind)
