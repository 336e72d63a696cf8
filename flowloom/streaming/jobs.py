"""Structured Streaming forms of the operators.

Sources are replayable and queries checkpoint, so a lost executor costs a retry and no event. Built-in windowed
aggregations carry most of it; flow matching (flow_state) is keyed state with event-time timers, rules (alerts) and
snapshots carry tables from batch to batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowloom.functions import scalars as S
from flowloom.operators.flows import HOOK_ORDER, TUPLE


def timed(events: DataFrame, delay: str = "2 minutes") -> DataFrame:
    """Event time and its watermark; rows later than the delay are dropped and counted in the query's progress."""
    return events.withColumn("ts", S.event_time("ts_ns")).withWatermark("ts", delay)


def windowed_counts(events: DataFrame, value: str, window: str = "60 seconds", slide: str | None = None, delay: str = "2 minutes") -> DataFrame:
    """Sums per window of event time, emitted once the watermark has passed it."""
    at = F.window("ts", window, slide) if slide else F.window("ts", window)
    sums = timed(events, delay).groupBy(at.alias("w")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("events"))
    return sums.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total", "events")


def running_udp_totals(udp: DataFrame) -> DataFrame:
    """Totals by flow, in update mode."""
    return udp.groupBy(*TUPLE, "pid").agg(F.sum("packet_size").alias("total_bytes"), F.count(F.lit(1)).alias("packets"))


def udp_sessions(udp: DataFrame, gap: str = "30 seconds", delay: str = "2 minutes") -> DataFrame:
    """T13"""
    s = timed(udp, delay).groupBy(*TUPLE, "pid", F.session_window("ts", gap).alias("s"))
    return s.agg(F.sum("packet_size").alias("bytes"), F.count(F.lit(1)).alias("packets")).select(*TUPLE, "pid", F.col("s.start").alias("session_start"), "bytes", "packets")


FLOWS = "sock long, syn_ts long, established_ts long, close_ts long, bytes_sent long, packets_sent long, retrans_count long, rst_count long"


def socket_machine(ttl_s: int | None) -> Callable:
    def work(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, flow = [], list(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
        else:
            for e in pd.concat(list(batches)).sort_values(HOOK_ORDER).itertuples(index=False):
                if e.hook == "tcp_connect":
                    flow = [int(e.ts_ns), 0, 0, 0, 0, 0]
                elif flow is None:
                    continue
                elif e.hook == "tcp_set_state" and e.arg == 1:
                    flow[1] = flow[1] or int(e.ts_ns)
                elif e.hook == "tcp_sendmsg":
                    flow[2] += int(e.arg)
                    flow[3] += 1
                elif e.hook == "tcp_retransmit_skb":
                    flow[4] += 1
                elif e.hook == "tcp_send_active_reset":
                    flow[5] += 1
                elif e.hook == "tcp_set_state" and e.arg == 7:
                    out.append((key[0], flow[0], flow[1] or None, int(e.ts_ns), *flow[2:]))
                    flow = None
            if flow is None:
                if state.exists:
                    state.remove()
            else:
                state.update(tuple(flow))
                if ttl_s:
                    state.setTimeoutTimestamp(max(flow[0] // 1_000_000 + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[x.strip().split(" ")[0] for x in FLOWS.split(",")]).astype({"established_ts": "Int64"})

    return work


def reconstruct_flows_stream(hooks: DataFrame, ttl_s: int | None = None, delay: str = "2 minutes") -> DataFrame:
    """A row for each closed connection of a socket."""
    timeout = GroupStateTimeout.EventTimeTimeout if ttl_s else GroupStateTimeout.NoTimeout
    state = "syn_ts long, established_ts long, bytes_sent long, packets_sent long, retrans_count long, rst_count long"
    return timed(hooks, delay).groupBy("sock").applyInPandasWithState(socket_machine(ttl_s), FLOWS, state, "append", timeout)


def by_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes a batch to a folder of its own, so that a batch that runs again adds nothing."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")


def to_tables(events: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], path: str, poison: str | None = None, **trigger):
    """Each micro-batch goes to every handler; rows that a condition calls poison go to a folder.

    A handler that raises costs its own rows only: its name, the batch and the error go to a table, and the other
    handlers and the stream go on.
    """
    spark = events.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        good, failed = batch.persist(), []
        try:
            if poison:
                bad = F.coalesce(F.expr(poison), F.lit(True))
                batch.where(bad).write.mode("overwrite").json(f"{path}/dead/batch={number}")
                good = batch.where(~bad)
            for name, handle in handlers.items():
                try:
                    handle(good, number)
                except Exception as error:  # noqa: BLE001
                    failed.append((name, type(error).__name__, str(error)[:2000]))
            found = spark.createDataFrame(failed, "handler string, kind string, message string")
            found.coalesce(1).write.mode("overwrite").json(f"{path}/errors/batch={number}")
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"processingTime": "15 seconds"})).start()


DROPPED = "query string, batch long, operator string, dropped long"


def dropped_rows(query) -> DataFrame:
    """The rows that each stateful operator of each batch dropped because they were later than the watermark."""
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.getActiveSession()
    rows = [(p["name"] or p["id"], p["batchId"], o["operatorName"], o["numRowsDroppedByWatermark"]) for p in map(as_dict, query.recentProgress) for o in p["stateOperators"]]
    return spark.createDataFrame(rows, DROPPED)


def as_dict(progress) -> dict:
    return progress if isinstance(progress, dict) else json.loads(progress.json)


class DroppedRows(StreamingQueryListener):
    """Writes what dropped_rows has of every query of the session to a table, as batches end."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = as_dict(event.progress)
        rows = [(p["name"] or p["id"], p["batchId"], o["operatorName"], o["numRowsDroppedByWatermark"]) for o in p["stateOperators"]]
        if rows:
            self.spark.createDataFrame(rows, DROPPED).coalesce(1).write.mode("overwrite").json(f"{self.path}/{p['id']}-{p['batchId']}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_updates(df: DataFrame, path: str) -> None:
    """What is there now, in update mode: each batch's changed rows go to a folder by its id, so a retry adds nothing."""
    df.writeStream.outputMode("update").foreachBatch(by_batch(f"{path}/rows")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def last_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The row of each key in the last batch that changed it."""
    rows = spark.read.parquet(f"{path}/rows")
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def run_available(df: DataFrame, path: str, mode: str = "append") -> str:
    """All input that is there now, through the stream, to Parquet under path; returns the folder of the rows."""
    query = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return f"{path}/rows"
