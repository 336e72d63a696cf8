"""T4, T6 at volume: flows of a stream by windows over each micro-batch, with the open flows carried as a table.

The rules are those of the keyed state machines (flow_state, jobs), in arrival order from batch to batch and in order of
time within one. A batch is one exchange by key with the flows that are still open, and no key costs a call into Python.
The watermark is carried too: rows at or before it are late and are dropped, and what is due by it leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators import flows as W
from flowloom.streaming.carried import Carried
from flowloom.streaming.flow_state import MATCHED
from flowloom.streaming.jobs import FLOWS

KEY = [*W.TUPLE, "protocol"]
OPEN = "saddr long, daddr long, sport int, dport int, protocol int, start_ts long, retrans_count long"
UNCLOSED = "sock long, syn_ts long, established_ts long, bytes_sent long, packets_sent long, retrans_count long, rst_count long"
MARK = "watermark_ms long"


def in_time(carried: Carried, rows: DataFrame, batch: int, delay_s: int) -> tuple[DataFrame, int | None]:
    """The rows of a batch that are not late, and the watermark after it."""
    mark = carried.load("mark", batch - 1, MARK).first()
    mark = mark[0] if mark else None
    newest = rows.agg(F.max("ts_ns")).first()[0]
    found = [m for m in (mark, None if newest is None else newest // 1_000_000 - delay_s * 1000) if m is not None]
    after = max(found, default=None)
    carried.save(carried.spark.createDataFrame([(after,)], MARK), "mark", batch)
    return (rows if mark is None else rows.where(F.expr("ts_ns div 1000") > mark * 1000)), after


def split(carried: Carried, rows: DataFrame, batch: int, schema: str, open_schema: str) -> None:
    """Writes what rows (done: an array of results, still: what stays open) have, each once."""
    step = carried.save(rows.where("size(done) > 0 or still is not null"), "step", batch)
    names = lambda s: [x.strip().split(" ")[0] for x in s.split(",")]
    done, still = step.select("*", F.inline("done")), step.where("still is not null").select("still.*")
    carried.save(done.select(*names(schema)), "done", batch, keep=True)
    carried.save(still.select(*names(open_schema)), "open", batch)


def match_batch(carried: Carried, events: DataFrame, batch: int, max_age_s: int = W.MAX_AGE_S, delay_s: int = 120) -> None:
    """Matched, orphan and expired flows of a batch, as FlowMachine without hold gives them."""
    events, mark = in_time(carried, events.where(F.col("event_type").isin(W.START, W.END, W.RETRANS)), batch, delay_s)
    kept = carried.load("open", batch - 1, OPEN).select(*KEY, F.lit(W.START).alias("event_type"), F.col("start_ts").alias("ts_ns"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("bytes_sent"), "retrans_count", F.lit(0).alias("fresh"))
    rows = kept.unionByName(events.select(*KEY, "event_type", "ts_ns", "seq", "bytes_sent", "retrans_count", F.lit(1).alias("fresh")))
    order = Window.partitionBy(*KEY).orderBy("fresh", "ts_ns", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    start, end, again = (F.col("event_type") == k for k in (W.START, W.END, W.RETRANS))
    head = F.struct("event_type", "ts_ns")
    rows = rows.withColumn("old", F.last(F.when(~again, head), ignorenulls=True).over(before))
    rows = rows.withColumn("was", F.coalesce(F.col("old.event_type") == W.START, F.lit(False)))
    rows = rows.withColumn("due", F.col("was") & (F.col("ts_ns") >= W.expiry_tick("old.ts_ns", max_age_s)))
    # a flow that one of its own retransmissions has let go is gone for the rows after it as well
    seen = F.when(start, F.when(F.col("fresh") == 1, 0).otherwise(F.col("retrans_count"))).when(again & F.col("was") & ~F.col("due"), F.col("retrans_count"))
    rows = rows.withColumn("seen", seen.cast("long")).withColumn("retrans", F.last("seen", ignorenulls=True).over(before))
    rows = rows.withColumn("retrans_after", F.last("seen", ignorenulls=True).over(so_far)).withColumn("last", F.lead("ts_ns").over(order).isNull())
    rows = rows.withColumn("turn", F.sum((~again).cast("int")).over(so_far))
    rows = rows.withColumn("gone_before", F.coalesce(F.max(F.when(again & F.col("due"), F.col("turn"))).over(before) == F.col("turn") - F.when(again, 0).otherwise(1), F.lit(False)))
    result = lambda kind, begun, over, sent, count: F.struct(*KEY, F.lit(kind).alias("kind"), begun.alias("start_ts"), over.alias("end_ts"), sent.alias("bytes_sent"), count.alias("retrans_count"))
    no_time, none = F.lit(None).cast("long"), F.lit(0).cast("long")
    leaves = F.when(F.col("due") & ~F.col("gone_before"), result("expired", F.col("old.ts_ns"), no_time, none, F.col("retrans")))
    matched = F.col("was") & ~F.col("due") & ~F.col("gone_before")
    closes = F.when(end & matched, result("matched", F.col("old.ts_ns"), F.col("ts_ns"), F.col("bytes_sent"), F.col("retrans_count"))).when(end, result("orphan", no_time, F.col("ts_ns"), F.col("bytes_sent"), F.col("retrans_count")))
    begun = F.when(start, F.col("ts_ns")).when(again & F.col("was") & ~F.col("due") & ~F.col("gone_before"), F.col("old.ts_ns"))
    rows = rows.withColumn("begun", F.when(F.col("last"), begun))
    over = F.floor(W.expiry_tick("begun", max_age_s) / 1_000_000) <= F.lit(mark)
    at_end = F.when(F.col("begun").isNotNull() & over, result("expired", F.col("begun"), no_time, none, F.col("retrans_after")))
    still = F.when(F.col("begun").isNotNull() & ~F.coalesce(over, F.lit(False)), F.struct(*KEY, F.col("begun").alias("start_ts"), F.col("retrans_after").alias("retrans_count")))
    done = F.filter(F.array(leaves, closes, at_end), lambda x: x.isNotNull())
    split(carried, rows.select(done.alias("done"), still.alias("still")), batch, MATCHED, OPEN)


def reconstruct_batch(carried: Carried, hooks: DataFrame, batch: int, ttl_s: int | None = None, delay_s: int = 120) -> None:
    """Closed connections of a batch, as socket_machine gives them; rows are late only where connections have an age."""
    fresh, mark = in_time(carried, hooks, batch, delay_s)
    hooks = fresh if ttl_s else hooks
    sums = ["established_ts", "bytes_sent", "packets_sent", "retrans_count", "rst_count"]
    kept = carried.load("open", batch - 1, UNCLOSED).select("sock", F.col("syn_ts").alias("ts_ns"), F.lit("tcp_connect").alias("hook"), F.lit(0).cast("long").alias("arg"), F.lit(0).alias("fresh"), *sums)
    rows = kept.unionByName(hooks.select("sock", "ts_ns", "hook", "arg", F.lit(1).alias("fresh")), allowMissingColumns=True)
    lives = W.lives_of(rows, ["fresh", *W.HOOK_ORDER])
    connect, close, up = W.is_hook("tcp_connect"), W.is_hook("tcp_set_state", W.CLOSE), W.is_hook("tcp_set_state", W.ESTABLISHED)
    stamp = lambda hit: F.min(F.when(hit, F.col("ts_ns")))
    total = lambda name, add: F.sum(F.coalesce(F.col(name), F.lit(0)) + add).alias(name)
    one = lambda name: W.is_hook(name).cast("long")
    found = lives.groupBy("sock", "life").agg(
        stamp(connect).alias("syn_ts"),
        F.coalesce(F.max("established_ts"), stamp(up)).alias("established_ts"),
        stamp(close).alias("close_ts"),
        total("bytes_sent", F.when(W.is_hook("tcp_sendmsg"), F.col("arg")).otherwise(0)),
        total("packets_sent", one("tcp_sendmsg")),
        total("retrans_count", one("tcp_retransmit_skb")),
        total("rst_count", one("tcp_send_active_reset")),
        F.max("later").alias("later"),
    )
    left = F.expr(f"syn_ts div 1000000 + {ttl_s * 1000}") <= F.lit(mark) if ttl_s else F.lit(False)
    closed = F.when(F.col("close_ts").isNotNull(), F.struct(*[x.strip().split(" ")[0] for x in FLOWS.split(",")]))
    stays = F.col("close_ts").isNull() & F.col("later").isNull() & ~F.coalesce(left, F.lit(False))
    still = F.when(stays, F.struct(*[x.strip().split(" ")[0] for x in UNCLOSED.split(",")]))
    split(carried, found.select(F.array_compact(F.array(closed)).alias("done"), still.alias("still")), batch, FLOWS, UNCLOSED)


def by_tables(stream: DataFrame, path: str, take, **options):
    """A query over a stream that takes each micro-batch by tables (match_batch, reconstruct_batch) under path."""
    spark, trigger = stream.sparkSession, options.pop("trigger", {"processingTime": "15 seconds"})

    def each(batch: DataFrame, number: int) -> None:
        take(Carried(spark, path), batch, number, **options)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(**trigger).start()


def done_of(spark, path: str, schema: str) -> DataFrame:
    return Carried(spark, path).all("done", schema)
