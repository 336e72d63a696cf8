"""Snapshots of all TCP families from a stream of events.

A batch matches its events with the flows that are still open, adds what it brings to each slot, and writes the
snapshots of the slots that are complete. Carried are the open flows, the totals at the last complete slot, and the
sums of the slot that is not complete yet, so the state is as large as the open flows. Events must come in order of
time from batch to batch; ``finish`` writes the last slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import flows as W
from flowloom.operators import metrics as M
from flowloom.schemas import EVENTS
from flowloom.streaming.carried import Carried

HISTORY = "name string, labels map<string,string>, ts_s long, value double"
STATES = "slot long, state string, d double"
MARKS = "until_ns long, complete_s long"


def merged(wide: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums of several batches, one row a slot; of last values the latest batch's. wide has the batch's number n."""
    last = {f[0] for f in M.TCP_LAST}
    columns = [c for c in wide.columns if c not in ("slot", "n")]
    each = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("n"))).alias(c) if c in last else F.sum(f"`{c}`").alias(c) for c in columns]
    return wide.groupBy("slot").agg(*each), states.groupBy("slot", "state").agg(F.sum("d").alias("d"))


def closed(carried: Carried, wide: DataFrame, states: DataFrame, batch: int, upto: int, since: int | None) -> None:
    """Writes the snapshots after since up to upto, and carries the totals at upto and the sums after it."""
    past, later = F.col("slot") <= upto, F.col("slot") > upto
    grid = carried.spark.range(1).select(F.explode(F.sequence(F.lit(since if since is not None else wide.agg(F.min("slot")).first()[0]), F.lit(upto), F.lit(M.SCRAPE_S))).alias("slot")) if wide.where(past).limit(1).count() else None
    if grid is not None:
        rows = M.history_of(wide.where(past), states.where(past), grid.withColumn("slot", F.col("slot").cast("long")))
        rows = rows if since is None else rows.where(F.col("ts_s") > since)
        carried.save(rows, "history", batch, keep=True)
    else:
        carried.save(carried.spark.createDataFrame([], HISTORY), "history", batch, keep=True)
    total, total_states = merged(wide.where(past).withColumn("n", F.col("slot")).withColumn("slot", F.lit(upto).cast("long")), states.where(past).withColumn("slot", F.lit(upto).cast("long")))
    carried.save(as_stored(total.unionByName(wide.where(later))), "sums", batch)
    carried.save(total_states.unionByName(states.where(later)), "states", batch)


def as_stored(wide: DataFrame) -> DataFrame:
    return wide.toDF(*[f"c{k}" for k in range(len(wide.columns))])


def no_sums(spark) -> DataFrame:
    """An empty table of sums by slot."""
    return M.slot_sums(W.match_flows(spark.createDataFrame([], EVENTS["tcp"])))[0]


def take_batch(carried: Carried, events: DataFrame, batch: int) -> None:
    marks = carried.load("marks", batch - 1, MARKS).first()
    events = events.withColumn("fresh", F.lit(True))
    if not events.limit(1).count():
        for name, schema in (("open", events.schema), ("states", STATES), ("marks", MARKS)):
            carried.save(carried.load(name, batch - 1, schema), name, batch)
        carried.save(carried.load("sums", batch - 1, as_stored(no_sums(carried.spark)).schema), "sums", batch)
        carried.save(carried.spark.createDataFrame([], HISTORY), "history", batch, keep=True)
        return
    kept = carried.load("open", batch - 1, events.schema)
    until = events.agg(F.max("ts_ns")).first()[0]
    matched = carried.save(W.match_flows(kept.unionByName(events), W.MAX_AGE_S), "matched", batch)
    fresh = W.with_expiries(matched, until).where(f"fresh or event_type = {W.EXPIRED}")
    wide, states = M.slot_sums(fresh)
    names = wide.columns
    old = carried.load("sums", batch - 1, as_stored(wide).schema).toDF(*names)
    wide, states = merged(wide.withColumn("n", F.lit(1)).unionByName(old.withColumn("n", F.lit(0))), states.unionByName(carried.load("states", batch - 1, STATES)))
    wide, states = carried.save(as_stored(wide), "wide", batch).toDF(*names), carried.save(states, "wide-states", batch)
    # the last slot may get more events
    upto = -(-until // (M.SCRAPE_S * 1_000_000_000)) * M.SCRAPE_S - M.SCRAPE_S
    since = marks.complete_s if marks else None
    upto = upto if since is None else max(upto, since)
    closed(carried, wide, states, batch, upto, since)
    ends = matched.where(F.col("event_type").isin(W.START, W.END))
    last = ends.groupBy(*W.TUPLE, "protocol").agg(F.max_by(F.struct(*ends.columns), F.struct("ts_ns", "seq")).alias("r")).select("r.*")
    still = last.where((F.col("event_type") == W.START) & (F.col("expired_ts") > until)).withColumn("fresh", F.lit(False))
    carried.save(still.select(events.columns), "open", batch)
    carried.save(carried.spark.createDataFrame([(until, upto if wide.where(F.col("slot") <= upto).limit(1).count() else None)], MARKS), "marks", batch)


def snapshots_stream(tcp: DataFrame, path: str, **trigger):
    """A query that writes snapshots of all families of a stream of TCP events; history reads them."""
    spark = tcp.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        take_batch(Carried(spark, path), batch, number)

    return tcp.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint").trigger(**(trigger or {"processingTime": "15 seconds"})).start()


def finish(spark, path: str) -> None:
    """Writes the snapshot of the last slot, once the stream is at its end."""
    carried = Carried(spark, path)
    batch = carried.last("marks")
    marks = carried.load("marks", batch, MARKS).first() if batch >= 0 else None
    if marks is None:
        return
    names = no_sums(spark)
    wide = carried.load("sums", batch, as_stored(names).schema).toDF(*names.columns)
    closed(carried, wide, carried.load("states", batch, STATES), batch + 1, -(-marks.until_ns // (M.SCRAPE_S * 1_000_000_000)) * M.SCRAPE_S, marks.complete_s)


def history(spark, path: str) -> DataFrame:
    return Carried(spark, path).all("history", HISTORY)
