"""Alert rules over a stream of samples, with the state of each alert carried from batch to batch.

A batch evaluates every rule at the points of its interval that have come since the batch before, over the samples of
the longest range that any rule looks back. An alert is inactive, pending since a point, or firing; what is active at
a batch's last point is carried. Rows of active alerts and changes of state are written once for each batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.plans import rules as R
from flowloom.plans import vectors as V
from flowloom.plans.panels import evaluate
from flowloom.streaming.carried import Carried

SAMPLES = "name string, labels map<string,string>, ts_s long, value double"
ACTIVE = "alert string, labels map<string,string>, t long, active_since long"
ALERTS = "alert string, labels map<string,string>, t long, value double, state string, active_since long, severity string, description string"
CHANGES = "alert string, labels map<string,string>, t long, state string"


def looks_back(expression: tuple) -> int:
    """The longest range of an expression in seconds."""
    kind, *args = expression
    if kind in ("rate", "increase"):
        return args[1]
    return max([V.LOOKBACK_S if kind == "instant" else 0, *[looks_back(a) for a in args if isinstance(a, tuple)]])


def changes(rows: DataFrame, rule: R.Rule, last: int) -> DataFrame:
    """alert, labels, t, state at which alerts (rows of one rule: labels, t, state, active_since) change, up to the point last."""
    order = Window.partitionBy("series", "active_since").orderBy("t")
    rows = rows.withColumn("series", V.key())
    rows = rows.withColumn("before", F.lag("state").over(order)).withColumn("after", F.lead("t").over(order))
    begun = F.when((F.col("t") == F.col("active_since")) | (F.col("state") != F.col("before")), F.struct("t", "state"))
    over = F.when(F.col("after").isNull() & (F.col("t") < last), F.struct((F.col("t") + rule.interval_s).alias("t"), F.lit("inactive").alias("state")))
    return rows.select(F.lit(rule.name).alias("alert"), "labels", F.inline(F.filter(F.array(begun, over), lambda x: x.isNotNull())))


def evaluate_batch(carried: Carried, samples: DataFrame, batch: int, rules: dict[str, R.Rule]) -> None:
    span = max(looks_back(r.expression) for r in rules.values())
    was = carried.load("until", batch - 1, "until long").first()
    was = was[0] if was else None
    kept = carried.load("recent", batch - 1, SAMPLES).unionByName(samples.select("name", "labels", "ts_s", "value"))
    now = kept.agg(F.max("ts_s")).first()[0]
    if now is None:
        now = was
    longest = max(r.interval_s for r in rules.values())
    needed = kept if was is None else kept.where(F.col("ts_s") > was - span - longest)
    rows = carried.save(needed, "window", batch)
    before = carried.load("active", batch - 1, ACTIVE)
    alerts, active, changed = [], [], []
    for rule in rules.values():
        vector = V.compare(evaluate(rows, rule.expression, rule.interval_s, now), rule.op, rule.threshold)
        if was is not None:
            vector = vector.where(F.col("t") > was)
        mine = before.where(F.col("alert") == rule.name)
        found = R.held(vector, rule.hold_s, rule.interval_s, mine)
        last = now // rule.interval_s * rule.interval_s if now is not None else 0
        alerts.append(R.described(found.where("fresh"), rule))
        active.append(found.where(F.col("t") == last).select(F.lit(rule.name).alias("alert"), "labels", "t", "active_since"))
        changed.append(changes(found, rule, last).where(F.lit(was is None) | (F.col("t") > F.lit(was))))
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    carried.save(union(alerts), "alerts", batch, keep=True)
    carried.save(union(changed), "changes", batch, keep=True)
    carried.save(union(active), "active", batch)
    carried.save(rows.where(F.col("ts_s") > F.lit(now) - span), "recent", batch)
    carried.save(carried.spark.createDataFrame([(now,)], "until long").where("until is not null"), "until", batch)


def rules_stream(samples: DataFrame, path: str, rules: dict[str, R.Rule] = R.RULES, **trigger):
    """A query that evaluates rules over a stream of samples (name, labels, ts_s, value), in order of time.

    A batch must hold all samples of its last moment, as a snapshot does. alerts_of and changes_of read what it wrote.
    """
    spark = samples.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        evaluate_batch(Carried(spark, path), batch, number, rules)

    writer = samples.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def alerts_of(spark, path: str) -> DataFrame:
    return Carried(spark, path).all("alerts", ALERTS)


def changes_of(spark, path: str) -> DataFrame:
    return Carried(spark, path).all("changes", CHANGES)
