"""Range and instant functions over samples (name, labels, ts_s, value); results are (labels, t, value).

A sample at ts belongs to the evaluation points t with t - range < ts <= t. A sample gives the points up to the next
sample of its series, for which it is the last; what is first in the range comes from one as-of lookup at t - range, in
the same stream of the series. Growth is a difference of running sums, so the length of a range costs little, and a
function is one exchange by series and day. Filters on name come first and reach the folders of a history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEP_S, LOOKBACK_S = 30, 300
#: A series is evaluated in slices of a day.
SLICE_S = 86400


def key(labels: str = "labels"):
    """Maps are no grouping keys; their sorted entries are."""
    return F.to_json(F.array_sort(F.map_entries(labels)))


def at_points(samples: DataFrame, name: str, range_s: int, step_s: int, end_s: int | None = None, only_last: bool = False, parts: int | None = None) -> DataFrame:
    """series, slice, labels, ts_s, value, i (number of the sample), resets (dropped by resets so far), first, next, points.

    points are the evaluation points at which the sample is the last one in the range; end_s is the last point of the
    grid (by default the time of the last sample of all families). A sample is in the slice of its day and in each later
    one that its range reaches, and a slice has the points of its own day only, so what a slice numbers and adds up
    from its own first sample says what the whole series would. parts, if given, is the number of tasks that slices are
    dealt over: samples compress to little, so their size on the way does not say how many a task can take.
    """
    mine = samples.where(F.col("name") == name)
    rows = mine.select("labels", "ts_s", "value")
    if only_last:
        end = mine.agg(F.expr(f"max(ts_s) div {step_s} * {step_s}").alias("end_s"))
    elif end_s is None:
        end = samples.agg(F.max("ts_s").alias("end_s"))
    rows = rows.withColumn("end_s", F.lit(end_s).cast("long")) if end_s is not None and not only_last else rows.join(F.broadcast(end))
    if only_last:
        rows = rows.where((F.col("ts_s") > F.col("end_s") - range_s) & (F.col("ts_s") <= F.col("end_s")))
    day = F.expr(f"ts_s div {SLICE_S}")
    rows = rows.select(key().alias("series"), "*", F.explode(F.sequence(day, F.expr(f"(ts_s + {range_s - 1}) div {SLICE_S}"))).alias("slice"))
    if parts and not only_last:
        rows = rows.repartition(parts, "series", "slice")
    order = Window.partitionBy("series", "slice").orderBy("ts_s")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("value").over(order)
    rows = rows.withColumn("reset", F.when(F.col("value") < before, before).otherwise(0.0))
    rows = rows.withColumn("resets", F.sum("reset").over(so_far)).withColumn("i", F.row_number().over(order))
    this = F.struct("ts_s", "value", "resets")
    rows = rows.withColumn("first", F.first(this).over(so_far)).withColumn("next", F.lead(this).over(order))
    least, most = F.col("slice") * SLICE_S, (F.col("slice") + 1) * SLICE_S - 1
    start = F.greatest(F.col("end_s"), least) if only_last else F.ceil(F.greatest("ts_s", least) / step_s).cast("long") * step_s
    stop = F.least(F.coalesce(F.col("next.ts_s"), F.col("end_s") + 1) - 1, F.col("ts_s") + range_s - 1, F.col("end_s"), most)
    points = F.when((start <= stop) & (start >= F.col("ts_s")), F.sequence(start, stop, F.lit(step_s).cast("long")))
    return rows.withColumn("points", F.coalesce(points, F.array().cast("array<bigint>"))).drop("reset", "end_s")


def increase(samples: DataFrame, name: str, range_s: int, step_s: int = STEP_S, only_last: bool = False, per_second: bool = False, end_s: int | None = None, parts: int | None = None) -> DataFrame:
    """Reset-corrected growth over the range, extrapolated to its ends; at least two samples."""
    rows = at_points(samples, name, range_s, step_s, end_s, only_last, parts)
    sample = F.array(F.struct(F.col("ts_s").alias("at"), F.lit(None).cast("long").alias("t")))
    points = F.transform("points", lambda t: F.struct((t - range_s).alias("at"), t.alias("t")))
    rows = rows.select("*", F.inline(F.concat(sample, points)))
    # samples come before the points of their moment: a sample at t - range is out of the range
    order = Window.partitionBy("series", "slice").orderBy("at", F.asc_nulls_first("t")).rowsBetween(Window.unboundedPreceding, 0)
    out = F.last(F.when(F.col("t").isNull(), F.struct("i", "next")), ignorenulls=True).over(order)
    g = rows.withColumn("out", out).where("t is not null").withColumn("f", F.coalesce("out.next", "first"))
    g = g.withColumn("n", F.col("i") - F.coalesce("out.i", F.lit(0))).where("n >= 2")
    g = g.selectExpr("labels", "t", "n", "f.value as f", "value - f.value + resets - f.resets as inc", "cast(ts_s - f.ts_s as double) as span", f"cast(f.ts_s - (t - {range_s}) as double) as ds", "cast(t - ts_s as double) as de")
    g = g.withColumn("avg", F.expr("span / (n - 1)"))
    g = g.withColumn("ds", F.expr("case when ds >= 1.1 * avg then avg / 2 else ds end")).withColumn("de", F.expr("case when de >= 1.1 * avg then avg / 2 else de end"))
    g = g.withColumn("ds", F.expr("case when inc > 0 and f >= 0 then least(ds, span * f / inc) else ds end"))
    value = "inc * (span + ds + de) / span" + (f" / {range_s}" if per_second else "")
    return g.select("labels", "t", F.expr(value).alias("value"))


def rate(samples: DataFrame, name: str, range_s: int, step_s: int = STEP_S, only_last: bool = False, end_s: int | None = None, parts: int | None = None) -> DataFrame:
    return increase(samples, name, range_s, step_s, only_last, True, end_s, parts)


def instant(samples: DataFrame, name: str, step_s: int = STEP_S, lookback_s: int = LOOKBACK_S, end_s: int | None = None, parts: int | None = None) -> DataFrame:
    """The last sample within the lookback."""
    return at_points(samples, name, lookback_s, step_s, end_s, parts=parts).select("labels", F.explode("points").alias("t"), "value")


def histogram_quantile(q: float, buckets: DataFrame) -> DataFrame:
    """Interpolated in the first bucket that reaches the rank; NaN for an empty histogram."""
    rows = buckets.withColumn("le", F.when(F.col("labels")["le"] == "+Inf", F.lit(float("inf"))).otherwise(F.expr("try_cast(labels['le'] as double)")))
    rows = rows.withColumn("labels", F.map_filter("labels", lambda k, _: k != "le")).withColumn("series", key())
    order = Window.partitionBy("series", "t").orderBy("le")
    rows = rows.withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("under", F.coalesce(F.lag("value").over(order), F.lit(0.0)))
    rows = rows.withColumn("total", F.max("value").over(Window.partitionBy("series", "t")))
    inside = "low + (le - low) * (cast({q} as double) * total - under) / nullif(value - under, 0)".format(q=q)
    at = F.min(F.when(F.col("value") >= F.lit(q) * F.col("total"), F.struct("le", F.expr(f"case when le = double('Infinity') then low else {inside} end").alias("v"))))
    g = rows.groupBy("series", "t").agg(F.any_value("labels").alias("labels"), F.max("total").alias("total"), at.alias("at"))
    return g.select("labels", "t", F.when(F.col("total") > 0, F.col("at.v")).otherwise(F.lit(float("nan"))).alias("value"))


def sum_by(vector: DataFrame, *names: str) -> DataFrame:
    """R8, G-A21"""
    kept = F.map_filter("labels", lambda k, _: k.isin(list(names)))
    rows = vector.withColumn("labels", kept).withColumn("series", key())
    return rows.groupBy("series", "t").agg(F.any_value("labels").alias("labels"), F.sum("value").alias("value")).select("labels", "t", "value")


def bucket_cells(vector: DataFrame) -> DataFrame:
    """What each bucket holds by itself, from cumulative values."""
    rows = vector.withColumn("le", F.when(F.col("labels")["le"] == "+Inf", F.lit(float("inf"))).otherwise(F.expr("try_cast(labels['le'] as double)")))
    rest = rows.withColumn("series", key("labels")).withColumn("series", F.to_json(F.array_sort(F.map_entries(F.map_filter("labels", lambda k, _: k != "le")))))
    order = Window.partitionBy("series", "t").orderBy("le")
    return rest.withColumn("value", F.col("value") - F.coalesce(F.lag("value").over(order), F.lit(0.0))).select("labels", "t", "value")


OPS = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    # a float division: x/0 is infinite and 0/0 is no number
    "/": lambda a, b: F.when(b != 0, F.try_divide(a, b)).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))),
}


def binary(op: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """One to one on equal labels and time; the rest is dropped."""
    a = left.select(key().alias("series"), "labels", "t", F.col("value").alias("a"))
    b = right.select(key().alias("series"), "t", F.col("value").alias("b"))
    return a.join(b, ["series", "t"]).select("labels", "t", OPS[op](F.col("a"), F.col("b")).alias("value"))


def scalar_op(op: str, vector: DataFrame, c: float) -> DataFrame:
    """R5, P26"""
    return vector.withColumn("value", OPS[op](F.col("value"), F.lit(float(c))))


def compare(vector: DataFrame, op: str, c: float) -> DataFrame:
    """The elements for which the comparison holds; never NaN."""
    v = F.col("value")
    hit = {">": v > c, ">=": v >= c, "<": v < c, "<=": v <= c, "==": v == c, "!=": v != c}[op]
    return vector.where(hit & ~F.isnan(v))


def select_labels(samples: DataFrame, **labels: str) -> DataFrame:
    """F11"""
    for k, v in labels.items():
        samples = samples.where(F.col("labels")[k] == v)
    return samples


def share(vector: DataFrame) -> DataFrame:
    """G-A22: percent of the sum at each time."""
    return vector.withColumn("value", F.expr("100 * value / nullif(sum(value) over (partition by t), 0)"))


def top_n(vector: DataFrame, n: int, *ties: str) -> DataFrame:
    """K1: a report, so the limit is the feature."""
    return vector.orderBy(F.desc("value"), *ties).limit(n)


def last_not_null(vector: DataFrame) -> DataFrame:
    """The last value of each series that is not null."""
    rows = vector.where("value is not null").withColumn("series", key())
    return rows.groupBy("series").agg(F.any_value("labels").alias("labels"), F.max("t").alias("t"), F.max_by("value", "t").alias("value")).drop("series")
