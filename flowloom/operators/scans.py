"""Running values along a key: one window where a key fits a task, or slices of time where it may not.

In slices, each (key, slice) is a group of its own: it is reduced to one row, these rows (as many as slices, whatever
the key has) are made cumulative along the key, and what the other slices bring comes back into each slice as a row
before its first and one after its last. The rows themselves are exchanged once, by key and slice, and never joined, so
null keys stay keys. A key with half of all rows is spread over as many tasks as it has slices.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of a slice, in seconds. A key may have any number of slices; the rows of a key in one slice meet in one task.
SLICE_S = 3600
SLICE, PLACE, HELD = "scan_slice", "scan_place", "scan_of_"
HEAD, ROW, TAIL = 0, 1, 2


class Run(NamedTuple):
    """sum, min, max or last of value over the rows so far, or next: the first after. Nulls say nothing.

    own: whether the row itself counts.
    """

    kind: str
    value: Column
    own: bool = True


def over_rows(kind: str, name: str, keys: list[str], order: list[str], own: bool) -> Column:
    """A run over the column name. next looks ahead along the same order, so that rows are sorted once."""
    if kind == "next":
        by = f"partition by {', '.join(f'`{k}`' for k in keys)} " if keys else ""
        after = f"lead(`{name}`) ignore nulls over ({by}order by {', '.join(f'`{c}`' for c in order)})"
        return F.expr(f"coalesce(`{name}`, {after})" if own else after)
    reduce = {"sum": F.sum, "min": F.min, "max": F.max}.get(kind, lambda v: F.last(v, ignorenulls=True))
    return reduce(F.col(name)).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1))


def of_a_slice(kind: str, value: Column, place: Column) -> Column:
    seen = F.when(value.isNotNull(), place)
    return {"sum": F.sum, "min": F.min, "max": F.max, "last": lambda v: F.max_by(v, seen), "next": lambda v: F.min_by(v, seen)}[kind](value)


def edges(held: DataFrame, keys: list[str], order: list[str], runs: dict[str, Run]) -> DataFrame:
    """For each slice of a key, what the slices before it (place HEAD) and after it (place TAIL) bring, if anything."""
    slices = held.groupBy(*keys, SLICE).agg(*[of_a_slice(r.kind, F.col(HELD + n), F.struct(*order)).alias(HELD + n) for n, r in runs.items()])
    out = None
    for place, wanted in ((HEAD, lambda kind: kind != "next"), (TAIL, lambda kind: kind == "next")):
        names = [HELD + n for n, r in runs.items() if wanted(r.kind)]
        if names:
            brought = [over_rows(r.kind, HELD + n, keys, [SLICE], own=False).alias(HELD + n) for n, r in runs.items() if wanted(r.kind)]
            rows = slices.select(*keys, SLICE, F.lit(place).alias(PLACE), *brought).where(F.coalesce(*[F.when(F.col(n).isNotNull(), True) for n in names], F.lit(False)))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def running(rows: DataFrame, keys: list[str], order: list[str], runs: dict[str, Run], slice_s: int | None = None, parts: int | None = None) -> DataFrame:
    """rows with a column for each run. The order begins with ts_ns, by which slices are cut; slice_s None means one window a key.

    parts, if given, is the number of tasks that slices are dealt over, whatever their rows compress to.
    """
    held = rows.select("*", *[r.value.alias(HELD + n) for n, r in runs.items()])
    keys, order = list(keys), list(order)
    if slice_s:
        held = held.select("*", F.expr(f"ts_ns div {slice_s}000000000").alias(SLICE), F.lit(ROW).alias(PLACE))
        held = held.unionByName(edges(held, keys, order, runs), allowMissingColumns=True)
        keys, order = [*keys, SLICE], [PLACE, *order]
        if parts:
            held = held.repartition(parts, *keys)
    out = held.select("*", *[over_rows(r.kind, HELD + n, keys, order, own=r.own).alias(n) for n, r in runs.items()])
    if slice_s:
        out = out.where(F.col(PLACE) == ROW)
    return out.select(*rows.columns, *runs)
