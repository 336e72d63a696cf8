"""Matching of flows as keyed state with a timer for each open flow.

The state of a five-tuple is its open flow (a value) and, in the mode that holds, the ENDs that have no open flow yet
(a list). A flow's timer is its expiry tick in event time. Without hold an END without an open flow is an orphan at
once, as in the order of arrival; with hold it waits until the watermark has passed it, for a START that is late.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowloom.operators.flows import END, MAX_AGE_S, RETRANS, START, TUPLE

MATCHED = "saddr long, daddr long, sport int, dport int, protocol int, kind string, start_ts long, end_ts long, bytes_sent long, retrans_count long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Result = Row(*[x.strip().split(" ")[0] for x in MATCHED.split(",")])


class FlowMachine(StatefulProcessor):
    def __init__(self, max_age_s: int, hold: bool):
        self.age_ns, self.hold = max_age_s * 1_000_000_000, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start_ts long, retrans long")
        self.held = handle.getListState("held", "ts_ns long, seq long, bytes_sent long, retrans_count long")

    def tick(self, start: int) -> int:
        """When a flow leaves for its age (see flows.expiry_tick)."""
        return ((start + self.age_ns) // self.age_ns + 1) * self.age_ns

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        flow = tuple(self.open.get()) if self.open.exists() else None
        held = sorted(tuple(h) for h in self.held.get()) if self.hold else []
        waiting, old = list(held), flow
        for e in sorted(rows, key=lambda e: (e.ts_ns, e.seq)):
            if flow and e.ts_ns >= self.tick(flow[0]):
                yield Result(*key, "expired", flow[0], None, 0, flow[1])
                flow = None
            if e.event_type == START:
                flow = (e.ts_ns, 0)
                late = next((h for h in held if e.ts_ns <= h[0] < self.tick(e.ts_ns)), None)
                if late:
                    held.remove(late)
                    yield Result(*key, "matched", e.ts_ns, late[0], late[2], late[3])
                    flow = None
            elif e.event_type == RETRANS and flow:
                flow = (flow[0], e.retrans_count)
            elif e.event_type == END and flow:
                yield Result(*key, "matched", flow[0], e.ts_ns, e.bytes_sent, e.retrans_count)
                flow = None
            elif e.event_type == END and self.hold:
                held = sorted([*held, (e.ts_ns, e.seq, e.bytes_sent, e.retrans_count)])
                self.handle.registerTimer(e.ts_ns // 1_000_000 + 1)
            elif e.event_type == END:
                yield Result(*key, "orphan", None, e.ts_ns, e.bytes_sent, e.retrans_count)
        if held != waiting:
            self.held.put(held) if held else self.held.clear()
        if flow == old:
            return
        if old and (not flow or flow[0] != old[0]):
            self.handle.deleteTimer(self.tick(old[0]) // 1_000_000)
        if flow:
            self.open.update(flow)
            if not old or flow[0] != old[0]:
                self.handle.registerTimer(self.tick(flow[0]) // 1_000_000)
        else:
            self.open.clear()

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if self.open.exists():
            start, retrans = self.open.get()
            if self.tick(start) // 1_000_000 <= now:
                self.open.clear()
                yield Result(*key, "expired", start, None, 0, retrans)
        if self.hold:
            held = sorted(tuple(h) for h in self.held.get())
            over = [h for h in held if h[0] // 1_000_000 < now]
            if over:
                rest = held[len(over) :]
                self.held.put(rest) if rest else self.held.clear()
                for ts_ns, _, sent, count in over:
                    yield Result(*key, "orphan", None, ts_ns, sent, count)

    def close(self) -> None:
        pass


def match_flows_stream(tcp: DataFrame, max_age_s: int = MAX_AGE_S, delay: str = "2 minutes", hold: bool = False) -> DataFrame:
    """Matched, orphan and expired flows as they happen; the session gets the RocksDB state store, which timers need."""
    from flowloom.streaming.jobs import timed

    tcp.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = timed(tcp.where(F.col("event_type").isin(START, END, RETRANS)), delay)
    rows = rows.select(*TUPLE, "protocol", "event_type", "ts_ns", "seq", "bytes_sent", "retrans_count", "ts")
    return rows.groupBy(*TUPLE, "protocol").transformWithState(FlowMachine(max_age_s, hold), MATCHED, "Append", "EventTime")
