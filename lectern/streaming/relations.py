"""Relationships between nodes as state: the latest change of each edge, kept through restarts, and given up when stale.

A key is (src, dst, edge_type). Its state is the latest change (a value) and the times of all changes of the retention (a
map). A timer in event time, retention after the latest change, tells that an edge has gone stale: it is reported as
expired, and its state goes. A batch table of relationships may be the state to begin with.

  in order   a change later than the latest one becomes the latest and is reported, if it changes something: an Added edge
             that lives already only puts its expiry off, a Removed one that is gone only counts
  at once    of changes at the same time the one that comes last in (change, label) stands, whatever order they come in
  late       a change earlier than the latest is remembered as seen and changes nothing; one before the watermark is
             dropped by Spark before it gets here
  repeated   a change at a time that was seen with the same kind and label changes nothing
  null       a change without src, dst, edge_type or at has no key or no time and is left out

At the end of a stream what is live is what graph.latest_relationships says of the same changes as a table, less what has
expired. The session needs the RocksDB state store (STORE).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
REPORT = "src string, dst string, edge_type string, label string, live boolean, reason string, at timestamp"
KEY = ["src", "dst", "edge_type"]


class Relationships(StatefulProcessor):
    """The processor of one key; retention in milliseconds."""

    def __init__(self, retention: int) -> None:
        self.retention = retention

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "at long, change string, label string, live boolean")
        self.seen = handle.getMapState("seen", "at long", "said string")

    def _take(self, at: int, change: str, label: str | None) -> str | None:
        """Take a change in; why it is to be reported, or None."""
        said = f"{change} {label or ''}"
        known = self.seen.getValue((at,))[0] if self.seen.containsKey((at,)) else None
        if known is not None and known >= said:
            return None
        self.seen.updateValue((at,), (said,))
        then = self.latest.get() if self.latest.exists() else None
        if then is not None and at < then[0]:
            return None
        live = change != "Removed"
        self.latest.update((at, change, label, live))
        if then is None or at != then[0]:
            if then is not None:
                self.handle.deleteTimer(then[0] + self.retention)
            self.handle.registerTimer(at + self.retention)
        if then is None:
            return "added" if live else None
        return ("added" if live else "removed") if live != then[3] else "changed" if live and label != then[2] else None

    def _report(self, key: tuple, reason: str) -> pd.DataFrame:
        at, _, label, live = self.latest.get()
        row = (*key, label, live and reason != "expired", reason, pd.Timestamp(at, unit="ms"))
        return pd.DataFrame([row], columns=[c.split()[0] for c in REPORT.split(", ")])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reason = None
        for batch in rows:
            batch = batch.sort_values(["at", "change", "label"], na_position="first", kind="stable")
            for at, change, label in zip(batch["at"], batch["change"], batch["label"], strict=True):
                reason = self._take(int(at.value // 1_000_000), change, None if pd.isna(label) else label) or reason
        watermark = timerValues.getCurrentWatermarkInMs()
        if self.seen.exists():
            for (at,) in [k for k in self.seen.keys() if k[0] + self.retention < watermark]:
                self.seen.removeKey((at,))
        if reason:
            yield self._report(key, reason)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.latest.exists() and self.latest.get()[0] + self.retention <= expiredTimerInfo.getExpiryTimeInMs():
            if self.latest.get()[3]:
                yield self._report(key, "expired")
            self.latest.clear()
            self.seen.clear()

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for at, label in zip(initialState["at"], initialState["label"], strict=True):
            self._take(int(at.value // 1_000_000), "Added", None if pd.isna(label) else label)

    def close(self) -> None:
        pass


def relationships(stream: DataFrame, late: str = "1 hour", retention: str = "30 days", before: DataFrame | None = None) -> DataFrame:
    """REPORT rows of a stream of changes (src, dst, edge_type, change, at, label) as edges come to live, change, go or
    expire. before: live relationships (src, dst, edge_type, label, at) to begin with."""
    spark = stream.sparkSession
    if spark.conf.get(STORE[0]) != STORE[1]:
        raise ValueError(f"set {STORE[0]} to {STORE[1]}")
    kept = stream.select(*KEY, "change", "at", "label").where(" AND ".join(f"{c} IS NOT NULL" for c in [*KEY, "at", "change"]))
    first = before.select(*KEY, "label", "at").groupBy(*KEY) if before is not None else None
    span = int(pd.Timedelta(retention).total_seconds() * 1000)
    return kept.withWatermark("at", late).groupBy(*KEY).transformWithStateInPandas(Relationships(span), REPORT, "append", "eventTime", first)


def live(reports: DataFrame) -> DataFrame:
    """(src, dst, edge_type, label, at): what lives after reports, rows of a stream's output with their order (batch)."""
    last = reports.groupBy(*KEY).agg(F.max_by(F.struct("label", "live", "at"), F.struct("batch", "at")).alias("last"))
    return last.select(*KEY, "last.*").where("live").drop("live")
