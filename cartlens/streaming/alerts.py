"""Alerts raised on the stream: closed minutes meet a state that holds the look-back and how long each rule is broken.

The state is one group: the counts of the last _LOOKBACK_MINUTES and one number per rule, whatever the traffic, and it
receives one row per minute. Minutes without a row count as silent once a later one has closed. A restart goes on with the
state of the last run.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cartlens.operators import monitoring as m
from cartlens.session import ship_package
from cartlens.streaming.monitors import watermarked, write_closed_windows

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_BUCKETS = [f"le_{i}" for i in range(len(m.LATENCY_BOUNDS))] + ["le_all"]
_COUNTS = ["requests", "clicks", "transactions", "revenue", "errors", *_BUCKETS]
_SILENT = [0.0 if name == "revenue" else 0 for name in _COUNTS]
_RECENT, _BEFORE = (4, 0), (119, 60)  # minutes back, both ends included
_KEPT = _BEFORE[0] + 1
_RULES = (
    ("ctr_drop", m.LONG_HOLD_MIN),
    ("conversion_drop", m.LONG_HOLD_MIN),
    ("revenue_drop", m.LONG_HOLD_MIN),
    ("error_ratio", m.SHORT_HOLD_MIN),
    ("latency_p95", m.SHORT_HOLD_MIN),
    ("low_request_rate", m.LONG_HOLD_MIN),
)
FIRED = "alert string, minute bigint, value double, threshold double"


def _quantile(q: float, upto: list[int], total: int) -> float | None:
    """Like ``monitoring.histogram_quantile``, of plain numbers."""
    if total <= 0:
        return None
    low, below = 0.0, 0
    for bound, n in zip(m.LATENCY_BOUNDS, upto, strict=True):
        if n >= total * q:
            return low + (bound - low) * (total * q - below) / (n - below) if n > below else None
        low, below = bound, n
    return float(m.LATENCY_BOUNDS[-1])


def _share(top: float, bottom: float) -> float | None:
    return top / bottom if bottom > 0 else None


class Watch:
    """The last minutes, and for how many of them in a row each rule has been broken."""

    def __init__(self, saved: str | None = None) -> None:
        now = json.loads(saved) if saved else {"last": None, "rows": [], "held": [0] * len(_RULES)}
        self.last: int | None = now["last"]
        self.rows: deque[list[float]] = deque(now["rows"], maxlen=_KEPT)
        self.held: list[int] = now["held"]

    def saved(self) -> str:
        return json.dumps({"last": self.last, "rows": list(self.rows), "held": self.held})

    def _sums(self, first: int, last: int) -> dict[str, float]:
        rows = list(self.rows)[max(len(self.rows) - first - 1, 0) : max(len(self.rows) - last, 0)]
        return dict(zip(_COUNTS, (sum(column) for column in zip(*rows, strict=True)), strict=True)) if rows else dict.fromkeys(_COUNTS, 0)

    def judge(self) -> list[tuple[float | None, float | None, bool]]:
        """Value, threshold and whether it is broken now, for every rule."""
        now, before = self._sums(*_RECENT), self._sums(*_BEFORE)
        out: list[tuple[float | None, float | None, bool]] = []
        full = len(self.rows) > _BEFORE[1]
        drops = [(_share(now[c], now["requests"]), _share(before[c], before["requests"])) for c in ("clicks", "transactions")]
        drops.append((now["revenue"] / 300.0, before["revenue"] / 3600.0 if full else None))
        for value, base in drops:
            limit = None if base is None else base * m.DROP_FACTOR
            out.append((value, limit, value is not None and limit is not None and value < limit))
        errors, rate = _share(now["errors"], now["requests"]), now["requests"] / 300.0
        p95 = _quantile(0.95, [int(now[b]) for b in _BUCKETS[:-1]], int(now["le_all"]))
        out.append((errors, m.MAX_ERROR_RATIO, errors is not None and errors > m.MAX_ERROR_RATIO))
        out.append((p95, m.MAX_P95_S, p95 is not None and p95 > m.MAX_P95_S))
        out.append((rate, m.MIN_REQUEST_RATE, rate < m.MIN_REQUEST_RATE))
        return out

    def add(self, minute: int, counts: list[float]) -> Iterator[tuple[str, int, float | None, float | None]]:
        """Take a closed minute, after the silent ones before it; give the alerts that fire."""
        silent = range(self.last + 1, minute) if self.last is not None else range(0)
        for at in (*silent, minute):
            self.last = at
            self.rows.append(counts if at == minute else _SILENT)
            for k, ((name, hold), (value, limit, broken)) in enumerate(zip(_RULES, self.judge(), strict=True)):
                self.held[k] = self.held[k] + 1 if broken else 0
                if self.held[k] >= hold:
                    yield name, at, value, limit


class AlertProcessor(StatefulProcessor):
    """The state of the one group is a ``Watch``; every batch brings the minutes that have closed since the last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("watch", "saved string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        watch = Watch(self.state.get()[0] if self.state.exists() else None)
        closed = pd.concat(list(rows)).sort_values("minute")  # one row per closed minute
        fired = [alert for row in closed[["minute", *_COUNTS]].itertuples(index=False) for alert in watch.add(int(row[0]), [float(x) for x in row[1:]])]
        self.state.update((watch.saved(),))
        yield pd.DataFrame(fired, columns=["alert", "minute", "value", "threshold"]).astype({"value": "float64", "threshold": "float64"})

    def close(self) -> None:
        pass


def stream_alerts(log: DataFrame) -> DataFrame:
    """(alert, minute, value, threshold) as minutes close; the streaming form of ``monitoring.alerts``."""
    ship_package(log.sparkSession)
    minutes = m.minute_windows(watermarked(log)).withColumn("one", F.lit(0))
    return minutes.groupBy("one").transformWithStateInPandas(AlertProcessor(), FIRED, "Append", "None")


def write_alerts(log: DataFrame, path: str, available_now: bool = False) -> StreamingQuery:
    """Append alerts to parquet; a restart goes on where the last run ended. The state needs the RocksDB store."""
    conf = log.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return write_closed_windows(stream_alerts(log), path, available_now=available_now)
    finally:
        conf.set(_PROVIDER, before) if before else conf.unset(_PROVIDER)
