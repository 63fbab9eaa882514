"""Per-symbol state that follows bars across micro-batches in event time.

A symbol's bars wait in a list until the watermark has passed them and are folded in time order then, so a late bar counts where it
belongs, whichever batch brings it. What is kept of the past is of fixed size: the exponential mean, the last fourteen true ranges,
the last seven highs and lows, the standing swing levels, the direction of the last break, and two ratcheting stops. One event-time
timer per symbol wakes it up for its next waiting bar, or when it has been idle for too long: then it says so and is forgotten. A gap
of that length inside the data ends a symbol just the same, so results do not depend on how the stream was cut into batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Bars to each side of a swing, and true ranges in the average.
SWING, RANGES = 3, 14
#: The state store that timers and lists need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUT = ("symbol string, us long, close double, ema double, trail_stop double, atr_stop double, event string, break_dir string, "
       "swing_high double, swing_low double")


@dataclass
class Track:
    """What is known of a symbol after its last bar."""

    n: int = 0
    last_ts: int = 0
    ema: float = 0.0
    peak: float = float("-inf")
    stop: float = float("-inf")
    close: float = 0.0
    ranges: list[float] = field(default_factory=list)
    highs: list[float] = field(default_factory=list)
    lows: list[float] = field(default_factory=list)
    swing_high: float | None = None
    swing_low: float | None = None
    open_high: bool = False
    open_low: bool = False
    direction: str | None = None

    def step(self, ts: int, high: float, low: float, close: float, alpha: float, atr_mult: float) -> str | None:
        """Takes a bar in; returns the structure event that it makes."""
        self.ema = close if self.n == 0 else self.ema + alpha * (close - self.ema)
        true_range = high - low if self.n == 0 else max(high - low, abs(high - self.close), abs(low - self.close))
        self.ranges = [*self.ranges[-(RANGES - 1) :], true_range]
        self.peak = max(self.peak, close)
        self.stop = max(self.stop, close - atr_mult * sum(self.ranges) / len(self.ranges))
        self.highs, self.lows = [*self.highs[-2 * SWING :], high], [*self.lows[-2 * SWING :], low]
        self.n, self.last_ts, self.close = self.n + 1, ts, close
        if len(self.highs) == 2 * SWING + 1:
            h, lo, k = self.highs, self.lows, SWING
            if h[k] == max(h) and h[k] > h[k - 1] and h[k] > h[k + 1]:
                self.swing_high, self.open_high = h[k], True
            if lo[k] == min(lo) and lo[k] < lo[k - 1] and lo[k] < lo[k + 1]:
                self.swing_low, self.open_low = lo[k], True
        if self.open_high and close > self.swing_high:
            self.open_high, before, self.direction = False, self.direction, "bull"
            return "CHOCH_BULL" if before == "bear" else "BOS_BULL"
        if self.open_low and close < self.swing_low:
            self.open_low, before, self.direction = False, self.direction, "bear"
            return "CHOCH_BEAR" if before == "bull" else "BOS_BEAR"
        return None


_WAITING = "ts long, high double, low double, close double"
_STATE = T.StructType([T.StructField(f.name, {"ranges": T.ArrayType(T.DoubleType()), "highs": T.ArrayType(T.DoubleType()), "lows": T.ArrayType(T.DoubleType()), "n": T.LongType(), "last_ts": T.LongType(),
                                              "open_high": T.BooleanType(), "open_low": T.BooleanType(), "direction": T.StringType()}.get(f.name, T.DoubleType())) for f in fields(Track)])


class SymbolTracker(StatefulProcessor):
    """Folds each symbol's bars behind the watermark; ``idle_ms`` of 0 keeps symbols for ever. Times are in microseconds."""

    def __init__(self, span: int, trail_pct: float, atr_mult: float, idle_ms: int) -> None:
        self.alpha, self.trail_pct, self.atr_mult, self.idle_ms = 2 / (span + 1), trail_pct, atr_mult, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)
        self.track = handle.getValueState("track", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            self.waiting.appendList(list(zip(pdf["us"].tolist(), pdf["high"].tolist(), pdf["low"].tolist(), pdf["close"].tolist())))
        yield self._fold(key[0], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield self._fold(key[0], timerValues.getCurrentWatermarkInMs())

    def _fold(self, symbol: str, watermark_ms: int) -> pd.DataFrame:
        due, later = [], []
        for row in self.waiting.get():
            (due if row[0] <= watermark_ms * 1000 else later).append(tuple(row))
        track = Track(*(list(x) if isinstance(x, (list, tuple)) else x for x in self.track.get())) if self.track.exists() else Track()
        out: list[tuple] = []

        def expired_at(now_us: int) -> bool:
            return self.idle_ms > 0 and track.n > 0 and now_us - track.last_ts > self.idle_ms * 1000

        def say(ts: int, event: str | None) -> None:
            out.append((symbol, ts, track.close, track.ema, track.peak * (1 - self.trail_pct), track.stop, event, track.direction, track.swing_high, track.swing_low))

        for ts, high, low, close in sorted(due):
            if expired_at(ts):
                say(track.last_ts + self.idle_ms * 1000, "EXPIRED")
                track = Track()
            say(ts, track.step(ts, high, low, close, self.alpha, self.atr_mult))
        if not later and expired_at(watermark_ms * 1000):
            say(track.last_ts + self.idle_ms * 1000, "EXPIRED")
            track = Track()
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if track.n:
            self.track.update(tuple(getattr(track, f.name) for f in fields(Track)))
        elif self.track.exists():
            self.track.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if later:
            self.handle.registerTimer(min(later)[0] // 1000 + 1)
        elif self.idle_ms and track.n:
            self.handle.registerTimer(track.last_ts // 1000 + self.idle_ms + 1)
        columns = [c.split()[0] for c in OUT.split(", ")]
        return pd.DataFrame(out, columns=columns).astype({"us": "int64"} | {c: "float64" for c in columns if c not in ("symbol", "us", "event", "break_dir")})

    def close(self) -> None:
        pass


def track_structure(bars: DataFrame, span: int = 12, trail_pct: float = 0.05, atr_mult: float = 3.0, delay: str = "1 hour", max_idle_minutes: int = 0) -> DataFrame:
    """One row per closed bar of a stream (symbol, ts, high, low, close), in event time: exponential mean, stops that only rise (a share under
    the highest close, and ``atr_mult`` average ranges under the close), standing swing levels (known three bars late), structure breaks
    and their direction. Bars up to ``delay`` late still count in their place. With ``max_idle_minutes`` a symbol without a bar for longer than
    that gets an EXPIRED row and starts anew. The session's state store must be ROCKS (see ``stream.run_available``)."""
    from tickloom.streaming.stream import with_event_time

    d = with_event_time(bars.select("symbol", "ts", "high", "low", "close"), "ts", delay).withColumn("us", F.unix_micros("ts"))
    d = d.groupBy("symbol").transformWithStateInPandas(SymbolTracker(span, trail_pct, atr_mult, max_idle_minutes * 60_000), OUT, "Append", "EventTime")
    return d.select("symbol", F.timestamp_micros("us").alias("ts"), *[c.split()[0] for c in OUT.split(", ")[2:]])
