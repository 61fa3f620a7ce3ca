"""Alert rules on a stream, evaluated by event time: silence and held conditions fire without a new row.

Rows are counted per series and minute by a windowed aggregation first, so a busy series reaches its state as one row a
minute. The state of a series is the running count of its window and the minutes at which that count changes; a timer
stands at the next minute that can change the outcome, and between those minutes nothing is done.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallywatch.operators.monitor import rule_limits

_MINUTE_KEY = T.StructType([T.StructField("minute", T.LongType())])
_DELTA = T.StructType([T.StructField("delta", T.LongType())])
_RULE = T.StructType([
    T.StructField("total", T.LongType()), T.StructField("at", T.LongType()), T.StructField("since", T.LongType()),
    T.StructField("fired", T.BooleanType()), T.StructField("timer", T.LongType())])
_MINUTE_MS = 60_000


class WindowRule(StatefulProcessor):
    """One rule for each series: the count of the last ``length`` minutes within limits for ``hold`` minutes.

    ``at`` is the first minute not evaluated yet, ``since`` the start of the present span. A minute is evaluated once the
    watermark has passed its end, so rows in any order within the watermark's delay give the same alerts.
    """

    def __init__(self, series: Sequence[str], length: int, low: int, high: int | None, hold: int):
        self.series, self.length, self.low, self.high, self.hold = list(series), length, low, high, hold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.changes = handle.getMapState("changes", _MINUTE_KEY, _DELTA)
        self.rule = handle.getValueState("rule", _RULE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat([frame[["minute", "n"]] for frame in rows])
        total, at, since, fired, timer = self.rule.get() if self.rule.exists() else (0, int(seen["minute"].min()), None, False, None)
        changes = {k[0]: v[0] for k, v in self.changes.iterator()}
        for minute, n in zip(seen["minute"], seen["n"]):
            for when, delta in ((int(minute), int(n)), (int(minute) + self.length, -int(n))):
                when = max(when, at)
                changes[when] = changes.get(when, 0) + delta
        yield self._advance(key, timerValues, changes, (total, at, since, fired, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.rule.exists():
            total, at, since, fired, _ = self.rule.get()
            yield self._advance(key, timerValues, {k[0]: v[0] for k, v in self.changes.iterator()}, (total, at, since, fired, None))

    def _advance(self, key, timerValues, changes: dict[int, int], state) -> pd.DataFrame:
        """Evaluate all minutes that the watermark has passed, store what is left and set the next timer."""
        total, at, since, fired, timer = state
        last = timerValues.getCurrentWatermarkInMs() // _MINUTE_MS - 1
        out = []
        for point in [*sorted(c for c in changes if c <= last), last + 1]:
            if point > at:
                # The count is the same in all minutes from ``at`` to ``point - 1``.
                if total >= self.low and (self.high is None or total <= self.high):
                    since = at if since is None else since
                    if not fired and point - 1 - since >= self.hold:
                        fired = True
                        out.append(("firing", since, None))
                elif since is not None:
                    if fired:
                        out.append(("resolved", since, at - 1))
                    since, fired = None, False
                at = point
            if point <= last:
                total += changes.pop(point)
        self._store(changes, (total, at, since, fired), timer)
        frame = pd.DataFrame({name: pd.Series([value] * len(out), dtype="object") for name, value in zip(self.series, key)})
        frame["state"] = pd.Series([s for s, _, _ in out], dtype="object")
        frame["active_since"] = pd.Series([60 * s for _, s, _ in out], dtype="Int64")
        frame["firing_from"] = pd.Series([60 * (s + self.hold) for _, s, _ in out], dtype="Int64")
        frame["active_until"] = pd.Series([None if u is None else 60 * u for _, _, u in out], dtype="Int64")
        return frame

    def _store(self, changes: dict[int, int], state, timer: int | None) -> None:
        total, at, since, fired = state
        if timer is not None:
            self.handle.deleteTimer(timer)
        for stored in [k[0] for k, _ in self.changes.iterator()]:
            if stored not in changes:
                self.changes.removeKey((stored,))
        for minute, delta in changes.items():
            self.changes.updateValue((minute,), (delta,))
        waits = [min(changes)] if changes else []
        if since is not None and not fired:
            waits.append(max(since + self.hold, at))
        if not waits and since is None and self.low > 0:
            # Nothing in the window: the series starts anew with its next row.
            self.rule.clear()
            return
        timer = (min(waits) + 1) * _MINUTE_MS if waits else None
        if timer is not None:
            self.handle.registerTimer(timer)
        self.rule.update((total, at, since, fired, timer))

    def close(self) -> None:
        pass


def alert_stream(df: DataFrame, series: Sequence[str], ts: str = "ts", wanted: Column | None = None, length: int = 10,
                 at_least: int | None = None, at_most: int | None = None, hold: int = 0, delay: str = "10 minutes") -> DataFrame:
    """Alerts of a streaming table: (series, state, active_since, firing_from, active_until), written in append mode.

    The rule holds in a minute if the number of ``wanted`` rows in the ``length`` minutes up to it is ``at_least`` and
    ``at_most`` as much. A span of minutes in which it holds for more than ``hold`` minutes gives a row ``firing`` once
    the watermark (``delay`` behind the newest row of the table) has passed minute ``firing_from``, and a row
    ``resolved`` with its last minute once it is over. ``at_most=0`` is silence. A series is evaluated from its first
    wanted row on. Rows behind the watermark and rows without time count nowhere; null is a series like others.
    The batch form is ``monitor.alert_spans``. Needs the RocksDB state store.
    """
    low, high = rule_limits(at_least, at_most)
    flag = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    # Wanted rows are counted, not filtered: a filter would move below the watermark, which all rows must drive.
    marked = df.select(*series, F.col(ts).alias("_ts"), flag.alias("_wanted")).withWatermark("_ts", delay)
    minutes = (marked.groupBy(*series, F.window("_ts", "1 minute").alias("w")).agg(F.count_if("_wanted").alias("n")).where("n > 0")
               .withColumns({"minute": (F.unix_timestamp("w.start") / 60).cast("long"), "_all": F.lit(0)}).drop("w"))
    keys = list(series) or ["_all"]
    spans = [T.StructField(c, T.LongType()) for c in ("active_since", "firing_from", "active_until")]
    schema = T.StructType([df.schema[c] for c in series] + [T.StructField("state", T.StringType()), *spans])
    out = minutes.groupBy(*keys).transformWithStateInPandas(
        WindowRule(series, length, low, high, hold), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return out.withColumns({f.name: F.timestamp_seconds(f.name) for f in spans})


def alert_states(rows: DataFrame, series: Sequence[str]) -> DataFrame:
    """One row per alert from the rows of ``alert_stream``: active_until is null while it fires."""
    return rows.groupBy(*series, "active_since", "firing_from").agg(F.max("active_until").alias("active_until"))
