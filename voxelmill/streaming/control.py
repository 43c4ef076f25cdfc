"""Structured Streaming forms of the stateful operators: contact onsets, a command watchdog, strictly newer rows, throttling,
rest, latest requests, replies, sinks by micro-batch.

State is keyed, so it spreads over executors, and small: one row a key. Onsets use Spark's session windows; the others keep
the last value of a key with applyInPandasWithState, and drop the state of a key that is silent for `idle` of processing time,
so that new keys don't pile up for ever. Event times must be of type timestamp.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def onsets(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """(key, onset, contacts): contacts of a key, a new one after more than gap without a row; rows later than `late` drop."""
    window = F.session_window(F.col(time), gap)
    out = events.withWatermark(time, late).groupBy(key, window.alias("w")).agg(F.count(F.lit(1)).alias("contacts"))
    return out.select(key, F.col("w.start").alias("onset"), "contacts")


def _ordered(frames: Iterator[pd.DataFrame], time: str) -> pd.DataFrame:
    rows = pd.concat(list(frames), ignore_index=True)
    return rows.sort_values(time, kind="stable", ignore_index=True)


#: After so many milliseconds without a row a key's state goes: it starts anew with its next row. None keeps it; a query that is to end
#: with its input needs that, as a timeout makes it wait for ever.
IDLE = 24 * 3_600_000


def _timeout(idle: int | None) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout


def watchdog(events: DataFrame, key: str, expires: float, most: float, idle: int | None = IDLE) -> DataFrame:
    """(key, time, command) for each sample row of events (key, time double seconds, kind, value).

    kind: 'command' sets the velocity (clamped to +-most, not finite ones ignored), 'enable' (value 0 or 1) switches the motor
    and clears the velocity, 'sample' asks. The answer is 0 while disabled or once the command is older than expires.
    """

    def step(name, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        enabled, velocity, at = state.get if state.exists else (False, 0.0, float("-inf"))
        out = []
        for t, kind, value in _ordered(frames, "time")[["time", "kind", "value"]].itertuples(index=False):
            if kind == "command" and value == value and abs(value) != float("inf"):
                velocity, at = max(-most, min(most, value)), t
            elif kind == "enable":
                enabled, velocity, at = bool(value), 0.0, float("-inf")
            elif kind == "sample":
                out.append((name[0], t, velocity if enabled and t - at <= expires else 0.0))
        state.update((enabled, velocity, at))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=[key, "time", "command"])

    schema = f"{key} {events.schema[key].dataType.simpleString()}, time double, command double"
    return events.groupBy(key).applyInPandasWithState(step, schema, "enabled boolean, velocity double, at double", "append", _timeout(idle))


def _folded(events: DataFrame, key: str, state_type: str, start: tuple, fold, idle: int | None) -> DataFrame:
    """Rows that the fold takes: fold(time, row, state) gives whether, and the state that follows. Rows of a micro-batch are put in
    order of time, those of a key together."""
    columns = events.columns

    def step(_, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else start
        rows, taken = _ordered(frames, "time"), []
        for row in rows.itertuples(index=False):
            take, now = fold(row.time, row, now)
            taken.append(take)
        state.update(now)
        if idle:
            state.setTimeoutDuration(idle)
        yield rows.loc[taken, columns]

    return events.groupBy(key).applyInPandasWithState(step, events.schema, state_type, "append", _timeout(idle))


def newer(events: DataFrame, key: str, idle: int | None = IDLE) -> DataFrame:
    """Rows (key, time double, ...) whose time is strictly above that of every row of the key that came through before."""
    return _folded(events, key, "last double", (float("-inf"),), lambda t, _, s: (True, (t,)) if t > s[0] else (False, s), idle)


def throttled(events: DataFrame, key: str, rate: float, idle: int | None = IDLE) -> DataFrame:
    """At most rate rows a second of each key: the next row passes 1 / rate later, or in a later batch when the clock went back."""
    return _folded(events, key, "last double", (float("-inf"),), lambda t, _, s: (True, (t,)) if t - s[0] >= 1.0 / rate or t < s[0] else (False, s), idle)


def settled(events: DataFrame, key: str, speed: float, turn: float, least: float, idle: int | None = IDLE) -> DataFrame:
    """Rows (key, time double, linear, angular, ...) at which a key has been at rest, both speeds within their limits, for `least` seconds
    or longer without a break."""

    def fold(t, row, s):
        still = abs(row.linear) <= speed and abs(row.angular) <= turn
        since = (t if s[0] != s[0] else s[0]) if still else float("nan")
        return still and t - since >= least, (since,)

    return _folded(events, key, "since double", (float("nan"),), fold, idle)


def advances(events: DataFrame, key: str, most: int, idle: int | None = IDLE) -> DataFrame:
    """Rows (key, time double, ...) whose stamp is above the key's last one; `most` rows in a row that are not is an error."""

    def fold(t, _, s):
        if t > s[0]:
            return True, (t, 0)
        if s[1] + 1 >= most:
            raise ValueError(f"{most} frames in a row were not newer")
        return False, (s[0], s[1] + 1)

    return _folded(events, key, "last double, missed long", (float("-inf"), 0), fold, idle)


def replies(requests: DataFrame, answers: DataFrame, key: str, time: str, late: str, expires: str) -> DataFrame:
    """Each request with the time of an answer of the same key, not before it and at most expires after it; null for one that timed out,
    which comes once the watermark has passed. An inner interval join of two streams with an outer side."""
    r = requests.withWatermark(time, late).alias("r")
    a = answers.withWatermark(time, late).select(F.col(key).alias("__k"), F.col(time).alias("answer"))
    on = F.expr(f"r.{key} = __k AND answer >= r.{time} AND answer <= r.{time} + interval {expires}")
    return r.join(a, on, "leftOuter").drop("__k")


class Latest:
    """Latest request wins, by micro-batch: counts of a cell size are made once and kept, a change of the threshold alone uses them
    again, and a request that a newer one has overtaken is left out. For foreachBatch; a small table of requests, one key."""

    def __init__(self, count, keep: int = 4):
        #: count(size) gives a DataFrame with n; the last `keep` sizes stay cached.
        self.count, self.keep, self.cached, self.revision, self.made = count, keep, {}, -1, 0

    def answer(self, requests) -> DataFrame | None:
        """The answer to the newest of the requests (revision, size, threshold); None if it is stale."""
        top = max(requests, key=lambda r: r.revision, default=None)
        if top is None or top.revision <= self.revision:
            return None
        self.revision = top.revision
        if top.size not in self.cached:
            self.made += 1
            self.cached[top.size] = self.count(top.size).persist()
            while len(self.cached) > self.keep:
                self.cached.pop(next(iter(self.cached))).unpersist()
        return self.cached[top.size].filter(F.col("n") > top.threshold)


def traced(events: DataFrame, path: str, checkpoint: str, phase: str):
    """A running query that appends every row to the folder of its phase; reading path gives all phases, with their names."""
    return events.writeStream.outputMode("append").format("parquet").option("path", f"{path}/phase={phase}").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingress(messages: DataFrame) -> DataFrame:
    """(key, time, linear, angular) of JSON commands (key, time, body): those that don't parse or aren't finite numbers are left out."""
    body = F.from_json("body", "linear double, angular double", {"mode": "PERMISSIVE"})
    out = messages.select("key", "time", body.alias("b")).select("key", "time", "b.linear", "b.angular")
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return out.filter(fine("linear") & fine("angular"))


def published(batch: DataFrame) -> DataFrame:
    """Points (x, y, z, ...) fit to be published: rows with a coordinate that isn't finite are left out."""
    ok = None
    for a in "xyz":
        c = F.col(a).isNotNull() & ~F.isnan(F.col(a)) & (F.abs(F.col(a)) < float("inf"))
        ok = c if ok is None else ok & c
    return batch.filter(ok)
