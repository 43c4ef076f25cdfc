"""Streams that act by a clock or hold a set: stops without input, and which payloads are loaded around a moving key."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .control import _ordered


def stops(events: DataFrame, key: str, expires: float, most: float) -> DataFrame:
    """(key, time, command, cause) of commands as they come, and of the stop that follows by itself.

    events: (key, time double seconds, kind, value). kind 'command' is clamped to +-most and passed on while the motor is enabled; what isn't
    finite is ignored. 'enable' (value 0 or 1) switches the motor and clears the command: a stop, cause 'motor', if one was in force.
    `expires` seconds of the cluster's clock without a new command give a command of 0, cause 'silence', once: the query goes on with
    empty batches, so no input is needed for it. Rows of a batch are taken in order of time.
    """
    wait = max(1, int(expires * 1000))

    def step(name, frames, state: GroupState):
        enabled, moving, last = state.get if state.exists else (False, False, 0.0)
        out = []
        if state.hasTimedOut:
            if moving:
                out.append((name[0], last + expires, 0.0, "silence"))
            state.update((enabled, False, last))
        else:
            for t, kind, value in _ordered(frames, "time")[["time", "kind", "value"]].itertuples(index=False):
                if kind == "enable":
                    if moving:
                        out.append((name[0], t, 0.0, "motor"))
                    enabled, moving, last = bool(value), False, t
                elif kind == "command" and enabled and value == value and abs(value) != float("inf"):
                    out.append((name[0], t, max(-most, min(most, value)), "command"))
                    moving, last = True, t
            state.update((enabled, moving, last))
            if moving:
                state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=[key, "time", "command", "cause"])

    schema = f"{key} {events.schema[key].dataType.simpleString()}, time double, command double, cause string"
    return events.groupBy(key).applyInPandasWithState(step, schema, "enabled boolean, moving boolean, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def resident(moves: DataFrame, boxes: list[tuple[str, float, float, float, float]], key: str, radius: float) -> DataFrame:
    """(key, time, payload, loaded) whenever a payload is loaded or dropped as a key moves; moves: (key, time double, x, y).

    boxes: (payload, least x, least y, greatest x, greatest y), the index of one world, which every task holds: 100,000 at most. A key
    looks again once it is the threshold, the lesser of 5 and radius / 6, from where it last looked. A payload is loaded where its box comes
    within the radius on both axes, and stays until it is beyond radius plus twice the threshold on one. The state of a key is its place
    and the names that are loaded; rows of a batch are taken in order of time.
    """
    if len(boxes) > 100_000:
        raise ValueError("too many payloads to hold in every task")
    step_, held = min(5.0, radius / 6), sorted(boxes)

    def step(name, frames, state: GroupState):
        x0, y0, text = state.get if state.exists else (None, None, "[]")
        now, out = set(json.loads(text)), []
        for t, x, y in _ordered(frames, "time")[["time", "x", "y"]].itertuples(index=False):
            if x0 is not None and ((x - x0) ** 2 + (y - y0) ** 2) ** 0.5 < step_:
                continue
            x0, y0 = float(x), float(y)
            wide = lambda p: radius + (2 * step_ if p in now else 0.0)  # noqa: B023, E731
            wanted = {p for p, lx, ly, ux, uy in held if lx <= x + wide(p) and ux >= x - wide(p) and ly <= y + wide(p) and uy >= y - wide(p)}
            out += [(name[0], t, p, False) for p in sorted(now - wanted)] + [(name[0], t, p, True) for p in sorted(wanted - now)]
            now = wanted
        state.update((x0, y0, json.dumps(sorted(now))))
        yield pd.DataFrame(out, columns=[key, "time", "payload", "loaded"])

    schema = f"{key} {moves.schema[key].dataType.simpleString()}, time double, payload string, loaded boolean"
    return moves.groupBy(key).applyInPandasWithState(step, schema, "x double, y double, held string", "append", GroupStateTimeout.NoTimeout)
