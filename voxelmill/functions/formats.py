"""The cheapest way from the formats that a model comes in to one that can be loaded, over registered conversions."""

from __future__ import annotations

import heapq
from dataclasses import dataclass


@dataclass(frozen=True)
class Conversion:
    source: str
    target: str
    #: Above 0; what is lost and what it takes.
    cost: float = 1.0


def plan(have: set[str], loadable: set[str], conversions: list[Conversion]) -> list[Conversion]:
    """The conversions of least cost, in order; none where a format can be loaded as it is. Ties go to fewer steps, then to names."""
    if any(c.cost <= 0 for c in conversions):
        raise ValueError("a conversion costs something")
    queue = [(0.0, 0, name, ()) for name in sorted(have)]
    heapq.heapify(queue)
    seen: set[str] = set()
    by = {c: i for i, c in enumerate(conversions)}
    while queue:
        cost, steps, name, way = heapq.heappop(queue)
        if name in loadable:
            return [conversions[i] for i in way]
        if name in seen:
            continue
        seen.add(name)
        for c in conversions:
            if c.source == name and c.target not in seen:
                heapq.heappush(queue, (cost + c.cost, steps + 1, c.target, (*way, by[c])))
    raise ValueError(f"no way from {sorted(have)} to {sorted(loadable)}")
