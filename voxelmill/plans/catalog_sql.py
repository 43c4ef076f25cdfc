"""SQL that several queries share."""

from __future__ import annotations

from . import adapters as A

D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
KNN = f"{A.EP}, n AS (SELECT a.id, b.id AS nid, sqrt({D2}) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY sqrt({D2}), b.id) AS rank FROM ep a JOIN ep b ON a.id <> b.id)"
