"""Queries of ordered rows and sets: best rows, runs, batches, ranks, focal filters, rectangles, set operations, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as win
from . import adapters as A
from .registry import query


@query("SELECT l_partkey, l_orderkey AS orderkey, price FROM (SELECT l_partkey, l_orderkey, l_extendedprice AS price, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def best_per_group(spark, d):
    t = A.table(spark, d, "lineitem").withColumns({"price": F.col("l_extendedprice"), "orderkey": F.col("l_orderkey")})
    return win.best(t, "l_partkey", [-F.col("price"), F.col("l_orderkey"), F.col("l_linenumber")], ["orderkey", "price"])


_BINS = "b AS (SELECT DISTINCT user_id, us // 3600000000 AS bin FROM ev), s AS (SELECT *, CASE WHEN bin - lag(bin) OVER w > 6 THEN 1 ELSE 0 END AS f FROM b WINDOW w AS (PARTITION BY user_id ORDER BY bin)), r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS run FROM s), g AS (SELECT user_id, min(bin) AS first, max(bin) AS last, count(*) AS bins FROM r GROUP BY user_id, run)"


def _bins(spark, d):
    return A.stream(spark, d).select("user_id", F.floor(F.col("us") / 3_600_000_000).alias("bin"))


@query(f"WITH {A.EV}, {_BINS} SELECT user_id, first, last, bins FROM g WHERE bins / (last - first + 1) >= 0.4::DOUBLE")
def occupied_runs(spark, d):
    return win.bin_runs(_bins(spark, d), "user_id", "bin", 6, 0.4)


@query(f"WITH {A.EV}, {_BINS} SELECT user_id, first, last, bins FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY greatest(first - 473400, 473400 - last, 0), -bins, first) AS k FROM g) WHERE k = 1")
def central_runs(spark, d):
    return win.central_run(_bins(spark, d), "user_id", "bin", 6, 473_400)


@query(f"WITH {A.EV}, b AS (SELECT event_id, coalesce(sum(floor(value)) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before FROM ev) SELECT event_id, before, CAST(floor(before / 500) AS BIGINT) AS batch FROM b")
def batch_bounds(spark, d):
    return win.batches(A.stream(spark, d), A.by_user(), F.floor("value").cast("double"), 500.0).select("event_id", "before", "batch")


_RUN = "n AS (SELECT *, sum((value > 25)::INT) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS n, sum((value > 25)::INT) OVER (PARTITION BY user_id) AS total FROM ev)"


@query(f"WITH {A.EV}, {_RUN}, r AS (SELECT user_id, n, sum(CASE WHEN value > 25 THEN 0.0::DOUBLE ELSE floor(value) + 1 END) AS w FROM n GROUP BY user_id, n) SELECT user_id, max(w) AS longest FROM r GROUP BY user_id")
def longest_gaps(spark, d):
    e = A.stream(spark, d).withColumn("w", F.floor("value") + 1.0)
    return win.longest_gap(e, "user_id", ["us", "event_id"], F.col("value") > 25, "w", False)


@query(f"WITH {A.EV}, {_RUN}, r AS (SELECT user_id, CASE WHEN n = total THEN 0 ELSE n END AS n, sum(CASE WHEN value > 25 THEN 0.0::DOUBLE ELSE floor(value) + 1 END) AS w FROM n GROUP BY ALL) SELECT user_id, max(w) AS longest FROM r GROUP BY user_id")
def longest_closed_gaps(spark, d):
    e = A.stream(spark, d).withColumn("w", F.floor("value") + 1.0)
    return win.longest_gap(e, "user_id", ["us", "event_id"], F.col("value") > 25, "w", True)


@query(f"WITH {A.EP} SELECT id, CAST(row_number() OVER (PARTITION BY id % 5 ORDER BY floor(x / 0.1::DOUBLE), floor(y / 0.1::DOUBLE), floor(z / 0.1::DOUBLE), id) AS INTEGER) AS place FROM ep")
def cell_order(spark, d):
    w = Window.partitionBy(F.col("id") % 5).orderBy(*[F.floor(F.col(a) / 0.1) for a in "xyz"], "id")
    return A.vec_points(spark, d).select("id", F.row_number().over(w).alias("place"))


@query(f"WITH {A.EX} SELECT id, CAST(row_number() OVER (PARTITION BY label ORDER BY round(x, 1) DESC, round(y, 1) DESC, id) AS INTEGER) AS turn FROM ex")
def greedy_order(spark, d):
    w = Window.partitionBy("label").orderBy(F.desc(F.round("x", 1)), F.desc(F.round("y", 1)), "id")
    return A.vec_parts(spark, d).select("id", F.row_number().over(w).alias("turn"))


_CELLS = "c AS (SELECT CAST(floor(x * 0.5::DOUBLE) AS BIGINT) AS ix, CAST(floor(y * 0.5::DOUBLE) AS BIGINT) AS iy, count(*)::DOUBLE AS v FROM lp GROUP BY ALL)"


def _cells(spark, d):
    return A.line_points(spark, d).groupBy(F.floor(F.col("x") * 0.5).alias("ix"), F.floor(F.col("y") * 0.5).alias("iy")).agg(F.count(F.lit(1)).cast("double").alias("v"))


_FOCAL = f"f AS (SELECT a.ix, a.iy, min(b.v) AS low, median(b.v) AS middle, max(b.v) AS high, sum(b.v * exp(-0.5::DOUBLE * ((a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy)))) / sum(exp(-0.5::DOUBLE * ((a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy)))) AS smooth FROM c a JOIN c b ON abs(a.ix - b.ix) <= 2 AND abs(a.iy - b.iy) <= 2 GROUP BY ALL)"


@query(f"WITH {A.LP}, {_CELLS}, {_FOCAL} SELECT ix, iy, low, middle, high, round(smooth, 6) AS smooth FROM f")
def focal_filters(spark, d):
    return win.focal(_cells(spark, d), "v", 2).withColumn("smooth", F.round("smooth", 6))


@query(f"WITH {A.LP}, {_CELLS}, {_FOCAL} SELECT ix, iy, v FROM c JOIN f USING (ix, iy) WHERE v = high AND v > 4")
def local_peaks(spark, d):
    return win.peaks(_cells(spark, d), "v", 2, 4.0)


@query(f"WITH {A.LP}, {_CELLS}, o AS (SELECT ix, iy FROM c WHERE v > 3), s AS (SELECT *, CASE WHEN ix - lag(ix) OVER (PARTITION BY iy ORDER BY ix) > 1 THEN 1 ELSE 0 END AS f FROM o), r AS (SELECT *, sum(f) OVER (PARTITION BY iy ORDER BY ix ROWS UNBOUNDED PRECEDING) AS run FROM s), h AS (SELECT iy, min(ix) AS x0, max(ix) AS x1 FROM r GROUP BY iy, run), t AS (SELECT *, CASE WHEN iy - lag(iy) OVER (PARTITION BY x0, x1 ORDER BY iy) > 1 THEN 1 ELSE 0 END AS f FROM h), u AS (SELECT *, sum(f) OVER (PARTITION BY x0, x1 ORDER BY iy ROWS UNBOUNDED PRECEDING) AS run FROM t) SELECT x0, x1, min(iy) AS y0, max(iy) AS y1 FROM u GROUP BY x0, x1, run")
def cell_rectangles(spark, d):
    return win.rectangles(_cells(spark, d).filter("v > 3"))


_RH = "k AS (SELECT id, z, CAST(floor(x / 0.05::DOUBLE) AS BIGINT) AS ix, CAST(floor(y / 0.05::DOUBLE) AS BIGINT) AS iy FROM ep), q AS (SELECT ix, iy, quantile_cont(z, 0.1) AS q FROM k GROUP BY ALL), l AS (SELECT a.ix, a.iy, min(b.q) AS q FROM q a JOIN q b ON abs(a.ix - b.ix) <= 2 AND abs(a.iy - b.iy) <= 2 GROUP BY ALL), g AS (SELECT a.ix, a.iy, median(b.q) AS ground FROM l a JOIN l b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 GROUP BY ALL)"


@query(f"WITH {A.EP}, {_RH} SELECT id, round(z - ground, 7) AS height FROM k JOIN g USING (ix, iy)")
def relative_heights(spark, d):
    return win.relative_heights(A.vec_points(spark, d), 0.05).withColumn("height", F.round("height", 7))


_SETS = {k: f"(SELECT DISTINCT user_id FROM events WHERE event_type = '{k}' AND value > 80)" for k in ("click", "purchase")}


def _users(spark, d, kind):
    return A.table(spark, d, "events").filter((F.col("event_type") == kind) & (F.col("value") > 80)).select("user_id")


@query("SELECT user_id, event_type FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_type FROM events WHERE value > 50")
def union_all(spark, d):
    e = A.table(spark, d, "events").select("user_id", "event_type", "value")
    return e.filter("event_type = 'click'").unionByName(e.filter("value > 50")).select("user_id", "event_type")


@query(f"SELECT user_id FROM {_SETS['click']} UNION SELECT user_id FROM {_SETS['purchase']}")
def union_distinct(spark, d):
    return _users(spark, d, "click").union(_users(spark, d, "purchase")).distinct()


@query(f"SELECT user_id FROM {_SETS['click']} INTERSECT SELECT user_id FROM {_SETS['purchase']}")
def intersect_sets(spark, d):
    return _users(spark, d, "click").intersect(_users(spark, d, "purchase"))


@query(f"SELECT user_id FROM {_SETS['click']} EXCEPT SELECT user_id FROM {_SETS['purchase']}")
def except_sets(spark, d):
    return _users(spark, d, "click").distinct().join(_users(spark, d, "purchase"), "user_id", "left_anti")


@query(f"WITH {A.LP} SELECT DISTINCT CAST(floor(x) AS BIGINT) AS ix, CAST(floor(z) AS BIGINT) AS iz FROM lp")
def distinct_cells(spark, d):
    return A.line_points(spark, d).select(F.floor("x").alias("ix"), F.floor("z").alias("iz")).distinct()


@query("SELECT event_id FROM events ORDER BY value DESC, event_id LIMIT 100")
def top_rows(spark, d):
    return A.table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(100).select("event_id")


@query("WITH l AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id), u AS (SELECT user_id, unnest(ids) AS event_id, generate_subscripts(ids, 1) - 1 AS place FROM l) SELECT user_id, event_id, CAST(place AS INTEGER) AS place FROM u")
def unnest_lists(spark, d):
    lists = A.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    return lists.select("user_id", F.posexplode("ids").alias("place", "event_id")).select("user_id", "event_id", "place")


_PL = "pl AS (SELECT id // 5 AS line, id % 5 AS o, x, y, z FROM ep), s AS (SELECT *, lead(x) OVER w AS b_x, lead(y) OVER w AS b_y, lead(z) OVER w AS b_z, sqrt(pow(lead(x) OVER w - x, 2) + pow(lead(y) OVER w - y, 2) + pow(lead(z) OVER w - z, 2)) AS d FROM pl WINDOW w AS (PARTITION BY line ORDER BY o)), t AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY line ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS s, sum(d) OVER (PARTITION BY line) AS total FROM s), n AS (SELECT DISTINCT line, CAST(ceil(total / 0.05::DOUBLE) AS BIGINT) AS n, total / ceil(total / 0.05::DOUBLE) AS step FROM t WHERE total > 0), k AS (SELECT line, n, step, unnest(range(n + 1)) AS k FROM n), j AS (SELECT k.line, k, n, step, o, x, y, z, b_x, b_y, b_z, d, s, row_number() OVER (PARTITION BY k.line, k ORDER BY o DESC) AS r FROM k JOIN t ON t.line = k.line AND d > 0 AND (s <= k * step OR s = 0))"


@query(f"WITH {A.EP}, {_PL} SELECT line, k, " + ", ".join(f"round({a} + least((k * step - s) / d, 1.0::DOUBLE) * (b_{a} - {a}), 6) AS {a}" for a in "xyz") + ", round(CASE WHEN k = 0 OR k = n THEN step / 2 ELSE step END, 8) AS weight FROM j WHERE r = 1")
def resampled_lines(spark, d):
    p = A.vec_points(spark, d).withColumns({"line": F.floor(F.col("id") / 5), "o": F.col("id") % 5})
    out = win.resampled(p, "line", "o", 0.05)
    return out.select("line", "k", *[F.round(a, 6).alias(a) for a in "xyz"], F.round("weight", 8).alias("weight"))


@query("""WITH r AS (SELECT user_id % 20 AS k, user_id AS rep, event_type AS f, event_id % 4 AS how FROM events),
reps AS (SELECT k, count(DISTINCT rep) AS n FROM r GROUP BY k), kept AS (SELECT k, f FROM r WHERE how = 0 GROUP BY k, f HAVING count(DISTINCT rep) = (SELECT n FROM reps WHERE reps.k = r.k)),
c AS (SELECT DISTINCT k, f FROM r WHERE how = 1), l AS (SELECT DISTINCT k, f FROM r WHERE how = 2 AND f < 'm'), u AS (SELECT DISTINCT k, f FROM r WHERE how = 3 AND f > 'm')
SELECT k, coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM kept WHERE kept.k = reps.k AND NOT EXISTS (SELECT 1 FROM c WHERE c.k = kept.k AND c.f = kept.f) AND NOT EXISTS (SELECT 1 FROM l WHERE l.k = kept.k AND l.f = kept.f) AND NOT EXISTS (SELECT 1 FROM u WHERE u.k = kept.k AND u.f = kept.f)), '') AS kept,
coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM c WHERE c.k = reps.k AND NOT EXISTS (SELECT 1 FROM l WHERE l.k = c.k AND l.f = c.f)), '') AS changed, coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM l WHERE l.k = reps.k), '') AS lost,
coalesce((SELECT string_agg(f, ',' ORDER BY f) FROM u WHERE u.k = reps.k AND NOT EXISTS (SELECT 1 FROM c WHERE c.k = u.k AND c.f = u.f) AND NOT EXISTS (SELECT 1 FROM l WHERE l.k = u.k AND l.f = u.f)), '') AS open FROM reps""")
def evidence_sets(spark, d):
    e = A.table(spark, d, "events").withColumns({"k": F.col("user_id") % 20, "how": F.col("event_id") % 4, "f": F.col("event_type")})
    of = lambda c: F.collect_set(F.when(c, F.col("f")))
    r = e.groupBy("k", "user_id").agg(of(F.col("how") == 0).alias("kept"), of(F.col("how") == 1).alias("changed"), of((F.col("how") == 2) & (F.col("f") < "m")).alias("lost"), of((F.col("how") == 3) & (F.col("f") > "m")).alias("unknown"))
    out = win.evidence(r, "k")
    return out.select("k", *[F.array_join(c, ",").alias(c) for c in ("kept", "changed", "lost", "open")])
