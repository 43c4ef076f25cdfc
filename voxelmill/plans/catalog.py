"""Named queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audits, cells, crowds, neighbours, ranges, sequences, statistics
from . import adapters as A
from . import registry
from .catalog_sql import D2, KNN
from .registry import query

def _c(size: float, names: str = "x y z") -> str:
    return ", ".join(f"CAST(floor({a} * {1.0 / size!r}::DOUBLE) AS BIGINT) AS i{a}" for a in names.split())


@query(f"WITH {A.LP} SELECT {_c(0.5)}, count(*) AS n FROM lp GROUP BY ALL")
def voxel_counts(spark, d):
    return cells.counts(A.line_points(spark, d), 0.5)


@query(f"WITH {A.LP}, c AS (SELECT {_c(2.0)}, count(*) AS n FROM lp GROUP BY ALL) SELECT n, count(*) AS cells FROM c GROUP BY n")
def voxel_distribution(spark, d):
    return cells.distribution(A.line_points(spark, d), 2.0)


@query(f"WITH {A.LP}, c AS (SELECT {_c(2.0)}, count(*) AS n FROM lp GROUP BY ALL) SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS points, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, CAST(median(n) AS DOUBLE) AS middle FROM c")
def voxel_summary(spark, d):
    return cells.summary(A.line_points(spark, d), 2.0).withColumn("mean", F.round("mean", 6))


@query(f"WITH {A.LR}, c AS (SELECT *, {_c(5.0)} FROM lp), p AS (SELECT *, count(*) OVER (PARTITION BY ix, iy, iz) AS n FROM c) SELECT key, n, n > 5 AS keep_5, n > 10 AS keep_10, n > 20 AS keep_20, n > 40 AS keep_40 FROM p")
def voxel_threshold_keep(spark, d):
    out = cells.keep_above(A.line_rows(spark, d), 5.0, (5, 10, 20, 40))
    return out.select("key", "n", *[f"keep_{t}" for t in (5, 10, 20, 40)])


@query(f"WITH {A.LP} SELECT CAST(floor(x / 0.1::DOUBLE) AS BIGINT) AS ix, CAST(floor(y / 0.1::DOUBLE) AS BIGINT) AS iy, CAST(floor(z / 0.1::DOUBLE) AS BIGINT) AS iz, count(*) AS n FROM lp GROUP BY ALL")
def obstacle_cells(spark, d):
    return cells.counts(A.line_points(spark, d), 0.1, divide=True)


@query(f"WITH {A.LR}, c AS (SELECT *, {_c(5.0)} FROM lp) SELECT key, round(1.0::DOUBLE / count(*) OVER (PARTITION BY ix, iy, iz), 9) AS weight FROM c")
def cell_weights(spark, d):
    return cells.populations(A.line_rows(spark, d), 5.0).select("key", F.round(1 / F.col("n"), 9).alias("weight"))


@query(f"WITH {A.EP}, c AS (SELECT *, {_c(0.1)} FROM ep) SELECT ix, iy, iz, id FROM (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY ix, iy, iz) AS n FROM c WINDOW w AS (PARTITION BY ix, iy, iz ORDER BY z, id)) WHERE k = n // 2 + 1")
def cell_median_row(spark, d):
    return cells.pick_in_cell(A.vec_points(spark, d), 0.1, ["z", "id"], True).select(*cells.CELL, "id")


@query(f"WITH {A.EP}, c AS (SELECT *, {_c(0.1)} FROM ep) SELECT ix, iy, iz, min(id) AS id FROM c GROUP BY ALL")
def cell_first_row(spark, d):
    return cells.pick_in_cell(A.vec_points(spark, d), 0.1, ["id"], False).select(*cells.CELL, "id")


_TILE = "CAST(floor(x::FLOAT::DOUBLE / 10.0::DOUBLE) AS BIGINT) AS tx, CAST(floor(y::FLOAT::DOUBLE / 10.0::DOUBLE) AS BIGINT) AS ty"


@query(f"WITH {A.LP}, t AS (SELECT *, {_TILE} FROM lp) SELECT tx, ty, 't_' || replace((tx + 10000)::VARCHAR, '-', 'm') || '_' || replace((ty + 10000)::VARCHAR, '-', 'm') AS name, count(*) AS points, min(z) AS low, max(z) AS high FROM t GROUP BY ALL")
def tile_report(spark, d):
    t = cells.tiles(A.line_points(spark, d), 10.0).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("points"), F.min("z").alias("low"), F.max("z").alias("high"))
    return t.withColumn("name", cells.tile_name(F.col("tx"), F.col("ty")))


@query(f"""WITH {A.LP}, t AS (SELECT *, {_TILE} FROM lp), h AS (SELECT x, y, tx + dx AS tx, ty + dy AS ty, dx = 0 AND dy = 0 AS own FROM t, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy))
SELECT tx, ty, count(*) AS points, count(*) FILTER (WHERE own) AS owned FROM h WHERE x >= tx * 10.0::DOUBLE - 0.7::DOUBLE AND x < (tx + 1) * 10.0::DOUBLE + 0.7::DOUBLE AND y >= ty * 10.0::DOUBLE - 0.7::DOUBLE AND y < (ty + 1) * 10.0::DOUBLE + 0.7::DOUBLE GROUP BY ALL""")
def tile_halo_counts(spark, d):
    return cells.halo(A.line_points(spark, d), 10.0, 0.7).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("points"), F.count_if("own").alias("owned"))


@query(f"WITH {A.LP}, q AS (SELECT unnest([0, .01, .5, .9, .95, .99, 1])::DOUBLE AS q, unnest(quantile_cont(y, [0, .01, .5, .9, .95, .99, 1])) AS v FROM lp) SELECT q, round(v, 4) AS v FROM q")
def dist_quantiles(spark, d):
    return audits.quantiles(A.line_points(spark, d), "y", [0.0, 0.01, 0.5, 0.9, 0.95, 0.99, 1.0]).withColumn("v", F.round("v", 4))


@query(f"WITH {A.LP}, c AS (SELECT DISTINCT {_c(2.0)} FROM lp), f AS (SELECT ix, iy, iz, axis, side, ix + CASE WHEN axis = 0 THEN side ELSE 0 END AS nx, iy + CASE WHEN axis = 1 THEN side ELSE 0 END AS ny, iz + CASE WHEN axis = 2 THEN side ELSE 0 END AS nz FROM c, (SELECT unnest([0, 1, 2])::INTEGER AS axis), (SELECT unnest([-1, 1])::INTEGER AS side)) SELECT f.ix, f.iy, f.iz, axis, side FROM f ANTI JOIN c ON c.ix = nx AND c.iy = ny AND c.iz = nz")
def exposed_voxel_faces(spark, d):
    return cells.exposed_faces(cells.counts(A.line_points(spark, d), 2.0))


@query(f"WITH {A.LP}, c AS (SELECT DISTINCT {_c(2.0)} FROM lp) SELECT a.ix, a.iy, a.iz, count(*) AS near, count(*) >= 5 AS keep FROM c a JOIN c b ON b.ix BETWEEN a.ix - 2 AND a.ix + 2 AND b.iy BETWEEN a.iy - 2 AND a.iy + 2 AND b.iz BETWEEN a.iz - 2 AND a.iz + 2 AND (a.ix - b.ix) * (a.ix - b.ix) + (a.iy - b.iy) * (a.iy - b.iy) + (a.iz - b.iz) * (a.iz - b.iz) <= 4 GROUP BY ALL")
def density_cleanup(spark, d):
    return cells.dense_neighbours(cells.counts(A.line_points(spark, d), 2.0), 2.0, 5)


_D2 = D2


@query(f"WITH {A.EP} SELECT a.id AS a, b.id AS b, round({_D2}, 9) AS d2 FROM ep a JOIN ep b ON a.id < b.id WHERE {_D2} <= 0.0025::DOUBLE")
def radius_pairs(spark, d):
    return neighbours.radius_pairs(A.vec_points(spark, d), 0.05).withColumn("d2", F.round("d2", 9))


@query(f"WITH {A.EP} SELECT a.id, count(b.id) AS near FROM ep a LEFT JOIN ep b ON a.id <> b.id AND {_D2} <= 0.01::DOUBLE GROUP BY a.id")
def radius_counts(spark, d):
    return neighbours.radius_counts(A.vec_points(spark, d), 0.1)


_KNN = KNN


@query(f"WITH {_KNN} SELECT id, nid, CAST(rank AS INTEGER) AS rank, round(dist, 9) AS dist FROM n WHERE rank <= 20")
def knn_20(spark, d):
    return neighbours.nearest(A.vec_points(spark, d), 20).withColumn("dist", F.round("dist", 9))


@query(f"WITH {_KNN}, m AS (SELECT id, avg(dist) AS m FROM n WHERE rank <= 20 GROUP BY id), l AS (SELECT avg(m) + 1.0::DOUBLE * stddev_samp(m) AS l FROM m) SELECT id, round(m, 9) AS mean_dist, m <= l AS keep FROM m, l")
def sor_keep(spark, d):
    out = neighbours.statistical_outliers(neighbours.mean_distances(A.vec_points(spark, d), 20), 1.0)
    return out.withColumn("mean_dist", F.round("mean_dist", 9))


@query(f"""WITH {_KNN}, k AS (SELECT n.id, n.nid, n.dist, kk.k FROM n, (SELECT unnest([10, 20]) AS k) kk WHERE rank <= kk.k), kd AS (SELECT n.id, kk.k, n.dist AS kd FROM n, (SELECT unnest([10, 20]) AS k) kk WHERE rank = kk.k),
lrd AS (SELECT k.id, k.k, 1 / (avg(greatest(k.dist, kd.kd)) + 1e-10::DOUBLE) AS lrd FROM k JOIN kd ON kd.id = k.nid AND kd.k = k.k GROUP BY ALL)
SELECT k.id, CAST(k.k AS INTEGER) AS k, round(avg(o.lrd) / any_value(p.lrd), 6) AS lof FROM k JOIN lrd o ON o.id = k.nid AND o.k = k.k JOIN lrd p ON p.id = k.id AND p.k = k.k GROUP BY k.id, k.k""")
def lof_multi_k(spark, d):
    return neighbours.outlier_factors(A.vec_points(spark, d), (10, 20)).withColumn("lof", F.round("lof", 6))


@query(f"WITH RECURSIVE {A.EP}, e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM ep a JOIN ep b ON a.id <> b.id WHERE {_D2} <= 0.0016::DOUBLE), r(id, root) AS (SELECT id, id FROM ep UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id) SELECT id, min(root) AS label FROM r GROUP BY id")
def components_r(spark, d):
    return neighbours.components(A.vec_points(spark, d), 0.04)


_W = "(PARTITION BY user_id ORDER BY us, event_id)"


@query(f"WITH {A.EV}, g AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR us - lag(us) OVER w > 21600000000 THEN 1 ELSE 0 END AS f FROM ev WINDOW w AS {_W}) SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g")
def session_onsets(spark, d):
    return sequences.sessions(A.stream(spark, d), A.by_user(), "us", 6 * 3600 * 1_000_000).select("event_id", "session")


@query(f"WITH {A.EV}, n AS (SELECT *, row_number() OVER {_W} - 1 AS k FROM ev) SELECT event_id, k // 5 AS slot, first_value(value) OVER (PARTITION BY user_id, k // 5 ORDER BY us, event_id) AS held FROM n")
def sample_hold(spark, d):
    return sequences.sample_hold(A.stream(spark, d), A.by_user(), "value", 5).select("event_id", "slot", "held")


@query(f"WITH {A.EV} SELECT event_id, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS episode FROM ev")
def episode_ids(spark, d):
    return sequences.episodes(A.stream(spark, d), A.by_user(), F.col("event_type") == "purchase").select("event_id", "episode")


@query(f"WITH {A.EV}, c AS (SELECT event_id, us, value, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS v, last_value(CASE WHEN event_type = 'click' THEN us END IGNORE NULLS) OVER w AS t FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)) SELECT event_id, CASE WHEN t IS NULL OR us - t > 86400000000 THEN 0.0::DOUBLE ELSE v END AS command FROM c")
def asof_latest(spark, d):
    return sequences.latest(A.stream(spark, d), A.by_user(), F.col("event_type") == "click", "value", "us", 86_400_000_000).select("event_id", "command")


@query(f"WITH {A.EV}, i AS (SELECT user_id, us AS low, us + CAST(floor(value) AS BIGINT) * 60000000 AS high FROM ev), g AS (SELECT *, CASE WHEN low > max(high) OVER (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM i), r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(low) AS low, max(high) AS high FROM r GROUP BY user_id, run")
def interval_union(spark, d):
    e = A.stream(spark, d).select("user_id", F.col("us").alias("low"), (F.col("us") + F.floor("value") * 60_000_000).alias("high"))
    return sequences.merged(e, "user_id", "low", "high")


@query("WITH j AS (SELECT l_orderkey, l_quantity AS q, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem) SELECT CASE WHEN n <= 20 THEN 5 WHEN q < 10 THEN 1 WHEN q < 25 THEN 2 WHEN q < 45 THEN 3 ELSE 0 END AS label, count(*) AS rows_in FROM j GROUP BY 1")
def priority_partition(spark, d):
    t = A.table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").alias("q"), F.count(F.lit(1)).over(Window.partitionBy("l_partkey")).alias("n"))
    label = F.when(F.col("n") <= 20, 5).when(F.col("q") < 10, 1).when(F.col("q") < 25, 2).when(F.col("q") < 45, 3).otherwise(0)
    return t.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("rows_in"))


@query(f"""WITH {A.LP}, b AS (SELECT min(y) AS lo, max(y) AS hi FROM lp), n AS (SELECT least(CAST(floor((y - lo) / (hi - lo) * 64) AS BIGINT), 63) AS bin, count(*) AS n FROM lp, b GROUP BY ALL)
SELECT k.bin, round(lo + k.bin * ((hi - lo) / 64), 6) AS low, round(CASE WHEN k.bin = 63 THEN hi ELSE lo + (k.bin + 1) * ((hi - lo) / 64) END, 6) AS high, coalesce(n.n, 0) AS n FROM (SELECT unnest(range(64)) AS bin) k CROSS JOIN b LEFT JOIN n ON n.bin = k.bin""")
def dist_histogram64(spark, d):
    return statistics.histogram(A.line_points(spark, d), "y", 64).withColumns({c: F.round(c, 6) for c in ("low", "high")})


@query("WITH e AS (SELECT l_returnflag, l_extendedprice AS v, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY v ROWS UNBOUNDED PRECEDING) AS below, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM e) SELECT l_returnflag, min(v) AS q FROM c WHERE below >= total * 0.95::DOUBLE GROUP BY ALL")
def weighted_p95(spark, d):
    return statistics.weighted_quantile(A.table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity", 0.95)


_MOMENTS = [f"{f}_{a}" for a in "xyz" for f in ("min", "max", "mean")] + [f"c{p}" for p in ("xx", "xy", "xz", "yy", "yz", "zz")]
_MOMENTS_SQL = ", ".join([f"round({'avg' if m[:4] == 'mean' else m[:3]}({m[-1]}), 6) AS {m}" if "_" in m else f"round(covar_pop({m[1]}, {m[2]}), 6) AS {m}" for m in _MOMENTS])


@query(f"WITH {A.EP} SELECT id % 7 AS label, count(*) AS n, {_MOMENTS_SQL} FROM ep GROUP BY 1")
def component_stats(spark, d):
    p = A.vec_points(spark, d)
    return statistics.component_moments(p, p.withColumn("label", F.col("id") % 7)).withColumns({m: F.round(m, 6) for m in _MOMENTS})


@query(f"WITH {A.EV} SELECT count(*) FILTER (WHERE value > 50 AND event_type = 'click') AS hits, round(count(*) FILTER (WHERE value > 50 AND event_type = 'click') / nullif(count(*) FILTER (WHERE value > 50), 0), 9) AS precision, round(count(*) FILTER (WHERE value > 50 AND event_type = 'click') / nullif(count(*) FILTER (WHERE event_type = 'click'), 0), 9) AS recall FROM ev")
def capacity_ratios(spark, d):
    out = statistics.capacity(A.stream(spark, d), F.col("value") > 50, F.col("event_type") == "click")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


@query(f"WITH {A.EP}, n AS (SELECT a.id, {_D2} AS d2 FROM ep a JOIN ep b ON a.id <> b.id AND {_D2} <= 0.01::DOUBLE), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2 DESC) AS k FROM n) SELECT id, round(max(CASE WHEN k = 3 THEN d2 END), 9) AS third FROM r GROUP BY id HAVING count(*) >= 6")
def neighbour_third_largest(spark, d):
    return crowds.third_farthest(A.vec_points(spark, d), 0.1, 6).withColumn("third", F.round("third", 9))


@query(f"WITH {A.EP}, n AS (SELECT a.id, degrees(atan2(b.y - a.y, b.x - a.x)) AS g FROM ep a JOIN ep b ON a.id <> b.id AND {_D2} <= 0.01::DOUBLE), s AS (SELECT id, g, coalesce(lead(g) OVER w, first_value(g) OVER w + 360.0::DOUBLE) - g AS step FROM n WINDOW w AS (PARTITION BY id ORDER BY g)) SELECT id, round(max(step), 6) AS gap FROM s GROUP BY id")
def cyclic_gap(spark, d):
    return crowds.widest_gaps(A.vec_points(spark, d), 0.1).withColumn("gap", F.round("gap", 6))


@query()
def iterative_lof(spark, d):
    from ..sources.folders import shared

    shared(spark)
    return statistics.iterative_outliers(A.vec_points(spark, d), 10, 1.5, 3, neighbours.outlier_factors)


#: One box for each nation, in the range of the points.
_BOX = "SELECT n_nationkey AS box, n_nationkey * 0.02::DOUBLE - 0.25::DOUBLE AS lx, n_nationkey * 0.02::DOUBLE - 0.235::DOUBLE AS ux, n_nationkey * 0.01::DOUBLE - 0.2::DOUBLE AS ly, n_nationkey * 0.01::DOUBLE AS uy FROM nation"


def _boxes(spark, d):
    k = F.col("n_nationkey")
    return A.table(spark, d, "nation").select(k.alias("box"), (k * 0.02 - 0.25).alias("lx"), (k * 0.02 - 0.235).alias("ux"), (k * 0.01 - 0.2).alias("ly"), (k * 0.01).alias("uy"))


_IN = "EXISTS (SELECT 1 FROM bx WHERE x >= lx AND x <= ux AND y >= ly AND y <= uy)"


@query(f"WITH {A.EP}, bx AS ({_BOX}) SELECT id FROM ep WHERE {_IN}")
def box_semi(spark, d):
    return ranges.inside_boxes(A.vec_points(spark, d), _boxes(spark, d), 0.05).select("id")


@query(f"WITH {A.EP}, bx AS ({_BOX}) SELECT id FROM ep WHERE NOT {_IN}")
def box_anti(spark, d):
    return ranges.outside_boxes(A.vec_points(spark, d), _boxes(spark, d), 0.05).select("id")


_EB = "eb AS (SELECT id, " + ", ".join(f"{a} - 0.02::DOUBLE AS l{a}, {a} + 0.02::DOUBLE AS u{a}" for a in "xyz") + " FROM ep)"


@query(f"WITH {A.EP}, {_EB} SELECT a.id AS a, b.id AS b FROM eb a JOIN eb b ON a.id < b.id WHERE a.lx <= b.ux AND b.lx <= a.ux AND a.ly <= b.uy AND b.ly <= a.uy AND a.lz <= b.uz AND b.lz <= a.uz")
def aabb_overlap(spark, d):
    p = A.vec_points(spark, d)
    boxes = p.select(F.col("id").alias("box"), *[(F.col(a) - 0.02).alias(f"l{a}") for a in "xyz"], *[(F.col(a) + 0.02).alias(f"u{a}") for a in "xyz"])
    return ranges.overlapping_boxes(boxes, 0.05)


@query(f"WITH {A.EP}, s AS (SELECT n_nationkey AS seed, n_nationkey * 0.02::DOUBLE - 0.25::DOUBLE AS sx, n_regionkey * 0.1::DOUBLE - 0.2::DOUBLE AS sy FROM nation), n AS (SELECT id, seed, sqrt((x - sx) * (x - sx) + (y - sy) * (y - sy)) AS dist FROM ep, s) SELECT id, seed, round(dist, 9) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, seed) AS k FROM n WHERE dist < 0.2::DOUBLE) WHERE k = 1")
def nearest_seed(spark, d):
    n = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("seed"), (F.col("n_nationkey") * 0.02 - 0.25).alias("x"), (F.col("n_regionkey") * 0.1 - 0.2).alias("y"))
    return ranges.nearest_seed(A.vec_points(spark, d), n, 0.2).withColumn("dist", F.round("dist", 9))


@query("SELECT k.label, count(l_linenumber) AS n FROM (SELECT unnest(range(10)) AS label) k LEFT JOIN lineitem ON l_linenumber = label GROUP BY 1")
def label_domain(spark, d):
    return ranges.domain_counts(A.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("label")), "label", 10)


_B4, _AF = "(PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "(PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query(f"WITH {A.EV}, k AS (SELECT *, CASE WHEN event_type = 'click' THEN us END AS t, CASE WHEN event_type = 'click' THEN value END AS v FROM ev), c AS (SELECT event_id, us, last_value(t IGNORE NULLS) OVER p AS t0, last_value(v IGNORE NULLS) OVER p AS v0, first_value(t IGNORE NULLS) OVER f AS t1, first_value(v IGNORE NULLS) OVER f AS v1 FROM k WINDOW p AS {_B4}, f AS {_AF}) SELECT event_id, round(coalesce(CASE WHEN t1 = t0 THEN v0 ELSE v0 + (v1 - v0) * (us - t0) / (t1 - t0) END, v0, v1), 6) AS lerp FROM c")
def lerp_join(spark, d):
    out = sequences.interpolated(A.stream(spark, d), A.by_user(), F.col("event_type") == "click", "us", "value")
    return out.select("event_id", F.round("lerp", 6).alias("lerp"))


from . import columns, joins, meshes, rasters, shapes, surfaces, tables, wholes, windows  # noqa: E402, F401  (they register their queries)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
