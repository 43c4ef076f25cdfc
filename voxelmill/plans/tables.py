"""Queries of whole tables: audits, reports, sinks and scans, and state rows of moving things."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audits, cells, motion, neighbours
from ..sources import folders, sinks
from . import adapters as A
from .catalog_sql import KNN
from .registry import query

_QS = [0.0, 0.01, 0.5, 0.9, 0.95, 0.99, 1.0]


@query("SELECT 10000::BIGINT * 0 + count(*) AS source, count(*) FILTER (WHERE event_id % 10 <> 3) + count(*) FILTER (WHERE event_id % 10 = 4) + 7 AS archive, count(*) FILTER (WHERE event_id % 10 = 3) AS missing, count(*) FILTER (WHERE event_id % 10 = 4) AS doubled, count(*) FILTER (WHERE event_id % 10 = 5) AS altered, 7::BIGINT AS strange FROM events")
def archive_audit(spark, d):
    """An archive that lacks, doubles, alters and adds rows."""
    e = A.table(spark, d, "events").select("event_id", "user_id", "value")
    k = F.col("event_id") % 10
    archive = e.filter(k != 3).withColumn("value", F.when(k == 5, F.col("value") + 1).otherwise(F.col("value")))
    archive = archive.unionByName(e.filter(k == 4)).unionByName(spark.range(-7, 0).select(F.col("id").alias("event_id"), F.lit(0).cast("long").alias("user_id"), F.lit(0.0).alias("value")))
    return audits.archive_audit(e, archive, "event_id", ["user_id", "value"])


@query(f"WITH {A.LP}, t AS (SELECT CAST(floor(x::FLOAT::DOUBLE / 10.0::DOUBLE) AS BIGINT) AS tx, CAST(floor(y::FLOAT::DOUBLE / 10.0::DOUBLE) AS BIGINT) AS ty, count(*) AS n FROM lp GROUP BY ALL) SELECT tx, ty, n AS found, CASE WHEN tx % 2 = 0 THEN n + 1 END AS said FROM t WHERE tx % 2 = 0 OR ty % 3 = 0")
def resume_audit(spark, d):
    t = cells.tiles(A.line_points(spark, d), 10.0).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"))
    said = t.filter("tx % 2 = 0 OR ty % 3 <> 0").withColumn("n", F.when(F.col("tx") % 2 == 0, F.col("n") + 1).otherwise(F.col("n")))
    return audits.resume_audit(t, said, ["tx", "ty"], "n")


@query("SELECT count(*) FILTER (WHERE vec_id % 9 = 0) AS unlabelled, count(*) FILTER (WHERE vec_id % 9 = 1) AS several, CAST(count(*) FILTER (WHERE vec_id % 9 = 2) AS BIGINT) AS outside, 2::BIGINT AS unknown FROM embeddings")
def label_audit(spark, d):
    rows = A.vec_points(spark, d).select("id")
    k = F.col("id") % 9
    labels = rows.filter(k != 0).select("id", F.when(k == 2, 77).otherwise(F.col("id") % 5).cast("long").alias("label"))
    labels = labels.unionByName(rows.filter(k == 1).select("id", F.lit(0).cast("long").alias("label"))).unionByName(spark.range(-2, 0).select("id", F.lit(1).cast("long").alias("label")))
    return audits.label_audit(rows, labels, [0, 1, 2, 3, 4])


@query(f"WITH {A.LP}, q AS (SELECT unnest([0, .01, .5, .9, .95, .99, 1])::DOUBLE AS q, unnest(quantile_cont(z * y, [0, .01, .5, .9, .95, .99, 1])) AS v FROM lp) SELECT q, round(v, 4) AS v FROM q")
def whole_quantiles(spark, d):
    folders.shared(spark)
    return audits.quantiles(A.line_points(spark, d).withColumn("p", F.col("z") * F.col("y")), "p", _QS).withColumn("v", F.round("v", 4))


@query(f"WITH {KNN}, m AS (SELECT id, avg(dist) AS m FROM n WHERE rank <= 12 GROUP BY id), s AS (SELECT avg(m) + stddev_samp(m) AS l FROM m) SELECT count(*) AS records, count(*) FILTER (WHERE m <= l) AS retained, count(*) FILTER (WHERE m > l) AS removed, round(count(*) FILTER (WHERE m <= l) / count(*), 9) AS retained_share, round(count(*) FILTER (WHERE m > l) / count(*), 9) AS removed_share, round(avg(m), 9) AS mean, round(stddev_samp(m), 9) AS deviation FROM m, s")
def filter_report(spark, d):
    kept = neighbours.statistical_outliers(neighbours.mean_distances(A.vec_points(spark, d), 12), 1.0)
    return audits.filter_report(kept, "keep", "mean_dist").withColumns({c: F.round(c, 9) for c in ("retained_share", "removed_share", "mean", "deviation")})


_CROSS = "c AS (SELECT *, floor(x * 0.2::DOUBLE) AS ix, floor(y * 0.2::DOUBLE) AS iy, floor(z * 0.2::DOUBLE) AS iz, x < 40 AS sor FROM lp), n AS (SELECT *, CASE WHEN sor THEN count(*) FILTER (WHERE sor) OVER (PARTITION BY ix, iy, iz) ELSE 0 END AS n FROM c)"


def _crossed(spark, d):
    p = cells.with_cells(A.line_rows(spark, d), 5.0).withColumn("sor", F.col("x") < 40)
    return audits.crossed_counts(p, "sor", cells.CELL)


@query(f"WITH {A.LP}, {_CROSS} SELECT CAST(t AS INTEGER) AS threshold, count(*) FILTER (WHERE n > t) AS kept, count(*) FILTER (WHERE n > t AND sor) AS kept_after FROM n, (SELECT unnest([5, 10, 20, 40]) AS t) GROUP BY t")
def threshold_rows(spark, d):
    p = _crossed(spark, d).withColumns({f"keep_{t}": F.col("n") > t for t in (5, 10, 20, 40)})
    return audits.threshold_rows(p, [5, 10, 20, 40], "sor")


@query(f"WITH {A.LR.replace('lp AS', 'lp AS')}, c AS (SELECT key, x, floor(x * 0.2::DOUBLE) AS ix, floor(y * 0.2::DOUBLE) AS iy, floor(z * 0.2::DOUBLE) AS iz, x < 40 AS sor FROM lp) SELECT key, CASE WHEN sor THEN count(*) FILTER (WHERE sor) OVER (PARTITION BY ix, iy, iz) ELSE 0 END AS n FROM c")
def crossed_counts(spark, d):
    return _crossed(spark, d).select("key", "n")


@query(f"WITH {A.LP}, {_CROSS}, k AS (SELECT ix, iy, iz, count(*) AS a, count(*) FILTER (WHERE sor) AS b FROM c GROUP BY ALL), f AS (SELECT a AS n, 1 AS before, 0 AS after FROM k UNION ALL SELECT b, 0, 1 FROM k WHERE b > 0) SELECT n, CAST(sum(before) AS BIGINT) AS before, CAST(sum(after) AS BIGINT) AS after FROM f GROUP BY n")
def frequency_rows(spark, d):
    p = cells.with_cells(A.line_points(spark, d), 5.0).withColumn("sor", F.col("x") < 40)
    return audits.frequencies(p, "sor", cells.CELL)


_TILES = "t AS (SELECT CAST(floor(x::FLOAT::DOUBLE / 10.0::DOUBLE) AS BIGINT) AS tx, CAST(floor(y::FLOAT::DOUBLE / 10.0::DOUBLE) AS BIGINT) AS ty, x, y, z FROM lp)"


@query(f"WITH {A.LP}, {_TILES}, r AS (SELECT 't_' || replace((tx + 10000)::VARCHAR, '-', 'm') || '_' || replace((ty + 10000)::VARCHAR, '-', 'm') AS name, count(*) AS points, count(*) FILTER (WHERE z > 9) AS high, count(*) FILTER (WHERE x > 49.5) AS edge FROM t GROUP BY tx, ty) SELECT count(*) AS regions, CAST(sum(points) AS BIGINT) AS points, CAST(sum(high) AS BIGINT) AS high, CAST(sum(edge) AS BIGINT) AS edge, count(*) FILTER (WHERE edge > 0) AS filled, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE edge = 0), '') AS empty FROM r")
def region_rollup(spark, d):
    t = cells.tiles(A.line_points(spark, d), 10.0).groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("points"), F.count_if(F.col("z") > 9).alias("high"), F.count_if(F.col("x") > 49.5).alias("edge"))
    return audits.rolled_up(t.withColumn("name", cells.tile_name(F.col("tx"), F.col("ty"))), "name", ["points", "high", "edge"], "edge")


@query(f"WITH {A.LP}, c AS (SELECT CAST(floor(x / 2.0::DOUBLE) AS BIGINT) AS ix, CAST(floor(y / 2.0::DOUBLE) AS BIGINT) AS iy, min(z) AS low, max(z) AS high FROM lp GROUP BY ALL) SELECT ix, iy, low, high FROM c WHERE high - low > 5")
def vertical_cells(spark, d):
    p = A.line_points(spark, d).groupBy(F.floor(F.col("x") / 2.0).alias("ix"), F.floor(F.col("y") / 2.0).alias("iy")).agg(F.min("z").alias("low"), F.max("z").alias("high"))
    return p.filter("high - low > 5")


@query(f"WITH {A.LP}, {_TILES} SELECT tx, ty, count(*) AS n, round(sum(z), 4) AS z FROM t GROUP BY ALL")
def tile_partition(spark, d):
    """Written as one folder a tile and read back, tiles from the folders' names; a misplaced row is an error."""
    rows = cells.tiles(A.line_points(spark, d), 10.0)
    back = sinks.write_tiles(rows, 10.0, folders.path(spark, "tiles"), ["x", "y", "z"])
    return back.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 4).alias("z"))


@query("SELECT event_id, json_extract_string(props, '$.page') AS page, json_valid(props) AS valid FROM events")
def json_props(spark, d):
    from ..sources import records

    return records.json_field(A.table(spark, d, "events"), "props", "page").select("event_id", "page", "valid")


@query("WITH p AS (SELECT p_type, CASE WHEN starts_with(p_type, 'PROMO') THEN 'promo' WHEN starts_with(p_type, 'STANDARD') THEN 'standard' WHEN starts_with(p_type, 'S') THEN 'small' ELSE 'other' END AS name, p_size FROM part) SELECT name, count(*) AS parts, CAST(sum(p_size) AS BIGINT) AS size FROM p GROUP BY name")
def path_inventory(spark, d):
    p = A.table(spark, d, "part")
    name = audits.assigned(p, "p_type", [("promo", "PROMO"), ("standard", "STANDARD"), ("small", "S")], "other")
    return p.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("parts"), F.sum("p_size").alias("size"))


@query("SELECT page_id, regexp_extract(coalesce(html, ''), '<a [^>]*href=\"([^\"]*)\"', 1) AS link, regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(coalesce(url, ''), '[?&]page=([^&#]*)', 1) AS page FROM pages")
def html_form_url(spark, d):
    from ..sources import records

    return records.links(A.table(spark, d, "pages"))


@query(f"WITH {A.EV}, s AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR us - lag(us) OVER w > 43200000000 THEN 1 ELSE 0 END AS f FROM ev WHERE event_type <> 'view' WINDOW w AS (PARTITION BY user_id, event_type ORDER BY us, event_id)) SELECT event_type, count(DISTINCT user_id) AS obstacles, CAST(sum(f) AS BIGINT) AS collisions FROM s GROUP BY event_type")
def contact_report(spark, d):
    from ..operators import sequences

    e = A.stream(spark, d).filter("event_type <> 'view'")
    s = sequences.sessions(e, Window.partitionBy("user_id", "event_type").orderBy("us", "event_id"), "us", 43_200_000_000)
    each = s.groupBy("event_type", "user_id").agg(F.max("session").alias("n"))
    return each.groupBy("event_type").agg(F.count(F.lit(1)).alias("obstacles"), F.sum("n").alias("collisions"))


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_updates(spark, d):
    return audits.latest(A.table(spark, d, "events").withColumn("revision", F.col("event_id")), "user_id", "revision", ["event_id", "event_type"])


@query(f"WITH {A.EV}, s AS (SELECT *, floor(value) AS stamp FROM ev), f AS (SELECT *, coalesce(stamp > max(stamp) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM s), r AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS r FROM f) SELECT event_id, fresh, CAST(row_number() OVER (PARTITION BY user_id, r ORDER BY us, event_id) - 1 AS INTEGER) AS missed FROM r")
def monotone_stamps(spark, d):
    e = A.stream(spark, d).withColumn("stamp", F.floor("value"))
    return motion.fresh(e, "user_id", ["us", "event_id"], "stamp").select("event_id", "fresh", "missed")


@query(f"WITH {A.EV}, s AS (SELECT *, value <= 40 AS s FROM ev), f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR s <> lag(s) OVER w THEN 1 ELSE 0 END AS f FROM s WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), r AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT user_id, min(us) AS since, max(us) AS until FROM r WHERE s GROUP BY user_id, run HAVING max(us) - min(us) >= 21600000000")
def settled_runs(spark, d):
    return motion.settled(A.stream(spark, d), A.by_user(), F.col("value") <= 40, "user_id", "us", 21_600_000_000)


_XY = "p AS (SELECT *, value / 10 AS x, event_id % 17 / 2.0::DOUBLE AS y FROM ev)"


def _walk(spark, d):
    return A.stream(spark, d).withColumns({"x": F.col("value") / 10, "y": F.col("event_id") % 17 / 2.0})


@query(f"WITH {A.EV}, {_XY}, w AS (SELECT user_id, us - first_value(us) OVER w AS t, sqrt((x - first_value(x) OVER w) * (x - first_value(x) OVER w) + (y - first_value(y) OVER w) * (y - first_value(y) OVER w)) AS d FROM p WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)) SELECT user_id, round(max(d), 9) AS moved, max(d) <= 4 AS immobile FROM w WHERE t <= 86400000000 GROUP BY user_id")
def immobile_users(spark, d):
    out = motion.immobile(_walk(spark, d), "user_id", ["us", "event_id"], "us", ["x", "y"], 86_400_000_000, 4.0)
    return out.withColumn("moved", F.round("moved", 9))


@query(f"WITH {A.EV}, {_XY}, s AS (SELECT user_id, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d, sqrt((last_value(x) OVER f - first_value(x) OVER f) * (last_value(x) OVER f - first_value(x) OVER f) + (last_value(y) OVER f - first_value(y) OVER f) * (last_value(y) OVER f - first_value(y) OVER f)) AS e FROM p WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id), f AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT user_id, count(*) AS rows, round(coalesce(sum(d), 0), 6) AS length, round(max(e), 9) AS straight FROM s GROUP BY user_id")
def path_lengths(spark, d):
    out = motion.paths(_walk(spark, d), A.by_user(), "user_id", ["x", "y"])
    return out.withColumns({"length": F.round("length", 6), "straight": F.round("straight", 9)})


@query(f"WITH {A.EV} SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY us DESC, event_id DESC) AS n FROM ev) WHERE n <= 10")
def queued_states(spark, d):
    return motion.queued(A.stream(spark, d), "user_id", ["us", "event_id"], 10).select("event_id")


@query("SELECT event_id, value < 90 AS taken FROM events")
def ingress(spark, d):
    """Commands above 90 stand for ones that aren't finite."""
    e = A.table(spark, d, "events").withColumn("v", F.when(F.col("value") >= 90, float("nan")).otherwise(F.col("value")))
    return motion.accepted(e, ["v"]).select("event_id", "taken")


@query()
def residency(spark, d):
    payloads = A.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("payload"), (F.col("n_nationkey") % 5 * 2.0).alias("px"), (F.floor(F.col("n_nationkey") / 5) * 2.0).alias("py"))
    return motion.residency(_walk(spark, d), payloads, "user_id", ["us", "event_id"], 3.0)
