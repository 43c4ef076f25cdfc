"""Joins by place: capped neighbours, nearest rows of another table, cells, gaps, intervals, capsules, halos, replies."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored
from . import sequences
from .cells import AXES, CELL, with_cells

#: Half of the 26 neighbouring cells, and the cell itself: each pair of cells once.
HALF = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) >= (0, 0, 0)]


def _around(points: DataFrame, names: list[str]) -> DataFrame:
    """points sent to the cells around their own, for each of the integer columns."""
    for n in names:
        points = points.withColumn("__d", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(n, F.col(n) + F.col("__d"))
    return points.drop("__d")


def within(points: DataFrame, others: DataFrame, radius: float, axes: str = "xyz") -> DataFrame:
    """(id, oid, dist) of the points (id, ...) and others (oid, ...) at most radius apart on the axes: cells as wide as the radius."""
    cell = [f"i{a}" for a in axes]
    at = lambda df: df.withColumns({f"i{a}": F.floor(F.col(a) / radius) for a in axes})
    far = _around(at(others), cell).withColumnsRenamed({a: f"o{a}" for a in AXES if a in others.columns})
    d = [F.col(a) - F.col(f"o{a}") for a in axes]
    near = at(points).join(far, cell).withColumn("dist", F.sqrt(reduce(Column.__add__, [c * c for c in d])))
    return near.filter(F.col("dist") <= radius)


def _halvings(others: DataFrame, radius: float, k: int, axes: str) -> int:
    """How often the radius is halved until a cell of its width, where most others lie, holds a few times k at most."""
    n = others.groupBy(*[F.floor(F.col(a) / radius) for a in axes]).agg(F.count(F.lit(1)).cast("double").alias("n"))
    full = n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    return max(0, math.floor(math.log2(max(1.0, 4 * full / k)) / len(axes)))


def _ranked(near: DataFrame, k: int) -> DataFrame:
    if k == 1:
        rest = [c for c in near.columns if c not in ("id", "dist", "oid")]
        best = near.groupBy("id").agg(F.min(F.struct("dist", "oid", *rest)).alias("m"))
        return best.select("id", "m.*").withColumn("rank", F.lit(1))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("dist", "oid"))).filter(F.col("rank") <= k)


def nearest_within(points: DataFrame, others: DataFrame, radius: float, k: int = 1, axes: str = "xyz", itself: bool = True) -> DataFrame:
    """within() with rank: the k nearest of each point only, ties to the lower oid; without those of its own id, if itself is False.

    Where others are crowded a point looks within a part of the radius first, and only those that find fewer than k there look farther,
    twice as far in each round: what is compared grows with the points, not with the pairs that the radius has.
    """
    def look(asked: DataFrame, far: float) -> DataFrame:
        near = within(asked, others, far, axes)
        return _ranked(near if itself else near.filter("id <> oid"), k)

    steps = _halvings(others, radius, k, axes)
    if not steps:
        return look(points, radius)
    left, others, done = stored(points, "asked"), stored(others, "offered"), None
    for step in range(steps, -1, -1):
        near = look(left, radius / 2**step)
        if step:
            near = stored(near, "nearest")
            full = near.filter(F.col("rank") == k).select("id")
            left = stored(left.join(full, "id", "left_anti"), "asked")
            near = near.join(full, "id", "left_semi")
        done = near if done is None else done.unionByName(near)
        if step and left.isEmpty():
            break
    return done


def capped_neighbours(points: DataFrame, radius: float, k: int) -> DataFrame:
    """(id, oid, dist, rank): up to k other rows within the closed radius, nearest first, ties to the lower id."""
    return nearest_within(points, points.withColumnRenamed("id", "oid"), radius, k, itself=False).select("id", "oid", "dist", "rank")


def owned_by_ground(points: DataFrame, ground: DataFrame, radius: float, height: float) -> DataFrame:
    """(id, oid, ground): the ground row nearest in the plane, within radius, and whether the point lies within height of it."""
    best = nearest_within(points, ground, radius, 1, "xy")
    return best.select("id", "oid", (F.abs(F.col("z") - F.col("oz")) <= height).alias("ground"))


def lattice_lookup(points: DataFrame, lattice: DataFrame, size: float) -> DataFrame:
    """(id, value): the value of the lattice cell (i, j) of a point; on an edge the cells that share it are tried too, first the own,
    then those before it on x, on y, on both; null where none is there."""
    gx, gy = F.col("x") / size, F.col("y") / size
    i, j = F.floor(gx), F.floor(gy)
    tries = [(0, 0), (1, 0), (0, 1), (1, 1)]
    closed = [F.lit(True), gx == i, gy == j, (gx == i) & (gy == j)]
    moves = F.array(*[F.when(c, F.struct(F.lit(n).alias("turn"), (i - a).alias("i"), (j - b).alias("j"))) for n, ((a, b), c) in enumerate(zip(tries, closed, strict=True))])
    asked = points.select("id", F.explode(F.array_compact(moves)).alias("m")).select("id", "m.*")
    got = asked.join(lattice, ["i", "j"], "left").groupBy("id")
    return got.agg(F.min(F.when(F.col("value").isNotNull(), F.struct("turn", "value"))).alias("m")).select("id", "m.value")


def cell_links(cells: DataFrame, reach: float, level: str, most: int) -> DataFrame:
    """(ax, ay, bx, by): pairs of cells (ix, iy, level) at most reach apart, each once, whose levels differ by at most `most`."""
    r = int(reach)
    steps = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if (a, b) > (0, 0) and a * a + b * b <= reach * reach + 1e-10]
    moves = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in steps])
    sent = cells.select(F.col("ix").alias("ax"), F.col("iy").alias("ay"), F.col(level).alias("la"), F.explode(moves).alias("m"))
    sent = sent.withColumns({"ix": F.col("ax") + F.col("m.dx"), "iy": F.col("ay") + F.col("m.dy")})
    near = sent.join(cells.select("ix", "iy", F.col(level).alias("lb")), ["ix", "iy"])
    return near.filter(F.abs(F.col("la") - F.col("lb")) <= most).select("ax", "ay", F.col("ix").alias("bx"), F.col("iy").alias("by"))


def box_gaps(boxes: DataFrame, reach: float) -> DataFrame:
    """(a, b, gap) with a < b: boxes (box, lx, ux, ly, uy, lz, uz) whose gap is at most reach. Boxes meet in cells as wide as the
    reach that they cover, grown by half of it; a pair counts in the first cell that both have."""
    size = reach
    grown = boxes
    for a in "xy":
        grown = grown.withColumn(f"g{a}", F.floor((F.col(f"l{a}") - reach / 2) / size)).withColumn(f"c{a}", F.explode(F.sequence(F.col(f"g{a}"), F.floor((F.col(f"u{a}") + reach / 2) / size))))
    other = grown.select("cx", "cy", *[F.col(c).alias(f"o_{c}") for c in grown.columns if c not in ("cx", "cy")])
    apart = [F.greatest(F.col(f"l{a}") - F.col(f"o_u{a}"), F.col(f"o_l{a}") - F.col(f"u{a}"), F.lit(0.0)) for a in AXES]
    first = [F.greatest(f"g{a}", f"o_g{a}") == F.col(f"c{a}") for a in "xy"]
    near = grown.join(other, ["cx", "cy"]).filter(F.col("box") < F.col("o_box")).filter(first[0] & first[1])
    near = near.withColumn("gap", F.sqrt(reduce(Column.__add__, [c * c for c in apart])))
    return near.filter(F.col("gap") <= reach).select(F.col("box").alias("a"), F.col("o_box").alias("b"), "gap")


#: Rows of a block, and blocks at most: beyond, blocks grow. Two blocks meet in one task.
BLOCK, BLOCKS = 2000, 64
#: Pairs that a task looks at together.
PAIRS = 1 << 18


def _packed(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, rows): the rows of a block as one Arrow stream, by rising key."""
    def pack(group: pa.Table) -> pa.Table:
        at, sink = group.sort_by(key), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, at.drop_columns(["__b"]).schema) as out:
            out.write_table(at.drop_columns(["__b"]))
        return pa.table({"block": at.column("__b").slice(0, 1), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    at = rows.filter(F.col(key).isNotNull()).withColumn("__b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return at.groupBy("__b").applyInArrow(pack, "block int, rows binary")


def all_pairs(rows: DataFrame, key: str, block: int = BLOCK, near=None, figures=None, names: tuple[str, ...] = ()) -> DataFrame:
    """(key, o_key, names): every two of the rows once, the lower key first, of those that near(rows, other rows) holds in an array of all
    their pairs; figures(one row of each pair, the other) are their doubles. As many pairs as there are.

    Rows are dealt to blocks, which are shuffled as one row each; a task reads two of them, holds nothing else, and gives its pairs in
    small parts. What is shuffled and stored follows the rows, not the pairs.
    """
    n = max(1, min(-(-rows.count() // block), BLOCKS))
    columns = [c for c in rows.columns if c != key]
    kind = rows.schema[key].dataType.simpleString()

    def parts(own: pa.Table, other: pa.Table, same: bool):
        mine, theirs = (t.column(key).to_numpy() for t in (own, other))
        down, across = ({c: t.column(c).to_numpy() for c in columns} for t in (own, other))
        wide = len(theirs)
        step = max(1, PAIRS // max(1, wide))
        for low in range(0, len(mine), step):
            k, some = mine[low : low + step], {c: v[low : low + step] for c, v in down.items()}
            left = None if near is None else near(some, across)
            # One end stays the same for many rows, so that a sink's columns are small.
            for swap in (False,) if same else (False, True):
                held = k[:, None] > theirs if swap else k[:, None] < theirs
                i, j = np.divmod(np.flatnonzero(held if left is None else held & left).astype(np.int32), np.int32(wide))
                if len(i):
                    values = figures({c: v[i] for c, v in some.items()}, {c: v[j] for c, v in across.items()}) if figures else ()
                    ends = (theirs[j], k[i]) if swap else (k[i], theirs[j])
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (*ends, *values))], names=[key, f"o_{key}", *names])

    def compare(batches):
        for batch in batches:
            for q in range(batch.num_rows):
                own, other = (pa.ipc.open_stream(batch.column(c)[q].as_buffer()).read_all() for c in ("rows", "o_rows"))
                yield from parts(own, other, batch.column("block")[q].as_py() == batch.column("o_block")[q].as_py())

    own = _packed(rows, key, n)
    other = own.select(F.col("block").alias("o_block"), F.col("rows").alias("o_rows"))
    own, other = own.repartitionById(n, "block"), other.repartitionById(n, "o_block")
    # Of two blocks each is the left one as often as the other.
    once = F.expr("block = o_block OR (block < o_block) = ((block + o_block) % 2 = 0)")
    both = own.join(other.hint("shuffle_replicate_nl"), once)
    return both.mapInArrow(compare, ", ".join([f"{key} {kind}", f"o_{key} {kind}", *[f"{c} double" for c in names]]))


def _ends(key: str) -> list[Column]:
    return [F.col(key).alias("a"), F.col(f"o_{key}").alias("b")]


def plane_pairs(planes: DataFrame, least: float, most: float = 180.0, reach: float | None = None) -> DataFrame:
    """(a, b, degrees) with a < b: planes (plane, nx, ny, nz) that meet at an angle of `least` degrees or more, and `most` at most; with a
    reach also gap, the distance of their places (x, y, z), which is at most that."""
    # near() leaves out what misses a limit by more than rounding does; the figures decide on the others, and on what is no number.
    high = math.cos(math.radians(least)) + 1e-9 if least > 0 else None
    low = math.cos(math.radians(most)) - 1e-9 if most < 90 else None
    n = [f"n{a}" for a in AXES]
    matrix = lambda rows, names: np.stack([rows[c] for c in names], 1)

    def near(own, other):
        size = np.abs(matrix(own, n) @ matrix(other, n).T)
        far = np.zeros(size.shape, bool) if high is None else size > high
        if low is not None:
            far |= size < low
        if reach is not None:
            p, q = matrix(own, AXES), matrix(other, AXES)
            p2, q2 = (p * p).sum(1), (q * q).sum(1)
            square = np.concatenate([p, p2[:, None], np.ones((len(p), 1))], 1) @ np.concatenate([-2 * q, np.ones((len(q), 1)), q2[:, None]], 1).T
            far |= square > reach * reach * (1 + 1e-9) + 1e-13 * (p2.max(initial=0.0) + q2.max(initial=0.0))
        return ~far

    def figures(own, other):
        dots = lambda c, d: reduce(np.add, [x * y for x, y in zip(c, d, strict=True)])
        cosine = dots([own[c] for c in n], [other[c] for c in n])
        if reach is None:
            return (cosine,)
        off = [own[a] - other[a] for a in AXES]
        return cosine, np.sqrt(dots(off, off))

    gap = [] if reach is None else ["gap"]
    columns = [F.col(c).cast("double").alias(c) for c in (*n, *([] if reach is None else AXES))]
    pairs = all_pairs(planes.select("plane", *columns), "plane", near=near, figures=figures, names=("cosine", *gap))
    angle = F.degrees(F.acos(F.least(F.abs("cosine"), F.lit(1.0))))
    pairs = pairs if reach is None else pairs.filter(F.col("gap") <= reach)
    return pairs.withColumn("degrees", angle).filter((F.col("degrees") >= least) & (F.col("degrees") <= most)).select(*_ends("plane"), "degrees", *gap)


def in_turn(rows: DataFrame, key: str, first: int = 1000, most: int | None = None) -> list[Column]:
    """Conditions on a number that part the rows by rising key: some `first` rows, then twice as many each time, up to `most`."""
    n = rows.count()
    shares, size, upto = [], first, first
    while upto < n:
        shares.append(upto / n)
        size = min(2 * size, most or 2 * size)
        upto += size
    cuts = sorted(set(rows.approxQuantile(key, shares, 1e-4))) if shares else []
    value = F.col(key)
    low = [None, *[value > c for c in cuts]]
    high = [*[value <= c for c in cuts], None]
    both = [F.lit(True) if a is None and b is None else b if a is None else a if b is None else a & b for a, b in zip(low, high, strict=True)]
    return both


#: Intervals of either side of a block, and pairs of a task, of a crowd of overlaps.
DEALT, PER_TASK = 10_000, 4_000_000


def _dealt(left: DataFrame, right: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both tables, and what they meet by, for a merge join whose tasks are as many as the pairs of equal keys need; the rows of a key
    beyond DEALT are dealt to blocks on either side, and each two blocks are a group of their own."""
    both = left.select(*key, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(right.select(*key, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    n = both.groupBy(*key).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r")).filter("__l > 0 AND __r > 0")
    pairs, rows, most = n.agg(F.sum(F.col("__l") * F.col("__r")), F.sum(F.col("__l") + F.col("__r")), F.max(F.greatest("__l", "__r"))).first()
    if (most or 0) > DEALT:
        blocks = [F.ceil(F.col(c) / DEALT).cast("int").alias(c) for c in ("__l", "__r")]
        many = stored(n.filter(F.greatest("__l", "__r") > DEALT).select(*key, *blocks), "crowded")

        def deal(df: DataFrame, mine: str, other: str) -> DataFrame:
            at = df.join(many, key, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in (mine, other)})
            at = at.withColumn(mine, F.pmod(F.xxhash64(*df.columns), F.col(mine)).cast("int"))
            return at.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

        left, right, key = deal(left, "__l", "__r"), deal(right, "__r", "__l"), [*key, "__l", "__r"]
    tasks = min(4096, max(left.sparkSession.sparkContext.defaultParallelism, (rows or 0) // 500_000, (pairs or 0) // PER_TASK))
    left, right = (df.repartition(tasks, *key) for df in (left, right))
    return left, right.hint("merge"), key


def interval_overlaps(left: DataFrame, right: DataFrame, kind: list[str], size: float, crowds: bool = False) -> DataFrame:
    """(kind, a, b, low, high): intervals (kind, a or b, low, high) of one kind that share more than a point, with the part that they
    share. In the slots of the given width that they cover those meet of which one begins in the slot: on turn 0 the left one, on turn 1
    the right one alone. crowds: each has many overlaps, so they are counted first and tasks follow the pairs, not the bytes."""
    first = F.floor(F.col("low") / size)
    slots = lambda df: df.filter("low < high").withColumn("slot", F.explode(F.sequence(first, F.floor(F.col("high") / size))))
    begins = first == F.col("slot")
    own = slots(left).withColumn("turn", F.when(begins, 0).otherwise(1))
    other = slots(right).withColumn("turn", F.explode(F.when(begins, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    other, key = other.withColumnsRenamed({"low": "olow", "high": "ohigh"}), [*kind, "slot", "turn"]
    if crowds:
        own, other, key = _dealt(own, other, key)
    near = own.join(other, key).filter((F.col("low") < F.col("ohigh")) & (F.col("olow") < F.col("high")))
    return near.select(*kind, "a", "b", F.greatest("low", "olow").alias("low"), F.least("high", "ohigh").alias("high"))


def united(intervals: DataFrame, kind: list[str], size: float) -> DataFrame:
    """(kind, low, high): the unions of each kind's intervals that hold more than a point. Those that begin in one slot of the given width
    are united first, so that only unions of a kind come together, not its intervals."""
    some = intervals.filter("low < high").select(F.struct(*kind, F.floor(F.col("low") / size).alias("slot")).alias("__k"), "low", "high")
    parts = sequences.merged(some, "__k", "low", "high").select(F.struct(*[F.col(f"__k.{c}").alias(c) for c in kind]).alias("__k"), "low", "high")
    return sequences.merged(parts, "__k", "low", "high").select("__k.*", "low", "high")


def covered(left: DataFrame, right: DataFrame, kind: list[str], size: float) -> DataFrame:
    """(kind, a, low, high): the parts of the left intervals (kind, a, low, high) that right ones (kind, low, high) cover, as unions. A left
    interval meets the unions of the right ones, so a crowd of overlaps is one."""
    both = interval_overlaps(left.filter("low < high"), united(right, kind, size).withColumn("b", F.col("low")), kind, size)
    one = sequences.merged(both.select(F.struct(*kind, "a").alias("__k"), "low", "high"), "__k", "low", "high")
    return one.select("__k.*", "low", "high")


def _to_segment(p: list[Column], a: list[Column], b: list[Column]) -> Column:
    """Distance of p to the segment from a to b."""
    ab, ap = [y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, p, strict=True)]
    dot = lambda u, v: reduce(Column.__add__, [x * y for x, y in zip(u, v, strict=True)])
    t = F.greatest(F.least(F.coalesce(F.try_divide(dot(ap, ab), dot(ab, ab)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    off = [y - t * x for x, y in zip(ab, ap, strict=True)]
    return F.sqrt(dot(off, off))


def capsule_cover(pieces: DataFrame, segments: DataFrame, radius: float, longest: float) -> DataFrame:
    """(piece, seg): pieces (piece, px, py, pz, qx, qy, qz) both of whose ends lie within radius of one segment (seg, ax ... bz), the
    lowest such; null for the others. longest: no segment is longer, which is checked. A segment goes to the cells that its box touches,
    grown by the radius. Segments take their turns by number, few first, and a covered piece meets no later ones."""
    size = max(2 * radius, longest / 8)
    long = F.sqrt(reduce(Column.__add__, [(F.col(f"b{a}") - F.col(f"a{a}")) * (F.col(f"b{a}") - F.col(f"a{a}")) for a in AXES]))
    segments.agg(F.max(F.when(long > longest, F.raise_error(F.lit("a segment is longer than said")).cast("int")).otherwise(F.lit(1)))).collect()
    end = lambda e: _to_segment([F.col(f"{e}{a}") for a in AXES], [F.col(f"a{a}") for a in AXES], [F.col(f"b{a}") for a in AXES])
    reach = radius * (1 + 1e-9)
    left, done = stored(pieces.withColumns({f"i{a}": F.floor(F.col(f"p{a}") / size) for a in AXES}), "pieces"), None
    for turn in in_turn(segments, "seg"):
        sent = segments.filter(turn)
        for a in AXES:
            low, high = F.least(f"a{a}", f"b{a}") - reach, F.greatest(f"a{a}", f"b{a}") + reach
            sent = sent.withColumn(f"i{a}", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
        near = left.join(sent, CELL).filter((end("p") <= radius) & (end("q") <= radius))
        found = stored(near.groupBy("piece").agg(F.min("seg").alias("seg")), "covered")
        done = found if done is None else done.unionByName(found)
        left = stored(left.join(found, "piece", "left_anti"), "pieces")
        if left.isEmpty():
            break
    return pieces.select("piece").join(done, "piece", "left")


def cubic_halo(points: DataFrame, size: float, margin: float) -> DataFrame:
    """Every point once for each cube that it lies in or within margin of (half-open): (cx, cy, cz, own)."""
    at = with_cells(points, size, divide=True).withColumnsRenamed({f"i{a}": f"h{a}" for a in AXES})
    out = at
    for a in AXES:
        out = out.withColumn(f"d{a}", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn(f"c{a}", F.col(f"h{a}") + F.col(f"d{a}"))
    inside = [(F.col(a) >= F.col(f"c{a}") * size - margin) & (F.col(a) < (F.col(f"c{a}") + 1) * size + margin) for a in AXES]
    own = reduce(Column.__and__, [F.col(f"d{a}") == 0 for a in AXES])
    return out.filter(reduce(Column.__and__, inside)).withColumn("own", own).drop(*[f"{p}{a}" for a in AXES for p in "hd"])


def replies(requests: DataFrame, answers: DataFrame, key: str, time: str, expires: int) -> DataFrame:
    """requests with answer (time of the first answer of the same key, not before the request and at most expires after it) and
    timely: whether there is one. Equal requests stay rows of their own; one without key or time has no answer.

    Both go to slots of time as long as `expires`, answers to the one before theirs too, and a request takes the next answer of its
    slot: a busy key is as many groups as it has slots, and no pair is made.
    """
    slot = F.floor(F.col("__t") / max(expires, 1))
    asked = requests.select(F.struct(*requests.columns).alias("__r"), F.col(key).alias("__k"), F.col(time).alias("__t")).withColumn("__s", slot)
    given = answers.select(F.lit(None).cast(asked.schema["__r"].dataType).alias("__r"), F.col(key).alias("__k"), F.col(time).alias("__t")).filter("__k is not null and __t is not null")
    given = given.withColumn("__s", F.explode(F.array(slot, slot - 1)))
    after = Window.partitionBy("__k", "__s").orderBy("__t", F.col("__r").isNull()).rowsBetween(0, Window.unboundedFollowing)
    first = F.first(F.when(F.col("__r").isNull(), F.col("__t")), ignorenulls=True).over(after)
    got = asked.unionByName(given).withColumn("__a", first).filter("__r is not null")
    answer = F.when(F.col("__k").isNotNull() & (F.col("__a") <= F.col("__t") + expires), F.col("__a"))
    return got.select("__r.*", answer.alias("answer")).withColumn("timely", F.col("answer").isNotNull())


def welded(vertices: DataFrame) -> DataFrame:
    """(a, b) with a < b: owners that have a vertex (owner, x, y, z) at exactly the same place, each pair once. The owners of a place
    are chained in order, which connects them all without every pair."""
    one = vertices.select("owner", *[(F.col(a) + 0.0).alias(a) for a in AXES]).distinct()
    w = Window.partitionBy(*AXES).orderBy("owner")
    return one.withColumn("b", F.lead("owner").over(w)).filter("b IS NOT NULL").select(F.col("owner").alias("a"), "b").distinct()


def terrain(points: DataFrame, corners: DataFrame, size: float) -> DataFrame:
    """(id, ground): height over the lattice cell (i, j, z00, z10, z11, z01), each half of it a plane; null outside of the lattice."""
    at = points.withColumns({"i": F.floor(F.col("x") / size), "j": F.floor(F.col("y") / size)})
    u, v = F.col("x") / size - F.col("i"), F.col("y") / size - F.col("j")
    lower = F.col("z00") + u * (F.col("z10") - F.col("z00")) + v * (F.col("z11") - F.col("z10"))
    upper = F.col("z00") + u * (F.col("z11") - F.col("z01")) + v * (F.col("z01") - F.col("z00"))
    return at.join(corners, ["i", "j"], "left").select("id", F.when(u >= v, lower).otherwise(upper).alias("ground"))
