"""Operators by name, with what they need of a session and of their input; a plug-in registers its own under a new name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession

#: Group of entry points whose modules register operators when they are loaded.
GROUP = "voxelmill.operators"


class Unsupported(ValueError):
    """An operator can't run here; report says why."""

    def __init__(self, report: Report):
        super().__init__(f"{report.name}: {'; '.join(report.problems)}")
        self.report = report


@dataclass(frozen=True)
class Operator:
    name: str
    function: Callable[..., DataFrame]
    #: Columns and types that the first table needs, as DDL; empty: any.
    needs: str = ""
    #: Whether it writes checkpoints, and so needs the shared folder.
    checkpoints: bool = False


@dataclass
class Report:
    """What stands against running an operator; it is supported if nothing does."""

    name: str
    problems: list[str] = field(default_factory=list)

    @property
    def supported(self) -> bool:
        return not self.problems

    def require(self) -> None:
        if self.problems:
            raise Unsupported(self)


_KNOWN: dict[str, Operator] = {}
_loaded = False


def operator(name: str, needs: str = "", checkpoints: bool = False):
    """Registers the function as the operator of that name, which must be new."""

    def put(f):
        if not name or name in _KNOWN:
            raise ValueError(f"an operator needs a name of its own: {name!r}")
        _KNOWN[name] = Operator(name, f, needs, checkpoints)
        return f

    return put


def _load() -> None:
    """The package's own operators, and those of installed plug-ins."""
    global _loaded
    if _loaded:
        return
    _loaded = True
    from ..operators import cells, neighbours, shapes

    xyz = "x double, y double, z double"
    for name, f, needs, checkpoints in (
        ("voxel_counts", cells.counts, xyz, False), ("keep_above", cells.keep_above, xyz, False), ("radius_pairs", neighbours.radius_pairs, f"id long, {xyz}", False),
        ("nearest", neighbours.nearest, f"id long, {xyz}", True), ("outlier_factors", neighbours.outlier_factors, f"id long, {xyz}", True), ("mean_distances", neighbours.mean_distances, f"id long, {xyz}", True),
        ("components", neighbours.components, f"id long, {xyz}", True), ("edge_features", shapes.edge_features, f"id long, {xyz}", True), ("contour_features", shapes.contour_features, f"id long, {xyz}", True),
    ):
        if name not in _KNOWN:
            operator(name, needs, checkpoints)(f)
    for point in metadata.entry_points(group=GROUP):
        point.load()


def names() -> list[str]:
    _load()
    return sorted(_KNOWN)


def support(spark: SparkSession, name: str, table: DataFrame | None = None) -> Report:
    """Whether the session, and the table, have what the operator needs; says all that is missing, before anything runs."""
    from pyspark.sql import types as T

    _load()
    report = Report(name)
    if name not in _KNOWN:
        report.problems.append("no such operator")
        return report
    own = _KNOWN[name]
    local = spark.sparkContext.master.split("[")[0] == "local"
    if own.checkpoints and not local and not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        report.problems.append("spark.checkpoint.dir isn't set")
    if own.needs and table is not None:
        have = {f.name: f.dataType for f in table.schema.fields}
        for f in T.StructType.fromDDL(own.needs).fields:
            if f.name not in have:
                report.problems.append(f"no column {f.name}")
            elif isinstance(f.dataType, T.NumericType) != isinstance(have[f.name], T.NumericType):
                report.problems.append(f"column {f.name} is {have[f.name].simpleString()}")
    return report


def create(spark: SparkSession, name: str) -> Callable[..., DataFrame]:
    """The operator of that name, as a function that checks its first table before it runs."""
    support(spark, name).require()
    own = _KNOWN[name]

    def run(table: DataFrame, *args, **options) -> DataFrame:
        support(spark, name, table).require()
        return own.function(table, *args, **options)

    return run
