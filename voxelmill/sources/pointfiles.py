"""Point files as a Spark data source: spark.read.format("pcd").load(path), for ASCII and binary PCD and PLY files.

A path is a file, a folder or a pattern. Files are cut into ranges of whole rows, one partition each: fixed-size rows in a binary file,
lines in a text one, where a range owns the lines that start in it. Headers are read on the driver, payloads in tasks alone. Rows of
a text file have their place if somebody has counted those before them: open_points() has tasks count all ranges first;
without that each task counts what stands before its own. Files are read through pyarrow's file systems, so that a path may be local
or on any store they know.
"""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bounds of a header; a file beyond them is refused.
HEADER_LINES, HEADER_BYTES = 256, 1 << 20
#: Bytes of a partition.
SPLIT = 32 << 20
#: Fixed values of the two formats: type letters and names.
PCD_TYPES = {"F4": "f4", "F8": "f8", "I1": "i1", "I2": "i2", "I4": "i4", "I8": "i8", "U1": "u1", "U2": "u2", "U4": "u4", "U8": "u8"}
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
_SQL = {"f4": "float", "f8": "double", "i1": "byte", "i2": "short", "i4": "int", "i8": "long", "u1": "short", "u2": "int", "u4": "long", "u8": "decimal(20,0)"}


@dataclass(frozen=True)
class Header:
    """Where the rows of a file are and what they hold."""

    fields: tuple[tuple[str, str], ...]
    rows: int
    text: bool
    start: int
    big: bool = False

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([(n, (">" if self.big else "<") + t) for n, t in self.fields])


def _lines(file, last: str) -> tuple[list[str], int]:
    """Header lines up to the one that starts with `last`, and the offset behind it."""
    head = file.read(HEADER_BYTES)
    out, at = [], 0
    while len(out) < HEADER_LINES:
        end = head.find(b"\n", at)
        if end < 0:
            break
        out.append(head[at:end].decode("ascii", "strict").strip())
        at = end + 1
        if out[-1].split(" ", 1)[0] == last:
            return out, at
    raise ValueError(f"no {last} line in the header")


def pcd_header(file) -> Header:
    lines, start = _lines(file, "DATA")
    said: dict[str, list[str]] = {}
    for line in lines:
        if not line or line[0] == "#":
            continue
        name, *values = line.split()
        if name in said:
            raise ValueError(f"{name} is declared twice")
        said[name] = values
    if lost := {"FIELDS", "SIZE", "TYPE", "WIDTH", "HEIGHT", "POINTS", "DATA"} - said.keys():
        raise ValueError(f"not declared: {sorted(lost)}")
    names = said["FIELDS"]
    count = [int(c) for c in said.get("COUNT", ["1"] * len(names))]
    if not len(names) == len(said["SIZE"]) == len(said["TYPE"]) == len(count):
        raise ValueError("FIELDS, SIZE, TYPE and COUNT differ in length")
    fields, pad = [], 0
    for name, size, kind, n in zip(names, said["SIZE"], said["TYPE"], count, strict=True):
        if kind + size not in PCD_TYPES:
            raise ValueError(f"unknown type {kind}{size}")
        for i in range(n):
            if name == "_":
                pad += 1
            fields.append((f"_pad{pad}" if name == "_" else name if n == 1 else f"{name}_{i}", PCD_TYPES[kind + size]))
    if len({f for f, _ in fields}) < len(fields):
        raise ValueError("a field is declared twice")
    rows = int(said["POINTS"][0])
    if int(said["WIDTH"][0]) * int(said["HEIGHT"][0]) != rows:
        raise ValueError("WIDTH times HEIGHT isn't POINTS")
    if said["DATA"] not in (["ascii"], ["binary"]):
        raise ValueError(f"payload {said['DATA']} isn't supported")
    return Header(tuple(fields), rows, said["DATA"] == ["ascii"], start)


def ply_header(file) -> Header:
    lines, start = _lines(file, "end_header")
    if lines[0] != "ply":
        raise ValueError("not a PLY file")
    form, element, rows, fields = None, None, None, []
    for words in (line.split() for line in lines[1:-1]):
        if words[:1] == ["format"]:
            form = words[1]
        elif words[:1] == ["element"]:
            element = words[1]
            if rows is None and element != "vertex":
                raise ValueError("vertices must come first")
            rows = int(words[2]) if element == "vertex" else rows
        elif words[:1] == ["property"] and element == "vertex":
            if words[1] not in PLY_TYPES:
                raise ValueError(f"unknown type {words[1]}")
            fields.append((words[2], PLY_TYPES[words[1]]))
    if rows is None or form not in ("ascii", "binary_little_endian", "binary_big_endian"):
        raise ValueError("no vertices or an unknown format")
    return Header(tuple(fields), rows, form == "ascii", start, form == "binary_big_endian")


def _open(path: str):
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


@dataclass
class Range(InputPartition):
    """Rows [first, last) of a binary file, or the lines that start in bytes [first, last) of a text one."""

    first: int
    last: int


@dataclass
class Piece(Range):
    """A range of one of several files. row: number of its first row, None where nobody has counted; last_one: nothing comes behind it."""

    path: str
    header: Header
    row: int | None
    last_one: bool


def files_of(path: str, ending: str) -> list[str]:
    """The file at the path; or those below a folder, or that fit a pattern, with the ending, in order of their names. None is an error."""
    store, at = _open(path)
    prefix = path[: len(path) - len(at)]
    if any(c in at for c in "*?["):
        top = at[: re.search(r"[*?\[]", at).start()].rpartition("/")[0] or "/"
        found = [f.path for f in store.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.path, at)]
    elif store.get_file_info(at).type == fs.FileType.Directory:
        found = [f.path for f in store.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(ending)]
    else:
        return [path]
    if not found:
        raise ValueError(f"no {ending} file at {path}")
    return [prefix + f for f in sorted(found)]


class PointReader(DataSourceReader):
    def __init__(self, files: list[tuple[str, Header]], split: int, columns: list[str] | None, counts: dict[str, list[int]], named: bool):
        self.files, self.split, self.columns, self.counts, self.named = files, split, columns, counts, named

    def partitions(self):
        with ThreadPoolExecutor(16) as pool:
            pieces = list(pool.map(lambda f: self._pieces(*f), self.files))
        return [p for own in pieces for p in own]

    def _pieces(self, path: str, h: Header) -> list[Piece]:
        store, at = _open(path)
        size = store.get_file_info(at).size
        if h.text:
            bounds = [(p, min(p + self.split, size)) for p in range(h.start, size, self.split)] or [(h.start, h.start)]
            rows = self.counts.get(path)
            rows = [sum(rows[:k]) for k in range(len(bounds))] if rows else [None] * len(bounds)
        else:
            if size < h.start + h.rows * h.dtype.itemsize:
                raise ValueError(f"{path}: the payload is shorter than its header says")
            step = max(1, self.split // h.dtype.itemsize)
            bounds = [(r, min(r + step, h.rows)) for r in range(0, h.rows, step)] or [(0, 0)]
            rows = [first for first, _ in bounds]
        return [Piece(*b, path, h, row, k == len(bounds) - 1) for k, (b, row) in enumerate(zip(bounds, rows, strict=True))]

    def read(self, part: Piece) -> Iterator[pa.RecordBatch]:
        h = part.header
        store, at = _open(part.path)
        with store.open_input_file(at) as f:
            row = part.row
            if h.text:
                rows = _text(f, h, part)
                if row is None:
                    row = sum(_counted(f, h, p, min(p + self.split, part.first)) for p in range(h.start, part.first, self.split))
                if part.last_one and row + len(rows) != h.rows:
                    raise ValueError(f"{part.path}: the header says {h.rows} rows, there are {row + len(rows)}")
            else:
                rows = np.frombuffer(f.read_at((part.last - part.first) * h.dtype.itemsize, h.start + part.first * h.dtype.itemsize), h.dtype)
                if part.last_one:
                    for p in range(h.start + h.rows * h.dtype.itemsize, f.size(), 1 << 20):
                        if f.read_at(1 << 20, p).strip(b"\0"):
                            raise ValueError(f"{part.path}: something other than zeros follows the payload")
        for k in range(0, len(rows), 1 << 16):
            batch = _batch(rows[k : k + (1 << 16)], h, row + k)
            if self.columns is not None:
                batch = batch.select([*self.columns, "row"])
            yield batch.append_column("file", pa.array([part.path] * batch.num_rows, pa.string())) if self.named else batch


def _lines_of(f, h: Header, first: int, last: int) -> bytes:
    """The whole lines that start in the range; one that begins before its first byte belongs to the range in front."""
    data = f.read_at(last - first + 1, first - 1) if first > h.start else b"\n" + f.read_at(last - first, first)
    cut = data.find(b"\n")
    if cut < 0:
        return b""
    data, at = data[cut + 1 :], last
    while data and data[-1:] != b"\n" and (more := f.read_at(1 << 12, at)):
        end = more.find(b"\n")
        data, at = data + (more if end < 0 else more[: end + 1]), at + len(more)
        if end >= 0:
            break
    return data


def _counted(f, h: Header, first: int, last: int) -> int:
    return sum(1 for line in _lines_of(f, h, first, last).split(b"\n") if line.strip())


def _text(f, h: Header, part: Range) -> np.ndarray:
    rows = [line.split() for line in _lines_of(f, h, part.first, part.last).decode("ascii").split("\n") if line.strip()]
    if any(len(r) != len(h.fields) for r in rows):
        raise ValueError("a row has not as many values as the header has fields")
    out = np.zeros(len(rows), h.dtype)
    for i, (name, _) in enumerate(h.fields):
        kind = h.dtype[name]
        out[name] = [float(r[i]) if kind.kind == "f" else int(r[i]) for r in rows]
    return out


def _batch(rows: np.ndarray, h: Header, first: int) -> pa.RecordBatch:
    wide = {"u1": pa.int16(), "u2": pa.int32(), "u4": pa.int64(), "u8": pa.decimal128(20, 0)}
    columns = []
    for name, t in h.fields:
        own = np.ascontiguousarray(rows[name]).astype(t)
        columns.append(pa.array(own).cast(wide[t]) if t in wide else pa.array(own))
    columns.append(pa.array(np.arange(first, first + len(rows))))
    return pa.RecordBatch.from_arrays(columns, names=[*[n for n, _ in h.fields], "row"])


class _Points(DataSource):
    """Columns are the fields of the header; row, the place in the file; and file, its path, where the path is a folder or a pattern.

    Files must have the same fields. Options: split, bytes of a partition; columns, the fields wanted, by commas. A header that is cut,
    doubled or contradicts itself is refused, as is a file of more or fewer rows than it says; zeros may pad a binary one.
    """

    header_of = None

    def _header(self, path: str) -> Header:
        store, at = _open(path)
        with store.open_input_file(at) as f:
            return type(self).header_of(f)

    def _files(self) -> list[str]:
        return files_of(self.options["path"], f".{type(self).name()}")

    def _columns(self) -> list[str] | None:
        said = self.options.get("columns")
        return [c.strip() for c in said.split(",")] if said else None

    def schema(self) -> str:
        files = self._files()
        fields = dict(self._header(files[0]).fields)
        names = self._columns() or list(fields)
        if lost := [n for n in names if n not in fields]:
            raise ValueError(f"no such field: {lost}")
        return ", ".join([*[f"`{n}` {_SQL[fields[n]]}" for n in names], "`row` long", *(["`file` string"] if files != [self.options["path"]] else [])])

    def reader(self, schema) -> PointReader:
        files = self._files()
        with ThreadPoolExecutor(16) as pool:
            headers = list(pool.map(self._header, files))
        if odd := [f for f, h in zip(files, headers, strict=True) if h.fields != headers[0].fields]:
            raise ValueError(f"other fields than in {files[0]}: {odd[:3]}")
        counts = json.loads(self.options.get("counts", "{}"))
        return PointReader(list(zip(files, headers, strict=True)), int(self.options.get("split", SPLIT)), self._columns(), counts, files != [self.options["path"]])


class PcdSource(_Points):
    header_of = staticmethod(pcd_header)

    @classmethod
    def name(cls) -> str:
        return "pcd"


class PlySource(_Points):
    header_of = staticmethod(ply_header)

    @classmethod
    def name(cls) -> str:
        return "ply"


def register(spark) -> None:
    """Makes the formats pcd and ply known to the session."""
    spark.dataSource.register(PcdSource)
    spark.dataSource.register(PlySource)


def open_points(spark, path: str, columns: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """The rows of the PCD or PLY files at a path: a file, a folder or a pattern. Lines of text files are counted by tasks first, one number
    for each range comes to the driver, so that no range is read but for itself."""
    kind = "ply" if path.lower().endswith(".ply") or (not path.lower().endswith(".pcd") and not _any(path, ".pcd")) else "pcd"
    register(spark)
    source = (PlySource if kind == "ply" else PcdSource)({"path": path, "split": str(split)})
    pieces = [p for p in source.reader(None).partitions() if p.header.text]
    counts: dict[str, list[int]] = {}
    if pieces:
        ranges = spark.createDataFrame([(k, p.path, p.header.start, p.first, p.last) for k, p in enumerate(pieces)], "k long, path string, start long, first long, last long")

        def count(batches):
            for batch in batches:
                n = []
                for name, start, first, last in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "first", "last")), strict=True):
                    store, at = _open(name)
                    with store.open_input_file(at) as f:
                        n.append(_counted(f, Header((), 0, True, start), first, last))
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("path"), pa.array(n, pa.int64())], names=["k", "path", "n"])

        for r in sorted(ranges.repartition(len(pieces)).mapInArrow(count, "k long, path string, n long").collect()):
            counts.setdefault(r.path, []).append(r.n)
        for p in pieces:
            if p.last_one and sum(counts[p.path]) != p.header.rows:
                raise ValueError(f"{p.path}: the header says {p.header.rows} rows, there are {sum(counts[p.path])}")
    reader = spark.read.format(kind).option("split", split).option("counts", json.dumps(counts))
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def _any(path: str, ending: str) -> bool:
    try:
        return any(f.lower().endswith(ending) for f in files_of(path, ending))
    except ValueError:
        return False


def cloud(records: DataFrame) -> DataFrame:
    """(row, file if there is one, x, y, z in double precision, nx, ny, nz and valid, red, green, blue): the views of point records.

    Normals come from normal_x, normal_y, normal_z or nx, ny, nz, colours from r, g, b or red, green, blue, a packed rgb or rgba, or the
    intensity; without them normals are null and invalid, and the colour is grey. A coordinate that is missing or isn't finite in
    single precision raises an error when it is read.
    """
    from ..operators import attributes as at

    names = records.columns
    if lost := [a for a in "xyz" if a not in names]:
        raise ValueError(f"no field {lost}")
    keep = [c for c in ("row", "file") if c in names]
    checked = {a: F.when(at.finite(F.col(a).cast("float")), F.col(a).cast("double")).otherwise(F.raise_error(F.lit("a coordinate is missing or not finite"))) for a in "xyz"}
    own = records.withColumns({f"__{a}": c for a, c in checked.items()})
    normals = next((n for n in (("normal_x", "normal_y", "normal_z"), ("nx", "ny", "nz")) if set(n) <= set(names)), None)
    own = at.unit_normals(own, normals)
    rgb = next((n for n in (("r", "g", "b"), ("red", "green", "blue")) if set(n) <= set(names)), None)
    packed = next((n for n in ("rgb", "rgba") if n in names), None)
    own = own.withColumns({**{f"__c{i}": F.col(rgb[i]).cast("int") if rgb else F.lit(None).cast("int") for i in range(3)}, "__p": F.col(packed).cast("long") if packed else F.lit(None).cast("long"), "__i": F.col("intensity").cast("double") if "intensity" in names else F.lit(None).cast("double")})
    own = at.colours(own, ("__c0", "__c1", "__c2"), "__p", "__i")
    return own.select(*keep, *[F.col(f"__{a}").alias(a) for a in "xyz"], "nx", "ny", "nz", "valid", "red", "green", "blue")
