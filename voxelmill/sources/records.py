"""Further scans: NumPy arrays, JSON fields and reports, links of pages, XML worlds and models, bag headers; and schema checks."""

from __future__ import annotations

import ast
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from .pointfiles import _SQL, SPLIT, Header, Range, _batch, _open

#: The fixed schema of a record with normals, in its order, all of single precision.
XYZINORMAL = ("x", "y", "z", "intensity", "normal_x", "normal_y", "normal_z", "curvature")


def require_xyzinormal(header: Header) -> Header:
    """The header, if it is that of binary records of the eight fields and nothing else."""
    if header.text or header.big or header.fields != tuple((n, "f4") for n in XYZINORMAL):
        raise ValueError("not binary records of x, y, z, intensity, normal and curvature in single precision")
    return header


def require_columns(df: DataFrame, schema: str) -> DataFrame:
    """df, if its columns have the names, types and order of the schema."""
    want = [(f.name, f.dataType) for f in T.StructType.fromDDL(schema).fields]
    if [(f.name, f.dataType) for f in df.schema.fields] != want:
        raise ValueError(f"columns are {df.schema.simpleString()}, not {schema}")
    return df


def npy_header(file) -> Header:
    """Header of a one-dimensional array of plain or structured numbers, or of rows of numbers (columns c0, c1 ...)."""
    magic = file.read(8)
    if magic[:6] != b"\x93NUMPY" or magic[6] not in (1, 2, 3):
        raise ValueError("not a NumPy array")
    size = struct.unpack("<H", file.read(2))[0] if magic[6] == 1 else struct.unpack("<I", file.read(4))[0]
    said = ast.literal_eval(file.read(size).decode("latin-1"))
    shape, kind = said["shape"], said["descr"]
    if said["fortran_order"] and len(shape) > 1 or len(shape) not in (1, 2):
        raise ValueError("only arrays in C order of one or two dimensions are read")
    dtype = np.dtype([tuple(f) for f in kind] if isinstance(kind, list) else kind)
    if len(shape) == 2:
        if dtype.names:
            raise ValueError("a structured array has one dimension")
        dtype = np.dtype([(f"c{i}", dtype) for i in range(shape[1])])
    fields = [(n, dtype[n]) for n in dtype.names] if dtype.names else [("value", dtype)]
    orders = {t.byteorder for _, t in fields if t.itemsize > 1}
    if any(f"{t.kind}{t.itemsize}" not in _SQL for _, t in fields) or len(orders) > 1:
        raise ValueError("unknown types or mixed byte orders")
    return Header(tuple((n, f"{t.kind}{t.itemsize}") for n, t in fields), shape[0], False, 10 + size + 2 * (magic[6] > 1), ">" in orders)


class _NpyReader(DataSourceReader):
    def __init__(self, path: str, header: Header, split: int):
        self.path, self.header, self.split = path, header, split

    def partitions(self):
        h = self.header
        store, at = _open(self.path)
        if store.get_file_info(at).size != h.start + h.rows * h.dtype.itemsize:
            raise ValueError("the array's size isn't what its header says")
        step = max(1, self.split // h.dtype.itemsize)
        return [Range(r, min(r + step, h.rows)) for r in range(0, h.rows, step)] or [Range(0, 0)]

    def read(self, part: Range):
        h = self.header
        store, at = _open(self.path)
        with store.open_input_file(at) as f:
            rows = np.frombuffer(f.read_at((part.last - part.first) * h.dtype.itemsize, h.start + part.first * h.dtype.itemsize), h.dtype)
        for k in range(0, len(rows), 1 << 16):
            yield _batch(rows[k : k + (1 << 16)], h, part.first + k)


class NpySource(DataSource):
    """spark.read.format("npy"): columns of the array and row, the place in it. Option split: bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def _header(self) -> Header:
        store, at = _open(self.options["path"])
        with store.open_input_file(at) as f:
            return npy_header(f)

    def schema(self) -> str:
        return ", ".join([*[f"`{n}` {_SQL[t]}" for n, t in self._header().fields], "`row` long"])

    def reader(self, schema) -> _NpyReader:
        return _NpyReader(self.options["path"], self._header(), int(self.options.get("split", SPLIT)))


def json_field(df: DataFrame, column: str, field: str) -> DataFrame:
    """df with the field of a JSON column as text, null where there is none, and valid: whether the column parses."""
    parsed = F.try_parse_json(F.col(column))
    return df.withColumns({field: F.get_json_object(column, f"$.{field}"), "valid": parsed.isNotNull()})


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a file, of a schema; a file that doesn't parse raises an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def same_configuration(reports: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """The reports whose configuration differs from what is wanted, with the names of the columns that do."""
    differ = F.array_compact(F.array(*[F.when(~F.col(k).eqNullSafe(F.lit(v)), F.lit(k)) for k, v in wanted.items()]))
    return reports.withColumn("differs", differ).filter(F.size("differs") > 0)


def links(pages: DataFrame) -> DataFrame:
    """(page_id, link, host, page): a page's first link, its own host, and the page parameter of its address; empty where there is none."""
    url = F.coalesce("url", F.lit(""))
    return pages.select("page_id", F.regexp_extract(F.coalesce("html", F.lit("")), '<a [^>]*href="([^"]*)"', 1).alias("link"), F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract(url, "[?&]page=([^&#]*)", 1).alias("page"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(name, x, y, z, sx, sy, sz) of the boxes in the models of a world file, placed by the model's pose; another shape is refused when
    the row is read."""
    pose = "pose string"
    schema = f"_name string, {pose}, link struct<{pose}, collision: struct<_name: string, geometry: struct<box: struct<size: string>, sphere: string, cylinder: string, mesh: string>>>"
    models = spark.read.format("xml").option("rowTag", "model").schema(schema.replace(f"struct<{pose}", "struct<pose: string")).load(path)
    size = F.split(F.trim("link.collision.geometry.box.size"), r"\s+")
    place = F.split(F.trim("pose"), r"\s+")
    known = F.when(F.col("link.collision.geometry.box.size").isNull(), F.raise_error(F.concat(F.lit("not a box: "), F.col("_name")))).otherwise(F.col("_name"))
    return models.select(known.alias("name"), *[place[i].cast("double").alias(a) for i, a in enumerate("xyz")], *[size[i].cast("double").alias(f"s{a}") for i, a in enumerate("xyz")])


def read_joints(spark: SparkSession, path: str) -> DataFrame:
    """(joint, kind, parent, child, low, high) of the joints of robot model files."""
    schema = "_name string, _type string, parent struct<_link: string>, child struct<_link: string>, limit struct<_lower: double, _upper: double>"
    joints = spark.read.format("xml").option("rowTag", "joint").schema(schema).load(path).filter("_type IS NOT NULL")
    return joints.select(F.col("_name").alias("joint"), F.col("_type").alias("kind"), F.col("parent._link").alias("parent"), F.col("child._link").alias("child"), F.col("limit._lower").alias("low"), F.col("limit._upper").alias("high"))


def bag_header(data: bytes, size: int) -> dict[str, int]:
    """Fields of the header record of a bag of version 2.0, checked against the file's size: index_pos, conn_count, chunk_count."""
    magic = b"#ROSBAG V2.0\n"
    if not data.startswith(magic):
        raise ValueError("not a bag of version 2.0")
    at = len(magic)
    (length,) = struct.unpack_from("<I", data, at)
    if length > 4096 or at + 4 + length > len(data):
        raise ValueError("the header record is cut")
    record, fields = data[at + 4 : at + 4 + length], {}
    while record:
        (n,) = struct.unpack_from("<I", record)
        name, found, value = record[4 : 4 + n].partition(b"=")
        if not found or n > len(record) - 4:
            raise ValueError("a field of the header is cut")
        fields[name.decode("ascii")] = value
        record = record[4 + n :]
    if fields.get("op") != b"\x03" or {"index_pos", "conn_count", "chunk_count"} - fields.keys():
        raise ValueError("the first record isn't a bag header")
    out = {k: int.from_bytes(fields[k], "little") for k in ("index_pos", "conn_count", "chunk_count")}
    if not 0 < out["index_pos"] <= size:
        raise ValueError("the index lies outside of the file")
    return out


def audit_bags(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, index_pos, conn_count, chunk_count, problem) of the bag files below a path; their first 8 KB are read, no more of
    them however large they are."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")

    def look(batches):
        for batch in batches:
            rows = []
            for path, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                try:
                    store, at = _open(path)
                    with store.open_input_file(at) as f:
                        h = bag_header(f.read_at(8192, 0), size)
                    rows.append((h["index_pos"], h["conn_count"], h["chunk_count"], None))
                except (OSError, ValueError, struct.error) as e:
                    rows.append((None, None, None, str(e)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(),) * 3 + (pa.string(),), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), *columns], names=["path", "bytes", "index_pos", "conn_count", "chunk_count", "problem"])

    return files.mapInArrow(look, "path string, bytes long, index_pos long, conn_count long, chunk_count long, problem string")


def register(spark: SparkSession) -> None:
    """Makes the format npy known to the session."""
    spark.dataSource.register(NpySource)


def audit_points(spark: SparkSession, said: DataFrame) -> DataFrame:
    """said (path, rows) with found and problem: what the header of each point file declares, and what is wrong with it: a header that
    is refused, a payload too short, or other rows than the catalogue says. Headers are read in parallel, payloads not at all."""
    from .pointfiles import pcd_header, ply_header

    def look(batches):
        for batch in batches:
            found, problem = [], []
            for path, rows in zip(batch.column("path").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                try:
                    store, at = _open(path)
                    with store.open_input_file(at) as f:
                        h = (ply_header if path.endswith(".ply") else pcd_header)(f)
                    short = not h.text and store.get_file_info(at).size < h.start + h.rows * h.dtype.itemsize
                    found.append(h.rows)
                    problem.append("the payload is cut" if short else None if h.rows == rows else "the catalogue says otherwise")
                except (OSError, ValueError) as e:
                    found.append(None)
                    problem.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("rows"), pa.array(found, pa.int64()), pa.array(problem, pa.string())], names=["path", "rows", "found", "problem"])

    return said.select("path", F.col("rows").cast("long").alias("rows")).mapInArrow(look, "path string, rows long, found long, problem string")
