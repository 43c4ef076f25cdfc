"""Sensor messages as arrays: images of an encoding, and ranges of a scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings: type of a sample, samples of a pixel, and what a sample is multiplied by (millimetres become metres).
ENCODINGS = {"mono8": ("u1", 1, 1.0), "rgb8": ("u1", 3, 1.0), "bgr8": ("u1", 3, 1.0), "rgba8": ("u1", 4, 1.0), "16UC1": ("u2", 1, 0.001), "32FC1": ("f4", 1, 1.0)}


def decoded(data: bytes, encoding: str, width: int, height: int, stride: int, big: bool) -> np.ndarray:
    """Samples (height, width, samples) in double precision; red comes first. Depths that are 0 or not finite are infinite."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding}")
    kind, samples, scale = ENCODINGS[encoding]
    dtype = np.dtype(kind).newbyteorder(">" if big else "<")
    row = width * samples * dtype.itemsize
    if width < 1 or height < 1 or stride < row or len(data) != stride * height:
        raise ValueError("the image's bytes are not what its size, stride and encoding say")
    lines = np.frombuffer(data, np.uint8).reshape(height, stride)[:, :row]
    out = np.ascontiguousarray(lines).view(dtype).reshape(height, width, samples).astype(np.float64) * scale
    if encoding in ("16UC1", "32FC1"):
        out[~np.isfinite(out) | (out <= 0)] = np.inf
    return out[:, :, ::-1] if encoding == "bgr8" else out


def images(frames: DataFrame) -> DataFrame:
    """frames (data binary, encoding, width, height, stride, big) with pixels, row after row, samples together; a frame whose bytes are
    not what it says raises an error."""

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("data", "encoding", "width", "height", "stride", "big"))
            made = [decoded(*row).ravel() for row in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.list_(pa.float64()))], names=[*batch.schema.names, "pixels"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)
    return frames.mapInArrow(run, f"{schema}, pixels array<double>")


def ranges(column: str, least: float, most: float) -> Column:
    """The array of ranges with null, what isn't finite, and what lies outside of the sensor's range made infinite."""
    far = F.lit(float("inf"))
    return F.transform(column, lambda x: F.when(x.isNotNull() & ~F.isnan(x) & (x >= least) & (x <= most), x).otherwise(far))
