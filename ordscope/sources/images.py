"""Patch statistics of images, one row per image.

Decoding is Spark's ``image`` source; the medians are NumPy over one patch at a
time inside Arrow batches. Everything derived from the medians (angle, anchor,
bins) is column arithmetic in ``functions.ordinal``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordscope import fixed_values as fv

# sRGB to XYZ (D65) and the reference white.
_RGB_TO_XYZ = np.array(
    [
        [0.412453, 0.357580, 0.180423],
        [0.212671, 0.715160, 0.072169],
        [0.019334, 0.119193, 0.950227],
    ]
)
_WHITE = np.array([0.950456, 1.0, 1.088754])

PATCH_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("l_med", "b_med", "r_med", "g_med", "b_med_rgb")]
)


def lab_of(rgb: np.ndarray) -> np.ndarray:
    """CIE-Lab (L 0..100) of an (n, 3) array of 8-bit RGB values, to 9 decimals.

    Products are added in one order, and what is left of floating noise is rounded
    away: digits do not depend on how many pixels share a batch, and grey is exactly 0.
    """
    c = rgb / 255.0
    linear = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    r, g, b = linear[:, 0], linear[:, 1], linear[:, 2]
    xyz = np.column_stack([(m[0] * r + m[1] * g) + m[2] * b for m in _RGB_TO_XYZ]) / _WHITE
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16.0 / 116.0)
    light = np.where(xyz[:, 1] > 0.008856, 116.0 * f[:, 1] - 16.0, 903.3 * xyz[:, 1])
    return np.round(np.column_stack([light, 500.0 * (f[:, 0] - f[:, 1]), 200.0 * (f[:, 1] - f[:, 2])]), 9)


def _segment_medians(values: np.ndarray, segment: np.ndarray, n: int) -> np.ndarray:
    """Median of the values of every segment 0 .. n-1; NaN where there is none."""
    order = np.lexsort((values, segment))
    ordered, sizes = values[order], np.bincount(segment, minlength=n)
    starts = np.cumsum(sizes) - sizes
    out, some = np.full(n, np.nan), sizes > 0
    low, high = starts + np.maximum(sizes - 1, 0) // 2, starts + sizes // 2
    out[some] = (ordered[low[some]] + ordered[high[some]]) / 2.0
    return out


def batch_medians(buffers: list[bytes | None]) -> np.ndarray:
    """Masked medians of many BGR buffers: one colour transform over all their pixels.

    Columns as in ``PATCH_SCHEMA``; NaN where no pixel passes a mask. Bytes after the
    last whole pixel are no pixel.
    """
    n, data = len(buffers), [b or b"" for b in buffers]
    pixels = np.array([len(d) // 3 for d in data], dtype=np.int64)
    joined = b"".join(d[: 3 * p] for d, p in zip(data, pixels.tolist()))
    rgb = np.frombuffer(joined, dtype=np.uint8).reshape(-1, 3)[:, ::-1].astype(float)
    segment = np.repeat(np.arange(n), pixels)
    lab = lab_of(rgb)
    low, high = fv.ANGLE_LUMINANCE_RANGE
    skin = (lab[:, 0] > low) & (lab[:, 0] < high)
    low, high = fv.COLOUR_LUMINANCE_RANGE
    usable = (lab[:, 0] > low) & (lab[:, 0] < high)
    columns = [(lab[:, 0], skin), (lab[:, 2], skin), *[(rgb[:, i], usable) for i in range(3)]]
    return np.column_stack([_segment_medians(v[m], segment[m], n) for v, m in columns])


@F.pandas_udf(PATCH_SCHEMA)
def patch_statistics(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(batch_medians(data.tolist()), columns=PATCH_SCHEMA.fieldNames(), dtype="float64").replace({np.nan: None})


def with_patch_statistics(df: DataFrame, data_col: str = "data") -> DataFrame:
    """Add ``l_med, b_med, r_med, g_med, b_med_rgb`` from BGR bytes."""
    return df.withColumn("__p", patch_statistics(F.col(data_col))).select("*", "__p.*").drop("__p")


@F.pandas_udf(T.BinaryType())
def _as_bgr(data: pd.Series, channels: pd.Series) -> pd.Series:
    """Grey repeated for the three colours, alpha removed; None for what could not be decoded."""

    def convert(raw: bytes | None, n: int) -> bytes | None:
        if not raw or n not in (1, 3, 4):
            return None
        return np.frombuffer(raw, np.uint8).reshape(-1, n)[:, [0] * 3 if n == 1 else [0, 1, 2]].tobytes()

    return pd.Series([convert(d, c) for d, c in zip(data, channels)])


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """Images of a folder as ``path, data`` (BGR bytes). Undecodable files stay, with NULL data."""
    images = spark.read.format("image").option("dropInvalid", "false").load(path)
    return images.select(
        F.col("image.origin").alias("path"), _as_bgr(F.col("image.data"), F.col("image.nChannels")).alias("data")
    )


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Listing table of a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length")
