"""The three layouts of a 4-D image: long samples (L1), series per voxel (L2), volume per frame (L3).

L1 is image, voxel, x, y, z, t, v. L2 has ``ts`` (array over t) per voxel, L3 ``vol`` (array over voxels) per
frame. Temporal operators keep to L2 or L1 grouped by voxel, spatial ones to L1 or L3 keyed by frame, so a
pipeline changes its partitioning only where it turns from one to the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEY = ["image", "voxel", "x", "y", "z"]


def voxel_id(x: Column, y: Column, z: Column, xdim: int, ydim: int) -> Column:
    return z * (xdim * ydim) + y * xdim + x


def long_from_series(series: DataFrame, ts: str = "ts") -> DataFrame:
    """L2 to L1."""
    keep = [c for c in series.columns if c != ts]
    return series.select(*keep, F.posexplode(ts).alias("t", "v"))


def series_from_long(long: DataFrame) -> DataFrame:
    """L1 to L2; a voxel's frames are sorted by t."""
    keys = [c for c in long.columns if c not in ("t", "v")]
    packed = F.array_sort(F.collect_list(F.struct("t", "v")))
    return long.groupBy(*keys).agg(F.transform(packed, lambda s: s.v).alias("ts"))


def volumes_from_long(long: DataFrame) -> DataFrame:
    """L1 to L3; a frame's cells are sorted by voxel."""
    packed = F.array_sort(F.collect_list(F.struct("voxel", "v")))
    return long.groupBy("image", "t").agg(F.transform(packed, lambda s: s.v).alias("vol"))


def long_from_volumes(volumes: DataFrame, xdim: int, ydim: int) -> DataFrame:
    """L3 to L1."""
    v = volumes.select("image", "t", F.posexplode("vol").alias("voxel", "v"))
    return v.select(
        "image", F.col("voxel").cast("long").alias("voxel"), (F.col("voxel") % xdim).alias("x"),
        F.expr(f"(voxel div {xdim}) % {ydim}").alias("y"), F.expr(f"voxel div {xdim * ydim}").alias("z"), "t", "v",
    )


def scaled(raw: Column, slope: Column, inter: Column) -> Column:
    """Stored value to double; a slope of 0 means slope 1, intercept 0."""
    r = raw.cast("double")
    return F.when(slope == 0, r).otherwise(r * slope + inter)


def stored(value: Column, slope: Column, inter: Column, kind: str) -> Column:
    """Double to stored value of a SQL integer type: truncation toward zero, null where it cannot be stored."""
    r = F.when(slope == 0, value).otherwise((value - inter) / slope)
    return F.when(~F.isnan(r), r).try_cast(kind)


def from_vectors(vectors: DataFrame, xdim: int = 8, ydim: int = 8, image: str = "img") -> DataFrame:
    """A table of (vec_id, embedding, label) as L2: the vector number is the voxel, the position the frame."""
    return vectors.select(
        F.lit(image).alias("image"), F.col("vec_id").alias("voxel"), (F.col("vec_id") % xdim).alias("x"),
        F.expr(f"(vec_id div {xdim}) % {ydim}").alias("y"), F.expr(f"vec_id div {xdim * ydim}").alias("z"),
        "label", F.transform("embedding", lambda e: e.cast("double")).alias("ts"),
    )
