"""Masks and regions of interest."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

POINT = 0.01  # members of the point list
SKIP = 0.1  # members for the skip inside temporal tools
NAN = float("nan")
XYZ = ["x", "y", "z"]


def points(mask: DataFrame) -> DataFrame:
    """Member voxels of a mask volume (x, y, z, weight)."""
    return mask.where((F.col("weight") > POINT) & ~F.isnan("weight")).select(*XYZ).distinct()


def apply(long: DataFrame, mask: DataFrame, threshold: float = POINT) -> DataFrame:
    """Series of mask members kept, all other cells NaN."""
    m = mask.where((F.col("weight") > threshold) & ~F.isnan("weight")).select(*XYZ, F.lit(True).alias("_in")).distinct()
    v = F.when(F.col("_in"), F.col("v")).otherwise(F.lit(NAN))
    return long.join(m, XYZ, "left").withColumn("v", v).drop("_in").select(*long.columns)


def select(long: DataFrame, mask: DataFrame) -> DataFrame:
    """Samples of the mask's members only."""
    return long.join(points(mask), XYZ, "left_semi")


def within(df: DataFrame, mask: DataFrame | None, threshold: float = SKIP) -> DataFrame:
    """Voxels (rows with x, y, z) that a temporal operator takes up: all without a mask, else those of at least the threshold."""
    if mask is None:
        return df
    m = mask.where((F.col("weight") >= threshold) & ~F.isnan("weight")).select(*XYZ).distinct()
    return df.join(m, XYZ, "left_semi")


def skipped(result: DataFrame, every: DataFrame, on: list[str], value: str) -> DataFrame:
    """A result with a NaN for every voxel that a mask left out; ``every`` has the rows (``on``) of the whole image."""
    return every.select(*on).join(result, on, "left").withColumn(value, F.coalesce(value, F.lit(NAN))).select(*result.columns)


def clean(long: DataFrame, min_frames: int = 20, min_sd: float = 1e-6) -> DataFrame:
    """Voxels whose series has no NaN and, beyond ``min_frames`` frames, varies."""
    g = long.groupBy("voxel").agg(
        F.max(F.isnan("v").cast("int")).alias("bad"), F.count("*").alias("n"),
        F.stddev_samp(F.when(~F.isnan("v"), F.col("v"))).alias("sd"),
    )
    return g.where((F.col("bad") == 0) & ((F.col("n") <= min_frames) | (F.col("sd") >= min_sd))).select("voxel")


def binarize(v: Column) -> Column:
    """0 for values under 0.1, NaN and infinities, else 1."""
    return F.when(F.isnan(v) | (v < SKIP) | (F.abs(v) == float("inf")), 0).otherwise(1)


def dilate(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Cells within the 26-neighbourhood (or wider) of the given ones, themselves included."""
    r = range(-radius, radius + 1)
    off = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in r for j in r for k in r])
    e = cells.select(*XYZ, F.explode(off).alias("o"))
    return e.select(*[(F.col(c) + F.col(f"o.{o}")).alias(c) for c, o in zip(XYZ, "ijk")]).distinct()


def distance(x: Column, y: Column, z: Column, center: tuple[float, float, float]) -> Column:
    a, b, c = center
    return F.sqrt(F.pow(x - a, 2) + F.pow(y - b, 2) + F.pow(z - c, 2))


def in_volume(dims: tuple[int, int, int], cols=("x", "y", "z")) -> Column:
    a, b, c = cols
    return F.col(a).between(0, dims[0] - 1) & F.col(b).between(0, dims[1] - 1) & F.col(c).between(0, dims[2] - 1)


def region(
    cells: DataFrame, center=(0.0, 0.0, 0.0), sphere: float | None = None, cube: tuple[float, float, float] | None = None,
    value: float = 1.0, keep: bool = False, affine: list[list[float]] | None = None,
) -> DataFrame:
    """Cells (x, y, z, v) with ``value`` inside the sphere or cube, 0 (or the input if ``keep``) outside.

    With an affine (4 x 4) the center is in mm, else in voxels. Both borders belong to the region.
    """
    pos = [F.col(c).cast("double") for c in XYZ]
    if affine:
        pos = [sum((F.lit(float(affine[i][j])) * pos[j] for j in range(3)), F.lit(float(affine[i][3]))) for i in range(3)]
    inside = F.lit(False)
    if sphere is not None:
        inside = inside | (distance(*pos, center) <= sphere)
    if cube is not None:
        box = [F.abs(p - c) <= d / 2 for p, c, d in zip(pos, center, cube)]
        inside = inside | (box[0] & box[1] & box[2])
    rest = F.col("v") if keep else F.lit(0.0)
    return cells.withColumn("v", F.when(inside, F.lit(float(value))).otherwise(rest))


def random_cells(cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` cells above 0.5 without replacement, by the order of a hash; fewer cells than ``n`` are an error."""
    have = cells.where("v > 0.5")
    picked = have.orderBy(F.xxhash64(*XYZ, F.lit(seed)), *XYZ).limit(n)
    picked = picked.withColumn("_n", F.count("*").over(Window.partitionBy()))  # at most n rows
    short = F.raise_error(F.lit(f"fewer than {n} cells to sample"))
    first = cells.columns[0]
    checked = F.when(F.col("_n") < n, short.cast(cells.schema[first].dataType)).otherwise(F.col(first)).alias(first)
    return picked.select(checked, *cells.columns[1:])


def resampled_index(i: Column, old: int, new: int) -> Column:
    """Index in a grid of ``old`` cells nearest below index ``i`` of ``new`` cells, in single precision."""
    return F.floor((F.lit(old).cast("float") / F.lit(new).cast("float")).cast("float") * i.cast("float")).cast("long")


def resample(mask: DataFrame, old: tuple[int, int, int], new: tuple[int, int, int]) -> DataFrame:
    """A mask (x, y, z, weight) on another grid by nearest cells; a join on the source cell."""
    spark = mask.sparkSession
    cells = spark.range(math.prod(new)).select(
        (F.col("id") % new[0]).alias("x"), F.expr(f"(id div {new[0]}) % {new[1]}").alias("y"), F.expr(f"id div {new[0] * new[1]}").alias("z")
    )
    src = cells.select(*XYZ, *[resampled_index(F.col(c), o, n).alias(f"s{c}") for c, o, n in zip(XYZ, old, new)])
    m = mask.select(*[F.col(c).alias(f"s{c}") for c in XYZ], "weight")
    return src.join(m, ["sx", "sy", "sz"]).select(*XYZ, "weight")
