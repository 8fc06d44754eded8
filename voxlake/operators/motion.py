"""Motion metrics and frame scrubbing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import masks

MM_PER_DEGREE = math.pi * 50 / 180
BINS = 4096


def reordered(rp: DataFrame, fmt: str = "spm") -> DataFrame:
    """Columns c1..c6 of a realignment table as t, x, y, z (mm), pitch, roll, yaw (degrees)."""
    keys = [c for c in rp.columns if c not in {f"c{i}" for i in range(1, 7)}]
    if fmt == "spm":
        cols = [F.col(f"c{i}") for i in range(1, 7)]
    elif fmt == "fsl":
        cols = [F.col(f"c{i}") for i in (4, 5, 6)] + [F.degrees(F.col(f"c{i}")) for i in (1, 2, 3)]
    else:
        raise ValueError(f"unknown format {fmt}")
    return rp.select(*keys, *[c.alias(n) for c, n in zip(cols, ("x", "y", "z", "pitch", "roll", "yaw"))])


def framewise_displacement(rp: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, fd of a table with x, y, z in mm and pitch, roll, yaw in degrees; the first frame is 0."""
    w = W.partitionBy(*keys).orderBy("t")
    d = lambda c: F.abs(F.col(c) - F.lag(c).over(w))
    moved = d("x") + d("y") + d("z") + (d("pitch") + d("roll") + d("yaw")) * MM_PER_DEGREE
    return rp.select(*keys, "t", F.coalesce(moved, F.lit(0.0)).alias("fd"))


def value_range(samples: DataFrame, skip: int = 5) -> DataFrame:
    """Smallest and largest value over frames t >= min(skip, T - 1), NaN left out: lo, hi."""
    last = samples.agg(F.max("t").alias("last"))
    v = F.when(~F.isnan("v"), F.col("v"))
    s = samples.join(last, F.col("t") >= F.least(F.lit(skip), F.col("last")))
    return s.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))


def histogram(samples: DataFrame) -> DataFrame:
    """bin, n of values in [0, 4095) over 4096 uniform bins."""
    v = F.col("v")
    inside = samples.where((v >= 0) & (v < BINS - 1) & ~F.isnan(v))
    return inside.groupBy(F.floor(v * BINS / (BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def modal_bin(samples: DataFrame) -> DataFrame:
    """The first of the most frequent bins: modal."""
    top = F.max(F.struct("n", (-F.col("bin")).alias("b")))
    return histogram(samples).agg(top.alias("m")).select((-F.col("m.b")).alias("modal"))


def dvars(samples: DataFrame, scaled: Column) -> DataFrame:
    """t, dvars: root mean square over the voxels of the change of the scaled value; frame 0 is 0.

    One shuffle by voxel for the change, then a partial aggregate per frame.
    """
    w = W.partitionBy("voxel").orderBy("t")
    i = samples.select("voxel", "t", scaled.alias("i"))
    d = i.select("t", (F.col("i") - F.lag("i").over(w)).alias("d"))
    return d.groupBy("t").agg(F.coalesce(F.sqrt(F.avg(F.col("d") * F.col("d"))), F.lit(0.0)).alias("dvars"))


def dvars_range(samples: DataFrame) -> DataFrame:
    """DVARS of values scaled to their range."""
    r = value_range(samples)
    i = samples.join(F.broadcast(r), F.lit(True))  # the range is one row
    return dvars(i, (F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))


def dvars_modal(samples: DataFrame) -> DataFrame:
    """DVARS of values scaled by the modal intensity."""
    i = samples.join(F.broadcast(modal_bin(samples)), F.lit(True))  # one row
    return dvars(i, F.col("v") / F.nullif(F.col("modal").cast("double"), F.lit(0.0)))


def over(value: Column, threshold: float) -> Column:
    """Comparison in which null and NaN exceed nothing."""
    return F.coalesce((value > threshold) & ~F.isnan(value), F.lit(False))


def flagged(metrics: DataFrame, keys: list[str], fd_threshold: float = 1.0, dvars_threshold: float = 0.05) -> DataFrame:
    """keys, t, flagged: frames (from t = 1) over a threshold, with the frame before and after."""
    bad = (F.col("t") >= 1) & (over(F.col("fd"), fd_threshold) | over(F.col("dvars"), dvars_threshold))
    w = W.partitionBy(*keys).orderBy("t").rangeBetween(-1, 1)
    return metrics.select(*keys, "t", F.max(bad.cast("int")).over(w).alias("flagged"))


def frame_map(flags: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, new_t: dense numbers of the frames that stay."""
    w = W.partitionBy(*keys).orderBy("t")
    return flags.where("flagged = 0").select(*keys, "t", (F.row_number().over(w) - 1).alias("new_t"))


def scrub(long: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Listed frames (keys, t) removed, the rest renumbered densely within the keys; keys that the list lacks count for all.

    The new numbers come from the distinct frames, one row each, not from the samples.
    """
    every = long.select(*keys, "t").distinct()
    on = [k for k in keys if k in frames.columns] + ["t"]
    kept = every.join(frames.select(*on), on, "left_anti").withColumn("flagged", F.lit(0))
    out = long.join(frame_map(kept, keys), [*keys, "t"])
    return out.drop("t").withColumnRenamed("new_t", "t").select(*long.columns)


def motion_scrubbing(
    long: DataFrame, rp: DataFrame, mask: DataFrame | None = None, fmt: str = "spm", fd_threshold: float = 1.0, dvars_threshold: float = 0.05, modal: bool = False,
) -> dict[str, DataFrame]:
    """One image and its realignment parameters (t, c1..c6) to fd (t, fd), dvars (t, dvars), flagged (t, flagged) and the
    scrubbed image. The metrics are those of the mask's members; a frame without parameters has no displacement.
    """
    fd = framewise_displacement(reordered(rp, fmt).withColumn("_k", F.lit(0)), ["_k"]).select("t", "fd")
    inside = long if mask is None else masks.select(long, mask)
    dv = dvars_modal(inside) if modal else dvars_range(inside)
    flags = flagged(dv.join(fd, "t", "left").withColumn("_k", F.lit(0)), ["_k"], fd_threshold, dvars_threshold).drop("_k")
    kept = scrub(long.withColumn("_k", F.lit(0)), flags.where("flagged = 1"), ["_k"]).drop("_k")
    return {"fd": fd, "dvars": dv, "flagged": flags, "scrubbed": kept}
