"""Images moved to other grids: deobliqueing and chains of transformations in one interpolation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions import affine
from . import spatial

XYZ = ["x", "y", "z"]
PHASE = {"x+": ("x", 1), "x-": ("x", -1), "y+": ("y", 1), "y-": ("y", -1), "z+": ("z", 1), "z-": ("z", -1), "x": ("x", 1), "y": ("y", 1), "z": ("z", 1)}


def on_grid(values: DataFrame, dims: tuple[int, int, int], default: float | None = None) -> DataFrame:
    """id, value (and t) to x, y, z, v (and t); cells without a value get the default."""
    v = F.col("value") if default is None else F.coalesce("value", F.lit(float(default)))
    return values.select(
        *spatial.frame_key(values), (F.col("id") % dims[0]).alias("x"), F.expr(f"(id div {dims[0]}) % {dims[1]}").alias("y"),
        F.expr(f"id div {dims[0] * dims[1]}").alias("z"), v.alias("v"),
    )


def deoblique(cells: DataFrame, m: np.ndarray, dims: tuple[int, int, int], keep_sizes: bool = False) -> tuple[DataFrame, np.ndarray, tuple[int, int, int]]:
    """A frame, or each of many keyed by t, on an axis-parallel grid by Lanczos-3: cells, its matrix and size."""
    out, size = affine.straight_grid(m, dims, keep_sizes)
    targets = spatial.affine_targets(cells.sparkSession, size, affine.index_map(out, m))
    return on_grid(spatial.lanczos3(targets, cells), size), out, size


def transformed(
    cells: DataFrame, source: np.ndarray, target: np.ndarray, dims: tuple[int, int, int], chain: list[tuple[str, object]], default: float | None = None,
) -> DataFrame:
    """A frame, or each of many keyed by t, moved through a chain to a target grid.

    A step is ("affine", 4 x 4 of world space), ("inverse", the same, inverted), ("warp", table x, y, z, dx, dy, dz of
    shifts in source cells on the target grid), or ("mult" / "div", image x, y, z, v on the target grid). All affine
    steps fold into one matrix, so the values are interpolated once; factors apply in target space.
    """
    spark = cells.sparkSession
    world = affine.composed(*[np.linalg.inv(np.asarray(s, float)) if k == "inverse" else s for k, s in chain if k in ("affine", "inverse")])
    targets = spatial.affine_targets(spark, dims, affine.index_map(target, source, np.linalg.inv(world)))
    for kind, step in chain:
        if kind == "warp":
            ident = F.col("z") * (dims[0] * dims[1]) + F.col("y") * dims[0] + F.col("x")
            shift = step.select(ident.alias("id"), "dx", "dy", "dz")
            j = targets.join(shift, "id", "left")
            targets = j.select("id", *[(F.col(f"p{c}") + F.coalesce(f"d{c}", F.lit(0.0))).alias(f"p{c}") for c in XYZ])
    out = on_grid(spatial.lanczos3(targets, cells), dims)
    for kind, step in chain:
        if kind in ("mult", "div"):
            if spatial.frame_key(cells):
                out = spatial.combine(out, spatial.each_frame(step, cells), kind)
            else:
                out = spatial.combine(out.withColumn("t", F.lit(0)), step.withColumn("t", F.lit(0)), kind).drop("t")
    return out if default is None else out.withColumn("v", F.coalesce("v", F.lit(float(default))))


def shift_field(shifts: DataFrame, direction: str) -> DataFrame:
    """A map of shifts in cells (x, y, z, v) along the phase-encoding direction as dx, dy, dz."""
    if direction not in PHASE:
        raise ValueError(f"phase-encoding direction {direction!r} is none of {', '.join(PHASE)}")
    axis, sign = PHASE[direction]
    return shifts.select(*XYZ, *[(F.col("v") * sign if c == axis else F.lit(0.0)).alias(f"d{c}") for c in XYZ])
