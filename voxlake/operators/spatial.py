"""Spatial operators: smoothing, padding, orientation, interpolation, distances."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

XYZ = ["x", "y", "z"]


def _offsets(values: list[tuple]) -> Column:
    """A literal array of structs o (and w) to explode; its length is the size of a kernel."""
    names = ("o", "w")
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(t, names)]) for t in values])


def frame_key(cells: DataFrame) -> list[str]:
    """["t"] for the cells of many frames (t, x, y, z, v), [] for those of one (x, y, z, v)."""
    return ["t"] if "t" in cells.columns else []


def each_frame(grid: DataFrame, cells: DataFrame) -> DataFrame:
    """The rows of a grid once for every frame of the cells; the numbers of an image's frames are few, the grid is not."""
    return grid.crossJoin(F.broadcast(cells.select("t").distinct())) if frame_key(cells) else grid


# Smoothing


def gaussian(fwhm: float, size: float) -> list[tuple[int, float]]:
    """(offset, weight) of a Gaussian of a full width at half maximum in mm, cut at four deviations."""
    sigma = fwhm / (2 * math.sqrt(2 * math.log(2)))
    reach = math.ceil(4 * sigma / size)
    return [(i, math.exp(-((i * size) ** 2) / (2 * sigma * sigma))) for i in range(-reach, reach + 1)]


def smooth_axis(cells: DataFrame, axis: str, fwhm: float, size: float) -> DataFrame:
    """One pass of the separable kernel over cells (t, x, y, z, v); weights renormalised over finite cells.

    Each finite cell spreads its value and weight to its neighbours; the sums per target cell combine before
    the shuffle. Targets outside the volume fall away by the join with the cells themselves.
    """
    spread = cells.where(~F.isnan("v")).withColumn("k", F.explode(_offsets(gaussian(fwhm, size))))
    rest = [c for c in XYZ if c != axis]
    g = spread.groupBy("t", *rest, (F.col(axis) + F.col("k.o")).alias(axis)).agg(
        (F.sum(F.col("v") * F.col("k.w")) / F.sum("k.w")).alias("s")
    )
    out = cells.select("t", *XYZ).join(g, ["t", *XYZ], "left")
    return out.select("t", *XYZ, F.coalesce("s", F.lit(float("nan"))).alias("v"))


def smooth(cells: DataFrame, fwhm: float, sizes: tuple[float, float, float], axes: str = "xyz") -> DataFrame:
    """Gaussian smoothing along x, then y, then z."""
    for axis in axes:
        cells = smooth_axis(cells, axis, fwhm, sizes[XYZ.index(axis)])
    return cells


def smooth_volumes(cells: DataFrame, dims: tuple[int, int, int], fwhm: float, sizes: tuple[float, float, float]) -> DataFrame:
    """The same per frame in numpy, for large kernels: one group is one volume."""
    kernels = [np.array([w for _, w in gaussian(fwhm, s)]) for s in sizes]

    def one(pdf):
        vol = np.full(dims, np.nan)
        ix = tuple(pdf[c].to_numpy() for c in XYZ)
        vol[ix] = pdf["v"].to_numpy()
        have = np.zeros(dims, bool)
        have[ix] = True
        for axis, k in enumerate(kernels):
            ok = np.isfinite(vol)
            conv = lambda a: np.apply_along_axis(lambda r: np.convolve(r, k, "full")[len(k) // 2 : len(k) // 2 + len(r)], axis, a)  # noqa: B023, E731
            with np.errstate(all="ignore"):
                vol = np.where(have, conv(np.where(ok, vol, 0.0)) / conv(ok.astype(float)), np.nan)
        return pdf.assign(v=vol[ix])

    return cells.groupBy("t").applyInPandas(one, cells.schema)


# Padding


def pad(cells: DataFrame, dims: tuple[int, int, int], low: tuple[int, int, int], high: tuple[int, int, int], value: float = 0.0) -> DataFrame:
    """Cells (x, y, z, v, or t too) padded with a value, or cropped where an amount is negative."""
    new = tuple(d + a + b for d, a, b in zip(dims, low, high))
    key = frame_key(cells)
    grid = each_frame(grid_cells(cells.sparkSession, new), cells)
    moved = cells.select(*key, *[(F.col(c) + a).cast("long").alias(c) for c, a in zip(XYZ, low)], "v")
    return grid.join(moved, [*key, *XYZ], "left").select(*key, *XYZ, F.coalesce("v", F.lit(value)).alias("v"))


def pad_mirror(cells: DataFrame, dims: tuple[int, int, int], low: tuple[int, int, int], high: tuple[int, int, int]) -> DataFrame:
    """Cells padded with their mirror image at the edge."""
    new = tuple(d + a + b for d, a, b in zip(dims, low, high))
    grid = grid_cells(cells.sparkSession, new)

    def source(c: str, d: int, a: int) -> Column:
        i = F.col(c) - a
        return F.when(i < 0, -1 - i).when(i >= d, 2 * d - i - 1).otherwise(i)

    src = grid.select(*XYZ, *[source(c, d, a).alias(f"s{c}") for c, d, a in zip(XYZ, dims, low)])
    key = frame_key(cells)
    c = cells.select(*key, *[F.col(c).cast("long").alias(f"s{c}") for c in XYZ], "v")
    return src.join(c, [f"s{c}" for c in XYZ]).select(*key, *XYZ, "v")


def padded_origin(affine: np.ndarray, low: tuple[int, int, int]) -> np.ndarray:
    """Affine after padding: the origin moves by the cells added below."""
    out = np.array(affine, float)
    out[:3, 3] -= out[:3, :3] @ np.asarray(low, float)
    return out


def grid_cells(spark, dims: tuple[int, int, int]) -> DataFrame:
    """All cells of a grid."""
    return spark.range(math.prod(dims)).select(
        (F.col("id") % dims[0]).alias("x"), F.expr(f"(id div {dims[0]}) % {dims[1]}").alias("y"), F.expr(f"id div {dims[0] * dims[1]}").alias("z")
    )


# Orientation

AXES = {"L": (0, -1), "R": (0, 1), "P": (1, -1), "A": (1, 1), "I": (2, -1), "S": (2, 1)}


def orientation_of(affine: np.ndarray) -> str:
    """Three letters naming the direction in which each index grows."""
    m = np.asarray(affine, float)[:3, :3]
    out, free = [], {0, 1, 2}
    for col in sorted(range(3), key=lambda c: -np.abs(m[:, c]).max()):
        row = max(free, key=lambda r: abs(m[r, col]))
        free.discard(row)
        out.append((col, ("LR", "PA", "IS")[row][int(m[row, col] > 0)]))
    return "".join(letter for _, letter in sorted(out))


def reorientation(old: str, new: str) -> list[tuple[int, bool]]:
    """For each new axis the old axis and whether it is flipped."""
    old, new = old.upper(), new.upper()
    for code in (old, new):
        if len(code) != 3 or {AXES[c][0] for c in code if c in AXES} != {0, 1, 2}:
            raise ValueError(f"{code}: needs one of L/R, P/A and I/S each")
    place = {AXES[c][0]: (i, AXES[c][1]) for i, c in enumerate(old)}
    return [(place[AXES[c][0]][0], place[AXES[c][0]][1] != AXES[c][1]) for c in new]


def reorient(cells: DataFrame, dims: tuple[int, int, int], old: str, new: str) -> DataFrame:
    """Axes permuted and flipped to another code; a projection of the coordinates."""
    plan = reorientation(old, new)
    cols = [((dims[a] - 1 - F.col(XYZ[a])) if flip else F.col(XYZ[a])).alias(n) for n, (a, flip) in zip(XYZ, plan)]
    return cells.select(*[c for c in cells.columns if c not in XYZ], *cols)


def reoriented_affine(affine: np.ndarray, dims: tuple[int, int, int], old: str, new: str) -> np.ndarray:
    """Affine that maps the new indices to the same places."""
    m = np.zeros((4, 4))
    m[3, 3] = 1
    for i, (a, flip) in enumerate(reorientation(old, new)):
        m[a, i] = -1 if flip else 1
        if flip:
            m[a, 3] = dims[a] - 1
    return np.asarray(affine, float) @ m


# Interpolation


def lanczos(d: Column, a: int = 3) -> Column:
    """Windowed sinc of a distance."""
    p = F.lit(math.pi) * d
    value = a * F.sin(p) * F.sin(p / a) / F.nullif(p * p, F.lit(0.0))
    return F.when(F.abs(d) < 1e-12, 1.0).when(F.abs(d) >= a, 0.0).otherwise(value)


def interpolate(targets: DataFrame, cells: DataFrame, weight, reach: tuple[int, int]) -> DataFrame:
    """Weighted sum of the cells around target positions (id, px, py, pz): id, v, w, n, per frame if the cells have t.

    Offsets reach[0]..reach[1] from the floor are exploded per axis, joined to the finite cells and summed with
    ``weight(dx, dy, dz)``, taken before the join as all frames share it; n counts the cells that took part.
    """
    r = range(reach[0], reach[1] + 1)
    off = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.lit(k).alias("z")) for i in r for j in r for k in r])
    t = targets.withColumn("k", F.explode(off))
    t = t.select("id", *[f"p{c}" for c in XYZ], *[(F.floor(f"p{c}") + F.col(f"k.{c}")).alias(c) for c in XYZ])
    t = t.select("id", *XYZ, weight(*[F.col(f"p{a}") - F.col(a) for a in XYZ]).alias("w"))
    key = frame_key(cells)
    c = cells.where(~F.isnan("v")).select(*key, *[F.col(a).cast("long").alias(a) for a in XYZ], "v")
    j = t.join(c.hint("merge"), XYZ)  # neither side has a bound, and the size of exploded targets is estimated far too low
    return j.groupBy(*key, "id").agg(F.sum(F.col("v") * F.col("w")).alias("v"), F.sum("w").alias("w"), F.count("*").alias("n"))


def lanczos3(targets: DataFrame, cells: DataFrame) -> DataFrame:
    """Lanczos-3 where all 216 cells are there, else the distance-weighted value, else null: id, value."""
    full = interpolate(targets, cells, lambda a, b, c: lanczos(a) * lanczos(b) * lanczos(c), (-2, 3))
    near = distance_weighted(targets, cells).withColumnRenamed("value", "near")
    on = [*frame_key(cells), "id"]
    j = each_frame(targets.select("id"), cells).join(full, on, "left").join(near, on, "left")
    return j.select(*on, F.when(F.col("n") == 216, F.col("v")).otherwise(F.col("near")).alias("value"))


def distance_weighted(targets: DataFrame, cells: DataFrame, sizes: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Mean of the eight corners weighted by nearness: id, value (null where no corner is there)."""
    def weight(a: Column, b: Column, c: Column) -> Column:
        return F.sqrt(sum((F.pow((1 - F.abs(d)) / s, 2) for d, s in zip((a, b, c), sizes)), F.lit(0.0)))

    g = interpolate(targets, cells, weight, (0, 1))
    on = [*frame_key(cells), "id"]
    found = g.where("w > 0").select(*on, (F.col("v") / F.col("w")).alias("value"))
    return each_frame(targets.select("id"), cells).join(found, on, "left")


def trilinear(targets: DataFrame, cells: DataFrame) -> DataFrame:
    """Plain trilinear interpolation where all corners with a weight are there: id, value."""
    one = lambda d: F.greatest(1 - F.abs(d), F.lit(0.0))
    g = interpolate(targets, cells, lambda a, b, c: one(a) * one(b) * one(c), (0, 1))
    on = [*frame_key(cells), "id"]
    found = g.where("w > 1 - 1e-9").select(*on, F.col("v").alias("value"))
    return each_frame(targets.select("id"), cells).join(found, on, "left")


def rescale_targets(spark, dims: tuple[int, int, int], scale: tuple[float, float, float]) -> tuple[DataFrame, tuple[int, int, int]]:
    """Target positions of a rescaled grid (id, px, py, pz) and its size, ceil(old * scale)."""
    new = tuple(math.ceil(d * s) for d, s in zip(dims, scale))
    applied = [n / d for n, d in zip(new, dims)]
    g = grid_cells(spark, new)
    ident = F.col("z") * (new[0] * new[1]) + F.col("y") * new[0] + F.col("x")
    return g.select(ident.alias("id"), *[(F.col(c) / a).alias(f"p{c}") for c, a in zip(XYZ, applied)]), new


def affine_targets(spark, dims: tuple[int, int, int], to_source: np.ndarray) -> DataFrame:
    """Target positions of a grid mapped into source indices by a 4 x 4 matrix."""
    g = grid_cells(spark, dims)
    ident = F.col("z") * (dims[0] * dims[1]) + F.col("y") * dims[0] + F.col("x")
    m = np.asarray(to_source, float)
    pos = [sum((F.lit(float(m[i, j])) * F.col(XYZ[j]) for j in range(3)), F.lit(float(m[i, 3]))) for i in range(3)]
    return g.select(ident.alias("id"), *[p.alias(f"p{c}") for c, p in zip(XYZ, pos)])


# Distances and arithmetic


def _along(points: DataFrame, axis: str, size: float, low: int, high: int) -> DataFrame:
    """One axis of a distance transform: from points (x, y, z, d) the least d + (step * size)^2 at every place low..high of
    each line that holds a point. A line is no longer than the image is wide."""
    rest = [c for c in XYZ if c != axis]
    line = points.groupBy(*rest).agg(F.collect_list(F.struct(F.col(axis).cast("long").alias("p"), "d")).alias("l"))
    line = line.select(*[F.col(c).cast("long").alias(c) for c in rest], F.col("l.p").alias("p"), F.col("l.d").alias("d"))
    to = np.arange(low, high + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = [
                (((to[:, None] - np.asarray(p.as_py())[None, :]) * size) ** 2 + np.asarray(d.as_py())[None, :]).min(1)
                for p, d in zip(b.column(2), b.column(3))
            ]
            lines = np.repeat(np.arange(b.num_rows), len(to))
            cols = {rest[0]: b.column(0).take(pa.array(lines)), rest[1]: b.column(1).take(pa.array(lines)), axis: pa.array(np.tile(to, b.num_rows))}
            yield pa.RecordBatch.from_arrays([*[cols[c] for c in XYZ], pa.array(np.concatenate(out))], [*XYZ, "d"])

    return line.mapInArrow(work, "x long, y long, z long, d double")


def border_distance(cells: DataFrame, sizes: tuple[float, float, float]) -> DataFrame:
    """Distance in mm of mask cells (x, y, z, on) to the nearest off-mask cell that touches the mask: x, y, z, dist.

    A distance transform by axes: squared distances along x from the border cells of every line, then along y, then along
    z, each a group by line. So the work is a few times the volume, however far the border is. Without a border no rows.
    """
    on, off = cells.where("on = 1").select(*XYZ), cells.where("on = 0").select(*XYZ)
    from .masks import dilate

    border = off.join(dilate(on), XYZ, "left_semi").withColumn("d", F.lit(0.0))
    box = on.agg(*[f(c).alias(f"{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if box["lox"] is None:
        return on.withColumn("dist", F.lit(None).cast("double")).where("false")
    d = border
    for c, size in zip(XYZ, sizes):
        d = _along(d, c, float(size), int(box[f"lo{c}"]), int(box[f"hi{c}"]))
    whole = on.select(*[F.col(c).cast("long").alias(c) for c in XYZ]).distinct()
    out = whole.join(d, XYZ).withColumn("dist", F.sqrt("d"))
    return out.select(*[F.col(c).cast(on.schema[c].dataType).alias(c) for c in XYZ], "dist")


def combine(a: DataFrame, b: DataFrame, operation: str) -> DataFrame:
    """Two images multiplied or divided cell by cell (keys x, y, z, t): x, y, z, t, v; division by 0 is null."""
    j = a.join(b.select(*XYZ, "t", F.col("v").alias("w")), [*XYZ, "t"])
    v = F.col("v") * F.col("w") if operation == "mult" else F.col("v") / F.nullif(F.col("w"), F.lit(0.0))
    return j.select(*XYZ, "t", v.alias("v"))
