"""Principal components and common spatial patterns.

Only matrices of frames x frames reach the driver: their size is the number of frames of an image, not its
voxels. They are summed per partition from Arrow batches and then over the partitions, so one small row per
partition is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .temporal import map_series

MAX_FRAMES = 8192
#: Partial sums of frame matrices after the first step of the summation.
STEP = 32


@dataclass
class Components:
    """Eigenvalues in order, and one column per component over the frames."""

    values: np.ndarray
    vectors: np.ndarray


def gram(series: DataFrame, frames: int, center: str = "none", standardise: bool = False) -> tuple[np.ndarray, np.ndarray, int]:
    """(sum of y y', sum of y, number of voxels) over L2 series of ``frames`` frames.

    ``center="voxel"`` subtracts each voxel's mean first; series with a NaN are left out.
    """
    if frames > MAX_FRAMES:
        raise ValueError(f"{frames} frames: the frame matrix would not fit the driver")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, s, n = np.zeros((frames, frames)), np.zeros(frames), 0
        for b in batches:
            if b.num_rows:
                y = np.array(b.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
                y = y[np.isfinite(y).all(1)]
                if standardise:
                    sd = y.std(1, ddof=1, keepdims=True)
                    y = (y - y.mean(1, keepdims=True)) / np.where(sd > 0, sd, 1)
                elif center == "voxel":
                    y = y - y.mean(1, keepdims=True)
                g, s, n = g + y.T @ y, s + y.sum(0), n + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([g.ravel(), s, [n]]).tobytes()], pa.binary())], ["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(frames * frames + frames + 1)
        for b in batches:
            for m in b.column(0):
                total += np.frombuffer(m.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    # One row per partition, summed in two steps, so that no task reads them all; few are brought together at once.
    parts = series.select("ts").mapInArrow(work, "m binary").withColumn("k", F.spark_partition_id() % STEP).repartition("k")
    flat = np.frombuffer(parts.select("m").mapInArrow(add, "m binary").repartition(1).mapInArrow(add, "m binary").first().m)
    return flat[: frames * frames].reshape(frames, frames), flat[frames * frames : -1], int(flat[-1])


def fixed_signs(vectors: np.ndarray) -> np.ndarray:
    """Each column with its largest entry positive."""
    top = np.abs(vectors).argmax(0)
    return vectors * np.where(vectors[top, range(vectors.shape[1])] < 0, -1, 1)


def ordered(values: np.ndarray, vectors: np.ndarray) -> Components:
    k = np.argsort(-np.abs(values), kind="stable")
    return Components(values[k], fixed_signs(vectors[:, k]))


def how_many(values: np.ndarray, components: int = 0, variance: float = 0.0) -> int:
    """Number of components kept: at least one, the given number, or as many as explain the variance."""
    total = np.abs(values).sum()
    n, explained = 0, 0.0
    while True:
        explained += abs(values[n]) / total if total else 0
        n += 1
        if n >= len(values) or not (n < components or (explained < variance and components < 1)):
            return n


def frame_covariance(series: DataFrame, frames: int) -> np.ndarray:
    """Covariance of the frames over the voxels."""
    g, s, n = gram(series, frames)
    return (g - np.outer(s, s) / n) / (n - 1)


def temporal_pca(series: DataFrame, frames: int, components: int = 0, variance: float = 0.0, standardise: bool = False) -> tuple[Components, DataFrame]:
    """Components over the frames, and the map of each on the voxels (L2 with one entry per component)."""
    g, s, n = gram(series, frames, standardise=standardise)
    c = ordered(*np.linalg.eigh((g - np.outer(s, s) / n) / (n - 1)))
    kept = c.vectors[:, : how_many(c.values, components, variance)]

    def project(y: np.ndarray) -> np.ndarray:
        if standardise:
            sd = y.std(1, ddof=1, keepdims=True)
            y = (y - y.mean(1, keepdims=True)) / np.where(sd > 0, sd, 1)
        return y @ kept

    return Components(c.values, kept), map_series(series, project)


def spatial_pca(series: DataFrame, frames: int, components: int = 0, variance: float = 0.0) -> tuple[Components, DataFrame]:
    """Components over the voxels by the dual of their covariance: courses (frames) and maps (voxels).

    The voxel covariance is Y Y' / (T - 1) with rows centred; its eigenvalues are those of Y' Y / (T - 1), which
    has one row per frame.
    """
    g, s, n = gram(series, frames, center="voxel")
    c = ordered(*np.linalg.eigh(g / (frames - 1)))
    n = how_many(c.values, components, variance)
    scale = np.sqrt(np.maximum(c.values[:n] * (frames - 1), 1e-300))
    v = c.vectors[:, :n]
    maps = map_series(series, lambda y: (y - y.mean(1, keepdims=True)) @ v / scale)
    return Components(c.values, v * scale), maps


def repaired(m: np.ndarray, floor: float = 1e-10) -> tuple[np.ndarray, int]:
    """A symmetric matrix whose eigenvalues up to ``floor`` are replaced by the mean of the rest, and their number."""
    w, v = np.linalg.eigh(m)
    bad = w <= floor
    if bad.any() and not bad.all():
        w = np.where(bad, w[~bad].mean(), w)
    return (v * w) @ v.T, int(bad.sum())


def common_spatial_patterns(a: DataFrame, b: DataFrame, frames: int, components: int | None = None) -> Components:
    """Frame patterns with the most different variance in two regions: first half of the kept ones, then the last reversed."""
    ca, cb = frame_covariance(a, frames), frame_covariance(b, frames)
    both, _ = repaired(ca + cb)
    # (Ca + Cb) v = l Cb v, whitened by the Cholesky factor of the right side.
    right, _ = repaired(cb)
    low = np.linalg.inv(np.linalg.cholesky(right))
    w, u = np.linalg.eigh(low @ both @ low.T)
    c = ordered(w, low.T @ u)
    k = (components or 2 * (frames // 2)) // 2
    pick = [*range(k), *range(len(w) - 1, len(w) - 1 - k, -1)]
    return Components(c.values, c.vectors[:, pick])


def courses(spark, c: Components) -> DataFrame:
    """component, t, value."""
    rows = [(i, t, float(v)) for i, col in enumerate(c.vectors.T) for t, v in enumerate(col)]
    return spark.createDataFrame(rows, "component int, t int, value double")


def eigenvalues(spark, c: Components) -> DataFrame:
    """rank, eigenvalue."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(c.values)], "rank int, eigenvalue double")


def converted(value, mode: str):
    """Entries of a correlation matrix: absolute, positive, negative or scaled."""
    if mode == "absolute":
        return F.abs(value)
    if mode == "positive":
        return F.greatest(value, F.lit(0.0))
    if mode == "negative":
        return F.when(value > 0, 0.0).otherwise(F.abs(value))
    if mode == "scaled":
        e = 1e-10
        return value + float(abs(np.log(e / (2 - e)))) + e
    raise ValueError(f"unknown mode {mode}")
