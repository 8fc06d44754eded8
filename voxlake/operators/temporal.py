"""Per-voxel temporal operators: time courses, correlation, t-tests, regression, band-pass, resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import spectrum

NAN = float("nan")


# Time courses of a region


def mean_course(samples: DataFrame) -> DataFrame:
    """Mean over the voxels per frame: t, value."""
    return samples.groupBy("t").agg(F.avg("v").alias("value"))


def stddev_course(samples: DataFrame) -> DataFrame:
    """Sample standard deviation over the voxels per frame."""
    return samples.groupBy("t").agg(F.stddev_samp("v").alias("value"))


def point_course(long: DataFrame, x: int, y: int, z: int) -> DataFrame:
    """The series of one voxel."""
    return long.where((F.col("x") == x) & (F.col("y") == y) & (F.col("z") == z)).select("t", F.col("v").alias("value"))


# Correlation with a seed


def pearson(x: Column, y: Column) -> Column:
    """Correlation with both deviations floored, so that a constant series gives 0; NaN stays NaN."""
    return F.covar_samp(x, y) / (F.greatest(F.stddev_samp(x), F.lit(1e-10)) * F.greatest(F.stddev_samp(y), F.lit(1e-10)))


def fisher_z(r: Column) -> Column:
    c = F.greatest(F.least(r, F.lit(1 - 1e-10)), F.lit(-1 + 1e-10))
    return F.when(F.isnan(r), F.lit(NAN)).otherwise(0.5 * F.log((1 + c) / (1 - c)))


def t_of_r(r: Column, n: Column) -> Column:
    """t statistic of a correlation over n frames; null where it is not finite."""
    return F.when(1 - r * r > 0, r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0))))


def paired(long: DataFrame, seed: DataFrame, delay: int = 0, length: int | None = None) -> DataFrame:
    """Samples with the seed value of their frame: voxel, x, y, z, t, v, s.

    With a delay d the series at index i + max(0, d) meets the seed at i + max(0, -d); ``length`` keeps the
    first frames only. The seed has one row per frame.
    """
    s = seed.select((F.col("t") + delay).alias("t"), F.col("value").alias("s"))
    kept = long if length is None else long.where(F.col("t") < length)
    if length is not None:
        s = s.where(F.col("t") < length + max(0, -delay))
    return kept.join(s, "t")


def correlate(long: DataFrame, seed: DataFrame, conversion: str = "z", delay: int = 0, length: int | None = None) -> DataFrame:
    """r, z or t of every voxel's series with a seed course: voxel, value."""
    g = paired(long, seed, delay, length).groupBy("voxel").agg(pearson(F.col("v"), F.col("s")).alias("r"), F.count("*").alias("n"))
    value = {"none": F.col("r"), "z": fisher_z(F.col("r")), "t": t_of_r(F.col("r"), F.col("n"))}[conversion]
    return g.select("voxel", value.alias("value"))


def monte_carlo(long: DataFrame, seed: DataFrame, draws: DataFrame) -> DataFrame:
    """Mean z over random subsets of frames; ``draws`` (rep, t) is shared by all voxels."""
    p = paired(long, seed).join(draws, "t")
    z = p.groupBy("voxel", "rep").agg(fisher_z(pearson(F.col("v"), F.col("s"))).alias("z"))
    return z.groupBy("voxel").agg(F.avg("z").alias("value"))


# t-test


def t_test(samples: DataFrame, keys: list[str], mu: float = 0.0) -> DataFrame:
    """One-sample t of ``v`` within the keys: keys, tvalue, df; null where the deviation is 0."""
    g = samples.groupBy(*keys).agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"), F.count("v").alias("n"))
    t = (F.col("m") - mu) / F.nullif(F.col("sd") / F.sqrt("n"), F.lit(0.0))
    return g.select(*keys, t.alias("tvalue"), (F.col("n") - 1).alias("df"))


# Regression


def simple_regression(long: DataFrame, regressor: DataFrame, output: str = "residual") -> DataFrame:
    """Least squares on one regressor with intercept: voxel, t, value (residual or fitted) or voxel, slope, intercept.

    The sums are a partial aggregate per voxel; the regressor (t, value) has one row per frame.
    """
    p = long.join(regressor.select("t", F.col("value").alias("s")), "t")
    sxx = F.sum(F.col("s") * F.col("s")) - F.sum("s") * F.sum("s") / F.count("*")
    sxy = F.sum(F.col("s") * F.col("v")) - F.sum("s") * F.sum("v") / F.count("*")
    slope = F.coalesce(sxy / F.when(F.abs(sxx) > 1e-12, sxx), F.lit(0.0))
    b = p.groupBy("voxel").agg(slope.alias("slope"), F.avg("v").alias("mv"), F.avg("s").alias("ms"))
    b = b.select("voxel", "slope", (F.col("mv") - F.col("slope") * F.col("ms")).alias("intercept"))
    if output == "betas":
        return b
    fit = F.col("intercept") + F.col("slope") * F.col("s")
    value = fit if output == "fitted" else F.col("v") - fit
    return p.join(b, "voxel").select("voxel", "t", value.alias("value"))


def band_stop_regressors(frames: int, tr: float, f1: float, f2: float) -> np.ndarray:
    """Sine and cosine columns of the frequencies below f1 and above f2 (frames x 2n)."""
    nyquist = 1 / (2 * tr)
    width = nyquist / (frames // 2)
    low = [width * i for i in range(1, int(f1 / width) + 1)]
    high = [nyquist - width * i for i in range(int((nyquist - f2) / width))]
    t = np.arange(frames) * tr
    cols = [f(2 * math.pi * w * t) for w in low + high for f in (np.sin, np.cos)]
    return np.stack(cols, axis=1) if cols else np.zeros((frames, 0))


def multiple_regression(series: DataFrame, design: np.ndarray, output: str = "residual", zscore: bool = False) -> DataFrame:
    """Least squares with intercept on a design (frames x p) of series in L2: keys and ``ts`` (or betas).

    The pseudo-inverse is computed once (rank by tolerance on balanced columns) and multiplied with batches of
    series, so there is no shuffle and no per-voxel decomposition.
    """
    x = np.asarray(design, float)
    x = x - x.mean(0)
    sd = x.std(0, ddof=1)
    x = np.c_[np.ones(len(x)), x / np.where(sd > 0, sd, 1)]
    pinv = np.linalg.pinv(x, rcond=1e-12)
    back = np.where(sd > 0, sd, 1)
    mean = np.asarray(design, float).mean(0)

    def solve(y: np.ndarray) -> np.ndarray:
        if zscore:
            s = y.std(1, ddof=1, keepdims=True)
            y = (y - y.mean(1, keepdims=True)) / np.where(s > 0, s, 1)
        b = y @ pinv.T
        if output == "fitted":
            return b @ x.T
        if output == "residual":
            return y - b @ x.T
        slopes = b[:, 1:] / back
        return np.c_[b[:, :1] - slopes @ mean[:, None], slopes]

    return map_series(series, solve)


def regression_fit(series: DataFrame, design: np.ndarray) -> tuple[DataFrame, int, np.ndarray]:
    """What the least-squares fits of :func:`multiple_regression` are worth: chi2 (sum of squared residuals) per voxel, the
    rank of the design with its intercept, and (X'X)^-1, so that chi2 / (frames - rank) times it is the covariance of a
    voxel's coefficients. Series with a NaN have a NaN."""
    x = np.c_[np.ones(len(design)), np.asarray(design, float)]
    size = np.linalg.norm(x, axis=0)
    size = np.where(size > 0, size, 1)
    rank = int(np.linalg.matrix_rank(x / size, tol=1e-12 * len(x)))
    spread = np.linalg.pinv((x / size).T @ (x / size), rcond=1e-12) / np.outer(size, size)
    res = multiple_regression(series, design)
    chi2 = F.aggregate("ts", F.lit(0.0), lambda s, v: s + v * v)
    return res.select(*[c for c in series.columns if c != "ts"], chi2.alias("chi2")), rank, spread


def map_series(series: DataFrame, kernel) -> DataFrame:
    """A numpy kernel (voxels x frames to voxels x out) over the ``ts`` of L2, by Arrow batches.

    Series that hold a NaN or null give NaN throughout; all series of an image have one length.
    """
    names = series.columns
    at = names.index("ts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat = b.column(at)
            y = np.array(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
            with np.errstate(all="ignore"):
                out = kernel(y)
            out[~np.isfinite(y).all(1)] = NAN
            values = pa.array(np.ascontiguousarray(out).ravel())
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * out.shape[1])
            cols = [pa.ListArray.from_arrays(offsets, values) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return series.mapInArrow(work, series.schema)


# Band-pass


def bandpass_fft(series: DataFrame, frames: int, tr: float, f1: float, f2: float, keep_mean: bool = False, rolloff: float | None = None) -> DataFrame:
    """Band-pass of L2 series by real FFT and attenuation of the bins."""
    weight = spectrum.attenuation(frames, tr, f1, f2, keep_mean, rolloff)
    return map_series(series, lambda y: np.fft.irfft(np.fft.rfft(y, axis=1) * weight, n=frames, axis=1))


def bandpass_kernel(long: DataFrame, frames: int, tr: float, f1: float, f2: float, keep_mean: bool = False) -> DataFrame:
    """The same as a circular convolution within each voxel: voxel, t, value.

    The kernel's circulant (frames x frames) multiplies batches of series.
    """
    from .layouts import series_from_long

    h = np.asarray(spectrum.kernel(spectrum.attenuation(frames, tr, f1, f2, keep_mean), frames), float)
    k = np.arange(frames)
    circulant = h[(k[None, :] - k[:, None]) % frames]  # row s: what frame s gives to every frame
    out = map_series(series_from_long(long.select("voxel", "t", "v")), lambda y: y @ circulant)
    return out.select("voxel", F.posexplode("ts").alias("t", "value"))


def attenuation_table(spark, frames: int, tr: float, f1: float, f2: float, keep_mean: bool = False, rolloff: float | None = None) -> DataFrame:
    """bin, freq, weight: one row per frequency bin."""
    w = spectrum.attenuation(frames, tr, f1, f2, keep_mean, rolloff)
    return spark.createDataFrame([(k, k / (frames * tr), float(x)) for k, x in enumerate(w)], "bin int, freq double, weight double")


# Resampling in time


def resampled_frames(frames: int, tr_in: float, tr_out: float, order: int = 2) -> int:
    return math.floor(frames * tr_in / tr_out - order)


def resample_floor(series: DataFrame, frames: int, tr_in: float, tr_out: float, order: int = 2) -> DataFrame:
    """out[j] = in[floor(order - 1 + j * tr_out / tr_in)] of L2 series; positions past the end are NaN."""
    n = resampled_frames(frames, tr_in, tr_out, order)
    at = [math.floor(order - 1 + j * tr_out / tr_in) for j in range(n)]
    pick = F.array(*[F.get("ts", F.lit(i)) if i < frames else F.lit(NAN) for i in at])
    return series.withColumn("ts", pick)


def lanczos_weights(frames: int, tr_in: float, tr_out: float, order: int = 2) -> np.ndarray:
    """Windowed-sinc weights (out x in); a row whose window leaves the series is NaN."""
    n = resampled_frames(frames, tr_in, tr_out, order)
    w = np.zeros((n, frames))
    for j in range(n):
        p = order - 1 + j * tr_out / tr_in
        k = np.arange(math.floor(p) - order + 1, math.floor(p) + order + 1)
        if k[0] < 0 or k[-1] >= frames:
            w[j] = NAN
            continue
        d = p - k
        w[j, k] = np.sinc(d) * np.sinc(d / order)
    return w


def resample_lanczos(series: DataFrame, frames: int, tr_in: float, tr_out: float, order: int = 2) -> DataFrame:
    """Temporal windowed-sinc interpolation of L2 series."""
    w = lanczos_weights(frames, tr_in, tr_out, order)
    return map_series(series, lambda y: y @ w.T)


# Ranks and scores


def average_rank(df: DataFrame, by: list[str], col: str, out: str = "rank") -> DataFrame:
    """Rank within ``by``, ties sharing their mean rank."""
    w = W.partitionBy(*by)
    return df.withColumn(out, F.rank().over(w.orderBy(col)) + (F.count("*").over(W.partitionBy(*by, col)) - 1) / 2)


def z_scores(long: DataFrame) -> DataFrame:
    """Standard scores per voxel (0 for a constant series): voxel, t, value."""
    g = long.groupBy("voxel").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("sd"))
    z = F.coalesce((F.col("v") - F.col("m")) / F.when(F.col("sd") > 1e-12, F.col("sd")), F.lit(0.0))
    return long.join(g, "voxel").select("voxel", "t", z.alias("value"))
