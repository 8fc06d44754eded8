"""Queries of the imaging operators over the test tables.

``embeddings`` is read as one image: the vector is the voxel on an 8 x 8 grid, the position in it the frame;
label 2 and 7 are two regions. ``events`` and ``lineitem`` give irregular series.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import spectrum
from ..operators import layouts, masks, motion, multivariate, spatial, temporal
from ..session import table
from .voxels_sql import ORACLE as SQL

T, TR, F1, F2 = 64, 2.0, 0.009, 0.08
DIGITS = 6
#: Slices of the volume in which masks grow, as in its SQL; more where the table has more.
SLICES = 32
AFFINE = [[3.0, 0, 0, -12], [0, 3.0, 0, -12], [0, 0, 3.0, -12], [0, 0, 0, 1]]


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Doubles to six digits, -0.0 to 0.0, NaN to null."""
    clean = lambda c: F.when(F.isnan(c), None).otherwise(F.round(c, DIGITS) + 0.0)
    return df.select(*[clean(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def image(spark: SparkSession, d: str) -> DataFrame:
    return layouts.from_vectors(table(spark, d, "embeddings"))


def long(spark: SparkSession, d: str) -> DataFrame:
    return layouts.long_from_series(image(spark, d))


def mask_of(spark: SparkSession, d: str, label: int = 2) -> DataFrame:
    s = image(spark, d)
    return s.select("x", "y", "z", F.when(F.col("label") == label, 1.0).otherwise(0.0).alias("weight"))


def region_samples(spark: SparkSession, d: str, label: int = 2) -> DataFrame:
    """Samples of a region; the mask meets the series, one row per voxel, before they are exploded."""
    return layouts.long_from_series(masks.select(image(spark, d), mask_of(spark, d, label)))


def seed(spark: SparkSession, d: str, label: int = 2) -> DataFrame:
    return temporal.mean_course(region_samples(spark, d, label))


def samples_long(spark, d):
    return rounded(long(spark, d).select("voxel", "x", "y", "z", "t", "v"), "v")


def mask_apply(spark, d):
    return rounded(masks.apply(long(spark, d), mask_of(spark, d)).select("voxel", "t", "v"), "v")


def mask_clean(spark, d):
    # Two voxels are spoiled so that the filter has something to drop.
    v = F.when((F.col("voxel") == 3) & (F.col("t") == 5), float("nan")).when(F.col("voxel") == 4, 1.0).otherwise(F.col("v"))
    return masks.clean(long(spark, d).withColumn("v", v))


def mask_binarize(spark, d):
    return long(spark, d).where("t = 0").select("voxel", masks.binarize(F.col("v")).alias("member"))


def mask_dilate(spark, d):
    m = mask_of(spark, d).where("weight > 0.5")
    x, y, z = _dims(spark, d)
    return masks.dilate(m).where(masks.in_volume((x, y, max(z, SLICES))))


def _cells0(spark, d):
    return long(spark, d).where("t = 0").select("voxel", "x", "y", "z", "v")


def roi_sphere(spark, d):
    return masks.region(_cells0(spark, d), center=(0.0, 0.0, 0.0), sphere=9.0, value=2.0, affine=AFFINE).select("voxel", "v")


def roi_cube(spark, d):
    return masks.region(_cells0(spark, d), center=(3.0, 4.0, 2.0), cube=(4.0, 2.0, 3.0)).select("voxel", "v")


def roi_union_keep(spark, d):
    r = masks.region(_cells0(spark, d), center=(2.0, 2.0, 2.0), sphere=1.5, cube=(6.0, 1.0, 1.0), value=5.0, keep=True)
    return rounded(r.select("voxel", "v"), "v")


def roi_random_sample(spark, d):
    return masks.random_cells(mask_of(spark, d).withColumnRenamed("weight", "v"), 10, seed=7)


def tc_mean(spark, d):
    return rounded(seed(spark, d), "value")


def tc_stddev(spark, d):
    return rounded(temporal.stddev_course(region_samples(spark, d)), "value")


def tc_point(spark, d):
    return rounded(temporal.point_course(long(spark, d), 3, 4, 5), "value")


def corr_r(spark, d):
    return rounded(temporal.correlate(long(spark, d), seed(spark, d), "none"), "value")


def corr_z(spark, d):
    return rounded(temporal.correlate(long(spark, d), seed(spark, d), "z"), "value")


def corr_t(spark, d):
    return rounded(temporal.correlate(long(spark, d), seed(spark, d), "t"), "value")


def corr_delay(spark, d):
    return rounded(temporal.correlate(long(spark, d), seed(spark, d), "z", delay=3), "value")


def corr_length(spark, d):
    return rounded(temporal.correlate(long(spark, d), seed(spark, d), "z", length=40), "value")


def corr_montecarlo(spark, d):
    # 16 of 64 frames in each of five draws, by an arithmetic permutation.
    draws = spark.range(5 * 16).select(F.expr("id div 16").alias("rep"), F.expr("((id % 16) * 37 + (id div 16) * 11) % 64").alias("t"))
    return rounded(temporal.monte_carlo(long(spark, d), seed(spark, d), draws), "value")


def ttest_single(spark, d):
    return rounded(temporal.t_test(long(spark, d), ["voxel"]), "tvalue")


def ttest_multi(spark, d):
    return rounded(temporal.t_test(long(spark, d), ["label", "t"]), "tvalue")


def regress_1(spark, d):
    return rounded(temporal.simple_regression(long(spark, d), seed(spark, d)), "value")


def regress_1_betas(spark, d):
    return rounded(temporal.simple_regression(long(spark, d), seed(spark, d), "betas"), "slope", "intercept")


def regress_1_fitted(spark, d):
    return rounded(temporal.simple_regression(long(spark, d), seed(spark, d), "fitted"), "value")


def _design(spark, d, labels):
    """Mean courses of regions as columns; frames x regions numbers reach the driver."""
    m = long(spark, d).where(F.col("label").isin(*labels)).groupBy("t", "label").agg(F.avg("v").alias("value"))
    out = np.zeros((T, len(labels)))
    for r in m.collect():
        out[r.t, labels.index(r.label)] = r.value
    return out


def regress_2(spark, d):
    r = temporal.multiple_regression(image(spark, d).select("voxel", "ts"), _design(spark, d, (2, 7)))
    return rounded(r.select("voxel", F.posexplode("ts").alias("t", "value")), "value")


def regress_many(spark, d):
    r = temporal.multiple_regression(image(spark, d).select("voxel", "ts"), _design(spark, d, (1, 2, 3, 5, 7)), "betas")
    return rounded(r.select("voxel", F.posexplode("ts").alias("beta", "value")), "value")


def regress_bandstop(spark, d):
    x = np.c_[_design(spark, d, (2,)), temporal.band_stop_regressors(T, TR, F1, F2)]
    r = temporal.multiple_regression(image(spark, d).select("voxel", "ts"), x)
    return rounded(r.select("voxel", F.posexplode("ts").alias("t", "value")), "value")


def bandpass(spark, d):
    f = temporal.bandpass_fft(image(spark, d).select("voxel", "ts"), T, TR, F1, F2)
    return rounded(f.select("voxel", F.posexplode("ts").alias("t", "value")), "value")


def bandpass_keepmean(spark, d):
    f = temporal.bandpass_fft(image(spark, d).select("voxel", "ts"), T, TR, 0.02, F2, keep_mean=True)
    return rounded(f.select("voxel", F.posexplode("ts").alias("t", "value")), "value")


def bandpass_convolution(spark, d):
    return rounded(temporal.bandpass_kernel(long(spark, d), T, TR, F1, F2), "value")


def attenuation_table(spark, d):
    return rounded(temporal.attenuation_table(spark, T, TR, F1, F2), "freq", "weight")


def attenuation_sigmoid(spark, d):
    return rounded(temporal.attenuation_table(spark, T, TR, F1, F2, rolloff=10.0), "freq", "weight")


def resample_floor(spark, d):
    r = temporal.resample_floor(image(spark, d).select("voxel", "ts"), T, TR, 3.0)
    return rounded(r.select("voxel", F.posexplode("ts").alias("t", "value")), "value")


def resample_lanczos(spark, d):
    r = temporal.resample_lanczos(image(spark, d).select("voxel", "ts"), T, TR, 3.0)
    return rounded(r.select("voxel", F.posexplode("ts").alias("t", "value")), "value")


def zscore_series(spark, d):
    return rounded(temporal.z_scores(long(spark, d)), "value")


def rank_avg_ties(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", F.floor(F.col("embedding")[0] * 4).cast("long").alias("level"))
    return temporal.average_rank(v, ["label"], "level").select("vec_id", "rank")


def matrix_conversion(spark, d):
    z = temporal.correlate(long(spark, d), seed(spark, d), "none").withColumnRenamed("value", "r")
    modes = ("absolute", "positive", "negative", "scaled")
    return rounded(z.select("voxel", *[multivariate.converted(F.col("r"), m).alias(m) for m in modes]), *modes)


def _frame_pairs(spark, d):
    c = multivariate.frame_covariance(image(spark, d), T)
    rows = [(i, j, float(c[i, j])) for i in range(T) for j in range(T)]
    return spark.createDataFrame(rows, "t1 int, t2 int, cov double")


def cov_matrix_tt(spark, d):
    return rounded(_frame_pairs(spark, d), "cov")


def tpca_courses(spark, d):
    c, _ = multivariate.temporal_pca(image(spark, d), T, components=5)
    return rounded(multivariate.courses(spark, c), "value")


def tpca_maps(spark, d):
    _, m = multivariate.temporal_pca(image(spark, d).select("voxel", "ts"), T, components=5)
    return rounded(m.select("voxel", F.posexplode("ts").alias("component", "value")), "value")


def tpca_eigenvalues(spark, d):
    c, _ = multivariate.temporal_pca(image(spark, d), T, variance=0.5, standardise=True)
    return rounded(multivariate.eigenvalues(spark, c), "eigenvalue")


def spca_courses(spark, d):
    c, _ = multivariate.spatial_pca(image(spark, d), T, components=3)
    return rounded(multivariate.courses(spark, c), "value")


def spca_maps(spark, d):
    _, m = multivariate.spatial_pca(image(spark, d).select("voxel", "ts"), T, components=3)
    return rounded(m.select("voxel", F.posexplode("ts").alias("component", "value")), "value")


def csp_courses(spark, d):
    s = image(spark, d)
    c = multivariate.common_spatial_patterns(s.where("label < 5"), s.where("label >= 5"), T, 4)
    return rounded(multivariate.courses(spark, c), "value")


def csp_eigenvalues(spark, d):
    s = image(spark, d)
    c = multivariate.common_spatial_patterns(s.where("label < 5"), s.where("label >= 5"), T, 4)
    return rounded(multivariate.eigenvalues(spark, c), "eigenvalue")


# Motion: six parameters from the daily means of the event types and the daily count.

TYPES = ("click", "purchase", "signup", "view", "error")


def _motion_table(spark, d):
    """One row per day: c1..c5 daily mean value of each event type in order of name, c6 daily rows / 1000."""
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", "value")
    g = e.groupBy("day").pivot("event_type").agg(F.avg("value"))
    n = e.groupBy("day").agg((F.count("*") / 1000).alias("c6"))
    names = sorted(c for c in g.columns if c != "day")
    if len(names) > 5:
        raise ValueError(f"{len(names)} event types: with the count they are no six parameters")
    j = g.join(n, "day").select("day", *[F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias(f"c{i + 1}") for i, c in enumerate(names[:5])], "c6")
    first = e.agg(F.min("day").alias("first"))
    return j.join(F.broadcast(first), F.lit(True)).select(F.datediff("day", "first").alias("t"), *[f"c{i}" for i in range(1, 7)])


def fd(spark, d):
    rp = motion.reordered(_motion_table(spark, d)).withColumn("run", F.lit(0))
    return rounded(motion.framewise_displacement(rp, ["run"]).select("t", "fd"), "fd")


def fd_fsl(spark, d):
    rp = motion.reordered(_motion_table(spark, d), "fsl").withColumn("run", F.lit(0))
    return rounded(motion.framewise_displacement(rp, ["run"]).select("t", "fd"), "fd")


def value_range(spark, d):
    return rounded(motion.value_range(long(spark, d)), "lo", "hi")


def _bright(spark, d):
    return long(spark, d).withColumn("v", (F.col("v") + 1) * 2000)


def modal_hist(spark, d):
    return motion.histogram(_bright(spark, d))


def modal_value(spark, d):
    return motion.modal_bin(_bright(spark, d))


def dvars_range(spark, d):
    return rounded(motion.dvars_range(region_samples(spark, d)), "dvars")


def dvars_modal(spark, d):
    return rounded(motion.dvars_modal(region_samples(spark, d).withColumn("v", (F.col("v") + 1) * 2000)), "dvars")


def _metrics(spark, d):
    """fd and dvars of a deterministic kind: the mean course and its scatter."""
    s = region_samples(spark, d)
    return s.groupBy("t").agg(F.abs(F.avg("v")).alias("fd"), F.stddev_samp("v").alias("dvars")).withColumn("run", F.lit(0))


def flag_dilate(spark, d):
    return motion.flagged(_metrics(spark, d), ["run"], 0.02, 1.0).select("t", "flagged")


def frame_map(spark, d):
    f = motion.flagged(_metrics(spark, d), ["run"], 0.02, 1.0)
    return motion.frame_map(f, ["run"]).select("t", "new_t")


def scrub(spark, d):
    f = motion.flagged(_metrics(spark, d), ["run"], 0.02, 1.0).where("flagged = 1")
    s = motion.scrub(long(spark, d).withColumn("run", F.lit(0)), f, ["run"])
    return rounded(s.select("voxel", "t", "v"), "v")


# Space


def _dims(spark, d):
    """Size of the image: 8 x 8 cells and the slices of the table, the last of which may be filled in part."""
    last = image(spark, d).agg(F.max("z")).first()[0]
    return 8, 8, (last or 0) + 1


def _cells(spark, d):
    """All cells of all frames."""
    return long(spark, d).select("t", "x", "y", "z", "v")


def pad_const(spark, d):
    return rounded(spatial.pad(_cells(spark, d), _dims(spark, d), (1, 0, 2), (0, 1, 0), -1.0), "v")


def crop(spark, d):
    return rounded(spatial.pad(_cells(spark, d), _dims(spark, d), (-2, -1, 0), (-1, -3, -4), 0.0), "v")


def pad_mirror(spark, d):
    return rounded(spatial.pad_mirror(_cells(spark, d), _dims(spark, d), (2, 1, 0), (1, 3, 2)), "v")


def orient_flip(spark, d):
    return rounded(spatial.reorient(_cells(spark, d), _dims(spark, d), "RAS", "LSP"), "v")


def grid_resample_mask(spark, d):
    """The mask on a grid of 5 x 5 cells and eleven slices for every eight."""
    x, y, z = _dims(spark, d)
    return masks.resample(mask_of(spark, d), (x, y, z), (5, 5, -(-11 * z // 8)))


def smooth_x(spark, d):
    return rounded(spatial.smooth_axis(_cells(spark, d), "x", 6.0, 3.0), "v")


def smooth_gauss(spark, d):
    return rounded(spatial.smooth(_cells(spark, d), 6.0, (3.0, 3.0, 3.0)), "v")


def border_distance(spark, d):
    m = image(spark, d).select("x", "y", "z", F.when(F.col("label") <= 4, 1).otherwise(0).alias("on"))
    return rounded(spatial.border_distance(m, (3.0, 3.0, 3.0)), "dist")


def rescale_dist8(spark, d):
    g, _ = spatial.rescale_targets(spark, _dims(spark, d), (1.5, 1.0, 0.75))
    return rounded(spatial.distance_weighted(g, _cells(spark, d)), "value")


def interp_lanczos3(spark, d):
    g, _ = spatial.rescale_targets(spark, _dims(spark, d), (1.25, 1.25, 1.25))
    return rounded(spatial.lanczos3(g, _cells(spark, d)), "value")


def interp_trilinear(spark, d):
    g, _ = spatial.rescale_targets(spark, _dims(spark, d), (1.25, 1.25, 1.25))
    return rounded(spatial.trilinear(g, _cells(spark, d)), "value")


def mult_div(spark, d):
    a = long(spark, d).select("x", "y", "z", "t", "v")
    b = a.withColumn("v", F.col("v") * 2 + 1)
    m, q = spatial.combine(a, b, "mult"), spatial.combine(a, b, "div")
    j = m.withColumnRenamed("v", "product").join(q.withColumnRenamed("v", "quotient"), ["x", "y", "z", "t"])
    return rounded(j, "product", "quotient")


def paste_regressors(spark, d):
    a, b = seed(spark, d, 2), seed(spark, d, 7)
    return rounded(a.withColumnRenamed("value", "r1").join(b.withColumnRenamed("value", "r2"), "t"), "r1", "r2")


# Volume series: suppliers by month.


def _supplier_months(spark, d):
    li = table(spark, d, "lineitem")
    t = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate") - 1
    return li.groupBy(F.col("l_suppkey").alias("voxel"), t.alias("t")).agg(F.avg(F.col("l_extendedprice").cast("double")).alias("v"))


def supplier_corr(spark, d):
    m = _supplier_months(spark, d)
    z = temporal.correlate(m, temporal.mean_course(m), "z")
    return rounded(z, "value")


def supplier_regress(spark, d):
    m = _supplier_months(spark, d)
    return rounded(temporal.simple_regression(m, temporal.mean_course(m), "betas"), "slope", "intercept")


def events_daily(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min(F.to_date("ts")).alias("first"))
    g = e.join(F.broadcast(first), F.lit(True)).groupBy(F.col("user_id").alias("voxel"), F.datediff(F.to_date("ts"), "first").alias("t"))
    return rounded(g.agg(F.avg("value").alias("v")), "v")


def events_ttest(spark, d):
    return rounded(temporal.t_test(events_daily(spark, d), ["voxel"], mu=50.0), "tvalue")


def flagship_dmn(spark, d):
    """Global signal out, band-pass, scrubbing, seed mean, z map: one lazy plan."""
    s = long(spark, d).select("image", "voxel", "x", "y", "z", "label", "t", "v")
    clean = temporal.simple_regression(s, temporal.mean_course(s)).withColumnRenamed("value", "v")
    filtered = temporal.bandpass_fft(layouts.series_from_long(clean), T, TR, F1, F2)
    back = filtered.select("voxel", F.posexplode("ts").alias("t", "v")).withColumn("run", F.lit(0))
    bad = motion.flagged(_metrics(spark, d), ["run"], 0.02, 1.0).where("flagged = 1")
    kept = motion.scrub(back, bad, ["run"])
    region = image(spark, d).where("label = 2").select("voxel")
    course = temporal.mean_course(kept.join(region, "voxel", "left_semi"))
    return rounded(temporal.correlate(kept, course, "z"), "value")


NAMES = """samples_long mask_apply mask_clean mask_binarize mask_dilate roi_sphere roi_cube roi_union_keep roi_random_sample tc_mean tc_stddev tc_point
corr_r corr_z corr_t corr_delay corr_length corr_montecarlo ttest_single ttest_multi regress_1 regress_1_betas regress_1_fitted regress_2 regress_many
regress_bandstop bandpass bandpass_keepmean bandpass_convolution attenuation_table attenuation_sigmoid resample_floor resample_lanczos zscore_series
rank_avg_ties matrix_conversion cov_matrix_tt tpca_courses tpca_maps tpca_eigenvalues spca_courses spca_maps csp_courses csp_eigenvalues fd fd_fsl
value_range modal_hist modal_value dvars_range dvars_modal flag_dilate frame_map scrub pad_const crop pad_mirror orient_flip grid_resample_mask smooth_x
smooth_gauss border_distance rescale_dist8 interp_lanczos3 interp_trilinear mult_div paste_regressors supplier_corr supplier_regress events_daily
events_ttest flagship_dmn""".split()
QUERIES = {n: globals()[n] for n in NAMES}
ORACLE = SQL
