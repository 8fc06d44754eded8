import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import layouts, masks, motion, multivariate, spatial, temporal

L1 = "image string, voxel long, x int, y int, z int, t int, v double"


@pytest.fixture(scope="module")
def data():
    return np.random.default_rng(4).normal(size=(8, 20))


@pytest.fixture
def long(spark, data):
    return spark.createDataFrame([("i", k, k % 2, k // 2 % 2, k // 4, t, float(data[k, t])) for k in range(8) for t in range(20)], L1)


def values(df, *keys, v="value"):
    return {tuple(r[k] for k in keys): r[v] for r in df.collect()}


def test_layouts_round_trip(long):
    same = layouts.long_from_series(layouts.series_from_long(long)).select(*long.columns)
    assert same.exceptAll(long).count() == 0 and same.count() == 160
    again = layouts.long_from_volumes(layouts.volumes_from_long(long), 2, 2).select(*[F.col(c).cast(long.schema[c].dataType).alias(c) for c in long.columns])
    assert again.exceptAll(long).count() == 0


def test_stored_values(spark):
    d = spark.createDataFrame([(1.9,), (-1.9,), (1e9,), (float("nan"),)], "v double")
    got = [r[0] for r in d.select(layouts.stored(F.col("v"), F.lit(1.0), F.lit(0.0), "smallint")).collect()]
    assert got == [1, -1, None, None]
    assert d.select(layouts.scaled(F.lit(7), F.lit(0.0), F.lit(5.0))).first()[0] == 7


def test_correlation(long, spark, data):
    seed = spark.createDataFrame([(t, float(data[0, t])) for t in range(20)], "t int, value double")
    r = values(temporal.correlate(long, seed, "none"), "voxel")
    for k in range(8):
        assert r[(k,)] == pytest.approx(np.corrcoef(data[0], data[k])[0, 1])
    z = values(temporal.correlate(long, seed), "voxel")
    assert z[(3,)] == pytest.approx(np.arctanh(np.corrcoef(data[0], data[3])[0, 1])) and z[(0,)] > 11
    flipped = values(temporal.correlate(long, seed.withColumn("value", -F.col("value"))), "voxel")
    assert flipped[(3,)] == pytest.approx(-z[(3,)])
    for d in (-1, 1, 19, -19):
        got = values(temporal.correlate(long, seed, "none", delay=d), "voxel")
        a, b = (data[5, d:], data[0, : 20 - d]) if d > 0 else (data[5, : 20 + d], data[0, -d:])
        if len(a) > 1:
            assert got[(5,)] == pytest.approx(np.corrcoef(a, b)[0, 1])
    flat = values(temporal.correlate(long.withColumn("v", F.lit(2.0)), seed), "voxel")
    assert set(flat.values()) == {0.0}
    nan = long.withColumn("v", F.when(F.col("t") == 3, float("nan")).otherwise(F.col("v")))
    assert all(np.isnan(v) for v in values(temporal.correlate(nan, seed), "voxel").values())


def test_regression(long, spark, data):
    x = np.random.default_rng(9).normal(size=(20, 3))
    full = np.c_[np.ones(20), x]
    s = layouts.series_from_long(long).select("voxel", "ts")
    res = {r.voxel: np.array(r.ts) for r in temporal.multiple_regression(s, x).collect()}
    fit = {r.voxel: np.array(r.ts) for r in temporal.multiple_regression(s, x, "fitted").collect()}
    beta = {r.voxel: np.array(r.ts) for r in temporal.multiple_regression(s, x, "betas").collect()}
    for k in range(8):
        b = np.linalg.lstsq(full, data[k], rcond=None)[0]
        assert np.allclose(beta[k], b) and np.allclose(res[k], data[k] - full @ b) and np.allclose(fit[k] + res[k], data[k])
        assert np.allclose(full.T @ res[k], 0, atol=1e-9)
    one = spark.createDataFrame([(t, float(x[t, 0])) for t in range(20)], "t int, value double")
    r1 = values(temporal.simple_regression(long, one), "voxel", "t")
    m1 = {r.voxel: r.ts for r in temporal.multiple_regression(s, x[:, :1]).collect()}
    assert r1[(2, 7)] == pytest.approx(m1[2][7])
    flat = values(temporal.simple_regression(long, one.withColumn("value", F.lit(1.0))), "voxel", "t")
    assert flat[(2, 7)] == pytest.approx(data[2, 7] - data[2].mean())


def test_t_test(long, data):
    t = values(temporal.t_test(long, ["voxel"], 0.1), "voxel", v="tvalue")
    assert t[(1,)] == pytest.approx((data[1].mean() - 0.1) / (data[1].std(ddof=1) / np.sqrt(20)))
    assert values(temporal.t_test(long.withColumn("v", F.lit(1.0)), ["voxel"]), "voxel", v="tvalue")[(1,)] is None


def test_bandpass_forms_agree(long):
    s = layouts.series_from_long(long).select("voxel", "ts")
    a = values(temporal.bandpass_fft(s, 20, 2.0, 0.02, 0.1).select("voxel", F.posexplode("ts").alias("t", "value")), "voxel", "t")
    b = values(temporal.bandpass_kernel(long, 20, 2.0, 0.02, 0.1), "voxel", "t")
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_components(long, data):
    s = layouts.series_from_long(long).select("voxel", "ts")
    assert np.allclose(multivariate.frame_covariance(s, 20), np.cov(data.T))
    c, maps = multivariate.temporal_pca(s, 20, components=3)
    assert c.values.sum() == pytest.approx(np.trace(np.cov(data.T)))
    assert np.allclose({r.voxel: r.ts for r in maps.collect()}[2], data[2] @ c.vectors)
    c, maps = multivariate.spatial_pca(s, 20, components=2)
    w = np.linalg.eigvalsh(np.cov(data))[::-1]
    assert np.allclose(c.values[:2], w[:2])
    m = np.array([r.ts for r in maps.orderBy("voxel").collect()])
    assert np.allclose(m.T @ m, np.eye(2), atol=1e-8)


def test_masks(long, spark):
    m = spark.createDataFrame([(0, 0, 0, 0.02), (1, 0, 0, 0.005), (1, 1, 1, 1.0), (9, 9, 9, 1.0), (0, 1, 0, float("nan"))], "x int, y int, z int, weight double")
    assert masks.select(long, m).select("voxel").distinct().count() == 2
    assert masks.apply(long, m).where(~F.isnan("v")).count() == 40
    assert masks.select(long, m.where("false")).count() == 0
    assert masks.dilate(m.where("weight = 1.0 and x = 1")).count() == 27
    with pytest.raises(Exception, match="fewer than"):
        masks.random_cells(m.withColumnRenamed("weight", "v"), 9).collect()
    assert masks.random_cells(m.withColumnRenamed("weight", "v").where("x < 9"), 1).count() == 1


def test_scrub_and_flags(long, spark):
    m = spark.createDataFrame([(0, t, 5.0 if t in (0, 4) else float("nan") if t == 9 else 0.1, 0.01) for t in range(12)], "k int, t int, fd double, dvars double")
    f = {r.t for r in motion.flagged(m, ["k"]).where("flagged = 1").collect()}
    assert f == {3, 4, 5}
    kept = motion.scrub(long, spark.createDataFrame([("i", 0), ("i", 19), ("i", 7)], "image string, t int"), ["image"])
    assert sorted({r.t for r in kept.select("t").distinct().collect()}) == list(range(17))
    assert kept.columns == long.columns


def test_displacement(spark):
    d = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1, 1, 1.0, -1.0, 0.0, 2.0, 0.0, 0.0)], "r int, t int, x double, y double, z double, pitch double, roll double, yaw double")
    fd = values(motion.framewise_displacement(d, ["r"]), "t", v="fd")
    assert fd[(0,)] == 0 and fd[(1,)] == pytest.approx(2 + 2 * np.pi * 50 / 180)


@pytest.fixture
def cube(spark):
    g = np.random.default_rng(6).normal(size=(4, 4, 4))
    return g, spark.createDataFrame([(0, x, y, z, float(g[x, y, z])) for x in range(4) for y in range(4) for z in range(4)], "t int, x int, y int, z int, v double")


def test_smoothing(cube, spark):
    g, cells = cube
    a = values(spatial.smooth(cells, 4.0, (2.0, 2.0, 2.0)), "x", "y", "z", v="v")
    b = values(spatial.smooth_volumes(cells, (4, 4, 4), 4.0, (2.0, 2.0, 2.0)), "x", "y", "z", v="v")
    assert all(a[k] == pytest.approx(b[k]) for k in a)
    flat = spatial.smooth(cells.withColumn("v", F.lit(3.0)), 9.0, (1.0, 1.0, 1.0))
    assert all(r.v == pytest.approx(3.0) for r in flat.collect())
    hole = cells.withColumn("v", F.when((F.col("x") == 1) & (F.col("y") == 1), float("nan")).otherwise(F.col("v")))
    assert spatial.smooth(hole, 4.0, (2.0, 2.0, 2.0)).where(F.isnan("v")).count() == 0


def test_padding_and_orientation(cube):
    g, cells = cube
    c = cells.drop("t")
    padded = spatial.pad(c, (4, 4, 4), (2, 1, 0), (0, 1, 3), -9.0)
    back = spatial.pad(padded, (6, 6, 7), (-2, -1, 0), (0, -1, -3))
    assert values(back, "x", "y", "z", v="v") == values(c, "x", "y", "z", v="v")
    mirror = values(spatial.pad_mirror(c, (4, 4, 4), (1, 0, 0), (1, 0, 0)), "x", "y", "z", v="v")
    assert mirror[(0, 2, 2)] == g[0, 2, 2] and mirror[(5, 2, 2)] == g[3, 2, 2]
    turned = spatial.reorient(spatial.reorient(c, (4, 4, 4), "RAS", "SLP"), (4, 4, 4), "SLP", "RAS")
    assert values(turned, "x", "y", "z", v="v") == values(c, "x", "y", "z", v="v")


def test_interpolation(cube, spark):
    g, cells = cube
    c = cells.drop("t")
    t = spark.createDataFrame([(0, 1.0, 2.0, 1.0), (1, 1.5, 2.0, 1.0), (2, 9.0, 9.0, 9.0)], "id long, px double, py double, pz double")
    tri = values(spatial.trilinear(t, c), "id")
    assert tri[(0,)] == pytest.approx(g[1, 2, 1]) and tri[(1,)] == pytest.approx((g[1, 2, 1] + g[2, 2, 1]) / 2) and tri[(2,)] is None
    assert values(spatial.lanczos3(t, c), "id")[(2,)] is None


def test_border_distance(spark):
    on = np.zeros((9, 9, 9), bool)
    on[1:8, 1:8, 1:8] = True
    cells = spark.createDataFrame([(x, y, z, int(on[x, y, z])) for x in range(9) for y in range(9) for z in range(9)], "x int, y int, z int, on int")
    got = values(spatial.border_distance(cells, (1.0, 2.0, 3.0)), "x", "y", "z", v="dist")
    off = np.argwhere(~on)
    for p in np.argwhere(on)[::17]:
        want = np.sqrt((((off - p) * [1, 2, 3]) ** 2).sum(1)).min()
        assert got[tuple(int(v) for v in p)] == pytest.approx(want)
    assert len(got) == on.sum()


def test_ranks(spark):
    d = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 3.0), ("b", 2.0)], "k string, v double")
    assert sorted(r["rank"] for r in temporal.average_rank(d, ["k"], "v").collect()) == [1.0, 1.0, 2.5, 2.5]


def test_worth_of_a_fit(spark):
    import numpy as np

    from voxlake.operators import temporal

    g = np.random.default_rng(0)
    x = g.normal(size=(20, 2))
    x = np.c_[x, x[:, 0] * 2]  # one column depends on another
    y = g.normal(size=(3, 20))
    s = spark.createDataFrame([(k, list(map(float, y[k]))) for k in range(3)], "voxel long, ts array<double>")
    chi2, rank, spread = temporal.regression_fit(s, x)
    full = np.c_[np.ones(20), x[:, :2]]
    res = y.T - full @ np.linalg.lstsq(full, y.T, rcond=None)[0]
    got = {r.voxel: r.chi2 for r in chi2.collect()}
    assert rank == 3 and all(abs(got[k] - (res[:, k] ** 2).sum()) < 1e-9 for k in range(3))
    _, _, plain = temporal.regression_fit(s, x[:, :2])
    assert np.allclose(plain, np.linalg.inv(full.T @ full))
