"""The spatial queries run over every cell of every frame: brute force on an image of ten slices, the last in part."""

import itertools
import math

import numpy as np
import pytest

import __spark_entry__ as entry
from voxlake.functions import affine

N, T, DIMS = 600, 3, (8, 8, 10)
XYZ = np.arange(N) % 8, np.arange(N) // 8 % 8, np.arange(N) // 64


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("image")
    g = np.random.default_rng(5)
    v, label = g.normal(0, 1, (N, T)), g.integers(0, 10, N)
    data = [(i, [float(a) for a in v[i]], int(label[i])) for i in range(N)]
    spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    vols = np.full((T, *DIMS), np.nan)
    vols[(slice(None), *XYZ)] = v.T
    mask = np.full(DIMS, np.nan)
    mask[XYZ] = label == 2
    return str(d), vols, mask


def lanczos(d):
    return np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0.0).prod(1)


def nearness(d):
    return np.sqrt(((1 - np.abs(d)) ** 2).sum(1))


def around(vol, p, weight, reach):
    """Sum of weighted cells, of weights and number of cells around every position."""
    v, w, n = np.zeros(len(p)), np.zeros(len(p)), np.zeros(len(p), int)
    f = np.floor(p).astype(int)
    for o in itertools.product(range(reach[0], reach[1] + 1), repeat=3):
        at = f + o
        inside = ((at >= 0) & (at < vol.shape)).all(1)
        c = vol[tuple(np.where(inside[:, None], at, 0).T)]
        ok = inside & np.isfinite(c)
        k = weight(p - at)
        v, w, n = v + np.where(ok, c * k, 0), w + np.where(ok, k, 0), n + ok
    return v, w, n


def near(vol, p):
    v, w, _ = around(vol, p, nearness, (0, 1))
    return np.where(w > 0, v / np.where(w > 0, w, 1), np.nan)


def full(vol, p):
    v, _, n = around(vol, p, lanczos, (-2, 3))
    return np.where(n == 216, v, near(vol, p))


def linear(vol, p):
    v, w, _ = around(vol, p, lambda d: np.maximum(1 - np.abs(d), 0).prod(1), (0, 1))
    return np.where(w > 1 - 1e-9, v, np.nan)


def positions(size, m=None):
    """Positions of a grid's cells in order of their number, x fastest."""
    i = np.arange(math.prod(size))
    p = np.stack([i % size[0], i // size[0] % size[1], i // (size[0] * size[1])], 1).astype(float)
    return p if m is None else p @ m[:3, :3].T + m[:3, 3]


def rescaled(size):
    return positions(size) / (np.array(size) / DIMS)


def as_grid(values, size):
    return values.reshape(size[::-1]).transpose(2, 1, 0)


def smoothed(vol, axes):
    sigma = 6.0 / (2 * math.sqrt(2 * math.log(2)))
    for a in axes:
        i = np.arange(DIMS[a])
        d = np.abs(i[:, None] - i)
        k = np.where(d <= math.ceil(4 * sigma / 3), np.exp(-((d * 3.0) ** 2) / (2 * sigma**2)), 0.0)
        ok = np.isfinite(vol)
        along = lambda x: np.moveaxis(np.tensordot(k, x, (1, a)), 0, a)  # noqa: B023, E731
        vol = np.where(ok, along(np.where(ok, vol, 0)) / np.maximum(along(ok * 1.0), 1e-300), np.nan)
    return vol


def wanted(name, vol):
    grid = np.diag([3.0, 3, 3, 1])
    turned = lambda deg: np.array([[np.cos(np.deg2rad(deg)), -np.sin(np.deg2rad(deg))], [np.sin(np.deg2rad(deg)), np.cos(np.deg2rad(deg))]])
    if name == "pad_const":
        return np.pad(np.where(np.isnan(vol), -1.0, vol), ((1, 0), (0, 1), (2, 0)), constant_values=-1.0)
    if name == "crop":
        return np.where(np.isnan(vol), 0.0, vol)[2:-1, 1:-3, :-4]
    if name == "pad_mirror":
        return np.pad(vol, ((2, 1), (1, 3), (0, 2)), mode="symmetric")
    if name == "orient_flip":
        return vol[::-1, ::-1].transpose(0, 2, 1)
    if name in ("smooth_x", "smooth_gauss"):
        return smoothed(vol, (0,) if name == "smooth_x" else (0, 1, 2))
    if name == "rescale_dist8":
        return near(vol, rescaled((12, 8, 8)))
    if name in ("interp_lanczos3", "interp_trilinear"):
        return (full if name == "interp_lanczos3" else linear)(vol, rescaled((10, 10, 13)))
    if name == "deoblique":
        m = np.eye(4)
        m[:2, :2], m[2, 2] = turned(10) * 3, 3
        out, size = affine.straight_grid(m, DIMS)
        # Cells that fall on cells: the exact positions, without the rounding errors of the inverse.
        return as_grid(full(vol, positions(size, np.round(np.linalg.inv(m) @ out, 12))), size)
    if name == "transform_chain":
        shift, turn = np.eye(4), np.eye(4)
        shift[:3, 3], turn[:2, :2] = (1.5, 0, -3.0), turned(5)
        v = full(vol, positions(DIMS, np.linalg.inv(grid) @ np.linalg.inv(turn @ shift) @ grid))
        return as_grid(np.where(np.isnan(v), 0.0, 2 * v), DIMS)
    return as_grid(full(vol, positions(DIMS) - (0, 1, 0)), DIMS)  # fugue_warp


@pytest.mark.parametrize("name", """smooth_x smooth_gauss pad_const crop pad_mirror orient_flip rescale_dist8 interp_lanczos3 interp_trilinear
deoblique transform_chain fugue_warp""".split())
def test_every_frame_and_cell(spark, stored, name):
    d, vols, _ = stored
    df = entry.queries()[name](spark, d)
    value = "value" if "id" in df.columns else "v"
    place = ["id"] if "id" in df.columns else ["x", "y", "z"]
    got = {(r.t, *(r[c] for c in place)): r[value] for r in df.collect()}
    assert len(got) == df.count()
    seen = 0
    for t in range(T):
        for at, v in np.ndenumerate(wanted(name, vols[t])):
            have = got.get((t, *at))
            seen += (t, *at) in got
            assert np.isnan(v) if have is None else have == pytest.approx(v, abs=2e-6), (t, at)
    assert seen == len(got)


def test_mask_on_another_grid(spark, stored):
    d, _, mask = stored
    got = {(r.x, r.y, r.z): r.weight for r in entry.queries()["grid_resample_mask"](spark, d).collect()}
    size = (5, 5, 14)
    src = [np.floor(np.float32(o) / np.float32(n) * np.arange(n, dtype=np.float32)).astype(int) for o, n in zip(DIMS, size)]
    want = {at: v for at, v in np.ndenumerate(mask[np.ix_(*src)]) if not np.isnan(v)}
    assert got == want and max(z for _, _, z in got) == 13
