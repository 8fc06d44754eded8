import datetime

import numpy as np

from voxlake.operators import spikes as S, tails

RP = "run_id long, t int, c1 double, c2 double, c3 double, c4 double, c5 double, c6 double, rp_text string, arrived_at timestamp, site string"
MM = "run_id long, t int, fd double, dvars double, arrived_at timestamp, extra string"
T0 = datetime.datetime(2024, 1, 1)


def walk(n, seed, scale=0.1):
    g = np.random.default_rng(seed)
    x = np.zeros((n, 6))
    for i in range(1, n):
        x[i] = 0.9 * x[i - 1] + g.normal(0, scale, 6)
    return x


def rp_rows(rows, runs):
    return rows([(r, t, *map(float, x[t]), None, T0, "s") for r, x in runs.items() for t in range(len(x))], RP)


def test_spikes_stuck_and_impossible(rows):
    x = walk(200, 1)
    x[50, 2] += 5
    x[90:92, 4] -= 6
    x[120:127, 0] = x[120, 0]
    x[150, 3] = np.inf
    y = walk(200, 2)
    y[100:, 1] += 8  # a step that stays is behaviour
    got = {(r.run_id, r.t) for r in S.flagged_parameters(rp_rows(rows, {1: x, 2: y})).collect()}
    assert got == {(1, 50), (1, 90), (1, 91), (1, 150), *((1, t) for t in range(120, 127))}


def test_metrics(rows):
    g = np.random.default_rng(0)
    fd, dv = np.abs(g.normal(0.4, 0.1, 150)), g.normal(0.03, 0.003, 150)
    fd[0] = dv[0] = 0
    fd[30], fd[40], fd[60] = 9.0, -1.0, np.nan
    dv[70], dv[80] = 0.3, 0.001
    dv[100:106] = 0.031
    data = [(1, t, None if t == 61 else float(fd[t]), float(dv[t]), T0, "x") for t in range(150)]
    data += [(1, 30, 0.4, 0.03, T0 - datetime.timedelta(days=1), "x")] + [data[70]] * 3
    got = {(r.t, r.measure) for r in S.flagged_metrics(rows(data, MM)).collect()}
    assert got == {(30, "fd"), (40, "fd"), (70, "dvars"), (80, "dvars"), *((t, "dvars") for t in range(100, 106))}
    assert S.flagged_metrics(rows(data * 2, MM)).count() == len(got)


def test_text_lines_and_empty(rows):
    x = walk(100, 5)
    x[40, 0] += 7
    data = [(1, t, *([None] * 6), ", ".join(f"{v:.4f} mm" if i < 3 else f"{v:.4f} deg" for i, v in enumerate(x[t])), T0, "s") for t in range(100)]
    assert [(r.t, r.measure) for r in S.flagged_parameters(rows(data, RP)).collect()] == [(40, "rp")]
    assert S.flagged_parameters(rows([], RP)).count() == 0
    assert S.flagged_metrics(rows([(None, None, None, None, None, None)], MM)).count() == 0


def test_long_run_in_blocks(rows):
    n = 3 * S.BLOCK // 2
    x = walk(n, 7)
    x[S.BLOCK - 1, 1] += 6
    x[S.BLOCK - 3 : S.BLOCK + 4, 5] = 0.123
    got = {r.t for r in S.flagged_parameters(rp_rows(rows, {4: x})).collect()}
    assert got == {*range(S.BLOCK - 3, S.BLOCK + 4)}


def test_long_runs_get_the_limits_of_the_whole_run(rows, monkeypatch):
    g = np.random.default_rng(3)
    x = walk(700, 11)
    x[500:] *= 6  # a restless end: its tail belongs to the run
    x[[40, 255, 256, 640], 1] += 30
    m = [(r, t, float(g.gamma(4, 0.1)) * (20 if t in (99, 300) else 1), float(g.normal(0.03, 0.003)) * (5 if t == 255 else 1), T0, "x") for r in (1, 2) for t in range(700)]
    m += [(3, t, float(g.gamma(4, 0.1)), 0.03, T0, "x") for t in range(200)]
    rp = rp_rows(rows, {1: x, 2: x[:100], 3: -x})
    want = sorted(map(tuple, S.implausible(rp, rows(m, MM)).collect()))
    monkeypatch.setattr(S, "BLOCK", 256)
    assert sorted(map(tuple, S.implausible(rp, rows(m, MM)).collect())) == want
    assert {(1, 255, "rp"), (1, 256, "rp"), (2, 40, "rp"), (1, 99, "fd"), (2, 255, "dvars")} <= set(want)


def test_cutoff_follows_the_tail():
    g = np.random.default_rng(1)
    light, heavy = g.uniform(-1, 1, (50, 400)), g.laplace(0, 1, (50, 400))
    a, b = tails.cutoff(tails.steps(light)), tails.cutoff(tails.steps(heavy))
    assert np.median(a) < 2 < 6 < np.median(b)
    assert np.isinf(tails.cutoff(np.full((1, 20), np.nan)))[0]


def test_spikes_do_not_take_part_in_the_fit():
    g = np.random.default_rng(2)
    x = np.abs(g.normal(0, 1, (30, 300)))
    spoiled = x.copy()
    spoiled[:, ::30] = 80 + g.normal(0, 9, (30, 10))
    a, b = tails.cutoff(tails.steps(x)), tails.cutoff(tails.steps(spoiled))
    assert (b < 15).all() and np.median(b / a) < 1.3


def test_cutoff_from_counts():
    g = np.random.default_rng(4)
    v = tails.steps(g.normal(0, 1, (1, 5000)))
    u, n = np.unique(v, return_counts=True)
    assert np.allclose(tails.cutoff(v), tails.cutoff(u[None, :], n[None, :].astype(float)))


def test_the_fit_decides():
    """Two runs whose flags no common number of robust deviations gives: one with a light tail, one with a heavy one."""
    g = np.random.default_rng(5)
    light, heavy = g.uniform(-1, 1, 300), g.standard_t(3, 300)
    light[150] = 5.0
    dev = [1.4826 * np.median(np.abs(x)) for x in (light, heavy)]
    x = np.stack([light, heavy]) + 50
    hit = S.flags(x, "fd")
    assert np.flatnonzero(hit[0]).tolist() == [150] and not hit[1].any()
    assert light[150] / dev[0] < np.abs(heavy).max() / dev[1]
