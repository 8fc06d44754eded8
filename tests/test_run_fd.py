"""Every run has its displacement, whatever its column order and whether it holds numbers or text."""

import datetime

import numpy as np
import pytest

import __spark_entry__ as entry

RP = "run_id long, t int, c1 double, c2 double, c3 double, c4 double, c5 double, c6 double, rp_text string, arrived_at timestamp"
T0 = datetime.datetime(2024, 1, 1)


def test_text_and_column_order(rows, spark, tmp_path):
    x = np.cumsum(np.random.default_rng(3).normal(0, 0.1, (12, 6)), axis=0)  # mm and degrees
    fsl = np.c_[np.deg2rad(x[:, 3:]), x[:, :3]]
    text = lambda v, names: ", ".join(f"{a:.9f} {u}" for a, u in zip(v, names))
    rp = []
    for t in range(12):
        rp += [(1, t, *map(float, x[t]), None, T0), (2, t, *map(float, fsl[t]), None, T0), (5, t, *map(float, x[t]), None, T0)]
        rp += [(3, t, *[None] * 6, text(x[t], ["mm"] * 3 + ["deg"] * 3), T0)]
        rp += [(4, t, *[None] * 6, text(fsl[t] * 1e3, ["mrad"] * 3 + ["um"] * 3), T0)]
    rp.append((1, 4, *[9.0] * 6, None, T0 + datetime.timedelta(days=1)))  # a later copy
    rows(rp, RP).write.parquet(f"{tmp_path}/realignment.parquet")
    rows([(1, "spm"), (2, " FSL (mcflirt)"), (3, None), (4, "Fsl6")], "run_id long, rpformat string").write.parquet(f"{tmp_path}/scrub_run.parquet")
    d = np.abs(np.diff(x, axis=0))
    want = np.r_[0, d[:, :3].sum(1) + d[:, 3:].sum(1) * np.pi * 50 / 180]
    got = {(r.run_id, r.t): r.fd for r in entry.queries()["run_fd"](spark, str(tmp_path)).collect()}
    assert len(got) == 60
    for (_, t), fd in got.items():
        assert fd == pytest.approx(want[t], abs=2e-4)
