import datetime

import numpy as np
import pytest

from voxlake.operators import units as U

RP = "run_id long, t int, c1 double, c2 double, c3 double, c4 double, c5 double, c6 double, rp_text string, arrived_at timestamp"
MM = "run_id long, t int, fd double, arrived_at timestamp, extra int"
RUN = "run_id long, rpformat string, rp_note string, extra int"
T0 = datetime.datetime(2024, 1, 1)


def course(seed, n=60):
    g = np.random.default_rng(seed)
    return np.cumsum(g.normal(0, 0.08, (n, 6)), axis=0)


def displacement(x):
    d = np.abs(np.diff(x, axis=0))
    return np.r_[0, d[:, :3].sum(1) + d[:, 3:].sum(1) * U.MM_PER_DEGREE]


def fixture(rows, specs):
    rp, mm, runs = [], [], []
    for run, (t, r, fmt, note, with_fd, text) in specs.items():
        x = course(run)
        tr, ro = x[:, :3] / U.TRANSLATION[t], x[:, 3:] / U.ROTATION[r]
        fsl = "fsl" in (fmt or "").lower()
        six = np.c_[ro, tr] if fsl else np.c_[tr, ro]
        for i, v in enumerate(six):
            if text:
                names = ([r] * 3 + [t] * 3) if fsl else ([t] * 3 + [r] * 3)
                rp.append((run, i, *[None] * 6, " | ".join(f"{a:.9f} {u}" for a, u in zip(v, names)), T0))
            else:
                rp.append((run, i, *map(float, v), None, T0))
        if with_fd:
            mm += [(run, i, float(f), T0, 1) for i, f in enumerate(displacement(x))]
        runs.append((run, fmt, note, 1))
    return rows(rp, RP), rows(mm, MM), rows(runs, RUN)


def test_units_from_each_source(rows):
    specs = {
        1: ("mm", "deg", "spm", None, True, False),
        2: ("um", "mrad", " SPM12", "field of view 22 cm", True, False),
        3: ("m", "rad", "mcflirt/FSL", "B0 map warped by 12 rad max phase", True, False),
        4: ("mm", "rad", "fsl", None, False, False),
        5: ("cm", "arcmin", None, "trans [cm], rotations in minutes of arc", False, False),
        6: ("inch", "rad", "FSL", None, False, True),
        7: ("um", "deg", "spm", None, False, False),
    }
    rp, mm, runs = fixture(rows, specs)
    got = {r.run_id: (r.translation, r.rotation, r.fsl) for r in U.run_units(rp, mm, runs).collect()}
    assert got == {k: (t, r, "fsl" in (f or "").lower()) for k, (t, r, f, *_) in specs.items()}
    found = {tuple(r) for r in U.found_units(U.run_units(rp, mm, runs)).collect()}
    assert (2, "translation", "um") in found and (2, "rotation", "mrad") in found and all(r[0] != 1 for r in found)
    conv = U.converted(rp, U.run_units(rp, mm, runs))
    for r in conv.where("t = 17").collect():
        assert [r.x, r.y, r.z, r.pitch, r.roll, r.yaw] == pytest.approx(course(r.run_id)[17], abs=1e-4)


def test_spoiled_frames_do_not_decide(rows):
    rp, mm, runs = fixture(rows, {1: ("um", "rad", "spm", None, True, False)})
    from pyspark.sql import functions as F

    rp = rp.withColumn("c2", F.when(F.col("t") % 9 == 0, F.lit(9999.0)).otherwise(F.col("c2")))
    rp = rp.unionByName(rp.where("t = 3"))
    mm = mm.withColumn("fd", F.when(F.col("t") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("fd")))
    assert [tuple(r)[2:] for r in U.run_units(rp, mm, runs).collect()] == [("um", "rad")]


def test_empty_and_constant(rows):
    rp, mm, runs = fixture(rows, {1: ("mm", "deg", "spm", None, False, False)})
    from pyspark.sql import functions as F

    assert U.run_units(rp.where("false"), mm, runs).count() == 0
    flat = rp.select("run_id", "t", *[F.lit(0.0).alias(f"c{i}") for i in range(1, 7)], "rp_text", "arrived_at")
    assert [tuple(r)[2:] for r in U.run_units(flat, mm, runs.where("false")).collect()] == [("mm", "deg")]


def test_scales_are_estimated():
    g = np.random.default_rng(3)
    p, q = g.gamma(3, 40, 200), g.gamma(3, 1.2, 200)
    fd = 0.001 * p + 0.05 * q + 0.02
    p[::9] *= 50  # readings that cannot be true
    fd[4::11] = 7.0
    a, b, c, left, n = U.robust_scales(p, q, fd)
    assert (a, b, c) == pytest.approx((0.001, 0.05, 0.02), rel=1e-3) and left < 1e-3 and n < 200
    assert np.isnan(U.robust_scales(p[:4], q[:4], fd[:4])[0])


def test_unknown_unit_is_not_guessed(rows):
    from pyspark.sql import functions as F

    rp, mm, runs = fixture(rows, {1: ("um", "deg", "spm", None, True, False), 2: ("mm", "deg", "spm", None, True, False)})
    rp = rp.select("run_id", "t", *[(F.col(c) / F.when(F.col("run_id") == 1, 10).otherwise(1)).alias(c) for c in ("c1", "c2", "c3")], "c4", "c5", "c6", "rp_text", "arrived_at")
    links = U.source_links(rp, mm, runs)
    got = {r.run_id: r for r in links.collect()}
    assert (got[1].translation, got[1].rotation) == ("unknown", "deg") and got[1].t_scale == pytest.approx(0.01, rel=1e-3) and got[1].t_off > 2
    assert (got[2].translation, got[2].rotation, got[2].t_from) == ("mm", "deg", "displacements") and got[2].t_off < 0.01
    assert U.found_units(links).count() == 0
    r = U.converted(rp, links).where("run_id = 1 and t = 17").first()
    assert [r.x, r.y, r.z] == pytest.approx(course(1)[17][:3], abs=1e-3)


def test_units_travel_along_the_graph(rows):
    """Runs without displacements: by the subject where it moves unlike the rest, else by the site, else by all."""
    from pyspark.sql import functions as F

    specs = {i: ("mm", "deg", "spm", None, True, False) for i in range(1, 7)}
    specs |= {7: ("mm", "mrad", "spm", None, False, False), 8: ("um", "deg", "spm", None, False, False), 9: ("mm", "rad", "spm", None, False, False)}
    rp, mm, runs = fixture(rows, specs)
    calm = F.when(F.col("run_id").isin(1, 7), 0.1).otherwise(1.0)  # subject of 1 and 7: a tenth of the others' movement
    rp = rp.select("run_id", "t", *[(F.col(f"c{i}") * calm).alias(f"c{i}") for i in range(1, 7)], "rp_text", "arrived_at")
    mm = mm.withColumn("fd", F.col("fd") * calm)
    runs = runs.withColumn("image", F.concat(F.lit("i"), "run_id")).withColumn("site", F.when(F.col("run_id") == 9, "t").otherwise("s"))
    images = rows([(f"i{i}", 1 if i in (1, 7) else 100 + i, "x") for i in range(1, 10)], "image string, subject_no long, extra string")
    got = {r.run_id: (r.translation, r.rotation, r.t_from, r.r_from) for r in U.source_links(rp, mm, runs, images).collect()}
    assert got[7] == ("mm", "mrad", "subject", "subject")
    assert got[8] == ("um", "deg", "site", "site") and got[9] == ("mm", "rad", "all", "all")


def test_long_run_in_blocks(rows, monkeypatch):
    rp, mm, runs = fixture(rows, {1: ("um", "rad", "fsl", None, True, False)})
    monkeypatch.setattr(U, "BLOCK", 16)
    assert [tuple(r)[2:] for r in U.run_units(rp, mm, runs).collect()] == [("um", "rad")]
