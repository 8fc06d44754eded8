import datetime

import pytest

from voxlake.plans import job
from voxlake.streaming import frames

JOB = """<job><parameters><param name="base">${root}/x</param><param name="root">/d</param></parameters><tasks>
<task code="roi"><description>seed region</description><args><arg name="input">img</arg><arg name="center">0,0,0</arg><arg name="sphere">1</arg><arg name="output">region</arg></args></task>
<task code="timecourse"><args><arg name="input">img</arg><arg name="mask">region</arg><arg name="output">seed</arg></args></task>
<task code="correlation"><args><arg name="input">img</arg><arg name="regressor">seed</arg><arg name="output">z</arg></args></task>
<task code="sql"><args><arg name="query">select '${base}' as place, count(*) as n from {z}</arg><arg name="output">summary</arg></args></task>
</tasks></job>"""


def image(spark):
    return spark.createDataFrame([("i", k, k % 2, k // 2, 0, t, float((k + 1) * t % 5)) for k in range(4) for t in range(10)], "image string, voxel long, x int, y int, z int, t int, v double")


def test_pipeline(spark):
    out = job.compile_job(JOB, {"img": image(spark)})
    assert out["z"].count() == 4
    assert tuple(out["summary"].first()) == ("/d/x", 4)
    assert job.compile_job(JOB, {"img": image(spark)}, given={"root": "/e"})["summary"].first().place == "/e/x"
    assert len(job.overview(JOB)) == 4
    assert job.parse(job.serialize(*job.parse(JOB))) == job.parse(JOB)
    assert "z" not in job.compile_job(JOB, {"img": image(spark)}, skip="3-4")


def test_errors(spark):
    with pytest.raises(job.JobError, match="refer to each other"):
        job.resolved({"a": "${b}", "b": "${a}"})
    with pytest.raises(job.JobError, match="undefined parameters: q, r"):
        job.substituted([job.Task("x", "", {"k": ["${q} ${r} ${q}"]})], {})
    with pytest.raises(job.JobError, match="unknown operator"):
        job.compile_job(JOB.replace('"roi"', '"nothing"'), {})
    with pytest.raises(job.JobError, match="is missing"):
        job.compile_job(JOB.replace('name="center"', 'name="centre"'), {})
    with pytest.raises(job.JobError, match="twice"):
        job.operator("roi", "x")(None)
    with pytest.raises(job.JobError):
        job.parse("<job")
    assert job.skipped("1,4-6") == {1, 4, 5, 6}


def test_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(1, t, 3.0 if t == 4 else 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, t0 + datetime.timedelta(seconds=t)) for t in range(8)]
    schema = "run_id long, t int, x double, y double, z double, pitch double, roll double, yaw double, arrived_at timestamp"
    for k in range(2):
        spark.createDataFrame(rows[4 * k : 4 * k + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = frames.flagged_stream(s).writeStream.format("memory").queryName("flags").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.t: (r.fd, r.flagged) for r in spark.sql("select * from flags").collect()}
    assert set(got) == set(range(8)) and got[4] == (3.0, 1) and got[5] == (3.0, 1) and got[6] == (0.0, 1) and got[7] == (0.0, 0)


def test_unknown_arguments_are_errors(spark):
    with pytest.raises(job.JobError, match="unknown arguments frequency"):
        job.compile_job(JOB.replace('<arg name="sphere">1', '<arg name="frequency">1'), {})
    with pytest.raises(job.JobError, match="output.* is missing"):
        job.compile_job(JOB.replace('<arg name="output">seed</arg>', ""), {})


def test_masks_and_scrubbing(spark):
    import numpy as np
    from pyspark.sql import functions as F

    g = np.random.default_rng(0)
    img = spark.createDataFrame([("i", k, k % 2, k // 2, 0, t, float(g.normal())) for k in range(6) for t in range(16)], "image string, voxel long, x int, y int, z int, t int, v double")
    mask = spark.createDataFrame([(0, 0, 0, 1.0), (1, 0, 0, 0.5), (0, 1, 0, 0.05)], "x int, y int, z int, weight double")
    rp = spark.createDataFrame([(t, *([2.0 if t == 7 else 0.0] + [0.0] * 5)) for t in range(16)], "t int, " + ", ".join(f"c{i} double" for i in range(1, 7)))
    reg = spark.createDataFrame([(t, float(t), float(t * t % 7)) for t in range(16)], "t int, a double, b double")
    tasks = [
        job.Task("regression", "", {"input": ["img"], "regressors": ["reg"], "residuals": ["res"], "betas": ["betas"]}),
        job.Task("bandpass", "", {"input": ["res"], "filtered": ["fil"], "mask": ["m"], "TR": ["2"], "f1": ["0.05"], "f2": ["0.2"]}),
        job.Task("motionscrubbing", "", {"input": ["fil"], "rp": ["rp"], "mask": ["m"], "output": ["scr"], "flagged": ["fl"], "fd": ["fd"], "dvarsthreshold": ["99"]}),
        job.Task("timecourse", "", {"input": ["scr"], "mask": ["m"], "output": ["c"]}),
        job.Task("correlation", "", {"input": ["scr"], "regressor": ["c"], "mask": ["m"], "output": ["map"]}),
    ]
    out = job.compile_job(job.serialize({}, tasks), {"img": img, "m": mask, "rp": rp, "reg": reg})
    y = np.array([[r.v for r in img.where(f"voxel = {k}").orderBy("t").collect()] for k in range(6)]).T
    x = np.c_[np.ones(16), np.arange(16), np.arange(16) ** 2 % 7]
    want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    assert {(r.voxel, r.t): r.v for r in out["res"].collect()} == pytest.approx({(k, t): want[t, k] for k in range(6) for t in range(16)})
    assert {r.voxel for r in out["fil"].where(~F.isnan("v")).collect()} == {0, 1} and out["fil"].count() == 96
    assert {r.t for r in out["fl"].where("flagged = 1").collect()} == {6, 7, 8, 9}
    assert {r.t for r in out["scr"].collect()} == set(range(12))
    z = {r.voxel: r.value for r in out["map"].collect()}
    assert len(z) == 6 and not any(np.isnan([z[0], z[1]])) and all(np.isnan(z[k]) for k in range(2, 6))


def test_the_whole_pipeline(spark):
    import os

    from voxlake.plans import pipeline

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data here")
    assert len(job.parse(pipeline.full_job())[1]) == 12
    frames = job.compile_job(pipeline.full_job(), pipeline.inputs(spark, "/root/testdata/sf0.001"))
    assert len(frames["regressors"].columns) == 20  # t, three means, two times five components, six parameters
    got = frames["map"].toPandas()
    assert len(got) == 500 and got.value.abs().max() <= 19 and got.value.isna().any()
