"""Whole pipelines as jobs over the test tables: nuisance regression, band-pass, scrubbing and a seed correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import job, voxels
from .voxels_sql import PEARSON, fisher, kernel, r, seed, w

PARAMETERS = {"frames": "64", "TR": "2.0", "freqLow": "0.009", "freqHigh": "0.08", "seed": "3,3,3", "fdthreshold": "0.065", "dvarsthreshold": "0.09"}


def _task(code: str, **args: str) -> job.Task:
    return job.Task(code, "", {k.rstrip("_"): v.split("\n") for k, v in args.items()})


def _rest(regressors: str) -> list[job.Task]:
    """From regression to the correlation map."""
    return [
        _task("regression", input="image", regressors=regressors, residuals="regressed"),
        _task("bandpass", input="regressed", filtered="filtered", mask="brain", frames="${frames}", TR="${TR}", f1="${freqLow}", f2="${freqHigh}"),
        _task("motionscrubbing", input="filtered", rp="rp", mask="brain", output="scrubbed", fd="fd", dvars="dvars", fdthreshold="${fdthreshold}", dvarsthreshold="${dvarsthreshold}"),
        _task("roi", input="scrubbed", mask="region", center="${seed}", sphere="2"),
        _task("timecourse", input="scrubbed", mask="region", output="course"),
        _task("correlation", input="scrubbed", regressor="course", mask="brain", conversion="z", output="map"),
    ]


def full_job() -> str:
    """Twelve tasks: mean signals and components of two tissues, all pasted to the realignment parameters."""
    parts = {"algorithm": "tpca", "retainComponents": "5", "useStandardScores": ""}
    first = [
        _task("timecourse", input="image", mask="brain", output="global"),
        _task("timecourse", input="image", mask="csf", output="csfMean"),
        _task("timecourse", input="image", mask="wm", output="wmMean"),
        _task("timecourse", input="image", mask="csf", output="csfParts", **parts),
        _task("timecourse", input="image", mask="wm", output="wmParts", **parts),
        _task("paste", inputs="global\ncsfMean\ncsfParts\nwmMean\nwmParts\nrp", output="regressors"),
    ]
    return job.serialize(PARAMETERS, first + _rest("regressors"))


def short_job() -> str:
    """The same with the mean signals of the brain and one tissue only."""
    first = [
        _task("timecourse", input="image", mask="brain", output="global"),
        _task("timecourse", input="image", mask="wm", output="wmMean"),
        _task("paste", inputs="global\nwmMean", output="regressors"),
    ]
    return job.serialize(PARAMETERS, first + _rest("regressors"))


def inputs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The image, masks of it, and realignment parameters made of six of its series."""
    image = voxels.image(spark, d)
    long = voxels.long(spark, d).select("image", "voxel", "x", "y", "z", "t", "v")
    mask = lambda c: image.select("x", "y", "z", F.when(c, 1.0).otherwise(0.0).alias("weight"))
    six = long.where("voxel < 6").groupBy("t").pivot("voxel", list(range(6))).agg(F.first("v"))
    rp = six.select("t", *[(F.col(str(i)) * 0.05).alias(f"c{i + 1}") for i in range(6)])
    label = F.col("label")
    return {"image": long, "brain": mask(label != 9), "csf": mask(label == 2), "wm": mask(label == 7), "rp": rp}


def job_dmn(spark: SparkSession, d: str) -> DataFrame:
    """Map of the full job."""
    return voxels.rounded(job.compile_job(full_job(), inputs(spark, d))["map"], "value")


def job_seed(spark: SparkSession, d: str) -> DataFrame:
    """Map of the short job."""
    return voxels.rounded(job.compile_job(short_job(), inputs(spark, d))["map"], "value")


QUERIES = {"job_dmn": job_dmn, "job_seed": job_seed}

_STEP = " + ".join(f"abs(c{i} - lag(c{i}) OVER (ORDER BY t)){' * 3.141592653589793 * 50 / 180' if i > 3 else ''}" for i in range(1, 7))
ORACLE = {
    "job_seed": w(
        f"SELECT e.voxel, CASE WHEN c IS NOT NULL THEN {r(fisher('c'))} END AS value FROM e LEFT JOIN k USING (voxel)",
        "s AS (SELECT t, avg(v) AS value FROM l WHERE label <> 9 GROUP BY t)", seed(7, "s7"),
        "p AS (SELECT voxel, t, v, s.value AS u, s7.value AS q FROM l JOIN s USING (t) JOIN s7 USING (t))",
        "c2 AS (SELECT voxel, covar_samp(u, u) AS uu, covar_samp(q, q) AS qq, covar_samp(u, q) AS uq, covar_samp(u, v) AS uv, covar_samp(q, v) AS qv, avg(v) AS mv, avg(u) AS mu, avg(q) AS mq FROM p GROUP BY voxel)",
        "b AS (SELECT voxel, mv, mu, mq, (qq * uv - uq * qv) / (uu * qq - uq * uq) AS b1, (uu * qv - uq * uv) / (uu * qq - uq * uq) AS b2 FROM c2)",
        "res AS (SELECT voxel, t, v - mv - b1 * (u - mu) - b2 * (q - mq) AS v FROM p JOIN b USING (voxel) JOIN e USING (voxel) WHERE label <> 9)",
        *kernel(1, 11, False, "res"),
        "rp AS (SELECT t, " + ", ".join(f"max(v) FILTER (voxel = {i}) * 0.05 AS c{i + 1}" for i in range(6)) + " FROM l WHERE voxel < 6 GROUP BY t)",
        f"fd AS (SELECT t, coalesce({_STEP}, 0) AS fd FROM rp)",
        "rg AS (SELECT min(v) AS lo, max(v) AS hi FROM f WHERE t >= 5)",
        "ch AS (SELECT t, (v - lag(v) OVER (PARTITION BY voxel ORDER BY t)) / (SELECT nullif(hi - lo, 0) FROM rg) AS d FROM f)",
        "dv AS (SELECT t, coalesce(sqrt(avg(d * d)), 0) AS dv FROM ch GROUP BY t)",
        f"fl AS (SELECT t, max(bad) OVER (ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS flagged FROM (SELECT t, CASE WHEN t >= 1 AND (fd > {PARAMETERS['fdthreshold']} OR dv > {PARAMETERS['dvarsthreshold']}) THEN 1 ELSE 0 END AS bad FROM dv JOIN fd USING (t)))",
        "sc AS (SELECT f.voxel, x, y, z, f.t, f.v FROM f JOIN fl ON f.t = fl.t AND flagged = 0 JOIN e USING (voxel))",
        "co AS (SELECT t, avg(v) AS value FROM sc WHERE sqrt(pow(x - 3, 2) + pow(y - 3, 2) + pow(z - 3, 2)) <= 2 GROUP BY t)",
        f"k AS (SELECT voxel, {PEARSON} AS c FROM (SELECT voxel, v, co.value AS sv FROM sc JOIN co USING (t)) GROUP BY voxel)",
    ),
}
