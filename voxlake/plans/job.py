"""Declarative pipelines: a job of tasks compiled to one lazy plan.

A job is an XML document with parameters and an ordered list of tasks; every task names an operator, its
arguments and its output. ``${key}`` in an argument is replaced by the parameter (given, else of the job, else of
the settings); undefined names and cycles are errors before anything is planned. Tasks exchange DataFrames by
name. ``sql`` is a task too: a query over the outputs so far. There is no shell task.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import layouts, masks, motion, multivariate, spatial, temporal
from ..session import written

NAME = re.compile(r"\$\{([^${}]+)\}")


class JobError(ValueError):
    pass


@dataclass
class Task:
    code: str
    description: str = ""
    args: dict[str, list[str]] = field(default_factory=dict)

    def one(self, key: str, default: str | None = None) -> str:
        v = self.args.get(key)
        if not v:
            if default is None:
                raise JobError(f"task {self.code}: argument {key} is missing")
            return default
        return v[-1]

    def has(self, key: str) -> bool:
        return key in self.args


@dataclass
class Operator:
    code: str
    category: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    outputs: tuple[str, ...]
    plan: Callable[[dict[str, DataFrame], Task], DataFrame | dict[str, DataFrame]]


REGISTRY: dict[str, Operator] = {}


def operator(code: str, category: str, *needs: str, may: tuple[str, ...] = (), outputs: tuple[str, ...] = ("output",)):
    """Register a planning function under a code; a code stands for one operator only.

    ``needs`` and ``may`` are its arguments, ``outputs`` those that name a result, of which one is needed; any other is an
    error. The function gives the output, or several by the argument that names each; only those named are kept.
    """

    def add(f):
        if code in REGISTRY:
            raise JobError(f"operator {code} is registered twice")
        REGISTRY[code] = Operator(code, category, needs, may, outputs, f)
        return f

    return add


def parse(text: str) -> tuple[dict[str, str], list[Task]]:
    """Parameters and tasks of ``<job><parameters><param name>..</param></parameters><tasks><task code>..``.

    An argument with several lines stands for several values; one without text is a flag.
    """
    try:
        root = ET.fromstring(text)
    except ET.ParseError as e:
        raise JobError(f"no well-formed job: {e}") from e
    if root.tag != "job":
        raise JobError(f"expected <job>, found <{root.tag}>")
    params = {p.get("name", ""): (p.text or "").strip() for p in root.iterfind("./parameters/param")}
    tasks = []
    for t in root.iterfind("./tasks/task"):
        if not t.get("code"):
            raise JobError("a task without a code")
        task = Task(t.get("code"), (t.findtext("description") or "").strip())
        for a in t.iterfind("./args/arg"):
            task.args.setdefault(a.get("name", ""), []).extend([s.strip() for s in (a.text or "").strip().splitlines()] or [""])
        tasks.append(task)
    return params, tasks


def serialize(params: dict[str, str], tasks: list[Task]) -> str:
    """The XML of :func:`parse`."""
    root = ET.Element("job")
    ps = ET.SubElement(root, "parameters")
    for k, v in params.items():
        ET.SubElement(ps, "param", name=k).text = v
    ts = ET.SubElement(root, "tasks")
    for t in tasks:
        e = ET.SubElement(ts, "task", code=t.code)
        ET.SubElement(e, "description").text = t.description
        args = ET.SubElement(e, "args")
        for k, v in t.args.items():
            ET.SubElement(args, "arg", name=k).text = "\n".join(v)
    return ET.tostring(root, encoding="unicode")


def resolved(params: dict[str, str]) -> dict[str, str]:
    """Parameters with all references replaced; cycles are an error, undefined names stay."""
    out: dict[str, str] = {}

    def value(key: str, above: tuple[str, ...]) -> str:
        if key in above:
            raise JobError("parameters refer to each other: " + " -> ".join([*above, key]))
        if key not in out:
            out[key] = NAME.sub(lambda m: value(m[1], (*above, key)) if m[1] in params else m[0], params[key])
        return out[key]

    for k in params:
        value(k, ())
    return out


def substituted(tasks: list[Task], params: dict[str, str]) -> list[Task]:
    """Tasks with references replaced; all undefined names are reported together."""
    params = resolved(params)
    missing: dict[str, None] = {}

    def one(m: re.Match) -> str:
        if m[1] not in params or NAME.search(params[m[1]]):
            missing.update(dict.fromkeys([m[1], *NAME.findall(params.get(m[1], ""))] if m[1] not in params else NAME.findall(params[m[1]])))
            return m[0]
        return params[m[1]]

    out = [Task(t.code, t.description, {k: [NAME.sub(one, v) for v in vs] for k, vs in t.args.items()}) for t in tasks]
    if missing:
        raise JobError("undefined parameters: " + ", ".join(missing))
    return out


def skipped(spec: str) -> set[int]:
    """Task numbers of ``1,4-7``, counted from 1."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in spec.split(","))):
        a, _, b = part.partition("-")
        if not a.isdigit() or (b and not b.isdigit()):
            raise JobError(f"no task range: {part}")
        out.update(range(int(a), int(b or a) + 1))
    return out


def compile_job(text: str, inputs: dict[str, DataFrame], given: dict[str, str] | None = None, config: dict[str, str] | None = None, skip: str = "") -> dict[str, DataFrame]:
    """All named outputs of a job. Every task is checked before the first is planned; an output that one task reads at most
    stays lazy and becomes part of its plan, others are written once."""
    params, tasks = parse(text)
    tasks = substituted(tasks, {**(config or {}), **params, **(given or {})})
    leave = skipped(skip)
    tasks = [t for i, t in enumerate(tasks, 1) if i not in leave]
    for t in tasks:
        if t.code not in REGISTRY:
            raise JobError(f"unknown operator {t.code}; known: {', '.join(sorted(REGISTRY))}")
        op = REGISTRY[t.code]
        for need in op.needs:
            t.one(need)
        if not any(t.args.get(k) for k in op.outputs):
            raise JobError(f"task {t.code}: argument {' or '.join(op.outputs)} is missing")
        known = {*op.needs, *op.may, *op.outputs}
        strange = [k for k in t.args if k not in known]
        if strange:
            raise JobError(f"task {t.code}: unknown arguments {', '.join(strange)}; known: {', '.join(sorted(known))}")
    frames = dict(inputs)
    for i, t in enumerate(tasks):
        made = REGISTRY[t.code].plan(frames, t)
        for key, df in (made if isinstance(made, dict) else {"output": made}).items():
            if t.has(key):
                name = t.one(key)
                # What several tasks read is computed once, as a table in the shared folder.
                readers = sum(name in [*vs, *re.findall(r"\{(\w+)\}", " ".join(vs))] for u in tasks[i + 1 :] for vs in u.args.values())
                frames[name] = written(df, f"job-{name}") if readers > 1 else df
    return frames


def overview(text: str, given: dict[str, str] | None = None, config: dict[str, str] | None = None) -> list[str]:
    """One line per task: number, operator, arguments."""
    params, tasks = parse(text)
    tasks = substituted(tasks, {**(config or {}), **params, **(given or {})})
    return [f"{i}. {t.code}: {t.description or '-'} ({', '.join(f'{k}={chr(124).join(v)}' if any(v) else k for k, v in t.args.items())})" for i, t in enumerate(tasks, 1)]


def frame(frames: dict[str, DataFrame], name: str) -> DataFrame:
    if name not in frames:
        raise JobError(f"no output named {name}")
    return frames[name]


@operator("mask", "ROI", "input", "mask")
def _mask(fr, t):
    return masks.apply(frame(fr, t.one("input")), frame(fr, t.one("mask")))


@operator("roi", "ROI", "input", "center", may=("sphere", "cube", "value"), outputs=("output", "mask"))
def _roi(fr, t):
    """``mask`` is another name of the output."""
    center = tuple(float(v) for v in re.split(r"[,\s]+", t.one("center")))
    sphere = float(t.one("sphere")) if t.has("sphere") else None
    cube = tuple(float(v) for v in re.split(r"[,\s]+", t.one("cube"))) if t.has("cube") else None
    cells = frame(fr, t.one("input")).where("t = 0").select("x", "y", "z", "v")
    out = masks.region(cells, center, sphere, cube, float(t.one("value", "1"))).withColumnRenamed("v", "weight")
    return {"output": out, "mask": out}


def _mask_of(fr, t) -> DataFrame | None:
    return frame(fr, t.one("mask")) if t.has("mask") else None


def _frames(df: DataFrame) -> int:
    """Number of frames of an image."""
    return int(df.agg(F.max("t")).first()[0]) + 1


def _wide(spark, c: multivariate.Components) -> DataFrame:
    """Courses of components as columns: t, r1, r2, ..."""
    rows = [(i, *map(float, r)) for i, r in enumerate(c.vectors)]
    return spark.createDataFrame(rows, "t int, " + ", ".join(f"r{k + 1} double" for k in range(c.vectors.shape[1])))


@operator("timecourse", "Temporal", "input", "mask", may=("algorithm", "retainComponents", "minVariance", "useStandardScores", "mask2"), outputs=("output", "spatialMap", "eigenvalues"))
def _timecourse(fr, t):
    """Mean or deviation (t, value), or components as columns (t, r1, ...), their maps and eigenvalues."""
    src, how = frame(fr, t.one("input")), t.one("algorithm", "mean")
    s = masks.select(src, frame(fr, t.one("mask")))
    s = s.join(masks.clean(s), "voxel", "left_semi")  # without voxels left out before
    if how in ("mean", "stddev"):
        return {"mean": temporal.mean_course, "stddev": temporal.stddev_course}[how](s)
    spark, n = src.sparkSession, _frames(src)
    keep, variance = int(t.one("retainComponents", "0")), float(t.one("minVariance", "0"))
    series = layouts.series_from_long(s)
    if how == "tpca":
        c, maps = multivariate.temporal_pca(series, n, keep, variance, t.has("useStandardScores"))
    elif how == "spca":
        c, maps = multivariate.spatial_pca(series, n, keep, variance)
    elif how == "csp":
        c, maps = multivariate.common_spatial_patterns(series, layouts.series_from_long(masks.select(src, frame(fr, t.one("mask2")))), n, keep or None), None
    else:
        raise JobError(f"task timecourse: no algorithm {how}")
    out = {"output": _wide(spark, c), "eigenvalues": multivariate.eigenvalues(spark, c)}
    return out if maps is None else {**out, "spatialMap": maps}


@operator("paste", "Util", "inputs")
def _paste(fr, t):
    """Columns of several tables (t and any others) side by side by frame: t, r1, r2, ..."""
    out, k = None, 0
    for name in t.args["inputs"]:
        df = frame(fr, name)
        cols = [c for c in df.columns if c != "t"]
        df = df.select("t", *[F.col(c).cast("double").alias(f"r{k + i + 1}") for i, c in enumerate(cols)])
        k += len(cols)
        out = df if out is None else out.join(df, "t")
    return out


@operator("correlation", "Temporal", "input", "regressor", may=("mask", "conversion", "delay", "length"))
def _correlation(fr, t):
    src = frame(fr, t.one("input"))
    length = int(t.one("length")) if t.has("length") else None
    inside = masks.within(src, _mask_of(fr, t))
    out = temporal.correlate(inside, frame(fr, t.one("regressor")), t.one("conversion", "z"), int(t.one("delay", "0")), length)
    return masks.skipped(out, src.select("voxel").distinct(), ["voxel"], "value") if t.has("mask") else out


def _design(df: DataFrame):
    """Regressors (t and columns) as a matrix of frames x columns; one row per frame, so it fits the driver."""
    cols = [c for c in df.columns if c != "t"]
    rows = df.orderBy("t").limit(multivariate.MAX_FRAMES + 1).toPandas()
    if len(rows) > multivariate.MAX_FRAMES:
        raise JobError(f"more than {multivariate.MAX_FRAMES} frames of regressors")
    return rows[cols].to_numpy(float)


@operator("regression", "Temporal", "input", may=("regressor", "regressors", "mask", "zscore"), outputs=("output", "residuals", "fitted", "betas"))
def _regression(fr, t):
    """Least squares with intercept on one regressor or the columns of a table; outside a mask NaN."""
    if t.has("regressor") == t.has("regressors"):
        raise JobError("task regression: one of regressor and regressors is needed")
    src = frame(fr, t.one("input"))
    design = _design(frame(fr, t.one("regressors" if t.has("regressors") else "regressor")))
    series = masks.within(layouts.series_from_long(src), _mask_of(fr, t))

    def made(what: str) -> DataFrame:
        df = layouts.long_from_series(temporal.multiple_regression(series, design, what, t.has("zscore")))
        return masks.skipped(df, src, [c for c in src.columns if c != "v"], "v") if t.has("mask") and what != "betas" else df

    res = made("residual")
    return {"output": res, "residuals": res, **{k: made(k) for k in ("fitted", "betas") if t.has(k)}}


@operator("bandpass", "Temporal", "input", "TR", "f1", "f2", may=("frames", "keepMean", "mask", "rolloff"), outputs=("output", "filtered"))
def _bandpass(fr, t):
    src = frame(fr, t.one("input"))
    n = int(t.one("frames")) if t.has("frames") else _frames(src)
    s = masks.within(layouts.series_from_long(src), _mask_of(fr, t))
    rolloff = float(t.one("rolloff")) if t.has("rolloff") else None
    out = layouts.long_from_series(temporal.bandpass_fft(s, n, float(t.one("TR")), float(t.one("f1")), float(t.one("f2")), t.has("keepMean"), rolloff))
    if t.has("mask"):
        out = masks.skipped(out, src, [c for c in src.columns if c != "v"], "v")
    return {"output": out, "filtered": out}


@operator("scrubbing", "Artifacts", "input", "flagged")
def _scrubbing(fr, t):
    """Listed frames out; a list without an image counts for all images."""
    src, flagged = frame(fr, t.one("input")), frame(fr, t.one("flagged"))
    if "flagged" in flagged.columns:
        flagged = flagged.where("flagged = 1")
    if "image" in src.columns:
        return motion.scrub(src, flagged, ["image"])
    return motion.scrub(src.withColumn("_k", F.lit(0)), flagged, ["_k"]).drop("_k")


@operator("motionscrubbing", "Artifacts", may=("metrics", "keys", "input", "rp", "rpformat", "mask", "usemodal", "fdthreshold", "dvarsthreshold"), outputs=("output", "fd", "dvars", "flagged"))
def _motion_scrubbing(fr, t):
    """An image and its realignment parameters to the scrubbed image, its metrics and flags; or flagged frames of ready metrics."""
    limits = float(t.one("fdthreshold", "1.0")), float(t.one("dvarsthreshold", "0.05"))
    if t.has("metrics"):
        keys = [k for k in t.args.get("keys", []) if k]
        m = frame(fr, t.one("metrics"))
        m = m if keys else m.withColumn("_k", F.lit(0))
        return motion.flagged(m, keys or ["_k"], *limits).where("flagged = 1").drop("_k", "flagged")
    image, rp = frame(fr, t.one("input")), frame(fr, t.one("rp"))
    made = motion.motion_scrubbing(image, rp, _mask_of(fr, t), t.one("rpformat", "spm"), *limits, t.has("usemodal"))
    return {"output": made["scrubbed"], **{k: made[k] for k in ("fd", "dvars", "flagged")}}


@operator("smoothing", "Spatial", "input", "kernelSize", "sizes")
def _smoothing(fr, t):
    sizes = tuple(float(v) for v in t.one("sizes").split(","))
    return spatial.smooth(frame(fr, t.one("input")).select("t", "x", "y", "z", "v"), float(t.one("kernelSize")), sizes)


@operator("orientation", "Spatial", "input", "from", "orientation", "dims")
def _orientation(fr, t):
    dims = tuple(int(v) for v in t.one("dims").split(","))
    return spatial.reorient(frame(fr, t.one("input")), dims, t.one("from"), t.one("orientation"))


@operator("sql", "Util", "query")
def _sql(fr, t):
    spark = SparkSession.getActiveSession()
    return spark.sql(" ".join(t.args["query"]), **{k: v for k, v in fr.items() if "{" + k + "}" in " ".join(t.args["query"])})
