"""Queries of the operators over the run and header tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import affine
from ..operators import header, layouts, motion, spatial, transform, units
from ..session import table
from . import voxels


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """run_id, t, x, y, z (mm), pitch, roll, yaw (degrees): frames of all runs, numbers or text, the first copy of a repeated frame.

    The column order is the one the run's rpformat names, spm where it names none. Units written beside the values
    count, else translations are mm and rotations degrees (radians in the order of fsl).
    """
    v = units.numbers(table(spark, d, "realignment")).groupBy("run_id", "t").agg(F.min(F.struct("arrived_at", "v", "u1", "u4")).alias("r"))
    said = table(spark, d, "scrub_run").groupBy("run_id").agg(F.max("rpformat").alias("rpformat"))
    j = v.join(said, "run_id", "left").select("run_id", "t", "r.v", "r.u1", "r.u4", units.is_fsl(F.col("rpformat")).alias("fsl"))
    pick = lambda a, b: F.when(F.col("fsl"), b).otherwise(a)

    def scale(unit, words, sizes, usual):
        named = units.text_unit(unit, words)
        return F.coalesce(*[F.when(named == u, F.lit(s)) for u, s in sizes.items()], usual)

    u1, u4 = F.col("u1"), F.col("u4")
    st = scale(pick(u1, u4), units.TRANSLATION_WORDS, units.TRANSLATION, F.lit(1.0))
    sr = scale(pick(u4, u1), units.ROTATION_WORDS, units.ROTATION, pick(F.lit(1.0), F.lit(units.ROTATION["rad"])))
    at = lambda i: pick(F.col("v")[i], F.col("v")[(i + 3) % 6])
    return j.select(
        "run_id", "t", *[(at(i) * st).alias(n) for i, n in enumerate("xyz")],
        *[(at(i + 3) * sr).alias(n) for i, n in enumerate(("pitch", "roll", "yaw"))],
    )


def run_fd(spark, d):
    """Framewise displacement of every run by its own column order."""
    f = motion.framewise_displacement(_runs(spark, d), ["run_id"])
    return f.select("run_id", "t", F.when(F.abs("fd") < 1e6, F.round("fd", 8) + 0.0).alias("fd"))


def _metrics(spark, d):
    m = table(spark, d, "motion_metric")
    v = F.struct("arrived_at", "fd", "dvars")
    return m.groupBy("run_id", "t").agg(F.min(v).alias("v")).select("run_id", "t", "v.fd", "v.dvars")


def run_flags(spark, d):
    """Flagged frames of every run by default thresholds."""
    f = motion.flagged(_metrics(spark, d), ["run_id"])
    return f.where("flagged = 1").select("run_id", "t")


def run_frame_map(spark, d):
    """Dense numbers of the frames that stay after scrubbing."""
    return motion.frame_map(motion.flagged(_metrics(spark, d), ["run_id"]), ["run_id"])


def header_lookup(spark, d):
    return header.lookup(table(spark, d, "headerinfo"), "ProtocolName")


def header_entries(spark, d):
    fields = ["manufacturermodelname", "magneticfieldstrength", "echotime", "dicom_rows"]
    return header.entries(table(spark, d, "headerinfo"), fields)


def header_latest(spark, d):
    return header.latest(table(spark, d, "headerinfo"), ["image"]).select("image", "header_id", "seriesnumber")


def header_tr(spark, d):
    return header.repetition_seconds(table(spark, d, "headerinfo")).select("header_id", F.round("tr", 6).alias("tr"))


def header_dwell(spark, d):
    return header.dwell_times(table(spark, d, "headerinfo")).select("header_id", F.round("dwell", 9).alias("dwell"))


def header_set(spark, d):
    h = header.with_values(table(spark, d, "headerinfo"), ["PatientPosition=HFS", "seriesnumber=7"])
    return h.select("header_id", "patientposition", "seriesnumber")


def header_scaling(spark, d):
    """Raw values 0 and 100 of every image scaled by its header."""
    h = table(spark, d, "image_header")
    s, i = F.col("slope").cast("double"), F.col("inter").cast("double")
    return h.select("image", F.round(layouts.scaled(F.lit(0), s, i), 4).alias("zero"), F.round(layouts.scaled(F.lit(100), s, i), 4).alias("hundred"))


def stored_values(spark, d):
    """A value stored as a short by every image's scaling: truncated, null where it does not fit."""
    h = table(spark, d, "image_header")
    s, i = F.col("slope").cast("double"), F.col("inter").cast("double")
    return h.select("image", layouts.stored(F.lit(1234.56), s, i, "smallint").cast("int").alias("raw"))


def deoblique(spark, d):
    """A tilted image on a straight grid."""
    a = np.deg2rad(10)
    m = np.eye(4)
    m[:3, :3] = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]]) * 3.0
    cells, _, _ = transform.deoblique(voxels._cells(spark, d), m, voxels._dims(spark, d))
    return voxels.rounded(cells, "v")


def transform_chain(spark, d):
    """Two affine steps and a factor in one interpolation."""
    shift, turn = np.eye(4), np.eye(4)
    shift[:3, 3] = (1.5, 0, -3.0)
    a = np.deg2rad(5)
    turn[:2, :2] = [[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]
    grid = np.diag([3.0, 3, 3, 1])
    cells, dims = voxels._cells(spark, d), voxels._dims(spark, d)
    factor = spatial.grid_cells(spark, dims).withColumn("v", F.lit(2.0))
    out = transform.transformed(cells, grid, grid, dims, [("affine", shift), ("affine", turn), ("mult", factor)], default=0.0)
    return voxels.rounded(out, "v")


def fugue_warp(spark, d):
    """Shifts along the phase-encoding direction as a field, applied."""
    cells, dims = voxels._cells(spark, d), voxels._dims(spark, d)
    field = transform.shift_field(spatial.grid_cells(spark, dims).withColumn("v", F.lit(1.0)), "y-")
    grid = np.diag([3.0, 3, 3, 1])
    out = transform.transformed(cells, grid, grid, dims, [("warp", field)])
    return voxels.rounded(out, "v")


def itk_matrix(spark, d):
    """A registration matrix in the convention of another tool, entry by entry."""
    m = np.eye(4)
    m[:3, 3] = (1.0, 2.0, 3.0)
    grid = np.diag([3.0, 3, 3, 1])
    out = affine.itk_from_flirt(m, grid, (3, 3, 3, 8), grid, (3, 3, 3, 8))
    return spark.createDataFrame([(i, j, round(float(out[i, j]), 6) + 0.0) for i in range(4) for j in range(4)], "i int, j int, value double")


NAMES = """run_fd run_flags run_frame_map header_lookup header_entries header_latest header_tr header_dwell header_set header_scaling stored_values
deoblique transform_chain fugue_warp itk_matrix""".split()
QUERIES = {n: globals()[n] for n in NAMES}

_MM = "m AS (SELECT run_id, t, v.fd AS fd, v.dvars AS dv FROM (SELECT run_id, t, arg_min({'fd': fd, 'dvars': dvars}, arrived_at) AS v FROM motion_metric GROUP BY run_id, t))"
_FL = f"""{_MM}, fl AS (SELECT run_id, t, max(bad) OVER (PARTITION BY run_id ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS flagged
  FROM (SELECT run_id, t, CASE WHEN t >= 1 AND (coalesce(fd > 1.0 AND NOT isnan(fd), false) OR coalesce(dv > 0.05 AND NOT isnan(dv), false)) THEN 1 ELSE 0 END AS bad FROM m))"""
#: Frames of all runs in mm and degrees: numbers or text, in the order of rpformat, first copies.
_TEXT = r"(?:^|[,|\s=])([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*([^\s,|=0-9+.-][^\s,|=]*)"
_T_UNIT = r"""CASE WHEN {u} = 'm' THEN 1000.0 WHEN regexp_matches({u}, 'µm|μm|\bum\b|micromet|micron') THEN 0.001
  WHEN regexp_matches({u}, '\bcm\b|centimet|zentimet') THEN 10.0 WHEN regexp_matches({u}, '\binch') THEN 25.4
  WHEN regexp_matches({u}, '\bmet(re|er)s?\b|\bmètres?\b|\[m\]|\(m\)') THEN 1000.0 ELSE 1.0 END"""
_R_UNIT = r"""CASE WHEN {u} IN ('''', '′') THEN 1.0 / 60 WHEN regexp_matches({u}, '\bmrad\b|milliradian') THEN degrees(0.001)
  WHEN regexp_matches({u}, '\barcmin|bogenminute') THEN 1.0 / 60 WHEN regexp_matches({u}, '\brad\b|\bradian|bogenmaß') THEN degrees(1)
  WHEN regexp_matches({u}, '\bdeg\b|\bdegree|\bgrad\b|°') THEN 1.0 WHEN fsl THEN degrees(1) ELSE 1.0 END"""
_FRAMES = f"""n AS (SELECT run_id, t, arrived_at,
    CASE WHEN rp_text IS NULL THEN [c1, c2, c3, c4, c5, c6] ELSE list_transform(regexp_extract_all(rp_text, '{_TEXT}', 1), lambda s: try_cast(s AS DOUBLE)) END AS v,
    CASE WHEN rp_text IS NOT NULL THEN regexp_extract_all(rp_text, '{_TEXT}', 2) END AS u FROM realignment WHERE run_id IS NOT NULL AND t IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY run_id, t ORDER BY arrived_at NULLS FIRST, v) AS k FROM n WHERE len(v) = 6),
  said AS (SELECT run_id, max(rpformat) AS f FROM scrub_run GROUP BY run_id),
  o AS (SELECT k.*, coalesce(contains(lower(f), 'fsl') OR contains(lower(f), 'mcflirt'), false) AS fsl FROM k LEFT JOIN said USING (run_id) WHERE k = 1),
  p AS (SELECT run_id, t, fsl, CASE WHEN fsl THEN v[4:6] ELSE v[1:3] END AS tr, CASE WHEN fsl THEN v[1:3] ELSE v[4:6] END AS ro,
    lower(CASE WHEN fsl THEN u[4] ELSE u[1] END) AS ut, lower(CASE WHEN fsl THEN u[1] ELSE u[4] END) AS ur FROM o),
  fr AS (SELECT run_id, t, {", ".join(f"tr[{i + 1}] * ({_T_UNIT.format(u='ut')}) AS {c}" for i, c in enumerate("xyz"))},
    {", ".join(f"ro[{i + 1}] * ({_R_UNIT.format(u='ur')}) AS {c}" for i, c in enumerate("abc"))} FROM p)"""
_D = lambda c: f"abs({c} - lag({c}) OVER w)"

ORACLE = {
    "run_fd": f"WITH {_FRAMES}, q AS (SELECT run_id, t, coalesce({_D('x')} + {_D('y')} + {_D('z')} + ({_D('a')} + {_D('b')} + {_D('c')}) * 3.141592653589793 * 50 / 180, 0) AS fd "
    "FROM fr WINDOW w AS (PARTITION BY run_id ORDER BY t)) SELECT run_id, t, CASE WHEN abs(fd) < 1e6 THEN round(fd, 8) + 0.0 END AS fd FROM q",
    "run_flags": f"WITH {_FL} SELECT run_id, t FROM fl WHERE flagged = 1",
    "run_frame_map": f"WITH {_FL} SELECT run_id, t, row_number() OVER (PARTITION BY run_id ORDER BY t) - 1 AS new_t FROM fl WHERE flagged = 0",
    "header_lookup": "SELECT image, protocolname AS value FROM (SELECT image, protocolname, row_number() OVER (PARTITION BY image ORDER BY loaded_at DESC, header_id DESC) AS k FROM headerinfo) WHERE k = 1",
    "header_entries": "SELECT header_id, key, value FROM (SELECT header_id, unnest([{'key': 'manufacturermodelname', 'value': manufacturermodelname}, {'key': 'magneticfieldstrength', 'value': magneticfieldstrength}, "
    "{'key': 'echotime', 'value': echotime}, {'key': 'dicom_rows', 'value': CAST(dicom_rows AS VARCHAR)}], recursive := true) FROM headerinfo) WHERE value IS NOT NULL AND value <> ''",
    "header_latest": "SELECT image, header_id, seriesnumber FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY loaded_at DESC, header_id DESC) AS k FROM headerinfo) WHERE k = 1",
    "header_tr": "SELECT header_id, round(CASE WHEN v >= 20 THEN v / 1000 WHEN v > 0 THEN v END, 6) AS tr FROM (SELECT header_id, try_cast(repetitiontime AS DOUBLE) AS v FROM headerinfo)",
    "header_dwell": "SELECT header_id, round(CASE WHEN n > 0 AND b > 0 THEN 1 / (n * b) END, 9) AS dwell FROM (SELECT header_id, try_cast(phaseencodinglines AS DOUBLE) AS n, bandwidthperpixelphaseencode AS b FROM headerinfo)",
    "header_set": "SELECT header_id, 'HFS' AS patientposition, '7' AS seriesnumber FROM headerinfo",
    "header_scaling": "SELECT image, round(CASE WHEN slope = 0 THEN 0 ELSE CAST(inter AS DOUBLE) END, 4) AS zero, round(CASE WHEN slope = 0 THEN 100 ELSE 100 * CAST(slope AS DOUBLE) + CAST(inter AS DOUBLE) END, 4) AS hundred FROM image_header",
    "stored_values": "SELECT image, CASE WHEN r > -32769 AND r < 32768 THEN CAST(trunc(r) AS INTEGER) END AS raw FROM (SELECT image, CASE WHEN slope = 0 THEN 1234.56::DOUBLE ELSE (1234.56::DOUBLE - CAST(inter AS DOUBLE)) / CAST(slope AS DOUBLE) END AS r FROM image_header)",
    # Closed form: in scaled mm x runs backwards, in world space x and y do, so of the inverse shift (-1, -2, -3) only y turns its sign.
    "itk_matrix": "SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i = j THEN 1.0::DOUBLE WHEN j = 3 THEN CAST([-1, 2, -3][i + 1] AS DOUBLE) ELSE 0.0 END AS value FROM range(4) a(i), range(4) b(j)",
}
