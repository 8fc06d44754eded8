"""Quantities recorded in different units: the six motion parameters of a run to mm and degrees.

A run is recorded by two sources, its realignment file (unknown units) and its displacement file (always mm),
which are linked by (run, frame). The displacement of a frame is ``A * sum |d first three| + B * sum |d last
three| + offset``: scales and offset of the pair of sources are estimated per run by least absolute deviations over
the linked frames, frames that jump set aside. A scale is snapped to the nearest known conversion (mm per unit of
translation, mm on a 50 mm sphere per unit of rotation) if it lies within ``SNAP`` of it; a scale that is well
determined but near none is an unknown unit, not the nearest guess.

Units that the run's own text names (in the lines or the note) come before estimates. What is then still open is
propagated through the graph of sources: runs are joined by a common image, subject or site, and the typical change
between frames of the settled runs at the other end, in mm or degrees, against the run's own gives its pairwise
scale, snapped likewise. Edges are followed from the strongest kind to the weakest, the whole population last. As
the kinds are nested (an image has one subject, a subject one site), one step per kind reaches the fixed point.

Both sources are shuffled once, by run and block of frames, so a hot site does not matter, nor a run that holds a
third of all rows: its blocks are estimated each and the median of their scales counts.

Defined cases: null and NaN readings take no part; a repeated (run, frame) keeps its latest arrival; a run
with neither displacements, words nor any change of value counts as mm and degrees; a null order is spm; runs
that are missing from the table of runs have no words, image or site.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import written

#: mm per unit; cm and inch occur only where written down.
TRANSLATION = {"mm": 1.0, "um": 0.001, "m": 1000.0, "cm": 10.0, "inch": 25.4}
#: degrees per unit; arcmin occurs only where written down.
ROTATION = {"deg": 1.0, "rad": 180 / math.pi, "mrad": 0.18 / math.pi, "arcmin": 1 / 60}
INFERABLE = ("mm", "um", "m", "deg", "rad", "mrad")
MM_PER_DEGREE = math.pi * 50 / 180
#: Frames of a run that stay together; an ordinary run has a few hundred.
BLOCK = 4096
#: Largest distance, as a logarithm, of an estimated scale from the conversion it is snapped to.
SNAP = 0.25
#: Linked frames that an estimate takes at least, and the median residual, as a share of the median displacement, that it may leave.
LEAST, MOST_RESIDUAL = 6, 0.25
#: Frames that move more than this many times the median are set aside.
JUMP = 5.0
ROUNDS = 25
UNKNOWN = "unknown"

#: Patterns of unit words, tried on lower-case text from which the settings that look alike are removed.
TRANSLATION_WORDS = {
    "um": r"(µm|μm|\bum\b|micromet|micron)", "cm": r"(\bcm\b|centimet|zentimet)", "inch": r"\binch",
    "mm": r"(\bmm\b|millimet)", "m": r"(\bsi \(m\)|\bmet(re|er)s?\b|\bmètres?\b|\[m\]|\(m\)|\bin m\b)",
}
ROTATION_WORDS = {
    "mrad": r"(\bmrad\b|milliradian)", "arcmin": r"(\barcmin|minutes? of arc|bogenminute)",
    "rad": r"(\brad\b|\bradian|bogenmaß)", "deg": r"(\bdeg\b|\bdegree|\bgrad\b|°)",
}
#: Settings in which a unit word says nothing about the file's own units.
OTHER_SETTINGS = r"(voxel size [0-9.]+ ?mm|field of view [0-9.]+ ?cm|fov [0-9.]+ ?cm|warped by [0-9.]+ ?rad( max phase)?|smoothed [0-9.]+ ?cm( fwhm)?)"
#: A value of a text line: optional label, number, unit.
TEXT_VALUE = r"(?:^|[,|\s=])([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*([^\s,|=0-9+.-][^\s,|=]*)"


def _words(text: Column, words: dict[str, str]) -> Column:
    clean = F.regexp_replace(F.lower(text), OTHER_SETTINGS, " ")
    return F.coalesce(*[F.when(clean.rlike(p), u) for u, p in words.items()])


def text_unit(unit: Column, words: dict[str, str]) -> Column:
    """The unit named by the token written beside a value."""
    u = F.lower(unit)
    extra = F.when(u == "m", "m").when(u.isin("'", "′"), "arcmin") if "m" in words else F.when(u.isin("'", "′"), "arcmin")
    return F.coalesce(extra, *[F.when(u.rlike(p), k) for k, p in words.items()])


def is_fsl(rpformat: Column) -> Column:
    """Column order named by a format typed by hand."""
    f = F.lower(F.coalesce(rpformat, F.lit("")))
    return f.contains("fsl") | f.contains("mcflirt")


def numbers(rp: DataFrame) -> DataFrame:
    """Readings with six numbers whatever the file: run_id, t, v (six doubles in the file's order), u1 and u4
    (the units written beside the first and fourth value), arrived_at. No shuffle."""
    nums = F.regexp_extract_all("rp_text", F.lit(TEXT_VALUE), 1)
    unts = F.regexp_extract_all("rp_text", F.lit(TEXT_VALUE), 2)
    has = F.col("rp_text").isNotNull()
    six = F.array(*[f"c{i}" for i in range(1, 7)])
    v = F.when(has, F.transform(nums, lambda x: x.try_cast("double"))).otherwise(six)
    u = rp.select("run_id", "t", "arrived_at", v.alias("v"), F.when(has, unts).alias("u"))
    return u.where((F.size("v") == 6) & F.col("run_id").isNotNull() & F.col("t").isNotNull()).select(
        "run_id", "t", "arrived_at", "v", F.get("u", F.lit(0)).alias("u1"), F.get("u", F.lit(3)).alias("u4")
    )


def robust_scales(p: np.ndarray, q: np.ndarray, fd: np.ndarray) -> tuple[float, float, float, float, int]:
    """Scales of p and q, offset and relative residual of fd by least absolute deviations, and the frames that took part."""
    none = (np.nan,) * 4
    ok = np.isfinite(p) & np.isfinite(q) & np.isfinite(fd) & (p + q > 0)
    for x in (p, q, fd):
        m = np.median(x[ok]) if ok.any() else 0.0
        if m > 0:
            ok &= ~(x > JUMP * m)
    n = int(ok.sum())
    if n < LEAST:
        return (*none, n)
    p, q, fd = p[ok], q[ok], fd[ok]
    sp, sq, sf = (float(np.mean(x)) or 1.0 for x in (p, q, fd))
    x = np.stack([p / sp, q / sq, np.ones(n)], axis=1)
    y = fd / sf
    w = np.ones(n)
    b = np.zeros(3)
    for _ in range(ROUNDS):
        g = (x * w[:, None]).T
        b = np.linalg.solve(g @ x + 1e-9 * np.eye(3), g @ y)
        w = 1 / np.maximum(np.abs(y - x @ b), 1e-5)
    left = float(np.median(np.abs(y - x @ b)) / max(float(np.median(y)), 1e-12))
    return float(b[0] * sf / sp), float(b[1] * sf / sq), float(b[2] * sf), left, n


def _estimate_kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows run_id, blk, t, fd, v0..v5 sorted by (run_id, blk, t, latest first), a source's own columns NaN in the other's rows."""
    names = ["run_id", "frames", "n", "a", "b", "c", "left", "p", "q"]

    def one(run: int, t: np.ndarray, fd: np.ndarray, v: np.ndarray) -> tuple | None:
        has = np.flatnonzero(~np.isnan(v).all(1))
        has = has[np.r_[True, t[has][1:] != t[has][:-1]]] if len(has) else has
        if not len(has):
            return None
        told = np.flatnonzero(~np.isnan(fd))
        told = told[np.r_[True, t[told][1:] != t[told][:-1]]] if len(told) else told
        tv, x = t[has], v[has]
        with np.errstate(all="ignore"):
            d = np.abs(np.diff(x, axis=0))
        step = np.diff(tv) == 1
        p, q = d[step, :3].sum(1), d[step, 3:].sum(1)
        at = tv[1:][step]
        f = np.full(len(at), np.nan)
        if len(told) and len(at):
            k = np.minimum(np.searchsorted(t[told], at), len(told) - 1)
            f = np.where(t[told][k] == at, fd[told][k], np.nan)
        est = robust_scales(p, q, f)
        middle = [float(np.median(z[np.isfinite(z)])) if np.isfinite(z).any() else np.nan for z in (p, q)]
        return (run, len(tv), est[4], *est[:4], *middle)

    held: list[tuple] = []
    for b in batches:
        cols = [np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(3)]
        fd = b.column(3).to_numpy(zero_copy_only=False).astype(float)
        v = np.stack([b.column(4 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(6)], axis=1)
        held.append((*cols, fd, v))
        run, blk = cols[0], cols[1]
        if len(run) == 0 or ((run[0], blk[0]) == (run[-1], blk[-1]) and (held[0][0][0], held[0][1][0]) == (run[-1], blk[-1])):
            continue
        yield from _estimated(held, one, names, False)
    if held:
        yield from _estimated(held, one, names, True)


def _estimated(held: list[tuple], one, names: list[str], last: bool) -> Iterator[pa.RecordBatch]:
    """Estimates of the whole groups held; the last group stays, as it may go on, unless it is the last of all."""
    run, blk, t, fd, v = (np.concatenate(c) for c in zip(*held))
    edge = np.flatnonzero((run[1:] != run[:-1]) | (blk[1:] != blk[:-1])) + 1
    cuts = [0, *edge.tolist(), len(run)]
    whole = len(cuts) - 1 if last else len(cuts) - 2
    rows = [one(run[a], t[a:b], fd[a:b], v[a:b]) for a, b in zip(cuts[:whole], cuts[1 : whole + 1]) if a < b]
    a = cuts[whole]
    held[:] = [] if last else [(run[a:], blk[a:], t[a:], fd[a:], v[a:])]
    cols = list(zip(*[r for r in rows if r])) or [()] * len(names)
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 6]
    yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], names)


def pair_estimates(rp: DataFrame, metric: DataFrame) -> DataFrame:
    """Per run: frames, n (linked frames used), a and b (mm of displacement per unit of the first and last three columns),
    c (offset), left (relative residual), p and q (median change of the first and last three columns)."""
    none = F.lit(float("nan"))
    v = [F.coalesce(F.col("v")[i], none).alias(f"v{i}") for i in range(6)]
    own = numbers(rp).select("run_id", "t", "arrived_at", none.alias("fd"), *v)
    told = metric.where(F.col("fd").isNotNull() & ~F.isnan("fd") & F.col("run_id").isNotNull() & F.col("t").isNotNull())
    told = told.select("run_id", "t", "arrived_at", "fd", *[none.alias(f"v{i}") for i in range(6)])
    both = own.unionByName(told).withColumn("blk", F.expr(f"t div {BLOCK}")).repartition("run_id", "blk")
    rows = both.sortWithinPartitions("run_id", "blk", "t", F.desc("arrived_at"), "fd", *[f"v{i}" for i in range(6)])
    out = "run_id long, frames int, n int, a double, b double, c double, left double, p double, q double"
    per = rows.select("run_id", "blk", "t", "fd", *[f"v{i}" for i in range(6)]).mapInArrow(_estimate_kernel, out)
    mid = lambda c: F.percentile_approx(F.when(~F.isnan(c), F.col(c)), 0.5, 1000).alias(c)
    return per.groupBy("run_id").agg(F.sum("frames").alias("frames"), F.sum("n").alias("n"), *[mid(c) for c in ("a", "b", "c", "left", "p", "q")])


def _nearest(scale: Column, known: dict[str, float], only: tuple[str, ...] | None = None) -> Column:
    """(e, u): the known conversion nearest to a scale, and its distance as a logarithm."""
    return F.array_min(F.array(*[F.struct(F.abs(F.log(scale / s)).alias("e"), F.lit(u).alias("u")) for u, s in known.items() if not only or u in only]))


def source_links(rp: DataFrame, metric: DataFrame, runs: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One row per run with readings: run_id, fsl, n, offset, residual, and for translation and rotation the estimated scale
    (t_scale, r_scale: mm or degrees per unit, null without an estimate), its distance from the nearest conversion (t_off,
    r_off), the unit, and where it comes from (t_from, r_from: words, displacements, image, subject, site, all or usual)."""
    est = pair_estimates(rp, metric)
    text = numbers(rp.where("rp_text is not null")).groupBy("run_id").agg(F.max("u1").alias("u1"), F.max("u4").alias("u4"))
    said = runs.groupBy("run_id").agg(F.max("rpformat").alias("rpformat"), F.max("rp_note").alias("rp_note"), *([F.max(c).alias(c) for c in ("image", "site") if c in runs.columns]))
    for c in ("image", "site"):
        if c not in said.columns:
            said = said.withColumn(c, F.lit(None).cast("string"))
    if images is not None:
        said = said.join(images.groupBy("image").agg(F.max("subject_no").alias("subject")), "image", "left")
    else:
        said = said.withColumn("subject", F.lit(None).cast("long"))
    per = est.join(text, "run_id", "left").join(said, "run_id", "left").withColumn("fsl", is_fsl(F.col("rpformat")))
    pick = lambda a, b: F.when(F.col("fsl"), F.col(b)).otherwise(F.col(a))
    good = (F.col("n") >= LEAST) & (F.col("left") <= MOST_RESIDUAL)
    per = per.select(
        "run_id", "fsl", "n", F.col("c").alias("offset"), F.col("left").alias("residual"), "image", "subject", "site", F.lit(0).alias("all"), "rp_note",
        F.when(good & (pick("a", "b") > 0), pick("a", "b")).alias("t_scale"), F.when(good & (pick("b", "a") > 0), pick("b", "a") / MM_PER_DEGREE).alias("r_scale"),
        pick("p", "q").alias("t_change"), pick("q", "p").alias("r_change"), pick("u1", "u4").alias("t_text"), pick("u4", "u1").alias("r_text"),
    )
    for k, known, words in (("t", TRANSLATION, TRANSLATION_WORDS), ("r", ROTATION, ROTATION_WORDS)):
        near = _nearest(F.col(f"{k}_scale"), known)
        said_unit = F.coalesce(text_unit(F.col(f"{k}_text"), words), _words(F.col("rp_note"), words))
        per = per.withColumn(f"{k}_off", near["e"]).withColumn(f"{k}_said", said_unit)
        per = per.withColumn(f"{k}_est", F.when(near["e"] <= SNAP, near["u"]).when(F.col(f"{k}_scale").isNotNull(), UNKNOWN))
        size = F.coalesce(*[F.when(F.coalesce(f"{k}_said", f"{k}_est") == u, F.lit(s)) for u, s in known.items()], F.when(F.col(f"{k}_said").isNull(), F.col(f"{k}_scale")))
        per = per.withColumn(f"{k}_typ", F.when(F.col(f"{k}_change") > 0, F.log(F.col(f"{k}_change") * size)))
    per = written(per.drop("rp_note", "t_text", "r_text"), "runs")
    out = per
    for level in ("image", "subject", "site", "all"):
        ends = per.where(F.col(level).isNotNull()).groupBy(level).agg(*[F.percentile_approx(f"{k}_typ", 0.5, 1000).alias(f"{k}_{level}") for k in "tr"])
        out = out.join(ends, level, "left")
    cols = ["run_id", "fsl", "n", "offset", "residual"]
    for k, name, known, usual in (("t", "translation", TRANSLATION, "mm"), ("r", "rotation", ROTATION, "deg")):
        own = F.when(F.col(f"{k}_change") > 0, F.log(f"{k}_change"))
        by = []
        for level in ("image", "subject", "site", "all"):
            near = _nearest(F.exp(F.col(f"{k}_{level}") - own), known, INFERABLE)
            by.append(F.when(near["e"].isNotNull(), F.struct(near["u"].alias("u"), F.lit(level).alias("f"))))
        has = lambda c, f: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("u"), F.lit(f).alias("f")))
        last = F.struct(F.lit(usual).alias("u"), F.lit("usual").alias("f"))
        out = out.withColumn(name, F.coalesce(has(f"{k}_said", "words"), has(f"{k}_est", "displacements"), *by, last))
        cols += [F.col(f"{k}_scale"), F.col(f"{k}_off"), F.col(name)["u"].alias(name), F.col(name)["f"].alias(f"{k}_from")]
    return out.select(*cols)


def run_units(rp: DataFrame, metric: DataFrame, runs: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(run_id, fsl, translation, rotation): column order and units per run, one row per run with readings."""
    return source_links(rp, metric, runs, images).select("run_id", "fsl", "translation", "rotation")


def found_units(units: DataFrame) -> DataFrame:
    """(run_id, quantity, unit) of the quantities recorded in a known unit other than mm and degrees."""
    return units.select(
        "run_id", F.explode(F.array(
            F.struct(F.lit("translation").alias("quantity"), F.col("translation").alias("unit")),
            F.struct(F.lit("rotation").alias("quantity"), F.col("rotation").alias("unit")),
        )).alias("q"),
    ).select("run_id", "q.quantity", "q.unit").where(f"unit not in ('mm', 'deg', '{UNKNOWN}')")


def converted(rp: DataFrame, units: DataFrame) -> DataFrame:
    """Frames in common units: run_id, t, x, y, z in mm, pitch, roll, yaw in degrees; latest arrival of a frame.

    ``units`` is the outcome of :func:`source_links`, whose estimated scale serves where the unit is unknown, or of
    :func:`run_units`, without which such values are null.
    """
    v = numbers(rp).withColumn("blk", F.expr(f"t div {BLOCK}")).groupBy("run_id", "blk", "t").agg(F.max_by("v", F.struct("arrived_at", "v")).alias("v"))

    def scale(c: str, k: str, m: dict[str, float]) -> Column:
        own = [F.col(k)] if k in units.columns else []
        return F.coalesce(*[F.when(F.col(c) == u, F.lit(s)) for u, s in m.items()], *own)

    sized = units.select("run_id", "fsl", scale("translation", "t_scale", TRANSLATION).alias("st"), scale("rotation", "r_scale", ROTATION).alias("sr"))
    j = v.join(sized, "run_id")
    at = lambda i: F.when(F.col("fsl"), F.col("v")[(i + 3) % 6]).otherwise(F.col("v")[i])
    return j.select(
        "run_id", "t", *[(at(i) * F.col("st")).alias(n) for i, n in enumerate("xyz")],
        *[(at(i + 3) * F.col("sr")).alias(n) for i, n in enumerate(("pitch", "roll", "yaw"))],
    )
