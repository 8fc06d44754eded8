"""Implausible readings, each judged against the ordinary behaviour of its own run.

Every series (the six parameters, fd, dvars) is set against the running course of its run, its seasonal part:
parameters against the medians of the three recorded frames before and after (the nearer of both, so a step that
stays is no spike), fd against the median of ``AROUND`` frames on either side, dvars as the log ratio to it. Both
tails of the residuals of a run are fitted by peaks over threshold (:mod:`.tails`) and the cutoff of the fit, and
nothing else, decides what leaves the run's ordinary variation; what is back after one or two frames is a spike.

Two rules beside it: six or more successive recorded frames without a change (stuck), and impossible readings
(infinite, negative fd or dvars, or a thousand times the ordinary variation away from the course: a code number).

Readings are brought together by one shuffle on (run, block of ``BLOCK`` frames) with margins from the
neighbouring blocks. A run within one block is judged where it lies. Of a longer run every block counts its
residuals by step; the counts are added up, the tails fitted from them for the run as a whole, and its blocks
judged by these limits. As the fit works on steps anyway, a run gets the same limits in one block or in many.
Neither a hot site nor a hot run lands in one task. The kernel is numpy over Arrow batches.

Defined cases: null and NaN are missing and never flagged; a repeated (run, frame) keeps its latest arrival; runs
under ``tails.LEAST`` readings have no fitted cutoff and only the two rules apply; frame 0 is never flagged; rows
without run or frame are ignored; at the edge of a block, neighbours further than ``MARGIN`` frames are not seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import joined, written
from . import tails
from .units import numbers

BLOCK = 4096
MARGIN = 32
#: Recorded frames on either side that make the course of fd and dvars, and of what is impossible.
AROUND = 8
STUCK = 6
#: Multiple of the ordinary variation that no reading has.
NEVER = 1000.0
#: Series padded side by side are processed in groups of about this many values.
GROUP_VALUES = 400_000
#: Bytes up to which the ids of the long runs are broadcast.
FEW_BYTES = 8 << 20
#: A frame number that marks a run with readings outside its first block.
MARK = -(2**31)
TAILS = ("up", "down", "far")


def _side_median(x: np.ndarray, before: bool) -> np.ndarray:
    """Median of up to three recorded values before (or after) each value; rows hold values left-packed, NaN behind."""
    n, w = x.shape
    p = np.full((n, w + 6), np.nan)
    p[:, 3 : w + 3] = x
    a, b, c = (p[:, 2 - i : 2 - i + w] if before else p[:, 4 + i : 4 + i + w] for i in range(3))  # nearest first
    hi, lo = np.fmax(np.fmax(a, b), c), np.fmin(np.fmin(a, b), c)
    have = np.isfinite(a).astype(int) + np.isfinite(b) + np.isfinite(c)
    with np.errstate(all="ignore"):
        mid = np.where(have == 3, a + b + c - hi - lo, (hi + lo) / 2)
        mid = np.where((have == 3) & (np.maximum(np.abs(hi), np.abs(lo)) > 1e6), np.sort(np.stack([a, b, c]), axis=0)[1], mid)
    return mid


def _course(x: np.ndarray) -> np.ndarray:
    """Running median of the recorded values around each value, itself included."""
    n, w = x.shape
    p = np.full((n, w + 2 * AROUND), np.nan)
    p[:, AROUND : w + AROUND] = x
    s = np.sort(np.lib.stride_tricks.sliding_window_view(p, 2 * AROUND + 1, axis=1), axis=2)  # NaN last
    k = np.maximum((~np.isnan(s)).sum(2) - 1, 0)[:, :, None]
    lo, hi = np.take_along_axis(s, k // 2, 2)[:, :, 0], np.take_along_axis(s, (k + 1) // 2, 2)[:, :, 0]
    return lo / 2 + hi / 2


def residuals(x: np.ndarray, measure: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residuals up, down and distances from the course, each on the grid of the fit; ``x`` left-packed, NaN behind."""
    y = np.where(np.isinf(x), np.sign(x) * 1e300, x)
    with np.errstate(all="ignore"):
        course = _course(y)
        far = np.abs(y - course)
        if measure == "rp":
            b, a = y - _side_median(y, True), y - _side_median(y, False)
            both = np.isfinite(a) & np.isfinite(b) & (a * b > 0)
            res = np.where(both, np.sign(a) * np.minimum(np.abs(a), np.abs(b)), np.where(np.isnan(y), np.nan, 0.0))
        elif measure == "dvars":
            res = np.where(course > 0, np.log((np.maximum(y, 0) + 0.1 * course) / (1.1 * course)), np.where(np.isnan(y), np.nan, 0.0))
        else:
            res = y - course
    return tails.steps(res), tails.steps(-res), tails.steps(far)


def limits(up: np.ndarray, down: np.ndarray, far: np.ndarray, weight: tuple = (None, None, None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cutoffs up and down and the distance that is impossible, per row."""
    return tails.cutoff(up, weight[0]), tails.cutoff(down, weight[1]), _never(far, weight[2])


def _never(far: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    by = np.argsort(far, axis=1)
    s = np.take_along_axis(far, by, 1)
    w = np.isfinite(s).astype(float) if weight is None else np.take_along_axis(weight, by, 1)
    upto = np.cumsum(w, axis=1)
    n = upto[:, -1]
    mid = s[np.arange(len(s)), np.argmax(upto >= (n / 2)[:, None], axis=1)]
    return np.where((n >= tails.LEAST) & (mid > 0), NEVER * 1.4826 * mid, np.inf)


def flags(x: np.ndarray, measure: str, given: tuple | None = None) -> np.ndarray:
    """Which readings cannot be true; ``x`` is series x recorded frames, left-packed, NaN behind."""
    out = np.isinf(x)
    if measure != "rp":
        out |= x < 0
    up, down, far = residuals(x, measure)
    hi, lo, never = given if given is not None else limits(up, down, far)
    with np.errstate(all="ignore"):
        out |= far > never[:, None]
        spike = (up > hi[:, None]) | (down > lo[:, None])
    # A spike is back after one or two frames; longer stretches are behaviour, unless impossible.
    run = _run_lengths(spike & ~out)
    out |= spike & (run <= 2)
    same = np.zeros(x.shape, bool)
    same[:, 1:] = x[:, 1:] == x[:, :-1]
    stay = _run_lengths(same)  # of equal neighbours; the first frame of the stretch comes before them
    stuck = same & (stay >= STUCK - 1)
    stuck[:, :-1] |= stuck[:, 1:]
    return out | stuck


def _run_lengths(m: np.ndarray) -> np.ndarray:
    """For every true cell the length of its horizontal run of true cells, 0 elsewhere."""
    r, w = m.shape
    flat = np.zeros((r, w + 1), bool)
    flat[:, :w] = m
    f = flat.ravel().astype(np.int8)
    d = np.diff(np.concatenate([[0], f, [0]]))
    start, end = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    out = np.zeros(f.size + 1, np.int32)
    ln = (end - start).astype(np.int32)
    out[start] += ln
    out[end] -= ln
    return np.cumsum(out[:-1]).reshape(r, w + 1)[:, :w]


class _Groups:
    """Rows sorted by run, block, t, latest arrival first, as whole groups: one row per frame, groups numbered."""

    def __init__(self, run: np.ndarray, blk: np.ndarray, t: np.ndarray, vals: np.ndarray, lim: np.ndarray):
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (blk[1:] != blk[:-1]) | (t[1:] != t[:-1])
        self.run, self.blk, self.t, self.vals = run[new], blk[new], t[new], vals[new]
        first = np.ones(len(self.run), bool)
        first[1:] = (self.run[1:] != self.run[:-1]) | (self.blk[1:] != self.blk[:-1])
        self.first = np.flatnonzero(first)
        self.group = np.cumsum(first) - 1
        self.lim = lim[new][self.first]
        self.own = self.t // BLOCK == self.blk
        long = (self.blk[self.first] != 0) | (self.t[self.first] == MARK)
        self.short = ~long[self.group]

    def series(self, j: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows with a value of series j among ``keep``; their group and place; the values as groups x places."""
        at = np.flatnonzero(keep & ~np.isnan(self.vals[:, j]))
        if not len(at):
            return at, at, at, np.zeros((0, 4))
        g = self.group[at]
        size = np.bincount(g, minlength=self.group[-1] + 1)
        pos = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        x = np.full((len(size), max(int(size.max()), 4)), np.nan)
        x[g, pos] = self.vals[at, j]
        return at, g, pos, x


def _flag(measures: tuple[str, ...], long: bool) -> Callable[[_Groups], pa.RecordBatch | None]:
    """Flags of the runs within one block, or, with the limits of their run beside them, of the blocks of long runs."""

    def judge(s: _Groups) -> pa.RecordBatch | None:
        found: dict[str, list[np.ndarray]] = {}
        keep = np.ones(len(s.run), bool) if long else s.short
        for j, measure in enumerate(measures):
            at, g, pos, x = s.series(j, keep)
            if len(at):
                given = tuple(np.array([r[3 * j + k] for r in s.lim]) for k in range(3)) if long else None
                hit = flags(x, measure, given)[g, pos]
                found.setdefault(measure, []).append(at[hit & (s.t[at] >= 1) & s.own[at]])
        parts = {m: np.unique(np.concatenate(v)) for m, v in found.items()}
        rows = np.concatenate([*parts.values(), np.zeros(0, int)]).astype(int)
        if not len(rows):
            return None
        names = np.repeat(list(parts), [len(v) for v in parts.values()])
        return pa.RecordBatch.from_arrays([pa.array(s.run[rows]), pa.array(s.t[rows].astype(np.int32)), pa.array(list(names), pa.string())], ["run_id", "t", "measure"])

    return judge


def _count(measures: tuple[str, ...]) -> Callable[[_Groups], pa.RecordBatch | None]:
    """Residuals of the blocks of long runs, counted by step: run_id, part (series and tail), v, n."""

    def count(s: _Groups) -> pa.RecordBatch | None:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for j, measure in enumerate(measures):
            at, g, pos, x = s.series(j, np.ones(len(s.run), bool))
            if not len(at):
                continue
            own = np.zeros(x.shape, bool)
            own[g, pos] = s.own[at]
            for k, res in enumerate(residuals(x, measure)):
                r, c = np.nonzero(own & np.isfinite(res))
                key, n = np.unique(np.stack([r.astype(float), res[r, c]]), axis=1, return_counts=True)
                for col, v in zip(cols, (s.run[s.first][key[0].astype(int)], np.full(len(n), 3 * j + k), key[1], n)):
                    col.append(v)
        if not cols[0]:
            return None
        types = [pa.int64(), pa.int32(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(t) for c, t in zip(cols, types)], ["run_id", "part", "v", "n"])

    return count


def _kernel(series: int, work_on: Callable[[_Groups], pa.RecordBatch | None]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows = 0

        def columns():
            return [np.concatenate(c) for c in zip(*held)]

        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            vals = np.stack([b.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(series)], axis=1)
            lim = b.column(3 + series).to_numpy(zero_copy_only=False) if b.num_columns > 3 + series else np.zeros(b.num_rows)
            held.append((*cols, vals, lim))
            rows += b.num_rows
            if rows * series < GROUP_VALUES:
                continue
            run, blk, t, vals, lim = columns()
            # The last group may go on in the next batch.
            cut = int(np.flatnonzero((run != run[-1]) | (blk != blk[-1]))[-1]) + 1 if (run[0], blk[0]) != (run[-1], blk[-1]) else 0
            if cut:
                out = work_on(_Groups(run[:cut], blk[:cut], t[:cut], vals[:cut], lim[:cut]))
                if out:
                    yield out
            held = [(run[cut:], blk[cut:], t[cut:], vals[cut:], lim[cut:])]
            rows = len(run) - cut
        if rows:
            out = work_on(_Groups(*columns()))
            if out:
                yield out

    return work


def _fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows run_id, part, v (list), n (list) to run_id, part, lim."""
    for b in parts:
        lim = []
        for part, v, n in zip(b.column(1).to_pylist(), b.column(2), b.column(3)):
            v, n = np.array(v.as_py())[None, :], np.array(n.as_py(), float)[None, :]
            lim.append(float((_never if part % 3 == 2 else tails.cutoff)(v, n)[0]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lim, pa.float64())], ["run_id", "part", "lim"])


def _flagged(df: DataFrame, keys: DataFrame, series: list[str], measures: tuple[str, ...]) -> DataFrame:
    """df: run_id, t, arrived_at and the series; keys: (run_id, t) of the same rows, unread. One shuffle by (run, block)."""
    floor = F.floor(F.col("t") / BLOCK).cast("long")
    near = F.array_distinct(F.array(floor, F.floor((F.col("t") - MARGIN) / BLOCK).cast("long"), F.floor((F.col("t") + MARGIN) / BLOCK).cast("long")))
    edge = F.pmod(F.col("t"), F.lit(BLOCK))
    inside = (edge >= MARGIN) & (edge < BLOCK - MARGIN) | ((F.col("t") < BLOCK - MARGIN) & (F.col("t") >= 0))
    rows = df.where("run_id is not null and t is not null").withColumn("blk", F.explode(F.when(inside, F.array(floor)).otherwise(near)))
    beyond = keys.where((F.col("t") >= BLOCK) | (F.col("t") < 0)).where("run_id is not null")
    marks = beyond.select("run_id").distinct().select("run_id", F.lit(MARK).alias("t"), F.lit(0).cast("long").alias("blk"))
    order = ["run_id", "blk", "t", F.desc("arrived_at"), *series]
    cols = ["run_id", "blk", "t", *series]
    out = "run_id long, t int, measure string"
    n = len(measures)
    all_rows = rows.unionByName(marks, allowMissingColumns=True).repartition("run_id", "blk").sortWithinPartitions(*order)
    short = all_rows.select(*cols).mapInArrow(_kernel(n, _flag(measures, False)), out)
    if beyond.limit(1).count() == 0:  # no run goes beyond a block; footers of the files mostly tell
        return short
    long = joined(rows, written(beyond.select("run_id").distinct(), "long-runs"), ["run_id"], "left_semi", FEW_BYTES)
    counted = long.repartition("run_id", "blk").sortWithinPartitions(*order).select(*cols).mapInArrow(_kernel(n, _count(measures)), "run_id long, part int, v double, n long")
    tail = counted.groupBy("run_id", "part", "v").agg(F.sum("n").alias("n")).groupBy("run_id", "part")
    fitted = tail.agg(F.collect_list(F.struct("v", "n")).alias("s")).select("run_id", "part", "s.v", "s.n").mapInArrow(_fit, "run_id long, part int, lim double")
    per = fitted.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("part", "lim"))).alias("m"))
    none = F.lit(float("inf"))
    per = per.select("run_id", F.array(*[F.coalesce(F.col("m")[F.lit(i)], none) for i in range(3 * n)]).alias("lim"))
    blocks = long.select("run_id", "blk").distinct().join(per, "run_id")
    judged = long.join(blocks.hint("merge"), ["run_id", "blk"]).sortWithinPartitions(*order).select(*cols, "lim")
    return short.unionByName(judged.mapInArrow(_kernel(n, _flag(measures, True)), out))


def flagged_parameters(rp: DataFrame) -> DataFrame:
    """(run_id, t, 'rp') of frames with an implausible parameter; needs run_id, t, c1..c6, rp_text, arrived_at."""
    v = numbers(rp).select("run_id", "t", "arrived_at", *[F.col("v")[i].alias(f"v{i}") for i in range(6)])
    return _flagged(v, rp.select("run_id", "t"), [f"v{i}" for i in range(6)], ("rp",) * 6)


def flagged_metrics(metric: DataFrame) -> DataFrame:
    """(run_id, t, 'fd' or 'dvars') of implausible readings; needs run_id, t, fd, dvars, arrived_at."""
    return _flagged(metric.select("run_id", "t", "arrived_at", "fd", "dvars"), metric.select("run_id", "t"), ["fd", "dvars"], ("fd", "dvars"))


def implausible(rp: DataFrame, metric: DataFrame) -> DataFrame:
    """All implausible readings: (run_id, t, measure)."""
    return flagged_parameters(rp).unionByName(flagged_metrics(metric))
