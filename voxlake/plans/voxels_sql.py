"""DuckDB SQL for the queries of :mod:`voxels`, written independently of the operators."""

from __future__ import annotations

E = """e AS (SELECT vec_id AS voxel, vec_id % 8 AS x, (vec_id // 8) % 8 AS y, vec_id // 64 AS z, label, embedding FROM embeddings),
l AS (SELECT voxel, x, y, z, label, CAST(g - 1 AS INTEGER) AS t, CAST(embedding[g] AS DOUBLE) AS v FROM e, range(1, 65) r(g))"""
PI = "3.141592653589793"


def r(x: str) -> str:
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE round({x}, 6) + 0.0 END)"


def w(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([E, *ctes]) + "\n" + select


def seed(label: int = 2, name: str = "s") -> str:
    return f"{name} AS (SELECT t, avg(v) AS value FROM l WHERE label = {label} GROUP BY t)"


PEARSON = "covar_samp(v, sv) / (greatest(stddev_samp(v), 1e-10) * greatest(stddev_samp(sv), 1e-10))"


def fisher(x: str) -> str:
    c = f"greatest(least({x}, 1 - 1e-10), -1 + 1e-10)"
    return f"0.5 * ln((1 + {c}) / (1 - {c}))"


def corr(on: str = "l.t = s.t", value: str = fisher("c"), where: str = "true") -> str:
    return w(
        f"SELECT voxel, {r(value)} AS value FROM k", seed(),
        f"p AS (SELECT l.voxel, l.v, s.value AS sv FROM l JOIN s ON {on} WHERE {where})",
        f"k AS (SELECT voxel, {PEARSON} AS c, count(*) AS n FROM p GROUP BY voxel)",
    )


REG = (
    seed(),
    "p AS (SELECT l.voxel, l.t, l.v, s.value AS sv FROM l JOIN s USING (t))",
    """b AS (SELECT voxel, CASE WHEN abs(sxx) > 1e-12 THEN sxy / sxx ELSE 0 END AS slope, mv, ms FROM (
      SELECT voxel, sum(sv * sv) - sum(sv) * sum(sv) / count(*) AS sxx, sum(sv * v) - sum(sv) * sum(v) / count(*) AS sxy, avg(v) AS mv, avg(sv) AS ms
      FROM p GROUP BY voxel))""",
)


def kernel(first: int, last: int, mean: bool, src: str = "l") -> tuple[str, ...]:
    dc = " + 1.0 / 64" if mean else ""
    return (
        f"h AS (SELECT d, 2.0 / 64 * sum(cos(2 * {PI} * k * d / 64)){dc} AS h FROM range(0, 64) a(d), range({first}, {last + 1}) b(k) GROUP BY d)",
        f"f AS (SELECT q.voxel, CAST(o.t AS INTEGER) AS t, sum(q.v * h.h) AS v FROM {src} q, range(0, 64) o(t), h WHERE h.d = (o.t - q.t + 64) % 64 GROUP BY ALL)",
    )


METRICS = """m AS (SELECT t, abs(avg(v)) AS fd, stddev_samp(v) AS dv FROM l WHERE label = 2 GROUP BY t),
fl AS (SELECT t, max(bad) OVER (ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS flagged
  FROM (SELECT t, CASE WHEN t >= 1 AND (fd > 0.02 OR dv > 1.0) THEN 1 ELSE 0 END AS bad FROM m)),
fm AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS new_t FROM fl WHERE flagged = 0)"""

RP = """d AS (SELECT CAST(ts AS DATE) AS day, event_type, value FROM events),
n AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM d)),
g AS (SELECT day, """ + ", ".join(f"coalesce(avg(value) FILTER (k = {i}), 0) AS c{i}" for i in range(1, 6)) + """, count(*) / 1000 AS c6 FROM d JOIN n USING (event_type) GROUP BY day),
rp AS (SELECT CAST(day - (SELECT min(day) FROM d) AS INTEGER) AS t, c1, c2, c3, c4, c5, c6 FROM g)"""


def fd(order: list[str]) -> str:
    d = lambda c: f"abs({c} - lag({c}) OVER (ORDER BY t))"
    tr, ro = " + ".join(map(d, order[:3])), " + ".join(map(d, order[3:]))
    return f"WITH {RP} SELECT t, {r(f'coalesce({tr} + ({ro}) * {PI} * 50 / 180, 0)')} AS fd FROM rp"


def smooth_pass(src: str, out: str, axis: str) -> str:
    rest = [c for c in "xyz" if c != axis]
    sel = ", ".join(f"a.{c}" for c in "xyz")
    same = " AND ".join(f"a.{c} = b.{c}" for c in rest)
    # FWHM 6 mm at 3 mm cells: deviation 2.548 mm, reach ceil(4 * 2.548 / 3) = 4.
    g = f"exp(-pow((a.{axis} - b.{axis}) * 3.0, 2) / (2 * pow(6.0 / (2 * sqrt(2 * ln(2))), 2)))"
    return (
        f"{out} AS (SELECT a.t, {sel}, sum(b.v * {g}) / sum({g}) AS v FROM {src} a JOIN {src} b ON a.t = b.t AND {same} "
        f"AND abs(a.{axis} - b.{axis}) <= 4 GROUP BY ALL)"
    )


NZ = "nz AS (SELECT max(z) + 1 AS n FROM e)"
FRAMES = "f0 AS (SELECT t, x, y, z, v FROM l)"
CELLS = "c AS (SELECT t, x, y, z, v FROM l)"


def grid(a: int, b: int, c: str, frames: str = ", range(64) f(t)") -> str:
    """NZ and all cells of a grid for all frames; ``c`` is the number of slices by that of the image, n."""
    t = "f.t, " if frames else ""
    return (
        f"{NZ}, g AS (SELECT {t}i % {a} AS x, (i // {a}) % {b} AS y, i // {a * b} AS z, i AS id, n, nn "
        f"FROM (SELECT unnest(range({a * b} * nn)) AS i, n, nn FROM (SELECT n, CAST({c} AS BIGINT) AS nn FROM nz)) q{frames})"
    )


def targets(new: tuple[int, int, str]) -> tuple[str, str]:
    p = ", ".join(f"CAST({c} AS DOUBLE) / ({n} / {o}) AS p{c}" for c, n, o in zip("xyz", (f"{new[0]}.0", f"{new[1]}.0", "CAST(nn AS DOUBLE)"), ("8.0", "8.0", "n")))
    return grid(*new), f"tg AS (SELECT t, id, {p} FROM g)"


def corners(lo: int, hi: int, weight: str, name: str) -> str:
    near = " AND ".join(f"c.{a} BETWEEN floor(tg.p{a}) + {lo} AND floor(tg.p{a}) + {hi}" for a in "xyz")
    d = ", ".join(f"tg.p{a} - c.{a} AS d{a}" for a in "xyz")
    return f"{name} AS (SELECT t, id, sum(v * w) AS v, sum(w) AS w, count(*) AS n FROM (SELECT t, id, v, {weight} AS w FROM (SELECT tg.t, tg.id, c.v, {d} FROM tg JOIN c ON tg.t = c.t AND {near})) GROUP BY t, id)"


DIST8 = "sqrt(pow(1 - abs(dx), 2) + pow(1 - abs(dy), 2) + pow(1 - abs(dz), 2))"
TRI = " * ".join(f"greatest(1 - abs(d{a}), 0)" for a in "xyz")


def lz(d: str, a: int = 3) -> str:
    return f"(CASE WHEN abs({d}) < 1e-12 THEN 1.0 WHEN abs({d}) >= {a} THEN 0.0 ELSE {a} * sin({PI} * {d}) * sin({PI} * {d} / {a}) / pow({PI} * {d}, 2) END)"


LZ = " * ".join(lz(f"d{a}") for a in "xyz")
#: Lanczos-3 values of the targets tg where all 216 cells are there, else by the eight corners.
LANCZOS_XYZ = (
    corners(-2, 3, LZ, "k"), corners(0, 1, DIST8, "nr"),
    "lz AS (SELECT tg.t, tg.id, CASE WHEN k.n = 216 THEN k.v ELSE nr.v / nullif(nr.w, 0) END AS value FROM tg LEFT JOIN k ON tg.t = k.t AND tg.id = k.id LEFT JOIN nr ON tg.t = nr.t AND tg.id = nr.id)",
)


def moved(px: str, py: str, pz: str, value: str) -> str:
    """The image at the places px, py, pz (source cells) of every cell of its own grid."""
    return w(
        f"SELECT lz.t, g.x, g.y, g.z, {r(value)} AS v FROM lz JOIN g USING (t, id)", CELLS, grid(8, 8, "n"),
        f"tg AS (SELECT t, id, {px} AS px, {py} AS py, {pz} AS pz FROM g)", *LANCZOS_XYZ,
    )


MASK = "m AS (SELECT x, y, z, CASE WHEN label = 2 THEN 1.0::DOUBLE ELSE 0.0 END AS weight FROM e)"
MOVED = lambda a, b, c: f"mv AS (SELECT t, x + {a} AS x, y + {b} AS y, z + {c} AS z, v FROM c)"
MONTHS = """sm AS (SELECT l_suppkey AS voxel, CAST((year(l_shipdate) - 1992) * 12 + month(l_shipdate) - 1 AS INTEGER) AS t, avg(CAST(l_extendedprice AS DOUBLE)) AS v
  FROM lineitem GROUP BY ALL), ss AS (SELECT t, avg(v) AS value FROM sm GROUP BY t), p AS (SELECT voxel, sm.t, v, ss.value AS sv FROM sm JOIN ss USING (t))"""
DAILY = """dv AS (SELECT user_id AS voxel, CAST(CAST(ts AS DATE) - (SELECT min(CAST(ts AS DATE)) FROM events) AS INTEGER) AS t, avg(value) AS v FROM events GROUP BY ALL)"""
MIRROR = lambda c, d, a: f"CASE WHEN g.{c} - {a} < 0 THEN -1 - (g.{c} - {a}) WHEN g.{c} - {a} >= {d} THEN 2 * {d} - (g.{c} - {a}) - 1 ELSE g.{c} - {a} END"
LANCZOS_T = f"""SELECT voxel, CAST(j AS INTEGER) AS t, {r("CASE WHEN count(*) = 4 THEN sum(v * k) END")} AS value FROM (
  SELECT voxel, j, v, CASE WHEN abs(d) < 1e-12 THEN 1.0 ELSE sin({PI} * d) / ({PI} * d) * sin({PI} * d / 2) / ({PI} * d / 2) END AS k
  FROM (SELECT l.voxel, o.j, l.v, 1 + o.j * 1.5 - l.t AS d, l.t, floor(1 + o.j * 1.5) AS f FROM l, range(0, 40) o(j)) WHERE t BETWEEN f - 1 AND f + 2)
  GROUP BY voxel, j"""



def many_betas(labels: tuple[int, ...]) -> str:
    """Coefficients of the mean courses of regions by orthogonalising one after the other and substituting back."""
    k = range(1, len(labels) + 1)
    raw = ", ".join(f"avg(v) FILTER (label = {b}) AS m{i}" for i, b in zip(k, labels))
    steps = ["o0 AS (SELECT t, " + ", ".join(f"m{i}, m{i} - avg(m{i}) OVER () AS x{i}" for i in k) + f" FROM (SELECT t, {raw} FROM l GROUP BY t))"]
    for i in k:
        q = f"x{i}" + "".join(f" - sum(x{i} * q{j}) OVER () / sum(q{j} * q{j}) OVER () * q{j}" for j in range(1, i))
        steps.append(f"o{i} AS (SELECT *, {q} AS q{i} FROM o{i - 1})")
    last = f"o{len(labels)}"
    on = ", ".join(f"sum(v * q{i}) / sum(q{i} * q{i}) AS d{i}" for i in k)
    mix = "".join(f", sum(x{j} * q{i}) / sum(q{i} * q{i}) AS r{i}_{j}" for i in k for j in range(i + 1, len(labels) + 1))
    steps.append(f"b{len(labels) + 1} AS (SELECT voxel, avg(v) AS mv, {', '.join(f'avg(m{i}) AS a{i}' for i in k)}, {on}{mix} FROM l JOIN {last} USING (t) GROUP BY voxel)")
    for i in reversed(k):
        rest = "".join(f" - r{i}_{j} * b{j}" for j in range(i + 1, len(labels) + 1))
        steps.append(f"b{i} AS (SELECT *, d{i}{rest} AS b{i} FROM b{i + 1})")
    parts = ["mv" + "".join(f" - b{i} * a{i}" for i in k), *[f"b{i}" for i in k]]
    return w(" UNION ALL ".join(f"SELECT voxel, {n} AS beta, {r(x)} AS value FROM b1" for n, x in enumerate(parts)), *steps)


ORACLE = {
    "samples_long": w(f"SELECT voxel, x, y, z, t, {r('v')} AS v FROM l"),
    "mask_apply": w(f"SELECT voxel, t, CASE WHEN label = 2 THEN {r('v')} END AS v FROM l"),
    "mask_clean": w(
        "SELECT voxel FROM q GROUP BY voxel HAVING count(*) FILTER (isnan(v)) = 0 AND stddev_samp(v) >= 1e-6",
        "q AS (SELECT voxel, CASE WHEN voxel = 3 AND t = 5 THEN 'nan'::DOUBLE WHEN voxel = 4 THEN 1.0 ELSE v END AS v FROM l WHERE voxel <> 3 OR t <> 5 UNION ALL SELECT 3, 'nan'::DOUBLE)",
    ).replace("stddev_samp(v) >= 1e-6", "stddev_samp(CASE WHEN isnan(v) THEN NULL ELSE v END) >= 1e-6"),
    "mask_binarize": w("SELECT voxel, CASE WHEN v < 0.1 OR isnan(v) OR isinf(v) THEN 0 ELSE 1 END AS member FROM l WHERE t = 0"),
    "mask_dilate": w(
        "SELECT DISTINCT m.x + a.i AS x, m.y + b.i AS y, m.z + c.i AS z FROM m, range(-1, 2) a(i), range(-1, 2) b(i), range(-1, 2) c(i) "
        "WHERE m.weight > 0.5 AND m.x + a.i BETWEEN 0 AND 7 AND m.y + b.i BETWEEN 0 AND 7 AND m.z + c.i BETWEEN 0 AND 31", MASK),  # fmt: skip
    "roi_sphere": w("SELECT voxel, CASE WHEN sqrt(pow(3.0 * x - 12, 2) + pow(3.0 * y - 12, 2) + pow(3.0 * z - 12, 2)) <= 9 THEN 2.0::DOUBLE ELSE 0.0 END AS v FROM l WHERE t = 0"),
    "roi_cube": w("SELECT voxel, CASE WHEN abs(x - 3) <= 2 AND abs(y - 4) <= 1 AND abs(z - 2) <= 1.5 THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM l WHERE t = 0"),
    "roi_union_keep": w(
        "SELECT voxel, CASE WHEN sqrt(pow(x - 2, 2) + pow(y - 2, 2) + pow(z - 2, 2)) <= 1.5 OR (abs(x - 2) <= 3 AND abs(y - 2) <= 0.5 AND abs(z - 2) <= 0.5) "
        f"THEN 5.0 ELSE {r('v')} END AS v FROM l WHERE t = 0"),  # fmt: skip
    "tc_mean": w(f"SELECT t, {r('value')} AS value FROM s", seed()),
    "tc_stddev": w(f"SELECT t, {r('stddev_samp(v)')} AS value FROM l WHERE label = 2 GROUP BY t"),
    "tc_point": w(f"SELECT t, {r('v')} AS value FROM l WHERE x = 3 AND y = 4 AND z = 5"),
    "corr_r": corr(value="c"),
    "corr_z": corr(),
    "corr_t": corr(value="CASE WHEN 1 - c * c > 0 THEN c * sqrt((n - 2) / (1 - c * c)) END"),
    "corr_delay": corr(on="l.t = s.t + 3"),
    "corr_length": corr(where="l.t < 40"),
    "corr_montecarlo": w(
        f"SELECT voxel, {r('avg(z)')} AS value FROM k GROUP BY voxel", seed(),
        "dr AS (SELECT i // 16 AS rep, ((i % 16) * 37 + (i // 16) * 11) % 64 AS t FROM range(80) q(i))",
        "p AS (SELECT voxel, rep, v, s.value AS sv FROM l JOIN s USING (t) JOIN dr USING (t))",
        f"k AS (SELECT voxel, rep, {fisher('c')} AS z FROM (SELECT voxel, rep, {PEARSON} AS c FROM p GROUP BY voxel, rep))"),
    "ttest_single": w(f"SELECT voxel, {r('avg(v) / nullif(stddev_samp(v) / sqrt(count(v)), 0)')} AS tvalue, count(v) - 1 AS df FROM l GROUP BY voxel"),
    "ttest_multi": w(f"SELECT label, t, {r('avg(v) / nullif(stddev_samp(v) / sqrt(count(v)), 0)')} AS tvalue, count(v) - 1 AS df FROM l GROUP BY label, t"),
    "regress_1": w(f"SELECT voxel, t, {r('v - (mv - slope * ms + slope * sv)')} AS value FROM p JOIN b USING (voxel)", *REG),
    "regress_1_fitted": w(f"SELECT voxel, t, {r('mv - slope * ms + slope * sv')} AS value FROM p JOIN b USING (voxel)", *REG),
    "regress_1_betas": w(f"SELECT voxel, {r('slope')} AS slope, {r('mv - slope * ms')} AS intercept FROM b", *REG),
    "regress_2": w(
        f"SELECT voxel, t, {r('v - mv - b1 * (u - mu) - b2 * (q - mq)')} AS value FROM p JOIN k USING (voxel)", seed(2, "s"), seed(7, "s7"),
        "p AS (SELECT voxel, t, v, s.value AS u, s7.value AS q FROM l JOIN s USING (t) JOIN s7 USING (t))",
        "c2 AS (SELECT voxel, covar_samp(u, u) AS uu, covar_samp(q, q) AS qq, covar_samp(u, q) AS uq, covar_samp(u, v) AS uv, covar_samp(q, v) AS qv, avg(v) AS mv, avg(u) AS mu, avg(q) AS mq FROM p GROUP BY voxel)",
        "k AS (SELECT voxel, mv, mu, mq, (qq * uv - uq * qv) / (uu * qq - uq * uq) AS b1, (uu * qv - uq * uv) / (uu * qq - uq * uq) AS b2 FROM c2)"),
    "regress_many": many_betas((1, 2, 3, 5, 7)),
    "bandpass": w(f"SELECT voxel, t, {r('v')} AS value FROM f", *kernel(1, 11, False)),
    "bandpass_convolution": w(f"SELECT voxel, t, {r('v')} AS value FROM f", *kernel(1, 11, False)),
    "bandpass_keepmean": w(f"SELECT voxel, t, {r('v')} AS value FROM f", *kernel(2, 11, True)),
    "attenuation_table": f"SELECT CAST(k AS INTEGER) AS bin, {r('k / 128.0')} AS freq, CASE WHEN k BETWEEN 1 AND 11 THEN 1.0::DOUBLE ELSE 0.0 END AS weight FROM range(33) q(k)",
    "attenuation_sigmoid": f"SELECT CAST(k AS INTEGER) AS bin, {r('k / 128.0')} AS freq, {r(f'1 - tanh(10.0 / 33 * {PI} * pow(greatest(1 - k, k - 11, 0), 2))')} AS weight FROM range(33) q(k)",
    "resample_floor": w(f"SELECT l.voxel, CAST(o.j AS INTEGER) AS t, {r('l.v')} AS value FROM l, range(0, 40) o(j) WHERE l.t = floor(1 + o.j * 1.5)"),
    "resample_lanczos": w(LANCZOS_T),
    "zscore_series": w(
        f"SELECT voxel, t, {r('coalesce((v - m) / CASE WHEN sd > 1e-12 THEN sd END, 0)')} AS value FROM l JOIN (SELECT voxel, avg(v) AS m, stddev_samp(v) AS sd FROM l GROUP BY voxel) USING (voxel)"),
    "rank_avg_ties": "SELECT vec_id, rank() OVER (PARTITION BY label ORDER BY lv) + (count(*) OVER (PARTITION BY label, lv) - 1) / 2 AS rank "
    "FROM (SELECT vec_id, label, floor(embedding[1] * 4) AS lv FROM embeddings)",
    "matrix_conversion": w(
        f"SELECT voxel, {r('abs(c)')} AS absolute, {r('greatest(c, 0.0)')} AS positive, {r('CASE WHEN c > 0 THEN 0.0 ELSE abs(c) END')} AS negative, "
        f"{r('c + abs(ln(1e-10 / (2 - 1e-10))) + 1e-10')} AS scaled FROM k", seed(),
        f"k AS (SELECT voxel, {PEARSON} AS c FROM (SELECT l.voxel, l.v, s.value AS sv FROM l JOIN s USING (t)) GROUP BY voxel)"),
    "cov_matrix_tt": w(f"SELECT a.t AS t1, b.t AS t2, {r('covar_samp(a.v, b.v)')} AS cov FROM l a JOIN l b USING (voxel) GROUP BY a.t, b.t"),
    "fd": fd(["c1", "c2", "c3", "c4", "c5", "c6"]),
    "fd_fsl": fd(["c4", "c5", "c6", "degrees(c1)", "degrees(c2)", "degrees(c3)"]),
    "value_range": w(f"SELECT {r('min(v)')} AS lo, {r('max(v)')} AS hi FROM l WHERE t >= 5"),
    "modal_hist": w("SELECT CAST(floor((v + 1) * 2000 * 4096 / 4095) AS INTEGER) AS bin, count(*) AS n FROM l WHERE (v + 1) * 2000 >= 0 AND (v + 1) * 2000 < 4095 GROUP BY ALL"),
    "modal_value": w(
        "SELECT bin AS modal FROM (SELECT CAST(floor((v + 1) * 2000 * 4096 / 4095) AS INTEGER) AS bin, count(*) AS n FROM l WHERE (v + 1) * 2000 >= 0 AND (v + 1) * 2000 < 4095 GROUP BY ALL) ORDER BY n DESC, bin LIMIT 1"),
    "dvars_range": w(
        f"SELECT t, {r('coalesce(sqrt(avg(d * d)), 0)')} AS dvars FROM q GROUP BY t", "m AS (SELECT * FROM l WHERE label = 2)",
        "g AS (SELECT min(v) AS lo, max(v) AS hi FROM m WHERE t >= 5)",
        "q AS (SELECT t, (v - lag(v) OVER (PARTITION BY voxel ORDER BY t)) / (SELECT nullif(hi - lo, 0) FROM g) AS d FROM m)"),
    "dvars_modal": w(
        f"SELECT t, {r('coalesce(sqrt(avg(d * d)), 0)')} AS dvars FROM q GROUP BY t", "m AS (SELECT voxel, t, (v + 1) * 2000 AS v FROM l WHERE label = 2)",
        "g AS (SELECT bin AS modal FROM (SELECT floor(v * 4096 / 4095) AS bin, count(*) AS n FROM m WHERE v >= 0 AND v < 4095 GROUP BY ALL) ORDER BY n DESC, bin LIMIT 1)",
        "q AS (SELECT t, (v - lag(v) OVER (PARTITION BY voxel ORDER BY t)) / (SELECT nullif(modal, 0) FROM g) AS d FROM m)"),
    "flag_dilate": w("SELECT t, flagged FROM fl", METRICS),
    "frame_map": w("SELECT t, new_t FROM fm", METRICS),
    "scrub": w(f"SELECT voxel, new_t AS t, {r('v')} AS v FROM l JOIN fm USING (t)", METRICS),
    "pad_const": w(f"SELECT g.t, g.x, g.y, g.z, {r('coalesce(mv.v, -1.0)')} AS v FROM g LEFT JOIN mv USING (t, x, y, z)", CELLS, MOVED(1, 0, 2), grid(9, 9, "n + 2")),
    "crop": w(f"SELECT g.t, g.x, g.y, g.z, {r('coalesce(mv.v, 0.0)')} AS v FROM g LEFT JOIN mv USING (t, x, y, z)", CELLS, MOVED(-2, -1, 0), grid(5, 4, "n - 4")),
    "pad_mirror": w(
        f"SELECT g.t, g.x, g.y, g.z, {r('c.v')} AS v FROM g JOIN c ON c.t = g.t AND c.x = {MIRROR('x', 8, 2)} AND c.y = {MIRROR('y', 8, 1)} AND c.z = {MIRROR('z', 'g.n', 0)}", CELLS, grid(11, 12, "n + 2")),
    "orient_flip": w(f"SELECT t, {r('v')} AS v, 7 - x AS x, z AS y, 7 - y AS z FROM c", CELLS),
    "grid_resample_mask": w(
        "SELECT g.x, g.y, g.z, m.weight FROM g JOIN m ON m.x = floor(CAST(8.0 AS FLOAT) / CAST(5.0 AS FLOAT) * CAST(g.x AS FLOAT)) "
        "AND m.y = floor(CAST(8.0 AS FLOAT) / CAST(5.0 AS FLOAT) * CAST(g.y AS FLOAT)) AND m.z = floor(CAST(g.n AS FLOAT) / CAST(g.nn AS FLOAT) * CAST(g.z AS FLOAT))",
        MASK, grid(5, 5, "ceil(11.0 * n / 8)", "")),
    "smooth_x": w(f"SELECT t, x, y, z, {r('v')} AS v FROM f1", FRAMES, smooth_pass("f0", "f1", "x")),
    "smooth_gauss": w(f"SELECT t, x, y, z, {r('v')} AS v FROM f3", FRAMES, smooth_pass("f0", "f1", "x"), smooth_pass("f1", "f2", "y"), smooth_pass("f2", "f3", "z")),
    "border_distance": w(
        f"SELECT a.x, a.y, a.z, {r('min(sqrt(9.0 * (pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))))')} AS dist FROM m a, bd b WHERE a.on_ = 1 GROUP BY a.x, a.y, a.z",
        "m AS (SELECT x, y, z, CASE WHEN label <= 4 THEN 1 ELSE 0 END AS on_ FROM e)",
        "bd AS (SELECT DISTINCT b.x, b.y, b.z FROM m b JOIN m a ON a.on_ = 1 AND b.on_ = 0 AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1)"),
    "rescale_dist8": w(f"SELECT tg.t, tg.id, {r('k.v / k.w')} AS value FROM tg LEFT JOIN k ON tg.t = k.t AND tg.id = k.id AND k.w > 0", CELLS, *targets((12, 8, "ceil(n * 0.75)")), corners(0, 1, DIST8, "k")),
    "interp_lanczos3": w(
        f"SELECT t, id, {r('value')} AS value FROM lz", CELLS, *targets((10, 10, "ceil(n * 1.25)")), *LANCZOS_XYZ),
    "interp_trilinear": w(f"SELECT tg.t, tg.id, {r('k.v')} AS value FROM tg LEFT JOIN k ON tg.t = k.t AND tg.id = k.id AND k.w > 1 - 1e-9", CELLS, *targets((10, 10, "ceil(n * 1.25)")), corners(0, 1, TRI, "k")),
    "mult_div": w(f"SELECT x, y, z, t, {r('v * (v * 2 + 1)')} AS product, {r('v / nullif(v * 2 + 1, 0)')} AS quotient FROM l"),
    "paste_regressors": w(f"SELECT t, {r('s.value')} AS r1, {r('s7.value')} AS r2 FROM s JOIN s7 USING (t)", seed(2), seed(7, "s7")),
    "supplier_corr": f"WITH {MONTHS} SELECT voxel, {r(fisher('c'))} AS value FROM (SELECT voxel, {PEARSON} AS c FROM p GROUP BY voxel)",
    "supplier_regress": f"WITH {MONTHS}, {REG[2]} SELECT voxel, {r('slope')} AS slope, {r('mv - slope * ms')} AS intercept FROM b",
    "events_daily": f"WITH {DAILY} SELECT voxel, t, {r('v')} AS v FROM dv",
    "events_ttest": f"WITH {DAILY}, q AS (SELECT voxel, round(v, 6) AS v FROM dv) SELECT voxel, {r('(avg(v) - 50) / nullif(stddev_samp(v) / sqrt(count(v)), 0)')} AS tvalue, count(v) - 1 AS df FROM q GROUP BY voxel",
    "flagship_dmn": w(
        f"SELECT voxel, {r(fisher('c'))} AS value FROM k", "s AS (SELECT t, avg(v) AS value FROM l GROUP BY t)", *REG[1:],
        "res AS (SELECT voxel, t, v - (mv - slope * ms + slope * sv) AS v FROM p JOIN b USING (voxel))", *kernel(1, 11, False, "res"), METRICS,
        "sc AS (SELECT voxel, new_t AS t, v FROM f JOIN fm USING (t))",
        "co AS (SELECT t, avg(v) AS value FROM sc WHERE voxel IN (SELECT voxel FROM e WHERE label = 2) GROUP BY t)",
        f"k AS (SELECT voxel, {PEARSON} AS c FROM (SELECT voxel, v, co.value AS sv FROM sc JOIN co USING (t)) GROUP BY voxel)"),
    "transform_chain": moved("cos(radians(5)) * x + sin(radians(5)) * y - 0.5", "cos(radians(5)) * y - sin(radians(5)) * x", "z + 1.0", "coalesce(2 * value, 0.0)"),
    "fugue_warp": moved("CAST(x AS DOUBLE)", "y - 1.0", "CAST(z AS DOUBLE)", "value"),
    "deoblique": w(
        f"SELECT lz.t, g.x, g.y, g.z, {r('value')} AS v FROM lz JOIN g USING (t, id)", CELLS, grid(12, 12, "n + 2"),
        "k0 AS (SELECT sin(radians(10)) AS s, cos(radians(10)) AS c)",
        "tg AS (SELECT t, id, k0.c * (x - 7 * s - 1) + s * (y - 1) AS px, k0.c * (y - 1) - s * (x - 7 * s - 1) AS py, z - 1.0 AS pz FROM g, k0)", *LANCZOS_XYZ),
}
