"""Queries of the general training-data operators: pN_... for problems 1, 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import parsefail, spikes, units
from ..session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    cells = parsefail.parse_cells(table(spark, d, "regressor_line"), table(spark, d, "regressor_file"))
    return parsefail.failed_lines(cells)


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return parsefail.loaded_cells(table(spark, d, "regressor_line"), table(spark, d, "regressor_file"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(table(spark, d, "realignment"), table(spark, d, "motion_metric"))


def _units(spark: SparkSession, d: str) -> DataFrame:
    return units.source_links(*[table(spark, d, n) for n in ("realignment", "motion_metric", "scrub_run", "image_header")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return units.found_units(_units(spark, d))


def p5_converted(spark: SparkSession, d: str) -> DataFrame:
    out = units.converted(table(spark, d, "realignment"), _units(spark, d))
    return out.select("run_id", "t", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "pitch", "roll", "yaw")])


def p5_sources(spark: SparkSession, d: str) -> DataFrame:
    """Scale, offset and residual of the two sources of every run, the snapped units and where they come from."""
    return _units(spark, d)


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p4_found, p5_found, p5_converted, p5_sources)}

_CELLS = r"""
WITH f AS (SELECT file_id, max(n_columns) AS n_columns FROM regressor_file GROUP BY file_id),
b AS (
  SELECT l.line_id, l.file_id, l.line_no, f.n_columns,
         regexp_replace(regexp_replace(l.raw, '\r$', ''), '^[ \t]+|[ \t]+$', '', 'g') AS body
  FROM regressor_line l LEFT JOIN f USING (file_id)),
r AS (SELECT *, regexp_split_to_array(body, '[ \t]+') AS cells FROM b WHERE body <> ''),
c AS (SELECT line_id, file_id, line_no, n_columns, len(cells) AS n, unnest(cells) AS cell, generate_subscripts(cells, 1) AS col FROM r),
k AS (
  SELECT *, contains(cell, '"') AND NOT regexp_full_match(cell, '"[^"]*"') AS broken,
         CASE WHEN starts_with(cell, '"') THEN substr(cell, 2, greatest(length(cell) - 2, 0)) ELSE cell END AS bare FROM c),
v AS (
  SELECT *, CASE WHEN NOT broken AND regexp_full_match(bare, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
            THEN try_cast(bare AS DOUBLE) END AS number FROM k),
w AS (SELECT *, CASE WHEN isfinite(number) THEN number END AS value FROM v),
bad AS (
  SELECT line_id, CASE WHEN bool_or(broken) THEN 'quoting' WHEN bool_or(n IS DISTINCT FROM n_columns) THEN 'column_count'
                  WHEN bool_or(value IS NULL) THEN 'invalid_value' END AS reason
  FROM w GROUP BY line_id)
"""

ORACLE = {
    "p1_found": _CELLS + "SELECT line_id, reason FROM bad WHERE reason IS NOT NULL",
    "p1_loaded": _CELLS
    + "SELECT DISTINCT ON (line_id, col) file_id, line_id, line_no, CAST(col AS INTEGER) AS col, value FROM w "
    "WHERE line_id IN (SELECT line_id FROM bad WHERE reason IS NULL)",
}
