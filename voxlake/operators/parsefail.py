"""Rows that fail to parse, separated with a reason while the valid rows load as numbers.

The lines are exploded to (line, column, value) cells, the line as a whole being column 0. The cells are joined
with the rule table by scope and every rule is evaluated on them from its own row: a pattern the text must match
and whether it must read as a finite number. The violations of a line are aggregated to the reason of the first
rule it breaks, and the clean cells are the anti-join with the failed lines. All of it stays in JVM code.
Violations are few and pre-aggregate before their shuffle; when numbers are loaded, the lines are shuffled once
by line_id, before they are exploded, and cells, violations and anti-join stay on that partitioning.

Defined cases: a null or blank line is no row and no failure; a line whose file is unknown has no
column count to meet and fails with ``column_count``; repeated lines with one ``line_id`` count once;
extra columns on either input are ignored; numbers beyond the double range are not finite, so invalid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
#: scope (a cell, or the line as "cells/columns due"), pattern to match, whether it must be a finite number, reason, priority.
RULES = (
    ("cell", r'\A([^"]*|"[^"]*")\z', False, "quoting", 1),
    ("line", r"\A([0-9]+)/\1\z", False, "column_count", 2),
    ("cell", rf'\A(?:{NUMBER}|"{NUMBER}")\z', True, "invalid_value", 3),
)


def _rows(lines: DataFrame, files: DataFrame) -> DataFrame:
    f = files.groupBy("file_id").agg(F.max("n_columns").alias("n_columns"))
    body = F.regexp_replace(F.regexp_replace("raw", r"\r\z", ""), r"\A[ \t]+|[ \t]+\z", "")
    rows = lines.select("line_id", "file_id", "line_no", body.alias("body")).where("body <> ''").join(f, "file_id", "left")
    return rows.select("line_id", "file_id", "line_no", "n_columns", F.split("body", r"[ \t]+").alias("cells"))


def _exploded(rows: DataFrame) -> DataFrame:
    due = F.concat(F.size("cells"), F.lit("/"), F.coalesce(F.col("n_columns").cast("string"), F.lit("?")))
    cells = rows.select("line_id", "file_id", "line_no", F.posexplode(F.concat(F.array(due), "cells")).alias("col", "text"))
    quoted = F.col("text").startswith('"') & F.col("text").endswith('"') & (F.length("text") > 1)
    bare = F.when(quoted, F.expr("substring(text, 2, length(text) - 2)")).otherwise(F.col("text"))
    number = F.when((F.col("col") > 0) & bare.rlike(rf"\A{NUMBER}\z"), bare).try_cast("double")
    cells = cells.withColumn("number", number)
    finite = F.abs("number") < F.lit(float("inf"))
    return cells.select("line_id", "file_id", "line_no", "col", "text", F.when(finite, F.col("number")).alias("value"))


def parse_cells(lines: DataFrame, files: DataFrame) -> DataFrame:
    """One row per cell: line_id, file_id, line_no, col (1-based), text and value (null if it is no finite number);
    the line as a whole is column 0, its text the cells it has over the cells due."""
    return _exploded(_rows(lines, files))


def rule_table(df: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """The rules as a table."""
    return df.sparkSession.createDataFrame(list(rules), "scope string, pattern string, finite boolean, reason string, priority int")


def violations(cells: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """(line_id, col, reason, priority): every rule a cell breaks."""
    scope = F.when(F.col("col") == 0, "line").otherwise("cell")
    tried = cells.withColumn("scope", scope).join(F.broadcast(rule_table(cells, rules)), "scope")
    met = F.rlike("text", F.col("pattern")) & (~F.col("finite") | F.col("value").isNotNull())
    return tried.where(~met).select("line_id", "col", "reason", "priority")


def failed_lines(cells: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """(line_id, reason) of every line with a violation, the first rule that holds."""
    return violations(cells, rules).groupBy("line_id").agg(F.min_by("reason", "priority").alias("reason"))


def loaded_cells(lines: DataFrame, files: DataFrame, rules: Sequence[tuple] = RULES) -> DataFrame:
    """The numbers of the lines without a violation: file_id, line_id, line_no, col, value (one copy per line_id)."""
    cells = _exploded(_rows(lines, files).repartition("line_id").dropDuplicates(["line_id"]))
    clean = cells.where("col > 0").join(failed_lines(cells, rules), "line_id", "left_anti")
    return clean.select("file_id", "line_id", "line_no", "col", "value")
