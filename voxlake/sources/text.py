"""Text inputs: regressor tables, single columns, index lists, matrices and settings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, n, line of text files: n counts the lines that are not blank, from 0. A last line without an end is kept.

    The whole file is one value, as its lines are numbered; regressor files have one line per frame.
    """
    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\r\n|\n|\r").alias("l"))
    kept = F.filter("l", lambda s: F.trim(F.translate(s, "\t", " ")) != "")
    return t.select("path", F.posexplode(kept).alias("n", "line"))


def regressors(spark: SparkSession, path: str, constant: bool = True) -> DataFrame:
    """path, t, r, value of a table with space or tab between its columns; r = 0 is the constant 1."""
    cells = F.transform(F.split(F.regexp_replace("line", r"^[ \t]+|[ \t]+$", ""), r"[ \t]+"), lambda s: s.try_cast("double"))
    values = F.concat(F.array(F.lit(1.0)), cells) if constant else cells
    return lines(spark, path).select("path", F.col("n").alias("t"), F.posexplode(values).alias("r", "value"))


def column(spark: SparkSession, path: str) -> DataFrame:
    """t, value of a file with one number per line."""
    return lines(spark, path).select(F.col("n").alias("t"), F.trim("line").try_cast("double").alias("value"))


def local_column(spark: SparkSession, text) -> DataFrame:
    """The same from lines at hand, such as standard input."""
    rows = [float(s) for s in text if s.strip()]
    return spark.createDataFrame(list(enumerate(rows)), "t int, value double")


def index_list(spark: SparkSession, path: str, frames: int) -> DataFrame:
    """t of a file with one frame number per line; a number outside the image is an error."""
    t = F.round(F.trim("line").cast("double")).cast("int")
    bad = F.raise_error(F.concat(F.lit("no such frame: "), t.cast("string")))
    return lines(spark, path).select(F.when((t >= 0) & (t < frames), t).otherwise(bad.cast("int")).alias("t")).distinct()


def matrix(path: str) -> np.ndarray:
    """A small matrix of text, one row per line."""
    return np.loadtxt(path, ndmin=2)


def settings(path: str) -> dict[str, str]:
    """key=value lines with # comments; the last value of a key counts."""
    out = {}
    with open(path) as f:
        for s in f:
            s = s.split("#", 1)[0].strip()
            if "=" in s:
                k, v = s.split("=", 1)
                out[k.strip()] = v.strip()
    return out


def write_column(df: DataFrame, path: str, value: str = "value", form: str = "%e") -> None:
    """One number per line in the order of t."""
    df.orderBy("t").select(F.format_string(form, F.col(value)).alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def write_table(df: DataFrame, path: str, columns: list[str], form: str = "%.10f") -> None:
    """Tab-separated columns in the order of the first."""
    out = df.orderBy(columns[0]).select(F.concat_ws("\t", *[F.format_string(form, F.col(c).cast("double")) for c in columns]).alias("value"))
    out.coalesce(1).write.mode("errorifexists").text(path)


def write_flagged(flags: DataFrame, path: str) -> None:
    """Numbers of the flagged frames, one per line."""
    flags.where("flagged = 1").orderBy("t").select(F.col("t").cast("string").alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def paste(*columns: DataFrame) -> DataFrame:
    """Columns (t, value) glued side by side as t, r1, r2, ..."""
    out = None
    for i, c in enumerate(columns, 1):
        c = c.select("t", F.col("value").alias(f"r{i}"))
        out = c if out is None else out.join(c, "t")
    return out


def numbered(df: DataFrame, order: str, out: str = "t") -> DataFrame:
    """Dense numbers from 0 in the order of a column; for tables of one row per frame."""
    return df.withColumn(out, F.row_number().over(W.orderBy(order)) - 1)
