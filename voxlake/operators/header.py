"""Extended image headers: lookup, change, typed values, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

KEYS = ["header_id", "image", "site", "loaded_at"]


def column_of(headers: DataFrame, key: str) -> str:
    """The column of a key, whatever its case."""
    found = [c for c in headers.columns if c.lower() == key.lower()]
    if not found:
        raise KeyError(f"no header field {key}")
    return found[0]


def lookup(headers: DataFrame, key: str) -> DataFrame:
    """image, value of one field as text; the latest header of an image counts."""
    value = F.col(column_of(headers, key)).cast("string")
    return headers.groupBy("image").agg(F.max_by(value, F.struct("loaded_at", "header_id")).alias("value"))


def entries(headers: DataFrame, fields: list[str]) -> DataFrame:
    """header_id, key, value of the fields that are set."""
    pairs = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).cast("string").alias("value")) for f in fields])
    return headers.select("header_id", F.explode(pairs).alias("e")).select("header_id", "e.key", "e.value").where("value is not null and value <> ''")


def with_values(headers: DataFrame, assignments: list[str]) -> DataFrame:
    """Fields set from ``key=value`` texts with exactly one equals sign each."""
    for a in assignments:
        if a.count("=") != 1:
            raise ValueError(f"{a}: needs exactly one =")
        key, value = a.split("=")
        c = column_of(headers, key.strip())
        headers = headers.withColumn(c, F.lit(value).cast(headers.schema[c].dataType))
    return headers


def repetition_seconds(headers: DataFrame) -> DataFrame:
    """header_id, tr in seconds: the text is in ms, but values under 20 are seconds already."""
    v = F.col("repetitiontime").try_cast("double")
    return headers.select("header_id", F.when(v >= 20, v / 1000).when(v > 0, v).alias("tr"))


def dwell_times(headers: DataFrame) -> DataFrame:
    """header_id, dwell from phase-encoding lines and bandwidth where both are positive."""
    lines = F.col("phaseencodinglines").try_cast("double")
    bw = F.col("bandwidthperpixelphaseencode")
    return headers.select("header_id", F.when((lines > 0) & (bw > 0), 1 / (lines * bw)).alias("dwell"))


def latest(headers: DataFrame, keys: list[str]) -> DataFrame:
    """The last loaded header per key, all its fields."""
    s = F.max_by(F.struct(*headers.columns), F.struct("loaded_at", "header_id")).alias("h")
    return headers.groupBy(*keys).agg(s).select("h.*")


def add_comment(comments, text: str, version: str):
    """A provenance array with an entry appended: when, by what version, what was called."""
    entry = F.struct(F.date_format(F.current_timestamp(), "yyyy/MM/dd HH:mm:ss").alias("ts"), F.lit(version).alias("version"), F.lit(text).alias("call"))
    return F.concat(F.coalesce(comments, F.array().cast("array<struct<ts:string,version:string,call:string>>")), F.array(entry))
