"""Session, table and checkpoint helpers shared by all queries."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def worker_cache(key, build):
    """``build()`` once per Python worker process, kept across tasks by ``key``."""
    kept = sys.modules["__main__"].__dict__.setdefault("_voxlake_cache", {})
    if key not in kept:
        kept[key] = build()
    return kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory; columns and rows are pruned by Catalyst, not here."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    ``spark.checkpoint.dir`` wins. Only where nothing is set and the session is local (tests) a
    temporary folder is used; a cluster without the setting is an error, as its executors share no
    machine-local folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    d = os.path.join(tempfile.gettempdir(), f"voxlake-{os.getuid()}-checkpoints")
    spark.conf.set("spark.checkpoint.dir", d)
    return d


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, read back: computed once, its lineage cut."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bytes_of(table: DataFrame) -> int:
    """Bytes of the files a written table stands in: what its readers' size estimate starts from."""
    jvm = table.sparkSession.sparkContext._jvm
    conf = table.sparkSession._jsparkSession.sessionState().newHadoopConf()
    total = 0
    for f in table.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


#: What a row takes in memory over its bytes in a compressed file, at most, as far as the check is concerned.
UNPACKED = 8


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str, limit: int) -> DataFrame:
    """A join whose right side, a written table, is broadcast only if it takes at most ``limit`` bytes unpacked."""
    few = UNPACKED * bytes_of(right) <= limit
    return left.join(F.broadcast(right) if few else right.hint("merge"), on, how)


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder, its lineage cut; survives a lost executor."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
