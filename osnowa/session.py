"""Session settings, table access and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Defaults for sessions this library opens itself; a session handed in keeps its own settings.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def open_session(app: str = "osnowa", master: str = "local[8]", **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app).master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset, a folder of one's own: in local mode, where all share the machine, a temporary one; on a cluster
    one in the home folder of the default file system, and an error if that file system is a machine's own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("osnowa.shared.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        folder = "file:" + tempfile.mkdtemp(prefix="osnowa-")
    else:
        fs, _ = _file_system(spark, ".")
        if fs.getUri().getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{fs.getHomeDirectory().toString()}/osnowa-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, folder)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    spark.conf.set("osnowa.shared.dir", folder)
    return folder


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run in here removes its shuffle files as soon as it ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def cut(df: DataFrame, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Writes ``df`` as a parquet table into the shared folder and reads it back: the lineage ends there.

    Unlike a local checkpoint the result outlives any executor. ``by`` repartitions first, so equal keys share a file. The table
    is deleted when the session's file system closes, whatever file system it is; shuffle files are gone once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    if by:
        df = df.repartition(parts, *by) if parts else df.repartition(*by)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


def default_parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


__all__ = ["DEFAULTS", "open_session", "table", "shared_folder", "shuffles_removed", "cut", "default_parallelism"]
