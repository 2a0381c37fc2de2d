"""Files of the cluster's file system, through Spark's own configuration of it."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.  Only where that is unset, on one machine (tests), a temporary one is made."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="fathomdex-")
        atexit.register(shutil.rmtree, where, True)
    sc.setCheckpointDir(where)
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder, so that a lost executor costs nothing that is read again."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def size(spark: SparkSession, path: str) -> int:
    p, fs = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def names(spark: SparkSession, path: str) -> list[str]:
    p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed, so that a reader never sees half of it."""
    p, fs = _fs(spark, path + ".new")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, False)
    fs.rename(p, target)


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
