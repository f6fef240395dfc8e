"""Tables staged in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_homes: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, the context's checkpoint folder, and for a local master a new one. On a cluster without either it is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    context = sc._jsc.sc().getCheckpointDir()
    if not context.isDefined():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
        context = sc._jsc.sc().getCheckpointDir()
    return context.get().rstrip("/")


def small_batches(spark: SparkSession, limit: int = 2 << 20) -> None:
    """Hold the session's Arrow batches to 2 MB of data, so that Python workers stay small whatever the rows' length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key)) or 0) > limit:
        spark.conf.set(key, str(limit))


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean_up() -> None:
    spark = SparkSession.getActiveSession()
    if spark and spark.sparkContext._jsc:
        for home in _homes:
            delete(spark, home)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that nobody uses yet, below the application's own folder, which goes when the driver's Python ends."""
    home = f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"
    if not _homes:
        atexit.register(_clean_up)
    _homes.add(home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: later steps start from there, and a lost executor costs nothing that was written."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
