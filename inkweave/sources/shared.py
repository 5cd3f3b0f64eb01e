"""Intermediate tables in the folder that every executor can reach."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_written: list[tuple[SparkSession, str]] = []


def own_dir() -> str:
    """A folder of this process, removed when it ends; for local sessions."""
    global _own
    if _own is None:
        _own = tempfile.mkdtemp(prefix="inkweave-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session that names none gets one of its own, a cluster's is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
    return own_dir()


def clean(spark: SparkSession) -> int:
    """Remove the tables that store() wrote for this session; results that are still to be read from them must have been written elsewhere. Returns their number."""
    mine = [p for s, p in _written if s is spark]
    for path in mine:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _written[:] = [x for x in _written if x[0] is not spark]
    return len(mine)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, and the rows outlive executors. clean() removes what was written."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Remove the table that store() returned as df, once all that reads it has been written elsewhere."""
    spark = df.sparkSession
    files = df.inputFiles()
    for mine in [x for x in _written if x[0] is spark and any(f"/{x[1].rpartition('/')[2]}/" in f for f in files)]:
        p = spark._jvm.org.apache.hadoop.fs.Path(mine[1])
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _written.remove(mine)


def tidy(spark: SparkSession) -> None:
    """Give up the shuffle files of what has been written: Spark removes them when the driver collects its garbage, which in a long loop may be never."""
    gc.collect()
    spark._jvm.System.gc()


def parallel(spark: SparkSession) -> int:
    """Shuffle partitions set for the session; at least the number of task slots."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
