"""Tables between two parts of a job, written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: Text tables of up to so many bytes are dealt over all cores, as they may lie in one row group that one task would read.
SPREAD_BYTES = 64 << 20


def folder(spark: SparkSession) -> str:
    """The shared folder; one is made only in local mode, where the session names none."""
    path = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set(_SETTING, path)
    return path


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, which is deleted when the session's process ends."""
    path = f"{folder(spark)}/quern-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone, and its files with it
        return


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here, and its rows stay what they are."""
    path = fresh_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def keep_buckets(df: DataFrame, label: str, buckets: int, *on: str) -> DataFrame:
    """``df`` kept in ``buckets`` by ``on``: joins and groups by these columns don't shuffle it again."""
    path = fresh_folder(df.sparkSession, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(buckets, *on).format("parquet").option("path", path).saveAsTable(name)
    out = df.sparkSession.table(name)
    out._kept_at, out._table = path, name
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the files of frames that ``keep`` returned, once nothing reads them."""
    for f in frames:
        if path := getattr(f, "_kept_at", None):
            if name := getattr(f, "_table", None):
                f.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")  # the catalogue's entry; the files lie outside the warehouse
            _remove(f.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its files have up to ``SPREAD_BYTES``; larger ones have parts of their own."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def look_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str, hot: int = 1024) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in ``weight`` about how many of ``rows`` have it.

    Keys with more than 1 / ``hot`` of all weight are fewer than ``hot``: these are broadcast, so their rows don't meet in a task. The others
    are joined by shuffling.
    """
    line = (table.agg(F.sum(weight)).first()[0] or 0) // hot
    often, seldom = table.where(F.col(weight) > line), table.where(F.col(weight) <= line)
    rest = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(seldom, on)
    return rows.join(F.broadcast(often), on).unionByName(rest)
