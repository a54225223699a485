"""Tables, the shared folder and Arrow loops used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SETTING = "spark.checkpoint.dir"
#: Rows of a batch that are looked at together, so that memory follows these and not the Arrow batch.
STEP = 256


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only in local mode, as in tests, where the session names none."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set(_SETTING, folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, which goes when the session ends."""
    path = f"{shared_folder(spark)}/quern-{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone, and its files with it
        return


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each job run herein when the job ends, since only its output is read on."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before) if before is not None else spark.conf.unset(setting)


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it cuts lineage and outlives a lost executor."""
    path = new_folder(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``keep`` returned, once nothing reads them any more."""
    for f in frames:
        if path := getattr(f, "_kept_at", None):
            remove(f.sparkSession, path)


def look_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str, hot: int = 1024) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and in ``weight`` how many of ``rows`` have it.

    Keys that more than 1 / ``hot`` of the rows have are fewer than ``hot``: these are broadcast, so their rows don't meet in a task.
    The other rows are joined by shuffling.
    """
    line = (table.agg(F.sum(weight)).first()[0] or 0) // hot
    often, seldom = table.where(F.col(weight) > line).drop(weight), table.where(F.col(weight) <= line).drop(weight)
    rest = rows.join(F.broadcast(often.select(*on)), on, "left_anti").join(seldom, on)
    return rows.join(F.broadcast(often), on).unionByName(rest)


_cached: dict = {}


def cached(key: tuple, make: Callable[[], object]) -> object:
    """What this worker process keeps under ``key`` from one task to the next."""
    if key not in _cached:
        _cached.clear()
        _cached[key] = make()
    return _cached[key]


def release() -> None:
    """Let go of what an earlier operator's tasks kept; workers outlive operators, and their memory is shared out once."""
    _cached.clear()
    trim()


def trim() -> None:
    """Hand freed memory back to the system, where its C library can; an executor's workers share one limit."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema, keeps: bool = False) -> DataFrame:
    """``mapInArrow`` over at most ``STEP`` rows at a time; ``make`` runs once for each task and returns what maps a batch.

    ``keeps`` is for what uses ``cached`` itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                out = step(batch.slice(at, STEP))
                if out is not None and out.num_rows:
                    yield out
            trim()

    return df.mapInArrow(run, schema)


def with_fields(df: DataFrame, **fields: T.DataType) -> T.StructType:
    """The schema of ``df`` and further fields after it."""
    return T.StructType([*df.schema.fields, *[T.StructField(k, v) for k, v in fields.items()]])


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column; null as empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or where ``df`` has such a column, whatever the case, ``name`` with a number that it hasn't."""
    taken = {c.lower() for c in df.columns}
    return next(c for c in [name, *(f"{name}_{i}" for i in range(len(taken) + 1))] if c.lower() not in taken)


def id_text(column) -> "F.Column":
    """A document's id as text; null as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def remainder(column, by: int):
    """crc32 of the id's text modulo ``by``."""
    return F.crc32(id_text(column).cast("binary")) % F.lit(by)
