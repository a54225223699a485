"""Incremental runs as streams: corrections in layers, resumed appends, and windows over events.

These extend the batch operators; a stream that has seen all files holds what the batch operator gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from quern.operators import records


def read(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def latest_wins(stream: DataFrame, folder: str, checkpoint: str, key: list[str], order: list[str], buckets: int = 64) -> StreamingQuery:
    """Keep the latest row of each key in a table below ``folder``, of which a batch rewrites only the buckets that it touches.

    Keys are dealt over ``buckets`` by hash. A micro-batch reads the newest version of the buckets of its keys, and writes these anew
    below its own number; the others stay where they are. A batch that is repeated after a failure sees what was there before it and writes
    the same again. ``current`` reads the table.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # ``buckets`` at most
        if not touched:
            return
        old = current(spark, folder, batch.schema, before=number)
        rows = new if old is None else new.unionByName(old.where(F.col("bucket").isin(touched)))
        best = records.latest(rows, [*key, "bucket"], [F.col(c) for c in order]).drop("copies")
        best.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, schema: StructType, before: int | None = None) -> DataFrame | None:
    """The rows of a table that ``latest_wins`` keeps, with their bucket: of each the version of the last batch (under ``before``) that has it; None if there is none."""
    whole = StructType([*schema.fields, StructField("batch", LongType()), StructField("bucket", IntegerType())])
    try:
        rows = spark.read.schema(whole).option("basePath", folder).parquet(folder)
    except AnalysisException as e:  # no batch has been written
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    rows = rows if before is None else rows.where(F.col("batch") < before)
    newest = {r["bucket"]: r["batch"] for r in rows.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}  # a row for each bucket
    if not newest:
        return None
    by_batch: dict[int, list[int]] = {}
    for bucket, number in newest.items():
        by_batch.setdefault(number, []).append(bucket)
    wanted = F.lit(False)
    for number, some in sorted(by_batch.items()):  # on partition columns alone, so other versions aren't read
        wanted = wanted | ((F.col("batch") == number) & F.col("bucket").isin(some))
    return rows.where(wanted).drop("batch")


def append_pending(stream: DataFrame, path: str, checkpoint: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Compute and append rows whose key isn't there yet."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.parquet(path).select(key)
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            done = None
        new = batch.dropDuplicates([key])
        compute(new if done is None else records.pending(new, done, key)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type and window, for streams and tables; events later than ``late`` are dropped from streams."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's runs of events with no pause of ``gap`` or more."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")
