"""Operators over keyed records: versions, differences, merges, numbering and fan-out.

Each takes and returns DataFrames and leaves the physical plan to Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.shared import keep


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row that comes last by ``order``, with ``copies``, the number of its rows."""
    last = Window.partitionBy(*key).orderBy(*[c.desc() for c in order])
    every = Window.partitionBy(*key)
    return rows.withColumn("copies", F.count("*").over(every)).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with a flag for keys that occur again."""
    return rows.withColumn("repeated", F.count("*").over(Window.partitionBy(*key)) > 1)


def merge_facts(content: DataFrame, facts: DataFrame, key: str, failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(content with its facts, excluded rows with a reason): failed rows go first, then those without facts."""
    excluded = []
    if failed is not None:
        excluded.append(content.join(failed.select(key).distinct(), key, "left_semi").select(key, F.lit("failed validation").alias("reason")))
        content = content.join(failed.select(key).distinct(), key, "left_anti")
    excluded.append(content.join(facts, key, "left_anti").select(key, F.lit("not in manifest").alias("reason")))
    out = excluded[0] if len(excluded) == 1 else excluded[0].unionByName(excluded[1])
    return content.join(facts, key), out


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    return expected.join(found.select(key), key, "left_anti").select(key, F.lit("missing").alias("reason"))


def pending(every: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """What is still to do, in key order; ``limit`` is a batch's size."""
    left = every.join(done.select(key), key, "left_anti")
    return left if limit is None else left.orderBy(key).limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new``: columns that ``new`` has are taken from it, nulls too; the others stay."""
    sent = [c for c in new.columns if c != key]
    renamed = new.select(F.col(key), F.lit(True).alias("_sent"), *[F.col(c).alias(f"_new_{c}") for c in sent])
    both = old.join(renamed, key, "full_outer")
    pick = {c: F.when(F.col("_sent"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in old.columns else F.col(f"_new_{c}") for c in sent}
    return both.select(key, *[pick.get(c, F.col(c)).alias(c) for c in [*[c for c in old.columns if c != key], *[c for c in sent if c not in old.columns]]])


def with_vectors(records: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Each record with its vector; a record without one is an error when the row is read."""
    joined = records.join(vectors.withColumn("_has", F.lit(True)), key, "left")
    checked = F.when(F.col("_has"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no vector for "), F.col(key).cast("string"))).cast("boolean"))
    return joined.where(checked).drop("_has")


def difference(wanted: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key, action): create, update, unchanged or extra."""
    fields = [c for c in wanted.columns if c != key]
    a = wanted.select(F.col(key), F.lit(True).alias("_wanted"), *[F.col(c).alias(f"_w_{c}") for c in fields])
    b = existing.select(F.col(key), F.lit(True).alias("_there"), *fields)
    same = F.lit(True)
    for c in fields:
        same = same & F.col(f"_w_{c}").eqNullSafe(F.col(c))
    action = F.when(F.col("_there").isNull(), "create").when(F.col("_wanted").isNull(), "extra").when(same, "unchanged").otherwise("update")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def fan_out(rows: DataFrame, kinds: dict[str, Column], into: str = "kind") -> DataFrame:
    """A row of each kind whose condition holds."""
    return rows.withColumn(into, F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in kinds.items()]))))


def numbered(rows: DataFrame, order: list[str], into: str = "position") -> DataFrame:
    """``rows`` with their place from 0 by unique ``order``, without bringing all rows together.

    Rows are ranged by ``order``; each range counts itself, and only the counts are summed up in order. The ranged
    rows are written to the shared folder, because the bounds of ranges are sampled anew by every evaluation.
    """
    ranged = keep(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")
    ranged = ranged.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(starts, "_range").withColumn(into, (F.col("_start") + F.col("_in")).cast("long")).drop("_range", "_in", "_size", "_start")


def slices(rows: DataFrame, order: list[str], size: int = 50, per_batch: int = 10) -> DataFrame:
    """``rows`` with their slice of ``size`` and its batch and message names."""
    placed = numbered(rows, order)
    number = F.floor(F.col("position") / size)
    batch = F.lpad((F.floor(number / per_batch) + 1).cast("string"), 2, "0")
    message = F.lpad((number % per_batch + 1).cast("string"), 2, "0")
    return placed.withColumn("batch_id", F.concat(F.lit("B"), batch, F.lit("-M"), message))


def slice_index(rows: DataFrame, key: str) -> DataFrame:
    """The first and last key and the number of rows of each slice."""
    return rows.groupBy("batch_id").agg(F.min_by(key, "position").alias("first_id"), F.max_by(key, "position").alias("last_id"), F.count("*").alias("n_rows"))


def first_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int, into: str = "rank") -> DataFrame:
    """The first ``n`` of each group; Spark drops others before the shuffle."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(into) <= n)


def round_robin(rows: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The first of each group, then the second of each, and so on, up to ``limit``."""
    turn = first_per_group(rows, [group], order, limit, "round")
    return turn.orderBy("round", group).limit(limit)


def in_given_order(ids: DataFrame, index: DataFrame, key: str, array: str) -> DataFrame:
    """The rows of ``index`` for an array of keys, with their place; keys that aren't there are left out."""
    return ids.select(*[c for c in ids.columns if c != array], F.posexplode(array).alias("place", key)).join(index, key)


def sources_first(rows: DataFrame, source: str, key: str) -> DataFrame:
    """Rows that others refer to come before those that refer."""
    return rows.orderBy(F.col(source).isNotNull(), key)


def violations(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that should be unique and aren't, with their counts."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def first_distinct(rows: DataFrame, group: str, value: Column, order: str, n: int) -> DataFrame:
    """The first ``n`` rows by ``order`` of each group that differ in ``value``, with their place from 1."""
    one = rows.withColumn("_copy", F.row_number().over(Window.partitionBy(group, value).orderBy(order))).where("_copy = 1").drop("_copy")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("place") <= n)
