"""Stratified folds of groups, and cross-validation over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import metrics
from quern.operators.records import numbered
from quern.operators.shared import keep

#: Classes whose counts a group carries, and groups that are placed one after another by the driver.
MOST_CLASSES, LARGE = 1024, 10_000


def class_counts(rows: DataFrame, group: str, label: str) -> tuple[DataFrame, list[int]]:
    """((group, counts), totals): of each group its rows by class, in the order of classes; no null group or label."""
    cells = rows.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    totals = cells.groupBy(label).agg(F.sum("n").alias("n")).orderBy(label).limit(MOST_CLASSES + 1).collect()
    if len(totals) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    found = F.map_from_entries(F.collect_list(F.struct(label, "n")))
    named = cells.groupBy(group).agg(found.alias("_found"))
    counts = F.array(*[F.coalesce(F.try_element_at("_found", F.lit(r[0])), F.lit(0)) for r in totals])
    return named.select(group, counts.cast("array<long>").alias("counts")), [r["n"] for r in totals]


def place(counts: list[tuple[int, ...]], totals: list[int], folds: int) -> list[int]:
    """The fold of each group in turn: the one in which the classes that it has are least frequent so far.

    With shares s = rows of a class in a fold / rows of the class, a group adds least to the sum of all s * s (whose mean is fixed, so to their
    variance) where the sum of its shares times the fold's is least. Ties go to the fold with fewer rows, then the lower one.
    """
    held = [[0] * len(totals) for _ in range(folds)]
    size, out = [0] * folds, []
    for group in counts:
        gain = [sum(g * h / (t * t) for g, h, t in zip(group, fold, totals, strict=True) if g) for fold in held]
        best = min(range(folds), key=lambda f: (round(gain[f], 12), size[f], f))
        held[best] = [h + g for h, g in zip(held[best], group, strict=True)]
        size[best] += sum(group)
        out.append(best)
    return out


def stratified_folds(rows: DataFrame, group: str, label: str, folds: int = 5) -> DataFrame:
    """(group, fold): every group in one fold, with the classes' shares alike in all.

    Only groups' counts by class are used. The ``LARGE`` groups with the largest shares (sum of squares, ties by counts, then group) are placed one
    after another as in ``place``. The others are dealt in turn in the order of their counts, so that of each kind of group folds hold as many but for
    one. Rows without group or label take no part.
    """
    found, totals = class_counts(rows, group, label)
    share = F.lit(0.0)
    for i, t in enumerate(totals):
        share = share + F.pow(F.get("counts", F.lit(i)) / t, F.lit(2))
    order = [F.col("_share").desc(), F.col("counts").desc(), F.col(group)]
    found = keep(found.withColumn("_share", F.round(share, 12)), "groups")
    spark = rows.sparkSession
    large = found.orderBy(*order).limit(LARGE).collect()
    fixed = place([tuple(r["counts"]) for r in large], totals, folds)
    kind = found.schema[group].dataType.simpleString()
    placed = spark.createDataFrame([(r[group], f) for r, f in zip(large, fixed, strict=True)], f"`{group}` {kind}, fold int")
    if len(large) < LARGE:
        return placed
    rest = numbered(found.join(F.broadcast(placed), group, "left_anti").withColumn("_share", -F.col("_share")), ["_share", "counts", group])
    return placed.unionByName(rest.select(group, (F.col("position") % folds).cast("int").alias("fold")))


def cross_validate(rows: DataFrame, group: str, label: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], folds: int = 5) -> DataFrame:
    """(fold, train_rows, test_rows, accuracy, macro_f1): for each fold a model of the others, measured on it.

    ``fit`` takes the training rows and returns what adds ``predicted`` to a DataFrame.
    """
    dealt = keep(rows.join(stratified_folds(rows, group, label, folds), group), "folds")
    n, out = dealt.count(), None
    for k in range(folds):
        test = dealt.where(F.col("fold") == k).drop("fold")
        counts = metrics.confusion(fit(dealt.where(F.col("fold") != k).drop("fold"))(test), label, "predicted")
        size = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("test_rows"), F.try_divide(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
        macro = metrics.per_class(counts).where("support > 0").agg(F.avg("f1").alias("macro_f1"))
        one = size.crossJoin(macro).select(F.lit(k).alias("fold"), (n - F.col("test_rows")).alias("train_rows"), "test_rows", "accuracy", "macro_f1")  # one row each
        out = one if out is None else out.unionByName(one)
    return out


def spread_of(scores: DataFrame, column: Column) -> DataFrame:
    """The mean of a score over folds and its deviation (of the population)."""
    return scores.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("deviation"))
