"""Metrics of classification and retrieval as aggregates.

Curves are built from counts by distinct score, so a hot score is one row, and the running sums go over
ranges of scores rather than over all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numeric import safe_ratio
from quern.operators.shared import keep


def confusion(rows: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    return rows.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def binary_counts(rows: DataFrame, truth: Column, flagged: Column, by: list[str] | None = None) -> DataFrame:
    """tn, fp, fn and tp in one pass."""
    return rows.groupBy(*(by or [])).agg(F.count_if(~truth & ~flagged).alias("tn"), F.count_if(~truth & flagged).alias("fp"), F.count_if(truth & ~flagged).alias("fn"), F.count_if(truth & flagged).alias("tp"))


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 where undefined) and the flagged share, from tn, fp, fn and tp."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    every = tn + fp + fn + tp
    return (
        counts.withColumn("accuracy", safe_ratio(tn + tp, every))
        .withColumn("precision", safe_ratio(tp, tp + fp))
        .withColumn("recall", safe_ratio(tp, tp + fn))
        .withColumn("f1", safe_ratio(2 * tp, 2 * tp + fp + fn))
        .withColumn("flagged_share", safe_ratio(tp + fp, every))
    )


def per_class(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, from a confusion matrix (truth, predicted, n)."""
    each = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("named")), F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("named")))).alias("x"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    sums = each.groupBy("x.class").agg(F.sum("x.support").alias("support"), F.sum("x.named").alias("named"), (F.sum("hit") / 2).cast("long").alias("hit"))
    precision, recall = safe_ratio(F.col("hit"), F.col("named")), safe_ratio(F.col("hit"), F.col("support"))
    return sums.select("class", "support", precision.alias("precision"), recall.alias("recall"), safe_ratio(2 * F.col("hit"), F.col("named") + F.col("support")).alias("f1"))


def by_score(rows: DataFrame, score: Column, truth: Column, by: list[str] | None = None) -> DataFrame:
    """(by, score, n, positives) by distinct score; rows without score or truth take no part."""
    kept = rows.where(score.isNotNull() & truth.isNotNull())
    return kept.groupBy(*(by or []), score.alias("score")).agg(F.count("*").alias("n"), F.count_if(truth).alias("positives"))


def running(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``counts`` with above and positives_above: what has this score or a higher one, within each ``by``.

    Scores are ranged over the partitions; each sums up its own, and the partitions' totals are added in order.
    The ranged rows are written to the shared folder, because the bounds of ranges are sampled anew by every evaluation.
    """
    by = by or []
    ranged = keep(counts.repartitionByRange(*by, F.desc("score")).withColumn("_range", F.spark_partition_id()), "scores")
    own = Window.partitionBy("_range", *by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("_n", F.sum("n").over(own)).withColumn("_p", F.sum("positives").over(own))
    before = (Window.partitionBy(*by) if by else Window).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = ranged.groupBy("_range", *by).agg(F.sum("n").alias("n"), F.sum("positives").alias("p"))
    starts = totals.select("_range", *by, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("_p0"))
    joined = ranged.join(starts, ["_range", *by])
    return joined.select(*by, "score", "n", "positives", (F.col("_n") + F.col("_n0")).alias("above"), (F.col("_p") + F.col("_p0")).alias("positives_above"))


def average_precision(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The step-wise area under the precision-recall curve of each ``by``; null without positives."""
    step = F.col("positives") * F.try_divide(F.col("positives_above").cast("double"), F.col("above"))
    return running(counts, by).groupBy(*(by or [])).agg(F.try_divide(F.sum(step), F.sum("positives")).alias("average_precision"))


def roc_auc(counts: DataFrame) -> DataFrame:
    """The chance that a positive scores above a negative, ties half; null without either."""
    below = F.col("negatives_total") - (F.col("above") - F.col("positives_above"))
    tied = F.col("n") - F.col("positives")
    curve = running(counts)
    total = curve.agg(F.sum("positives").alias("positives_total"), (F.sum("n") - F.sum("positives")).alias("negatives_total"))
    wins = curve.crossJoin(F.broadcast(total))  # one row of totals
    return wins.agg(F.try_divide(F.sum(F.col("positives") * (below + tied / 2)), F.max("positives_total").cast("double") * F.max("negatives_total")).alias("roc_auc"))


def best_f1(counts: DataFrame) -> DataFrame:
    """The threshold (flagged from it on) with the best F1, the lowest of equal ones, and its precision and recall."""
    curve = running(counts)
    total = curve.agg(F.sum("positives").alias("all_positives"))
    precision = safe_ratio(F.col("positives_above"), F.col("above"))
    recall = safe_ratio(F.col("positives_above"), F.col("all_positives"))
    f1 = safe_ratio(2 * F.col("positives_above"), F.col("above") + F.col("all_positives"))
    best = F.max_by(F.struct("score", "precision", "recall", "f1"), F.struct(F.col("f1"), (-F.col("score")).alias("s"))).alias("best")
    rows = curve.crossJoin(F.broadcast(total)).select("score", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
    return rows.agg(best).select(F.col("best.score").alias("threshold"), "best.precision", "best.recall", "best.f1")


def majority_baseline(rows: DataFrame, label: str) -> DataFrame:
    """The most frequent label, the least of equal ones, and how often it would be right."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    ordered = counts.agg(F.min_by(label, F.struct((-F.col("n")).alias("m"), F.col(label))).alias("label"), F.max("n").alias("most"), F.sum("n").alias("every"))
    return ordered.select("label", safe_ratio(F.col("most"), F.col("every")).alias("accuracy"))


def index_quantile(values: Column, share: float) -> Column:
    """``sorted[floor(n * share)]``: an element, unlike an interpolated percentile. For groups of bounded size."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.least(F.floor(F.size(ordered) * share), F.size(ordered) - 1).cast("int"))


def gate(scores: DataFrame, floors: DataFrame, key: str) -> DataFrame:
    """The metrics that are missing or below their floor."""
    return floors.join(scores, key, "left").where(F.col("score").isNull() | (F.col("score") < F.col("floor")))


def retrieval(ranked: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Of each query: returned, hit, reciprocal rank, precision at ``k`` and noise among the first ``k``.

    ``ranked`` has query_id, rank, relevant and noise. A query without results counts, and precision is always by ``k``.
    """
    top = ranked.where(F.col("rank") <= k)
    sums = top.groupBy("query_id").agg(F.count("*").alias("returned"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.count_if("relevant").alias("good"), F.count_if("noise").alias("noise"))
    every = queries.select("query_id").join(sums, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.select(
        "query_id", zero("returned").alias("returned"), F.col("first").isNotNull().cast("int").alias("hit"), F.coalesce(F.try_divide(F.lit(1.0), F.col("first")), F.lit(0.0)).alias("rr"), (zero("good") / k).alias("p_at_k"), zero("noise").alias("noise")
    )


def retrieval_summary(judged: DataFrame, expect_empty: Column, by: list[str], k: int) -> DataFrame:
    """Means over answerable queries (0 without any) and how many others rightly got nothing."""
    mean = lambda c: F.coalesce(F.avg(F.when(~expect_empty, c)), F.lit(0.0))
    return judged.groupBy(*by).agg(
        F.count_if(~expect_empty).alias("queries"),
        mean(F.col("hit")).alias("hit_rate"),
        mean(F.col("rr")).alias("mrr"),
        mean(F.col("p_at_k")).alias("p_at_k"),
        mean(F.col("noise") / k).alias("noise_share"),
        F.count_if(expect_empty).alias("out_of_scope"),
        F.count_if(expect_empty & (F.col("returned") == 0)).alias("correct_empty"),
    )


def macro_f1(cells: DataFrame) -> DataFrame:
    """One row: the mean F1 of all classes and the accuracy, from a confusion matrix (truth, predicted, n)."""
    hits = cells.agg(safe_ratio(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return per_class(cells).agg(F.count("*").alias("classes"), F.avg("f1").alias("macro_f1")).crossJoin(hits)  # one row by one row


def accuracy_by(rows: DataFrame, group: Column, correct: Column) -> DataFrame:
    """(group, n, accuracy) of each group."""
    return rows.groupBy(group.alias("group")).agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy"))


def refusal_score(expected: Column, refused: Column, score: Column, right: float = 1.0, wrong: float = 0.5) -> Column:
    """``right`` where a refusal was expected and given, ``wrong`` where it was expected only, else ``score``."""
    return F.when(expected, F.when(refused, F.lit(right)).otherwise(F.lit(wrong))).otherwise(score)


def least_similarity(pairs: DataFrame, similarity: Column, floor: float) -> DataFrame:
    """One row: the least similarity of a sample of pairs, and whether it reaches ``floor``; without pairs it doesn't."""
    return pairs.agg(F.count("*").alias("n"), F.min(similarity).alias("least")).withColumn("passed", F.coalesce(F.col("least") >= floor, F.lit(False)))
