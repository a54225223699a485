"""Models on features: logistic regression, Spark's boosted trees, importances and tuning.

scikit-learn's defaults differ from Spark's in places; where a formula can be matched it is, and where it can't the
docstring says so.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import metrics
from quern.operators.boosting import Boosted
from quern.operators.records import numbered
from quern.operators.shared import keep


def logistic(rows: DataFrame, features: list[str], label: str, c: float = 1.0):
    """Standardised logistic regression; Spark scales by the sample's deviation, which differs a little from the population's."""
    assemble = VectorAssembler(inputCols=features, outputCol="_raw")
    scale = StandardScaler(inputCol="_raw", outputCol="features", withMean=True)
    model = LogisticRegression(labelCol=label, regParam=1 / (c * max(1, rows.count())), standardization=False, maxIter=100)
    return Pipeline(stages=[assemble, scale, model]).fit(rows)


def boosted_trees(rows: DataFrame, features: list[str], label: str, rounds: int = 60, depth: int = 4):
    """Gradient-boosted trees: grown by level and without L2, so close to histogram boosting but not the same."""
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    return Pipeline(stages=[assemble, GBTClassifier(labelCol=label, maxIter=rounds, stepSize=0.05, maxDepth=depth, seed=7)]).fit(rows)


def scored(model, rows: DataFrame) -> DataFrame:
    """``rows`` with the probability of the positive class."""
    if isinstance(model, Boosted):
        return model.score(rows)
    return model.transform(rows).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))


def tune(fit, train: DataFrame, validation: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Metrics on the test part at the threshold that is best on validation, with a model refitted on both others."""
    with ThreadPoolExecutor(2) as both:  # neither fit needs the other, and many small jobs leave cores idle
        fits = [both.submit(inheritable_thread_target(train.sparkSession)(fit), rows) for rows in (train, train.unionByName(validation))]
    first, final = (scored(f.result(), rows) for f, rows in zip(fits, (validation, test), strict=True))
    threshold = metrics.best_f1(metrics.by_score(first, F.col("score"), F.col(label) == 1)).first()["threshold"]
    flagged = F.col("score") >= threshold if threshold is not None else F.lit(False)
    return metrics.binary_metrics(metrics.binary_counts(final, F.col(label) == 1, flagged)).withColumn("threshold", F.lit(threshold).cast("double"))


def dealt_out(rows: DataFrame, features: list[str], repeats: int, seed: int = 7) -> DataFrame:
    """``rows`` once for each (feature, repeat), with the feature's values dealt out anew among all rows, and once as they are (feature "").

    Each repeat numbers all rows by a hash of its own, and the row that comes nth gives its values to the one at place n. A repeat's features are
    dealt out by one order, each alone, so rows are shuffled once for each repeat and not for each feature.
    """
    placed = keep(numbered(keep(rows.withColumn("_id", F.monotonically_increasing_id()), "rows"), ["_id"], "_at"), "placed")
    n = max(1, placed.count())
    repeated = F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("repeat")
    given = placed.select("_id", repeated, F.struct(*[F.col(f).cast("double").alias(f) for f in features]).alias("_new"))
    given = numbered(given.withColumn("_h", F.xxhash64(F.lit(seed), "repeat", "_id")), ["repeat", "_h", "_id"], "_at")
    given = given.select("repeat", (F.col("_at") % n).alias("_at"), "_new")
    joined = placed.select("*", repeated).join(given, ["repeat", "_at"])
    dealt = joined.select("*", F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    new = lambda c: F.when(F.col("feature") == c, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in features else F.col(c)
    whole = placed.select(F.lit("").alias("feature"), F.lit(0).alias("repeat"), *rows.columns)
    return whole.unionByName(dealt.select("feature", "repeat", *[new(c) for c in rows.columns]))


def permutation_importance(model, rows: DataFrame, features: list[str], label: str, repeats: int = 5, seed: int = 7) -> DataFrame:
    """(feature, drop, deviation): the loss of average precision when a feature's values are dealt out anew, its mean and deviation over ``repeats``.

    All permutations are rows of one table, which is scored once; the number of jobs doesn't depend on features or repeats.
    """
    dealt = scored(model, dealt_out(rows.select(*features, label), features, repeats, seed))
    quality = keep(metrics.average_precision(metrics.by_score(dealt, F.col("score"), F.col(label) == 1, ["feature", "repeat"]), ["feature", "repeat"]), "quality")
    whole = quality.where("feature = ''").select(F.col("average_precision").alias("_before"))
    drop = F.coalesce(F.col("_before"), F.lit(0.0)) - F.coalesce(F.col("average_precision"), F.lit(0.0))
    each = quality.where("feature <> ''").crossJoin(F.broadcast(whole))  # one row
    return each.groupBy("feature").agg(F.avg(drop).alias("drop"), F.stddev_pop(drop).alias("deviation")).orderBy(F.desc("drop"), "feature")


def first_sentences_noisy(rows: DataFrame, text: str, seed: int, rate: float = 0.3) -> DataFrame:
    """The stress form of a text: its first sentence with typos."""
    from quern.functions import prng
    from quern.functions import text as T

    own = F.xxhash64(F.lit(seed), F.col(text))
    return rows.withColumn(text, prng.add_typos(T.first_sentence(F.col(text)), own, rate))
