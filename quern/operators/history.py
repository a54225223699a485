"""Leakage-safe features of events, chronological splits and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numeric import safe_ratio


def by_day(rows: DataFrame, who: str, day: Column, outcome: Column) -> DataFrame:
    """(who, day, n, bad): a patient's appointments and no-shows of each day."""
    return rows.groupBy(who, day.alias("day")).agg(F.count("*").alias("n"), F.count_if(outcome).alias("bad"))


def before(days: DataFrame, who: str) -> DataFrame:
    """``days`` with what happened on earlier days only: n_before, bad_before and their ratio."""
    earlier = Window.partitionBy(who).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    with_sums = days.withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("bad_before", F.coalesce(F.sum("bad").over(earlier), F.lit(0)))
    return with_sums.withColumn("rate_before", safe_ratio(F.col("bad_before"), F.col("n_before")))


def features(rows: DataFrame, who: str, day: Column, outcome: Column) -> DataFrame:
    """``rows`` with what was known before their day."""
    known = before(by_day(rows, who, day, outcome), who).select(who, "day", "n_before", "bad_before", "rate_before")
    return rows.withColumn("day", day).join(known, [who, "day"], "left")


def before_booking(rows: DataFrame, who: str, day: Column, booked: Column, outcome: Column) -> DataFrame:
    """``rows`` with what had happened before they were booked: appointments of days before the booking's.

    Bookings are laid among the days of each patient, and running sums are read off at their places.
    """
    days = by_day(rows, who, day, outcome).select(who, "day", "n", "bad", F.lit(1).alias("kind"))
    asked = rows.select(who, booked.alias("day")).distinct().select(who, "day", F.lit(0).alias("n"), F.lit(0).alias("bad"), F.lit(0).alias("kind"))
    earlier = Window.partitionBy(who).orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, -1)
    both = days.unionByName(asked)
    summed = both.withColumn("n_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("bad_before", F.coalesce(F.sum("bad").over(earlier), F.lit(0))).where("kind = 0")
    known = summed.select(who, F.col("day").alias("booked_day"), "n_before", "bad_before", safe_ratio(F.col("bad_before"), F.col("n_before")).alias("rate_before"))
    return rows.withColumn("booked_day", booked).join(known, [who, "booked_day"], "left")


def day_shares(rows: DataFrame, day: Column) -> DataFrame:
    """(day, n, share): the share of rows up to each day; the window is over days, one row each."""
    days = rows.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("share", F.sum("n").over(upto) / F.sum("n").over(Window.partitionBy()))


def time_split(shares: DataFrame, first: float = 0.6, second: float = 0.8) -> DataFrame:
    """``shares`` with a part: train before the first day whose share reaches ``first``, test from the one at ``second``."""
    cuts = shares.agg(F.min(F.when(F.col("share") >= first, F.col("day"))).alias("v"), F.min(F.when(F.col("share") >= second, F.col("day"))).alias("t"))
    part = F.when(F.col("day") < F.col("v"), "train").when(F.col("day") < F.col("t"), "validation").otherwise("test")
    return shares.crossJoin(F.broadcast(cuts)).withColumn("part", part).drop("v", "t")  # one row of cuts


def clean(rows: DataFrame, bad_first: Column, bad_second: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that are good by both rules, one row of counts: how many the first rule drops, and the second of the others)."""
    counts = rows.agg(F.count("*").alias("n_rows"), F.count_if(bad_first).alias("first"), F.count_if(bad_second & ~bad_first).alias("second"))
    return rows.where(~bad_first & ~bad_second), counts
