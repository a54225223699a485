"""A seeded manifest of visits: patients, episodes, a schedule without clashes, numbers, slices and facts.

Every value is a draw by the row's own number, so rows are made anywhere and in any order. Where the original
generator searched for a free place in one sequence, places are dealt out by rank: a doctor's visits take the
doctor's open (day, slot) places in order, which can't clash; visits that would put a patient in two places on one
day are dealt out again. The catalogue (diagnoses and doctors) is data, not code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import prng
from quern.functions.numeric import age_on, calendar
from quern.functions.text import padded_id
from quern.operators import records
from quern.operators.shared import keep


def patients(spark: SparkSession, n: int, seed: int, middle: str) -> DataFrame:
    """(patient, gender, birth, age): ages of 19 to 80 at ``middle``."""
    own = F.xxhash64(F.lit(seed), "id")
    days = prng.integer(own, F.lit(2), 19 * 365 + 5, 80 * 365 + 20)
    birth = F.date_sub(F.to_date(F.lit(middle)), days)
    rows = spark.range(1, n + 1).select(padded_id("PAT", F.col("id")).alias("patient"), F.when(prng.draw(own, F.lit(1)) < 0.5, "male").otherwise("female").alias("gender"), birth.alias("birth"))
    return rows.withColumn("age", age_on(F.col("birth"), F.to_date(F.lit(middle))))


def episodes(people: DataFrame, diagnoses: DataFrame, per_diagnosis: int, seed: int) -> DataFrame:
    """(patient, diagnosis_id, specialization, visit, chronic): episodes of eligible patients, one to four visits each.

    A diagnosis takes the ``per_diagnosis`` eligible patients with the least draws. ``diagnoses`` has diagnosis_id,
    specialization, low, high, sex (null for any) and chronic.
    """
    fits = (F.col("age") >= F.col("low") + 1) & (F.col("age") <= F.col("high") - 1) & (F.col("sex").isNull() | (F.col("sex") == F.col("gender")))
    able = people.join(F.broadcast(diagnoses), fits)  # the catalogue: a few dozen rows by contract
    luck = F.xxhash64(F.lit(seed), "patient", "diagnosis_id")
    taken = records.first_per_group(able.withColumn("_luck", luck), ["diagnosis_id"], [F.col("_luck"), F.col("patient")], per_diagnosis, "_n")
    visits = F.when(F.col("chronic"), prng.integer(F.col("_luck"), F.lit(1), 2, 4)).otherwise(F.when(prng.draw(F.col("_luck"), F.lit(2)) < 0.15, 2).otherwise(1))
    return taken.select("patient", "gender", "birth", "diagnosis_id", "specialization", "chronic", F.explode(F.sequence(F.lit(1), visits)).alias("visit"))


def places(doctors: DataFrame, first: str, last: str) -> DataFrame:
    """(doctor, place, day, weekday, slot): every open place of each doctor, numbered in a mixed order.

    ``doctors`` has doctor, specialization, days and slots.
    """
    days = calendar(doctors.sparkSession.range(1).select(F.to_date(F.lit(first)).alias("first"), F.to_date(F.lit(last)).alias("last")))
    grid = doctors.select("doctor", "specialization", F.explode("days").alias("weekday"), "slots").join(F.broadcast(days), "weekday").select("doctor", "specialization", "day", "weekday", F.explode("slots").alias("slot"))
    mixed = Window.partitionBy("doctor").orderBy(F.xxhash64("doctor", "day", "slot"), "day", "slot")
    return grid.withColumn("place", F.row_number().over(mixed))


def schedule(visits: DataFrame, doctors: DataFrame, open_places: DataFrame, seed: int, rounds: int = 50) -> DataFrame:
    """``visits`` with doctor, day, weekday and slot: no doctor's place is taken twice, and no patient has two on one day.

    Each round deals unplaced visits to the next free places of their doctors, and takes back those on a day that their
    patient has already. Raises if visits are left after ``rounds``, as when doctors have too few places.
    """
    from quern.operators.records import numbered

    own = F.xxhash64(F.lit(seed), "patient", "diagnosis_id", "visit")
    crews = doctors.groupBy("specialization").agg(F.array_sort(F.collect_list("doctor")).alias("crew"))
    asked = visits.join(crews, "specialization").withColumn("doctor", prng.pick(own, F.lit(1), F.col("crew"))).drop("crew")
    left = keep(numbered(asked, ["patient", "diagnosis_id", "visit"], "_id"), "visits")
    free, placed = keep(open_places.select("doctor", "place", "day", "weekday", "slot"), "places"), None
    for turn in range(rounds):
        if left.isEmpty():
            break
        queue = left.withColumn("_turn", F.row_number().over(Window.partitionBy("doctor").orderBy(F.xxhash64(F.lit(turn), "_id"), "_id")))
        stock = free.withColumn("_turn", F.row_number().over(Window.partitionBy("doctor").orderBy("place")))
        dealt = keep(queue.join(stock, ["doctor", "_turn"]).drop("_turn"), "dealt")
        used = dealt.select("doctor", "place")
        same_day = Window.partitionBy("patient", "day").orderBy("_id")
        dealt = dealt.withColumn("_n", F.row_number().over(same_day))
        good = dealt.where("_n = 1").drop("_n")
        if placed is not None:
            good = good.join(placed.select("patient", "day"), ["patient", "day"], "left_anti")
        good = good.select(*visits.columns, "doctor", "place", "day", "weekday", "slot", "_id")
        good = keep(good, "placed")
        left = keep(left.join(good.select("_id"), "_id", "left_anti").select(*left.columns), "visits")
        # what was dealt is used up in this round, taken or not, so the next round's places are other ones
        free = free.join(used, ["doctor", "place"], "left_anti")
        placed = good if placed is None else placed.unionByName(good)
    if placed is None or not left.isEmpty():
        raise ValueError("no free places are left for some visits")
    return placed.drop("_id", "place")


def number(visits: DataFrame, paired: Column, slice_size: int = 50) -> DataFrame:
    """Visits in the order of pairing, day, time and doctor, with the ids of notes, prescriptions and groups, and slices."""
    from quern.functions.numeric import slot_minutes

    rows = visits.withColumn("_unpaired", ~paired).withColumn("_minutes", slot_minutes(F.col("slot")))
    placed = records.slices(rows, ["_unpaired", "day", "_minutes", "doctor"], slice_size)
    n = F.col("position") + 1
    return placed.select(padded_id("VN", n).alias("doc_id"), F.when(~F.col("_unpaired"), padded_id("RX", n)).alias("rx_doc_id"), padded_id("VISIT", n).alias("group_id"), *visits.columns, "position", "batch_id")


def broken_rules(visits: DataFrame, doctors: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """(rule, n) of the rules that a manifest breaks; no row means that it is sound."""
    each = visits.join(F.broadcast(doctors.select("doctor", "days", "slots")), "doctor").join(F.broadcast(diagnoses.select("diagnosis_id", "low", "high", "sex")), "diagnosis_id")
    age = age_on(F.col("birth"), F.col("day"))
    rows = [
        ("weekday", ~F.array_contains("days", F.col("weekday")) | (F.date_format("day", "EEE") != F.col("weekday"))),
        ("slot", ~F.array_contains("slots", F.col("slot"))),
        ("age", ~age.between(F.col("low"), F.col("high"))),
        ("sex", F.coalesce(F.col("sex") != F.col("gender"), F.lit(False))),
    ]
    found = each.select(F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rows]))).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))
    for name, key in (("doctor twice", ["doctor", "day", "slot"]), ("patient twice", ["patient", "day"]), ("number twice", ["doc_id"])):
        found = found.unionByName(records.violations(visits, key).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(name).alias("rule"), "n"))
    return found
