"""From layered, partly malformed output and a manifest of facts to a clean corpus and its summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import records, similarity, validate
from quern.operators.shared import keep

# Topics about doctors that don't exist, which a search must not return; and the corpus's columns.
HIDDEN_TOPICS = ["Doctor schedule", "Doctor fees", "Doctor profile", "Specialization doctors"]
COLUMNS = (
    "doc_id record_type group_id content synthetic_patient_ref synthetic_doctor_ref patient_name doctor_name specialization diagnosis_id diagnosis "
    "medicines visit_date time_slot visit_kind faq_intent faq_topic anchor_occupation anchor_context anchor_vital answer_facts difficulty edge_tags "
    "confusable_with rag_visible is_noise noise_type source_doc_id batch_id generator_model generator_seed"
).split()
#: Kinds whose near copies are errors; prescriptions share their structure.
COMPARED = ["visit_note", "faq"]


def is_visible(kind: Column, topic: Column) -> Column:
    return ~(kind.eqNullSafe(F.lit("faq")) & F.coalesce(topic.isin(HIDDEN_TOPICS), F.lit(False)))


def to_records(rows: DataFrame) -> DataFrame:
    """``rows`` (content with its facts) in the corpus's columns; what a kind of record lacks is null."""
    have = set(rows.columns)
    made = {"rag_visible": is_visible(F.col("record_type"), F.col("faq_topic") if "faq_topic" in have else F.lit(None).cast("string")), "is_noise": F.lit(False), "noise_type": F.lit(None).cast("string"), "source_doc_id": F.lit(None).cast("string")}
    return rows.select(*[(made[c] if c in made else F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in COLUMNS])


def note_and_prescription(visits: DataFrame) -> DataFrame:
    """A note of each visit, and a prescription of those that have one; the two share their group."""
    both = records.fan_out(visits.drop("record_type"), {"visit_note": F.lit(True), "prescription": F.col("has_prescription")}, "record_type")
    is_note = F.col("record_type") == "visit_note"
    return both.withColumn("doc_id", F.when(is_note, F.col("doc_id")).otherwise(F.col("rx_doc_id"))).withColumn("advice", F.when(is_note, F.col("advice")).otherwise(F.col("rx_advice"))).withColumn("answer_facts", F.when(is_note, F.col("answer_facts_vn")).otherwise(F.col("answer_facts_rx")))


def twins(rows: DataFrame) -> DataFrame:
    """(doc_id, twin) of near copies: of one kind, not of one patient, word sets at 0.9 or more.

    ``rows`` has doc_id, slice, position, record_type and content. Equal sets meet by a representative, whose links are
    its class's; within a class every row but the first has the first as its twin, patients permitting.
    """
    sets = rows.where(F.col("record_type").isin(COMPARED)).select("doc_id", "slice", "position", "record_type", T.patient_of(F.col("content")).alias("patient"), F.array_distinct(T.content_words(F.col("content"))).alias("words"))
    sets = keep(sets.where(F.size("words") > 0), "words")
    reps, groups = similarity.representatives(sets, "doc_id", "words", ["record_type", "patient"])
    groups = groups.select("doc_id", "rep")
    other = (F.col("a_record_type") == F.col("b_record_type")) & F.coalesce(F.col("a_patient") != F.col("b_patient"), F.lit(True))
    pairs = similarity.similar_pairs(reps, "doc_id", "words", 9, 10, other, ["record_type", "patient"]).select("left", "right")
    member = groups.select(F.col("doc_id").alias("own"), F.col("rep").alias("left"))
    both = pairs.unionByName(pairs.select(F.col("right").alias("left"), F.col("left").alias("right")))
    where = sets.select("doc_id", "slice", "position")
    # the class on the right is stood for by its first member of every slice, which is enough to find one twin
    firsts = groups.join(where, "doc_id").groupBy(F.col("rep").alias("right"), "slice").agg(F.min_by("doc_id", "position").alias("twin"), F.min("position").alias("at"))
    own = member.join(where.select(F.col("doc_id").alias("own"), F.col("slice").alias("own_slice"), F.col("position").alias("own_at")), "own")
    nameless = sets.where("patient is null").select(F.col("doc_id").alias("own"))
    within = own.join(nameless, "own", "left_semi").select("own", "own_slice", "own_at", F.col("left").alias("right"))
    met = own.join(both, "left").select("own", "own_slice", "own_at", "right").unionByName(within).join(firsts, "right")
    wrong = (F.col("twin") != F.col("own")) & ((F.col("slice") != F.col("own_slice")) | (F.col("at") < F.col("own_at")))
    return met.where(wrong).groupBy(F.col("own").alias("doc_id")).agg(F.min("twin").alias("twin"))


def validated(manifest: DataFrame, output: DataFrame, rules: dict[str, list[validate.Rule]]) -> DataFrame:
    """Every manifest row with its latest output, errors and warnings.

    ``manifest`` has doc_id, slice, position, record_type, group_id and facts; ``output`` slice, layer, line, doc_id, group_id,
    record_type and content. ``rules`` are those of each kind.
    """
    last = records.latest(output, ["slice", "doc_id"], [F.col("layer"), F.col("line")])
    again = records.repeated(output, ["slice", "layer", "doc_id"]).where("repeated").select("slice", "doc_id").distinct().withColumn("_again", F.lit(True))
    said = last.select("slice", "doc_id", F.col("group_id").alias("out_group"), F.col("record_type").alias("out_type"), "content").withColumn("found", F.lit(True))
    rows = manifest.join(said, ["slice", "doc_id"], "left").join(again, ["slice", "doc_id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    near = twins(rows.where("found"))
    rows = rows.join(near, "doc_id", "left")
    shared = [validate.Rule("error", "missing", ~F.col("found")), validate.Rule("warning", "repeated", F.col("_again") & F.col("found")), validate.Rule("error", "near-duplicate", F.col("twin").isNotNull())]
    shared += [validate.Rule(r.level, r.message, F.col("found") & r.holds) for r in validate.identity(group=F.col("out_group"), expected_group=F.col("group_id"), kind=F.col("out_type"), expected_kind=F.col("record_type")) + validate.common(F.col("content"))]
    for kind, own in rules.items():
        shared += [validate.Rule(r.level, r.message, F.col("found") & (F.col("record_type") == kind) & r.holds) for r in own]
    return validate.check(rows, shared).drop("_again")


def build(checked: DataFrame, extra: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean records, excluded documents with a reason) of validated rows and output that the manifest doesn't know."""
    good = checked.where(F.col("found") & (F.size("errors") == 0)).withColumn("batch_id", F.col("slice"))
    bad = checked.where(F.size("errors") > 0).select("doc_id", "slice", F.when(F.col("found"), "validator errors").otherwise("missing").alias("reason"))
    return to_records(good), bad.unionByName(extra.select("doc_id", "slice", F.lit("not in manifest").alias("reason")))


def summary(corpus: DataFrame, excluded: DataFrame) -> DataFrame:
    """(key, value, n): totals, and counts by kind, generator, specialization and reason; a missing value counts as "null"."""
    count = lambda df, name, c: df.groupBy(F.coalesce(c.cast("string"), F.lit("null")).alias("value")).agg(F.count("*").alias("n")).select(F.lit(name).alias("key"), "value", "n")
    parts = [count(corpus, c, F.col(c)) for c in ("record_type", "generator_model", "specialization", "rag_visible")]
    parts += [count(corpus, "total", F.lit("all")), count(excluded, "excluded", F.col("reason"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def confusable_pairs(visits: DataFrame) -> DataFrame:
    """(a, b): visits of one diagnosis and different patients, each in one pair at most.

    Patients' visits are numbered in turn within a diagnosis and neighbours are paired, so no order of allocation matters.
    """
    turn = F.row_number().over(Window.partitionBy("diagnosis_id", "patient").orderBy("doc_id"))
    place = F.row_number().over(Window.partitionBy("diagnosis_id").orderBy("turn", "patient"))
    placed = visits.withColumn("turn", turn).withColumn("place", place)
    pair = placed.groupBy("diagnosis_id", F.floor((F.col("place") - 1) / 2).alias("pair")).agg(F.min_by(F.struct("doc_id", "patient"), "place").alias("x"), F.max_by(F.struct("doc_id", "patient"), "place").alias("y"), F.count("*").alias("n"))
    return pair.where((F.col("n") == 2) & (F.col("x.patient") != F.col("y.patient"))).select("diagnosis_id", F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))


def free_slots(wanted: DataFrame, slots: DataFrame, occupied: DataFrame) -> DataFrame:
    """The slots of wanted (doctor, day) that aren't occupied."""
    return wanted.join(slots, "doctor").join(occupied.select("doctor", "day", "slot"), ["doctor", "day", "slot"], "left_anti")
