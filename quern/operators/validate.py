"""Rule-based validation: each rule is a condition with a level and a message, and rows collect what holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T


@dataclass
class Rule:
    """A row where ``holds`` is true has the problem ``message``, an error or a warning."""

    level: str
    message: str | Column
    holds: Column


def check(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` with arrays ``errors`` and ``warnings``, in the order of the rules; a rule on nulls doesn't hold.

    The number of words of ``content`` is counted once, for the rules on length.
    """
    names = rows.columns
    if "content" in names:
        rows = rows.withColumn("_n_words", T.word_count(F.col("content")))

    def of(level: str) -> Column:
        found = [F.when(r.holds, F.lit(r.message) if isinstance(r.message, str) else r.message) for r in rules if r.level == level]
        return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")

    return rows.select(*names, of("error").alias("errors"), of("warning").alias("warnings"))


def identity(content: DataFrame | None = None, *, group: Column, expected_group: Column, kind: Column, expected_kind: Column) -> list[Rule]:
    empty = F.lit("")
    return [Rule("error", "group_id", F.coalesce(group, empty) != F.coalesce(expected_group, empty)), Rule("error", "record_type", ~kind.eqNullSafe(expected_kind))]


def common(content: Column) -> list[Rule]:
    """No line break, no double quote, no identifier."""
    return [Rule("error", "line break", F.rlike(content, F.lit("[\r\n]"))), Rule("error", "double quote", F.contains(content, F.lit('"'))), Rule("error", "id", F.rlike(content, F.lit(T.ID_LEAK)))]


def length(span: Column) -> list[Rule]:
    """Word counts of ``content`` beyond the error bounds, or outside the range."""
    n, b = F.col("_n_words"), T.length_bounds(span)
    wrong = (n < b["error_lo"]) | (n > b["error_hi"])
    return [Rule("error", "length", wrong), Rule("warning", "length", ~wrong & ((n < b["lo"]) | (n > b["hi"])))]


def _numbers_missing(source: Column, target: Column) -> Column:
    return F.exists(T.numbers(source), lambda n: ~F.contains(target, n))


def foreign_medicines(content: Column, names: list[str], allowed: Column, exempt: Column) -> Column:
    """The catalogue's medicines that ``content`` names, without ``allowed`` ones and those in the ``exempt`` text."""
    rest = F.aggregate(allowed, content, lambda t, n: F.regexp_replace(t, F.concat(F.lit("(?i)"), T.literal(n)), F.lit(" ")))
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: T.mentions(rest, n) & ~T.mentions(F.coalesce(exempt, F.lit("")), n))


def visit_note(places: list[str], medicines: list[str]) -> list[Rule]:
    """The rules of visit notes, on ``content`` and the manifest's columns."""
    c, col = F.col("content"), F.col
    header = F.concat(F.lit("Visit note | "), col("visit_date"), F.lit(" "), col("time_slot"), F.lit(" | "), col("doctor_name"), F.lit(", "), col("specialization"), F.lit(" | Patient: "), col("patient_name"), F.lit(", "), col("age").cast("string"), F.lit(", "), col("gender"), F.lit("."))
    at = F.instr(c, "Assessment:")
    vital = F.contains(c, col("anchor_vital"))
    numbers = T.numbers(col("anchor_vital"))
    reworded = ~vital & (F.size(numbers) > 0) & ~_numbers_missing(col("anchor_vital"), c)
    place = F.get(F.filter(F.array(*[F.lit(p) for p in places]), lambda p: F.contains(col("anchor_context"), p)), F.lit(0))
    exempt = F.concat_ws(" ", col("advice"), col("plan_note"), col("must_include"))
    named = foreign_medicines(c, medicines, F.array().cast("array<string>"), exempt)
    complaint = T.first_sentence(F.btrim(F.substring(c, F.length(header) + 1, F.length(c))))
    return [
        Rule("error", "header", ~F.startswith(c, header)),
        Rule("error", "assessment missing", at == 0),
        Rule("error", "diagnosis", (at > 0) & ~T.contains_ci(F.substring(c, at, F.lit(200)), col("diagnosis"))),
        Rule("error", "vital", ~vital & ~reworded),
        Rule("warning", "vital reworded", reworded),
        Rule("error", "occupation", ~T.contains_ci(c, col("anchor_occupation"))),
        Rule("error", "place", place.isNotNull() & ~F.contains(c, place)),
        Rule("error", "context", T.coverage(col("anchor_context"), c) < 0.6),
        Rule("warning", "other vital", F.exists(F.split(col("other_vitals"), ", *"), lambda v: ~T.contains_ci(c, v))),
        Rule("error", "comorbidity", (F.coalesce(col("comorbidity"), F.lit("none")) != "none") & ~T.contains_ci(c, col("comorbidity"))),
        Rule("error", "medicine", F.size(named) > 0),
        Rule("error", "prescription", col("has_prescription") & ~F.rlike(c, F.lit("(?i)prescription"))),
        Rule("error", "no prescription", ~col("has_prescription") & ~F.rlike(c, F.lit("(?i)no new (medicine|medication|prescription)"))),
        Rule("error", "must include", col("must_include").isNotNull() & (_numbers_missing(col("must_include"), c) | (T.coverage(col("must_include"), c) < 0.7))),
        Rule("warning", "follow-up", _numbers_missing(col("follow_up"), c) | (T.coverage(col("follow_up"), c) < 0.5)),
        Rule("warning", "advice", T.coverage(col("advice"), c) < 0.5),
        Rule("warning", "complaint copied", T.contains_ci(c, col("chief_complaint_hint"))),
        Rule("warning", "specialization in complaint", T.contains_ci(complaint, col("specialization"))),
        *length(col("length_words")),
    ]


def prescription(medicines: list[str]) -> list[Rule]:
    """The rules of prescriptions."""
    c, col = F.col("content"), F.col
    header = F.concat(F.lit("Prescription | "), col("visit_date"), F.lit(" | "), col("doctor_name"), F.lit(", "), col("specialization"), F.lit(" | Patient: "), col("patient_name"), F.lit(", "), col("age").cast("string"), F.lit(", "), col("gender"), F.lit(" | Diagnosis: "), col("diagnosis"), F.lit(" | Medicines:"))
    lines = F.transform(col("medicines"), lambda m, i: F.concat((i + 1).cast("string"), F.lit(") "), m["name"], F.lit(" "), F.concat_ws(", ", m["dosage"], m["frequency"], m["duration"])))
    follow = F.concat(F.lit("Follow-up: "), col("follow_up"))
    extra = foreign_medicines(c, medicines, F.transform(col("medicines"), lambda m: m["name"]), col("advice"))
    return [
        Rule("error", "header", ~F.startswith(c, header)),
        Rule("error", "medicine line", F.exists(lines, lambda x: ~F.contains(c, x))),
        Rule("error", "too many medicines", F.rlike(c, F.concat(F.lit(r"\b"), (F.size("medicines") + 1).cast("string"), F.lit(r"\)")))),
        Rule("error", "medicine", F.size(extra) > 0),
        Rule("error", "advice missing", ~F.contains(c, F.lit("Advice:"))),
        Rule("error", "follow-up", ~F.contains(c, follow)),
        Rule("error", "order", F.contains(c, follow) & (F.instr(c, "Advice:") > F.instr(c, "Follow-up:"))),
        Rule("warning", "advice", T.coverage(col("advice"), c) < 0.5),
        *length(col("length_words")),
    ]


def faq() -> list[Rule]:
    """The rules of questions with answers; the shape comes first, and the rest needs it."""
    c, col = F.col("content"), F.col
    parts = T.question_answer(c)
    answer = parts["answer"]
    missed = lambda fact: _numbers_missing(fact, answer) | F.exists(T.proper_names(fact), lambda n: ~F.contains(answer, n)) | (T.coverage(fact, answer) < 0.5)
    return [
        Rule("error", "shape", parts.isNull()),
        Rule("error", "fact", parts.isNotNull() & F.exists(col("answer_facts"), missed)),
        Rule("warning", "question", parts.isNotNull() & (T.coverage(col("question_hint"), parts["question"]) < 0.3)),
        *[Rule(r.level, r.message, parts.isNotNull() & r.holds) for r in length(col("length_words"))],
    ]


def near_duplicate_errors(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, twin): of a pair across slices both fail, of one within a slice the later row; the twin is the least.

    ``rows`` has doc_id, slice and position; ``pairs`` has left and right.
    """
    both = pairs.select("left", "right").unionByName(pairs.select(F.col("right").alias("left"), F.col("left").alias("right")))
    own = rows.select(F.col("doc_id").alias("left"), F.col("slice").alias("ls"), F.col("position").alias("lp"))
    other = rows.select(F.col("doc_id").alias("right"), F.col("slice").alias("rs"), F.col("position").alias("rp"))
    joined = both.join(own, "left").join(other, "right")
    return joined.where((F.col("ls") != F.col("rs")) | (F.col("lp") > F.col("rp"))).groupBy(F.col("left").alias("doc_id")).agg(F.min("right").alias("twin"))


def unresolved(rows: DataFrame, key: list[str], layer: str, malformed: Column) -> DataFrame:
    """Malformed rows that no later layer supplies well-formed."""
    later = F.max(F.when(~malformed, F.col(layer))).over(Window.partitionBy(*key))
    return rows.withColumn("_good", later).where(malformed & (F.col("_good").isNull() | (F.col("_good") < F.col(layer)))).drop("_good")


def report(results: DataFrame, by: str) -> DataFrame:
    """Of each slice: expected, found, passed and failed rows, and those with warnings; ok where none failed.

    ``results`` has a row for each expected record: errors, warnings and found.
    """
    failed = (F.size("errors") > 0) | ~F.col("found")
    return results.groupBy(by).agg(
        F.count("*").alias("rows_expected"), F.count_if("found").alias("rows_found"), F.count_if(~failed).alias("rows_passed"), F.count_if(failed).alias("rows_failed"), F.count_if(F.size("warnings") > 0).alias("rows_with_warnings"), (F.count_if(failed) == 0).alias("ok")
    )
