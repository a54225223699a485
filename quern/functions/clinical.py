"""Renderers of clinical facts: vital signs by template, companion vitals, plans and edge tags.

Templates are data. A value is drawn from its bounds by a seeded draw, so a row renders alike anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import prng
from quern.functions.numeric import round_to

# The text of each kind of vital sign; {i} is a whole number from the first bounds, {f} one with a decimal,
# {j} a whole number from the second bounds, {side} a side, {five} a multiple of five and {acuity} a line of the chart.
VITALS = {
    "temp": "temperature {f}°F",
    "bp": "BP {i}/{j} mmHg",
    "spo2": "SpO2 {i}%",
    "pulse": "pulse {i} bpm",
    "pulse_irregular": "pulse {i} bpm and irregular",
    "glucose": "fasting glucose {f} mmol/L",
    "glucose_random": "random blood glucose {f} mmol/L",
    "hb": "haemoglobin {f} g/dL",
    "platelet": "platelet count {i}000 per microlitre",
    "ldl": "LDL cholesterol {f} mmol/L",
    "tsh": "TSH {f} mIU/L",
    "vitd": "vitamin D level {i} ng/mL",
    "bmi": "BMI {f}",
    "pain": "pain score {i}/10",
    "lesion": "affected area about {i} cm across",
    "spots": "about {i} inflamed spots on the face",
    "welts": "about {i} welts on the trunk and arms",
    "abduction": "shoulder lifts only to {five} degrees",
    "headache_days": "about {i} headache days a month",
    "monofilament": "reduced sensation at {i} of 10 monofilament test sites",
    "dix_hallpike": "Dix-Hallpike test positive on the {side} side",
    "acuity": "visual acuity 6/{acuity} in the {side} eye",
    "tbut": "tear break-up time {i} seconds",
    "lid_lump": "lump about {i} mm on the {side} upper eyelid",
    "sneezes": "about {i} sneezing fits a day",
    "gad7": "GAD-7 score {i}",
    "phq9": "PHQ-9 score {i}",
    "isi": "Insomnia Severity Index score {i}",
    "attacks": "about {i} panic attacks in the last month",
}
# Lines of an eye chart, and what triggers at work and of study need.
CHART = ["6", "9", "12", "18"]
WORK = r"(?i)shift|work|office|job|colleague|factory|call centre|employment|deadline|company|hospital|business"
STUDY = r"(?i)exam|university|college|hostel"
NOT_WORKING = ["retired civil servant", "homemaker", "university student"]


def _between(seed: Column, n: int, low: Column, high: Column) -> Column:
    return F.floor(prng.draw(seed, F.lit(n)) * (high - low + 1) + low).cast("int")


def vital(kind: Column, seed: Column, low: Column, high: Column, low2: Column | None = None, high2: Column | None = None) -> Column:
    """The text of a vital sign; null for an unknown kind. Uses draws 1 to 3 of ``seed``."""
    templates = F.create_map(*[F.lit(x) for pair in VITALS.items() for x in pair])
    whole = _between(seed, 1, low, high)
    parts = {
        "{i}": whole.cast("string"),
        "{f}": F.format_string("%.1f", round_to(prng.draw(seed, F.lit(1)) * (high - low) + low, 1)),
        "{j}": _between(seed, 2, low2 if low2 is not None else low, high2 if high2 is not None else high).cast("string"),
        "{side}": F.when(prng.draw(seed, F.lit(3)) < 0.5, "left").otherwise("right"),
        "{five}": (_between(seed, 1, low / 5, high / 5) * 5).cast("string"),
        "{acuity}": F.coalesce(F.get(F.array(*[F.lit(x) for x in CHART]), F.least(F.greatest(whole, F.lit(0)), F.lit(len(CHART) - 1))), F.lit("")),
    }
    text = F.try_element_at(templates, kind)
    for mark, value in parts.items():
        text = F.replace(text, F.lit(mark), value)
    return text


def companion_vitals(kind: Column, febrile: Column, hypertensive: Column, chest: Column, weight: Column, seed: Column, short_of_oxygen: Column | None = None) -> Column:
    """The vitals that stand beside the main one: what it is itself is left out; one diagnosis of the chest is ``short_of_oxygen``. Uses draws 11 to 17 of ``seed``."""
    low = F.lit(False) if short_of_oxygen is None else short_of_oxygen
    between = lambda n, a, b: prng.integer(seed, F.lit(n), a, b).cast("string")
    return F.array_join(
        F.array_compact(
            F.array(
                F.when(febrile & (kind != "temp"), F.format_string("temperature %.1f°F", round_to(prng.draw(seed, F.lit(11)) * 2.4 + 101.0, 1))),
                F.when(kind != "bp", F.when(hypertensive, F.concat(F.lit("BP "), between(12, 136, 152), F.lit("/"), between(13, 86, 96), F.lit(" mmHg"))).otherwise(F.concat(F.lit("BP "), between(12, 110, 136), F.lit("/"), between(13, 70, 86), F.lit(" mmHg")))),
                F.when(~F.startswith(kind, F.lit("pulse")), F.concat(F.lit("pulse "), F.when(febrile, between(14, 92, 110)).otherwise(between(14, 68, 92)), F.lit(" bpm"))),
                F.when(chest & (kind != "spo2"), F.concat(F.lit("SpO2 "), F.when(low, between(15, 91, 95)).otherwise(between(15, 94, 98)), F.lit("%"))),
                F.concat(F.lit("weight "), (weight + prng.integer(seed, F.lit(16), -2, 2)).cast("string"), F.lit(" kg")),
            )
        ),
        ", ",
    )


def trigger_fits(trigger: Column, occupation: Column) -> Column:
    """Triggers at work need a job, and those of study a student."""
    return ~(F.rlike(trigger, F.lit(WORK)) & occupation.isin(NOT_WORKING)) & ~(F.rlike(trigger, F.lit(STUDY)) & (occupation != "university student"))


#: What a plan without prescription notes; {0} is the diagnosis' tests or the specialization referred to.
PLAN_NOTES = {
    "continue": "chronic follow-up: continue current medicines, no new prescription issued",
    "tests": "tests ordered before starting treatment: {0}",
    "lifestyle": "lifestyle and self-care advice only, no medicine needed at this stage",
    "referral": "referral to {0} in this clinic for further assessment",
}


def plan_note(plan: Column, tests: Column, refer_to: Column) -> Column:
    """The note of a plan; null for a prescription."""
    out = F.lit(None).cast("string")
    for name, text in PLAN_NOTES.items():
        before, _, after = text.partition("{0}")
        out = F.when(plan == name, F.concat(F.lit(before), tests if name == "tests" else refer_to, F.lit(after)) if "{0}" in text else F.lit(text)).otherwise(out)
    return out


def regimen(plan: Column, regimens: Column, seed: Column, n: Column) -> Column:
    """The regimen of a prescription: the first one, or by a draw under 0.3 the second, if there is one; null for other plans."""
    second = (F.size(regimens) > 1) & (prng.draw(seed, n) < 0.3)
    return F.when(plan == "prescription", F.get(regimens, F.when(second, 1).otherwise(0)))


def follow_up(plan: Column, refer_to: Column, usual: Column) -> Column:
    return F.when(plan == "tests", "after the test results are ready").when(plan == "referral", F.concat(F.lit("after the "), refer_to, F.lit(" review"))).otherwise(usual)


def edge_tags(repeated: Column, comorbidity: Column, plan: Column, age: Column) -> Column:
    return F.array_compact(F.array(F.when(repeated, "multi_visit"), F.when(comorbidity != "none", "comorbidity"), F.when(plan == "referral", "referral"), F.when(age >= 70, "elderly")))


def eligible(age: Column, gender: Column, visits: Column, seen: Column, diagnosis: Column, low: Column, high: Column, sex: Column, wanted: Column, cap: int = 8) -> Column:
    """Whether a patient can have an episode: age inside the range by a year, sex, number of visits, and not had before."""
    return (age >= low + 1) & (age <= high - 1) & (sex.isNull() | (gender == sex)) & (visits + wanted <= cap) & ~F.array_contains(seen, diagnosis)
