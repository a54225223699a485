"""Queries of record rules, corpus building and rendering.

No table has visits, so their facts are expressions over documents. ``_facts`` lists these once, in words that Spark and
other engines read alike; queries and SQL start from the same rows and part from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import clinical, numeric
from quern.functions import text as T
from quern.operators import corpus as building
from quern.operators import manifest, records, search, validate
from quern.plans import learning
from quern.plans._tables import table
from quern.plans.text import draw_sql
from quern.plans.text import _content, _stems

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _one_of(key: str, *values: str) -> str:
    """SQL for the value at ``key`` modulo their number."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


MEDICINES = ["Calmex", "Dorvane", "Pulmira"]
PLACES = ["Northfield", "Eastmoor"]
_FACTS = {
    "doc_id": "doc_id",
    "visit_date": "'2025-03-1' || CAST(doc_id % 10 AS STRING)",
    "time_slot": "'0' || CAST(1 + doc_id % 9 AS STRING) || ':30 PM'",
    "doctor_name": _one_of("doc_id", "'Dr. Alba Reyes'", "'Dr. Omar Finch'", "'Dr. Lin Hart'"),
    "specialization": _one_of("doc_id", "'Cardiology'", "'Neurology'"),
    "patient_name": _one_of("doc_id", "'Mina Cole'", "'Tariq Stone'", "'Ruth Vale'"),
    "age": "CAST(20 + doc_id % 60 AS INT)",
    "gender": _one_of("doc_id", "'female'", "'male'"),
    "diagnosis": _one_of("doc_id", "'Stable angina'", "'Tension headache'"),
    "anchor_vital": "'BP ' || CAST(120 + doc_id % 30 AS STRING) || '/80 mmHg'",
    "anchor_occupation": _one_of("doc_id", "'welder'", "'school teacher'"),
    "anchor_context": _one_of("doc_id", "'symptoms started during the harvest at Northfield'", "'woke early after long journeys to Eastmoor'"),
    "other_vitals": "'pulse ' || CAST(70 + doc_id % 9 AS STRING) || ' bpm, weight 70 kg'",
    "comorbidity": _one_of("doc_id", "'none'", "'asthma'", "'none'"),
    "advice": _one_of("doc_id", "'drink plenty of water and rest.'", "'avoid heavy meals; Pulmira only at night'"),
    "plan_note": _one_of("doc_id", "CAST(NULL AS STRING)", "'review again with Dorvane'"),
    "must_include": _one_of("doc_id", "CAST(NULL AS STRING)", "CAST(NULL AS STRING)", "'glucose chart of 14 days shown'"),
    "follow_up": _one_of("doc_id", "'return after 10 days'", "'come back within 3 weeks'"),
    "has_prescription": "doc_id % 2 = 0",
    "chief_complaint_hint": "'pressing pain behind both eyes'",
    "length_words": "'40-80'",
    "defect": "doc_id % 29",
    "text": "coalesce(text, '')",
}
_HEADER = "'Visit note | ' || visit_date || ' ' || time_slot || ' | ' || doctor_name || ', ' || specialization || ' | Patient: ' || patient_name || ', ' || CAST(age AS STRING) || ', ' || gender || '.'"


def _unless(n: int, good: str, bad: str = "''") -> str:
    return f"CASE WHEN defect = {n} THEN {bad} ELSE {good} END"


#: A sound note, but for the defect that its number names; the whole text of the document ends each ninth one.
_NOTE = " || ".join(
    [
        _unless(1, _HEADER, "'Note of ' || patient_name || '.'"),
        _unless(2, "' Head feels heavy since Monday.'", "' Has pressing pain behind both eyes, for ' || specialization || '.'"),
        "' Works as a ' || " + _unless(3, "anchor_occupation", "'baker'"),
        "', ' || CASE defect WHEN 4 THEN " + _one_of("doc_id", "'symptoms started during the harvest'", "'woke early after long journeys'") + " WHEN 17 THEN 'Northfield, Eastmoor' ELSE anchor_context END",
        "'. ' || CASE defect WHEN 5 THEN 'pressure high' WHEN 18 THEN 'pressure ' || substr(anchor_vital, 4) ELSE anchor_vital END",
        _unless(6, "', ' || other_vitals", "', pulse normal'"),
        _unless(7, "' and ' || comorbidity || ' known.'", "' and well.'"),
        _unless(8, "' Assessment: '", "' Seen: '"),
        _unless(9, "lower(diagnosis)", "'unclear'"),
        _unless(10, "'.'", "'; takes calmex and Dorvane.'"),
        _unless(11, "CASE WHEN has_prescription THEN ' A prescription was given.' ELSE ' No new medicine was needed.' END"),
        _unless(12, "coalesce(' ' || must_include || '.', '')", "' A chart of 15 days.'"),
        _unless(13, "' ' || follow_up || '.'", "' Nothing further.'"),
        _unless(14, "' ' || advice"),
        _unless(15, "''", "' See VN-000012 \"today\".'"),
        _unless(16, "''", "' ' || anchor_context || ' ' || anchor_context || ' ' || anchor_context || ' ' || anchor_context || ' ' || anchor_context || ' ' || anchor_context || ' ' || anchor_context || ' ' || anchor_context || ' ' || anchor_context"),
        "CASE WHEN doc_id % 9 = 8 THEN ' ' || text ELSE '' END",
    ]
)
_FACTS_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in _FACTS.items()) + " FROM documents"


def _notes_sql(content: str = _NOTE) -> str:
    return f"SELECT *, {content} AS content FROM ({_FACTS_SQL})"


def _facts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {n}" for n, e in _FACTS.items()])


def _joined(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


def _has(part: str, text: str = "content") -> str:
    return f"contains({text}, {part})"


def _has_ci(part: str, text: str = "content") -> str:
    return f"contains(lower({text}), lower({part}))"


def _covered(source: str, target: str) -> str:
    s = _stems(source)
    return f"(CASE WHEN len({s}) = 0 THEN 1.0 ELSE len(list_intersect({s}, {_stems(target)}))::DOUBLE / len({s}) END)"


def _numbers(text: str) -> str:
    return rf"regexp_extract_all({text}, '\d+(?:[.,/]\d+)*')"


def _missing_numbers(source: str, target: str = "content") -> str:
    return f"(len(list_filter({_numbers(source)}, lambda x: NOT contains({target}, x))) > 0)"


def _mentions(text: str, name: str) -> str:
    return rf"regexp_matches({text}, '(?i)\b' || {name} || '\b')"


def _sql_rules(rules: list[tuple[str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in rules) + "], lambda x: x IS NOT NULL), ';')"


_COUNTED = r"len(list_filter(regexp_split_to_array(content, '[ \t\n\r\f\v\x{00a0}]+'), lambda w: w <> ''))"
_NAMES = "[" + ", ".join(f"'{m}'" for m in MEDICINES) + "]"
_REWORDED = f"NOT {_has('anchor_vital')} AND len({_numbers('anchor_vital')}) > 0 AND NOT {_missing_numbers('anchor_vital')}"
_PLACE = "CASE WHEN contains(anchor_context, 'Northfield') THEN 'Northfield' WHEN contains(anchor_context, 'Eastmoor') THEN 'Eastmoor' END"
_SENTENCE = r"regexp_extract(trim(substr(content, len(header) + 1)), '^((?s:.*?)[.!?])(?:\s(?s:.*))?$', 1)"
_NOTE_ERRORS = [
    ("header", "NOT starts_with(content, header)"),
    ("assessment missing", "strpos(content, 'Assessment:') = 0"),
    ("diagnosis", "strpos(content, 'Assessment:') > 0 AND NOT contains(lower(substr(content, strpos(content, 'Assessment:'), 200)), lower(diagnosis))"),
    ("vital", f"NOT {_has('anchor_vital')} AND NOT ({_REWORDED})"),
    ("occupation", f"NOT {_has_ci('anchor_occupation')}"),
    ("place", f"({_PLACE}) IS NOT NULL AND NOT contains(content, {_PLACE})"),
    ("context", f"{_covered('anchor_context', 'content')} < 0.6"),
    ("comorbidity", f"comorbidity <> 'none' AND NOT {_has_ci('comorbidity')}"),
    ("medicine", f"len(list_filter({_NAMES}, lambda m: {_mentions('content', 'm')} AND NOT {_mentions('exempt', 'm')})) > 0"),
    ("prescription", "has_prescription AND NOT regexp_matches(content, '(?i)prescription')"),
    ("no prescription", "NOT has_prescription AND NOT regexp_matches(content, '(?i)no new (medicine|medication|prescription)')"),
    ("must include", f"must_include IS NOT NULL AND ({_missing_numbers('must_include')} OR {_covered('must_include', 'content')} < 0.7)"),
    ("length", "n < 20 OR n > 104"),
]
_NOTE_WARNINGS = [
    ("vital reworded", _REWORDED),
    ("other vital", f"len(list_filter(regexp_split_to_array(other_vitals, ', *'), lambda v: NOT {_has_ci('v')})) > 0"),
    ("follow-up", f"{_missing_numbers('follow_up')} OR {_covered('follow_up', 'content')} < 0.5"),
    ("advice", f"{_covered('advice', 'content')} < 0.5"),
    ("complaint copied", _has_ci("chief_complaint_hint")),
    ("specialization in complaint", _has_ci("specialization", _SENTENCE)),
    ("length", "n BETWEEN 20 AND 104 AND (n < 40 OR n > 80)"),
]


@query(f"""SELECT doc_id, {_sql_rules(_NOTE_ERRORS)} AS errors, {_sql_rules(_NOTE_WARNINGS)} AS warnings
FROM (SELECT *, {_COUNTED} AS n, {_HEADER} AS header, concat_ws(' ', advice, plan_note, must_include) AS exempt FROM ({_notes_sql()}))""")
def visit_note_rules(spark, sf_dir):
    """The rules of visit notes; each defect occurs, and some notes are sound."""
    notes = _facts(spark, sf_dir).withColumn("content", F.expr(_NOTE))
    return _joined(validate.check(notes, validate.visit_note(PLACES, MEDICINES)))


_RX_HEADER = "'Prescription | ' || visit_date || ' | ' || doctor_name || ', ' || specialization || ' | Patient: ' || patient_name || ', ' || CAST(age AS STRING) || ', ' || gender || ' | Diagnosis: ' || diagnosis || ' | Medicines:'"
_FIRST, _SECOND = "'1) Calmex 5 mg, twice daily, 7 days'", "'2) Dorvane 10 mg, at night, 14 days'"
_RX = " || ".join(
    [
        _unless(1, _RX_HEADER, "'Prescription for ' || patient_name"),
        f"' ' || {_FIRST}",
        _unless(2, f"'; ' || {_SECOND}", "'; 2) Dorvane 20 mg'"),
        _unless(3, "''", "'; 3) rest'"),
        _unless(4, "''", "'; or pulmira'"),
        _unless(5, "'. Advice: ' || advice", "'. '"),
        _unless(6, "''", "' Follow-up: soon'"),
        "CASE WHEN defect = 7 THEN '' WHEN defect = 8 THEN ' Follow-up: ' || follow_up || ' Advice: ' || advice ELSE ' Follow-up: ' || follow_up END",
        "CASE WHEN doc_id % 9 = 8 THEN ' ' || text ELSE '' END",
    ]
)
_WITHOUT_OWN = r"regexp_replace(regexp_replace(content, '(?i)Calmex', ' ', 'g'), '(?i)Dorvane', ' ', 'g')"
_RX_ERRORS = [
    ("header", "NOT starts_with(content, header)"),
    ("medicine line", f"NOT ({_has(_FIRST)} AND {_has(_SECOND)})"),
    ("too many medicines", r"regexp_matches(content, '\b3\)')"),
    ("medicine", f"len(list_filter({_NAMES}, lambda m: {_mentions(_WITHOUT_OWN, 'm')} AND NOT {_mentions('advice', 'm')})) > 0"),
    ("advice missing", "NOT contains(content, 'Advice:')"),
    ("follow-up", "NOT contains(content, 'Follow-up: ' || follow_up)"),
    ("order", "contains(content, 'Follow-up: ' || follow_up) AND strpos(content, 'Advice:') > strpos(content, 'Follow-up:')"),
    ("length", "n < 20 OR n > 104"),
]
_RX_WARNINGS = [("advice", f"{_covered('advice', 'content')} < 0.5"), ("length", "n BETWEEN 20 AND 104 AND (n < 40 OR n > 80)")]


@query(f"SELECT doc_id, {_sql_rules(_RX_ERRORS)} AS errors, {_sql_rules(_RX_WARNINGS)} AS warnings FROM (SELECT *, {_COUNTED} AS n, {_RX_HEADER} AS header FROM ({_notes_sql(_RX)}))")
def prescription_rules(spark, sf_dir):
    taken = "array(named_struct('name', 'Calmex', 'dosage', '5 mg', 'frequency', 'twice daily', 'duration', '7 days'), named_struct('name', 'Dorvane', 'dosage', '10 mg', 'frequency', 'at night', 'duration', '14 days'))"
    rows = _facts(spark, sf_dir).withColumn("content", F.expr(_RX)).withColumn("medicines", F.expr(taken))
    return _joined(validate.check(rows, validate.prescription(MEDICINES)))


_FAQ = " || ".join(
    [
        _unless(1, "'Q: '", "'Question: '"),
        _unless(2, "'When is ' || doctor_name || ' in the clinic'", "'Any news'"),
        "'? A: '",
        _unless(3, "doctor_name", "'Someone'"),
        _unless(4, "' sits in room ' || CAST(100 + doc_id % 40 AS STRING)", "' sits in a room'"),
        _unless(5, "', on the ground floor, and opens the door at ' || time_slot", "', upstairs'"),
        "'.'",
        "CASE WHEN doc_id % 9 = 8 THEN ' ' || text ELSE '' END",
    ]
)
_FACT_1, _FACT_2 = "doctor_name || ' sits in room ' || CAST(100 + doc_id % 40 AS STRING)", "'ground floor, door opens at ' || time_slot"
_SHAPED = r"regexp_matches(content, '^Q: (.+?) A: (.+)$')"


def _missed(fact: str) -> str:
    return rf"({_missing_numbers(fact, 'answer')} OR len(list_filter(regexp_extract_all({fact}, '\b[A-Z][A-Za-z]*'), lambda w: w NOT IN ('I', 'A') AND NOT contains(answer, w))) > 0 OR {_covered(fact, 'answer')} < 0.5)"


_FAQ_ERRORS = [("shape", "NOT shaped"), ("fact", f"shaped AND ({_missed('fact_1')} OR {_missed('fact_2')})"), ("length", "shaped AND (n < 5 OR n > 52)")]
_FAQ_WARNINGS = [("question", f"shaped AND {_covered('hint', 'question')} < 0.3"), ("length", "shaped AND n BETWEEN 5 AND 52 AND (n < 10 OR n > 40)")]


@query(rf"""SELECT doc_id, {_sql_rules(_FAQ_ERRORS)} AS errors, {_sql_rules(_FAQ_WARNINGS)} AS warnings
FROM (SELECT *, {_COUNTED} AS n, {_SHAPED} AS shaped, regexp_extract(content, '^Q: (.+?) A: (.+)$', 1) AS question, regexp_extract(content, '^Q: (.+?) A: (.+)$', 2) AS answer,
    {_FACT_1} AS fact_1, {_FACT_2} AS fact_2, 'clinic times of ' || doctor_name AS hint FROM ({_notes_sql(_FAQ)}))""")
def faq_rules(spark, sf_dir):
    rows = _facts(spark, sf_dir).withColumn("content", F.expr(_FAQ)).withColumn("answer_facts", F.array(F.expr(_FACT_1), F.expr(_FACT_2)))
    rows = rows.withColumn("question_hint", F.expr("'clinic times of ' || doctor_name")).withColumn("length_words", F.lit("10-40"))
    return _joined(validate.check(rows, validate.faq()))


_KIND = _one_of("doc_id", "'visit_note'", "'faq'", "'prescription'", "'faq'")
_MANIFEST = {"doc_id": "doc_id", "slice": "source", "position": "doc_id", "record_type": _KIND, "group_id": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'VISIT-' || CAST(doc_id AS STRING) END"}
_OUTPUT = {
    "slice": "source", "layer": "0", "line": "doc_id", "doc_id": "CASE WHEN doc_id % 31 = 7 THEN -doc_id ELSE doc_id END",
    "group_id": "CASE WHEN doc_id % 17 = 3 THEN 'other' WHEN doc_id % 5 = 0 THEN '' ELSE 'VISIT-' || CAST(doc_id AS STRING) END",
    "record_type": f"CASE WHEN doc_id % 19 = 4 THEN 'note' ELSE {_KIND} END", "content": "text",
}
#: A second layer that mends some rows, and a line of the first that comes twice.
_MENDED = _OUTPUT | {"layer": "1", "group_id": _MANIFEST["group_id"], "record_type": _KIND}
_AGAIN = _OUTPUT | {"line": "doc_id + 1000000000"}


def _of(columns: dict[str, str], where: str = "true") -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM documents WHERE {where}"


_CHECKED = f"""m AS ({_of(_MANIFEST)}),
o AS ({_of(_OUTPUT)} UNION ALL {_of(_MENDED, 'doc_id % 17 = 3 AND doc_id % 2 = 0')} UNION ALL {_of(_AGAIN, 'doc_id % 23 = 5')}),
l AS (SELECT *, row_number() OVER (PARTITION BY slice, doc_id ORDER BY layer DESC, line DESC) AS r FROM o),
g AS (SELECT DISTINCT slice, doc_id, true AS again FROM o GROUP BY slice, layer, doc_id HAVING count(*) > 1),
f AS (SELECT m.*, l.doc_id IS NOT NULL AS found, l.group_id AS out_group, l.record_type AS out_type, l.content, coalesce(g.again, false) AS again
    FROM m LEFT JOIN l ON m.doc_id = l.doc_id AND m.slice = l.slice AND l.r = 1 LEFT JOIN g ON m.doc_id = g.doc_id AND m.slice = g.slice),
s AS (SELECT doc_id, slice, position, record_type, list_distinct({_content('content')}) AS w FROM f WHERE found AND record_type <> 'prescription'),
t AS (SELECT doc_id, slice, position, record_type, len(w) AS n, unnest(w) AS token FROM s),
p AS (SELECT a.doc_id, b.doc_id AS other FROM t a JOIN t b ON a.token = b.token AND a.record_type = b.record_type AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
    AND (a.slice <> b.slice OR b.position < a.position) GROUP BY 1, 2 HAVING 10 * count(*) >= 9 * (any_value(a.n) + any_value(b.n) - count(*))),
c AS (SELECT doc_id, slice, found, {_sql_rules([
    ("missing", "NOT found"), ("near-duplicate", "doc_id IN (SELECT doc_id FROM p)"),
    ("group_id", "found AND coalesce(out_group, '') <> coalesce(group_id, '')"), ("record_type", "found AND out_type <> record_type"),
    ("line break", r"found AND regexp_matches(content, '[\r\n]')"), ("double quote", "found AND contains(content, chr(34))"),
    ("id", r"found AND regexp_matches(content, '\b(PAT|DOC|VN|RX|VISIT|FAQI?|DX)-\d')"),
])} AS errors, CASE WHEN found AND again THEN 'repeated' ELSE '' END AS warnings FROM f)"""


def _checked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(checked rows of a manifest, output that it doesn't know): documents are both, the output with defects and layers."""
    docs = table(spark, sf_dir, "documents")
    made = lambda columns, where: docs.where(where).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])
    facts = made(_MANIFEST, "true")
    output = made(_OUTPUT, "true").unionByName(made(_MENDED, "doc_id % 17 = 3 AND doc_id % 2 = 0")).unionByName(made(_AGAIN, "doc_id % 23 = 5"))
    extra = records.latest(output, ["slice", "doc_id"], [F.col("layer"), F.col("line")]).join(facts.select("doc_id"), "doc_id", "left_anti").select("doc_id", "slice")
    return building.validated(facts, output, {}), extra


@query(f"WITH {_CHECKED} SELECT doc_id, errors, warnings FROM c")
def checked_records(spark, sf_dir):
    """Every row of a manifest with the problems of its latest output: missing, repeated, near copies, identity, common rules."""
    return _joined(_checked(spark, sf_dir)[0])


@query(f"""WITH {_CHECKED} SELECT slice, count(*) AS rows_expected, count(*) FILTER (found) AS rows_found, count(*) FILTER (errors = '') AS rows_passed, count(*) FILTER (errors <> '') AS rows_failed,
    count(*) FILTER (warnings <> '') AS rows_with_warnings, count(*) FILTER (errors <> '') = 0 AS ok FROM c GROUP BY slice""")
def slice_report(spark, sf_dir):
    return validate.report(_checked(spark, sf_dir)[0], "slice")


@query(f"""WITH {_CHECKED} SELECT doc_id, slice, CASE WHEN found THEN 'validator errors' ELSE 'missing' END AS reason FROM c WHERE errors <> ''
UNION ALL SELECT DISTINCT doc_id, slice, 'not in manifest' FROM o WHERE doc_id NOT IN (SELECT doc_id FROM m)""")
def build_excluded(spark, sf_dir):
    """What a build leaves out, and why."""
    return building.build(*_checked(spark, sf_dir))[1]


_SYMPTOMS = r"""trim(regexp_replace(regexp_replace(regexp_replace(substr(content, s, greatest(CASE WHEN e > 1 THEN e ELSE len(content) + 1 END - s, 0)),
    '\b(Mr|Mrs|Ms|Miss)\.? [A-Z][a-z]+', 'The patient', 'g'), '\b' || split_part(patient_name, ' ', 1) || '\b', 'the patient', 'g'), '\b' || split_part(patient_name, ' ', 2) || '\b', 'the patient', 'g'))"""
_SPOKEN = f"{_HEADER} || ' Mrs. ' || split_part(patient_name, ' ', 2) || ' has a cough. ' || patient_name || ' sleeps badly' || CASE WHEN defect = 1 THEN '' ELSE '. On examination all is well.' END"


@query(rf"""SELECT doc_id, {_SYMPTOMS} AS symptoms, nullif(regexp_extract(content, '\| Patient: ([^,|]+),', 1), '') AS patient, contains(lower(content), lower(diagnosis)) AS names_diagnosis, {_mentions('content', 'specialization')} AS names_specialization
FROM (SELECT *, strpos(content, 'Patient: ') + len(regexp_extract(content, '(Patient: [^.]*\.\s*)', 1)) AS s, strpos(content, ' On examination') AS e FROM ({_notes_sql(_SPOKEN)}))""")
def symptom_texts(spark, sf_dir):
    """What patients tell, without their names; the patient that a note names; and whether it names a diagnosis or specialization."""
    notes, c = _facts(spark, sf_dir).withColumn("content", F.expr(_SPOKEN)), F.col("content")
    return notes.select("doc_id", T.symptom_text(c, F.col("patient_name")).alias("symptoms"), T.patient_of(c).alias("patient"), T.contains_ci(c, F.col("diagnosis")).alias("names_diagnosis"), T.mentions(c, F.col("specialization")).alias("names_specialization"))


@query(rf"""SELECT conv_id, turn, regexp_matches(coalesce(text, ''), '{T.REFUSAL.replace("'", "''")}') AS refuses,
    len(trim(text)) > 120 OR len(regexp_extract_all(text, '\?')) >= 2 OR regexp_matches(text, '{T.COMPLEX}') AS complex,
    CASE WHEN len(x) = 1 THEN x[1] END AS label, len(list_filter(regexp_extract_all(text, '\b[A-Z][A-Za-z]*'), lambda w: w NOT IN ('I', 'A'))) AS n_names
FROM (SELECT *, list_filter(['the', 'that', 'with'], lambda m: {_mentions('text', 'm')}) AS x FROM conversations)""")
def turn_labels(spark, sf_dir):
    """Whether turns refuse or ask for much, the one of three words that they name, and how many proper names they have."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_refusal(t).alias("refuses"), T.is_complex(t).alias("complex"), T.routing_label(t, ["the", "that", "with"]).alias("label"), F.size(T.proper_names(t)).cast("long").alias("n_names"))


_CASED = "upper(substr(rtrim(regexp_replace(trim(advice), '\\.+$', '')), 1, 1)) || substr(rtrim(regexp_replace(trim(advice), '\\.+$', '')), 2) || '.'"


@query(f"""SELECT doc_id, {_RX_HEADER} || ' ' || {_FIRST} || CASE WHEN doc_id % 2 = 0 THEN '; ' || {_SECOND} ELSE '' END || '. Advice: ' || {_CASED} || ' Follow-up: ' || follow_up AS content,
    {_one_of('doc_id', "''", "'Calmex'", "'Calmex and Dorvane'", "'Calmex, Dorvane, and Pulmira'")} AS medicines FROM ({_FACTS_SQL})""")
def rendered_prescriptions(spark, sf_dir):
    """Prescriptions with one or two medicines, and lists in words of none to three."""
    one = [F.struct(*[F.lit(v).alias(k) for k, v in zip(("name", "dosage", "frequency", "duration"), m)]) for m in (("Calmex", "5 mg", "twice daily", "7 days"), ("Dorvane", "10 mg", "at night", "14 days"))]
    taken = F.when(F.col("doc_id") % 2 == 0, F.array(*one)).otherwise(F.array(one[0]))
    named = F.slice(F.array(*[F.lit(m) for m in MEDICINES]), F.lit(1), F.pmod("doc_id", F.lit(4)).cast("int"))
    return _facts(spark, sf_dir).select("doc_id", T.prescription(F.expr(_RX_HEADER), taken, F.col("advice"), F.col("follow_up")).alias("content"), T.english_list(named).alias("medicines"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal IS NOT NULL THEN greatest(0.0, least(1.0, c_acctbal / 5000))::DOUBLE END AS share, nullif(TRY_CAST(CASE c_custkey % 4 WHEN 0 THEN '0' WHEN 1 THEN 'none' WHEN 2 THEN '2.5' ELSE c_custkey::VARCHAR END AS DOUBLE), 0) AS number,
    least(5000 * pow(2.0, c_custkey % 8), 90000)::DOUBLE AS wait_ms, CASE WHEN c_custkey % 2 = 0 THEN round_even(c_acctbal::DOUBLE / 8, 1)::DOUBLE END AS even FROM customer""")
def number_guards(spark, sf_dir):
    """Shares cut to 0 and 1, numbers other than 0, waiting times and rounding of halves to even."""
    k = F.col("c_custkey")
    said = F.when(k % 4 == 0, "0").when(k % 4 == 1, "none").when(k % 4 == 2, "2.5").otherwise(k.cast("string"))
    even = F.when(k % 2 == 0, numeric.round_even(F.col("c_acctbal").cast("double") / 8, 1))
    return table(spark, sf_dir, "customer").select("c_custkey", numeric.unit_interval(F.col("c_acctbal").cast("double") / 5000).alias("share"), numeric.number_or_null(said).alias("number"), numeric.backoff(k % 8 + 1).alias("wait_ms"), even.alias("even"))


@query("SELECT vec_id, true AS same, len(embedding) AS size FROM embeddings")
def vectors_as_text(spark, sf_dir):
    """Vectors written as text and read back are the same."""
    back = numeric.parse_vector(numeric.vector_text(F.col("embedding")))
    return table(spark, sf_dir, "embeddings").select("vec_id", back.eqNullSafe(F.col("embedding").cast("array<float>")).alias("same"), F.size(back).cast("long").alias("size"))


_PLANS = _one_of("p_partkey", "'tests'", "'referral'", "'continue'", "'lifestyle'", "'prescription'")
_REGIMENS = "CASE WHEN p_size % 4 = 0 THEN array('only ' || p_brand) ELSE array('first ' || p_brand, 'second ' || p_type) END"


@query(f"""SELECT p_partkey, CASE plan WHEN 'continue' THEN 'chronic follow-up: continue current medicines, no new prescription issued' WHEN 'tests' THEN 'tests ordered before starting treatment: ' || p_type
    WHEN 'lifestyle' THEN 'lifestyle and self-care advice only, no medicine needed at this stage' WHEN 'referral' THEN 'referral to ' || p_brand || ' in this clinic for further assessment' END AS note,
    CASE WHEN plan = 'prescription' THEN regimens[CASE WHEN len(regimens) > 1 AND u < 0.3 THEN 2 ELSE 1 END] END AS regimen,
    CASE plan WHEN 'tests' THEN 'after the test results are ready' WHEN 'referral' THEN 'after the ' || p_brand || ' review' ELSE 'usual' END AS follow_up
FROM ({draw_sql('p_partkey', '21', 'u', f"SELECT *, {_PLANS} AS plan, {_REGIMENS.replace('array(', '(').replace("('only ' || p_brand)", "['only ' || p_brand]").replace("('first ' || p_brand, 'second ' || p_type)", "['first ' || p_brand, 'second ' || p_type]")} AS regimens FROM part")})""")
def plan_choices(spark, sf_dir):
    """What each plan notes, prescribes and has as its follow-up, over parts."""
    rows = table(spark, sf_dir, "part").withColumn("plan", F.expr(_PLANS)).withColumn("regimens", F.expr(_REGIMENS))
    plan = F.col("plan")
    return rows.select(
        "p_partkey", clinical.plan_note(plan, F.col("p_type"), F.col("p_brand")).alias("note"), clinical.regimen(plan, F.col("regimens"), F.col("p_partkey"), F.lit(21)).alias("regimen"),
        clinical.follow_up(plan, F.col("p_brand"), F.lit("usual")).alias("follow_up"),
    )


_JOB = _one_of("p_partkey", "'homemaker'", "'welder'", "'university student'", "'retired civil servant'", "'school teacher'")
_TRIGGER = _one_of("p_size", "'long shift at work'", "'exam week'", "'cold weather'", "'Office air'")
_PLAN = _one_of("p_partkey", "'tests'", "'referral'", "'continue'")


@query(f"""SELECT p_partkey, NOT (regexp_matches(t, '{clinical.WORK}') AND job IN ('retired civil servant', 'homemaker', 'university student')) AND NOT (regexp_matches(t, '{clinical.STUDY}') AND job <> 'university student') AS fits,
    CASE plan WHEN 'tests' THEN 'after the test results are ready' WHEN 'referral' THEN 'after the ' || p_type || ' review' ELSE 'usual' END AS follow_up,
    array_to_string(list_filter([CASE WHEN p_size % 3 = 0 THEN 'multi_visit' END, CASE WHEN p_size % 4 = 0 THEN 'comorbidity' END, CASE WHEN plan = 'referral' THEN 'referral' END, CASE WHEN 50 + p_size >= 70 THEN 'elderly' END], lambda x: x IS NOT NULL), ';') AS tags,
    50 + p_size BETWEEN 61 AND 89 AND (p_size % 2 = 0 OR p_partkey % 3 = 0) AND p_size % 8 + 2 <= 8 AND p_size % 5 <> 1 AS able
FROM (SELECT *, {_JOB} AS job, {_TRIGGER} AS t, {_PLAN} AS plan FROM part)""")
def visit_facts(spark, sf_dir):
    """Triggers that fit occupations, follow-ups, edge tags, and patients who can have an episode, over parts."""
    rows = table(spark, sf_dir, "part").withColumn("job", F.expr(_JOB)).withColumn("t", F.expr(_TRIGGER)).withColumn("plan", F.expr(_PLAN))
    size, key = F.col("p_size"), F.col("p_partkey")
    gender, sex = F.when(key % 3 == 0, "female").otherwise("male"), F.when(size % 2 == 1, "female")
    able = clinical.eligible(50 + size, gender, size % 8, F.array(size % 5), F.lit(1), F.lit(60), F.lit(90), sex, F.lit(2))
    tags = clinical.edge_tags(size % 3 == 0, F.when(size % 4 == 0, "asthma").otherwise("none"), F.col("plan"), 50 + size)
    return rows.select("p_partkey", clinical.trigger_fits(F.col("t"), F.col("job")).alias("fits"), clinical.follow_up(F.col("plan"), F.col("p_type"), F.lit("usual")).alias("follow_up"), F.array_join(tags, ";").alias("tags"), able.alias("able"))


_VISITS_SQL = """v AS (SELECT o_orderkey // 2 AS doc_id, o_custkey AS patient, n_suppliers.s_name AS doctor, 'DX-' || o_custkey % 48 AS diagnosis_id, o_orderdate::DATE AS day, o_custkey,
    CASE o_orderkey % 5 WHEN 0 THEN 'Sun' ELSE substr(dayname(o_orderdate), 1, 3) END AS weekday, CASE o_orderkey % 4 WHEN 0 THEN '09:00 AM' WHEN 1 THEN '03:00 PM' ELSE '11:00 AM' END AS slot,
    (o_orderdate - to_days((6000 + o_custkey % 20000)::INT))::DATE AS birth, CASE WHEN o_custkey % 2 = 0 THEN 'female' ELSE 'male' END AS gender, s_suppkey
    FROM orders JOIN supplier n_suppliers ON s_suppkey = o_custkey % 10 + 1),
e AS (SELECT *, year(day) - year(birth) - (strftime(day, '%m%d') < strftime(birth, '%m%d'))::INT AS age, CASE s_suppkey % 3 WHEN 0 THEN ['Sun', 'Tue', 'Thu'] WHEN 1 THEN ['Mon', 'Wed', 'Sat'] ELSE ['Sun', 'Wed', 'Thu'] END AS days,
    CASE s_suppkey % 3 WHEN 0 THEN ['09:00 AM', '09:30 AM', '10:00 AM'] WHEN 1 THEN ['03:00 PM', '03:30 PM'] ELSE ['11:00 AM', '04:00 PM', '05:30 PM'] END AS slots, o_custkey % 48 AS d
    FROM v WHERE o_custkey % 48 % 12 IN (SELECT s_suppkey % 12 FROM supplier))"""


@query(f"""WITH {_VISITS_SQL}, r AS (
SELECT 'weekday' AS rule, count(*) FILTER (NOT list_contains(days, weekday) OR substr(dayname(day), 1, 3) <> weekday) AS n FROM e
UNION ALL SELECT 'slot', count(*) FILTER (NOT list_contains(slots, slot)) FROM e
UNION ALL SELECT 'age', count(*) FILTER (age NOT BETWEEN 18 + d % 5 * 4 AND 60 + d % 7 * 4) FROM e
UNION ALL SELECT 'sex', count(*) FILTER (d % 9 = 0 AND gender <> 'female') FROM e
UNION ALL SELECT 'doctor twice', count(*) FROM (SELECT 1 FROM v GROUP BY doctor, day, slot HAVING count(*) > 1)
UNION ALL SELECT 'patient twice', count(*) FROM (SELECT 1 FROM v GROUP BY patient, day HAVING count(*) > 1)
UNION ALL SELECT 'number twice', count(*) FROM (SELECT 1 FROM v GROUP BY doc_id HAVING count(*) > 1)) SELECT rule, n FROM r WHERE n > 0""")
def broken_manifest_rules(spark, sf_dir):
    """The rules that orders break when they are read as visits without any planning."""
    doctors, diagnoses = learning._catalogue(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").withColumn("s_suppkey", F.col("o_custkey") % 10 + 1).join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("doctor")), "s_suppkey")
    day, key = F.to_date("o_orderdate"), F.col("o_orderkey")
    visits = orders.select(
        F.floor(key / 2).alias("doc_id"), F.col("o_custkey").alias("patient"), "doctor", F.concat(F.lit("DX-"), (F.col("o_custkey") % 48).cast("string")).alias("diagnosis_id"), day.alias("day"),
        F.when(key % 5 == 0, "Sun").otherwise(F.date_format(day, "EEE")).alias("weekday"), F.when(key % 4 == 0, "09:00 AM").when(key % 4 == 1, "03:00 PM").otherwise("11:00 AM").alias("slot"),
        F.date_sub(day, (6000 + F.col("o_custkey") % 20000).cast("int")).alias("birth"), F.when(F.col("o_custkey") % 2 == 0, "female").otherwise("male").alias("gender"),
    )
    return manifest.broken_rules(visits, doctors, diagnoses)


@query("""SELECT DISTINCT text FROM (SELECT text FROM benchmark UNION SELECT text FROM conversations WHERE role = 'user') WHERE text IS NOT NULL AND text NOT IN (SELECT text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL)""")
def texts_to_embed(spark, sf_dir):
    """The distinct texts of two tables that a cache of texts doesn't have."""
    turns = table(spark, sf_dir, "conversations")
    asked = table(spark, sf_dir, "benchmark").select("text").union(turns.where("role = 'user'").select("text")).where("text IS NOT NULL").distinct()
    return asked.join(turns.where("role = 'assistant'").select("text"), "text", "left_anti")


_ASKED = """SELECT doc_id, toxic, batch, row_number() OVER (PARTITION BY batch ORDER BY doc_id) AS place FROM (SELECT doc_id, toxic, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM labels)"""


@query(f"""SELECT toxic AS label, count(*) AS n, avg((predicted IS NOT DISTINCT FROM toxic::VARCHAR)::INT)::DOUBLE AS accuracy FROM (
    SELECT *, CASE WHEN batch % 7 = 3 THEN NULL WHEN place % 5 = 0 THEN 'x' ELSE '0' END AS predicted FROM ({_ASKED})) GROUP BY toxic""")
def zero_shot_labels(spark, sf_dir):
    """Batches of sixteen are asked at once; replies are JSON lists, and a list of another length counts for no row."""
    placed = records.numbered(table(spark, sf_dir, "labels").select("doc_id", "toxic"), ["doc_id"])
    asked = placed.select("doc_id", "toxic", F.floor(F.col("position") / 16).alias("batch"), (F.col("position") % 16 + 1).alias("place"))
    size = asked.groupBy("batch").agg(F.max("place").alias("n"))
    marks = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.when(i % 5 == 0, F.lit("x")).otherwise(F.lit("0")))
    said = F.concat(F.lit("Labels: "), F.when(F.col("batch") % 7 == 3, F.lit('["0"]')).otherwise(F.to_json(marks)), F.lit(" as asked"))
    replies = size.where("NOT (n = 1 AND batch % 7 = 3)").select("batch", said.alias("content"))
    predicted = search.listed_labels(asked, replies)
    return predicted.groupBy(F.col("toxic").alias("label")).agg(F.count("*").alias("n"), F.avg(F.col("predicted").eqNullSafe(F.col("toxic").cast("string")).cast("int")).alias("accuracy"))


@query("""SELECT conv_id, 'Question: ' || any_value(text) FILTER (turn = first) || chr(10) || string_agg('[' || place || '] ' || regexp_replace(substr(text, 1, 60), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), chr(10) ORDER BY place) FILTER (place BETWEEN 1 AND 20) AS prompt
FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id HAVING count(*) > 1""")
def passage_prompts(spark, sf_dir):
    """A question (the first turn) over its numbered passages (the twenty next turns: a prompt has twenty candidates)."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    placed = turns.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    asked = placed.where("place = 0").select("conv_id", F.col("text").alias("question"))
    cut = F.regexp_replace(F.substring("text", 1, 60), "[ \\t\\n\\r\\f\\x0B]+", " ")
    listed = search.numbered_passages(placed.where("place BETWEEN 1 AND 20").withColumn("passage", cut), "conv_id", "place", F.col("passage"))
    return asked.join(listed, "conv_id").select("conv_id", F.concat(F.lit("Question: "), F.col("question"), F.lit("\n"), F.col("passages")).alias("prompt"))


@query("""SELECT item_id, place FROM (SELECT item_id, row_number() OVER (ORDER BY len(text) % 3 * 100 + len(text) % 40, item_id) AS place FROM benchmark)""")
def restrictive_first(spark, sf_dir):
    """Items in the order of a key, those with the same key in their own order."""
    keyed = table(spark, sf_dir, "benchmark").select("item_id", (F.length("text") % 3 * 100 + F.length("text") % 40).alias("key"))
    return records.numbered(keyed, ["key", "item_id"]).select("item_id", (F.col("position") + 1).alias("place"))
