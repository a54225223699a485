"""Text functions over columns: tokens, stems, coverage, similarity, extraction and rendering.

All are built from Spark's own expressions. Patterns name ASCII classes, so that other engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that don't count as content.
STOP_WORDS = (
    "the and for with from that this have has had was were are his her their them they she him you your our into over after "
    "before about when while since than then also only each every been being will would should could there which what where "
    "who whom does did done more most some such very just onto upon near"
).split()
#: White space as browsers and JavaScript see it; Java's ``\s`` is ASCII only.
WHITE = r"[\s ﻿  -     　]+"
#: A word between white space. Most characters are told by the first range, before all kinds of white space are tried.
WORD = f"[!-~{WHITE.replace('[', '[^', 1)[:-1]}]++"
# Identifiers that must not leak into a text, and how answers refuse.
ID_LEAK = r"\b(PAT|DOC|VN|RX|VISIT|FAQI?|DX)-\d"
REFUSAL = r"(?i)cannot|don't know|do not know|out of scope|unsupported|not able|unable|refuse"


def words(text: Column) -> Column:
    """The words between white space."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def normalize(text: Column) -> Column:
    """Lower case; degree signs go; each run of other characters is one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "°", ""), "[^a-z0-9./%-]+", " ")


def stem(word: Column) -> Column:
    """Without one common ending, six letters at most."""
    return F.substring(F.regexp_replace(word, "(ing|ed|es|s)$", ""), 1, 6)


#: A content word: at the start of a run of word characters, after any dots and hyphens, four characters or more from no digit
#: to no dot or hyphen, and not a stop word up to the end of the run. One pass of one pattern is many times
#: faster than splitting the text and filtering its pieces one by one.
_RUN = "[a-z0-9./%-]"
CONTENT = rf"(?<!{_RUN})[.-]*+(?!(?:{'|'.join(w for w in STOP_WORDS if len(w) > 3)})[.-]*+(?!{_RUN}))([a-z/%]{_RUN}{{2,}}[a-z0-9/%])"


def content_words(text: Column) -> Column:
    """Words of more than three letters, trimmed of dots and hyphens, that are no stop words and start with no digit."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "°", ""), F.lit(CONTENT), F.lit(1))


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(content_words(text), stem))


def covered(targets: DataFrame, sources: DataFrame, least: float) -> DataFrame:
    """(doc_id, item_id, coverage) where a target (doc_id, stems) has a share of ``least`` or more, above 0, of a source's (item_id, stems) stems.

    Counted over shared stems, so no pair without one is looked at; a source without stems has no row.
    """
    wanted = sources.select("item_id", F.size("stems").alias("n"), F.explode("stems").alias("stem"))
    shared = targets.select("doc_id", F.explode("stems").alias("stem")).join(wanted, "stem").groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("shared"))
    return shared.select("doc_id", "item_id", (F.col("shared").cast("double") / F.col("n")).alias("coverage")).where(F.col("coverage") >= least)


def coverage(source: Column, target: Column) -> Column:
    """The share of the source's stems that the target has; 1 for a source without any."""
    wanted = stems(source)
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(F.try_divide(F.size(F.array_intersect(wanted, stems(target))).cast("double"), F.size(wanted)))


def numbers(text: Column) -> Column:
    """Runs of digits with inner points, commas and slashes."""
    return F.regexp_extract_all(text, F.lit(r"\d+(?:[.,/]\d+)*"), F.lit(0))


def contains_ci(text: Column, part: Column) -> Column:
    return F.contains(F.lower(text), F.lower(part))


def literal(text: Column) -> Column:
    """A pattern that matches ``text`` itself."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def mentions(text: Column, term: Column) -> Column:
    """Whether ``term`` stands in ``text`` as whole words, in either case."""
    return F.rlike(text, F.concat(F.lit(r"(?i)\b"), literal(term), F.lit(r"\b")))


def patient_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\| Patient: ([^,|]+),", 1), F.lit(""))


def tokens(text: Column) -> Column:
    """Alphanumeric tokens of more than two letters, in lower case."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("İ"), F.lit("i"))), F.lit("[a-z0-9]{3,}"), F.lit(0))


def known_tokens(text: Column) -> Column:
    """``tokens``, but null without a text, which then doesn't count in a mean length."""
    return F.when(text.isNotNull(), tokens(text))


def jaccard(a: Column, b: Column, *, both_empty: float | None = None) -> Column:
    """Shared over all distinct members; of two empty sets ``both_empty``."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(both_empty).cast("double")).otherwise(F.try_divide(shared.cast("double"), every))


def four_proxies(question: Column, answer: Column, context: Column, truth: Column, expect_refuse: Column) -> dict[str, Column]:
    """Lexical stand-ins for judged scores. Where a refusal is expected, the answer counts whole if it refuses and half if not, and there are no context scores."""
    q, a, c, g = (tokens(x) for x in (question, answer, context, truth))
    overlap = lambda x, y: jaccard(x, y, both_empty=1.0)
    said = F.when(is_refusal(answer), 1.0).otherwise(0.5)
    return {
        "faithfulness": F.when(expect_refuse, said).otherwise(overlap(a, c)),
        "answer_relevance": F.when(expect_refuse, said).otherwise(0.5 * overlap(a, q) + 0.5 * overlap(a, c)),
        "context_precision": F.when(~expect_refuse, overlap(c, a)),
        "context_recall": F.when(~expect_refuse, overlap(c, g)),
    }


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)^(.*?[.!?])(?:\s.*)?$", 1)


def question_answer(text: Column) -> Column:
    """A struct of question and answer of ``Q: ... A: ...``, null where the text isn't of that form."""
    pattern = r"^Q: (.+?) A: (.+)$"
    return F.when(F.rlike(text, F.lit(pattern)), F.struct(F.regexp_extract(text, pattern, 1).alias("question"), F.regexp_extract(text, pattern, 2).alias("answer")))


def proper_names(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(r"\b[A-Z][A-Za-z]*"), F.lit(0)), lambda w: ~w.isin("I", "A"))


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of the words, each padded by two blanks before and one after."""
    spaced = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    padded = F.transform(spaced, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b), both_empty=0.0)


def json_object(text: Column) -> Column:
    """From the first opening to the last closing brace, null without them."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def json_array(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))


def snippet(text: Column, size: int, *, collapse_first: bool = True) -> Column:
    """White space collapsed and cut to ``size``, in the order wanted."""
    flat = lambda c: F.btrim(F.regexp_replace(c, WHITE, " "))
    return F.substring(flat(text), 1, size) if collapse_first else flat(F.substring(text, 1, size))


def is_refusal(text: Column) -> Column:
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(REFUSAL))


#: Words that join or compare, and what an answer says that gives up.
COMPLEX = r"(?i)\b(and|also|plus|both|compare|versus|vs\.?|difference|as well as|then|after that|before that|in addition|along with|what about|how (?:does|do|is|are).+\b(?:and|versus|vs)\b)\b"
GIVES_UP = r"(?i)do not know|could not find"
#: The same for Java, whose word edges know other letters than ASCII's, and whose ``(?i)`` leaves out the two other letters that fold to ASCII.
_EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_COMPLEX, _GIVES_UP = COMPLEX.replace("s", "[sſ]").replace(r"\b", _EDGE), GIVES_UP.replace("k", "[k\u212a]")


#: Unicode's space separators, which SQL's ``trim`` takes off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def without_spaces(text: Column) -> Column:
    """Without space separators at both ends; line ends and tabs stay."""
    return F.btrim(text, F.lit(SPACES))


def folded(text: Column) -> Column:
    """Lower case letter by letter: no letter depends on those before it, and none becomes two."""
    return F.lower(F.translate(text, "Σİ", "σi"))


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{WHITE}|{WHITE}$", "")


def is_complex(question: Column, trim=trimmed) -> Column:
    """Longer than 120 characters, several questions, or words that join or compare."""
    asked = trim(question)
    return (F.length(asked) > 120) | (F.regexp_count(asked, F.lit(r"\?")) >= 2) | F.rlike(asked, F.lit(_COMPLEX))


def gives_up(answer: Column) -> Column:
    return F.rlike(answer, F.lit(_GIVES_UP))


def routing_label(text: Column, labels: list[str]) -> Column:
    """The one label that the text names, null for none or several."""
    named = F.filter(F.array(*[F.lit(x) for x in labels]), lambda x: mentions(text, x))
    return F.when(F.size(named) == 1, F.get(named, F.lit(0)))


def mask(text: Column, names: Column, by: str) -> Column:
    """``text`` with each of ``names``, as a whole word, replaced."""
    return F.aggregate(names, text, lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"\b"), literal(n), F.lit(r"\b")), F.lit(by)))


def symptom_text(content: Column, patient: Column) -> Column:
    """What a note says between its header and the examination, with titles and the patient's names masked."""
    start = F.regexp_instr(content, F.lit(r"Patient: [^.]*\.\s*"))
    header = F.length(F.regexp_extract(content, r"(Patient: [^.]*\.\s*)", 1))
    end = F.instr(content, " On examination")
    first = F.greatest(start, F.lit(1)) + header
    body = F.substring(content, first, F.greatest(F.when(end > 1, end).otherwise(F.length(content) + 1) - first, F.lit(0)))
    untitled = F.regexp_replace(body, r"\b(Mr|Mrs|Ms|Miss)\.? [A-Z][a-z]+", "The patient")
    return F.btrim(mask(untitled, words(F.coalesce(patient, F.lit(""))), "the patient"))


def sentence_case(text: Column) -> Column:
    """A capital at the start and one full stop at the end."""
    trimmed = F.rtrim(F.regexp_replace(F.btrim(text), r"\.+$", ""))
    return F.concat(F.upper(F.substring(trimmed, 1, 1)), F.substring(trimmed, F.lit(2), F.length(trimmed)), F.lit("."))


def english_list(items: Column) -> Column:
    """``a``; ``a and b``; ``a, b, and c``."""
    n = F.size(items)
    last = F.element_at(items, -1)
    return (
        F.when(n == 0, "")
        .when(n == 1, F.get(items, F.lit(0)))
        .when(n == 2, F.concat_ws(" and ", items))
        .otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), last))
    )


def padded_id(prefix: str, number: Column, width: int = 6) -> Column:
    return F.concat(F.lit(f"{prefix}-"), F.lpad(number.cast("string"), width, "0"))


def prescription(header: Column, medicines: Column, advice: Column, follow_up: Column) -> Column:
    """The text of a prescription: its header, numbered medicines, advice and follow-up."""
    lines = F.transform(medicines, lambda m, i: F.concat((i + 1).cast("string"), F.lit(") "), m["name"], F.lit(" "), F.concat_ws(", ", m["dosage"], m["frequency"], m["duration"])))
    return F.concat(header, F.lit(" "), F.array_join(lines, "; "), F.lit(". Advice: "), sentence_case(advice), F.lit(" Follow-up: "), follow_up)


def length_bounds(span: Column) -> Column:
    """Of ``"120-220"``: lo, hi, and the bounds beyond which a length is an error."""
    lo, hi = (F.split_part(span, F.lit("-"), F.lit(i)).cast("int") for i in (1, 2))
    return F.struct(lo.alias("lo"), hi.alias("hi"), F.least(F.floor(lo * 0.5), F.lit(90)).cast("int").alias("error_lo"), F.ceil(hi * 1.3).cast("int").alias("error_hi"))


def without_cut_line(text: Column, cut: Column) -> Column:
    """``text`` without its last line where ``cut`` says that it ended early."""
    lines = F.split(text, "\n")
    return F.when(cut, F.array_join(F.slice(lines, F.lit(1), F.size(lines) - 1), "\n")).otherwise(text)


def percent(share: Column, digits: int = 2) -> Column:
    """``share`` as per cent with fixed digits; null stays null."""
    return F.when(share.isNotNull(), F.format_string(f"%.{digits}f%%", share * 100))
