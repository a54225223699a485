"""Queries over texts: words, lengths, numbers, coverage, similarity, noise, extraction and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import prng
from quern.functions import text as T
from quern.operators import similarity, validate
from quern.operators.shared import keep, spread
from quern.plans._tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def _content(text: str) -> str:
    """SQL for the content words of ``text``."""
    return f"""list_filter(list_transform(string_split(regexp_replace(replace(lower({text}), '°', ''), '[^a-z0-9./%-]+', ' ', 'g'), ' '), lambda w: trim(w, '.-')),
    lambda w: len(w) > 3 AND NOT list_contains({_STOPS}, w) AND NOT substr(w, 1, 1) BETWEEN '0' AND '9')"""


def _stems(text: str) -> str:
    return f"list_distinct(list_transform({_content(text)}, lambda w: substr(regexp_replace(w, '(ing|ed|es|s)$', ''), 1, 6)))"


def _texts(spark, sf_dir, *more: str) -> DataFrame:
    """Documents whose texts are much work, over all cores where the table is small."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", *more, "text"))


def _proxy_tokens(text: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: len(w) > 2)"


def _jaccard(a: str, b: str, empty: str) -> str:
    return f"""CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN {empty}
    ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"""


@query(f"SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, list_sort(list_distinct(w))[1] AS first_word FROM (SELECT doc_id, {_content('text')} AS w FROM documents)")
def content_words(spark, sf_dir):
    w = _texts(spark, sf_dir).select("doc_id", T.content_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.get(F.array_sort(F.array_distinct("w")), F.lit(0)).alias("first_word"))


@query("""SELECT doc_id, n, CASE WHEN n < 60 OR n > 286 THEN 'error' WHEN n < 120 OR n > 220 THEN 'warning' ELSE 'ok' END AS level
FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v\\x{00a0}]+'), lambda w: w <> '')) AS n FROM documents)""")
def word_length_check(spark, sf_dir):
    """Word counts against the range 120-220."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n"), T.length_bounds(F.lit("120-220")).alias("b"))
    level = F.when((F.col("n") < F.col("b.error_lo")) | (F.col("n") > F.col("b.error_hi")), "error").when((F.col("n") < F.col("b.lo")) | (F.col("n") > F.col("b.hi")), "warning").otherwise("ok")
    return docs.select("doc_id", "n", level.alias("level"))


@query(r"SELECT doc_id, len(x) AS n_numbers, array_to_string(x, ' ') AS numbers FROM (SELECT doc_id, regexp_extract_all(text, '\d+(?:[.,/]\d+)*') AS x FROM documents)")
def number_extract(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", T.numbers(F.col("text")).alias("x"))
    return x.select("doc_id", F.size("x").cast("long").alias("n_numbers"), F.array_join("x", " ").alias("numbers"))


@query(f"""WITH d AS (SELECT doc_id, unnest({_stems('text')}) AS stem FROM documents), i AS (SELECT item_id, {_stems('text')} AS s FROM benchmark),
b AS (SELECT item_id, len(s) AS n, unnest(s) AS stem FROM i)
SELECT doc_id, item_id, count(*)::DOUBLE / any_value(n) AS coverage FROM d JOIN b USING (stem) GROUP BY 1, 2 HAVING 2 * count(*) >= any_value(n)""")
def stem_coverage(spark, sf_dir):
    """All documents that have half of an item's stems or more."""
    docs = _texts(spark, sf_dir).select("doc_id", T.stems(F.col("text")).alias("stems"))
    items = table(spark, sf_dir, "benchmark").select("item_id", T.stems(F.col("text")).alias("stems"))
    return similarity.met(docs, items, "stems", lambda shared, n, m: shared / m >= 0.5, by_size=False).select("doc_id", "item_id", (F.col("shared").cast("double") / F.col("m")).alias("coverage"))


@query(f"""SELECT doc_id, CASE WHEN len(b) = 0 THEN 1.0 ELSE len(list_intersect(b, s))::DOUBLE / len(b) END AS coverage
FROM (SELECT doc_id, {_stems('text')} AS s, {_stems("string_split(text, chr(10))[1]")} AS b FROM documents)""")
def first_line_coverage(spark, sf_dir):
    """The share of the first line's stems that the whole text has."""
    return table(spark, sf_dir, "documents").select("doc_id", T.coverage(F.element_at(F.split("text", "\n"), 1), F.col("text")).alias("coverage"))


def _word_sets(spark, sf_dir) -> DataFrame:
    """Each document's word set, written once: several joins read it, and texts are scanned once."""
    sets = _texts(spark, sf_dir, "source").select("doc_id", "source", F.array_distinct(T.content_words(F.col("text"))).alias("words"))
    return keep(sets, "words")


def _pairs_sql(also: str, by: str) -> str:
    group = ", source" if by else ""
    return f"""WITH s AS (SELECT doc_id, source, list_sort(list_distinct({_content('text')})) AS w FROM documents),
r AS (SELECT min(doc_id) AS id, w{group} FROM s WHERE len(w) > 0 GROUP BY w{group}),
t AS (SELECT id, len(w) AS n{group}, unnest(w) AS token FROM r),
p AS (SELECT a.id AS "left", b.id AS "right", count(*) AS shared, any_value(a.n) + any_value(b.n) - count(*) AS total
    FROM t a JOIN t b ON a.token = b.token AND a.id < b.id {also} AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY 1, 2)
SELECT "left", "right", shared, total FROM p WHERE 10 * shared >= 9 * total"""


def _near_pairs(spark, sf_dir, by: list[str], also: Column | None) -> DataFrame:
    sets = _word_sets(spark, sf_dir)
    reps = similarity.representatives(sets, "doc_id", "words", by)[0]
    found = similarity.similar_pairs(reps, "doc_id", "words", 9, 10, also, by)
    return found.select("left", "right", F.col("shared").cast("long").alias("shared"), F.col("total").cast("long").alias("total"))


@query(_pairs_sql("", ""))
def near_duplicate_pairs(spark, sf_dir):
    """Pairs of different word sets at 0.9, each set by its least document; near_duplicate_classes has the rest."""
    return _near_pairs(spark, sf_dir, [], None)


@query(_pairs_sql("AND a.source IS DISTINCT FROM b.source", "source"))
def near_duplicate_excl_same_source(spark, sf_dir):
    """The same, but of different sources only: a source stands for a patient, whose texts may be alike."""
    return _near_pairs(spark, sf_dir, ["source"], ~F.col("a_source").eqNullSafe(F.col("b_source")))


@query(f"""SELECT doc_id, min(doc_id) OVER (PARTITION BY w) AS rep, len(w) AS n FROM (SELECT doc_id, list_sort(list_distinct({_content('text')})) AS w FROM documents) WHERE len(w) > 0""")
def near_duplicate_classes(spark, sf_dir):
    """Of each document the least one with the same word set."""
    return similarity.classes(_word_sets(spark, sf_dir), "doc_id", "words", []).select("doc_id", "rep", F.col("n").cast("long").alias("n"))


@query(f"""WITH d AS (SELECT doc_id, list_distinct({_content('text')}) AS w FROM documents), b AS (SELECT item_id, list_distinct({_content('text')}) AS w FROM benchmark),
t AS (SELECT doc_id, len(w) AS n, unnest(w) AS token FROM d), u AS (SELECT item_id, len(w) AS n, unnest(w) AS token FROM b)
SELECT doc_id, item_id, count(*) AS shared, count(*)::DOUBLE / (any_value(t.n) + any_value(u.n) - count(*)) AS jaccard
FROM t JOIN u USING (token) GROUP BY 1, 2 HAVING 10 * count(*) >= any_value(t.n) + any_value(u.n) - count(*)""")
def contamination_jaccard(spark, sf_dir):
    """Documents and benchmark items that share a tenth of their content words or more.

    An item's words are few; each task counts its documents' words against all items.
    """
    sets = lambda df, key: df.select(key, F.array_distinct(T.content_words(F.col("text"))).alias("words"))
    found = similarity.met(sets(_texts(spark, sf_dir), "doc_id"), sets(table(spark, sf_dir, "benchmark"), "item_id"), "words", lambda shared, n, m: 10 * shared >= n + m - shared)
    total = F.col("n") + F.col("m") - F.col("shared")
    return found.select("doc_id", "item_id", "shared", (F.col("shared").cast("double") / total).alias("jaccard"))


_TRI = """list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> ''),
    lambda w: list_transform(range(1, len(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""


@query(f"""WITH p AS (SELECT p_name, {_TRI.format('p_name')} AS t FROM (SELECT DISTINCT p_name FROM part))
SELECT a.p_name AS a, b.p_name AS b, len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) AS similarity
FROM p a JOIN p b ON a.p_name < b.p_name AND len(list_intersect(a.t, b.t)) > 0
WHERE 10 * len(list_intersect(a.t, b.t)) >= 3 * len(list_distinct(list_concat(a.t, b.t)))""")
def trigram_similarity(spark, sf_dir):
    """Pairs of part names with trigram similarity of 0.3 or more, by their shared trigrams."""
    names = table(spark, sf_dir, "part").select("p_name").distinct().withColumn("t", T.trigrams(F.col("p_name")))
    return similarity.similar_pairs(names, "p_name", "t", 3, 10).select(F.col("left").alias("a"), F.col("right").alias("b"), (F.col("shared").cast("double") / F.col("total")).alias("similarity"))


@query("""SELECT event_id, CAST(json_extract(regexp_extract('note ' || props || ' end', '(\\{.*\\})', 1), '$.k') AS BIGINT) AS k FROM events""")
def json_in_text(spark, sf_dir):
    found = F.from_json(T.json_object(F.concat(F.lit("note "), F.col("props"), F.lit(" end"))), "k long")
    return table(spark, sf_dir, "events").select("event_id", found["k"].alias("k"))


_MASK = "4294967295"


def draw_sql(seed: str, n: str, into: str, source: str) -> str:
    """SQL that adds the draw ``into`` to the rows of ``source``, in one step for each line of the generator."""
    return f"""SELECT * EXCLUDE (a_, t1_, t2_), xor(t2_, t2_ >> 14)::DOUBLE / 4294967296 AS {into} FROM (
    SELECT *, xor(t1_, (t1_ + ((xor(t1_, t1_ >> 7)::HUGEINT * (t1_ | 61)::HUGEINT) & {_MASK}::HUGEINT)::BIGINT) & {_MASK}) AS t2_ FROM (
    SELECT *, ((xor(a_, a_ >> 15)::HUGEINT * (a_ | 1)::HUGEINT) & {_MASK}::HUGEINT)::BIGINT AS t1_ FROM (
    SELECT *, ((({seed})::HUGEINT + ({n})::HUGEINT * 1831565813) & {_MASK}::HUGEINT)::BIGINT AS a_ FROM ({source}))))"""


@query(f"SELECT n, floor(u * 1e9) AS u9 FROM ({draw_sql('20250', 'n', 'u', 'SELECT event_id AS n FROM events')})")
def prng_draws(spark, sf_dir):
    """Each event's draw: that of its number, wherever the row lies."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("n"), F.floor(prng.draw(20250, F.col("event_id")) * 1e9).cast("double").alias("u9"))


_WORDS50 = "string_split(text, ' ')[1:(1 + doc_id % 50)::BIGINT]"


@query(f"""WITH RECURSIVE b AS (SELECT doc_id, {_WORDS50} AS x FROM documents WHERE text IS NOT NULL),
d AS MATERIALIZED (SELECT doc_id, i, floor(r * (size - i + 1))::BIGINT AS j FROM ({draw_sql('doc_id', 'i', 'r', 'SELECT doc_id, len(x) AS size, unnest(range(1, len(x))) AS i FROM b')})),
r AS (SELECT doc_id, x, 1::BIGINT AS i FROM b
    UNION ALL SELECT r.doc_id, list_transform(x, lambda v, k: CASE WHEN k = len(x) - r.i + 1 THEN x[j + 1] WHEN k = j + 1 THEN x[len(x) - r.i + 1] ELSE v END), r.i + 1 FROM r JOIN d ON d.doc_id = r.doc_id AND d.i = r.i)
SELECT doc_id, array_to_string(x, ' ') AS words FROM r WHERE i >= len(x) OR len(x) = 0""")
def shuffled_words(spark, sf_dir):
    """The first 1 to 50 words of each document, shuffled by its id; the SQL swaps them one after another."""
    words = F.slice(F.split("text", " ", -1), F.lit(1), (1 + F.col("doc_id") % 50).cast("int"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(prng.shuffle(F.col("doc_id"), words), " ").alias("words"))


_TYPO = draw_sql("doc_id", "4 * i + 4", "r4", draw_sql("doc_id", "4 * i + 3", "r3", draw_sql("doc_id", "4 * i + 2", "r2", draw_sql("doc_id", "4 * i + 1", "r1", "SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) - 1 AS i FROM (SELECT doc_id, string_split(text, ' ') AS x FROM documents)"))))
_KEYS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in prng.NEIGHBOURS.items()) + "}"


@query(f"""SELECT doc_id, sha256(string_agg(CASE WHEN r1 >= 0.35 OR len(w) < 4 THEN w
    WHEN op = 0 THEN substr(w, 1, p - 1) || substr(w, p + 1, 1) || substr(w, p, 1) || substr(w, p + 2)
    WHEN op = 1 THEN substr(w, 1, p - 1) || substr(w, p + 1)
    WHEN op = 2 THEN substr(w, 1, p) || substr(w, p)
    WHEN k IS NULL THEN w ELSE substr(w, 1, p - 1) || substr(k, floor(r4 * len(k))::INT + 1, 1) || substr(w, p + 1) END, ' ' ORDER BY i)) AS noisy_sha256
FROM (SELECT *, {_KEYS}[lower(substr(w, p, 1))] AS k FROM (SELECT *, floor(r2 * (len(w) - 2))::INT + 2 AS p, floor(r3 * 4)::INT AS op FROM ({_TYPO})))
GROUP BY doc_id""")
def typo_noise(spark, sf_dir):
    """Typos at a rate of 0.35 in every whole text, by seeds of the documents' own."""
    noisy = prng.add_typos(F.col("text"), F.col("doc_id"), 0.35)
    return _texts(spark, sf_dir).select("doc_id", F.sha2(noisy, 256).alias("noisy_sha256"))


@query(r"SELECT doc_id, regexp_extract(text, '^((?s:.*?)[.!?])(?:\s(?s:.*))?$', 1) AS first FROM documents")
def first_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("first"))


@query(f"""WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next_role, lag(text) OVER w AS context FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT conv_id, turn, {_proxy_tokens('text')} AS q, {_proxy_tokens('answer')} AS a, {_proxy_tokens('context')} AS c FROM t WHERE role = 'user' AND next_role = 'assistant'),
s AS (SELECT conv_id, turn, {_jaccard('a', 'c', '1.0')} AS faithfulness, {_jaccard('a', 'q', '1.0')} AS aq FROM i)
SELECT conv_id, turn, floor(faithfulness * 10000 + 0.5) / 10000 AS faithfulness, floor((0.5 * aq + 0.5 * faithfulness) * 10000 + 0.5) / 10000 AS answer_relevance FROM s""")
def ragas_proxy(spark, sf_dir):
    """Lexical proxies of each question and its answer; the turn before is the context."""
    from pyspark.sql import Window

    from quern.functions.numeric import round_to

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next_role"), F.lag("text").over(w).alias("context"))
    i = t.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", *[T.tokens(F.col(c)).alias(n) for c, n in (("text", "q"), ("answer", "a"), ("context", "c"))])
    s = i.select("conv_id", "turn", T.jaccard(F.col("a"), F.col("c"), both_empty=1.0).alias("faithfulness"), T.jaccard(F.col("a"), F.col("q"), both_empty=1.0).alias("aq"))
    return s.select("conv_id", "turn", round_to(F.col("faithfulness"), 4).alias("faithfulness"), round_to(0.5 * F.col("aq") + 0.5 * F.col("faithfulness"), 4).alias("answer_relevance"))


_FOUR = f"""WITH t AS (SELECT conv_id, turn, role, text, lead(text) OVER w AS answer, lead(role) OVER w AS next_role, list(coalesce(text, '')) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS contexts,
    last_value(text) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS truth FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT conv_id, turn, turn % 5 = 0 AS expect_refuse, regexp_matches(coalesce(answer, ''), '{T.REFUSAL.replace("'", "''")}') AS refuses, len(coalesce(contexts, [])) AS n_contexts,
    {_proxy_tokens('text')} AS q, {_proxy_tokens('answer')} AS a, {_proxy_tokens("coalesce(array_to_string(contexts, chr(10)), '')")} AS c, {_proxy_tokens('truth')} AS g FROM t WHERE role = 'user' AND next_role = 'assistant'),
s AS (SELECT *, {_jaccard('a', 'c', '1.0')} AS ac, {_jaccard('a', 'q', '1.0')} AS aq, {_jaccard('c', 'a', '1.0')} AS ca, {_jaccard('c', 'g', '1.0')} AS cg, CASE WHEN refuses THEN 1.0 ELSE 0.5 END AS said FROM i)
SELECT conv_id, turn, expect_refuse AS refused, n_contexts, floor(CASE WHEN expect_refuse THEN said ELSE ac END * 10000 + 0.5) / 10000 AS faithfulness,
    floor(CASE WHEN expect_refuse THEN said ELSE 0.5 * aq + 0.5 * ac END * 10000 + 0.5) / 10000 AS answer_relevance,
    CASE WHEN NOT expect_refuse THEN floor(ca * 10000 + 0.5) / 10000 END AS context_precision, CASE WHEN NOT expect_refuse THEN floor(cg * 10000 + 0.5) / 10000 END AS context_recall FROM s"""


@query(_FOUR)
def context_metrics(spark, sf_dir):
    """The four lexical proxies of each question: up to three turns before it are its contexts, the conversation's last text is the ground truth, and
    every fifth turn expects a refusal, which has no context metrics."""
    from pyspark.sql import Window

    from quern.functions.numeric import round_to

    w = Window.partitionBy("conv_id").orderBy("turn")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next_role"),
        F.collect_list(F.coalesce("text", F.lit(""))).over(w.rowsBetween(-3, -1)).alias("contexts"), F.last("text").over(whole).alias("truth"),
    )
    i = t.where("role = 'user' AND next_role = 'assistant'").withColumn("context", F.array_join("contexts", "\n"))
    scores = T.four_proxies(F.col("text"), F.col("answer"), F.col("context"), F.col("truth"), F.col("turn") % 5 == 0)
    return i.select("conv_id", "turn", (F.col("turn") % 5 == 0).alias("refused"), F.size("contexts").cast("long").alias("n_contexts"), *[round_to(v, 4).alias(k) for k, v in scores.items()])


@query("""SELECT d.doc_id, array_to_string(list_filter([
    CASE WHEN l.doc_id IS NULL THEN 'not in manifest' END,
    CASE WHEN regexp_matches(text, '[\\r\\n]') THEN 'line break' END,
    CASE WHEN contains(text, '"') THEN 'double quote' END,
    CASE WHEN regexp_matches(text, '\\b(PAT|DOC|VN|RX|VISIT|FAQI?|DX)-\\d') THEN 'id' END,
    CASE WHEN n < 60 OR n > 286 THEN 'length' END], lambda x: x IS NOT NULL), ';') AS errors,
    array_to_string(list_filter([CASE WHEN n BETWEEN 60 AND 286 AND (n < 120 OR n > 220) THEN 'length' END], lambda x: x IS NOT NULL), ';') AS warnings
FROM (SELECT doc_id, text, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v\\x{00a0}]+'), lambda w: w <> '')) AS n FROM documents) d LEFT JOIN labels l USING (doc_id)""")
def validator_checks(spark, sf_dir):
    """The checks that hold for every kind of record, on documents against their labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    known = table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known"))
    rules = [validate.Rule("error", "not in manifest", F.col("known").isNull()), *validate.common(F.col("content")), *validate.length(F.lit("120-220"))]
    return validate.check(docs.join(known, "doc_id", "left"), rules).select("doc_id", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


@query("""SELECT conv_id, count(*) AS n_problems FROM conversations c WHERE len(text) < 120
    AND NOT EXISTS (SELECT 1 FROM conversations o WHERE o.conv_id = c.conv_id AND o.role = c.role AND o.turn > c.turn AND len(o.text) >= 120)
GROUP BY conv_id""")
def unresolved_problems(spark, sf_dir):
    """Malformed rows (short turns) that no later layer of the same key supplies."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", (F.length("text") < 120).alias("malformed"))
    return validate.unresolved(rows, ["conv_id", "role"], "turn", F.col("malformed")).groupBy("conv_id").agg(F.count("*").alias("n_problems"))


@query(f"""SELECT doc_id, regexp_replace(substr(text, 1, 200), '[ \\t\\n\\r\\f\\v]+', ' ', 'g') AS snippet, len(list_filter(string_split(text, ' '), lambda w: regexp_matches(w, '^[A-Z][a-z]+$'))) AS capitals FROM documents""")
def snippets(spark, sf_dir):
    cut = F.regexp_replace(F.substring("text", 1, 200), "[ \\t\\n\\r\\f\\x0B]+", " ")
    return table(spark, sf_dir, "documents").select("doc_id", cut.alias("snippet"), F.size(F.filter(F.split("text", " "), lambda w: F.rlike(w, F.lit("^[A-Z][a-z]+$")))).cast("long").alias("capitals"))
