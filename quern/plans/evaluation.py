"""Queries of classification and answer evaluation, and of generated text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import numeric
from quern.functions import text as T
from quern.operators import metrics, records
from quern.plans._tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


_CELLS = "cells AS (SELECT quality AS truth, 1 - toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2)"


@query(f"""WITH {_CELLS}, c AS (SELECT DISTINCT unnest([truth, predicted]) AS class FROM cells),
f AS (SELECT class, coalesce(2.0 * sum(n) FILTER (truth = class AND predicted = class) / nullif(coalesce(sum(n) FILTER (truth = class), 0) + coalesce(sum(n) FILTER (predicted = class), 0), 0), 0) AS f1
    FROM c CROSS JOIN cells GROUP BY class)
SELECT count(*) AS classes, avg(f1)::DOUBLE AS macro_f1, any_value(a)::DOUBLE AS accuracy FROM f CROSS JOIN (SELECT sum(n) FILTER (truth = predicted) / sum(n) AS a FROM cells)""")
def macro_f1(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("predicted"))
    return metrics.macro_f1(rows.groupBy("truth", "predicted").agg(F.count("*").alias("n")))


@query('SELECT lang AS "group", count(*) AS n, avg((quality = 1 - toxic)::INT)::DOUBLE AS accuracy FROM labels JOIN documents USING (doc_id) GROUP BY 1')
def accuracy_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.accuracy_by(rows, F.col("lang"), F.col("quality") == 1 - F.col("toxic"))


@query("""SELECT count(*) AS n, min(floor(s * 1e6 + 0.5) / 1e6) AS least, coalesce(min(floor(s * 1e6 + 0.5) / 1e6) >= 0.98, false) AS passed
FROM (SELECT list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)""")
def least_similarity(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    return metrics.least_similarity(pairs, numeric.round_to(numeric.cosine(F.col("embedding"), F.col("other")), 6), 0.98)


@query("""SELECT doc_id, (CASE WHEN quality = 0 THEN CASE WHEN toxic = 1 THEN 1.0 ELSE 0.5 END ELSE toxic / 2.0 END)::DOUBLE AS proxy,
    (CASE WHEN quality = 0 THEN CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END WHEN toxic = 1 THEN 0.2 ELSE 1.0 END)::DOUBLE AS live FROM labels""")
def refusal_scores(spark, sf_dir):
    """Scores of expected and unexpected refusals: those of lexical proxies, and those of live runs."""
    expected, refused = F.col("quality") == 0, F.col("toxic") == 1
    live = metrics.refusal_score(expected, refused, F.when(refused, F.lit(0.2)).otherwise(F.lit(1.0)), wrong=0.0)
    return table(spark, sf_dir, "labels").select("doc_id", metrics.refusal_score(expected, refused, F.col("toxic") / 2).alias("proxy"), live.alias("live"))


@query("""WITH q AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, lower(text) ORDER BY turn) AS copy FROM conversations WHERE role = 'user' AND text IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM q WHERE copy = 1) SELECT conv_id, turn, text, place FROM r WHERE place <= 2""")
def first_questions(spark, sf_dir):
    """Of each conversation the first two questions that differ in more than their case."""
    asked = table(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    return records.first_distinct(asked, "conv_id", F.lower("text"), "turn", 2).select("conv_id", "turn", "text", F.col("place").cast("long").alias("place"))


#: Closing sentences, in turn.
CLOSINGS = ["Please call us with any question.", "Bring this sheet to your next visit.", "Keep the medicines away from children.", "Tell us about any side effect."]


@query(f"SELECT doc_id, {CLOSINGS!r}[((row_number() OVER (ORDER BY doc_id) - 1) % 4)::INT + 1] AS closing FROM documents")
def closing_sentences(spark, sf_dir):
    placed = records.slices(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 50)
    return placed.select("doc_id", F.get(F.array(*map(F.lit, CLOSINGS)), F.pmod("position", F.lit(4)).cast("int")).alias("closing"))


@query("SELECT doc_id, md5(CASE WHEN lang = 'en' THEN array_to_string(string_split(text, chr(10))[:-2], chr(10)) ELSE text END) AS text_md5 FROM documents")
def cut_replies(spark, sf_dir):
    """English texts stand for replies that were cut: their last line goes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.without_cut_line(F.col("text"), F.col("lang") == "en").cast("binary")).alias("text_md5"))


@query("SELECT lang, printf('%.2f%%', 100.0 * count(*) / (SELECT count(*) FROM documents)) AS share FROM documents GROUP BY 1")
def language_shares(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("lang", T.percent(F.col("n") / F.col("total")).alias("share"))  # one row beside each
