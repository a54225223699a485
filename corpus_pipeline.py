"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Toxic documents go, one document of each group of near-duplicates stays, benchmark passages go (with the whole document
where they make up a twentieth of it), secrets are replaced by marks, and what is left is packed into sequences of
token ids. All stages but the last return the columns of ``documents``.

In every stage null texts count as empty and stay null, texts of any length are read whole, repeated rows are treated alike
(of those in a group of near-duplicates one stays), rows without doc_id are treated like others, an empty table gives an
empty table, and further columns stay as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import _base, decontaminate, neardup, packing, secrets, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose toxicity is under one half; the held-out fold of labels stays unused here as well."""
    model = toxicity.fit(docs, _base.read(spark, sf_dir, "labels"))
    names, score = docs.columns, _base.fresh(docs, "toxicity")
    return toxicity.score(docs, model, into=score).where(F.col(score) < 0.5).select(*names)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the least id of each group of near-duplicates; rows without id come after all others.

    A row is known by its id and text, so different texts under one id are decided on their own. Rows without words stay.
    """
    names, row, key = docs.columns, _base.fresh(docs, "row"), _base.fresh(docs, "key")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumn(row, F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(F.xxhash64(text), F.lit(1 << 61)))).withColumn(key, F.md5(text.cast("binary")))
    found = _base.keep(neardup.near_duplicates(rows.select(F.col(row).alias("doc_id"), F.col(key).alias("key"), "text"), keys=["key"]), "duplicates").where("n_shingles > 0")
    each = found.groupBy("doc_id", "key").agg(F.first("class_id").alias("class_id"), F.count("*").alias("n"))
    first = each.groupBy("class_id").agg(F.min(F.struct("doc_id", "key")).alias("first")).select("first.*")
    gone = each.join(first, ["doc_id", "key"], "left_anti").select(F.col("doc_id").alias(row), F.col("key").alias(key))
    again = each.where("n > 1").join(first, ["doc_id", "key"], "left_semi").select(F.col("doc_id").alias(row), F.col("key").alias(key))
    hint = lambda d: F.broadcast(d) if d.count() <= neardup.BROADCAST_ROWS else d
    kept = rows.join(hint(gone), [row, key], "left_anti")
    if not again.isEmpty():  # equal rows: one stays
        again = hint(again)
        kept = kept.join(again, [row, key], "left_anti").unionByName(kept.join(again, [row, key], "left_semi").dropDuplicates([row, key]))
    return kept.select(*names)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents; the others lose the benchmark passages that they have."""
    return decontaminate.decontaminate(docs, _base.read(spark, sf_dir, "benchmark"), min_span=1)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark of its kind."""
    return secrets.scan(docs, into=_base.fresh(docs, "secrets"), redacted=True).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences, with their token ids."""
    return packing.pack(docs, public_tokenizers.path(tokens.VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("secrets", hide_secrets),
    ("packing", pack),
]

#: SQL can express neither the toxicity score nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _base.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
