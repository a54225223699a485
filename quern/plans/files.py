"""Queries that write files below the shared folder and read them back: each must equal its SQL on the table that was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import records
from quern.operators.shared import fresh_folder
from quern.plans._tables import table
from quern.sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _digest():
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")


@query("SELECT doc_id, lang, source, sha256(text) AS text_sha256 FROM documents WHERE text <> ''")
def csv_round_trip(spark, sf_dir):
    """Texts with commas, quotes and line breaks, written as CSV and read by an explicit schema."""
    path = fresh_folder(spark, "csv")
    files.write_csv(table(spark, sf_dir, "documents").where("text <> ''"), path, ["doc_id", "lang", "source", "text"])
    return files.read_csv(spark, path, "doc_id long, lang string, source string, text string").select("doc_id", "lang", "source", _digest())


@query("SELECT doc_id, lang, NULL::VARCHAR AS absent, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def jsonl_round_trip(spark, sf_dir):
    """One object to a line; a field that no object has reads as null."""
    path = fresh_folder(spark, "jsonl")
    table(spark, sf_dir, "documents").select("doc_id", "text", "lang").write.json(path)
    return files.read_jsonl(spark, path, "doc_id long, text string, lang string, absent string").select("doc_id", "lang", "absent", _digest())


_SLICE = "concat('B', lpad(CAST(1 + conv_id DIV 100 AS STRING), 4, '0'))"
#: Lines of layered output over conversations: layers 0, 2 and 10, with fences, marks, repeated headers and lines of too many or too few fields.
_LAYERED_SQL = """WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, 'VN-' || (1000 * conv_id + turn) AS doc_id, 'B' || lpad((1 + conv_id // 100)::VARCHAR, 4, '0') AS slice FROM conversations),
l AS (SELECT *, 0 AS layer, text AS content FROM t WHERE NOT (conv_id % 13 = 5 AND turn = 1) UNION ALL SELECT *, 2, 'second: ' || text FROM t WHERE conv_id % 7 = 0 UNION ALL SELECT *, 10, 'tenth' FROM t WHERE conv_id % 21 = 0)"""


@query(f"{_LAYERED_SQL} SELECT doc_id, slice, layer::BIGINT AS layer, role AS group_id, sha256(content) AS content_sha256, count(*) OVER (PARTITION BY doc_id) AS copies FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY layer DESC) = 1")
def layered_output(spark, sf_dir):
    """Output in layers, of which the last one of each row counts: the tenth after the second, in files with what models add around rows."""
    return records.latest(_layered(spark, sf_dir)[0], ["doc_id"], [F.col("layer")]).select("doc_id", "slice", F.col("layer").cast("long").alias("layer"), "group_id", F.sha2("content", 256).alias("content_sha256"), "copies")


@query("""SELECT 'VN-' || (1000 * conv_id + turn) AS doc_id, 'B' || lpad((1 + conv_id // 100)::VARCHAR, 4, '0') AS slice, 5::BIGINT AS fields FROM conversations WHERE conv_id % 13 = 5 AND turn = 1 AND conv_id % 7 <> 0""")
def layered_problems(spark, sf_dir):
    """Malformed lines whose row no layer supplies."""
    rows, problems = _layered(spark, sf_dir)
    return files.open_problems(problems, rows).select("doc_id", "slice", F.col("fields").cast("long").alias("fields"))


def _layered(spark, sf_dir):
    path = fresh_folder(spark, "layers")
    t = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("VN-"), (1000 * F.col("conv_id") + F.col("turn")).cast("string")).alias("doc_id"), F.expr(_SLICE).alias("slice")
    )
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = lambda content: F.concat_ws(",", "doc_id", "role", F.lit("visit_note"), quoted(content))
    bad = (F.col("conv_id") % 13 == 5) & (F.col("turn") == 1)
    head = F.lit("doc_id,group_id,record_type,content")
    base = t.select("slice", F.lit(".csv").alias("end"), F.when(bad, F.concat(F.col("doc_id"), F.lit(",g,visit_note,a,b"))).otherwise(line(F.col("text"))).alias("line"), "conv_id", "turn")
    second = t.where("conv_id % 7 = 0").select("slice", F.lit(".fix2.csv"), F.concat(F.lit("```\n"), head, F.lit("\n"), line(F.concat(F.lit("second: "), F.col("text"))), F.lit("\nCONTINUE\n```")), "conv_id", "turn")
    tenth = t.where("conv_id % 21 = 0").select("slice", F.lit(".fix10.csv"), F.concat(head, F.lit("\r\n"), line(F.lit("tenth"))), "conv_id", "turn")
    every = base.union(second).union(tenth).select(F.concat("slice", "end").alias("file"), "line", "conv_id", "turn")
    every.repartition("file").sortWithinPartitions("file", "conv_id", "turn").select("line", "file").write.partitionBy("file").text(path)
    return files.read_layers(spark, path)


@query("SELECT doc_id, 1::BIGINT AS copies, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def resumed_append(spark, sf_dir):
    """A run that stops after a part of the rows and is started again, twice: every row is there once."""
    path = fresh_folder(spark, "append")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files.append_new(docs.where("doc_id % 3 = 0"), path, "doc_id", None)
    for _ in range(2):
        files.append_new(docs, path, "doc_id", spark.read.parquet(path))
    return spark.read.parquet(path).groupBy("doc_id").agg(F.count("*").alias("copies"), F.first(_digest()).alias("text_sha256"))


@query("""SELECT 'B' || lpad((1 + p // 500)::VARCHAR, 2, '0') || '-M' || lpad((1 + p // 50 % 10)::VARCHAR, 2, '0') AS batch_id, count(*) AS n, min(item_id) AS first_id, max(item_id) AS last_id, sha256(string_agg(text, chr(10) ORDER BY item_id)) AS texts_sha256
FROM (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS p FROM benchmark) GROUP BY 1""")
def slice_files(spark, sf_dir):
    """Slices of fifty rows, each in files of its own, read back with the slice from its folder's name."""
    path = fresh_folder(spark, "slices")
    files.write_slices(records.slices(table(spark, sf_dir, "benchmark").select("item_id", "text"), ["item_id"]), path, "item_id")
    rows = spark.read.schema("item_id long, text string, batch_id string").json(path)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "text"))), lambda x: x["text"]), "\n")  # a slice has fifty rows
    return rows.groupBy("batch_id").agg(F.count("*").alias("n"), F.min("item_id").alias("first_id"), F.max("item_id").alias("last_id"), F.sha2(texts, 256).alias("texts_sha256"))
