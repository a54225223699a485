"""Sources and sinks of records, with explicit schemas.

Nothing is inferred, so a file that lacks a column reads as nulls and a scan prunes what isn't asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import records

#: A row of written output.
OUTPUT = "doc_id string, group_id string, record_type string, content string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object to a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole files of one object or one array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: str, *, header: bool = True) -> DataFrame:
    """Quoted fields may hold commas, doubled quotes and line breaks; a column ``_corrupt`` in the schema takes bad lines."""
    return spark.read.schema(schema).option("header", header).option("multiLine", True).option("quote", '"').option("escape", '"').option("columnNameOfCorruptRecord", "_corrupt").csv(path)


def write_csv(rows: DataFrame, path: str, header: list[str]) -> None:
    """The columns of ``header`` in that order, quoted only where needed, nulls as nothing."""
    rows.select(*header).write.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def split_outside_quotes(text: Column, by: str) -> Column:
    """``text`` split at each ``by`` that has an even number of quotes after it, in one pass.

    Pieces between quotes are taken in turn, and those outside get a mark of two characters in place of ``by``; the text's own marks are escaped first.
    """
    pieces = F.split(F.replace(text, F.lit("\u0001"), F.lit("\u0001\u0002")), '"', -1)
    marked = F.transform(F.reverse(pieces), lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(by), F.lit("\u0001\u0003"))).otherwise(p))
    return F.transform(F.split(F.array_join(F.reverse(marked), '"'), "\u0001\u0003", -1), lambda p: F.replace(p, F.lit("\u0001\u0002"), F.lit("\u0001")))


def read_layers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, problems) of written CSV files ``slice.csv``, ``slice.fix1.csv``, ``slice.fix2.csv`` and so on.

    A byte-order mark, code fences, continuation marks, repeated headers and blank lines are passed over. Lines of other
    than four fields are problems. Rows carry slice, layer (0 for the base file, then by number, so 10 follows 9)
    and line. Each file is one row until it is cut into lines, as slices are small by contract. A file may be a folder of that name, or one named
    ``file=slice.csv``, with what Spark has written in it.
    """
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("value"), F.regexp_extract(F.input_file_name(), r"([^/=]+\.csv)(?:/[^/]+)?$", 1).alias("file"))
    text = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n")
    # a line ends where the quotes after it are even, so a quoted field may hold line breaks
    lines = split_outside_quotes(text, "\n")
    cut = whole.select("file", F.posexplode(lines).alias("line", "raw"))
    kept = cut.where(~F.rlike(F.btrim("raw"), F.lit(r"^(```.*|CONTINUE|doc_id,.*|)$")))
    fields = F.transform(split_outside_quotes(F.col("raw"), ","), lambda x: F.when(F.rlike(x, F.lit('(?s)^".*"$')), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    parsed = kept.select(
        F.regexp_extract("file", r"^(.+?)(?:\.fix\d+)?\.csv$", 1).alias("slice"), F.coalesce(F.regexp_extract("file", r"\.fix(\d+)\.csv$", 1).try_cast("int"), F.lit(0)).alias("layer"), "line", "raw", fields.alias("f")
    )
    good = parsed.where(F.size("f") == 4)
    rows = good.select("slice", "layer", "line", *[F.get("f", F.lit(i)).alias(c.split()[0]) for i, c in enumerate(OUTPUT.split(", "))])
    problems = parsed.where(F.size("f") != 4).select("slice", "layer", "line", F.regexp_extract("raw", r"^(\w+-\d+),", 1).alias("doc_id"), F.size("f").alias("fields"), F.substring("raw", 1, 60).alias("start"))
    return rows, problems


def open_problems(problems: DataFrame, rows: DataFrame) -> DataFrame:
    """Problems whose document no row of the same slice supplies."""
    return problems.join(rows.select("slice", "doc_id").distinct(), ["slice", "doc_id"], "left_anti")


def read_appointments(spark: SparkSession, path: str) -> DataFrame:
    """The appointments file: ids as longs, times without zone, flags as integers, ``no_show`` as a boolean."""
    raw = "PatientId double, AppointmentID double, Gender string, ScheduledDay string, AppointmentDay string, Age int, Neighbourhood string, Scholarship int, Hipertension int, Diabetes int, Alcoholism int, Handcap int, SMS_received int, `No-show` string"
    rows = spark.read.schema(raw).option("header", True).csv(path)
    time = lambda c: F.to_timestamp_ntz(F.regexp_replace(c, "Z$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return rows.select(
        F.col("PatientId").cast("long").alias("patient"), time("ScheduledDay").alias("scheduled"), time("AppointmentDay").alias("appointment"), F.col("Age").alias("age"), (F.col("Gender") == "F").cast("int").alias("female"),
        F.col("Scholarship").alias("scholarship"), F.col("Hipertension").alias("hypertension"), F.col("Diabetes").alias("diabetes"), F.col("Alcoholism").alias("alcoholism"), (F.col("Handcap") > 0).cast("int").alias("handicap"), F.col("SMS_received").alias("sms"), (F.col("No-show") == "Yes").alias("no_show"),
    )


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """Key-value lines of a settings file, quotes stripped; comments and blank lines are passed over."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"^\s*([A-Za-z_]\w*)\s*=", 1).alias("k"), F.btrim(F.btrim(F.regexp_extract("value", r"=(.*)$", 1)), F.lit("\"'")).alias("v"))
    return {r["k"]: r["v"] for r in rows.where("k <> ''").collect()}


def append_new(rows: DataFrame, path: str, key: str, done: DataFrame | None) -> None:
    """Append the rows whose key isn't in ``done``; running it again adds nothing."""
    (rows if done is None else records.pending(rows, done, key)).write.mode("append").parquet(path)


def write_version(old: DataFrame, new: DataFrame, key: str, path: str) -> None:
    """A new version of a keyed table, with ``new`` merged into ``old``; columns that aren't sent stay."""
    records.upsert(old, new, key).write.parquet(path)


def count_only(rows: DataFrame, condition: Column | None = None) -> int:
    return (rows if condition is None else rows.where(condition)).count()


def write_slices(rows: DataFrame, path: str, key: str) -> DataFrame:
    """Records by slice, and the slices' index."""
    rows.write.partitionBy("batch_id").json(path)
    return records.slice_index(rows, key)


def fix_requests(failed: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """(slice, request): what to write again, one text for each slice with failures.

    ``failed`` has slice, key and errors; ``manifest`` the key and its facts. Slices are small by contract.
    """
    facts = manifest.select(key, F.to_json(F.struct(*manifest.columns)).alias("fact"))
    rows = failed.join(facts, key).withColumn("line", F.concat(F.lit("- "), F.col(key), F.lit(": "), F.array_join("errors", "; ")))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(c).alias("x")))), lambda s: s["x"])
    missing_only = F.bool_and(F.size(F.array_except("errors", F.array(F.lit("missing")))) == 0)
    return rows.groupBy("slice").agg(ordered("line").alias("lines"), ordered("fact").alias("facts"), missing_only.alias("missing_only")).select(
        "slice", F.when(F.col("missing_only"), F.concat_ws("\n", F.lit("Write the missing rows below."), "facts")).otherwise(F.concat_ws("\n", F.lit("Write these rows again."), "lines", "facts")).alias("request")
    )


def report_text(title: str, rows: DataFrame) -> str:
    """A Markdown table of a small result."""
    cells = [[("" if x is None else str(x)) for x in r] for r in rows.collect()]
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}"
    return "\n".join([f"# {title}", "", head, *[f"| {' | '.join(r)} |" for r in cells], ""])


def write_reports(reports: DataFrame, path: str, key: str = "slice") -> None:
    """One JSON object for each report, in a folder named by its key; ``read_jsonl`` reads them back with the key."""
    reports.write.partitionBy(key).json(path)
