from pyspark.sql import functions as F

from quern.sources import files
from quern.streaming import layers


def test_layers_of_written_files(spark, tmp_path):
    (tmp_path / "B01-M01.csv").write_text('﻿doc_id,group_id,record_type,content\nVN-1,G-1,visit_note,"one, with ""quotes""\nand a line"\nVN-2,G-2,visit_note,two,extra\n\nFAQ-1,,faq,three\n', encoding="utf-8")
    (tmp_path / "B01-M01.fix2.csv").write_text("```\ndoc_id,group_id,record_type,content\r\nVN-1,G-1,visit_note,second\r\nCONTINUE\n```\n")
    (tmp_path / "B01-M01.fix10.csv").write_text("doc_id,group_id,record_type,content\nVN-1,G-1,visit_note,tenth\nVN-3,short\n")
    rows, problems = files.read_layers(spark, str(tmp_path))
    got = sorted((r["doc_id"], r["layer"], r["group_id"], r["content"]) for r in rows.collect())
    assert got == [("FAQ-1", 0, "", "three"), ("VN-1", 0, "G-1", 'one, with "quotes"\nand a line'), ("VN-1", 2, "G-1", "second"), ("VN-1", 10, "G-1", "tenth")]
    assert sorted((r["doc_id"], r["fields"]) for r in problems.collect()) == [("VN-2", 5), ("VN-3", 2)]
    assert {r["doc_id"] for r in files.open_problems(problems, rows.unionByName(rows.withColumn("doc_id", F.lit("VN-2")))).collect()} == {"VN-3"}


def test_csv_round_trip(spark, tmp_path):
    data = [("a,b", 'say "x"', None), ("two\nlines", "plain", "z")]
    files.write_csv(spark.createDataFrame(data, "p string, q string, r string"), str(tmp_path / "c"), ["r", "p", "q"])
    got = files.read_csv(spark, str(tmp_path / "c"), "r string, p string, q string")
    assert sorted((r["p"], r["q"], r["r"]) for r in got.collect()) == sorted(data)


def test_json_lines_skip_blanks(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2, "b": "t"}\n')
    assert sorted((r["a"], r["b"]) for r in files.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, b string").collect()) == [(1, None), (2, "t")]


def test_settings_and_requests(spark, tmp_path):
    (tmp_path / "env").write_text("# c\nA=\"x y\"\n\nB='z'\n")
    assert files.read_settings(spark, str(tmp_path / "env")) == {"A": "x y", "B": "z"}
    failed = spark.createDataFrame([("s", "1", ["missing"]), ("t", "2", ["length", "id"])], "slice string, doc_id string, errors array<string>")
    manifest = spark.createDataFrame([("1", "f"), ("2", "g")], "doc_id string, fact string")
    got = {r["slice"]: r["request"] for r in files.fix_requests(failed, manifest, "doc_id").collect()}
    assert got["s"].startswith("Write the missing") and "- 2: length; id" in got["t"]


def test_reports_of_slices(spark, tmp_path):
    schema = "slice string, rows_found int, results array<struct<doc_id string, errors array<string>>>"
    data = [("B01-M01", 2, [("VN-1", ["length"]), ("VN-2", [])]), ("B01-M02", 0, [])]
    files.write_reports(spark.createDataFrame(data, schema), str(tmp_path / "r"))
    assert (tmp_path / "r/slice=B01-M02").is_dir()
    back = files.read_jsonl(spark, str(tmp_path / "r"), "rows_found int, results array<struct<doc_id string, errors array<string>>>, slice string")
    got = {r["slice"]: (r["rows_found"], [(x["doc_id"], x["errors"]) for x in r["results"]]) for r in back.collect()}
    assert got == {s: (n, list(x)) for s, n, x in data}


def test_append_twice_adds_nothing(spark, tmp_path):
    rows, path = spark.range(5).withColumnRenamed("id", "k"), str(tmp_path / "t")
    files.append_new(rows, path, "k", None)
    files.append_new(rows, path, "k", spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 5


def test_slices_on_disk(spark, tmp_path):
    from quern.operators import records

    index = files.write_slices(records.slices(spark.range(120), ["id"]), str(tmp_path / "s"), "id")
    assert sorted((r["batch_id"], r["first_id"], r["last_id"], r["n_rows"]) for r in index.collect()) == [("B01-M01", 0, 49, 50), ("B01-M02", 50, 99, 50), ("B01-M03", 100, 119, 20)]


def test_stream_keeps_the_latest(spark, tmp_path):
    schema, out = "k string, layer int, x int", str(tmp_path / "out")
    for rows in [[("a", 0, 1), ("b", 0, 2)], [("a", 2, 3)], [("a", 1, 4), ("c", 0, 5)]]:
        frame = spark.createDataFrame(rows, schema)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        layers.latest_wins(layers.read(spark, str(tmp_path / "in"), schema), out, str(tmp_path / "c"), ["k"], ["layer"]).awaitTermination()
    last = layers.current(spark, out, frame.schema).drop("bucket")
    assert sorted(map(tuple, last.collect())) == [("a", 2, 3), ("b", 0, 2), ("c", 0, 5)]


def test_stream_rewrites_touched_buckets_and_repeats_a_batch(spark, tmp_path):
    import shutil

    schema, folder = "k long, layer int, x long", str(tmp_path / "out")
    size = lambda n: sum(f.stat().st_size for f in (tmp_path / f"out/batch={n}").rglob("*.parquet"))

    def run(checkpoint="c"):
        layers.latest_wins(layers.read(spark, str(tmp_path / "in"), schema, files_per_batch=1), folder, str(tmp_path / checkpoint), ["k"], ["layer"], buckets=32).awaitTermination()

    spark.range(20000).selectExpr("id AS k", "0 AS layer", "id * 7 AS x").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    frame = spark.createDataFrame([(5, 1, -1), (20001, 0, -2)], schema)
    frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    table = lambda: {r["k"]: r["x"] for r in layers.current(spark, folder, frame.schema).collect()}
    want = {k: 7 * k for k in range(20000)} | {5: -1, 20001: -2}
    assert table() == want and size(1) < size(0) / 8
    commits = sorted((tmp_path / "c/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    commits[-1].unlink()  # the batch has written, but the run ended before it was recorded
    shutil.rmtree(next((tmp_path / "out/batch=1").glob("bucket=*")))
    run()
    assert table() == want


def test_stream_appends_once(spark, tmp_path):
    for _ in range(2):
        spark.range(4).withColumnRenamed("id", "k").write.mode("append").parquet(str(tmp_path / "in"))
        layers.append_pending(layers.read(spark, str(tmp_path / "in"), "k long"), str(tmp_path / "out"), str(tmp_path / "c"), "k", lambda d: d.withColumn("v", F.col("k") * 2)).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3]


def test_splitting_outside_quotes_takes_one_pass(spark):
    import time

    from pyspark.sql import functions as F

    from quern.sources import files

    texts = ['a,"b,""c"",",d', 'x\u0001,"\u0001\u0003,"', ',,', '', 'odd,"quote,s', '"a"","b,c"']
    pattern = r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", files.split_outside_quotes(F.col("t"), ",").alias("x"), F.split("t", pattern, -1).alias("y")).collect()
    assert len(got) == len(texts) and all(r["x"] == r["y"] for r in got)
    began = time.time()
    long = spark.range(1).select(F.repeat(F.lit('"a, b ""c""",\n'), 100_000).alias("t"))
    assert long.select(F.size(files.split_outside_quotes(F.col("t"), ","))).first()[0] == 100_001
    assert time.time() - began < 60
