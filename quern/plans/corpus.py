"""Queries of corpus building: versions, merges, differences, numbering, fan-out and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import corpus as building
from quern.operators import records
from quern.plans._tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


@query("""SELECT coalesce(source, 'null') AS source, count(*) AS n_rows, count(*) FILTER (lang = 'en') AS n_english,
    count(*) FILTER (n_chars > 1000) AS n_long, min(n_chars) AS shortest, max(n_chars) AS longest, avg(n_chars) AS mean_chars
FROM documents GROUP BY 1""")
def corpus_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.coalesce("source", F.lit("null")).alias("source")).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("lang") == "en").alias("n_english"), F.count_if(F.col("n_chars") > 1000).alias("n_long"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.avg("n_chars").alias("mean_chars")
    )


@query("""SELECT lang, CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS source, count(*) AS n_rows FROM documents
GROUP BY ROLLUP (lang, source) HAVING grouping(lang) = 0""")
def phase_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    totals = docs.rollup("lang", "source").agg(F.grouping("lang").alias("g"), F.grouping("source").alias("h"), F.count("*").alias("n_rows"))
    return totals.where("g = 0").select("lang", F.when(F.col("h") == 1, "all").otherwise(F.col("source")).alias("source"), "n_rows")


@query("""SELECT conv_id, role, turn, len(text) AS n_chars, copies FROM (
    SELECT *, count(*) OVER (PARTITION BY conv_id, role) AS copies, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text DESC) AS n
    FROM conversations) WHERE n = 1""")
def latest_wins(spark, sf_dir):
    rows = records.latest(table(spark, sf_dir, "conversations"), ["conv_id", "role"], [F.col("turn"), F.col("text")])
    return rows.select("conv_id", "role", "turn", F.length("text").cast("long").alias("n_chars"), "copies")


@query("""SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id, role) > 1 AS repeated FROM conversations""")
def duplicate_keys(spark, sf_dir):
    return records.repeated(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "role"])


_FAILED = "(SELECT doc_id FROM documents WHERE n_chars < 200)"


def _merged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return records.merge_facts(docs, table(spark, sf_dir, "labels"), "doc_id", docs.where("n_chars < 200"))


@query(f"""SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)
WHERE d.doc_id NOT IN {_FAILED}""")
def merge_facts(spark, sf_dir):
    return _merged(spark, sf_dir)[0].select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


@query(f"""SELECT doc_id, 'failed validation' AS reason FROM documents WHERE n_chars < 200
UNION ALL SELECT doc_id, 'not in manifest' FROM documents WHERE doc_id NOT IN {_FAILED} AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def excluded_rows(spark, sf_dir):
    return _merged(spark, sf_dir)[1]


@query("""SELECT doc_id, 'missing' AS reason FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 500)""")
def missing_rows(spark, sf_dir):
    return records.missing(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").where("n_chars >= 500"), "doc_id")


@query("""SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def extra_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("""SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id LIMIT 50""")
def resume_pending(spark, sf_dir):
    """The next batch of 50 records without a vector."""
    done = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return records.pending(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), done, "doc_id", 50)


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.source, CASE WHEN l.doc_id IS NOT NULL THEN nullif(l.quality, 0) ELSE d.n_chars END AS n_chars, l.toxic
FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def upsert_preserve(spark, sf_dir):
    new = table(spark, sf_dir, "labels").select("doc_id", F.nullif("quality", F.lit(0)).cast("long").alias("n_chars"), "toxic")
    return records.upsert(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), new, "doc_id")


@query("""SELECT d.doc_id, d.lang, e.label, len(e.embedding) AS size FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id""")
def record_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    known = table(spark, sf_dir, "documents").select("doc_id", "lang").join(vectors.select("doc_id"), "doc_id", "left_semi")
    return records.with_vectors(known, vectors, "doc_id").select("doc_id", "lang", "label", F.size("embedding").cast("long").alias("size"))


@query("""SELECT o_orderkey, 'visit_note' AS kind, o_totalprice FROM orders
UNION ALL SELECT o_orderkey, 'prescription', o_totalprice FROM orders WHERE o_orderstatus = 'F'""")
def visit_rx_fanout(spark, sf_dir):
    kinds = {"visit_note": F.lit(True), "prescription": F.col("o_orderstatus") == "F"}
    return records.fan_out(table(spark, sf_dir, "orders"), kinds).select("o_orderkey", "kind", "o_totalprice")


_SLICED = """SELECT doc_id, p, 'B' || lpad(CAST(p // 500 + 1 AS VARCHAR), 2, '0') || '-M' || lpad(CAST(p // 50 % 10 + 1 AS VARCHAR), 2, '0') AS batch_id
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)"""


@query(f"SELECT doc_id, p AS position, batch_id FROM ({_SLICED})")
def slices_50(spark, sf_dir):
    return records.slices(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query(f"SELECT batch_id, min(doc_id) AS first_id, max(doc_id) AS last_id, count(*) AS n_rows FROM ({_SLICED}) GROUP BY batch_id")
def batch_index(spark, sf_dir):
    return records.slice_index(records.slices(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]), "doc_id")


@query("""SELECT coalesce(s.k, c.k) AS key, CASE WHEN c.k IS NULL THEN 'create' WHEN s.k IS NULL THEN 'extra'
    WHEN s.nation IS NOT DISTINCT FROM c.nation AND s.balance IS NOT DISTINCT FROM c.balance THEN 'unchanged' ELSE 'update' END AS action
FROM (SELECT s_suppkey AS k, s_nationkey AS nation, s_acctbal > 0 AS balance FROM supplier) s
FULL JOIN (SELECT c_custkey AS k, c_nationkey AS nation, c_acctbal > 0 AS balance FROM customer) c ON s.k = c.k""")
def doctor_diff(spark, sf_dir):
    shape = lambda t, p: table(spark, sf_dir, t).select(F.col(f"{p}key").alias("key"), F.col(f"{p[0]}_nationkey").alias("nation"), (F.col(f"{p[0]}_acctbal") > 0).alias("balance"))
    return records.difference(shape("supplier", "s_supp"), shape("customer", "c_cust"), "key")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def integrity_violations(spark, sf_dir):
    return records.violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT s_suppkey, s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09)""")
def in_use_lookup(spark, sf_dir):
    """Which suppliers are in use by either rule, with the lookups of their nation and region."""
    lines = table(spark, sf_dir, "lineitem")
    used = lines.where((F.col("l_returnflag") == "R") | (F.col("l_discount") > 0.09)).select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(used, "s_suppkey", "left_semi").join(places, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "n_name", "r_name")


@query("""SELECT c_custkey, p_name AS item, x.place, l.l_quantity FROM (
    SELECT c_custkey, unnest([c_custkey + 2, c_custkey, 100000000]) AS id, generate_subscripts([1, 2, 3], 1) - 1 AS place FROM customer WHERE c_acctbal > 9000) x
JOIN part ON p_partkey = x.id JOIN (SELECT l_partkey, sum(l_quantity) AS l_quantity FROM lineitem GROUP BY 1) l ON l.l_partkey = x.id""")
def ids_in_order(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_custkey", F.array(F.col("c_custkey") + 2, "c_custkey", F.lit(100000000).cast("long")).alias("ids"))
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("l_quantity"))
    index = table(spark, sf_dir, "part").join(sold, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("item"), "l_quantity")
    return records.in_given_order(wanted, index, "id", "ids").select("c_custkey", "item", F.col("place").cast("long").alias("place"), "l_quantity")


@query("""SELECT source, doc_id, r AS round, row_number() OVER (ORDER BY r, source) AS place FROM (
    SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
QUALIFY place <= 100""")
def round_robin_sources(spark, sf_dir):
    """A hundred documents, taken from the sources in turn."""
    taken = records.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", [F.col("doc_id")], 100)
    place = F.row_number().over(Window.orderBy("round", "source"))  # over a hundred rows
    return taken.select("source", "doc_id", F.col("round").cast("long").alias("round"), place.cast("long").alias("place"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'faq' ELSE 'visit_note' END AS record_type, lang AS faq_topic, source AS specialization, d.doc_id % 3 <> 0 OR lang <> 'Doctor fees' AS rag_visible,
    false AS is_noise, l.quality AS difficulty FROM (SELECT * REPLACE (CASE lang WHEN 'fr' THEN 'Doctor fees' ELSE lang END AS lang) FROM documents) d LEFT JOIN labels l USING (doc_id)""")
def record_projection(spark, sf_dir):
    """Documents with their labels as corpus records: defaults, and topics that stay hidden."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    facts = rows.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "faq").otherwise("visit_note").alias("record_type"), F.col("text").alias("content"), F.when(F.col("lang") == "fr", "Doctor fees").otherwise(F.col("lang")).alias("faq_topic"), F.col("source").alias("specialization"), F.col("quality").alias("difficulty"))
    return building.to_records(facts).select("doc_id", "record_type", "faq_topic", "specialization", "rag_visible", "is_noise", "difficulty")


_CORPUS_SUMMARY = """SELECT 'record_type' AS key, lang AS value, count(*) AS n FROM good GROUP BY lang UNION ALL SELECT 'generator_model', coalesce(generator, 'null'), count(*) FROM good GROUP BY generator
UNION ALL SELECT 'specialization', source, count(*) FROM good GROUP BY source UNION ALL SELECT 'rag_visible', 'true', count(*) FROM good HAVING count(*) > 0 UNION ALL SELECT 'total', 'all', count(*) FROM good HAVING count(*) > 0
UNION ALL SELECT 'excluded', reason, count(*) FROM bad GROUP BY reason"""


@query(f"""WITH good AS (SELECT lang, source, CASE WHEN n_chars > 1000 THEN 'llm' END AS generator FROM documents JOIN labels USING (doc_id)),
bad AS (SELECT 'not in manifest' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) {_CORPUS_SUMMARY}""")
def build_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("record_type"), F.col("source").alias("specialization"), F.when(F.col("n_chars") > 1000, "llm").alias("generator_model"))
    good, bad = records.merge_facts(docs, table(spark, sf_dir, "labels"), "doc_id")
    return building.summary(building.to_records(good), bad)


@query("""WITH v AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) AS turn FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY turn, o_custkey) AS place FROM v)
SELECT a.o_orderpriority AS diagnosis_id, a.o_orderkey AS a, b.o_orderkey AS b FROM p a JOIN p b ON a.o_orderpriority = b.o_orderpriority AND b.place = a.place + 1 AND a.place % 2 = 1 AND a.o_custkey <> b.o_custkey""")
def confusable_pairs(spark, sf_dir):
    visits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("patient"), F.col("o_orderpriority").alias("diagnosis_id"))
    return building.confusable_pairs(visits)


@query("""SELECT s_suppkey AS doctor, d AS day, slot FROM supplier, (SELECT unnest([0, 1]) AS d), (SELECT unnest(['09:00 AM', '03:30 PM']) AS slot)
WHERE s_suppkey % 2 = d AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_linenumber = 7 AND l_quantity > 45 AND slot = '09:00 AM')""")
def free_slots(spark, sf_dir):
    doctors = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doctor"))
    wanted = doctors.withColumn("day", (F.col("doctor") % 2).cast("int"))
    slots = doctors.withColumn("slot", F.explode(F.array(F.lit("09:00 AM"), F.lit("03:30 PM"))))
    taken = table(spark, sf_dir, "lineitem").where("l_linenumber = 7 and l_quantity > 45").select(F.col("l_suppkey").alias("doctor"), (F.col("l_suppkey") % 2).cast("int").alias("day"), F.lit("09:00 AM").alias("slot"))
    return building.free_slots(wanted, slots, taken).select("doctor", "day", "slot")
