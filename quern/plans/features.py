"""Queries of event features, splits, bins, order statistics and dates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import numeric
from quern.operators import history, metrics, records
from quern.plans._tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add




def _day():
    return F.to_date("ts")


def _bad():
    return F.col("event_type") == "error"


_DAYS = "SELECT user_id, ts::DATE AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1, 2"
_BEFORE = f"""SELECT *, coalesce(sum(n) OVER w, 0)::BIGINT AS n_before, coalesce(sum(bad) OVER w, 0)::BIGINT AS bad_before FROM ({_DAYS})
WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query(f"SELECT user_id, day, n, bad, n_before, bad_before, CASE WHEN n_before > 0 THEN bad_before / n_before ELSE 0 END::DOUBLE AS rate_before FROM ({_BEFORE})")
def exclusive_history(spark, sf_dir):
    return history.before(history.by_day(table(spark, sf_dir, "events"), "user_id", _day(), _bad()), "user_id")


@query(f"SELECT e.event_id, b.n_before, b.bad_before, CASE WHEN n_before > 0 THEN bad_before / n_before ELSE 0 END::DOUBLE AS rate_before FROM events e JOIN ({_BEFORE}) b ON e.user_id = b.user_id AND e.ts::DATE = b.day")
def history_features(spark, sf_dir):
    return history.features(table(spark, sf_dir, "events"), "user_id", _day(), _bad()).select("event_id", "n_before", "bad_before", "rate_before")


@query(f"""WITH d AS ({_DAYS}) SELECT e.event_id, coalesce(sum(d.n), 0)::BIGINT AS n_before, coalesce(sum(d.bad), 0)::BIGINT AS bad_before
FROM (SELECT event_id, user_id, ts::DATE - (event_id % 9)::INT AS booked FROM events) e LEFT JOIN d ON d.user_id = e.user_id AND d.day < e.booked GROUP BY 1""")
def booking_history(spark, sf_dir):
    """The same as of the day of booking, which here is up to eight days earlier."""
    rows = table(spark, sf_dir, "events")
    booked = F.date_sub(F.to_date("ts"), (F.col("event_id") % 9).cast("int"))
    return history.before_booking(rows, "user_id", _day(), booked, _bad()).select("event_id", "n_before", "bad_before")


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS rate,
    coalesce(sum(value) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'none'), 0), 0)::DOUBLE AS empty_ratio FROM events GROUP BY 1""")
def safe_ratio(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(_bad()).alias("bad"), F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("spent"), F.count_if(F.col("event_type") == "none").alias("none"))
    return e.select("user_id", "n", numeric.safe_ratio(F.col("bad"), F.col("n")).alias("rate"), numeric.safe_ratio(F.col("spent"), F.col("none")).alias("empty_ratio"))


_SHARES = "SELECT day, n, (sum(n) OVER (ORDER BY day) / sum(n) OVER ())::DOUBLE AS share FROM (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)"
_SPLIT = f"""SELECT *, CASE WHEN day < (SELECT min(day) FROM s WHERE share >= 0.6) THEN 'train' WHEN day < (SELECT min(day) FROM s WHERE share >= 0.8) THEN 'validation' ELSE 'test' END AS part FROM s"""


@query(f"WITH s AS ({_SHARES}) {_SPLIT}")
def time_split(spark, sf_dir):
    return history.time_split(history.day_shares(table(spark, sf_dir, "events"), _day()))


@query(f"WITH s AS ({_SHARES}) SELECT part, min(day) AS first_day, max(day) AS last_day, sum(n)::BIGINT AS n_rows, count(*) AS n_days FROM ({_SPLIT}) GROUP BY part")
def split_profile(spark, sf_dir):
    split = history.time_split(history.day_shares(table(spark, sf_dir, "events"), _day()))
    return split.groupBy("part").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("n_rows"), F.count("*").alias("n_days"))


@query("""SELECT bin, count(*) AS n, avg(l_quantity) AS mean_quantity, avg((l_returnflag = 'R')::INT) AS returned_share FROM (
    SELECT *, CASE WHEN d <= -1 THEN NULL WHEN d <= 0 THEN '0' WHEN d <= 2 THEN '1-2' WHEN d <= 7 THEN '3-7' WHEN d <= 30 THEN '8-30' WHEN d <= 200 THEN '31-200' END AS bin
    FROM (SELECT *, date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) WHERE bin IS NOT NULL GROUP BY bin""")
def lead_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    binned = rows.withColumn("bin", numeric.lead_bin(numeric.lead_days(F.col("o_orderdate"), F.col("l_shipdate")))).where("bin is not null")
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean_quantity"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("returned_share"))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (l_quantity > 48) AS first, count(*) FILTER (l_discount > 0.08 AND NOT l_quantity > 48) AS second FROM lineitem""")
def cleaning_counts(spark, sf_dir):
    """How many rows each of two cleaning rules drops, the second of what the first leaves."""
    return history.clean(table(spark, sf_dir, "lineitem"), F.col("l_quantity") > 48, F.col("l_discount") > 0.08)[1]


@query("""SELECT lang, n, x[least(floor(n * 0.5), n - 1)::INT + 1] AS median, x[least(floor(n * 0.95), n - 1)::INT + 1] AS p95, x[1] AS least, x[n] AS most
FROM (SELECT lang, count(*) AS n, list_sort(list(n_chars)) AS x FROM documents GROUP BY lang)""")
def order_stats_index(spark, sf_dir):
    """Elements by index of the sorted lengths of each language.

    Counts by distinct length come first, so that a language's rows are never gathered; running sums then give the places.
    """
    counts = table(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("lang").orderBy("n_chars"))
    total = F.sum("c").over(Window.partitionBy("lang"))
    placed = counts.withColumn("upto", upto).withColumn("n", total)
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col("n_chars")))
    return placed.groupBy("lang").agg(F.max("n").alias("n"), at(0.5).alias("median"), at(0.95).alias("p95"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("""SELECT visits, count(*) AS n_customers FROM (SELECT c_custkey, count(o_orderkey) AS visits FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) GROUP BY visits""")
def visits_histogram(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("visits"))
    each = table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left")
    return each.groupBy(F.coalesce("visits", F.lit(0)).alias("visits")).agg(F.count("*").alias("n_customers"))


@query("SELECT lang, doc_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 10")
def first_n_per_class(spark, sf_dir):
    return records.first_per_group(table(spark, sf_dir, "documents"), ["lang"], [F.col("doc_id")], 10).select("lang", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT source, doc_id, n_chars, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def topk_per_group(spark, sf_dir):
    best = records.first_per_group(table(spark, sf_dir, "documents"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3)
    return best.select("source", "doc_id", "n_chars", F.col("rank").cast("long").alias("rank"))


@query("""SELECT o_orderkey, date_part('year', DATE '2010-03-01') - date_part('year', o_orderdate) - (strftime(DATE '2010-03-01', '%m%d') < strftime(o_orderdate, '%m%d'))::INT AS age, dayname(o_orderdate)[1:3] AS weekday FROM orders""")
def age_on_date(spark, sf_dir):
    age = numeric.age_on(F.col("o_orderdate"), F.to_date(F.lit("2010-03-01")))
    return table(spark, sf_dir, "orders").select("o_orderkey", age.cast("long").alias("age"), F.date_format("o_orderdate", "EEE").alias("weekday"))


@query("""SELECT event_id, strftime(ts, '%I:%M %p') AS slot, date_part('hour', ts) * 60 + date_part('minute', ts) AS minutes FROM events""")
def slot_minutes(spark, sf_dir):
    slot = F.date_format("ts", "hh:mm a")
    return table(spark, sf_dir, "events").select("event_id", slot.alias("slot"), numeric.slot_minutes(slot).cast("long").alias("minutes"))


@query("""SELECT o_custkey, o_orderpriority, count(*) AS n, count(*) > 1 AS repeat_diagnosis FROM orders GROUP BY 1, 2""")
def repeat_tags(spark, sf_dir):
    rows = records.repeated(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), ["o_custkey", "o_orderpriority"])
    return rows.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"), F.bool_or("repeated").alias("repeat_diagnosis"))


@query("""WITH o AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT min(day) AS first, max(day) AS last FROM o)
SELECT d.day, dayname(d.day)[1:3] AS weekday, coalesce(n, 0) AS n_orders FROM (SELECT unnest(range(first::TIMESTAMP, last::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS day FROM b) d LEFT JOIN o USING (day)""")
def calendar_spine(spark, sf_dir):
    """Every day from the first order to the last, with its orders, none too."""
    orders = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    days = numeric.calendar(orders.agg(F.min("day").alias("first"), F.max("day").alias("last")))
    return days.join(orders, "day", "left").select("day", "weekday", F.coalesce("n", F.lit(0)).alias("n_orders"))


# ----- classification metrics: the score of an event is its value, and an error is a positive


def _scores(spark, sf_dir):
    return metrics.by_score(table(spark, sf_dir, "events"), F.col("value"), _bad())


_CURVE = """WITH c AS (SELECT value AS score, count(*) AS n, count(*) FILTER (event_type = 'error') AS p FROM events GROUP BY 1),
r AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS above, sum(p) OVER (ORDER BY score DESC) AS pa, sum(p) OVER () AS allp, sum(n) OVER () AS alln FROM c)"""


@query(f"{_CURVE} SELECT floor(sum(p * pa / above::DOUBLE) / sum(p) * 1e9 + 0.5) / 1e9 AS average_precision FROM r")
def average_precision(spark, sf_dir):
    return metrics.average_precision(_scores(spark, sf_dir)).select(numeric.round_to(F.col("average_precision"), 9).alias("average_precision"))


@query(f"{_CURVE} SELECT floor(sum(p * ((alln - allp) - (above - pa) + (n - p) / 2.0::DOUBLE)) / (any_value(allp)::DOUBLE * any_value(alln - allp)) * 1e9 + 0.5) / 1e9 AS roc_auc FROM r")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(_scores(spark, sf_dir)).select(numeric.round_to(F.col("roc_auc"), 9).alias("roc_auc"))


@query(f"""{_CURVE} SELECT score AS threshold, (pa / above)::DOUBLE AS precision, (pa / allp)::DOUBLE AS recall, (2 * pa / (above + allp))::DOUBLE AS f1 FROM r ORDER BY f1 DESC, score LIMIT 1""")
def best_f1_threshold(spark, sf_dir):
    return metrics.best_f1(_scores(spark, sf_dir))


@query("SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return metrics.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


_PRF = """(tn + tp) / (tn + fp + fn + tp)::DOUBLE AS accuracy, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall,
coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) AS f1, (tp + fp) / (tn + fp + fn + tp)::DOUBLE AS flagged_share"""


@query(f"""SELECT cut, tn, fp, fn, tp, {_PRF} FROM (SELECT cut, count(*) FILTER (NOT t AND NOT f) AS tn, count(*) FILTER (NOT t AND f) AS fp, count(*) FILTER (t AND NOT f) AS fn, count(*) FILTER (t AND f) AS tp
FROM (SELECT cut, event_type = 'error' AS t, value >= cut AS f FROM events, (SELECT unnest([10.0, 50.0, 1e9])::DOUBLE AS cut)) GROUP BY cut)""")
def binary_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("cut", F.explode(F.array(*[F.lit(c) for c in (10.0, 50.0, 1e9)])))
    return metrics.binary_metrics(metrics.binary_counts(rows, _bad(), F.col("value") >= F.col("cut"), ["cut"]))


@query("""WITH x AS (SELECT event_type AS t, CASE event_id % 7 WHEN 0 THEN 'view' WHEN 1 THEN 'click' ELSE event_type END AS p FROM events),
c AS (SELECT t AS class FROM x UNION SELECT p FROM x),
s AS (SELECT class, count(*) FILTER (t = class) AS support, count(*) FILTER (p = class) AS named, count(*) FILTER (t = class AND p = class) AS hit FROM c, x GROUP BY class)
SELECT class, support, coalesce(hit / nullif(named, 0)::DOUBLE, 0) AS precision, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2 * hit / nullif(named + support, 0)::DOUBLE, 0) AS f1 FROM s""")
def per_class_metrics(spark, sf_dir):
    guess = F.when(F.col("event_id") % 7 == 0, "view").when(F.col("event_id") % 7 == 1, "click").otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_type", guess.alias("guess"))
    return metrics.per_class(metrics.confusion(rows, "event_type", "guess"))


@query("SELECT event_type AS label, n / (SELECT count(*) FROM events)::DOUBLE AS accuracy FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, event_type LIMIT 1")
def majority_baseline(spark, sf_dir):
    return metrics.majority_baseline(table(spark, sf_dir, "events"), "event_type")


@query("""SELECT coalesce(d.lang, 'unknown') AS category, count(*) AS n, count(l.quality) AS n_scored, avg(l.quality) AS mean_quality, avg(l.toxic) AS mean_toxic,
    count(*) FILTER (l.quality = 1 AND l.toxic = 0) AS fully_correct FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def judge_means(spark, sf_dir):
    """Means of judged rows by category, always beside how many were judged."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.groupBy(F.coalesce("lang", F.lit("unknown")).alias("category")).agg(
        F.count("*").alias("n"), F.count("quality").alias("n_scored"), F.avg("quality").alias("mean_quality"), F.avg("toxic").alias("mean_toxic"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("fully_correct")
    )


@query("""SELECT count(*) FILTER (quality = 0) AS expected, count(*) FILTER (quality = 0 AND toxic = 1) / nullif(count(*) FILTER (quality = 0), 0)::DOUBLE AS correct_refusals,
    count(*) FILTER (quality = 1 AND toxic = 1) / nullif(count(*) FILTER (quality = 1), 0)::DOUBLE AS wrong_refusals FROM labels""")
def refusal_rates(spark, sf_dir):
    bad, flag = F.col("quality") == 0, F.col("toxic") == 1
    share = lambda a, b: F.try_divide(F.count_if(a).cast("double"), F.count_if(b))
    return table(spark, sf_dir, "labels").agg(F.count_if(bad).alias("expected"), share(bad & flag, bad).alias("correct_refusals"), share(~bad & flag, ~bad).alias("wrong_refusals"))


@query("""SELECT metric, floor, score FROM (SELECT unnest(['quality', 'toxic', 'missing']) AS metric, unnest([0.9, 0.1, 0.5])::DOUBLE AS floor) f
LEFT JOIN (SELECT 'quality' AS metric, avg(quality) AS score FROM labels UNION ALL SELECT 'toxic', avg(toxic) FROM labels) USING (metric) WHERE score IS NULL OR score < floor""")
def gate(spark, sf_dir):
    floors = spark.createDataFrame([("quality", 0.9), ("toxic", 0.1), ("missing", 0.5)], "metric string, floor double")
    means = table(spark, sf_dir, "labels").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    scores = means.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in ("quality", "toxic")])).alias("x")).select("x.*")
    return metrics.gate(scores, floors, "metric").select("metric", "floor", "score")
