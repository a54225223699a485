"""Noise for indexes and queries: typo copies, junk texts and off-topic texts, from seeded draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import prng

#: Sentences of topics that no query asks about.
OFF_TOPIC = {
    "astronomy": ["A telescope with a wider mirror gathers more light from faint galaxies.", "The comet returns every seventy years or so.", "Saturn shows its rings best when they tilt towards us."],
    "carpentry": ["Sand along the grain before the first coat of varnish.", "A dovetail joint holds a drawer without any nails.", "Let the glue cure overnight under clamps."],
    "chess": ["White gave up a pawn to open the long diagonal.", "Rooks belong behind passed pawns in most endings.", "The match was drawn after forty quiet moves."],
    "railways": ["The night express stops at the junction for twelve minutes.", "A new signal box controls both branch lines.", "Freight wagons are sorted on a gentle slope north of town."],
    "bees": ["A healthy hive stores its honey above the brood.", "Clover fields near the orchard bloom late in June.", "The keeper calms the swarm with a little smoke."],
    "pottery": ["Throw the clay hard on the centre of the wheel.", "This glaze turns blue only in a reducing kiln.", "Dry the bowls slowly under a damp cloth."],
    "sailing": ["Reef the mainsail before the squall arrives.", "The harbour pilot came aboard at the outer buoy.", "An old chart shows a sandbank that moved years ago."],
    "museums": ["The east wing reopens with a show of woodcuts.", "Guides in three languages lead tours on Sundays.", "The curator found the sketch inside a ledger."],
    "opera": ["The second act ends with a quartet in the garden.", "Her understudy sang the premiere without a rehearsal.", "The orchestra pit was rebuilt after the flood."],
    "printing": ["Set the type a little looser for narrow columns.", "The old press needs one sheet at a time.", "Ink dries faster on uncoated paper."],
}
_KINDS = ["faq", "visit_note", "prescription"]


def noisy_text(text: Column, seed: Column, rate: float, junk: int) -> Column:
    """Typos first, then junk tokens; queries take 0.35 and 2, documents 0.5 and 4."""
    return prng.add_junk(prng.add_typos(text, seed, rate), seed, junk)


def noisy_queries(queries: DataFrame, seed: int) -> DataFrame:
    """A noisy copy of each query (id, query), with the id it comes from."""
    own = F.xxhash64(F.lit(seed), "id")
    return queries.withColumn("from", F.col("id")).withColumn("id", F.concat(F.lit("N"), F.substring("id", F.lit(2), F.length("id")))).withColumn("query", noisy_text(F.col("query"), own, 0.35, 2))


def _array(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def _numbered(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumn("record_type", F.get(_array(_KINDS), (F.col("id") % 3).cast("int")))


def junk_rows(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """Texts of 20 to 49 clinic words, junk tokens and random strings; text i draws from a seed of its own."""
    own = F.xxhash64(F.lit(seed), "id")
    word = lambda k: F.when(prng.draw(own, 2 * k) < 0.35, prng.pick(own, 2 * k + 1, _array(prng.JUNK_WORDS))).when(prng.draw(own, 2 * k) < 0.7, prng.pick(own, 2 * k + 1, _array(prng.JUNK_TOKENS))).otherwise(F.lower(F.conv(prng.integer(own, 2 * k + 1, 0, 99999).cast("string"), 10, 36)))
    size = prng.integer(own, F.lit(1), 20, 49)
    return _numbered(spark, n).select("record_type", F.array_join(F.transform(F.sequence(F.lit(1), size), word), " ").alias("content"), F.lit("junk").alias("noise_type"), F.lit(None).cast("string").alias("source_doc_id"))


def off_topic_rows(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """Two or three sentences of the topics in turn, ordered by a keyed draw."""
    own = F.xxhash64(F.lit(seed), "id")
    topics = F.array(*[_array(s) for s in OFF_TOPIC.values()])
    said = F.get(topics, (F.col("id") % len(OFF_TOPIC)).cast("int"))
    mixed = F.transform(F.array_sort(F.transform(said, lambda s, i: F.struct(prng.draw(own, i + 1).alias("d"), s.alias("s")))), lambda x: x["s"])
    return _numbered(spark, n).select("record_type", F.array_join(F.slice(mixed, F.lit(1), (2 + F.col("id") % 2).cast("int")), " ").alias("content"), F.lit("off_topic").alias("noise_type"), F.lit(None).cast("string").alias("source_doc_id"))


def typo_rows(sources: DataFrame, seed: int) -> DataFrame:
    """Typo copies of ``sources`` (doc_id, record_type, content)."""
    own = F.xxhash64(F.lit(seed), "doc_id")
    return sources.select("record_type", noisy_text(F.col("content"), own, 0.5, 4).alias("content"), F.lit("typo_duplicate").alias("noise_type"), F.col("doc_id").alias("source_doc_id"))


def noise_rows(sources: DataFrame, seed: int, n: int = 100) -> DataFrame:
    """All three kinds, ``n`` of each generated one, numbered in their order."""
    spark = sources.sparkSession
    every = typo_rows(sources, seed).unionByName(junk_rows(spark, seed, n)).unionByName(off_topic_rows(spark, seed, n))
    return every.withColumn("rag_visible", F.lit(True)).withColumn("is_noise", F.lit(True)).withColumn("doc_id", F.concat(F.lit("NOISE-"), F.substring(F.sha2(F.concat_ws("|", "noise_type", "content", "source_doc_id"), 256), 1, 12)))
