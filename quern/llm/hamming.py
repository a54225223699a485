"""Exact top-k search over binary codes by incremental multi-index hashing.

A block of codes is indexed once for each segment; a segment has about as many bits as the logarithm of the block's
codes, so that a lookup meets about one code whatever the block's size. A query searches its segments in turn with
growing radius: once radius r is done in the first j + 1 of m segments (and r - 1 in the rest), every code within
m * r + j has been seen, since a code further away in each segment is further away in all. The search
ends when the kth distance verified so far, or known from another block, lies within that.

Blocks of codes meet blocks of queries in two rounds: in the first each block of queries meets one block of codes,
whose kth distances bound the searches of the second. A block's k best go on to the k best of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import _base

CODES = 16384
QUERIES = 256
#: Tasks that share the codes of one block of queries.
SPREAD = 32
#: Up to so many pairs of blocks have a task each; of more, a task has up to 64.
TASKS = 1024


def binarize(vectors: DataFrame, column: str, into: str = "code") -> DataFrame:
    """``vectors`` with the signs of ``column`` (1 where positive) as bytes, padded with zeros; null stays null."""
    schema = _base.with_fields(vectors.drop(into), **{into: T.BinaryType()})

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = []
        for v in batch.column(batch.schema.get_field_index(column)).to_pylist():
            if v is None:
                codes.append(None)
            else:
                bits = np.array([x is not None and x > 0 for x in v], np.uint8)
                codes.append(np.packbits(bits).tobytes())
        return batch.append_column(into, pa.array(codes, pa.binary()))

    return _base.map_rows(vectors.drop(into), lambda: step, schema)


_MASKS: dict[tuple[int, int], np.ndarray] = {}


def masks(bits: int, radius: int) -> np.ndarray:
    """All words of ``bits`` bits with ``radius`` of them set."""
    if (bits, radius) not in _MASKS:
        _MASKS[bits, radius] = np.array([sum(1 << b for b in set_) for set_ in combinations(range(bits), radius)], np.int64)
    return _MASKS[bits, radius]


class Index:
    """A multi-index over codes (n rows of bytes) with their ids."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.codes = ids[order], codes[order]
        bits = 8 * codes.shape[1]
        self.segments = -(-bits // min(16, max(4, round(np.log2(max(2, len(ids)))))))
        self.cuts = [bits * j // self.segments for j in range(self.segments + 1)]
        self.widths = [b - a for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        keys = self.keys(self.codes)
        self.orders = [np.argsort(k, kind="stable") for k in keys]
        self.starts = [np.searchsorted(k[o], np.arange((1 << w) + 1)) for k, o, w in zip(keys, self.orders, self.widths, strict=True)]

    def keys(self, codes: np.ndarray) -> list[np.ndarray]:
        """Of each segment the codes' words."""
        table = np.unpackbits(codes, axis=1)
        return [table[:, a:b] @ (1 << np.arange(b - a - 1, -1, -1, dtype=np.int64)) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def search(self, query: np.ndarray, k: int, bound: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of the ``k`` nearest (of those within ``bound``, if there is one), by distance, then id."""
        seen = np.zeros(len(self.ids), bool)
        found, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        by_distance = np.zeros(8 * self.codes.shape[1] + 1, np.int64)
        words = [int(x[0]) for x in self.keys(query[None])]
        covered = -1
        for radius in range(max(self.widths) + 1):
            for order, starts, width, word in zip(self.orders, self.starts, self.widths, words, strict=True):
                covered += 1
                if radius <= width:
                    keys = masks(width, radius) ^ word
                    lo = starts[keys]
                    size = starts[keys + 1] - lo
                    total = int(size.sum())
                    at = order[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(total)]
                    at = at[~seen[at]]  # one segment has a code once
                    if len(at):
                        seen[at] = True
                        d = np.bitwise_count(self.codes[at] ^ query).sum(1).astype(np.int64)
                        found.append(at)
                        far.append(d)
                        by_distance += np.bincount(d, minlength=len(by_distance))
                if by_distance[: covered + 1].sum() >= k or bound is not None and covered >= bound or len(self.ids) == sum(map(len, found)):
                    break
            else:
                continue
            break
        at, d = np.concatenate(found), np.concatenate(far)
        if bound is not None:
            at, d = at[d <= bound], d[d <= bound]
        best = np.lexsort((at, d))[:k]  # places ascend with ids
        return self.ids[at[best]], d[best]


def _blocks(codes: DataFrame, size: int, names: tuple[str, str, str]) -> DataFrame:
    """(number, ids, codes) in blocks of up to ``size``, one length of code to a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple[int, bytes]]] = {}

        def out(part: list[tuple[int, bytes]]) -> pa.RecordBatch:
            nonlocal number
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([np.array([x[0] for x in part], "<i8").tobytes()], pa.binary()), pa.array([b"".join(x[1] for x in part)], pa.binary())], list(names))

        for batch in batches:
            for i, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = held.setdefault(len(c), [])
                part.append((i, c))
                if len(part) == size:
                    yield out(held.pop(len(c)))
        for part in held.values():
            yield out(part)

    return codes.mapInArrow(run, f"{names[0]} long, {names[1]} binary, {names[2]} binary")


def _table(ids: bytes, codes: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(ids, "<i8")
    return rows, np.frombuffer(codes, np.uint8).reshape(len(rows), -1)


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, neighbor_id, distance, rank) of the ``k`` nearest codes of each query; both inputs have id and code.

    Distance is Hamming's; ties go by id. Rows with null id or code take no part, and codes of another length
    than the query's aren't its neighbours. Repeated rows are neighbours of their own, and a repeated query is one; queries of
    one id with different codes are searched each and share the ``k`` rows of their id. Other columns aren't kept, whatever their names.
    """
    use = lambda df: df.select(F.col("id").cast("long"), "code").where(F.col("id").isNotNull() & F.col("code").isNotNull() & (F.length("code") > 0))
    data = _base.keep(_blocks(use(codes), CODES, ("block", "ids", "codes")), "codes")
    asked = _base.keep(_blocks(use(queries).distinct(), QUERIES, ("query_block", "query_ids", "query_codes")), "queries")
    sizes = data.select("block", (F.length("codes") / F.length("ids")).alias("size"))
    rank = F.row_number().over(Window.partitionBy("size", "share").orderBy("block"))
    firsts = sizes.withColumn("share", F.pmod("block", F.lit(SPREAD)).cast("int")).withColumn("place", rank).where("place = 1").select("size", "share", "block")
    home = asked.select("query_block", (F.length("query_codes") / F.length("query_ids")).alias("size"))
    # every block of queries begins with one block of its codes' length
    begun = home.join(firsts.groupBy("size").agg(F.collect_list("block").alias("blocks")), "size").select("query_block", F.expr("blocks[pmod(xxhash64(query_block), size(blocks))]").alias("block"))
    shares = asked.select("query_block", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("share"))
    wanted = shares.join(data.select("block", F.pmod("block", F.lit(SPREAD)).cast("int").alias("share")), "share").select("query_block", "block")
    first = _base.keep(begun, "begun")
    n, m = asked.count(), data.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                if row["block"] != at:
                    at, index = row["block"], Index(*_table(row["ids"], row["codes"]))
                names, asks = _table(row["query_ids"], row["query_codes"])
                if asks.shape[1] != index.codes.shape[1]:
                    continue
                bounds = row["bounds"] or [None] * len(asks)
                got = [index.search(q, k, b) for q, b in zip(asks, bounds, strict=True)]
                columns = [np.repeat(np.arange(len(names)), [len(g[0]) for g in got]), np.repeat(names, [len(g[0]) for g in got]), *(np.concatenate([g[j] for g in got]) for j in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), row["query_block"])), *map(pa.array, columns)], ["query_block", "place", "query_id", "neighbor_id", "distance"])

    def searched(pairs: DataFrame, size: int) -> DataFrame:
        tasks = max(min(2 * size, TASKS), size // 64, 1)
        placed = pairs.join(data, "block").join(asked, "query_block").repartition(tasks, "block", "query_block").sortWithinPartitions("block")
        return placed.mapInArrow(run, "query_block long, place long, query_id long, neighbor_id long, distance long")

    start = _base.keep(searched(first.withColumn("bounds", F.lit(None).cast("array<long>")), n), "first")
    kth = start.groupBy("query_block", "place").agg(F.when(F.count("*") >= k, F.max("distance")).alias("bound"))
    bounds = kth.groupBy("query_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "bound"))), lambda x: x["bound"]).alias("bounds"))
    rest = wanted.join(first, ["query_block", "block"], "left_anti").join(bounds, "query_block", "left")
    near = start.unionByName(searched(rest, n * (m - 1)))
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return near.select("query_id", "neighbor_id", "distance").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op1_binary_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = binarize(_base.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "embedding").select("id", "code")
    return top_k(codes, codes.where(F.col("id") % 50 == 0), 10)


ORACLE_SQL = """
WITH q AS (SELECT DISTINCT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0),
d AS (
    SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id,
        CAST(len(list_filter(list_zip(q.embedding, e.embedding), lambda p: (p[1] > 0) <> (p[2] > 0))) AS BIGINT) AS distance
    FROM q CROSS JOIN embeddings e
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d)
SELECT query_id, neighbor_id, distance, rank FROM r WHERE rank <= 10
"""
