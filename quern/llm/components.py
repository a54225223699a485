"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import _base


#: Edges that a task contracts at once.
EDGES = 250_000


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.setdefault(r, r)) != r:
            r = p
        while x != r:
            up[x], x = r, up[x]
        return r

    def join(self, a: int, b: int) -> bool:
        """Whether ``a`` and ``b`` were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each partition's edges as stars: (member, least member)."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    members = np.array([x for x in forest.up if forest.root(x) != x], np.int64)
    roots = np.array([forest.root(x) for x in members.tolist()], np.int64)
    for at in range(0, len(members), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(members[at : at + 100_000]), pa.array(roots[at : at + 100_000])], ["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: of each vertex, the neighbours above it (large) or it and those below (small) go to the least one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where(F.col("b") <= F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(member, root) of every vertex of ``edges`` (a, b: long) that isn't the least of its component.

    Edges come in partitions of about ``EDGES``, each of which contracts its own. What crosses partitions is
    joined by alternating star steps until every member has one root that is no member itself.
    """
    edges = _base.keep(edges.select("a", "b"), "edges")
    while True:
        parts = -(-edges.count() // EDGES)
        stars = _base.keep(edges.coalesce(max(1, parts)).mapInArrow(_contract, "a long, b long"), "edges")
        _base.drop(edges)
        if parts <= 1:
            break
        seen = stars.select(F.col("a").alias("x"), F.lit(1).alias("member"), F.lit(0).alias("root")).union(stars.select("b", F.lit(0), F.lit(1)))
        loose = seen.groupBy("x").agg(F.sum("member").alias("member"), F.max("root").alias("root")).where((F.col("member") > 1) | ((F.col("member") > 0) & (F.col("root") > 0)))
        if loose.isEmpty():
            break
        edges = _base.keep(_star(_star(stars, True), False), "edges")
        _base.drop(stars)
    out = stars.select(F.col("a").alias("member"), F.col("b").alias("root"))
    out._kept_at = stars._kept_at
    return out
