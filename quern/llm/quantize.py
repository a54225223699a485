"""Vector code compression: product codes by weighted Lloyd over distinct integer parts.

Components become integers, and vectors are cut into equal parts. Equal parts of one position are one row with a weight,
so a part that a third of all vectors have is looked at once in each round. A round assigns every distinct part to
its nearest entry; tasks return weighted sums for each entry, so no more than the codebooks' size reaches the driver.
In the end codes and errors are joined back to the vectors by their parts.

Distances are exact: integers of up to ``LIMIT`` keep every product and sum below 2^53.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import _base

#: Integers beyond this are not coded, since sums of squares would not be exact.
LIMIT = 1 << 22
#: Distinct parts whose distances are held at once.
ROWS = 4096


@dataclass
class Codes:
    """``rows``: the vectors' rows with ``codes`` (array<int>, null if not coded) and ``error``; ``books[part][entry]``: integer components."""

    rows: DataFrame
    books: list[np.ndarray]

    def digest(self) -> str:
        """Hex sha256 of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there and has only finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(vector.isNotNull() & ~F.exists(vector, lambda x: bad(x.cast("double"))), F.lit(False))


def _nearest(cells: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of ``cells``; ties go to the lower entry."""
    entry, error = np.zeros(len(cells), np.int64), np.zeros(len(cells), np.int64)
    b = book.astype(np.float64)
    norms = (b * b).sum(1)
    for at in range(0, len(cells), ROWS):
        x = cells[at : at + ROWS].astype(np.float64)
        far = norms - 2 * (x @ b.T)
        near = far.argmin(1)
        entry[at : at + ROWS] = near
        error[at : at + ROWS] = far[np.arange(len(x)), near] + (x * x).sum(1)
    return entry, error


def _cells(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(parts: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(position, entry, n, sums): of each entry the number and the sum of its parts, once for each task."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(books), len(books[0])), np.int64)
        sums = np.zeros((*count.shape, width), np.int64)
        for batch in batches:
            position, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            cells = _cells(batch.column(1), width)
            for p in np.unique(position).tolist():
                mine = position == p
                entry, _ = _nearest(cells[mine], books[p])
                np.add.at(count[p], entry, n[mine])
                np.add.at(sums[p], entry, cells[mine] * n[mine, None])
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], ["position", "entry", "n", "sums"])

    found = parts.select("position", "cells", "n").mapInArrow(run, "position int, entry int, n long, sums array<long>")
    return found.groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(width)]).alias("sums"))


def _assigned(parts: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``parts`` with their entry and error."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position, cells = batch.column(0).to_numpy(), _cells(batch.column(1), width)
            entry, error = np.zeros(len(cells), np.int32), np.zeros(len(cells), np.int64)
            for p in np.unique(position).tolist():
                mine = position == p
                entry[mine], error[mine] = _nearest(cells[mine], books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry), pa.array(error)], ["position", "cells", "n", "entry", "part_error"])

    return parts.select("position", "cells", "n").mapInArrow(run, "position int, cells array<int>, n long, entry int, part_error long")


def compress(vectors: DataFrame, vector: str = "embedding", order: str = "vec_id", *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> Codes:
    """Product codes of ``vectors``: each component is floor(scale * x), and each of ``parts`` has a codebook of up to ``entries``.

    Codebooks start as the parts of the first ``entries`` rows by ``order`` (nulls last, ties by the integers). In each of
    ``rounds`` every part goes to its nearest entry (squared Euclidean distance, ties to the lower one), and entries become the floor of
    their parts' mean; unused ones stay. Then parts are assigned once more.

    Rows whose vector is null or has null or non-finite components are dropped. Rows that can't be coded stay, with null codes and error:
    vectors of another length than the first row's, of a length that ``parts`` doesn't divide, or with
    an integer of ``LIMIT`` or more. Fewer rows than ``entries`` make as many entries; an empty table gives an empty one. Repeated rows are
    coded alike, each on its own. Other columns stay; ones named codes or error, whatever the case, are replaced.
    """
    spark = vectors.sparkSession
    vectors = vectors.drop("codes", "error")
    row, ints = _base.fresh(vectors, "row"), _base.fresh(vectors, "ints")
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale))
    fits = (F.size(vector) > 0) & (F.size(vector) % parts == 0) & F.forall(F.col(vector), lambda x: F.abs(x.cast("double")) < (LIMIT - 1) / scale)
    kept = _base.keep(vectors.where(usable(F.col(vector))).withColumn(ints, F.when(fits, scaled.cast("array<int>"))).withColumn(row, F.monotonically_increasing_id()), "vectors")
    first = lambda df, n: df.select(ints).orderBy(F.col(order).asc_nulls_last(), ints).limit(n).collect()
    start = first(kept.where(F.col(ints).isNotNull()), 1)
    if not start:
        return Codes(kept.select(*vectors.columns, F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")), [])
    size = len(start[0][0])
    width = size // parts
    coded = kept.where(F.size(ints) == size)
    seeds = np.array([r[0] for r in first(coded, entries)], np.int64)
    books = [seeds[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    each = coded.select(row, F.posexplode(F.array(*[F.slice(ints, 1 + p * width, width) for p in range(parts)])).alias("position", "cells"))
    distinct = _base.keep(each.groupBy("position", "cells").agg(F.count("*").alias("n")), "parts")
    for _ in range(rounds):
        for r in _sums(distinct, books).collect():  # a row for each entry at most
            books[r["position"]][r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
    known = _base.keep(_assigned(distinct, books), "codes")
    joined = _base.look_up(each, known, ["position", "cells"], "n")
    codes = joined.groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: x["entry"]).alias("codes"), F.sum("part_error").alias("error"))
    out = _base.keep(kept.drop(ints).join(codes, row, "left").select(*vectors.columns, "codes", "error"), "coded")
    _base.drop(kept, distinct, known)
    return Codes(out, books)


def with_label_error(rows: DataFrame, label: str, into: str = "label_error") -> DataFrame:
    """``rows`` with their error summed over equal labels; null labels are alike."""
    none, name = _base.fresh(rows, "none"), _base.fresh(rows, "name")
    named = rows.withColumn(none, F.col(label).isNull()).withColumn(name, F.coalesce(F.col(label).cast("string"), F.lit("")))
    weight = _base.fresh(named, "weight")
    sums = named.groupBy(none, name).agg(F.sum("error").alias(into), F.count("*").alias(weight))
    return _base.look_up(named, sums, [none, name], weight).drop(none, name)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = compress(_base.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    code = F.array_join(F.transform("codes", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    rows = with_label_error(got.rows.select("vec_id", "label", code.alias("code"), "error"), "label")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(got.digest()).alias("codebooks_sha256"))


def _sql(rounds: int = 4) -> str:
    parts = """
WITH k AS (
    SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
e AS (SELECT r, vec_id, position, v[position * (len(v) // 4) + 1 : (position + 1) * (len(v) // 4)] AS cells FROM k CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS position)),
d AS MATERIALIZED (SELECT position, cells, count(*) AS n FROM e GROUP BY ALL),
b0 AS MATERIALIZED (SELECT position, row_number() OVER (PARTITION BY position ORDER BY vec_id) - 1 AS entry, cells AS book FROM e QUALIFY entry < 256)"""
    for i in range(rounds + 1):
        parts += f""",
a{i} AS MATERIALIZED (
    SELECT position, cells, n, min(CAST(list_sum(list_transform(list_zip(cells, book), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) * 256 + entry) AS found
    FROM d JOIN b{i} USING (position) GROUP BY ALL
)"""
        if i < rounds:
            parts += f""",
s{i} AS (SELECT position, found % 256 AS entry, generate_subscripts(cells, 1) AS j, unnest(cells) * n AS x, n FROM a{i}),
m{i} AS (SELECT position, entry, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY j) AS fresh FROM (SELECT position, entry, j, sum(x) AS s, sum(n) AS c FROM s{i} GROUP BY ALL) GROUP BY ALL),
b{i + 1} AS MATERIALIZED (SELECT position, entry, coalesce(fresh, book) AS book FROM b{i} LEFT JOIN m{i} USING (position, entry))"""
    return f"""{parts},
h AS (SELECT sha256(string_agg(array_to_string(book, ','), ',' ORDER BY position, entry)) AS codebooks_sha256 FROM b{rounds}),
c AS (SELECT r, string_agg(lpad(lower(hex(found % 256)), 2, '0'), '' ORDER BY position) AS code, CAST(sum(found // 256) AS BIGINT) AS error FROM e JOIN a{rounds} USING (position, cells) GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (r) CROSS JOIN h
"""


ORACLE_SQL = _sql()
