"""Gradient boosting on histograms, with leaf-wise growth and L2 regularisation, for a binary label.

Features are cut into bins by quantiles once. Sums of gradients and curvatures by (leaf, feature, bin) are one aggregate over
the rows for each level of a tree, so the driver sees no more than leaves x features x bins numbers. Growth is best first: the
leaf with the largest gain is split, until a tree has its leaves. Levels of several leaves share a job: what best-first growth would split
with the gains known so far is split, and their children's sums are taken together; gains that come later only move
others back, so nothing is missing and what isn't used goes. Of two children only the one with fewer rows is summed up; the other is the
rest of its parent.

Sums are integers (multiples of 2^-30), so trees don't depend on how rows are partitioned. Rows lie in blocks, whose columns are read as
arrays, in a file for each core, and executors hold them between passes. A pass is one stage: each core's sums come to the driver, which adds them up.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.shared import drop, keep

_UNIT = float(1 << 30)
#: Rounds after which the rows' sums are written, so that no lineage is longer.
KEEP_EVERY = 20
#: Rows of a block, which is a row of the table that passes read, and rows that a task sums up at once (of which sums are exact as doubles).
BLOCK, AT_ONCE = 512, 1 << 16


@dataclass
class Tree:
    """Nodes as arrays: a row goes left if its bin is at most ``at``; a leaf has no feature (-1) and adds ``value``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    at: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        a = len(self.feature)
        self.feature[node], self.at[node], self.left[node], self.right[node] = feature, at, a, a + 1
        for _ in range(2):
            self.feature.append(-1), self.at.append(0), self.left.append(0), self.right.append(0), self.value.append(0.0)
        return a, a + 1

    def rows_of(self, bins: np.ndarray, wanted: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, its rows) of ``bins``, which has an array for each feature; of ``wanted`` leaves and those above them only, if given."""
        waiting = [(0, np.arange(bins.shape[1]))]
        while waiting:
            node, rows = waiting.pop()
            if self.feature[node] < 0:
                yield node, rows
                continue
            low = bins[self.feature[node]].take(rows) <= self.at[node]
            for child, mine in ((self.left[node], low), (self.right[node], ~low)):
                if wanted is None or child in wanted:
                    waiting.append((child, rows[mine]))

    def above(self, leaves: list[int]) -> set[int]:
        """``leaves`` and the nodes above them."""
        out = set(leaves)
        for node in reversed(range(len(self.feature))):  # children come after their parent
            if self.feature[node] >= 0 and (self.left[node] in out or self.right[node] in out):
                out.add(node)
        return out

    def add(self, bins: np.ndarray, raw: np.ndarray) -> None:
        """Add each row's value to ``raw``."""
        for leaf, rows in self.rows_of(bins):
            raw[rows] += self.value[leaf]



@dataclass
class Boosted:
    """A fitted model: bins' upper bounds by feature, trees, and the score of a row without any."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    base: float

    def score(self, rows: DataFrame, into: str = "score") -> DataFrame:
        """``rows`` with the probability of the positive class; a column of that name is replaced."""
        rows = rows.drop(into)
        schema = T.StructType([*rows.schema.fields, T.StructField(into, T.DoubleType())])
        at = [rows.columns.index(f) for f in self.features]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = _bins([batch.column(i) for i in at], self.edges)
                raw = np.full(batch.num_rows, self.base)
                for tree in self.trees:
                    tree.add(bins, raw)
                yield batch.append_column(into, pa.array(1 / (1 + np.exp(-raw)), pa.float64()))

        return rows.mapInArrow(run, schema)


def _bins(columns: list[pa.Array], edges: list[np.ndarray]) -> np.ndarray:
    """Of each column the bins of its values: how many bounds lie below them. Null and NaN come below all."""
    out = np.zeros((len(columns), len(columns[0]) if columns else 0), np.uint8)
    for i, (c, e) in enumerate(zip(columns, edges, strict=True)):
        x = np.nan_to_num(np.array(c.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64), nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        out[i] = np.searchsorted(e, x, "left")
    return out


def _edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Of each feature the upper bounds of its bins: its values where there are up to ``bins``, else quantiles."""
    use = rows.select(*[F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in features])
    shares = [i / bins for i in range(1, bins)]
    whole = use.agg(*[F.percentile_approx(f, shares, 20 * bins).alias(f) for f in features], *[F.approx_count_distinct(f).alias(f"{f}_n") for f in features]).first()
    out = []
    for f in features:
        few = [r[0] for r in use.select(f).dropna().distinct().limit(bins + 1).collect()] if whole[f"{f}_n"] <= 2 * bins else None
        out.append(np.unique(np.array(few if few is not None and len(few) <= bins else whole[f] or [], np.float64)))
    return out


def _sums(table: DataFrame, added: list[Tree], tree: Tree, wanted: list[int], features: int) -> dict[int, np.ndarray]:
    """(3, feature, bin) sums of gradient, curvature (as integers) and rows for each of the leaves ``wanted`` of ``tree``."""
    place, path = {node: i for i, node in enumerate(wanted)}, tree.above(wanted)
    shape = (3, features, len(wanted), 256)

    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        total = np.zeros(shape, np.int64)
        for bins, y, raw in blocks:
            raw = _added(bins, raw, added)
            found = list(tree.rows_of(bins, path))
            rows = np.concatenate([r for _, r in found])
            leaf = np.repeat([256 * place[node] for node, _ in found], [len(r) for _, r in found])
            p = 1 / (1 + np.exp(-raw[rows]))
            weights = (np.rint((p - y[rows]) * _UNIT), np.rint(p * (1 - p) * _UNIT), None)
            for f in range(features):
                key = leaf + bins[f].take(rows)
                for i, w in enumerate(weights):
                    total[i, f] += np.bincount(key, w, shape[2] * 256).astype(np.int64).reshape(shape[2:])
        cells = np.flatnonzero(total[2])
        yield cells, total.reshape(3, -1)[:, cells]

    total = np.zeros(shape, np.int64)
    for cells, sums in _held(table, features).mapPartitions(run).collect():  # a part for each core
        total.reshape(3, -1)[:, cells] += sums
    return dict(zip(wanted, total.transpose(2, 0, 1, 3), strict=True))


def _held(table: DataFrame, features: int) -> RDD:
    """The rows of ``table`` held by executors, ``AT_ONCE`` at a time: (bins by feature, labels, sums); what is lost is read again."""

    def gathered(rows: Iterator[Row]) -> Iterator[tuple]:
        waiting, n = [], 0
        for r in rows:
            y = np.frombuffer(r["y"], np.float64)
            waiting.append((np.frombuffer(r["bins"], np.uint8).reshape(features, len(y)), y, np.frombuffer(r["raw"], np.float64)))
            n += len(y)
            if n + BLOCK > AT_ONCE:
                yield _joined(waiting)
                waiting, n = [], 0
        if waiting:
            yield _joined(waiting)

    if getattr(table, "_rows_held", None) is None:
        table._rows_held = table.rdd.mapPartitions(gathered).persist(StorageLevel.MEMORY_AND_DISK)
    return table._rows_held


def _joined(blocks: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One block of several; labels take a byte if they are 0 and 1."""
    bins, y, raw = (np.concatenate(x, -1) for x in zip(*blocks, strict=True))
    return bins, y.astype(np.uint8) if ((y == 0) | (y == 1)).all() else y, raw


def _added(bins: np.ndarray, raw: np.ndarray, trees: list[Tree]) -> np.ndarray:
    """The rows' sums with those of ``trees``."""
    if trees:
        raw = raw.copy()
    for t in trees:
        t.add(bins, raw)
    return raw


def _blocks(bins: np.ndarray, y: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    """Rows as blocks: their bins by feature, labels and sums as bytes."""
    cuts = range(0, len(y), BLOCK)
    parts = [[np.ascontiguousarray(x[..., a : a + BLOCK]).tobytes() for a in cuts] for x in (bins, y, raw)]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in parts], ["bins", "y", "raw"])


def best_split(sums: np.ndarray, l2: float, least: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a leaf, the first of equal ones; none without gain or with fewer than ``least`` rows on a side."""
    left = sums.cumsum(2)
    whole = left[:, :1, -1:]
    right = whole - left
    worth = lambda s: s[0] ** 2 / (s[1] + l2)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = worth(left) + worth(right) - worth(whole)
    gain = np.where((left[2] >= least) & (right[2] >= least) & (left[1] > 1e-3) & (right[1] > 1e-3), gain, -np.inf)
    at = int(gain.argmax())
    feature, bin_ = divmod(at, gain.shape[1])
    return (float(gain[feature, bin_]), feature, bin_) if gain[feature, bin_] > 1e-9 else None


def _grown(table: DataFrame, added: list[Tree], features: int, leaves: int, l2: float, least: int, rate: float) -> Tree:
    """One tree, grown best first; the gains that a wave of splits needs are one job."""
    trial, unit = Tree(), np.array([_UNIT, _UNIT, 1.0])[:, None, None]
    exact = _sums(table, added, trial, [0], features)
    sums = {0: exact[0] / unit}
    best = {0: best_split(sums[0], l2, least)}
    while True:
        order, waiting, count = [], [(-best[0][0], 0)] if best[0] else [], 1
        while waiting and count < leaves:
            _, node = heapq.heappop(waiting)
            order.append(node)
            count += 1
            for child in (trial.left[node], trial.right[node]) if trial.feature[node] >= 0 else ():
                if best.get(child):
                    heapq.heappush(waiting, (-best[child][0], child))
        fresh = [n for n in (order if count < leaves else order[:-1]) if trial.feature[n] < 0]
        if not fresh:
            break
        fewer = {}
        for n in fresh:
            _, feature, bin_ = best[n]
            low, high = trial.split(n, feature, bin_)
            rows = exact[n][2, feature]
            mine, rest = (low, high) if 2 * rows[: bin_ + 1].sum() <= rows.sum() else (high, low)
            fewer[mine] = (n, rest)
        for c, s in _sums(table, added, trial, list(fewer), features).items():
            n, rest = fewer[c]
            exact[c], exact[rest] = s, exact[n] - s
            for child in (c, rest):
                sums[child] = exact[child] / unit
                best[child] = best_split(sums[child], l2, least)
    tree, held = Tree(), {0: (0, sums[0][:, 0].sum(1) if features else np.zeros(3))}
    for node in order:  # the same splits, without what best-first growth left out
        own, _ = held[node]
        _, feature, bin_ = best[node]
        a, b = tree.split(own, feature, bin_)
        low = sums[node][:, feature, : bin_ + 1].sum(1)
        whole = sums[node][:, feature].sum(1)
        for child, place, s in ((trial.left[node], a, low), (trial.right[node], b, whole - low)):
            tree.value[place] = -rate * s[0] / (s[1] + l2)
            if trial.feature[node] >= 0:
                held[child] = (place, s)
    if not order and held[0][1][2]:
        tree.value[0] = -rate * held[0][1][0] / (held[0][1][1] + l2)
    return tree


def boost(rows: DataFrame, features: list[str], label: str, *, rounds: int = 300, rate: float = 0.05, leaves: int = 31, l2: float = 1.0, least: int = 20, bins: int = 255) -> Boosted:
    """Boosted trees for the log loss of ``label`` (0 or 1): histograms of up to ``bins`` bins, ``leaves`` leaves a tree and ``least`` rows a leaf.

    Rows without label take no part; null and NaN features come below all numbers.
    """
    use = rows.where(F.col(label).isNotNull())
    edges = _edges(use, features, bins)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _blocks(_bins(batch.columns[1:], edges), batch.column(0).to_numpy(), np.zeros(batch.num_rows))

    schema = "bins binary, y binary, raw binary"
    values = use.select(F.col(label).cast("double").alias("y"), *[F.col(f).cast("double").alias(f) for f in features])
    blocks = values.mapInArrow(binned, schema).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    table = keep(blocks, "bins")
    share = values.agg(F.avg("y")).first()[0]
    share = min(max(0.5 if share is None else share, 1e-9), 1 - 1e-9)
    base = Tree(value=[float(np.log(share / (1 - share)))])
    trees, added = [], [base]
    for _ in range(rounds):
        done, before = list(added), _held(table, len(features))
        table._rows_held = before.map(lambda b, done=done: (b[0], b[1], _added(b[0], b[2], done))).persist(StorageLevel.MEMORY_AND_DISK)
        trees.append(_grown(table, [], len(features), leaves, l2, least, rate))  # its first pass adds the tree before to the rows' sums
        before.unpersist()
        added = [trees[-1]]
        if len(trees) % KEEP_EVERY == 0 and len(trees) < rounds:
            held = table._rows_held
            flat = held.flatMap(lambda b: zip(*_blocks(b[0], b[1].astype(np.float64), b[2]).to_pydict().values(), strict=True))
            old, table = table, keep(rows.sparkSession.createDataFrame(flat, schema), "bins")
            held.unpersist()
            drop(old)
    if getattr(table, "_rows_held", None) is not None:
        table._rows_held.unpersist()
    drop(table)
    return Boosted(features, edges, trees, base.value[0])
