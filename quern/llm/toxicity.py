"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text. Byte n-grams are weighted by both classes: the log-likelihood ratio of how many toxic and
how many ordinary texts have one decides whether it speaks for toxicity, so no single text can rule it out. The toxic
dictionary is trained on the pieces of toxic text that such n-grams cover, as often as they occur, the ordinary one on ordinary text without
them. A window of several words is compressed with the ordinary dictionary alone and with the toxic one beside it; the difference
in length is its evidence. In the toxic one's place the first compressor has noise of the same length, so that equal references cost the
same. The largest evidences of the whole text, and how many of its windows have some, go through a calibrated logistic threshold.
Windows overlap by half.

zstandard counts whole bytes and a back reference costs about three of them, so each byte is written as ``EXPAND`` code
bytes before compressing, which makes literals dear and references cheap without changing what can match. A window
that shares no ``GRAM`` bytes with what only the toxic dictionary has can't gain by it: its evidence is 0, and it isn't compressed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import _base
from quern.llm._text import LOWER, SPACES, _spans, mix, windows

EXPAND = 3
TOP = 5
#: Evidences from which on windows are counted.
COUNTED = (3, 6)
FEATURES = TOP - 1 + 2 * len(COUNTED)
WINDOW, STRIDE = 4, 2
GRAM = 6
#: Bytes of an n-gram by which pieces of toxic text are found, its least log-likelihood ratio, by how much it is more frequent in toxic texts, and
#: how many n-grams (those of the largest ratios) the fit uses.
PIECE, LEAST_RATIO, TIMES, TELLING = 8, 15.0, 3.0, 500
ORDINARY_BYTES = 65536
#: Sizes of the toxic dictionary, of which the calibration picks the best.
TOXIC_BYTES = (1024, 2048, 4096)
_GROUP = 4 << 20
_SLICE = 1 << 20
_FOLD = bytes(32 if SPACES[b] else LOWER[b] for b in range(256))
_CODES = mix(np.arange(1, 256 * EXPAND + 1, dtype=np.uint64)).astype(np.uint8).reshape(256, EXPAND)


def _expand(text: bytes) -> bytes:
    return _CODES[np.frombuffer(text, np.uint8)].tobytes()


def _grams(text: bytes, size: int) -> np.ndarray:
    """The numbers of all runs of ``size`` bytes."""
    return windows(text)[: max(0, len(text) - size + 1)] & np.uint64((1 << 8 * size) - 1)


def _in(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``found``."""
    if not len(found):
        return np.zeros(len(values), bool)
    at = np.searchsorted(found, values)
    at[at == len(found)] = 0
    return found[at] == values


@dataclass
class ToxicityModel:
    """What scoring needs: two dictionaries of bounded size and the calibration."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: list[float] = field(default_factory=lambda: [0.0] * (FEATURES + 1))
    prior: float = 0.0

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Scores texts with a model's two compressors."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        if not model.toxic:
            return
        noise = mix(np.arange(1, EXPAND * len(model.toxic) + 1, dtype=np.uint64)).astype(np.uint8).tobytes()
        self.pair = [self._compressor(_expand(model.ordinary) + x) for x in (noise, _expand(model.toxic))]
        own = np.unique(_grams(model.toxic, GRAM))
        self.own = own[~_in(own, np.unique(_grams(model.ordinary, GRAM)))]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self._slot(self.own)] = True

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        return grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)

    @staticmethod
    def _compressor(content: bytes) -> zstd.ZstdCompressor:
        how = zstd.ZstdCompressionParameters(
            window_log=19, chain_log=18, hash_log=18, search_log=8, min_match=3, target_length=999, strategy=zstd.STRATEGY_BTULTRA2,
            write_content_size=0, write_dict_id=0, write_checksum=0, format=zstd.FORMAT_ZSTD1_MAGICLESS,
        )
        d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return zstd.ZstdCompressor(dict_data=d, compression_params=how)

    def evidence(self, some: list[bytes]) -> np.ndarray:
        """By how many bytes the toxic dictionary shortens each window."""
        if not some:
            return np.zeros(0, np.int64)
        plain, toxic = (np.array([len(x) for x in c.multi_compress_to_buffer(some, threads=1)], np.int64) for c in self.pair)
        return plain - toxic

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Of each text the three largest evidences, the sum of the next two, and by ``COUNTED`` how many windows have more, absolutely and as a share."""
        out = np.zeros((len(texts), FEATURES))
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= _GROUP):
                size += len(texts[upto])
                upto += 1
            out[at:upto] = self._group(texts[at:upto])
            at = upto
        return out

    def _group(self, texts: list[bytes]) -> np.ndarray:
        buf = b" %b " % b" ".join(texts).translate(_FOLD)
        hits = []
        for a in range(0, len(buf), _SLICE):
            grams = _grams(buf[a : a + _SLICE + GRAM - 1], GRAM)
            near = np.flatnonzero(self.maybe[self._slot(grams)])
            hits.append(a + near[_in(grams[near], self.own)])
        hit = np.concatenate(hits)
        starts, ends = _spans(np.frombuffer(buf, np.uint8), SPACES)
        first = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]) + 1)])
        n_windows = np.maximum(1, -(-np.diff(first) // STRIDE))
        if not len(hit):
            return self._summary(np.zeros(0, np.int64), np.zeros(0), n_windows)
        word = np.unique(np.searchsorted(starts, hit + 1, "right") - 1)  # a gram may start with the space before its word
        word = word[word >= 0]
        doc = np.searchsorted(first, word, "right") - 1
        start = (word - first[doc]) // STRIDE * STRIDE
        begins = np.unique(np.concatenate([(first[doc] + start - k * STRIDE)[start >= k * STRIDE] for k in range(WINDOW // STRIDE)]))
        doc = np.searchsorted(first, begins, "right") - 1
        last = np.minimum(begins + WINDOW, first[doc + 1]) - 1
        codes = _CODES[np.frombuffer(buf, np.uint8)].ravel() if len(begins) * 64 > len(buf) else None
        cut = (lambda a, b: codes[a * EXPAND : b * EXPAND].tobytes()) if codes is not None else (lambda a, b: _expand(buf[a:b]))
        e = self.evidence([cut(a, b) for a, b in zip((starts[begins] - 1).tolist(), (ends[last] + 1).tolist(), strict=True)])
        return self._summary(doc, e, n_windows)

    @staticmethod
    def _summary(doc: np.ndarray, e: np.ndarray, n_windows: np.ndarray) -> np.ndarray:
        order = np.lexsort((-e, doc))
        doc, e = doc[order], e[order]
        top = np.zeros((len(n_windows), TOP))
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        used = (rank < TOP) & (e > 0)
        top[doc[used], rank[used]] = e[used]
        counts = [np.bincount(doc[e >= c], minlength=len(n_windows)) for c in COUNTED]
        return np.column_stack([top[:, :3], top[:, 3:].sum(1), *[np.log1p(c) for c in counts], *[np.log((c + 0.5) / (n_windows + 5)) for c in counts]])

    def scores(self, texts: list[bytes]) -> list[float]:
        if not self.model.toxic:
            return [self.model.prior for _ in texts]
        x = self.model.weights[0] + self.features(texts) @ np.array(self.model.weights[1:])
        return (1 / (1 + np.exp(-np.clip(x, -60, 60)))).tolist()


def _folded(text: bytes) -> bytes:
    return b" %b " % text.translate(_FOLD)


def _telling(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """The n-grams that speak for toxicity: ``TIMES`` as frequent among toxic texts, with a log-likelihood ratio of ``LEAST_RATIO``, the best ``TELLING``."""

    def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        grams, n, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for i, t in enumerate(texts):
            held.append(np.unique(_grams(_folded(t), PIECE)))
            size += len(held[-1])
            if size > 1 << 21 or i == len(texts) - 1:
                every = np.concatenate([grams, *held])
                ones = np.concatenate([n, np.ones(size, np.int64)])
                grams, at = np.unique(every, return_inverse=True)
                n, held, size = np.bincount(at, ones, len(grams)).astype(np.int64), [], 0
        return grams, n

    (g1, a), (g0, c) = counted(toxic), counted(ordinary)
    if not len(g1):
        return g1
    at = np.minimum(np.searchsorted(g0, g1), max(0, len(g0) - 1))
    b = np.where(g0[at] == g1, c[at], 0) if len(g0) else np.zeros(len(g1), np.int64)
    n1, n0 = len(toxic), len(ordinary)
    part = lambda x, expected: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(expected, 1e-300)), 0.0)
    share = n1 / (n1 + n0)
    ratio = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)) + part(n1 - a, (n1 + n0 - a - b) * share) + part(n0 - b, (n1 + n0 - a - b) * (1 - share)))
    ratio = np.where(a / n1 >= TIMES * (b + 0.5) / n0, ratio, 0.0)
    best = np.argsort(-ratio, kind="stable")[:TELLING]
    return np.sort(g1[best[ratio[best] >= LEAST_RATIO]])


def _parted(text: bytes, grams: np.ndarray) -> tuple[list[bytes], bytes]:
    """(the pieces of a folded text that ``grams`` cover, each with the byte before, and the text without what they cover)."""
    inside = _in(_grams(text, PIECE), grams)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    pieces = [text[max(0, a - 1) : b + PIECE - 1] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
    kept = np.ones(len(text), bool)
    for i in range(PIECE):
        kept[np.flatnonzero(inside) + i] = False
    return pieces, np.frombuffer(text, np.uint8)[kept].tobytes()


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on ``samples``; where these are too few for zstandard's trainer, their last bytes."""
    try:
        return zstd.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[float]:
    """Newton's method with a ridge on standardised features; the weights are those of the features as they are."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    x = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[0, 0] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    w[1:] /= scale
    w[0] -= w[1:] @ mean
    return w.tolist()


def train(toxic: list[bytes], ordinary: list[bytes], share: float) -> ToxicityModel:
    """A model from toxic and ordinary texts; ``share`` is the share of toxic documents among all.

    Two thirds of either side train the dictionaries, the rest the calibration, which also picks the size of the
    toxic dictionary by its likelihood. Where no n-gram speaks for toxicity, all texts get ``share`` as their score.
    """
    if not toxic or not ordinary:
        return ToxicityModel(prior=share)
    cut = [max(1, len(s) * 2 // 3) for s in (toxic, ordinary)]
    grams = _telling(toxic[: cut[0]], ordinary[: cut[1]])
    pieces = [p for t in toxic[: cut[0]] for p in _parted(_folded(t), grams)[0]]
    if not pieces:
        return ToxicityModel(prior=share)
    base = _dictionary([_parted(_folded(t), grams)[1] for t in ordinary[: cut[1]]], ORDINARY_BYTES)
    sides = [toxic[cut[0] :] or toxic, ordinary[cut[1] :] or ordinary]
    y = np.repeat([1.0, 0.0], [len(s) for s in sides])
    odds = min(max(share, 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, odds / len(sides[0]), (1 - odds) / len(sides[1])) * len(y)
    best, least = None, math.inf
    for size in TOXIC_BYTES:
        model = ToxicityModel(base, _dictionary(pieces, size), prior=share)
        x = model.scorer().features([t for s in sides for t in s])
        model.weights = _logistic(x, y, weight)
        z = np.clip(model.weights[0] + x @ np.array(model.weights[1:]), -60, 60)
        loss = float((weight * (np.logaddexp(0, z) - y * z)).sum())
        if loss < least:
            best, least = model, loss
    return best


def fit(
    docs: DataFrame, labels: DataFrame, *, folds: int = 5, held_out: int | None = 0, sample_rows: int = 2000, sample_bytes: int = 12_000_000
) -> ToxicityModel:
    """Fit on labelled rows whose crc32(doc_id as text) mod ``folds`` isn't ``held_out``.

    The fit is bounded: of each class the ``sample_rows`` rows with the least hash of their id, and of
    these as many whole texts as ``sample_bytes`` hold. Rows without label or id aren't used.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") == 1).alias("is_toxic"))
    if held_out is not None:
        labels = labels.where(_base.remainder(F.col("doc_id"), folds) != held_out)
    counts = {r["is_toxic"]: r["count"] for r in labels.groupBy("is_toxic").count().collect()}
    total = sum(counts.values())
    share = counts.get(True, 0) / total if total else 0.0
    order = F.xxhash64("doc_id")
    ids = [r[0] for side in (True, False) for r in labels.where(F.col("is_toxic") == side).groupBy("doc_id").agg(order.alias("h")).orderBy("h", "doc_id").limit(sample_rows).select("doc_id").collect()]
    if not ids:
        return ToxicityModel(prior=share)
    spark = docs.sparkSession
    chosen = labels.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long")), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("is_toxic").alias("is_toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most twice sample_rows ids
    sizes = rows.select("doc_id", "is_toxic", F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).groupBy("doc_id", "is_toxic").agg(F.sum("n").alias("n")).orderBy(order, "doc_id").limit(2 * sample_rows).collect()
    room = {True: sample_bytes, False: sample_bytes}
    taken: dict[int, bool] = {}
    for r in sizes:
        if r["n"] <= room[r["is_toxic"]]:
            room[r["is_toxic"]] -= r["n"]
            taken[r["doc_id"]] = r["is_toxic"]
    kept = rows.join(F.broadcast(spark.createDataFrame([(i,) for i in taken] or [(None,)], "doc_id long")), "doc_id", "left_semi")
    texts = sorted((r["doc_id"], r["text"] or "") for r in kept.select("doc_id", "text").collect())
    texts.sort(key=lambda x: (x[0] * 2654435761) % (1 << 32))
    sides = [list(dict.fromkeys(t.encode() for i, t in texts if taken[i] is s)) for s in (True, False)]
    return train(*sides, share)


def score(docs: DataFrame, model: ToxicityModel, into: str = "toxicity") -> DataFrame:
    """``docs`` with ``into`` (0 to 1) added, from the whole text alone.

    Null and empty texts get the score of a text without evidence. Repeated rows get the same score. A text of any
    length is scored whole, slice by slice. A column that is already named ``into``, whatever the case, is replaced.
    """
    docs = docs.drop(into)
    schema = _base.with_fields(docs, **{into: T.DoubleType()})

    def make():
        scorer = model.scorer()
        return lambda batch: batch.append_column(into, pa.array(scorer.scores(_base.texts_of(batch, "text")), pa.float64()))

    return _base.map_rows(docs, make, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _base.read(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select(
        "doc_id", (_base.remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    )
