"""A hierarchical Pitman-Yor language model, trained and applied without holding words or contexts in one place.

Each word before, whatever its count, has a restaurant, and all of these share the root as parent, which draws
from all known words and one unknown. After a word that training text doesn't have, the root decides.

Everything about a word (its customers and tables in all restaurants) lies in one bucket by the word's hash, so
Gibbs sampling needs nothing from other buckets but each restaurant's totals. The root's go to every bucket; those of the
words before are summed in shards by the range of their hash, and each bucket gets back only those of the contexts it
has. A word with more tokens than half a bucket is split into parts by the word before; the root has a dish for each
part, and its probability is that of all its parts. A sweep draws the tables of each (word, restaurant) given its customers
and the parent's probability of the word; a bucket's own part of the totals is up to date, that of other buckets is
from the sweep before, as usual where Gibbs sampling is spread over machines. Predictive probabilities are averaged over the last sweeps.

Tokens are looked up by blocks: a block of documents asks each bucket once for each different (word, context)
it has, and keeps its documents' texts for the answers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import _base
from quern.llm._text import LOWER, hash_words, mix

BLOCK_BYTES = 16 << 20
#: Text whose words are hashed together; what that needs is many times the text.
PIECE_BYTES = 1 << 20
BUCKET_TOKENS = 1_250_000
BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
#: Log probabilities come back from the buckets in steps of 1 / FINE.
FINE = 2048
#: Up to so many customers the number of tables is drawn from its exact distribution.
EXACT = 24
_END, _START = (np.uint64(x) for x in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165))
_NAMES = ["block", "bucket", "payload"]
_KINDS = "block long, bucket int, payload binary"


def _wide(tokens: int) -> int:
    """Bytes of a context's number, so that one of so many tokens shares it with another with odds of at most about 1 / 128."""
    return min(7, max(4, -(-(max(1, tokens // 16).bit_length() + 7) // 8)))


def _contexts(words: np.ndarray, wide: int) -> np.ndarray:
    """Numbers of contexts: the upper ``wide`` bytes of the hash of the word before."""
    return words >> np.uint64(64 - 8 * wide)


def _pack(contexts: np.ndarray, wide: int) -> bytes:
    return np.ascontiguousarray(contexts.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def _unpack(raw: bytes, n: int) -> np.ndarray:
    cells = np.zeros((n, 8), np.uint8)
    cells[:, : len(raw) // max(1, n)] = np.frombuffer(raw, np.uint8).reshape(n, -1) if n else 0
    return cells.view("<u8").ravel()


def _pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """``texts`` in groups of about ``PIECE_BYTES``, one group at least."""
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= PIECE_BYTES:
            yield held
            held, size = [], 0
    if held or not texts:
        yield held


def _tokens(texts: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and context of each token, the end of each text among them, and the place of each text's first token (with the total last)."""
    token, before, sizes = (np.concatenate(x) for x in zip(*[_tokens_of(part, wide) for part in _pieces(texts)], strict=True))
    return token, before, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _tokens_of(texts: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and context of each token, and the number of tokens of each text."""
    starts, _, words = hash_words(b" ".join(texts).translate(LOWER))
    past = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.searchsorted(starts, past)]).astype(np.int64)
    at = np.arange(len(words)) + np.repeat(np.arange(len(texts)), np.diff(first))
    places = first + np.arange(len(texts) + 1)
    token = np.empty(places[-1], np.uint64)
    token[at], token[places[1:] - 1] = words, _END
    before = np.empty(len(token), np.uint64)
    before[places[:-1]] = _contexts(_START, wide)
    before[at + 1] = _contexts(words, wide)  # of the token after each word
    return token, before, np.diff(places)


def _parts(word: int, parts: int) -> np.ndarray:
    """The words that stand for the parts of a split word."""
    return mix(np.uint64(word) ^ mix(np.arange(1, parts + 1, dtype=np.uint64)))


def _split(token: np.ndarray, before: np.ndarray, hot: dict[int, int]) -> None:
    """Put parts in the place of split words, by the word before."""
    for word, n in hot.items():
        at = np.flatnonzero(token == np.uint64(word))
        token[at] = _parts(word, n)[(mix(before[at]) % np.uint64(n)).astype(np.int64)]


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (doc_id, held_out, text) in blocks of about ``BLOCK_BYTES`` of text; a text isn't cut."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, _base.STEP):
            part = batch.slice(at, _base.STEP)
            for i, h, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _base.texts_of(part, "text"), strict=True):
                held.append((i, h, t))
                size += len(t)
                if size >= BLOCK_BYTES:
                    yield held
                    held, size = [], 0
                    _base.trim()
    if held:
        yield held


def _survey(docs: DataFrame) -> tuple[int, dict[int, int]]:
    """The number of all tokens, and how many parts each word has that is split.

    Of each block only words with at least 1 / 4,096 of its tokens are reported, or with fewer where there are so many blocks that a word
    could be missed: what all blocks together leave out of a word is less than half a part. What a word near the bound does may follow
    the layout: that moves random draws, but no count.
    """
    blocks = 1 + 4 * int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // BLOCK_BYTES  # texts are packed in their files
    least = BUCKET_TOKENS / (4 * blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.release()
        for held in _blocks_of(batches):
            token = _tokens([x[2] for x in held], 4)[0]
            words, n = np.unique(token, return_counts=True)
            often = n >= min(len(token) / 4096, least)
            words, n = words[often].view(np.int64).tolist(), n[often].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([None, *words], pa.int64()), pa.array([len(token), *n], pa.int64())], ["word", "n"])

    sums = docs.select("doc_id", "held_out", "text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    part = BUCKET_TOKENS // 2
    found = {r["word"]: r["n"] for r in sums.where(F.col("word").isNull() | (F.col("n") > part)).collect()}  # at most two for each bucket
    tokens = found.pop(None, 0)
    return tokens, {int(np.int64(w).view(np.uint64)): -(-n // part) for w, n in sorted(found.items())}


@dataclass
class Pairs:
    """The different (word, context) of a block in the order of their words, and which of them each token is."""

    words: np.ndarray
    per: np.ndarray  # pairs of each word
    contexts: np.ndarray
    context: np.ndarray  # of each pair, its place among the contexts
    which: np.ndarray
    places: np.ndarray  # of each text's first token, with the total last


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and which of them each one is; ``numpy.unique`` needs twice the memory for it."""
    order = np.argsort(x)
    values = x[order]
    new = np.ones(len(x), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    values = values[new]
    which = np.empty(len(x), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return values, which


def _pairs(texts: list[bytes], wide: int, hot: dict[int, int]) -> Pairs:
    token, before, places = _tokens(texts, wide)
    _split(token, before, hot)
    words, word = _ranked(token)
    del token
    contexts, context = _ranked(before)
    del before
    pair = word.astype(np.int64)
    del word
    pair *= len(contexts)
    pair += context
    del context
    pairs, which = _ranked(pair)
    del pair
    per = np.bincount(pairs // len(contexts), minlength=len(words))
    return Pairs(words, per, contexts, (pairs % len(contexts)).astype(np.int32), which.astype(np.uint32), places)


def _ask(docs: DataFrame, buckets: int, wide: int, hot: dict[int, int]) -> DataFrame:
    """(block, bucket, payload): requests to the buckets, and with bucket -1 the block's documents."""

    def block_rows(block: int, held: list[tuple]) -> Iterator[tuple[int, int, bytes]]:
        texts = [x[2] for x in held]
        p = _pairs(texts, wide, hot)
        train = np.repeat(~np.array([x[1] for x in held], bool), np.diff(p.places))
        n = np.bincount(p.which[train], minlength=len(p.context)).astype(np.uint32)
        p.which = None
        of_words = np.searchsorted(_home(p.words, buckets), np.arange(buckets + 1))
        cuts = np.concatenate([[0], np.cumsum(p.per)])[of_words]  # words ascend with their buckets
        yield block, -1, pickle.dumps(([x[0] for x in held], [x[1] for x in held], [len(t) for t in texts], zstd.compress(b"".join(texts)), cuts), 5)
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            words, own = slice(of_words[b], of_words[b + 1]), slice(cuts[b], cuts[b + 1])
            yield block, b, pickle.dumps((p.words[words], _small(p.per[words]), _pack(p.contexts[p.context[own]], wide), _small(n[own])), 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.release()
        for block, held in enumerate(_blocks_of(batches), TaskContext.get().partitionId() << 24):
            for part in batched(block_rows(block, held), 64):
                yield _row(*zip(*part, strict=True))

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, _KINDS)


def _row(block, bucket, payload) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())], _NAMES)


def _home(words: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each word: that of the range in which its hash lies."""
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _small(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as bytes, and in order those that are 255 or more."""
    return np.minimum(n, 255).astype(np.uint8), n[n >= 255].astype(np.uint32)


def _counts(packed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    n = packed[0].astype(np.int64)
    n[n == 255] = packed[1]
    return n


def _gather(asked: DataFrame, answers: DataFrame | None, buckets: int) -> DataFrame:
    """(block, bucket, payload): each bucket's rows together, the totals of its contexts first, then its requests in the order of their blocks."""
    rows = asked if answers is None else asked.unionByName(answers)
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows (place, key, payload) that lie in the order of their keys and places, as (key, all its (place, payload))."""
    at, held = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            place, key, payload = (batch.column(k)[i].as_py() for k in range(3))
            if key != at:
                if held:
                    yield at, held
                at, held = key, []
            held.append((place, payload))
    if held:
        yield at, held


def _open(number: int, rows: list[tuple[int, bytes]], shared: "Totals | None", hot: "Hot") -> tuple["Bucket", "Totals | None"]:
    """A bucket and the totals of all other buckets in its restaurants; ``shared`` are the root's over all buckets."""
    bucket = Bucket(number, [x for x in rows if x[0] >= 0], hot)
    if shared is None:
        return bucket, None
    own, *parts = [pickle.loads(raw) for place, raw in rows if place < 0]
    customers, tables = (np.concatenate([shared.root[i : i + 1] - own[i], *[_counts(p[i]) for p in parts]]) for i in (0, 1))
    return bucket, shared.of(customers, tables)


@dataclass
class Hot:
    """Split words: of each part the customers, tables and training tokens of all parts of its word, its own at the root, and their number."""

    at: dict[int, tuple[float, float, int, float, float, int]] = field(default_factory=dict)


class Bucket:
    """The words of a bucket with their customers in training text; sampling is seeded by the bucket's number."""

    def __init__(self, number: int, requests: list[tuple[int, bytes]], hot: Hot = Hot()):
        loaded = [(block, *pickle.loads(raw)) for block, raw in requests]
        self.words = np.unique(np.concatenate([x[1] for x in loaded]))
        named = [_unpack(x[3], len(x[4][0])) for x in loaded]
        self.contexts = np.unique(np.concatenate(named))
        self.requests: list[tuple[int, tuple, np.ndarray]] = []  # block, numbers of requests by word, and word and context of each as one number
        for (block, u, per, _, _), c in zip(loaded, named, strict=True):
            self.requests.append((block, per, np.repeat(np.searchsorted(self.words, u), _counts(per)) * len(self.contexts) + np.searchsorted(self.contexts, c)))
        del named
        pair, n = np.concatenate([x[2] for x in self.requests]), np.concatenate([_counts(x[4]) for x in loaded])
        del loaded
        pair, n = pair[n > 0], n[n > 0]
        order = np.argsort(pair)
        pair, n = pair[order], n[order]
        del order
        at = np.flatnonzero(np.diff(pair, prepend=-1))
        self.pair = pair[at]  # the leaves
        self.n = np.add.reduceat(n, at) if len(at) else n
        self.word, self.context = (self.pair // len(self.contexts)).astype(np.int32), (self.pair % len(self.contexts)).astype(np.int32)
        self.total = np.bincount(self.word, self.n, len(self.words)).astype(np.int64)
        self.random = np.random.default_rng(number)
        self.t_leaf = np.ones(len(self.n), np.int64)
        self._fold()
        self.t_root = (self.n_root > 0).astype(np.int64)
        self.of_hot = [(i, hot.at[w]) for i, w in enumerate(self.words.tolist()) if w in hot.at] if hot.at else []
        self.more_n, self.more_t, self.share = np.zeros(len(self.words)), np.zeros(len(self.words)), np.ones(len(self.words))
        for i, (n_all, t_all, _, n_own, t_own, parts) in self.of_hot:
            self.more_n[i], self.more_t[i], self.share[i] = n_all - n_own, t_all - t_own, 1 / parts

    def _fold(self) -> None:
        """Customers of the root: tables of the leaves."""
        self.n_root = np.bincount(self.word, self.t_leaf, len(self.words)).astype(np.int64)

    def p_root(self, m: "Totals") -> np.ndarray:
        """The root's probability of each word; a word that training text doesn't have gets that of the unknown one."""
        own = self.n_root + self.more_n - m.discount[1] * (self.t_root + self.more_t)
        return (own + (STRENGTH + m.discount[1] * m.tables[0]) * m.base) / (STRENGTH + m.customers[0])

    def sweep(self, m: "Totals") -> None:
        """One Gibbs sweep from the leaves up: the tables of each (word, restaurant) anew."""
        a = (STRENGTH + m.discount[0] * m.tables[1 + self.context]) * self.p_root(m)[self.word]
        self.t_leaf = _tables(self.n, a, m.discount[0], self.random)
        self._fold()
        self.t_root = _tables(self.n_root, (STRENGTH + m.discount[1] * m.tables[0]) * m.base * self.share, m.discount[1], self.random)

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables: the root's, then those of each context."""
        n, t = (np.bincount(self.context, x, len(self.contexts)) for x in (self.n, self.t_leaf))
        return np.concatenate([[self.n_root.sum()], n]), np.concatenate([[self.t_root.sum()], t])

    def together(self, others: "Totals") -> "Totals":
        """The totals of all buckets from those of the others."""
        n, t = self.totals()
        return others.of(others.customers + n, others.tables + t)

    def once_twice(self) -> list[tuple[float, float]]:
        """Words sitting alone and in twos at the leaves and the root."""
        return [(float((n == 1).sum()), float((n == 2).sum())) for n in (self.n, self.n_root)]

    def answers(self, others: "Totals", samples: int) -> Iterator[tuple[int, np.ndarray, tuple, np.ndarray]]:
        """(block, log10 probability of each request, numbers of requests by word, training count of each of these words)."""
        asked = []
        for block, per, pair in self.requests:
            own = _find(self.pair, pair).astype(np.int32)
            asked.append((block, per, (pair // len(self.contexts)).astype(np.int32), (pair % len(self.contexts)).astype(np.int32), own, np.zeros(len(pair))))
        self.requests.clear()
        for i in range(BURN_IN + samples):
            self.sweep(self.together(others))
            if i < BURN_IN:
                continue
            m = self.together(others)
            root, leaf = self.p_root(m), self.n - m.discount[0] * self.t_leaf
            room, size = STRENGTH + m.discount[0] * m.tables[1:], STRENGTH + m.customers[1:]
            for _, _, w, c, own, total in asked:
                total += (_at(leaf, own) + room[c] * root[w]) / size[c]
        n = self.total.copy()
        for i, x in self.of_hot:
            n[i] = x[2]
        for block, per, w, _, _, total in asked:
            counts = _counts(per)
            yield block, np.log10(total / samples), per, n[w[np.cumsum(counts) - counts]]


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted key in sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def _at(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.where(places >= 0, values[places], 0.0) if len(values) else np.zeros(len(places))


def _stirling(d: float) -> np.ndarray:
    """log of the generalised Stirling numbers S(n, t) for discount ``d``, by n and t up to ``EXACT``."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[0, 0] = 0.0
    for n in range(1, EXACT + 1):
        for t in range(1, n + 1):
            stay = np.log(n - 1 - d * t) + s[n - 1, t] if n - 1 > d * t and np.isfinite(s[n - 1, t]) else -np.inf
            s[n, t] = np.logaddexp(s[n - 1, t - 1], stay)
    return s


def _tables(n: np.ndarray, a: np.ndarray, d: float, random: np.random.Generator) -> np.ndarray:
    """The number of tables of ``n`` customers each: a draw given that a new table weighs ``a``.

    Up to ``EXACT`` customers p(t) is proportional to S(n, t) * a ** t. Beyond, customers are seated one by one
    while there are few, then in runs that grow with the number seated, each run with one binomial draw.
    """
    t = np.ones(len(n), np.int64)
    log_s, log_a = _stirling(d), np.log(np.maximum(a, 1e-300))
    for k in range(2, EXACT + 1):
        at = np.flatnonzero(n == k)
        for lo in range(0, len(at), 50_000):
            part = at[lo : lo + 50_000]
            steps = np.arange(1, k + 1)
            p = log_s[k, 1 : k + 1] + steps * log_a[part][:, None]
            p = np.exp(p - p.max(1, keepdims=True))
            c = np.cumsum(p, 1)
            t[part] = 1 + (c < random.random((len(part), 1)) * c[:, -1:]).sum(1)
    many = np.flatnonzero(n > EXACT)
    if len(many):
        seated, got, most, w = 1, np.ones(len(many)), n[many], a[many]
        while (left := most > seated).any():
            run = np.minimum(max(1, seated // 16), most - seated).clip(0)
            new = w / (w + np.maximum(seated - d * got, 1e-9))
            got += np.where(left, random.binomial(run, np.clip(new, 0, 1)), 0)
            seated += max(1, seated // 16)
        t[many] = np.minimum(got, most).astype(np.int64)
    return np.where(n > 0, t, 0)


@dataclass
class Totals:
    """What all buckets need of each other: customers and tables (the root's first, then by context), discounts of leaves and root, the root's base."""

    customers: np.ndarray
    tables: np.ndarray
    discount: np.ndarray
    base: float

    @property
    def root(self) -> np.ndarray:
        return np.array([self.customers[0], self.tables[0]])

    def of(self, customers: np.ndarray, tables: np.ndarray) -> "Totals":
        return Totals(customers, tables, self.discount, self.base)


@dataclass
class Round:
    """What is known after all buckets were summed: the root's totals, split words, training tokens and their kinds, and each bucket's answers."""

    shared: Totals
    hot: Hot
    tokens: int
    kinds: int
    answers: DataFrame
    kept: DataFrame


def _sum_totals(asked: DataFrame, last: Round | None, buckets: int, wide: int, hot: dict[int, int]) -> Round:
    """The totals over all buckets, after sweeps with the last round's if there was one.

    ``answers`` has (block, bucket, payload): what each bucket had of the root, in its first row, and the
    totals of other buckets in its contexts.
    """
    shared, split = (last.shared, last.hot) if last else (None, Hot())
    parts_of = {int(p): w for w, n in hot.items() for p in _parts(w, n).tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.release()
        for number, rows in _groups(batches):
            b, others = _open(number, rows, shared, split)
            del rows
            b.requests.clear()
            for _ in range(BURN_IN if others else 0):
                b.sweep(b.together(others))
            n, t = b.totals()
            mine = [(w, float(b.n_root[i]), float(b.t_root[i]), int(b.total[i])) for i, w in enumerate(b.words.tolist()) if w in parts_of] if parts_of else []
            sums = [*b.once_twice(), (float(b.total.sum()), float((b.total > 0).sum() - sum(x[3] > 0 for x in mine)))]
            yield _row([-1, -2], [number] * 2, [pickle.dumps(x, 5) for x in ((n[0], t[0], sums, mine), (n[0], t[0]))])
            shard = (b.contexts >> np.uint64(8 * wide - 32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.searchsorted(shard, np.arange(buckets + 1, dtype=np.uint64))
            n, t = n[1:].astype(np.int64), t[1:].astype(np.int64)
            for part in batched(np.flatnonzero(np.diff(cuts)).tolist(), 64):
                cells = [[x[cuts[s] : cuts[s + 1]] for x in (b.contexts, n, t)] for s in part]
                yield _row(part, [number] * len(part), [pickle.dumps((_pack(c, wide), _small(x), _small(y)), 5) for c, x, y in cells])
            del b, others
            _base.trim()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.release()
        for shard, rows in _groups(batches):
            parts = [pickle.loads(raw) for _, raw in rows]
            contexts = [_unpack(p[0], len(p[1][0])) for p in parts]
            known, which = np.unique(np.concatenate(contexts), return_inverse=True)
            n, t = (np.bincount(which, np.concatenate([_counts(p[i]) for p in parts]), len(known)).astype(np.int64) for i in (1, 2))
            ends = np.cumsum([len(c) for c in contexts]).tolist()
            for (bucket, _), (_, own_n, own_t), a, z in zip(rows, parts, [0, *ends[:-1]], ends, strict=True):
                others = [_small(total[which[a:z]] - _counts(own)) for total, own in ((n, own_n), (t, own_t))]
                yield _row([shard - buckets], [bucket], [pickle.dumps(others, 5)])

    found = _base.keep(_gather(asked, last.answers if last else None, buckets).mapInArrow(run, _KINDS), "totals")
    sums = [pickle.loads(r["payload"]) for r in found.where("block = -1").select("payload").collect()]  # a few numbers for each bucket
    few = np.array([x[2] for x in sums]).reshape(-1, 3, 2).sum(0)
    mine = {w: x for *_, m in sums for w, *x in m}
    whole: dict[int, np.ndarray] = {}
    for p, w in parts_of.items():
        whole[w] = whole.get(w, np.zeros(3)) + mine.get(p, (0.0, 0.0, 0))
    split = Hot({p: (whole[w][0], whole[w][1], int(whole[w][2]), *mine.get(p, (0.0, 0.0, 0))[:2], hot[w]) for p, w in parts_of.items()})
    tokens, kinds = int(few[2, 0]), int(few[2, 1]) + sum(x[2] > 0 for x in whole.values())
    discount = np.array([np.clip(one / max(1.0, one + 2 * two), 0.05, 0.95) for one, two in few[:2]])
    shared = Totals(np.array([sum(x[0] for x in sums)], float), np.array([sum(x[1] for x in sums)], float), discount, 1 / (kinds + 1))
    parts = found.where("block >= 0").select(F.col("bucket").cast("long").alias("block"), F.col("block").cast("int").alias("bucket"), "payload")
    answered = parts.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(merge, _KINDS)
    own = found.where("block = -2").select(F.lit(-buckets - 1).cast("long").alias("block"), "bucket", "payload")
    return Round(shared, split, tokens, kinds, own.unionByName(answered), found)


def _answer(asked: DataFrame, last: Round, buckets: int) -> DataFrame:
    """(block, bucket, payload): the answers to each block's requests."""
    shared, split = last.shared, last.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.release()
        for number, rows in _groups(batches):
            b, others = _open(number, rows, shared, split)
            del rows
            for block, log_p, per, n in b.answers(others, SAMPLES):
                yield _row([block], [number], [pickle.dumps((np.minimum(np.rint(log_p * -FINE), 65535).astype(np.uint16), per, _small(n)), 5)])
            del b, others
            _base.trim()

    return _gather(asked, last.answers, buckets).mapInArrow(run, _KINDS)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs`` (doc_id, text, held_out).

    Rows with ``held_out`` aren't learned from. Null and empty texts have one token, their end. A text of any length is
    scored whole, in a block of its own if it is longer than a block. Without any training row every token is unknown.
    Repeated rows get the same scores. Other columns of ``docs`` aren't kept, whatever their names.
    """
    tokens, hot = _survey(docs)
    buckets, wide = max(1, -(-tokens // BUCKET_TOKENS)), _wide(tokens)
    spark = docs.sparkSession
    path = _base.new_folder(spark, "asked")
    _ask(docs, buckets, wide, hot).withColumn("kind", (F.col("bucket") >= 0).cast("int")).write.partitionBy("kind").parquet(path)
    rows = spark.read.schema(f"{_KINDS}, kind int").parquet(path)
    asked, own = (rows.where(f"kind = {k}").drop("kind") for k in (1, 0))
    last = None
    for _ in range(2):
        before = last
        last = _sum_totals(asked, before, buckets, wide, hot)
        _base.drop(*[before.kept] if before else [])
    answered = _base.keep(_answer(asked, last, buckets), "answers")
    _base.drop(last.kept)
    _base.remove(spark, f"{path}/kind=1")
    train_tokens, kinds = last.tokens, last.kinds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _base.release()
        for _, rows in _groups(batch.select(["bucket", "block", "payload"]) for batch in batches):
            ids, held, sizes, raw, cuts = pickle.loads(rows[0][1])
            log_p, n = np.zeros(cuts[-1], np.float32), np.zeros(cuts[-1], np.int64)
            for b, payload in rows[1:]:
                x, per, y = pickle.loads(payload)
                log_p[cuts[b] : cuts[b + 1]], n[cuts[b] : cuts[b + 1]] = x / -FINE, np.repeat(_counts(y), _counts(per))
            del rows
            raw, ends = zstd.decompress(raw), np.cumsum([0, *sizes]).tolist()
            p = _pairs([raw[a:z] for a, z in zip(ends, ends[1:], strict=False)], wide, hot)
            token, places = p.which, p.places
            del p, raw
            base = np.log10((n + 0.1) / (train_tokens + 0.1 * (kinds + 1)))
            sums = lambda x: np.add.reduceat(x[token].astype(float), places[:-1])
            columns = [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(np.diff(places)), pa.array(sums(n > 0).astype(np.int64)), pa.array(sums(base)), pa.array(sums(log_p))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
            _base.trim()

    placed = own.unionByName(answered).repartition(max(1, buckets // 4), "block").sortWithinPartitions("block", "bucket")
    scored = placed.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.read(spark, sf_dir, "documents")
    return score(docs.select(F.col("doc_id").cast("long"), "text", (_base.remainder(F.col("doc_id"), 10) == 0).alias("held_out")))
