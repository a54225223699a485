"""Benchmark decontamination with a generalised suffix automaton.

All normalised benchmark items go into one automaton over word ids. A document's words are streamed through
it, keeping the longest length matched so far; wherever that length reaches a window (13 words, or a whole
shorter item) the words of the window are hit. Words that no item has end every match, so only runs of known
words that are long enough for a window are streamed at all.

The automaton is built from blocks of at most ``BLOCK_WORDS`` benchmark words; each block is one broadcast of
bounded size, and the documents go through the blocks one after another. A benchmark has one block until it
is larger than that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import _base

WINDOW = 13
BLOCK_WORDS = 100_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z in lower case, every separator a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class SuffixAutomaton:
    """A generalised suffix automaton of word sequences; edges lie in one dictionary by (state, word)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.edges: dict[int, int] = {}
        self.length, self.link = [0], [-1]
        self._out: list[list[int]] = [[]]
        self.least = min([window, *(len(w) for _, w in items if w)])
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.names: dict[int, set[str]] = {}  # of the state that holds a window: the items that have it
        self.short: dict[int, list[tuple[int, str]]] = {}  # of a state: the whole short items that end there
        self.at = [-1] * len(self.length)  # of a state: the one on its suffix path that holds the last `window` words
        self.ends = [False] * len(self.length)  # whether a short item ends on the suffix path
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[s]
            self.at[s] = self.at[up] if self.length[up] >= window else s if self.length[s] >= window else -1
        for name, ids in coded:
            s = 0
            for n, c in enumerate(ids, 1):
                s = self.edges[s << 32 | c]
                if n >= window:
                    self.names.setdefault(self.at[s], set()).add(name)
            if len(ids) < window:
                while self.length[self.link[s]] >= len(ids):
                    s = self.link[s]
                self.short.setdefault(s, []).append((len(ids), name))
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.ends[s] = s in self.short or self.ends[self.link[s]]
        del self._out

    def _state(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self._out.append([])
        return len(self.length) - 1

    def _put(self, s: int, c: int, to: int) -> None:
        if s << 32 | c not in self.edges:
            self._out[s].append(c)
        self.edges[s << 32 | c] = to

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the words that end with ``c`` after ``p``, split off from ``q`` where ``q`` holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q])
        for x in self._out[q]:
            self._put(clone, x, self.edges[q << 32 | x])
        self.link[q] = clone
        while p >= 0 and self.edges.get(p << 32 | c) == q:
            self.edges[p << 32 | c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.edges.get(last << 32 | c)
        if q is not None:  # an earlier item goes the same way
            return self._split(last, c, q)
        new = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and p << 32 | c not in self.edges:
            self._put(p, c, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.edges[p << 32 | c])
        return new

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(first place, word ids) of the runs of known words that are long enough for a window."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.least:
                yield a, ids[a:b].tolist()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The hit spans of word places (end exclusive, merged, ascending) and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        edges, link, length = self.edges, self.link, self.length
        for first, ids in self.runs(words):
            s = n = 0
            for i, c in enumerate(ids, first + 1):
                while s and s << 32 | c not in edges:
                    s = link[s]
                    n = length[s]
                to = edges.get(s << 32 | c)
                if to is None:
                    continue
                s, n = to, n + 1
                reach = 0
                if n >= self.window:
                    reach = self.window
                    items |= self.names[self.at[s]]
                if self.ends[s]:
                    t = s
                    while t > 0:
                        for size, name in self.short.get(t, ()):
                            if size <= n:
                                reach = max(reach, size)
                                items.add(name)
                        t = link[t]
                if reach:
                    start = i - reach
                    while spans and spans[-1][0] >= start:
                        spans.pop()
                    if spans and spans[-1][1] >= start:
                        spans[-1] = (spans[-1][0], i)
                    else:
                        spans.append((start, i))
        return spans, items


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[SuffixAutomaton]:
    """One automaton for each block of items, read item by item; an item isn't split."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text").toLocalIterator():
        words = words_of((r[1] or "").encode())
        if not words:
            continue
        block.append((r[0], words))
        size += len(words)
        if size >= block_words:
            yield SuffixAutomaton(block, window)
            block, size = [], 0
    if block:
        yield SuffixAutomaton(block, window)


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS, into: str = "contamination") -> DataFrame:
    """``docs`` with a struct ``into``: n_words, n_hit, the items found (sorted) and the hit spans of word places.

    Null and empty texts have no words; items without words have no window; a null item id counts as "null".
    Repeated rows are scanned alike. A column already named ``into`` is replaced.
    """
    out = docs.drop(into)
    schema = _base.with_fields(out, **{into: SCAN})
    blocks = _blocks(docs.sparkSession, benchmark, window, block_words)
    for block in blocks[:-1]:
        out = _base.map_rows(out, _adder(block, into), schema)
    return _base.map_rows(out, _adder(blocks[-1], into), schema)


_KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])


def _blocks(spark: SparkSession, benchmark: DataFrame, window: int, block_words: int) -> list:
    """A broadcast for each block of the benchmark; None for an empty one."""
    return [spark.sparkContext.broadcast(a) for a in automata(benchmark, window, block_words)] or [None]


def _adder(block, into: str):
    """Makes what adds the scan by one block to a batch, together with what earlier blocks have found."""

    def make():
        machine = block.value if block is not None else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            had = batch.column(batch.schema.get_field_index(into)).to_pylist() if into in batch.schema.names else [None] * batch.num_rows
            rows = []
            for text, old in zip(_base.texts_of(batch, "text"), had, strict=True):
                words = words_of(text)
                spans, items = machine.scan(words) if machine else ([], set())
                if old:
                    spans = _merge(spans, [(s["first"], s["last"]) for s in old["spans"]])
                    items = items | set(old["items"])
                rows.append({"n_words": len(words), "n_hit": sum(b - a for a, b in spans), "items": sorted(items), "spans": [{"first": a, "last": b} for a, b in spans]})
            kept = batch.drop_columns([into]) if into in batch.schema.names else batch
            return kept.append_column(into, pa.array(rows, _KIND))

        return step

    return make


def is_contaminated(into: str = "contamination"):
    """Hit, and by at least a twentieth of the words."""
    return (F.col(f"{into}.n_hit") > 0) & (20 * F.col(f"{into}.n_hit") >= F.col(f"{into}.n_words"))


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of ``spans`` and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text.translate(_FOLD))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, min_span: int = WINDOW, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without contaminated documents; the others lose hit spans of ``min_span`` words or more.

    Documents without a hit stay byte for byte, null texts null; ``n_chars``, where there is one, follows the text. All
    columns stay, whatever their names. Repeated rows are treated alike. The last block's scan, the decision and the cut are one pass.
    """
    names, into = docs.columns, _base.fresh(docs, "contamination")
    blocks = _blocks(docs.sparkSession, benchmark, window, block_words)
    out = docs
    for block in blocks[:-1]:
        out = _base.map_rows(out, _adder(block, into), _base.with_fields(docs, **{into: SCAN}))

    def make():
        scan_batch = _adder(blocks[-1], into)()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            batch = scan_batch(batch)
            found = batch.column(batch.schema.get_field_index(into)).to_pylist()
            clean = [not (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"]) for r in found]
            batch = batch.select(names).filter(pa.array(clean))
            spans = [[(s["first"], s["last"]) for s in r["spans"] if s["last"] - s["first"] >= min_span] for r, ok in zip(found, clean, strict=True) if ok]
            if any(spans):
                at = names.index("text")
                texts = [cut(t.encode(), s).decode() if s else t for t, s in zip(batch.column(at).to_pylist(), spans, strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if "n_chars" in names:
                    at = names.index("n_chars")
                    sizes = [len(t) if s else n for t, s, n in zip(texts, spans, batch.column(at).to_pylist(), strict=True)]
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
            return batch

        return step

    return _base.map_rows(out, make, docs.schema)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.read(spark, sf_dir, "documents").select("doc_id", "text")
    c = scan(docs, _base.read(spark, sf_dir, "benchmark"))
    return c.select(
        "doc_id",
        "contamination.n_words",
        "contamination.n_hit",
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


