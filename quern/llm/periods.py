"""Periodic runs of words: block matching at every power of two, then exact extension.

A run with smallest period q, ``2^k <= q < 2^(k + 1)``, that holds four periods has within its first ``2^k`` words the start
of an aligned block of ``2^k`` words, and that block occurs again q words later inside the run. So for each scale the aligned
blocks of a document are the keys of an Aho-Corasick automaton over word numbers, the document is searched for them,
and every occurrence at a distance of ``2^k`` to ``2^(k + 1) - 1`` seeds an extension to both sides, which
compares words.

Two conditions save keys and lose no run. Each word of such a block occurs again less than ``2^(k + 1)`` words later, which few blocks
of prose meet. And a block that lies with all its seeds inside a run of a smaller period seeds nothing: two periods
of such a stretch have a common divisor as its period, so the seeded one is not the smallest.
"""

from __future__ import annotations

from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import _base

#: A run has this many periods and words at least.
PERIODS, WORDS = 4, 6
#: Words in the keys of one automaton (one key where a block is longer), so that memory doesn't follow a text's length.
KEY_WORDS = 1 << 17
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def number_words(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers, in order of appearance."""
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(names.__getitem__, words), np.int64, len(words))


def _gaps(ids: np.ndarray) -> np.ndarray:
    """How many words later each word occurs again; the text's length where it doesn't."""
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    out = np.full(len(ids), len(ids), np.int64)
    out[order[same]] = order[same + 1] - order[same]
    return out


def _equal_from(ids: np.ndarray, i: int, period: int) -> int:
    """The first place from ``i`` on whose word differs from that ``period`` later (or that has none)."""
    end, step = len(ids) - period, 64
    while i < end:
        to = min(end, i + step)
        differs = ids[i:to] != ids[i + period : to + period]
        at = int(differs.argmax())
        if differs[at]:
            return i + at
        i, step = to, step * 2
    return end


def _equal_to(ids: np.ndarray, i: int, period: int) -> int:
    """The least place from which all words before ``i`` equal those ``period`` later."""
    step = 64
    while i > 0:
        low = max(0, i - step)
        differs = (ids[low:i] != ids[low + period : i + period])[::-1]
        at = int(differs.argmax())
        if differs[at]:
            return i - at
        i, step = low, step * 2
    return 0


def _seeds(ids: np.ndarray, blocks: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(distance, place) of all occurrences of the ``blocks`` of ``size`` words at distances from ``size`` to ``2 * size - 1``."""
    out = []
    few = max(1, KEY_WORDS // size)
    for at in range(0, len(blocks), few):
        part = blocks[at : at + few].tolist()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        keys: dict[tuple[int, ...], int] = {}
        mine = []
        for p in part:
            key = tuple(ids[p : p + size].tolist())
            if key not in keys:
                keys[key] = len(keys)
                automaton.add_word(key, keys[key])
            mine.append(keys[key])
        automaton.make_automaton()
        places: list[list[int]] = [[] for _ in keys]
        low = high = part[0]
        for p in [*part, None]:  # blocks whose surroundings meet are searched in one go
            if p is None or p > high:
                if high > low:
                    for end, key in automaton.iter(tuple(ids[low:high].tolist())):
                        places[key].append(low + end + 1 - size)
                low = p
            if p is not None:
                high = min(len(ids), p + 3 * size)
        for p, key in zip(part, mine, strict=True):
            found = places[key]
            i = bisect_left(found, p + size)
            while i < len(found) and found[i] < p + 2 * size:
                out.append((found[i] - p, p))
                i += 1
    return sorted(out)


def _inside(starts: np.ndarray, ends: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of the stretches from ``starts`` to ``ends`` lie in one of ``runs``."""
    if not runs or not len(starts):
        return np.zeros(len(starts), bool)
    table = np.array(runs, np.int64)
    table = table[np.argsort(table[:, 0], kind="stable")]
    furthest = np.maximum.accumulate(table[:, 1])
    at = np.searchsorted(table[:, 0], starts, "right") - 1
    return (at >= 0) & (furthest[at] >= ends)


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run in a sequence of numbers, by start, then period."""
    n = len(ids)
    if n < WORDS:
        return []
    gaps = _gaps(ids)
    runs: list[tuple[int, int, int]] = []  # (start, end, period)
    size = 1
    while PERIODS * size <= n:
        whole = n // size * size
        blocks = np.flatnonzero((gaps[:whole] < 2 * size).reshape(-1, size).all(1)) * size
        blocks = blocks[~_inside(blocks, blocks + 3 * size - 1, runs)]
        seeds = _seeds(ids, blocks, size) if len(blocks) else []
        if seeds:
            table = np.array(seeds, np.int64)
            table = table[~_inside(table[:, 1], table.sum(1) + size, runs)]
            for period in np.unique(table[:, 0]).tolist():
                found = _extended(ids, table[table[:, 0] == period, 1].tolist(), period, size)
                if found:
                    ends = np.array(found, np.int64)
                    runs += [x for x, in_other in zip(found, _inside(ends[:, 0], ends[:, 1], runs).tolist(), strict=True) if not in_other]
        size *= 2
    return sorted((s, e - s, q) for s, e, q in runs)


def _extended(ids: np.ndarray, places: list[int], period: int, size: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the stretches of ``period``, long enough for a run, around blocks that occur again that much later."""
    out, start, end = [], 0, 0
    for p in places:
        if start <= p and p + size + period <= end:
            continue
        start, end = _equal_to(ids, p, period), _equal_from(ids, p + size, period) + period
        if end - start >= max(WORDS, PERIODS * period):
            out.append((start, end, period))
    return out


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()])


def mark_runs(docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with the periodic runs of ``text`` (array of start, length, period) and the text without their repeats.

    Words are what white space of ASCII parts; a run is a longest stretch of at least ``PERIODS`` times its smallest period and ``WORDS`` words, and
    only its first period stays. Null, empty and blank texts have no runs and collapse to an empty text. A text of any length is taken
    whole by one task, with automata of bounded size. Repeated rows get equal results, an empty table gives an empty one. Columns named
    ``runs`` or ``collapsed``, whatever the case, are replaced; others stay.
    """
    docs = docs.drop(runs, collapsed)
    schema = _base.with_fields(docs, **{runs: RUNS, collapsed: T.StringType()})

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, texts = [], []
        for t in _base.texts_of(batch, text):
            words = t.split()
            here = find_runs(number_words(words))
            found.append([{"start": s, "length": n, "period": q} for s, n, q in here])
            texts.append(_collapsed(words, here))
        item = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        return batch.append_column(runs, pa.array(found, item)).append_column(collapsed, pa.array(texts, pa.binary()).cast(pa.string()))

    return _base.map_rows(docs, lambda: step, schema)


def planted(doc_id: Column, text: Column) -> Column:
    """The words of ``text``, in a tenth of the documents repeated with a period from some word on, both by the id's crc32; null as empty."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h, n = F.crc32(_base.id_text(doc_id).cast("binary")), F.size(words).cast("long")
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a.cast("int") + 1, p.cast("int")), F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), " ")).otherwise(F.coalesce(text, F.lit("")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _base.read(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    rows = mark_runs(docs)
    over = lambda x, y: F.coalesce(x["length"] * y["period"], F.lit(0)) > F.coalesce(y["length"] * x["period"], F.lit(-1))
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda top, x: F.when(over(x, top), x).otherwise(top))  # runs come by start, then period
    line = F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), sha(F.array_join(line, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))
    top = F.col("best")
    return rows.select(
        "doc_id", "n_runs", top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.floor(1000 * top["length"] / top["period"]).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
