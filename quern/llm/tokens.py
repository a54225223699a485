"""Tokenising and a bit-packed file format for token ids.

The pre-tokenizer of the vocabulary drops white space, so no token reaches over it: a text's ids are those of
its white-space-separated chunks in order. Each worker keeps the ids of chunks that the library has encoded,
within a fixed number of entries, and hands only new ones to it.

File format (little-endian): a header, the documents' ids and their places, the blocks' byte offsets, then the
blocks. A block holds ``BLOCK`` ids in the fewest bits that hold the vocabulary's largest id, so any range of ids
is read by unpacking the blocks that it touches with numpy. Spark writes the files as the ``file`` column of a
Parquet table, because only Spark's own writers reach every shared store.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator
from itertools import compress

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import _base
from quern.llm._text import LOWER, blocks, hash_words, windows

VOCABULARY = "word_bpe_49k.json"
END = 1
BLOCK = 4096
#: A file is closed once it has so many ids; a longer document makes a longer file.
FILE_IDS = 1 << 20
_CACHED = 400_000
_TOGETHER = 1 << 20
_STEP = 512
#: Longer chunks are encoded wherever they stand and never kept.
_LONGEST = 64
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_HEADER = struct.Struct("<4sHHIQQQ")
_MAGIC = b"QTID"


class Recent:
    """The ids of up to ``size`` recently used byte strings of at most ``_LONGEST`` bytes, in arrays: about seventy bytes for each.

    A string is found by its hash and compared by its bytes. When the arrays are full, the half that was used
    longer ago goes.
    """

    FIELDS = ("keys", "length", "used", "at", "place", "count")

    def __init__(self, size: int):
        self.size, self.now = size, 0
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.length, self.used = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.at, self.text = np.zeros(0, np.int64), np.zeros(0, np.uint64)  # where a string's blocks are, and all of these
        self.place, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def find(self, found: "Strings") -> np.ndarray:
        """The place of each string, -1 where it isn't known; what is found counts as used."""
        self.now += 1
        at = np.full(len(found.keys), -1)
        if not len(self.keys) or not len(at):
            return at
        near = np.searchsorted(self.keys, found.keys)
        near[near == len(self.keys)] = 0
        maybe = np.flatnonzero((self.keys[near] == found.keys) & (self.length[near] == found.length))
        near = near[maybe]
        cells, n = blocks(found.view, found.start[maybe], found.length[maybe])
        known = ~_any(cells != self.text[_runs(self.at[near], n)], n)
        at[maybe[known]] = near[known]
        self.used[near[known]] = self.now
        return at

    def add(self, found: "Strings", new: np.ndarray, ids: list[bytes]) -> None:
        """Put the strings at the places ``new``, which aren't known; one whose hash another has takes its place."""
        short = np.flatnonzero(found.length[new] <= _LONGEST)
        ids, new = [ids[i] for i in short.tolist()], new[short]
        if len(self.keys) + len(new) > self.size:
            self._thin()
        count = np.array([len(x) // 4 for x in ids], np.int32)
        place = len(self.ids) + np.cumsum(count, dtype=np.int64) - count
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), "<u4")])
        cells, n = blocks(found.view, found.start[new], found.length[new])
        at = len(self.text) + np.cumsum(n) - n
        self.text = np.concatenate([self.text, cells])
        order = np.argsort(found.keys[new])
        keys = found.keys[new][order]
        if len(self.keys):
            taken = np.searchsorted(self.keys, keys)
            taken[taken == len(self.keys)] = 0
            self._keep(~np.isin(np.arange(len(self.keys)), taken[self.keys[taken] == keys]))
        to = np.searchsorted(self.keys, keys)
        for name, x in zip(self.FIELDS, (keys, found.length[new][order], np.full(len(keys), self.now, np.int32), at[order], place[order], count[order]), strict=True):
            setattr(self, name, np.insert(getattr(self, name), to, x))

    def _keep(self, kept: np.ndarray) -> None:
        if not kept.all():
            for name in self.FIELDS:
                setattr(self, name, getattr(self, name)[kept])

    def _thin(self) -> None:
        self._keep(self.used >= min(np.median(self.used) + 1, self.now) if len(self.used) else np.zeros(0, bool))
        self.ids, n = self.ids[_runs(self.place, self.count)], (self.length + 7) // 8
        self.text = self.text[_runs(self.at, n)]
        self.place, self.at = (np.cumsum(x, dtype=np.int64) - x for x in (self.count, n))

    def ids_of(self, found: "Strings", learn) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings one after another, and each one's number of ids; ``learn`` gives those of new ones (by their places)."""
        at = self.find(found)
        hit, new = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        fresh = learn(new)
        count, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[hit], count[new] = self.count[at[hit]], [len(x) // 4 for x in fresh]
        both = np.concatenate([hit, new])
        start[both] = np.cumsum(count[both]) - count[both]
        ids = np.concatenate([self.ids[_runs(self.place[at[hit]], self.count[at[hit]])], np.frombuffer(b"".join(fresh), "<u4")])
        self.add(found, new, fresh)
        return ids[_runs(start, count)], count


def _any(flags: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether any flag is set in each run of ``n`` (at least one) of them."""
    return np.logical_or.reduceat(flags, np.cumsum(n) - n) if len(n) else np.zeros(0, bool)


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all runs of ``size`` from ``start``, one after another."""
    past = np.cumsum(size, dtype=np.int64)
    return np.repeat(start - (past - size), size) + np.arange(past[-1] if len(past) else 0)


class Strings:
    """The different white-space-separated strings of ``buf`` (hash, start and length), and of each one there (from ``starts``) which it is.

    ``exact`` is false if two different strings have one hash.
    """

    def __init__(self, buf: bytes):
        self.starts, ends, hashes = hash_words(buf)
        self.keys, at, self.which = np.unique(hashes, return_index=True, return_inverse=True)
        size = ends - self.starts
        self.view, self.start, self.length = windows(buf), self.starts[at], size[at].astype(np.int32)
        self.exact = bool((size == self.length[self.which]).all())
        for a in range(0, len(size) if self.exact else 0, 1 << 16):
            part = slice(a, a + (1 << 16))
            own, _ = blocks(self.view, self.starts[part], size[part])
            first, _ = blocks(self.view, self.start[self.which[part]], size[part])
            self.exact = self.exact and bool((own == first).all())


#: Characters whose lower case or composed form is longer; their tokens may hang on what stands next to them.
_LONGER = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x30000)) if not "\ud800" <= c <= "\udfff" and (len(c.lower()) > 1 or len(unicodedata.normalize("NFC", c)) > 1)) + "]")


class Encoder:
    """Encodes UTF-8 texts to arrays of little-endian unsigned 32-bit ids; memory is bounded by ``_CACHED`` chunks and words.

    A chunk of letters and ASCII punctuation after them is two pre-tokens, looked up on their own; any other
    chunk is encoded as it stands. New words go to the library in one text, and the mark that the vocabulary
    puts on a word's last token parts their ids again. A text with a character of ``_LONGER`` is encoded as a whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.chunks, self.words = Recent(_CACHED), Recent(_CACHED)
        self.marks: dict[str, bytes] = {}
        self.ends = np.zeros(self.vocabulary, bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True

    @property
    def vocabulary(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _pieces(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, each encoded as a text of its own."""
        out: list[bytes] = []
        for at in range(0, len(chunks), 4096):
            part = chunks[at : at + 4096]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ends = (np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1)) * 4).tolist()
            raw = np.array(e.ids, "<u4").tobytes()
            out += [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def _letters(self, words: list[str]) -> list[bytes]:
        """The same for words of letters, in one text where each gives one pre-token."""
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = [0, *((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()]
            if len(ends) == len(part) + 1:
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            else:
                out += self._pieces(part)
        return out

    def _of_words(self, words: list[str]) -> list[bytes]:
        """The ids of ``words`` of letters."""
        if not words:
            return []
        found = Strings("\n".join(words).encode())
        if not found.exact:
            return self._pieces(words)
        one = np.zeros(len(found.keys), np.int64)
        one[found.which] = np.arange(len(words))
        ids, count = self.words.ids_of(found, lambda new: self._letters([words[i] for i in one[new].tolist()]))
        raw, ends = ids.tobytes(), (np.concatenate([[0], np.cumsum(count)]) * 4).tolist()
        out = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return [out[i] for i in found.which.tolist()]

    def _learn(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of new ``chunks``."""
        if not chunks:
            return []
        lows = b"\n".join(chunks).translate(LOWER).decode().split("\n")
        heads = [x.rstrip(_PUNCTUATION) for x in lows]
        alone = [x.isalpha() for x in heads]
        simple, lows, heads = [list(compress(x, alone)) for x in (range(len(chunks)), lows, heads)]
        tails = [x[len(h) :] for x, h in zip(lows, heads, strict=True)]
        if len(self.marks) > 10_000:
            self.marks.clear()
        left = list(set(tails).difference(self.marks))
        self.marks.update(zip(left, self._pieces(left), strict=True))
        out = [b""] * len(chunks)
        for i, x, t in zip(simple, self._of_words(heads), tails, strict=True):
            out[i] = x + self.marks[t]
        other = [i for i, ok in enumerate(alone) if not ok]
        for i, x in zip(other, self._pieces([chunks[i].decode() for i in other]), strict=True):
            out[i] = x
        return out

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, without special tokens added; about a megabyte of texts are looked up together."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= _TOGETHER:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[bytes]) -> Iterator[bytes]:
        whole = {i: t.decode() for i, t in enumerate(texts) if not t.isascii()}
        whole = {i: t for i, t in whole.items() if _LONGER.search(t)}
        buf = b" ".join([b"" if i in whole else t for i, t in enumerate(texts)] if whole else texts)
        found = Strings(buf)
        if not found.exact:  # two strings with one hash
            for t in texts:
                yield np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()
            return
        cut = lambda new: [buf[a:b] for a, b in zip(found.start[new].tolist(), (found.start[new] + found.length[new]).tolist(), strict=True)]
        ids, count = self.chunks.ids_of(found, lambda new: self._learn(cut(new)))
        place = np.cumsum(count) - count
        count = count[found.which]
        ids = ids[_runs(place[found.which], count)]
        past = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        text_ends = np.cumsum([(0 if i in whole else len(t)) + 1 for i, t in enumerate(texts)]) if texts else np.zeros(0, np.int64)
        cuts = [0, *past[np.searchsorted(found.starts, text_ends)].tolist()]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if i in whole:
                yield np.array(self.tokenizer.encode(whole[i], add_special_tokens=False).ids, "<u4").tobytes()
            else:
                yield ids[a:b].tobytes()


def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept while its tasks use the same vocabulary."""
    return _base.cached(("encoder", path), lambda: Encoder(path))


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    table = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (table.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_file(docs: list[tuple[int | None, bytes]], vocabulary: int) -> bytes:
    """The bytes of a file of (doc_id, ids as unsigned 32-bit integers)."""
    bits = max(1, int(vocabulary - 1).bit_length())
    ids = np.frombuffer(b"".join([d[1] for d in docs]), "<u4")
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    names = np.array([d[0] or 0 for d in docs], "<i8").tobytes() + np.array([d[0] is None for d in docs], np.uint8).tobytes()
    places = np.concatenate([[0], np.cumsum([len(d[1]) // 4 for d in docs])]).astype("<u8").tobytes()
    first = _HEADER.size + len(names) + len(places) + 8 * (len(blocks) + 1)
    offsets = (first + np.concatenate([[0], np.cumsum([len(b) for b in blocks])])).astype("<u8").tobytes()
    return b"".join([_HEADER.pack(_MAGIC, 1, bits, BLOCK, len(ids), len(docs), len(blocks)), names, places, offsets, *blocks])


class TokenFile:
    """Reads a file's bytes; ``ids(a, b)`` unpacks no more than the blocks that the range touches."""

    def __init__(self, raw: bytes):
        magic, version, self.bits, self.block, self.n_ids, self.n_docs, blocks = _HEADER.unpack_from(raw)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a token file")
        at, self.raw = _HEADER.size, raw
        names = np.frombuffer(raw, "<i8", self.n_docs, at)
        null = np.frombuffer(raw, np.uint8, self.n_docs, at + 8 * self.n_docs)
        at += 9 * self.n_docs
        self.doc_ids = [None if z else n for n, z in zip(names.tolist(), null.tolist(), strict=True)]
        self.places = np.frombuffer(raw, "<u8", self.n_docs + 1, at).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, at + 8 * (self.n_docs + 1)).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        parts = [unpack(self.raw[self.offsets[i] : self.offsets[i + 1]], self.bits, min(self.block, self.n_ids - i * self.block)) for i in range(a, b)]
        return np.concatenate(parts)[start - a * self.block : stop - a * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.places[i]), int(self.places[i + 1]))


def encode(docs: DataFrame, path: str, *, end: int | None = END) -> DataFrame:
    """(doc_id, ids): ids as little-endian unsigned 32-bit integers, with the end id; null texts as empty."""
    tail = b"" if end is None else struct.pack("<I", end)

    def make():
        own = encoder(path)
        return lambda batch: pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array([x + tail for x in own.encode(_base.texts_of(batch, "text"))], pa.binary())], ["doc_id", "ids"])

    return _base.map_rows(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, ids binary", keeps=True)


def write_tokens(docs: DataFrame, path: str, folder: str, *, end: int | None = END, file_ids: int = FILE_IDS) -> None:
    """Write the ids of ``docs`` to ``folder`` as token files, in ascending doc_id order (null first).

    Rows of one doc_id stand side by side. The table has a row for each file: its shard, its number in the
    shard, its numbers of documents and ids, and its bytes. An empty table makes no file.
    """
    tail = b"" if end is None else struct.pack("<I", end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard, number = encoder(path), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, number
            n = sum(len(d[1]) for d in held) // 4
            row = pa.RecordBatch.from_pydict({"shard": [shard], "number": [number], "n_docs": [len(held)], "n_ids": [n], "file": [write_file(held, own.vocabulary)]})
            held, size, number = [], 0, number + 1
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, _STEP):
                part = batch.slice(at, _STEP)
                for i, ids in zip(part.column(0).to_pylist(), own.encode(_base.texts_of(part, "text")), strict=True):
                    held.append((i, ids + tail))
                    size += len(ids) // 4 + 1
                    if size >= file_ids:
                        yield close()
        if held:
            yield close()
        _base.trim()

    placed = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    placed.mapInArrow(run, "shard long, number long, n_docs long, n_ids long, file binary").write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the files of ``folder``; start counts the ids of all documents before it.

    A start needs the number of ids in the shards before, so one number for each shard comes to the driver.
    """
    files = spark.read.parquet(folder)
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before = dict(zip([r["shard"] for r in sizes], np.cumsum([0] + [r["n"] for r in sizes]).tolist(), strict=False))
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "shard long, shard_start long")
    order = files.select("shard", "number", "n_ids").withColumn(
        "in_shard", F.expr("sum(n_ids) over (partition by shard order by number rows between unbounded preceding and 1 preceding)")
    )
    located = order.join(F.broadcast(starts), "shard").select("shard", "number", (F.col("shard_start") + F.coalesce("in_shard", F.lit(0))).alias("file_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                f = TokenFile(raw.as_py())
                for at in range(0, f.n_docs, 4 * _STEP):
                    to = min(f.n_docs, at + 4 * _STEP)
                    a = int(f.places[at])
                    ids = f.ids(a, int(f.places[to]))
                    cuts = (f.places[at : to + 1] - a).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids[at:to], pa.int64()), pa.array((f.places[at:to] + first).tolist(), pa.int64()), pa.array([ids[x:y].astype("<u4").tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())],
                        ["doc_id", "start", "ids"],
                    )

    return files.select("shard", "number", "file").join(F.broadcast(located), ["shard", "number"]).select("file_start", "file").mapInArrow(run, "doc_id long, start long, ids binary")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _base.new_folder(spark, "tokens")
    write_tokens(_base.read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), folder)
    return read_tokens(spark, folder).select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
