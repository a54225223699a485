"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds its distinct five-word shingles (64-bit hashes). Documents with the same set are one
from the start. For the others, ``TREES`` independent trees branch on minwise tokens: a node picks, by a hash of
its path, one or two of the ``COORDINATES`` minwise tokens (``1 / threshold`` on average) and sends a document to the
child of each token picked. Nodes of up to ``SMALL`` documents are compared exhaustively; larger ones branch
again. What is still large at ``DEPTH`` holds one family of near copies, most of which are connected by then, so
only documents outside the node's main component are compared with the others.

Comparing uses one byte of each minwise token and over-links by four and a half standard errors. The clusters
found so are then settled on the full sets: within a block of a cluster and between it and the first block all
pairs are decided; after that, each document outside the cluster's main component is held against every
document of the cluster. A pair is passed over only if its two documents are connected already, so no component
is lost, and no task holds more than two blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import _base
from quern.llm._text import mix, shingle_sets
from quern.llm.components import Forest, components

COORDINATES = 64
TREES = 14
DEPTH = 3
SMALL = 200
THRESHOLD = 75
#: Up to so many rows of ids are broadcast, so that texts need no shuffle; more are joined by shuffling.
BROADCAST_ROWS = 300_000
_FACTORS = mix(np.arange(11, 11 + COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Shingles that a block holds on average, so that few long texts fill one.
BLOCK_SHINGLES = 4_000_000


def signature(s: np.ndarray) -> np.ndarray:
    """The least hash of the set in each coordinate, upper 32 bits."""
    least = np.full(COORDINATES, ~np.uint64(0))
    for at in range(0, len(s), 4096):
        least = np.minimum(least, np.multiply.outer(s[at : at + 4096], _FACTORS).min(0))
    return (least >> np.uint64(32)).astype("<u4")


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.astype("<u8").tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _signed(docs: DataFrame, keys: list[str], width: int) -> DataFrame:
    rows = docs.select(*[F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)], F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(n, T.LongType()) for n in ("n_shingles", "fp_a", "fp_b")], T.StructField("sig", T.BinaryType())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(_base.texts_of(batch, "text"), width)
        prints = [_fingerprint(s) if len(s) else (0, 0) for s in sets]
        more = [pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], schema.names)

    return _base.map_rows(rows, lambda: step, schema)


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, COORDINATES)


def _children(paths: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) for each token that a row's node picks: always one, a second with probability 1 / threshold - 1."""
    rows = np.arange(len(paths))
    draw = mix(paths ^ np.uint64(0x5851F42D4C957F2D))
    first = (draw % np.uint64(COORDINATES)).astype(np.int64)
    second = (first + 1 + ((draw >> np.uint64(8)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    two = (draw >> np.uint64(40)) % np.uint64(THRESHOLD) < np.uint64(100 - THRESHOLD)
    rows, picked = np.concatenate([rows, rows[two]]), np.concatenate([first, second[two]])
    token = sigs[rows, picked].astype(np.uint64) | (picked.astype(np.uint64) << np.uint64(32))
    return rows, mix(paths[rows] * np.uint64(0xD1342543DE82EF95) ^ mix(token))


def _roots(reps: DataFrame) -> DataFrame:
    """(node, rep) at depth 1 of all trees."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sigs = batch.column(0).to_numpy(zero_copy_only=False), _sigs(batch.column(1))
        nodes, owners = [], []
        for tree in range(TREES):
            rows, paths = _children(np.full(len(ids), mix(np.array([tree + 1], np.uint64))[0]), sigs)
            nodes.append(paths)
            owners.append(ids[rows])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), pa.array(np.concatenate(owners))], ["node", "rep"])

    return _base.map_rows(reps.select("rep", "sig"), lambda: step, "node long, rep long")


def _branch(large: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, rep) one level below the nodes of ``large``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, paths = _children(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), _sigs(batch.column(2)))
        return pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(batch.column(1).to_numpy(zero_copy_only=False)[rows])], ["node", "rep"])

    return _base.map_rows(large.select("node", "rep").join(reps.select("rep", "sig"), "rep").select("node", "rep", "sig"), lambda: step, "node long, rep long")


def _blocks(rows: DataFrame, key: str, payload: list[str], count: str = "c", size: int = SMALL) -> DataFrame:
    """``rows`` gathered in blocks of about ``size``: (key, block, members); a row's block follows from its rep alone."""
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col(count) / size))
    return rows.withColumn("block", block).groupBy(key, "block").agg(F.collect_list(F.struct("rep", *payload)).alias("members"))


def _sketch_links(a: list[dict], b: list[dict] | None, threshold: int = THRESHOLD, least: int = COORDINATES // 2) -> Iterator[tuple[int, int]]:
    """A forest over the pairs that may be similar: within ``a``, or between ``a`` and ``b`` where labels differ."""
    forest = Forest()
    other = a if b is None else b
    left = np.frombuffer(b"".join([x["sig"] for x in a]), "<u4").reshape(-1, COORDINATES).astype(np.uint8)
    right = left if b is None else np.frombuffer(b"".join([x["sig"] for x in other]), "<u4").reshape(-1, COORDINATES).astype(np.uint8)
    n_left, n_right = np.array([x["n"] for x in a]), np.array([x["n"] for x in other])
    labels = None if b is None else (np.array([x["label"] for x in a]), np.array([x["label"] for x in other]))
    for i, x in enumerate(a):
        from_ = i + 1 if b is None else 0
        near = (right[from_:] == left[i]).sum(1) >= least
        near &= 100 * np.minimum(n_right[from_:], n_left[i]) >= threshold * np.maximum(n_right[from_:], n_left[i])
        if labels is not None:
            near &= labels[1][from_:] != labels[0][i]
        for j in np.flatnonzero(near).tolist():
            y = other[from_ + j]
            if labels is None:
                if forest.join(x["rep"], y["rep"]):
                    yield x["rep"], y["rep"]
            elif forest.join(x["label"], y["label"]):
                yield x["rep"], y["rep"]


def _pairs_map(rows: DataFrame, links, schema: str = "a long, b long") -> DataFrame:
    """``links`` over each row's members and, if there, others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            two = "others" in batch.schema.names
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                a = batch.column(batch.schema.get_field_index("members"))[i].as_py()
                b = (batch.column(batch.schema.get_field_index("others"))[i].as_py() or []) if two else None
                found.extend(links(a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, schema)


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the label of their rep: its root, or itself."""
    return rows.join(roots.select(F.col("member").alias("rep"), "root"), "rep", "left").withColumn("label", F.coalesce("root", "rep")).drop("root")


def _main_label(rows: DataFrame, key: str) -> DataFrame:
    """(key, main): the label that most rows of a key have, the least of these."""
    sizes = rows.groupBy(key, "label").agg(F.count("*").alias("n"))
    return sizes.groupBy(key).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"))


def _outsiders(rows: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """Blocks of the rows whose label isn't their key's main one, beside every block of the key: (members, others)."""
    mains = _base.keep(_main_label(rows, key), "mains")
    hint = F.broadcast if mains.count() <= BROADCAST_ROWS else lambda d: d  # a row for each key; rows needn't meet by key then
    mixed = rows.join(hint(mains), key)
    odd = mixed.where(F.col("label") != F.col("main"))
    counts = odd.groupBy(key).agg(F.count("*").alias("odd_c"))
    small = _blocks(odd.join(hint(counts), key), key, payload, "odd_c").select(key, "members")
    every = _blocks(mixed.join(hint(counts.select(key)), key, "left_semi"), key, payload).select(key, F.col("members").alias("others"))
    return small.join(every, key).select("members", "others")


def _set_links(a: list[dict], b: list[dict] | None, threshold: int = THRESHOLD) -> Iterator[tuple[int, int]]:
    """A forest of exact links. Without labels: over all members of both; with labels: between different ones of either.

    A breadth-first walk: each document reached is counted against all that aren't, by an inverted index.
    """
    labelled = bool(a) and a[0]["label"] is not None
    docs = {x["rep"]: x for x in [*a, *(b or [])]}
    reps = list(docs)
    at = {r: i for i, r in enumerate(reps)}
    sets = [np.frombuffer(docs[r]["shingles"], "<u8") for r in reps]
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]

    def linked(i: int) -> np.ndarray:
        lo, hi = np.searchsorted(tokens, sets[i], "left"), np.searchsorted(tokens, sets[i], "right")
        span = hi - lo
        total = int(span.sum())
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(span)[:-1]]), span) + np.arange(total)
        both = np.bincount(owner[where], minlength=len(sets))
        return 100 * both >= threshold * (sizes + sizes[i] - both)

    if labelled:
        forest = Forest()
        for x in a:
            for j in np.flatnonzero(linked(at[x["rep"]])).tolist():
                y = docs[reps[j]]
                if y["label"] != x["label"] and forest.join(x["label"], y["label"]):
                    yield x["rep"], y["rep"]
        return
    left = np.ones(len(sets), bool)
    for first in range(len(sets)):
        queue = [first] if left[first] else []
        left[first] = False
        while queue and left.any():
            i = queue.pop()
            for j in np.flatnonzero(linked(i) & left).tolist():
                left[j] = False
                queue.append(j)
                yield reps[i], reps[j]


def _cluster_sets(docs: DataFrame, reps: DataFrame, clusters: DataFrame, width: int) -> DataFrame:
    """(cluster, c, rep, shingles) of every document in ``clusters``, from the whole texts."""
    named = clusters.join(reps.select("rep", "name", "n_shingles", "fp_a", "fp_b"), "rep")
    # a cluster of few long texts counts as one of more texts, as blocks follow the count
    size = named.groupBy("cluster").agg(F.greatest(F.count("*"), F.ceil(F.sum("n_shingles") * F.lit(SMALL) / F.lit(BLOCK_SHINGLES))).alias("c"))
    wanted = named.drop("n_shingles").join(size, "cluster")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(_base.texts_of(batch, "text"), width)
        fits = pa.array([_fingerprint(s) == p if len(s) else False for s, p in zip(sets, zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True), strict=True)])
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["cluster", "c", "rep", "shingles"])
        return out.filter(fits)

    wanted = _base.keep(wanted, "wanted")
    small = wanted.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").cast("long").alias("name"), "text").join(F.broadcast(wanted) if small else wanted, "name")
    sets = _base.keep(_base.map_rows(texts.select("cluster", "c", "rep", "fp_a", "fp_b", "text"), lambda: step, "cluster long, c long, rep long, shingles binary"), "sets")
    _base.drop(wanted)
    return sets


def _candidates(reps: DataFrame) -> DataFrame:
    """(rep, cluster) of the documents that may be similar to another, by the trees."""
    nodes = _roots(reps)
    near, kept = [], []
    for depth in range(1, DEPTH + 1):
        # counts are a table of their own, so that Spark can split a node with very many documents in the join
        shared = _base.keep(nodes.groupBy("node").agg(F.count("*").alias("c")).where("c > 1"), "counts")
        counted = _base.keep(nodes.join(shared, "node"), "nodes")
        kept += [shared, counted]
        near.append(counted.where(F.col("c") <= SMALL).select("node", "rep"))
        large = counted.where(F.col("c") > SMALL)
        dense = not large.isEmpty()
        if depth == DEPTH or not dense:
            break
        nodes = _branch(large, reps)
    payload = reps.select("rep", F.col("n_shingles").alias("n"), "sig")
    gathered = reduce(DataFrame.unionByName, near).join(payload, "rep").groupBy("node").agg(F.collect_list(F.struct("rep", "n", "sig")).alias("members"))
    edges = _base.keep(_pairs_map(gathered.select("members"), _sketch_links), "links")
    roots = components(edges)
    if dense:
        rows = _base.keep(_labelled(large, roots).join(payload, "rep"), "dense")
        more = components(edges.unionByName(_pairs_map(_outsiders(rows, "node", ["n", "sig", "label"]), _sketch_links)))
        _base.drop(rows, roots)
        roots = more
    clusters = _clusters(roots)
    _base.drop(edges, roots, *kept)
    return clusters


def _clusters(roots: DataFrame) -> DataFrame:
    """(rep, cluster) of every vertex, from what ``components`` returns."""
    every = roots.select(F.col("member").alias("rep"), F.col("root").alias("cluster")).unionByName(roots.select(F.col("root").alias("rep"), F.col("root").alias("cluster")).distinct())
    return _base.keep(every, "clusters")


def near_duplicates(docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text).

    With ``keys``, these come first, and a number of the component follows, which tells components of rows that share an id apart.

    Null and empty texts have no shingle and are alone. Rows with the same set are one class, whatever their
    ids; rows of one id with different sets are in different classes. A row without id belongs to its class, but makes
    no links of its own; alone, its component is null and it is kept. Repeated rows get the same result. A text of any length is taken whole;
    blocks hold fewer of longer texts. Columns that aren't keys aren't kept, whatever their names.
    """
    return linked(docs, keys or [], _candidates, 5, THRESHOLD)


def linked(docs: DataFrame, keys: list[str], candidates: Callable[[DataFrame], DataFrame], width: int, threshold: int) -> DataFrame:
    """The rows of ``near_duplicates`` for shingles of ``width`` words linked at ``threshold`` percent.

    ``candidates`` gives, of the documents that differ (rep, name, n_shingles, fp_a, fp_b, sig), the clusters (rep, cluster) outside which there is no link.
    """
    signed = _base.keep(_signed(docs, keys, width), "signed")
    named = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = named.groupBy("n_shingles", "fp_a", "fp_b").agg(F.min("doc_id").alias("name"), F.first("sig").alias("sig"))
    reps = _base.keep(classes.withColumn("rep", F.monotonically_increasing_id()), "reps")
    clusters = candidates(reps)
    sets = _cluster_sets(docs, reps, clusters, width)
    links_of = partial(_set_links, threshold=threshold)
    blocks = _base.keep(_blocks(sets.withColumn("label", F.lit(None).cast("long")), "cluster", ["shingles", "label"]), "blocks")
    first = blocks.where(F.col("block") == 0).select("cluster", F.col("members").alias("others"))
    links = _base.keep(_pairs_map(blocks.join(first, "cluster", "left").select("members", F.when(F.col("block") > 0, F.col("others")).alias("others")), links_of), "links")
    wide = sets.where(F.col("c") > SMALL)
    if not wide.isEmpty():
        known = components(links)
        labelled = _base.keep(_labelled(wide, known), "wide")
        more = _pairs_map(_outsiders(labelled, "cluster", ["shingles", "label"]), links_of)
        roots = components(links.unionByName(more))
        _base.drop(known, labelled)
    else:
        roots = components(links)
    _base.drop(clusters, sets, blocks, links)
    members = reps.join(roots.select(F.col("member").alias("rep"), "root"), "rep", "left").withColumn("class", F.coalesce("root", "rep"))
    members = members.join(members.groupBy("class").agg(F.min("name").alias("component_id")), "class")
    full = signed.where("n_shingles > 0").join(members.select("n_shingles", "fp_a", "fp_b", "component_id", F.col("class").alias("class_id")), ["n_shingles", "fp_a", "fp_b"], "left")
    empty = signed.where("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("class_id", F.lit(None).cast("long"))
    out = full.unionByName(empty)
    return out.select(*[F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)], "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *(["class_id"] if keys else []))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_base.read(spark, sf_dir, "documents"))
