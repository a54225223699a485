"""Jaccard join on word n-grams by PartEnum signatures.

Two sets of sizes up to r with a Jaccard similarity of at least t differ in no more than k = 2r(1 - t) / (1 + t)
elements. Sizes are cut into bands, and a set takes part in every band in which it may be a partner, so linked sets
share one. A band deals the domain of all elements into groups, and each group into ``PARTS`` partitions; there are more groups than k / 2, so
in some group two linked sets differ by one element at most, that is in one partition at most. A signature
is a hash of what a set has in a group outside one of its partitions, for each partition in turn; linked sets share one at least.

An empty signature would be shared by nearly all small sets, so it isn't given. It could be all that two sets have in common in a group only
where both have elements in one partition at most. A band has ``slack`` more groups than needed, and a set with more such thin groups than
that also takes part in a further level, which deals the elements anew. Two linked sets with too many thin groups in common are
both there. The last level gives empty signatures too, so no link is lost.

Sets that share a signature are compared by minwise sketches (a linked pair passes with odds of 1 - 3e-10), first with the least of the
signature's sets, then, where a signature's sets aren't in one cluster yet, with all of them that are in others. Clusters are settled on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import _base, neardup
from quern.llm._text import mix, shingle_sets
from quern.llm.components import components

WIDTH = 4
THRESHOLD = 85
#: Partitions of a group; a signature leaves one out.
PARTS = 3
#: Levels that deal the elements in different ways.
LEVELS = 6
#: Minwise tokens of 64 that a pair must share to be compared on full sets; at 85 % it shares fewer with odds of 3e-10.
LEAST = 34
_ODD = 0x9E3779B97F4A7C15


def bands(most: int, threshold: int = THRESHOLD) -> list[tuple[int, int, int]]:
    """(smallest partner, largest size, differences) of each band, up to that of sets of ``most`` elements."""
    out, low = [], -(-100 // (100 - threshold))  # smaller sets are linked only where equal
    while low <= most * 100 // threshold + 1:
        high = low + low // 2
        out.append((-(-threshold * low // 100), high, 2 * high * (100 - threshold) // (100 + threshold)))
        low = high + 1
    return out


def groups(differences: int) -> tuple[int, int]:
    """(groups, slack) of a band: with ``slack`` groups left out, two sets agree but for one element at most in one of the others."""
    needed = differences // 2 + 1
    slack = 0 if needed < 3 else 2 + needed // 12
    return needed + slack, slack


def signatures(sets: list[np.ndarray], threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(place of the set, signature) of all ``sets`` of 64-bit hashes."""
    size = np.array([len(s) for s in sets], np.int64)
    owners, found = [], []
    for number, (low, high, differences) in enumerate(bands(int(size.max(initial=0)), threshold)):
        here = np.flatnonzero((size >= low) & (size <= high))
        n, slack = groups(differences)
        for level in range(LEVELS):
            if not len(here):
                break
            last = level == LEVELS - 1
            seed = mix(np.array([number * LEVELS + level + 1], np.uint64) * np.uint64(_ODD))[0]
            again = []
            for at in range(0, len(here), 64):
                part = here[at : at + 64]
                owner, signature, thin = _level([sets[i] for i in part], n, seed, last)
                owners.append(part[owner])
                found.append(signature)
                again.append(part[thin > slack])
            here = np.concatenate(again)
    return np.concatenate([*owners, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.uint64)])


def _level(sets: list[np.ndarray], n: int, seed: np.uint64, last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, signature) of all sets at one level of a band, and of each set the number of thin groups."""
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    drawn = mix(tokens ^ seed)
    cell = owner * (n * PARTS) + ((drawn >> np.uint64(32)) * np.uint64(n * PARTS) >> np.uint64(32)).astype(np.int64)
    shape = (len(sets), n, PARTS)
    held = np.bincount(cell, minlength=len(sets) * n * PARTS).reshape(shape)
    sums = np.zeros(len(sets) * n * PARTS, np.uint64)
    np.add.at(sums, cell, mix(drawn * np.uint64(_ODD) + seed))
    sums = sums.reshape(shape)
    thin = (held > 0).sum(2) <= 1
    names = mix(np.arange(1, n * PARTS + 1, dtype=np.uint64) * np.uint64(_ODD) ^ seed).reshape(1, n, PARTS)
    signature = mix(sums.sum(2, keepdims=True, dtype=np.uint64) - sums + names)
    used = np.broadcast_to((held.sum(2, keepdims=True) > held) | last, shape)
    place = np.broadcast_to(np.arange(len(sets))[:, None, None], shape)
    return place[used], signature[used], thin.sum(1)


def _nodes(docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """(node, who): a signature, and the first half of its set's fingerprint."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(_base.texts_of(batch, "text"), width)
        owner, signature = signatures(sets, threshold)
        prints = np.array([neardup._fingerprint(s)[0] if len(s) else 0 for s in sets], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(prints[owner])], ["node", "who"])

    return _base.map_rows(docs.where("doc_id is not null").select("text"), lambda: step, "node long, who long")


def _tested(pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (a, b, and n and sig of both) whose sketches and sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            near = (neardup._sigs(batch.column(4)).astype(np.uint8) == neardup._sigs(batch.column(5)).astype(np.uint8)).sum(1) >= LEAST
            near &= 100 * np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(near))

    return pairs.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _candidates(docs: DataFrame, reps: DataFrame, width: int, threshold: int) -> DataFrame:
    """(rep, cluster) of the sets that may be linked with another."""
    nodes = _nodes(docs, width, threshold)
    # equal sets count once, and a signature of a third of all sets is two numbers of each task
    ends = nodes.groupBy("node").agg(F.min("who").alias("lo"), F.max("who").alias("hi"))
    shared = _base.keep(ends.where("lo <> hi").select("node", "lo"), "shared")
    named = reps.select("fp_a", "rep", F.col("n_shingles").alias("n"), "sig")
    members = _base.keep(nodes.join(shared, "node").distinct(), "members")
    stars = _base.keep(members.where("who <> lo").select("who", "lo").distinct(), "stars")
    side = lambda name, as_: named.select(F.col("fp_a").alias(name), F.col("rep").alias(as_), F.col("n").alias(f"n_{as_}"), F.col("sig").alias(f"sig_{as_}"))
    edges = _base.keep(_tested(stars.join(side("who", "a"), "who").join(side("lo", "b"), "lo"), threshold), "links")
    roots = components(edges)
    own = members.join(named.select(F.col("fp_a").alias("who"), "rep"), "who").select("node", "rep")
    rows = neardup._labelled(own, roots)
    seen = rows.groupBy("node").agg(F.count("*").alias("c"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum(F.xxhash64("rep") / F.lit(2.0) ** 20).alias("h"))
    # signatures of the same sets ask for the same comparisons; those of two are compared already
    open_ = _base.keep(seen.where("low <> high AND c > 2").groupBy("c", "low", "high", "h").agg(F.min("node").alias("node")).select("node", "c"), "open")
    if not open_.isEmpty():
        payload = reps.select("rep", F.col("n_shingles").alias("n"), "sig")
        mixed = _base.keep(rows.join(open_, "node").join(payload, "rep"), "mixed")
        links_of = partial(neardup._sketch_links, threshold=threshold, least=LEAST)
        more = components(edges.unionByName(neardup._pairs_map(neardup._outsiders(mixed, "node", ["n", "sig", "label"]), links_of)))
        _base.drop(mixed, roots)
        roots = more
    clusters = neardup._clusters(roots)
    _base.drop(shared, members, stars, edges, roots, open_)
    return clusters


def jaccard_classes(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text): the classes of sets linked at ``threshold`` percent or more.

    Null and empty texts have no shingle and are alone. Rows with the same set are one class, whatever their ids; a row
    without id belongs to its class, but makes no links of its own, and alone its component is null. Repeated rows get the same result. A text of
    any length is taken whole; an empty table gives an empty one. Other columns aren't kept, whatever their names.
    """
    return neardup.linked(docs, [], lambda reps: _candidates(docs, reps, width, threshold), width, threshold).select("doc_id", "n_shingles", "component_id")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_base.read(spark, sf_dir, "documents"))
