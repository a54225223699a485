"""The n-gram Jaccard join against brute force, and its signatures against pairs at the threshold."""

import random

import numpy as np
import pytest

from quern.llm import neardup, partenum
from tests.llm.test_operators import frame, odd_rows, words_of

FOLDER = "/root/testdata/sf0.001"


def set_of(text, width=4):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def by_force(rows, threshold=85):
    """(doc_id, set size, component) of all rows by comparing all pairs of sets that share an element."""
    sets = [set_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= threshold * (len(s) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.mark.parametrize("threshold", [85, 80])
def test_linked_sets_share_a_signature(threshold):
    rng = np.random.default_rng(threshold)
    for n in [*range(1, 60), 80, 119, 120, 207, 209, 400, 1500]:
        pairs = []
        for _ in range(40):
            elements = np.unique(rng.integers(0, 1 << 63, 2 * n + 4).astype(np.uint64))
            rng.shuffle(elements)
            more = int(rng.integers(0, n * (100 - threshold) // threshold + 1))  # elements of the second set alone
            total = n + more
            less = max(0, (100 * n - threshold * total) // 100)  # and of the first one alone
            a, b = np.sort(elements[:n]), np.sort(elements[less:total])
            if len(b) and 100 * len(np.intersect1d(a, b)) >= threshold * len(np.union1d(a, b)) and not np.array_equal(a, b):
                pairs.append((a, b))
        for a, b in pairs:
            owner, signature = partenum.signatures([a, b], threshold)
            assert set(signature[owner == 0].tolist()) & set(signature[owner == 1].tolist()), (n, len(a), len(b))


def test_small_sets_give_no_signature_that_all_share():
    rng = np.random.default_rng(1)
    for n in (6, 7, 10, 16, 40, 200):
        sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(300)]
        _, signature = partenum.signatures(sets)
        assert np.unique(signature, return_counts=True)[1].max() == 1


def some_docs(rng, n):
    """Families of near copies, families that share a passage only, short texts and singles."""
    passage = " ".join(f"p{i}" for i in range(60))
    words = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]
    out = []
    for _ in range(n):
        base = words(rng.choice([3, 4, 8, 11, 30, 100, 300]))
        if rng.random() < 0.4:
            base = passage.split() + base
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                at = rng.randrange(len(copy))
                copy[at : at + rng.choice([0, 1])] = words(1)
            out.append((len(out), " ".join(copy)))
    return out


def test_classes_equal_brute_force(spark):
    rows = [*some_docs(random.Random(4), 150), (7, "a b c d e f g h i j"), (None, "a b c d e f g h i j"), (None, "x y z"), (5000, None)]
    got = sorted(map(tuple, partenum.jaccard_classes(frame(spark, rows)).collect()), key=repr)
    want = by_force(rows)
    assert got == want and sum(r[0] is not None and r[0] != r[2] for r in got) > 50


def test_large_families_are_settled_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 8)
    rows = some_docs(random.Random(5), 40)
    base = [f"v{i}" for i in range(200)]
    for i in range(60):
        copy = list(base)
        copy[3 * i] = "changed"
        rows.append((1000 + i, " ".join(copy)))
    assert sorted(map(tuple, partenum.jaccard_classes(frame(spark, rows)).collect()), key=repr) == by_force(rows)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, partenum.op11_jaccard_join(spark, FOLDER).collect()), key=repr) == by_force(docs)


def test_classes_of_odd_rows(spark):
    docs = frame(spark, [(i, t, 1, "x") for i, t in odd_rows()], "doc_id long, text string, rep int, Node string")
    got = sorted(map(tuple, partenum.jaccard_classes(docs).collect()), key=repr)
    assert got == by_force(odd_rows())
    assert partenum.jaccard_classes(docs.where("false")).count() == 0
