"""Periodic runs and vector codes against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from quern.llm import _base, periods, quantize
from tests.llm.test_operators import frame, odd_rows

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def runs_by_force(w):
    """All maximal stretches of each period, one period after another, without those that have a smaller one."""
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            length, root = i + q - start, w[start : start + q]
            smaller = any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.add((start, length, q))
    return sorted(out)


def row_by_force(doc_id, text):
    w = WORDS.findall(text or "")
    n, h = len(w), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = runs_by_force(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
    digests = ("".join(f"{s},{length},{q}\n" for s, length, q in runs), " ".join(x for i, x in enumerate(w) if i not in gone))
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in digests))


def test_runs_equal_brute_force_on_random_sequences():
    rng = random.Random(3)
    for _ in range(1500):
        k = rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.randint(1, 9)
            w += ([rng.randrange(k + 2) for _ in range(p)] * 9)[: rng.randint(3 * p, 9 * p)]
            w += [rng.randrange(k) for _ in range(rng.randint(0, 5))]
        assert periods.find_runs(np.array(w, np.int64)) == runs_by_force(w)


def test_runs_of_long_texts_use_bounded_automata(monkeypatch):
    w = list(range(700)) * 6 + [1] * 5000 + [1, 2, 3] * 900
    whole = periods.find_runs(np.array(w))
    assert (0, 4200, 700) in whole
    monkeypatch.setattr(periods, "KEY_WORDS", 64)
    assert periods.find_runs(np.array(w)) == whole


def test_periodic_runs_equal_brute_force(spark):
    got = sorted(map(tuple, periods.op12_periodic_runs(spark, FOLDER).collect()))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert got == sorted(row_by_force(*r) for r in docs) and sum(r[1] > 0 for r in got) > 5


def test_periodic_runs_of_odd_rows(spark):
    rows = [*odd_rows(), (10, "a a a a a a"), (11, "a a a a a"), (12, "x " + "p q " * 3), (13, "x " + "p q " * 4 + "\t p")]
    docs = frame(spark, [(i, t, t) for i, t in rows], "doc_id long, text string, Runs string")
    got = periods.mark_runs(docs)
    assert got.columns == ["doc_id", "text", "runs", "collapsed"]
    found = defaultdict(list)
    for r in got.collect():
        found[r["doc_id"]].append(([tuple(x) for x in r["runs"]], r["collapsed"]))
    assert found[1] == found[2] == found[3] == [([], "")] and found[11] == [([], "a a a a a")] and found[12] == [([], "x p q p q p q")]
    assert found[10] == [([(0, 6, 1)], "a")] and found[13] == [([(1, 9, 2)], "x p q")] and found[5] == [([(0, 63000, 7)], "a b c d e f g")]
    assert found[6][0] == found[6][1] and len(found[7][0][1]) == 3_000_000 and len(found[None]) == 1
    assert periods.mark_runs(docs.where("false")).count() == 0


def codes_by_force(vectors, parts=4, entries=256, rounds=4):
    """(codes, error) of each row, in order, and the codebooks, with Python's integers."""
    ints = [[int(np.floor(float(x) * 1024)) for x in v] for _, v in vectors]
    width = len(ints[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for v in ints] for p in range(parts)]
    order = sorted(range(len(ints)), key=lambda i: (vectors[i][0] is None, vectors[i][0] or 0, ints[i]))[:entries]
    books, out = [], [[[], 0] for _ in ints]
    for p in range(parts):
        book = [cut[p][i] for i in order]
        near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
        for _ in range(rounds):
            members = defaultdict(list)
            for x in cut[p]:
                members[near(x, book)[1]].append(x)
            book = [tuple(sum(c) // len(members[e]) for c in zip(*members[e])) if e in members else book[e] for e in range(len(book))]
        for i, x in enumerate(cut[p]):
            error, e = near(x, book)
            out[i][0].append(e)
            out[i][1] += error
        books.append(book)
    return out, books


@pytest.mark.parametrize("entries", [4, 64])
def test_codes_equal_brute_force(spark, entries):
    rng = random.Random(entries)
    some = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(30)]
    vectors = [(rng.choice([None, rng.randint(0, 99)]), rng.choice(some) if rng.random() < 0.5 else [rng.choice([-0.5, 0.25, 1e-4, -1e-4]) for _ in range(8)]) for _ in range(150)]
    got = quantize.compress(frame(spark, [(i, v, n) for n, (i, v) in enumerate(vectors)], "vec_id long, embedding array<double>, n long"), entries=entries)
    want, books = codes_by_force(vectors, entries=entries)
    assert [(r["codes"], r["error"]) for r in got.rows.orderBy("n").collect()] == [tuple(x) for x in want]
    assert [[tuple(e) for e in b.tolist()] for b in got.books] == books


def test_codes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, [0.5, None, 0.0, 0.0]), (3, [nan, 0.0, 0.0, 0.0]), (4, [0.0, -inf, 0.0, 0.0]), (5, [0.5, 0.25, 0.0, -0.001]), (5, [0.5, 0.25, 0.0, -0.001]), (6, [0.1] * 8), (7, [1e30, 0.0, 0.0, 0.0]), (8, []), (9, [0.1] * 3), (None, [0.0] * 4)]
    odd = frame(spark, [(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, codes int, row string")
    got = quantize.compress(odd)
    assert got.rows.columns == ["vec_id", "embedding", "row", "codes", "error"]
    found = {(r["vec_id"], None if r["codes"] is None else tuple(r["codes"]), r["error"]) for r in got.rows.collect()}
    assert found == {(5, (0, 0, 0, 0), 0), (6, None, None), (7, None, None), (8, None, None), (9, None, None), (None, (2, 2, 0, 2), 0)}
    assert got.rows.count() == 7 and len(got.books) == 4 and len(got.books[0]) == 3
    empty = quantize.compress(odd.where("false"))
    assert empty.rows.count() == 0 and empty.books == [] and quantize.compress(odd.where("vec_id = 8")).rows.count() == 1


def test_label_errors_take_nulls_together(spark):
    rows = frame(spark, [(1, "", 3), (2, None, 4), (3, None, 5), (4, "b", None), (5, "b", 7)], "n long, label string, error long")
    got = {r["n"]: r["label_error"] for r in quantize.with_label_error(rows, "label").collect()}
    assert got == {1: 3, 2: 9, 3: 9, 4: 7, 5: 7}


def test_look_up_joins_frequent_and_other_keys(spark):
    rows = frame(spark, [(i % 7 if i < 50 else 9, i) for i in range(200)], "k long, i long")
    table = rows.groupBy("k").count().selectExpr("k", "k * 10 AS v", "count AS n")
    for hot in (1, 3, 1024):
        got = sorted(map(tuple, _base.look_up(rows, table, ["k"], "n", hot).select("i", "v").collect()))
        assert got == [(i, 10 * (i % 7) if i < 50 else 90) for i in range(200)]
