"""Folds, boosting and importances against brute force, and search with pruning against search without."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import boosting, folds, metrics, models, search, shared, textmodel
from tests.test_operators import rows


def labelled(spark, n=3000, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, c = rng.random(), rng.randint(0, 9), rng.gauss(0, 1)
        x = 3 * (a > 0.6) + (b % 3 == 0) * (c > 0) * 2 - 2 + rng.gauss(0, 0.7)
        out.append((a, float(b), c if rng.random() > 0.05 else None, int(x > 0)))
    return rows(spark, out, "a double, b double, c double, y int")


def tree_by_force(x, g, h, leaves, l2, least, rate):
    """Leaf-wise growth by looking at every threshold of every leaf; returns each row's value."""
    def best(idx):
        worth = lambda s: g[s].sum() ** 2 / (h[s].sum() + l2)
        top = None
        for f in range(x.shape[1]):
            for t in np.unique(x[idx, f])[:-1]:
                low, high = idx[x[idx, f] <= t], idx[x[idx, f] > t]
                if min(len(low), len(high)) >= least and min(h[low].sum(), h[high].sum()) > 1e-3:
                    gain = worth(low) + worth(high) - worth(idx)
                    if gain > 1e-9 and (top is None or gain > top[0] + 1e-12):
                        top = (gain, low, high)
        return top

    parts = [np.arange(len(x))]
    splits = [best(parts[0])]
    while len(parts) < leaves and any(splits):
        i = max((i for i, s in enumerate(splits) if s), key=lambda i: splits[i][0])
        _, low, high = splits[i]
        parts[i : i + 1], splits[i : i + 1] = [low, high], [best(low), best(high)]
    out = np.zeros(len(x))
    for p in parts:
        out[p] = -rate * g[p].sum() / (h[p].sum() + l2)
    return out


def test_boosted_trees_split_as_brute_force(spark):
    df = labelled(spark, 400).repartition(3)
    data = df.collect()
    x = np.array([[r["a"], r["b"], -math.inf if r["c"] is None else r["c"]] for r in data])
    y = np.array([r["y"] for r in data], float)
    x[:, 0] = np.round(x[:, 0], 2)
    x[:, 2] = np.where(np.isinf(x[:, 2]), x[:, 2], np.round(x[:, 2], 1))
    small = rows(spark, [(*map(float, v), int(t)) for v, t in zip(x, y)], "a double, b double, c double, y int").repartition(3)
    model = boosting.boost(small, ["a", "b", "c"], "y", rounds=3, rate=0.3, leaves=7, least=10)
    raw = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-raw))
        raw = raw + tree_by_force(x, p - y, p * (1 - p), 7, 1.0, 10, 0.3)
        assert tree.feature.count(-1) == 7
    got = {tuple(r[:3]): r["score"] for r in model.score(small).collect()}
    for v, s in zip(x, raw):
        assert abs(got[tuple(v)] - 1 / (1 + math.exp(-s))) < 1e-6


def test_boosted_trees_do_not_depend_on_partitions_and_keep_sums(spark, monkeypatch):
    df = labelled(spark, 600)
    one = boosting.boost(df.coalesce(1), ["a", "b", "c"], "y", rounds=5, leaves=6)
    monkeypatch.setattr(boosting, "KEEP_EVERY", 2)
    assert boosting.boost(df.repartition(5), ["a", "b", "c"], "y", rounds=5, leaves=6).trees == one.trees


def test_boosted_trees_predict_as_well_as_spark_ones(spark):
    train, test = labelled(spark, 3000, 1), labelled(spark, 2000, 2)
    names, truth = ["a", "b", "c"], F.col("y") == 1
    ours = boosting.boost(train, names, "y", rounds=40, rate=0.1, leaves=15)
    whole = lambda df: df.fillna(-9.0)
    theirs = models.boosted_trees(whole(train), names, "y", rounds=20, depth=4)
    ap = lambda df: metrics.average_precision(metrics.by_score(df, F.col("score"), truth)).first()[0]
    a, b = ap(ours.score(test)), ap(models.scored(theirs, whole(test)))
    assert a > 0.9 and a > b - 0.01


def test_boosted_trees_of_odd_tables(spark):
    empty = rows(spark, [], "a double, y int")
    assert boosting.boost(empty, ["a"], "y", rounds=2).score(empty).count() == 0
    alike = rows(spark, [(1.0, 1)] * 50 + [(None, None)], "a double, y int")
    model = boosting.boost(alike, ["a"], "y", rounds=2)
    assert all(r["score"] > 0.99 for r in model.score(alike).collect())


def test_folds_are_those_of_the_greedy_rule(spark, monkeypatch):
    rng = random.Random(6)
    data = [(g, c) for g in range(60) for c in rng.choices("abc", [6, 3, 1], k=rng.choice([1, 3, 10, 40]))] + [(None, "a"), (1, None)]
    df = rows(spark, data, "g long, c string")
    got = {r["g"]: r["fold"] for r in folds.stratified_folds(df, "g", "c").collect()}
    counts = Counter(x for x in data if None not in x)
    totals = Counter(c for g, c in data if g is not None and c)
    of = {g: tuple(counts[g, c] for c in "abc") for g in got}
    order = sorted(of, key=lambda g: (-round(sum((n / totals[c]) ** 2 for n, c in zip(of[g], "abc")), 12), tuple(-n for n in of[g]), g))
    assert set(got) == set(range(60)) and [got[g] for g in order] == folds.place([of[g] for g in order], [totals[c] for c in "abc"], 5)
    share = lambda f, c: sum(of[g]["abc".index(c)] for g in got if got[g] == f) / totals[c]
    assert all(abs(share(f, c) - 0.2) < 0.03 for f in range(5) for c in "ab")
    monkeypatch.setattr(folds, "LARGE", 8)
    dealt = {r["g"]: r["fold"] for r in folds.stratified_folds(df, "g", "c").collect()}
    assert set(dealt) == set(range(60)) and [dealt[g] for g in order[:8]] == [got[g] for g in order[:8]]
    kinds = Counter((of[g], dealt[g]) for g in order[8:])
    for kind in {k for k, _ in kinds}:
        of_kind = [kinds[kind, f] for f in range(5)]
        assert max(of_kind) - min(of_kind) <= 1


def test_cross_validation_has_a_row_for_each_fold(spark):
    data = [(g, float(g % 3), g % 3 == 0) for g in range(90) for _ in range(1 + g % 4)]
    df = rows(spark, data, "g long, x double, y boolean")
    got = folds.cross_validate(df, "g", "y", lambda train: lambda test: test.withColumn("predicted", F.col("x") == 0)).collect()
    assert [r["fold"] for r in got] == [0, 1, 2, 3, 4] and sum(r["test_rows"] for r in got) == len(data)
    assert all(r["accuracy"] == 1 and r["macro_f1"] == 1 and r["train_rows"] + r["test_rows"] == len(data) for r in got)
    mean = folds.spread_of(spark.createDataFrame(got), F.col("accuracy")).first()
    assert tuple(mean) == (1.0, 0.0)


def test_values_are_dealt_out_among_all_rows(spark):
    df = rows(spark, [(float(i), float(i % 5), i % 2) for i in range(40)], "a double, b double, y int")
    got = models.dealt_out(df, ["a", "b"], 3).collect()
    by = {}
    for r in got:
        by.setdefault((r["feature"], r["repeat"]), []).append((r["a"], r["b"], r["y"]))
    assert sorted(by) == [("", 0), *[(f, r) for f in "ab" for r in range(3)]]
    assert sorted(by["", 0]) == sorted(map(tuple, df.collect()))
    for (f, _), dealt in by.items():
        if f:
            kept = [(b, y) if f == "a" else (a, y) for a, b, y in dealt]
            moved = [a if f == "a" else b for a, b, y in dealt]
            assert Counter(kept) == Counter((r[1], r[2]) if f == "a" else (r[0], r[2]) for r in df.collect())
            assert Counter(moved) == Counter(r[0] if f == "a" else r[1] for r in df.collect())
    assert sorted(by["a", 0]) != sorted(by["a", 1])


def test_importances_need_as_many_jobs_for_any_repeats(spark):
    df = labelled(spark, 500).fillna(0.0)
    model = models.logistic(df, ["a", "b", "c"], "y")
    jobs = []
    for names, repeats in ((["a"], 1), (["a", "b", "c"], 5)):
        fitted = model if len(names) == 3 else models.logistic(df, names, "y")
        spark.sparkContext.setJobGroup(f"importance-{repeats}", "")
        got = models.permutation_importance(fitted, df, names, "y", repeats).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"importance-{repeats}")))
        spark.sparkContext.setJobGroup("", "")
    assert got[0]["feature"] == "a" and got[0]["drop"] > 0.1 and jobs[1] <= jobs[0] + 2


def test_pruned_search_finds_the_same_and_scores_less(spark):
    rng = random.Random(8)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    data = [(i, " ".join(word() for _ in range(rng.randint(0, 120)))) for i in range(1500)] + [(3, "w1 w2 w3"), (9000, None), (9001, "")]
    docs = rows(spark, data, "doc_id long, text string")
    asked = rows(spark, sorted({(q, w) for q in range(25) for w in data[q * 7][1].split()[:30]} | {(99, "unheard")}), "query_id long, term string")
    terms = F.split("text", " ")
    counts = search.term_counts(docs, terms)
    n, mean = docs.agg(F.count("*"), F.avg(F.size(terms))).first()
    every = search.bm25(counts, asked, n, mean)
    plain = lambda df, k: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in search.top(df.withColumn("score", F.round("score", 6)), "score", k).collect())
    for k in (3, 50):
        assert plain(search.bm25_top(docs, terms, asked, k), k) == plain(every, k)
    found, n, mean = search.postings(docs, terms, asked)
    left, _ = search.survivors(*search.term_weights(found, n, mean), asked, 3)
    assert left.count() < every.count() / 4


def test_text_classifier_equals_a_dense_fit(spark):
    rng = random.Random(9)
    words = {"x": [f"red{i}" for i in range(12)], "y": [f"blue{i}" for i in range(12)], "z": [f"green{i}" for i in range(12)]}
    every = [w for ws in words.values() for w in ws]
    text = lambda c: " ".join(rng.choice(words[c] if rng.random() < 0.4 else every) for _ in range(rng.randint(3, 25)))
    data = [(i, text(c), c) for i, c in enumerate(rng.choices("xyz", [6, 3, 1], k=240))]
    test = [(i, text(c), c) for i, c in enumerate(rng.choices("xyz", k=120))] + [(900, None, "x"), (901, "the unheard of", "x")]
    schema = "id long, text string, label string"

    terms = lambda t: (w := (t or "").split()) + [f"{a} {b}" for a, b in zip(w, w[1:])]
    df = Counter(t for _, s, _ in data for t in set(terms(s)))
    names = sorted(t for t in df if df[t] >= 2)
    idf = np.array([math.log((1 + len(data)) / (1 + df[t])) + 1 for t in names])

    def dense(rows_):
        x = np.zeros((len(rows_), len(names)))
        for i, (_, s, _) in enumerate(rows_):
            for t, n in Counter(terms(s)).items():
                if df[t] >= 2:
                    x[i, names.index(t)] = 1 + math.log(n)
        x *= idf
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)

    x, y = dense(data), np.array(["xyz".index(c) for _, _, c in data])
    weight = np.array([len(y) / (3 * (y == k).sum()) for k in range(3)])[y]
    w, b = np.zeros((len(names), 3)), np.zeros(3)
    for _ in range(6000):  # plain gradient descent on the same loss
        m = x @ w + b
        p = np.exp(m - m.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - np.eye(3)[y]) * weight[:, None] / weight.sum()
        w, b = w - 1.5 * (x.T @ p + w / (10 * len(y))), b - 1.5 * p.sum(0)
    margin = dense(test) @ w + b
    predict = textmodel.text_classifier(rows(spark, data, schema), "text", "label", tolerance=1e-7)
    got = {r["id"]: r["predicted"] for r in predict(rows(spark, test, schema)).collect()}
    clear = np.sort(margin, 1)[:, -1] - np.sort(margin, 1)[:, -2] > 0.03
    assert clear.sum() > 90 and all(got[i] == "xyz"[m.argmax()] for (i, _, _), m, sure in zip(test, margin, clear) if sure)


def test_text_classifier_of_odd_tables(spark):
    schema = "text string, label string"
    one = textmodel.text_classifier(rows(spark, [("a b c", "x"), ("d e f", "x"), (None, "x"), ("g", None)], schema), "text", "label")
    assert [r["predicted"] for r in one(rows(spark, [("zz", None), (None, None)], schema)).collect()] == ["x", "x"]
    with pytest.raises(ValueError):
        textmodel.text_classifier(rows(spark, [], schema), "text", "label")


def test_direction_is_that_of_the_two_loops():
    rng = np.random.default_rng(2)
    g, steps = rng.normal(size=30), [rng.normal(size=30) for _ in range(3)]
    changes = [s * rng.uniform(0.5, 2, 30) for s in steps]
    d, alphas = -g.copy(), []
    for s, c in zip(reversed(steps), reversed(changes)):
        alphas.append(d @ s / (s @ c))
        d -= alphas[-1] * c
    d *= steps[-1] @ changes[-1] / (changes[-1] @ changes[-1])
    for s, c, a in zip(steps, changes, reversed(alphas)):
        d += (a - d @ c / (s @ c)) * s
    table = np.array([g, *steps, *changes])
    assert np.allclose(textmodel.direction(table @ table.T) @ table, d)


def test_products_over_the_terms_equal_dense_ones_and_leave_the_chunks_where_they_are(spark):
    rng = np.random.default_rng(6)
    x = np.where(rng.random((40, 23)) < 0.3, rng.uniform(0.5, 2, (40, 23)), 0)
    x[5] = 0
    data = [(i, i % 3, int(t), float(x[i, t]), 1.0) for i in range(40) for t in np.nonzero(x[i])[0]] + [(5, 2, -1, 0.0, 1.0)]
    entries = rows(spark, data, "_row long, _label int, id long, x double, _weight double").withColumn("chunk", F.col("_row") % 7)
    chunks = shared.keep_buckets(textmodel._sparse_chunks(entries, 3), "chunks", 3, "chunk")
    r = rng.normal(size=(40, 2))
    given = rows(spark, [(c, r[c::7].tobytes()) for c in range(7)], "chunk long, r binary")
    unit = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)
    products = textmodel._products(chunks, given, 2, 5)
    got = {g["chunk"]: np.frombuffer(g["kr"]).reshape(-1, 2) for g in products.collect()}
    assert all(np.allclose(got[c], (unit @ (unit.T @ r))[c::7]) for c in range(7))
    w = np.array([g["w"] for g in textmodel._term_weights(chunks, given, 2, 5).orderBy("id").collect()])
    assert np.allclose(w, unit.T @ r)
    plan = chunks.groupBy("chunk").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    shared.drop(chunks)
    assert not spark.catalog.tableExists(chunks._table)


def test_full_text_search_counts_shared_ids_together_and_shuffles_no_pairs(spark):
    data = [(i, " ".join(f"w{j}" for j in range(i % 7 + 1))) for i in range(300)] + [(5, "w0 w0"), (5, "w3 w4 w5"), (None, "w0 w6"), (None, "w6 w6"), (7, "w0 w0")]
    docs = rows(spark, data, "doc_id long, text string")
    asked = rows(spark, [(q, f"w{j}") for q in range(9) for j in range(q)], "query_id long, term string")
    terms = F.split("text", " ")
    n, mean = docs.agg(F.count("*"), F.avg(F.size(terms))).first()
    every = search.bm25(search.term_counts(docs, terms), asked, n, mean)
    found = search.bm25_top(docs, terms, asked, 3)
    plain = lambda df: sorted(((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in search.top(df.withColumn("score", F.round("score", 6)), "score", 3).collect()), key=str)
    assert plain(found) == plain(every)
    assert found.count() < every.count() / 10


def test_dealing_out_joins_a_row_for_each_repeat_and_not_for_each_feature(spark):
    df = rows(spark, [(float(i), float(2 * i), i % 2) for i in range(50)], "a double, b double, y int")
    dealt = models.dealt_out(df, ["a", "b"], 4)
    by = {}
    for r in dealt.where("feature <> ''").collect():
        by.setdefault((r["feature"], r["repeat"]), []).append(r["b"] / 2 if r["feature"] == "a" else r["a"])
    assert all(sorted(x) == [float(i) for i in range(50)] for x in by.values()) and len(by) == 8
    orders = {r: sorted((x["b"] / 2, x["a"]) for x in dealt.where(f"feature = 'a' AND repeat = {r}").collect()) for r in range(2)}
    same = sorted((x["a"], x["b"] / 2) for x in dealt.where("feature = 'b' AND repeat = 0").collect())
    assert orders[0] == same and orders[0] != orders[1]  # features of a repeat share an order


def test_boosting_passes_sum_half_of_the_rows_at_most_and_read_blocks_on_all_cores(spark, monkeypatch):
    df = labelled(spark, 6000).coalesce(1)
    seen, plain = [], boosting._sums

    def sums(table, added, tree, wanted, features):
        out = plain(table, added, tree, wanted, features)
        seen.append((len(table.inputFiles()), table.count(), len(wanted), sum(int(out[w][2, 0].sum()) for w in wanted)))
        return out

    monkeypatch.setattr(boosting, "_sums", sums)
    model = boosting.boost(df, ["a", "b", "c"], "y", rounds=1, leaves=8)
    assert model.trees[0].feature.count(-1) == 8
    assert all(files == spark.sparkContext.defaultParallelism and blocks < 20 for files, blocks, _, _ in seen)
    assert seen[0][2:] == (1, 6000) and len(seen) > 2 and all(n <= 3000 for _, _, _, n in seen[1:])


def test_tuned_models_fit_all_rounds(spark, monkeypatch):
    from quern.plans import learning

    seen, boost, trees = [], boosting.boost, models.boosted_trees
    monkeypatch.setattr(boosting, "boost", lambda df, f, y, rounds=300, **more: seen.append(("boost", rounds)) or boost(df, f, y, rounds=2, **more))
    monkeypatch.setattr(models, "boosted_trees", lambda df, f, y, rounds=60, depth=4: seen.append(("trees", rounds, depth)) or trees(df, f, y, 2, 2))
    assert learning.tuned_models(spark, "/root/testdata/sf0.001").count() == 3
    assert sorted(seen) == [("boost", 300)] * 2 + [("trees", 60, 4)] * 2


def test_a_boosting_pass_is_one_stage_over_rows_that_stay_held(spark):
    table = shared.keep(labelled(spark, 3000).select("y", "a", "b", "c").mapInArrow(lambda batches: (boosting._blocks(boosting._bins(b.columns[1:], [np.array([0.0])] * 3), b.column(0).cast("double").to_numpy(), np.zeros(b.num_rows)) for b in batches), "bins binary, y binary, raw binary"), "bins")
    spark.sparkContext.setJobGroup("pass", "a pass")
    one = boosting._sums(table, [], boosting.Tree(), [0], 3)[0]
    shared.drop(table)  # held rows need no file
    again = boosting._sums(table, [], boosting.Tree(), [0], 3)[0]
    spark.sparkContext.setJobGroup("other", "others")
    tracker = spark.sparkContext.statusTracker()
    stages = [len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup("pass")]
    assert stages == [1, 1] and np.array_equal(one, again) and one[2, 0].sum() == 3000


def test_products_by_buckets_of_terms_equal_dense_ones_and_shuffle_no_terms(spark):
    rng = np.random.default_rng(4)
    words = [[f"w{j}" for j in rng.integers(0, 400, rng.integers(0, 60))] for _ in range(90)]
    df = Counter(t for w in words for t in set(w))
    names = sorted(t for t in df if df[t] >= 2)
    x = np.zeros((90, len(names)))
    for i, w in enumerate(words):
        for t, n in Counter(w).items():
            if df[t] >= 2:
                x[i, names.index(t)] = (1 + math.log(n)) * (math.log(91 / (1 + df[t])) + 1)
    listed = spark.createDataFrame(list(enumerate(words)), "row long, _terms array<string>").repartition(5)
    keys = textmodel._bucket_keys(spark, 3)
    blocks = shared.keep_buckets(textmodel._term_blocks(textmodel._shares(listed, 7), 90, 2, keys), "blocks", 3, "bucket")
    r = rng.normal(size=(90, 2))
    sent = spark.createDataFrame([(c, bytearray(r[30 * c : 30 * c + 30].tobytes())) for c in range(3)], "chunk long, s binary")
    read = lambda d: np.concatenate([np.frombuffer(g["y"]).reshape(-1, 2) for g in d.orderBy("chunk").collect()])
    crossed = textmodel._crossed(blocks, sent, keys, 2)
    assert np.allclose(read(crossed), x @ (x.T @ r)) and np.allclose(read(textmodel._crossed(blocks, sent, keys, 2, squares=True))[:, 0], (x * x).sum(1))
    assert blocks.count() == 7 and textmodel._to_buckets(sent, keys).count() == 9 and crossed.count() == 3
    weights = {t: w for g in textmodel._block_weights(blocks, sent, keys, 2).collect() for t, w in zip(g["terms"], np.frombuffer(g["w"]).reshape(-1, 2), strict=True)}
    assert sorted(weights) == names and np.allclose([weights[t] for t in names], x.T @ r)


def test_full_text_search_passes_hold_many_queries_and_read_terms_once(spark, monkeypatch):
    docs = rows(spark, [(i, f"w{i % 50} w{i % 7} both") for i in range(400)], "doc_id long, text string").select("doc_id", F.split("text", " ").alias("_terms"))
    asked = rows(spark, [(q, t) for q in range(5000) for t in (f"w{q % 60}", "both")], "query_id long, term string").distinct()
    passes, plain, kept = [], search._scorer, []
    monkeypatch.setattr(search, "_scorer", lambda *a: passes.append(1) or plain(*a))
    monkeypatch.setattr(search, "keep", lambda df, label: kept.append(label) or shared.keep(df, label))
    found = search.bm25_top(shared.keep(docs, "docs"), F.col("_terms"), asked, 3)
    assert len(passes) == 1 and "terms" not in kept and found.select("query_id").distinct().count() == 5000
    monkeypatch.setattr(search, "PASS_TERMS", 3000)
    again = search.bm25_top(docs, F.col("_terms"), asked, 3)
    assert len(passes) == 1 + 4 and sorted(map(tuple, again.collect())) == sorted(map(tuple, found.collect()))


def test_postings_search_leaves_out_no_document_of_the_first(monkeypatch):
    rng = np.random.default_rng(11)
    monkeypatch.setattr(search, "WIDE", 8)
    asks = [rng.choice(60, rng.integers(1, 30), replace=False) for _ in range(40)]
    for k in (1, 5, 40):
        best, every = [None] * len(asks), []
        for part in range(3):
            weight = rng.integers(0, 4, (60, 300)) * (rng.random((60, 1)) * rng.random((60, 300)) + 0.2) * (rng.random((60, 300)) < rng.random((60, 1)) ** 3)
            weight[:, 150:180] = weight[:, :30]  # equal documents
            doc = rng.permutation(300) + 300 * part
            term, row = np.nonzero(weight)
            search._search(asks, [term.astype(np.int32), row.astype(np.int32), weight[term, row]], doc, 60, k, best)
            every.append((doc, weight))
        doc, weight = np.concatenate([d for d, _ in every]), np.concatenate([w for _, w in every], 1)
        for mine, got in zip(asks, best, strict=True):
            score = np.floor(weight[mine].sum(0) * 1e6 + 0.5) / 1e6
            order = [i for i in np.lexsort((doc, -score)) if weight[mine][:, i].any()][:k]
            assert (got[1].tolist() if got is not None else []) == doc[order].tolist()
