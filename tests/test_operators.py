import random

from pyspark.sql import functions as F

from quern.functions import clinical, numeric, prng
from quern.functions import text as T
from quern.operators import history, metrics, models, noise, records, search, similarity, validate, textmodel


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_words_split_on_wide_spaces(spark):
    assert value(spark, T.word_count(F.lit(" a b　c\n"))) == 3
    assert value(spark, T.words(F.lit(""))) == []


def test_content_words_and_coverage(spark):
    assert value(spark, T.content_words(F.lit("The patients' 38.5°C fever, resting... 3rd walk-"))) == ["patients", "fever", "resting", "walk"]
    assert value(spark, T.coverage(F.lit("resting fevers"), F.lit("rested with fever"))) == 1.0
    assert value(spark, T.coverage(F.lit("the"), F.lit("anything"))) == 1.0


def test_mentions_takes_terms_literally(spark):
    assert value(spark, T.mentions(F.lit("took Co+D (10) now"), F.lit("co+d")).cast("string")) in ("true", "false")
    assert value(spark, T.mentions(F.lit("a Napa tablet"), F.lit("napa")))
    assert not value(spark, T.mentions(F.lit("Napastar"), F.lit("napa")))


def test_english_list(spark):
    for items, want in (([], ""), (["a"], "a"), (["a", "b"], "a and b"), (["a", "b", "c"], "a, b, and c")):
        assert value(spark, T.english_list(F.array(*[F.lit(x) for x in items]).cast("array<string>"))) == want


def test_question_answer_and_json(spark):
    got = value(spark, T.question_answer(F.lit("Q: When? A: At 9 A: sharp")))
    assert (got["question"], got["answer"]) == ("When?", "At 9 A: sharp")
    assert value(spark, T.question_answer(F.lit("no"))) is None
    assert value(spark, T.json_object(F.lit('so: {"a": {"b": 1}} ok'))) == '{"a": {"b": 1}}'


def test_prescription_and_case(spark):
    medicine = F.array(F.struct(F.lit("Napa").alias("name"), F.lit("500 mg").alias("dosage"), F.lit("twice").alias("frequency"), F.lit("5 days").alias("duration")))
    assert value(spark, T.prescription(F.lit("H:"), medicine, F.lit("rest."), F.lit("in a week"))) == "H: 1) Napa 500 mg, twice, 5 days. Advice: Rest. Follow-up: in a week"


def test_numbers(spark):
    assert value(spark, numeric.round_to(F.lit(-0.5), 0)) == 0.0
    assert value(spark, numeric.round_even(F.lit(2.5), 0)) == 2.0
    assert value(spark, numeric.unit_interval(F.lit(float("nan")))) is None
    assert value(spark, numeric.number_or_null(F.lit("0"))) is None
    assert value(spark, numeric.slot_minutes(F.lit("12:15 AM"))) == 15
    assert value(spark, numeric.slot_minutes(F.lit("12:00 PM"))) == 720
    assert value(spark, numeric.age_on(F.to_date(F.lit("2000-03-02")), F.to_date(F.lit("2020-03-01")))) == 19
    assert [value(spark, numeric.lead_bin(F.lit(d))) for d in (-1, 0, 2, 3, 200, 201)] == [None, "0", "1-2", "3-7", "31-200", None]


def test_draws_equal_the_sequential_generator(spark):
    def sequence(seed, n):
        a, out = seed & 0xFFFFFFFF, []
        for _ in range(n):
            a = (a + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((a ^ (a >> 15)) * (a | 1)) & 0xFFFFFFFF
            t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
            out.append((t ^ (t >> 14)) / 4294967296)
        return out

    for seed in (0, 20250, 2**32 - 1):
        got = [r[0] for r in spark.range(1, 301).select(prng.draw(seed, F.col("id"))).collect()]
        assert got == sequence(seed, 300)


def test_latest_upsert_and_difference(spark):
    layered = rows(spark, [("a", 0, 1), ("a", 10, 2), ("a", 9, 3), ("b", 0, 4)], "k string, layer int, x int")
    assert sorted((r["k"], r["x"], r["copies"]) for r in records.latest(layered, ["k"], [F.col("layer")]).collect()) == [("a", 2, 3), ("b", 4, 1)]
    old, new = rows(spark, [(1, "x", 5), (2, "y", 6)], "k int, a string, b int"), rows(spark, [(2, None), (3, "z")], "k int, a string")
    assert sorted(map(tuple, records.upsert(old, new, "k").collect())) == [(1, "x", 5), (2, None, 6), (3, "z", None)]
    actions = records.difference(rows(spark, [(1, "x"), (2, None)], "k int, a string"), rows(spark, [(2, None), (4, "q")], "k int, a string"), "k")
    assert dict(map(tuple, actions.collect())) == {1: "create", 2: "unchanged", 4: "extra"}


def test_numbering_is_gapless(spark):
    got = records.numbered(spark.range(1000).repartition(7).select((F.col("id") * 37 % 1000).alias("id")), ["id"])
    assert all(r["id"] == r["position"] for r in got.collect())
    assert records.numbered(spark.range(0), ["id"]).count() == 0


def test_vector_without_match_is_an_error(spark):
    import pytest

    found = records.with_vectors(rows(spark, [(1,), (2,)], "k int"), rows(spark, [(1, 2.0)], "k int, v double"), "k")
    with pytest.raises(Exception, match="no vector for 2"):
        found.collect()


def test_prefix_join_equals_all_pairs(spark):
    random.seed(4)
    sets = [(i, sorted(random.sample("abcdefghijkl", random.randint(1, 9)))) for i in range(120)]
    got = {(r["left"], r["right"]) for r in similarity.similar_pairs(rows(spark, sets, "k int, w array<string>"), "k", "w", 3, 5).collect()}
    want = {(i, j) for i, a in sets for j, b in sets if i < j and 5 * len(set(a) & set(b)) >= 3 * len(set(a) | set(b))}
    assert got == want


def test_near_duplicate_rule_is_one_sided_in_a_slice(spark):
    pairs = rows(spark, [("a", "b"), ("a", "c")], "left string, right string")
    where = rows(spark, [("a", "s1", 1), ("b", "s1", 2), ("c", "s2", 1)], "doc_id string, slice string, position int")
    assert sorted(map(tuple, validate.near_duplicate_errors(pairs, where).collect())) == [("a", "c"), ("b", "a"), ("c", "a")]


def test_published_confusion_counts(spark):
    got = metrics.binary_metrics(rows(spark, [(14085, 7482, 1569, 3313)], "tn long, fp long, fn long, tp long")).first()
    assert [round(got[c], 3) for c in ("accuracy", "precision", "recall", "f1")] == [0.658, 0.307, 0.679, 0.423]
    none = metrics.binary_metrics(rows(spark, [(5, 0, 0, 0)], "tn long, fp long, fn long, tp long")).first()
    assert (none["precision"], none["recall"], none["f1"], none["accuracy"]) == (0, 0, 0, 1)


def test_curves_with_ties(spark):
    data = [(0.9, True), (0.8, False), (0.8, True), (0.8, True), (0.3, False), (0.1, True), (0.1, False), (0.05, False)]
    counts = metrics.by_score(rows(spark, data, "s double, t boolean"), F.col("s"), F.col("t"))
    pos, neg = [s for s, t in data if t], [s for s, t in data if not t]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(metrics.roc_auc(counts).first()[0] - auc) < 1e-12
    ap, seen, hit = 0.0, 0, 0
    for s in sorted({x for x, _ in data}, reverse=True):
        here = [t for x, t in data if x == s]
        seen, hit = seen + len(here), hit + sum(here)
        ap += sum(here) / len(pos) * hit / seen
    assert abs(metrics.average_precision(counts).first()[0] - ap) < 1e-12
    assert metrics.best_f1(counts).first()["threshold"] == 0.8
    empty = metrics.by_score(rows(spark, [], "s double, t boolean"), F.col("s"), F.col("t"))
    assert metrics.average_precision(empty).first()[0] is None


def test_index_quantile_takes_an_element(spark):
    got = rows(spark, [(x,) for x in (4, 1, 3, 2)], "x int").agg(metrics.index_quantile(F.col("x"), 0.5).alias("m")).first()
    assert got["m"] == 3


def test_retrieval_counts_queries_without_results(spark):
    ranked = rows(spark, [(1, 1, False, True), (1, 2, True, False)], "query_id int, rank int, relevant boolean, noise boolean")
    got = {r["query_id"]: r for r in metrics.retrieval(ranked, rows(spark, [(1,), (2,)], "query_id int"), 5).collect()}
    assert (got[1]["rr"], got[1]["p_at_k"], got[1]["noise"], got[2]["returned"], got[2]["hit"], got[2]["rr"]) == (0.5, 0.2, 1, 0, 0, 0.0)


def test_published_ranks_give_published_means(spark):
    fused = [(i, 1) for i in range(26)] + [(26, 2), (27, 2), (28, 2), (29, 2)]
    ranked = rows(spark, fused, "query_id int, rank int").withColumn("relevant", F.lit(True)).withColumn("noise", F.lit(False))
    got = metrics.retrieval(ranked, spark.range(30).withColumnRenamed("id", "query_id"), 5).agg(F.avg("rr")).first()[0]
    assert round(got, 2) == 0.93


def test_cleaned_rankings_and_rerank(spark):
    assert value(spark, search.clean_ranking(F.lit("[2, 2, 9, x, 1]"), F.lit(3))) == [2, 1]
    assert value(spark, search.clean_ranking(F.lit("none"), F.lit(3))) is None
    fused = rows(spark, [(1, f"d{i}", i) for i in (1, 2, 3)] + [(2, "e1", 1)], "query_id int, doc_id string, rank int")
    replies = rows(spark, [(1, True, "[3]"), (2, False, "[1]")], "query_id int, ok boolean, content string")
    got = sorted(map(tuple, search.rerank(fused, replies, 2).collect()))
    assert got == [(1, "d1", 2), (1, "d3", 1), (2, "e1", 1)]


def test_cut_off_and_visibility(spark):
    found = rows(spark, [(1, 0.55, None), (2, 0.5, 0.6), (3, 0.5, 0.5)], "id int, similarity double, trigram double")
    assert sorted(r["id"] for r in search.cut_off(found, 0.55).collect()) == [1, 2]
    seen = rows(spark, [(1, None, None), (2, True, True), (3, False, False)], "id int, rag_visible boolean, is_noise boolean")
    assert [r["id"] for r in search.visible(seen).collect()] == [1]
    assert sorted(r["id"] for r in search.visible(seen, include_noise=True).collect()) == [1, 2]


def test_history_excludes_the_day_itself(spark):
    data = [(1, "2024-01-01", True), (1, "2024-01-01", False), (1, "2024-01-03", False), (2, "2024-01-02", True)]
    days = history.by_day(rows(spark, data, "p int, d string, bad boolean"), "p", F.to_date("d"), F.col("bad"))
    got = {(r["p"], str(r["day"])): (r["n_before"], r["rate_before"]) for r in history.before(days, "p").collect()}
    assert got == {(1, "2024-01-01"): (0, 0.0), (1, "2024-01-03"): (2, 0.5), (2, "2024-01-02"): (0, 0.0)}


def test_time_split_at_exact_shares(spark):
    shares = history.day_shares(spark.range(5).select(F.date_add(F.to_date(F.lit("2024-01-01")), F.col("id").cast("int")).alias("d")), F.col("d"))
    assert [r["part"] for r in history.time_split(shares).orderBy("day").collect()] == ["train", "train", "validation", "test", "test"]


def test_rules_for_notes(spark):
    fact = dict(visit_date="2024-01-02", time_slot="09:00 AM", doctor_name="Dr. A", specialization="ENT", patient_name="P Q", age=40, gender="female", diagnosis="Sinusitis", anchor_vital="temperature 101.2°F", anchor_occupation="tailor", anchor_context="dust at work in Khulna", other_vitals="pulse 80 bpm, weight 60 kg", comorbidity="none", advice="steam inhalation daily", plan_note=None, must_include=None, has_prescription=False, follow_up="after 7 days", chief_complaint_hint="blocked nose", length_words="10-60")
    good = "Visit note | 2024-01-02 09:00 AM | Dr. A, ENT | Patient: P Q, 40, female. Stuffy for days. A tailor with dust at work in Khulna. temperature 101.2°F, pulse 80 bpm, weight 60 kg. Assessment: sinusitis. Steam inhalation daily advised; no new medicine was prescribed. Return after 7 days."
    bad = good.replace("Khulna", "Dhaka").replace("tailor", "baker").replace("101.2", "100").replace("sinusitis", "flu") + ' Took "Napa" PAT-1'
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'string'}" for k, v in fact.items())
    data = rows(spark, [(*fact.values(), good), (*fact.values(), bad)], f"{schema}, content string")
    rules = validate.common(F.col("content")) + validate.visit_note(["Khulna", "Dhaka"], ["Napa"])
    first, second = validate.check(data, rules).collect()
    assert (first["errors"], first["warnings"]) == ([], [])
    assert {"double quote", "id", "vital", "occupation", "place", "diagnosis", "medicine"} <= set(second["errors"])


def test_rules_for_questions(spark):
    data = rows(spark, [("Q: When is Dr. Kabir in? A: Dr. Kabir sits at 9.30 on Sunday.", ["Kabir sits at 9.30"], "when sits Kabir", "3-20"), ("nothing", ["x"], "y", "3-20"), ("Q: When? A: On Sunday.", ["Kabir sits at 9.30"], "when", "3-20")], "content string, answer_facts array<string>, question_hint string, length_words string")
    got = [r["errors"] for r in validate.check(data, validate.faq()).collect()]
    assert got == [[], ["shape"], ["fact"]]


def test_noise_kinds(spark):
    got = noise.noise_rows(rows(spark, [("a", "faq", "some words that slip easily")], "doc_id string, record_type string, content string"), 5, 10)
    assert {r["noise_type"]: r["n"] for r in got.groupBy("noise_type").agg(F.count("*").alias("n")).collect()} == {"typo_duplicate": 1, "junk": 10, "off_topic": 10}
    assert got.where("content is null or content = ''").count() == 0


def test_vitals_render_every_kind(spark):
    kinds = rows(spark, [(k,) for k in clinical.VITALS], "k string")
    texts = [r[0] for r in kinds.select(clinical.vital(F.col("k"), F.lit(9), F.lit(1), F.lit(3), F.lit(60), F.lit(70))).collect()]
    assert len(texts) == 29 and not any("{" in t for t in texts)
    assert value(spark, clinical.vital(F.lit("none"), F.lit(9), F.lit(1), F.lit(3))) is None


def test_symptoms_without_names(spark):
    note = "Visit note | d | Dr. A, ENT | Patient: Rina Das, 40, female. Mrs. Das has a cough. Rina sleeps badly. On examination all is well."
    assert value(spark, T.symptom_text(F.lit(note), F.lit("Rina Das"))) == "The patient has a cough. the patient sleeps badly."
    assert value(spark, T.symptom_text(F.lit("plain words"), F.lit(None).cast("string"))) == "plain words"


def test_corpus_from_layers(spark):
    from quern.operators import corpus

    manifest = rows(spark, [(f"FAQ-{i}", "B01-M01" if i < 4 else "B01-M02", i, "faq", None, ["opens at 9"], "opening hours", "3-30", "Hours") for i in range(1, 7)], "doc_id string, slice string, position int, record_type string, group_id string, answer_facts array<string>, question_hint string, length_words string, faq_topic string")
    text = "Q: What are the opening hours of the {}? A: The {} clinic desk opens at 9 and closes late in the evening."
    said = [("FAQ-1", 0, text.format("north", "north")), ("FAQ-2", 0, "broken"), ("FAQ-2", 2, text.format("north", "north")), ("FAQ-4", 0, text.format("north", "north")), ("FAQ-5", 0, "Q: Different wording about opening hours? A: Doors are unlocked and it opens at 9 sharp."), ("FAQ-6", 0, "Q: no"), ("FAQ-9", 0, "x")]
    output = rows(spark, [("B01-M01" if d < "FAQ-4" else "B01-M02", layer, 1, d, "", "faq", t) for d, layer, t in said], "slice string, layer int, line int, doc_id string, group_id string, record_type string, content string")
    checked = corpus.validated(manifest, output, {"faq": validate.faq()})
    errors = {r["doc_id"]: r["errors"] for r in checked.collect()}
    assert errors == {"FAQ-1": ["near-duplicate"], "FAQ-2": ["near-duplicate"], "FAQ-3": ["missing"], "FAQ-4": ["near-duplicate"], "FAQ-5": [], "FAQ-6": ["shape"]}
    extra = output.join(manifest.select("doc_id"), "doc_id", "left_anti").select("doc_id", "slice")
    good, bad = corpus.build(checked, extra)
    assert [r["doc_id"] for r in good.collect()] == ["FAQ-5"] and good.columns == corpus.COLUMNS
    assert {r["doc_id"]: r["reason"] for r in bad.collect()}["FAQ-9"] == "not in manifest"
    report = validate.report(checked, "slice").orderBy("slice").first()
    assert (report["rows_expected"], report["rows_found"], report["rows_passed"], report["ok"]) == (3, 2, 0, False)


def test_first_row_of_a_slice_has_no_twin_within_it(spark):
    from quern.operators import corpus

    same = "Q: Same question about clinics? A: Identical answer with several longer content words."
    data = rows(spark, [("a", "s", 1, "faq", same), ("b", "s", 2, "faq", same), ("c", "s", 3, "prescription", same)], "doc_id string, slice string, position int, record_type string, content string")
    assert list(map(tuple, corpus.twins(data).collect())) == [("b", "a")]


def test_text_classifier_knows_rare_terms(spark):
    rng = random.Random(35)
    rows = []
    for i in range(3300):  # 5,000 words that say nothing come about ten times, the 1,800 that tell classes apart about five times
        words = [f"filler{rng.randrange(5000)}" for _ in range(17)] + [f"mark{2 * rng.randrange(900) + i % 2}" for _ in range(3)]
        rows.append((i, " ".join(rng.sample(words, 20)), "ab"[i % 2]))
    docs = spark.createDataFrame(rows, "id int, text string, label string")
    predict = textmodel.text_classifier(docs.where("id < 3000"), "text", "label")
    got = predict(docs.where("id >= 3000")).agg(F.avg((F.col("label") == F.col("predicted")).cast("int"))).first()[0]
    assert got > 0.9


def test_label_lists_and_passages(spark):
    from quern.operators import search

    asked = rows(spark, [(1, 1), (1, 2), (2, 1), (3, 1)], "batch int, place int")
    replies = rows(spark, [(1, 'so: ["a", "b"]'), (2, '["a", "b"]'), (3, None)], "batch int, content string")
    assert sorted(map(tuple, search.listed_labels(asked, replies).collect())) == [(1, 1, "a"), (1, 2, "b"), (2, 1, None), (3, 1, None)]
    listed = search.numbered_passages(rows(spark, [("q", 2, "y"), ("q", 10, "z"), ("q", 1, "x")], "q string, place int, text string"), "q", "place", F.col("text"))
    assert listed.first()["passages"] == "[1] x\n[2] y\n[10] z"


def test_similar_pairs_at_high_thresholds_join_by_parts(spark):
    import random

    from quern.operators import similarity

    draw = random.Random(5)
    sets = []
    for i in range(0, 400, 2):  # common words in all sets, and a near copy of each
        own = draw.sample(range(150), draw.randint(1, 90))
        sets += [(i, own), (i + 1, sorted({*own[draw.randint(0, 3) :], *draw.sample(range(150), draw.randint(0, 3))}))]
    df = spark.createDataFrame([(k, [f"w{x}" for x in s]) for k, s in sets if s], "k int, w array<string>")
    kept = {k: set(s) for k, s in sets if s}
    want = {(a, b) for a in kept for b in kept if a < b and 10 * len(kept[a] & kept[b]) >= 9 * len(kept[a] | kept[b])}
    got = [(r["left"], r["right"]) for r in similarity.similar_pairs(df, "k", "w", 9, 10).collect()]
    assert set(got) == want and len(got) == len(want) > 50
    found = similarity.parts(df, "k", "w", 9, 10)
    met = found.join(found.withColumnRenamed("k", "j"), "part").where("k < j").select("k", "j").distinct().count()
    assert met < 4 * len(want)  # single words in common would join nearly all pairs


def test_dense_search_by_blocks_equals_all_pairs(spark, monkeypatch):
    from quern.functions import numeric
    from quern.operators import search

    monkeypatch.setattr(search, "DENSE_BLOCK", 16)  # several blocks of both
    random.seed(9)
    vectors = [(i, [random.uniform(-1, 1) for _ in range(5)]) for i in range(150)]
    vectors += [(i, vectors[7][1]) for i in range(150, 200)] + [(200, None), (201, [])]  # ties, and nothing in common
    v = rows(spark, vectors, "doc_id long, embedding array<float>")
    asked = v.where("doc_id % 4 = 0").selectExpr("doc_id query_id", "embedding query_vector")
    plain = lambda df, k: sorted((r["query_id"], r["rank"], r["doc_id"], r["similarity"] or 9) for r in search.top(df, "similarity", k).collect())
    every = search.dense(asked, v).where("query_id <> doc_id").withColumn("similarity", numeric.round_to(F.col("similarity"), 6))
    some = lambda df: df.where("query_id < 200 and doc_id < 200")
    for k in (1, 7):
        assert plain(search.dense_top(asked.where("query_id < 200"), v.where("doc_id < 200"), k), k) == plain(some(every), k)
    whole = search.top(search.dense_top(asked, v, 250), "similarity", 250)
    assert whole.count() == asked.count() * (len(vectors) - 1)
    assert {r["doc_id"] for r in whole.where("query_id = 0 and similarity is null").collect()} == {200, 201}


def test_words_are_told_by_printable_ascii_first(spark):
    texts = ["", " ", "a b", "naïve\u00a0café\u2003x\ufeffy", "~!\t\n\x0b\x0c\r\x7f z", "\u3000é ü~", "".join(map(chr, range(0xD7FF)))]
    plain = T.WHITE.replace("[", "[^", 1)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.words(F.col("t")).alias("x"), F.regexp_extract_all("t", F.lit(plain), F.lit(0)).alias("y"), T.word_count(F.col("t")).alias("n")).collect()
    assert all(r["x"] == r["y"] and r["n"] == len(r["y"]) for r in got) and len(got) == len(texts)
    assert T.WORD.startswith("[!-~")


def test_met_sets_equal_brute_force_and_only_enough_leaves_a_task(spark):
    from quern.operators import similarity

    sets = [(i, [f"w{j}" for j in range(i % 9, 12)]) for i in range(60)] + [(3, ["w1", "w2"]), (4, []), (None, ["w9"]), (70, None), (71, ["v"])]
    items = [(i, [f"w{j}" for j in range(i, i + 3)]) for i in range(8)] + [(90, []), (91, ["v", "u"])]
    docs, asked = rows(spark, sets, "doc_id long, words array<string>"), rows(spark, items, "item_id long, words array<string>")
    for by_size, enough in ((True, lambda s, n, m: 4 * s >= n + m - s), (False, lambda s, n, m: s / m >= 0.5)):
        wanted = {}
        for d, x in sets:
            for i, y in items:
                if s := len(set(x or []) & set(y)):
                    key = (d, i, len(x) if by_size else 0, len(y))
                    wanted[key] = wanted.get(key, 0) + s
        got = {(r["doc_id"], r["item_id"], r["n"] if by_size else 0, r["m"]): r["shared"] for r in similarity.met(docs, asked, "words", enough, by_size).collect()}
        assert got == {k: s for k, s in wanted.items() if enough(s, k[2], k[3])}
