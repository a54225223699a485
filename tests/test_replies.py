"""Replies: typed verdicts in prose, and a two-hop plan with every branch."""

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import replies
from tests.test_operators import rows, value


def test_complex_questions_and_answers_that_give_up(spark):
    yes = ["fees and hours", "A or both?", "compare x", "is it open? is it near?", "x vs. y", "what about sundays", "how do I book, then pay", "y" * 121, "also z", "in addition w"]
    no = ["opening hours", "sandwich", "  " + "x" * 118 + "  ", "brand new thenar", "is it open?"]
    assert [value(spark, T.is_complex(F.lit(q))) for q in yes + no] == [True] * len(yes) + [False] * len(no)
    assert [value(spark, T.gives_up(F.lit(a))) for a in ("I DO NOT know", "could not find it", "I don't know")] == [True, True, False]


def test_snippets_in_both_orders(spark):
    text = F.lit("a  b   c d")
    assert value(spark, T.snippet(text, 4)) == "a b " and value(spark, T.snippet(text, 4, collapse_first=False)) == "a b"


def test_verdicts_of_every_kind(spark):
    said = [
        ("ok", True, 'Well: {"score": 4, "flag": true, "reason": "fine"} indeed', None), ("text", True, '{"score": " 2.5 ", "flag": "true"}', None), ("zero", True, '{"score": 0}', None),
        ("word", True, '{"score": "high"}', None), ("bad", True, '{"score": 4', None), ("braces", True, "{no: json}", None), ("none", True, "no object", None), ("failed", False, '{"score": 4}', "timeout"), ("null", None, None, None),
    ]
    keys = rows(spark, [(k[0],) for k in said] + [("missing",), ("unanswered",), ("silent",)], "k string")
    answers = rows(spark, [(k[0], True) for k in said] + [("missing", True), ("unanswered", False)], "k string, ok boolean")
    verdicts = rows(spark, said + [("unanswered", True, '{"score": 5}', None)], "k string, ok boolean, content string, error string")
    got = {r["k"]: (r["state"], r["score"], r["flag"], r["reason"]) for r in replies.judged(keys, answers, verdicts, ["k"], ["score"], ["flag"]).collect()}
    assert got == {
        "ok": ("judged", 4.0, True, "fine"), "text": ("judged", 2.5, False, "unparsed"), "zero": ("partial", None, False, "unparsed"), "word": ("partial", None, False, "unparsed"),
        "bad": ("unparsed", None, False, "unparsed"), "braces": ("unparsed", None, False, "unparsed"), "none": ("unparsed", None, False, "unparsed"), "failed": ("failed", None, False, "timeout"),
        "null": ("failed", None, False, "unparsed"), "missing": ("failed", None, False, "unparsed"), "unanswered": ("no answer", None, None, None), "silent": ("no answer", None, None, None),
    }
    means = replies.verdict_means(replies.judged(keys, answers, verdicts, ["k"], ["score"]), [], ["score"]).first()
    assert (means["n"], means["no_answer"], means["failed"], means["unparsed"], means["partial"], means["judged"], means["score"]) == (12, 2, 3, 3, 2, 2, 3.25)


def test_lists_of_texts(spark):
    read = lambda s: value(spark, replies.text_list(replies.reply_object(F.lit(s)), "queries", 2))
    assert read('{"queries": [" a  b ", 7, "A B", "", "c", "d"]}') == ["a b", "c"] and read('{"queries": "a"}') is None and read('{"queries": [1, " "]}') is None and read("{}") is None and read("x") is None
    assert len(read('{"queries": ["' + "z" * 400 + '"]}')[0]) == 300


def test_two_hops_take_every_branch(spark):
    items = rows(spark, [("plain", "hours"), ("model", "a and b"), ("failed", "a and c"), ("nothing", "zzz"), ("denied", "a and b"), ("typed", "a"), ("broken", "b"), ("gives up", "c"), ("no answer", "d")], "item_id string, question string")
    found = rows(spark, [("hours", "d1", 0.9, 1), ("a", "d2", 0.5, 1), ("a", "d3", 0.4, 2), ("b", "d2", 0.8, 1), ("c", "d4", 0.7, 1), ("d", "d5", 0.6, 1), ("a and c", "d6", 0.3, 1), ("more", "d7", 0.95, 1), ("more", "d2", 0.1, 2)], "query string, doc_id string, similarity double, rank int")
    yes = '{"supported": true}'
    said = rows(
        spark,
        [
            ("plan", "plain", True, '{"queries": ["a"]}'), ("plan", "model", True, '{"queries": ["a", "b", "c"]}'), ("plan", "failed", False, '{"queries": ["a"]}'), ("plan", "denied", True, '{"queries": []}'),
            ("followup", "model", True, 'ask {"queries": ["more"]}'), ("followup", "plain", True, '{"queries": ["more"]}'), ("followup", "failed", False, '{"queries": ["more"]}'),
            ("support", "plain", True, yes), ("support", "model", True, yes), ("support", "failed", True, yes), ("support", "nothing", True, yes), ("support", "denied", True, '{"supported": false}'),
            ("support", "typed", True, '{"supported": "true"}'), ("support", "broken", True, '{"supported": tru'), ("support", "gives up", True, yes), ("support", "no answer", True, yes),
            ("answer", "plain", True, " Nine. "), ("answer", "model", True, "Yes."), ("answer", "failed", True, "So."), ("answer", "gives up", True, "I do not know"), ("answer", "no answer", False, "late"),
        ],
        "step string, item_id string, ok boolean, content string",
    )
    merged, outcome = replies.two_hops(items, said, lambda asked: asked.join(found, "query"))
    got = {r["item_id"]: (r["complex"], r["plan_source"], r["n_queries"], r["n_followups"], r["n_contexts"], r["support_source"], r["refused"], r["answer"]) for r in outcome.collect()}
    no = replies.REFUSE_MESSAGE
    assert got == {
        "plain": (False, "heuristic", 1, 0, 1, "model", False, "Nine."), "model": (True, "model", 2, 1, 3, "model", False, "Yes."), "failed": (True, "fallback", 1, 0, 1, "model", False, "So."),
        "nothing": (False, "heuristic", 1, 0, 0, "empty", True, no), "denied": (True, "model", 1, 0, 0, "empty", True, no), "typed": (False, "heuristic", 1, 0, 2, "fallback", True, no),
        "broken": (False, "heuristic", 1, 0, 1, "fallback", True, no), "gives up": (False, "heuristic", 1, 0, 1, "model", True, no), "no answer": (False, "heuristic", 1, 0, 1, "model", True, no),
    }
    assert sorted((r["rank"], r["doc_id"], r["hop"], r["similarity"]) for r in merged.where("item_id = 'model'").collect()) == [(1, "d7", 2, 0.95), (2, "d2", 1, 0.8), (3, "d3", 1, 0.4)]


def test_plan_trims_as_it_is_told(spark):
    from pyspark.sql import functions as F

    from quern.operators import replies

    items = spark.createDataFrame([(1, "x" * 119 + "\n\n ")], "item_id long, question string")
    said = spark.createDataFrame([], "step string, item_id long, ok boolean, content string")
    assert [replies.plan(items, said, *t).first()["complex"] for t in ([], [F.btrim])] == [False, True]


def test_two_hops_equal_their_sql_on_odd_texts_and_numbers(spark, tmp_path):
    """Letters whose capitals are two, Greek ends, other spaces and word edges, null turns, and items below 0 or without a number."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quern.plans import replies as plans
    from tests.oracle import compare

    filler = "Das große Maß und die Straße, alpha beta gamma delta, Ende naht; epsilon zeta eta theta iota kappa lambda my ny xi omikron pi rho sigma"
    texts = [
        "beß geä beß große maß des, " + filler, "ΟΔΟΣ οδος alpha and beta ΣΑΣ. " + filler, "ΟΔΟς alpha and beta, " + filler, "İstanbul ist groß, also alpha. " + filler, "ŉ ǰ ΐ ᾀ ᾈ ᾳ ﬁ ﬀ ᾲ ſ K ƛ alpha and beta " + filler, "äand alpha ßalso beta",
        "alpha aſ well aſ beta", "pluſ gamma", " 　" + "x" * 119 + " ", "\t" + "y" * 118 + "\n", "alpha and　beta gamma﻿ delta " + filler, "do not Know alpha", "　" * 60 + "alpha and beta" + "　" * 60, "", 'quote " and \\ back {brace} } alpha', "alpha? beta?",
    ]
    ids = [0, 6, 12, 18, 24, -1, -2, -3, -6, -12, 30, 36, None, 42, 48, 1 << 62, 54, 60, 66, 72]
    turns = [(c, 1, "user", texts[(i + j) % len(texts)]) for j in range(4) for i, c in enumerate([None if x is None else x + 6 * 1000 * j for x in ids] if j else ids)]
    turns = list({t[0]: t for t in turns}.values()) + [(0, None, "user", "never first"), (7, None, "user", "only one, and null"), (8, 0, "user", None)]
    names = ["conv_id", "turn", "role", "text"]
    docs = [(i, t) for i, t in enumerate(texts + [filler, "GROẞE maß", "GROSSE MASS", "alpha beta gamma", "istanbul", "stanbul"])] + [(None, "alpha beta gamma"), (3, "alpha"), (None, None)]
    empty = pa.table({"x": pa.array([], pa.int64())})
    for name in "region nation customer supplier part orders lineitem events embeddings pages benchmark labels".split():
        pq.write_table(empty, f"{tmp_path}/{name}.parquet")
    pq.write_table(pa.table(dict(zip(names, map(list, zip(*turns)))), pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])), f"{tmp_path}/conversations.parquet")
    pq.write_table(pa.table(dict(zip(["doc_id", "text"], map(list, zip(*docs)))), pa.schema([("doc_id", pa.int64()), ("text", pa.string())])), f"{tmp_path}/documents.parquet")
    for name in ("two_hop_contexts", "two_hop_outcomes"):
        ours, theirs = compare(spark, plans.QUERIES[name], plans.ORACLES[name], str(tmp_path))
        assert ours == theirs and ours


def test_letters_change_case_as_in_sql(spark):
    import duckdb
    import pyarrow as pa

    from quern.plans import replies as plans

    letters = [chr(i) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000]
    table = pa.table({"c": letters})
    theirs = duckdb.from_arrow(table).query("t", "SELECT c, upper(c), trim(c) FROM t").fetchall()
    ours = spark.createDataFrame(table).select("c", F.expr(plans._UPPER["spark"].format("c")), T.without_spaces(F.col("c"))).collect()
    assert sorted(map(tuple, ours)) == sorted(theirs)
