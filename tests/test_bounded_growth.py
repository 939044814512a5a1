"""What operators write, shuffle or hold grows no faster than their input (findings of the third round)."""

from tessaria.functions import math_text as M
from tessaria.operators import dedup as D
from tessaria.operators import quality as Q
from tessaria.operators import repetition as R
from tessaria.operators import retrieval as T


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lineage_stores_no_reach_of_documents_that_are_no_starts(spark, monkeypatch):
    rows, real = [], D.cut
    monkeypatch.setattr(D, "cut", lambda df, folder, name: rows.append(df.count()) or real(df, folder, name))
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)], "new_document_id long, previous_document_id long")
    got = {(r["start"], r["ancestor"]) for r in D.lineage(edges, spark.createDataFrame([(200,)], "doc_id long")).collect()}
    assert got == {(200, i) for i in range(200)}
    assert sum(rows) < 10 * 200  # the whole reach has 20,100 pairs


def test_lineage_with_a_cycle_two_starts_and_a_meeting_of_branches(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8), (9, 7), (8, 6), (7, 6), (6, 5)], "new_document_id long, previous_document_id long")
    got = sorted((r["start"], r["ancestor"]) for r in D.lineage(edges, spark.createDataFrame([(1,), (9,), (9,), (40,)], "doc_id long")).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (9, 5), (9, 6), (9, 7), (9, 8)]


def test_issues_find_keys_once_and_count_within_unnamed_reports(spark):
    long = "Every branch of the trade depends on cost and on terms of payment"
    rows = [(None, 1, f"{long} a。{long} b。\n- one 12345\n- one 12345\n- two 12345"), (None, 2, f"{long} b。{long} a。{long} a。\n- two 12345\n- two 12345"), ("r", 3, f"{long} a。"), ("r", 4, None)]
    df = R.issues(spark.createDataFrame(rows, "report string, chapter long, text string"))
    plan = _plan(df)
    assert plan.count("Generate ") == 1 and plan.count("Join ") == 1
    n = len(long.replace(" ", "")) + 1
    assert {r["chapter"]: (r["repeated"], r["repeated_chars"], r["chars"], r["repeated_rows"], r["prose_issue"]) for r in df.collect()} == {1: (0, 0, 2 * n, 1, False), 2: (3, 3 * n, 3 * n, 1, True), 3: (0, 0, n, 0, False), 4: (0, 0, 0, 0, False)}


def test_series_rules_need_neither_sort_nor_exchange(spark):
    text = "### 市场规模与增长\n- 2021年设备市场规模1亿\n- 2022年：零件市场规模2亿\n# 其他\n- 2023年：3亿"
    df = Q.series_rules(spark.createDataFrame([("r", 1, text), (None, 2, text), ("r", 3, None)], "report string, chapter long, text string"))
    assert not any(x in _plan(df) for x in ("Window", "Join", "Aggregate", "Generate"))
    assert sorted((r["chapter"], r["year_table"], r["mixed_scopes"]) for r in df.collect()) == [(1, False, True), (2, False, True), (3, False, False)]


def test_repetition_scores_do_not_join_keys_with_their_places(spark):
    s = spark.createDataFrame([(1, 0, "A long sentence!", "k"), (1, 1, "A long sentence.....", "k"), (2, 0, "a longsentence", "k"), (2, 1, "Another", "j")], "doc_id long, pos int, sentence string, key string")
    df = D.repetition_scores(s)
    assert _plan(df).count("Join ") == 1
    assert {r["doc_id"]: (r["chars"], r["repeated"], r["repeated_chars"]) for r in df.collect()} == {1: (36, 1, 20), 2: (21, 1, 14)}


def test_document_frequencies_do_not_shuffle_postings(spark):
    d = spark.createDataFrame([(1, "alpha beta alpha"), (2, "alpha"), (3, None), (4, "")], "doc_id long, text string")
    df = T.term_statistics(d, "doc_id")[1]
    assert _plan(df).count("Aggregate ") == 1
    assert {r["term"]: r["df"] for r in df.collect()} == {"alpha": 2, "beta": 1}
    twice = d.unionByName(spark.createDataFrame([(1, "alpha gamma")], "doc_id long, text string"))
    assert {r["term"]: r["df"] for r in T.term_statistics(twice, "doc_id")[1].collect()} == {"alpha": 2, "beta": 1, "gamma": 1}


def test_math_text_reads_a_run_of_words_as_one_token():
    assert len(M._TOKEN.findall("one two  three\nfour")) == 1
    assert M.read_math("$ a  b $ \\$5 and \\$$x$ \\( c \\) d") == "a  b $5 and $x c d"


def test_short_data_rows_have_no_key_and_chapters_are_cut_once(spark):
    rows = [(1, "- 1\n- 22\n- key 333\n| 4 |"), (2, "- 1\n- 22\n- key 333\n| 4 |\nown"), (3, None)]
    d = spark.createDataFrame([("r", *x) for x in rows], "report string, chapter long, text string")
    assert {r["chapter"]: r["repeated_rows"] for r in R.issues(d).collect()} == {1: 0, 2: 1, 3: 0}
    df = R.without_repeats(d)
    assert "Window" not in _plan(df) and _plan(df).count("Join ") == 2
    assert {r["chapter"]: (r["text"], r["removed"]) for r in df.collect()} == {1: (rows[0][1], 0), 2: ("- 1\n- 22\n| 4 |\nown", 1), 3: ("", 0)}
