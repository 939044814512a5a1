"""Small cases of rules over chapters, headings, citations, caches, tables and scenario inputs."""

from datetime import datetime

from pyspark.sql import functions as F

from tessaria.functions import text as T
from tessaria.operators import catalog as K
from tessaria.operators import dedup as D
from tessaria.operators import facts as X
from tessaria.operators import quality as Q
from tessaria.operators import scenarios as C


def _set(df):
    return {tuple(r) for r in df.collect()}


def test_cleaners(spark):
    r = spark.createDataFrame([("  Ａb_c，(É-9) ",), (None,), ("",)], "t string").select(T.letters_and_digits(F.col("t")), T.no_list_marks(F.col("t"))).collect()
    assert [tuple(x) for x in r] == [("ａbcé9", "ａbc(é-9)"), (None, None), ("", "")]


def test_citations_of_chapters_and_of_the_summary(spark):
    ch = spark.createDataFrame([(3, "a [2] b [4-6][6] c [2021-2099] d [9-7] [x] [1, 2]"), (0, "[4-2] [5] [0-1] [11-1] [10-3]"), (7, None), (8, "[99999999999999999999999]")], "chapter_no int, content string")
    assert _set(T.cited_sources(ch)) == {(3, 2), (3, 4), (3, 5), (3, 6), (4, 2), (10, 3)}
    assert T.cited_sources(ch.limit(0)).count() == 0


def test_a_first_heading_that_repeats_the_title_goes(spark):
    rows = [("\n ## 二、 Market size ##\ntext", "Market Size", "\ntext"), ("# Size\nx", "Market size", "x"), ("# Market size and more\nx", "market size", "x"), ("# 第3章 other\nx", "t", "x"),
            ("# Other\n# Market\nx", "Market", "# Other\n# Market\nx"), ("text\n# Market", "Market", "text\n# Market"), ("# 、\nx", "Market", "# 、\nx"), ("# Any\nx", "", "# Any\nx"), ("# Any\nx", None, "# Any\nx"), ("", "t", ""), (None, "t", None)]
    got = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, x string, t string").select("i", T.without_outer_heading(F.col("x"), F.col("t"))).collect()
    assert [r[1] for r in sorted(got)] == [r[2] for r in rows]


def test_year_tables_and_mixed_scopes(spark):
    rows = "### 市场规模与增速\n- 2022年微短剧市场：101.7亿元\n- 2023年：373.9亿元\n- 2024年：504.4亿元"
    ch = [("r", 1, rows), ("r", 4, rows), ("r", 5, rows + "\n- 2025年：AI漫剧市场规模189.8亿元"), ("r", 2, "### 其他\n" + rows.split("\n", 1)[1]), ("r", 6, None), ("r", 7, rows + "\n### 市场规模增长\n- 2025年：AI漫剧市场规模1亿元"), ("q", 2, "### 市场规模增长\n- 2021年：全球设备市场规模1\n- 2022年：设备市场规模1")]
    df = spark.createDataFrame([(*x, "extra") for x in ch], "report string, chapter int, text string, n string")
    assert _set(Q.series_rules(df)) == {("r", 1, True, False), ("r", 4, False, False), ("r", 5, False, True), ("r", 2, False, False), ("r", 6, False, False), ("r", 7, False, False), ("q", 2, False, False)}


def test_tables_go_by_their_header(spark):
    docs = spark.createDataFrame([(1, "a\n| x | score |\n| 1 | 2 |\nb\n| y |\n| 3 |\n| score |"), (2, "| score |\nscore"), (3, "| score |\n| 1 |"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["cut"]) for r in Q.without_conclusions(docs, "never", "^never$", "N", header="score").collect()}
    assert got == {1: ("a\nb\n| y |\n| 3 |\n| score |\nN", True), 2: ("| score |\nscore", False), 3: ("N", True), 4: ("", False)}


def test_cells_keep_their_header(spark):
    b = spark.createDataFrame([(1, 0, "a | b"), (1, 1, "x | x | x"), (1, 2, "text"), (1, 3, "c | d"), (2, 0, "e | f"), (2, 1, None)], "doc_id int, ordinal int, text string")
    got = _set(K.table_cells(b).select("doc_id", "table", "row", "col", "header", "text"))
    assert got == {(1, 1, 1, 0, "a", "a"), (1, 1, 1, 1, "b", "b"), (1, 1, 2, 0, "a", "x"), (1, 1, 2, 1, "b", "x"), (1, 1, 2, 2, None, "x"), (1, 2, 1, 0, "c", "c"), (1, 2, 1, 1, "d", "d"), (2, 1, 1, 0, "e", "e"), (2, 1, 1, 1, "f", "f")}


def test_cache_is_replaced_by_key(spark):
    now, t = F.lit("2025-01-08").cast("timestamp"), datetime
    answers = spark.createDataFrame([("p", "d", "1", "first", t(2025, 1, 1)), ("p", "d", "1", "last", t(2025, 1, 2)), ("q", "d", "1", "other", t(2025, 1, 1))], "provider string, dataset string, params string, answer string, asked timestamp")
    cache = K.put_cache(answers.limit(0).select(F.lit("k").alias("cache_key"), "provider", "answer", now.alias("stored"), now.alias("expires")), answers, now, {"q": "30 days"})
    assert {r["answer"]: r["expires"] for r in cache.collect()} == {"last": t(2025, 1, 15), "other": t(2025, 2, 7)}
    again = K.put_cache(cache, answers.filter("provider = 'p'").withColumn("answer", F.lit("new")), F.lit("2025-02-01").cast("timestamp"), {})
    assert {r["answer"]: r["expires"] for r in again.collect()} == {"new": t(2025, 2, 8), "other": t(2025, 2, 7)}
    assert {r["answer"] for r in K.live_cache(again, F.lit("2025-02-07 12:00:00").cast("timestamp")).collect()} == {"new"}


def test_refused_changes(spark):
    ch = spark.createDataFrame([(1, "edit", "x"), (1, "trash", None), (2, "edit", "x"), (3, "edit", None), (9, "trash", None)], "block_id int, action string, text string")
    blocks = spark.createDataFrame([(1, "image"), (2, None), (3, "image")], "block_id int, kind string")
    assert _set(K.refused_changes(ch, blocks).select("block_id", "action", "reason")) == {(1, "edit", "image_text"), (9, "trash", "no_block")}


def test_market_inputs_are_checked(spark):
    s = spark.createDataFrame([("s", "site", "t", "home", 2024)], "scenario string, base_unit string, demand_unit string, scope string, year int")
    good = [("base", 1, "site"), ("unit_demand", 1, "t/site"), ("unit_price", 1, "元/t"), ("effective_capacity", 1, "t"), ("acquisition_rate_pct", 100, "%"), ("product_fit_pct", None, "%")]
    rows = [("s", *x, "home", 2024) for x in good]
    bad = [("s", "base", 1, None, "home", 2024), ("s", "base", 1, "site", None, None), ("s", "mood", 1, "%", "home", 2024), ("s", "product_fit_pct", 101, "%", "home", 2023), ("z", "base", 1, "site", "home", 2024)]
    kind = "scenario string, key string, value int, unit string, scope string, year int"
    assert _set(C.market_problems(spark.createDataFrame(rows, kind), s)) == set()
    assert _set(C.market_problems(spark.createDataFrame(rows + bad, kind), s)) == {("s", "base", "unit"), ("s", "base", "scope"), ("s", "base", "year"), ("s", "mood", "unknown_key"), ("s", "product_fit_pct", "percentage"), ("s", "product_fit_pct", "year"), ("z", "base", "no_scenario")}


def test_city_inputs_are_checked(spark):
    ind = spark.createDataFrame([("s", "a", "33.4", "km"), ("s", "b", "66.6", "t"), ("w", "a", "99.9", "km"), ("v", "a", "50", "km"), ("v", "a", "50", "km"), ("u", "a", None, "km")], "scenario string, indicator string, w string, unit string").withColumn("weight", F.col("w").cast("decimal(9,3)"))
    cities = spark.createDataFrame([("s", "x"), ("s", "y"), ("w", "x"), ("w", "x"), ("v", " "), ("u", "x")], "scenario string, city string")
    cells = spark.createDataFrame([("s", "a", "x", "km", "all"), ("s", "b", "y", "t", None), ("s", "b", "x", "km", ""), ("s", "c", "x", "km", ""), ("s", "a", "z", "km", "here")], "scenario string, indicator string, city string, unit string, scope string")
    got = _set(C.city_problems(cells, ind, cities, spark.createDataFrame([("s", "all")], "scenario string, scope string")))
    assert got == {("w", None, None, "weights"), ("u", None, None, "weights"), ("v", "a", None, "indicator_repeats"), ("w", None, "x", "city_repeats"), ("v", None, " ", "no_name"),
                   ("s", "b", "x", "unit"), ("s", "c", "x", "unknown_indicator"), ("s", "a", "z", "unknown_city"), ("s", "a", "z", "scope")}


def test_names_are_checked_against_targets(spark):
    kind = "doc_id int, company_key string, title_key string, deleted boolean, superseded boolean"
    rows = spark.createDataFrame([(1, "c", "t", False, False), (2, "c", "t", True, True), (3, "c", "t", True, False), (4, "d", "t", None, None), (5, "c", None, False, False)], kind)
    new = spark.createDataFrame([(9, "c", "t", None), (8, "c", "t", 1), (7, "c", "u", 3), (6, "c", "u", 4), (10, "c", "u", 77), (5, "c", None, None), (1, "c", "t", 3)], "doc_id int, company_key string, title_key string, target int")
    assert _set(D.name_check(rows, new)) == {(9, "name_conflict", 1), (9, "name_conflict", 3), (8, "name_conflict", 3), (7, "invalid_version", 3), (6, "invalid_version", 4), (10, "invalid_version", 77), (1, "invalid_version", 3)}


def test_claims_that_a_quote_does_not_hold_are_replaced(spark):
    c = spark.createDataFrame([(1, "In **North land**, 3 t", " north  Land", "t"), (2, "In South", "North", None), (3, None, "North", ""), (4, "x", "", "x")], "id int, quote string, geography string, scope string")
    assert _set(X.supported_by_quote(c, {"geography": None, "scope": "as quoted"}).drop("quote")) == {(1, "north Land", "t"), (2, None, "as quoted"), (3, None, "as quoted"), (4, None, "x")}


def test_query_budget(spark):
    ch = spark.createDataFrame([(1, 3), (1, 4), (2, 3)], "project_id int, chapter_no int")
    saved = spark.createDataFrame([(1, 3), (1, 3), (1, 4)], "project_id int, chapter_no int")
    assert _set(K.query_budget(ch, saved, 4)) == {(1, 3, 3), (1, 4, 4), (2, 3, 4)} and _set(K.query_budget(ch, saved, 1)) == {(1, 3, 1), (1, 4, 1), (2, 3, 1)}
