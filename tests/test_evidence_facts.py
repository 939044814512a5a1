from pyspark.sql import functions as F

from tessaria.functions import text as T
from tessaria.operators import catalog as K
from tessaria.operators import evidence as E
from tessaria.operators import facts as X
from tessaria.operators import quality as Q
from tessaria.operators import retrieval as R

EV = "id long, project_id long, chapter_no long, title string, url string, publisher string, source_type string, search_query string, score double, excerpt string"


def _ev(spark, *rows):
    return spark.createDataFrame([(i, 1, 1, "t", r.get("url"), r.get("publisher"), r.get("type", "web"), "q", 0.5, r.get("excerpt", "")) for i, r in enumerate(rows)], EV)


def test_grades_and_look_alike_hosts(spark):
    ev = _ev(spark, {"url": "https://gov.example.org/a?utm_source=x"}, {"url": "https://GOV.example.org/a/"}, {"publisher": "Valley University"}, {"url": "https://docs.example.net/1"}, {"url": "https://notgov.example.org/a"}, {})
    rows = E.classify(ev).orderBy("id").collect()
    assert [r["grade"] for r in rows] == ["A", "A", "B", "D", "C", "D"]
    assert rows[0]["origin_key"] == rows[1]["origin_key"]
    a = E.audit(E.classify(ev), ["project_id"]).first()
    assert (a["n_a"], a["ab_origins"], a["ready"]) == (2, 2, True)


def test_conflicts_need_same_year_unit_and_subject(spark):
    say = lambda y, s, v: {"excerpt": f"In {y} the {s} revenue was {v} thousand."}
    c = lambda *rows: {r["id"] for r in E.conflicts(E.claim_keys(_ev(spark, *rows))).collect()}
    assert c(say(2020, "north", 100), say(2020, "north", 120), say(2021, "north", 130)) == {0, 1}
    assert c(say(2020, "north", "1,000"), say(2020, "north", 1000), say(2020, "south", 7)) == set()


def test_duplicates_keep_signs(spark):
    got = [r["duplicate_of"] for r in E.duplicate_owner(_ev(spark, {"excerpt": "Down -10%"}, {"excerpt": "down  -10%"}, {"excerpt": "down 10%"}, {}, {})).orderBy("id").collect()]
    assert got == [None, 0, None, None, None]


def test_growth_of_exact_points_only(spark):
    def rec(i, quote, scope="all", conflict=False):
        return (f"r{i}", "market", "Demand", scope, "", conflict, quote, [f"{i}"])

    rows = [rec(0, "In 2022 it was 100 thousand"), rec(1, "In 2024 it was 121 thousand"), rec(2, "In 2023 it was about 110 thousand"), rec(3, "In 2023 it was 5 thousand", conflict=True), rec(4, "From 2020 to 2021 it was 7 thousand")]
    r = spark.createDataFrame(rows, "record_id string, record_type string, metric string, scope string, geography string, conflict boolean, quote string, evidence_ids array<string>")
    ev = r.select(F.get("evidence_ids", F.lit(0)).alias("id"), F.concat(F.lit("x "), "quote").alias("excerpt"), F.lit("o").alias("origin_key"))
    atoms = X.fact_atoms(r, ev)
    assert [x["reason"] for x in atoms.orderBy("record_id").collect()] == [None, None, "not_a_point", "conflict", "not_a_point"]
    g = X.growth(X.yearly_series(atoms)).first()
    assert abs(g["cagr"] - 10) < 1e-9 and g["periods"] == 2


def test_text_series_and_ambiguity(spark):
    text = "# Market\nIn 2020 the revenue was 5 thousand.\nIn 2021 it was 6 thousand.\nIn 2022 and 2023 respectively it was 7 thousand."
    s = X.text_series(X.lines_of(spark.createDataFrame([(1, text)], "doc_id long, text string")), ["revenue"]).collect()
    assert len(s) == 1 and s[0]["points"] == 2


def test_table_without_unit_gives_no_series(spark):
    t = lambda h, c: f"| Year | {h} |\n|---|---|\n| 2020 | 1 |\n| 2021 | {c} |"
    d = spark.createDataFrame([(1, t("Sales (km)", "2")), (2, t("Sales", "2")), (3, t("Sales (km)", "2-3"))], "doc_id long, text string")
    assert [r["doc_id"] for r in X.table_series(X.tables(d)).collect()] == [1]


def test_bm25_finds_the_row(spark):
    d = spark.createDataFrame([(1, "apples and pears"), (2, "pears and plums"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(9, "plums plums"), (8, "nothing")], "query_id long, text string")
    assert [(r["query_id"], r["doc_id"]) for r in R.bm25(d, q, "doc_id").collect()] == [(9, 2)]


def test_packing(spark):
    r = spark.createDataFrame([(["aaaa", "bb", "cccccc", "d"],)], "x array<string>").select(R.pack_flush(F.col("x"), 6).alias("f"), R.pack_skip(F.col("x"), 6).alias("s")).first()
    assert r["f"] == [0, 0, 1, 2] and r["s"] == [True, True, False, False]


def test_guarded_upsert_and_copy(spark):
    o = spark.createDataFrame([(1, "a", True, False), (2, "b", True, True), (3, "c", True, False), (4, "d", False, False)], "k long, value string, managed boolean, verified boolean")
    n = spark.createDataFrame([(1, "x"), (2, "y"), (5, "z")], "k long, value string")
    got = {r["k"]: (r["value"], r["action"]) for r in K.guarded_upsert(o, n, "k").collect()}
    assert got == {1: ("x", "updated"), 2: ("b", "skipped"), 3: ("c", "deleted"), 4: ("d", "kept"), 5: ("z", "created")}
    assert K.verify_copy(o, o.repartition(3)).first()["equal"] and not K.verify_copy(o, o.limit(3)).first()["equal"]


def test_text_functions(spark):
    d = spark.createDataFrame([("  Ａ(B)．docx ", "http://WWW.Ex.org/a/?utm_x=1&b=2&ref=3#t", "see [1], [3-5] and [1-99]", r"$\frac{\frac{1}{2}}{3} \times 4$")], "n string, u string, c string, m string")
    r = d.select(T.name_key(F.col("n")).alias("n"), T.url_for_grading(F.col("u")).alias("g"), T.url_for_collection(F.col("u")).alias("u"), T.citations(F.col("c")).alias("c"), T.plain_math(F.col("m")).alias("m")).first()
    assert (r["n"], r["g"], r["u"], r["c"], r["m"]) == ("a(b)", "http://www.ex.org/a?b=2&ref=3", "http://ex.org/a?b=2", [1, 3, 4, 5], "((1) ÷ (2)) ÷ (3) × 4")


def test_quality_rules(spark):
    d = spark.createDataFrame([(1, "Too short"), (2, "A long text " * 20 + "ends well."), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["i"] for r in d.select("doc_id", Q.blocking(Q.chapter_rules(F.col("text")), Q.content_rules(F.col("text"))).alias("i")).collect()}
    assert got == {1: ["unfinished", "too_short"], 2: [], 3: []}


def test_cards_account_for_every_value_of_a_quote(spark):
    claim = lambda *c: [dict(zip(("whole", "value", "unit"), x)) for x in c]
    two = claim(("5 thousand", "5", "thousand"), ("6 thousand", "6", "thousand"))
    rows = [("a", "In 2020 the revenue was 5 thousand, in 2021 it was 6 thousand.", ["1"], False, two, None, None, None), ("b", "In 2020 the revenue was 5 thousand, in 2021 it was 6 thousand.", ["1"], False, two[:1], None, None, None),
            ("c", "In 2020 the revenue was 5 thousand, the cost 6 thousand.", ["1"], False, two, None, None, None), ("d", "The price was 7 thousand.", ["1"], False, None, "7.0", "thousand", "2019"),
            ("e", "The price was 7 thousand.", ["1"], False, None, "8", "thousand", None), ("f", "The price was 7 thousand, or 7 thousand.", ["1"], False, None, "7", "thousand", None),
            ("g", "The price was 7 thousand.", ["1", "2"], False, None, "7", "thousand", None), ("h", "The price was 7 thousand.", ["1"], True, None, "7", "thousand", None), ("i", None, ["1"], False, two, None, None, None),
            ("j", "The price was 7 thousand.", [], False, None, "7", "thousand", None), ("k", "The price was 7 thousand.", None, None, [], "7", "thousand", None),
            ("l", "In 2021 the steel revenue was 6 thousand and in 2020 the revenue was 5 thousand.", ["1"], False, two, None, None, None)]
    r = spark.createDataFrame(rows, "record_id string, quote string, evidence_ids array<string>, conflict boolean, claims array<struct<whole:string,value:string,unit:string>>, value string, unit string, period string").withColumn("metric", F.lit("Base"))
    ev = spark.createDataFrame([("1", " ".join(x[1] or "" for x in rows)), ("2", None)], "id string, excerpt string")
    got = sorted((x["record_id"], x["kind"], x["metric"], tuple(x["labels"]), tuple(int(v) for v in x["values"])) for x in X.fact_cards(r, ev).collect())
    assert got == [("a", "card", "Base", ("2021",), (6,)), ("a", "card", "revenue", ("2020",), (5,)), ("a", "series", "Base", ("2020", "2021"), (5, 6)),
                   ("c", "card", "cost", ("2020",), (6,)), ("c", "card", "revenue", ("2020",), (5,)), ("d", "card", "Base", ("2019",), (7,)),
                   ("l", "card", "revenue", ("2020",), (5,)), ("l", "card", "steel revenue", ("2021",), (6,)), ("l", "series", "Base", ("2020", "2021"), (5, 6))]
    assert X.fact_cards(r.limit(0), ev).count() == 0
