import datetime



from tessaria.operators import scenarios as C

FACT = "scenario string, key string, value decimal(20,6), source string, origin_id string, date date, basis string, verified boolean, conflict boolean"


def _facts(spark, scenario, values, **change):
    from decimal import Decimal

    rows = [(scenario, k, Decimal(v), "book", "o1", datetime.date(2024, 1, 1), change.get(k, "reported"), True, False) for k, v in values.items()]
    return spark.createDataFrame(rows, FACT)


MARKET = dict(base=1000, unit_demand=2, unit_price=3, regional_coverage_pct=50, product_fit_pct=80, service_coverage_pct=75, acquisition_rate_pct=20, effective_capacity=100)
FINANCE = dict(sales=100, capacity=200, price=100, variable_cost=60, fixed_cash_cost=1000, depreciation=1000, capex=10000, annual_credit_purchases=6000, receivable_days=90, inventory_days=15, payable_days=30)


def test_market(spark):
    r = C.market(_facts(spark, "a", MARKET)).first()
    assert (r["tam"], r["sam"], r["demand_ceiling"], r["som"], r["binding"], r["status"]) == (6000, 1800, 360, 300, "capacity", "checkable")
    gap = C.market(_facts(spark, "a", {k: v for k, v in MARKET.items() if k != "base"})).first()
    assert gap["tam"] is None and gap["gaps"] == ["base"]
    assert C.market(_facts(spark, "a", MARKET, base="assumption")).first()["status"] == "scenario"
    assert C.market(_facts(spark, "a", MARKET, base="unverified")).first()["tam"] is None


def test_finance(spark):
    r = C.finance(_facts(spark, "a", FINANCE)).first()
    assert (r["operating_profit"], r["breakeven_quantity"], r["ccc_days"]) == (2000, 50, 75)
    loss = C.finance(_facts(spark, "a", FINANCE | {"variable_cost": 120})).first()
    assert loss["breakeven_quantity"] is None and loss["operating_profit"] == -4000
    assert C.finance(_facts(spark, "a", FINANCE, sales="assumption")).first()["operating_profit"] == 2000


def test_city(spark):
    def cells(*rows):
        return spark.createDataFrame([("s", i, w, d, c, v, True) for i, w, d, c, v in rows], "scenario string, indicator string, weight double, direction string, city string, value double, ok boolean")

    full = [("x", 60.0, "higher", c, v) for c, v in zip("abc", (30.0, 20.0, 10.0))] + [("y", 40.0, "lower", c, v) for c, v in zip("abc", (30.0, 20.0, 10.0))]
    got = {r["city"]: (r["total"], r["rank"], r["recommended"]) for r in C.city_scores(cells(*full)).collect()}
    assert got == {"a": (60.0, 1, True), "b": (50.0, 2, False), "c": (40.0, 3, False)}
    assert all(r["total"] is None and not r["recommended"] for r in C.city_scores(cells(*full[:-1], ("y", 40.0, "lower", "c", None))).collect())
    flat = [(i, w, d, c, 5.0) for i, w, d, c, _ in full]
    assert all(r["total"] == 50 and not r["recommended"] for r in C.city_scores(cells(*flat)).collect())


def test_gates(spark):
    rows = spark.createDataFrame([("a", "higher", 10.0, 10.0, 5.0, True), ("a", "lower", 1.0, 2.0, 4.0, True), ("b", "higher", 5.0, 10.0, 5.0, True), ("b", "higher", 20.0, 10.0, 5.0, True), ("c", "higher", None, 10.0, 5.0, True), ("d", "higher", 7.0, 10.0, 5.0, True), ("e", "higher", 7.0, 5.0, 10.0, True)],
                                 "scenario string, direction string, current double, go double, no_go double, reviewed boolean")
    _, d = C.gates(rows)
    assert {r["scenario"]: r["decision"] for r in d.collect()} == {"a": "GO", "b": "NO-GO", "c": None, "d": "HOLD", "e": None}


def test_price(spark):
    r = spark.createDataFrame([("s", 100.0, 80.0, 70.0, 100.0, 60.0, 1000.0), ("z", 100.0, 80.0, 0.0, 100.0, 60.0, 0.0)], "scenario string, capacity double, output double, sales double, price double, unit_cost double, fixed_cost double")
    got = {x["scenario"]: x for x in C.price_scenarios(r, [-10]).collect()}
    assert (got["s"]["utilization_pct"], got["s"]["gross_profit"], round(got["s"]["shock_gross_profit"], 6)) == (80.0, 1800.0, 1100.0)
    assert got["z"]["margin_pct"] is None


def test_math_text_keeps_currency(spark):
    from pyspark.sql import functions as F

    from tessaria.functions import text as T
    cases = {
        "It cost $100 in all, not $90.": "It cost $100 in all, not $90.",
        r"$$\frac{\text{a}}{b}$$ and $x_1 = 2$": "(a) ÷ (b) and x_1 = 2",
        r"\(x^{2}\) or \[y^{a+b}\] of $V$": "x^2 or y^(a+b) of V",
        r"\begin{aligned}\sqrt{\frac{a}{b}} \cdot \sum x \\ \unknown\end{aligned}": "√((a) ÷ (b)) × 求和 x \n unknown",
        "It cost $100 (fee = 2%), later $90.": "It cost $100 (fee = 2%), later $90.",
        "pay $5 for file_a or $6 for file_b": "pay $5 for file_a or $6 for file_b",
        "海外报价为$100/台，公式为 $收入/销量$。": "海外报价为$100/台，公式为 收入/销量。",
        "$a + b$ and $2x + 1$, a &= b, R&D": "a + b and 2x + 1, a = b, R&D",
        "$x$ costs $3, a run $$$ of three $$$ stays, so does \\$ and $ alone": "x costs $3, a run $$$ of three $$$ stays, so does $ and $ alone",
        "\\[\n\\Delta \\text{Profit} = \\Delta \\text{Price} \\times \\text{Quantity Sold}\n\\]\n其中，\\(\\Delta \\text{Price}\\) 是变动量。": "Δ Profit = Δ Price × Quantity Sold\n其中，Δ Price 是变动量。",
        r"\[ TAM = \sum (需求 \times (1 + 增长率)^n) \]": "TAM = 求和 (需求 × (1 + 增长率)^n)",
        r"$$ CAGR=\left(\frac{V_{t}}{V_{0}}\right)^{\frac{1}{n}}-1 $$": "CAGR=((V_t) ÷ (V_0))^((1) ÷ (n))-1",
        r"单价=\frac{\text{收入}}{\text{销量}}，阈值\geq 15\%。": "单价=(收入) ÷ (销量)，阈值≥ 15%。",
        r"\begin{align*}a & b \\ c &= {d}\end{align*} \begin{foo}": "a   b \n c = {d} begin{foo}",
        r"\sqrt{\text{a {b} c}} x_{i_{j}} \frac{a}b \frac {a} {b^{c}} }": "√(a {b} c) x_i_j (a)b (a) ÷ (b^c) }",
        r"\text{never {closes": "{never {closes",
        "\\frac{" * 3000 + "a" + "}{b}" * 3000: "(" * 3000 + "a" + ") ÷ (b)" * 3000,
        r"\frac{\frac{\frac{\frac{\frac{a}{b}}{c}}{d}}{e}}{f}": "(((((a) ÷ (b)) ÷ (c)) ÷ (d)) ÷ (e)) ÷ (f)",
    }
    rows = spark.createDataFrame(list(cases.items()), "text string, want string").select(T.plain_math(F.col("text")).alias("got"), "want", "text").collect()
    assert [(r["text"], r["got"]) for r in rows] == [(r["text"], r["want"]) for r in rows]


def test_packing_long_rows_and_nulls(spark):
    from pyspark.sql import functions as F

    from tessaria.operators import retrieval as R
    d = spark.createDataFrame([(1, ["ab"] * 30_000), (2, []), (3, None), (4, ["a" * 9, None, "bb", "c" * 7])], "id int, s array<string>")
    got = {r["id"]: (r["f"], r["k"]) for r in d.select("id", R.pack_flush(F.col("s"), 8).alias("f"), R.pack_skip(F.col("s"), 9).alias("k")).collect()}
    assert got[1][0] == [i // 4 for i in range(30_000)] and sum(got[1][1]) == 4
    assert got[2] == ([], []) and got[3] == (None, None)
    assert got[4] == ([0, 1, 1, 2], [True, True, False, False])
