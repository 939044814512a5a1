"""Scenario calculators in bulk (CAL): long facts, one row per scenario and key, to results per scenario.

Facts have (scenario, key, value, source, origin_id, date, basis, verified, conflict). Inputs are decimal(20,6);
products are cast step by step, so scales stay defined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MARKET = ("base", "unit_demand", "unit_price", "regional_coverage_pct", "product_fit_pct", "service_coverage_pct", "acquisition_rate_pct", "effective_capacity")
FINANCE = ("sales", "capacity", "price", "variable_cost", "fixed_cash_cost", "depreciation", "capex", "annual_credit_purchases", "receivable_days", "inventory_days", "payable_days")
INPUT = "decimal(20,6)"


def dec(c: Column) -> Column:
    return c.cast("decimal(38,6)")


def reviewed(assumptions: bool) -> Column:
    """Whether a fact is usable without a note; assumptions: whether verified assumptions are."""
    bad = ("unverified",) if assumptions else ("unverified", "assumption")
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.col("verified") & ~F.coalesce("conflict", F.lit(False)) & text("source") & text("origin_id") & F.col("date").isNotNull() & ~F.coalesce("basis", F.lit("unverified")).isin(*bad)


def _wide(facts: DataFrame, keys: tuple[str, ...], assumptions: bool) -> DataFrame:
    """Values by key, and sorted arrays of gaps, pending keys and assumptions."""
    f = facts.filter(F.col("key").isin(*keys)).withColumn("ok", reviewed(assumptions))
    aggs = [F.max(F.when(F.col("key") == k, F.col("value"))).cast(INPUT).alias(k) for k in keys]
    have = F.collect_set(F.when(F.col("value").isNotNull(), F.col("key")))
    pending = F.collect_set(F.when(F.col("value").isNotNull() & ~F.col("ok"), F.col("key")))
    assumed = F.collect_set(F.when(F.col("basis") == "assumption", F.col("key")))
    out = f.groupBy("scenario").agg(*aggs, have.alias("have"), F.array_sort(pending).alias("pending"), F.array_sort(assumed).alias("assumed"))
    return out.withColumn("gaps", F.array_sort(F.array_except(F.array(*(F.lit(k) for k in keys)), "have"))).drop("have")


def market(facts: DataFrame) -> DataFrame:
    """CAL-1: market funnel. Gaps and pending facts block the numbers; verified assumptions label them a scenario."""
    w = _wide(facts, MARKET, assumptions=True)
    open_ = (F.size("gaps") == 0) & (F.size("pending") == 0)
    pct = lambda c, k: dec(c * F.col(k) / 100)
    w = w.withColumn("tam", F.when(open_, dec(dec(F.col("base") * F.col("unit_demand")) * F.col("unit_price"))))
    w = w.withColumn("sam", pct(pct(pct(F.col("tam"), "regional_coverage_pct"), "product_fit_pct"), "service_coverage_pct"))
    w = w.withColumn("demand_ceiling", pct(F.col("sam"), "acquisition_rate_pct")).withColumn("capacity_ceiling", F.when(open_, dec(F.col("effective_capacity") * F.col("unit_price"))))
    binding = F.when(F.col("capacity_ceiling") < F.col("demand_ceiling"), "capacity").when(F.col("capacity_ceiling") > F.col("demand_ceiling"), "acquisition").when(open_, "both")
    status = F.when(~open_, "open").when(F.size("assumed") > 0, "scenario").otherwise("checkable")
    return w.select("scenario", "tam", "sam", F.least("demand_ceiling", "capacity_ceiling").alias("som"), "demand_ceiling", "capacity_ceiling", binding.alias("binding"), status.alias("status"), "gaps", "pending")


def market_problems(facts: DataFrame, scenarios: DataFrame, currency: str = "元") -> DataFrame:
    """CAL-1: (scenario, key, problem), a row for each fault of a fact (scenario, key, value, unit, scope, year) against its
    scenario (scenario, base_unit, demand_unit, scope, year; one row each): unknown key, unit, scope, year, percentage
    over 100, or no scenario. What is null doesn't agree. Scenarios without a row here may be calculated."""
    s = scenarios.select("scenario", "base_unit", "demand_unit", F.col("scope").alias("_scope"), F.col("year").alias("_year"), F.lit(True).alias("_known"))
    f = facts.join(s, "scenario", "left")
    key = F.col("key")
    want = F.when(key == "base", F.col("base_unit")).when(key == "unit_demand", F.concat("demand_unit", F.lit("/"), "base_unit")).when(key == "unit_price", F.concat(F.lit(currency + "/"), "demand_unit")).when(key == "effective_capacity", F.col("demand_unit")).otherwise("%")
    known, differs = F.col("_known").isNotNull() & key.isin(*MARKET), lambda a, b: ~F.coalesce(a == b, F.lit(False))
    rules = {"no_scenario": F.col("_known").isNull(), "unknown_key": F.col("_known").isNotNull() & ~F.coalesce(key.isin(*MARKET), F.lit(False)), "unit": known & differs(F.col("unit"), want),
             "scope": known & differs(F.col("scope"), F.col("_scope")), "year": known & differs(F.col("year"), F.col("_year")), "percentage": known & F.endswith(key, F.lit("_pct")) & (F.col("value") > 100)}
    return f.select("scenario", "key", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))).alias("problem"))


def city_problems(cells: DataFrame, indicators: DataFrame, cities: DataFrame, scenarios: DataFrame) -> DataFrame:
    """CAL-3: (scenario, indicator, city, problem): weights that don't sum to 100, indicators or cities that repeat, cities
    without a name, and cells (scenario, indicator, city, unit, scope) of a city or an indicator that isn't declared, in another
    unit, or of another scope (an empty one agrees). indicators have (scenario, indicator, weight decimal, unit), cities
    (scenario, city), scenarios (scenario, scope). Scenarios without a row here may be scored."""
    none = F.lit(None).cast("string")
    rows = lambda df, problem, indicator=none, city=none: df.select("scenario", indicator.alias("indicator"), city.alias("city"), problem.alias("problem"))
    weights = indicators.groupBy("scenario").agg(F.sum("weight").alias("w")).filter("w is null or w <> 100")
    twice = indicators.groupBy("scenario", "indicator").agg(F.count("*").alias("n")).filter("n > 1")
    known = cities.groupBy("scenario", "city").agg(F.count("*").alias("n"))
    out = rows(weights, F.lit("weights")).unionByName(rows(twice, F.lit("indicator_repeats"), F.col("indicator")))
    out = out.unionByName(rows(known.filter("n > 1"), F.lit("city_repeats"), city=F.col("city"))).unionByName(rows(known.filter("coalesce(trim(city), '') = ''"), F.lit("no_name"), city=F.col("city")))
    units = indicators.groupBy("scenario", "indicator").agg(F.min("unit").alias("_unit"), F.lit(True).alias("_indicator"))
    c = cells.join(units, ["scenario", "indicator"], "left").join(known.select("scenario", "city", F.lit(True).alias("_city")), ["scenario", "city"], "left")
    c = c.join(scenarios.select("scenario", F.col("scope").alias("_scope")), "scenario", "left")
    other = (F.coalesce("scope", F.lit("")) != "") & ~F.coalesce(F.col("scope") == F.col("_scope"), F.lit(False))
    rules = {"unknown_indicator": F.col("_indicator").isNull(), "unknown_city": F.col("_city").isNull(), "unit": F.col("_indicator").isNotNull() & ~F.coalesce(F.col("unit") == F.col("_unit"), F.lit(False)), "scope": other}
    c = c.withColumn("problem", F.explode(F.array_compact(F.array(*(F.when(x, F.lit(n)) for n, x in rules.items())))))
    return out.unionByName(rows(c, F.col("problem"), F.col("indicator"), F.col("city")))


def finance(facts: DataFrame) -> DataFrame:
    """CAL-2: profit, break-even, cash cycle and funding floor. Gaps (or capacity or price not above 0) block, pending
    facts do not; break-even is null without a positive contribution."""
    w = _wide(facts, FINANCE, assumptions=False)
    bad = F.coalesce((F.col("capacity") <= 0) | (F.col("price") <= 0), F.lit(False))
    w = w.withColumn("gaps", F.when(bad & (F.size("gaps") == 0), F.array(F.lit("capacity_or_price"))).otherwise(F.col("gaps")))
    open_ = F.size("gaps") == 0
    c = lambda k: F.when(open_, F.col(k))
    w = w.withColumn("revenue", dec(c("sales") * F.col("price"))).withColumn("cash_cost", dec(c("sales") * F.col("variable_cost") + F.col("fixed_cash_cost")))
    w = w.withColumn("cost", dec(F.col("cash_cost") + F.col("depreciation"))).withColumn("contribution", dec(c("price") - F.col("variable_cost")))
    w = w.withColumn("operating_profit", dec(F.col("revenue") - F.col("cost"))).withColumn("breakeven_quantity", F.when(F.col("contribution") > 0, dec((F.col("fixed_cash_cost") + F.col("depreciation")) / F.col("contribution"))))
    w = w.withColumn("utilization_pct", dec(c("sales") / F.col("capacity") * 100)).withColumn("breakeven_utilization_pct", dec(F.col("breakeven_quantity") / F.col("capacity") * 100))
    w = w.withColumn("ccc_days", dec(c("receivable_days") + F.col("inventory_days") - F.col("payable_days")))
    working = dec(F.col("revenue") * F.col("receivable_days") / 365 + F.col("cost") * F.col("inventory_days") / 365 - F.col("annual_credit_purchases") * F.col("payable_days") / 365)
    w = w.withColumn("working_capital", F.when(open_, working)).withColumn("funding_floor", dec(c("capex") + F.greatest("working_capital", F.lit(0).cast("decimal(38,6)"))))
    over = F.coalesce(F.col("sales") > F.col("capacity"), F.lit(False)) & open_
    status = F.when(open_ & (F.size("pending") == 0) & ~over, "checkable").otherwise("open")
    return w.select("scenario", "revenue", "cost", "operating_profit", "contribution", "utilization_pct", "breakeven_quantity", "breakeven_utilization_pct", "ccc_days", "working_capital", "funding_floor", over.alias("sales_above_capacity"), status.alias("status"), "gaps", "pending")


def city_scores(cells: DataFrame) -> DataFrame:
    """CAL-3: (scenario, city, total, rank, recommended): min-max scores by indicator, weighted; cells are (scenario,
    indicator, weight, direction, city, value, ok), one for each pair, null where missing. A missing cell blocks the
    scenario; a city is recommended if nothing is pending and its total is the best alone."""
    w = Window.partitionBy("scenario", "indicator")
    lo, hi = F.min("value").over(w), F.max("value").over(w)
    up = (F.col("value") - lo) / (hi - lo) * 100
    score = F.when(hi == lo, 50.0).when(F.col("direction") == "higher", up).otherwise(100 - up)
    s = cells.withColumn("score", score).groupBy("scenario", "city").agg(F.sum(F.col("score") * F.col("weight") / 100).alias("total"), F.count_if(F.col("value").isNull()).alias("gaps"), F.count_if(~F.col("ok")).alias("pending"))
    by = Window.partitionBy("scenario")
    s = s.withColumn("total", F.when(F.sum("gaps").over(by) == 0, F.round("total", 6)))
    s = s.withColumn("rank", F.when(F.col("total").isNotNull(), F.rank().over(by.orderBy(F.desc("total")))))
    ties = F.count_if(F.col("rank") == 1).over(by)
    return s.select("scenario", "city", "total", "rank", F.coalesce((F.col("rank") == 1) & (ties == 1) & (F.sum("pending").over(by) == 0), F.lit(False)).alias("recommended"))


def gates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CAL-4: (rows with gate, decision per scenario). A gate is GO at or beyond its go threshold in its direction,
    NO-GO at or beyond the other, else HOLD; pending without a reviewed value; thresholds in the wrong order are invalid.
    Overall: nothing while any is pending or invalid, NO-GO if any, GO if all, else HOLD."""
    up = F.col("direction") == "higher"
    wrong = F.when(up, F.col("go") <= F.col("no_go")).otherwise(F.col("go") >= F.col("no_go"))
    go = F.when(up, F.col("current") >= F.col("go")).otherwise(F.col("current") <= F.col("go"))
    no = F.when(up, F.col("current") <= F.col("no_go")).otherwise(F.col("current") >= F.col("no_go"))
    gate = F.when(wrong, "INVALID").when(F.col("current").isNull() | ~F.coalesce("reviewed", F.lit(False)), "PENDING").when(go, "GO").when(no, "NO-GO").otherwise("HOLD")
    g = rows.withColumn("gate", gate)
    is_ = lambda *x: F.col("gate").isin(*x)
    d = g.groupBy("scenario").agg(F.when(F.bool_or(is_("PENDING", "INVALID")), F.lit(None).cast("string")).when(F.bool_or(is_("NO-GO")), "NO-GO").when(F.bool_and(is_("GO")), "GO").otherwise("HOLD").alias("decision"), F.count_if(is_("PENDING")).alias("pending"))
    return g, d


def price_scenarios(rows: DataFrame, shocks: list[float]) -> DataFrame:
    """CAL-5: utilisation, revenue, gross profit and margin before and after price shocks (a list of percentages):
    rows (scenario, capacity, output, sales, price, unit_cost, fixed_cost)."""
    g = rows.withColumn("shock_pct", F.explode(F.array(*(F.lit(float(x)) for x in shocks))))
    rev = F.col("sales") * F.col("price")
    cost = F.col("sales") * F.col("unit_cost") + F.col("fixed_cost")
    new = rev * (1 + F.col("shock_pct") / 100)
    margin = lambda r: F.when(r != 0, (r - cost) / r * 100)
    return g.select("scenario", "shock_pct", F.when(F.col("capacity") > 0, F.col("output") / F.col("capacity") * 100).alias("utilization_pct"), rev.alias("revenue"), (rev - cost).alias("gross_profit"), margin(rev).alias("margin_pct"), new.alias("shock_revenue"), (new - cost).alias("shock_gross_profit"), margin(new).alias("shock_margin_pct"),
                    F.array_compact(F.array(F.when(F.col("output") > F.col("capacity"), "output_above_capacity"), F.when(F.col("sales") > F.col("output"), "sales_above_output"))).alias("warnings"))
