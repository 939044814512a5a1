"""Facts from evidence, yearly series, growth, and series discovery (FCT, SER, TXT-29, TXT-30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import json_text as J
from ..functions import text as T
from ..sources.shared import cut, shared_dir
from . import containment as C


def rule_candidates(graded: DataFrame, rules: list[tuple[str, str]], default: str = "risk", per_row: int = 3, missing: str = r"(?i)not available|unknown|暂无|缺失") -> DataFrame:
    """FCT-1/2: candidate facts from sentences with measures: rows by (grade, chapter, score desc, id), first of equal
    (type, text), at most per_row of a row, each with a deterministic id.

    The first of equal sentences is taken over all rows before the cap, so a later copy of a sentence that the cap
    drops is not taken in its place."""
    s = graded.select("id", "project_id", "chapter_no", "grade", "score", F.posexplode(T.sentences(F.col("excerpt"), ends=".!?;。！？；", cut=800)).alias("position", "quote"))
    s = s.filter(F.col("quote").rlike(T.MEASURE) & ~F.col("quote").rlike(missing)).withColumn("record_type", T.first_rule(F.col("quote"), rules, F.lit(default))).withColumn("key", T.bare(F.col("quote")))
    order = [F.col("grade"), F.col("chapter_no"), F.desc_nulls_last("score"), F.col("id"), F.col("position")]
    s = s.withColumn("seen", F.row_number().over(Window.partitionBy("project_id", "record_type", "key").orderBy(*order))).filter("seen = 1")
    s = s.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("position"))).filter(F.col("n") <= per_row)
    return s.select("id", "project_id", "chapter_no", "record_type", "quote", T.stable_id(F.concat_ws("|", "record_type", F.col("id").cast("string"), "key"), 27).alias("record_id"))


def accepted_candidates(candidates: DataFrame, ev: DataFrame, types: list[str]) -> DataFrame:
    """FCT-3: candidates (id, record_type, quote, value, unit, year) with `reason`: null if accepted, else the first of
    type, evidence, quote, measure and period that fails. Number and unit must be one token of the quote."""
    c = candidates.join(ev.select("id", "excerpt"), "id", "left")
    measured = F.exists(T.measures(F.col("quote")), lambda m: (F.regexp_replace(m["value"], ",", "") == F.regexp_replace("value", ",", "")) & (m["unit"] == F.col("unit")))
    reason = F.when(~F.col("record_type").isin(*types), "type").when(F.col("excerpt").isNull(), "evidence").when(~F.contains("excerpt", F.col("quote")), "quote").when(~measured, "measure").when(F.col("year").isNotNull() & ~F.contains("quote", F.col("year").cast("string")), "period")
    return c.withColumn("reason", reason).drop("excerpt")


def supported_by_quote(candidates: DataFrame, columns: dict[str, str | None]) -> DataFrame:
    """FCT-3: candidates whose claims (columns: what stands instead) the quote doesn't hold are replaced, as are null and empty
    ones; case, white space, commas and marks of emphasis don't matter. Rows stay."""
    said = T.no_list_marks(F.coalesce("quote", F.lit("")))
    def held(c):
        key = T.no_list_marks(F.coalesce(c, F.lit("")))
        return F.when((key != "") & F.contains(said, key), T.collapse(F.col(c)))
    return candidates.withColumns({c: F.coalesce(held(c), F.lit(instead).cast("string")) for c, instead in columns.items()})


def balanced_sample(ev: DataFrame, per_chapter: int = 2, rows: int = 30, chars: int = 22_000) -> DataFrame:
    """FCT-4: per project, the best rows of each chapter first, then the rest by order, as far as both limits allow."""
    best = [F.desc_nulls_last("score"), F.col("id")]
    r = ev.withColumn("in_chapter", F.row_number().over(Window.partitionBy("project_id", "chapter_no").orderBy(*best)))
    w = Window.partitionBy("project_id").orderBy((F.col("in_chapter") > per_chapter).cast("int"), *best)
    r = r.withColumn("place", F.row_number().over(w)).withColumn("used", F.sum(F.length("excerpt")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.filter((F.col("place") <= rows) & (F.col("used") <= chars)).drop("in_chapter")


def missing_types(records: DataFrame, expected: list[str]) -> DataFrame:
    """FCT-5: (project_id, missing): expected types that a project has no record of."""
    have = records.groupBy("project_id").agg(F.collect_set("record_type").alias("have"))
    return have.select("project_id", F.array_sort(F.array_except(F.array(*(F.lit(x) for x in expected)), "have")).alias("missing"))


def cache_hits(wanted: DataFrame, runs: DataFrame, records: DataFrame) -> DataFrame:
    """FCT-6: wanted (project_id, version, input_hash, mode) that a stored run answers, all of whose ids still exist."""
    hit = wanted.join(runs, ["project_id", "version", "input_hash", "mode"]).select("project_id", F.explode("ids").alias("record_id"))
    known = hit.join(records.select("record_id", F.lit(True).alias("there")), "record_id", "left")
    return known.groupBy("project_id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("hit")).filter("hit").select("project_id")


def fact_atoms(records: DataFrame, ev: DataFrame) -> DataFrame:
    """FCT-7/8: records (record_id, record_type, metric, scope, geography, conflict, quote, evidence_ids) with `reason`
    (first rule that blocks, else null), year, value, unit, metric_key and scope_key."""
    r = records.withColumn("id", F.when(F.size("evidence_ids") == 1, F.get("evidence_ids", F.lit(0)))).join(ev.select("id", "excerpt", "origin_key"), "id", "left")
    years, m = F.array_distinct(T.year_tokens(F.col("quote"))), T.measures(F.col("quote"))
    r = r.withColumn("_y", years).withColumn("_m", m).withColumn("metric_key", T.bare(F.col("metric")))
    value = T.safe_number(F.get("_m", F.lit(0))["value"]).cast("decimal(20,6)")
    reason = (F.when(F.col("excerpt").isNull(), "evidence").when((F.trim("quote") == "") | ~F.contains("excerpt", F.col("quote")), "quote").when(F.coalesce("conflict", F.lit(False)), "conflict")
              .when(T.is_ambiguous(F.col("quote")), "not_a_point").when(F.size("_y") != 1, "year").when(F.size("_m") != 1, "measure").when(F.coalesce("metric_key", F.lit("")) == "", "metric").when(value.isNull(), "number"))
    explicit = ~F.lower(F.trim(F.coalesce("scope", F.lit("")))).isin("", "all", "total", "overall")
    scope = F.when(explicit, F.concat_ws("|", T.bare(F.col("scope")), "origin_key")).otherwise(F.concat_ws("|", F.lit("source"), "origin_key", T.bare(F.coalesce("geography", F.lit("")))))
    return r.select("record_id", "record_type", "metric", "metric_key", scope.alias("scope_key"), "quote", "id", reason.alias("reason"), F.get("_y", F.lit(0)).try_cast("int").alias("year"), value.alias("value"), F.get("_m", F.lit(0))["unit"].alias("unit"), F.col("quote").rlike("(?i)forecast|expected|预计|预测").alias("forecast"))


SERIES = ["record_type", "metric_key", "unit", "scope_key"]


def yearly_series(atoms: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    """FCT-9: per series its points (year, value, record_ids), and why it is blocked: a year with several values, or
    fewer than two points."""
    years = atoms.filter("reason is null").groupBy(*keys, "year").agg(F.countDistinct("value").alias("n"), F.min("value").alias("value"), F.array_sort(F.collect_set("record_id")).alias("record_ids"), F.bool_or("forecast").alias("forecast"))
    s = years.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("year", "value", "record_ids"))).alias("points"), F.max("n").alias("most"), F.count("*").alias("n_points"), F.bool_or("forecast").alias("forecast"))
    return s.withColumn("blocked", F.when(F.col("most") > 1, "conflict").when(F.col("n_points") < 2, "points")).drop("most")


def growth(series: DataFrame) -> DataFrame:
    """FCT-10: compound yearly growth in percent from the first to the last point, null with a reason where it is undefined."""
    a, b = F.element_at("points", 1), F.element_at("points", -1)
    n = b["year"] - a["year"]
    ok = (a["value"] > 0) & (b["value"] >= 0) & (n > 0)
    rate = (F.pow(b["value"].cast("double") / a["value"].cast("double"), 1 / n) - 1) * 100
    s = series.filter("blocked is null").withColumn("periods", n).withColumn("start_value", a["value"]).withColumn("end_value", b["value"])
    return s.withColumn("cagr", F.when(ok, rate)).withColumn("reason", F.when(~ok, "not_defined"))


def gap_report(records: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """FCT-11: per project, whether any record of each family exists."""
    return records.groupBy("project_id").agg(*(F.bool_or(F.col("record_type").isin(*types)).alias(f"has_{name}") for name, types in families.items()))


def readiness(records: DataFrame) -> DataFrame:
    """FCT-12: per project and type, whether a verified record stands that is no assumption and has nothing open."""
    ok = F.col("verified") & ~F.coalesce("basis", F.lit("")).isin("assumption", "unverified") & (F.col("gaps") == 0) & (F.col("pending") == 0)
    return records.groupBy("project_id", "record_type").agg(F.bool_or(ok).alias("ready"))


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, section): lines with the running number of the heading above them."""
    b = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("section", F.sum(F.startswith("line", F.lit("#")).cast("int")).over(w))


def text_series(lines: DataFrame, metrics: list[str]) -> DataFrame:
    """SER-1: per (document, section, metric, unit) the values by year of lines with exactly one year; a line that names
    no metric takes the last one named in its section; a year with two values drops the series; two points at least."""
    named = F.nullif(F.lower(F.regexp_extract("line", rf"(?i)\b({'|'.join(sorted(metrics, key=len, reverse=True))})\b", 1)), F.lit(""))
    w = Window.partitionBy("doc_id", "section").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    l = lines.withColumn("metric", F.last(named, ignorenulls=True).over(w)).withColumn("y", F.array_distinct(T.year_tokens(F.col("line")))).filter((F.size("y") == 1) & F.col("metric").isNotNull() & ~ambiguous_pairing(F.col("line")))
    p = l.select("doc_id", "section", "metric", F.get("y", F.lit(0)).cast("int").alias("year"), F.explode(T.measures(F.col("line"))).alias("m"))
    p = p.select("doc_id", "section", "metric", F.col("m.unit").alias("unit"), "year", T.safe_number(F.col("m.value")).alias("value"))
    years = p.groupBy("doc_id", "section", "metric", "unit", "year").agg(F.countDistinct("value").alias("n"), F.min("value").alias("value"))
    s = years.groupBy("doc_id", "section", "metric", "unit").agg(F.max("n").alias("most"), F.count("*").alias("points"), F.array_sort(F.collect_list(F.struct("year", "value"))).alias("values"))
    return s.filter("most = 1 and points >= 2").drop("most")


def scalar_facts(lines: DataFrame, least_label: int = 2) -> DataFrame:
    """SER-2: (doc_id, pos, i, label, value, unit) of single values with a label before them; shares above 100 % are left out."""
    m = lines.select("doc_id", "pos", "line", F.posexplode(T.measures(F.col("line"))).alias("i", "m"))
    label = T.collapse(F.regexp_extract("line", r"(?s)^(.*?)[-+]?[0-9][0-9,.]*\s*(?:%|[A-Za-z])", 1))
    v = T.safe_number(F.col("m.value"))
    out = m.select("doc_id", "pos", "i", label.alias("label"), v.alias("value"), F.col("m.unit").alias("unit"))
    return out.filter((F.length("label") >= least_label) & ~(F.col("unit").isin("%", "percent") & (F.col("value") > 100)))


def ambiguous_pairing(c: Column) -> Column:
    """SER-3: "respectively" with numbers of years and values that do not pair."""
    return c.rlike(r"(?i)respectively|分别") & (F.size(T.year_tokens(c)) != F.size(T.measures(c)))


def tables(docs: DataFrame) -> DataFrame:
    """TXT-30: cells of markdown tables: (doc_id, table, row, col, header, cell). A table is a run of | lines whose
    second line is a separator; rows with another number of cells than the header are left out."""
    b = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    b = b.withColumn("is_row", F.col("line").rlike(r"^\s*\|.*\|\s*$")).withColumn("start", F.col("is_row") & ~F.coalesce(F.lag("is_row").over(w), F.lit(False)))
    b = b.withColumn("table", F.sum(F.col("start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("is_row")
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    b = b.withColumn("cells", cells).withColumn("row", F.row_number().over(Window.partitionBy("doc_id", "table").orderBy("pos")) - 1)
    sep = F.forall("cells", lambda x: x.rlike(r"^:?-+:?$"))
    whole = Window.partitionBy("doc_id", "table")
    b = b.withColumn("ok", F.bool_or((F.col("row") == 1) & sep).over(whole)).withColumn("headers", F.first(F.when(F.col("row") == 0, F.col("cells")), ignorenulls=True).over(whole))
    b = b.filter("ok and row >= 2").filter(F.size("cells") == F.size("headers"))
    return b.select("doc_id", "table", (F.col("row") - 2).alias("row"), F.posexplode(F.arrays_zip(F.col("headers").alias("h"), F.col("cells").alias("c"))).alias("col", "x")).select("doc_id", "table", "row", "col", F.col("x.h").alias("header"), F.col("x.c").alias("cell"))


def table_series(cells: DataFrame, least: int = 2, most: int = 30) -> DataFrame:
    """SER-4: series of complete numeric columns with a unit in the header, labelled by the first column: labels are
    unique, 2 to 30 rows; a time series if the label column says year and all labels are years."""
    label = cells.filter("col = 0").select("doc_id", "table", "row", F.col("header").alias("label_header"), F.col("cell").alias("label"))
    unit = F.regexp_extract("header", r"[(（]([^()（）]+)[)）]", 1)
    v = cells.filter("col > 0").withColumn("unit", unit).withColumn("value", T.safe_number(F.col("cell"))).filter("unit <> ''").join(label, ["doc_id", "table", "row"])
    s = v.groupBy("doc_id", "table", "col", "header", "unit", "label_header").agg(F.count("*").alias("n"), F.count("value").alias("numbers"), F.countDistinct("label").alias("labels"), F.bool_and(F.col("label").rlike(r"^(?:19|20)[0-9]{2}$")).alias("all_years"), F.array_sort(F.collect_list(F.struct("label", "value"))).alias("points"))
    s = s.filter((F.col("n") == F.col("numbers")) & (F.col("n") == F.col("labels")) & F.col("n").between(least, most))
    return s.withColumn("time_series", F.col("label_header").rlike("(?i)year|年") & F.col("all_years")).drop("numbers", "labels", "all_years")


def audited_facts(facts: DataFrame, ev: DataFrame) -> DataFrame:
    """SER-5: facts (id, record_id, metric, unit, year, value, quote) whose quote stands in usable evidence and has no
    other measured value than the fact's own."""
    f = facts.join(ev.select("id", "excerpt"), "id")
    own = F.forall(T.measures(F.col("quote")), lambda m: (T.safe_number(m["value"]) == F.col("value")) & (m["unit"] == F.col("unit")))
    return f.filter(F.contains("excerpt", F.col("quote")) & own & (F.size(T.measures(F.col("quote"))) > 0)).drop("excerpt")


#: Words that say nothing about what is measured.
FILLERS = r"(?i)\b(?:in|was|is|were|are|and|reached|rose|fell|of|at|to|the|it|then|while)\b|[为达是约至和年]"


def _quoted(records: DataFrame, ev: DataFrame, least: int) -> DataFrame:
    """Records without a conflict whose quote of `least` characters or more stands in every evidence row that they name."""
    r = records.filter(~F.coalesce("conflict", F.lit(False)) & (F.length(F.trim("quote")) >= least))
    r = r.withColumn("quote", F.trim("quote")).withColumn("evidence_ids", F.array_distinct(F.filter("evidence_ids", lambda i: i.isNotNull())))
    named = r.select("record_id", "quote", F.size("evidence_ids").alias("n"), F.explode("evidence_ids").alias("id")).join(ev.select("id", "excerpt").dropDuplicates(["id"]), "id")
    held = named.filter(F.contains("excerpt", F.col("quote"))).groupBy("record_id", "n").agg(F.count("*").alias("found")).filter("found = n")
    return r.join(held.select("record_id"), "record_id", "left_semi")


def fact_cards(records: DataFrame, ev: DataFrame, least: int = 6) -> DataFrame:
    """SER-5: (record_id, kind, metric, unit, labels, values) from records(record_id, metric, quote, conflict, evidence_ids,
    claims, value, unit, period), whose record_id is unique, and usable evidence(id, excerpt).

    `claims` (array<struct<whole, value, unit>>) must be as many as the quote's measured values; each value that stands once
    in the quote as a claim has it makes a "card". Without claims, value and unit must be those of exactly one measured value.
    A value's label is the last year before it in the quote, else the record's period; its metric the words since the value
    before, or the record's if it is alone or no words are left. Two values or more with a year each, all different, of one
    unit and one metric make a "series" besides, in order of years; a value without words of its own, or with the end of the
    first one's, has the metric that came before. Quotes that pair years and values at a distance give nothing."""
    q = _quoted(records, ev, least).filter(~ambiguous_pairing(F.col("quote"))).withColumn("found", T.measures(F.col("quote"))).withColumn("pieces", F.split("quote", T.MEASURE, -1))
    same = lambda m, value, unit: (T.safe_number(m["value"]) == T.safe_number(value)) & (m["unit"] == unit)
    once = lambda m: F.size(F.filter("found", lambda o: o["whole"] == m["whole"])) == 1
    claimed = lambda m: F.exists("claims", lambda c: (c["whole"] == m["whole"]) & same(m, c["value"], c["unit"]))
    has_claims = F.coalesce(F.size("claims"), F.lit(0)) > 0
    alone = F.size(F.filter("found", lambda m: same(m, F.col("value"), F.col("unit")))) == 1
    q = q.filter(F.when(has_claims, F.size("claims") == F.size("found")).otherwise(alone))
    clean = lambda t: T.collapse(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, T.YEAR, " "), FILLERS, " "), r"[\p{Punct}，。；：、]+", " "))
    q = q.withColumn("names", F.transform("pieces", lambda t: F.lower(clean(t))))
    last = lambda a: F.get(a, F.size(a) - 1)
    kept = lambda m: F.when(has_claims, once(m) & claimed(m)).otherwise(same(m, F.col("value"), F.col("unit")))

    def point(m, i):
        year = last(F.regexp_extract_all(F.array_join(F.slice("pieces", 1, i + 1), " "), F.lit(T.YEAR), F.lit(1)))
        own = last(F.filter(F.slice("names", 1, i + 1), lambda n: n != ""))
        first = F.get(F.filter("names", lambda n: n != ""), F.lit(0))
        signature = F.when(F.endswith(first, own), first).otherwise(own)
        name = F.when((F.size("found") == 1) | (F.get("names", i) == ""), F.col("metric")).otherwise(F.get("names", i))
        return F.struct(kept(m).alias("ok"), year.alias("year"), F.coalesce(year, "period").alias("label"), name.alias("name"), signature.alias("signature"), T.safe_number(m["value"]).alias("value"), m["unit"].alias("unit"))

    p = q.select("record_id", "metric", F.filter(F.transform("found", point), lambda x: x["ok"]).alias("x"))
    cards = p.select("record_id", F.explode("x").alias("c")).select("record_id", F.lit("card").alias("kind"), F.col("c.name").alias("metric"), "c.unit", F.array("c.label").alias("labels"), F.array("c.value").alias("values"))
    dated = p.withColumn("x", F.array_sort(F.transform(F.filter("x", lambda c: c["year"].isNotNull() & c["signature"].isNotNull()), lambda c: F.struct(c["year"].alias("year"), c["value"].alias("value"), c["unit"].alias("unit"), c["signature"].alias("signature")))))
    one = lambda f: F.size(F.array_distinct(F.col(f"x.{f}"))) == 1
    series = dated.filter((F.size("x") >= 2) & (F.size(F.array_distinct("x.year")) == F.size("x")) & one("unit") & one("signature"))
    return cards.unionByName(series.select("record_id", F.lit("series").alias("kind"), "metric", F.col("x.unit")[0].alias("unit"), F.col("x.year").alias("labels"), F.col("x.value").alias("values")))


def audited_growth(growth_rows: DataFrame, atoms: DataFrame) -> DataFrame:
    """SER-6: growth rows all of whose points have records that are still there, say so, and whose quotes state that value
    and unit themselves. A point without records drops its row."""
    p = growth_rows.select(*SERIES, F.explode("points").alias("p")).select(*SERIES, F.col("p.year").alias("year"), F.col("p.value").alias("value"), F.explode_outer("p.record_ids").alias("record_id"))
    a = atoms.filter("reason is null").select("record_id", F.col("value").alias("v"), F.col("unit").alias("u"), "quote")
    states = F.exists(T.measures(F.col("quote")), lambda m: (T.safe_number(m["value"]) == F.col("value")) & (m["unit"] == F.col("unit")))
    ok = p.join(a, "record_id", "left").groupBy(*SERIES).agg(F.bool_and(F.coalesce((F.col("v") == F.col("value")) & (F.col("u") == F.col("unit")) & states, F.lit(False))).alias("audited"))
    return growth_rows.join(ok.filter("audited").select(*SERIES), SERIES, "left_semi")


def calculation_series(wide: DataFrame, keys: list[str], units: dict[str, str]) -> DataFrame:
    """SER-7: wide results to (keys, label, value, unit)."""
    long = wide.select(*keys, *(F.col(c).cast("double").alias(c) for c in units)).unpivot(keys, list(units), "label", "value")
    return long.withColumn("unit", F.create_map(*(F.lit(x) for kv in units.items() for x in kv))[F.col("label")])


def merge_provenance(series: DataFrame, signature: list[str]) -> tuple[DataFrame, DataFrame]:
    """SER-8: (merged, members) of series (signature, id, grade, excerpts, refs). merged has a row per signature: the smallest id, the best (first)
    grade, and how many ids, excerpts and references it joins; members has these as rows (signature, kind, value), each once. A signature of any
    number of series is never gathered into one row. Null values are left out; null signatures are one."""
    def named(values: str, kind: str) -> Column:
        return F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    rows = series.select(*signature, "id", "grade", F.explode(F.concat(
        F.array(F.struct(F.lit("id").alias("kind"), F.col("id").cast("string").alias("value"))),
        named("excerpts", "excerpt"), named("refs", "reference"))).alias("x"))
    rows = rows.select(*signature, "id", "grade", "x.kind", "x.value").filter("value is not null")
    members = rows.groupBy(*signature, "kind", "value").agg(F.min("id").alias("id"), F.min("grade").alias("grade"))
    n = lambda k: F.count_if(F.col("kind") == k)
    merged = members.groupBy(*signature).agg(F.min("id").alias("id"), F.min("grade").alias("grade"), n("id").alias("n_ids"), n("excerpt").alias("n_excerpts"), n("reference").alias("n_references"))
    return merged, members.select(*signature, "kind", "value")


def thin(candidates: DataFrame, per_chapter: int = 3) -> DataFrame:
    """SER-9: candidates (chapter_no, kind, signature, unit, value, id): first of a signature; scalars leave chapter 1,
    are unique by (chapter, unit, value) and at most per_chapter."""
    c = candidates.withColumn("a", F.row_number().over(Window.partitionBy("signature").orderBy("id"))).filter("a = 1").filter("kind <> 'scalar' or chapter_no <> 1")
    c = c.withColumn("b", F.when(F.col("kind") == "scalar", F.row_number().over(Window.partitionBy("kind", "chapter_no", "unit", "value").orderBy("id"))).otherwise(1)).filter("b = 1")
    return c.withColumn("k", F.when(F.col("kind") == "scalar", F.row_number().over(Window.partitionBy("kind", "chapter_no").orderBy("id"))).otherwise(1)).filter(F.col("k") <= per_chapter).drop("a", "b", "k")


def selection_state(series: DataFrame, saved: DataFrame) -> DataFrame:
    """SER-10: (chart_id, state): selected, unselected, stale (saved but gone or of another type)."""
    out = series.select("chart_id", "chart_type").join(saved.select("chart_id", F.col("chart_type").alias("saved_type"), "selected"), "chart_id", "full")
    state = F.when(F.col("saved_type").isNotNull() & ~F.col("chart_type").eqNullSafe(F.col("saved_type")), "stale").when(F.coalesce("selected", F.lit(False)), "selected").otherwise("unselected")
    return out.select("chart_id", state.alias("state"))


def block_form(c: Column) -> Column:
    """How excerpts and blocks are compared: without white space, markdown marks and citation numbers."""
    return F.regexp_replace(c, r"(?U)[\s#*_`|]|\[\d+(?:-\d+)?\]", "")


def _excerpts(series: DataFrame, least: int) -> DataFrame:
    form = F.array_sort(F.array_distinct(F.filter(F.transform("excerpts", lambda e: block_form(F.coalesce(e, F.lit("")))), lambda e: e != "")))
    s = series.withColumn("parts", form)
    return s.filter((F.size("parts") > 0) & F.forall("parts", lambda e: F.length(e) >= least))


def _standing(parts: DataFrame, block_rows: DataFrame) -> DataFrame:
    texts = cut(block_rows.select("chapter_no", F.col("block_id").alias("key"), block_form(F.col("text")).alias("text")), shared_dir(parts.sparkSession, "blocks"), "texts")
    return C.contained(parts.select("chapter_no", F.explode("parts").alias("needle")), texts, ("chapter_no",)).withColumnRenamed("key", "block_id")


def bind_series(series: DataFrame, block_rows: DataFrame, least: int = 6) -> DataFrame:
    """SER-11: (series_id, block_id) of series(series_id, chapter_no, excerpts) whose excerpts all stand in exactly one
    of block_rows(chapter_no, block_id, text) of the chapter. An excerpt of fewer than `least` characters, or a series
    without any, binds nowhere; letters are compared as they are.

    Excerpts find their blocks by containment. Series with the same excerpts are one class, and a class looks only at the
    blocks of its rarest excerpt, so neither common excerpts nor a chapter with all blocks multiply series by blocks."""
    folder = shared_dir(series.sparkSession, "bound")
    s = cut(_excerpts(series, least).select("series_id", "chapter_no", "parts"), folder, "series")
    classes = s.select("chapter_no", "parts").distinct()
    hits = cut(_standing(classes, block_rows), folder, "hits")
    often = hits.groupBy("chapter_no", "needle").agg(F.count("*").alias("n"))
    each = classes.select("chapter_no", "parts", F.explode("parts").alias("needle"))
    rare = each.join(often, ["chapter_no", "needle"], "left").groupBy("chapter_no", "parts").agg(F.min_by("needle", F.struct("n", "needle")).alias("needle"), F.count_if(F.col("n").isNull()).alias("missing"))
    maybe = rare.filter("missing = 0").join(hits, ["chapter_no", "needle"]).select("chapter_no", "parts", "block_id")
    held = maybe.select("chapter_no", "parts", "block_id", F.explode("parts").alias("needle")).join(hits, ["chapter_no", "needle", "block_id"])
    held = held.groupBy("chapter_no", "parts", "block_id").agg(F.count("*").alias("n")).filter(F.col("n") == F.size("parts"))
    bound = held.groupBy("chapter_no", "parts").agg(F.count("*").alias("n"), F.min("block_id").alias("block_id")).filter("n = 1")
    return s.join(bound, ["chapter_no", "parts"]).select("series_id", "block_id")


def place_series(series: DataFrame, block_rows: DataFrame, least: int = 6) -> DataFrame:
    """SER-11: (series_id, ordinal) of the last block that an excerpt stands in, for series each of whose excerpts stands
    in exactly one of block_rows(chapter_no, block_id, ordinal, text); the others go to the chapter's end (null)."""
    s = _excerpts(series, least).select("series_id", "chapter_no", "parts")
    hits = _standing(s.select("chapter_no", "parts").distinct(), block_rows).join(block_rows.select("chapter_no", "block_id", "ordinal"), ["chapter_no", "block_id"])
    single = hits.groupBy("chapter_no", "needle").agg(F.count("*").alias("n"), F.max("ordinal").alias("ordinal")).filter("n = 1")
    at = s.select("series_id", "chapter_no", F.size("parts").alias("size"), F.explode("parts").alias("needle")).join(single, ["chapter_no", "needle"])
    at = at.groupBy("series_id", "size").agg(F.count("*").alias("n"), F.max("ordinal").alias("ordinal")).filter("n = size")
    return series.select("series_id").join(at.select("series_id", "ordinal"), "series_id", "left")


def ledger(series: DataFrame) -> DataFrame:
    """SER-12: a series' points as rows, unconfirmed where nothing else is said."""
    return series.select("series_id", F.posexplode("points").alias("i", "p"), F.coalesce("status", F.lit("unconfirmed")).alias("status")).select("series_id", "i", F.col("p.label").alias("period"), F.col("p.value").alias("value"), "status")


def json_candidates(rows: DataFrame, column: str = "answer", fields: tuple[str, str] = ("evidence_id", "exact_quote")) -> DataFrame:
    """TXT-29: (id, evidence_id, quote, row) of the JSON rows in an answer's prose; see functions.json_text."""
    return rows.select("id", F.explode(J.json_rows(F.col(column), fields)).alias("x")).select("id", "x.evidence_id", "x.quote", "x.row")
