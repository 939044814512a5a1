"""Text-quality rules over chapters and documents (QLT). Patterns and limits are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .retrieval import pack_flush

NUMBER = r"(?<![A-Za-z0-9])([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)"


def named(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))


def chapter_rules(text: Column, stray: str = r"(?i)\b(?:todo|tbd|lorem ipsum|undefined|nan)\b") -> Column:
    """QLT-1: unfinished tail, list item cut off, stray tokens, raw formulas, several units for one table."""
    tail = F.rtrim(text)
    return named({
        "unfinished": (F.length(tail) > 0) & ~tail.rlike(r"""[.!?:;)\]|"'”»。！？；：）%*]$"""),
        "cut_list": tail.rlike(r"\n\s*(?:[-*+]|[0-9]+[.)])\s*$"),
        "stray_token": text.rlike(stray),
        "raw_formula": text.rlike(r"\\(?:frac|text|times|mathrm)\b|\$\$"),
    })


#: Sections on market size, what names a series' scope in a list row, and geographies before it (fixed patterns).
MARKET_HEADING = "市场规模.*(?:增速|增长)|市场规模与增速"
SERIES_SCOPE = r"([A-Za-z一-鿿][A-Za-z0-9一-鿿·（）()\-/]{1,29}?)(?:市场规模|市场[：:])"
GEOGRAPHY = "^(?:中国|国内|全国|全球)"


def series_rules(chapters: DataFrame, early: tuple[int, ...] = (1, 2), least: int = 3, heading: str = MARKET_HEADING, scope: str = SERIES_SCOPE, geography: str = GEOGRAPHY) -> DataFrame:
    """QLT-1: (report, chapter, year_table, mixed_scopes) of chapters (report, chapter, text): whether a section on market
    size in one of the `early` chapters lists `least` years or more, and whether a section's rows name several scopes.

    Rows are list items with a year. A row's scope is the name before the measure after its year, geographies aside;
    rows without a name say nothing. Chapters without such a section have false for both. A chapter is judged within its row.
    """
    keys = ["report", "chapter"]
    rows = chapters.select(*keys, F.split(F.coalesce("text", F.lit("")), r"\r?\n").alias("lines"))
    heads = F.array_compact(F.transform("lines", lambda x, i: F.when(x.rlike(r"^\s*#{1,6}\s+"), i)))
    rows = rows.select(*keys, "lines", heads.alias("heads"))
    sections = F.transform("heads", lambda a, i: F.struct(a.alias("a"), F.coalesce(F.get("heads", i + 1), F.size("lines")).alias("b")))
    market = F.filter(sections, lambda s: F.get("lines", s["a"]).rlike(heading))
    items = F.transform(market, lambda s: F.filter(F.slice("lines", s["a"] + 1, s["b"] - s["a"]), lambda x: x.rlike(r"^\s*[-*+]\s+.*20[0-9]{2}年")))

    def name(line: Column) -> Column:
        said = F.regexp_replace(F.regexp_replace(line, r"^\s*[-*+]\s+", ""), r"^.*?20[0-9]{2}年[，,:：\s]*", "")
        return F.nullif(F.regexp_replace(F.regexp_replace(F.regexp_extract(said, scope, 1), geography, ""), "^[的：: ]+|[的：: ]+$", ""), F.lit(""))

    counts = F.transform(items, lambda s: F.struct(F.size(s).alias("n"), F.size(F.array_distinct(F.array_compact(F.transform(s, name)))).alias("scopes")))
    most = lambda field: F.coalesce(F.array_max(F.transform("counts", lambda s: s[field])), F.lit(0))
    return rows.select(*keys, counts.alias("counts")).select(*keys, (F.col("chapter").isin(*early) & (most("n") >= least)).alias("year_table"), (most("scopes") > 1).alias("mixed_scopes"))


def content_rules(text: Column, echo: str = r"(?i)^\s*(?:as an assistant|here is the|sure,)", least: int = 80) -> Column:
    """QLT-2: echo of instructions, too short, a question spliced into the text."""
    return named({"echo": text.rlike(echo), "too_short": F.length(F.trim(text)) < least, "spliced_question": text.rlike(r"[a-z]\?[a-z]")})


def decision_rules(text: Column, ready: Column, excluded: list[str], needed: list[str] = ()) -> Column:
    """QLT-3: a percentage given as a size, vague thresholds, missing tokens, a decision without numbers, a claim of
    readiness against the records, and terms outside the scope."""
    drift = F.lit(False)
    for t in excluded:
        drift = drift | F.contains(F.lower(text), F.lit(t))
    lack = F.lit(False)
    for t in needed:
        lack = lack | ~F.contains(F.lower(text), F.lit(t))
    decided = text.rlike(r"(?i)\b(?:go|no-go|approve|reject)\b")
    return named({"size_as_percent": text.rlike(r"(?i)market size[^.]{0,30}?[0-9]+(?:\.[0-9]+)?\s*%"), "vague_threshold": text.rlike(r"(?i)\b(?:sufficient|reasonable|adequate)\s+(?:level|threshold|amount)"), "missing_token": lack,
                  "no_bands": decided & ~text.rlike(r"[0-9]"), "not_ready": decided & ~ready, "scope_drift": drift})


def topic_coverage(text: Column, topics: dict[str, str]) -> Column:
    """QLT-4: the topics whose pattern does not occur."""
    return named({n: ~text.rlike(p) for n, p in topics.items()})


def blocking(*families: Column) -> Column:
    """QLT-5: the union of rule families."""
    return F.array_distinct(F.concat(*families))


def _tables(rows: DataFrame) -> DataFrame:
    """`table`: the position of the first of two or more table rows in succession, null elsewhere; `place` counts them from 1."""
    rows = rows.withColumn("bar", F.col("line").rlike(r"^\s*\|.+\|\s*$"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = rows.withColumn("start", F.last(F.when(F.col("bar") & ~F.coalesce(F.lag("bar").over(order), F.lit(False)), F.col("pos")), ignorenulls=True).over(order))
    rows = rows.withColumn("start", F.when(F.col("bar"), F.col("start")))
    size = F.count("*").over(Window.partitionBy("doc_id", "start"))
    return rows.withColumn("table", F.when(F.col("bar") & (size > 1), F.col("start"))).withColumn("place", F.when(F.col("table").isNotNull(), F.col("pos") - F.col("start") + 1)).drop("bar", "start")


def without_conclusions(docs: DataFrame, heading: str, line: str, note: str, header: str | None = None) -> DataFrame:
    """QLT-6: drops sections whose heading matches, lines that match and, with `header`, tables of two rows or more whose
    first two match it; where something went, one note closes the text. A document of which nothing stays is the note."""
    b = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.startswith("line", F.lit("#"))
    b = b.withColumn("in_bad", F.coalesce(F.last(F.when(head, F.col("line").rlike(heading)), ignorenulls=True).over(w), F.lit(False)))
    b = b.withColumn("gone", F.col("in_bad") | F.col("line").rlike(line))
    if header is not None:
        top = F.bool_or((F.col("place") <= 2) & F.col("line").rlike(header)).over(Window.partitionBy("doc_id", "table"))
        b = _tables(b).withColumn("gone", F.col("gone") | (F.col("table").isNotNull() & F.coalesce(top, F.lit(False))))
    out = b.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("pos", "line")))).alias("s"), F.bool_or("gone").alias("cut"))
    text = F.array_join(F.transform("s", lambda x: x["line"]), "\n")
    return out.select("doc_id", F.when(F.col("cut"), F.concat_ws("\n", F.nullif(text, F.lit("")), F.lit(note))).otherwise(text).alias("text"), "cut")


def numbers(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(NUMBER), F.lit(1)), lambda x: F.regexp_replace(x, ",", "")))


def new_numbers(derived: Column, source: Column) -> Column:
    """QLT-7: numbers of a derived text that its source does not have."""
    return F.array_sort(F.array_except(numbers(derived), numbers(source)))


def references(docs: DataFrame, heading: str = r"(?i)^#+\s*(?:references|sources|bibliography)") -> tuple[DataFrame, DataFrame]:
    """QLT-8: (bodies, reference lines): sections under a bibliography heading split off."""
    b = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("ref", F.coalesce(F.last(F.when(F.startswith("line", F.lit("#")), F.col("line").rlike(heading)), ignorenulls=True).over(w), F.lit(False)))
    body = b.filter("not ref").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return body, b.filter("ref and line not like '#%'").filter(F.trim("line") != "").select("doc_id", "pos", "line")


def merge_sources(refs: DataFrame) -> DataFrame:
    """QLT-8: refs (chapter_no, number, url) as rows (url_key, ref, cited, mentions): each reference "chapter-number" to a source once, with the number of
    references that its source has and how often they are given. Sources are canonical URLs; one that very many chapters cite stays many rows."""
    r = refs.withColumn("url_key", T.url_for_grading(F.col("url"))).withColumn("ref", F.concat_ws("-", F.col("chapter_no").cast("string"), F.col("number").cast("string")))
    once = r.groupBy("url_key", "ref").agg(F.count("*").alias("given"))
    per = once.groupBy("url_key").agg(F.count("*").alias("cited"), F.sum("given").alias("mentions"))
    same = once.withColumnRenamed("url_key", "k")
    return same.join(per, F.col("k").eqNullSafe(F.col("url_key"))).select("url_key", "ref", "cited", "mentions")


def outline(docs: DataFrame, limit: int = 400) -> DataFrame:
    """QLT-9: reading blocks: lines under the heading above them, short neighbours merged up to the limit."""
    b = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("head", F.sum(F.startswith("line", F.lit("#")).cast("int")).over(w))
    per = b.groupBy("doc_id", "head").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("s"))
    g = pack_flush(F.transform("s", lambda x: x["line"]), limit)
    rows = per.select("doc_id", "head", F.explode(F.arrays_zip(F.col("s").alias("s"), g.alias("g"))).alias("x"))
    return rows.groupBy("doc_id", "head", F.col("x.g").alias("block")).agg(F.count("*").alias("lines"), F.sum(F.length("x.s.line")).alias("chars"))
