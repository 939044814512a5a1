"""Grading, triage and review of evidence rows (EVD, FLT, VAL).

Evidence has (id, project_id, chapter_no, title, url, publisher, source_type, search_query, score, excerpt); host and
hint lists are parameters. "First" always means by (id).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

WEAK_HOSTS = ("docs.example.net",)
OFFICIAL_HOSTS = ("gov.example.org", "stats.example.org")
OFFICIAL_TYPES = ("annual_report", "official_statistics", "standard")
RESEARCH_TYPES = ("research_report", "academic")
RESEARCH_HINTS = ("university", "institute", "research", "association")
METRICS = ("revenue", "demand", "capacity", "price", "cost")


def nonblank(c: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) != ""


def classify(ev: DataFrame, weak=WEAK_HOSTS, official=OFFICIAL_HOSTS, official_types=OFFICIAL_TYPES, hints=RESEARCH_HINTS, research_types=RESEARCH_TYPES) -> DataFrame:
    """EVD-1: adds grade (A to D), grade_reason and origin_key; the first rule that applies decides."""
    url = T.url_for_grading(F.coalesce("url", F.lit("")))
    host, kind, publisher = T.host_of(url), F.lower(F.coalesce("source_type", F.lit(""))), F.lower(F.trim(F.coalesce("publisher", F.lit(""))))
    hinted = F.lit(False)
    for h in hints:
        hinted = hinted | F.contains(publisher, F.lit(h))
    grade = (F.when(T.is_host(host, list(weak)), F.struct(F.lit("D").alias("g"), F.lit("library").alias("r")))
             .when(T.is_host(host, list(official)) | kind.isin(*official_types), F.struct(F.lit("A").alias("g"), F.lit("official").alias("r")))
             .when(hinted | kind.isin(*research_types), F.struct(F.lit("B").alias("g"), F.lit("research").alias("r")))
             .when((publisher != "") | (host != ""), F.struct(F.lit("C").alias("g"), F.lit("named").alias("r")))
             .otherwise(F.struct(F.lit("D").alias("g"), F.lit("anonymous").alias("r"))))
    raw = F.when(url != "", url).otherwise(F.concat(F.trim(F.coalesce("publisher", F.lit(""))), F.lit("|"), F.coalesce("title", F.lit(""))))
    return ev.withColumn("_g", grade).withColumn("grade", F.col("_g.g")).withColumn("grade_reason", F.col("_g.r")).withColumn("origin_key", T.stable_id(raw, 10, "sha1")).drop("_g")


def audit(graded: DataFrame, keys: list[str]) -> DataFrame:
    """EVD-2: rows per grade, distinct origins, distinct A or B origins, ready for a cross-check from two of these on."""
    ab = F.when(F.col("grade").isin("A", "B"), F.col("origin_key"))
    out = graded.groupBy(*keys).agg(*(F.count_if(F.col("grade") == g).alias(f"n_{g.lower()}") for g in "ABCD"), F.countDistinct("origin_key").alias("origins"), F.countDistinct(ab).alias("ab_origins"))
    return out.withColumn("ready", F.col("ab_origins") >= 2)


FINGERPRINTED = ("title", "url", "publisher", "source_type", "search_query", "excerpt")


def fingerprint(ev: DataFrame, columns=FINGERPRINTED) -> DataFrame:
    """EVD-3: a hash of the source fields; null and empty count alike."""
    return ev.withColumn("fingerprint", F.sha2(F.concat_ws("\u001f", *(F.coalesce(c, F.lit("")) for c in columns)), 256))


def batch_fingerprint(fingerprinted: DataFrame, keys: list[str], briefs: DataFrame | None = None) -> DataFrame:
    """EVD-4: a hash of each batch over its key, its brief (briefs(keys, brief), none counts as empty) and all its row fingerprints, whatever their order.

    Fingerprints are summed as four numbers of 60 bits each and counted, in partial aggregates, so no batch is gathered;
    batches with equal rows, repeated ones as often, have equal hashes.
    """
    part = lambda i: F.conv(F.substring("fingerprint", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")
    rows = fingerprinted.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(part(i)).alias(f"s{i}") for i in range(4)))
    if briefs is not None:
        rows = rows.join(briefs.select(*keys, "brief"), keys, "left")
    brief = F.coalesce("brief", F.lit("")) if briefs is not None else F.lit("")
    return rows.select(*keys, F.sha2(F.concat_ws(",", *(F.col(k).cast("string") for k in keys), brief, *(F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3"))), 256).alias("batch_fingerprint"))


def exact_quotes(ev: DataFrame, terms: DataFrame | None = None, important: str = r"(?i)\b(?:record|first|largest|must|never)\b", most: int = 5) -> DataFrame:
    """EVD-5: per row the best sentences: 4 for a number, 2 for a key term, up to 3 for shared chapter terms
    (terms(chapter_no, terms array)), 1 for a year, minus 2 if cut off; ties by position."""
    s = ev.select("id", "chapter_no", F.posexplode(T.sentences(F.col("excerpt"), ends="。！？；.!?;", least=8, most=500)).alias("position", "quote"))
    number, key = F.col("quote").rlike(T.MEASURE), F.col("quote").rlike(important)
    overlap = F.lit(0)
    if terms is not None:
        s = s.join(terms, "chapter_no", "left")
        overlap = F.least(F.lit(3), F.coalesce(F.size(F.array_intersect(T.ngrams(F.col("quote")), F.col("terms"))), F.lit(0)))
    cut = F.contains("quote", F.lit("...")) | F.contains("quote", F.lit("…"))
    s = s.withColumn("quote_score", F.when(number, 4).otherwise(0) + F.when(key, 2).otherwise(0) + overlap + F.when(F.col("quote").rlike(T.YEAR), 1).otherwise(0) - F.when(cut, 2).otherwise(0)).filter(number | key)
    w = Window.partitionBy("id").orderBy(F.desc("quote_score"), "position")
    return s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("id", "rank", "position", "quote", "quote_score")


def relevance(ev: DataFrame, core: Column, chapter: Column) -> DataFrame:
    """EVD-6: (2 core hits + chapter hits) / max(1, min(12, terms)), 1 at most; 0.5 without terms; obvious_low if
    nothing hits and the provider's score is below 0.15. core and chapter are arrays of terms."""
    hay = T.ngrams(F.concat_ws(" ", "title", "excerpt", "publisher", "search_query"))
    ev = ev.withColumn("_h", hay)
    c, h = F.size(F.array_intersect(core, "_h")), F.size(F.array_intersect(chapter, "_h"))
    terms = F.size(core) + F.size(chapter)
    score = F.when(terms == 0, 0.5).otherwise(F.least(F.lit(1.0), (2 * c + h) / F.greatest(F.lit(1), F.least(F.lit(12), terms))))
    low = (F.size(core) > 0) & (c == 0) & (h == 0) & (F.coalesce("score", F.lit(0.0)) < 0.15)
    return ev.withColumn("relevance", score).withColumn("obvious_low", low).drop("_h")


#: Places that a claim may be about, and marks of provinces, which may be followed by one more.
PLACES = ("全球", "中国", "全国", "长三角", "珠三角")
PROVINCES = "京津沪渝粤浙苏鲁豫川鄂湘闽皖冀晋辽吉黑陕甘青琼云贵桂内蒙宁新藏"


def place_pattern(places: tuple[str, ...] = PLACES, marks: str = PROVINCES, after: str = "省") -> str:
    """A pattern of the first place in a text: names of any number of words, longer ones before those they begin with."""
    names = [re.escape(p) for p in sorted(places, key=lambda p: (-len(p), p))] + ([f"[{marks}]{after}?"] if marks else [])
    return "|".join(names)


def claim_keys(ev: DataFrame, metrics=METRICS, places: str | None = None) -> DataFrame:
    """EVD-7: (id, metric, year, unit, geography, subject, value) of every measured value in sentences that name a metric.
    Geography is the first match of `places` (see place_pattern) in the sentence, or empty."""
    s = ev.select("id", "chapter_no", F.explode(T.sentences(F.col("excerpt"), ends=".!?;。！？；", least=8, most=500)).alias("s"))
    metric = F.lower(F.regexp_extract("s", rf"(?i)\b({'|'.join(metrics)})\b", 1))
    s = s.withColumn("metric", metric).filter("metric <> ''")
    subject = T.bare(F.regexp_replace(F.regexp_extract("s", rf"(?is)^(.*?)\b(?:{'|'.join(metrics)})\b", 1), T.YEAR, ""))
    s = s.withColumn("geography", F.regexp_extract("s", places or place_pattern(), 0))
    s = s.withColumn("year", F.regexp_extract("s", T.YEAR, 1)).withColumn("subject", F.right(subject, F.lit(30)))
    s = s.select("id", "chapter_no", "metric", "year", "geography", "subject", F.explode(T.measures(F.col("s"))).alias("m"))
    return s.select("id", "chapter_no", "metric", "year", "geography", "subject", F.col("m.unit").alias("unit"), T.safe_number(F.col("m.value")).alias("value"))


CLAIM = ("chapter_no", "metric", "year", "unit", "geography", "subject")


def conflicts(claims: DataFrame, keys=CLAIM) -> DataFrame:
    """EVD-8: ids of rows that make a claim on which another value is stated too."""
    disputed = claims.groupBy(*keys).agg(F.countDistinct("value").alias("n")).filter("n > 1")
    return claims.join(disputed.select(*keys), list(keys), "left_semi").select("id").distinct()


def duplicate_owner(ev: DataFrame) -> DataFrame:
    """EVD-9: adds duplicate_of: the first row of the chapter with the same excerpt, white space and case aside."""
    key = F.lower(F.regexp_replace(F.coalesce("excerpt", F.lit("")), r"\s+", ""))
    place = ["project_id", "chapter_no", "_k"]
    # Firsts are minima, taken before the shuffle; rows without an excerpt don't meet them, and a key of many rows is split by the join.
    keyed = ev.withColumn("_k", F.when(key != "", F.sha2(key, 256)))
    firsts = keyed.filter(F.col("_k").isNotNull()).groupBy(*place).agg(F.min("id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in place[:2]] + [F.col("a._k") == F.col("b._k")]
    out = keyed.alias("a").join(firsts.alias("b"), same, "left")
    return out.select(*(F.col(f"a.`{c}`") for c in ev.columns if c != "duplicate_of"), F.when(F.col("b._first") < F.col("a.id"), F.col("b._first")).alias("duplicate_of"))


def triage(rows: DataFrame) -> DataFrame:
    """EVD-10: state, confidence and risks from grade, duplicate_of, obvious_low, conflicting and excerpt."""
    cut = F.contains("excerpt", F.lit("...")) | F.contains("excerpt", F.lit("…"))
    doubt = F.col("obvious_low") | F.col("conflicting") | (F.col("grade") == "D") | cut
    state = F.when(~nonblank("excerpt"), "empty").when(F.col("duplicate_of").isNotNull(), "duplicate").when(doubt, "manual_review").otherwise("recommended")
    confidence = F.when(F.col("state") == "empty", 1.0).when(F.col("state") == "duplicate", 0.98).when(F.col("state") == "manual_review", 0.45).when(F.col("grade").isin("A", "B"), 0.86).otherwise(0.72)
    risks = F.array_compact(F.array(*(F.when(c, n) for n, c in (
        ("off_topic", F.col("obvious_low")), ("conflict", F.col("conflicting")), ("cut", cut), ("weak_source", F.col("grade") == "D"), ("no_publisher", ~nonblank("publisher")), ("no_url", ~nonblank("url"))))))
    return rows.withColumn("state", state).withColumn("confidence", confidence).withColumn("risks", F.when(F.col("state").isin("empty", "duplicate"), F.expr("cast(array() as array<string>)")).otherwise(risks))


def validate_quotes(proposed: DataFrame, ev: DataFrame) -> DataFrame:
    """EVD-11: proposed(id, quote) with accepted: the quote has 8 to 500 characters and stands in the row it cites."""
    out = proposed.join(ev.select("id", "excerpt"), "id", "left")
    ok = F.length("quote").between(8, 500) & F.contains(F.coalesce("excerpt", F.lit("")), F.col("quote"))
    return out.select("id", "quote", F.coalesce(ok, F.lit(False)).alias("accepted"))


def review_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """EVD-12: rows by state and by human decision, quotes, open manual reviews, and whether the batch is complete."""
    pending = (F.col("state") == "manual_review") & F.col("decision").isNull()
    out = rows.groupBy(*keys).agg(*(F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("empty", "duplicate", "manual_review", "recommended")),
                                  F.count_if(F.col("decision") == "approved").alias("approved"), F.count_if(F.col("decision") == "excluded").alias("excluded"), F.sum("quotes").alias("quotes"), F.count_if(pending).alias("pending"))
    return out.withColumn("complete", F.col("pending") == 0)


def route(rows: DataFrame, mode: str) -> DataFrame:
    """EVD-13: new decisions for undecided rows: 'recommended' approves recommended rows with quotes, 'clean' excludes
    duplicates and empty rows, 'all' approves what is not empty and excludes the rest."""
    s = F.col("state")
    d = {"recommended": F.when((s == "recommended") & (F.col("quotes") > 0), "approved"), "clean": F.when(s.isin("duplicate", "empty"), "excluded"), "all": F.when(s == "empty", "excluded").otherwise("approved")}[mode]
    return rows.withColumn("decision", F.coalesce("decision", d))


def warnings(rows: DataFrame) -> DataFrame:
    """EVD-14: notes on a row: excerpt, publisher, date, url, short excerpt."""
    notes = (("no_excerpt", ~nonblank("excerpt")), ("no_publisher", ~nonblank("publisher")), ("no_date", ~nonblank("published_at")), ("no_url", ~nonblank("url")), ("short", nonblank("excerpt") & (F.length("excerpt") < 40)))
    return rows.withColumn("warnings", F.array_compact(F.array(*(F.when(c, n) for n, c in notes))))


def staleness(old: DataFrame, new: DataFrame, content: DataFrame) -> DataFrame:
    """EVD-15: per chapter the number of changed reviews and whether they are newer than its text:
    old and new(id, chapter_no, decision), content(chapter_no, content_revision)."""
    both = new.select("id", "chapter_no", F.col("decision").alias("d1")).join(old.select("id", F.col("decision").alias("d0")), "id", "full")
    rev = both.groupBy("chapter_no").agg(F.count_if(~F.col("d0").eqNullSafe(F.col("d1"))).alias("evidence_revision"))
    return rev.join(content, "chapter_no", "left").withColumn("stale", F.col("evidence_revision") > F.coalesce("content_revision", F.lit(0)))


def counts(chapters: DataFrame, ev: DataFrame) -> DataFrame:
    """EVD-16: evidence rows per chapter, 0 where there are none."""
    n = ev.groupBy("project_id", "chapter_no").agg(F.count("*").alias("evidence"))
    return chapters.join(n, ["project_id", "chapter_no"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(0)))


def usable(rows: DataFrame) -> DataFrame:
    """FLT-1: rows with an excerpt that no one has excluded; automatic states never exclude."""
    return rows.filter(nonblank("excerpt") & ~F.col("decision").eqNullSafe(F.lit("excluded")))


def live(documents: DataFrame, state: DataFrame) -> DataFrame:
    """FLT-2: documents without a deleted state."""
    return documents.join(state.filter("deleted").select("doc_id"), "doc_id", "left_anti")


def current_assessment(rows: DataFrame, version: int) -> DataFrame:
    """FLT-3: the stored state if version, fingerprint and chapter still match, else null."""
    ok = (F.col("assessed_version") == version) & (F.col("assessed_fingerprint") == F.col("fingerprint")) & (F.col("assessed_chapter") == F.col("chapter_no"))
    return rows.withColumn("current_state", F.when(ok, F.col("assessed_state")))


def violations(records: DataFrame) -> DataFrame:
    """VAL-1: rules a record breaks: period order; verified needs source and date, is no assumption, and has no gaps if calculated."""
    v, basis = F.col("verified"), F.coalesce("basis", F.lit(""))
    rules = (("period_order", F.col("period_end") < F.col("period_start")), ("no_source", v & ~nonblank("source")), ("no_date", v & F.col("as_of_date").isNull()), ("assumption", v & basis.isin("assumption", "unverified")), ("open_gaps", v & (basis == "calculated") & (F.col("gaps") > 0)))
    return records.withColumn("violations", F.array_compact(F.array(*(F.when(c, n) for n, c in rules))))
