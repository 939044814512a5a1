"""Queries for evidence (EVD, FLT, VAL), over pages, documents, orders and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from .base import Book, derived, table
from .text_queries import _NUM, _UNIT

BOOK = Book()

#: Evidence made of pages and documents; the same SQL runs in both engines.
EV = """select p.page_id as id, p.page_id % 5 as project_id, p.page_id % 10 + 1 as chapter_no, split_part(d.text, chr(10), 1) as title, case when p.page_id % 13 = 0 then null else p.url end as url,
  case when p.page_id % 6 = 0 then null when p.page_id % 6 = 1 then 'Valley University' else regexp_extract(p.url, '://([^/?#:]+)', 1) end as publisher,
  case when p.page_id % 9 = 0 then 'annual_report' when p.page_id % 9 = 1 then 'academic' else 'web' end as source_type, d.lang as search_query, (p.page_id * 37 % 100) / cast(100 as double) as score,
  case when p.page_id % 11 = 0 then '' else d.text end as excerpt
from {pages} p join {documents} d on d.doc_id = case when p.page_id % 4 = 0 then p.page_id - p.page_id % 80 else p.page_id end"""
_EV = EV.format(pages="pages", documents="documents")
#: Measured claims made of orders.
CLAIMS = """select o_orderkey as id, o_orderkey % 5 as project_id, o_custkey % 10 + 1 as chapter_no, concat('In ', cast(year(o_orderdate) as {s}), ' the demand of segment ', cast(o_custkey % 7 as {s}), ' was ', cast(cast(floor(o_totalprice / 20000) as bigint) as {s}), ' thousand units sold. It rained.') as excerpt from {orders}"""
_CLAIMS = CLAIMS.replace("{s}", "varchar").replace("{orders}", "orders")


def _ev(s, d):
    return derived(s, d, EV, "pages", "documents")


def _claims(s, d):
    return derived(s, d, CLAIMS.replace("{s}", "string"), "orders")


_URL = r"""u as (select *, coalesce(url, '') as u0 from ({ev})),
u1 as (select *, lower(regexp_extract(u0, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as sc, lower(regexp_extract(u0, '://([^/?#]+)', 1)) as ho, regexp_replace(regexp_extract(u0, '://[^/?#]+([^?#]*)', 1), '/+$', '') as pa,
  array_to_string(list_filter(string_split(regexp_extract(u0, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(?:utm_|spm|from)')), '&') as qq from u),
u2 as (select *, case when u0 = '' then '' else sc || '://' || ho || pa || case when qq <> '' then '?' || qq else '' end end as uk, split_part(ho, ':', 1) as host from u1),
gr as (select *, case when host = 'docs.example.net' or host like '%.docs.example.net' then 'D' when host in ('gov.example.org', 'stats.example.org') or host like '%.gov.example.org' or host like '%.stats.example.org' or source_type in ('annual_report', 'official_statistics', 'standard') then 'A'
  when regexp_matches(lower(coalesce(publisher, '')), 'university|institute|research|association') or source_type in ('research_report', 'academic') then 'B' when coalesce(publisher, '') <> '' or host <> '' then 'C' else 'D' end as grade,
  left(sha1(case when uk <> '' then uk else trim(coalesce(publisher, '')) || '|' || coalesce(title, '') end), 10) as origin_key from u2)""".replace("{ev}", _EV)


@BOOK.add("evd_1_source_grade", "with " + _URL + " select id, grade, origin_key from gr")
def _(s, d):
    return E.classify(_ev(s, d)).select("id", "grade", "origin_key")


@BOOK.add("evd_2_evidence_audit", "with " + _URL + """ select project_id, count(*) filter (grade = 'A')::bigint as n_a, count(*) filter (grade = 'B')::bigint as n_b, count(*) filter (grade = 'C')::bigint as n_c, count(*) filter (grade = 'D')::bigint as n_d,
 count(distinct origin_key)::bigint as origins, count(distinct case when grade in ('A', 'B') then origin_key end)::bigint as ab_origins, count(distinct case when grade in ('A', 'B') then origin_key end) >= 2 as ready from gr group by project_id""")
def _(s, d):
    return E.audit(E.classify(_ev(s, d)), ["project_id"])


_FP = f"fp as (select *, sha256(concat_ws(chr(31), coalesce(title, ''), coalesce(url, ''), coalesce(publisher, ''), coalesce(source_type, ''), coalesce(search_query, ''), coalesce(excerpt, ''))) as fingerprint from ({_EV}))"


@BOOK.add("evd_3_fingerprint", f"with {_FP} select id, fingerprint from fp")
def _(s, d):
    return E.fingerprint(_ev(s, d)).select("id", "fingerprint")


@BOOK.add("evd_4_batch_fingerprint", f"with {_FP} select project_id, chapter_no, sha256(concat_ws(',', project_id, chapter_no, case when chapter_no <> 3 then 'brief ' || chapter_no else '' end, count(*), " + ", ".join(f"sum(('0x' || substr(fingerprint, {1 + 15 * i}, 15))::bigint)" for i in range(4)) + ")) as batch_fingerprint from fp group by project_id, chapter_no")
def _(s, d):
    ev = E.fingerprint(_ev(s, d))
    briefs = ev.filter("chapter_no <> 3").select("project_id", "chapter_no", F.concat(F.lit("brief "), F.col("chapter_no").cast("string")).alias("brief")).distinct()
    return E.batch_fingerprint(ev, ["project_id", "chapter_no"], briefs)


@BOOK.add("evd_5_exact_quotes", rf"""
with e as ({_CLAIMS}), s as (select id, trim(unnest(string_split_regex(regexp_replace(excerpt, '([.!?;])', '\1' || chr(10), 'g'), '\n+'))) as quote from e),
k as (select id, quote from s where length(quote) between 8 and 500 and regexp_matches(quote, '(?:^|[^A-Za-z0-9_.,]){_NUM}\s*{_UNIT}')) select id, 1 as rank, quote, 5 as quote_score from k""")
def _(s, d):
    return E.exact_quotes(_claims(s, d)).select("id", "rank", "quote", "quote_score")


_NG = r"list_filter(list_distinct(regexp_extract_all(lower({}), '([a-z][a-z0-9]+)', 1)), lambda x: x not in ('the', 'of', 'and', 'to', 'in', 'is', 'a', 'for'))"


@BOOK.add("evd_6_relevance", f"""
with e as (select *, {_NG.format("concat_ws(' ', title, excerpt, publisher, search_query)")} as h from ({_EV})), c as (select *, len(list_intersect(['en', 'valley', 'thing', 'eder'], h)) as c, len(list_intersect(['that', 'be', 'by'], h)) as k from e)
select id, round(least(1.0, (2 * c + k) / 7), 6) as relevance, (c = 0 and k = 0 and coalesce(score, 0) < 0.15) as obvious_low from c""")
def _(s, d):
    a = lambda *x: F.array(*(F.lit(v) for v in x))
    return E.relevance(_ev(s, d), a("en", "valley", "thing", "eder"), a("that", "be", "by")).select("id", F.round("relevance", 6).alias("relevance"), "obvious_low")


_PLACES = ("East Asia", "Asia", "Western Europe")
_PLACED = "select id, project_id, chapter_no, replace(excerpt, ' sold.', case id % 4 when 0 then ' sold in East Asia.' when 1 then ' sold in Asia, not in Western Europe.' when 2 then ' sold in Western Europe.' else ' sold.' end) as excerpt from ({}) c"


def _placed(s, d):
    return derived(s, d, _PLACED.replace("({})", "(" + CLAIMS.replace("{s}", "string") + ")"), "orders")


_CK = rf"""e as (select *, ['East Asia', 'Asia', 'Western Europe', ''][id % 4 + 1] as geography from ({_PLACED.format(_CLAIMS)})), s as (select id, chapter_no, geography, trim(unnest(string_split_regex(regexp_replace(excerpt, '([.!?;])', '\1' || chr(10), 'g'), '\n+'))) as s from e),
m as (select *, lower(regexp_extract(s, '(?i)\b(revenue|demand|capacity|price|cost)\b', 1)) as metric, regexp_extract(s, '((?:19|20)[0-9]{{2}})', 1) as year,
  right(lower(regexp_replace(regexp_replace(regexp_extract(s, '(?is)^(.*?)\b(?:revenue|demand|capacity|price|cost)\b', 1), '\b(?:19|20)[0-9]{{2}}\b', '', 'g'), '[\s!-/:-@\[-`{{-~]+', '', 'g')), 30) as subject from s where length(s) >= 8),
ck as (select id, chapter_no, geography, metric, year, subject, unnest(regexp_extract_all(s, '(?:^|[^A-Za-z0-9_.,])({_NUM})\s*({_UNIT})', 1))::double as value, 'thousand' as unit from m where metric <> '')"""


@BOOK.add("evd_7_claim_keys", f"with {_CK} select id, metric, year, geography, subject, unit, value from ck")
def _(s, d):
    return E.claim_keys(_placed(s, d), places=E.place_pattern(_PLACES, "")).select("id", "metric", "year", "geography", "subject", "unit", F.col("value").cast("double").alias("value"))


@BOOK.add("evd_8_conflicts", f"with {_CK}, x as (select chapter_no, metric, year, unit, geography, subject from ck group by all having count(distinct value) > 1) select distinct id from ck join x using (chapter_no, metric, year, unit, geography, subject)")
def _(s, d):
    return E.conflicts(E.claim_keys(_placed(s, d), places=E.place_pattern(_PLACES, "")))


_DU = rf"du as (select id, case when k <> '' and min(id) over (partition by project_id, chapter_no, k) < id then min(id) over (partition by project_id, chapter_no, k) end as duplicate_of from (select *, lower(regexp_replace(excerpt, '\s+', '', 'g')) as k from ({_EV})))"


@BOOK.add("evd_9_duplicate_owner", f"with {_DU} select id, duplicate_of from du")
def _(s, d):
    return E.duplicate_owner(_ev(s, d)).select("id", "duplicate_of")


_TR = f"""with {_URL}, {_DU}, tr as (select gr.*, du.duplicate_of, case when trim(excerpt) = '' then 'empty' when duplicate_of is not null then 'duplicate' when score < 0.05 or grade = 'D' or excerpt like '%...%' or excerpt like '%…%' then 'manual_review' else 'recommended' end as state from gr join du using (id)),
dc as (select tr.*, case when l.quality = 1 then 'approved' when l.quality = 0 then 'excluded' end as decision from tr left join labels l on l.doc_id = tr.id)"""


def _triaged(s, d):
    rows = E.duplicate_owner(E.classify(_ev(s, d))).withColumn("obvious_low", F.col("score") < 0.05).withColumn("conflicting", F.lit(False))
    return E.triage(rows)


def _decided(s, d):
    q = table(s, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "approved").when(F.col("quality") == 0, "excluded").alias("decision"))
    return _triaged(s, d).join(q, "id", "left").withColumn("quotes", F.col("id") % 3)


@BOOK.add("evd_10_triage_state", _TR + """ select id, state, case when state = 'empty' then 1.0 when state = 'duplicate' then 0.98 when state = 'manual_review' then 0.45 when grade in ('A', 'B') then 0.86 else 0.72 end::double as confidence,
 case when state in ('empty', 'duplicate') then 0 else (score < 0.05)::int + (excerpt like '%...%' or excerpt like '%…%')::int + (grade = 'D')::int + (trim(coalesce(publisher, '')) = '')::int + (trim(coalesce(url, '')) = '')::int end as n_risks from tr""")
def _(s, d):
    return _triaged(s, d).select("id", "state", "confidence", F.size("risks").alias("n_risks"))


@BOOK.add("evd_11_quote_validation", f"with e as ({_EV}) select id, (length(q) between 8 and 500 and contains(excerpt, q)) as accepted from (select id, excerpt, case when id % 3 = 0 then 'made up words here' else left(title, 20) end as q from e)")
def _(s, d):
    ev = _ev(s, d)
    q = ev.select("id", F.when(F.col("id") % 3 == 0, "made up words here").otherwise(F.left("title", F.lit(20))).alias("quote"))
    return E.validate_quotes(q, ev).select("id", "accepted")


@BOOK.add("evd_12_review_summary", _TR + """ select project_id, count(*) filter (state = 'empty')::bigint as n_empty, count(*) filter (state = 'duplicate')::bigint as n_duplicate, count(*) filter (state = 'manual_review')::bigint as n_manual_review, count(*) filter (state = 'recommended')::bigint as n_recommended,
 count(*) filter (decision = 'approved')::bigint as approved, count(*) filter (decision = 'excluded')::bigint as excluded, sum(id % 3)::bigint as quotes, count(*) filter (state = 'manual_review' and decision is null)::bigint as pending, count(*) filter (state = 'manual_review' and decision is null) = 0 as complete from dc group by project_id""")
def _(s, d):
    return E.review_summary(_decided(s, d), ["project_id"])


@BOOK.add("evd_13_bulk_routing", _TR + """ select id, coalesce(decision, case when state = 'recommended' and id % 3 > 0 then 'approved' end) as by_recommended, coalesce(decision, case when state in ('duplicate', 'empty') then 'excluded' end) as by_clean, coalesce(decision, case when state = 'empty' then 'excluded' else 'approved' end) as by_all from dc""")
def _(s, d):
    rows = _decided(s, d)
    out = rows.select("id")
    for m in ("recommended", "clean", "all"):
        out = out.join(E.route(rows, m).select("id", F.col("decision").alias(f"by_{m}")), "id")
    return out


@BOOK.add("evd_14_warnings", f"with e as ({_EV}) select id, concat_ws(',', case when trim(excerpt) = '' then 'no_excerpt' end, case when trim(coalesce(publisher, '')) = '' then 'no_publisher' end, 'no_date', case when coalesce(url, '') = '' then 'no_url' end, case when trim(excerpt) <> '' and length(excerpt) < 40 then 'short' end) as warnings from e")
def _(s, d):
    return E.warnings(_ev(s, d).withColumn("published_at", F.lit(None).cast("string"))).select("id", F.array_join("warnings", ",").alias("warnings"))


@BOOK.add("evd_15_staleness", """with n as (select doc_id as id, doc_id % 10 + 1 as chapter_no, quality::varchar as d1, case when toxic = 1 then null else '1' end as d0 from labels)
select chapter_no, count(*) filter (d0 is distinct from d1)::bigint as evidence_revision, chapter_no * 4 as content_revision, count(*) filter (d0 is distinct from d1) > chapter_no * 4 as stale from n group by chapter_no""")
def _(s, d):
    l = table(s, d, "labels").withColumn("chapter_no", F.col("doc_id") % 10 + 1).withColumnRenamed("doc_id", "id")
    new, old = l.select("id", "chapter_no", F.col("quality").cast("string").alias("decision")), l.select("id", F.when(F.col("toxic") != 1, "1").alias("decision"))
    return E.staleness(old, new, l.select("chapter_no", (F.col("chapter_no") * 4).alias("content_revision")).distinct())


@BOOK.add("evd_16_counts", f"with e as ({_EV}), c as (select n_nationkey % 5 as project_id, (n_nationkey // 5) * 3 + 1 as chapter_no from nation) select c.project_id, c.chapter_no, (select count(*) from e where e.project_id = c.project_id and e.chapter_no = c.chapter_no)::bigint as evidence from c")
def _(s, d):
    ch = table(s, d, "nation").select((F.col("n_nationkey") % 5).alias("project_id"), (F.floor(F.col("n_nationkey") / 5).cast("int") * 3 + 1).alias("chapter_no"))
    return E.counts(ch, _ev(s, d))


@BOOK.add("flt_1_usable", _TR + " select id from dc where trim(excerpt) <> '' and decision is distinct from 'excluded'")
def _(s, d):
    return E.usable(_decided(s, d)).select("id")


@BOOK.add("flt_2_live_documents", "select source, count(*)::bigint as docs from documents where doc_id not in (select doc_id from labels where toxic = 1) group by source")
def _(s, d):
    return E.live(table(s, d, "documents"), table(s, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("deleted"))).groupBy("source").agg(F.count("*").alias("docs"))


@BOOK.add("flt_3_current_assessment", _TR + ", f as (select *, sha256(excerpt) as fingerprint from tr) select id, case when id % 5 > 0 and id % 4 > 0 then state end as current_state from f")
def _(s, d):
    rows = _triaged(s, d).withColumn("fingerprint", F.sha2("excerpt", 256))
    rows = rows.withColumn("assessed_version", F.when(F.col("id") % 5 > 0, 2).otherwise(1)).withColumn("assessed_fingerprint", F.col("fingerprint")).withColumn("assessed_chapter", F.when(F.col("id") % 4 > 0, F.col("chapter_no")).otherwise(0)).withColumn("assessed_state", F.col("state"))
    return E.current_assessment(rows, 2).select("id", "current_state")


@BOOK.add("val_1_record_validation", """with r as (select o_orderkey as id, o_orderkey % 2 = 0 as verified, case when o_custkey % 4 = 0 then '' else 'book' end as source, case when o_custkey % 5 = 0 then null else o_orderdate end as as_of, case o_orderkey % 3 when 0 then 'assumption' when 1 then 'calculated' else 'reported' end as basis, o_custkey % 3 as gaps, o_orderkey % 7 as a, o_custkey % 7 as b from orders)
select id, concat_ws(',', case when b < a then 'period_order' end, case when verified and source = '' then 'no_source' end, case when verified and as_of is null then 'no_date' end, case when verified and basis = 'assumption' then 'assumption' end, case when verified and basis = 'calculated' and gaps > 0 then 'open_gaps' end) as violations from r""")
def _(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = table(s, d, "orders").select(k.alias("id"), (k % 2 == 0).alias("verified"), F.when(c % 4 == 0, "").otherwise("book").alias("source"), F.when(c % 5 != 0, F.col("o_orderdate")).alias("as_of_date"),
                                     F.when(k % 3 == 0, "assumption").when(k % 3 == 1, "calculated").otherwise("reported").alias("basis"), (c % 3).alias("gaps"), (k % 7).alias("period_start"), (c % 7).alias("period_end"))
    return E.violations(r).select("id", F.array_join("violations", ",").alias("violations"))


QUERIES, ORACLE = BOOK.queries, BOOK.sql
