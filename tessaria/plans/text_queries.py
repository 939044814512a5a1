"""Queries for the scalar text functions (TXT, FLT, VAL), over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .base import Book, derived, table

BOOK = Book()
#: White space as Spark's patterns and DuckDB's both know it.
_LINES = "select doc_id, unnest(string_split(text, chr(10))) as line from documents"


@BOOK.add("txt_1_norm_key", r"""select doc_id, sha256(lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}_]', '', 'g'))) as norm_key from documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(T.norm_key(F.col("text")), 256).alias("norm_key"))


@BOOK.add("txt_2_name_key", r"""select page_id, lower(regexp_replace(regexp_replace(url, '\s', '', 'g'), '\.docx$', '')) as name_key from pages""")
def _(s, d):
    return table(s, d, "pages").select("page_id", T.name_key(F.col("url")).alias("name_key"))


@BOOK.add("txt_3_content_form", r"""select doc_id, sha256(replace(lower(regexp_replace(text, '\s', '', 'g')), 'ß', 'ss')) as content_hash from documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(T.content_form(F.col("text")), 256).alias("content_hash"))


@BOOK.add("txt_4_stable_id", "select doc_id, left(sha256(text), 24) as id24, left(sha1(text), 10) as id10 from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.stable_id(F.col("text")).alias("id24"), T.stable_id(F.col("text"), 10, "sha1").alias("id10"))


@BOOK.add("txt_5_cleaners", r"""
select doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) as collapsed, sha256(lower(regexp_replace(text, '[\s!-/:-@\[-`{-~]+', '', 'g'))) as bare,
       sha256(lower(regexp_replace(text, '[\s,*_`#>|]+', '', 'g'))) as no_marks from documents""")
def _(s, d):
    c = F.col("text")
    return table(s, d, "documents").select("doc_id", *(F.sha2(f(c), 256).alias(n) for n, f in (("collapsed", T.collapse), ("bare", T.bare), ("no_marks", T.no_marks))))


@BOOK.add("txt_5_key_cleaners", r"""
select doc_id, sha256(lower(regexp_replace(text, '[^\p{L}\p{M}\p{N}]+', '', 'g'))) as letters, sha256(lower(regexp_replace(replace(replace(text, '*', ''), '_', ''), '[\s\x{a0},，`]+', '', 'g'))) as no_list_marks from documents""")
def _(s, d):
    c = F.col("text")
    return table(s, d, "documents").select("doc_id", F.sha2(T.letters_and_digits(c), 256).alias("letters"), F.sha2(T.no_list_marks(c), 256).alias("no_list_marks"))


def _split_sql(ends: str, least: int, most: str = "", cut: str = "", text: str = "text") -> str:
    """Sentences in DuckDB, whose patterns have no look-behind: an end mark is followed by a line break first."""
    piece = f"trim(x{cut})" if not cut else f"left(trim(x), {cut})"
    return f"""
select doc_id, count(*)::bigint as n, sum(length(x))::bigint as chars, sha256(string_agg(x, '|' order by x)) as digest from (
  select distinct doc_id, x from (
    select doc_id, {piece} as x from (select doc_id, unnest(string_split_regex(regexp_replace({text}, '([{ends}])', '\\1' || chr(10), 'g'), '\\n+')) as x from documents))
  where length(x) >= {least} {most}) group by doc_id"""


def _summed(df, col):
    x = F.array_sort(col)
    return df.select("doc_id", col.alias("l")).filter(F.size("l") > 0).select("doc_id", F.size("l").cast("long").alias("n"), F.aggregate(F.transform("l", lambda v: F.length(v)), F.lit(0).cast("long"), lambda a, v: a + v).alias("chars"), F.sha2(F.array_join(F.array_sort("l"), "|"), 256).alias("digest"))


@BOOK.add("txt_6_sentences_a", _split_sql(".!?", 8, cut="800"))
def _(s, d):
    return _summed(table(s, d, "documents"), T.sentences(F.col("text"), ends=".!?", least=8, cut=800))


@BOOK.add("txt_7_sentences_b", _split_sql(".!?;", 8, "and length(x) <= 500"))
def _(s, d):
    return _summed(table(s, d, "documents"), T.sentences(F.col("text"), ends=".!?;", least=8, most=500))


@BOOK.add("txt_8_sentences_c", r"""
with l as (select doc_id, i, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)
           where not regexp_matches(ltrim(line), '^[#|]')),
t as (select doc_id, string_agg(regexp_replace(regexp_replace(line, '^\s*(?:[-*+]|[0-9]+[.)])\s+', ''), '\[[0-9,\s-]+\]', '', 'g'), chr(10) order by i) as text from l group by doc_id)
select doc_id, count(*)::bigint as n, sum(length(x))::bigint as chars, sha256(string_agg(x, '|' order by x)) as digest from (
  select distinct doc_id, trim(x) as x from (select doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?。！？；])', '\1' || chr(10), 'g'), '\n+')) as x from t) where length(trim(x)) >= 25) group by doc_id""")
def _(s, d):
    return _summed(table(s, d, "documents"), T.review_sentences(F.col("text")))


@BOOK.add("txt_9_sentences_d", _split_sql(".!?", 1, text="regexp_replace(text, '[*_`#>|]+', '', 'g')"))
def _(s, d):
    return _summed(table(s, d, "documents"), T.sentences(F.col("text"), ends=".!?", least=1, strip=r"[*_`#>|]+"))


@BOOK.add("txt_11_complete_context", r"""
select doc_id, case when length(text) <= 400 then text else regexp_extract(left(text, 400), '(?s)^(.*(?:[.!?。！？](?:\[[0-9-]+\])*|\n))', 1) || ' […]' end as context from documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.complete_context(F.col("text"), 400).alias("context"))


@BOOK.add("txt_12_query_fragment", r"""
select doc_id, case when length(f) <= 80 then f when length(h) >= 40 then h else left(f, 80) end as fragment
from (select doc_id, f, regexp_extract(left(f, 80), '(?s)^(.*)[\s,;.，；。]', 1) as h from (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as f from documents))""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.query_fragment(F.col("text"), 80).alias("fragment"))


#: Sentences with facts, made from orders: the same text in both engines.
FACTS = """
select o_orderkey as id, concat('In ', cast(year(o_orderdate) as varchar(8)), ' the revenue of clerk ', cast(o_custkey % 7 as varchar(8)), ' was ', cast(cast(floor(o_totalprice) as bigint) as varchar(20)), ' USD. ',
  case when o_orderkey % 3 = 0 then 'It rose by about 5 percent.' when o_orderkey % 3 = 1 then 'Costs were 1,250 thousand in Q3.' else concat('Output reached 12.5 million on ', left(cast(o_orderdate as varchar(30)), 10), '.') end) as text
from {orders}"""
_FACTS = FACTS.replace("{orders}", "orders")
_NUM = r"[-+−]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"
_UNIT = r"(?:%|percent|billion|million|thousand|USD|EUR|kg|km|units|days)"


def _facts(s, d):
    return derived(s, d, FACTS.replace("varchar(8)", "string").replace("varchar(20)", "string").replace("varchar(30)", "string"), "orders")


@BOOK.add("txt_13_measures", rf"""
with f as ({_FACTS}), m as (select id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_.,])({_NUM})\s*({_UNIT})', 1)) as value, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9_.,])({_NUM})\s*({_UNIT})', 2)) as unit from f)
select id, value, unit from m""")
def _(s, d):
    return _facts(s, d).select("id", F.explode(T.measures(F.col("text"))).alias("m")).select("id", "m.value", "m.unit")


@BOOK.add("txt_14_year_values", rf"""
with f as ({_FACTS}) select id, unnest(regexp_extract_all(text, '((?:19|20)[0-9]{{2}})[^0-9]{{1,48}}?({_NUM})\s*({_UNIT})', 1)) as year,
  unnest(regexp_extract_all(text, '((?:19|20)[0-9]{{2}})[^0-9]{{1,48}}?({_NUM})\s*({_UNIT})', 2)) as value from f""")
def _(s, d):
    return _facts(s, d).select("id", F.explode(T.year_values(F.col("text"))).alias("m")).select("id", "m.year", "m.value")


@BOOK.add("txt_15_date_tokens", rf"""
with f as ({_FACTS}) select id, string_agg(x, ',') as dates from (select id, unnest(regexp_extract_all(text, '(?:^|[^0-9])((?:19|20)[0-9]{{2}}(?:-(?:0[1-9]|1[0-2])(?:-(?:[0-2][0-9]|3[01]))?)?)(?:$|[^0-9])', 1)) as x from f) group by id""")
def _(s, d):
    return _facts(s, d).select("id", F.array_join(T.date_tokens(F.col("text"), r"(?<![0-9])((?:19|20)[0-9]{2}(?:-(?:0[1-9]|1[0-2])(?:-(?:[0-2][0-9]|3[01]))?)?)(?![0-9])"), ",").alias("dates"))


@BOOK.add("txt_16_ambiguous", rf"""
with f as ({_FACTS}) select id, (regexp_matches(text, '(?i)\b(?:about|around|approximately|roughly|nearly|over|under|more than|less than|up to|at least|at most)\b|[~≈约近超]')
  or regexp_matches(text, '{_NUM}\s*(?:%|{_UNIT})?\s*(?:-|–|—|~|to|至)\s*{_NUM}')) as ambiguous from f""")
def _(s, d):
    return _facts(s, d).select("id", T.is_ambiguous(F.col("text")).alias("ambiguous"))


@BOOK.add("txt_17_metric_name", rf"""
with f as ({_FACTS}), h as (select id, right(left(text, length(text) - length(regexp_replace(text, '^.*?(?:^|[^A-Za-z0-9_.,]){_NUM}\s*{_UNIT}', '')) ), 1000) as head, text from f),
n as (select id, regexp_replace(regexp_extract(text, '(?s)^(.*?[^A-Za-z0-9_.,]){_NUM}\s*{_UNIT}', 1), '\b(?:19|20)[0-9]{{2}}\b', '', 'g') as x from f)
select id, trim(regexp_replace(regexp_replace(regexp_replace(right(x, 70), '(?i)\b(?:in|was|is|were|are|reached|of|at|to|the)\b', ' ', 'g'), '[,:;.，：；]+', ' ', 'g'), '\s+', ' ', 'g')) as metric from n""")
def _(s, d):
    return _facts(s, d).select("id", T.metric_name(F.col("text")).alias("metric"))


@BOOK.add("txt_18_safe_number", rf"""
with f as ({_FACTS}) select id, try_cast(replace(regexp_extract(text, '([0-9][0-9,.]*[0-9]) (?:thousand|million|percent|USD)', 1), ',', '') as double) as number from f""")
def _(s, d):
    return _facts(s, d).select("id", T.safe_number(F.regexp_extract("text", r"([0-9][0-9,.]*[0-9]) (?:thousand|million|percent|USD)", 1)).cast("double").alias("number"))


_RULES = [(r"(?i)\brevenue\b.*percent", "growth"), (r"(?i)\bcosts?\b", "cost"), (r"(?i)\boutput\b", "capacity")]


@BOOK.add("txt_19_classifier", rf"""
with f as ({_FACTS}) select id, case when regexp_matches(text, '(?i)\brevenue\b.*percent') then 'growth' when regexp_matches(text, '(?i)\bcosts?\b') then 'cost' when regexp_matches(text, '(?i)\boutput\b') then 'capacity' else 'risk' end as kind from f""")
def _(s, d):
    return _facts(s, d).select("id", T.first_rule(F.col("text"), _RULES, F.lit("risk")).alias("kind"))


@BOOK.add("txt_20_ngrams", r"""
select doc_id, count(*)::bigint as n, sha256(string_agg(x, ' ' order by x)) as digest from (
  select distinct doc_id, unnest(regexp_extract_all(lower(text), '([a-z][a-z0-9]+)', 1)) as x from documents) where x not in ('the', 'of', 'and', 'to', 'in', 'is', 'a', 'for') group by doc_id""")
def _(s, d):
    g = T.ngrams(F.col("text"))
    return table(s, d, "documents").select("doc_id", g.alias("g")).filter(F.size("g") > 0).select("doc_id", F.size("g").cast("long").alias("n"), F.sha2(F.array_join(F.array_sort("g"), " "), 256).alias("digest"))


def _url_sql(drop: str, host: str) -> str:
    return rf"""
with u as (select page_id, trim(url) as u from pages),
p as (select page_id, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) as scheme, lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1)) as host,
  regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/+$', '') as path, regexp_extract(u, '^[^?#]*\?([^#]*)', 1) as q from u),
k as (select *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' and not regexp_matches(x, '(?i)^(?:{drop})')), '&') as kept from p)
select page_id, scheme || '://' || {host} || path || case when kept <> '' then '?' || kept else '' end as url_key from k"""


@BOOK.add("txt_21_url_grading", _url_sql("utm_|spm|from", "host"))
def _(s, d):
    return table(s, d, "pages").select("page_id", T.url_for_grading(F.col("url")).alias("url_key"))


@BOOK.add("txt_22_url_collection", _url_sql("utm_|spm|ref", r"regexp_replace(host, '^www\.', '')"))
def _(s, d):
    return table(s, d, "pages").select("page_id", T.url_for_collection(F.col("url")).alias("url_key"))


@BOOK.add("txt_23_host_match", r"""select page_id, (h = 'example.org' or h like '%.example.org') as in_org from (select page_id, lower(regexp_extract(trim(url), '://([^/?#:]+)', 1)) as h from pages)""")
def _(s, d):
    return table(s, d, "pages").select("page_id", T.is_host(T.host_of(F.col("url")), ["example.org"]).alias("in_org"))


@BOOK.add("txt_24_math_to_text", """
select o_orderkey as id, '((' || (o_orderkey % 9) || ') ÷ (b)) ÷ (c) × ' || o_custkey || ' ≤ 5% for $' || o_orderkey || ' and x^2 = √(y_1)' as plain from orders""")
def _(s, d):
    made = F.concat(F.lit(r"$\frac{\frac{"), (F.col("o_orderkey") % 9).cast("string"), F.lit(r"}{\text{b}}}{c} \times "), F.col("o_custkey").cast("string"), F.lit(r" \le 5\%$ for $"), F.col("o_orderkey").cast("string"), F.lit(r" and $x^{2} = \sqrt{y_{1}}$"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), T.plain_math(made).alias("plain"))


@BOOK.add("txt_25_sanitise", r"""
select doc_id, sha256(trim(regexp_replace(replace(t || chr(10) || '((' || doc_id || ') ÷ (n_2)) ÷ (√(b)) costs $' || doc_id || ', not $9.', 'idiot', '[removed]'), '\n{3,}', chr(10) || chr(10), 'g'))) as digest
from (select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_matches(x, '(?i)licen[sc]e')), chr(10)) as t from documents)""")
def _(s, d):
    # Documents hold no formula; each gets one, and two prices.
    i = F.col("doc_id").cast("string")
    made = F.concat(F.col("text"), F.lit("\n" + r"\[ \frac{\frac{\text{"), i, F.lit(r"}}{n_{2}}}{\sqrt{b}} \] costs $"), i, F.lit(", not $9."))
    return table(s, d, "documents").select("doc_id", F.sha2(T.sanitised(made, [r"(?i)licen[sc]e"], {"idiot": "[removed]"}), 256).alias("digest"))


@BOOK.add("txt_26_citations", """
select id, string_agg(c, ',' order by c) as cited from (select distinct o_orderkey as id, unnest(list_concat([o_custkey % 5 + 1], range(o_orderkey % 7 + 1, o_orderkey % 7 + 4))) as c from orders) group by id""")
def _(s, d):
    k, c = F.col("o_orderkey") % 7, F.col("o_custkey") % 5
    text = F.concat(F.lit("As shown ["), (c + 1).cast("string"), F.lit("] and ["), (k + 1).cast("string"), F.lit("-"), (k + 3).cast("string"), F.lit("], but not [1-99]."))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(T.citations(text), ",").alias("cited"))


@BOOK.add("txt_27_heading", r"""
select doc_id, lower(regexp_replace(regexp_replace('## ' || (doc_id % 12) || '.1 ' || split_part(text, chr(10), 1), '^\s*#*\s*(?:[0-9]+(?:\.[0-9]+)*[.)、]?)?\s*', ''), '\s+', '', 'g')) as heading from documents""")
def _(s, d):
    line = F.concat(F.lit("## "), (F.col("doc_id") % 12).cast("string"), F.lit(".1 "), F.split_part("text", F.lit("\n"), F.lit(1)))
    return table(s, d, "documents").select("doc_id", T.heading(line).alias("heading"))


@BOOK.add("txt_26_by_chapter", """
select distinct chapter_no::bigint as chapter_no, source::bigint as source from (
  select o_orderkey % 4 as chapter_no, unnest(list_concat([o_custkey], range(o_orderkey, o_orderkey + 1 + o_custkey % 20))) as source from orders where o_orderkey % 4 <> 0
  union all select o_custkey % 12, o_orderkey from orders where o_orderkey % 4 = 0 and o_custkey % 12 between 1 and 10)""")
def _(s, d):
    """Chapters cite a customer and a range of orders, and a span of years that is none; the summary cites chapter and order."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey")
    own = F.concat(F.lit("See ["), c.cast("string"), F.lit("], ["), k, F.lit("-"), (F.col("o_orderkey") + c % 20).cast("string"), F.lit("] of [1000-2025] and [9-1]."))
    summary = F.concat(F.lit("As in ["), (c % 12).cast("string"), F.lit("-"), k, F.lit("] and ["), k, F.lit("]."))
    no = F.col("o_orderkey") % 4
    return T.cited_sources(table(s, d, "orders").select(no.alias("chapter_no"), F.when(no == 0, summary).otherwise(own).alias("content")))


@BOOK.add("txt_27_outer_heading", r"""
select doc_id, sha256(case doc_id % 4 when 0 then chr(10) || text when 1 then text when 2 then '## Other words' || chr(10) || text else 'A line' || chr(10) || '# ' || source || chr(10) || text end) as digest from documents""")
def _(s, d):
    """Documents under a heading that repeats their source, that counts a chapter, another one, and one below a line of text."""
    n = F.col("doc_id") % 4
    head = F.when(n == 0, F.concat(F.lit("\n# 第一章 "), "source", F.lit(" ##\n"))).when(n == 1, F.lit("### 3章: more\n")).when(n == 2, F.lit("## Other words\n")).otherwise(F.concat(F.lit("A line\n# "), "source", F.lit("\n")))
    return table(s, d, "documents").select("doc_id", F.sha2(T.without_outer_heading(F.concat(head, "text"), F.concat(F.lit("一、"), "source")), 256).alias("digest"))


@BOOK.add("txt_28_redaction", r"""
select doc_id, sha256(regexp_replace(regexp_replace(text, '(?i)((?:api[_-]?key|token|secret|password|passwd)["'']?\s*[:=]\s*["'']?)[A-Za-z0-9._~+/=-]+', '\1***', 'g'), '\b[0-9a-f]{40}\b', '***', 'g')) as digest,
       regexp_matches(text, '(?i)(?:api[_-]?key|token|secret|password|passwd)["'']?\s*[:=]') as had from documents""")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(T.redacted(F.col("text")), 256).alias("digest"), F.col("text").rlike(r"""(?i)(?:api[_-]?key|token|secret|password|passwd)["']?\s*[:=]""").alias("had"))


QUERIES, ORACLE = BOOK.queries, BOOK.sql
