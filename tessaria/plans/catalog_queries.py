"""Queries for ingest, catalogue, upserts and text quality (SRC, CAT, MRG, QLT), over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as K
from ..operators import quality as Q
from ..operators import retrieval as R
from .base import Book, derived, table
from .evidence_queries import EV, _EV
from .text_queries import _url_sql

BOOK = Book()
_KEY_GRADING, _KEY_COLLECTION = _url_sql("utm_|spm|from", "host"), _url_sql("utm_|spm|ref", r"regexp_replace(host, '^www\.', '')")
_LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as pos from documents)"


def _docs(s, d):
    return table(s, d, "documents")


@BOOK.add("src_1_corpus_scan", "select source, count(*)::bigint as files, sum(strlen(text))::bigint as bytes from documents where source not like 'src9%' group by source")
def _(s, d):
    # The corpus is a table here; corpus_scan reads folders of files with the same rule on names.
    return _docs(s, d).filter(~F.col("source").rlike("^src9")).groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


@BOOK.add("src_2_incremental_scan", "select left(sha256(doc_id::varchar), 20) as id, sha256(text) as fingerprint from documents where doc_id % 3 = 0")
def _(s, d):
    now = K.with_ids(_docs(s, d).select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"), "doc_id"))
    state = now.select("id", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit(1).alias("version"))
    return K.changed_files(now, state, 1).select("id", "fingerprint")


@BOOK.add("src_6_quarantine", "select case when n_chars < 100 then 'too_short' when lang = 'es' then 'language' else 'good' end as outcome, count(*)::bigint as n from documents group by 1")
def _(s, d):
    good, bad = K.quarantine(_docs(s, d), {"too_short": F.col("n_chars") < 100, "language": F.col("lang") == "es"})
    return good.select(F.lit("good").alias("outcome")).unionByName(bad.select(F.col("error").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


#: Documents as blocks in which every fifth line is a heading.
def _typed(s, d):
    b = R.blocks(_docs(s, d)).select("doc_id", "ordinal", F.when(F.col("ordinal") % 5 == 0, F.concat(F.lit("# "), "text")).otherwise(F.col("text")).alias("text"))
    return K.typed_blocks(b, [(r"(?i)\bthe\b", "first"), (r"(?i)\bde\b", "second")], [(r"(?i)\bof\b", "issue"), (r"(?i)\band\b", "advice")])


_TB = r"""b as (select doc_id, pos, case when pos % 5 = 0 then '# ' else '' end || case when line like '% | %' then array_to_string(list_transform(list_filter(range(1, len(c) + 1), lambda i: list_position(c, c[i]) = i), lambda i: c[i]), ' | ') else trim(line) end as text
  from (select *, list_transform(string_split(line, '|'), lambda x: trim(x)) as c from l) where trim(line) <> ''),
h as (select *, case when text like '#%' then 'heading' when text like '% | %' then 'table_row' else 'paragraph' end as kind, case when text like '#%' then case when regexp_matches(text, '(?i)\bthe\b') then 'first' when regexp_matches(text, '(?i)\bde\b') then 'second' end end as m,
 case when text like '#%' then case when regexp_matches(text, '(?i)\bof\b') then 'issue' when regexp_matches(text, '(?i)\band\b') then 'advice' end end as x from b),
t as (select doc_id, pos, kind, last_value(m ignore nulls) over w as module, last_value(x ignore nulls) over w as section from h window w as (partition by doc_id order by pos rows unbounded preceding))"""


@BOOK.add("src_7_block_typing", f"with {_LINES}, {_TB} select kind, module, section, count(*)::bigint as n from t group by all")
def _(s, d):
    return _typed(s, d).groupBy("kind", "module", "section").agg(F.count("*").alias("n"))


@BOOK.add("src_8_table_capture", f"with {_LINES}, c as (select doc_id, pos as ordinal, unnest(string_split(line, ' | ')) as x from l where line like '% | %') select doc_id, count(distinct ordinal)::bigint as table_rows, count(*)::bigint as cells from c group by doc_id")
def _(s, d):
    b = _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    return K.table_capture(b).groupBy("doc_id").agg(F.countDistinct("ordinal").alias("table_rows"), F.count("*").alias("cells"))


@BOOK.add("src_8_table_cells", """with r as (select doc_id, unnest(range(0, 2 + doc_id % 3)) as i from documents)
select doc_id, (t + 1)::int as "table", (i + 1)::int as row, c::int as col, case when c < 2 then 'h' || t || c end as header, case when i = 0 then 'h' || t || c else 'same' || (doc_id % 7) end as text
from (select r.*, unnest([0, 1]) as t from r), (select unnest([0, 1, 2]) as c) where c < 2 or i = 2""")
def _(s, d):
    """Each document ends in two tables with a line between; their third row has a cell more than the header."""
    i, own = F.col("doc_id"), F.concat(F.lit("same"), (F.col("doc_id") % 7).cast("string"))
    rows = lambda t: F.transform(F.sequence(F.lit(0), (i % 3 + 1).cast("int")), lambda x: F.when(x == 0, f"h{t}0 | h{t}1").when(x == 2, F.concat_ws(" | ", own, own, own)).otherwise(F.concat_ws(" | ", own, own)))
    lines = F.concat(F.transform(F.split("text", "\n"), lambda x: F.replace(x, F.lit(" | "), F.lit(" "))), rows(0), F.array(F.lit("between")), rows(1))
    return K.table_cells(_docs(s, d).select("doc_id", F.posexplode(lines).alias("ordinal", "text"))).drop("ordinal")


_LOOKS = r"[A-Z][a-z]*(?:tion|ment|heit)"


@BOOK.add("src_9_entity", rf"""with {_LINES}, e as (select doc_id, arg_min(regexp_extract(trim(line), '{_LOOKS}'), pos) as e from l where trim(line) <> '' and pos < 35 and regexp_matches(trim(line), '{_LOOKS}') group by doc_id)
select d.doc_id, coalesce(e, nullif(trim(regexp_replace(source, '[_\-0-9]+', ' ', 'g')), ''), 'needs review') as entity from documents d left join e using (doc_id)""")
def _(s, d):
    return K.entity(R.blocks(_docs(s, d)), _docs(s, d).withColumn("name", F.col("source")), _LOOKS)


@BOOK.add("src_10_suggestion", rf"""with {_LINES}, e as (select doc_id, arg_min(regexp_extract(trim(line), '{_LOOKS}'), pos) as e from l where trim(line) <> '' and pos < 35 and regexp_matches(trim(line), '{_LOOKS}') group by doc_id)
select d.doc_id, coalesce(e, case when doc_id % 2 = 0 then source end) as suggested, case when e is not null and doc_id % 2 = 0 then 'conflict' when e is not null then 'cover' when doc_id % 2 = 0 then 'file' else 'none' end as reason from documents d left join e using (doc_id)""")
def _(s, d):
    docs = _docs(s, d).withColumn("name", F.when(F.col("doc_id") % 2 == 0, F.concat("source", F.lit(".pdf"))).otherwise(F.lit("scan.pdf")))
    return K.suggestions(docs, R.blocks(_docs(s, d)), _LOOKS, r"(?i)^scan$").select("doc_id", "suggested", "reason")


@BOOK.add("src_11_score_conflict", "select p_partkey as doc_id, p_brand as module, p_size as table_value from part where p_partkey % 3 = 0")
def _(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("module"), F.col("p_size").alias("value"))
    return K.score_conflicts(p, p.withColumn("value", F.when(F.col("doc_id") % 3 == 0, F.col("value") + 1).otherwise(F.col("value")))).select("doc_id", "module", "table_value")


@BOOK.add("src_12_report_quality", f"with {_LINES}, {_TB}, q as (select doc_id, (not coalesce(bool_or(module = 'first'), false))::int + (not coalesce(bool_or(module = 'second'), false))::int as missing from t group by doc_id) select doc_id, missing, case when missing > 0 or doc_id % 4 = 0 then 'needs_review' else 'ready' end as status from q")
def _(s, d):
    c = _docs(s, d).filter("doc_id % 4 = 0").select("doc_id")
    return K.report_quality(_typed(s, d), ["first", "second"], c).select("doc_id", F.size("missing").alias("missing"), "status")


@BOOK.add("src_13_relations", "with p as (select o_custkey as doc_id, o_orderstatus as module, o_orderkey as ordinal, case when o_orderkey % 2 = 0 then 'issue' else 'advice' end as section from orders) select left(sha256(a.doc_id || '|' || a.module || '|' || a.ordinal || '|' || b.ordinal), 24) as id from p a join p b using (doc_id, module) where a.section = 'issue' and b.section = 'advice'")
def _(s, d):
    p = table(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("module"), F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderkey") % 2 == 0, "issue").otherwise("advice").alias("section"))
    return K.candidate_relations(p).select("id")


@BOOK.add("src_14_recent_rows", "select event_type, least(20, count(*))::int as shown, count(*)::bigint as total from events group by event_type")
def _(s, d):
    return K.recent_rows(table(s, d, "events").select("event_type", "event_id", "user_id", "value"), ["event_type"], "event_id").select("event_type", "shown", "total")


@BOOK.add("src_15_normalised_results", f"with e as ({_EV}) select id, coalesce(case when id % 3 = 0 then null else nullif(trim(excerpt), '') end, 'h' || id) as excerpt, coalesce(nullif(trim(publisher), ''), lower(regexp_extract(trim(url), '://([^/?#:]+)', 1))) as publisher, case when id % 2 = 0 then 0.9 else score end::double as score from e")
def _(s, d):
    e = derived(s, d, EV, "pages", "documents")
    r = e.select("id", "url", "title", "publisher", "score", F.when(F.col("id") % 3 != 0, F.col("excerpt")).alias("summary"), F.array(F.concat(F.lit("h"), F.col("id").cast("string"))).alias("highlights"), F.lit(None).cast("string").alias("text"), F.when(F.col("id") % 2 == 0, F.array(F.lit(0.2), F.lit(0.9))).alias("highlight_scores"))
    return K.normalised_results(r).select("id", "excerpt", "publisher", "score")


@BOOK.add("src_16_idempotent_collect", rf"""with p as (select page_id as id, page_id % 5 as project_id, 1 as chapter_no, url_key from ({_KEY_COLLECTION})),
o as (select distinct project_id, chapter_no, url_key from p where id % 7 = 0), n as (select * from p anti join o using (project_id, chapter_no, url_key)) select min(id) as id from n group by project_id, chapter_no, url_key""")
def _(s, d):
    p = table(s, d, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 5).alias("project_id"), F.lit(1).alias("chapter_no"), "url", F.lit(1).alias("rank"))
    return K.collect_new(p, p.filter("id % 7 = 0")).select("id")


@BOOK.add("src_17_outcome_counters", "select o_custkey % 100 as project_id, count(*)::bigint as run, count(*) filter (o_orderstatus = 'F')::bigint as succeeded, count(*) filter (o_orderstatus = 'O')::bigint as failed, sum(o_orderkey % 9)::bigint as found, (count(*) filter (o_orderstatus = 'O') > 0 and count(*) filter (o_orderstatus = 'F') > 0) as partial from orders group by 1")
def _(s, d):
    r = table(s, d, "orders").select((F.col("o_custkey") % 100).alias("project_id"), F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "O", "failed").otherwise("skipped").alias("status"), (F.col("o_orderkey") % 9).alias("found"), F.lit(0).alias("saved"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority")).alias("error"))
    return K.outcome_counters(r, ["project_id"]).select("project_id", "run", "succeeded", "failed", "found", "partial")


@BOOK.add("src_18_precedence", "select o_custkey as k, arg_min(o_orderkey, (case o_orderstatus when 'P' then 0 when 'F' then 1 else 2 end) * 1000000000 + o_orderkey) as id from orders group by 1")
def _(s, d):
    r = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("provider"))
    return K.by_precedence(r, ["k"], {"P": 0, "F": 1, "O": 2}).select("k", "id")


@BOOK.add("src_18_query_budget", "select o_custkey as project_id, o_orderkey % 5 as chapter_no, case when o_orderkey % 5 = 3 and max(o_orderkey) % 2 = 0 then 3 else 4 end::int as budget from orders group by 1, 2")
def _(s, d):
    """Chapters of customers; structured rows were saved where the last order's key is even."""
    ch = table(s, d, "orders").groupBy(F.col("o_custkey").alias("project_id"), (F.col("o_orderkey") % 5).alias("chapter_no")).agg(F.max("o_orderkey").alias("last"))
    return K.query_budget(ch, ch.filter("last % 2 = 0"), 4)


@BOOK.add("src_19_requirements", "select c_custkey as project_id, c_custkey % 4 as chapter_no, 'd' || (c_custkey % 4) as dataset from customer where c_custkey % 4 in (1, 2) and (c_custkey % 4 = 1 or c_nationkey = 3)")
def _(s, d):
    ch = table(s, d, "customer").select(F.col("c_custkey").alias("project_id"), (F.col("c_custkey") % 4).alias("chapter_no"), F.col("c_nationkey").cast("string").alias("geography"))
    return K.requirements(ch, s.createDataFrame([(1, None, "d1"), (2, "3", "d2")], "chapter_no long, geography string, dataset string"))


@BOOK.add("src_20_shortage", f"with e as ({_EV}), c as (select n_nationkey % 5 as project_id, (n_nationkey // 5) * 3 + 1 as chapter_no, n_regionkey = 1 as complete from nation), n as (select c.*, (select count(*) from e where e.project_id = c.project_id and e.chapter_no = c.chapter_no and trim(excerpt) <> '')::bigint as n from c) select project_id, chapter_no, greatest(0, 8 - n)::bigint as short, complete and n = 0 as unfounded from n")
def _(s, d):
    ch = table(s, d, "nation").select((F.col("n_nationkey") % 5).alias("project_id"), (F.floor(F.col("n_nationkey") / 5).cast("int") * 3 + 1).alias("chapter_no"), (F.col("n_regionkey") == 1).alias("complete"))
    return K.shortage(ch, derived(s, d, EV, "pages", "documents").filter(F.trim("excerpt") != ""), 8).select("project_id", "chapter_no", "short", "unfounded")


@BOOK.add("src_21_ttl_cache", """select sha256('["' || event_type || '","d","' || user_id || '"]') as cache_key from events where ts + interval 7 day > (select max(ts) from events) - interval 3 day""")
def _(s, d):
    e = table(s, d, "events")
    top = e.agg(F.max("ts").alias("t")).first()["t"]
    c = e.select(K.cache_key(F.col("event_type"), F.lit("d"), F.col("user_id").cast("string")).alias("cache_key"), (F.col("ts") + F.expr("interval 7 days")).alias("expires"))
    return K.live_cache(c, F.lit(top) - F.expr("interval 3 days")).select("cache_key")


@BOOK.add("src_21_cache_writes", """with a as (select event_type as provider, user_id, max(ts) as asked, arg_max(event_id, (ts, lpad(event_id::varchar, 20, '0'))) as answer from events where event_id % 2 = 1 group by 1, 2),
o as (select event_type as provider, user_id from events where event_id % 2 = 0 group by 1, 2), n as (select provider, sha256('["' || provider || '","d","' || user_id || '"]') as cache_key, answer::varchar as answer, case provider when 'click' then 30 else 7 end as days from a)
select cache_key, answer, days::int as days from n union all select sha256('["' || provider || '","d","' || user_id || '"]'), 'old', 1 from o anti join a using (provider, user_id)""")
def _(s, d):
    """Events ask: even ones are in the cache, odd ones are put, the last of a key wins; days are how long an entry lives from now."""
    now, old = F.lit("2025-01-01 00:00:00").cast("timestamp"), F.col("event_id") % 2 == 0
    e = table(s, d, "events").select(F.col("event_type").alias("provider"), F.lit("d").alias("dataset"), F.col("user_id").cast("string").alias("params"), F.lpad(F.col("event_id").cast("string"), 20, "0").alias("answer"), F.col("ts").alias("asked"), "event_id")
    cache = e.filter(old).select(K.cache_key(F.col("provider"), F.col("dataset"), F.col("params")).alias("cache_key"), "provider", F.lit("old").alias("answer"), (now - F.expr("interval 6 days")).alias("stored"), (now + F.expr("interval 1 day")).alias("expires")).distinct()
    out = K.put_cache(cache, e.filter(~old), now, {"click": "30 days"})
    return out.select("cache_key", F.regexp_replace("answer", "^0+(?=.)", "").alias("answer"), F.datediff("expires", now).alias("days"))


@BOOK.add("src_22_insert_absent", "select count(*)::bigint as n, sum(v)::bigint as total from (select o_orderkey as k, 0 as v from orders where o_orderkey % 2 = 0 union all select o_orderkey, 1 from orders where o_orderkey % 2 = 1 and o_orderkey % 3 = 0)")
def _(s, d):
    o = table(s, d, "orders")
    return K.insert_absent(o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("v")), o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.lit(0).alias("v")), ["k"]).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@BOOK.add("src_23_copy_verification", "select count(*)::bigint as n, count(*)::bigint as n_copy, true as equal from lineitem union all select count(*)::bigint, count(*)::bigint, false from lineitem")
def _(s, d):
    l = table(s, d, "lineitem")
    return K.verify_copy(l, l.repartition("l_partkey")).unionByName(K.verify_copy(l, l.withColumn("l_tax", F.col("l_tax") + 0.01)))


@BOOK.add("src_24_plan_table", "select c_custkey as project_id, 1::int as chapter_no, 'size of ' || c_name || case when c_mktsegment = 'BUILDING' then ';land for ' || c_name else '' end as queries from customer")
def _(s, d):
    b = table(s, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("topic"), F.col("c_mktsegment").alias("focus"))
    rules = s.createDataFrame([(1, 1, "size of {topic}", None), (1, 2, "land for {topic}", "BUILDING"), (1, 3, "size of {topic}", "BUILDING")], "chapter_no int, position int, template string, only_if string")
    return K.plan_rows(b, rules).select("project_id", "chapter_no", F.array_join("queries", ";").alias("queries"))


_OLD = "select o_orderkey as k, 'o' as value, o_orderkey % 2 = 0 as managed, o_orderkey % 3 = 0 as verified from {orders}"


@BOOK.add("mrg_1_guarded_upsert", """with o as (select o_orderkey as k, o_orderkey % 2 = 0 and o_orderkey % 3 <> 0 as free, o_orderkey % 5 > 0 as again from orders)
select case when again and free then 'updated' when again then 'skipped' when free then 'deleted' else 'kept' end as action, count(*)::bigint as n from o group by 1 union all select 'created', count(*)::bigint from orders where o_orderkey % 100 = 1""")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("o").alias("value"), (F.col("o_orderkey") % 2 == 0).alias("managed"), (F.col("o_orderkey") % 3 == 0).alias("verified"))
    n = o.filter("k % 5 > 0").select("k", F.lit("n").alias("value")).unionByName(o.filter("k % 100 = 1").select((-F.col("k")).alias("k"), F.lit("n").alias("value")))
    return K.guarded_upsert(o, n, "k").groupBy("action").agg(F.count("*").alias("n"))


@BOOK.add("mrg_2_batch_append", "select count(*)::bigint as n, count(distinct c_custkey)::bigint as keys from customer")
def _(s, d):
    c = table(s, d, "customer").select("c_custkey", "c_name")
    return K.insert_absent(c.unionByName(c), c.filter("c_custkey % 2 = 0"), ["c_custkey"]).agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("keys"))


def _blocks(s, d):
    return _docs(s, d).select(F.col("doc_id").alias("block_id"), "doc_id", "text", F.col("lang").alias("module"))


def _edits(s, d):
    return table(s, d, "labels").select(F.col("doc_id").alias("block_id"), F.when(F.col("quality") == 0, F.concat(F.lit("e"), F.col("doc_id").cast("string"))).alias("text"), F.lit(None).cast("string").alias("module"), (F.col("toxic") == 1).alias("deleted"))


@BOOK.add("cat_1_effective_blocks", "select d.doc_id as block_id, sha256(coalesce(case when quality = 0 then 'e' || d.doc_id end, text)) as text, lang as module, l.doc_id is not null as edited from documents d left join labels l using (doc_id) where toxic is distinct from 1")
def _(s, d):
    return K.effective_blocks(_blocks(s, d), _edits(s, d)).select("block_id", F.sha2("text", 256).alias("text"), "module", "edited")


@BOOK.add("cat_2_apply_changes", "select doc_id as block_id, case when doc_id % 3 = 0 then 'new' when quality = 0 then 'e' || doc_id end as text, case when doc_id % 3 = 0 then false when doc_id % 3 = 1 then true else toxic = 1 end as deleted from labels")
def _(s, d):
    c = _edits(s, d).filter("block_id % 3 < 2").select("block_id", F.lit(1).alias("seq"), F.lit("trash").alias("action"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("module"))
    more = c.filter("block_id % 3 = 0").select("block_id", F.lit(2).alias("seq"), F.lit("edit").alias("action"), F.lit("new").alias("text"), "module")
    return K.apply_changes(_edits(s, d), c.unionByName(more)).select("block_id", "text", "deleted")


@BOOK.add("cat_2_refused", "select doc_id as block_id, 1 as seq, case when quality = 0 and toxic is distinct from 1 then 'image_text' else 'no_block' end as reason from labels where toxic = 1 or quality = 0 and doc_id % 3 <> 0")
def _(s, d):
    """Labels as blocks: toxic ones are gone, those of low quality are images; every third change is to the trash."""
    lab = table(s, d, "labels")
    changes = lab.select(F.col("doc_id").alias("block_id"), F.lit(1).alias("seq"), F.when(F.col("doc_id") % 3 == 0, "trash").otherwise("edit").alias("action"), F.lit("new").alias("text"), F.lit(None).cast("string").alias("module"))
    blocks = lab.filter("toxic is distinct from 1").select(F.col("doc_id").alias("block_id"), F.when(F.col("quality") == 0, "image").alias("kind"))
    return K.refused_changes(changes, blocks).select("block_id", "seq", "reason")


@BOOK.add("cat_2_new_ordinals", "select o_custkey as doc_id, o_orderkey as seq, (coalesce((select count(*) from customer where c_custkey = o_custkey and c_nationkey % 2 = 0), 0) + row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as ordinal from orders")
def _(s, d):
    """Orders as rows added to customers, every other nation's of which have a block already."""
    old = table(s, d, "customer").filter("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("ordinal"))
    return K.new_ordinals(table(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.lit("x").alias("text")), old).select("doc_id", "seq", "ordinal")


@BOOK.add("cat_3_catalogue", "select d.doc_id, coalesce(case when quality = 1 then 'T' || d.doc_id end, source) as title, coalesce(n_name, 'unknown') as company from documents d left join labels l using (doc_id) left join nation on n_nationkey = d.doc_id % 40 where toxic is distinct from 1")
def _(s, d):
    lab = table(s, d, "labels")
    r = _docs(s, d).select("doc_id", F.col("source").alias("name"), (F.col("doc_id") % 40).cast("int").alias("company_id"))
    titles = lab.select("doc_id", F.when(F.col("quality") == 1, F.concat(F.lit("T"), F.col("doc_id").cast("string"))).alias("title"), F.lit(None).cast("string").alias("label"))
    return K.catalogue(r, titles, lab.select("doc_id", (F.col("toxic") == 1).alias("deleted")), table(s, d, "nation").select(F.col("n_nationkey").alias("company_id"), F.col("n_name").alias("company_name")))


@BOOK.add("cat_4_preprocessing_status", "select c_custkey as doc_id, coalesce(n, 0)::bigint as blocks, coalesce(p, 0)::bigint as pending from customer left join (select o_custkey, count(*) as n, nullif(count(*) filter (o_orderstatus = 'P'), 0) as p from orders group by 1) on o_custkey = c_custkey")
def _(s, d):
    o = table(s, d, "orders")
    return K.preprocessing_status(table(s, d, "customer").select(F.col("c_custkey").alias("doc_id")), o.select(F.col("o_custkey").alias("doc_id")), o.select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("done").alias("status")))


@BOOK.add("cat_5_corpus_status", "select count(*)::bigint as documents, sum(n_chars)::bigint as chars from documents where doc_id not in (select doc_id from labels where toxic = 1)")
def _(s, d):
    from ..operators.evidence import live

    return live(_docs(s, d), table(s, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("deleted"))).agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


@BOOK.add("cat_6_audit_log", "select l.doc_id as target_id, case when toxic = 1 then 'trash' else 'edit' end as action, lang from labels l join documents using (doc_id)")
def _(s, d):
    ch = table(s, d, "labels").select(F.col("doc_id").alias("block_id"), F.lit(1).alias("seq"), F.when(F.col("toxic") == 1, "trash").otherwise("edit").alias("action"))
    return K.audit_log(_blocks(s, d), ch).select("target_id", "action", F.get_json_object("before_value", "$.module").alias("lang"))


@BOOK.add("cat_9_versions", "select o_custkey as project_id, o_orderkey as version_id, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc)::int as place from orders")
def _(s, d):
    return K.versions(table(s, d, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").alias("created"))).select("project_id", "version_id", "place")


@BOOK.add("cat_10_remap", "select page_id as id, case page_id % 10 + 1 when 1 then 4 when 2 then 4 else page_id % 10 + 1 end::bigint as chapter_no from pages")
def _(s, d):
    ev = table(s, d, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 10 + 1).alias("chapter_no"))
    return K.remap(ev, s.createDataFrame([(1, 4), (2, 4)], "old_no long, new_no long")).select("id", "chapter_no")


@BOOK.add("cat_11_reusable_plan", "select c_mktsegment as brief, max(c_custkey) as project_id from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_orderkey % 3 = 0) and c_custkey % 3 > 0 and c_custkey % 7 > 0 group by 1")
def _(s, d):
    c = table(s, d, "customer")
    p = c.select(F.col("c_custkey").alias("project_id"), F.col("c_mktsegment").alias("brief"), F.when(F.col("c_custkey") % 3 > 0, "planned").otherwise("running").alias("status"), F.col("c_custkey").alias("created"))
    return K.reusable_plan(p, table(s, d, "orders").filter("o_orderstatus = 'P' and o_orderkey % 3 = 0").select(F.col("o_custkey").alias("project_id")), c.filter("c_custkey % 7 = 0").select(F.col("c_custkey").alias("project_id")))


@BOOK.add("cat_12_progress", "select o_custkey as project_id, case when count(*) filter (o_orderstatus = 'F') >= 11 then 100 else least(99, count(*) filter (o_orderstatus = 'F') * 9) end::int as progress from orders group by 1")
def _(s, d):
    return K.progress(table(s, d, "orders").select(F.col("o_custkey").alias("project_id"), (F.col("o_orderstatus") == "F").alias("complete")))


@BOOK.add("qlt_1_chapter_rules", r"""select doc_id, concat_ws(',', case when length(rtrim(text)) > 0 and not regexp_matches(rtrim(text), '[.!?:;)\]|"''”»。！？；：）%*]$') then 'unfinished' end, case when regexp_matches(rtrim(text), '\n\s*(?:[-*+]|[0-9]+[.)])\s*$') then 'cut_list' end, case when regexp_matches(text, '(?i)\b(?:todo|tbd|lorem ipsum|undefined|nan)\b') then 'stray_token' end, case when regexp_matches(text, '\\(?:frac|text|times|mathrm)\b|\$\$') then 'raw_formula' end) as issues from documents""")
def _(s, d):
    return _docs(s, d).select("doc_id", F.array_join(Q.chapter_rules(F.col("text")), ",").alias("issues"))


@BOOK.add("qlt_1_series_rules", "select o_custkey as report, o_orderkey as chapter, false as year_table, o_orderkey % 7 = 0 as mixed_scopes from orders where o_orderkey not in (1, 2) union all select o_custkey, o_orderkey, o_custkey % 3 > 0, false from orders where o_orderkey in (1, 2)")
def _(s, d):
    """Orders as chapters: two to four years of one market, with and without its country, of another in every seventh, below a heading on market growth and above one on other things."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(F.lit("# 概况\n- 2019年甲市场规模1亿\n### 市场规模与增长\n- 2021年中国设备市场规模1亿\n- 2022年："), F.when(k % 7 == 0, "零件").otherwise("设备"), F.lit("市场规模2亿\n"), F.repeat(F.lit("* 2023年：3亿\n"), (c % 3).cast("int")), F.lit("文字2024年\n## 其他\n- 2020年乙市场：4亿"))
    return Q.series_rules(table(s, d, "orders").select(c.alias("report"), k.alias("chapter"), text.alias("text")))


@BOOK.add("qlt_2_content_rules", "select doc_id, concat_ws(',', case when regexp_matches(text, '(?i)^\\s*(?:as an assistant|here is the|sure,)') then 'echo' end, case when length(trim(text)) < 80 then 'too_short' end, case when regexp_matches(text, '[a-z]\\?[a-z]') then 'spliced_question' end) as issues from documents")
def _(s, d):
    return _docs(s, d).select("doc_id", F.array_join(Q.content_rules(F.col("text")), ",").alias("issues"))


@BOOK.add("qlt_3_decision_rules", r"""select doc_id, concat_ws(',', case when not contains(lower(text), 'the') then 'missing_token' end, case when regexp_matches(text, '(?i)\b(?:go|no-go|approve|reject)\b') and not regexp_matches(text, '[0-9]') then 'no_bands' end,
 case when regexp_matches(text, '(?i)\b(?:go|no-go|approve|reject)\b') and doc_id % 2 = 1 then 'not_ready' end, case when contains(lower(text), 'idiot') or contains(lower(text), 'trash') then 'scope_drift' end) as issues from documents""")
def _(s, d):
    return _docs(s, d).select("doc_id", F.array_join(Q.decision_rules(F.col("text"), F.col("doc_id") % 2 == 0, ["idiot", "trash"], ["the"]), ",").alias("issues"))


@BOOK.add("qlt_4_topic_coverage", r"select doc_id, concat_ws(',', case when not regexp_matches(text, '(?i)\bthe\b') then 'a' end, case when not regexp_matches(text, '[0-9]') then 'b' end) as missing from documents")
def _(s, d):
    return _docs(s, d).select("doc_id", F.array_join(Q.topic_coverage(F.col("text"), {"a": r"(?i)\bthe\b", "b": "[0-9]"}), ",").alias("missing"))


@BOOK.add("qlt_5_blocking", r"""select doc_id, (length(rtrim(text)) > 0 and not regexp_matches(rtrim(text), '[.!?:;)\]|"''”»。！？；：）%*]$'))::int + (length(trim(text)) < 80)::int + regexp_matches(text, '(?i)\b(?:todo|tbd|lorem ipsum|undefined|nan)\b')::int + (regexp_matches(text, '[a-z]\?[a-z]'))::int + regexp_matches(text, '(?i)^\s*(?:as an assistant|here is the|sure,)')::int + regexp_matches(rtrim(text), '\n\s*(?:[-*+]|[0-9]+[.)])\s*$')::int + regexp_matches(text, '\\(?:frac|text|times|mathrm)\b|\$\$')::int as n from documents""")
def _(s, d):
    c = F.col("text")
    return _docs(s, d).select("doc_id", F.size(Q.blocking(Q.chapter_rules(c), Q.content_rules(c))).alias("n"))


@BOOK.add("qlt_6_conclusion_filter", f"""with {_LINES}, h as (select *, last_value(case when line like '#%' then regexp_matches(line, '(?i)conclusion') end ignore nulls) over (partition by doc_id order by pos rows unbounded preceding) as bad from l),
k as (select *, coalesce(bad, false) or contains(line, 'idiot') as gone from h) select doc_id, bool_or(gone) as cut, sum(case when gone then 0 else length(line) + 1 end)::bigint - 1 + case when bool_or(gone) then 5 else 0 end as chars from k group by doc_id having sum(case when gone then 0 else 1 end) > 0""")
def _(s, d):
    out = Q.without_conclusions(_docs(s, d), "(?i)conclusion", "idiot", "Note")
    return out.filter("text <> 'Note'").select("doc_id", "cut", F.length("text").cast("long").alias("chars"))


@BOOK.add("qlt_6_tables", """select doc_id, true as cut, sha256(case when doc_id % 3 = 0 then '| a | b |' || chr(10) || 'between' || chr(10) || '| Score |' || chr(10) || 'Note' when doc_id % 3 = 1 then text || chr(10) || '| a | b |' || chr(10) || '| 1 | 2 |' || chr(10) || '| Score | 3 |' || chr(10) || 'Note' else 'Note' end) as digest from documents""")
def _(s, d):
    """A table by its header, a table whose third row only looks like one, a single row, and documents of which nothing stays."""
    n = F.col("doc_id") % 3
    made = F.when(n == 0, F.lit("| a | b |\nbetween\n| Score |\n# Conclusion\nx")).when(n == 1, F.concat("text", F.lit("\n| a | b |\n| 1 | 2 |\n| Score | 3 |\n# Conclusion\n| 5 |"))).otherwise("| a |\n| Score |\n| 7 |")
    return Q.without_conclusions(_docs(s, d).select("doc_id", made.alias("text")), "Conclusion", "^never$", "Note", header="Score").select("doc_id", "cut", F.sha2("text", 256).alias("digest"))


@BOOK.add("qlt_7_new_numbers", "select o_orderkey as id, case when o_custkey % 3 = 0 and o_custkey <> o_orderkey then o_custkey::varchar else '' end as fresh from orders")
def _(s, d):
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    source = F.concat(F.lit("There were "), k, F.when(F.col("o_custkey") % 3 == 0, "").otherwise(F.concat(F.lit(" and "), c)))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(Q.new_numbers(F.concat(F.lit("About "), k, F.lit(" or "), c), source), ",").alias("fresh"))


@BOOK.add("qlt_8_reference_separation", rf"""with p as (select page_id % 10 as chapter_no, page_id as number, url_key from ({_KEY_GRADING})), o as (select distinct url_key, chapter_no || '-' || number as ref from p),
c as (select url_key, count(*)::bigint as mentions from p group by url_key), n as (select url_key, count(*)::bigint as cited from o group by url_key)
select o.url_key, o.ref, n.cited, c.mentions from o join n on n.url_key is not distinct from o.url_key join c on c.url_key is not distinct from o.url_key""")
def _(s, d):
    return Q.merge_sources(table(s, d, "pages").select((F.col("page_id") % 10).alias("chapter_no"), F.col("page_id").alias("number"), "url"))


@BOOK.add("qlt_8_reference_sections", """select doc_id, sha256(text || chr(10) || '# Appendix' || chr(10) || 'end') as body, '[' || doc_id || '] source' as line from documents""")
def _(s, d):
    """Each document with a list of sources, and an appendix after it."""
    i = F.col("doc_id").cast("string")
    made = table(s, d, "documents").select("doc_id", F.concat(F.col("text"), F.lit("\n## Sources\n\n["), i, F.lit("] source\n# Appendix\nend")).alias("text"))
    body, lines = Q.references(made)
    return body.select("doc_id", F.sha2("text", 256).alias("body")).join(lines.select("doc_id", "line"), "doc_id")


@BOOK.add("qlt_9_outline", f"""with recursive {_LINES}, b as (select doc_id, pos, length(line) as n, sum((line like '#%')::int) over (partition by doc_id order by pos rows unbounded preceding) as head from l where trim(line) <> ''),
o as (select *, row_number() over (partition by doc_id, head order by pos) as k from b), r as (select doc_id, head, k, n, n as used, 0 as g from o where k = 1 union all select o.doc_id, o.head, o.k, o.n, case when r.used > 0 and r.used + o.n > 400 then o.n else r.used + o.n end, case when r.used > 0 and r.used + o.n > 400 then r.g + 1 else r.g end from r join o on o.doc_id = r.doc_id and o.head = r.head and o.k = r.k + 1)
select doc_id, g as block, count(*)::bigint as lines, sum(n)::bigint as chars from r group by doc_id, head, g""")
def _(s, d):
    return Q.outline(_docs(s, d)).select("doc_id", "block", "lines", "chars")


QUERIES, ORACLE = BOOK.queries, BOOK.sql
