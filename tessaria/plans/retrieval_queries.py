"""Queries for chunking, packing and retrieval (SRC-3..5, RET, PACK, TXT-10), over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from .base import Book, derived, table

BOOK = Book()

_BLOCKS = r"""b0 as (select doc_id, string_split(text, chr(10)) as l from documents),
b1 as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as ordinal from b0),
b as (select doc_id, ordinal::int as ordinal, line like '% | %' as is_row, case when line like '% | %' then null else trim(line) end as text, line from b1 where trim(line) <> '')"""


@BOOK.add("src_3_block_explode", "with " + _BLOCKS + " select doc_id, ordinal, case when is_row then 'row ' else 'paragraph ' end || (ordinal + 1) as locator, case when is_row then -1 else length(text) end::int as chars from b")
def _(s, d):
    b = R.blocks(table(s, d, "documents"))
    return b.select("doc_id", "ordinal", "locator", F.when(F.startswith("locator", F.lit("row")), F.lit(-1)).otherwise(F.length("text")).alias("chars"))


def _chunks(s, d):
    return R.chunks(R.blocks(table(s, d, "documents")))


@BOOK.add("src_4_greedy_chunking", r"""
with recursive b0 as (select doc_id, string_split(text, chr(10)) as l from documents), b1 as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as o from b0),
b2 as (select doc_id, o, case when line like '% | %' then array_to_string(list_transform(list_sort(list_distinct(list_transform(string_split(line, '|'), lambda x: trim(x)))), lambda x: x), ' | ') else trim(line) end as t from b1 where trim(line) <> ''),
b3 as (select doc_id, o, unnest(range(0, greatest(1, length(t)), 850)) as i, t from b2),
p as (select doc_id, length(substring(t, i + 1, 1000)) as n, row_number() over (partition by doc_id order by o, i) as k from b3),
r as (select doc_id, k, n as used, 0 as g, n from p where k = 1 union all
      select p.doc_id, p.k, case when r.used > 0 and r.used + p.n > 1200 then p.n else r.used + p.n end, case when r.used > 0 and r.used + p.n > 1200 then r.g + 1 else r.g end, p.n from r join p on p.doc_id = r.doc_id and p.k = r.k + 1)
select doc_id, g as chunk, (sum(n) + count(*) - 1)::bigint as chars from r group by doc_id, g""")
def _(s, d):
    return _chunks(s, d).select("doc_id", "chunk", F.length("text").cast("long").alias("chars"))


_TOK = r"regexp_extract_all(lower({}), '([\p{{L}}\p{{N}}_]{{2,}})', 1)"


@BOOK.add("src_5_tokenise", f"select doc_id, len({_TOK.format('text')})::int as n_tokens, len(list_distinct({_TOK.format('text')}))::int as n_distinct from documents")
def _(s, d):
    t = R.tokens(F.col("text"))
    return table(s, d, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@BOOK.add("txt_10_boundary_chunker", r"""
with recursive s0 as (select doc_id, list_filter(string_split_regex(regexp_replace(text, '([.!?]\s|\n)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') as l from documents),
p as (select doc_id, length(unnest(l)) as n, generate_subscripts(l, 1) as k from s0),
r as (select doc_id, k, n as used, 0 as g, n from p where k = 1 union all select p.doc_id, p.k, case when r.used + p.n > 440 then p.n else r.used + p.n end, case when r.used + p.n > 440 then r.g + 1 else r.g end, p.n from r join p on p.doc_id = r.doc_id and p.k = r.k + 1)
select doc_id, g as piece, sum(n)::bigint as chars from r group by doc_id, g""")
def _(s, d):
    # Pieces end after a sentence's white space or a line break, and together are the text.
    parts = F.filter(F.split(F.regexp_replace("text", r"([.!?]\s|\n)", "$1\u0001"), "\u0001"), lambda x: x != "")
    rows = table(s, d, "documents").select("doc_id", parts.alias("p")).withColumn("g", R.pack_flush(F.col("p"), 440))
    rows = rows.select("doc_id", F.explode(F.arrays_zip("p", "g")).alias("x"))
    return rows.groupBy("doc_id", F.col("x.g").alias("piece")).agg(F.sum(F.length("x.p")).alias("chars"))


@BOOK.add("ret_1_term_statistics", f"with t as (select distinct doc_id, unnest({_TOK.format('text')}) as term from documents) select term, count(*)::bigint as df from t group by term")
def _(s, d):
    return R.term_statistics(table(s, d, "documents"), "doc_id")[1]


@BOOK.add("ret_2_bm25", f"""
with t as (select doc_id, {_TOK.format('text')} as t from documents), c as (select count(*) as n, avg(len(t)) as al from t),
p as (select doc_id, len, term, count(*) as tf from (select doc_id, len(t) as len, unnest(t) as term from t) group by all), f as (select term, count(*) as df from p group by term),
q as (select distinct item_id as query_id, unnest({_TOK.format('text')}) as term from benchmark),
sc as (select query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al))) as score from q join f using (term) join p using (term), c group by 1, 2),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from sc where score > 0)
select query_id, doc_id, round(score, 6) as score, rank::int as rank from r where rank <= 10""")
def _(s, d):
    q = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.bm25(table(s, d, "documents"), q, "doc_id").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


_LETTERS = r"lower(regexp_replace({}, '[^\p{{L}}\p{{M}}\p{{N}}_]', '', 'g'))"


@BOOK.add("ret_3_entity_resolution", rf"""
with w as (select item_id, string_split(text, ' ') as w from benchmark), e as (select item_id as entity, {_LETTERS.format("array_to_string(w[1:4], ' ')")} as key from w union select c, c from (select unnest(['idiot', 'trash', 'moron', 'clown']) as c)),
d as (select doc_id, {_LETTERS.format('text')} as t from documents)
select doc_id as query_id, min(entity) as entity from d join e on length(key) >= 4 and contains(t, key) group by doc_id having count(distinct entity) = 1""")
def _(s, d):
    # Entities are known by the first four words of a benchmark item, and by four words of abuse.
    items = table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("entity"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("key"))
    more = s.createDataFrame([("idiot",), ("trash",), ("moron",), ("clown",)], "entity string")
    e = items.unionByName(more.withColumn("key", F.col("entity")))
    return R.entity_in_query(table(s, d, "documents").select(F.col("doc_id").alias("query_id"), "text"), e)


@BOOK.add("ret_4_broad_coverage", "select conv_id, count(*)::bigint as turns, sum(length(text))::bigint as chars from conversations group by conv_id having sum(length(text)) <= 600")
def _(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), "text")
    out = R.broad_coverage(c.select("doc_id").distinct(), c, 600)
    return out.groupBy(F.col("doc_id").alias("conv_id")).agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))


@BOOK.add("ret_5_scope_status", rf"""
with r as (select doc_id, {_LETTERS.format("array_to_string(string_split(text, ' ')[1:3], ' ')")} as a, {_LETTERS.format("coalesce(string_split(text, ' ')[5], '')")} as b from documents where lang = 'en'),
q as (select conv_id, turn, text, {_LETTERS.format('text')} as t, case when turn % 4 = 3 then conv_id % 50 end as chosen from conversations),
n as (select conv_id, turn, count(distinct doc_id) as n, bool_or(doc_id <> chosen) as differs, min(doc_id) as one from q join r on (length(a) >= 9 and contains(t, a)) or (length(b) >= 9 and contains(t, b)) group by 1, 2),
h as (select q.*, n.n, n.one, case when chosen is not null then case when differs then 'mismatch' else 'chosen' end when n.n > 0 then 'alias' when contains(text, 'it ') and turn > 0 then 'follow_up' when contains(text, 'Wh') then 'across' else 'unnamed' end as how from q left join n using (conv_id, turn)),
p as (select h.*, case how when 'chosen' then (select count(distinct doc_id) from r where doc_id = chosen) when 'alias' then n when 'follow_up' then (select count(distinct doc_id) from r where doc_id in (conv_id, conv_id + 3)) else 0 end as k,
  case how when 'chosen' then chosen when 'alias' then one when 'follow_up' then (select min(doc_id) from r where doc_id in (conv_id, conv_id + 3)) end as rid from h)
select conv_id, turn, case when how in ('mismatch', 'across') then 'refused' when how = 'unnamed' or k = 0 then 'unknown' when k > 1 then 'ambiguous' else 'resolved' end as status,
  case when how in ('mismatch', 'across', 'unnamed') then how when k = 0 then 'no_report' when k > 1 then 'several_reports' else how end as reason, case when k = 1 then rid end as report_id from p""")
def _(s, d):
    # A report is known by its first three words and by its fifth; a conversation's earlier answer came from two reports.
    w = F.split("text", " ")
    reports = table(s, d, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("report_id"), F.col("doc_id").alias("document_id"), F.array(F.array_join(F.slice(w, 1, 3), " "), F.get(w, F.lit(4))).alias("aliases"))
    key, conv = F.struct("conv_id", "turn"), F.col("conv_id")
    q = table(s, d, "conversations").select(key.alias("query_id"), "text", F.when(F.col("turn") % 4 == 3, conv % 50).alias("document_id"), F.when(F.col("turn") > 0, F.array(conv, conv + 3)).alias("previous"))
    return R.resolve_scope(q, reports, ("it ",), ("Wh",), least=9).select("query_id.*", "status", "reason", "report_id")


@BOOK.add("ret_6_module_filter", "select source, count(*)::bigint as docs from documents where lang in ('de', 'fr') group by source")
def _(s, d):
    rules = s.createDataFrame([("german", "de"), ("french", "fr"), ("spanish", "es")], "word string, module string")
    wanted = s.createDataFrame([(1, "german"), (1, "french")], "query_id int, word string")
    return R.module_filter(table(s, d, "documents").withColumnRenamed("lang", "module"), rules, wanted).groupBy("source").agg(F.count("*").alias("docs"))


_ROBIN = """
with recursive t as (select conv_id, turn, role, length(text) as n, row_number() over (partition by conv_id, role order by turn) as rn from conversations),
o as (select *, row_number() over (partition by conv_id order by rn, role, turn) as k from t),
r as (select conv_id, k, turn, n <= 500 as ok, case when n <= 500 then n else 0 end as used from o where k = 1 union all
 select o.conv_id, o.k, o.turn, r.used + o.n <= 500, case when r.used + o.n <= 500 then r.used + o.n else r.used end from r join o on o.conv_id = r.conv_id and o.k = r.k + 1)
select conv_id, turn from r where ok"""


@BOOK.add("ret_7_round_robin", _ROBIN)
def _(s, d):
    return R.round_robin(table(s, d, "conversations"), ["conv_id"], "role", "turn", 500).select("conv_id", "turn")


@BOOK.add("ret_8_conversation_window", """
select conv_id, turn, used::bigint as used from (select *, sum(length(text)) over (partition by conv_id order by turn desc rows unbounded preceding) as used, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where used <= 700 and rn <= 4""")
def _(s, d):
    return R.conversation_window(table(s, d, "conversations"), 700, 4).select("conv_id", "turn", "used")


@BOOK.add("ret_9_last_answer", "select conv_id, max(turn) as turn, arg_max(text, turn) as text from conversations where role = 'assistant' and text <> '' group by conv_id")
def _(s, d):
    return R.last_answer(table(s, d, "conversations"))


def _pack_sql(rows: str, keys: str, order: str, budget: int, out: str) -> str:
    k = [x.strip() for x in keys.split(",")]
    on = " and ".join(f"o.{x} = r.{x}" for x in k)
    pick = ", ".join(f"o.{x}" for x in k)
    return f"""with recursive t as ({rows}), o as (select *, row_number() over (partition by {keys} order by {order}) as k from t),
r as (select {keys}, k, {out}, n <= {budget} as ok, case when n <= {budget} then n else 0 end as used from o where k = 1 union all
 select {pick}, o.k, {', '.join('o.' + x.strip() for x in out.split(','))}, r.used + o.n <= {budget}, case when r.used + o.n <= {budget} then r.used + o.n else r.used end from r join o on {on} and o.k = r.k + 1)
select {keys}, {out} from r where ok"""


EVIDENCE = """select page_id as id, page_id % 5 as project_id, page_id % 10 + 1 as chapter_no, url, case when page_id % 7 = 0 then null else (page_id * 37 % 100) / 100.0D end as score, html as excerpt from {pages}"""
_EV = EVIDENCE.replace("100.0D", "100.0::double").replace("{pages}", "pages")


@BOOK.add("ret_10_ranked_evidence", _pack_sql(f"select *, length(excerpt) as n, row_number() over (partition by project_id, chapter_no order by score desc nulls last, id)::int as citation from ({_EV}) where excerpt <> ''", "project_id, chapter_no", "citation", 12000, "citation, id"))
def _(s, d):
    return R.ranked_evidence(derived(s, d, EVIDENCE, "pages"), 12000)


@BOOK.add("ret_11_relevant_records", _pack_sql("select doc_id % 5 as project_id, c as chapter_no, p as priority, doc_id as id, length(text) as n from documents join (select * from (values ('en', 1, 1), ('de', 1, 2), ('fr', 2, 1)) v(record_type, c, p)) on lang = record_type where text <> ''", "project_id, chapter_no", "priority, id", 20000, "priority, id"))
def _(s, d):
    rules = s.createDataFrame([("en", 1, 1), ("de", 1, 2), ("fr", 2, 1)], "record_type string, chapter_no int, priority int")
    return R.relevant_records(table(s, d, "documents").select((F.col("doc_id") % 5).alias("project_id"), F.col("lang").alias("record_type"), F.col("doc_id").alias("id"), "text"), rules, 20000)


@BOOK.add("ret_12_digest", _pack_sql("""select doc_id, kind, pos, length(line) as n from (select doc_id, pos, line, case when pos < 3 then '0 opening' when regexp_matches(line, '(?i)\\b(?:decision|recommend|must|should)\\b') then '1 decision' when line like '% | %' then '2 table' else '3 other' end as kind
 from (select doc_id, unnest(string_split(text, chr(10))) as line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as pos from documents) where trim(line) <> '')""", "doc_id, kind", "pos", 250, "pos"))
def _(s, d):
    return R.digest_lines(table(s, d, "documents"), 1000, 0.25, 0.25, 0.25).select("doc_id", "kind", "pos")


@BOOK.add("pack_1_flush", """
with recursive o as (select conv_id, turn, length(text) as n, row_number() over (partition by conv_id order by turn) as k from conversations),
r as (select conv_id, k, turn, n as used, 0 as g from o where k = 1 union all select o.conv_id, o.k, o.turn, case when r.used > 0 and r.used + o.n > 400 then o.n else r.used + o.n end, case when r.used > 0 and r.used + o.n > 400 then r.g + 1 else r.g end from r join o on o.conv_id = r.conv_id and o.k = r.k + 1)
select conv_id, g as grp, count(*)::bigint as turns from r group by conv_id, g""")
def _(s, d):
    per = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    return per.select("conv_id", F.explode(R.pack_flush(F.transform("s", lambda x: x["text"]), 400)).alias("grp")).groupBy("conv_id", "grp").agg(F.count("*").alias("turns"))


@BOOK.add("pack_2_skip", _pack_sql("select conv_id, turn, length(text) as n from conversations", "conv_id", "turn", 400, "turn"))
def _(s, d):
    per = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    ok = R.pack_skip(F.transform("s", lambda x: x["text"]), 400)
    return per.select("conv_id", F.explode(F.arrays_zip(F.col("s").alias("s"), ok.alias("ok"))).alias("x")).filter("x.ok").select("conv_id", F.col("x.s.turn").alias("turn"))


@BOOK.add("pack_3_pages", """
with recursive o as (select conv_id, length(text) as n, row_number() over (partition by conv_id order by turn) as k from conversations),
r as (select conv_id, k, n as used, 0 as g from o where k = 1 union all select o.conv_id, o.k, case when r.used > 0 and r.used + o.n > 300 then o.n else r.used + o.n end, case when r.used > 0 and r.used + o.n > 300 then r.g + 1 else r.g end from r join o on o.conv_id = r.conv_id and o.k = r.k + 1)
select conv_id, (g // 2)::int as page, count(*)::bigint as turns from r group by 1, 2""")
def _(s, d):
    per = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("s"))
    return per.select("conv_id", F.explode(R.pack_pages(F.transform("s", lambda x: x["text"]), 300, 2)).alias("page")).groupBy("conv_id", "page").agg(F.count("*").alias("turns"))


QUERIES, ORACLE = BOOK.queries, BOOK.sql
