"""Queries for facts, series and scenario calculators (FCT, SER, CAL, TXT-29/30), over orders, lineitem and nations.

Sentences and tables are written from the rows, so the expected values come straight from the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as X
from ..operators import scenarios as C
from .base import Book, derived, table
from .evidence_queries import CLAIMS, _CLAIMS

BOOK = Book()

#: One record per customer segment and year: revenue in thousands, and the sentence that states it.
YEARLY = """select concat('r', seg, '-', y) as record_id, seg, y, v, concat('In ', y, ' the revenue was ', v, ' thousand in all.') as quote from (
 select cast(o_custkey % 20 as {s}) as seg, cast(year(o_orderdate) as {s}) as y, cast(cast(floor(sum(o_totalprice) / 10) as bigint) as {s}) as v from {orders} group by 1, 2) t"""
_YEARLY = YEARLY.replace("{s}", "varchar").replace("{orders}", "orders")


def _records(s, d):
    r = derived(s, d, YEARLY.replace("{s}", "string"), "orders")
    return r.select("record_id", F.lit("market").alias("record_type"), F.lit("Revenue").alias("metric"), F.lit("all").alias("scope"), F.concat(F.lit("seg"), "seg").alias("geography"), (F.col("seg") == "3").alias("conflict"),
                    F.when(F.col("seg") == "5", F.concat(F.lit("about "), "quote")).otherwise(F.col("quote")).alias("quote"), F.when(F.col("seg") == "7", F.array("seg", "y")).otherwise(F.array("record_id")).alias("evidence_ids"), "seg", "y", "v")


def _evidence(s, d):
    r = _records(s, d)
    return r.select(F.col("record_id").alias("id"), F.concat(F.lit("Report. "), "quote").alias("excerpt"), F.concat(F.lit("o"), "seg").alias("origin_key"))


def _atoms(s, d):
    return X.fact_atoms(_records(s, d), _evidence(s, d))


_OK = "seg not in ('3', '5', '7')"


@BOOK.add("fct_1_rule_candidates", f"""with e as ({_CLAIMS}), s as (select id, project_id, chapter_no, regexp_extract(excerpt, '^(.*sold\\.)', 1) as quote from e),
r as (select *, row_number() over (partition by project_id, lower(regexp_replace(quote, '[\\s!-/:-@\\[-`{{-~]+', '', 'g')) order by chapter_no, id) as rn from s) select id, 'demand' as record_type, quote from r where rn = 1""")
def _(s, d):
    ev = derived(s, d, CLAIMS.replace("{s}", "string"), "orders").withColumn("grade", F.lit("C")).withColumn("score", F.lit(0.5))
    return X.rule_candidates(ev, [(r"(?i)\bdemand\b", "demand")]).select("id", "record_type", "quote")


@BOOK.add("fct_2_candidate_record", f"""with e as ({_CLAIMS}), s as (select id, project_id, chapter_no, regexp_extract(excerpt, '^(.*sold\\.)', 1) as quote from e), k as (select *, lower(regexp_replace(quote, '[\\s!-/:-@\\[-`{{-~]+', '', 'g')) as key from s),
r as (select *, row_number() over (partition by project_id, key order by chapter_no, id) as rn from k) select id, left(sha256('demand|' || id || '|' || key), 27) as record_id from r where rn = 1""")
def _(s, d):
    ev = derived(s, d, CLAIMS.replace("{s}", "string"), "orders").withColumn("grade", F.lit("C")).withColumn("score", F.lit(0.5))
    return X.rule_candidates(ev, [(r"(?i)\bdemand\b", "demand")]).select("id", "record_id")


@BOOK.add("fct_3_accepted_candidates", f"""with y as ({_YEARLY}) select record_id, case when seg = '1' then 'type' when seg = '2' then 'measure' when seg = '4' then 'period' end as reason from y""")
def _(s, d):
    r = _records(s, d)
    c = r.select("record_id", F.col("record_id").alias("id"), F.when(F.col("seg") == "1", "gossip").otherwise("market").alias("record_type"), "quote", F.when(F.col("seg") == "2", "1").otherwise(F.col("v")).alias("value"), F.lit("thousand").alias("unit"), F.when(F.col("seg") == "4", 1800).otherwise(F.col("y").cast("int")).alias("year"))
    return X.accepted_candidates(c, _evidence(s, d), ["market"]).select("record_id", "reason")


@BOOK.add("fct_3_supported_claims", """select o_orderkey as id, case when o_custkey % 3 = 0 then 'North, Land' end as geography, case when o_orderkey % 2 = 0 then o_orderpriority else 'as quoted' end as scope from orders""")
def _(s, d):
    """Quotes name their geography in every third case, with other signs, and their scope in every second."""
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    quote = F.concat(F.when(F.col("o_custkey") % 3 == 0, "In **NORTH land** ").otherwise("In South "), F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise(F.lit("they")), F.lit(" sold 3 t"))
    c = o.select(k.alias("id"), quote.alias("quote"), F.lit(" North,  Land ").alias("geography"), F.when(k % 4 == 1, "").otherwise(F.col("o_orderpriority")).alias("scope"))
    return X.supported_by_quote(c, {"geography": None, "scope": "as quoted"}).select("id", "geography", "scope")


@BOOK.add("fct_4_balanced_sample", f"""with e as (select *, id % 97 / 97.0::double as score from ({_CLAIMS})), c as (select *, row_number() over (partition by project_id, chapter_no order by score desc, id) as k from e),
p as (select *, row_number() over (partition by project_id order by (k > 2)::int, score desc, id) as place, sum(length(excerpt)) over (partition by project_id order by (k > 2)::int, score desc, id rows unbounded preceding) as used from c) select id, project_id from p where place <= 30 and used <= 2200""")
def _(s, d):
    ev = derived(s, d, CLAIMS.replace("{s}", "string"), "orders").withColumn("score", (F.col("id") % 97) / 97.0)
    return X.balanced_sample(ev, chars=2200).select("id", "project_id")


@BOOK.add("fct_5_missing_types", "select o_custkey % 50 as project_id, concat_ws(',', case when bool_or(o_orderstatus = 'F') then null else 'F' end, case when bool_or(o_orderstatus = 'X') then null else 'X' end) as missing from orders group by 1")
def _(s, d):
    r = table(s, d, "orders").select((F.col("o_custkey") % 50).alias("project_id"), F.col("o_orderstatus").alias("record_type"))
    return X.missing_types(r, ["F", "X"]).select("project_id", F.array_join("missing", ",").alias("missing"))


@BOOK.add("fct_6_cache_hits", "with g as (select o_custkey as p, list(o_orderkey) as ids, bool_and(o_orderkey % 13 <> 0) as ok from orders group by 1) select p as project_id from g where ok and p % 4 > 0")
def _(s, d):
    o = table(s, d, "orders")
    runs = o.groupBy(F.col("o_custkey").alias("project_id")).agg(F.collect_list("o_orderkey").alias("ids")).withColumn("version", F.lit(1)).withColumn("input_hash", F.concat(F.lit("h"), F.col("project_id").cast("string"))).withColumn("mode", F.lit("rules"))
    wanted = runs.select("project_id", F.when(F.col("project_id") % 4 > 0, 1).otherwise(2).alias("version"), "input_hash", "mode")
    return X.cache_hits(wanted, runs, o.filter("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("record_id")))


@BOOK.add("fct_7_fact_atoms", f"with y as ({_YEARLY}) select record_id, case when seg = '7' then 'evidence' when seg = '3' then 'conflict' when seg = '5' then 'not_a_point' end as reason, y::int as year, v::double as value from y")
def _(s, d):
    return _atoms(s, d).select("record_id", "reason", "year", F.col("value").cast("double").alias("value"))


@BOOK.add("fct_8_scope_key", f"with y as ({_YEARLY}) select record_id, case when seg = '7' then 'source|seg7' else 'source|o' || seg || '|seg' || seg end as scope_key from y")
def _(s, d):
    return _atoms(s, d).select("record_id", "scope_key")


@BOOK.add("fct_9_yearly_series", f"with y as ({_YEARLY}) select 'source|o' || seg || '|seg' || seg as scope_key, count(*)::bigint as n_points, case when count(*) < 2 then 'points' end as blocked from y where {_OK} group by seg")
def _(s, d):
    return X.yearly_series(_atoms(s, d)).select("scope_key", "n_points", "blocked")


@BOOK.add("fct_10_growth", f"with y as (select *, y::int as yr, v::double as val from ({_YEARLY})) select 'source|o' || seg || '|seg' || seg as scope_key, max(yr) - min(yr) as periods, round((pow(arg_max(val, yr) / arg_min(val, yr), 1.0 / (max(yr) - min(yr))) - 1) * 100, 6) as cagr from y where {_OK} group by seg having count(*) >= 2")
def _(s, d):
    return X.growth(X.yearly_series(_atoms(s, d))).select("scope_key", "periods", F.round("cagr", 6).alias("cagr"))


@BOOK.add("fct_11_gap_report", "select o_custkey % 50 as project_id, bool_or(o_orderstatus = 'F') as has_done, bool_or(o_orderstatus in ('O', 'P')) as has_open from orders group by 1")
def _(s, d):
    r = table(s, d, "orders").select((F.col("o_custkey") % 50).alias("project_id"), F.col("o_orderstatus").alias("record_type"))
    return X.gap_report(r, {"done": ["F"], "open": ["O", "P"]})


@BOOK.add("fct_12_readiness", "select o_custkey % 50 as project_id, o_orderstatus as record_type, bool_or(o_orderkey % 2 = 0 and o_orderkey % 3 > 0 and o_custkey % 3 = 0) as ready from orders group by 1, 2")
def _(s, d):
    k = F.col("o_orderkey")
    r = table(s, d, "orders").select((F.col("o_custkey") % 50).alias("project_id"), F.col("o_orderstatus").alias("record_type"), (k % 2 == 0).alias("verified"), F.when(k % 3 == 0, "assumption").otherwise("reported").alias("basis"), (F.col("o_custkey") % 3).alias("gaps"), F.lit(0).alias("pending"))
    return X.readiness(r)


#: A page of lines per segment: one heading, then a line for each year.
def _pages_of_lines(s, d):
    r = _records(s, d)
    line = F.when(F.col("seg").cast("int") % 2 == 0, F.concat(F.lit("In "), "y", F.lit(" the revenue reached "), "v", F.lit(" thousand."))).otherwise(F.concat(F.lit("In "), "y", F.lit(" it was "), "v", F.lit(" thousand.")))
    per = r.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("y", line.alias("l")))).alias("ls"))
    text = F.concat(F.lit("# Market\nOur view on revenue follows.\n"), F.array_join(F.transform("ls", lambda x: x["l"]), "\n"), F.lit("\n# Outlook\nNothing new."))
    return per.select(F.col("seg").cast("long").alias("doc_id"), text.alias("text"))


@BOOK.add("ser_1_text_series", f"with y as ({_YEARLY}) select seg::bigint as doc_id, 'revenue' as metric, 'thousand' as unit, count(*)::bigint as points from y group by seg having count(*) >= 2")
def _(s, d):
    return X.text_series(X.lines_of(_pages_of_lines(s, d)), ["revenue", "cost"]).select("doc_id", "metric", "unit", "points")


@BOOK.add("ser_2_scalar_facts", f"with y as ({_YEARLY}) select seg::bigint as doc_id, v::double as value, 'thousand' as unit from y")
def _(s, d):
    return X.scalar_facts(X.lines_of(_pages_of_lines(s, d))).select("doc_id", F.col("value").cast("double").alias("value"), "unit")


@BOOK.add("ser_3_ambiguous_pairing", "select o_orderkey as id, o_orderkey % 2 = 0 and o_custkey % 3 > 0 as ambiguous from orders")
def _(s, d):
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "Respectively, ").otherwise(""), F.lit("1994 and 1995 saw 5 km and "), F.when(F.col("o_custkey") % 3 == 0, "6 km").otherwise("a bit"))
    return table(s, d, "orders").select(F.col("o_orderkey").alias("id"), X.ambiguous_pairing(text).alias("ambiguous"))


def _tables(s, d):
    r = _records(s, d)
    line = F.concat(F.lit("| "), "y", F.lit(" | "), "v", F.lit(" | "), F.when(F.col("seg") == "4", "n/a").otherwise(F.col("v")), F.lit(" |"))
    per = r.groupBy("seg").agg(F.array_sort(F.collect_list(line)).alias("ls"))
    text = F.concat(F.lit("Intro\n| Year | Revenue (thousand) | Share |\n|---|:--:|---|\n"), F.array_join("ls", "\n"), F.lit("\nEnd"))
    return X.tables(per.select(F.col("seg").cast("long").alias("doc_id"), text.alias("text")))


@BOOK.add("txt_30_markdown_tables", f"with y as ({_YEARLY}) select seg::bigint as doc_id, count(*)::bigint * 3 as cells, sum(v::bigint)::double as total from y group by seg")
def _(s, d):
    return _tables(s, d).groupBy("doc_id").agg(F.count("*").alias("cells"), F.sum(F.when(F.col("col") == 1, F.col("cell").cast("double"))).alias("total"))


@BOOK.add("ser_4_table_series", f"with y as ({_YEARLY}) select seg::bigint as doc_id, 'thousand' as unit, count(*)::bigint as n, true as time_series from y group by seg having count(*) >= 2")
def _(s, d):
    return X.table_series(_tables(s, d)).select("doc_id", "unit", "n", "time_series")


@BOOK.add("ser_5_audited_facts", f"with y as ({_YEARLY}) select record_id from y where seg <> '7' and seg <> '2'")
def _(s, d):
    f = _atoms(s, d).withColumn("value", F.when(F.startswith("record_id", F.lit("r2-")), F.lit(-1)).otherwise(F.col("value")))
    return X.audited_facts(f, _evidence(s, d)).select("record_id")


#: Two years of a segment in one sentence; the second one's unit or metric differs in some segments.
TWO_YEARS = """select concat('t', seg, '-', y) as record_id, seg, y, v, y2, v2, concat('In ', y, ' the revenue was ', v, ' thousand, in ', y2, case when seg = '4' then ' the cost' else ' the revenue' end, ' was ', v2, case when seg = '3' then ' million.' else ' thousand.' end) as quote from (
 select seg, y, v, lead(y) over (partition by seg order by y) as y2, lead(v) over (partition by seg order by y) as v2 from ({yearly}) z) t where y2 is not null and v <> v2"""


@BOOK.add("ser_5_cards_and_series", f"""with t as ({TWO_YEARS.format(yearly=_YEARLY)}), ok as (select *, case when seg = '4' then 'cost' else 'revenue' end as m2, case when seg = '3' then 'million' else 'thousand' end as u2 from t where seg not in ('2', '5', '7'))
select record_id, 'card' as kind, 'revenue' as metric, 'thousand' as unit, y as labels, v as "values" from ok union all select record_id, 'card', m2, u2, y2, v2 from ok
union all select record_id, 'series', 'Sales', 'thousand', y || ',' || y2, v || ',' || v2 from ok where seg not in ('3', '4')""")
def _(s, d):
    # Segment 2 claims one of its two values only, the evidence of segment 5 says something else, segment 7 is in conflict.
    r = derived(s, d, TWO_YEARS.replace("{yearly}", YEARLY.replace("{s}", "string")), "orders")
    claim = lambda v, u: F.struct(F.concat_ws(" ", v, u).alias("whole"), F.col(v).alias("value"), u.alias("unit"))
    first, second = claim("v", F.lit("thousand")), claim("v2", F.when(F.col("seg") == "3", "million").otherwise("thousand"))
    records = r.select("record_id", F.lit("Sales").alias("metric"), "quote", (F.col("seg") == "7").alias("conflict"), F.array("record_id").alias("evidence_ids"), F.when(F.col("seg") == "2", F.array(first)).otherwise(F.array(first, second)).alias("claims"),
                       F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("period"))
    ev = r.select(F.col("record_id").alias("id"), F.when(F.col("seg") == "5", "Nothing of it.").otherwise(F.concat(F.lit("Report. "), "quote")).alias("excerpt"))
    joined = lambda c: F.array_join(c, ",")
    return X.fact_cards(records, ev).select("record_id", "kind", "metric", "unit", joined("labels").alias("labels"), joined(F.transform("values", lambda v: v.cast("long").cast("string"))).alias("values"))


@BOOK.add("ser_6_audited_growth", f"with y as ({_YEARLY}) select 'source|o' || seg || '|seg' || seg as scope_key from y where {_OK} and seg <> '9' group by seg having count(*) >= 2")
def _(s, d):
    a = _atoms(s, d)
    return X.audited_growth(X.growth(X.yearly_series(a)), a.filter(~F.startswith("record_id", F.lit("r9-")))).select("scope_key")


@BOOK.add("ser_7_calculation_series", "with g as (select o_custkey % 20 as seg, count(*)::double as n, round(sum(o_totalprice), 2) as total from orders group by 1) select seg, 'n' as label, n as value, 'orders' as unit from g union all select seg, 'total', total, 'USD' from g")
def _(s, d):
    g = table(s, d, "orders").groupBy((F.col("o_custkey") % 20).alias("seg")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return X.calculation_series(g, ["seg"], {"n": "orders", "total": "USD"})


@BOOK.add("ser_8_merge_provenance", """with m as (select o_custkey % 50 as seg, year(o_orderdate)::int as y, o_orderkey as id, o_orderpriority as grade, o_orderstatus as excerpt, 'c' || o_custkey as ref from orders),
p as (select distinct seg, y, 'id' as kind, id::varchar as value from m union all select distinct seg, y, 'excerpt', excerpt from m union all select distinct seg, y, 'reference', ref from m),
g as (select seg, y, min(id) as id, min(grade) as grade from m group by 1, 2)
select p.seg, p.y, g.id, g.grade, count(*) filter (kind = 'id')::bigint as n_ids, count(*) filter (kind = 'excerpt')::bigint as n_excerpts, count(*) filter (kind = 'reference')::bigint as n_references, min(value) as first_value, count(*)::bigint as members from p join g using (seg, y) group by 1, 2, 3, 4""")
def _(s, d):
    r = table(s, d, "orders").select((F.col("o_custkey") % 50).alias("seg"), F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("grade"), F.array("o_orderstatus").alias("excerpts"), F.array(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("refs"))
    merged, members = X.merge_provenance(r, ["seg", "y"])
    return merged.join(members.groupBy("seg", "y").agg(F.min("value").alias("first_value"), F.count("*").alias("members")), ["seg", "y"])


@BOOK.add("ser_9_thinning", """with c as (select o_orderkey as id, o_custkey % 5 + 1 as chapter_no, case when o_orderkey % 2 = 0 then 'scalar' else 'series' end as kind, o_custkey || '-' || o_orderstatus as signature, o_orderstatus as unit, o_custkey % 11 as value from orders),
a as (select *, row_number() over (partition by signature order by id) as a from c), b as (select *, row_number() over (partition by kind, chapter_no, unit, value order by id) as b from a where a = 1 and (kind <> 'scalar' or chapter_no <> 1)),
k as (select *, row_number() over (partition by kind, chapter_no order by id) as k from b where kind <> 'scalar' or b = 1) select id from k where kind <> 'scalar' or k <= 3""")
def _(s, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = table(s, d, "orders").select(k.alias("id"), (c % 5 + 1).alias("chapter_no"), F.when(k % 2 == 0, "scalar").otherwise("series").alias("kind"), F.concat_ws("-", c.cast("string"), "o_orderstatus").alias("signature"), F.col("o_orderstatus").alias("unit"), (c % 11).alias("value"))
    return X.thin(r).select("id")


@BOOK.add("ser_10_selection_state", "select p_partkey as chart_id, case when p_partkey % 5 = 0 then 'stale' when p_partkey % 7 = 0 then 'stale' when p_partkey % 3 = 0 then 'selected' else 'unselected' end as state from part")
def _(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("chart_id"), F.lit("line").alias("chart_type"))
    saved = p.select("chart_id", F.when(F.col("chart_id") % 7 == 0, "bar").otherwise("line").alias("chart_type"), (F.col("chart_id") % 3 == 0).alias("selected"))
    return X.selection_state(p.filter("chart_id % 5 <> 0"), saved)


@BOOK.add("ser_11_series_binding", r"""
with b as (select doc_id, regexp_replace(text, '[\s#*_`|]|\[[0-9]+(-[0-9]+)?\]', '', 'g') as body, string_split(text, chr(10)) as l from documents),
e as (select doc_id, regexp_replace(coalesce(l[1], ''), '[\s#*_`|]|\[[0-9]+(-[0-9]+)?\]', '', 'g') as e1, regexp_replace(coalesce(l[2], ''), '[\s#*_`|]|\[[0-9]+(-[0-9]+)?\]', '', 'g') as e2 from b)
select e.doc_id as series_id, min(b.doc_id) as block_id from e join b on contains(body, e1) and contains(body, e2) where e1 || e2 <> '' and (e1 = '' or length(e1) >= 6) and (e2 = '' or length(e2) >= 6) group by 1 having count(*) = 1""")
def _(s, d):
    # Series quote the first two lines of a document; all documents are blocks of one chapter.
    docs, lines = table(s, d, "documents").withColumn("chapter_no", F.lit(1)), F.split("text", "\n")
    series = docs.select(F.col("doc_id").alias("series_id"), "chapter_no", F.array(F.get(lines, F.lit(0)), F.get(lines, F.lit(1))).alias("excerpts"))
    return X.bind_series(series, docs.select("chapter_no", F.col("doc_id").alias("block_id"), "text"))


@BOOK.add("ser_12_ledger", f"with y as ({_YEARLY}) select 's' || seg as series_id, y as period, v::double as value, case when seg = '1' then 'checked' else 'unconfirmed' end as status from y")
def _(s, d):
    g = _records(s, d).groupBy(F.concat(F.lit("s"), "seg").alias("series_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("y").alias("label"), F.col("v").cast("double").alias("value")))).alias("points"))
    return X.ledger(g.withColumn("status", F.when(F.col("series_id") == "s1", "checked"))).select("series_id", "period", "value", "status")


@BOOK.add("txt_29_json_candidates", "select o_orderkey as id, 'e' || o_custkey as evidence_id, 'q\"]} ' || o_orderkey as quote from orders where o_orderkey % 8 < 6 union all select o_orderkey, 'x', 'second' from orders where o_orderkey % 8 = 5")
def _(s, d):
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    one = F.concat(F.lit('{"evidence_id": "e'), c, F.lit('", "exact_quote": "q\\"]} '), k, F.lit('"}'))
    forms = [("[", ', {"evidence_id": "x"}]'), ('{"records": [', "]}"), ("Here [as asked] it is: ", ". I hope {this} helps."),
             ('```json\n{"data": {"result": {"items": [', "]}}}\n```"), ('{"note": 1} {"notes": [1, 2]} then ', ""), ('{"candidates": [', ', {"evidence_id": "x", "exact_quote": "second"}, 7]}'),
             ("no json [", " never closed"), ("{'python': [", "]}")]
    answer = F.lit(None).cast("string")
    for i, (before, after) in enumerate(forms):
        body = one if i < 6 else F.lit("{")
        answer = F.when(F.col("o_orderkey") % 8 == i, F.concat(F.lit(before), body, F.lit(after))).otherwise(answer)
    return X.json_candidates(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), answer.alias("answer"))).select("id", "evidence_id", "quote")


# ---- calculators ------------------------------------------------------------------------------------------------------

#: Aggregates per brand that stand for inputs.
BRANDS = """select p_brand as scenario, count(*) as n, cast(floor(sum(l_quantity)) as bigint) as q, cast(floor(avg(l_extendedprice)) as bigint) as price, cast(floor(avg(p_retailprice)) as bigint) as cost, min(l_partkey) as k from {lineitem} join {part} on l_partkey = p_partkey group by p_brand"""
_BRANDS = BRANDS.replace("{lineitem}", "lineitem").replace("{part}", "part")


def _facts(s, d, values: dict):
    b = derived(s, d, BRANDS, "lineitem", "part")
    kv = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("decimal(20,6)").alias("value")) for k, v in values.items()))).alias("x")
    f = b.select("scenario", "k", kv).select("scenario", "k", "x.key", "x.value")
    return f.select("scenario", "key", F.when((F.col("k") % 5 == 0) & (F.col("key") == list(values)[0]), F.lit(None)).otherwise(F.col("value")).alias("value"), F.lit("book").alias("source"), F.lit("o").alias("origin_id"), F.lit("2024-01-01").cast("date").alias("date"),
                    F.when((F.col("k") % 5 == 1) & (F.col("key") == list(values)[1]), "assumption").otherwise("reported").alias("basis"), ((F.col("k") % 5 != 2) | (F.col("key") != list(values)[2])).alias("verified"), F.lit(False).alias("conflict"))


@BOOK.add("cal_1_market_funnel", f"""with b as ({_BRANDS}), m as (select *, n * 2.0 * price as tam, n * 2.0 * price * 0.5 * 0.8 * 0.75 as sam from b), c as (select *, sam * 0.2 as dc, q * price as cc, k % 5 in (0, 2) as open from m)
select scenario, case when not open then round(tam, 4)::double end as tam, case when not open then round(sam, 4)::double end as sam, case when not open then round(least(dc, cc), 4)::double end as som, case when open then null when cc < dc then 'capacity' when cc > dc then 'acquisition' else 'both' end as binding, case when open then 'open' when k % 5 = 1 then 'scenario' else 'checkable' end as status from c""")
def _(s, d):
    l = F.lit
    f = _facts(s, d, {"base": F.col("n"), "unit_demand": l(2), "unit_price": F.col("price"), "regional_coverage_pct": l(50), "product_fit_pct": l(80), "service_coverage_pct": l(75), "acquisition_rate_pct": l(20), "effective_capacity": F.col("q")})
    m = C.market(f)
    return m.select("scenario", *(F.round(F.col(c).cast("double"), 4).alias(c) for c in ("tam", "sam", "som")), "binding", "status")


@BOOK.add("cal_1_market_checks", f"""with b as ({_BRANDS}), f as (select *, unnest(['base', 'unit_demand', 'unit_price', 'acquisition_rate_pct', 'effective_capacity', 'mood']) as key from b where k % 7 <> 3),
p as (select scenario, key, case when key = 'mood' then 'unknown_key' end as a, case when key = 'unit_price' and k % 3 = 0 then 'unit' end as u, case when key <> 'mood' and k % 5 = 1 then 'scope' end as sc, case when key = 'base' and k % 4 = 1 then 'year' end as y, case when key = 'acquisition_rate_pct' and n > 100 then 'percentage' end as pc from f)
select scenario, key, unnest(list_filter([a, u, sc, y, pc], lambda x: x is not null)) as problem from p
union all select scenario, unnest(['base', 'unit_demand', 'unit_price', 'acquisition_rate_pct', 'effective_capacity', 'mood']), 'no_scenario' from b where k % 7 = 3""")
def _(s, d):
    b = derived(s, d, BRANDS, "lineitem", "part")
    l, k = F.lit, F.col("k")
    units = {"base": l("site"), "unit_demand": l("t/site"), "unit_price": F.when(k % 3 == 0, "元").otherwise("元/t"), "acquisition_rate_pct": l("%"), "effective_capacity": l("t"), "mood": l("good")}
    x = F.explode(F.array(*(F.struct(l(n).alias("key"), u.alias("unit")) for n, u in units.items()))).alias("x")
    facts = b.select("scenario", "k", F.col("n").cast("decimal(20,6)").alias("value"), x).select("scenario", "x.key", "value", "x.unit", F.when(k % 5 == 1, "abroad").otherwise("home").alias("scope"), F.when((k % 4 == 1) & (F.col("x.key") == "base"), 2023).otherwise(2024).alias("year"))
    return C.market_problems(facts, b.filter("k % 7 <> 3").select("scenario", l("site").alias("base_unit"), l("t").alias("demand_unit"), l("home").alias("scope"), l(2024).alias("year")))


@BOOK.add("cal_3_city_checks", """select n_regionkey as scenario, null::varchar as indicator, null::varchar as city, 'weights' as problem from nation where n_regionkey in (1, 3) group by 1
union all select n_regionkey, 'b', null, 'indicator_repeats' from nation where n_regionkey = 3 group by 1
union all select n_regionkey, null, n_name, 'city_repeats' from nation where n_nationkey % 6 = 5
union all select n_regionkey, 'c', n_name, 'unknown_indicator' from nation
union all select n_regionkey, i, n_name, 'unknown_city' from nation, (select unnest(['a', 'b', 'c']) as i) where n_nationkey % 6 = 4
union all select n_regionkey, 'b', n_name, 'unit' from nation where n_nationkey % 4 = 0
union all select n_regionkey, 'a', n_name, 'scope' from nation where n_nationkey % 5 = 2""")
def _(s, d):
    n, k = table(s, d, "nation").select(F.col("n_regionkey").alias("scenario"), F.col("n_name").alias("city"), F.col("n_nationkey").alias("k")), F.col("k")
    of = lambda *x: F.explode(F.array(*(F.struct(F.lit(a).alias("indicator"), F.lit(b).cast("decimal(9,3)").alias("weight")) for a, b in x))).alias("x")
    regions = n.select("scenario").distinct()
    indicators = regions.select("scenario", of(("a", "60"), ("b", "40"))).unionByName(regions.filter("scenario = 3").select("scenario", of(("b", "40"))))
    indicators = indicators.select("scenario", "x.indicator", F.when((F.col("scenario") == 1) & (F.col("x.indicator") == "a"), F.lit("59.999").cast("decimal(9,3)")).otherwise(F.col("x.weight")).alias("weight"), F.lit("km").alias("unit"))
    cells = n.select("scenario", "city", "k", F.explode(F.array(*map(F.lit, "abc"))).alias("indicator"))
    cells = cells.select("scenario", "indicator", "city", F.when((k % 4 == 0) & (F.col("indicator") == "b"), "mi").otherwise("km").alias("unit"), F.when((k % 5 == 2) & (F.col("indicator") == "a"), "other").otherwise("").alias("scope"))
    cities = n.filter("k % 6 <> 4").select("scenario", "city")
    return C.city_problems(cells, indicators, cities.unionByName(n.filter("k % 6 = 5").select("scenario", "city")), regions.withColumn("scope", F.lit("all")))


@BOOK.add("cal_2_finance", f"""with b as ({_BRANDS}), v as (select *, q * price::double as revenue, q * cost::double + 100000 + 50000 as total, price - cost as con, k % 5 = 0 as open from b)
select scenario, case when not open then revenue end as revenue, case when not open then revenue - total end as operating_profit, case when not open and con > 0 then round(150000.0 / con, 4)::double end as breakeven_quantity, case when not open then 75.0::double end as ccc_days,
 case when not open then round(500000 + greatest(0, revenue * 90 / 365 + total * 15 / 365 - 6000.0 * 30 / 365), 2)::double end as funding_floor, case when open or k % 5 in (1, 2) then 'open' else 'checkable' end as status from v""")
def _(s, d):
    l = F.lit
    f = _facts(s, d, {"sales": F.col("q"), "price": F.col("price"), "variable_cost": F.col("cost"), "capacity": F.col("q") * 2, "fixed_cash_cost": l(100000), "depreciation": l(50000), "capex": l(500000), "annual_credit_purchases": l(6000), "receivable_days": l(90), "inventory_days": l(15), "payable_days": l(30)})
    x = lambda c, n: F.round(F.col(c).cast("double"), n).alias(c)
    return C.finance(f).select("scenario", x("revenue", 2), x("operating_profit", 2), x("breakeven_quantity", 4), x("ccc_days", 2), x("funding_floor", 2), "status")


_CELLS = """select n_regionkey as scenario, n_name as city, cast(coalesce(c, 0) as double) as a, cast(coalesce(b, 0) as double) as b from {nation} left join (select c_nationkey, count(*) as c, floor(sum(c_acctbal)) as b from {customer} group by c_nationkey) t on c_nationkey = n_nationkey"""


@BOOK.add("cal_3_city_scores", f"""with n as ({_CELLS.replace('{nation}', 'nation').replace('{customer}', 'customer')}), m as (select *, min(a) over w as la, max(a) over w as ha, min(b) over w as lb, max(b) over w as hb from n window w as (partition by scenario)),
t as (select scenario, city, round(0.6 * case when ha = la then 50 else (a - la) / (ha - la) * 100 end + 0.4 * case when hb = lb then 50 else 100 - (b - lb) / (hb - lb) * 100 end, 6) as total from m), r as (select *, rank() over (partition by scenario order by total desc)::int as rank from t)
select *, rank = 1 and count(*) filter (rank = 1) over (partition by scenario) = 1 and scenario <> 2 as recommended from r""")
def _(s, d):
    n = derived(s, d, _CELLS, "nation", "customer")
    cells = n.select("scenario", "city", F.explode(F.array(F.struct(F.lit("a").alias("indicator"), F.lit(60.0).alias("weight"), F.lit("higher").alias("direction"), F.col("a").alias("value")), F.struct(F.lit("b").alias("indicator"), F.lit(40.0).alias("weight"), F.lit("lower").alias("direction"), F.col("b").alias("value")))).alias("x")).select("scenario", "city", "x.*", (F.col("scenario") != 2).alias("ok"))
    return C.city_scores(cells)


@BOOK.add("cal_4_gates", f"""with b as ({_BRANDS}), g as (select scenario, case when k % 7 = 0 then 'PENDING' when n >= 100 then 'GO' when n <= 10 then 'NO-GO' else 'HOLD' end as a, case when cost <= 1400 then 'GO' when cost >= 1450 then 'NO-GO' else 'HOLD' end as b from b)
select scenario, case when a = 'PENDING' then null when a = 'NO-GO' or b = 'NO-GO' then 'NO-GO' when a = 'GO' and b = 'GO' then 'GO' else 'HOLD' end as decision from g""")
def _(s, d):
    b = derived(s, d, BRANDS, "lineitem", "part")
    st = lambda name, direction, cur, go, no, ok: F.struct(F.lit(name).alias("name"), F.lit(direction).alias("direction"), cur.cast("double").alias("current"), F.lit(float(go)).alias("go"), F.lit(float(no)).alias("no_go"), ok.alias("reviewed"))
    rows = b.select("scenario", F.explode(F.array(st("orders", "higher", F.col("n"), 100, 10, F.col("k") % 7 != 0), st("cost", "lower", F.col("cost"), 1400, 1450, F.lit(True)))).alias("x")).select("scenario", "x.*")
    return C.gates(rows)[1].select("scenario", "decision")


@BOOK.add("cal_5_price_scenarios", f"""with b as ({_BRANDS}), s as (select *, q * price::double as r, q * cost::double + 1000 as c, unnest([-10.0, 0.0, 5.0])::double as shock_pct from b)
select scenario, shock_pct, 80.0::double as utilization_pct, r as revenue, round((r - c) / r * 100, 6) as margin_pct, round(r * (1 + shock_pct / 100) - c, 2) as shock_gross_profit from s""")
def _(s, d):
    b = derived(s, d, BRANDS, "lineitem", "part")
    x = lambda c: F.col(c).cast("double")
    rows = b.select("scenario", F.lit(100.0).alias("capacity"), F.lit(80.0).alias("output"), x("q").alias("sales"), x("price").alias("price"), x("cost").alias("unit_cost"), F.lit(1000.0).alias("fixed_cost"))
    return C.price_scenarios(rows, [-10, 0, 5]).select("scenario", "shock_pct", "utilization_pct", "revenue", F.round("margin_pct", 6).alias("margin_pct"), F.round("shock_gross_profit", 2).alias("shock_gross_profit"))


QUERIES, ORACLE = BOOK.queries, BOOK.sql
