"""Operator 9, quality rules judged by host: DataFrame functions only.

Rules are counted per document inside its row: no text is exploded or shuffled. Failures are then summed by host,
each host's failure rates are shrunk towards a beta prior fitted to all hosts by moments, and the host's verdict on
each rule is joined back: a failure counts against a document where failing that rule is a habit of its host, and is
forgiven where it is an accident. The join is salted, so a host with a third of all documents does not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

BLANKS = "\x09\x0a\x0b\x0c\x0d\x20"
SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "word_length", "dup_lines")


def _chars(col: F.Column, drop: str) -> F.Column:
    return F.length(F.translate(col, drop, ""))


def rule_counts(docs: DataFrame, window: int = 5) -> DataFrame:
    """docs' columns doc_id and source with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long)."""
    empty = F.expr("cast(array() as array<string>)")
    body = F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS))
    rows = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"),
                       F.when(body == "", empty).otherwise(F.split(body, r"[\x20\x09-\x0D]+")).alias("w"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    starts = F.sequence(F.lit(0), F.size("w") - window)
    prints = F.when(F.size("w") >= window, F.transform(starts, lambda i: F.xxhash64(*(F.get("w", i + j) for j in range(window)))))
    rows = rows.select("doc_id", "source", F.size("w").cast("long").alias("n_words"), _chars(F.col("text"), BLANKS).cast("long").alias("word_chars"),
                       (F.length("text") - _chars(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"), prints.alias("p"))
    rows = rows.select("doc_id", "source", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "p")
    # Only texts with a repeated window sort theirs: equal windows become neighbours and name their positions.
    again = F.size("p") > F.size(F.array_distinct("p"))
    rows = rows.withColumn("s", F.when(again, F.array_sort(F.transform("p", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("p")
    twice = F.filter("s", lambda x, i: F.coalesce(F.get("s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["h"] == x["h"], F.lit(False)))
    rows = rows.withColumn("at", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("s")
    covered = F.transform("at", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("at", i + 1) - p, F.lit(window))))
    n = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(n, F.lit(0)).cast("long")).drop("at")


def quality_rules(docs: DataFrame, symbol_percent: int = 10, min_word: int = 2, max_word: int = 15, dup_line_percent: int = 10,
                  habit: float = 0.02, salts: int = 16) -> DataFrame:
    """One row per input row: doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, and the names of the rules failed.

    docs needs doc_id, text and source; other columns are ignored. Words are runs of anything but ASCII white space;
    null has none. base_failed: fewer than 10 words, or over a fifth of the words in repeated 5-word windows. Host
    rules: symbols over symbol_percent of the word characters, mean word length outside min_word to max_word, equal
    lines, in number, over dup_line_percent of the words; a host is a value of source, null and '' are hosts of their own.
    A host's rate of a rule is (failures + a) / (documents + a + b) with the beta prior's a and b by moments over all
    hosts; with one host, or hosts that do not differ, the prior is as strong as 1000 documents. kept is false if
    base_failed, or if the document fails a rule whose shrunk rate at its host is `habit` or more. A document that
    fails no rule is always kept. Repeated rows each count; empty tables give empty results.
    """
    folder = shared_dir(docs.sparkSession)
    rows = cut(rule_counts(docs.select("doc_id", "source", "text")), folder, "counts")
    fails = {
        "symbols": 100 * F.col("n_symbols") > symbol_percent * F.col("word_chars"),
        "word_length": (F.col("word_chars") < min_word * F.col("n_words")) | (F.col("word_chars") > max_word * F.col("n_words")),
        "dup_lines": 100 * F.col("n_dup_lines") > dup_line_percent * F.col("n_words"),
    }
    for r in RULES:
        rows = rows.withColumn(f"f_{r}", fails[r])
    hosts = rows.groupBy("source").agg(F.count("*").alias("n"), *(F.count_if(f"f_{r}").alias(r) for r in RULES))
    moments = hosts.agg(*(f(F.col(r) / F.col("n")).alias(f"{m}_{r}") for r in RULES for m, f in (("mean", F.avg), ("var", F.var_pop)))).first()
    for r in RULES:
        mean, var = moments[f"mean_{r}"] or 0.0, moments[f"var_{r}"] or 0.0
        strength = min(1000.0, max(1.0, mean * (1 - mean) / var - 1)) if var > 0 else 1000.0
        hosts = hosts.withColumn(r, (F.col(r) + mean * strength) / (F.col("n") + strength) >= habit)
    hosts = hosts.select(F.col("source").alias("host"), *(F.col(r).alias(f"h_{r}") for r in RULES), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    same = (F.coalesce(rows.source, F.lit("")) == F.coalesce(hosts.host, F.lit(""))) & (rows.source.isNull() == hosts.host.isNull()) & (rows.salt == hosts.salt)
    out = rows.join(hosts, same, "left")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = F.lit(False)
    for r in RULES:
        counted = counted | (F.col(f"f_{r}") & F.coalesce(f"h_{r}", F.lit(False)))
    return out.select("doc_id", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~counted).alias("kept"),
                      F.array_compact(F.array(*(F.when(F.col(f"f_{r}"), F.lit(r)) for r in RULES))).alias("failed_rules"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_SQL = r"""
with d as (
  select doc_id, source, coalesce(text, '') as text, row_number() over () as r,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
g as (select r, i, list_aggregate(w[i:i+4], 'string_agg', ' ') as p
      from (select r, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)),
q as (select r, i from (select r, i, count(*) over (partition by r, p) as c from g) where c > 1),
n as (select r, sum(least(5, coalesce(nx - i, 5))) as n_repeat_words
      from (select r, i, lead(i) over (partition by r order by i) as nx from q) group by r),
c as (
  select d.r, d.doc_id, d.source, len(d.w)::bigint as n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         (length(d.text) - length(translate(d.text, '#*$%&|<>', '')))::bigint as n_symbols,
         (len(d.l) - len(list_distinct(d.l)))::bigint as n_dup_lines, coalesce(n.n_repeat_words, 0)::bigint as n_repeat_words
  from d left join n using (r)),
f as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed, 100 * n_symbols > 10 * word_chars as f1,
             (word_chars < 2 * n_words or word_chars > 15 * n_words) as f2, 10 * n_dup_lines > n_words as f3 from c),
h as (select source, count(*) as n, count(*) filter (f1) as k1, count(*) filter (f2) as k2, count(*) filter (f3) as k3 from f group by source),
m as (select avg(k1/n) as m1, var_pop(k1/n) as v1, avg(k2/n) as m2, var_pop(k2/n) as v2, avg(k3/n) as m3, var_pop(k3/n) as v3 from h),
s as (select *, case when v1 > 0 then least(1000.0, greatest(1.0, m1*(1-m1)/v1 - 1)) else 1000.0 end as s1,
                case when v2 > 0 then least(1000.0, greatest(1.0, m2*(1-m2)/v2 - 1)) else 1000.0 end as s2,
                case when v3 > 0 then least(1000.0, greatest(1.0, m3*(1-m3)/v3 - 1)) else 1000.0 end as s3 from m),
v as (select source, (k1 + m1*s1)/(n + s1) >= 0.02 as h1, (k2 + m2*s2)/(n + s2) >= 0.02 as h2, (k3 + m3*s3)/(n + s3) >= 0.02 as h3 from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (not base_failed and not (f1 and h1) and not (f2 and h2) and not (f3 and h3)) as kept
from f join v on f.source is not distinct from v.source
"""
QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLE = {"op9_quality_rules": _SQL}
