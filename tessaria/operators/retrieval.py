"""Chunking, packing under length budgets, BM25 and scoped retrieval (SRC-3..5, RET, PACK)."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType
from pyspark.sql.window import Window

from . import containment as C


def blocks(docs: DataFrame) -> DataFrame:
    """SRC-3: (doc_id, ordinal, locator, text) of non-empty lines; a table row ("a | b | a") keeps distinct cells."""
    b = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ordinal", "line")).filter(F.trim("line") != "")
    cells = F.array_join(F.array_distinct(F.transform(F.split("line", r"\|"), lambda x: F.trim(x))), " | ")
    row = F.contains("line", F.lit(" | "))
    return b.select("doc_id", "ordinal", F.concat(F.when(row, "row ").otherwise("paragraph "), (F.col("ordinal") + 1).cast("string")).alias("locator"), F.when(row, cells).otherwise(F.trim("line")).alias("text"))


def slices(c: Column, window: int = 1000, stride: int = 850) -> Column:
    """SRC-4: overlapping windows of a long text, the text itself if it is short."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length(c) - 1), F.lit(stride))
    return F.transform(starts, lambda i: F.substring(c, i + 1, F.lit(window)))


@F.pandas_udf(ArrayType(IntegerType()))
def _flushed(sizes: pd.Series, budget: pd.Series) -> pd.Series:
    def one(row, most):
        out, used, g = np.zeros(len(row), np.int32), 0, 0
        for i, n in enumerate(row.tolist()):
            if used > 0 and used + n > most:
                used, g = 0, g + 1
            used += n
            out[i] = g
        return out

    return pd.Series([None if row is None else one(row, most) for row, most in zip(sizes, budget)])


@F.pandas_udf(ArrayType(BooleanType()))
def _skipped(sizes: pd.Series, budget: pd.Series) -> pd.Series:
    def one(row, most):
        out, used = np.zeros(len(row), bool), 0
        for i, n in enumerate(row.tolist()):
            out[i] = used + n <= most
            used += n if out[i] else 0
        return out

    return pd.Series([None if row is None else one(row, most) for row, most in zip(sizes, budget)])


def _sizes(items: Column) -> Column:
    return F.transform(items, lambda x: F.coalesce(F.length(x), F.lit(0)).cast("long"))


def pack_flush(items: Column, budget: int) -> Column:
    """PACK-1: group number of each item of an array: items are taken while the sum stays within the budget, then a new
    group starts; an item above the budget is a group of its own. One pass over the lengths, in an Arrow function, as
    the built-in aggregate would copy what it has for every item. A null item counts as empty, a null array gives null."""
    return _flushed(_sizes(items), F.lit(budget).cast("long"))


def pack_skip(items: Column, budget: int) -> Column:
    """PACK-2: whether each item of an array is taken: in order, items that do not fit are passed over."""
    return _skipped(_sizes(items), F.lit(budget).cast("long"))


def pack_pages(items: Column, limit: int, per_page: int) -> Column:
    """PACK-3: page of each sentence: consecutive sentences are joined into points up to limit, per_page points a page."""
    return F.transform(pack_flush(items, limit), lambda g: F.floor(g / per_page).cast("int"))


def chunks(block_rows: DataFrame, budget: int = 1200, window: int = 1000, stride: int = 850) -> DataFrame:
    """SRC-4: (doc_id, chunk, location, text): blocks in windows, packed up to the budget; locators joined."""
    parts = block_rows.select("doc_id", "ordinal", "locator", F.posexplode(slices(F.col("text"), window, stride)).alias("part", "piece"))
    per = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "part", "piece", "locator"))).alias("s"))
    group = pack_flush(F.transform("s", lambda x: x["piece"]), budget)
    rows = per.select("doc_id", F.posexplode(F.arrays_zip(F.col("s").alias("s"), group.alias("g"))).alias("i", "x")).select("doc_id", "i", F.col("x.g").alias("chunk"), "x.s.piece", "x.s.locator")
    out = rows.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("i", "piece", "locator"))).alias("s"))
    return out.select("doc_id", "chunk", F.array_join(F.array_distinct(F.transform("s", lambda x: x["locator"])), "; ").alias("location"), F.array_join(F.transform("s", lambda x: x["piece"]), "\n").alias("text"))


def tokens(c: Column) -> Column:
    """SRC-5: lower-case word tokens of two characters or more; runs of CJK as 2-grams."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.regexp_extract_all(F.regexp_replace(low, "[一-鿿]+", " "), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.concat(words, F.regexp_extract_all(low, F.lit("(?=([一-鿿]{2}))"), F.lit(1)))


def term_statistics(texts: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """RET-1: postings(key, term, tf, len), df(term, df), and totals (n, average length) as one row.

    df is counted from each text's distinct terms, so postings are not shuffled for it; texts that share a key count as one."""
    t = texts.select(key, tokens(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    postings = t.select(key, "len", F.explode("t").alias("term")).groupBy(key, "len", "term").agg(F.count("*").alias("tf"))
    # The outer explode keeps Spark from cutting each text a second time to leave out those without a term.
    terms = texts.select(key, F.explode_outer(F.array_distinct(tokens(F.col("text")))).alias("term")).filter("term is not null")
    if not texts.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        terms = terms.distinct()
    return postings, terms.groupBy("term").agg(F.count("*").alias("df")), t.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


#: Terms of all queries, each as often as it is asked for, up to which they are sent to the workers, some 100 bytes each.
MOST_ASKED = 1_000_000


def _best(shared, names: list[str], k: int, k1: float, b: float):
    """A task's k best texts of each query; of texts that may tie more may stay, but no more than k of one score."""
    def run(batches):
        at, ends, who, idf, queries, avg = shared.value
        keys, q, score = None, np.zeros(0, np.int64), np.zeros(0)
        least = np.zeros(len(queries))
        for batch in batches:
            found, rows, scores = [], [], []
            for row, (words, n) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                tf = Counter(filter(at.__contains__, words))
                if tf:
                    t, f = np.array([at[w] for w in tf]), np.array(list(tf.values()), float)
                    part = idf[t] * f * (k1 + 1) / (f + k1 * (1 - b + b * n / avg))
                    s = np.bincount(np.concatenate([who[ends[i] : ends[i + 1]] for i in t]), np.repeat(part, ends[t + 1] - ends[t]), len(queries))
                    good = np.flatnonzero((s > 0) & (s >= least - 2e-9))
                    found.append(good)
                    rows.append(np.full(len(good), row))
                    scores.append(s[good])
            if not found:
                continue
            new = batch.column(0).take(pa.array(np.concatenate(rows), pa.int64()))
            keys = new if keys is None else pa.concat_arrays([keys, new])
            q, score = np.concatenate([q, *found]), np.concatenate([score, *scores])
            by_key = np.argsort(np.asarray(pa.compute.sort_indices(keys)), kind="stable")
            order = np.lexsort((by_key, -score, q))
            q, score = q[order], score[order]
            places = np.arange(len(q))
            first = np.maximum.accumulate(np.where(np.append(True, q[1:] != q[:-1]), places, 0))
            same = np.maximum.accumulate(np.where(np.append(True, (q[1:] != q[:-1]) | (score[1:] != score[:-1])), places, 0))
            kth = places - first == k - 1
            least[q[kth]] = score[kth]
            stays = (score >= least[q] - 2e-9) & (places - same < k)
            q, score, keys = q[stays], score[stays], keys.take(pa.array(order[stays]))
        if keys is not None:
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(q)), keys, pa.array(score)], names=names)

    return run


def bm25(texts: DataFrame, queries: DataFrame, key: str, k: int = 10, k1: float = 1.5, b: float = 0.75, most: int = MOST_ASKED) -> DataFrame:
    """RET-2: (query_id, key, score, rank): the k best texts of each query over its distinct terms. Statistics are those
    of all texts. Up to `most` terms of queries (counted) are sent to the workers, and a task keeps its k best texts of each, so neither postings
    nor scores are shuffled; more, or texts that share a key, meet postings by equality. Both give the same rows."""
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), key)
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    if terms.count() <= most and texts.groupBy(key).count().filter("count > 1").isEmpty():
        t = texts.select(key, tokens(F.col("text")).alias("t")).withColumn("len", F.size("t"))
        n, avg = t.agg(F.count("*"), F.avg("len")).first()  # one row of two numbers
        df = t.select(F.explode(F.array_distinct("t")).alias("term")).join(F.broadcast(terms.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("df"))
        found = terms.join(df, "term").sort("term").toArrow()  # bounded by `most`
        words, codes = np.unique(np.array(found.column("term").to_pylist(), object), return_inverse=True)
        order = np.argsort(codes, kind="stable")
        ids = pa.compute.unique(found.column("query_id"))
        who = np.asarray(pa.compute.index_in(found.column("query_id"), ids, skip_nulls=False)).astype(np.int64)[order]
        of = np.zeros(len(words))
        of[codes] = found.column("df").to_numpy()
        sent = (dict(zip(words.tolist(), range(len(words)), strict=True)), np.searchsorted(codes[order], np.arange(len(words) + 1)), who, np.log(1 + (n - of + 0.5) / (of + 0.5)), ids, avg or 1.0)
        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, `{key}` {texts.schema[key].dataType.simpleString()}, score double"
        scored = t.select(key, "t", "len").mapInArrow(_best(texts.sparkSession.sparkContext.broadcast(sent), ["query_id", key, "score"], k, k1, b), kinds)
        return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    postings, df, totals = term_statistics(texts, key)
    n, avg = totals.first()  # one row of two numbers
    asked = terms.join(df, "term")
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(avg or 1.0)))
    scored = postings.join(asked, "term").groupBy("query_id", key).agg(F.sum(part).alias("score")).filter("score > 0")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def entity_in_query(queries: DataFrame, entities: DataFrame, least: int = 4, longest: bool = False) -> DataFrame:
    """RET-3: (query_id, entity) of queries(query_id, text) that name exactly one entity of entities(entity, key).

    A key of `least` letters or more is named where its letters stand in the query's, spaces, marks and case aside, so
    keys may have several words. With `longest`, a key inside a longer one that is named too does not count."""
    names = entities.select("entity", F.col("key").alias("name"))
    hits = C.mentions(queries.select(F.col("query_id").alias("key"), "text"), names, least, longest)
    return hits.groupBy(F.col("key").alias("query_id")).agg(F.countDistinct("entity").alias("n"), F.min("entity").alias("entity")).filter("n = 1").select("query_id", "entity")


def broad_coverage(docs_wanted: DataFrame, chunk_rows: DataFrame, limit: int = 40_000) -> DataFrame:
    """RET-4: all chunks of documents whose chunks together stay within the limit."""
    total = Window.partitionBy("doc_id")
    return chunk_rows.join(docs_wanted, "doc_id", "left_semi").withColumn("total", F.sum(F.length("text")).over(total)).filter(F.col("total") <= limit).drop("total")


#: Words by which a question goes on from the last one, and by which it asks about all companies.
FOLLOW_UP = ("它", "这家", "该企业", "该公司", "继续", "那么", "那应该")
ACROSS = ("哪些企业", "所有企业", "各企业", "85家", "跨企业")


def resolve_scope(queries: DataFrame, reports: DataFrame, follow_up: tuple[str, ...] = FOLLOW_UP, across: tuple[str, ...] = ACROSS, least: int = 2) -> DataFrame:
    """RET-5: (query_id, status, reason, report_id, n_reports) of queries(query_id, text, document_id, previous) over
    reports(report_id, document_id, aliases). `previous` holds the documents of the last answer.

    A chosen document_id decides, unless an alias of another document is named ("refused", "mismatch"). Else the reports
    with a named alias count, else with a word of `follow_up` those of `previous`, else a word of `across` is "refused"
    as "across", and the rest is "unknown" as "unnamed". One report is "resolved", several are "ambiguous", none is
    "unknown" as "no_report". The reason of a resolved query says how: "chosen", "alias" or "follow_up". Null aliases,
    and aliases of fewer than `least` letters, name nothing. Reports without an id don't exist."""
    r = reports.filter(F.col("report_id").isNotNull())
    names = r.select("document_id", F.explode("aliases").alias("name")).filter(F.col("name").isNotNull())
    named = C.mentions(queries.select(F.col("query_id").alias("key"), "text"), names.select(F.col("document_id").alias("entity"), "name"), least)
    named = named.select(F.col("key").alias("query_id"), F.col("entity").alias("named")).distinct()
    q = queries.select("query_id", "text", F.col("document_id").alias("chosen"), "previous")
    other = named.join(q.select("query_id", "chosen"), "query_id").groupBy("query_id").agg(F.count("*").alias("n_named"), F.bool_or(F.col("named") != F.col("chosen")).alias("differs"))
    q = q.join(other, "query_id", "left")
    says = lambda words: F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.coalesce("text", F.lit("")), w)) if words else F.lit(False)
    goes_on = says(follow_up) & (F.coalesce(F.size("previous"), F.lit(0)) > 0)
    how = F.when(F.col("chosen").isNotNull(), F.when(F.col("differs"), "mismatch").otherwise("chosen")).when(F.col("n_named") > 0, "alias").when(goes_on, "follow_up").when(says(across), "across").otherwise("unnamed")
    q = q.select("query_id", "chosen", "previous", how.alias("how"))
    wanted = q.filter("how = 'chosen'").select("query_id", F.col("chosen").alias("document_id"))
    wanted = wanted.unionByName(q.filter("how = 'alias'").select("query_id").join(named, "query_id").select("query_id", F.col("named").alias("document_id")))
    wanted = wanted.unionByName(q.filter("how = 'follow_up'").select("query_id", F.explode(F.array_distinct("previous")).alias("document_id")))
    found = wanted.join(r.select("document_id", "report_id").distinct(), "document_id").groupBy("query_id").agg(F.countDistinct("report_id").alias("n"), F.min("report_id").alias("one"))
    out = q.select("query_id", "how").join(found, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    refused, unnamed = F.col("how").isin("mismatch", "across"), F.col("how") == "unnamed"
    status = F.when(refused, "refused").when(unnamed | (F.col("n") == 0), "unknown").when(F.col("n") > 1, "ambiguous").otherwise("resolved")
    reason = F.when(refused | unnamed, F.col("how")).when(F.col("n") == 0, "no_report").when(F.col("n") > 1, "several_reports").otherwise(F.col("how"))
    return out.select("query_id", status.alias("status"), reason.alias("reason"), F.when(status == "resolved", F.col("one")).alias("report_id"), F.col("n").alias("n_reports"))


def module_filter(block_rows: DataFrame, rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """RET-6: blocks of the modules that a query's words name: rules(word, module), wanted(query_id, word)."""
    return wanted.join(rules, "word").select("query_id", "module").distinct().join(block_rows, "module")


def round_robin(rows: DataFrame, keys: list[str], group: str, order: str, budget: int) -> DataFrame:
    """RET-7: per keys, items alternate over groups (first of each, then second of each) and are taken while they fit;
    taken rows come back in their own order."""
    rn = Window.partitionBy(*keys, group).orderBy(order)
    ranked = rows.withColumn("_turn", F.row_number().over(rn))
    per = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_turn", group, order, "text"))).alias("s"))
    taken = pack_skip(F.transform("s", lambda x: x["text"]), budget)
    out = per.select(*keys, F.explode(F.arrays_zip(F.col("s").alias("s"), taken.alias("ok"))).alias("x")).filter("x.ok")
    return out.select(*keys, F.col(f"x.s.{group}").alias(group), F.col(f"x.s.{order}").alias(order), F.col("x.s.text").alias("text"))


def conversation_window(turns: DataFrame, budget: int = 14_000, most: int = 12) -> DataFrame:
    """RET-8: the newest turns of each conversation while their total length and number stay within bounds."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    used = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("used", used).withColumn("rn", F.row_number().over(w)).filter((F.col("used") <= budget) & (F.col("rn") <= most)).drop("rn")


def last_answer(turns: DataFrame) -> DataFrame:
    """RET-9: (conv_id, turn, text) of the newest assistant turn with a text."""
    t = turns.filter((F.col("role") == "assistant") & (F.coalesce("text", F.lit("")) != ""))
    return t.groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("x")).select("conv_id", "x.turn", "x.text")


def pack_ranked(items: DataFrame, keys: list[str], rank: Column, budget: int) -> DataFrame:
    """The items (keys, n, ...) of each group that greedy packing by `rank` takes: in order, one that doesn't fit is passed over; n is 1 or more.

    What is left only shrinks, so of items of one size only the first budget / n can be taken. A limit within each
    (group, size) leaves at most budget * ln(budget) candidates of a group, however large it is, and these are packed.
    """
    kept = items.filter(F.col("n") <= budget).withColumn("rank", rank)
    w = Window.partitionBy(*keys, "n").orderBy("rank")
    kept = kept.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= budget).filter(F.col("k") * F.col("n") <= budget).drop("k")
    rest = [c for c in kept.columns if c not in (*keys, "rank", "n")]
    per = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", "n", *rest))).alias("s"))
    ok = _skipped(F.transform("s", lambda x: x["n"].cast("int")), F.lit(budget).cast("long"))
    return per.select(*keys, F.explode(F.arrays_zip(F.col("s").alias("s"), ok.alias("ok"))).alias("x")).filter("x.ok").select(*keys, "x.s.*")


def ranked_evidence(evidence: DataFrame, budget: int) -> DataFrame:
    """RET-10: evidence (project_id, chapter_no, id, score, excerpt) by score (nulls last, ties by id), numbered before packing, so numbers stay when items are passed over.

    Rows without an excerpt are no evidence. A number is one more than the rows before it; rows are counted between the
    ranks that were taken, in partial aggregates, so no chapter is sorted whole. Ids are unique in a chapter.
    """
    keys = ["project_id", "chapter_no"]
    rank = F.struct(F.col("score").isNull().alias("last"), (-F.coalesce("score", F.lit(0.0))).alias("score"), F.col("id").alias("id"))
    rows = evidence.filter(F.coalesce("excerpt", F.lit("")) != "").select(*keys, "id", "score", F.length("excerpt").alias("n"))
    taken = pack_ranked(rows, keys, rank, budget).select(*keys, "rank", "id")
    bounds = taken.groupBy(*keys).agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    # A row stands before the taken one whose rank is the first that is above its own.
    at = rows.withColumn("rank", rank).join(bounds, keys).select(*keys, F.size(F.filter("ranks", lambda x: x <= F.col("rank"))).alias("slot"))
    slots = at.groupBy(*keys, "slot").agg(F.count("*").alias("rows"))
    own = taken.withColumn("slot", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")))
    w = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = slots.withColumn("before", F.coalesce(F.sum("rows").over(w), F.lit(0))).select(*keys, "slot", "before")
    return own.join(before, [*keys, "slot"]).select(*keys, (F.col("before") + 1).cast("int").alias("citation"), "id")


def relevant_records(records: DataFrame, rules: DataFrame, budget: int) -> DataFrame:
    """RET-11: records whose type a chapter allows (rules(chapter_no, record_type, priority)), by priority and id, whole texts within the budget; empty ones are left out."""
    keys = ["project_id", "chapter_no"]
    r = records.filter(F.coalesce("text", F.lit("")) != "").select("project_id", "record_type", "id", F.length("text").alias("n")).join(rules, "record_type")
    return pack_ranked(r.select(*keys, "priority", "id", "n"), keys, F.struct("priority", "id"), budget).select(*keys, "priority", "id")


def digest_lines(docs: DataFrame, budget: int, opening: float = 0.32, decisions: float = 0.38, tables: float = 0.17) -> DataFrame:
    """RET-12: per document, lines by class (opening, decision, table, other), each class packed into its share."""
    b = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    kind = F.when(F.col("pos") < 3, "0 opening").when(F.col("line").rlike(r"(?i)\b(?:decision|recommend|must|should)\b"), "1 decision").when(F.contains("line", F.lit(" | ")), "2 table").otherwise("3 other")
    b = b.withColumn("kind", kind)
    per = b.groupBy("doc_id", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("s"))
    shares = {"0 opening": opening, "1 decision": decisions, "2 table": tables, "3 other": 1 - opening - decisions - tables}
    out = None
    for name, share in shares.items():
        ok = pack_skip(F.transform("s", lambda x: x["line"]), int(budget * share))
        part = per.filter(F.col("kind") == name).select("doc_id", "kind", F.explode(F.arrays_zip(F.col("s").alias("s"), ok.alias("ok"))).alias("x")).filter("x.ok").select("doc_id", "kind", F.col("x.s.pos").alias("pos"), F.col("x.s.line").alias("line"))
        out = part if out is None else out.unionByName(part)
    return out
