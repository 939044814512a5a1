"""Duplicate detection between documents by weighted character shingles (DUP).

Grams are rows (doc_id, gram): weights, signatures, bands and scores are joins and aggregates over them. Candidate
pairs come from equal buckets or, exhaustively, from shared grams with a stated set of incoming documents, never from
a product of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import nfkc
from ..sources.shared import cut, shared_dir

#: Modulus of the permutations (fixed value).
PRIME = 2147483647


def profiles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """DUP-1: non-empty paragraphs in compatibility normal form without white space in lower case, their joined text,
    its hash and length. Paragraphs are lines."""
    normal = docs.select(F.col(key).alias("doc_id"), nfkc(F.coalesce(text, F.lit(""))).alias("text"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.lower(F.regexp_replace(x, r"\s+", "")))
    out = normal.select("doc_id", F.filter(lines, lambda x: x != "").alias("paragraphs"))
    body = F.array_join("paragraphs", "\n")
    return out.withColumn("body", body).withColumn("text_hash", F.sha2("body", 256)).withColumn("characters", F.length(F.array_join("paragraphs", "")).cast("long"))


def table_layout_hash(rows: Column) -> Column:
    """DUP-1: hash of a table's cells that keeps their layout, so (AB, C) and (A, BC) differ."""
    return F.sha2(F.to_json(rows), 256)


def exact_hash(text_hash: Column, tables_hash: Column | None = None, assets: Column | None = None) -> Column:
    """DUP-5: one hash over text, tables and sorted assets."""
    return F.sha2(F.to_json(F.struct(text_hash.alias("text"), (tables_hash if tables_hash is not None else F.lit("")).alias("tables"), (F.array_sort(assets) if assets is not None else F.expr("cast(array() as array<string>)")).alias("assets"))), 256)


def gram_array(n: int = 5) -> Column:
    """DUP-2: the distinct n-character windows of a profile's body as an array; a shorter body is one gram."""
    windows = F.regexp_extract_all("body", F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.length("body") < n, F.array("body")).otherwise(F.array_distinct(windows))


def grams(profile: DataFrame, n: int = 5) -> DataFrame:
    """DUP-2: (doc_id, gram), a row for each of a document's windows."""
    return profile.select("doc_id", F.explode(gram_array(n)).alias("gram"))


def frequency_weights(g: DataFrame, n_docs: int, least_docs: int = 5) -> DataFrame:
    """DUP-3: (gram, weight): 0.1 + ln((n + 1) / (df + 1)); all 1 for fewer than least_docs documents."""
    df = g.groupBy("gram").agg(F.count("*").alias("df"))
    weight = F.lit(1.0) if n_docs < least_docs else 0.1 + F.log((F.lit(n_docs) + 1) / (F.col("df") + 1))
    return df.select("gram", weight.cast("double").alias("weight"))


def unseen_weight(n_docs: int, least_docs: int = 5) -> Column:
    return F.lit(1.0) if n_docs < least_docs else 0.1 + F.log(F.lit(float(n_docs + 1)))


def totals(g: DataFrame, weights: DataFrame, unseen: Column) -> DataFrame:
    """(doc_id, total): sum of the weights of a document's grams."""
    return g.join(weights, "gram", "left").groupBy("doc_id").agg(F.sum(F.coalesce("weight", unseen)).alias("total"))


def scores(pairs: DataFrame, g: DataFrame, weights: DataFrame, unseen: Column) -> DataFrame:
    """DUP-4: weighted Jaccard of the pairs (a, b): the weight of shared grams over the weight of all; both totals come
    from one aggregate, so only shared grams are joined. Pairs without shared grams score 0."""
    t = totals(g, weights, unseen)
    left = pairs.join(g.select(F.col("doc_id").alias("a"), "gram"), "a")
    shared = left.join(g.select(F.col("doc_id").alias("b"), "gram"), ["b", "gram"]).join(weights, "gram", "left")
    inter = shared.groupBy("a", "b").agg(F.sum(F.coalesce("weight", unseen)).alias("shared"))
    out = pairs.join(inter, ["a", "b"], "left").join(t.select(F.col("doc_id").alias("a"), F.col("total").alias("ta")), "a").join(t.select(F.col("doc_id").alias("b"), F.col("total").alias("tb")), "b")
    s = F.coalesce("shared", F.lit(0.0))
    return out.select("a", "b", (s / F.greatest(F.lit(1e-12), F.col("ta") + F.col("tb") - s)).alias("similarity"))


def hashed(g: DataFrame) -> DataFrame:
    """(doc_id, v): a 32-bit value of each gram, from its digest."""
    return g.select("doc_id", F.conv(F.substring(F.sha2("gram", 256), 1, 8), 16, 10).cast("bigint").alias("v"))


def permutations(n: int, seed: int = 11) -> list[tuple[int, int]]:
    """n pairs (a, b) below the modulus, by a linear congruence from the seed."""
    x, out = seed, []
    for _ in range(n):
        x = (x * 48271) % PRIME
        a = x
        x = (x * 48271) % PRIME
        out.append((a, x))
    return out


def signatures(v: DataFrame, keys: list[str], n: int = 64) -> DataFrame:
    """DUP-6: the n minima of (a v + b) mod p per key, as one partial and one final aggregate."""
    return v.groupBy(*keys).agg(*(F.min((F.col("v") * a + b) % PRIME).alias(f"s{i}") for i, (a, b) in enumerate(permutations(n))))


def bands(sig: DataFrame, keys: list[str], n: int = 64, rows: int = 2) -> DataFrame:
    """DUP-7: (keys, band, bucket): a bucket for each run of `rows` minima."""
    cells = [F.struct(F.lit(i // rows).alias("band"), F.xxhash64(*(f"s{j}" for j in range(i, i + rows))).alias("bucket")) for i in range(0, n, rows)]
    return sig.select(*keys, F.explode(F.array(*cells)).alias("x")).select(*keys, "x.band", "x.bucket")


def scopes(g: DataFrame, weights: DataFrame, unseen: Column, least: int = 20) -> DataFrame:
    """DUP-8: (doc_id, scope, gram): whole texts, and distinctive grams (weight of half the unseen one or more) of
    documents with at least `least` of them and some others."""
    marked = g.join(weights, "gram", "left").withColumn("rare", F.coalesce("weight", unseen) >= unseen / 2)
    counts = marked.groupBy("doc_id").agg(F.count_if("rare").alias("r"), F.count("*").alias("n")).filter((F.col("r") >= least) & (F.col("r") < F.col("n")))
    rare = marked.filter("rare").join(counts.select("doc_id"), "doc_id", "left_semi")
    return g.select("doc_id", F.lit("whole").alias("scope"), "gram").unionByName(rare.select("doc_id", F.lit("distinctive").alias("scope"), "gram"))


def fast_candidates(incoming: DataFrame, index: DataFrame) -> DataFrame:
    """DUP-12: distinct pairs (a, b) of an incoming and an indexed document that share a bucket (keys: all but doc_id)."""
    keys = [c for c in index.columns if c != "doc_id"]
    return incoming.withColumnRenamed("doc_id", "a").join(index.withColumnRenamed("doc_id", "b"), keys).filter("a <> b").select("a", "b").distinct()


def changed(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """DUP-10, SRC-2: rows whose key values are not all in the state."""
    return rows.join(state.select(*keys).distinct(), keys, "left_anti")


def exact_route(incoming: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DUP-11: (matches(a, b), rest of incoming): equal hashes settle the check, the rest flows on. Both have (doc_id, hash)."""
    hit = incoming.select(F.col("doc_id").alias("a"), "hash").join(corpus.select(F.col("doc_id").alias("b"), "hash"), "hash").filter("a <> b")
    return hit.select("a", "b"), incoming.join(hit.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_anti")


def strict_scores(incoming: DataFrame, g: DataFrame, weights: DataFrame, unseen: Column) -> DataFrame:
    """DUP-13/15: every pair of an incoming document (doc_id) and a document that shares a gram, scored. Incoming
    documents are the stated set; their grams meet the corpus by equality only."""
    t = totals(g, weights, unseen)
    asked = g.join(incoming.select("doc_id"), "doc_id", "left_semi").withColumnRenamed("doc_id", "a")
    inter = asked.join(g.withColumnRenamed("doc_id", "b"), "gram").filter("a <> b").join(weights, "gram", "left").groupBy("a", "b").agg(F.sum(F.coalesce("weight", unseen)).alias("s"))
    out = inter.join(t.select(F.col("doc_id").alias("a"), F.col("total").alias("ta")), "a").join(t.select(F.col("doc_id").alias("b"), F.col("total").alias("tb")), "b")
    return out.select("a", "b", (F.col("s") / F.greatest(F.lit(1e-12), F.col("ta") + F.col("tb") - F.col("s"))).alias("similarity"))


def matches(scored: DataFrame, exact: DataFrame, targets: DataFrame, threshold: float = 90.0) -> DataFrame:
    """DUP-14: pairs at or over the threshold (percent), exact ones and explicit targets, with flags, best first."""
    e = exact.select("a", "b", F.lit(True).alias("exact"))
    t = targets.select("a", "b", F.lit(True).alias("target"))
    out = scored.join(e, ["a", "b"], "full").join(t, ["a", "b"], "full")
    out = out.select("a", "b", F.when(F.coalesce("exact", F.lit(False)), 100.0).otherwise(F.round(100 * F.coalesce("similarity", F.lit(0.0)), 2)).alias("percent"), F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("target", F.lit(False)).alias("target"))
    return out.filter((F.col("percent") >= threshold) | F.col("exact") | F.col("target"))


def paragraph_differences(pairs: DataFrame, profile: DataFrame, most: int = 3, width: int = 450) -> DataFrame:
    """DUP-16: per pair the first paragraphs only one side has, in order, `most` of each, `width` characters."""
    p = profile.select("doc_id", "paragraphs")
    out = pairs.join(p.withColumnRenamed("doc_id", "a").withColumnRenamed("paragraphs", "pa"), "a").join(p.withColumnRenamed("doc_id", "b").withColumnRenamed("paragraphs", "pb"), "b")
    side = lambda x, y: F.transform(F.slice(F.array_except(x, y), 1, most), lambda v: F.left(v, F.lit(width)))
    return out.select("a", "b", side("pa", "pb").alias("only_a"), side("pb", "pa").alias("only_b"))


def name_conflicts(rows: DataFrame, incoming: DataFrame, retired: DataFrame) -> DataFrame:
    """DUP-17: (doc_id, other): equal company and title keys, not itself, not retired."""
    live = rows.join(retired.select("doc_id"), "doc_id", "left_anti").withColumnRenamed("doc_id", "other")
    return incoming.join(live, ["company_key", "title_key"]).filter("doc_id <> other").select("doc_id", "other")


def name_check(rows: DataFrame, incoming: DataFrame) -> DataFrame:
    """DUP-17: (doc_id, problem, other) for incoming documents (doc_id, company_key, title_key, target: the document to be
    updated or null) against rows (doc_id, company_key, title_key, deleted, superseded).

    A target must be there, not deleted and of the same company, else `invalid_version` with it; the others of equal
    company and title are `name_conflict`, but for the target, the document itself, and those both deleted and superseded.
    Both are rows; an invalid target does not hide conflicts. Null keys match nothing.
    """
    r = rows.select(F.col("doc_id").alias("other"), F.col("company_key").alias("_company"), F.col("title_key").alias("_title"), F.coalesce("deleted", F.lit(False)).alias("_deleted"), F.coalesce("superseded", F.lit(False)).alias("_superseded"))
    t = incoming.filter("target is not null").join(r, F.col("target") == F.col("other"), "left")
    bad = t.filter(F.col("other").isNull() | F.col("_deleted") | ~F.coalesce(F.col("company_key") == F.col("_company"), F.lit(False)))
    live = r.filter(~(F.col("_deleted") & F.col("_superseded")))
    same = incoming.join(live, (F.col("company_key") == F.col("_company")) & (F.col("title_key") == F.col("_title"))).filter("other <> doc_id and (target is null or other <> target)")
    return bad.select("doc_id", F.lit("invalid_version").alias("problem"), F.col("target").alias("other")).unionByName(same.select("doc_id", F.lit("name_conflict").alias("problem"), "other"))


def inventory(documents: DataFrame, labels: DataFrame, state: DataFrame, reports: DataFrame, companies: DataFrame, superseded: DataFrame) -> DataFrame:
    """DUP-18: documents with label, state, report and company, and whether another version replaced them."""
    old = superseded.select(F.col("previous_document_id").alias("doc_id")).distinct().withColumn("superseded", F.lit(True))
    out = documents.join(labels, "doc_id", "left").join(state, "doc_id", "left").join(reports.filter("active"), "doc_id", "left").join(companies, "company_id", "left").join(old, "doc_id", "left")
    return out.select("doc_id", "name", F.coalesce("label", "company_name", F.lit("unknown")).alias("company"), F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("superseded", F.lit(False)).alias("superseded"))


def publication_decision(flags: DataFrame) -> DataFrame:
    """DUP-19: the first reason that applies decides: name, file, exact content, similar text outside the lineage, review."""
    d = F.when(F.col("name_conflict"), "reject_name").when(F.col("file_match"), "reject_file").when(F.col("exact_match"), "reject_exact").when(F.col("similar_outside"), "reject_similar").when(F.col("needs_review"), "review").otherwise("accept")
    return flags.withColumn("decision", d)


def lineage(edges: DataFrame, starts: DataFrame, most: int = 20) -> DataFrame:
    """DUP-20: (start, ancestor), each once: everything that starts (doc_id) reach over (new_document_id, previous_document_id).

    Step k joins what is reached with the pairs that are 2**k edges apart, so neither side holds the reach of documents that
    are no starts. Ends when nothing new is reached; `most` bounds the doublings (a lineage of 2**20 versions)."""
    folder = shared_dir(edges.sparkSession)
    hop = cut(edges.select(F.col("new_document_id").alias("x"), F.col("previous_document_id").alias("y")).distinct(), folder, "hop0")
    reached = cut(starts.select(F.col("doc_id").alias("x")).distinct().join(hop, "x"), folder, "new0")
    for k in range(most):
        on = hop.select(F.col("x").alias("y"), F.col("y").alias("z"))
        far = reached.join(on, "y").select("x", F.col("z").alias("y")).distinct()
        new = cut(far.join(reached, ["x", "y"], "left_anti"), folder, f"new{k + 1}")
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        hop = cut(hop.join(on, "y").select("x", F.col("z").alias("y")).distinct(), folder, f"hop{k + 1}")
    return reached.select(F.col("x").alias("start"), F.col("y").alias("ancestor"))


def calibration(scored: DataFrame, n_docs: int, high: float = 0.9) -> DataFrame:
    """DUP-21: distribution of all pairs' scores; pairs without a shared gram count as 0."""
    pairs = n_docs * (n_docs - 1) // 2
    s = scored.filter("a < b").agg(F.count("*").alias("scored"), F.max("similarity").alias("top"), F.count_if(F.col("similarity") >= high).alias("n_high"), F.sum("similarity").alias("s"))
    return s.select(F.lit(pairs).cast("long").alias("pairs"), "scored", "n_high", F.round("top", 6).alias("top"), F.round(F.col("s") / pairs, 6).alias("mean"))


def _blocks(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))


def exact_paragraphs(docs: DataFrame, least: int = 40) -> DataFrame:
    """DUP-22: documents' texts without prose lines of `least` characters or more that, white space aside, stand
    earlier in the same document or in a document before it; headings left without a body go."""
    b = _blocks(docs).withColumn("key", F.regexp_replace("line", r"\s+", "")).withColumn("prose", (F.length("key") >= least) & ~F.col("line").rlike(r"^\s*(?:[#|>]|[-*+]\s|[0-9]+[.)]\s)"))
    first = b.filter("prose").groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("first")).withColumnRenamed("key", "first_key")
    b = b.join(first, (F.col("key") == F.col("first_key")) & F.col("prose"), "left").select("doc_id", "pos", "line", "prose", "first")
    b = b.filter(~F.col("prose") | F.col("first").eqNullSafe(F.struct("doc_id", "pos")))
    after = Window.partitionBy("doc_id").orderBy("pos")
    filled = b.filter(F.trim("line") != "").withColumn("next", F.lead("line").over(after))
    empty = F.col("line").rlike(r"^#") & (F.col("next").isNull() | F.col("next").rlike(r"^#"))
    return filled.filter(~empty).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))


def sentence_rows(docs: DataFrame, least: int = 25) -> DataFrame:
    """(doc_id, pos, sentence, key): sentences of `least` characters or more."""
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), r"\n+|(?<=[.!?。！？；])(?!\n)"), lambda x: F.trim(x))
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "sentence")).filter(F.length("sentence") >= least).withColumn("key", F.lower(F.regexp_replace("sentence", r"[\s\p{Punct}]+", "")))


def repeated_passages(sents: DataFrame) -> DataFrame:
    """DUP-23: sentences whose key stands earlier: in a smaller doc_id, or before in the same document."""
    first = sents.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.count("*").alias("n")).filter("n > 1")
    return sents.join(first, "key").filter(F.struct("doc_id", "pos") != F.col("f")).select("doc_id", "pos", "sentence", "key")


def repetition_scores(sents: DataFrame, least_sentences: int = 3, least_chars: int = 120, share: float = 0.25) -> DataFrame:
    """DUP-23/25: per document, repeated sentences and characters, and whether they are an issue.

    What is repeated is what is there less the sentences whose key stands first here, so keys are grouped once and never joined
    with their places. They are grouped by hash and text: rows sort by the hash."""
    n = F.length("sentence").cast("long")
    first = sents.groupBy(F.xxhash64("key").alias("h"), "key").agg(F.min(F.struct("doc_id", "pos", n.alias("n"))).alias("f"))
    first = first.groupBy(F.col("f.doc_id").alias("doc_id")).agg(F.count("*").alias("firsts"), F.sum("f.n").alias("first_chars"))
    al = sents.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(n).alias("chars"))
    less = lambda a, b: F.col(a) - F.coalesce(b, F.lit(0))
    out = al.join(first, "doc_id", "left").select("doc_id", "chars", less("n", "firsts").alias("repeated"), less("chars", "first_chars").alias("repeated_chars"))
    return out.withColumn("issue", (F.col("repeated") >= least_sentences) & (F.col("repeated_chars") >= F.greatest(F.lit(float(least_chars)), share * F.col("chars"))))


def without_repeats(sents: DataFrame) -> DataFrame:
    """DUP-24: (doc_id, text) of the sentences that are not repeated passages, in order."""
    kept = sents.join(repeated_passages(sents).select("doc_id", "pos"), ["doc_id", "pos"], "left_anti")
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))


def cross_document_repeats(sents: DataFrame) -> DataFrame:
    """DUP-26: sentences found more than once, how often and in how many documents."""
    return sents.groupBy("sentence").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc")).filter("n > 1")
