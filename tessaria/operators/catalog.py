"""Ingest bookkeeping, catalogue, overlays, versions and upserts (SRC, CAT, MRG)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def corpus_scan(spark, path: str, pattern: str = "*", skip: str = r"^~\$") -> DataFrame:
    """SRC-1: (path, name, size, content) of files in name order; temporary ones (by name) are skipped."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    f = f.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    return f.filter(~F.col("name").rlike(skip)).select("path", "name", F.col("length").alias("size"), "content")


def with_ids(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """SRC-2: id (from the name) and fingerprint (from the content)."""
    return files.withColumn("id", T.stable_id(F.col(name), 20)).withColumn("fingerprint", F.sha2(F.col(content), 256))


def changed_files(files: DataFrame, state: DataFrame, version: int) -> DataFrame:
    """SRC-2: files whose (id, fingerprint, version) is not in the state."""
    return files.withColumn("version", F.lit(version)).join(state.select("id", "fingerprint", "version"), ["id", "fingerprint", "version"], "left_anti")


def quarantine(rows: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """SRC-6: (good rows, bad rows with an error): the first check that is true names the error; a bad row stops nothing."""
    error = F.coalesce(*(F.when(c, F.lit(name)) for name, c in checks.items()))
    r = rows.withColumn("error", error)
    return r.filter("error is null").drop("error"), r.filter("error is not null")


def typed_blocks(blocks: DataFrame, modules: list[tuple[str, str]], sections: list[tuple[str, str]]) -> DataFrame:
    """SRC-7/8: kind of each block, and module and section of the latest heading that names one (pattern, name)."""
    kind = F.when(F.startswith("text", F.lit("#")), "heading").when(F.contains("text", F.lit(" | ")), "table_row").otherwise("paragraph")
    b = blocks.withColumn("kind", kind)
    head = F.col("kind") == "heading"
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    none = F.lit(None).cast("string")
    return b.withColumn("module", F.last(F.when(head, T.first_rule(F.col("text"), modules, none)), ignorenulls=True).over(w)).withColumn("section", F.last(F.when(head, T.first_rule(F.col("text"), sections, none)), ignorenulls=True).over(w))


def table_capture(blocks: DataFrame) -> DataFrame:
    """SRC-8: (doc_id, ordinal, col, text) of all cells of table rows; repeated values stay."""
    return blocks.filter(F.contains("text", F.lit(" | "))).select("doc_id", "ordinal", F.posexplode(F.split("text", r" \| ")).alias("col", "text"))


def table_cells(blocks: DataFrame) -> DataFrame:
    """SRC-8: (doc_id, ordinal, table, row, col, header, text): table rows in succession are a table (counted from 1 in a
    document), whose first row gives each cell its header (null in columns beyond it). All cells stay, repeated ones too."""
    order = Window.partitionBy("doc_id").orderBy("ordinal")
    b = blocks.withColumn("cells", F.when(F.contains("text", F.lit(" | ")), F.split("text", r" \| ")))
    new = F.col("cells").isNotNull() & F.lag("cells").over(order).isNull()
    b = b.withColumn("table", F.count_if(new).over(order)).filter("cells is not null")
    own = Window.partitionBy("doc_id", "table").orderBy("ordinal")
    b = b.withColumn("row", F.row_number().over(own)).withColumn("headers", F.first("cells").over(own))
    b = b.select("doc_id", "ordinal", F.col("table").cast("int").alias("table"), "row", "headers", F.posexplode("cells").alias("col", "text"))
    return b.select("doc_id", "ordinal", "table", "row", "col", F.get("headers", "col").alias("header"), "text")


def entity(blocks: DataFrame, documents: DataFrame, looks: str, first: int = 35) -> DataFrame:
    """SRC-9: (doc_id, entity): the first of `first` blocks that looks like one, else the cleaned name, else a label."""
    seen = blocks.filter((F.col("ordinal") < first) & F.col("text").rlike(looks)).groupBy("doc_id").agg(F.min_by(F.regexp_extract("text", looks, 0), "ordinal").alias("e"))
    name = F.nullif(F.trim(F.regexp_replace(F.regexp_replace("name", r"\.[A-Za-z]+$", ""), r"[_\-0-9]+", " ")), F.lit(""))
    return documents.join(seen, "doc_id", "left").select("doc_id", F.coalesce("e", name, F.lit("needs review")).alias("entity"))


def suggestions(documents: DataFrame, blocks: DataFrame, looks: str, generic: str) -> DataFrame:
    """SRC-10: cover and file candidates, whether they differ, and why the suggestion was chosen."""
    cover = blocks.filter("ordinal < 35").filter(F.col("text").rlike(looks)).groupBy("doc_id").agg(F.min_by(F.regexp_extract("text", looks, 0), "ordinal").alias("cover"))
    stem = F.regexp_replace("name", r"\.[A-Za-z]+$", "")
    d = documents.join(cover, "doc_id", "left").withColumn("file", F.when(~stem.rlike(generic), stem))
    reason = F.when(F.col("cover").isNotNull() & F.col("file").isNotNull() & (F.lower("cover") != F.lower("file")), "conflict").when(F.col("cover").isNotNull(), "cover").when(F.col("file").isNotNull(), "file").otherwise("none")
    return d.select("doc_id", "cover", "file", F.coalesce("cover", "file").alias("suggested"), reason.alias("reason"))


def score_conflicts(table_values: DataFrame, prose_values: DataFrame) -> DataFrame:
    """SRC-11: (doc_id, module, table_value, prose_value) where a table and the prose of a module state different values."""
    j = table_values.withColumnRenamed("value", "table_value").join(prose_values.withColumnRenamed("value", "prose_value"), ["doc_id", "module"])
    return j.filter("table_value <> prose_value")


def report_quality(blocks: DataFrame, expected: list[str], conflicts: DataFrame) -> DataFrame:
    """SRC-12: per document the missing modules, conflicts, pending images and a status."""
    b = blocks.groupBy("doc_id").agg(F.collect_set("module").alias("have"), F.count_if(F.col("kind") == "image").alias("images"))
    c = conflicts.groupBy("doc_id").agg(F.count("*").alias("conflicts"))
    out = b.join(c, "doc_id", "left").withColumn("conflicts", F.coalesce("conflicts", F.lit(0))).withColumn("missing", F.array_sort(F.array_except(F.array(*(F.lit(x) for x in expected)), "have")))
    return out.withColumn("status", F.when((F.size("missing") > 0) | (F.col("conflicts") > 0) | (F.col("images") > 0), "needs_review").otherwise("ready")).drop("have")


def candidate_relations(blocks: DataFrame) -> DataFrame:
    """SRC-13: every issue block with every recommendation block of the same document and module, with a fixed id."""
    p = blocks.select("doc_id", "module", "section", "ordinal")
    a, b = p.filter("section = 'issue'"), p.filter("section = 'advice'")
    j = a.select("doc_id", "module", F.col("ordinal").alias("issue")).join(b.select("doc_id", "module", F.col("ordinal").alias("advice")), ["doc_id", "module"])
    return j.withColumn("id", T.stable_id(F.concat_ws("|", *(F.col(c).cast("string") for c in ("doc_id", "module", "issue", "advice")))))


def recent_rows(rows: DataFrame, keys: list[str], order: str, n: int = 20, limit: int = 9000) -> DataFrame:
    """SRC-14: per key the last n rows as JSON, cut at limit characters, with the number of rows there were."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    r = rows.withColumn("_n", F.row_number().over(w)).withColumn("_all", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("_n") <= n)
    body = F.struct(*(c for c in rows.columns if c not in keys))
    out = r.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_n", body.alias("b")))).alias("s"), F.first("_all").alias("total"))
    return out.select(*keys, F.left(F.to_json(F.transform("s", lambda x: x["b"])), F.lit(limit)).alias("excerpt"), F.size("s").alias("shown"), "total")


def normalised_results(rows: DataFrame, limits: tuple[int, int] = (200, 2500)) -> DataFrame:
    """SRC-15: text (summary, else highlights, else the text up to a limit), title, publisher (else the host) and score
    (the highest highlight's, else the row's); rows without text are skipped."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    body = F.coalesce(blank(F.col("summary")), blank(F.array_join("highlights", " ")), blank(F.left("text", F.lit(limits[1]))))
    return rows.select("id", "url", F.left("title", F.lit(limits[0])).alias("title"), body.alias("excerpt"), F.coalesce(blank(F.col("publisher")), T.host_of(F.col("url"))).alias("publisher"), F.coalesce(F.array_max("highlight_scores"), "score").alias("score")).filter("excerpt is not null")


def collect_new(found: DataFrame, existing: DataFrame) -> DataFrame:
    """SRC-16: found rows whose (project, chapter, canonical URL) is new, first (by rank, id) wins."""
    f = found.withColumn("url_key", T.url_for_collection(F.col("url")))
    f = f.join(existing.select("project_id", "chapter_no", T.url_for_collection(F.col("url")).alias("url_key")).distinct(), ["project_id", "chapter_no", "url_key"], "left_anti")
    w = Window.partitionBy("project_id", "chapter_no", "url_key").orderBy("rank", "id")
    return f.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def outcome_counters(runs: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-17: runs by outcome, rows found and saved, flags, and the first two distinct errors."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = runs.groupBy(*keys).agg(F.count("*").alias("run"), n("ok").alias("succeeded"), n("failed").alias("failed"), n("skipped").alias("skipped"), F.sum("found").alias("found"), F.sum("saved").alias("saved"), F.slice(F.array_sort(F.collect_set("error")), 1, 2).alias("errors"))
    return out.withColumn("partial", (F.col("failed") > 0) & (F.col("succeeded") > 0)).withColumn("all_failed", (F.col("failed") > 0) & (F.col("succeeded") == 0))


def by_precedence(rows: DataFrame, keys: list[str], order: dict[str, int]) -> DataFrame:
    """SRC-18: per key the row of the source that comes first."""
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("provider")]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.coalesce(rank, F.lit(99)), "id"))).filter("_r = 1").drop("_r")


def query_budget(chapters: DataFrame, saved: DataFrame, most: int, reduced: int = 3) -> DataFrame:
    """SRC-18: (project_id, chapter_no, budget): web queries left to a chapter, one less in chapter `reduced` if structured
    rows (project_id, chapter_no) were saved for it, but one at least."""
    have = saved.select("project_id", "chapter_no").distinct().withColumn("_saved", F.lit(1))
    out = chapters.join(have, ["project_id", "chapter_no"], "left")
    less = F.when(F.col("chapter_no") == reduced, F.coalesce("_saved", F.lit(0))).otherwise(0)
    return out.select("project_id", "chapter_no", F.greatest(F.lit(1), F.lit(most) - less).alias("budget"))


def requirements(chapters: DataFrame, rules: DataFrame) -> DataFrame:
    """SRC-19: datasets that a chapter in a geography needs; a rule without geography holds for all."""
    return chapters.join(rules.withColumnRenamed("geography", "rule_geography"), "chapter_no").filter("rule_geography is null or rule_geography = geography").select("project_id", "chapter_no", "dataset").distinct()


def shortage(chapters: DataFrame, usable: DataFrame, target: int) -> DataFrame:
    """SRC-20: usable evidence per chapter against a target; finished chapters without any are flagged."""
    n = usable.groupBy("project_id", "chapter_no").agg(F.count("*").alias("n"))
    out = chapters.join(n, ["project_id", "chapter_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("short", F.greatest(F.lit(0), target - F.col("n"))).withColumn("unfounded", F.col("complete") & (F.col("n") == 0))


def cache_key(provider: Column, dataset: Column, params: Column) -> Column:
    """SRC-21: hash of the canonical JSON of provider, dataset and parameters."""
    return F.sha2(F.to_json(F.array(provider, dataset, params)), 256)


def live_cache(cache: DataFrame, now: Column) -> DataFrame:
    """SRC-21: entries that have not expired."""
    return cache.filter(F.col("expires") > now)


def put_cache(cache: DataFrame, answers: DataFrame, now: Column, lifetimes: dict[str, str], lifetime: str = "7 days") -> DataFrame:
    """SRC-21: the cache (cache_key, provider, answer, stored, expires) after answers (provider, dataset, params, answer,
    asked) were put: per key the last one asked (ties by the greater answer) replaces what was there, whether that has
    expired or not. Entries live for their provider's lifetime (an interval), else for `lifetime`."""
    age = F.expr(f"interval {lifetime}")
    for name, span in lifetimes.items():
        age = F.when(F.col("provider") == name, F.expr(f"interval {span}")).otherwise(age)
    last = answers.withColumn("cache_key", cache_key(F.col("provider"), F.col("dataset"), F.col("params"))).groupBy("cache_key", "provider").agg(F.max(F.struct("asked", "answer")).alias("x"))
    fresh = last.select("cache_key", "provider", F.col("x.answer").alias("answer"), now.alias("stored"), (now + age).alias("expires"))
    return cache.join(fresh.select("cache_key"), "cache_key", "left_anti").unionByName(fresh)


def insert_absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """SRC-22, MRG-2: old rows and those new ones whose key is not there yet (first of equal keys, by all columns)."""
    w = Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys])
    fresh = new.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k").join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def digest(rows: DataFrame) -> DataFrame:
    """SRC-23: number of rows and an order-free digest: the xor and the sum of row hashes."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256), 1, 12), 16, 10).cast("bigint")
    return rows.select(h.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"))


def verify_copy(source: DataFrame, copy: DataFrame) -> DataFrame:
    """SRC-23: one row: counts and whether the digests agree."""
    a, b = digest(source), digest(copy)
    return a.join(b.select(F.col("n").alias("n2"), F.col("x").alias("x2"), F.col("s").alias("s2"))).select("n", F.col("n2").alias("n_copy"), (F.col("n").eqNullSafe(F.col("n2")) & F.col("x").eqNullSafe(F.col("x2")) & F.col("s").eqNullSafe(F.col("s2"))).alias("equal"))


def plan_rows(briefs: DataFrame, rules: DataFrame) -> DataFrame:
    """SRC-24: (project_id, chapter_no, queries): rules (chapter_no, template, only_if) filled with the brief; a rule with
    only_if holds for briefs of that focus; equal queries once, in order of the rules' position."""
    rules = F.broadcast(rules) if rules.count() <= 10_000 else rules
    r = briefs.join(rules, F.col("only_if").isNull() | (F.col("only_if") == F.col("focus")))
    q = r.select("project_id", "chapter_no", "position", F.replace("template", F.lit("{topic}"), F.col("topic")).alias("q"))
    return q.groupBy("project_id", "chapter_no").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "q"))), lambda x: x["q"])).alias("queries"))


def guarded_upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """MRG-1: the next snapshot and what happened to each row. New rows replace those that are managed and unverified;
    managed, unverified rows absent from new go; all others stay. Both have (key, value, managed, verified)."""
    o = old.select(key, F.col("value").alias("o"), F.col("managed").alias("om"), F.col("verified").alias("ov"), F.lit(True).alias("in_old"))
    n = new.select(key, F.col("value").alias("n"), F.lit(True).alias("in_new"))
    j = o.join(n, key, "full")
    free = F.coalesce(F.col("om") & ~F.col("ov"), F.lit(False))
    action = F.when(F.col("in_old").isNull(), "created").when(F.col("in_new").isNotNull() & free, "updated").when(F.col("in_new").isNotNull(), "skipped").when(free, "deleted").otherwise("kept")
    take = action.isin("created", "updated")
    return j.select(key, F.when(take, F.col("n")).otherwise(F.col("o")).alias("value"), F.coalesce("om", F.lit(True)).alias("managed"), F.coalesce("ov", F.lit(False)).alias("verified"), action.alias("action"))


def effective_blocks(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """CAT-1: blocks with edits over them (null leaves the base value), an edited flag, without deleted ones."""
    e = edits.select("block_id", F.col("text").alias("e_text"), F.col("module").alias("e_module"), F.col("deleted"), F.lit(True).alias("edited"))
    j = blocks.join(e, "block_id", "left").filter(~F.coalesce("deleted", F.lit(False)))
    return j.select("block_id", "doc_id", F.coalesce("e_text", "text").alias("text"), F.coalesce("e_module", "module").alias("module"), F.coalesce("edited", F.lit(False)).alias("edited"))


def apply_changes(edits: DataFrame, changes: DataFrame) -> DataFrame:
    """CAT-2: the overlay after a batch of changes (block_id, seq, action, text, module): per block the last one wins;
    trash and restore set the state and keep the text."""
    last = changes.groupBy("block_id").agg(F.max_by(F.struct("action", "text", "module"), "seq").alias("c"))
    j = edits.join(last, "block_id", "full")
    deleted = F.when(F.col("c.action") == "trash", True).when(F.col("c.action").isin("restore", "edit"), False).otherwise(F.coalesce("deleted", F.lit(False)))
    return j.select("block_id", F.coalesce("c.text", edits["text"]).alias("text"), F.coalesce("c.module", edits["module"]).alias("module"), deleted.alias("deleted"))


def refused_changes(changes: DataFrame, blocks: DataFrame) -> DataFrame:
    """CAT-2: changes that can't be made, with a reason: edits of an image's text, and changes of blocks that don't exist.
    blocks have (block_id, kind), one row each."""
    j = changes.join(blocks.select("block_id", F.coalesce("kind", F.lit("paragraph")).alias("_kind")), "block_id", "left")
    reason = F.when(F.col("_kind").isNull(), "no_block").when((F.col("action") == "edit") & (F.col("_kind") == "image") & F.col("text").isNotNull(), "image_text")
    return j.withColumn("reason", reason).filter("reason is not null").drop("_kind")


def new_ordinals(added: DataFrame, blocks: DataFrame) -> DataFrame:
    """CAT-2: added rows (doc_id, seq, text) with ordinals after the last one of their document."""
    top = blocks.groupBy("doc_id").agg(F.max("ordinal").alias("top"))
    w = Window.partitionBy("doc_id").orderBy("seq")
    return added.join(top, "doc_id", "left").withColumn("ordinal", F.coalesce("top", F.lit(-1)) + F.row_number().over(w)).drop("top")


def catalogue(reports: DataFrame, labels: DataFrame, state: DataFrame, companies: DataFrame) -> DataFrame:
    """CAT-3: live reports with title and company, with fallbacks."""
    j = reports.join(labels, "doc_id", "left").join(state, "doc_id", "left").join(companies, "company_id", "left")
    return j.filter(~F.coalesce("deleted", F.lit(False))).select("doc_id", F.coalesce("title", "name").alias("title"), F.coalesce("label", "company_name", F.lit("unknown")).alias("company"))


def preprocessing_status(reports: DataFrame, blocks: DataFrame, relations: DataFrame) -> DataFrame:
    """CAT-4: blocks and pending relations per report, each aggregated before the join."""
    b = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"))
    r = relations.filter("status = 'pending'").groupBy("doc_id").agg(F.count("*").alias("pending"))
    return reports.join(b, "doc_id", "left").join(r, "doc_id", "left").select("doc_id", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("pending", F.lit(0)).alias("pending"))


def audit_log(before: DataFrame, changes: DataFrame) -> DataFrame:
    """CAT-6: one row per change: target, action and the value before it, as JSON."""
    return changes.join(before.select("block_id", F.to_json(F.struct("text", "module")).alias("before_value")), "block_id", "left").select(F.col("block_id").alias("target_id"), "seq", "action", "before_value")


def progress(chapters: DataFrame, share: int = 9, all_of: int = 11) -> DataFrame:
    """CAT-12: completed chapters times a share, 100 once all are complete."""
    n = chapters.groupBy("project_id").agg(F.count_if("complete").alias("done"))
    return n.select("project_id", F.when(F.col("done") >= all_of, 100).otherwise(F.least(F.lit(99), F.col("done") * share)).cast("int").alias("progress"))


def versions(rows: DataFrame) -> DataFrame:
    """CAT-9: versions per project, newest first, the latest flagged."""
    w = Window.partitionBy("project_id").orderBy(F.desc("created"), F.desc("version_id"))
    return rows.withColumn("place", F.row_number().over(w)).withColumn("latest", F.col("place") == 1)


def remap(evidence: DataFrame, mapping: DataFrame) -> DataFrame:
    """CAT-10: evidence with chapters mapped (old_no, new_no); unmapped ones keep theirs."""
    m = mapping.withColumnRenamed("old_no", "chapter_no")
    return evidence.join(m, "chapter_no", "left").withColumn("chapter_no", F.coalesce("new_no", "chapter_no")).drop("new_no")


def reusable_plan(projects: DataFrame, evidence: DataFrame, contents: DataFrame) -> DataFrame:
    """CAT-11: per brief the newest planned project without evidence and without content."""
    p = projects.filter("status = 'planned'").join(evidence.select("project_id").distinct(), "project_id", "left_anti").join(contents.select("project_id").distinct(), "project_id", "left_anti")
    return p.groupBy("brief").agg(F.max_by("project_id", F.struct("created", "project_id")).alias("project_id"))
