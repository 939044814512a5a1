"""Operator 3, benchmark decontamination by winnowing.

Every k-gram of words is hashed, and of each run of w neighbouring k-grams the leftmost smallest hash is a
fingerprint. Two texts that share a span of k + w - 1 words or more share the fingerprint of every such window in it,
so with k + w - 1 = the window's length no shared window can be missed. Fingerprints of documents and of benchmark
items are joined; a match is then extended: the whole windows around it are compared word by word, by a join on the
words themselves. Items shorter than a window are one window, their own fingerprint (k = their length, w = 1).

The benchmark's fingerprints are a filter for the documents' ones while they are few (their number is checked); above
that bound, documents' fingerprints are shuffled and joined with them: one row for each run of windows that share a
fingerprint's place, without words. Only for runs whose fingerprint the benchmark has are the words read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import MARKS, bounded_batches, cut, raw_bytes, shared_dir, sliding_min, table, window_hashes, word_hashes, word_spans

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WINDOWS = "id long, text_key long, n_words long, start long, length long, print long, words binary"


def words_of(text: str | None) -> tuple[list[bytes], np.ndarray]:
    """The words (A-Z in lower case) of a text, and their hashes."""
    raw = raw_bytes(text)
    starts, ends = word_spans(raw, MARKS)
    lower = raw.tobytes().translate(_LOWER)
    return [lower[a:b] for a, b in zip(starts.tolist(), ends.tolist())], word_hashes(raw, starts, ends, fold=True)


def prints(hashes: np.ndarray, length: int, k: int) -> np.ndarray:
    """The fingerprint of each window of `length` words: the smallest hash among its k-grams."""
    k = min(k, length)
    grams = window_hashes(hashes, k)
    w = length - k + 1
    return grams[sliding_min(grams, w)] if len(grams) >= w else grams[:0]


def _table(rows: list[tuple], kinds: tuple, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) if rows else [[]] * len(kinds), kinds)], names=names)


RUNS = "id long, text_key long, n_words long, lo long, hi long, length long, print long"


def _runs(k: int, lengths: list[int]):
    """One row per run of windows (lo to hi) that share a fingerprint at one place, and one without a run per input row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words, hashes = words_of(text.as_py())
                rows.append((i, key, len(words), None, None, None, None))
                for length in lengths:
                    if length <= len(words):
                        grams = window_hashes(hashes, min(k, length))
                        at = sliding_min(grams, length - min(k, length) + 1)
                        lo = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                        hi = np.append(lo[1:], len(at)) - 1
                        rows.extend((i, key, None, a, b, length, p) for a, b, p in zip(lo.tolist(), hi.tolist(), grams[at[lo]].view(np.int64).tolist()))
            yield _table(rows, (pa.int64(),) * 7, ["id", "text_key", "n_words", "lo", "hi", "length", "print"])

    return run


def _words_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the runs of each text, with their words."""
    for batch in batches:
        rows: list[tuple] = []
        for i, key, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            words, _ = words_of(text.as_py())
            rows.extend((i, key, a, r["length"], r["print"], b" ".join(words[a : a + r["length"]])) for r in runs.as_py() for a in range(r["lo"], r["hi"] + 1))
        yield _table(rows, (pa.int64(),) * 5 + (pa.binary(),), ["id", "text_key", "start", "length", "print", "words"])


def _windows(window: int, k: int, lengths: list[int], known: np.ndarray | None):
    """One row per window whose fingerprint is known, and one without a window per input row. Without known ones: each
    text's own windows, a short text's being all of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words, hashes = words_of(text.as_py())
                rows.append((i, key, len(words), None, None, None, None))
                for length in lengths if known is not None else [min(window, len(words))]:
                    if not 0 < length <= len(words):
                        continue
                    p = prints(hashes, length, k)
                    at = range(len(p))
                    if known is not None and len(p):
                        j = np.searchsorted(known, p)
                        at = np.flatnonzero(known[np.minimum(j, len(known) - 1)] == p).tolist() if len(known) else []
                    signed = p.view(np.int64)
                    rows.extend((i, key, None, a, length, int(signed[a]), b" ".join(words[a : a + length])) for a in at)
            yield _table(rows, (pa.int64(),) * 6 + (pa.binary(),), ["id", "text_key", "n_words", "start", "length", "print", "words"])

    return run


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.xxhash64(key, "text").alias("text_key"), "text")


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 6, filter_bound: int = 1_000_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, hits, owners): words(doc_id, text_key, n_words) per input row; hits(doc_id, text_key, start, length,
    words), one for each occurrence of an item's window in a document; owners(words, item_id)."""
    spark = bounded_batches(docs).sparkSession
    folder = shared_dir(spark)
    items = cut(_keyed(benchmark, "item_id").mapInArrow(_windows(window, k, [], None), WINDOWS).filter("start is not null"), folder, "items")
    owners = items.select(F.col("id").alias("item_id"), "words", "print", "length").distinct()
    lengths = sorted({window} | {r[0] for r in items.select("length").distinct().collect()})  # at most `window` values
    keys = items.select("print").distinct()
    rows = _keyed(docs, "doc_id")
    if keys.count() <= filter_bound:
        known = np.sort(np.array([r[0] for r in keys.collect()], np.int64).view(np.uint64))
        made = cut(rows.mapInArrow(_windows(window, k, lengths, known), WINDOWS), folder, "windows")
        windows = made.filter("start is not null")
    else:
        made = cut(rows.mapInArrow(_runs(k, lengths), RUNS), folder, "runs")
        found = made.filter("lo is not null").join(items.select("print", "length").distinct(), ["print", "length"], "left_semi").distinct()
        found = cut(found.groupBy("id", "text_key").agg(F.collect_list(F.struct("lo", "hi", "length", "print")).alias("runs")), folder, "found")
        ids = found.select(F.col("id").alias("i"), F.col("text_key").alias("t"), "runs")
        texts = rows.dropDuplicates(["id", "text_key"]).join(ids, [rows.id.eqNullSafe(ids.i), rows.text_key == ids.t]).select("id", "text_key", "text", "runs")
        windows = texts.mapInArrow(_words_of_runs, "id long, text_key long, start long, length long, print long, words binary")
    words = made.filter("n_words is not null").select(F.col("id").alias("doc_id"), "text_key", "n_words")
    # The fingerprints meet, then the windows around them are compared in full.
    targets = owners.select("print", "length", F.col("words").alias("target")).distinct()
    hits = windows.join(targets, ["print", "length"]).filter("words = target")
    return words, hits.select(F.col("id").alias("doc_id"), "text_key", "start", "length", "words"), owners


def _item_digest(ids: F.Column) -> F.Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(ids, lambda x: x.cast("string"))), ","), 256)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 6, filter_bound: int = 1_000_000) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the item_ids found.

    docs needs doc_id (long) and text, benchmark item_id (long) and text; other columns are ignored. Words are runs of
    [0-9a-z] and non-ASCII characters, A-Z in lower case; null has none. A window is `window` consecutive words of an
    item, or all of an item that has fewer but some. Document words inside an occurrence of a window are hit. Repeated
    rows each get their own row; rows without a doc_id are kept with a null id. An empty benchmark hits nothing, empty
    documents give no rows, items without words or ids count for nothing (a null item_id is left out).
    """
    benchmark = benchmark.filter("item_id is not null")
    words, hits, owners = benchmark_hits(docs, benchmark, window, k, filter_bound)
    hits = hits.select("doc_id", "text_key", "start", "length", "words").distinct()
    before = Window.partitionBy("doc_id", "text_key").orderBy("start", "length", "words").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = F.greatest(F.lit(0), end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))))
    n_hit = hits.withColumn("fresh", fresh).groupBy("doc_id", "text_key").agg(F.sum("fresh").alias("n_hit"))
    found = hits.select("doc_id", "text_key", "words").distinct().join(owners.select("words", "item_id").distinct(), "words")
    found = found.groupBy("doc_id", "text_key").agg(F.collect_set("item_id").alias("item_ids"))
    # Nulls in the key would not join; the text key is never null and names the row on its own together with the id.
    both = n_hit.join(found, [n_hit.doc_id.eqNullSafe(found.doc_id), n_hit.text_key == found.text_key]).select(n_hit.doc_id.alias("d"), n_hit.text_key.alias("t"), "n_hit", "item_ids")
    out = words.join(both, [words.doc_id.eqNullSafe(both.d), words.text_key == both.t], "left")
    ids = F.coalesce("item_ids", F.expr("cast(array() as array<bigint>)"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                      _item_digest(ids).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), F.array_sort(ids).alias("item_ids"), "text_key")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = {"op3_decontamination": op3_decontamination}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SQL = f"""
with b as (select item_id, {_WORDS} as w from benchmark where item_id is not null),
t as (select distinct item_id, least(10, len(w)) as n, list_aggregate(w[i:i+least(10, len(w))-1], 'string_agg', ' ') as p from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as i from b where len(w) > 0)),
d as (select doc_id, {_WORDS} as w from documents),
g as (select doc_id, i, n, list_aggregate(w[i:i+n-1], 'string_agg', ' ') as p from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from t) where len(w) >= n)),
h as (select doc_id, i, n, item_id from g join t using (n, p)),
c as (select doc_id, count(distinct i) as n_hit from (select doc_id, unnest(range(i, i + n)) as i from h) group by doc_id),
s as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from h group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join c using (doc_id) left join s using (doc_id)
"""
ORACLE = {"op3_decontamination": _SQL}
