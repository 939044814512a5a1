"""Operator 5, substring dedup by super-k-mer partitioning.

A window is a run of consecutive words. Its minimiser is the leftmost smallest hash among its m-word grams. Windows
that follow each other and share the minimiser's place form a super-k-mer and travel as one packed string to the
bucket that the minimiser names; equal windows have equal minimisers, at equal offsets, so they meet in one bucket.
There the packed strings are unfolded again, their windows sorted and counted exactly: equal fingerprints are
confirmed on the words themselves. What goes back per document are ranges of words to remove.

Partitions hold a bounded number of bytes of text on average, whatever the input's size. A minimiser that is common (a
phrase that very many documents share in different surroundings) would still make one bucket too large for a task: a
bucket that outgrows its bound is dealt on by windows instead. Its strings are counted against each other by parts,
and the first place of each window of a part travels as a 128-bit fingerprint to a bucket named by the fingerprint.

Before the shuffle each task sets aside packed strings it has sent before, as far back as a bounded memory goes: every
later copy has an earlier start in the same task, so its words are removed without travelling. A passage that a third
of all documents share costs few strings per task. Strings for one partition travel as compressed blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, bounded_batches, cut, shared_dir, shuffle_partitions, sliding_min, table, window_hashes, word_hashes, word_spans

#: Bytes of packed strings that a task holds before it sends blocks, that it unfolds at once, and that it remembers as sent.
_FLUSH, _BLOCK, _SENT = 32 << 20, 4 << 20, 24 << 20
#: Bytes of text per partition on average, and of strings that a task holds before it looks for buckets to deal on.
PART_BYTES, HELD_BYTES = 16 << 20, 64 << 20


def _packed(text: str | None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space, and the offsets at which words start and end in that string."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return b" ".join(words), ends - lengths, ends


def super_kmers(text: bytes, starts: np.ndarray, ends: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, window after the last, and minimiser of each super-k-mer of a packed text."""
    raw = np.frombuffer(text, np.uint8)
    grams = window_hashes(word_hashes(raw, starts, ends, fold=False), m)
    n = len(starts) - window + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = sliding_min(grams, window - m + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return first, np.append(first[1:], n), grams[at[first]]


def _send(window: int, m: int, parts: int):
    """Rows with a block: packed strings for a partition; rows without: words removed at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=6)
        boxes: dict[int, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            rows = []
            for part, (meta, strings) in boxes.items():
                head = np.array(meta, np.int64)
                rows.append((part, None, None, None, squeeze.compress(len(meta).to_bytes(8, "little") + head.tobytes() + b"\n".join(strings))))
            boxes.clear()
            size = 0
            return _sent(rows)

        sent: dict[bytes, tuple[int, int]] = {}
        remembered = 0
        for batch in batches:
            local: list[tuple] = []
            order = np.argsort(np.array(batch.column(0).to_pylist(), np.int64), kind="stable").tolist()
            for i in order:
                doc, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                joined, starts, ends = _packed(text)
                if len(starts) < window:
                    continue
                lo, hi, key = super_kmers(joined, starts, ends, window, m)
                to = (key % np.uint64(parts)).astype(np.int64).tolist()
                cut_from, cut_to = starts[lo].tolist(), ends[hi + window - 2].tolist()
                key = key.astype(np.int64).tolist()
                for a, b, part, h, x, y in zip(lo.tolist(), hi.tolist(), to, key, cut_from, cut_to):
                    s = joined[x:y]
                    if (was := sent.get(s)) is not None and was <= (doc, a):
                        if was == (doc, a):
                            continue
                        if local and local[-1][1] == doc and local[-1][3] >= a:
                            local[-1] = (*local[-1][:3], b + window - 1, None)
                        else:
                            local.append((doc % parts, doc, a, b + window - 1, None))
                        continue
                    if was is None:
                        remembered += len(s) + 100
                    sent[s] = (doc, a)
                    box = boxes.setdefault(part, ([], []))
                    box[0].append((h, doc, a))
                    box[1].append(s)
                    size += len(s)
                if size > _FLUSH:
                    yield flush()
                if remembered > _SENT:
                    sent.clear()
                    remembered = 0
            yield _sent(local)
        yield flush()

    return run


def _sent(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                      names=["part", "doc_id", "lo", "hi", "block"])


SENT = "part long, doc_id long, lo long, hi long, block binary"


def _later(keys: np.ndarray, docs: np.ndarray, firsts: np.ndarray, strings: list[bytes], window: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, window start) of each window of these packed strings that is not its sequence's first."""
    text = b" ".join(strings)
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(raw, SPACES)
    words = word_hashes(raw, starts, ends, fold=False)
    lengths = np.fromiter((s.count(b" ") + 1 for s in strings), np.int64, len(strings))
    after = np.cumsum(lengths)
    first_word = after - lengths
    n = lengths - window + 1
    which = np.repeat(np.arange(len(strings)), n)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = first_word[which] + offset
    h = window_hashes(words, window)[at]
    doc, start = docs[which], firsts[which] + offset
    order = np.lexsort((start, doc, h, keys[which]))
    h, doc, start, at, key = h[order], doc[order], start[order], at[order], keys[which][order]
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (key[1:] == key[:-1])
    lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
    again &= (doc != doc[lead]) | (start != start[lead])
    # Equal fingerprints are confirmed on the words; should two sequences ever share one, they are told apart here.
    left, right, lead = starts[at].tolist(), ends[at + window - 1].tolist(), lead.tolist()
    other: set[bytes] = set()
    for i in np.flatnonzero(again).tolist():
        s, j = text[left[i] : right[i]], lead[i]
        if s != text[left[j] : right[j]]:
            again[i] = s in other
            other.add(s)
    return doc[again], start[again]


def _fingerprints(docs: np.ndarray, firsts: np.ndarray, strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of these strings (fingerprint, second fingerprint, doc, start) of each sequence's first place, and
    (doc, start) of all other places."""
    raw = np.frombuffer(b" ".join(strings), np.uint8)
    words = word_hashes(raw, *word_spans(raw, SPACES), fold=False)
    lengths = np.fromiter((s.count(b" ") + 1 for s in strings), np.int64, len(strings))
    n = lengths - window + 1
    which = np.repeat(np.arange(len(strings)), n)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(lengths) - lengths)[which] + offset
    h, g = (window_hashes(words, window, second)[at].view(np.int64) for second in (False, True))
    return _firsts(np.column_stack([h, g, docs[which], firsts[which] + offset]))


def _firsts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows (h, g, doc, start) of the first place of each (h, g), and (doc, start) of its other places."""
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    again = np.zeros(len(rows), bool)
    again[1:] = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
    lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(rows))))
    same = again & (rows[:, 2:] == rows[lead, 2:]).all(axis=1)
    return rows[~again], rows[again & ~same, 2:]


def _ranges(doc: np.ndarray, start: np.ndarray, window: int) -> pa.RecordBatch:
    """Removed windows as ranges of words: FOUND rows without a block."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)))) if len(doc) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(doc)) - 1 if len(new) else new
    none = pa.nulls(len(new), pa.int64()), pa.nulls(len(new), pa.binary())
    return pa.RecordBatch.from_arrays([none[0], pa.array(doc[new]), pa.array(start[new]), pa.array(start[last] + window), none[1]], names=["part", "doc_id", "lo", "hi", "block"])


def _count(window: int, m: int, parts: int, held_bytes: int):
    """FOUND rows: ranges to remove, and blocks of window fingerprints of buckets that are dealt on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, squeeze = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        part, metas, strings, held, hot = None, [], [], 0, np.zeros(0, np.int64)

        def deal(meta: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            at, sizes = 0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            while at < len(texts):
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _BLOCK)))
                firsts, again = _fingerprints(meta[at:to, 1], meta[at:to, 2], texts[at:to], window)
                yield _ranges(again[:, 0], again[:, 1], window)
                to_part = (firsts[:, 0].view(np.uint64) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(to_part, kind="stable")
                bounds = np.append(np.flatnonzero(np.concatenate(([True], np.diff(to_part[order]) > 0))), len(order))
                yield _sent([(int(to_part[order[x]]), None, None, None, squeeze.compress(firsts[order[x:y]].tobytes())) for x, y in zip(bounds, bounds[1:])])
                at = to

        def done(meta: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.lexsort((meta[:, 2], meta[:, 1], meta[:, 0]))
            key = meta[order, 0]
            shared = np.zeros(len(key), bool)
            shared[1:] |= key[1:] == key[:-1]
            shared[:-1] |= key[1:] == key[:-1]
            # A bucket with one string has no equal windows: two in one string would have the minimiser at two places.
            order = order[shared]
            bounds = np.flatnonzero(np.diff(meta[order, 0])) + 1
            sizes = np.cumsum(np.fromiter((len(strings[i]) for i in order.tolist()), np.int64, len(order)))
            at = 0
            while at < len(order):
                to = np.searchsorted(sizes, (sizes[at - 1] if at else 0) + _BLOCK)
                after = bounds[bounds > to]
                to = int(after[0]) if len(after) else len(order)
                rows = order[at:to]
                yield _ranges(*_later(meta[rows, 0], meta[rows, 1], meta[rows, 2], [strings[i] for i in rows.tolist()], window, m), window)
                at = to

        for batch in batches:
            yield batch.filter(pc.is_valid(batch.column(1)))
            for p, block in zip(batch.column(0).to_pylist(), batch.column(4)):
                if not block.is_valid:
                    continue
                if part is not None and p != part:
                    if metas:
                        yield from done(np.concatenate(metas))
                    metas, strings, held, hot = [], [], 0, np.zeros(0, np.int64)
                part = p
                data = open_.decompress(block.as_py())
                n = int.from_bytes(data[:8], "little")
                meta, texts = np.frombuffer(data[8 : 8 + 24 * n], np.int64).reshape(n, 3), data[8 + 24 * n :].split(b"\n")
                gone = np.isin(meta[:, 0], hot)
                if gone.any():
                    yield from deal(meta[gone], [texts[i] for i in np.flatnonzero(gone).tolist()])
                    texts, meta = [texts[i] for i in np.flatnonzero(~gone).tolist()], meta[~gone]
                if len(meta):
                    metas.append(meta)
                    strings.extend(texts)
                    held += sum(map(len, texts))
                if held > held_bytes:
                    # Buckets with an eighth of what a task may hold are dealt on, now and as more of them comes.
                    meta = np.concatenate(metas)
                    keys, which = np.unique(meta[:, 0], return_inverse=True)
                    large = np.bincount(which, np.fromiter(map(len, strings), np.int64, len(strings))) > held_bytes / 8
                    hot = np.union1d(hot, keys[large])
                    gone = large[which]
                    yield from deal(meta[gone], [strings[i] for i in np.flatnonzero(gone).tolist()])
                    strings = [strings[i] for i in np.flatnonzero(~gone).tolist()]
                    metas = [meta[~gone]] if len(strings) else []
                    # Without a large bucket the partition is large as a whole; the bound is raised until the next look.
                    held = sum(map(len, strings)) if gone.any() else 0
        if part is not None and metas:
            yield from done(np.concatenate(metas))

    return run


def _count_dealt(window: int):
    """Ranges to remove of one fingerprint's bucket: rows sorted by part, each a block of fingerprints."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        part, rows = None, []

        def done() -> pa.RecordBatch:
            return _ranges(*_firsts(np.concatenate(rows))[1].T, window).select([1, 2, 3])

        for batch in batches:
            for p, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part is not None and p != part:
                    yield done()
                    rows = []
                part = p
                rows.append(np.frombuffer(open_.decompress(block), np.int64).reshape(-1, 4))
        if rows:
            yield done()

    return run


def _cover(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, gone, sha, kept = [], [], [], [], []
            for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                rest, at, removed = [], 0, 0
                for lo, hi in _cover([(s["lo"], s["hi"]) for s in spans.as_py() or []]):
                    rest.extend(words[at:lo])
                    removed += hi - lo
                    at = hi
                rest = b" ".join(rest + words[at:])
                ids.append(doc)
                n.append(len(words))
                gone.append(removed)
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "surrogatepass") if with_text else None)
            cols = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(kept, pa.string())] * with_text, names=names + ["kept_text"] * with_text)

    return run


def repeated_ranges(docs: DataFrame, folder: str, window: int = 20, m: int = 4, part_bytes: int = PART_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(doc_id, lo, hi): word ranges that windows starting earlier elsewhere cover; ranges of a document may overlap."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4 * shuffle_partitions(docs.sparkSession), -(-size // part_bytes))
    sent = docs.mapInArrow(_send(window, m, parts), SENT).repartition(parts, "part").sortWithinPartitions("part")
    found = cut(sent.mapInArrow(_count(window, m, parts, held_bytes), SENT), folder, "found")
    ranges, dealt = found.filter("block is null").select("doc_id", "lo", "hi"), found.filter("block is not null").select("part", "block")
    if dealt.isEmpty():
        return ranges
    again = dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_count_dealt(window), "doc_id long, lo long, hi long")
    return ranges.unionByName(again)


def substring_dedup(docs: DataFrame, window: int = 20, m: int = 4, with_text: bool = True, broadcast_rows: int = 1_000_000,
                    part_bytes: int = PART_BYTES, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    docs needs doc_id (long) and text; other columns are ignored. Words are runs of anything but ASCII white space.
    A word goes if a window of `window` words over it has a word sequence that also starts earlier: in a document with
    a smaller doc_id, or earlier in the same one. Windows are judged on the input. Null and empty texts and texts of
    fewer words than a window lose nothing. doc_id must be unique and not null for the order to be defined: rows
    without one are left out, and of rows that repeat one, each gets the union of what is removed under that id. A
    task holds some held_bytes of strings; larger buckets are dealt on by 128-bit fingerprints of their windows, where
    two different sequences would be taken for one with a probability of 1e-18 among 10^10 windows.
    """
    folder = shared_dir(docs.sparkSession)
    docs = bounded_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null"))
    ranges = repeated_ranges(docs, folder, window, m, part_bytes, held_bytes).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    ranges = cut(ranges, folder, "ranges")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    ids = ranges.select("doc_id")
    if ids.count() > broadcast_rows:
        return docs.join(ranges, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_kept(with_text), schema)
    # While the ids of documents that lose words are few enough to broadcast, only those documents' texts travel.
    whole = docs.join(F.broadcast(ids), "doc_id", "left_anti").withColumn("spans", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>"))
    part = docs.join(F.broadcast(ids), "doc_id", "left_semi").join(ranges, "doc_id").select("doc_id", "text", "spans")
    return whole.unionByName(part).mapInArrow(_kept(with_text), schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
_SQL = r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
g as (select doc_id, i, list_aggregate(w[i:i+19], 'string_agg', ' ') as p from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from w where len(w) >= 20)),
f as (select doc_id, i, row_number() over (partition by p order by doc_id, i) as k from g),
x as (select distinct doc_id, unnest(range(i, i + 20)) as i from f where k > 1),
u as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from w),
k as (select doc_id, count(*) filter (x.i is not null) as n, string_agg(word, ' ' order by u.i) filter (x.i is null) as t from u left join x using (doc_id, i) group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join k using (doc_id)
"""
ORACLE = {"op5_substring_dedup": _SQL}
