"""Operator 8, toxicity by nearest labelled examples.

A bounded sample of labelled documents becomes TF-IDF vectors over every term that occurs in it; how many documents a
term is in is counted over all documents. The vectors go into an inverted index whose posting lists are cut into
blocks with the block's largest weight. A document's upper bound for every block follows from these maxima; blocks of
a bound below the k-th nearest example found are never opened, so the neighbours are those of the exact cosine.

A neighbour's vote weighs as much as what it shares with the document, each shared term counted by how well it tells
the classes apart among the examples; all terms make the distance, telling ones make the vote. Votes are calibrated by
isotonic regression on examples that are not in the index. Index and calibration are of bounded size and go to the
tasks; documents are scored where they are read, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MARKS, bounded_batches, carried, only_ids, raw_bytes, table, word_hashes, word_spans

FOLDS = 5
OUTPUTS = ("doc_id", "held_out", "score", "predicted", "neighbours")


def fold(doc_id: F.Column) -> F.Column:
    return F.pmod(F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)), F.lit(FOLDS))


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's distinct terms (as signed integers) and how often each occurs."""
    raw = raw_bytes(text)
    return np.unique(word_hashes(raw, *word_spans(raw, MARKS), fold=True).view(np.int64), return_counts=True)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct terms and counts, and how many characters it has."""
    for batch in batches:
        found = [term_counts(text.as_py()) for text in batch.column(1)]
        chars = [len(text.as_py() or "") for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.tobytes() for t, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary()), pa.array(chars, pa.int64())],
                                         names=["doc_id", "terms", "counts", "chars"])


def _document_counts(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                raw = raw_bytes(text.as_py())
                h = word_hashes(raw, *word_spans(raw, MARKS), fold=True).view(np.int64)
                i = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                n[np.unique(i[terms[i] == h])] += 1
                docs += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, 0)), pa.array(np.append(n, docs)), pa.array([False] * len(terms) + [True])], names=["term", "n", "total"])

    return run


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0]..hi[0]-1, lo[1]..hi[1]-1, and so on, in one array."""
    n = hi - lo
    return np.arange(int(n.sum())) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)


@dataclass
class Index:
    """Blocked inverted index over the examples. A cell is the postings of one term in one block: those of a term lie
    between cells[term] and cells[term + 1], the postings of cell c between lo[c] and lo[c + 1]."""

    terms: np.ndarray
    idf: np.ndarray
    telling: np.ndarray  # how well a term tells the classes apart
    ids: np.ndarray  # of the examples, in index order
    label: np.ndarray
    cells: np.ndarray
    block_of: np.ndarray  # of a cell
    most: np.ndarray  # largest weight in a cell
    lo: np.ndarray
    postings: np.ndarray
    weights: np.ndarray
    block: int
    k: int
    damp: float = 0.0
    xs: np.ndarray | None = None
    ys: np.ndarray | None = None
    no_terms: float = 0.0
    many: np.ndarray | None = None  # postings in a cell
    tells: np.ndarray | None = None  # how well the term of a posting tells the classes apart

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's known terms, and its TF-IDF vector of length 1 over them."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[i] == terms
        i, w = i[known], (1 + np.log(counts[known])) * self.idf[i[known]]
        return i, w / float(np.sqrt(w @ w)) if len(w) else w

    def nearest(self, i: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0 (ties: first in the index), their cosines and telling shares."""
        lo, hi = self.cells[i], self.cells[i + 1]
        c = _ranges(lo, hi)
        block, weight, many = self.block_of[c], np.repeat(w, hi - lo), self.many[c]
        bound = np.bincount(block, weight * self.most[c], minlength=-(-len(self.ids) // self.block))
        n, least, opened = len(self.ids), 0.0, []
        cosine, told = np.zeros(n), np.zeros(n)
        closed = bound > 0
        while closed.any():
            # First the blocks of the highest bounds that hold k examples, then all that may still hold a nearer one.
            some = closed & (bound >= least * (1 - 1e-9))
            if least == 0.0:
                first = np.argsort(-bound, kind="stable")[: -(-self.k // self.block) + 1]
                some = np.zeros_like(closed)
                some[first] = closed[first]
            if not some.any():
                break
            closed &= ~some
            at = np.flatnonzero(some[block])
            first, size = self.lo[c[at]], many[at]
            p = _ranges(first, first + size)
            example, part = self.postings[p], np.repeat(weight[at], size) * self.weights[p]
            cosine += np.bincount(example, part, minlength=n)
            opened.append((example, part, p))
            least = np.partition(cosine, n - self.k)[n - self.k] if n > self.k else 0.0
            if least <= 0.0:
                least = np.finfo(float).tiny
        at = np.flatnonzero(cosine >= max(least, np.finfo(float).tiny))
        at = at[np.argsort(-cosine[at], kind="stable")][: self.k]
        near = np.zeros(n, bool)
        near[at] = True
        for example, part, p in opened:
            mine = np.flatnonzero(near[example])
            told += np.bincount(example[mine], part[mine] * self.tells[p[mine]], minlength=n)
        return at, cosine[at], told[at]

    def vote(self, i: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, float]:
        at, _, told = self.nearest(i, w)
        total = float(told.sum())
        return float((told * self.label[at]).sum() / (total + self.damp)) if total + self.damp > 0 else 0.0, at, total

    def score(self, text: str | None) -> tuple[float, list[int]]:
        i, w = self.vector(*term_counts(text))
        if not len(i) or self.xs is None:
            return self.no_terms, []
        v, at, _ = self.vote(i, w)
        return float(np.clip(0.98 * np.interp(v, self.xs, self.ys) + 0.02 * v, 0, 1)), self.ids[at].tolist()


def _isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted least-squares non-decreasing fit, as points to interpolate between."""
    pools: list[list[float]] = []
    for xx, yy, ww in sorted(zip(x.tolist(), y.tolist(), w.tolist())):
        pools.append([yy * ww, ww, xx, xx])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
    points = [p for a in pools for p in ((a[2], a[0] / a[1]), (a[3], a[0] / a[1]))]
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


def fit(docs: DataFrame, labels: DataFrame, examples: int = 1500, example_chars: int = 8_000_000, k: int = 100, block: int = 32) -> Index:
    """Fits the index on at most `examples` labelled documents of either class, of example_chars characters at most in
    all (a longer text is passed over), in the order of a hash of their id, outside the held-out fold; of ten, seven
    make the index and three calibrate. All their terms are in the index; document frequencies are those of docs."""
    labels = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    labels = labels.filter(fold(F.col("doc_id")) != 0)
    size = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}  # two rows
    base = size.get(1, 0) / max(1, sum(size.values()))
    chosen = [r for y in (0, 1) for r in labels.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).collect()]
    ids = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in chosen], "doc_id long")
    texts = only_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids, "doc_id", len(chosen))
    # One row per example comes to the driver; the bounds are those of the parameters.
    found: dict[int, tuple] = {}
    for r in texts.mapInArrow(_terms, "doc_id long, terms binary, counts binary, chars long").filter(F.col("chars") <= example_chars).collect():
        one = (bytes(r["terms"]), bytes(r["counts"]), r["chars"])
        found[r["doc_id"]] = min(one, found.get(r["doc_id"], one))
    kinds: list[list[tuple]] = []
    for y in (0, 1):
        mine, chars = [], 0
        for r in chosen:
            if r["toxic"] == y and r["doc_id"] in found and chars + found[r["doc_id"]][2] <= example_chars:
                t, n, c = found[r["doc_id"]]
                chars += c
                mine.append((r["doc_id"], y, np.frombuffer(t, np.int64), np.frombuffer(n, np.int32), len(mine) % 10 < 7))
        kinds.append(mine)
    learn, held = ([x for mine in kinds for x in mine if x[4] == part] for part in (True, False))
    terms = np.unique(np.concatenate([x[2] for x in learn])) if learn else np.zeros(0, np.int64)
    if not len(terms) or any(len({x[1] for x in part}) < 2 for part in (learn, held)):
        return Index(terms[:0], np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), *(np.zeros(1, np.int64) for _ in range(5)), np.zeros(0), block, k, no_terms=base)
    df = docs.select("text").mapInArrow(_document_counts(terms), "term long, n long, total boolean").groupBy("term", "total").agg(F.sum("n").alias("n")).collect()
    total = next(r["n"] for r in df if r["total"])
    of = {r["term"]: r["n"] for r in df if not r["total"]}
    idf = np.log((total + 1) / (np.array([of.get(t, 0) for t in terms.tolist()]) + 1)) + 1
    return _index(terms, idf, learn, held, {y: size[y] / sum(x[1] == y for x in held) for y in (0, 1)}, base, block, k)


def _telling(terms: np.ndarray, learn: list, prior: float = 3.0) -> np.ndarray:
    """The squared log odds of a term between the classes, drawn to 0 as if `prior` more examples held it by chance."""
    n = [sum(x[1] == y for x in learn) for y in (0, 1)]
    seen = [np.bincount(np.searchsorted(terms, np.concatenate([x[2] for x in learn if x[1] == y])), minlength=len(terms)) for y in (0, 1)]
    rate = [(seen[y] + prior * n[y] / sum(n)) / (n[y] + prior * n[y] / sum(n)) for y in (0, 1)]
    return np.log(rate[1] / rate[0]) ** 2


def _index(terms: np.ndarray, idf: np.ndarray, learn: list, held: list, weight: dict, base: float, block: int, k: int) -> Index:
    index = Index(terms, idf, _telling(terms, learn), *(np.zeros(0, np.int64) for _ in range(8)), block, k)
    vectors = {x[0]: index.vector(x[2], x[3]) for x in learn + held}
    # Neighbouring examples share their class and their most telling term, so block maxima are tight.
    top = {d: int(i[np.argmax(w * index.telling[i])]) if len(i) else -1 for d, (i, w) in vectors.items()}
    learn = sorted(learn, key=lambda x: (x[1], top[x[0]], x[0]))
    index.ids, index.label = np.array([x[0] for x in learn], np.int64), np.array([x[1] for x in learn], float)
    term = np.concatenate([vectors[x[0]][0] for x in learn])
    example = np.repeat(np.arange(len(learn)), [len(vectors[x[0]][0]) for x in learn])
    weights = np.concatenate([vectors[x[0]][1] for x in learn])
    order = np.lexsort((example, term))
    term, example, weights = term[order], example[order], weights[order]
    new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (example[1:] // block != example[:-1] // block))))
    index.postings, index.weights, index.tells = example, weights, index.telling[term]
    index.lo, index.block_of = np.append(new, len(term)), example[new] // block
    index.many = np.diff(index.lo)
    index.cells, index.most = np.searchsorted(term[new], np.arange(len(terms) + 1)), np.maximum.reduceat(weights, new)
    index.damp = 0.3 * float(np.median([index.vote(*vectors[x[0]])[2] for x in held if len(vectors[x[0]][0])] or [1.0]))
    known = [x for x in held if len(vectors[x[0]][0])]
    blank = np.array([x[1] for x in held if not len(vectors[x[0]][0])])
    if known:
        votes, label = np.array([index.vote(*vectors[x[0]])[0] for x in known]), np.array([x[1] for x in known], float)
        index.xs, index.ys = _isotonic(votes, label, np.where(label == 1, weight[1], weight[0]))
    w = np.where(blank == 1, weight[1], weight[0])
    index.no_terms = float((w * blank).sum() / w.sum()) if len(blank) else base
    return index


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found = [index.score(text.as_py()) for text in batch.column(1)]
            scores = [x[0] for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([x[1] for x in found], pa.list_(pa.int64()))],
                                             names=["doc_id", *batch.schema.names[2:], "score", "predicted", "neighbours"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), **options) -> DataFrame:
    """One row per input row: doc_id, held_out, the columns to carry, score (0 to 1), predicted (1 from 0.5 on),
    neighbours (evidence: the ids of the nearest labelled examples, nearest first).

    docs needs doc_id and text, labels doc_id and toxic; other columns are ignored. held_out: crc32 of the id as text
    is divisible by 5; labels of such rows are never read. A text without a term of any example (a null or empty one
    too) gets the share of toxic documents among labelled ones of that kind (of all, if there are none). Without labels
    of both classes every score is the share of toxic labels (0 if there are none). A document labelled twice is toxic if either label says so;
    repeated rows get equal scores. Scores depend on the text alone. A carried column named like an output comes out
    with `_carried` after its name.
    """
    index = fit(bounded_batches(docs), labels, **options)
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by examples and example_chars
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_scored"), (fold(F.col("doc_id")) == 0).alias("held_out"), *carried(carry, OUTPUTS))
    extra = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[3:])
    return rows.mapInArrow(_score(shared), f"doc_id long, held_out boolean{extra}, score double, predicted int, neighbours array<bigint>")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("neighbours")


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE = {}
