"""Operator 2, token counts that follow edits.

A byte-pair encoder never merges across the pieces of its pre-token pattern, and a single space between two
characters that are not white space always starts a piece. Texts are cut there into atoms of whole pre-tokens. A
document keeps a segment tree: its leaves are runs of atoms with their number of characters, pre-tokens and tokens,
and every inner node the sum of its children. An edit replaces a span of characters. Only the leaves that the span or
the two characters before it touch, and the leaf of the character behind it, are cut and encoded again; the borders
around them stay borders, as the characters that make them so are unchanged. Updated sums rise to the root.

Trees are kept: token_trees() makes a table of documents with the leaves of their trees, apply_edits() takes such a
table with edits and returns the edited texts with their leaves, ready for the next edits, beside the counts.

Distinct atoms are few, so a task cuts and encodes each once and keeps its counts.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, cut, shared_dir, table

#: The pre-token pattern of the byte-level vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A border depends on the character before it, the space itself and the one behind it.
LOOK = 2
LEAF = 64


def atoms(text: str) -> list[str]:
    """The text cut before every single space that stands between two characters that are not white space."""
    parts = text.split(" ")
    if not any(not p or p[0].isspace() or p[-1].isspace() for p in parts):
        return [parts[0], *[" " + p for p in parts[1:]]]
    out, open_ = [parts[0]], not parts[0] or parts[0][-1].isspace()
    for p in parts[1:]:
        if open_ or not p or p[0].isspace():
            out[-1] += " " + p
        else:
            out.append(" " + p)
        open_ = not p or p[-1].isspace()
    return out if out != [""] else []


class Counter:
    """(pre-tokens, tokens) of atoms, each distinct one encoded once (what is known is forgotten when it grows large)."""

    def __init__(self, vocabulary: str, most: int = 200_000) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, tuple[int, int]] = {}
        self.most = most

    def __call__(self, pieces: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        try:
            return np.array([known[p] for p in pieces], np.int64).reshape(-1, 2)
        except KeyError:
            for p in set(pieces):
                if p not in known:
                    known[p] = (len(self.pattern.findall(p)), len(self.encoding.encode_ordinary(p)))
            return np.array([known[p] for p in pieces], np.int64).reshape(-1, 2)


_counters: dict[str, Counter] = {}


def counter(vocabulary: str) -> Counter:
    """One counter per worker and vocabulary."""
    if vocabulary not in _counters:
        _counters[vocabulary] = Counter(vocabulary)
    return _counters[vocabulary]


class SegmentTree:
    """Sums over leaves in heap order: node i has the children 2i and 2i + 1, leaf j is node size + j."""

    def __init__(self, leaves: np.ndarray) -> None:
        self.n = len(leaves)
        self.size = 1 << max(0, (self.n - 1).bit_length())
        self.nodes = np.zeros((2 * self.size, leaves.shape[1] if leaves.ndim > 1 else 3), np.int64)
        self.nodes[self.size : self.size + self.n] = leaves
        level = self.size
        while level > 1:
            level //= 2
            self.nodes[level : 2 * level] = self.nodes[2 * level : 4 * level : 2] + self.nodes[2 * level + 1 : 4 * level : 2]

    @property
    def total(self) -> np.ndarray:
        return self.nodes[1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last one for the end of the text), and where it starts."""
        i, start = 1, 0
        at = min(at, int(self.nodes[1, 0]) - 1)
        while i < self.size:
            i *= 2
            if at >= start + self.nodes[i, 0]:
                start += int(self.nodes[i, 0])
                i += 1
        return i - self.size, start

    def put(self, leaf: int, row: tuple[int, int, int]) -> None:
        i = self.size + leaf
        change = np.array(row) - self.nodes[i]
        while i:
            self.nodes[i] += change
            i //= 2


def leaves_of(pieces: list[str], count: Callable[[list[str]], np.ndarray]) -> np.ndarray:
    """(characters, pre-tokens, tokens) of each run of LEAF atoms."""
    if not pieces:
        return np.zeros((0, 3), np.int64)
    rows = np.column_stack([np.fromiter(map(len, pieces), np.int64, len(pieces)), count(pieces)])
    return np.add.reduceat(rows, np.arange(0, len(pieces), LEAF), axis=0)


def build(text: str, count: Callable[[list[str]], np.ndarray]) -> SegmentTree:
    leaves = leaves_of(atoms(text) if text else [], count)
    return SegmentTree(leaves if len(leaves) else np.zeros((1, 3), np.int64))


def edit(tree: SegmentTree, text: str, start: int, end: int, put: str, count: Callable[[list[str]], np.ndarray]) -> tuple[SegmentTree, str, int]:
    """Replaces text[start:end]; returns the tree, the new text and how many atoms were encoded again.

    The first touched leaf takes over the new atoms, the others become empty. Where it would grow beyond four leaves'
    worth for each leaf touched (a long insertion), the leaf row is laid out anew from the unchanged leaves and the
    new ones, without encoding the unchanged ones.
    """
    new = text[:start] + put + text[end:]
    if not text:
        fresh = build(new, count)
        return fresh, new, len(atoms(new)) if new else 0
    first, at = tree.find(max(0, start - LOOK))
    last, border = tree.find(end)
    border += int(tree.nodes[tree.size + last, 0])
    part = new[at : border + len(put) - (end - start)]
    pieces = atoms(part) if part else []
    if len(pieces) <= 4 * LEAF * (last - first + 1):
        tree.put(first, (len(part), *count(pieces).sum(axis=0).tolist()))
        for leaf in range(first + 1, last + 1):
            tree.put(leaf, (0, 0, 0))
        return tree, new, len(pieces)
    old = tree.nodes[tree.size : tree.size + tree.n]
    return SegmentTree(np.concatenate([old[:first], leaves_of(pieces, count), old[last + 1 :]])), new, len(pieces)


TREES = "doc_id long, text string, leaves binary"


def _plant(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            leaves = [leaves_of(atoms(t) if (t := text.as_py()) else [], count).astype(np.int32).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(leaves, pa.binary()), *batch.columns[2:]], names=["doc_id", "text", "leaves", *batch.schema.names[2:]])

    return run


def token_trees(docs: DataFrame, vocabulary: str = VOCABULARY, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, leaves) and the columns to carry: each document with the leaves of its segment tree, an int32 row
    (characters, pre-tokens, tokens) for each. A null or empty text has no leaves. vocabulary is a file of ranks that
    every worker can read at this path."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    extra = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return bounded_batches(rows).mapInArrow(_plant(vocabulary), TREES + extra)


def _follow(vocabulary: str, with_trees: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, leaves, edits in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                text = text.as_py() or ""
                kept = np.frombuffer(leaves or b"", np.int32).reshape(-1, 3).astype(np.int64)
                tree = SegmentTree(kept if len(kept) else np.zeros((1, 3), np.int64))
                before = tree.total.copy()
                again, done = 0, 0
                # Right to left, so an edit does not move the places of those to come; an overlapping one is cut short.
                limit = len(text)
                for e in sorted(edits.as_py() or [], key=lambda e: (-(e["start"] or 0), -(e["end"] or 0))):
                    start = min(max(0, e["start"] or 0), limit)
                    end = min(max(start, e["end"] or start), limit)
                    tree, text, n = edit(tree, text, start, end, e["put"] or "", count)
                    again, done, limit = again + n, done + 1, start
                rows.append((doc, int(before[1]), int(before[2]), done, again, int(tree.total[1]), int(tree.total[2])))
                if with_trees:
                    now = tree.nodes[tree.size : tree.size + tree.n]
                    rows[-1] += (text, now[now[:, 0] > 0].astype(np.int32).tobytes())
            kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()] * with_trees
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) if rows else [[]] * 9, kinds)], names=[x.split()[0] for x in (COUNTS + ", text string, leaves binary" * with_trees).split(", ")])

    return run


COUNTS = "doc_id long, n_pre_tokens long, n_tokens long, n_edits long, n_encoded_again long, n_pre_tokens_after long, n_tokens_after long"


def apply_edits(trees: DataFrame, vocabulary: str = VOCABULARY, with_trees: bool = True) -> DataFrame:
    """Token counts before and after edits, one row per input row, and if asked for the edited text and its leaves, so
    that the next edits go on from there.

    trees needs doc_id, text, the leaves that token_trees or an earlier call gave for that text, and edits, an array of
    struct<start int, end int, put string> in characters of the text (a null start is 0, a null end is start, a null
    put is empty; places beyond the text are its end; of overlapping edits the left one ends where the right one
    starts; null or empty: no edit). Other columns are ignored. Null text counts as empty. n_encoded_again is what the
    edits cost in atoms, against some n_pre_tokens_after for a full count. Special tokens' strings are ordinary text.
    """
    rows = trees.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "leaves", F.col("edits").cast("array<struct<start:int,end:int,put:string>>").alias("edits"))
    return bounded_batches(rows).mapInArrow(_follow(vocabulary, with_trees), COUNTS + ", text string, leaves binary" * with_trees)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token counts before and after edits of documents that have no trees yet: docs needs doc_id, text and edits. See
    apply_edits for what edits may be."""
    return apply_edits(token_trees(docs, vocabulary, carry=("edits",)), vocabulary, with_trees=False)


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs(doc_id, text) with edits(doc_id, start, end, put) gathered per document; edits of unknown ids are dropped."""
    by_doc = edits.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "put")).alias("edits"))
    return docs.select("doc_id", "text").join(by_doc, "doc_id", "left")


def line_edits(docs: DataFrame) -> DataFrame:
    """docs with the edits of a clean-up: the first line that repeats an earlier one goes, and the first number of 12
    digits or more is masked. Places come from built-in functions, in characters."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = docs.select("doc_id", "text", lines.alias("l"))
    # Lines sorted with their numbers: one that equals the line before it repeats an earlier one.
    rows = rows.withColumn("s", F.array_sort(F.filter(F.transform("l", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("i"))), lambda p: F.trim(p["x"]) != "")))
    pairs = F.arrays_zip(F.slice("s", 1, F.greatest(F.lit(0), F.size("s") - 1)).alias("a"), F.slice("s", 2, F.greatest(F.lit(0), F.size("s") - 1)).alias("b"))
    i = F.array_min(F.transform(F.filter(pairs, lambda p: p["a"]["x"] == p["b"]["x"]), lambda p: p["b"]["i"]))
    rows = rows.withColumn("i", F.coalesce(i, F.lit(0)).cast("int"))
    start = F.aggregate(F.slice("l", 1, F.greatest(F.lit(0), F.col("i") - 1)), F.lit(0), lambda a, x: a + F.length(x) + 1)
    again = F.when(F.col("i") > 0, F.struct(start.alias("start"), (start + F.length(F.try_element_at("l", F.col("i"))) + 1).cast("int").alias("end"), F.lit("").alias("put")))
    number = F.regexp_extract("text", r"[0-9]{12,}", 0)
    at = (F.instr("text", number) - 1).cast("int")
    mask = F.when(F.length(number) > 0, F.struct(at.alias("start"), (at + F.length(number)).cast("int").alias("end"), F.lit("<number>").alias("put")))
    return rows.select("doc_id", "text", F.array_compact(F.array(again, mask)).alias("edits"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Trees are planted and kept in a table, then a clean-up's edits are applied to what is kept.
    trees = cut(token_trees(line_edits(table(spark, sf_dir, "documents")), carry=("edits",)), shared_dir(spark), "trees")
    return apply_edits(trees, with_trees=False)


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE = {}
