"""Operator 11, cross-tokenizer alignment: ids of two tokenizers over the same bytes, linked where both end.

A text is cut before its white space into segments that neither tokenizer joins across (this is checked against the
pieces of both), so a segment's tokens are the same in every text and are aligned once per worker: the ends of A's and
B's tokens are dictionaries from end to index, the sorted common keys slice both lists of ids into groups, and each
slice is expanded into links. A document is the sum of its segments; one with a segment whose bytes a tokenizer alters
is encoded whole.

Documents are dealt with in blocks of bounded text within their task. A block asks once for each of its distinct id
pairs, so a pair of very common words costs one row a block, not one a document; the counts come back to the block
with its documents, which hold places in the block's list of pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, carried, cut, shared_dir, table
from .token_counts import PATTERN

#: Vocabularies, on a path that every worker can read.
BYTE_BPE, PIECE_BPE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: White space as the byte-level tokenizer's pattern has it (Unicode's property White_Space, fixed values).
SPACE = r"\t-\r \x85\xa0  -     　"
_AFTER = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
#: A pair of ids is a * PAIR + b.
PAIR = 1 << 32
#: Code points of a block, segments that a worker remembers for long, and the longest one that it does.
BLOCK_CHARS, KNOWN, KNOWN_CHARS = 700_000, 60_000, 64
#: A group with more links than this is expanded from its distinct ids.
LARGE_GROUP = 4096


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers: ids of texts with a space before them, and the bytes of each id."""

    def __init__(self, byte_bpe: str, piece_bpe: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of each worker would take time and memory of the others
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(byte_bpe), sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # A segment ends before white space that no piece of B has after anything else (A's pattern never joins across
        # any), and line breaks are in no piece.
        self.a_sizes, self.b_sizes = np.array([*map(len, self.a_bytes)]), np.array([*map(len, self.b_bytes)])
        # An id as text with what follows it inside a group, and at its end.
        self.a_text = np.array([f"{i}{x}" for i in range(len(self.a_bytes)) for x in ",|"], object)
        self.b_text = np.array([f"{i}{x}" for i in range(len(self.b_bytes)) for x in ",;"], object)
        kept = [p.replace("▁", " ") for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        glue = "".join(sorted({c for p in kept for c in _AFTER.findall(p)}))
        more = f"(?:[{re.escape(glue)}][{SPACE}]*[^{SPACE}]*)*" if glue else ""
        self.segment = re.compile(f"[{SPACE}]*[^{SPACE}]+{more}|[{SPACE}]+")
        written = json.loads(self.a.to_str())
        byte_level = written["pre_tokenizer"] or {}
        self.ranked = self._ranked(written, vocabulary) if byte_level.get("use_regex", True) and byte_level.get("type") == "ByteLevel" and not byte_level.get("add_prefix_space") and not written["normalizer"] else None
        if self.ranked is not None:
            self.a = None
        self.apart = byte_level.get("type") == "ByteLevel" and byte_level.get("use_regex", True) and not any("\n" in p for p in kept)

    def _ranked(self, written: dict, vocabulary: dict[str, int]):
        """The same tokenizer by ranks, which returns plain lists: only where ids rise in the order of the merges."""
        import tiktoken

        special = {t["id"] for t in written["added_tokens"]}
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" ", 1))] for m in written["model"]["merges"]]
        ranks = {self.a_bytes[i]: i for i in vocabulary.values() if i not in special}
        if merged != sorted(merged) or len(merged) + 256 != len(ranks) or max(ranks[bytes([b])] for b in range(256)) >= min(merged, default=256):
            return None
        return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        if self.ranked is not None:
            return [self.ranked.encode_ordinary(t) for t in texts]
        some = (self.a.encode_batch_fast(texts[k : k + 500], add_special_tokens=False) for k in range(0, len(texts), 500))
        return [e.ids for x in some for e in x]

    def ids_b(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments. The model puts a space before each text: it stands for a segment's own first space, or is cut off with a line break after it."""
        asked = [s[1:] + "\n" if s[0] == " " else "\n" + s for s in segments]
        return [x[:-1] if s[0] == " " else x[2:] for s, x in zip(segments, self.b.encode(asked, num_threads=1), strict=True)]

    def exact(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = text.encode()
        return b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Segments:
    """Segments aligned so far. Of each: its numbers of A tokens, B tokens, groups and links (sizes), whether its bytes are
    exact, how often it was asked for, its groups as text, and its pairs with their times, from start to the next start."""

    def __init__(self, tok: Tokenizers) -> None:
        self.tok, self.place, self.text, self.passing = tok, {}, [], []
        self.sizes, self.exact, self.used = np.zeros((0, 4), np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
        self.start, self.pairs, self.times = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, texts: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> None:
        """Aligns texts, laid end to end: as each ends with a token of both tokenizers, no group crosses from one to the next."""
        tok = self.tok
        exact = np.ones(len(texts), bool)
        if not tok.exact("".join(texts), [i for x in ids_a for i in x], [i for x in ids_b for i in x]):
            exact = np.array([tok.exact(*x) for x in zip(texts, ids_a, ids_b, strict=True)], bool)
            ids_a, ids_b = ([x if ok else [] for x, ok in zip(ids, exact, strict=True)] for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(texts)) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        at_a = dict(zip(np.cumsum(tok.a_sizes[a]).tolist(), range(1, len(a) + 1), strict=True))
        at_b = dict(zip(np.cumsum(tok.b_sizes[b]).tolist(), range(1, len(b) + 1), strict=True))
        common = sorted(at_a.keys() & at_b.keys())
        end_a, end_b = (np.array([0, *map(at.__getitem__, common)], np.int64) for at in (at_a, at_b))
        wide_a, wide_b, groups = np.diff(end_a), np.diff(end_b), np.arange(len(common))
        # Each A id of a slice with each B id of it, in a row; a large slice is expanded from its distinct ids.
        many = wide_a * wide_b
        made = np.where(many <= LARGE_GROUP, many, 0)
        group, k = np.repeat(groups, made), _ranges(np.zeros(len(made), np.int64), made)
        pairs, times = a[end_a[group] + k // wide_b[group]] * PAIR + b[end_b[group] + k % wide_b[group]], np.ones(len(group), np.int64)
        large = np.flatnonzero(many > LARGE_GROUP).tolist()
        for g in large:
            (x, p), (y, q) = (np.unique(ids[e[g] : e[g + 1]], return_counts=True) for ids, e in ((a, end_a), (b, end_b)))
            pairs, times = np.append(pairs, (x[:, None] * PAIR + y).ravel()), np.append(times, np.outer(p, q).ravel())
            group = np.append(group, np.full(len(x) * len(y), g))
        if large:
            order = np.argsort(group, kind="stable")
            pairs, times, group = pairs[order], times[order], group[order]
        # The ids as text in the order of the groups, each with what follows it.
        last_a, last_b, said = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), np.zeros(len(a) + len(b), object)
        last_a[end_a[1:] - 1], last_b[end_b[1:] - 1] = 1, 1
        said[np.arange(len(a)) + end_b[np.repeat(groups, wide_a)]] = tok.a_text[a * 2 + last_a]
        said[np.arange(len(b)) + end_a[np.repeat(groups, wide_b) + 1]] = tok.b_text[b * 2 + last_b]
        ends, said = np.cumsum(n_a + n_b).tolist(), said.tolist()
        self.text += ["".join(said[i:j])[:-1] for i, j in zip([0, *ends], ends, strict=False)]
        segment = np.searchsorted(np.cumsum(n_a), end_a[1:], "left")
        total = lambda x: np.bincount(segment, x, len(texts)).astype(np.int64)
        kept = total(np.bincount(group, minlength=len(groups)))
        for name, new in (("sizes", np.stack([n_a, n_b, total(None), total(many)], axis=1)), ("exact", exact), ("used", np.zeros(len(texts), np.int64)),
                          ("start", self.start[-1] + np.cumsum(kept)), ("pairs", pairs), ("times", times)):
            setattr(self, name, np.concatenate([getattr(self, name), new]))

    def learn(self, segments: list[str]) -> None:
        """Aligns the new segments of a block: first those to remember, then long ones, which the block's end forgets."""
        new = list(dict.fromkeys(s for s in segments if s not in self.place))
        self.passing = [s for s in new if len(s) > KNOWN_CHARS]
        for some in ([s for s in new if len(s) <= KNOWN_CHARS], self.passing):
            if some:
                self.place.update(zip(some, range(len(self.text), len(self.text) + len(some)), strict=True))
                self.add(some, self.tok.ids_a(some), self.tok.ids_b(some))

    def whole(self, text: str) -> np.ndarray:
        """The place of a text taken whole, like a segment that the block's end forgets."""
        self.add([text], self.tok.ids_a([text]), [self.tok.b.encode(text[1:])])
        return np.array([len(self.text) - 1])

    def of(self, text: str, cut_up: list[str]) -> np.ndarray:
        """The places of a text's segments."""
        if self.tok.apart:
            at = np.fromiter(map(self.place.__getitem__, cut_up), np.int64, len(cut_up))
            if self.exact[at].all():
                return at
        return self.whole(text)

    def links(self, own: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of segments that occur so often, and their times."""
        lengths = self.start[own + 1] - self.start[own]
        at = _ranges(self.start[own], lengths)
        unique, inverse = np.unique(self.pairs[at], return_inverse=True)
        return unique, np.bincount(inverse, self.times[at] * np.repeat(often, lengths), len(unique)).astype(np.int64)

    def end_block(self) -> None:
        """Forgets long segments and whole texts, and where more than twice KNOWN are left, all but the KNOWN most used."""
        for s in self.passing:
            del self.place[s]
        n = len(self.place)
        if n > 2 * KNOWN:
            kept = np.sort(np.argsort(-self.used[:n], kind="stable")[:KNOWN])
            names = list(self.place)
            self.place = {names[i]: k for k, i in enumerate(kept.tolist())}
            self.used //= 2
        elif n < len(self.text):
            kept = np.arange(n)
        else:
            return
        lengths = self.start[kept + 1] - self.start[kept]
        at = _ranges(self.start[kept], lengths)
        self.pairs, self.times, self.start = self.pairs[at], self.times[at], np.concatenate([[0], np.cumsum(lengths)])
        self.sizes, self.exact, self.used, self.text, self.passing = self.sizes[kept], self.exact[kept], self.used[kept], [self.text[i] for i in kept.tolist()], []


_DOC = "block long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, at array<int>, times array<long>, pairs array<long>, docs array<int>"
_loaded: dict[tuple[str, str], Segments] = {}


def _encode(column: str, names: list[str], byte_bpe: str, piece_bpe: str, keep_groups: bool, block_chars: int):
    """Batches of documents to one row each, with the links as places in the pairs of their block, and one row for each block's pairs."""
    def block(number: int, texts: list[str | None], known: Segments) -> tuple[dict, list[int]]:
        cut_up = [known.tok.segment.findall(" " + t) if t else [] for t in texts]
        if known.tok.apart:
            known.learn([s for c in cut_up for s in c])
        out: dict[str, list] = {k: [] for k in ("n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256")}
        found, held = [], []
        for t, c in zip(texts, cut_up, strict=True):
            places = known.of(" " + t, c) if t else np.zeros(0, np.int64)
            total = known.sizes[places].sum(axis=0).tolist()
            text = ";".join([known.text[i] for i in places.tolist()]) if total[0] else ""
            for k, v in zip(("n_a", "n_b", "n_groups", "n_links"), total, strict=True):
                out[k].append(v)
            out["groups"].append(text if keep_groups else None)
            out["groups_sha256"].append(hashlib.sha256(text.encode()).hexdigest() if text else "")
            own, often = np.unique(places, return_counts=True)
            known.used[own] += often
            unique, times = known.links(own, often)
            found.append(unique)
            held.append(times)
        pairs, inverse, docs = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
        ends = np.cumsum([0, *map(len, found)])
        out |= {"at": [inverse[ends[k] : ends[k + 1]].astype(np.int32) for k in range(len(texts))], "times": held, "block": [number] * len(texts)}
        return out, [pairs, docs.astype(np.int32)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (byte_bpe, piece_bpe) not in _loaded:
            _loaded[byte_bpe, piece_bpe] = Segments(Tokenizers(byte_bpe, piece_bpe))
        known = _loaded[byte_bpe, piece_bpe]
        first, done = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            start = 0
            while start < len(texts):
                end, chars = start, 0
                while end < len(texts) and (end == start or chars + len(texts[end] or "") <= block_chars):
                    chars += len(texts[end] or "")
                    end += 1
                out, (pairs, docs) = block(first + done, texts[start:end], known)
                kinds = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "groups_sha256": pa.string(), "at": pa.list_(pa.int32()), "times": pa.list_(pa.int64())}
                rows = batch.slice(start, end - start)
                nothing = [None] * (end - start)
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in names), pa.array(out["block"], pa.int64()), *(pa.array(out[k], t) for k, t in kinds.items()), pa.array(nothing, pa.list_(pa.int64())), pa.array(nothing, pa.list_(pa.int32()))], [*names, "block", *kinds, "pairs", "docs"])
                if len(pairs):
                    kept = [pa.nulls(1, rows.column(rows.schema.get_field_index(c)).type) for c in names]
                    yield pa.RecordBatch.from_arrays([*kept, pa.array([first + done], pa.int64()), *(pa.nulls(1, t) for t in kinds.values()), pa.array([pairs], pa.list_(pa.int64())), pa.array([docs], pa.list_(pa.int32()))], [*names, "block", *kinds, "pairs", "docs"])
                known.end_block()
                start, done = end, done + 1

    return run


def align_tokens(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, text: str = "text", carry: tuple[str, ...] = ("doc_id",),
                 keep_groups: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per input row: carried columns, n_a, n_b, n_groups, n_links, n_best, count_sum, groups and groups_sha256.

    A is a byte-level tokenizer (tokenizers' JSON) over a space and the text, B a sentencepiece model over the text.
    Groups lie between the byte offsets where tokens of both end; a link is an A token and a B token of one group.
    A pair's count is the number of rows of docs that link it, repeated rows each counted. n_best counts the links whose
    pair has the highest count of all pairs of its A id, ties included; count_sum sums the counts over all links.
    groups is `a1,a2|b1;a3|b2` in order (null unless keep_groups), groups_sha256 its digest. Texts that are null, empty,
    or altered by either tokenizer (joined bytes differ) have zeros and empty texts. A text of any length is one row of
    a block. A carried column named like an output gets `_carried` after its name. Empty tables give empty results.
    """
    folder = shared_dir(docs.sparkSession)
    outputs = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "groups_sha256", "block", "at", "times", "pairs", "docs")
    kept = carried(carry, outputs)
    names = docs.select(*kept).columns
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)
    read = bounded_batches(docs.select(*kept, F.col(text).alias("tessaria_text")))
    encoded = cut(read.mapInArrow(_encode("tessaria_text", names, byte_bpe, piece_bpe, keep_groups, block_chars), f"{ddl}, {_DOC}"), folder, "encoded")
    asked = encoded.filter("pairs is not null").select(F.col("block").alias("asker"), F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "x")).select("asker", "at", "x.pairs", "x.docs")
    counts = asked.groupBy("pairs").agg(F.sum("docs").alias("count")).withColumn("a", F.expr(f"pairs div {PAIR}"))
    counts = cut(counts, folder, "counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    judged = counts.join(most, "a").select("pairs", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.drop("docs").join(judged, "pairs").select("asker", "at", "count", "best")
    rows = encoded.filter("pairs is null").drop("pairs", "docs")

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        left, count, best = left.combine_chunks(), np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        count[right["at"].to_numpy()], best[right["at"].to_numpy()] = right["count"].to_numpy(), right["best"].to_numpy().astype(np.int64)
        at, times = left["at"].combine_chunks(), left["times"].combine_chunks()
        place, often = at.flatten().to_numpy(), times.flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        sums = [np.concatenate([[0], np.cumsum(x[place] * often)]) for x in (best, count)]
        n_best, count_sum = (x[ends[1:]] - x[ends[:-1]] for x in sums)
        return pa.table({**{c: left[c] for c in names}, **{c: left[c] for c in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": n_best, "count_sum": count_sum, "groups": left["groups"], "groups_sha256": left["groups_sha256"]})

    out = f"{ddl}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string, groups_sha256 string"
    return rows.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(total, out)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), keep_groups=False).drop("groups")


QUERIES = {"op11_alignment": op11_alignment}
#: SQL has no tokenizers; tests compare with a brute-force version.
ORACLE: dict[str, str] = {}
