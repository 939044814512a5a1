"""Operator 1, MinHash near-dedup: chosen-path set similarity join and near-duplicate classes.

Every document is a set of distinct shingles. Equal sets are first collapsed into one class representative. Each
representative carries a signature of minwise tokens. A number of independent trees then branch recursively: a node
chooses, by a hash of its own path, on average 1 / threshold positions of the signature, and a document goes to the
child named by its token at each chosen position. Two sets of similarity s share on average s / threshold children, so
similar pairs survive from level to level while others fall apart. Nodes of bounded size are compared exhaustively on
signatures and part into the components that likely pairs make; small components are then compared on their full
sets, and stars are kept that join the same documents as the links found. Trees repeat to reach the target recall; documents whose nodes are still large after
a further level, where a tree loses more, go through further trees.

Nodes that stay large (thousands of near copies never fall apart, as all their tokens agree) and large components are
dealt into blocks of bounded size, which are settled alone; after the links are joined into components, only different
components are compared, minority against all, block by block. No step lists all pairs of a group and no step holds a
whole group in one task.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACES, bounded_batches, cut, only_ids, raw_bytes, shared_dir, table, window_hashes, word_hashes, word_spans
from .graph import connected_components

#: Minwise tokens: 16 bits of each name children, 8 others estimate similarity. Trees share them, so there must be many:
#: with 16, a pair that agrees on few of them by chance is missed by all trees alike.
TOKENS = 256
SKETCH = "doc_id long, n_shingles long, digest binary, sig binary, bits long"
#: Nodes of so much mean agreement are not branched: on the way down to depth 12 their copies in all the trees would
#: cost as many comparisons as the node itself, block by block.
DENSE = 0.6
#: Tokens of which one further bit measures a node's mean agreement.
BITS = 64
_seeds = np.random.default_rng(7_2017)
_MUL = _seeds.integers(1, 1 << 63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _seeds.integers(0, 1 << 63, TOKENS, dtype=np.uint64)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles (of the whole sequence if it is shorter)."""
    raw = raw_bytes(text)
    starts, ends = word_spans(raw, SPACES)
    words = word_hashes(raw, starts, ends, fold=True)
    return np.unique(window_hashes(words, min(k, len(words)))) if len(words) else np.zeros(0, np.uint64)


def signature(items: np.ndarray) -> tuple[bytes, int]:
    """The minwise tokens, all of different hash functions: 16 bits of each, then 8 other bits of each; and one more
    bit of the first ones as a long."""
    best = np.full(TOKENS, np.uint64((1 << 64) - 1))
    for i in range(0, len(items), 1024):
        np.minimum(best, (items[None, i : i + 1024] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=best)
    bits = np.packbits((best[:BITS] >> np.uint64(19)).astype(np.uint8) & 1).view(np.int64)
    return (best >> np.uint64(28)).astype(np.uint16).tobytes() + (best >> np.uint64(20)).astype(np.uint8).tobytes(), int(bits[0])


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, digests, sigs, bits = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py(), k)
                ids.append(doc)
                counts.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) + struct.pack("<I", len(s)) if len(s) else None)
                sig, bit = signature(s) if len(s) else (None, None)
                sigs.append(sig)
                bits.append(bit)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bits, pa.int64())],
                                             names=["doc_id", "n_shingles", "digest", "sig", "bits"])

    return run


def _branch(rows: DataFrame, threshold: float) -> DataFrame:
    """(doc, sig, node) to the children of each node: one position, and a second, other one for the share of nodes that makes
    the mean 1 / threshold. Both are hashes of the node, so all its documents choose alike."""
    extra = int((1 / threshold - 1) * 10_000)
    first = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(TOKENS))
    second = F.when(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(10_000)) < extra, F.pmod(F.lit(1) + first + F.pmod(F.xxhash64("node", F.lit(3)), F.lit(TOKENS - 1)), F.lit(TOKENS)))
    at = F.explode(F.array_compact(F.array(first, second)))
    return rows.select("doc", "sig", "bits", "node", at.alias("at")).select(
        "doc", "sig", "bits", F.xxhash64("node", "at", F.expr("substring(sig, cast(2 * at + 1 as int), 2)")).alias("node"))


def _stars(a: np.ndarray, b: np.ndarray, doc: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Links (centre, doc) that join the same documents as the edges (a, b): each component that they make of the
    given ones gets its smallest document as the centre of a star over one document of each of these."""
    up = {x: x for x in comp.tolist()}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(comp[a].tolist(), comp[b].tolist()):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    first: dict[int, int] = {}
    for d, c in zip(doc.tolist(), comp.tolist()):
        first[c] = min(d, first.get(c, d))
    centre: dict[int, int] = {}
    for c, d in first.items():
        r = root(c)
        centre[r] = min(d, centre.get(r, d))
    return [(centre[root(c)], d) for c, d in first.items() if centre[root(c)] != d]


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each group of two or more; groups are neighbours and named by the first column."""
    held: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                if len(held) > 1:
                    yield held
                held = []
            held.append(row)
    if len(held) > 1:
        yield held


def _packed(items: Iterator[tuple], kinds: tuple, names: list[str], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for row in items:
        rows.append(row)
        if len(rows) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
            rows = []
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) if rows else [[]] * len(kinds), kinds)], names=names)


def _likely(sig: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others) for each row of byte tokens with later rows that agree with it on a share of `least` or more.

    A product of signs, one bit of each token, first leaves the pairs that may; where tokens differ, their signs agree
    by chance with a standard error below 1/32, so what it drops is more than six of these away.
    """
    n, tokens = sig.shape
    signs = (sig & 1).astype(np.float32) * 2 - 1
    for lo in range(0, n, 256):
        near = signs[lo : lo + 256] @ signs[lo:].T >= (least - 0.2) * tokens
        a, b = np.nonzero(np.triu(near, 1))
        ok = np.zeros(len(a), bool)
        for at in range(0, len(a), 65_536):
            same = sig[lo + a[at : at + 65_536]] == sig[lo + b[at : at + 65_536]]
            # Bytes add up in lanes of a word, 32 at most in each.
            ok[at : at + 65_536] = same.view(np.uint64).sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=1) >= least * tokens
        a, b = a[ok], b[ok]
        cuts = np.flatnonzero(np.diff(a)) + 1
        for rows, others in zip(np.split(a, cuts), np.split(b, cuts)):
            if len(rows):
                yield lo + int(rows[0]), lo + others


def _tokens(rows: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join(r[-1] for r in rows), np.uint8).reshape(len(rows), -1)


def _parted(least: float):
    """Of each group (g, doc, bytes) the components (g, doc, n), n documents each, that its likely pairs make."""
    def parts(groups: Iterator[list[tuple]]) -> Iterator[tuple]:
        for g in groups:
            label = np.arange(len(g))
            for i, others in _likely(_tokens(g), least):
                joined = np.unique(label[others])
                if len(joined) > 1 or joined[0] != label[i]:
                    label[np.isin(label, joined)] = label[i]
            _, label, n = np.unique(label, return_inverse=True, return_counts=True)
            name = [xxhash.xxh3_64_intdigest(struct.pack("<qq", g[0][0], c)) - (1 << 63) for c in range(len(n))]
            for row, c in zip(g, label.tolist()):
                if n[c] > 1:
                    yield name[c], row[1], int(n[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(parts(_by_group(batches)), (pa.int64(), pa.int64(), pa.int64()), ["g", "doc", "n"])

    return run


def _partnered(least: float):
    """Of each group (g, doc, comp, ask, bytes), the members with a partner: another component, one of the two asks,
    and an estimate of `least` or more."""
    def members(groups: Iterator[list[tuple]]) -> Iterator[tuple]:
        for g in groups:
            comp, ask = (np.array([r[i] for r in g]) for i in (2, 3))
            found = np.zeros(len(g), bool)
            for i, others in _likely(_tokens(g), least):
                others = others[(comp[others] != comp[i]) & (ask[others] | ask[i])]
                found[i] |= len(others) > 0
                found[others] = True
            for i in np.flatnonzero(found).tolist():
                yield g[i][:4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(members(_by_group(batches)), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), ["g", "doc", "comp", "ask"])

    return run


def _intersections(sets: list[np.ndarray], columns: int = 16_384) -> np.ndarray:
    """Sizes of all pairwise intersections: products of slices of the incidence matrix of shared items."""
    if len(sets) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[0, n], [n, 0]])
    items = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    new = np.concatenate(([True], items[1:] != items[:-1]))
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)))
    last = int(column.max(initial=-1)) + 1
    for lo in range(0, last, columns):
        part = (column >= lo) & (column < lo + columns)
        m = np.zeros((len(sets), min(columns, last - lo)), np.float32)
        m[owner[part], column[part] - lo] = 1
        out += m @ m.T
    return out


def _linked(k: int, percent: int):
    """Of each group (g, doc, comp, ask, text) stars that join what its links, confirmed on the full sets, join."""
    def links(groups: Iterator[list[tuple]]) -> Iterator[tuple]:
        for g in groups:
            doc, comp, ask = (np.array([r[i] for r in g]) for i in (1, 2, 3))
            sets = [shingles(r[4], k) for r in g]
            size = np.array([len(s) for s in sets])
            both = _intersections(sets)
            ok = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            a, b = np.nonzero(np.triu(ok & (comp[:, None] != comp[None, :]) & (ask[:, None] | ask[None, :]), 1))
            yield from _stars(a, b, doc, comp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(links(_by_group(batches)), (pa.int64(), pa.int64()), ["a", "b"])

    return run


def _by_node(groups: DataFrame, reps: DataFrame, *columns: str) -> DataFrame:
    """The members of each group together, with their byte tokens. No number of partitions is given, so that adaptive
    execution joins small ones."""
    estimates = reps.select("doc", F.expr(f"substring(sig, {2 * TOKENS + 1}, {TOKENS})").alias("bytes"))
    return groups.join(estimates, "doc").select("g", "doc", *columns, "bytes").repartition("g").sortWithinPartitions("g", "doc")


def _once(groups: DataFrame, *columns: str) -> DataFrame:
    """Of groups with the same rows, one."""
    same = groups.groupBy("g").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("doc", *columns)).alias("x"), F.bit_xor(F.xxhash64("doc", *columns, F.lit(1))).alias("y"))
    return groups.join(same.groupBy("k", "x", "y").agg(F.min("g").alias("g")).select("g"), "g", "left_semi")


def _partners(groups: DataFrame, reps: DataFrame, folder: str, least: float) -> DataFrame:
    """The members of each group (g, doc, comp, ask) that have a likely partner, equal groups once."""
    left = _by_node(groups, reps, "comp", "ask").mapInArrow(_partnered(least), "g long, doc long, comp long, ask boolean")
    return _once(cut(left, folder, "partnered"), "ask")


def _links(groups: DataFrame, docs: DataFrame, folder: str, k: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join the components of each group (g, doc, comp, ask) as all its links would. Texts
    travel once for each group that a document is in; pairs never travel."""
    groups = cut(groups, folder, "asked")
    ids = groups.select(F.col("doc").alias("doc_id")).distinct()
    texts = only_ids(docs.select("doc_id", "text"), ids, "doc_id", ids.count()).select(F.col("doc_id").alias("doc"), "text")
    dealt = groups.join(texts, "doc").select("g", "doc", "comp", "ask", "text").repartition("g").sortWithinPartitions("g", "doc")
    return cut(dealt.mapInArrow(_linked(k, percent), "a long, b long"), folder, "links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 85, trees: int = 10, node_limit: int = 4000, group_limit: int = 400,
                    depths: tuple[int, int] = (2, 12), slack: float = 0.10, deep_trees: int = 18) -> DataFrame:
    """One row per document id: doc_id, n_shingles, rep (smallest id with the same set), component_id, kept.

    docs needs doc_id (long) and text; other columns are ignored, so clashing names do no harm. Words are runs of
    anything but ASCII white space, A-Z in lower case. A set has the distinct k-word shingles; a text of fewer words
    has one shingle, its whole sequence; a null or empty text has none and links with nothing. Two sets link if
    100 * intersection >= percent * union, which is confirmed on full sets of 64-bit shingle hashes. component_id is
    the smallest doc_id reachable over links, kept is doc_id = component_id. Rows that repeat a doc_id count once,
    with the smallest of their texts; rows without a doc_id are left out. An empty table gives an empty result.

    Nodes are first compared at depth depths[0], where a token shared by chance or by one common passage is not
    enough. Up to node_limit members meet on signatures in one task (3 MB); larger nodes branch on, unless their members
    agree on DENSE of their tokens in the mean, down to depths[1]. Members of nodes that branch on at depth depths[0] + 1
    go through deep_trees further trees among themselves. No more than group_limit documents meet on their full sets in
    one task. Recall: given that a pair
    agrees on m of the 256 tokens, trees miss it independently, so its miss is the mean over the binomial m of (1 -
    survival) ** trees. At the threshold of 0.85 (0.80) 10 trees miss 8e-7 (5e-6) at depth 2 and 1.4e-5 (6e-5) at depth
    3; 28 trees miss 3e-8 (4e-7) at depth 6, 1e-6 (1e-5) at depth 8 and 6e-5 (3e-4) at depth 12. Dense
    nodes, and those that depth depths[1] still leaves large, are settled exactly, by blocks; pairs that several of them
    share are settled in one. slack is what a
    signature's estimate may fall short of the threshold: 4.5 standard errors of 256 tokens.
    """
    spark = bounded_batches(docs).sparkSession
    folder = shared_dir(spark)
    threshold = percent / 100
    least = threshold - slack
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    sketch = cut(docs.mapInArrow(_sketch(k), SKETCH), folder, "sketch")
    if sketch.count() != sketch.select("doc_id").distinct().count():
        docs = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
        sketch = cut(docs.mapInArrow(_sketch(k), SKETCH), folder, "sketch-of-ids")
    one = sketch.select("doc_id", "digest", "n_shingles")
    reps = cut(sketch.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.first("bits").alias("bits")), folder, "reps")
    links = _tree_links(reps, docs, folder, k, percent, threshold, least, (trees, deep_trees), node_limit, group_limit, depths)
    comps = connected_components(links, f"{folder}/final")
    classes = reps.select("digest", F.col("doc").alias("rep")).join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("digest", "rep", F.coalesce("component", "rep").alias("component"))
    out = one.join(classes, "digest", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("component", "doc_id").alias("component_id"),
                      (F.col("doc_id") == F.coalesce("component", "doc_id")).alias("kept"))


def _agreement(large: DataFrame) -> DataFrame:
    """(node, agree): the share of its pairs that agree on a token, in the mean. The square of a sum of signs, one by
    token, estimates the number of agreeing pairs without listing them, so sums by node are all that is shuffled."""
    n = F.count("*").cast("double")
    return large.groupBy("node").agg(sum((F.pow((2 * F.sum(F.shiftright("bits", i).bitwiseAND(1)) - n) / n, 2) for i in range(BITS)), F.lit(0.0)).alias("agree")).withColumn("agree", F.col("agree") / BITS)


def _descend(reps: DataFrame, folder: str, trees: range, threshold: float, limit: int, depths: tuple[int, int]) -> tuple[list, list, DataFrame | None]:
    """(groups, heavy, deep) of the trees: groups are tables (g, doc) of small nodes, heavy tables (g, doc, n) of large
    ones that do not branch on; deep has the documents that branch on a level after the first comparison."""
    roots = F.explode(F.array(*(F.xxhash64(F.lit(f"tree {i}")) for i in trees))).alias("node")
    members = reps.select("doc", "sig", "bits", roots)
    for _ in range(depths[0] - 1):
        members = _branch(members, threshold)
    members = _branch(members, threshold).drop("sig")
    groups, heavy, deep = [], [], None
    for depth in range(depths[0], depths[1] + 1):
        members = cut(members, folder, f"depth-{depth}")
        nodes = members.groupBy("node").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"),
                                            F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")).filter("n > 1")
        nodes = cut(nodes, folder, f"nodes-{depth}")
        # Trees often make the same node; it is settled once, but branches on in each of them.
        small = nodes.filter(F.col("n") <= limit).groupBy("n", "x", "y").agg(F.min("node").alias("node"))
        groups.append(members.join(small.select("node"), "node").select(F.col("node").alias("g"), "doc"))
        large = members.join(nodes.filter(F.col("n") > limit).select("node", "n"), "node")
        stays = _agreement(large).select("node", (F.col("agree") >= DENSE if depth < depths[1] else F.lit(True)).alias("stays"))
        twin = F.min("node").over(Window.partitionBy("n", "x", "y"))
        stays = nodes.join(stays, "node").withColumn("twin", twin).filter("node = twin or not stays").select("node", "n", "stays")
        # A row for each large node, so few that what is left to do is known without reading the members again.
        stays = cut(stays, folder, f"large-{depth}")
        branches, ends = (stays.agg(F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).alias("k")) for c in (~F.col("stays"), F.col("stays")))
        branches, ends = branches.first()["k"], ends.first()["k"]
        if ends:
            heavy.append(members.join(stays.filter("stays").select("node", "n"), "node").select(F.col("node").alias("g"), "doc", "n"))
        if not branches:
            break
        large = members.join(stays.filter("not stays").select("node"), "node").select("doc", "node")
        if depth == depths[0] + 1:
            deep = large.select("doc").distinct()
        members = _branch(large.join(reps, "doc").select("doc", "sig", "bits", "node"), threshold).drop("sig")
    return groups, heavy, deep


def _tree_links(reps, docs, folder, k, percent, threshold, least, trees, node_limit, limit, depths) -> DataFrame:
    groups, heavy, deep = _descend(reps, folder, range(trees[0]), threshold, node_limit, depths)
    if deep is not None and trees[1]:
        # A pair of two such documents may have been lost further down; any other pair is settled by the first trees.
        some = cut(reps.join(deep, "doc", "left_semi"), folder, "deep")
        more, dense, _ = _descend(some, f"{folder}/deeper", range(trees[0], sum(trees)), threshold, node_limit, depths)
        groups, heavy = groups + more, heavy + dense
    # Nodes fall apart into the components of their likely pairs. Those of bounded size are settled at once; larger
    # ones, like nodes that could not be compared, within blocks.
    every = _by_node(reduce(DataFrame.unionByName, groups).select("g", "doc"), reps)
    parts = cut(_once(cut(every.mapInArrow(_parted(least), "g long, doc long, n long"), folder, "parts")), folder, "groups")
    asked = parts.filter(F.col("n") <= limit).select("g", "doc", F.col("doc").alias("comp"), F.lit(True).alias("ask"))
    crowds = parts.filter(F.col("n") > limit)
    if heavy or not crowds.isEmpty():
        heavy = cut(reduce(DataFrame.unionByName, [*heavy, crowds]), folder, "heavy")
        # Large nodes of different trees hold much the same documents. Each document is at home in the largest of its
        # nodes and is settled there first.
        home = heavy.groupBy("doc").agg(F.max(F.struct("n", "g"))["g"].alias("home"))
        heavy = cut(heavy.join(home, "doc"), folder, "homes")
        at_home = heavy.filter("g = home")

    def blocks(turn: int) -> F.Column:
        return F.xxhash64("g", F.lit(turn), F.pmod(F.xxhash64("doc", F.lit(turn)), F.ceil(F.col("n") / limit))).alias("g")

    # Blocks are settled first; then they are dealt anew among nodes that still hold several components, and at last
    # what lies outside a node's largest component, or its members' commonest home, meets all of the node.
    if heavy:
        first = at_home.select(blocks(0), "doc", F.col("doc").alias("comp"), F.lit(True).alias("ask"))
        asked = asked.unionByName(_partners(first, reps, f"{folder}/turn-0", least))
    links = _links(asked, docs, f"{folder}/turn-0", k, percent)
    for turn, rows in ((1, at_home), (2, heavy)) if heavy else ():
        comps = connected_components(links, f"{folder}/components-{turn}").withColumnRenamed("node", "doc")
        now = rows.join(comps, "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
        mixed = now.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("g")
        now = cut(now.join(mixed, "g", "left_semi"), folder, f"mixed-{turn}")
        if now.isEmpty():
            continue
        dealt = _minority(now, limit) if turn == 2 else now.select(blocks(turn), "doc", "comp", F.lit(True).alias("ask"))
        asked = _partners(dealt, reps, f"{folder}/turn-{turn}", least)
        links = links.unionByName(_links(asked, docs, f"{folder}/turn-{turn}", k, percent))
    return links


def _minority(heavy: DataFrame, limit: int) -> DataFrame:
    """Blocks of the members (g, doc, comp, home) that ask, each against each block of all members of their node.

    Those outside the node's largest component ask, or those whose home isn't the commonest one of its members, if they
    are fewer: pairs with both at that home meet there. A node that is itself its members' commonest home asks by
    component.
    """
    def commonest(by: str) -> DataFrame:
        n = heavy.groupBy("g", by).agg(F.count("*").alias("n"))
        return n.groupBy("g").agg(F.max_by(by, F.struct("n", by)).alias(f"most_{by}"), F.sum("n").alias("n"), F.max("n").alias(f"n_{by}"))

    told = commonest("comp").join(commonest("home").drop("n"), "g").withColumn("by_home", F.expr("most_home <> g and n_home > n_comp"))
    told = told.withColumn("chunks", F.ceil((F.col("n") - F.expr("if(by_home, n_home, n_comp)")) / limit)).withColumn("blocks", F.ceil(F.col("n") / limit)).filter("chunks > 0")
    rows = heavy.drop("n").join(told, "g")
    asks = rows.filter("if(by_home, home <> most_home, comp <> most_comp)").withColumn("i", F.pmod(F.xxhash64("doc"), F.col("chunks")))
    asks = asks.select("g", "doc", "comp", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("ask"))
    others = rows.withColumn("j", F.pmod(F.xxhash64("doc", F.lit(5)), F.col("blocks"))).select("g", "doc", "comp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), "j", F.lit(False).alias("ask"))
    return asks.unionByName(others).groupBy(F.xxhash64("g", "i", "j").alias("g"), "doc", "comp").agg(F.max("ask").alias("ask"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("rep")


QUERIES = {"op1_near_dedup": op1_near_dedup}
_SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, list_aggregate(w[i:i+4], 'string_agg', ' ') as g from (select doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (select a.doc_id as a, b.doc_id as b from s a join s b using (g) join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id where a.doc_id <> b.doc_id
      group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r as (select doc_id, doc_id as c from w union select l.b, r.c from r join l on l.a = r.doc_id),
c as (select doc_id, min(c) as component_id from r group by doc_id)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from c left join n using (doc_id)
"""
ORACLE = {"op1_near_dedup": _SQL}
