"""Operator 10, mixing sources to target weights by temperature.

Every source's share of tokens is raised to an exponent and normalised: 1 keeps the sources' own shares, 0 makes all
sources equal. The exponent is bisected until the weights meet a target: an entropy, or a limit on how often any
source repeats under the budget. Each bisection step is an aggregate over the table of sources; the driver sees sums
only. Weights become budgets, and budgets become rows by block permutations: a source's documents fall into blocks by
a hash, every epoch orders the blocks anew, whole blocks are taken while they fit, and the block at the end is
filled document by document. Prefix sums run over hash ranges, blocks and one block's documents in turn, so no task
needs a whole source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shared_dir, table

OUTPUTS = ("doc_id", "source", "n_tokens", "epoch", "mix_order")
STEPS = 5  # halvings answered by one aggregate


def token_count(text: F.Column) -> F.Column:
    """White-space words of a text: the default token count."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit("\x09\x0a\x0b\x0c\x0d\x20"))
    return F.when(body == "", F.lit(0)).otherwise(F.regexp_count(body, F.lit(r"[\x20\x09-\x0D]+")) + 1).cast("long")


def _bisect(sources: DataFrame, measure, wanted: float, low: float = 0.0, high: float = 1.0, rounds: int = 8) -> float:
    """The largest exponent in [low, high] at which measure, which falls as the exponent falls, is at most wanted."""
    if measure(sources, [high])[0] <= wanted:
        return high
    for _ in range(rounds):
        n = 1 << STEPS
        at = [low + (high - low) * i / n for i in range(1, n)]
        good = [a for a, m in zip(at, measure(sources, at)) if m <= wanted]
        low = max(good, default=low)
        high = min([a for a in at if a > low], default=high)
    return low


def _sums(sources: DataFrame, at: list[float], terms: list) -> list[list[float]]:
    cols = [f(F.pow("share", F.lit(a)), a).alias(f"x{i}_{j}") for i, a in enumerate(at) for j, f in enumerate(terms)]
    row = sources.filter("share > 0").agg(*cols).first()
    return [[row[f"x{i}_{j}"] or 0.0 for j in range(len(terms))] for i in range(len(at))]


def _negative_entropy(sources: DataFrame, at: list[float]) -> list[float]:
    both = _sums(sources, at, [lambda p, a: F.sum(p), lambda p, a: F.sum(p * F.log("share"))])
    return [-(math.log(z) - a * s / z) if z else 0.0 for a, (z, s) in zip(at, both)]


def _repetition(budget: float, total: float):
    def measure(sources: DataFrame, at: list[float]) -> list[float]:
        both = _sums(sources, at, [lambda p, a: F.sum(p), lambda p, a: F.max(p / F.col("share"))])
        return [-(top / z * budget / total) if z else 0.0 for z, top in both]

    return measure


def source_weights(tokens: DataFrame, budget: int | None = None, entropy: float | None = None, max_repeat: float | None = None) -> tuple[DataFrame, float, int]:
    """(sources(source, docs, tokens, share, weight, budget), exponent, budget) for tokens(source, n_tokens).

    The target is an entropy in nats that the weights must reach (the largest exponent that does; more than the log
    of the number of sources gives exponent 0), or a limit on repetition: the smallest exponent at which no source is
    read more than max_repeat times (1 if even own shares exceed it).
    """
    sources = tokens.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens"))
    sources = cut(sources, shared_dir(tokens.sparkSession), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    sources = sources.withColumn("share", F.col("tokens") / F.lit(float(max(1, total))))
    if not total:
        exponent = 1.0
    elif entropy is not None:
        exponent = _bisect(sources, _negative_entropy_of(entropy), 0.0)
    else:
        exponent = _least_exponent(sources, _repetition(float(budget), float(total)), -(max_repeat if max_repeat is not None else 4.0))
    z = _sums(sources, [exponent], [lambda p, a: F.sum(p)])[0][0] or 1.0
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent)) / z).otherwise(0.0)
    return sources.withColumn("weight", weight).withColumn("budget", F.round(weight * budget).cast("long")), exponent, budget


def _negative_entropy_of(entropy: float):
    return lambda sources, at: [entropy + m for m in _negative_entropy(sources, at)]


def _least_exponent(sources: DataFrame, measure, wanted: float) -> float:
    """The smallest exponent in [0, 1] at which measure, which rises with it, is at least wanted."""
    if measure(sources, [0.0])[0] >= wanted:
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(8):
        n = 1 << STEPS
        at = [low + (high - low) * i / n for i in range(1, n)]
        good = [a for a, m in zip(at, measure(sources, at)) if m >= wanted]
        high = min(good, default=high)
        low = max([a for a in at if a < high], default=low)
    return high


def mix(docs: DataFrame, budget: int | None = None, entropy: float | None = None, max_repeat: float | None = None,
        tokens: str | None = None, block_docs: int = 512, seed: int = 17, carry: tuple[str, ...] = (), max_epochs: int = 1_000_000) -> DataFrame:
    """The mixed corpus: doc_id, source, n_tokens, epoch, mix_order, the columns to carry, one row per reading of a document.

    docs needs doc_id, text and source (null is a source of its own); tokens names a column with token counts, else
    white-space words are counted. The budget defaults to all tokens there are. A source's budget is its weight times
    the budget; it is filled epoch by epoch, each a fresh permutation of the source's blocks and of the documents
    within. Documents are read while the tokens read before them are below the budget, so a source exceeds its budget
    by less than one document. mix_order orders the corpus: a document's place in its source's budget, from 0 to 1, so
    sources are spread evenly; ties break by hash. Documents without tokens are read where they fall, once an epoch at
    most. Repeated rows, and rows without an id or with another row's id, are rows of their own and keep what they carry;
    a carried column named like an output comes out with `_carried` after its name. A target that would have a source
    read more than max_epochs times is an error. An empty table gives an empty result.
    """
    folder = shared_dir(docs.sparkSession)
    count = F.coalesce(F.col(tokens).cast("long"), F.lit(0)) if tokens else token_count(F.col("text"))
    # A row is known by a number of its own, as ids may be null or repeat; `tie` tells rows of one id apart by what they hold.
    names = [f"c{i}" for i in range(len(carry))]
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", count.alias("n_tokens"), F.xxhash64("text", *carry).alias("tie"),
                      F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)])
    whole = cut(row, folder, "tokens")
    slim = whole.drop(*names)
    sources, _, budget = source_weights(slim, budget, entropy, max_repeat)
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    sources = sources.withColumn("key", key).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs))).filter("budget > 0 and tokens > 0")
    most = sources.agg(F.max(F.col("budget") / F.col("tokens"))).first()[0] or 0.0
    if most > max_epochs:
        raise ValueError(f"a source would be read {most:.0f} times, max_epochs is {max_epochs}")
    keyed = slim.withColumn("key", key)
    # Documents to blocks: the number of blocks of a source comes by a salted join, as a source may hold a third of all rows.
    salts = 16
    side = sources.select("key", "blocks", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(salts)).cast("int")).join(side, ["key", "salt"]).drop("salt")
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), F.col("blocks")))
    keyed = cut(keyed.select("row", "doc_id", "source", "n_tokens", "tie", "key", "block"), folder, "blocks")
    blocks = keyed.groupBy("key", "block").agg(F.sum("n_tokens").alias("n"))
    # Each epoch orders the blocks by a hash; prefix sums first over ranges of the hash, then inside a range.
    epochs = sources.select("key", "budget", "tokens", F.explode(F.sequence(F.lit(0), F.ceil(F.col("budget") / F.col("tokens")).cast("int") - 1)).alias("epoch"))
    laid = blocks.join(epochs, "key").withColumn("h", F.xxhash64("key", "block", "epoch", F.lit(seed))).withColumn("range", F.shiftright("h", 56))
    ranges = laid.groupBy("key", "epoch", "range").agg(F.sum("n").alias("in_range"))
    earlier = Window.partitionBy("key").orderBy("epoch", "range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before_range", F.coalesce(F.sum("in_range").over(earlier), F.lit(0))).drop("in_range")
    inside = Window.partitionBy("key", "epoch", "range").orderBy("h", "block").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.join(ranges, ["key", "epoch", "range"]).withColumn("before", F.col("before_range") + F.coalesce(F.sum("n").over(inside), F.lit(0))).filter("before < budget")
    laid = laid.select("key", "block", "epoch", "before", "budget")
    rows = keyed.join(laid, ["key", "block"])
    order = Window.partitionBy("key", "block", "epoch").orderBy(F.xxhash64("doc_id", "tie", "epoch", F.lit(seed)), "doc_id", "n_tokens", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).filter("start < budget")
    rows = rows.select("row", "doc_id", "source", "n_tokens", "epoch", (F.col("start") / F.col("budget")).alias("mix_order"))
    if carry:
        rows = rows.join(whole.select("row", *[F.col(n).alias(f"{c}_carried" if c in OUTPUTS else c) for c, n in zip(carry, names)]), "row")
    return rows.drop("row")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), max_repeat=4.0)


QUERIES = {"op10_mixing": op10_mixing}
ORACLE = {}
