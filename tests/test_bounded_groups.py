"""Choices, hashes and merges over groups of any size, beside brute-force versions."""

import random

from pyspark.sql import functions as F

from tessaria.operators import evidence as E
from tessaria.operators import facts as X
from tessaria.operators import quality as Q
from tessaria.operators import retrieval as R


def greedy(items, budget):
    used, out = 0, []
    for rank, n in sorted(items):
        if used + n <= budget:
            used += n
            out.append(rank)
    return out


def test_packing_equals_a_walk_over_all_items(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(1, 6), i, rng.choice([1, 1, 2, 3, 7, 40, 90, 101, rng.randrange(1, 60)])) for i in range(3000)]
    d = spark.createDataFrame(rows, "g long, id long, n int").repartition(7)
    for budget in (1, 5, 100, 10_000):
        got = R.pack_ranked(d, ["g"], F.struct("id"), budget).collect()
        for g in range(6):
            assert sorted(r["id"] for r in got if r["g"] == g) == greedy([(i, n) for k, i, n in rows if k == g], budget)


def test_ranked_evidence_keeps_its_numbers(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), 1, i, rng.choice([None, 0.5, rng.random()]), rng.choice([None, "", "x" * rng.randrange(1, 30)])) for i in range(400)]
    got = R.ranked_evidence(spark.createDataFrame(rows, "project_id long, chapter_no int, id long, score double, excerpt string"), 60).collect()
    for p in (0, 1):
        order = sorted((r for r in rows if r[0] == p and r[4]), key=lambda r: (r[3] is None, -(r[3] or 0), r[2]))
        taken = greedy([(k + 1, len(r[4])) for k, r in enumerate(order)], 60)
        assert sorted((r["citation"], r["id"]) for r in got if r["project_id"] == p) == [(k, order[k - 1][2]) for k in taken]


def test_batch_hash_ignores_order_and_counts_rows(spark):
    rows = [(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a"), (3, "b"), (3, "b"), (4, "c")]
    fp = spark.createDataFrame(rows, "k long, t string").withColumn("fingerprint", F.sha2("t", 256)).withColumn("same", F.lit("s"))
    got = {r["k"]: r["batch_fingerprint"] for r in E.batch_fingerprint(fp.withColumn("k2", F.col("k")), ["k"]).collect()}
    assert len(set(got.values())) == 4
    alone = lambda k: E.batch_fingerprint(fp.filter(F.col("k") == k), ["same"]).first()["batch_fingerprint"]
    assert alone(1) == alone(2) != alone(3)
    briefs = spark.createDataFrame([(1, "new")], "k long, brief string")
    other = {r["k"]: r["batch_fingerprint"] for r in E.batch_fingerprint(fp, ["k"], briefs).collect()}
    assert other[1] != got[1] and other[2] == got[2]


def test_provenance_and_references_as_rows(spark):
    d = spark.createDataFrame([("s", 3, "B", ["x", "y"], ["r"]), ("s", 2, "A", ["y", None], None), ("t", 9, None, None, [])], "sig string, id long, grade string, excerpts array<string>, refs array<string>")
    merged, members = X.merge_provenance(d, ["sig"])
    assert {tuple(r) for r in merged.collect()} == {("s", 2, "A", 2, 2, 1), ("t", 9, None, 1, 0, 0)}
    assert {tuple(r) for r in members.collect()} == {("s", "id", "2"), ("s", "id", "3"), ("s", "excerpt", "x"), ("s", "excerpt", "y"), ("s", "reference", "r"), ("t", "id", "9")}
    refs = spark.createDataFrame([(1, 1, "http://a.org/x?utm_a=1"), (1, 1, "http://a.org/x"), (2, 5, "http://A.org/x/"), (2, 6, None)], "chapter_no int, number int, url string")
    assert {tuple(r) for r in Q.merge_sources(refs).collect()} == {("http://a.org/x", "1-1", 2, 3), ("http://a.org/x", "2-5", 2, 3), (None, "2-6", 1, 1)}
