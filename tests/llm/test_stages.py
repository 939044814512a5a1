"""Single stages and production parameters on planted cases that the defaults of a small test would not reach."""

import random

import pytest
from test_operators import DOCS, components, shingles

from tessaria.llm import near_dedup

pipeline = pytest.importorskip("corpus_pipeline")


def similar(a, b, percent):
    a, b = shingles(a), shingles(b)
    return 100 * len(a & b) >= percent * len(a | b)


def test_near_dedup_stage_links_from_80_percent(spark, tmp_path):
    rng = random.Random(11)
    texts = []
    for i in range(40):
        w = [f"w{rng.randrange(10**6)}" for _ in range(100)]
        texts.append(" ".join(w))
        for at in (30, 60) if i % 2 else (20, 50, 80):  # 86 of 106 shingles: 0.81; 81 of 111: 0.73
            w[at] = "changed"
        texts.append(" ".join(w))
    assert similar(texts[2], texts[3], 80) and not similar(texts[2], texts[3], 85) and not similar(texts[0], texts[1], 80)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if similar(texts[a], texts[b], 80)]
    want = {d for d, c in components(links, range(len(texts))).items() if d == c}
    assert {r["doc_id"] for r in pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()} == want and len(want) == 60


def test_near_duplicates_recall_far_down_the_trees(spark):
    # Compared at depth 6 only, as members of large sparse groups are: trees must not miss the same pairs together.
    rng = random.Random(12)
    texts = []
    for i in range(400):
        w = [f"w{rng.randrange(10**6)}" for _ in range(169)]
        texts.append(" ".join(w))
        for at in (20, 150, 167):  # 153 of 177 shingles: 0.864
            w[at] = f"x{i}"
        texts.append(" ".join(w))
    assert similar(texts[0], texts[1], 85) and not similar(texts[0], texts[1], 88)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    missed = {2 * i + 1 for i in range(400)} - {r["doc_id"] for r in near_dedup.near_duplicates(docs, depths=(6, 6)).filter("not kept").collect()}
    assert len(missed) <= 1
