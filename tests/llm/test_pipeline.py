"""The pipeline's stages on planted cases, against brute-force versions of what each must do."""

import random

import pytest
from test_operators import DOCS, brute_leaks, brute_near, prose, toxic_rows

pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    rng = random.Random(5)
    base = toxic_rows(900)
    texts = [t for _, t, _ in base]
    leak = prose(rng, 30)
    texts += [texts[1], texts[2] + " more", f"{prose(rng, 15)} {leak} {prose(rng, 15)}", f'{prose(rng, 20)} token = "{"0a1b" * 10}" {prose(rng, 20)}', None, ""]
    docs = [(i, t, "en", f"s{i % 4}" if i % 3 else "hot", len(t or "")) for i, t in enumerate(texts)]
    # Rows without an id pass every filter with their own texts, and so do both texts of an id that repeats.
    odd = [prose(rng, 12) for _ in range(4)]
    docs += [(None, odd[0], "en", "s1", 1), (None, odd[1], "en", "hot", 1), (5000, odd[2], "en", "s2", 1), (5000, odd[3], "en", None, 1)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in base], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept, n = d, len(docs)
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = [tuple(r) for r in kept.collect()]
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        kept = spark.read.parquet(str(tmp_path / f"stage{k}"))
        after = {r["doc_id"]: r for r in kept.collect()}
        ids = {r[0] for r in before}
        if k < 4:
            assert kept.columns == list(pipeline.COLUMNS)
        if name == "toxicity":
            toxic = {i for i, _, y in base if y}
            assert len(set(after) & toxic) <= 0.05 * len(toxic) and len(ids - toxic - set(after)) <= 0.02 * n
        elif name == "near_dedup":
            assert set(after) == {x[0] for x in brute_near([r for r in before if r[0] is not None]) if x[3]} | {None}
        elif name == "decontamination":
            assert set(after) == {x[0] for x in brute_leaks(before, [(1, leak)]) if not x[5]}
        elif name == "secret_scans":
            assert set(after) == ids and "0a1b0a1b" not in after[903]["text"] and "<secret>" in after[903]["text"]
            assert all(after[r[0]]["text"] == (r[1] or "") for r in before if r[0] not in (903, None, 5000))
        else:
            # Every reading is of a row with its own text, and each source has its budget of words.
            assert {(r["doc_id"], r["text"]) for r in kept.collect()} <= {(r[0], r[1]) for r in before}
            words = {s: sum(len((r[1] or "").split()) for r in before if r[3] == s) for s in {r[3] for r in before}}
            read = {s: sum(len((r["text"] or "").split()) for r in kept.collect() if r["source"] == s) for s in words}
            assert abs(sum(read.values()) - sum(words.values())) <= 200 * len(words) and all(read[s] <= 4.1 * words[s] + 200 for s in words)
        if k < 4:
            assert {(r["doc_id"], r["text"]) for r in kept.collect()} >= {(None, t) for t in odd[:2]} | {(5000, t) for t in odd[2:]}
    assert {r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()} == set(after)


def test_rows_that_share_an_id_are_judged_apart(spark, tmp_path):
    rng = random.Random(8)
    leak, base, other = prose(rng, 30), prose(rng, 80), prose(rng, 60)
    words = base.split(" ")
    words[40] = "changed"
    texts = [(1, base), (5, f"{prose(rng, 15)} {leak} {prose(rng, 15)}"), (5, prose(rng, 40)), (6, " ".join(words)), (6, other), (None, other), (None, leak), (None, prose(rng, 25)), (7, prose(rng, 33)), (7, None), (8, "")]
    rows = [(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(texts)] + [(7, texts[8][1], "en", "again", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = lambda r: (r[0], r[1])
    clean = sorted((key(r) for r in pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()), key=str)
    assert clean == sorted((key(r) for r in rows if leak not in (r[1] or "")), key=str)
    kept = [key(r) for r in pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).collect()]
    # One row of each class of a brute-force version over rows that are numbered apart, whatever their ids.
    classes = {}
    for x in brute_near([(k, *r[1:]) for k, r in enumerate(rows)]):
        classes.setdefault(x[2], set()).add(key(rows[x[0]]))
    assert len(kept) == len(classes) and all(sum(k in c for k in kept) == 1 for c in classes.values())
