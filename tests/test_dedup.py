from pyspark.sql import functions as F

from tessaria.operators import dedup as D

DOCS = "doc_id long, text string"


def _rows(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


def test_profile_ignores_space_and_case_only(spark):
    p = {r["doc_id"]: r for r in D.profiles(_rows(spark, "Rate -1.5%\n\nEnd", "rate  -1.5%\nEND", "Rate 15%\nEnd", None, "")).collect()}
    assert p[0]["text_hash"] == p[1]["text_hash"] != p[2]["text_hash"]
    assert p[3]["paragraphs"] == p[4]["paragraphs"] == []


def test_table_layout_counts(spark):
    t = spark.createDataFrame([(["AB", "C"], ["A", "BC"])], "a array<string>, b array<string>").select(D.table_layout_hash(F.col("a")).alias("a"), D.table_layout_hash(F.col("b")).alias("b")).first()
    assert t["a"] != t["b"]


def test_weights_and_scores(spark):
    base = " ".join(f"{i * 7919 % 10007:x}w{i * 104729 % 9973:x}" for i in range(300))
    docs = _rows(spark, base, base + " One more sentence at the end.", "quite different words here, nothing shared", "xyz", base.upper(), "abcdefgh")
    g, n = D.grams(D.profiles(docs)), 6
    w, u = D.frequency_weights(g, n), D.unseen_weight(n)
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 4)], "a long, b long")
    s = {(r["a"], r["b"]): r["similarity"] for r in D.scores(pairs, g, w, u).collect()}
    assert 0.9 <= s[0, 1] < 0.999 and s[0, 2] < 0.1 and abs(s[0, 4] - 1) < 1e-9
    strict = {(r["a"], r["b"]): r["similarity"] for r in D.strict_scores(docs.filter("doc_id = 0").select("doc_id"), g, w, u).collect()}
    assert abs(strict[0, 1] - s[0, 1]) < 1e-9
    cand = {(r["a"], r["b"]) for r in D.fast_candidates(*(2 * [D.bands(D.signatures(D.hashed(g), ["doc_id"]), ["doc_id"])])).collect()}
    assert (0, 4) in cand and (0, 1) in cand


def test_few_documents_weigh_alike(spark):
    g = D.grams(D.profiles(_rows(spark, "one two", "one three")))
    assert {r["weight"] for r in D.frequency_weights(g, 2).collect()} == {1.0}


def test_minhash_equals_numpy(spark):
    import hashlib

    g = D.grams(D.profiles(_rows(spark, "the quick brown fox")))
    row = D.signatures(D.hashed(g), ["doc_id"]).first()
    vals = [int(hashlib.sha256(r["gram"].encode()).hexdigest()[:8], 16) for r in g.collect()]
    for i, (a, b) in enumerate(D.permutations(64)):
        assert row[f"s{i}"] == min((v * a + b) % D.PRIME for v in vals)


def test_exact_paragraphs_keep_the_first_and_are_idempotent(spark):
    long = "This is a paragraph of prose that is long enough to count as one."
    docs = _rows(spark, f"# A\n{long}\n# B\n{long}", f"# C\n{long}\nOwn text here.")
    once = D.exact_paragraphs(docs)
    got = {r["doc_id"]: r["text"] for r in once.collect()}
    assert got == {0: f"# A\n{long}", 1: "# C\nOwn text here."}
    assert {r["doc_id"]: r["text"] for r in D.exact_paragraphs(once).collect()} == got


def test_lineage_and_decisions(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (9, 8)], "new_document_id long, previous_document_id long")
    got = {(r["start"], r["ancestor"]) for r in D.lineage(e, spark.createDataFrame([(5,)], "doc_id long")).collect()}
    assert got == {(5, 4), (5, 3), (5, 1)}
    f = spark.createDataFrame([(True, True, False, False, False), (False, False, False, True, True), (False,) * 5], "name_conflict boolean, file_match boolean, exact_match boolean, similar_outside boolean, needs_review boolean")
    assert [r["decision"] for r in D.publication_decision(f).collect()] == ["reject_name", "reject_similar", "accept"]


def test_distinct_windows_are_counted_within_the_row(spark):
    """A document's windows are one array: no row for each, and so no exchange."""
    df = spark.createDataFrame([(1, "abcabcabc"), (2, "ab"), (3, "")], "doc_id long, body string").select("doc_id", D.gram_array(3).alias("g")).select("doc_id", F.size("g").alias("n"), F.array_min("g").alias("first"))
    assert sorted(map(tuple, df.collect())) == [(1, 3, "abc"), (2, 1, "ab"), (3, 1, "")]
