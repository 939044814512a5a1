import random

from tessaria.operators import retrieval as R


def test_both_ways_of_bm25_give_the_same_rows(spark):
    """Terms in the tasks, or by a join; with ties, copies and texts without words."""
    r = random.Random(6)
    texts = [" ".join(r.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(r.randrange(12))) for _ in range(120)] + ["alpha beta"] * 30 + ["", None, "漢字漢字"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    q = spark.createDataFrame([(1, "alpha beta"), (2, "gamma gamma unknown"), (3, ""), (4, "漢字 zeta"), (None, "delta")], "query_id long, text string")
    rows = lambda df: sorted((str(x["query_id"]), x["rank"], x["doc_id"], round(x["score"], 9)) for x in df.collect())
    sent = R.bm25(d, q, "doc_id")
    assert "MapInArrow" in sent._jdf.queryExecution().toString()
    assert rows(sent) == rows(R.bm25(d, q, "doc_id", most=0)) and len(rows(sent)) > 30
    twice = d.unionByName(d.limit(20))
    assert rows(R.bm25(twice, q, "doc_id")) == rows(R.bm25(twice, q, "doc_id", most=0))
