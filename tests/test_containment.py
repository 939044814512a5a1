"""Needles in texts by both ways, and what is built on them: names, scopes, series in blocks, places of claims."""

import random

from pyspark.sql import functions as F

from tessaria.operators import containment as C
from tessaria.operators import evidence as E
from tessaria.operators import facts as X
from tessaria.operators import retrieval as R


def _world(rng, n_texts=120, n_needles=160):
    letters = "abé中𝄞 "
    texts = [(rng.randrange(3), i, "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 30, 400])))) for i in range(n_texts)]
    texts += [(0, 900, None), (None, 901, "abababab"), (0, 902, "ab" * 20_000)]
    needles = [(rng.randrange(3), "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5])))) for _ in range(n_needles)]
    for _ in range(40):  # pieces of texts, some long
        g, _, t = rng.choice(texts[:n_texts])
        at = rng.randrange(len(t) + 1)
        needles.append((g, t[at : at + rng.choice([4, 12, 13, 90])]))
    return texts, needles + [(0, None), (0, ""), (None, "ab"), (0, "a" * 50), (0, "ab" * 5_000)] + needles[:5]


def test_both_ways_give_what_a_look_at_all_pairs_gives(spark):
    for seed in (1, 2):
        texts, needles = _world(random.Random(seed))
        t, n = spark.createDataFrame(texts, "g int, key long, text string").repartition(5), spark.createDataFrame(needles, "g int, needle string")
        want = {(g, w, k) for g, w in needles for h, k, x in texts if w and x is not None and g is not None and g == h and w in x}
        for most in (1_000_000, 0):
            rows = C.contained(n, t, ("g",), most_chars=most).collect()
            assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == want
        free = {(w, k) for _, w in needles for _, k, x in texts if w and x is not None and w in x}
        for most in (1_000_000, 0):
            assert {tuple(r) for r in C.contained(n.select("needle"), t.select("key", "text"), most_chars=most).collect()} == free


def test_nothing_in_nothing(spark):
    t, n = spark.createDataFrame([(1, "abc")], "key long, text string"), spark.createDataFrame([("b",)], "needle string")
    for most in (1_000_000, 0):
        assert C.contained(n.limit(0), t, most_chars=most).count() == 0
        assert C.contained(n, t.limit(0), most_chars=most).count() == 0
        assert C.contained(n, t, most_chars=most).count() == 1


def test_one_needle_in_every_text(spark):
    t = spark.range(3000).select(F.col("id").alias("key"), F.concat(F.lit("the same words and "), F.col("id")).alias("text"))
    n = spark.createDataFrame([("same words and",), ("words and 77",)], "needle string")
    for most in (1_000_000, 0):
        got = {r["needle"]: r["n"] for r in C.contained(n, t, most_chars=most).groupBy("needle").agg(F.count("*").alias("n")).collect()}
        assert got == {"same words and": 3000, "words and 77": 11}


def test_names_of_several_words(spark):
    e = spark.createDataFrame([("A", "Acme"), ("S", "Acme Steel"), ("B", "北方重工"), ("B", "Northern Heavy"), ("T", "abc")], "entity string, key string")
    q = spark.createDataFrame([(1, "How is ACME-steel doing?"), (2, "Acme alone"), (3, "北方 重工 或 northern  heavy"), (4, "Ａｃｍｅ and Northern Heavy"), (5, None), (6, "abc"), (7, "")], "query_id long, text string")
    one = lambda **k: {r["query_id"]: r["entity"] for r in R.entity_in_query(q, e, **k).collect()}
    assert one() == {2: "A", 3: "B"}
    assert one(longest=True) == {1: "S", 2: "A", 3: "B"}
    assert one(least=3)[6] == "T"


def test_scope_with_reasons(spark):
    reports = spark.createDataFrame([(10, 1, ["Acme Steel", "AS", None]), (20, 2, ["北方重工"]), (21, 2, ["北方重工"]), (30, 3, None), (None, 4, ["Ghost"])], "report_id long, document_id long, aliases array<string>")
    rows = [(1, "acme steel?", None, None, ("resolved", "alias", 10)), (2, "北方重工 怎么样", None, None, ("ambiguous", "several_reports", None)), (3, "Acme Steel", 1, None, ("resolved", "chosen", 10)),
            (4, "Acme Steel", 3, None, ("refused", "mismatch", None)), (5, "它 怎么样", None, [1, 1, None], ("resolved", "follow_up", 10)), (6, "它 怎么样", None, [], ("unknown", "unnamed", None)),
            (7, "哪些企业 最好", None, [1], ("refused", "across", None)), (8, None, 3, None, ("resolved", "chosen", 30)), (9, "", 99, None, ("unknown", "no_report", None)), (10, None, None, None, ("unknown", "unnamed", None)),
            (11, "继续", None, [1, 3], ("ambiguous", "several_reports", None)), (12, "Ghost", None, None, ("unknown", "unnamed", None)), (13, "acme steel 北方重工", 1, None, ("refused", "mismatch", None))]
    q = spark.createDataFrame([r[:4] for r in rows], "query_id long, text string, document_id long, previous array<long>")
    got = {r["query_id"]: (r["status"], r["reason"], r["report_id"]) for r in R.resolve_scope(q, reports).collect()}
    assert got == {r[0]: r[4] for r in rows}
    assert R.resolve_scope(q, reports.limit(0)).filter("status = 'resolved'").count() == 0


def test_series_bind_as_a_look_at_all_blocks_says(spark):
    rng = random.Random(3)
    words = ["alpha beta", "gamma delta", "one two three", "tiny", "common text", "rare words here"]
    blocks = [(rng.choice([0, 0, 0, 1]), i, i, " ".join(rng.sample(words, rng.randrange(1, 5))) + rng.choice(["", " [3]", "**"])) for i in range(40)] + [(0, 99, 99, None)]
    series = [(i, rng.choice([0, 0, 1]), [rng.choice(words) + rng.choice(["", " [1-2]", "  #"]) for _ in range(rng.randrange(0, 4))] + rng.choice([[], [None], [""]])) for i in range(80)]
    form = lambda x: __import__("re").sub(r"[\s#*_`|]|\[\d+(?:-\d+)?\]", "", x or "")
    bound, placed = {}, {}
    for i, chapter, excerpts in series:
        parts = {form(e) for e in excerpts} - {""}
        placed[i] = None
        if parts and all(len(p) >= 6 for p in parts):
            mine = [b for b in blocks if b[0] == chapter]
            whole = [b[1] for b in mine if all(p in form(b[3]) for p in parts)]
            if len(whole) == 1:
                bound[i] = whole[0]
            at = [[b[2] for b in mine if p in form(b[3])] for p in parts]
            placed[i] = max(a[0] for a in at) if all(len(a) == 1 for a in at) else None
    s = spark.createDataFrame(series, "series_id long, chapter_no long, excerpts array<string>")
    b = spark.createDataFrame(blocks, "chapter_no long, block_id long, ordinal long, text string")
    assert {r["series_id"]: r["block_id"] for r in X.bind_series(s, b).collect()} == bound
    assert {r["series_id"]: r["ordinal"] for r in X.place_series(s, b).collect()} == placed


def test_claims_about_two_places_do_not_conflict(spark):
    say = lambda i, text: (i, 0, text)
    ev = spark.createDataFrame([say(1, "In 2020 the demand was 5 thousand in 中国 alone."), say(2, "In 2020 the demand was 6 thousand in 全球 alone."), say(3, "In 2020 the demand was 7 thousand in 全球 alone."),
                                say(4, "In 2021 the cost was 7 thousand in 粤省."), say(5, None)], "id long, chapter_no int, excerpt string")
    claims = E.claim_keys(ev)
    assert {r["id"]: r["geography"] for r in claims.collect()} == {1: "中国", 2: "全球", 3: "全球", 4: "粤省"}
    assert {r["id"] for r in E.conflicts(claims).collect()} == {2, 3}
    assert E.place_pattern(("Asia", "Asia Minor"), "") == "Asia\\ Minor|Asia"


def test_json_in_prose(spark):
    row = '{"evidence_id": "e1", "exact_quote": "a ] } \\" b", "more": 1}'
    cases = [(f"Sure [1]: ```json\n[{row}]\n```", ["e1"]), (row, ["e1"]), (f'{{"data": {{"response": {{"records": [{row}]}}}}}}', ["e1"]), ('{"candidates": "' + f"[{row}]".replace("\\", "\\\\").replace('"', '\\"') + '"}', ["e1"]),
             (f'{{"items": []}} {row}', []), (f"{{broken {row}", ["e1"]), (f"[{row}, 3, {{}}] [{row}, {row}]", ["e1"]), ("[" * 3000, []), (None, []), ("", []), ("no", []), ('[{"evidence_id": " ", "exact_quote": "x"}]', []),
             ('{"a": {"evidence_id": 7, "exact_quote": "x"}}', ["7"]), (f'{{"data": {{"data": {{"data": {{"data": [{row}]}}}}}}}}', ["e1"]), ("{} [] " + row, [])]
    d = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id long, answer string")
    got = {}
    for r in X.json_candidates(d).collect():
        got.setdefault(r["id"], []).append(r["evidence_id"])
        assert r["evidence_id"] == "7" or r["quote"] == 'a ] } " b'
    assert got == {i: w for i, (_, w) in enumerate(cases) if w}
