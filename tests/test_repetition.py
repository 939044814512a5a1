import random
import re
from statistics import median

import pytest
from pyspark.sql import functions as F

from tessaria.operators import repetition as R
from tessaria.operators import similarity as S

CHAPTERS = "report string, chapter long, text string, note string"


def _rows(spark, *chapters):
    return spark.createDataFrame([("r", i, t, "x") for i, t in enumerate(chapters, 1)], CHAPTERS)


def _texts(df):
    return {r["chapter"]: (r["text"], r["removed"]) for r in df.collect()}


LONG = "Every branch of the trade depends on cost, on channels and on payment terms"


def test_sentences_and_rows_of_earlier_chapters_go(spark):
    rows = "- 2022: 101.7 bn\n- 2023: 373.9 bn\n- 2024: 504.4 bn"
    got = _texts(R.without_repeats(_rows(spark, f"# One\n{LONG}。Own end of one.\n{rows}", f"# Two\n- {LONG} [3]。New words。\n## Sub\n{rows}\n# Three\n2) 2024:504.4bn [1-2]；\nshort", None, "")))
    assert got == {1: (f"# One\n{LONG}。Own end of one.\n{rows}", 0), 2: ("# Two\n- New words。\n# Three\nshort", 5), 3: ("", 0), 4: ("", 0)}


def test_bare_headings_go_with_their_children(spark):
    got = _texts(R.without_repeats(_rows(spark, "# A\n## B\n### C\ntext\n## D\n## E\n\nmore\n# F\n## G")))
    assert got[1][0] == "# A\n## B\n### C\ntext\n## E\n\nmore"


def test_a_second_run_removes_nothing(spark):
    once = R.without_repeats(_rows(spark, f"{LONG}。{LONG}！\n| a | 12345 |", f"| a | 12345 |\n\n{LONG}\nOther words of chapter two"))
    twice = R.without_repeats(once.select("report", "chapter", "text"))
    assert {k: v[0] for k, v in _texts(once).items()} == {k: v[0] for k, v in _texts(twice).items()}
    assert all(n == 0 for _, n in _texts(twice).values())


def test_issues(spark):
    prose = "。".join(f"{LONG}, number {i} of all" for i in range(4))
    rows = "- 2022: 101.7 bn\n- 2023: 373.9 bn\n- 2024: 504.4 bn"
    got = {r["chapter"]: r for r in R.issues(_rows(spark, prose, prose, f"{prose}。{prose}", LONG, rows, rows, "- 2024: 504.4 bn", None, f"{rows}\n{rows}\n{rows}")).collect()}
    assert [got[i]["prose_issue"] for i in range(1, 10)] == [False, True, True, False, False, False, False, False, False]
    assert [got[i]["rows_issue"] for i in range(1, 10)] == [False] * 5 + [True, False, False, True]
    assert (got[3]["repeated"], got[7]["repeated_rows"], got[9]["repeated_rows"]) == (8, 1, 3)
    assert R.issues(_rows(spark).limit(0)).count() == R.without_repeats(_rows(spark).limit(0)).count() == 0


def _left(chapters):
    """Chapter by chapter, line by line: what is left and how much went."""
    keys, told, out = set(), set(), {}
    plain = lambda x: re.sub(r"\[\d+(-\d+)?\]|[\s*`]", "", x)
    for no, text in chapters:
        mine, lines, gone = set(), [], 0
        for line in text.split("\n"):
            mark = re.match(r"\s*([-*+]\s+|\d+[.)、]\s*)", line)
            mark = mark.group() if mark else ""
            body, item = line[len(mark):], mark or line.lstrip().startswith("|")
            key = plain(body).replace("|", "").strip("。；;")
            if item and len(key) >= 6 and re.search(r"\d", key):
                if key in keys:
                    gone += 1
                    continue
                keys.add(key)
            parts = []
            for part in re.split("(?<=[。！？])", body):
                k = plain(part).rstrip("。！？")
                if len(k) >= 25:
                    if k in told or k in mine:
                        gone += 1
                        continue
                    mine.add(k)
                parts.append(part)
            if "".join(parts).strip() or not body.strip():
                lines.append(mark + "".join(parts).strip() if body.strip() else line)
        seen, kept = set(), []
        for line in lines:
            k = re.sub(r"\s", "", line)
            if len(k) >= 40 and not re.match(r"\s*([#|>]|[-*+]\s|\d+[.)、]\s)", line):
                if k in seen:
                    continue
                seen.add(k)
            kept.append(line)
        ends = []
        for line in reversed(kept):
            rank = len(m[1]) if (m := re.match(r"\s*(#{1,6})\s+\S", line)) else 0
            below = next((x for x in reversed(ends) if x.strip()), "")
            under = len(m[1]) if (m := re.match(r"\s*(#{1,6})\s+\S", below)) else 9
            if not rank or below and under > rank:
                ends.append(line)
        out[no] = ("\n".join(reversed(ends)).strip(), gone)
        for line in text.split("\n"):
            if not line.lstrip().startswith(("#", "|")):
                body = re.sub(r"^\s*([-*+]\s+|\d+[.)、]\s*)", "", line)
                told |= {k for x in re.split("[。！？]", body) if len(k := plain(x)) >= 25}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equals_reading_line_by_line(spark, seed):
    rng = random.Random(seed)
    said = [f"{LONG} {i}" for i in range(4)] + ["short words"]
    def line():
        kind = rng.random()
        if kind < 0.15:
            return "#" * rng.randint(1, 4) + f" Heading {rng.randint(1, 3)}"
        if kind < 0.25:
            return rng.choice(["", "  "])
        if kind < 0.5:
            return rng.choice(["- ", "2. ", "| ", "* **", ""]) + f"level {rng.randint(1, 4)}00 [{rng.randint(1, 9)}]"
        return rng.choice(["", "", "- ", "| "]) + "".join(rng.choice(said) + rng.choice("。！") for _ in range(rng.randint(1, 3)))
    chapters = [(i, "\n".join(line() for _ in range(rng.randint(1, 14)))) for i in range(1, 13)]
    assert _texts(R.without_repeats(spark.createDataFrame([("r", i, t, "") for i, t in chapters], CHAPTERS))) == _left(chapters)


def test_locations_are_rows_and_leave_references_out(spark):
    docs = spark.createDataFrame([(1, f"# One\n{LONG} [1]。x"), (2, f"{LONG}。\n# References\n{LONG}"), (3, None), (4, "once only, but long enough to be one")], "doc_id long, text string")
    got = {tuple(r) for r in R.locations(docs).select("doc_id", "pos", "part", "heading", "n").collect()}
    assert got == {(1, 1, 0, "One", 2), (2, 0, 0, None, 2)}


def test_scores_at_ranks_equal_a_sort(spark):
    rng = random.Random(3)
    found = [rng.choice([rng.random(), 0.25, 1.0, 0.25 + 1e-9]) for _ in range(150)]
    n, pairs = 24, 24 * 23 // 2
    zeros = pairs - len(found)
    scores = spark.createDataFrame([(x,) for x in found], "similarity double")
    every = sorted([0.0] * zeros + found)
    for k in (0, zeros - 1, zeros, zeros + 1, pairs // 2, pairs - 1):
        assert abs(S.score_at(scores, k, zeros) - every[k]) < 1e-12
    r = S.calibration(scores, n, spark.createDataFrame([(0.97,), (0.93,)], "similarity double")).first()
    assert (r["documents"], r["pairs"], r["pairs_at_90"], r["synthetic_append_min"]) == (n, pairs, sum(x >= 0.9 for x in found), 93.0)
    assert abs(r["median"] - 100 * median(every)) < 1e-9 and abs(r["p95"] - 100 * every[int((pairs - 1) * 0.95)]) < 1e-9
    none = S.calibration(scores.limit(0), 1, scores.limit(0)).first()
    assert (none["pairs"], none["median"], none["p95"], none["maximum"], none["synthetic_append_min"]) == (0, 0.0, 0.0, 0.0, 0.0)


def test_a_revision_keeps_most_of_a_text(spark):
    p = spark.createDataFrame([(1, "a text of some length that stays as it is " * 3), (2, "")], "doc_id long, body string")
    sets = p.select("doc_id", S.gram_ids(F.col("body")).alias("grams"))
    got = {r["a"]: r["similarity"] for r in S.revision_scores(p, S.gram_weights(sets, 2), 1.0, "one more").collect()}
    assert 0.7 < got[1] < 1 and got[2] == 0
