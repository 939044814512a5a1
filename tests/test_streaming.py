"""The streaming check and the first-seen filter, over several batches and restarts."""

import random
import shutil
import time as clock
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessaria.streaming import ingest as I

DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)
EVENTS = "user long, at timestamp, n long"


def write(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    clock.sleep(0.05)  # files are read by the time of their change


def brute_first_seen(rows, lifetime):
    last, out = {}, []
    for u, t, n in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]):
        if u not in last or t >= last[u] + lifetime:
            last[u] = t
            out.append((u, t, n))
    return out


def first_seen(spark, folder, out, state):
    events = I.read_files(spark, str(folder), EVENTS, per_trigger=1)
    I.start_with_state(I.first_seen(events, ["user"], "at", 3600, "10 minutes"), str(out), str(state)).awaitTermination()
    return sorted((r["user"], r["at"].replace(tzinfo=timezone.utc), r["n"]) for r in spark.read.parquet(str(out)).collect())


def test_first_seen_expires(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(5), DAY + timedelta(seconds=rng.randrange(6 * 3600)), i) for i in range(300)]
    rows = sorted({(u, t): (u, t, n) for u, t, n in rows}.values(), key=lambda r: r[1])
    rows += [(9, DAY, 1000), (9, DAY + timedelta(seconds=3599), 1001), (9, DAY + timedelta(seconds=3600), 1002), (7, DAY + timedelta(hours=9), 1003)]
    rows = sorted(rows, key=lambda r: r[1])
    for k in range(0, len(rows), 90):  # batches in order of time
        write(spark, tmp_path / "in", rows[k : k + 90], EVENTS)
    write(spark, tmp_path / "in", [(1, None, 5000)], EVENTS)
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name, None)
    got = first_seen(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state")
    assert got == sorted(brute_first_seen(rows, timedelta(hours=1))) and spark.conf.get(name, None) == own
    # A restart goes on with the state: within the lifetime nothing passes, after it one row does; what is too late is dropped.
    end = DAY + timedelta(hours=9)
    more = [(7, end + timedelta(minutes=59), 1), (7, end + timedelta(minutes=61), 2), (8, end - timedelta(hours=3), 3)]
    write(spark, tmp_path / "in", more, EVENTS)
    assert [x for x in first_seen(spark, tmp_path / "in", tmp_path / "out", tmp_path / "state") if x not in got] == [(7, more[1][1], 2)]


DOCS = "doc_id long, text string"


def documents():
    rng = random.Random(3)
    word = lambda: rng.choice(["mill", "river", "stone", "vale", "night"]) + str(rng.randrange(300))
    base = [[word() for _ in range(120)] for _ in range(8)]
    rows = []
    for k, w in enumerate(base):
        rows += [" ".join(w), " ".join(w).upper(), " ".join([*w, "end"]), " ".join([*w[:60], *base[k - 1][60:]])]
    rng.shuffle(rows)
    rows += [" ".join([*base[0][:-1], f"tail{i}"]) for i in range(40)] + ["", None, "", "short"]
    return [(i, t) for i, t in enumerate(rows)]


def brute_ingest(rows, threshold=0.9):
    """Which documents have an earlier copy, and which only an earlier one that is similar."""
    body = lambda t: "".join((t or "").split()).lower()
    grams = lambda b: {b[i : i + 5] for i in range(max(1, len(b) - 4))}
    copy, near = {}, {}
    sets = {i: grams(body(t)) for i, t in rows}
    for i, t in rows:
        earlier = [j for j, u in rows if j < i and body(u) == body(t)]
        if earlier:
            copy[i] = min(earlier)
        else:
            near[i] = {j for j, _ in rows if j < i and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}
    return copy, near


@pytest.mark.parametrize("files", [1, 4])
def test_ingest_finds_copies_and_near_copies(spark, tmp_path, files):
    rows = documents()
    for k in range(files):
        write(spark, tmp_path / "in", rows[k * len(rows) // files : (k + 1) * len(rows) // files], DOCS)
    out = str(tmp_path / "out")

    def run():
        I.ingest(I.read_files(spark, str(tmp_path / "in"), DOCS, per_trigger=1), out, str(tmp_path / "state")).awaitTermination()
        return {r["doc_id"]: (r["duplicate_of"], r["similarity"]) for r in spark.read.parquet(f"{out}/decisions").collect()}

    got, (copy, near) = run(), brute_ingest(rows)
    assert set(got) == {i for i, _ in rows}
    for i, (other, similarity) in got.items():
        if i in copy:
            assert (other, similarity) == (copy[i], 1.0)
        else:
            assert (other in near[i] and similarity >= 0.9) if near[i] else other is None
    assert run() == got  # nothing new
    # The last batch run again, as after a failure, gives the same rows and leaves one row per document.
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    (tmp_path / "state" / "commits" / str(last)).unlink()
    shutil.rmtree(tmp_path / "state" / "commits" / f".{last}.crc", ignore_errors=True)
    (tmp_path / "state" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    assert run() == got and spark.read.parquet(f"{out}/decisions").count() == len(rows)


def test_sketches_lose_no_similar_pair(spark):
    """Pairs at or over the threshold pass; most others of the same size don't, so their texts are not shuffled."""
    from tessaria.operators import similarity as S

    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    cases = []
    for n in (1, 4, 60, 900, 4000):
        for cut in (0, 1, n // 40, n // 21, n // 10, n):
            a = text(n)
            cases.append((a, a[: n - cut] + text(cut)))
    d = spark.createDataFrame(cases, "a string, b string").select("a", "b", S.gram_ids(F.col("a")).alias("x"), S.gram_ids(F.col("b")).alias("y"))
    may = S.may_reach(S.sketch(F.col("x")), F.size("x"), S.sketch(F.col("y")), F.size("y"), 0.9)
    rows = d.select("a", "b", S.text_jaccard("a", "b").alias("s"), may.alias("may")).collect()
    grams = lambda b: {b[i : i + 5] for i in range(max(1, len(b) - 4))}
    for r in rows:
        x, y = grams(r["a"]), grams(r["b"])
        assert r["s"] == len(x & y) / len(x | y) and (r["may"] or r["s"] < 0.9)
    assert sum(r["s"] >= 0.9 for r in rows) > 5 and not any(r["may"] for r in rows if r["s"] < 0.1 and len(r["a"]) >= 900)


def test_the_ingest_index_stores_no_sets(spark, tmp_path):
    write(spark, tmp_path / "in", documents(), DOCS)
    I.ingest(I.read_files(spark, str(tmp_path / "in"), DOCS), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert not [t for _, t in spark.read.parquet(str(tmp_path / "out" / "docs")).dtypes if t.startswith("array")]
