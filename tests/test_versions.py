"""Snapshots and restores of projects' tables: whole steps or nothing, nothing copied, others untouched."""

from datetime import datetime

import pytest

from tessaria.operators.versions import Versions

SCHEMAS = {"chapters": "project_id long, chapter_no int, status string, content string", "evidence": "project_id long, id long"}


def _frames(spark, chapters, evidence):
    return {"chapters": spark.createDataFrame(chapters, SCHEMAS["chapters"]), "evidence": spark.createDataFrame(evidence, SCHEMAS["evidence"])}


def _now(store):
    return tuple(sorted(tuple(r) for r in store.current(t).collect()) for t in ("chapters", "evidence"))


@pytest.fixture
def store(spark, tmp_path):
    s = Versions(spark, str(tmp_path / "store"), SCHEMAS)
    s.save(_frames(spark, [(1, i, "complete", "text") for i in range(11)] + [(2, 1, "complete", "a"), (2, 2, "draft", "b"), (2, 3, "complete", None), (2, 0, "complete", "z"), (3, 1, "complete", " \n")], [(1, 10), (1, 10), (2, 20), (4, 40)]), into_empty=True)
    return s


def _ids(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "project_id long")


def test_progress_and_no_version_without_content(spark, store):
    got = store.snapshot(_ids(spark, 1, 2, 2, 3, 4, 99), "kept", datetime(2024, 1, 1)).collect()
    assert {(r["project_id"], r["status"], r["completed"], r["progress"], r["reason"]) for r in got} == {(1, "complete", 10, 100, "kept"), (2, "interrupted", 1, 9, "kept")}
    assert len(got) == 2 and store.snapshot(_ids(spark, 3), "none").count() == 0


def test_restore_replaces_every_table_and_keeps_what_was(spark, store):
    first = _now(store)
    v = {r["project_id"]: r["version_id"] for r in store.snapshot(_ids(spark, 1, 2), "kept").collect()}
    store.save(_frames(spark, [(1, 1, "draft", "new"), (2, 1, "draft", "other")], [(2, 21), (2, 22)]))
    second = _now(store)
    assert [r for r in second[0] if r[0] == 1] == [(1, 1, "draft", "new")] and [r for r in second[1] if r[0] in (1, 4)] == [(4, 40)]
    pick = lambda *rows: spark.createDataFrame(rows, "project_id long, version_id string")
    assert [r["project_id"] for r in store.restore(pick((1, v[1]), (2, v[1]), (7, "no"), (None, None))).collect()] == [1]
    third = _now(store)
    assert [[r for r in t if r[0] == 1] for t in third] == [[r for r in t if r[0] == 1] for t in first]
    assert [[r for r in t if r[0] != 1] for t in third] == [[r for r in t if r[0] != 1] for t in second]
    backup = store.versions().filter("reason = 'before a restore'").collect()
    assert [(r["project_id"], r["status"], r["progress"]) for r in backup] == [(1, "interrupted", 0)]
    store.restore(pick((1, backup[0]["version_id"]), (1, v[1])))  # the newer of two
    assert _now(store) == second


def test_a_step_that_fails_half_way_changes_nothing(spark, store, monkeypatch):
    v = store.snapshot(_ids(spark, 1, 2), "kept").select("project_id", "version_id").collect()
    store.save(_frames(spark, [(1, 1, "draft", "new"), (2, 1, "draft", "other")], []))
    before, made = _now(store), store.versions().count()

    def lost(*_):
        raise OSError("lost")

    chosen = spark.createDataFrame(v, "project_id long, version_id string")
    steps = [lambda: store.restore(chosen), lambda: store.snapshot(_ids(spark, 1), "x"), lambda: store.save(_frames(spark, [(5, 1, "draft", "five")], [(5, 50)]))]
    for step in steps:
        with monkeypatch.context() as m, pytest.raises(OSError):
            m.setattr(Versions, "_commit", lost)
            step()
        assert _now(store) == before and store.versions().count() == made
        if step is steps[0]:  # what a failed restore left is not taken up by a snapshot
            assert store.snapshot(_ids(spark, 2), "y").count() == 1 and _now(store) == before
            made += 1
        if step is steps[1]:  # nor a failed snapshot's versions by a save
            store.save(_frames(spark, [(2, 1, "draft", "other")], []))
            assert _now(store) == before and store.versions().count() == made
    assert {r["project_id"] for r in store.restore(chosen).collect()} == {1, 2}
    assert {r[0] for r in _now(store)[0]} == {1, 2, 3} and (1, 10, "complete", "text") in _now(store)[0]
    assert store.versions().count() == made + 2


def test_refusals_and_empty_projects(spark, store):
    before = _now(store)
    with pytest.raises(ValueError):
        store.save(_frames(spark, [(1, 1, "draft", "x")], []), into_empty=True)
    with pytest.raises(ValueError):
        store.save({"chapters": spark.createDataFrame([], SCHEMAS["chapters"])})
    with pytest.raises(ValueError):
        store.save(_frames(spark, [(None, 1, "draft", "x")], []))
    with pytest.raises(ValueError):
        store.save(_frames(spark, [(1, 1, "draft", "x")], []), projects=_ids(spark, 2))
    assert _now(store) == before
    store.save(_frames(spark, [], []), projects=_ids(spark, 1, 2, 3))
    assert _now(store) == ([], [(4, 40)])
    empty = Versions(spark, store.path + "-none", SCHEMAS)
    assert _now(empty) == ([], []) and empty.versions().count() == 0 and empty.last() == 0
    assert empty.restore(spark.createDataFrame([(1, "v1-1")], "project_id long, version_id string")).count() == 0
