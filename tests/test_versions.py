"""Versioned tables: atomic replacement, crashes at every step, the URL index and the ledger of lots."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from gleanery.operators import normalize, star
from gleanery.session import work_dir
from gleanery.sources import snapshots, store as stores, urlindex
from gleanery.sources.snapshots import ConcurrentWrite, Snapshots, by_tier
from gleanery.sources.store import Store
from gleanery.streaming.ingest import ingest_step

from .test_store import BASE, CLOCK, aggregate_rows, events, plan_of


@pytest.fixture
def store(spark):
    return Store(spark, work_dir(spark, "versions")).create()


def rows(spark, *changes):
    return normalize.from_events(events(spark, *changes), CLOCK, "rang")


def urls(n, start=0, **more):
    return [{"link": f"u{i}", **more} for i in range(start, start + n)]


def rebuilt(store):
    """The aggregate and calendar that a rebuild gives, next to the present ones."""
    now = aggregate_rows(store), sorted(map(tuple, store.calendar().collect()))
    store.rebuild()
    return now, (aggregate_rows(store), sorted(map(tuple, store.calendar().collect())))


# --- snapshots ---


def test_versions_are_kept_for_a_while_and_then_deleted(spark):
    s = Snapshots(spark, work_dir(spark, "snap"))
    held = []
    for i in range(snapshots.KEEP + 4):
        state = s.current()
        s.drop(state, state["runs"].get("t", []))
        state["runs"]["t"] = [s.write("t", spark.range(i).coalesce(1))]
        assert s.commit(state)["version"] == i + 1
        held.append(state["runs"]["t"][0])
    assert s.read(s.current()["runs"]["t"], "id long").count() == snapshots.KEEP + 3
    there = set(s.files.names(f"{s.root}/t"))
    assert [h.split("/")[1] in there for h in held[:2]] == [False, False]
    assert all(h.split("/")[1] in there for h in held[-snapshots.KEEP :])
    assert len([n for n in s.files.names(f"{s.root}/_versions") if n.endswith(".json")]) <= snapshots.KEEP + 1


def test_a_second_writer_fails_at_its_commit(spark):
    s = Snapshots(spark, work_dir(spark, "snap"))
    one, two = s.current(), s.current()
    s.commit(one)
    with pytest.raises(ConcurrentWrite):
        s.commit({**two, "x": 1})
    assert s.current()["version"] == 1 and "x" not in s.current()


def test_tiers():
    runs = [{"rows": r} for r in (1, 2, 3, 11, 12, 100)]
    assert by_tier(runs, 4, 10) == []
    assert by_tier([*runs, {"rows": 4}], 4, 10) == [{"rows": r} for r in (1, 2, 3, 4)]
    assert by_tier([{"rows": 11}] * 4, 4, 10) == [{"rows": 11}] * 4


def test_readers_see_one_version(spark, store, monkeypatch):
    store.append_new(rows(spark, {}, {"link": "b", "date": "2026-01-16"}), "rang")
    store.rebuild()
    before = store.aggregate(), store.calendar()
    old = [sorted(map(tuple, t.collect())) for t in before]
    store.append_new(rows(spark, {"link": "c", "date": "2026-01-17"}), "rang")
    # The write of the aggregate is done, that of the calendar fails: neither is seen.
    write = Snapshots.write
    failing = lambda self, table, df, **o: write(self, table, df, **o) if table == "aggregate" else 1 / 0
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "write", failing)
        with pytest.raises(ZeroDivisionError):
            store.rebuild()
        with pytest.raises(ZeroDivisionError):
            store.refresh_days(["2026-01-17"])
    assert [sorted(map(tuple, t.collect())) for t in (store.aggregate(), store.calendar())] == old
    store.rebuild()
    assert store.calendar().count() == 3
    # Who planned with the former version can still read it.
    assert [sorted(map(tuple, t.collect())) for t in before] == old


# --- crashes ---


@pytest.mark.parametrize("step", ["_store", "half", "_enter", "commit"])
def test_a_crash_at_any_step_costs_nothing(spark, store, monkeypatch, step):
    store.append_new(rows(spark, *urls(3)), "rang")
    more = rows(spark, *urls(6, start=2, date="2026-01-16"), {"link": "undated", "date": None})

    def crash(*_):
        raise RuntimeError("lost driver")

    with monkeypatch.context() as m:
        if step == "half":
            kept = Store._store
            m.setattr(Store, "_store", lambda self, r: (kept(self, r.where("url IN ('u4', 'u6', 'undated')")), crash()))
        elif step == "commit":
            commit = Snapshots.commit
            m.setattr(Snapshots, "commit", lambda self, s: crash() if s.get("waiting", [])[1:] else commit(self, s))
        else:
            m.setattr(Store, step, crash)
        with pytest.raises(RuntimeError):
            store.append_new(more, "rang")
    late = Store(spark, store.root)
    late.append_new(more, "rang")
    late.refresh_days()
    got = sorted((r["url"], r["id"]) for r in late.facts().select("url", "id").collect())
    assert [u for u, _ in got] == sorted([f"u{i}" for i in range(8)] + ["undated"])
    assert sorted(i for _, i in got) == list(range(1, 10))
    now, then = rebuilt(late)
    assert now == then


# --- URL index ---


def test_files_of_a_batch_do_not_grow_with_the_store(spark, store, monkeypatch):
    opened, find = [], urlindex.UrlIndex.slices
    monkeypatch.setattr(urlindex.UrlIndex, "slices", staticmethod(lambda runs, hashes: opened.append(find(runs, hashes)) or opened[-1]))
    monkeypatch.setattr(urlindex, "FANOUT", 3)
    monkeypatch.setattr(urlindex, "SMALLEST", 12)
    written = []
    for k in range(14):
        had = {r["run"] for r in store.snapshots.current()["runs"].get("urls", [])}
        assert store.append_new(rows(spark, *urls(4, start=3 * k)), "rang") == (3 if k else 4)
        runs = store.snapshots.current()["runs"]["urls"]
        files = lambda run: [n for n in store.snapshots.files.names(f"{store.root}/{run}/tranche=0") if n.endswith(".parquet")]
        written.append(sum(len(files(r["run"])) for r in runs if r["run"] not in had))
    assert set(written) <= {0, 1, 2} and written.count(1) >= 12
    assert max(map(len, opened)) <= 2 * 3
    assert sum(r["rows"] for r in runs) == store.facts().count() == 43
    assert sorted(r[0] for r in store.index.known(store.snapshots.current(), store.facts()).collect()) == sorted(r[0] for r in store.facts().select("url").collect())


def test_large_runs_are_opened_in_slices(spark, monkeypatch):
    monkeypatch.setattr(urlindex, "SLICE_ROWS", 50)
    index = urlindex.UrlIndex(Snapshots(spark, work_dir(spark, "urls")))
    state = {"version": 0, "runs": {}, "dropped": []}
    stored = spark.range(1000).select(F.concat(F.lit("u"), "id").alias("url"))
    index.add(state, stored, 1000)
    (run,) = state["runs"]["urls"]
    assert run["bits"] == 5 and run["slices"] == sorted(run["slices"]) or set(run["slices"]) == set(range(32))
    asked = spark.createDataFrame([("u7",), ("u999",), ("new",), (None,)], "url string")
    found = index.known(state, asked)
    assert sorted(r[0] for r in found.collect()) == ["u7", "u999"]
    assert len(found.inputFiles()) <= 3
    plan = plan_of(found)
    assert "PushedFilters: [In(h, [" in plan or "PushedFilters: [Or(" in plan or "EqualTo(h" in plan
    # Rows are sorted, so that row groups and pages have narrow ranges.
    one = spark.read.parquet(f"{index.snapshots.root}/{run['run']}/tranche=3").select("h").collect()
    assert [r[0] for r in one] == sorted(r[0] for r in one)
    monkeypatch.setattr(urlindex, "LOOKUP", 2)
    assert index.known(state, asked).count() == 1000


def test_the_index_of_no_rows(spark):
    index = urlindex.UrlIndex(Snapshots(spark, work_dir(spark, "urls")))
    state = {"version": 0, "runs": {}, "dropped": []}
    none = spark.createDataFrame([], "url string")
    index.add(state, none, 0)
    assert index.known(state, none).collect() == [] and state["runs"]["urls"] == []


def test_rows_added_behind_the_index(spark, store):
    store.append_new(rows(spark, *urls(2)), "rang")
    store.append(store.facts().limit(1).withColumn("url", F.lit("odd")).withColumn("id", F.lit(40).cast("long")))
    assert store.append_new(rows(spark, {"link": "odd"}, {"link": "u1"}, {"link": "z"}), "rang") == 1
    assert {r["url"]: r["id"] for r in store.facts().collect()}["z"] == 41


# --- incremental aggregate ---


def test_late_days_add_up_without_reading_their_day(spark, store, monkeypatch):
    lots = [
        [{}, {"link": "b", "score": 5, "themes": ["a", "b"]}, {"link": "c", "date": "2026-01-16", "score": None}],
        [{"link": "d", "themes": None}, {"link": "e", "date": "2025-12-31"}, {"link": "f", "date": None}],
        [{"link": "b", "score": 1}, {"link": "g", "date": "2026-01-16", "score": 2}],
    ]
    read = lambda *_: (_ for _ in ()).throw(AssertionError("facts were read"))
    for lot in lots:
        store.append_new(rows(spark, *lot), "rang")
        with monkeypatch.context() as m:
            m.setattr(Store, "_facts_of", read)
            m.setattr(Store, "facts", read)
            store.refresh_days()
            store.refresh_days()  # a lot is applied once
    now, then = rebuilt(store)
    assert now == then and ("2026-01-16", None, 2, 2.0) in now[0]
    assert star.crosscheck(store.aggregate(), store.facts()).count() == 0


def test_recomputed_days_and_waiting_lots_do_not_count_twice(spark, store):
    store.append_new(rows(spark, {}, {"link": "b", "date": "2026-01-16"}), "rang")
    store.refresh_days(["2026-01-15"])
    now, then = rebuilt(store)
    assert now == then
    store.append_new(rows(spark, {"link": "c"}), "rang")
    store.rebuild()
    store.refresh_days()
    now, then = rebuilt(store)
    assert now == then and then[0][0][2] == 2


def test_small_runs_are_folded(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "SMALL_RUNS", 2)
    for k in range(5):
        store.append_new(rows(spark, {"link": f"x{k}", "date": f"2026-01-1{k}"}, {"link": f"y{k}"}), "rang")
        store.refresh_days()
    assert all(len(store.snapshots.current()["runs"][t]) <= 2 for t in ("aggregate", "calendar"))
    now, then = rebuilt(store)
    assert now == then


def test_a_replay_after_a_failed_refresh(spark, store, monkeypatch):
    batch = events(spark, {}, {"link": "b"}).drop("rang").withColumn("lieu", F.struct(F.lit(0).alias("x")))
    step = ingest_step(store, lambda: CLOCK)
    with monkeypatch.context() as m:
        m.setattr(Store, "_fold", lambda *a, **k: 1 / 0)
        step(batch, 0)
    assert store.facts().count() == 2 and aggregate_rows(store) == []
    step(batch, 0)
    now, then = rebuilt(store)
    assert now == then and len(now[0]) == 2


# --- labels ---


def test_labels_are_compacted_and_sent_to_the_facts(spark, store):
    store.append_new(rows(spark, *urls(40)), "rang")
    for k in range(9):
        changes = [(f"u{i}", json.dumps([str(k)]), 0.1 * k) for i in range(k, 12)]
        store.update_labels(spark.createDataFrame(changes, "url string, themes_ml string, score_confiance_ml double"))
    runs = store.snapshots.current()["runs"]["labels"]
    assert len(runs) < stores.LABEL_FANOUT and sum(r["rows"] for r in runs) <= 12 + 3 * 12
    got = {r["url"]: r["themes_ml"] for r in store.articles().collect()}
    assert got == {f"u{i}": json.dumps([str(min(i, 8))]) if i < 12 else None for i in range(40)}
    plan = plan_of(store.articles())
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and plan.count("libelles") == 0
    facts_side = plan[plan.index("BroadcastHashJoin") :].split("BroadcastExchange")[0]
    assert "Exchange" not in facts_side


def test_no_labels_at_all(spark, store):
    store.append_new(rows(spark, {}), "rang")
    store.update_labels(spark.createDataFrame([], "url string, themes_ml string, score_confiance_ml double"))
    assert store.snapshots.current()["runs"].get("labels", []) == []
    assert [r["url"] for r in store.articles().collect()] == [BASE["link"]]
