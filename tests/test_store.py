"""Files, ingestion, stored tables and the stream."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gleanery.functions.dates import in_day
from gleanery.functions.labels import score_pairs
from gleanery.model import EVENT_SCHEMA, EXTRACT_SCHEMA, LABEL_HYPOTHESES
from gleanery.operators import classify, ingest, normalize, star, updates
from gleanery.operators.search import unclassified
from gleanery.plans import batch
from gleanery.session import work_dir
from gleanery.sources import files
from gleanery.sources.store import Store
from gleanery.streaming.ingest import event_stream, ingest_step, start_ingest, store_responses

from .conftest import as_tuples

CLOCK = dt.datetime(2026, 7, 20, 12, tzinfo=dt.timezone.utc)
BASE = {
    "title": "Un article", "link": "https://example.com/a", "source": "dev.to", "themes": ["Architecture"],
    "score": 3, "date": "2026-01-15", "tags": ["  React ", "TS"],
}


def events(spark, *changes):
    rows = [{**BASE, **c} for c in changes]
    rows = [{**r, "score": None if r["score"] is None else str(r["score"])} for r in rows]
    df = spark.createDataFrame([tuple(r.get(c) for c in EVENT_SCHEMA.names) for r in rows], EVENT_SCHEMA)
    return df.withColumn("rang", F.monotonically_increasing_id())


@pytest.fixture
def store(spark):
    return Store(spark, work_dir(spark, "test")).create()


def aggregate_rows(store):
    found = store.aggregate().orderBy("date", F.desc("est_total"), "thematique").collect()
    return [(str(r["date"]), r["thematique"], r["nb_articles"], r["score_moyen"]) for r in found]


def send(store, df):
    fresh, rejects = ingest.ingest_batch(store.articles(), df, CLOCK, "rang")
    store.append(fresh)
    return rejects


def test_ingest_projection(spark, store):
    send(store, events(spark, {}, {"link": "b", "source": "", "resume": "", "categorie": "", "score": 0, "themes": None, "tags": None, "date": "?"}))
    a, b = (r.asDict() for r in store.articles().orderBy(F.desc("url")).collect())
    assert (a["url"], a["tags"], a["themes_mistral"]) == (BASE["link"], '["react","ts"]', '["Architecture"]')
    assert (a["date_article"], a["date_collecte"], a["jour"]) == (
        "2026-01-15T00:00:00.000Z", "2026-07-20T12:00:00.000Z", dt.date(2026, 1, 15),
    )
    assert a["themes_ml"] is None and a["score_mistral"] == 3
    for name in ("resume", "categorie_mistral", "score_mistral", "themes_mistral", "date_article", "jour"):
        assert b[name] is None
    assert (b["source"], b["tags"]) == ("inconnu", "[]")


def test_first_send_wins_and_resends_change_nothing(spark, store):
    first = [{"title": "one"}] + [{"title": f"again {i}"} for i in range(30)] + [{"link": "b"}]
    send(store, events(spark, *first))
    send(store, events(spark, {"title": "later"}, {"link": "c"}))
    got = {r["url"]: r["titre"] for r in store.articles().collect()}
    assert got == {BASE["link"]: "one", "b": "Un article", "c": "Un article"}
    ids = [r["id"] for r in store.articles().collect()]
    assert len(set(ids)) == 3 and min(ids) >= 1


def test_rejects(spark, store):
    rejects = send(store, events(spark, {"link": None}, {"title": ""}, {"title": None, "link": ""}))
    assert sorted(r["motif"] for r in rejects.collect()) == ["link missing", "title and link missing", "title missing"]
    assert store.articles().count() == 0


def test_refresh_is_idempotent_and_equals_rebuild(spark, store):
    send(store, events(spark, {}, {"link": "b", "score": 5, "themes": ["a", "b"]}, {"link": "c", "date": "2026-01-16"}, {"link": "d", "date": None}))
    store.refresh_days(["2026-01-15"])
    one = aggregate_rows(store)
    assert one == [("2026-01-15", None, 2, 4.0), ("2026-01-15", "Architecture", 1, 3.0), ("2026-01-15", "a", 1, 5.0), ("2026-01-15", "b", 1, 5.0)]
    store.refresh_days(["2026-01-15"])
    assert aggregate_rows(store) == one
    store.refresh_days(["2026-01-15", "2026-01-16"])
    both = aggregate_rows(store)
    store.rebuild()
    assert aggregate_rows(store) == both
    assert star.crosscheck(store.aggregate(), store.articles()).count() == 0
    assert spark.read.parquet(store.calendar_path).count() == 2


def test_refresh_clears_a_day_that_lost_its_articles(spark, store):
    send(store, events(spark, {}, {"link": "b", "date": "2026-01-16"}))
    store.rebuild()
    kept = store.articles().where("url = 'b'")
    kept.write.mode("overwrite").partitionBy("jour").parquet(store.articles_path + "-new")
    store.articles_path += "-new"
    store.refresh_days(["2026-01-15"])
    assert [r[0] for r in aggregate_rows(store)] == ["2026-01-16", "2026-01-16"]


def test_refresh_checks_its_days(store):
    with pytest.raises(ValueError, match="not a day"):
        store.refresh_days(["2026-02-30"])


def test_any_number_of_days_gives_the_same_tables(spark, store):
    rows = events(spark, *[{"link": str(i), "date": str(dt.date(2026, 1, 1) + dt.timedelta(i % 9))} for i in range(40)])
    send(store, rows)
    for day in range(9):
        store.refresh_days([str(dt.date(2026, 1, 1) + dt.timedelta(day))])
    one_by_one = aggregate_rows(store), sorted(map(tuple, store.calendar().collect()))
    together = Store(spark, work_dir(spark, "test")).create()
    send(together, rows)
    together.refresh_days(together.touched_days(together.facts()))
    assert (aggregate_rows(together), sorted(map(tuple, together.calendar().collect()))) == one_by_one
    together.rebuild()
    assert (aggregate_rows(together), sorted(map(tuple, together.calendar().collect()))) == one_by_one
    assert len(one_by_one[1]) == 9


def test_a_refresh_lists_its_own_days_only(spark, store):
    send(store, events(spark, *[{"link": str(i), "date": str(dt.date(2026, 1, 1) + dt.timedelta(i))} for i in range(30)]))
    opened = store._facts_of([dt.date(2026, 1, 5), dt.date(2030, 1, 1)])
    assert {f.split("jour=")[1][:10] for f in opened.inputFiles()} == {"2026-01-05"} and opened.count() == 1
    assert store._facts_of([dt.date(2030, 1, 1)]).count() == 0


def test_ids_are_dense_and_the_index_is_repaired(spark, store):
    store.append_new(normalize.from_events(events(spark, {}, {"link": "b"}, {"link": "c"}), CLOCK, "rang"), "rang")
    # Stored behind the index's back, as after a crash between the two writes.
    other = Store(spark, store.articles_path.removesuffix("/articles"))
    send(other, events(spark, {"link": "d"}))
    late = Store(spark, store.articles_path.removesuffix("/articles"))
    again = normalize.from_events(events(spark, {"link": "d"}, {"link": "e"}, {"link": "b"}), CLOCK, "rang")
    late.append_new(again, "rang")
    late.append_new(again, "rang")
    got = sorted((r["url"], r["id"]) for r in late.facts().collect())
    assert [u for u, _ in got] == ["b", "c", "d", "e", BASE["link"]] and len({i for _, i in got}) == 5
    assert max(i for u, i in got if u == "e") == 5


def test_labels_and_new_articles_at_once(spark, store):
    send(store, events(spark, {}, {"link": "b"}))
    reply = lambda url, score, n: (url, json.dumps({"labels": [LABEL_HYPOTHESES["Sécurité"]], "scores": [score]}), n)
    asked = spark.createDataFrame([reply("b", 0.9, 1), reply("b", 0.8, 2), reply(BASE["link"], 0.1, 1)], "url string, reponse string, n int")
    send(store, events(spark, {"link": "c"}))  # the same day, between reading and labelling
    store_responses(store, asked, "n")
    got = {r["url"]: r["score_confiance_ml"] for r in store.articles().collect()}
    assert got == {BASE["link"]: 0.1, "b": 0.8, "c": None}
    store_responses(store, spark.createDataFrame([reply("b", 0.7, 0)], "url string, reponse string, n int"), "n")
    assert sorted((r["url"], r["score_confiance_ml"] or 0) for r in store.articles().collect()) == [("b", 0.7), ("c", 0), (BASE["link"], 0.1)]


def test_keyed_update_never_doubles_a_row(spark, make_articles):
    changes = spark.createDataFrame([(1, 0.5), (1, 0.9)], "id long, score_confiance_ml double")
    got = updates.keyed_update(make_articles({}, {}), changes, "id", ["score_confiance_ml"])
    assert sorted((r["id"], r["score_confiance_ml"]) for r in got.collect()) == [(1, 0.9), (2, None)]


def test_keyed_update(spark, make_articles):
    rows = make_articles({"score_confiance_ml": 0.1}, {}, {})
    changes = spark.createDataFrame([(1, None, 1), (2, 0.5, 1), (2, 0.7, 2), (9, 0.9, 1)], "id long, score_confiance_ml double, n int")
    got = updates.keyed_update(rows, changes, "id", ["score_confiance_ml"], order="n")
    assert got.columns == rows.columns
    assert sorted((r["id"], r["score_confiance_ml"]) for r in got.collect()) == [(1, None), (2, 0.7), (3, None)]


def test_second_labels_reach_the_store(spark, store):
    send(store, events(spark, {}, {"link": "b"}, {"link": "c", "date": None}, {"link": "d"}))
    devops = LABEL_HYPOTHESES["DevOps/Infrastructure"]
    responses = spark.createDataFrame(
        [
            (BASE["link"], json.dumps({"labels": [devops], "scores": [0.93]})),
            ("b", json.dumps([{"label": devops, "score": 0.4}])),
            ("c", json.dumps({"labels": [devops], "scores": [0.8]})),
            ("d", '{"error": "overloaded"}'),
        ],
        "url string, reponse string",
    )
    labelled = store_responses(store, responses)
    assert as_tuples(classify.outcome_counts(labelled)) == [(3, 1, 1)]
    got = {r["url"]: (r["themes_ml"], r["score_confiance_ml"]) for r in store.articles().collect()}
    assert got == {
        BASE["link"]: ('["DevOps/Infrastructure"]', 0.93), "b": ("[]", 0.4), "c": ('["DevOps/Infrastructure"]', 0.8), "d": (None, None),
    }
    assert [r["url"] for r in unclassified(store.articles()).collect()] == ["d"]


def test_rounded_confidence(spark):
    rows = spark.createDataFrame([(json.dumps({"labels": [LABEL_HYPOTHESES["IA/ML"]], "scores": [0.876549]}),)], "r string")
    assert classify.labels_from_scores(rows, score_pairs(F.col("r")), places=4).first()["confiance"] == 0.8765


def deliver(spark, store, path, name, *changes):
    folder = f"{path}/incoming"
    rows = [json.dumps({**BASE, **c}) for c in changes]
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.mode("append").text(folder)
    stream = event_stream(spark, folder)
    start_ingest(stream, store, f"{path}/progress", lambda: CLOCK, f"{path}/rejects").awaitTermination()


def test_stream_resumes_and_keeps_the_aggregate(spark, store):
    path = work_dir(spark, "stream-test")
    deliver(spark, store, path, "one", {}, {"link": "b", "date": "2026-01-16"}, {"title": ""}, {"tags": "x", "link": "t"})
    assert [r for r in aggregate_rows(store) if r[1] is None] == [("2026-01-15", None, 2, 3.0), ("2026-01-16", None, 1, 3.0)]
    deliver(spark, store, path, "two", {"title": "again"}, {"link": "c", "score": 5, "date": "2026-01-16"})
    assert [r for r in aggregate_rows(store) if r[1] is None] == [("2026-01-15", None, 2, 3.0), ("2026-01-16", None, 2, 4.0)]
    assert {r["url"] for r in store.articles().collect()} == {BASE["link"], "b", "c", "t"}
    assert spark.read.json(f"{path}/rejects").select("motif").collect()[0][0] == "title missing"


def test_replayed_batch_repairs_the_aggregate(spark, store):
    rows = events(spark, {}).drop("rang").withColumn("lieu", F.struct(F.lit(0).alias("x")))
    step = ingest_step(store, lambda: CLOCK)
    store.refresh_days, kept = (lambda days: (_ for _ in ()).throw(RuntimeError("lost executor"))), store.refresh_days
    step(rows, 0)
    assert store.articles().count() == 1 and aggregate_rows(store) == []
    store.refresh_days = kept
    step(rows, 0)
    assert store.articles().count() == 1 and len(aggregate_rows(store)) == 2


def test_legacy_import(spark, tmp_path):
    records = [
        {"title": "a", "link": "u1", "source": "s", "score": 0, "tags": ["X "], "analyzedAt": "2026-03-01T00:00:00Z", "date": "raw"},
        {"title": "b", "link": "u1", "source": "s"},
        {"title": "c", "link": "u2"},
        {"title": "", "link": "u3", "source": "s"},
        {"title": "d", "link": "u4", "source": "s"},
    ]
    (tmp_path / "old.json").write_text(json.dumps(records))
    read = files.read_legacy(spark, str(tmp_path / "old.json")).withColumn("rang", F.monotonically_increasing_id())
    existing = spark.createDataFrame([(41, "u9")], "id long, url string")
    got = ingest.legacy_batch(existing, read, CLOCK, "rang").orderBy("url").collect()
    assert [(r["url"], r["titre"], r["score_mistral"], r["tags"], r["date_article"], r["date_collecte"]) for r in got] == [
        ("u1", "a", 0, '["X "]', "raw", "2026-03-01T00:00:00Z"),
        ("u4", "d", None, "[]", None, "2026-07-20T12:00:00.000Z"),
    ]
    assert min(r["id"] for r in got) > 41
    assert sorted(r["id"] for r in got) == [42, 43]


def test_csv_round_trip(spark, make_articles, tmp_path):
    odd = 'say "hi",\nthen\r\nleave \\ "'
    rows = files.extract_columns(make_articles({"titre": odd, "tags": '["a\\"b","c"]', "source": None}, {"score_confiance_ml": 0.5}))
    files.write_csv(rows, str(tmp_path / "out"), single_file=True)
    back = files.read_extract_csv(spark, str(tmp_path / "out"))
    assert back.schema == EXTRACT_SCHEMA
    assert sorted(as_tuples(back)) == sorted(as_tuples(rows))
    assert len(list((tmp_path / "out").glob("part-*.csv"))) == 1


def test_envelope_takes_the_first_statement(spark, tmp_path):
    body = [{"results": [{"id": 1, "titre": "a"}, {"id": 2}], "success": True, "meta": {}}, {"results": [{"id": 3}]}]
    (tmp_path / "export.json").write_text(json.dumps(body))
    assert sorted((r["id"], r["titre"]) for r in files.read_envelope(spark, str(tmp_path / "export.json")).collect()) == [(1, "a"), (2, None)]


def test_suggestions(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"12": ["IA/ML"], "13": []}')
    assert sorted(as_tuples(files.read_suggestions(spark, str(tmp_path / "s.json")))) == [(12, ["IA/ML"]), (13, [])]


def test_batch_report(spark, make_articles, tmp_path):
    rows = make_articles(*[{"tags": '["a","b"]', "themes_mistral": '["IA/ML"]', "date_article": "2026-01-15T00:00:00.000Z"}] * 5)
    batch.run(files.extract_columns(rows), str(tmp_path), single_file=True)
    read = lambda name: as_tuples(spark.read.option("header", True).csv(str(tmp_path / name)))
    assert read("freq_themes") == [("IA/ML", "mistral", "5", "false")]
    assert read("cooccurrences_tags") == [("a", "b", "5")]
    assert read("tendances_hebdo") == [("2026-01-15", "5", "5.0")]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_day_filters_reach_the_scan(spark, store):
    send(store, events(spark, {}, {"link": "b", "date": "2026-01-16"}))
    text_filter = plan_of(store.articles().where(in_day(F.col("date_article"), "2026-01-15")).select("id"))
    assert "GreaterThanOrEqual(date_article,2026-01-15)" in text_filter and "LessThan(date_article,2026-01-16)" in text_filter
    by_day = plan_of(store.articles().where(F.col("jour").isin(F.lit("2026-01-15").cast("date"))).select("id"))
    assert "PartitionFilters: [isnotnull(jour" in by_day or "PartitionFilters: [(jour" in by_day


def test_insert_check_does_not_shuffle_the_stored_table(spark, store):
    send(store, events(spark, {}))
    plan = plan_of(ingest.absent_from(events(spark, {}).select(F.col("link").alias("url")), store.articles()))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_first_per_url_filters_before_the_shuffle(spark):
    rows = spark.range(10).select((F.col("id") % 2).cast("string").alias("url"), "id")
    plan = plan_of(ingest.first_per_url(rows, "id"))
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_only_new_rows_of_a_batch_are_normalised(spark, store, tmp_path, monkeypatch):
    step = ingest_step(store, lambda: CLOCK, str(tmp_path / "refus"))
    place = F.lit(0).alias("lieu")
    step(events(spark, {}, {"title": ""}).drop("rang").select("*", place), 0)
    read = normalize.normalize_date
    again = lambda text: F.when(text == BASE["date"], F.raise_error(F.lit("again")).cast("string")).otherwise(read(text))
    monkeypatch.setattr(normalize, "normalize_date", again)
    step(events(spark, {"title": "resent"}, {"link": "b", "date": "2026-01-16"}, {"link": ""}).drop("rang").select("*", place), 1)
    got = {r["url"]: (r["titre"], str(r["jour"])) for r in store.articles().collect()}
    assert got == {BASE["link"]: ("Un article", "2026-01-15"), "b": ("Un article", "2026-01-16")}
    refused = spark.read.json(str(tmp_path / "refus")).orderBy("lot")
    assert [(r["lot"], r["motif"]) for r in refused.collect()] == [(0, "title missing"), (1, "link missing")]


def test_responses_are_read_once(spark):
    bodies = ['[{"label": "%s", "score": 0.9}]' % next(iter(LABEL_HYPOTHESES.values())), '{"error": "overloaded"}', None]
    rows = spark.createDataFrame([(f"u{i}", b) for i, b in enumerate(bodies)], "url string, reponse string")
    found = classify.label_updates(classify.labels_from_scores(rows, score_pairs(F.col("reponse"))), "url")
    assert as_tuples(found) == [("u0", f'["{next(iter(LABEL_HYPOTHESES))}"]', 0.9)]
    filters = [line for line in plan_of(found).splitlines() if "Filter" in line]
    assert not any("parse_json" in line for line in filters)


def test_a_batch_is_read_once_and_kept_in_files_not_in_the_heap(spark, store, tmp_path, monkeypatch):
    reads, plans, append = spark.sparkContext.accumulator(0), [], store.append_new

    @F.udf("string")
    def read(title):
        reads.add(1)
        return title

    def noted(rows, *more):
        plans.append(plan_of(rows))
        return append(rows, *more)

    def broken(rows, *more):
        rows.count()
        raise RuntimeError("lost executor")

    sent = events(spark, {}, {"link": "b"}, {"title": ""}).drop("rang").select("*", F.lit(0).alias("lieu"))
    step = ingest_step(store, lambda: CLOCK, str(tmp_path / "refus"))
    monkeypatch.setattr(store, "append_new", noted)
    step(sent.withColumn("title", read("title")), 0)
    assert "FileScan parquet" in plans[0] and "InMemoryTableScan" not in plans[0]
    assert reads.value == 3 and store.articles().count() == 2
    assert [r["motif"] for r in spark.read.json(str(tmp_path / "refus")).collect()] == ["title missing"]
    monkeypatch.setattr(store, "append_new", broken)
    with pytest.raises(RuntimeError, match="lost executor"):
        step(sent, 1)
    assert store.snapshots.files.names(f"{store.root}/batches") == []
