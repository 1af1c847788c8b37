"""The stateful trend and distinct counts from sketches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleanery.operators import sketches, trends
from gleanery.session import work_dir
from gleanery.streaming import trend as stream
from gleanery.streaming.trend import TrendTable, start_trend

from .conftest import as_tuples

START = dt.datetime(2026, 1, 1)


def deliver(spark, root, days, lateness, checkpoint="progress"):
    rows = [(i, None if d is None else START + dt.timedelta(days=d)) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "n long, ts timestamp")
    df.coalesce(1).write.mode("append").parquet(f"{root}/in")
    table = TrendTable(spark, f"{root}/trend")
    source = spark.readStream.schema(df.schema).parquet(f"{root}/in")
    start_trend(source, "ts", table, f"{root}/{checkpoint}", lateness).awaitTermination()
    return table


def batch(spark, days):
    rows = [(START + dt.timedelta(days=d),) for d in days if d is not None]
    return sorted(as_tuples(trends.weekly_trend(spark.createDataFrame(rows, "ts timestamp"), "ts")))


def test_stream_equals_batch_after_restarts(spark, monkeypatch):
    monkeypatch.setattr(stream, "RUNS", 2)
    root, rng, sent = work_dir(spark, "trend-test"), random.Random(3), []
    for _ in range(4):
        lot = [rng.uniform(0, 60) for _ in range(25)] + [None]
        sent += lot
        table = deliver(spark, root, lot, "90 days")
        assert sorted(as_tuples(table.trend())) == batch(spark, sent)
    assert len(table.snapshots.current()["runs"]["weeks"]) <= 2
    # A replay from nothing, as after a lost checkpoint, gives the same totals.
    again = deliver(spark, root, [], "90 days", "progress-2")
    assert sorted(as_tuples(again.trend())) == batch(spark, sent)


def test_rows_of_final_weeks_are_left_out(spark):
    root = work_dir(spark, "trend-test")
    deliver(spark, root, [0, 1, 60], "10 days")
    # The week of day 45 ends less than ten days before day 60; the first weeks are final.
    table = deliver(spark, root, [2, 50, 61], "10 days")
    assert sorted(as_tuples(table.trend())) == batch(spark, [0, 1, 50, 60, 61])


def test_sketches_over_ranges_of_days(spark):
    rng = random.Random(1)
    rows = [(f"2026-0{rng.randint(1, 4)}-{rng.randint(1, 28):02d}T00:00:00.000Z", f"s{rng.randint(0, 40)}", f"t{rng.randint(0, 9000)}") for _ in range(30_000)]
    rows += [(None, "undated", "t"), ("2026-05-01", None, None)]
    df = spark.createDataFrame(rows, "date_article string, source string, titre string")
    lots = [df.where(F.xxhash64("titre") % 3 == i) for i in range(-2, 3)]
    parts = [sketches.daily_sketches(x, ["source", "titre"]) for x in lots]
    stored = parts[0]
    for part in parts[1:]:
        stored = stored.unionByName(part)
    days = sketches.merged(stored)
    assert days.count() == days.select("date").distinct().count() == 4 * 28 + 1
    spans = [("2026-01-01", "2026-01-01"), ("2026-01-05", "2026-01-20"), ("2026-01-01", "2026-04-30"), ("2026-05-01", "2026-05-02"), ("2030-01-01", "2030-02-01")]
    ranges = spark.createDataFrame([tuple(map(dt.date.fromisoformat, s)) for s in spans], "debut date, fin date")
    found = {(str(r.debut), str(r.fin)): r for r in sketches.distinct_between(days, ranges).collect()}
    for a, b in spans:
        held = [r for r in rows if r[0] and a <= r[0][:10] <= b]
        for name, k in (("source", 1), ("titre", 2)):
            n = len({r[k] for r in held} - {None})
            assert found[a, b][name] == pytest.approx(n, rel=0.02), (a, b, name)


def test_exact_counts_over_ranges_of_days(spark):
    rng = random.Random(2)
    first = dt.date(2026, 1, 1)
    rows = [(first + dt.timedelta(rng.randint(0, 60)), rng.choice([None, *(f"s{i}" for i in range(70))])) for _ in range(400)]
    rows += [(None, "undated"), (first + dt.timedelta(90), None), *[(first, "often")] * 50]
    df = spark.createDataFrame(rows, "jour date, source string")
    spans = [(first + dt.timedelta(a), first + dt.timedelta(b)) for a, b in ((0, 0), (3, 30), (10, 12), (0, 90), (90, 91), (200, 210), (3, 30))]
    found = sketches.exactly_between(df, "source", spark.createDataFrame(spans, "debut date, fin date"), "n")
    held = {(a, b): len({s for d, s in rows if d and a <= d <= b} - {None}) for a, b in spans}
    assert sorted(as_tuples(found)) == sorted((a, b, n) for (a, b), n in held.items())
    # Values are told apart before they meet the ranges, not once in every range.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and "distinct" not in plan
