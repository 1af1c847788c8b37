"""Stored facts as day-partitioned Parquet, with calendar, daily aggregate, labels and URL index as versioned runs."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import calendar_day, day_of
from ..model import ARTICLE_SCHEMA
from ..operators.ingest import absent_from, first_per_url, numbered_after
from ..operators.star import averaged, calendar_of, daily_partials, summed
from ..operators.updates import last_per_key, overlaid
from .snapshots import Snapshots, by_tier
from .urlindex import UrlIndex

FACT_SCHEMA = T.StructType([*ARTICLE_SCHEMA.fields, T.StructField("jour", T.DateType())])
PARTIAL_SCHEMA = "date date, est_total boolean, thematique string, n bigint, s bigint, k bigint"
CALENDAR_SCHEMA = "date_complete date, annee int, mois int, semaine int, jour_semaine int"
LABEL_COLUMNS = ["themes_ml", "score_confiance_ml"]
LABEL_SCHEMA = "url string, themes_ml string, score_confiance_ml double, lot long"
#: Runs of the aggregate or the calendar, which are small, before they are folded into one.
SMALL_RUNS = 8
#: Runs of labels of one size before they are merged, and the smallest size.
LABEL_FANOUT = 4
LABEL_SMALLEST = 10_000
#: Labels (about 100 bytes each) that are sent to the facts instead of shuffling both.
BROADCAST_LABELS = 500_000


class Store:
    """Folder with ``articles`` (by publication day) and the versioned tables ``aggregate`` (partial sums by day and
    theme), ``calendar``, ``labels`` (second labels by URL) and ``urls``.

    The articles are the truth and only grow. Everything derived from them changes by a commit of the
    manifest, so a reader sees each change as a whole. New articles are staged and numbered, noted in
    the manifest as a lot, and then stored; a crash in between costs the next call the rows of that lot.
    One writer at a time: a second one fails at its commit instead of doing harm.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.articles_path = f"{root}/articles"
        self.snapshots = Snapshots(spark, root)
        self.index = UrlIndex(self.snapshots)

    def create(self) -> Store:
        """Empty tables, where there are none yet."""
        self.spark.createDataFrame([], FACT_SCHEMA).write.mode("ignore").partitionBy("jour").parquet(self.articles_path)
        return self

    # --- reading ---

    def facts(self) -> DataFrame:
        """Articles as they were ingested."""
        return self.spark.read.schema(FACT_SCHEMA).parquet(self.articles_path)

    def articles(self) -> DataFrame:
        """Articles with the last second labels received for each.

        The labels are compacted, and their number is known: as long as it is small they go to the
        facts, which are not shuffled.
        """
        runs = self.snapshots.current()["runs"].get("labels", [])
        if not runs:
            return self.facts()
        given = self._last_labels(runs)
        if sum(r["rows"] for r in runs) <= BROADCAST_LABELS:
            given = F.broadcast(given)
        return overlaid(self.facts(), given, "url", LABEL_COLUMNS).select(*FACT_SCHEMA.names)

    def aggregate(self) -> DataFrame:
        """The daily aggregate of the current version, summed over its runs."""
        return averaged(summed(self._partials(self.snapshots.current()))).where(F.col("nb_articles") > 0)

    def calendar(self) -> DataFrame:
        """The calendar dimension: every day that has or had articles."""
        return self.snapshots.read(self.snapshots.current()["runs"].get("calendar", []), CALENDAR_SCHEMA)

    @property
    def calendar_path(self) -> str:
        """The files of the current calendar."""
        runs = [r.split("/")[1] for r in self.snapshots.current()["runs"].get("calendar", [])]
        return f"{self.root}/calendar/{{{','.join(runs)}}}"

    # --- articles ---

    @contextmanager
    def kept(self, rows: DataFrame) -> Iterator[DataFrame]:
        """The rows from files beside the tables, for as long as a batch is worked on. A crash leaves them behind, unread."""
        path = f"{self.root}/batches/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(path)
            yield self.spark.read.schema(rows.schema).parquet(path)
        finally:
            self.snapshots.files.delete(path)

    def append(self, rows: DataFrame) -> None:
        """Adds numbered article rows as they are. URL index and aggregate learn of them later: the
        index with the next :meth:`append_new`, the aggregate from :meth:`refresh_days` or :meth:`rebuild`."""
        state = self._settled()
        self.snapshots.commit({**state, "behind": True})
        self._store(rows)

    def append_new(self, candidates: DataFrame, order: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Insert-or-ignore on the URL; returns the number of new articles.

        ``shape`` makes article rows of raw candidates; only those that are new go through it.
        """
        state = self._covered(self._settled())
        known = self.index.known(state, candidates)
        fresh = first_per_url(absent_from(candidates, known), order).drop(order)
        # Stored before they are numbered, so that numbers cannot differ between two evaluations.
        placed = (shape(fresh) if shape else fresh).withColumn("place", F.monotonically_increasing_id())
        stage = f"lots/{uuid.uuid4().hex}"
        placed.write.parquet(f"{self.root}/{stage}")
        lot = {"stage": stage, "after": state.get("highest", 0)}
        lot["rows"] = self._lot(lot).count()
        if not lot["rows"]:
            self.snapshots.files.delete(f"{self.root}/{stage}")
            return 0
        state = self.snapshots.commit({**state, "pending": lot})
        self._store(self._lot(lot))
        self._enter(state)
        return lot["rows"]

    def _lot(self, lot: dict[str, Any]) -> DataFrame:
        """The numbered rows of a lot."""
        schema = T.StructType([f for f in ARTICLE_SCHEMA.fields if f.name != "id"] + [T.StructField("place", T.LongType())])
        return numbered_after(lot["after"], self.spark.read.schema(schema).parquet(f"{self.root}/{lot['stage']}"), "place")

    def _store(self, rows: DataFrame) -> None:
        """Rebalancing packs small days together and splits a hot one."""
        placed = rows.withColumn("jour", day_of(F.col("date_article"))).select(*FACT_SCHEMA.names)
        placed.hint("rebalance", "jour").write.mode("append").partitionBy("jour").parquet(self.articles_path)

    def _enter(self, state: dict[str, Any]) -> dict[str, Any]:
        """The pending lot is stored: its URLs are indexed, and it waits for the aggregate."""
        lot = state["pending"]
        state["highest"] = lot["after"] + lot["rows"]
        self.index.add(state, self._lot(lot), lot["rows"])
        state["waiting"] = [*state.get("waiting", []), lot]
        return self.snapshots.commit({**state, "pending": None})

    def _settled(self) -> dict[str, Any]:
        """The current version, after a lot that a crash left half stored is stored whole.

        Its rows are told by their numbers, which nobody else has; only its days are read.
        """
        state = self.snapshots.current()
        lot = state.get("pending")
        if not lot:
            return state
        rows = self._lot(lot)
        days = [r[0] for r in rows.select(day_of(F.col("date_article")).alias("jour")).distinct().collect()]
        there = self._facts_of(days).where(F.col("id") > lot["after"]).select("id")
        missing = rows.join(there, "id", "left_anti")
        self._store(missing)
        return self._enter(state)

    def _covered(self, state: dict[str, Any]) -> dict[str, Any]:
        """The version whose URL index holds all articles, those added by :meth:`append` included."""
        if not state.get("behind"):
            return state
        facts = self.facts()
        known = self.index.known({"runs": state["runs"]}, facts)
        missing = facts.select("url").join(known.distinct(), "url", "left_anti").distinct()
        self.index.add(state, missing, missing.count())
        state["highest"] = facts.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        return self.snapshots.commit({**state, "behind": False})

    # --- calendar and aggregate ---

    def rebuild(self) -> None:
        """Replaces calendar and aggregate by those of all stored facts, in one commit."""
        state = self._settled()
        # The calendar's days are those of the total rows just written, so the facts are read once.
        run = self.snapshots.write("aggregate", self._packed(daily_partials(self.facts())))
        days = self.snapshots.read([run], PARTIAL_SCHEMA).where("est_total").select("date")
        self._replace(state, "aggregate", run)
        self._replace(state, "calendar", self.snapshots.write("calendar", calendar_of(days).coalesce(1)))
        self._applied(state)

    def refresh_days(self, days: DataFrame | Sequence[str] | None = None) -> None:
        """Brings aggregate and calendar up to date, in one commit.

        Without ``days``: adds the partial sums of the lots that wait for it, each exactly once and
        however late their days are; neither stored articles nor other days are read. With ``days``
        (one date column, NULL left out, or strict day texts): recomputes these days from the facts
        and replaces them as a whole, whatever became of their articles; other days stay as they are.
        """
        state = self._settled()
        lots = state.get("waiting", [])
        arrived = [daily_partials(self._lot(lot)) for lot in lots]
        if days is None:
            if lots:
                self._fold(state, arrived)
                self._applied(state)
            return
        if not isinstance(days, DataFrame):
            days = self.spark.createDataFrame([(calendar_day(d),) for d in days], "jour date")
        wanted = days.select(F.col(days.columns[0]).alias("jour")).where("jour IS NOT NULL").distinct()
        dates = [r[0] for r in wanted.collect()]  # the calendar bounds them
        if not dates:
            return
        # The recomputed days hold the waiting lots already; of these, only the other days are added.
        others = [self._partials(state), *arrived]
        others = [p.where(~F.col("date").isin(dates)) for p in others]
        self._fold(state, [*others, daily_partials(self._facts_of(dates))], replace=True)
        self._applied(state)

    def _partials(self, state: dict[str, Any]) -> DataFrame:
        return self.snapshots.read(state["runs"].get("aggregate", []), PARTIAL_SCHEMA)

    @staticmethod
    def _packed(partials: DataFrame) -> DataFrame:
        return partials.hint("rebalance")

    def _fold(self, state: dict[str, Any], parts: list[DataFrame], replace: bool = False) -> None:
        """Puts partial sums into the state: as a further run, or in place of all runs. Enters their new days."""
        runs = state["runs"].setdefault("aggregate", [])
        if not replace and len(runs) + 1 > SMALL_RUNS:
            parts, replace = [self._partials(state), *parts], True
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        run = self.snapshots.write("aggregate", self._packed(summed(rows)))
        days = self.snapshots.read([run], PARTIAL_SCHEMA).where("est_total").select("date").distinct()
        if replace:
            self._replace(state, "aggregate", run)
        else:
            runs.append(run)
        self._enter_days(state, days)

    def _enter_days(self, state: dict[str, Any], days: DataFrame) -> None:
        runs = state["runs"].setdefault("calendar", [])
        held = self.snapshots.read(runs, CALENDAR_SCHEMA)
        missing = [r[0] for r in days.join(held.select(F.col("date_complete").alias("date")), "date", "left_anti").collect()]
        if not missing:  # the calendar bounds them
            return
        rows = calendar_of(self.spark.createDataFrame([(d,) for d in missing], "date date"))
        if len(runs) + 1 > SMALL_RUNS:
            self._replace(state, "calendar", self.snapshots.write("calendar", held.unionByName(rows).coalesce(1)))
        else:
            runs.append(self.snapshots.write("calendar", rows.coalesce(1)))

    def _replace(self, state: dict[str, Any], table: str, run: str) -> None:
        self.snapshots.drop(state, state["runs"].get(table, []))
        state["runs"][table] = [run]

    def _applied(self, state: dict[str, Any]) -> None:
        """Commits; the lots that waited are in the aggregate, and their staged rows no longer needed."""
        self.snapshots.drop(state, [lot["stage"] for lot in state.get("waiting", [])])
        self.snapshots.commit({**state, "waiting": []})

    def _facts_of(self, dates: list) -> DataFrame:
        """Facts of some days (None: without a day), opened by their folders: files of other days are not even listed."""
        there = set(self.snapshots.files.names(self.articles_path))
        names = [f"jour={d.isoformat() if d else '__HIVE_DEFAULT_PARTITION__'}" for d in dates]
        folders = [f"{self.articles_path}/{n}" for n in names if n in there]
        if not folders:
            return self.spark.createDataFrame([], FACT_SCHEMA)
        return self.spark.read.schema(FACT_SCHEMA).option("basePath", self.articles_path).parquet(*folders)

    @staticmethod
    def touched_days(batch: DataFrame) -> DataFrame:
        """``jour``: the distinct publication days of a batch."""
        return batch.select(day_of(F.col("date_article")).alias("jour")).where("jour IS NOT NULL").distinct()

    # --- second labels ---

    def update_labels(self, updates: DataFrame, order: str | None = None) -> None:
        """Adds second labels by URL; of several for a URL the last by ``order`` holds.

        Articles are not rewritten, so labels and new articles may arrive at once. Labels of a later
        call supersede earlier ones; merging runs of labels leaves the superseded ones behind.
        """
        state = self._settled()
        ranked = updates.withColumn("ordre", F.col(order) if order else F.struct(*LABEL_COLUMNS))
        last = last_per_key(ranked, "url", LABEL_COLUMNS, "ordre")
        rows = last.select("url", *LABEL_COLUMNS, F.lit(time.time_ns()).alias("lot"))
        runs = state["runs"].setdefault("labels", [])
        added = self._write_labels(rows)
        if not added["rows"]:
            return
        runs.append(added)
        while due := by_tier(runs, LABEL_FANOUT, LABEL_SMALLEST):
            merged = self._write_labels(self._last_labels(due, "lot"))
            runs[:] = [r for r in runs if r not in due] + [merged]
            self.snapshots.drop(state, [r["run"] for r in due])
        self.snapshots.commit(state)

    def _write_labels(self, rows: DataFrame) -> dict[str, Any]:
        run = self.snapshots.write("labels", rows.hint("rebalance"))
        return {"run": run, "rows": self.snapshots.read([run], LABEL_SCHEMA).count()}

    def _last_labels(self, runs: list[dict[str, Any]], *more: str) -> DataFrame:
        """The last labels of each URL in the given runs."""
        rows = self.snapshots.read([r["run"] for r in runs], LABEL_SCHEMA)
        if len(runs) == 1:  # a run holds a URL once
            return rows.select("url", *LABEL_COLUMNS, *more)
        return last_per_key(rows, "url", [*LABEL_COLUMNS, *more], "lot")
