"""Weekly volumes as a stateful stream, with the trailing mean on what it has stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.trends import with_trailing_mean
from ..sources.snapshots import Snapshots

SCHEMA = "semaine date, nb_articles long, lot long"
#: Runs before they are folded into one row per week.
RUNS = 8


class TrendTable:
    """Weekly totals below a folder: runs of changed weeks, of which the last holds."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.snapshots = Snapshots(spark, root)

    def weeks(self) -> DataFrame:
        """``semaine, nb_articles``."""
        return self._last(self.snapshots.current()["runs"].get("weeks", [])).select("semaine", "nb_articles")

    def trend(self, rows: int = 4) -> DataFrame:
        """The rows that :func:`trends.weekly_trend` gives for what has arrived."""
        return with_trailing_mean(self.weeks(), rows=rows)

    def _last(self, runs: list[str]) -> DataFrame:
        stored = self.snapshots.read(runs, SCHEMA)
        last = F.max_by(F.struct("nb_articles", "lot"), "lot").alias("last")
        return stored.groupBy("semaine").agg(last).select("semaine", "last.*")

    def store(self, changed: DataFrame, epoch: int) -> None:
        """The ``foreachBatch`` body. Totals replace totals, so a replayed batch changes nothing."""
        state = self.snapshots.current()
        runs = state["runs"].setdefault("weeks", [])
        # Versions order the batches, also across a new checkpoint that counts epochs anew.
        rows = changed.select("semaine", "nb_articles", F.lit(state["version"] + 1).cast("long").alias("lot"))
        runs.append(self.snapshots.write("weeks", rows.coalesce(1)))  # a row per changed week
        if len(runs) > RUNS:
            folded = self.snapshots.write("weeks", self._last(runs).coalesce(1))
            self.snapshots.drop(state, runs)
            state["runs"]["weeks"] = [folded]
        self.snapshots.commit(state)


def start_trend(
    events: DataFrame, moment: str, table: TrendTable, checkpoint: str, lateness: str = "28 days", available_now: bool = True
) -> StreamingQuery:
    """Counts events by week in the state store and keeps ``table`` up to date; ``checkpoint`` must be on shared storage.

    Late data: a row is counted as long as its week ends less than ``lateness`` before the latest moment seen
    (by the batches before); then its week is final, leaves the state, and what still comes for it is left out. The
    state is thus bounded by ``lateness``. Rows without a moment are left out.
    """
    dated = events.where(F.col(moment).isNotNull()).withWatermark(moment, lateness)
    weekly = dated.groupBy(F.window(moment, "7 days").alias("w")).agg(F.count("*").alias("nb_articles"))
    rows = weekly.select(F.to_date("w.start").alias("semaine"), "nb_articles")
    writer = rows.writeStream.outputMode("update").foreachBatch(table.store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
