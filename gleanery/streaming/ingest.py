"""Continuous ingestion: append new articles, keep the daily aggregate exact."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.labels import score_pairs
from ..model import EVENT_SCHEMA
from ..operators.classify import label_updates, labels_from_scores
from ..operators.ingest import rejected
from ..operators.normalize import candidates, from_candidates
from ..sources.store import Store

log = logging.getLogger(__name__)

_PLACE = ["_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start"]


#: Files of a micro-batch; it bounds what one batch holds, a backlog included.
FILES_PER_TRIGGER = 1000


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Events from a folder of JSON-lines files, with what is needed to rank their arrival."""
    schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path).select("*", F.struct(*_PLACE).alias("lieu"))


def ingest_step(
    store: Store, now: Callable[[], dt.datetime] | None = None, rejects_path: str | None = None
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` body. Safe to replay: the URL check skips rows already stored."""

    def step(batch: DataFrame, epoch: int) -> None:
        clock = now() if now else dt.datetime.now(dt.timezone.utc)
        # The rank inside one split comes last: files are ranked by age, then name and position.
        arrival = F.struct("lieu", F.monotonically_increasing_id().alias("n"))
        # Read once, for the URL check, the write and the rejects; only new rows are normalised.
        # Kept in files: a cache takes the executors' heap from the sorts, and a lost executor's part is read again.
        with store.kept(batch.withColumn("arrivee", arrival).drop("lieu")) as events:
            store.append_new(candidates(events), "arrivee", lambda rows: from_candidates(rows, clock))
            if rejects_path:
                # A folder per batch: a replay replaces what it wrote.
                rejected(events).drop("arrivee").write.mode("overwrite").json(f"{rejects_path}/lot={epoch}")
        _refresh(store, epoch)

    return step


def _refresh(store: Store, epoch: int) -> None:
    # The store knows which lots its aggregate lacks, so a replay after a crash, which has nothing
    # new to append, still brings it up to date.
    try:
        store.refresh_days()
    except Exception:
        # The facts are stored; the next refresh or Store.rebuild repairs the aggregate.
        log.exception("aggregate refresh failed for batch %s", epoch)


def start_ingest(
    events: DataFrame,
    store: Store,
    checkpoint: str,
    now: Callable[[], dt.datetime] | None = None,
    rejects_path: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Runs :func:`ingest_step` over a stream; ``checkpoint`` must be on shared storage."""
    writer = events.writeStream.foreachBatch(ingest_step(store, now, rejects_path)).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def store_responses(store: Store, responses: DataFrame, order: str | None = None) -> DataFrame:
    """Labels stored articles from classifier responses ``url, reponse``; returns the labelled rows.

    Of several responses for a URL the last usable one by ``order`` holds; name it wherever URLs
    can repeat. Failed ones change nothing, so their articles stay queued.
    """
    labelled = labels_from_scores(responses, score_pairs(F.col("reponse")))
    store.update_labels(label_updates(labelled, "url", *([order] if order else [])), order)
    return labelled
