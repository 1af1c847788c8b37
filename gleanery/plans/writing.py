"""Queries that store something and read it back: files, ingestion, refresh, streaming."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonarrays import as_array
from ..model import LABEL_HYPOTHESES
from ..operators import sampling
from ..operators.ingest import ingest_batch, legacy_batch
from ..operators.normalize import candidates, from_candidates
from ..session import work_dir
from ..sources import files
from ..sources.store import Store
from ..sources.tables import table
from ..streaming.ingest import event_stream, start_ingest, store_responses
from ..streaming.trend import TrendTable, start_trend
from . import batch
from .catalog import Query
from .checks import LINES_SQL, NOW, PICKED_SQL, STORED_SELECT, annotation_lines, stored_view
from .views import ARTICLES_SQL, DOCUMENTS_SQL, RECORDS_SQL, annotated_documents, articles, event_records

CLOCK = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)

# --- files ---------------------------------------------------------------------------------


def _csv(spark: SparkSession, folder: str) -> DataFrame:
    """Whole document texts, line breaks and quotes included, through a CSV extract."""
    d = table(spark, folder, "documents")
    path = work_dir(spark, "csv")
    rows = d.select(F.col("doc_id").alias("id"), F.col("text").alias("titre"), "source")
    files.write_csv(rows, path)
    return files.read_extract_csv(spark, path, rows.schema)


# Rows of an envelope in memory, and of a file that holds one JSON value.
ENVELOPE_ROWS = 1000
FILE_ROWS = 10_000


def _envelope(spark: SparkSession, folder: str) -> DataFrame:
    """Articles through export envelopes of at most ``ENVELOPE_ROWS`` rows each."""
    a = articles(spark, folder)
    lot = F.floor(F.col("id") / ENVELOPE_ROWS).alias("lot")
    body = F.to_json(F.array(F.struct(F.collect_list(F.struct(*a.columns)).alias("results"))), {"ignoreNullFields": "false"})
    # Order keys are unique, so a lot cannot outgrow its number of keys.
    return files.envelope_rows(a.groupBy(lot).agg(body.alias("value")))


def _extract(spark: SparkSession, folder: str) -> DataFrame:
    return files.extract_columns(articles(spark, folder))


def _envelope_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same through files of one envelope each."""
    a = articles(spark, folder)
    path = work_dir(spark, "envelopes")
    lot = F.floor(F.col("id") / FILE_ROWS).alias("lot")
    results = F.collect_list(F.struct(*a.columns)).alias("results")
    body = F.to_json(F.array(F.struct(results)), {"ignoreNullFields": "false"})
    a.groupBy(lot).agg(body.alias("value")).write.partitionBy("lot").text(path)
    return files.read_envelope(spark, path)


def _annotation_file(spark: SparkSession, folder: str) -> DataFrame:
    """Annotation lines written below their header, in order, and numbered as they are read back."""
    path = work_dir(spark, "annotations")
    header = spark.createDataFrame([(-1, "id,themes_manuels")], "ligne long, texte string")
    lines = annotation_lines(spark, folder).unionByName(header)
    ordered = lines.repartitionByRange("ligne").sortWithinPartitions("ligne")
    ordered.select(F.concat("texte", F.lit("\r")).alias("texte")).write.text(path)
    return files.read_annotation_lines(spark, path)


def _suggestion_map(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of documents through JSON maps from id to labels."""
    d = annotated_documents(spark, folder)
    path = work_dir(spark, "suggestions")
    entry = F.struct(F.col("id").cast("string"), as_array(d, "themes_ml"))
    lot = F.floor(F.col("id") / FILE_ROWS).alias("lot")
    maps = d.groupBy(lot).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    maps.write.partitionBy("lot").text(path)
    return files.read_suggestions(spark, path).select("id", F.array_join("themes", "|").alias("themes"))


def _batch_report(spark: SparkSession, folder: str) -> DataFrame:
    """CSV extract in, three CSV reports out; read back as one table."""
    root = work_dir(spark, "batch")
    files.write_csv(files.extract_columns(articles(spark, folder)), f"{root}/extract")
    batch.run(files.read_extract_csv(spark, f"{root}/extract"), f"{root}/out")
    schemas = {
        "freq_themes": "cle string, detail string, nb long, valeur string",
        "cooccurrences_tags": "cle string, detail string, nb long",
        "tendances_hebdo": "cle string, nb long, valeur string",
    }
    rows = [
        spark.read.schema(schema).options(header="true", enforceSchema="true").csv(f"{root}/out/{name}").withColumn("rapport", F.lit(name))
        for name, schema in schemas.items()
    ]
    both = rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True)
    return both.select("rapport", F.when(F.col("rapport") == "tendances_hebdo", F.substring("cle", 1, 10)).otherwise(F.col("cle")).alias("cle"), "detail", "nb", "valeur")


def _sheet_file(spark: SparkSession, folder: str) -> DataFrame:
    """The annotator's sample, sorted by id, through its JSON file."""
    path = work_dir(spark, "sample")
    files.write_sample(sampling.sample_sheet(sampling.stratified_sample(articles(spark, folder))), path)
    return spark.read.schema("id long, titre string, resume string, source string, url string").json(path)


def _legacy(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    status = F.col("o_orderstatus")
    path = work_dir(spark, "legacy")
    o.select(
        F.concat(F.lit("Order "), "o_orderkey").alias("title"),
        F.concat(F.lit("https://clients.example/"), "o_custkey").alias("link"),
        F.when(status != "P", F.concat(F.lit("etat "), status)).alias("source"),
        (F.length("o_orderpriority") % 6).alias("score"),
        F.array(F.col("o_orderpriority")).alias("tags"),
        F.when(status == "O", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("analyzedAt"),
        F.col("o_orderkey").alias("rang"),
    ).write.json(path)
    # The rank travels in the title, since the format has no field for it.
    records = files.read_legacy(spark, path, multi_line=False)
    ranked = records.withColumn("rang", F.substring_index("title", " ", -1).cast("long"))
    stored = legacy_batch(_no_articles(spark), ranked, NOW, "rang")
    return stored.select("url", "titre", "source", "score_mistral", "tags", "date_collecte")


def _no_articles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id long, url string")


# --- ingestion -----------------------------------------------------------------------------


def _ingest(spark: SparkSession, folder: str) -> DataFrame:
    """All records against a table that already holds the purchases."""
    records = event_records(spark, folder)
    bought = records.where(F.col("source") == "purchase")
    existing = bought.select(F.col("rang").alias("id"), F.col("link").alias("url"))
    fresh, _ = ingest_batch(existing, records, CLOCK, "rang")
    return stored_view(fresh)


def _first_sends(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    records = event_records(spark, folder)
    again = F.col("rang") >= (1 << 40)
    return records.where(~again), records.where(again)


def _filled_store(spark: SparkSession, folder: str) -> Store:
    """A store ingested in two batches; the errors and their second copies arrive late."""
    store = Store(spark, work_dir(spark, "store")).create()
    valid = candidates(event_records(spark, folder))
    late = F.col("source") == "error"
    shape = lambda rows: from_candidates(rows, CLOCK)
    store.append_new(valid.where(~late), "rang", shape)
    store.rebuild()
    second = valid.where(late)
    store.append_new(second, "rang", shape)
    store.refresh_days(store.touched_days(shape(second)))
    return store


def _aggregate(store: Store) -> DataFrame:
    return store.aggregate().withColumn("date", F.col("date").cast("string"))


def _refresh(spark: SparkSession, folder: str) -> DataFrame:
    return _aggregate(_filled_store(spark, folder))


def _stored_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Stored articles labelled from responses: a score below the threshold for the views, none for clicks."""
    store = _filled_store(spark, folder)
    hypotheses = list(LABEL_HYPOTHESES.values())
    facts = store.articles()
    score = F.when(F.col("source") == "inconnu", 0.5).otherwise(0.875)
    pairs = F.array(
        F.struct(F.lit(hypotheses[0]).alias("label"), score.alias("score")),
        F.struct(F.lit(hypotheses[3]).alias("label"), F.lit(0.25).alias("score")),
    )
    body = F.when(F.col("source") == "click", F.lit('{"error": "overloaded"}')).otherwise(F.to_json(pairs))
    # Purchases answer twice, first with a score below the threshold; what came last holds.
    earlier = F.regexp_replace(F.to_json(pairs), "0[.]875", "0.125")
    first = facts.where(F.col("source") == "purchase").select("url", earlier.alias("reponse"), F.lit(1).alias("rang"))
    responses = facts.select("url", body.alias("reponse"), F.lit(2).alias("rang")).unionByName(first)
    store_responses(store, responses, "rang")
    return store.articles().select("url", "titre", "themes_ml", "score_confiance_ml")


def _streamed(spark: SparkSession, folder: str) -> Store:
    """The records as files read by a stream that is stopped and resumed between two deliveries."""
    root = work_dir(spark, "stream")
    store = Store(spark, root).create()
    for delivery in _first_sends(spark, folder):
        delivery.drop("rang").write.mode("append").json(f"{root}/incoming")
        stream = event_stream(spark, f"{root}/incoming")
        start_ingest(stream, store, f"{root}/progress", lambda: CLOCK, f"{root}/rejects").awaitTermination()
    return store


def _stream_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return _streamed(spark, folder).calendar().withColumn("date_complete", F.col("date_complete").cast("string"))


def _stream_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Rejects of a stream that is delivered twice: sign-ups lack a title, and come once more cut short."""
    root = work_dir(spark, "rejects")
    store = Store(spark, root).create()
    records = event_records(spark, folder)
    records.drop("rang").write.json(f"{root}/incoming")
    cut = records.where(F.col("source") == "signup").select(F.concat(F.lit('{"link":"'), "link", F.lit('","title')).alias("value"))
    cut.write.mode("append").text(f"{root}/incoming")
    for attempt in ("a", "b"):  # a lost checkpoint: every batch is replayed under its number
        stream = event_stream(spark, f"{root}/incoming")
        start_ingest(stream, store, f"{root}/progress-{attempt}", lambda: CLOCK, f"{root}/refus").awaitTermination()
    return spark.read.schema("motif string, link string, ligne string").json(f"{root}/refus").drop("lot")


def _stream_facts(spark: SparkSession, folder: str) -> DataFrame:
    return stored_view(_streamed(spark, folder).articles())


def _stream_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return _aggregate(_streamed(spark, folder))


def _stream_trend(spark: SparkSession, folder: str) -> DataFrame:
    """The events' weekly trend from a stream that is stopped and resumed between two deliveries, out of order."""
    root = work_dir(spark, "trend")
    events = table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    weeks = TrendTable(spark, f"{root}/trend")
    for late in (F.col("event_id") % 3 != 0, F.col("event_id") % 3 == 0):
        events.where(late).write.mode("append").parquet(f"{root}/incoming")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/incoming")
        start_trend(stream, "ts", weeks, f"{root}/progress", lateness="60 days").awaitTermination()
    return weeks.trend().withColumn("semaine", F.col("semaine").cast("string"))


class _FailingRefresh(Store):
    """A store whose aggregate cannot be refreshed, as with a lost cluster of readers."""

    def refresh_days(self, days=None) -> None:
        raise RuntimeError("no refresh")


def _repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The stream with every refresh failing: nothing sent is lost, the aggregate stays empty, a rebuild repairs it."""
    root = work_dir(spark, "repair")
    broken = _FailingRefresh(spark, root).create()
    event_records(spark, folder).drop("rang").write.json(f"{root}/incoming")
    stream = event_stream(spark, f"{root}/incoming")
    start_ingest(stream, broken, f"{root}/progress", lambda: CLOCK).awaitTermination()
    store = Store(spark, root)
    left = store.aggregate().count()
    store.rebuild()
    return _aggregate(store).withColumn("avant", F.lit(left))


_STORED_DAYS = f"""WITH {RECORDS_SQL}
SELECT CAST(jour AS VARCHAR) AS date, false AS est_total, theme AS thematique, count(*) AS nb_articles,
  avg(score_mistral) AS score_moyen FROM (SELECT jour, score_mistral, unnest(m) AS theme FROM stored)
WHERE jour IS NOT NULL GROUP BY ALL
UNION ALL
SELECT CAST(jour AS VARCHAR), true, NULL, count(*), avg(score_mistral) FROM stored WHERE jour IS NOT NULL GROUP BY jour"""

_PLAIN = """SELECT id, titre, url, resume, source, categorie_mistral, score_mistral, themes_mistral, themes_ml,
  score_confiance_ml, tags, date_article, date_collecte FROM articles"""

_REPORT_SQL = f"""WITH {ARTICLES_SQL},
tagged AS (SELECT DISTINCT id, unnest(t) AS tag FROM articles),
pairs AS (
  SELECT a.tag AS cle, b.tag AS detail, count(*) AS nb FROM tagged a JOIN tagged b ON a.id = b.id AND a.tag < b.tag
  GROUP BY ALL HAVING count(*) >= 5 ORDER BY nb DESC, cle, detail LIMIT 50),
weeks AS (
  SELECT time_bucket(INTERVAL '7 days', ts_article, TIMESTAMP '1970-01-01') AS semaine, count(*) AS nb
  FROM articles WHERE ts_article IS NOT NULL GROUP BY 1)
SELECT 'freq_themes' AS rapport, theme AS cle, origine AS detail, count(*) AS nb,
  CASE WHEN theme = 'Produktivité/Outils' THEN 'true' ELSE 'false' END AS valeur
FROM (SELECT unnest(m) AS theme, 'mistral' AS origine FROM articles UNION ALL SELECT unnest(b), 'ml' FROM articles) GROUP BY ALL
UNION ALL SELECT 'cooccurrences_tags', cle, detail, nb, NULL FROM pairs
UNION ALL SELECT 'tendances_hebdo', CAST(CAST(semaine AS DATE) AS VARCHAR), NULL, nb,
  CAST(CAST(round(CAST(avg(nb) OVER (ORDER BY semaine ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS VARCHAR)
FROM weeks"""

QUERIES = {
    "csv_round_trip": Query(_csv, "SELECT doc_id AS id, text AS titre, source FROM documents"),
    "envelope_scan": Query(_envelope, f"WITH {ARTICLES_SQL} {_PLAIN}"),
    "batch_extract": Query(
        _extract,
        f"""WITH {ARTICLES_SQL} SELECT id, titre, url, source, date_article, themes_mistral, themes_ml,
        score_confiance_ml, tags FROM articles""",
    ),
    "json_sheet": Query(_sheet_file, f"WITH {ARTICLES_SQL}, {PICKED_SQL} SELECT id, titre, resume, source, url FROM picked"),
    "envelope_files": Query(_envelope_files, f"WITH {ARTICLES_SQL} {_PLAIN}"),
    "annotation_file": Query(
        _annotation_file, f"WITH {LINES_SQL} SELECT row_number() OVER (ORDER BY ligne) + 1 AS ligne, texte FROM judged"
    ),
    "suggestion_map": Query(
        _suggestion_map, f"WITH {DOCUMENTS_SQL} SELECT id, coalesce(array_to_string(b, '|'), '') AS themes FROM docs"
    ),
    "batch_report": Query(_batch_report, _REPORT_SQL),
    "legacy_import": Query(
        _legacy,
        f"""SELECT 'https://clients.example/' || o_custkey AS url, 'Order ' || o_orderkey AS titre,
          'etat ' || o_orderstatus AS source, CAST(length(o_orderpriority) % 6 AS INTEGER) AS score_mistral,
          '["' || o_orderpriority || '"]' AS tags,
          CASE WHEN o_orderstatus = 'O' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '{NOW}' END AS date_collecte
        FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders
              WHERE o_orderstatus <> 'P') WHERE r = 1""",
    ),
    "ingest_new_only": Query(_ingest, f"WITH {RECORDS_SQL} {STORED_SELECT} WHERE source <> 'purchase'"),
    "day_refresh": Query(_refresh, _STORED_DAYS),
    "stored_label_update": Query(
        _stored_labels,
        f"""WITH {RECORDS_SQL} SELECT url, titre,
          CASE source WHEN 'click' THEN NULL WHEN 'inconnu' THEN '[]' ELSE '["IA/ML"]' END AS themes_ml,
          CASE source WHEN 'click' THEN NULL WHEN 'inconnu' THEN 0.5::DOUBLE ELSE 0.875::DOUBLE END AS score_confiance_ml
        FROM stored""",
    ),
    "stream_calendar": Query(
        _stream_calendar,
        f"""WITH {RECORDS_SQL} SELECT DISTINCT CAST(jour AS VARCHAR) AS date_complete, CAST(year(jour) AS INTEGER) AS annee,
          CAST(month(jour) AS INTEGER) AS mois, CAST(strftime(jour, '%W') AS INTEGER) AS semaine,
          CAST(strftime(jour, '%w') AS INTEGER) AS jour_semaine FROM stored WHERE jour IS NOT NULL""",
    ),
    "stream_rejects": Query(
        _stream_rejects,
        """SELECT 'title missing' AS motif, 'https://events.example/' || event_id AS link, CAST(NULL AS VARCHAR) AS ligne
        FROM events WHERE event_type = 'signup'
        UNION ALL SELECT 'unreadable JSON', NULL, '{"link":"https://events.example/' || event_id || '","title'
        FROM events WHERE event_type = 'signup'""",
    ),
    "stream_ingest": Query(_stream_facts, f"WITH {RECORDS_SQL} {STORED_SELECT}"),
    "stream_aggregate": Query(_stream_aggregate, _STORED_DAYS),
    "stream_trend": Query(
        _stream_trend,
        """SELECT CAST(CAST(semaine AS DATE) AS VARCHAR) AS semaine, nb_articles,
          CAST(round(CAST(avg(nb_articles) OVER (ORDER BY semaine ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS DECIMAL(18, 6)), 2) AS DOUBLE)
            AS moyenne_glissante_4s
        FROM (SELECT time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS semaine, count(*) AS nb_articles
              FROM events WHERE ts IS NOT NULL GROUP BY 1)""",
    ),
    "failed_refresh_repair": Query(_repaired, f"SELECT *, CAST(0 AS BIGINT) AS avant FROM ({_STORED_DAYS})"),
}
