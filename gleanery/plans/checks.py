"""Queries on health, data contracts, normalisation, annotations and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import ISO_FORMAT, normalize_date
from ..functions.jsonarrays import as_array, parse_json_array
from ..functions.labels import join_labels
from ..model import LABELS
from ..operators import agreement, annotations, health, quality, sampling, stats
from ..operators.ingest import rejected
from ..operators.normalize import from_events, reject_reason
from ..sources.tables import table
from .catalog import Query
from .views import ARTICLES_SQL, DOCUMENTS_SQL, ISO, RECORDS_SQL, annotated_documents, articles, event_records

NOW = "2001-09-08T12:00:00.000Z"


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([ARTICLES_SQL, *ctes]) + f"\n{body}"


# --- health and contracts ------------------------------------------------------------------


def _health(spark: SparkSession, folder: str) -> DataFrame:
    return health.health_report(articles(spark, folder), NOW).select(
        "statut",
        "collecte.dernier_article_collecte",
        "collecte.jours_depuis",
        F.col("collecte.statut").alias("statut_collecte"),
        "classification.total",
        "classification.ml_en_retard",
        "classification.ml_sans_theme",
        "classification.mistral_manquants",
        F.col("classification.statut").alias("statut_classification"),
    )


def _health_by_dates(spark: SparkSession, folder: str) -> DataFrame:
    return health.health_by_dates(articles(spark, folder), NOW)


_COUNTERS_SQL = f"""counters AS (
  SELECT max(date_collecte) AS dernier_article_collecte, count(*) AS total,
    count(*) FILTER (themes_ml IS NULL AND date_collecte < '2001-09-07T12:00:00.000Z') AS ml_en_retard,
    count(*) FILTER (themes_ml = '[]') AS ml_sans_theme, count(*) FILTER (themes_mistral IS NULL) AS mistral_manquants,
    (epoch_us(TIMESTAMP '2001-09-08 12:00:00') - epoch_us(max(ts_collecte))) / 86400000000.0 AS age FROM articles),
judged AS (
  SELECT * EXCLUDE (age), CAST(floor(age) AS INTEGER) AS jours_depuis,
    CASE WHEN age < 4 THEN 'ok' WHEN age < 15 THEN 'degrade' ELSE 'alerte' END AS statut_collecte,
    CASE WHEN ml_en_retard > 0 THEN 'alerte' ELSE 'ok' END AS statut_classification FROM counters)"""


def _dates(spark: SparkSession, folder: str) -> DataFrame:
    return quality.date_contract(articles(spark, folder))


def _collect_dates(spark: SparkSession, folder: str) -> DataFrame:
    return quality.collect_contract(articles(spark, folder))


def _article_dates_as_collected(spark: SparkSession, folder: str) -> DataFrame:
    return quality.collect_contract(articles(spark, folder), "date_article")


# --- normalisation -------------------------------------------------------------------------


def _order_date_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One text form per priority, and others for open orders: mail, ISO, month-first and slashed forms, and junk."""
    o = table(spark, folder, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    prio = F.substring("o_orderpriority", 1, 1)
    ymd = F.date_format(day, "yyyy-MM-dd")
    closed = (
        F.when(prio == "1", F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 23:35:22 +0000")))
        .when(prio == "2", F.concat(F.date_format(day, "d MMMM yyyy"), F.lit(" 07:05 EST")))
        .when(prio == "3", F.concat(ymd, F.lit("T07:36:00-08:00")))
        .when(prio == "4", F.concat(F.lit("  "), ymd))
        .otherwise(F.concat(F.lit("T"), F.date_format(day, "HH:mm")))
    )
    opened = (
        F.when(prio == "1", F.concat(ymd, F.lit("T10:00Z")))
        .when(prio == "2", F.concat(F.date_format(day, "EEE, dd MMM yyyy"), F.lit(" 10:00:00 +01:00")))
        .when(prio == "3", F.date_format(day, "MMM d, yyyy"))
        .when(prio == "4", F.date_format(day, "MM/dd/yyyy"))
        .otherwise(F.date_format(day, "yyyy/M/d"))
    )
    short = F.when(prio <= "2", F.date_format(day, "yyyy")).otherwise(F.date_format(day, "yyyy-MM"))
    status = F.col("o_orderstatus")
    raw = F.when(status == "F", closed).when(status == "O", opened).otherwise(short)
    return o.select(F.col("o_orderkey").alias("id"), raw.alias("brut"))


def _normalized_dates(spark: SparkSession, folder: str) -> DataFrame:
    return _order_date_texts(spark, folder).select("id", normalize_date(F.col("brut")).alias("date_article"))


def _decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Label texts as arrays: sound ones, a number among them, and all that must count as absent."""
    o = table(spark, folder, "orders")
    name = F.concat(F.lit('"client '), "o_custkey", F.lit('"'))
    forms = {
        "1F": ("[", name, ', "b"]'), "2F": (" [ ", name, " ]\n"), "3F": ("[", F.lit(""), "]"), "4F": ("[", name, ""),
        "5F": ("[", name, '],"w":[1]'), "1O": ("[", name, ", 3]"), "2O": ("[", name, ']} ["b"]'), "3O": ("[", name, '], ["b"]'),
        "4O": ('{"a": [', name, "]}"), "5O": ("", name, ""), "1P": ("[", name, "]] [1]"), "2P": ("[", name, "]x"),
    }
    form = F.concat(F.substring("o_orderpriority", 1, 1), "o_orderstatus")
    texts = [F.when(form == k, F.concat(F.lit(a), v, F.lit(b))) for k, (a, v, b) in forms.items()]
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(parse_json_array(F.coalesce(*texts)), "|").alias("themes"))


_STORED_COLUMNS = ["url", "titre", "resume", "source", "categorie_mistral", "score_mistral", "tags", "date_article"]


def stored_view(rows: DataFrame) -> DataFrame:
    """Stored columns with the label array joined, for comparison."""
    themes = F.array_join(as_array(rows, "themes_mistral"), "|").alias("themes")
    return rows.select(*_STORED_COLUMNS, themes)


STORED_SELECT = f"SELECT {', '.join(_STORED_COLUMNS)}, array_to_string(m, '|') AS themes FROM stored"


def _normalized(spark: SparkSession, folder: str) -> DataFrame:
    records = event_records(spark, folder).where(reject_reason().isNull())
    return stored_view(from_events(records, NOW))


def _rejected(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(event_records(spark, folder)).select("rang", "link", "motif")


# --- annotations ---------------------------------------------------------------------------


def annotation_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``conversations`` as annotation lines: one per turn, its conversation as the id."""
    c = table(spark, folder, "conversations")
    size = F.length("text")
    cell = (
        F.when((F.col("role") == "user") & (size % 5 == 0), "")
        .when(F.col("role") == "user", F.lit('"Sécurité | IA/ML|"'))
        .when(F.col("role") == "assistant", F.when(size % 3 == 0, "").otherwise("Développement"))
        .otherwise("Infrastructure")
    )
    text = (
        F.when(size % 17 == 0, F.concat(F.lit("ligne "), "conv_id"))
        .when(size % 13 == 0, F.concat(F.lit("n"), "conv_id", F.lit(","), cell))
        .otherwise(F.concat("conv_id", F.lit(" ,"), cell))
    )
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("ligne"), text.alias("texte"))


def _validated(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    known = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"))
    return annotations.validate_annotations(annotation_lines(spark, folder), known)


def _valid(spark: SparkSession, folder: str) -> DataFrame:
    return annotations.canonical_sheet(_validated(spark, folder)[0])


def _rejects(spark: SparkSession, folder: str) -> DataFrame:
    return _validated(spark, folder)[1]


def _distribution(spark: SparkSession, folder: str) -> DataFrame:
    return stats.label_distribution(_validated(spark, folder)[0], "themes")


def _empty(spark: SparkSession, folder: str) -> DataFrame:
    return annotations.without_label(_validated(spark, folder)[0])


def _concordance(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.concordance(annotated_documents(spark, folder), "themes_mistral", "themes_ml")


LINES_SQL = """lines AS (
  SELECT conv_id * 100000 + turn AS ligne, conv_id AS id, length(text) AS size,
    CASE role WHEN 'user' THEN CASE WHEN length(text) % 5 = 0 THEN '' ELSE '"Sécurité | IA/ML|"' END
      WHEN 'assistant' THEN CASE WHEN length(text) % 3 = 0 THEN '' ELSE 'Développement' END
      ELSE 'Infrastructure' END AS cell,
    CASE role WHEN 'user' THEN CASE WHEN length(text) % 5 = 0 THEN '' ELSE 'IA/ML|Sécurité' END
      WHEN 'assistant' THEN CASE WHEN length(text) % 3 = 0 THEN '' ELSE 'Développement' END
      ELSE 'Infrastructure' END AS themes FROM conversations),
judged AS (
  SELECT *, CASE WHEN size % 17 = 0 THEN 'ligne ' || id WHEN size % 13 = 0 THEN 'n' || id || ',' || cell
      ELSE id || ' ,' || cell END AS texte,
    CASE WHEN size % 17 = 0 THEN 'no comma' WHEN size % 13 = 0 THEN 'id is not an integer'
      WHEN id NOT IN (SELECT item_id FROM benchmark) THEN 'unknown id'
      WHEN ligne > min(CASE WHEN size % 17 <> 0 AND size % 13 <> 0 THEN ligne END) OVER (PARTITION BY id) THEN 'duplicate id'
      WHEN themes = 'Infrastructure' THEN 'unknown label' END AS motif FROM lines)"""

_DISTRIBUTION = ", ".join(f"({i}, '{x}')" for i, x in enumerate(LABELS))

# --- samples -------------------------------------------------------------------------------


def _sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample_sheet(sampling.stratified_sample(articles(spark, folder)))


def _greedy(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample_sheet(sampling.greedy_sample(articles(spark, folder)))


def _coverage(spark: SparkSession, folder: str) -> DataFrame:
    sample = sampling.stratified_sample(articles(spark, folder))
    return stats.sample_coverage(sample)[0]


def _source_coverage(spark: SparkSession, folder: str) -> DataFrame:
    sample = sampling.stratified_sample(articles(spark, folder))
    return stats.sample_coverage(sample)[1]


def _sheet(spark: SparkSession, folder: str) -> DataFrame:
    a = articles(spark, folder)
    confident = a.where(F.col("score_confiance_ml") >= 0.5)
    suggested = confident.select("id", as_array(a, "themes_ml").alias("themes"))
    sheet = annotations.annotation_sheet(a, suggested)
    return sheet.select("id", "titre", "url", join_labels(F.col("themes")).alias("themes_manuels"))


PICKED_SQL = """per AS (SELECT id, source, unnest(list_filter(m, lambda x: x <> 'Produktivité/Outils')) AS theme FROM articles),
r AS (SELECT *, row_number() OVER (PARTITION BY theme, source ORDER BY id) AS r1 FROM per),
q AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY r1, id) AS r2 FROM r),
picked AS (SELECT * FROM articles WHERE id IN (SELECT id FROM q WHERE r2 <= 15))"""

_LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"

# The sequential rule step by step: 15 turns for each label, then 100 over all of them. A turn takes the lowest
# id among the sources used least so far; used sources are counted from those of the ids taken.
_GREEDY_SQL = f"""WITH RECURSIVE {ARTICLES_SQL},
pool AS (
  SELECT id, source, unnest(list_append(l, '')) AS stratum
  FROM (SELECT id, source, list_filter(m, lambda x: x <> 'Produktivité/Outils') AS l FROM articles) WHERE len(l) > 0),
turns AS (
  SELECT range AS turn, CASE WHEN range < 105 THEN ({_LABEL_LIST})[range // 15 + 1] ELSE '' END AS stratum
  FROM range(205)),
steps AS (
  SELECT 0 AS turn, CAST([] AS BIGINT[]) AS taken, CAST([] AS VARCHAR[]) AS used
  UNION ALL
  SELECT s.turn + 1, CASE WHEN b.best IS NULL THEN s.taken ELSE list_append(s.taken, b.best.id) END,
    CASE WHEN b.best IS NULL THEN s.used ELSE list_append(s.used, b.best.source) END
  FROM steps s JOIN (
    SELECT x.turn, arg_min({{'id': p.id, 'source': p.source}}, {{'n': len(list_filter(x.used, lambda u: u = p.source)), 'id': p.id}})
        FILTER (p.id IS NOT NULL AND len(x.taken) < 100 AND NOT list_contains(x.taken, p.id)) AS best
    FROM steps x JOIN turns t ON t.turn = x.turn LEFT JOIN pool p ON p.stratum = t.stratum GROUP BY x.turn) b ON b.turn = s.turn
  WHERE s.turn < 205)
SELECT id, titre, resume, source, url FROM articles
WHERE id IN (SELECT unnest(taken) FROM steps WHERE turn = 205)"""

_CANONICAL_B = "list_filter(['" + "', '".join(LABELS) + "'], lambda x: list_contains(b, x))"


QUERIES = {
    "health_report": Query(
        _health,
        _sql(
            """SELECT *, CASE WHEN 'alerte' IN (statut_collecte, statut_classification) THEN 'alerte'
              WHEN 'degrade' IN (statut_collecte, statut_classification) THEN 'degrade' ELSE 'ok' END AS statut FROM judged""",
            _COUNTERS_SQL,
        ),
    ),
    "health_by_dates": Query(_health_by_dates, _sql("SELECT * FROM judged", _COUNTERS_SQL)),
    "date_contract": Query(
        _dates,
        _sql(
            """SELECT count(*) AS total, count(*) FILTER (date_article LIKE '%+02:00') AS hors_contrat,
            count(*) FILTER (date_article IS NULL) AS sans_date FROM articles"""
        ),
    ),
    "collect_contract": Query(
        _collect_dates,
        _sql(
            f"""SELECT count(*) AS total, count(*) FILTER (date_collecte IS NULL) AS nulles,
            count(*) FILTER (try_cast(date_collecte AS TIMESTAMP) IS NULL) AS non_parsables,
            count(*) FILTER (date_collecte IS DISTINCT FROM strftime(ts_collecte, {ISO})) AS hors_format FROM articles"""
        ),
    ),
    "publication_contract": Query(
        _article_dates_as_collected,
        _sql(
            f"""SELECT count(*) AS total, count(*) FILTER (date_article IS NULL) AS nulles,
            count(*) FILTER (ts_article IS NULL) AS non_parsables,
            count(*) FILTER (date_article IS DISTINCT FROM strftime(ts_article, {ISO})) AS hors_format FROM articles"""
        ),
    ),
    "normalized_dates": Query(
        _normalized_dates,
        f"""SELECT o_orderkey AS id, strftime(CASE o_orderstatus || substr(o_orderpriority, 1, 1)
          WHEN 'F1' THEN jour + to_seconds(84922) WHEN 'F2' THEN jour + to_seconds(43500)
          WHEN 'F3' THEN jour + to_seconds(56160) WHEN 'F4' THEN jour WHEN 'F5' THEN NULL
          WHEN 'O1' THEN jour + to_seconds(36000) WHEN 'O2' THEN jour + to_seconds(32400)
          WHEN 'O3' THEN jour WHEN 'O4' THEN jour WHEN 'O5' THEN jour
          WHEN 'P1' THEN date_trunc('year', jour) WHEN 'P2' THEN date_trunc('year', jour)
          ELSE date_trunc('month', jour) END, {ISO}) AS date_article
        FROM (SELECT *, CAST(o_orderdate AS TIMESTAMP) AS jour FROM orders)""",
    ),
    "decoded_labels": Query(
        _decoded,
        """SELECT o_orderkey AS id, CASE substr(o_orderpriority, 1, 1) || o_orderstatus
          WHEN '1F' THEN o_clerk_a || '|b' WHEN '2F' THEN o_clerk_a WHEN '3F' THEN '' WHEN '1O' THEN o_clerk_a || '|3' END AS themes
        FROM (SELECT *, 'client ' || o_custkey AS o_clerk_a FROM orders)""",
    ),
    "normalized_articles": Query(
        _normalized,
        f"""WITH {RECORDS_SQL} {STORED_SELECT}
        UNION ALL {STORED_SELECT.replace(' titre,', " titre || ' bis',")} WHERE source = 'error'""",
    ),
    "rejected_events": Query(
        _rejected,
        """SELECT event_id AS rang, 'https://events.example/' || event_id AS link, 'title missing' AS motif
        FROM events WHERE event_type = 'signup'""",
    ),
    "annotation_validation": Query(
        _valid,
        f"WITH {LINES_SQL} SELECT id, themes AS themes_manuels FROM judged WHERE motif IS NULL",
    ),
    "annotation_rejects": Query(
        _rejects, f"WITH {LINES_SQL} SELECT ligne, texte, motif FROM judged WHERE motif IS NOT NULL"
    ),
    "annotation_distribution": Query(
        _distribution,
        f"""WITH {LINES_SQL}, v AS (SELECT unnest(string_split(themes, '|')) AS theme FROM judged WHERE motif IS NULL)
        SELECT rang, l.theme, count(v.theme) AS nb FROM (VALUES {_DISTRIBUTION}) l(rang, theme)
        LEFT JOIN v ON v.theme = l.theme GROUP BY ALL""",
    ),
    "annotations_without_label": Query(
        _empty, f"WITH {LINES_SQL} SELECT id FROM judged WHERE motif IS NULL AND themes = ''"
    ),
    "annotation_concordance": Query(
        _concordance,
        f"""WITH {DOCUMENTS_SQL}, s AS (SELECT len(list_intersect(m, b)) AS i, len(m) AS x, len(b) AS y FROM docs
          WHERE m IS NOT NULL AND b IS NOT NULL)
        SELECT count(*) AS annotations, count(*) FILTER (x = y AND i = x) AS accord_exact,
          CAST(floor(100.0 * count(*) FILTER (x = y AND i = x) / count(*) + 0.5) AS BIGINT) AS pct_exact,
          floor(avg(i / greatest(x + y - i, 1)) * 1000 + 0.5) / 1000 AS jaccard_moyen FROM s""",
    ),
    "stratified_sample": Query(_sample, _sql("SELECT id, titre, resume, source, url FROM picked", PICKED_SQL)),
    "stratified_sample_greedy": Query(_greedy, _GREEDY_SQL),
    "sample_coverage": Query(
        _coverage,
        _sql(
            f"""SELECT rang, l.theme, count(v.theme) AS nb FROM (VALUES {_DISTRIBUTION}) l(rang, theme)
            LEFT JOIN (SELECT unnest(m) AS theme FROM picked) v ON v.theme = l.theme GROUP BY ALL""",
            PICKED_SQL,
        ),
    ),
    "sample_source_coverage": Query(
        _source_coverage, _sql("SELECT source, count(*) AS nb FROM picked GROUP BY source", PICKED_SQL)
    ),
    "annotation_sheet": Query(
        _sheet,
        _sql(
            f"""SELECT id, titre, url, CASE WHEN score_confiance_ml >= 0.5
            THEN coalesce(array_to_string({_CANONICAL_B}, '|'), '') ELSE '' END AS themes_manuels FROM articles"""
        ),
    ),
}
