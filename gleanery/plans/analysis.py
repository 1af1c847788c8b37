"""Analytical queries: pairs, trends, agreement, star schema, regularity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import day_of, parse_iso
from ..functions.labels import usable_scores, zip_scores
from ..model import LABEL_HYPOTHESES, LABELS
from ..operators import agreement, health, kpi, sketches, star, variants
from ..operators.classify import labels_from_scores, outcome_counts
from ..operators.cooccurrence import BUCKETS, item_tags, tag_cooccurrence
from ..operators.trends import fine_trend, weekly_trend
from ..operators.updates import keyed_update
from ..session import work_dir
from ..sources.tables import table
from .catalog import Query
from .views import (
    ARTICLES_SQL,
    DOCUMENT_LABELS,
    DOCUMENTS_SQL,
    SPELLED_SQL,
    annotated_documents,
    articles,
    order_tags,
    spelled_tags,
    vector_scores,
)


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([ARTICLES_SQL, *ctes]) + f"\n{body}"


def _text(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("string") for n in names})


# --- pairs of tags -------------------------------------------------------------------------


def _brand_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return tag_cooccurrence(order_tags(spark, folder))


def _article_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return tag_cooccurrence(item_tags(articles(spark, folder)), top=200)


def _article_pairs_in_two_passes(spark: SparkSession, folder: str) -> DataFrame:
    return tag_cooccurrence(item_tags(articles(spark, folder)), top=200, buckets=BUCKETS)


def _variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.tag_variants(spelled_tags(spark, folder))


_VARIANTS_SQL = f"""WITH RECURSIVE {SPELLED_SQL},
compte AS (
  SELECT tag, count(*) AS nb,
    regexp_replace(translate(lower(tag), '{variants.ACCENTED}', '{variants.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS forme
  FROM spelled WHERE tag IS NOT NULL GROUP BY tag),
formes AS (SELECT DISTINCT forme FROM compte WHERE forme <> ''),
liens AS (
  SELECT a.forme AS a, b.forme AS b FROM formes a JOIN formes b
    ON levenshtein(a.forme, b.forme) <= 1 AND length(a.forme) >= 6 AND length(b.forme) >= 6
    AND regexp_replace(a.forme, '[^0-9]', '', 'g') = regexp_replace(b.forme, '[^0-9]', '', 'g')
  UNION SELECT forme, forme FROM formes),
atteint(forme, vers) AS (
  SELECT a, b FROM liens UNION SELECT x.forme, l.b FROM atteint x JOIN liens l ON l.a = x.vers),
groupes AS (SELECT forme, min(vers) AS groupe FROM atteint GROUP BY forme)
SELECT tag, first_value(tag) OVER (PARTITION BY coalesce(groupe, ' ' || tag) ORDER BY nb DESC, tag) AS canonique, nb
FROM compte LEFT JOIN groupes USING (forme)"""


# --- trends --------------------------------------------------------------------------------


def _weekly(spark: SparkSession, folder: str) -> DataFrame:
    return _text(weekly_trend(table(spark, folder, "orders"), "o_orderdate"), "semaine")


def _events_by_second(spark: SparkSession, folder: str) -> DataFrame:
    # Some ten ranges at every scale, so that rows are carried over at small ones, too.
    events = table(spark, folder, "events")
    return _text(fine_trend(events, "ts", range_rows=max(100, events.count() // 10)), "debut")


def _weekly_by_status(spark: SparkSession, folder: str) -> DataFrame:
    a = articles(spark, folder).select("categorie_mistral", parse_iso(F.col("date_article")).alias("ts"))
    return _text(weekly_trend(a, "ts", key="categorie_mistral"), "semaine")


_WEEK = "time_bucket(INTERVAL '7 days', {}, TIMESTAMP '1970-01-01')"

# --- agreement -----------------------------------------------------------------------------


def _agreement(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.agreement_global(annotated_documents(spark, folder), "themes_mistral", "themes_ml")


def _agreement_by_label(spark: SparkSession, folder: str) -> DataFrame:
    docs = annotated_documents(spark, folder)
    return agreement.agreement_by_label(docs, "themes_mistral", "themes_ml", DOCUMENT_LABELS)


def _disagreements(spark: SparkSession, folder: str) -> DataFrame:
    docs = annotated_documents(spark, folder)
    return agreement.disagreements(docs, "themes_mistral", "themes_ml").select("id", "source")


def _article_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return agreement.agreement_by_label(articles(spark, folder), "themes_mistral", "themes_ml")


_AGREEMENT_SQL = """SELECT count(*) AS total, count(*) FILTER (m IS NOT NULL AND b IS NOT NULL) AS compares,
  count(*) FILTER (list_sort(m) = list_sort(b)) AS accord_exact,
  count(*) FILTER (list_has_any(m, b)) AS chevauchement,
  coalesce(floor(avg(CASE WHEN len(m) + len(b) = 0 THEN 1.0
      ELSE len(list_intersect(m, b)) / (len(m) + len(b) - len(list_intersect(m, b))) END) * 1000 + 0.5) / 1000, 0.0)
    AS jaccard_moyen
FROM docs"""


def _by_label_sql(source: str, labels: list[str]) -> str:
    rows = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))
    return f"""SELECT rang, theme,
      count(*) FILTER (list_contains(m, theme) AND list_contains(b, theme)) AS accord,
      count(*) FILTER (list_contains(m, theme) AND NOT list_contains(b, theme)) AS mistral_seul,
      count(*) FILTER (NOT list_contains(m, theme) AND list_contains(b, theme)) AS ml_seul
    FROM (VALUES {rows}) l(rang, theme), {source} WHERE m IS NOT NULL AND b IS NOT NULL GROUP BY ALL"""


# --- star schema ---------------------------------------------------------------------------


def _calendar(spark: SparkSession, folder: str) -> DataFrame:
    return _text(star.calendar(articles(spark, folder)), "date_complete")


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return _text(star.daily_aggregate(articles(spark, folder)), "date")


def _timeline(spark: SparkSession, folder: str) -> DataFrame:
    return _text(star.timeline(star.daily_aggregate(articles(spark, folder))), "jour")


def _backfilled(a: DataFrame) -> DataFrame:
    """Undated articles dated by their collection: a keyed update by id."""
    missing = a.where(F.col("date_article").isNull())
    updates = missing.select("id", F.col("date_collecte").alias("date_article"))
    return keyed_update(a, updates, "id", ["date_article"])


def _backfill(spark: SparkSession, folder: str) -> DataFrame:
    return _backfilled(articles(spark, folder)).select("id", "url", "date_article", "date_collecte")


def _crosscheck(spark: SparkSession, folder: str) -> DataFrame:
    # The aggregate as it was before the backfill, so the check has something to find.
    a = articles(spark, folder)
    return _text(star.crosscheck(star.daily_aggregate(a), _backfilled(a)), "date")


def _crosscheck_clean(spark: SparkSession, folder: str) -> DataFrame:
    a = articles(spark, folder)
    return star.crosscheck(star.daily_aggregate(a), a).agg(F.count("*").alias("ecarts"))


def _themes_from_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    return star.theme_counts_from_aggregate(star.daily_aggregate(articles(spark, folder)))


def _theme_trend(spark: SparkSession, folder: str) -> DataFrame:
    return star.theme_trend(star.daily_aggregate(articles(spark, folder)))


_FILLED = """filled AS (SELECT id, url, coalesce(date_article, date_collecte) AS date_article, date_collecte,
  CAST(coalesce(ts_article, ts_collecte) AS DATE) AS jour FROM articles)"""

# --- regularity and process ----------------------------------------------------------------


def _client_days(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(F.col("o_custkey").alias("client"), F.to_date("o_orderdate").alias("jour"))


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    return kpi.gap_regularity(_client_days(spark, folder), "client", "jour")


def _kpis(spark: SparkSession, folder: str) -> DataFrame:
    found = kpi.process_kpis(articles(spark, folder), boundary="1998-04-01")
    return _text(found, "premiere_collecte", "derniere_collecte")


def _regularity(spark: SparkSession, folder: str) -> DataFrame:
    return star.collection_regularity(_client_days(spark, folder), "jour")


def _distinct_by_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct sources and titles of ten ranges of days, exactly, and whether the sketches come within 2 %."""
    dated = articles(spark, folder).withColumn("jour", day_of(F.col("date_article"))).where("jour IS NOT NULL")
    # Days are read from their texts once; ranges, sketches and exact counts all need them.
    path = work_dir(spark, "days")
    dated = dated.select("id", "jour", "source", "titre")
    dated.write.parquet(path)
    a = spark.read.schema(dated.schema).parquet(path)
    ranges = a.agg(F.min("jour").alias("a"), F.max("jour").alias("b")).select(
        "b", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.date_add("a", i * 97))).alias("debut")
    )
    ranges = ranges.select("debut", F.greatest("debut", F.date_sub("b", 31)).alias("fin"))
    # Two lots, as they would be stored one after the other.
    lots = [sketches.daily_sketches(a.where(F.col("id") % 2 == i), ["source", "titre"]) for i in (0, 1)]
    found = sketches.distinct_between(sketches.merged(lots[0].unionByName(lots[1])), ranges)
    sources = sketches.exactly_between(a, "source", ranges, "sources")
    exact = sources.join(sketches.exactly_between(a, "titre", ranges, "titres"), ["debut", "fin"])
    near = lambda estimate, n: F.abs(estimate - n) <= 0.02 * n
    both = found.join(exact, ["debut", "fin"]).withColumn("proche", near(F.col("source"), F.col("sources")) & near(F.col("titre"), F.col("titres")))
    return _text(both.select("debut", "fin", "sources", "titres", "proche"), "debut", "fin")


def _backtest(spark: SparkSession, folder: str) -> DataFrame:
    return health.freshness_backtest(_client_days(spark, folder), "jour", ok_days=0, alert_days=1)


# One row per era and collection day, then one per era: days are rows there, so passes, span and gaps are plain
# aggregates. Distinct values are counted over the articles.
_KPI_SQL = """par_jour AS (
  SELECT date_collecte < '1998-04-01' AS avant, CAST(ts_collecte AS DATE) AS jour, count(*) AS n,
    sum((epoch_us(ts_collecte) - epoch_us(ts_article)) / 86400000000.0) AS ages, count(ts_article) AS n_ages,
    count(*) FILTER (score_mistral = 3) AS n3, count(*) FILTER (score_mistral = 4) AS n4,
    count(*) FILTER (score_mistral IN (1, 2)) AS n12, count(*) FILTER (score_mistral = 5) AS n5,
    count(*) FILTER (categorie_mistral = 'HORS_SCOPE') AS hors, count(*) FILTER (themes_mistral IS NULL) AS sans
  FROM articles GROUP BY ALL),
avec_ecart AS (SELECT *, jour - lag(jour) OVER (PARTITION BY avant ORDER BY jour) AS ecart FROM par_jour),
distincts AS (
  SELECT date_collecte < '1998-04-01' AS avant, count(DISTINCT categorie_mistral) AS categories, count(DISTINCT source) AS sources
  FROM articles GROUP BY 1),
comptes AS (
  SELECT avant, sum(n) AS n, count(*) AS passes, min(jour) AS debut, max(jour) AS fin, sum(ages) / sum(n_ages) AS age,
    CAST(sum(n3) AS BIGINT) AS n3, CAST(sum(n4) AS BIGINT) AS n4, CAST(sum(n12) AS BIGINT) AS n12, CAST(sum(n5) AS BIGINT) AS n5,
    any_value(categories) AS categories, any_value(sources) AS sources, sum(hors) AS hors, sum(sans) AS sans,
    avg(ecart) AS ecart_moyen, median(ecart) AS ecart_median, max(ecart) AS ecart_max
  FROM avec_ecart JOIN distincts USING (avant) GROUP BY avant HAVING count(ecart) > 0)"""
_KPI_ROW = """SELECT CASE WHEN avant THEN 'avant' ELSE 'apres' END AS ere, CAST(n AS BIGINT) AS articles, passes,
  CAST(debut AS VARCHAR) AS premiere_collecte, CAST(fin AS VARCHAR) AS derniere_collecte,
  CAST(fin - debut AS INTEGER) AS etendue_j, CAST(((20 * n + passes) // (2 * passes)) / 10.0 AS DOUBLE) AS articles_par_passe,
  round(age, 1) AS age_moyen_j, CAST(((2000 * n3 + n) // (2 * n)) / 10.0 AS DOUBLE) AS pct_score_3,
  CAST(((2000 * n4 + n) // (2 * n)) / 10.0 AS DOUBLE) AS pct_score_4, n12 AS notes_1_ou_2, n5 AS notes_5,
  categories AS categories_distinctes, CAST(hors AS BIGINT) AS hors_scope, sources AS sources_distinctes,
  CAST(sans AS BIGINT) AS sans_theme, round(ecart_moyen, 1) AS intervalle_moyen_j,
  round(ecart_median, 1) AS intervalle_median_j, CAST(ecart_max AS INTEGER) AS plus_longue_interruption_j FROM comptes"""

# --- second classification -----------------------------------------------------------------


def _pairs():
    return zip_scores(F.col("labels"), F.col("scores"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors labelled 3 answer in texts that no label has, so they fail."""
    responses = vector_scores(spark, folder, list(LABEL_HYPOTHESES.values()), failing=3)
    return labels_from_scores(responses, _pairs(), places=4)


def _score_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("id", F.array_join("themes", "|").alias("themes"), "confiance", "erreur")


def _outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return outcome_counts(_scored(spark, folder))


def _micro_f1(spark: SparkSession, folder: str) -> DataFrame:
    responses = vector_scores(spark, folder, list(LABEL_HYPOTHESES.values()))
    label = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label")
    named = F.array_compact(F.array(*[F.when(F.col("label") % 7 == i, F.lit(x)) for i, x in enumerate(LABELS)]))
    both = responses.join(label, "id").select(named.alias("vrai"), usable_scores(_pairs()).alias("obtenu"))
    return agreement.micro_f1(both, "vrai", "obtenu", [0.3, 0.5, 0.7])


_LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
_SCORES = f"""sc AS (SELECT vec_id AS id, label, list_transform(embedding[1:7], lambda x: abs(CAST(x AS DOUBLE)) * 4) AS s,
  {_LABEL_LIST} AS l FROM embeddings),
lab AS (SELECT id, label, s, l, list_filter(l, lambda x, i: s[i] >= 0.7) AS kept FROM sc)"""


_ARTICLE_PAIRS = _sql(
    """SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS support FROM it a JOIN it b ON a.id = b.id AND a.tag < b.tag
    GROUP BY ALL HAVING count(*) >= 5 ORDER BY support DESC, tag_a, tag_b LIMIT 200""",
    "it AS (SELECT DISTINCT id, unnest(t) AS tag FROM articles)",
)

QUERIES = {
    "tag_cooccurrence": Query(
        _brand_pairs,
        """WITH it AS (SELECT DISTINCT l_orderkey AS id, p_brand AS tag FROM lineitem JOIN part ON p_partkey = l_partkey)
        SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS support FROM it a JOIN it b ON a.id = b.id AND a.tag < b.tag
        GROUP BY ALL HAVING count(*) >= 5 ORDER BY support DESC, tag_a, tag_b LIMIT 50""",
    ),
    "tag_cooccurrence_articles": Query(_article_pairs, _ARTICLE_PAIRS),
    "tag_cooccurrence_two_passes": Query(_article_pairs_in_two_passes, _ARTICLE_PAIRS),
    "tag_variants": Query(_variants, _VARIANTS_SQL),
    "weekly_trend": Query(
        _weekly,
        f"""SELECT CAST(CAST(semaine AS DATE) AS VARCHAR) AS semaine, nb_articles,
          CAST(round(CAST(avg(nb_articles) OVER (ORDER BY semaine ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS DECIMAL(18, 6)), 2) AS DOUBLE)
            AS moyenne_glissante_4s
        FROM (SELECT {_WEEK.format('o_orderdate')} AS semaine, count(*) AS nb_articles FROM orders GROUP BY 1)""",
    ),
    "trend_by_second": Query(
        _events_by_second,
        """SELECT CAST(debut AS VARCHAR) AS debut, nb_articles,
          CAST(round(CAST(avg(nb_articles) OVER (ORDER BY debut ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS DECIMAL(18, 6)), 2) AS DOUBLE)
            AS moyenne_glissante
        FROM (SELECT date_trunc('second', ts) AS debut, count(*) AS nb_articles FROM events WHERE ts IS NOT NULL GROUP BY 1)""",
    ),
    "weekly_trend_by_category": Query(
        _weekly_by_status,
        _sql(
            f"""SELECT categorie_mistral, CAST(CAST(semaine AS DATE) AS VARCHAR) AS semaine, nb_articles,
              CAST(round(CAST(avg(nb_articles) OVER (PARTITION BY categorie_mistral ORDER BY semaine
                ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS DECIMAL(18, 6)), 2) AS DOUBLE) AS moyenne_glissante_4s
            FROM (SELECT categorie_mistral, {_WEEK.format('ts_article')} AS semaine, count(*) AS nb_articles
                  FROM articles WHERE ts_article IS NOT NULL GROUP BY ALL)"""
        ),
    ),
    "label_agreement_global": Query(_agreement, f"WITH {DOCUMENTS_SQL}\n{_AGREEMENT_SQL}"),
    "label_agreement_by_label": Query(
        _agreement_by_label, f"WITH {DOCUMENTS_SQL}\n{_by_label_sql('docs', DOCUMENT_LABELS)}"
    ),
    "article_agreement_by_label": Query(_article_agreement, _sql(_by_label_sql("articles", LABELS))),
    "label_disagreements": Query(
        _disagreements,
        f"""WITH {DOCUMENTS_SQL} SELECT id, source FROM docs
        WHERE m IS NOT NULL AND b IS NOT NULL AND NOT list_has_any(m, b)""",
    ),
    "calendar_dim": Query(
        _calendar,
        _sql(
            """SELECT DISTINCT CAST(jour AS VARCHAR) AS date_complete, CAST(year(jour) AS INTEGER) AS annee,
            CAST(month(jour) AS INTEGER) AS mois, CAST(strftime(jour, '%W') AS INTEGER) AS semaine,
            CAST(strftime(jour, '%w') AS INTEGER) AS jour_semaine FROM articles WHERE jour IS NOT NULL"""
        ),
    ),
    "daily_theme_aggregate": Query(
        _daily,
        _sql(
            """SELECT CAST(jour AS VARCHAR) AS date, false AS est_total, theme AS thematique, count(*) AS nb_articles,
              avg(score_mistral) AS score_moyen FROM (SELECT jour, score_mistral, unnest(m) AS theme FROM articles)
            WHERE jour IS NOT NULL GROUP BY ALL
            UNION ALL
            SELECT CAST(jour AS VARCHAR), true, NULL, count(*), avg(score_mistral) FROM articles
            WHERE jour IS NOT NULL GROUP BY jour"""
        ),
    ),
    "timeline": Query(
        _timeline,
        _sql("SELECT CAST(jour AS VARCHAR) AS jour, count(*) AS nb FROM articles WHERE jour IS NOT NULL GROUP BY 1"),
    ),
    "keyed_backfill": Query(_backfill, _sql("SELECT id, url, date_article, date_collecte FROM filled", _FILLED)),
    "aggregate_crosscheck": Query(
        _crosscheck,
        _sql(
            """SELECT CAST(coalesce(x.jour, y.jour) AS VARCHAR) AS date, x.n AS nb_agregat, y.n AS nb_calcule
            FROM (SELECT jour, count(*) AS n FROM articles WHERE jour IS NOT NULL GROUP BY 1) x
            FULL JOIN (SELECT jour, count(*) AS n FROM filled GROUP BY 1) y ON x.jour = y.jour
            WHERE x.n IS DISTINCT FROM y.n""",
            _FILLED,
        ),
    ),
    "aggregate_crosscheck_clean": Query(
        _crosscheck_clean,
        _sql(
            """SELECT count(*) AS ecarts FROM (SELECT jour, count(*) AS n FROM articles WHERE jour IS NOT NULL GROUP BY 1) x
            FULL JOIN (SELECT CAST(ts_article AS DATE) AS jour, count(ts_article) AS n FROM articles
                       WHERE date_article IS NOT NULL GROUP BY 1) y ON x.jour = y.jour WHERE x.n IS DISTINCT FROM y.n"""
        ),
    ),
    "theme_counts_from_aggregate": Query(
        _themes_from_aggregate,
        _sql(
            """SELECT theme, count(*) AS nb FROM (SELECT unnest(m) AS theme FROM articles WHERE jour IS NOT NULL)
            GROUP BY theme"""
        ),
    ),
    "theme_trend": Query(
        _theme_trend,
        _sql(
            """SELECT strftime(jour, '%Y-%m') AS mois, theme, count(*) AS nb
            FROM (SELECT jour, unnest(m) AS theme FROM articles WHERE jour IS NOT NULL) GROUP BY ALL"""
        ),
    ),
    "gap_regularity": Query(
        _gaps,
        """WITH e AS (SELECT client, CAST(datediff('day', lag(jour) OVER (PARTITION BY client ORDER BY jour), jour) AS INTEGER) AS g
          FROM (SELECT DISTINCT o_custkey AS client, CAST(o_orderdate AS DATE) AS jour FROM orders))
        SELECT client, ((20 * CAST(sum(g) AS BIGINT) + count(*)) // (2 * count(*))) / 10.0 AS intervalle_moyen_j,
          CAST(median(g) AS DOUBLE) AS intervalle_median_j,
          max(g) AS plus_longue_interruption_j FROM e WHERE g IS NOT NULL GROUP BY client""",
    ),
    "process_kpis": Query(
        _kpis, _sql(_KPI_ROW, _KPI_SQL)
    ),
    "collection_regularity": Query(
        _regularity,
        """SELECT n AS jours_couverts, span AS etendue_j, ((2000 * n + span) // (2 * span)) / 10.0 AS pct_couvert
        FROM (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) AS n, CAST(datediff('day', min(CAST(o_orderdate AS DATE)),
          max(CAST(o_orderdate AS DATE))) + 1 AS INTEGER) AS span FROM orders)""",
    ),
    "distinct_by_sketch": Query(
        _distinct_by_sketch,
        _sql(
            """SELECT CAST(debut AS VARCHAR) AS debut, CAST(fin AS VARCHAR) AS fin, count(DISTINCT source) AS sources,
              count(DISTINCT titre) AS titres, true AS proche
            FROM (SELECT CAST(a + CAST(i * 97 AS INTEGER) AS DATE) AS debut, CAST(greatest(a + CAST(i * 97 AS INTEGER), b - 31) AS DATE) AS fin
                  FROM (SELECT min(jour) AS a, max(jour) AS b FROM articles), range(10) t(i)) r
            LEFT JOIN articles ON jour BETWEEN debut AND fin GROUP BY 1, 2"""
        ),
    ),
    "freshness_backtest": Query(
        _backtest,
        """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS jour FROM orders),
        every_day AS (SELECT CAST(unnest(generate_series(min(jour), max(jour), INTERVAL 1 DAY)) AS DATE) AS jour FROM d),
        aged AS (SELECT e.jour, datediff('day', max(d.jour) OVER (ORDER BY e.jour), e.jour) AS age
          FROM every_day e LEFT JOIN d ON d.jour = e.jour)
        SELECT CASE WHEN age <= 0 THEN 'ok' WHEN age <= 1 THEN 'degrade' ELSE 'alerte' END AS statut, count(*) AS jours
        FROM aged GROUP BY 1""",
    ),
    "score_labels": Query(
        _score_labels,
        f"""WITH {_SCORES} SELECT id, array_to_string(kept, '|') AS themes,
          floor(list_max(s) * 10000 + 0.5) / 10000 AS confiance, CAST(NULL AS VARCHAR) AS erreur FROM lab WHERE label <> 3
        UNION ALL SELECT id, NULL, NULL, 'unusable response' FROM lab WHERE label = 3""",
    ),
    "score_outcomes": Query(
        _outcomes,
        f"""WITH {_SCORES} SELECT count(*) FILTER (label <> 3) AS classes, count(*) FILTER (label = 3) AS echecs,
          count(*) FILTER (label <> 3 AND len(kept) = 0) AS sans_theme FROM lab""",
    ),
    "micro_f1": Query(
        _micro_f1,
        f"""WITH {_SCORES},
        w AS (SELECT seuil, l[(label % 7) + 1] AS vrai, list_filter(l, lambda x, i: s[i] >= seuil) AS kept
          FROM lab, (VALUES (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) t(seuil)),
        c AS (SELECT seuil, count(*) FILTER (list_contains(kept, vrai)) AS tp,
          CAST(sum(len(kept)) AS BIGINT) - count(*) FILTER (list_contains(kept, vrai)) AS fp,
          count(*) FILTER (NOT list_contains(kept, vrai)) AS fn FROM w GROUP BY seuil)
        SELECT seuil, tp AS vrais_positifs, fp AS faux_positifs, fn AS faux_negatifs,
          floor(2.0 * tp / (2 * tp + fp + fn) * 10000 + 0.5) / 10000 AS micro_f1 FROM c""",
    ),
}
