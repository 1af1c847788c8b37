"""Article-shaped views of the Parquet tables, each with its SQL twin for the result check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import ISO_FORMAT
from ..sources.tables import table


def _labels(*cases: tuple[Column, str]) -> Column:
    """JSON text of the labels whose condition holds."""
    return _json(*[F.when(cond, F.lit(label)) for cond, label in cases])


def _json(*items: Column) -> Column:
    quoted = [F.concat(F.lit('"'), item, F.lit('"')) for item in items]
    return F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]"))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """``orders`` as articles: two annotators, tags, canonical, off-contract and missing dates."""
    o = table(spark, folder, "orders")
    status, price, client = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_custkey")
    prio = F.substring("o_orderpriority", 1, 1).cast("int")
    moment = F.timestamp_seconds(
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400
    )
    first = _labels(
        (status == "F", "DevOps/Infrastructure"),
        (status == "O", "Développement"),
        (prio == 1, "Sécurité"),
        (prio <= 2, "IA/ML"),
        (price >= 300000, "Architecture"),
        (price < 30000, "Produktivité/Outils"),
    )
    second = _labels(
        (price >= 250000, "Architecture"),
        (prio == 1, "Sécurité"),
        ((status == "O") & (prio >= 3), "Développement"),
        ((status == "F") & (price < 200000), "DevOps/Infrastructure"),
        (client % 4 == 0, "Pratiques/Qualité"),
    )
    unlabelled = (status == "P") & (prio == 4)
    cut_short = (status == "F") & (prio == 5) & (price < 60000)
    tags = _json(
        F.concat(F.lit("etat-"), F.lower(status)),
        F.concat(F.lit("prio-"), prio),
        F.concat(F.lit("client-"), client % 97),
        F.when(price >= 300000, "grand compte"),
    )
    canonical = F.date_format(moment, ISO_FORMAT)
    shifted = F.concat(F.date_format(moment + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    collected = moment + F.make_dt_interval(days=(client % 30).cast("int"), hours=F.lit(5))
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Order "), "o_orderkey").alias("titre"),
        F.concat(F.lit("https://orders.example/"), "o_orderkey").alias("url"),
        F.when(status != "P", F.concat(F.lit("Priority "), "o_orderpriority")).alias("resume"),
        F.concat(F.lit("client-"), client).alias("source"),
        F.when(status == "O", "PRO")
        .when(status == "F", "PERSO")
        .when(prio == 5, "HORS_SCOPE")
        .when(prio != 4, "LES_DEUX")
        .alias("categorie_mistral"),
        F.when(prio != 4, prio).alias("score_mistral"),
        F.when(unlabelled, F.lit(None).cast("string"))
        .when(cut_short, '["IA/ML"')
        .otherwise(first)
        .alias("themes_mistral"),
        F.when(price >= 20000, second).alias("themes_ml"),
        F.when(price >= 20000, price / 500000).alias("score_confiance_ml"),
        tags.alias("tags"),
        F.when(client % 50 == 0, F.lit(None).cast("string"))
        .when(client % 50 == 1, shifted)
        .otherwise(canonical)
        .alias("date_article"),
        F.date_format(collected, ISO_FORMAT).alias("date_collecte"),
    )


ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"

# The same view in SQL: texts as stored, plus what they mean as lists (m, b, t) and instants.
ARTICLES_SQL = f"""
base AS (
  SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS prio,
         CAST(o_orderdate AS TIMESTAMP) + to_seconds(o_orderkey % 86400) AS moment
  FROM orders),
lists AS (
  SELECT *,
    CASE WHEN o_orderstatus = 'P' AND prio = 4 THEN NULL
         WHEN o_orderstatus = 'F' AND prio = 5 AND o_totalprice < 60000 THEN NULL
         ELSE list_filter([
      CASE WHEN o_orderstatus = 'F' THEN 'DevOps/Infrastructure' END,
      CASE WHEN o_orderstatus = 'O' THEN 'Développement' END,
      CASE WHEN prio = 1 THEN 'Sécurité' END,
      CASE WHEN prio <= 2 THEN 'IA/ML' END,
      CASE WHEN o_totalprice >= 300000 THEN 'Architecture' END,
      CASE WHEN o_totalprice < 30000 THEN 'Produktivité/Outils' END], lambda x: x IS NOT NULL) END AS m,
    CASE WHEN o_totalprice < 20000 THEN NULL ELSE list_filter([
      CASE WHEN o_totalprice >= 250000 THEN 'Architecture' END,
      CASE WHEN prio = 1 THEN 'Sécurité' END,
      CASE WHEN o_orderstatus = 'O' AND prio >= 3 THEN 'Développement' END,
      CASE WHEN o_orderstatus = 'F' AND o_totalprice < 200000 THEN 'DevOps/Infrastructure' END,
      CASE WHEN o_custkey % 4 = 0 THEN 'Pratiques/Qualité' END], lambda x: x IS NOT NULL) END AS b,
    list_filter(['etat-' || lower(o_orderstatus), 'prio-' || prio, 'client-' || (o_custkey % 97),
      CASE WHEN o_totalprice >= 300000 THEN 'grand compte' END], lambda x: x IS NOT NULL) AS t,
    CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE moment END AS ts_article,
    moment + to_days(CAST(o_custkey % 30 AS INTEGER)) + to_hours(5) AS ts_collecte
  FROM base),
articles AS (
  SELECT o_orderkey AS id, 'Order ' || o_orderkey AS titre, 'https://orders.example/' || o_orderkey AS url,
    CASE WHEN o_orderstatus <> 'P' THEN 'Priority ' || o_orderpriority END AS resume,
    'client-' || o_custkey AS source,
    CASE WHEN o_orderstatus = 'O' THEN 'PRO' WHEN o_orderstatus = 'F' THEN 'PERSO'
         WHEN prio = 5 THEN 'HORS_SCOPE' WHEN prio <> 4 THEN 'LES_DEUX' END AS categorie_mistral,
    CASE WHEN prio <> 4 THEN prio END AS score_mistral,
    CASE WHEN o_orderstatus = 'F' AND prio = 5 AND o_totalprice < 60000 THEN '["IA/ML"'
         ELSE CAST(to_json(m) AS VARCHAR) END AS themes_mistral,
    CAST(to_json(b) AS VARCHAR) AS themes_ml,
    CASE WHEN b IS NOT NULL THEN o_totalprice / 500000 END AS score_confiance_ml,
    CAST(to_json(t) AS VARCHAR) AS tags,
    CASE WHEN o_custkey % 50 = 0 THEN NULL
         WHEN o_custkey % 50 = 1 THEN strftime(moment + to_hours(2), '%Y-%m-%dT%H:%M:%S') || '+02:00'
         ELSE strftime(moment, {ISO}) END AS date_article,
    strftime(ts_collecte, {ISO}) AS date_collecte,
    m, b, t, ts_article, ts_collecte, CAST(ts_article AS DATE) AS jour
  FROM lists)"""


def order_tags(spark: SparkSession, folder: str) -> DataFrame:
    """``id, tag`` rows: the brands of the parts of each order."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand")
    joined = lines.join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.select(F.col("l_orderkey").alias("id"), F.col("p_brand").alias("tag"))


def spelled_tags(spark: SparkSession, folder: str) -> DataFrame:
    """``id, tag``: part names as tags, each in one of seven spellings."""
    p = table(spark, folder, "part")
    name, size = F.col("p_name"), F.length("p_name")
    kind = F.col("p_partkey") % 7
    spelled = (
        F.when(kind == 1, F.upper(name))
        .when(kind == 2, F.replace(name, F.lit(" "), F.lit("-")))
        .when(kind == 3, F.concat(name, F.lit("s")))
        .when(kind == 4, name.substr(F.lit(1), size - 1))
        .when(kind == 5, F.concat(F.replace(name, F.lit("e"), F.lit("é")), F.lit("ss")))
        .when(kind == 6, F.concat(F.substring("p_name", 1, 1), F.lit(" "), F.substring("p_name", 1, 3)))
        .otherwise(name)
    )
    return p.select(F.col("p_partkey").alias("id"), spelled.alias("tag"))


SPELLED_SQL = """spelled AS (
  SELECT p_partkey AS id, CASE p_partkey % 7 WHEN 1 THEN upper(p_name) WHEN 2 THEN replace(p_name, ' ', '-')
    WHEN 3 THEN p_name || 's' WHEN 4 THEN left(p_name, length(p_name) - 1)
    WHEN 5 THEN replace(p_name, 'e', 'é') || 'ss' WHEN 6 THEN left(p_name, 1) || ' ' || left(p_name, 3) ELSE p_name END AS tag
  FROM part)"""


def annotated_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` labelled by ``labels`` (NULL where absent) and by a rule on the text length and language."""
    d = table(spark, folder, "documents").select("doc_id", "source", "lang", F.length("text").alias("taille"))
    given = table(spark, folder, "labels")
    known = F.col("quality").isNotNull()
    return d.join(given, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        "source",
        F.when(known, _labels((F.col("quality") == 1, "quality"), (F.col("toxic") == 1, "toxic"))).alias("themes_mistral"),
        _labels((F.col("taille") >= 500, "quality"), (F.col("lang") != "en", "foreign")).alias("themes_ml"),
    )


DOCUMENT_LABELS = ["quality", "toxic", "foreign", "unused"]

DOCUMENTS_SQL = """
docs AS (
  SELECT d.doc_id AS id, d.source,
    CASE WHEN l.quality IS NOT NULL THEN list_filter([CASE WHEN l.quality = 1 THEN 'quality' END,
      CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) END AS m,
    list_filter([CASE WHEN length(d.text) >= 500 THEN 'quality' END,
      CASE WHEN d.lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL) AS b
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def event_records(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as incoming records: raw tag, label, score and date fields, ranked by ``rang``.

    Every event is sent, and the errors are sent a second time under the same link with another
    title, so first-come-first-stored has something to decide. Sign-ups lack a title.
    """
    e = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind, k = F.col("event_type"), F.col("k")
    moment = F.date_trunc("millisecond", F.col("ts").cast("timestamp"))
    mail = F.concat(F.date_format(moment, "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    row = e.select(
        F.col("event_id").alias("rang"),
        F.when(kind == "signup", F.lit("")).otherwise(F.concat(F.lit("Event "), "event_id")).alias("title"),
        F.concat(F.lit("https://events.example/"), "event_id").alias("link"),
        F.when(kind == "view", F.lit("")).otherwise(kind).alias("source"),
        F.when(F.col("value") < 5, F.lit("")).otherwise(F.concat(F.lit("value "), kind)).alias("resume"),
        F.when(kind != "click", F.upper(kind)).alias("categorie"),
        # A score may come as 3, as 3.0 and as a text.
        F.when(kind == "purchase", F.concat(k % 6, F.lit(".0"))).otherwise((k % 6).cast("string")).alias("score"),
        F.when(kind == "purchase", F.concat(F.lit("Mon, "), mail))
        .when(kind == "error", F.date_format(moment, ISO_FORMAT))
        .when(kind == "click", F.lit("pas-une-date"))
        .otherwise(F.date_format(moment, "yyyy-MM-dd"))
        .alias("date"),
        F.array(F.concat(F.lit("  "), F.upper(kind), F.lit(" ")), F.concat(F.lit("K"), k % 10)).alias("tags"),
        F.when(k % 5 != 0, F.array(F.concat(F.lit("theme-"), k % 7), kind)).alias("themes"),
    )
    again = row.where(F.col("source") == "error").withColumns(
        {"title": F.concat("title", F.lit(" bis")), "rang": F.col("rang") + (1 << 40)}
    )
    return row.unionByName(again)


# What those records become once stored. ``jour`` is NULL where the date is missing or unreadable.
RECORDS_SQL = f"""
ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, date_trunc('millisecond', ts) AS moment
  FROM events),
stored AS (
  SELECT event_id, 'Event ' || event_id AS titre, 'https://events.example/' || event_id AS url,
    CASE WHEN value < 5 THEN NULL ELSE 'value ' || event_type END AS resume,
    CASE WHEN event_type = 'view' THEN 'inconnu' ELSE event_type END AS source,
    CASE WHEN event_type <> 'click' THEN upper(event_type) END AS categorie_mistral,
    CASE WHEN k % 6 <> 0 THEN k % 6 END AS score_mistral,
    CASE WHEN k % 5 <> 0 THEN ['theme-' || (k % 7), event_type] END AS m,
    '["' || event_type || '","k' || (k % 10) || '"]' AS tags,
    CASE event_type WHEN 'purchase' THEN strftime(date_trunc('second', moment), {ISO})
                    WHEN 'error' THEN strftime(moment, {ISO})
                    WHEN 'click' THEN NULL
                    ELSE strftime(CAST(moment AS DATE), '%Y-%m-%d') || 'T00:00:00.000Z' END AS date_article,
    CASE WHEN event_type <> 'click' THEN CAST(moment AS DATE) END AS jour
  FROM ev WHERE event_type <> 'signup')"""


def vector_scores(spark: SparkSession, folder: str, hypotheses: list[str], failing: int | None = None) -> DataFrame:
    """``embeddings`` as classifier responses: one score in 0..1 per component and hypothesis text.

    Components beyond the hypotheses carry unknown texts, which the mapping must drop; vectors
    labelled ``failing`` carry nothing else.
    """
    v = table(spark, folder, "embeddings")
    scores = F.transform("embedding", lambda x: F.abs(x.cast("double")) * 4)
    known = F.array(*[F.lit(h) for h in hypotheses])
    fails = F.lit(False) if failing is None else F.col("label") == failing
    names = F.transform(
        F.sequence(F.lit(1), F.size("embedding")),
        lambda i: F.coalesce(F.when(~fails, F.get(known, i - 1)), F.concat(F.lit("texte "), i)),
    )
    return v.select(F.col("vec_id").alias("id"), names.alias("labels"), scores.alias("scores"))
