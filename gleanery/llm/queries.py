"""The corpus operators as registered queries: each reads its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.catalog import Query
from ..sources.tables import table
from . import bpe, decontam, divergence, hashforest, hostrules, idfiles, langid, linededup, resample, secrets, simhash
from . import toxicity, warc
from .common import is_bucket

OP5_SQL = r"""
WITH lines AS (
    SELECT doc_id, source, n, line, trim(line, chr(32) || chr(9) || chr(13)) AS bare
    FROM (
        SELECT doc_id, source, unnest(range(len(string_split(text, chr(10))))) AS n,
               unnest(string_split(text, chr(10))) AS line
        FROM documents
    )
), totals AS (
    SELECT source, count(*) AS total FROM documents WHERE source IS NOT NULL GROUP BY source
), bad AS (
    SELECT source, bare FROM (SELECT DISTINCT doc_id, source, bare FROM lines WHERE bare <> '') JOIN totals USING (source)
    GROUP BY source, bare HAVING count(*) >= 5 AND count(*) > 0.1 * any_value(total)
), marked AS (
    SELECT lines.*, bad.bare IS NOT NULL AS gone
    FROM lines LEFT JOIN bad ON lines.source = bad.source AND lines.bare = bad.bare
), pages AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_gone,
           count(*) FILTER (WHERE NOT gone AND bare <> '') AS n_left,
           string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone) AS kept
    FROM marked GROUP BY doc_id
)
SELECT doc_id, CASE WHEN n_gone > 0 AND n_left > 0 THEN kept ELSE text END AS text,
       coalesce(n_lines, 0) AS n_lines, CASE WHEN n_gone > 0 AND n_left > 0 THEN n_gone ELSE 0 END AS n_dropped
FROM documents LEFT JOIN pages USING (doc_id)
"""

OP9_SQL = """
WITH paged AS (
    SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
           sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), marked AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS response
    FROM paged
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN response IS NOT NULL AND response IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN response IS NOT NULL AND response IS DISTINCT FROM page_id THEN response END AS refers_to
FROM marked
"""

OP10_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[s : s + 9], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), places AS (
    SELECT doc_id, size, s, array_to_string(w[s : s + size - 1], ' ') AS phrase
    FROM (
        SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS s
        FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size
    )
), found AS (
    SELECT doc_id, places.size AS size, s, item_id FROM places JOIN windows USING (phrase)
), hits AS (
    SELECT doc_id, count(DISTINCT pos) AS n_hit
    FROM (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM found) GROUP BY doc_id
), listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

_WORDS = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP11_SQL = rf"""
WITH crc_table AS (
    SELECT list(c ORDER BY n) AS crcs FROM (
        SELECT n, list_reduce(list_prepend(n, range(8)),
                              lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
        FROM range(256) AS r(n)
    )
), texts AS (
    SELECT 'S' AS side, row_number() OVER () AS did, doc_id, {_WORDS} AS w FROM documents
    UNION ALL SELECT 'T', row_number() OVER (), NULL, {_WORDS} FROM benchmark
), runs AS (
    SELECT side, did, unnest(w) AS run FROM texts
    UNION ALL
    SELECT side, did, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM texts
), hashed AS (
    SELECT run, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(octet_length(encode(run))),
            lambda i: ('0x' || substring(hex(encode(run)), 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT DISTINCT run FROM runs), crc_table
), counted AS (
    SELECT bucket, count(*) FILTER (WHERE side = 'S') AS s, count(*) FILTER (WHERE side = 'T') AS t
    FROM runs JOIN hashed USING (run) GROUP BY bucket
), gained AS (
    SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE)
                                        / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM counted
), weighed AS (
    SELECT did, count(*) AS n, sum(gain) AS total
    FROM runs JOIN hashed USING (run) JOIN gained USING (bucket) WHERE side = 'S' GROUP BY did
), scored AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
           CASE WHEN n > 0 THEN CAST((total - ((total % n) + n) % n) // n AS BIGINT) ELSE 0 END AS weight,
           ('0x' || substring(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h
    FROM texts LEFT JOIN weighed USING (did) WHERE side = 'S'
), final AS (
    SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
           count(*) FILTER (WHERE n_words >= 20) OVER () * 25 // 100 AS drawn
    FROM final
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank
FROM placed
"""

OP12_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS did, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), occurring AS (
    SELECT did, lang, source, unnest(w) AS term FROM docs
), kept AS (
    SELECT lang, term FROM occurring GROUP BY lang, term HAVING count(DISTINCT did) >= 10
), sizes AS (
    SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM docs) LEFT JOIN kept USING (lang) GROUP BY lang
), counted AS (
    SELECT lang, source, term, count(*) AS n FROM occurring JOIN kept USING (lang, term) GROUP BY lang, source, term
), cells AS (
    SELECT lang, source, term, coalesce(n, 0) AS n, v
    FROM (SELECT DISTINCT lang, source FROM docs) JOIN kept USING (lang) JOIN sizes USING (lang)
         LEFT JOIN counted USING (lang, source, term)
), grouped AS (
    SELECT lang, source, term, n,
           1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
    FROM cells
), whole AS (
    SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v)) AS q
    FROM cells GROUP BY lang, term
), pairs AS (
    SELECT a.lang AS lang, a.source AS source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY 1, 2, 3
), others AS (
    SELECT a.lang AS lang, a.source AS source, b.source AS item
    FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b
         ON a.lang = b.lang AND a.source <> b.source
), valued AS (
    SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM others LEFT JOIN pairs USING (lang, source, item)
    UNION ALL
    SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT)
    FROM grouped JOIN whole USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS place FROM valued
)
SELECT lang, source, part, item, value, CAST(place AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR place <= 10
"""

OP13_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS did, doc_id, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), runs AS (
    SELECT did, i, run, count(*) OVER (PARTITION BY did, run) AS times
    FROM (SELECT did, unnest(range(1, len(w) - 1)) AS i,
                 unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS run FROM docs)
), repeated AS (
    SELECT did, count(DISTINCT place) AS n_repeat_words FROM (SELECT did, unnest([i, i + 1, i + 2]) AS place FROM runs WHERE times > 1)
    GROUP BY did
), base AS (
    SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM docs LEFT JOIN repeated USING (did)
), judged AS (
    SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive, 10 * n_symbols > n_words AS symbols,
           word_chars < 3 * n_words OR word_chars > 10 * n_words AS lengths, 10 * n_dup_lines > 3 * n_lines AS copied
    FROM base
), failures AS (
    SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE failed) AS f
    FROM (SELECT source, unnest([1, 2, 3, 4, 5]) AS rule, unnest([short, repetitive, symbols, lengths, copied]) AS failed
          FROM judged WHERE source IS NOT NULL)
    GROUP BY source, rule
), sums AS (
    SELECT rule, count(*) AS k, sum(n) AS n, sum(n * n) AS nn, sum(f) AS f, sum(f * f / n) AS ff FROM failures GROUP BY rule
), moments AS (
    SELECT rule, f / n AS mean, ff - f * f / n - (f / n) * (1 - f / n) * (k - 1) AS between_hosts,
           (f / n) * (1 - f / n) * (n - nn / n - (k - 1)) AS room FROM sums
), priors AS (
    SELECT rule, mean, CASE WHEN room > 0 AND between_hosts > 0
                            THEN least(greatest(room / between_hosts - 1, 10), 1e9) ELSE 1e9 END AS strength FROM moments
), rates AS (
    SELECT source, mean, (f + mean * strength) / (n + strength) AS rate FROM failures JOIN priors USING (rule)
), bad AS (
    SELECT DISTINCT source FROM rates WHERE rate >= 0.5 AND rate * (1 - mean) > 4 * mean * (1 - rate)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
       bad.source IS NOT NULL AS host_failed, NOT (short OR repetitive) AND bad.source IS NULL AS kept
FROM judged LEFT JOIN bad ON judged.source = bad.source
"""


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(spark, docs, labels, ~is_bucket(labels["doc_id"], 5, 0))
    found = toxicity.score(spark, docs, model)
    return found.select(
        "doc_id",
        is_bucket(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "sentence",
        "sentence_score",
    )


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(spark, table(spark, folder, "documents"))
    return found.select("doc_id", "start", "end", "value", "score", "secret")


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(spark, docs, ~is_bucket(docs["doc_id"], 4, 2))
    found = langid.predict(spark, docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        is_bucket(F.col("doc_id"), 4, 2).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"),
    )


def op4_hash_forest(spark: SparkSession, folder: str) -> DataFrame:
    forest = hashforest.HashForest(spark, table(spark, folder, "embeddings"), k=20)
    return forest.search(lambda vec_id: vec_id % 20 == 0).withColumnRenamed("id", "vec_id")


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return linededup.remove_boilerplate(spark, docs).select("doc_id", "text", "n_lines", "n_dropped")


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(spark, table(spark, folder, "documents"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(spark, table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_id_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = idfiles.write_corpus(spark, table(spark, folder, "documents"))
    return idfiles.read_digests(spark, manifest).withColumnRenamed("key", "doc_id")


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write(spark, table(spark, folder, "pages"))
    found = warc.read(spark, archives, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontam.contamination(spark, docs, benchmark).drop("text_hash")


def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(spark, table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(spark, table(spark, folder, "documents"))


def op13_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return hostrules.judge(spark, docs).select("doc_id", *hostrules.MEASURES, "base_failed", "host_failed", "kept")


QUERIES = {
    "op1_toxicity": Query(op1_toxicity),
    "op2_secret_scan": Query(op2_secret_scan),
    "op3_language_id": Query(op3_language_id),
    "op4_hash_forest": Query(op4_hash_forest),
    "op5_line_dedup": Query(op5_line_dedup, OP5_SQL),
    "op6_byte_bpe": Query(op6_byte_bpe),
    "op7_simhash": Query(op7_simhash),
    "op8_id_files": Query(op8_id_files),
    "op9_warc": Query(op9_warc, OP9_SQL),
    "op10_decontamination": Query(op10_decontamination, OP10_SQL),
    "op11_resampling": Query(op11_resampling, OP11_SQL),
    "op12_divergence": Query(op12_divergence, OP12_SQL),
    "op13_host_rules": Query(op13_host_rules, OP13_SQL),
}
