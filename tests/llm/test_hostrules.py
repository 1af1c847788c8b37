"""Host rules against plain loops on odd texts, and the prior on hosts that differ."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from gleanery.llm import hostrules
from gleanery.llm.queries import OP13_SQL, QUERIES

from ..oracle import connect, difference, spark_rows, sql_rows

FOLDER = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_measures_match_plain_loops(spark, make_docs):
    rng = random.Random(3)
    speak = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    texts = [None, "", " \n\t", "a", "a b", "a b a b", "a b c", "a b c a b c", "x x x x", "#$ <b>|&*%", "é ü 😀\x0bz\r\nz\r\nz"]
    texts += ["same\n\n same\nsame\n \n", speak(400, "abcdefg"), speak(9000, "abcdefghijklmnopqrstuvwxyz"), "ab" * 50_000, "p q r " * 20_000]
    docs = make_docs(*texts, *texts[:3])
    got = sorted(tuple(r) for r in hostrules.measured(docs).select("doc_id", *hostrules.MEASURES).collect())
    assert got == sorted((r.doc_id, *brute(r.text)) for r in docs.collect())


def hosts(spark, **given):
    rows = [(host, i < bad) for host, (n, bad) in given.items() for i in range(n)]
    return spark.createDataFrame([(None if h == "none" else h, b) for h, b in rows], "host string, rule boolean")


def test_verdicts_shrink_small_hosts(spark):
    given = {f"clean{i}": (200, 2) for i in range(20)}
    table = hosts(spark, bad=(300, 280), tiny=(1, 1), small=(4, 3), none=(50, 50), **given)
    found = {r.host: r for r in hostrules.host_verdicts(spark, table, "host", ["rule"]).collect()}
    assert {h for h, r in found.items() if r.host_failed} == {"bad"}
    assert None not in found and found["bad"].n == 300 and found["bad"].rule == 280
    # Shrunk towards the corpus, the more the fewer documents there are.
    assert found["tiny"].rate_rule < found["small"].rate_rule < 0.75 < found["bad"].rate_rule < 280 / 300


def test_nothing_stands_out_where_all_fail_or_hosts_are_alike(spark):
    for table in (hosts(spark, a=(100, 90), b=(100, 91)), hosts(spark, a=(100, 100), b=(3, 3)), hosts(spark, only=(100, 99))):
        assert not any(r.host_failed for r in hostrules.host_verdicts(spark, table, "host", ["rule"]).collect())
    assert hostrules.host_verdicts(spark, hosts(spark), "host", ["rule"]).collect() == []


def test_bad_hosts_take_their_documents_along(spark, make_docs):
    rng = random.Random(5)
    clean = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(3, 8) for _ in range(80)) for _ in range(60)]
    rows = make_docs(*clean).withColumn("source", F.when(F.col("doc_id") < 50, F.concat(F.lit("s"), F.col("doc_id") % 5)))
    spam = make_docs(*["#$% |" * 30 + " " + clean[i] for i in range(40)], clean[0], ids=range(100, 141)).withColumn("source", F.lit("spam"))
    found = hostrules.judge(spark, rows.unionByName(spam)).collect()
    assert len(found) == 101
    kept = {r.doc_id for r in found if r.kept}
    assert kept == set(range(60))
    one = next(r for r in found if r.doc_id == 140)
    assert one.host_failed and not one.base_failed and not one.kept


def test_columns_and_empty_tables(spark, make_docs):
    docs = make_docs("a b c", None)
    found = hostrules.judge(spark, docs, prefix="q_")
    assert set(found.columns) >= (set(docs.columns) - {"text"}) | {"q_n_words", "q_base_failed", "q_kept"}
    assert {r.q_kept for r in found.collect()} == {False}
    assert hostrules.judge(spark, docs.limit(0)).collect() == []


def test_query(spark):
    got = spark_rows(QUERIES["op13_host_rules"](spark, FOLDER))
    assert difference(got, sql_rows(connect(FOLDER), OP13_SQL)) is None


def test_plan_stays_native(spark, make_docs):
    plan = hostrules.measured(make_docs("a"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
