"""Line dedup against SQL and a plain loop."""

from __future__ import annotations

from collections import Counter

from gleanery.llm import linededup
from gleanery.llm.queries import OP5_SQL, QUERIES

from ..oracle import connect, difference, spark_rows, sql_rows


def plain(rows, ratio, least):
    bare = lambda line: line.strip(" \t\r")
    totals, counts = Counter(h for _, _, h in rows if h is not None), Counter()
    for _, text, host in rows:
        counts.update({(host, bare(x)) for x in (text or "").split("\n") if bare(x)})
    out = []
    for key, text, host in rows:
        lines = [] if text is None else text.split("\n")
        bad = lambda x: host is not None and bare(x) and counts[host, bare(x)] >= least and counts[host, bare(x)] > ratio * totals[host]
        kept = [x for x in lines if not bad(x)]
        if len(kept) == len(lines) or not any(map(bare, kept)):
            kept = lines
        out.append((key, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_against_a_loop(spark, monkeypatch):
    rows = [(i, f"menu\n  line {i}\n\nfooter \t", "a") for i in range(20)]
    rows += [(100 + i, "menu\r\nfooter", "a") for i in range(3)]  # nothing but boilerplate: left as they were
    rows += [(200, None, "a"), (201, "", "a"), (202, "\n\n", "a"), (203, "menu\nmenu\nown", "a"), (203, "menu\nmenu\nown", "a")]
    rows += [(300 + i, f"menu\nb{i}", "b") for i in range(3)] + [(400 + i, "menu\nx", None) for i in range(9)] + [(None, "menu\nz", "a")]
    schema = "doc_id long, text string, source string, n_lines_ int, line string, total int, _x string"
    docs = spark.createDataFrame([(*r, 1, "l", 2, "x") for r in rows], schema)
    for few in (linededup.BROADCAST_LINES, 0):
        found = linededup.remove_boilerplate(spark, docs, broadcast_lines=few)
        assert found.columns == [*docs.columns, "n_lines", "n_dropped"]
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in found.collect()), key=str)
        assert got == plain(rows, linededup.RATIO, linededup.MIN_PAGES)
    assert linededup.remove_boilerplate(spark, docs.limit(0)).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    got = spark_rows(QUERIES["op5_line_dedup"](spark, folder))
    assert difference(got, sql_rows(connect(folder), OP5_SQL)) is None
