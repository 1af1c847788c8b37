"""WARC archives: what is written is read back, whatever the ranges cut."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from gleanery.llm import warc
from gleanery.llm.queries import OP9_SQL, QUERIES

from ..oracle import connect, difference, spark_rows, sql_rows

SCHEMA = "page_id long, url string, html string, digest string, response int, path string"


def pages(spark):
    twin, rng = "<p>é</p>" * 200, random.Random(1)
    noise = "".join(chr(rng.randrange(32, 0x2000)) for _ in range(70_000))
    rows = [(1, "http://a/", twin), (2, None, twin), (7, "http://a/ b\r\nX: y", twin), (7, "http://b/", twin), (None, "u", twin)]
    rows += [(3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (8, "u", noise), (None, None, None)]
    return spark.createDataFrame([(*r, "d", 5, "p") for r in rows], SCHEMA)


def expected(rows):
    payloads = [(r.page_id, (r.html or "").encode()) for r in rows]
    out = []
    for page, body in payloads:
        twins = [p for p, b in payloads if b == body and p is not None]
        revisit = len(body) >= 1000 and sum(b == body for _, b in payloads) > 1 and twins and page != max(twins)
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", max(twins) if revisit else None))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_every_split_reads_each_record_once(spark):
    given = pages(spark)
    files = warc.write(spark, given.coalesce(2))
    want = expected(given.collect())
    for split in (64, 777, 5000, 1 << 20):
        assert found(warc.read(spark, files, split)) == want
    whole = {r.page_id: r for r in warc.read(spark, files).where("record_type = 'response' AND page_id = 8").collect()}
    assert bytes(whole[8].payload).decode() == given.where("page_id = 8").first().html


def test_groups_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", 0)
    given = pages(spark)
    assert found(warc.read(spark, warc.write(spark, given))) == expected(given.collect())


def test_empty_table(spark):
    assert warc.read(spark, warc.write(spark, pages(spark).limit(0))).collect() == []


class Bytes:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at : at + n]


def members(n, body=b"x" * 50):
    return [warc.member(i, "u", body, hashlib.sha1(body).hexdigest(), None) for i in range(n)]


def by_ranges(data, split):
    return [r[3] for start in range(0, len(data), split) for r in warc.records(Bytes(data), len(data), start, start + split, "f")]


def test_archive_inside_a_payload_is_not_read():
    inner = b"".join(members(5))
    outer = warc.member(100, "u", inner, hashlib.sha1(inner).hexdigest(), None)
    stored = gzip.compress(gzip.decompress(outer), compresslevel=0)  # members stand in it byte by byte
    data = b"".join(members(2)) + stored + b"".join(members(3))
    for split in (len(inner) + 300, 5000, len(data)):
        assert sorted(by_ranges(data, split)) == sorted([0, 1, 100, 0, 1, 2])


def test_a_broken_member_loses_only_itself():
    parts = members(5)
    parts[2] = parts[2][:20] + b"\xff\xff\xff" + parts[2][23:]
    data = b"".join(parts)
    for split in (100, 300, len(data)):
        assert by_ranges(data, split) == [0, 1, 3, 4]


def test_other_gzip_members_are_passed_over():
    data = gzip.compress(b"no record") + b"".join(members(2))
    assert by_ranges(data, 60) == [0, 1]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    got = spark_rows(QUERIES["op9_warc"](spark, folder))
    assert difference(got, sql_rows(connect(folder), OP9_SQL)) is None


def test_damaged_magic_loses_one_record():
    parts = members(6)
    parts[3] = b"\x00\x00\x00" + parts[3][3:]
    data = b"".join(parts)
    for split in (100, 300, 700, len(data)):
        assert by_ranges(data, split) == [0, 1, 2, 4, 5]


def test_trailing_and_inner_zeros_lose_nothing():
    data = b"".join(members(3)) + bytes(500) + b"".join(members(2)) + bytes(700)
    for split in (100, 300, 777, len(data)):
        assert by_ranges(data, split) == [0, 1, 2, 0, 1]


def test_archive_inside_another_gzip_member_is_not_read():
    stored = gzip.compress(b"no record" + b"".join(members(4)) + b"end", compresslevel=0)
    data = b"".join(members(2)) + stored + b"".join(members(3)) + bytes(50)
    for split in (len(stored) + 10, 5000, len(data)):
        assert by_ranges(data, split) == [0, 1, 0, 1, 2]
