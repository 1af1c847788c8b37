"""Annotation files."""

from __future__ import annotations

import pytest

from gleanery.operators import annotations, stats
from gleanery.sources import files

from .conftest import as_tuples


@pytest.fixture
def annotated(spark, make_articles, tmp_path):
    def load(body: str):
        path = tmp_path / "annotations.csv"
        path.write_text(body, encoding="utf-8")
        known = make_articles(*[{}] * 5)
        return annotations.validate_annotations(files.read_annotation_lines(spark, str(path)), known)

    return load


def test_rejects_in_order(annotated):
    valid, rejects = annotated(
        "﻿ID , themes_manuels\r\n1,IA/ML|Sécurité\r\n\r\nrien\r\nabc,IA/ML\r\n99,IA/ML\r\n2,IoT\r\n2,IA/ML\r\n"
        '1,IA/ML\r\n 3 ,"Sécurité | IA/ML"\r\n4,\r\n1.5,IA/ML\r\n5.0,IA/ML\r\n,IA/ML\r\n'
    )
    assert sorted((r["ligne"], r["motif"]) for r in rejects.collect()) == [
        (3, "no comma"),
        (4, "id is not an integer"),
        (5, "unknown id"),
        (6, "unknown label"),
        (7, "duplicate id"),
        (8, "duplicate id"),
        (11, "id is not an integer"),
        (13, "unknown id"),
    ]
    assert as_tuples(annotations.canonical_sheet(valid)) == [(1, "IA/ML|Sécurité"), (3, "IA/ML|Sécurité"), (4, ""), (5, "IA/ML")]
    assert as_tuples(annotations.without_label(valid)) == [(4,)]
    counts = {r["theme"]: r["nb"] for r in stats.label_distribution(valid, "themes").collect()}
    assert counts["IA/ML"] == 3 and counts["Sécurité"] == 2 and counts["Architecture"] == 0 and len(counts) == 7
    with pytest.raises(annotations.AnnotationsRejected, match="L3: no comma"):
        annotations.require_valid(rejects)


def test_clean_file_passes(annotated):
    valid, rejects = annotated("id,themes_manuels\n1,IA/ML\n")
    annotations.require_valid(rejects)
    assert valid.count() == 1


@pytest.mark.parametrize("body", ["", "\n\n", "titre,themes\n1,IA/ML\n"])
def test_header_is_required(annotated, body):
    with pytest.raises(files.BadHeader):
        annotated(body)


def test_line_numbers_across_splits(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("id,themes_manuels\n" + "".join(f"{i},IA/ML\n" for i in range(2, 5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        lines = files.read_annotation_lines(spark, str(path))
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 1
        got = {r["ligne"]: r["texte"] for r in lines.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {i: f"{i},IA/ML" for i in range(2, 5000)}


def test_work_sheet(spark, make_articles):
    suggestions = spark.createDataFrame([(1, ["IA/ML"])], "id long, themes array<string>")
    sheet = annotations.annotation_sheet(make_articles({}, {"themes_mistral": '["IA/ML"]'}), suggestions)
    assert sheet.columns == ["id", "titre", "resume", "source", "url", "themes"]
    assert sorted((r["id"], r["themes"]) for r in sheet.collect()) == [(1, ["IA/ML"]), (2, [])]
