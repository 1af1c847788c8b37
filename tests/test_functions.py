"""Column expressions: JSON arrays, dates, labels, set measures."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanery.functions import dates, jsonarrays, labels, sets, text
from gleanery.model import LABEL_HYPOTHESES


def apply(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[1] for r in rows.select("i", column(F.col("c"))).orderBy("i").collect()]


UNREADABLE = [None, "", '["ia"', "ia, web", '{"theme":"ia"}', "42", "null", "['a']", '["a"] junk', '["a",]', "[NaN]", '["a"]]', '["a"]}']


def test_unreadable_json_counts_as_absent(spark):
    assert apply(spark, UNREADABLE, jsonarrays.parse_json_array) == [None] * len(UNREADABLE)
    assert apply(spark, UNREADABLE, jsonarrays.parse_string_items) == [None] * len(UNREADABLE)
    with_default = apply(spark, UNREADABLE, lambda c: jsonarrays.parse_json_array(c, jsonarrays.empty_array()))
    assert with_default == [[]] * len(UNREADABLE)


def test_readable_json(spark):
    texts = ["[]", '["ia","web"]', ' [ "é" , "a\\"b" ] ', '[1,"a",null,{"x":1}]', '["]"]\n']
    assert apply(spark, texts, jsonarrays.parse_json_array) == [
        [],
        ["ia", "web"],
        ["é", 'a"b'],
        ["1", "a", None, '{"x":1}'],
        ["]"],
    ]
    assert apply(spark, texts, jsonarrays.parse_string_items) == [[], ["ia", "web"], ["é", 'a"b'], ["a"], ["]"]]


def test_tags_are_lowered_and_stripped(spark):
    tags = [["  React ", "TS"], None, [" Été　"]]
    assert apply(spark, tags, text.normalize_tags, "array<string>") == ['["react","ts"]', "[]", '["été"]']


@pytest.mark.parametrize(
    ("raw", "iso"),
    [
        ("Sat, 07 Feb 2026 23:35:22 +0000", "2026-02-07T23:35:22.000Z"),
        ("Thu, 29 Jan 2026 17:00:00 GMT", "2026-01-29T17:00:00.000Z"),
        ("1 April 2026 1:02 PST", "2026-04-01T09:02:00.000Z"),
        ("2026-02-05T07:36:00-08:00", "2026-02-05T15:36:00.000Z"),
        ("2026-01-15T10:00:00.1239Z", "2026-01-15T10:00:00.123Z"),
        ("2026-01-15", "2026-01-15T00:00:00.000Z"),
        ("  2026-01-15 ", "2026-01-15T00:00:00.000Z"),
        ("pas-une-date", None),
        ("   ", None),
        (None, None),
        ("T10", None),
        ("12:30", None),
        ("2026-02-30", None),
        ("31 Feb 2026 00:00:00 GMT", None),
    ],
)
def test_normalize_date(spark, raw, iso):
    assert apply(spark, [raw], dates.normalize_date) == [iso]


def test_calendar_parts_match_strftime(spark):
    start = dt.date(2019, 12, 25)
    days = [start + dt.timedelta(days=i) for i in range(2600)]
    assert apply(spark, days, dates.week_of_year, "date") == [int(d.strftime("%W")) for d in days]
    assert apply(spark, days, dates.day_of_week, "date") == [int(d.strftime("%w")) for d in days]


@pytest.mark.parametrize(
    ("day", "following"),
    [("2026-06-29", "2026-06-30"), ("2026-01-31", "2026-02-01"), ("2028-02-29", "2028-03-01"), ("2026-12-31", "2027-01-01")],
)
def test_day_bounds(day, following):
    assert dates.day_bounds(day) == (day, following)


@pytest.mark.parametrize(
    "day",
    ["pas-une-date", "2026-02-30", "2026-06-31", "2027-02-29", "2026-13-01", "2026-00-10", "2026-6-9", "26-06-29",
     "2026/06/29", "2026-06-29T10:00:00Z", " 2026-06-29", "2026-06-29\n", "２026-06-29"],
)
def test_day_bounds_refuses(day):
    with pytest.raises(ValueError, match="not a day"):
        dates.day_bounds(day)


def scored(spark, response):
    column = lambda c: labels.usable_scores(labels.score_pairs(c))
    rows = spark.createDataFrame([(response,)], "c string").select(column(F.col("c")).alias("u"))
    return tuple(rows.select(labels.kept_labels(F.col("u")), labels.top_score(F.col("u"))).first())


DEVOPS, SECURITY = LABEL_HYPOTHESES["DevOps/Infrastructure"], LABEL_HYPOTHESES["Sécurité"]


def test_scores_to_labels(spark):
    assert scored(spark, f'{{"labels":["{DEVOPS}","{SECURITY}"],"scores":[0.93,0.41]}}') == (["DevOps/Infrastructure"], 0.93)
    pairs = f'[{{"label":"{SECURITY}","score":0.85}},{{"label":"{DEVOPS}","score":0.72}}]'
    assert scored(spark, pairs) == (["Sécurité", "DevOps/Infrastructure"], 0.85)
    assert scored(spark, f'{{"labels":["{DEVOPS}"],"scores":[0.6]}}') == ([], 0.6)
    assert scored(spark, f'{{"labels":["{DEVOPS}","autre"],"scores":[0.7,0.99]}}') == (["DevOps/Infrastructure"], 0.7)
    mixed = f'{{"labels":["{DEVOPS}",3,"{SECURITY}"],"scores":["0.9",0.8,1]}}'
    assert scored(spark, mixed) == (["Sécurité"], 1.0)


@pytest.mark.parametrize("response", ['{"labels":["autre"],"scores":[0.9]}', '{"error":"x"}', "[]", "oops", None])
def test_unusable_responses(spark, response):
    assert scored(spark, response) == (None, None)


def test_label_lists(spark):
    cells = ['"IA/ML | Sécurité|"', "", None, "a||b"]
    assert apply(spark, cells, labels.split_labels) == [["IA/ML", "Sécurité"], [], [], ["a", "b"]]
    arrays = [["Sécurité", "IA/ML", "Sécurité"], [], ["IoT"]]
    assert apply(spark, arrays, labels.join_labels, "array<string>") == ["IA/ML|Sécurité", "", ""]
    assert apply(spark, [["IoT", "IA/ML", "IA/ML"], None], labels.canonical_only, "array<string>") == [["IA/ML", "IA/ML"], []]
    assert apply(spark, [0.00005, 0.12344, 0.93], lambda c: labels.round_half_up(c, 4), "double") == [0.0001, 0.1234, 0.93]


def test_set_measures(spark):
    rows = spark.createDataFrame(
        [(["a", "b"], ["b", "a"]), (["a", "b"], ["a", "c"]), (["a"], ["b"]), ([], []), ([], ["a"])],
        "a array<string>, b array<string>",
    )
    a, b = F.col("a"), F.col("b")
    got = rows.select(sets.same_set(a, b), sets.jaccard(a, b), sets.jaccard(a, b, False), sets.disjoint(a, b)).collect()
    assert [tuple(r) for r in got] == [
        (True, 1.0, 1.0, False),
        (False, 1 / 3, 1 / 3, False),
        (False, 0.0, 0.0, True),
        (True, 1.0, 0.0, True),
        (False, 0.0, 0.0, True),
    ]


def test_model_input(spark):
    rows = spark.createDataFrame([("T", "r"), ("T", None)], "t string, r string")
    assert [r[0] for r in rows.select(text.model_input(F.col("t"), F.col("r"))).collect()] == ["T. r", "T."]
