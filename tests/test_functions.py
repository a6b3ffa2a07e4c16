from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pressmill.functions import dates, geo, scoring, text, values


def one(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Thu Feb 29 13:57:27 +0000 2024", datetime(2024, 2, 29, 13, 57, 27)),
        ("2025-03-31 10:57:46 +00000", datetime(2025, 3, 31, 10, 57, 46)),
        ("2025-03-21T12:19:52.000Z", datetime(2025, 3, 21, 12, 19, 52)),
        ("2025-03-21T12:19:52+02:00", datetime(2025, 3, 21, 12, 19, 52)),
        ("04:19 09 Mar 2025", datetime(2025, 3, 9, 4, 19)),
        ("2025-03-14 16:17:49", datetime(2025, 3, 14, 16, 17, 49)),
        ("2025-03-14 16:17:49.5", None),
        ("12/04/2024, 08:00 AM, +0000 UTC", datetime(2024, 4, 12, 8, 0)),
        ("unknown", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_date(spark, raw, expected):
    assert one(spark, dates.parse_date, raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [("Earth", None), (" Lagos ,  Nigeria. ", "Lagos , Nigeria"), ("NIGERIA", "Nigeria"), ("https://x.y", None), ("10.0.0.1", None), ("a@b.c", None), ("world, far", None), ("far,world", None), (None, None), ("", None)],
)
def test_clean_location(spark, raw, expected):
    assert one(spark, geo.clean_location, raw) == expected


def test_normalize_text(spark):
    assert one(spark, text.normalize_text, "  Hello   WORLD! https://a.b/c  (ok) ") == "hello world!  ok"
    assert one(spark, text.normalize_text, None) == ""
    assert one(spark, text.normalize_strict, "Café, déjà-vu!") == "café déjàvu"


def test_values(spark):
    assert [one(spark, values.safe_long, x) for x in ("1.0", "-2.7", "nan", "x", None)] == [1, -2, None, None, None]
    assert one(spark, values.safe_double, "NaN") is None


def test_urls(spark):
    assert one(spark, geo.url_domain, "https://www.fark.com/comments/13591050") == "fark.com"
    assert one(spark, geo.url_domain, "see www.abc.com/x") == "abc.com"
    assert one(spark, geo.url_domain, "nothing") == ""
    assert one(spark, geo.country_from_domain, "bbc.co.uk") == "uk"


def test_location_without_text(spark):
    judged = lambda c, **how: geo.classify_location(c, F.lit("src1"), F.lit(""), F.lit("London, UK"), F.lit("user1"), F.lit(""), **how)
    for raw in (None, ""):
        assert tuple(one(spark, judged, raw)) == (None, None)
        assert tuple(one(spark, lambda c: judged(c, needs_text=False), raw)) == ("uk", 0.7)
    assert tuple(one(spark, judged, "x")) == tuple(one(spark, lambda c: judged(c, needs_text=False), "x")) == ("uk", 0.7)


def test_ministry_first_of_equals(spark):
    assert one(spark, scoring.ministry, "a new road and a school") == "works"
    assert one(spark, scoring.ministry, "nothing here") == "non_governance"
    assert one(spark, scoring.ministry, "hospital doctor school") == "health_social_welfare"


def test_slugs_and_lines(spark):
    assert one(spark, text.slug, "Fuel Price: Hike!") == "fuel-price-hike"
    assert one(spark, text.slug, "!!!") == "general-issue"
    assert one(spark, lambda c: text.first_number(c, "reach"), "likes 3\nReach: 12.5 of 20") == 12.5
    got = one(spark, scoring.scorer_lines, "Sentiment: Negative\nSentiment Score: -0.7\nJustification: because\nTopics: a, b")
    assert (got.label, got.score, got.justification, got.topics) == ("negative", -0.7, "because", ["a", "b"])


def test_webvtt(spark):
    raw = "WEBVTT\n\n1\n00:00:00.000 --> 00:00:01.000\nHello\n\n2\n00:00:01.000 --> 00:00:02.000\nworld\n"
    assert one(spark, text.webvtt_text, raw) == "Hello world"


def test_automaton_finds_overlapping_terms(spark):
    from pressmill.functions import automaton

    terms = ["he", "she", "hers", "his", "is", "s", "", "he", "ab", "ba", "a b", "é", "she sells"] + [f"t{i}" for i in range(60)]
    texts = ["ushers", "this", "", None, "abab a b", "é t5 t55", "she sells", "zzz"]
    for find in (automaton.finder(tuple(terms)),):
        assert [find(x) for x in texts if x is not None] == [[i for i, t in enumerate(terms) if t in x] for x in texts if x is not None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = {r.id: r for r in df.select("id", automaton.found_terms(F.col("text"), terms).alias("f"), automaton.contains_any(F.col("text"), terms[:6]).alias("any"), automaton.first_rule(F.col("text"), [("x", ["hers", "sells"]), ("y", ["he"]), ("x", ["is"])], "none").alias("first")).collect()}
    for i, x in enumerate(texts):
        assert rows[i].f == (None if x is None else [k for k, t in enumerate(terms) if t in x])
        assert rows[i].any == (None if x is None else any(t in x for t in terms[:6]))
    assert [rows[i].first for i in range(8)] == ["x", "x", "none", "none", "none", "none", "x", "none"]


def test_rules_of_few_and_of_many_terms_agree(spark, monkeypatch):
    from pressmill.functions import automaton, categories, scoring

    rules = {"one": ["he", "her"], "two": ["is", "he"], "three": ["xyz"]}
    df = spark.createDataFrame([("ushers",), ("this he",), ("none",), (None,), ("xyz is her",)], "text string")
    found = []
    for many in (1, 1000):
        monkeypatch.setattr(automaton, "MANY", many)
        columns = [scoring.ministry(F.col("text"), rules), scoring.topics(F.col("text"), rules), scoring.inferred_ministry(F.col("text"), F.array().cast("array<string>"), {"a": "b"}, rules), categories.issue_title(F.col("text"), rules)["slug"]]
        found.append([tuple(r) for r in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()])
    assert found[0] == found[1] and found[0][0][0] == "one" and found[0][1][1] == ["one", "two"]


#: What the library for dates of Python's data tools reads with 29 February 2024 for missing parts.
WRITTEN_DATES = {
    "May 3, 2024": "2024-05-03", "3 May 2024": "2024-05-03", "3rd of May 2024": "2024-05-03", "May 2024": "2024-05-29", "May": "2024-05-29", "3 May": "2024-05-03", "Monday": "2024-03-04",
    "fri 3pm": "2024-03-01 15:00", "2024": "2024-02-29", "1/2/99": "1999-01-02", "1-2-03": "2003-01-02", "2023-7": "2023-07-29", "7/2023": "2023-07-29", "20240503": "2024-05-03",
    "20240503101112": "2024-05-03 10:11:12", "202405031011": "2024-05-03 10:11", "10:30": "2024-02-29 10:30", "10:30 pm": "2024-02-29 22:30", "3 pm": "2024-02-29 15:00", "12 am": "2024-02-29 00:00",
    "12:05 AM 5 Jan 2020": "2020-01-05 00:05", "5 Jan 20": "2020-01-05", "Jan 5 20": "2020-01-05", "99-Jan-05": "1999-01-05", "5-Jan-99": "1999-01-05", "2024.05.03": "2024-05-03",
    "May 3 2024 at 3:07 p.m.": "2024-05-03 15:07", "Thu Feb 29 13:57:27 2024": "2024-02-29 13:57:27", "9 Sept 2021 11:22 +0530": "2021-09-09 11:22", "31 Feb 2020": None, "hello": None, "45/45/45": None,
    "13:99": None, "tomorrow": None, "Feb 2023": "2023-02-28", "December 31": "2024-12-31", "1st June": "2024-06-01", "Wednesday 5 June 2024 at 4pm": "2024-06-05 16:00", "June 5th '21": "2021-06-05",
    "11 12 13": "2013-11-12", "13 12 11": "2011-12-13",
}


def test_general_dates(spark):
    from pressmill.functions.date_text import parse_text

    default = datetime(2024, 2, 29)
    want = {x: datetime.fromisoformat(v) if v else None for x, v in WRITTEN_DATES.items()}
    assert {x: parse_text(x, default) for x in want} == want
    try:
        from dateutil import parser
    except ImportError:
        parser = None
    for x, v in want.items() if parser else ():
        try:
            assert parser.parse(x, default=default).replace(tzinfo=None) == v, x
        except (ValueError, OverflowError):
            assert v is None, x
    rows = spark.createDataFrame([(x,) for x in want] + [(None,), ("none",), ("2024-05-03 10:11:12",), ("2024-99-03 10:11:12",)], "v string")
    got = {r.v: r.d for r in rows.select("v", dates.parse_date(F.col("v"), default="2024-02-29").alias("d")).collect()}
    # the fixed formats come first; a text that a strict one claims and can't read stays null
    assert got == want | {None: None, "none": None, "2024-05-03 10:11:12": datetime(2024, 5, 3, 10, 11, 12), "2024-99-03 10:11:12": None}
