from datetime import date

import pytest
from pyspark.sql import functions as F

from factloom.functions import calendar, scores, text


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("said", "expected"),
    [("3 months", (0, 3, 0)), ("1 year and 2 weeks", (1, 0, 14)), ("2 days 3 days", (0, 0, 5)), ("P1Y6M", (1, 6, 0)), ("P3M2W", (0, 3, 14)), ("soon", None), ("", None)],
)
def test_offset(spark, said, expected):
    found = one(spark, calendar.offset_from_text(F.lit(said)))
    assert (tuple(found) if found else None) == expected


@pytest.mark.parametrize(
    ("start", "offset", "minus", "expected"),
    [
        (date(2025, 7, 12), (0, 3, 0), True, date(2025, 10, 11)), (date(2018, 3, 10), (6, 0, 0), False, date(2024, 3, 10)), (date(2025, 3, 10), (0, 0, 21), False, date(2025, 3, 31)),
        (date(2024, 1, 31), (0, 1, 0), False, date(2024, 2, 29)), (date(2024, 2, 29), (1, 0, 0), False, date(2025, 2, 28)),
    ],
)
def test_deadline_arithmetic(spark, start, offset, minus, expected):
    assert one(spark, calendar.apply_offset(F.lit(start), *offset, minus)) == expected


def test_allen_order_of_tests(spark):
    d = lambda n: F.lit(date(2024, 1, n))
    for (a, b, c, e), expected in {
        (1, 2, 3, 4): "BEFORE", (3, 4, 1, 2): "AFTER", (1, 3, 3, 5): "MEETS", (3, 5, 1, 3): "MET_BY", (1, 4, 2, 6): "OVERLAPS", (2, 6, 1, 4): "OVERLAPPED_BY", (1, 3, 1, 5): "STARTS",
        (1, 5, 1, 3): "STARTED_BY", (2, 3, 1, 5): "DURING", (1, 5, 2, 3): "CONTAINS", (3, 5, 1, 5): "FINISHES", (1, 5, 3, 5): "FINISHED_BY", (1, 2, 1, 2): "EQUALS",
    }.items():
        assert one(spark, calendar.allen(d(a), d(b), d(c), d(e))) == expected
    assert one(spark, calendar.allen(d(1), F.lit(None).cast("date"), d(1), d(2))) == "UNKNOWN"


def test_dates_and_periods(spark):
    assert one(spark, calendar.parse_date(F.lit("1st March 2024"))) == date(2024, 3, 1)
    assert one(spark, calendar.parse_date(F.lit("31/02/2024"))) is None
    assert one(spark, calendar.words_to_int(F.lit("one hundred and twenty"))) == 120
    assert one(spark, calendar.text_duration_days(F.lit("within three months"))) == 90
    assert one(spark, calendar.text_duration_days(F.lit("no period"))) is None
    assert tuple(one(spark, calendar.value_interval(F.lit("2024-02")))) == (date(2024, 2, 1), date(2024, 2, 29))
    assert tuple(one(spark, calendar.iso_period(F.lit("P1Y2M")))) == (1, 2, 0)
    assert one(spark, calendar.iso_period(F.lit("P"))) is None


def test_tolling(spark):
    d = lambda m, n: F.lit(date(2025, m, n))
    assert one(spark, calendar.tolled(d(10, 11), d(9, 1), d(9, 21))) == date(2025, 10, 31)
    assert one(spark, calendar.tolled(d(10, 11), d(9, 1), d(10, 10), (0, 1, 0))) == date(2025, 11, 19)
    assert one(spark, calendar.tolled(d(10, 11), d(10, 12), d(10, 30))) == date(2025, 10, 11)


def test_text(spark):
    assert one(spark, text.tokens(F.lit("Été, it's 3-fold"))) == ["été", "it", "s", "3", "fold"]
    assert one(spark, text.party_key(F.lit("Dr. Jane Roe of Acme Holdings Ltd 12"))) == ["acme", "jane", "roe"]
    assert one(spark, text.base_entity(F.lit("Article 3.1 The Contract"))) == "the contract"
    assert one(spark, text.normalise_entity(F.lit("Section 4(2) Claimant's  Notice"), ("claimant's",))) == "notice"
    assert one(spark, text.quote_supported(F.lit("a  long\nquoted sentence here"), F.lit("long quoted sentence")))
    assert not one(spark, text.quote_supported(F.lit("a long quoted sentence"), F.lit("long")))
    stated = one(spark, text.stated_offsets(F.lit("within twenty-one days, or 3 months")))
    assert {tuple(x) for x in stated} == {(21, "day"), (3, "month")}
    assert one(spark, text.mentions_date(F.lit("on 03 March 2024"), F.lit(date(2024, 3, 3))))
    assert not one(spark, text.mentions_date(F.lit("on 3rd March 2024"), F.lit(date(2024, 3, 3))))  # the day must be a word
    assert one(spark, text.mentions_date(F.lit("03/03/24"), F.lit(date(2024, 3, 3))))
    assert not one(spark, text.mentions_date(F.lit("it may be 2024"), F.lit(date(2024, 5, 3))))
    assert one(spark, text.normalize_whitespace(F.lit("a-\nb  c \r\n\n\n\nd "))) == "ab c\n\nd"
    assert [x["sentence"] for x in one(spark, text.sentences(F.lit("One. Two; three\n\nfour")))] == ["One.", "Two;", "three", "four"]
    kept = one(spark, text.clean_paragraphs(F.lit("Page 1 of 2\n\nThe meeting was on 3 May 2024\nat noon.\n\nshort")))
    assert kept["kept"] == ["The meeting was on 3 May 2024 at noon."] and kept["dropped"] == ["Page 1 of 2", "short"]


def test_scores(spark):
    weights = F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(1.0))
    a, b = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"))
    assert one(spark, scores.weighted_jaccard(a, b, weights)) == pytest.approx(2 / 3)
    assert one(spark, scores.weighted_containment(a, b, weights)) == pytest.approx((2 / 3 + 1) / 2)
    assert one(spark, scores.role_compatibility(F.lit("START"), F.lit("END"))) == 0
    assert one(spark, scores.role_compatibility(F.lit("START"), F.lit("CONTAINS"))) == 0.85
    assert one(spark, scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 1
    assert one(spark, scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, scores.pair_score(F.lit(1.0), F.lit(1.0), F.lit(None).cast("double"), F.lit(0.85))) == pytest.approx(0.85)
