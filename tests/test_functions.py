"""Time expressions and trigger words, case by case."""

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import scalar as S


def texts(spark, column, cases):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    return [r["x"] for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_shapes(spark):
    cases = {
        "14:30": "TIME", "5 p.m": "TIME", "noon": "TIME", "the 1990s": "DECADE_CENT", "19th century": "DECADE_CENT", "1914–1918": "YEAR_RANGE", "44 to 20 BC": "YEAR_RANGE", "3-5 May": "DAY_RANGE",
        " 1996 ": "YEAR", "44 bc": "OTHER", "AD 70": "YEAR", "12": "BARE_NUM", "May 5, 1996": "FULL_DATE", "May 1996": "MONTH_YEAR", "5 Sept": "DAY_MONTH", "august": "MONTH", "two days later": "REL_QTY", "the next week": "REL_QTY",
        "three weeks": "QTY", "ten-year": "QTY", "a few days": "QTY", "the war": "RELATIVE", "now": "RELATIVE", "late 1996": "HAS_YEAR", "spring": "OTHER", "": "OTHER", None: "OTHER",
    }
    assert dict(zip(cases, texts(spark, S.surface_shape, cases))) == cases


def test_dates(spark):
    cases = {
        "May 5, 1996": (1996, 5, 5), "5 Sep 1996": (1996, 9, 5), "mid-december 1999": (1999, 12, 0), "mayor of 1996": (1996, 5, 0), "1996": (1996, 0, 0), "32 May 1996": (1996, 5, 32 - 32), "39 March 2001": (2001, 3, 0),
        "2199 May": None, "0999": None, "sept 1996": (1996, 0, 0), None: None,
    }
    assert dict(zip(cases, texts(spark, S.parse_date, cases))) == cases


@pytest.mark.parametrize(("word", "kind"), [("Began", "BEGIN"), ("opening", "BEGIN"), ("beginners", "none"), ("founder", "none"), ("Withdrew", "END"), ("died", "END"), ("endless", "none"), ("lasted", "DUR"), ("wars", "DUR"), ("warship", "none")])
def test_trigger_words(spark, word, kind):
    assert texts(spark, S.trigger_class, [word]) == [kind]
