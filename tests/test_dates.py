"""Texts are parsed only by the date-time layouts that they look like."""

from pyspark.sql import functions as F

from tabprobe.operators import profile

DATES = ["2024-01-31", "2024-01-31 10:05", "2024-01-31 10:05:09", "2024-01-31 10:05:09.123456", "2024-01-31 10:05:09+02:00",
         "2024-01-31T10:05", "2024-01-31t10:05:09", "2024-01-31T10:05:09.123", "2024-01-31T10:05:09Z", "2024-01-31T10:05:09.123-01:30",
         "2024/01/31", "2024/01/31 10:05:09", "31.01.2024", "31.01.2024 10:05", "01/31/2024", "01/31/2024 10:05", "3 Jan 2024",
         "13 JANUARY 2024", "jan 3, 2024", "January 31, 2024", "3-Jan-2024", " 2024-01-31 "]
OTHERS = ["173665.47", "12", "600000", "1-URGENT", "4-NOT SPECIFIED", "2024-02-30", "2024-13-01", "31.13.2024", "3 Foo 2024",
          "2024-01-31x", "+2024-01-31", "+12024-01-31", "-3 Jan 2024", "0003 Jan 2024", "2024-1-31", "May", "1.2.3", "2024-01-31 10:05:09 +02:00", "a, b"]


def test_shapes_lose_no_date(spark):
    """The same texts are dates as when every layout is tried on every text."""
    df = spark.createDataFrame([(t,) for t in DATES + OTHERS], "t string")
    t, every = F.trim("t"), F.lit(False)
    for fmt in profile.DATETIME_FORMATS:
        every = every | F.try_to_timestamp(t, F.lit(fmt)).isNotNull()
    rows = df.select("t", profile._is_datetime(F.col("t")).alias("got"), (t.rlike(profile.DATETIME_SHAPE) & every).alias("want")).collect()
    assert all(r["got"] == r["want"] for r in rows), [r for r in rows if r["got"] != r["want"]]
    assert all(r["got"] for r in rows if r["t"] in DATES)


def test_other_texts_are_not_parsed(spark):
    """A number or a code looks like no layout, so no parse is tried on it."""
    import re
    shapes = [re.compile(profile.layout_shape(f), re.I) for f in profile.DATETIME_FORMATS]
    for text in ("173665.47", "12", "600000", "1-URGENT", "4-NOT SPECIFIED", "Clerk 12"):
        assert not any(s.fullmatch(text) for s in shapes), text
    assert [f for f, s in zip(profile.DATETIME_FORMATS, shapes) if s.fullmatch("1996-01-02")] == ["yyyy-MM-dd"]
