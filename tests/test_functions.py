"""Values of the column functions, from the rules they implement."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabwright.functions import dates, numbers, text, units


def values(spark, inputs, expression, type_="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, c {type_}")
    return [r["v"] for r in rows.select("i", expression(F.col("c")).alias("v")).orderBy("i").collect()]


def test_parse_bool(spark):
    assert values(spark, ["Yes", "off", "T", "2", None], numbers.parse_bool) == [1.0, 0.0, 1.0, None, None]


def test_parse_number(spark):
    got = values(spark, ["1,250 kg", "75%", "€ 3.5", "-", "1f", "1e3", "inf", "5 miles", "$-4.5", "1d"], numbers.parse_number)
    assert got == [1250.0, 75.0, 3.5, None, None, 1000.0, None, 5.0, -4.5, None]


def test_parse_number_loose(spark):
    assert values(spark, ["45 km", "1e3", "5-3", "", "2h 50m", "$1,000"], numbers.parse_number_loose) == [45.0, 13.0, None, None, 250.0, 1000.0]


def test_durations_and_units(spark):
    assert values(spark, ["2h 50min", "00:15:30", "5 days", "soon", None, "1 week"], units.duration_minutes) == [170.0, 15.5, 7200.0, None, None, 10080.0]
    assert values(spark, ["15 kg", "5 g", "5 m", "x"], units.unit_value) == [15.0, 0.005, None, None]
    assert values(spark, ["2 km", "50 cm"], lambda c: units.unit_value(c, "m")) == [2000.0, 0.5]


def test_split_structured(spark):
    got = values(spark, ["12 items left", "Red-Blue", None], units.split_structured)
    assert (got[0]["number"], got[0]["parts"]) == (12.0, ["items", "left"])
    assert (got[1]["number"], got[1]["parts"]) == (None, ["Red", "Blue"])


def test_round_half_even(spark):
    assert values(spark, [0.5, 1.5, 2.5, None], numbers.to_int, "double") == [0, 2, 2, None]


def test_weekday_starts_on_monday(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 7, 8),)], "c timestamp")
    got = dates.expand_datetime(rows, "c").first().asDict()
    assert got == {"c__year": 2024.0, "c__month": 1.0, "c__day": 1.0, "c__weekday": 0.0, "c__hour": 7.0, "c__minute": 8.0}


@pytest.mark.parametrize("dayfirst, month, day", [(False, 1, 2), (True, 2, 1)])
def test_numeric_dates_follow_the_asked_order(spark, dayfirst, month, day):
    got = values(spark, ["01/02/24", "2024-01-01", "bad-date", "20240101", "13/05/2022", "05/13/2022", "5.6.99"], lambda c: dates.parse_date(c, dayfirst))
    assert got[0] == dt.datetime(2024, month, day)
    assert got[1] == dt.datetime(2024, 1, 1)
    assert got[2] is None and got[3] is None
    assert got[4] == got[5] == dt.datetime(2022, 5, 13)
    assert got[6].year == 1999


def test_dates_with_clock_zone_and_names(spark):
    got = values(spark, ["2024-01-01T10:30:05Z", "2024-01-01T10:30:05+0200", "1 Jan 2020", "March 7, 2020", "12 Marble 2020", "2024-02-30"], dates.parse_date)
    assert got == [
        dt.datetime(2024, 1, 1, 10, 30, 5), dt.datetime(2024, 1, 1, 8, 30, 5), dt.datetime(2020, 1, 1), dt.datetime(2020, 3, 7), None, None,
    ]


def test_normalize(spark):
    inputs = [" New   York ", "​Unknown", "ＡＢ", "a\t b\r\nc", "N/A", '{"b": 1, "a": [2, {"z": 1, "y": null}]}', "{bad}", "�", None]
    got = values(spark, inputs, lambda c: text.normalize(c, lower=False, compose=True))
    assert got == ["New York", None, "AB", "a b c", None, '{"a":[2,{"y":null,"z":1}],"b":1}', "{bad}", None, None]


def test_normalized_columns_equal_the_single_expression(spark):
    inputs = [" New   York ", "unknown", "Ａ", '{"b":1,"a":2}', "", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, c string")
    staged = [r["c"] for r in text.normalized(rows, ["c"], compose=True).orderBy("i").collect()]
    assert staged == values(spark, inputs, lambda c: text.normalize(c, compose=True))


def test_decode_falls_back_to_latin1(spark):
    assert values(spark, [bytearray("é".encode()), bytearray(b"\xe9")], text.decode_text, "binary") == ["é", "é"]


def test_alias_matches_with_spaces_removed(spark):
    assert values(spark, ["NY", "new york", "u s a", "Oslo"], text.apply_alias) == ["new york", "new york", "united states", "oslo"]


def test_flatten_nested_sorts_keys(spark):
    rows = spark.sql("SELECT named_struct('b', 1, 'a', array(1, 2)) AS s, map('y', 1, 'x', 2) AS m, CAST('hi' AS binary) AS b")
    assert tuple(text.flatten_nested(rows).first()) == ('{"a":[1,2],"b":1}', '{"x":2,"y":1}', "hi")


def test_clip_and_log_keep_nulls(spark):
    assert values(spark, [-5.0, 50.0, None], lambda c: numbers.clip(c, 0.0, 10.0), "double") == [0.0, 10.0, None]
    assert values(spark, [-1.0, 0.0, None], numbers.log1p_clipped, "double") == [0.0, 0.0, None]


def test_unbiased_skew(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10, 50)], "v double")
    assert rows.agg(numbers.unbiased_skew(F.col("v")).alias("s")).first()["s"] == pytest.approx(2.0855561345)


def test_name_tokens():
    assert text.name_tokens("RainTomorrow") == ["rain", "tomorrow"]
    assert text.name_tokens("event_date2") == ["event", "date"]
    assert "y" not in text.name_tokens("city")


CLOCK_CASES = {
    "01/02/2024 3:30 PM": "2024-01-02 15:30:00", "01/02/2024 12:05 am": "2024-01-02 00:05:00", "1/2/2024 12:00 p.m.": "2024-01-02 12:00:00",
    "2024-01-02T03:04:05.123456789Z": "2024-01-02 03:04:05.123456", "2024-01-02 10:00 EST": "2024-01-02 15:00:00", "5 March 2024 7 p.m.": "2024-03-05 19:00:00",
    "Mar 5, 2024 07:08:09 PM GMT": "2024-03-05 19:08:09", "01-02-2024 10:00 +0100": "2024-01-02 09:00:00", "2024-01-02 10:00:00+05:30": "2024-01-02 04:30:00",
    "31/12/1999 11:59:59 P.M. CET": "1999-12-31 22:59:59", "13/02/24": "2024-02-13 00:00:00", "may 1 2024": "2024-05-01 00:00:00",
    "20240102": None, "3 PM": None, "2024-01-02 13:00 PM": None, "2024-13-45": None, "12-34-56-7890": None, "": None, None: None,
}


def test_clocks_with_halves_fractions_and_zones(spark):
    rows = spark.createDataFrame([(k,) for k in CLOCK_CASES], "d string").select("d", dates.parse_date(F.col("d")).cast("string").alias("t")).collect()
    assert {r.d: r.t for r in rows} == CLOCK_CASES


def test_date_orders_are_voted_by_column(spark):
    cells = {"dmy": ["01/02/2024", "13/02/2024", "2024-01-05"], "mdy": ["01/02/2024", "02/13/2024"], "iso": ["2024-01-05", "2024/01/13"], "even": ["01/02/2024 3 PM"], "ydm": ["2024-13-01"] * 3 + ["2024-01-02"], "none": ["x", None]}
    values = spark.createDataFrame([(c, v, 1) for c, vs in cells.items() for v in vs], "column string, value string, n long")
    assert dates.vote_orders(values) == {"dmy": "dmy", "mdy": "mdy", "iso": "ymd", "even": "mdy", "ydm": "ydm"}
    assert dates.vote_orders(values, dayfirst=True)["even"] == "dmy"
    parsed = spark.createDataFrame([("01/02/2024",), ("2024-01-05",), ("02/13/2024",)], "d string").select(dates.parse_date(F.col("d"), order="dmy").cast("date").cast("string").alias("t")).collect()
    assert [r.t for r in parsed] == ["2024-02-01", "2024-01-05", "2024-02-13"]
