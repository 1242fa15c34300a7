import math

import pytest
from pyspark.sql import functions as F

from fixlake.functions.summary import format_int, format_money, format_price, format_qty, pad_cell, raw_display, side_label, truncate, utc_time
from fixlake.functions.values import human_duration, number, parse_duration, quantity, sending_ns, u32


def column(spark, f, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t")).alias("v")).collect()]


def test_numbers(spark):
    assert column(spark, u32, "0", "007", "4294967295", "4294967296", "", "-1", "+1", " 1", "1a", None) == [0, 7, 4294967295] + [None] * 7
    assert [None if v is None else int(v) for v in column(spark, quantity, "12", "12.x", ".5", "", "-1", "18446744073709551615", "18446744073709551616")] == [12, 12, 0, None, None, 18446744073709551615, None]
    got = column(spark, number, "1.5", "-.5", "1e3", "inf", "-inf", "nan", " 1", "1d", "", "5.")
    assert got[:5] == [1.5, -0.5, 1000.0, math.inf, -math.inf] and math.isnan(got[5]) and got[6:] == [None, None, None, 5.0]


def test_times(spark):
    day = 86_400_000_000_000
    got = column(spark, sending_ns, "19700101-00:00:00", "19700102-00:00:00.5", "19700101-25:00:00", "20260231-00:00:00", "20260303-00:00:00", "19691231-23:59:59", "19700101-00:00:00.", "19700101-00:00:00.1234567890", "19701301-00:00:00", "x", None)
    assert got[:3] == [0, day + 500_000_000, 25 * 3600 * 10**9] and got[3] == got[4] and got[5:] == [None] * 6
    assert column(spark, lambda t: utc_time(sending_ns(t)), "20260416-13:32:06.200") == ["2026-04-16 13:32:06"]


def test_durations():
    assert [parse_duration(t) for t in ("1s", " 500ms ", "2m", "3 us", "7ns", "x", "1h", "", "-1s")] == [10**9, 5 * 10**8, 120 * 10**9, 3000, 7, None, None, None, None]
    assert [human_duration(n) for n in (60 * 10**9, 10**9, 5 * 10**6, 7, 3000)] == ["1m", "1s", "5ms", "7ns", "3us"]


def test_shown(spark):
    assert column(spark, format_qty, "1234567", "-1234.50", "999", "12a", "", "+1000") == ["1,234,567", "-1,234.50", "999", "12a", "", "+1,000"]
    assert column(spark, lambda t: truncate(t, 4), "abcd", "abcde") == ["abcd", "abc…"] and column(spark, lambda t: pad_cell(t, 3), "a", "abcd") == ["a  ", "abc"]
    assert column(spark, raw_display, "8=F\x019=é\x02") == ["8=F|9=.."] and column(spark, side_label, "1", "9", "z", None) == ["BUY", "CROSSS", "?", None]
    row = spark.range(1).select(format_int(F.lit(1234567)), format_money(F.lit(1234.5)), format_price(F.lit(0.0)), format_price(F.lit(1.5))).first()
    assert tuple(row) == ("1,234,567", "1,234.50", "-", "1.5000")


@pytest.mark.parametrize("n", [0])
def test_zero_duration(n):
    assert human_duration(n) == "0m"
