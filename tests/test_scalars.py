import pytest
from pyspark.sql import functions as F

from wheeltrace.functions import scalars as S


def column(spark, values, expression, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    rows = frame.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()
    return [row.y for row in rows]


def test_split_state(spark):
    values = ["UNAVAILABLE|1", "CITY|RING|2", "|0", "AVAILABLE", "A|x", "A|", None]
    assert column(spark, values, S.state_label) == [
        "UNAVAILABLE", "CITY|RING", None, "AVAILABLE", "A", "A", None,
    ]
    assert column(spark, values, S.state_code) == [1.0, 2.0, 0.0, None, None, None, None]


def test_switched_on(spark):
    values = {
        "Driver_applying_brakes|2": True,
        "Driver_not_applying_brakes|1": False,
        "NOT_ACTIVE": False,
        "ACTIVE": True,
        "inactive": False,
        "Off": False,
        "On": True,
        "NONE": True,
        "true": True,
        "false": False,
        "2": True,
        "0": False,
        "0.0": False,
        "-1.5": True,
        "idle": False,
        None: False,
    }
    assert column(spark, list(values), S.is_switched_on) == list(values.values())


def test_elapsed_seconds(spark):
    values = {
        "01:02:03": 3723.0,
        "00:00:01.250": 1.25,
        "30:00:00": 108000.0,
        "2 days 01:00:00": 176400.0,
        "-00:00:10": -10.0,
        "-1 days +23:59:50": -10.0,
        "12.5": 12.5,
        "1:2": None,
        "abc": None,
        None: None,
    }
    assert column(spark, list(values), S.elapsed_seconds) == list(values.values())


def test_numbers_follow_decimal_syntax(spark):
    values = {
        " 1.5 ": 1.5,
        "1e3": 1000.0,
        ".5": 0.5,
        "5.": 5.0,
        "-7": -7.0,
        "1d": None,
        "1f": None,
        "0x10": None,
        "inf": None,
        "NaN": None,
        "1e999": None,
        "": None,
        "true": 1.0,
        "False": 0.0,
        None: None,
    }
    assert column(spark, list(values), S.parse_number) == list(values.values())


def test_finite(spark):
    values = [1.0, float("nan"), float("inf"), float("-inf"), None]
    assert column(spark, values, S.finite, "double") == [1.0, None, None, None, None]


def test_missing_tokens(spark):
    values = ["NA", "null", "n/a", "", "NONE", "x"]
    assert column(spark, values, S.missing_to_null) == [None, None, None, None, "NONE", "x"]


def test_epoch_micros_rounds_and_bounds(spark):
    values = [1704067200.123457, 1704067200.0, -0.5, 1e20, 9.3e9, None]
    expected = [1704067200123457, 1704067200000000, -500000, None, None, None]
    assert column(spark, values, S.epoch_micros, "double") == expected


def test_severity(spark):
    def score(x):
        return S.severity_score(x, F.lit(-3.0), F.lit(-5.5))

    assert column(spark, [-3.0, -4.25, -5.5, -9.0, -1.0], score, "double") == [0, 0.5, 1, 1, 0]
    assert column(spark, [0.67, 0.669, 0.34, 0.339], S.severity_label, "double") == [
        "high", "moderate", "moderate", "low",
    ]


def test_rates_without_distance(spark):
    def rate(x):
        return S.per_100_km(F.lit(3), x)

    assert column(spark, [150.0, 0.0, -1.0], rate, "double") == [2.0, 0.0, 0.0]


def test_event_id_is_padded_not_cut(spark):
    def name(x):
        return S.event_id(F.lit("d"), F.lit("t"), x)

    assert column(spark, [7, 123456], name, "bigint") == ["d:t:00007", "d:t:123456"]


def test_number_text(spark):
    values = [1.005, 2.5, None, float("nan")]
    assert column(spark, values, S.number_text, "double")[1:] == ["2.50", "N/A", "N/A"]
    assert column(spark, [16.25], lambda x: S.number_text(x, 1), "double") == ["16.2"]


@pytest.mark.parametrize(
    "bound, hour",
    [("2024-01-01T10:00:00", 10), ("2024-01-01T10:00:00+02:00", 8), ("2024-01-01", 0)],
)
def test_bounds_are_utc(bound, hour):
    moment = S.as_utc(bound)
    assert moment.hour == hour and moment.utcoffset().total_seconds() == 0


def test_cell_start_before_1970(spark):
    assert column(spark, [-1, 0, 59, 60], lambda x: S.cell_start(x, 60), "bigint") == [
        -60, 0, 0, 60,
    ]
