"""Column expressions for parsing, time, severity and formatting.

Everything here is a built-in Spark expression, so it stays in generated code.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wheeltrace.config import ACTIVE_AUTOPILOT_STATES

# Texts that mean "missing" in a CSV field.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_ELAPSED = (
    r"^\s*([+-]?)(?:([0-9]+)\s*days?,?\s*)?([+]?)([0-9]+):([0-9]{1,2}):([0-9]{1,2}(?:\.[0-9]*)?)\s*$"
)

# Seconds a nanosecond clock can hold on either side of 1970; beyond is no time.
_MAX_EPOCH_SECONDS = 9_223_372_036.854775


def missing_to_null(text: Column) -> Column:
    return F.when(~text.isin(*MISSING_TOKENS), text)


def finite(number: Column) -> Column:
    """The number, or NULL for NaN and the infinities."""
    value = number.cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def parse_number(text: Column) -> Column:
    """Decimal text to double, NULL for anything else.

    Stricter than a plain cast, which also takes Java literals such as `1d`.
    `true` and `false` count as 1 and 0, as in a column of flags.
    """
    bare = F.trim(text)
    flag = F.lower(bare)
    return (
        F.when(bare.rlike(_DECIMAL), finite(bare.try_cast("double")))
        .when(flag == "true", F.lit(1.0))
        .when(flag == "false", F.lit(0.0))
    )


def to_number(column: Column, data_type: T.DataType) -> Column:
    """Coerce a column of any stored type to a finite double or NULL."""
    if isinstance(data_type, T.StringType):
        return parse_number(column)
    return finite(column)


def state_label(text: Column) -> Column:
    """`LABEL|CODE` to `LABEL`, cutting at the last bar; an empty label is NULL."""
    return F.nullif(F.regexp_replace(text, r"[|][^|]*$", ""), F.lit(""))


def state_code(text: Column) -> Column:
    """`LABEL|CODE` to the code as a number, NULL without a bar."""
    return F.when(text.contains("|"), parse_number(F.substring_index(text, "|", -1)))


def is_switched_on(text: Column) -> Column:
    """Read a number or an enum text as a flag; never NULL.

    The tests are plain substring tests, so `NONE` is on because it contains `on`.
    """
    lowered = F.lower(text)
    negative = F.coalesce(lowered.rlike("not_active|not_applying|inactive|off|false"), F.lit(False))
    positive = F.coalesce(lowered.rlike("active|applying|on|true"), F.lit(False))
    nonzero = F.coalesce(parse_number(text), F.lit(0.0)) != 0.0
    return (positive | nonzero) & ~negative


def elapsed_seconds(text: Column) -> Column:
    """`[N days ]HH:MM:SS[.f]` to seconds; a bare number is already seconds.

    The pattern runs once: it rewrites the text to bar-separated parts, which the
    lambda then reads. A text that does not match stays whole.
    """

    def seconds(parts: Column) -> Column:
        def number(index: int) -> Column:
            return F.get(parts, F.lit(index)).try_cast("double")

        clock = number(3) * 3600 + number(4) * 60 + number(5)
        days = F.coalesce(number(1), F.lit(0.0)) * 86400
        sign = F.when(F.get(parts, F.lit(0)) == "-", F.lit(-1.0)).otherwise(F.lit(1.0))
        # "-1 days +23:59:59" takes the clock forward from a negative day.
        forward = F.get(parts, F.lit(2)) == "+"
        total = sign * days + F.when(forward, clock).otherwise(sign * clock)
        return F.when(F.size(parts) == 6, total)

    parts = F.split(F.regexp_replace(text, _ELAPSED, "$1|$2|$3|$4|$5|$6"), "[|]")
    parsed = F.get(F.transform(F.array(parts), seconds), F.lit(0))
    return F.coalesce(parsed, parse_number(text))


def epoch_micros(seconds: Column) -> Column:
    """Epoch seconds to whole microseconds (nearest), NULL beyond the clock's range."""
    inside = F.abs(seconds) <= _MAX_EPOCH_SECONDS
    return F.when(inside, F.floor(seconds * 1_000_000 + 0.5)).cast("bigint")


def epoch_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros(epoch_micros(seconds))


def autopilot_active(state: Column) -> Column:
    return F.coalesce(F.upper(state).isin(*ACTIVE_AUTOPILOT_STATES), F.lit(False))


def severity_score(peak: Column, threshold: Column, reference: Column) -> Column:
    """Share of the way from the threshold to the severe reference, within 0..1."""
    floor = F.abs(threshold)
    ceiling = F.greatest(F.abs(reference), floor + 1e-9)
    share = (F.abs(peak) - floor) / (ceiling - floor)
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))


def severity_label(score: Column) -> Column:
    return F.when(score >= 0.67, "high").when(score >= 0.34, "moderate").otherwise("low")


def per_100_km(count: Column, distance_km: Column) -> Column:
    rate = F.bround(count / F.nullif(distance_km, F.lit(0.0)) * 100.0, 4)
    return F.when(distance_km > 0, rate).otherwise(F.lit(0.0))


def percent_of(part: Column, whole: Column) -> Column:
    share = F.bround(part / F.nullif(whole, F.lit(0.0)) * 100.0, 3)
    return F.when(whole > 0, share).otherwise(F.lit(0.0))


def event_id(drive_id: Column, event_type: Column, ordinal: Column) -> Column:
    return F.format_string("%s:%s:%05d", drive_id, event_type, ordinal)


def number_text(number: Column, digits: int = 2) -> Column:
    """Fixed-point text, rounded half to even; `N/A` when there is no finite number."""
    value = finite(number)
    text = F.format_string(f"%.{digits}f", F.bround(value, digits))
    return F.when(value.isNotNull(), text).otherwise(F.lit("N/A"))


def iso_text(timestamp: Column) -> Column:
    """UTC text such as 2024-01-31T08:00:00.250000Z (the session runs in UTC)."""
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def as_utc(bound: str | datetime) -> datetime:
    """A time bound as an aware UTC datetime; naive input is taken as UTC."""
    moment = datetime.fromisoformat(bound) if isinstance(bound, str) else bound
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def cell_start(moment_us: Column, width_us: int) -> Column:
    """Start of the fixed-width time cell that holds the moment."""
    return moment_us - F.pmod(moment_us, F.lit(width_us))
