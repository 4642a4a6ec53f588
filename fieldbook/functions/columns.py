"""Column functions: rounding rules, calendars, names, identifiers, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"


def season_of(day: Column) -> Column:
    """The season's first year and the last two digits of its second; it turns over in July."""
    first = F.year(day) - F.when(F.month(day) < 7, 1).otherwise(0)
    return F.concat(first.cast("string"), F.lit("-"), F.lpad(((first + 1) % 100).cast("string"), 2, "0"))


def local_day(time: Column, zone: str = "Europe/London") -> Column:
    """The calendar day of a UTC time without zone in another zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), time))


def local_midnight(day: Column, zone: str = "Europe/London") -> Column:
    """The UTC time at which a calendar day begins in a zone."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))


def parsed_day(text: Column) -> Column:
    """A day written dd/MM/yyyy or dd/MM/yy; null if neither."""
    return F.coalesce(F.to_date(F.try_to_timestamp(text, F.lit("dd/MM/yyyy"))), F.to_date(F.try_to_timestamp(text, F.lit("dd/MM/yy"))))


def name_tokens(name: Column) -> Column:
    """The words of a name in lower case without accents."""
    return F.regexp_extract_all(F.translate(F.lower(name), ACCENTED, PLAIN), F.lit("([a-z]+)"), F.lit(1))


def fixture_id(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def valid_season(season: Column) -> Column:
    """Whether a season id names two years in a row."""
    parts = F.regexp_extract(season, r"^(\d{4})-(\d{2})$", 1)
    second = F.regexp_extract(season, r"^(\d{4})-(\d{2})$", 2)
    return (parts != "") & ((F.when(parts != "", parts).cast("int") + 1) % 100 == F.when(second != "", second).cast("int"))


def percent_points(share: Column) -> Column:
    """Whole percent, halves away from zero, as exact decimals."""
    return F.round(share.cast("decimal(20,10)") * 100, 0).cast("int")


def significant(value: Column, digits: int = 6) -> Column:
    """A number rounded to significant digits."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value * scale) / scale)


def checked_decimal(text: Column, precision: int, scale: int, low: float, high: float) -> tuple[Column, Column]:
    """(value, issue): an exact decimal within its bounds, or null and why."""
    value = text.try_cast(f"decimal({precision},{scale})")
    inside = value.between(low, high)
    issue = F.when(text.isNull(), None).when(value.isNull(), "not a decimal").when(~inside, "out of range")
    return F.when(inside, value), issue
