"""Typed readings of wire values, as Column expressions: null where a value does not parse, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U32_MAX = 4294967295
U64_MAX = 18446744073709551615
#: What the standard library that the analyses follow takes for a floating-point number.
_FLOAT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_SPECIAL = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def u32(text: Column) -> Column:
    """Unsigned 32-bit integer as BIGINT; an empty text, a sign and an overflow give null."""
    number = F.when(text.rlike("^0*[0-9]{1,10}$"), text.try_cast("long"))
    return F.when(number <= U32_MAX, number)


def _u64(text: Column) -> Column:
    number = F.when(text.rlike("^0*[0-9]{1,20}$"), text.try_cast("decimal(20,0)"))
    return F.when(number <= F.lit(str(U64_MAX)).cast("decimal(20,0)"), number)


def quantity(text: Column) -> Column:
    """Whole part of a quantity as DECIMAL(20,0), so that all of 64 unsigned bits fit; what follows the first point is cut off unread, and
    a missing whole part counts as 0."""
    whole = F.substring_index(text, ".", 1)
    return F.when(text != "", F.when(whole == "", F.lit(0).cast("decimal(20,0)")).otherwise(_u64(whole)))


def number(text: Column) -> Column:
    """DOUBLE; infinities and NaN by name, but neither spaces nor suffixes."""
    special = F.lower(text)
    return (
        F.when(text.rlike(_FLOAT), text.try_cast("double"))
        .when(text.rlike(_SPECIAL) & special.contains("nan"), F.lit(float("nan")))
        .when(text.rlike(_SPECIAL), F.when(special.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    )


def exact_product(a: str, b: str) -> Column:
    """The product of two columns of numbers as DECIMAL(38,10); null where one does not parse or has more digits than five places and 12 or 15 before the point. A product of doubles would be off by more than ten places show."""
    def held(name: str, kind: str) -> Column:
        value, double = F.col(name).try_cast(kind), number(F.col(name))
        return F.when(value.cast("double") == double, value)

    return held(a, "decimal(17,5)") * held(b, "decimal(20,5)")


def sending_ns(text: Column) -> Column:
    """Nanoseconds since 1970 of YYYYMMDD-HH:MM:SS[.f], f of one to nine digits, as BIGINT. Days up to 31 and any hours, minutes and seconds of two digits are
    taken and roll over; times before 1970, or beyond what 64 bits hold (from 2262 on), give null."""
    part = lambda a, n: F.substring(text, a, n).try_cast("long")
    good = text.rlike(r"^[0-9]{4}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])-[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,9})?$") & part(1, 4).between(1970, 2261)
    first = F.unix_date(F.make_date(part(1, 4), part(5, 2), F.lit(1))).cast("long")
    seconds = (first + part(7, 2) - 1) * 86400 + part(10, 2) * 3600 + part(13, 2) * 60 + part(16, 2)
    fraction = F.rpad(F.substring(text, 19, 9), 9, "0").try_cast("long")
    return F.when(good, seconds * 1_000_000_000 + fraction)


def ns_to_timestamp(ns: Column) -> Column:
    """TIMESTAMP, to the microsecond."""
    return F.timestamp_micros(F.floor(ns.cast("decimal(20,0)") / 1000).cast("long"))


_UNITS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000}


def parse_duration(text: str) -> int | None:
    """Nanoseconds of a whole number with a unit (ns, us, ms, s, m), or None."""
    text = text.strip()
    digits = text.rstrip("abcdefghijklmnopqrstuvwxyz")
    unit, digits = text[len(digits) :], digits.rstrip()
    digits = digits.removeprefix("+")
    if unit not in _UNITS or not digits.isascii() or not digits.isdigit() or int(digits) > U64_MAX:
        return None
    return int(digits) * _UNITS[unit]


def human_duration(ns: int) -> str:
    """The largest unit that divides the duration."""
    for unit in ("m", "s", "ms", "us"):
        if ns % _UNITS[unit] == 0:
            return f"{ns // _UNITS[unit]}{unit}"
    return f"{ns}ns"
