"""Scalar functions over the fields of flight logs and camera streams, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _angle(text: Column, degrees: int, negative: str) -> Column:
    """Degrees, minutes and thousandths of minutes, then the hemisphere."""
    part = lambda a, n: F.substring(text, a, n).cast("int")
    value = part(1, degrees) + part(degrees + 1, 5) / F.lit(60000.0)
    return F.when(F.substring(text, degrees + 6, 1) == negative, -value).otherwise(value)


def igc_latitude(text: Column) -> Column:
    """DDMMmmmN or S."""
    return _angle(text, 2, "S")


def igc_longitude(text: Column) -> Column:
    """DDDMMmmmE or W."""
    return _angle(text, 3, "W")


def igc_date(text: Column) -> Column:
    """DDMMYY, whatever follows a comma; years from 80 are of the last century."""
    day = F.substring_index(text, ",", 1)
    part = lambda a: F.substring(F.trim(day), a, 2).cast("int")
    return F.make_date(part(5) + F.when(part(5) < 80, 2000).otherwise(1900), part(3), part(1))


def day_seconds(hhmmss: Column) -> Column:
    part = lambda a: F.substring(hhmmss, a, 2).cast("int")
    return part(1) * 3600 + part(3) * 60 + part(5)


def gps_clock(text: Column) -> Column:
    """YYMMDDHHMMSS.fraction as a time in UTC, to the microsecond; null if it isn't one."""
    pattern = r"^(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})\.(\d+)"
    p = lambda k: F.regexp_extract(text, pattern, k)
    seconds = F.concat(p(6), F.lit("."), F.substring(F.rpad(p(7), 6, "0"), 1, 6)).cast("decimal(16,6)")
    made = F.make_timestamp_ntz(F.lit(2000) + p(1).cast("int"), p(2).cast("int"), p(3).cast("int"), p(4).cast("int"), p(5).cast("int"), seconds)
    return F.when(text.rlike(pattern), made)


def header_value(line: Column) -> Column:
    """What follows the first colon, or else the letters of the code."""
    rest = F.substring(line, 6, 1 << 30)
    at = F.locate(":", rest)
    return F.trim(F.when(at > 0, F.substr(rest, at + 1)).otherwise(rest))


def not_nil(text: Column) -> Column:
    return F.when(F.upper(F.trim(text)) == "NIL", F.lit(None)).otherwise(text)


def scaled(samples: Column, scale: Column) -> Column:
    """Sample rows divided by one scale or by one for each component."""
    return F.transform(samples, lambda row: F.transform(row, lambda x, i: x / F.when(F.size(scale) == 1, scale[0]).otherwise(F.get(scale, i))))


def axes_remapped(row: Column, orientation: Column) -> Column:
    """Components as X, Y, Z by the letters of orientation; small letters change the sign; unknown axes stay."""
    upper = F.upper(orientation)

    def axis(k: int, name: str) -> Column:
        at = F.instr(upper, name)
        value = F.get(row, at - 1)
        return F.when(at == 0, row[k]).when(F.substr(orientation, at, F.lit(1)) == name, value).otherwise(-value)

    known = (F.length(orientation) >= 3) & (F.size(row) == 3)
    return F.when(known, F.array(*(axis(k, n) for k, n in enumerate("XYZ")))).otherwise(row)


def sample_times(stamp_us: Column, duration: Column, n: Column) -> Column:
    """Times of n samples spread over a payload that begins at stamp_us."""
    start = stamp_us / 1e6
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i * duration / n)


def quality_weight(validity: Column) -> Column:
    return F.when(validity == "A", 1.0).otherwise(0.01)


def dilution_weight(dop: Column) -> Column:
    """One by the dilution of precision; only an exact zero counts as 0.1."""
    return 1.0 / F.when(dop == 0.0, 0.1).otherwise(dop)


def pixel(text: Column, most: Column) -> Column:
    """A coordinate: whole pixels, or a percentage of `most`, cut to whole pixels."""
    share = F.regexp_replace(text, "%", "").try_cast("double") / 100.0
    return F.when(F.endswith(text, F.lit("%")), (share * most).cast("long")).otherwise(text.try_cast("long"))
