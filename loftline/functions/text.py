"""Texts for overlays and subtitles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of camera settings.
FIELDS_OF_VIEW = {"W": "Wide", "S": "SuperView", "L": "Linear", "N": "Narrow", "M": "Max SuperView", "X": "HyperView", "LH": "Linear + Horizon Lock"}
HEIGHTS = {720: "720p", 1080: "1080p", 1440: "1440p", 1520: "2.7K", 2160: "4K", 2880: "5K", 3360: "5.3K"}
STABILISATION = {"HS High": "HyperSmooth High", "HS Boost": "HyperSmooth Boost", "HS Standard": "HyperSmooth", "HS Off": "Stab Off", "HSON": "HyperSmooth On", "ON": "EIS On", "OFF": "Stab Off"}
LENS_MOD = "Max Lens Mod"


def labelled(code: Column, labels: dict, fallback: Column | None = None) -> Column:
    """The label of a code; else the fallback, or the code itself."""
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code), code if fallback is None else fallback)


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm; thousandths are rounded on their own and may read 1000; null and NaN are zero."""
    s = F.when(seconds.isNull() | F.isnan(seconds), 0.0).otherwise(seconds)
    whole = F.floor(s)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(whole / 3600), F.floor(F.pmod(whole, F.lit(3600)) / 60), F.pmod(whole, F.lit(60)), F.rint((s - whole) * 1000).cast("long"))


def srt_block(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), srt_time(start), F.lit(" --> "), srt_time(end), F.lit("\n"), text, F.lit("\n"))


def duration_text(seconds: Column) -> Column:
    """Hours and minutes, or minutes and seconds."""
    total = F.floor(seconds)
    h, m, s = F.floor(total / 3600), F.floor(F.pmod(total, F.lit(3600)) / 60), F.pmod(total, F.lit(60))
    hours = F.when(m > 0, F.format_string("%dh %02dm", h, m)).otherwise(F.format_string("%dh 0m", h))
    return F.when(h > 0, hours).when(m > 0, F.format_string("%dm %02ds", m, s)).otherwise(F.format_string("0m %ds", s))


def resolution_text(resolution: Column, rate: Column) -> Column:
    """`1920x1080` and a rate as `1080p60`; what can't be read stays."""
    height = F.when(F.size(F.split(resolution, "x")) == 2, F.split(resolution, "x")[1].try_cast("int"))
    label = labelled(height, HEIGHTS, F.concat(height.cast("string"), F.lit("p")))
    return F.when(height.isNull(), resolution).otherwise(F.concat(label, F.rint(rate).cast("long").cast("string")))


def view_text(code: Column, lens: Column) -> Column:
    return F.when(F.upper(lens) == "MLNS", LENS_MOD).when(F.coalesce(code, F.lit("")) != "", labelled(code, FIELDS_OF_VIEW)).otherwise("")


def stabilisation_text(on: Column, method: Column) -> Column:
    named = F.coalesce(method, F.lit("")) != ""
    return F.when((on == F.lit(False)) | F.upper(method).isin("OFF", "HS OFF"), "Stab Off").when(named, labelled(method, STABILISATION)).when(on, "EIS On").otherwise("")


def info_line(*parts: Column) -> Column:
    """Parts that are there, with dots between; null if none is."""
    return F.nullif(F.concat_ws(" · ", *(F.nullif(p, F.lit("")) for p in parts)), F.lit(""))


def flight_line(pilot: Column, glider: Column, registration: Column, day: Column, seconds: Column) -> Column:
    aircraft = F.when(registration.isNotNull(), F.concat(glider, F.lit(" ("), registration, F.lit(")"))).otherwise(glider)
    return info_line(pilot, aircraft, F.date_format(day, "dd MMM yyyy"), F.concat(F.lit("Flight Time: "), duration_text(seconds)))


def altitude_text(z: Column) -> Column:
    """Whole metres, half to even, never below zero; null stays null."""
    return F.rint(F.when(z < 0, 0.0).otherwise(z)).cast("long").cast("string")


def speed_text(v: Column, unit: str) -> Column:
    return F.rint(F.when(v < 0, 0.0).otherwise(v) * (3.6 if unit == "km/h" else 1.0)).cast("long").cast("string")


def plain_number(x: Column, digits: int = 2) -> Column:
    """Without zeros at the end of the fraction."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}f", x), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def speedup_text(speed: Column, rounded: bool) -> Column:
    """With marks for faster and slower than real time; rounded: to a power of two."""
    value = F.pow(F.lit(2.0), F.rint(F.log2(F.when(speed < 0.001, 0.001).otherwise(speed)))) if rounded else F.bround(speed, 2)
    mark = F.when(value > 1.05, "x >>").when(value < 0.95, "x <<").otherwise("x")
    return F.concat(plain_number(value, 10), mark)
