"""Flight-logger text files (IGC) as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fields

# Header codes and the metadata they hold.
HEADERS = {"PLT": "pilot", "CM2": "copilot", "GTY": "glider_type", "GID": "glider_id", "CID": "competition_id", "CCL": "competition_class", "FTY": "fr_type", "RFW": "firmware", "RHW": "hardware", "GPS": "gps_receiver", "PRS": "pressure_sensor", "DTM": "gps_datum", "ALG": "altitude_gps_ref", "ALP": "altitude_pressure_ref", "TZN": "timezone_offset_h"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(flight_id, line_no, line): flight_id is the file's name without its ending."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    lines = files.select(name.alias("flight_id"), F.posexplode(F.split(F.decode("content", "ISO-8859-1"), r"\r\n|\r|\n")).alias("line_no", "line"))
    return lines.where("line <> ''")


def fixes(lines: DataFrame) -> DataFrame:
    """B records: flight_id, line_no, timestamp_s since the first fix, position, heights, validity.

    A time of day more than an hour before the one before it starts the next day.  Bad digits raise an error.
    """
    b = lines.where("line LIKE 'B%' AND length(line) >= 35")
    part = lambda a, n: F.substring("line", a, n)
    rows = b.select(
        "flight_id", "line_no", fields.day_seconds(part(2, 6)).alias("tod"),
        fields.igc_latitude(part(8, 8)).alias("gps_lat_deg"), fields.igc_longitude(part(16, 9)).alias("gps_lon_deg"),
        part(26, 5).cast("long").alias("alt_baro_m"), part(31, 5).cast("long").alias("alt_gps_m"), part(25, 1).alias("fix_validity"),
    )
    w = Window.partitionBy("flight_id").orderBy("line_no")
    rows = rows.withColumn("_new_day", F.coalesce((F.col("tod") < F.lag("tod").over(w) - 3600).cast("int"), F.lit(0)))
    rows = rows.withColumn("_s", F.col("tod") + 86400 * F.sum("_new_day").over(w))
    start = F.first("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("timestamp_s", (F.col("_s") - start).cast("double")).drop("_new_day", "_s")


def headers(lines: DataFrame) -> DataFrame:
    """(flight_id, code, value): the last H record of each code."""
    h = lines.where("line LIKE 'H%' AND length(line) >= 5")
    rows = h.select("flight_id", "line_no", F.substring("line", 3, 3).alias("code"), fields.header_value(F.col("line")).alias("value"))
    return rows.groupBy("flight_id", "code").agg(F.max_by("value", "line_no").alias("value"))


def extensions(lines: DataFrame) -> DataFrame:
    """(flight_id, first, last, code): what the last I record adds to B records."""
    i = lines.where("line LIKE 'I%'").groupBy("flight_id").agg(F.max_by("line", "line_no").alias("line"))
    n = F.substring("line", 2, 2).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr("line", 4 + 7 * k, F.lit(7)))
    rows = i.where(n > 0).select("flight_id", F.explode(parts).alias("p"))
    return rows.select("flight_id", F.substring("p", 1, 2).cast("int").alias("first"), F.substring("p", 3, 2).cast("int").alias("last"), F.substring("p", 5, 3).alias("code"))


def metadata(lines: DataFrame) -> DataFrame:
    """One row for each flight: its headers by name, recorder, start, duration and number of fixes."""
    h = headers(lines)
    known = h.groupBy("flight_id").agg(
        F.first(F.when(F.col("code") == "DTE", fields.igc_date(F.regexp_replace("value", "(?i)^date:?", ""))), ignorenulls=True).alias("date"),
        *(F.first(F.when(F.col("code") == c, F.nullif(F.col("value"), F.lit(""))), ignorenulls=True).alias(n) for c, n in HEADERS.items()),
    )
    recorder = lines.where("line LIKE 'A%'").groupBy("flight_id").agg(F.max_by(F.trim(F.substring("line", 2, 1 << 30)), "line_no").alias("fr_id"))
    f = fixes(lines)
    span = f.groupBy("flight_id").agg(F.count("*").alias("num_fixes"), (F.max_by("timestamp_s", "line_no") - F.min_by("timestamp_s", "line_no")).alias("duration_s"), F.min_by("tod", "line_no").alias("_tod"))
    rows = known.join(recorder, "flight_id", "left").join(span, "flight_id", "left")
    start = F.timestamp_seconds(F.unix_date("date") * F.lit(86400) + F.col("_tod"))
    return rows.withColumns({"gps_start_utc": start, "pilot": fields.not_nil(F.col("pilot")), "copilot": fields.not_nil(F.col("copilot")), "timezone_offset_h": F.col("timezone_offset_h").try_cast("double")}).drop("_tod")
