"""Points from GPX and GeoJSON lines, and the choice among sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ordered

POINT = "_lat double, _lon double, ele double, time string, speed double, hdop double"
#: Sources from the most trusted on.
PRIORITY = ("GEOJSON", "IGC", "GPX")


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, latitude, longitude, altitude_msl, speed, hdop, source): the track points of GPX files."""
    rows = spark.read.format("xml").option("rowTag", "trkpt").schema(POINT).load(path)
    t = F.unix_micros(F.to_timestamp("time")) / 1e6
    return rows.select(t.alias("timestamp"), F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"), F.col("ele").alias("altitude_msl"), "speed", "hdop", F.lit("GPX").alias("source"))


def read_line(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, longitude, latitude, altitude_msl, source): the points of the first LineString of each GeoJSON file."""
    geometry = "struct<type:string,coordinates:array<array<double>>>"
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"struct<features:array<struct<geometry:{geometry}>>,geometry:{geometry}>").alias("j"))
    line = F.coalesce(F.get(F.filter(F.transform(F.col("j.features"), lambda f: f["geometry"]), lambda g: g["type"] == "LineString"), 0), F.col("j.geometry"))
    rows = files.select("path", F.posexplode(line["coordinates"]).alias("i", "p"))
    return rows.select("path", "i", F.col("p")[0].alias("longitude"), F.col("p")[1].alias("latitude"), F.get("p", 2).alias("altitude_msl"), F.lit("GEOJSON").alias("source"))


def most_trusted(df: DataFrame, time: str, source: str = "source", flight: str = "flight_id", priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """One row for each flight and time: that of the most trusted source; sources that aren't listed come last."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, priority)), F.col(source)), F.lit(0)), F.lit(len(priority) + 1))
    w = Window.partitionBy(flight, time).orderBy(rank, source)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def filled_gaps(df: DataFrame, values: list[str], step: float, most: float, time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """df and interpolated rows, every `step` seconds, in gaps of more than a step and at most `most` seconds."""
    holes = ordered.gaps(df, step, time, flight).where(F.col("gap_end") - F.col("gap_start") <= most)
    n = F.ceil((F.col("gap_end") - F.col("gap_start")) / step).cast("long") - 1
    new = holes.where(n > 0).select(flight, "gap_start", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("_i"))
    new = new.select(flight, (F.col("gap_start") + F.col("_i") * step).alias(time))
    made = ordered.interpolate(new, df.select(flight, time, *values), time, values, flight)
    return df.withColumn("filled", F.lit(False)).unionByName(made.withColumn("filled", F.lit(True)), allowMissingColumns=True)


def video_time(frame: Column, custom_fps: Column, sequence_fps: Column) -> Column:
    """Seconds of a frame; 24 frames a second if no rate is known."""
    return frame / F.coalesce(F.when(custom_fps > 0, custom_fps), sequence_fps, F.lit(24.0))


def flat_world(lat: Column, lon: Column, lat0: float, lon0: float, scale: float = 111320.0) -> tuple[Column, Column]:
    """Metres north and east of an origin on a flat earth, for engines without a georeference."""
    return (lat - lat0) * scale, (lon - lon0) * scale * F.cos(F.radians(F.lit(lat0)))
