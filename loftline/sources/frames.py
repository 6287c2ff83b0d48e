"""Tables of video frames and trajectories in CSV, JSON and GeoJSON; registries in YAML."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SEQUENCE_FRAME

REQUIRED = ("timestamp_s", "x_m", "y_m", "z_m")


def read_sequence(spark: SparkSession, path: str) -> DataFrame:
    """Frame rows; frame_id stays text, so zeros before it stay."""
    header = spark.read.option("header", True).csv(path)
    types = {f.name: f.dataType for f in SEQUENCE_FRAME}
    return header.select(*(F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in header.columns))


def read_playback(spark: SparkSession, path: str) -> DataFrame:
    """Trajectory rows by small-letter names; missing columns are 0, load_g 1; rows without the required four go."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    if missing := [c for c in REQUIRED if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    names = [f.name for f in SEQUENCE_FRAME if f.name not in ("frame_id", "video_time_s", "phase")]
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in raw.columns else F.lit(1.0 if c == "load_g" else 0.0)
    rows = raw.dropna(subset=list(REQUIRED))
    return rows.select(*(number(c).alias(c) for c in names), (F.col("phase") if "phase" in raw.columns else F.lit("")).alias("phase"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents with trajectory_points, local or on the globe, as rows."""
    schema = "trajectory_points array<struct<timestamp:double,x:double,y:double,z:double,latitude:double,longitude:double,altitude_msl:double,source:string,quality:double>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("trajectory_points"))


def read_polygon(spark: SparkSession, path: str) -> DataFrame:
    """(path, i, lon, lat, height): the first ring of the first feature, closed; rings of fewer than two points go."""
    geometry = "struct<type:string,coordinates:array<array<array<double>>>>"
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    found = F.from_json("value", f"struct<features:array<struct<geometry:{geometry}>>,geometry:{geometry}>")
    ring = F.coalesce(F.get(found["features"], 0)["geometry"], found["geometry"])["coordinates"][0]
    rows = text.select("path", ring.alias("ring")).where(F.size("ring") >= 2)
    closed = F.when(F.get("ring", 0) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.array(F.get("ring", 0))))
    return rows.select("path", F.posexplode(closed).alias("i", "p")).select("path", "i", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat"), F.lit(0.0).alias("height"))


def read_registry(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A YAML mapping of ids to flat or nested records, as one row for each id.  Configuration: a few rows."""
    import yaml

    content = yaml.safe_load(Path(path).read_text())
    rows = []
    for name, record in content.items():
        flat = {key: name}
        for k, v in record.items():
            flat |= {f"{k}_{n}": x for n, x in v.items()} if isinstance(v, dict) else {k: v}
        rows.append(flat)
    return spark.createDataFrame(rows)


def pick_source(preferred: DataFrame, fallback: DataFrame, flight: str = "flight_id") -> DataFrame:
    """The preferred rows, and the fallback rows of flights without any."""
    rest = fallback.join(preferred.select(flight).distinct(), flight, "left_anti")
    return preferred.withColumn("source", F.lit("preferred")).unionByName(rest.withColumn("source", F.lit("fallback")), allowMissingColumns=True)


def flight_ids(paths: DataFrame) -> DataFrame:
    """paths (path): the distinct parts before the first underscore of the file names."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return paths.select(F.split(name, "_")[0].alias("flight_id")).distinct().orderBy("flight_id")
