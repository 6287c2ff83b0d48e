"""Which files belong to a flight or a video sequence, from a listing of paths, and the flights' own records."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "path string, flight_uid string, flight_tag string, glider_id string, airfield_id string, qnh_hpa double, record string"
#: What a flight's record may leave out.
DEFAULTS = {"glider_id": "szd_51_junior", "airfield_id": "epbc"}


def absolute(path: str, root: str) -> str:
    """A path of the configuration: relative ones are under the root."""
    return path if os.path.isabs(path) else os.path.join(root, path)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path): all files under a folder; nothing is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def only_one(rows: DataFrame, by: str, wanted: DataFrame, what: str, out: str) -> DataFrame:
    """(by, out): the single path of each wanted key; none, or more than one, is an error when the row is read."""
    found = rows.groupBy(by).agg(F.count("*").alias("_n"), F.min("path").alias("_path"))
    both = wanted.select(by).distinct().join(found, by, "left")
    none = F.raise_error(F.concat(F.lit(f"no {what} found for "), F.col(by).cast("string"))).cast("string")
    many = F.raise_error(F.concat(F.lit(f"more than one {what} found for "), F.col(by).cast("string"))).cast("string")
    return both.select(by, F.when(F.col("_n").isNull(), none).when(F.col("_n") > 1, many).otherwise(F.col("_path")).alias(out))


def flight_records(paths: DataFrame, uids: DataFrame) -> DataFrame:
    """paths (path), uids (flight_uid): (flight_uid, record_path), the one `<uid>_*.yaml` of each."""
    rows = paths.select("path", F.regexp_extract(file_name("path"), r"^([^_]+)_.*\.yaml$", 1).alias("flight_uid")).where("flight_uid <> ''")
    return only_one(rows, "flight_uid", uids, "record", "record_path")


def flight_media(paths: DataFrame, tags: DataFrame) -> DataFrame:
    """paths (path), tags (flight_tag): (flight_tag, video_path, log_path).

    The video is `<tag>.mp4`, else `<tag>.MP4`; the log `<tag>.igc`.  What a flight lacks is null.
    """
    name = F.regexp_extract(file_name("path"), r"^(.*)\.(mp4|MP4|igc)$", 1)
    rows = paths.select("path", name.alias("flight_tag"), F.regexp_extract("path", r"\.(mp4|MP4|igc)$", 1).alias("_kind")).where("flight_tag <> ''")
    of = lambda kind: F.min(F.when(F.col("_kind") == kind, F.col("path")))
    found = rows.groupBy("flight_tag").agg(F.coalesce(of("mp4"), of("MP4")).alias("video_path"), of("igc").alias("log_path"))
    return tags.select("flight_tag").distinct().join(found, "flight_tag", "left")


def sequence_actors(paths: DataFrame, sequences: DataFrame) -> DataFrame:
    """paths (path), sequences (sequence): (sequence, actor), what follows the sequence's name in its one `<sequence>_*.csv`.

    A sequence's name may have underscores: each prefix of a file's name that ends before one is tried.
    """
    stem = F.regexp_extract(file_name("path"), r"^(.*)\.csv$", 1)
    parts = F.split(stem, "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    rows = paths.where(F.size(parts) > 1).select("path", F.explode(prefixes).alias("sequence"))
    one = only_one(rows.join(sequences.select("sequence").distinct(), "sequence"), "sequence", sequences, "table", "_path")
    name = F.regexp_extract(file_name("_path"), r"^(.*)\.csv$", 1)
    return one.select("sequence", F.substring(name, F.length("sequence") + 2, F.length(name)).alias("actor"))


def read_flight_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each flight's YAML file: its keys, the glider and airfield (see DEFAULTS), and all of it as JSON."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for pdf in frames:
            rows = []
            for f in pdf.itertuples():
                record = DEFAULTS | (yaml.safe_load(f.value) or {})
                qnh = record.get("qnh_hpa")
                texts = [None if record.get(n) is None else str(record[n]) for n in names[1:5]]
                rows.append((f.path, *texts, None if qnh is None else float(qnh), json.dumps(record, default=str)))
            yield pd.DataFrame(rows, columns=names)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInPandas(run, RECORD)


def with_registry(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """rows with the registry's columns by key.  A key that the registry lacks is an error where one of them is read."""
    types = dict(registry.dtypes)
    text = F.concat(F.lit(f"{key} is not in the registry: "), F.coalesce(F.col(key).cast("string"), F.lit("none")))
    both = rows.join(registry.withColumn("_known", F.lit(True)), key, "left")
    known = lambda c: F.when(F.col("_known"), F.col(c)).otherwise(F.raise_error(text).cast(types[c]))
    return both.withColumns({c: known(c) for c in registry.columns}).drop("_known")
