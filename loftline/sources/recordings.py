"""Recordings as a data source: a file is as many partitions as it has splits, and only asked streams are decoded.

A split is a range of bytes.  A task walks the file's boxes and sample tables, which are small, and reads those packets of
the telemetry track that begin in its range: so a file's packets are dealt to tasks without anybody reading the
tables of all files first, and a packet belongs to one split whatever its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import ordered
from ..schemas import IMU_SAMPLE
from . import camera, gpmf, video

#: Bytes of a split, unless the option `splitBytes` says otherwise.
SPLIT = 128 << 20
#: Packet bytes that are decoded at once.
BATCH = 8 << 20

_DOUBLES = pa.list_(pa.float64())
_TYPES = {"flight_id": pa.string(), "payload": pa.int32(), "stream": pa.string(), "orientation": pa.string(), "gps_clock": pa.string(), "scale": _DOUBLES, "samples": pa.list_(_DOUBLES)}
_SCHEMA = pa.schema([(x.split()[0], _TYPES.get(x.split()[0], pa.float64())) for x in gpmf.ROWS.split(", ")])


def files(path: str, endings: tuple[str, ...] = (".mp4",)) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of all files with these endings (of any case) in the folder and those in it."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        system, top, head = fs.LocalFileSystem(), path, ""
    else:
        plain = path.replace("s3a://", "s3://", 1)
        system, top = fs.FileSystem.from_uri(plain)
        head = plain[: plain.index(top)] if top in plain else ""
    info = system.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top, recursive=True))
    return sorted((head + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(endings))


@dataclass
class Split(InputPartition):
    path: str
    length: int
    start: int
    end: int


class RecordingReader(DataSourceReader):
    def __init__(self, path: str, split: int, streams: frozenset[str]):
        self.path, self.split, self.streams = path, split, streams

    def partitions(self) -> list[Split]:
        return [Split(path, size, at, min(size, at + self.split)) for path, size in files(self.path) for at in range(0, size, self.split)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        flight, rows, held = video.stem(part.path), [], 0
        with video.opened(part.path) as f:
            for k, (pts, duration, at, size) in enumerate(video.packets(f, part.length)):
                if not part.start <= at < part.end:
                    continue
                data = video.bytes_at(f, at, size)
                if len(data) < size:  # the file ends before the packet does
                    continue
                rows += [{"flight_id": flight, "payload": k, "pts": pts, "duration": duration} | s for s in gpmf.streams(data, self.streams)]
                held += size
                if held >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


class Recordings(DataSource):
    """Options: path; splitBytes; streams, names separated by commas (all if there is none)."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return gpmf.ROWS

    def reader(self, schema) -> RecordingReader:
        asked = frozenset(filter(None, self.options.get("streams", "").replace(" ", "").split(",")))
        if unknown := asked - set(gpmf.STREAMS):
            raise ValueError(f"unknown streams: {sorted(unknown)}")
        return RecordingReader(self.options["path"], int(self.options.get("splitBytes", SPLIT)), asked or frozenset(gpmf.STREAMS))


def read_recordings(spark: SparkSession, path: str, *streams: str, split: int = SPLIT) -> DataFrame:
    """Streams of the telemetry packets of a file, or of all MP4 files under a folder: rows as of gpmf.parse_payloads().

    flight_id is the file's name.  Without names all streams come.  A file without a telemetry track gives no rows, nor do
    packets that the file ends before.  Paths may be of any file system that Arrow opens.
    """
    spark.dataSource.register(Recordings)
    return spark.read.format("recordings").option("splitBytes", split).option("streams", ",".join(streams)).load(path)


def sensor_table(parsed: DataFrame) -> DataFrame:
    """All motion sensors at the accelerometer's times: IMU_SAMPLE's columns.

    The gyroscope's rows are taken one by one if a flight has as many of them, else interpolated as orientations and gravity
    are; what a flight has no sample of is null.  Flights without accelerations have no rows.
    """
    series = {"gyro": ("GYRO", [f"gyro_{a}_rads" for a in "xyz"], True)} | {q: (q.upper(), [f"{q}_{a}" for a in "wxyz"], False) for q in ("cori", "iori")}
    series["grav"] = ("GRAV", [f"grav_{a}" for a in "xyz"], False)
    of = lambda stream, names, turned: gpmf.samples(parsed, stream, names, turned).select("flight_id", "timestamp_s", *names)
    left = of("ACCL", [f"accl_{a}_ms2" for a in "xyz"], True)
    found = ordered.merged(left, {n: (of(*x), x[1]) for n, x in series.items()}, exact=("gyro",))
    return found.select([f.name for f in IMU_SAMPLE])


def recording_info(parsed: DataFrame, settings: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """One row for each recording: flight_id, gps_start_utc, camera_serial, lens_serial, metadata_version, settings (the others).

    settings (flight_id, settings): see camera.named_settings().  probes (flight_id, probe: JSON text) adds the struct
    container, see camera.container_info().  The clock is that of the first payload that has one.
    """
    promoted = ("camera_serial", "lens_serial", "metadata_version")
    rows = gpmf.first_clock(parsed).withColumnRenamed("start", "gps_start_utc").join(settings, "flight_id", "left")
    rows = rows.withColumns({n: F.try_element_at("settings", F.lit(n)) for n in promoted})
    rows = rows.withColumn("settings", F.map_filter("settings", lambda k, v: ~k.isin(*promoted)))
    if probes is not None:
        rows = rows.join(probes.select("flight_id", camera.container_info(F.col("probe")).alias("container")), "flight_id", "left")
    return rows


def write_recordings(spark: SparkSession, path: str, out: str) -> None:
    """From recordings to the tables out/gps, out/sensors and out/info, the first two partitioned by flight_id."""
    from ..plans.sinks import write_table

    parsed = read_recordings(spark, path)
    write_table(gpmf.gps_track(parsed), f"{out}/gps")
    write_table(sensor_table(parsed), f"{out}/sensors")
    recording_info(parsed, camera.named_settings(gpmf.read_settings(spark, path))).write.mode("overwrite").parquet(f"{out}/info")
