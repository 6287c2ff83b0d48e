"""Camera telemetry (GPMF) in MP4 files or as payload rows.

The binary is parsed next to the data, payload by payload; rows of one stream of one payload come out, and all further
work is columns: scaling, axes, times.
"""

from __future__ import annotations

import struct
from collections.abc import Container, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fields
from . import video

# Number types of the format, and the streams that are read.
TYPES = {"b": "b", "B": "B", "s": "h", "S": "H", "l": "i", "L": "I", "f": "f", "d": "d", "J": "Q"}
STREAMS = ("GPS5", "GPSF", "GPSP", "ACCL", "GYRO", "CORI", "IORI", "GRAV")
ROWS = "flight_id string, payload int, pts double, duration double, stream string, scale array<double>, stamp_us double, orientation string, gps_fix double, gps_precision double, gps_clock string, samples array<array<double>>"


def items(data: bytes) -> Iterator[tuple[str, str, int, int, bytes]]:
    """Key, type, size, repeat and content of each item; nested items have type NUL."""
    at = 0
    while at + 8 <= len(data):
        key, kind, size, repeat = struct.unpack_from(">4scBH", data, at)
        n = size * repeat
        yield key.decode("latin-1"), kind.decode("latin-1"), size, repeat, data[at + 8 : at + 8 + n]
        at += 8 + -(-n // 4) * 4


def numbers(kind: str, size: int, data: bytes) -> list[list[float]]:
    if kind not in TYPES or not size:
        return []
    one = struct.calcsize(">" + TYPES[kind])
    flat = struct.unpack(f">{len(data) // one}{TYPES[kind]}", data[: len(data) // one * one])
    width = size // one
    return [[float(x) for x in flat[i : i + width]] for i in range(0, len(flat), width)]


def number(kind: str, size: int, data: bytes) -> float | None:
    """The first number of an item; none if it is empty or of an unknown type."""
    rows = numbers(kind, size, data)
    return rows[0][0] if rows and rows[0] else None


def text(data: bytes) -> str:
    return data.decode("latin-1").rstrip("\0")


def streams(data: bytes, asked: Container[str] = STREAMS) -> Iterator[dict]:
    """The asked streams of one payload, each with the settings that stand before its samples; others aren't decoded."""
    for key, kind, _, _, device in items(data):
        if key != "DEVC" or kind != "\0":
            continue
        for inner, nested, _, _, content in items(device):
            if inner != "STRM" or nested != "\0":
                continue
            found: dict = {"scale": [1.0], "stamp_us": None, "orientation": None, "gps_fix": None, "gps_precision": None, "gps_clock": None, "stream": None, "samples": []}
            for name, k, size, _, body in items(content):
                if name in STREAMS and name not in asked and name not in ("GPSF", "GPSP"):
                    found["stream"] = None
                    break
                if name == "SCAL":
                    found["scale"] = [x for row in numbers(k, size, body) for x in row]
                elif name == "STMP":
                    found["stamp_us"] = number(k, size, body)
                elif name == "ORIN":
                    found["orientation"] = text(body)
                elif name == "GPSU":
                    found["gps_clock"] = text(body)
                elif name in ("GPSF", "GPSP"):
                    found["gps_fix" if name == "GPSF" else "gps_precision"] = number(k, size, body)
                elif name in STREAMS:
                    found["stream"], found["samples"] = name, numbers(k, size, body)
            if found["stream"]:
                yield found


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """payloads (flight_id, payload, pts, duration, data): one row for each stream of each payload."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ROWS.split(", ")]
        for pdf in frames:
            rows = [{"flight_id": p.flight_id, "payload": p.payload, "pts": p.pts, "duration": p.duration} | s for p in pdf.itertuples() for s in streams(bytes(p.data))]
            yield pd.DataFrame(rows, columns=names)

    return payloads.select("flight_id", "payload", "pts", "duration", "data").mapInPandas(run, ROWS)


def samples(parsed: DataFrame, stream: str, names: list[str], turn: bool = True) -> DataFrame:
    """(flight_id, payload, i, timestamp_s, names..., gps_fix, gps_dop): scaled, turned to X, Y, Z (if asked), with times."""
    rows = parsed.where(F.col("stream") == stream).where(F.size("samples") > 0)
    values = fields.scaled(F.col("samples"), F.col("scale"))
    turned = F.when(F.col("orientation").isNull() | ~F.lit(turn), values).otherwise(F.transform(values, lambda r: fields.axes_remapped(r, F.col("orientation"))))
    times = fields.sample_times(F.coalesce("stamp_us", F.lit(0.0)), F.col("duration"), F.size("samples"))
    both = F.posexplode(F.arrays_zip(times.alias("t"), turned.alias("v")))
    rows = rows.select("flight_id", "payload", "gps_fix", (F.col("gps_precision") / 100).alias("gps_dop"), both.alias("i", "s"))
    value: list[Column] = [F.get(F.col("s.v"), k).alias(n) for k, n in enumerate(names)]
    return rows.select("flight_id", "payload", "i", F.col("s.t").alias("timestamp_s"), *value, "gps_fix", "gps_dop")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(flight_id, key, type, value): the camera's settings in moov/udta/GPMF of MP4 files; only that box is read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for file in pdf.itertuples():
                with video.opened(file.path) as f:
                    place = video.inside(f, 0, file.length, "moov", "udta", "GPMF")
                    box = video.bytes_at(f, place[1], place[2] - place[1]) if place else b""
                nested = [(k, t, s, b) for key, kind, _, _, body in items(box) if key == "DEVC" and kind == "\0" for k, t, s, _, b in items(body)]
                for k, t, s, b in nested or [(k, t, s, b) for k, t, s, _, b in items(box)]:
                    first = numbers(t, s, b)
                    rows.append((video.stem(file.path), k, t, ".".join(f"{x:g}" for x in first[0]) if first else text(b)))
            yield pd.DataFrame(rows, columns=["flight_id", "key", "type", "value"])

    return video.video_files(spark, path).mapInPandas(run, "flight_id string, key string, type string, value string")


def gps_track(parsed: DataFrame) -> DataFrame:
    """(flight_id, timestamp_s, gps_lat_deg, gps_lon_deg, gps_alt_m, gps_speed2d_ms, gps_speed3d_ms, gps_fix, gps_dop).

    The camera's positions with the acceleration of the nearest moment, of two equally near ones the later.
    """
    from ..operators import ordered

    gps = samples(parsed, "GPS5", ["gps_lat_deg", "gps_lon_deg", "gps_alt_m", "gps_speed2d_ms", "gps_speed3d_ms"]).drop("payload", "i")
    pulls = [f"accl_{a}_ms2" for a in "xyz"]
    return ordered.nearest(gps, samples(parsed, "ACCL", pulls), "timestamp_s", pulls).drop("matched_t")


def first_clock(parsed: DataFrame) -> DataFrame:
    """(flight_id, start): the clock of the first payload that has one, null without any."""
    known = F.when(F.col("gps_clock").isNotNull(), F.struct("pts", "payload"))
    return parsed.groupBy("flight_id").agg(fields.gps_clock(F.min_by("gps_clock", known)).alias("start"))


def stream_rates(payloads: DataFrame, durations: DataFrame, flight: str = "flight_id") -> DataFrame:
    """payloads (flight, stream, raw: an array of samples); durations (flight, duration_s).

    (flight, stream, n_samples, rate_hz): over all payloads; no rate for a duration that is missing or not above 0.
    """
    counts = payloads.groupBy(flight, "stream").agg(F.sum(F.greatest(F.size("raw"), F.lit(0))).cast("long").alias("n_samples"))
    rate = F.when(F.col("duration_s") > 0, F.col("n_samples") / F.col("duration_s"))
    return counts.join(durations, flight, "left").select(flight, "stream", "n_samples", rate.alias("rate_hz"))
