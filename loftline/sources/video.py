"""Camera telemetry in MP4 files, read by ranges: a task opens a file, walks its boxes and reads the bytes it needs.

Recordings are larger than a row may be, so no file is ever loaded whole.  Paths may be of any file system that Arrow
opens (local, HDFS, S3).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

PAYLOADS = "flight_id string, payload int, pts double, duration double, data binary"
#: Payload bytes of one batch of rows.
BATCH = 8 << 20

Box = tuple[str, int, int]


def opened(uri: str) -> BinaryIO:
    from pyarrow import fs

    if uri.startswith("file:"):
        return open("/" + uri.removeprefix("file:").lstrip("/"), "rb")
    system, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return system.open_input_file(path)


def bytes_at(f: BinaryIO, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(max(n, 0))


def boxes(f: BinaryIO, at: int, end: int) -> Iterator[Box]:
    """Kind, start and end of the content of each box in a range; a size of 0, or one that can't be, ends the walk."""
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", bytes_at(f, at, 8))
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack(">Q", bytes_at(f, at + 8, 8))[0], 16
        if size < head:
            return
        yield kind.decode("latin-1"), at + head, min(at + size, end)
        at += size


def inside(f: BinaryIO, at: int, end: int, *path: str) -> Box | None:
    """The first box on a path of kinds."""
    found: Box | None = ("", at, end)
    for kind in path:
        found = next((b for b in boxes(f, found[1], found[2]) if b[0] == kind), None) if found else None
    return found


def numbers_in(f: BinaryIO, table: Box | None, kinds: str, skip: int = 4) -> list[tuple]:
    """The entries of a sample table: `skip` bytes, their count, then the entries themselves."""
    if not table:
        return []
    raw = bytes_at(f, table[1], table[2] - table[1])
    if len(raw) < skip + 4:
        return []
    width, n = struct.calcsize(">" + kinds), struct.unpack_from(">I", raw, skip)[0]
    whole = min(n, (len(raw) - skip - 4) // width)
    return list(struct.iter_unpack(">" + kinds, raw[skip + 4 : skip + 4 + whole * width]))


def packets(f: BinaryIO, end: int) -> Iterator[tuple[float, float, int, int]]:
    """Time, duration, place and size of each packet of the telemetry track, in order; none without such a track."""
    movie = inside(f, 0, end, "moov")
    for kind, a, z in boxes(f, movie[1], movie[2]) if movie else ():
        tables = inside(f, a, z, "mdia", "minf", "stbl") if kind == "trak" else None
        header = inside(f, a, z, "mdia", "mdhd") if tables else None
        if not tables or not header:
            continue
        table = lambda name, t=tables: inside(f, t[1], t[2], name)
        entry = table("stsd")
        if not entry or bytes_at(f, entry[1] + 12, 4) != b"gpmd":
            continue
        wide = bytes_at(f, header[1], 1) == b"\1"
        scale = struct.unpack(">I", bytes_at(f, header[1] + (20 if wide else 12), 4))[0] or 1
        sizes_box = table("stsz")
        same, count = struct.unpack(">II", bytes_at(f, sizes_box[1] + 4, 8)) if sizes_box else (0, 0)
        sizes = [same] * count if same else [s for (s,) in numbers_in(f, sizes_box, "I", 8)]
        steps = [d for n, d in numbers_in(f, table("stts"), "II") for _ in range(n)]
        chunks = [c for (c,) in numbers_in(f, table("stco"), "I") or numbers_in(f, table("co64"), "Q")]
        runs = numbers_in(f, table("stsc"), "III")
        each = []
        for k, (first, per, _) in enumerate(runs):
            last = runs[k + 1][0] if k + 1 < len(runs) else len(chunks) + 1
            each += [per] * (last - first)
        i = ticks = 0
        for at, n in zip(chunks, each, strict=False):
            for size in sizes[i : i + n]:
                step = steps[i] if i < len(steps) else 0
                yield ticks / scale, step / scale, at, size
                at, ticks, i = at + size, ticks + step, i + 1
        return


def stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def video_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length): the files alone; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(flight_id, payload, pts, duration, data): the telemetry packets of MP4 files; flight_id is the file's name.

    A file is one task's work, but only its packets are read, in batches of about BATCH bytes.  A packet that the file
    ends before is left out; a file without a telemetry track gives no rows.
    """
    names = [x.split()[0] for x in PAYLOADS.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file in pdf.itertuples():
                rows, held = [], 0
                with opened(file.path) as f:
                    for k, (pts, duration, at, size) in enumerate(packets(f, file.length)):
                        data = bytes_at(f, at, size)
                        if len(data) == size:
                            rows.append((stem(file.path), k, pts, duration, data))
                            held += size
                        if held >= BATCH:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    return video_files(spark, path).mapInPandas(run, PAYLOADS)
