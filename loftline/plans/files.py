"""Texts as files: one file for each flight, all of them or none.

Tasks write under a folder of their own in the target; the driver renames what succeeded when all tasks have ended, and
clears the folders.  So a task that is run again leaves no second file, and a write that fails leaves none.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import sinks

STAGING = "_staging"


def _system(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path.rstrip("/")
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/")
    system, top = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system, top.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """Staged files and what they are to be called."""

    files: list[tuple[str, str]]


class TextFileWriter(DataSourceWriter):
    def __init__(self, path: str, ending: str, overwrite: bool):
        self.path, self.ending, self.overwrite, self.job = path, ending, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        system, top = _system(self.path)
        folder, done = f"{top}/{STAGING}/{self.job}/{uuid.uuid4().hex}", []
        system.create_dir(folder, recursive=True)
        for name, text in rows:
            if name is None or not re.fullmatch(r"[^/\x00]+", name) or name.startswith((".", "_")):
                raise ValueError(f"no name for a file: {name!r}")
            staged = f"{folder}/{len(done)}"
            with system.open_output_stream(staged) as f:
                f.write((text or "").encode())
            done.append((staged, f"{name}{self.ending}"))
        return Written(done)

    def _clear(self) -> None:
        system, top = _system(self.path)
        from pyarrow import fs

        for folder in (f"{top}/{STAGING}/{self.job}", f"{top}/{STAGING}"):
            if system.get_file_info(folder).type == fs.FileType.Directory and (self.job in folder or not system.get_file_info(fs.FileSelector(folder))):
                system.delete_dir(folder)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, top = _system(self.path)
        system.create_dir(top, recursive=True)
        new = [x for m in messages if m for x in m.files]
        names = [n for _, n in new]
        there = {f.base_name for f in system.get_file_info(fs.FileSelector(top)) if f.type == fs.FileType.File and f.base_name.endswith(self.ending)}
        twice = sorted(n for n, k in Counter(names).items() if k > 1)
        if twice or (not self.overwrite and there & set(names)):
            self._clear()
            raise ValueError(f"more than one text for {twice or sorted(there & set(names))}")
        for name in there if self.overwrite else ():
            system.delete_file(f"{top}/{name}")
        for staged, name in new:
            system.move(staged, f"{top}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


class TextFiles(DataSource):
    """Rows (name, text) become files `path/name + ending`.  Mode append adds files; overwrite replaces those with that ending."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> TextFileWriter:
        return TextFileWriter(self.options["path"], self.options.get("ending", ""), overwrite)


def write_texts(texts: DataFrame, path: str, ending: str, mode: str = "overwrite") -> None:
    """texts (name, text), in this order: a file for each row.  A name that is null, hidden or a path, or comes twice, is an
    error and no file is left; a null text is an empty file.  Paths may be of any file system that Arrow opens."""
    texts.sparkSession.dataSource.register(TextFiles)
    name, text = texts.columns
    rows = texts.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text"))
    rows.write.format("text_files").mode(mode).option("ending", ending).save(path)


def write_subtitles(df: DataFrame, phase: str, path: str, time: str = "timestamp_s", flight: str = "flight_id") -> None:
    """A subtitle file for each flight."""
    write_texts(sinks.subtitles(df, phase, time, flight), path, ".srt")


def write_frames(frames: DataFrame, path: str, flight: str = "flight_id") -> None:
    """A frame file for each flight; see sinks.frame_csv()."""
    write_texts(sinks.frame_csv(frames, flight), path, ".csv")


def write_indexed(df: DataFrame, columns: list[str], order: str, path: str, flight: str = "flight_id") -> None:
    """A table for each flight whose first column has no name and counts from 0."""
    write_texts(sinks.indexed_csv(df, columns, order, flight), path, ".csv")


def write_geojson(lines: DataFrame, path: str, flight: str = "flight_id") -> None:
    """lines (flight, layer, coordinates): a feature collection for each flight."""
    write_texts(sinks.feature_collection(lines, flight), path, ".geojson")
