"""Files: Parquet and CSV tables, subtitles, GeoJSON, frame rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import ordered

# Default style of a line.
STYLE = {"name": "Flight Track", "stroke": "#555555", "stroke-width": 3.0, "stroke-opacity": 1.0}


def write_table(df: DataFrame, path: str, flight: str = "flight_id") -> None:
    df.write.mode("overwrite").partitionBy(flight).parquet(path)


def write_csv(df: DataFrame, path: str, order: tuple[str, ...]) -> None:
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


# Columns and formats of a frame file.
FRAME = {
    "frame_id": "%04d", "timestamp_s": "%.6f", "video_time_s": "%.6f", "x_m": "%.6f", "y_m": "%.6f", "z_m": "%.6f", "vx_ms": "%.6f", "vy_ms": "%.6f", "vz_ms": "%.6f", "v_mag_ms": "%.6f",
    "ax_ms2": "%.6f", "ay_ms2": "%.6f", "az_ms2": "%.6f", "load_g": "%.4f", "yaw_rad": "%.6f", "pitch_rad": "%.6f", "roll_rad": "%.6f", "phase": "%s",
}


def frame_csv(frames: DataFrame, flight: str = "flight_id") -> DataFrame:
    """frames: the columns of FRAME.  (flight, csv): a flight's frames as one file's text, in order of frame_id."""
    line = F.format_string(",".join(FRAME.values()), *FRAME)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("frame_id", line.alias("line")))), lambda x: x["line"])
    return frames.groupBy(flight).agg(F.concat(F.lit(",".join(FRAME) + "\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("csv"))


def indexed_csv(df: DataFrame, columns: list[str], order: str, flight: str = "flight_id") -> DataFrame:
    """(flight, csv): a flight's rows as one file's text; the first column has no name and counts from 0.  Nulls are empty."""
    row = F.struct(order, F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("cells"))
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda x, i: F.concat(i.cast("string"), F.lit(","), F.array_join(x["cells"], ",")))
    return df.groupBy(flight).agg(F.concat(F.lit(",".join(["", *columns]) + "\n"), F.array_join(lines, "\n"), F.lit("\n")).alias("csv"))


def subtitles(df: DataFrame, phase: str, time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """(flight, srt): the phases of each flight as one subtitle text; an empty line ends each block."""
    blocks = ordered.islands(df, phase, time, flight)
    one = text.srt_block(F.col("block"), F.col("start_s"), F.col("end_s"), F.concat(F.col(phase), F.lit(" until "), text.srt_time(F.col("end_s"))))
    parts = F.array_sort(F.collect_list(F.struct("block", one.alias("srt"))))
    return blocks.groupBy(flight).agg(F.array_join(F.transform(parts, lambda p: F.concat(p["srt"], F.lit("\n"))), "").alias("srt"))


def feature(coordinates: Column, name: Column, stroke: Column | None = None) -> Column:
    style = F.struct(name.alias("name"), F.coalesce(stroke, F.lit(STYLE["stroke"])).alias("stroke") if stroke is not None else F.lit(STYLE["stroke"]).alias("stroke"), F.lit(STYLE["stroke-width"]).alias("stroke-width"), F.lit(STYLE["stroke-opacity"]).alias("stroke-opacity"))
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    return F.struct(F.lit("Feature").alias("type"), style.alias("properties"), geometry.alias("geometry"))


def feature_collection(lines: DataFrame, by: str) -> DataFrame:
    """lines (by, layer, coordinates): (by, geojson); empty lines are left out."""
    rows = lines.where(F.size("coordinates") > 0).select(by, "layer", feature(F.col("coordinates"), F.col("layer")).alias("f"))
    all_features = F.transform(F.array_sort(F.collect_list(F.struct("layer", "f"))), lambda x: x["f"])
    body = F.struct(F.lit("FeatureCollection").alias("type"), all_features.alias("features"))
    return rows.groupBy(by).agg(F.to_json(body, {"pretty": "true"}).alias("geojson"))


def overview_lines(columns: dict[str, str], sequence: str, actor: str, font: int) -> Column:
    """The overview's lines as structs x, y, text, colour: title, actor, then each column in order; fractions have three
    digits, frame_id has no line of its own.  columns: names and types of the frame."""

    def shown(name: str, kind: str) -> Column:
        value = F.format_string("%.3f", name) if kind in ("double", "float") else F.col(name).cast("string")
        missing = "nan" if kind in ("double", "float") else "None"
        return F.concat(F.lit(f"{name}: "), F.when(F.col(name).isNull(), missing).otherwise(F.regexp_replace(value, "NaN", "nan")))

    title = F.concat(F.lit(f"{sequence} | Frame: "), F.col("frame_id").cast("string"))
    texts = [title, F.lit(f"actor: {actor}"), *(shown(n, k) for n, k in columns.items() if n != "frame_id")]
    line = lambda i, t: F.struct(F.lit(50).alias("x"), F.lit(50 + i * (font + 4)).alias("y"), t.alias("text"), F.lit("yellow" if i == 0 else "white").alias("colour"))
    return F.array(*(line(i, t) for i, t in enumerate(texts)))


def draw_commands(frames: DataFrame, widgets: list[dict], width: int = 3840, height: int = 2160, only: list[str] | None = None, sequence: str = "", actor: str = "", font: int = 40) -> DataFrame:
    """A row for each text that is drawn: frame_id, widget, x, y, text, colour.

    The widget `overview` is always there, besides those of the configuration: dictionaries with name, type, x, y and,
    for speed, unit; with a title, that stands at (x, y) and the value title_size + 5 pixels under it.  Unknown types are
    skipped; `only` names the widgets that are drawn; values that are null or NaN aren't.
    """
    valid = lambda name: F.when(~F.isnan(F.col(name).try_cast("double")), F.col(name).try_cast("double"))
    texts = {
        "AltitudeOverlay": lambda w: text.altitude_text(valid("z_m")),
        "SpeedOverlay": lambda w: text.speed_text(valid("v_mag_ms"), w.get("unit", "km/h")),
        "SpeedupOverlay": lambda w: text.speedup_text(valid("speedup_raw"), w.get("round", False)),
    }
    size = {"x": width, "y": height}
    shown = lambda name: only is None or name in only
    one = lambda name, x, y, t, colour="white": F.struct(F.lit(name).alias("widget"), F.lit(x).alias("x"), F.lit(y).alias("y"), t.alias("text"), F.lit(colour).alias("colour"))
    commands = []
    if shown("overview"):
        lines = overview_lines(dict(frames.dtypes), sequence, actor, font)
        commands.append(F.transform(lines, lambda c: F.struct(F.lit("overview").alias("widget"), c["x"].alias("x"), c["y"].alias("y"), c["text"].alias("text"), c["colour"].alias("colour"))))
    for w in widgets:
        if w["type"] not in texts or not shown(w["name"]):
            continue
        x, y = (int(float(str(w[a])[:-1]) / 100 * size[a]) if str(w[a]).endswith("%") else int(w[a]) for a in "xy")
        value = texts[w["type"]](w)
        if w.get("title"):
            commands.append(F.array(one(w["name"], x, y, F.when(value.isNotNull(), w["title"]))))
            y += int(w.get("title_size", font)) + 5
        commands.append(F.array(one(w["name"], x, y, value)))
    if not commands:
        raise ValueError("no widget is left to draw")
    return frames.select("frame_id", F.inline(F.flatten(F.array(*commands)))).where("text IS NOT NULL")
