"""Repair of altitude glitches in logger data."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geodesy import haversine
from .ordered import by_time, step_rate, stretches, strictly_increasing

#: Steps of more than so many metres a second are glitches; a missed climb is drawn with the other rate.
GLITCH, CLIMB = 30.0, 10.0
TRUST = 0.01
ALTITUDES = ("alt_gps_m", "alt_baro_m", "z_m")


def _between(values: np.ndarray, rows: np.ndarray, new: np.ndarray) -> None:
    values[rows] = np.trunc(new) if values.dtype.kind == "i" else new


def repair_flight(pdf: pd.DataFrame) -> pd.DataFrame:
    """One flight in order of time.  A drop is bridged up to the next rise; a lone rise gets a ramp before it.

    Whole-number columns stay whole (cut towards zero).  The steps are those before any repair; the repairs see each
    other's results.  A drop without a rise after it, or at the start, stays as it is.
    """
    if len(pdf) < 3 or "alt_gps_m" not in pdf:
        return pdf
    t = pdf["timestamp_s"].to_numpy(float)
    columns = {c: pdf[c].to_numpy().copy() for c in ALTITUDES if c in pdf}
    weight = pdf["weight"].to_numpy(float).copy() if "weight" in pdf else None
    rate = np.append(0.0, np.diff(columns["alt_gps_m"].astype(float)) / np.maximum(np.diff(t), 1.0))
    events = [(i, rate[i] > 0) for i in np.flatnonzero(np.abs(rate) > GLITCH)]
    at = 0
    while at < len(events):
        i, rising = events[at]
        at += 1
        rows = np.zeros(0, int)
        if not rising:
            ahead = next((k for k in range(at, len(events)) if events[k][1]), None)
            if ahead is None:
                continue
            end, at = events[ahead][0], ahead + 1
            rows = np.arange(i, end)
            for values in columns.values():
                a, b = float(values[i - 1]), float(values[end])
                # Divided last, so that a whole height isn't missed by a rounded share.
                _between(values, rows, a + (t[rows] - t[i - 1]) * (b - a) / (t[end] - t[i - 1]))
        else:
            top, ground = float(columns["alt_gps_m"][i]), float(columns["alt_gps_m"][i - 1])
            seconds = max(1.0, (top - ground) / CLIMB)
            begin = t[i] - seconds
            rows = np.flatnonzero((t >= begin) & (t < t[i]))
            for values in columns.values():
                a, b = float(values[i - 1]), float(values[i])
                _between(values, rows, a + (t[rows] - begin) * (b - a) / seconds)
        if weight is not None:
            weight[rows] = TRUST
    return pdf.assign(**columns, **({} if weight is None else {"weight": weight}))


def repair_altitude(df: DataFrame, flight: str = "flight_id") -> DataFrame:
    """All flights; each is one group, as a repair depends on those before it."""
    fields = dict(df.dtypes)
    columns = df.columns
    whole = [c for c in ALTITUDES if fields.get(c) in ("bigint", "int")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp_s", kind="stable").reset_index(drop=True)
        for c in whole:
            if not pdf[c].isna().any():
                pdf[c] = pdf[c].astype("int64")
        return repair_flight(pdf)[columns]

    return df.groupBy(flight).applyInPandas(run, df.schema)


def bridge_drops(df: DataFrame, value: str, time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """Only the drops, with windows alone: rows from a drop to before the next rise become linear between its ends.

    The same as repair_altitude() for data without lone rises: a rise ends the drop before it.
    """
    w = by_time(flight, time)
    df = df.withColumn("_rate", step_rate(value, time, w))
    mark = F.when(F.col("_rate") < -GLITCH, -1).when(F.col("_rate") > GLITCH, 1)
    df = df.withColumn("_mark", mark)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    # The first drop since the last rise opens the gap; the next rise closes it.
    df = df.withColumn("_rises", F.sum(F.when(F.col("_mark") == 1, 1).otherwise(0)).over(past))
    open_row = F.struct(F.lag(time).over(w).alias("t"), F.lag(value).over(w).alias("v"))
    df = df.withColumn("_open", F.when(F.col("_mark") == -1, open_row))
    gap = Window.partitionBy(flight, "_rises").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_a", F.first("_open", ignorenulls=True).over(gap))
    close = F.when(F.col("_mark") == 1, F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    df = df.withColumn("_close", close)
    df = df.withColumn("_b", F.last("_close", ignorenulls=True).over(Window.partitionBy(flight).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, -1)))
    span = F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0.0))
    line = F.col("_a.v") + (F.col(time) - F.col("_a.t")) / span * (F.col("_b.v") - F.col("_a.v"))
    bad = F.col("_a.t").isNotNull() & F.col("_b").isNotNull()
    return df.withColumns({f"{value}_repaired": F.when(bad, line).otherwise(F.col(value).cast("double")), "repaired": bad}).drop("_rate", "_mark", "_rises", "_open", "_a", "_b", "_close")


def steady(t: np.ndarray, v: np.ndarray, most: float, last: tuple[float, float] | None = None) -> np.ndarray:
    """Which values change by at most `most` a second from the one kept before them; last: the one kept before the first.

    Values that are none are never kept.  Where neighbours are steady nothing is looked up; after a jump the next value that
    fits is sought in stretches of growing length.
    """
    keep = np.zeros(len(t), bool)
    known = np.flatnonzero(~np.isnan(v))
    if not len(known):
        return keep
    t, v = t[known], v[known]
    near = np.append(False, np.abs(np.diff(v)) <= most * np.diff(t))
    jumps = np.append(np.flatnonzero(~near), len(t))
    i = 0
    while i < len(t):
        if last is not None:  # the first value from i on that fits the last one kept
            width, at = 8, i
            while at < len(t):
                fits = np.abs(v[at : at + width] - last[1]) <= most * (t[at : at + width] - last[0])
                if fits.any():
                    break
                at, width = at + width, width * 2
            if at >= len(t):
                break
            i = at + int(fits.argmax())
        end = int(jumps[np.searchsorted(jumps, i, side="right")])
        keep[known[i:end]] = True
        last, i = (t[end - 1], v[end - 1]), end
    return keep


def without_spikes(df: DataFrame, value: str, most: float, time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """Rows that change by at most `most` a second from the row kept before them; the first stays, rows without a value go.

    Flights stream past in order of time, batch by batch, so a task holds a batch however long a flight is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for b in batches:
            t, v = (b[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (time, value))
            keep = np.zeros(b.num_rows, bool)
            for key, lo, hi in stretches(b[flight]):
                if (key,) != now:
                    now, last = (key,), None
                keep[lo:hi] = steady(t[lo:hi], v[lo:hi], most, last)
                if keep[lo:hi].any():
                    k = lo + int(np.flatnonzero(keep[lo:hi])[-1])
                    last = (t[k], v[k])
            yield b.filter(pa.array(keep))

    return df.repartition(flight).sortWithinPartitions(flight, time).mapInArrow(run, T.StructType(df.schema.fields))


def dropped_report(df: DataFrame, time: str, order: str, flight: str = "flight_id") -> DataFrame:
    """By flight: rows, and rows that strictly_increasing() drops."""
    w = by_time(flight, order).rowsBetween(Window.unboundedPreceding, -1)
    marked = df.select(flight, (F.col(time) <= F.max(time).over(w)).alias("_late"))
    return marked.groupBy(flight).agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("_late"), 1)).alias("dropped"))


def dropped_ranges(df: DataFrame, kept: str, speed: str, time: str, order: str, flight: str = "flight_id", ground_speed: float = 7.0, gap: float = 1.0) -> DataFrame:
    """What a filter drops; kept is its verdict on each row, null counts as dropped.

    (flight, n_rows, dropped, ground, in_flight, jitter, gaps): dropped rows under the ground speed and others, runs of
    dropped rows that last no longer than `gap` seconds, and the longer runs as structs start_s, end_s in order.
    """
    rows = df.select(flight, F.col(order).alias("_o"), F.col(time).alias("_t"), F.col(speed).alias("_v"), (~F.coalesce(F.col(kept), F.lit(False))).alias("_out"))
    w = by_time(flight, "_o")
    first = F.col("_out") & ~F.coalesce(F.lag("_out").over(w), F.lit(False))
    rows = rows.withColumn("_first", first.cast("long"))
    rows = rows.withColumn("_run", F.when(F.col("_out"), F.sum("_first").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    runs = rows.groupBy(flight, "_run").agg(
        F.count("*").alias("_n"), F.count(F.when(F.col("_v") < ground_speed, 1)).alias("_slow"), F.min_by("_t", "_o").alias("_a"), F.max_by("_t", "_o").alias("_z")
    )
    out, long = F.col("_run").isNotNull(), F.col("_z") - F.col("_a") > gap
    total = lambda c: F.coalesce(F.sum(F.when(out, c)), F.lit(0)).cast("long")
    ranges = F.array_sort(F.collect_list(F.when(out & long, F.struct(F.col("_a").alias("start_s"), F.col("_z").alias("end_s")))))
    return runs.groupBy(flight).agg(
        F.sum("_n").cast("long").alias("n_rows"), total(F.col("_n")).alias("dropped"), total(F.col("_slow")).alias("ground"), total(F.col("_n") - F.col("_slow")).alias("in_flight"),
        F.count(F.when(out & ~F.coalesce(long, F.lit(False)), 1)).alias("jitter"), ranges.alias("gaps"),
    )


def precise_enough(df: DataFrame, dilution: str, most: float = 5.0) -> DataFrame:
    """Rows whose dilution of precision isn't known or is at most so much."""
    return df.where(F.col(dilution).isNull() | (F.col(dilution) <= most))


def within_bounds(df: DataFrame, lat: str = "latitude", lon: str = "longitude", alt: str | None = "altitude_msl", highest: float = 20000.0) -> DataFrame:
    """Rows on the globe and not above the highest altitude; without a latitude or longitude a row goes."""
    inside = F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180)
    return df.where(inside if alt is None else inside & F.coalesce(F.col(alt) <= highest, F.lit(True)))


def one_each_time(df: DataFrame, time: str, order: str, flight: str = "flight_id") -> DataFrame:
    """The first row, by order, of each flight and time.  Rows come back in order of time within a flight."""
    w = Window.partitionBy(flight, time).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k").sortWithinPartitions(flight, time)


def with_ground_speed(df: DataFrame, lat: str, lon: str, speed: str, time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """Speeds that are null come from the way and the time since the row before; a first row's stays null."""
    w = by_time(flight, time)
    way = haversine(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon))
    return df.withColumn(speed, F.coalesce(F.col(speed), way / F.nullif(F.col(time) - F.lag(time).over(w), F.lit(0))))
