"""Operators over rows in order of time, by flight.

Each works with one shuffle on the flight: windows over the same partition share the exchange and the sort.  Matching
two series never joins them: the rows are united and the neighbours filled in from before and after.  What comes after a row
is looked up in descending order: a frame that ends with its row grows by one row each time, whereas one that begins
with it is gone through anew for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ..functions import flight as fl


def stretches(keys: pa.Array) -> Iterator[tuple[object, int, int]]:
    """Key, start and end of each run of one key."""
    if len(keys):
        coded = keys.dictionary_encode()
        code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield keys[lo].as_py(), lo, hi


def by_time(flight: str = "flight_id", *order: str) -> WindowSpec:
    return Window.partitionBy(flight).orderBy(*(order or ("timestamp_s",)))


def strictly_increasing(df: DataFrame, time: str, order: str, flight: str = "flight_id") -> DataFrame:
    """Rows, in the given order, whose time exceeds all times before; the first row stays."""
    before = by_time(flight, order).rowsBetween(Window.unboundedPreceding, -1)
    most = F.max(time).over(before)
    return df.withColumn("_most", most).where(F.col("_most").isNull() | (F.col(time) > F.col("_most"))).drop("_most")


def plausible_speed(df: DataFrame, x: str, y: str, time: str, speed: str, order: str, flight: str = "flight_id") -> DataFrame:
    """Rows whose speed from positions is within (0.5, 2) of the measured one, after more than 0.03 s; slow ones stay."""
    w = by_time(flight, order)
    dt = F.col(time) - F.lag(time).over(w)
    implied = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2)) / F.nullif(dt, F.lit(0.0))
    ratio = implied / F.nullif(F.col(speed), F.lit(0.0))
    marked = df.withColumns({"_dt": dt, "_ratio": ratio})
    fits = (F.col("_ratio") > 0.5) & (F.col("_ratio") < 2.0) & (F.col("_dt") > 0.03)
    return marked.where(F.col("_dt").isNull() | F.coalesce(fits, F.lit(False)) | (F.col(speed) < 7.0)).drop("_dt", "_ratio")


def step_rate(value: str, time: str, w: WindowSpec, least: float = 1.0) -> Column:
    """Change to the row before by time, which counts as `least` at least; 0 in the first row."""
    return F.coalesce((F.col(value) - F.lag(value).over(w)) / F.greatest(F.col(time) - F.lag(time).over(w), F.lit(least)), F.lit(0.0))


def island_id(value: str, w: WindowSpec) -> Column:
    """Numbers runs of one value from 1."""
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | F.lag(F.lit(1)).over(w).isNull()
    return F.sum(changed.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))


def islands(df: DataFrame, value: str, time: str = "timestamp_s", flight: str = "flight_id", *order: str) -> DataFrame:
    """One row for each run of one value: flight, block, value, start, end, rows.  Null values and times are dropped."""
    rows = df.dropna(subset=[value, time])
    w = by_time(flight, *(order or (time,)))
    # The flag first, then its sum: two windows over one sort.
    rows = rows.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("long"))
    rows = rows.withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(flight, "block").agg(F.min(value).alias(value), F.min(time).alias("start_s"), F.max(time).alias("end_s"), F.count("*").alias("n_rows"))


def transitions(df: DataFrame, value: str, time: str, flight: str = "flight_id", *order: str) -> DataFrame:
    """Rows where the value changes: flight, time, from, to."""
    w = by_time(flight, *(order or (time,)))
    rows = df.select(flight, time, F.lag(value).over(w).alias("from_value"), F.col(value).alias("to_value"))
    return rows.where("from_value IS NOT NULL AND from_value <> to_value")


def central_partners(time: str, columns: list[str], flight: str, half: float, inside: bool) -> dict[str, Column]:
    """For each column its value at the partner before (`_b`) and after (`_f`).

    inside: the outermost rows within half a span; else the nearest rows at least half a span away, or the first and
    last row of the flight.
    """
    over = f"PARTITION BY `{flight}` ORDER BY `{time}`"
    found = {}
    for c in columns:
        if inside:
            frame = f"RANGE BETWEEN {half}D PRECEDING AND {half}D FOLLOWING"
            found[f"{c}_b"] = F.expr(f"first_value(`{c}`) OVER ({over} {frame})")
            found[f"{c}_f"] = F.expr(f"last_value(`{c}`) OVER ({over} {frame})")
        else:
            first = f"first_value(`{c}`) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
            last = f"last_value(`{c}`) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
            found[f"{c}_b"] = F.expr(f"coalesce(last_value(`{c}`) OVER ({over} RANGE BETWEEN UNBOUNDED PRECEDING AND {half}D PRECEDING), {first})")
            found[f"{c}_f"] = F.expr(f"coalesce(last_value(`{c}`) OVER ({over} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND {half}D PRECEDING), {last})")
    return found


def central_difference(df: DataFrame, columns: list[str], time: str, half: float = 1.5, inside: bool = False, flight: str = "flight_id") -> DataFrame:
    """Adds d_<column>, the change between the partners, and d_t, at least 1e-6."""
    with_partners = df.withColumns(central_partners(time, [*columns, time], flight, half, inside))
    added = {f"d_{c}": F.col(f"{c}_f") - F.col(f"{c}_b") for c in columns}
    added["d_t"] = F.greatest(F.col(f"{time}_f") - F.col(f"{time}_b"), F.lit(1e-6))
    return with_partners.withColumns(added).drop(*(f"{c}_{s}" for c in [*columns, time] for s in "bf"))


def unwrap(df: DataFrame, angle: str, out: str, flight: str = "flight_id", *order: str) -> DataFrame:
    """Angle in radians without jumps of more than half a turn."""
    w = by_time(flight, *order)
    delta = F.col(angle) - F.lag(angle).over(w)
    near = F.pmod(delta + F.pi(), 2 * F.pi()) - F.pi()
    near = F.when((near == -F.pi()) & (delta > 0), F.pi()).otherwise(near)
    # first angle + sum of the short ways
    step = df.withColumn("_step", F.coalesce(near, F.col(angle)))
    return step.withColumn(out, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def median_interval(df: DataFrame, time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """(flight, median_dt): of the steps in time; 1.0 if there is none or it is next to nothing."""
    step = df.select(flight, (F.col(time) - F.lag(time).over(by_time(flight, time))).alias("dt"))
    median = F.percentile("dt", F.lit(0.5))
    return step.groupBy(flight).agg(F.when(median < 1e-6, 1.0).otherwise(F.coalesce(median, F.lit(1.0))).alias("median_dt"))


def half_window(median_dt: Column, span: float = 2.0) -> Column:
    """Half of the odd number of rows, 3 at least, that makes up the span (rounded half to even)."""
    n = F.greatest(F.lit(3), F.rint(F.lit(span) / median_dt).cast("long"))
    return F.floor(n / 2)


def rolling_median(df: DataFrame, column: str, out: str, half: int, flight: str = "flight_id", *order: str) -> DataFrame:
    """Centred median over 2 * half + 1 rows; fewer at the ends."""
    return df.withColumn(out, F.percentile(column, F.lit(0.5)).over(by_time(flight, *order).rowsBetween(-half, half)))


#: Rows whose medians are found at once, besides what their windows reach over.
CHUNK = 1 << 14


def rolling_medians(df: DataFrame, columns: dict[str, str], time: str, flight: str = "flight_id", span: float = 2.0, *order: str) -> DataFrame:
    """Adds for each column -> name its centred median over the span, in rows of the flight's own median step.

    The number of rows is a column: a flight's rows are cut into chunks, a row goes to each chunk whose windows reach it,
    and a chunk is one group, however long the flight and however many rates there are.  Nulls don't count.
    """
    w = by_time(flight, *(order or (time,)))
    rows = df.withColumns({"_n": F.row_number().over(w) - 1, "_dt": F.col(time) - F.lag(time).over(by_time(flight, time))})
    median = F.percentile("_dt", F.lit(0.5)).over(Window.partitionBy(flight))
    rows = rows.withColumn("_half", half_window(F.when(median < 1e-6, 1.0).otherwise(F.coalesce(median, F.lit(1.0))), span)).drop("_dt")
    chunk = lambda n: F.floor(n / CHUNK)
    rows = rows.withColumn("_chunk", F.explode(F.sequence(chunk(F.greatest(F.lit(0), F.col("_n") - F.col("_half"))), chunk(F.col("_n") + F.col("_half")))))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("_n")
        own = pc.equal(pc.divide(part["_n"], CHUNK), part["_chunk"])
        width = 2 * part["_half"][0].as_py() + 1
        for column, out in columns.items():
            values = pd.Series(part[column].cast(pa.float64()).to_numpy())
            part = part.append_column(out, pa.array(values.rolling(width, center=True, min_periods=1).median(), from_pandas=True))
        return part.filter(own).drop_columns(["_n", "_half", "_chunk"])

    schema = T.StructType([*(f for f in df.schema), *(T.StructField(out, T.DoubleType()) for out in columns.values())])
    rows = rows.withColumns({"_n": F.col("_n").cast("long"), "_half": F.col("_half").cast("long")})
    return rows.groupBy(flight, "_chunk").applyInArrow(run, schema)


def brackets(left: DataFrame, right: DataFrame, time: str, values: list[str], flight: str = "flight_id", strict: bool = False) -> DataFrame:
    """left with structs `before` and `after`: the neighbours (time, values) in right.

    before is the last row at or before the time (strict: before it), after the first one at or after it.
    """
    side = F.struct(F.col(time).alias("t"), *values)
    empty = F.lit(None).cast(right.select(side.alias("s")).schema["s"].dataType)
    both = left.withColumns({"_side": F.lit(1), "_row": empty}).unionByName(
        right.select(flight, time, F.lit(0).alias("_side"), side.alias("_row")), allowMissingColumns=True
    )
    # A right row of a left row's time comes before it both upward and downward; upward not if strict.
    at = Window.partitionBy(flight).orderBy(time, F.col("_side").desc() if strict else "_side")
    down = Window.partitionBy(flight).orderBy(F.desc(time), "_side")
    met = lambda w: F.last("_row", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumns({"before": met(at), "after": met(down)}).where("_side = 1").drop("_side", "_row")


def merged(left: DataFrame, others: dict[str, tuple[DataFrame, list[str]]], time: str = "timestamp_s", flight: str = "flight_id", exact: tuple[str, ...] = ()) -> DataFrame:
    """left with the values of many other series, interpolated linearly at its times and held at their ends.

    others: name -> (series, values).  All series are united with left: one exchange, however many there are, and a sort
    upward and one downward.  A series named in `exact` that has as many rows in a flight as left is taken row by row
    instead.  A flight without a row of a series has nulls.
    """
    rows = left.withColumn("_side", F.lit(1))
    kinds = {}
    for name, (series, values) in others.items():
        side = F.struct(F.col(time).alias("t"), *(F.col(v).cast("double").alias(v) for v in values))
        more = series.select(flight, time, F.lit(0).alias("_side"), side.alias(f"_{name}"))
        kinds[name] = more.schema[f"_{name}"].dataType
        rows = rows.unionByName(more, allowMissingColumns=True)
    up, down = Window.partitionBy(flight).orderBy(time, "_side"), Window.partitionBy(flight).orderBy(F.desc(time), "_side")
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(flight)
    added = {}
    for name in others:
        c = F.col(f"_{name}")
        added |= {f"_{name}_b": F.last(c, ignorenulls=True).over(past(up)), f"_{name}_a": F.last(c, ignorenulls=True).over(past(down))}
        if name in exact:
            # The k-th row of the series, where the k-th row of left is: all of a flight's, in order, if there are as many.
            added |= {f"_{name}_n": F.count(c).over(whole), f"_{name}_k": F.count(c).over(past(up))}
    if exact:
        added |= {"_all": F.sum("_side").over(whole), "_i": F.sum("_side").over(past(up))}
    rows = rows.withColumns(added)
    for name in exact:
        # Row i of both has one key; the two rows meet in a window on it.
        key = F.when(F.col("_side") == 1, F.col("_i")).when(F.col(f"_{name}").isNotNull(), F.col(f"_{name}_k"))
        pair = Window.partitionBy(flight, key)
        rows = rows.withColumn(f"_{name}_x", F.when(F.col("_all") == F.col(f"_{name}_n"), F.max(f"_{name}").over(pair)))
    rows = rows.where("_side = 1")
    found = {}
    for name, (_, values) in others.items():
        b, a = F.col(f"_{name}_b"), F.col(f"_{name}_a")
        part = F.coalesce((F.col(time) - b["t"]) / F.nullif(a["t"] - b["t"], F.lit(0.0)), F.lit(0.0))
        for v in values:
            mixed = F.when(b.isNull(), a[v]).when(a.isNull(), b[v]).otherwise(b[v] + part * (a[v] - b[v]))
            found[v] = F.when(F.col("_all") == F.col(f"_{name}_n"), F.col(f"_{name}_x")[v]).otherwise(mixed) if name in exact else mixed
    return rows.withColumns(found).select(*left.columns, *found)


def nearest(left: DataFrame, right: DataFrame, time: str, values: list[str], flight: str = "flight_id", later: bool = True) -> DataFrame:
    """left with the values of the nearest row of right; of two equally near ones the later (or the earlier) one."""
    found = brackets(left, right, time, values, flight)
    gap_before, gap_after = F.col(time) - F.col("before.t"), F.col("after.t") - F.col(time)
    closer = gap_before < gap_after if later else gap_before <= gap_after
    pick = F.when(F.col("after").isNull() | (F.col("before").isNotNull() & closer), F.col("before")).otherwise(F.col("after"))
    return found.withColumn("_pick", pick).withColumns({v: F.col(f"_pick.{v}") for v in values}).withColumn("matched_t", F.col("_pick.t")).drop("_pick", "before", "after")


def interpolate(left: DataFrame, right: DataFrame, time: str, values: list[str], flight: str = "flight_id") -> DataFrame:
    """left with the values of right interpolated linearly; held at the ends."""
    found = brackets(left, right, time, values, flight)
    span = F.nullif(F.col("after.t") - F.col("before.t"), F.lit(0.0))
    part = F.coalesce((F.col(time) - F.col("before.t")) / span, F.lit(0.0))

    def at(v: str) -> Column:
        a, b = F.col(f"before.{v}"), F.col(f"after.{v}")
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + part * (b - a))

    return found.withColumns({v: at(v) for v in values}).drop("before", "after")


def played(left: DataFrame, right: DataFrame, time: str, values: list[str], flight: str = "flight_id") -> DataFrame:
    """left with the values of right as playback shows them: between the row before the time and the one at or after it,
    held at the first and the last row; null for a flight without rows."""
    found = brackets(left, right, time, values, flight, strict=True)
    part = (F.col(time) - F.col("before.t")) / F.greatest(F.col("after.t") - F.col("before.t"), F.lit(1e-4))
    between = lambda v: F.col(f"before.{v}") + part * (F.col(f"after.{v}") - F.col(f"before.{v}"))
    at = {v: F.when(F.col("before").isNull(), F.col(f"after.{v}")).when(F.col("after").isNull(), F.col(f"before.{v}")).otherwise(between(v)) for v in values}
    return found.withColumns(at).drop("before", "after")


def playback(left: DataFrame, right: DataFrame, time: str, values: list[str], rotation: list[str], labels: list[str], flight: str = "flight_id") -> DataFrame:
    """left with what playback shows at its times: values between the row before and the one at or after the time, the
    rotation (w, x, y, z) turned the short way between theirs, and labels of the row before.

    Before the first row and after the last one all is as in that row; null for a flight without rows.
    """
    found = brackets(left, right, time, [*values, *rotation, *labels], flight, strict=True)
    before, after = F.col("before"), F.col("after")
    found = found.withColumn("_part", (F.col(time) - before["t"]) / F.greatest(after["t"] - before["t"], F.lit(1e-4)))
    found = fl.with_slerp(found, [before[c] for c in rotation], [after[c] for c in rotation], F.col("_part"), [f"_{c}" for c in rotation])
    shown = lambda v, between: F.when(before.isNull(), after[v]).when(after.isNull(), before[v]).otherwise(between)
    at = {v: shown(v, before[v] + F.col("_part") * (after[v] - before[v])) for v in values} | {c: shown(c, F.col(f"_{c}")) for c in rotation} | {c: shown(c, before[c]) for c in labels}
    return found.withColumns(at).drop("before", "after", "_part", *(f"_{c}" for c in rotation))


def align_by_position(left: DataFrame, right: DataFrame, time: str, values: list[str], flight: str = "flight_id") -> DataFrame:
    """left with the values of the row of right at the same position, for flights with equal counts in both."""
    w = Window.partitionBy(flight)
    number = lambda df: df.withColumns({"_n": F.row_number().over(by_time(flight, time)), "_all": F.count("*").over(w)})
    a, b = number(left), number(right).select(flight, "_n", "_all", *values)
    return a.join(b, [flight, "_n", "_all"]).drop("_n", "_all")


def grid(df: DataFrame, step: float, time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """(flight, grid_i, time): from the flight's first time by steps, its last time excluded."""
    span = df.groupBy(flight).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    n = F.ceil((F.col("_b") - F.col("_a")) / step)
    rows = span.where(n > 0).select(flight, "_a", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("grid_i"))
    return rows.select(flight, "grid_i", (F.col("_a") + F.col("grid_i") * step).alias(time))


def every_nth(df: DataFrame, n: int, time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """The first row of each flight and every n-th after it."""
    return df.withColumn("_n", F.row_number().over(by_time(flight, time))).where(F.pmod(F.col("_n") - 1, F.lit(n)) == 0).drop("_n")


def every_seconds(df: DataFrame, seconds: float, time: str = "timestamp_s", flight: str = "flight_id", first: int = 1000) -> DataFrame:
    """Every n-th row of each flight from its first; n is the interval by the median of the flight's first steps.

    `first` rows give the median, as in every flight the rate is steady; n is 1 at least, halves round to even.
    """
    w = by_time(flight, time)
    rows = df.withColumns({"_n": F.row_number().over(w), "_dt": F.col(time) - F.lag(time).over(w)})
    step = F.percentile(F.when(F.col("_n") <= first, F.col("_dt")), F.lit(0.5)).over(Window.partitionBy(flight))
    rows = rows.withColumn("_step", F.greatest(F.lit(1), F.coalesce(F.rint(seconds / F.nullif(step, F.lit(0.0))).cast("long"), F.lit(1))))
    return rows.where(F.pmod(F.col("_n") - 1, F.col("_step")) == 0).drop("_n", "_dt", "_step")


def stride_cap(df: DataFrame, most: int, time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """At most `most` rows a flight, evenly spaced by rows."""
    w = Window.partitionBy(flight)
    rows = df.withColumns({"_n": F.row_number().over(by_time(flight, time)) - 1, "_skip": F.greatest(F.lit(1), F.floor(F.count("*").over(w) / most))})
    return rows.where((F.pmod("_n", "_skip") == 0) & (F.col("_n") < F.col("_skip") * most)).drop("_n", "_skip")


def backfilled(value: Column, flight: str, *order: str) -> Column:
    """The value, or the next one that isn't null."""
    down = Window.partitionBy(flight).orderBy(*(F.desc(c) for c in order))
    return F.last(value, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))


def speedup(df: DataFrame, time: str, video_time: str, flight: str, *order: str) -> DataFrame:
    """Adds speedup_raw: flight time by video time since the row before; nulls take the next value."""
    w = by_time(flight, *order)
    raw = (F.col(time) - F.lag(time).over(w)) / F.nullif(F.col(video_time) - F.lag(video_time).over(w), F.lit(0.0))
    return df.withColumn("_raw", raw).withColumn("speedup_raw", backfilled(F.col("_raw"), flight, *order)).drop("_raw")


def gaps(df: DataFrame, most: float, time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """(flight, gap_start, gap_end): neighbours in time that are more than `most` apart."""
    rows = df.select(flight, F.lag(time).over(by_time(flight, time)).alias("gap_start"), F.col(time).alias("gap_end"))
    return rows.where(F.col("gap_end") - F.col("gap_start") > most)


def smoothed_circle(df: DataFrame, angles: list[str], values: list[str], half: int, flight: str = "flight_id", *order: str) -> DataFrame:
    """Means over 2 * half + 1 rows: of values, and of angles on the circle."""
    w = by_time(flight, *order).rowsBetween(-half, half)
    added = {f"{a}_mean": F.atan2(F.avg(F.sin(a)).over(w), F.avg(F.cos(a)).over(w)) for a in angles}
    return df.withColumns(added | {f"{v}_mean": F.avg(v).over(w) for v in values})


def distinct_neighbours(df: DataFrame, value: str, flight: str, *order: str, skip_first: bool = False) -> DataFrame:
    """Rows whose value differs from that of the row before.  skip_first: a flight's first row is as if it weren't there."""
    w = by_time(flight, *order)
    if skip_first:
        df = df.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")
    before = F.lag(value).over(w)
    return df.withColumn("_same", F.col(value).eqNullSafe(before)).where("NOT _same OR _same IS NULL").drop("_same")


def smoothed_on_grid(df: DataFrame, angles: list[str], values: list[str], half: int, seconds: float, time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """smoothed_circle(), of which the rows stay that are first in each `seconds` since the flight's first row."""
    rows = smoothed_circle(df, angles, values, half, flight, time)
    w = by_time(flight, time)
    since = F.col(time) - F.first(time).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_cell", F.floor(since / seconds + 1e-9))
    return rows.withColumn("_new", ~F.col("_cell").eqNullSafe(F.lag("_cell").over(w))).where("_new").drop("_cell", "_new")


def window_of_flight(df: DataFrame, speed: str, least: float, sustain: float, time: str = "timestamp_s", flight: str = "flight_id", *order: str) -> DataFrame:
    """(flight, takeoff, landing): the start of the first run of at least `sustain` seconds at the least speed or more,
    and the last time at it.  Rows without a speed count for neither; what isn't there is null."""
    runs = islands(df.withColumn("_fast", F.col(speed) >= least), "_fast", time, flight, *order)
    long = F.col("_fast") & (F.col("end_s") - F.col("start_s") >= sustain)
    found = runs.groupBy(flight).agg(F.min(F.when(long, F.col("start_s"))).alias("takeoff"), F.max(F.when(F.col("_fast"), F.col("end_s"))).alias("landing"))
    return df.select(flight).distinct().join(found, flight, "left")


def within_window(df: DataFrame, windows: DataFrame, time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """Rows from takeoff to landing, both included; an end that is null is open."""
    rows = df.join(windows.select(flight, "takeoff", "landing"), flight, "left")
    inside = (F.col("takeoff").isNull() | (F.col(time) >= F.col("takeoff"))) & (F.col("landing").isNull() | (F.col(time) <= F.col("landing")))
    return rows.where(inside).drop("takeoff", "landing")
