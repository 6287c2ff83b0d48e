"""Meshes and lines from ordered points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flight as fl
from ..schemas import PHASES
from .ordered import every_seconds

# Colours of the phases in plots, in the order of PHASES.
COLOURS = ("gray", "orange", "red", "blue", "green", "purple", "brown")


def directions(df: DataFrame, order: str, flight: str = "flight_id") -> DataFrame:
    """Adds dir_x, dir_y, dir_z: to the next point, at the end from the one before; east for single points."""
    w = Window.partitionBy(flight).orderBy(order)
    step = {a: F.coalesce(F.lead(f"{a}_m").over(w) - F.col(f"{a}_m"), F.col(f"{a}_m") - F.lag(f"{a}_m").over(w)) for a in "xyz"}
    df = df.withColumns({f"_d{a}": F.coalesce(s, F.lit(0.0)) for a, s in step.items()})
    unit = fl.forward_axis(F.col("_dx"), -F.col("_dy"), F.col("_dz"))
    return df.withColumns({f"dir_{a}": u for a, u in zip("xyz", unit, strict=True)}).drop("_dx", "_dy", "_dz")


def ribbon_vertices(df: DataFrame, order: str, span: float, flight: str = "flight_id") -> DataFrame:
    """Two vertices for each point, half a span to the right and left along the bank: vertex, u, v, position vx, vy, vz, and
    the normal nx, ny, nz, square to the way and to the span (zero if these are one line)."""
    rows = directions(df, order, flight)
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(flight).orderBy(order)) - 1)
    rows = fl.with_banked_axes(rows, F.col("dir_x"), -F.col("dir_y"), F.col("dir_z"), F.col("roll_rad"))
    rows = rows.withColumns(fl.normal([F.col(c) for c in ("fx", "fy", "fz")], [F.col(c) for c in ("rx", "ry", "rz")]))
    side = lambda sign, v: F.struct(F.lit(v).alias("v"), *((F.col(f"{a}_m") + sign * span / 2 * F.col(f"r{a}")).alias(f"v{a}") for a in "xyz"), "nx", "ny", "nz")
    both = F.posexplode(F.array(side(1, 1.0), side(-1, 0.0))).alias("_k", "_s")
    return rows.select(flight, "_i", F.col(order).alias("u"), both).select(flight, (2 * F.col("_i") + F.col("_k")).cast("long").alias("vertex"), "u", "_s.*")


def ribbon_triangles(df: DataFrame, order: str, flight: str = "flight_id") -> DataFrame:
    """Two triangles for each step from a point to the next: (flight, triangle, a, b, c)."""
    n = df.groupBy(flight).agg(F.count("*").alias("n")).where("n > 1")
    steps = n.select(flight, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 2)).alias("i"))
    one = lambda k, *v: F.struct(F.lit(k).alias("k"), *((2 * F.col("i") + x).alias(name) for name, x in zip("abc", v, strict=True)))
    both = F.explode(F.array(one(0, 0, 2, 1), one(1, 1, 2, 3))).alias("t")
    return steps.select(flight, "i", both).select(flight, (2 * F.col("i") + F.col("t.k")).alias("triangle"), "t.a", "t.b", "t.c")


def lines(df: DataFrame, order: str, *coordinates: str, flight: str = "flight_id") -> DataFrame:
    """(flight, coordinates): the points of each flight in order, as one array."""
    points = F.array_sort(F.collect_list(F.struct(order, F.array(*coordinates).alias("c"))))
    return df.groupBy(flight).agg(F.transform(points, lambda p: p["c"]).alias("coordinates"))


def closed_spline(df: DataFrame, order: str, columns: list[str], per_edge: int, by: str = "flight_id") -> DataFrame:
    """(by, order, step, columns): a smooth closed line through the points of each ring, `per_edge` points from each to the next.

    Cubic pieces whose direction in a point is half the way between its neighbours; the last point's next is the first one,
    so the line is smooth there as well.  A last point that repeats the first one is left out; a single point stays put.
    """
    w = Window.partitionBy(by).orderBy(order)
    ring = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = lambda c: F.first(c).over(ring)
    rows = df.select(by, order, *(F.col(c).cast("double").alias(c) for c in columns))
    again = F.lead(F.lit(1)).over(w).isNull() & F.lag(F.lit(1)).over(w).isNotNull()
    for c in columns:
        again &= F.col(c).eqNullSafe(first(c))
    rows = rows.withColumn("_again", again).where("NOT _again")
    after = lambda c: F.coalesce(F.lead(c).over(w), first(c))
    before = lambda c: F.coalesce(F.lag(c).over(w), F.last(c).over(ring))
    rows = rows.withColumns({f"_t_{c}": (after(c) - before(c)) / 2 for c in columns})
    rows = rows.withColumns({f"_n_{c}": after(c) for c in columns} | {f"_u_{c}": after(f"_t_{c}") for c in columns})
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(per_edge - 1)))).withColumn("_x", F.col("step") / per_edge)
    x = F.col("_x")
    at = lambda c: (2 * x - 3) * x * x * (F.col(c) - F.col(f"_n_{c}")) + F.col(c) + ((x - 2) * x + 1) * x * F.col(f"_t_{c}") + (x - 1) * x * x * F.col(f"_u_{c}")
    return rows.select(by, order, "step", *(at(c).alias(c) for c in columns))


def bounds(df: DataFrame, *columns: str, by: str = "flight_id") -> DataFrame:
    """Least, greatest and middle of each column."""
    return df.groupBy(by).agg(*(e for c in columns for e in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), ((F.min(c) + F.max(c)) / 2).alias(f"{c}_mid"))))


def moebius(spark, n: int, radius: float, width: float) -> DataFrame:
    """The points of a strip with half a twist: (i, side, x, y, z)."""
    u = F.col("id") * (6.283185307179586 / n)
    half = F.col("side") * width / 2
    r = radius + half * F.cos(u / 2)
    return spark.range(n + 1).withColumn("side", F.explode(F.array(F.lit(-1.0), F.lit(1.0)))).select(F.col("id").alias("i"), "side", (r * F.cos(u)).alias("x"), (r * F.sin(u)).alias("y"), (half * F.sin(u / 2)).alias("z"))


def phase_lines(df: DataFrame, phase: str, columns: list[str], time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """A line for each flight and phase, as rows (flight, phase, place, columns) in order.

    Where the phase was left and comes again the line breaks: a row of nulls comes between.
    """
    w = Window.partitionBy(flight).orderBy(time)
    mine = Window.partitionBy(flight, phase)
    rows = df.select(flight, phase, time, *columns).withColumn("_new", ~F.col(phase).eqNullSafe(F.lag(phase).over(w)))
    rows = rows.withColumn("_break", F.col("_new") & (F.row_number().over(mine.orderBy(time)) > 1))
    point = F.struct(F.lit(1).alias("_side"), *columns)
    gap = F.struct(F.lit(0).alias("_side"), *(F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns))
    points = F.when(F.col("_break"), F.array(gap, point)).otherwise(F.array(point))
    rows = rows.select(flight, phase, time, F.inline(points))
    return rows.select(flight, phase, F.row_number().over(mine.orderBy(time, "_side")).alias("place"), *columns)


def travel_directions(df: DataFrame, order: str, flight: str = "flight_id") -> DataFrame:
    """Adds dir_x, dir_y, dir_z in engine axes: along vx_ms, vy_ms, vz_ms; for points at rest the bisector of the ways
    from the point before and to the next, at the ends the only way; east where there is none."""
    w = Window.partitionBy(flight).orderBy(order)
    here = {a: -F.col("y_m") if a == "y" else F.col(f"{a}_m") for a in "xyz"}
    df = df.withColumns({f"_to_{a}": F.lead(c).over(w) - c for a, c in here.items()} | {f"_by_{a}": c - F.lag(c).over(w) for a, c in here.items()})
    df = df.withColumns({f"_go_{a}": (-1 if a == "y" else 1) * F.coalesce(F.col(f"v{a}_ms"), F.lit(0.0)) for a in "xyz"})

    def unit(kind: str, a: str) -> Column:
        n = F.sqrt(sum((F.col(f"_{kind}_{b}") ** 2 for b in "xyz"), F.lit(0.0)))
        return F.coalesce(F.when(n > 1e-4, F.col(f"_{kind}_{a}") / n), F.lit(0.0))

    ways = df.withColumns({f"_u{kind}_{a}": unit(kind, a) for kind in ("to", "by") for a in "xyz"} | {f"_ugo_{a}": unit("go", a) for a in "xyz"})
    moving = sum((F.col(f"_ugo_{a}") ** 2 for a in "xyz"), F.lit(0.0)) > 0
    ways = ways.withColumns({f"_d_{a}": F.when(moving, F.col(f"_ugo_{a}")).otherwise(F.col(f"_uto_{a}") + F.col(f"_uby_{a}")) for a in "xyz"})
    n = F.sqrt(sum((F.col(f"_d_{a}") ** 2 for a in "xyz"), F.lit(0.0)))
    found = ways.withColumns({f"dir_{a}": F.when(n > 1e-4, F.col(f"_d_{a}") / F.nullif(n, F.lit(0.0))).otherwise(1.0 if a == "x" else 0.0) for a in "xyz"})
    return found.drop(*(f"_{k}_{a}" for k in ("to", "by", "go", "uto", "uby", "ugo", "d") for a in "xyz"))


def wings(df: DataFrame, span: float, seconds: float, time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """(flight, time, left_x ... right_z): both wing tips every so many seconds: 1 for the envelope, 5 for cross-bars."""
    tips = fl.wing_tips(*(F.col(c) for c in ("x_m", "y_m", "z_m", "yaw_rad", "pitch_rad", "roll_rad")), span)
    return every_seconds(df, seconds, time, flight).select(flight, time, *(c.alias(n) for n, c in tips.items()))


def altitude_plot(df: DataFrame, phase: str = "phase_hmm", z: str = "z_m", time: str = "timestamp_s", flight: str = "flight_id") -> DataFrame:
    """(flight, time, z, phase, colour): the points of an altitude plot; phases without a colour are in the line only."""
    colour = F.try_element_at(F.create_map(*(F.lit(x) for pair in zip(PHASES, COLOURS, strict=True) for x in pair)), F.col(phase))
    return df.select(flight, time, z, phase, colour.alias("colour"))


def material(source: Column) -> Column:
    """The material of a trajectory's source; others have the one for unknown sources."""
    return F.when(source.isin("IGC", "GPX", "GEOJSON"), source).otherwise("UNKNOWN")
