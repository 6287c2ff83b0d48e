"""Registered queries of the telemetry operators, with the same in SQL where SQL can express them.

The event table stands in for telemetry: a user is a flight, the seconds since the user's first event are the time,
value and k are signals.  Gaps between a user's events are hours, so time constants are hours here.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fields, text
from ..functions import flight as fl
from ..operators import cleaning, geometry, ordered, phases, spline
from ..schemas import PHASES, Spec, violations
from ..sources import discovery, gpmf, igc
from . import files, sinks
from . import flight as plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

S = """s AS (SELECT event_id, user_id AS flight_id, CAST(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS DOUBLE) / 1e6 AS t,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"""
TYPES = ("view", "click", "purchase", "signup", "error")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, flight_id, t (seconds), n (position), value, event_type, k."""
    e = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    w = Window.partitionBy("user_id")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    rows = e.select("event_id", F.col("user_id").alias("flight_id"), us.alias("us"), "ts", "user_id", "value", "event_type", k.alias("k"))
    rows = rows.withColumns({"t": (F.col("us") - F.min("us").over(w)).cast("double") / 1e6, "n": F.row_number().over(w.orderBy("ts", "event_id")).cast("long")})
    return rows.select("event_id", "flight_id", "t", "n", "value", "event_type", "k")


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


# Logger files


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.format_string(
        "B%02d%02d%02d%02d%05d%s%03d%05d%s%s%05d%05d",
        *((x).cast("int") for x in ((k * 7 + 3) % 24, (k * 11) % 60, (k * 13) % 60, k % 90, (k * 37) % 60000)), F.when(k % 3 == 0, "S").otherwise("N"),
        (k % 180).cast("int"), ((k * 53) % 60000).cast("int"), F.when(k % 5 == 0, "W").otherwise("E"), F.when(k % 7 == 0, "V").otherwise("A"), ((k * 3) % 5000).cast("int"), ((k * 5) % 6000).cast("int"),
    )
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("flight_id"), k.alias("line_no"), line.alias("line"))


_LINES = """l AS (SELECT o_custkey AS flight_id, o_orderkey AS line_no, o_orderkey AS k, printf('B%02d%02d%02d%02d%05d%s%03d%05d%s%s%05d%05d', (o_orderkey * 7 + 3) % 24, (o_orderkey * 11) % 60, (o_orderkey * 13) % 60,
  o_orderkey % 90, (o_orderkey * 37) % 60000, CASE WHEN o_orderkey % 3 = 0 THEN 'S' ELSE 'N' END, o_orderkey % 180, (o_orderkey * 53) % 60000, CASE WHEN o_orderkey % 5 = 0 THEN 'W' ELSE 'E' END,
  CASE WHEN o_orderkey % 7 = 0 THEN 'V' ELSE 'A' END, (o_orderkey * 3) % 5000, (o_orderkey * 5) % 6000) AS line FROM orders)"""


@query(f"""WITH {_LINES}, f AS (SELECT flight_id, line_no, CAST(substr(line, 2, 2) AS INT) * 3600 + CAST(substr(line, 4, 2) AS INT) * 60 + CAST(substr(line, 6, 2) AS INT) AS tod,
  round((CAST(substr(line, 8, 2) AS INT) + CAST(substr(line, 10, 5) AS INT) / 60000.0::DOUBLE) * CASE WHEN substr(line, 15, 1) = 'S' THEN -1 ELSE 1 END, 6) + 0 AS lat,
  round((CAST(substr(line, 16, 3) AS INT) + CAST(substr(line, 19, 5) AS INT) / 60000.0::DOUBLE) * CASE WHEN substr(line, 24, 1) = 'W' THEN -1 ELSE 1 END, 6) + 0 AS lon,
  CAST(substr(line, 26, 5) AS BIGINT) AS alt_baro_m, CAST(substr(line, 31, 5) AS BIGINT) AS alt_gps_m, substr(line, 25, 1) AS fix_validity FROM l),
 d AS (SELECT *, CASE WHEN tod < lag(tod) OVER (PARTITION BY flight_id ORDER BY line_no) - 3600 THEN 1 ELSE 0 END AS nd FROM f),
 a AS (SELECT *, tod + 86400 * sum(nd) OVER (PARTITION BY flight_id ORDER BY line_no) AS s FROM d)
SELECT flight_id, line_no, tod, lat, lon, alt_baro_m, alt_gps_m, fix_validity, CAST(s - first_value(s) OVER (PARTITION BY flight_id ORDER BY line_no) AS DOUBLE) AS timestamp_s FROM a""")
def igc_fixes(spark, sf_dir):
    f = igc.fixes(_records(spark, sf_dir))
    return f.select("flight_id", "line_no", "tod", r("gps_lat_deg").alias("lat"), r("gps_lon_deg").alias("lon"), "alt_baro_m", "alt_gps_m", "fix_validity", "timestamp_s")


@query("""WITH h AS (SELECT c_nationkey AS flight_id, c_custkey AS line_no, CASE c_custkey % 3 WHEN 0 THEN 'PLT' WHEN 1 THEN 'GTY' ELSE 'GID' END AS code, CASE WHEN c_custkey % 4 = 0 THEN 'NIL' ELSE c_name END AS value FROM customer)
SELECT flight_id, code, CASE WHEN arg_max(value, line_no) = 'NIL' THEN NULL ELSE arg_max(value, line_no) END AS value FROM h GROUP BY 1, 2""")
def igc_headers(spark, sf_dir):
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, "PLT").when(k % 3 == 1, "GTY").otherwise("GID")
    line = F.concat(F.lit("HF"), code, F.lit("NAME: "), F.when(k % 4 == 0, "NIL").otherwise(F.col("c_name")))
    lines = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("flight_id"), k.alias("line_no"), line.alias("line"))
    return igc.headers(lines).select("flight_id", "code", fields.not_nil(F.col("value")).alias("value"))


@query("""SELECT o_orderkey, CAST(make_date(CASE WHEN o_orderkey % 100 < 80 THEN 2000 ELSE 1900 END + o_orderkey % 100, 1 + o_orderkey % 12, 1 + o_orderkey % 28) AS VARCHAR) AS day FROM orders""")
def igc_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    written = F.format_string("%02d%02d%02d,%02d", (1 + k % 28).cast("int"), (1 + k % 12).cast("int"), (k % 100).cast("int"), (k % 9).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", fields.igc_date(written).cast("string").alias("day"))


@query("""SELECT o_orderkey, make_timestamp(2000 + o_orderkey % 60, 1 + o_orderkey % 12, 1 + o_orderkey % 28, o_orderkey % 24, o_orderkey % 60, (o_orderkey % 60) + (o_orderkey % 1000) / 1000.0) AS clock FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 5 = 0""")
def gps_clocks(spark, sf_dir):
    k = F.col("o_orderkey")
    written = F.format_string("%02d%02d%02d%02d%02d%02d.%03d", *(x.cast("int") for x in (k % 60, 1 + k % 12, 1 + k % 28, k % 24, k % 60, k % 60, k % 1000)))
    return table(spark, sf_dir, "orders").select("o_orderkey", fields.gps_clock(F.when(k % 5 == 0, "no clock").otherwise(written)).alias("clock"))


@query("""SELECT c_nationkey AS flight_id, count(*) AS n_rows, CAST(count(*) FILTER (WHERE c_custkey % 4 = 0) AS BIGINT) AS null_pilot, CAST(count(*) FILTER (WHERE c_custkey % 7 = 0) AS BIGINT) AS null_weight, CAST(count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS BIGINT) AS enum_segment,
 CAST(count(*) FILTER (WHERE NOT regexp_matches(c_name, '[0-6]$')) AS BIGINT) AS pattern_tag FROM customer GROUP BY 1""")
def validation_counts(spark, sf_dir):
    k = F.col("c_custkey")
    pilot = fields.not_nil(F.when(k % 4 == 0, "nil").otherwise(F.col("c_name")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("flight_id"), pilot.alias("pilot"), F.when(k % 7 == 0, float("nan")).otherwise(1.0).alias("weight"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("tag"))
    return violations(rows, Spec(required=("pilot", "weight"), enums={"segment": ("BUILDING", "MACHINERY")}, patterns={"tag": "[0-6]$"}), by_flight=True)


# Cleaning


@query(f"""WITH {S}, h AS (SELECT event_id, flight_id, floor(t / 3600) AS hour, max(floor(t / 3600)) OVER (PARTITION BY flight_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
SELECT event_id, flight_id, CAST(hour AS BIGINT) AS hour FROM h WHERE m IS NULL OR hour > m""")
def strict_monotone_filter(spark, sf_dir):
    rows = samples(spark, sf_dir).select("event_id", "flight_id", F.floor(F.col("t") / 3600).alias("hour"))
    return ordered.strictly_increasing(rows, "hour", "event_id")


@query(f"""WITH {S}, d AS (SELECT *, t - lag(t) OVER w AS dt, sqrt((value - lag(value) OVER w) ** 2 + (k - lag(k) OVER w) ** 2) AS way FROM s WINDOW w AS (PARTITION BY flight_id ORDER BY t, event_id)),
 q AS (SELECT *, way / nullif(dt / 3600, 0) / nullif(value / 5, 0) AS ratio FROM d)
SELECT event_id, flight_id FROM q WHERE dt IS NULL OR coalesce(ratio > 0.5 AND ratio < 2 AND dt / 3600 > 0.03, false) OR value / 5 < 7""")
def kinematic_filter(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumns({"h": F.col("t") / 3600, "v": F.col("value") / 5, "y": F.col("k").cast("double")}).withColumn("ord", F.struct("t", "event_id"))
    return ordered.plausible_speed(rows, "value", "y", "h", "v", "ord").select("event_id", "flight_id")


@query(f"""WITH {S} SELECT event_id, CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0.01::DOUBLE END AS weight, round(1.0::DOUBLE / (CASE WHEN k = 0 THEN 0.1::DOUBLE ELSE k / 100.0::DOUBLE END), 6) AS dop_weight FROM s""")
def quality_weights(spark, sf_dir):
    validity = F.when(F.col("event_type") == "view", "A").otherwise("V")
    return samples(spark, sf_dir).select("event_id", fields.quality_weight(validity).alias("weight"), r(fields.dilution_weight(F.col("k") / 100.0)).alias("dop_weight"))


@query(f"""WITH {S}, v AS (SELECT flight_id, n, value, value - lag(value) OVER (PARTITION BY flight_id ORDER BY n) AS rate FROM s),
 m AS (SELECT *, CASE WHEN rate < -30 THEN -1 WHEN rate > 30 THEN 1 END AS mark FROM v),
 g AS (SELECT *, sum(CASE WHEN mark = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY flight_id ORDER BY n) AS rises, min(CASE WHEN mark = 1 THEN n END) OVER (PARTITION BY flight_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS close_n FROM m),
 o AS (SELECT *, min(CASE WHEN mark = -1 THEN n END) OVER (PARTITION BY flight_id, rises ORDER BY n) - 1 AS open_n FROM g)
SELECT o.flight_id, o.n, CASE WHEN o.open_n IS NOT NULL AND o.close_n IS NOT NULL THEN true ELSE false END AS repaired,
 round(CASE WHEN o.open_n IS NOT NULL AND o.close_n IS NOT NULL THEN a.value + CAST(o.n - o.open_n AS DOUBLE) / (o.close_n - o.open_n) * (b.value - a.value) ELSE o.value END, 7) AS value_repaired
FROM o LEFT JOIN s a ON a.flight_id = o.flight_id AND a.n = o.open_n LEFT JOIN s b ON b.flight_id = o.flight_id AND b.n = o.close_n""")
def drop_gap_repair(spark, sf_dir):
    rows = samples(spark, sf_dir).select("flight_id", "n", "value", F.col("n").cast("double").alias("timestamp_s"))
    return cleaning.bridge_drops(rows, "value").select("flight_id", "n", "repaired", r("value_repaired", 7).alias("value_repaired"))


@query(f"""WITH RECURSIVE {S}, a AS (SELECT flight_id, n, CAST(trunc(value) AS BIGINT) AS v, CAST(trunc(value) AS BIGINT) - lag(CAST(trunc(value) AS BIGINT)) OVER (PARTITION BY flight_id ORDER BY n) AS d FROM s),
 g AS (SELECT flight_id, list(v ORDER BY n) AS vals, list_transform(list(v ORDER BY n), lambda x: 1.0::DOUBLE) AS weights, coalesce(list(n ORDER BY n) FILTER (WHERE abs(d) > 30), []) AS evs, coalesce(list(d > 0 ORDER BY n) FILTER (WHERE abs(d) > 30), []) AS up, count(*) AS m FROM a GROUP BY 1),
 q AS (SELECT flight_id, CAST(1 AS BIGINT) AS k, vals, weights, evs, up, m FROM g
  UNION ALL SELECT flight_id, CASE WHEN NOT rising AND closes > 0 THEN k + closes + 1 ELSE k + 1 END,
   CASE WHEN lo IS NULL THEN vals ELSE list_transform(vals, lambda x, i: CASE WHEN i >= lo AND i < hi THEN CAST(trunc(va + (i - since) * (vb - va) / span) AS BIGINT) ELSE x END) END,
   CASE WHEN lo IS NULL THEN weights ELSE list_transform(weights, lambda x, i: CASE WHEN i >= lo AND i < hi THEN 0.01::DOUBLE ELSE x END) END, evs, up, m
  FROM (SELECT *, CASE WHEN rising THEN e - span WHEN closes > 0 THEN e END AS lo, CASE WHEN rising THEN e ELSE evs[k + closes] END AS hi, CASE WHEN rising THEN e - span ELSE e - 1 END AS since, vals[e - 1] AS va, vals[CASE WHEN rising THEN e ELSE evs[k + closes] END] AS vb
   FROM (SELECT *, CASE WHEN rising THEN greatest(1.0::DOUBLE, (vals[e] - vals[e - 1]) / 10.0::DOUBLE) ELSE evs[k + closes] - (e - 1) END AS span
    FROM (SELECT *, evs[k] AS e, up[k] AS rising, coalesce(list_position(up[k + 1:], true), 0) AS closes FROM q WHERE k <= len(evs) AND m >= 3) x) y) z),
 l AS (SELECT flight_id, arg_max(vals, k) AS vals, arg_max(weights, k) AS weights FROM q GROUP BY 1)
SELECT flight_id, CAST(i AS DOUBLE) AS timestamp_s, vals[i] AS alt_gps_m, weights[i] AS weight FROM (SELECT *, unnest(range(1, len(vals) + 1)) AS i FROM l)""")
def altitude_repair(spark, sf_dir):
    rows = samples(spark, sf_dir).select("flight_id", F.col("n").cast("double").alias("timestamp_s"), F.col("value").cast("long").alias("alt_gps_m"), F.lit(1.0).alias("weight"))
    return cleaning.repair_altitude(rows)


@query(f"""WITH {S}, c AS (SELECT flight_id, event_id, floor(t / 3600) AS hour, max(floor(t / 3600)) OVER (PARTITION BY flight_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)
SELECT flight_id, count(*) AS n_rows, CAST(count(*) FILTER (WHERE m IS NOT NULL AND hour <= m) AS BIGINT) AS dropped FROM c GROUP BY 1""")
def dropped_rows(spark, sf_dir):
    rows = samples(spark, sf_dir).select("event_id", "flight_id", F.floor(F.col("t") / 3600).alias("hour"))
    return cleaning.dropped_report(rows, "hour", "event_id")


@query(f"""WITH RECURSIVE {S}, f AS (SELECT flight_id, n, n AS kept_n, value AS last, true AS good FROM s WHERE n = 1
 UNION ALL SELECT s.flight_id, s.n, CASE WHEN abs(s.value - f.last) <= 40 * (s.n - f.kept_n) THEN s.n ELSE f.kept_n END, CASE WHEN abs(s.value - f.last) <= 40 * (s.n - f.kept_n) THEN s.value ELSE f.last END, abs(s.value - f.last) <= 40 * (s.n - f.kept_n)
 FROM f JOIN s ON s.flight_id = f.flight_id AND s.n = f.n + 1) SELECT s.flight_id, s.n, s.value FROM s JOIN f ON f.flight_id = s.flight_id AND f.n = s.n WHERE f.good""")
def spike_filter(spark, sf_dir):
    rows = samples(spark, sf_dir).select("flight_id", "n", "value", F.col("n").cast("double").alias("timestamp_s"))
    return cleaning.without_spikes(rows, "value", 40.0).select("flight_id", "n", "value")


@query(f"WITH {S} SELECT event_id FROM s WHERE (event_type = 'error' OR k <= 5) AND value BETWEEN -90 AND 90")
def quality_bounds_filter(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumns({"hdop": F.when(F.col("event_type") != "error", F.col("k")), "longitude": F.lit(0.0)})
    return cleaning.within_bounds(cleaning.precise_enough(rows, "hdop"), "value", "longitude", None).select("event_id")


@query(f"""WITH {S}, d AS (SELECT *, floor(t / 86400) AS day, row_number() OVER (PARTITION BY flight_id, floor(t / 86400) ORDER BY n) AS i FROM s) SELECT event_id, CAST(day AS BIGINT) AS day FROM d WHERE i = 1""")
def duplicate_times(spark, sf_dir):
    return cleaning.one_each_time(samples(spark, sf_dir).withColumn("day", F.floor(F.col("t") / 86400)), "day", "n").select("event_id", "day")


@query(f"""WITH {S}, q AS (SELECT event_id, flight_id, n, t, CASE WHEN event_type <> 'view' THEN value END AS v, radians(value / 10) AS la, radians(CAST(k AS DOUBLE)) AS lo, radians(lag(value / 10) OVER w) AS la0, radians(lag(CAST(k AS DOUBLE)) OVER w) AS lo0, t - lag(t) OVER w AS dt FROM s WINDOW w AS (PARTITION BY flight_id ORDER BY n))
SELECT event_id, round(coalesce(v, 12742000.0::DOUBLE * asin(sqrt(least(1, power(sin((la - la0) / 2), 2) + cos(la0) * cos(la) * power(sin((lo - lo0) / 2), 2)))) / nullif(dt, 0)), 3) AS speed FROM q""")
def ground_speeds(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumns({"speed": F.when(F.col("event_type") != "view", F.col("value")), "lat": F.col("value") / 10, "lon": F.col("k").cast("double"), "at": F.struct("t", "n")})
    return cleaning.with_ground_speed(rows, "lat", "lon", "speed", "t").select("event_id", r("speed", 3).alias("speed"))


@query(f"""WITH {S}, o AS (SELECT *, coalesce(event_type = 'view' AND k < 15, false) AS kept FROM s), c AS (SELECT *, CASE WHEN NOT kept AND coalesce(lag(kept) OVER (PARTITION BY flight_id ORDER BY n), true) THEN 1 ELSE 0 END AS c FROM o),
 b AS (SELECT *, sum(c) OVER (PARTITION BY flight_id ORDER BY n) AS run FROM c), g AS (SELECT flight_id, run, count(*) AS m, count(*) FILTER (WHERE value < 7) AS slow, min(t) AS a, max(t) AS z FROM b WHERE NOT kept GROUP BY 1, 2),
 d AS (SELECT flight_id, CAST(sum(m) AS BIGINT) AS dropped, CAST(sum(slow) AS BIGINT) AS ground, CAST(sum(m - slow) AS BIGINT) AS in_flight, CAST(count(*) FILTER (WHERE z - a <= 86400) AS BIGINT) AS jitter, CAST(count(*) FILTER (WHERE z - a > 86400) AS BIGINT) AS n_gaps, round(coalesce(sum(z - a) FILTER (WHERE z - a > 86400), 0), 3) AS gap_s FROM g GROUP BY 1)
SELECT f.flight_id, n_rows, coalesce(dropped, 0) AS dropped, coalesce(ground, 0) AS ground, coalesce(in_flight, 0) AS in_flight, coalesce(jitter, 0) AS jitter, coalesce(n_gaps, 0) AS n_gaps, coalesce(gap_s, 0) AS gap_s
FROM (SELECT flight_id, count(*) AS n_rows FROM s GROUP BY 1) f LEFT JOIN d ON f.flight_id = d.flight_id""")
def dropped_ranges(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("kept", (F.col("event_type") == "view") & (F.col("k") < 15))
    found = cleaning.dropped_ranges(rows, "kept", "value", "t", "n", gap=86400.0)
    seconds = F.aggregate("gaps", F.lit(0.0), lambda a, g: a + (g["end_s"] - g["start_s"]))
    return found.select("flight_id", "n_rows", "dropped", "ground", "in_flight", "jitter", F.size("gaps").cast("long").alias("n_gaps"), r(seconds, 3).alias("gap_s"))


# Lookups and matching


@query("""SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def registry_join(spark, sf_dir):
    c, n, g = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    rows = discovery.with_registry(c.withColumnRenamed("c_nationkey", "n_nationkey"), n, "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    return discovery.with_registry(rows, g, "r_regionkey").select("c_custkey", "n_name", "r_name")


def _paths(spark, sf_dir) -> DataFrame:
    """Paths of a made-up archive with a log for each customer and videos and tables for some."""
    k = F.col("c_custkey")
    tag = F.concat(F.lit("/archive/"), F.col("c_nationkey").cast("string"), F.lit("/f"), k.cast("string"))
    names = F.array(F.concat(tag, F.lit("_note.yaml")), F.concat(tag, F.lit(".igc")), F.when(k % 3 == 0, F.concat(tag, F.lit(".mp4"))), F.when(k % 2 == 0, F.concat(tag, F.lit(".MP4"))), F.concat(tag, F.lit("_glider_"), (k % 7).cast("string"), F.lit(".csv")))
    return table(spark, sf_dir, "customer").select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("path"))


@query("""SELECT 'f' || c_custkey AS flight_uid, '/archive/' || c_nationkey || '/f' || c_custkey || '_note.yaml' AS record_path FROM customer""")
def flight_records(spark, sf_dir):
    return discovery.flight_records(_paths(spark, sf_dir), table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("flight_uid")))


@query("""WITH c AS (SELECT 'f' || c_custkey AS flight_tag, '/archive/' || c_nationkey || '/f' || c_custkey AS base, c_custkey AS k FROM customer)
SELECT flight_tag, CASE WHEN k % 3 = 0 THEN base || '.mp4' WHEN k % 2 = 0 THEN base || '.MP4' END AS video_path, base || '.igc' AS log_path FROM c""")
def flight_media(spark, sf_dir):
    return discovery.flight_media(_paths(spark, sf_dir), table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("flight_tag")))


@query("SELECT 'f' || c_custkey AS sequence, 'glider_' || (c_custkey % 7) AS actor FROM customer")
def sequence_actors(spark, sf_dir):
    return discovery.sequence_actors(_paths(spark, sf_dir), table(spark, sf_dir, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("sequence")))


_CODES = ("W", "S", "L", "N", "M", "X", "LH", "Q")


@query("""WITH p AS (SELECT p_partkey, list_extract(['W', 'S', 'L', 'N', 'M', 'X', 'LH', 'Q'], CAST(p_partkey % 8 + 1 AS INT)) AS code, CASE WHEN p_partkey % 10 = 0 THEN 'mlns' ELSE 'GPRO' END AS lens, list_extract([720, 1080, 1440, 2160, 999], CAST(p_partkey % 5 + 1 AS INT)) AS height FROM part)
SELECT p_partkey, CASE WHEN lens = 'mlns' THEN 'Max Lens Mod' ELSE CASE code WHEN 'W' THEN 'Wide' WHEN 'S' THEN 'SuperView' WHEN 'L' THEN 'Linear' WHEN 'N' THEN 'Narrow' WHEN 'M' THEN 'Max SuperView' WHEN 'X' THEN 'HyperView' WHEN 'LH' THEN 'Linear + Horizon Lock' ELSE code END END AS view,
 CASE height WHEN 720 THEN '720p' WHEN 1080 THEN '1080p' WHEN 1440 THEN '1440p' WHEN 2160 THEN '4K' ELSE '999p' END || '60' AS resolution FROM p""")
def camera_labels(spark, sf_dir):
    k = F.col("p_partkey")
    code = F.get(F.array(*map(F.lit, _CODES)), (k % 8).cast("int"))
    size = F.concat(F.lit("100x"), F.get(F.array(*map(F.lit, (720, 1080, 1440, 2160, 999))), (k % 5).cast("int")).cast("string"))
    lens = F.when(k % 10 == 0, "mlns").otherwise("GPRO")
    return table(spark, sf_dir, "part").select("p_partkey", text.view_text(code, lens).alias("view"), text.resolution_text(size, F.lit(59.94)).alias("resolution"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 4 = 1 THEN 'Stab Off' WHEN p_partkey % 4 = 0 THEN 'HyperSmooth High' WHEN p_partkey % 4 = 2 THEN 'custom' ELSE 'EIS On' END AS stabilisation FROM part""")
def stabilisation_labels(spark, sf_dir):
    k = F.col("p_partkey")
    method = F.when(k % 4 == 0, "HS High").when(k % 4 == 1, "hs off").when(k % 4 == 2, "custom")
    return table(spark, sf_dir, "part").select("p_partkey", text.stabilisation_text(k % 3 != 0, method).alias("stabilisation"))


def _two(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    s = samples(spark, sf_dir)
    return s.where("event_type = 'click'").select("event_id", "flight_id", "t"), s.where("event_type = 'view'").select("flight_id", "t", F.col("value").alias("seen"))


_NEAR = f"""WITH {S}, c AS (SELECT event_id, flight_id, t FROM s WHERE event_type = 'click'), v AS (SELECT flight_id, t, value FROM s WHERE event_type = 'view'),
 b AS (SELECT c.*, v.t AS bt, v.value AS bv FROM c ASOF LEFT JOIN v ON c.flight_id = v.flight_id AND c.t >= v.t), a AS (SELECT b.*, v.t AS aft, v.value AS av FROM b ASOF LEFT JOIN v ON b.flight_id = v.flight_id AND b.t <= v.t)"""


@query(_NEAR + " SELECT event_id, CASE WHEN aft IS NULL OR (bt IS NOT NULL AND t - bt < aft - t) THEN bv ELSE av END AS seen, round(CASE WHEN aft IS NULL OR (bt IS NOT NULL AND t - bt < aft - t) THEN bt ELSE aft END, 3) AS matched_t FROM a")
def nearest_tie_late(spark, sf_dir):
    left, right = _two(spark, sf_dir)
    return ordered.nearest(left, right, "t", ["seen"]).select("event_id", "seen", r("matched_t", 3).alias("matched_t"))


@query(_NEAR + " SELECT event_id, CASE WHEN aft IS NULL OR (bt IS NOT NULL AND t - bt <= aft - t) THEN bv ELSE av END AS seen FROM a")
def nearest_tie_early(spark, sf_dir):
    left, right = _two(spark, sf_dir)
    return ordered.nearest(left, right, "t", ["seen"], later=False).select("event_id", "seen")


@query(_NEAR + " SELECT event_id, round(bt, 3) AS before_t, round(aft, 3) AS after_t FROM a")
def bracket_lookup(spark, sf_dir):
    left, right = _two(spark, sf_dir)
    return ordered.brackets(left, right, "t", ["seen"]).select("event_id", r("before.t", 3).alias("before_t"), r("after.t", 3).alias("after_t"))


@query(_NEAR + " SELECT event_id, round(CASE WHEN bv IS NULL THEN av WHEN av IS NULL THEN bv ELSE bv + coalesce((t - bt) / nullif(aft - bt, 0), 0) * (av - bv) END, 5) AS seen FROM a")
def bracket_lerp(spark, sf_dir):
    left, right = _two(spark, sf_dir)
    return ordered.interpolate(left, right, "t", ["seen"]).select("event_id", r("seen", 5).alias("seen"))


@query(f"""WITH {S}, c AS (SELECT event_id, flight_id, row_number() OVER (PARTITION BY flight_id ORDER BY t) AS i, count(*) OVER (PARTITION BY flight_id) AS m FROM s WHERE event_type = 'click'),
 v AS (SELECT flight_id, value AS seen, row_number() OVER (PARTITION BY flight_id ORDER BY t) AS i, count(*) OVER (PARTITION BY flight_id) AS m FROM s WHERE event_type = 'view') SELECT c.event_id, v.seen FROM c JOIN v USING (flight_id, i, m)""")
def positional_align(spark, sf_dir):
    left, right = _two(spark, sf_dir)
    return ordered.align_by_position(left, right, "t", ["seen"]).select("event_id", "seen")


@query(f"""WITH {S}, v AS (SELECT * FROM s WHERE event_type = 'view' AND flight_id % 3 = 0), c AS (SELECT * FROM s WHERE event_type = 'click')
SELECT event_id, flight_id, 'preferred' AS source FROM v UNION ALL SELECT event_id, flight_id, 'fallback' FROM c WHERE flight_id NOT IN (SELECT flight_id FROM v)""")
def source_fallback(spark, sf_dir):
    from ..sources.frames import pick_source

    s = samples(spark, sf_dir)
    found = pick_source(s.where("event_type = 'view' AND flight_id % 3 = 0"), s.where("event_type = 'click'"))
    return found.select("event_id", "flight_id", "source")


# Windows


def _positions(spark, sf_dir) -> DataFrame:
    s = samples(spark, sf_dir)
    w = Window.partitionBy("flight_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumns({"timestamp_s": F.col("t") / 3600, "x_m": F.sum(F.col("value").cast("decimal(18,2)")).over(w).cast("double"), "y_m": F.sum("k").over(w).cast("double"), "z_m": F.col("value")})


_P = f"""{S}, p AS (SELECT event_id, flight_id, n, value, k, event_type, t / 3600 AS ts, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS x, CAST(sum(k) OVER w AS DOUBLE) AS y, value AS z FROM s WINDOW w AS (PARTITION BY flight_id ORDER BY n))"""


@query(f"""WITH {_P}, q AS (SELECT event_id, x, y, ts, coalesce(last_value(x) OVER b, first_value(x) OVER f) AS xb, coalesce(first_value(x) OVER a, last_value(x) OVER f) AS xf, coalesce(last_value(y) OVER b, first_value(y) OVER f) AS yb, coalesce(first_value(y) OVER a, last_value(y) OVER f) AS yf,
 coalesce(last_value(ts) OVER b, first_value(ts) OVER f) AS tb, coalesce(first_value(ts) OVER a, last_value(ts) OVER f) AS tf FROM p WINDOW f AS (PARTITION BY flight_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
 b AS (PARTITION BY flight_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 12 PRECEDING), a AS (PARTITION BY flight_id ORDER BY ts RANGE BETWEEN 12 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT event_id, round(sqrt((xf - xb) ** 2 + (yf - yb) ** 2) / greatest(tf - tb, 1e-6), 4) AS speed FROM q""")
def central_diff_outer(spark, sf_dir):
    d = ordered.central_difference(_positions(spark, sf_dir), ["x_m", "y_m"], "timestamp_s", 12.0)
    return d.select("event_id", r(F.sqrt(F.col("d_x_m") ** 2 + F.col("d_y_m") ** 2) / F.col("d_t"), 4).alias("speed"))


@query(f"""WITH {_P}, q AS (SELECT event_id, last_value(z) OVER i - first_value(z) OVER i AS dz, last_value(ts) OVER i - first_value(ts) OVER i AS dt FROM p WINDOW i AS (PARTITION BY flight_id ORDER BY ts RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING))
SELECT event_id, round(dz / greatest(dt, 1e-6), 4) AS climb FROM q""")
def central_diff_inner(spark, sf_dir):
    d = ordered.central_difference(_positions(spark, sf_dir), ["z_m"], "timestamp_s", 12.0, inside=True)
    return d.select("event_id", r(F.col("d_z_m") / F.col("d_t"), 4).alias("climb"))


_U = f"""{S}, h AS (SELECT event_id, flight_id, n, t / 3600 AS ts, value - 2 * pi() * floor(value / (2 * pi())) AS h FROM s), d AS (SELECT *, h - lag(h) OVER w AS dl FROM h WINDOW w AS (PARTITION BY flight_id ORDER BY n)),
 e AS (SELECT *, (dl + pi()) - 2 * pi() * floor((dl + pi()) / (2 * pi())) - pi() AS m FROM d), u AS (SELECT *, sum(coalesce(CASE WHEN m = -pi() AND dl > 0 THEN pi() ELSE m END, h)) OVER (PARTITION BY flight_id ORDER BY n) AS u FROM e)"""


@query(f"WITH {_U} SELECT event_id, round(u, 5) AS unwrapped FROM u")
def angle_unwrap(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("h", F.pmod("value", 2 * F.pi()))
    return ordered.unwrap(rows, "h", "u", "flight_id", "n").select("event_id", r("u", 5).alias("unwrapped"))


@query(f"""WITH {_U}, q AS (SELECT event_id, last_value(u) OVER i - first_value(u) OVER i AS du, last_value(ts) OVER i - first_value(ts) OVER i AS dt FROM u WINDOW i AS (PARTITION BY flight_id ORDER BY ts RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING))
SELECT event_id, round(degrees(du / greatest(dt, 1e-6)), 4) AS turn FROM q""")
def turn_rate(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumns({"h": F.pmod("value", 2 * F.pi()), "timestamp_s": F.col("t") / 3600})
    d = ordered.central_difference(ordered.unwrap(rows, "h", "u", "flight_id", "n"), ["u"], "timestamp_s", 12.0, inside=True)
    return d.select("event_id", r(F.degrees(F.col("d_u") / F.col("d_t")), 4).alias("turn"))


@query(f"WITH {S} SELECT event_id, round(median(value) OVER (PARTITION BY flight_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM s")
def rolling_median(spark, sf_dir):
    return ordered.rolling_median(samples(spark, sf_dir), "value", "m", 2, "flight_id", "n").select("event_id", r("m").alias("smooth"))


@query(f"WITH {S}, d AS (SELECT flight_id, t - lag(t) OVER (PARTITION BY flight_id ORDER BY t) AS dt FROM s) SELECT flight_id, round(CASE WHEN median(dt) < 1e-6 THEN 1.0 ELSE coalesce(median(dt), 1.0) END, 4) AS median_dt FROM d GROUP BY 1")
def median_interval(spark, sf_dir):
    return ordered.median_interval(samples(spark, sf_dir), "t").select("flight_id", r("median_dt", 4).alias("median_dt"))


@query(f"WITH {S} SELECT event_id, round(coalesce((value - lag(value) OVER w) / greatest((t - lag(t) OVER w) / 3600, 1.0), 0), 5) AS rate FROM s WINDOW w AS (PARTITION BY flight_id ORDER BY n)")
def step_rates(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("h", F.col("t") / 3600)
    return rows.select("event_id", r(ordered.step_rate("value", "h", Window.partitionBy("flight_id").orderBy("n")), 5).alias("rate"))


_B = f"""{S}, c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY flight_id ORDER BY n) THEN 1 ELSE 0 END AS c FROM s), b AS (SELECT *, sum(c) OVER (PARTITION BY flight_id ORDER BY n) AS block FROM c),
 i AS (SELECT flight_id, CAST(block AS BIGINT) AS block, min(event_type) AS event_type, min(t) AS start_s, max(t) AS end_s, count(*) AS n_rows FROM b GROUP BY flight_id, block)"""


@query(f"WITH {_B} SELECT flight_id, block, event_type, round(start_s, 3) AS start_s, round(end_s, 3) AS end_s, n_rows FROM i")
def phase_blocks(spark, sf_dir):
    return ordered.islands(samples(spark, sf_dir), "event_type", "t", "flight_id", "n").select("flight_id", "block", "event_type", r("start_s", 3).alias("start_s"), r("end_s", 3).alias("end_s"), "n_rows")


@query(f"WITH {S}, l AS (SELECT flight_id, round(t, 3) AS t, lag(event_type) OVER (PARTITION BY flight_id ORDER BY n) AS from_value, event_type AS to_value FROM s) SELECT * FROM l WHERE from_value <> to_value")
def phase_transitions(spark, sf_dir):
    return ordered.transitions(samples(spark, sf_dir), "event_type", "t", "flight_id", "n").withColumn("t", r("t", 3))


_SRT = "CASE WHEN {0} IS NULL THEN '' ELSE printf('%02d:%02d:%02d,%03d', CAST(floor(floor({0}) / 3600) AS BIGINT), CAST(floor({0}) AS BIGINT) % 3600 // 60, CAST(floor({0}) AS BIGINT) % 60, CAST(round_even(({0} - floor({0})) * 1000, 0) AS BIGINT)) END"


@query(f"""WITH {_B} SELECT flight_id, string_agg(block || chr(10) || {_SRT.format('start_s')} || ' --> ' || {_SRT.format('end_s')} || chr(10) || event_type || ' until ' || {_SRT.format('end_s')} || chr(10) || chr(10), '' ORDER BY block) AS srt FROM i GROUP BY flight_id""")
def srt_text(spark, sf_dir):
    return sinks.subtitles(samples(spark, sf_dir), "event_type", "t")


@query(f"WITH {S} SELECT flight_id, event_type, count(*) AS n_rows, round(max(t) - min(t), 3) AS span_s FROM s GROUP BY 1, 2")
def phase_summary(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("flight_id", "event_type").agg(F.count("*").alias("n_rows"), r(F.max("t") - F.min("t"), 3).alias("span_s"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 1")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type")


@query(f"WITH {S} SELECT flight_id, min(value) AS value_min, max(value) AS value_max, round((min(value) + max(value)) / 2, 4) AS value_mid, min(k) AS k_min, max(k) AS k_max, (min(k) + max(k)) / 2.0::DOUBLE AS k_mid FROM s GROUP BY 1")
def bounding_box(spark, sf_dir):
    return geometry.bounds(samples(spark, sf_dir), "value", "k").withColumn("value_mid", r("value_mid", 4))


@query(f"WITH {S} SELECT flight_id, count(*) AS n_points, round(max(t) - min(t), 3) AS duration_s, count(*) FILTER (WHERE value < 5) AS low FROM s GROUP BY 1")
def anomaly_counts(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("flight_id").agg(F.count("*").alias("n_points"), r(F.max("t") - F.min("t"), 3).alias("duration_s"), F.count_if(F.col("value") < 5).alias("low"))


@query(f"WITH {S}, g AS (SELECT flight_id, lag(t) OVER (PARTITION BY flight_id ORDER BY t) AS a, t AS b FROM s) SELECT flight_id, round(a, 3) AS gap_start, round(b, 3) AS gap_end FROM g WHERE b - a > 86400")
def gap_report(spark, sf_dir):
    return ordered.gaps(samples(spark, sf_dir), 86400.0, "t").select("flight_id", r("gap_start", 3).alias("gap_start"), r("gap_end", 3).alias("gap_end"))


@query(f"""WITH {S}, c AS (SELECT *, CASE WHEN (value >= 20) IS DISTINCT FROM lag(value >= 20) OVER (PARTITION BY flight_id ORDER BY n) THEN 1 ELSE 0 END AS c FROM s), b AS (SELECT *, sum(c) OVER (PARTITION BY flight_id ORDER BY n) AS block FROM c),
 i AS (SELECT flight_id, block, bool_and(value >= 20) AS fast, min(t) AS a, max(t) AS z FROM b GROUP BY 1, 2), f AS (SELECT flight_id, min(a) FILTER (WHERE fast AND z - a >= 43200) AS takeoff, max(z) FILTER (WHERE fast) AS landing FROM i GROUP BY 1)
SELECT flight_id, round(takeoff, 3) AS takeoff, round(landing, 3) AS landing FROM f""")
def flight_window(spark, sf_dir):
    found = ordered.window_of_flight(samples(spark, sf_dir), "value", 20.0, 43200.0, "t", "flight_id", "n")
    return found.select("flight_id", r("takeoff", 3).alias("takeoff"), r("landing", 3).alias("landing"))


@query(SQL["flight_window"].rsplit("SELECT", 1)[0] + "SELECT s.event_id FROM s JOIN f ON s.flight_id = f.flight_id WHERE (takeoff IS NULL OR t >= takeoff) AND (landing IS NULL OR t <= landing)")
def window_prune(spark, sf_dir):
    s = samples(spark, sf_dir)
    return ordered.within_window(s, ordered.window_of_flight(s, "value", 20.0, 43200.0, "t", "flight_id", "n"), "t").select("event_id")


# Resampling


@query(f"""WITH {S}, g AS (SELECT flight_id, max(t) AS b FROM s GROUP BY 1) SELECT flight_id, i AS grid_i, i * 86400.0::DOUBLE AS t FROM (SELECT flight_id, unnest(range(CAST(ceil(b / 86400.0) AS BIGINT))) AS i FROM g)""")
def resample_grid(spark, sf_dir):
    return ordered.grid(samples(spark, sf_dir), 86400.0, "t")


@query(f"""WITH {S}, g AS (SELECT flight_id, max(t) AS b FROM s GROUP BY 1), q AS (SELECT flight_id, i, i * 86400.0::DOUBLE AS t FROM (SELECT flight_id, unnest(range(CAST(ceil(b / 86400.0) AS BIGINT))) AS i FROM g)),
 b AS (SELECT q.*, s.t AS bt, s.value AS bv FROM q ASOF LEFT JOIN s ON q.flight_id = s.flight_id AND q.t >= s.t), a AS (SELECT b.*, s.t AS aft, s.value AS av FROM b ASOF LEFT JOIN s ON b.flight_id = s.flight_id AND b.t <= s.t)
SELECT flight_id, i AS grid_i, round(bv + coalesce((t - bt) / nullif(aft - bt, 0), 0) * (av - bv), 5) AS value FROM a""")
def resample_lerp(spark, sf_dir):
    s = samples(spark, sf_dir).select("flight_id", "t", "value")
    return ordered.interpolate(ordered.grid(s, 86400.0, "t"), s, "t", ["value"]).select("flight_id", "grid_i", r("value", 5).alias("value"))


@query(f"WITH {S} SELECT event_id FROM s WHERE (n - 1) % 7 = 0")
def stride_sample(spark, sf_dir):
    return ordered.every_nth(samples(spark, sf_dir), 7, "n").select("event_id")


@query(f"WITH {S}, q AS (SELECT event_id, n - 1 AS i, greatest(1, count(*) OVER (PARTITION BY flight_id) // 20) AS skip FROM s) SELECT event_id FROM q WHERE i % skip = 0 AND i < skip * 20")
def stride_cap(spark, sf_dir):
    return ordered.stride_cap(samples(spark, sf_dir), 20, "n").select("event_id")


_STEP = f"""{S}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY flight_id ORDER BY t) AS dt FROM s), g AS (SELECT flight_id, greatest(1, coalesce(CAST(round_even(400000 / nullif(median(dt) FILTER (WHERE n <= 1000), 0), 0) AS BIGINT), 1)) AS step FROM d GROUP BY 1),
 e AS (SELECT s.* FROM s JOIN g ON s.flight_id = g.flight_id WHERE (n - 1) % step = 0)"""


@query(f"""WITH {_STEP}, q AS (SELECT *, value / 50 AS yaw, k / 100.0::DOUBLE AS pitch, value / 100 AS roll FROM e),
 b AS (SELECT *, cos(yaw) * sin(pitch) * sin(roll) - sin(yaw) * cos(roll) AS bx, sin(yaw) * sin(pitch) * sin(roll) + cos(yaw) * cos(roll) AS byy, cos(pitch) * sin(roll) AS bz FROM q)
SELECT flight_id, round(t, 3) AS t, round(value + 7.5 * bx, 4) AS left_x, round(k + 7.5 * byy, 4) AS left_y, round(value + 7.5 * bz, 4) AS left_z, round(value - 7.5 * bx, 4) AS right_x, round(k - 7.5 * byy, 4) AS right_y, round(value - 7.5 * bz, 4) AS right_z FROM b""")
def wing_envelope(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumns({"x_m": F.col("value"), "y_m": F.col("k").cast("double"), "z_m": F.col("value"), "yaw_rad": F.col("value") / 50, "pitch_rad": F.col("k") / 100.0, "roll_rad": F.col("value") / 100})
    found = geometry.wings(rows, 15.0, 400000.0, "t")
    return found.select("flight_id", r("t", 3).alias("t"), *(r(f"{s}_{a}", 4).alias(f"{s}_{a}") for s in ("left", "right") for a in "xyz"))


@query(f"""WITH {S}, m AS (SELECT *, avg(value) OVER w AS vm, atan2(avg(sin(value)) OVER w, avg(cos(value)) OVER w) AS am, floor(t / 400000 + 1e-9) AS cell FROM s WINDOW w AS (PARTITION BY flight_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 c AS (SELECT *, lag(cell) OVER (PARTITION BY flight_id ORDER BY t) AS before FROM m) SELECT event_id, round(vm, 5) AS value_mean, round(cos(am), 4) AS cos_mean FROM c WHERE before IS NULL OR cell <> before""")
def smoothed_grid(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("angle", F.col("value"))
    return ordered.smoothed_on_grid(rows, ["angle"], ["value"], 3, 400000.0, "t").select("event_id", r("value_mean", 5).alias("value_mean"), r(F.cos("angle_mean"), 4).alias("cos_mean"))


_SPEEDUP = f"""{S}, q AS (SELECT *, (t - lag(t) OVER w) / nullif(CAST(k - lag(k) OVER w AS DOUBLE), 0) AS raw FROM s WINDOW w AS (PARTITION BY flight_id ORDER BY n)),
 f AS (SELECT *, first_value(raw IGNORE NULLS) OVER (PARTITION BY flight_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sp FROM q)"""


@query(f"WITH {_SPEEDUP} SELECT event_id, round(sp, 4) AS speedup_raw FROM f")
def speedup_backfill(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("v", F.col("k").cast("double"))
    return ordered.speedup(rows, "t", "v", "flight_id", "n").select("event_id", r("speedup_raw", 4).alias("speedup_raw"))


@query(f"WITH {_SPEEDUP} SELECT event_id, round(sp, 4) AS speedup_raw FROM f WHERE n <= 5")
def limit_after_backfill(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("v", F.col("k").cast("double"))
    return ordered.speedup(rows, "t", "v", "flight_id", "n").where("n <= 5").select("event_id", r("speedup_raw", 4).alias("speedup_raw"))


@query(f"WITH {S}, q AS (SELECT *, k // 10 AS frame, lag(k // 10) OVER (PARTITION BY flight_id ORDER BY n) AS before FROM s) SELECT event_id, CAST(frame AS BIGINT) AS frame FROM q WHERE frame IS DISTINCT FROM before")
def frame_dedup(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("frame", F.floor(F.col("k") / 10))
    return ordered.distinct_neighbours(rows, "frame", "flight_id", "n").select("event_id", "frame")


@query(f"WITH {S}, q AS (SELECT event_id, CAST(k // 10 AS BIGINT) AS frame, lag(k // 10) OVER (PARTITION BY flight_id ORDER BY n) AS before FROM s WHERE n > 1) SELECT event_id, frame FROM q WHERE frame IS DISTINCT FROM before")
def frame_export(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("frame", F.floor(F.col("k") / 10))
    return ordered.distinct_neighbours(rows, "frame", "flight_id", "n", skip_first=True).select("event_id", "frame")


@query(f"""WITH {S}, v AS (SELECT * FROM s WHERE event_type = 'view'), c AS (SELECT event_id, flight_id, t FROM s WHERE event_type = 'click'), b AS (SELECT c.*, v.t AS bt, v.value AS bv FROM c ASOF LEFT JOIN v ON c.flight_id = v.flight_id AND c.t > v.t),
 a AS (SELECT b.*, v.t AS aft, v.value AS av FROM b ASOF LEFT JOIN v ON b.flight_id = v.flight_id AND b.t <= v.t)
SELECT event_id, round(CASE WHEN bt IS NULL THEN av WHEN aft IS NULL THEN bv ELSE bv + (t - bt) / greatest(aft - bt, 1e-4) * (av - bv) END, 5) AS value FROM a""")
def playback_lerp(spark, sf_dir):
    left, right = _two(spark, sf_dir)
    return ordered.played(left, right, "t", ["seen"]).select("event_id", r(F.col("seen"), 5).alias("value"))


@query(f"""WITH {S} SELECT event_id, round(atan2(avg(sin(value)) OVER w, avg(cos(value)) OVER w), 4) AS value_mean, round(avg(k) OVER w, 4) AS k_mean FROM s WINDOW w AS (PARTITION BY flight_id ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def circular_mean(spark, sf_dir):
    return ordered.smoothed_circle(samples(spark, sf_dir), ["value"], ["k"], 3, "flight_id", "n").select("event_id", r("value_mean", 4).alias("value_mean"), r("k_mean", 4).alias("k_mean"))


# Phases


def _features(spark, sf_dir) -> DataFrame:
    return samples(spark, sf_dir).withColumns({"h": F.col("t") / 36000, "v": F.col("value") / 3, "vz": (F.col("k") - 50) / 10, "agl": F.col("k").cast("double"), "w": F.pmod("value", F.lit(20.0)) - 10})


_RULES = """CASE WHEN st IN (5, 6) AND agl > 30 AND v > 15 THEN 3 ELSE st END"""
_FSM = f"""WITH RECURSIVE {S}, g AS (SELECT flight_id, n, t / 36000 AS h, value / 3 AS v, (k - 50) / 10.0::DOUBLE AS vz, CAST(k AS DOUBLE) AS agl, value - 20 * floor(value / 20) - 10 AS w FROM s),
 d AS (SELECT *, coalesce(h - lag(h) OVER (PARTITION BY flight_id ORDER BY n), 0) AS dt FROM g),
 m(flight_id, n, st, a, b) AS (SELECT flight_id, CAST(0 AS BIGINT), 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM d WHERE n = 1
  UNION ALL SELECT z.flight_id, z.n,
   CASE WHEN ca AND na >= la THEN ta WHEN cb AND nb >= lb THEN tb ELSE s0 END, CASE WHEN (ca AND na >= la) OR (cb AND nb >= lb) THEN 0 WHEN ca THEN na ELSE 0 END, CASE WHEN (ca AND na >= la) OR (cb AND nb >= lb) THEN 0 WHEN cb THEN nb ELSE 0 END
  FROM (SELECT y.*, a0 + dt AS na, b0 + dt AS nb,
    CASE s0 WHEN 0 THEN v > 3 WHEN 1 THEN v > 15 AND vz > 1 AND agl > 5 WHEN 2 THEN agl < 10 AND v < 30 WHEN 3 THEN agl < 10 AND v < 30 WHEN 4 THEN agl < 10 AND v < 30 WHEN 5 THEN v < 2 ELSE false END AS ca,
    CASE s0 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 5 THEN 5 ELSE 4 END AS la, CASE s0 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 5 THEN 6 ELSE 5 END AS ta,
    CASE s0 WHEN 2 THEN vz < 1 AND agl > 50 WHEN 3 THEN abs(w) > 6 WHEN 4 THEN abs(w) < 4 ELSE false END AS cb, CASE s0 WHEN 2 THEN 3 ELSE 5 END AS lb, CASE s0 WHEN 3 THEN 4 ELSE 3 END AS tb
   FROM (SELECT d.*, CASE WHEN m.st IN (5, 6) AND agl > 30 AND v > 15 THEN 3 ELSE m.st END AS s0, CASE WHEN m.st IN (5, 6) AND agl > 30 AND v > 15 THEN 0 ELSE m.a END AS a0, CASE WHEN m.st IN (5, 6) AND agl > 30 AND v > 15 THEN 0 ELSE m.b END AS b0
     FROM m JOIN d ON d.flight_id = m.flight_id AND d.n = m.n + 1) y) z)
SELECT flight_id, n, list_extract({list(PHASES)}, st + 1) AS phase FROM m WHERE n > 0"""


@query(_FSM)
def fsm_phases(spark, sf_dir):
    f = _features(spark, sf_dir)
    found = phases.label_phases(f, "h", "v", "vz", "agl", "w")
    return f.select("flight_id", "n", "h").join(found, ["flight_id", "h"]).select("flight_id", "n", "phase")


def _emission_sql(k: int) -> str:
    import math

    constant = -sum(math.log(d) for d in phases.DEVIATIONS[k]) - 4 * math.log(math.sqrt(2 * math.pi))
    squares = " + ".join(f"power(({x} - ({m})) / {d}::DOUBLE, 2)" for x, m, d in zip(("value / 3", "(k - 50) / 10.0::DOUBLE", "k", "abs(value - 20 * floor(value / 20) - 10)"), phases.MEANS[k], phases.DEVIATIONS[k], strict=True))
    return f"round(-0.5::DOUBLE * ({squares}) + ({constant!r})::DOUBLE, 5) AS b{k}"


@query(f"WITH {S} SELECT event_id, " + ", ".join(map(_emission_sql, range(7))) + " FROM s")
def hmm_emissions(spark, sf_dir):
    logs = phases.emissions(*map(F.col, ("v", "vz", "agl", "w")))
    return _features(spark, sf_dir).select("event_id", *(r(x, 5).alias(f"b{k}") for k, x in enumerate(logs)))


def _viterbi_sql() -> str:
    rows = [[f"{x!r}::DOUBLE" if x > float("-inf") else "'-infinity'::DOUBLE" for x in row] for row in phases.log_transitions().T.tolist()]
    paths = lambda j: "[" + ", ".join(f"f.sc[{i + 1}] + {a}" for i, a in enumerate(rows[j])) + "]"
    return f"""WITH RECURSIVE {S}, e AS (SELECT flight_id, n, t / 36000 AS h, [{", ".join(_emission_sql(k).removeprefix("round(").split(", 5) AS")[0] for k in range(7))}] AS b FROM s),
 f AS (SELECT flight_id, n, list_transform(b, lambda x: x - ln(7.0::DOUBLE)) AS sc, [CAST(0 AS INTEGER)] AS back FROM e WHERE n = 1
  UNION ALL SELECT e.flight_id, e.n, [{", ".join(f"list_max({paths(j)}) + e.b[{j + 1}]" for j in range(7))}], [{", ".join(f"list_position({paths(j)}, list_max({paths(j)}))" for j in range(7))}] FROM f JOIN e ON e.flight_id = f.flight_id AND e.n = f.n + 1),
 m AS (SELECT flight_id, max(n) AS n FROM f GROUP BY 1),
 p AS (SELECT f.flight_id, f.n, list_position(sc, list_max(sc)) AS st FROM f JOIN m ON m.flight_id = f.flight_id AND m.n = f.n
  UNION ALL SELECT p.flight_id, p.n - 1, f.back[p.st] FROM p JOIN f ON f.flight_id = p.flight_id AND f.n = p.n WHERE p.n > 1)
SELECT p.flight_id, h, list_extract({list(PHASES)}, st) AS phase_hmm FROM p JOIN e ON e.flight_id = p.flight_id AND e.n = p.n"""


@query(_viterbi_sql())
def hmm_viterbi(spark, sf_dir):
    return phases.decode_phases(_features(spark, sf_dir), "h", "v", "vz", "agl", "w")


def _grounded(spark, sf_dir) -> DataFrame:
    phase = F.when(F.col("event_type") == "signup", PHASES[0]).when(F.col("event_type") == "error", PHASES[6]).otherwise(PHASES[3])
    return samples(spark, sf_dir).withColumns({"phase": phase, "timestamp_s": F.col("t") / 3600})


_GROUND = f"{S}, p AS (SELECT *, t / 3600 AS ts, CASE event_type WHEN 'signup' THEN 'PRE_FLIGHT' WHEN 'error' THEN 'PUSHING_GROUND' ELSE 'CRUISING' END AS phase FROM s)"


@query(f"""WITH {_GROUND}, e AS (SELECT *, max(ts) FILTER (WHERE phase = 'PRE_FLIGHT') OVER w AS pre, min(ts) FILTER (WHERE phase = 'PUSHING_GROUND') OVER w AS post FROM p WINDOW w AS (PARTITION BY flight_id))
SELECT event_id, phase FROM e WHERE NOT coalesce(phase = 'PRE_FLIGHT' AND ts < pre - 3, false) AND NOT coalesce(phase = 'PUSHING_GROUND' AND ts > post + 3, false)""")
def trim_ground(spark, sf_dir):
    return phases.trim_ground(_grounded(spark, sf_dir), "phase").select("event_id", "phase")


_ANCHORS = f"""{_GROUND}, a AS (SELECT flight_id, """ + ", ".join(
    f"min(value) FILTER (WHERE phase = '{p}') AS {n}_min, avg(value) FILTER (WHERE phase = '{p}') AS {n}_mean, coalesce(stddev_samp(value) FILTER (WHERE phase = '{p}'), 0) AS {n}_std, median(ts) FILTER (WHERE phase = '{p}') AS {n}_t, count(*) FILTER (WHERE phase = '{p}') AS {n}_n"
    for n, p in (("pre", "PRE_FLIGHT"), ("post", "PUSHING_GROUND"))
) + " FROM p GROUP BY flight_id)"


@query(f"WITH {_ANCHORS} SELECT flight_id, " + ", ".join(f"round({n}_{c}, 7) AS {n}_{c}" for n in ("pre", "post") for c in ("min", "mean", "std", "t")) + ", pre_n, post_n FROM a")
def phase_stats(spark, sf_dir):
    found = phases.ground_anchors(_grounded(spark, sf_dir), "phase", "value")
    return found.select("flight_id", *(r(f"{n}_{c}", 7).alias(f"{n}_{c}") for n in ("pre", "post") for c in ("min", "mean", "std", "t")), "pre_n", "post_n")


@query(f"""WITH {_ANCHORS} SELECT event_id, round(value - CASE WHEN pre_t IS NOT NULL AND post_t IS NOT NULL THEN pre_min + greatest(0, least(1, coalesce((ts - pre_t) / nullif(post_t - pre_t, 0), 1))) * (post_min - pre_min) ELSE coalesce(pre_min, post_min, 0) END, 7) + 0 AS value
FROM p JOIN a USING (flight_id)""")
def drift_correct(spark, sf_dir):
    return phases.correct_drift(_grounded(spark, sf_dir), "phase", "value").select("event_id", r("value", 7).alias("value"))


@query(f"WITH {S} SELECT flight_id, round(median(value) FILTER (WHERE t <= 864000), 5) AS ground FROM s GROUP BY 1")
def ground_level(spark, sf_dir):
    return phases.ground_level(samples(spark, sf_dir), "value", "t", seconds=864000.0).select("flight_id", r("ground", 5).alias("ground"))


# Texts


@query(f"""WITH {S} SELECT event_id, CAST(CAST(round_even(greatest(value - 50, 0), 0) AS BIGINT) AS VARCHAR) AS altitude, CAST(CAST(round_even(greatest(value - 50, 0) * 3.6::DOUBLE, 0) AS BIGINT) AS VARCHAR) AS speed FROM s""")
def overlay_values(spark, sf_dir):
    v = F.col("value") - 50
    return samples(spark, sf_dir).select("event_id", text.altitude_text(v).alias("altitude"), text.speed_text(v, "km/h").alias("speed"))


@query(f"""WITH {S}, q AS (SELECT event_id, power(2, round_even(log2(greatest(value / 50, 0.001::DOUBLE)), 0)) AS p FROM s)
SELECT event_id, regexp_replace(regexp_replace(printf('%.10f', p), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') || CASE WHEN p > 1.05 THEN 'x >>' WHEN p < 0.95 THEN 'x <<' ELSE 'x' END AS speedup FROM q""")
def overlay_speedup(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", text.speedup_text(F.col("value") / 50, True).alias("speedup"))


@query(f"WITH {S} SELECT event_id, 'value: ' || printf('%.3f', value) || chr(10) || 'k: ' || k AS overview FROM s")
def overlay_overview(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", F.concat(F.lit("value: "), F.format_string("%.3f", "value"), F.lit("\nk: "), F.col("k").cast("string")).alias("overview"))


@query(f"""WITH {S}, q AS (SELECT event_id, value - 50 AS z, CASE WHEN event_type <> 'error' THEN value END AS v FROM s), o AS (SELECT event_id, unnest([0, 1, 2, 3]) AS i, unnest(['seq | Frame: ' || event_id, 'actor: a', 'z_m: ' || printf('%.3f', z), 'v_mag_ms: ' || coalesce(printf('%.3f', v), 'nan')]) AS text FROM q)
SELECT event_id AS frame_id, 'overview' AS widget, CAST(50 AS INT) AS x, CAST(50 + 34 * i AS INT) AS y, text, CASE WHEN i = 0 THEN 'yellow' ELSE 'white' END AS colour FROM o
UNION ALL SELECT event_id, 'alt', 384, 20, CAST(CAST(round_even(greatest(z, 0), 0) AS BIGINT) AS VARCHAR), 'white' FROM q
UNION ALL SELECT event_id, 'speed', 100, 216, 'SPEED', 'white' FROM q WHERE v IS NOT NULL
UNION ALL SELECT event_id, 'speed', 100, 241, CAST(CAST(round_even(v * 3.6::DOUBLE, 0) AS BIGINT) AS VARCHAR), 'white' FROM q WHERE v IS NOT NULL""")
def overlay_commands(spark, sf_dir):
    widgets = [
        {"name": "alt", "type": "AltitudeOverlay", "x": "10%", "y": 20}, {"name": "speed", "type": "SpeedOverlay", "x": 100, "y": "10%", "title": "SPEED", "title_size": 20},
        {"name": "clock", "type": "ClockOverlay", "x": 1, "y": 1}, {"name": "other", "type": "AltitudeOverlay", "x": 1, "y": 1},
    ]
    rows = samples(spark, sf_dir).select(F.col("event_id").alias("frame_id"), (F.col("value") - 50).alias("z_m"), F.when(F.col("event_type") != "error", F.col("value")).alias("v_mag_ms"))
    return sinks.draw_commands(rows, widgets, only=["overview", "alt", "speed"], sequence="seq", actor="a", font=30)


@query(f"WITH {S} SELECT event_id, CASE WHEN k % 2 = 0 THEN CAST(trunc(k / 100.0::DOUBLE * 3840) AS BIGINT) ELSE k END AS x FROM s")
def coord_parse(spark, sf_dir):
    written = F.when(F.col("k") % 2 == 0, F.concat(F.col("k").cast("string"), F.lit("%"))).otherwise(F.col("k").cast("string"))
    return samples(spark, sf_dir).select("event_id", fields.pixel(written, F.lit(3840)).alias("x"))


@query(f"""WITH {S}, q AS (SELECT event_id, CAST(floor(t) AS BIGINT) AS s FROM s) SELECT event_id, CASE WHEN s >= 3600 THEN CASE WHEN s % 3600 // 60 > 0 THEN printf('%dh %02dm', s // 3600, s % 3600 // 60) ELSE printf('%dh 0m', s // 3600) END WHEN s >= 60 THEN printf('%dm %02ds', s // 60, s % 60) ELSE printf('0m %ds', s) END AS duration FROM q""")
def duration_text(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", text.duration_text(F.col("t")).alias("duration"))


@query("""SELECT o_orderkey, concat_ws(' · ', CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END, 'SZD (' || o_orderkey || ')', strftime(o_orderdate, '%d %b %Y'), 'Flight Time: 0m 5s') AS line FROM orders""")
def flight_line(spark, sf_dir):
    k = F.col("o_orderkey")
    pilot = F.when(k % 4 != 0, F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.flight_line(pilot, F.lit("SZD"), k.cast("string"), F.col("o_orderdate"), F.lit(5.7)).alias("line"))


# Flight mechanics: value, k and price columns as velocities and accelerations


def _motion(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", (F.col("l_quantity") - 25).alias("vx"), (F.col("l_discount") * 100 - 5).alias("vy"), (F.col("l_tax") * 100 - 4).alias("vz"), (F.col("l_extendedprice") / 20000 - 2).alias("ax"), (F.col("l_tax") * 50 - 2).alias("ay"), (F.col("l_discount") * 10).alias("az"), (F.col("l_extendedprice") / 100).alias("z"))


_M = "m AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS vx, l_discount * 100 - 5 AS vy, l_tax * 100 - 4 AS vz, l_extendedprice / 20000 - 2 AS ax, l_tax * 50 - 2 AS ay, l_discount * 10 AS az, l_extendedprice / 100 AS z FROM lineitem)"
_ROLL = "atan2((vy * ax - vx * ay) / greatest(sqrt(vx * vx + vy * vy), 1e-6), 9.81)"


@query(f"""WITH {_M}, q AS (SELECT *, {_ROLL} AS roll FROM m) SELECT l_orderkey, l_linenumber, round(atan2(vy, vx), 5) + 0 AS yaw, round(roll, 5) + 0 AS roll, round(sqrt(ax * ax + ay * ay + (az + 9.81) * (az + 9.81)) / 9.81, 5) AS load_g,
 round(atan2(vz, sqrt(vx * vx + vy * vy)) + greatest(-0.5, least(1.5, 2 * 340.0 * 9.81 / (1.225 * power(1 - 2.25577e-5 * z, 4.256) * greatest(vx * vx + vy * vy + vz * vz, 1e-6) * 12.51 * greatest(cos(roll), 0.1)))) / (2 * pi() / (1 + 2 * pi() / (pi() * 0.85 * 225.0 / 12.51))) - 0.035, 5) AS pitch FROM q""")
def orientation(spark, sf_dir):
    m = _motion(spark, sf_dir)
    vx, vy, vz, ax, ay, az, z = (F.col(c) for c in ("vx", "vy", "vz", "ax", "ay", "az", "z"))
    bank = fl.roll(vx, vy, ax, ay)
    return m.select("l_orderkey", "l_linenumber", r(fl.yaw(vx, vy), 5).alias("yaw"), r(bank, 5).alias("roll"), r(fl.load_factor(ax, ay, az), 5).alias("load_g"), r(fl.pitch(vx, vy, vz, z, bank, 340.0, 12.51, 15.0), 5).alias("pitch"))


@query("""SELECT l_orderkey, l_linenumber, round(1.225 * power(1 - 2.25577e-5 * (l_extendedprice / 100), 4.256), 6) AS density, round((l_quantity + 3) - 2 * pi() * floor(((l_quantity + 3) + pi()) / (2 * pi())), 6) AS wrapped FROM lineitem""")
def air_density(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", r(fl.air_density(F.col("l_extendedprice") / 100)).alias("density"), r(fl.wrapped(F.col("l_quantity") + 3)).alias("wrapped"))


@query("""WITH q AS (SELECT s_suppkey, 20.0::DOUBLE AS v1, -0.6 - s_acctbal / 1e5 AS w1, 30.0::DOUBLE AS v2, -0.8::DOUBLE AS w2, 40.0::DOUBLE AS v3, -1.9 - s_acctbal / 2e5 AS w3 FROM supplier), a AS (SELECT *, ((w3 - w2) / (v3 - v2) - (w2 - w1) / (v2 - v1)) / (v3 - v1) AS a FROM q), b AS (SELECT *, (w2 - w1) / (v2 - v1) - a * (v1 + v2) AS b FROM a)
SELECT s_suppkey, round(a * 1e6, 5) AS a, round(b * 1e4, 3) AS b, round(w1 - a * v1 * v1 - b * v1, 5) AS c, round(v2 * sqrt((340 + s_suppkey % 100) / 340.0::DOUBLE), 5) AS scaled, round(15.0 * 15.0 / (12 + s_suppkey % 3)::DOUBLE, 5) AS ratio FROM b""")
def polar_fit(spark, sf_dir):
    s = F.col("s_acctbal")
    a, b, c = fl.polar_parabola(F.lit(20.0), -0.6 - s / 1e5, F.lit(30.0), F.lit(-0.8), F.lit(40.0), -1.9 - s / 2e5)
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", r(a * 1e6, 5).alias("a"), r(b * 1e4, 3).alias("b"), r(c, 5).alias("c"), r(fl.polar_scaled(F.lit(30.0), 340 + k % 100, F.lit(340.0)), 5).alias("scaled"), r(fl.aspect_ratio(F.lit(15.0), 12.0 + k % 3), 5).alias("ratio"))


@query(f"WITH {_M} SELECT l_orderkey, l_linenumber, round(vx * 100, 4) AS wx, round(-vy * 100, 4) + 0.0 AS wy, round(vz * 100, 4) AS wz, round(vy * 2 * 100, 4) AS lx, round(vx * 2 * 100, 4) AS ly FROM m")
def enu_to_world(spark, sf_dir):
    x, y, z = (F.col(c) for c in ("vx", "vy", "vz"))
    w, old = fl.world(x, y, z), fl.world_legacy(x, y, z, 2.0)
    return _motion(spark, sf_dir).select("l_orderkey", "l_linenumber", r(w[0], 4).alias("wx"), r(w[1], 4).alias("wy"), r(w[2], 4).alias("wz"), r(old[0], 4).alias("lx"), r(old[1], 4).alias("ly"))


@query(f"""WITH {_M}, q AS (SELECT *, ax AS yaw, ay AS pitch, az AS roll FROM m), b AS (SELECT *, cos(yaw) * sin(pitch) * sin(roll) - sin(yaw) * cos(roll) AS bx, sin(yaw) * sin(pitch) * sin(roll) + cos(yaw) * cos(roll) AS byy, cos(pitch) * sin(roll) AS bz FROM q)
SELECT l_orderkey, l_linenumber, round(vx + 9 * bx, 5) AS left_x, round(vy + 9 * byy, 5) AS left_y, round(vz + 9 * bz, 5) AS left_z, round(vx - 9 * bx, 5) AS right_x, round(vy - 9 * byy, 5) AS right_y, round(vz - 9 * bz, 5) AS right_z FROM b""")
def wing_tips(spark, sf_dir):
    tips = fl.wing_tips(*(F.col(c) for c in ("vx", "vy", "vz", "ax", "ay", "az")), 18.0)
    return _motion(spark, sf_dir).select("l_orderkey", "l_linenumber", *(r(c, 5).alias(n) for n, c in tips.items()))


@query(f"WITH {S} SELECT event_id, round(CASE WHEN value * 4 - 100 < 0 THEN 0 WHEN value * 4 - 100 <= 360 THEN 1 ELSE greatest(0.5, 1 - (value * 4 - 100 - 360) / 240 * 0.5) END, 6) AS opacity FROM s")
def opacity_timeline(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", r(fl.opacity(F.col("value") * 4 - 100)).alias("opacity"))


@query(f"""WITH {_M}, q AS (SELECT *, az AS roll, sqrt(vx * vx + vy * vy + vz * vz) AS nf FROM m), f AS (SELECT *, CASE WHEN nf > 1e-8 THEN vx / nf ELSE 1 END AS fx, CASE WHEN nf > 1e-8 THEN -vy / nf ELSE 0 END AS fy, CASE WHEN nf > 1e-8 THEN vz / nf ELSE 0 END AS fz FROM q),
 g AS (SELECT *, sqrt(fx * fx + fy * fy) AS nr FROM f), h AS (SELECT *, CASE WHEN nr > 1e-8 THEN -fy / nr ELSE 0 END AS rx, CASE WHEN nr > 1e-8 THEN fx / nr ELSE 1 END AS ry FROM g)
SELECT l_orderkey, l_linenumber, round(fx, 5) + 0 AS fx, round(fy, 5) + 0 AS fy, round(rx * cos(-roll) + (0 - fz * ry) * sin(-roll) + fx * (fx * rx + fy * ry) * (1 - cos(-roll)), 5) + 0 AS rx, round(ry * cos(-roll) + fz * rx * sin(-roll) + fy * (fx * rx + fy * ry) * (1 - cos(-roll)), 5) + 0 AS ry,
 round((fx * ry - fy * rx) * sin(-roll) + fz * (fx * rx + fy * ry) * (1 - cos(-roll)), 5) + 0 AS rz FROM h""")
def banked_axes(spark, sf_dir):
    rows = fl.with_banked_axes(_motion(spark, sf_dir), *map(F.col, ("vx", "vy", "vz", "az")))
    return rows.select("l_orderkey", "l_linenumber", *(r(c, 5).alias(c) for c in ("fx", "fy", "rx", "ry", "rz")))


@query(SQL["banked_axes"].rsplit("SELECT", 1)[0] + """SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS norm, round(fx, 3) + 0 AS fx, round(fy, 3) + 0 AS fy, round(fz, 3) + 0 AS fz, round(rx * cos(-roll) + (0 - fz * ry) * sin(-roll) + fx * (fx * rx + fy * ry) * (1 - cos(-roll)), 3) + 0 AS rx FROM h""")
def quaternion_norm(spark, sf_dir):
    """The length of the quaternion of the banked axes, and what it turns the axes x and y into."""
    rows = fl.with_banked_axes(_motion(spark, sf_dir), *map(F.col, ("vx", "vy", "vz", "az")))
    rows = rows.withColumns(fl.quaternion([F.col(c) for c in ("fx", "fy", "fz")], [F.col(c) for c in ("rx", "ry", "rz")]))
    w, x, y, z = (F.col(f"q{a}") for a in "wxyz")
    turned = {"fx": 1 - 2 * (y**2 + z**2), "fy": 2 * (x * y + w * z), "fz": 2 * (x * z - w * y), "rx": 2 * (x * y - w * z)}
    return rows.select("l_orderkey", "l_linenumber", r(F.sqrt(w**2 + x**2 + y**2 + z**2), 4).alias("norm"), *(r(c, 3).alias(n) for n, c in turned.items()))


@query(f"""WITH {S}, q AS (SELECT event_id, (value - 2 * pi() * floor(value / (2 * pi()))) / 2 AS ha, k / 40.0::DOUBLE AS hb FROM s), d AS (SELECT *, abs(cos(ha - hb)) AS nd, CASE WHEN cos(ha - hb) < 0 THEN -1 ELSE 1 END AS sg FROM q), o AS (SELECT *, acos(least(nd, 1)) AS om FROM d),
 w AS (SELECT *, CASE WHEN nd > 0.9999 THEN 0.7 ELSE sin(0.7 * om) / nullif(sin(om), 0) END AS wa, sg * CASE WHEN nd > 0.9999 THEN 0.3 ELSE sin(0.3 * om) / nullif(sin(om), 0) END AS wb FROM o), m AS (SELECT *, wa * cos(ha) + wb * cos(hb) AS c, wa * sin(ha) + wb * sin(hb) AS z FROM w)
SELECT event_id, round(c / sqrt(c * c + z * z), 4) AS qw, round(z / sqrt(c * c + z * z), 4) AS qz FROM m""")
def slerp(spark, sf_dir):
    ha, hb = F.pmod("value", 2 * F.pi()) / 2, F.col("k") / 40.0
    zero = F.lit(0.0)
    q = fl.slerp([F.cos(ha), zero, zero, F.sin(ha)], [F.cos(hb), zero, zero, F.sin(hb)], F.lit(0.3))
    return samples(spark, sf_dir).select("event_id", r(q[0], 4).alias("qw"), r(q[3], 4).alias("qz"))


# Geometry


@query(f"""WITH {S}, i AS (SELECT flight_id, n - 1 AS i, count(*) OVER (PARTITION BY flight_id) AS m FROM s), e AS (SELECT * FROM i WHERE i < m - 1) SELECT flight_id, 2 * i AS triangle, 2 * i AS a, 2 * i + 2 AS b, 2 * i + 1 AS c FROM e UNION ALL SELECT flight_id, 2 * i + 1, 2 * i + 1, 2 * i + 2, 2 * i + 3 FROM e""")
def ribbon_triangles(spark, sf_dir):
    return geometry.ribbon_triangles(samples(spark, sf_dir), "n")


@query(f"""WITH {_P}, d AS (SELECT *, coalesce(lead(x) OVER w - x, x - lag(x) OVER w, 0) AS dx, coalesce(lead(y) OVER w - y, y - lag(y) OVER w, 0) AS dy, coalesce(lead(z) OVER w - z, z - lag(z) OVER w, 0) AS dz FROM p WINDOW w AS (PARTITION BY flight_id ORDER BY n)),
 u AS (SELECT *, sqrt(dx * dx + dy * dy + dz * dz) AS nn FROM d), f AS (SELECT *, CASE WHEN nn > 1e-8 THEN dx / nn ELSE 1 END AS fx, CASE WHEN nn > 1e-8 THEN dy / nn ELSE 0 END AS fy FROM u), g AS (SELECT *, sqrt(fx * fx + fy * fy) AS nr FROM f),
 h AS (SELECT *, CASE WHEN nr > 1e-8 THEN -fy / nr ELSE 0 END AS rx, CASE WHEN nr > 1e-8 THEN fx / nr ELSE 1 END AS ry, CASE WHEN nn > 1e-8 THEN dz / nn ELSE 0 END AS fz FROM g),
 o AS (SELECT *, nullif(sqrt(power(fz * ry, 2) + power(fz * rx, 2) + power(fx * ry - fy * rx, 2)), 0) AS no FROM h)
SELECT round(coalesce(-fz * ry / no, 0), 4) + 0 AS nx, round(coalesce(fz * rx / no, 0), 4) + 0 AS ny, round(coalesce((fx * ry - fy * rx) / no, 0), 4) + 0 AS nz, flight_id, 2 * (n - 1) + b AS vertex, n AS u, 1.0::DOUBLE - b AS v, round(x + (1 - 2 * b) * 7.5 * rx, 3) AS vx, round(y + (1 - 2 * b) * 7.5 * ry, 3) AS vy, round(z, 3) AS vz FROM o, (VALUES (0), (1)) k(b)""")
def ribbon_vertices(spark, sf_dir):
    rows = _positions(spark, sf_dir).withColumn("roll_rad", F.lit(0.0))
    v = geometry.ribbon_vertices(rows, "n", 15.0)
    return v.select("flight_id", "vertex", "u", "v", *(r(c, 3).alias(c) for c in ("vx", "vy", "vz")), *(r(c, 4).alias(c) for c in ("nx", "ny", "nz")))


@query(f"WITH {S} SELECT flight_id, count(*) AS n_points, round(CAST(sum(CAST(value AS DECIMAL(18,2)) * n) AS DOUBLE), 2) AS checksum FROM s GROUP BY 1")
def geojson_lines(spark, sf_dir):
    lines = geometry.lines(samples(spark, sf_dir), "n", "value", "t")
    total = F.aggregate(F.transform("coordinates", lambda c, i: c[0].cast("decimal(18,2)") * (i + 1)), F.lit(0).cast("decimal(30,2)"), lambda a, x: (a + x).cast("decimal(30,2)"))
    return lines.select("flight_id", F.size("coordinates").cast("long").alias("n_points"), r(total.cast("double"), 2).alias("checksum"))


@query(f"WITH {S} SELECT flight_id, count(DISTINCT event_type) AS n_features FROM s GROUP BY 1")
def layer_union(spark, sf_dir):
    s = samples(spark, sf_dir)
    layers = None
    for kind in TYPES:
        one = geometry.lines(s.where(F.col("event_type") == kind), "n", "value", "t").withColumn("layer", F.lit(kind))
        layers = one if layers is None else layers.unionByName(one)
    found = sinks.feature_collection(layers, "flight_id")
    return found.select("flight_id", F.size(F.from_json("geojson", "features array<struct<type:string>>")["features"]).cast("long").alias("n_features"))


@query(f"""WITH {S}, q AS (SELECT event_id, radians(value / 10) AS la, radians(CAST(k AS DOUBLE)) AS lo, radians(lag(value / 10) OVER w) AS la0, radians(lag(CAST(k AS DOUBLE)) OVER w) AS lo0 FROM s WINDOW w AS (PARTITION BY flight_id ORDER BY n))
SELECT event_id, round(12742000.0::DOUBLE * asin(sqrt(least(1, power(sin((la - la0) / 2), 2) + cos(la0) * cos(la) * power(sin((lo - lo0) / 2), 2)))), 2) AS metres FROM q""")
def haversine_steps(spark, sf_dir):
    from ..functions.geodesy import haversine

    w = Window.partitionBy("flight_id").orderBy("n")
    lat, lon = F.col("value") / 10, F.col("k").cast("double")
    rows = samples(spark, sf_dir).select("event_id", lat.alias("lat"), lon.alias("lon"), F.lag(lat).over(w).alias("lat0"), F.lag(lon).over(w).alias("lon0"))
    return rows.select("event_id", r(haversine(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")), 2).alias("metres"))


def _geodesic_sql() -> str:
    """Distance and azimuth by six rounds, a table for each; far points too."""
    f, b = "(1 / 298.257223563::DOUBLE)", "(6378137.0::DOUBLE * (1 - 1 / 298.257223563::DOUBLE))"
    step = lambda k: f"""p{k} AS (SELECT *, cos(u2) * sin(lam) AS px, cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam) AS py, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS co FROM r{k}),
 q{k} AS (SELECT *, sqrt(px * px + py * py) AS si, CASE WHEN px * px + py * py > 0 THEN cos(u1) * cos(u2) * sin(lam) / sqrt(px * px + py * py) ELSE 0 END AS al FROM p{k}),
 m{k} AS (SELECT *, 1 - al * al AS ca, CASE WHEN 1 - al * al > 0 THEN co - 2 * sin(u1) * sin(u2) / (1 - al * al) ELSE 0 END AS mi, {f} / 16 * (1 - al * al) * (4 + {f} * (4 - 3 * (1 - al * al))) AS fc FROM q{k}),
 r{k + 1} AS (SELECT event_id, u1, u2, l0, l0 + (1 - fc) * {f} * al * (atan2(si, co) + fc * si * (mi + fc * co * (2 * mi * mi - 1))) AS lam FROM m{k})"""  # noqa: E731
    rounds = ", ".join(step(k) for k in range(6))
    return f"""WITH {S}, r0 AS (SELECT event_id, atan((1 - {f}) * tan(radians(52.27::DOUBLE))) AS u1, atan((1 - {f}) * tan(radians(52 + least(value, 300) / 10))) AS u2, radians(20 + k / 10.0::DOUBLE - 20.91::DOUBLE) AS l0, radians(20 + k / 10.0::DOUBLE - 20.91::DOUBLE) AS lam FROM s), {rounds},
 e AS (SELECT *, ca * (6378137.0::DOUBLE ** 2 - {b} ** 2) / {b} ** 2 AS w FROM m5),
 g AS (SELECT *, 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w))) AS ba, w / 1024 * (256 + w * (-128 + w * (74 - 47 * w))) AS bb FROM e),
 d AS (SELECT event_id, px, py, {b} * ba * (atan2(si, co) - bb * si * (mi + bb / 4 * (co * (2 * mi * mi - 1) - bb / 6 * mi * (4 * si * si - 3) * (4 * mi * mi - 3)))) AS far FROM g)
SELECT s.event_id, round(far * sin(atan2(px, py)), 3) + 0 AS x_m, round(far * cos(atan2(px, py)), 3) + 0 AS y_m, round(52 + least(value, 300) / 10, 7) AS lat_deg, round(20 + k / 10.0::DOUBLE, 7) AS lon_deg FROM d JOIN s ON s.event_id = d.event_id"""


@query(_geodesic_sql())
def projection_round_trip(spark, sf_dir):
    """Local coordinates of points up to a thousand kilometres away, and the points again from these."""
    from ..functions import geodesy

    rows = samples(spark, sf_dir).select("event_id", (52 + F.least("value", F.lit(300.0)) / 10).alias("lat"), (20 + F.col("k") / 10.0).alias("lon"))
    local = geodesy.to_local(rows, "lat", "lon", F.lit(52.27), F.lit(20.91))
    back = geodesy.to_globe(local, "x_m", "y_m", F.lit(52.27), F.lit(20.91))
    return back.select("event_id", r("x_m", 3).alias("x_m"), r("y_m", 3).alias("y_m"), r("lat_deg", 7).alias("lat_deg"), r("lon_deg", 7).alias("lon_deg"))


@query(f"""WITH {S}, c AS (SELECT *, count(*) OVER (PARTITION BY flight_id) AS m FROM s), k AS (SELECT o, exp(-0.5 * (o / 1.5::DOUBLE) ** 2) AS w FROM (SELECT unnest(range(-6, 7)) AS o)), w AS (SELECT o, w / sum(w) OVER () AS w FROM k),
 p AS (SELECT flight_id, n, w, ((n - 1 + o) % (2 * m) + 2 * m) % (2 * m) AS a, m FROM c, w)
SELECT p.flight_id, CAST(p.n AS DOUBLE) AS i, round(sum(w * value), 7) AS value FROM p JOIN s ON s.flight_id = p.flight_id AND s.n = CASE WHEN a < m THEN a + 1 ELSE 2 * m - a END GROUP BY 1, 2""")
def gaussian_smooth(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("i", F.col("n").cast("double"))
    return spline.smooth(rows, ["value"], 1.5, "i").withColumn("value", r("value", 7))


@query()
def spline_fit(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumns({"i": F.col("n").cast("double"), "y": F.col("k").cast("double")})
    return spline.fit_splines(rows, ["value", "y"], 5, 500.0, "i")


@query(f"WITH {S} SELECT flight_id, count(*) AS n_rows, count(*) AS n_finite, true AS close_enough, true AS smooth_enough FROM s GROUP BY 1")
def spline_target(spark, sf_dir):
    """The trajectories' splines at their own rows: the weighted sum of squares is at most s, and no less than need be.

    smooth_enough: it is s, or the spline has no inner knot: then it is the polynomial, and no spline is smoother.
    """
    rows = samples(spark, sf_dir).select("flight_id", "value", F.col("n").cast("double").alias("i"), F.col("k").cast("double").alias("y"))
    found = spline.spline_values(rows, ["value", "y"], [spline.Spline(5, 0.5, [(["fx", "fy"], "i", 0)], "inner")], "i")
    error = F.sum((F.col("fx") - F.col("value")) ** 2 + (F.col("fy") - F.col("y")) ** 2)
    finite = F.count(F.when(~F.isnan("fx") & ~F.isnan("fy"), 1))
    s = F.count("*") * 0.5
    smooth = (error >= 0.998 * s) | (F.max("inner") == 0)
    return found.groupBy("flight_id").agg(F.count("*").alias("n_rows"), finite.alias("n_finite"), (error <= 1.001 * s).alias("close_enough"), smooth.alias("smooth_enough"))


@query(f"""WITH {S} SELECT event_id, round(value, 5) AS at_row, round(value + coalesce(0.25 * (lead(value) OVER w - value), 0.25 * (value - lag(value) OVER w), 0), 5) AS later, round(coalesce(lead(value) OVER w - value, value - lag(value) OVER w, 0), 5) AS slope FROM s WINDOW w AS (PARTITION BY flight_id ORDER BY n)""")
def spline_values(spark, sf_dir):
    """Splines without smoothing: of degree 5 at their rows; straight ones a quarter of a second later, and their slope."""
    rows = samples(spark, sf_dir).select("event_id", "flight_id", "value", F.col("n").cast("double").alias("i"))
    rows = rows.withColumn("later_i", F.col("i") + 0.25)
    exact, straight = spline.Spline(5, 0.0, [(["at_row"], "i", 0)]), spline.Spline(1, 0.0, [(["later"], "later_i", 0), (["slope"], "later_i", 1)])
    found = spline.spline_values(rows, ["value"], [exact, straight], "i")
    return found.select("event_id", r("at_row", 5).alias("at_row"), r("later", 5).alias("later"), r("slope", 5).alias("slope"))


@query(f"""WITH {S} SELECT flight_id, 60 * (count(*) - 1) AS n_samples, 1.0::DOUBLE AS first_s, round(count(*) - 1 / 60.0::DOUBLE, 6) AS last_s, 60 * (count(*) - 1) AS n_finite, 60 * (count(*) - 1) AS n_consistent, 60 * (count(*) - 1) AS n_near FROM s GROUP BY 1 HAVING count(*) > 1""")
def trajectory_samples(spark, sf_dir):
    """trajectory_60hz by flight: samples, and how many of them are finite, have a speed that fits the velocity, and a next
    position where velocity and acceleration lead."""
    rows = plan.trajectories(_tracks(spark, sf_dir), ahead=("x_m",))
    ahead = F.col("next_x_m") - (F.col("x_m") + F.col("vx_ms") / 60 + F.col("ax_ms2") / 7200)
    rows = rows.withColumn("_near", F.coalesce(F.abs(ahead) <= 0.01 + 0.02 * (F.abs("vx_ms") + F.abs("ax_ms2")) / 60, F.lit(True)))
    finite = sum((F.when(F.isnan(c) | F.col(c).isNull() | (F.abs(c) > 1e6), 1).otherwise(0) for c in ("x_m", "y_m", "z_m", "vx_ms", "az_ms2", "load_g", "yaw_rad", "pitch_rad", "roll_rad")), F.lit(0)) == 0
    fits = F.abs(F.col("v_mag_ms") ** 2 - F.col("vx_ms") ** 2 - F.col("vy_ms") ** 2 - F.col("vz_ms") ** 2) <= 1e-6 * (1 + F.col("v_mag_ms") ** 2)
    return rows.groupBy("flight_id").agg(F.count("*").alias("n_samples"), F.min("timestamp_s").alias("first_s"), r(F.max("timestamp_s")).alias("last_s"), *(F.count(F.when(c, 1)).alias(n) for n, c in (("n_finite", finite), ("n_consistent", fits), ("n_near", F.col("_near")))))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's position in its flight stands in for its second."""
    return samples(spark, sf_dir).select("flight_id", F.col("n").cast("double").alias("timestamp_s"), F.col("value").alias("x_m"), F.col("k").cast("double").alias("y_m"), F.col("value").alias("z_m"), F.lit(1.0).alias("weight"), F.lit(PHASES[3]).alias("phase"))


@query()
def trajectory_60hz(spark, sf_dir):
    """Sixty samples a second."""
    return plan.trajectories(_tracks(spark, sf_dir))


def _payloads(spark, sf_dir) -> DataFrame:
    """Events of a user as sensor streams in payloads of up to 10 samples."""
    s = samples(spark, sf_dir).withColumn("payload", F.floor((F.col("n") - 1) / 10).cast("int"))
    many = s.groupBy("flight_id", "payload").agg(F.array_sort(F.collect_list(F.struct("n", F.round(F.col("value") * 100).cast("int").alias("a"), F.col("k").cast("int").alias("b")))).alias("rows"))
    import struct as pack
    from collections.abc import Iterator

    import pandas as pd

    def item(key: bytes, kind: bytes, size: int, repeat: int, body: bytes) -> bytes:
        return pack.pack(">4scBH", key, kind, size, repeat) + body + b"\0" * (-len(body) % 4)

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for p in pdf.itertuples():
                body = b"".join(pack.pack(">iii", x["a"], x["b"], -x["b"]) for x in p.rows)
                stream = item(b"SCAL", b"s", 2, 1, pack.pack(">h", 100)) + item(b"STMP", b"J", 8, 1, pack.pack(">Q", p.payload * 1_000_000)) + item(b"ORIN", b"c", 3, 1, b"YxZ") + item(b"ACCL", b"l", 12, len(p.rows), body)
                nested = item(b"STRM", b"\0", 1, len(stream), stream)
                out.append((str(p.flight_id), p.payload, float(p.payload), 1.0, item(b"DEVC", b"\0", 1, len(nested), nested)))
            yield pd.DataFrame(out, columns=["flight_id", "payload", "pts", "duration", "data"])

    return many.mapInPandas(build, "flight_id string, payload int, pts double, duration double, data binary")


@query(f"""WITH {S}, q AS (SELECT *, (n - 1) // 10 AS payload, (n - 1) % 10 AS i FROM s), c AS (SELECT *, count(*) OVER (PARTITION BY flight_id, payload) AS m FROM q)
SELECT CAST(flight_id AS VARCHAR) AS flight_id, CAST(payload AS INT) AS payload, CAST(i AS INT) AS i, round(payload + i / m::DOUBLE, 6) AS timestamp_s, round(-k / 100.0::DOUBLE, 6) + 0.0 AS x, round(round(value * 100, 0) / 100.0::DOUBLE, 6) AS y, round(-k / 100.0::DOUBLE, 6) + 0.0 AS z FROM c""")
def gpmf_samples(spark, sf_dir):
    from ..sources import gpmf

    found = gpmf.samples(gpmf.parse_payloads(_payloads(spark, sf_dir)), "ACCL", ["x", "y", "z"])
    return found.select("flight_id", "payload", "i", r("timestamp_s").alias("timestamp_s"), r("x").alias("x"), r("y").alias("y"), r("z").alias("z"))


@query(f"""WITH {S}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY flight_id ORDER BY t) AS dt FROM s),
 h AS (SELECT flight_id, CAST(floor(greatest(3, round_even(400000 / CASE WHEN median(dt) < 1e-6 THEN 1.0 ELSE coalesce(median(dt), 1.0) END, 0)) / 2) AS BIGINT) AS half FROM d GROUP BY 1)
SELECT event_id, round(median(value) OVER (PARTITION BY s.flight_id ORDER BY n ROWS BETWEEN half PRECEDING AND half FOLLOWING), 6) AS smooth FROM s JOIN h ON s.flight_id = h.flight_id""")
def rolling_median_by_rate(spark, sf_dir):
    return ordered.rolling_medians(samples(spark, sf_dir), {"value": "m"}, "t", "flight_id", 400000.0, "n").select("event_id", r("m").alias("smooth"))


@query(f"""WITH {S}, p AS (SELECT *, value AS x, -CAST(k AS DOUBLE) AS y, CASE WHEN k % 3 = 0 THEN 0 ELSE value - 40 END AS gx, CASE WHEN k % 3 = 0 THEN 0 ELSE 5 - CAST(k AS DOUBLE) END AS gy FROM s),
 d AS (SELECT *, lead(x) OVER w - x AS tx, lead(y) OVER w - y AS ty, x - lag(x) OVER w AS bx, y - lag(y) OVER w AS byy FROM p WINDOW w AS (PARTITION BY flight_id ORDER BY n)),
 u AS (SELECT *, sqrt(tx * tx + ty * ty) AS tn, sqrt(bx * bx + byy * byy) AS bn, sqrt(gx * gx + gy * gy) AS gn FROM d),
 m AS (SELECT *, CASE WHEN gn > 1e-4 THEN gx / gn ELSE CASE WHEN tn > 1e-4 THEN tx / tn ELSE 0 END + CASE WHEN bn > 1e-4 THEN bx / bn ELSE 0 END END AS dx, CASE WHEN gn > 1e-4 THEN gy / gn ELSE CASE WHEN tn > 1e-4 THEN ty / tn ELSE 0 END + CASE WHEN bn > 1e-4 THEN byy / bn ELSE 0 END END AS dy FROM u)
SELECT event_id, round(CASE WHEN sqrt(dx * dx + dy * dy) > 1e-4 THEN dx / sqrt(dx * dx + dy * dy) ELSE 1 END, 4) + 0 AS dir_x, round(CASE WHEN sqrt(dx * dx + dy * dy) > 1e-4 THEN dy / sqrt(dx * dx + dy * dy) ELSE 0 END, 4) + 0 AS dir_y FROM m""")
def travel_directions(spark, sf_dir):
    rest = F.col("k") % 3 == 0
    rows = samples(spark, sf_dir).withColumns({"x_m": F.col("value"), "y_m": F.col("k").cast("double"), "z_m": F.lit(0.0), "vx_ms": F.when(rest, 0.0).otherwise(F.col("value") - 40), "vy_ms": F.when(rest, 0.0).otherwise(F.col("k") - 5.0), "vz_ms": F.lit(0.0)})
    return geometry.travel_directions(rows, "n").select("event_id", r("dir_x", 4).alias("dir_x"), r("dir_y", 4).alias("dir_y"))


@query(f"""WITH {S}, x AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY flight_id ORDER BY n) AND row_number() OVER (PARTITION BY flight_id, event_type ORDER BY n) > 1 AS gap FROM s),
 y AS (SELECT flight_id, event_type, n, 1 AS side, value, k FROM x UNION ALL SELECT flight_id, event_type, n, 0, NULL, NULL FROM x WHERE gap)
SELECT flight_id, event_type, row_number() OVER (PARTITION BY flight_id, event_type ORDER BY n, side) AS place, value, CAST(k AS DOUBLE) AS k FROM y""")
def phase_lines(spark, sf_dir):
    return geometry.phase_lines(samples(spark, sf_dir), "event_type", ["value", "k"], "n").withColumns({"place": F.col("place").cast("long"), "k": F.col("k").cast("double")})


@query(f"""WITH {S} SELECT flight_id, '{",".join(sinks.FRAME)}' || chr(10) || string_agg(printf('{",".join(sinks.FRAME.values())}', n, t, t + 1, value, CAST(k AS DOUBLE), value, value, value, value, value, value, value, value, value, value, value, value, event_type), chr(10) ORDER BY n) || chr(10) AS csv FROM s GROUP BY flight_id""")
def frame_csv(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumns({"frame_id": F.col("n"), "timestamp_s": F.col("t"), "video_time_s": F.col("t") + 1, "y_m": F.col("k").cast("double"), "phase": F.col("event_type")})
    return sinks.frame_csv(rows.withColumns({c: F.col("value") for c in sinks.FRAME if c not in rows.columns}))


@query(f"""WITH {S} SELECT flight_id, ',event_id,k,event_type' || chr(10) || string_agg((n - 1) || ',' || event_id || ',' || coalesce(CAST(k AS VARCHAR), '') || ',' || event_type, chr(10) ORDER BY n) || chr(10) AS csv FROM s GROUP BY flight_id""")
def indexed_csv(spark, sf_dir):
    return sinks.indexed_csv(samples(spark, sf_dir), ["event_id", "k", "event_type"], "n")


@query(f"""WITH {S}, d AS (SELECT flight_id, max(t) AS d FROM s GROUP BY 1) SELECT s.flight_id, event_type AS stream, count(*) AS n_samples, round(CASE WHEN d > 0 THEN count(*) / d END, 9) AS rate_hz FROM s JOIN d ON s.flight_id = d.flight_id GROUP BY s.flight_id, event_type, d""")
def stream_rates(spark, sf_dir):
    s = samples(spark, sf_dir)
    payloads = s.groupBy("flight_id", F.col("event_type").alias("stream"), F.floor(F.col("n") / 10).alias("payload")).agg(F.collect_list("value").alias("raw"))
    found = gpmf.stream_rates(payloads, s.groupBy("flight_id").agg(F.max("t").alias("duration_s")))
    return found.withColumn("rate_hz", r("rate_hz", 9))


def _sensor_sql() -> str:
    """Four other streams at the clicks' times; views are taken one by one where a flight has as many of them."""
    streams = (("views", "view", "value"), ("errors", "error", "k"), ("signups", "signup", "value"), ("purchases", "purchase", "k"))
    parts = [f"{n}_s AS (SELECT flight_id, t, CAST({v} AS DOUBLE) AS v FROM s WHERE event_type = '{kind}')" for n, kind, v in streams]
    parts += [f"{n}_b AS (SELECT c.event_id, c.flight_id, c.t, x.t AS bt, x.v AS bv FROM c ASOF LEFT JOIN {n}_s x ON c.flight_id = x.flight_id AND c.t >= x.t)" for n, _, _ in streams]
    parts += [f"{n}_a AS (SELECT b.*, x.t AS aft, x.v AS av FROM {n}_b b ASOF LEFT JOIN {n}_s x ON b.flight_id = x.flight_id AND b.t <= x.t)" for n, _, _ in streams]
    parts += [f"{n} AS (SELECT event_id, flight_id, t, CASE WHEN bv IS NULL THEN av WHEN av IS NULL THEN bv ELSE bv + coalesce((t - bt) / nullif(aft - bt, 0), 0) * (av - bv) END AS v FROM {n}_a)" for n, _, _ in streams]
    numbered = "row_number() OVER (PARTITION BY flight_id ORDER BY t) AS i, count(*) OVER (PARTITION BY flight_id) AS m"
    both = f"p AS (SELECT c.event_id, x.v FROM (SELECT *, {numbered} FROM c) c JOIN (SELECT *, {numbered} FROM views_s) x USING (flight_id, i, m))"
    shown = ", ".join(f"round({'coalesce(p.v, views.v)' if n == 'views' else n + '.v'}, 5) AS {n}" for n, _, _ in streams)
    joins = " ".join(f"JOIN {n} ON {n}.event_id = c.event_id" for n, _, _ in streams)
    return f"WITH {S}, c AS (SELECT event_id, flight_id, t FROM s WHERE event_type = 'click'), {', '.join(parts)}, {both} SELECT c.event_id, {shown} FROM c {joins} LEFT JOIN p ON p.event_id = c.event_id"


@query(_sensor_sql())
def sensor_table(spark, sf_dir):
    """The series of four kinds of events at the times of a fifth."""
    s = samples(spark, sf_dir)
    of = lambda kind, value, name: (s.where(F.col("event_type") == kind).select("flight_id", "t", F.col(value).cast("double").alias(name)), [name])
    others = {"views": of("view", "value", "views"), "errors": of("error", "k", "errors"), "signups": of("signup", "value", "signups"), "purchases": of("purchase", "k", "purchases")}
    found = ordered.merged(s.where("event_type = 'click'").select("event_id", "flight_id", "t"), others, "t", exact=("views",))
    return found.select("event_id", *(r(n, 5).alias(n) for n in others))


@query(SQL["srt_text"].replace("SELECT flight_id, string_agg", "SELECT CAST(flight_id AS VARCHAR) AS flight_id, string_agg"))
def srt_files(spark, sf_dir):
    """srt_text by way of files: one for each flight, written and read again."""
    top = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='spark-')}"
    path = f"{top}/srt-{uuid.uuid4().hex}"
    files.write_subtitles(samples(spark, sf_dir), "event_type", path, "t")
    read = spark.read.option("pathGlobFilter", "*.srt").text(path, wholetext=True)
    return read.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.srt$", 1).alias("flight_id"), F.col("value").alias("srt"))


_AXIS = (0.6, 0.0, 0.8)


@query(f"""WITH {S}, v AS (SELECT *, value AS seen, value / 40 AS half FROM s WHERE event_type = 'view'), c AS (SELECT event_id, flight_id, t FROM s WHERE event_type = 'click'),
 b AS (SELECT c.*, v.t AS bt, v.seen AS bv, CAST(v.k AS DOUBLE) AS bk, v.half AS bh, v.props AS bp FROM c ASOF LEFT JOIN (SELECT *, 'p' || (k % 5) AS props FROM v) v ON c.flight_id = v.flight_id AND c.t > v.t),
 a AS (SELECT b.*, v.t AS aft, v.seen AS av, CAST(v.k AS DOUBLE) AS ak, v.half AS ah, 'p' || (v.k % 5) AS ap FROM b ASOF LEFT JOIN v ON b.flight_id = v.flight_id AND b.t <= v.t),
 p AS (SELECT *, (t - bt) / greatest(aft - bt, 1e-4) AS part, cos(bh - ah) AS d FROM a),
 w AS (SELECT *, CASE WHEN abs(d) > 0.9999 THEN 1 - part ELSE sin((1 - part) * acos(least(abs(d), 1))) / sin(acos(least(abs(d), 1))) END AS wa, CASE WHEN abs(d) > 0.9999 THEN part ELSE sin(part * acos(least(abs(d), 1))) / sin(acos(least(abs(d), 1))) END * CASE WHEN d < 0 THEN -1 ELSE 1 END AS wb FROM p),
 m AS (SELECT *, wa * cos(bh) + wb * cos(ah) AS mc, wa * sin(bh) + wb * sin(ah) AS ms FROM w),
 x AS (SELECT event_id, CASE WHEN bt IS NULL THEN av WHEN aft IS NULL THEN bv ELSE bv + part * (av - bv) END AS value, CASE WHEN bt IS NULL THEN ak WHEN aft IS NULL THEN bk ELSE bk + part * (ak - bk) END AS k, CASE WHEN bt IS NULL THEN ap ELSE bp END AS phase,
  CASE WHEN bt IS NULL THEN cos(ah) WHEN aft IS NULL THEN cos(bh) ELSE mc / sqrt(mc * mc + ms * ms) END AS qc, CASE WHEN bt IS NULL THEN sin(ah) WHEN aft IS NULL THEN sin(bh) ELSE ms / sqrt(mc * mc + ms * ms) END AS qs FROM m)
SELECT event_id, round(value, 5) AS value, round(k, 5) AS k, phase, round(qc, 4) + 0 AS qw, round({_AXIS[0]} * qs, 4) + 0 AS qx, round({_AXIS[1]} * qs, 4) + 0 AS qy, round({_AXIS[2]} * qs, 4) + 0 AS qz FROM x""")
def playback_whole(spark, sf_dir):
    """Views played back at the times of clicks: two values, a rotation about a slanted axis and a label."""
    s = samples(spark, sf_dir)
    half = F.col("value") / 40
    turned = {"qw": F.cos(half)} | {f"q{a}": F.lit(x) * F.sin(half) for a, x in zip("xyz", _AXIS, strict=True)}
    rows = s.where("event_type = 'view'").select("flight_id", "t", "value", F.col("k").cast("double").alias("k"), F.concat(F.lit("p"), (F.col("k") % 5).cast("string")).alias("phase"), *(c.alias(n) for n, c in turned.items()))
    found = ordered.playback(s.where("event_type = 'click'").select("event_id", "flight_id", "t"), rows, "t", ["value", "k"], list(turned), ["phase"])
    return found.select("event_id", r("value", 5).alias("value"), r("k", 5).alias("k"), "phase", *(r(c, 4).alias(c) for c in turned))


@query(f"""WITH {S}, z AS (SELECT *, count(*) OVER (PARTITION BY flight_id) AS m, first_value(value) OVER (PARTITION BY flight_id ORDER BY n) AS v1, first_value(k) OVER (PARTITION BY flight_id ORDER BY n) AS k1 FROM s),
 p AS (SELECT flight_id, n, value AS x, CAST(k AS DOUBLE) AS y FROM z WHERE NOT (n = m AND m > 1 AND value = v1 AND k = k1)), c AS (SELECT *, max(n) OVER (PARTITION BY flight_id) AS m FROM p),
 t AS (SELECT c.*, a.x AS ax, a.y AS ay, (a.x - b.x) / 2 AS tx, (a.y - b.y) / 2 AS ty FROM c JOIN p a ON a.flight_id = c.flight_id AND a.n = c.n % c.m + 1 JOIN p b ON b.flight_id = c.flight_id AND b.n = (c.n + c.m - 2) % c.m + 1),
 e AS (SELECT t.*, u.tx AS ux, u.ty AS uy, j, j / 3.0::DOUBLE AS h FROM t JOIN t u ON u.flight_id = t.flight_id AND u.n = t.n % t.m + 1, (SELECT unnest(range(3)) AS j))
SELECT flight_id, n, CAST(j AS INT) AS step, round((2 * h ** 3 - 3 * h ** 2 + 1) * x + (h ** 3 - 2 * h ** 2 + h) * tx + (3 * h ** 2 - 2 * h ** 3) * ax + (h ** 3 - h ** 2) * ux, 5) + 0 AS x, round((2 * h ** 3 - 3 * h ** 2 + 1) * y + (h ** 3 - 2 * h ** 2 + h) * ty + (3 * h ** 2 - 2 * h ** 3) * ay + (h ** 3 - h ** 2) * uy, 5) + 0 AS y FROM e""")
def closed_polygon(spark, sf_dir):
    """A flight's events as the corners of a ring, with a smooth line through them."""
    rows = samples(spark, sf_dir).select("flight_id", "n", F.col("value").alias("x"), F.col("k").cast("double").alias("y"))
    return geometry.closed_spline(rows, "n", ["x", "y"], 3).withColumns({"x": r("x", 5), "y": r("y", 5)})
