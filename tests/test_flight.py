import io
import random
import time
from itertools import pairwise

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loftline.functions import geodesy
from loftline.operators import cleaning, phases, spline
from loftline.plans import flight, sinks
from loftline.schemas import TRACK_SPEC, TRAJECTORY_COLUMNS, TRAJECTORY_SPEC, asserted, validate
from loftline.sources import frames, gpmf, igc, video
from loftline.streaming import phases as streaming
from tests.oracle import TABLES


def repaired(alt, t=None, **more):
    pdf = pd.DataFrame({"timestamp_s": np.arange(len(alt), dtype=float) if t is None else t, "alt_gps_m": alt, "weight": 1.0} | more)
    return cleaning.repair_flight(pdf)


def test_drop_becomes_a_line():
    out = repaired([382, 140, 140, 140, 140, 140, 140, 140, 372])
    assert out["alt_gps_m"].tolist() == [int(382 - 10 * i / 8) for i in range(9)]
    assert out["weight"].tolist() == [1.0] + [0.01] * 7 + [1.0]


def test_single_bad_point_and_two_segments():
    assert repaired([400, 140, 390])["alt_gps_m"].tolist() == [400, 395, 390]
    assert repaired([400, 100, 100, 390, 395, 100, 100, 385])["alt_gps_m"].tolist()[5:7] == [391, 388]


def test_whole_heights_are_met_on_a_line():
    out = repaired([40] + [-40] * 13 + [-2])
    assert out["alt_gps_m"].tolist() == [40 - 3 * i for i in range(15)]


def test_drop_without_recovery_stays():
    assert repaired([400, 140, 140, 140])["alt_gps_m"].tolist() == [400, 140, 140, 140]


def test_missed_climb_is_a_ramp():
    out = repaired([140] * 30 + [340], z_m=[0.0] * 30 + [200.0])
    assert out["z_m"].tolist()[10:30] == pytest.approx([10.0 * i for i in range(20)])
    assert out["weight"].tolist()[:10] == [1.0] * 10


def test_repairs_in_spark_match(spark):
    rows = [(f, float(t), int(a)) for f in ("a", "b") for t, a in enumerate([400, 100, 100, 390, 395, 100, 100, 385])]
    got = cleaning.repair_altitude(spark.createDataFrame(rows, "flight_id string, timestamp_s double, alt_gps_m long")).toPandas()
    assert got.sort_values(["flight_id", "timestamp_s"])["alt_gps_m"].tolist() == repaired([400, 100, 100, 390, 395, 100, 100, 385])["alt_gps_m"].tolist() * 2


def test_projection_round_trip():
    r = np.random.default_rng(1)
    lat, lon = 52 + r.random(200), 20 + r.random(200)
    s, z = geodesy.inverse(np.full(200, 52.27), np.full(200, 20.91), lat, lon)
    back = geodesy.direct(52.27, 20.91, s, z)
    assert np.abs(back[0] - lat).max() < 1e-10 and np.abs(back[1] - lon).max() < 1e-10
    assert geodesy.inverse(np.array([1.0]), np.array([2.0]), np.array([1.0]), np.array([2.0]))[0][0] == 0


def test_spline_reaches_the_asked_smoothness():
    t = np.linspace(0, 60, 400)
    y = np.c_[np.sin(t / 5) * 40, t * 2] + np.random.default_rng(0).normal(0, 0.4, (400, 2))
    for k, s in ((5, 0.5 * 400), (3, 400.0)):
        knots, c, degree = spline.fit(t, y, np.ones(400), k, s)
        left = ((spline.evaluate(t, knots, c, degree) - y) ** 2).sum()
        assert left <= s * 1.01
    slope = spline.evaluate(t, knots, c, degree, 1)[20:-20]
    assert np.abs(slope[:, 1] - 2).max() < 1
    with pytest.raises(ValueError):
        spline.fit(np.array([0.0, 1.0, 1.0]), np.zeros((3, 1)), np.ones(3), 3, 1.0)


def test_short_flights_fit():
    for n in range(1, 7):
        t = np.arange(n, dtype=float)
        knots, c, k = spline.fit(t, t[:, None] * 3, np.ones(n), 5, 0.1)
        assert np.allclose(spline.evaluate(t, knots, c, k)[:, 0], t * 3, atol=0.4)


def test_viterbi_beats_other_paths():
    r = np.random.default_rng(3)
    log_b = r.normal(size=(40, 7))
    a = phases.log_transitions()
    score = lambda p: log_b[np.arange(40), p].sum() + sum(a[i, j] for i, j in pairwise(p))
    best = score(phases.best_path(log_b))
    for _ in range(300):
        p, state = [], int(r.integers(7))
        for _ in range(40):
            p.append(state)
            state = int(r.choice(np.flatnonzero(np.isfinite(a[state]))))
        assert score(p) <= best + 1e-9


def test_machine_needs_the_condition_to_hold():
    m = phases.Debounced()
    still = dict.fromkeys(phases.NAMES, False)
    assert [m.step(t, still | {"moving": t != 1.5}) for t in (0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0)] == [0, 0, 1, 1, 1, 1, 1]
    m = phases.Debounced(phases.LANDING)
    assert m.step(0.0, still | {"airborne": True}) == phases.CRUISE


def test_stream_equals_batch(spark, tmp_path):
    r = random.Random(5)
    rows = [(f, float(t), r.random() * 40, r.random() * 4 - 1, r.random() * 80, r.random() * 20 - 10) for f in range(3) for t in range(120)]
    schema = "flight_id long, t double, v double, vz double, agl double, w double"
    whole = spark.createDataFrame(rows, schema)
    want = phases.label_phases(whole, "t", "v", "vz", "agl", "w").toPandas().sort_values(["flight_id", "t"])["phase"].tolist()
    for k in range(3):
        whole.where(f"t >= {40 * k} AND t < {40 * k + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.stream_phases(source, "t", "v", "vz", "agl", "w").writeStream.format("memory").queryName("phases_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("phases_out").toPandas().sort_values(["flight_id", "t"])["phase"].tolist()
    assert got == want


B = "B{0}5216203N02054600EA00000{1:05d}"


def test_logger_file(spark, tmp_path):
    text = ["AXXX123", "HFDTEDATE:080525,01", "HFPLTPILOTINCHARGE: Ann", "HFCM2CREW2: nil", "HFTZNTIMEZONE:2.0", "HFPLTPILOTINCHARGE:Bob", "I013638FXA", "LNOTE", B.format("235959", 100), B.format("235959", 100), B.format("000001", 101), "B12"]
    (tmp_path / "07_x.igc").write_bytes("\r\n".join(text).encode("latin-1"))
    lines = igc.read_lines(spark, str(tmp_path / "*.igc"))
    f = igc.fixes(lines).orderBy("line_no").collect()
    assert [x["timestamp_s"] for x in f] == [0.0, 0.0, 2.0] and [x["alt_gps_m"] for x in f] == [100, 100, 101]
    assert f[0]["gps_lat_deg"] == pytest.approx(52 + 16203 / 60000) and f[0]["flight_id"] == "07_x"
    m = igc.metadata(lines).first()
    assert (m["pilot"], m["copilot"], m["fr_id"], m["num_fixes"], m["timezone_offset_h"], str(m["date"])) == ("Bob", None, "XXX123", 3, 2.0, "2025-05-08")
    assert str(m["gps_start_utc"]) == "2025-05-08 23:59:59"
    assert igc.extensions(lines).first()[1:] == (36, 38, "FXA")


def test_whole_flight(spark):
    r = np.random.default_rng(2)
    t = np.arange(0, 300.0)
    v = np.clip((t - 30) * 1.5, 0, 25) * (t < 260)
    x = np.cumsum(v)
    alt = np.rint(130 + np.clip((t - 45) * 3, 0, 300) * np.clip((260 - t) / 100, 0, 1)).astype(int)
    lat, lon = geodesy.direct(52.2, 20.9, x, np.zeros(300))
    rows = [("f", "home", i, float(s), float(a), float(o), 0, int(h), "A") for i, (s, a, o, h) in enumerate(zip(t, lat, lon + r.normal(0, 1e-7, 300), alt, strict=True))]
    fixes = spark.createDataFrame(rows, "flight_id string, airfield_id string, line_no long, timestamp_s double, gps_lat_deg double, gps_lon_deg double, alt_baro_m long, alt_gps_m long, fix_validity string")
    fields = spark.createDataFrame([("home", 52.2, 20.9, 130.0)], "airfield_id string, lat double, lon double, alt double")
    track = flight.track(fixes, fields).cache()
    assert track.select("phase").distinct().count() >= 3
    out = flight.trajectories(validate(track, TRACK_SPEC), fps=5.0).toPandas()
    assert list(out.columns) == ["flight_id", *TRAJECTORY_COLUMNS, "phase"] and len(out) > 500
    assert out["load_g"].median() == pytest.approx(1.0, abs=0.1) and out["v_mag_ms"].max() < 40
    assert "-->" in sinks.subtitles(track, "phase_hmm").first()["srt"]


def test_validation_reports(spark):
    bad = spark.createDataFrame([("f", 0.0, 1.0, None, 0.0, 1.0, "NOWHERE")], "flight_id string, timestamp_s double, x_m double, y_m double, z_m double, weight double, phase string")
    with pytest.raises(ValueError, match="null_y_m"):
        validate(bad, TRACK_SPEC)
    with pytest.raises(ValueError, match="missing"):
        validate(bad.drop("weight"), TRACK_SPEC)


def test_frames_and_polygons(spark, tmp_path):
    (tmp_path / "s.csv").write_text("frame_id,timestamp_s,video_time_s,z_m\n0001,1.5,0.1,3\n0002,2.5,0.2,x\n")
    got = frames.read_sequence(spark, str(tmp_path / "s.csv")).orderBy("frame_id").collect()
    assert got[0]["frame_id"] == "0001" and got[1]["z_m"] is None
    (tmp_path / "p.json").write_text('{"features": [{"geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, 4], [5, 6]]]}}]}')
    ring = frames.read_polygon(spark, str(tmp_path / "p.json")).orderBy("i").collect()
    assert [(x["lon"], x["lat"]) for x in ring] == [(1, 2), (3, 4), (5, 6), (1, 2)]
    (tmp_path / "t.json").write_text('{"trajectory_points": [{"timestamp": 1, "x": 2, "y": 3, "z": 4, "source": "IGC", "quality": 0.5}]}')
    assert frames.read_points(spark, str(tmp_path / "t.json")).first()["source"] == "IGC"
    (tmp_path / "g.csv").write_text("Timestamp_S, X_m,y_m,z_m\n1,2,3,4\n2,,3,4\n")
    assert [x["load_g"] for x in frames.read_playback(spark, str(tmp_path / "g.csv")).collect()] == [1.0]


def test_camera_boxes():
    import struct

    box = lambda kind, body: struct.pack(">I4s", 8 + len(body), kind) + body
    data = box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", b"1234") + box(b"udta", box(b"GPMF", b"payload")))
    f = io.BytesIO(data)
    _, a, z = video.inside(f, 0, len(data), "moov", "udta", "GPMF")
    assert data[a:z] == b"payload" and video.inside(f, 0, len(data), "moov", "none") is None
    wide = struct.pack(">I4sQ", 1, b"moov", 20) + b"1234" + struct.pack(">I4s", 0, b"mdat") + b"rest"
    assert list(video.boxes(io.BytesIO(wide), 0, len(wide))) == [("moov", 16, 20)]
    assert gpmf.number("?", 1, b"x") is None and gpmf.number("L", 4, b"") is None
    assert gpmf.numbers("s", 6, struct.pack(">6h", 1, 2, 3, 4, 5, 6)) == [[1, 2, 3], [4, 5, 6]]
    assert gpmf.text(b"abc\0\0") == "abc"


def dense_rows(t, w, knots, k):
    at, b = spline.basis(t, knots, k)
    rows = np.zeros((len(t), len(knots) - k - 1))
    for i in range(k + 1):
        rows[np.arange(len(t)), at - k + i] = b[:, i]
    return rows * w[:, None]


def test_banded_factorisation_equals_dense_least_squares():
    r = np.random.default_rng(0)
    for n, step, size in ((40, 3, 64), (200, 3, 16), (200, 2, 7), (150, 40, 16)):
        t, w = np.cumsum(r.exponential(1, n)), r.uniform(0.5, 2, n)
        y = r.standard_normal((n, 2))
        knots = spline._knots(t, t[5 : n - 5 : step], 5)
        at, b = spline.basis(t, knots, 5)
        band = spline.factored(at - 5, b * w[:, None], y * w[:, None], len(knots) - 6, size)
        want, rest = np.linalg.lstsq(dense_rows(t, w, knots, 5), y * w[:, None], rcond=None)[:2]
        got = band.solve()
        assert band.regular() and got == pytest.approx(want, abs=1e-7)
        assert band.misfit(got) == pytest.approx(rest, rel=1e-8, abs=1e-12)
        assert band.misfit(got + 0.1) == pytest.approx(((dense_rows(t, w, knots, 5) @ (got + 0.1) - y * w[:, None]) ** 2).sum(0))


@settings(deadline=None, max_examples=150)
@given(st.integers(1, 100), st.integers(0, 2**31), st.sampled_from(["walk", "noise", "gaps", "weights", "far"]), st.sampled_from([(5, 0.5), (3, 1.0), (4, 0.01), (5, 500.0), (5, 0.0), (1, 0.1)]))
def test_splines_reach_their_target(n, seed, kind, how):
    r, (k, each) = np.random.default_rng(seed), how
    t = np.arange(n, dtype=float) if kind == "walk" else np.cumsum(r.exponential(1, n) + 1e-3)
    if kind == "gaps":
        t = np.cumsum(np.where(r.random(n) < 0.1, 1000.0, 1.0) * r.random(n) + 1e-4)
    y = np.cumsum(r.normal(size=(n, 2)), 0) if kind in ("walk", "gaps") else r.random((n, 2)) * 100 + (1e7 if kind == "far" else 0)
    w = np.where(r.random(n) < 0.2, 0.01, 1.0) if kind == "weights" else np.ones(n)
    knots, c, degree = spline.fit(t, y, w, k, each * n)
    left = (((spline.evaluate(t, knots, c, degree) - y) * w[:, None]) ** 2).sum()
    assert np.isfinite(c).all() and left <= 1.001 * each * n + 1e-11 * (y**2).sum()
    assert (np.diff(knots) >= 0).all() and len(knots) == len(c) + degree + 1


def test_a_sum_next_to_the_target_keeps_the_degree():
    t, y = np.arange(30.0), np.random.default_rng(2230).integers(0, 100, (30, 2)).astype(float)
    knots, c, k = spline.fit(t + 1, y, np.ones(30), 5, 15.0)
    assert k == 5 and 0.998 * 15 <= ((spline.evaluate(t + 1, knots, c, k) - y) ** 2).sum() <= 1.001 * 15


def test_short_flights_meet_the_target_as_sql_says(spark, tmp_path):
    """Seven rows that a polynomial meets, but no straight line."""
    from loftline.plans.queries import QUERIES, SQL
    from tests.oracle import compare

    rows = [(u * 100 + n, f"2024-01-01 00:00:{n:02d}", u, "view", float(n * n), f'{{"k": {n % 3}}}') for u in range(1, 12) for n in range(u)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    for t in set(TABLES) - {"events"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    for name in ("spline_target", "spline_values"):
        compare(spark, str(tmp_path), QUERIES[name], SQL[name])


def test_values_of_splines_equal_fits_and_evaluation(spark):
    """Flights longer and shorter than a batch; one exchange."""
    r = np.random.default_rng(2)
    rows = [(f, float(t), float(r.normal()), float(r.integers(9)), t + 0.25) for f, n in (("a", 1), ("b", 2), ("c", 90), ("d", 7), ("e", 30), ("f", 3)) for t in range(n)]
    df = spark.createDataFrame(rows, "flight_id string, timestamp_s double, x double, y double, later double").repartition(3)
    asked = [spline.Spline(5, 0.5, [(["fx", "fy"], "timestamp_s", 0), (["vx", "vy"], "later", 1)], "inner"), spline.Spline(1, 0.0, [(["gx", "gy"], "later", 0)])]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        found = spline.spline_values(df, ["x", "y"], asked)
        plan = found._jdf.queryExecution().executedPlan().toString()
        found = found.toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert len(found) == len(rows) and plan.count("Exchange hashpartitioning") == 1
    for _, p in found.groupby("flight_id"):
        p = p.sort_values("timestamp_s")
        t, y = p["timestamp_s"].to_numpy(), p[["x", "y"]].to_numpy()
        one, two = (spline.fit(t, y, np.ones(len(t)), k, s * len(t)) for k, s in ((5, 0.5), (1, 0.0)))
        assert np.allclose(p[["fx", "fy"]], spline.evaluate(t, *one)) and np.allclose(p[["gx", "gy"]], spline.evaluate(t + 0.25, *two))
        assert np.allclose(p[["vx", "vy"]], spline.evaluate(t + 0.25, *one, derivative=1) if one[2] else 0) and (p["inner"] == len(one[1]) - one[2] - 1).all()


def test_interpolation_goes_straight_to_its_knots(monkeypatch):
    solved, whole = [], spline._least_squares
    monkeypatch.setattr(spline, "_least_squares", lambda *x: solved.append(x) or whole(*x))
    t, y = np.arange(67.0), np.random.default_rng(0).random((67, 1)) * 100
    for k, most in ((5, 1), (4, 1), (1, 0)):
        solved.clear()
        assert spline.evaluate(t, *spline.fit(t, y, np.ones(67), k, 0.0)) == pytest.approx(y, abs=1e-9) and len(solved) == most


def test_all_derivatives_at_once():
    r = np.random.default_rng(0)
    for n, k in ((60, 5), (60, 3), (9, 2), (2, 1), (1, 0)):
        t = np.cumsum(r.random(n) + 0.1)
        fit = spline.fit(t, r.random((n, 2)), np.ones(n), k, 0.01)
        at = np.linspace(t[0] - 0.1, t[-1] + 0.1, 200)
        for d, x in enumerate(spline.derivatives(at, *fit, 3)):
            assert np.allclose(x, spline.evaluate(at, *fit, derivative=d) if d <= fit[2] else 0, rtol=1e-12)


def test_smoothest_of_the_close_ones():
    """With s between the polynomial's and no residual the sum is s, and dense equations with that penalty agree."""
    r = np.random.default_rng(4)
    t, y = np.arange(60.0), r.random((60, 1)) * 10
    knots, c, k = spline.fit(t, y, np.ones(60), 3, 200.0)
    rows = dense_rows(t, np.ones(60), knots, k)
    assert ((rows @ c - y) ** 2).sum() == pytest.approx(200.0, rel=1.1e-3)
    d = np.zeros((len(knots) - 2 * k - 2, len(c)))
    jumps = spline._jumps(knots, k)
    for i, x in enumerate(jumps):
        d[i, i : i + k + 2] = x
    # At the optimum the residuals' gradient is a multiple of the jumps'.
    pull, bend = rows.T @ (y - rows @ c), d.T @ (d @ c)
    assert np.abs(pull - bend * (pull * bend).sum() / (bend**2).sum()).max() < 1e-5 * np.abs(pull).max()


def test_long_flight_in_seconds():
    t = np.arange(20_000.0)
    y = np.random.default_rng(1).random((20_000, 2)) * 100
    began = time.process_time()
    knots, c, k = spline.fit(t, y, np.ones(20_000), 5, 10_000.0)
    assert time.process_time() - began < 30
    assert ((spline.evaluate(t, knots, c, k) - y) ** 2).sum() == pytest.approx(10_000, rel=2e-3)


def test_a_trajectory_of_chunks_is_one_trajectory(spark):
    r = np.random.default_rng(3)
    rows = [(f, float(t), float(20 * t + r.normal()), float(300 * np.sin(t / 9)), float(100 + r.normal()), 1.0, "CRUISING") for f, n in (("a", 90), ("b", 7), ("c", 1)) for t in range(n)]
    tracks = spark.createDataFrame(rows, "flight_id string, timestamp_s double, x_m double, y_m double, z_m double, weight double, phase string")
    fits = flight.fit_tracks(tracks)
    whole = flight.sample_fits(fits, 10.0).toPandas().sort_values(["flight_id", "i"])
    out = flight.trajectories(tracks, fps=10.0, chunk=100).toPandas().sort_values(["flight_id", "timestamp_s"])
    assert out.groupby("flight_id").size().to_dict() == {"a": 890, "b": 60} and list(out.columns) == ["flight_id", *TRAJECTORY_COLUMNS, "phase"]
    assert out["x_m"].tolist() == whole["x_m"].tolist()
    # The same in NumPy, a flight at once.
    for f in ("a", "b"):
        a, b = out[out["flight_id"] == f], whole[whole["flight_id"] == f]
        yaw = np.unwrap(np.arctan2(b["vy_ms"], b["vx_ms"]))
        assert np.allclose(a["yaw_rad"], (spline.gaussian(yaw, 15.0) + np.pi) % (2 * np.pi) - np.pi, atol=1e-9)
        roll = np.arctan2((b["vy_ms"] * b["ax_ms2"] - b["vx_ms"] * b["ay_ms2"]) / np.hypot(b["vx_ms"], b["vy_ms"]), 9.81)
        assert np.allclose(a["roll_rad"], spline.gaussian(roll.to_numpy(), 15.0), atol=1e-9)


def test_samples_are_not_exchanged(spark):
    rows = [(f, float(t), float(t % 7), 1.0, 2.0, 1.0, "CRUISING") for f, n in (("a", 80), ("b", 2), ("c", 1), ("d", 30)) for t in range(n)]
    tracks = spark.createDataFrame(rows, "flight_id string, timestamp_s double, x_m double, y_m double, z_m double, weight double, phase string")
    for chunk in (100, 1 << 15):
        found = flight.trajectories(tracks, fps=10.0, chunk=chunk, ahead=("x_m",))
        assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        out = found.toPandas()
        assert out.groupby("flight_id").size().to_dict() == {"a": 790, "b": 10, "d": 290}
        assert all(p["timestamp_s"].is_monotonic_increasing and p["next_x_m"].iloc[:-1].tolist() == p["x_m"].iloc[1:].tolist() and p["next_x_m"].isna().iloc[-1] for _, p in out.groupby("flight_id"))


def test_smoothing_by_parts_equals_the_whole():
    x = np.random.default_rng(0).random(500)
    for sigma in (0.1, 2.0, 30.0, 200.0):
        halo = int(4 * sigma + 0.5)
        parts = [spline.gaussian(x[max(0, lo - halo) : lo + 170 + halo], sigma, min(lo, halo), max(0, min(500, lo + 170 + halo) - min(500, lo + 170))) for lo in range(0, 500, 170)] if halo <= 170 else []
        if parts:
            assert np.concatenate(parts) == pytest.approx(spline.gaussian(x, sigma))


def test_bad_trajectories_raise(spark):
    row = dict.fromkeys(TRAJECTORY_COLUMNS, 1.0) | {"flight_id": "f", "phase": "CRUISING"}
    good = spark.createDataFrame([row])
    assert asserted(good, TRAJECTORY_SPEC).count() == 1
    for change in ({"pitch_rad": float("nan")}, {"x_m": None}, {"phase": "NOWHERE"}):
        bad = spark.createDataFrame([row | change], good.schema)
        with pytest.raises(Exception, match="violations: "):
            asserted(bad, TRAJECTORY_SPEC).collect()
        with pytest.raises(ValueError, match="violations"):
            validate(bad, TRAJECTORY_SPEC)
    with pytest.raises(ValueError, match="missing"):
        asserted(good.drop("az_ms2"), TRAJECTORY_SPEC)
    assert flight.checked_track(spark.createDataFrame([("f", 0.0, 1.0, 1.0, 1.0, 1.0)], "flight_id string, timestamp_s double, x_m double, y_m double, z_m double, weight double")).count() == 1


def stepped(t, flags):
    """The phase machine row by row, as its rules read."""
    state, held, last, out = phases.PRE, [0.0, 0.0], None, []
    for i, at in enumerate(t):
        dt, last = (0.0 if last is None else at - last), at
        if state in (phases.LANDING, phases.POST) and flags["airborne"][i]:
            state, held = phases.CRUISE, [0.0, 0.0]
        for k, (name, seconds, following) in enumerate(phases.RULES[state]):
            held[k] = held[k] + dt if flags[name][i] else 0.0
            if flags[name][i] and held[k] >= seconds:
                state, held = following, [0.0, 0.0]
                break
        out.append(state)
    return out


@settings(deadline=None, max_examples=150)
@given(st.integers(1, 300), st.integers(0, 2**31))
def test_machine_by_events_equals_row_by_row(n, seed):
    r = np.random.default_rng(seed)
    t = np.cumsum(r.choice([0.055, 0.1, 0.3, 1.0], n))
    flags = {name: np.repeat(r.random(n) < r.random(), int(r.integers(1, 30)))[:n] for name in phases.NAMES}
    machine, got, i = phases.Debounced(), [], 0
    while i < n:  # in batches
        j = i + int(r.integers(1, n + 1))
        got += machine.run(t[i:j], {k: f[i:j] for k, f in flags.items()}).tolist()
        i = j
    assert got == stepped(t, flags)


def test_machine_on_ten_million_rows():
    t = np.arange(10_000_000) / 18
    on = t / 300 % 2 < 1
    flags = {name: on if k % 2 else ~on for k, name in enumerate(phases.NAMES)}
    began = time.process_time()
    states = phases.Debounced().run(t, flags)
    assert time.process_time() - began < 30 and states[:20_000].tolist() == stepped(t[:20_000], flags)


@settings(deadline=None, max_examples=150)
@given(st.integers(1, 150), st.integers(0, 2**31))
def test_spikes_equal_row_by_row(n, seed):
    r = np.random.default_rng(seed)
    t, v = np.cumsum(r.random(n)), np.cumsum(r.normal(size=n)) * r.choice([1, 20]) + (r.random(n) < 0.1) * 100
    v[r.random(n) < 0.05] = np.nan
    want, last = [], None
    for a, b in zip(t, v, strict=True):
        want.append(bool(not np.isnan(b) and (last is None or abs(b - last[1]) <= 5 * (a - last[0]))))
        last = (a, b) if want[-1] else last
    assert cleaning.steady(t, v, 5.0).tolist() == want


def test_flights_stream_through_small_batches(spark):
    """Rows of a flight over many batches, null keys, other columns kept as they are."""
    r = np.random.default_rng(8)
    rows = [(f, float(t), float(r.random() * 100), None if t % 7 == 0 else t, float(r.random() * 40)) for f in ("a", "b", None) for t in range(200)]
    df = spark.createDataFrame(rows, "flight_id string, timestamp_s double, z double, n int, v double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = []
    for n in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        labels = phases.label_phases(df, "timestamp_s", "v", "v", "z", "z")
        found.append((sorted(map(str, cleaning.without_spikes(df, "z", 20.0).collect())), sorted(map(str, labels.collect()))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found[0] == found[1] and len(found[0][1]) == 600 and 3 < len(found[0][0]) < 600


def test_projection_of_columns_equals_that_of_arrays(spark):
    r = np.random.default_rng(6)
    lat, lon = np.concatenate([r.uniform(-89, 89, 300), [52.27, -52.27, 0.0, 90.0]]), np.concatenate([r.uniform(-60, 100, 300), [20.91, -159.09, 20.91, 20.91]])
    rows = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(lat, lon, strict=True))] + [(1000, None, 1.0)], "k int, lat double, lon double")
    local = geodesy.to_local(rows, "lat", "lon", F.lit(52.27), F.lit(20.91))
    assert local.columns == ["k", "lat", "lon", "x_m", "y_m"]
    got = geodesy.to_globe(local, "x_m", "y_m", F.lit(52.27), F.lit(20.91)).toPandas().sort_values("k")
    assert got["x_m"].isna().tolist() == [False] * 301 + [True, False, False, True]  # nearly opposite, and null
    near = got[got["x_m"].notna()]
    s, z = geodesy.inverse(np.full(len(near), 52.27), np.full(len(near), 20.91), near["lat"].to_numpy(), near["lon"].to_numpy())
    assert np.abs(near["x_m"] - s * np.sin(z)).max() < 1e-3 and np.abs(near["y_m"] - s * np.cos(z)).max() < 1e-3
    assert np.abs(near["lat_deg"] - near["lat"]).max() < 1e-9
    assert np.abs(near["lon_deg"] - near["lon"])[near["lat"].abs() < 89.9].max() < 1e-7
