"""From files to tracks: recordings, listings, records."""

import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loftline.operators import cleaning, geometry, ordered
from loftline.plans import files, flight, sinks
from loftline.sources import discovery, gpmf, igc, recordings, video


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), kind) + body


def item(key: bytes, kind: bytes, size: int, repeat: int, body: bytes) -> bytes:
    return struct.pack(">4scBH", key, kind, size, repeat) + body + b"\0" * (-len(body) % 4)


def nested(key: bytes, body: bytes) -> bytes:
    return item(key, b"\0", 1, len(body), body)


def payload(k: int, n: int = 18) -> bytes:
    """A second of flight to the east at about 20 m/s, n positions and n accelerations."""
    t = k + np.arange(n) / n
    rows = np.c_[np.full(n, 52.27e7), (20.91 + t * 20 / 68300) * 1e7, np.full(n, 400e3), np.full(n, 20e3), np.full(n, 20e2)].astype(int)
    gps = item(b"STMP", b"J", 8, 1, struct.pack(">Q", k * 1_000_000)) + item(b"GPSF", b"L", 4, 1, struct.pack(">I", 3)) + item(b"GPSP", b"S", 2, 1, struct.pack(">H", 150))
    gps += item(b"GPSU", b"c", 16, 1, b"2105021000%02d.000" % k) + item(b"SCAL", b"l", 4, 5, struct.pack(">5i", 10**7, 10**7, 1000, 1000, 100)) + item(b"GPS5", b"l", 20, n, b"".join(struct.pack(">5i", *r) for r in rows))
    pull = item(b"STMP", b"J", 8, 1, struct.pack(">Q", k * 1_000_000)) + item(b"SCAL", b"s", 2, 1, struct.pack(">h", 100)) + item(b"ACCL", b"s", 6, n, struct.pack(">3h", 0, 0, 981) * n)
    empty = item(b"STMP", b"J", 8, 0, b"") + item(b"GYRO", b"s", 6, 0, b"")
    return nested(b"DEVC", nested(b"STRM", gps) + nested(b"STRM", pull) + nested(b"STRM", empty))


def recording(payloads: list[bytes], chunks: list[int], other_first: bool = True) -> bytes:
    """An MP4 with a video track and a telemetry track whose packets lie in chunks of the given numbers of packets."""
    head = box(b"ftyp", b"isom")
    at, places, i = len(head) + 8, [], 0
    for n in chunks:
        places.append(at)
        at += sum(map(len, payloads[i : i + n]))
        i += n
    full = lambda kind, body: box(kind, b"\0\0\0\0" + body)
    count = lambda rows, kinds: struct.pack(">I", len(rows)) + b"".join(struct.pack(">" + kinds, *r) for r in rows)
    runs = [(k + 1, n, 1) for k, n in enumerate(chunks) if k == 0 or chunks[k - 1] != n]
    tables = full(b"stsd", struct.pack(">II4s", 1, 16, b"gpmd") + b"\0" * 8) + full(b"stts", count([(len(payloads), 1001)], "II"))
    tables += full(b"stsz", struct.pack(">I", 0) + count([(len(p),) for p in payloads], "I")) + full(b"stsc", count(runs, "III")) + full(b"stco", count([(p,) for p in places], "I"))
    track = box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 1000, 0)) + box(b"minf", box(b"stbl", tables))))
    seen = box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 25, 0)) + box(b"minf", box(b"stbl", full(b"stsd", struct.pack(">II4s", 1, 16, b"avc1"))))))
    settings = box(b"udta", box(b"GPMF", nested(b"DEVC", item(b"VFOV", b"c", 1, 1, b"W"))))
    return head + box(b"mdat", b"".join(payloads)) + box(b"moov", (seen + track if other_first else track + seen) + settings)


AIRFIELD = "airfield_id string, lat double, lon double, alt double"


def test_recording_to_track(spark, tmp_path):
    data = [payload(k) for k in range(12)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "f1.mp4").write_bytes(recording(data, [5, 5, 2]))
    (tmp_path / "a" / "f2.MP4").write_bytes(recording(data[:3], [1, 2], other_first=False))
    (tmp_path / "a" / "none.mp4").write_bytes(box(b"ftyp", b"isom"))
    found = video.read_payloads(spark, str(tmp_path / "a"))
    rows = sorted(found.collect(), key=lambda r: (r["flight_id"], r["payload"]))
    assert [(r["flight_id"], r["payload"], bytes(r["data"]) == data[r["payload"]]) for r in rows] == [("f1", k, True) for k in range(12)] + [("f2", k, True) for k in range(3)]
    assert rows[2]["pts"] == pytest.approx(2.002) and rows[2]["duration"] == pytest.approx(1.001)
    parsed = gpmf.parse_payloads(found)
    assert {r["flight_id"]: str(r["start"]) for r in gpmf.first_clock(parsed).collect()} == dict.fromkeys(("f1", "f2"), "2021-05-02 10:00:00")
    gps = gpmf.gps_track(parsed)
    first = gps.where("flight_id = 'f1'").orderBy("timestamp_s").first()
    assert (first["gps_lat_deg"], first["gps_alt_m"], first["gps_dop"], first["accl_z_ms2"]) == (52.27, 400.0, 1.5, 9.81)
    assert [(r["flight_id"], r["key"], r["value"]) for r in gpmf.read_settings(spark, str(tmp_path / "a")).orderBy("flight_id").collect()] == [("f1", "VFOV", "W"), ("f2", "VFOV", "W")]
    airfields = spark.createDataFrame([("here", 52.27, 20.91, 100.0)], AIRFIELD)
    track = flight.camera_track(gps.withColumn("airfield_id", F.lit("here")), airfields).toPandas()
    one = track[track["flight_id"] == "f1"].sort_values("timestamp_s")
    assert len(one) > 200 and np.allclose(np.diff(one["x_m"]) / np.diff(one["timestamp_s"]), 20, atol=1.5) and set(one["weight"]) == {1 / 1.5}
    with pytest.raises(Exception, match="airfield_id is not in the registry: gone"):
        flight.camera_track(gps.withColumn("airfield_id", F.lit("gone")), airfields).count()


def test_logs_and_videos_to_tracks(spark, tmp_path):
    for name in ("logs", "videos"):
        (tmp_path / name).mkdir()
    lines = [f"B1000{k:02d}5216200N0205{4600 + 18 * k:04d}EA{400:05d}{400:05d}" for k in range(50)]
    (tmp_path / "logs" / "f1.igc").write_text("AXXX\n" + "\n".join(lines))
    (tmp_path / "videos" / "f1.mp4").write_bytes(recording([payload(k) for k in range(6)], [6]))
    records = spark.createDataFrame([("f1", "here")], "flight_tag string, airfield_id string")
    log, camera = flight.files_to_tracks(spark, str(tmp_path / "logs"), str(tmp_path / "videos"), records, spark.createDataFrame([("here", 52.27, 20.91, 100.0)], AIRFIELD))
    assert log.count() == 50 and camera.count() > 90
    layers = {r["layer"]: len(r["coordinates"]) for r in flight.flight_lines(log, 52.27, 20.91, "log", flight.PRESETS["log_line"]).collect()}
    assert layers == {"Raw log": 50, "Smooth log": 2450}
    features = sinks.feature_collection(flight.flight_lines(camera, 52.27, 20.91, "camera", flight.PRESETS["camera_line"]), "flight_id")
    assert features.select(F.size(F.from_json("geojson", "features array<struct<type:string>>")["features"])).first()[0] == 2


def test_glider_of_each_flight(spark):
    t = np.arange(40.0)
    rows = [(f, float(x), 20 * float(x), float(x) ** 1.5, 300.0, 1.0, "CRUISING", mass, 12.51, 15.0) for f, mass in (("a", 340.0), ("b", 600.0)) for x in t]
    tracks = spark.createDataFrame(rows, "flight_id string, timestamp_s double, x_m double, y_m double, z_m double, weight double, phase string, mass_kg double, wing_area_m2 double, wingspan_m double")
    pitch = {r["flight_id"]: r["p"] for r in flight.trajectories(tracks, 5.0).groupBy("flight_id").agg(F.avg("pitch_rad").alias("p")).collect()}
    assert pitch["b"] > pitch["a"] + 0.01
    plain = flight.trajectories(tracks.drop("mass_kg"), 5.0).groupBy("flight_id").agg(F.avg("pitch_rad").alias("p")).collect()
    assert plain[0]["p"] == pytest.approx(pitch["a"])


def test_files_of_flights(spark, tmp_path):
    paths = spark.createDataFrame([("/x/1_a.yaml",), ("/x/2_a.yaml",), ("/y/2_b.yaml",), ("/x/a_1_b.csv",), ("/x/tag.MP4",)], "path string")
    uids = lambda *names: spark.createDataFrame([(n,) for n in names], "flight_uid string")
    assert discovery.flight_records(paths, uids("1")).first()["record_path"] == "/x/1_a.yaml"
    for uid, what in (("2", "more than one record found for 2"), ("3", "no record found for 3")):
        with pytest.raises(Exception, match=what):
            discovery.flight_records(paths, uids(uid)).collect()
    sequences = spark.createDataFrame([("a",), ("a_1",)], "sequence string")
    assert {r["sequence"]: r["actor"] for r in discovery.sequence_actors(paths, sequences).collect()} == {"a": "1_b", "a_1": "b"}
    tags = spark.createDataFrame([("tag",), ("none",)], "flight_tag string")
    assert {r["flight_tag"]: (r["video_path"], r["log_path"]) for r in discovery.flight_media(paths, tags).collect()} == {"tag": ("/x/tag.MP4", None), "none": (None, None)}
    (tmp_path / "1_a.yaml").write_text("flight_uid: '1'\nflight_tag: tag\nairfield_id: here\nqnh_hpa: 1013\n")
    row = discovery.read_flight_records(spark, str(tmp_path / "1_a.yaml")).first()
    assert (row["flight_uid"], row["flight_tag"], row["glider_id"], row["airfield_id"], row["qnh_hpa"]) == ("1", "tag", "szd_51_junior", "here", 1013.0)
    assert discovery.absolute("a/b", "/r") == "/r/a/b" and discovery.absolute("/a", "/r") == "/a"
    assert [p["path"].rsplit("/", 1)[-1] for p in discovery.listing(spark, str(tmp_path)).collect()] == ["1_a.yaml"]


def test_windows_and_bounds(spark):
    t = [1000.0 + 10 * k for k in range(9)]
    v = [1.0, 2.0, 15.0, 20.0, 25.0, 22.0, 18.0, 12.0, 1.0]
    rows = spark.createDataFrame([("a", x, y) for x, y in zip(t, v, strict=True)] + [("b", 1000.0, None), ("b", 1010.0, None), ("c", 1000.0, 4.0), ("c", 1002.0, 1.0)], "flight_id string, timestamp_s double, speed double")
    found = {r["flight_id"]: (r["takeoff"], r["landing"]) for r in ordered.window_of_flight(rows, "speed", 2.78, 5.0).collect()}
    assert found == {"a": (1020.0, 1070.0), "b": (None, None), "c": (None, 1000.0)}
    assert ordered.within_window(rows, ordered.window_of_flight(rows, "speed", 2.78, 5.0)).groupBy("flight_id").count().orderBy("flight_id").collect() == [("a", 6), ("b", 2), ("c", 1)]
    points = spark.createDataFrame([(52.0, 20.0, 100.0), (95.0, 20.0, 110.0), (52.0, 185.0, 120.0), (52.0, 20.0, 25000.0), (53.0, 21.0, None)], "latitude double, longitude double, altitude_msl double")
    assert cleaning.within_bounds(points).count() == 2
    assert geometry.altitude_plot(spark.createDataFrame([("a", 1.0, 2.0, "CRUISING"), ("a", 2.0, 2.0, "?")], "flight_id string, timestamp_s double, z_m double, phase_hmm string")).orderBy("timestamp_s").select("colour").collect() == [("blue",), (None,)]
    assert spark.createDataFrame([("IGC",), ("x",)], "s string").select(geometry.material(F.col("s"))).collect() == [("IGC",), ("UNKNOWN",)]


def test_a_large_recording_is_many_tasks(spark, tmp_path):
    data = [payload(k, 60) for k in range(60)]
    (tmp_path / "one.MP4").write_bytes(recording(data, [7, 20, 20, 13]))
    (tmp_path / "none.mp4").write_bytes(box(b"ftyp", b"isom"))
    (tmp_path / "cut.mp4").write_bytes(recording(data[:4], [4])[:2500])
    size = (tmp_path / "one.MP4").stat().st_size
    found = recordings.read_recordings(spark, str(tmp_path), split=size // 10)
    assert found.rdd.getNumPartitions() >= 11
    want = gpmf.parse_payloads(video.read_payloads(spark, str(tmp_path)))
    key = lambda r: (r["flight_id"], r["payload"], r["stream"])
    assert sorted(found.collect(), key=key) == sorted(want.collect(), key=key) and found.count() == 180
    filled = [n for n in found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(filled) >= 8 and max(filled) <= 24
    # Each packet is read by one split, and little besides: the tables and nothing else.
    reader = recordings.RecordingReader(str(tmp_path / "one.MP4"), size // 10, frozenset(["ACCL"]))
    seen = []
    opened = video.opened

    class Counted:
        def __init__(self, path):
            self.f = opened(path)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            seen.append(n)
            return self.f.read(n)

    video.opened = Counted
    try:
        rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    finally:
        video.opened = opened
    assert [r["payload"] for r in rows] == list(range(60)) and {r["stream"] for r in rows} == {"ACCL"}
    assert sum(seen) < sum(map(len, data)) + len(reader.partitions()) * 1500
    assert recordings.read_recordings(spark, str(tmp_path), "GPS5").select("stream").distinct().collect() == [("GPS5",)]
    with pytest.raises(Exception, match="unknown streams"):
        recordings.read_recordings(spark, str(tmp_path), "NOPE").count()
    assert recordings.read_recordings(spark, str(tmp_path / "none.mp4")).count() == 0


def motion(k: int, n: int, others: dict[bytes, tuple[int, int]]) -> bytes:
    """A second of accelerations (i, 0, 0), turned, and other streams: rows and width, with values from 0 to 1 over the second."""
    stamp = item(b"STMP", b"J", 8, 1, struct.pack(">Q", k * 1_000_000))
    scale = item(b"SCAL", b"s", 2, 1, struct.pack(">h", 1000))
    parts = nested(b"STRM", stamp + scale + item(b"ORIN", b"c", 3, 1, b"XyZ") + item(b"ACCL", b"s", 6, n, b"".join(struct.pack(">3h", i, i, 0) for i in range(n))))
    for name, (m, width) in others.items():
        rows = b"".join(struct.pack(f">{width}h", *[1000 * i // m + 1000 * k] * width) for i in range(m))
        parts += nested(b"STRM", stamp + scale + item(name, b"s", 2 * width, m, rows))
    return nested(b"DEVC", parts)


def test_table_of_all_sensors(spark, tmp_path):
    (tmp_path / "same.mp4").write_bytes(recording([motion(k, 8, {b"GYRO": (8, 3), b"CORI": (4, 4), b"GRAV": (2, 3)}) for k in range(3)], [3]))
    (tmp_path / "less.mp4").write_bytes(recording([motion(k, 8, {b"GYRO": (4, 3)}) for k in range(3)], [3]))
    (tmp_path / "gps.mp4").write_bytes(recording([payload(k) for k in range(3)], [3]))
    found = recordings.sensor_table(recordings.read_recordings(spark, str(tmp_path))).toPandas().sort_values(["flight_id", "timestamp_s"])
    same, less = found[found["flight_id"] == "same"], found[found["flight_id"] == "less"]
    assert len(same) == len(less) == 24 and len(found) == 48 + 54
    t = same["timestamp_s"].to_numpy()
    assert same["accl_x_ms2"].tolist() == [k % 8 / 1000 for k in range(24)] and same["accl_y_ms2"].tolist() == [-k % 8 / -1000 * -1 if k % 8 == 0 else -(k % 8) / 1000 for k in range(24)]
    assert same["gyro_x_rads"].tolist() == [(1000 * (k % 8) // 8 + 1000 * (k // 8)) / 1000 for k in range(24)]
    step = 1.001 / 4
    at = np.concatenate([k + np.arange(4) * step for k in range(3)])
    want = np.interp(t, at, np.concatenate([k + np.arange(4) / 4 for k in range(3)]))
    assert np.allclose(same["cori_w"], want, atol=1e-6) and np.allclose(less["gyro_z_rads"], want, atol=1e-6)
    assert same["iori_w"].isna().all() and less["grav_x"].isna().all() and not same["grav_x"].isna().any()
    recordings.write_recordings(spark, str(tmp_path), str(tmp_path / "out"))
    tables = {n: spark.read.parquet(str(tmp_path / "out" / n)) for n in ("gps", "sensors", "info")}
    assert tables["sensors"].count() == len(found) and tables["gps"].count() == 54 and tables["info"].count() == 3
    assert tables["info"].where("flight_id = 'gps'").first()["settings"] == {"field_of_view": "W"}


def test_files_of_texts(spark, tmp_path):
    out = tmp_path / "out"
    read = lambda: {p.name: p.read_text() for p in out.iterdir()}
    texts = spark.createDataFrame([("a", "one\n"), ("b", None), ("c", "é")], "flight_id string, text string").repartition(3)
    files.write_texts(texts, str(out), ".srt")
    assert read() == {"a.srt": "one\n", "b.srt": "", "c.srt": "é"}
    files.write_texts(texts.where("flight_id = 'a'").withColumn("flight_id", F.lit("d")), str(out), ".srt", "append")
    (out / "other.csv").write_text("x")
    before = read()
    for bad, mode in ((texts.where("flight_id = 'a'"), "append"), (texts.unionByName(texts), "overwrite"), (texts.withColumn("flight_id", F.lit("../x")), "overwrite"), (texts.withColumn("text", F.raise_error(F.lit("lost")).cast("string")), "overwrite")):
        with pytest.raises(Exception):  # noqa: B017
            files.write_texts(bad, str(out), ".srt", mode)
        assert read() == before
    files.write_texts(texts.where("flight_id = 'c'"), str(out), ".srt")
    assert read() == {"c.srt": "é", "other.csv": "x"}


def test_files_equal_the_texts(spark, tmp_path):
    rows = [(f, float(t), float(t) ** 2, 1.0, "CRUISING" if t < 3 else "THERMALLING") for f in ("a", "b") for t in range(6)]
    df = spark.createDataFrame(rows, "flight_id string, timestamp_s double, x double, y double, phase string")
    files.write_subtitles(df, "phase", str(tmp_path / "srt"))
    assert (tmp_path / "srt" / "a.srt").read_text() == "1\n00:00:00,000 --> 00:00:02,000\nCRUISING until 00:00:02,000\n\n2\n00:00:03,000 --> 00:00:05,000\nTHERMALLING until 00:00:05,000\n\n"
    files.write_indexed(df, ["timestamp_s", "phase"], "timestamp_s", str(tmp_path / "csv"))
    assert (tmp_path / "csv" / "b.csv").read_text().splitlines()[:2] == [",timestamp_s,phase", "0,0.0,CRUISING"]
    lines = geometry.lines(df, "timestamp_s", "x", "y").withColumn("layer", F.lit("raw"))
    files.write_geojson(lines, str(tmp_path / "json"))
    import json

    got = json.loads((tmp_path / "json" / "a.geojson").read_text())
    assert got["type"] == "FeatureCollection" and got["features"][0]["geometry"]["coordinates"][2] == [4.0, 1.0] and got["features"][0]["properties"]["stroke-width"] == 3.0
    frame = df.withColumns({"frame_id": F.col("timestamp_s").cast("int"), **{c: F.lit(1.0) for c in sinks.FRAME if c not in ("frame_id", "timestamp_s", "phase")}})
    files.write_frames(frame, str(tmp_path / "frames"))
    assert (tmp_path / "frames" / "a.csv").read_text().splitlines()[1].startswith("0000,0.000000,1.000000,")


def test_a_log_without_fixes(spark, tmp_path):
    (tmp_path / "x.igc").write_text("AXXX123\nHFDTE080525\n")
    found = igc.fixes(igc.read_lines(spark, str(tmp_path / "x.igc")))
    assert found.count() == 0 and {"flight_id", "timestamp_s", "gps_lat_deg", "alt_gps_m"} <= set(found.columns)
    assert igc.metadata(igc.read_lines(spark, str(tmp_path / "x.igc"))).first()["num_fixes"] is None


def test_looking_ahead_is_linear(spark):
    """200,000 rows of one flight: a frame that is gone through anew for each row would take hours."""
    rows = spark.range(200_000).select(F.lit("f").alias("flight_id"), F.col("id").cast("double").alias("t"), F.when(F.col("id") % 1000 == 7, F.col("id")).alias("v"))
    began = time.time()
    left, right = rows.select("flight_id", "t"), rows.where("v IS NOT NULL").select("flight_id", "t", F.col("v").cast("double").alias("v"))
    assert ordered.interpolate(left, right, "t", ["v"]).where("abs(v - greatest(7, least(t, 199007))) > 1e-6").count() == 0
    assert ordered.merged(left, {"a": (right, ["v"])}, "t").where("abs(v - greatest(7, least(t, 199007))) > 1e-6").count() == 0
    assert ordered.central_difference(rows, ["t"], "t", 1.5).where("d_t < 1.9").count() == 0
    filled = rows.withColumn("w", ordered.backfilled(F.col("v"), "flight_id", "t"))
    assert filled.where("w IS NULL").count() == 199_999 - 199_007 and filled.agg(F.min("w")).first()[0] == 7
    assert ordered.rolling_medians(rows.withColumn("x", F.col("t") % 5), {"x": "m"}, "t", span=5.0).where("m <> 2 AND t BETWEEN 2 AND 199997").count() == 0
    assert time.time() - began < 90


def test_closed_line_is_smooth(spark):
    """Also where it closes: no corner, and the same line from whichever point it begins."""
    points = [(0.0, 0.0), (4.0, 1.0), (5.0, 5.0), (1.0, 6.0), (-2.0, 3.0)]
    rows = [(name, k, x, y) for name, turn, close in (("a", 0, True), ("b", 2, False)) for k, (x, y) in enumerate([*points[turn:], *points[:turn], *([points[turn]] if close else [])])]
    df = spark.createDataFrame([*rows, ("one", 0, 7.0, 8.0)], "ring string, k int, x double, y double")
    out = geometry.closed_spline(df, "k", ["x", "y"], 50, "ring").toPandas().sort_values(["ring", "k", "step"])
    a, b = (out[out["ring"] == n][["x", "y"]].to_numpy() for n in "ab")
    assert a.shape == b.shape == (250, 2) and np.allclose(np.roll(b, 100, 0), a) and np.allclose(a[::50], points)
    ways = np.diff(np.vstack([a, a[:2]]), axis=0)
    angles = np.diff(np.unwrap(np.arctan2(ways[:, 1], ways[:, 0])))
    assert np.abs(angles).max() < 0.1
    assert out[out["ring"] == "one"][["x", "y"]].drop_duplicates().to_numpy().tolist() == [[7.0, 8.0]]
