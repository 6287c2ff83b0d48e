import pytest
from pyspark.sql import functions as F

from loftline.sources import camera, tracks


def test_settings_and_line(spark):
    rows = [("f", "EISE", "Y"), ("f", "EISA", "HS Boost"), ("f", "VFOV", "W"), ("f", "PIMX", "1600"), ("f", "ZFOV", "121.12345678"), ("f", "DZOM", "N"), ("f", "NOPE", "x"), ("f", "PIMN", "bad")]
    got = camera.named_settings(spark.createDataFrame(rows, "flight_id string, key string, value string"))
    s = got.first()["settings"]
    assert s == {"electronic_stabilization_on": "true", "electronic_stabilization": "HS Boost", "field_of_view": "W", "auto_iso_max": "1600", "diagonal_fov_deg": "121.123457", "digital_zoom_on": "false"}
    probe = '{"streams": [{"codec_type": "video", "width": 3840, "height": 2160, "r_frame_rate": "60000/1001", "bit_rate": "60123456"}, {"codec_type": "audio", "bit_rate": "189000"}], "format": {"duration": "12.5"}}'
    both = got.withColumn("info", camera.container_info(F.lit(probe)))
    row = both.select("info.*", camera.camera_line(F.lit("Camera 12"), F.col("info"), F.col("settings")).alias("line")).first()
    assert (row["frame_rate_hz"], row["video_mbps"], row["audio_kbps"], row["duration_s"]) == (59.9401, 60.12, 189.0, 12.5)
    assert row["line"] == "Camera 12 · 4K60 · Wide · HyperSmooth Boost"


def test_points_and_priority(spark, tmp_path):
    (tmp_path / "a.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1.5" lon="2.5"><ele>100</ele><time>2021-05-02T10:00:00Z</time><hdop>1.2</hdop></trkpt><trkpt lat="1.6" lon="2.6"/></trkseg></trk></gpx>')
    got = tracks.read_gpx(spark, str(tmp_path / "a.gpx")).orderBy("latitude").collect()
    assert [(r["latitude"], r["altitude_msl"]) for r in got] == [(1.5, 100.0), (1.6, None)] and got[0]["timestamp"] == 1619949600.0
    (tmp_path / "l.json").write_text('{"features": [{"geometry": {"type": "LineString", "coordinates": [[2, 1, 9], [3, 2]]}}]}')
    assert [(r["i"], r["latitude"], r["altitude_msl"]) for r in tracks.read_line(spark, str(tmp_path / "l.json")).orderBy("i").collect()] == [(0, 1.0, 9.0), (1, 2.0, None)]
    rows = spark.createDataFrame([("f", 1.0, "IGC"), ("f", 1.0, "GEOJSON"), ("f", 2.0, "GPX"), ("f", 2.0, "other")], "flight_id string, t double, source string")
    assert sorted((r["t"], r["source"]) for r in tracks.most_trusted(rows, "t").collect()) == [(1.0, "GEOJSON"), (2.0, "GPX")]


def test_small_gaps_are_filled(spark):
    rows = spark.createDataFrame([("f", float(t), float(t * 2)) for t in (0, 1, 4, 600)], "flight_id string, timestamp_s double, z double")
    got = tracks.filled_gaps(rows, ["z"], 1.0, 10.0).orderBy("timestamp_s").collect()
    assert [(r["timestamp_s"], r["z"], r["filled"]) for r in got] == [(0, 0, False), (1, 2, False), (2, 4, True), (3, 6, True), (4, 8, False), (600, 1200, False)]


def test_frames_and_flat_world(spark):
    r = spark.range(1).select(tracks.video_time(F.lit(48), F.lit(0.0), F.lit(None).cast("double")).alias("v"), *(c.alias(n) for c, n in zip(tracks.flat_world(F.lit(53.27), F.lit(21.91), 52.27, 20.91), "ne", strict=True))).first()
    assert r["v"] == 2.0 and r["n"] == pytest.approx(111320.0) and r["e"] == pytest.approx(68120, rel=1e-2)
