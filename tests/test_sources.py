"""Sources and sinks on temporary folders."""

import hashlib
import json
from datetime import datetime

from pyspark.sql import functions as F

from sightline.functions.integrity import register_sql_functions
from sightline.operators import evidence
from sightline.sources import io
from sightline.sources.schemas import TABLES


def test_tables_are_read_with_their_schemas(spark, tmp_path):
    rows = [("CAM_1", "one", 28.5, 77.1, "Road", 90.0, "toll", None, "active", datetime(2026, 9, 1), datetime(2026, 9, 2))]
    spark.createDataFrame(rows, TABLES["cameras"]).write.parquet(f"{tmp_path}/cameras")
    got = io.read_table(spark, "cameras", str(tmp_path))
    assert [tuple(r) for r in got.collect()] == rows and [f.name for f in got.schema] == [c.split()[0] for c in TABLES["cameras"].split(", ")]


def test_json_columns_become_arrays_and_maps(spark):
    df = spark.createDataFrame([("[0.5, 1]", "[1, 2, 3, 4]", '{"a": "b"}'), (None, None, "not json")], "embedding string, plate_box string, details string")
    got = io.decode_json(df).collect()
    assert got[0].embedding == [0.5, 1.0] and got[0].plate_box == [1, 2, 3, 4] and got[0].details == {"a": "b"} and got[0].embedding_dim == 2
    assert got[1].embedding is None and got[1].embedding_dim == 0 and not got[1].details


def _media(tmp_path):
    for name, content in (("CAM_1_trk7_20260901_083000_crop.jpg", b"one"), ("CAM_1_trk8_20260901_093000_frame.jpg", b"two"), ("CAM_2_trk1_20260901_083000_plate.jpg", b"x"), ("note.txt", b"no")):
        (tmp_path / name).write_bytes(content)
    return str(tmp_path)


def test_evidence_files_tell_camera_track_and_digest(spark, tmp_path):
    rows = {(r.camera_id, r.track_id): r for r in io.read_evidence(spark, _media(tmp_path)).collect()}
    assert set(rows) == {("CAM_1", 7), ("CAM_1", 8), ("CAM_2", 1)}
    one = rows["CAM_1", 7]
    assert (one.taken, one.kind, one.length, one.sha256) == ("20260901_083000", "crop", 3, hashlib.sha256(b"one").hexdigest())


def test_latest_frame_is_the_greatest_name(spark, tmp_path):
    latest = {r.camera_id: r.path for r in io.latest_frame(io.read_evidence(spark, _media(tmp_path))).collect()}
    assert latest["CAM_1"].endswith("CAM_1_trk8_20260901_093000_frame.jpg") and len(latest) == 2


def test_changed_and_missing_files_are_told(spark, tmp_path):
    folder = _media(tmp_path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    stored = [("CAM_1_trk7_20260901_083000_crop.jpg", hashlib.sha256(b"one").hexdigest().upper() + " "), ("CAM_1_trk8_20260901_093000_frame.jpg", hashlib.sha256(b"twp").hexdigest()), ("gone.jpg", "aa"), ("CAM_2_trk1_20260901_083000_plate.jpg", "")]
    got = {r.path: r.state for r in evidence.verify_evidence(files, spark.createDataFrame(stored, "path string, expected string")).collect()}
    assert list(got.values()).count("ok") == 1 and got["gone.jpg"] == "missing" and got["CAM_1_trk7_20260901_083000_crop.jpg"] == "ok"
    assert got["CAM_1_trk8_20260901_093000_frame.jpg"] == got["CAM_2_trk1_20260901_083000_plate.jpg"] == "mismatch"


def test_audit_rows_are_appended_with_defaults(spark, tmp_path):
    events = spark.createDataFrame([("", None, "export", "case", 7, datetime(2026, 9, 1, 8)), ("B1", "Officer", "View", "case", None, datetime(2026, 9, 2, 8))], "user_badge_id string, user_name string, action string, resource_type string, resource_id long, timestamp timestamp_ntz")
    uri = f"{tmp_path}/audit"
    io.append_audit(events, uri)
    io.append_audit(events.limit(1), uri)
    rows = spark.read.parquet(uri).sort("timestamp", "action").collect()
    assert len(rows) == 3
    assert (rows[0].user_badge_id, rows[0].user_name, rows[0].action, rows[0].resource_id, rows[0].details) == ("SYSTEM_AUTO", "Automated Police System", "EXPORT", "7", {})
    assert (rows[2].user_badge_id, rows[2].action, rows[2].resource_id) == ("B1", "VIEW", None)


def test_one_dossier_a_case(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "case_id long, root_hash string")
    io.write_dossiers(df, f"{tmp_path}/out")
    for n, want in ((1, "a"), (2, "b")):
        (file,) = (tmp_path / "out" / f"case_id={n}").glob("*.json")
        assert json.loads(file.read_text()) == {"root_hash": want}


def test_sql_functions_agree_with_the_columns(spark):
    assert len(register_sql_functions(spark)) == 7
    one = spark.sql(
        """SELECT plate_similarity('DL01AB1234', 'DLOIABIZ34') AS a, plate_similarity('MH12AB1230', 'MH12AB123X') AS b, plate_similarity(NULL, 'A') AS c, plate_similarity('U1', 'Y1') AS d,
        composite_score(1.0D, 'A1', 1.0D, 1.0D, 1.0D, 1.0D) AS e, composite_score(0.0D, NULL, 0.0D, 1.0D, 1.0D, 0.0D) AS f, box_iou(array(0, 0, 10, 10), array(5, 0, 15, 10)) AS g, clean_plate('dl-01') AS h"""
    ).first()
    assert (one.a, one.b, one.c, one.d, one.e, one.f, one.h) == (0.88, 0.9, 0.0, 0.5, 1.0, 0.8, "DL01") and abs(one.g - 1 / 3) < 1e-9
