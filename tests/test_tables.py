"""Tables that batches are merged into, and tables of a database read in ranges."""

from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sightline.operators import detections as det
from sightline.operators import mutations
from sightline.sources import io
from sightline.sources.tables import MergedTable

SCHEMA = "sighting_id long, camera_id string, timestamp timestamp_ntz, plate_text string, plate_confidence double, day date"


def rows(spark, *some):
    made = [(i, f"C{i % 3}", datetime(2024, 1, day, 8, 0, i % 60), None if i % 4 == 0 else f"P{i}", conf, date(2024, 1, day)) for i, day, conf in some]
    return spark.createDataFrame(made, SCHEMA)


def found(table, **how):
    return {r.sighting_id: r.plate_confidence for r in table.read(**how).collect()}


@pytest.fixture
def table(spark, tmp_path):
    return MergedTable(spark, f"file://{tmp_path}/t", SCHEMA, "day")


def test_batches_commit_once_whatever_comes_again(spark, table):
    first, second = rows(spark, *[(i, 1 + i % 3, 0.1) for i in range(12)]), rows(spark, (1, 2, 0.9), (4, 2, 0.8), (50, 2, 0.7))
    assert table.read().count() == 0 and table.merge(first, 0, mutations.upsert_sightings)
    # files of a batch that was not committed are seen by nobody
    assert not table.merge(second, 1, mutations.upsert_sightings, commit=False)
    assert found(table) == {i: 0.1 for i in range(12)}
    assert table.merge(second, 1, mutations.upsert_sightings)
    after = {**{i: 0.1 for i in range(12)}, 1: 0.9, 4: 0.8, 50: 0.7}
    assert found(table) == after
    for batch, n in ((first, 0), (second, 1), (rows(spark, (1, 2, 0.2)), 1)):
        assert not table.merge(batch, n, mutations.upsert_sightings)
    assert found(table) == after and len(table.log()) == 2 and found(table, version=1) == {i: 0.1 for i in range(12)}


def test_partitions_that_a_batch_does_not_touch_keep_their_files(spark, table, tmp_path):
    files = lambda: {str(p): p.stat().st_mtime_ns for p in Path(f"{tmp_path}/t/data").rglob("*.parquet")}
    table.merge(rows(spark, *[(i, 1 + i % 5, 0.1) for i in range(20)]), "a", mutations.upsert_sightings)
    before = files()
    table.merge(rows(spark, (2, 3, 0.5)), "b", mutations.upsert_sightings)
    added = {p for p in files() if p not in before}
    assert {p: files()[p] for p in before} == before and added and all("part=2024-01-03" in p for p in added)
    # and the merge reads the touched partition alone
    read = table.read(["2024-01-03"]).inputFiles()
    assert all("part=2024-01-03" in p for p in read) and table.log()[-1]["parts"] == ["2024-01-03"]


def test_two_writers_do_not_commit_one_version(spark, table, tmp_path):
    table.merge(rows(spark, (1, 1, 0.1)), 0, mutations.upsert_sightings)
    Path(f"{tmp_path}/t/log/000000002.json").write_text('{"version": 2, "batch": "other", "folder": "none", "parts": []}')
    stale = MergedTable(spark, table.path, SCHEMA, "day")
    stale.log = lambda: [x for x in table.log() if x["version"] == 1]
    with pytest.raises(Exception, match="(?i)exist"):
        stale.merge(rows(spark, (2, 1, 0.1)), 1, mutations.upsert_sightings)


def test_matches_merge_by_buckets_of_cases(spark, tmp_path):
    fresh = ["plate_score", "visual_score", "attribute_score", "spatio_temporal_score", "composite_score"]
    schema = "case_id long, sighting_id long, " + ", ".join(f"{c} double" for c in fresh) + ", sequence_order int, verification_status string, bucket int"
    table = MergedTable(spark, f"file://{tmp_path}/m", schema, "bucket")
    ranked = lambda pairs, x: spark.createDataFrame([(c, s, *[x] * 5, 1, None, c % 4) for c, s in pairs], schema)
    merge = lambda now, batch: mutations.upsert_matches(now, batch).withColumn("bucket", (F.col("case_id") % 4).cast("int"))
    table.merge(ranked([(c, s) for c in range(8) for s in range(3)], 0.1), 0, merge)
    table.merge(ranked([(2, 1), (2, 9)], 0.7), 1, merge)
    got = {(r.case_id, r.sighting_id): (r.composite_score, r.verification_status) for r in table.read().collect()}
    assert len(got) == 25 and got[2, 1] == got[2, 9] == (0.7, "pending") and got[6, 1] == (0.1, "pending")


def test_a_database_is_read_in_ranges_of_equal_rows(spark):
    url = "jdbc:derby:memory:sightline;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    # ids far apart: steps of equal width would put nearly all rows into one
    ids = [*range(900), *range(10**6, 10**6 + 100)]
    cams = [(i, f"CAM_{i % 5}", f"CAM_{i % 7}", i / 10, 1.0, 2.0, 50.0, i % 2 == 0) for i in ids]
    spark.createDataFrame(cams, "id long, from_camera_id string, to_camera_id string, distance_km double, min_travel_time_sec double, max_travel_time_sec double, typical_speed_kmh double, is_connected boolean").write.jdbc(url, "camera_topology", mode="overwrite", properties=driver)
    got = io.read_table(spark, "camera_topology", url, key="id", partitions=8, **driver)
    assert got.schema.simpleString() == "struct<id:bigint,from_camera_id:string,to_camera_id:string,distance_km:double,min_travel_time_sec:double,max_travel_time_sec:double,typical_speed_kmh:double,is_connected:boolean>"
    assert sorted(r.id for r in got.collect()) == ids
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert got.rdd.getNumPartitions() == len(sizes) == 8 and max(sizes) < 0.2 * len(ids)
    # filters and columns reach the database
    plan = got.filter("distance_km > 50 and from_camera_id = 'CAM_1'").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThan(distance_km" in plan.replace("*", "") or "distance_km" in plan.split("PushedFilters")[1]
    assert io.read_table(spark, "camera_topology", url, **driver).count() == len(ids)


def test_a_database_table_without_rows(spark):
    url, driver = "jdbc:derby:memory:sightline2;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.createDataFrame([], "id long, case_id long, sighting_id long, composite_score double").write.jdbc(url, "case_matches", mode="overwrite", properties=driver)
    assert io.read_table(spark, "case_matches", url, key="id", partitions=4, **driver).count() == 0


BOX = [100, 100, 220, 190]


def test_tracks_go_on_over_missed_frames_and_end_after_max_age(spark):
    seen = lambda frame, det_id, conf=0.9, box=BOX: ("C1", frame, det_id, box, conf, "car", 0.5, 0)
    far = [600, 100, 720, 190]
    d = [seen(0, 1), seen(1, 2), seen(4, 3, 0.3), seen(5, 4), seen(20, 5), seen(0, 6, 0.9, far), seen(2, 7, 0.2, far), seen(9, 8, 0.3, far), seen(0, 9, 0.05)]
    df = spark.createDataFrame(d, "camera_id string, frame_idx long, det_id long, bbox array<int>, confidence double, class_name string, quality double, track_id long")
    links = {(r.det_id, r.prev_id): r.gap for r in det.association_over_gaps(df, 5).collect()}
    # frames 2 and 3 are missed; 15 frames are too many; a weak detection alone starts nothing
    assert links == {(2, 1): 1, (3, 2): 3, (4, 3): 1, (7, 6): 2}
    got = {r.track_id: (r.n_frames, r.latest_det) for r in det.tracks(df, 5).collect()}
    assert got == {1: (4, 4), 5: (1, 5), 6: (2, 7)}
    assert {r.track_id: r.n_frames for r in det.tracks(df, 15).collect()} == {1: 5, 6: 3}
    assert det.tracks(df.limit(0), 3).count() == 0
