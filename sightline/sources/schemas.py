"""Schemas of the seven tables and of detections, as DDL."""

from __future__ import annotations

TABLES = {
    "cameras": "id STRING, name STRING, latitude DOUBLE, longitude DOUBLE, road_name STRING, direction_bearing DOUBLE, camera_type STRING, stream_url STRING, status STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "vehicles": "id BIGINT, plate_number STRING, vehicle_type STRING, color STRING, make STRING, model STRING, first_seen TIMESTAMP_NTZ, last_seen TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ",
    "vehicle_sightings": "id BIGINT, camera_id STRING, vehicle_id BIGINT, timestamp TIMESTAMP_NTZ, track_id INT, plate_text STRING, plate_confidence DOUBLE, plate_box ARRAY<INT>, vehicle_box ARRAY<INT>, vehicle_type STRING, vehicle_color STRING, make STRING, model STRING, embedding ARRAY<FLOAT>, image_path STRING, crop_path STRING, plate_crop_path STRING, sha256_hash STRING, direction_travel STRING, speed_estimate_kmh DOUBLE, created_at TIMESTAMP_NTZ",
    "cases": "id BIGINT, fir_number STRING, reported_plate STRING, theft_datetime TIMESTAMP_NTZ, theft_latitude DOUBLE, theft_longitude DOUBLE, theft_location_name STRING, vehicle_type STRING, vehicle_color STRING, make STRING, model STRING, distinctive_features STRING, reference_image_path STRING, reference_embedding ARRAY<FLOAT>, status STRING, investigating_officer STRING, police_station STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ",
    "case_matches": "id BIGINT, case_id BIGINT, sighting_id BIGINT, plate_score DOUBLE, visual_score DOUBLE, attribute_score DOUBLE, spatio_temporal_score DOUBLE, composite_score DOUBLE, sequence_order INT, verification_status STRING, reviewed_by STRING, reviewed_at TIMESTAMP_NTZ, review_notes STRING, created_at TIMESTAMP_NTZ",
    "camera_topology": "id BIGINT, from_camera_id STRING, to_camera_id STRING, distance_km DOUBLE, min_travel_time_sec DOUBLE, max_travel_time_sec DOUBLE, typical_speed_kmh DOUBLE, is_connected BOOLEAN",
    "audit_logs": "id BIGINT, user_badge_id STRING, user_name STRING, action STRING, resource_type STRING, resource_id STRING, endpoint STRING, ip_address STRING, details MAP<STRING,STRING>, timestamp TIMESTAMP_NTZ",
}
DETECTIONS = "camera_id STRING, frame_idx BIGINT, ts TIMESTAMP_NTZ, bbox ARRAY<INT>, confidence DOUBLE, class_name STRING, lap_var DOUBLE, frame_w INT, frame_h INT"
