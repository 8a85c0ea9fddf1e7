"""Predicates and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.integrity import iso
from sightline.functions.scoring import cosine01


def plate_filter(q: str, plate: Column | None = None) -> Column:
    """Plates that equal or hold q in upper case; % and _ in q are wildcards, backslashes are not."""
    plate, q = F.col("plate_text") if plate is None else plate, q.strip().upper()
    return (plate == q) | plate.like("%" + q.replace("\\", "\\\\") + "%")


def contains_text(column: str, q: str) -> Column:
    return F.lower(F.col(column)).contains(q.strip().lower())


def search_filter(plate: str | None = None, vehicle_type: str | None = None, color: str | None = None, camera: str | None = None, start: str | None = None, end: str | None = None, min_confidence: float = 0.50) -> Column:
    """All given criteria of a sighting search; times are inclusive, and a confidence over 0 leaves nulls out."""
    out = F.lit(True)
    if plate is not None:
        out &= plate_filter(plate)
    if vehicle_type:
        out &= contains_text("vehicle_type", vehicle_type)
    if color:
        out &= contains_text("vehicle_color", color)
    if camera:
        out &= F.col("camera_id") == camera.strip()
    if start:
        out &= F.col("timestamp") >= F.lit(start).cast("timestamp_ntz")
    if end:
        out &= F.col("timestamp") <= F.lit(end).cast("timestamp_ntz")
    return out & (F.col("plate_confidence") >= min_confidence) if min_confidence > 0 else out


def concat_streams(batches: list[DataFrame]) -> DataFrame:
    """Batches of several cameras as one table; columns that a batch lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), batches)


def min_visual_similarity(s: DataFrame, reference: Column, least: float) -> DataFrame:
    return s.filter(cosine01(reference, F.col("embedding")) >= least)


def active_cases(cases: DataFrame) -> DataFrame:
    return cases.filter(F.col("status").isin("open", "tracking"))


def drop_untimed(s: DataFrame) -> DataFrame:
    return s.filter(F.col("timestamp").isNotNull())


def drop_blurry(d: DataFrame, least: float = 100.0) -> DataFrame:
    return d.filter(F.col("lap_var") >= least)


def normalize_case_input(cases: DataFrame) -> DataFrame:
    return cases.withColumns({"reported_plate": F.upper(F.trim("reported_plate")), "vehicle_type": F.lower(F.trim("vehicle_type")), "vehicle_color": F.lower(F.trim("vehicle_color"))})


def _violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("violations", F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull()))


def validate_cases(cases: DataFrame) -> DataFrame:
    """Rows with the names of the request rules that they break."""
    needed = ["fir_number", "reported_plate", "theft_datetime", "theft_location_name", "vehicle_type", "vehicle_color", "investigating_officer", "police_station"]
    rules = {c: F.col(c).isNotNull() for c in needed}
    return _violations(cases, rules | {"theft_latitude": F.col("theft_latitude").between(-90, 90), "theft_longitude": F.col("theft_longitude").between(-180, 180)})


def validate_cameras(cameras: DataFrame) -> DataFrame:
    rules = {c: F.col(c).isNotNull() for c in ("id", "name", "road_name")}
    return _violations(cameras, rules | {"latitude": F.col("latitude").between(-90, 90), "longitude": F.col("longitude").between(-180, 180), "direction_bearing": F.coalesce("direction_bearing", F.lit(0.0)).between(0, 360)})


def sample_frames(frames: DataFrame, every: int, fps: float, start: str, most: int | None = None) -> DataFrame:
    """Every n-th frame below ``most``, with the time that its index gives."""
    kept = frames.filter(F.col("frame_idx") % every == 0)
    kept = kept if most is None else kept.filter(F.col("frame_idx") < most)
    micros = F.unix_micros(F.lit(start).cast("timestamp")) + F.round(F.col("frame_idx") * (1_000_000.0 / fps)).cast("long")
    return kept.withColumn("ts", F.timestamp_micros(micros).cast("timestamp_ntz"))


def normalize_route_input(df: DataFrame) -> DataFrame:
    """Rows of other shapes with the columns that routes need, defaults filled in."""
    has = lambda *names: [F.col(n) for n in names if n in df.columns]
    camera = F.coalesce(*has("camera_id"), F.lit("UNKNOWN_CAM"))
    return df.select(
        *([F.col("case_id")] if "case_id" in df.columns else []), F.coalesce(*has("sighting_id", "id"), F.lit(None).cast("long")).alias("sighting_id"), camera.alias("camera_id"), F.coalesce(*has("camera_name"), F.format_string("Camera %s", camera)).alias("camera_name"),
        F.coalesce(*has("latitude"), F.lit(0.0)).alias("latitude"), F.coalesce(*has("longitude"), F.lit(0.0)).alias("longitude"), F.coalesce(*has("timestamp"), F.lit(None).cast("timestamp_ntz")).alias("timestamp"), F.coalesce(*has("composite_score"), F.lit(1.0)).alias("composite_score"),
    )


def to_public(df: DataFrame) -> DataFrame:
    """Rows for display: times as ISO text and vectors as their sizes."""
    shown = []
    for c, kind in df.dtypes:
        if kind.startswith("timestamp"):
            shown.append(iso(F.col(c)).alias(c))
        elif c.endswith("embedding"):
            shown.append(F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).alias(f"{c}_dim"))
        else:
            shown.append(F.col(c))
    return df.select(*shown)


#: Further columns of a search row, where a sighting has them.
DETAILS = ("track_id", "plate_box", "vehicle_box", "make", "model", "image_path", "crop_path", "plate_crop_path", "sha256_hash", "direction_travel", "speed_estimate_kmh", "created_at")


def sighting_view(s: DataFrame) -> DataFrame:
    """Search rows: a sighting with its camera and best match, confidence 0 and scores to 4 decimals by default."""
    return s.select(
        "sighting_id", "camera_id", "camera_name", "latitude", "longitude", "road_name", "timestamp", "plate_text", F.coalesce("plate_confidence", F.lit(0.0)).alias("plate_confidence"), "vehicle_type", "vehicle_color",
        F.round("match_score", 4).alias("match_score"), "verification_status", *[c for c in DETAILS if c in s.columns],
    )


def segment_labels(segments: DataFrame) -> DataFrame:
    """Label of each segment, and of its route: any infeasible segment raises an alert."""
    alert = F.bool_or(~F.col("feasible")).over(W.partitionBy("case_id"))
    return segments.withColumn("label", F.when(F.col("feasible"), "Feasible").otherwise("Speed Alert")).withColumn("route_label", F.when(alert, "Speed Alert").otherwise("Feasible"))
