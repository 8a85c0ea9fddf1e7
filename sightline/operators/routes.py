"""Routes: waypoints and segments in the order of time, for all cases at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.functions.geo import bearing_deg, haversine_km, haversine_raw_km, route_transition, seconds_between, transition

ORIGIN = "THEFT_ORIGIN"
_ORDER = ["timestamp", "sighting_id"]


def waypoints(s: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows with seq, their place in time, and the point before."""
    w = W.partitionBy(key).orderBy(*_ORDER)
    before = {f"prev_{c}": F.lag(c).over(w) for c in ("latitude", "longitude", "timestamp", "camera_id")}
    return s.filter("timestamp is not null").withColumns({"seq": F.row_number().over(w), **before})


def route_segments(s: DataFrame, key: str = "case_id", max_speed: float = 120.0) -> DataFrame:
    """One row per move between sightings that follow each other: distance, time, speed, bearing and feasibility."""
    w = waypoints(s, key).filter("seq > 1")
    km = haversine_km(F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude"))
    t = transition(km, seconds_between(F.col("prev_timestamp"), F.col("timestamp")), max_speed)
    moved = w.withColumn("t", t).withColumn("bearing", bearing_deg(F.col("prev_latitude"), F.col("prev_longitude"), F.col("latitude"), F.col("longitude")))
    return moved.select(key, (F.col("seq") - 1).alias("from_seq"), F.col("seq").alias("to_seq"), F.col("prev_camera_id").alias("from_camera_id"), F.col("camera_id").alias("to_camera_id"), "t.km", "t.dt", "t.speed", "t.feasible", "bearing")


def route_summary(s: DataFrame, key: str = "case_id", max_speed: float = 120.0) -> DataFrame:
    """Per route: points, length, duration in seconds, mean speed, whether all moves are feasible, where and when it ends."""
    seg = route_segments(s, key, max_speed).groupBy(key).agg(F.round(F.sum("km"), 3).alias("total_km"), F.bool_and("feasible").alias("all_feasible"))
    last = F.struct(*_ORDER)
    ends = s.filter("timestamp is not null").groupBy(key).agg(F.count(F.lit(1)).alias("n_points"), F.round(seconds_between(F.min("timestamp"), F.max("timestamp")), 2).alias("duration_s"), F.max_by("camera_id", last).alias("last_camera"), F.max("timestamp").alias("last_seen"))
    total = F.coalesce("total_km", F.lit(0.0))
    return ends.join(seg, key, "left").select(key, "n_points", total.alias("total_km"), "duration_s", F.when(F.col("duration_s") > 0, F.round(total / (F.col("duration_s") / 3600), 2)).otherwise(0.0).alias("avg_speed"), F.coalesce("all_feasible", F.lit(True)).alias("all_feasible"), "last_camera", "last_seen")


def case_routes(points: DataFrame, max_speed: float = 120.0) -> DataFrame:
    """Waypoints from the place of the theft on: points are case rows joined with sightings and cameras (mode route).

    The origin is the first point of a route; the first waypoint shows no distance, time or speed but its feasibility.
    """
    origin = points.select("case_id", F.col("theft_latitude").alias("latitude"), F.col("theft_longitude").alias("longitude"), F.col("theft_datetime").alias("timestamp"), F.lit(ORIGIN).alias("camera_id"), F.lit(None).cast("bigint").alias("sighting_id"), F.lit(0).alias("leg")).distinct()
    seen = points.select("case_id", "latitude", "longitude", "timestamp", "camera_id", "sighting_id", F.lit(1).alias("leg"))
    w = W.partitionBy("case_id").orderBy("leg", *_ORDER)
    prev = {f"p_{c}": F.lag(c).over(w) for c in ("latitude", "longitude", "timestamp", "camera_id")}
    moved = origin.unionByName(seen).withColumns({**prev, "seq": F.row_number().over(w) - 1}).filter("leg = 1")
    raw = haversine_raw_km(F.col("p_latitude"), F.col("p_longitude"), F.col("latitude"), F.col("longitude"))
    moved = moved.withColumn("raw_km", raw).withColumn("t", route_transition(F.col("raw_km"), seconds_between(F.col("p_timestamp"), F.col("timestamp")), max_speed))
    running = F.round(F.sum("raw_km").over(W.partitionBy("case_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)), 3)
    shown = lambda c: F.when(F.col("seq") > 1, F.col(f"t.{c}"))
    return moved.select("case_id", "seq", "sighting_id", F.col("p_camera_id").alias("from_camera_id"), "camera_id", "timestamp", shown("km").alias("km"), shown("dt").alias("dt"), shown("speed").alias("speed"), F.col("t.feasible").alias("feasible"), running.alias("running_km"))


def case_route_totals(routes: DataFrame, cases: DataFrame) -> DataFrame:
    """Per case, those without sightings included: length from the place of the theft, minutes since the theft, status, where and when the route ends."""
    last = F.max_by(F.struct("running_km", "camera_id", "timestamp"), "seq")
    ends = routes.groupBy("case_id").agg(last.alias("last"), F.count(F.lit(1)).alias("waypoints"))
    joined = cases.select("case_id", "fir_number", "theft_datetime").join(ends, "case_id", "left")
    minutes = F.round(seconds_between(F.col("theft_datetime"), F.col("last.timestamp")) / 60, 1)
    return joined.select(
        "case_id", "fir_number", F.coalesce("waypoints", F.lit(0)).alias("waypoints"), F.coalesce("last.running_km", F.lit(0.0)).alias("total_km"), F.greatest(F.lit(0.0), F.coalesce(minutes, F.lit(0.0))).alias("duration_min"),
        F.when(F.col("last").isNull(), "No Detections").otherwise("Active Lead").alias("route_status"), F.col("last.camera_id").alias("last_camera"), F.col("last.timestamp").alias("last_seen"),
    )
