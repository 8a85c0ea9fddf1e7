"""Roll-ups for dashboards and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = ("open", "tracking")


def total_count(df: DataFrame) -> DataFrame:
    """One row: the number of rows before paging."""
    return df.agg(F.count(F.lit(1)).alias("total"))


def with_total(rows: DataFrame, df: DataFrame) -> DataFrame:
    """A page of df with the number of all its rows on each."""
    return rows.crossJoin(F.broadcast(total_count(df)))


def dashboard_kpis(cameras: DataFrame, cases: DataFrame, s: DataFrame, matches: DataFrame, midnight: str) -> DataFrame:
    """One row of counts; detections and matches count from ``midnight`` on."""
    since = lambda c: F.count_if(F.col(c) >= F.lit(midnight).cast("timestamp_ntz"))
    rate = F.when(F.count(F.lit(1)) == 0, 0.0).otherwise(F.round(100.0 * F.count_if(F.col("status") == "recovered") / F.count(F.lit(1)), 1))
    one = cameras.agg(F.count(F.lit(1)).alias("total_cameras"), F.count_if(F.col("status") == "active").alias("active_cameras"))
    two = cases.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active_cases"), F.coalesce(rate, F.lit(0.0)).alias("recovery_rate"))
    return one.crossJoin(two).crossJoin(s.agg(since("timestamp").alias("detections_today"))).crossJoin(matches.agg(since("created_at").alias("matches_today")))


def recovery_rate(cases: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return cases.agg(n.alias("total"), F.count_if(F.col("status") == "recovered").alias("recovered"), F.when(n == 0, 0.0).otherwise(F.round(100.0 * F.count_if(F.col("status") == "recovered") / n, 1)).alias("recovery_rate"))


def detections_per_camera(cameras: DataFrame, s: DataFrame) -> DataFrame:
    """Cameras in the order of their ids with all their sightings counted, 0 included."""
    n = s.groupBy("camera_id").agg(F.count(F.lit(1)).alias("n"))
    return cameras.join(n, cameras["id"] == n["camera_id"], "left").select(cameras["id"].alias("camera_id"), "name", "status", F.coalesce("n", F.lit(0)).alias("detections")).orderBy("camera_id")


def case_counts(cases: DataFrame, matches: DataFrame) -> DataFrame:
    """Cases with the numbers of their candidates and verified matches."""
    n = matches.groupBy("case_id").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("verification_status") == "verified").alias("v"))
    return cases.join(n, "case_id", "left").select("case_id", "fir_number", "status", F.coalesce("c", F.lit(0)).alias("candidates"), F.coalesce("v", F.lit(0)).alias("verified"))


def recent_alerts(matches: DataFrame, cases: DataFrame, s: DataFrame, n: int = 5) -> DataFrame:
    """The n latest matches with their cases and sightings; ties by greatest id. The limit comes before the joins."""
    latest = matches.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
    return latest.join(cases.select("case_id", "fir_number", "reported_plate"), "case_id").join(s.select("sighting_id", "camera_id", "plate_text"), "sighting_id").select("id", "case_id", "fir_number", "reported_plate", "sighting_id", "camera_id", "plate_text", "composite_score", "created_at")


def target_split(batch: DataFrame, targets: Column) -> DataFrame:
    return batch.agg(F.count(F.lit(1)).alias("total"), F.count_if(targets).alias("targets"), F.count_if(~F.coalesce(targets, F.lit(False))).alias("others"))


def page(df: DataFrame, number: int = 1, limit: int = 20, by: str = "timestamp", key: str = "sighting_id") -> DataFrame:
    """One page of the rows, latest first, ids breaking ties."""
    return df.orderBy(F.desc(by), F.desc(key)).offset((number - 1) * limit).limit(limit)


def feed(df: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), F.desc("sighting_id")).offset(offset).limit(limit).withColumn("page", F.lit(offset // limit + 1))


def list_cases(cases: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Latest first; an offset counts only with a limit."""
    ordered = cases.orderBy(F.desc("created_at"), F.desc("case_id"))
    return ordered if limit is None else ordered.offset(offset).limit(limit)


def audit_recent(audit: DataFrame, n: int = 50) -> DataFrame:
    return audit.orderBy(F.desc("timestamp"), F.desc("audit_id")).limit(n)


def audit_by_user(audit: DataFrame, badge: str, n: int = 100) -> DataFrame:
    return audit_recent(audit.filter(F.col("user_badge_id") == badge), n)


def audit_for_case_view(audit: DataFrame, case_id: str, n: int = 100) -> DataFrame:
    return audit_recent(audit.filter((F.col("resource_id") == case_id) | (F.col("resource_type") == "case")), n)


def case_detail(cases: DataFrame, matches: DataFrame, case_id: int) -> DataFrame:
    """One case with the numbers of its candidates and verified matches; no row for an unknown one."""
    n = matches.filter(F.col("case_id") == case_id).agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("verification_status") == "verified").alias("verified"))
    return cases.filter(F.col("case_id") == case_id).crossJoin(n)


def camera_detail(cameras: DataFrame, s: DataFrame, camera_id: str) -> DataFrame:
    """One camera with the number of its sightings; no row for an unknown one."""
    return cameras.filter(F.col("id") == camera_id).crossJoin(s.filter(F.col("camera_id") == camera_id).agg(F.count(F.lit(1)).alias("detections")))
