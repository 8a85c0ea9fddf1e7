"""Batches of changes: each takes the current rows and a batch and returns the rows after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.operators.joins import new_rows_only

STATUSES = ("pending", "verified", "rejected", "flagged")


def _latest(df: DataFrame, keys: list[str], *by: Column) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).filter("_rank = 1").drop("_rank")


def upsert_sightings(current: DataFrame, batch: DataFrame, overwrite: tuple[str, ...] = ("plate_confidence", "embedding", "plate_box", "vehicle_box", "sha256_hash")) -> DataFrame:
    """Sightings keyed by camera, time and plate, null plates being equal: known ones take the batch's measurements, others are added.

    Of rows of the batch with one key that with the greatest id counts.
    """
    keys = ["camera_id", "timestamp", "plate_text"]
    new = _latest(batch, keys, F.desc("sighting_id")).select(*[F.col(c).alias(f"_{c}") for c in batch.columns], F.lit(True).alias("_in"))
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = current.withColumn("_cur", F.lit(True)).join(new, same, "full_outer")
    pick = lambda c: F.when(F.col("_cur") & (F.col("_in") if c in overwrite else F.lit(False)), F.col(f"_{c}")).when(F.col("_cur"), F.col(c)).otherwise(F.col(f"_{c}"))
    return joined.select(*[pick(c).alias(c) for c in current.columns])


def upsert_vehicles(current: DataFrame, s: DataFrame) -> DataFrame:
    """Vehicles by plate; unknown plates are added with the looks of their earliest sighting."""
    seen = s.filter("plate_text is not null").groupBy(F.col("plate_text").alias("plate_number")).agg(F.min_by(F.struct("vehicle_type", "vehicle_color", "timestamp"), F.struct("timestamp", "sighting_id")).alias("f"))
    rows = seen.select("plate_number", F.col("f.vehicle_type").alias("vehicle_type"), F.col("f.vehicle_color").alias("color"), F.col("f.timestamp").alias("first_seen"), F.col("f.timestamp").alias("last_seen"))
    return current.unionByName(rows.join(current, "plate_number", "left_anti"), allowMissingColumns=True)


def upsert_matches(current: DataFrame, ranked: DataFrame) -> DataFrame:
    """Matches by case and sighting: new ones are pending, known ones take the new scores and order and keep their review."""
    fresh = ["plate_score", "visual_score", "attribute_score", "spatio_temporal_score", "composite_score", "sequence_order"]
    new = ranked.select("case_id", "sighting_id", *[F.col(c).alias(f"_{c}") for c in fresh])
    joined = current.join(new, ["case_id", "sighting_id"], "full_outer")
    changed = {c: F.coalesce(f"_{c}", c) for c in fresh} | {"verification_status": F.coalesce("verification_status", F.lit("pending"))}
    return joined.withColumns(changed).select(*current.columns)


def apply_verifications(matches: DataFrame, decisions: DataFrame, s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches after officers' decisions, and the decisions that were rejected with the reason.

    The last decision on a case and sighting wins, notes are overwritten only by notes, and a match that is missing is
    created with the sighting's confidence. Decisions with another status or on unknown sightings are rejected.
    """
    clean = decisions.withColumn("status", F.lower(F.trim("status"))).join(s.select(F.col("sighting_id").alias("_s"), F.col("plate_confidence").alias("_conf")), F.col("sighting_id") == F.col("_s"), "left")
    reason = F.when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "status").when(F.col("_s").isNull(), "sighting")
    judged = clean.withColumn("reason", reason)
    w = W.partitionBy("case_id", "sighting_id").orderBy("decided_at", "status")
    notes = F.last(F.nullif("notes", F.lit("")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    good = _latest(judged.filter("reason is null").withColumn("notes", notes), ["case_id", "sighting_id"], F.desc("decided_at"), F.desc("status"))
    new = good.select("case_id", "sighting_id", F.col("status").alias("_status"), F.col("officer_badge_id").alias("_by"), F.col("decided_at").alias("_at"), F.col("notes").alias("_notes"), "_conf")
    j = matches.withColumn("_known", F.lit(True)).join(new, ["case_id", "sighting_id"], "full_outer")
    born = F.col("_known").isNull()
    default = lambda c, v: F.when(born, v).otherwise(F.col(c))
    out = j.withColumns(
        {"plate_score": default("plate_score", F.coalesce(F.nullif("_conf", F.lit(0.0)), F.lit(0.90))), "visual_score": default("visual_score", F.lit(0.90)), "attribute_score": default("attribute_score", F.lit(1.0)), "composite_score": default("composite_score", F.lit(0.90)),
         "verification_status": F.coalesce("_status", "verification_status"), "reviewed_by": F.coalesce("_by", "reviewed_by"), "reviewed_at": F.coalesce("_at", "reviewed_at"), "review_notes": F.coalesce("_notes", "review_notes")}
    )
    return out.select(*matches.columns), judged.filter("reason is not null").drop("_s", "_conf")


def apply_case_status(cases: DataFrame, updates: DataFrame, verified: DataFrame | None = None) -> DataFrame:
    """Cases with old_status and status after explicit updates; a verified match turns an open case to tracking."""
    last = _latest(updates, ["case_id"], F.desc("decided_at"), F.desc("new_status")).select("case_id", "new_status")
    out = cases.withColumn("old_status", F.col("status")).join(last, "case_id", "left")
    if verified is not None:
        out = out.join(verified.select("case_id").distinct().withColumn("_v", F.lit(True)), "case_id", "left")
        promoted = F.when(F.col("_v") & (F.col("status") == "open"), "tracking")
        return out.withColumn("status", F.coalesce("new_status", promoted, "status")).drop("new_status", "_v")
    return out.withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def _first_of(incoming: DataFrame, key: str, order: list[str] | None) -> DataFrame:
    """Rows with _nth, their place among those of one key: by ``order``, then by all columns, so that it is fixed."""
    names = [*(order or []), *(c for c in incoming.columns if c not in (order or []))]
    return incoming.withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(*names)))


def register_cases(current: DataFrame, incoming: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Incoming cases that are new, the least by ``order`` of each number, and the current ones that others name again."""
    first = _first_of(incoming, "fir_number", order).filter("_nth = 1").drop("_nth")
    return new_rows_only(first, current, ["fir_number"]), current.join(incoming.select("fir_number"), "fir_number", "left_semi")


def register_cameras(current: DataFrame, incoming: DataFrame, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cameras that are accepted, and error rows with their reason: the id exists, or an earlier row of the batch has it."""
    known = current.select(F.col("id").alias("_id")).distinct()
    judged = _first_of(incoming, "id", order).join(known, F.col("id") == F.col("_id"), "left")
    judged = judged.withColumn("reason", F.when(F.col("_id").isNotNull(), "exists").when(F.col("_nth") > 1, "repeated"))
    return judged.filter("reason is null").select(*incoming.columns), judged.filter("reason is not null").select(*incoming.columns, "reason")


def cascade_delete(s: DataFrame, matches: DataFrame, cameras: DataFrame | None = None, cases: DataFrame | None = None, sightings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sightings and matches that remain after cameras (camera_id), cases (case_id) and sightings (sighting_id) are deleted."""
    left = s if cameras is None else s.join(cameras, "camera_id", "left_anti")
    left = left if sightings is None else left.join(sightings, "sighting_id", "left_anti")
    kept = matches if cases is None else matches.join(cases, "case_id", "left_anti")
    return left, kept.join(left.select("sighting_id"), "sighting_id", "left_semi")
