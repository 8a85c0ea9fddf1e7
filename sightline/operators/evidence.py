"""Evidence dossiers and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.integrity import certificate_fields, iso, sighting_digest, verify_hash
from sightline.operators.joins import for_members
from sightline.operators.plate_joins import dealt


def timeline_list(timeline: DataFrame) -> DataFrame:
    """Per case the ordered list of its sightings and of their digests."""
    digest = sighting_digest(F.col("sha256_hash"), F.col("sighting_id"), F.col("timestamp"))
    item = F.struct("timestamp", "sighting_id", "camera_id", "camera_name", "plate_text", "composite_score", "verification_status", digest.alias("sha256"))
    return timeline.groupBy("case_id", "fir_number").agg(F.array_sort(F.collect_list(item)).alias("timeline"))


def _of_members(gathered: DataFrame, own: DataFrame, members: DataFrame | None) -> DataFrame:
    """What was gathered of timelines, with the columns that each case has of its own.

    With ``members`` (case_id, fir_number and the ``first`` case whose timeline is theirs) a timeline is gathered once
    for all of these. What a case has of its own meets its members first, so that no timeline is shuffled case by case.
    """
    if members is None:
        return gathered.join(own, "case_id", "left")
    lists = gathered.drop("fir_number").withColumnRenamed("case_id", "first")
    return dealt(members.join(own, "case_id", "left"), "first").join(lists, "first").drop("first")


def _custody_counts(custody: DataFrame) -> DataFrame:
    return custody.groupBy("case_id").agg(F.count(F.lit(1)).alias("custody"))


def _rooted(timeline: DataFrame, own: DataFrame, members: DataFrame | None) -> DataFrame:
    """Per case its timeline with its digests, what it has of its own, and the root hash; a timeline is gathered once."""
    lists = timeline_list(timeline).withColumn("digests", F.array_join(F.col("timeline.sha256"), ","))
    lists = _of_members(lists, own, members).withColumn("custody", F.coalesce("custody", F.lit(0)))
    canonical = F.concat_ws("|", F.col("case_id").cast("string"), "fir_number", "digests", F.col("custody").cast("string"))
    return lists.withColumn("root_hash", F.sha2(canonical, 256)).drop("digests")


def evidence_root_hash(timeline: DataFrame, custody: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Per case the digest of its summary, its ordered evidence digests and the number of custody rows.

    The canonical text is "case_id|fir_number|digest,digest,...|custody". ``members`` are as in ``evidence_dossier``.
    """
    return _rooted(timeline, _custody_counts(custody), members).select("case_id", F.size("timeline").cast("long").alias("n_items"), "custody", "root_hash")


def evidence_dossier(timeline: DataFrame, custody: DataFrame, at: str, members: DataFrame | None = None, **officer: str) -> DataFrame:
    """One row per case: certificate, timeline, custody trail, root hash.

    Where several cases have one timeline, ``members`` names them (case_id, fir_number, first), and ``timeline`` has the
    rows of the first ones alone.
    """
    rows = F.array_sort(F.collect_list(F.struct("timestamp", "audit_id", "action", "user_badge_id")))
    own = custody.groupBy("case_id").agg(rows.alias("custody_trail"), F.count(F.lit(1)).alias("custody"))
    when = F.lit(at).cast("timestamp_ntz")
    certificate = certificate_fields(F.col("case_id"), F.col("fir_number"), F.col("root_hash"), when, **officer)
    return _rooted(timeline, own, members).withColumn("certificate", certificate).withColumn("exported_at", iso(when))


def evidence_blocks(timeline: DataFrame) -> DataFrame:
    """One row per case and day of its sightings: case_id, fir_number, block, n_items, first_seen, last_seen, items, block_hash.

    A block's hash is of its digests in order of time and id, so a case is hashed in blocks of a day and no row holds
    all of it.
    """
    digest = sighting_digest(F.col("sha256_hash"), F.col("sighting_id"), F.col("timestamp"))
    item = F.struct("timestamp", "sighting_id", "camera_id", "camera_name", "plate_text", "composite_score", "verification_status", digest.alias("sha256"))
    blocks = timeline.groupBy("case_id", "fir_number", F.to_date("timestamp").alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return blocks.select(
        "case_id", "fir_number", "block", F.size("items").cast("long").alias("n_items"), F.element_at("items", 1)["timestamp"].alias("first_seen"), F.element_at("items", -1)["timestamp"].alias("last_seen"),
        "items", F.sha2(F.array_join("items.sha256", ","), 256).alias("block_hash"),
    )


def block_root_hash(timeline: DataFrame, custody: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Per case the digest over its block hashes: case_id, n_blocks, n_items, custody, root_hash.

    The canonical text is "case_id|fir_number|day=hash,day=hash,...|custody", with a place for each day. ``members`` are
    as in ``evidence_dossier``.
    """
    return _block_roots(timeline, custody, members).drop("fir_number")


def _block_roots(timeline: DataFrame, custody: DataFrame, members: DataFrame | None) -> DataFrame:
    days = evidence_blocks(timeline).drop("items").groupBy("case_id", "fir_number").agg(F.array_sort(F.collect_list(F.concat_ws("=", F.col("block").cast("string"), "block_hash"))).alias("days"), F.sum("n_items").alias("n_items"))
    rows = _of_members(days, _custody_counts(custody), members).withColumn("custody", F.coalesce("custody", F.lit(0)))
    canonical = F.concat_ws("|", F.col("case_id").cast("string"), "fir_number", F.array_join("days", ","), F.col("custody").cast("string"))
    return rows.select("case_id", "fir_number", F.size("days").cast("long").alias("n_blocks"), "n_items", "custody", F.sha2(canonical, 256).alias("root_hash"))


def dossier_blocks(timeline: DataFrame, custody: DataFrame, at: str, members: DataFrame | None = None, **officer: str) -> DataFrame:
    """A dossier as rows: per case one of section ``certificate``, one of ``timeline`` for each day, and one of ``custody``
    (100 audit rows at most), each with its block, number of items, digest and body as JSON. ``members`` are as in ``evidence_dossier``."""
    when = F.lit(at).cast("timestamp_ntz")
    root = _block_roots(timeline, custody, members)
    certificate = certificate_fields(F.col("case_id"), F.col("fir_number"), F.col("root_hash"), when, **officer)
    row = lambda section, block, n, digest, body: [F.col("case_id"), F.lit(section).alias("section"), block.alias("block"), n.cast("long").alias("n_items"), digest.alias("digest"), body.alias("body")]
    head = root.select(*row("certificate", F.lit(None).cast("date"), F.lit(1), F.col("root_hash"), F.to_json(certificate)))
    days = evidence_blocks(timeline).select(*row("timeline", F.col("block"), F.col("n_items"), F.col("block_hash"), F.to_json("items")))
    days = days if members is None else for_members(days, members.select("first", "case_id"))
    trail = custody.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "audit_id", "action", "user_badge_id"))).alias("trail"))
    body = F.to_json("trail")
    return head.unionByName(days).unionByName(trail.select(*row("custody", F.lit(None).cast("date"), F.size("trail"), F.sha2(body, 256), body)))


def verify_evidence(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored items (path, expected) against files (path, content): ok, mismatch or missing."""
    joined = stored.join(files, "path", "left")
    state = F.when(F.col("content").isNull(), "missing").when(verify_hash(F.col("content"), F.col("expected")), "ok").otherwise("mismatch")
    return joined.select("path", state.alias("state"))
