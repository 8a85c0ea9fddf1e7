"""Digests, certificates and time parsing as columns."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sightline.functions.plates import CONFUSED


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def verify_hash(content: Column, expected: Column) -> Column:
    """Whether content has the expected digest, in any case and with blanks around; a missing digest never fits."""
    want = F.lower(F.trim(F.coalesce(expected, F.lit(""))))
    return (want != "") & F.coalesce(F.sha2(content, 256) == want, F.lit(False))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def sighting_digest(stored: Column, sighting_id: Column, ts: Column) -> Column:
    """The stored digest, else that of "{id}_{timestamp}"."""
    return F.coalesce(F.nullif(stored, F.lit("")), F.sha2(F.concat_ws("_", sighting_id.cast("string"), iso(ts)), 256))


#: The constant fields of a certificate.
STATUTE = "Section 65B, Indian Evidence Act 1872 / Section 63, Bharatiya Sakshya Adhiniyam 2023"
ALGORITHM = "SHA-256 (FIPS 180-4)"
ADMISSIBILITY = "VALID_COURT_EXHIBIT"
AFFIRMATION = (
    "I hereby certify that the electronic records, CCTV surveillance frame captures, license plate OCR logs, and spatio-temporal route trajectories contained in this dossier were produced by the automated "
    "Police CCTV & ANPR Computer Vision System during the regular course of official activities. The computer system was operating properly throughout the period of record generation, and the cryptographic "
    "SHA-256 hashes confirm that the electronic contents have not been altered or tampered with."
)


def certificate_fields(case_id: Column, fir: Column, root_hash: Column, at: Column, badge: str = "SYSTEM_AUTO", officer: str = "Investigating Officer", station: str = "Central Police Command", system: str = "sightline") -> Column:
    """struct of the 13 fields of an electronic-evidence certificate issued at a time."""
    fields = {
        "certificate_id": F.format_string("CERT-65B-%s-%s", fir, F.date_format(at, "yyyyMMddHHmmss")), "statute": F.lit(STATUTE), "system_name": F.lit(system), "case_id": case_id, "fir_number": fir,
        "evidence_root_hash": root_hash, "hash_algorithm": F.lit(ALGORITHM), "certifying_officer": F.lit(officer), "officer_badge_id": F.lit(badge), "police_station": F.lit(station),
        "certification_timestamp": iso(at), "affirmation_text": F.lit(AFFIRMATION), "admissibility_status": F.lit(ADMISSIBILITY),
    }
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def parse_iso_ts(c: Column) -> Column:
    """A timestamp, null where the text is none."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Temporary SQL functions for distance, bearing, plates, box overlap and scores; returns their names."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN
        round(12742.0 * asin(least(1.0, sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))), 4)"""
    )
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION clean_plate(raw STRING) RETURNS STRING RETURN regexp_replace(upper(raw), '[^\\\\p{L}\\\\p{N}]', '')")
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION box_iou(a ARRAY<INT>, b ARRAY<INT>) RETURNS DOUBLE RETURN
        greatest(0, least(a[2], b[2]) - greatest(a[0], b[0])) * greatest(0, least(a[3], b[3]) - greatest(a[1], b[1]))
        / nullif((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1])
        - greatest(0, least(a[2], b[2]) - greatest(a[0], b[0])) * greatest(0, least(a[3], b[3]) - greatest(a[1], b[1])), 0)"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION cosine01(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN
        round(greatest(0D, least(1D, coalesce(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)
        / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D), 0D))), 4)"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION bearing_deg(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE RETURN
        CASE WHEN abs(lat2 - lat1) < 1e-7 AND abs(lon2 - lon1) < 1e-7 THEN 0D ELSE round(pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)),
        cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) + 360, 360), 2) END"""
    )
    one, other = "".join(g[1:] for g in CONFUSED), "".join(g[0] * (len(g) - 1) for g in CONFUSED)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION plate_similarity(a STRING, b STRING) RETURNS DOUBLE RETURN
        CASE WHEN a IS NULL AND b IS NULL THEN 1D WHEN a IS NULL OR b IS NULL THEN 0D WHEN clean_plate(a) = clean_plate(b) THEN 1D WHEN clean_plate(a) = '' OR clean_plate(b) = '' THEN 0D
        ELSE round(greatest(0D, 1 - element_at(aggregate(sequence(1, length(clean_plate(a))), transform(sequence(0, length(clean_plate(b))), j -> double(j)),
          (row, i) -> aggregate(sequence(1, length(clean_plate(b))), array(double(i)), (out, j) -> concat(out, array(least(row[j] + 1, element_at(out, -1) + 1, row[j - 1]
            + CASE WHEN substring(clean_plate(a), i, 1) = substring(clean_plate(b), j, 1) THEN 0D
                WHEN translate(substring(clean_plate(a), i, 1), '{one}', '{other}') = translate(substring(clean_plate(b), j, 1), '{one}', '{other}')
                  AND NOT (substring(clean_plate(a), i, 1) IN ('U', 'Y') AND substring(clean_plate(b), j, 1) IN ('U', 'Y')) THEN 0.3D ELSE 1D END))))), -1)
          / greatest(length(clean_plate(a)), length(clean_plate(b)))), 4) END"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION composite_score(similarity DOUBLE, plate STRING, confidence DOUBLE, visual DOUBLE, type_score DOUBLE, color_score DOUBLE) RETURNS DOUBLE RETURN
        round(round(greatest(0D, least(1D, CASE WHEN coalesce(trim(plate), '') <> '' AND coalesce(confidence, 0) >= 0.5 AND similarity >= 0.4
          THEN 0.5D * similarity * least(1D, confidence) + 0.35D * visual + 0.15D * (0.5D * type_score + 0.5D * color_score) ELSE 0.65D * visual + 0.2D * color_score + 0.15D * type_score END)), 10), 4)"""
    )
    return ["haversine_km", "clean_plate", "box_iou", "cosine01", "bearing_deg", "plate_similarity", "composite_score"]
