"""Domain tables derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _plate(u: Column) -> Column:
    return F.concat(F.lit("DL"), _pad(u % 100, 2), F.lit("AB"), _pad(u % 10000, 4))


def _pick(c: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))


def cameras(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        F.concat(F.lit("CAM_"), _pad(k, 3)).alias("id"), F.col("n_name").alias("name"), (F.lit(28.4) + F.lit(0.013) * k).alias("latitude"), (F.lit(77.1) + F.lit(0.05) * F.col("n_regionkey")).alias("longitude"),
        F.concat(F.lit("Road "), F.col("n_regionkey").cast("string")).alias("road_name"), _pick(k, "active", "active", "offline", "active", "maintenance").alias("status"), _pick(F.col("n_regionkey"), "urban", "junction", "highway", "toll", "junction").alias("camera_type"),
    )


def vectors_of(spark: SparkSession, d: str) -> int:
    """The number of embeddings; their ids run from 0. At least 1, so that it divides."""
    return max(1, table(spark, d, "embeddings").count())


def sightings(spark: SparkSession, d: str, vectors: bool = False) -> DataFrame:
    """Sightings from events; a third of the camera ids point past the cameras where the id is divisible by 97."""
    e, i, u = table(spark, d, "events"), F.col("event_id"), F.col("user_id")
    base = _plate(u)
    text = F.when(i % 11 == 0, None).when(i % 7 == 0, F.translate(base, "018", "OIB")).otherwise(base)
    kinds = F.when(F.col("event_type") == "view", "car").when(F.col("event_type") == "click", "truck").when(F.col("event_type") == "signup", "bus").when(F.col("event_type") == "error", "motorcycle").otherwise("van")
    s = e.select(
        i.alias("sighting_id"), F.concat(F.lit("CAM_"), _pad(F.when(i % 97 == 0, 99).otherwise(i % 25), 3)).alias("camera_id"), F.col("ts").cast("timestamp_ntz").alias("timestamp"), text.alias("plate_text"),
        (F.least(F.floor(F.col("value") / 2), F.lit(100)) / 100).alias("plate_confidence"), kinds.alias("vehicle_type"), _pick(u, "white", "black", "silver", "grey", "red").alias("vehicle_color"), u.alias("user_id"), (u % vectors_of(spark, d)).alias("vec_id"), F.when(i % 3 == 0, F.sha2(i.cast("string"), 256)).alias("sha256_hash"),
    )
    return s.join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id") if vectors else s


def cases(spark: SparkSession, d: str, vectors: bool = False) -> DataFrame:
    k = F.col("c_custkey")
    segment = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "car").when(F.col("c_mktsegment") == "BUILDING", "truck").when(F.col("c_mktsegment") == "FURNITURE", "bus").when(F.col("c_mktsegment") == "HOUSEHOLD", "van").otherwise("motorcycle")
    n = table(spark, d, "nation")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(
        k.alias("case_id"), F.concat(F.lit("FIR-"), _pad(k, 6)).alias("fir_number"), _plate(k % 150).alias("reported_plate"), (start + F.make_dt_interval(days=(k % 20).cast("int"))).alias("theft_datetime"), (F.lit(28.4) + F.lit(0.013) * F.col("n_nationkey")).alias("theft_latitude"),
        (F.lit(77.1) + F.lit(0.05) * F.col("n_regionkey")).alias("theft_longitude"), segment.alias("case_type"), _pick(k / 50, "white", "black", "silver", "grey", "red").alias("case_color"), _pick(k / 50, "open", "tracking", "recovered", "closed").alias("status"), (k % vectors_of(spark, d)).alias("ref_id"),
    )
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("ref_id"), F.col("embedding").alias("reference_embedding"))
    return c.join(e, "ref_id") if vectors else c


def matched_cases(spark: SparkSession, d: str) -> DataFrame:
    """The cases that may have matches: those divisible by 200 have none."""
    return cases(spark, d).filter("case_id % 200 != 0")


def matches(spark: SparkSession, d: str, of: DataFrame | None = None, ids: tuple[int | None, int | None] | None = None) -> DataFrame:
    """Cases, all or those of ``of``, with the sightings of their plates that were read right; cases divisible by 200 have none.

    With ``ids``, the least and the greatest, matches with other ids are not made: cases of which no sighting gives an
    id between these leave before they meet any.
    """
    c = (cases(spark, d) if of is None else of).filter("case_id % 200 != 0").select("case_id", "reported_plate")
    s = sightings(spark, d).filter("plate_text is not null")
    own = F.col("case_id") * 1_000_000
    if ids:
        least, most = s.agg(F.min("sighting_id"), F.max("sighting_id")).first()
        if None in (*ids, least, most):
            return matches(spark, d, c.limit(0))
        c = c.filter(own.between(max(-(2**63), ids[0] - most), min(2**63 - 1, ids[1] - least)))
    j = c.join(s, F.col("reported_plate") == F.col("plate_text"))
    found = j.select((own + F.col("sighting_id")).alias("id"), "case_id", "sighting_id", F.col("plate_confidence").alias("composite_score"), _pick(F.col("sighting_id") / 5, "pending", "verified", "rejected", "flagged").alias("verification_status"), F.col("timestamp").alias("created_at"))
    return found.filter(F.col("id").between(*ids)) if ids else found


def audit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("audit_id"), F.concat(F.lit("B"), (F.col("o_custkey") % 20).cast("string")).alias("user_badge_id"), F.upper("o_orderpriority").alias("action"), F.when(F.col("o_orderstatus") == "O", "case").when(F.col("o_orderstatus") == "F", "match").otherwise("camera").alias("resource_type"),
        F.col("o_custkey").cast("string").alias("resource_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"),
    )


def detections(spark: SparkSession, d: str) -> DataFrame:
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    li = table(spark, d, "lineitem").groupBy(*keys).agg(*[F.min(c).alias(c) for c in ("l_quantity", "l_discount", "l_returnflag")])
    x, y = (F.col("l_partkey") % 300).cast("int"), (F.col("l_quantity") * 4).cast("int")
    det = (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")) * 100_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    return li.select(
        F.concat(F.lit("CAM_"), _pad(F.col("l_suppkey") % 25, 3)).alias("camera_id"), (F.col("l_orderkey") % 500).alias("frame_idx"), det.alias("det_id"), F.array(x, y, x + 120, y + 90).alias("bbox"),
        F.least(F.lit(1.0), F.round(F.col("l_discount") * 10, 1)).alias("confidence"), F.lower("l_returnflag").alias("class_name"), (F.col("l_partkey") % 400).cast("double").alias("lap_var"), (F.col("l_suppkey") % 40).alias("track_id"),
    )


#: The same tables as common table expressions of DuckDB.
SQL = """
v_cameras AS (SELECT 'CAM_' || lpad(n_nationkey::VARCHAR, 3, '0') AS id, n_name AS name, 28.4::DOUBLE + 0.013::DOUBLE * n_nationkey AS latitude, 77.1::DOUBLE + 0.05::DOUBLE * n_regionkey AS longitude,
  'Road ' || n_regionkey::VARCHAR AS road_name, (['active', 'active', 'offline', 'active', 'maintenance'])[n_nationkey % 5 + 1] AS status FROM nation),
v_base AS (SELECT *, 'DL' || lpad((user_id % 100)::VARCHAR, 2, '0') || 'AB' || lpad((user_id % 10000)::VARCHAR, 4, '0') AS base FROM events),
v_sightings AS (SELECT event_id AS sighting_id, 'CAM_' || lpad((CASE WHEN event_id % 97 = 0 THEN 99 ELSE event_id % 25 END)::VARCHAR, 3, '0') AS camera_id, ts AS timestamp,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN translate(base, '018', 'OIB') ELSE base END AS plate_text, least(floor(value / 2), 100)::DOUBLE / 100 AS plate_confidence,
  CASE event_type WHEN 'view' THEN 'car' WHEN 'click' THEN 'truck' WHEN 'signup' THEN 'bus' WHEN 'error' THEN 'motorcycle' ELSE 'van' END AS vehicle_type, (['white', 'black', 'silver', 'grey', 'red'])[user_id % 5 + 1] AS vehicle_color,
  user_id, user_id % greatest(1, (SELECT count(*) FROM embeddings)) AS vec_id, CASE WHEN event_id % 3 = 0 THEN sha256(event_id::VARCHAR) END AS sha256_hash FROM v_base),
v_cases AS (SELECT c_custkey AS case_id, 'FIR-' || lpad(c_custkey::VARCHAR, 6, '0') AS fir_number, 'DL' || lpad((c_custkey % 150 % 100)::VARCHAR, 2, '0') || 'AB' || lpad((c_custkey % 150)::VARCHAR, 4, '0') AS reported_plate,
  TIMESTAMP '2024-01-01 00:00:00' + to_days((c_custkey % 20)::INT) AS theft_datetime, 28.4::DOUBLE + 0.013::DOUBLE * n_nationkey AS theft_latitude, 77.1::DOUBLE + 0.05::DOUBLE * n_regionkey AS theft_longitude,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'car' WHEN 'BUILDING' THEN 'truck' WHEN 'FURNITURE' THEN 'bus' WHEN 'HOUSEHOLD' THEN 'van' ELSE 'motorcycle' END AS case_type, (['white', 'black', 'silver', 'grey', 'red'])[c_custkey // 50 % 5 + 1] AS case_color,
  (['open', 'tracking', 'recovered', 'closed'])[c_custkey // 50 % 4 + 1] AS status, c_custkey % greatest(1, (SELECT count(*) FROM embeddings)) AS ref_id FROM customer JOIN nation ON c_nationkey = n_nationkey),
v_matches AS (SELECT case_id * 1000000 + sighting_id AS id, case_id, sighting_id, plate_confidence AS composite_score, (['pending', 'verified', 'rejected', 'flagged'])[sighting_id // 5 % 4 + 1] AS verification_status, timestamp AS created_at
  FROM v_cases JOIN v_sightings ON reported_plate = plate_text WHERE case_id % 200 <> 0),
v_audit AS (SELECT o_orderkey AS audit_id, 'B' || (o_custkey % 20)::VARCHAR AS user_badge_id, upper(o_orderpriority) AS action, CASE o_orderstatus WHEN 'O' THEN 'case' WHEN 'F' THEN 'match' ELSE 'camera' END AS resource_type, o_custkey::VARCHAR AS resource_id, o_orderdate AS timestamp FROM orders),
v_detections AS (SELECT 'CAM_' || lpad((l_suppkey % 25)::VARCHAR, 3, '0') AS camera_id, l_orderkey % 500 AS frame_idx, (l_orderkey * 1000000 + l_partkey) * 100000 + l_suppkey * 10 + l_linenumber AS det_id, (l_partkey % 300)::INT AS x1, (min(l_quantity) * 4)::INT AS y1,
  least(1.0::DOUBLE, round(min(l_discount) * 10, 1)) AS confidence, lower(min(l_returnflag)) AS class_name, (l_partkey % 400)::DOUBLE AS lap_var, l_suppkey % 40 AS track_id FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey, l_linenumber)
"""
