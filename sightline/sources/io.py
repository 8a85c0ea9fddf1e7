"""Reading tables, evidence files and JSON columns; appending audit rows; writing dossiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.sources.schemas import TABLES

MEDIA = r"([^/]+)_trk(\d+)_([^_/]+(?:_[^_/]+)*)_(crop|plate|frame)\.jpg$"


def read_table(spark: SparkSession, name: str, uri: str, key: str | None = None, partitions: int = 8, **jdbc: str) -> DataFrame:
    """One of the seven tables, from Parquet files or, for a jdbc: address, from a database.

    With a numeric ``key`` a database is read in ``partitions`` ranges of equal shares of its rows. Filters on the result are pushed to
    the database in each of them. Columns have the types of the table's schema; arrays and maps come as their JSON text, for ``decode_json``.
    """
    if not uri.startswith("jdbc:"):
        return spark.read.schema(TABLES[name]).parquet(f"{uri}/{name}")
    types = dict(c.split(maxsplit=1) for c in TABLES[name].split(", "))
    # a column that is stored as another scalar type is cast by the source
    scalars = ", ".join(f"{c} {t}" for c, t in types.items() if not t.startswith(("array", "map", "timestamp")))
    options = {"url": uri, "customSchema": scalars, **jdbc}
    if key is None:
        return _typed(spark.read.format("jdbc").options(dbtable=name, **options).load(), types)
    whole = spark.read.format("jdbc").options(dbtable=name, url=uri, **jdbc).load()
    # the name as the database writes it, in its own quotes
    stored = next(c for c in whole.columns if c.lower() == key.lower())
    key = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(uri).quoteIdentifier(stored)
    cuts = key_quantiles(spark, name, key, partitions, {"url": uri, **jdbc})
    edges = [None, *cuts, None]
    ranges = [" AND ".join(x for x in (lo is not None and f"{key} >= {lo}", hi is not None and f"{key} < {hi}") if x) or "1 = 1" for lo, hi in zip(edges, edges[1:], strict=False)]
    ranges[0] = f"({ranges[0]}) OR {key} IS NULL"
    return _typed(spark.read.jdbc(uri, name, predicates=ranges, properties={k: v for k, v in options.items() if k != "url"}), types)


def key_quantiles(spark: SparkSession, name: str, key: str, partitions: int, jdbc: dict[str, str]) -> list[int]:
    """The keys that cut a table of a database into ranges of about equal numbers of rows, from a narrow scan of its keys.

    ``key`` is in the quotes of the database. That scan is itself read in equal steps between the least and the greatest key, which the database tells.
    """
    ends = spark.read.format("jdbc").options(query=f"SELECT MIN({key}) AS lo, MAX({key}) AS hi FROM {name}", **jdbc).load().first()
    if ends[0] is None or partitions < 2:
        return []
    steps = {"partitionColumn": "k", "lowerBound": str(int(ends[0])), "upperBound": str(int(ends[1]) + 1), "numPartitions": str(partitions)}
    keys = spark.read.format("jdbc").options(dbtable=f"(SELECT {key} AS k FROM {name}) narrow", **steps, **jdbc).load().toDF("k")
    keys = keys.filter("k is not null").select(F.col("k").cast("double"))
    found = keys.approxQuantile("k", [i / partitions for i in range(1, partitions)], 0.01)
    return sorted({int(x) for x in found if int(ends[0]) < int(x)})


def _typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns under the names of the schema, whatever case the database gives them, and times without a zone."""
    own = {c.lower(): c for c in df.columns}
    kept = [(c, t) for c, t in types.items() if c.lower() in own]
    return df.select(*[(F.col(own[c.lower()]).cast(t) if t.startswith("timestamp") else F.col(own[c.lower()])).alias(c) for c, t in kept])


def decode_json(df: DataFrame, arrays: dict[str, str] | None = None, maps: list[str] | None = None) -> DataFrame:
    """JSON text columns as arrays of the given element types and as string maps; embedding_dim counts a vector."""
    for c, kind in (arrays or {"embedding": "float", "plate_box": "int", "vehicle_box": "int"}).items():
        if c in df.columns:
            df = df.withColumn(c, F.from_json(c, f"array<{kind}>"))
    for c in maps or ["details"]:
        if c in df.columns:
            df = df.withColumn(c, F.from_json(c, "map<string,string>"))
    return df.withColumn("embedding_dim", F.when(F.col("embedding").isNull(), 0).otherwise(F.size("embedding"))) if "embedding" in df.columns else df


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Media files with what their names say and the digest of their bytes; Spark does not list empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").option("recursiveFileLookup", "true").load(path)
    part = lambda i: F.regexp_extract("path", MEDIA, i)
    return files.select("path", part(1).alias("camera_id"), part(2).cast("int").alias("track_id"), part(3).alias("taken"), part(4).alias("kind"), "length", F.sha2("content", 256).alias("sha256"))


def latest_frame(files: DataFrame) -> DataFrame:
    """Per camera the path whose file name is greatest."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.groupBy("camera_id").agg(F.max_by("path", name).alias("path"))


def audit_rows(events: DataFrame) -> DataFrame:
    """Audit events with defaults for badge, user and details, and the action in upper case."""
    or_else = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v)).alias(c)
    no_details = F.create_map().cast("map<string,string>")
    details: Column = F.coalesce(F.col("details"), no_details) if "details" in events.columns else no_details
    return events.select(or_else("user_badge_id", "SYSTEM_AUTO"), or_else("user_name", "Automated Police System"), F.upper("action").alias("action"), "resource_type", F.col("resource_id").cast("string").alias("resource_id"), details.alias("details"), "timestamp")


def append_audit(events: DataFrame, uri: str) -> None:
    audit_rows(events).withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").parquet(uri)


def write_dossiers(dossiers: DataFrame, uri: str) -> None:
    """One folder a case, with one JSON document."""
    dossiers.write.mode("overwrite").partitionBy("case_id").json(uri)
