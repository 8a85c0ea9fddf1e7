"""Sharding by fixed virtual slots.

Records hash into thousands of slots, bytes are summed per slot, and a versioned map names the shard of each slot. Rows that are
repeated hash with a number of their own, so that no slot is as heavy as a row that comes a million times.
A rebalance writes a new version that edits as few entries as it can; no record is hashed anew.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sightline.llm.common import shared_dir, written

#: The number of virtual slots never changes in the life of a dataset.
SLOTS = 8192
#: Parts of a slot, so that no task numbers all rows of a slot.
PARTS = 16
#: Parts in which repeated rows are numbered, so that no task numbers all repeats of a row.
REPEAT_PARTS = 4096
OVERHEAD = 16


def virtual_slot(doc_id: Column, text_crc32: Column, slots: int = SLOTS, repeat: Column | None = None) -> Column:
    """The slot of a record; a null id counts as a value, and so does the number of a repeated row, null for others."""
    return F.pmod(F.xxhash64(F.lit("slot"), doc_id, text_crc32, *([] if repeat is None else [repeat])), F.lit(slots)).cast("int")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of each record; a null text has no bytes and the checksum of an empty one.

    Rows that are equal in doc_id, size and checksum are numbered, each part of them apart, and spread over the slots by their
    numbers. A row that comes once has the same slot in every run.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    row = ["doc_id", "size", "text_crc32"]
    part = F.pmod(F.monotonically_increasing_id(), F.lit(REPEAT_PARTS)).alias("part")
    # written once, as the numbers of rows must not be dealt anew
    rows = written(docs.select("doc_id", (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), part), "op3-sizes")
    repeated = rows.groupBy(*row).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*[F.col(c).alias(f"_{c}") for c in row], F.lit(True).alias("_repeated"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("size") == F.col("_size")) & (F.col("text_crc32") == F.col("_text_crc32"))
    # a repeated row may be a third of all rows; an adaptive join splits it where the repeated ones are too many to send everywhere
    marked = rows.join(repeated, same, "left").select(*row, "part", "_repeated")
    number = F.row_number().over(W.partitionBy(*row, "part").orderBy(F.lit(1)))
    numbered = marked.withColumn("repeat", F.when(F.col("_repeated"), (number - 1) * REPEAT_PARTS + F.col("part")))
    return numbered.select(*row, virtual_slot(F.col("doc_id"), F.col("text_crc32"), slots, F.col("repeat")).alias("vslot"))


def slot_bytes(records: DataFrame) -> dict[int, int]:
    """Bytes of each slot that has records: at most as many entries as there are slots."""
    return {r["vslot"]: r["b"] for r in records.groupBy("vslot").agg(F.sum("size").alias("b")).collect()}


def first_map(loads: dict[int, int], shards: int, slots: int = SLOTS) -> list[int]:
    """Shard by slot: heaviest slot first, each to the lightest shard."""
    heap, owner = [(0, s) for s in range(shards)], [0] * slots
    for slot in sorted(range(slots), key=lambda v: (-loads.get(v, 0), v)):
        load, shard = heapq.heappop(heap)
        owner[slot] = shard
        heapq.heappush(heap, (load + loads.get(slot, 0), shard))
    return owner


def rebalanced(owner: list[int], loads: dict[int, int], shards: int) -> list[int]:
    """The map after loads or the number of shards changed: slots leave shards above the mean for those below.

    Only what a heavy shard has in excess moves; slots of shards that no longer exist all move.
    """
    out, mean = list(owner), sum(loads.values()) / max(1, shards)
    held: list[list[int]] = [[] for _ in range(shards)]
    loose = []
    for slot, shard in enumerate(owner):
        (held[shard] if shard < shards else loose).append(slot)
    load = [sum(loads.get(v, 0) for v in h) for h in held]
    for shard, mine in enumerate(held):
        for slot in sorted(mine, key=lambda v: (-loads.get(v, 0), v)):
            size = loads.get(slot, 0)
            if size and load[shard] - size >= mean:
                load[shard] -= size
                loose.append(slot)
    heap = [(b, s) for s, b in enumerate(load)]
    heapq.heapify(heap)
    for slot in sorted(loose, key=lambda v: (-loads.get(v, 0), v)):
        b, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (b + loads.get(slot, 0), shard))
    return out


def save_map(spark: SparkSession, owner: list[int], version: int, path: str) -> DataFrame:
    """Stores one version of the map under ``path`` and returns its rows: version, vslot, owner. A version that is there is never overwritten."""
    rows = spark.createDataFrame([(v, s) for v, s in enumerate(owner)], "vslot int, owner int").coalesce(1)
    rows.write.parquet(f"{path}/version={version}")
    return load_map(spark, version, path)


def load_map(spark: SparkSession, version: int, path: str) -> DataFrame:
    return spark.read.schema("vslot int, owner int").parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


def latest_version(spark: SparkSession, path: str) -> int:
    """The greatest version of the map that is stored under ``path``; 0 where there is none."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath() for x in fs.listStatus(folder)] if fs.exists(folder) else []
    # a version that was not written to its end has no _SUCCESS
    done = [x.getName() for x in names if x.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return max((int(x.split("=")[1]) for x in done), default=0)


def next_map(spark: SparkSession, loads: dict[int, int], shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """The map for these loads, stored under ``path``: version 1, or the latest one there edited as the next version.

    A map that needs no edit stays the version it is.
    """
    version = latest_version(spark, path)
    if not version:
        return save_map(spark, first_map(loads, shards, slots), 1, path)
    stored = load_map(spark, version, path)
    old = [r["owner"] for r in stored.sort("vslot").collect()]
    if len(old) != slots:
        raise ValueError(f"the map under {path} has {len(old)} slots, not {slots}")
    new = rebalanced(old, loads, shards)
    return stored if new == old else save_map(spark, new, version + 1, path)


def assign(docs: DataFrame, shards: int = 40, path: str | None = None, slots: int = SLOTS) -> DataFrame:
    """One row per record: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version.

    The law is ``bytes``. ``slot`` numbers the records of a shard from 0 without gaps: virtual slots follow each other
    in the shard, and so do the parts of a slot. Repeated rows are records of their own and spread over the slots, so
    sizes stay near equal whatever rows repeat; a null text counts ``OVERHEAD`` bytes; a text of any length is one
    record, and sizes differ by the longest at most; an empty table gives an empty result; other columns are ignored. A map under ``path`` is edited and stored as the next version;
    where there is none, or no path is given, a new one is stored as version 1 (in the shared folder unless given).
    """
    spark = docs.sparkSession
    records = sized(docs, slots).withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)))
    # the parts must not be drawn twice, so the narrow rows are written before they are counted and numbered
    records = written(records, "op3-records")
    path = path or f"{shared_dir(spark)}/op3-map-{uuid.uuid4().hex}"
    current = next_map(spark, slot_bytes(records), shards, path, slots)
    # at most slots * PARTS rows
    counts = records.groupBy("vslot", "part").count().join(F.broadcast(current), "vslot")
    base = F.sum("count").over(W.partitionBy("owner").orderBy("vslot", "part").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select("vslot", "part", "owner", "version", F.coalesce(base, F.lit(0)).alias("start"))
    rank = F.row_number().over(W.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    return records.withColumn("rank", rank).join(F.broadcast(starts), ["vslot", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("owner").alias("shard"), (F.col("start") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.col("version").alias("map_version"),
    )
