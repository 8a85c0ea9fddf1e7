"""Partitioned tables that batches are merged into: versions of partitions, and a log of the batches.

A merge reads and writes only the partitions that its batch touches. It writes them under a new version, and the
version counts once its line is in the log: a batch that fails before leaves nothing that a reader sees, and one that
comes again is found in the log. Partitions that no batch touched keep their files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class MergedTable:
    """Rows under ``path``, partitioned by the column ``by``; ``schema`` has all columns, none of them named part.

    Keys that a merge compares must decide the partition, as rows of other partitions are not read. One writer at a time
    commits a version: a second one fails at the log, whose files are never overwritten.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str) -> None:
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self.schema = spark.createDataFrame([], schema).schema

    def _fs(self, path: str) -> tuple:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def log(self) -> list[dict]:
        """Committed versions in order: version, batch, and the folders of the partitions that it wrote."""
        fs, folder = self._fs(f"{self.path}/log")
        if not fs.exists(folder):
            return []
        rows = self.spark.read.text(f"{self.path}/log").collect()
        return sorted((json.loads(r["value"]) for r in rows), key=lambda x: x["version"])

    def _current(self, log: list[dict]) -> dict[str, str]:
        """The folder that holds each partition now: at most one entry a partition."""
        return {part: f"{self.path}/data/{entry['folder']}/part={part}" for entry in log for part in entry["parts"]}

    def read(self, parts: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of all partitions, or of some, now or as of a version."""
        log = [x for x in self.log() if version is None or x["version"] <= version]
        held = {p: f for p, f in self._current(log).items() if parts is None or p in parts}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        # the column itself is stored too, so folders are read as they are
        return self.spark.read.schema(self.schema).parquet(*held.values())

    def merge(self, batch: DataFrame, batch_id: int | str, merge: Merge, commit: bool = True) -> bool:
        """Merges a batch once: False if the log has it. ``merge`` takes current rows and the batch; the names of touched
        partitions are what reaches the driver. Without ``commit`` the files are written and nothing counts, as after a crash."""
        log = self.log()
        if any(x["batch"] == str(batch_id) for x in log):
            return False
        batch = batch.persist()
        try:
            parts = sorted(str(r[0]) for r in batch.select(F.col(self.by).cast("string")).distinct().collect())
            version = log[-1]["version"] + 1 if log else 1
            folder = f"version={version}-{uuid.uuid4().hex}"
            rows = merge(self.read(parts), batch).select(*self.schema.names)
            rows.withColumn("part", F.col(self.by).cast("string")).write.partitionBy("part").parquet(f"{self.path}/data/{folder}")
        finally:
            batch.unpersist()
        if not commit:
            return False
        fs, file = self._fs(f"{self.path}/log/{version:09}.json")
        out = fs.create(file, False)
        out.write(bytearray(json.dumps({"version": version, "batch": str(batch_id), "folder": folder, "parts": parts}).encode()))
        out.close()
        return True
