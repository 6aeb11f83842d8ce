"""Snapshot stores of nested records.

A snapshot is a manifest, a small file that names a folder of Parquet files for each bucket of keys. A submit reads and writes the bucket of its record
only, into a folder of its own, and then moves a new manifest to the next number, which is refused if that is taken: so submits are atomic, readers
never see half of one, of two that started from the same snapshot one fails, and one that dies leaves nothing that others meet.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.operators.apply import ApplyError, apply_changes, check_record


class FrameStore:
    """The snapshot is a DataFrame in memory's plan; for tests and for changes that are looked at before they are written."""

    def __init__(self, df: DataFrame, key: str):
        self.df, self.key = df, key

    def current(self) -> DataFrame:
        return self.df

    def load(self, record_id):
        return self.df.filter(F.col(f"`{self.key}`") == F.lit(record_id)).first()

    def apply(self, changes):
        check_record(self.df, self.key, changes)
        self.df = apply_changes(self.df, self.key, changes)
        return changes.record_id


class SnapshotStore:
    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = 64):
        """buckets: parts of a new store. A submit rewrites one of them."""
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), conf)
        self._plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self._plain[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE

    def version(self) -> int:
        """The number of the last snapshot; -1 if there is none."""
        if not self._fs.exists(self._path(self.folder)):
            return -1
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(self._path(self.folder))]
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)\.json", n))), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            raise ApplyError("The store has no snapshot.")
        stream = self._fs.open(self._path(f"{self.folder}/v{version}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict, version: int) -> None:
        """Moves the manifest to its number, or fails if another submit has that number."""
        temporary = self._path(f"{self.folder}/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        try:
            self._files.rename(temporary, self._path(f"{self.folder}/v{version}.json"), self._plain)
        except Exception as e:
            self._fs.delete(temporary, False)
            raise ApplyError(f"Snapshot {version} was written by another submit.") from e

    def _bucket(self, key, buckets: int):
        return F.pmod(F.xxhash64(key), F.lit(buckets))

    def create(self, df: DataFrame) -> SnapshotStore:
        """A snapshot of df's rows."""
        part, to = "_bucket", f"data/{uuid.uuid4().hex}"
        df.withColumn(part, self._bucket(F.col(f"`{self.key}`"), self.buckets)).repartition(part).write.partitionBy(part).parquet(f"{self.folder}/{to}")
        there = {int(m[1]) for s in self._fs.listStatus(self._path(f"{self.folder}/{to}")) if (m := re.fullmatch(rf"{part}=(\d+)", str(s.getPath().getName())))}
        self._commit({"schema": df.schema.jsonValue(), "buckets": self.buckets, "parts": {str(b): f"{to}/{part}={b}" for b in sorted(there)}}, self.version() + 1)
        return self

    def _read(self, manifest: dict, parts: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame:
        m = self.manifest()
        return self._read(m, list(m["parts"].values()))

    def _part_of(self, manifest: dict, record_id) -> str:
        kind = T.StructType.fromJson(manifest["schema"])[self.key].dataType
        return str(self.spark.range(1).select(self._bucket(F.lit(record_id).try_cast(kind), manifest["buckets"])).first()[0])

    def load(self, record_id):
        """A record by its key: reads its bucket."""
        m = self.manifest()
        own = m["parts"].get(self._part_of(m, record_id))
        return self._read(m, [own] if own else []).filter(F.col(f"`{self.key}`") == F.lit(record_id)).first()

    def apply(self, changes):
        version = self.version()
        m = self.manifest(version)
        part = self._part_of(m, changes.record_id)
        df = self._read(m, [m["parts"][part]] if part in m["parts"] else [])
        check_record(df, self.key, changes)
        to = f"data/{uuid.uuid4().hex}"
        apply_changes(df, self.key, changes).write.parquet(f"{self.folder}/{to}")
        self._commit(m | {"parts": m["parts"] | {part: to}}, version + 1)
        return changes.record_id
