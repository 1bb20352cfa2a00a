"""Tables that several sessions write and read: immutable segments, deleted keys and one manifest a version.

A transaction writes new folders, which nobody sees, and then publishes a manifest under the next version's name by a rename
that fails if that name is taken.  So a version has all of a transaction's tables or none, a reader keeps the version that it
began with, and of two writers that began with the same version one gets ``Conflict``.  An update costs what changed: new
rows are a further segment, and the keys that they replace are listed with the version that replaced them.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Deleted keys up to so many are sent to every task (some 100 bytes each); more are joined by a shuffle.
SMALL = 500_000


class Conflict(RuntimeError):
    """Another transaction published a version since this one began."""


class _Files:
    """The file system of a path, as Spark sees it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(path).getFileSystem(self.conf)

    def path(self, path: str):  # noqa: ANN201
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        at = self.path(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Writes a file under another name and renames it; whether the name was free."""
        hidden = self.path(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
        stream = self.fs.create(hidden, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        hidden, target = self.fs.makeQualified(hidden), self.fs.makeQualified(self.path(path))
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), self.conf).rename(hidden, target, options)
        except Exception as e:  # noqa: BLE001  Py4J wraps what Java threw
            self.fs.delete(hidden, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


@dataclass(frozen=True)
class Snapshot:
    """One version of all tables."""

    store: TableStore
    version: int
    tables: dict[str, dict[str, Any]]

    def segments(self, name: str) -> list[dict[str, Any]]:
        """path, version, rows and facts of each segment; none if the table isn't there."""
        return self.tables.get(name, {}).get("segments", [])

    def schema(self, name: str) -> StructType:
        return StructType.fromJson(self.tables[name]["schema"])

    def read(self, name: str, segments: Sequence[dict[str, Any]]) -> DataFrame:
        """Rows of some segments, deleted ones too."""
        if not segments:
            return self.store.spark.createDataFrame([], self.schema(name))
        reader = self.store.spark.read.schema(self.schema(name))
        paths = [f"{self.store.path}/{s['path']}" for s in segments]
        if not self.tables[name]["by"]:
            return reader.parquet(*paths)
        parts = [reader.parquet(p) for p in paths]  # folders of partitions under several roots
        return reduce(DataFrame.unionByName, parts)

    def table(self, name: str) -> DataFrame:
        """The table's rows: those of every segment whose key no later version deleted or replaced.

        Segments without later deletions are read as they are; deleted keys are sent to all tasks only up to ``SMALL``.
        """
        about, key = self.tables[name], self.tables[name].get("key")
        gone = about.get("gone", [])
        last = max((g["version"] for g in gone), default=-1)
        fresh = [s for s in about["segments"] if s["version"] >= last]
        old = [s for s in about["segments"] if s["version"] < last]
        if not old:
            return self.read(name, fresh)
        spark, path = self.store.spark, self.store.path
        versioned = None
        for v in sorted({s["version"] for s in old}):
            part = self.read(name, [s for s in old if s["version"] == v]).withColumn("_version", F.lit(v))
            versioned = part if versioned is None else versioned.unionByName(part)
        kind = self.schema(name)[key].dataType.simpleString()
        keys = spark.read.schema(f"_key {kind}, _at bigint").parquet(*[f"{path}/{g['path']}" for g in gone])
        keys = keys.groupBy("_key").agg(F.max("_at").alias("_at"))
        keys = F.broadcast(keys) if sum(g["rows"] for g in gone) <= SMALL else keys
        live = versioned.join(keys, versioned[key].eqNullSafe(keys["_key"]) & (keys["_at"] > versioned["_version"]), "left_anti").drop("_version")
        return live.unionByName(self.read(name, fresh)) if fresh else live


@dataclass
class Transaction:
    """Changes on top of a snapshot; nothing of them is seen before ``commit``."""

    base: Snapshot
    tables: dict[str, dict[str, Any]] = field(default_factory=dict)
    written: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.tables = json.loads(json.dumps(self.base.tables))
        self.version = self.base.version + 1

    def _write(self, name: str, rows: DataFrame, by: str | None) -> str:
        path = f"data/{name}/{self.version:08d}-{uuid.uuid4().hex}"
        self.written.append(path)
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.base.store.path}/{path}")
        return path

    def append(self, name: str, rows: DataFrame, key: str | None = None, facts: Sequence[Column] = (), by: str | None = None, **more: Any) -> dict[str, Any]:
        """Writes rows as a new segment.  ``facts`` are sums worked out on what was written, kept in the manifest with ``more``."""
        about = self.tables.setdefault(name, {"key": key, "by": by, "schema": rows.schema.jsonValue(), "segments": [], "gone": []})
        path = self._write(name, rows, by)
        back = self.base.store.spark.read.schema(rows.schema).parquet(f"{self.base.store.path}/{path}")
        known = back.agg(F.count("*").alias("rows"), *facts).first().asDict()
        segment = {"path": path, "version": self.version, "rows": known.pop("rows"), "facts": {k: v or 0 for k, v in known.items()} | more}
        about["segments"].append(segment)
        return segment

    def delete(self, name: str, keys: DataFrame) -> None:
        """Rows with these keys (one column) that earlier versions hold are gone; rows of this transaction stay."""
        if name in self.tables:
            rows = keys.toDF("_key").distinct().withColumn("_at", F.lit(self.version).cast("bigint"))
            path = self._write(f"{name}-gone", rows, None)
            n = self.base.store.spark.read.parquet(f"{self.base.store.path}/{path}").count()
            if n:
                self.tables[name]["gone"].append({"path": path, "version": self.version, "rows": n})

    def replace(self, name: str, rows: DataFrame, keys: DataFrame, key: str) -> dict[str, Any]:
        """Rows in place of those with the given keys."""
        self.delete(name, keys)
        return self.append(name, rows, key)

    def overwrite(self, name: str, rows: DataFrame, key: str | None = None) -> dict[str, Any]:
        """Rows in place of the whole table."""
        self.tables.pop(name, None)
        return self.append(name, rows, key)

    def commit(self) -> Snapshot:
        """Publishes the version, or raises ``Conflict`` and deletes what was written."""
        manifest = {"version": self.version, "at": time.time(), "tables": self.tables}
        if not self.base.store.files.publish(self.base.store.manifest(self.version), json.dumps(manifest)):
            self.abandon()
            raise Conflict(f"version {self.version} is there already")
        return Snapshot(self.base.store, self.version, self.tables)

    def abandon(self) -> None:
        for path in self.written:
            self.base.store.files.delete(f"{self.base.store.path}/{path}")


class TableStore:
    """Tables below a folder that all machines see."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.files = _Files(spark, self.path)

    def manifest(self, version: int) -> str:
        return f"{self.path}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/manifests") if n.endswith(".json") and not n.startswith(".")]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or a given one; version 0 of a new store has no tables."""
        if version is None:
            version = max(self.versions(), default=0)
        return Snapshot(self, version, json.loads(self.files.read(self.manifest(version)))["tables"] if version else {})

    def begin(self) -> Transaction:
        return Transaction(self.snapshot())

    def compact(self, name: str, most: int = 8) -> Snapshot:
        """Merges the segments of a table once there are more than ``most``, leaving out deleted rows."""
        now = self.snapshot()
        if len(now.segments(name)) + len(now.tables[name]["gone"]) <= most:
            return now
        tx = Transaction(now)
        try:
            tx.overwrite(name, now.table(name), now.tables[name]["key"])
        except PySparkException:
            tx.abandon()
            raise
        return tx.commit()

    def expire(self, keep: int = 2) -> list[str]:
        """Deletes all but the newest versions and the folders that only those held, and says which.

        Folders of versions that are not published yet stay, as somebody may be writing them.
        """
        versions = self.versions()
        kept, old = versions[-keep:], versions[:-keep]
        used = {s["path"] for v in kept for t in self.snapshot(v).tables.values() for s in [*t["segments"], *t["gone"]]}
        out = []
        for name in self.files.names(f"{self.path}/data"):
            for folder in self.files.names(f"{self.path}/data/{name}"):
                if (path := f"data/{name}/{folder}") not in used and int(folder[:8]) <= max(kept, default=0):
                    self.files.delete(f"{self.path}/{path}")
                    out.append(path)
        for v in old:
            self.files.delete(self.manifest(v))
        return out
